"""Plans: compositions of operators, and the catalogue of registered queries."""
