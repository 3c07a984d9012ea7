"""lingotally: multilingual text-corpus analytics as PySpark DataFrame operators."""
