"""Addresses, private ranges and range lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from lingotally import refdata as R
from lingotally.functions import net
from lingotally.operators import geo, rules
from lingotally.plans.catalogue.registry import documents, query, table

SLICE, USED = 2621, 2000  # /16 blocks per nation, and how many of them its range covers


def _addresses(spark, sf):
    """Mixed addresses from event numbers: mostly IPv4, some IPv6, some malformed."""
    e = F.col("event_id")
    value = (F.col("user_id") * F.lit(2654435761) + e * 40503) % F.lit(4294967296)
    ip = (
        F.when(e % 50 == 0, F.concat(F.lit("bad-"), e.cast("string")))
        .when(e % 53 == 0, F.concat(F.lit("fe80::"), F.lower(F.hex(e % 65536))))
        .when(e % 59 == 0, F.concat(F.lit("2001:db8::"), F.lower(F.hex(e % 65536))))
        .when(e % 61 == 0, F.concat(F.lit("192.168."), (e % 256).cast("string"), F.lit(".7")))
        .otherwise(net.int_to_ipv4(value.cast("bigint")))
    )
    return table(spark, sf, "events").select("event_id", ip.alias("ip"))


def _ranges(spark, sf):
    k = F.col("n_nationkey").cast("bigint")
    return table(spark, sf, "nation").select(
        (k * SLICE * 65536).alias("lo"), ((k * SLICE + USED) * 65536 - 1).alias("hi"),
        F.upper(F.substring("n_name", 1, 2)).alias("country_code"), F.col("n_name").alias("country_name"),
        F.concat(F.lit("city-"), k.cast("string")).alias("city"),
        (k * 1.5).alias("latitude"), (k * -2.5).alias("longitude"),
    )


SQL_ADDR = """addr AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'bad-' || event_id
 WHEN event_id % 53 = 0 THEN 'fe80::' || lower(printf('%x', event_id % 65536))
 WHEN event_id % 59 = 0 THEN '2001:db8::' || lower(printf('%x', event_id % 65536))
 WHEN event_id % 61 = 0 THEN '192.168.' || event_id % 256 || '.7'
 ELSE (n // 16777216) || '.' || (n // 65536 % 256) || '.' || (n // 256 % 256) || '.' || (n % 256)
 END AS ip FROM (SELECT event_id, (user_id * 2654435761 + event_id * 40503) % 4294967296 AS n
 FROM events)),
 num AS (SELECT *, CASE WHEN v4 THEN CAST(split_part(ip,'.',1) AS BIGINT) * 16777216 +
 CAST(split_part(ip,'.',2) AS BIGINT) * 65536 + CAST(split_part(ip,'.',3) AS BIGINT) * 256 +
 CAST(split_part(ip,'.',4) AS BIGINT) END AS n FROM (SELECT *,
 regexp_full_match(ip, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS v4 FROM addr)),
 priv AS (SELECT event_id, ip, n, v4 OR contains(ip, ':') AS valid,
 CASE WHEN v4 THEN n = 0 OR n // 16777216 IN (10, 127) OR n // 1048576 = 2753
  OR n // 65536 IN (43518, 49320) OR n // 256 IN (12582914, 12989284, 13303921)
  OR n // 268435456 = 14 OR n // 4194304 = 401 OR n = 4294967295
 ELSE starts_with(ip, 'fe80') END AS is_private FROM num)"""
# 172.16/12 is n // 2^20 = 2753; 169.254 and 192.168 are n // 2^16; 192.0.2, 198.51.100
# and 203.0.113 n // 2^8; 224/4 is n // 2^28 = 14; 100.64/10 is n // 2^22 = 401.
SQL_RANGES = f"""ranges AS (SELECT CAST(n_nationkey AS BIGINT) * {SLICE} * 65536 AS lo,
 (CAST(n_nationkey AS BIGINT) * {SLICE} + {USED}) * 65536 - 1 AS hi,
 upper(substring(n_name, 1, 2)) AS country_code, n_name AS country_name,
 'city-' || n_nationkey AS city, n_nationkey * 1.5 AS latitude, n_nationkey * -2.5 AS longitude
 FROM nation)"""


@query("ip_private", f"WITH {SQL_ADDR} SELECT event_id, ip, valid, is_private FROM priv")
def ip_private(spark, sf):
    ip = F.col("ip")
    return _addresses(spark, sf).select(
        "event_id", "ip", net.ip_valid(ip).alias("valid"), net.is_private(ip).alias("is_private")
    )


@query("geo_lookup", f"""WITH {SQL_ADDR}, {SQL_RANGES} SELECT event_id, ip, is_private,
 country_code, country_name, city, CAST(latitude AS DOUBLE) AS latitude,
 CAST(longitude AS DOUBLE) AS longitude,
 CASE WHEN NOT valid THEN 'not a valid IP address' END AS error
 FROM priv LEFT JOIN ranges ON NOT is_private AND n BETWEEN lo AND hi""")
def geo_lookup(spark, sf):
    return geo.geo_lookup(_addresses(spark, sf), _ranges(spark, sf)).drop("asn", "org")


V6_SLICE, V6_USED = 40, 30  # blocks of 2a00::/16 per nation, and how many of them its range covers


def _addresses_v6(spark, sf):
    """Both families: every third event has an IPv6 address in one of 1024 blocks."""
    e = F.col("event_id")

    def h(c):
        return F.lower(F.hex(c))

    v6 = F.concat(F.lit("2a00:"), h(F.col("user_id") % 1024), F.lit("::"), h(F.floor(e / 65536)), F.lit(":"), h(e % 65536))
    return _addresses(spark, sf).join(
        table(spark, sf, "events").select("event_id", "user_id"), "event_id").select(
        "event_id", F.when(e % 3 == 0, v6).otherwise(F.col("ip")).alias("ip"))


def _ranges_v6(spark, sf):
    k = F.col("n_nationkey")

    def block(c, fill):
        return F.rpad(F.concat(F.lit("2a00"), F.lpad(F.lower(F.hex(c)), 4, "0")), 32, fill)

    return table(spark, sf, "nation").select(
        block(k * V6_SLICE, "0").alias("lo"), block(k * V6_SLICE + V6_USED - 1, "f").alias("hi"),
        F.upper(F.substring("n_name", 1, 2)).alias("country_code"), F.col("n_name").alias("country_name"),
        F.concat(F.lit("six-"), k.cast("string")).alias("city"), (k * 1.5).alias("latitude"), (k * -2.5).alias("longitude"))


@query("geo_lookup_v6", f"""WITH {SQL_ADDR}, {SQL_RANGES},
 six AS (SELECT event_id, printf('%x', user_id % 1024) AS a, user_id % 1024 AS block, printf('%x', event_id // 65536) AS b,
  printf('%x', event_id % 65536) AS c FROM events WHERE event_id % 3 = 0),
 n6 AS (SELECT n_nationkey * {V6_SLICE} AS lo, n_nationkey * {V6_SLICE} + {V6_USED} - 1 AS hi,
  upper(substring(n_name, 1, 2)) AS country_code, n_name AS country_name, 'six-' || n_nationkey AS city,
  n_nationkey * 1.5 AS latitude, n_nationkey * -2.5 AS longitude FROM nation)
 SELECT event_id, '2a00:' || a || '::' || b || ':' || c AS ip, false AS is_private, country_code, country_name, city,
 CAST(latitude AS DOUBLE) AS latitude, CAST(longitude AS DOUBLE) AS longitude, CAST(NULL AS VARCHAR) AS error
 FROM six LEFT JOIN n6 ON block BETWEEN lo AND hi
 UNION ALL SELECT event_id, ip, is_private, country_code, country_name, city, CAST(latitude AS DOUBLE),
 CAST(longitude AS DOUBLE), CASE WHEN NOT valid THEN 'not a valid IP address' END
 FROM priv LEFT JOIN ranges ON NOT is_private AND n BETWEEN lo AND hi WHERE event_id % 3 <> 0""")
def geo_lookup_v6(spark, sf):
    """Addresses of both families, looked up in one pass."""
    return geo.geo_lookup(_addresses_v6(spark, sf), _ranges(spark, sf), _ranges_v6(spark, sf)).drop("asn", "org")


@query("geo_lookup_merged", f"""WITH {SQL_ADDR}, {SQL_RANGES} SELECT event_id, ip, is_private,
 country_code, city, CASE WHEN NOT valid THEN 'not a valid IP address' END AS error
 FROM priv LEFT JOIN ranges ON NOT is_private AND n BETWEEN lo AND hi""")
def geo_lookup_merged(spark, sf):
    """The way of tables beyond the bound of the index: a sorted merge of ranges and distinct addresses."""
    found = geo.geo_lookup(_addresses(spark, sf), _ranges(spark, sf), index_bytes=0)
    return found.drop("asn", "org", "country_name", "latitude", "longitude")


@query("geo_country_counts", f"""WITH {SQL_ADDR}, {SQL_RANGES}
 SELECT coalesce(country_name, CASE WHEN NOT valid THEN 'invalid' WHEN is_private THEN 'private'
 ELSE 'unknown' END) AS place, count(*) AS n_events FROM priv
 LEFT JOIN ranges ON NOT is_private AND n BETWEEN lo AND hi GROUP BY 1""")
def geo_country_counts(spark, sf):
    """Addresses are counted first: a hot address is looked up once."""
    counted = _addresses(spark, sf).groupBy("ip").agg(F.count("*").alias("n"))
    found = geo.geo_lookup(counted, _ranges(spark, sf))
    other = F.when(F.col("error").isNotNull(), "invalid").when(
        F.col("is_private"), "private").otherwise("unknown")
    return found.groupBy(F.coalesce("country_name", other).alias("place")).agg(
        F.sum("n").alias("n_events")
    )


IPV4_RE = r"\b" + R.OCTET + r"(?:\." + R.OCTET + r"){3}\b"


@query("ipv4_in_docs", f"""SELECT doc_id, ip, count(*) AS n FROM (SELECT doc_id,
 unnest(regexp_extract_all(text, '{IPV4_RE}')) AS ip FROM documents) GROUP BY ALL""")
def ipv4_in_docs(spark, sf):
    only = [r for r in rules.default_rules() if r["string_id"] == "dotted_quad"]
    hits = rules.rule_hits(documents(spark, sf, "text"), {"source": "text"}, ["doc_id"], only)
    return rules.rule_offsets(hits, ["doc_id"]).groupBy("doc_id", F.col("data").alias("ip")).agg(
        F.count("*").alias("n")
    )
