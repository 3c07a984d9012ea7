"""Address lookups against brute force, in both ways, and at millions of ranges."""

import bisect
import ipaddress
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lingotally.operators import geo
from lingotally.session import checkpoints

PLACE = "country_code string, country_name string, city string, latitude double, longitude double"


@pytest.fixture(scope="module")
def spark(spark):
    return checkpoints(spark)


def disjoint(r, n, bits, start):
    """Random disjoint ranges, some of one address, some touching."""
    out, at = [], start
    for i in range(n):
        at += r.choice([0, 1, r.getrandbits(bits)])
        size = r.choice([0, 0, 1, r.getrandbits(bits)])
        out.append((at, at + size, f"c{i % 7}", f"n{i % 7}", None if i % 5 == 0 else f"t{i}", i * 1.0, None))
        at += size + 1
    return out


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    four = disjoint(r, 900, 18, 8 << 24)
    six = disjoint(r, 900, 90, 0x2A << 120)
    asked = [str(ipaddress.ip_address(max(0, x + d))) for f in (four, six) for lo, hi, *_ in f
             for x in (lo, hi) for d in (-1, 0, 1)]
    asked += [str(ipaddress.IPv4Address(r.getrandbits(32))) for _ in range(500)]
    asked += [str(ipaddress.IPv6Address((0x2A << 120) + r.getrandbits(100))) for _ in range(500)]
    asked += ["::ffff:8.8.8.8", "::", "bad", "1.2.3", "10.1.2.3", "fe80::1", None] + ["8.8.8.8"] * 3000
    ips = spark.createDataFrame(list(enumerate(asked)), "i int, ip string").repartition(4)
    v4 = spark.createDataFrame(four, f"lo bigint, hi bigint, {PLACE}")
    v6 = spark.createDataFrame([(f"{a:032x}", f"{b:032X}", *x) for a, b, *x in six], f"lo string, hi string, {PLACE}")
    return asked, four, six, ips, v4, v6


@pytest.mark.parametrize("index_bytes", [1 << 20, 0])
def test_both_families_against_brute_force(tables, index_bytes):
    asked, four, six, ips, v4, v6 = tables
    got = {r.i: r for r in geo.geo_lookup(ips, v4, v6, index_bytes=index_bytes).collect()}
    assert len(got) == len(asked)
    for i, text in enumerate(asked):
        try:
            x = ipaddress.ip_address(text)
        except ValueError:
            assert got[i].error == "not a valid IP address" and got[i].country_code is None
            continue
        table = four if x.version == 4 else six
        at = bisect.bisect([t[0] for t in table], int(x)) - 1
        want = table[at][2:] if at >= 0 and int(x) <= table[at][1] and not got[i].is_private else (None,) * 5
        found = got[i]
        assert (found.country_code, found.country_name, found.city, found.latitude, found.longitude) == want, text
        assert found.error is None


def test_bytes_compare_as_numbers():
    r = random.Random(1)
    numbers = sorted({0, 1, 255, 256, 2 ** 128 - 1, 1 << 127, *(r.getrandbits(128) >> r.randint(0, 127) for _ in range(2000))})
    packed = np.array([x.to_bytes(16, "big") for x in numbers], dtype="S16")
    assert (np.argsort(packed, kind="stable") == np.arange(len(numbers))).all()
    assert np.searchsorted(packed, packed, side="right").tolist() == list(range(1, len(numbers) + 1))


def test_millions_of_ranges_without_shuffling_addresses(spark):
    """Two million ranges of 512 addresses with a gap of 512: located where the addresses are."""
    k = F.col("id")
    ranges = spark.range(2_000_000).select(
        (k * 1024 + (1 << 24)).alias("lo"), (k * 1024 + (1 << 24) + 511).alias("hi"),
        F.concat(F.lit("c"), (k % 200).cast("string")).alias("country_code"), F.lit("n").alias("country_name"),
        F.concat(F.lit("t"), (k % 5000).cast("string")).alias("city"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    value = (1 << 24) + (k * 7919) % (2_000_000 * 1024)
    octets = [F.shiftright(value, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string") for s in (24, 16, 8, 0)]
    ips = spark.range(200_000).select(value.alias("v"), F.concat_ws(".", *octets).alias("ip"))
    began = time.time()
    found = geo.geo_lookup(ips, ranges)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [x for x in re.findall(r"\bExchange [^\n]*", plan)] == [] and "BroadcastHashJoin" in plan
    at = F.floor((F.col("v") - (1 << 24)) / 1024)
    inside = (F.col("v") - (1 << 24)) % 1024 < 512
    want = F.when(inside & ~F.col("is_private"), F.concat(F.lit("t"), (at % 5000).cast("string")))
    n = found.agg(F.count("*").alias("n"), F.count_if(~F.col("city").eqNullSafe(want)).alias("bad"),
                  F.count_if(F.col("city").isNotNull()).alias("hits")).first()
    assert (n.n, n.bad) == (200_000, 0) and n.hits > 90_000
    assert time.time() - began < 120


def test_empty_and_inverted_ranges(spark):
    ips = spark.createDataFrame([("8.8.8.8", 1)], "ip string, _place int")
    none = spark.createDataFrame([], f"lo bigint, hi bigint, {PLACE}")
    for index_bytes in (1 << 20, 0):
        got = geo.geo_lookup(ips, none, index_bytes=index_bytes)
        assert got.columns[:2] == ["ip", "_place"] and [(r.country_code, r[1]) for r in got.collect()] == [(None, 1)]
    back = spark.createDataFrame([(9, 3, "x", "x", "x", 0.0, 0.0), (None, 3, "x", "x", "x", 0.0, 0.0)], none.schema)
    assert geo.geo_lookup(ips, back).first().country_code is None
    assert geo.geo_lookup(ips.limit(0), back).count() == 0
