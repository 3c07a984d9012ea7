"""Range join of IP addresses with a table of address ranges.

Ranges become an index: sorted arrays of bounds and the number of the place each range belongs to. While it
fits ``INDEX_BYTES`` it travels to the workers, every Arrow batch of addresses is located by binary search, and
no address is shuffled. Beyond that, ranges and distinct addresses are dealt by ranges of address, sorted and
merged in one streaming pass per task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lingotally.functions import net
from lingotally.functions.binding import free_prefix
from lingotally.operators.sizes import broadcast_if_small
from lingotally.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FIELDS = ["country_code", "country_name", "city", "latitude", "longitude"]
INDEX_BYTES = 128 << 20
# packed bytes of a range: two bounds and the number of its place
V4_BYTES, V6_BYTES = 4 + 4 + 8, 16 + 16 + 8
V4, V6 = "4", "6"


def v4_key(value: Column) -> Column:
    """Text key of a numeric IPv4 address; keys sort as addresses do, all IPv4 before all IPv6."""
    return F.concat(F.lit(V4), F.lower(F.lpad(F.hex(value), 8, "0")))


def v6_key(digits: Column) -> Column:
    return F.concat(F.lit(V6), digits)


def keyed_ranges(ranges: DataFrame, ranges_v6: DataFrame | None = None) -> DataFrame:
    """lo, hi as text keys, and the fields, of both families; ranges without an address are left out."""
    out = ranges.select(v4_key(F.col("lo")).alias("lo"), v4_key(F.col("hi")).alias("hi"), *FIELDS)
    if ranges_v6 is not None:
        out = out.unionByName(ranges_v6.select(
            v6_key(F.lower("lo")).alias("lo"), v6_key(F.lower("hi")).alias("hi"), *FIELDS))
    return out.filter("lo <= hi")


def numbered_places(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges as (lo, hi, place) and the distinct places (place, fields): both stored once.

    A range table names the same place many times, so its text is kept once per place.
    """
    fields = F.struct(*FIELDS)
    places = durable(keyed.groupBy(fields.alias("_at")).agg(F.count("*").alias("_n")).select(
        F.monotonically_increasing_id().alias("place"), "_at"))
    found = keyed.join(broadcast_if_small(places), fields.eqNullSafe(F.col("_at")))
    return durable(found.select("lo", "hi", "place")), places.select("place", "_at.*")


class IntervalIndex:
    """Sorted bounds and places of disjoint ranges, one pair of arrays per family."""

    def __init__(self, v4: tuple[np.ndarray, np.ndarray, np.ndarray], v6: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.v4, self.v6 = v4, v6

    @staticmethod
    def collect(ranges: DataFrame) -> IntervalIndex:
        """Pack the ranges (lo, hi, place); the caller has checked their number."""
        is4 = F.substring("lo", 1, 1) == V4

        def number(c: str) -> Column:
            return F.conv(F.substring(c, 2, 8), 16, 10).cast("bigint").alias(c)

        def raw(c: str) -> Column:
            return F.unhex(F.substring(c, 2, 32)).alias(c)

        a = ranges.filter(is4).select(number("lo"), number("hi"), "place").toArrow().sort_by("lo")
        b = ranges.filter(~is4).select(raw("lo"), raw("hi"), "place").toArrow()
        low, high = (np.array(b[c].to_pylist(), dtype="S16") for c in ("lo", "hi"))
        order = np.argsort(low, kind="stable")
        return IntervalIndex(
            (a["lo"].to_numpy().astype(np.uint32), a["hi"].to_numpy().astype(np.uint32),
             a["place"].to_numpy()),
            (low[order], high[order], b["place"].to_numpy()[order]))

    @staticmethod
    def _locate(arrays: tuple[np.ndarray, np.ndarray, np.ndarray], address: np.ndarray) -> np.ndarray:
        low, high, place = arrays
        if not len(low):
            return np.full(len(address), -1, dtype=np.int64)
        at = np.searchsorted(low, address, side="right") - 1
        inside = (at >= 0) & (address <= high[at])
        return np.where(inside, place[at], -1)

    def locate(self, v4: np.ndarray, v6: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of numeric IPv4 and 16-byte IPv6 addresses; -1 outside all ranges."""
        return self._locate(self.v4, v4.astype(np.uint32)), self._locate(self.v6, v6)


def locator(spark, index: IntervalIndex):
    """Function from (IPv4 number, IPv6 bytes), at most one of them not null, to the place."""
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("bigint")
    def locate(v4: pd.Series, v6: pd.Series) -> pd.Series:
        out = np.full(len(v4), -1, dtype=np.int64)
        is4, is6 = v4.notna().to_numpy(), v6.notna().to_numpy()
        out[is4], out[is6] = shared.value.locate(
            v4[is4].to_numpy().astype(np.int64), np.array(v6[is6].tolist(), dtype="S16"))
        return pd.Series(out).where(out >= 0, None).astype("Int64")

    return locate


def merged_places(keys: DataFrame, ranges: DataFrame, parts: int) -> DataFrame:
    """key, place of every distinct key inside a range, by one sorted merge of keys and ranges.

    Rows are dealt by ranges of key, so a task holds its stretch of the address space only; the range that is
    open where a stretch begins comes from the stretches before (one row each on the driver).
    """
    none = F.lit(None)
    events = ranges.select(F.col("lo").alias("key"), F.lit(0).alias("kind"), "hi", "place").unionByName(
        keys.select("key", F.lit(1).alias("kind"), none.cast("string").alias("hi"), none.cast("bigint").alias("place")))
    dealt = durable(events.repartitionByRange(parts, "key", "kind").sortWithinPartitions("key", "kind").withColumn(
        "part", F.spark_partition_id()))
    last = dealt.filter("kind = 0").groupBy("part").agg(F.max_by(F.struct("hi", "place"), "key").alias("r")).collect()
    ends = sorted((r.part, r.r.hi, r.r.place) for r in last)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, place, begun = "", -1, False
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                for part, h, p in ends:
                    if part < batch["part"][0].as_py():
                        hi, place = h, p
                begun = True
            opens = batch["kind"].to_numpy() == 0
            # number of the latest range at or before every row, 0 for the one carried in
            which = np.cumsum(opens)
            his = np.array([hi, *batch["hi"].filter(pa.array(opens)).to_pylist()], dtype=object)
            places = np.concatenate(([place], batch["place"].filter(pa.array(opens)).to_numpy()))
            hi, place = his[-1], int(places[-1])
            rows = np.flatnonzero(~opens)
            keys_ = np.array(batch["key"].take(pa.array(rows)).to_pylist(), dtype=object)
            inside = np.array(keys_ <= his[which[rows]], dtype=bool) if len(rows) else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys_[inside], type=pa.string()),
                 pa.array(places[which[rows]][inside].astype(np.int64))], names=["key", "place"])

    return dealt.mapInArrow(merge, "key string, place bigint")


def geo_lookup(ips: DataFrame, ranges: DataFrame, ranges_v6: DataFrame | None = None,
               ip: str = "ip", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Location of every address; private ones are not looked up, malformed ones get an error.

    ``ranges`` (lo, hi as numbers) and ``ranges_v6`` (lo, hi as 32 hex digits) are disjoint. Up to
    ``index_bytes`` of packed ranges are searched where the addresses are; more are merged with the distinct
    addresses, whose places are then joined back (unique right side, so that adaptive execution can split a hot
    address).
    """
    spark, p = ips.sparkSession, free_prefix(ips.columns)
    found, places = numbered_places(keyed_ranges(ranges, ranges_v6))
    n = found.agg(F.count("*").alias("n"), F.count_if(F.col("lo").startswith(V4)).alias("v4")).first()
    own, four, six = F.col(f"`{ip}`"), F.col(f"{p}v4"), F.col(f"{p}v6")
    df = ips.select("*", net.ipv4_to_int(own).alias(f"{p}v4"), net.ipv6_to_hex(own).alias(f"{p}v6"))
    df = df.withColumn(f"{p}private", F.coalesce(net.is_private_v4(four), net.is_private_v6(six), F.lit(False)))
    public = ~F.col(f"{p}private")
    if n.v4 * V4_BYTES + (n.n - n.v4) * V6_BYTES <= index_bytes:
        locate = locator(spark, IntervalIndex.collect(found))
        df = df.withColumn(f"{p}place", locate(F.when(public, four), F.when(public, F.unhex(six))))
    else:
        df = df.withColumn(f"{p}key", F.when(public, F.coalesce(v4_key(four), v6_key(six))))
        key = F.col(f"{p}key")
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n.n // 1_000_000)
        merged = merged_places(df.filter(key.isNotNull()).select(key.alias("key")).distinct(), found, parts)
        # rows that need no lookup get keys of their own, so that they neither match nor pile up
        spread = F.concat(F.lit("-"), F.xxhash64(own).cast("string"))
        df = df.join(merged.withColumnsRenamed({"key": f"{p}mk", "place": f"{p}place"}),
                     F.coalesce(key, spread) == F.col(f"{p}mk"), "left")
    error = F.when(four.isNull() & six.isNull(), "not a valid IP address")
    named = places.select(F.col("place").alias(f"{p}p"), *[F.col(c).alias(f"{p}{c}") for c in FIELDS])
    df = df.withColumn(f"{p}error", error).join(
        broadcast_if_small(named), F.col(f"{p}place") == F.col(f"{p}p"), "left")
    return df.select(
        *[F.col(f"`{c}`") for c in ips.columns], F.col(f"{p}private").alias("is_private"),
        *[F.col(f"{p}{c}").alias(c) for c in FIELDS], F.lit(None).cast("int").alias("asn"),
        F.lit(None).cast("string").alias("org"), F.col(f"{p}error").alias("error"),
    )
