"""SimHash near-duplicates joined by pigeonring filtering (after Qin and Xiao, 2018).

A text's fingerprint is the bitwise majority of the XXH64 hashes of its 3-word shingles. Fingerprints
within ``MAX_BITS`` differing bits are linked; components of links are near-duplicate classes.

Pigeonring: lay the m = 4 segments of 16 bits on a ring. If two fingerprints differ in at most 3 bits,
some start s on the ring has running differences d[s] <= 3/4, d[s] + d[s+1] <= 6/4 and
d[s] + d[s+1] + d[s+2] <= 9/4. So one segment is equal, the next differs by at most one bit, and both
with the third by at most two. The first two conditions become join keys: segment s with segment s+1,
one of its 16 bits masked (64 keys of 31 bits each per distinct fingerprint). The third prunes before
the full Hamming check.

Exact copies collapse to one fingerprint before anything is paired. Keys held once are dropped; a key
with more than ``CELL`` fingerprints is cut into blocks and its block pairs spread over tasks. A cell
reports its links as a star per connected part, so rows stay below the cell's size. Components come
from alternating large-star and small-star steps (Kiveris et al., 2014) on checkpointed edges.

Defined results: null and empty texts have fingerprint 0 and link like any other; texts of one or two
words hash the whole sequence; repeated rows are reported each; a null id never names a component
unless all ids of it are null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lingotally.functions.binding import free_prefix

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEED = 42
SHINGLE = 3
MAX_BITS = 3
CELL = 2048
TASK_NODES = 20_000
PIECE = 1 << 16


def _fingerprint(text: str | None, k: int = SHINGLE) -> int:
    from xxhash import xxh64_digest

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII case and white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= k:
        starts, ends = [0], [len(joined)]
    else:
        stops = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], stops[:-k])).tolist()
        ends = (stops[k - 1:] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(starts), PIECE):
        digests = b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts[i:i + PIECE], ends[i:i + PIECE])])
        bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    return pd.Series([_fingerprint(t) for t in texts], dtype="int64")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (signed 64-bit)."""
    return docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fingerprint"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def ring_keys(nodes: DataFrame) -> DataFrame:
    """turn, key, fp: per ring start the equal segment and the next one with one bit masked."""
    fp = F.col("fp")
    keys = []
    for s in range(4):
        turned = fp if s == 0 else F.shiftleft(fp, 16 * s).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * s))
        head = F.shiftrightunsigned(turned, 32)  # segment s, then segment s+1
        for b in range(16):
            keys.append(head.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << b))).bitwiseOR(
                F.lit((s * 16 + b) << 32).cast("bigint")))
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _stars(fps: np.ndarray, start: int, max_bits: int) -> list[tuple[int, int]]:
    """Links inside one cell as (member, least member of its part)."""
    fps = np.sort(fps)
    n = len(fps)
    u = fps.view(np.uint64)
    label = np.arange(n)
    third = np.uint64(((1 << 48) - 1) << 16)  # segments s, s+1, s+2 after turning

    def linked(lo: int, hi: int) -> np.ndarray:
        x = u[lo:hi, None] ^ u[None, :]
        if start:
            x = (x << np.uint64(16 * start)) | (x >> np.uint64(64 - 16 * start))
        near = np.bitwise_count(x & third) <= 2
        return near & (np.bitwise_count(x) <= max_bits)

    step = max(1, (1 << 22) // n)
    while True:
        new = label.copy()
        for lo in range(0, n, step):
            hit = linked(lo, min(lo + step, n))
            new[lo:lo + step] = np.where(hit, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(fps[i]), int(fps[label[i]])) for i in np.flatnonzero(label != np.arange(n))]


def _cell_links(keys: pd.Series, cells: pd.Series) -> pd.Series:
    out = []
    for key, fps in zip(keys, cells):
        start = (key >> 32) // 16
        if len(fps) == 2:
            a, b = int(min(fps)), int(max(fps))
            near = ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= MAX_BITS
            out.append([{"u": b, "v": a}] if near else [])
        else:
            stars = _stars(np.asarray(fps, dtype=np.int64), start, MAX_BITS)
            out.append([{"u": u, "v": v} for u, v in stars])
    return pd.Series(out)


cell_links = F.pandas_udf(_cell_links, T.ArrayType(
    T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])))


def links(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """u, v: links whose components are those of all pairs within ``MAX_BITS`` bits.

    ``nodes`` holds distinct fingerprints ``fp``.
    """
    keys = ring_keys(nodes)
    many = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    # Spark sizes both sides as the fingerprints before they became 64 keys each, and would send them through the driver
    shared = keys.join(many.hint("merge"), "key")
    blocks = F.ceil(F.col("n") / cell)
    own = F.pmod(F.xxhash64("fp"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), blocks - 1),
                        lambda b: F.struct(F.least(own, b).alias("a"), F.greatest(own, b).alias("b")))
    cells = shared.select("key", "fp", F.explode(pairs).alias("cell")).groupBy("key", "cell").agg(
        F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    found = cells.select(F.explode(cell_links("key", "fps")).alias("e"))
    return found.select("e.u", "e.v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node that has a link; rounds go on until nothing moves."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = e.checkpoint(eager=True)
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = e.union(e.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("x", "m"))
        e = both.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter(
            "u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.*").filter(
            "u <> v").distinct().checkpoint(eager=True)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(fps: DataFrame, cell: int = CELL) -> DataFrame:
    """fp, component_id for every distinct fingerprint of ``fps`` (doc_id, fingerprint)."""
    nodes = fps.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("_least")).checkpoint(eager=True)
    # each fingerprint becomes 64 keys: tasks grow in number with the fingerprints, not with their few bytes
    tasks = math.ceil(nodes.count() / TASK_NODES) or 1
    roots = components(links(nodes.select("fp").repartition(tasks, "fp"), cell))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "_least")
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    return named.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    fps = fingerprints(docs, doc_id, text).checkpoint(eager=True)
    c = classes(fps, cell).checkpoint(eager=True)
    return fps.join(c, fps["fingerprint"] == c["fp"]).select("doc_id", "fingerprint", "component_id")


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> DataFrame:
    """One row of every near-duplicate class, with all its columns: that of the smallest id.

    Winners are chosen among ids and fingerprints; texts move once, to meet them.
    """
    fps = fingerprints(docs, doc_id, text).checkpoint(eager=True)
    c = classes(fps, cell)
    named = fps.join(c, fps["fingerprint"] == c["fp"])
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "fingerprint")
    won = named.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("_alone")).agg(
        F.min(first).alias("w")).select(F.col("w.doc_id").alias("_w_id"), F.col("w.fingerprint").alias("_w_fp"))
    p = free_prefix(docs.columns)
    won = won.toDF(*[f"{p}{c}" for c in won.columns])
    rows = docs.withColumn(f"{p}row", fingerprint(F.col(f"`{text}`")))
    kept = rows.join(won, F.col(f"`{doc_id}`").eqNullSafe(F.col(f"{p}_w_id")) & (F.col(f"{p}row") == F.col(f"{p}_w_fp")), "left_semi")
    return kept.dropDuplicates([doc_id, f"{p}row"]).select(*[F.col(f"`{x}`") for x in docs.columns])
