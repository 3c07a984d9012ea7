"""File trees, partial reads and line numbers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lingotally.sources import readers, tree


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a" / ".deep" / "x").mkdir(parents=True)
    (tmp_path / "_b").mkdir()
    (tmp_path / "_a.txt").write_bytes(b"%PDF-1.7 and more than sixteen bytes")
    (tmp_path / ".b.txt").write_bytes(b"short")
    (tmp_path / "a" / "spaced name é.bin").write_bytes(b"\x00\x01")
    (tmp_path / "a" / ".deep" / "x" / "z.txt").write_bytes(b"")
    (tmp_path / "_b" / "one.txt").write_bytes(b"one")
    with open(tmp_path / "a" / "huge.bin", "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n")
        f.truncate((2 << 30) + 5)  # a hole, no blocks on disk
    (tmp_path / "link.txt").symlink_to(tmp_path / "_a.txt")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    return tmp_path


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.collect())


ALL = [".b.txt", "_a.txt", "huge.bin", "one.txt", "spaced name é.bin", "z.txt"]


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_hidden_names_links_and_huge_files(spark, files, parts):
    found = tree.load_tree(spark, str(files), 16, parts)
    got = {r.path.rsplit("/", 1)[1]: r for r in found.collect()}
    assert sorted(got) == ALL and found.count() == len(ALL)
    assert bytes(got["_a.txt"].head) == b"%PDF-1.7 and mor" and bytes(got["z.txt"].head) == b""
    assert got["huge.bin"].length == (2 << 30) + 5 and bytes(got["huge.bin"].head)[:4] == b"\x89PNG"
    assert all(r.path == f"file:{files}/{os.path.relpath(r.path[5:], files)}" for r in got.values())
    assert abs(got["one.txt"].modificationTime.timestamp() - (files / "_b" / "one.txt").stat().st_mtime) < 1
    assert names(tree.load_tree(spark, f"file://{files}", 0, parts)) == ALL


def test_only_the_head_is_read(spark, files, monkeypatch):
    """Bytes read are counted where the reader reads them."""
    asked = []
    real = os.read
    monkeypatch.setattr(os, "read", lambda fd, n: asked.append(n) or real(fd, n))
    reader = tree.TreeReader(str(files), 16, 1)
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == len(ALL) and asked == [16] * len(ALL)
    asked.clear()
    reader = tree.TreeReader(str(files), 16, 1)
    rest = list(reader.pushFilters([tree.D.GreaterThan(("length",), 1 << 20), tree.D.StringEndsWith(("path",), ".bin"),
                                    tree.D.IsNotNull(("length",)), tree.D.IsNull(("head",))]))
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["path"].rsplit("/", 1)[1] for r in rows] == ["huge.bin"] and asked == [16] and len(rest) == 1


def test_filters_reach_the_source(spark, files):
    big = readers.scan_tree(spark, str(files)).filter("length > 3 and path like '%.txt'")
    assert names(big) == [".b.txt", "_a.txt"]
    assert names(readers.scan_tree(spark, str(files)).filter("length in (2, 3) or path like '%z.txt'")) == [
        "one.txt", "spaced name é.bin", "z.txt"]
    plan = big._jdf.queryExecution().executedPlan().toString()
    assert "length" not in plan.split("BatchScan")[0].split("Filter")[-1] or "Filter" not in plan.split("BatchScan")[0]


def test_heads_and_kinds(spark, files):
    listed = readers.scan_tree(spark, str(files))
    assert listed.columns == ["path", "length", "modificationTime"]
    gone = spark.createDataFrame([("file:/no/such/file.srt", 1, None), (None, 0, None)], listed.schema)
    heads = {r.path: r.head for r in readers.read_heads(listed.unionByName(gone), 4).collect()}
    assert bytes(heads[f"file:{files}/_a.txt"]) == b"%PDF" and heads["file:/no/such/file.srt"] is None
    kinds = {r.path.rsplit("/", 1)[1]: r.kind for r in readers.sniff_kinds(
        listed.unionByName(gone).filter("path is not null")).collect()}
    assert kinds["_a.txt"] == "pdf" and kinds["huge.bin"] == "image" and kinds["file.srt"] == "subtitle"
    assert readers.scan_tree(spark, str(files / "_b" / "none")).count() == 0


@pytest.mark.parametrize("size", ["128m", "300b", "7b"])
def test_line_numbers_do_not_depend_on_splits(spark, tmp_path, size):
    r = random.Random(3)
    want = []
    for name, n in (("a.txt", 400), ("b.txt", 1), ("c.txt", 90)):
        lines = ["".join(r.choice("xyz # é") for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(n)]
        body = "".join(x + r.choice(["\n", "\r\n"]) for x in lines) + ("last" if name == "c.txt" else "")
        (tmp_path / name).write_bytes(body.encode())
        want += [(name, i, x) for i, x in enumerate(lines + (["last"] if name == "c.txt" else []), 1)]
    before = {k: spark.conf.get(k, None) for k in (
        "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")}
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.numbered_lines(spark, str(tmp_path))
        got = [(x.path.rsplit("/", 1)[1], x.line_no, x.value) for x in df.collect()]
        n_splits = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_block_start")).distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)
    assert sorted(got) == sorted(want)
    assert n_splits == 1 if size == "128m" else n_splits > 15
