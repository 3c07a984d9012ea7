"""Words, splits and settings shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Documents of 3 to 120 kB go to Python in batches of a few MB.
ARROW_ROWS = "1000"


def whole(text: Column) -> Column:
    """Null texts are empty."""
    return F.coalesce(text, F.lit(""))


def runs(text: Column, gap: str) -> Column:
    """Non-empty stretches between matches of ``gap``; a split costs a fraction of extracting every match."""
    return F.array_remove(F.split(text, gap), "")


def words(text: Column) -> Column:
    """Array of words: maximal runs without space and \\t to \\r."""
    return runs(whole(text), r"[\x20\x09-\x0D]+")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def char_count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the faster function."""
    t = whole(text)
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus


def arrow(spark: SparkSession) -> SparkSession:
    """Batch size for operators that hand whole texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def input_bytes(df: DataFrame, text: str) -> int:
    """Bytes of all texts; decides how many blocks and buckets a job is cut into."""
    return df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
