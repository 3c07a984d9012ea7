"""Batch inference: pluggable models over Arrow batches, each distinct text once."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lingotally.functions.text import is_blank
from lingotally.session import stored

# Functions of this module travel to Python workers by value: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Model = Callable[[list[str]], list[str | None]]
Factory = Callable[[], Model]


def tagging_model(target: str) -> Factory:
    """Deterministic stand-in for a translation model: marks the text with the target code."""
    return lambda: lambda texts: [f"[{target}] {t}" for t in texts]


def with_fallback(primary: Factory, secondary: Factory) -> Factory:
    """Use the second backend only for texts the first one fails on, inside the same worker."""
    def build() -> Model:
        first, second = primary(), secondary()

        def run(texts: list[str]) -> list[str | None]:
            out, errors = _guarded(first, texts)
            failed = [i for i, e in enumerate(errors) if e is not None]
            if failed:
                again = second([texts[i] for i in failed])
                for i, value in zip(failed, again):
                    out[i] = value
            return out

        return run

    return build


def _guarded(model: Model, texts: list[str]) -> tuple[list, list]:
    """Outputs and errors per text; a failing batch is halved until the bad texts stand alone."""
    try:
        out = list(model(texts))
        return out, [None if o is not None else "no output" for o in out]
    except Exception as batch_error:
        if len(texts) == 1:
            return [None], [f"{type(batch_error).__name__}: {batch_error}"]
    half = len(texts) // 2
    (a, bad_a), (b, bad_b) = _guarded(model, texts[:half]), _guarded(model, texts[half:])
    return [*a, *b], [*bad_a, *bad_b]


def map_model(df: DataFrame, factory: Factory, text: str = "text", output: str = "output",
              keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``output`` and ``error``; the model is built once per Python worker.

    A failing text becomes a row with ``error``; the job goes on.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    slim = df.select(*keep, text)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.select(*keep).schema)
    schema = ", ".join(x for x in (fields, f"`{output}` string, error string") if x)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            if len(batch) == 0:
                continue
            out, errors = _guarded(model, batch[text].tolist())
            yield batch[keep].assign(**{output: out, "error": errors})

    return slim.mapInPandas(run, schema)


def infer_distinct(df: DataFrame, factory: Factory, key: Column, text: str = "text",
                   output: str = "output", partitions: int | None = None, store: bool = False) -> DataFrame:
    """Model output for every row, computed once per distinct text and joined back on its digest.

    Two branches read the rows; ``store`` writes them to the shared folder first, for rows that
    are dear to compute (a detector has judged them).

    Copies collapse before the first shuffle. Blank texts are not inferred; they get join keys
    spread by the row key, so that they do not pile up in one partition. The digest side is unique,
    hence a text with very many copies is a one-sided skew, which AQE splits in the left join.
    """
    blank = is_blank(F.col(text))
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).cast("string"))
    keyed = df.withColumn("_k", F.when(blank, spread).otherwise(F.sha2(F.col(text), 256)))
    if store:
        keyed = stored(keyed, "infer")
    # The digest determines the text; grouping by both hashes instead of sorting whole texts.
    texts = keyed.filter(~blank).select("_k", text).distinct()
    if partitions:
        texts = texts.repartition(partitions, "_k")
    inferred = map_model(texts, factory, text, output, ["_k"])
    return keyed.join(inferred, "_k", "left").drop("_k")
