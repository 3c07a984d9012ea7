"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sources, ordered by code point with null last, weigh ``weights`` in turn and share ``share`` times
   all tokens. A target stops at ``epochs`` times its source's size; the excess is reshared by weight
   until none is above (one level for all sources below their cap, found in closed form).
2. The budget is cut into blocks of ``block`` tokens. Highest quotients votes / (2 k + 1) hand the
   blocks to sources (votes: targets) and, within each source, to its shards (votes: their tokens).
3. A shard is the stream of its documents in seeded order, cut into equal blocks. Whole passes come
   first; of the last pass, the quota's rest is spread evenly over the blocks from a seeded phase.
   What a document gives follows from running sums, so blocks never become rows: ``passes`` whole copies
   of it and, of the last pass, the word ranges ``spans`` (start, end exclusive), whose lengths make
   ``taken``. ``mixed_text`` writes them out.

Documents are dealt to shards by id, so a source with any share of the rows is spread over shards of
bounded size. Quotas pass down a tree: source, groups of ``GROUP_SHARDS`` shards, shards; so no window
ranks all shards of a hot source. The only unpartitioned window runs over the table of sources.

Defined results: a null source is a source of its own (last); null or empty texts have size 0 and
give 0; a source without tokens has target 0; repeated rows count each time; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lingotally.functions.binding import let
from lingotally.llm import common
from lingotally.llm.common import word_count
from lingotally.operators.sizes import broadcast_if_small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
BLOCK = 16
SHARD_DOCS = 2_000
GROUP_SHARDS = 1_024
SEED = 17
MADE = ("size", "source_size", "target", "taken", "passes", "spans", "mixed_text")


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                source: str = "source") -> DataFrame:
    """doc_id, source, size in words."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       word_count(F.col(text)).alias("size"))


def mixed_text(text: Column, passes: Column, spans: Column) -> Column:
    """Text the mix takes of a document: whole copies as they are, then the words of each span, one per line.

    It has ``taken`` words; null where the mix takes none.
    """
    copies = F.array_repeat(common.whole(text), passes.cast("int"))

    def parts(own: Column) -> Column:  # the words are split once, however many spans there are
        cut = F.transform(spans, lambda s: F.array_join(F.slice(own, s["start"] + 1, s["end"] - s["start"]), " "))
        return F.concat(F.when(F.size(own) > 0, copies).otherwise(F.array().cast("array<string>")), cut)

    return let(let(common.words(text), parts), lambda x: F.when(F.size(x) > 0, F.array_join(x, "\n")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns of ``docs`` with size, source_size, target, taken, passes, spans and mixed_text
    (replacing such columns). Texts are read twice: to count words, and to be cut; in between only sizes are used."""
    rest = [c for c in docs.columns if c not in (*MADE, "doc_id", "source")]
    sizes = token_sizes(docs).checkpoint(eager=True)
    packed = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                         *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)])
    out = mix(sizes, rows=packed, carry=tuple(f"_c{i}" for i in range(len(rest))), **options)
    back = {c: F.col(f"_c{i}") for i, c in enumerate(rest)}
    return out.select(
        *[back[c].alias(c) if c in back else F.col(c) for c in docs.columns if c not in MADE],
        *MADE[:-1], mixed_text(back["text"], F.col("passes"), F.col("spans")).alias("mixed_text"))


def mixture(mixed: DataFrame) -> DataFrame:
    """The mix itself, from rows of ``mix_documents``: their own columns, texts as the mix takes them, rows
    that give nothing left out. A length column ``n_chars``, if any, is renewed."""
    new = {"text": F.col("mixed_text"), "n_chars": F.length("mixed_text").cast("bigint")}
    return mixed.filter("taken > 0").select(
        *[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in mixed.columns if c not in MADE])


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE,
                   epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, n_docs, target; one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                            (place % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(epochs))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * share
    s = s.withColumn("level", (total - before) / after)
    level = F.max("level").over(Window.partitionBy())
    target = F.greatest(F.lit(0.0), F.least("cap", level * F.col("weight")))
    return s.select("source", "source_size", "n_docs", target.alias("target"))


def sainte_lague(cells: DataFrame, group: list[str], votes: str, seats: str,
                 order: list[str], quota: str) -> DataFrame:
    """Add ``quota``: the seats of every group (column ``seats``, same within it) by highest quotients.

    Any divisor method with standard rounding gives a cell at most n / (2 seats) of its fair share
    (n cells) plus a half more or less. Seats below that range are certain; only quotients inside it
    are ranked, about six rows per cell.
    """
    w = Window.partitionBy(*group)
    n, total = F.count("*").over(w), F.sum(F.col(votes).cast("double")).over(w)
    fair = F.when((total > 0) & (F.col(seats) > 0), F.col(votes) * F.col(seats) / total).otherwise(0.0)
    slack = F.when(F.col(seats) > 0, F.col("_fair") * n / (2.0 * F.col(seats))).otherwise(0.0)
    c = cells.withColumn("_fair", fair).withColumn("_slack", slack)
    c = c.withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_fair") - F.col("_slack") - 2)).cast("bigint"))
    c = c.withColumn("_hi", F.when(F.col("_fair") > 0, F.ceil(F.col("_fair") + F.col("_slack") + 2))
                     .otherwise(F.lit(0)).cast("bigint"))
    c = c.withColumn("_left", F.col(seats) - F.sum("_lo").over(w))
    keys = [*group, *order]
    tries = c.select(*keys, votes, "_left", F.explode(F.sequence("_lo", "_hi")).alias("_k")).select(
        *keys, "_left", "_k", (F.col(votes) / (2 * F.col("_k") + 1)).alias("_q"))
    rank = F.row_number().over(
        w.orderBy(F.desc("_q"), *[F.col(k).asc_nulls_last() for k in order], "_k"))
    won = tries.withColumn("_r", rank).filter("_r <= _left").groupBy(
        *[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_won"))
    same = [c[k].eqNullSafe(won[f"_w{i}"]) for i, k in enumerate(keys)]
    out = c.join(won, same, "left")
    return out.select(*[c[x] for x in cells.columns],
                      (F.col("_lo") + F.coalesce("_won", F.lit(0))).alias(quota))


def mix(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
        block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: int = SEED,
        rows: DataFrame | None = None, carry: tuple[str, ...] = (), group_shards: int = GROUP_SHARDS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken (tokens the mix takes, repeats counted), passes, spans.

    ``sizes`` (doc_id, source, size) is read several times: pass a stored table. ``rows``: the same rows
    with further columns ``carry`` to keep; read once.
    """
    targets = source_targets(sizes, weights, share, epochs).withColumn(
        "_seats_all", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("bigint")
    ).withColumn("_all", F.lit(1)).checkpoint(eager=True)
    targets = sainte_lague(targets, ["_all"], "target", "_seats_all", ["source"], "_seats").withColumn(
        "_shards", F.ceil(F.col("n_docs") / shard_docs).cast("bigint"))
    targets = targets.select(
        F.col("source").alias("_source"), "source_size", "target", "_seats", "_shards").checkpoint(eager=True)
    small = broadcast_if_small(targets)
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("_shards"))

    def dealt(df: DataFrame) -> DataFrame:
        return df.join(small, F.col("source").eqNullSafe(F.col("_source")), "inner").withColumn("_shard", shard)

    cells = dealt(sizes).groupBy("_source", "_shard", "_seats").agg(F.sum("size").alias("_tokens"))
    cells = cells.withColumn("_group", F.floor(F.col("_shard") / group_shards)).checkpoint(eager=True)
    groups = cells.groupBy("_source", "_group", "_seats").agg(F.sum("_tokens").alias("_votes"))
    groups = sainte_lague(groups, ["_source"], "_votes", "_seats", ["_group"], "_own").select(
        F.col("_source").alias("_gs"), F.col("_group").alias("_gg"), "_own")
    cells = cells.join(groups, F.col("_source").eqNullSafe(F.col("_gs")) & (F.col("_group") == F.col("_gg")))
    cells = cells.select("_source", "_shard", "_group", "_tokens", "_own").checkpoint(eager=True)
    cells = sainte_lague(cells, ["_source", "_group"], "_tokens", "_own", ["_shard"], "_quota")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("_tokens") / block)).cast("bigint")
    cells = cells.select(F.col("_source").alias("_cs"), F.col("_shard").alias("_ch"), "_tokens", "_quota",
                         blocks.alias("_n")).withColumn(
        "_full", F.least(F.floor(F.col("_quota") / F.col("_n")), F.lit(epochs))).withColumn(
        "_rest", F.when(F.col("_full") < epochs, F.col("_quota") % F.col("_n")).otherwise(0)).withColumn(
        "_phase", F.pmod(F.xxhash64(F.lit(seed), "_cs", "_ch"), F.col("_n"))).checkpoint(eager=True)
    run = Window.partitionBy("_source", "_shard").orderBy(
        F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = dealt(sizes if rows is None else rows).withColumn("_end", F.sum("size").over(run))
    d = d.join(broadcast_if_small(cells),
               F.col("_source").eqNullSafe(F.col("_cs")) & (F.col("_shard") == F.col("_ch")), "left")

    def chosen(j: Column) -> Column:
        """Blocks chosen among the first ``j``."""
        return F.floor((j * F.col("_rest") + F.col("_phase")) / F.col("_n")).cast("bigint")

    # of the last pass: the part of each chosen block that lies in the document
    end, start = F.col("_end"), F.col("_end") - F.col("size")
    none = F.array().cast("array<struct<start:int,end:int>>")
    first, last = F.floor(start / block).cast("bigint"), F.floor((end - 1) / block).cast("bigint")
    picked = F.filter(F.sequence(first, last), lambda j: chosen(j + 1) > chosen(j))
    spans = F.transform(picked, lambda j: F.struct(
        (F.greatest(j * block, start) - start).cast("int").alias("start"),
        (F.least((j + 1) * block, end) - start).cast("int").alias("end")))
    d = d.withColumn("passes", F.col("_full").cast("bigint")).withColumn(
        "spans", F.when((F.col("size") > 0) & (F.col("_rest") > 0), spans).otherwise(none))
    taken = F.col("passes") * F.col("size") + F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return d.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "passes", "spans",
                    *[F.col(f"`{c}`") for c in carry])
