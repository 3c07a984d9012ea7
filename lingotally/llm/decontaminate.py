"""Benchmark decontamination with a distributed positional inverted index.

``windows`` cuts benchmark items to windows of ``n`` words (a shorter item is one window).
``term_counts`` counts the benchmark's terms in the training texts, ``probes`` picks the ``rarest``
terms of every window by those counts, and ``postings`` stores (term, document, place) of the picked
terms only. ``intersect`` shifts the postings of a window's rarest term to the window's start and
keeps the starts that the shifted lists of its other picked terms confirm. ``exact`` compares what
is left with the text; ``hits`` reports the phrase spans. ``proximity`` shifts the lists alike, but keeps starts
whose other picked terms, all but ``missing``, stand within ``slop`` places of where they belong; ``near_hits`` then counts all words of
the window in the text and keeps what has ``share`` of them near their places. Its probes pick among the terms
that occur, so that a window with a word found nowhere in the training texts is still looked for.

Sides that come from the benchmark are broadcast only below a measured bound; above it the same joins
shuffle. Counting combines before its shuffle, postings are keyed by document and start, and a term
in every document is only ever picked for windows that consist of such terms.

Defined results: null and empty texts have no words, are never hit and hit nothing; a null id is a
document of its own value (null); repeated rows are reported each; repeated items each count; empty
tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lingotally.functions.binding import free_prefix, let
from lingotally.llm.common import lower_ascii, runs
from lingotally.operators.sizes import broadcast_if_small

N = 10
RAREST = 3
SLOP = 5
SHARE = 0.8
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, in lower-cased text


def terms(text: Column) -> Column:
    return runs(lower_ascii(text), GAP)


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """window (id), terms, size, items: distinct windows with the items that hold them."""
    w = F.col("_t")
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0)))
    cut = items.select(F.col(item_id).cast("string").alias("_item"), terms(F.col(text)).alias("_t"))
    cut = cut.filter(F.size("_t") > 0).select(
        "_item", F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, n))).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("_item").alias("items")).select(
        F.sha2(F.concat_ws(" ", "terms"), 256).alias("window"), "terms",
        F.size("terms").alias("size"), "items")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, place, term of every training token."""
    return docs.select(F.col(key).alias("doc"), F.posexplode(terms(F.col(text))).alias("place", "term"))


def term_counts(docs: DataFrame, wins: DataFrame, text: str = "text") -> DataFrame:
    """How often each benchmark term occurs in all training texts (0 where it never does)."""
    vocabulary = wins.select(F.explode("terms").alias("term")).distinct()
    seen = docs.select(F.explode(terms(F.col(text))).alias("term")).join(
        broadcast_if_small(vocabulary), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    return vocabulary.join(seen, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def probes(wins: DataFrame, counts: DataFrame, rarest: int = RAREST, share: float = 1.0) -> DataFrame:
    """window, rank (0: rarest), term, offset: the picked terms of windows of whose words ``share`` occur.

    Only terms that occur are picked; exact phrases need all of a window's terms to occur.
    """
    t = wins.select("window", "size", F.posexplode("terms").alias("offset", "term")).join(counts, "term")
    by = Window.partitionBy("window")
    t = t.filter("n > 0").withColumn("_occur", F.count("*").over(by)).filter(F.col("_occur") >= share * F.col("size"))
    # one place per term first, so that the lists differ
    t = t.withColumn("_copy", F.row_number().over(Window.partitionBy("window", "term").orderBy("offset")))
    t = t.withColumn("rank", F.row_number().over(by.orderBy("_copy", "n", "term", "offset")) - 1)
    return t.filter(F.col("rank") < rarest).select("window", "rank", "term", "offset")


def postings(docs: DataFrame, picked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: doc, place, term of every occurrence of a picked term."""
    return tokens(docs, key, text).join(
        broadcast_if_small(picked.select("term").distinct()), "term", "left_semi")


def intersect(index: DataFrame, picked: DataFrame, rarest: int = RAREST) -> DataFrame:
    """doc, start, window: starts that the shifted lists of all picked terms of the window share.

    The rarest list of a window proposes starts; each further list keeps the starts whose place it
    holds. Only the proposing list is expanded by windows, the others are looked up.
    """
    first = picked.filter("rank = 0").select("term", "window", "offset")
    left = index.join(broadcast_if_small(first), "term").select(
        "doc", (F.col("place") - F.col("offset")).alias("start"), "window").filter("start >= 0").distinct()
    held = index.select(F.col("doc").alias("_d"), F.col("place").alias("_p"), F.col("term").alias("_t"))
    for r in range(1, rarest):
        side = picked.filter(F.col("rank") == r).select("window", F.col("term").alias("_term"), "offset")
        left = left.join(broadcast_if_small(side), "window", "left")
        found = left.filter("_term is not null").join(
            held, F.col("doc").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_term"))
            & (F.col("_p") == F.col("start") + F.col("offset")), "left_semi")
        left = found.unionByName(left.filter("_term is null")).select("doc", "start", "window")
    return left


def proximity(index: DataFrame, picked: DataFrame, slop: int = SLOP, bin_width: int = 64, missing: int = 0) -> DataFrame:
    """doc, window, start: picked terms of a window, all but ``missing``, within ``slop`` places of where they belong.

    Starts are proposed by the ``missing`` + 1 rarest terms, one of which is there. Shifted starts are binned; a start
    also joins the next bin if it lies within reach, so that nothing is lost at a border and no list is paired with itself.
    """
    side = picked.select("term", "window", "offset", "rank")
    s = index.join(broadcast_if_small(side), "term").select(
        F.struct("doc").alias("doc"), "window", "rank", (F.col("place") - F.col("offset")).alias("start"))  # null ids meet
    anchor = s.filter(F.col("rank") <= missing).select("doc", "window", F.col("start").alias("at")).distinct()
    reach = F.sequence(F.floor((F.col("start") - slop) / bin_width), F.floor((F.col("start") + slop) / bin_width))
    near = s.withColumn("_bin", F.explode(reach)).join(
        anchor.withColumn("_bin", F.floor(F.col("at") / bin_width)), ["doc", "window", "_bin"])
    near = near.filter(F.abs(F.col("start") - F.col("at")) <= slop).groupBy("doc", "window", "at").agg(
        F.countDistinct("rank").alias("_met"))
    need = picked.groupBy("window").agg(F.greatest(F.count("*") - missing, F.lit(1)).alias("_need"))
    return near.join(broadcast_if_small(need), "window").filter(F.col("_met") >= F.col("_need")).select(
        F.col("doc.doc").alias("doc"), "window", F.col("at").alias("start"))


def listed(found: DataFrame, wins: DataFrame) -> DataFrame:
    """doc, hits: starts, terms and items of what was ``found`` (doc, start, window), per document."""
    side = wins.select("window", F.col("terms").alias("_terms"), F.col("items").alias("_items"))
    return found.join(broadcast_if_small(side), "window").groupBy("doc").agg(
        F.collect_list(F.struct("start", F.col("_terms").alias("terms"), F.col("_items").alias("items"))).alias("hits"))


def candidates(docs: DataFrame, wins: DataFrame, key: str = "doc_id", text: str = "text",
               rarest: int = RAREST) -> DataFrame:
    """doc, hits: starts and windows that the index cannot rule out, per document."""
    picked = probes(wins, term_counts(docs, wins, text), rarest).checkpoint(eager=True)
    index = postings(docs, picked, key, text).checkpoint(eager=True)
    return listed(intersect(index, picked, rarest), wins)


def exact(words: Column, hits: Column) -> Column:
    """Hits whose window stands in the text at its start, in order."""
    ok = F.filter(hits, lambda h: F.slice(words, h["start"] + 1, F.size(h["terms"])) == h["terms"])
    return F.array_sort(F.transform(ok, lambda h: F.struct(
        h["start"].alias("start"), (h["start"] + F.size(h["terms"])).alias("end"), h["items"].alias("items"))))


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["to"]))).alias("n"),
        F.greatest(s["end"], a["to"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
         item_id: str = "item_id", item_text: str = "text", n: int = N,
         rarest: int = RAREST) -> DataFrame:
    """Key, n_words, n_hit, hit_items (sorted), spans (start, end, items of every phrase found) of every row of ``docs``."""
    wins = windows(items, item_id, item_text, n).checkpoint(eager=True)
    found = candidates(docs, wins, key, text, rarest)
    d = docs.select(F.col(key).alias("doc"), F.col(text).alias("_text"))
    j = d.join(found.withColumnRenamed("doc", "_doc"), F.col("doc").eqNullSafe(F.col("_doc")), "left")
    judged = let(terms(F.col("_text")), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n"), F.when(F.col("hits").isNotNull(), exact(w, F.col("hits"))).alias("s")))
    j = j.select("doc", judged.alias("_j")).select("doc", F.col("_j.n").alias("n_words"), F.col("_j.s").alias("_s"))
    return j.select(
        F.col("doc").alias(key), "n_words",
        F.coalesce(covered(F.col("_s")), F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct(F.flatten(F.transform("_s", lambda s: s["items"])))),
                   F.array().cast("array<string>")).alias("hit_items"),
        F.coalesce(F.col("_s"), F.filter(F.array(F.struct(
            F.lit(0).alias("start"), F.lit(0).alias("end"), F.array().cast("array<string>").alias("items"))),
            lambda s: F.lit(False))).alias("spans"))


def met(words: Column, hit: Column, slop: int) -> Column:
    """How many words of the window stand in the text within ``slop`` places of where they belong."""
    def near(term: Column, j: Column) -> Column:
        place = hit["start"] + j
        first = F.greatest(place - slop, F.lit(0))
        return F.array_contains(F.slice(words, first + 1, F.greatest(place + slop + 1 - first, F.lit(0))), term)

    return F.size(F.filter(hit["terms"], near))


def near_hits(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
              item_text: str = "text", n: int = N, rarest: int = RAREST, slop: int = SLOP,
              share: float = SHARE, missing: int = 1) -> DataFrame:
    """Key, start, end, n_near, items: one row per proximity match, phrases included (n_near is the window's size there).

    Windows of ``n`` words only. A match is a start that an occurrence of one of the window's ``missing`` + 1 rarest
    occurring terms proposes, where all picked terms but ``missing`` stand within ``slop`` places of theirs, as do
    ``share`` of all the window's words. So a passage with any one word replaced is found.
    """
    wins = windows(items, item_id, item_text, n).filter(F.col("size") == n).checkpoint(eager=True)
    picked = probes(wins, term_counts(docs, wins, text), rarest, share).checkpoint(eager=True)
    index = postings(docs, picked, key, text).checkpoint(eager=True)
    found = listed(proximity(index, picked, slop, missing=missing), wins)
    d = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text"))
    j = found.join(d, F.col("doc").eqNullSafe(F.col("_doc")))
    counted = let(terms(F.col("_text")), lambda w: F.transform(F.col("hits"), lambda h: F.struct(
        h["start"].alias("start"), met(w, h, slop).cast("bigint").alias("n_near"), h["items"].alias("items"))))
    return j.select("doc", F.explode(counted).alias("h")).filter(F.col("h.n_near") >= share * n).select(
        F.col("doc").alias(key), "h.start", (F.col("h.start") + n).alias("end"), "h.n_near",
        F.array_sort("h.items").alias("items"))


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", n: int = N, rarest: int = RAREST) -> DataFrame:
    """Rows of ``docs`` without a hit, with all their columns."""
    wins = windows(items, item_id, item_text, n).checkpoint(eager=True)
    p = free_prefix(docs.columns)
    found = candidates(docs, wins, key, text, rarest).select(F.col("doc").alias(f"{p}doc"), F.col("hits").alias(f"{p}hits"))
    j = docs.join(found, F.col(f"`{key}`").eqNullSafe(F.col(f"{p}doc")), "left")
    hit = let(terms(F.col(f"`{text}`")), lambda w: F.size(exact(w, F.col(f"{p}hits"))) > 0)
    return j.filter(F.col(f"{p}hits").isNull() | ~hit).select(*[F.col(f"`{c}`") for c in docs.columns])
