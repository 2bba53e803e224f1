"""Benchmark decontamination with a positional inverted index, in DataFrame operations alone.

The corpus is counted once for the terms that occur in the tests. Each test window (13 words, or
a shorter item as a whole) is looked up by its LISTS rarest terms: their postings (document,
position) make the stored index, each posting moves by the term's offset in the window to the
window's start, and starts that all lists share are candidates. The words at a candidate are then
compared with the window's. Common terms never leave their document.

Defined results: null and empty texts have no words and no hits; benchmark items without words
have no window; items that repeat, or share windows, each count; a null item_id counts its hits
but is not listed; rows that repeat a doc_id with another text are judged apart; an empty
benchmark hits nothing; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, keyed, same_row

LISTS = 3
#: Rows up to which the test side is broadcast; beyond, the join shuffles.
SMALL = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text") -> Column:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case."""
    parts = F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def test_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """item_id, window (its words), pid (a hash of them)."""
    w = benchmark.select("item_id", words().alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = w.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, size))).alias("window"))
    return each.withColumn("pid", F.xxhash64("window"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The positional index of ``terms`` (term): doc_id, th, pos, term."""
    every = docs.select("doc_id", "th", F.posexplode(words()).alias("pos", "term"))
    return every.join(small(terms), "term")


def rarest_lists(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """pid, n, needed, term, off: the rarest terms of each window that can occur at all."""
    terms = windows.select("pid", F.size("window").alias("n"), F.posexplode("window").alias("off", "term"))
    terms = terms.groupBy("pid", "n", "term").agg(F.min("off").alias("off"))
    vocabulary = small(terms.select("term").distinct())
    counts = docs.select(F.explode(words()).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    whole = Window.partitionBy("pid")
    known = terms.join(counts, "term", "left").withColumn("missing", F.max(F.col("df").isNull()).over(whole)).filter(~F.col("missing"))
    ranked = known.withColumn("rank", F.row_number().over(whole.orderBy("df", "term"))).filter(F.col("rank") <= LISTS)
    return ranked.withColumn("needed", F.count("*").over(whole)).select("pid", "n", "needed", "term", "off")


def phrase_matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Every occurrence of a window: doc_id, th, start, n, pid. docs: keyed; windows: window, pid, distinct."""
    windows = kept(windows, "test-windows")
    lists = kept(rarest_lists(docs, windows), "test-lists")
    index = kept(postings(docs, lists.select("term").distinct()), "index")
    at = index.join(small(lists), "term").select("doc_id", "th", "pid", "needed", (F.col("pos") - F.col("off")).alias("start"))
    shared = at.filter("start >= 0").groupBy("doc_id", "th", "pid", "needed", "start").agg(F.count("*").alias("lists")).filter("lists >= needed")  # rows that repeat a document add up; the words are compared below
    asked = shared.join(small(windows), "pid").groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "pid", "window")).alias("asked"))
    texts = docs.join(asked, same_row(docs, asked)).select(docs["doc_id"], docs["th"], "text", "asked").dropDuplicates(["doc_id", "th"])
    held = texts.select("doc_id", "th", "asked", words().alias("w"))
    true = F.filter("asked", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["window"])) == c["window"])
    return held.select("doc_id", "th", F.explode(true).alias("c")).select("doc_id", "th", "c.start", F.size("c.window").alias("n"), "c.pid")


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """Places where all words of a phrase lie within ``span`` words, in any order.

    phrases: phrase_id, text. Result: doc_id, th, phrase_id, start (the first word of the place).
    """
    docs = keyed(docs)
    terms = phrases.select("phrase_id", F.explode(F.array_distinct(words())).alias("term"))
    needed = terms.groupBy("phrase_id").agg(F.count("*").alias("needed"))
    found = postings(docs, terms.select("term").distinct()).join(small(terms), "term")
    near = Window.partitionBy("doc_id", "th", "phrase_id").orderBy("pos").rangeBetween(0, span - 1)  # within a document
    counted = found.withColumn("terms", F.size(F.collect_set("term").over(near)))
    return counted.join(small(needed), "phrase_id").filter("terms = needed").select("doc_id", "th", "phrase_id", F.col("pos").alias("start"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20) -> DataFrame:
    """Per row: doc_id, th, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words > 0)."""
    docs = keyed(docs)
    windows = test_windows(benchmark, size)
    found = kept(phrase_matches(docs, windows.select("window", "pid").distinct()), "matches")
    spans = found.groupBy("doc_id", "th", "start").agg((F.col("start") + F.max("n")).alias("end"))
    earlier = Window.partitionBy("doc_id", "th").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # within a document
    reach = F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0)))
    hits = spans.withColumn("new", F.greatest(F.col("end") - reach, F.lit(0))).groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit"))
    items = windows.select("pid", F.col("item_id").cast("string").alias("item_id")).distinct()
    listed = found.select("doc_id", "th", "pid").distinct().join(small(items), "pid").groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    both = hits.join(listed, same_row(hits, listed), "left").select(hits["doc_id"], hits["th"], "n_hit", "items")
    counted = docs.select("doc_id", "th", F.size(words()).cast("long").alias("n_words"))
    joined = counted.join(both, same_row(counted, both), "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        counted["doc_id"], counted["th"], "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))
