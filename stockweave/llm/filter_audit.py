"""What each of five quality filters removes, in every order in which they could be applied.

Every text gets a mask of the filters that it fails. Copies are found by the text's digest: the
least doc_id per digest combines before the shuffle and is joined back on digest and doc_id, so a
text that a third of all rows share is no hot key. Rows are then counted per part
and mask, 32 cells a part at most. A cell is folded over the orders, a constant array of permutations:
each step of each order gives one struct of the cell's counts, weighted by what the step does to the
mask, and the arrays of a part's cells are summed element by element.

Defined results: a null text is empty, a null source is the part ''. Rows that repeat a doc_id are
counted one by one. A null doc_id has no smaller one and is none, and has no label; a doc_id with several labels is
good or toxic if one of them says so. An empty table gives no row.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that see one text alone."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def mask_of(failures: dict[str, Column]) -> Column:
    out = F.lit(0)
    for name, fails in failures.items():
        out = out + F.when(fails, F.lit(bit(name))).otherwise(F.lit(0))
    return out


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (a bit per failed filter) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = kept(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"),
        mask_of(text_failures(text)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")), "masks")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["digest", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(later, bit("E")).otherwise(0)).select(
        "doc_id", "part", "mask")


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many rows fail which filters."""
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masked(docs).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("rows"))  # so that no doc_id is a hot key
    return rows.join(said, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("rows").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("rows")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, F.col("rows")).otherwise(0)).alias("toxic"))


def orders() -> Column:
    """All orders of the filters as a constant array: the order's name and its filters' bits."""
    names = ["".join(p) for p in permutations(FILTERS)]
    return F.array(*[F.struct(F.lit(o).alias("filter_order"), F.array(*[F.lit(bit(c)) for c in o]).alias("bits")) for o in names])


def cell_steps(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """One struct for every step of every order: what the step does to the cell's rows."""

    def weight(test: Column, count: Column) -> Column:
        return F.when(test, count).otherwise(F.lit(0)).cast("long")

    def step(order: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(order["bits"], F.lit(1), i), F.lit(0), lambda seen, b: seen.bitwiseOR(b))
        own = F.element_at(order["bits"], i + 1)
        alive, fails = before.bitwiseAND(mask) == 0, own.bitwiseAND(mask) != 0
        return F.struct(
            order["filter_order"].alias("filter_order"), (i + 1).alias("step"), own.alias("own"),
            weight(alive & ~fails, n).alias("kept"), weight(alive & fails, n).alias("removed"), weight(~alive & fails, n).alias("redundant"),
            weight(mask == own, n).alias("unique_fails"), weight(alive & fails, good).alias("good_lost"), weight(alive & fails, toxic).alias("toxic_lost"))

    places = F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))
    return F.flatten(F.transform(orders(), lambda order: F.transform(places, lambda i: step(order, i))))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        x["filter_order"].alias("filter_order"), x["step"].alias("step"), x["own"].alias("own"), *[(x[c] + y[c]).alias(c) for c in COUNTS]))


def audited(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, the counts and shapley from cells of ``mask_cells``."""
    zero = F.lit(0).cast("long")
    per_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = F.aggregate("cells", cell_steps(F.lit(0), zero, zero, zero), lambda total, c: added(total, cell_steps(c["mask"], c["n"], c["good"], c["toxic"])))
    rows = per_part.select("part", F.inline(steps))
    same = Window.partitionBy("part", "own")  # 120 rows: each order applies a filter once
    return rows.withColumn("shapley", F.sum("removed").over(same)).select("part", "filter_order", "step", *COUNTS, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audited(mask_cells(docs, labels))
