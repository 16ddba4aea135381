"""How filters of a corpus interact: what each removes, in every order.

Each document is reduced to the bits of the filters it fails. Documents of one
part and one set of bits are one weighted cell, so that all further work is
with at most 32 cells a part, whatever the corpus holds. The cells are unpivoted
against the steps of all 120 orders; a running bit-or over the earlier steps of
an order tells whether a cell was gone before; conditional sums give what a step
keeps and removes, and a total over all steps of a filter its Shapley sum.

The filters (words: maximal runs of no white space, case-sensitive):

* A: under 200 words;
* B: under half of the words distinct;
* C: over 2 % of the code points in A-Z;
* D: any of ``# $ % & * |``;
* E: the text of a row with a smaller id, removed or not.

For E, rows meet their text's smallest id by that id and the text's digest, so
a text that a third of all rows share is spread over the tasks.

Edge cases: null text counts as empty (it fails A only, or E: 0 of 0 words are
not under half); a null part is the empty string; a null id is neither smaller
nor larger than any and has no label, so its row never fails E; rows of one id and one text do
not fail E for each other; an id that is labelled twice counts as good or toxic
if any of its labels is 1; rows without a label are neither; empty documents
give no rows; other columns are ignored. A text is held as an array of its
words while its bits are taken.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limber.llm.common import SPACE, text_of, written

FILTERS = "ABCDE"
BIT = {f: 1 << i for i, f in enumerate(FILTERS)}
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 2
#: What D looks for and C counts, as regular expressions.
SYMBOLS, UPPER = "[#$%&*|]", "[A-Z]"


def _bit(name: str, fails: Column) -> Column:
    return F.when(fails, F.lit(BIT[name])).otherwise(F.lit(0))


def text_mask(text: str, w: str) -> Column:
    """The bits A to D of a text that is not null and its words."""
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return (
        _bit("A", F.size(w) < MIN_WORDS)
        + _bit("B", 100 * F.size(F.array_distinct(w)) < MIN_DISTINCT_PERCENT * F.size(w))
        + _bit("C", 100 * upper.cast("long") > MAX_UPPER_PERCENT * F.length(text).cast("long"))
        + _bit("D", F.col(text).rlike(SYMBOLS))
    )


def failure_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: the documents of each part that fail just the filters in mask."""
    text = docs.select(F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    split = text.withColumn("w", F.array_remove(F.split("text", SPACE + "+"), ""))
    thin = written(split.select("part", "id", F.sha2("text", 256).alias("digest"), text_mask("text", "w").alias("mask")), "masks")
    first = thin.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    ones = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.select(F.col(id_col).alias("id"), "quality", "toxic").groupBy("id").agg(ones("quality"), ones("toxic"))
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    mask = (F.col("mask") + _bit("E", repeated)).cast("int")
    rows = thin.join(first, ["id", "digest"], "left").join(known, "id", "left").select("part", mask.alias("mask"), "quality", "toxic")
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long"))
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def _steps() -> Column:
    """All orders and steps as an array of structs."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    return F.flatten(F.transform(orders, lambda o: F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda s: F.struct(o.alias("filter_order"), s.alias("step")))))


def audit_cells(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step does, of cells (part, mask, n, good, toxic)."""
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    bit = F.element_at(F.create_map(*[F.lit(x) for item in BIT.items() for x in item]), letter)
    long = cells.select("*", F.explode(_steps()).alias("at")).select("part", "mask", "n", "good", "toxic", "at.filter_order", "at.step").withColumn("bit", bit)
    earlier = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(earlier), F.lit(0))
    seen = long.withColumn("gone", before != 0).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")) != 0)
    fails, gone = F.col("fails"), F.col("gone")
    total = lambda of, when, name: F.sum(F.when(when, F.col(of)).otherwise(F.lit(0).cast("long"))).alias(name)
    steps = seen.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~gone, "kept"),
        total("n", fails & ~gone, "removed"),
        total("n", fails & gone, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", fails & ~gone, "good_lost"),
        total("toxic", fails & ~gone, "toxic_lost"),
    )
    return steps.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows a part."""
    return audit_cells(failure_cells(docs, labels, part_col, id_col, text_col))
