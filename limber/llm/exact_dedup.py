"""Exact de-duplication with a heavy-hitter split.

Two texts are equal when they are identical after their white space
(``[\\x20\\x09-\\x0D]``) is deleted. A Misra-Gries pass over the digests finds
every digest that may hold more than ``support`` of the rows. Those candidates,
at most ``1/support`` of them, are counted exactly; the ones that really are
that frequent get their winner broadcast, so that the copies of a hot text are
settled map-side and never meet in one task. All other digests, none of which
holds more than ``support`` of the rows, go through an ordinary shuffle.

Everything is DataFrame code; there is no Python on the executors.

Edge cases, the same for both functions:

* null text counts as empty; all empty texts are one group;
* of equal texts the one with most code points in the original stays, then the
  one with the smallest id; a null id comes after all others;
* rows that tie in both (repeated rows) still leave exactly one row;
* an empty table gives an empty result;
* other columns are ignored by :func:`exact_duplicates` and kept as they are by
  :func:`drop_exact_duplicates`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.llm.common import SPACE, text_of, written

#: Share of rows above which a digest is settled map-side. It bounds the broadcast to 1/SUPPORT rows.
SUPPORT = 0.001


def text_digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text without white space, in UTF-8."""
    return F.sha2(F.encode(F.regexp_replace(text, SPACE + "+", ""), "UTF-8"), 256)


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A thin table: id, row (unique), chars, digest; written, so that row is stable."""
    thin = df.select(
        F.col(id_col).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.length(text_of(text_col)).cast("long").alias("chars"),
        text_digest(text_of(text_col)).alias("digest"),
    )
    return written(thin, "digests")


def _rank() -> Column:
    """Smallest first: most code points, then smallest id, nulls last, then the row."""
    return F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))


def _winners(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))


def heavy_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Digests of more than ``support`` of the rows with their exact count and winner; fewer than ``1/support`` rows."""
    total = digests.agg(F.count(F.lit(1)).alias("total"))
    candidates = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    counted = _winners(digests.join(F.broadcast(candidates), "digest", "left_semi"))
    return counted.join(F.broadcast(total), F.col("group_size") > F.lit(support) * F.col("total")).drop("total")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256."""
    digests = _digests(df, id_col, text_col)
    heavy = written(heavy_winners(digests, support), "heavy")
    hot = digests.join(F.broadcast(heavy), "digest")
    rest = digests.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    winners = written(_winners(rest), "winners")  # written, so that a join of its own can split a digest just below the support
    settled = hot.unionByName(rest.join(winners, "digest"))
    return settled.select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Copies of a hot text are dropped where they are read unless they tie with
    the winner; what is left is reduced with a map-side combine, so no group
    is ever gathered.
    """
    heavy = written(heavy_winners(_digests(df, id_col, text_col), support), "heavy")
    keyed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"),
        F.col(id_col).alias("id"),
        F.length(text_of(text_col)).cast("long").alias("chars"),
        text_digest(text_of(text_col)).alias("digest"),
        F.lit(0).cast("long").alias("row"),
    )
    best = heavy.select("digest", F.col("best.chars").alias("best_chars"), F.col("best.id").alias("best_id"))
    left = keyed.join(F.broadcast(best), "digest", "left").where(
        F.col("best_chars").isNull() | ((-F.col("chars") == F.col("best_chars")) & F.col("id").eqNullSafe(F.col("best_id")))
    )
    return left.groupBy("digest").agg(F.min_by("doc", _rank()).alias("doc")).select("doc.*")
