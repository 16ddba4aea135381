"""Mixing to target weights by iterative proportional fitting.

The token weights of the cells source x language x topic are raked until their
margins meet the targets. A cell's factor is its fitted over its actual weight.
With a ``budget`` (a share of all tokens) the sample is to hold so many tokens:
no cell can give more than it has, so the cells are raked once more under that
cap, where a cell that is sampled whole leaves the rest to the others of its
slices. Without one, probabilities are proportional to the factors and the cell
of the largest is sampled whole: the expected shares are the targets to the
last, but one rare cell decides how little is kept. The draw is a hash of the
document's id and a seed: it needs no state, and a lost task repeats it exactly.

The table is only aggregated (map-side combine) and joined with the cells, of
which there are as many as source, lang and topic combinations occur. Up to
``BROADCAST`` cells are raked on the driver, as a sparse table, and no text is
shuffled; more of them stay a table of Spark's, which is raked by sums over each
dimension that are joined back, a written table a round. Both come to the same
weights, the second to ``NEAR``. Tempered targets list every value that
has tokens; values that no target lists are one further value, whose target is
its actual share. Tokens are what the caller counts (``tokens``), and otherwise
words between white space: the columns named for tokens hold these then.

Edge cases: null values of a dimension are unlisted values; documents without
tokens count for nothing and get their cell's probability (1 when the cell has
no tokens at all); targets that the cells that occur cannot meet are met as
nearly as raking comes, with a warning; a null id draws like any other value, repeated rows draw
alike; target values that do not occur are left out; an empty table gives an
empty result; other columns are ignored by :func:`mixing_weights` and kept by
:func:`sample_mixture`.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.llm.common import text_of, words, written

OTHER = "\u0000other"
#: Up to so many cells are raked on the driver, and the documents joined with a broadcast of them.
BROADCAST = 200_000
#: Distance of a margin from its target at which raking in Spark ends, and rounds at most, a look at the distance every few.
NEAR, SPARK_ROUNDS, LOOK = 1e-5, 40, 4
TEMPERATURE = 0.7
#: Share of all tokens that the production mixture is to hold.
BUDGET = 0.6
#: Distance of a margin from its target above which a warning is given.
REPORTED = 1e-3
SEED = 17
TOPICS = ("licence", "contact", "list", "prose")


def topic_of(text: Column) -> Column:
    """A rule for tables without a topic column: licence, contact, list or prose."""
    return (
        F.when(text.rlike("(?i)licen[sc]e"), "licence")
        .when(text.rlike(r"[\w.]@[\w-]+\.\w|\+\d[\d ()-]{7,}"), "contact")
        .when(text.rlike(r" [|•] "), "list")
        .otherwise("prose")
    )


def tempered_targets(cells: DataFrame, dims: dict[str, float]) -> dict[str, dict[str, float]]:
    """For each dimension the shares of its values with tokens, raised to the power given and normalised."""
    found = {}
    for dim, power in dims.items():
        heaviest = cells.where(F.col(dim).isNotNull()).groupBy(dim).agg(F.sum("tokens").alias("tokens")).where("tokens > 0").orderBy(F.desc("tokens"), dim).collect()
        scaled = {r[dim]: float(r["tokens"]) ** power for r in heaviest}
        total = sum(scaled.values())
        found[dim] = {k: v / total for k, v in scaled.items()}
    return found


def rake(actual: np.ndarray, targets: list[np.ndarray], tolerance: float = 1e-10, max_rounds: int = 1000) -> np.ndarray:
    """The weights nearest ``actual`` (n-way array) with the target shares as margins; targets of empty slices are left out."""
    codes = [c.ravel() for c in np.indices(actual.shape)]
    return rake_cells(actual.ravel(), codes, targets, None, tolerance, max_rounds)[0].reshape(actual.shape)


def _scales(weight: np.ndarray, cap: np.ndarray, code: np.ndarray, want: np.ndarray) -> np.ndarray:
    """For each slice the factor by which its weights, none beyond its cap, sum to what is wanted; the least that caps them all if they cannot."""
    use = np.flatnonzero(weight > 0)
    at = np.divide(cap[use], weight[use])  # the factor at which a cell meets its cap
    order = use[np.lexsort((at, code[use]))]
    at = cap[order] / weight[order]
    c, u, w = code[order], np.where(np.isinf(cap[order]), 0.0, cap[order]), weight[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, dtype=np.int64)
    size = np.diff(np.r_[first, len(c)])
    capped = np.cumsum(u) - u  # what the cells before this one have at their caps
    capped -= np.repeat(capped[first], size)
    before = np.cumsum(w) - w
    left = np.repeat(np.add.reduceat(w, first), size) - (before - np.repeat(before[first], size)) if len(c) else w
    scale = np.maximum(want[c] - capped, 0) / np.maximum(left, w)
    fits = np.where(scale <= at, np.arange(len(c)), len(c))
    out = np.ones(len(want))
    if len(c):
        best = np.minimum.reduceat(fits, first)
        last = first + size - 1
        out[c[first]] = np.where(best <= last, scale[np.minimum(best, last)], at[last])
    return out


def rake_cells(
    actual: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], caps: np.ndarray | None = None, tolerance: float = 1e-10, max_rounds: int = 1000
) -> tuple[np.ndarray, float]:
    """:func:`rake` of the cells that occur, each with its place along every axis; also the largest distance of a margin from its target.

    With ``caps`` no fitted share is beyond its cap; what a capped cell cannot
    give the other cells of its slice do. A margin that all caps of its slice
    together do not reach stays below its target.
    """
    weight = actual / actual.sum()
    cap = np.full(len(actual), np.inf) if caps is None else caps
    wants = []
    for code, share in zip(codes, targets, strict=True):
        want = np.where(np.bincount(code, weights=weight, minlength=len(share)) > 0, share, 0)
        wants.append(want / want.sum() if want.sum() else None)
    residual = 0.0
    for _ in range(max_rounds):
        fitted = np.minimum(weight, cap)
        residual = max([0.0, *(float(np.abs(np.bincount(c, weights=fitted, minlength=len(w)) - w).max()) for c, w in zip(codes, wants, strict=True) if w is not None)])
        if residual < tolerance:
            break
        old = fitted
        for code, want in zip(codes, wants, strict=True):
            if want is not None:
                weight = weight * _scales(weight, cap, code, want)[code]
        if float(np.abs(np.minimum(weight, cap) - old).max()) < tolerance / 100:
            break  # nothing moves: some margin cannot be met
    return np.minimum(weight, cap), residual


def _thin(df: DataFrame, dims: dict[str, Column], tokens: Column, id_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), *[c.cast("string").alias(d) for d, c in dims.items()], tokens.cast("long").alias("tokens"))


def cell_factors(cells: DataFrame, targets: dict[str, dict[str, float]], budget: float | None = None) -> tuple[DataFrame, int]:
    """The cells with columns factor and probability, and how many there are; a warning tells how far margins stay from their targets."""
    dims = list(targets)
    rows = cells.select(*dims, F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens")).toPandas()
    values = {d: [*targets[d], OTHER] for d in dims}
    codes = np.empty((len(rows), len(dims)), dtype=np.int64)
    for i, d in enumerate(dims):
        at = {v: j for j, v in enumerate(targets[d])}
        codes[:, i] = [at.get(v, len(at)) for v in rows[d]]
    merged, cell = np.unique(codes, axis=0, return_inverse=True)
    cell = cell.ravel()
    actual = np.bincount(cell, weights=rows["tokens"], minlength=len(merged)) if len(rows) else np.zeros(0)
    total = actual.sum()
    factor = probability = np.ones(len(merged))
    if total > 0:
        places, shares = list(merged.T), []
        for code, d in zip(places, dims, strict=True):
            margin = np.bincount(code, weights=actual, minlength=len(values[d])) / total
            share = np.where(margin > 0, [*targets[d].values(), 0.0], 0.0)
            share = share / (share.sum() or 1) * (1 - margin[-1])
            share[-1] = margin[-1]
            shares.append(share)
        has = actual > 0
        fitted, residual = rake_cells(actual, places, shares)
        factor = np.divide(fitted * total, actual, out=np.ones_like(actual), where=has)
        if budget is None:
            probability = np.where(has, factor / factor[has].max(), 1.0)
        else:
            fitted, residual = rake_cells(actual, places, shares, actual / (total * budget))
            probability = np.divide(fitted * total * budget, actual, out=np.ones_like(actual), where=has).clip(0, 1)
        if residual > REPORTED:
            warnings.warn(f"the targets cannot be met: a share of tokens is off by {residual:.2g}", stacklevel=2)
    made = pd.DataFrame({d: rows[d].astype(object) for d in dims} | {"factor": factor[cell], "probability": probability[cell]})
    made = made.where(made.notna(), None)
    return cells.sparkSession.createDataFrame(made, ", ".join(f"{d} string" for d in dims) + ", factor double, probability double"), len(rows)


def _wanted(coded: DataFrame, dims: list[str], shares: dict[str, DataFrame], total: float) -> list[DataFrame]:
    """For each dimension its values that occur and the share of all tokens that each is to have."""
    found = []
    for d in dims:
        margin = coded.groupBy(d).agg((F.sum("tokens") / F.lit(total)).alias("margin")).where("margin > 0")
        listed = margin.where(F.col(d) != OTHER).join(shares[d].select(F.col("value").alias(d), "share"), d)
        other = margin.where(F.col(d) == OTHER).agg(F.coalesce(F.sum("margin"), F.lit(0.0))).head()[0]  # one row
        whole = listed.agg(F.coalesce(F.sum("share"), F.lit(0.0))).head()[0]
        want = listed.select(d, (F.col("share") / F.lit(whole or 1.0) * F.lit(1 - other)).alias("want"))
        found.append(written(want.unionByName(margin.where(F.col(d) == OTHER).select(d, F.col("margin").alias("want"))), "wanted"))
    return found


def rake_table(coded: DataFrame, dims: list[str], wanted: list[DataFrame], budget: float | None = None) -> tuple[DataFrame, float]:
    """The cells (``dims``, actual: their share of all tokens) with a column fitted, and the largest distance of a margin from its target; with a ``budget`` no cell has more than its actual share of it.

    In each round and dimension, cells at their cap count with it and the others
    are scaled to what is left of their slice's target.
    """
    cap = F.col("actual") / F.lit(budget) if budget else F.lit(float("inf"))
    state = coded.select(*dims, "actual", F.col("actual").alias("weight"))
    residual = float("inf")
    for number in range(1, SPARK_ROUNDS + 1):
        for d, want in zip(dims, wanted, strict=True):
            full = F.sum(F.when(F.col("weight") >= cap, cap).otherwise(F.lit(0.0))).alias("full")
            free = F.sum(F.when(F.col("weight") < cap, F.col("weight")).otherwise(F.lit(0.0))).alias("free")
            scale = F.when(F.col("free") > 0, F.greatest(F.col("want") - F.col("full"), F.lit(0.0)) / F.col("free")).otherwise(F.lit(1.0))
            scales = state.groupBy(d).agg(full, free).join(want, d).select(F.col(d).alias("of"), scale.alias("scale"))
            state = state.join(scales, F.col(d) == F.col("of")).select(*dims, "actual", (F.col("weight") * F.when(F.col("scale") > 0, F.col("scale")).otherwise(F.lit(1e-12))).alias("weight"))
        state = written(state, "raked")
        if number % LOOK == 0 or number == SPARK_ROUNDS:
            off = [state.groupBy(d).agg(F.sum(F.least("weight", cap)).alias("has")).join(want, d).agg(F.max(F.abs(F.col("has") - F.col("want")))).head()[0] for d, want in zip(dims, wanted, strict=True)]
            before, residual = residual, max([x for x in off if x is not None], default=0.0)
            if residual < NEAR or before - residual < NEAR / 100:
                break
    return state.select(*dims, "actual", F.least("weight", cap).alias("fitted")), residual


def cell_factors_in_spark(cells: DataFrame, dims: list[str], shares: dict[str, DataFrame], budget: float | None = None) -> DataFrame:
    """:func:`cell_factors` for cells that are too many for the driver; ``shares`` has value and share of each dimension."""
    own = cells.select(*dims, F.coalesce("tokens", F.lit(0)).cast("double").alias("tokens"))
    for d in dims:
        known = shares[d].select(F.col("value").alias("of"), F.lit(True).alias("known"))
        own = own.join(known, F.col(d) == F.col("of"), "left").withColumn(f"code_{d}", F.when(F.col("known"), F.col(d)).otherwise(F.lit(OTHER))).drop("of", "known")
    own = written(own, "coded")
    codes = [f"code_{d}" for d in dims]
    merged = own.groupBy(*codes).agg(F.sum("tokens").alias("tokens"))
    total = float(own.agg(F.sum("tokens")).head()[0] or 0.0)
    if total <= 0:
        return own.select(*dims, F.lit(1.0).alias("factor"), F.lit(1.0).alias("probability"))
    coded = written(merged.withColumn("actual", F.col("tokens") / F.lit(total)), "merged")
    wanted = _wanted(coded, codes, {f"code_{d}": shares[d] for d in dims}, total)
    there = coded.where("actual > 0")
    free, residual = rake_table(there, codes, wanted)
    factor = free.select(*codes, (F.col("fitted") / F.col("actual")).alias("factor"))
    if budget is None:
        most = factor.agg(F.max("factor")).head()[0]
        both = factor.withColumn("probability", F.col("factor") / F.lit(most))
    else:
        capped, residual = rake_table(there, codes, wanted, budget)
        both = factor.join(capped.select(*codes, F.least(F.col("fitted") * F.lit(budget) / F.col("actual"), F.lit(1.0)).alias("probability")), codes)
    if residual > REPORTED:
        warnings.warn(f"the targets cannot be met: a share of tokens is off by {residual:.2g}", stacklevel=2)
    both = written(both, "factors")
    return own.join(both, codes, "left").select(*dims, F.coalesce("factor", F.lit(1.0)).alias("factor"), F.coalesce("probability", F.lit(1.0)).alias("probability"))


def tempered_shares(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """:func:`tempered_targets` of one dimension as a table of value and share (not normalised)."""
    by_value = cells.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens")).where("tokens > 0")
    return by_value.select("value", F.pow("tokens", F.lit(float(power))).alias("share"))


def draw(id_: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the id alone."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def _decide(rows: DataFrame, thin: DataFrame, dims: list[str], powers: dict[str, float] | None, targets: dict[str, dict[str, float]] | None, budget: float | None, seed: int) -> DataFrame:
    """``rows`` (with id and dims) joined with factor, probability and sampled."""
    cells = written(thin.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    n, spark = cells.count(), cells.sparkSession
    if targets is None and budget is None:
        budget = BUDGET
    if n <= BROADCAST:
        factors, _ = cell_factors(cells, tempered_targets(cells, powers or {}) if targets is None else targets, budget)
    else:
        if targets is None:
            shares = {d: written(tempered_shares(cells, d, power), "shares") for d, power in (powers or {}).items()}
        else:
            shares = {d: spark.createDataFrame([(str(k), float(v)) for k, v in of.items()], "value string, share double") for d, of in targets.items()}
        factors = cell_factors_in_spark(cells, dims, shares, budget)
    factors = factors.select(*[F.col(d).alias(f"cell_{d}") for d in dims], "factor", "probability")
    match = [F.col(d).eqNullSafe(F.col(f"cell_{d}")) for d in dims]
    joined = rows.join(F.broadcast(factors) if n <= BROADCAST else factors, match, "left").drop(*[f"cell_{d}" for d in dims])
    return joined.withColumn("sampled", draw(F.col("id"), seed) < F.col("probability"))


def _dims(source_col: str, lang_col: str, text_col: str, topic_col: str | None) -> dict[str, Column]:
    topic = F.col(topic_col) if topic_col else topic_of(text_of(text_col))
    return {"source": F.col(source_col), "lang": F.col(lang_col), "topic": topic}


def _weight(text_col: str, tokens: Column | None) -> Column:
    return F.coalesce(tokens, F.lit(0)) if tokens is not None else F.size(words(text_of(text_col)))


#: Temperatures of the production mixture: sources and languages are flattened, topics keep their shares.
POWERS = {"source": TEMPERATURE, "lang": TEMPERATURE, "topic": 1.0}


def mixing_weights(
    df: DataFrame,
    targets: dict[str, dict[str, float]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic_col: str | None = None,
    budget: float | None = None,
    seed: int = SEED,
    tokens: Column | None = None,
) -> DataFrame:
    """One row per input row: id, source, lang, topic, n_tokens, factor, probability, sampled.

    ``targets`` maps source, lang and topic to {value: share}; without it they
    are tempered by POWERS, and the budget is BUDGET unless given. ``tokens`` is
    what a document weighs (a column of token counts, say); without it its words are counted.
    """
    dims = _dims(source_col, lang_col, text_col, topic_col)
    thin = written(_thin(df, dims, _weight(text_col, tokens), id_col), "mixing")
    decided = _decide(thin, thin, list(dims), POWERS, targets, budget, seed)
    return decided.select(F.col("id").alias(id_col), *dims, F.col("tokens").alias("n_tokens"), "factor", "probability", "sampled")


def sample_mixture(df: DataFrame, targets: dict[str, dict[str, float]] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, budget: float | None = None, seed: int = SEED, tokens: Column | None = None) -> DataFrame:
    """The sampled rows of ``df`` with all their columns; documents are read twice and, up to BROADCAST cells, never shuffled."""
    dims = _dims(source_col, lang_col, text_col, topic_col)
    thin = _thin(df, dims, _weight(text_col, tokens), id_col)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), F.col(id_col).alias("id"), *[c.cast("string").alias(d) for d, c in dims.items()])
    return _decide(whole, thin, list(dims), POWERS, targets, budget, seed).where("sampled").select("doc.*")
