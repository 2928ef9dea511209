"""The screening funnel: sample, gate, score, refine, select, assemble. Lazy frames, stored where a list is read by several later steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import descriptors as D
from strandlake.functions import objective as O
from strandlake.functions.cleaning import library_feasible
from strandlake.operators import select as sel
from strandlake.operators.models import Predictors
from strandlake.operators.search import refine

LEAST_PASS = 0.02


@dataclass
class Sizes:
    """The usual numbers; registered queries say which smaller ones they take."""

    library: int = 50_000
    top: int = 100
    draw: int = 50
    gated: int = 20_000
    ranked: int = 2_000
    seeds: int = 150
    steps: int = 400
    seed: int = 42


def described(df: DataFrame) -> DataFrame:
    return D.with_descriptors(df.select("ord", "s"))


def scored(df: DataFrame, predictors: Predictors) -> DataFrame:
    """df (with descriptors) with predictions, axes and scores."""
    return O.with_score(O.with_axes(predictors.predict(df)))


def unknown(df: DataFrame, refs: DataFrame) -> DataFrame:
    return df.where(library_feasible(F.col("s"))).join(refs.select("s").distinct(), "s", "left_anti").select("ord", "s")


def run(pool: DataFrame, refs: DataFrame, predictors: Predictors, sizes: Sizes | None = None, save: Callable[[DataFrame], DataFrame] = lambda df: df.persist()) -> tuple[DataFrame, DataFrame]:
    """(library: ord, s; top: rank and what explains it) from a sampled pool (ord, s).

    Raises ValueError where fewer than LEAST_PASS of the pool pass the gate, where the library can't be filled, or where a rule of the result is violated.
    """
    n = sizes or Sizes()
    fresh = save(unknown(pool.groupBy("s").agg(F.min("ord").alias("ord")), refs))
    gated = save(predictors.gate.apply(described(fresh)).select("ord", "s", *D.FEATURES, "in_distribution"))
    counts = gated.agg(F.count(F.lit(1)).alias("n"), F.count_if("in_distribution").alias("ok")).first()
    if counts["ok"] < LEAST_PASS * max(counts["n"], 1):
        raise ValueError(f"{counts['ok']} of {counts['n']} sequences pass the gate")
    first = save(sel.first_passing(gated, F.col("in_distribution"), n.gated).drop("in_distribution"))
    ranked = save(sel.top_k(scored(first, predictors), "chebyshev", n.ranked).select("rank", "ord", "s"))
    starts = ranked.where(F.col("rank") <= n.seeds).select((F.col("rank") - 1).cast("long").alias("ord"), "s")
    chains = save(refine(starts.repartition(min(n.seeds, 64), "ord"), n.steps, n.seed, predictors.scorer()))
    # all best states first, then what the chains proposed, then the ranked ones
    place = F.when(F.col("best"), F.col("chain")).otherwise(F.lit(n.seeds) + F.col("chain") * (n.steps + 1) + F.col("place"))
    refined = unknown(chains.select(place.alias("ord"), "s"), refs)
    union = save(sel.ordered_union(refined, ranked).withColumn("ord", F.col("part") * 1_000_000_000 + F.col("ord")).select("ord", "s"))
    final = save(scored(described(union), predictors))
    listed = save(sel.top_list(final.select("s", "ord", "risk_adjusted"), refs, "risk_adjusted", n.top, min(n.draw, n.top)))
    top = listed.select(F.col("pick").alias("rank"), "s").join(O.explain(final), "s")
    library = sel.ordered_union(listed.select(F.col("pick").alias("ord"), "s"), union, first, fresh).withColumn("ord", F.col("part") * 1_000_000_000_000 + F.col("ord"))
    library = save(sel.first_passing(library, library_feasible(F.col("s")), n.library).select("ord", "s"))
    sel.require_valid(sel.validate(listed, library, refs, n.top, n.library))
    return library, top
