"""Ordered selection: stable top-k, truncation, bands, greedy diversity, factorial cells, validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import cleaning as C
from strandlake.operators.similarity import lcs_lengths, novel, violations
from strandlake.operators.storage import durable
from strandlake.operators.tables import balance_report, median_cells

#: Rows of the top list's shortlist.
SHORTLIST = 600


def top_k(df: DataFrame, score: str, k: int) -> DataFrame:
    """The k best, with rank 1..k; ties keep the order of ord. Spark keeps k rows a task; the ranks are of those k."""
    return df.orderBy(F.desc(score), "ord").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "ord")))


def first_passing(df: DataFrame, condition, n: int) -> DataFrame:
    """The first n rows in input order (ord) that pass."""
    return df.where(condition).orderBy("ord").limit(n)


def ordered_union(*parts: DataFrame) -> DataFrame:
    """Parts one after another, each in its order, each sequence at its first place; ord is numbered anew by (part, ord)."""
    rows = [p.select(F.lit(i).alias("part"), "ord", "s") for i, p in enumerate(parts)]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("s").agg(F.min(F.struct("part", "ord")).alias("o")).select("s", "o.part", "o.ord")


def eligible_band(df: DataFrame, score: str, tolerance: float) -> DataFrame:
    """Rows within tolerance times the score's range of the best; a range of 0 counts as 1."""
    b = df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return df.join(F.broadcast(b)).where(F.col(score) >= F.col("_hi") - tolerance * span).drop("_hi", "_lo")


def length_order(df: DataFrame, k: int) -> DataFrame:
    """The first k sequences by length, the longest first, then alphabet, with rank: the order in which clusters are led."""
    order = [F.desc(F.length("s")), F.col("s")]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def greedy_indices(seqs: list[str], score: np.ndarray, k: int, weight: float) -> list[int]:
    """Repeatedly the largest score * (1 - weight * largest ratio to what is chosen); the first on ties. Scores that aren't finite are never chosen."""
    n = len(seqs)
    if not n:
        return []
    near, left, out = np.zeros(n), np.isfinite(score), []
    size = np.array([len(s) for s in seqs])
    for _ in range(min(k, int(left.sum()))):
        gain = np.where(left, np.where(left, score, 0.0) * (1 - weight * near), -np.inf)
        i = int(gain.argmax())
        out.append(i)
        left[i] = False
        near = np.maximum(near, 2 * lcs_lengths([seqs[i]] * n, seqs) / np.maximum(size + size[i], 1))
    return out


def greedy_short(df: DataFrame, score: str, k: int, weight: float = 1.0) -> DataFrame:
    """greedy_diverse of a short list, in one task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ord", kind="stable").reset_index(drop=True)
        at = greedy_indices(p["s"].tolist(), p[score].to_numpy(float), k, weight)
        return p.iloc[at].assign(pick=np.arange(1, len(at) + 1, dtype=np.int64))

    from pyspark.sql.types import LongType, StructType

    rows = df.withColumn("_all", F.lit(0))
    schema = StructType([*rows.schema.fields]).add("pick", LongType())
    return rows.groupBy("_all").applyInPandas(run, schema).drop("_all")


#: Rows of each group, the best by score, whose exact gains the driver knows: the best of them bounds a round's pick from below.
LEADING = 64


def refreshed(rows: pd.DataFrame, score: str, by: str, picks: dict, least: dict, weight: float) -> pd.DataFrame:
    """rows with `near` and `seen` brought up to date, where the gain that they last had may still be the group's best.

    near: the largest ratio to the first `seen` picks of the row's group. A gain falls as near grows where the score is positive, and stays below score * (1 - weight) otherwise.
    picks: the sequences picked so far, by group; least: a gain that the group's best row has at least.
    """
    near, seen = rows["near"].to_numpy(float, copy=True), rows["seen"].to_numpy(np.int64, copy=True)
    value, words = rows[score].to_numpy(float), rows["s"].to_numpy()
    bound = np.where(value > 0, value * (1 - weight * near), value * (1 - weight))
    for g, at in rows.groupby(by, dropna=False).indices.items():
        chosen = picks.get(g, [])
        at = at[bound[at] >= least.get(g, -np.inf)]
        for first in np.unique(seen[at]).tolist():
            behind = at[seen[at] == first]
            own = words[behind].tolist()
            size = np.array([len(x) for x in own])
            for c in chosen[first:]:
                near[behind] = np.maximum(near[behind], 2 * lcs_lengths([c] * len(own), own) / np.maximum(size + len(c), 1))
        seen[at] = len(chosen)
    return rows.assign(near=near, seen=seen)


def greedy_rounds(df: DataFrame, score: str, k: int, by: str, weight: float = 1.0, save=durable) -> tuple[list[tuple], DataFrame]:
    """(picks as (group, ord, s, pick); the rows with `near` and `seen` after the last round): greedy_indices over all rows of each group, of any size, evaluated lazily.

    A round takes each row's last gain as a bound. Rows that it leaves below what the group's best row has at least keep it; the others are compared with the picks that they haven't
    been compared with. So the sum of `seen` is the number of comparisons: k a row at most, and far fewer where scores fall off. The state is written after each round.
    Rows that can't be picked are left out first: a row's gain lies between score and score * (1 - weight), and the k best by the smaller of the two have a larger gain than it
    (at a weight of 1 that only leaves out negative scores).
    """
    fields = {"_hi": F.greatest(F.col(score), F.col(score) * (1 - weight)), "_lo": F.least(F.col(score), F.col(score) * (1 - weight))}
    rows = df.where(F.col(score).isNotNull()).select(F.col(by), "ord", "s", F.col(score).cast("double").alias(score)).withColumns(fields)
    # the k-th largest lower bound of each group; Spark keeps k rows a group and task before the shuffle
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_lo")))
    floor = rows.select(by, "_lo").withColumn("_n", place).where(F.col("_n") <= k).groupBy(by).agg(F.min("_lo").alias("_floor"))
    state = save(rows.join(F.broadcast(floor), by).where(F.col("_hi") >= F.col("_floor")).select(by, "ord", "s", score, F.lit(0.0).alias("near"), F.lit(0).cast("long").alias("seen")))
    best = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), "ord"))
    leading: dict = {}
    for r in state.select(by, "ord", "s", score, best.alias("n")).where(F.col("n") <= LEADING).orderBy(by, "n").collect():
        leading.setdefault(r[by], []).append([r[score], 0.0, r["s"], r["ord"]])
    picks: dict = {}
    out: list[tuple] = []
    schema = state.schema
    for pick in range(1, k + 1):
        taken = {o for _, o, _, _ in out}
        least = {g: max((v * (1 - weight * n) for v, n, _, o in rows if o not in taken), default=-np.inf) for g, rows in leading.items()}
        now = state
        if picks:
            kept, bounds = {g: list(p) for g, p in picks.items()}, dict(least)

            def refresh(parts, kept=kept, bounds=bounds):
                for p in parts:
                    yield refreshed(p, score, by, kept, bounds, weight)

            # the last round's picks go
            now = save(state.where(~F.col("ord").isin([o for _, o, _, n in out if n == pick - 1])).mapInPandas(refresh, schema))
        exact = now.where(F.col("seen") == pick - 1).select(by, "ord", "s", (F.col(score) * (1 - weight * F.col("near"))).alias("_gain"))
        got = exact.groupBy(by).agg(F.max_by(F.struct("ord", "s"), F.struct("_gain", -F.col("ord"))).alias("b")).collect()
        state = now
        if not got:
            break
        for r in got:
            out.append((r[by], r["b"]["ord"], r["b"]["s"], pick))
            picks.setdefault(r[by], []).append(r["b"]["s"])
            for row in leading[r[by]]:
                row[1] = max(row[1], float(2 * lcs_lengths([r["b"]["s"]], [row[2]])[0] / max(len(row[2]) + len(r["b"]["s"]), 1)))
    return out, state


def greedy_diverse(df: DataFrame, score: str, k: int, by: str, weight: float = 1.0, save=durable) -> DataFrame:
    """df's chosen rows with `pick` (1..k), for each value of `by`: the first largest score * (1 - weight * largest ratio to what is chosen), again and again. ord must be unique. Null scores are never picked."""
    from pyspark.sql.types import LongType, StructType

    picks, _ = greedy_rounds(df, score, k, by, weight, save)
    kinds = StructType().add("ord", df.schema["ord"].dataType).add("pick", LongType())
    listed = df.sparkSession.createDataFrame([(o, n) for _, o, _, n in picks], kinds)
    return df.join(F.broadcast(listed), "ord").select(*df.columns, "pick")


def eligible(df: DataFrame, refs: DataFrame, score: str, t: float = 0.8) -> DataFrame:
    """The SHORTLIST best feasible and novel rows, with their place."""
    return top_k(novel(df.where(C.candidate_feasible(F.col("s"))), refs, t), score, SHORTLIST).withColumnRenamed("rank", "place")


def top_list(df: DataFrame, refs: DataFrame, score: str, k: int, head: int, weight: float = 1.0, t: float = 0.8) -> DataFrame:
    """Feasible, novel, shortlisted by score; `head` picked greedily among the 4 * head best, the rest from what is left."""
    short = eligible(df, refs, score, t).persist()
    first = greedy_short(short.where(F.col("place") <= 4 * head), score, min(head, k), weight)
    rest = greedy_short(short.join(first.select("s"), "s", "left_anti").select(*short.columns), score, max(k - head, 0), weight).withColumn("pick", F.col("pick") + head)
    return first.select("s", "ord", score, "pick").unionByName(rest.select("s", "ord", score, "pick"))


def factorial_band(df: DataFrame, score: str, axes: list[str], pool: int, tolerance: float = 0.12, save=lambda d: d.persist()) -> DataFrame:
    """The rows that a design of `pool` rows chooses among, with their cell: the eligible band or, where it has fewer than `pool` rows, the max(3 pool, 150) best.

    `save` keeps the band, which its medians read."""
    band = save(eligible_band(df, score, tolerance))
    if band.count() < pool:
        band = save(top_k(df, score, max(3 * pool, 150)).drop("rank"))
    return median_cells(band, axes)


def factorial_select(df: DataFrame, score: str, axes: list[str], pool: int, tolerance: float = 0.12, weight: float = 1.0, save=lambda d: d.persist()) -> DataFrame:
    """`pool` rows with their cell and pick (1..pool): of the band the cells of median splits each give pool // cells (1 at least) by greedy
    diversity, in order of their names; what is missing is filled by score. `save` keeps the band, which each pick reads."""
    cells = save(factorial_band(df, score, axes, pool, tolerance, save))
    take = max(pool // max(cells.select("cell").distinct().count(), 1), 1)
    chosen = greedy_diverse(cells, score, take, "cell", weight)
    fill = top_k(cells.join(chosen.select("ord"), "ord", "left_anti").select(*cells.columns), score, pool)
    both = chosen.select(*cells.columns, F.lit(0).alias("_late"), "pick").unionByName(fill.select(*cells.columns, F.lit(1).alias("_late"), F.col("rank").cast("long").alias("pick")))
    # at most pool rows and one a cell stand here
    order = Window.orderBy("_late", F.when(F.col("_late") == 0, F.col("cell")), "pick")
    return both.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= pool).drop("_late")


def factorial_cells_report(chosen: DataFrame, band: DataFrame, score: str, means: list[str]) -> DataFrame:
    """cell, available, selected, mean_score and the means of the given columns over the selected rows of each cell of the band."""
    there = band.groupBy("cell").agg(F.count(F.lit(1)).alias("available"))
    got = chosen.groupBy("cell").agg(F.count(F.lit(1)).alias("selected"), F.avg(score).alias("mean_score"), *[F.avg(c).alias(f"mean_{c}") for c in means])
    return there.join(got, "cell", "left").withColumn("selected", F.coalesce("selected", F.lit(0)))


def factorial_cost(chosen: DataFrame, df: DataFrame, score: str, axes: list[str], match: list[str]) -> DataFrame:
    """One row: design_mean and greedy_mean of the score, relative_cost of choosing by design, and for each matched column the spread of its cell means,
    cells being those of the chosen rows' own medians."""
    n = chosen.count()
    best = top_k(df, score, n).agg(F.avg(score).alias("greedy_mean"))
    own = chosen.agg(F.avg(score).alias("design_mean"))
    cost = F.when(F.col("greedy_mean") == 0, 0.0).otherwise((F.col("greedy_mean") - F.col("design_mean")) / F.abs("greedy_mean"))
    out = own.join(F.broadcast(best)).withColumn("relative_cost", F.coalesce(cost, F.lit(0.0)))
    cells = median_cells(chosen.drop("cell"), axes)
    for c in match:
        out = out.join(F.broadcast(balance_report(cells, c).select(F.coalesce("spread", F.lit(0.0)).alias(f"spread_{c}"))))
    return out


class TooDear(ValueError):
    """A design costs more of the mean score than allowed."""


def factorial_top_list(df: DataFrame, refs: DataFrame, score: str, axes: list[str], k: int = 100, pool: int = 50, tolerance: float = 0.12, weight: float = 1.0, t: float = 0.8, most_cost: float | None = None) -> DataFrame:
    """s, ord, score, pick: a factorial design of `pool` rows of the eligible ones, then the rest by greedy diversity, k in all.

    Without `pool` eligible rows the list is empty. most_cost: raise TooDear where the design's relative cost is above it (0.05 is usual), instead of listing.
    """
    short = eligible(df, refs, score, t).drop("place").persist()
    if short.count() < pool:
        return short.limit(0).select("s", "ord", score, F.lit(0).cast("long").alias("pick"))
    first = factorial_select(short, score, axes, pool, tolerance, weight)
    if most_cost is not None:
        cost = factorial_cost(first, short, score, axes, []).first()["relative_cost"]
        if cost > most_cost:
            raise TooDear(f"the design costs {cost:.2%} of the mean score; at most {most_cost:.2%} is allowed")
    rest = greedy_short(short.join(first.select("ord"), "ord", "left_anti").select(*short.columns), score, max(k - pool, 0), weight).withColumn("pick", F.col("pick") + pool)
    return first.select("s", "ord", score, F.col("pick").cast("long")).unionByName(rest.select("s", "ord", score, "pick"))


def validate(top: DataFrame, library: DataFrame, refs: DataFrame, k: int, n: int) -> DataFrame:
    """One row of violation counts: all zero for a valid result. A top sequence is too close where its best reference is strictly above 0.8."""
    t = top.agg((F.lit(k) - F.count(F.lit(1))).alias("top_missing"), (F.count(F.lit(1)) - F.count_distinct("s")).alias("top_repeats"), F.count_if(~C.candidate_feasible(F.col("s"))).alias("top_infeasible"))
    l = library.agg((F.lit(n) - F.count(F.lit(1))).alias("library_missing"), (F.count(F.lit(1)) - F.count_distinct("s")).alias("library_repeats"), F.count_if(~C.library_feasible(F.col("s"))).alias("library_infeasible"))
    outside = top.join(library.select("s"), "s", "left_anti").agg(F.count(F.lit(1)).alias("top_outside_library"))
    known = library.join(refs.select("s").distinct(), "s", "left_semi").agg(F.count(F.lit(1)).alias("library_known"))
    close = violations(top, refs).agg(F.count(F.lit(1)).alias("top_too_close"))
    return t.join(l).join(outside).join(known).join(close)


def require_valid(counts: DataFrame) -> None:
    """Raise ValueError with every violated rule of a row of `validate`."""
    wrong = {k: v for k, v in counts.first().asDict().items() if v}
    if wrong:
        raise ValueError("; ".join(f"{k}: {v}" for k, v in wrong.items()))
