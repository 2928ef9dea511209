"""Aggregations, pivots and statistics over measurement tables."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.scales import FORBIDDEN, TOP_MAX_LENGTH, TOP_MIN_LENGTH

GROUPS = ["gram_negative", "gram_positive", "hc50", "resistant"]


def log2(x: Column) -> Column:
    """The logarithm of the C library; null where x isn't positive. Spark's log2 divides two logarithms: its log2(100) - log2(50) isn't 1, so values at a threshold fall on either side."""

    def run(v: pd.Series) -> pd.Series:
        return pd.Series([math.log2(i) if i > 0 else math.nan if i != i else None for i in v.tolist()], dtype=object)

    # nulls reach pandas as NaN
    return F.when(x.isNotNull(), F.pandas_udf(run, "double")(x))


def aggregate_activity(long: DataFrame) -> DataFrame:
    """One row per sequence and group. Rows of resistant strains count in the group `resistant` too; one shuffle."""
    groups = F.when(F.col("resistant"), F.array(F.col("grp"), F.lit("resistant"))).otherwise(F.array("grp"))
    rows = long.where("drop_reason is null").select("s", F.explode(groups).alias("grp"), log2(F.col("value_um")).alias("v"), "censor", "amidated")
    return rows.groupBy("s", "grp").agg(
        F.median("v").alias("log2_um"), F.when(F.bool_and(F.col("censor") == 1), 1).otherwise(0).alias("censor"), F.count(F.lit(1)).alias("n_obs"), F.bool_or("amidated").alias("amidated")
    )


def to_wide(agg: DataFrame) -> DataFrame:
    """Per sequence: value, censor and count of each group; null where not measured. One pivot."""
    out = agg.groupBy("s").pivot("grp", GROUPS).agg(F.first("log2_um").alias("v"), F.first("censor").alias("censor"), F.first("n_obs").alias("n"))
    return out.select("s", *[F.col(f"{g}_v").alias(g) for g in GROUPS], *[f"{g}_{k}" for g in GROUPS for k in ("censor", "n")])


def coverage(wide: DataFrame, potent: float = 4.0) -> DataFrame:
    """grp, measured, bounds, potent; and rows both_gram and any_gram."""
    one = wide.agg(*[f for g in GROUPS for f in (F.count(g).alias(f"{g}_m"), F.count_if(F.col(f"{g}_censor") == 1).alias(f"{g}_b"), F.count_if(F.col(g) <= potent).alias(f"{g}_p"))],
                   F.count_if(F.col("gram_negative").isNotNull() & F.col("gram_positive").isNotNull()).alias("both_m"), F.count_if(F.coalesce("gram_negative", "gram_positive").isNotNull()).alias("any_m"))
    rows = [F.struct(F.lit(g).alias("grp"), F.col(f"{g}_m").alias("measured"), F.col(f"{g}_b").alias("bounds"), F.col(f"{g}_p").alias("potent")) for g in GROUPS]
    none = F.lit(None).cast("long")
    rows += [F.struct(F.lit(f"{k}_gram").alias("grp"), F.col(f"{k}_m").alias("measured"), none.alias("bounds"), none.alias("potent")) for k in ("both", "any")]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


#: Distinct values that one task sums up. Fewer are one range; more are cut into ranges of about as many.
RANGE_ROWS = 100_000


def cuts_of(counts: DataFrame, column: str) -> list[float]:
    """Values that cut the rows into ranges of about RANGE_ROWS; none for fewer rows."""
    ranges = -(-counts.count() // RANGE_ROWS)
    if ranges < 2:
        return []
    found = counts.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.5 / ranges)
    return sorted(set(found))


def running(counts: DataFrame, column: str, weight: str, by: list[str] | None = None) -> DataFrame:
    """counts with `upto`: the sum of `weight` over rows whose `column` is at most as large, for each value of `by`. A value stands once in a group.

    Where there are more than RANGE_ROWS rows, they are cut into ranges, as many as their number asks for, summed up in each, and the sums (one a range and group) put
    one after another: no task gets all rows of a large group.
    """
    by = by or []
    cuts = cuts_of(counts, column)
    whole = Window.partitionBy(*by).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    if not cuts:
        return counts.withColumn("upto", F.sum(weight).over(whole))
    part = counts.withColumn("_range", F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(column) > c)))
    sums = part.groupBy(*by, "_range").agg(F.sum(weight).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum(weight).over(Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    keys = [*by, "_range"]
    before = before.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return part.withColumn("upto", inside).join(before, same).withColumn("upto", F.col("upto") + F.col("_before")).drop("_before", "_range", *[f"_k_{k}" for k in keys])


def exact_quantiles(df: DataFrame, column: str, levels: list, by: list[str] | None = None) -> DataFrame:
    """by, n, q0, q1, ...: interpolated quantiles of the values that aren't null. levels: shares, or functions of the Column n that give one.

    Values come from counts of distinct values and their running sums, so a group's values are never in one buffer. Groups without a value have no row;
    ungrouped, there is one row in any case.
    """
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counts, "_v", "_c", by)
    n = counts.groupBy(*by).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"))
    keys = [F.col(k).eqNullSafe(F.col(f"_n_{k}")) for k in by]
    sized = n.withColumnsRenamed({k: f"_n_{k}" for k in by})
    joined = upto.join(F.broadcast(sized), keys) if by else upto.join(F.broadcast(sized))
    place = [(level(F.col("n")) if callable(level) else F.lit(float(level))) * (F.col("n") - 1) for level in levels]
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("_v")))
    got = joined.groupBy(*by, "n").agg(*[f for i, p in enumerate(place) for f in (at(F.floor(p)).alias(f"_lo{i}"), at(F.ceil(p)).alias(f"_hi{i}"))])
    value = lambda i, p: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (p - F.floor(p))
    out = got.select(*by, "n", *[value(i, p).alias(f"q{i}") for i, p in enumerate(place)])
    return out if by else n.join(F.broadcast(out.drop("n")), how="left")


def quantile_windows(df: DataFrame, columns: list[str], by: Column, least: int = 50, levels: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Exact, interpolated quantiles of each column per population; small populations are left out."""
    rows = df.withColumn("population", by)
    out = None
    for c in columns:
        got = exact_quantiles(rows, c, list(levels), ["population"]).where(F.col("n") >= least)
        got = got.select("population", F.lit(c).alias("column"), "n", *[F.col(f"q{i}").alias(f"q{round(100 * x)}") for i, x in enumerate(levels)])
        out = got if out is None else out.unionByName(got)
    return out


def design_windows(wide: DataFrame, properties: DataFrame, potent: float = 4.0, selective: float = 2.0, least: int = 50) -> DataFrame:
    """population, n, and the quantiles that the design windows come from, of three nested populations of sequences without cysteine.

    wide: as to_wide gives it; properties: s, net_charge, moment_helix, length. `potent`: a Gram value of at most this log2 concentration; `selective`: in
    addition a log2 safety window of at least this; `length_band`: in addition a length allowed in top lists. Populations under `least` are left out.
    """
    best = F.least("gram_positive", "gram_negative")  # passes over nulls
    base = wide.where((best <= potent) & ~F.col("s").contains(FORBIDDEN)).join(properties, "s")
    window = F.coalesce(F.col("hc50") - best >= selective, F.lit(False))
    names = F.array(F.lit("potent"), F.when(window, "selective"), F.when(window & F.col("length").between(TOP_MIN_LENGTH, TOP_MAX_LENGTH), "length_band"))
    rows = base.select(F.explode(F.array_compact(names)).alias("population"), "net_charge", "moment_helix", "length")
    q = quantile_windows(rows, ["net_charge", "moment_helix", "length"], F.col("population"), least)
    of = lambda c, k: F.max(F.when(F.col("column") == c, F.col(k)))
    return q.groupBy("population").agg(
        F.max("n").alias("n"), of("net_charge", "q10").alias("charge_lo"), of("net_charge", "q90").alias("charge_hi"), of("net_charge", "q50").alias("charge_median"),
        of("moment_helix", "q10").alias("moment_floor"), of("moment_helix", "q50").alias("moment_median"), of("length", "q10").alias("length_lo"), of("length", "q90").alias("length_hi"),
    )


def safety_target(wide: DataFrame, level: float = 0.75, least: int = 100, default: float = 5.0) -> DataFrame:
    """n and target: the quantile of positive safety windows, where there are more than `least`."""
    w = wide.select((F.col("hc50") - F.least("gram_positive", "gram_negative")).alias("w")).where("w > 0")
    return exact_quantiles(w, "w", [level]).select("n", F.when(F.col("n") > least, F.col("q0")).otherwise(default).alias("target"))


def run_summary(df: DataFrame, by: str, metric: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("std"), F.count(metric).alias("n"))


def average_ranks(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ranks with ties averaged, from running counts of distinct values: equal values cost one row."""
    by = by or []
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_c"))
    ranks = running(counts, column, "_c", by).select(*by, column, (F.col("upto") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(ranks, [*by, column])


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null where one of the two doesn't vary (`corr` divides by zero there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y)
    ranked = average_ranks(average_ranks(rows, x, "_rx", by), y, "_ry", by)
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("spearman"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """Correlation of the residues of the ranks of x and y on those of z; from correlations, in one aggregate."""
    ranked = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(x, y, z)
    for c, r in ((x, "_rx"), (y, "_ry"), (z, "_rz")):
        ranked = average_ranks(ranked, c, r)
    c = ranked.agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("xy"), correlation("_rx", "_rz").alias("xz"), correlation("_ry", "_rz").alias("yz"))
    return c.select("n", ((F.col("xy") - F.col("xz") * F.col("yz")) / F.sqrt((1 - F.pow("xz", F.lit(2.0))) * (1 - F.pow("yz", F.lit(2.0))))).alias("partial"))


def median_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """cell: hi or lo against the median of each column, joined by '|'. The medians are one row."""
    sides = [F.concat(F.lit(f"{c}:"), F.when(F.col(c) >= F.col(f"_m_{c}"), "hi").otherwise("lo")) for c in columns]
    rows = df
    for c in columns:
        rows = rows.join(F.broadcast(exact_quantiles(df, c, [0.5]).select(F.col("q0").alias(f"_m_{c}"))))
    return rows.withColumn("cell", F.concat_ws("|", *sides)).drop(*[f"_m_{c}" for c in columns])


def balance_report(df: DataFrame, column: str) -> DataFrame:
    cells = df.groupBy("cell").agg(F.avg(column).alias("m"))
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.min("m").alias("low"), F.max("m").alias("high"), (F.max("m") - F.min("m")).alias("spread"))


def conformal_width(residuals: DataFrame, column: str, alpha: float = 0.1) -> DataFrame:
    """n, width: the interpolated quantile of |residual| at min(1, ceil((n + 1)(1 - alpha)) / n); 0 without rows."""
    r = residuals.select(F.abs(column).alias("r"))
    level = lambda n: F.least(F.lit(1.0), F.ceil((n + 1) * (1 - alpha)) / n)
    return exact_quantiles(r, "r", [level]).select("n", F.coalesce("q0", F.lit(0.0)).alias("width"))


def evaluate(df: DataFrame, truth: str, pred: str, censor: str) -> DataFrame:
    """Metrics over uncensored rows, and the share of bounds that predictions respect; two rows' ranks never meet the driver."""
    open_ = df.where(F.col(censor) == 0)
    err = F.abs(F.col(truth) - F.col(pred))
    a = open_.agg(F.count(F.lit(1)).alias("n"), F.avg(err).alias("mae"), F.avg((err <= 1).cast("double")).alias("within_1"), F.avg((err <= 2).cast("double")).alias("within_2"))
    b = spearman(open_, truth, pred).select("spearman")
    c = df.where(F.col(censor) == 1).agg(F.count(F.lit(1)).alias("n_censored"), F.avg((F.col(pred) >= F.col(truth)).cast("double")).alias("bound_respected"))
    return a.join(b).join(c)
