"""Fitted operators: censored regression, activity classification, the distribution gate.

Gradient boosting comes from operators/boosting.py or, for more training rows than a task takes, from pyspark.ml.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators import boosting
from strandlake.operators.tables import conformal_width, evaluate, running
from strandlake.sources.tables import read_json, write_json

#: Distinct rows (by hash) in which the gate's steps over all rows find their starts, and how many starts are followed.
START_ROWS, START_MODELS = 1_500, 3
#: Most concentration steps over all rows.
MOST_STEPS = 30
#: Rows of a bin from which on its distinct distances are listed.
LISTED = 65_536
#: Rows of sums that a concentration step brings to the driver, a task one.
MOST_SUMS = 256


def _filled(features: list[str]):
    """The features as an array of doubles, missing ones as 0."""
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])


class CensoredRegressor:
    """Boosted trees for targets with lower bounds: after each round, a bound's target becomes max(bound, prediction).

    step: what each tree counts; rows and columns: shares drawn anew for each tree. engine: 'tasks' fits one member a task (operators/boosting.py; more training rows than a task takes,
    909,090 of 44 features, are fitted with 'spark'), 'spark' fits them one after another with pyspark.ml, of any number of rows; its trees draw columns anew in each node.
    """

    def __init__(self, features: list[str], seeds: tuple[int, ...] = (0, 1, 2), rounds: int = 4, trees: int = 400, depth: int = 3, step: float = 0.05, row_share: float = 0.8, column_share: float = 0.8, engine: str = "tasks"):
        if engine not in ("tasks", "spark"):
            raise ValueError(f"no engine {engine}")
        self.features, self.seeds, self.rounds, self.trees, self.depth = features, seeds, rounds, trees, depth
        self.step, self.row_share, self.column_share, self.engine, self.models = step, row_share, column_share, engine, []

    def _assemble(self, df: DataFrame) -> DataFrame:
        filled = df.withColumns({f"_x{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(self.features)})
        return VectorAssembler(inputCols=[f"_x{i}" for i in range(len(self.features))], outputCol="_features").transform(filled).drop(*[f"_x{i}" for i in range(len(self.features))])

    def fit(self, df: DataFrame, target: str, censor: str) -> CensoredRegressor:
        known = df.where(F.col(target).isNotNull())
        if self.engine == "spark":
            self._fit_spark(known, target, censor)
            return self
        settings = {"rounds": self.rounds, "trees": self.trees, "depth": self.depth, "step": self.step, "rows": self.row_share, "columns": self.column_share}
        rows = known.select(_filled(self.features).alias("x"), F.col(target).cast("double").alias("y"), F.coalesce((F.col(censor) == 1).cast("int"), F.lit(0)).alias("mark")).persist()
        fit = lambda x, y, mark, _, seed: boosting.imputed(x, y, mark == 1, seed=seed, **settings)
        try:
            if rows.count() > boosting.most_rows(len(self.features)):
                self.engine = "spark"
                self._fit_spark(known, target, censor)
                return self
            self.models = boosting.fit_members(rows, len(self.features), list(enumerate(self.seeds)), fit)
        finally:
            rows.unpersist()
        return self

    def _fit_spark(self, df: DataFrame, target: str, censor: str) -> None:
        from pyspark.ml.regression import GBTRegressor

        rows = self._assemble(df).select("_features", F.col(target).cast("double").alias("_bound"), (F.col(censor) == 1).alias("_right"))
        rows = rows.cache()
        self.models = []
        for seed in self.seeds:
            now = rows.withColumn("_y", F.col("_bound"))
            for r in range(self.rounds):
                model = GBTRegressor(featuresCol="_features", labelCol="_y", predictionCol="_p", maxIter=self.trees, maxDepth=self.depth, stepSize=self.step, subsamplingRate=self.row_share, featureSubsetStrategy=str(self.column_share), seed=seed).fit(now)
                # imputed from the rows themselves each round: the lineage doesn't grow
                if r < self.rounds - 1:
                    now = model.transform(rows).withColumn("_y", F.when(F.col("_right"), F.greatest("_bound", "_p")).otherwise(F.col("_bound"))).drop("_p")
            self.models.append(model)
        rows.unpersist()

    def predict(self, df: DataFrame, out: str = "prediction", spread: str = "spread") -> DataFrame:
        """Mean and population deviation over the seeds."""
        if self.engine == "tasks":
            now = df.withColumn("_p", boosting.predicted(self.models, _filled(self.features), len(self.features)))
            cols = [F.get("_p", i) for i in range(len(self.models))]
        else:
            now, cols = self._assemble(df), []
            for i, m in enumerate(self.models):
                now = m.copy({m.predictionCol: f"_p{i}"}).transform(now)
                cols.append(F.col(f"_p{i}"))
        mean = sum(cols[1:], cols[0]) / len(cols)
        now = now.withColumn(out, mean)
        dev = F.sqrt(sum(((c - F.col(out)) * (c - F.col(out)) for c in cols), F.lit(0.0)) / len(cols))
        return now.withColumn(spread, dev).drop("_features", "_p", *[f"_p{i}" for i in range(len(cols))])

    def importances(self) -> dict[str, float]:
        """Shares of the features in the first member: of its splits, or with engine 'spark' of their gain."""
        first = self.models[0]
        return dict(zip(self.features, (first.shares(len(self.features)) if self.engine == "tasks" else first.featureImportances.toArray()).tolist()))

    def save(self, path: str) -> None:
        """Write the ensembles and their settings under `path`, in any file system that Spark writes to."""
        spark = SparkSession.active()
        if self.engine == "tasks":
            spark.createDataFrame([(i, m.to_json()) for i, m in enumerate(self.models)], "member int, model string").write.mode("overwrite").parquet(f"{path}/members")
        else:
            for i, m in enumerate(self.models):
                m.write().overwrite().save(f"{path}/member-{i}")
        names = ("features", "rounds", "trees", "depth", "step", "row_share", "column_share", "engine")
        write_json(spark, {k: getattr(self, k) for k in names} | {"seeds": list(self.seeds), "members": len(self.models)}, f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> CensoredRegressor:
        from pyspark.ml.regression import GBTRegressionModel

        spark = SparkSession.active()
        s = read_json(spark, f"{path}/settings")
        out = cls(s["features"], tuple(s["seeds"]), s["rounds"], s["trees"], s["depth"], s["step"], s["row_share"], s["column_share"], s["engine"])
        if out.engine == "tasks":
            out.models = [boosting.Ensemble.of_json(r["model"]) for r in spark.read.parquet(f"{path}/members").orderBy("member").collect()]
        else:
            out.models = [GBTRegressionModel.load(f"{path}/member-{i}") for i in range(s["members"])]
        return out


class ActivityClassifier:
    """Boosted trees for the log-odds with isotonic calibration: each of `folds` models is fitted without one fold and calibrated on it; a prediction is their mean. Folds are fitted in tasks of their own, at the same time."""

    def __init__(self, features: list[str], trees: int = 300, folds: int = 5, depth: int = 3, step: float = 0.05, row_share: float = 0.8):
        self.features, self.trees, self.folds, self.depth, self.step, self.row_share, self.members = features, trees, folds, depth, step, row_share, []

    def _rows(self, df: DataFrame, label: str, key: str) -> DataFrame:
        return df.where(F.col(label).isNotNull()).withColumns({"_y": F.col(label).cast("double"), "_fold": F.pmod(F.xxhash64(key), F.lit(self.folds)).cast("int")})

    def fit(self, df: DataFrame, label: str, key: str) -> ActivityClassifier:
        from pyspark.ml.regression import IsotonicRegression

        settings = {"trees": self.trees, "depth": self.depth, "step": self.step, "rows": self.row_share, "columns": 1.0, "loss": "logistic", "least": 1}
        rows = self._rows(df, label, key).select(_filled(self.features).alias("_x"), "_y", "_fold").persist()
        fit = lambda x, y, mark, fold, seed: boosting.boost(x[mark != fold], y[mark != fold], seed, **settings)
        models = boosting.fit_members(rows.select(F.col("_x").alias("x"), F.col("_y").alias("y"), F.col("_fold").alias("mark")), len(self.features), [(f, 7 + f) for f in range(self.folds)], fit)
        held = rows.withColumn("_raw", self._probability(F.get(boosting.predicted(models, F.col("_x"), len(self.features)), F.col("_fold")))).select("_raw", "_y", "_fold").persist()
        self.members = [(m, IsotonicRegression(featuresCol="_raw", labelCol="_y", predictionCol="_p").fit(held.where(F.col("_fold") == f).select("_raw", "_y"))) for f, m in enumerate(models)]
        held.unpersist()
        rows.unpersist()
        return self

    @staticmethod
    def _probability(odds):
        return 1 / (1 + F.exp(-odds))

    def predict(self, df: DataFrame, out: str = "probability_active") -> DataFrame:
        now, names = df.withColumn("_odds", boosting.predicted([m for m, _ in self.members], _filled(self.features), len(self.features))), []
        for i, (_, isotonic) in enumerate(self.members):
            now = isotonic.copy({isotonic.predictionCol: f"_p{i}"}).transform(now.withColumn("_raw", self._probability(F.get("_odds", i)))).drop("_raw")
            names.append(f"_p{i}")
        return now.withColumn(out, sum((F.col(c) for c in names[1:]), F.col(names[0])) / len(names)).drop("_odds", *names)

    def predict_held_out(self, df: DataFrame, label: str, key: str, out: str = "probability_active") -> DataFrame:
        """Each row's probability from the model that was fitted without its fold, before the calibration, which saw that fold."""
        odds = boosting.predicted([m for m, _ in self.members], _filled(self.features), len(self.features))
        return self._rows(df, label, key).withColumn(out, self._probability(F.get(odds, F.col("_fold")))).drop("_y")


def classifier_metrics(df: DataFrame, label: str, probability: str) -> DataFrame:
    """n, base_rate, average_precision and brier of probabilities; rows of equal probability are one step of the curve."""
    rows = df.where(F.col(label).isNotNull() & F.col(probability).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(probability).cast("double").alias("p"))
    steps = rows.groupBy((-F.col("p")).alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("hits"))
    upto = running(steps, "p", "n").withColumnRenamed("upto", "n_upto").join(running(steps, "p", "hits").select("p", F.col("upto").alias("hits_upto")), "p")
    area = upto.agg(F.sum(F.col("hits") * F.col("hits_upto") / F.col("n_upto")).alias("area"))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("base_rate"), F.sum("y").alias("hits"), F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2.0))).alias("brier"))
    return one.join(F.broadcast(area)).select("n", "base_rate", (F.col("area") / F.col("hits")).alias("average_precision"), "brier")


#: Column of each head's predictions, and the heads that count as 6.0 where they are missing.
HEADS = {"gram_positive": "log2_mic_gram_positive", "gram_negative": "log2_mic_gram_negative", "hc50": "log2_hc50", "resistant": "log2_mic_resistant"}
DEFAULTED, DEFAULT = ("gram_positive", "gram_negative", "hc50"), 6.0


class Predictors:
    """Fitted heads with their gate, conformal widths and metrics, over one list of features."""

    def __init__(self, features: list[str], heads: dict[str, CensoredRegressor], gate: DistributionGate | None = None, widths: dict[str, float] | None = None, metrics: dict | None = None):
        self.features, self.heads, self.gate, self.widths, self.metrics = features, heads, gate, widths or {}, metrics or {}

    @classmethod
    def fit(cls, wide: DataFrame, features: list[str], clusters: DataFrame | None = None, least: int = 200, alpha: float = 0.2, gated: bool = True, **settings) -> Predictors:
        """Heads for the columns of `wide` (s, values, *_censor, features) with at least `least` values.

        clusters: s and `test`, the split by whole clusters that metrics and conformal widths are measured on; without it all rows are fitted and none measured.
        gated: whether the gate is fitted too; predictions, importances, metrics and widths don't read it.
        """
        heads, widths, metrics = {}, {}, {}
        rows = wide if clusters is None else wide.join(clusters.select("s", "test"), "s")

        def one(name: str):
            own = rows.where(F.col(name).isNotNull()).withColumn("_right", (F.col(f"{name}_censor") == 1).cast("int")).persist()
            try:
                if own.count() < least:
                    return name, None, None, None
                head = CensoredRegressor(features, **settings).fit(own if clusters is None else own.where("not test"), name, "_right")
                if clusters is None:
                    return name, head, None, None
                tested = head.predict(own.where("test")).select(name, "prediction", "_right").persist()
                found = {k: v for k, v in evaluate(tested, name, "prediction", "_right").first().asDict().items() if v is not None}
                width = conformal_width(tested.where("_right = 0").select((F.col(name) - F.col("prediction")).alias("r")), "r", alpha).first()["width"] if found["n"] > 5 else None
                tested.unpersist()
                return name, head, found, width
            finally:
                own.unpersist()

        # heads don't wait for each other: their members' tasks run side by side
        with ThreadPoolExecutor(len(HEADS)) as pool:
            for name, head, found, width in pool.map(inheritable_thread_target(wide.sparkSession)(one), HEADS):
                if head is not None:
                    heads[name] = head
                    metrics |= {} if found is None else {name: found}
                    widths |= {} if width is None else {name: width}
        return cls(features, heads, DistributionGate(features).fit(wide) if gated else None, widths, metrics)

    def predict(self, df: DataFrame) -> DataFrame:
        """df with the columns of HEADS and spread_<head>; a missing head's value is 6.0 (null for resistant strains), its spread null."""
        none = F.lit(None).cast("double")
        for name, column in HEADS.items():
            if name in self.heads:
                df = self.heads[name].predict(df, column, f"spread_{name}")
            else:
                df = df.withColumns({column: F.lit(DEFAULT) if name in DEFAULTED else none, f"spread_{name}": none})
        return df

    def importances(self) -> DataFrame:
        """head, feature, share: of the first member of each head."""
        rows = [(h, f, float(v)) for h, m in self.heads.items() for f, v in m.importances().items()]
        return SparkSession.active().createDataFrame(rows, "head string, feature string, share double")

    def save(self, path: str) -> None:
        for name, head in self.heads.items():
            head.save(f"{path}/{name}")
        settings = {"features": self.features, "heads": list(self.heads), "widths": self.widths, "metrics": self.metrics, "gate": self.gate and self.gate.settings()}
        write_json(SparkSession.active(), settings, f"{path}/settings")

    @classmethod
    def load(cls, path: str) -> Predictors:
        s = read_json(SparkSession.active(), f"{path}/settings")
        gate = DistributionGate.of(s["gate"]) if s["gate"] else None
        return cls(s["features"], {n: CensoredRegressor.load(f"{path}/{n}") for n in s["heads"]}, gate, s["widths"], s["metrics"])

    def scorer(self, objective=None) -> Scorer:
        """A scorer of single sequences that needs no session: it can be sent to workers."""
        return Scorer(self.features, {n: [Trees.of(m) for m in h.models] for n, h in self.heads.items()}, self.gate, objective or {})


class Trees:
    """A boosted ensemble as arrays, for predictions without a session."""

    def __init__(self, trees: list[tuple[np.ndarray, ...]], weights: np.ndarray):
        self.trees, self.weights = trees, weights

    @classmethod
    def of(cls, model) -> Trees | boosting.Ensemble:
        if isinstance(model, boosting.Ensemble):
            return model
        out = []
        for tree in model.trees:
            nodes: list[tuple[int, float, int, int, float]] = []

            def walk(node) -> int:
                at = len(nodes)
                nodes.append((-1, 0.0, 0, 0, node.prediction()))
                if node.subtreeDepth() > 0:
                    split = node.split()
                    l, r = walk(node.leftChild()), walk(node.rightChild())
                    nodes[at] = (split.featureIndex(), split.threshold(), l, r, node.prediction())
                return at

            walk(tree._java_obj.rootNode())
            out.append(tuple(np.array(c) for c in zip(*nodes)))
        return cls(out, np.array(list(model.treeWeights)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for (feature, threshold, left, right, value), weight in zip(self.trees, self.weights):
            at = np.zeros(len(x), np.int64)
            while (open_ := np.flatnonzero(feature[at] >= 0)).size:
                now = at[open_]
                at[open_] = np.where(x[open_, feature[now]] <= threshold[now], left[now], right[now])
            total += weight * value[at]
        return total


class Scorer:
    """score(sequence, softness): the objective of a sequence from fitted heads, as the Columns give it; -inf where it isn't feasible or outside the gate."""

    def __init__(self, features: list[str], heads: dict[str, list[Trees]], gate: DistributionGate | None, objective: dict):
        self.features, self.heads, self.gate, self.objective = features, heads, gate, objective
        self.seen: dict[str, tuple | None] = {}

    def axes(self, s: str) -> tuple | None:
        """Values of the axes and what the soft windows read; null where the sequence is out."""
        from strandlake.functions import scales as S
        from strandlake.functions import vectors
        from strandlake.functions.objective import plain_axes

        if not S.MIN_LENGTH <= len(s) <= S.MAX_LENGTH or set(s) - set(S.ALPHABET):
            return None
        found = vectors.featurize([s])
        values = {k: float(v[0]) for k, v in found.items()}
        x = np.array([[values.get(f, 0.0) for f in self.features]])
        if self.gate is not None and not self.gate.passes(values):
            return None
        predicted = {HEADS[n]: np.array([t.predict(x)[0] for t in members]) for n, members in self.heads.items()}
        mean = {c: float(v.mean()) for c, v in predicted.items()}
        spread = {f"spread_{n}": float(predicted[HEADS[n]].std()) for n in self.heads}
        return plain_axes({HEADS[n]: DEFAULT for n in DEFAULTED} | mean | spread, values), values

    def __call__(self, s: str, softness: float = 1.0) -> float:
        from strandlake.functions.objective import plain_score

        if s not in self.seen:
            self.seen[s] = self.axes(s)
        got = self.seen[s]
        return -np.inf if got is None else plain_score(*got, softness=softness, **self.objective)


def quadratic(x: np.ndarray, mu: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """(x - mu)' inverse (x - mu) of each row, summed column by column: a row's result doesn't depend on its batch."""
    z = x - mu
    y, out = np.zeros_like(z), np.zeros(len(z))
    for j in range(z.shape[1]):
        y += z[:, j : j + 1] * inverse[j]
    for j in range(z.shape[1]):
        out += z[:, j] * y[:, j]
    return np.maximum(out, 0.0)


def inverse_of(cov: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(cov, hermitian=True)


def logdet(cov: np.ndarray) -> float:
    return float(np.linalg.slogdet(cov + 1e-9 * np.eye(len(cov)))[1])


def fast_mcd(x: np.ndarray, support: float = 0.85, starts: int = 30, seed: int = 0, best: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
    """The `best` centres and covariances of least determinant over subsets of a share `support`: concentration steps from random starts."""
    n, p = x.shape
    h = max(min(p + 1, n), int(np.ceil(support * n)))
    rng = np.random.default_rng(seed)
    found = {}
    for _ in range(starts):
        at = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(30):
            mu, cov = x[at].mean(0), np.cov(x[at].T, bias=True).reshape(p, p) + 1e-9 * np.eye(p)
            z = x - mu
            new = np.sort(np.argsort(((z @ inverse_of(cov)) * z).sum(axis=1), kind="stable")[:h])
            if np.array_equal(new, at):
                break
            at = new
        cov = np.cov(x[at].T, bias=True).reshape(p, p)
        found.setdefault(tuple(at), (logdet(cov), x[at].mean(0), cov))
    return [(mu, cov) for _, mu, cov in sorted(found.values(), key=lambda f: f[0])[:best]]


def gamma_share(a: float, x: float) -> float:
    """The share of Gamma(a, 1) up to x: a series below a + 1, a continued fraction above."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return min(1.0, scale * total)
    # Lentz's method
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        n = -i * (i - a)
        b += 2
        d = 1 / (n * d + b)
        c = b + n / c
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - scale * h


def chi_square_quantile(p: float, df: int) -> float:
    """The value below which a chi-square variable with df degrees of freedom stays with probability p."""
    lo, hi = 0.0, float(df)
    while gamma_share(df / 2, hi / 2) < p:
        lo, hi = hi, 2 * hi
    while hi - lo > 1e-12 * hi:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_share(df / 2, mid / 2) < p else (lo, mid)
    return (lo + hi) / 2


#: Share of a normal distribution that the reweighting step keeps.
REWEIGHTED = 0.975


class DistributionGate:
    """Passes rows whose robust distance from the fitted centre is within a quantile of the fitted rows' distances.

    Reweighted minimum covariance determinant over all finite rows. First the raw estimate: START_ROWS distinct rows only give the centres and covariances that the
    concentration steps start from. Then its covariance is multiplied by the factor that makes the median distance that of a normal distribution, and
    centre and covariance are estimated anew from all rows whose distance is below the chi-square quantile REWEIGHTED (`reweight=False` leaves this step out). Each step's
    cut (the distance of rank h), the median, means and covariances, as well as the dropped columns and the threshold, are aggregates over all rows. Of rows that stand at a
    step's cut, each counts with the share that fills h, so copies need no order. Without a finite row nothing passes; where no column varies, all rows have distance 0; where half
    the rows have distance 0, the raw estimate stays.
    """

    def __init__(self, features: list[str], level: float = 0.975, support: float = 0.85, reweight: bool = True):
        self.features, self.level, self.support, self.reweight = features, level, support, reweight

    def fit(self, df: DataFrame) -> DistributionGate:
        ok = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(self.features)]).dropna()
        rows = ok.select(F.array(*ok.columns).alias("x")).where(F.forall("x", lambda v: F.abs(v) < float("inf"))).persist()
        try:
            return self._fit(rows)
        finally:
            rows.unpersist()

    def _fit(self, rows: DataFrame) -> DistributionGate:
        spread = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("v").alias("n"), F.var_pop("v").alias("v"), F.avg("v").alias("m")).orderBy("i").collect()
        at = [r["i"] for r in spread if r["v"] > 1e-12]
        n, p = (spread[0]["n"] if spread else 0), len(at)
        self.kept, self.mu, self.inverse = [self.features[i] for i in at], np.zeros(p), np.zeros((p, p))
        self.threshold = 0.0 if n else -1.0
        if not p:
            return self
        middle, h = np.array([spread[i]["m"] for i in at]), max(min(p + 1, n), int(np.ceil(self.support * n)))
        first = rows.distinct().orderBy(F.xxhash64("x"), "x").limit(START_ROWS).collect()
        models = fast_mcd(np.array([r["x"] for r in first], float)[:, at], self.support, best=START_MODELS)
        done: list[tuple[float, np.ndarray, np.ndarray]] = []
        last = [np.inf] * len(models)
        for step in range(MOST_STEPS):
            shapes = [(mu, inverse_of(cov + 1e-9 * np.eye(p))) for mu, cov in models]
            cuts = [c[0] for c in ranked(rows, at, shapes, [h - 1] * len(shapes), n)]
            models = concentrated(rows, at, shapes, cuts, h, middle)
            det = [logdet(cov) for _, cov in models]
            over = [step == MOST_STEPS - 1 or d >= l - 1e-9 for d, l in zip(det, last)]
            done += [(d, *m) for d, m, o in zip(det, models, over) if o]
            models, last = [m for m, o in zip(models, over) if not o], [d for d, o in zip(det, over) if not o]
            if not models:
                break
        _, self.mu, cov = min(done, key=lambda d: d[0])
        self.inverse = inverse_of(cov)
        if self.reweight:
            raw = (self.mu, self.inverse)
            (a, _, _), (b, _, _) = ranked(rows, at, [raw] * 2, [(n - 1) // 2, n // 2], n)
            factor = (a + b) / 2 / chi_square_quantile(0.5, p)
            if factor > 0:
                inner = cut_sums(rows, at, [raw], [factor * chi_square_quantile(REWEIGHTED, p)], middle)[0][0]
                self.mu, cov = moments(inner, inner[0], middle)
                self.inverse = inverse_of(cov)
        place = (n - 1) * self.level
        lo, hi = int(np.floor(place)), int(np.ceil(place))
        shape = [(self.mu, self.inverse)] * 2
        (a, _, _), (b, _, _) = ranked(rows, at, shape, [lo, hi], n)
        self.threshold = float(a + (b - a) * (place - lo))
        return self

    def settings(self) -> dict:
        return {"features": self.features, "level": self.level, "support": self.support, "reweight": self.reweight, "kept": self.kept, "mu": self.mu.tolist(), "inverse": self.inverse.tolist(), "threshold": self.threshold}

    @classmethod
    def of(cls, s: dict) -> DistributionGate:
        out = cls(s["features"], s["level"], s["support"], s["reweight"])
        out.kept, out.mu, out.threshold = s["kept"], np.array(s["mu"], float), s["threshold"]
        out.inverse = np.array(s["inverse"], float).reshape(len(out.mu), len(out.mu))
        return out

    def save(self, path: str) -> None:
        write_json(SparkSession.active(), self.settings(), path)

    @classmethod
    def load(cls, path: str) -> DistributionGate:
        return cls.of(read_json(SparkSession.active(), path))

    def passes(self, values: dict[str, float]) -> bool:
        """Whether one row passes."""
        x = np.array([[values[f] for f in self.kept]], float).reshape(1, -1)
        return bool(np.isfinite(x).all() and (quadratic(x, self.mu, self.inverse)[0] if self.kept else 0.0) <= self.threshold)

    def apply(self, df: DataFrame) -> DataFrame:
        """distance (null where a kept column is null, NaN where one isn't finite) and in_distribution."""
        mu, inverse = self.mu, self.inverse

        def far(x: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, index=x.index, dtype=float)
            if len(x):
                m = np.array(x.tolist(), float).reshape(len(x), -1)
                with np.errstate(invalid="ignore", over="ignore"):
                    out[:] = np.where(np.isfinite(m).all(axis=1), quadratic(m, mu, inverse), np.nan)
            return out

        if not self.kept:
            distance = F.lit(0.0)
        else:
            x = F.array(*[F.col(f).cast("double") for f in self.kept])
            some = F.exists(x, lambda v: v.isNull())
            d = F.pandas_udf(far, "double")(F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan")))))
            distance = F.when(some, None).otherwise(F.coalesce(d, F.lit(float("nan"))))
        return df.withColumn("distance", distance).withColumn("in_distribution", F.coalesce(F.col("distance") <= self.threshold, F.lit(False)))


def _matrices(batches, at: list[int]):
    for b in batches:
        col = b.column(0)
        if len(col):
            x = col.flatten().to_numpy(zero_copy_only=False)
            yield x.reshape(len(col), -1)[:, at]


def ranked(rows: DataFrame, at: list[int], shapes: list, ranks: list[int], total: int | None = None) -> list[tuple[float, int, int]]:
    """For each shape its distance of that rank (from 0) over all rows (`total` of them, counted where it is not given), how many are smaller, and how many are equal: exact.

    Doubles that aren't negative order like their bits. Counts by leading bits narrow the rank's bin down by 16 bits a round, or to the
    distinct values at once where few rows are left in it.
    """
    total = rows.count() if total is None else total
    state = [{"prefix": 0, "shift": 64, "below": 0, "left": total} for _ in shapes]
    while any(s["shift"] for s in state):
        now = [(i, s["prefix"], s["shift"], 0 if s["left"] <= LISTED else s["shift"] - 16) for i, s in enumerate(state) if s["shift"]]

        def count(batches):
            for x in _matrices(batches, at):
                for i, prefix, old, new in now:
                    bits = quadratic(x, *shapes[i]).view(np.uint64)
                    if old < 64:
                        bits = bits[bits >> np.uint64(old) == np.uint64(prefix)]
                    key, n = np.unique(bits >> np.uint64(new), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i), pa.int32()), pa.array(key.astype(np.int64)), pa.array(n, pa.int64())], ["i", "key", "n"])

        got = rows.mapInArrow(count, "i int, key long, n long").groupBy("i", "key").agg(F.sum("n").alias("n")).toPandas().sort_values(["i", "key"])
        for i, _, _, new in now:
            mine, s = got[got["i"] == i], state[i]
            upto = s["below"] + mine["n"].cumsum().to_numpy()
            k = int(np.searchsorted(upto, ranks[i], side="right"))
            n = int(mine["n"].iloc[k])
            s.update(prefix=int(mine["key"].iloc[k]), shift=new, below=int(upto[k]) - n, left=n)
    return [(float(np.array([s["prefix"]], np.uint64).view(float)[0]), s["below"], s["left"]) for s in state]


def cut_sums(rows: DataFrame, at: list[int], shapes: list, cuts: list[float], middle: np.ndarray) -> np.ndarray:
    """For each shape, of the rows within its cut and of those at it: count, sums and products around `middle`; taken per task, and added on the driver."""
    p = len(at)

    def sums(batches):
        acc = np.zeros((len(shapes), 2, 1 + p + p * p))
        for x in _matrices(batches, at):
            for i, (shape, cut) in enumerate(zip(shapes, cuts)):
                d = quadratic(x, *shape)
                for k, some in enumerate((d < cut, d == cut)):
                    z = x[some] - middle
                    acc[i, k] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([acc.tobytes()], pa.binary())], ["acc"])

    total = np.zeros((len(shapes), 2, 1 + p + p * p))
    # one job (an iterator would run the partitions one after another), of at most MOST_SUMS rows
    for r in rows.coalesce(MOST_SUMS).mapInArrow(sums, "acc binary").collect():
        total += np.frombuffer(r["acc"]).reshape(total.shape)
    return total


def moments(t: np.ndarray, n: float, middle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance of n rows from their sums."""
    p = len(middle)
    m, prod = t[1 : p + 1] / n, t[p + 1 :].reshape(p, p) / n
    return middle + m, prod - np.outer(m, m)


def concentrated(rows: DataFrame, at: list[int], shapes: list, cuts: list[float], h: int, middle: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Centre and covariance of each shape's h nearest rows."""
    return [moments(inner + edge * ((h - inner[0]) / max(edge[0], 1.0)), h, middle) for inner, edge in cut_sums(rows, at, shapes, cuts, middle)]
