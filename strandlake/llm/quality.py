"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features. Preference pairs set a document of label
1 against one of label 0; the weights minimise the logistic loss of the difference of their features.
The cut is a quantile of the strengths of the labelled rows: the share of label 0 among them. The
score is a logistic curve through the cut, so that score >= 0.3 says the same as strength >= cut.

Learning sees a bounded sample (`max_train`, by a hash of the id) of labelled rows; scoring reads every
row's whole text, in one pass without shuffle.

Cases: null and empty texts have all features of an empty text, and a score; repeated rows get equal
scores; labels other than 0 and 1 and null labels are ignored; with no labels of one kind all strengths
are 0 and every score is 0.5; a very long text is read
whole, in one task's memory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.kernels import Words, row_slices, slices

MAX_TRAIN = 20_000
PAIRS = 200_000
FOLDS = 5
THRESHOLD = 0.3
_EXTRA = ("log_words", "log_bytes", "mean_word", "deviation_word", "long_words", "same_as_before", "same_as_second", "distinct", "marked_words", "lines", "distinct_lines", "sentences", "capitals", "joined")
N_FEATURES = 128 + len(_EXTRA)


def features(raws: list[bytes]) -> np.ndarray:
    """A row for each text: roots of the shares of ASCII bytes, then word and line statistics."""
    n = len(raws)
    out = np.zeros((n, N_FEATURES), np.float32)
    if not n:
        return out
    w = Words(raws)
    h, width = w.hashes(), (w.end - w.start).astype(np.float64)
    last = w.buf[w.end - 1] if len(w.end) else w.buf[:0]
    before = np.zeros(len(h), bool)
    before[1:] = (h[1:] == h[:-1]) & (w.doc[1:] == w.doc[:-1])
    second = np.zeros(len(h), bool)
    second[2:] = (h[2:] == h[:-2]) & (w.doc[2:] == w.doc[:-2])
    marked = np.isin(last, np.frombuffer(b"#%$*&|@^~=<>", np.uint8))
    stops = np.isin(last, np.frombuffer(b".!?", np.uint8))
    heads = w.buf[w.start] if len(w.start) else w.buf[:0]
    total = lambda x: np.bincount(w.doc, x, n)
    count = total(np.ones(len(h)))
    per = np.maximum(count, 1)
    mean = total(width) / per
    out[:, 128] = np.log1p(count)
    out[:, 129] = np.log1p([len(r) for r in raws])
    out[:, 130] = mean
    out[:, 131] = np.sqrt(np.maximum(total(width**2) / per - mean**2, 0))
    out[:, 132] = total(width > 20) / per
    out[:, 133] = total(before) / per
    out[:, 134] = total(second) / per
    order = np.lexsort((h, w.doc))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (w.doc[order][1:] != w.doc[order][:-1])
    # of texts of n words about sqrt(n) fewer are distinct anyway: put it on the scale of the root
    out[:, 135] = np.log(np.maximum(np.bincount(w.doc[order], fresh, n), 1)) / np.maximum(np.log(per), 1)
    out[:, 136] = total(marked) / per
    out[:, 139] = total(stops) / per
    out[:, 140] = total((heads >= 65) & (heads <= 90)) / per
    out[:, 141] = total(width == 1) / per
    for i, r in enumerate(raws):
        if r:
            seen = np.bincount(np.frombuffer(r, np.uint8), minlength=256)
            out[i, :128] = np.sqrt(seen[:128] / len(r))
            lines = r.split(b"\n")
            out[i, 137] = np.log1p(len(lines)) / np.log1p(count[i] + 1)
            out[i, 138] = len(set(lines)) / len(lines)
    return out


class BradleyTerry:
    """Weights, the scaling of the features, the cut and the slope of the score."""

    def __init__(self, weights=None, mean=None, scale=None, cut: float = 0.0, slope: float = 1.0):
        self.weights = np.zeros(N_FEATURES) if weights is None else weights
        self.mean = np.zeros(N_FEATURES) if mean is None else mean
        self.scale = np.ones(N_FEATURES) if scale is None else scale
        self.cut, self.slope, self.fitted = cut, slope, weights is not None

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        z = self.slope * (self.strength(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 7, ridge: float = 1e-4) -> BradleyTerry:
    """Learn from features and labels 0 or 1."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return BradleyTerry()
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    z = np.clip((x - mean) / np.where(scale > 1e-9, scale, 1), -8, 8).astype(np.float32)
    i, j = rng.choice(good, pairs), rng.choice(bad, pairs)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    size = 4096
    for t in range(1, steps + 1):
        at = rng.integers(0, pairs, size)
        gap = z[i[at]] - z[j[at]]
        lose = 1 / (1 + np.exp(np.clip(gap @ w, -40, 40)))
        g = -(lose[:, None] * gap).mean(0) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model = BradleyTerry(w, mean, np.where(scale > 1e-9, scale, 1))
    s = model.strength(x)
    model.cut = float(np.quantile(s, len(bad) / len(y)))
    model.slope = float(min(4.0, 6.0 / max(s.std(), 1e-6)))
    return model


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves no remainder by FOLDS."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> BradleyTerry:
    """Fit on at most max_train labelled rows outside the held-out fold; features are made on the executors."""
    chosen = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out("doc_id"))
        .groupBy("doc_id").agg(F.min("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    )
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, raws in row_slices(batches):
            x = features(raws)
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    got = rows.mapInArrow(run, "y int, x binary").toArrow()
    y = np.array(got.column("y").to_pylist(), int)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(len(y), N_FEATURES)
    order = np.lexsort((*x.T[128:131], y))  # so that the fit doesn't depend on the order of tasks
    return fit(x[order], y[order])


def score(df: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in row_slices(batches):
            s = model.score(features(raws))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def keep_good(df: DataFrame, model: BradleyTerry, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, with all their columns, that score at least the threshold; one pass, no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                keep = []
                for _, raws in slices(range(part.num_rows), part.column(at).to_pylist()):
                    keep.append(model.score(features(raws)) >= threshold)
                yield part.filter(pa.array(np.concatenate(keep)))

    return df.mapInArrow(run, df.schema)
