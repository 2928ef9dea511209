"""Gradient-boosted trees over histograms, one ensemble a task.

Columns are cut into at most BINS bins once. A tree draws its rows and columns, and is grown level by level: the gradients of a node are summed into a histogram a column,
in which every cut's gain is found; of two siblings the larger one's is the difference. Ensembles are fitted in tasks of their own, all at the same time: Spark deals each one a copy of
the training rows, of MOST_CELLS values at most. More are never sampled: such tables are what pyspark.ml's trees are for (`engine="spark"` of the operators that use this).

Rows are put in the order of their values first, so an ensemble depends on its seed and the rows alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of a column, rows of a leaf at least, and values (rows by columns, 8 bytes each) that a task takes.
BINS, LEAST_ROWS, MOST_CELLS = 255, 20, 40_000_000


class Ensemble:
    """A start value and trees (feature, threshold, left, right, value) as arrays; a feature of -1 is a leaf. Values hold the step."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, ...]]):
        self.start, nodes = start, max((len(t[0]) for t in trees), default=0)
        # a row a tree, padded by leaves that nothing leads to
        pad = lambda c, other: np.array([np.append(t[c], np.full(nodes - len(t[c]), other)) for t in trees], type(other)).reshape(len(trees), nodes)
        self.wide = pad(0, -1), pad(1, 0.0), pad(2, 0), pad(3, 0), pad(4, 0.0)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All trees are walked together, some rows at a time."""
        feature, threshold, left, right, value = self.wide
        if not len(feature):
            return np.full(len(x), self.start)
        tree, out = np.arange(len(feature)), np.empty(len(x))
        for lo in range(0, len(x), 512):
            part = x[lo : lo + 512]
            rows, at = np.arange(len(part))[:, None], np.zeros((len(part), len(tree)), np.int64)
            while (open_ := (f := feature[tree, at]) >= 0).any():
                at = np.where(open_, np.where(part[rows, f] <= threshold[tree, at], left[tree, at], right[tree, at]), at)
            out[lo : lo + 512] = self.start + value[tree, at].sum(axis=1)
        return out

    def shares(self, columns: int) -> np.ndarray:
        """Each column's share of the splits."""
        feature = self.wide[0]
        n = np.bincount(feature[feature >= 0], minlength=columns)
        return n / max(n.sum(), 1)

    def to_json(self) -> str:
        return json.dumps({"start": self.start, "trees": [c.tolist() for c in self.wide]})

    @classmethod
    def of_json(cls, text: str) -> Ensemble:
        d = json.loads(text)
        return cls(d["start"], [tuple(np.array(c) for c in t) for t in zip(*d["trees"])])


def cuts(column: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between the bins: midpoints of neighbouring values, or of those at even ranks where there are more."""
    values = np.unique(column)
    if len(values) > bins:
        ranked = np.sort(column)
        values = np.unique(ranked[np.linspace(0, len(ranked) - 1, bins).astype(np.int64)])
    return (values[:-1] + values[1:]) / 2


def boost(x: np.ndarray, y: np.ndarray, seed: int, trees: int, depth: int = 3, step: float = 0.05, rows: float = 0.8, columns: float = 0.8, loss: str = "squares", least: int = LEAST_ROWS) -> Ensemble:
    """Trees for the squared loss, or (loss='logistic', y of 0 and 1) for the log-odds."""
    n, p = x.shape
    rng = np.random.default_rng(seed)
    edges = [cuts(x[:, j]) for j in range(p)]
    width = max((len(e) for e in edges), default=0) + 1
    codes = [np.searchsorted(e, x[:, j], side="left").astype(np.uint8 if width <= 256 else np.int32) for j, e in enumerate(edges)]
    logistic = loss == "logistic"
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if logistic and n else 0.5
    start = float(np.log(share / (1 - share))) if logistic else float(y.mean()) if n else 0.0
    now, out = np.full(n, start), []
    for _ in range(trees if n else 0):
        prob = 1 / (1 + np.exp(-now)) if logistic else None
        g, h = (y - prob, prob * (1 - prob)) if logistic else (y - now, None)
        drawn = np.zeros(n, bool)
        drawn[rng.permutation(n)[: max(1, round(rows * n))]] = True
        some = np.sort(rng.permutation(p)[: max(1, round(columns * p))])
        tree, leaves = _grow(codes, g, h, drawn, some, edges, width, depth, step, least)
        out.append(tree)
        for node, at in leaves:
            now[at] += tree[4][node]
    return Ensemble(start, out)


def _whole(v: np.ndarray, most: float) -> tuple[np.ndarray, float]:
    """v in whole steps of which the largest value has at most `most`, and the step: sums of whole numbers are exact in any order, so a node's histogram is its parent's less its sibling's."""
    largest = float(np.abs(v).max(initial=0.0))
    unit = 2.0 ** np.ceil(np.log2(largest / most)) if largest > 0 else 1.0
    return np.rint(v / unit), unit


def _grow(codes: list[np.ndarray], g: np.ndarray, h: np.ndarray | None, drawn: np.ndarray, some: np.ndarray, edges: list[np.ndarray], width: int, depth: int, step: float, least: int) -> tuple[tuple[np.ndarray, ...], list]:
    """A tree and its leaves' rows (None: all), drawn or not. h: null where each row weighs 1.

    Histograms hold rows and gradients in one number, rows in its upper digits; values of nodes come from the gradients themselves.
    """
    n = len(g)
    own, mass = np.where(drawn, g, 0.0), drawn.astype(float) if h is None else np.where(drawn, h, 0.0)
    shift = 2.0 ** (52 - int(n).bit_length())
    packed, unit = _whole(own, shift / 4 / n)
    packed = np.where(drawn, packed + shift, 0.0)
    weights, hess_unit = [packed], 1.0
    if h is not None:
        whole, hess_unit = _whole(mass, 2.0**52 / n)
        weights.append(whole)

    def histogram(at):
        out = np.empty((len(weights), len(some), width))
        part = weights if at is None else [w[at] for w in weights]
        for k, c in enumerate(some.tolist()):
            keys = codes[c] if at is None else codes[c][at]
            for i, w in enumerate(part):
                out[i, k] = np.bincount(keys, w, width)
        return out

    def best_cut(hist):
        """(gain, column's place, bin), or null."""
        upto = np.cumsum(hist, axis=2)
        total = np.floor(upto[0, :1, -1:] / shift + 0.5)
        nl = np.floor(upto[0, :, :-1] / shift + 0.5)
        gl, gt = (upto[0, :, :-1] - nl * shift) * unit, (upto[0, :1, -1:] - total * shift) * unit
        hl, ht = (nl, total) if h is None else (upto[1, :, :-1] * hess_unit, upto[1, :1, -1:] * hess_unit)
        nr, hr, gr = total - nl, ht - hl, gt - gl
        fine = (nl >= least) & (nr >= least) & (hl > 1e-12) & (hr > 1e-12)
        if not fine.any():
            return None
        gain = np.where(fine, gl**2 / np.maximum(hl, 1e-12) + gr**2 / np.maximum(hr, 1e-12) - gt**2 / np.maximum(ht, 1e-12), 0.0)
        place = int(gain.argmax())
        return None if gain.flat[place] <= 1e-12 else divmod(place, width - 1)

    value_of = lambda at: float((own if at is None else own[at]).sum() / max((mass if at is None else mass[at]).sum(), 1e-12)) * step
    feature, threshold, left, right, value = [-1], [0.0], [0], [0], [value_of(None)]
    open_, leaves = [(0, None, histogram(None))] if depth and width > 1 and len(some) else [], []
    if not open_:
        leaves.append((0, slice(None)))
    for level in range(depth):
        nxt = []
        for node, at, hist in open_:
            cut = best_cut(hist)
            if cut is None:
                leaves.append((node, slice(None) if at is None else at))
                continue
            column, bin_ = int(some[cut[0]]), cut[1]
            over = (codes[column] if at is None else codes[column][at]) > bin_
            sides = [np.flatnonzero(~over), np.flatnonzero(over)] if at is None else [at[~over], at[over]]
            feature[node], threshold[node], left[node], right[node] = column, float(edges[column][bin_]), len(feature), len(feature) + 1
            children = []
            for rows in sides:
                children.append(len(feature))
                for field, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, value_of(rows))):
                    field.append(v)
            if level == depth - 1:
                leaves += zip(children, sides)
                continue
            small = int(len(sides[1]) < len(sides[0]))
            one = histogram(sides[small])
            hists = (one, hist - one) if small == 0 else (hist - one, one)
            nxt += [(c, rows, x) for c, rows, x in zip(children, sides, hists)]
        open_ = nxt
    return (np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value)), leaves


def imputed(x: np.ndarray, bound: np.ndarray, right: np.ndarray, rounds: int, **settings) -> Ensemble:
    """The last of `rounds` ensembles; after each, the target of a lower bound becomes max(bound, prediction)."""
    target, model = bound.copy(), None
    for _ in range(rounds):
        model = boost(x, target, **settings)
        target[right] = np.maximum(bound[right], model.predict(x[right]))
    return model


def _matrix(values: pd.Series, columns: int) -> np.ndarray:
    return np.array(values.tolist(), float).reshape(len(values), columns)


def most_rows(columns: int) -> int:
    """Training rows that a task takes."""
    return MOST_CELLS // max(columns, 1)


def fit_members(rows: DataFrame, columns: int, members: list[tuple[int, int]], fit, most: int | None = None) -> list[Ensemble]:
    """Ensembles for members (number, seed), each in a task of its own. rows: x (array<double>), y, mark (int).

    fit(x, y, mark, number, seed) gives an Ensemble; it runs in the tasks."""
    n, most = rows.count(), most_rows(columns) if most is None else most
    if n > most:
        raise ValueError(f"{n} training rows; a task takes {most}. Fit with engine='spark'")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(i).alias("member"), F.lit(s).alias("seed")) for k, (i, s) in enumerate(members)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        member, seed = held[0].column("member")[0].as_py(), held[0].column("seed")[0].as_py()
        x = np.concatenate([b.column("x").flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(-1, columns) if columns else np.empty((sum(b.num_rows for b in held), 0))
        y, mark = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("y", "mark"))
        held.clear()
        order = np.lexsort((mark, y, *x.T[::-1]))
        model = fit(x[order], y[order].astype(float), mark[order].astype(np.int64), member, seed)
        yield pa.RecordBatch.from_arrays([pa.array([member], pa.int32()), pa.array([model.to_json()])], ["member", "model"])

    # a partition a member: by hash, two could meet in one
    dealt = rows.select("x", "y", "mark", each.alias("m")).select("x", "y", "mark", "m.place", "m.member", "m.seed").repartitionById(len(members), F.col("place"))
    got = {r["member"]: r["model"] for r in dealt.drop("place").mapInArrow(run, "member int, model string").collect()}
    return [Ensemble.of_json(got[i]) if i in got else Ensemble(0.0, []) for i, _ in members]


def predicted(models: list[Ensemble], x: Column, columns: int) -> Column:
    """Array of the models' predictions."""

    def run(values: pd.Series) -> pd.Series:
        m = _matrix(values, columns)
        return pd.Series(list(np.stack([e.predict(m) for e in models], axis=1)) if len(m) else [], index=values.index, dtype=object)

    return F.pandas_udf(run, "array<double>")(x)
