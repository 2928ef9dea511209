"""Local refinement by annealing, and a conditional n-gram generator (a declared substitute for a neural sampler)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import scales as S
from strandlake.functions import tokens
from strandlake.functions.cleaning import library_feasible

LETTERS = S.ALPHABET.replace(S.FORBIDDEN, "")
# Residues that a class is refilled from, the moves' shares, and the share of the usual pool on and off the face.
POOLS = {"cationic": "KR", "hydrophobic": "AILMFVW", "polar": "GNQST", "anionic": "DE"}
MOVES = {"same_class": 0.40, "face": 0.30, "swap": 0.15, "indel": 0.08, "terminal": 0.07}
USUAL = 0.7
_H = np.zeros(128)
for _a, _v in S.EISENBERG.items():
    _H[ord(_a)] = _v


def feasible(s: str) -> bool:
    return S.TOP_MIN_LENGTH <= len(s) <= S.TOP_MAX_LENGTH and not set(s) - set(LETTERS)


def on_face(position: int, centre: float, half: float = 90.0) -> bool:
    """Whether a position's wheel angle is within `half` degrees of the face's centre."""
    return abs((tokens.wheel_angle(position) - centre + 180) % 360 - 180) <= half


def face_centre(s: str) -> float:
    """Circular mean of the hydrophobic residues' wheel angles, in degrees; 0 without any."""
    a = np.radians([tokens.wheel_angle(i) for i, c in enumerate(s) if c in S.HYDROPHOBIC])
    return float(np.degrees(np.arctan2(np.sin(a).sum(), np.cos(a).sum())) % 360) if len(a) else 0.0


class Mutator:
    """Random moves that keep the rules, so nothing infeasible is proposed; a move that has no room gives the sequence back.

    same_class: another residue of the same class. face: on the hydrophobic face a hydrophobic residue (a polar or cationic one in 3 of 10 cases), off it
    a cationic one (a polar one in 3 of 10). swap: two places change residues. indel: one residue more or less anywhere. terminal: one more or less at an end.
    """

    def __init__(self, least: int = S.TOP_MIN_LENGTH, most: int = S.TOP_MAX_LENGTH, shares: dict[str, float] = MOVES):
        self.least, self.most = least, most
        self.names, self.shares = list(shares), np.array(list(shares.values())) / sum(shares.values())

    def __call__(self, s: str, rng: np.random.Generator) -> str:
        return getattr(self, self.names[rng.choice(len(self.names), p=self.shares)])(s, rng)

    @staticmethod
    def put(s: str, i: int, pool: str, rng: np.random.Generator) -> str:
        others = pool.replace(s[i], "")
        return s[:i] + others[rng.integers(len(others))] + s[i + 1 :] if others else s

    def same_class(self, s: str, rng: np.random.Generator) -> str:
        i = rng.integers(len(s))
        return self.put(s, i, POOLS[tokens.residue_class(s[i])], rng)

    def face(self, s: str, rng: np.random.Generator) -> str:
        i, usual = rng.integers(len(s)), rng.random() < USUAL
        if on_face(int(i), face_centre(s)):
            return self.put(s, i, POOLS["hydrophobic"] if usual else POOLS["polar"] + POOLS["cationic"], rng)
        return self.put(s, i, POOLS["cationic" if usual else "polar"], rng)

    def swap(self, s: str, rng: np.random.Generator) -> str:
        if len(s) < 2:
            return s
        i, j = sorted(rng.permutation(len(s))[:2].tolist())
        return s[:i] + s[j] + s[i + 1 : j] + s[i] + s[j + 1 :]

    def _resize(self, s: str, rng: np.random.Generator, place: Callable[[int], int]) -> str:
        """One residue less (half of the times, while there is room), else one more, where `place` says."""
        if rng.random() < 0.5 and len(s) > self.least:
            i = place(len(s) - 1)
            return s[:i] + s[i + 1 :]
        if len(s) >= self.most:
            return s
        i = place(len(s))
        return s[:i] + LETTERS[rng.integers(len(LETTERS))] + s[i:]

    def indel(self, s: str, rng: np.random.Generator) -> str:
        return self._resize(s, rng, lambda last: int(rng.integers(last + 1)))

    def terminal(self, s: str, rng: np.random.Generator) -> str:
        return self._resize(s, rng, lambda last: last * int(rng.integers(2)))


def rule_score(s: str, softness: float = 1.0) -> float:
    """Moment, charge and hydrophobicity within soft windows: a stand-in objective that needs no model; -inf where not feasible."""
    if not feasible(s):
        return -math.inf
    h = _H[np.frombuffer(s.encode(), np.uint8)]
    n = len(s)
    moment = abs((h * np.exp(1j * np.radians(S.HELIX_DEGREES) * np.arange(n))).sum()) / n
    charge = sum(s.count(c) for c in "KR") - sum(s.count(c) for c in "DE")
    soft = lambda x, lo, hi, w: math.exp(-((max(lo - x, x - hi, 0.0) / max(w, 1e-6)) ** 2))
    return float(min(moment, 1.0) * soft(charge, *S.WINDOWS["net_charge"], 0.5 * softness) * soft(h.mean(), *S.WINDOWS["mean_hydrophobicity"], 0.5 * softness))


class Chain:
    """What a chain found: its best state and that state's score when it was taken, moves taken, and all finite proposals in order."""

    def __init__(self, best: str, score: float):
        self.best, self.score, self.taken, self.visited = best, score, 0, {}


def anneal(start: str, seed: int, steps: int = 400, hot: float = 0.06, cold: float = 0.002, soft: tuple[float, float] = (2.0, 0.4), score=rule_score, move: Mutator | None = None) -> Chain:
    """Metropolis steps; temperature and softness of the windows fall geometrically. score(sequence, softness) is -inf where not feasible."""
    rng, move = np.random.default_rng(seed), move or Mutator()
    memo: dict[tuple[str, str], float] = {}

    def value(x: str, softness: float) -> float:
        key = x, f"{softness:.3f}"
        if key not in memo:
            memo[key] = score(x, softness)
        return memo[key]

    now, v = start, value(start, soft[0])
    chain = Chain(start, v)
    for k in range(steps):
        f = k / max(steps - 1, 1)
        temperature, softness = hot * (cold / hot) ** f, soft[0] * (soft[1] / soft[0]) ** f
        t = move(now, rng)
        if t == now:
            continue
        w = value(t, softness)
        if math.isfinite(w):
            chain.visited[t] = None
        if w >= v or (math.isfinite(w) and math.isfinite(v) and rng.random() < math.exp((w - v) / temperature)):
            now, v = t, w
            chain.taken += 1
            if v > chain.score:
                chain.best, chain.score = now, v
    return chain


def refine(df: DataFrame, steps: int = 400, seed: int = 42, score=rule_score) -> DataFrame:
    """chain, place, s, score, best, taken: the states of one chain a row of df (ord: its number from 0, s), with scores at softness 1.

    place 0 is the best state; the others follow in the order of their proposals. Chains are independent and seeded by their number, so any
    partitioning gives equal results.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for o, s in zip(p["ord"], p["s"]):
                got = anneal(s, seed + 1000 * (int(o) + 1), steps, score=score)
                states = [got.best] * math.isfinite(got.score) + [x for x in got.visited if x != got.best]
                rows += [(int(o), i, x, float(score(x, 1.0)), i == 0 and x == got.best, got.taken) for i, x in enumerate(states)]
            yield pd.DataFrame(rows, columns=["chain", "place", "s", "score", "best", "taken"])

    return df.select("ord", "s").mapInPandas(run, "chain long, place long, s string, score double, best boolean, taken long")


# ---- sampler


def ngram_model(df: DataFrame, order: int = 2, conditions: tuple[str, ...] = ()) -> DataFrame:
    """condition, context, next, n, p, upto: next residue (or '$') given the last `order` residues ('^' before the start), with cumulative shares in order of p.

    conditions: columns of df whose values, as text joined by '|', are counted apart; the empty condition counts all rows.
    """
    padded = F.concat(F.lit("^" * order), F.col("s"), F.lit("$"))
    own = F.concat_ws("|", *[F.col(c).cast("string") for c in conditions]) if conditions else F.lit("")
    kinds = F.explode(F.array(F.lit(""), own) if conditions else F.array(F.lit(""))).alias("condition")
    grams = df.select(own.alias("own"), F.explode(F.transform(F.sequence(F.lit(1), F.length("s") + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))).alias("g"), *conditions)
    counts = grams.select(kinds, "g").groupBy("condition", F.substring("g", 1, order).alias("context"), F.substring("g", order + 1, 1).alias("next")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("condition", "context")
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(w))
    return p.withColumn("upto", F.sum("p").over(w.orderBy(F.desc("p"), "next").rowsBetween(Window.unboundedPreceding, 0))).select("condition", "context", "next", "n", "p", "upto")


def heated(options: list[tuple[str, float]], temperature: float) -> list[tuple[str, float]]:
    """Shares to the power 1 / temperature, scaled to 1, the largest first."""
    raised = [(c, p ** (1 / max(temperature, 1e-6))) for c, p in options]
    total = sum(p for _, p in raised)
    return sorted(((c, p / total) for c, p in raised), key=lambda o: (-o[1], o[0]))


def sample(model: dict[str, list[tuple[str, float]]], key: str, top_p: float = 0.95, least: int = S.MIN_LENGTH, most: int = S.MAX_LENGTH, order: int = 2, temperature: float = 1.0) -> str:
    """A sequence from hash draws: the smallest set of next residues whose share reaches top_p (the one that crosses it stays); no end before `least`."""
    s = ""
    while len(s) < most:
        options = model.get(("^" * order + s)[-order:], [("$", 1.0)])
        open_ = [o for o in options if o[0] != "$" or len(s) >= least]
        if not open_:
            break
        kept, total = [], 0.0
        for c, p in heated(open_, temperature):
            kept.append((c, p))
            total += p
            if total > top_p:
                break
        u = int.from_bytes(hashlib.blake2b(f"{key}:{len(s)}".encode(), digest_size=8).digest(), "big") / 2**64 * total
        for c, p in kept:
            u -= p
            if u < 0:
                break
        if c == "$":
            break
        s += c
    return s


def draws(df_model: DataFrame, jobs: list[tuple[int, str, float, int]], top_p: float = 0.95, order: int = 2, least: int = S.MIN_LENGTH, most: int = S.MAX_LENGTH) -> DataFrame:
    """ord, s for each job's draws, one job after another. jobs: (draws, condition, temperature, seed). A condition that was never seen falls back on all rows.

    The model has at most 21^order contexts a condition, so it is small whatever the input.
    """
    model: dict[str, dict[str, list[tuple[str, float]]]] = {}
    for r in df_model.orderBy("condition", "context", F.desc("p"), "next").collect():
        model.setdefault(r["condition"], {}).setdefault(r["context"], []).append((r["next"], r["p"]))
    starts = np.concatenate([[0], np.cumsum([j[0] for j in jobs])])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for i in p["id"].tolist():
                k = int(np.searchsorted(starts, i, side="right")) - 1
                _, condition, temperature, seed = jobs[k]
                own = model.get(condition) or model.get("", {})
                out.append((i, sample(own, f"{seed}:{i - int(starts[k])}", top_p, least, most, order, temperature)))
            yield pd.DataFrame(out, columns=["ord", "s"])

    return df_model.sparkSession.range(int(starts[-1])).mapInPandas(run, "ord long, s string")


#: The grid that a pool is spread over, the temperature of what is drawn in addition, and how often in a row that may bring nothing new.
CHARGES, TEMPERATURES, LATE_TEMPERATURE, STALLS = (2.0, 4.0, 6.0, 8.0, 10.0), (0.9, 1.0, 1.15), 1.2, 12


def sample_pool(seqs: DataFrame, n: int, seed: int = 0, top_p: float = 0.95, order: int = 2, charge: str | None = None, source: str | None = None, save=lambda df: df.persist()) -> DataFrame:
    """ord, s: about n distinct sequences that keep the library's rules, in order of their draws.

    Draws are spread over CHARGES (as conditions, where `charge` names a column of net charges) and TEMPERATURES; of `source`, rows of false are followed. What is
    missing is drawn in rounds at LATE_TEMPERATURE, until STALLS rounds in a row bring nothing new. `save` keeps a round's rows.
    """
    rows, names = seqs.select("s"), []
    if charge:
        extra = [F.coalesce(F.col(source).cast("boolean"), F.lit(False)).alias("_source")] if source else [F.lit(False).alias("_source")]
        rows, names = seqs.select("s", tokens.charge_bucket(F.col(charge)).alias("_charge"), *extra), ["_charge", "_source"]
    model = save(ngram_model(rows, order, tuple(names)))
    of = lambda c: f"{tokens.charge_token(c) - tokens.CONDITIONS}|false" if charge else ""
    grid = [(c, t) for c in CHARGES for t in TEMPERATURES]
    jobs = [(-(-n // len(grid)), of(c), t, seed + k) for k, (c, t) in enumerate(grid)]
    # draws depend on their job and number alone: a round makes them all anew rather than build on the rows of the round before
    distinct = lambda: draws(model, jobs, top_p, order).where(library_feasible(F.col("s"))).groupBy("s").agg(F.min("ord").alias("ord")).select("ord", "s")
    pool = save(distinct())
    have, stalls = pool.count(), 0
    while have < n and stalls < STALLS:
        jobs.append((n - have, of(6.0), LATE_TEMPERATURE, seed + 5_000 + len(jobs)))
        pool.unpersist()
        pool = save(distinct())
        now = pool.count()
        stalls, have = (stalls + 1 if now == have else 0), now
    return pool
