"""Similarity of sequences: 2 LCS / (|a| + |b|), best references with exact pruning, block joins of short lists, and leader clusters.

LCS is computed bit-parallel over whole Arrow batches: one 64-bit word a pair, one step a residue. Candidates stay where they are: each task
compares its batches with one reference after another, after two exact upper bounds, the lengths and the letters that both have. No
pairs are stored or shuffled, and work is split by candidates, not by a join key. References are sent to the tasks in parts of at most about
BROADCAST_ROWS.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.scales import ALPHABET

#: Most reference rows (of at most 64 residues each) that are broadcast.
BROADCAST_ROWS = 100_000
#: Sequences that a round of leader clustering decides at least.
BLOCK_ROWS = 2_000


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """LCS of each pair; a's strings have at most 63 residues."""
    n = len(a)
    masks = np.zeros((n, 27), np.uint64)
    wide = max((len(x) for x in a), default=0)
    code = lambda s, w: np.frombuffer(b"".join(x.encode().ljust(w, b"[") for x in s), np.uint8).reshape(len(s), w) - 65 if w else np.zeros((len(s), 0), np.uint8)
    ca, rows = code(a, wide), np.arange(n)
    for i in range(wide):
        masks[rows, ca[:, i]] |= np.uint64(1 << i)
    masks[:, 26] = 0
    size = np.fromiter(map(len, a), np.int64, n)
    full = (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1)
    v = full.copy()
    wide_b = max((len(x) for x in b), default=0)
    cb = code(b, wide_b)
    for j in range(wide_b):
        m = masks[rows, cb[:, j]]
        u = v & m
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & full).astype(np.int64)


def _lcs(a: pd.Series, b: pd.Series) -> pd.Series:
    ok = a.notna() & b.notna()
    out = pd.Series(np.nan, index=a.index)
    if ok.any():
        out[ok] = lcs_lengths(a[ok].tolist(), b[ok].tolist())
    return out.astype("Int32")


def lcs(a: Column, b: Column) -> Column:
    """Longest common subsequence, where both are given."""
    return F.pandas_udf(_lcs, "int")(a, b)


def ratio(a: Column, b: Column) -> Column:
    return F.when(F.length(a) + F.length(b) == 0, 1.0).otherwise(2.0 * lcs(a, b) / (F.length(a) + F.length(b)))


def block_pairs(df: DataFrame, blocks: int = 8) -> DataFrame:
    """l_ord, l_s, r_ord, r_s, ratio of all pairs of a short list (ord, s) with l_ord < r_ord: blocks of rows meet by an equi-join on the pair of their numbers."""
    rows = df.select("ord", "s", F.pmod(F.xxhash64("ord", "s"), F.lit(blocks)).cast("int").alias("b"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    l = rows.select(F.col("ord").alias("l_ord"), F.col("s").alias("l_s"), F.col("b").alias("i"), every).withColumnRenamed("other", "j")
    r = rows.select(F.col("ord").alias("r_ord"), F.col("s").alias("r_s"), F.col("b").alias("j"), every).withColumnRenamed("other", "i")
    return l.join(r, ["i", "j"]).where("l_ord < r_ord").select("l_ord", "l_s", "r_ord", "r_s", ratio(F.col("l_s"), F.col("r_s")).alias("ratio"))


def distinct_first(df: DataFrame) -> DataFrame:
    """Each sequence once, at its first ord."""
    return df.groupBy("s").agg(F.min("ord").alias("ord"))


def novel(candidates: DataFrame, refs: DataFrame, t: float = 0.8) -> DataFrame:
    """Candidates without a reference of ratio >= t (inclusive). Comparison is by distinct sequence."""
    near = best_references(candidates.select("s").distinct(), refs, t).select(F.col("l_s").alias("s")).distinct()
    return candidates.join(near, "s", "left_anti")


def closest(candidates: DataFrame, refs: DataFrame, t: float = 0.0) -> DataFrame:
    """ord, s, ref, identity: each candidate's best reference of ratio >= t, the first one on ties; null and 0 where there is none."""
    hits = best_references(candidates.select("s").distinct(), refs, t)
    return candidates.join(hits, candidates.s == hits.l_s, "left").select("ord", "s", F.col("r_s").alias("ref"), F.coalesce("ratio", F.lit(0.0)).alias("identity"))


def code_table(seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit masks of each letter's places (letters x sequences), full words, and lengths; sequences have at most 63 residues."""
    size = np.fromiter(map(len, seqs), np.int64, len(seqs))
    masks = np.zeros((26, len(seqs)), np.uint64)
    wide = int(size.max(initial=0))
    codes = np.frombuffer(b"".join(x.encode().ljust(wide, b"[") for x in seqs), np.uint8).reshape(len(seqs), wide) - 65 if wide else np.zeros((len(seqs), 0), np.uint8)
    for i in range(wide):
        at = np.flatnonzero(codes[:, i] < 26)
        masks[codes[at, i], at] |= np.uint64(1 << i)
    return masks, (np.uint64(1) << size.astype(np.uint64)) - np.uint64(1), size


def ratios_to(table: tuple[np.ndarray, np.ndarray, np.ndarray], s: str, at=slice(None)) -> np.ndarray:
    """Ratio of the table's sequences (those at `at`) to s."""
    masks, full, size = table
    full, both = full[at], size[at] + len(s)
    v = full.copy()
    own = {c: masks[ord(c) - 65][at] for c in set(s)}
    for c in s:
        u = v & own[c]
        v = (v + u) | (v - u)
    return np.where(both == 0, 1.0, 2.0 * np.bitwise_count(~v & full) / np.maximum(both, 1))


def best_of(seqs: list[str], refs: list[str], t: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(best ratio, its place among refs) of each sequence: the first reference on ties; -1 and -1 where none reaches t."""
    top, place = np.full(len(seqs), -1.0), np.full(len(seqs), -1)
    order = np.argsort([len(s) for s in seqs], kind="stable")
    table = code_table([seqs[i] for i in order])
    size = table[2]
    counts = np.bitwise_count(table[0]).astype(np.int16).T
    best, at = top[order], place[order]
    for i, r in enumerate(refs):
        # lengths that can reach t, multiplied out so that pairs at the threshold stay
        lo = np.searchsorted(size, len(r) * t / (2 - t) - 1e-9)
        hi = np.searchsorted(size, len(r) * (2 - t) / max(t, 1e-9) + 1e-9, side="right")
        own = np.bincount([ord(c) - 65 for c in r], minlength=26).astype(np.int16)
        both = np.maximum(size[lo:hi] + len(r), 1)
        most = 2.0 * np.minimum(counts[lo:hi], own).sum(axis=1) / both
        few = lo + np.flatnonzero((most > best[lo:hi] - 1e-12) & (most >= t - 1e-12))
        if len(few):
            now = ratios_to(table, r, few)
            better = (now > best[few]) & (now >= t - 1e-12)
            best[few[better]], at[few[better]] = now[better], i
    top[order], place[order] = best, at
    return top, place


def best_references(unique: DataFrame, refs: DataFrame, t: float = 0.0) -> DataFrame:
    """l_s, r_ord, r_s, ratio: the best reference of ratio >= t of each sequence of `unique` that has one, the first on ties."""
    known = distinct_first(refs)
    parts = max(1, -(-known.count() // BROADCAST_ROWS))
    hits = None
    for part in range(parts):
        listed = known.where(F.pmod(F.xxhash64("s"), F.lit(parts)) == part).orderBy("ord", "s").collect()
        sent = unique.sparkSession.sparkContext.broadcast(([r["ord"] for r in listed], [r["s"] for r in listed]))

        def best(batches, sent=sent):
            ords, seqs = sent.value
            for b in batches:
                for lo in range(0, len(b), 8_192):
                    s = b["s"].iloc[lo : lo + 8_192].dropna().tolist()
                    top, at = best_of(s, seqs, t)
                    rows = [(x, ords[i], seqs[i], float(v)) for x, i, v in zip(s, at.tolist(), top) if i >= 0]
                    yield pd.DataFrame(rows, columns=["l_s", "r_ord", "r_s", "ratio"])

        hit = unique.select("s").mapInPandas(best, "l_s string, r_ord long, r_s string, ratio double")
        hits = hit if hits is None else hits.unionByName(hit)
    if parts > 1:
        top = F.max_by(F.struct("r_ord", "r_s", "ratio"), F.struct("ratio", -F.col("r_ord")))
        hits = hits.groupBy("l_s").agg(top.alias("b")).select("l_s", "b.*")
    return hits


def violations(candidates: DataFrame, refs: DataFrame, t: float = 0.8) -> DataFrame:
    """Candidates whose closest reference is strictly above t."""
    return closest(candidates, refs, t).where(F.col("identity") > t).withColumn("identity", F.round("identity", 4))


def diversity(df: DataFrame) -> DataFrame:
    """n_sequences, mean and largest ratio over all pairs of a short list, and length statistics."""
    pairs = block_pairs(df).agg(F.avg("ratio").alias("mean_ratio"), F.max("ratio").alias("max_ratio"))
    return df.agg(F.count(F.lit(1)).alias("n_sequences"), F.min(F.length("s")).alias("min_length"), F.avg(F.length("s")).alias("mean_length"), F.max(F.length("s")).alias("max_length")).join(F.broadcast(pairs))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """n, shared, share of the distinct sequences of a that b has."""
    x = a.select("s").distinct().join(b.select("s").distinct().withColumn("hit", F.lit(1)), "s", "left")
    return x.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("shared"), (F.count("hit") / F.count(F.lit(1))).alias("share"))


def lead_block(seqs: list[str], t: float) -> list[str]:
    """Leaders of the sequential rule among sequences in order."""
    masks, full, size = code_table(seqs)
    open_, out = np.arange(len(seqs)), []
    while len(open_):
        leader = seqs[open_[0]]
        out.append(leader)
        now = ratios_to((masks[:, open_], full[open_], size[open_]), leader)
        near = now >= t - 1e-12
        near[0] = True
        open_ = open_[~near]
    return out


def leader_clusters(df: DataFrame, t: float, save) -> DataFrame:
    """s, leader, cluster_id: leader clustering in the order (-length, s): join the first leader of ratio >= t, else lead.

    Rounds: the first BLOCK_ROWS undecided sequences are clustered by the sequential rule on the driver, as no earlier
    leader is near them; then each undecided sequence joins the first of the new leaders that is near it, or stays
    undecided. A round decides a block at least. `save` cuts the lineage of each round. No pairs are stored: work grows with sequences x leaders.
    """
    schema = "s string, leader string"
    left, parts = save(df.select("s").distinct().where(F.col("s").isNotNull())), []
    while True:
        block = [r["s"] for r in left.orderBy(F.desc(F.length("s")), "s").limit(BLOCK_ROWS).collect()]
        if not block:
            break
        leaders = lead_block(block, t)

        def join(batches, leaders=leaders):
            for b in batches:
                for lo in range(0, len(b), 8_192):
                    s = b["s"].iloc[lo : lo + 8_192].to_numpy()
                    masks, full, size = code_table(s.tolist())
                    open_, owner = np.arange(len(s)), np.full(len(s), None, object)
                    for r in leaders:
                        near = ratios_to((masks, full, size), r) >= t - 1e-12
                        if near.any():
                            owner[open_[near]] = r
                            open_, masks, full, size = open_[~near], masks[:, ~near], full[~near], size[~near]
                            if not len(open_):
                                break
                    yield pd.DataFrame({"s": s, "leader": owner})

        done = save(left.select("s").mapInPandas(join, schema))
        parts.append(done.where("leader is not null"))
        left = done.where("leader is null").select("s")
    owned = reduce(DataFrame.unionByName, parts, left.select("s", F.lit(None).cast("string").alias("leader")))
    # numbered within groups of equal length and first two letters, and the groups (some 17,000 at most) one after another
    leaders = owned.select("leader").distinct().select("leader", F.length("leader").alias("n"), F.substring("leader", 1, 2).alias("two"))
    groups = leaders.groupBy("n", "two").agg(F.count(F.lit(1)).alias("size"))
    before = groups.withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy(F.desc("n"), "two").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("n", "two").orderBy("leader"))
    ids = leaders.withColumn("place", place).join(F.broadcast(before), ["n", "two"]).select("leader", (F.col("before") + F.col("place") - 1).cast("int").alias("cluster_id"))
    return owned.join(ids, "leader").select("s", "leader", "cluster_id")


def group_split(df: DataFrame, group: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `test`: whole groups, the first max(1, round(share * groups)) in hash order."""
    ids = df.select(group).distinct()
    n = ids.count()
    take = max(1, round(share * n))
    order = Window.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"))))
    return df.join(ids.withColumn("test", F.row_number().over(order) <= take), group)


def random_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with `test`: exactly round(share * n) rows (1 at least) by hash order of a unique key.

    The hash at the cut is found from exact counts by its leading digits, four more a round, so no row order is made.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    hashed = df.select(h.alias("h"))
    left, prefix = max(1, round(share * df.count())), ""
    while len(prefix) < 32:
        digits = len(prefix) + 4
        counts = hashed.where(F.substring("h", 1, len(prefix)) == prefix).groupBy(F.substring("h", 1, digits).alias("p")).count().orderBy("p").collect()
        for r in counts:
            if r["count"] >= left:
                prefix = r["p"]
                break
            left -= r["count"]
        else:
            break  # fewer rows than asked for
        if r["count"] == left:
            break  # all of this prefix are taken
    return df.withColumn("test", F.substring(h, 1, len(prefix)) <= prefix)


def split_leakage(df: DataFrame, group: str) -> DataFrame:
    """n_test, leaked: the share of test rows whose group is in train too."""
    train = df.where("not test").select(group).distinct().withColumn("hit", F.lit(1.0))
    return df.where("test").join(train, group, "left").agg(F.count(F.lit(1)).alias("n_test"), F.avg(F.coalesce("hit", F.lit(0.0))).alias("leaked"))
