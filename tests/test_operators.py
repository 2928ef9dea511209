"""Similarity, clusters, selection, statistics and models against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import descriptors as D
from strandlake.functions import objective as O
from strandlake.functions import scales as S
from strandlake.functions import tokens
from strandlake.operators import models, search, similarity, tables
from strandlake.operators import select as sel


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def seqs(n, seed, letters="KLW"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(8, 16))) for _ in range(n)]


def frame(spark, words):
    return spark.createDataFrame(list(enumerate(words)), "ord long, s string")


def test_lcs():
    a, b = seqs(200, 1) + ["", "A" * 50], seqs(200, 2) + ["A", "A" * 50]
    assert similarity.lcs_lengths(a, b).tolist() == [round(ratio(x, y) * (len(x) + len(y)) / 2) for x, y in zip(a, b)]


def test_novel_and_closest(spark):
    refs, cand = seqs(40, 3), seqs(60, 4) + ["AAAAAAAAAA", "AAAAAAAACC"]
    refs.append("AAAAAAAADD")  # ratio 0.8 with both
    got = {r["s"] for r in similarity.novel(frame(spark, cand), frame(spark, refs)).collect()}
    assert got == {c for c in cand if all(ratio(c, r) < 0.8 - 1e-12 for r in refs)}
    best = {r["ord"]: (r["ref"], r["identity"]) for r in similarity.closest(frame(spark, cand), frame(spark, refs), 0.8).collect()}
    for i, c in enumerate(cand):
        top = max(ratio(c, r) for r in refs)
        assert best[i] == (next(r for r in refs if ratio(c, r) == top), pytest.approx(top)) if top >= 0.8 else best[i][0] is None


def test_leader_clusters(spark):
    words = seqs(60, 7)
    leaders, want = [], {}
    for s in sorted(set(words), key=lambda s: (-len(s), s)):
        hit = next((c for c in leaders if ratio(s, c) >= 0.7 - 1e-12), None)
        if hit is None:
            leaders.append(s)
        want[s] = hit or s
    got = similarity.leader_clusters(frame(spark, words), 0.7, lambda d: d.persist()).collect()
    assert {r["s"]: r["leader"] for r in got} == want and {r["leader"]: r["cluster_id"] for r in got} == {s: i for i, s in enumerate(leaders)}


def test_greedy():
    words, rng = seqs(30, 9), np.random.default_rng(1)
    score = np.round(rng.random(30), 1)
    left, out = list(range(30)), []
    for _ in range(10):
        gain = [score[i] * (1 - 0.5 * max([ratio(words[i], words[j]) for j in out], default=0)) for i in left]
        out.append(left.pop(int(np.argmax(gain))))
    assert sel.greedy_indices(words, score, 10, 0.5) == out and sel.greedy_indices([], np.zeros(0), 3, 0.5) == []
    assert sel.greedy_indices(words, np.where(score > 0.5, score, -np.inf), 30, 1.0)[0] == int(score.argmax()) and len(sel.greedy_indices(words, np.where(score > 0.5, score, -np.inf), 30, 1.0)) == (score > 0.5).sum()


def test_statistics(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in [(1, 2), (1, 3), (2, 1), (3, 9), (3, 9)]] + [(None, 1.0)], "x double, y double")
    r = tables.spearman(df, "x", "y").first()
    assert r["n"] == 5 and r["spearman"] == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4.5, 4.5], [2, 3, 1, 4.5, 4.5])[0, 1])
    assert tables.conformal_width(df.where("x < 0"), "x").first()["width"] == 0
    band = sel.eligible_band(df.where("x is not null"), "x", 0.25).collect()
    assert sorted(b["x"] for b in band) == [3.0, 3.0]
    top = sel.top_k(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "ord long, v double"), "v", 2).orderBy("rank").collect()
    assert [t["ord"] for t in top] == [1, 2]


def test_moves_keep_their_invariants():
    """Each move by itself: what it may change, within the rules; classes and pools as published."""
    rng, move = np.random.default_rng(1), search.Mutator()
    kinds = {c: tokens.residue_class(c) for c in S.ALPHABET}
    assert sorted(c for c, k in kinds.items() if k == "cationic") == ["H", "K", "R"] and kinds["D"] == "anionic" and kinds["Y"] == "hydrophobic" and kinds["P"] == "polar"
    starts = ["KWKLFKKIGIGKFLHSAKKF", "K" * 12, "ACDEFGHIKLMN", "L" * 30, "GIGAVLKVLTTGLPALISWIKRKRQQ"]
    for s in starts:
        for _ in range(300):
            t = move.same_class(s, rng)
            assert len(t) == len(s) and [kinds[c] for c in t] == [kinds[c] for c in s] and sum(a != b for a, b in zip(s, t)) <= 1
            t = move.swap(s, rng)
            assert sorted(t) == sorted(s)
            t = move.face(s, rng)
            at = [i for i in range(len(s)) if s[i] != t[i]]
            assert len(t) == len(s) and len(at) <= 1
            for i in at:
                assert t[i] in ("AILMFVWGNQSTKR" if search.on_face(i, search.face_centre(s)) else "KRGNQST")
            t = move.indel(s, rng)
            assert abs(len(t) - len(s)) <= 1 and 12 <= len(t) <= 30
            t = move.terminal(s, rng)
            assert 12 <= len(t) <= 30 and (s in t or t in (s[1:], s[:-1]))
    names = [rng.choice(move.names, p=move.shares) for _ in range(4000)]
    assert all(abs(names.count(n) / 4000 - p) < 0.03 for n, p in (("same_class", 0.40), ("face", 0.30), ("swap", 0.15), ("indel", 0.08), ("terminal", 0.07)))
    on, pools = "KWKLFKKIGIGKFLHSAKKF", []
    for _ in range(6000):
        t = move.face(on, rng)
        pools += [t[i] in "AILMFVW" for i in range(len(on)) if t[i] != on[i] and search.on_face(i, search.face_centre(on))]
    assert 0.6 < np.mean(pools) < 0.8


def test_search_is_seeded_and_feasible(spark):
    start = "KWKLFKKIGIGKFLHSAKKF"
    a, b = search.anneal(start, 3, 60), search.anneal(start, 3, 60)
    assert a.best == b.best and list(a.visited) == list(b.visited) and 0 < a.taken <= 60
    assert all(search.feasible(s) for s in a.visited) and a.score >= search.rule_score(start, 2.0) and (a.best == start or a.best in a.visited)
    assert len(a.visited) > a.taken * 0.5 and search.anneal("C" * 12, 1, 20).score == -np.inf
    df = frame(spark, [start, "GIGAVLKVLTTGLPALISWI"])
    x = search.refine(df, 30).orderBy("chain", "place").collect()
    y = search.refine(df.repartition(3), 30).orderBy("chain", "place").collect()
    assert x == y and sum(r["place"] == 0 for r in x) == 2 and len({(r["chain"], r["s"]) for r in x}) == len(x)


def test_sampler(spark):
    words = seqs(80, 31, S.ALPHABET.replace("C", ""))
    df = frame(spark, words).withColumn("charge", F.length("s") * 1.0 - 10).withColumn("second", F.col("ord") % 3 == 0)
    for extra in ({}, {"charge": "charge"}, {"charge": "charge", "source": "second"}):
        pool = [r["s"] for r in search.sample_pool(df, 60, **extra).orderBy("ord").collect()]
        assert len(pool) == len(set(pool)) >= 60 and all(8 <= len(s) <= 50 for s in pool)
        assert pool == [r["s"] for r in search.sample_pool(df.repartition(3), 60, **extra).orderBy("ord").collect()]
    # one word only: the pool stalls
    assert search.sample_pool(frame(spark, ["KLAKLAKLAKLA"]), 60).count() < 20
    hot = dict(search.heated([("a", 0.9), ("b", 0.1)], 10.0))
    assert 0.5 < hot["a"] < 0.6 and dict(search.heated([("a", 0.9), ("b", 0.1)], 0.01))["a"] > 0.999
    counts = {(r["condition"], r["context"], r["next"]): r["n"] for r in search.ngram_model(df, 1, ("second",)).collect()}
    assert sum(n for (c, _, x), n in counts.items() if c == "" and x == "$") == 80 and sum(n for (c, _, x), n in counts.items() if c == "true" and x == "$") == 27


def test_gate_and_regression(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), *map(float, rng.normal(size=3))) for i in range(400)] + [(1000, 30.0, 30.0, 30.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r["id"]: r["in_distribution"] for r in models.DistributionGate(["a", "b", "c"]).fit(df).apply(df).collect()}
    assert not got[1000] and 0.9 < np.mean(list(got.values())) < 1
    long = df.where("id < 1000").selectExpr("a", "b", "2 * a as y", "cast(0 as int) as k")
    fitted = models.CensoredRegressor(["a", "b"], seeds=(0,), rounds=1, trees=5).fit(long, "y", "k").predict(long).collect()
    assert np.corrcoef([r["y"] for r in fitted], [r["prediction"] for r in fitted])[0, 1] > 0.9


def test_gate_fits_on_all_rows(spark):
    # more rows than any sample, a block of copies among them, and rows that aren't finite
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(size=(4000, 2)), np.tile([0.5, 0.5], (7000, 1)), rng.normal(6, 1, size=(900, 2))])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(-1, float("nan"), 1.0), (-2, None, 1.0), (-3, float("inf"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double").repartition(5)
    gate = models.DistributionGate(["a", "b"], reweight=False).fit(df)
    got = {r["id"]: r for r in gate.apply(df).collect()}
    assert gate.kept == ["a", "b"] and len(got) == len(rows) and not any(got[i]["in_distribution"] for i in (-1, -2, -3))
    d = np.array([got[i]["distance"] for i in range(len(x))])
    assert gate.threshold == pytest.approx(np.quantile(d, 0.975)) and all(got[i]["in_distribution"] == (d[i] <= gate.threshold) for i in range(len(x)))
    # a concentration step over all rows doesn't move the centre any more
    h, order = int(np.ceil(0.85 * len(x))), np.argsort(d, kind="stable")
    assert np.allclose(x[order[:h]].mean(axis=0), gate.mu, atol=1e-6)


def test_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(models, "LISTED", 10)
    x = np.round(np.random.default_rng(5).normal(size=(500, 1)), 2)
    rows = spark.createDataFrame([([float(v)],) for v in x[:, 0]], "x array<double>")
    d = np.sort(models.quadratic(x, np.zeros(1), np.eye(1)))
    got = models.ranked(rows, [0], [(np.zeros(1), np.eye(1))] * 3, [0, 250, 499])
    assert got == [(d[r], int((d < d[r]).sum()), int((d == d[r]).sum())) for r in (0, 250, 499)]


def test_closest_of_any_similarity(spark, monkeypatch):
    from strandlake.plans import catalog

    refs, cand = seqs(40, 3) + ["KKKKKKKKKK"], seqs(60, 4) + ["AAAAAAAAAA", "AAAAAAAACC", "KLWKLWKL"] * 2
    want = {i: max(ratio(c, r) for r in refs) for i, c in enumerate(cand)}
    for rows in (100_000, 7):
        monkeypatch.setattr(similarity, "BROADCAST_ROWS", rows)
        best = {r["ord"]: (r["ref"], r["identity"]) for r in similarity.closest(frame(spark, cand), frame(spark, refs)).collect()}
        assert best == {i: (next(r for r in refs if ratio(c, r) == want[i]), pytest.approx(want[i])) for i, c in enumerate(cand)}
    none = similarity.closest(frame(spark, cand), frame(spark, refs).limit(0)).collect()
    assert len(none) == len(cand) and all(r["ref"] is None and r["identity"] == 0 for r in none)
    got = catalog.QUERIES["closest_reference"](spark, "/root/testdata/sf0.001")
    assert got.where("ref is null").count() == 0 and got.where("identity < 0.8").count() > 0


def test_cells_choose_among_all_rows(spark):
    # 700 near copies with better scores in each cell, and less similar rows behind them
    rng = random.Random(11)
    words = ["KKKKKKKKKKKK" + "".join(rng.choice("KL") for _ in range(8)) for _ in range(1400)] + seqs(100, 12, "AGST")
    score = [2.0 - 0.0005 * (i // 2) for i in range(1400)] + [1.5 - 0.001 * i for i in range(100)]
    for shift in (0.0, -1.6):
        df = spark.createDataFrame([(i, w, x + shift, "ab"[i % 2]) for i, (w, x) in enumerate(zip(words, score))], "ord long, s string, v double, cell string").repartition(5)
        got = {(r["cell"], r["pick"]): r["ord"] for r in sel.greedy_diverse(df, "v", 6, "cell", 0.5).collect()}
        for c in (0, 1):
            own = list(range(c, 1500, 2))
            want = sel.greedy_indices([words[i] for i in own], np.array([score[i] + shift for i in own]), 6, 0.5)
            assert [got["ab"[c], n + 1] for n in range(6)] == [own[i] for i in want]
            assert shift or any(own[i] >= 1400 for i in want)


def test_leader_clusters_in_many_rounds(spark, monkeypatch):
    from strandlake.operators.tables import aggregate_activity
    from strandlake.plans import catalog

    def rule(words, t):
        leaders, out = [], {}
        for s in sorted(set(words), key=lambda s: (-len(s), s)):
            hit = next((c for c in leaders if ratio(s, c) >= t - 1e-12), None)
            if hit is None:
                leaders.append(s)
            out[s] = (hit or s, leaders.index(hit or s))
        return out

    monkeypatch.setattr(similarity, "BLOCK_ROWS", 20)
    words = seqs(150, 21, "KLWAGSTDE") * 2
    for t in (0.4, 0.65):
        got = similarity.leader_clusters(frame(spark, words), t, lambda d: d.persist()).collect()
        assert {r["s"]: (r["leader"], r["cluster_id"]) for r in got} == rule(words, t) and len(got) == 150
    assert similarity.leader_clusters(frame(spark, words).limit(0), 0.4, lambda d: d).count() == 0
    monkeypatch.undo()
    sf = "/root/testdata/sf0.001"
    known = [r["s"] for r in aggregate_activity(catalog.long_table(spark, sf)).select("s").collect()]
    assert {r["s"]: (r["leader"], r["cluster_id"]) for r in catalog.QUERIES["leader_clusters"](spark, sf).collect()} == rule(known, 0.4)


def plain_greedy(rows, k, weight=1.0):
    left, out = list(rows), []
    while left and len(out) < k:
        gain = [v * (1 - weight * max([ratio(s, t) for t, _ in out], default=0)) for s, v in left]
        out.append(left.pop(int(np.argmax(gain))))
    return out


def test_factorial_design_against_plain_python(spark):
    rng = random.Random(41)
    words = list(dict.fromkeys(seqs(260, 42, "KLWAGST")))
    value = {s: round(rng.random() * 3 + 1, 3) for s in words}
    axes = {s: (rng.randint(0, 9), rng.randint(0, 5)) for s in words}

    def plain(pool, tolerance):
        hi, lo = max(value.values()), min(value.values())
        band = [s for s in words if value[s] >= hi - tolerance * (hi - lo)]
        if len(band) < pool:
            band = sorted(words, key=lambda s: (-value[s], words.index(s)))[: max(3 * pool, 150)]
        cut = [np.median([axes[s][i] for s in band]) for i in (0, 1)]
        cell = {s: "|".join(f"{n}:{'hi' if axes[s][i] >= cut[i] else 'lo'}" for i, n in enumerate("ab")) for s in band}
        take = max(pool // len(set(cell.values())), 1)
        out = []
        for c in sorted(set(cell.values())):
            out += [s for s, _ in plain_greedy([(s, value[s]) for s in words if cell.get(s) == c], take)]
        out += sorted((s for s in band if s not in out), key=lambda s: (-value[s], words.index(s)))[: max(pool - len(out), 0)]
        return out[:pool], cell

    df = spark.createDataFrame([(i, s, value[s], *axes[s]) for i, s in enumerate(words)], "ord long, s string, v double, a int, b int").repartition(3)
    for pool, tolerance in ((14, 0.5), (14, 0.01), (3, 0.5)):
        want, cell = plain(pool, tolerance)
        got = sel.factorial_select(df, "v", ["a", "b"], pool, tolerance).orderBy("pick").collect()
        assert [r["s"] for r in got] == want and all(r["cell"] == cell[r["s"]] for r in got)
        band = {r["s"]: r["cell"] for r in sel.factorial_band(df, "v", ["a", "b"], pool, tolerance).collect()}
        assert band == cell
    chosen = sel.factorial_select(df, "v", ["a", "b"], 14, 0.5)
    want, cell = plain(14, 0.5)
    cost = sel.factorial_cost(chosen, df, "v", ["a", "b"], ["a"]).first()
    greedy = np.mean(sorted(value.values())[-14:])
    assert cost["greedy_mean"] == pytest.approx(greedy) and cost["relative_cost"] == pytest.approx((greedy - np.mean([value[s] for s in want])) / greedy)
    report = {r["cell"]: r for r in sel.factorial_cells_report(chosen, sel.factorial_band(df, "v", ["a", "b"], 14, 0.5), "v", ["a"]).collect()}
    assert {c: r["available"] for c, r in report.items()} == {c: list(cell.values()).count(c) for c in set(cell.values())} and sum(r["selected"] for r in report.values()) == 14


def test_top_lists(spark):
    words = list(dict.fromkeys(seqs(120, 51, "KLWAGSTDE")))
    words = [s for s in words if 12 <= len(s)]
    value = {s: 5 - 0.01 * i for i, s in enumerate(words)}
    df = spark.createDataFrame([(i, s, value[s], len(s), s.count("K")) for i, s in enumerate(words)], "ord long, s string, v double, a int, b int")
    refs = frame(spark, words[:3])
    open_ = [s for s in words if all(ratio(s, r) < 0.8 - 1e-12 for r in words[:3])]
    head = [s for s, _ in plain_greedy([(s, value[s]) for s in open_[:40]], 10)]
    tail = [s for s, _ in plain_greedy([(s, value[s]) for s in open_ if s not in head], 8)]
    got = [r["s"] for r in sel.top_list(df, refs, "v", 18, 10).orderBy("pick").collect()]
    assert got == head + tail
    design = [r["s"] for r in sel.factorial_top_list(df, refs, "v", ["a", "b"], 18, 10).orderBy("pick").collect()]
    assert len(set(design)) == 18 and set(design) <= set(open_)
    assert sel.factorial_top_list(df.limit(4), refs, "v", ["a", "b"], 18, 10).count() == 0
    with pytest.raises(sel.TooDear):
        sel.factorial_top_list(df, refs, "v", ["a", "b"], 18, 10, tolerance=1.0, most_cost=0.0)
    counts = sel.validate(frame(spark, [words[0], words[0], "CCCC"]), frame(spark, words), refs, 3, len(words))
    row = counts.first().asDict()
    assert {k: v for k, v in row.items() if v} == {"top_repeats": 1, "top_infeasible": 1, "top_outside_library": 1, "library_known": 3, "top_too_close": 2}
    with pytest.raises(ValueError, match="top_too_close"):
        sel.require_valid(counts)


def test_quantiles_and_running_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k in (1, 2) for v in np.round(rng.normal(size=300 * k), 1)] + [(3, 1.5), (None, 2.0), (None, 4.0), (4, None)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r["k"]: r for r in tables.exact_quantiles(df, "v", [0.1, 0.5, lambda n: F.least(F.lit(1.0), 0.9 + 1 / n)], ["k"]).collect()}
    assert set(got) == {1, 2, 3, None}
    for k, r in got.items():
        own = [v for g, v in rows if g == k and v is not None]
        assert r["n"] == len(own) and [r["q0"], r["q1"], r["q2"]] == pytest.approx([np.quantile(own, q) for q in (0.1, 0.5, min(1, 0.9 + 1 / len(own)))])
    one = tables.exact_quantiles(df, "v", [0.25]).first()
    assert one["q0"] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.25))
    none = tables.exact_quantiles(df.limit(0), "v", [0.25]).collect()
    assert [(r["n"], r["q0"]) for r in none] == [(0, None)]
    values = spark.range(1000).selectExpr("cast(id as double) v", "id % 3 w")
    assert {r["v"]: r["upto"] for r in tables.running(values, "v", "w").collect()} == {float(i): sum(j % 3 for j in range(i + 1)) for i in range(1000)}


def test_random_split_is_exact(spark):
    import hashlib

    for n in (1, 2, 37, 1000):
        df = spark.range(n)
        order = sorted(range(n), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
        assert {r["id"] for r in similarity.random_split(df, "id").where("test").collect()} == set(order[: max(1, round(0.2 * n))])


def test_diversity_and_violations(spark):
    words = seqs(25, 61)
    r = similarity.diversity(frame(spark, words)).first()
    every = [ratio(a, b) for i, a in enumerate(words) for b in words[:i]]
    assert (r["n_sequences"], r["mean_ratio"], r["max_ratio"]) == (25, pytest.approx(np.mean(every)), pytest.approx(max(every)))
    got = {x["s"]: x["identity"] for x in similarity.violations(frame(spark, ["A" * 10, "A" * 8 + "CC"]), frame(spark, ["A" * 9 + "D", "A" * 8 + "DD"])).collect()}
    assert got == {"A" * 10: 0.9}  # 0.8 itself is none


def test_tokens(spark):
    for s, q in (("ACDY", -3.0), ("KKKK", 6.0), ("", 20.0)):
        ids = tokens.encode(s, q, len(s) > 3)
        row = spark.createDataFrame([(s, q, len(s) > 3)], "s string, q double, second boolean").select(tokens.encoded(F.col("s"), F.col("q"), F.col("second")).alias("t")).select("t", tokens.decoded(F.col("t")).alias("d")).first()
        assert row["t"] == ids and row["d"] == s == tokens.decode(ids)
    assert tokens.encode("A", 2.0) == [25, 30, 0, 3, 1] and tokens.VOCABULARY == 32 and tokens.charge_token(-2.5) == 23 and tokens.charge_token(12.0) == 29
    t = D.tiers()
    assert [len(v) for v in t.values()] == [29, 33, 38, 44] and t["+topology"][:29] == t["composition"]


def test_heads_are_kept_and_score_alike(spark, tmp_path):
    rng = random.Random(71)
    words = ["".join(rng.choice(S.ALPHABET) for _ in range(rng.randint(12, 30))) for _ in range(90)]
    rows = [(s, s.count("K") * 0.5 + rng.random(), int(i % 5 == 0), 5.0 - s.count("L") * 0.3, 0, 7.0 + s.count("G"), 0, None, None) for i, s in enumerate(words)]
    names = "s string, gram_negative double, gram_negative_censor int, gram_positive double, gram_positive_censor int, hc50 double, hc50_censor int, resistant double, resistant_censor int"
    wide = D.with_descriptors(spark.createDataFrame(rows, names)).persist()
    split = wide.select("s", (F.length("s") % 4 == 0).alias("test"))
    heads = models.Predictors.fit(wide, D.FEATURES, split, least=20, seeds=(0, 1), rounds=2, trees=3)
    assert set(heads.heads) == {"gram_negative", "gram_positive", "hc50"} and all(m["n"] > 0 for m in heads.metrics.values()) and all(w > 0 for w in heads.widths.values())
    heads.save(str(tmp_path / "h"))
    again = models.Predictors.load(str(tmp_path / "h"))
    cols = [*models.HEADS.values(), "spread_gram_negative", "spread_resistant"]
    a, b = ({r["s"]: r for r in h.predict(wide).select("s", *cols).collect()} for h in (heads, again))
    assert a == b and all(r["log2_mic_resistant"] is None for r in a.values()) and again.metrics == heads.metrics and again.gate.threshold == heads.gate.threshold
    few = models.Predictors(D.FEATURES, {}, heads.gate).predict(wide).first()
    assert (few["log2_mic_gram_positive"], few["log2_mic_gram_negative"], few["log2_hc50"], few["log2_mic_resistant"]) == (6.0, 6.0, 6.0, None)
    # a single sequence's score equals the Columns', and what is outside the gate or the rules has none
    scorer = again.scorer()
    passed = {r["s"]: r for r in heads.gate.apply(O.with_score(O.with_axes(heads.predict(wide)))).collect()}
    soft = {r["s"]: r["chebyshev"] for r in O.with_score(O.with_axes(heads.predict(wide)), softness=0.4).collect()}
    for s, r in passed.items():
        assert scorer(s) == (pytest.approx(r["chebyshev"], abs=1e-9) if r["in_distribution"] else -np.inf)
        assert not r["in_distribution"] or scorer(s, 0.4) == pytest.approx(soft[s], abs=1e-9)
    assert scorer("KKK") == scorer("B" * 12) == -np.inf
    assert heads.importances().groupBy("head").agg(F.sum("share").alias("t")).count() == 3
    # chains on fitted heads run in workers
    some = [s for s, r in passed.items() if r["in_distribution"]][:3]
    got = search.refine(frame(spark, some), 10, score=scorer).where("place = 0").collect()
    assert len(got) == 3 and all(np.isfinite(r["score"]) for r in got)


def test_classifier_on_held_out_folds(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(x), float(y), int(x + 0.3 * y + 0.2 * rng.normal() > 0)) for i, (x, y) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    model = models.ActivityClassifier(["a", "b"], trees=3, folds=3).fit(df, "y", "id")
    assert all(0 <= r["probability_active"] <= 1 for r in model.predict(df).collect())
    held = model.predict_held_out(df, "y", "id")
    got = models.classifier_metrics(held, "y", "probability_active").first()
    p = [(r["probability_active"], r["y"]) for r in held.collect()]
    steps, hits, seen, area = sorted({v for v, _ in p}, reverse=True), 0, 0, 0.0
    for v in steps:
        own = [y for w, y in p if w == v]
        hits, seen = hits + sum(own), seen + len(own)
        area += sum(own) * hits / seen
    assert got["n"] == 300 and got["average_precision"] == pytest.approx(area / hits) and got["average_precision"] > 0.9
    assert got["brier"] == pytest.approx(np.mean([(v - y) ** 2 for v, y in p]))


def plain_gate(x, level=0.975, support=0.85):
    """Reweighted minimum covariance determinant in plain numpy: concentration from many starts over all rows, median factor, chi-square cut."""
    from strandlake.operators.models import chi_square_quantile

    n, p = x.shape
    h = int(np.ceil(support * n))
    far = lambda mu, cov: (((x - mu) @ np.linalg.pinv(cov)) * (x - mu)).sum(axis=1)
    best = None
    rng = np.random.default_rng(99)
    for _ in range(60):
        at = rng.choice(n, p + 1, replace=False)
        for _ in range(50):
            mu, cov = x[at].mean(0), np.cov(x[at].T, bias=True) + 1e-9 * np.eye(p)
            new = np.argsort(far(mu, cov), kind="stable")[:h]
            if set(new) == set(at):
                break
            at = new
        mu, cov = x[at].mean(0), np.cov(x[at].T, bias=True)
        found = (np.linalg.slogdet(cov)[1], mu, cov)
        best = found if best is None or found[0] < best[0] - 1e-12 else best
    _, mu, cov = best
    d = far(mu, cov)
    inside = d < np.median(d) / chi_square_quantile(0.5, p) * chi_square_quantile(0.975, p)
    raw = (mu, cov)
    mu, cov = x[inside].mean(0), np.cov(x[inside].T, bias=True)
    return mu, cov, np.quantile(far(mu, cov), level), raw


def test_chi_square_quantiles():
    # fixed values of printed tables
    known = {(0.5, 1): 0.4549364, (0.975, 5): 12.8325020, (0.975, 2): 7.3777589, (0.95, 10): 18.3070381, (0.5, 64): 63.3347, (0.975, 44): 64.2015}
    for (p, df), value in known.items():
        assert models.chi_square_quantile(p, df) == pytest.approx(value, rel=1e-5)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gate_reweights_as_plain_numpy_does(spark, seed):
    rng = np.random.default_rng(seed)
    clean = rng.normal(size=(800, 3)) @ np.array([[2.0, 0.3, 0], [0, 1, 0.4], [0, 0, 0.5]])
    odd = rng.normal(size=(100, 3)) * 0.3 + [9, -6, 4]
    x = np.concatenate([clean, odd])
    rng.shuffle(x)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double").repartition(3)
    gate = models.DistributionGate(["a", "b", "c"]).fit(df)
    mu, cov, threshold, (raw_mu, raw_cov) = plain_gate(x)
    assert np.allclose(gate.mu, mu) and np.allclose(gate.inverse, np.linalg.inv(cov)) and gate.threshold == pytest.approx(threshold)
    raw = models.DistributionGate(["a", "b", "c"], reweight=False).fit(df)
    assert np.allclose(raw.mu, raw_mu) and np.allclose(raw.inverse, np.linalg.inv(raw_cov)) and not np.allclose(raw.inverse, gate.inverse, rtol=0.01)
    passed = {r["id"] for r in gate.apply(df).where("in_distribution").collect()}
    d = (((x - mu) @ np.linalg.inv(cov)) * (x - mu)).sum(axis=1)
    assert passed == set(np.flatnonzero(d <= threshold + 1e-9).tolist()) and len(passed) == pytest.approx(0.975 * len(x), abs=2)
    # the clean rows' covariance is found again, other than by an estimate from all rows
    assert np.allclose(np.linalg.inv(gate.inverse), np.cov(clean.T), rtol=0.35, atol=0.1) and not np.allclose(np.cov(x.T), np.cov(clean.T), rtol=1.0, atol=1.0)
    assert models.DistributionGate.of(gate.settings()).settings() == gate.settings()


def test_greedy_rounds_compare_lazily(spark):
    rng = np.random.default_rng(4)
    words = list(dict.fromkeys(seqs(300, 12, "KLAWR")))
    for weight, score in ((1.0, rng.random(len(words))), (0.6, rng.normal(size=len(words))), (0.5, np.round(rng.random(len(words)), 1))):
        rows = [(i, w, "x" if i % 3 else None, float(v)) for i, (w, v) in enumerate(zip(words, score))]
        df = spark.createDataFrame(rows, "ord long, s string, cell string, v double").fillna({"cell": "y"}).repartition(3)
        picks, state = sel.greedy_rounds(df, "v", 20, "cell", weight)
        for cell in ("x", "y"):
            own = [i for i in range(len(words)) if bool(i % 3) == (cell == "x")]
            want = [own[i] for i in sel.greedy_indices([words[i] for i in own], score[own], 20, weight)]
            got = [o for g, o, _, _ in sorted(picks, key=lambda p: p[3]) if g == cell]
            # where all scores left are negative at a weight of 1, rows that can't be picked were left out
            assert got == want[: len(got)] and (len(got) == 20 or weight == 1.0)
        compared = state.agg({"seen": "sum"}).first()[0]
        assert compared <= 19 * len(words) and (weight != 0.6 or compared < 19 * len(words) / 2)


def plain_boost(x, y, seed, trees, depth, step, rows, columns, least):
    """Boosting of the squared loss by trying every cut of every drawn column; draws as operators/boosting.py makes them."""
    rng = np.random.default_rng(seed)
    n, p = x.shape
    now, out = np.full(n, y.mean()), []

    def grow(at, some, level, g):
        mean = g[at].mean()
        best = (1e-12, None)
        if level < depth:
            for c in some:
                values = np.unique(x[:, c])
                for cut in (values[:-1] + values[1:]) / 2:
                    l, r = at[x[at, c] <= cut], at[x[at, c] > cut]
                    if len(l) >= least and len(r) >= least:
                        gain = g[l].sum() ** 2 / len(l) + g[r].sum() ** 2 / len(r) - g[at].sum() ** 2 / len(at)
                        if gain > best[0] + 1e-9:
                            best = (gain, (c, cut, l, r))
        if best[1] is None:
            return lambda row: step * mean
        c, cut, l, r = best[1]
        a, b = grow(l, some, level + 1, g), grow(r, some, level + 1, g)
        return lambda row: a(row) if row[c] <= cut else b(row)

    for _ in range(trees):
        g = y - now
        drawn = np.sort(rng.permutation(n)[: max(1, round(rows * n))])
        some = np.sort(rng.permutation(p)[: max(1, round(columns * p))])
        tree = grow(drawn, some, 0, g)
        out.append(tree)
        now = now + np.array([tree(r) for r in x])
    return lambda rows: np.array([y.mean() + sum(t(r) for t in out) for r in rows])


def test_boosting_against_all_cuts():
    from strandlake.operators import boosting

    rng = np.random.default_rng(1)
    x = np.column_stack([rng.normal(size=120), rng.integers(0, 4, 120), rng.normal(size=120).round(1), np.ones(120)]).astype(float)
    y = x[:, 0] * 2 + (x[:, 1] > 1) + 0.1 * rng.normal(size=120)
    for settings in (dict(trees=12, depth=3, step=0.3, rows=1.0, columns=1.0, least=1), dict(trees=20, depth=3, step=0.05, rows=0.8, columns=0.8, least=20)):
        model = boosting.boost(x, y, 5, **settings)
        assert np.allclose(model.predict(x), plain_boost(x, y, 5, **settings)(x), atol=1e-9)
        again = boosting.Ensemble.of_json(model.to_json())
        assert np.array_equal(again.predict(x), model.predict(x)) and model.shares(4)[3] == 0 and model.shares(4).sum() == pytest.approx(1)
    odds = boosting.boost(x, (y > 1).astype(float), 5, trees=60, loss="logistic", step=0.2, least=5).predict(x)
    assert ((odds > 0) == (y > 1)).mean() > 0.95
    # no rows, no columns, a constant target, more values than bins
    assert boosting.boost(np.empty((0, 2)), np.empty(0), 0, trees=3).predict(x[:, :2]).tolist() == [0.0] * 120
    assert np.allclose(boosting.boost(np.empty((5, 0)), np.arange(5.0), 0, trees=3, rows=1.0).predict(np.empty((2, 0))), 2.0)
    assert np.allclose(boosting.boost(x, np.ones(120), 0, trees=3).predict(x), 1.0)
    assert len(boosting.cuts(rng.normal(size=5000))) <= boosting.BINS


def test_censored_members_in_tasks(spark, tmp_path):
    from strandlake.operators import boosting

    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    y = 3 * x[:, 0] + 0.1 * rng.normal(size=300)
    mark = (y > 2).astype(int)
    rows = [(float(a), None if i % 50 == 0 else float(b), float(min(t, 2.0)), int(m)) for i, ((a, b), t, m) in enumerate(zip(x, y, mark))]
    df = spark.createDataFrame(rows, "a double, b double, y double, k int")
    fit = lambda d, **extra: models.CensoredRegressor(["a", "b"], seeds=(1, 2), rounds=3, trees=60, step=0.1, **extra).fit(d, "y", "k")
    model = fit(df.repartition(5))
    got = {r["a"]: r for r in model.predict(df).collect()}
    p = np.array([got[float(a)]["prediction"] for a in x[:, 0]])
    assert np.abs(p - y)[mark == 0].mean() < 0.5 and (p[mark == 1] > 1.5).mean() > 0.9 and all(r["spread"] >= 0 for r in got.values())
    # the same whatever the partitions, and after a round trip
    other = {r["a"]: r["prediction"] for r in fit(df.coalesce(1)).predict(df).collect()}
    assert other == {a: r["prediction"] for a, r in got.items()}
    model.save(str(tmp_path / "m"))
    back = models.CensoredRegressor.load(str(tmp_path / "m"))
    assert {r["a"]: r["prediction"] for r in back.predict(df).collect()} == other and back.importances() == model.importances()
    plain = boosting.imputed(*[np.array(v)[np.lexsort((mark, np.minimum(y, 2.0), np.where(np.arange(300) % 50 == 0, 0.0, x[:, 1]), x[:, 0]))] for v in (np.column_stack([x[:, 0], np.where(np.arange(300) % 50 == 0, 0.0, x[:, 1])]), np.minimum(y, 2.0), mark == 1)], rounds=3, trees=60, step=0.1, seed=1)
    assert np.allclose(plain.predict(np.array([[0.5, 0.0]])), model.models[0].predict(np.array([[0.5, 0.0]])))
    with pytest.raises(ValueError, match="spark"):
        boosting.fit_members(df.selectExpr("array(a) as x", "y", "k as mark"), 1, [(0, 0)], None, most=10)
    spark_trees = models.CensoredRegressor(["a", "b"], seeds=(1,), rounds=1, trees=5, engine="spark").fit(df, "y", "k").predict(df)
    assert spark_trees.agg({"prediction": "count"}).first()[0] == 300


def test_boosting_takes_large_tables(spark, monkeypatch):
    """More rows than 200,000 are fitted, members in tasks of their own; regressors go to pyspark.ml beyond what a task takes; histograms of differences are exact."""
    import numpy as np

    from strandlake.operators import boosting, models

    df = spark.range(200_001).selectExpr("id", "double(id % 97) as a", "double(id % 2) as y", "0 as k")
    model = models.ActivityClassifier(["a"], trees=2, folds=3).fit(df, "y", "id")
    assert len(model.members) == 3 and model.predict(df).count() == 200_001
    seen = []
    rows = df.limit(300).selectExpr("array(a) as x", "y", "k as mark")
    fit = lambda x, y, mark, number, seed: boosting.Ensemble(100.0 * number + seed + len(x) / 1000, [])
    assert [m.start for m in boosting.fit_members(rows, 1, [(5, 1), (2, 7), (9, 3)], fit)] == [501.3, 207.3, 903.3]
    rng = np.random.default_rng(4)
    v = rng.normal(size=1000)
    whole, unit = boosting._whole(v, 2.0**30)
    assert np.allclose(whole * unit, v, atol=1e-8) and np.cumsum(whole)[-1] == whole[::-1].sum()
    monkeypatch.setattr(boosting, "MOST_CELLS", 100)
    big = models.CensoredRegressor(["a"], seeds=(1,), rounds=1, trees=2).fit(df.limit(300), "y", "k")
    assert big.engine == "spark" and big.predict(df.limit(10)).count() == 10


def test_objective_of_long_runs(spark):
    """The quotient of the SQL where the window of the hydrophobic run vanishes in doubles."""
    import math

    from strandlake.plans import catalog

    got = {r["s"]: r["chebyshev_compat"] for r in catalog.scored(spark.createDataFrame([("K" + "L" * 17 + "K",), ("K" + "L" * 18 + "K",)], "s string")).select("s", "chebyshev_compat").collect()}
    assert [math.isnan(got["K" + "L" * n + "K"]) for n in (17, 18)] == [False, True]


def test_log2_at_thresholds(spark):
    """Values that are twice others stand one apart; what has no logarithm is null."""
    from strandlake.operators import tables

    v = [50.0, 100.0, 200.0, 0.1, 0.2, 0.0, -1.0, None]
    got = [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").withColumn("y", tables.log2(F.col("x"))).orderBy("i").collect()]
    assert got[1] - got[0] == 1.0 and got[2] - got[1] == 1.0 and got[4] - got[3] == 1.0 and got[5:] == [None] * 3


def test_heads_without_a_gate(spark, monkeypatch):
    """Predictions, importances and metrics of heads read no gate, so their queries fit none."""
    from strandlake.operators import models
    from strandlake.plans import catalog

    monkeypatch.setattr(models.DistributionGate, "fit", lambda *_: pytest.fail("fitted a gate that nothing reads"))
    wide = spark.createDataFrame([(f"s{i}", float(i % 7), 0, float(i)) for i in range(60)], "s string, gram_negative double, gram_negative_censor int, x double")
    wide = wide.withColumns({c: F.lit(None).cast(t) for g in ("gram_positive", "hc50", "resistant") for c, t in ((g, "double"), (f"{g}_censor", "int"))})
    monkeypatch.setattr(catalog, "activity_features", lambda *_: wide)
    monkeypatch.setattr(catalog.D, "FEATURES", ["x"])
    monkeypatch.setattr(models.CensoredRegressor, "fit", lambda self, *_: self)
    _, heads = catalog.fitted_heads(spark, "")
    assert set(heads.heads) == {"gram_negative"} and heads.gate is None


def test_measured_heads_are_alike_without_a_gate(spark):
    from strandlake.operators import models

    wide = spark.createDataFrame([(f"s{i}", float(i % 7), 0, float(i * i % 11)) for i in range(60)], "s string, gram_negative double, gram_negative_censor int, x double")
    wide = wide.withColumns({c: F.lit(None).cast(t) for g in ("gram_positive", "hc50", "resistant") for c, t in ((g, "double"), (f"{g}_censor", "int"))}).persist()
    split = wide.select("s", (F.col("x") < 4).alias("test"))
    a, b = (models.Predictors.fit(wide, ["x"], split, least=20, gated=g, seeds=(0,), rounds=1, trees=2) for g in (True, False))
    assert a.metrics.keys() == b.metrics.keys() == {"gram_negative"} and b.metrics["gram_negative"] == pytest.approx(a.metrics["gram_negative"]) and b.widths == a.widths and a.gate is not None and b.gate is None


def test_gate_sums_take_one_job(spark):
    """A concentration step adds up all partitions at once, and its sums are those of the whole table."""
    from strandlake.operators import models

    x = np.random.default_rng(0).normal(size=(240, 3))
    rows = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(24).persist()
    rows.count()
    spark.sparkContext.setJobGroup("gate-sums", "")
    got = models.cut_sums(rows, [0, 1, 2], [(np.zeros(3), np.eye(3))], [2.0], np.zeros(3))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("gate-sums")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    rows.unpersist()
    near = x[(x**2).sum(axis=1) < 2]
    assert np.allclose(got[0, 0], np.concatenate([[len(near)], near.sum(axis=0), (near.T @ near).ravel()])) and not got[0, 1].any()
    assert len(jobs) == 1
