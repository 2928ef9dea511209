"""Descriptors against plain Python on random and edge sequences."""

import cmath
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import descriptors as D
from strandlake.functions import scales as S
from strandlake.functions import vectors

EDGES = ["A" * 8, "C" * 8, "GP" * 5, "KRDEKRDE", "K" * 11, "K" * 12, "LLLLLLLLLLLLLLLLLLLLLL", "DGNGNSDP", "ILVAFW", "AKA", "W"]


def brute(s):
    h = [S.EISENBERG[c] for c in s]
    n = len(s)
    moment = lambda x, d: abs(sum(v * cmath.exp(1j * math.radians(d) * i) for i, v in enumerate(x))) / len(x)
    out = {"moment_helix": moment(h, 100), "moment_sheet": moment(h, 180), "moment_windowed": moment(h, 100) if n <= 11 else max(moment(h[i : i + 11], 100) for i in range(n - 10))}
    z = [v - sum(h) / n for v in h]
    power = [abs(sum(v * cmath.exp(1j * math.radians(a) * i) for i, v in enumerate(z))) ** 2 for a in range(2, 360, 2)]
    out["periodicity_purity"] = power[49] / sum(power) if n >= 6 and sum(v * v for v in z) > 1e-20 else 0.0
    idx = [i for i, c in enumerate(s) if c in S.HYDROPHOBIC]
    a = sorted(i * 100 % 360 for i in idx)
    if len(a) < 2:
        out |= {"wheel_arc_width": 0.0, "wheel_largest_gap": 0.0, "wheel_resultant": 0.0}
    else:
        gaps = sorted([y - x for x, y in zip(a, a[1:])] + [a[0] + 360 - a[-1]])
        out |= {"wheel_arc_width": 360 - gaps[-1], "wheel_largest_gap": gaps[-2], "wheel_resultant": abs(sum(cmath.exp(1j * math.radians(x)) for x in a)) / len(a)}
    # single linkage by Kruskal
    at = lambda i: (2.3 * math.cos(math.radians(100) * i), 2.3 * math.sin(math.radians(100) * i), 1.5 * i)
    edges, root, deaths = sorted((math.dist(at(i), at(j)), i, j) for i in idx for j in idx if i < j), {i: i for i in idx}, []
    find = lambda v: v if root[v] == v else find(root[v])
    for d, i, j in edges:
        if find(i) != find(j):
            root[find(i)] = find(j)
            deaths.append(d)
    out |= {"h0_max_death": deaths[-1] if len(idx) >= 3 else 0.0, "h0_total_death": sum(deaths) if len(idx) >= 3 else 0.0, "h0_n_components": len(idx)}
    best = run = 0
    for c in s:
        run = run + 1 if c in S.HYDROPHOBIC else 0
        best = max(best, run)
    out["longest_hydrophobic_run"] = best
    out["molecular_weight"] = sum(S.RESIDUE_MASS[c] for c in s) + S.WATER_MASS
    out["n_liability_motifs"] = sum(s.count(m) for m in S.LIABILITY_MOTIFS)
    return out


def test_descriptors(spark):
    rng = random.Random(5)
    seqs = EDGES + ["".join(rng.choice(S.ALPHABET) for _ in range(rng.randint(8, 50))) for _ in range(60)]
    rows = D.with_descriptors(spark.createDataFrame([(s,) for s in seqs], "s string")).collect()
    assert len(rows) == len(seqs) and all(f in rows[0].asDict() for f in D.FEATURES) and len(D.FEATURES) == 44
    for r in rows:
        for k, v in brute(r["s"]).items():
            assert r[k] == pytest.approx(v, abs=1e-7), (r["s"], k)


def test_helicity_bounds_and_short(spark):
    rows = {r["s"]: r for r in D.with_disorder(spark.createDataFrame([("AAA",), ("A" * 30,), ("PPPPPPPP",)], "s string")).collect()}
    assert rows["AAA"]["helicity_water"] == 0 and 0 < rows["PPPPPPPP"]["helicity_water"] < rows["A" * 30]["helicity_water"] <= 1


def test_vectors_equal_columns(spark):
    rng = random.Random(6)
    seqs = EDGES + ["".join(rng.choice(S.ALPHABET) for _ in range(rng.randint(1, 50))) for _ in range(200)]
    rows = {r["s"]: r for r in D.with_descriptors(spark.createDataFrame([(s,) for s in seqs], "s string")).collect()}
    got = vectors.featurize(seqs)
    assert list(sorted(got)) == sorted(D.FEATURES)
    for k, v in got.items():
        assert v == pytest.approx([rows[s][k] for s in seqs], abs=1e-9), k
    nulls = D.with_descriptors(spark.createDataFrame([(None, 3.0), ("", 4.0)], "s string, length double")).collect()
    assert nulls[0]["kappa"] is None and nulls[0]["net_charge"] is None and nulls[1]["moment_helix"] == 0 and nulls[1]["length"] == 0


def test_patterning_against_its_definition():
    """Windows of 5 and 6, each share compared with the whole's, over the order +, 0, -."""

    def deviation(q, blob):
        if len(q) < blob:
            return 0.0
        of = lambda x: (sum(v > 0 for v in x) / len(x), sum(v < 0 for v in x) / len(x))
        p, m = of(q)
        sigma = (p - m) ** 2 / (p + m) if p + m else 0.0
        parts = [of(q[i : i + blob]) for i in range(len(q) - blob + 1)]
        return sum(((a - b) ** 2 / (a + b) - sigma) ** 2 if a + b else (p - m) ** 2 for a, b in parts) / len(parts)

    def ratio(q):
        ref = sum(deviation(sorted(q, reverse=True), k) for k in (5, 6))
        return sum(deviation(q, k) for k in (5, 6)) / ref if any(q) and ref > 0 else 0.0

    rng = random.Random(7)
    seqs = EDGES + ["".join(rng.choice(S.ALPHABET) for _ in range(rng.randint(1, 50))) for _ in range(300)]
    got = vectors.positional(seqs)
    sign = {"K": 1, "R": 1, "D": -1, "E": -1}
    assert got["kappa"] == pytest.approx([ratio([sign.get(c, 0) for c in s]) for s in seqs])
    assert got["hydrophobic_blockiness"] == pytest.approx([ratio([1 if c in S.HYDROPHOBIC else -1 for c in s]) for s in seqs])


def test_published_values():
    """A few values of each fixed table, written down a second time."""
    assert (S.EISENBERG["R"], S.EISENBERG["I"], S.KYTE_DOOLITTLE["I"], S.KYTE_DOOLITTLE["R"]) == (-2.53, 1.38, 4.5, -4.5)
    assert (S.BOMAN["R"], S.BOMAN["L"], S.WW_INTERFACE["W"], S.WW_OCTANOL["D"]) == (14.92, -4.92, -1.85, 3.64)
    assert (S.HELIX_PROPENSITY["E"], S.SHEET_PROPENSITY["V"], S.RESIDUE_MASS["G"], S.HELIX_WEIGHT["P"]) == (1.51, 1.70, 57.0519, 0.02)
    assert (S.PKA_BASE["K"], S.PKA_ACID["D"], S.PKA_N_TERMINUS, S.PKA_C_TERMINUS) == (10.54, 3.90, 9.69, 2.34)
    for scale in (S.EISENBERG, S.KYTE_DOOLITTLE, S.BOMAN, S.WW_INTERFACE, S.WW_OCTANOL, S.HELIX_PROPENSITY, S.SHEET_PROPENSITY, S.RESIDUE_MASS, S.HELIX_WEIGHT):
        assert "".join(scale) == S.ALPHABET


def test_deaths_of_any_cloud(spark):
    """Against Kruskal's rule over all pairs."""
    from strandlake.functions import descriptors as D

    rng = np.random.default_rng(2)
    clouds = [rng.normal(size=(n, 3)).round(1).tolist() for n in (0, 1, 2, 3, 20, 60)] + [[[1.0, 1, 1]] * 5, None]
    rows = [(i, None if c is None else [(*map(float, p), "x") for p in c]) for i, c in enumerate(clouds)]
    rows.append((99, [(0.0, 0.0, 0.0, "x"), (None, 1.0, 1.0, "x"), (float("nan"), 1.0, 1.0, "x"), (3.0, 4.0, 0.0, "x")]))
    df = spark.createDataFrame(rows, "id int, c array<struct<x: double, y: double, z: double, name: string>>")
    got = {r["id"]: r["d"] for r in df.select("id", D.cloud_deaths(F.col("c")).alias("d")).collect()}
    for i, c in enumerate(clouds):
        if c is None:
            assert got[i] is None
            continue
        root = list(range(len(c)))

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        want = []
        for d, a, b in sorted((float(np.linalg.norm(np.subtract(p, q))), a, b) for a, p in enumerate(c) for b, q in enumerate(c) if a < b):
            if find(a) != find(b):
                root[find(a)] = find(b)
                want.append(d)
        assert np.allclose(got[i], want)
    assert got[99] == [5.0]
    s = "AKLLGWKAV" * 2
    points = spark.createDataFrame([(s,)], "s string").select(D.hydrophobic_cloud(F.col("s")).alias("c"), D.cloud_deaths(D.hydrophobic_cloud(F.col("s"))).alias("d"), D.h0(F.col("s")).alias("h")).first()
    assert [p["place"] for p in points["c"]] == [i for i, c in enumerate(s) if c in "AILMFVWY"] and max(points["d"]) == pytest.approx(points["h"]["h0_max_death"]) and sum(points["d"]) == pytest.approx(points["h"]["h0_total_death"])
