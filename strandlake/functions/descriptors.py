"""Sequence descriptors as Column expressions.

Additive descriptors are linear in the 20 letter counts, which with_descriptors makes columns of once per row. Those that hang on the
order of residues along the whole chain (moments, patterning) run in one Arrow function over batches (functions/vectors.py), which takes
about a tenth of the time of folds over arrays; wheel, topology and helicity are folds. Null sequences give nulls.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from strandlake.functions import scales as S
from strandlake.functions import vectors

GLOBAL = ["net_charge", "charge_density", "isoelectric_point", "mean_hydrophobicity", "gravy", "boman", "mean_helix_propensity", "molecular_weight", "moment_helix", "moment_sheet", "moment_windowed", "periodicity_purity", "kappa", "hydrophobic_blockiness"]
COMPOSITION = ["fcr", "ncpr", "frac_cationic", "frac_anionic", "frac_aromatic", "frac_glycine", "frac_proline"]
WHEEL = ["wheel_arc_width", "wheel_largest_gap", "wheel_resultant", "wheel_circular_var", "wheel_n_hydrophobic"]
PARTITION = ["dg_interface", "dg_octanol", "dg_interface_per_res", "dg_octanol_per_res", "interfacial_preference"]
LIABILITY = ["frac_hydrophobic", "longest_hydrophobic_run", "longest_beta_branched_run", "n_oxidation_prone", "n_liability_motifs", "mean_sheet_propensity", "length"]
TOPOLOGY = ["h0_n_components", "h0_max_death", "h0_total_death", "h0_mean_death", "h0_gap", "h0_n_patches"]
DISORDER = ["helicity_water", "helicity_interface", "helicity_gap", "helicity_ratio", "switchability", "water_optimum_dev", "prefold_risk", "charge_helix_coupling", "helicity_length_product"]
MOMENTS = ["moment_helix", "moment_sheet", "moment_windowed", "periodicity_purity"]
#: The descriptor columns in their fixed order.
FEATURES = GLOBAL + COMPOSITION + WHEEL + PARTITION + LIABILITY + TOPOLOGY


def tiers(columns: list[str] = FEATURES) -> dict[str, list[str]]:
    """Nested lists of descriptors, each with one more kind: what is left without the others, moments, wheel, topology."""
    kinds = {"+moment": [c for c in columns if c in MOMENTS], "+wheel": [c for c in columns if c in WHEEL], "+topology": [c for c in columns if c in TOPOLOGY]}
    out = {"composition": [c for c in columns if not any(c in k for k in kinds.values())]}
    for name, own in kinds.items():
        out[name] = [*out[list(out)[-1]], *own]
    return out


def bind(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def count_letters(s: Column, letters: str) -> Column:
    # one letter is replaced: translate looks up each character of s
    return F.length(s) - F.length(F.replace(s, F.lit(letters), F.lit("")) if len(letters) == 1 else F.translate(s, letters, ""))


def counted(s: Column):
    """Count of one letter, as a function of it."""
    return lambda a: count_letters(s, a)


def weighted(s: Column, scale: dict[str, float], count=None) -> Column:
    """Sum of a scale over a sequence. count: the count of a letter as a Column, where it is there already."""
    count = count or counted(s)
    return sum((count(a) * F.lit(float(v)) for a, v in scale.items()), F.lit(0.0))


def values(s: Column, scale: dict[str, float], default: float = 0.0) -> Column:
    """Array of a scale's values along a sequence."""
    table = F.array(*[F.lit(float(scale.get(chr(65 + i), default))) for i in range(26)])
    return F.transform(F.split(s, ""), lambda c: F.get(table, F.ascii(c) - 65))


def per_residue(s: Column, x: Column) -> Column:
    return x / F.greatest(F.length(s), F.lit(1))


def molecular_weight(s: Column) -> Column:
    return weighted(s, S.RESIDUE_MASS) + S.WATER_MASS


def net_charge(s: Column, ph: float = 7.4, count=None) -> Column:
    base = {a: 1 / (1 + 10 ** (ph - p)) for a, p in S.PKA_BASE.items()}
    acid = {a: -1 / (1 + 10 ** (p - ph)) for a, p in S.PKA_ACID.items()}
    ends = 1 / (1 + 10 ** (ph - S.PKA_N_TERMINUS)) - 1 / (1 + 10 ** (S.PKA_C_TERMINUS - ph))
    return weighted(s, base | acid, count) + ends


def _arrow(run, names: list[str]):
    """A pandas function of sequences with the doubles `names`, null for null sequences."""
    schema = StructType()
    for name in names:
        schema.add(name, DoubleType())

    def of(x: pd.Series) -> pd.DataFrame:
        got = pd.DataFrame(run(x.fillna("").tolist()))[names]
        return got.mask(x.isna().to_numpy()[:, None].repeat(got.shape[1], axis=1))

    return F.pandas_udf(of, schema)


def isoelectric_point(s: Column) -> Column:
    """Bisection of the charge over pH 0 to 14, for whole batches."""
    return _arrow(lambda x: {"pi": vectors.isoelectric(vectors.letter_counts(x))}, ["pi"])(s)["pi"]


def positional(s: Column) -> Column:
    """Struct of the six descriptors of vectors.POSITIONAL."""
    return _arrow(vectors.positional, vectors.POSITIONAL)(s)


def shaped(s: Column, topology: bool = True) -> Column:
    """Struct of the descriptors that aren't sums over letters: positional ones, isoelectric point, wheel and H0; one Arrow function, as folds over arrays are interpreted row by row."""
    names = [*vectors.POSITIONAL, "isoelectric_point", *WHEEL, *(TOPOLOGY if topology else [])]
    return _arrow(lambda x: vectors.shaped(x, topology), names)(s)


def hydrophobic_positions(s: Column) -> Column:
    """Zero-based positions of hydrophobic residues."""
    return F.filter(F.transform(F.split(s, ""), lambda c, i: F.when(F.instr(F.lit(S.HYDROPHOBIC), c) > 0, i)), lambda i: i.isNotNull())


def wheel(s: Column) -> Column:
    """Struct of the five circular statistics on the helical wheel."""
    def stats(idx: Column) -> Column:
        n = F.size(idx)
        around = F.array_sort(F.transform(idx, lambda i: (i * 100) % 360))
        gaps = bind(around, lambda a: F.array_sort(F.concat(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.get(a, k) - F.get(a, k - 1)), F.array(F.get(a, 0) + 360 - F.get(a, n - 1)))))
        part = lambda f: F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + f(F.radians(((i * 100) % 360).cast("double")))) / n
        r = F.sqrt(F.pow(part(F.cos), F.lit(2.0)) + F.pow(part(F.sin), F.lit(2.0)))
        pack = lambda a, g, res, var: F.struct(a.alias("wheel_arc_width"), g.alias("wheel_largest_gap"), res.alias("wheel_resultant"), var.alias("wheel_circular_var"), n.cast("double").alias("wheel_n_hydrophobic"))
        zero = F.lit(0.0)
        full = bind(gaps, lambda g: bind(r, lambda x: pack((360 - F.element_at(g, -1)).cast("double"), F.coalesce(F.get(g, F.size(g) - 2), F.lit(0)).cast("double"), x, 1 - x)))
        return F.when(n < 2, pack(zero, zero, zero, F.lit(1.0))).otherwise(full)

    return bind(hydrophobic_positions(s), stats)


def face_centre(s: Column) -> Column:
    """Circular mean of the hydrophobic residues' wheel angles in degrees; 0 without any, and where they cancel out (up to rounding)."""
    def centre(idx: Column) -> Column:
        part = lambda f: F.aggregate(idx, F.lit(0.0), lambda acc, i: acc + f(F.radians(((i * 100) % 360).cast("double"))))
        return bind(F.struct(part(F.cos).alias("x"), part(F.sin).alias("y")), lambda v: F.when(F.hypot(v["x"], v["y"]) < 1e-9, 0.0).otherwise(F.pmod(F.degrees(F.atan2(v["y"], v["x"])) + 360, F.lit(360.0))))

    return bind(hydrophobic_positions(s), centre)


def longest_run(s: Column, letters: str) -> Column:
    runs = F.transform(F.regexp_extract_all(s, F.lit(f"([{letters}]+)"), F.lit(1)), F.length)
    return F.when(s.isNotNull(), F.coalesce(F.array_max(runs), F.lit(0)).cast("double"))


def distances() -> list[float]:
    """Distance of two residues on the ideal helix by how far apart they are along the chain."""
    return [round(math.sqrt(2 * S.HELIX_RADIUS**2 * (1 - math.cos(math.radians(S.HELIX_DEGREES) * d)) + (S.HELIX_RISE * d) ** 2), 9) for d in range(S.MAX_LENGTH)]


def h0(s: Column) -> Column:
    """Struct of the six H0 statistics of the hydrophobic points on an ideal helix.

    Deaths are the edges of a minimum spanning tree. The distance of two points depends on how far apart they are along
    the chain only, so it is looked up; the tree grows by Prim's rule in a fold.
    """
    table = F.array(*[F.lit(x) for x in distances()])
    dist = lambda i, j: F.get(table, F.abs(i - j))

    def deaths(idx: Column) -> Column:
        rest = F.slice(idx, 2, F.greatest(F.size(idx) - 1, F.lit(0)))
        start = F.struct(rest.alias("rest"), F.transform(rest, lambda i: dist(i, F.get(idx, 0))).alias("near"), F.array().cast("array<double>").alias("out"))

        def grow(st: Column, _: Column) -> Column:
            low = F.array_min(st["near"])

            def take(at: Column) -> Column:
                v = F.get(st["rest"], at)
                keep = F.filter(F.transform(st["rest"], lambda r, k: F.when(k != at, F.struct(r.alias("r"), F.least(F.get(st["near"], k), dist(r, v)).alias("d")))), lambda x: x.isNotNull())
                return bind(keep, lambda kk: F.struct(F.transform(kk, lambda x: x["r"]).alias("rest"), F.transform(kk, lambda x: x["d"]).alias("near"), F.concat(st["out"], F.array(low)).alias("out")))

            return bind((F.array_position(st["near"], low) - 1).cast("int"), take)

        return F.array_sort(F.aggregate(rest, start, grow, lambda st: st["out"]))

    names = TOPOLOGY

    def stats(idx: Column) -> Column:
        n = F.size(idx)
        pack = lambda *v: F.struct(*[x.cast("double").alias(k) for k, x in zip(names, v)])
        none = pack(n, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.greatest(n, F.lit(1)))

        def of(d: Column) -> Column:
            jumps = F.transform(F.sequence(F.lit(1), F.size(d) - 1), lambda k: F.round(F.get(d, k) - F.get(d, k - 1), 8))
            total = F.aggregate(d, F.lit(0.0), lambda a, v: a + v)
            return bind(jumps, lambda j: pack(n, F.element_at(d, -1), total, total / F.size(d), F.array_max(j), F.size(d) - F.array_position(j, F.array_max(j)) + 1))

        return F.when(n < 3, none).otherwise(bind(deaths(idx), of))

    return bind(hydrophobic_positions(s), stats)


def hydrophobic_cloud(s: Column) -> Column:
    """Array of (place, x, y, z): the hydrophobic residues on an ideal helix."""
    angle = lambda i: F.radians(F.lit(float(S.HELIX_DEGREES)) * i)
    return F.transform(hydrophobic_positions(s), lambda i: F.struct(i.alias("place"), (S.HELIX_RADIUS * F.cos(angle(i))).alias("x"), (S.HELIX_RADIUS * F.sin(angle(i))).alias("y"), (S.HELIX_RISE * i).alias("z")))


def cloud_deaths(cloud: Column) -> Column:
    """Sorted deaths of the connected components of points (an array of structs x, y, z): edges of their minimum spanning tree. Empty for fewer than two points, null for a null cloud.

    Points with a null or non-finite coordinate take no part. A cloud is grown by Prim's rule in time that grows with the square of its points, and memory with their number.
    """
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    points = F.transform(F.filter(cloud, lambda p: fine(p["x"].cast("double")) & fine(p["y"].cast("double")) & fine(p["z"].cast("double"))), lambda p: F.array(*[p[c].cast("double") for c in "xyz"]))

    def run(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else vectors.deaths(np.array([list(q) for q in p], float).reshape(-1, 3)) for p in x], index=x.index, dtype=object)

    return F.pandas_udf(run, "array<double>")(points)


def helicity(s: Column, scale: float, v: float, eps: float = 1e-3) -> Column:
    """Mean helical share from a two-state transfer matrix, by a finite difference of log Z."""
    def log_z(w: Column, boost: float) -> Column:
        start = F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("log"))

        def step(st: Column, x: Column) -> Column:
            a, b = x * boost * st["a"] + st["b"] * v, st["a"] + st["b"]
            return bind(F.struct(a.alias("a"), b.alias("b")), lambda z: F.struct((z["a"] / (z["a"] + z["b"])).alias("a"), (z["b"] / (z["a"] + z["b"])).alias("b"), (st["log"] + F.log(z["a"] + z["b"])).alias("log")))

        return F.aggregate(w, start, step, lambda st: st["log"])

    weights = F.transform(values(s, S.HELIX_WEIGHT, 0.5), lambda w: F.greatest(w * scale, F.lit(1e-6)))
    mean = bind(weights, lambda w: (log_z(w, 1 + eps) - log_z(w, 1.0)) / eps)
    return F.when(F.length(s) < 4, 0.0).otherwise(F.least(F.greatest(mean / F.length(s), F.lit(0.0)), F.lit(1.0)))


def with_descriptors(df: DataFrame, seq: str = "s", topology: bool = True) -> DataFrame:
    """df with the descriptor columns, in a few projections so that generated methods stay small."""
    s, own = F.col(seq), df.columns
    n = F.greatest(F.length(s), F.lit(1))
    count = lambda a: F.col(f"_n_{a}")
    of = lambda some: sum((count(a) for a in some[1:]), count(some[0])).cast("double")
    df = df.withColumns({f"_n_{a}": count_letters(s, a) for a in S.ALPHABET}).withColumns({
        "net_charge": net_charge(s, count=count), "mean_hydrophobicity": weighted(s, S.EISENBERG, count) / n, "gravy": weighted(s, S.KYTE_DOOLITTLE, count) / n,
        "boman": weighted(s, S.BOMAN, count) / n, "mean_helix_propensity": weighted(s, S.HELIX_PROPENSITY, count) / n, "molecular_weight": weighted(s, S.RESIDUE_MASS, count) + S.WATER_MASS,
        "dg_interface": weighted(s, S.WW_INTERFACE, count), "dg_octanol": weighted(s, S.WW_OCTANOL, count), "mean_sheet_propensity": weighted(s, S.SHEET_PROPENSITY, count) / n, "length": F.length(s).cast("double"),
        "fcr": of("KRDE") / n, "ncpr": (of("KR") - of("DE")) / n, "frac_cationic": of("KR") / n, "frac_anionic": of("DE") / n, "frac_aromatic": of("FWY") / n, "frac_glycine": of("G") / n, "frac_proline": of("P") / n,
        "frac_hydrophobic": of(S.HYDROPHOBIC) / n, "n_oxidation_prone": of(S.OXIDATION_PRONE),
        "longest_hydrophobic_run": longest_run(s, S.HYDROPHOBIC), "longest_beta_branched_run": longest_run(s, S.BETA_BRANCHED),
        "n_liability_motifs": sum(((F.length(s) - F.length(F.replace(s, F.lit(m), F.lit("")))) / 2 for m in S.LIABILITY_MOTIFS), F.lit(0.0)),
        "_shaped": shaped(s, topology),
    })
    df = df.withColumns({
        "charge_density": F.col("net_charge") / n, "dg_interface_per_res": F.col("dg_interface") / n, "dg_octanol_per_res": F.col("dg_octanol") / n, "interfacial_preference": F.col("dg_octanol") - F.col("dg_interface"),
    } | {k: F.col("_shaped")[k] for k in [*vectors.POSITIONAL, "isoelectric_point", *WHEEL, *(TOPOLOGY if topology else [])]})
    made = [f for f in FEATURES if topology or f not in TOPOLOGY]
    return df.select(*[c for c in own if c not in made], *made)


def with_disorder(df: DataFrame, seq: str = "s", optimum: float = 0.18) -> DataFrame:
    """df with the nine conditional-disorder columns."""
    s = F.col(seq)
    n = F.greatest(F.length(s), F.lit(1))
    coupling = sum((count_letters(s, a) * F.lit(S.HELIX_PROPENSITY[a]) for a in S.PKA_BASE), F.lit(0.0)) / n
    df = df.withColumns({"helicity_water": helicity(s, 1.0, S.NUCLEATION_WATER), "helicity_interface": helicity(s, S.INTERFACE_BOOST, S.NUCLEATION_INTERFACE)})
    hw, hi = F.col("helicity_water"), F.col("helicity_interface")
    dev = F.pow(hw - optimum, F.lit(2.0))
    return df.withColumns({
        "helicity_gap": hi - hw, "helicity_ratio": hi / F.greatest(hw, F.lit(1e-3)), "switchability": (hi - hw) * F.exp(-dev / (2 * 0.10**2)), "water_optimum_dev": dev,
        "prefold_risk": hw * count_letters(s, S.HYDROPHOBIC) / n, "charge_helix_coupling": coupling, "helicity_length_product": hi * F.length(s),
    })
