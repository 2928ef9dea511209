"""Every branch of the record cleaning."""

import json

import pytest
from pyspark.sql import functions as F

from strandlake.functions import cleaning as C
from strandlake.sources import records


@pytest.mark.parametrize("raw,value,code", [("8", 8, 0), ("NA", None, 0), (">100", 100, 1), ("≥64", 64, 1), ("<2", 2, -1), ("4-8", 8, 2), ("4–8", 8, 2), ("12.5±2", None, 0), ("1,5", 1.5, 0), ("1,000", 1.0, 0), ("", None, 0), (None, None, 0)])
def test_concentration(spark, raw, value, code):
    r = spark.createDataFrame([(raw,)], "r string").select(C.concentration(F.col("r")).alias("c")).first()["c"]
    assert (r["value"], r["censor"]) == (value, code)


def test_units_and_ceilings(spark):
    rows = [(1.0, u) for u in ["µM", "μM", "nM", "mM", "ug/ml", "mg/ml", "ng/ml", "CFU"]] + [(0.0, "uM"), (-1.0, "uM"), (float("inf"), "uM")]
    got = [r[0] for r in spark.createDataFrame(rows, "v double, u string").select(C.to_micromolar(F.col("v"), F.col("u"), F.lit("AAAAAAAA"))).collect()]
    mw = 8 * 71.0788 + 18.0153
    assert got[:7] == pytest.approx([1, 1, 1e-3, 1e3, 1e3 / mw, 1e6 / mw, 1 / mw]) and got[7:] == [None] * 4
    ceil = spark.createDataFrame([(100.0, 0), (101.0, 0), (100.0, 2)], "v double, c int").select(C.with_ceiling(F.col("v"), F.col("c"))).collect()
    assert [r[0] for r in ceil] == [1, 0, 2]


def test_records(spark):
    act = {"activityMeasureGroup": {"name": "MIC"}, "targetSpecies": "Escherichia coli", "concentration": 8, "unit": {"name": "uM"}}
    good = {"id": 1, "sequence": " aaaaaaaa ", "complexity": {"name": "Monomer"}, "targetActivities": [act, act | {"unit": {}}, act | {"targetSpecies": "Candida"}], "cTerminus": "AMD"}
    lines = [json.dumps(good), "{bad", "", json.dumps(good | {"complexity": "dimer"}), json.dumps(good | {"unusualAminoAcids": ["x"]}), json.dumps(good | {"sequence": None})]
    rec = records.parse_records(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(str(r["drop_reason"]) for r in rec.collect()) == ["None", "bad_json", "bad_sequence", "not_monomer", "unusual_residues"]
    got = records.measurements(rec).collect()
    assert sorted((r["drop_reason"] or "kept", r["value_um"]) for r in got if r["drop_reason"] != "not_bacterial") == [("bad_unit", None), ("kept", 8.0)] and all(r["amidated"] for r in got)


def test_fasta_round_trip(spark, tmp_path):
    p = tmp_path / "x.fasta"
    p.write_text("acdef\n>one\nKLM\n\nnpq\n>two\nRST")
    assert [r["s"] for r in records.read_fasta(spark, str(p)).orderBy("ord").collect()] == ["ACDEF", "KLMNPQ", "RST"]
    records.write_fasta(spark.createDataFrame([(2, "BB"), (1, "AA")], "rank int, s string"), str(tmp_path / "out"))
    assert "".join(f.read_text() for f in sorted((tmp_path / "out").glob("part-*"))) == ">seq1\nAA\n>seq2\nBB\n"


def test_retries():
    calls, waits = [], []

    def get():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert records.with_retries(get, 4, 2.0, waits.append) == 7 and waits == [2.0, 4.0]
