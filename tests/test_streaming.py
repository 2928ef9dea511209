"""Files are read once each, also over restarts."""

import json

from strandlake.streaming.append import append_measurements


def test_append_resumes(spark, tmp_path):
    act = {"activityMeasureGroup": "MIC", "targetSpecies": "Escherichia coli", "concentration": "8", "unit": "uM"}
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    src.mkdir()
    for i in range(2):
        (src / f"{i}.ndjson").write_text(json.dumps({"id": i, "sequence": "AAAAAAAA", "complexity": "monomer", "targetActivities": [act]}) + "\n{bad\n")
        append_measurements(spark, str(src), out, mark).awaitTermination(60)
        assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(i + 1))
