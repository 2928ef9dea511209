"""Sources and sinks: CSV, JSON, paged indexes, resumable fetches."""

import json
import os
import random

import pytest

from strandlake.operators import tables as T
from strandlake.sources import records, tables

CALLS: list[int] = []


def fetch_one(i):
    if i == 13:
        raise LookupError
    return {"id": i, "sequence": "KLAKLAKLAKLA"}


def fetch_page(start, stop):
    return [{"id": i} for i in range(start, stop)]


def count_all():
    return 25


def test_status_policy():
    def failing(*codes):
        left = list(codes)

        def get():
            if left:
                raise records.Status(left.pop(0))
            return "ok"

        return get

    waits = []
    assert records.with_retries(failing(503, 429), 4, 1.0, waits.append) == "ok" and waits == [1.0, 2.0]
    assert records.with_retries(failing(404), 4, 1.0, waits.append) is None
    with pytest.raises(records.Status):
        records.with_retries(failing(403), 4, 1.0, waits.append)
    assert waits == [1.0, 2.0]
    with pytest.raises(records.Status):
        records.with_retries(failing(500, 500), 2, 1.0, waits.append)


def test_get_json_over_http(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    answers = [(500, b""), (200, b"{broken"), (200, b'{"a": 1}'), (404, b"")]

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            code, body = answers.pop(0)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}/x", []
    assert records.get_json(url, 4, 0.5, 5.0, waits.append) == {"a": 1} and waits == [0.5, 1.0]
    assert records.get_json(url, 4, 0.5, 5.0, waits.append) is None
    server.shutdown()


def test_collect_ids():
    pages = {0: {"totalCount": 7, "data": [{"id": 1}, {"id": None}, {"id": "3"}]}, 3: {"data": [{"id": 4}, {"id": 5}]}, 5: {"data": [{"id": 6}, {"id": 7}]}}
    asked = []

    def get(offset, size):
        asked.append((offset, size))
        return pages.get(offset)

    assert list(records.collect_ids(get, 3)) == [1, 3, 4, 5, 6, 7] and asked == [(0, 3), (3, 3), (5, 3)]
    assert list(records.collect_ids(get, 3, most=3)) == [1, 3, 4]
    assert list(records.collect_ids(lambda o, n: {"data": [{"id": 9}]} if o == 0 else {"data": []})) == [9]
    assert list(records.collect_ids(lambda o, n: None)) == []


def test_fetch_goes_on_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "raw")
    ids = spark.createDataFrame([(i,) for i in (1, 2, 13, 2, None)], "id long")
    assert records.fetch_records(ids, path, "tests.test_sources:fetch_one") == 3
    assert sorted(r["id"] for r in records.fetched_ids(spark, path).collect()) == [1, 2]
    more = ids.unionByName(spark.createDataFrame([(4,)], "id long"))
    assert records.fetch_records(more, path, "tests.test_sources:fetch_one") == 2  # 13 is tried again
    assert sorted(r["id"] for r in records.fetched_ids(spark, path).collect()) == [1, 2, 4]
    (tmp_path / "raw" / "broken.txt").write_text('{"id": 99')
    assert records.fetched_ids(spark, path).count() == 3
    usable = records.parse_records(spark.read.text(path)).where("s is not null")
    assert usable.count() == 3


def test_paged_source(spark):
    spark.dataSource.register(records.PagedSource)
    load = lambda **o: spark.read.format("paged_records").options(fetcher="tests.test_sources:fetch_page", pageSize=10, **o).load()
    for options in ({"total": 25}, {"counter": "tests.test_sources:count_all"}):
        df = load(**options)
        assert df.rdd.getNumPartitions() == 3 and sorted(r["id"] for r in df.collect()) == list(range(25))
    assert json.loads(load(total=1).first()["value"]) == {"id": 0}


def test_csv_tables(spark, tmp_path):
    rows = [("KLAK", "mic", "gram_negative", 'E. "coli", x', True, 1.5, 1, False), ("KLAKK", "hc50", "hc50", "Human", False, 250.0, 0, None)]
    long = spark.createDataFrame(rows, "s string, endpoint string, grp string, species string, resistant boolean, value_um double, censor int, amidated boolean").withColumn("id", T.F.lit(1))
    tables.write_long(long, str(tmp_path / "long"))
    back = tables.read_long(spark, str(tmp_path / "long"))
    assert sorted(map(tuple, back.collect())) == sorted(rows) and back.columns[0] == "s"
    wide = T.to_wide(T.aggregate_activity(long.withColumn("drop_reason", T.F.lit(None).cast("string"))))
    tables.write_wide(wide, str(tmp_path / "wide"))
    again = tables.read_wide(spark, str(tmp_path / "wide")).select(*wide.columns)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, wide.collect()), key=str)
    part = next((tmp_path / "wide").glob("part-*"))
    assert part.read_text().startswith("sequence,gram_negative,")


def test_json_summaries(spark, tmp_path):
    value = {"gram_negative": {"n": 3, "mae": 0.5, "note": None}, "windows": [1.0, 2.0]}
    tables.write_json(spark, value, str(tmp_path / "m"))
    assert tables.read_json(spark, str(tmp_path / "m")) == value
    df = spark.createDataFrame([("b", 2, None), ("a", 1, 0.5)], "name string, n int, v double")
    assert tables.summary(df, "name") == {"a": {"n": 1, "v": 0.5}, "b": {"n": 2, "v": None}}



def plain_fasta(text):
    """Records by lines, as a reference reader does."""
    out, now = [], ""
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith(">"):
            out.append(now)
            now = ""
        else:
            now += line
    return [s.upper() for s in [*out, now] if s]


def test_fasta_across_block_borders(spark, tmp_path):
    rng = random.Random(6)
    texts = ["ACDEF\n>a\nKL\nmn\n\n  pq  \n>b>c x\nRST\n>empty\n>\nVW", "\n \n>x\nAAA\n  >y\nCCC\r\n>z\r\nDD\r\nEE", "", ">only", "\n".join(f">r{i} {'>' * (i % 3)}\n" + "\n".join("".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randint(1, 60))) for _ in range(i % 4)) for i in range(400))]
    folder = tmp_path / "in"
    folder.mkdir()
    for i, t in enumerate(texts):
        (folder / f"f{i}.fa").write_bytes(t.encode())
    want = [s for t in texts for s in plain_fasta(t)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128m", "997", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = records.read_fasta(spark, str(folder)).orderBy("ord").collect()
            assert [r["s"] for r in got] == want and [r["ord"] for r in got] == list(range(1, len(want) + 1))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_fasta_is_written_in_parts(spark, tmp_path):
    rows = [(i * 3, "ACDE" * (1 + i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "rank long, s string").repartition(5)
    path = tmp_path / "out"
    records.write_fasta(df, str(path), records=60)
    parts = sorted(p for p in path.iterdir() if p.name.startswith("part-"))
    whole = "".join(p.read_text() for p in parts)
    assert len(parts) > 4 and whole == "".join(f">seq{i}\n{s}\n" for i, (_, s) in enumerate(rows, 1))
    back = records.read_fasta(spark, str(path)).orderBy("ord").collect()
    assert [tuple(r) for r in back] == [(i, s) for i, (_, s) in enumerate(rows, 1)]
    records.write_fasta(df.limit(0), str(tmp_path / "none"))
    assert records.read_fasta(spark, str(tmp_path / "none")).count() == 0


def growing_page(start, stop, path):
    with open(f"{path}/asked", "a") as f:
        f.write(f"{start}-{stop} ")
    if os.path.exists(f"{path}/fail") and start >= 20:
        raise records.Status(403)
    return [{"id": i} for i in range(start, stop)]


def growing_total(path):
    with open(f"{path}/total") as f:
        return int(f.read())


def test_stream_of_a_growing_index(spark, tmp_path):
    options = {"fetcher": "tests.test_sources:growing_page", "counter": "tests.test_sources:growing_total", "argument": str(tmp_path), "pageSize": "10"}
    fetch = lambda: records.fetch_stream(spark, options, str(tmp_path / "lines"), str(tmp_path / "log"))
    seen = lambda: sorted(json.loads(r["value"])["id"] for r in spark.read.text(str(tmp_path / "lines")).collect())
    (tmp_path / "total").write_text("15")
    fetch()
    assert seen() == list(range(15)) and sorted((tmp_path / "asked").read_text().split()) == ["0-10", "10-15"]
    fetch()  # nothing new
    assert seen() == list(range(15))
    # a batch that breaks off is fetched again as a whole, and no record is there twice
    (tmp_path / "total").write_text("37")
    (tmp_path / "fail").write_text("")
    with pytest.raises(Exception):
        fetch()
    assert seen() == list(range(15))
    (tmp_path / "fail").unlink()
    (tmp_path / "asked").write_text("")
    fetch()
    # (tasks of the broken batch may still ask)
    assert seen() == list(range(37)) and set((tmp_path / "asked").read_text().split()) == {"15-25", "25-35", "35-37"}
    # an index that shrinks, then grows
    for total, n in (("3", 37), ("40", 40)):
        (tmp_path / "total").write_text(total)
        fetch()
        assert seen() == list(range(n))


def test_counters_of_the_writing_pass(spark, tmp_path):
    act = lambda **k: {"activityMeasureGroup": {"name": "MIC"}, "targetSpecies": "Escherichia coli", "concentration": "8", "unit": "uM"} | k
    rec = lambda **k: json.dumps({"id": 1, "sequence": "KLAKLAKLAK", "complexity": "Monomer", "targetActivities": [act(), act(unit="?"), act(concentration="x"), act(targetSpecies="Candida")]} | k)
    lines = spark.createDataFrame([(x,) for x in (rec(), rec(complexity="Dimer"), rec(sequence="XX"), "{bad", " ", rec(targetActivities=None))], "value string").repartition(3)
    got = records.ingest(lines, lambda df: df.write.parquet(str(tmp_path / "kept")))
    assert got == {tuple(r)[:2]: r["n"] for r in records.drop_counts(lines).collect()}
    assert got["measurement", "kept"] == spark.read.parquet(str(tmp_path / "kept")).count() == 1 and got["record", "usable"] == 2


def test_records_are_read_by_compiled_methods(spark, capsys):
    """The JVM doesn't compile methods over 8,000 bytes; records of millions of lines took twice as long by one of 15,339."""
    import re

    from strandlake.plans import projection

    e = spark.createDataFrame([(i, i % 9, float(i)) for i in range(40)], "event_id long, user_id long, value double")
    was, projection.table = projection.table, lambda *_: e
    try:
        lines = projection.record_lines(spark, "")
    finally:
        projection.table = was
    # rows of an RDD: a local table's lines would be made while the plan is
    kept = spark.createDataFrame(lines.rdd, "value string")
    for df in (lines.select("value"), records.measurements(records.parse_records(kept))):
        capsys.readouterr()
        df.explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
        assert sizes and max(sizes) < 8000


def test_names_of_enum_fields(spark):
    from pyspark.sql import functions as F

    from strandlake.functions import cleaning as C

    texts = ['{"k":{"name":"a"}}', '{"k":"b"}', '{"k":{"id":1}}', '{"k":{"name":null}}', '{"k":null}', "{}", '{"k":"{c"}', '{"k":["d"]}', '{"k":1.50}', '{"k":{}}', "{bad"]
    want = ["a", "b", "", "", "", "", "{c", '["d"]', "1.5", "", ""]
    v = spark.createDataFrame(list(enumerate(texts)), "i int, value string").select("i", F.try_parse_json("value").alias("v"))
    got = v.select("i", C.name_of(F.col("v"), "$.k").alias("at"), C.name_of(F.try_variant_get("v", "$.k", "variant")).alias("own")).orderBy("i").collect()
    assert [r["at"] for r in got] == want == [r["own"] for r in got]


def test_kept_measurements_run_in_methods_that_the_jvm_compiles(spark, capsys):
    """The filter on drop_reason, with all that it reads inlined, made a method of 12,736 bytes."""
    import re

    kept = spark.createDataFrame(spark.sparkContext.parallelize([('{"id":1}',)]), "value string")
    capsys.readouterr()
    # what aggregate_activity reads, before its shuffle
    records.measurements(records.parse_records(kept)).where("drop_reason is null").selectExpr("s", "explode(CASE WHEN resistant THEN array(grp, 'resistant') ELSE array(grp) END) AS grp", "value_um", "censor", "amidated").explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_events_of_one_file_are_dealt_to_all_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandlake.plans import projection as P

    spark.range(200_000).select(F.col("id").alias("event_id"), (F.col("id") % 9).alias("user_id"), F.col("id").cast("double").alias("value")).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    parts = P.record_lines(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(r["count"] for r in parts) == 200_000 and len(parts) > 1 and max(r["count"] for r in parts) < 150_000


def test_fields_of_odd_records(spark):
    """Fields read as a whole are those that paths give one by one, for enum fields of any kind, in records and in measurements."""
    from pyspark.sql import functions as F

    from strandlake.functions import cleaning as C

    odd = ['{"name":"a"}', '"b"', '{"id":1}', '{"name":null}', "null", '"{c"', '["d"]', "1.50", "{}", '{"name":{"x":1}}', '{"name":"e","id":2}', "true"]
    base = '{"id":%s,"sequence":"KLAKLAKLAK","complexity":"Monomer","unusualAminoAcids":%s,"cTerminus":%s,"targetActivities":[%s],"hemoliticCytotoxicActivities":%s}'
    act = '{"activityMeasureGroup":%s,"activityMeasureValue":"MIC","targetSpecies":%s,"concentration":%s,"unit":%s}'
    lines = [base % (i, "[]", x, act % (x, x, x, x), "null") for i, x in enumerate(odd)]
    lines += [base % ('"7"', "{}", '"AMD"', "5,null,[1]," + act % ('"MIC"', '"Escherichia coli"', 100, '"uM"'), '[{"targetCell":{"name":"Human erythrocytes"},"concentration":"5","unit":"nM"},"x"]'), base % ("1.5", '["x"]', "null", "", "3"), base % ('"x"', "null", '""', "", "[]"), "[1]", "null", "7", "{bad", '{"id":1,"id":2}', '{"targetActivities":{"a":1}}']
    lines += ['{"complexity":%s,"nTerminus":%s}' % (x, x) for x in odd]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    name = lambda k, v="v": C.name_of(F.col(v), f"$.{k}")
    rec = records.parse_records(df)
    get = lambda k, t, v="v": F.try_variant_get(v, f"$.{k}", t)
    paths = rec.select(get("id", "long").alias("id"), C.clean_sequence(get("sequence", "string")).alias("s"), F.lower(name("complexity")).alias("complexity"), F.coalesce(F.size(get("unusualAminoAcids", "array<variant>")), F.lit(0)).alias("unusual"), C.is_modified(name("nTerminus"), name("cTerminus")).alias("modified"))
    assert rec.select(*paths.columns).collect() == paths.collect()
    ok = rec.where("drop_reason is null")
    own = [ok.select("id", "s", "modified", F.lit(e).alias("endpoint"), F.explode(get(k, "array<variant>")).alias("a")) for k, e in (("targetActivities", "mic"), ("hemoliticCytotoxicActivities", "hc50"))]
    group = name("activityMeasureGroup", "a")
    rows = own[0].unionByName(own[1]).select("id", "s", "modified", "endpoint", F.when(group != "", group).otherwise(F.coalesce(get("activityMeasureValue", "string", "a"), F.lit(""))).alias("measure"),
        F.when(F.col("endpoint") == "mic", name("targetSpecies", "a")).otherwise(name("targetCell", "a")).alias("species"), C.concentration(get("concentration", "string", "a")).alias("c"), name("unit", "a").alias("unit"))
    want = records.classify(rows.select("id", "s", "modified", "endpoint", "measure", "species", F.col("c.value").alias("value"), F.col("c.censor").alias("code"), "unit"))
    got = records.measurements(rec)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == len(odd) + 6
