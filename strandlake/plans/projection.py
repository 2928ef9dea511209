"""Deterministic projection of the test tables onto sequences and activity records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions.scales import ALPHABET, MAX_LENGTH, MIN_LENGTH

UNITS = ["uM", "nM", "ug/ml", "mg/ml", "CFU"]
SPECIES = ["Escherichia coli ATCC 25922", "Staphylococcus aureus ATCC 43300", "Candida albicans", "Bacillus subtilis", "Pseudomonas aeruginosa (multidrug resistant)", "Homo sapiens", "Klebsiella pneumoniae ATCC 700603", "Enterococcus faecalis VRE"]
MEASURES = ["MIC", "MIC50", "IC50", "mic_90"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentences(df: DataFrame, key: str) -> DataFrame:
    """ord, s: every sentence of every whole text, reduced to residue letters, where 8 to 50 of them are left."""
    part = df.select(F.col(key).alias("k"), F.posexplode(F.split("text", "[.\\n]")).alias("pos", "x"))
    s = F.regexp_replace(F.upper(F.regexp_replace("x", "[^A-Za-z]", "")), f"[^{ALPHABET}]", "")
    return part.select((F.col("k") * 1_000_000 + F.col("pos")).alias("ord"), s.alias("s")).where(F.length("s").between(MIN_LENGTH, MAX_LENGTH))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"), "doc_id")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "benchmark"), "item_id")


SENTENCES_SQL = """SELECT k * 1000000 + pos AS ord, s FROM (
  SELECT {key} AS k, pos - 1 AS pos, regexp_replace(upper(regexp_replace(x, '[^A-Za-z]', '', 'g')), '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g') AS s
  FROM (SELECT {key}, unnest(p) AS x, unnest(range(1, len(p) + 1)) AS pos FROM (SELECT {key}, string_split_regex(text, '[.\\n]') AS p FROM {table}))) WHERE length(s) BETWEEN 8 AND 50"""
LIBRARY_SQL = SENTENCES_SQL.format(key="doc_id", table="documents")
REFERENCES_SQL = SENTENCES_SQL.format(key="item_id", table="benchmark")


#: Events with neighbouring ids that are dealt together (as a power of two), and tasks a core that they are dealt to.
EVENT_BLOCK, EVENT_TASKS = 13, 4


def record_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One NDJSON line (column value) per event: enum fields are objects or strings by turns, some lines are broken.

    Each piece stands in the expression once: methods that Spark generates from more are over 8,000 bytes, which the JVM doesn't compile.
    """
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    # a file has at most as many tasks as row groups, which may be one: blocks of events in fewer files than cores are dealt to all
    if 0 < len(e.inputFiles()) < spark.sparkContext.defaultParallelism:
        e = e.repartition(EVENT_TASKS * spark.sparkContext.defaultParallelism, F.shiftright("event_id", EVENT_BLOCK))
    pick = lambda words, i: F.get(F.array(*[F.lit(w) for w in words]), i.cast("int"))
    v = F.round(F.abs("value") * 10).cast("long") + 1
    m = F.col("event_id") % 7
    seq = F.substring(F.translate(F.md5(F.col("user_id").cast("string").cast("binary")), "0123456789abcdef", "ACDEFGHIKLMNPQRS"), 1, 32)
    seq = F.when(F.col("event_id") % 17 == 0, "XXX").otherwise(F.substr(seq, F.lit(1), (12 + F.col("user_id") % 15).cast("int")))
    quote = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    even = F.col("event_id") % 2 == 0
    enum = lambda c: F.concat(F.when(even, '{"name":"').otherwise('"'), c, F.when(even, '"}').otherwise('"'))
    unit = pick(UNITS, F.col("event_id") % 5)
    sign, rest = F.when(m == 1, ">").when(m == 2, "<").otherwise(""), F.when(m == 3, F.concat(F.lit("-"), (2 * v).cast("string"))).when(m == 5, ",5").otherwise("")
    number = F.when(m == 6, "100").when(m == 4, '"NA"').otherwise(quote(F.concat(sign, v.cast("string"), rest)))
    blood = F.col("event_id") % 3 == 0
    cell = pick(["Human erythrocytes", "Mouse erythrocytes"], F.col("event_id") % 2)
    mic = F.concat(F.lit('{"activityMeasureGroup":'), enum(pick(MEASURES, F.col("event_id") % 4)), F.lit(',"targetSpecies":'), enum(pick(SPECIES, F.col("user_id") % 8)))
    hc = F.concat(F.lit('],"hemoliticCytotoxicActivities":[{"targetCell":'), enum(cell))
    line = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"sequence":'), quote(seq), F.lit(',"complexity":'), enum(F.when(F.col("event_id") % 11 == 0, "Dimer").otherwise("Monomer")),
        F.lit(',"unusualAminoAcids":'), F.when(F.col("event_id") % 13 == 0, '["x"]').otherwise("[]"), F.lit(',"cTerminus":'), F.when(F.col("event_id") % 6 == 0, enum(F.lit("AMD"))).otherwise("null"),
        F.lit(',"targetActivities":['), F.when(blood, hc).otherwise(mic), F.lit(',"concentration":'), number, F.lit(',"unit":'), enum(unit), F.when(blood, "}]}").otherwise('}],"hemoliticCytotoxicActivities":[]}'),
    )
    return e.select(F.when(F.col("event_id") % 19 == 0, "{bad").otherwise(line).alias("value"))


def _case(words: list[str], expr: str) -> str:
    return "CASE " + expr + " " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


#: The long table of kept measurements, from the events alone.
MEASUREMENTS_SQL = f"""
SELECT id, s, endpoint, grp, species, endpoint = 'mic' AND user_id % 8 IN (1, 4, 6, 7) AS resistant, value_um, censor, id % 6 = 0 AS amidated FROM (
 SELECT id, user_id, s, endpoint, CASE WHEN endpoint = 'hc50' THEN 'hc50' WHEN user_id % 8 IN (1, 3, 7) THEN 'gram_positive' WHEN user_id % 8 IN (0, 4, 6) THEN 'gram_negative' END AS grp, species,
  CASE id % 5 WHEN 0 THEN val WHEN 1 THEN val / 1000.0 WHEN 2 THEN val * 1000.0 / mw WHEN 3 THEN val * 1e6 / mw END AS value_um,
  CASE WHEN endpoint = 'hc50' AND code = 0 AND val IN (10, 20, 25, 32, 50, 64, 100, 128, 150, 200, 250, 256, 300, 400, 500, 512, 1000) THEN 1 ELSE code END AS censor
 FROM (SELECT event_id AS id, user_id, s, CASE WHEN event_id % 3 = 0 THEN 'hc50' ELSE 'mic' END AS endpoint,
   CASE WHEN event_id % 3 = 0 THEN CASE event_id % 2 WHEN 0 THEN 'Human erythrocytes' ELSE 'Mouse erythrocytes' END ELSE {_case(SPECIES, "user_id % 8")} END AS species,
   CASE event_id % 7 WHEN 3 THEN 2.0 * v WHEN 4 THEN NULL WHEN 5 THEN v + 0.5 WHEN 6 THEN 100.0 ELSE CAST(v AS DOUBLE) END AS val,
   CASE event_id % 7 WHEN 1 THEN 1 WHEN 2 THEN -1 WHEN 3 THEN 2 ELSE 0 END AS code,
   18.0153 + list_sum(list_transform(string_split(s, ''), lambda c: {{mass}})) AS mw
  FROM (SELECT event_id, user_id, CAST(round(abs(value) * 10) AS BIGINT) + 1 AS v, substr(translate(md5(CAST(user_id AS VARCHAR)), '0123456789abcdef', 'ACDEFGHIKLMNPQRS'), 1, CAST(12 + user_id % 15 AS BIGINT)) AS s FROM events
   WHERE event_id % 19 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0)
  WHERE CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 ELSE event_id % 4 <> 2 END))
WHERE grp IS NOT NULL AND value_um IS NOT NULL
"""


# ---- a table as a paged index: what a fetch sees of a service

#: Records of a stored page.
INDEX_PAGE = 100


def write_index(df: DataFrame, key: str, path: str) -> int:
    """Store df under `path` as pages of INDEX_PAGE records in order of the key, a page a Parquet folder; how many records there are.

    Records are numbered by ranges of the key and the numbers of rows in the ranges before."""
    from pyspark.sql import Window

    from strandlake.operators.storage import durable

    rows = durable(df.withColumnRenamed(key, "id").repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    numbered = rows.join(F.broadcast(before), "part").withColumn("place", place).drop("part", "before").withColumn("page", F.floor(F.col("place") / INDEX_PAGE))
    numbered.write.partitionBy("page").parquet(f"{path}/pages")
    return rows.count()


def _files(path: str):
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system, place


def set_index_total(spark: SparkSession, path: str, total: int) -> None:
    system, place = _files(path)
    with system.open_output_stream(f"{place}/total") as f:
        f.write(str(total).encode())


def index_total(path: str) -> int:
    system, place = _files(path)
    with system.open_input_stream(f"{place}/total") as f:
        return int(f.read())


def index_page(start: int, stop: int, path: str) -> list[dict]:
    """Records start to stop of the index, from the pages that hold them."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, place = _files(path)
    out = []
    for page in range(start // INDEX_PAGE, (stop - 1) // INDEX_PAGE + 1):
        for f in system.get_file_info(fs.FileSelector(f"{place}/pages/page={page}")):
            if f.path.endswith(".parquet"):
                with system.open_input_file(f.path) as g:
                    out += [r for r in pq.read_table(g).to_pylist() if start <= r["place"] < stop]
    return sorted(out, key=lambda r: r["place"])
