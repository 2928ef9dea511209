"""Sources and sinks: FASTA, NDJSON activity records, paged and resumable fetches. CSV tables and JSON summaries are in tables.py."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from strandlake.functions import cleaning as C
from strandlake.operators.storage import durable


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """ord (1, 2, ...), s: records in the order of files' names and their places; lines trimmed and joined, blanks dropped, upper case, headers dropped, empty records left out.

    A record begins at a line whose first character (after blanks) is `>`; text before a file's first header is a record. Files are read in blocks: a record that crosses
    a block's border belongs to the block that it begins in. Records are numbered within their block, and blocks by the numbers of records before them (a table of one row a
    block), so no task gets a whole file.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    in_block = Window.partitionBy("file", "block").orderBy("at")
    # the separator takes the sign from all records but a file's first, which has one after blanks, or has no header
    first, bare = (F.col("block") == 0) & (F.row_number().over(in_block) == 1), F.regexp_replace("value", "^\\s+", "")
    alike = F.when(first & bare.startswith(">"), F.substr(bare, F.lit(2))).when(first, F.concat(F.lit("\n"), "value")).otherwise(F.col("value"))
    rows = raw.withColumn("value", alike).select("file", "block", "at", F.posexplode(F.split("value", "\n[ \\t\\r\\f\\x0B]*>")).alias("sub", "text"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    body = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    rows = rows.select("file", "block", "at", "sub", F.upper(F.array_join(body, "")).alias("s")).where("s <> ''")
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("file", "block").orderBy("at", "sub")))
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("size"))
    before = blocks.select("file", "block", F.coalesce(F.sum("size").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(before), ["file", "block"]).select((F.col("before") + F.col("n")).alias("ord"), "s")


def write_fasta(df: DataFrame, path: str, rank_col: str = "rank", seq_col: str = "s", records: int = 1_000_000) -> None:
    """`>seq{i}` records in order of rank, i counting from 1, in parts whose names are in that order: `records` in each, roughly.

    Rows are sorted by ranges of rank, and each part's numbers begin after the counts of the parts before (one number a part on the driver). Parts are committed as a whole by Spark's writer.
    """
    parts = max(1, -(-df.count() // records))
    # the number of a row's part is in the upper bits
    rows = durable(df.select(F.col(rank_col).alias("rank"), F.col(seq_col).alias("s")).repartitionByRange(parts, "rank").sortWithinPartitions("rank", "s").withColumn("at", F.monotonically_increasing_id()))
    sizes = {r["part"]: r["count"] for r in rows.groupBy(F.shiftright("at", 33).alias("part")).count().collect()}
    before, sum_ = [], 0
    for i in range(max(sizes, default=0) + 1):
        before.append(sum_)
        sum_ += sizes.get(i, 0)
    number = F.get(F.array(*[F.lit(b) for b in before]), F.shiftright("at", 33).cast("int")) + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    rows.select(F.concat(F.lit(">seq"), number.cast("string"), F.lit("\n"), F.col("s")).alias("value")).write.mode("overwrite").text(path)


#: Enum-like fields, which are objects with a name or plain values, and the other fields that are read as text.
ENUMS, TEXTS = ["complexity", "nTerminus", "cTerminus"], ["sequence"]
ACTIVITY_ENUMS, ACTIVITY_TEXTS = ["activityMeasureGroup", "targetSpecies", "targetCell", "unit"], ["activityMeasureValue", "concentration"]


def _as_text(names: list[str]) -> str:
    return ", ".join(f"{n}: string" for n in names)


def _as_object(names: list[str]) -> str:
    return ", ".join(f"{n}: struct<name: string>" for n in names)


def _name(text: Column, named: Column, field: str) -> Column:
    """As cleaning.name_of, of a field that was read as text and as an object (null where it isn't one): an object's `name`, else the value as text; '' where missing."""
    return F.coalesce(F.when(named[field].isNotNull(), named[field]["name"]).otherwise(text[field]), F.lit(""))


def parse_records(lines: DataFrame) -> DataFrame:
    """Records from NDJSON lines (column value): fields, and drop_reason (null for usable ones). Blank lines are skipped.

    Filters hold in order: bad JSON, not a monomer, unusual residues, bad sequence.
    """
    # exploded, so that filters on what follows aren't pushed below: they would parse a line anew for each field
    v = lines.where(F.trim("value") != "").select(F.explode(F.array(F.try_parse_json("value"))).alias("v"))
    # all fields in two reads of the VARIANT: a read of one field by its path costs as much as of all
    read = F.struct(
        F.try_variant_get("v", "$", f"struct<id: bigint, unusualAminoAcids: array<variant>, {_as_text(TEXTS + ENUMS)}>").alias("text"), F.try_variant_get("v", "$", f"struct<{_as_object(ENUMS)}>").alias("named")
    )
    v = v.select("v", F.explode(F.array(read)).alias("r"))
    name = lambda k: _name(F.col("r.text"), F.col("r.named"), k)
    rec = v.select(
        "v", F.col("r.text.id").alias("id"), C.clean_sequence(F.col("r.text.sequence")).alias("s"), F.lower(name("complexity")).alias("complexity"),
        F.coalesce(F.size("r.text.unusualAminoAcids"), F.lit(0)).alias("unusual"), C.is_modified(name("nTerminus"), name("cTerminus")).alias("modified"),
    )
    reason = F.when(F.col("v").isNull(), "bad_json").when(F.col("complexity") != "monomer", "not_monomer").when(F.col("unusual") > 0, "unusual_residues").when(F.col("s").isNull(), "bad_sequence")
    return rec.withColumn("drop_reason", reason)


def measurements(records: DataFrame) -> DataFrame:
    """Long table of the usable records' measurements, each with drop_reason (null for those that are kept).

    Both nested arrays are exploded in one pass: they are put into one array first, so records are read once.
    """
    ok = records.where("drop_reason is null")
    fields = {"text": _as_text(ACTIVITY_TEXTS + ACTIVITY_ENUMS), "named": _as_object(ACTIVITY_ENUMS)}

    def acts(key: str, kind: str) -> Column:
        both = F.arrays_zip(*[F.try_variant_get("v", f"$.{key}", f"array<struct<{f}>>").alias(n) for n, f in fields.items()])
        return F.transform(F.coalesce(both, F.array().cast(f"array<struct<{', '.join(f'{n}: struct<{f}>' for n, f in fields.items())}>>")), lambda a: F.struct(F.lit(kind).alias("endpoint"), a["text"].alias("text"), a["named"].alias("named")))

    rows = ok.select("id", "s", "modified", F.explode(F.concat(acts("targetActivities", "mic"), acts("hemoliticCytotoxicActivities", "hc50"))).alias("x")).select("id", "s", "modified", "x.endpoint", "x.text", "x.named")
    name = lambda k: _name(F.col("text"), F.col("named"), k)
    group_name = name("activityMeasureGroup")
    measure = F.when(group_name != "", group_name).otherwise(F.coalesce("text.activityMeasureValue", F.lit("")))
    mic = F.col("endpoint") == "mic"
    rows = rows.select("id", "s", "modified", "endpoint", measure.alias("measure"), F.when(mic, name("targetSpecies")).otherwise(name("targetCell")).alias("species"), C.concentration(F.col("text.concentration")).alias("c"), name("unit").alias("unit"))
    rows = rows.select("id", "s", "modified", "endpoint", "measure", "species", "unit", F.explode(F.array("c")).alias("c"))
    return classify(rows.select("id", "s", "modified", "endpoint", "measure", "species", F.col("c.value").alias("value"), F.col("c.censor").alias("code"), "unit"))


def classify(rows: DataFrame) -> DataFrame:
    """group, resistant, value_um, censor and drop_reason of parsed measurements."""
    mic = F.col("endpoint") == "mic"
    cell = F.lower("species")
    made = F.struct(
        F.when(mic, C.gram_class(F.col("species"))).otherwise("hc50").alias("grp"), (mic & C.is_resistant(F.col("species"))).alias("resistant"),
        C.to_micromolar(F.col("value"), F.col("unit"), F.col("s")).alias("value_um"), F.when(mic, F.col("code")).otherwise(C.with_ceiling(F.col("value"), F.col("code"))).alias("censor"),
    )
    # exploded, so that a filter on drop_reason reads what is made once: with all of it inlined the method is too long for the JVM to compile
    rows = rows.select("*", F.explode(F.array(made)).alias("made")).select("*", "made.*").drop("made")
    reason = (
        F.when(mic & ~C.is_measure(F.col("measure")), "not_mic").when(mic & F.col("grp").isNull(), "not_bacterial").when(~mic & ~cell.contains("erythrocyte"), "not_erythrocyte")
        .when(~mic & ~cell.contains("human"), "not_human").when(F.col("value").isNull(), "unreadable_value").when(F.col("value_um").isNull(), "bad_unit")
    )
    return rows.select("id", "s", "endpoint", "grp", "species", "resistant", "value_um", "censor", F.col("modified").alias("amidated"), reason.alias("drop_reason"))


def fetched_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids on disk; lines that can't be read are tolerated."""
    return spark.read.text(path).select(F.try_variant_get(F.try_parse_json("value"), "$.id", "long").alias("id")).where("id is not null").distinct()


def still_to_fetch(ids: DataFrame, done: DataFrame) -> DataFrame:
    return ids.join(done, "id", "left_anti")


class Status(Exception):
    """An HTTP answer other than success."""

    def __init__(self, code: int):
        super().__init__(f"status {code}")
        self.code = code


#: Statuses that may pass by themselves.
PASSING = (429, 500, 502, 503, 504)


def with_retries(get: Callable[[], object], retries: int = 4, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep):
    """get(), tried again after backoff * 2^n seconds. None for a missing record (status 404 or LookupError).

    Broken connections, timeouts, unreadable JSON and PASSING statuses are tried again; another status is raised at once. The last try isn't waited for.
    """
    for n in range(retries):
        try:
            return get()
        except LookupError:
            return None
        except (Status, OSError, ValueError) as e:
            if isinstance(e, Status) and e.code == 404:
                return None
            if n == retries - 1 or (isinstance(e, Status) and e.code not in PASSING):
                raise
            sleep(backoff * 2**n)


def get_json(url: str, retries: int = 4, backoff: float = 2.0, timeout: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """The JSON document at a URL, or None where there is none; a try ends after `timeout` seconds."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    def once():
        try:
            with urlopen(Request(url, headers={"Accept": "application/json"}), timeout=timeout) as answer:
                return json.loads(answer.read())
        except HTTPError as e:
            raise Status(e.code) from e

    return with_retries(once, retries, backoff, sleep)


def collect_ids(get: Callable[[int, int], dict | None], page_size: int = 100, most: int | None = None, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[int]:
    """Ids of a paged index, page after page: get(offset, page_size) gives {"totalCount": n, "data": [{"id": ...}, ...]}.

    It ends at a page that is missing or empty, once the first page's count is reached, or after `most` ids. Pages may be shorter than asked
    for; items without an id are passed over but count as read.
    """
    offset, total, found = 0, None, 0
    while True:
        page = with_retries(lambda: get(offset, page_size), sleep=sleep)
        items = (page or {}).get("data") or []
        if not items:
            return
        if total is None:
            total = page.get("totalCount")
        for i in items:
            if i.get("id") is not None:
                yield int(i["id"])
                found += 1
                if most and found >= most:
                    return
        offset += len(items)
        if total is not None and offset >= total:
            return
        sleep(delay)


class Page(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


def function_of(name: str) -> Callable:
    """'module:function' as the function."""
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _bound(options, name: str) -> Callable | None:
    """The function of an option, with option `argument` (if given) as its last argument."""
    if name not in options:
        return None
    f, argument = function_of(options[name]), options.get("argument")
    return f if argument is None else lambda *a: f(*a, argument)


class _Paged:
    """Pages of records from option `fetcher` ('module:function' of (start, stop) -> records), with at least `delay` seconds between two pages of a task.

    The number of records is option `total`, or what option `counter` ('module:function' of no argument) says. Option `argument` is handed to both functions as their last.
    """

    def __init__(self, options):
        self.options = dict(options.items())
        self.fixed, self.page = options.get("total"), int(options.get("pageSize", 100))
        if self.fixed is None and "counter" not in options:
            raise ValueError("give option total or counter")
        self.retries, self.delay = int(options.get("retries", 4)), float(options.get("delay", 0))

    def count(self) -> int:
        return int(self.fixed if self.fixed is not None else with_retries(_bound(self.options, "counter"), self.retries))

    def pages(self, start: int, stop: int) -> list[Page]:
        return [Page(i, min(stop, i + self.page)) for i in range(start, stop, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        get = _bound(self.options, "fetcher")
        if self.delay:
            time.sleep(self.delay)
        for r in with_retries(lambda: get(partition.start, partition.stop), self.retries) or ():
            yield (r.get("id"), json.dumps(r))


class PagedReader(_Paged, DataSourceReader):
    """All pages, one partition each."""

    def partitions(self):
        return self.pages(0, self.count())


class PagedStream(_Paged, DataSourceStreamReader):
    """Pages as they come to be: an offset is the number of records read, so an index that has grown goes on at its last record, whole page or not.

    A batch's range stands in the query's log before it is fetched, and a batch that failed is fetched again over the same range; with a sink that keeps batches whole each record is there once.
    """

    def __init__(self, options):
        super().__init__(options)
        self.last = 0

    def initialOffset(self) -> dict:
        return {"record": 0}

    def latestOffset(self) -> dict:
        # an index that shrinks gives nothing new
        self.last = max(self.last, self.count())
        return {"record": self.last}

    def partitions(self, start: dict, end: dict):
        self.last = max(self.last, start["record"])
        return self.pages(start["record"], end["record"])

    def commit(self, end: dict) -> None:
        pass


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return "id long, value string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def fetch_stream(spark: SparkSession, options: dict[str, str], path: str, log: str) -> None:
    """Fetch what an index has beyond the last call, and append it as NDJSON lines to the folder `path`; `log` keeps how far it came.

    Call it again after it was broken off, or when the index has grown. Spark reads only finished batches of the folder, by the list that the sink keeps there.
    """
    spark.dataSource.register(PagedSource)
    rows = spark.readStream.format("paged_records").options(**options).load()
    rows.select("value").writeStream.format("text").option("path", path).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def append_fetched(records: DataFrame, path: str) -> None:
    """Append NDJSON lines; with still_to_fetch, an interrupted fetch goes on where it stopped."""
    records.select("value").write.mode("append").text(path)


def fetch_records(ids: DataFrame, path: str, fetcher: str, retries: int = 4, backoff: float = 2.0, tasks: int = 8) -> int:
    """Fetch the records of the ids (column id) that aren't in the folder `path` yet and append them as NDJSON lines; how many ids were left to fetch.

    fetcher: 'module:function' of an id, which gives a record or None. `tasks` workers fetch at the same time. Each task's lines are kept or dropped as a whole,
    so a call that was broken off is simply made again.
    """
    from pyspark.errors import AnalysisException

    wanted = ids.select(F.col("id").cast("long").alias("id")).where("id is not null").distinct()
    try:
        left = still_to_fetch(wanted, fetched_ids(ids.sparkSession, path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        left = wanted
    left = left.repartition(tasks, "id").persist()

    def run(parts):
        get = function_of(fetcher)
        for p in parts:
            got = [with_retries(lambda i=i: get(i), retries, backoff) for i in p["id"].tolist()]
            yield p.assign(value=[None if r is None else json.dumps(r) for r in got])[["value"]]

    n = left.count()
    if n:
        append_fetched(left.mapInPandas(run, "value string").where("value is not null"), path)
    left.unpersist()
    return n


def drop_counts(lines: DataFrame) -> DataFrame:
    """level (record or measurement), reason, n: rows by the first filter that drops them; 'usable' and 'kept' are the others."""
    records = parse_records(lines)
    rows = records.select(F.lit("record").alias("level"), F.coalesce("drop_reason", F.lit("usable")).alias("reason"))
    rows = rows.unionByName(measurements(records).select(F.lit("measurement").alias("level"), F.coalesce("drop_reason", F.lit("kept")).alias("reason")))
    return rows.groupBy("level", "reason").agg(F.count(F.lit(1)).alias("n"))


#: What a record or a measurement may be dropped for, in the order of the filters; the last is what is left.
RECORD_REASONS = ("bad_json", "not_monomer", "unusual_residues", "bad_sequence", "usable")
MEASUREMENT_REASONS = ("not_mic", "not_bacterial", "not_erythrocyte", "not_human", "unreadable_value", "bad_unit", "kept")


def ingest(lines: DataFrame, write: Callable[[DataFrame], None]) -> dict[tuple[str, str], int]:
    """Parse NDJSON lines and hand the kept measurements to `write`; (level, reason) -> rows, counted on the very pass that writes. Reasons without rows are left out.

    write: runs one job over all of the frame, such as saving it. Rows of tasks that Spark runs again because an executor was lost are counted again.
    """
    from pyspark.sql import Observation

    seen = {"record": Observation(), "measurement": Observation()}

    def counted(df: DataFrame, level: str, reasons: tuple[str, ...]) -> DataFrame:
        reason = F.coalesce("drop_reason", F.lit(reasons[-1]))
        return df.observe(seen[level], *[F.count_if(reason == r).alias(r) for r in reasons])

    rows = counted(measurements(counted(parse_records(lines), "record", RECORD_REASONS)), "measurement", MEASUREMENT_REASONS)
    write(rows.where("drop_reason is null").drop("drop_reason"))
    return {(level, r): n for level, o in seen.items() for r, n in o.get.items() if n}


def summarise(records: DataFrame, lines: DataFrame) -> DataFrame:
    """kind, name, n: the 12 most usual units, 20 most usual species, and complexities."""
    v = lines.select(F.try_parse_json("value").alias("v")).where("v is not null")
    acts = v.select(F.explode(F.try_variant_get("v", "$.targetActivities", "array<variant>")).alias("a"))
    part = lambda kind, df, c: df.select(F.lit(kind).alias("kind"), c.alias("name"))
    get = lambda col, k: C.name_of(F.try_variant_get(col, f"$.{k}", "variant"))
    rows = part("unit", acts, get("a", "unit")).unionByName(part("species", acts, get("a", "targetSpecies"))).unionByName(part("complexity", v, get("v", "complexity")))
    w = Window.partitionBy("kind").orderBy(F.desc("n"), "name")
    most = F.when(F.col("kind") == "unit", 12).otherwise(20)
    return rows.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).drop("r")
