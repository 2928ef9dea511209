"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

1. One pass over the training table stores its postings of the tests' terms, (row, pos, term), as Parquet; a posting behind
   the last word of each row ends it and holds its id. Lengths of the posting lists are counted over the stored index.
2. Of every window (`n` consecutive words of an item; a shorter item is one window) the rarest term, that of the shortest list, is
   the anchor. Windows with a term without postings are dropped. Windows that share an anchor position are one range.
3. Each posting of an anchor's term proposes an alignment (row, anchor, base), one row each: term i of the item should stand at base + i. The lists of
   the other terms, offset by the base, are intersected with it by a join on (row, pos). The nearest miss on each side of the anchor
   tells which windows of its range occur, and they cover one interval of the row.
4. Intervals are merged per row, in order of their starts.

proximity_matches proposes alignments by more of an item's terms, as the rarest may be altered, and joins the same lists around each place.

Tables of the test side are broadcast only while they have at most BROADCAST_ROWS rows; beyond that Spark joins by shuffle, and splits
skewed terms. Nothing is collected but those counts, and no row holds more than 2 n - 1 terms.

Cases: null texts and texts without a word have no windows and no hits; every row is judged by itself, so ids may be null, of any
type, or repeated; item ids are compared and listed as strings, a null one as the empty string; items of one id are one item; an empty
training table gives an empty result and an empty benchmark gives no hits; a document that repeats one word meets an
item that does so by one alignment a place and anchor; other columns are ignored (`clean` keeps them, whatever their names).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.shared import materialize

WINDOW = 13
#: Most rows (at most about 300 bytes each) of a table of the test side that are broadcast.
BROADCAST_ROWS = 100_000
#: What stands between words: ASCII but for letters and digits.
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BLANK = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Term number of the posting that ends a row.
END = -1


def term(word: Column) -> Column:
    """A-Z to lower case; other letters keep their case."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def spelled(text: Column) -> Column:
    """Words in order with their case, and an empty one behind them."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(inner == "", F.array(F.lit(""))).otherwise(F.concat(F.split(inner, _BETWEEN), F.array(F.lit(""))))


def sent(df: DataFrame, rows: int) -> DataFrame:
    """df of the test side, marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


@dataclass
class Index:
    """items: item, item_id, size (words). spots: item, i, term, postings (length of the term's list). postings: row, pos, term, held."""

    items: DataFrame
    spots: DataFrame
    n_spots: int
    postings: DataFrame


def build(docs: DataFrame, tests: DataFrame, held: Column) -> Index:
    """The stored index. docs: text, and what `held` (a value kept for each row) reads. tests: item_id, text."""
    items = tests.select("item_id", spelled(F.col("text")).alias("words"))
    items = items.where(F.size("words") > 1).withColumn("item", F.monotonically_increasing_id())
    named = items.select("item", "item_id", "words").select("item", "item_id", (F.size("words") - 1).alias("size"), F.posexplode("words").alias("i", "word"))
    named = materialize(named.where("i < size").select("item", "item_id", "size", "i", term(F.col("word")).alias("name")), "items")
    terms = materialize(named.select("name").distinct().select("name", F.monotonically_increasing_id().alias("term")), "terms")
    n_terms = terms.count()
    known = terms.unionByName(terms.sparkSession.createDataFrame([("", END)], "name string, term long"))
    # rows are numbered before they are exploded
    rows = docs.select(F.monotonically_increasing_id().alias("row"), held.alias("held"), "text").select("row", "held", F.posexplode(spelled(F.col("text"))).alias("pos", "word"))
    rows = rows.select("row", "pos", "held", term(F.col("word")).alias("name")).join(sent(known, n_terms), "name")
    postings = materialize(rows.select("row", "pos", "term", F.when(F.col("term") == END, F.col("held")).alias("held")), "postings")
    lists = postings.where(F.col("term") != END).groupBy("term").agg(F.count(F.lit(1)).alias("postings"))
    lists = terms.join(sent(lists, n_terms), "term", "left").select("name", "term", F.coalesce("postings", F.lit(0)).alias("postings"))
    spots = materialize(named.join(sent(lists, n_terms), "name").select("item", "item_id", "size", "i", "term", "postings"), "spots")
    return Index(spots.where("i = 0").select("item", "item_id", "size"), spots, spots.count(), postings)


def anchors_of(index: Index, n: int) -> DataFrame:
    """anchor, item, item_id, term, at, lo, hi, wide, terms: windows lo..hi of the item (of `wide` words) have the term at place `at` as their rarest.

    terms: those of the places lo .. hi + wide - 1. Of equally rare places the one at a multiple of the width is taken, then
    the first: that is one order of an item's places, so the windows of a place are a range, and repeated words don't make every place an anchor.
    """
    spots = index.spots.withColumn("wide", F.least("size", F.lit(n)))
    starts = F.explode(F.sequence(F.greatest(F.col("i") - F.col("wide") + 1, F.lit(0)), F.least(F.col("i"), F.col("size") - F.col("wide"))))
    rank = F.struct("postings", (F.col("i") % F.col("wide") != 0).alias("off"), "i", "term").alias("rank")
    rarest = spots.select("item", "item_id", "wide", starts.alias("s"), rank).groupBy("item", "item_id", "wide", "s").agg(F.min("rank").alias("rank"))
    ranges = rarest.where("rank.postings > 0").groupBy("item", "item_id", "wide", F.col("rank.i").alias("at"), F.col("rank.term").alias("term")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    place = F.explode(F.sequence(F.col("lo"), F.col("hi") + F.col("wide") - 1)).alias("i")
    around = ranges.select("item", "at", place).join(index.spots.select("item", "i", F.col("term").alias("other")), ["item", "i"])
    around = around.groupBy("item", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "other"))), lambda x: x["other"]).alias("terms"))
    return materialize(ranges.join(around, ["item", "at"]).withColumn("anchor", F.monotonically_increasing_id()), "anchors")


def phrase_matches(index: Index, n: int = WINDOW) -> DataFrame:
    """row, item, item_id, start, stop: words start .. stop - 1 of the row are covered by occurring windows of the item."""
    anchors = anchors_of(index, n)
    n_anchors = anchors.count()
    lists = index.postings.where(F.col("term") != END).select("row", "pos", "term")
    found = lists.join(sent(anchors.select("anchor", "term", "at", "lo", "terms"), n_anchors), "term").select("row", "anchor", "lo", "at", (F.col("pos") - F.col("at")).alias("base"), "terms")
    places = found.select("row", "anchor", "base", "lo", "at", F.posexplode("terms").alias("k", "want"))
    places = places.select("row", "anchor", "base", (F.col("lo") + F.col("k") - F.col("at")).alias("away"), (F.col("base") + F.col("lo") + F.col("k")).alias("pos"), "want")
    met = places.join(lists, ["row", "pos"], "left").select("row", "anchor", "base", "away", F.coalesce(F.col("term") == F.col("want"), F.lit(False)).alias("met"))
    misses = met.groupBy("row", "anchor", "base").agg(F.max(F.when(~F.col("met") & (F.col("away") < 0), F.col("away"))).alias("before"), F.min(F.when(~F.col("met") & (F.col("away") > 0), F.col("away"))).alias("behind"))
    ranges = misses.join(sent(anchors.drop("terms", "term"), n_anchors), "anchor")
    first = F.greatest("lo", F.col("at") + F.col("before") + 1)  # greatest and least pass over nulls
    last = F.least("hi", F.col("at") + F.col("behind") - F.col("wide"))
    hits = ranges.withColumns({"first": first, "last": last}).where("first <= last")
    return hits.select("row", "item", "item_id", (F.col("base") + F.col("first")).alias("start"), (F.col("base") + F.col("last") + F.col("wide")).alias("stop"))


def judged(docs: DataFrame, tests: DataFrame, held: Column, n: int, share: int) -> DataFrame:
    """held, n_words, n_hit, items (listed ids), contaminated: one row for each row of docs."""
    index = build(docs, tests, held)
    hits = materialize(phrase_matches(index, n), "hits")
    # words covered: each interval adds what lies behind all intervals that start before it
    runs = hits.groupBy("row", "start").agg(F.max("stop").alias("stop"))
    upto = F.max("stop").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    added = F.greatest(F.col("stop") - F.greatest("start", F.coalesce(upto, F.col("start"))), F.lit(0))
    covered = runs.select("row", added.alias("added")).groupBy("row").agg(F.sum("added").alias("n_hit"))
    listed = hits.select("row", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    ends = index.postings.where(F.col("term") == END).select("row", "held", F.col("pos").cast("long").alias("n_words"))
    out = ends.join(covered.join(listed, "row"), "row", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("held", "n_words", hit.alias("n_hit"), items.alias("items"), ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"))


def _tests(tests: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return tests.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))


def decontaminate(docs: DataFrame, tests: DataFrame, n: int = WINDOW, share: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words) of each row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = judged(rows, _tests(tests, item_col, item_text_col), F.col("doc_id"), n, share)
    return out.select(F.col("held").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, tests: DataFrame, n: int = WINDOW, share: int = 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that aren't contaminated. Rows are known by two hashes of their text, so ids don't matter."""
    two = F.struct(F.xxhash64(F.col(text_col)).alias("a"), F.xxhash64(F.col(text_col), F.lit(1)).alias("b"))
    rows = docs.select(F.col(text_col).cast("string").alias("text"), two.alias("key"))
    bad = judged(rows, _tests(tests, item_col, item_text_col), F.col("key"), n, share).where("contaminated").select(F.col("held.a").alias("a"), F.col("held.b").alias("b")).distinct()
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row"), two.alias("key")).select("kept_row", "key.a", "key.b")
    return kept.join(bad, ["a", "b"], "left_anti").select("kept_row.*")


def proximity_matches(docs: DataFrame, tests: DataFrame, distance: int = 3, n: int = WINDOW) -> DataFrame:
    """doc_id, item_id, at: alignments at which a term of the item stands in its very place, and at least min(n, item size) of the item's terms
    within `distance` of theirs (a phrase match with altered, inserted or deleted words).

    Of an item of m terms with k needed, any m - k + 1 hold one that stands near its place in every match. So the m - k + 1
    rarest propose alignments, a term that no document has being one of them; a posting proposes those up to `distance` around it.
    """
    index = build(docs.select("doc_id", F.col("text").cast("string").alias("text")), _tests(tests, "item_id", "text"), F.col("doc_id"))
    lists = index.postings.where(F.col("term") != END).select("row", "pos", "term")
    rare = Window.partitionBy("item").orderBy("postings", "i")
    few = index.spots.withColumn("nth", F.row_number().over(rare)).where(F.col("nth") <= F.col("size") - F.least("size", F.lit(n)) + 1).where("postings > 0")
    shifts = F.explode(F.sequence(F.lit(-distance), F.lit(distance))).alias("d")
    proposed = lists.join(sent(few.select("item", "i", "term"), index.n_spots), "term").select("row", "item", (F.col("pos") - F.col("i")).alias("base")).distinct()
    proposed = proposed.select("row", "item", "base", shifts).select("row", "item", (F.col("base") + F.col("d")).alias("base")).distinct()
    wanted = proposed.join(sent(index.spots.select("item", "i", F.col("term").alias("want")), index.n_spots), "item")
    wanted = wanted.select("row", "item", "base", "i", "want", shifts).withColumn("pos", F.col("base") + F.col("i") + F.col("d"))
    met = wanted.join(lists, ["row", "pos"]).where("term = want").groupBy("row", "item", "base", "i").agg(F.max((F.col("d") == 0).cast("int")).alias("exact"))
    met = met.groupBy("row", "item", "base").agg(F.count(F.lit(1)).alias("near"), F.max("exact").alias("exact"))
    found = met.join(sent(index.items, index.n_spots), "item").where((F.col("near") >= F.least("size", F.lit(n))) & (F.col("exact") == 1))
    ends = index.postings.where(F.col("term") == END).select("row", F.col("held").alias("doc_id"))
    return found.join(ends, "row").select("doc_id", "item_id", F.col("base").alias("at")).distinct()
