"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is a bag of words: each distinct run of `[^\\x20\\x09-\\x0D]+`, weighted by how often it occurs. For every sample
j and term, hashes of the two give r and c from Gamma(2, 1) and b from the uniform distribution. A term of weight w is quantised to
t = floor(ln w / r + b), and has the rank ln c - r (t - b + 1). The sample is the term of least rank, so two bags
agree in it with the probability of their generalised Jaccard similarity (sums of the terms' smaller weights over those
of the larger). A rank is a function of sample, term and t; so equal ranks stand for equal samples, and a hash of the rank is what the fingerprint keeps.

Plans. Samples are rows of SEEDS, each with PER_ROW ranks in columns: so the generated code stays small enough to be compiled, and every rank is
reduced by a hash aggregate over doubles in the task that made it. All terms of a document are in one task, as the text arrived there; a task's aggregates spill. Words aren't shuffled: texts
are, once, by id and hash, and once more as much of each as its predecessor borrows. The order of documents comes from ids alone, sorted by range
in many tasks; a range's last document finds the first of the next range through a table of one row a range.

Cases: null text is empty. A text without words has no samples: its fingerprint is the empty string, alike 1.0 with another such, and 0.0 with any other. Null ids
come first in the order, as one id. Rows of one id follow each other by a hash of the text; equal rows (id and text) are one document there, and give equal
result rows. One document is its own successor. A very long text is one row of one task, whose words are aggregated with spilling. An
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.shared import materialize

#: Samples of a fingerprint: rows a term is copied to, times ranks in each of them.
SEEDS, PER_ROW = 16, 4
_BITS = 21


def _uniform(hashed: str, place: int) -> str:
    """The 21 bits at a place (0, 1, 2) of a 64-bit hash, as a double between 0 and 1, neither included."""
    return f"((shiftrightunsigned({hashed}, {_BITS * place}) & {(1 << _BITS) - 1}) + 0.5D) * {2.0**-_BITS!r}D"


def signatures(terms: DataFrame, keys: list[str], weights: list[str], seeds: int = SEEDS) -> DataFrame:
    """keys, and for each column w of weights: w, the PER_ROW * seeds samples as array<int>, or null for a bag without terms.

    terms: one row a key and term, with the long column `term` and weights as doubles; a null weight, or one not above 0, means that the term isn't in that bag.
    """
    logs = [F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))).alias(f"log_{w}") for w in weights]
    rows = terms.select(*keys, "term", *logs, F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("seed"))
    each, held = range(PER_ROW), [*keys, "seed", *(f"log_{w}" for w in weights)]
    rows = rows.selectExpr(*held, *[f"xxhash64(term, seed, {2 * j}) x{j}" for j in each], *[f"xxhash64(term, seed, {2 * j + 1}) y{j}" for j in each])
    gamma = lambda a, i, b, k: f"-ln(({_uniform(a, i)}) * ({_uniform(b, k)}))"
    rows = rows.selectExpr(
        *held, *[f"{gamma(f'x{j}', 0, f'x{j}', 1)} r{j}" for j in each], *[f"ln({gamma(f'x{j}', 2, f'y{j}', 0)}) c{j}" for j in each], *[f"{_uniform(f'y{j}', 1)} b{j}" for j in each]
    )
    # a weight of 1 has t = 0
    rank = lambda w, j: f"c{j} + r{j} * (b{j} - 1D - if(log_{w} = 0D, 0D, floor(log_{w} / r{j} + b{j})))"
    least = rows.groupBy(*keys, "seed").agg(*[F.min(F.expr(rank(w, j))).alias(f"{w}_{j}") for w in weights for j in each])
    short = lambda c: F.when(c.isNotNull(), F.xxhash64(c).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    some = least.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.when(F.col(f"{w}_0").isNotNull(), F.struct("seed", *[short(F.col(f"{w}_{j}")).alias(f"s{j}") for j in each])))).alias(w) for w in weights])
    flat = lambda w: F.flatten(F.transform(w, lambda x: F.array(*[x[f"s{j}"] for j in each])))
    return some.select(*keys, *[F.when(F.size(w) > 0, flat(w)).alias(w) for w in weights])


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: 1.0 for two bags without terms, 0.0 for one."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / F.size(a))


def shown(samples: Column) -> Column:
    """Samples as a string, eight hexadecimal digits each."""
    return F.coalesce(F.array_join(F.transform(samples, lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 8, "0"))), ""), F.lit(""))


def _words(text: str) -> Column:
    return F.split(F.col(text), "[\\x20\\x09-\\x0D]+")


def word_bags(df: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """keys, term, and for each text column the term's number of occurrences in it as a double, 0 for none. One row of df a key.

    All texts of a row are exploded in one pass, and counted together.
    """
    held = df.select(*keys, *[_words(t).alias(f"words_{i}") for i, t in enumerate(texts)])
    ends, n = [], F.lit(0)
    for i in range(len(texts)):
        n = n + F.size(f"words_{i}")
        ends.append(n.alias(f"end_{i}"))
    rows = held.select(*keys, *ends, F.posexplode(F.concat(*[f"words_{i}" for i in range(len(texts))])).alias("pos", "word")).where("word <> ''")
    within = lambda i: (F.col("pos") < F.col(f"end_{i}")) & (F.col("pos") >= (F.col(f"end_{i - 1}") if i else F.lit(0)))
    counts = [F.sum(F.when(within(i), 1).otherwise(0)).cast("double").alias(t) for i, t in enumerate(texts)]
    return rows.groupBy(*keys, F.xxhash64("word").alias("term")).agg(*counts)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS) -> DataFrame:
    """id, fingerprint of each document; equal rows are one document. Its samples are in the array column `samples`."""
    docs = _documents(df, id_col, text_col)
    prints = signatures(word_bags(docs, ["key", "h"], ["text"]), ["key", "h"], ["text"], seeds)
    out = docs.select("key", "h").join(prints, ["key", "h"], "left")
    return out.select(_id(df, id_col), shown(F.col("text")).alias("fingerprint"), F.col("text").alias("samples"))


_NONE = -(2**63)


def _id(df: DataFrame, id_col: str) -> Column:
    """The id from its key; the hash tells a null id from the least long."""
    return F.when(F.col("h") % 2 == 0, F.col("key")).cast(df.schema[id_col].dataType).alias("doc_id")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (the id, null as the least long), h (a hash of the text, odd for null ids), text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    nil = F.col(id_col).isNull().cast("long")
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("key"), F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(nil).alias("h"), text.alias("text"))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, h, text: equal rows once, which they become before they are shuffled; partitioned by key and h."""
    return _keyed(df, id_col, text_col).groupBy("key", "h").agg(F.first("text").alias("text"))


def successors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, h, n_chars, copies (equal rows), next_key, next_h: each document's successor in the order of ids; the last one's is the first."""
    ids = _keyed(df, id_col, text_col).select("key", "h", F.length("text").cast("long").alias("n_chars")).groupBy("key", "h").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("copies"))
    ranges = materialize(ids.repartitionByRange("key", "h").withColumn("range", F.spark_partition_id()), "ranges")
    firsts = ranges.groupBy("range").agg(F.min(F.struct("key", "h")).alias("first"))
    # one row a range
    whole = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("first").over(whole), F.first("first").over(whole)).alias("after"))
    own = Window.partitionBy("range").orderBy("key", "h")
    rows = ranges.withColumn("next", F.lead(F.struct("key", "h")).over(own)).join(firsts, "range")
    return rows.select("key", "h", "n_chars", "copies", F.coalesce("next", "after").alias("next")).select("key", "h", "n_chars", "copies", F.col("next.key").alias("next_key"), F.col("next.h").alias("next_h"))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = SEEDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    A document's edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document, or all of them.
    """
    keys = ["key", "h"]
    docs, links = _documents(df, id_col, text_col), materialize(successors(df, id_col, text_col), "successors")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    wanted = links.select(F.col("key").alias("to_key"), F.col("h").alias("to_h"), half.alias("size"), F.col("next_key").alias("key"), F.col("next_h").alias("h"))
    # both joins read one exchange of the texts
    lent = docs.join(wanted, keys).select(F.col("to_key").alias("key"), F.col("to_h").alias("h"), F.expr("substring(text, 1, size)").alias("lent"))
    both = docs.join(lent, keys).withColumn("n_chars", F.length("text").cast("long"))
    both = both.select(*keys, "n_chars", "text", F.concat(F.expr("substring(text, 1, int(n_chars - n_chars div 2))"), "lent").alias("edited"))
    prints = signatures(word_bags(both, keys, ["text", "edited"]), keys, ["text", "edited"], seeds)
    told = both.select(*keys, "n_chars", F.sha2("edited", 256).alias("edited_sha256")).join(prints, keys, "left")
    told = materialize(told.withColumnsRenamed({"text": "own"}), "fingerprints")
    after = told.select(F.col("key").alias("next_key"), F.col("h").alias("next_h"), F.col("own").alias("following"))
    rows = told.join(links.drop("n_chars"), keys).join(after, ["next_key", "next_h"])
    rows = rows.select(
        _id(df, id_col), "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"), "copies",
    )
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
