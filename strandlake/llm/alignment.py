"""Alignment of two tokenizers: which tokens overlap, how often each pair does in the corpus, and sums of those counts by document.

A text's tokens of side A (byte-level BPE of a space and the text) and of side B (pieces with byte fallback, which puts the space there itself)
cover the same bytes. Offsets where both end a token cut them into groups; a link is a pair of tokens whose bytes overlap.

Long texts are encoded in parts. They are cut before a space that follows other text: A's pre-tokeniser breaks there whatever stands around, and
no piece of B's vocabulary has a space after anything but spaces (checked when it is loaded), so no merge crosses it. Both sides end a token there, so groups don't
cross it either, and memory is bounded by a part.

Plan, by cogrouped postings. One pass over the texts writes a row a document (counts and digest) and posting blocks: for an id of B, the ids of A linked to it, each with
its documents and multiplicities, sorted; a set of blocks is of the same documents. Blocks are summed to pair counts before they are shuffled. Then they are cogrouped with those: sorted by id of B in
Spark's spillable sort, each id's counts ahead of its blocks. A task holds the counts of one id (no more than A has ids), finds their maximum, and streams the postings past them.
Ids of B with OFTEN postings or more, together nearly all postings of a large corpus, are dealt by sets of documents: all their postings of a set meet in one task, with a copy of the counts, so a document's
sum over them is made in one task, and a frequent id is spread over many. Rarer ids are dealt by id. Contributions are summed by document in the task, sent as arrays for a chunk of documents at a time, and summed
again where a chunk's arrays meet. Which way an id goes stands in a table of one row an id of B, which the vocabulary bounds and which is broadcast.

Documents are known by task and row of the first pass, whose output is written before it is used. So null and repeated ids are rows like others.

Cases: texts null, empty, or not spelt by the joined tokens (a text that holds U+2581, for one) have no tokens: zeros, and an empty digest; no pair of theirs is counted.
Strings of special tokens are plain text. Ties: all of an id's pairs with its highest count are best. Repeated rows count as often as they are there. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import token_counts
from strandlake.llm.kernels import give_back
from strandlake.llm.shared import materialize

#: Characters of a part; characters of parts that are aligned at once; postings of a set of blocks, and sums that a task holds.
PART_CHARS, SLICE_CHARS, HELD_POSTINGS, HELD_SUMS = 1 << 16, 1 << 20, 1_000_000, 1_000_000
#: Documents of a first task whose sums travel together, as a power of two.
CHUNK_BITS = 11
#: Postings from which on an id of B is dealt by sets of documents, and least postings of a share of the work.
OFTEN, LEAST_SHARE = 1_000, 200_000
_SIDES: dict[tuple, Sides] = {}


class Sides:
    """Both tokenizers, with the bytes of their tokens."""

    def __init__(self, ranks_path: str | None, pieces_path: str | None):
        import public_tokenizers
        import sentencepiece

        self.a = token_counts.encoder(ranks_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path or public_tokenizers.path("piece_bpe_32k.model"))
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.width_a, self.width_b = self.a.width, np.array([len(x) for x in self.bytes_b], np.int64)
        if any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if self.b.is_byte(i) is False):
            raise ValueError("a piece has a space after other text, so texts can't be cut before spaces")
        n = max(len(self.width_a), len(pieces))
        #: decimal ids, each followed by a comma, a bar, or a semicolon
        self.shown = [f"{i}{mark}" for mark in ",|;" for i in range(n)]
        self.ids = n


def sides(ranks_path: str | None = None, pieces_path: str | None = None) -> Sides:
    if (ranks_path, pieces_path) not in _SIDES:
        _SIDES[ranks_path, pieces_path] = Sides(ranks_path, pieces_path)
    return _SIDES[ranks_path, pieces_path]


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """The text, cut before spaces that follow other text, without those spaces; each part has `size` characters or more, but for the last."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (text[cut - 1].isspace() or text[cut - 1] == "▁" or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


class Aligned:
    """Alignment of several parts: arrays over them (fits, n_a, n_b, n_groups, n_links), their links, and their groups as text."""

    def __init__(self, texts: list[str], s: Sides):
        self.sides = s
        ids_a, ids_b = [s.a.ids(" " + t) for t in texts], s.b.encode(texts, num_threads=1)
        raw = [(" " + t).encode("utf-8") for t in texts]
        self.fits = np.array([b"".join(map(s.bytes_b.__getitem__, y)) == r for y, r in zip(ids_b, raw)], bool)
        for i in np.flatnonzero(~self.fits):
            ids_a[i] = ids_b[i] = ()
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (ids_a, ids_b))
        self.a, self.b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((ids_a, self.n_a), (ids_b, self.n_b)))
        end_a, end_b = np.cumsum(s.width_a[self.a]), np.cumsum(s.width_b[self.b])
        if len(end_a) and end_a[-1] != end_b[-1]:
            raise ValueError("the sides' tokens cover different bytes")
        # each byte offset: does a token of A (1), of B (2), or of both (3) end there?
        ends = np.zeros(end_a[-1] + 1 if len(end_a) else 1, np.uint8)
        ends[end_a] = 1
        ends[end_b] |= 2
        places = np.flatnonzero(ends)
        at = ends[places]
        in_a, in_b, both = at & 1, at >> 1, at == 3
        # a link between each two ends
        self.link_a, self.link_b = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
        sizes = np.array([len(r) if f else 0 for r, f in zip(raw, self.fits)], np.int64)
        stop = np.searchsorted(places, np.cumsum(sizes), side="right")
        self.n_links = np.diff(stop, prepend=0)
        whole = np.concatenate(([0], np.cumsum(both)))
        self.n_groups = np.diff(whole[stop], prepend=0)
        self.places, self.both = places, both
        before = whole[:-1]
        self.group_a, self.group_b = before[in_a == 1], before[in_b == 1]
        self.last_a, self.last_b = both[in_a == 1], both[in_b == 1]
        self.part = np.repeat(np.arange(len(texts)), self.n_links)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B of every link."""
        return self.a[self.link_a], self.b[self.link_b]

    def shown(self) -> list[str]:
        """Each part's groups: a1,a2|b1;a3|b2,b3; with a semicolon after the last."""
        first_a, first_b = (np.concatenate(([0], x[self.both] + 1)) for x in (self.link_a, self.link_b))
        out = np.empty(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + first_b[self.group_a]] = self.a + self.sides.ids * self.last_a
        out[np.arange(len(self.b)) + first_a[self.group_b + 1]] = self.b + 2 * self.sides.ids * self.last_b
        stops = np.concatenate(([0], np.cumsum(self.n_a + self.n_b))).tolist()
        show = self.sides.shown.__getitem__
        return ["".join(map(show, out[i:j].tolist())) for i, j in zip(stops, stops[1:])]

    def groups(self) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
        """Part, start and end byte (of all parts joined, each after a space), ids of A, ids of B."""
        cut_a, cut_b = (np.concatenate(([0], x[self.both] + 1)).tolist() for x in (self.link_a, self.link_b))
        ends = np.concatenate(([0], self.places[self.both])).tolist()
        for g, part in enumerate(self.part[self.both].tolist()):
            yield part, ends[g], ends[g + 1], self.a[cut_a[g] : cut_a[g + 1]].tolist(), self.b[cut_b[g] : cut_b[g + 1]].tolist()


class _Document:
    """What has been seen of one row."""

    def __init__(self, row: int, id: object):
        self.row, self.id, self.n, self.digest, self.fits, self.any = row, id, np.zeros(4, np.int64), hashlib.sha256(), True, False

    def told(self) -> tuple:
        whole = self.fits and self.any
        return (self.row, self.id, *(int(x) for x in (self.n if whole else np.zeros(4, np.int64))), self.digest.hexdigest() if whole else "")


class _Postings:
    """Keys (id of B, id of A, row) with multiplicities, summed now and then."""

    def __init__(self):
        self.held, self.n = [], 0

    def add(self, keys: np.ndarray, m: np.ndarray) -> None:
        self.held.append((keys, m))
        self.n += len(keys)

    def sum(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        keys, m = (np.concatenate(x) for x in zip(*self.held))
        keys, m = _summed(keys, m)
        self.held, self.n = [(keys, m)], len(keys)
        return keys, m


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values)


_BLOCK = "base int, b int, ids array<int>, sizes array<int>, totals array<long>, rows array<int>, times array<int>"


def _first_pass(ranks_path: str | None, pieces_path: str | None, part_chars: int, slice_chars: int, held: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, task = sides(ranks_path, pieces_path), TaskContext.get().partitionId()
        kind, postings, open_docs = None, _Postings(), []
        texts, owners, chars = [], [], 0

        def schema() -> pa.Schema:
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            names = ["task", "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "base", "b", "ids", "sizes", "totals", "rows", "times"]
            return pa.schema(list(zip(names, [pa.int32(), pa.int32(), kind, *[pa.int64()] * 4, pa.string(), pa.int32(), pa.int32(), ints, ints, longs, ints, ints])))

        def batch_of(n: int, own: dict) -> pa.RecordBatch:
            fields = schema()
            own |= {"task": pa.array(np.full(n, task, np.int32))}
            return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(n, f.type) for f in fields], schema=fields)

        def align() -> None:
            nonlocal texts, owners, chars
            if texts:
                got = Aligned(texts, s)
                a, b = got.pairs()
                rows = np.array([d.row for d in owners], np.int64)[got.part]
                keys, m = _summed((b << 16 | a) << 32 | rows, np.ones(len(a), np.int64))
                postings.add(keys, m)
                for d, fits, shown, *n in zip(owners, got.fits.tolist(), got.shown(), got.n_a, got.n_b, got.n_groups, got.n_links):
                    d.fits &= fits
                    d.n += n
                    d.digest.update((";" * d.any + shown[:-1]).encode("ascii"))
                    d.any = True
                if postings.n > held:
                    postings.sum()
            texts, owners, chars = [], [], 0

        def documents() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(open_docs), 4096):
                cols = list(zip(*(d.told() for d in open_docs[at : at + 4096])))
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
                yield batch_of(len(cols[0]), {n: pa.array(c, schema().field(n).type) for n, c in zip(names, cols)})

        def blocks() -> Iterator[pa.RecordBatch]:
            keys, m = postings.sum()
            misfits = np.array([d.row for d in open_docs if not d.fits], np.int64)
            if len(misfits):
                fine = ~np.isin(keys & 0xFFFFFFFF, misfits)
                keys, m = keys[fine], m[fine]
            postings.held, postings.n = [], 0
            pair, rows = keys >> 32, (keys & 0xFFFFFFFF).astype(np.int32)
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            own, sizes = pair[first], np.diff(np.append(first, len(pair)))
            totals = np.add.reduceat(m, first) if len(first) else m
            of_b = np.flatnonzero(np.diff(own >> 16, prepend=-1))
            stops = np.append(of_b, len(own))
            starts = np.append(first, len(pair))
            # rows of a batch, so that no batch is much larger than a million postings
            at = 0
            while at < len(of_b):
                to = max(at + 1, int(np.searchsorted(starts[stops], starts[of_b[at]] + 1_000_000, side="right")) - 1)
                i, j = of_b[at], stops[to]
                p, q = starts[i], starts[j]
                cut, wide = pa.array((stops[at : to + 1] - i).astype(np.int32)), pa.array((starts[stops[at : to + 1]] - p).astype(np.int32))
                lists = lambda offsets, x, t: pa.ListArray.from_arrays(offsets, pa.array(x.astype(t)))
                yield batch_of(to - at, {
                    "base": pa.array(np.full(to - at, open_docs[0].row, np.int32)), "b": pa.array((own[of_b[at:to]] >> 16).astype(np.int32)), "ids": lists(cut, own[i:j] & 0xFFFF, np.int32), "sizes": lists(cut, sizes[i:j], np.int32),
                    "totals": lists(cut, totals[i:j], np.int64), "rows": lists(wide, rows[p:q], np.int32), "times": lists(wide, m[p:q], np.int32),
                })
                at = to

        row = 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    d = _Document(row, id)
                    row += 1
                    for t in parts(text, part_chars) if text else ():
                        texts.append(t)
                        owners.append(d)
                        chars += len(t)
                        if chars >= slice_chars:
                            align()
                    open_docs.append(d)
                    if postings.n > held or len(open_docs) >= 100_000:
                        align()
                        yield from documents()
                        yield from blocks()
                        open_docs = []
                        give_back()
        if kind is not None:
            align()
            yield from documents()
            yield from blocks()
        give_back()

    return run


def postings(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pieces_path: str | None = None,
    part_chars: int = PART_CHARS, slice_chars: int = SLICE_CHARS, held: int = HELD_POSTINGS,
) -> tuple[DataFrame, DataFrame]:
    """Documents (task, row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) and posting blocks (task, base, b, ids, sizes, totals, rows, times), written; blocks of one task and base are of the same documents.

    A block's ids of A come with their number of documents, the sum of multiplicities, and, one id after another, the documents' rows and multiplicities.
    """
    kind = df.schema[id_col].dataType.simpleString()
    run = _first_pass(ranks_path, pieces_path, part_chars, slice_chars, held)
    schema = f"task int, row int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {_BLOCK}"
    both = materialize(df.select(id_col, text_col).mapInArrow(run, schema), "postings")
    return both.where("row is not null").select(*both.columns[:8]), both.where("row is null").select("task", *both.columns[8:])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n: how many links of the corpus hold the pair."""
    return blocks.select("b", F.explode(F.arrays_zip("ids", "totals")).alias("x")).groupBy("b", F.col("x.ids").alias("a")).agg(F.sum("x.totals").alias("n"))


def _contributions(held: int):
    """Maps rows sorted by id of B, its counts first: task, chunk, and arrays over its documents (row, n_best, count_sum), summed as far as they fit in memory."""
    names = ["task", "chunk", "rows", "best", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # ids and counts of the current id of B, sorted, and the highest count
        ids, counts, best = np.empty(0, np.int64), np.empty(0, np.int64), 0
        sums, n = [], 0

        def out(done: tuple) -> pa.RecordBatch:
            key, b, c = done
            chunk = key >> CHUNK_BITS
            first = np.flatnonzero(np.diff(chunk, prepend=-1))
            cut = pa.array(np.append(first, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in ((key & 0xFFFFFFFF).astype(np.int32), b, c)]
            own = chunk[first] << CHUNK_BITS
            return pa.RecordBatch.from_arrays([pa.array((own >> 32).astype(np.int32)), pa.array(((own & 0xFFFFFFFF) >> CHUNK_BITS).astype(np.int32)), *lists], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                of_counts, tasks = piece.column(2).is_null().to_numpy(zero_copy_only=False), piece.column(2).fill_null(0).to_numpy().astype(np.int64)
                own_ids, sizes, totals, rows, times = (piece.column(i) for i in range(3, 8))
                flat = lambda x: x.flatten().to_numpy(zero_copy_only=False)
                length = lambda x: np.concatenate(([0], np.cumsum(x.value_lengths().fill_null(0).to_numpy())))
                f_ids, f_sizes, f_totals, f_rows, f_times = map(flat, (own_ids, sizes, totals, rows, times))
                of_ids, of_sizes, of_totals, of_rows = map(length, (own_ids, sizes, totals, rows))
                found = []
                stops = [*np.flatnonzero(of_counts).tolist(), piece.num_rows]
                for i, j in zip([-1, *stops[:-1]], stops):
                    if i >= 0:
                        ids, counts = f_ids[of_ids[i] : of_ids[i + 1]], f_totals[of_totals[i] : of_totals[i + 1]]
                        order = np.argsort(ids)
                        ids, counts, best = ids[order], counts[order], counts.max()
                    if i + 1 < j:
                        got = counts[np.searchsorted(ids, f_ids[of_ids[i + 1] : of_ids[j]])]
                        size = f_sizes[of_sizes[i + 1] : of_sizes[j]]
                        found.append((np.repeat(got, size), np.repeat(got == best, size)))
                if found:
                    each, is_best = (np.concatenate(x) for x in zip(*found))
                    keys = np.repeat(tasks, np.diff(of_rows)) << 32 | f_rows
                    m = f_times.astype(np.int64)
                    sums.append(_summed(keys, m * is_best, m * each))
                    n += len(sums[-1][0])
                if n > held:
                    sums = [_summed(*(np.concatenate(x) for x in zip(*sums)))]
                    n = len(sums[0][0])
                    if 2 * n > held:
                        yield out(sums.pop())
                        n = 0
        if sums:
            yield out(_summed(*(np.concatenate(x) for x in zip(*sums))))
        give_back()

    return run


def align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pieces_path: str | None = None,
    part_chars: int = PART_CHARS, slice_chars: int = SLICE_CHARS, held: int = HELD_POSTINGS, held_sums: int = HELD_SUMS, share: int | None = None, often: int = OFTEN,
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row.

    share: about how many postings are dealt together, chosen by their number if not given.
    """
    spark = df.sparkSession
    docs, blocks = postings(df, id_col, text_col, ranks_path, pieces_path, part_chars, slice_chars, held)
    sizes = blocks.groupBy("b").agg(F.sum(F.size("rows")).alias("n"))
    hot, rare = sizes.agg(F.coalesce(F.sum(F.when(F.col("n") >= often, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n") < often, F.col("n"))), F.lit(0))).first()
    if not share:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        share = max(LEAST_SHARE, (hot + rare) // (2 * tasks))
    sets, others = max(1, -(-hot // share)), max(1, -(-rare // share))
    # one row an id of B; shares from `sets` on are those of rarer ids
    ways = F.broadcast(sizes.select("b", (F.col("n") >= often).alias("hot")))
    of_rare = (sets + F.pmod(F.xxhash64("b"), F.lit(others))).cast("int")
    counts = pair_counts(blocks).groupBy("b").agg(F.collect_list("a").alias("ids"), F.collect_list("n").alias("totals")).join(ways, "b")
    none = F.lit(None).cast("array<int>")
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(sets - 1))).otherwise(F.array(of_rare)))
    first = counts.select("b", copies.alias("share"), F.lit(None).cast("int").alias("task"), "ids", none.alias("sizes"), "totals", none.alias("rows"), none.alias("times"))
    own = F.when(F.col("hot"), F.pmod(F.xxhash64("task", "base"), F.lit(sets)).cast("int")).otherwise(of_rare)
    then = blocks.join(ways, "b").select("b", own.alias("share"), "task", "ids", "sizes", F.lit(None).cast("array<long>").alias("totals"), "rows", "times")
    dealt = first.unionByName(then).repartition("share").sortWithinPartitions("share", "b", F.col("task").asc_nulls_first())
    sums = dealt.mapInArrow(_contributions(held_sums), "task int, chunk int, rows array<int>, best array<long>, sums array<long>").repartition("task", "chunk")
    sums = sums.select("task", "chunk", F.explode(F.arrays_zip("rows", "best", "sums")).alias("x")).groupBy("task", "chunk", F.col("x.rows").alias("row")).agg(F.sum("x.best").alias("n_best"), F.sum("x.sums").alias("count_sum"))
    sums = sums.drop("chunk")
    out = docs.join(sums, ["task", "row"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
