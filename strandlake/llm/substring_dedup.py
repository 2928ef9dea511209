"""Substring deduplication with a compressed FM-index per shard.

A window is `window` consecutive words of one document. Routing: every window has a key, the smallest hash of
the ANCHOR-word runs in it; equal windows have equal keys. Consecutive windows of one key form a fragment. Keys
that only one document has can't repeat; only fragments of the other keys are kept, equal fragments are one
(with the smallest document that has it), and all fragments of a key meet in one shard. The key of very many documents is refined
by more of the smallest hashes, the more the more documents there are, up to all of a window's; then a key stands for one window's
words, of which a shard holds a single copy. So a passage that any share of the documents has doesn't gather their neighbourhoods in one shard.
Rows are dealt by key and sorted, and a task takes whole keys as a shard until it has SHARD_WORDS words. The words of a fragment are shuffled once a
task that cut it out; its smallest document comes from an aggregate of its own, with partial minima.

In a shard, a key's fragments are ranked by their documents, and merged as in a tournament: at each level the fragments of every left half
are indexed, and those of the right half, which are of later documents, are streamed through the index. What is found to be a repeat is
neither indexed nor streamed again, so that a family of copies shrinks to its distinct windows.

The index is a wavelet matrix over the Burrows-Wheeler transform (bit vectors with block counts), the symbols' counts, and one byte a row with the
longest common prefix of neighbouring rows, capped at the window. No suffix array is kept. Documents are read from right to left, all in step:
a backward search extends the match by one word; where that fails, the match is cut to the parent interval's length and the
search goes on. That gives each position's matching statistic, and positions with one of at least the window begin a repeat.
Over sigma distinct symbols, a word of index takes 1.5 log2(sigma) bits and a byte (`FmIndex.bytes`): about 5 bytes in a full shard.

Words are compared by 64-bit hashes over windows of at least `window` words.

Cases: null text has no words; texts shorter than a window lose nothing; repeats within one document only are kept; of equal texts the one
with the smallest doc_id keeps its words; rows of one doc_id are parts of one document, each with its own result, and don't cut each other; rows without an id
lose nothing and cut nothing; an empty table gives an empty result; very long texts cost memory in proportion to their length; other columns
are ignored, and kept whatever their names by outputs='rows'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from strandlake.llm.kernels import U64, Words, give_back, mix, rolling, row_slices
from strandlake.llm.shared import discard, materialize

WINDOW = 50
ANCHOR = 20
#: From how many documents of a key on it is refined, and by how many hashes (0: all of the window's).
HOT_DOCS = 1_000
REFINED = ((1, 4), (16, 12), (256, 0))
SHARD_WORDS = 600_000
#: Fragments that a task remembers, so that it sends the words of equal ones once.
SEEN_FRAGMENTS = 200_000
#: Windows of a stretch that is streamed in one piece, and the match length at which the search goes back to the window's.
PIECE, DEEPEST = 256, 62
_MAX = U64(0xFFFFFFFFFFFFFFFF)


# ---- FM-index


class Bits:
    """A bit vector with rank: 64-bit blocks and the count of ones before each."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = flags
        self.blocks = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = n - int(flags.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        b = i >> 6
        mask = (U64(1) << (i & 63).astype(np.uint64)) - U64(1)
        return self.before[b] + np.bitwise_count(self.blocks[b] & mask).astype(np.int64)


class WaveletMatrix:
    """rank of any symbol over a sequence of small integers."""

    def __init__(self, s: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.levels: list[Bits] = []
        for level in range(self.depth - 1, -1, -1):
            bit = ((s >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            s = np.concatenate([s[~bit], s[bit]])
        self.base = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, v in enumerate(self.levels):
            ones = v.rank1(i)
            i = np.where((c >> (self.depth - 1 - k)) & 1, v.zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Times that symbol c stands before position i."""
        return self._walk(c, i) - self.base[c]


class FmIndex:
    """Matching statistics, up to `window`, against texts (arrays of 64-bit word codes)."""

    def __init__(self, texts: list[np.ndarray], window: int):
        assert 1 <= window < DEEPEST
        self.window = window
        lengths = np.array([len(f) for f in texts], np.int64)
        self.alphabet, dense = np.unique(np.concatenate(texts), return_inverse=True)
        self.n = n = int(lengths.sum() + len(lengths))
        inside = np.ones(n, bool)
        inside[np.cumsum(lengths + 1) - 1] = False  # each text is followed by a separator, symbol 0
        text = np.zeros(n, np.int32)
        text[inside] = dense + 1
        symbols = len(self.alphabet) + 1
        # ranks by the first 1, 2, 4, ..., 64 symbols; they are dropped once the rows are in order
        ranks = [text]
        for step in (1, 2, 4, 8, 16, 32):
            ranks.append(self._double(ranks[-1], step))
        rows = np.argsort(ranks[-1], kind="stable")
        self.wavelet = WaveletMatrix(text[rows - 1].astype(np.int64), symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols))))[:-1]
        shared, a, b = np.zeros(n - 1, np.int64), rows[:-1], rows[1:]
        for rank, step in zip(ranks[5::-1], (32, 16, 8, 4, 2, 1)):
            i, j = a + shared, b + shared
            ok = (i < n) & (j < n)
            ok[ok] = rank[i[ok]] == rank[j[ok]]
            shared += step * ok
        #: common prefix of each row and the one before it; 0 at both ends, so that scans stop there
        self.common = np.zeros(n + 1, np.uint8)
        self.common[1:n] = np.minimum(shared, window)
        blocks = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        blocks[: n + 1] = self.common
        self.lows = blocks.reshape(-1, 64).min(axis=1)

    @staticmethod
    def _double(rank: np.ndarray, shift: int) -> np.ndarray:
        n = len(rank)
        second = np.zeros(n, np.int64)
        if shift < n:
            second[: n - shift] = rank[shift:].astype(np.int64) + 1
        _, out = np.unique(rank * np.int64(n + 2) + second, return_inverse=True)
        return out.astype(np.int32)

    @property
    def bytes(self) -> int:
        """Size of what the search reads, without the alphabet."""
        w = self.wavelet
        return sum(v.blocks.nbytes + v.before.nbytes for v in w.levels) + w.base.nbytes + self.first.nbytes + self.common.nbytes + self.lows.nbytes

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The index's symbol of each code, -1 where it has none."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, -1)

    def _scan(self, at: np.ndarray, less: np.ndarray, way: int) -> np.ndarray:
        """The nearest row at or before (way -1) or behind (way 1) `at` whose common prefix is shorter than `less`."""
        out, open_ = at.copy(), np.arange(len(at))
        edge = 63 if way < 0 else 0
        while len(open_):
            open_ = open_[self.common[out[open_]] >= less[open_]]
            out[open_] += way
            far = open_[(out[open_] & 63) == edge]
            while len(far):  # whole blocks without such a row
                far = far[self.lows[out[far] >> 6] >= less[far]]
                out[far] += 64 * way
        return out

    def cut(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first `length` (> 0) symbols of the rows lo .. hi - 1."""
        return self._scan(lo, length, -1), self._scan(hi, length, 1)

    def statistics(self, queries: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query numbers, position, length of the longest match that starts there, exact up to `window`) of all queries in step, from the right."""
        size = np.array([len(q) for q in queries], np.int64)
        order = np.argsort(-size, kind="stable")
        sorted_size = size[order]
        ends = np.cumsum(size)[order]
        text = self.symbols(np.concatenate(queries))
        lo, hi, depth = np.zeros(len(order), np.int64), np.full(len(order), self.n, np.int64), np.zeros(len(order), np.int64)
        for t in range(int(sorted_size[0]) if len(order) else 0):
            live = int(np.searchsorted(-sorted_size, -t, side="left"))  # queries longer than t
            c = text[ends[:live] - 1 - t]
            unknown = np.flatnonzero(c < 0)
            lo[unknown], hi[unknown], depth[unknown] = 0, self.n, 0
            todo = np.flatnonzero(c >= 0)
            while len(todo):
                own, m = c[todo], len(todo)
                both = self.wavelet.rank(np.concatenate([own, own]), np.concatenate([lo[todo], hi[todo]]))
                l, h = self.first[own] + both[:m], self.first[own] + both[m:]
                ok = l < h
                done = todo[ok]
                lo[done], hi[done] = l[ok], h[ok]
                depth[done] += 1
                todo = todo[~ok]  # never at depth 0, as the index has the symbol
                self._parents(todo, lo, hi, depth)
            deep = np.flatnonzero(depth[:live] >= DEEPEST)
            lo[deep], hi[deep] = self.cut(lo[deep], hi[deep], np.full(len(deep), self.window))
            depth[deep] = self.window
            yield order[:live], sorted_size[:live] - 1 - t, depth[:live]

    def _parents(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> None:
        """Cut the matches `at` to the next shorter length whose interval is wider."""
        up = np.maximum(self.common[lo[at]], self.common[hi[at]]).astype(np.int64)
        top, rest = at[up == 0], at[up > 0]
        lo[top], hi[top], depth[top] = 0, self.n, 0
        lo[rest], hi[rest] = self.cut(lo[rest], hi[rest], up[up > 0])
        depth[rest] = up[up > 0]


def alive(flags: np.ndarray, piece: int | None = None) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of windows that aren't flagged, in pieces of at most `piece` windows."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], flags, [True])).astype(np.int8)))
    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    return runs if piece is None else [(i, min(i + piece, b)) for a, b in runs for i in range(a, b, piece)]


def repeats(fragments: list[np.ndarray], keys: np.ndarray, owners: np.ndarray, window: int) -> list[np.ndarray]:
    """For each fragment, flags of the windows that a fragment of the same key and a smaller owner has."""
    flags = [np.zeros(len(f) - window + 1, bool) for f in fragments]
    if not len(fragments):
        return flags
    order = np.lexsort((owners, keys))
    k, o = keys[order], owners[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    step = np.concatenate(([True], new_key[1:] | (o[1:] != o[:-1])))
    number = np.cumsum(step) - 1
    # the owner's place among those of its key, and the key's number
    place, group = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    place[order] = number - np.maximum.accumulate(np.where(new_key, number, 0))
    group[order] = np.cumsum(new_key) - 1
    for level in range(int(place.max()).bit_length()):
        # a left half and the right half beside it
        pair = mix((group * (place.max() + 2) + (place >> (level + 1))).astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(1))
        right = (place >> level) & 1 == 1
        index_of = np.flatnonzero(~right & np.isin(pair, pair[right]))
        code = lambda i, a, b: mix(fragments[i][a : b + window - 1] ^ pair[i])
        texts = [code(i, a, b) for i in index_of for a, b in alive(flags[i])]
        read = [(i, a, b) for i in np.flatnonzero(right) for a, b in alive(flags[i], PIECE)]
        if not texts or not read:
            continue
        found = FmIndex(texts, window).statistics([code(*r) for r in read])
        who, start = np.array([r[0] for r in read]), np.array([r[1] for r in read])
        offset = np.concatenate(([0], np.cumsum([len(f) for f in flags])))
        flat = np.concatenate(flags)
        for q, pos, length in found:
            hit = length >= window
            flat[(offset[who] + start)[q[hit]] + pos[hit]] = True
        flags = [flat[a:b] for a, b in zip(offset[:-1], offset[1:])]
    return flags


# ---- routing


def window_keys(h: np.ndarray, doc: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of the windows, their keys, hashes of all anchors)."""
    runs = mix(rolling(h, anchor) ^ U64(0xA0761D6478BD642F))
    width = window - anchor + 1
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), runs
    low, size = runs, 1
    while 2 * size <= width:
        low, size = np.minimum(low[: len(low) - size], low[size:]), 2 * size
    key = np.minimum(low[:n], low[width - size : width - size + n])
    ok = doc[:n] == doc[window - 1 :]
    return np.flatnonzero(ok), key[ok], runs


def keys_of(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """key, doc_id, part of every row's windows, each once. docs: doc_id, text, part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in row_slices(batches):
            w = Words(raws)
            at, key, _ = window_keys(w.hashes(), w.doc, window, anchor)
            new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (w.doc[at][1:] != w.doc[at][:-1])))) if len(at) else at
            d, k = w.doc[at[new]], key[new]
            order = np.lexsort((k, d))
            d, k = d[order], k[order]
            keep = np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))) if len(d) else np.zeros(0, bool)
            of = np.array([(i["doc_id"], i["part"]) for i in ids], np.int64).reshape(-1, 2)[d[keep]]
            yield pa.RecordBatch.from_arrays([pa.array(k[keep].view(np.int64)), pa.array(of[:, 0]), pa.array(of[:, 1])], ["key", "doc_id", "part"])

    return docs.select(F.struct("doc_id", "part"), "text").mapInArrow(run, "key long, doc_id long, part long")


def fragments_of(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, part, pos, size, key, f1, f2, codes. docs: doc_id, part, text, keys (those to keep), hot (for each degree of refinement, the keys of that degree).

    f1 and f2 are hashes of the words; codes are given once for equal fragments of a task, as far as it remembers them.
    """
    width = window - anchor + 1

    def refine(key: np.ndarray, which: np.ndarray, most: int, at: np.ndarray, runs: np.ndarray) -> None:
        for a in range(0, len(which), 4096):
            own = which[a : a + 4096]
            near = runs[at[own][:, None] + np.arange(width)[None, :]]
            near = np.sort(near, axis=1)[:, 1:]  # the smallest is the key itself
            mixed = mix(key[own])
            for j in range(min(most - 1 if most else width, near.shape[1])):
                mixed = mix(mixed + mix(near[:, j]))
            key[own] = mixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = zip(*(part.column(i).to_pylist() for i in range(5)))
                cols: list[list] = [[] for _ in range(8)]
                if len(seen) > SEEN_FRAGMENTS:
                    seen.clear()
                for i, p, text, keys, hot in rows:
                    w = Words([(text or "").encode("utf-8", "surrogatepass")])
                    h = w.hashes()
                    at, key, runs = window_keys(h, w.doc, window, anchor)
                    if not len(at):
                        continue
                    use = np.isin(key, np.array(keys, np.int64).view(np.uint64))
                    plain = key.copy()
                    for (_, most), some in zip(REFINED, hot):
                        if some:
                            refine(key, np.flatnonzero(use & np.isin(plain, np.array(some, np.int64).view(np.uint64))), most, at, runs)
                    key = np.where(use, key, _MAX)
                    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    stop = np.append(edge[1:], len(key))
                    for a, b in zip(edge[key[edge] != _MAX], stop[key[edge] != _MAX]):
                        words = h[at[a] : at[b - 1] + window]
                        raw = words.tobytes()
                        digest = hashlib.blake2b(raw, digest_size=16).digest()
                        f = np.frombuffer(digest, np.int64).tolist()
                        for col, v in zip(cols, (i, p, int(at[a]), len(words), int(key[a].view(np.int64)), *f, None if digest in seen else raw)):
                            col.append(v)
                        seen.add(digest)
                types = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "part", "pos", "size", "key", "f1", "f2", "codes"])
        seen.clear()
        give_back()

    return docs.select("doc_id", "part", "text", "keys", "hot").mapInArrow(run, "doc_id long, part long, pos long, size long, key long, f1 long, f2 long, codes binary")


def search_keys(window: int):
    """Maps rows sorted by key, f1, f2 (doc_id, and codes or null) to f1, f2, owner, runs: one row for each fragment.

    runs: word ranges of the fragment that windows of documents before the owner cover (flat pairs of start and end).
    """
    names = ["f1", "f2", "owner", "runs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []  # key, f1, f2, owner, codes
        words = 0

        def search() -> pa.RecordBatch:
            rows = [r for r in held if r[4] is not None]
            flags = repeats([np.frombuffer(r[4], np.uint64) for r in rows], np.array([r[0] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64), window)
            out = [(r[1], r[2], r[3], covered(np.flatnonzero(f), window)) for r, f in zip(rows, flags)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                key, f1, f2, doc_id, codes = row
                if held and held[-1][0] != key and words >= SHARD_WORDS:
                    yield search()
                    held, words = [], 0
                if not held or held[-1][0] != key or held[-1][1] != f1 or held[-1][2] != f2:
                    held.append([key, f1, f2, doc_id, None])
                last = held[-1]
                last[3] = min(last[3], doc_id)
                if codes is not None and last[4] is None:
                    last[4], words = codes, words + len(codes) // 8
        if held:
            yield search()
        held.clear()
        give_back()

    return run


def covered(starts: np.ndarray, window: int) -> list[int]:
    """Merged ranges of the words that windows at `starts` (ascending) cover: start, end, start, end, ..."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    a, b = starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))] + window
    return np.column_stack([a, b]).ravel().tolist()


def _part(text):
    """What tells rows of one id apart: rows of equal id and text have equal results."""
    return F.xxhash64(text)


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot_docs: int = HOT_DOCS) -> DataFrame:
    """doc_id, part (xxhash64 of the text), spans: arrays of (start, stop) in words that windows of documents with smaller ids cover. Only rows that have some.

    window: 1 to DEEPEST - 1 words, as common prefixes are held up to DEEPEST.
    """
    if not 1 <= window < DEEPEST:
        raise ValueError(f"a window must have 1 to {DEEPEST - 1} words")
    text = F.col(text_col).cast("string")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), _part(text).alias("part"))
    keys = materialize(keys_of(docs.where("doc_id is not null and text is not null"), window, anchor), "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    degree = sum(((F.col("docs") > hot_docs * over).cast("int") for over, _ in REFINED), F.lit(0))
    hot = F.array(*[F.collect_list(F.when(F.col("degree") == i + 1, F.col("key"))) for i in range(len(REFINED))])
    marks = keys.join(shared.select("key", degree.alias("degree")), "key").groupBy("doc_id", "part").agg(F.collect_list("key").alias("keys"), hot.alias("hot"))
    found = materialize(fragments_of(docs.join(marks, ["doc_id", "part"]), window, anchor), "fragments")
    discard(df.sparkSession, keys)
    total = found.where("codes is not null").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_WORDS))
    owners = found.groupBy("key", "f1", "f2").agg(F.min("doc_id").alias("doc_id")).withColumn("codes", F.lit(None).cast("binary"))
    dealt = owners.unionByName(found.where("codes is not null").select("key", "f1", "f2", "doc_id", "codes")).repartition(tasks, "key")
    hits = dealt.sortWithinPartitions("key", "f1", "f2").mapInArrow(search_keys(window), "f1 long, f2 long, owner long, runs array<int>")
    # a document other than the owner has the whole fragment from the owner
    at = found.select("doc_id", "part", "pos", "size", "f1", "f2").join(hits, ["f1", "f2"])
    runs = F.when(F.col("doc_id") != F.col("owner"), F.array(F.lit(0), F.col("size").cast("int"))).otherwise(F.col("runs"))
    spans = at.select("doc_id", "part", "pos", runs.alias("runs")).where(F.size("runs") > 0)
    flat = F.col("runs")
    span = lambda i: F.struct((F.col("pos") + F.get(flat, 2 * i)).alias("start"), (F.col("pos") + F.get(flat, 2 * i + 1)).alias("stop"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(runs) div 2 - 1").cast("int")), span)
    return spans.select("doc_id", "part", pairs.alias("spans")).groupBy("doc_id", "part").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def cut_text(text: str | None, spans: list | None) -> tuple[int, int, bytes]:
    """Words of the text, words removed, and the kept words joined by a space."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    total = len(words)
    if spans:
        flag = np.zeros(total, bool)
        for s in spans:
            flag[s["start"] : s["stop"]] = True
        words = [w for w, f in zip(words, flag.tolist()) if not f]
    return total, total - len(words), b" ".join(words)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot_docs: int = HOT_DOCS, outputs: str = "digests") -> DataFrame:
    """One row for each row of df. outputs='digests': doc_id, n_words, n_removed, kept_sha256. 'texts': doc_id, n_words, n_removed, kept (the words left, joined by a space).
    'rows': the row's own columns as the struct `row`, n_words, n_removed, kept."""
    spans = repeated_spans(df, id_col, text_col, window, anchor, hot_docs)
    text = F.col(text_col).cast("string")
    own = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if outputs == "rows" else F.col(id_col).cast("long")
    docs = df.select(own.alias("own"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"), _part(text).alias("part"))
    rows = docs.join(spans, ["doc_id", "part"], "left").select("own", "text", "spans")
    first, last = "row" if outputs == "rows" else "doc_id", "kept_sha256" if outputs == "digests" else "kept"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                got = [cut_text(t, s) for t, s in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                kept = [hashlib.sha256(k).hexdigest() if outputs == "digests" else k.decode("utf-8", "surrogatepass") for _, _, k in got]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _, _ in got], pa.int64()), pa.array([g for _, g, _ in got], pa.int64()), pa.array(kept, pa.string())], [first, "n_words", "n_removed", last])

    schema = StructType().add(first, rows.schema["own"].dataType).add("n_words", LongType()).add("n_removed", LongType()).add(last, StringType())
    return rows.mapInArrow(run, schema)
