"""Exact Jaccard join of word shingle sets by universe partition and pigeonhole.

Two sets r, s with |r| <= |s| and Jaccard >= t differ in at most H = 2|s|(1-t)/(1+t) elements. For each
band of sizes (of the larger set) the universe of shingles is hashed into m segments; the parts of r and s
in a segment agree unless one of the differing elements falls there. A set whose parts are non-empty in at
least H + c segments therefore agrees with every partner in at least c of them. Bands of small sets use
one-deletion neighbourhoods instead: a segment of two or more elements then only disagrees if two elements
differ there, so it counts twice. What a band uses is allocated by cost (signatures to index, and segments
of one element, which select badly). A set that has too few usable segments is indexed again with the next
seed, until one does; a partner is met at the smaller of both seeds, so none is lost.

Shingles that are very frequent say little and would make hot lists. They are left out of the signatures
(differences without them can only be fewer, so the argument holds for any left-out set); sets that consist mostly of
them are indexed in full, in a scheme of their own, which every pair of such sets shares.

Only sets that may have a partner are signed. The pass that describes the texts keeps each set's smallest elements: a fifth (at 0.8), so that linked sets share
one of them, and a few more, so that they share several. Sets that share fewer of them with other sets link with nothing.

Equal sets are one class from the start. Signatures are packed and met in buckets, where classes of a
short list are paired and counted, and the classes of a long list are tied by a star, without pairs. Pairs
with at least c common signatures form candidate groups, in which sets are compared exactly inside a task; only a forest of
links leaves it. A group of one block is compared whole. Of a larger group each block is compared with itself and with SEED_SETS seeds of
the group, which ties a family of copies together at a cost in proportion to it. A link that this leaves out is one between two components: its sets
share one of the smallest elements of each (prefix filtering), so only sets with such an element in common with another component are
compared once more, by pairs of blocks, and no link is lost.

Cases: null texts and texts without words have no shingles, and link with nothing; texts of fewer words than
`k` have their whole sequence as one shingle; equal texts share a class and a component; rows of one id are judged each by its own
text; rows without an id have no component and link nothing; an empty table gives an empty result; very long texts cost memory in proportion to
their length; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.components import components, forest
from strandlake.llm.kernels import U64, Words, give_back, mix, rolling, row_slices
from strandlake.llm.shared import discard, materialize

K = 5
NUM, DEN = 80, 100
#: Least similarity that signatures serve.
LEAST_SIMILARITY = 0.7
#: A shingle this frequent (counted where a slice of text holds it SLICE_DF times) is left out of signatures.
FREQUENT_DF, SLICE_DF, MAX_FREQUENT = 64, 3, 200_000
#: Lists up to this length are paired; longer ones become a star.
PAIRED = 16
SEEDS = 4
BLOCK_SETS, BLOCK_SHINGLES, SEED_SETS = 500, 500_000, 32
#: Copies of a set of a large group that are shuffled at once, when pairs of its blocks are compared.
ROUND_COPIES = 4
PACK_SHINGLES = 1_500_000
BUCKET_SHINGLES = 2_000_000
#: Bytes of text whose signatures are made at once; each takes some 200 bytes of arrays.
SIGNED_BYTES = 1 << 20
#: Passes over the texts, each with the signatures of its share of the bands: only these are on disk at once. A pair is met in one band, so in one pass.
#: Where the sets that are signed have at most one PASSES-th of all shingles, one pass has no more on disk.
PASSES = 2
#: A set's prefix is longer by one and this share of its size than what makes linked sets share one element.
PREFIX_SHARE = 20
#: Smallest elements of sets that meet in a bucket.
PREFIX_ELEMENTS = 1_500_000
#: Bits that a filter has for each of its ids, and most bits (16 MB). A fuller filter lets more rows pass, and loses none.
FILTER_BITS, MOST_BITS = 16, 1 << 27
#: A filter is made where there are this many times as many rows as ids.
FILTERED_FROM = 1.25


def shingle_sets(raws: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles, sorted by text, then hash. A-Z are lower-cased."""
    w = Words(raws, lower=True)
    h = w.hashes()
    n = w.first[1:] - w.first[:-1]
    runs = rolling(h, k)
    doc = w.doc[: len(runs)]
    ok = doc == w.doc[k - 1 :] if len(runs) else np.zeros(0, bool)
    x, d = runs[ok], doc[ok]
    cut = np.searchsorted(d, np.arange(len(raws) + 1))
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        x[lo:hi].sort()
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = [rolling(h[w.first[i] : w.first[i + 1]], int(n[i]), 1 + int(n[i]))[0] for i in short]
        x, d = np.insert(x, cut[short], np.array(whole, np.uint64)), np.insert(d, cut[short], short)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return x[keep], d[keep]


def class_hashes(x: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two order-free 64-bit hashes of each set."""
    a, b = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    np.add.at(a, d, mix(x ^ U64(0x5851F42D4C957F2D)))
    np.add.at(b, d, mix(x + U64(0x14057B7EF767814F)))
    return mix(a), mix(b)


class Band:
    """Sizes lo..hi of the larger set, least size of the smaller, and how segments are allocated."""

    def __init__(self, lo: int, hi: int, num: int, den: int):
        self.lo, self.hi = lo, hi
        self.least = -(-num * lo // den)
        self.h = 2 * hi * (den - num) // (den + num)
        self.c, self.m, self.deletions = 1, 0, False
        if self.h == 0:
            return  # only equal sets
        best = None
        for deletions in (False, True):
            unit = 2 if deletions else 1
            c = 1 if deletions else 1 + self.h // 10
            m = -(-(self.h + c) // unit)
            while True:
                p0 = np.exp(-self.least / m)
                p1 = p0 * self.least / m
                weak = m * (p0 + p1 if deletions else p0)
                if unit * (m - weak - 1.5 * np.sqrt(weak)) >= self.h + c or m > 4 * (self.h + c) + 8:
                    break
                m += max(1, m // 64)
            cost = m + deletions * self.lo + 6 * m * (p0 + p1)
            if best is None or cost < best[0]:
                best = cost, c, m, deletions
        _, self.c, self.m, self.deletions = best


@lru_cache
def bands(num: int, den: int, largest: int = 1 << 34) -> list[Band]:
    out, lo = [], 1
    while lo < largest:
        hi = max(lo, lo * den // num)
        out.append(Band(lo, hi, num, den))
        lo = hi + 1
    return out


def schemes_of(size: int, num: int, den: int) -> list[int]:
    """Bands in which a set of this size takes part."""
    return [i for i, b in _near(size, num, den) if b.least <= size <= b.hi and b.h]


def _near(size: int, num: int, den: int):
    every = bands(num, den)
    his = _his(num, den)
    i = int(np.searchsorted(his, size))
    return [(j, every[j]) for j in range(max(0, i - 1), min(len(every), i + 3))]


@lru_cache
def _his(num: int, den: int) -> np.ndarray:
    return np.array([b.hi for b in bands(num, den)], np.float64)


def signatures(x: np.ndarray, d: np.ndarray, size: np.ndarray, frequent: np.ndarray, num: int = NUM, den: int = DEN, passes: int = 1, now: int = 0):
    """(text, scheme, signature) arrays. scheme = (band * 2 + full) * 64 + seed.

    size: the full sets' sizes. frequent: sorted hashes that are left out while a set has enough others. Of several passes, each has the bands of its remainder.
    """
    n = len(size)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        rare = frequent[at] != x
    else:
        rare = np.ones(len(x), bool)
    first = np.searchsorted(d, np.arange(n + 1))
    todo: dict[int, list[int]] = {}
    for i in np.flatnonzero(size > 0):
        for b in schemes_of(int(size[i]), num, den):
            if b % passes == now:
                todo.setdefault(b, []).append(int(i))
    out_d, out_s, out_g = [], [], []
    for b, members in todo.items():
        band = bands(num, den)[b]
        need = band.h + band.c
        for full in (0, 1):
            live = np.array(members, np.int64)
            seed = 0
            while len(live) and seed < (SEEDS if not full else 64):
                lens = first[live + 1] - first[live]
                idx = np.repeat(first[live], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
                own = np.repeat(np.arange(len(live)), lens)
                if not full:
                    keep = rare[idx]
                    idx, own = idx[keep], own[keep]
                v = x[idx]
                scheme = (b * 2 + full) * 64 + seed
                salt = U64((scheme * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
                e = mix(v ^ salt)
                seg = ((e >> U64(32)) * U64(band.m)) >> U64(32)
                key = own.astype(np.uint64) * U64(band.m) + seg
                order = np.argsort(key)
                key, e = key[order], mix(e[order] + U64(1))
                starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                counts = np.diff(np.append(starts, len(key)))
                total = np.add.reduceat(e, starts) if len(starts) else np.zeros(0, np.uint64)
                owner = (key[starts] // U64(band.m)).astype(np.int64)
                place = mix((key[starts] % U64(band.m)) ^ salt)
                sig, who = mix(total + place), owner
                weight = np.ones(len(starts), np.int64)
                if band.deletions:
                    weight[counts >= 2] = 2
                    each = np.repeat(np.arange(len(starts)), counts)
                    two = counts[each] >= 2
                    sig = np.concatenate([sig, mix(total[each][two] - e[two] + place[each][two])])
                    who = np.concatenate([who, owner[each][two]])
                out_d.append(live[who])
                out_s.append(np.full(len(who), scheme, np.int64))
                out_g.append(sig)
                usable = np.bincount(owner, weight, len(live))
                live = live[usable < need]
                seed += 1
            members = live.tolist()  # those that are left are indexed in full
            if not members:
                break
        if members:
            raise ValueError("a set can't be indexed")
    if not out_d:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_d), np.concatenate(out_s), np.concatenate(out_g)


def needed(scheme: int, num: int = NUM, den: int = DEN) -> int:
    """Common signatures that a scheme guarantees for every pair."""
    return bands(num, den)[scheme // 128].c


# ---- stages


def extra(size):
    """How many elements a set of this size has in its prefix beyond those that make linked sets share one."""
    return size // PREFIX_SHARE


def prefix_lengths(size, num: int, den: int):
    """Smallest elements of a set that meet others'."""
    return np.where(size > 0, size + 1 - -(-num * size // den) + extra(size), 0)


def shared_least(size, num: int, den: int):
    """Elements of its prefix that a set shares with the prefix of any set that it links with.

    Both have at least num/den of their elements in common, so the j-th smallest common element is among the first size - ceil(num/den size) + j of either; j is
    what both prefixes allow, and the partner has at least num/den of the set's size.
    """
    return 1 + extra(-(-num * size // den))


def describe(df: DataFrame, k: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n, h1, h2 of each text, and rows of null doc_id whose `often` holds shingles frequent within a slice and whose `least` holds its sets' prefixes."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in row_slices(batches):
            x, d = shingle_sets(raws, k)
            n = np.bincount(d, minlength=len(raws))
            a, b = class_hashes(x, d, len(raws))
            # equal sets count once, so copies alone don't make a shingle frequent
            fresh = np.zeros(len(raws), bool)
            fresh[np.unique(a, return_index=True)[1]] = True
            seen, times = np.unique(x[fresh[d]], return_counts=True)
            hot = times >= SLICE_DF
            often = [[(int(s), int(t)) for s, t in zip(seen[hot].view(np.int64), times[hot])]]
            own = np.where(fresh, n, 0)
            first = np.concatenate(([0], np.cumsum(n)))[d]
            taken = np.arange(len(x)) - first < prefix_lengths(own, num, den)[d]
            least = _pack_prefixes(a[own > 0], own[own > 0], prefix_lengths(own, num, den)[own > 0], x[taken])
            pad = lambda v, t: pa.concat_arrays([pa.array(v, t), pa.nulls(1, t)])
            id_type = pa.array(ids).type if any(i is not None for i in ids) else pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pad(ids, id_type), pad(n, pa.int64()), pad(a.view(np.int64), pa.int64()), pad(b.view(np.int64), pa.int64()),
                 pa.array([None] * len(raws) + often, pa.list_(pa.struct([("x", pa.int64()), ("n", pa.int64())]))),
                 pa.array([None] * len(raws) + [least], pa.binary())],
                ["doc_id", "n", "h1", "h2", "often", "least"],
            )

    return df.mapInArrow(run, f"doc_id {kind}, n long, h1 long, h2 long, often array<struct<x:long,n:long>>, least binary")


#: Bits of an element that prefixes keep: 32 to compare within a bucket, 16 to deal to buckets. Other elements with the same bits let sets pass, and lose none.
_PREFIX_BITS = U64((1 << 48) - 1)


def _pack_prefixes(h: np.ndarray, size: np.ndarray, counts: np.ndarray, x: np.ndarray) -> bytes:
    parts = np.array([len(h)], np.uint64), h, size.astype(np.uint32), counts.astype(np.uint32), x.astype(np.uint32), (x >> U64(32)).astype(np.uint16)
    return b"".join(p.tobytes() for p in parts)


def _unpack_prefixes(raw: bytes):
    n = int(np.frombuffer(raw, np.uint64, 1)[0])
    h, (size, counts) = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.uint32, 2 * n, 8 + 8 * n).reshape(2, n)
    m = int(counts.sum())
    low, high = np.frombuffer(raw, np.uint32, m, 8 + 16 * n), np.frombuffer(raw, np.uint16, m, 8 + 16 * n + 4 * m)
    return h, size, counts, low, high


def dealt_prefixes(packed: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """bucket, blob: a slice's prefixes by bucket of the elements. Frequent ones aren't compared: they count as shared (scheme 1), and are dealt by set."""
    often = np.unique(frequent & _PREFIX_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                h, size, counts, low, high = _unpack_prefixes(raw)
                if not len(h):
                    continue
                who = np.repeat(np.arange(len(h)), counts)
                scheme = np.zeros(len(low), np.int64)
                if len(often):
                    x = low | (high.astype(np.uint64) << U64(32))
                    scheme = (often[np.minimum(np.searchsorted(often, x), len(often) - 1)] == x).astype(np.int64)
                bucket = np.where(scheme == 1, (h[who] % U64(buckets)).astype(np.int64), high.astype(np.int64) % buckets)
                yield pa.RecordBatch.from_arrays(_blobs(bucket, who, scheme, h, size, low), ["bucket", "blob"])

    return packed.mapInArrow(run, "bucket int, blob binary")


def _blobs(bucket: np.ndarray, who: np.ndarray, scheme: np.ndarray, h: np.ndarray, size: np.ndarray, rest: np.ndarray) -> list[pa.Array]:
    """Packed entries of each bucket: who and scheme go with a run of entries, h and size with who."""
    order = np.argsort((bucket * len(h) + who) * (int(scheme.max(initial=0)) + 1) + scheme)
    who, scheme, bucket, rest = who[order], scheme[order], bucket[order], rest[order]
    edge = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (scheme[1:] != scheme[:-1]) | (bucket[1:] != bucket[:-1]))))[: len(who)]
    counts = np.diff(np.append(edge, len(who)))
    eb = bucket[edge]
    starts = np.flatnonzero(np.concatenate(([True], eb[1:] != eb[:-1])))[: len(eb)]
    rows = []
    for i, j in zip(starts, np.append(starts[1:], len(eb))):
        at = edge[i:j]
        rows.append(_pack(h[who[at]], size[who[at]], scheme[at], counts[i:j], rest[at[0] : at[-1] + counts[j - 1]]))
    return [pa.array(eb[starts], pa.int32()), pa.array(rows, pa.binary())]


def shared_elements(table: pa.Table, buckets: int) -> pa.Table:
    """bucket (by set), blob: how many of a bucket's elements each set shares with another; the counts stand as (h, size, count)."""
    h, size, scheme, rest = _unpack(table.column("blob").to_pylist())
    sure = scheme == 1
    order = np.lexsort((h, rest, scheme))
    h, size, scheme, rest, sure = h[order], size[order], scheme[order], rest[order], sure[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (rest[1:] != rest[:-1]) | (scheme[1:] != scheme[:-1])
    h, size, rest, sure = h[keep], size[keep], rest[keep], sure[keep]
    same = (rest[1:] == rest[:-1]) & (sure[1:] == sure[:-1])
    met = sure.copy()
    met[1:] |= same
    met[:-1] |= same
    h, at, counts = np.unique(h[met], return_index=True, return_counts=True)
    size, to = size[met][at], (h % U64(buckets)).astype(np.int32)
    order = np.argsort(to, kind="stable")
    starts = np.searchsorted(to[order], np.arange(buckets + 1))
    names, rows = [], []
    for b in range(buckets):
        own = order[starts[b] : starts[b + 1]]
        if len(own):
            names.append(b)
            rows.append(np.array([len(own)], np.uint64).tobytes() + h[own].tobytes() + size[own].astype(np.uint32).tobytes() + counts[own].astype(np.uint32).tobytes())
    return pa.table([pa.array(names, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "blob"])


def sharing_enough(table: pa.Table, num: int, den: int) -> pa.Table:
    """h1 of a bucket's sets that share enough elements in all."""
    hs, sizes, counts = [], [], []
    for raw in table.column("blob").to_pylist():
        n = int(np.frombuffer(raw, np.uint64, 1)[0])
        hs.append(np.frombuffer(raw, np.uint64, n, 8))
        both = np.frombuffer(raw, np.uint32, 2 * n, 8 + 8 * n)
        sizes.append(both[:n])
        counts.append(both[n:])
    h, at, back = np.unique(np.concatenate(hs), return_index=True, return_inverse=True)
    total = np.bincount(back, np.concatenate(counts)).astype(np.int64)
    enough = total >= shared_least(np.concatenate(sizes)[at].astype(np.int64), num, den)
    return pa.table([pa.array(h[enough].view(np.int64))], names=["h1"])


def with_partners(seen: DataFrame, frequent: np.ndarray, buckets: int, num: int, den: int) -> DataFrame:
    """h1 of the sets that may link with another one: those that share enough of their smallest elements with others."""
    dealt = dealt_prefixes(seen.where("least is not null").select("least"), frequent, buckets)
    shared = dealt.groupBy("bucket").applyInArrow(_then_give_back(lambda t: shared_elements(t, buckets)), "bucket int, blob binary")
    return shared.groupBy("bucket").applyInArrow(_then_give_back(lambda t: sharing_enough(t, num, den)), "h1 long")


def _filter_bits(ids: np.ndarray, size: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % U64(size)).astype(np.int64)


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """Flags that _passing tests: every one of the n ids (longs without nulls) passes, and few others do. Bits are joined in tasks; the driver gets one row a byte at most."""
    size = min(MOST_BITS, max(1 << 10, 1 << (FILTER_BITS * max(n, 1) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _filter_bits(batch.column(0).to_numpy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bit"])

    got = ids.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.uint64)
    out[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _passing(ids: list, words: np.ndarray) -> np.ndarray:
    """Which ids may be among the filter's; a null isn't."""
    there = np.array([i is not None for i in ids], bool)
    at = _filter_bits(np.array([i or 0 for i in ids], np.int64), len(words) << 6)
    return there & ((words[at >> 6] >> (at & 63).astype(np.uint64)) & U64(1)).astype(bool)


def bucketed(df: DataFrame, frequent: np.ndarray, buckets: int, k: int, num: int, den: int, signed: np.ndarray | None = None, passes: int = 1, now: int = 0) -> DataFrame:
    """bucket, blob: packed signatures of one slice of texts, in the bands of one pass. Equal sets of a slice are packed once; `signed` is a filter of the ids that are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in row_slices(batches, SIGNED_BYTES):
            if signed is not None:
                raws = [r for r, ok in zip(raws, _passing(ids, signed).tolist()) if ok]
                if not raws:
                    continue
            x, d = shingle_sets(raws, k)
            size = np.bincount(d, minlength=len(raws))
            h1, _ = class_hashes(x, d, len(raws))
            fresh = np.zeros(len(raws), bool)
            fresh[np.unique(h1, return_index=True)[1]] = True
            keep = fresh[d]
            size = np.where(fresh, size, 0)
            who, scheme, sig = signatures(x[keep], d[keep], size, frequent, num, den, passes, now)
            if not len(who):
                continue
            bucket = (sig % U64(buckets)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(_blobs(bucket, who, scheme, h1, size, (sig >> U64(32)).astype(np.uint32)), ["bucket", "blob"])
        give_back()

    return df.mapInArrow(run, "bucket int, blob binary")


def _pack(h: np.ndarray, size: np.ndarray, scheme: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> bytes:
    """Sizes, schemes and counts are compressed byte by place, as they are small or alike; hashes don't compress."""
    small = np.concatenate([size, scheme, counts]).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    small = pa.compress(small, codec="zstd", asbytes=True)
    return np.array([len(h), len(small)], np.uint32).tobytes() + small + h.tobytes() + rest.tobytes()


def _unpack(blobs: list[bytes]):
    cols: list[list[np.ndarray]] = [[], [], [], []]
    for raw in blobs:
        n, taken = (int(v) for v in np.frombuffer(raw, np.uint32, 2))
        small = pa.decompress(raw[8 : 8 + taken], 12 * n, codec="zstd", asbytes=True)
        size, scheme, counts = np.ascontiguousarray(np.frombuffer(small, np.uint8).reshape(4, -1).T).view("<u4").reshape(3, n)
        h = np.frombuffer(raw, np.uint64, n, 8 + taken)
        for c, v in zip(cols, (np.repeat(h, counts), np.repeat(size, counts), np.repeat(scheme, counts), np.frombuffer(raw, np.uint32, -1, 8 + taken + 8 * n))):
            c.append(v)
    return [np.concatenate(c) for c in cols]


def candidate_pairs(table: pa.Table, num: int, den: int, paired: int = PAIRED) -> pa.Table:
    """(scheme, a, b, common, tied) of a bucket: pairs with their common signatures, and stars of long lists (tied)."""
    names = ["scheme", "a", "b", "common", "tied"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    blobs = table.column("blob").to_pylist()
    parts: list[list[np.ndarray]] = [[], [], [], [], []]

    def add(scheme, a, b, common, tied):
        for c, v in zip(parts, (scheme, a, b, common, np.full(len(a), tied))):
            c.append(v)

    if blobs:
        h, size, scheme, rest = _unpack(blobs)
        order = np.lexsort((h, rest, scheme))
        h, size, scheme, rest = h[order], size[order].astype(np.int64), scheme[order].astype(np.int64), rest[order]
        same = (scheme[1:] == scheme[:-1]) & (rest[1:] == rest[:-1])
        keep = np.concatenate(([True], ~(same & (h[1:] == h[:-1])))) if len(h) else np.zeros(0, bool)
        h, size, scheme, rest = h[keep], size[keep], scheme[keep], rest[keep]
        starts = np.flatnonzero(np.concatenate(([True], (scheme[1:] != scheme[:-1]) | (rest[1:] != rest[:-1]))))
        counts = np.diff(np.append(starts, len(h)))
        ps, pa_, pb = [], [], []
        for g in np.unique(counts[(counts > 1) & (counts <= paired)]):
            at = starts[counts == g]
            for i in range(int(g) - 1):
                j = np.arange(i + 1, int(g))
                l, r = np.repeat(at + i, len(j)), (at[:, None] + j[None, :]).ravel()
                near = np.minimum(size[l], size[r]) * den >= np.maximum(size[l], size[r]) * num
                l, r = l[near], r[near]
                ps.append(scheme[l])
                pa_.append(h[l])
                pb.append(h[r])
        if ps:
            ps, pa_, pb = map(np.concatenate, (ps, pa_, pb))
            order = np.lexsort((pb, pa_, ps))
            ps, pa_, pb = ps[order], pa_[order], pb[order]
            first = np.flatnonzero(np.concatenate(([True], (ps[1:] != ps[:-1]) | (pa_[1:] != pa_[:-1]) | (pb[1:] != pb[:-1])))) if len(ps) else np.zeros(0, np.int64)
            add(ps[first], pa_[first].view(np.int64), pb[first].view(np.int64), np.diff(np.append(first, len(ps))), False)
        ties: set[tuple[int, int]] = set()
        for s, c in zip(starts[counts > paired], counts[counts > paired]):
            root = int(h[s].view(np.int64))
            ties.update((root, int(v)) for v in h[s + 1 : s + c].view(np.int64))
        if ties:
            t = np.array(sorted(ties), np.int64)
            # a forest of them is enough
            t = t[forest(t[:, 0], t[:, 1])]
            add(np.full(len(t), -1, np.int64), t[:, 0], t[:, 1], np.ones(len(t), np.int64), True)
    cols = [np.concatenate(c) if c else np.zeros(0) for c in parts]
    return pa.table([pa.array(c.astype(bool) if t == pa.bool_() else c.astype(np.int64), t) for c, t in zip(cols, types)], names=names)


def links_among(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sets of distinct elements, by exact counts.

    Components grow set by set: each set that joins is counted against the sets that no component has yet, through lists of the sets
    that have an element. The lists are made anew once half of their sets are taken, so a family of copies costs about its elements, not its pairs.
    """
    size = np.array([len(s) for s in sets], np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate(([0], np.cumsum(size)))
    owner = np.repeat(np.arange(len(sets)), size)
    free = np.ones(len(sets), bool)
    out: list[tuple[int, int]] = []

    def lists():
        at = np.flatnonzero(free[owner])
        at = at[np.argsort(column[at], kind="stable")]
        return owner[at], np.searchsorted(column[at], np.arange(columns + 1))

    columns = int(column.max()) + 1
    members, start = lists()
    listed = left = len(sets)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        left -= 1
        todo = [seed]
        while todo and left:
            if 2 * left < listed:
                (members, start), listed = lists(), left
            i = todo.pop()
            own = column[first[i] : first[i + 1]]
            lo, n = start[own], start[own + 1] - start[own]
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(members[at], minlength=len(sets))
            seen = np.flatnonzero(common)
            common = common[seen]
            ok = free[seen] & (den * common >= num * (size[i] + size[seen] - common))
            for j in seen[ok].tolist():
                out.append((int(ids[i]), int(ids[j])))
                todo.append(j)
            free[seen[ok]] = False
            left -= int(ok.sum())
    return out


def verify_group(table: pa.Table, num: int, den: int) -> pa.Table:
    """Links of the candidate groups of one pack, or of a block of a group with what meets it."""
    out: list[tuple[int, int]] = []
    groups, ids = np.array(table.column("grp").to_pylist(), np.int64), np.array(table.column("h1").to_pylist(), np.int64)
    items = table.column("items").to_pylist()
    order = np.lexsort((ids, groups))
    cut = np.flatnonzero(np.concatenate(([True], groups[order][1:] != groups[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    for lo, hi in zip(cut, np.append(cut[1:], len(order))):
        at = order[lo:hi]
        at = at[np.concatenate(([True], ids[at][1:] != ids[at][:-1]))]  # a class once
        if len(at) > 1:
            out += links_among(ids[at], [np.frombuffer(items[i], np.uint64) for i in at], num, den)
    return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, num: int = NUM, den: int = DEN, buckets: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard >= num/den) of each row.

    Thresholds below LEAST_SIMILARITY are refused: sets then differ in so many elements that signatures of some sizes can't guarantee a common one.
    """
    if not LEAST_SIMILARITY <= num / den <= 1:
        raise ValueError(f"a similarity of {num}/{den} can't be indexed; it must be between {LEAST_SIMILARITY} and 1")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = materialize(describe(docs, k, num, den), "sets")
    shingles = seen.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    often = (
        seen.where("often is not null").select(F.explode("often").alias("o")).groupBy("o.x").agg(F.sum("o.n").alias("n"))
        .where(F.col("n") >= FREQUENT_DF).orderBy(F.desc("n"), "x").limit(MAX_FREQUENT).select("x").toArrow()
    )
    frequent = np.sort(often.column("x").to_numpy().astype(np.int64).view(np.uint64))
    sets = seen.where("often is null")
    classes = materialize(sets.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "classes")

    # of equal sets one document is signed, wherever the others are, and of these the ones that may have a partner
    share = 1 - num / den + 1 / PREFIX_SHARE
    dealt = min(1 << 16, max(least_buckets, -(-int(shingles * share) // PREFIX_ELEMENTS)))
    paired = materialize(classes.join(with_partners(seen, frequent, dealt, num, den), "h1", "left_semi").select("rep", "n"), "paired")
    rows = sets.count()
    distinct, items = paired.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    signed = id_filter(paired.select("rep"), distinct) if distinct * FILTERED_FROM < rows else None
    discard(spark, paired)
    passes = 1 if items * PASSES <= shingles else PASSES
    if not buckets:  # a bucket's signatures fit in a task, whatever the input
        buckets = max(least_buckets, -(-items * PASSES // (BUCKET_SHINGLES * passes)))
    least = F.element_at(F.array(*[F.lit(b.c) for b in bands(num, den)]), (F.greatest(F.col("scheme"), F.lit(0)) / 128).cast("int") + 1)
    edges = None
    for now in range(passes):
        packed = bucketed(docs, frequent, buckets, k, num, den, signed, passes, now)
        pairs = packed.groupBy("bucket").applyInArrow(_then_give_back(lambda t: candidate_pairs(t, num, den)), "scheme long, a long, b long, common long, tied boolean")
        pairs = pairs.groupBy("scheme", "a", "b").agg(F.sum("common").alias("common"), F.max("tied").alias("tied"))
        found = materialize(pairs.where(F.col("tied") | (F.col("common") >= least)).select("a", "b"), "pairs")
        edges = found if edges is None else edges.unionByName(found)
    groups = materialize(with_roots(components(edges)).withColumnRenamed("node", "h1"), "groups")
    members = materialize(groups.join(classes, "h1").select("root", "h1", "rep", "n"), "members")
    discard(spark, groups)

    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("items"))
    sizes = sizes.where("sets > 1").select("root", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("items") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    packs = max(1, -(-total // PACK_SHINGLES), min(buckets, total // 50_000))
    placed = materialize(members.join(sizes, "root").select("root", "h1", "rep", "blocks", F.pmod(F.xxhash64("h1", F.lit(5)), F.col("blocks")).cast("int").alias("block")), "placed")
    discard(spark, members)
    wanted = placed.count()
    texts = possible(docs, id_filter(placed.select("rep"), wanted)) if wanted * FILTERED_FROM < rows else docs
    held = materialize(set_table(texts, placed, k), "held")
    pack = F.pmod(F.xxhash64("root"), F.lit(packs))
    links = verified(held.where("blocks = 1").select(pack.alias("task"), F.col("root").alias("grp"), "h1", "items"), num, den)
    large = not placed.where("blocks > 1").isEmpty()
    discard(spark, placed)
    if large:
        links = links.unionByName(links_of_large_groups(held.where("blocks > 1"), num, den))
    # classes that are linked, and the smallest id of each component
    roots = materialize(with_roots(components(links)).join(classes, F.col("node") == F.col("h1")).select("root", "h1", "rep"), "roots")
    discard(spark, held)
    least = roots.groupBy("root").agg(F.min("rep").alias("component"))
    linked = classes.join(roots.join(least, "root").select("h1", "component"), "h1", "left")
    labelled = sets.join(linked, ["h1", "h2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def with_roots(found: DataFrame) -> DataFrame:
    """Components with their roots as nodes of their own."""
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def possible(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """Rows of docs (doc_id, text) whose id passes a filter, before their texts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_passing(batch.column(0).to_pylist(), wanted)))

    return docs.mapInArrow(run, "doc_id long, text string")


def set_table(docs: DataFrame, placed: DataFrame, k: int) -> DataFrame:
    """placed (with h1 and rep, the class and a document of it) with items, the set's shingles: from the texts of the documents, each class once."""
    names = ["h1", "root", "blocks", "block"]

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raws = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(0).to_pylist()]
                x, d = shingle_sets(raws, k)
                # of an id's rows with other texts, that of the class
                own = np.flatnonzero(class_hashes(x, d, len(raws))[0].view(np.int64) == part.column(1).to_numpy())
                cut = np.searchsorted(d, np.arange(len(raws) + 1))
                blobs = pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in own], pa.binary())
                kept = part.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([kept.column(i + 1) for i in range(4)] + [blobs], [*names, "items"])

    rows = docs.join(placed.hint("merge"), docs.doc_id == placed.rep).withColumn("same", F.xxhash64("text")).dropDuplicates(["h1", "same"])
    return rows.select("text", *names).mapInArrow(items, "h1 long, root long, blocks int, block int, items binary")


def _then_give_back(f):
    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return run


def verified(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links a, b of the sets of each group of a task. rows: task, grp, h1, items."""
    return rows.groupBy("task").applyInArrow(_then_give_back(lambda t: verify_group(t, num, den)), "a long, b long")


def links_of_large_groups(held: DataFrame, num: int, den: int) -> DataFrame:
    """Links that tie the components of groups of several blocks. held: h1, root, blocks, block, items."""
    by_hash = Window.partitionBy("root").orderBy(F.xxhash64("h1"), "h1")
    seeds = held.select("root", "h1").withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= SEED_SETS).select("root", "h1")
    # a set goes to its block, a seed to the others' as well
    own = held.select("root", "block", "h1", "items")
    others = held.join(seeds, ["root", "h1"], "left_semi").select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "h1", "items", F.col("block").alias("home")).where("block <> home").drop("home")
    task = F.xxhash64("root", "block")
    links = materialize(verified(own.unionByName(others).select(task.alias("task"), task.alias("grp"), "h1", "items"), num, den), "links")
    # sets that share an element of their prefixes with a set of another component of the group
    tied = components(links)
    tied = materialize(held.select("root", "h1").join(tied.select("node", F.col("root").alias("tie")), F.col("h1") == F.col("node"), "left").select("root", "h1", F.coalesce("tie", "h1").alias("tie")), "tied")
    if tied.groupBy("root").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a < b").isEmpty():
        return links
    elements = prefixes(held.select("h1", "items"), num, den).join(tied, "h1")
    across = elements.groupBy("root", "x").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a < b").select("root", "x")
    open_ = materialize(elements.join(across, ["root", "x"]).select("root", "h1").distinct(), "open")
    parts = open_.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK_SETS).cast("int").alias("parts"))
    rest = held.select("root", "h1", "items").join(open_, ["root", "h1"]).join(parts, "root").withColumn("part", F.pmod(F.xxhash64("h1", F.lit(9)), F.col("parts")).cast("int"))
    rest = rest.select("root", "h1", "items", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    task = F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other"))
    pairs = rest.select(task.alias("task"), task.alias("grp"), "h1", "items")
    # a set goes to as many pairs of blocks as its group has parts: in rounds, so that only ROUND_COPIES of it are on disk at once
    size = parts.agg(F.coalesce(F.sum(F.col("parts") * F.col("parts")), F.lit(0)).alias("copies"), F.coalesce(F.sum("parts"), F.lit(1)).alias("once")).first()
    rounds = max(1, -(-size["copies"] // (ROUND_COPIES * max(size["once"], 1))))
    for i in range(rounds):
        links = links.unionByName(materialize(verified(pairs.where(F.pmod(F.xxhash64("task", F.lit(7)), F.lit(rounds)) == i), num, den), "links"))
    return links


def prefixes(held: DataFrame, num: int, den: int) -> DataFrame:
    """h1, x: each set's smallest elements, so many that linked sets share one: they have at least num/den of either's elements in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, xs = [], []
                for i, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    x = np.sort(np.frombuffer(raw, np.uint64))
                    x = x[: len(x) + 1 - -(-num * len(x) // den)]
                    ids.append(np.full(len(x), i, np.int64))
                    xs.append(x.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(xs))], ["h1", "x"])

    return held.mapInArrow(run, "h1 long, x long")
