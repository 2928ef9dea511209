"""Language identification by multilingual mixture inference.

Each language has a smoothed distribution over hashed runs of three bytes. A document's words are drawn from
a mixture of languages; expectation-maximisation estimates the proportions. The set of languages is
then chosen by penalised likelihood: the sets tried are nested, the one, two, ... most frequent languages (not every set), each set's
proportions are estimated anew, and each language costs half the logarithm of the number of words.
The predicted language is the largest of the chosen set, the score its proportion.

Learning sees a bounded sample (`max_train` rows, by a hash of the id) with a known language; n-gram counts are
added up on the executors, and only languages x slots counts come to the driver.

Cases: a null text, or one without a letter, is `und` with score 0; ties go to the language that sorts
first; repeated rows get equal answers; rows of null language are never learned from; with no labelled
row everything is `und`; very long texts
are read whole, as one row among others, and in one task's memory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.kernels import row_slices
from strandlake.llm.quality import held_out

MAX_TRAIN = 20_000
SLOT_BITS = 15
ROUNDS = 10
#: The n-grams of a word overlap, so each counts for less than a whole observation.
WEIGHT = 0.4
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
for _c in range(97, 123):
    _FOLD[_c] = _FOLD[_c - 32] = _c


def grams(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the three-byte runs that begin at each letter and at the space before each word, starts of the words in them, each word's text.

    A word is a run of ASCII letters and bytes from 0x80. Two spaces stand between texts, so no run reaches into the next one.
    """
    buf = _FOLD[np.frombuffer(b"  ".join([b"", *raws, b"   "]), np.uint8)]
    sizes = np.fromiter((len(r) + 2 for r in raws), np.int64, len(raws))
    ends = np.cumsum(sizes) + 2
    inside = buf != 32
    keep = np.flatnonzero(inside[:-3] | inside[1:-2])  # the letters, and the space before each word
    four = np.ndarray((len(buf) - 3,), "<u4", np.ascontiguousarray(buf).data, 0, (1,))[keep].astype(np.uint64)
    three = four & np.uint64(0xFFFFFF)
    slot = ((three * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    start = np.flatnonzero(~inside[keep])
    doc = np.searchsorted(ends, keep[start] + 1, side="right") if len(start) else start
    return slot, start, np.minimum(doc, max(len(raws) - 1, 0))


class Mixture:
    """Languages and their log distributions over slots (slots x languages)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts.astype(np.float64) + 0.5
        self.log_p = np.ascontiguousarray(np.log(p / p.sum(axis=1, keepdims=True)).T.astype(np.float32)) if len(languages) else np.zeros((1 << SLOT_BITS, 0), np.float32)

    def em(self, like: np.ndarray, doc: np.ndarray, share: np.ndarray, n: int, rounds: int) -> np.ndarray:
        """Proportions of each text, from word likelihoods (words x languages)."""
        first = np.searchsorted(doc, np.arange(n))
        has = np.bincount(doc, minlength=n) > 0
        for _ in range(rounds):
            r = share[doc] * like
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            share = share.copy()
            share[has] = np.add.reduceat(r, first[has], axis=0) if has.any() else share[has]
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
        return share

    def infer(self, raws: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its proportion, and the proportions of the chosen set for each text."""
        n, k = len(raws), len(self.languages)
        share = np.full((n, max(k, 1)), 1 / max(k, 1))
        has_letter = np.array([bool(_LETTER.search(r.decode("utf-8", "replace"))) for r in raws], bool)
        if not k:
            return ["und"] * n, np.zeros(n), share * 0
        slot, start, doc = grams(raws)
        if len(start):
            log_like = np.add.reduceat(self.log_p[slot], start, axis=0).astype(np.float64) * WEIGHT
            top = log_like.max(axis=1, keepdims=True)
            like = np.exp(log_like - top)
            first = np.searchsorted(doc, np.arange(n))
            count = np.bincount(doc, minlength=n)
            has = count > 0
            share = self.em(like, doc, share, n, ROUNDS)
            rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
            best, chosen = np.full(n, -np.inf), share
            for size in range(1, k + 1):
                part = np.where(rank < size, np.maximum(share, 1e-6), 0.0)
                part /= part.sum(axis=1, keepdims=True)
                if 1 < size < k:
                    part = self.em(like, doc, part, n, 3)
                fit = np.log(np.maximum((part[doc] * like).sum(axis=1), 1e-300))
                value = np.zeros(n)
                value[has] = np.add.reduceat(fit, first[has])
                value -= 0.5 * (size - 1) * np.log(np.maximum(count, 2))
                better = value > best
                best = np.where(better, value, best)
                chosen = np.where(better[:, None], part, chosen)
            share = chosen
        at = share.argmax(axis=1)
        score = np.where(has_letter, share[np.arange(n), at], 0.0)
        return [self.languages[i] if ok else "und" for i, ok in zip(at, has_letter)], np.clip(score, 0, 1), share


def learn(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Mixture:
    """Count n-grams by language over the sample."""
    named = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang")).where("doc_id is not null and lang is not null").where(~held_out("doc_id"))
    ids = named.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = df.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")).where("lang is not null")
    rows = rows.join(F.broadcast(ids), "doc_id").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for langs, raws in row_slices(batches):
            by: dict[str, list[bytes]] = {}
            for lang, r in zip(langs, raws):
                by.setdefault(lang, []).append(r)
            for lang, own in by.items():
                got = np.bincount(grams(own)[0], minlength=1 << SLOT_BITS)
                seen[lang] = seen[lang] + got if lang in seen else got
        for lang, c in seen.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "slot", "n"])

    got = rows.mapInArrow(run, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(names), 1 << SLOT_BITS))
    place = {x: i for i, x in enumerate(names)}
    rows_of = np.array([place[x] for x in got.column("lang").to_pylist()], int)
    counts[rows_of, got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return Mixture(names, counts)


def identify(df: DataFrame, model: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the proportions by language; one pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, raws in row_slices(batches, 2 << 20):
            lang, s, share = model.infer(raws)
            mixed = [[(l, float(p)) for l, p in zip(model.languages, row) if p > 0] for row in share]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lang, pa.string()), pa.array(s, pa.float64()), pa.array(mixed, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "proportions"])

    out = df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, proportions map<string,double>")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "proportions")
