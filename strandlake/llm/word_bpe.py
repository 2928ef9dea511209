"""BPE encoding and decoding with a contiguous rank array per word.

Each short word holds two plain arrays: its parts, and the ranks of its adjacent pairs. The smallest
rank is looked up by a scan, the boundary between that pair is deleted, and the two neighbouring
ranks are refreshed, until no pair has a rank. Words of one batch are handled together: the arrays
are the rows of a matrix, and each scan takes the minimum of every row. Words longer than
SHORT_WORD bytes use a heap over a linked list, as scanning them would be quadratic.

Cases: null text is empty (0 tokens, digests of the empty string); special strings inside a text are
single ids, and cut the text before it is normalised; repeated rows are encoded row by row; an empty
table gives an empty result; other columns are ignored. Very long texts need memory in proportion to
their own length only.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlake.llm.kernels import give_back

#: Fixed value: the vocabulary's split pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
SHORT_WORD = 48
#: Words whose ids a task remembers, at some 400 bytes a word.
CACHE_WORDS = 100_000
_NO_RANK = np.int64(1) << np.int64(40)
_CODECS: dict[str, "WordBpe"] = {}


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class WordBpe:
    """A tokenizer file's vocabulary, merges and special strings."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int64)
        self.final = np.array([self.vocab[c + self.suffix] for c in letters], np.int64)
        size = max(self.token) + 1
        self.shift = np.int64(1 << int(size).bit_length())
        pairs, made = [], []
        for a, b in model["merges"]:
            pairs.append(self.vocab[a] * int(self.shift) + self.vocab[b])
            made.append(self.vocab[a + b])
        rank = np.arange(len(pairs), dtype=np.int64)
        self.ranks = {p: (int(r), m) for p, r, m in zip(pairs, rank, made)}
        # open addressing over the pairs, for whole arrays of lookups
        bits = max(4, (4 * len(pairs)).bit_length())
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, _NO_RANK, np.int64)
        self.made = np.array(made, np.int64)
        todo = np.array(pairs, np.int64)
        slot, ids = self._slot(todo), rank
        while len(todo):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = todo[free]
            done = self.keys[slot] == todo
            self.values[slot[done]] = ids[done]
            todo, ids, slot = todo[~done], ids[~done], (slot[~done] + 1) & self.mask
        self.forget()

    def forget(self, but: set[str] | None = None) -> None:
        """Empty the caches of words, but for the special strings and the words `but`."""
        ids, tokens = {s: str(i) for s, i in self.special.items()}, {s: s for s in self.special}
        for w in but or ():
            if w in self.ids_of:
                ids[w], tokens[w] = self.ids_of[w], self.tokens_of[w]
        self.ids_of, self.tokens_of = ids, tokens

    def _slot(self, pair: np.ndarray) -> np.ndarray:
        h = pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(40)).astype(np.int64) & self.mask

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.shift + right
        slot = self._slot(pair)
        out = np.full(len(pair), _NO_RANK, np.int64)
        live = np.arange(len(pair))
        while len(live):
            key = self.keys[slot[live]]
            hit = key == pair[live]
            out[live[hit]] = self.values[slot[live[hit]]]
            live = live[~hit & (key != -1)]
            slot[live] = (slot[live] + 1) & self.mask
        return out

    def merge_short(self, words: list[bytes]) -> list[list[int]]:
        """Contiguous rank arrays, one row a word."""
        n, width = len(words), max(map(len, words))
        length = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        parts = self.inner[raw]
        rows = np.arange(n)
        parts[rows, length - 1] = self.final[raw[rows, length - 1]]
        ranks = np.full((n, width), _NO_RANK, np.int64)
        r, c = np.nonzero(np.arange(width - 1)[None, :] < (length - 1)[:, None]) if width > 1 else (rows[:0], rows[:0])
        ranks[r, c] = self._rank(parts[r, c], parts[r, c + 1])
        live = rows[length > 1]
        while len(live):
            w = int(length[live].max())
            window = ranks[live, :w]
            at = window.argmin(axis=1)
            best = window[np.arange(len(live)), at]
            going = best < _NO_RANK
            live, at, best = live[going], at[going], best[going]
            if not len(live):
                break
            # delete the boundary: everything to its right moves left by one
            col = np.arange(w)[None, :]
            take = np.minimum(col + (col > at[:, None]), w - 1)
            own = np.take_along_axis(parts[live, :w], take, 1)
            near = np.take_along_axis(ranks[live, :w], np.minimum(col + (col >= at[:, None]), w - 1), 1)
            near[:, w - 1] = _NO_RANK
            k = np.arange(len(live))
            own[k, at] = self.made[best]
            length[live] -= 1
            # refresh the ranks on both sides
            has = at + 1 < length[live]
            near[k, at] = _NO_RANK
            near[k[has], at[has]] = self._rank(own[k[has], at[has]], own[k[has], at[has] + 1])
            has = at > 0
            near[k[has], at[has] - 1] = self._rank(own[k[has], at[has] - 1], own[k[has], at[has]])
            parts[live, :w], ranks[live, :w] = own, near
            live = live[length[live] > 1]
        return [parts[i, : length[i]].tolist() for i in range(n)]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges by a heap over a linked list."""
        ids = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        n, shift = len(ids), int(self.shift)
        after, before, heap = [*range(1, n), -1], [*range(-1, n - 1)], []
        for i in range(n - 1):
            if found := self.ranks.get(ids[i] * shift + ids[i + 1]):
                heap.append((found[0], i, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j == -1 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.ranks[a * shift + b][1], -1, after[j]
            if after[i] != -1:
                before[after[i]] = i
                if found := self.ranks.get(ids[i] * shift + ids[after[i]]):
                    heapq.heappush(heap, (found[0], i, ids[i], ids[after[i]]))
            if before[i] != -1 and (found := self.ranks.get(ids[before[i]] * shift + ids[i])):
                heapq.heappush(heap, (found[0], before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x != -1]

    def learn(self, words: list[str]) -> None:
        """Put words in the caches."""
        short, raws = [], []
        for w in words:
            raw = w.encode("utf-8")
            if len(raw) > SHORT_WORD:
                self._keep(w, self.merge_long(raw))
            else:
                short.append(w)
                raws.append(raw)
        order = sorted(range(len(short)), key=lambda i: len(raws[i]))
        for at in range(0, len(order), 4096):
            part = order[at : at + 4096]
            for i, ids in zip(part, self.merge_short([raws[i] for i in part])):
                self._keep(short[i], ids)

    def _keep(self, word: str, ids: list[int]) -> None:
        self.ids_of[word] = " ".join(map(str, ids))
        self.tokens_of[word] = " ".join([self.token[i] for i in ids])

    def words(self, text: str) -> list[str]:
        """The pre-tokeniser's words of a text without special strings.

        Turning blanks into spaces, as the normaliser does, changes no word, since the pattern drops all blanks.
        """
        if not text.isascii():
            text = normalize("NFC", text)
            if "Σ" in text:  # the library lowers each character alone, without the final sigma
                text = text.replace("Σ", "σ")
        return self.split.findall(text.lower())

    def pieces(self, text: str) -> list[str]:
        """Words and special strings in order; no word can equal a special string, as the pattern cuts those."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.words(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.words(part))]

    def encode_many(self, texts: list[str]) -> list[tuple[str, int, str]]:
        """For each text: decimal ids joined by a space, their count, the decoded text."""
        split = [self.pieces(t) for t in texts]
        if len(self.ids_of) > CACHE_WORDS:
            self.forget(set().union(*split))  # the usual words are among these
        self.learn(list(set().union(*[set(words).difference(self.ids_of) for words in split])))
        out = []
        for words in split:
            ids = " ".join(map(self.ids_of.__getitem__, words))
            out.append((ids, ids.count(" ") + 1 if ids else 0, " ".join(map(self.tokens_of.__getitem__, words))))
        return out

    def encode(self, text: str) -> tuple[str, int, str]:
        return self.encode_many([text])[0]


def codec(path: str | None = None) -> WordBpe:
    import public_tokenizers

    path = path or public_tokenizers.path("word_bpe_49k.json")
    if path not in _CODECS:
        _CODECS[path] = WordBpe(path)
    return _CODECS[path]


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, outputs: str = "digests") -> DataFrame:
    """Encode and decode every text; one pass, no shuffle.

    outputs='digests': doc_id, n_tokens, ids_sha256, decoded_sha256. 'texts': doc_id, ids (array), decoded.
    """
    kind = df.schema[id_col].dataType.simpleString()
    if outputs == "digests":
        schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    else:
        schema = f"doc_id {kind}, ids array<int>, decoded string"
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                rows = bpe.encode_many([t or "" for t in texts])
                if outputs == "digests":
                    arrays = [pa.array([r[1] for r in rows], pa.int64()), pa.array([digest(r[0]) for r in rows], pa.string()), pa.array([digest(r[2]) for r in rows], pa.string())]
                    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                else:
                    arrays = [pa.array([[int(x) for x in r[0].split()] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.string())]
                    names = ["doc_id", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)
        bpe.forget()  # else a reused worker would hold the words for ever
        give_back()

    return df.select(id_col, text_col).mapInArrow(run, schema)
