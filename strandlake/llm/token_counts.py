"""Token counts by overlap resynchronisation.

A huge text is cut into overlapping chunks. Each chunk is encoded alone, with the offset of every
token. Two neighbours are spliced at a token boundary that both encodings have and that is proven
stable: a position before white space that follows other text. The pre-tokeniser's pattern has no
alternative that runs from a non-blank character into a blank one, and it looks ahead by one
character only, so every encoding, wherever it began, breaks at such a position, and what follows it
depends on the later text alone. If the overlap holds no such boundary, it is doubled, up to the
whole rest of the text.

Chunks are encoded by another library than the contract's, with the same vocabulary from a file of its own format (ranks of byte strings);
the tests hold the counts against the contract's library and file.

Cases: null text counts as empty (0 bytes, 0 tokens); special strings inside a text count as one
token each, as the tokenizer's default has it, and cut the text; ties and repeated rows are counted
row by row; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_CHARS = 1 << 16
OVERLAP_CHARS = 1 << 9
TOKEN_LIMIT = 512
#: Fixed value: the special token of the 50k byte-level vocabulary and its id.
SPECIAL = {"<|endoftext|>": 50256}
_ENCODERS: dict[str, object] = {}


class ByteBpe:
    """The 50k byte-level vocabulary, as ids with byte offsets."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.width[i] = len(token)

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def ends(self, ids: list[int]) -> np.ndarray:
        """Byte offset of each token's end."""
        return np.cumsum(self.width[np.asarray(ids, np.int64)]) if ids else np.empty(0, np.int64)


def encoder(ranks_path: str | None = None) -> ByteBpe:
    import public_tokenizers

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteBpe(path, public_tokenizers.PATTERN)
    return _ENCODERS[path]


def stable_boundaries(text: str, start: int, stop: int) -> list[int]:
    """Positions p in (start, stop) with a blank at p and none before it."""
    return [p for p in range(start + 1, stop) if text[p].isspace() and not text[p - 1].isspace() and text[p] not in "\x1c\x1d\x1e\x1f" and text[p - 1] not in "\x1c\x1d\x1e\x1f"]


def encode_chunked(text: str, bpe: ByteBpe, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """The ids of the whole text, from overlapping chunks."""
    n, begin, out = len(text), 0, []
    while True:
        stop = min(n, begin + chunk)
        if stop >= n:
            return out + bpe.ids(text[begin:])
        left = bpe.ids(text[begin:stop])
        width = min(overlap, stop - begin - 1)
        while True:
            lo = max(begin, stop - width)
            # the last two characters are left out: a match that ends there may need what follows
            marks = stable_boundaries(text, lo, stop - 2)
            if marks:
                right = bpe.ids(text[lo : min(n, stop + width)])
                left_ends = bpe.ends(left)
                right_ends = set((bpe.ends(right) + len(text[begin:lo].encode("utf-8"))).tolist())
                cut = None
                for p in reversed(marks):
                    at = len(text[begin:p].encode("utf-8"))
                    i = int(np.searchsorted(left_ends, at))
                    if i < len(left_ends) and left_ends[i] == at and at in right_ends:
                        cut = p, i + 1
                        break
                if cut:
                    out += left[: cut[1]]
                    begin = cut[0]
                    break
            if lo == begin:  # no common boundary in the whole chunk: widen the chunk itself
                chunk *= 2
                break
            width = min(2 * width, stop - begin)


def split_special(text: str) -> list[str]:
    """The text's parts between special strings."""
    parts = [text]
    for s in SPECIAL:
        parts = [q for p in parts for q in p.split(s)]
    return parts


def count_text(text: str | None, bpe: ByteBpe, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    if not text:
        return 0
    parts = split_special(text) if any(s in text for s in SPECIAL) else [text]
    total = len(parts) - 1
    for p in parts:
        total += len(encode_chunked(p, bpe, chunk, overlap)) if len(p) > chunk else len(bpe.ids(p))
    return total


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
    limit: int = TOKEN_LIMIT, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row; one pass, no shuffle."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path)
        for batch in batches:
            sizes, counts = [], []
            for at in range(0, batch.num_rows, 256):
                for t in batch.column(1).slice(at, 256).to_pylist():
                    sizes.append(len(t.encode("utf-8")) if t else 0)
                    counts.append(count_text(t, bpe, chunk, overlap))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
