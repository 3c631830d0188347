"""Byte-level BPE encoding and decoding over a public vocabulary.

A text is split by the vocabulary's pattern. Within a short word, its part boundaries and the
ranks of adjacent parts' joins lie in two contiguous arrays: the least rank is scanned for, its
boundary deleted, and the neighbouring ranks are refreshed, until no join has a rank. A word
beyond ``SHORT`` bytes goes through a heap over linked parts, with the same result in less
than quadratic time. Words are encoded once while they stay in a worker's cache.

Defined cases: a null text has null tokens and a null count; an empty one has none and 0; rows
are taken one by one, so ties and repeated rows each give theirs; a very long text or word is
encoded whole; no rows in give no rows out; other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHORT, NONE = 128, 1 << 60
#: Bytes of words and their results that a worker remembers, by estimate.
REMEMBERED = 96 << 20
ROWS = 512

# the same pattern over the characters of the plain set, for which the standard library's engine is faster
_PLAIN = re.compile("[^\t-\r -~À-ɏ]")
_L, _S = "A-Za-zÀ-ÖØ-öø-ɏ", "\t-\r "
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")
# regex counts four control characters as white space that Unicode doesn't
_FULL = regex.compile(PATTERN.replace(r"\S", r"\P{White_Space}").replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}"))


def pretokens(text: str) -> list[str]:
    return (_FULL if _PLAIN.search(text) else _FAST).findall(text)


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Tokens of one pretoken."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > SHORT:
        return _encode_long(word, ranks)
    get = ranks.get
    bounds = list(range(len(word) + 1))
    near = [get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == NONE:
            break
        i = near.index(least)
        del bounds[i + 1], near[i]
        if i < len(near):
            near[i] = get(word[bounds[i] : bounds[i + 2]], NONE)
        if i:
            near[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def _encode_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(word)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, m, e = heapq.heappop(heap)
        if not alive[i] or end[i] != m or m >= n or not alive[m] or end[m] != e:
            continue
        alive[m], end[i] = False, e
        if e < n:
            prev[e] = i
            if (r := ranks.get(word[i : end[e]])) is not None:
                heapq.heappush(heap, (r, i, e, end[e]))
        if (p := prev[i]) >= 0 and (r := ranks.get(word[p:e])) is not None:
            heapq.heappush(heap, (r, p, i, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Remembered(dict):
    """A word's result by the word, worked out when first asked for.

    What is held takes no more than so many bytes: in two halves, of which the older one is
    dropped when the newer is full; a word of the older one that is asked for again joins the
    newer. A result of a sixteenth of the bytes isn't held at all.
    """

    def __init__(self, work: Callable, most: int = REMEMBERED):
        self.work, self.most, self.held, self.older = work, most, 0, {}

    def __missing__(self, word: str):
        out = self.older.pop(word, None)
        if out is None:
            out = self.work(word)
        size = 150 + (getsizeof(word) if type(word) is not int else 0) + (sum(map(_size, out)) if type(out) is tuple else _size(out))
        if size * 16 <= self.most:
            if self.held + size > self.most // 2:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self.held += size
            self[word] = out
        return out


def _size(value) -> int:
    return getsizeof(value) + (28 * len(value) if type(value) is list else 0)


class Codec:
    def __init__(self, raw: bytes):
        self.ranks = read_ranks(raw)
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.packed = Remembered(self._pack)
        self.lossy: set[str] = set()

    def _pack(self, word: str) -> bytes:
        raw = word.encode()
        ids = encode_word(raw, self.ranks)
        if self.decode(ids) != raw:
            self.lossy.add(word)
        return np.array(ids, np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        return self.checked(text)[0]

    def checked(self, text: str) -> tuple[np.ndarray, bool]:
        """The tokens, and whether decoding them gives the text: each word is decoded when it is encoded, and the words must make up the text."""
        words = pretokens(text)
        ids = np.frombuffer(b"".join(map(self.packed.__getitem__, words)), np.int32)
        return ids, "".join(words) == text and not (self.lossy and any(w in self.lossy for w in words))

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, tokens))


_codecs: dict[int, Codec] = {}


def codec(raw: bytes) -> Codec:
    """One codec of a vocabulary in each worker."""
    if (k := hash(raw)) not in _codecs:
        _codecs[k] = Codec(raw)
    return _codecs[k]


def shared_vocabulary(df: DataFrame, vocabulary: str):
    """The file's bytes (about 1 MB, whatever the corpus), read once by the driver."""
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


ENCODED = "doc_id bigint, n_tokens int, tokens array<int>, round_trip boolean"


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, tokens, and whether decoding them gives the text back."""
    shared = shared_vocabulary(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                parts, same, sizes = [], [], []
                for t in b.column(1).to_pylist():
                    ids, whole_again = own.checked(t or "")
                    parts.append(ids)
                    sizes.append(None if t is None else len(ids))
                    same.append(None if t is None else whole_again)
                offsets = np.cumsum([0, *(len(p) for p in parts)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)), mask=pa.array([s is None for s in sizes]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32()), tokens, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "tokens", "round_trip"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of token lists; null for a null list, or where a token isn't in the vocabulary or is null."""
    shared = shared_vocabulary(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for b in batches:
            out = [None if ids is None or any(i not in own.tokens for i in ids) else own.decode(ids).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(tokens).cast("array<int>").alias("tokens")).mapInArrow(run, "doc_id bigint, text string")
