"""What the corpus operators share: vectorised words over Arrow text buffers, checkpoints, table paths.

A *word* is a maximal run of ASCII letters, ASCII digits, underscores and non-ASCII
characters; case is folded for ASCII and Latin-1 letters. A null text is an empty one.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
#: Bytes of text that are tokenised at once; a longer text is taken alone and whole.
CHUNK = 1 << 20

WORD, PUNCT = np.zeros(256, bool), np.zeros(256, bool)
for _b in range(256):
    WORD[_b] = _b >= 128 or chr(_b).isalnum() or _b == 95
    PUNCT[_b] = 33 <= _b < 127 and not WORD[_b]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets, without copying where there are no nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about so many bytes together, at least one document each."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, of the same length in bytes."""
    out = _FOLD[data]
    if len(out) > 1:
        second = out[1:]
        up = (data[:-1] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
        second[up] += 32
    return out


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of members, none across documents."""
    if not len(member):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(len(member) + 1, bool)
    first[off] = True
    before = np.empty(len(member), bool)
    before[0], before[1:] = False, member[:-1]
    starts = np.flatnonzero(member & (~before | first[:-1]))
    after = np.empty(len(member), bool)
    after[-1], after[:-1] = False, member[1:]
    return starts, np.flatnonzero(member & (~after | first[1:])) + 1


def run_hashes(data: np.ndarray, member: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run's bytes: a polynomial in an odd base, then mixed."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    power = np.full(int(lens.max()), BASE, U64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    body = data[member].astype(U64)
    body += U64(1)
    body *= power[np.arange(len(body)) - np.repeat(first, lens)]
    return mix(np.add.reduceat(body, first) ^ lens.astype(U64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: the words' hashes, first and end bytes, and n + 1 offsets of the documents' words."""
    low = fold(data)
    member = WORD[low]
    starts, ends = runs(member, off)
    return run_hashes(low, member, starts, ends), starts, ends, np.searchsorted(starts, off)


def word_hashes(text: str) -> np.ndarray:
    """The words' hashes of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    return words(raw, np.array([0, len(raw)]))[0]


_ODD = mix(np.arange(1, 65, dtype=U64)) | U64(1)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n words in a row, wherever documents end."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out += h[k : len(h) - n + 1 + k] * _ODD[k]
    return mix(out)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the folder that the cluster shares.

    The folder is the session's spark.checkpoint.dir. A local session that has none gets a
    temporary one, as in tests; a cluster without one is refused, as no folder of one machine
    outlives an executor.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def fresh(docs: DataFrame, name: str) -> str:
    """A name like the given one that no column of docs has, whatever their case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def char_offsets(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Byte offsets within one text as offsets in characters."""
    count = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=count[1:])
    return count[at]
