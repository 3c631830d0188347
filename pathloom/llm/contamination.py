"""Benchmark decontamination with an FM-index per training shard.

The phrases are all windows of ``n`` words of the test items (an item of fewer words, but at
least ``shortest``, is one phrase). Each shard of the corpus is written as a text over the
phrases' vocabulary: a word outside it can take part in no occurrence, so it is a separator,
and runs of words shorter than the shortest phrase are left out; both leave every occurrence
as it is. Over that text stand a suffix array, its Burrows-Wheeler transform in a wavelet
matrix, and suffix positions sampled at every eighth word of a run. All phrases are searched
backward at once; rows found are walked to a sample. Overlapping or touching occurrences of a
document merge into one removal span, given in characters. Test items beyond ``ITEMS_AT_ONCE``
are searched in groups, all in the text as it came; occurrences are merged when all are found.

Defined cases: null and empty texts and items have no occurrences; rows are taken one by one,
so repeated rows each give their spans; a very long text is a shard of its own, searched whole;
phrases that tie or repeat count once at a place; a null id is carried as null, an item without
one is searched but not named; no rows in give no rows out; other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructField, StructType

from pathloom.llm.common import U64, char_offsets, chunks, runs, text_buffer, word_hashes, words

N, SHORTEST, SAMPLE = 8, 5, 8
#: Bytes of text in a shard.
SHARD = 24 << 20
#: Bytes of test items that are searched in one pass; more take more passes.
ITEMS_AT_ONCE = 16 << 20


class Wavelet:
    """A wavelet matrix: for each bit of the symbols, counts of ones before each place."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol stands before the place."""
        start = np.zeros(len(symbol), np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            a, s = ones[at], ones[start]
            at, start = np.where(one, zeros + a, at - a), np.where(one, zeros + s, start - s)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            a = ones[at]
            one = ones[at + 1] > a
            symbol = symbol * 2 + one
            at = np.where(one, zeros + a, at - a)
        return symbol


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; each separator (0) differs from all others, in the order of their places."""
    n = len(text)
    zero = text == 0
    m = int(zero.sum())
    rank = text + m
    rank[zero] = np.arange(m)
    width = 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank[order]
        fresh = np.ones(n, bool)
        fresh[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        rank = rank * (n + 1) + after
        order = np.argsort(rank, kind="stable")
        width *= 2


class FMIndex:
    """Of a text of symbols above 0 with separators 0, the last symbol a separator."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_array(text)
        bwt = text[self.order - 1]
        self.before = np.zeros(symbols + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols + 1), out=self.before[1:])
        self.wavelet = Wavelet(bwt, max(1, int(symbols).bit_length()))
        starts = np.flatnonzero(text == 0) + 1
        run = np.zeros(len(text), np.int64)
        run[starts[:-1]] = starts[:-1]
        run = np.maximum.accumulate(run)
        sampled = (np.arange(len(text)) - run) % SAMPLE == 0
        kept = sampled[self.order]
        self.sampled = kept
        self.sample = self.order[kept]
        self.nth = np.cumsum(kept) - 1
        del self.order

    def search(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of each phrase, so many words from its start on."""
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), len(self.sampled), np.int64)
        for back in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= back) & (low < high))
            c = words[starts[on] + lengths[on] - back].astype(np.int64)
            low[on] = self.before[c] + self.wavelet.rank(c, low[on])
            high[on] = self.before[c] + self.wavelet.rank(c, high[on])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places in the text; a run's first word is sampled, so no walk crosses a separator."""
        at, steps, left = np.zeros(len(rows), np.int64), 0, np.arange(len(rows))
        while len(left):
            done = self.sampled[rows]
            at[left[done]] = self.sample[self.nth[rows[done]]] + steps
            left, rows = left[~done], rows[~done]
            c = self.wavelet.access(rows)
            rows = self.before[c] + self.wavelet.rank(c, rows)
            steps += 1
        return at


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Of pairs of ranks: equal ones and only those get the same rank."""
    return np.unique(first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int32)


class Phrases:
    """The test items' phrases over their own vocabulary.

    Each is a place and a length in the items' words, kept as numbers (about 20 bytes a phrase);
    which places are of one phrase is told by doubling: a run's rank is that of its two halves' ranks.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], n: int = N, shortest: int = SHORTEST):
        each = [word_hashes(text or "") for _, text in items]
        self.vocabulary, self.words = np.unique(np.concatenate([np.zeros(0, U64), *each]), return_inverse=True)
        self.words = (self.words + 1).astype(np.int32)
        size = np.array([len(h) for h in each], np.int64)
        base = np.cumsum(size) - size
        starts, lengths, owners, kinds = ([np.zeros(0, np.int32)] for _ in range(4))
        for long in sorted({int(min(k, n)) for k in size if k >= shortest}):
            own = np.flatnonzero((size >= n) if long == n else (size == long))
            count = size[own] - long + 1
            at = np.repeat(base[own] - np.cumsum(count) + count, count) + np.arange(count.sum())
            rank, width = self.words, 1
            while width < long:
                step = min(width, long - width)
                rank, width = _ranks(rank[: len(rank) - step], rank[step:]), width + step
            starts.append(at.astype(np.int32))
            lengths.append(np.full(len(at), long, np.int32))
            owners.append(np.repeat(own, count).astype(np.int32))
            kinds.append(rank[at] + int(kinds[-1].max(initial=-1)) + 1)
        starts, lengths, owners, kinds = map(np.concatenate, (starts, lengths, owners, kinds))
        first, of = np.unique(kinds, return_index=True, return_inverse=True)[1:]
        self.starts, self.lengths = starts[first], lengths[first]
        self.least = int(self.lengths.min(initial=1 << 30)) if len(first) else 0
        del starts, lengths, kinds
        # pairs of a phrase and an item that has a name, by phrase
        named = np.array([i is not None for i, _ in items], bool)
        some = named[owners]
        pair = np.unique(of[some] * max(1, len(items)) + owners[some])
        self._ids = np.array([i or 0 for i, _ in items], np.int64)
        self._owners = (pair % max(1, len(items))).astype(np.int32)
        self._at = np.searchsorted(pair, np.arange(len(first) + 1) * max(1, len(items))).astype(np.int32)
        self.near = np.zeros(1 << 20, bool)
        self.near[self.vocabulary >> U64(44)] = True

    def items(self, phrase: int) -> list[int]:
        """The ids of the items that hold a phrase, those that have one."""
        return np.unique(self._ids[self._owners[self._at[phrase] : self._at[phrase + 1]]]).tolist()

    def symbols(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int64)
        if len(self.vocabulary):
            maybe = np.flatnonzero(self.near[h >> U64(44)])
            k = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
            out[maybe] = np.where(self.vocabulary[k] == h[maybe], k + 1, 0)
        return out


def shard_occurrences(texts: list[tuple[np.ndarray, np.ndarray]], phrases: Phrases) -> dict[int, list[tuple[int, int, list]]]:
    """Of a shard (batches of bytes and offsets), by row: (start, end, items) of each occurrence, in characters."""
    parts, doc, first, last, row = [np.zeros(1, np.int64)], [[-1]], [[0]], [[0]], 0
    for data, off in texts:
        for i, j in chunks(off):
            h, starts, ends, per = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
            s = phrases.symbols(h)
            begin, end = runs(s > 0, per)
            long = end - begin >= phrases.least
            begin, end = begin[long], end[long]
            if not len(begin):
                continue
            lens = end - begin
            out = np.zeros(int(lens.sum()) + len(lens), np.int64)
            place = np.arange(len(out)) - np.repeat(np.cumsum(lens + 1) - lens - 1, lens + 1)
            which = np.minimum(np.repeat(begin, lens + 1) + place, len(s) - 1)
            body = place < np.repeat(lens, lens + 1)
            out[body] = s[which[body]]
            owner = np.searchsorted(per, which, "right") - 1
            parts.append(out)
            doc.append(owner + row + i)
            shift = off[i] - off[i:j][owner]
            first.append(starts[which] + shift)
            last.append(ends[which] + shift)
        row += len(off) - 1
    text = np.concatenate(parts)
    if len(text) == 1:
        return {}
    doc, first, last = map(np.concatenate, (doc, first, last))
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.words, phrases.starts, phrases.lengths)
    count = high - low
    hit = np.flatnonzero(count > 0)
    if not len(hit):
        return {}
    which = np.repeat(hit, count[hit])
    rows = np.arange(len(which)) - np.repeat(np.cumsum(count[hit]) - count[hit], count[hit]) + np.repeat(low[hit], count[hit])
    at = index.locate(rows)
    stop = last[at + phrases.lengths[which] - 1]
    order = np.argsort(doc[at], kind="stable")
    owner = doc[at][order]
    cut = np.flatnonzero(np.diff(owner, prepend=-2))
    bases = np.cumsum([0] + [len(off) - 1 for _, off in texts])
    found = {}
    for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(owner)]):
        d, own = int(owner[i]), order[i:j]
        t = int(np.searchsorted(bases, d, "right")) - 1
        data, off = texts[t]
        k = d - bases[t]
        a, b = char_offsets(data[off[k] : off[k + 1]], np.stack([first[at[own]], stop[own]])).tolist()
        found[d] = [(*x, phrases.items(p)) for *x, p in zip(a, b, which[own].tolist())]
    return found


def merged(found: list[tuple[int, int, list]]) -> list[list]:
    """Of a text's occurrences: [start, end, occurrences, items] of the removal spans. What stands at one place is one phrase, whichever groups have it."""
    places: dict[tuple[int, int], set] = {}
    for a, b, items in found:
        places.setdefault((a, b), set()).update(items)
    out: list[list] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] += 1
            out[-1][3].update(places[a, b])
        else:
            out.append([a, b, 1, set(places[a, b])])
    return [[a, b, n, sorted(items)] for a, b, n, items in out]


def _shards(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(k).nbytes
        if size >= SHARD:
            yield held
            held, size = [], 0
    if held:
        yield held


def _passes(items: DataFrame, item_id: str, text: str) -> list[list[tuple]]:
    """The items in groups of a checked size, each group for one pass over the corpus."""
    items = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(text).cast("string").alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = total // ITEMS_AT_ONCE + 1
    return [[tuple(r) for r in items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n)]


SPANS = "doc_id bigint, span_start int, span_end int, n_phrases int, items array<bigint>"
FOUND = "__found"
_FOUND = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("items", pa.list_(pa.int64()))]))


def _searched(batches: Iterator[pa.RecordBatch], k: int, phrases: Phrases, more: bool) -> Iterator[tuple[pa.RecordBatch, dict[int, list]]]:
    """Batches and by row what was found in their column k; with more, the last column, of what other groups found, is taken off and added."""
    for held in _shards(batches, k):
        found, row = shard_occurrences([text_buffer(b.column(k)) for b in held], phrases) if len(phrases.lengths) else {}, 0
        for b in held:
            own = {d - row: s for d, s in found.items() if row <= d < row + b.num_rows}
            row += b.num_rows
            if more:
                for d, s in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    if s:
                        own.setdefault(d, []).extend((x["a"], x["b"], x["items"]) for x in s)
                b = b.select(range(b.num_columns - 1))
            yield b, own


def _all_but_last(docs: DataFrame, k: int, groups: list[list[tuple]], n: int, shortest: int) -> tuple[DataFrame, Broadcast, bool]:
    """docs, with what all groups but the last find in column k as a last column; the last group's phrases, broadcast (their size is bounded by ITEMS_AT_ONCE); and whether there are others."""
    out = docs
    for g, group in enumerate(groups[:-1]):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(group, n, shortest))

        def add(batches, shared=shared, more=g > 0):
            for b, own in _searched(batches, k, shared.value, more):
                found = [[{"a": a, "b": z, "items": list(x)} for a, z, x in own[d]] if d in own else None for d in range(b.num_rows)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, _FOUND)], [*b.schema.names, FOUND])

        out = out.mapInArrow(add, StructType([*docs.schema.fields, StructField(FOUND, from_arrow_type(_FOUND))]))
    return out, docs.sparkSession.sparkContext.broadcast(Phrases(groups[-1], n, shortest)), len(groups) > 1


def contamination_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, shortest: int = SHORTEST) -> DataFrame:
    """A row for each removal span: doc_id, span_start and span_end in characters, n_phrases found in it, the items they are of."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source, phrases, more = _all_but_last(source, 1, _passes(items, item_id, item_text), n, shortest)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in _searched(batches, 1, phrases.value, more):
            ids = b.column(0).to_pylist() if own else []
            found = [(ids[d], *x) for d in sorted(own) for x in merged(own[d])]
            cols = list(zip(*found)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "span_start", "span_end", "n_phrases", "items"])

    return source.mapInArrow(spans, SPANS)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", n_chars: str = "n_chars", item_id: str = "item_id", item_text: str = "text", n: int = N, shortest: int = SHORTEST) -> DataFrame:
    """docs with the removal spans cut out of the text and n_chars set anew; a text of which no word is left goes with its row.

    Rows without a span stay as they are, null and empty texts too. All columns come back.
    """
    k = [c.lower() for c in docs.columns].index(text.lower())
    m = next((i for i, c in enumerate(docs.columns) if c.lower() == n_chars.lower()), None)
    source, phrases, more = _all_but_last(docs, k, _passes(items, item_id, item_text), n, shortest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, own in _searched(batches, k, phrases.value, more):
            if own:
                texts, keep = b.column(k).to_pylist(), np.ones(b.num_rows, bool)
                size = b.column(m).to_pylist() if m is not None else None
                for d, found in own.items():
                    for a, z, *_ in reversed(merged(found)):
                        texts[d] = texts[d][:a] + texts[d][z:]
                    keep[d] = len(word_hashes(texts[d])) > 0
                    if size:
                        size[d] = len(texts[d])
                cols = list(b.columns)
                cols[k] = pa.array(texts, b.schema.field(k).type)
                if size:
                    cols[m] = pa.array(size, b.schema.field(m).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep))
            yield b

    return source.mapInArrow(cut, docs.schema)
