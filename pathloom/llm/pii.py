"""PII: information-theoretic sanitisation.

Protected entities are e-mail addresses, telephone numbers, IP addresses, card numbers (13 to 19
digits whose check digit is right) and social security numbers; they are replaced by their kind. What else reveals them is estimated
from the corpus: of N documents, an entity e is in d(e), a term t in d(t), and both are in
d(e, t) of them, wherever they stand (``WINDOW``, in words, spans any text). An entity in the
documents of t is as likely as P(e | t) = (d(e, t) + s d(e) / N) / (d(t) + s): ``PRIOR`` = s
documents of the corpus's own rate smooth small counts, so that entities and terms of one
document have an estimate too. The share of e's information that t discloses is

    log(P(e | t) N / d(e)) / log(N / d(e)),

the pointwise mutual information over e's information content. From ``GENERALISE`` on the term
is generalised to [TERM], from ``REMOVE`` on removed, in each document that holds e, wherever
it stands there. All counts are over the whole corpus.

Defined cases: a null or empty text has no entities; every row counts as a document, repeated
rows too; terms are decided by id, so rows of one id (or without one) share theirs; an entity
that all documents hold has no information to disclose; terms that tie at a threshold are
disclosed alike; very long texts are read whole; no rows give no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.common import checkpointed, chunks, text_buffer, words

WINDOW, PRIOR, GENERALISE, REMOVE = 1 << 30, 1.0, 0.6, 0.85
EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
NUMBER = re.compile(
    r"(?<![\d.])(?P<ip>(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)"
    r"|(?<!\d)(?P<card>\d{4}([ -]?)\d{4}\3\d{4}\3\d{4}|\d{13,19})(?!\d)"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?P<phone>(?<![\d+])\+?(?<!\d)(?:\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![.-]?\d))",
    re.ASCII,
)
_ANY = re.compile(r"[0-9@]")
BITS = 24


def checked(number: str) -> bool:
    """Whether the last digit is the check digit of a card number (Luhn)."""
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return (sum(digits[::2]) + sum(x * 2 - 9 * (x > 4) for x in digits[1::2])) % 10 == 0


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities, in order, none overlapping."""
    if not _ANY.search(text):
        return []
    found = [(m.start(), m.end(), "EMAIL") for m in EMAIL.finditer(text)] if "@" in text else []
    out, free = [], 0
    numbers = [(m.start(), m.end(), m.lastgroup.upper()) for m in NUMBER.finditer(text) if m.lastgroup != "card" or checked(m.group())]
    for a, b, kind in sorted(found + numbers, key=lambda s: (s[0], -s[1])):
        if a >= free:
            out.append((a, b, kind))
            free = b
    return out


def identity(text: str, kind: str) -> int:
    """The same for one address or number, however it is written."""
    plain = text.lower() if kind in ("EMAIL", "IP") else re.sub(r"\D", "", text)
    return xxhash.xxh64_intdigest(f"{kind}:{plain}") - (1 << 63)


def _bytes(text: str, spans: list) -> list[tuple[int, int]]:
    if text.isascii():
        return [(a, b) for a, b, _ in spans]
    return [(len(text[:a].encode()), len(text[:b].encode())) for a, b, _ in spans]


def _terms(raw: bytes, at: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signed hashes, starts and ends of the words outside the entities; and each entity's place among them."""
    h, starts, ends, _ = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    a, b = np.array(at, np.int64).reshape(-1, 2).T
    own = np.searchsorted(b, starts, "right")
    inside = (own < len(a)) & (a[np.minimum(own, max(0, len(a) - 1))] < ends) if len(a) else np.zeros(len(h), bool)
    h, starts, ends = h[~inside].view(np.int64), starts[~inside], ends[~inside]
    return h, starts, ends, np.searchsorted(starts, a)


MARKED = "doc_id bigint, text string, kinds array<string>, n_entities int, ents array<bigint>, near array<struct<es:array<bigint>,ts:array<bigint>>>"


def _mark(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t or not (spans := entities(t)):
                    continue
                h, _, _, place = _terms(t.encode(), _bytes(t, spans))
                ids = [identity(t[a:z], k) for a, z, k in spans]
                own = sorted(set(ids))
                if window >= len(h):
                    near = [{"es": own, "ts": np.unique(h)}]
                else:
                    places = [(e, [h[max(0, p - window) : p + window] for x, p in zip(ids, place.tolist()) if x == e]) for e in own]
                    near = [{"es": [e], "ts": np.unique(np.concatenate(x))} for e, x in places]
                rows.append((i, t, sorted({k for *_, k in spans}), len(spans), own, near))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.struct([("es", pa.list_(pa.int64())), ("ts", pa.list_(pa.int64()))]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "text", "kinds", "n_entities", "ents", "near"])

    return run


def _document_counts(docs: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """(t, dt): the number of documents of each of the terms.

    The terms' first bits make a bit map of 2 MB, whatever their number; words whose bit isn't
    set are dropped where they are read, the rest is counted and joined with the terms.
    """
    bits = terms.select(F.shiftrightunsigned("t", 64 - BITS).alias("b")).groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 31 as int))")).alias("m"))
    near = np.zeros(1 << BITS, bool)
    for w, m in bits.collect():
        near[(w << 5) + np.flatnonzero([(m >> k) & 1 for k in range(32)])] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.unpackbits(shared.value).view(bool)
        for b in batches:
            data, off = text_buffer(b.column(0))
            some = []
            for i, j in chunks(off):
                h, _, _, per = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                hit = np.flatnonzero(own[h >> np.uint64(64 - BITS)])
                pair = np.stack([np.searchsorted(per, hit, "right").astype(np.int64), h[hit].view(np.int64)], 1)
                pair = pair[np.lexsort(pair.T)]
                if len(pair):
                    some.append(pair[np.r_[True, (pair[1:] != pair[:-1]).any(1)], 1])
            t, n = np.unique(np.concatenate(some) if some else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["t", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("dt"))
    return counted.join(terms, "t", "left_semi")


def _actions(docs: DataFrame, text: str, marked: DataFrame, prior: float, generalise: float, remove: float) -> DataFrame:
    """(id, terms): of each document, the terms that disclose too much, and whether they go."""
    near = marked.select("doc_id", F.explode("near").alias("p")).select("doc_id", "p.es", "p.ts")
    de = marked.select(F.explode("ents").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("de"))
    dt = _document_counts(docs, text, near.select(F.explode("ts").alias("t")).distinct())
    n = F.lit(float(docs.count()))

    def told(both: Column) -> Column:
        return F.log((both + prior * F.col("de") / n) / (F.col("dt") + prior) * n / F.col("de")) / F.log(n / F.col("de"))

    pairs = near.select("doc_id", F.explode("es").alias("e"), "ts").join(de.where(F.col("de") < n), "e")
    pairs = pairs.select("doc_id", "e", "de", F.explode("ts").alias("t")).join(dt, "t")
    # no pair is in more documents than its entity or its term; those below the threshold even so aren't counted
    pairs = pairs.where(told(F.least("de", "dt")) >= generalise)
    flagged = pairs.withColumn("told", told(F.count(F.lit(1)).over(Window.partitionBy("e", "t")))).where(F.col("told") >= generalise)
    each = flagged.groupBy("doc_id", "t").agg(F.max(F.col("told") >= remove).alias("gone"))
    return each.groupBy(F.col("doc_id").alias("id")).agg(F.collect_list(F.struct("t", "gone")).alias("terms"))


def sanitise_text(text: str, terms: dict[int, bool]) -> tuple[str, int, int]:
    """The text without its entities and terms, and how many words were generalised and removed."""
    raw, spans = text.encode(), entities(text)
    at = _bytes(text, spans)
    cut = [(a, b, f"[{k}]".encode()) for (a, b), (*_, k) in zip(at, spans)]
    general = gone = 0
    if terms:
        h, starts, ends, _ = _terms(raw, at)
        for x, a, b in zip(h.tolist(), starts.tolist(), ends.tolist()):
            if x in terms:
                cut.append((a, b, b"" if terms[x] else b"[TERM]"))
                gone, general = gone + terms[x], general + (not terms[x])
    out, last = [], 0
    for a, b, new in sorted(cut):
        out += [raw[last:a], new]
        last = b
    return b"".join([*out, raw[last:]]).decode(), general, gone


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, prior: float = PRIOR, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """The documents that hold an entity: doc_id, kinds, n_entities, n_generalised, n_removed, sanitized. All others stay as they are and aren't listed."""
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = checkpointed(source.mapInArrow(_mark(window), MARKED))
    actions = _actions(source, "text", marked, prior, generalise, remove)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [sanitise_text(t, {x["t"]: x["gone"] for x in terms or []}) for t, terms in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            texts, general, gone = zip(*done) if done else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(general, pa.int32()), pa.array(gone, pa.int32()), pa.array(texts, pa.string())], ["doc_id", "kinds", "n_entities", "n_generalised", "n_removed", "sanitized"])

    rows = marked.join(actions, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "kinds", "n_entities", "text", "terms")
    return rows.mapInArrow(run, "doc_id bigint, kinds array<string>, n_entities int, n_generalised int, n_removed int, sanitized string")
