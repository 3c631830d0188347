"""A quality classifier by ordinal cumulative-link regression on graded ratings.

Grades from the labels: 0 toxic, 1 of low quality, 2 good. A text's features are the distinct
hashes of its words and of its runs of punctuation (2^22 buckets) and a few shares of its
characters. All grades share one weight vector; ordered thresholds t0 < t1 part them:
P(grade > j) = sigmoid(score - t_j). So each text has an expected grade, P(>0) + P(>1), and
tail probabilities; texts of P(grade > 1) >= ``keep`` are selected.

The model is fitted on at most ``MOST`` labelled documents, those of the least hash of their
id: the bound is on training alone, and all documents are scored, whole.

Defined cases: a null or empty text is scored by the thresholds alone with no words (and is
kept or not by the same rule); labels that are null, without a document or doubled: a row with
a null rating or id isn't used, of several labels the worst counts; without any labels nothing
is learned, all grades are as likely as their prior of one half and all documents are kept;
repeated rows and equal texts (ties) are scored alike, and kept or not together; a very long text
is scored whole; no rows in give no rows out; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import PUNCT, U64, chunks, fold, mix, run_hashes, runs, text_buffer, words

BITS, MOST, KEEP, SHARES = 22, 12_000, 0.5, 5
#: The least chi-square, at a boundary of grades, of a bucket that gets a weight, and the least number of its rows.
TELLING, SEEN = 16.0, 4
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: distinct (text, bucket) pairs in order, and the texts' shares."""
    n = len(off) - 1
    h, _, _, per = words(data, off)
    marks, ends = runs(PUNCT[data], off)
    p = mix(run_hashes(data, PUNCT[data], marks, ends) ^ U64(77))
    pd = np.searchsorted(off, marks, "right") - 1
    doc = np.concatenate([np.repeat(np.arange(n), np.diff(per)), pd])
    key = np.sort(doc.astype(np.int64) << BITS | (np.concatenate([h, p]) >> U64(64 - BITS)).astype(np.int64))
    key = key[np.diff(key, prepend=-1) != 0]
    d = key >> BITS
    size, count = np.maximum(1, np.diff(off)), np.maximum(1, np.diff(per))
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off])
    shares = np.stack([total(_UPPER[data]) / size, total(_DIGIT[data]) / size, np.bincount(pd, minlength=n) / count, np.bincount(d, minlength=n) / count, np.log1p(size) / 10], 1)
    return d, (key & ((1 << BITS) - 1)).astype(np.int64), np.minimum(shares, 3)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights by bucket, weights of the shares, thresholds."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, shares: np.ndarray, thresholds: tuple[float, float]):
        self.buckets, self.weights, self.shares, self.thresholds = buckets, weights, shares, thresholds
        self.dense: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "dense": None}

    def score(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.dense is None:
            self.dense = np.zeros(1 << BITS, np.float32)
            self.dense[self.buckets] = self.weights
        out = [np.zeros(0)]
        for i, j in chunks(off):
            d, b, shares = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
            out.append(np.bincount(d, self.dense[b], minlength=j - i) + shares @ self.shares)
        return np.concatenate(out)

    def tails(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return sigmoid(score - self.thresholds[0]), sigmoid(score - self.thresholds[1])


def fit(doc: np.ndarray, bucket: np.ndarray, shares: np.ndarray, grade: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """By full-batch AdaGrad on the cumulative-link likelihood; the same rows give the same model.

    doc says which row a bucket belongs to; only buckets that tell the grades apart (TELLING, SEEN) get a weight.
    """
    kept, n_rows = np.unique(bucket, return_counts=True)
    place, n = np.searchsorted(kept, bucket), max(1, len(grade))
    above = np.stack([grade > 0, grade > 1], 1).astype(float)
    telling = np.zeros(len(kept), bool)
    for j in range(2):
        total = above[:, j].sum()
        seen = np.bincount(place, above[doc, j], minlength=len(kept))
        spread = n_rows * (n - n_rows) * total * (n - total)
        telling |= (seen * n - n_rows * total) ** 2 * n >= TELLING * np.maximum(spread, 1) if total else False
    kept = kept[telling & (n_rows >= SEEN)]
    w, v, t = np.zeros(len(kept)), np.zeros(shares.shape[1]), np.array([-1.0, 1.0])
    if len(grade) and len(set(grade.tolist())) > 1:
        place = np.searchsorted(kept, bucket)
        known = (place < len(kept)) & (kept[np.minimum(place, len(kept) - 1)] == bucket) if len(kept) else np.zeros(len(bucket), bool)
        doc, place = doc[known], place[known]
        # each boundary's two sides weigh alike
        share = np.clip(above.mean(0), 1 / n, 1 - 1 / n)
        weigh = above / share + (1 - above) / (1 - share)
        gw, gv, gt = np.full(len(w), 1e-8), np.full(len(v), 1e-8), np.full(2, 1e-8)
        for _ in range(rounds):
            score = np.bincount(doc, w[place], minlength=n) + shares @ v
            pull = weigh * (sigmoid(score[:, None] - t) - above) / n
            each = pull.sum(1)
            dw = np.bincount(place, each[doc], minlength=len(w)) + decay * w
            dv, dt = shares.T @ each + decay * v, -pull.sum(0)
            for x, d, g in ((w, dw, gw), (v, dv, gv), (t, dt, gt)):
                g += d * d
                x -= rate * d / np.sqrt(g)
            t.sort()
    else:
        t = np.array([0.0, 0.0])
    return Model(kept, w.astype(np.float32), v, (float(t[0]), float(t[1])))


def _grades(labels: DataFrame, label_id: str, quality: str, toxic: str) -> DataFrame:
    q, x = F.col(quality), F.col(toxic)
    grade = F.when(x == 1, 0).when(q == 0, 1).when((q == 1) & (x == 0), 2)
    return labels.select(F.col(label_id).cast("bigint").alias("i"), grade.alias("g")).where("i IS NOT NULL AND g IS NOT NULL").groupBy("i").agg(F.min("g").alias("g"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id", quality: str = "quality", toxic: str = "toxic", most: int = MOST) -> Model:
    """Fitted on at most ``most`` labelled documents; only their features, not their texts, come to the driver."""
    chosen = _grades(labels, label_id, quality, toxic).orderBy(F.xxhash64("i"), "i").limit(most)
    # the sample's size is bounded by most, so it may be broadcast at any size of the tables
    rows = docs.select(F.col(doc_id).cast("bigint").alias("i"), F.col(text).cast("string").alias("t")).join(F.broadcast(chosen), "i").select("i", "t", "g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = text_buffer(b.column(1))
            buckets, shares = [], []
            for i, j in chunks(off):
                d, k, s = features(data[off[i] : off[j]], off[i : j + 1] - off[i])
                buckets += np.split(k.astype(np.int32), np.searchsorted(d, np.arange(1, j - i)))
                shares += list(s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.tobytes() for x in buckets], pa.binary()), pa.array([x.tobytes() for x in shares], pa.binary())], ["i", "g", "b", "s"])

    got = rows.mapInArrow(run, "i bigint, g int, b binary, s binary").toArrow().sort_by("i")
    buckets = [np.frombuffer(x, np.int32) for x in got["b"].to_pylist()]
    shares = np.array([np.frombuffer(x) for x in got["s"].to_pylist()]).reshape(-1, SHARES)
    doc = np.repeat(np.arange(len(buckets)), [len(b) for b in buckets])
    return fit(doc, np.concatenate([np.zeros(0, np.int32), *buckets]).astype(np.int64), shares, np.array(got["g"].to_pylist(), int))


def _scored(docs: DataFrame, model: Model, doc_id: str, text: str, keep: float | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = shared.value
            low, high = own.tails(own.score(*text_buffer(b.column(1))))
            ok = pa.array(high >= (keep or 0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(low + high), pa.array(low), pa.array(high), pa.array(high >= KEEP if keep is None else high >= keep)], ["doc_id", "expected_grade", "p_above_0", "p_above_1", "selected"]).filter(ok)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, expected_grade double, p_above_0 double, p_above_1 double, selected boolean")


def grade(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents: doc_id, expected_grade (0 to 2), p_above_0, p_above_1, selected."""
    return _scored(docs, model, doc_id, text, None)


def selected(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: float = KEEP) -> DataFrame:
    """The selected documents' rows of ``grade``."""
    return _scored(docs, model, doc_id, text, keep)


def keep_good(docs: DataFrame, model: Model, text: str = "text", keep: float = KEEP) -> DataFrame:
    """docs without the rows that aren't selected; all columns come back."""
    k = [c.lower() for c in docs.columns].index(text.lower())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = shared.value
            yield b.filter(pa.array(own.tails(own.score(*text_buffer(b.column(k))))[1] >= keep))

    return docs.mapInArrow(run, docs.schema)
