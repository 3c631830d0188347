"""Near-duplicate embeddings by product quantisation.

Vectors are scaled to length 1. Coarse centroids (about the square root of the number of
vectors) part them into inverted lists; a member's residual to its centroid is cut into
subspaces, each stored as the code of its nearest codeword. Centroids and codewords are fitted
by Lloyd rounds over all vectors.

Every vector is a query with the radius r of the threshold's angle. It probes its own list and
each list that can hold a partner: cell j lies beyond the plane between its centroid and any
other one k, and (d_j^2 - d_k^2) / (2 |c_k - c_j|) is the query's distance from it, which is
asked of the ``NEAREST`` centroids k; and the query is at most r farther from c_j than the
list's farthest member. Both hold for every pair, so the probes lose none (``reach=None``).
A number as ``reach`` asks for at most so many mean offsets r / sqrt(dimensions) beyond the
planes; that takes fewer probes, but loses pairs where vectors are of few intrinsic
dimensions. In a list, tables of the query's distances
to codewords are summed by the members' codes; a member is kept while that distance is at most
r plus the length of what its code leaves out, a bound by which the tables lose no pair. What
is kept is ranked again by exact cosine.

Lists of more than ``block`` members are searched in blocks, each by all queries of the list,
so no list has to fit in one task. As a pair is looked for from one side only, a query
probes the lists from its own on upward.

Defined cases: vectors that are null, empty, of zero length, of another number of dimensions
than most, or with a null, NaN or infinite value match nothing, nor does a null id; rows of
one id are never a pair of each other, and a pair found more than once is given once with the
greatest cosine; equal vectors (ties) all pair up; vectors of any length are read whole; no rows
give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import checkpointed
from pathloom.llm.near_dup import linked

LEAST, SUBSPACES, CODES, ROUNDS, BLOCK, MOST_LISTS = 0.95, 8, 256, 3, 20_000, 16_384
REACH, NEAREST = None, 16
QUERIES = 512


def matrix(col: pa.Array, dims: int) -> np.ndarray:
    """Vectors held as bytes, none of them null, without a copy."""
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros((0, dims), np.float32)
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.float32).reshape(-1, dims)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared, of rows to rows."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T), 0)


def assign(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(distances(x[k : k + 4096], c).argmin(1) for k in range(0, len(x), 4096))])


class Quantiser:
    def __init__(self, centroids: np.ndarray, words: np.ndarray | None = None):
        self.centroids, self.words = centroids, words

    def residuals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = assign(x, self.centroids)
        return own, x - self.centroids[own]

    def parts(self, r: np.ndarray) -> np.ndarray:
        """Residuals by subspace (n x subspaces x width), with zeros where the dimensions don't fill the last."""
        width = self.words.shape[2]
        out = np.zeros((len(r), len(self.words) * width), np.float32)
        out[:, : r.shape[1]] = r
        return out.reshape(len(r), len(self.words), width)

    def codes(self, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the length of what they leave out."""
        p = self.parts(r)
        code = np.stack([assign(p[:, m], self.words[m]) for m in range(len(self.words))], 1)
        left = p - self.words[np.arange(len(self.words)), code]
        return code.astype(np.uint8), np.sqrt((left * left).sum((1, 2)))


SUMS = "k bigint, n bigint, s binary"


def _sums(total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array([r.tobytes() for r in total[some]], pa.binary())], ["k", "n", "s"])


def _means(rows: DataFrame, dims: int, keys: int, width: int, label) -> dict[int, np.ndarray]:
    """Mean vectors by key, of the (keys, vectors) that label makes of a matrix; sums are combined in each task, and by key before the driver gets a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((keys, width)), np.zeros(keys, np.int64)
        for b in batches:
            k, v = label(matrix(b.column(1), dims))
            order = np.argsort(k, kind="stable")
            first = np.flatnonzero(np.diff(k[order], prepend=-1))
            if len(first):
                total[k[order][first]] += np.add.reduceat(v[order], first, axis=0, dtype=np.float64)
            count += np.bincount(k, minlength=keys)
        yield _sums(total, count)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((keys, width)), np.zeros(keys, np.int64)
        for b in batches:
            k = b.column(0).to_numpy()
            np.add.at(total, k, np.frombuffer(b"".join(b.column(2).to_pylist())).reshape(-1, width))
            np.add.at(count, k, b.column(1).to_numpy())
        yield _sums(total, count)

    sums = rows.mapInArrow(run, SUMS).repartition("k").mapInArrow(combine, SUMS)
    return {r[0]: np.frombuffer(r[2]) / r[1] for r in sums.collect()}


def train(rows: DataFrame, dims: int, n: int, subspaces: int = SUBSPACES, codes: int = CODES, rounds: int = ROUNDS, most_lists: int = MOST_LISTS) -> Quantiser:
    """Lloyd rounds over all vectors; starts are the vectors of the least hashes.

    ``most_lists`` bounds the model, which driver and workers hold; longer lists are searched in blocks, with the same result.
    """
    lists = int(min(most_lists, max(1, round(n**0.5))))
    first = np.stack([np.frombuffer(r[0], np.float32) for r in rows.orderBy(F.xxhash64("v"), "id").limit(max(lists, min(codes, n))).select("v").collect()])
    own = Quantiser(first[:lists].copy())
    for _ in range(rounds):
        for k, v in _means(rows, dims, lists, dims, lambda x: (assign(x, own.centroids), x)).items():
            own.centroids[k] = v
    width = -(-dims // subspaces)
    own.words = np.zeros((subspaces, min(codes, len(first)), width), np.float32)
    own.words[:] = own.parts(own.residuals(first[:codes])[1]).transpose(1, 0, 2)
    size = own.words.shape[1]

    def label(x: np.ndarray):
        p = own.parts(own.residuals(x)[1])
        k = np.stack([assign(p[:, m], own.words[m]) + m * size for m in range(subspaces)], 1)
        return k.ravel(), p.reshape(-1, width)

    for _ in range(rounds):
        for k, v in _means(rows, dims, subspaces * size, width, label).items():
            own.words[k // size, k % size] = v
    return own


def _postings(own: Quantiser, dims: int, radius: float, reach: float, blocks: dict[int, int], widest: dict[int, float]):
    """Of each vector: a member row in its list's block, and a query row for each block of each list it can reach."""
    far = np.array([widest.get(k, -np.inf) for k in range(len(own.centroids))])

    def probes(x: np.ndarray, home: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (query, list) pairs to search; distances between centroids are worked out for those at hand, so no table of lists by lists is held."""
        d = distances(x.astype(np.float64), c)
        probe = (np.arange(len(c)) >= home[:, None]) & (np.sqrt(d) <= far + radius + 1e-3)
        # lists are told apart in single precision, hence the allowance
        for k in (home, *np.argpartition(d, min(NEAREST, len(c)) - 1, 1)[:, :NEAREST].T):
            some, of = np.unique(k, return_inverse=True)
            probe &= d - d[np.arange(len(x)), k][:, None] <= (2 * reach * np.sqrt(distances(c[some], c)) + 1e-5)[of]
        q, at = np.nonzero(probe)
        return q, at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = own.centroids.astype(np.float64)
        for whole in batches:
            for b in (whole.slice(k, QUERIES) for k in range(0, whole.num_rows, QUERIES)):
                ids, x = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), dims)
                home, rest = own.residuals(x)
                code, err = own.codes(rest)
                q, at = probes(x, home, c)
                parts = np.array([blocks.get(k, 1) for k in at.tolist()], np.int64)
                block = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                q, at = np.repeat(q, parts), np.repeat(at, parts)
                mine = np.array([i % blocks.get(k, 1) for i, k in zip(ids.tolist(), home.tolist())], np.int64)
                n, m = len(ids), len(q)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([home, at])), pa.array(np.concatenate([mine, block])), pa.array(np.repeat([False, True], [n, m])), pa.array(np.concatenate([ids, ids[q]])),
                        pa.concat_arrays([b.column(1), b.column(1).take(pa.array(q))]), pa.array([*(r.tobytes() for r in code), *[None] * m], pa.binary()), pa.array(np.concatenate([err, np.full(m, 0)]).astype(np.float64)), pa.array(np.concatenate([home, home[q]])),
                    ],
                    ["l", "p", "query", "id", "v", "code", "err", "home"],
                )

    return run


def _search(own: Quantiser, dims: int, radius: float, least: float):
    """Of rows in the order of list, block and kind, members first: pairs."""

    squares = (own.words * own.words).sum(2)

    def against(members: list, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at = members[0]
        ids, x, code, err = members[1:]
        used = [np.unique(code[:, m], return_inverse=True) for m in range(code.shape[1])]
        limit = ((radius + err + 1e-3) ** 2).astype(np.float32)[:, None]
        for k in range(0, b.num_rows, QUERIES):
            s = b.slice(k, QUERIES)
            qi, qv, home = s.column(3).to_numpy(), matrix(s.column(4), dims), s.column(7).to_numpy()
            p = own.parts(qv - own.centroids[at])
            total = np.tile((p * p).sum((1, 2)), (len(ids), 1))
            for m in range(len(own.words)):
                # a codeword's row holds its distance from every query (without the query's own square), so that a member's look-up copies one row
                words, at_word = used[m]
                table = own.words[m, words] @ (-2 * p[:, m].T)
                table += squares[m, words][:, None]
                total += np.take(table, at_word, axis=0)
            o, q = np.nonzero(total <= limit)
            # in their own list both of a pair ask; the lesser id's question counts
            once = (qi[q] != ids[o]) & ((home[q] != at) | (qi[q] < ids[o]))
            q, o = q[once], o[once]
            near = (qv[q] * x[o]).sum(1) >= least - 1e-4
            q, o = q[near], o[near]
            cos = np.einsum("ij,ij->i", qv[q].astype(np.float64), x[o].astype(np.float64))
            ok = cos >= least
            a, z = qi[q][ok], ids[o][ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, z)), pa.array(np.maximum(a, z)), pa.array(cos[ok])], ["vec_a", "vec_b", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, members = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy() << 33 | b.column(1).to_numpy() << 1 | b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(key)]):
                s, here = b.slice(i, j - i), int(key[i]) >> 1
                if here != now:
                    now, members = here, None
                if not key[i] & 1:
                    part = [s.column(3).to_numpy(), matrix(s.column(4), dims), np.frombuffer(b"".join(s.column(5).to_pylist()), np.uint8).reshape(j - i, -1), s.column(6).to_numpy()]
                    members = [here >> 32, *(part if members is None else map(np.concatenate, zip(members[1:], part)))]
                elif members is not None:
                    yield from against(members, s)

    return run


def _unit(docs: DataFrame, vec_id: str, vector: str) -> tuple[DataFrame, int]:
    source = docs.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("e")).where("id IS NOT NULL AND size(e) > 0")
    dims = source.agg(F.mode(F.size("e"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, dims)
            size = np.sqrt((x * x).sum(1))
            ok = np.isfinite(size) & (size > 0)
            u = (x[ok] / size[ok][:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in u], pa.binary())], ["id", "v"])

    return source.where(F.size("e") == dims).mapInArrow(run, "id bigint, v binary"), dims


def embedding_pairs(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST, block: int = BLOCK, reach: float | None = REACH, most_lists: int = MOST_LISTS) -> DataFrame:
    """Pairs vec_a < vec_b with cosine >= least."""
    unit, dims = _unit(vectors, vec_id, vector)
    found = _found(checkpointed(unit), dims, least, block, reach, most_lists)
    return found.groupBy("vec_a", "vec_b").agg(F.max("cosine").alias("cosine"))


def embedding_classes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = LEAST, block: int = BLOCK, reach: float | None = REACH, most_lists: int = MOST_LISTS) -> DataFrame:
    """A row for each vector: vec_id, class_id and n_links.

    n_links is the number of all other ids with a cosine >= least; class_id is the least id of all
    that are connected by such pairs. Vectors of one direction (equal once they are of length 1)
    are searched once and match, whatever their number. A vector that matches nothing is a class
    of its own; rows without an id have no row here.
    """
    unit, dims = _unit(vectors, vec_id, vector)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(v) for v in b.column(1).to_pylist()], pa.binary())], ["id", "v", "short"])

    unit = checkpointed(unit.mapInArrow(name, "id bigint, v binary, short binary"))
    # equal vectors are told by 128 bits of hash
    heads = checkpointed(unit.select("v", "short").distinct().withColumn("id", F.monotonically_increasing_id()))
    near = _found(heads.select("id", "v"), dims, least, block, reach, most_lists).select(F.col("vec_a").alias("key_a"), F.col("vec_b").alias("key_b")).distinct()
    members = unit.select("id", "short").join(heads.select("short", F.col("id").alias("key")), "short")
    return linked(vectors.select(F.col(vec_id).cast("bigint").alias("id")), members, near).withColumnRenamed("id", "vec_id")


def _found(unit: DataFrame, dims: int, least: float, block: int, reach: float | None, most_lists: int) -> DataFrame:
    """Pairs of vectors (id, v) of length 1, kept already; some may come twice."""
    schema = "vec_a bigint, vec_b bigint, cosine double"
    n = unit.count() if dims else 0
    if not n:
        return unit.sparkSession.createDataFrame([], schema)
    own, radius = train(unit, dims, n, most_lists=most_lists), float(np.sqrt(max(0.0, 2 - 2 * least)))
    sizes = _sizes(unit, own, dims)
    blocks = {k: -(-v // block) for k, (v, _) in sizes.items() if v > block}
    posted = unit.mapInArrow(_postings(own, dims, radius, radius if reach is None else radius * min(1.0, reach / dims**0.5), blocks, {k: w for k, (_, w) in sizes.items()}), "l bigint, p bigint, query boolean, id bigint, v binary, code binary, err double, home bigint")
    return posted.repartition("l", "p").sortWithinPartitions("l", "p", "query").mapInArrow(_search(own, dims, radius, least), schema)


def _sizes(unit: DataFrame, own: Quantiser, dims: int) -> dict[int, tuple[int, float]]:
    """Members of each list, and their greatest distance from its centroid (a row for each list)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, rest = own.residuals(matrix(b.column(1), dims))
            k, n = np.unique(home, return_counts=True)
            w = np.zeros(len(own.centroids))
            np.maximum.at(w, home, np.sqrt((rest.astype(np.float64) ** 2).sum(1)))
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n), pa.array(w[k])], ["l", "n", "w"])

    return {r[0]: (r[1], r[2]) for r in unit.mapInArrow(run, "l bigint, n bigint, w double").groupBy("l").agg(F.sum("n"), F.max("w")).collect()}
