"""Near-duplicates by MinHash, as an inverted join over signature coordinates.

A document's shingles are its runs of ``width`` words (all its words, if it has fewer); its
signature holds the least hash under each of ``coordinates`` functions. Two documents match
where at least ``least`` coordinates agree.

Documents of one signature are tied to the one of the least id, so that a thousand copies take
a thousand rows and not half a million. The other signatures are posted under each pair of
coordinate and value. Values that nothing else holds are dropped, and with them each document
that has fewer than ``least`` values left. Of m values, ordered by how many hold them, a
document's first m - least + 1 are its prefix: matching documents share a value in their
prefixes, so only the prefixes' lists are merged and the longest lists are skipped. A pair
meets first at its least coordinate that both prefixes have; there its collisions are counted
over all coordinates, and at the later ones it is passed over. A list that may be longer than
``LIST`` is compared in pairs of blocks, so that none has to fit in one task.

Defined cases: a null text, or one without a word, has no signature and matches nothing; so
does a null id; a very long text is signed whole, over all its shingles. Rows of one id are one
document, and never a pair; where they differ, each of their signatures counts. Equal texts tie at the least id. No rows in give no rows out; other
columns are not read, whatever their names. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import U64, checkpointed, chunks, fresh, mix, ngrams, text_buffer, words

COORDINATES, LEAST, WIDTH = 64, 39, 2
_A = (mix(np.arange(1001, 1001 + 256, dtype=U64)) & U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(5001, 5001 + 256, dtype=U64)) & U64(0xFFFFFFFF)).astype(np.uint32)
BLOCK = 4096
#: Members of a value's list that are held by one task at a time.
LIST = 20_000


def signatures(data: np.ndarray, off: np.ndarray, coordinates: int = COORDINATES, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Signatures (n x coordinates, uint32) and which texts have one."""
    n = len(off) - 1
    out = np.full((n, coordinates), 0xFFFFFFFF, np.uint32)
    has = np.zeros(n, bool)
    for i, j in chunks(off):
        h, _, _, per = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        count = np.diff(per)
        has[i:j] = count > 0
        owner = np.repeat(np.arange(i, j), count)
        grams = ngrams(h, width)
        inside = owner[: len(grams)] == owner[len(owner) - len(grams) :]
        g, d = grams[inside], owner[: len(grams)][inside]
        for k in np.flatnonzero((count > 0) & (count < width)):
            g = np.append(g, ngrams(h[per[k] : per[k + 1]], int(count[k])))
            d = np.append(d, k + i)
        order = np.argsort(d, kind="stable")
        g, d = g[order].astype(np.uint32), d[order]
        for a in range(0, len(g), BLOCK):
            dd = d[a : a + BLOCK]
            first = np.flatnonzero(np.diff(dd, prepend=-1))
            m = np.multiply.outer(_A[:coordinates], g[a : a + BLOCK])
            m += _B[:coordinates, None]
            # the order of scrambled values: a product alone keeps neighbours together
            m ^= m >> np.uint32(15)
            m *= np.uint32(0x2C1B3C6D)
            least = np.minimum.reduceat(m, first, axis=1).T
            out[dd[first]] = np.minimum(out[dd[first]], least)
    return out, has


def _signed(coordinates: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig, has = signatures(*text_buffer(b.column(1)), coordinates, width)
            has &= ~np.asarray(b.column(0).is_null())
            raw = [r.tobytes() for r in sig[has]]
            short = pa.array([xxhash.xxh3_128_digest(r) for r in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(has)), pa.array(raw, pa.binary()), short], ["id", "sig", "short"])

    return sign


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(b.num_rows, -1)
        key = (np.arange(sig.shape[1], dtype=np.int64) << 32) | sig.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), sig.shape[1])), pa.array(key.ravel())], ["key", "e"])


def _lists(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of rows (e, p, key, sig, mask) in the order of e and p: the pairs of each list that meet there first and collide often enough.

    p >> 1 tells the pair of blocks, the same one twice (all pairs count) or two (those of an even p with an odd one).
    """
    held: list[pa.RecordBatch] = []

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        e, p, keys, mask = (rows[c].to_numpy() for c in ("e", "p", "key", "mask"))
        bit = np.int64(1) << (e >> 32)
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint32).reshape(len(e), -1)
        new = np.ones(len(e), bool)
        new[1:] = (e[1:] != e[:-1]) | (p[1:] >> 1 != p[:-1] >> 1)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(e)))
        end, place = np.repeat(first + size, size), np.arange(len(e))
        two = (p >> 33) != ((p >> 1) & 0xFFFFFFFF)
        even = np.repeat(first + np.add.reduceat((p & 1) == 0, first, dtype=np.int64), size)
        begin = np.where(two, np.where(p & 1, end, even), place + 1)
        after, a = end - begin, 0
        total = np.cumsum(after)
        while a < len(e):  # about 100,000 comparisons at once
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + 100_000, "right")))
            left = np.repeat(np.arange(a, z), after[a:z])
            if len(left):
                right = begin[left] + np.arange(len(left)) - np.repeat(np.cumsum(after[a:z]) - after[a:z], after[a:z])
                parts = []
                for k in range(0, len(left), 50_000):
                    x, y = left[k : k + 50_000], right[k : k + 50_000]
                    equal = np.zeros((len(x), 64), bool)
                    equal[:, : sig.shape[1]] = sig[x] == sig[y]
                    both = np.packbits(equal, axis=1, bitorder="little").view(np.int64)[:, 0] & mask[x] & mask[y]
                    parts.append(np.where(both & -both == bit[x], equal.sum(1), 0))
                n = np.concatenate(parts)
                ok = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[left[ok]]), pa.array(keys[right[ok]]), pa.array(n[ok].astype(np.int32))], ["key_a", "key_b", "matches"])
            a = z

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        e, p = b.column(0).to_numpy(), b.column(1).to_numpy() >> 1
        if (e[-1], p[-1]) != (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py() >> 1):  # a list may go on in the next batch
            rows = pa.Table.from_batches(held)
            e, p = rows["e"].to_numpy(), rows["p"].to_numpy() >> 1
            cut = len(e) - int(np.argmin(np.append(((e == e[-1]) & (p == p[-1]))[::-1], False)))
            yield from pairs(rows.slice(0, cut))
            held = rows.slice(cut).to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _block_pairs(key: Column, parts: Column) -> Column:
    """Of a list in so many blocks: the pairs of blocks that the key's own is in, as first << 33 | second << 1 | whether its own is the second of two."""
    own = F.pmod(F.xxhash64(key), parts)

    def pair(k: Column) -> Column:
        return F.shiftleft(F.least(own, k), 33).bitwiseOR(F.shiftleft(F.greatest(own, k), 1)).bitwiseOR((k < own).cast("bigint"))

    return F.transform(F.sequence(F.lit(0).cast("bigint"), parts - 1), pair)


def _matched(docs: DataFrame, doc_id: str, text: str, coordinates: int, least: int, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (id, sig, short); signatures (key, short, id), each with its least id; pairs of different signatures (key_a, key_b, matches)."""
    if coordinates > 64:
        raise ValueError("there are at most 64 coordinates")
    source = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = checkpointed(source.mapInArrow(_signed(coordinates, width), "id bigint, sig binary, short binary"))
    # an id whose rows differ has several signatures: prefixes are those of signatures, which an id can't tell apart
    heads = checkpointed(signed.groupBy("sig", "short").agg(F.min("id").alias("id")).withColumn("key", F.monotonically_increasing_id()))
    posted = heads.select("key", "sig").mapInArrow(_elements, "key bigint, e bigint")
    # counts are combined before they are sent, and a hot value's postings may be split among tasks in the join
    counted = posted.join(posted.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "e")
    # the order by count and value as one number; counts beyond 2^25 are in the order of the values, which changes no pair
    shared = counted.select("key", F.least("n", F.lit((1 << 25) - 1)).alias("n"), "e").select("key", F.shiftleft("n", 38).bitwiseOR(F.col("e")).alias("o"))
    each = shared.groupBy("key").agg(F.array_sort(F.collect_list("o")).alias("l")).where(F.size("l") >= least)
    each = each.select("key", F.slice("l", F.lit(1), F.size("l") - (least - 1)).alias("l"))
    value = lambda o: o.bitwiseAND(F.lit((1 << 38) - 1))
    mask = F.aggregate("l", F.lit(0).cast("bigint"), lambda m, o: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(value(o), 32).cast("int"))))
    lists = each.join(heads, "key").select(F.explode("l").alias("o"), "key", "sig", mask.alias("mask"))
    lists = lists.select(value(F.col("o")).alias("e"), F.explode(_block_pairs(F.col("key"), F.ceil(F.shiftright("o", 38) / LIST))).alias("p"), "key", "sig", "mask")
    lists = lists.repartition(F.col("e"), F.shiftright("p", 1)).sortWithinPartitions("e", "p")
    return signed, heads.select("key", "short", "id"), lists.mapInArrow(lambda it: _lists(it, least), "key_a bigint, key_b bigint, matches int")


def near_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coordinates: int = COORDINATES, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """Pairs doc_a < doc_b with matches, the number of coordinates that agree.

    Each document whose signature another holds too is paired with the least id of that
    signature; of different signatures, the least ids stand for all. So two documents match
    exactly where their least ids are equal or paired.
    """
    signed, heads, near = _matched(docs, doc_id, text, coordinates, least, width)
    # equal signatures are told by 128 bits of hash, so that only these are sent about
    many = signed.groupBy("short").agg(F.min("id").alias("doc_a"), F.max("id").alias("last")).where("last > doc_a").select("short", "doc_a")
    same = signed.select("id", "short").join(many, "short").where("id != doc_a").select("doc_a", F.col("id").alias("doc_b"), F.lit(coordinates).alias("matches"))
    ids = near.join(heads.select(F.col("key").alias("key_a"), F.col("id").alias("a")), "key_a").join(heads.select(F.col("key").alias("key_b"), F.col("id").alias("b")), "key_b")
    found = ids.where("a != b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "matches")
    return same.unionAll(found).groupBy("doc_a", "doc_b").agg(F.max("matches").alias("matches"))


def components(pairs: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """Of each id in a pair: (id, head), the least id of all that are connected with it.

    Large and small stars in turn, each round checkpointed, until nothing changes.
    """
    edges = checkpointed(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = checkpointed(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("head")).unionAll(edges.select(F.col("v"), F.col("v")).distinct())
        mark = now


def linked(ids: DataFrame, members: DataFrame, near: DataFrame) -> DataFrame:
    """Of each of ids, its class and links: (id, class_id, n_links).

    ``members`` (id, key) has each id's keys; ``near`` (key_a, key_b) the keys that match, each
    pair once. Ids are linked where they share a key or hold keys that match. A class is all that
    is connected, by its least id; n_links counts the other ids that an id is linked with,
    whatever number of keys link them. An id without a key is a class of its own.
    """
    members, near = checkpointed(members.select("id", "key").distinct()), checkpointed(near.select("key_a", "key_b"))
    # ids of several keys are counted by themselves, once for all the ways that lead to them; the others by the sizes of their keys
    several = checkpointed(members.join(members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"), "id"))
    keys = members.join(several.select("id").distinct(), "id", "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    own = members.groupBy("key").agg(F.min("id").alias("low"))
    reach = near.select(F.col("key_a").alias("node"), F.col("key_b").alias("key")).unionAll(near.select("key_b", "key_a")).unionAll(own.select("key", "key"))

    def counted(reach: DataFrame) -> DataFrame:
        one = reach.join(keys, "key").select("node", "n", F.lit(None).cast("bigint").alias("id"))
        each = reach.join(several, "key").select("node", F.lit(0).cast("bigint").alias("n"), "id").distinct()
        return one.unionAll(each).groupBy("node").agg((F.sum("n") + F.count("id") - 1).alias("n_links"))

    joined = several.groupBy("id").agg(F.min("key").alias("first")).join(several, "id").select("first", "key").where("first != key")
    heads = components(near.unionAll(joined), "key_a", "key_b").select(F.col("id").alias("key"), "head")
    grouped = own.join(heads, "key", "left").select("key", "low", F.coalesce("head", "key").alias("head"))
    classes = grouped.join(grouped.groupBy("head").agg(F.min("low").alias("class_id")), "head").select("key", "class_id")
    of_keys = classes.join(counted(reach).withColumnRenamed("node", "key"), "key")
    of_several = counted(several.join(reach.withColumnRenamed("key", "to"), several["key"] == reach["node"]).select(several["id"].alias("node"), F.col("to").alias("key")).distinct())
    first = members.groupBy("id").agg(F.min("key").alias("key")).join(of_keys, "key").select("id", "class_id", "n_links")
    found = first.join(of_several.select(F.col("node").alias("id"), F.col("n_links").alias("all")), "id", "left").select("id", "class_id", F.coalesce("all", "n_links").alias("n_links"))
    return ids.select("id").where("id IS NOT NULL").distinct().join(found, "id", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", coordinates: int = COORDINATES, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """A row for each document: doc_id, class_id and n_links.

    n_links is the number of all other documents that match it, copies too; class_id is the least
    id of all that are connected by matches. Rows without an id have no row here.
    """
    signed, heads, near = _matched(docs, doc_id, text, coordinates, least, width)
    members = signed.select("id", "short").join(heads.select("short", "key"), "short")
    return linked(docs.select(F.col(doc_id).cast("bigint").alias("id")), members, near).withColumnRenamed("id", "doc_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without the documents that are connected with one of a smaller id; all columns come back.

    Rows of one id stay or go together; rows without an id or without a word stay.
    """
    name = fresh(docs, "gone")
    gone = components(near_pairs(docs, doc_id, text, **how)).where("id != head").select(F.col("id").alias(name))
    return docs.join(gone, F.col(doc_id).cast("bigint") == F.col(name), "left_anti")
