"""Clashing names, blocks, bounded memory, and independent versions of what the operators compute."""

import random
from collections import Counter

import numpy as np
import pytest
from test_operators import SF, WORD, expected_pairs, lower, ranks, read

from pathloom.llm import bpe, contamination, embeddings, licenses, near_dup, pii, quality, queries, secrets, urls
from pathloom.llm.common import U64, fresh, mix, word_hashes


def test_clashing_names(spark, odd):
    names = ["gone", "GONE_", "found", "live", "Live_id", "k", "segs", "__gone", "__live", "__live_id", "__found"]
    df = odd.select("doc_id", "text", "lang", "source", "n_chars").selectExpr("*", *(f"'clash' as {n}" for n in names))
    assert fresh(df, "gone") == "gone__" and fresh(df, "other") == "other"
    for f in (near_dup.drop_near_duplicates, secrets.mask_live_secrets, lambda d: contamination.decontaminate(d, read(spark, "benchmark"))):
        got = f(df)
        assert got.columns == df.columns and got.where("gone = 'clash'").count() == got.count() > 0


# 2


def plain_signature(text):
    """By whole numbers, a shingle and a coordinate at a time."""
    h = [int(x) for x in word_hashes(text)]
    odd = [int(x) for x in mix(np.arange(1, 65, dtype=U64)) | U64(1)]
    width = min(2, len(h))
    grams = [int(mix(np.array([sum(x * o for x, o in zip(h[k : k + width], odd)) % 2**64], U64))[0]) % 2**32 for k in range(len(h) - width + 1)]

    def value(k, g):
        v = (int(near_dup._A[k]) * g + int(near_dup._B[k])) % 2**32
        return (v ^ v >> 15) * 0x2C1B3C6D % 2**32

    return [min(value(k, g) for g in grams) for k in range(64)]


def test_all_pairs_by_hand(spark):
    random.seed(21)
    base = [[random.choice("abcdefghij") + str(random.randrange(40)) for _ in range(60)] for _ in range(12)]
    docs = {}
    for i in range(60):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 4, 8])):
            w[random.randrange(len(w))] = "new" + str(random.randrange(99))
        docs[i] = " ".join(w)
    sig = {i: plain_signature(t) for i, t in docs.items()}
    want = {(i, j): n for i in docs for j in docs if i < j and (n := sum(a == b for a, b in zip(sig[i], sig[j]))) >= near_dup.LEAST}
    pairs = near_dup.near_pairs(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    # each pair of heads holds for all their members
    members = {i: {i} for i in docs}
    for r in pairs:
        if r.matches == 64:
            members[r.doc_a].add(r.doc_b)
    got = {}
    for r in pairs:
        for x in members[r.doc_a]:
            for y in members[r.doc_b]:
                if x != y:
                    got[min(x, y), max(x, y)] = max(r.matches, got.get((min(x, y), max(x, y)), 0))
    for own in members.values():
        got |= {(x, y): 64 for x in own for y in own if x < y}
    assert got == want and len({n for n in want.values()}) > 3


def near_rows(n, bases, rows_of_one):
    random.seed(1)
    base = [[random.choice("abcdefghij") + str(random.randrange(40)) for _ in range(60)] for _ in range(bases)]
    rows = []
    for i in [i for i in range(n) for _ in range(random.choice(rows_of_one))]:
        w = list(random.choice(base))
        for _ in range(random.choice([0, 1, 2, 4, 8])):
            w[random.randrange(len(w))] = "new" + str(random.randrange(99))
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("least", [near_dup.LEAST, 20])
def test_pairs_of_ids_whose_rows_differ(spark, least):
    df = spark.createDataFrame(near_rows(150, 12, [1, 1, 2, 3]), "doc_id long, text string")
    got = {(r.doc_a, r.doc_b): r.matches for r in near_dup.near_pairs(df, least=least).collect()}
    assert got == expected_pairs(spark, df, least) and len(got) > 500


def classes(ids, links):
    """Class and number of links of each id, by plain search."""
    out = {}
    for i in sorted(ids):
        held, new = {i}, [i]
        while new and i not in out:
            new = [y for x in new for y in links[x] if y not in held and not held.add(y)]
        for x in held if i not in out else ():
            out[x] = (i, len(links[x]))
    return out


@pytest.mark.parametrize("bases, rows_of_one", [(60, [1]), (150, [1, 1, 1, 1, 1, 2, 3])])
def test_classes_by_hand(spark, bases, rows_of_one):
    rows = near_rows(200, bases, rows_of_one) + [(300, None), (301, "..."), (302, "..."), (None, "some words"), (303, "some words")]
    sig = [(i, plain_signature(t)) for i, t in rows if i is not None and t and t != "..."]
    links = {i: set() for i, _ in rows if i is not None}
    for k, (i, s) in enumerate(sig):
        for j, t in sig[:k]:
            if i != j and sum(a == b for a, b in zip(s, t)) >= near_dup.LEAST:
                links[i].add(j)
                links[j].add(i)
    got = near_dup.near_classes(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as key", "3 as class_id").repartition(3)).collect()
    want = classes(links, links)
    assert len(got) == len(want) and {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    assert max(n for _, n in want.values()) > 3 and len({c for c, _ in want.values()}) > 10


def test_a_row_for_each_document(spark):
    df = read(spark, "documents")
    got = {r.doc_id: (r.class_id, r.n_links) for r in queries.op2_minhash_pairs(spark, SF).collect()}
    members, links = {}, {r.doc_id: set() for r in df.collect()}
    pairs = near_dup.near_pairs(df).collect()
    for r in pairs:
        if r.matches == 64:
            members.setdefault(r.doc_a, {r.doc_a}).add(r.doc_b)
    for own in members.values():
        for x in own:
            links[x] |= own - {x}
    for r in pairs:
        for x in members.get(r.doc_a, {r.doc_a}):
            for y in members.get(r.doc_b, {r.doc_b}) if r.matches < 64 else ():
                links[x].add(y)
                links[y].add(x)
    assert got == classes(links, links) and sum(n for _, n in got.values()) > len(pairs)


@pytest.mark.parametrize("most", [3, 40])
def test_lists_in_blocks(spark, monkeypatch, most):
    df = read(spark, "documents")
    one = sorted(map(tuple, near_dup.near_pairs(df, least=20).collect()))
    monkeypatch.setattr(near_dup, "LIST", most)
    assert sorted(map(tuple, near_dup.near_pairs(df, least=20).collect())) == one


# 3


def test_fewest_edits():
    random.seed(8)
    for _ in range(200):
        spans = [(random.choice("abc"), a := random.randrange(60), a + random.randrange(1, 20), random.randrange(4)) for _ in range(random.randrange(12))]
        assert licenses.fewest(spans) == [x for x in spans if not any(y[3] < x[3] and y[0] != x[0] and y[1] < x[2] and x[1] < y[2] for y in spans)]


# 4


def test_fit_reaches_the_optimum():
    rng = np.random.default_rng(3)
    n, buckets = 400, 6
    on = rng.random((n, buckets)) < 0.4
    grade = np.clip(np.round(on @ np.array([1.2, -1.0, 0.6, 0, 0, -0.4]) + rng.normal(size=n) * 0.7 + 1), 0, 2).astype(int)
    doc, bucket = np.nonzero(on)
    shares = rng.random((n, 2))
    model = quality.fit(doc, bucket, shares, grade, rounds=20_000, decay=1e-4)
    t = np.array(model.thresholds)
    assert t[0] < t[1] and len(model.buckets)
    x = np.concatenate([on[:, model.buckets].astype(float), shares], 1)
    above = np.stack([grade > 0, grade > 1], 1).astype(float)
    weigh = above / above.mean(0) + (1 - above) / (1 - above.mean(0))

    def loss(p):
        """The objective, written down again."""
        z = (x @ p[:-2])[:, None] - p[-2:]
        return (weigh * np.log1p(np.exp(-np.where(above > 0, z, -z)))).sum() / n + 0.5e-4 * (p[:-2] ** 2).sum()

    best = np.concatenate([model.weights.astype(float), model.shares, t])
    for k in range(len(best)):
        step = np.eye(len(best))[k] * 1e-4
        assert abs(loss(best + step) - loss(best - step)) / 2e-4 < 2e-3
    assert all(loss(best) <= loss(best + rng.normal(size=len(best)) * 0.05) for _ in range(200))


def test_grades_of_labels(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 0), (3, 1, 1), (4, 0, None), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r.i, r.g) for r in quality._grades(labels, "doc_id", "quality", "toxic").collect()} == {(1, 1), (2, 2), (3, 0), (4, 1)}


# 5


def test_odd_pages(spark):
    long = "http://h.example/" + "/".join(f"s{k % 7}" for k in range(3000)) + "?" + "q" * 100_000
    rows = [(1, long, "x"), (1, long, "x"), (None, "http://h.example/a/1", "x"), (3, None, "x"), (4, "", "x"), (5, "ftp://A.example", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").selectExpr("*", *(f"'clash' as {n}" for n in ("k", "segs", "node", "bad", "n", "template", "name", "kept")))
    labels = read(spark, "labels").selectExpr("*", "'clash' as bad", "'clash' as k")
    got = urls.url_templates(df, labels).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows) and {r.host for r in got} == {"h.example", "", "a.example"}
    assert urls.url_templates(df.where("false"), labels).count() == 0 and urls.url_templates(df, labels.where("false")).where("rejected").count() == 0


# 6, 7


def test_memory_of_words_is_bounded():
    held = bpe.Remembered(lambda w: w.encode(), 1 << 16)
    for k in range(5000):
        assert held[f"{k:0300}"] == f"{k:0300}".encode() and held.held <= 1 << 16
    assert held["x" * 100_000] == b"x" * 100_000 and "x" * 100_000 not in held and 0 < len(held) < 120
    codec = bpe.Codec(ranks())
    text = "".join(random.choice("ab /+=") for _ in range(20_000))
    assert codec.decode(codec.encode(text).tolist()) == text.encode() and codec.packed.held <= bpe.REMEMBERED


# 8


def test_phrases_against_sets():
    random.seed(5)
    items = [(i if i % 7 else None, " ".join(random.choice("abcd") for _ in range(random.randrange(14)))) for i in range(80)]
    want = {}
    for i, t in items:
        w = [lower(m) for m in WORD.findall(t)]
        if len(w) >= 5:
            for k in range(max(1, len(w) - 7)):
                want.setdefault(tuple(w[k : k + 8]), set()).update([i] if i is not None else [])
    own = contamination.Phrases(items)
    name = {int(h): w for w in "abcd" for h in word_hashes(w)}
    got = {tuple(name[int(own.vocabulary[x - 1])] for x in own.words[s : s + n]): set(own.items(k)) for k, (s, n) in enumerate(zip(own.starts, own.lengths))}
    assert got == want and len(own.starts) == len(want) and own.least == min(map(len, want))
    assert len(contamination.Phrases([]).starts) == 0 == len(contamination.Phrases([(1, "a b"), (2, None)]).starts)


# 9


def test_check_digits():
    assert [k for *_, k in pii.entities("4111 1111 1111 1111, 4111-1111-1111-1112, 1700000000000, 378282246310005")] == ["CARD", "CARD"]


# 10


def test_odd_vectors(spark):
    rows = [(i % 5 if i != 3 else None, [float(i % 3), 1.0, 2.0], "x") for i in range(12)] + [(90, [1e30, 1e30, 1e30], "x"), (91, [None, 1.0, 2.0], "x"), (92, [1.0] * 5000, "x"), (93, None, "x"), (94, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string").selectExpr("*", *(f"'clash' as {n}" for n in ("id", "e", "l", "p", "code", "home", "query")))
    got = {(r.vec_a, r.vec_b) for r in embeddings.embedding_pairs(df, least=0.999).collect()}
    vectors = [(i, np.array(e) / np.linalg.norm(e)) for i, e, _ in rows if i is not None and e and len(e) == 3 and None not in e]
    assert got == {(i, j) for i, x in vectors for j, y in vectors if i < j and x @ y >= 0.999} and got


def test_classes_of_vectors(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(300, 24))
    x = np.concatenate([base, *(base[:80] + 0.07 * rng.normal(size=(80, 24)) for _ in range(4)), np.repeat(base[:2], 40, axis=0)]).astype(np.float32)
    rows = [*enumerate(x.tolist()), (3, x[250].tolist()), (3, x[5].tolist()), (900, None), (901, [0.0] * 24), (902, [1.0]), (None, x[0].tolist()), (903, [float("nan")] * 24)]
    held = [(i, np.array(v, np.float32)) for i, v in rows if i is not None and v and len(v) == 24 and np.linalg.norm(v) > 0]
    unit = np.array([v / np.linalg.norm(v) for _, v in held], float)
    links = {i: set() for i, _ in rows if i is not None}
    for a, b in zip(*np.nonzero(unit @ unit.T >= 0.95)):
        if held[a][0] != held[b][0]:
            links[held[a][0]].add(held[b][0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as key", "'x' as short", "3 as class_id").repartition(3)
    want = classes(links, links)
    for how in ({}, {"block": 7}):
        got = embeddings.embedding_classes(df, **how).collect()
        assert len(got) == len(want) and {r.vec_id: (r.class_id, r.n_links) for r in got} == want
    assert max(n for _, n in want.values()) > 40 and len({c for c, _ in want.values()}) > 200
    for none in (df.where("false"), df.where("vec_id >= 900 and vec_id < 902")):
        assert [(r.vec_id, r.class_id, r.n_links) for r in embeddings.embedding_classes(none).orderBy("vec_id").collect()] == [(r.vec_id, r.vec_id, 0) for r in none.orderBy("vec_id").collect()]
    ids = {r.vec_id for r in read(spark, "embeddings").collect()}
    assert sorted(r.vec_id for r in queries.op10_embedding_pairs(spark, SF).collect()) == sorted(ids)


def test_few_lists(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 16))
    x = np.concatenate([x, x[:100] + 0.02 * rng.normal(size=(100, 16))])
    df = spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    all_lists, few = ({(r.vec_a, r.vec_b) for r in embeddings.embedding_pairs(df, **how).collect()} for how in ({}, {"most_lists": 3}))
    assert all_lists == few and len(few) >= 100
