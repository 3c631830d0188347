"""The operators where they once did less than the whole job, against brute force."""

from collections import Counter
from math import log

import numpy as np
from test_operators import WORD, lower, read

from pathloom.llm import embeddings, pii

# 9


def test_terms_of_rare_entities(spark):
    texts = {r.doc_id: r.text for r in read(spark, "documents").select("doc_id", "text").collect()}
    found = {i: pii.entities(t) for i, t in texts.items()}
    words = {i: [(m.start(), m.end(), lower(m.group())) for m in WORD.finditer(t)] for i, t in texts.items()}
    outside = {i: [w for a, b, w in words[i] if not any(x < b and a < z for x, z, _ in s)] for i, s in found.items() if s}
    ents = {i: {pii.identity(texts[i][a:b], k) for a, b, k in found[i]} for i in outside}
    n, dt = len(texts), Counter(w for own in words.values() for w in {w for *_, w in own})
    de, det = Counter(e for own in ents.values() for e in own), Counter((e, w) for i in outside for e in ents[i] for w in set(outside[i]))
    want = {}
    for i, own in outside.items():
        told = {w: max(log((det[e, w] + de[e] / n) / (dt[w] + 1) * n / de[e]) / log(n / de[e]) for e in ents[i]) for w in set(own)}
        want[i] = (sum(pii.GENERALISE <= told[w] < pii.REMOVE for w in own), sum(told[w] >= pii.REMOVE for w in own))
    got = {r.doc_id: (r.n_generalised, r.n_removed) for r in pii.sanitise(read(spark, "documents")).collect()}
    assert got == want and max(de.values()) < 3 and all(sum(x[k] for x in got.values()) for k in (0, 1))


def test_terms_far_from_an_entity(spark):
    rows = [(0, "rarity " + "and so on " * 40 + "call +1 (555) 123-4567")] + [(i, "and so on call") for i in range(1, 50)]
    (got,) = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert got.n_removed + got.n_generalised == 1 and "rarity" not in got.sanitized and "and so on" in got.sanitized


# 10


def test_pairs_of_few_intrinsic_dimensions(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(4000, 5)) @ np.linalg.qr(rng.normal(size=(384, 5)))[0].T).astype(np.float32)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit.astype(float) @ unit.T.astype(float)
    want = {(i, j) for i, j in zip(*(v.tolist() for v in np.nonzero(cos >= 0.95 + 1e-6))) if i < j}
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    got = {(r.vec_a, r.vec_b) for r in embeddings.embedding_pairs(df).collect()}
    assert want <= got and all(cos[p] >= 0.95 - 1e-6 for p in got)
    assert len(got & want) > 1000
