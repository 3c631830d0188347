"""Notices beside each other, and credentials by owners, in texts."""

import hashlib
import random

from pyspark.sql import functions as F

from pathloom.llm import licenses, secrets

# 3


def test_adjacent_notices():
    find = licenses.Finder(licenses.NOTICES).spans
    assert find("released under teh mit license\nreleased under the mit license") == [("mit", 0, 30, 2), ("mit", 31, 61, 0)]
    assert find("all rights reservd all rights reserved") == [("all-rights", 0, 18, 1), ("all-rights", 19, 38, 0)]
    random.seed(3)
    for name, notice in licenses.NOTICES.items():
        for _ in range(5):
            text, want = "", []
            for e in sorted((random.randint(0, licenses.edits(notice)) for _ in range(6)), reverse=True):
                chars = list(notice)
                for at in random.sample(range(3, len(notice) - 3), e):
                    chars[at] = "#"
                want.append((name, len(text), len(text) + len(notice), e))
                text += "".join(chars) + "\n"
            assert [s for s in find(text) if s[0] == name] == want


# 1


def test_one_owner_of_many_repositories(spark):
    own, hot = "q9w8e7r6t5y4u3i2o1p0", "a1b2c3d4e5f6a7b8c9d0"
    rows = [(i, f'token = "{own}"', f"me/r{i}") for i in range(5)] + [(10 + i, f'token = "{hot}"', f"o{i}/r") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_repos, r.n_owners, r.verdict) for r in secrets.secret_ownership(df).collect()}
    assert got == {i: (5, 1, "owner_specific") if i < 5 else (3, 3, "copied_example") for i, *_ in rows}
    assert all((own in r.text) is False and (hot in r.text) is (r.doc_id >= 10) for r in secrets.mask_live_secrets(df).collect())


def test_long_and_bare_values(spark):
    random.seed(6)
    long = "".join(random.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(500))
    bare = "Zq9w8e7r6t5y4u3i2o1p0"
    texts = [f'token = "{long}"', f"PORT=80\nAPI_KEY={bare}\nMODE=on", f"password: {bare}x", f"see sk_live_{long} there", f"see xoxb-{long} there", f"auth={bare}y.", "the author = someone, and token = request(12345678901234567890) or auth: see below"]
    values = [long, bare, bare + "x", "sk_live_" + long, "xoxb-" + long, bare + "y"]
    df = spark.createDataFrame([(i, t, f"o{i}/r") for i, t in enumerate(texts)], "doc_id long, text string, source string").withColumn("n_chars", F.length("text"))
    got = {r.doc_id: (r.secret_hash, r.verdict) for r in secrets.secret_ownership(df).collect()}
    assert got == {i: (hashlib.sha256(v.encode()).hexdigest(), "owner_specific") for i, v in enumerate(values)}
    masked = {r.doc_id: r for r in secrets.mask_live_secrets(df).collect()}
    assert [masked[i].text for i in range(7)] == [t.replace(v, "[SECRET]") for t, v in zip(texts, [*values, "\0"])]
    assert all(r.n_chars == len(r.text) for r in masked.values())
