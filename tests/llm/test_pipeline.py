"""The pipeline's stages against brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F
from test_operators import brute_spans, expected_pairs

import corpus_pipeline
from pathloom.llm import pii, quality, secrets

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "p")
        f(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return {n: (a, b) for n, a, b in out}


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for name, (before, after) in stages.items():
        if name != "encode":
            assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality(spark, stages):
    before, after = stages["quality"]
    model = quality.train(before, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.grade(before, model).where("selected").collect()}
    assert set(rows(after)) == want
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r.quality and not r.toxic]
    assert sum(i in want for i in clean) > 0.95 * len(clean)


def test_near_dup(spark, stages):
    before, after = stages["near_dup"]
    group = {i: i for i in rows(before)}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in expected_pairs(spark, before):
        a, b = sorted((find(a), find(b)))
        group[b] = a
    assert set(rows(after)) == {i for i in group if find(i) == i} and after.count() < before.count()


def test_decontaminate(spark, stages):
    before, after = stages["decontaminate"]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    spans, want = {}, rows(before)
    for d, a, b, _ in brute_spans(want.items(), items):
        spans.setdefault(d, []).append((a, b))
    for d, own in spans.items():
        for a, b in reversed(own):
            want[d] = want[d][:a] + want[d][b:]
    got = rows(after)
    assert spans and all(got.get(d, "") == t or d not in got for d, t in want.items()) and set(want) - set(got) <= set(spans)
    assert after.where(F.col("n_chars") != F.length("text")).count() == before.where(F.col("n_chars") != F.length("text")).count()


def test_secrets(stages):
    before, after = stages["secrets"]
    live = {}
    for r in secrets.secret_ownership(before).where("verdict = 'owner_specific'").collect():
        live.setdefault(r.doc_id, r)
    a, b = rows(before), rows(after)
    assert set(a) == set(b) and {i for i in a if a[i] != b[i]} == set(live)
    assert secrets.secret_ownership(after).where("verdict = 'owner_specific'").count() == 0


def test_encode(stages):
    before, after = stages["encode"]
    assert after.count() == before.count() and after.where("round_trip").count() == after.count()


def test_run_and_oddities(spark, odd, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["encode"][1].count()
    assert corpus_pipeline.ORACLE_SQL is None and pii.WINDOW
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, odd, SF).count() <= odd.count() and f(spark, odd.where("false"), SF).count() == 0
