"""Test items searched in groups."""

import random

from pyspark.sql import functions as F

from pathloom.llm import contamination

# 8


def test_groups_of_items_as_one_pass(spark, monkeypatch):
    random.seed(12)
    docs = [(i % 140 or None, " ".join(random.choice("abcx") for _ in range(random.randrange(90))), i) for i in range(150)] + [(300, None, 0), (301, "", 0)]
    items = [(i, " ".join(random.choice("abc") for _ in range(random.choice([5, 6, 8, 9, 12])))) for i in range(40)] + [(None, "a b c a b c"), (99, "a b c a b c")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long").repartition(2, "n_chars")
    bench = spark.createDataFrame(items, "item_id long, text string")

    def both():
        spans = contamination.contamination_spans(df, bench).collect()
        return sorted(spans, key=str), sorted(contamination.decontaminate(df, bench).collect(), key=str)

    one = both()
    monkeypatch.setattr(contamination, "ITEMS_AT_ONCE", 150)
    assert bench.agg(F.sum(F.octet_length("text"))).first()[0] > 3 * 150
    assert both() == one and one[0]
