"""Foreign keys that act on a delete: which rows they reach, and how many bytes they move."""

import pytest
from compare import spark_rows
from pyspark.sql import functions as F

from pathloom.catalog import Catalog
from pathloom.operators import mutations


def family(spark, parents, children, action):
    c = Catalog(spark)
    c.register("a", parents, ("id",))
    c.register("b", children, ("k",), [(("a",), "a", ("id",))])
    (f,) = c.model.table("b").fkeys
    f.on_delete = action
    c.model.table("b").columns["a"].nullok = True
    return c


def test_rows_that_share_a_declared_key(spark):
    """Keys of registered tables aren't checked: only rows that refer to a row deleted go."""
    c = family(spark, spark.range(3), spark.createDataFrame([(1, 1), (1, 2), (1, None)], "k long, a long"), "CASCADE")
    c.delete("entity/a/id=1")
    assert sorted(map(str, c.rows["public", "b"].collect())) == ["Row(k=1, a=2)", "Row(k=1, a=None)"]


@pytest.mark.parametrize("kind", ["bigint", "string"])
@pytest.mark.parametrize("words,action", [(1, "CASCADE"), (1 << 20, "CASCADE"), (1 << 20, "SET NULL")])
def test_filters_lose_nothing(spark, monkeypatch, kind, words, action):
    for name, value in (("FEW", 0), ("FILTERED", 0), ("WORDS", words)):
        monkeypatch.setattr(mutations, name, value)
    children = spark.range(400).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.col("id") % 100).cast(kind).alias("a"))
    c = family(spark, spark.range(100).select(F.col("id").cast(kind).alias("id"), (F.col("id") % 3).alias("v")), children, action)
    c.delete("entity/a/v=0")
    gone = F.coalesce(F.col("a").cast("bigint") % 3 == 0, F.lit(False))
    want = children.where(~gone) if action == "CASCADE" else children.withColumn("a", F.when(~gone, F.col("a")))
    assert spark_rows(c.rows["public", "b"]) == spark_rows(want)
    assert c.rows["public", "a"].count() == 66


def shuffled(spark, do):
    """Bytes that the shuffles of do write."""
    sc = spark.sparkContext._jsc.sc()

    def stages():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(k) for k in range(found.size()))}

    before = stages()
    do()
    return sum(v for k, v in stages().items() if k not in before)


def test_rows_that_stay_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(mutations, "FEW", 0, raising=False)
    monkeypatch.setattr(mutations, "FILTERED", 0, raising=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        children = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") % 4000).alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
        once = shuffled(spark, lambda: children.repartition(4, "k").write.format("noop").mode("overwrite").save())
        c = family(spark, spark.range(4000), children, "CASCADE")
        took = shuffled(spark, lambda: c.delete("entity/a/id::lt::200"))
        assert c.rows["public", "b"].count() == 190_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert took < once / 4, (took, once)
