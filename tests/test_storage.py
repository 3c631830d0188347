"""Catalogs in a folder: opened again, written by two, vacuumed; and the text of values."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pathloom.catalog import Catalog, Client, moment_code
from pathloom.errors import BadRequest, Conflict, Forbidden, PathError
from pathloom.functions.text import float_text, scalar_text
from pathloom.operators.predicates import literal
from pathloom.plans.model import Key, Type
from pathloom.sources import storage

DOC = {
    "table_name": "A", "column_definitions": [{"name": n, "type": {"typename": t}, "nullok": n != "id"} for n, t in (("RID", "text"), ("id", "int8"), ("v", "text"), ("p", "numeric(10,2)"))],
    "keys": [{"unique_columns": ["RID"]}, {"unique_columns": ["id"]}, {"unique_columns": ["v"], "enforced": False}], "foreign_keys": [], "annotations": {"a": [1]},
}


def rows(spark, *values):
    return spark.createDataFrame([(i, v, None) for i, v in values], "id long, v string, p decimal(38,18)")


def ids(c, path="entity/A"):
    return sorted(r.id for r in c.query(path).collect())


def test_opened_again(spark, tmp_path):
    root = str(tmp_path / "cat")
    c = Catalog(spark, root=root)
    c.create(DOC)
    c.register("outside", spark.range(3), ("id",))
    c.insert("entity/A", rows(spark, (1, "x"), (2, "y")))
    then, codes = c.changes[-1], {r.RID for r in c.query("entity/A").collect()}
    again = Catalog(spark, root=root)
    assert ids(again) == [1, 2] and again.model.document() == c.model.document() and not again.model.table("A").keys[2].enforced
    again.register("outside", spark.range(3), ("id",))
    assert ids(again, "entity/outside") == [0, 1, 2]
    again.insert("entity/A", rows(spark, (9, "z")))
    again.delete("entity/A/id=1")
    third = Catalog(spark, root=root)
    assert ids(third) == [2, 9] and ids(third, f"catalog/1@{moment_code(then)}/entity/A") == [1, 2]
    assert not codes & {r.RID for r in third.query("entity/A/id=9").collect()}
    assert Catalog(spark, root=str(tmp_path / "other")).changes == []


def test_two_writers(spark, tmp_path):
    root = str(tmp_path / "cat")
    first = Catalog(spark, root=root)
    first.create(DOC)
    second = Catalog(spark, root=root)
    first.insert("entity/A", rows(spark, (1, "x")))
    with pytest.raises(Conflict):
        second.insert("entity/A", rows(spark, (2, "y")))
    assert ids(Catalog(spark, root=root)) == [1]


def test_vacuum_and_parts(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "cat")
    c = Catalog(spark, root=root)
    c.create(DOC)
    for k in range(4):
        c.insert("entity/A", rows(spark, (k, str(k))))
    # an insert writes its own rows and no others
    assert [spark.read.parquet(f"{root}/{p}").count() for p in c.files["public", "A"]] == [1, 1, 1, 1] and ids(c) == [0, 1, 2, 3]
    monkeypatch.setattr("pathloom.catalog.PARTS", 3)
    c.insert("entity/A", rows(spark, (4, "4")))
    assert len(c.files["public", "A"]) == 1 and ids(c) == [0, 1, 2, 3, 4]
    assert c.vacuum() > 0 and ids(c) == ids(Catalog(spark, root=root)) == [0, 1, 2, 3, 4]
    assert c.vacuum() == 0 and len(storage.Folder(spark, root).manifests()) == 1


def test_delete_is_one_change(spark, tmp_path):
    c = Catalog(spark, root=str(tmp_path / "cat"))
    c.create(DOC)
    child = {"table_name": "B", "column_definitions": [{"name": "id", "type": "int8", "nullok": False}, {"name": "a", "type": "int8"}], "keys": [{"unique_columns": ["id"]}], "foreign_keys": [{"foreign_key_columns": [{"column_name": "a"}], "referenced_columns": [{"schema_name": "public", "table_name": "A", "column_name": "id"}], "on_delete": "CASCADE"}]}
    c.create(child)
    c.insert("entity/A", rows(spark, (1, "x"), (2, "y")))
    c.insert("entity/B", spark.createDataFrame([(1, 1), (2, 2)], "id long, a long"))
    before = len(c.changes)
    c.delete("entity/A/id=1")
    assert len(c.changes) == before + 1 and ids(c) == ids(c, "entity/B") == [2]
    past = c.changes[-2]
    assert ids(c, f"catalog/1@{moment_code(past)}/entity/B") == [1, 2]


def test_skip_takes_one_of_equal_keys(spark):
    c = Catalog(spark)
    c.create(DOC)
    added = c.insert("entity/A", rows(spark, *((1, str(k)) for k in range(50))).repartition(7), onconflict="skip")
    assert [r.v for r in added.collect()] == [r.v for r in c.query("entity/A").collect()] == [r.v for r in c.query("entity/A/id=1").collect()]


def test_pseudo_keys(spark):
    c = Catalog(spark)
    c.create(DOC)
    c.insert("entity/A", rows(spark, (1, "x"), (2, "x")))
    with pytest.raises(Conflict):
        c.add_key(c.model.table("A"), Key(("v",)))
    assert ids(c) == [1, 2]


def test_number_texts(spark):
    def texts(values, kind, f):
        return [r.t for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v")).alias("t")).collect()]

    doubles = {5.0: "5", 1e10: "10000000000", 0.0: "0", -0.5: "-0.5", 1e15: "1e+15", 123456789012345.0: "123456789012345", 1.5e-4: "0.00015", 1e-5: "1e-05", 1.25e-7: "1.25e-07", 1.2345678901234568e17: "1.2345678901234568e+17", -3e22: "-3e+22", 1.7976931348623157e308: "1.7976931348623157e+308", float("inf"): "Infinity"}
    assert texts(doubles, "double", lambda c: float_text(c, 15)) == list(doubles.values()) and texts([-0.0, None], "double", lambda c: float_text(c, 15)) == ["-0", None]
    floats = {5.0: "5", 1e6: "1e+06", 1234567.0: "1.234567e+06", 999999.0: "999999", 1e7: "1e+07"}
    assert texts(floats, "float", lambda c: float_text(c, 6)) == list(floats.values())
    plain = texts(["5", "5.10", "1200", "0.001"], "string", lambda c: scalar_text(c.cast("decimal(38,18)"), "numeric"))
    assert plain == ["5", "5.1", "1200", "0.001"] and texts(["5.1"], "string", lambda c: scalar_text(c.cast("decimal(10,2)"), "numeric", 2)) == ["5.10"]
    assert texts(["11:32:56", "09:05", "00:00:07.6"], "string", lambda c: scalar_text(c, "time")) == [" 11: 32: 56", " 09: 05: 00", " 00: 00: 08"]
    assert texts(["11:32:56-08:00", "09:05Z"], "string", lambda c: scalar_text(c, "timetz")) == [" 19: 32: 56", " 09: 05: 00"]


@pytest.mark.parametrize("value,kind", [("x", "int4"), ("2147483648", "int4"), ("-32769", "int2"), ("9223372036854775808", "int8"), ("1e30", "numeric"), ("nope", "float8"), ("garbage", "date"), ("2020-13-01", "date"), ("2020-02-30", "timestamp"), ("25:00", "time"), ("maybe", "boolean"), ("{", "json")])
def test_bad_literals(spark, value, kind):
    with pytest.raises(BadRequest):
        literal(value, Type(kind))


def test_good_literals(spark):
    cases = {("2147483647", "int4"): 2147483647, ("2020-2-3", "date"): datetime(2020, 2, 3).date(), ("2020-02", "date"): datetime(2020, 2, 1).date(), ("2020-02-03 04:05:06", "timestamp"): datetime(2020, 2, 3, 4, 5, 6), ("2015-03-11T11:32:56-0100", "timestamptz"): datetime(2015, 3, 11, 12, 32, 56, tzinfo=timezone.utc), ("11:32", "time"): "11:32"}
    got = spark.range(1).select(*(literal(v, Type(k)).alias(f"c{i}") for i, (v, k) in enumerate(cases))).first()
    for g, w in zip(got, cases.values()):
        assert (g.astimezone(timezone.utc) == w) if isinstance(w, datetime) and w.tzinfo else g == w


def test_anonymous_and_rights_at_a_snapshot(spark):
    c = Catalog(spark, clock=iter(datetime(2021, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=k) for k in range(99)).__next__)
    c.create(DOC)
    with pytest.raises(Forbidden):
        c.insert("entity/A", rows(spark, (1, "x")), client=Client())
    c.insert("entity/A", rows(spark, (1, "x")), client=Client("me"))
    assert c.query("attribute/A/r:=trs(RID)", client=Client("me")).first().r == '{"update":true,"delete":true}' and c.query("attribute/A/r:=trs(RID)").first().r == '{"update":false,"delete":false}'


def test_changes_leave_other_files(spark, tmp_path):
    root = str(tmp_path / "cat")
    c = Catalog(spark, root=root)
    c.create({**DOC, "keys": DOC["keys"][:2]})  # with the pseudo-key, rows would match on v too
    for k in range(5):
        c.insert("entity/A", rows(spark, (2 * k, str(k)), (2 * k + 1, str(k))))
    before, past = list(c.files["public", "A"]), list(c.past_files["public", "A"])
    c.delete("entity/A/id=4")
    kept = [p for p in before if p in c.files["public", "A"]]
    assert len(kept) == 4 and ids(c) == [0, 1, 2, 3, 5, 6, 7, 8, 9] and len([p for p in past if p in c.past_files["public", "A"]]) >= 4
    c.update("attributegroup/A/id;v", spark.createDataFrame([(7, "new")], "id long, v string"))
    c.delete("attribute/A/id=8/p")
    c.upsert("entity/A", rows(spark, (9, "nine"), (20, "twenty")))
    c.vacuum()
    again = Catalog(spark, root=root)
    assert {r.id: r.v for r in again.query("entity/A").collect()} == {0: "0", 1: "0", 2: "1", 3: "1", 5: "2", 6: "3", 7: "new", 8: "4", 9: "nine", 20: "twenty"}


def test_folder_and_memory_agree(spark, tmp_path):
    """The same writes with and without a folder leave the same rows and the same history."""
    import random

    doc = {**DOC, "column_definitions": DOC["column_definitions"][1:], "keys": DOC["keys"][1:2], "annotations": {}}
    child = {"table_name": "B", "column_definitions": [{"name": "id", "type": "int8", "nullok": False}, {"name": "a", "type": "int8"}], "keys": [{"unique_columns": ["id"]}], "foreign_keys": [{"foreign_key_columns": [{"column_name": "a"}], "referenced_columns": [{"schema_name": "public", "table_name": "A", "column_name": "id"}], "on_delete": "SET NULL"}]}

    def start(root):
        now = [datetime(2022, 1, 1, tzinfo=timezone.utc)]
        return now, Catalog(spark, root=root, clock=lambda: now[0])

    both = [start(None), start(str(tmp_path / "cat"))]
    for _, c in both:
        c.create(doc)
        c.create(child)
    random.seed(4)
    for step in range(12):
        kind, some = random.choice(["insert", "upsert", "update", "delete", "clear"]) if step > 1 else "insert", random.sample(range(30), 4)
        for now, c in both:
            now[0] += timedelta(seconds=step % 3)  # some writes share a moment
            try:
                if kind == "insert":
                    c.insert("entity/A", rows(spark, *((i, f"s{step}") for i in some)), onconflict="skip")
                    c.insert("entity/B", spark.createDataFrame([(100 * step + i, i) for i in some], "id long, a long"))
                elif kind == "upsert":
                    c.upsert("entity/A", rows(spark, *((i, f"s{step}") for i in some)))
                elif kind == "update":
                    c.update("attributegroup/A/id;v", spark.createDataFrame([(i, f"s{step}") for i in some], "id long, v string"))
                elif kind == "delete":
                    c.delete(f"entity/A/id=any({','.join(map(str, some))})")
                else:
                    c.delete(f"attribute/A/id=any({','.join(map(str, some))})/v")
            except PathError as e:
                assert e.status == 404
        for store in ("rows", "past"):
            for t in ("A", "B"):
                x, y = (sorted(map(str, getattr(c, store)["public", t].select(*sorted(getattr(c, store)["public", t].columns)).collect())) for _, c in both)
                assert x == y, (step, kind, store, t)
