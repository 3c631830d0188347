"""Semantics on small rows whose answers are known."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from pathloom.catalog import Catalog, Client, Registry, moment_code, moment_of
from pathloom.errors import BadRequest, Conflict, Forbidden, NotFound, Unsupported
from pathloom.functions import rid
from pathloom.operators import history
from pathloom.plans.model import Type
from pathloom.plans.syntax import parse
from pathloom.sources import formats


def column(name, kind, nullok=True, **more):
    return {"name": name, "type": {"typename": kind}, "nullok": nullok, **more}


def doc(table, columns, keys, fkeys=()):
    return {
        "table_name": table, "column_definitions": columns, "keys": [{"unique_columns": k} for k in keys],
        "foreign_keys": [{"foreign_key_columns": [{"column_name": c}], "referenced_columns": [{"schema_name": "public", "table_name": t, "column_name": k}], **more} for c, t, k, more in fkeys],
    }


class Clock:
    def __init__(self):
        self.now = datetime(2020, 1, 1, tzinfo=timezone.utc)

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


@pytest.fixture()
def basic(spark):
    c = Catalog(spark, clock=Clock())
    c.create(doc("top", [column("id", "int8", False), column("name", "text"), column("a_text", "text[]"), column("a_int4", "int4[]")], [["id"]]))
    c.create(doc("leaf", [column("id", "int8", False), column("level1_id", "int8"), column("name", "text")], [["id"]], [("level1_id", "top", "id", {})]))
    one = [(1, "foo", ["one", "foo", "BAR", "BAZ"], [0, 1]), (2, "bar", ["two", "FOO", "bar", "BAZ"], [0, 2]), (3, "baz", ["three", "FOO", "BAR", "baz"], [0, 3]), (4, "unreferenced", None, None)]
    c.insert("entity/top", spark.createDataFrame(one, "id long, name string, a_text array<string>, a_int4 array<int>"))
    two = [(1, "foo 1", 1), (2, "foo 2", 1), (3, "bar 1", 2), (4, "baz 1", 3), (5, "disconnected", None)]
    c.insert("entity/leaf", spark.createDataFrame(two, "id long, name string, level1_id long"))
    return c


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize("how,want", [("", (3, 4, 4)), ("left", (4, 4, 5)), ("right", (3, 5, 5)), ("full", (4, 5, 6))])
def test_joins(basic, how, want):
    r = basic.query(f"aggregate/A:=top/{how}(id)=(leaf:level1_id)/a:=cnt_d(A:id),b:=cnt_d(id),n:=cnt(*)").first()
    assert (r.a, r.b, r.n) == want


@pytest.mark.parametrize("cond,want", [
    ("id=any(1,2,3,4)", [1, 2, 3, 4]), ("id=all(1,2,3,4)", []), ("a_int4=any(0,1)", [1, 2, 3]), ("a_int4=all(0,1)", [1]), ("a_text=any(foo,bar)", [1, 2]), ("a_text=all(foo,bar)", []),
    ("name::regexp::any(oo,bar)", [1, 2]), ("a_text::ciregexp::any(foo,bar)", [1, 2, 3]), ("*::ciregexp::any(foo,bar)", [1, 2, 3]), ("a_int4=1", [1]), ("a_int4::gt::1", [2, 3]), ("!a_int4::gt::1", [1]),
    ("a_text::null::", [4]), ("!(id=1;id=2)", [3, 4]), ("name::ts::foo", [1]), ("id=1;id=2&name=foo", [1]), ("name=", []), ("a_int4::geq::3", [3]),
])
def test_predicates(basic, cond, want):
    assert ids(basic.query(f"entity/top/{cond}")) == want


def test_distinct_and_links(basic):
    assert ids(basic.query("entity/A:=top/leaf/$A")) == [1, 2, 3]
    assert ids(basic.query("entity/leaf/(level1_id)")) == [1, 2, 3]
    assert ids(basic.query("entity/top/id=1/(leaf:level1_id)")) == [1, 2]
    assert ids(basic.query("entity/A:=top/B:=leaf/A:name=foo&B:name::regexp::2")) == [2]
    with pytest.raises(Conflict):
        basic.query("entity/top/top")
    assert len(basic.query("attribute/A:=top/(id)=(leaf:level1_id)/$A/id,x:=leaf:name").collect()) == 3


@pytest.mark.parametrize("path", ["entity/top@after(1)", "entity/top@sort(id)@after(1,2)", "entity/top@sort(id)@before(3)", "aggregate/top/n:=cnt(*)@sort(n)", "entity/top/id=(1,2)", "entity/top/*=1", "aggregate/top/cnt(*)", "aggregate/top/id", "attribute/top/id,id", "entity/top/id=x", "nothing/top", "attribute/top", "entity/top@sort(nope)", "entity/A:=top/A:=leaf", "entity/top/id::what::1", "entity/top/id=some(1,2)", "attributegroup/top/b:=bin(id;0;1;2);n:=cnt(*)", "attributegroup/top/b:=bin(id;2;1;1);n:=cnt(*)", "aggregate/top/m:=sum(*)"])
def test_bad_requests(basic, path):
    with pytest.raises(BadRequest):
        basic.query(path)


@pytest.mark.parametrize("path", ["aggregate/top/m:=sum(name)", "aggregate/top/m:=avg(a_int4)", "entity/top/nope=1", "entity/nope", "attributegroup/top/b:=bin(name;2;1;3);n:=cnt(*)"])
def test_conflicts(basic, path):
    with pytest.raises(Conflict):
        basic.query(path)


def test_paging(spark):
    c = Catalog(spark)
    rows = [(n, v) for n in ("bar", "baz", "foo") for v in (0, 1, 2, 3, 4, None)] + [(None, 5), (None, None)]
    c.register("shelf", spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "id long, name string, value int"), ("id",))
    n = lambda p, limit=None: len(c.query("entity/shelf" + p, limit).collect())
    for p, want in [("@sort(name,value)@after(,4)", 20), ("@sort(name,value)@after(bar,3)", 16), ("@sort(name,value)@after(bar,::null::)", 14), ("@sort(name,value)@after(::null::,::null::)", 0), ("@sort(value,id)@after(::null::,12)", 2)]:
        assert n(p) == want
    for p, want in [("@sort(name,value)@before(,4)", 0), ("@sort(name,value)@before(bar,3)", 3), ("@sort(name,value)@before(bar,::null::)", 5), ("@sort(name,value)@before(::null::,::null::)", 19), ("@sort(value,id)@before(::null::,12)", 17)]:
        assert n(p, 50) == want
    assert n("@sort(name)@after(aaa)@before(::null::)") == 18
    assert n("@sort(value)@after(-1)@before(::null::)") == 16
    assert n("@sort(id)@after(0)@before(::null::)") == 20
    assert n("@sort(id)@after(0)@before(::null::)", 10) == 10
    # descending pages partition the rows at every bound
    whole = [tuple(r) for r in c.query("attribute/shelf/name,value,id@sort(name::desc::,value::desc::,id)").collect()]
    assert whole[0][0] is None
    for k, (a, b, i) in enumerate(whole):
        key = ",".join("::null::" if x is None else str(x) for x in (a, b, i))
        after = c.query(f"attribute/shelf/name,value,id@sort(name::desc::,value::desc::,id)@after({key})").collect()
        before = c.query(f"attribute/shelf/name,value,id@sort(name::desc::,value::desc::,id)@before({key})?limit=3").collect()
        assert [tuple(r) for r in after] == whole[k + 1 :] and [tuple(r) for r in before] == whole[max(0, k - 3) : k]
        if k > 6:
            break


def test_aggregates_of_arrays(spark):
    c = Catalog(spark)
    c.register("t", spark.createDataFrame([(1, "T", None, None), (2, None, ["T", "T"], []), (3, None, None, ["x"])], "sid int, c1 string, c2 array<string>, c3 array<string>"), ("sid",))
    r = c.query("aggregate/t/a:=array(c1),d:=array_d(c1),n:=cnt(c1),s:=cnt(*),k:=cnt_d(c3),lo:=min(c3),hi:=max(c2),rows:=array(*)").first()
    assert sorted(r.a, key=str) == [None, None, "T"] and sorted(r.d, key=str) == [None, "T"]
    assert (r.n, r.s, r.k, r.lo, r.hi, len(r.rows)) == (1, 3, 2, [], ["T", "T"], 3)
    assert c.query("aggregate/t/sid::gt::9/a:=array(c1),n:=cnt(*)").first().a is None


def test_bins(spark):
    c = Catalog(spark)
    c.register("t", spark.createDataFrame([(i, v) for i, v in enumerate([None, -1.0, 0.0, 4.9, 5.0, 9.99, 10.0])], "i int, v double"), ("i",))
    got = {r.i: tuple(r.b) for r in c.query("attribute/t/i,b:=bin(v;2;0;10)").collect()}
    assert got == {0: (None, None, None), 1: (0, None, 0.0), 2: (1, 0.0, 5.0), 3: (1, 0.0, 5.0), 4: (2, 5.0, 10.0), 5: (2, 5.0, 10.0), 6: (3, 10.0, None)}


def test_writes(basic, spark):
    with pytest.raises(Conflict):
        basic.insert("entity/top", spark.createDataFrame([(1, "x")], "id long, name string"))
    with pytest.raises(BadRequest):
        basic.insert("entity/top", spark.createDataFrame([(7, "x"), (7, "y")], "id long, name string"))
    with pytest.raises(Conflict):
        basic.insert("entity/leaf", spark.createDataFrame([(7, 99)], "id long, level1_id long"))
    assert basic.insert("entity/top", spark.createDataFrame([(1, "x"), (8, "y")], "id long, name string"), onconflict="skip").count() == 1
    basic.upsert("entity/top", spark.createDataFrame([(8, "z"), (9, "w")], "id long, name string"))
    assert {r.id: r.name for r in basic.query("entity/top/id::gt::4").collect()} == {8: "z", 9: "w"}
    basic.update("attributegroup/top/old:=id;new:=id", spark.createDataFrame([(9, 10)], "old long, new long"))
    assert ids(basic.query("entity/top/id::gt::8")) == [10]
    with pytest.raises(Conflict):
        basic.update("attributegroup/top/old:=id;new:=id", spark.createDataFrame([(1, 11)], "old long, new long"))
    with pytest.raises(Conflict):
        basic.delete("entity/top/id=1")
    basic.delete("attribute/top/id=8/name")
    assert basic.query("entity/top/id=8").first().name is None
    with pytest.raises(Conflict):
        basic.delete("attribute/top/id=8/id")
    with pytest.raises(NotFound):
        basic.delete("entity/top/id=99")
    basic.delete("entity/leaf/name=disconnected")
    assert ids(basic.query("entity/leaf")) == [1, 2, 3, 4]


@pytest.mark.parametrize("action,left", [("CASCADE", []), ("SET NULL", [(1, None)])])
def test_foreign_key_actions(spark, action, left):
    c = Catalog(spark)
    c.create(doc("a", [column("id", "int8", False)], [["id"]]))
    c.create(doc("b", [column("id", "int8", False), column("a", "int8")], [["id"]], [("a", "a", "id", {"on_delete": action})]))
    c.insert("entity/a", spark.createDataFrame([(1,)], "id long"))
    c.insert("entity/b", spark.createDataFrame([(1, 1)], "id long, a long"))
    c.delete("entity/a/id=1")
    assert [tuple(r) for r in c.query("entity/b").collect()] == left


def test_system_columns(spark):
    c = Catalog(spark, clock=Clock())
    system = [column("RID", "text", False), column("RCT", "timestamptz", False), column("RMT", "timestamptz", False), column("RCB", "text"), column("RMB", "text")]
    c.create(doc("t", [*system, column("id", "serial8", False), column("v", "text"), column("uri", "row_uri", default="/id/{RID}")], [["RID"], ["id"]]))
    me = Client("me", frozenset({"staff"}))
    c.insert("entity/t", spark.createDataFrame([("a",), ("b",)], "v string"), client=me)
    rows = c.query("entity/t").collect()
    assert len({r.RID for r in rows}) == 2 and {r.RCB for r in rows} == {"me"} and all(r.uri == f"/id/{r.RID}" for r in rows)
    before = {r.v: r.RMT for r in rows}
    c.update("attributegroup/t/v;uri", spark.createDataFrame([("a", "x")], "v string, uri string"), client=Client("you"))
    after = {r.v: (r.RMT, r.RMB) for r in c.query("entity/t").collect()}
    assert after["a"][0] > before["a"] and after["a"][1] == "you" and after["b"] == (before["b"], "me")
    assert c.query(f"entity/t/RID={rows[0].RID.lower()}").count() == 1
    assert c.entity_rid(rows[0].RID).first().table == "t"
    code = c.lease(1, me).first().RID
    with pytest.raises(Forbidden):
        c.insert("entity/t", spark.createDataFrame([(code, "c")], "RID string, v string"), nondefaults=("RID",), client=Client("you"))
    c.insert("entity/t", spark.createDataFrame([(code, "c")], "RID string, v string"), nondefaults=("RID",), client=me)
    with pytest.raises(Conflict):
        Catalog(spark, require_primary_keys=True).create(doc("u", [column("id", "int8", False)], [["id"]]))


def test_snapshots(basic, spark):
    first = basic.changes[-1]
    basic.update("attributegroup/top/id;name", spark.createDataFrame([(1, "changed")], "id long, name string"))
    basic.delete("entity/leaf")
    name = lambda at: basic.query(f"catalog/1@{moment_code(at)}/entity/top/id=1").first().name
    assert name(first) == "foo" and name(basic.changes[-1]) == "changed"
    assert basic.query(f"catalog/1@{moment_code(first)}/entity/leaf").count() == 5 and basic.query("entity/leaf").count() == 0
    with pytest.raises(Conflict):
        basic.query("catalog/1@2001-01-01/entity/top")
    with pytest.raises(Forbidden):
        basic.delete(f"catalog/1@{moment_code(first)}/entity/top")
    basic.redact_history(basic.model.table("top"), "name", only="id=1")
    assert name(first) is None
    basic.truncate_history(basic.changes[-1])
    assert basic.query(f"catalog/1@{moment_code(basic.changes[-1])}/entity/leaf").count() == 0
    assert moment_of(moment_code(first)) == first


def test_amended_intervals():
    t = [datetime(2020, 1, d) for d in range(1, 6)]
    assert history.amended([(t[0], t[2], "a"), (t[2], None, "b")], t[1], t[3], "x") == [(t[0], t[1], "a"), (t[1], t[2], "x"), (t[2], t[3], "x"), (t[3], None, "b")]


def test_rights(basic):
    t = basic.model.table("top")
    t.acls = {"select": ["reader"], "update": [], "delete": ["reader"], "insert": []}
    assert basic.query("entity/top").count() == 0
    reader = Client("r", frozenset({"reader"}))
    assert basic.query("entity/top", client=reader).count() == 4
    t.acl_bindings = {"named": {"types": ["update"], "projection": [{"filter": "id", "operator": "::gt::", "operand": 2}, "a_text"], "projection_type": "nonnull"}}
    with pytest.raises(Forbidden):
        basic.delete("attribute/top/id=1/name", client=reader)
    basic.delete("attribute/top/id=3/name", client=reader)
    with pytest.raises(Forbidden):
        basic.delete("entity/leaf/id=5", client=reader) if basic.model.table("leaf").acls.update({"delete": []}) is None else None


def test_rid_codec(spark):
    ns = [0, 1, 2, 15, 16, 1024, 2**31, 2**62, 2**63 - 1]
    got = [tuple(r) for r in spark.createDataFrame([(n,) for n in ns], "n long").select("n", rid.encode(F.col("n")).alias("c")).select("n", "c", rid.decode("c")).orderBy("n").collect()]
    codes = {n: c for n, c, _ in got}
    assert all(n == back for n, _, back in got)
    assert (codes[0], codes[1], codes[2], codes[15], codes[16], codes[1024]) == ("0", "2", "4", "Y", "10", "200")


def test_formats(basic, spark):
    t = basic.model.table("top")
    back = formats.read_rows(spark, t, 'id,name,a_int4\n7,,"{1,2}"\n8,"",[3]\n9,"a ""b"",c",\n', formats.CSV).orderBy("id").collect()
    assert [tuple(r) for r in back] == [(7, None, [1, 2]), (8, "", [3]), (9, 'a "b",c', None)]
    got = formats.render(basic.query("attribute/top/id,a_int4@sort(id)"), formats.CSV)
    assert got.splitlines()[:2] == ["id,a_int4", '1,"{0,1}"']
    assert '"a_int4":null' in formats.render(basic.query("attribute/top/id=4/id,a_int4"), formats.JSON)
    assert formats.render(basic.query("attribute/top/id=1/a_int4"), formats.CSV, "json").splitlines()[1] == '"[0,1]"'
    assert formats.read_rows(spark, t, '[{"id": 1, "a_text": ["x"]}, {"id": 2}]').count() == 2
    assert formats.read_rows(spark, t, '{"id": 1}\n{"id": 2}\n', formats.LINES).count() == 2
    for body, kind, error in [("id,id\n1,2\n", formats.CSV, BadRequest), ("nope\n1\n", formats.CSV, BadRequest), ("", formats.CSV, BadRequest), ("[1]", formats.JSON, BadRequest), ("", "text/html", Unsupported)]:
        with pytest.raises(error):
            formats.read_rows(spark, t, body, kind)


def test_files(basic, spark, tmp_path):
    t = basic.model.table("top")
    for kind in (formats.LINES, formats.CSV):
        path = str(tmp_path / kind.replace("/", "_"))
        formats.write_files(basic.query("entity/top"), path, kind)
        assert [tuple(r) for r in formats.read_files(spark, t, path, kind).orderBy("id").collect()] == [tuple(r) for r in basic.query("entity/top@sort(id)").collect()]


def test_model_changes(basic, spark):
    t = basic.model.table("top")
    from pathloom.plans.model import Column

    basic.add_column(t, Column("extra", Type.of("int4"), default=5))
    assert basic.query("entity/top/extra=5").count() == 4
    basic.alter_column(t, "name", new_name="title")
    assert basic.query("entity/top/title=foo").count() == 1
    basic.alter_table(t, name="renamed")
    assert basic.query("entity/renamed/leaf").count() == 4
    basic.drop_column(t, "extra")
    with pytest.raises(Conflict):
        basic.drop_table(t)
    basic.drop_table(basic.model.table("leaf"))
    again = Catalog(spark)
    again.create(basic.model.document())
    assert set(again.model.table("renamed").columns) == {"id", "title", "a_text", "a_int4"}


def test_registry(spark):
    r = Registry()
    c = r.create(spark)
    c.register("t", spark.range(3), ("id",))
    r.alias("main", c.id)
    assert r.query("catalog/main/entity/t").count() == 3
    r.delete("main")
    with pytest.raises(NotFound):
        r.get("main")


def test_plans_push_filters_and_avoid_products(spark):
    from pathloom.queries import catalog

    c = catalog(spark, "/root/testdata/sf0.001")
    plan = c.query("entity/A:=orders/o_totalprice::gt::1000/lineitem/l_quantity::gt::49/$A")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "GreaterThan(o_totalprice" in plan and "GreaterThan(l_quantity" in plan and "l_comment" not in plan and "Cartesian" not in plan
    assert parse("entity/a").steps


def test_disabled_history_and_listeners(basic, spark):
    seen = []
    basic.listeners.append(seen.append)
    basic.model.table("leaf").history = False
    basic.delete("entity/leaf/id=5")
    assert [w.kind for w in seen] == ["delete"]


def test_descriptions_and_audit(basic, spark):
    t = basic.model.table("top")
    basic.describe(t, comment="first", annotations={"tag:x": {"a": 1}}, acls={"select": ["*"]})
    assert (t.comment, t.annotations, t.acls) == ("first", {"tag:x": {"a": 1}}, {"select": ["*"]})
    basic.describe(t, annotations={"tag:x": None})
    assert t.annotations == {}
    with pytest.raises(BadRequest):
        basic.describe(t, acls={"fly": ["*"]})
    assert [tuple(r) for r in basic.meta("select").collect()] == [("select", "*")]
    basic.update("attributegroup/top/id;name", spark.createDataFrame([(1, "new")], "id long, name string"))
    seen = [tuple(r) for r in basic.audit(t, basic.changes[-1], show=("id", "name")).collect()]
    assert sorted(seen) == [("+", 1, "new"), ("-", 1, "foo")]


def test_amended_models(basic):
    basic.amend_models(lambda m: m.table("top").acls.update({"select": []}))
    assert basic.query("entity/top").count() == 0
    assert basic.query(f"catalog/1@{moment_code(basic.changes[-1])}/entity/top").count() == 0


def test_rights_of_rows(basic):
    basic.model.table("top").columns["RID"] = basic.model.table("top").columns["name"].__class__("RID", Type.of("text"))
    t = basic.model.table("top")
    basic.rows[t.id] = basic.rows[t.id].withColumn("RID", rid.encode(F.col("id")))
    t.acls = {"update": [], "delete": []}
    t.acl_bindings = {"foo": {"types": ["update"], "projection": "name", "projection_type": "acl"}}
    got = {r.id: r.r for r in basic.query("attribute/top/id,r:=trs(RID)", client=Client("foo")).collect()}
    assert got[1] == '{"update":true,"delete":false}' and got[2] == '{"update":false,"delete":false}'
    assert '"column_update"' in basic.query("attribute/top/id=1/r:=tcrs(RID)").first().r
