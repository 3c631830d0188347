"""Further queries: writes, rights, models, catalogs and history, each with its SQL."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import queries as base
from pathloom.catalog import Catalog, Client, Registry, moment_code
from pathloom.errors import Conflict
from pathloom.functions import rid
from pathloom.operators import authz, history
from pathloom.plans.model import SYSTEM, Column, ForeignKey, Key, Table, Type
from pathloom.queries_read import Query, code_sql, status_sql, statuses, values_sql
from pathloom.sources.storage import shared_folder

START = datetime(2020, 1, 1, tzinfo=timezone.utc)
ME = Client("me", frozenset({"staff"}))


def ticking():
    """A clock that goes on by a second whenever it is read."""
    now = [START]

    def clock() -> datetime:
        now[0] += timedelta(seconds=1)
        return now[0]

    return clock


def _column(name: str, kind: str, nullok: bool = True, **more) -> dict:
    return {"name": name, "type": {"typename": kind}, "nullok": nullok, **more}


_SYSTEM = [_column("RID", "row_rid", False), _column("RCT", "row_rct", False), _column("RMT", "row_rmt", False), _column("RCB", "row_rcb"), _column("RMB", "row_rmb")]


def notes(spark: SparkSession, sf_dir: str, rows: int = 500, **how) -> Catalog:
    """A table with system columns and defaults, filled from the first parts."""
    c = Catalog(spark, clock=ticking(), **how)
    own = [_column("id", "int8", False), _column("kind", "text", default="none"), _column("uri", "row_uri", default="/id/{RID}"), _column("size", "int4")]
    c.create({"table_name": "notes", "column_definitions": [*_SYSTEM, *own], "keys": [{"unique_columns": ["RID"]}, {"unique_columns": ["id"]}]})
    c.insert("entity/notes", base.rows(spark, sf_dir, "part").where(F.col("p_partkey") < rows).select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_size").alias("size")), client=ME)
    return c


# writes


def insert_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns named as defaults ignore what is given; identifiers that are given count only where they are named."""
    c = notes(spark, sf_dir, 0)
    parts = base.rows(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), rid.encode(F.col("p_partkey") + 5000).alias("RID"))
    # those given come first: what is made later lies beyond them, while one given later may be taken by then, whatever the number of parts
    c.insert("entity/notes", parts.where("id % 2 = 1"), nondefaults=("RID",), client=ME)
    c.insert("entity/notes", parts.where("id % 2 = 0"), defaults=("kind",), client=ME)
    return c.query("entity/notes").select("id", "kind", "size", F.when(F.col("id") % 2 == 1, F.col("RID")).alias("given"))


def insert_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an insert gives back: the rows added, in full."""
    c = notes(spark, sf_dir, 0)
    added = c.insert("entity/notes", base.rows(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), client=ME)
    return added.select("id", "kind", "size", (F.col("RCT") == F.col("RMT")).alias("new"), "RCB", F.col("RID").isNotNull().alias("named"))


def system_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who made and who changed a row, and whether later."""
    c = notes(spark, sf_dir)
    c.update("attributegroup/notes/kind;size", spark.createDataFrame([("ECONOMY", -1)], "kind string, size int"), client=Client("you", frozenset({"staff"})))
    return c.query("entity/notes").select("id", "size", "RCB", "RMB", (F.col("RMT") > F.col("RCT")).alias("changed"))


def rid_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers in a default's text; all rows have different ones."""
    df = notes(spark, sf_dir).query("entity/notes")
    return df.select((F.col("uri") == F.concat(F.lit("/id/"), "RID")).alias("own"), "RID").groupBy("own").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("RID").alias("different"))


def lease_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = notes(spark, sf_dir, 5)
    codes = [r.RID for r in c.lease(3, ME).collect()]
    row = lambda k, i: spark.createDataFrame([(codes[k] if k < 3 else "ZZ", i)], "RID string, id long")
    put = lambda k, i, who: c.insert("entity/notes", row(k, i), nondefaults=("RID",), client=who)
    return statuses(spark, {"leased": lambda: put(0, 900, ME), "leased by another": lambda: put(1, 901, Client("you", frozenset({"staff"}))), "not leased": lambda: put(3, 902, ME), "used before": lambda: put(0, 903, ME)})


def write_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.catalog(spark, sf_dir)
    nation = lambda *rows: spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int")
    return statuses(spark, {
        "insert of a key twice": lambda: c.insert("entity/nation", nation((90, "x", 1), (90, "y", 1))), "insert of a key that exists": lambda: c.insert("entity/nation", nation((1, "x", 1))),
        "insert without its target": lambda: c.insert("entity/nation", nation((91, "x", 77))), "insert without a key": lambda: c.insert("entity/nation", nation((None, "x", 1))), "insert of an unknown column": lambda: c.insert("entity/nation", spark.createDataFrame([(1,)], "nope int")),
        "insert by a path": lambda: c.insert("entity/region/nation", nation((92, "x", 1))), "insert with a filter": lambda: c.insert("entity/nation/n_name=x", nation((92, "x", 1))), "unknown onconflict": lambda: c.insert("entity/nation", nation((92, "x", 1)), onconflict="maybe"),
        "upsert without a key": lambda: c.upsert("entity/nation", spark.createDataFrame([("x",)], "n_name string")), "upsert of a key twice": lambda: c.upsert("entity/nation", nation((1, "x", 1), (1, "y", 1))), "update that joins keys": lambda: c.update("attributegroup/nation/old:=n_nationkey;new:=n_nationkey", spark.createDataFrame([(1, 2)], "old int, new int")),
        "update of other columns": lambda: c.update("attributegroup/nation/n_nationkey;n_name", spark.createDataFrame([(1,)], "n_nationkey int")), "update of a target in use": lambda: c.update("attributegroup/region/old:=r_regionkey;new:=r_regionkey", spark.createDataFrame([(1, 50)], "old int, new int")),
        "delete of a row in use": lambda: c.delete("entity/nation/n_nationkey=1"), "delete of nothing": lambda: c.delete("entity/nation/n_nationkey=99"), "delete with a sort": lambda: c.delete("entity/nation@sort(n_name)"), "clear of a key": lambda: c.delete("attribute/nation/n_nationkey"),
        "clear of another's cell": lambda: c.delete("attribute/A:=nation/region/A:n_name"), "clear of nothing": lambda: c.delete("attribute/nation/n_nationkey=99/n_name"), "write to a snapshot": lambda: c.delete("catalog/1@2099-01-01/entity/nation"),
    })


_WRITES = {
    "insert of a key twice": 400, "insert of a key that exists": 409, "insert without its target": 409, "insert without a key": 409, "insert of an unknown column": 400, "insert by a path": 400, "insert with a filter": 400, "unknown onconflict": 400,
    "upsert without a key": 409, "upsert of a key twice": 400, "update that joins keys": 409, "update of other columns": 400, "update of a target in use": 409, "delete of a row in use": 409, "delete of nothing": 404, "delete with a sort": 400, "clear of a key": 409,
    "clear of another's cell": 409, "clear of nothing": 404, "write to a snapshot": 403,
}


def _with_actions(spark: SparkSession, sf_dir: str, **actions: str) -> Catalog:
    c = base.catalog(spark, sf_dir)
    for t in c.model.tables():
        for f in t.fkeys:
            f.on_delete = actions.get(f.columns[0], "NO ACTION")
    return c


def fkey_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers go, with their orders and the lines of these."""
    c = _with_actions(spark, sf_dir, o_custkey="CASCADE", l_orderkey="CASCADE")
    c.delete("entity/customer/c_acctbal::lt::0")
    return c.query("attributegroup/lineitem/l_orderkey;n:=cnt(*)")


def fkey_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_actions(spark, sf_dir, l_suppkey="SET NULL")
    t = c.model.table("lineitem")
    t.keys = [Key(("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"), enforced=False)]
    t.columns["l_extendedprice"].nullok = False
    t.columns["l_suppkey"].nullok = True
    c.delete("entity/supplier/s_acctbal::lt::1000")
    return c.query("attributegroup/lineitem/l_suppkey;n:=cnt(*)")


def fkey_set_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _with_actions(spark, sf_dir, c_nationkey="SET DEFAULT", s_nationkey="SET DEFAULT")
    for name in ("customer", "supplier"):
        c.model.table(name).columns[f"{name[0]}_nationkey"].default = 0
    c.delete("entity/nation/n_nationkey::geq::20")
    return c.query("attribute/customer/c_custkey,c_nationkey")


def _renumbered(spark: SparkSession, sf_dir: str, **actions: str) -> Catalog:
    """Regions' and nations' keys change; what refers to them follows as it is told to."""
    c = base.catalog(spark, sf_dir)
    for t in c.model.tables():
        for f in t.fkeys:
            f.on_update = actions.get(f.columns[0], "NO ACTION")
    c.model.table("nation").columns["n_regionkey"].nullok = True
    new = base.rows(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") + 100).alias("to")).where("n_nationkey % 3 = 0")
    c.update("attributegroup/nation/n_nationkey;to:=n_nationkey", new)
    return c


def fkey_update_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _renumbered(spark, sf_dir, c_nationkey="CASCADE", s_nationkey="SET NULL")
    return c.query("attribute/customer/c_custkey,c_nationkey").unionAll(c.query("attribute/supplier/s_suppkey,s_nationkey"))


def change_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listeners hear of a run of writes."""
    c = _with_actions(spark, sf_dir, n_regionkey="CASCADE", c_nationkey="CASCADE", s_nationkey="CASCADE", o_custkey="CASCADE", l_orderkey="CASCADE", l_suppkey="CASCADE")
    seen: list[tuple] = []
    c.listeners.append(lambda w: seen.append((len(seen), ":".join(w.table), w.kind)))
    c.insert("entity/region", spark.createDataFrame([(9, "NEW")], "r_regionkey int, r_name string"))
    c.upsert("entity/region", spark.createDataFrame([(9, "NEWER")], "r_regionkey int, r_name string"))
    c.update("attributegroup/region/r_regionkey;r_name", spark.createDataFrame([(9, "NEWEST")], "r_regionkey int, r_name string"))
    c.delete("attribute/region/r_regionkey=9/r_name")
    c.delete("entity/region/r_regionkey=9")
    return spark.createDataFrame(seen, "n int, `table` string, kind string")


# rights

_RIGHTS = ["owner", "create", "enumerate", "select", "insert", "update", "delete", "write"]
_ENOUGH = {"enumerate": "select insert update delete write create owner", "select": "update delete write owner", "insert": "write owner", "update": "write owner", "delete": "write owner", "write": "owner", "create": "owner", "owner": ""}


def right_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which right is enough for which."""
    found = [(g, r, authz.allowed({g: ["me"]}, r, {"me"}) is True) for g in _RIGHTS for r in _RIGHTS]
    return spark.createDataFrame(found, "granted string, asked string, enough boolean")


def static_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions over column, table, schema and catalog: the nearest that speaks of the right counts, but for owners; bindings leave it open."""
    c = base.catalog(spark, sf_dir)
    m, t = c.model, c.model.table("customer")
    col, nowhere = t.columns["c_acctbal"], {"select": []}
    binding = {"types": ["select"], "projection": "c_mktsegment", "projection_type": "acl", "scope_acl": ["scoped"]}
    cases = [
        ("inherited from the catalog", {}, {}, {}, {}, "select", {"me", "*"}), ("table shuts", nowhere, {}, {}, {}, "select", {"me", "*"}), ("schema shuts", {}, nowhere, {}, {}, "select", {"me", "*"}), ("table opens what the schema shuts", {"select": ["me"]}, nowhere, {}, {}, "select", {"me", "*"}),
        ("column shuts", {}, {}, nowhere, {}, "select", {"me", "*"}), ("owner of the table owns a shut column", {"owner": ["me"]}, {}, nowhere, {}, "select", {"me", "*"}), ("binding in scope", nowhere, {}, {}, {"b": binding}, "select", {"me", "*", "scoped"}), ("binding out of scope", nowhere, {}, {}, {"b": binding}, "select", {"me", "*"}),
        ("binding of another right", {"update": []}, {}, {}, {"b": binding}, "update", {"me", "*", "scoped"}), ("anonymous reads", {}, {}, {}, {}, "select", {"*"}), ("anonymous doesn't write", {}, {}, {}, {}, "insert", {"*"}), ("update is enough to read", {"select": [], "update": ["me"]}, {}, {}, {}, "select", {"me", "*"}),
    ]
    out = []
    for name, table, schema, column, bindings, right, roles in cases:
        t.acls, m.schemas["public"].acls, col.acls, t.acl_bindings = table, schema, column, bindings
        out.append((name, str(authz.static(m, t, right, roles, col if column else None))))
    return spark.createDataFrame(out, "situation string, decision string")


_DECISIONS = [("inherited from the catalog", "True"), ("table shuts", "False"), ("schema shuts", "False"), ("table opens what the schema shuts", "True"), ("column shuts", "False"), ("owner of the table owns a shut column", "True"), ("binding in scope", "None"), ("binding out of scope", "False"), ("binding of another right", "False"), ("anonymous reads", "True"), ("anonymous doesn't write", "False"), ("update is enough to read", "True")]


def anonymous_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymous clients read; each of the five writes is refused."""
    c, nobody = base.catalog(spark, sf_dir), Client()
    row = spark.createDataFrame([(90, "x")], "r_regionkey int, r_name string")
    return statuses(spark, {
        "read": lambda: c.query("entity/region", client=nobody), "insert": lambda: c.insert("entity/region", row, client=nobody), "upsert": lambda: c.upsert("entity/region", row, client=nobody), "update": lambda: c.update("attributegroup/region/r_regionkey;r_name", row, client=nobody),
        "delete": lambda: c.delete("entity/region/r_regionkey=1", client=nobody), "clear": lambda: c.delete("attribute/region/r_name", client=nobody), "insert by a named client": lambda: c.insert("entity/region", row, client=ME),
    })


def acl_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two bindings, one is for other roles: it opens nothing."""
    c = base.catalog(spark, sf_dir)
    t = c.model.table("customer")
    t.acls = {"select": []}
    t.acl_bindings = {"mine": {"types": ["select"], "projection": "c_mktsegment", "projection_type": "acl", "scope_acl": ["staff"]}, "other": {"types": ["select"], "projection": "c_custkey", "projection_type": "nonnull", "scope_acl": ["admins"]}, "write": {"types": ["insert"], "projection": "c_custkey", "projection_type": "nonnull"}}
    return c.query("entity/customer", client=Client("me", frozenset({"staff", "FURNITURE"})))


def acl_nonnull(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a grade."""
    c = base.catalog(spark, sf_dir)
    c.model.table("labels").fkeys[0].name = ("public", "labels_doc")
    t = c.model.table("documents")
    t.acls = {"select": []}
    t.acl_bindings = {"graded": {"types": ["select"], "projection": [{"inbound": ["public", "labels_doc"]}, "quality"], "projection_type": "nonnull"}}
    return c.query("attribute/documents/doc_id,lang", client=ME)


def acl_single_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binding on the row alone, with filters."""
    c = base.catalog(spark, sf_dir)
    t = c.model.table("orders")
    t.acls = {"select": []}
    t.acl_bindings = {"some": {"types": ["select"], "projection": [{"or": [{"filter": "o_totalprice", "operator": "::gt::", "operand": "450000"}, {"filter": "o_orderstatus", "operand": "P", "negate": True}]}, {"filter": "o_orderpriority", "operator": "::regexp::", "operand": "^[12]"}, "o_custkey"], "projection_type": "nonnull"}}
    return c.query("entity/orders", client=ME)


def column_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column stricter than its table isn't seen at all; * and free text leave it out."""
    c = base.catalog(spark, sf_dir)
    c.model.table("customer").columns["c_name"].acls = {"select": [], "enumerate": []}
    return c.query("attribute/customer/*::regexp::Customer%7CBUILD/*", client=ME)


def write_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows may be written where a binding allows it; a write that touches others changes nothing."""
    c = base.catalog(spark, sf_dir)
    t = c.model.table("customer")
    t.acls = {"update": [], "insert": [], "delete": ["admin"]}
    t.acl_bindings = {"own": {"types": ["update"], "projection": "c_mktsegment", "projection_type": "acl"}}
    t.columns["c_name"].acls = {"update": []}
    me, new = Client("me", frozenset({"BUILDING"})), spark.createDataFrame([("BUILDING", -5.0)], "c_mktsegment string, c_acctbal double")
    c.update("attributegroup/customer/c_mktsegment;c_acctbal", new, client=me)
    for act in (lambda: c.delete("attribute/customer/c_mktsegment=MACHINERY/c_acctbal", client=me), lambda: c.delete("entity/customer/c_custkey=1", client=me), lambda: c.update("attributegroup/customer/c_mktsegment;c_acctbal", spark.createDataFrame([("BUILDING", 1.0), ("FURNITURE", 2.0)], new.schema), client=me)):
        if statuses(spark, {"": act}).first().status != 403:
            raise AssertionError("a write that isn't allowed went through")
    return c.query("entity/customer")


# models


def model_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model as rows."""
    found = [(t.name, c.name, c.type.declared) for t in base.catalog(spark, sf_dir).model.tables() for c in t.columns.values()]
    return spark.createDataFrame(found, "`table` string, `column` string, type string")


def model_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables, keys and links of a model document that was loaded into another catalog; foreign keys may come before their tables."""
    doc = base.catalog(spark, sf_dir).model.document()
    tables = doc["schemas"]["public"]["tables"]
    doc["schemas"]["public"]["tables"] = dict(reversed(tables.items()))
    again = Catalog(spark)
    again.create(doc)
    found = [(t.name, len(t.columns), ",".join(t.primary()), ";".join(sorted(f.target[1] for f in t.fkeys)), again.rows[t.id].count()) for t in again.model.tables()]
    return spark.createDataFrame(found, "`table` string, columns int, key string, targets string, n long")


_LINKS = [("region", 2, "r_regionkey", "", 0), ("nation", 3, "n_nationkey", "region", 0), ("customer", 5, "c_custkey", "nation", 0), ("supplier", 4, "s_suppkey", "nation", 0), ("part", 6, "p_partkey", "", 0), ("orders", 6, "o_orderkey", "customer", 0), ("lineitem", 11, "l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate", "orders;part;supplier", 0), ("events", 6, "event_id", "", 0), ("documents", 5, "doc_id", "", 0), ("labels", 3, "doc_id", "documents", 0), ("conversations", 4, "conv_id,turn", "", 0)]


def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas come and go; a table moves to another and is found by its new name, links and all."""
    c = base.catalog(spark, sf_dir)
    c.model.create_schema("empty")
    c.model.drop_schema("empty")
    c.model.create_schema("sales")
    t = c.model.table("customer")
    c.alter_table(t, name="buyer", schema="sales")
    c.create({"schema_name": "extra", "tables": {"a": {"table_name": "a", "column_definitions": [_column("id", "int4", False)], "keys": [{"unique_columns": ["id"]}]}}})
    c.drop_table(c.model.table("extra", "a"))
    return c.query("attributegroup/nation/B:=sales:buyer/nation:n_name,schema:=B:c_mktsegment;n:=cnt(B:c_custkey)")


def column_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added with a default, one renamed, one cast, one dropped."""
    c = base.catalog(spark, sf_dir)
    t = c.model.table("customer")
    c.add_column(t, Column("rating", Type.of("int4"), default=3))
    c.alter_column(t, "c_nationkey", new_name="nation")
    c.alter_column(t, "c_custkey", type=Type.of("text"))
    c.drop_column(t, "c_name")
    return c.query("entity/customer/rating=3")


def model_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.catalog(spark, sf_dir)
    m, nation, customer = c.model, c.model.table("nation"), c.model.table("customer")
    return statuses(spark, {
        "schema that exists": lambda: m.create_schema("public"), "drop of a schema in use": lambda: m.drop_schema("public"), "drop of no schema": lambda: m.drop_schema("none"), "table that exists": lambda: m.add_table(Table("public", "nation")), "name of 64 bytes": lambda: m.add_table(Table("public", "x" * 64)),
        "drop of a table in use": lambda: c.drop_table(nation), "column that exists": lambda: c.add_column(nation, Column("n_name", Type("text"))), "needed column without a default": lambda: c.add_column(nation, Column("y", Type("text"), False)), "unknown type": lambda: Type.of("blob"), "drop of a column in use": lambda: c.drop_column(nation, "n_nationkey"),
        "key that rows don't have": lambda: c.add_key(customer, Key(("c_mktsegment",))), "pseudo-key": lambda: c.add_key(customer, Key(("c_mktsegment",), enforced=False)), "key that exists": lambda: c.add_key(customer, Key(("c_custkey",))), "key of rows": lambda: c.add_key(customer, Key(("c_name",))), "drop of a key": lambda: c.drop_key(customer, ("c_name",)), "drop of no key": lambda: c.drop_key(customer, ("c_name",)), "drop of a key in use": lambda: c.drop_key(nation, ("n_nationkey",)),
        "foreign key to no key": lambda: c.add_fkey(customer, ForeignKey(("c_nationkey",), nation.id, ("n_regionkey",))), "foreign key that rows break": lambda: c.add_fkey(nation, ForeignKey(("n_nationkey",), m.table("region").id, ("r_regionkey",))), "pseudo foreign key": lambda: c.add_fkey(nation, ForeignKey(("n_nationkey",), m.table("region").id, ("r_regionkey",), enforced=False)),
        "action of a foreign key": lambda: c.alter_fkey(customer, ("c_nationkey",), on_delete="CASCADE"), "unknown action": lambda: c.alter_fkey(customer, ("c_nationkey",), on_delete="EXPLODE"), "drop of a foreign key": lambda: c.drop_fkey(customer, ("c_nationkey",)), "drop of no foreign key": lambda: c.drop_fkey(customer, ("c_nationkey",)), "link that was dropped": lambda: c.query("entity/nation/customer"),
        "unknown right": lambda: c.describe(nation, acls={"fly": ["*"]}), "tables without system columns": lambda: Catalog(spark, require_primary_keys=True).create({"table_name": "t", "column_definitions": [_column("id", "int8", False)], "keys": []}),
    })


_MODEL = {
    "schema that exists": 409, "drop of a schema in use": 409, "drop of no schema": 404, "table that exists": 409, "name of 64 bytes": 400, "drop of a table in use": 409, "column that exists": 409, "needed column without a default": 409, "unknown type": 400, "drop of a column in use": 409,
    "key that rows don't have": 409, "pseudo-key": 200, "key that exists": 409, "key of rows": 200, "drop of a key": 200, "drop of no key": 404, "drop of a key in use": 409, "foreign key to no key": 409, "foreign key that rows break": 409, "pseudo foreign key": 200,
    "action of a foreign key": 200, "unknown action": 400, "drop of a foreign key": 200, "drop of no foreign key": 404, "link that was dropped": 409, "unknown right": 400, "tables without system columns": 409,
}


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, annotations, ACLs and bindings, set, replaced and taken away."""
    c = base.catalog(spark, sf_dir)
    t = c.model.table("nation")
    c.describe(t, comment="first", annotations={"tag:a": {"x": 1}, "tag:b": 2}, acls={"select": ["staff"], "update": []}, bindings={"own": {"types": ["update"], "projection": "n_name"}})
    c.describe(t, comment="second", annotations={"tag:a": None, "tag:c": [3]}, acls={"update": None}, bindings={"own": None})
    c.describe(t.columns["n_name"], comment="name")
    return spark.createDataFrame([("comment", t.comment), ("annotations", str(t.annotations)), ("acls", str(t.acls)), ("bindings", str(t.acl_bindings)), ("column", t.columns["n_name"].comment)], "part string, value string")


def catalog_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.catalog(spark, sf_dir)
    c.model.acls |= {"owner": ["root", "admin"], "create": []}
    return c.meta()


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogs by number and by alias, cloned from another by name, unregistered; a path that names its catalog."""
    r = Registry()
    first = r.create(spark)
    first.register("nation", base.rows(spark, sf_dir, "nation"), ("n_nationkey",))
    r.create(spark, "7", clone_source="1")
    r.alias("main", "1")
    got = statuses(spark, {"id that exists": lambda: r.create(spark, "7"), "alias of none": lambda: r.alias("x", "99"), "alias like a catalog": lambda: r.alias("7", "1"), "found by alias": lambda: r.get("main"), "deleted": lambda: r.delete("7"), "gone": lambda: r.get("7"), "path without a catalog": lambda: r.query("entity/nation")})
    found = r.query("catalog/main/aggregate/nation/n:=cnt(*)").select(F.lit("rows").alias("request"), F.col("n").cast("int").alias("status"))
    return got.unionAll(found).unionAll(spark.createDataFrame([("source " + r.origins["7"], 0)], "request string, status int"))


def reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog in a folder, written to, vacuumed, opened again, written to again: rows, model, identifiers and history go on."""
    root = shared_folder(spark)
    c = notes(spark, sf_dir, 300, root=root)
    then = c.changes[-1]
    c.delete("entity/notes/size::gt::40", client=ME)
    c.vacuum()
    again = Catalog(spark, root=root, clock=lambda: START + timedelta(days=1))
    again.insert("entity/notes", base.rows(spark, sf_dir, "part").where("p_partkey >= 300 AND p_partkey < 400").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size")), client=ME)
    last = Catalog(spark, root=root)
    return last.query("attribute/notes/id,kind,size").select("*", F.lit(last.query("aggregate/notes/n:=cnt_d(RID)").first().n).alias("codes"), F.lit(last.query(f"catalog/1@{moment_code(then)}/aggregate/notes/n:=cnt(*)").first().n).alias("then"))


# history


def customers(spark: SparkSession, sf_dir: str) -> tuple[Catalog, list[datetime]]:
    """Customers with history: as registered, after an update, after a delete."""
    c = Catalog(spark, clock=ticking())
    t = c.register("customer", base.rows(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), ("c_custkey",), history=True)
    moments = [c.changes[-1]]
    c.update("attributegroup/customer/c_mktsegment;c_acctbal", spark.createDataFrame([("BUILDING", 0.0), ("MACHINERY", 1.0)], "c_mktsegment string, c_acctbal double"))
    moments.append(c.changes[-1])
    c.delete("entity/customer/c_acctbal::lt::0")
    moments.append(c.changes[-1])
    assert t.history
    return c, moments


def _at(spark: SparkSession, sf_dir: str, k: int, late: timedelta) -> DataFrame:
    c, moments = customers(spark, sf_dir)
    return c.query(f"catalog/1@{moment_code(moments[k] + late)}/entity/customer")


def snapshot_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _at(spark, sf_dir, 0, timedelta())


def snapshot_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moment between two changes: the earlier one counts."""
    return _at(spark, sf_dir, 1, timedelta(milliseconds=1))


def history_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of the rows, with the numbers of the changes that began and ended them."""
    c, moments = customers(spark, sf_dir)
    number = lambda col: F.coalesce(*(F.when(F.col(col) == F.lit(m).cast("timestamp"), F.lit(k)) for k, m in enumerate(moments)))
    return c.past["public", "customer"].select("c_custkey", "c_acctbal", "c_mktsegment", number(history.FROM).alias("begun"), number(history.TO).alias("ended"))


def history_same_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two changes at one moment leave one version."""
    c, _ = customers(spark, sf_dir)
    fixed = c.clock()
    c.clock = lambda: fixed
    for value in (7.0, 8.0):
        c.update("attributegroup/customer/c_mktsegment;c_acctbal", spark.createDataFrame([("BUILDING", value)], "c_mktsegment string, c_acctbal double"))
    return c.past["public", "customer"].where("c_mktsegment = 'BUILDING'").groupBy("c_acctbal", F.col(history.TO).isNull().alias("open")).agg(F.count(F.lit(1)).alias("n")).where("c_acctbal IN (7.0, 8.0)")


def history_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that had ended by the second change are dropped."""
    c, moments = customers(spark, sf_dir)
    c.truncate_history(moments[1])
    first, last = c.history_range()
    early = statuses(spark, {"": lambda: c.query(f"catalog/1@{moment_code(moments[0])}/entity/customer")}).first().status
    return c.past["public", "customer"].agg(F.count(F.lit(1)).alias("versions")).select("versions", F.lit(first == moments[1]).alias("begins"), F.lit(last == moments[2]).alias("ends"), F.lit(early).alias("earlier"))


def history_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances of a segment taken out of the versions that lie before the second change."""
    c, moments = customers(spark, sf_dir)
    c.redact_history(c.model.table("customer"), "c_acctbal", end=moments[1], only="c_mktsegment=BUILDING")
    return c.query(f"catalog/1@{moment_code(moments[0])}/entity/customer")


def history_amended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A right that is taken away for an interval of the past: rows seen before, in and after it."""
    c, moments = customers(spark, sf_dir)
    c.amend_models(lambda m: m.table("customer").acls.update({"select": []}), moments[1], moments[2])
    n = [c.query(f"catalog/1@{moment_code(m)}/aggregate/customer/n:=cnt(*)").first().n for m in moments]
    return spark.createDataFrame(list(enumerate(n)), "moment int, n long")


def history_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, moments = customers(spark, sf_dir)
    at = lambda t: f"catalog/1@{moment_code(t)}/entity/customer"
    row = spark.createDataFrame([(99999, 1.0, "X")], "c_custkey long, c_acctbal double, c_mktsegment string")
    return statuses(spark, {"too early": lambda: c.query(at(START - timedelta(days=1))), "in time": lambda: c.query(at(moments[0])), "not a time": lambda: c.query("catalog/1@autumn/entity/customer"), "insert": lambda: c.insert(at(moments[0]), row), "update": lambda: c.update(at(moments[0]).replace("entity", "attributegroup") + "/c_custkey;c_acctbal", row), "delete": lambda: c.delete(at(moments[0])), "redaction of a key": lambda: c.redact_history(c.model.table("customer"), "c_custkey")})


def history_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that keeps no history: its present is there, its past is refused."""
    c = Catalog(spark, clock=ticking())
    c.register("nation", base.rows(spark, sf_dir, "nation"), ("n_nationkey",))
    then = c.changes[-1]
    c.delete("entity/nation/n_regionkey=0")
    past = statuses(spark, {"past": lambda: c.query(f"catalog/1@{moment_code(then)}/entity/nation")}).first().status
    return c.query("attribute/nation/n_nationkey").select("n_nationkey", F.lit(past).alias("past"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write brought and took, with a column hidden."""
    c, moments = customers(spark, sf_dir)
    return c.audit(c.model.table("customer"), moments[1], hide=("c_mktsegment",))


def rid_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where identifiers are, those of deleted rows too."""
    c = notes(spark, sf_dir, 20)
    ids = {r.id: r.RID for r in c.query("entity/notes").collect()}
    c.delete("entity/notes/id::geq::10", client=ME)
    found = [(k, *(lambda r: (r.table, r.deleted_at is not None) if r else (None, None))(c.entity_rid(code).first())) for k, code in ids.items()]
    unknown = c.entity_rid("ZZZ-ZZZZ").first()
    return spark.createDataFrame([*found, (-1, unknown and unknown.table, None)], "id long, `table` string, deleted boolean")


_SEGMENT = "CASE c_mktsegment WHEN 'BUILDING' THEN 0.0 WHEN 'MACHINERY' THEN 1.0 ELSE c_acctbal END"
_FINE = [("id that exists", 409), ("alias of none", 409), ("alias like a catalog", 409), ("found by alias", 200), ("deleted", 200), ("gone", 404), ("path without a catalog", 400), ("rows", 25), ("source 1", 0)]

OTHERS: dict[str, tuple[Query, str]] = {
    "insert_defaults": (insert_defaults, f"SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 1 THEN p_type ELSE 'none' END AS kind, p_size AS size, CASE WHEN p_partkey % 2 = 1 THEN {code_sql('(p_partkey + 5000)')} END AS given FROM part"),
    "insert_returning": (insert_returning, "SELECT p_partkey AS id, 'none' AS kind, p_size AS size, true AS new, 'me' AS RCB, true AS named FROM part"),
    "system_columns": (system_columns, "SELECT p_partkey AS id, CASE WHEN p_type = 'ECONOMY' THEN -1 ELSE p_size END AS size, 'me' AS RCB, CASE WHEN p_type = 'ECONOMY' THEN 'you' ELSE 'me' END AS RMB, p_type = 'ECONOMY' AS changed FROM part WHERE p_partkey < 500"),
    "rid_defaults": (rid_defaults, "SELECT true AS own, count(*) AS n, count(*) AS different FROM part WHERE p_partkey < 500"),
    "lease_statuses": (lease_statuses, status_sql({"leased": 200, "leased by another": 403, "not leased": 403, "used before": 409})),
    "write_statuses": (write_statuses, status_sql(_WRITES)),
    "fkey_cascade": (fkey_cascade, "SELECT l_orderkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_acctbal >= 0 GROUP BY l_orderkey"),
    "fkey_set_null": (fkey_set_null, "SELECT CASE WHEN s_acctbal >= 1000 THEN l_suppkey END AS l_suppkey, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"),
    "fkey_set_default": (fkey_set_default, "SELECT c_custkey, CASE WHEN c_nationkey >= 20 THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer"),
    "fkey_update_cascade": (fkey_update_cascade, "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS c_nationkey FROM customer UNION ALL SELECT s_suppkey, CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey END FROM supplier"),
    "change_notices": (change_notices, values_sql('n, "table", kind', [(0, "public:region", "insert"), (1, "public:region", "upsert"), (2, "public:region", "update"), (3, "public:region", "clear"), (4, "public:region", "delete")])),
    "right_lattice": (right_lattice, values_sql("granted, asked, enough", [(g, r, g == r or g in _ENOUGH[r].split()) for g in _RIGHTS for r in _RIGHTS])),
    "static_decisions": (static_decisions, values_sql("situation, decision", _DECISIONS)),
    "anonymous_statuses": (anonymous_statuses, status_sql({"read": 200, "insert": 403, "upsert": 403, "update": 403, "delete": 403, "clear": 403, "insert by a named client": 200})),
    "acl_scope": (acl_scope, "SELECT * FROM customer WHERE c_mktsegment = 'FURNITURE'"),
    "acl_nonnull": (acl_nonnull, "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"),
    "acl_single_table": (acl_single_table, "SELECT * FROM orders WHERE (o_totalprice > 450000 OR NOT o_orderstatus = 'P') AND regexp_matches(o_orderpriority, '^[12]') AND o_custkey IS NOT NULL"),
    "column_hidden": (column_hidden, "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment LIKE '%BUILD%'"),
    "write_rights": (write_rights, "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN -5.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"),
    "model_columns": (model_columns, f"SELECT table_name AS \"table\", column_name AS \"column\", CASE data_type WHEN 'BIGINT' THEN 'int8' WHEN 'INTEGER' THEN 'int4' WHEN 'DOUBLE' THEN 'float8' WHEN 'VARCHAR' THEN 'text' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE data_type END AS type FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in base.TABLES)})"),
    "model_document": (model_document, values_sql('"table", columns, key, targets, n', _LINKS)),
    "schema_changes": (schema_changes, "SELECT n_name, c_mktsegment AS schema, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL"),
    "column_changes": (column_changes, "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_nationkey AS nation, c_acctbal, c_mktsegment, 3 AS rating FROM customer"),
    "model_statuses": (model_statuses, status_sql(_MODEL)),
    "descriptions": (descriptions, values_sql("part, value", [("comment", "second"), ("annotations", "{'tag:b': 2, 'tag:c': [3]}"), ("acls", "{'select': ['staff']}"), ("bindings", "{}"), ("column", "name")])),
    "catalog_meta": (catalog_meta, values_sql("key, value", [("owner", "root"), ("owner", "admin"), *((r, "*") for r in ("enumerate", "select", "insert", "update", "delete", "write"))])),
    "registry": (registry, status_sql(dict(_FINE))),
    "reopened": (reopened, "WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey < 300 THEN p_type ELSE 'none' END AS kind, p_size AS size FROM part WHERE p_partkey < 400 AND (p_partkey >= 300 OR p_size <= 40)) SELECT p.*, (SELECT count(*) FROM p) AS codes, 300::BIGINT AS \"then\" FROM p"),
    "snapshot_first": (snapshot_first, "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer"),
    "snapshot_clamped": (snapshot_clamped, f"SELECT c_custkey, {_SEGMENT} AS c_acctbal, c_mktsegment FROM customer"),
    "history_versions": (history_versions, f"WITH v AS (SELECT c_custkey, c_mktsegment, c_acctbal AS old, {_SEGMENT} AS new FROM customer) SELECT c_custkey, old AS c_acctbal, c_mktsegment, 0 AS begun, CASE WHEN old <> new THEN 1 WHEN new < 0 THEN 2 END AS ended FROM v UNION ALL SELECT c_custkey, new, c_mktsegment, 1, CASE WHEN new < 0 THEN 2 END FROM v WHERE old <> new"),
    "history_same_moment": (history_same_moment, "SELECT 8.0::DOUBLE AS c_acctbal, true AS open, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "history_truncated": (history_truncated, "SELECT count(*) AS versions, true AS begins, true AS ends, 409 AS earlier FROM customer"),
    "history_redacted": (history_redacted, "SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' OR c_acctbal = 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer"),
    "history_amended": (history_amended, f"SELECT 0 AS moment, count(*) AS n FROM customer UNION ALL SELECT 1, 0 UNION ALL SELECT 2, count(*) FROM customer WHERE {_SEGMENT} >= 0"),
    "history_statuses": (history_statuses, status_sql({"too early": 409, "in time": 200, "not a time": 400, "insert": 403, "update": 403, "delete": 403, "redaction of a key": 409})),
    "history_disabled": (history_disabled, "SELECT n_nationkey, 409 AS past FROM nation WHERE n_regionkey <> 0"),
    "audit_log": (audit_log, f"WITH v AS (SELECT c_custkey, c_acctbal AS old, {_SEGMENT} AS new FROM customer) SELECT '-' AS change, c_custkey, old AS c_acctbal FROM v WHERE old <> new UNION ALL SELECT '+', c_custkey, new FROM v WHERE old <> new"),
    "rid_resolution": (rid_resolution, "SELECT p_partkey AS id, 'notes' AS \"table\", p_partkey >= 10 AS deleted FROM part WHERE p_partkey < 20 UNION ALL SELECT -1, NULL, NULL"),
}


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in OTHERS.items()}
