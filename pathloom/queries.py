"""Queries over the tables of a folder, and the same in DuckDB's SQL; more of them are in queries_read and queries_write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.catalog import Catalog, Client
from pathloom.functions import rid
from pathloom.operators import history

TABLES: dict[str, tuple] = {
    "region": (("r_regionkey",), []),
    "nation": (("n_nationkey",), [(("n_regionkey",), "region", ("r_regionkey",))]),
    "customer": (("c_custkey",), [(("c_nationkey",), "nation", ("n_nationkey",))]),
    "supplier": (("s_suppkey",), [(("s_nationkey",), "nation", ("n_nationkey",))]),
    "part": (("p_partkey",), []),
    "orders": (("o_orderkey",), [(("o_custkey",), "customer", ("c_custkey",))]),
    "lineitem": (("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), [(("l_orderkey",), "orders", ("o_orderkey",)), (("l_partkey",), "part", ("p_partkey",)), (("l_suppkey",), "supplier", ("s_suppkey",))]),
    "events": (("event_id",), []),
    "documents": (("doc_id",), []),
    "labels": (("doc_id",), [(("doc_id",), "documents", ("doc_id",))]),
    "conversations": (("conv_id", "turn"), []),
}


#: The tables' columns, declared so that opening a catalog reads no file.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The folder's tables with their keys and foreign keys."""
    c = Catalog(spark)
    for name, (key, fkeys) in TABLES.items():
        c.register(name, rows(spark, sf_dir, name), key, fkeys)
    return c


#: name: (path, SQL)
PATHS: dict[str, tuple[str, str]] = {
    "entity_filter": ("entity/customer/c_acctbal::gt::9000", "SELECT * FROM customer WHERE c_acctbal > 9000"),
    "entity_fk_link": ("entity/region/r_name=ASIA/nation/customer", "SELECT c.* FROM customer c JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'"),
    "entity_dedupe": ("entity/A:=orders/lineitem/l_quantity::gt::49/$A", "SELECT DISTINCT o.* FROM orders o JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 49"),
    "entity_endpoint_link": ("entity/nation/n_name::regexp::%5B2-4%5D%24/(n_nationkey)=(supplier:s_nationkey)", "SELECT s.* FROM supplier s JOIN nation ON s_nationkey = n_nationkey WHERE regexp_matches(n_name, '[2-4]$')"),
    "entity_column_link": ("entity/orders/o_totalprice::gt::400000/(o_custkey)", "SELECT DISTINCT c.* FROM customer c JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 400000"),
    "entity_branches": ("entity/A:=customer/c_mktsegment=BUILDING/orders/o_orderpriority=1-URGENT/$A/nation/n_name=NATION_5/$A", "SELECT DISTINCT c.* FROM customer c JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' AND n_name = 'NATION_5'"),
    "attr_alias_star": ("attribute/A:=nation/B:=region/$A/A:*,region_name:=B:r_name", "SELECT n_nationkey AS \"A:n_nationkey\", n_name AS \"A:n_name\", n_regionkey AS \"A:n_regionkey\", r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "attr_rename": ("attribute/customer/c_acctbal::lt::0/key:=c_custkey,balance:=c_acctbal", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer WHERE c_acctbal < 0"),
    "attr_other_table": ("attribute/A:=customer/orders/$A/c_custkey,least:=orders:o_orderstatus", "SELECT c_custkey, min(o_orderstatus) AS least FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"),
    "left_outer_count": ("aggregate/A:=documents/left(doc_id)=(labels:doc_id)/c:=cnt(*),d:=cnt_d(doc_id),a:=cnt_d(A:doc_id)", "SELECT count(*) AS c, count(DISTINCT l.doc_id) AS d, count(DISTINCT a.doc_id) AS a FROM documents a LEFT JOIN labels l USING (doc_id)"),
    "right_outer_count": ("aggregate/A:=labels/right(doc_id)=(documents:doc_id)/c:=cnt(*),d:=cnt_d(doc_id),a:=cnt_d(A:doc_id)", "SELECT count(*) AS c, count(DISTINCT d.doc_id) AS d, count(DISTINCT l.doc_id) AS a FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id"),
    "full_outer_count": ("aggregate/A:=orders/full(o_orderkey)=(lineitem:l_orderkey)/c:=cnt(*),d:=cnt_d(l_orderkey),a:=cnt_d(A:o_orderkey)", "SELECT count(*) AS c, count(DISTINCT l_orderkey) AS d, count(DISTINCT o_orderkey) AS a FROM orders FULL JOIN lineitem ON l_orderkey = o_orderkey"),
    "outer_is_null": ("entity/A:=orders/left(o_orderkey)=(lineitem:l_orderkey)/l_orderkey::null::/$A", "SELECT o.* FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL"),
    "filter_quantified": ("entity/orders/o_orderpriority=any(1-URGENT,2-HIGH)", "SELECT * FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "filter_all": ("entity/part/p_name::ciregexp::all(blue,widget)", "SELECT * FROM part WHERE regexp_matches(p_name, '(?i)blue') AND regexp_matches(p_name, '(?i)widget')"),
    "filter_dnf_neg": ("entity/part/(p_size::lt::5;p_size::gt::45)&!p_brand=Brand%2317", "SELECT * FROM part WHERE (p_size < 5 OR p_size > 45) AND NOT p_brand = 'Brand#17'"),
    "filter_range": ("entity/lineitem/l_shipdate::geq::1997-01-01/l_shipdate::leq::1997-03-31/l_discount::geq::0.05", "SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate <= TIMESTAMP '1997-03-31' AND l_discount >= 0.05"),
    "filter_regexp": ("entity/part/p_name::regexp::%5Eblue", "SELECT * FROM part WHERE regexp_matches(p_name, '^blue')"),
    "filter_ciregexp": ("entity/part/p_type::ciregexp::economy", "SELECT * FROM part WHERE regexp_matches(p_type, '(?i)economy')"),
    "filter_star_regexp": ("entity/nation/*::ciregexp::nation_1%7C%5E2", "SELECT * FROM nation WHERE regexp_matches(CAST(n_nationkey AS VARCHAR), '(?i)nation_1|^2') OR regexp_matches(n_name, '(?i)nation_1|^2') OR regexp_matches(CAST(n_regionkey AS VARCHAR), '(?i)nation_1|^2')"),
    "agg_all": (
        "aggregate/lineitem/n:=cnt(*),c:=cnt(l_partkey),d:=cnt_d(l_suppkey),lo:=min(l_shipdate),hi:=max(l_extendedprice),mean:=avg(l_linenumber),total:=sum(l_linenumber),parts:=sum(l_partkey),flags:=array_d(l_returnflag)",
        "SELECT count(*) AS n, count(l_partkey) AS c, count(DISTINCT l_suppkey) AS d, min(l_shipdate) AS lo, max(l_extendedprice) AS hi, avg(l_linenumber) AS mean, CAST(sum(l_linenumber) AS BIGINT) AS total, CAST(sum(l_partkey) AS BIGINT) AS parts, list_sort(list_distinct(list(l_returnflag))) AS flags FROM lineitem",
    ),
    "group_segments": ("attributegroup/A:=orders/customer/c_mktsegment;n:=cnt(*),customers:=cnt_d(c_custkey),top:=max(A:o_totalprice)@sort(c_mktsegment)", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT c_custkey) AS customers, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"),
    "group_keys_only": ("attributegroup/lineitem/l_returnflag,l_linestatus", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "group_example": ("attributegroup/A:=customer/N:=nation/N:n_nationkey;N:n_name,n:=cnt(A:c_custkey)", "SELECT n_nationkey, any_value(n_name) AS n_name, count(c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey"),
    "group_deep": ("attributegroup/R:=region/nation/customer/O:=orders/R:r_name,O:o_orderstatus;n:=cnt(*),top:=max(O:o_totalprice)", "SELECT r_name, o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, o_orderstatus"),
    "array_agg": ("attributegroup/R:=region/nation/R:r_name;names:=array_d(n_name),n:=cnt(*)", "SELECT r_name, list_sort(list_distinct(list(n_name))) AS names, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name"),
    "sort_limit": ("attribute/orders/o_orderkey,o_totalprice@sort(o_totalprice::desc::,o_orderkey)?limit=50", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 50"),
    "sort_nulls": ("attribute/A:=documents/left(doc_id)=(labels:doc_id)/$A/doc_id,grade:=labels:quality@sort(grade::desc::,doc_id)?limit=700", "SELECT d.doc_id, quality AS grade FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS FIRST, d.doc_id LIMIT 700"),
    "page_after": ("attribute/orders/o_orderstatus,o_orderkey@sort(o_orderstatus,o_orderkey)@after(F,900)?limit=40", "SELECT o_orderstatus, o_orderkey FROM orders WHERE (o_orderstatus, o_orderkey) > ('F', 900) ORDER BY ALL LIMIT 40"),
    "page_after_desc": ("attribute/orders/o_orderstatus,o_orderkey@sort(o_orderstatus::desc::,o_orderkey)@after(O,900)?limit=40", "SELECT o_orderstatus, o_orderkey FROM orders WHERE o_orderstatus < 'O' OR (o_orderstatus = 'O' AND o_orderkey > 900) ORDER BY o_orderstatus DESC, o_orderkey LIMIT 40"),
    "page_before": ("attribute/orders/o_orderstatus,o_orderkey@sort(o_orderstatus,o_orderkey)@before(O,100)?limit=40", "SELECT o_orderstatus, o_orderkey FROM orders WHERE (o_orderstatus, o_orderkey) < ('O', 100) ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 40"),
    "page_between": ("attribute/orders/o_custkey,o_orderkey@sort(o_custkey,o_orderkey)@after(20,0)@before(30,0)", "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey > 20 OR (o_custkey = 20 AND o_orderkey > 0)) AND (o_custkey < 30 OR (o_custkey = 30 AND o_orderkey < 0))"),
    "page_aggregate": ("attributegroup/lineitem/l_suppkey;n:=cnt(*)@sort(n::desc::,l_suppkey)@after(600,3)?limit=20", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) < 600 OR (count(*) = 600 AND l_suppkey > 3) ORDER BY n DESC, l_suppkey LIMIT 20"),
}


def by_path(path: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: catalog(spark, sf_dir).query(path)


def group_bin_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalog(spark, sf_dir).query("attributegroup/lineitem/b:=bin(l_quantity;10;5;45);n:=cnt(*)")
    return df.select("b.bucket", "b.lower", "b.upper", "n")


def group_bin_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = catalog(spark, sf_dir).query("attributegroup/lineitem/b:=bin(l_shipdate;4;1994-01-01;1998-01-01);n:=cnt(*)")
    return df.select("b.bucket", F.unix_seconds("b.lower").alias("lower"), F.unix_seconds("b.upper").alias("upper"), "n")


def multi_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two foreign keys between the same tables: each match of either counts once."""
    c = Catalog(spark)
    nation = rows(spark, sf_dir, "nation")
    pair = rows(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_custkey", F.lit(25)).cast("int").alias("n1"), F.pmod("o_orderkey", F.lit(25)).cast("int").alias("n2"))
    c.register("nation", nation, ("n_nationkey",))
    c.register("trade", pair, ("o_orderkey",), [(("n1",), "nation", ("n_nationkey",)), (("n2",), "nation", ("n_nationkey",))])
    return c.query("attributegroup/nation/T:=trade/nation:n_name;n:=cnt(T:o_orderkey)")


def acl_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are seen by those whose role is their segment."""
    c = catalog(spark, sf_dir)
    t = c.model.table("customer")
    t.acls = {"select": []}
    t.acl_bindings = {"segment": {"types": ["select"], "projection": "c_mktsegment", "projection_type": "acl"}}
    return c.query("entity/customer/c_acctbal::gt::0", client=Client("someone", frozenset({"BUILDING", "MACHINERY"})))


def acl_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are seen by those whose role is the nation of their customer."""
    c = catalog(spark, sf_dir)
    for t in c.model.tables():
        for f in t.fkeys:
            f.name = ("public", f"{t.name}_{f.columns[0]}")
    t = c.model.table("orders")
    t.acls = {"select": []}
    t.acl_bindings = {"nation": {"types": ["select"], "projection": [{"outbound": ["public", "orders_o_custkey"]}, {"outbound": ["public", "customer_c_nationkey"]}, "n_name"], "projection_type": "acl"}}
    return c.query("entity/orders", client=Client("someone", frozenset({"NATION_5"})))


def cell_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances show in one segment alone, also to filters."""
    c = catalog(spark, sf_dir)
    t = c.model.table("customer")
    t.columns["c_acctbal"].acls = {"select": []}
    t.columns["c_acctbal"].acl_bindings = {"own": {"types": ["select"], "projection": "c_mktsegment", "projection_type": "acl"}}
    return c.query("entity/customer/c_acctbal::null::;c_acctbal::gt::5000", client=Client("someone", frozenset({"BUILDING"})))


def snapshot_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event type, kept as versions, as it was at a moment."""
    events = rows(spark, sf_dir, "events")
    last = events.groupBy("user_id", F.date_trunc("day", "ts").alias("valid_from")).agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e"))
    versions = last.select("user_id", "e.event_type", "valid_from", F.expr("lead(valid_from) OVER (PARTITION BY user_id ORDER BY valid_from)").alias("valid_to"))
    middle = events.agg(F.expr("timestamp_seconds(floor((unix_seconds(cast(min(ts) as timestamp)) + unix_seconds(cast(max(ts) as timestamp))) / 2))")).first()[0]
    return history.as_of(versions, middle)


def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New balances for some customers, and new customers."""
    c = catalog(spark, sf_dir)
    old = rows(spark, sf_dir, "customer")
    new = old.where("c_custkey % 7 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.concat(F.lit("new "), "c_name").alias("c_name"), "c_nationkey", F.lit(1.5).alias("c_acctbal"), "c_mktsegment")
    return c.upsert("entity/customer", new)


def group_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    new = spark.createDataFrame([("BUILDING", "TOWERS"), ("NOTHING", "X")], "old string, new string")
    return c.update("attributegroup/customer/old:=c_mktsegment;new:=c_mktsegment", new)


def delete_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.delete("entity/orders/o_totalprice::gt::300000/lineitem/l_quantity::gt::25")


def clear_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    return c.delete("attribute/nation/n_name=NATION_7/customer/c_acctbal,c_mktsegment")


def insert_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = catalog(spark, sf_dir)
    new = rows(spark, sf_dir, "part").where("p_partkey % 10 = 0").withColumn("p_partkey", F.col("p_partkey") * 3)
    c.insert("entity/part", new, onconflict="skip")
    return c.query("entity/part")


def textfacet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark)
    for name in ("region", "nation", "part"):
        c.register(name, rows(spark, sf_dir, name))
    return c.textfacet("asia|blue")


def rid_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = rows(spark, sf_dir, "orders").select("o_orderkey")
    coded = keys.withColumn("code", rid.encode(F.col("o_orderkey")))
    return coded.withColumn("back", rid.decode(F.lower("code")))


_CUSTOMER_UPSERT = """
WITH n AS (SELECT c_custkey * 2 AS c_custkey, 'new ' || c_name AS c_name, c_nationkey, 1.5::DOUBLE AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 7 = 0)
SELECT * FROM n UNION ALL SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)"""
_DIGITS = " || ".join(f"substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST((o_orderkey * 2 >> {5 * k}) & 31 AS INT) + 1, 1)" for k in range(7, -1, -1))

OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "group_bin_num": (group_bin_num, "WITH b AS (SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity >= 45 THEN 11 ELSE CAST(floor((l_quantity - 5) / 4) AS INT) + 1 END AS bucket FROM lineitem) SELECT bucket, CASE WHEN bucket = 0 THEN NULL ELSE 5 + 4.0 * (bucket - 1) END::DOUBLE AS lower, CASE WHEN bucket = 11 THEN NULL ELSE 5 + 4.0 * bucket END::DOUBLE AS upper, count(*) AS n FROM b GROUP BY bucket"),
    "group_bin_ts": (group_bin_ts, "WITH e AS (SELECT epoch(l_shipdate) AS x, epoch(TIMESTAMP '1994-01-01') AS a, epoch(TIMESTAMP '1998-01-01') AS z FROM lineitem), b AS (SELECT CASE WHEN x < a THEN 0 WHEN x >= z THEN 5 ELSE CAST(floor((x - a) / ((z - a) / 4)) AS INT) + 1 END AS bucket, a, (z - a) / 4 AS w FROM e) SELECT bucket, CASE WHEN bucket = 0 THEN NULL ELSE CAST(any_value(a) + any_value(w) * (bucket - 1) AS BIGINT) END AS lower, CASE WHEN bucket = 5 THEN NULL ELSE CAST(any_value(a) + any_value(w) * bucket AS BIGINT) END AS upper, count(*) AS n FROM b GROUP BY bucket"),
    "multi_edge": (multi_edge, "WITH t AS (SELECT o_orderkey, o_custkey % 25 AS n1, o_orderkey % 25 AS n2 FROM orders) SELECT n_name, count(o_orderkey) AS n FROM nation JOIN t ON n1 = n_nationkey OR n2 = n_nationkey GROUP BY n_name"),
    "acl_row_filter": (acl_row_filter, "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0"),
    "acl_path_filter": (acl_path_filter, "SELECT o.* FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_5'"),
    "cell_mask": (cell_mask, "SELECT * FROM (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer) WHERE c_acctbal IS NULL OR c_acctbal > 5000"),
    "snapshot_asof": (snapshot_asof, "WITH m AS (SELECT to_timestamp(floor((epoch(min(ts)) + epoch(max(ts))) / 2))::TIMESTAMP AS t FROM events), d AS (SELECT user_id, date_trunc('day', ts) AS f, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL), v AS (SELECT user_id, event_type, f, lead(f) OVER (PARTITION BY user_id ORDER BY f) AS u FROM d) SELECT user_id, event_type FROM v, m WHERE f <= t AND (u IS NULL OR t < u)"),
    "upsert": (upsert, _CUSTOMER_UPSERT),
    "group_update": (group_update, "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'TOWERS' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "delete_rows": (delete_rows, "SELECT * FROM lineitem l WHERE NOT (l_quantity > 25 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000))"),
    "clear_cells": (clear_cells, "SELECT c_custkey, c_name, c_nationkey, CASE WHEN n_name <> 'NATION_7' THEN c_acctbal END AS c_acctbal, CASE WHEN n_name <> 'NATION_7' THEN c_mktsegment END AS c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "insert_skip": (insert_skip, "SELECT * FROM part UNION ALL SELECT p_partkey * 3, p_name, p_brand, p_type, p_size, p_retailprice FROM part WHERE p_partkey % 10 = 0 AND p_partkey * 3 NOT IN (SELECT p_partkey FROM part)"),
    "textfacet": (textfacet, "SELECT 'public' AS schema, 'region' AS \"table\", 'r_name' AS \"column\" WHERE EXISTS (SELECT 1 FROM region WHERE regexp_matches(r_name, '(?i)asia|blue')) UNION ALL SELECT 'public', 'nation', 'n_name' WHERE EXISTS (SELECT 1 FROM nation WHERE regexp_matches(n_name, '(?i)asia|blue')) UNION ALL SELECT 'public', 'part', 'p_name' WHERE EXISTS (SELECT 1 FROM part WHERE regexp_matches(p_name, '(?i)asia|blue')) UNION ALL SELECT 'public', 'part', 'p_brand' WHERE EXISTS (SELECT 1 FROM part WHERE regexp_matches(p_brand, '(?i)asia|blue')) UNION ALL SELECT 'public', 'part', 'p_type' WHERE EXISTS (SELECT 1 FROM part WHERE regexp_matches(p_type, '(?i)asia|blue'))"),
    "rid_encode": (rid_encode, f"WITH d AS (SELECT o_orderkey, {_DIGITS} AS s FROM orders), g AS (SELECT o_orderkey, ltrim(substr(s, 1, 4) || '-' || substr(s, 5, 4), '0-') AS c FROM d) SELECT o_orderkey, CASE WHEN c = '' THEN '0' ELSE c END AS code, o_orderkey AS back FROM g"),
}


def headline() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries that are timed."""
    return {**{k: by_path(p) for k, (p, _) in PATHS.items()}, **{k: f for k, (f, _) in OTHERS.items()}}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from pathloom import queries_read, queries_write

    return {**headline(), **queries_read.queries(), **queries_write.queries()}


def oracle_sql() -> dict[str, str]:
    from pathloom import queries_read, queries_write

    own = {**{k: s for k, (_, s) in PATHS.items()}, **{k: s for k, (_, s) in OTHERS.items()}}
    return {**own, **queries_read.oracle_sql(), **queries_write.oracle_sql()}
