"""Further queries that read: arrays, literals, texts, joins, projections, aggregates, formats and refused requests, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import queries as base
from pathloom.catalog import Catalog, Client
from pathloom.errors import PathError
from pathloom.functions import rid
from pathloom.functions.text import as_text
from pathloom.plans.model import Type
from pathloom.sources import formats

Query = Callable[[SparkSession, str], DataFrame]


def statuses(spark: SparkSession, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """For each case the status that a service would answer with."""
    out = []
    for name, act in cases.items():
        try:
            act()
            out.append((name, 200))
        except PathError as e:
            out.append((name, e.status))
    return spark.createDataFrame(out, "request string, status int")


def values_sql(columns: str, rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (bool, int)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({columns})"


def status_sql(want: dict[str, int]) -> str:
    return values_sql("request, status", list(want.items()))


def code_sql(n: str) -> str:
    """A row identifier's text in SQL."""
    digits = " || ".join(f"substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(({n} * 2 >> {5 * k}) & 31 AS INT) + 1, 1)" for k in range(11, -1, -1))
    return f"coalesce(nullif(ltrim(regexp_replace({digits}, '(.{{4}})(.{{4}})(.{{4}})', '\\1-\\2-\\3'), '0-'), ''), '0')"


# arrays

_BASKET = "(SELECT o_orderkey, list(l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) FILTER (l_orderkey IS NOT NULL) AS lines, list(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) FILTER (l_orderkey IS NOT NULL) AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"


def baskets(spark: SparkSession, sf_dir: str) -> Catalog:
    """Orders with arrays of their lines' numbers and flags, null for N; orders without lines have null arrays."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    lines = base.rows(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    df = base.rows(spark, sf_dir, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    c = Catalog(spark)
    c.register("baskets", df.select("o_orderkey", F.transform("x", lambda s: s.l_linenumber).alias("lines"), F.transform("x", lambda s: s.flag).alias("flags")), ("o_orderkey",))
    return c


def of_baskets(path: str) -> Query:
    return lambda spark, sf_dir: baskets(spark, sf_dir).query(path)


ARRAYS: dict[str, tuple[str, str]] = {
    "array_equal": ("attribute/baskets/lines=3/o_orderkey", "list_contains(lines, 3)"),
    "array_equal_any": ("attribute/baskets/flags=any(A,X)/o_orderkey", "list_has_any(flags, ['A', 'X'])"),
    "array_equal_all": ("attribute/baskets/lines=all(1,2,5)/o_orderkey", "list_has_all(lines, [1, 2, 5])"),
    "array_ordered": ("attribute/baskets/lines::gt::6/o_orderkey", "list_max(lines) > 6"),
    "array_ordered_any": ("attribute/baskets/lines::geq::any(7,20)/o_orderkey", "list_max(lines) >= 7"),
    "array_ordered_neg": ("attribute/baskets/!flags::lt::R/o_orderkey", "list_min(list_filter(flags, lambda x: x IS NOT NULL)) >= 'R'"),
    "array_null": ("attribute/baskets/lines::null::/o_orderkey", "lines IS NULL"),
    "array_regexp": ("attribute/baskets/flags::regexp::%5E%5C%7BA%2C(NULL%7CR)/o_orderkey".replace("(", "%28").replace(")", "%29"), "regexp_matches('{' || array_to_string(list_transform(flags, lambda x: coalesce(x, 'NULL')), ',') || '}', '^\\{A,(NULL|R)')"),
}

#: name: (path, SQL) over the folder's tables
PATHS: dict[str, tuple[str, str]] = {
    "filter_ts": ("entity/part/p_name::ts::ring+small", "SELECT * FROM part WHERE list_has_all(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), ['ring', 'small'])"),
    "filter_empty_literal": ("attribute/documents/!lang=/doc_id,lang", "SELECT doc_id, lang FROM documents WHERE NOT lang = ''"),
    "filter_regexp_float": ("attribute/lineitem/l_quantity::regexp::%5E4%5B0-9%5D%24/l_orderkey,l_linenumber,l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 40 AND l_quantity < 50 AND l_quantity = floor(l_quantity)"),
    "filter_regexp_fraction": ("attribute/orders/o_totalprice::regexp::%5C.%5B0-9%5D%24/o_orderkey,o_totalprice", "SELECT o_orderkey, o_totalprice FROM orders WHERE round(o_totalprice * 10) / 10 = o_totalprice AND o_totalprice <> floor(o_totalprice)"),
    "filter_star_float": ("entity/part/*::regexp::%5E9%5B0-9%5D%2B%5C.5%24", "SELECT * FROM part WHERE regexp_matches(CAST(p_retailprice AS VARCHAR), '^9[0-9]+\\.5$')"),
    "filter_regexp_timestamp": ("attribute/orders/o_orderdate::regexp::%5E1997-0%5B1-3%5D-..T00%3A00%3A00%24/o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-04-01'"),
    "join_self": ("attributegroup/A:=conversations/B:=(conv_id)=(conversations:conv_id)/first:=A:role,second:=B:role;n:=cnt(*)", "SELECT a.role AS first, b.role AS second, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id GROUP BY a.role, b.role"),
    "attr_star": ("attribute/region/r_name::geq::B/*", "SELECT * FROM region WHERE r_name >= 'B'"),
    "array_of_values": ("attributegroup/orders/o_orderpriority;keys:=array(o_orderkey)", "SELECT o_orderpriority, list(o_orderkey ORDER BY o_orderkey) AS keys FROM orders GROUP BY o_orderpriority"),
    "array_of_none": ("aggregate/orders/o_totalprice::lt::0/keys:=array(o_orderkey),n:=cnt(*)", "SELECT CASE WHEN count(*) > 0 THEN list(o_orderkey) END AS keys, count(*) AS n FROM orders WHERE o_totalprice < 0"),
}


def array_of_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base.catalog(spark, sf_dir).query(PATHS["array_of_values"][0])
    return df.select("o_orderpriority", F.array_sort("keys").alias("keys"))


def array_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values of a group, nulls too."""
    df = base.catalog(spark, sf_dir).query("attributegroup/A:=documents/left(doc_id)=(labels:doc_id)/A:lang;grades:=array(quality),n:=cnt(quality),d:=array_d(quality)")
    return df.select("lang", F.size("grades").cast("bigint").alias("size"), F.size(F.filter("grades", lambda x: x.isNull())).cast("bigint").alias("nulls"), "n", F.size("d").cast("bigint").alias("different"))


def array_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows as records."""
    df = base.catalog(spark, sf_dir).query("attributegroup/nation/n_regionkey;rows:=array(*)")
    return df.select("n_regionkey", F.to_json(F.array_sort("rows")).alias("rows"))


def filter_regexp_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numeric of declared scale keeps its zeros, one without has none."""
    c = Catalog(spark)
    price = F.col("o_totalprice").cast("decimal(12,2)")
    c.register("prices", base.rows(spark, sf_dir, "orders").select("o_orderkey", price.alias("two"), price.cast("decimal(38,18)").alias("plain")), ("o_orderkey",))
    t = c.model.table("prices")
    t.columns["plain"].type = Type("numeric")
    return c.query("attribute/prices/two::regexp::%5C.%5B0-9%5D0%24&plain::regexp::%5C.%5B1-9%5D%24/o_orderkey,two")


def filter_rid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identifier in another spelling: lower case, O for 0, without hyphens."""
    c = Catalog(spark)
    c.register("t", base.rows(spark, sf_dir, "orders").select(rid.encode(F.col("o_orderkey")).alias("RID"), "o_orderkey"), ("RID",))
    return c.query("attribute/t/RID=any(2oo,20w,f8)/o_orderkey,RID")


def composite_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign key of two columns: each turn and the one before it."""
    c = Catalog(spark)
    turns = base.rows(spark, sf_dir, "conversations")
    c.register("conversations", turns, ("conv_id", "turn"))
    replies = turns.where("turn > 0").select("conv_id", F.col("turn").alias("own"), (F.col("turn") - 1).alias("before"), F.col("role").alias("who"))
    c.register("replies", replies, ("conv_id", "own"), [(("conv_id", "before"), "conversations", ("conv_id", "turn"))])
    return c.query("attributegroup/R:=replies/conversations/R:who,role;n:=cnt(*)")


def bin_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Catalog(spark)
    c.register("days", base.rows(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("day")), ("event_id",))
    df = c.query("attributegroup/days/b:=bin(day;4;2024-01-05;2024-01-25);n:=cnt(*)")
    return df.select("b.bucket", F.unix_seconds("b.lower").alias("lower"), F.unix_seconds("b.upper").alias("upper"), "n")


def bin_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins in JSON are arrays of numbers, of floats and of integers; bounds that don't exist are null."""
    df = base.catalog(spark, sf_dir).query("attribute/part/p_partkey,b:=bin(p_retailprice;4;950;1050),size:=bin(p_size;8;10;20)")
    return formats.json_lines(df)


def _bin_sql(x: str, n: int, low: int, high: int) -> str:
    width = (high - low) / n
    text = lambda v: f"regexp_replace(CAST({v} AS VARCHAR), '\\.0$', '')"
    k = f"CAST(floor(({x} - {low}) / {width}) AS INT)"
    inside = f"'[' || ({k} + 1) || ',' || {text(f'({low} + {width} * {k})::DOUBLE')} || ',' || {text(f'({low} + {width} * ({k} + 1))::DOUBLE')} || ']'"
    return f"CASE WHEN {x} < {low} THEN '[0,null,{low}]' WHEN {x} >= {high} THEN '[{n + 1},{high},null]' ELSE {inside} END"


def json_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON objects, with nulls."""
    df = base.catalog(spark, sf_dir).query("attribute/A:=documents/left(doc_id)=(labels:doc_id)/$A/doc_id,lang,grade:=labels:quality")
    return formats.json_lines(df)


def json_array_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as one JSON array."""
    text = formats.render(base.catalog(spark, sf_dir).query("entity/region@sort(r_regionkey)"), formats.JSON)
    return spark.createDataFrame([(text,)], "body string")


def csv_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of a CSV result, arrays as {a,b}."""
    return formats.csv_columns(baskets(spark, sf_dir).query("entity/baskets"))


def csv_out_json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.csv_columns(baskets(spark, sf_dir).query("entity/baskets"), "json")


_ODD_NAMES = "CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a \"b\", ' || n_name ELSE n_name || chr(10) || 'x' END"


def _nations(spark: SparkSession, sf_dir: str) -> tuple[Catalog, DataFrame]:
    c = base.catalog(spark, sf_dir)
    return c, base.rows(spark, sf_dir, "nation").selectExpr("n_nationkey", f"{_ODD_NAMES} AS n_name", "n_regionkey")


def _in_and_out(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c, odd = _nations(spark, sf_dir)
        return formats.read_rows(spark, c.model.table("nation"), formats.render(odd, kind), kind)

    return run


def csv_arrays_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays in CSV, as {a,b} and as JSON."""
    c = Catalog(spark)
    c.create({"table_name": "t", "column_definitions": [{"name": "id", "type": "int8"}, {"name": "numbers", "type": "int4[]"}, {"name": "words", "type": "text[]"}], "keys": []})
    few = baskets(spark, sf_dir).query("attribute/baskets/o_orderkey::lt::40/id:=o_orderkey,numbers:=lines,words:=flags")
    both = [formats.read_rows(spark, c.model.table("t"), formats.render(few, formats.CSV, how), formats.CSV) for how in ("text", "json")]
    return both[0].intersectAll(both[1])


def dict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small result as dictionaries in Python."""
    df = base.catalog(spark, sf_dir).query("entity/nation/n_regionkey=2")
    return spark.createDataFrame([r.asDict() for r in df.collect()], df.schema)


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values as patterns see them: floats shortest, dates, booleans and arrays, times to the second."""
    df = base.rows(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderdate").alias("t"), (F.floor("o_totalprice") * 1.0).alias("f"), (F.col("o_orderkey") % 2 == 0).alias("b"), F.array(F.col("o_custkey"), F.lit(None)).alias("a"), F.date_format("o_orderdate", "HH:mm:ss").alias("h"))
    kinds = {"d": Type("date"), "t": Type("timestamptz"), "f": Type("float8"), "b": Type("boolean"), "a": Type("int8", True), "h": Type("time")}
    return df.select("o_orderkey", *(as_text(F.col(c), k).alias(c) for c, k in kinds.items()))


def time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day are compared as such and seen by patterns in their own form."""
    c = Catalog(spark)
    c.register("t", base.rows(spark, sf_dir, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("at")), ("event_id",))
    c.model.table("t").columns["at"].type = Type("time")
    return c.query("attribute/t/at::geq::10:30:00&at::regexp::%5E 1%5B0-2%5D%3A/event_id,at".replace("10:30:00", "10%3A30%3A00").replace(" ", "%20"))


def moment_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = base.rows(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    coded = df.select("event_id", rid.encode_time(F.col("ts")).alias("code"), "ts")
    return coded.select("event_id", "code", F.unix_micros(rid.decode_time(F.lower("code"))).alias("back"))


def rights_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a client may do with each order: one binding walks to the customer's nation, one is of the row itself."""
    c = base.catalog(spark, sf_dir)
    orders = base.rows(spark, sf_dir, "orders").withColumn("RID", rid.encode(F.col("o_orderkey")))
    c.register("deals", orders, [("RID",), ("o_orderkey",)], [(("o_custkey",), "customer", ("c_custkey",))])
    t = c.model.table("deals")
    t.fkeys[0].name = ("public", "deals_customer")
    for f in c.model.table("customer").fkeys:
        f.name = ("public", "customer_nation")
    t.acls = {"update": [], "delete": []}
    t.acl_bindings = {
        "nation": {"types": ["update"], "projection": [{"outbound": ["public", "deals_customer"]}, {"outbound": ["public", "customer_nation"]}, "n_name"], "projection_type": "acl"},
        "status": {"types": ["delete"], "projection": [{"filter": "o_totalprice", "operator": "::gt::", "operand": "250000"}, "o_orderstatus"], "projection_type": "acl"},
    }
    return c.query("attribute/deals/o_orderkey,r:=trs(RID)", client=Client("someone", frozenset({"NATION_5", "F"})))


def rights_of_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for columns: balances by segment, names by nobody, the rest by all that may write."""
    c = Catalog(spark)
    c.register("customer", base.rows(spark, sf_dir, "customer").select(rid.encode(F.col("c_custkey")).alias("RID"), "c_custkey", "c_name", "c_acctbal", "c_mktsegment"), ("RID",))
    t = c.model.table("customer")
    t.acls = {"write": ["staff"]}
    t.columns["c_name"].acls = {"update": []}
    t.columns["c_acctbal"].acls = {"update": []}
    t.columns["c_acctbal"].acl_bindings = {"own": {"types": ["update"], "projection": "c_mktsegment", "projection_type": "acl"}}
    return c.query("attribute/customer/c_custkey,r:=tcrs(RID)", client=Client("someone", frozenset({"staff", "BUILDING"})))


# requests that are refused

REFUSED: dict[str, tuple[str, int]] = {
    "page without a sort": ("entity/orders@after(1)", 400), "page key of another length": ("entity/orders@sort(o_orderkey)@after(1,2)", 400), "before without a limit": ("entity/orders@sort(o_orderkey)@before(9)", 400),
    "sort of an aggregate": ("aggregate/orders/n:=cnt(*)@sort(n)", 400), "unknown sort key": ("attribute/orders/o_orderkey@sort(o_custkey)", 400), "star with another operator": ("entity/orders/*=1", 400),
    "list without a quantifier": ("entity/orders/o_orderkey=(1,2)", 400), "bad date": ("entity/orders/o_orderdate=garbage", 400), "number out of range": ("entity/nation/n_nationkey=99999999999", 400), "bad number": ("entity/nation/n_nationkey=x", 400),
    "bad limit": ("entity/nation?limit=x", 400), "same output twice": ("attribute/nation/x:=n_name,x:=n_nationkey", 400), "alias twice": ("entity/A:=nation/A:=region", 400), "aggregate without a name": ("aggregate/nation/cnt(*)", 400), "bare column in an aggregate": ("aggregate/nation/n_name", 400),
    "bin of equal bounds": ("attribute/part/b:=bin(p_size;3;5;5)", 400), "unknown api": ("query/nation", 400), "unknown alias": ("entity/nation/$Z", 400), "unequal link": ("entity/nation/(n_regionkey,n_name)=(region:r_regionkey)", 400),
    "link with itself": ("entity/nation/nation", 409), "no link": ("entity/region/part", 409), "unknown table": ("entity/nowhere", 409), "unknown column": ("entity/nation/nothing=1", 409), "sum of text": ("aggregate/nation/x:=sum(n_name)", 409), "bin of text": ("attribute/nation/b:=bin(n_name;2;1;3)", 409),
    "fine": ("entity/nation", 200),
}


def request_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = base.catalog(spark, sf_dir)
    return statuses(spark, {k: lambda p=p: c.query(p) for k, (p, _) in REFUSED.items()})


BODIES: dict[str, tuple[str, str, int]] = {
    "html": ("<p>", "text/html", 415), "xml": ("<a/>", "application/xml", 415), "csv": ("r_regionkey,r_name\n9,x\n", formats.CSV, 200), "json": ('[{"r_regionkey": 9}]', formats.JSON, 200), "json lines": ('{"r_regionkey": 9}\n', formats.LINES, 200),
    "csv without a header": ("", formats.CSV, 400), "csv with an unknown column": ("nope\n1\n", formats.CSV, 400), "csv with a column twice": ("r_name,r_name\nx,y\n", formats.CSV, 400), "csv with a field too many": ("r_name\nx,y\n", formats.CSV, 400), "csv with an open quote": ('r_name\n"x\n', formats.CSV, 400),
    "json that isn't rows": ("[1]", formats.JSON, 400), "broken json": ("[", formats.JSON, 400), "json with an unknown column": ('[{"nope": 1}]', formats.JSON, 400),
}


def body_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = base.catalog(spark, sf_dir).model.table("region")
    return statuses(spark, {k: lambda b=b, m=m: formats.read_rows(spark, t, b, m) for k, (b, m, _) in BODIES.items()})


_NATIONS_SQL = f"SELECT n_nationkey, {_ODD_NAMES} AS n_name, n_regionkey FROM nation"
_LISTED = "'{' || array_to_string(list_transform({0}, lambda x: coalesce(CAST(x AS VARCHAR), 'NULL')), ',') || '}'"

OTHERS: dict[str, tuple[Query, str]] = {
    **{k: (of_baskets(p), f"SELECT o_orderkey FROM {_BASKET} WHERE {w}") for k, (p, w) in ARRAYS.items()},
    "array_with_nulls": (array_with_nulls, "SELECT lang, count(*) AS size, count(*) - count(quality) AS nulls, count(quality) AS n, count(DISTINCT quality) + CAST(count(*) > count(quality) AS INT) AS different FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"),
    "array_records": (array_records, "SELECT n_regionkey, CAST(to_json(list({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey} ORDER BY n_nationkey)) AS VARCHAR) AS rows FROM nation GROUP BY n_regionkey"),
    "filter_regexp_numeric": (filter_regexp_numeric, "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(12,2)) AS two FROM orders WHERE CAST(o_totalprice AS DECIMAL(12,2)) * 10 % 1 = 0 AND CAST(o_totalprice AS DECIMAL(12,2)) % 1 <> 0"),
    "filter_rid": (filter_rid, f"SELECT o_orderkey, {code_sql('o_orderkey')} AS RID FROM orders WHERE o_orderkey IN (1024, 1038, 244)"),
    "composite_join": (composite_join, "SELECT r.role AS who, c.role, count(*) AS n FROM conversations r JOIN conversations c ON r.conv_id = c.conv_id AND r.turn - 1 = c.turn WHERE r.turn > 0 GROUP BY r.role, c.role"),
    "bin_date": (bin_date, "WITH d AS (SELECT date_diff('day', DATE '2024-01-05', CAST(ts AS DATE)) AS x FROM events), b AS (SELECT CASE WHEN x < 0 THEN 0 WHEN x >= 20 THEN 5 ELSE x // 5 + 1 END AS k FROM d) SELECT CAST(k AS INT) AS bucket, CASE WHEN k > 0 THEN CAST(epoch(DATE '2024-01-05') AS BIGINT) + 432000 * (k - 1) END AS lower, CASE WHEN k < 5 THEN CAST(epoch(DATE '2024-01-05') AS BIGINT) + 432000 * k END AS upper, count(*) AS n FROM b GROUP BY k"),
    "bin_json": (bin_json, f"SELECT '{{\"p_partkey\":' || p_partkey || ',\"b\":' || {_bin_sql('p_retailprice', 4, 950, 1050)} || ',\"size\":' || {_bin_sql('p_size', 8, 10, 20)} || '}}' AS value FROM part"),
    "json_out": (json_out, "SELECT '{\"doc_id\":' || d.doc_id || ',\"lang\":\"' || lang || '\",\"grade\":' || coalesce(CAST(quality AS VARCHAR), 'null') || '}' AS value FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "json_array_out": (json_array_out, "SELECT '[' || string_agg('{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}', ',' || chr(10) ORDER BY r_regionkey) || ']' AS body FROM region"),
    "csv_out": (csv_out, f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, {_LISTED.replace('{0}', 'lines')} AS lines, {_LISTED.replace('{0}', 'flags')} AS flags FROM {_BASKET}"),
    "csv_out_json_arrays": (csv_out_json_arrays, f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(to_json(lines) AS VARCHAR) AS lines, CAST(to_json(flags) AS VARCHAR) AS flags FROM {_BASKET}"),
    "csv_in": (_in_and_out(formats.CSV), _NATIONS_SQL),
    "json_in": (_in_and_out(formats.JSON), _NATIONS_SQL),
    "json_lines_in": (_in_and_out(formats.LINES), _NATIONS_SQL),
    "csv_arrays_in": (csv_arrays_in, f"SELECT o_orderkey AS id, lines AS numbers, flags AS words FROM {_BASKET} WHERE o_orderkey < 40"),
    "dict_rows": (dict_rows, "SELECT * FROM nation WHERE n_regionkey = 2"),
    "text_forms": (text_forms, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS t, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS f, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS b, '{' || o_custkey || ',NULL}' AS a, strftime(o_orderdate, ' %H: %M: %S') AS h FROM orders"),
    "time_filter": (time_filter, "SELECT event_id, strftime(ts, '%H:%M:%S') AS at FROM events WHERE strftime(ts, '%H:%M:%S') >= '10:30:00' AND hour(ts) BETWEEN 10 AND 12"),
    "moment_codes": (moment_codes, f"SELECT event_id, {code_sql('epoch_us(ts)')} AS code, epoch_us(ts) AS back FROM events"),
    "rights_of_rows": (rights_of_rows, "SELECT o_orderkey, '{\"update\":' || CAST(n_name = 'NATION_5' AS VARCHAR) || ',\"delete\":' || CAST(o_totalprice > 250000 AND o_orderstatus = 'F' AS VARCHAR) || '}' AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "rights_of_columns": (rights_of_columns, "SELECT c_custkey, '{\"update\":true,\"delete\":true,\"column_update\":{\"RID\":false,\"c_custkey\":true,\"c_name\":false,\"c_acctbal\":' || CAST(c_mktsegment = 'BUILDING' AS VARCHAR) || ',\"c_mktsegment\":true}}' AS r FROM customer"),
    "request_statuses": (request_statuses, status_sql({k: s for k, (_, s) in REFUSED.items()})),
    "body_statuses": (body_statuses, status_sql({k: s for k, (*_, s) in BODIES.items()})),
}


def queries() -> dict[str, Query]:
    paths = {k: base.by_path(p) for k, (p, _) in PATHS.items()}
    return {**paths, "array_of_values": array_of_values, **{k: f for k, (f, _) in OTHERS.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: s for k, (_, s) in PATHS.items()}, **{k: s for k, (_, s) in OTHERS.items()}}
