"""Rows in and out as CSV, JSON arrays and JSON lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.errors import BadRequest, Unsupported
from pathloom.functions.text import as_text, scalar_text
from pathloom.plans.model import Table, Type

_FIELD = re.compile(r'(?P<quoted>"(?:[^"]|"")*"(?=,|\r?\n|$(?!\n)))?(?P<plain>(?(quoted)|[^,\r\n]*))(?P<end>,|\r?\n|$)')
CSV, JSON, LINES = "text/csv", "application/json", "application/x-json-stream"


def _schema(table: Table, names: list[str]) -> T.StructType:
    if len(set(names)) < len(names):
        raise BadRequest("a column is given twice")
    unknown = [n for n in names if n not in table.columns]
    if unknown:
        raise BadRequest(f"unknown columns {unknown}")
    return T.StructType([T.StructField(n, T._parse_datatype_string(table.columns[n].type.spark)) for n in names])


def _cell(c: Column, kind: Type) -> Column:
    """A CSV field as its column's type; arrays stand as {a,b} or as JSON."""
    if not kind.array:
        return c.cast(kind.spark)
    inner = F.regexp_replace(c, r"^\{|\}$", "")
    plain = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(inner, ","), lambda x: F.when(x != "NULL", F.regexp_replace(x, '^"|"$', ""))))
    return F.when(c.startswith("["), F.from_json(c, kind.spark)).otherwise(plain.cast(kind.spark))


def _records(text: str) -> list[list[str | None]]:
    """CSV records; an empty field is null, a quoted empty one the empty string. Quoted fields may hold line ends."""
    out, row, at = [], [], 0
    while at < len(text):
        m = _FIELD.match(text, at)
        if m["quoted"] is not None:
            row.append(m["quoted"][1:-1].replace('""', '"'))
        elif '"' in m["plain"]:
            raise BadRequest("a quote is not closed or stands within a field")
        else:
            row.append(m["plain"] or None)
        at = m.end()
        if m["end"] != ",":
            out.append(row)
            row = []
        elif at == len(text):
            row.append(None)
    return out + [row] * bool(row)


def read_rows(spark: SparkSession, table: Table, body: str | bytes, kind: str = JSON) -> DataFrame:
    """A request's body; for files, read_files."""
    text = body.decode() if isinstance(body, bytes) else body
    if kind == CSV:
        records = [r for r in _records(text) if r != [None]]
        if not records:
            raise BadRequest("CSV needs a header")
        names, rows = [str(n) for n in records[0]], records[1:]
        _schema(table, names)
        if any(len(r) != len(names) for r in rows):
            raise BadRequest("a row has another number of fields than the header")
        raw = spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType()) for n in names]))
        return raw.select(*(_cell(F.col(f"`{n}`"), table.columns[n].type).alias(n) for n in names))
    if kind in (JSON, LINES):
        try:
            rows = json.loads(text) if kind == JSON else [json.loads(x) for x in text.splitlines() if x.strip()]
        except ValueError as e:
            raise BadRequest(str(e)) from e
        if not isinstance(rows, list) or any(not isinstance(r, dict) for r in rows):
            raise BadRequest("rows must be objects")
        names = list(dict.fromkeys(k for r in rows for k in r)) or list(table.columns)
        schema = _schema(table, names)
        docs = [[json.dumps(r[n]) if table.columns[n].type.name in ("json", "jsonb") and r.get(n) is not None else r.get(n) for n in names] for r in rows]
        strings = [json.dumps(dict(zip(names, d))) for d in docs]
        return spark.createDataFrame([(s,) for s in strings], "s string").select(F.from_json("s", schema).alias("r")).select("r.*")
    raise Unsupported(f"{kind} is not supported")


def read_files(spark: SparkSession, table: Table, path: str, kind: str = LINES, columns: list[str] | None = None) -> DataFrame:
    """Files of rows, read by the executors. CSV files need a header of the columns given, in their order."""
    schema = _schema(table, columns or list(table.columns))
    if kind == LINES:
        return spark.read.schema(schema).json(path)
    if kind == JSON:
        return spark.read.schema(schema).json(path, multiLine=True)
    if kind == CSV:
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
        raw = spark.read.schema(text).csv(path, header=True, enforceSchema=False, multiLine=True, emptyValue="")
        return raw.select(*(_cell(F.col(f"`{f.name}`"), table.columns[f.name].type).alias(f.name) for f in schema))
    if kind == "parquet":
        return spark.read.parquet(path)
    raise Unsupported(f"{kind} is not supported")


BIN = ["bucket", "lower", "upper"]


def _bin_json(c: Column, kind: T.StructType) -> Column:
    """A bin as the JSON text [bucket, lower, upper], with numbers as numbers and times as texts."""
    def part(f: T.StructField) -> Column:
        own = Type.of_spark(f.dataType)
        text = scalar_text(c[f.name], own.name, own.scale)
        return F.coalesce(text if own.numeric else F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))

    return F.concat(F.lit("["), F.concat_ws(",", *map(part, kind.fields)), F.lit("]"))


def _is_bin(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.fieldNames() == BIN


def json_lines(df: DataFrame) -> DataFrame:
    """A column of objects, one a row; nulls are kept."""
    keep = {"ignoreNullFields": "false"}
    if not any(_is_bin(f.dataType) for f in df.schema):
        return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), keep).alias("value"))

    def member(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if _is_bin(f.dataType):
            return F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), _bin_json(c, f.dataType))
        return F.regexp_replace(F.to_json(F.struct(c.alias(f.name)), keep), r"(?s)^\{|\}$", "")

    return df.select(F.concat(F.lit("{"), F.concat_ws(",", *map(member, df.schema.fields)), F.lit("}")).alias("value"))


def csv_columns(df: DataFrame, arrays: str = "text") -> DataFrame:
    """All columns as text: arrays as {a,b} or as JSON, records as JSON."""

    def field(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and arrays != "json" and not isinstance(f.dataType.elementType, (T.ArrayType, T.StructType)):
            return as_text(c, Type.of_spark(f.dataType))
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return _bin_json(c, f.dataType) if _is_bin(f.dataType) else F.to_json(c, {"ignoreNullFields": "false"})
        return c.cast("string")

    return df.select(*(field(f).alias(f.name) for f in df.schema))


def render(df: DataFrame, kind: str = JSON, arrays: str = "text") -> str:
    """A small result as one text; large ones go by write_files."""
    if kind in (JSON, LINES):
        rows = [r[0] for r in json_lines(df).toLocalIterator()]
        return "\n".join(rows) + "\n" * bool(rows) if kind == LINES else "[" + ",\n".join(rows) + "]"
    if kind == CSV:
        def cell(v: str | None) -> str:
            return "" if v is None else '"' + v.replace('"', '""') + '"' if v == "" or any(x in v for x in ',"\r\n') else v

        rows = [df.columns, *csv_columns(df, arrays).toLocalIterator()]
        return "".join(",".join(map(cell, r)) + "\n" for r in rows)
    raise Unsupported(f"{kind} is not supported")


def write_files(df: DataFrame, path: str, kind: str = LINES, arrays: str = "text") -> None:
    if kind == LINES:
        json_lines(df).write.text(path)
    elif kind == CSV:
        csv_columns(df, arrays).write.csv(path, header=True, nullValue="", emptyValue='""')
    elif kind == "parquet":
        df.write.parquet(path)
    else:
        raise Unsupported(f"{kind} is not supported")
