"""Aggregates, over a row or over the rows of a group."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.errors import BadRequest, Conflict
from pathloom.plans.model import Type


def aggregate(f: str, column: Column | None, kind: Type | None, record: Column | None = None) -> tuple[Column, Type | None]:
    """column is None for *, with record then the whole row. The result's type is None for arrays of records."""
    if f == "cnt":
        return (F.count(F.lit(1)) if column is None else F.count(column)), Type("int8")
    if column is None:
        if f not in ("array", "array_d"):
            raise BadRequest(f"{f} doesn't allow *")
        column, kind = record, None
    if f == "cnt_d":
        return F.count_distinct(column), Type("int8")
    if f in ("min", "max"):
        if not kind.ordered:
            raise Conflict(f"{f} is not defined on {kind.name}")
        return (F.min if f == "min" else F.max)(column), kind
    if f in ("avg", "sum"):
        if not kind.numeric:
            raise Conflict(f"{f} is not defined on {kind.name}{'[]' * kind.array}")
        if f == "avg":
            return F.avg(column), Type("float8")
        wide = kind.name in ("int8", "serial8", "oid")
        return F.sum(column.cast("decimal(38,0)") if wide else column), Type("numeric") if wide else Type("int8" if kind.name.startswith(("int", "serial")) else kind.name)
    # structs keep the nulls that lists and sets drop; no rows at all give null
    if f == "array":
        got = F.transform(F.collect_list(F.struct(column.alias("x"))), lambda s: s.x)
    else:
        got = F.array_sort(F.transform(F.collect_set(F.struct(column.alias("x"))), lambda s: s.x)) if kind else F.transform(F.collect_set(F.struct(column.alias("x"))), lambda s: s.x)
    return F.when(F.count(F.lit(1)) > 0, got), Type(kind.name, True) if kind and not kind.array else None


def example(column: Column) -> Column:
    """A bare column of a group: a value that isn't null; the least, so that it is always the same."""
    return F.min(column)
