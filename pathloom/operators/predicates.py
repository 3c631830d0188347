"""Filters to Column expressions, with PostgreSQL's null rules for arrays."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import datetime
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.errors import BadRequest
from pathloom.functions import rid
from pathloom.functions.text import as_text
from pathloom.plans import syntax as S
from pathloom.plans.model import FLOATS, INTS, TIMES, Type

COMPARE: dict[str, Callable[[Column, Column], Column]] = {"=": lambda a, b: a == b, "geq": lambda a, b: a >= b, "gt": lambda a, b: a > b, "leq": lambda a, b: a <= b, "lt": lambda a, b: a < b}


WIDTHS = {"int2": 16, "serial2": 16, "int4": 32, "serial4": 32, "int8": 64, "serial8": 64, "oid": 64}
CLOCK, ZONE = r"([01]\d|2[0-4]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?", r"(Z|[+-]\d\d(:?\d\d)?)?"


def moment(value: str) -> str:
    """A date or time as Spark casts it, or a ValueError; a day or month of one digit and a missing day are filled up."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(.*))?)?", value.strip())
    if not m:
        raise ValueError(value)
    day, rest = f"{m[1]}-{int(m[2] or 1):02}-{int(m[3] or 1):02}", m[4] or ""
    rest = re.sub(r"([+-]\d\d)(\d\d)$", r"\1:\2", rest)
    datetime.fromisoformat(day + rest)
    return day + rest


def literal(value: str | None, kind: Type) -> Column:
    """A value from the path, as the element type of a column."""
    base = Type(kind.name)
    if value is None:
        return F.lit(None).cast(base.spark)
    try:
        if base.name in INTS:
            if not -(1 << WIDTHS[base.name] - 1) <= int(value) < 1 << WIDTHS[base.name] - 1:
                raise ValueError(value)
            return F.lit(int(value)).cast(base.spark)
        if base.name in FLOATS or base.name == "numeric":
            float(value)
            if base.name == "numeric" and abs(Decimal(value)) >= 10**20:
                raise ValueError(value)
            return F.lit(value).cast(base.spark)
        if base.name in ("json", "jsonb"):
            return F.lit(json.dumps(json.loads(value), sort_keys=True, separators=(",", ":")))
        if base.name in TIMES:
            return F.lit(moment(value)).cast(base.spark)
        if base.name in ("time", "timetz") and not re.fullmatch(CLOCK + (ZONE if base.name == "timetz" else ""), value):
            raise ValueError(value)
    except (ValueError, ArithmeticError) as e:
        raise BadRequest(f"{value!r} is not of type {base.name}") from e
    if base.name == "boolean":
        if value.lower() not in ("t", "true", "f", "false", "yes", "no", "on", "off", "1", "0"):
            raise BadRequest(f"{value!r} is not boolean")
        return F.lit(value.lower() in ("t", "true", "yes", "on", "1"))
    return F.lit(value).cast(base.spark)


def any_element(c: Column, test: Callable[[Column], Column]) -> Column:
    """True if a non-null element passes, null if there is no such element at all."""
    some = F.filter(c, lambda x: x.isNotNull())
    return F.when(F.size(some) > 0, F.exists(some, test))


def like(c: Column, kind: Type, value: str, fold: bool) -> Column:
    return as_text(c, kind).rlike(("(?i)" if fold else "") + value)


def words_of(c: Column, value: str) -> Column:
    """All words of the value occur in the text (an extension: the reference's own is not usable)."""
    have = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return reduce(and_, (F.array_contains(have, w) for w in value.lower().split()), F.lit(True))


def single(c: Column, kind: Type, name: str, op: str, value: str) -> Column:
    if op in ("regexp", "ciregexp"):
        return like(c, kind, value, op == "ciregexp")
    if op == "ts":
        return words_of(as_text(c, kind), value)
    v = literal(value, kind)
    if kind.array:
        if op == "=":
            return F.when(c.isNotNull(), F.coalesce(F.array_contains(c, v), F.lit(False)))
        return any_element(c, lambda x: COMPARE[op](x, v))
    if op == "=" and name == "RID":
        return (c == v) | (c == rid.encode(rid.decode(v)))
    if kind.name in ("json", "jsonb") and op == "=":
        return F.to_json(F.parse_json(c)) == v
    return COMPARE[op](c, v)


def predicate(p: S.Predicate, column: Column, kind: Type) -> Column:
    name = p.left.parts[-1]
    if p.op == "null":
        return column.isNull()
    if p.quantifier and p.op == "=" and kind.array:
        values = F.array(*(literal(v, kind) for v in p.values))
        if p.quantifier == "any":
            return F.when(column.isNotNull(), F.coalesce(F.arrays_overlap(column, values), F.lit(False)))
        return F.when(column.isNotNull(), reduce(and_, (F.coalesce(F.array_contains(column, literal(v, kind)), F.lit(False)) for v in p.values)))
    if p.quantifier == "any" and p.op == "=" and not kind.array and name != "RID" and kind.name not in ("json", "jsonb"):
        return column.isin(*(literal(v, kind) for v in p.values))
    return reduce(and_ if p.quantifier == "all" else or_, (single(column, kind, name, p.op, v) for v in p.values))


def condition(node, resolve: Callable[[S.Name], list[tuple[Column, Type]]]) -> Column:
    """resolve gives the column of a name, or all columns of a row for *."""
    if isinstance(node, S.Not):
        return ~condition(node.term, resolve)
    if isinstance(node, S.And):
        return reduce(and_, (condition(t, resolve) for t in node.terms))
    if isinstance(node, S.Or):
        return reduce(or_, (condition(t, resolve) for t in node.terms))
    found = resolve(node.left)
    if node.left.parts[-1] == "*":
        if node.op not in ("regexp", "ciregexp", "ts"):
            raise BadRequest(f"* doesn't allow {node.op}")

        def whole(v: str) -> Column:
            return reduce(or_, (F.coalesce(single(c, k, "*", node.op, v), F.lit(False)) for c, k in found))

        return reduce(and_ if node.quantifier == "all" else or_, map(whole, node.values))
    return predicate(node, *found[0])
