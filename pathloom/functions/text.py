"""Values as text, as patterns see them: numbers in their shortest form, times in UTC to the second."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.plans.model import Type


def float_text(c: Column, digits: int) -> Column:
    """The shortest form that reads back: plain from 1e-4 up to ten to the digits, else with an exponent of two digits or more."""
    t, size = c.cast("string"), F.abs(c.cast("double"))
    plain = F.regexp_replace(t.try_cast("decimal(38,21)").cast("string"), r"\.?0+$", "")
    mantissa, power = F.regexp_extract(t, r"^(-?[0-9.]+)", 1), F.coalesce(F.regexp_extract(t, r"E(-?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    # below 1e7 there is no exponent in t yet
    low = F.regexp_replace((t.try_cast("decimal(38,10)") / F.lit(10**6).cast("decimal(7,0)")).cast("decimal(38,15)").cast("string"), r"\.?0+$", "")
    whole = F.when(power != 0, F.regexp_replace(mantissa, r"\.0$", "")).otherwise(low)
    power = F.when(power != 0, power).otherwise(6)
    scientific = F.concat(whole, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    special = F.isnan(c) | (size == float("inf"))
    return F.when(special, t).when(t == "-0.0", "-0").when(size == 0, "0").when((size >= 1e-4) & (size < 10.0**digits), plain).otherwise(scientific)


def scalar_text(c: Column, kind: str, scale: int | None = None) -> Column:
    if kind in ("timestamptz", "row_rct", "row_rmt"):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if kind in ("float4", "float8"):
        return float_text(c, 6 if kind == "float4" else 15)
    if kind == "numeric":
        t = c.cast("string") if scale is None else c.cast(f"decimal(38,{scale})").cast("string")
        return t if scale is not None else F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    if kind == "timetz":
        return F.date_format(F.concat(F.lit("1970-01-02 "), F.regexp_replace(c, r"^(\d\d:\d\d)(?!:)", "$1:00")).try_cast("timestamp"), " HH: mm: ss")
    if kind == "time":  # two digits each, after a blank for the sign
        part = lambda k: F.split_part(c, F.lit(":"), F.lit(k))
        second = F.lpad(F.round(F.coalesce(part(3).try_cast("double"), F.lit(0.0))).cast("int").cast("string"), 2, "0")
        return F.concat(F.lit(" "), part(1), F.lit(": "), part(2), F.lit(": "), second)
    return c.cast("string")


def as_text(c: Column, kind: Type) -> Column:
    """An array as {a,b}, with quotes where an element needs them and NULL for nulls."""
    if not kind.array:
        return scalar_text(c, kind.name, kind.scale)

    def element(x: Column) -> Column:
        t = scalar_text(x, kind.name, kind.scale)
        odd = t.rlike(r'^$|[{},"\\\s]|^(?i:null)$')
        return F.coalesce(F.when(odd, F.concat(F.lit('"'), F.regexp_replace(t, r'(["\\])', r"\\$1"), F.lit('"'))).otherwise(t), F.lit("NULL"))

    return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(c, element), ","), F.lit("}")))
