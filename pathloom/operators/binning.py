"""Equal-width bins: a struct of bucket, lower, upper."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.errors import BadRequest, Conflict
from pathloom.operators.predicates import literal
from pathloom.plans.model import INTS, TIMES, Type


def bin_of(column: Column, kind: Type, count: str, low: str, high: str) -> Column:
    """Nulls have no bucket; below low is bucket 0, from high on count + 1; low itself is in the first."""
    try:
        n = int(count)
    except ValueError as e:
        raise BadRequest(f"{count!r} is not a number of bins") from e
    if n < 1:
        raise BadRequest("at least one bin is needed")
    if kind.array or not (kind.numeric or kind.name in TIMES):
        raise Conflict(f"binning is not defined on {kind.name}")
    if low == high:
        raise BadRequest("a bin's bounds must differ")
    time = kind.name in TIMES
    a, b = literal(low, kind), literal(high, kind)

    def number(c: Column) -> Column:
        return (F.unix_micros(c.cast("timestamp")) / 1e6) if time else c.cast("double")

    x, lo, hi = number(column), number(a), number(b)
    bucket = F.width_bucket(x, lo, hi, F.lit(n)).cast("int")
    out = "timestamp" if time else "double" if kind.name in INTS or kind.name == "numeric" else kind.spark

    def edge(k: Column) -> Column:
        v = lo + (hi - lo) * (k / n)
        return F.timestamp_micros(F.round(v * 1e6).cast("bigint")) if time else v.cast(out)

    inside = (bucket >= 1) & (bucket <= n)
    return F.struct(bucket.alias("bucket"), F.when(inside, edge(bucket - 1)).when(bucket > n, edge(F.lit(n))).alias("lower"), F.when(inside, edge(bucket)).when(bucket < 1, edge(F.lit(0))).alias("upper"))
