"""Row versions with intervals: valid_from inclusive, valid_to exclusive and null while current."""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FROM, TO = "valid_from", "valid_to"


def _moment(t: datetime | None) -> Column:
    return F.lit(t).cast("timestamp")


def opened(df: DataFrame, now: datetime) -> DataFrame:
    return df.select("*", _moment(now).alias(FROM), _moment(None).alias(TO))


def capture(history: DataFrame, new: DataFrame, key: list[str], now: datetime) -> DataFrame:
    """The history after the table has become new: gone and changed rows are closed, new and changed ones opened.

    A version that was opened at this same moment is replaced, not closed.
    """
    cols = [c for c in history.columns if c not in (FROM, TO)]
    closed = history.where(F.col(TO).isNotNull())
    live = history.where(F.col(TO).isNull())
    fresh = reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(None).cast(history.schema[c].dataType)), cols, new).select(*(F.col(f"`{c}`").cast(history.schema[c].dataType).alias(c) for c in cols))
    a, b = live.select(F.struct(*(f"`{c}`" for c in history.columns)).alias("old")), fresh.select(F.struct(*(f"`{c}`" for c in cols)).alias("new"))
    both = a.join(b, reduce(and_, (F.col("old")[c].eqNullSafe(F.col("new")[c]) for c in key)), "full")
    same = reduce(and_, (F.col("old")[c].eqNullSafe(F.col("new")[c]) for c in cols)) & F.col("old").isNotNull() & F.col("new").isNotNull()
    both = both.withColumn("same", F.coalesce(same, F.lit(False)))
    kept = both.where(F.col("old").isNotNull() & (F.col("same") | (F.col("old")[FROM] < _moment(now))))
    kept = kept.select(*(F.col("old")[c].alias(c) for c in [*cols, FROM]), F.when(~F.col("same"), _moment(now)).alias(TO))
    begun = both.where(F.col("new").isNotNull() & ~F.col("same")).select(*(F.col("new")[c].alias(c) for c in cols))
    return closed.unionByName(kept).unionByName(opened(begun, now))


def capture_changes(history: DataFrame, before: DataFrame, after: DataFrame, key: list[str], now: datetime) -> tuple[DataFrame, DataFrame]:
    """(keys, versions): the keys of rows that differ between before and after, parts of a table that hold the same keys but for those that came or went; and their new versions."""
    cols = after.columns
    box = lambda df, name: df.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in cols)).alias(name))
    both = box(before, "old").join(box(after, "new"), reduce(and_, (F.col("old")[c].eqNullSafe(F.col("new")[c]) for c in key)), "full")
    differs = F.col("old").isNull() | F.col("new").isNull() | ~reduce(and_, (F.col("old")[c].eqNullSafe(F.col("new")[c]) for c in cols))
    both = both.where(differs)
    keys = both.select(*(F.coalesce(F.col("old")[c], F.col("new")[c]).alias(c) for c in key))
    fresh = opened(both.where(F.col("new").isNotNull()).select(*(F.col("new")[c].alias(c) for c in cols)), now)
    return keys, fresh.select(*(F.col(f"`{c}`").cast(history.schema[c].dataType).alias(c) if c in fresh.columns else F.lit(None).cast(history.schema[c].dataType).alias(c) for c in history.columns))


def closed(history: DataFrame, keys: DataFrame, key: list[str], now: datetime) -> DataFrame:
    """history with the current versions of the keys ended; one that began at this same moment is taken away."""
    cols = history.columns
    a = history.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in cols)).alias("h"))
    b = keys.select(F.struct(*(f"`{c}`" for c in key)).alias("k"), F.lit(True).alias("hit"))
    both = a.join(b, reduce(and_, (F.col("h")[c].eqNullSafe(F.col("k")[c]) for c in key)) & F.col("h")[TO].isNull(), "left")
    ended = F.coalesce(F.col("hit"), F.lit(False))
    kept = both.where(~(ended & (F.col("h")[FROM] >= _moment(now))))
    return kept.select(*((F.when(ended, _moment(now)).otherwise(F.col("h")[c]) if c == TO else F.col("h")[c]).alias(c) for c in cols))


def as_of(history: DataFrame, t: datetime) -> DataFrame:
    at = _moment(t)
    return history.where((F.col(FROM) <= at) & (F.col(TO).isNull() | (at < F.col(TO)))).drop(FROM, TO)


def truncated(history: DataFrame, until: datetime) -> DataFrame:
    """Without the versions that ended by then."""
    return history.where(F.col(TO).isNull() | (F.col(TO) > _moment(until)))


def redacted(history: DataFrame, column: str, start: datetime | None, end: datetime | None, only: Column | None = None) -> DataFrame:
    """The column set to null in versions that lie wholly inside the interval (and meet the filter)."""
    inside = F.lit(True)
    if start is not None:
        inside &= F.col(FROM) >= _moment(start)
    if end is not None:
        inside &= F.col(TO).isNotNull() & (F.col(TO) <= _moment(end))
    if only is not None:
        inside &= F.coalesce(only, F.lit(False))
    return history.withColumn(column, F.when(~inside, F.col(f"`{column}`")))


def extent(history: DataFrame) -> tuple[datetime | None, datetime | None]:
    r = history.agg(F.min(FROM), F.max(F.greatest(FROM, F.coalesce(TO, FROM)))).first()
    return r[0], r[1]


def amended(versions: list[tuple[datetime, datetime | None, object]], start: datetime | None, end: datetime | None, value: object) -> list[tuple[datetime, datetime | None, object]]:
    """Of a metadata's versions (from, to, value): those parts that lie in the interval get another value, the rest stays."""
    out = []
    for a, z, v in versions:
        lo = a if start is None else max(a, start)
        hi = z if end is None else end if z is None else min(z, end)
        if hi is not None and lo >= hi:
            out.append((a, z, v))
            continue
        out += [(a, lo, v)] * (a < lo) + [(lo, hi, value)]
        if hi is not None and (z is None or hi < z):
            out.append((hi, z, v))
    return out
