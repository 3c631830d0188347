"""Set-based writes: each gives the table as it is afterwards, or raises before anything has changed."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.errors import BadRequest, Conflict
from pathloom.operators.predicates import CLOCK, ZONE
from pathloom.plans.model import Table

#: Keys of fixed width up to which these are sent to all that join with them; keys from which a filter goes before another join, and its words of 64 bits at most.
FEW, FILTERED, WORDS = 1 << 16, 1 << 10, 1 << 20
_FIXED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def some(df: DataFrame) -> bool:
    return bool(df.limit(1).head(1))


def same(a: str, b: str, columns: list[str] | tuple[str, ...], null_safe: bool) -> Column:
    """Equality of columns of two sides whose structs are named a and b."""
    return reduce(and_, ((F.col(a)[c].eqNullSafe(F.col(b)[c]) if null_safe else F.col(a)[c] == F.col(b)[c]) for c in columns))


def boxed(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*(F.col(f"`{c}`").alias(c) for c in df.columns)).alias(name))


def unboxed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return df.select(*(F.col(name)[c].alias(c) for c in columns))


def check_distinct(rows: DataFrame, key: tuple[str, ...]) -> None:
    if some(rows.groupBy(*(f"`{c}`" for c in key)).count().where("count > 1")):
        raise BadRequest(f"rows share a key ({', '.join(key)})")


def check_types(table: Table, rows: DataFrame) -> None:
    for c in table.columns.values():
        if c.type.name == "color_rgb_hex" and not c.type.array and some(rows.where(~F.col(f"`{c.name}`").rlike("^#[0-9a-fA-F]{6}$"))):
            raise Conflict(f"{c.name} must be a colour")
        if c.type.name in ("time", "timetz") and not c.type.array and some(rows.where(~F.col(f"`{c.name}`").rlike(f"^{CLOCK}{ZONE if c.type.name == 'timetz' else ''}$"))):
            raise Conflict(f"{c.name} must be a time of day")
    need = [c.name for c in table.columns.values() if not c.nullok]
    if need and some(rows.where(reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNull() for c in need)))):
        raise Conflict(f"one of {need} is null")


def collisions(rows: DataFrame, current: DataFrame, key: tuple[str, ...], how: str) -> DataFrame:
    """Rows whose key stands in current (left_semi) or doesn't (left_anti); a null never collides."""
    cols = rows.columns
    return unboxed(boxed(rows, "n").join(boxed(current.select(*(f"`{c}`" for c in key)), "o"), same("n", "o", key, False), how), "n", cols)


def insert(table: Table, current: DataFrame, rows: DataFrame, skip: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the table, what was added). With skip, rows that collide with a key are left out, else an error."""
    rows = rows.select(*(f"`{c}`" for c in current.columns))
    keys = [k.columns for k in table.keys if k.enforced]
    for key in keys:
        if skip:
            rows = collisions(rows, current, key, "left_anti")
            full = reduce(and_, (F.col(f"`{c}`").isNotNull() for c in key))
            rows = rows.where(full).dropDuplicates(list(key)).unionAll(rows.where(~full))
        else:
            full = rows.where(reduce(and_, (F.col(f"`{c}`").isNotNull() for c in key)))
            check_distinct(full, key)
            if some(collisions(rows, current, key, "left_semi")):
                raise Conflict(f"a row with this key ({', '.join(key)}) exists")
    check_types(table, rows)
    return current.unionByName(rows), rows


def update(current: DataFrame, rows: DataFrame, key: dict[str, str], targets: dict[str, str], extra: dict[str, Column] | None = None, nullable: bool = False) -> DataFrame:
    """Rows of current that match on key (own column: column of rows) take targets (own column: column of rows)."""
    cols = current.columns
    on = reduce(and_, ((F.col("o")[c].eqNullSafe(F.col("n")[k]) if nullable else F.col("o")[c] == F.col("n")[k]) for c, k in key.items()))
    both = boxed(current, "o").join(boxed(rows.withColumn("found|", F.lit(True)), "n"), on, "left")
    hit = F.coalesce(F.col("n")["found|"], F.lit(False))

    def value(c: str) -> Column:
        if c in targets:
            return F.when(hit, F.col("n")[targets[c]].cast(current.schema[c].dataType)).otherwise(F.col("o")[c])
        if extra and c in extra:
            return F.when(hit, extra[c].cast(current.schema[c].dataType)).otherwise(F.col("o")[c])
        return F.col("o")[c]

    return both.select(*(value(c).alias(c) for c in cols))


def parted(df: DataFrame, keys: DataFrame, key: tuple[str, ...] | list[str], number: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows that may have one of the keys, rows that surely have none), so that a join moves no more than the first; the second is None where all rows are among the first.

    Each key sets two bits in one of the words of a filter, which is broadcast; more keys than the words are made for let more rows through.
    """
    kinds = [(df.schema[c].dataType, keys.schema[c].dataType) for c in key]
    fixed = all(isinstance(a, _FIXED) for a, _ in kinds)
    if number <= (FEW if fixed else FILTERED) or any(a != b or not (isinstance(a, _FIXED) or a == T.StringType()) for a, b in kinds):
        return df, None
    code = F.xxhash64(*(F.col(f"`{c}`") for c in key))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(code, at).bitwiseAND(F.lit(63)).cast("int"))
    own = {"word|": F.pmod(code, F.lit(min(WORDS, number // 4 + 1)).cast("bigint")), "mask|": bit(40).bitwiseOR(bit(50))}
    words = keys.select(*(c.alias(n) for n, c in own.items())).groupBy("word|").agg(F.bit_or("mask|").alias("bits|"))
    marked = df.withColumns(own).join(F.broadcast(words), "word|", "left")
    may = F.coalesce(F.col("bits|").bitwiseAND(F.col("mask|")) == F.col("mask|"), F.lit(False))
    cols = [f"`{c}`" for c in df.columns]
    return marked.where(may).select(*cols), marked.where(~may).select(*cols)


def sent(keys: DataFrame, number: int) -> DataFrame:
    """keys for the side of a join that is broadcast, if they are few and of fixed width."""
    return F.broadcast(keys) if number <= FEW and all(isinstance(f.dataType, _FIXED) for f in keys.schema) else keys


def matching(df: DataFrame, keys: DataFrame, key: tuple[str, ...] | list[str], number: int, null_safe: bool, how: str) -> DataFrame:
    """The rows of df whose key is among the keys (left_semi) or isn't (left_anti)."""
    side = sent(keys.select(*(F.col(f"`{c}`").alias(f"key|{k}") for k, c in enumerate(key))), number)
    pairs = [(F.col(f"`{c}`"), F.col(f"key|{k}")) for k, c in enumerate(key)]
    return df.join(side, reduce(and_, (a.eqNullSafe(b) if null_safe else a == b for a, b in pairs)), how)


def among(df: DataFrame, keys: DataFrame, key: tuple[str, ...] | list[str], number: int) -> DataFrame:
    """The rows whose key is among the keys; a null never is."""
    return matching(parted(df, keys, key, number)[0], keys, key, number, False, "left_semi")


def delete(current: DataFrame, keys: DataFrame, key: tuple[str, ...] | list[str], number: int, null_safe: bool = True) -> DataFrame:
    """Without the rows whose key is among the keys, so many in number."""
    may, rest = parted(current, keys, key, number)
    left = matching(may, keys, key, number, null_safe, "left_anti")
    return left if rest is None else rest.unionAll(left)


def replaced(current: DataFrame, keys: DataFrame, key: tuple[str, ...] | list[str], number: int, values: dict[str, object]) -> DataFrame:
    """The rows whose key is among the keys take values; a null never is."""
    may, rest = parted(current, keys, key, number)
    put = keys.select(*(f"`{c}`" for c in key)).distinct()
    for c, v in values.items():
        put = put.withColumn(f"new|{c}", F.lit(v).cast(current.schema[c].dataType))
    done = update(may, sent(put, number), {c: c for c in key}, {c: f"new|{c}" for c in values})
    return done if rest is None else rest.unionAll(done)


def clear(current: DataFrame, hit: DataFrame, key: tuple[str, ...] | list[str], columns: list[str], extra: dict[str, Column] | None = None) -> DataFrame:
    """The columns set to null in the rows hit."""
    empty = hit.select(*(F.col(f"`{c}`") for c in key)).distinct()
    for c in columns:
        empty = empty.withColumn(f"clear|{c}", F.lit(None).cast(current.schema[c].dataType))
    return update(current, empty, {c: c for c in key}, {c: f"clear|{c}" for c in columns}, extra, nullable=True)
