"""Sort orders and keyset pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.errors import BadRequest


def order(sort: list[tuple[str, bool]], reverse: bool = False) -> list[Column]:
    """Ascending with nulls last, descending with nulls first, or all of it turned around."""
    return [F.col(f"`{c}`").desc_nulls_first() if down != reverse else F.col(f"`{c}`").asc_nulls_last() for c, down in sort]


def beyond(sort: list[tuple[str, bool]], bounds: list[Column | None], before: bool) -> Column:
    """Rows that stand strictly after the bounds in the order, or before them."""
    (name, down), bound = sort[0], bounds[0]
    c = F.col(f"`{name}`")
    up = down == before  # the wanted values are the greater ones
    if bound is None:
        # null stands last ascending and first descending: only one side has rows
        here = c.isNotNull() if down != before else F.lit(False)
        same = c.isNull()
    else:
        here = (c > bound) if up else (c < bound)
        here = F.coalesce(here, F.lit(False)) | (c.isNull() if up else F.lit(False))
        same = c.eqNullSafe(bound)
    return here if len(sort) == 1 else here | (same & beyond(sort[1:], bounds[1:], before))


def page(df: DataFrame, sort: list[tuple[str, bool]] | None, after: list[str | None] | None, before: list[str | None] | None, limit: int | None, bound: Callable[[str, str | None], Column | None]) -> DataFrame:
    if sort is None:
        return df if limit is None else df.limit(limit)
    for name, _ in sort:
        if name not in df.columns:
            raise BadRequest(f"{name} is not in the result")
    if before is not None and after is None and limit is None:
        raise BadRequest("@before needs a limit, or @after too")
    for keys, is_before in ((after, False), (before, True)):
        if keys is not None:
            if len(keys) != len(sort):
                raise BadRequest("a page key needs as many values as the sort")
            df = df.where(beyond(sort, [bound(n, v) for (n, _), v in zip(sort, keys)], is_before))
    if before is not None and after is None:
        return df.orderBy(*order(sort, reverse=True)).limit(limit).orderBy(*order(sort))
    df = df.orderBy(*order(sort))
    return df if limit is None else df.limit(limit)
