"""A path query to a DataFrame.

Each element of a path is a scan whose columns are named ``t<place>|<column>``; links join it
to the element in context, and all filters come after the joins, as written. Two rewrites are
made here, as Catalyst can't know of the keys: entity and attribute queries that put out
nothing but the context become a chain of semi-joins, which neither multiplies rows nor
needs their removal; and a link over several foreign keys, an OR of equalities, becomes a union
of equi-joins of which each takes the pairs that none before it took.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.errors import BadRequest, Conflict
from pathloom.operators import aggregates, binning, paging
from pathloom.operators.predicates import condition, literal
from pathloom.plans import syntax as S
from pathloom.plans.model import Model, Table, Type

Pairs = tuple[tuple[str, str], ...]


@dataclass
class Element:
    place: int
    table: Table
    parent: int | None = None
    how: str = "inner"
    links: list[Pairs] = field(default_factory=list)  # alternatives, each of (parent's column, own column)
    marks: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)  # further columns of the rows, each by what adds it


def at(place: int, column: str) -> str:
    return f"t{place}|{column}"


def ref(place: int, column: str) -> Column:
    return F.col(f"`{at(place, column)}`")


@dataclass
class Output:
    name: str
    column: Column
    type: Type | None
    uses: set[int]


class Plan:
    """scan gives a table's rows and visible columns; rights gives expressions for summaries of rights."""

    def __init__(self, model: Model, scan: Callable[[Table], DataFrame], visible: Callable[[Table], list[str]] | None = None, rights: Callable | None = None):
        self.model, self.scan, self.rights = model, scan, rights
        self.visible = visible or (lambda t: list(t.columns))
        self.elements: list[Element] = []
        self.aliases: dict[str, int] = {}
        self.context = 0
        self.filters: list[tuple[object, int]] = []

    # names

    def alias(self, name: str | None, place: int) -> None:
        if name is not None:
            if name in self.aliases:
                raise BadRequest(f"alias {name} is used twice")
            self.aliases[name] = place

    def locate(self, name: S.Name, context: int | None = None) -> tuple[int, str]:
        """The element and column of a name; the column may be *."""
        here = self.context if context is None else context
        parts = name.parts
        if len(parts) == 1:
            place, column = here, parts[0]
        elif len(parts) == 2 and parts[0] in self.aliases:
            place, column = self.aliases[parts[0]], parts[1]
        elif len(parts) in (2, 3):
            table = self.model.table(*parts[:-1])
            table.column(parts[-1])
            places = [e.place for e in self.elements if e.table is table]
            if len(places) != 1:
                raise Conflict(f"{name} is not a column of one element of the path")
            place, column = places[0], parts[-1]
        else:
            raise BadRequest(f"{name} is not a column's name")
        if column != "*":
            self.elements[place].table.column(column)
            if column not in self.visible(self.elements[place].table):
                raise Conflict(f"no column {column}")
        return place, column

    def typed(self, name: S.Name, context: int) -> list[tuple[Column, Type]]:
        place, column = self.locate(name, context)
        table = self.elements[place].table
        return [(ref(place, c), table.columns[c].type) for c in (self.visible(table) if column == "*" else [column])]

    # links

    def step(self, step) -> None:
        if isinstance(step, S.TableStep):
            table = self.model.table(*step.name.parts)
            if self.elements:
                self.add(Element(len(self.elements), table, self.context, links=self.between(self.elements[self.context].table, table)))
            else:
                self.add(Element(0, table))
            self.alias(step.alias, self.context)
        elif isinstance(step, S.ColumnsStep):
            self.columns_step(step)
            self.alias(step.alias, self.context)
        elif isinstance(step, S.FilterStep):
            condition(step.condition, lambda n: self.typed(n, self.context))  # errors show at their place
            self.filters.append((step.condition, self.context))
        else:
            if step.alias not in self.aliases:
                raise BadRequest(f"no alias {step.alias}")
            self.context = self.aliases[step.alias]

    def add(self, e: Element) -> None:
        self.elements.append(e)
        self.context = e.place

    def between(self, left: Table, right: Table) -> list[Pairs]:
        if left is right:
            raise Conflict(f"a link of {left.name} with itself is ambiguous")
        out = [tuple(zip(f.target_columns, f.columns)) for t, f in self.model.references(left) if t is right]
        out += [tuple(zip(f.columns, f.target_columns)) for f in left.fkeys if f.target == right.id]
        if not out:
            raise Conflict(f"no link between {left.name} and {right.name}")
        return out

    def columns_step(self, step: S.ColumnsStep) -> None:
        if step.right is not None:
            left = [self.locate(n) for n in step.left]
            if len({p for p, _ in left}) != 1 or any(c == "*" for _, c in left):
                raise BadRequest("the left columns of a link must be of one element")
            if len(step.left) != len(step.right):
                raise BadRequest("a link needs as many columns on both sides")
            first = step.right[0].parts
            if len(first) < 2:
                raise BadRequest("the first right column of a link must name its table")
            table = self.model.table(*first[:-1])
            right = []
            for n in step.right:
                if len(n.parts) > 1 and self.model.table(*n.parts[:-1]) is not table:
                    raise BadRequest("the right columns of a link must be of one table")
                right.append(table.column(n.parts[-1]).name)
            self.add(Element(len(self.elements), table, left[0][0], step.outer or "inner", [tuple(zip((c for _, c in left), right))]))
            return
        # columns of the context (or of an alias), or of a table that is linked with it
        first = step.left[0].parts
        if len(first) == 1 or len(first) == 2 and first[0] in self.aliases:
            places = {self.locate(n) for n in step.left}
            if len({p for p, _ in places}) != 1:
                raise BadRequest("the columns of a link must be of one element")
            place, columns = next(iter(places))[0], {c for _, c in places}
            table = self.elements[place].table
            found = [(t, tuple(zip(f.target_columns, f.columns))) for t, f in self.model.references(table) if set(f.target_columns) == columns]
            found += [(self.model.table(*f.target), tuple(zip(f.columns, f.target_columns))) for f in table.fkeys if set(f.columns) == columns]
        else:
            place, here = self.context, self.elements[self.context].table
            table = self.model.table(*first[:-1])
            columns = {table.column(n.parts[-1]).name for n in step.left}
            found = [(table, tuple(zip(f.columns, f.target_columns))) for f in here.fkeys if f.target == table.id and set(f.target_columns) == columns]
            found += [(table, tuple(zip(f.target_columns, f.columns))) for f in table.fkeys if f.target == here.id and set(f.columns) == columns]
        if len(found) != 1:
            raise Conflict(f"{'no' if not found else 'more than one'} link over {', '.join(map(str, step.left))}")
        self.add(Element(len(self.elements), found[0][0], place, step.outer or "inner", [found[0][1]]))

    # rows

    def rows(self, e: Element) -> DataFrame:
        df = self.scan(e.table)
        columns = [*df.columns, *e.marks]
        for add in e.marks.values():
            df = add(df)
        return df.select(*(F.col(f"`{c}`").alias(at(e.place, c)) for c in columns))

    def on(self, e: Element) -> list[Column]:
        return [reduce(and_, (ref(e.parent, a) == ref(e.place, b) for a, b in pairs)) for pairs in e.links]

    def join(self, df: DataFrame, e: Element) -> DataFrame:
        right, on = self.rows(e), self.on(e)
        if len(on) == 1:
            return df.join(right, on[0], {"inner": "inner", "left": "left", "right": "right", "full": "full"}[e.how])
        parts = []
        for k, cond in enumerate(on):
            for earlier in on[:k]:
                cond = cond & ~F.coalesce(earlier, F.lit(False))
            parts.append(df.join(right, cond, "inner"))
        return reduce(DataFrame.unionAll, parts)

    def product(self) -> DataFrame:
        df = self.rows(self.elements[0])
        for e in self.elements[1:]:
            df = self.join(df, e)
        for cond, context in self.filters:
            df = df.where(condition(cond, lambda n, c=context: self.typed(n, c)))
        return df

    def places(self, node, context: int) -> set[int]:
        if isinstance(node, S.Not):
            return self.places(node.term, context)
        if isinstance(node, (S.And, S.Or)):
            return set().union(*(self.places(t, context) for t in node.terms))
        return {self.locate(node.left, context)[0]}

    def semi(self) -> DataFrame | None:
        """The context's rows by semi-joins, where all links are inner and each filter is of one element."""
        if any(e.how != "inner" for e in self.elements) or any(len(self.places(f, c)) > 1 for f, c in self.filters):
            return None
        near: dict[int, list[Element]] = {}
        for e in self.elements[1:]:
            near.setdefault(e.parent, []).append(e)
            near.setdefault(e.place, []).append(e)

        def reduced(place: int, came: int | None) -> DataFrame:
            df = self.rows(self.elements[place])
            for cond, context in self.filters:
                if self.places(cond, context) == {place}:
                    df = df.where(condition(cond, lambda n, c=context: self.typed(n, c)))
            for e in near.get(place, []):
                other = e.parent if e.place == place else e.place
                if other != came:
                    # an OR of equalities is no hash join; semi-joins by each alternative are
                    rest, on = reduced(other, place), self.on(e)
                    df = df.join(rest, on[0], "left_semi") if len(on) == 1 else self.any_semi(df, rest, on)
            return df

        return reduced(self.context, None)

    @staticmethod
    def any_semi(df: DataFrame, rest: DataFrame, on: list[Column]) -> DataFrame:
        parts, left = [], df
        for cond in on:
            parts.append(left.join(rest, cond, "left_semi"))
            left = left.join(rest, cond, "left_anti")
        return reduce(DataFrame.unionAll, parts)

    # projections

    def expand(self, items: list[S.Item], grouped: bool = False) -> list[Output]:
        out: list[Output] = []
        for i in items:
            place, column = self.locate(i.name)
            table = self.elements[place].table
            if i.aggregate:
                if grouped is False:
                    raise BadRequest("an aggregate is not allowed here")
                if i.alias is None:
                    raise BadRequest(f"{i.aggregate} needs a name")
                star = column == "*"
                record = F.struct(*(ref(place, c).alias(c) for c in self.visible(table))) if star else None
                c, kind = aggregates.aggregate(i.aggregate, None if star else ref(place, column), None if star else table.columns[column].type, record)
                out.append(Output(i.alias, c, kind, {place}))
            elif i.rights:
                if column != "RID" or self.rights is None:
                    raise Conflict("a summary of rights is of RID")
                summary, marks = self.rights(table, place, i.rights == "tcrs")
                self.elements[place].marks.update(marks)
                out.append(Output(i.alias or i.rights, summary, None, {place}))
            elif column == "*":
                if i.alias is not None:
                    raise BadRequest("* can't be renamed")
                prefix = f"{i.name.parts[0]}:" if len(i.name.parts) > 1 else ""
                out += [Output(prefix + c, ref(place, c), table.columns[c].type, {place}) for c in self.visible(table)]
            elif i.bin:
                out.append(Output(i.alias or column, binning.bin_of(ref(place, column), table.columns[column].type, *i.bin), None, {place}))
            else:
                out.append(Output(i.alias or column, ref(place, column), table.columns[column].type, {place}))
        return out

    @staticmethod
    def once(outputs: list[Output]) -> None:
        names = [o.name for o in outputs]
        if len(set(names)) < len(names):
            raise BadRequest("the result's columns need different names")

    def distinct(self, outputs: list[Output]) -> DataFrame:
        """Each entity of the context once, with the least of the rows that it is joined with."""
        e = self.elements[self.context]
        cols = [o.column.alias(o.name) for o in outputs]
        if len(self.elements) == 1:
            return self.product().select(*cols)
        key = e.table.primary()
        key = [c for c in key if c in self.visible(e.table)] == list(key) and key if key else None
        names = list(key or self.visible(e.table))
        own = all(o.uses == {e.place} for o in outputs)
        df = self.semi() if own else None
        if df is not None:
            return df.select(*cols) if key else df.select(*cols, *(ref(e.place, c).alias(f"key|{c}") for c in names)).dropDuplicates([f"key|{c}" for c in names]).drop(*(f"key|{c}" for c in names))
        keyed = self.product().select(*cols, *(ref(e.place, c).alias(f"key|{c}") for c in names))
        if own:
            return keyed.dropDuplicates([f"key|{c}" for c in names]).drop(*(f"key|{c}" for c in names))
        least = keyed.groupBy(*(f"`key|{c}`" for c in names)).agg(F.min(F.struct(*(f"`{o.name}`" for o in outputs))).alias("row"))
        return least.select(*(F.col("row")[o.name].alias(o.name) for o in outputs))

    def run(self, q: S.Query, limit: int | None = None) -> DataFrame:
        for s in q.steps:
            self.step(s)
        if q.api == "entity":
            table = self.elements[self.context].table
            outputs = [Output(c, ref(self.context, c), table.columns[c].type, {self.context}) for c in self.visible(table)]
            df = self.distinct(outputs)
        elif q.api == "attribute":
            outputs = self.expand(q.items)
            self.once(outputs)
            df = self.distinct(outputs)
        elif q.api == "aggregate":
            if q.sort is not None:
                raise BadRequest("an aggregate has one row and no order")
            if any(i.aggregate is None for i in q.leaves):
                raise BadRequest("aggregate queries put out aggregates only")
            outputs = self.expand(q.leaves, grouped=True)
            self.once(outputs)
            df = self.product().agg(*(o.column.alias(o.name) for o in outputs))
        else:
            keys, plain = self.expand(q.items), self.expand(q.leaves, grouped=True)
            outputs = keys + plain
            self.once(outputs)
            flags = [i.aggregate is not None for i in q.leaves for _ in self.expand([i], grouped=True)]
            grouped = self.product().groupBy(*(k.column.alias(k.name) for k in keys))
            leaves = [(o.column if agg else aggregates.example(o.column)).alias(o.name) for o, agg in zip(plain, flags)]
            df = grouped.agg(*leaves) if leaves else self.product().select(*(k.column.alias(k.name) for k in keys)).distinct()
        types = {o.name: o.type for o in outputs}

        def bound(name: str, value: str | None) -> Column | None:
            kind = types[name]
            if value is None:
                return None
            if kind is None or kind.array:
                return F.from_json(F.lit(value), df.schema[name].dataType.simpleString())
            return literal(value, kind)

        return paging.page(df, q.sort, q.after, q.before, limit, bound)
