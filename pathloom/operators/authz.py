"""Access rights: static decisions over the model, and dynamic ones compiled into the queries.

A static decision is True, False, or None where a binding decides row by row. Rows that no
binding allows are filtered out of the scan, before any filter of the query; cells that no
binding allows are null there.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.errors import BadRequest
from pathloom.plans import syntax as S
from pathloom.plans.model import Column as ModelColumn
from pathloom.plans.model import Model, Table

#: Having one of these is having the right as well.
IMPLIED = {
    "enumerate": {"select", "insert", "update", "delete", "write", "create", "owner"}, "select": {"update", "delete", "write", "owner"}, "insert": {"write", "owner"},
    "update": {"write", "owner"}, "delete": {"write", "owner"}, "write": {"owner"}, "create": {"owner"}, "owner": set(),
}


def allowed(acls: dict, right: str, roles: set[str]) -> bool | None:
    """None if the ACLs don't speak of the right at all."""
    names = {right, *IMPLIED[right]} & set(acls)
    members = {m for n in names for m in acls[n] or []}
    if members & (roles | {"*"}):
        return True
    return False if right in acls and acls[right] is not None else None


def static(model: Model, table: Table, right: str, roles: set[str], column: ModelColumn | None = None) -> bool | None:
    """Of the nearest of column, table, schema and catalog that speaks of the right; owners of what is around own what is in it. Anonymous clients read at most."""
    if roles <= {"*"} and right not in ("enumerate", "select"):
        return False
    chain = [*([column.acls] if column else []), table.acls, model.schemas[table.schema].acls, model.acls]
    if any(set(a.get("owner") or []) & (roles | {"*"}) for a in chain):
        return True
    decided = next((d for a in chain if (d := allowed(a, right, roles)) is not None), False)
    if decided:
        return True
    bindings = (column.acl_bindings if column else {}) or {}
    bindings = {**(table.acl_bindings or {}), **bindings}
    return None if any(b and in_scope(b, right, roles) for b in bindings.values()) else False


def in_scope(binding: dict, right: str, roles: set[str]) -> bool:
    types = set(binding.get("types", []))
    return bool(({right, *IMPLIED[right]} & types)) and bool(set(binding.get("scope_acl", ["*"])) & (roles | {"*"}))


def steps_of(projection) -> tuple[list, str]:
    """A binding's projection as path steps and the column at its end."""
    if isinstance(projection, str):
        return [], projection
    steps: list = []
    for part in projection[:-1]:
        if "and" in part or "or" in part or "filter" in part:
            steps.append(S.FilterStep(_filter(part)))
        elif "context" in part:
            steps.append(S.ResetStep(part["context"]))
        elif "inbound" in part or "outbound" in part:
            steps.append(part)
        else:
            raise BadRequest(f"unknown part {part} of a projection")
    return steps, projection[-1]


def _filter(part: dict):
    if "and" in part:
        out = S.And(tuple(_filter(p) for p in part["and"]))
    elif "or" in part:
        out = S.Or(tuple(_filter(p) for p in part["or"]))
    else:
        name = part["filter"]
        parts = tuple(name) if isinstance(name, list) else (name,)
        op = part.get("operator", "=").strip(":")
        out = S.Predicate(S.Name(parts), op, () if op == "null" else (str(part.get("operand", "")),))
    return S.Not(out) if part.get("negate") else out


def _link(plan, part: dict) -> None:
    """Walk a foreign key by its (schema, constraint) name."""
    from pathloom.plans.planner import Element

    name, inbound = (part["inbound"], True) if "inbound" in part else (part["outbound"], False)
    here = plan.elements[plan.context].table
    for t in plan.model.tables():
        for f in t.fkeys:
            if f.name and list(f.name) == list(name):
                if inbound and f.target == here.id:
                    plan.add(Element(len(plan.elements), t, plan.context, links=[tuple(zip(f.target_columns, f.columns))]))
                elif not inbound and t is here:
                    plan.add(Element(len(plan.elements), plan.model.table(*f.target), plan.context, links=[tuple(zip(f.columns, f.target_columns))]))
                else:
                    continue
                plan.alias(part.get("alias"), plan.context)
                return
    raise BadRequest(f"no foreign key {name}")


def test(c: Column, kind, projection_type: str, roles: set[str]) -> Column:
    if projection_type == "nonnull":
        return c.isNotNull()
    who = sorted(roles | {"*"})
    return F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, who))), F.lit(False)) if kind.array else F.coalesce(c.isin(who), F.lit(False))


def binding_clause(model: Model, table: Table, binding: dict, roles: set[str], raw) -> tuple[Column | None, DataFrame | None]:
    """Which rows the binding allows: a condition on the row itself, or the allowed rows' keys."""
    from pathloom.operators.predicates import condition
    from pathloom.plans.planner import Plan, ref

    steps, column = steps_of(binding["projection"])
    kind = binding.get("projection_type")
    if not any(isinstance(s, dict) for s in steps):
        def typed(n: S.Name):
            return [(F.col(f"`{n.parts[-1]}`"), table.column(n.parts[-1]).type)]

        c = table.column(column)
        own = [test(F.col(f"`{column}`"), c.type, kind or "acl", roles)]
        own += [F.coalesce(condition(s.condition, typed), F.lit(False)) for s in steps if isinstance(s, S.FilterStep)]
        return reduce(lambda a, b: a & b, own), None
    plan = Plan(model, raw)
    plan.step(S.TableStep(S.Name(table.id), "base"))
    for s in steps:
        _link(plan, s) if isinstance(s, dict) else plan.step(s)
    c = plan.elements[plan.context].table.column(column)
    key = table.primary() or tuple(table.columns)
    hits = plan.product().where(test(ref(plan.context, column), c.type, kind or "acl", roles))
    return None, hits.select(*(ref(0, k).alias(f"ok|{k}") for k in key)).distinct()


def with_decision(df: DataFrame, model: Model, table: Table, bindings: dict, right: str, roles: set[str], raw, name: str) -> DataFrame:
    """df with a boolean column: whether any binding allows the row. Path bindings are joined by key, at most one match a row."""
    clauses: list[Column] = []
    for k, b in enumerate(x for x in bindings.values() if x and in_scope(x, right, roles)):
        own, keys = binding_clause(model, table, b, roles, raw)
        if own is not None:
            clauses.append(own)
        else:
            mark = f"{name}{k}"
            keyed = keys.withColumn(mark, F.lit(True))
            cols = [c for c in keys.columns]
            df = df.join(keyed, reduce(lambda a, b: a & b, (F.col(f"`{c[3:]}`").eqNullSafe(F.col(f"`{c}`")) for c in cols)), "left").drop(*cols)
            clauses.append(F.coalesce(F.col(f"`{mark}`"), F.lit(False)))
    return df.withColumn(name, reduce(or_, clauses, F.lit(False)))


def guarded_scan(model: Model, table: Table, roles: set[str], raw, right: str = "select") -> DataFrame:
    """The table's rows and cells that the roles may see."""
    df, columns = raw(table), visible(model, table, roles)
    decision = static(model, table, right, roles)
    if decision is False:
        return df.where(F.lit(False)).select(*(f"`{c}`" for c in columns))
    if decision is None:
        df = with_decision(df, model, table, table.acl_bindings, right, roles, raw, "row|ok").where("`row|ok`")
    out = []
    for c in columns:
        col = table.columns[c]
        own = static(model, table, "select", roles, col)
        if own is None and col.acl_bindings:
            df = with_decision(df, model, table, {**table.acl_bindings, **col.acl_bindings}, "select", roles, raw, f"cell|{c}")
            out.append(F.when(F.col(f"`cell|{c}`"), F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def visible(model: Model, table: Table, roles: set[str]) -> list[str]:
    return [c.name for c in table.columns.values() if static(model, table, "select", roles, c) is not False or static(model, table, "enumerate", roles, c)] if any(c.acls or c.acl_bindings for c in table.columns.values()) else list(table.columns)


def rights_summary(model: Model, table: Table, place: int, columns: bool, roles: set[str], ref, raw) -> tuple[Column, dict]:
    """JSON of update and delete, and for tcrs of each column's update, for a row; and by name the marks that it reads, each made by a function of the rows."""
    marks: dict = {}

    def right(name: str, column: ModelColumn | None = None) -> Column:
        decision = static(model, table, name, roles, column)
        if decision is not None:
            return F.lit(decision)
        own = {k: b for k, b in {**table.acl_bindings, **(column.acl_bindings if column else {})}.items() if b and in_scope(b, name, roles)}
        mark = f"right|{name}|{'|'.join(str(id(b)) for b in own.values())}"
        marks[mark] = lambda df: with_decision(df, model, table, own, name, roles, raw, mark)
        return ref(place, mark)

    parts = [right("update").alias("update"), right("delete").alias("delete")]
    if columns:
        fixed = {"RID", "RCT", "RMT", "RCB", "RMB"}
        parts.append(F.struct(*((F.lit(False) if c.name in fixed else right("update", c)).alias(c.name) for c in table.columns.values())).alias("column_update"))
    return F.to_json(F.struct(*parts)), marks
