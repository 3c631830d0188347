"""Schemas, tables, columns, keys and foreign keys, as plain metadata beside the data."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from pathloom.errors import BadRequest, Conflict, NotFound

TEXT = ("text", "longtext", "markdown", "gene_sequence", "url", "uri", "curie", "row_uri", "row_curie", "color_rgb_hex", "row_rid", "row_rcb", "row_rmb", "uuid", "interval", "timetz", "json", "jsonb")
SPARK = {
    "boolean": "boolean", "int2": "smallint", "int4": "int", "int8": "bigint", "serial2": "smallint", "serial4": "int", "serial8": "bigint", "oid": "bigint",
    "float4": "float", "float8": "double", "numeric": "decimal(38,18)", "date": "date", "timestamptz": "timestamp", "timestamp": "timestamp_ntz", "time": "string",
    "row_rct": "timestamp", "row_rmt": "timestamp", **dict.fromkeys(TEXT, "string"),
}
ALIASES = {"integer": "int4", "int": "int4", "bigint": "int8", "smallint": "int2", "real": "float4", "double precision": "float8", "double": "float8", "character varying": "text", "varchar": "text", "string": "text", "bool": "boolean", "timestamp with time zone": "timestamptz", "timestamp without time zone": "timestamp", "serial": "serial4", "bigserial": "serial8"}
INTS, FLOATS, TIMES = {"int2", "int4", "int8", "serial2", "serial4", "serial8", "oid"}, {"float4", "float8"}, {"date", "timestamptz", "timestamp", "row_rct", "row_rmt"}
SYSTEM = ("RID", "RCT", "RMT", "RCB", "RMB")


@dataclass
class Type:
    """A base type, or an array of one; scale is that of a numeric type declared with one."""

    name: str
    array: bool = False
    scale: int | None = None

    @classmethod
    def of(cls, text: str) -> "Type":
        array = text.endswith("[]")
        base = text[:-2] if array else text
        base = ALIASES.get(base.lower(), base)
        if m := re.fullmatch(r"(?:numeric|decimal)(?:\(\d+, *(\d+)\))?", base.lower()):
            return cls("numeric", array, int(m[1]) if m[1] else None)
        if m := re.fullmatch(r"[a-z]+_(uri|curie|rid|rct|rmt|rcb|rmb)", base):  # domains of identifiers and system columns, whatever their prefix
            base = f"row_{m[1]}"
        if base not in SPARK:
            raise BadRequest(f"unknown type {text}")
        return cls(base, array)

    @classmethod
    def of_spark(cls, kind: T.DataType) -> "Type":
        if isinstance(kind, T.ArrayType):
            element = cls.of_spark(kind.elementType)
            return cls(element.name, True, element.scale)
        names = {T.BooleanType: "boolean", T.ByteType: "int2", T.ShortType: "int2", T.IntegerType: "int4", T.LongType: "int8", T.FloatType: "float4", T.DoubleType: "float8", T.DecimalType: "numeric", T.DateType: "date", T.TimestampType: "timestamptz", T.TimestampNTZType: "timestamp"}
        return cls(names.get(type(kind), "text"), scale=kind.scale if isinstance(kind, T.DecimalType) else None)

    @property
    def spark(self) -> str:
        return f"array<{SPARK[self.name]}>" if self.array else SPARK[self.name]

    @property
    def declared(self) -> str:
        return self.name + (f"(38,{self.scale})" if self.scale is not None else "") + "[]" * self.array

    @property
    def numeric(self) -> bool:
        return not self.array and (self.name in INTS or self.name in FLOATS or self.name == "numeric")

    @property
    def ordered(self) -> bool:
        return self.name not in ("json", "jsonb", "boolean", "uuid", "oid")


@dataclass
class Column:
    name: str
    type: Type
    nullok: bool = True
    default: object = None
    comment: str | None = None
    annotations: dict = field(default_factory=dict)
    acls: dict = field(default_factory=dict)
    acl_bindings: dict = field(default_factory=dict)


@dataclass
class Key:
    columns: tuple[str, ...]
    name: str | None = None
    enforced: bool = True
    comment: str | None = None
    annotations: dict = field(default_factory=dict)


@dataclass
class ForeignKey:
    columns: tuple[str, ...]
    target: tuple[str, str]
    target_columns: tuple[str, ...]
    name: str | None = None
    enforced: bool = True
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"
    comment: str | None = None
    annotations: dict = field(default_factory=dict)
    acls: dict = field(default_factory=dict)
    acl_bindings: dict = field(default_factory=dict)


@dataclass
class Table:
    schema: str
    name: str
    columns: dict[str, Column] = field(default_factory=dict)
    keys: list[Key] = field(default_factory=list)
    fkeys: list[ForeignKey] = field(default_factory=list)
    kind: str = "table"
    comment: str | None = None
    annotations: dict = field(default_factory=dict)
    acls: dict = field(default_factory=dict)
    acl_bindings: dict = field(default_factory=dict)
    history: bool = True

    @property
    def id(self) -> tuple[str, str]:
        return self.schema, self.name

    def column(self, name: str) -> Column:
        if name not in self.columns:
            raise Conflict(f"no column {name} in {self.schema}:{self.name}")
        return self.columns[name]

    def primary(self) -> tuple[str, ...] | None:
        """The shortest key of columns that are never null."""
        good = [k.columns for k in self.keys if all(not self.columns[c].nullok for c in k.columns)]
        return min(good, key=len, default=None)


@dataclass
class Schema:
    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    comment: str | None = None
    annotations: dict = field(default_factory=dict)
    acls: dict = field(default_factory=dict)


class Model:
    def __init__(self):
        self.schemas: dict[str, Schema] = {}
        self.acls: dict = {"owner": [], "enumerate": ["*"], "select": ["*"], "insert": ["*"], "update": ["*"], "delete": ["*"], "write": ["*"], "create": ["*"]}
        self.annotations: dict = {}

    def tables(self) -> list[Table]:
        return [t for s in self.schemas.values() for t in s.tables.values()]

    def table(self, *name: str) -> Table:
        """schema and table, or a table's name that only one schema has."""
        if len(name) == 2:
            s = self.schemas.get(name[0])
            if not s or name[1] not in s.tables:
                raise Conflict(f"no table {':'.join(name)}")
            return s.tables[name[1]]
        if len(name) != 1:
            raise BadRequest(f"{':'.join(name)} is not a table's name")
        found = [t for t in self.tables() if t.name == name[0]]
        if len(found) != 1:
            raise Conflict(f"{'no' if not found else 'more than one'} table {name[0]}")
        return found[0]

    def create_schema(self, name: str) -> Schema:
        if name in self.schemas:
            raise Conflict(f"schema {name} exists")
        self.schemas[name] = Schema(name)
        return self.schemas[name]

    def drop_schema(self, name: str) -> None:
        if name not in self.schemas:
            raise NotFound(f"no schema {name}")
        if self.schemas[name].tables:
            raise Conflict(f"schema {name} still has tables")
        del self.schemas[name]

    def add_table(self, table: Table) -> Table:
        schema = self.schemas.get(table.schema) or self.create_schema(table.schema)
        if table.name in schema.tables:
            raise Conflict(f"table {table.name} exists")
        for name in [table.name, *table.columns]:
            if len(name.encode()) > 63:
                raise BadRequest(f"{name} is longer than 63 bytes")
        schema.tables[table.name] = table
        return table

    def add_key(self, table: Table, key: Key) -> None:
        for c in key.columns:
            table.column(c)
        if any(set(k.columns) == set(key.columns) for k in table.keys):
            raise Conflict("the table has this key")
        table.keys.append(key)

    def drop_key(self, table: Table, columns: tuple[str, ...]) -> None:
        """A key, enforced or not, that no enforced foreign key needs."""
        key = next((k for k in table.keys if set(k.columns) == set(columns)), None)
        if key is None:
            raise NotFound(f"no key ({', '.join(columns)}) in {table.name}")
        if any(f.enforced and set(f.target_columns) == set(columns) for _, f in self.references(table)):
            raise Conflict("a foreign key refers to this key")
        table.keys.remove(key)

    def fkey(self, table: Table, columns: tuple[str, ...], target: tuple[str, str] | None = None) -> ForeignKey:
        found = [f for f in table.fkeys if set(f.columns) == set(columns) and target in (None, f.target)]
        if len(found) != 1:
            raise NotFound(f"{'no' if not found else 'more than one'} foreign key ({', '.join(columns)}) in {table.name}")
        return found[0]

    def drop_fkey(self, table: Table, columns: tuple[str, ...], target: tuple[str, str] | None = None) -> None:
        table.fkeys.remove(self.fkey(table, columns, target))

    def add_fkey(self, table: Table, fkey: ForeignKey) -> None:
        target = self.table(*fkey.target)
        if len(fkey.columns) != len(fkey.target_columns) or not fkey.columns:
            raise BadRequest("a foreign key needs as many columns as its target")
        for c in fkey.columns:
            table.column(c)
        if fkey.enforced and not any(set(k.columns) == set(fkey.target_columns) for k in target.keys):
            raise Conflict("a foreign key's target must be a key")
        table.fkeys.append(fkey)

    def references(self, target: Table) -> list[tuple[Table, ForeignKey]]:
        return [(t, f) for t in self.tables() for f in t.fkeys if f.target == target.id]

    # documents

    @staticmethod
    def table_of(doc: dict, schema: str) -> Table:
        t = Table(doc.get("schema_name", schema), doc["table_name"], kind=doc.get("kind", "table"), comment=doc.get("comment"), annotations=doc.get("annotations", {}), acls=doc.get("acls", {}), acl_bindings=doc.get("acl_bindings", {}), history=doc.get("history", True))
        for c in doc.get("column_definitions", []):
            kind = c["type"]["typename"] if isinstance(c["type"], dict) else c["type"]
            t.columns[c["name"]] = Column(c["name"], Type.of(kind), c.get("nullok", True), c.get("default"), c.get("comment"), c.get("annotations", {}), c.get("acls", {}), c.get("acl_bindings", {}))
        for k in doc.get("keys", []):
            t.keys.append(Key(tuple(k["unique_columns"]), (k.get("names") or [None])[0], k.get("enforced", True), comment=k.get("comment"), annotations=k.get("annotations", {})))
        for k in t.keys:
            for c in k.columns:
                t.column(c)
        return t

    @staticmethod
    def fkeys_of(doc: dict, schema: str) -> list[ForeignKey]:
        out = []
        for f in doc.get("foreign_keys", []):
            target = f["referenced_columns"][0]
            out.append(ForeignKey(tuple(c["column_name"] for c in f["foreign_key_columns"]), (target.get("schema_name", schema), target["table_name"]), tuple(c["column_name"] for c in f["referenced_columns"]), (f.get("names") or [None])[0], f.get("enforced", True), on_delete=f.get("on_delete", "NO ACTION"), on_update=f.get("on_update", "NO ACTION"), acls=f.get("acls", {}), acl_bindings=f.get("acl_bindings", {})))
        return out

    def load(self, doc: dict) -> list[Table]:
        """A model document, or a schema's; foreign keys follow when all tables stand."""
        made, later = [], []
        for name, s in (doc.get("schemas") or {doc["schema_name"]: doc}).items():
            schema = self.schemas.get(name) or self.create_schema(name)
            schema.comment, schema.annotations, schema.acls = s.get("comment"), s.get("annotations", {}), s.get("acls", {})
            for t in s.get("tables", {}).values():
                made.append(self.add_table(self.table_of(t, name)))
                later.append((made[-1], self.fkeys_of(t, name)))
        for t, fkeys in later:
            for f in fkeys:
                self.add_fkey(t, f)
        return made

    def document(self) -> dict:
        def table(t: Table) -> dict:
            return {
                "schema_name": t.schema, "table_name": t.name, "kind": t.kind, "history": t.history, "comment": t.comment, "annotations": t.annotations, "acls": t.acls, "acl_bindings": t.acl_bindings,
                "column_definitions": [{"name": c.name, "type": {"typename": c.type.declared}, "nullok": c.nullok, "default": c.default, "comment": c.comment, "annotations": c.annotations, "acls": c.acls, "acl_bindings": c.acl_bindings} for c in t.columns.values()],
                "keys": [{"unique_columns": list(k.columns), "names": [k.name] if k.name else [], "enforced": k.enforced, "comment": k.comment, "annotations": k.annotations} for k in t.keys],
                "foreign_keys": [{"foreign_key_columns": [{"schema_name": t.schema, "table_name": t.name, "column_name": c} for c in f.columns], "referenced_columns": [{"schema_name": f.target[0], "table_name": f.target[1], "column_name": c} for c in f.target_columns], "names": [f.name] if f.name else [], "enforced": f.enforced, "on_delete": f.on_delete, "on_update": f.on_update, "acls": f.acls, "acl_bindings": f.acl_bindings} for f in t.fkeys],
            }

        return {"acls": self.acls, "annotations": self.annotations, "schemas": {s.name: {"schema_name": s.name, "comment": s.comment, "annotations": s.annotations, "acls": s.acls, "tables": {t.name: table(t) for t in s.tables.values()}} for s in self.schemas.values()}}
