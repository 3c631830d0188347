"""Catalogs: a model, its tables' rows, their history, and path queries over them."""

from __future__ import annotations

import copy
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathloom.errors import BadRequest, Conflict, Forbidden, NotFound
from pathloom.functions import rid
from pathloom.functions.text import as_text
from pathloom.operators import authz, history, mutations
from pathloom.operators.predicates import condition
from pathloom.plans import syntax as S
from pathloom.plans.model import SYSTEM, Column, ForeignKey, Key, Model, Table, Type
from pathloom.plans.planner import Plan, ref
from pathloom.sources.storage import STAGING, Folder, place, settled

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_SYMBOLS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def moment_code(t: datetime) -> str:
    n = (t.astimezone(timezone.utc) - EPOCH) // timedelta(microseconds=1) << 1
    out = ""
    while n:
        out, n = _SYMBOLS[n & 31] + out, n >> 5
    return re.sub(r"(?<=.)(?=(.{4})+$)", "-", out) or "0"


def moment_of(text: str) -> datetime:
    """A snapshot's name: the code of its microseconds, or an ISO time."""
    raw = text.upper().translate(str.maketrans("OIL", "011", "-"))
    if len(raw) <= 13 and all(c in _SYMBOLS for c in raw) and not re.fullmatch(r"\d{4}-\d\d-\d\d", text):
        n = reduce(lambda a, c: a << 5 | _SYMBOLS.index(c), raw, 0)
        return EPOCH + timedelta(microseconds=n >> 1)
    try:
        t = datetime.fromisoformat(text)
    except ValueError as e:
        raise BadRequest(f"{text} is not a time") from e
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


@dataclass
class Client:
    id: str | None = None
    roles: frozenset[str] = frozenset({"*"})

    @property
    def all_roles(self) -> set[str]:
        return set(self.roles) | {"*"} | ({self.id} if self.id else set())

    @property
    def anonymous(self) -> bool:
        return self.id is None and set(self.roles) <= {"*"}


#: Who calls a method without naming a client: the program itself, which is not anonymous.
LOCAL = Client(roles=frozenset({"*", "local"}))
#: Directories of a table after which a write makes one of them all.
PARTS = 64


@dataclass
class Change:
    """A change of the rows that have some keys: how gives any part of the table, with all of its rows of those keys, as it is afterwards."""

    keys: DataFrame
    key: list[str]
    how: Callable[[DataFrame], DataFrame]
    null_safe: bool = False


@dataclass
class Written:
    """What happened in a write, for whoever listens."""

    table: tuple[str, str]
    kind: str
    at: datetime


class Catalog:
    """A model and its tables' rows. With ``root``, both are kept in that folder, and a catalog that is made over a folder in use goes on where the last one stopped; tables that were registered and never written are registered again."""

    def __init__(self, spark: SparkSession, id: str = "1", root: str | None = None, require_primary_keys: bool = False, clock: Callable[[], datetime] | None = None):
        self.spark, self.id, self.require_primary_keys = spark, id, require_primary_keys
        self.folder = Folder(spark, root) if root else None
        self.files: dict[tuple[str, str], list[str]] = {}
        self.past_files: dict[tuple[str, str], list[str]] = {}
        self.model = Model()
        self.rows: dict[tuple[str, str], DataFrame] = {}
        self.past: dict[tuple[str, str], DataFrame] = {}
        self.models: list[tuple[datetime, Model]] = []
        self.changes: list[datetime] = []
        self.written: set[tuple[str, str]] = set()
        self.created: set[tuple[str, str]] = set()
        self.listeners: list[Callable[[Written], None]] = []
        self.leases: DataFrame | None = None
        self.next_rid, self.version = 1, 0
        self.clock = clock or (lambda: datetime.now(timezone.utc))
        if self.folder and (numbers := self.folder.manifests()):
            self.resume(self.folder.read(numbers[-1]))

    def resume(self, doc: dict) -> None:
        self.version, self.next_rid = doc["version"], doc["next_rid"]
        self.changes = [datetime.fromisoformat(t) for t in doc["changes"]]
        for when, document in doc["models"]:
            model = Model()
            model.load(document)
            model.acls, model.annotations = document["acls"], document["annotations"]
            self.models.append((datetime.fromisoformat(when), model))
        self.model = copy.deepcopy(self.models[-1][1]) if self.models else self.model
        for key, kept in doc["tables"].items():
            table = tuple(json.loads(key))
            if kept["rows"]:
                self.files[table], self.rows[table] = kept["rows"], self.folder.rows(StructType.fromJson(kept["schema"]), kept["rows"])
            elif kept["schema"]:
                self.rows[table] = self.spark.createDataFrame([], StructType.fromJson(kept["schema"]))
            if kept["past"]:
                self.past_files[table], self.past[table] = kept["past"], self.folder.rows(StructType.fromJson(kept["past_schema"]), kept["past"])
            if kept["written"]:
                self.written.add(table)

    def save(self) -> None:
        """A manifest of the catalog as it is; none for a catalog without a folder."""
        if not self.folder:
            return
        tables = {}
        for t in self.model.tables():
            rows, past = self.rows.get(t.id), self.past.get(t.id)
            own = t.id in self.files or t.id in self.created
            tables[json.dumps(t.id)] = {"rows": self.files.get(t.id, []), "schema": json.loads(rows.schema.json()) if own else None, "past": self.past_files.get(t.id, []), "past_schema": json.loads(past.schema.json()) if past is not None else None, "written": t.id in self.written}
        self.version += 1
        self.folder.save(self.version, {"version": self.version, "next_rid": self.next_rid, "changes": [c.isoformat() for c in self.changes], "models": [[w.isoformat(), m.document()] for w, m in self.models], "tables": tables})

    def vacuum(self, keep: int = 1) -> int:
        """Drops the files that only older versions of the catalog need, and gives their number. Snapshots stay, as history has rows of its own."""
        return self.folder.vacuum(keep) if self.folder else 0

    # the model

    def remember_model(self) -> None:
        now = self.clock()
        self.models = [m for m in self.models if m[0] != now] + [(now, copy.deepcopy(self.model))]
        self.changes.append(now)
        self.save()

    def register(self, name: str, df: DataFrame, key: tuple[str, ...] | list[tuple[str, ...]] | None = None, fkeys: list[tuple[tuple[str, ...], str, tuple[str, ...]]] = (), schema: str = "public", kind: str = "table", history: bool = False) -> Table:
        """A table over rows that exist already; keys are declared, not checked, and their columns count as never null. Its history is kept if asked for."""
        keys = [key] if isinstance(key, tuple) else list(key or [])
        keyed = {c for k in keys for c in k}
        if schema in self.model.schemas and name in self.model.schemas[schema].tables and (schema, name) not in self.rows:  # of a catalog opened again
            self.rows[schema, name] = df
            return self.model.table(schema, name)
        t = Table(schema, name, {f.name: Column(f.name, Type.of_spark(f.dataType), f.name not in keyed) for f in df.schema}, [Key(k, enforced=kind == "table") for k in keys], kind=kind, history=history)
        self.model.add_table(t)
        for cols, target, target_cols in fkeys:
            self.model.add_fkey(t, ForeignKey(cols, self.model.table(target).id, target_cols))
        self.rows[t.id] = df
        self.remember_model()
        return t

    def create(self, doc: dict) -> list[Table]:
        """A model document, a schema's or a table's; new tables are empty."""
        if "table_name" in doc:
            made = [self.model.add_table(Model.table_of(doc, doc.get("schema_name", "public")))]
            for f in Model.fkeys_of(doc, made[0].schema):
                self.model.add_fkey(made[0], f)
        else:
            made = self.model.load(doc)
        for t in made:
            if self.require_primary_keys and not set(SYSTEM) <= set(t.columns):
                raise Conflict(f"{t.name} lacks system columns")
            self.rows[t.id] = self.spark.createDataFrame([], ", ".join(f"`{c.name}` {c.type.spark}" for c in t.columns.values()))
            self.created.add(t.id)
        self.remember_model()
        return made

    def alter_table(self, table: Table, name: str | None = None, schema: str | None = None) -> None:
        old = table.id
        del self.model.schemas[old[0]].tables[old[1]]
        table.name, table.schema = name or table.name, schema or table.schema
        self.model.add_table(table)
        for t in self.model.tables():
            for f in t.fkeys:
                if f.target == old:
                    f.target = table.id
        for store in (self.rows, self.past, self.files, self.past_files):
            if old in store:
                store[table.id] = store.pop(old)
        for kept in (self.written, self.created):
            if old in kept:
                kept.remove(old)
                kept.add(table.id)
        self.remember_model()

    def drop_table(self, table: Table) -> None:
        if any(t is not table for t, _ in self.model.references(table)):
            raise Conflict(f"{table.name} is referenced")
        del self.model.schemas[table.schema].tables[table.name]
        for store in (self.rows, self.past, self.files, self.past_files):
            store.pop(table.id, None)
        self.remember_model()

    def add_key(self, table: Table, key: Key) -> None:
        """A key, or with ``enforced=False`` a pseudo-key, which rows aren't held to."""
        for c in key.columns:
            table.column(c)
        if key.enforced and table.id in self.rows:
            full = self.rows[table.id].where(reduce(and_, (F.col(f"`{c}`").isNotNull() for c in key.columns)))
            if mutations.some(full.groupBy(*(f"`{c}`" for c in key.columns)).count().where("count > 1")):
                raise Conflict(f"rows share a key ({', '.join(key.columns)})")
        self.model.add_key(table, key)
        self.remember_model()

    def drop_key(self, table: Table, columns: tuple[str, ...]) -> None:
        self.model.drop_key(table, columns)
        self.remember_model()

    def add_fkey(self, table: Table, fkey: ForeignKey) -> None:
        """A foreign key, or with ``enforced=False`` a pseudo one, which rows aren't held to."""
        self.model.add_fkey(table, fkey)
        try:
            self.check_fkeys(table, self.rows[table.id])
        except Conflict:
            table.fkeys.remove(fkey)
            raise
        self.remember_model()

    def alter_fkey(self, table: Table, columns: tuple[str, ...], name: str | None = None, on_delete: str | None = None, on_update: str | None = None) -> None:
        f = self.model.fkey(table, columns)
        for action in (on_delete, on_update):
            if action not in (None, "NO ACTION", "RESTRICT", "CASCADE", "SET NULL", "SET DEFAULT"):
                raise BadRequest(f"unknown action {action}")
        f.name, f.on_delete, f.on_update = name or f.name, on_delete or f.on_delete, on_update or f.on_update
        self.remember_model()

    def drop_fkey(self, table: Table, columns: tuple[str, ...]) -> None:
        self.model.drop_fkey(table, columns)
        self.remember_model()

    def add_column(self, table: Table, column: Column) -> None:
        if column.name in table.columns:
            raise Conflict(f"column {column.name} exists")
        if not column.nullok and column.default is None and mutations.some(self.rows[table.id]):
            raise Conflict("a column that can't be null needs a default")
        table.columns[column.name] = column
        self.put(table, self.rows[table.id].withColumn(column.name, F.lit(column.default).cast(column.type.spark)), "alter")
        self.remember_model()

    def alter_column(self, table: Table, name: str, new_name: str | None = None, type: Type | None = None, nullok: bool | None = None) -> None:
        c = table.column(name)
        df = self.rows[table.id]
        if nullok is False and mutations.some(df.where(F.col(f"`{name}`").isNull())):
            raise Conflict(f"{name} holds nulls")
        if type:
            c.type, df = type, df.withColumn(name, F.col(f"`{name}`").cast(type.spark))
        if nullok is not None:
            c.nullok = nullok
        if new_name and new_name != name:
            if new_name in table.columns:
                raise Conflict(f"column {new_name} exists")
            swap = lambda cols: tuple(new_name if x == name else x for x in cols)
            table.columns = {new_name if k == name else k: v for k, v in table.columns.items()}
            c.name, df = new_name, df.withColumnRenamed(name, new_name)
            for k in table.keys:
                k.columns = swap(k.columns)
            for f in table.fkeys:
                f.columns = swap(f.columns)
            for _, f in self.model.references(table):
                f.target_columns = swap(f.target_columns)
            if table.id in self.past:
                self.past[table.id] = self.past[table.id].withColumnRenamed(name, new_name)
        self.put(table, df, "alter")
        self.remember_model()

    def drop_column(self, table: Table, name: str) -> None:
        table.column(name)
        if any(name in f.target_columns for _, f in self.model.references(table)):
            raise Conflict(f"{name} is referenced")
        table.keys = [k for k in table.keys if name not in k.columns]
        table.fkeys = [f for f in table.fkeys if name not in f.columns]
        del table.columns[name]
        self.put(table, self.rows[table.id].drop(name), "alter")
        self.remember_model()

    def describe(self, node, comment: str | None = None, annotations: dict | None = None, acls: dict | None = None, bindings: dict | None = None) -> None:
        """Sets a model element's comment, or entries of its annotations, ACLs and bindings; a value of None takes an entry away."""
        if comment is not None:
            node.comment = comment
        for store, new in (("annotations", annotations), ("acls", acls), ("acl_bindings", bindings)):
            for k, v in (new or {}).items():
                entries = getattr(node, store)
                if v is None:
                    entries.pop(k, None)
                else:
                    if store == "acls" and k not in authz.IMPLIED:
                        raise BadRequest(f"unknown right {k}")
                    entries[k] = v
        self.remember_model()

    def meta(self, key: str | None = None) -> DataFrame:
        """The catalog's ACLs as rows of key and value."""
        found = [(k, m) for k, members in self.model.acls.items() for m in members or [] if key in (None, k)]
        return self.spark.createDataFrame(found, "key string, value string")

    # reading

    def raw(self, at: datetime | None = None) -> Callable[[Table], DataFrame]:
        """A table's rows now or at a moment, whoever asks."""

        def rows(t: Table) -> DataFrame:
            if at is None:
                return self.rows[t.id]
            if t.id not in self.past:
                if t.id in self.written:
                    raise Conflict(f"no history of {t.name} is kept")
                return self.rows[t.id]
            old = history.as_of(self.past[t.id], at)
            return old.select(*(f"`{c}`" if c in old.columns else F.lit(None).cast(t.columns[c].type.spark).alias(c) for c in t.columns))

        return rows

    def scan(self, client: Client, at: datetime | None = None, model: Model | None = None) -> Callable[[Table], DataFrame]:
        model, raw = model or self.model, self.raw(at)
        return lambda t: authz.guarded_scan(model, t, client.all_roles, raw)

    def snapshot(self, t: datetime) -> datetime:
        """The latest change up to then."""
        before = [c for c in self.changes if c <= t]
        if not before:
            raise Conflict("the catalog has no snapshot that early")
        return max(before)

    def plan(self, client: Client, at: datetime | None = None) -> Plan:
        model = self.model
        if at is not None:
            model = next((m for when, m in reversed(self.models) if when <= at), self.model)
        roles = client.all_roles
        raw = self.raw(at)
        return Plan(model, self.scan(client, at, model), lambda t: authz.visible(model, t, roles), lambda t, place, cols: authz.rights_summary(model, t, place, cols, roles, ref, raw))

    def query(self, path: str, limit: int | None = None, client: Client | None = None) -> DataFrame:
        """A path such as ``entity/A:=orders/customer/c_custkey=1``, with ``?limit=N`` or the argument; no limit gives all rows."""
        path, _, options = path.partition("?")
        for o in filter(None, re.split("[&;]", options)):
            name, _, value = o.partition("=")
            if name == "limit" and value != "none":
                if not value.isdigit():
                    raise BadRequest(f"{value} is not a limit")
                limit = int(value)
        q = S.parse(path)
        at = self.snapshot(moment_of(q.snapshot)) if q.snapshot else None
        return self.plan(client or Client(), at).run(q, limit)

    def textfacet(self, pattern: str, columns: list[tuple[str, str, str]] | None = None, client: Client | None = None) -> DataFrame:
        """Which text columns hold a value that matches (case ignored): schema, table, column."""
        scan, out = self.scan(client or Client()), []
        for t in self.model.tables():
            for c in t.columns.values():
                if (t.schema, t.name, c.name) in columns if columns is not None else c.type.spark == "string":
                    hit = scan(t).where(as_text(F.col(f"`{c.name}`"), c.type).rlike(f"(?i){pattern}")).limit(1)
                    out.append(hit.select(F.lit(t.schema).alias("schema"), F.lit(t.name).alias("table"), F.lit(c.name).alias("column")))
        return reduce(DataFrame.unionAll, out) if out else self.spark.createDataFrame([], "schema string, table string, column string")

    def entity_rid(self, text: str) -> DataFrame:
        """Where a row identifier is or was: schema, table, and when it was deleted."""
        code = rid.encode(rid.decode(F.lit(text)))
        out = []
        for t in self.model.tables():
            if "RID" in t.columns:
                where = [F.lit(t.schema).alias("schema"), F.lit(t.name).alias("table")]
                if t.id in self.past:
                    found = self.past[t.id].where(F.col("RID") == code).groupBy("RID").agg(F.max(F.coalesce(history.TO, F.lit("9999-12-31").cast("timestamp"))).alias("end"))
                    out.append(found.select(*where, F.when(F.year("end") < 9999, F.col("end")).alias("deleted_at")))
                else:
                    out.append(self.rows[t.id].where(F.col("RID") == code).select(*where, F.lit(None).cast("timestamp").alias("deleted_at")))
        return reduce(DataFrame.unionAll, out) if out else self.spark.createDataFrame([], "schema string, table string, deleted_at timestamp")

    # writing

    def store(self, table: Table, files: dict, name: str, old: DataFrame | None, whole: DataFrame | None, added: DataFrame | None) -> DataFrame:
        """The whole rows, written anew; or old ones and added ones, of which only these are written."""
        if added is None or old is None or len(files.get(table.id, [])) >= PARTS:
            parts, new = [], whole if added is None or old is None else old.unionByName(added)
        else:
            parts, new = files.get(table.id, []), added
            if self.folder and not parts and table.id not in self.created:  # the old ones aren't in the folder yet
                new = old.unionByName(added)
        relative = place(table.schema, name)
        done = settled(new, self.folder, relative)
        if self.folder:
            files[table.id] = [*parts, relative]
            return self.folder.rows(new.schema, files[table.id])
        return done if new is not added else old.unionByName(done)

    def touched(self, df: DataFrame, parts: list[str], changes: list[Change], live: bool = False) -> tuple[list[str], list[str]]:
        """Of a table's parts: the files that hold rows of the changes' keys, and the rest. Only the key columns are read."""
        found: set[tuple[str, str]] = set()
        for c in changes:
            rows = self.folder.rows(df.schema, parts).select("*", F.col("_metadata.file_path").alias("file|"))
            rows = rows.where(F.col(history.TO).isNull()) if live else rows
            keys = mutations.boxed(c.keys.select(*(f"`{k}`" for k in c.key)), "n")
            hit = mutations.boxed(rows, "o").join(keys, mutations.same("o", "n", c.key, c.null_safe), "left_semi")
            found |= {tuple(r[0].rsplit("/", 2)[1:]) for r in hit.select(F.col("o")["file|"]).distinct().collect()}
        return self.folder.split(parts, found)

    def put_changes(self, table: Table, changes: list[Change], added: DataFrame | None, now: datetime) -> DataFrame | None:
        """A write that changes rows of a table in the folder: its files that hold such rows are put anew, and those of its history that hold their current versions. None if the table isn't there, or its history isn't."""
        parts, before = self.files.get(table.id), self.rows[table.id]
        key = ["RID"] if "RID" in table.columns else list(table.primary() or ())
        kept = table.history and bool(key)
        if not self.folder or not parts or kept and not self.past_files.get(table.id) or any(c not in self.past[table.id].columns for c in before.columns if kept):
            return None
        hit, rest = self.touched(before, parts, changes)
        old = self.folder.rows(before.schema, hit)
        new = reduce(lambda df, c: c.how(df), changes, old)
        new = new if added is None else new.unionByName(added)
        relative = place(table.schema, table.name)
        self.folder.write(new.select(*before.columns), relative)
        done = self.folder.rows(before.schema, [relative])
        if kept:
            past = self.past[table.id]
            keys, versions = history.capture_changes(past, old, done, key, now)
            keys = self.staged(keys)
            stale, fine = self.touched(past, self.past_files[table.id], [Change(keys, key, lambda df: df, True)], live=True)
            again = place(table.schema, f"{table.name}.history")
            self.folder.write(history.closed(self.folder.rows(past.schema, stale), keys, key, now).unionByName(versions), again)
            self.past_files[table.id] = [*fine, again]
            self.past[table.id] = self.folder.rows(past.schema, self.past_files[table.id])
        self.files[table.id] = [*rest, relative]
        return self.folder.rows(before.schema, self.files[table.id])

    def put(self, table: Table, df: DataFrame, kind: str, added: DataFrame | None = None, now: datetime | None = None, last: bool = True, changes: list[Change] | None = None) -> None:
        """The table becomes df. Where it is told by which rows added, or by which changes, df differs from what it was, a catalog in a folder writes no more than these, or the files that hold them.

        Of several tables that one write changes, the last one's call makes all of it visible to who opens the catalog again.
        """
        now = now or self.clock()
        done = self.put_changes(table, changes, added, now) if changes else None
        if done is None:
            done = self.put_whole(table, df, None if changes else added, now)
        self.rows[table.id] = done
        self.written.add(table.id)
        if now not in self.changes:
            self.changes.append(now)
        if last:
            self.save()
        for f in self.listeners:
            f(Written(table.id, kind, now))

    def put_whole(self, table: Table, df: DataFrame, added: DataFrame | None, now: datetime) -> DataFrame:
        before = self.rows[table.id]
        df = self.store(table, self.files, table.name, before, df, added)
        key = ["RID"] if "RID" in table.columns else list(table.primary() or ())
        if table.history and key:
            old = self.past.get(table.id)
            first = old is None
            if first:
                old = history.opened(before, self.changes[0] if self.changes else now)
            if added is not None:
                fresh = history.opened(added, now)
                new = self.store(table, self.past_files, f"{table.name}.history", None if first else old, old.unionByName(fresh, True) if first else None, None if first else fresh.select(*(f"`{c}`" if c in fresh.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns)))
            else:
                for c in df.columns:
                    if c not in old.columns:
                        old = old.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
                new = self.store(table, self.past_files, f"{table.name}.history", None, history.capture(old, df, key, now), None)
            self.past[table.id] = new
        return df

    def staged(self, df: DataFrame) -> DataFrame:
        """df as it is now, for the steps of a write."""
        return settled(df, self.folder, place(STAGING, "rows"))

    def audit(self, table: Table, at: datetime, hide: tuple[str, ...] = (), show: tuple[str, ...] | None = None) -> DataFrame:
        """The rows that a write at that moment brought or took away, for a log: change (+ or -) and the columns not hidden."""
        past = self.past[table.id]
        cols = [f"`{c}`" for c in table.columns if c not in hide and (show is None or c in show)]
        when = F.lit(at).cast("timestamp")
        taken = past.where(F.col(history.TO) == when).select(F.lit("-").alias("change"), *cols)
        return past.where(F.col(history.FROM) == when).select(F.lit("+").alias("change"), *cols).unionAll(taken)

    def may(self, table: Table, right: str, client: Client, column: Column | None = None) -> bool | None:
        if table.kind != "table":
            raise Conflict(f"{table.name} is not writable")
        decision = authz.static(self.model, table, right, client.all_roles, column)
        if decision is False:
            raise Forbidden(f"{right} on {table.name}")
        return decision

    def allowed_rows(self, table: Table, right: str, client: Client, df: DataFrame, decision: bool | None) -> None:
        if decision is None:
            marked = authz.with_decision(df, self.model, table, table.acl_bindings, right, client.all_roles, lambda t: self.rows[t.id], "row|ok")
            if mutations.some(marked.where("NOT `row|ok`")):
                raise Forbidden(f"{right} on a row of {table.name}")

    def completed(self, table: Table, rows: DataFrame, given: set[str], client: Client) -> DataFrame:
        """All columns of the table: as given, or by default; identifiers and times are made here."""
        now = F.lit(self.clock()).cast("timestamp")
        made = {"RCT": now, "RMT": now, "RCB": F.lit(client.id), "RMB": F.lit(client.id)}
        serial = F.monotonically_increasing_id() + self.next_rid
        if "RID" in table.columns and "RID" not in given:
            made["RID"] = rid.encode(serial)
        out = []
        for c in table.columns.values():
            if c.name in given:
                col = F.col(f"`{c.name}`")
            elif c.name in made:
                col = made[c.name]
            elif c.type.name.startswith("serial") and c.default is None:
                col = serial
            else:
                col = F.lit(c.default)
            out.append(col.cast(c.type.spark).alias(c.name))
        df = self.staged(rows.select(*out))
        top = df.agg(*(F.max(rid.decode("RID") if c.name == "RID" else F.col(f"`{c.name}`").cast("bigint")).alias(c.name) for c in table.columns.values() if c.name == "RID" or c.type.name.startswith("serial"))).first() if any(c.name == "RID" or c.type.name.startswith("serial") for c in table.columns.values()) else ()
        self.next_rid = max([self.next_rid, *(x + 1 for x in top if x is not None)])
        for c in table.columns.values():
            if c.type.name in ("row_uri", "row_curie") and c.name.lower() in ("uri", "id") and c.default and "{RID}" in str(c.default):
                df = df.withColumn(c.name, F.replace(F.col(c.name), F.lit("{RID}"), F.col("RID")))
        return df

    def check_fkeys(self, table: Table, rows: DataFrame) -> None:
        for f in table.fkeys:
            if f.enforced:
                target = self.rows[f.target]
                full = rows.where(reduce(and_, (F.col(f"`{c}`").isNotNull() for c in f.columns)))
                a, b = mutations.boxed(full, "n"), mutations.boxed(target.select(*(f"`{c}`" for c in f.target_columns)), "o")
                on = reduce(and_, (F.col("n")[c] == F.col("o")[t] for c, t in zip(f.columns, f.target_columns)))
                if mutations.some(a.join(b, on, "left_anti")):
                    raise Conflict(f"a row of {table.name} refers to a row of {f.target[1]} that is not there")

    def single(self, path: str) -> tuple[Table, S.Query]:
        q = S.parse(path)
        if q.snapshot:
            raise Forbidden("a snapshot can't be written")
        if len(q.steps) != 1 or not isinstance(q.steps[0], S.TableStep):
            raise BadRequest("this write takes one table without filters")
        return self.model.table(*q.steps[0].name.parts), q

    def insert(self, path: str, rows: DataFrame, defaults: tuple[str, ...] = (), nondefaults: tuple[str, ...] = (), onconflict: str | None = None, client: Client | None = None) -> DataFrame:
        """Adds rows; returns them in full. defaults are made whatever is given; system columns too, unless among nondefaults."""
        client = client or LOCAL
        table, _ = self.single(path)
        decision = self.may(table, "insert", client)
        if onconflict not in (None, "abort", "skip"):
            raise BadRequest(f"onconflict={onconflict}")
        for c in [*rows.columns, *defaults, *nondefaults]:
            if c not in table.columns:
                raise BadRequest(f"unknown column {c}")
        given = set(rows.columns) - set(defaults) - (set(SYSTEM) - set(nondefaults))
        if "RID" in given and self.leases is not None:
            free = self.leases.where(F.col("client").eqNullSafe(F.lit(client.id))).select("RID")
            if mutations.some(rows.select("RID").join(free, "RID", "left_anti")):
                raise Forbidden("a row identifier must be leased by the client")
        full = self.completed(table, rows, given, client)
        self.allowed_rows(table, "insert", client, full, decision)
        after, added = mutations.insert(table, self.rows[table.id], full, onconflict == "skip")
        if onconflict == "skip":  # of rows that share a key one was taken; it is the same one from here on
            added = self.staged(added)
            after = self.rows[table.id].unionByName(added)
        self.check_fkeys(table, added)
        self.put(table, after, "insert", added)
        return added

    def lease(self, number: int, client: Client) -> DataFrame:
        """Row identifiers for later inserts by the same client."""
        new = self.spark.range(self.next_rid, self.next_rid + number).select(rid.encode("id").alias("RID"), F.lit(client.id).alias("client"))
        self.next_rid += number
        self.save()
        self.leases = new if self.leases is None else self.leases.unionAll(new)
        return new.select("RID")

    def stamp(self, table: Table, client: Client) -> dict:
        out = {"RMT": F.lit(self.clock()).cast("timestamp"), "RMB": F.lit(client.id)}
        return {k: v for k, v in out.items() if k in table.columns}

    def upsert(self, path: str, rows: DataFrame, client: Client | None = None) -> DataFrame:
        """Rows that match on all key columns given (together) are updated, the rest inserted. Returns the table."""
        client = client or LOCAL
        table, _ = self.single(path)
        rows = self.known(table, rows)
        keyed = {c for k in table.keys for c in k.columns} - (set(SYSTEM) - {"RID"})
        users = {c for k in table.keys if set(k.columns) != {"RID"} for c in k.columns} - set(SYSTEM)
        key = [c for c in table.columns if c in rows.columns and c in (users or keyed)]
        if not key:
            raise Conflict(f"rows for {table.name} need key columns")
        mutations.check_distinct(rows, tuple(key))
        right = self.may(table, "update", client)
        rest = [c for c in rows.columns if c not in key and c not in SYSTEM]
        nullable = any(table.columns[c].nullok for c in key)
        current = self.rows[table.id]
        self.allowed_rows(table, "update", client, self.matched(current, rows, key, nullable), right)
        stamp, changes, added = self.stamp(table, client), [], None
        if rest:
            changes = [Change(rows, key, lambda df: mutations.update(df, rows, {c: c for c in key}, {c: c for c in rest}, stamp, nullable), nullable)]
            current = changes[0].how(current)
        a, b = mutations.boxed(rows, "n"), mutations.boxed(self.rows[table.id].select(*(f"`{c}`" for c in key)), "o")
        fresh = mutations.unboxed(a.join(b, mutations.same("n", "o", key, nullable), "left_anti"), "n", rows.columns)
        if mutations.some(fresh):
            self.allowed_rows(table, "insert", client, fresh, self.may(table, "insert", client))
            _, added = mutations.insert(table, current, self.completed(table, fresh, set(fresh.columns) - (set(SYSTEM) - {"RID"}), client), skip=True)
            added = self.staged(added)
            current = current.unionByName(added)
        return self.changed(table, current, rest, "upsert", changes, added)

    def matched(self, current: DataFrame, rows: DataFrame, key: list[str], nullable: bool) -> DataFrame:
        return mutations.unboxed(mutations.boxed(current, "o").join(mutations.boxed(rows.select(*(f"`{c}`" for c in key)), "n"), mutations.same("o", "n", key, nullable), "left_semi"), "o", current.columns)

    def known(self, table: Table, rows: DataFrame) -> DataFrame:
        for c in rows.columns:
            if c not in table.columns:
                raise BadRequest(f"unknown column {c}")
        return rows.select(*(F.col(f"`{c}`").cast(table.columns[c].type.spark).alias(c) for c in rows.columns))

    def changed(self, table: Table, after: DataFrame, columns: list[str], kind: str, changes: list[Change] | None = None, added: DataFrame | None = None, also: dict | None = None) -> DataFrame:
        """Puts what a write has made of the columns of a table, and also of other tables that follow it, if all of it holds together."""
        states = {table.id: (after, columns, changes), **(also or {})}
        before = {k: self.rows[k] for k in states}
        try:
            self.rows.update({k: df for k, (df, *_) in states.items()})
            for name, (df, cols, _) in states.items():
                t = self.model.table(*name)
                mutations.check_types(t, df)
                for k in t.keys:
                    if k.enforced and set(k.columns) & set(cols):
                        full = df.where(reduce(and_, (F.col(f"`{c}`").isNotNull() for c in k.columns)))
                        if mutations.some(full.groupBy(*(f"`{c}`" for c in k.columns)).count().where("count > 1")):
                            raise Conflict(f"rows would share a key ({', '.join(k.columns)})")
                self.check_fkeys(t, df)
                for child, f in self.model.references(t):
                    if f.enforced and set(f.target_columns) & set(cols):
                        self.check_fkeys(child, self.rows[child.id])
        finally:
            self.rows.update(before)
        now = self.clock()
        for k, (name, (df, _, own)) in enumerate(states.items()):
            self.put(self.model.table(*name), df, kind, added if name == table.id else None, now, k == len(states) - 1, own)
        return self.rows[table.id]

    def follow(self, table: Table, change: Change, columns: list[str], out: dict) -> dict:
        """What foreign keys make of other tables where the keys that they refer to change: by table its rows, the columns changed, and the changes."""
        for t, f in self.model.references(table):
            if not f.enforced or f.on_update in ("NO ACTION", "RESTRICT") or not set(f.target_columns) & set(columns) or t is table:
                continue
            old = {c: f"old|{c}" for c in f.target_columns}
            now = out[table.id][3] if table.id in out else self.rows[table.id]
            both = change.how(now.withColumns({o: F.col(f"`{c}`") for c, o in old.items()}))
            new = {"CASCADE": lambda c, k: F.col(f"`{c}`"), "SET NULL": lambda c, k: F.lit(None), "SET DEFAULT": lambda c, k: F.lit(t.columns[k].default)}[f.on_update]
            moved = both.where(~reduce(and_, (F.col(f"`{c}`").eqNullSafe(F.col(f"`{o}`")) for c, o in old.items())))
            moved = self.staged(moved.select(*(F.col(f"`{old[c]}`").alias(k) for c, k in zip(f.target_columns, f.columns)), *(new(c, k).cast(t.columns[k].type.spark).alias(f"to|{k}") for c, k in zip(f.target_columns, f.columns))))
            own = Change(moved, list(f.columns), lambda df, moved=moved, f=f: mutations.update(df, moved, {k: k for k in f.columns}, {k: f"to|{k}" for k in f.columns}))
            rows, cols, done, _ = out.get(t.id, (self.rows[t.id], [], [], None))
            out[t.id] = own.how(rows), [*cols, *f.columns], [*done, own], rows
            self.follow(t, own, list(f.columns), out)
        return out

    def update(self, path: str, rows: DataFrame, client: Client | None = None) -> DataFrame:
        """``attributegroup/T/k;a,b``: rows that match on k take a and b; rows that match nothing are ignored. ``old:=k;new:=k`` renames a key. Returns the table."""
        client = client or LOCAL
        table, q = self.single(path)
        if q.api != "attributegroup" or not q.leaves:
            raise BadRequest("an update is an attributegroup of keys and targets")
        key = {i.name.parts[-1]: i.alias or i.name.parts[-1] for i in q.items}
        targets = {i.name.parts[-1]: i.alias or i.name.parts[-1] for i in q.leaves}
        for c in [*key, *targets]:
            table.column(c)
        given = [*key.values(), *targets.values()]
        if len(set(given)) < len(given) or set(given) != set(rows.columns):
            raise BadRequest(f"rows must have the columns {given}")
        if set(targets) & {"RID", "RCT", "RCB"}:
            raise Forbidden("system columns can't be updated")
        mutations.check_distinct(rows, tuple(key.values()))
        right = self.may(table, "update", client)
        for c in targets:
            self.may(table, "update", client, table.columns[c])
        nullable = any(table.columns[c].nullok for c in key)
        current = self.rows[table.id]
        self.allowed_rows(table, "update", client, self.matched(current, rows.select(*(F.col(f"`{v}`").alias(k) for k, v in key.items())), list(key), nullable), right)
        stamp = self.stamp(table, client)
        change = Change(rows.select(*(F.col(f"`{v}`").alias(k) for k, v in key.items())), list(key), lambda df: mutations.update(df, rows, key, targets, stamp, nullable), nullable)
        also = {k: v[:3] for k, v in self.follow(table, change, list(targets), {}).items()}
        return self.changed(table, change.how(current), list(targets), "update", [change], also=also)

    def hits(self, q: S.Query, client: Client) -> tuple[Plan, Table, DataFrame, list[str]]:
        if q.snapshot:
            raise Forbidden("a snapshot can't be written")
        plan = self.plan(client)
        for s in q.steps:
            plan.step(s)
        table = plan.elements[plan.context].table
        key = list(table.primary() or table.columns)
        df = plan.semi()
        df = plan.product() if df is None else df
        hit = self.staged(df.select(*(ref(plan.context, c).alias(c) for c in table.columns if c in plan.visible(table))).dropDuplicates(key))
        if not mutations.some(hit):
            raise NotFound("nothing matches")
        return plan, table, hit, key

    def delete(self, path: str, client: Client | None = None) -> DataFrame:
        """``entity/path``: the rows of the context go, and foreign keys act. ``attribute/path/c``: their cells c become null. Returns the table."""
        client = client or LOCAL
        q = S.parse(path)
        if q.api == "attribute":
            return self.clear(q, client)
        if q.api != "entity" or q.sort is not None:
            raise BadRequest("rows are deleted by an entity path")
        _, table, hit, key = self.hits(q, client)
        self.allowed_rows(table, "delete", client, hit, self.may(table, "delete", client))
        changed: dict[tuple[str, str], DataFrame] = {}
        how: dict[tuple[str, str], list[Change]] = {}
        number = hit.count()
        self.remove(table, Change(hit, key, lambda df: mutations.delete(df, hit, key, number), True), hit, number, changed, how, set())
        now = self.clock()
        for k, (name, df) in enumerate(changed.items()):
            self.put(self.model.table(*name), df, "delete", now=now, last=k == len(changed) - 1, changes=how[name])
        return self.rows[table.id]

    def remove(self, table: Table, change: Change, hit: DataFrame, number: int, changed: dict, how: dict, seen: set) -> None:
        """The change takes rows of the table away; hit has as many rows as number, with the columns of theirs that foreign keys refer to."""

        def put(t: Table, c: Change) -> None:
            how.setdefault(t.id, []).append(c)
            changed[t.id] = c.how(changed.get(t.id, self.rows[t.id]))

        put(table, change)
        for t, f in self.model.references(table):
            if not f.enforced or (t.id, f.columns) in seen:
                continue
            child, own = changed.get(t.id, self.rows[t.id]), list(f.columns)
            keys = hit.select(*(F.col(f"`{k}`").alias(c) for c, k in zip(own, f.target_columns)))
            left = mutations.among(child, keys, own, number)
            needed = list(dict.fromkeys(c for _, g in self.model.references(t) if g.enforced for c in g.target_columns)) if f.on_delete == "CASCADE" else []
            left = left.select(*(f"`{c}`" for c in needed or own))
            if needed:  # of the rows that go, foreign keys follow these columns
                left = self.staged(left.distinct())
            if not mutations.some(left):
                continue
            if f.on_delete == "CASCADE":
                gone = Change(keys, own, lambda df, keys=keys, own=own: mutations.delete(df, keys, own, number, False))
                self.remove(t, gone, left, left.count() if needed else 0, changed, how, seen | {(t.id, f.columns)})
            elif f.on_delete in ("SET NULL", "SET DEFAULT"):
                values = {c: t.columns[c].default if f.on_delete == "SET DEFAULT" else None for c in own}
                put(t, Change(keys, own, lambda df, keys=keys, own=own, values=values: mutations.replaced(df, keys, own, number, values)))
            else:
                raise Conflict(f"rows of {t.name} refer to the rows")

    def clear(self, q: S.Query, client: Client) -> DataFrame:
        if any(len(i.name.parts) > 1 or i.alias or i.bin or i.aggregate for i in q.items):
            raise Conflict("only plain columns of the context can be cleared")
        _, table, hit, key = self.hits(q, client)
        columns = [c for i in q.items for c in (table.columns if i.name.parts[0] == "*" else [i.name.parts[0]])]
        for c in columns:
            if any(c in k.columns for k in table.keys) or c in SYSTEM:
                raise Conflict(f"{c} can't be cleared")
            self.may(table, "update", client, table.column(c))
        self.allowed_rows(table, "update", client, hit, self.may(table, "update", client))
        stamp = self.stamp(table, client)
        change = Change(hit, list(key), lambda df: mutations.clear(df, hit, key, columns, stamp), True)
        return self.changed(table, change.how(self.rows[table.id]), columns, "clear", [change])

    # history

    def history_range(self) -> tuple[datetime | None, datetime | None]:
        return (min(self.changes), max(self.changes)) if self.changes else (None, None)

    def truncate_history(self, until: datetime) -> None:
        for name, df in self.past.items():
            self.past[name] = history.truncated(df, until)
        kept = [m for m in self.models if m[0] > until]
        last = [m for m in self.models if m[0] <= until][-1:]
        self.models = [(until, m) for _, m in last] + kept
        self.changes = [until] * bool(last) + [c for c in self.changes if c > until]

    def redact_history(self, table: Table, column: str, start: datetime | None = None, end: datetime | None = None, only: str | None = None) -> None:
        c = table.column(column)
        if any(column in k.columns for k in table.keys):
            raise Conflict(f"{c.name} is part of a key")
        cond = condition(S.parse_condition(only), lambda n: [(F.col(f"`{n.parts[-1]}`"), table.column(n.parts[-1]).type)]) if only else None
        if table.id in self.past:
            self.past[table.id] = history.redacted(self.past[table.id], column, start, end, cond)

    def amend_models(self, change: Callable[[Model], None], start: datetime | None = None, end: datetime | None = None) -> None:
        """Applies a change of ACLs, bindings or annotations to the models of an interval; those that begin or end outside are split."""
        out: list[tuple[datetime, Model]] = []
        ends = [w for w, _ in self.models[1:]] + [None]
        for (when, model), to in zip(self.models, ends):
            for a, _, m in history.amended([(when, to, model)], start, end, None):
                m = copy.deepcopy(model if m is None else m)
                if (start is None or a >= start) and (end is None or a < end):
                    change(m)
                out.append((a, m))
        self.models = out
        if end is None or end > self.clock():
            change(self.model)


@dataclass
class Registry:
    """Catalogs by id, and other names for them."""

    catalogs: dict[str, Catalog] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)
    origins: dict[str, str] = field(default_factory=dict)

    def create(self, spark: SparkSession, id: str | None = None, clone_source: str | None = None, **how) -> Catalog:
        id = id or str(len(self.catalogs) + 1)
        if id in self.catalogs or id in self.aliases:
            raise Conflict(f"catalog {id} exists")
        self.catalogs[id] = Catalog(spark, id, **how)
        if clone_source:
            self.origins[id] = clone_source
        return self.catalogs[id]

    def alias(self, name: str, target: str) -> None:
        if name in self.catalogs:
            raise Conflict(f"catalog {name} exists")
        if target not in self.catalogs:
            raise Conflict(f"no catalog {target}")
        self.aliases[name] = target

    def get(self, id: str) -> Catalog:
        id = self.aliases.get(id, id)
        if id not in self.catalogs:
            raise NotFound(f"no catalog {id}")
        return self.catalogs[id]

    def delete(self, id: str) -> None:
        """Unregisters; what was written stays."""
        if self.aliases.pop(id, None) is None and self.catalogs.pop(id, None) is None:
            raise NotFound(f"no catalog {id}")

    def query(self, path: str, limit: int | None = None, client: Client | None = None) -> DataFrame:
        """A path that begins with ``catalog/<id>`` or ``catalog/<id>@<snapshot>``."""
        q = S.parse(path.partition("?")[0])
        if q.catalog is None:
            raise BadRequest("the path names no catalog")
        return self.get(q.catalog).query(path, limit, client)
