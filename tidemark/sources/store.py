"""Managed tables: versioned Parquet folders and one catalog file per version.

A write computes the next state of a table as a DataFrame, checks its constraints, writes a new version, and then creates
the next catalog file, which names the version of every table: that file is the commit, and the highest complete one is what
readers see.  Readers keep the version they began with.  Only one writer can create a version's file; the others get a
ConflictError.  Row ids come from one counter of the database, which stays ahead of every key that was given, and are never
used again.  Every commit appends to a change log: version, table, row id, kind, without payload.  Writes of many rows end
as if the rows had been written one by one, in their order.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CatalogError, ConflictError, ConstraintError, IndexRequired, StorageError, TransactionError, TypeMismatch, Unsupported

ROW = "__rowid__"
KEEP = 4096
#: Catalog files that stay, for readers that are about to open one.
KEPT_CATALOGS = 16
#: Milliseconds after which an unfinished catalog file counts as a crashed writer's.
GRACE = 10_000
#: Proposals of one key in a batch of DO UPDATE, at most: each takes a round.
ROUNDS = 64
_LOG = "version long, table string, id long, kind string"


def affinity(declared: str) -> str:
    """The storage class that a declared type's name stands for."""
    t = declared.upper()
    for parts, name in ((("INT",), "INTEGER"), (("CHAR", "CLOB", "TEXT"), "TEXT")):
        if any(p in t for p in parts):
            return name
    if not t or "BLOB" in t:
        return "BLOB"
    if t.startswith("VECTOR"):
        return "VECTOR"
    return "REAL" if any(p in t for p in ("REAL", "FLOA", "DOUB")) else "NUMERIC"


#: What a column takes on a write; integers widen to reals, nothing else changes its kind, and a number's text is a number.
_TAKES = {k: re.compile(v) for k, v in {
    "INTEGER": "tinyint|smallint|int|bigint|boolean", "REAL": r"tinyint|smallint|int|bigint|float|double|decimal.*", "TEXT": r"string|(var)?char\(\d+\)", "BLOB": "binary",
    "NUMERIC": r"tinyint|smallint|int|bigint|boolean|float|double|decimal.*|string", "VECTOR": r"array<(tinyint|smallint|int|bigint|float|double|decimal.*)>",
}.items()}
SPARK = {"INTEGER": "bigint", "TEXT": "string", "BLOB": "binary", "REAL": "double", "NUMERIC": "double", "VECTOR": "array<float>"}


@dataclass
class Spec:
    """A column: declared type, and what holds for it."""

    name: str
    type: str = "INTEGER"
    primary_key: bool = False
    not_null: bool = False
    unique: bool = False
    default: str | None = None
    check: str | None = None
    collation: str = "BINARY"

    @property
    def spark(self) -> str:
        return SPARK[affinity(self.type)]


@dataclass
class Table:
    columns: list[Spec]
    unique: list[list[str]] = field(default_factory=list)
    checks: list[str] = field(default_factory=list)
    path: str = ""
    indexes: dict[str, dict] = field(default_factory=dict)

    def keys(self) -> list[list[str]]:
        """Groups of columns that must be unique."""
        return [[c.name] for c in self.columns if c.primary_key or c.unique] + self.unique

    def spec(self, name: str) -> Spec:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise CatalogError(f"no such column: {name}")

    @property
    def schema(self) -> str:
        return ", ".join(f"`{c.name}` {c.spark}" for c in self.columns) + f", {ROW} bigint"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._staged: dict | None = None
        #: Change-log entries that are kept, and how many more may gather before the log is cut.
        self.keep, self.slack = KEEP, 64
        if not self._versions():
            self._put({"version": 0, "next": 1, "floor": 0, "log": [], "tables": {}})

    # Files, through Hadoop, whichever store holds them.

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> dict[int, int]:
        """Catalog files by version, with the milliseconds since each was last written."""
        fs, p = self._path("catalog")
        now = int(time.time() * 1000)
        return {int(f.getPath().getName()[:-5]): now - f.getModificationTime() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")} if fs.exists(p) else {}

    def _read(self, version: int) -> dict | None:
        """A catalog file's content; None where its writer has not ended."""
        fs, p = self._path(f"catalog/{version:012d}.json")
        try:
            f = fs.open(p)
            try:
                return json.loads(bytes(f.readAllBytes()).decode())
            finally:
                f.close()
        except (ValueError, Py4JJavaError):  # cut off, or dropped as too old since it was listed
            return None

    def _get(self) -> dict:
        for version in sorted(self._versions(), reverse=True):
            if (state := self._read(version)) is not None:
                return state
        raise StorageError("no catalog can be read")

    def _put(self, state: dict) -> None:
        """Create the version's file, which only one writer can: that is the commit.

        A file that a crashed writer has left unfinished is no version; after GRACE it no longer keeps others out, and
        a writer that was only slow sees the later version and takes its own for refused.
        """
        seen = self._versions()
        dead = [v for v, age in seen.items() if v >= state["version"] and self._read(v) is None and age > GRACE]
        if any(v >= state["version"] and v not in dead for v in seen):
            raise ConflictError("another writer has committed this version")
        state["version"] = max([state["version"], *(v + 1 for v in dead)])
        fs, p = self._path(f"catalog/{state['version']:012d}.json")
        try:
            out = fs.create(p, False)
        except Py4JJavaError as e:
            raise ConflictError("another writer has committed this version") from e
        out.write(json.dumps(state).encode())
        out.close()
        after = self._versions()
        if max(after) > state["version"]:
            fs.delete(p, False)
            raise ConflictError("another writer has committed since")
        for v in sorted(after)[:-KEPT_CATALOGS]:
            old, q = self._path(f"catalog/{v:012d}.json")
            old.delete(q, False)

    # State

    @property
    def state(self) -> dict:
        return self._staged if self._staged is not None else self._get()

    def names(self) -> list[str]:
        return sorted(self.state["tables"])

    def table(self, name: str) -> Table:
        found = next((t for k, t in self.state["tables"].items() if k.lower() == name.lower()), None)
        if found is None:
            raise CatalogError(f"no such table: {name}")
        return Table([Spec(**c) for c in found["columns"]], found["unique"], found["checks"], found["path"], found["indexes"])

    def frame(self, name: str, rowid: bool = False) -> DataFrame:
        df = self.spark.read.schema(self.table(name).schema).parquet(self.table(name).path)
        return df if rowid else df.drop(ROW)

    def begin(self) -> None:
        if self._staged is not None:
            raise TransactionError("a transaction is open already")
        self._staged = self._get() | {"pending": []}

    def commit(self) -> int:
        if self._staged is None:
            raise TransactionError("no transaction is open")
        staged, self._staged = self._staged, None
        return self._finish(staged, staged.pop("pending"))

    def rollback(self) -> None:
        if self._staged is None:
            raise TransactionError("no transaction is open")
        self._staged = None

    def _finish(self, state: dict, pending: list[str]) -> int:
        if self._get()["version"] != state["version"]:
            raise ConflictError("another writer has committed since")
        state["version"] += 1
        state["log"] = state["log"] + [{"version": state["version"], "path": p} for p in pending]
        if len(state["log"]) > self.keep + self.slack:
            state["floor"] = state["log"][-self.keep - 1]["version"]
            state["log"] = state["log"][-self.keep :]
        self._put(state)
        return state["version"]

    def _save(self, state: dict, name: str, table: Table | None, changes: DataFrame | None = None) -> None:
        if table is None:
            state["tables"].pop(name)
        else:
            state["tables"][name] = asdict(table)
        pending = state.setdefault("pending", [])
        if changes is not None:
            path = f"{self.root}/changes/{uuid.uuid4().hex}"
            changes.select((F.lit(state["version"] + 1).cast("bigint")).alias("version"), F.lit(name).alias("table"), F.col("id"), F.col("kind")).write.parquet(path)
            pending.append(path)
        if self._staged is None:
            self._finish(state, state.pop("pending"))

    def _write(self, name: str, df: DataFrame, table: Table) -> None:
        table.path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
        df.select(*[F.col(c.name).cast(c.spark).alias(c.name) for c in table.columns], F.col(ROW).cast("bigint").alias(ROW)).write.parquet(table.path)

    # Definitions

    def create_table(self, name: str, columns: Sequence[Spec], unique: Sequence[Sequence[str]] = (), checks: Sequence[str] = (), if_not_exists: bool = False) -> None:
        state = self.state
        if any(k.lower() == name.lower() for k in state["tables"]):
            if if_not_exists:
                return
            raise CatalogError(f"table {name} exists")
        if len({c.name.lower() for c in columns}) != len(columns):
            raise CatalogError("a column's name is used twice")
        table = Table(list(columns), [list(u) for u in unique], [*checks, *[c.check for c in columns if c.check]])
        self._write(name, self.spark.createDataFrame([], table.schema), table)
        self._save(state, name, table)

    def drop_table(self, name: str, if_exists: bool = False) -> None:
        state = self.state
        real = self._real(name, if_exists)
        if real:
            self._save(state, real, None)

    def _real(self, name: str, missing_ok: bool = False) -> str | None:
        found = next((k for k in self.state["tables"] if k.lower() == name.lower()), None)
        if found is None and not missing_ok:
            raise CatalogError(f"no such table: {name}")
        return found

    def add_column(self, name: str, column: Spec) -> None:
        table, real, state = self.table(name), self._real(name), self.state
        if column.primary_key or column.unique or (column.not_null and column.default is None):
            raise Unsupported("a new column can't be a key, nor NOT NULL without a default")
        df = self.frame(name, True).withColumn(column.name, F.expr(column.default or "NULL").cast(column.spark))
        table.columns.append(column)
        self._write(real, df, table)
        self._save(state, real, table)

    def rename_table(self, name: str, to: str) -> None:
        table, real, state = self.table(name), self._real(name), self.state
        if self._real(to, True):
            raise CatalogError(f"table {to} exists")
        state["tables"].pop(real)
        self._save(state, to, table, self.frame_of(table).select(F.col(ROW).alias("id"), F.lit("insert").alias("kind")))

    def frame_of(self, table: Table) -> DataFrame:
        return self.spark.read.schema(table.schema).parquet(table.path)

    def rename_column(self, name: str, old: str, new: str) -> None:
        table, real, state = self.table(name), self._real(name), self.state
        df = self.frame(name, True).withColumnRenamed(table.spec(old).name, new)
        swap = lambda text: re.sub(rf"\b{re.escape(old)}\b", new, text, flags=re.I)
        table.spec(old).name = new
        table.checks, table.unique = [swap(c) for c in table.checks], [[new if u.lower() == old.lower() else u for u in g] for g in table.unique]
        self._write(real, df, table)
        self._save(state, real, table)

    def drop_column(self, name: str, column: str) -> None:
        table, real, state = self.table(name), self._real(name), self.state
        spec = table.spec(column)
        if spec.primary_key or spec.unique or any(column.lower() in (u.lower() for u in g) for g in table.unique) or any(re.search(rf"\b{re.escape(column)}\b", c, re.I) for c in table.checks):
            raise CatalogError(f"a constraint or index mentions {column}")
        df = self.frame(name, True).drop(spec.name)
        table.columns.remove(spec)
        self._write(real, df, table)
        self._save(state, real, table)

    def create_index(self, index: str, name: str, columns: Sequence[str], kind: str | None = None, unique: bool = False) -> None:
        """kind is inferred from the columns' types: FULLTEXT for none, VECTOR for a vector, else BTREE."""
        table, real, state = self.table(name), self._real(name), self.state
        specs = [table.spec(c) for c in columns]
        if any(index.lower() == k.lower() for t in state["tables"].values() for k in t["indexes"]):
            raise CatalogError(f"index {index} exists")
        kind = {"BM25": "FULLTEXT", "HNSW": "VECTOR", "ANN": "VECTOR"}.get((kind or "").upper(), (kind or "").upper()) or ("VECTOR" if affinity(specs[0].type) == "VECTOR" else "BTREE")
        if unique:
            self._check_unique(self.frame(name, True), [list(columns)], table)
            table.unique.append([s.name for s in specs])
        table.indexes[index] = {"columns": [s.name for s in specs], "kind": kind, "unique": unique}
        self._save(state, real, table)

    def drop_index(self, index: str) -> None:
        state = self.state
        for name in self.names():
            table = self.table(name)
            for k in list(table.indexes):
                if k.lower() == index.lower():
                    gone = table.indexes.pop(k)
                    if gone["unique"]:
                        table.unique.remove(gone["columns"])
                    self._save(state, name, table)
                    return
        raise CatalogError(f"no such index: {index}")

    def has_index(self, name: str, column: str, kind: str) -> bool:
        return any(i["kind"] == kind and column.lower() in (c.lower() for c in i["columns"]) for i in self.table(name).indexes.values())

    # Writes

    def _numbered(self, rows: DataFrame, state: dict, table: Table, order: Sequence[Column] = ()) -> DataFrame:
        """Row ids: an INTEGER PRIMARY KEY where it is given, else the database's counter, which stays ahead of every key before.

        Rows count in the given order, or in their places.  No task counts another's rows: they are dealt by ranges of the
        order and written, each task's rows are numbered alone, and one row per task tells what comes before it.
        """
        key = next((s.name for s in table.columns if s.primary_key and affinity(s.type) == "INTEGER"), None)
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
        rows = rows.withColumn("__at", F.monotonically_increasing_id())
        kept = f"{self.root}/batches/{uuid.uuid4().hex}"
        rows.write.parquet(kept)
        rows = self.spark.read.schema(rows.schema).parquet(kept).withColumn("__task", F.shiftright("__at", 33))
        given = F.col(key) if key else F.lit(None).cast("bigint")
        known = rows.agg(F.count(given)).first()[0]
        if known:
            before = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
            rows = rows.withColumn("__nulls", F.coalesce(F.sum(given.isNull().cast("bigint")).over(before), F.lit(0)))
            # Behind a given key the counter is that key + 1, and one more for each row since that it has numbered.
            rows = rows.withColumn("__ahead", F.max(given + 1 - F.col("__nulls")).over(before))
        else:
            rows = rows.withColumn("__nulls", F.col("__at").bitwiseAND((1 << 33) - 1)).withColumn("__ahead", F.lit(None).cast("bigint"))
        ends = rows.groupBy("__task").agg(F.sum(given.isNull().cast("bigint")).alias("nulls"), F.max(given + 1 - F.col("__nulls")).alias("ahead")).orderBy("__task").collect()
        past, nulls, top = [], 0, state["next"]
        for r in ends:
            past.append((r[0], nulls, top))
            top = max(top, (r["ahead"] - nulls) if r["ahead"] is not None else top)
            nulls += r["nulls"]
        state["next"] = top + nulls
        if not past:
            return rows.drop("__at", "__task", "__nulls", "__ahead").withColumn(ROW, F.lit(None).cast("bigint"))
        of = lambda k: F.element_at(F.create_map(*[F.lit(x) for p in past for x in (p[0], p[k])]), F.col("__task"))
        number = F.greatest(of(2), F.col("__ahead") - of(1)) + of(1) + F.col("__nulls")
        out = rows.withColumn(ROW, F.coalesce(given.cast("bigint"), number).cast("bigint")).drop("__at", "__task", "__nulls", "__ahead")
        return out.withColumn(key, F.col(ROW).cast(table.spec(key).spark)) if key else out

    def _completed(self, rows: DataFrame, table: Table) -> DataFrame:
        given = {c.lower(): c for c in rows.columns}
        if bad := [c for c in given if c not in {s.name.lower() for s in table.columns}]:
            raise CatalogError(f"no such column: {bad[0]}")
        kinds = {c.lower(): k for c, k in rows.dtypes}
        for c in table.columns:
            kind = kinds.get(c.name.lower(), "void")
            if kind != "void" and not _TAKES[affinity(c.type)].fullmatch(kind):
                raise TypeMismatch(f"column {c.name} is {c.type} but the value is {kind}")
        return rows.select(*[F.col(given[s.name.lower()]).cast(s.spark).alias(s.name) if s.name.lower() in given else F.expr(s.default or "NULL").cast(s.spark).alias(s.name) for s in table.columns])

    def _violation(self, table: Table) -> Column:
        """NOT NULL, then CHECK (which fails only where it is false): the constraint's text, or NULL."""
        out = F.lit(None).cast("string")
        for c in reversed(table.checks):
            out = F.when(~F.coalesce(F.expr(c), F.lit(True)), F.lit(f"CHECK ({c})")).otherwise(out)
        for s in reversed(table.columns):
            if s.not_null and not (s.primary_key and affinity(s.type) == "INTEGER"):
                out = F.when(F.col(s.name).isNull(), F.lit(f"NOT NULL {s.name}")).otherwise(out)
        return out

    def _check(self, df: DataFrame, table: Table) -> None:
        for c in table.columns:
            if (n := re.search(r"VECTOR\s*\(\s*(\d+)", c.type, re.I)) and not df.filter(F.size(c.name) != int(n[1])).isEmpty():
                raise TypeMismatch(f"column {c.name} is {c.type} but a value has another dimension")
        bad = df.select(self._violation(table).alias("v")).filter("v IS NOT NULL").limit(1).collect()
        if bad:
            raise ConstraintError(f"constraint failed: {bad[0][0]}")
        self._check_unique(df, table.keys(), table)

    @staticmethod
    def _folded(table: Table, group: Sequence[str]) -> list[Column]:
        """The group's columns as its uniqueness compares them."""
        from ..functions.scalar import fold

        return [fold(c, table.spec(c).collation) if table.spec(c).spark == "string" else F.col(c) for c in group]

    def _check_unique(self, df: DataFrame, groups: Sequence[Sequence[str]], table: Table) -> None:
        for g in groups:
            if not df.dropna(subset=list(g)).groupBy(*self._folded(table, g)).count().filter("count > 1").isEmpty():
                raise ConstraintError(f"UNIQUE failed: {', '.join(g)}")

    def _with_keys(self, df: DataFrame, table: Table, groups: Sequence[Sequence[str]]) -> DataFrame:
        """Adds per group a struct of its folded columns, NULL where one of them is: NULLs never agree."""
        return df.withColumns({f"__k{k}": F.when(_all_known(g), F.struct(*[c.alias(f"c{j}") for j, c in enumerate(self._folded(table, g))])) for k, g in enumerate(groups)})

    def _staging(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/batches/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @staticmethod
    def _without(rows: DataFrame, others: DataFrame, k: int) -> DataFrame:
        """Rows whose key of group k no other row has."""
        keys = others.filter(F.col(f"__k{k}").isNotNull()).select(F.col(f"__k{k}").alias("__theirs"))
        return rows.join(keys, F.col(f"__k{k}") == F.col("__theirs"), "left_anti")

    def _unless_taken(self, new: DataFrame, old: DataFrame, table: Table, groups: Sequence[Sequence[str]]) -> DataFrame:
        """The rows that inserting one by one would keep: those no earlier kept row, old or new, agrees with on any group.

        Each round keeps the rows that come first for all their keys, and drops those that agree with them.
        """
        left, old = self._with_keys(new, table, groups), self._with_keys(old, table, groups)
        for k in range(len(groups)):
            left = self._without(left, old, k)
        left, kept = self._staging(left), None
        while not left.isEmpty():
            first = left
            for k in range(len(groups)):
                least = left.filter(F.col(f"__k{k}").isNotNull()).groupBy(f"__k{k}").agg(F.min("__seq").alias("__least")).withColumnRenamed(f"__k{k}", "__of")
                first = first.join(least, F.col(f"__k{k}") == F.col("__of"), "left").filter(F.col("__least").isNull() | (F.col("__least") == F.col("__seq"))).drop("__of", "__least")
            first = self._staging(first)
            kept = first if kept is None else kept.unionByName(first)
            left = left.join(first.select(F.col("__seq").alias("__done")), F.col("__seq") == F.col("__done"), "left_anti")
            for k in range(len(groups)):
                left = self._without(left, first, k)
            left = self._staging(left)
        return (left if kept is None else kept).drop(*[f"__k{k}" for k in range(len(groups))])

    def insert(self, name: str, rows: DataFrame, conflict: str = "abort", target: Sequence[str] | None = None, update: dict[str, str] | None = None, where: str | None = None, order: Sequence[Column] = ()) -> DataFrame:
        """conflict: abort, ignore, replace, nothing or update.  In `update`, excluded_<column> is the proposed value.

        Returns the rows written, as they are afterwards.
        """
        table, real, state = self.table(name), self._real(name), self.state
        rows = self._completed(rows, table)
        if conflict == "ignore":
            rows = rows.filter(self._violation(table).isNull())
        # Row ids may repeat where keys do, so the rows' own order is told by another number.
        new = self._numbered(rows, state, table, order).withColumn("__seq", F.monotonically_increasing_id())
        new = self._staging(new)
        old = self.frame(name, True)
        groups = [list(target)] if target else table.keys()
        names = [s.name for s in table.columns]
        if conflict == "replace":
            for s in table.columns:
                if s.not_null and s.default is not None:
                    new = new.withColumn(s.name, F.coalesce(F.col(s.name), F.expr(s.default).cast(s.spark)))
        if conflict in ("ignore", "nothing"):
            out = self._unless_taken(new, old, table, groups).drop("__seq")
            after, kinds = old.unionByName(out), out.select(F.col(ROW).alias("id"), F.lit("insert").alias("kind"))
        elif conflict == "replace":
            # Every row is inserted in its turn, so a row stays if no later one agrees with it on any group.
            keyed, kept = self._with_keys(new, table, groups), self._with_keys(old, table, groups)
            out = keyed
            for k in range(len(groups)):
                last = keyed.filter(F.col(f"__k{k}").isNotNull()).groupBy(f"__k{k}").agg(F.max("__seq").alias("__last")).withColumnRenamed(f"__k{k}", "__of")
                out = out.join(last, F.col(f"__k{k}") == F.col("__of"), "left").filter(F.col("__last").isNull() | (F.col("__last") == F.col("__seq"))).drop("__of", "__last")
                kept = self._without(kept, keyed, k)
            out, kept = out.select(*names, ROW), kept.select(*names, ROW)
            gone = old.join(kept.select(F.col(ROW).alias("__kept")), F.col(ROW) == F.col("__kept"), "left_anti")
            after, kinds = kept.unionByName(out), gone.select(F.col(ROW).alias("id"), F.lit("delete").alias("kind")).union(out.select(ROW, F.lit("insert")))
        elif conflict == "update":
            if not target or not update:
                raise Unsupported("DO UPDATE takes a conflict target and assignments")
            after, out, kinds = self._upserted(old, new, table, groups[0], {table.spec(c).name: e for c, e in update.items()}, where)
        elif conflict == "abort":
            out = new.drop("__seq")
            after, kinds = old.unionByName(out), out.select(F.col(ROW).alias("id"), F.lit("insert").alias("kind"))
        else:
            raise Unsupported(f"conflict clause {conflict!r}")
        self._check(after, table)
        self._write(real, after, table)
        self._save(state, real, table, kinds)
        return out.drop(ROW)

    def _upserted(self, old: DataFrame, new: DataFrame, table: Table, group: Sequence[str], update: dict[str, str], where: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The table after the proposals of each key in their order, the rows that any of them wrote, and the changes.

        The n-th proposals of all keys are one round, which sees what the rounds before have made.
        """
        names = [s.name for s in table.columns]
        new = self._with_keys(new, table, [group])
        loose, new = new.filter("__k0 IS NULL"), new.filter("__k0 IS NOT NULL")
        most = new.groupBy("__k0").count().agg(F.max("count")).first()[0] or 0
        if most > ROUNDS:
            raise Unsupported(f"a batch with more than {ROUNDS} proposals of one key")
        new = new.withColumn("__turn", F.row_number().over(Window.partitionBy("__k0").orderBy("__seq")))
        after = old.withColumn("__wrote", F.lit(False))
        kinds = None
        for turn in range(1, most + 1):
            current = self._with_keys(after, table, [group])
            proposed = new.filter(F.col("__turn") == turn).select(*[F.col(c).alias(f"excluded_{c}") for c in [*names, ROW]], F.col("__k0").alias("__theirs"))
            both = current.join(proposed, F.col("__k0") == F.col("__theirs"), "full_outer")
            fresh = F.col(ROW).isNull()
            does = ~fresh & F.col("__theirs").isNotNull() & (F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True))
            values = [F.when(fresh, F.col(f"excluded_{s.name}")).when(does, F.expr(update[s.name]).cast(s.spark) if s.name in update else F.col(s.name)).otherwise(F.col(s.name)).alias(s.name) for s in table.columns]
            row = F.coalesce(F.col(ROW), F.col(f"excluded_{ROW}")).alias(ROW)
            kind = F.when(fresh, "insert").when(does, "update")
            made = self._staging(both.select(*values, row, (F.coalesce("__wrote", F.lit(False)) | fresh | does).alias("__wrote"), kind.alias("__kind")))
            told = made.filter("__kind IS NOT NULL").select(F.col(ROW).alias("id"), F.col("__kind").alias("kind"))
            kinds, after = told if kinds is None else kinds.union(told), made.drop("__kind")
        loose = loose.select(*names, ROW, F.lit(True).alias("__wrote"))
        told = loose.select(F.col(ROW).alias("id"), F.lit("insert").alias("kind"))
        after = after.unionByName(loose)
        return after.drop("__wrote"), after.filter("__wrote").drop("__wrote"), told if kinds is None else kinds.union(told)

    def update(self, name: str, assignments: dict[str, str], where: str | None = None) -> DataFrame:
        """Every expression sees the old row.  Returns the rows as they are afterwards."""
        table, real, state = self.table(name), self._real(name), self.state
        does = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        wanted = {table.spec(c).name: e for c, e in assignments.items()}
        old = self.frame(name, True)
        after = old.select(*[F.when(does, F.expr(wanted[s.name]).cast(s.spark)).otherwise(F.col(s.name)).alias(s.name) if s.name in wanted else F.col(s.name) for s in table.columns], ROW, does.alias("__upd"))
        key = next((s.name for s in table.columns if s.primary_key and affinity(s.type) == "INTEGER" and s.name in wanted), None)
        if key:  # the key is the row id
            after = after.withColumn(ROW, F.coalesce(F.col(key).cast("bigint"), F.col(ROW)))
            state["next"] = max(state["next"], (after.agg(F.max(ROW)).first()[0] or 0) + 1)
        self._check(after.drop("__upd"), table)
        touched = self._staging(after.filter("__upd").select(F.col(ROW).alias("__touched")))
        self._write(real, after, table)
        self._save(state, real, table, touched.select(F.col("__touched").alias("id"), F.lit("update").alias("kind")))
        return self.frame_of(table).join(touched, F.col(ROW) == F.col("__touched"), "left_semi").drop(ROW)

    def delete(self, name: str, where: str | None = None) -> DataFrame:
        """Returns the rows as they were."""
        table, real, state = self.table(name), self._real(name), self.state
        does = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
        old = self.frame(name, True)
        self._write(real, old.filter(~does), table)
        gone = old.filter(does)
        self._save(state, real, table, gone.select(F.col(ROW).alias("id"), F.lit("delete").alias("kind")))
        return gone.drop(ROW)

    # Changes and upkeep

    @property
    def version(self) -> int:
        return self._get()["version"]

    def changes(self, since: int = 0) -> DataFrame:
        """Changes after a version.  `lost` tells whether some of them are beyond the log's keeping."""
        paths = [e["path"] for e in self._get()["log"] if e["version"] > since]
        return self.spark.read.schema(_LOG).parquet(*paths) if paths else self.spark.createDataFrame([], _LOG)

    @property
    def floor(self) -> int:
        """The version after which the log has every change."""
        return self._get()["floor"]

    def lost(self, since: int) -> bool:
        return since < self.floor

    def vacuum(self, to: str) -> Store:
        """A compact copy of the database in another folder."""
        other = Store(self.spark, to)
        state = other._get()
        for name in self.names():
            table = self.table(name)
            df = self.frame(name, True)
            other._write(name, df.coalesce(max(1, df.rdd.getNumPartitions() // 4)), table)
            state["tables"][name] = asdict(table)
        state["next"] = self._get()["next"]
        other._finish(state, [])
        return other

    def search_text(self, name: str, columns: str | Sequence[str], key: str, query: str, k: int | None = None, where: str | None = None) -> DataFrame:
        """BM25 ranking over a FULLTEXT index: key and score.  The postings of a table's version are written at its first search."""
        from ..operators import text_index

        columns = [columns] if isinstance(columns, str) else list(columns)
        table = self.table(name)
        found = next((n for n, i in table.indexes.items() if i["kind"] == "FULLTEXT" and [c.lower() for c in i["columns"]] == [c.lower() for c in columns]), None)
        if found is None:
            raise IndexRequired(f"no full-text index over {', '.join(columns)} of {name}")
        to = f"{self.root}/indexes/{found}/{table.path.rsplit('/', 1)[1]}-{key}"
        if not text_index.exists(self.spark, to):
            fs, p = self._path(to.removeprefix(f"{self.root}/"))
            fs.delete(p, True)  # what a broken build has left
            text_index.build(self.frame_of(table), columns, key, to)
        only = self.frame(name).filter(where).select(key) if where else None
        return text_index.search(self.spark, to, query, k, key=key, only=only)

    def search_vector(self, name: str, column: str, key: str, query: Sequence[float], k: int | None = None, where: str | None = None) -> DataFrame:
        """Cosine ranking of a column that has a VECTOR index."""
        from ..operators.retrieval import vector_top_k

        if not self.has_index(name, column, "VECTOR"):
            raise IndexRequired(f"no vector index over {column} of {name}")
        return vector_top_k(self.frame(name), column, query, key, k, F.expr(where) if where else None)

    def information(self, view: str = "COLUMNS") -> DataFrame:
        """A view of the catalog: TABLES, COLUMNS, SCHEMATA, STATISTICS, KEY_COLUMN_USAGE, TABLE_CONSTRAINTS; and VIEWS, TRIGGERS
        and ROUTINES, of which a database has none."""
        tables = {t: self.table(t) for t in self.names()}
        keys = [(t, "PRIMARY" if c.primary_key else f"{t}_{c.name}", [c.name]) for t, x in tables.items() for c in x.columns if c.primary_key or c.unique]
        keys += [(t, next((n for n, i in x.indexes.items() if i["columns"] == u), f"{t}_{'_'.join(u)}"), u) for t, x in tables.items() for u in x.unique]
        index = [(t, n, i["columns"], i["kind"], not i["unique"]) for t, x in tables.items() for n, i in x.indexes.items()]
        index += [(t, n, u, "BTREE", False) for t, n, u in keys if n not in tables[t].indexes]
        views = {
            "TABLES": ("table_name string, table_type string", [(t, "BASE TABLE") for t in tables]),
            "COLUMNS": (
                "table_name string, column_name string, ordinal_position long, data_type string, is_nullable boolean, column_default string, column_key string",
                [(t, c.name, k + 1, c.type, not c.not_null, c.default, "PRI" if c.primary_key else "UNI" if c.unique else "") for t, x in tables.items() for k, c in enumerate(x.columns)],
            ),
            "SCHEMATA": ("schema_name string", [("main",)]),
            "STATISTICS": ("table_name string, index_name string, seq_in_index long, column_name string, index_type string, non_unique boolean", [(t, n, k + 1, c, kind, many) for t, n, cs, kind, many in index for k, c in enumerate(cs)]),
            "KEY_COLUMN_USAGE": ("constraint_name string, table_name string, column_name string, ordinal_position long", [(n, t, c, k + 1) for t, n, cs in keys for k, c in enumerate(cs)]),
            "TABLE_CONSTRAINTS": (
                "constraint_name string, table_name string, constraint_type string",
                [(n, t, "PRIMARY KEY" if n == "PRIMARY" else "UNIQUE") for t, n, _ in keys] + [(f"{t}_chk_{k + 1}", t, "CHECK") for t, x in tables.items() for k in range(len(x.checks))],
            ),
            "VIEWS": ("table_name string, view_definition string", []),
            "TRIGGERS": ("trigger_name string, event_object_table string", []),
            "ROUTINES": ("routine_name string, routine_type string", []),
        }
        if view.upper() not in views:
            raise CatalogError(f"no such view: {view}")
        schema, rows = views[view.upper()]
        return self.spark.createDataFrame(rows, schema)


def _all_known(group: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in group:
        out = out & F.col(c).isNotNull()
    return out
