"""Chunk stores as Parquet folders: bucketed tables whose versions one snapshot file names.

A table is dealt by a hash of its key into buckets, sorted by key inside each.  A change writes the
buckets that it touches into a folder of its own; a snapshot names, for every table and bucket, the
folder that holds it.  A snapshot of all tables is committed by one rename, so readers see all
changes of a transaction or none, and a run that failed has left nothing that is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.text import columns
from quarrymill.session import unsized

#: Partition column of a bucket's folder.
BUCKET = "keyed_bucket"
#: Buckets of a new table; a task writes one bucket, so take more for larger stores.
BUCKETS = 32
#: Hours that files no snapshot names stay, as a transaction may still be writing them.
GRACE_HOURS = 24.0


class ConcurrentChange(RuntimeError):
    """Another writer has committed since the transaction began; nothing of it is visible."""


class RepeatedKeys(ValueError):
    """Rows to be written repeat a key of their table; nothing of the transaction is visible."""


def upserted(old: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` in the place of rows of ``old`` with the same key; of equal new keys one stays."""
    fresh = new.dropDuplicates([key])
    return fresh if old is None else old.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def deleted(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


@dataclass(frozen=True)
class Table:
    """A table of a snapshot: its keys, schema as JSON, number of buckets, and the folder of each bucket."""

    keys: tuple[str, ...]
    schema: str
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Snapshot:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class ChunkStore:
    """The tables below one folder.  Readers name a snapshot, or take the latest one."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # files, of any file system that Spark knows

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return at.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), at

    def _listed(self, path: str) -> dict[str, float]:
        """Names below a folder with their modification times in seconds."""
        fs, at = self._fs(path)
        return {s.getPath().getName(): s.getModificationTime() / 1000 for s in fs.listStatus(at)} if fs.exists(at) else {}

    def read_text(self, path: str) -> str:
        fs, at = self._fs(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str, replace: bool = False) -> None:
        """A file that appears whole by a rename; without ``replace`` it must not be there yet."""
        fs, made = self._fs(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.tmp")
        stream = fs.create(made, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, at = self._fs(path)
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE if replace else rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        try:
            context.rename(fs.makeQualified(made), fs.makeQualified(at), options)
        except Exception:
            fs.delete(made, False)
            raise

    # snapshots

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._listed("_snapshots") if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The latest snapshot, or the one of a number; an empty one where nothing was committed."""
        if number is None:
            number = max(self._numbers(), default=0)
        if not number:
            return Snapshot()
        said = json.loads(self.read_text(f"_snapshots/{number:012}.json"))
        return Snapshot(number, {n: Table(tuple(t["keys"]), t["schema"], t["buckets"], {int(b): f for b, f in t["folders"].items()}) for n, t in said.items()})

    def collections(self) -> list[str]:
        return sorted(self.snapshot().tables)

    def transaction(self) -> Transaction:
        return Transaction(self, self.snapshot())

    # reading

    def read_buckets(self, name: str, table: Table, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(table.schema))
        folders = [f"{self.root}/{name}/{f}/{BUCKET}={b}" for b, f in sorted(table.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def scan(self, name: str, at: Snapshot | None = None) -> DataFrame | None:
        table = (at or self.snapshot()).tables.get(name)
        return None if table is None else self.read_buckets(name, table)

    def get(self, name: str, *values, at: Snapshot | None = None) -> DataFrame:
        """The row of a key: one bucket is read, its row groups pruned by order and Bloom filter."""
        table = (at or self.snapshot()).tables.get(name)
        if table is None:
            raise ValueError(f"no collection {name}")
        kinds = {f["name"]: T._parse_datatype_json_value(f["type"]) for f in json.loads(table.schema)["fields"]}
        asked = self.spark.range(1).select(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in zip(table.keys, values, strict=True)])
        bucket = asked.select(bucket_of(table.keys, table.buckets)).first()[0]
        rows = self.read_buckets(name, table, [bucket])
        for k, v in zip(table.keys, values, strict=True):
            rows = rows.filter(F.col(k) == F.lit(v).cast(kinds[k]))
        return rows

    # writing

    def upsert(self, name: str, rows: DataFrame, key: str | Sequence[str] = "id") -> None:
        with self.transaction() as change:
            change.merge(name, rows.dropDuplicates(list(columns(key))), key=key)

    def delete(self, name: str, keys: DataFrame, key: str | Sequence[str] = "id") -> None:
        with self.transaction() as change:
            change.merge(name, None, keys, key=key)

    def vacuum(self, keep: int = 1, grace_hours: float = GRACE_HOURS) -> list[str]:
        """Removes all but the last ``keep`` snapshots and the folders that none of these names; returns those."""
        numbers, removed = self._numbers(), []
        kept = [self.snapshot(n) for n in numbers[-keep:]]
        named = {(name, f) for s in kept for name, t in s.tables.items() for f in t.folders.values()}
        for n in numbers[:-keep]:
            fs, at = self._fs(f"_snapshots/{n:012}.json")
            fs.delete(at, False)
        oldest = (datetime.now(UTC) - timedelta(hours=grace_hours)).timestamp()
        for name in [n for n in self._listed("") if not n.startswith(("_", "."))]:
            for folder, changed in self._listed(name).items():
                if (name, folder) not in named and changed <= oldest:
                    fs, at = self._fs(f"{name}/{folder}")
                    fs.delete(at, True)
                    removed.append(f"{name}/{folder}")
        return removed


class Transaction:
    """Changes of several tables that become visible together.

    Used with ``with``: it commits at the end of the block, and an error leaves the store as it was.
    """

    def __init__(self, store: ChunkStore, base: Snapshot):
        self.store, self.base, self.tables = store, base, dict(base.tables)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.commit()

    def scan(self, name: str) -> DataFrame | None:
        """The table as the transaction has it so far."""
        return None if name not in self.tables else unsized(self.store.read_buckets(name, self.tables[name]))

    def lookup(self, name: str, asked: DataFrame) -> DataFrame | None:
        """The rows whose key ``asked`` holds, from the buckets that can hold it."""
        table = self.tables.get(name)
        if table is None:
            return None
        at = bucket_of(table.keys, table.buckets)
        buckets = [r[0] for r in asked.select(at.alias("b")).distinct().collect()]  # at most the table's buckets
        return unsized(self.store.read_buckets(name, table, buckets)).join(asked.select(*table.keys).distinct(), list(table.keys), "left_semi")

    def merge(
        self, name: str, new: DataFrame | None, gone: DataFrame | None = None, key: str | Sequence[str] = "id", unique: Sequence[str] | None = None, match: Sequence[str] | None = None
    ) -> dict[str, int]:
        """Takes away the rows whose key, or whose ``match`` columns, ``gone`` or ``new`` holds, and adds ``new``.

        Only buckets that hold such keys are read and written.  Rows must be unique by ``unique``
        (the key by default); they are counted and checked by metrics of the write itself.
        Returns the numbers of rows added, of rows in the written buckets and of these buckets.
        """
        keys, table = list(columns(key)), self.tables.get(name)
        if table is None and new is None:
            return {"added": 0, "rows": 0, "buckets": 0}
        table = table or Table(tuple(keys), new.schema.json(), self.store.buckets)
        if tuple(keys) != table.keys:
            raise ValueError(f"{name} is kept by {', '.join(table.keys)}")
        by = list(match or keys)
        leaving = [x.select(*dict.fromkeys([*keys, *by])) for x in (new, gone) if x is not None]
        leaving = leaving[0] if len(leaving) == 1 else leaving[0].unionByName(leaving[1])
        at = bucket_of(keys, table.buckets)
        touched = sorted(r[0] for r in leaving.select(at.alias("b")).distinct().collect())  # at most the table's buckets
        if not touched:
            self.tables[name] = table
            return {"added": 0, "rows": 0, "buckets": 0}
        old = self.store.read_buckets(name, table, touched)
        rows = old.join(leaving.select(*by).distinct(), by, "left_anti").withColumn("_added", F.lit(0))
        rows = rows if new is None else rows.unionByName(new.withColumn("_added", F.lit(1)), allowMissingColumns=True)
        order = list(unique or keys)
        within = Window.partitionBy(BUCKET).orderBy(*order)
        same = F.lit(True)
        for k in order:
            same = same & F.col(k).eqNullSafe(F.lag(k).over(within))
        seen = Observation()
        checked = rows.withColumn(BUCKET, at).repartition(len(touched), BUCKET).withColumn("_again", same & (F.row_number().over(within) > 1))
        watched = checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_added"), F.lit(0)).alias("added"), F.count_if("_again").alias("repeated"))
        folder, writer = uuid.uuid4().hex, watched.drop("_added", "_again").write.partitionBy(BUCKET)
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.store.root}/{name}/{folder}")
        found = seen.get
        if found["repeated"]:
            raise RepeatedKeys(f"{found['repeated']} rows of {name} repeat {', '.join(order)}")
        written = {int(n.split("=")[1]) for n in self.store._listed(f"{name}/{folder}") if n.startswith(f"{BUCKET}=")}
        schema = rows.drop("_added").schema.json()
        kept = {b: f for b, f in table.folders.items() if b not in touched}
        self.tables[name] = Table(table.keys, schema, table.buckets, kept | {b: folder for b in written})
        return {"added": found["added"], "rows": found["rows"], "buckets": len(touched)}

    def commit(self) -> Snapshot:
        number = self.base.number + 1
        said = {n: {"keys": t.keys, "schema": t.schema, "buckets": t.buckets, "folders": t.folders} for n, t in self.tables.items()}
        try:
            self.store.write_text(f"_snapshots/{number:012}.json", json.dumps(said))
        except Exception as error:
            if number in self.store._numbers():
                raise ConcurrentChange(f"snapshot {number} is another writer's") from error
            raise
        return Snapshot(number, self.tables)
