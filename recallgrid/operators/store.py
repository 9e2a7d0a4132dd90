"""Tables of an engine in a shared folder: versions with a schema, migration, inserts, upserts and cascading deletes.

A table is a folder of numbered Parquet versions; a reader takes the newest complete one. A write makes a new version, so a
lost executor or a failed job leaves the version before it as it was. Columns that a stored version lacks are read as their
defaults, which is how a schema grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recallgrid.functions import extract as X
from recallgrid.operators import search

# The tables of the engine: columns, and the column that names a row.
SCHEMAS = {
    "memories": "id long, content string, indexed string, directory string, tags array<string>, heat double, importance double, confidence double, access_count long, is_stale boolean, is_protected boolean, file_hash string, store_type string, created_at timestamp, last_accessed timestamp, embedding_model string, reconsolidations long",
    "vectors": "id long, embedding array<double>, implicit array<double>",
    "postings": "term string, id long, dl int, tf long",
    "entities": "id long, name string, kind string, heat double, archived boolean, last_accessed timestamp",
    "edges": "src long, dst long, kind string, weight double, event_time timestamp",
    "clusters": "id long, level int, parent long, heat double, summary string",
    "profiles": "directory string, key string, value string, confidence double, evidence long",
    "beliefs": "name string, kind string, confidence double, evidence long",
    "rules": "id long, condition string, action string, kind string, scope string, value string, priority int, active boolean",
    "archives": "id long, content string, mismatch double, reason string, archived_at timestamp",
    "narratives": "directory string, period timestamp, n long, decisions string, events string",
    "processes": "name string, decay double, kinds string",
    "triggers": "trigger_id long, kind string, condition string, target string, fired long, active boolean",
    "transitions": "src long, dst long, n long, at timestamp",
    "causal_edges": "src string, dst string, kind string, confidence double",
    "checkpoints": "id long, session string, directory string, task string, epoch long, active boolean, created_at timestamp",
    "slots": "agent string, slot long, level double, held long",
    "episodes": "id long, session_id long, content string, ts timestamp",
    "file_hashes": "path string, hash string",
    "actions": "id long, session_id long, tool string, directory string, summary string, ts timestamp, processed boolean",
    "cursors": "name string, at long",
    "log": "step string, rows long, at timestamp",
}
DEFAULTS = {"heat": 1.0, "importance": 0.5, "confidence": 1.0, "access_count": 0, "is_stale": False, "is_protected": False, "store_type": "episodic", "weight": 1.0, "archived": False, "active": True, "evidence": 1, "fired": 0, "processed": False, "reconsolidations": 0, "epoch": 0}
# Tables that hold rows of a memory, and the columns that name it.
OWNED = {"memories": ("id",), "vectors": ("id",), "postings": ("id",), "archives": ("id",), "transitions": ("src", "dst")}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def conformed(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the columns of the table, in their order; those it lacks, and nulls in them, take their defaults."""
    out = []
    for f in schema_of(name):
        own = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        out.append((F.coalesce(own, F.lit(DEFAULTS[f.name]).cast(f.dataType)) if f.name in DEFAULTS else own).alias(f.name))
    return rows.select(*out)


class Store:
    """The tables under ``root``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def version(self, name: str) -> int:
        """The newest complete version of a table; 0 where it has none."""
        folder = self._path(f"{self.root}/{name}")
        if not self.files.exists(folder):
            return 0
        found = [s.getPath().getName() for s in self.files.listStatus(folder)]
        return max((int(n[1:]) for n in found if n[:1] == "v" and self.files.exists(self._path(f"{self.root}/{name}/{n}/_SUCCESS"))), default=0)

    def read(self, name: str) -> DataFrame:
        """The table with its present schema, whatever the schema that it was written with; empty where nothing is stored."""
        v = self.version(name)
        if not v:
            return self.spark.createDataFrame([], schema_of(name))
        return conformed(self.spark.read.parquet(f"{self.root}/{name}/v{v}"), name)

    def write(self, name: str, rows: DataFrame, keep: int = 2) -> None:
        """A new version of a table; versions before the last ``keep`` are deleted."""
        v = self.version(name) + 1
        conformed(rows, name).write.mode("overwrite").parquet(f"{self.root}/{name}/v{v}")
        for old in range(max(1, v - keep - 2), v - keep + 1):
            self.files.delete(self._path(f"{self.root}/{name}/v{old}"), True)

    def insert(self, name: str, rows: DataFrame) -> None:
        self.write(name, self.read(name).unionByName(conformed(rows, name)))

    def upsert(self, name: str, rows: DataFrame, keys: list[str], merged: dict[str, Column] | None = None) -> None:
        """Rows by ``keys``: new ones are added; of stored ones the columns that ``rows`` has are replaced, or become ``merged``
        (expressions over ``old.`` and ``new.`` columns). Keys are not null and stand once on each side.
        """
        self.write(name, upserted(self.read(name), rows, keys, merged))

    def delete(self, name: str, gone: DataFrame, keys: list[str]) -> None:
        self.write(name, self.read(name).join(gone.select(*keys).distinct(), keys, "left_anti"))

    def forget(self, gone: DataFrame) -> None:
        """Delete memories (id) and all their rows in other tables."""
        for name, rows in forgotten({n: self.read(n) for n in OWNED if self.version(n)}, gone).items():
            self.write(name, rows)

    def insert_memories(self, rows: DataFrame, tokens=None) -> None:
        """Add memories (id, content, ..., embedding) with their index text, vectors and postings."""
        known = rows.withColumn("indexed", X.identifier_parts(F.col("content")))
        self.insert("memories", known)
        if "embedding" in rows.columns:
            self.insert("vectors", rows.where("embedding is not null"))
        self.insert("postings", search.postings(known, "indexed"))


def upserted(stored: DataFrame, rows: DataFrame, keys: list[str], merged: dict[str, Column] | None = None) -> DataFrame:
    """``stored`` after an upsert of ``rows``; see ``Store.upsert``. A row is stored where ``old.<first key>`` is not null."""
    old, new = stored.alias("old"), rows.alias("new")
    same = None
    for k in keys:
        test = F.col(f"old.{k}") == F.col(f"new.{k}")
        same = test if same is None else same & test
    both, is_old, is_new = old.join(new, same, "full_outer"), F.col(f"old.{keys[0]}").isNotNull(), F.col(f"new.{keys[0]}").isNotNull()
    out = []
    for name in stored.columns:
        if name in keys:
            value = F.coalesce(F.col(f"old.{name}"), F.col(f"new.{name}"))
        elif merged and name in merged:
            value = F.when(is_old & is_new, merged[name]).when(is_new, F.col(f"new.{name}") if name in rows.columns else F.lit(None)).otherwise(F.col(f"old.{name}"))
        elif name in rows.columns and not merged:
            value = F.when(is_new, F.col(f"new.{name}")).otherwise(F.col(f"old.{name}"))
        elif name in rows.columns:
            value = F.when(is_old, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}"))
        else:
            value = F.col(f"old.{name}")
        out.append(value.cast(stored.schema[name].dataType).alias(name))
    return both.select(*out)


def upserted_profiles(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Profiles by (directory, key): each further row adds 0.1 of confidence, up to 1, and one of evidence; the value is the newest."""
    gained = F.least(F.round(F.col("old.confidence") + 0.1 * F.col("new.evidence"), 6), F.lit(1.0))
    found = rows.groupBy("directory", "key").agg(F.max_by("value", "at").alias("value"), F.least(F.lit(1.0), F.round(F.min("confidence") + 0.1 * (F.count(F.lit(1)) - 1), 6)).alias("confidence"), F.count(F.lit(1)).alias("evidence"))
    return upserted(stored, found, ["directory", "key"], {"confidence": gained, "evidence": F.col("old.evidence") + F.col("new.evidence"), "value": F.col("new.value")})


def forgotten(tables: dict[str, DataFrame], gone: DataFrame, owned: dict[str, tuple[str, ...]] = OWNED) -> dict[str, DataFrame]:
    """The tables without the rows of the memories ``gone`` (id), in each column that names one."""
    out = {}
    for name, rows in tables.items():
        for column in owned[name]:
            rows = rows.join(gone.select(F.col("id").alias(column)).distinct(), column, "left_anti")
        out[name] = rows
    return out


def updated(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """``rows`` with the values of ``changes`` (key and some ``columns``) where it has one; nulls change nothing."""
    renamed = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = rows.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def since(rows: DataFrame, cursor: Column, key: str = "id") -> DataFrame:
    """Rows past the cursor: the incremental scan. A null cursor means from the start."""
    return rows.where(F.col(key) > F.coalesce(cursor, F.lit(-(1 << 62))))


def advanced(cursors: DataFrame, name: str, rows: DataFrame, key: str = "id") -> DataFrame:
    """``cursors`` (name, at) with that of ``name`` at the largest key of ``rows``; never moved back, unmoved without rows."""
    at = rows.agg(F.lit(name).alias("name"), F.max(key).cast("long").alias("at")).where("at is not null")
    return cursors.select("name", "at").unionByName(at).groupBy("name").agg(F.max("at").alias("at"))


def without_binary(rows: DataFrame, vectors: tuple[str, ...] = ("embedding", "implicit", "hypervector")) -> DataFrame:
    """Rows as they are given to a user: without binary columns and vectors."""
    return rows.drop(*(f.name for f in rows.schema if isinstance(f.dataType, T.BinaryType) or f.name in vectors))


def needs_reembedding(rows: DataFrame, model: str) -> DataFrame:
    """Rows whose vector comes from another model, or from none."""
    return rows.where(F.coalesce(F.col("embedding_model") != model, F.lit(True)))


def rebuilt_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors cut to ``dims`` values, or filled with zeros, of unit length: the table at a new dimension."""
    filled = F.slice(F.concat("embedding", F.array_repeat(F.lit(0.0), dims)), 1, dims)
    size = F.sqrt(F.aggregate(filled, F.lit(0.0), lambda s, x: s + x * x))
    return vectors.where("embedding is not null").withColumn("embedding", F.when(size == 0, filled).otherwise(F.transform(filled, lambda x: x / size)))
