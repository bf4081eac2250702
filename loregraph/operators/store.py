"""Tables of the catalog: upserts, appends, deletes; and tables between steps."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per key: the one written last."""
    order = W.partitionBy(*keys).orderBy(F.desc(seq))
    return rows.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def merged(old: DataFrame, new: DataFrame, keys: list[str], now: Column, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """``old`` after an upsert of ``new`` (one row per key): columns in ``keep`` stay if known, updated_at moves, columns new to either are added."""
    fresh = new.withColumn("created_at", now).withColumn("updated_at", now) if "updated_at" in old.columns else new
    kept = [c for c in keep if c in old.columns]
    known = old.select(*keys, *[F.col(c).alias(f"__{c}") for c in kept])
    fresh = fresh.join(known, keys, "left")
    for c in kept:
        fresh = fresh.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)) if c in fresh.columns else F.col(f"__{c}")).drop(f"__{c}")
    rest = old.join(new.select(*keys), keys, "left_anti")
    return rest.unionByName(fresh, allowMissingColumns=True)


def without(rows: DataFrame, gone: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is not among the ids that are gone."""
    return rows.join(gone.select(F.col(other or key).alias(key)), key, "left_anti")


def cascade(blocks: DataFrame, embeddings: DataFrame, relations: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after blocks (block_id) are gone, with their embeddings and relations at either end."""
    relations = without(without(relations, gone, "src_id", "block_id"), gone, "dst_id", "block_id")
    return without(blocks, gone, "block_id"), without(embeddings, gone, "block_id"), relations


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one will do for a single process only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-loregraph-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex[:12]}"


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared checkpoint folder and read back, which cuts their lineage."""
    spark = rows.sparkSession
    path = scratch(spark, "settled")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


#: Partitions of a table, and the column that names a row's.
PARTS, PART = 16, "__part"


class Warehouse:
    """Catalog tables of one database, whose folder all executors share; one writer at a time.

    Rows are dealt to partitions by a hash of the table's keys. An upsert or a delete writes the partitions anew that hold its
    keys, and leaves the others alone. What is to be written is settled first, so it may come from the table itself; a writer that
    is lost while it commits can be started again. A table that the catalog of a new session does not know is registered from its folder.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS):
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self.database = f"kb_{hashlib.md5(self.root.encode()).hexdigest()[:16]}"
        # a write replaces the whole table, or only the partitions that it has rows for; neither setting is the caller's
        self._whole, self._writer = spark.newSession(), spark.newSession()
        self._whole.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
        self._writer.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self.database}` LOCATION '{self.root}'")

    def _table(self, name: str) -> str:
        return f"`{self.database}`.`{name}`"

    def exists(self, name: str) -> bool:
        if self.spark.catalog.tableExists(self._table(name)):
            return True
        try:
            self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:  # no such folder, or nothing in it
            return False
        self.spark.sql(f"CREATE TABLE {self._table(name)} USING parquet LOCATION '{self.root}/{name}'")
        self.spark.sql(f"ALTER TABLE {self._table(name)} RECOVER PARTITIONS")
        return True

    def _keys(self, name: str) -> list[str]:
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES {self._table(name)}").collect()}
        return json.loads(found.get("keys", "[]"))

    def _stored(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise KeyError(name)
        self.spark.catalog.refreshTable(self._table(name))
        return self.spark.table(self._table(name))

    def read(self, name: str) -> DataFrame:
        return self._stored(name).drop(PART)

    def _dealt(self, rows: DataFrame, keys: list[str], session: SparkSession | None = None) -> DataFrame:
        """``rows`` with their partitions, settled, in the session that writes them."""
        path = scratch(self.spark, "warehouse")
        placed = rows.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int"))
        placed.write.parquet(path)
        return (session or self._writer).read.schema(placed.schema).parquet(path)

    def write(self, name: str, rows: DataFrame, keys: list[str] | None = None) -> None:
        """Replace a table; without ``keys`` rows are dealt by their first column."""
        dealt = self._dealt(rows, keys or rows.columns[:1], self._whole)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name)}")
        # the table is external, so its folder is overwritten here
        dealt.write.mode("overwrite").partitionBy(PART).option("path", f"{self.root}/{name}").saveAsTable(self._table(name))
        self.spark.sql(f"ALTER TABLE {self._table(name)} SET TBLPROPERTIES ('keys' = '{json.dumps(keys or [])}')")

    def _replace(self, name: str, dealt: DataFrame) -> None:
        """Replace the partitions of ``dealt``; columns that are new to the table are added, those that it lacks are null."""
        known = self._stored(name).columns
        new = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema if f.name not in known]
        if new:
            self.spark.sql(f"ALTER TABLE {self._table(name)} ADD COLUMNS ({', '.join(new)})")
        fields = self._writer.table(self._table(name)).schema
        dealt.select(*[F.col(f"`{f.name}`") if f.name in dealt.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields]).write.mode("overwrite").insertInto(self._table(name))

    def append(self, name: str, rows: DataFrame) -> None:
        """Rows as they are, also such as are there already."""
        if not self.exists(name):
            self.write(name, rows)
            return
        dealt = self._dealt(rows, self._keys(name) or rows.columns[:1])
        known = self._writer.table(self._table(name)).schema
        dealt.select(*[F.col(f"`{f.name}`") if f.name in dealt.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in known]).write.mode("append").insertInto(self._table(name))

    def upsert(self, name: str, rows: DataFrame, keys: list[str], now: Column, keep: tuple[str, ...] = ("created_at",)) -> None:
        if not self.exists(name):
            self.write(name, rows.withColumn("created_at", now).withColumn("updated_at", now), keys)
            return
        if self._keys(name) != keys:
            self.write(name, self.read(name), keys)
        # settled once: what is merged has to be what tells the partitions
        fresh = settled(rows.withColumn(PART, F.pmod(F.xxhash64(*keys), F.lit(self.parts)).cast("int")))
        touched = [r[0] for r in fresh.select(PART).distinct().collect()]  # PARTS at most
        old = self._stored(name).where(F.col(PART).isin(touched)).drop(PART)
        self._replace(name, self._dealt(merged(old, fresh.drop(PART), keys, now, keep), keys))

    def delete(self, name: str, gone: DataFrame, key: str) -> int:
        """Rows deleted."""
        stored, ids = self._stored(name), settled(gone.select(key).distinct())
        lost = {r[PART]: r["n"] for r in stored.join(ids, key, "left_semi").groupBy(PART).agg(F.count(F.lit(1)).alias("n")).collect()}
        if lost:
            path = scratch(self.spark, "warehouse")
            left = stored.where(F.col(PART).isin(*lost)).join(ids, key, "left_anti")
            left.select(*stored.columns).write.parquet(path)
            left = self._writer.read.schema(stored.schema).parquet(path)
            emptied = set(lost) - {r[0] for r in left.select(PART).distinct().collect()}
            self._replace(name, left)
            for part in emptied:
                # a write without rows for a partition would leave it as it is
                none = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()})" for f in stored.schema if f.name != PART)
                self._writer.sql(f"INSERT OVERWRITE {self._table(name)} PARTITION ({PART} = {part}) SELECT {none} WHERE false")
        return sum(lost.values())
