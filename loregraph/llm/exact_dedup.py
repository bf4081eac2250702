"""Exact deduplication as a stateful stream.

Arriving rows are written to a content store in the shared folder: digest of the
normalised text, length, identifier, and the normalised text itself. Where a row
stands in the store, its file and number in it, is its content locator. A Structured
Streaming query reads the store without its texts and keeps, per digest, the best
record seen so far, with its locator, and a count, in RocksDB state on disk, without
watermark and so without expiry. Records of a micro-batch are combined per task before
the shuffle, so a digest that a third of all rows share reaches its state as one record
per task.

On a hit (a digest with more than one record) the text that stands at the retained
locator is read, and the full normalised bytes of every member are compared with it.
Digests whose members differ, should there be any, are grouped again by their whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.llm._scratch import fresh, scratch_dir, stage

#: Up to this many digests (40 bytes each) are broadcast; beyond it the join is shuffled.
BROADCAST_DIGESTS = 500_000

#: State is kept by RocksDB. Its memory is bounded for all stores of an executor together, stores are closed when they
#: have been written, none allocates files ahead, and commits write changes only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}

CONTENT = "digest binary, n_chars long, doc_id long, norm string"
_LOCATOR = "struct<file:string,row:long>"


def normalised(text: Column) -> Column:
    """Null counts as empty; every character of ``[\\x20\\x09-\\x0D]`` is deleted."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def _locator() -> Column:
    return F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


class StreamingDeduplicator:
    """Keyed state over everything that was ever added under ``home``.

    ``home`` is a folder that all executors share. Each ``add`` appends rows to
    the content store and brings the state up to date; calling it again later, in
    another session too, goes on from the checkpoint.
    """

    def __init__(self, spark: SparkSession, home: str, digest_bytes: int = 32):
        self.spark, self.home, self.digest_bytes = spark, home.rstrip("/"), digest_bytes

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        rows = docs.select(
            normalised(F.col(text_col)).alias("norm"), F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_chars"), F.col(id_col).cast("long").alias("doc_id")
        )
        digest = F.substring(F.unhex(F.sha2("norm", 256)), 1, self.digest_bytes).alias("digest")
        rows.select(digest, "n_chars", "doc_id", "norm").write.mode("append").option("compression", "zstd").parquet(f"{self.home}/content")
        self._update()

    def _update(self) -> None:
        # in a session of its own, so that no other query meets its settings
        spark = self.spark.newSession()
        for k, v in STATE_STORE.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.shuffle.partitions", self.spark.conf.get("spark.sql.shuffle.partitions"))
        # largest length first, then smallest id, null ids last; the complement of an id turns its order round, for every long
        rank = F.struct(F.col("n_chars"), F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not("doc_id").alias("not_id"), _locator().alias("locator"))
        state = (
            spark.readStream.schema(CONTENT)
            .parquet(f"{self.home}/content")
            .select("digest", rank.alias("rank"))
            .groupBy("digest")
            .agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
        )
        home = self.home

        def sink(batch: DataFrame, number: int) -> None:
            batch.select(
                "digest", F.bitwise_not("best.not_id").alias("keep_id"), F.col("best.locator").alias("locator"), "group_size"
            ).write.mode("overwrite").parquet(f"{home}/keepers/batch={number}")

        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(sink)
            .option("checkpointLocation", f"{home}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def content(self) -> DataFrame:
        """Everything that was added: digest, n_chars, doc_id, norm."""
        return self.spark.read.schema(CONTENT).parquet(f"{self.home}/content")

    def keepers(self) -> DataFrame:
        """The state's latest row for each digest: digest, keep_id, locator, group_size."""
        rows = self.spark.read.schema(f"digest binary, keep_id long, locator {_LOCATOR}, group_size long, batch long").parquet(f"{self.home}/keepers")
        if len(rows.select("batch").distinct().take(2)) < 2:
            return rows.drop("batch")
        latest = F.max_by(F.struct("keep_id", "locator", "group_size"), "batch")
        return rows.groupBy("digest").agg(latest.alias("x")).select("digest", "x.*")

    def clashes(self, keepers: DataFrame) -> DataFrame:
        """Digests that texts of different bytes share: every member of a digest is held against the text at its retained locator."""
        repeated = keepers.where("group_size > 1").select("digest", "locator")
        few = repeated.count() <= BROADCAST_DIGESTS
        hits = self.content().select("digest", "norm").join(F.broadcast(repeated.select("digest")) if few else repeated.select("digest"), "digest")
        at = repeated.select(F.col("digest").alias("own"), "locator.*")
        stored = self.content().select("norm", F.inline(F.array(_locator())))
        kept = stored.join(F.broadcast(at) if few else at, ["file", "row"]).select(F.col("own").alias("digest"), F.col("norm").alias("kept_norm"))
        # A copy of the kept text goes to every member. Nothing is grouped right below or above the join, so that its large
        # partitions can be split at run time.
        clash = hits.join(stage(kept, "exact-kept-bytes").hint("merge"), "digest").where(F.col("norm") != F.col("kept_norm"))
        return stage(clash.select("digest"), "exact-clashes").distinct()


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised texts are; of equal ones the row with
    the most code points, then the smallest id, stays. Null texts are empty
    texts, which are equal to each other and to texts of white space. Null ids
    rank last; where no id is known, keep_id is null. Rows that repeat an id and
    text all count in group_size; ``kept`` holds for one id, so for each of such
    repeats of the row that stays. ``digest_bytes`` below 32 shortens the state's
    key; results stay the same, since full bytes decide.
    """
    spark = docs.sparkSession
    dedup = StreamingDeduplicator(spark, scratch_dir(spark, "exact-dedup"), digest_bytes)
    dedup.add(docs, id_col, text_col)
    keepers = stage(dedup.keepers(), "exact-keepers")
    bad = dedup.clashes(keepers)
    sha = F.lower(F.hex("digest")) if digest_bytes == 32 else F.sha2("norm", 256)
    own, keepers = dedup.content(), keepers.drop("locator").hint("merge")
    if not bad.take(1):
        return _result(own.join(keepers, "digest").withColumn("sha", sha))
    rows = own.join(bad, "digest", "left_anti").join(keepers, "digest").withColumn("sha", sha)
    torn = own.join(bad, "digest")
    best = torn.groupBy("norm").agg(
        F.max(F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), F.bitwise_not("doc_id").alias("not_id"))).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    ).select("norm", F.bitwise_not("best.not_id").alias("keep_id"), "group_size")
    torn = torn.join(best, "norm").withColumn("sha", F.sha2("norm", 256))
    cols = ["doc_id", "keep_id", "group_size", "sha"]
    return _result(rows.select(cols).unionByName(torn.select(cols)))


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts; columns stay.

    Rows that repeat both id and text are reduced to one.
    """
    dup = exact_duplicates(docs, id_col, text_col)
    spark = docs.sparkSession
    key, sha, rank = fresh(docs, "keep", "sha", "n")
    dropped = stage(dup.where("not kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct(), "exact-dropped")
    few = dropped.count() <= BROADCAST_DIGESTS
    marked = docs.withColumn(sha, F.sha2(normalised(F.col(text_col)), 256))
    same = (marked[id_col].cast("long").eqNullSafe(dropped[key])) & (marked[sha] == dropped[sha])
    left = marked.join(F.broadcast(dropped) if few else dropped, same, "left_anti")
    # what is left repeats only where a row repeats its id and text
    twice = dup.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").take(1)
    return (left.dropDuplicates([id_col, sha]) if twice else left).drop(sha)
