"""Sharding by extendible hashing.

Each row has a hash of 60 bits of its key; a directory is indexed by the leading
bits. Only a bucket whose rows exceed the byte limit is split, on its next bit, until
every shard fits. Rows of one key that exceed the limit are split on by the 60 bits of a hash
of their texts, and equal texts of one key by the bits of a number that each of them gets.

Sizes are summed by cells of some more bits than the directory has, so one pass over
the sizes settles several splits; only the cells that are still too large are summed
again, finer. The directory is a table throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loregraph.llm._scratch import fresh, scratch_dir, stage

HASH_BITS = 60
LIMIT_BYTES = 2 << 20
#: Bits that one pass refines a cell by.
STEP_BITS = 12
#: Largest directory that is broadcast (entries of up to 200 bytes); a larger one is joined by a shuffle.
BROADCAST_CELLS = 200_000


def key_hash(key: Column) -> Column:
    """60 bits of the md5 of the key as text; null is the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _prefix(h: str, depth: int) -> Column:
    return F.shiftright(F.col(h), HASH_BITS - depth)


def _if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_CELLS else df


def directory(sizes: DataFrame, limit_bytes: int = LIMIT_BYTES, step_bits: int = STEP_BITS) -> tuple[DataFrame, DataFrame]:
    """Shards (g, d, p, b, n) of ``sizes`` (g, h, bytes), and cells of 60 bits that are still too large.

    A directory of its own for each g: the shallowest prefixes p of d bits whose rows have b bytes within the limit, or are one row.
    """
    many = (F.col("b") > limit_bytes) & (F.col("n") > 1)
    open_cells = stage(
        sizes.groupBy("g").agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n")).select("g", F.lit(0).alias("d"), F.lit(0).cast("long").alias("p"), "b", "n"), "shard-cells"
    )
    shards, depth = [open_cells.where(~many)], 0
    open_cells = open_cells.where(many)
    while depth < HASH_BITS:
        largest = open_cells.agg(F.max("b")).first()[0]
        if largest is None:
            break
        # deep enough that an even spread would fit, and at least one step
        need = max(1, (-(-largest // limit_bytes) - 1).bit_length()) + 2
        finer = min(HASH_BITS, depth + min(step_bits, need))
        rows = sizes.withColumn("p", _prefix("h", depth)).join(_if_small(open_cells.select("g", "p")), ["g", "p"], "left_semi")
        fine = rows.groupBy("g", _prefix("h", finer).alias("p")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))
        above = fine.select("g", F.explode(F.sequence(F.lit(depth + 1), F.lit(finer))).alias("d"), "p", "b", "n").withColumn("p", F.expr(f"shiftright(p, {finer} - d)"))
        cells = stage(above.groupBy("g", "d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n")), "shard-cells")
        parents = open_cells.union(cells.where(many & (F.col("d") < finer))).select("g", (F.col("d") + 1).alias("d"), F.col("p").alias("up"))
        shards.append(cells.where(~many).withColumn("up", F.shiftright("p", 1)).join(_if_small(parents), ["g", "d", "up"], "left_semi").drop("up"))
        open_cells, depth = cells.where(many & (F.col("d") == finer)), finer
    return reduce(DataFrame.unionByName, shards), open_cells


def directory_entries(shards: DataFrame) -> DataFrame:
    """(g, width, cell, parts): per group a directory of cells of ``width`` bits, each with the shards in it.

    A group of 2 ** width shards or more, but fewer than twice as many, has cells of that width: a shallower shard has an entry in
    each of its cells, as many together as there are shards at most, and deeper ones share a cell.
    """
    width = F.floor(F.log2(F.count(F.lit(1)) + 0.5)).cast("int")
    wide = shards.join(_if_small(shards.groupBy("g").agg(width.alias("width"))), "g")
    cells = F.when(F.col("d") >= F.col("width"), F.array(F.expr("shiftright(p, d - width)"))).otherwise(F.expr("sequence(shiftleft(p, width - d), shiftleft(p + 1, width - d) - 1)"))
    bits = F.expr("CASE WHEN d = 0 THEN '' ELSE lpad(bin(p), d, '0') END")
    entry = F.struct(F.expr(f"shiftleft(p, {HASH_BITS} - d)").alias("lo"), F.expr(f"shiftleft(p + 1, {HASH_BITS} - d) - 1").alias("hi"), F.col("d"), bits.alias("s"), F.col("b"))
    return wide.select("g", "width", F.explode(cells).alias("cell"), entry.alias("entry")).groupBy("g", "width", "cell").agg(F.collect_list("entry").alias("parts"))


def _placed(rows: DataFrame, shards: DataFrame, g: str | None, h: str, names: tuple[str, str, str], base: Column, base_depth: int) -> DataFrame:
    """``rows`` with the names, depths and bytes of their shards; ``base`` are the bits before the prefix."""
    cell, parts, group, width = fresh(rows, "cell", "parts", "group", "width")
    table = stage(directory_entries(shards), "shard-directory").withColumnsRenamed({"g": group, "width": width, "cell": cell, "parts": parts})
    few = (table.agg(F.sum(F.size(parts))).first()[0] or 0) <= BROADCAST_CELLS
    if g is None:
        found = table.select(width).first()
        rows = rows.withColumn(width, F.lit(found[0] if found else 0)).withColumn(group, F.lit(0).cast("long"))
    else:
        rows = rows.join(_if_small(table.select(F.col(group).alias(g), width).distinct()), g).withColumn(group, F.col(g))
    rows = rows.withColumn(cell, F.expr(f"shiftright(`{h}`, {HASH_BITS} - `{width}`)"))
    own = F.get(F.filter(F.col(parts), lambda x: (x["lo"] <= F.col(h)) & (F.col(h) <= x["hi"])), 0)
    table = table.drop(width)
    # a row of a cell that is too large has no shard here
    placed = rows.join(F.broadcast(table) if few else table, [group, cell]).where(own.isNotNull()).withColumn(names[0], F.concat(base, own["s"]))
    return placed.withColumn(names[1], (own["d"] + base_depth).cast("int")).withColumn(names[2], own["b"]).drop(cell, parts, group, width)


def _numbered(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, str]:
    """``rows`` written with a number among those of equal ``keys``, from 0 without gaps, and its column.

    Each task numbers its own rows; a key's tasks then begin where the ones before them end. So no task orders more rows than it has read.
    """
    task, start, number = fresh(rows, "task", "start", "number")
    own = stage(rows.withColumn(task, F.spark_partition_id()), "shard-repeats")
    counts = own.groupBy(*keys, task).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(*keys).orderBy(task).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*keys, task, F.coalesce(before, F.lit(0)).alias(start))
    within = F.row_number().over(Window.partitionBy(*keys, task).orderBy(F.lit(0))) - 1
    return own.withColumn(number, within).join(starts, [*keys, task]).withColumn(number, F.col(number) + F.col(start)).drop(task, start), number


def assign_shards(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES,
                  names: tuple[str, str, str] = ("shard", "depth", "shard_bytes")) -> DataFrame:
    """``docs`` with the shard ("b" and the bits of its prefix), its depth and its bytes of text.

    Null keys hash as the empty text, null texts have no bytes. Rows of one key are
    in one shard where they fit together; where they do not, they are split by text,
    and equal texts by a number that each of them gets. So a shard
    exceeds the limit only if it is one row that does, and shards do not hang on partitions. The shard of an input that fits
    as a whole is "b". Columns of ``docs`` named like ``names`` are replaced.
    """
    h, t = fresh(docs, "h", "t")
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    rows = docs.drop(*[c for c in names if c in docs.columns]).withColumn(h, key_hash(F.col(key_col)))
    sizes = stage(rows.select(F.lit(0).cast("long").alias("g"), F.col(h).alias("h"), size.alias("bytes")), "shard-sizes")
    shards, large = directory(sizes, limit_bytes)
    placed = _placed(rows, stage(shards, "shards-of-keys"), None, h, names, F.lit("b"), 0)
    if large.take(1):
        own = _if_small(large.select(F.col("p").alias(h)))
        aside = stage(rows.join(own, h, "left_semi").withColumn(t, key_hash(F.col(text_col))), "shard-large-keys")
        finer, repeats = directory(aside.select(F.col(h).alias("g"), F.col(t).alias("h"), size.alias("bytes")), limit_bytes)
        base = F.concat(F.lit("b"), F.lpad(F.bin(F.col(h)), HASH_BITS, "0"))
        placed = placed.unionByName(_placed(aside, stage(finer, "shards-of-texts"), h, t, names, base, HASH_BITS).drop(t))
        if repeats.take(1):
            own = _if_small(repeats.select(F.col("g").alias(h), F.col("p").alias(t)))
            alike, number = _numbered(aside.join(own, [h, t], "left_semi"), [h, t])
            g, r = fresh(alike, "group", "r")
            # the lowest bit of the number comes first, so that halves are even
            alike = alike.withColumn(r, F.conv(F.reverse(F.lpad(F.bin(F.col(number)), HASH_BITS, "0")), 2, 10).cast("long")).withColumn(g, F.xxhash64(h, t))
            alike = stage(alike, "shard-numbered")
            finest, _ = directory(alike.select(F.col(g).alias("g"), F.col(r).alias("h"), size.alias("bytes")), limit_bytes)
            base = F.concat(base, F.lpad(F.bin(F.col(t)), HASH_BITS, "0"))
            placed = placed.unionByName(_placed(alike, stage(finest, "shards-of-rows"), g, r, names, base, 2 * HASH_BITS).drop(t, g, r, number))
    return placed.drop(h)


def write_shards(assigned: DataFrame, path: str, shard_col: str = "shard") -> None:
    """One file per shard, in a folder per shard: every shard is written by one task, of bounded size by its limit."""
    assigned.repartition(shard_col).write.option("compression", "zstd").partitionBy(shard_col).parquet(path)


def shard_report(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """Writes the shards and returns, from the files: doc_id, shard, depth, shard_bytes."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    path = scratch_dir(spark, "shards")
    write_shards(assign_shards(rows, "doc_id", "text", limit_bytes), path)
    return spark.read.schema("doc_id long, depth int, shard_bytes long, shard string").parquet(path).select("doc_id", "shard", "depth", "shard_bytes")
