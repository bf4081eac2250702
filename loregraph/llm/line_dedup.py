"""Removal of repeated runs of lines by winnowing, in DataFrame functions only.

Lines without a word are passed over. A run of the others weighs as much as its
lines together; a line weighs as many as it has words, and a third of WEIGHT at
least. So three lines, or WEIGHT words in any number of lines, are the least run that
is looked for. A *later repeat* is such a run that also stands at an earlier place.

1. Winnowing: of every window of least weight the line of the smallest hash
   (the rightmost of equal ones) is a fingerprint. Equal runs of enough weight have
   the same windows, so they are sure to share a fingerprint.
2. Fingerprints that occur once are dropped. The windows around the others are the
   positions that are joined: the one that ends and the one that starts at a line.
3. A match is extended both ways by stepping its window from line to line: each
   step is joined with the earliest place of the same lines, whichever document that
   is in, so a run is held against all earlier places at a cost in
   proportion to its lines. Windows that follow each other make up the whole run.
4. The lines of all later repeats are deleted.

Only hashes are shuffled; texts are joined with the runs to delete at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.llm._scratch import fresh, stage

#: Least words of a repeated run, unless it has three lines.
WEIGHT = 50
#: Up to this many documents with runs, or fingerprints, are broadcast (100 bytes each at most); more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_BLANKS = " \\t-\\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _hashed(lines: Column, weight: int) -> Column:
    """Of each line with a word: its place among all lines, its weight, and two independent hashes."""

    def line(x: Column, i: Column) -> Column:
        words = F.size(F.split(F.regexp_replace(x, f"^[{_BLANKS}]+|[{_BLANKS}]+$", ""), f"[{_BLANKS}]+"))
        return F.struct(i.alias("at"), F.greatest(words, F.lit(-(-weight // 3))).alias("w"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(1), x).alias("g"), x.rlike(f"[^{_BLANKS}]").alias("full"))

    return F.filter(F.transform(lines, line), lambda x: x["full"])


def _windows(lines: str, weight: int) -> Column:
    """Windows of least weight: those that start at a line, and those that end at one but do not start anywhere.

    Each has its first line (s) and the line after its last (e), both among lines with a word, the places of its first and
    last line in the text, its hashes (k1, k2), and the hash of its fingerprint (gram) with its line (pos).
    """

    def window(i: Column, n: int, inner: int) -> Column:
        """``n`` lines from i on; the first ``inner`` of them are the window that starts there."""
        own = [F.get(lines, i + k) for k in range(n)]
        least = F.least(*[x["h"] for x in own[:inner]]) if inner > 1 else own[0]["h"]
        pos = i
        for k in range(1, inner):
            pos = F.when(own[k]["h"] == least, i + k).otherwise(pos)
        return F.struct(
            i.alias("s"), (i + n).alias("e"), own[0]["at"].alias("start"), (own[-1]["at"] + 1).alias("end"), F.xxhash64(F.lit(n), *[x["h"] for x in own]).alias("k1"),
            F.xxhash64(F.lit(n), *[x["g"] for x in own]).alias("k2"), least.alias("gram"), pos.alias("pos"),
        )

    def at(i: Column) -> Column:
        w = [F.get(lines, i + k)["w"] for k in range(3)]
        starts = F.when(w[0] >= weight, window(i, 1, 1)).when(w[0] + w[1] >= weight, window(i, 2, 2)).when(w[0] + w[1] + w[2] >= weight, window(i, 3, 3))
        # a window that ends after i + 1 or i + 2 and could do without its last line
        two = F.when((w[0] >= weight) & (w[1] < weight), window(i, 2, 1))
        three = F.when(w[1] + w[2] < weight, F.when(w[0] >= weight, window(i, 3, 1)).when(w[0] + w[1] >= weight, window(i, 3, 2)))
        return F.array(starts, two, three)

    every = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.flatten(F.transform(every, at)), lambda x: x.isNotNull())


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: int = WEIGHT) -> DataFrame:
    """(doc_id, row, start, end) of the runs of lines to delete, from 0, end exclusive; row is a hash of the text.

    Runs of one document do not touch each other.
    """
    text = F.col(text_col)
    hashed = docs.select(F.col(id_col).cast("long").alias("doc_id"), _row(text).alias("row"), _hashed(_lines(text), weight).alias("lines"))
    windows = stage(hashed.where(F.size("lines") > 0).select("doc_id", "row", F.inline(_windows("lines", weight))), "line-windows")
    place = F.xxhash64("doc_id", "row", "pos")
    anchors = windows.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("gram")
    anchors = stage(anchors, "line-anchors")
    few = anchors.count() <= BROADCAST_ROWS
    places = windows.join(F.broadcast(anchors) if few else anchors, "gram").drop("gram", "pos")
    where = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "s")
    earliest = places.groupBy("k1", "k2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    later = places.join(earliest.hint("merge"), ["k1", "k2"]).where(~where.eqNullSafe(F.col("first")))
    runs = stage(later.select("doc_id", "row", "s", "e", "start", "end").distinct(), "line-later")
    own = W.partitionBy("doc_id", "row").orderBy("s")
    before = F.max("e").over(own.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(F.col("s") <= before, 0).otherwise(1)).withColumn("run", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def remove_repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weight: int = WEIGHT,
                         names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with the text left after deletion, its lines before and how many of them are gone.

    Lines are cut at newlines and compared whole. Ids order documents, null ids last, then text
    hashes; in a document earlier lines come first, so runs are matched within one as well and may
    overlap. Lines without a word go where the lines with words on either side go. Null texts are
    empty; an empty text is one line without a word and stays. Rows that repeat id and text are one
    document and get the same answer. Columns of ``docs`` named like ``names`` are replaced.
    """
    runs = repeated_runs(docs, id_col, text_col, weight)
    key, row, cuts, left = fresh(docs, "key", "row", "cuts", "left")
    cut = runs.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(cuts))
    cut = stage(cut.select(F.col("doc_id").alias(key), F.col("row").alias(row), cuts), "line-runs")
    few = cut.count() <= BROADCAST_ROWS
    rows = docs.drop(*[c for c in names if c in docs.columns])
    same = F.col(id_col).cast("long").eqNullSafe(F.col(key)) & (_row(F.col(text_col)) == F.col(row))
    rows = rows.join(F.broadcast(cut) if few else cut, same, "left")
    lines = _lines(F.col(text_col))
    gap = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda j: F.struct(F.coalesce(F.get(cuts, j - 1)["end"], F.lit(0)).alias("lo"), F.coalesce(F.get(cuts, j)["start"], F.size(lines)).alias("hi")),
    )
    kept = F.flatten(F.transform(gap, lambda x: F.slice(lines, x["lo"] + 1, x["hi"] - x["lo"])))
    gone = F.aggregate(cuts, F.lit(0), lambda n, x: n + x["end"] - x["start"])
    rows = rows.withColumn(names[0], F.size(lines).cast("long")).withColumn(names[1], F.coalesce(gone, F.lit(0)).cast("long"))
    rows = rows.withColumn(left, F.when(F.col(cuts).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n")))
    return rows.withColumn(text_col, F.col(left)).drop(key, row, cuts, left)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, text_sha256 of what is left."""
    rows = remove_repeated_runs(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return rows.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))
