"""Vector and trigram indexes, claims of jobs and streamed job states against scans, folds and batch versions."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from loregraph.operators import claims, jobs, pdf_jobs, search, text_index
from loregraph.operators.text_index import TextIndex
from loregraph.operators.vector_index import VectorIndex
from loregraph.streaming import job_states


def at(seconds):
    return datetime(2026, 1, 1) + timedelta(seconds=seconds)


def best(rows, queries, k):
    keys = [i for i, v in rows if v is not None and len(v) == 24 and 0 < np.linalg.norm(v) < np.inf]
    x = np.array([v for _, v in rows if v is not None and len(v) == 24 and 0 < np.linalg.norm(v) < np.inf])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q, v in queries:
        s = np.round(x @ (np.array(v) / np.linalg.norm(v)), 9)
        out[q] = [(keys[j], float(s[j])) for j in sorted(np.flatnonzero(s > 0), key=lambda j: (-s[j], keys[j]))[:k]]
    return out


def ranked(hits):
    out = {}
    for r in sorted(hits, key=lambda r: (r["q"], r["rank"])):
        out.setdefault(r["q"], []).append((r["key"], round(r["score"], 9)))
    return out


def test_vector_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    middle = rng.normal(0, 1, (12, 24))
    x = middle[rng.integers(0, 12, 900)] + rng.normal(0, 0.6, (900, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)]  # many alike
    odd = [(2000, None), (2001, [0.0] * 24), (2002, [1.0, 2.0]), (2003, [float("nan")] + [1.0] * 23), (2004, [float("inf")] + [1.0] * 23)]
    table = spark.createDataFrame(rows + odd, "key int, vector array<double>")
    queries = [(f"q{i}", rows[i][1]) for i in (5, 6, 77, 400)] + [("far", (-x.mean(axis=0)).tolist())]
    asked = spark.createDataFrame([*queries, ("zero", [0.0] * 24), ("short", [1.0])], "key string, vector array<double>")
    index = VectorIndex.build(table, f"file://{tmp_path}/ix", n_cells=20)
    assert index.rows().count() == len(rows) and sum(c["n"] for c in index.cells) == len(rows)
    want = best(rows, queries, 10)
    for probes in (None, 1):
        assert ranked(index.search(asked, 10, probes, exact=True).collect()) == {q: h for q, h in want.items() if h}
    again = VectorIndex(spark, f"file://{tmp_path}/ix")  # as stored
    own = spark.createDataFrame(rows[::10], "key int, vector array<double>")
    found, exact = ranked(again.search(own, 10).collect()), best(rows, rows[::10], 10)
    recall = np.mean([len({k for k, _ in found[q]} & {k for k, _ in exact[q]}) / len(exact[q]) for q in exact])
    assert recall >= 0.9 and again.recall >= 0.9 and again.probes <= len(again.cells)
    plan = index.rows().where(F.col("cell").isin(0, 3))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan  # a search reads its cells alone


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, None)]])
def test_vector_index_of_little(spark, tmp_path, rows):
    index = VectorIndex.build(spark.createDataFrame(rows, "key int, vector array<double>"), f"file://{tmp_path}/ix")
    hits = index.search(spark.createDataFrame([("q", [1.0, 1.0])], "key string, vector array<double>"), exact=True)
    assert [(r["q"], r["key"], round(r["score"], 6), r["rank"]) for r in hits.collect()] == ([("q", 1, 0.707107, 1)] if rows and rows[0][1] else [])


TEXTS = ["The gateway forwards requests", "GATEWAYS and doors", "a\nb line\nends", "Änderung am Gerät", "x", None, "", "🙂 smile 🙂🙂 end", "gate way", "token token tokenization", "oauth2-service"]


def test_text_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    words = ["gateway", "token", "Änderung", "requests", "smile", "door", "ab", "zz-top", "gerät"]
    rows = [(i, t, None if t is None else t[:10], t, None) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, t := " ".join(rng.choices(words, k=6)), t[:12], t, f"2026-01-{i % 28 + 1:02}") for i in range(150)]
    texts = spark.createDataFrame(rows, "key int, full_text string, summary string, description string, updated_at string")
    index = TextIndex.build(texts, f"file://{tmp_path}/ix")
    for query in ("gateway", "TOKENIZATION", "änderung gerät", "ab", "x", "zz-top smile", "nothing here", "🙂🙂", "line\nends", "", "the", "way"):
        for limit in (None, 5):
            scan, found = (f(query, limit).select("key", "score").collect() for f in (lambda q, k: search.lexical_search(texts, q, k), index.search))
            assert (scan == found if limit else sorted(scan) == sorted(found)), query
    seen = Observation()
    hits = index.search("tokenization", None, seen=seen).collect()
    assert len(hits) == 1 and seen.get["rows"] == 1  # one of 161 texts was looked at
    assert TextIndex.build(texts.limit(0), f"file://{tmp_path}/none").search("gateway").count() == 0


def brute_grams(texts):
    out = {}
    for key, t in texts:
        for i in range(len(t or "") - 2):
            out.setdefault(t[i : i + 3], set()).add(key)
    return out


@pytest.mark.parametrize("piece", [1, 40, 10_000])
def test_text_index_makes_a_list_for_each_trigram_of_a_piece(monkeypatch, piece):
    monkeypatch.setattr(text_index, "PIECE", piece)
    rng = random.Random(2)
    letters = "".join(map(chr, [*range(0x20, 0x7F), *range(0x4E00, 0x5E00), 0x1F642]))
    rows = [(f"k{i}", "".join(rng.choices(letters if i % 2 else "ab ", k=rng.choice([0, 1, 2, 3, 30])))) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([t for _, t in rows])], names=["key", "text"])
    found, parts = {}, 0
    for part in text_index._postings(iter([batch, batch.slice(0, 0)])):
        grams, parts = part.column("gram").to_pylist(), parts + 1
        assert grams == sorted(set(grams)) and part.column("n").to_pylist() == [len(k) for k in part.column("keys").to_pylist()]
        for g, keys in zip(grams, part.column("keys").to_pylist(), strict=True):
            assert len(keys) == len(set(keys)) and not found.get(g, set()) & set(keys)
            found.setdefault(g, set()).update(keys)
    assert found == brute_grams(rows) and (parts == 1 if piece == 10_000 else parts > 3)


def test_text_index_stores_few_rows_and_scans_for_frequent_trigrams(spark, tmp_path, monkeypatch):
    rows = [(i, f"the same words in all {i}" if i % 2 else f"the rare{i % 10}", None, None, None) for i in range(400)]
    texts = spark.createDataFrame(rows, "key int, full_text string, summary string, description string, updated_at string")
    index = TextIndex.build(texts, f"file://{tmp_path}/ix")
    grams = brute_grams([(k, t) for k, t, *_ in rows])
    assert {r["gram"]: r["n"] for r in index.counts.collect()} == {g: len(keys) for g, keys in grams.items()}
    assert index.postings.count() <= len(grams) * index.texts.rdd.getNumPartitions() < sum(map(len, grams.values()))  # not a row for each key
    assert index.candidates(["same"]) is None and index.candidates(["the", "rare4"]) is None  # half of the texts or all of them
    assert sorted(r["key"] for r in index.candidates(["rare4"]).collect()) == [i for i in range(400) if i % 10 == 4]
    expected = sorted(search.lexical_search(texts, "rare4", None).select("key", "score").collect())
    for named, most in ((2_000, 500_000), (5, 500_000), (5, 5)):  # named in the filter, broadcast, joined
        monkeypatch.setattr(text_index, "NAMED", named)
        monkeypatch.setattr(text_index, "BROADCAST_KEYS", most)
        assert sorted(index.search("rare4", None).select("key", "score").collect()) == expected and len(expected) == 40


def test_grants_in_turn(spark):
    rows = [("j", 1, "a", at(0), "c1"), ("j", 1, "b", at(0), "c2"), ("j", 1, "b", at(599), "c3"), ("j", 1, "c", at(600), "c4"), ("j", 1, "a", at(1300), "c5"), ("j", 1, "a", at(1300), "c5"), ("j", 2, "b", at(1), "c6"), ("k", 1, "b", None, "c7")]
    table = spark.createDataFrame(rows, claims.SCHEMA)
    assert sorted((r["job_id"], r["attempt"], r["claimer"], r["claim_id"]) for r in claims.grants(table).collect()) == [("j", 1, "a", "c1"), ("j", 1, "a", "c5"), ("j", 1, "c", "c4"), ("j", 2, "b", "c6")]
    now = F.lit(at(620))
    assert [(r["job_id"], r["attempt"]) for r in claims.held(table, "c", now, 20).collect()] == [("j", 1)] and claims.held(table, "c", now, 21).count() == 0
    assert claims.grants(table.limit(0)).count() == 0


def test_two_claimers_never_hold_one_job(spark, tmp_path):
    """Two workers ask at about the same times, one before it can read what the other has just written."""
    rng = random.Random(7)
    path = f"file://{tmp_path}/claims"
    spark.createDataFrame([], claims.SCHEMA).write.parquet(path)
    queue = spark.createDataFrame(
        [(f"j{i:02}", "t", "pending", i % 3, None, at(i)) for i in range(30)] + [("busy", "t", "running", 1, None, at(0)), ("later", "t", "pending", 1, at(9999), at(0))],
        "job_id string, job_type string, status string, attempts int, next_retry_at timestamp, updated_at timestamp",
    )
    worked = []
    for turn in range(4):
        base = 1000 + 100 * turn
        read = {c: spark.read.schema(claims.SCHEMA).parquet(path) for c in "ab"}
        made = {c: claims.asked(queue, read[c], c, F.lit(at(base + rng.randint(0, 5))), 6, lease_s=10_000).collect() for c in "ab"}  # before either writes
        for c in rng.sample("ab", 2):
            spark.createDataFrame(made[c], claims.SCHEMA).write.mode("append").parquet(path)
        table = spark.read.schema(claims.SCHEMA).parquet(path)
        mine = {c: {r["job_id"] for r in claims.held(table, c, F.lit(at(base + 40)), lease_s=10_000).collect()} for c in "ab"}
        assert not mine["a"] & mine["b"] and len(mine["a"] | mine["b"]) == 6 * (turn + 1)
        worked.append(mine["a"] | mine["b"])
        shown = claims.with_claims(queue, table, F.lit(at(base + 40)), 10_000)
        running = {r["job_id"]: (r["claimer"], r["attempts"]) for r in shown.where("claimer IS NOT NULL AND status = 'running'").collect()}
        assert {i for i, (c, _) in running.items() if c == "a"} == mine["a"] and all(n == int(i[1:]) % 3 + 1 for i, (_, n) in running.items())
        assert shown.count() == queue.count()
    assert worked[-1] == {f"j{i:02}" for i in range(24)}  # the longest waiting ones
    late = claims.asked(queue, spark.read.schema(claims.SCHEMA).parquet(path), "c", F.lit(at(20_000)), 100, lease_s=10_000)
    assert late.count() == 31  # leases have run out, and the retry is due


def batch_states(spark, events, timeout_s, now):
    """The events of jobs that run once, by the batch operators, in the order of their times."""
    ids = sorted({e[0] for e in events})
    empty = spark.createDataFrame([], pdf_jobs.SCHEMA)
    rows = empty.unionByName(spark.createDataFrame([(i, "pending", 0) for i in ids], "job_id string, status string, pages_processed int"), allowMissingColumns=True)
    for i, kind, t, pages, error in sorted(events, key=lambda e: e[2]):
        when, one = F.lit(t), spark.createDataFrame([(i, pages, error)], "job_id string, pages_processed int, error_message string")
        rows = {"created": lambda r: r, "started": lambda r: pdf_jobs.start(r, one, when), "progress": lambda r: pdf_jobs.progress(r, one), "done": lambda r: pdf_jobs.complete(r, one, when), "failed": lambda r: pdf_jobs.fail(r, one, when)}[kind](rows)
    rows = jobs.clean_stale(rows.withColumn("path", F.col("job_id")), F.lit(now), timeout_s)
    return {r["job_id"]: (r["status"], r["pages_processed"], r["error_message"] is not None) for r in rows.collect()}


def run_states(spark, path, parts, **options):
    """Feeds ``parts`` one after the other, a query of its own for each, all from one checkpoint; last rows and all rows."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    for k, v in job_states.CONF.items():
        session.conf.set(k, v)
    for part in parts:
        session.createDataFrame(part, job_states.EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        out = job_states.job_states(session.readStream.schema(job_states.EVENTS).parquet(f"{path}/in"), **options)
        query = out.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/ck")
        query.trigger(availableNow=True).start().awaitTermination()
    return [r.asDict() for r in session.read.parquet(f"{path}/out").collect()]


def test_streamed_states_are_those_of_the_batch(spark, tmp_path):
    events = [
        ("fine", "created", at(0), None, None), ("fine", "started", at(10), None, None), ("fine", "progress", at(20), 3, None), ("fine", "done", at(30), None, None),
        ("bad", "created", at(0), None, None), ("bad", "started", at(5), None, None), ("bad", "failed", at(9), None, "page 2"), ("stuck", "created", at(1), None, None), ("stuck", "started", at(2), None, None),
        ("waits", "created", at(3), None, None),
    ]
    later = [("edge", "created", at(1000), None, None), ("edge", "started", at(1000), None, None), ("edge", "progress", at(1300), 7, None)]
    last = [("tick", "created", at(1600), None, None)]
    rows = run_states(spark, f"file://{tmp_path}", [events, later, last], timeout_s=600)
    final = {}
    for r in sorted(rows, key=lambda r: r["updated_at"]):
        final[r["job_id"]] = (r["status"], r["pages_processed"], r["error_message"] is not None)
    assert final == batch_states(spark, events + later + last, 600, at(1600))
    assert final["stuck"] == ("failed", 0, True) and final["edge"] == ("processing", 7, False)
    stuck = next(r for r in rows if r["job_id"] == "stuck" and r["status"] == "failed")
    assert stuck["error_message"] == "Timed out after 600s" and stuck["updated_at"] == at(602) + timedelta(milliseconds=1)
    assert len(rows) == len({(r["job_id"], r["status"], r["pages_processed"]) for r in rows})  # a restart repeats nothing


def test_streamed_retries(spark, tmp_path):
    first = [("r", "created", at(0), None, None), ("r", "started", at(1), None, None), ("r", "failed", at(2), None, "no answer"), ("r", "started", at(60), None, None)]
    second = [("tick", "created", at(200), None, None)]
    third = [("r", "started", at(210), None, None), ("r", "done", at(220), None, None), ("r", "done", at(230), None, None), ("tick", "created", at(240), None, None)]
    rows = [r for r in run_states(spark, f"file://{tmp_path}", [first, second, third], timeout_s=600, retries=True) if r["job_id"] == "r"]
    shown = [(r["status"], r["attempts"], r["next_retry_at"]) for r in sorted(rows, key=lambda r: r["updated_at"])]
    # the start at 60 comes too early: the retry is due two minutes after the failure
    assert shown == [("pending", 0, None), ("processing", 1, None), ("pending", 1, at(122)), ("due", 1, None), ("processing", 2, None), ("done", 2, None)]


def test_warehouse_writes_only_the_partitions_of_its_keys(spark, tmp_path):
    from pathlib import Path

    from loregraph.operators.store import Warehouse

    root = f"file://{tmp_path}/w"
    w = Warehouse(spark, root, parts=8)
    early, late = (F.lit(t).cast("timestamp") for t in ("2026-01-01", "2026-01-02"))
    w.upsert("t", spark.createDataFrame([(i, f"a{i}") for i in range(40)], "id int, v string"), ["id"], early)

    def files():
        return {str(f.relative_to(tmp_path)) for f in Path(tmp_path, "w/t").rglob("*.parquet")}

    before = files()
    w.upsert("t", spark.createDataFrame([(3, "b3", 1.5), (99, "b99", None)], "id int, v string, more double"), ["id"], late)
    assert len({f.split("/")[2] for f in before - files()}) <= 2 and before & files()  # other partitions have their files still
    rows = {r["id"]: (r["v"], r["more"], r["created_at"].day, r["updated_at"].day) for r in w.read("t").collect()}
    assert len(rows) == 41 and rows[3] == ("b3", 1.5, 1, 2) and rows[99] == ("b99", None, 2, 2) and rows[4] == ("a4", None, 1, 1)
    w.upsert("t", w.read("t").where("id < 10").select("id", F.lit("own").alias("v")), ["id"], late)  # from the table itself
    assert w.read("t").where("v = 'own'").count() == 10 and w.read("t").count() == 41
    assert w.delete("t", spark.createDataFrame([(i,) for i in range(0, 200, 2)], "id int"), "id") == 20 and w.delete("t", w.read("t").limit(0), "id") == 0
    assert {r["id"] for r in w.read("t").collect()} == {*range(1, 40, 2), 99}
    assert w.delete("t", w.read("t"), "id") == 21 and w.read("t").count() == 0  # every partition is emptied
    w.append("t", spark.createDataFrame([(1, "x"), (1, "x")], "id int, v string"))
    assert w.read("t").count() == 2 and w.read("t").columns == ["id", "v", "created_at", "updated_at", "more"]
    w.write("t", spark.createDataFrame([("k", 1)], "key string, n int"))
    assert [tuple(r) for r in w.read("t").collect()] == [("k", 1)]
    # a session whose catalog does not know the table
    spark.sql(f"DROP TABLE `{w.database}`.`t`")
    again = Warehouse(spark, root, parts=8)
    assert not again.exists("none") and [tuple(r) for r in again.read("t").collect()] == [("k", 1)]
    again.upsert("t", spark.createDataFrame([("k", 2), ("m", 3)], "key string, n int"), ["key"], late)
    assert {r["key"]: r["n"] for r in again.read("t").collect()} == {"k": 2, "m": 3}
    with pytest.raises(KeyError):
        w.read("none")
