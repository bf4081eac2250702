"""REST source with a stub that fails, progress of running imports, PDF jobs from clean-up to notes, Turtle documents."""

import json
import re
import urllib.error
import urllib.parse
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loregraph.operators import ontology, pdf_jobs, turtle
from loregraph.sources import files, rest
from loregraph.streaming import progress


def stub(folder, fail=2):
    """A service over issues.json in ``folder`` whose first ``fail`` answers are errors; runs in the tasks."""

    def get(url, headers):
        calls = folder / "calls"
        with calls.open("a") as log:
            log.write(url + "\n")
        n = len(calls.read_text().splitlines())
        if n <= fail:
            if n % 2:
                raise urllib.error.HTTPError(url, 503, "later", None, None)
            raise ConnectionResetError("lost")
        assert headers["Authorization"].startswith("Basic ")
        issues = json.loads((folder / "issues.json").read_text())
        parts = urllib.parse.urlparse(url)
        if "/issue/" in parts.path:
            key = urllib.parse.unquote(parts.path.rsplit("/", 1)[1])
            found = [i for i in issues if i["key"] == key]
            if not found:
                raise urllib.error.HTTPError(url, 404, "none", None, None)
            return json.dumps(found[0]).encode()
        q = dict(urllib.parse.parse_qsl(parts.query))
        jql = q.get("jql", "")
        for sign, text in re.findall(r'updated (>=|<) "([^"]+)"', jql):
            at = datetime.strptime(text, "%Y/%m/%d %H:%M").replace(tzinfo=timezone.utc)
            issues = [i for i in issues if (rest.moment(i["fields"]["updated"]) >= at) == (sign == ">=")]
        if own := re.search(r"project = (\w+)", jql):
            issues = [i for i in issues if i["key"].startswith(own[1] + "-")]
        issues.sort(key=lambda i: (rest.moment(i["fields"]["updated"]), i["key"]), reverse="DESC" in jql)
        start = int(q["startAt"])
        return json.dumps({"total": len(issues), "issues": issues[start : start + int(q["maxResults"])]}).encode()

    return get


def issue(key, updated, summary="s"):
    return {"key": key, "fields": {"summary": summary, "status": {"name": "Open"}, "issuetype": None, "assignee": {"displayName": "Ann"}, "labels": ["l"], "updated": updated}}


OPTIONS = {"url": "http://nowhere.invalid/", "user": "u", "token": "t", "backoff": "0.01"}


def at(seconds):
    return (datetime(2026, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)).isoformat(timespec="milliseconds")


def test_single_issue_and_pages_after_failures(spark, tmp_path):
    (tmp_path / "issues.json").write_text(json.dumps([issue(f"P-{k}", at(k)) for k in range(7)] + [issue("Q-1", at(0))]))
    rest.register(spark, stub(tmp_path))
    source = spark.read.format("issues").options(**OPTIONS)
    one = source.load().where("key = 'P-3'")
    assert [(r["key"], r["status"], r["issue_type"], r["assignee"], r["labels"]) for r in one.collect()] == [("P-3", "Open", "Unknown", "Ann", ["l"])]
    urls = (tmp_path / "calls").read_text().splitlines()
    assert len(urls) == 3 and all("/issue/P-3" in u for u in urls)  # two failures, and no search
    assert [r["key"] for r in source.option("key", "Q-1").load().collect()] == ["Q-1"]
    pages = spark.read.format("issues").options(**OPTIONS, jql="project = P", pagesize="3", maxresults="10").load()
    assert sorted(r["key"] for r in pages.collect()) == [f"P-{k}" for k in range(7)]
    with pytest.raises(Exception, match="404"):
        source.option("key", "none-1").load().collect()


def test_client_gives_up(tmp_path):
    client = rest.Client({**OPTIONS, "attempts": "2", "backoff": "0"}, stub(tmp_path, fail=9))
    with pytest.raises(OSError, match="lost"):
        client.issue("P-1")
    assert len((tmp_path / "calls").read_text().splitlines()) == 2


def test_stream_of_updates(spark, tmp_path):
    # 40 issues of one minute, more than pages hold, and some over an hour
    first = [issue(f"P-{k}", at(k)) for k in range(40)] + [issue(f"P-{k}", at(40 * k)) for k in range(40, 90)]
    (tmp_path / "issues.json").write_text(json.dumps(first))
    rest.register(spark, stub(tmp_path))
    where = {k: f"file://{tmp_path}/{k}" for k in ("out", "ck")}

    def run():
        rows = spark.readStream.format("issues").options(**OPTIONS, pagesize="7").load()
        rows.writeStream.format("parquet").option("path", where["out"]).option("checkpointLocation", where["ck"]).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["key"], r["summary"]) for r in spark.read.parquet(where["out"]).collect())

    assert run() == sorted((i["key"], "s") for i in first)
    later = [*first[1:], issue("P-0", at(9000), "again"), issue("P-90", at(9001))]
    (tmp_path / "issues.json").write_text(json.dumps(later))
    assert run() == sorted([*((i["key"], "s") for i in first), ("P-0", "again"), ("P-90", "s")])


def test_no_issue_is_lost_when_pages_shift(tmp_path):
    issues = [issue(f"P-{k:02}", at(30 * k)) for k in range(30)]
    folder = tmp_path
    get, calls = stub(folder, fail=0), []

    def moving(url, headers):
        """Between two pages one issue of the first is updated, so all that follow move up."""
        calls.append(url)
        if len(calls) == 3:
            issues[2] = issue("P-02", at(9999))
            (folder / "issues.json").write_text(json.dumps(issues))
        return get(url, headers)

    (folder / "issues.json").write_text(json.dumps(issues))
    reader = rest.IssueStreamReader({**OPTIONS, "pagesize": "5", "maxpartitions": "1"}, moving)
    parts = reader.partitions(reader.initialOffset(), {"updated": at(30 * 29)})
    assert len(parts) == 1 and {r[0] for r in reader.read(parts[0])} >= {f"P-{k:02}" for k in range(30)} - {"P-02"}


def test_progress_of_a_running_import(spark, tmp_path):
    for k in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.pdf").write_bytes(b"broken" if k == 3 else b"text %d" % k)
    seen = []
    listener = progress.ImportProgress(lambda *x: seen.append(x), total=5)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").option("maxFilesPerTrigger", 2).load(f"file://{tmp_path}/in")
        pages = stream.select("path", F.lit(1).alias("page"), F.when(F.col("content") == b"broken", "no pages").alias("error"))
        query = progress.watched(pages).writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert [x[0] for x in seen] == [2, 4, 5] and seen[-1] == (5, 1, 5)
    rows = spark.read.format("binaryFile").load(f"file://{tmp_path}/in").select(F.when(F.col("content") == b"broken", "no pages").alias("error"))
    told = []
    assert progress.reported(rows, lambda df: df.write.format("noop").mode("overwrite").save(), lambda *x: told.append(x), 5) == (5, 1) and told == [(5, 1, 5)]


def pdf_table(spark, rows):
    return spark.createDataFrame(rows, pdf_jobs.SCHEMA)


def test_clean_up_then_what_waits(spark, tmp_path):
    t = lambda s: datetime(2026, 1, 1) + timedelta(seconds=s)
    blank = (None,) * 4

    def job(i, path, status, started=None, domain="d", created=0, pages=2):
        return (i, path, domain, status, pages, 0, None, *blank, t(created), None if started is None else t(started), None)

    jobs = pdf_table(spark, [
        job("late", "/in/a.pdf", "processing", 0), job("runs", "/in/b.pdf", "processing", 700), job("old", "/in/c.pdf", "pending", created=1), job("new", "/in/c.pdf", "pending", created=2),
        job("bad", "/in/e.pdf", "pending"), job("void", "/in/f.pdf", "pending"), job("none", "/in/g.pdf", "pending"), job("other", "/in/c.pdf", "pending", domain="x"), job("ready", "/in/h.pdf", "done"),
    ])
    long = "A gateway forwards every request to the service behind it."
    texts = [("new", 1, f"{long}\n\n- first   item of a list that is long enough", None), ("new", 2, "second page " * 400, None), ("bad", 1, "fine", None), ("bad", 2, None, "page 2"), ("void", 1, "  \n", None)]
    pages = spark.createDataFrame(texts, "job_id string, page int, text string, error string")
    now = F.lit("2026-01-01 00:20:00").cast("timestamp")
    after, made, notes, counts = pdf_jobs.process_pending(jobs, lambda running: pages.join(running.select("job_id"), "job_id", "left_semi"), now, 600, "d")
    assert counts.collect()[0].asDict() == {"claimed": 4, "done": 1, "failed": 3, "total_pending": 4, "timed_out": 1}
    out = {r["job_id"]: r for r in after.collect()}
    assert {i: (r["status"], r["error_message"]) for i, r in out.items()} == {
        "late": ("failed", "Timed out after 600s"), "runs": ("processing", None), "new": ("done", None), "bad": ("failed", "page 2"), "void": ("failed", pdf_jobs.NO_TEXT), "none": ("failed", pdf_jobs.NO_TEXT),
        "other": ("pending", None), "ready": ("done", None),
    }
    done = out["new"]
    assert done["pages_processed"] == 2 and done["source_id"] == "pdf:d/c.pdf" and len(done["content_preview"]) == 1800 and done["content_preview"].startswith("## Page 1 A gateway")
    report = json.loads(done["result_json"])
    assert report["pages"] == 2 and report["blocks_imported"] == made.count() and report["artifact_id"] == done["artifact_id"] == notes.first()["artifact_id"]
    assert {r["block_type"] for r in made.collect()} == {"heading", "paragraph", "list_item"} and {r["source_type"] for r in made.collect()} == {"pdf"}
    assert out["bad"]["result_json"] is None and notes.count() == 1
    again = pdf_jobs.process_pending(after, lambda running: pages.join(running.select("job_id"), "job_id", "left_semi"), now, 600, "d")
    assert again[3].collect()[0]["claimed"] == 0 and again[0].count() == after.count() and again[1].count() == 0


def test_page_headings_stand_before_each_text(spark):
    pages = spark.createDataFrame([("j", k, f" text {k} " if k != 2 else " ", None) for k in (10, 2, 1)], "job_id string, page int, text string, error string")
    assert pdf_jobs.texts_of(pages).first()["text"] == "## Page 1\n\ntext 1\n\n## Page 10\n\ntext 10"
    assert files.page_text(["a", " ", "b"]) == "## Page 1\n\na\n\n## Page 3\n\nb"


HEAD = "@prefix ex: <http://e/> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
DOCUMENTS = {
    "blank": (HEAD + 'ex:A a rdfs:Class ; rdfs:label "A"@en ; rdfs:subClassOf [ a ex:R ; ex:on ex:p ; rdfs:label "inner" ] , ex:B .', [("http://e/A", "A", ["subClassOf", "subClassOf"])]),
    "list": (HEAD + 'ex:A ex:of ( ex:x [ ex:y ex:z ] ( ) "lit" ) ; rdfs:comment """long "one"\n.""" .', [("http://e/A", "A", ["of"])]),
    "base": ('BASE <http://b/dir/>\nPREFIX r: <voc#>\n<one> r:label "One" ; r:next <#two> , </three> . <#two> a r:Class .', [("http://b/dir/one", "One", ["next", "next"]), ("http://b/dir/#two", "two", [])]),
    "signs": (HEAD + "# ex:no a rdfs:Class .\nex:a.b rdfs:label 'x \\u0041 # no comment' ; ex:n 1.5 , true , -2e3 ; ex:rel ex:c\\,d ;; .", [("http://e/a.b", "x A # no comment", ["rel"])]),
    "undeclared": (HEAD + 'local:C rdfs:label "C" . <urn:d> rdfs:label "D"', [("urn:d", "D", [])]),
    "open string": (HEAD + 'ex:A rdfs:label "never closed .', []),
    "open list": (HEAD + "ex:A rdfs:label ( ex:x .", []),
    "no object": (HEAD + "ex:A rdfs:label .", []),
    "literal subject": (HEAD + '"x" rdfs:label "y" .', []),
    "deep": (HEAD + "ex:A ex:b " + "[ ex:b " * 20_000, []),
    "prefix only": (HEAD, []),
    "empty": ("", []),
    "null": (None, []),
}


def test_turtle_documents(spark):
    rows = ontology.parse(spark.createDataFrame([(k, t) for k, (t, _) in DOCUMENTS.items()], "path string, text string")).collect()
    found = {k: [(r["concept_id"], r["label"], [x["name"] for x in r["relations"]]) for r in sorted(rows, key=lambda r: r["pos"]) if r["path"] == k] for k in DOCUMENTS}
    assert found == {k: want for k, (_, want) in DOCUMENTS.items()}


def test_turtle_collections_are_chains():
    found = turtle.triples("@prefix : <http://e/> . :a :p ( :x ( ) ) . [ :q 1 ] . ( :y ) :r :z .")
    first, rest_, nil = (turtle.RDF + x for x in ("first", "rest", "nil"))
    plain = {(t.subject, t.predicate, t.object.value) for t in found}
    head = next(t.object.value for t in found if t.predicate == "http://e/p")
    tail = next(o for s, p, o in plain if (s, p) == (head, rest_))
    assert (head, first, "http://e/x") in plain and {(tail, first, nil), (tail, rest_, nil)} <= plain
    assert next(t for t in found if t.predicate == "http://e/q").object == turtle.Term("1", True)
    listed = next(t.subject for t in found if t.predicate == "http://e/r")
    assert (listed, first, "http://e/y") in plain
