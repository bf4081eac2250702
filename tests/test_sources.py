"""Readers, sinks, the stream and the engine on small files."""

from pyspark.sql import functions as F

from loregraph.engine import Engine
from loregraph.operators.store import Warehouse
from loregraph.sources import files, issues, rest
from loregraph.streaming import timeline


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return f"file://{path}"


def test_csv_variants(spark, tmp_path):
    comma = write(tmp_path / "a.csv", 'Issue key,Summary,Description,Status,Issue Type,Assignee,Labels,Custom Text\nPROJ-1,Sum,"line\nbreak",Open,Bug,,"bug,urgent",more\n,,,,,,,\n')
    rows = {r["key"]: r for r in issues.read_csv(spark, comma).collect()}
    assert rows["PROJ-1"]["labels"] == ["bug", "urgent"] and rows["PROJ-1"]["text_fields"] == {"Custom Text": "more"} and rows["PROJ-1"]["assignee"] is None
    assert "\n" in rows["PROJ-1"]["description"] and rows["(unknown-key)"]["summary"] == "(no summary)"
    semi = write(tmp_path / "b.csv", "﻿Vorgangsschlüssel:;Zusammenfassung;Stichwörter;Erstellt;Aktualisiert;Zusammenfassung\nAE-1;alt;x;23.10.2024 11:02;16.02.2026 11:12;neu\n")
    row = issues.read_csv(spark, semi).first()
    assert (row["key"], row["summary"], row["created_at"], row["updated_at"], row["event_day"]) == ("AE-1", "neu", "2024-10-23T11:02", "2026-02-16T11:12", "2026-02-16")
    only_header = write(tmp_path / "c.csv", "Issue key,Summary\n")
    assert issues.read_csv(spark, only_header).count() == 0


def test_pdfs(spark, tmp_path):
    write(tmp_path / "p/a.pdf", "one|two")
    write(tmp_path / "p/b.pdf", "!")

    def extract(content):
        if content == b"!":
            raise ValueError("broken")
        return content.decode().split("|")

    rows = {r["path"].rsplit("/", 1)[1]: r for r in files.read_pdfs(spark, f"file://{tmp_path}/p", extract).collect()}
    assert rows["a.pdf"]["pages"] == 2 and rows["a.pdf"]["text"].startswith("## Page 1") and rows["b.pdf"]["error"] == "broken"


def test_yaml_and_bundle(spark, tmp_path):
    write(tmp_path / "y/a.yaml", "quiz:\n  id: x\n")
    write(tmp_path / "y/b.yml", "a: [")
    rows = {r["path"].rsplit("/", 1)[1]: r["json"] for r in files.read_yaml_as_json(spark, f"file://{tmp_path}/y").collect()}
    assert rows == {"a.yaml": '{"quiz": {"id": "x"}}', "b.yml": None}
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "n int, line string")
    files.write_lines(lines, f"file://{tmp_path}/out", ["n"])
    assert [r["value"] for r in spark.read.text(f"file://{tmp_path}/out").collect()] == ["a", "b"]


def test_rest_rows_and_pages():
    issue = {"key": "A-1", "fields": {"summary": "s", "status": {"name": "Open"}, "assignee": {"displayName": "x"}, "labels": ["l"]}}
    assert rest.issue_row(issue)[:6] == ("A-1", "s", None, "Open", "Unknown", "x")
    pages = rest.IssueReader({"url": "http://h", "pagesize": "50", "maxresults": "120"}).partitions()
    assert [(p.start, p.size) for p in pages] == [(0, 50), (50, 50), (100, 20)]


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, "2026-01-01 10:00:00", "view"), (2, "2026-01-01 11:00:00", "view"), (3, "2026-01-02 10:00:00", "click")], "id int, t string, event_type string").withColumn("ts", F.col("t").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    q = timeline.daily_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["day"], r["kind"]): r["n"] for r in spark.table("counts").collect()} == {("2026-01-01", "view"): 2, ("2026-01-02", "click"): 1}
    w = Warehouse(spark, f"file://{tmp_path}/w")
    timeline.upsert_stream(stream.select("event_type", "id"), w, "events", ["event_type"], f"file://{tmp_path}/ck", "id").awaitTermination()
    assert {(r["event_type"], r["id"]) for r in w.read("events").collect()} == {("view", 2), ("click", 3)}


def test_engine(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    write(tmp_path / "md/a.md", "# Gateway\n\nThe gateway forwards every request to its service.\n\n- retry twice\n")
    engine.ingest(f"file://{tmp_path}/md", "markdown")
    engine.ingest(f"file://{tmp_path}/md", "markdown")
    assert engine.search_blocks("gateway").count() == 2 and engine.artifacts("glossary").count() == 1
    engine.ingest(write(tmp_path / "i.csv", "Issue key,Summary,Labels,Updated\nA-1,Gateway down,\"gateway,auth\",2026-02-16 11:12:00\nA-2,Login slow,auth,2026-02-17 11:12:00\n"))
    assert [r["key"] for r in engine.search("gateway").collect()] == ["A-1"]
    assert engine.timeline().count() == 2 and engine.graph()[1].where("relation = 'related_label'").count() == 2
    assert "auth" in {r["normalized_label"] for r in engine.promote_terms().collect()}
    class Lengths:
        def embed(self, text):
            return [float(len(text)), 1.0]

    made = {r["name"]: r["rows"] for r in engine.reimport(str(tmp_path / "i.csv"), Lengths(), "lengths").collect()}
    assert made["issues"] == 2 and made["embeddings"] == 1 and made["nodes"] > 4 and made["edges"] > 4 and made["terms"] >= 1
