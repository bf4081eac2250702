"""Operators on constructed rows: cases that the star schema does not have."""

import datetime as dt
import unicodedata
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loregraph.functions import dates, values
from loregraph.functions import text as tx
from loregraph.operators import artifacts, blocks, domains, graph, jobs, listings, mining, ontology, pdf_jobs, prompts, quiz, search, store, terms, vectors
from loregraph.sources import issues as issue_source


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


ISSUES = "key string, summary string, description string, labels array<string>, updated_at string, created_at string, assignee string, status string, issue_type string, seen int"


def issue_table(spark, rows):
    full = [(k, s, d, labels, u, None, a, "Open", "Task", i) for i, (k, s, d, labels, u, a) in enumerate(rows)]
    return issue_source.derived(spark.createDataFrame(full, ISSUES))


def test_text_columns(spark):
    assert one(spark, tx.canonical_term(F.lit(" OAuth2-Services "))) == "oauth service"
    assert one(spark, tx.canonical_term(F.lit("Web Systems"))) == "web system"
    assert one(spark, tx.search_tokens(F.lit("Die Änderung und die Änderung am API-Gateway"))) == ["änderung", "änderung", "api-gateway"]
    assert one(spark, tx.search_tokens(F.lit(None).cast("string"))) == []
    assert one(spark, tx.label_terms(F.lit("api-gateway"))) == ["api gateway", "gateway"]
    assert one(spark, tx.snippet(F.lit("a  b\nc" * 50), 10)).endswith("…")
    assert one(spark, tx.tfidf_tokens(F.lit("Café ßtraße x1y"))) == ["cafe", "trae", "x1y"]
    for odd in ("ﬁn ½ Ⅷ ㏂ e\u0301 ｆｕｌｌ 한 🙂 𝐁old ①②", "", "plain", "Ångström ǅ İ"):
        assert one(spark, tx.fold(F.lit(odd))) == unicodedata.normalize("NFKD", odd).encode("ascii", "ignore").decode()
    assert one(spark, tx.domain_name(F.lit("  My Domain! "))) == "my-domain"
    assert one(spark, tx.domain_name(F.lit("!!"))) == "default"
    assert one(spark, tx.id_tail(F.lit("http://x/y#Thing"))) == "Thing"
    assert one(spark, tx.chunks(F.lit("short"))) == ["short"] and one(spark, tx.chunks(F.lit(" \n "))) == []
    assert one(spark, tx.block_id(F.lit("/x/notes.md"), F.lit("heading"), F.lit("Intro"), F.lit(0))) == "5be346ec80914873"
    assert one(spark, tx.hashed_id("term:", tx.canonical_term(F.lit("OAuth2")))) == "term:b7e9a6e2e04ed3edbf8b"


@pytest.mark.parametrize(("text", "day"), [("2026-02-16T11:12", "2026-02-16"), ("16.02.2026 11:12", "2026-02-16"), ("2026-02-16T23:12:00+05:00", "2026-02-16"), ("20260216", "2026-02-16"), ("soon", None), (None, None)])
def test_days(spark, text, day):
    assert one(spark, dates.event_day(F.lit(text).cast("string"), F.lit(None).cast("string"))) == day


def test_values(spark):
    assert one(spark, values.clamp(F.lit(7.0))) == 1.0 and one(spark, values.percent(F.lit(1), F.lit(0))) == 0.0
    assert one(spark, values.json_array(F.lit("[\"a\", \"b\"]"))) == ["a", "b"] and one(spark, values.json_array(F.lit("oops"))) == []
    assert one(spark, values.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0)))) == 0.0
    assert one(spark, values.model_answer(F.lit("```json\n{\"a\": 1}\n```"), "a int"))["a"] == 1


def test_timeline_and_topics(spark):
    rows = issue_table(
        spark,
        [
            ("AE-1", "Splunk dashboard aufsetzen", "Monitoring für Login-Flows", ["splunk", "monitoring"], "2026-02-16T11:12", None),
            ("AE-2", "Alerting verbessern", "Splunk Alert Regeln erweitern", ["splunk", "alerting"], "2026-02-16T15:42", None),
            ("AE-3", "Dokumentation ergänzen", "Runbook für Incident Handling", ["runbook"], "2026-02-17T08:10", None),
        ],
    )
    days = {r["day"]: r for r in mining.daily_timeline(rows).collect()}
    assert days["2026-02-16"]["issue_count"] == 2
    topics = {r["day"]: r["topics"] for r in mining.daily_topics(rows).collect()}
    assert topics["2026-02-16"] == ["splunk", "monitoring", "alerting"]
    assert topics["2026-02-17"] == ["runbook", "dokumentation", "ergänzen", "incident"]
    assert mining.daily_timeline(rows, 1).count() == 1
    assert mining.daily_topics(rows.limit(0)).collect() == []


def test_lexical_and_hybrid(spark):
    rows = issue_table(
        spark,
        [("AE-10", "Support Portal Fehlerbild", "Kunde meldet Login-Probleme im Portal", ["support", "portal"], "2026-02-18T09:15", None), ("AE-11", "Monitoring Dashboard", None, ["monitoring"], "2026-02-18T10:15", None)],
    )
    hits = search.lexical_search(rows, "Portal").collect()
    assert [(r["key"], r["score"]) for r in hits] == [("AE-10", 7)]
    lexical = spark.createDataFrame([("a", 4.0), ("b", 2.0)], "key string, score double")
    semantic = spark.createDataFrame([("b", 0.5), ("c", 0.25)], "key string, score double")
    fused = {r["key"]: round(r["combined_score"], 6) for r in search.fuse(lexical, semantic).collect()}
    assert fused == {"a": 0.35, "b": 0.825, "c": 0.325}
    weights, vocab = vectors.tfidf(rows, "key", "full_text")
    got = search.hybrid_search(rows, weights, "Portal", vectors.query_weights(spark, "Portal", vocab)).collect()
    assert [(r["key"], round(r["combined_score"], 6)) for r in got] == [("AE-10", 1.0)]


def test_domain_terms(spark):
    rows = issue_table(spark, [("AE-30", "x", "ticket text", ["auth", "oauth", "api-gateway"], None, None), ("AE-31", "y", None, ["auth", "gateway"], None, None)])
    found = {r["term"]: r for r in mining.domain_terms(rows, 2, 10).collect()}
    assert {"auth", "gateway", "oauth", "api gateway"} <= set(found) and "ticket" not in found and "api" not in found
    assert found["auth"]["label_hits"] == 2 and found["auth"]["sample_issue_keys"] == ["AE-30", "AE-31"]
    assert "auth" not in {r["term"] for r in mining.domain_terms(rows, 1, 10, excluded=["auth"]).collect()}


def test_domain_terms_of_many_issues(spark, monkeypatch):
    issues = [(f"K-{i % 70}", [["Red_Car", "blue", None][i % 3]], f"common word{i % 9} common", {"comment 1": f"word{i % 4} spoken"} if i % 5 else None) for i in range(80)] + [("A-0", None, None, None)]
    rows = spark.createDataFrame(issues, "key string, labels array<string>, description string, text_fields map<string,string>")
    hits = {}
    for key, labels, text, fields in issues:
        marked = [("label", t) for x in labels or [] if x for t in {"red car", "blue"} if t == x.lower().replace("_", " ")]
        marked += [("description", t) for t in (text or "").split()] + [("comment", t) for v in (fields or {}).values() for t in v.split()]
        for source, t in marked:
            hits.setdefault(t, []).append((source, key))
    for first in (2_000, 3):
        monkeypatch.setattr(mining, "FIRST_KEYS", first)
        found = mining.domain_terms(rows, 1, None)
        if first > len(issues):  # no ranking of the issues of a common term
            assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        found = {r["term"]: r for r in found.collect()}
        assert set(hits) <= set(found)
        for t, h in hits.items():
            keys, labels = sorted({k for _, k in h}), sum(s == "label" for s, _ in h)
            assert (found[t]["count"], found[t]["issue_count"], found[t]["label_hits"]) == (len(h) + 5 * labels, len(keys), labels)
            assert found[t]["sources"] == sorted({s for s, _ in h}) and found[t]["sample_issue_keys"] == keys[:5]


def test_long_path(spark):
    ids = [f"n{k:02}" for k in range(14)]
    chain = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "src_id string, dst_id string")
    assert graph.shortest_path(chain, ids[0], ids[-1]) == ids
    assert graph.shortest_path(chain, ids[0], ids[-1], 10) == []


def test_graph(spark):
    rows = issue_table(spark, [("AE-100", "a", "b", ["support", "portal"], "2026-01-01T10:00", "alice"), ("AE-101", "c", "d", ["support", "faq"], "2026-01-02T10:00", "bob")])
    nodes, edges = graph.issue_nodes(rows), graph.issue_edges(rows)
    related = graph.related_label_edges(rows)
    assert nodes.count() == 11 and edges.count() == 12 and related.count() == 2
    every = edges.unionByName(related)
    near = graph.neighbors(every, nodes, "issue:AE-100").collect()
    assert {r["relation"] for r in near} == {"assigned_to", "has_status", "has_type", "updated_on", "has_label", "related_label"}
    seeds = spark.createDataFrame([("issue:AE-100", 1)], "node_id string, rank int")
    assert [r["node_id"] for r in graph.expand(every, seeds, ["related_label"]).collect()] == ["issue:AE-101"]
    assert "MERGE" in graph.cypher(nodes, edges).first()["line"]
    chain = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a")], "src_id string, dst_id string")
    assert graph.shortest_path(chain, "a", "c") == ["a", "b", "c"] and graph.shortest_path(chain, "a", "zz") == []
    one_edge = spark.createDataFrame([("a", "b", "r", 1.0)], "src_id string, dst_id string, relation string, weight double")
    two = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert graph.statistics(two, one_edge).first()["density"] == 0.5


def test_graph_of_issues_in_one_pass(spark):
    cols = ("assignee", "status", "issue_type", "event_day")
    issues = [(f"K-{i % 50}", f"s{i}", i, ["Ann", "ann", None][i % 3], ["Open", None][i % 2], "Bug", "2026-01-01" if i % 4 else None, [["X", "x", "Y"], ["y", None], [], None][i % 4]) for i in range(70)]
    rows = spark.createDataFrame(issues, "key string, summary string, seen long, assignee string, status string, issue_type string, event_day string, labels array<string>")
    last, links = {}, set()
    for key, summary, seen, *values, labels in issues:
        last.setdefault(f"issue:{key}", []).append((seen, summary, "issue"))
        named = [*zip(("assignee", "status", "type", "day"), ("assigned_to", "has_status", "has_type", "updated_on"), values, strict=True), *[("label", "has_label", x) for x in labels or []]]
        for kind, relation, value in named:
            if value is not None:
                last.setdefault(f"{kind}:{value.lower()}", []).append((seen, value, kind))
                links.add((f"issue:{key}", f"{kind}:{value.lower()}", relation, 1.0))
    nodes, edges = graph.issue_nodes(rows), graph.issue_edges(rows)
    assert sorted(map(tuple, nodes.collect())) == sorted((n, max(v)[2], max(v)[1]) for n, v in last.items())
    assert sorted(map(tuple, edges.collect())) == sorted(links) and len({x[:2] for x in links}) == len(links)
    for simple in (False, True):
        degree = {r["node_id"]: r["degree"] for r in graph.degrees(edges, simple).collect()}
        assert degree == Counter(x for link in links for x in link[:2])
        assert graph.statistics(nodes, edges, simple).first()[:2] == (len(last), len(links))
    # the issues are read once for all of their edges
    assert "Union" not in edges._jdf.queryExecution().optimizedPlan().toString()


MARKDOWN = """intro
text

# One
a
b
- x
* y
### Deep
```
# no heading

  code
```
## Two
1. first
   more
####### seven
```
open"""


def test_markdown(spark):
    docs = spark.createDataFrame([("d", MARKDOWN), ("n", None), ("e", ""), ("f", "```\n```\nx")], "path string, text string")
    rows = blocks.parse_markdown(docs).orderBy("path", "order_index").collect()
    got = [(r["block_type"], r["content"], r["heading_path"]) for r in rows if r["path"] == "d"]
    assert got == [
        ("paragraph", "intro text", ""), ("heading", "One", "One"), ("paragraph", "a b", "One"), ("list_item", "x", "One"), ("list_item", "y", "One"), ("heading", "Deep", "One / Deep"),
        ("code_block", "# no heading\n\ncode", "One / Deep"), ("heading", "Two", "One / Two"), ("list_item", "first", "One / Two"), ("paragraph", "more ####### seven", "One / Two"), ("code_block", "open", "One / Two"),
    ]
    by_id = {r["block_id"]: r["content"] for r in rows}
    parents = {r["content"]: by_id.get(r["parent_id"]) for r in rows if r["path"] == "d"}
    assert parents["Deep"] == parents["Two"] == "One" and parents["open"] == "Two" and parents["intro text"] is None
    assert [r["content"] for r in rows if r["path"] == "f"] == ["x"] and not [r for r in rows if r["path"] in "ne"]
    assert {r["block_type"] for r in blocks.only_types(blocks.parse_markdown(docs), ["list_item"]).collect()} == {"heading", "list_item"}


JSON_LD = '{"@graph": [{"@id": "x:Psychology", "label": "Psychology", "comment": "The study of mind and behaviour, in all of its many forms.....", "broader": {"@id": "x:Cognition"}}, {"@id": "x:Cognition", "prefLabel": "Cognition", "definition": "Knowing, in short form."}]}'
TURTLE = '@prefix ex: <http://e/> .\n@prefix rdfs: <http://r#> .\nex:Control a rdfs:Class ; rdfs:label "Security Control"@en ; rdfs:comment "A safeguard." ; ex:partOf ex:Policy, ex:Plan .\nex:Policy rdfs:label "Policy" .'
RDF = '<rdf:RDF xmlns:rdf="http://r#" xmlns:s="http://s#"><s:Class rdf:about="http://e/Therapy"><s:label>Therapy</s:label><s:comment>A treatment that is meant to relieve a disorder of any kind.</s:comment><s:subClassOf rdf:resource="http://e/Care"/></s:Class></rdf:RDF>'


def test_ontology(spark):
    docs = spark.createDataFrame([("j", JSON_LD), ("t", TURTLE), ("x", RDF), ("b", "{broken"), ("n", None)], "path string, text string")
    rows = ontology.ranked(ontology.parse(docs)).collect()
    assert {(r["path"], r["label"]): r["quality"] for r in rows} == {("j", "Psychology"): 5, ("j", "Cognition"): 3, ("t", "Security Control"): 4, ("t", "Policy"): 2, ("x", "Therapy"): 5}
    chosen = ontology.select(ontology.parse(docs), ["cognition"], 5)
    assert chosen.where("path = 'j'").orderBy("rank").first()["label"] == "Cognition"
    assert {(r["src_id"], r["dst_id"]) for r in ontology.relations(chosen).collect()} == {("x:Psychology", "x:Cognition"), ("http://e/Control", "http://e/Policy")}
    assert "## 1. Cognition" in ontology.markdown(chosen).where("path = 'j'").first()["markdown"]


def test_quiz_shapes(spark):
    docs = [
        '{"quiz": {"id": "care-1", "title": "Care", "sections": [{"title": "S", "summary": "text", "sameAs": ["http://a"]}], "questions": [{"id": "q1", "question": "Why?", "options": [{"id": "A", "text": "yes"}, {"id": "B", "text": "no"}], "correct_option_id": "A"}]}}',
        '{"data": {"Modul": {"id": "care-2", "kernkonzepte": [{"begriff": "K", "definition": "D", "dimensionen": ["x"]}], "quiz_fragen": [{"frage_text": "Was?", "antwort_optionen": [{"id": "A", "text": "a"}], "korrekte_antwort_id": "A"}]}}}',
        "nothing",
    ]
    modules = quiz.normalise(spark.createDataFrame([(d,) for d in docs], "json string"))
    kinds = {(r["source_id"], r["block_type"]): r["content"] for r in quiz.records(modules.where("module_id IS NOT NULL")).collect()}
    assert kinds[("quiz:care-1", "quiz_question")] == "Why?" and kinds[("quiz:care-2", "quiz_section")] == "D\nx" and kinds[("quiz:care-2", "quiz_question")] == "Was?"
    edges = {r["relation"] for r in quiz.relations(modules).collect()}
    assert edges == {"contains", "same_as", "has_option", "correct_option"}


def test_terms(spark):
    found = spark.createDataFrame([("OAuth2", 10, 4, ["label"], ["A"]), ("authorization", 3, 2, ["description"], ["B"]), ("oauth", 2, 1, ["label"], ["C"])], "term string, count int, issue_count int, sources array<string>, sample_issue_keys array<string>")
    made, marked = terms.promote(terms.candidates(found))
    assert {(r["normalized_label"], r["canonical_label"]) for r in made.collect()} == {("oauth", "OAuth2"), ("authorization", "authorization")}
    assert marked.where("promoted_term_id IS NULL").count() == 0
    t = made.withColumn("seen", F.lit(0))
    records = spark.createDataFrame([("r", "# Ops\nOAuth retries via API Gateway require stable tokens."), ("s", "oauths are unlike it, says none")], "record_id string, content string")
    assert [(r["record_id"], r["evidence"]) for r in terms.record_links(records, t).collect()] == [("r", "matched 'oauth'")]
    gaps = terms.term_gaps(spark.createDataFrame([(1, "API Gateway")], "term_id int, canonical_label string"), spark.createDataFrame([(1, 1, "short_fact", 0.35, None)], "fact_id int, term_id int, fact_type string, confidence double, supersedes_fact_id int"), spark.createDataFrame([], "source_term_id int"), min_confidence=0.7)
    assert round(gaps.first()["priority_score"], 6) == 10.35
    answers = spark.createDataFrame(
        [
            (1, 'x {"definition": "D", "short_facts": ["a", "A", "b"], "related_terms": [{"label": "Token", "relation": "uses", "weight": 2}, {"label": "Key"}, {"label": " "}]} y'), (2, "no json"),
            (3, '{"definition": "OAuth ist ein Framework.", "short_facts": ["OAuth nutzt Tokens."], "related_terms": [{"label":"OpenID Connect","relation":"related_to","weight":0.8}], "confidence": 0.86}'),
        ],
        "term_id int, answer string",
    )
    facts = spark.createDataFrame([(1, "short_fact", "B")], "term_id int, fact_type string, content string")
    new, links = terms.enriched(answers, facts, F.lit("2026-01-01"))
    assert sorted((r["term_id"], r["content"], r["confidence"]) for r in new.collect()) == [(1, "D", 0.6), (1, "a", 0.6), (3, "OAuth ist ein Framework.", 0.86), (3, "OAuth nutzt Tokens.", 0.86)]
    assert sorted((r["source_term_id"], r["target_label"], r["relation_type"], r["weight"]) for r in links.collect()) == [(1, "Key", "related_to", 0.5), (1, "Token", "uses", 1.0), (3, "OpenID Connect", "related_to", 0.8)]
    assert terms.enriched(answers, facts, F.lit("2026-01-01"), links)[1].collect() == []


def test_jobs(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    none = spark.createDataFrame([], "job_id string, key string, job_type string, status string, attempts int, next_retry_at timestamp, error_message string, created_at timestamp, updated_at timestamp")
    queue = jobs.enqueue(spark.createDataFrame([("a",), ("b",), ("a",)], "key string"), none, "enrich", now)
    assert queue.count() == 2 and jobs.enqueue(queue.select("key"), queue, "enrich", now).count() == 0
    taken, after = jobs.claim(queue, now, 1)
    assert taken.count() == 1 and after.where("status = 'running'").count() == 1

    def work(job):
        raise ValueError("no")

    done = jobs.finish(taken, jobs.run(taken, work), now).first()
    assert (done["status"], done["error_message"]) == ("pending", "no") and done["next_retry_at"] == dt.datetime(2026, 1, 1, 0, 2)
    assert jobs.finish(taken.withColumn("attempts", F.lit(5)), jobs.run(taken, work), now).first()["status"] == "failed"


def test_artifacts(spark):
    rows = [("c", "b1", "heading", "Eins", None, "x" * 60, 0), ("c", "b2", "paragraph", "Zwei", None, "y " * 200, 1), ("c", "b3", "quiz_option", "O", None, "z" * 60, 2), ("c", "b4", "paragraph", None, "/p", "short", 3)]
    records = spark.createDataFrame(rows, "source_id string, block_id string, block_type string, title string, path string, content string, order_index int")
    cards = artifacts.flashcards(records).orderBy("card_id").collect()
    assert [c["front"] for c in cards] == ["Eins", "Zwei"] and cards[1]["back"].endswith("…")
    first = artifacts.quiz(records).orderBy("question_id").first()
    assert first["options"] == ["Eins", "Zwei"] and first["correct_option_id"] == "A"
    assert set(artifacts.every(records)) == {"quiz", "flashcards", "summary", "glossary", "study_guide"}
    assert artifacts.as_json(artifacts.flashcards(records), "flashcards").first()["source_block_ids"] == ["b1", "b2"]


def test_domains(spark):
    versions = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("p", 3, "b")], "path string, saved_at int, content string")
    assert domains.snapshots(versions).count() == 2
    files = spark.createDataFrame([("a/b/c.md",), ("a/b/d.md",), ("e.md",)], "path string")
    assert {r["folder"]: r["files"] for r in domains.file_tree(files).collect()} == {"a/b": ["c.md", "d.md"], "": ["e.md"]}


def test_warehouse(spark, tmp_path):
    w = store.Warehouse(spark, f"file://{tmp_path}/w")
    assert not w.exists("t")
    early, late = (F.lit(t).cast("timestamp") for t in ("2026-01-01", "2026-01-02"))
    w.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), ["id"], early)
    w.upsert("t", spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"), ["id"], late)
    rows = {r["id"]: r for r in w.read("t").collect()}
    assert [rows[i]["v"] for i in (1, 2, 3)] == ["a", "c", "d"]
    assert rows[2]["created_at"] == dt.datetime(2026, 1, 1) and rows[2]["updated_at"] == dt.datetime(2026, 1, 2)
    assert w.delete("t", spark.createDataFrame([(1,), (9,)], "id int"), "id") == 1 and w.read("t").count() == 2


def test_names_from_addresses_and_paths(spark):
    def pair(value):
        r = one(spark, tx.relation_target(F.lit(value).cast("string")))
        return r["relation"], r["target"]

    assert pair("ex:partOf-> http://x/y") == ("partOf", "http://x/y") and pair("x/y#isA->b") == ("isA", "b") and pair("plain") == ("plain", "") and pair(None) == ("", "")
    urls = {"http://x.org/a/b c.owl?x=1": ("b-c", "b_c.owl"), "http://x.org/": ("ontology", "x.org"), "": ("ontology", "ontology_ttl"), "https://x.org/.hidden/": (".hidden", ".hidden"), None: ("ontology", "ontology_ttl")}
    for url, want in urls.items():
        c = F.lit(url).cast("string")
        assert (one(spark, tx.url_slug(c)), one(spark, tx.url_title(c, "ttl"))) == want
    shown = {"/data/a/b": "DATADIR/a/b", "/data": "DATADIR", "/home/u/x": "~/x", "/etc/x": "/etc/x", "/database": "/database", None: "-"}
    for path, want in shown.items():
        assert one(spark, tx.display_path(F.lit(path).cast("string"), "/data", "/home/u")) == want


def test_previews_and_diffs(spark):
    note = F.lit("summary_note")
    assert one(spark, tx.artifact_preview(note, F.lit('{"sections": [{"title": "T", "summary": "s"}]}'))) == "T: s"
    assert one(spark, tx.artifact_preview(note, F.lit('{"sections": [], "title": "X"}'))) == "X"
    assert one(spark, tx.artifact_preview(note, F.lit("no  json\n"))) == "no json" and one(spark, tx.artifact_preview(F.lit("quiz"), F.lit(None).cast("string"))) == ""
    diff = one(spark, tx.unified_diff(F.lit("a\nb\n"), F.lit("a\nc\n")))
    assert diff == "--- snapshot\n+++ current\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"
    assert one(spark, tx.answer_lines(F.lit(" a \n\n b"))) == ["a", "b"]


def test_checklists(spark):
    text = "# List\n- [ ] Deep Dive! :: Why?\n* [X] done one\n- [ ]  :: alone \n- [] none\n"
    rows = prompts.backlog(spark.createDataFrame([("p", text), ("q", None)], "path string, text string")).orderBy("line_index").collect()
    assert [(r["line_index"], r["checked"], r["template"], r["question"]) for r in rows] == [(1, False, "deep-dive", "Why?"), (2, True, "default", "done one"), (3, False, "default", "alone")]
    found = prompts.templates(spark.createDataFrame([("p", "x\n## Deep dive\n\nA {{question}}\n### sub\n## Empty")], "path string, text string"))
    assert {(r["template"], r["content"]) for r in found.collect()} == {("deep-dive", "A {{question}}\n### sub"), ("empty", "")}


def test_listings(spark):
    assert [listings.clamped(x, 20, 1, 100) for x in ("7", 500, -3, None, "x")] == [7, 100, 1, 20, 20]
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    named = spark.createDataFrame([(" Service-Mesh ", None), ("service mesh", "noise"), (" ", "noise")], "display_term string, kind string")
    rows = listings.exclusion_rows(named, now)
    assert [(r["normalized_term"], r["display_term"], r["kind"]) for r in rows.collect()] == [("service mesh", "service mesh", "noise")]
    found = spark.createDataFrame([("Service Mesh",), ("auth",)], "term string")
    assert [r["term"] for r in listings.without_excluded(found, rows).collect()] == ["auth"]
    e = spark.createDataFrame([("a", "m1", [1.0]), ("b", "m1", [2.0]), ("a", "m2", [3.0])], "key string, embedding_model string, vector array<double>")
    assert {(r["embedding_model"], r["vectors"]) for r in listings.embedding_counts(e).collect()} == {("m1", 2), ("m2", 1)}
    assert [r["vector"] for r in listings.embedding_of(e, "a", "m2").collect()] == [[3.0]]
    s = spark.createDataFrame([("s1", "md", 1), ("s2", "pdf", 3), ("s3", "md", 2)], "source_id string, source_type string, updated_at int")
    assert [r["source_id"] for r in listings.sources(s).collect()] == ["s2", "s3", "s1"] and [r["source_id"] for r in listings.sources(s, "md").collect()] == ["s3", "s1"]


def test_pdf_jobs(spark):
    now, later = (F.lit(f"2026-01-01 0{h}:00:00").cast("timestamp") for h in (1, 2))
    none = spark.createDataFrame([], pdf_jobs.SCHEMA)
    files = spark.createDataFrame([("/a.pdf", " ", 3), ("/b.pdf", "d", None), ("/b.pdf", "d", 4)], "pdf_path string, domain string, pages_total int")
    made = pdf_jobs.create(files, none, now)
    ids = {r["pdf_path"]: r["job_id"] for r in made.collect()}
    assert {(r["domain"], r["pages_total"], r["status"]) for r in made.collect()} == {("default", 3, "pending"), ("d", 4, "pending")}
    a, b = (spark.createDataFrame([(ids[p],)], "job_id string") for p in ("/a.pdf", "/b.pdf"))
    jobs_ = pdf_jobs.complete(pdf_jobs.progress(pdf_jobs.start(made, a, now), a.withColumn("pages_processed", F.lit(2))), a, later)
    row = jobs_.where(F.col("job_id") == ids["/a.pdf"]).first()
    assert (row["status"], row["pages_processed"], row["completed_at"].hour) == ("done", 2, 2)
    jobs_ = pdf_jobs.fail(pdf_jobs.start(jobs_, b, now), b.withColumn("error_message", F.lit("broken")), later)
    assert {(r["job_id"], r["error_message"]) for r in pdf_jobs.listed(jobs_, "d", "failed").collect()} == {(ids["/b.pdf"], "broken")}
    again = pdf_jobs.create(files, jobs_, later)
    assert again.count() == 2 and {r["status"] for r in again.collect()} == {"pending"} and {r["error_message"] for r in again.collect()} == {None}
    assert {r["pages_processed"] for r in pdf_jobs.create(files, pdf_jobs.start(jobs_, a, now), later).where(F.col("status") == "processing").collect()} == {2}
    kept = pdf_jobs.results(again, a.select("job_id", F.lit("s").alias("source_id"), F.lit(None).cast("string").alias("artifact_id"), F.lit(None).cast("string").alias("content_preview"), F.lit("{}").alias("result_json")))
    assert {(r["source_id"], r["result_json"]) for r in kept.collect()} == {("s", "{}"), (None, None)}


def test_broken_ontologies_end_no_task(spark):
    texts = ['[1, {"@id": "a", "label": "A"}]', '{"@graph": [null, {"@id": "b", "label": "B"}]}', '{"@id": "c", "label": "C", "@graph": {"@id": "x"}}', "3", '"x"', "[[]]", "{", "<a", None, ""]
    docs = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")
    assert {(r["path"], r["concept_id"]) for r in ontology.parse(docs).collect()} == {("0", "a"), ("1", "b"), ("2", "c")}
    looped = spark.createDataFrame([("p", '[{"@id": "a", "label": "A", "next": {"@id": "a"}, "far": {"@id": "zz"}}]')], "path string, text string")
    nodes, edges = ontology.concept_graph(ontology.parse(looped))
    assert nodes.count() == 1 and [(r["src_id"], r["dst_id"], r["relation"]) for r in edges.collect()] == [("a", "a", "next")]


def test_graph_context(spark):
    rows = issue_table(spark, [("AE-50", "portal login", "broken", ["auth", "portal"], "2026-01-01T10:00", None), ("AE-51", "faq", "text", ["portal", "faq"], "2026-01-02T10:00", None), ("AE-52", "other", "text", ["misc"], "2026-01-02T10:00", None)])
    hits = search.lexical_search(rows, "login", 1).withColumn("rank", F.lit(1))
    more = search.graph_context(rows, hits)
    assert [r["key"] for r in more.collect()] == ["AE-51"]
    text = search.context_prompt("Why?", hits, more).first()["prompt"]
    assert "AE-51 [graph]" in text and "AE-50:" in text
    assert search.graph_context(rows, hits.limit(0)).collect() == []


def test_support_answer(spark):
    hits = spark.createDataFrame([("s1", "T", "text", 2.0), ("s2", "U", "more", 3.0)], "source_id string, title string, snippet string, score double")
    row = search.support_answer("Why?", hits, lambda p: "because").first()
    assert row["answer"] == "because" and row["sources"] == ["s2", "s1"] and "[s2] U: more\n[s1] T: text" in row["prompt"]
    assert search.support_answer("Why?", hits.limit(0), lambda p: 1 / 0).first()["answer"] == search.NOTHING_FOUND


def test_issue_blocks(spark):
    rows = spark.createDataFrame([("A-1", "s", "d", {"Comment": "c", "Empty": ""}), ("A-2", "t", None, None)], "key string, summary string, description string, text_fields map<string,string>")
    found = {r["block_id"]: (r["parent_id"], r["path"], r["content"]) for r in blocks.of_issues(rows).collect()}
    assert found == {
        "A-1:summary": (None, "A-1", "s"), "A-1:description": ("A-1:summary", "A-1 / description", "d"), "A-1:field:Comment": ("A-1:summary", "A-1 / Comment", "c"), "A-2:summary": (None, "A-2", "t"),
    }


def test_turtle_concepts_have_whole_ids(spark):
    text = '@prefix ex: <http://e/> .\nex:A a ex:Class .\nex:B a ex:Other .\nlocal:C ex:label "C" .\n<urn:d> ex:label "D" .'
    rows = ontology.parse(spark.createDataFrame([("p", text)], "path string, text string")).collect()
    assert {r["concept_id"] for r in rows} == {"http://e/A", "urn:d"}


def test_terms_are_dealt_by_text_and_tokens_taken_once(spark):
    rows = spark.createDataFrame([(1, "red blue red"), (1, "red"), (2, ""), (3, None), (4, "blue")], "key int, text string")
    found = vectors.terms_of(rows, tx.word_tokens(F.col("text")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [(1, "blue", 1, 1), (1, "red", 3, 0), (4, "blue", 1, 0)]
    assert plan.count("Exchange hashpartitioning(key") == 1 and plan.count("regexp_extract_all") == 1
    ranked = mining.top_terms(rows)._jdf.queryExecution().executedPlan().toString()
    assert ranked.count("Exchange hashpartitioning") == 1


def test_concepts_leave_a_task_in_small_frames(spark):
    class Docs:
        def select(self, *columns):
            return self

        def mapInPandas(self, run, schema):
            return run

    text = "".join(f'<http://e/{k}> a <http://e/Class> ; <http://e/label> "c{k}" .\n' for k in range(30))
    frame = pd.DataFrame({"path": [f"p{i}" for i in range(200)], "text": [text, "<http://e/x> broken"] * 100})
    made = list(ontology.parse(Docs())(iter([frame, frame.head(0)])))
    assert max(map(len, made)) <= ontology.CONCEPT_ROWS < sum(map(len, made)) == 3_000
    rows = pd.concat(made)
    assert [(r.path, r.pos, r.label) for r in rows.itertuples()] == [(f"p{i}", k, f"c{k}") for i in range(0, 200, 2) for k in range(30)]
