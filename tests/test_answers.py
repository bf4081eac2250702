"""The assistant's choice of search, support passages, job detail, ticked checklists, fitted embedders."""

from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.operators import domains, listings, prompts, search, vectors


def issues(spark):
    rows = [
        ("NET-101", "Gateway down", "the gateway fails", ["net", "ops"], "2026-01-03"), ("NET-102", "Login slow", "tokens expire early", ["auth"], "2026-01-02"),
        ("NET-103", "Router", "packets vanish", ["net"], "2026-01-01"), ("NET-104", "Disk", "full disk", ["ops"], None),
    ]
    df = spark.createDataFrame(rows, "key string, summary string, description string, labels array<string>, updated_at string")
    return df.withColumn("full_text", tx.full_text(F.col("summary"), F.col("description"), F.col("labels")))


def test_ask_takes_hybrid_hits_where_there_are_vectors(spark):
    rows = issues(spark)
    plain = search.ask(rows, "gateway?", lambda p: f"{len(p.splitlines())} lines", limit=2).first()
    assert plain["sources"] == ["NET-101"] and plain["graph_expanded"] == ["NET-103", "NET-104"] and plain["answer"].endswith("lines")
    assert plain["prompt"].startswith("Question: gateway?") and "- NET-101: Gateway down" in plain["prompt"] and "- NET-103 [graph]: Router" in plain["prompt"]
    weights, vocab = vectors.tfidf(rows, "key", "full_text")
    asked = "tokens packets"
    hybrid = search.ask(rows, asked, None, 2, weights, vectors.query_weights(spark, asked, vocab), with_graph=False).first()
    # both match by one word; the text of fewer other words is nearer
    assert sorted(hybrid["sources"]) == ["NET-102", "NET-103"] and hybrid["graph_expanded"] == [] and hybrid["answer"] is None
    fused = search.hybrid_search(rows, weights, asked, vectors.query_weights(spark, asked, vocab), 2)
    order = [r["key"] for r in fused.orderBy(F.desc("combined_score"), "key").collect()]
    assert hybrid["sources"] == order
    none = search.ask(rows, "zzzz", None).first()
    assert none["sources"] == [] and none["prompt"].startswith("Question: zzzz")


def test_support_passages(spark):
    long = "a gateway is a door between two nets, and there may be many of them"
    texts = spark.createDataFrame([("/m/Gate.v2.md", "d", f"{long}\n\nshort\n\nsecond gateway paragraph that is long enough to count"), ("/m/.md", "e", long), ("/m/x.md", "d", None)], "path string, domain string, text string")
    md = search.text_passages(texts, "md")
    assert {(r["title"], r["source_id"], r["domain"]) for r in md.collect()} == {("Gate.v2", "md:/m/Gate.v2.md", "d"), (".md", "md:/m/.md", "e")} and md.count() == 3
    lines = [("/c/i.csv", "d", n, [("Key", f"K-{n}"), ("Note", " "), ("None", None), ("Text", "gateway " * n)]) for n in range(1, 31)] + [("/c/void.csv", "d", 1, [("Key", "")])]
    csv = search.csv_passages(spark.createDataFrame(lines, "path string, domain string, line int, cells array<struct<name:string,value:string>>"))
    found = csv.collect()
    assert len(found) == search.CSV_ROWS and all(len(r["snippet"]) <= search.CSV_CHARS for r in found) and found[0]["snippet"].startswith("Key: K-1 Text: gateway")
    every = md.unionByName(csv)
    assert {r["domain"] for r in search.support_search(every, "gateway", None, domain="d").collect()} == {"d"}
    assert {r["source_type"] for r in search.support_search(every, "gateway", None, types=["CSV"]).collect()} == {"jira"}
    assert {r["source_type"] for r in search.support_search(every, "gateway", None, types=["no such"]).collect()} == {"jira", "md"}
    best = search.support_search(every, "gateway door", 3).collect()
    assert [r["score"] for r in best] == sorted((r["score"] for r in best), reverse=True) and best[0]["score"] == 2.4
    assert search.support_search(every, "  ").count() == 0


def test_job_detail(spark):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    jobs = spark.createDataFrame([("j1", "t1", "a  b\n" * 200, "boom"), ("j2", "r1", None, None)], "job_id string, key string, prompt_text string, error_message string")
    terms = spark.createDataFrame([("t1", "Gateway")], "term_id string, canonical_label string")
    facts = spark.createDataFrame([(f"f{k:02}", "t1", "f01" if k == 2 else None) for k in range(12)], "fact_id string, term_id string, supersedes_fact_id string").withColumn("created_at", at)
    links = spark.createDataFrame([(f"l{k}", "r1", k / 10) for k in range(3)], "link_id string, record_id string, confidence double").withColumn("updated_at", at)
    job, found, own = listings.job_detail("j1", jobs, terms, facts, links)
    row = job.first()
    assert row["term_label"] == "Gateway" and len(row["prompt_preview"]) <= 200 and row["prompt_preview"].endswith("…") and row["error_preview"] == "boom"
    assert [r["fact_id"] for r in found.collect()] == ["f00", *(f"f{k:02}" for k in range(2, 9))] and own.count() == 0
    job, found, own = listings.job_detail("j2", jobs, terms, facts, links)
    assert job.first()["term_label"] is None and job.first()["prompt_preview"] == "" and found.count() == 0 and [r["link_id"] for r in own.collect()] == ["l2", "l1", "l0"]
    assert listings.looked_up(jobs, "job_id", "none").count() == 0


def test_batch_of_prompts_ticks_what_was_answered(spark):
    text = "\n# Plan\n- [ ] Deep :: Why [ ] now?\n* [x] old\n- [ ] How?\nplain [ ] text\n\n"
    docs = spark.createDataFrame([("p", text), ("q", "- [x] all done"), ("n", None)], "path string, text string")
    templates = spark.createDataFrame([("p", "deep", "Dig {{question}} in {{domain}}")], "path string, template string, content string")
    answers, after = prompts.run_batch(docs, templates, "shop", lambda p: p.upper())
    assert {(r["line_index"], r["prompt"], r["answer"]) for r in answers.collect()} == {(2, "Dig Why [ ] now? in shop", "DIG WHY [ ] NOW? IN SHOP"), (4, "How?", "HOW?")}
    found = {r["path"]: r["text"] for r in after.collect()}
    assert found["p"] == "# Plan\n- [x] Deep :: Why [ ] now?\n* [x] old\n- [x] How?\nplain [ ] text\n"
    assert found["q"] == "- [x] all done\n" and found["n"] == "\n"
    assert prompts.filled(prompts.backlog(after), templates, "shop").count() == 0


def test_fitted_embedder(spark):
    texts = spark.createDataFrame([("a", "gateway gateway door and more"), ("b", "door of a house and a yard"), ("c", "short")], "key string, text string")
    fitted = vectors.VocabularyEmbedder(most=3).fit(texts)
    assert list(fitted.words) == ["a", "and", "door"] and fitted.embed("Door, door! x a") == [0.25, 0.0, 0.5] and fitted.embed(None) == [0.0] * 3
    made = {r["key"]: r["vector"] for r in vectors.embed(texts, fitted).collect()}
    assert made["a"] == [0.0, 0.2, 0.2] and set(made) == {"a", "b"}


def test_fields_have_their_top_terms(spark):
    rows = spark.createDataFrame([("A-1", "gateway fails and gateway restarts, router waits for the gateway door", {"Comment": "nothing here " * 4})], "key string, description string, text_fields map<string,string>")
    found = {r["field_name"]: (r["top_terms"], r["field_kind"]) for r in vectors.with_top_terms(vectors.field_rows(rows)).collect()}
    assert found == {"description": (["gateway", "fails", "restarts", "router", "waits", "door"], "description"), "Comment": (["nothing", "here"], "comment")}


def test_browse(spark):
    sources = spark.createDataFrame([("s1", "md", 1), ("s2", "pdf", 3), ("s3", "md", 2)], "source_id string, source_type string, updated_at int")
    rows = [(s, f"{s}:{k}", "paragraph", f"{s}:{k - 1}" if k else None, f"gateway {k}" if k % 2 else "door", k) for s in ("s1", "s2", "s3") for k in range(30)]
    blocks = spark.createDataFrame(rows, "source_id string, block_id string, block_type string, parent_id string, content string, order_index int")
    made = spark.createDataFrame([("a1", "s2", 1), ("a2", "s3", 2)], "artifact_id string, source_id string, updated_at int")
    none = spark.createDataFrame([], "src_id string, dst_id string, relation string, weight double")
    seen = listings.browse(sources, blocks, made, none, query="GATEWAY", limit=2)
    assert [r["source_id"] for r in seen["sources"].collect()] == ["s2", "s3", "s1"] and seen["selected"].first()["source_id"] == "s2"
    assert [r["block_id"] for r in seen["search_results"].collect()] == ["s1:1", "s2:1"] and [r["block_id"] for r in seen["records"].collect()] == ["s2:0", "s2:1"]
    assert [r["artifact_id"] for r in seen["artifacts"].collect()] == ["a1"] and seen["nodes"].count() == 20 and seen["edges"].count() == 19
    typed = listings.browse(sources, blocks, made, none, "md")
    assert typed["selected"].first()["source_id"] == "s3" and typed["search_results"].count() == 0 and typed["records"].count() == 20 and typed["nodes"].count() == 30
    assert listings.browse(sources, blocks, made, none, "(all)", " s1 ")["selected"].first()["source_id"] == "s1"
    empty = listings.browse(sources, blocks, made, none, "no such")
    assert all(empty[k].count() == 0 for k in empty)


def test_created_domains(spark):
    rows = domains.created(spark.createDataFrame([("My Shop",), ("!!",), (" Default ",), ("",), (None,)], "name string"), "/data/").collect()
    assert [(r["domain"], r["valid"], r["prompts_dir"]) for r in rows] == [("my-shop", True, "/data/my-shop/prompts"), ("default", False, None), ("default", True, "/data/default/prompts"), ("default", False, None), ("default", False, None)]
