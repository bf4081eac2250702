"""Pairs by label, links by an automaton, folding, promotion over an earlier store: against brute-force versions."""

import random
import re
import unicodedata
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from loregraph.engine import Engine
from loregraph.functions import text as tx
from loregraph.operators import graph, jobs, listings, terms


def test_related_labels_of_a_label_that_all_share(spark):
    rng = random.Random(1)
    issues = [(f"K-{i}", ["All ", "all", *rng.sample(["x", "y", "z", " ", ""], 2)]) for i in range(90)] + [("K-0", ["all", "Z"]), ("none", None), ("void", [])]
    rows = spark.createDataFrame(issues, "key string, labels array<string>")
    own: dict[str, set] = {}
    for key, labels in issues:
        own.setdefault(key, set()).update(x.lower().strip() for x in labels or [] if x.strip())
    expected = Counter()
    for a, b in combinations(sorted(own), 2):
        if n := len(own[a] & own[b]):
            expected[(f"issue:{a}", f"issue:{b}")] = expected[(f"issue:{b}", f"issue:{a}")] = n
    for block in (7, 1024):
        out = graph.related_label_edges(rows, block=block).collect()
        assert {(r["src_id"], r["dst_id"]): r["weight"] for r in out} == expected and len(out) == len(expected)
    cells = graph.label_cells(graph.label_rows(rows), 7).groupBy("label", "l", "r", "side").count()
    # a block holds 7 issues on average; without blocks one cell would hold all 90
    assert cells.agg(F.max("count")).first()[0] <= 25
    few = graph.related_label_edges(rows, max_label_degree=80)
    assert {(r["src_id"], r["dst_id"]) for r in few.collect()} < set(expected)
    assert graph.related_label_edges(rows.limit(0)).count() == 0


def test_related_labels_shuffle_no_pairs(spark):
    issues = [(f"K-{i}", [f"l{j}" for j in range(80) if (i >> j % 5) & 1 and (i + j) % 3]) for i in range(40)]
    rows = spark.createDataFrame(issues, "key string, labels array<string>")
    own = dict(issues)
    expected = {(f"issue:{a}", f"issue:{b}"): len(set(own[a]) & set(own[b])) for a in own for b in own if a != b and set(own[a]) & set(own[b])}
    for block in (3, 1024):
        out = graph.related_label_edges(rows, block=block)
        # what comes after the join of a label's issues stays in its tasks
        after = out._jdf.queryExecution().executedPlan().toString().split("Join")[0]
        assert "Exchange" not in after and "Aggregate" not in after
        got = out.collect()
        assert {(r["src_id"], r["dst_id"]): r["weight"] for r in got} == expected and len(got) == len(expected)


LABELS = ["oauth", "api gateway", "gateway", "the api", "c++", "is the", ".net", "a+b", "über uns", "abc", "api", "retry policy of a", "gateway api gateway"]
CONTENTS = [
    "OAuth retries via API-Gateway, the API gateway api gateway is. the end", "oauths xoauth is thederer and this the", "Use C++ and .NET here: a+b, über_uns Über Uns", None, "", "short",
    " ".join(f"w{i} retry policy of a thing" for i in range(300)), "c++x xc++ .netx x.net a+bc the apis gateway", "is the is the is the is the",
]


def brute_links(contents, labels, canonical, most):
    out = set()
    for i, text in enumerate(contents):
        if text is None or len(text.strip()) < 20:
            continue
        hits = []
        for seen, label in enumerate(labels):
            start = r"(?<!\w)" if re.match(r"\w", label) else ""
            end = r"(?!\w)" if re.search(r"\w$", label) else ""
            if len(label) >= 4 and re.search(start + re.escape(label) + end, canonical[i]):
                hits.append((seen, label))
        out |= {(i, f"matched '{label}'") for _, label in sorted(hits)[:most]}
    return out


@pytest.mark.parametrize("in_memory", [100, 0])
@pytest.mark.parametrize("most", [14, 2])
def test_record_links_against_every_label_in_every_text(spark, in_memory, most):
    records = spark.createDataFrame([*enumerate(CONTENTS), (0, CONTENTS[0])], "record_id int, content string")
    canonical = {r["record_id"]: r["t"] for r in records.select("record_id", tx.canonical_term(F.col("content")).alias("t")).collect()}
    known = spark.createDataFrame([(f"t{k}", label, k) for k, label in enumerate(LABELS)], "term_id string, normalized_label string, seen int")
    out = terms.record_links(records, known, per_record=most, in_memory=in_memory)
    assert {(r["record_id"], r["evidence"]) for r in out.collect()} == brute_links(CONTENTS, LABELS, canonical, most)
    assert out.count() == len(out.distinct().collect()) and out.columns == ["record_id", "term_id", "confidence", "evidence"]
    assert terms.record_links(records, known.limit(0), in_memory=in_memory).count() == 0


def test_labels_by_their_words_are_those_of_the_automaton():
    import pyarrow as pa

    rng = random.Random(6)
    bits = ["a", "b", "ab", "c++", ".", "+", "/", "ä", "#", " ", " ", " ", "x1", "_"]
    for _ in range(60):
        labels = sorted({"".join(rng.choices(bits, k=rng.randint(1, 6))) for _ in range(30)})
        texts = [re.sub(" +", " ", "".join(rng.choices(bits, k=rng.randint(0, 25)))).strip() for _ in range(20)] + [None, ""]
        automaton = terms.LabelAutomaton([(label, k) for k, label in enumerate(labels)])
        text, rank = terms.LabelWords(pa.array(labels)).ranks(pa.array(["b a", *texts]).slice(1))
        assert list(zip(text.tolist(), rank.tolist(), strict=True)) == [(i, k) for i, t in enumerate(texts) if t for k in automaton.ranks(t)]


def test_many_labels_are_looked_up_without_a_shuffle_of_word_pairs(spark):
    records = spark.createDataFrame([(k, f"the gate is number {1000 * k} Gate, w{k} gate and w{k}. gate") for k in range(9)], "record_id int, content string")
    known = spark.range(200_100).select(F.concat(F.lit("t"), "id").alias("term_id"), F.concat(F.lit("w"), "id", F.lit(" gate")).alias("normalized_label"), F.col("id").alias("seen"))
    out = terms.record_links(records, known, max_words=2)
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["record_id"], r["term_id"]) for r in out.collect()) == [(k, f"t{k}") for k in range(9)]


def test_terms_of_one_label_all_link(spark):
    records = spark.createDataFrame([("r", "the api gateway is slow today")], "record_id string, content string")
    known = spark.createDataFrame([(f"t{k}", "api gateway", k) for k in range(20)], "term_id string, normalized_label string, seen int")
    assert {r["term_id"] for r in terms.record_links(records, known).collect()} == {f"t{k}" for k in range(14)}


def test_fold_whole_texts(spark):
    rng = random.Random(2)
    alphabet = list("abc XYZ 12 .,-\n\t") + list("éüßñçøł€ﬁ½Ⅷ㏂ｆ한🙂𝐁①ĳŉǅİ́ 中")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(400)] + [None, "", "plain ascii", "ﬃ" * 500]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.fold(F.col("t")).alias("f"))
    assert {r["i"]: r["f"] for r in rows.collect()} == {i: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for i, t in enumerate(texts)}


def test_stored_prompts_stay(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("a", "old a"), ("b", "old b"), ("c", None)], "job_id string, prompt_text string").withColumn("updated_at", F.lit("2026-01-01 00:00:00").cast("timestamp"))
    sent = spark.createDataFrame([("b", "new b"), ("z", "nobody")], "job_id string, prompt string")
    out = {r["job_id"]: (r["prompt_text"], r["prompt_hash"] is None, r["updated_at"].day) for r in jobs.with_prompts(rows, sent, now).collect()}
    assert out == {"a": ("old a", False, 1), "b": ("new b", False, 2), "c": (None, True, 1)}
    first = jobs.with_prompts(rows.drop("prompt_text"), sent, now)
    assert {r["job_id"]: r["prompt_text"] for r in first.collect()} == {"a": None, "b": "new b", "c": None}


def test_exclusions_are_composed_and_the_last_row_stays(spark):
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    named = spark.createDataFrame([("Ｍｅｓｈ ﬁle", "noise", 2), ("mesh file", "exception", 1), ("café", None, 3), (" ", "noise", 4)], "display_term string, kind string, n int")
    out = {r["normalized_term"]: (r["display_term"], r["kind"]) for r in listings.exclusion_rows(named, now, "n").collect()}
    assert out == {"mesh file": ("Ｍｅｓｈ ﬁle", "noise"), "café": ("café", "exception")}
    found = spark.createDataFrame([("MESH_FILE",), ("Café",), ("other",)], "term string")
    assert [r["term"] for r in listings.without_excluded(found, listings.exclusion_rows(named, now, "n")).collect()] == ["other"]


def test_promotion_leaves_forgotten_terms(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store")
    (tmp_path / "i.csv").write_text("Issue key,Summary,Labels,Updated\nA-1,Gateway down,\"gateway,auth\",2026-02-16 11:12:00\nA-2,Login slow,auth,2026-02-17 11:12:00\n")
    engine.ingest(str(tmp_path / "i.csv"))
    first = {r["normalized_label"]: r["term_id"] for r in engine.promote_terms().collect()}
    created = {r["term_id"]: r["created_at"] for r in engine.tables.read("terms").collect()}
    engine.forget_term(first["auth"])
    assert {r["normalized_label"] for r in engine.tables.read("candidates").where("promoted_term_id IS NOT NULL").collect()} == set(first) - {"auth"}
    engine.promote_terms()
    after = {r["normalized_label"]: r for r in engine.tables.read("terms").collect()}
    assert after["auth"]["status"] == "deprecated" and after["gateway"]["status"] == "new" and {r["term_id"] for r in after.values()} == set(created)
    assert {r["normalized_label"]: r["promoted_term_id"] for r in engine.tables.read("candidates").collect()} == first
    assert engine.tables.read("terms").count() == len(first)


def test_canonical_terms_and_their_starts(spark):
    def canonical(t):
        c = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9äöüß+.#/ ]+", " ", t.lower().replace("_", " ").replace("-", " "))).strip(" ").replace("oauth2", "oauth")
        return re.sub(r" (service|system)s$", r" \1", c)

    rng = random.Random(3)
    bits = ["oauth2", "OAuth2", " ", "\n", "\t", "service", "services", " systems", "_", "-", "K", "ẞ", "Ä", "B9", "+", ".", "é", "🙂", "\xa0"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(500)] + ["", "--", "Auth services", "auth services now", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = rows.select("i", tx.canonical_term(F.col("t")).alias("c"), tx.canonical_start(F.col("t"), 2).alias("s")).collect()
    expected = {i: None if t is None else canonical(t) for i, t in enumerate(texts)}
    assert {r["i"]: r["c"] for r in out} == expected
    assert {r["i"]: r["s"] for r in out} == {i: c and " ".join(c.split(" ")[:2]) for i, c in expected.items()}


@pytest.mark.parametrize("in_memory", [100, 2])
def test_candidate_labels_count_each_pair_once_without_a_shuffle_of_pairs(spark, in_memory):
    rng = random.Random(4)
    names = ["gate", "Token", "über", "cache", "abc", "relay", "naïve", "ßßßß"]
    records = [(k % 40, " ".join(rng.choices(names, k=rng.randint(0, 5)))) for k in range(60)] + [(90, None), (91, "abc of")]
    labels = [" ".join(rng.sample(["gate", "token", "über", "cache", "abc", "relay", "ßßßß"], rng.randint(1, 3))) for _ in range(25)]
    labels = sorted({*labels}) + labels[:3]
    rows = spark.createDataFrame(records, "record_id int, content string")
    known = spark.createDataFrame([(f"t{i}", label) for i, label in enumerate(labels)], "term_id string, normalized_label string")
    own: dict[int, set] = {}
    for i, text in records:
        own.setdefault(i, set()).update(w for w in (text or "").lower().split() if len(w) >= 4)
    every = {(i, label): n for i, ws in own.items() for label in labels if (n := len(ws & {w for w in label.split() if len(w) >= 4}))}
    found = terms.candidate_labels(rows, known, None, in_memory=in_memory)
    out = found.collect()
    assert {(r["record_id"], r["normalized_label"]): r["overlap"] for r in out} == every and len(out) == len(every)
    if in_memory == 100:
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Aggregate") > plan.index("MapInArrow")
    best = {(i, label): n for i in own for n, label in sorted(((n, label) for (j, label), n in every.items() if j == i), key=lambda x: (x[0], x[1].encode()))[-3:]}
    best |= {(i, label): 0 for i in own if not any(j == i for j, _ in every) for label in sorted({*labels})[:3]}
    out = terms.candidate_labels(rows, known, 3, fallback=True, in_memory=in_memory).collect()
    assert {(r["record_id"], r["normalized_label"]): r["overlap"] for r in out} == best and len(out) == len(best)


@pytest.mark.parametrize(("in_memory", "in_file"), [(1000, 1 << 19), (1000, 40), (7, 40)])
def test_candidate_labels_are_dealt_to_files_and_blocks_whole(spark, monkeypatch, in_memory, in_file):
    monkeypatch.setattr(terms, "PAIR_RECORDS", 3)
    monkeypatch.setattr(terms, "PAIR_CELLS", 7)
    rng = random.Random(5)
    names = ["gate", "token", "über", "cache", "abc", "relay", "ßßßß", "that", "with"]
    records = [(f"r{k % 50}", " ".join(rng.choices(names, k=rng.randint(0, 6)))) for k in range(70)] + [("none", None), ("empty", ""), ("short", "abc of")]
    labels = sorted({" ".join(rng.sample(names, rng.randint(1, 4))) for _ in range(40)} | {"that"})
    rows = spark.createDataFrame(records, "record_id string, content string").repartition(3)
    known = spark.createDataFrame([(f"t{i}", label) for i, label in enumerate(labels)], "term_id string, normalized_label string")
    own: dict[str, set] = {}
    for i, text in records:
        own.setdefault(i, set()).update(w for w in (text or "").split() if len(w) >= 4)
    every = {(i, label): n for i, ws in own.items() for label in labels if (n := len(ws & {w for w in label.split() if len(w) >= 4}))}
    out = terms.candidate_labels(rows, known, None, in_memory=in_memory, in_file=in_file).collect()
    assert {(r["record_id"], r["normalized_label"]): r["overlap"] for r in out} == every and len(out) == len(every)
    assert terms.candidate_labels(rows, known.limit(0), None, in_memory=in_memory, in_file=in_file).count() == 0


def test_files_of_candidate_labels_hold_each_label_once(spark, tmp_path):
    import pyarrow.parquet as pq

    # more than a megabyte of labels, which a single file would write out row by row
    labels = [f"{'x' * 60} gate w{k:05d}" for k in range(16_000)]
    known = spark.createDataFrame([(f"t{i}", label) for i, label in enumerate(labels)], "term_id string, normalized_label string")
    records = spark.createDataFrame([(k, "the gate") for k in range(20)], "record_id long, content string")
    terms.candidate_labels(records, known, None).write.parquet(f"{tmp_path}/out")
    files = [m for f in tmp_path.glob("out/*.parquet") if (m := pq.ParquetFile(f).metadata).num_rows]
    assert sum(m.num_rows for m in files) == 20 * len(labels)
    assert not any("PLAIN" in m.row_group(k).column(1).encodings for m in files for k in range(m.num_row_groups))


def test_concept_graph_of_a_brand_crosses_its_documents(spark, tmp_path):
    from loregraph.plans import registry

    rows = [(k, f"name {k}", f"Brand#{k % 2}", "LARGE", 1, 1.0) for k in (370, 380, 395, 405, 420, 430, 445)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    out = {tuple(r) for r in registry.queries()["concept_graph"](spark, str(tmp_path)).collect()}
    # brands are even and odd keys here, so an edge to the key plus 25 has none; equal brands need another key
    assert out == set()
    same = [(k, f"name {k}", "Brand#1", "LARGE", 1, 1.0) for k in (370, 380, 395, 405, 420, 430, 445)]
    spark.createDataFrame(same, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.mode("overwrite").parquet(f"{tmp_path}/part.parquet")
    out = {tuple(r) for r in registry.queries()["concept_graph"](spark, str(tmp_path)).collect()}
    assert out == {("Brand#1", f"part/{a}", f"part/{a + 25}") for a in (370, 380, 395, 405, 420)}


def test_cypher_export_has_every_node_and_edge(spark, tmp_path):
    from datetime import date

    from loregraph.plans import registry

    n, tables = 700, {}
    tables["part"] = spark.createDataFrame([(1, "bolt", "Brand#1")], "p_partkey long, p_name string, p_brand string")
    tables["customer"] = spark.createDataFrame([(1, "Ann")], "c_custkey long, c_name string")
    tables["orders"] = spark.createDataFrame([(k, 1, "O", "1-URGENT", date(2024, 1, 1 + k % 28)) for k in range(n)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date")
    tables["lineitem"] = spark.createDataFrame([(k, 1) for k in range(n)], "l_orderkey long, l_partkey long")
    for name, rows in tables.items():
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    out = [(r["part"], r["line"]) for r in registry.queries()["cypher_export"](spark, str(tmp_path)).collect()]
    # an issue has an edge to its assignee, status, type, day and label; those are nodes too
    assert Counter(part for part, _ in out) == {1: n + 4 + 28, 2: 5 * n} and len(set(out)) == len(out)
    assert {line for part, line in out if part == 1 and ":Issue" in line} == {f"MERGE (n_issue_O_{k}:Issue {{id: 'issue:O-{k}'}}) SET n_issue_O_{k}.name = 'bolt';" for k in range(n)}
    assert "LIMIT" not in registry.oracle_sql()["cypher_export"]


def test_neighbours_of_few_seeds_are_not_dealt_by_seed(spark):
    seeds = spark.createDataFrame([(f"issue:K-{k}", k) for k in (1, 2)], "node_id string, rank long")
    issues = spark.createDataFrame([(f"K-{k}", ["all", f"l{k % 3}"]) for k in range(30)], "key string, labels array<string>")
    related = graph.related_to(issues, seeds.select(F.substring("node_id", 7, 100).alias("key")))
    found = graph.expand(related, seeds, ["related_label"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = graph.expand(related, seeds, ["related_label"])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        out = {r["node_id"]: (r["rank"], r["r"]) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    near = {s: sorted((k for k in range(30) if k != s), key=lambda k: (-(1 + (k % 3 == s % 3)), f"issue:K-{k}"))[:5] for s in (1, 2)}
    best = {}
    for s in (1, 2):
        for r, k in enumerate(near[s], 1):
            if k not in (1, 2):
                best.setdefault(f"issue:K-{k}", (s, r))
    assert out == best
