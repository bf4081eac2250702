"""Queries over the views, each with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import dates, values
from loregraph.functions import text as tx
from loregraph.operators import artifacts, blocks, claims, domains, graph, jobs, listings, mining, ontology, pdf_jobs, prompts, quiz, search, store, terms, text_index, vector_index, vectors
from loregraph.plans import views
from loregraph.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-01-31 00:00:00"
STOP = "(" + ", ".join(f"'{w}'" for w in tx.STOPWORDS) + ")"
NOISE = "(" + ", ".join(f"'{w}'" for w in [*tx.STOPWORDS, *tx.NOISE_TERMS]) + ")"
SEARCH_QUERY = "estion outre Ingor"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp")


def tokens_sql(column: str) -> str:
    return f"list_filter(regexp_extract_all(lower({column}), '{tx.SEARCH_TOKEN}'), lambda t: t NOT IN {STOP})"


# -- search --------------------------------------------------------------------------------------------------------

_T = ["estion", "outre", "ingor"]
_SCORE = " + ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN {w} ELSE 0 END" for t in _T for c, w in search.WEIGHTS.items())
_HIT = " OR ".join(f"contains(lower(full_text), '{t}')" for t in _T)


@query(f"WITH {views.DOCS} SELECT key, CAST({_SCORE} AS BIGINT) AS score FROM v_docs WHERE {_HIT} ORDER BY score DESC, key LIMIT 20")
def lexical_search(spark, sf):
    return search.lexical_search(views.docs(spark, sf), SEARCH_QUERY, 20).select("key", "score")


@query(f"WITH {views.DOCS} SELECT key, CAST({_SCORE} AS BIGINT) AS score FROM v_docs WHERE {_HIT}")
def lexical_scores(spark, sf):
    return search.lexical_search(views.docs(spark, sf), SEARCH_QUERY, None).select("key", "score")


_INDEX_QUERIES = ["estion outre Ingor", "hntiwh", "the", "a b", "zzzzzz", "ther ENTI"]


def _index_query_sql(q: str) -> str:
    tokens = [t for t in re.findall(tx.SEARCH_TOKEN, q.lower()) if t not in tx.STOPWORDS] or [q.strip().lower()]
    score = " + ".join(f"CASE WHEN contains(lower({c}), '{t}') THEN {w} ELSE 0 END" for t in tokens for c, w in search.WEIGHTS.items())
    return f"SELECT '{q}' AS query, key, CAST({score} AS BIGINT) AS score FROM v_docs WHERE " + " OR ".join(f"contains(lower(full_text), '{t}')" for t in tokens)


@query(f"WITH {views.DOCS} " + " UNION ALL ".join(map(_index_query_sql, _INDEX_QUERIES)))
def indexed_lexical_search(spark, sf):
    """Searches over a trigram index of all documents: the same hits and scores as a scan of them."""
    index = text_index.TextIndex.build(views.docs(spark, sf), store.scratch(spark, "text-index"))
    hits = [index.search(q, None).select(F.lit(q).alias("query"), "key", "score") for q in _INDEX_QUERIES]
    return reduce(DataFrame.unionByName, hits)


@query(f"""WITH {views.DOCS}
SELECT key, CAST(CASE WHEN contains(lower(summary), 'a b') THEN 4 ELSE 0 END + CASE WHEN contains(lower(description), 'a b') THEN 2 ELSE 0 END + 1 AS BIGINT) AS score
FROM v_docs WHERE contains(lower(full_text), 'a b')""")
def lexical_search_no_tokens(spark, sf):
    return search.lexical_search(views.docs(spark, sf), "a b", None).select("key", "score")


@query(f"""WITH {views.BLOCKS} SELECT block_id, source_id, CAST(order_index AS BIGINT) AS order_index FROM v_blocks
WHERE contains(lower(content), 'sthe') OR contains(lower(content), 'nder') ORDER BY order_index, block_id LIMIT 30""")
def block_search(spark, sf):
    return search.block_search(views.blocks(spark, sf), "Sthe, nder!", 30).select("block_id", "source_id", "order_index")


_RT = ["enou", "ther", "tion"]
_RSCORE = " + ".join(f"CASE WHEN contains(lower(title || ' ' || snippet), '{t}') THEN 1.0 ELSE 0.0 END" for t in _RT)
_RSCORE = f"round(CAST({_RSCORE} AS DOUBLE) + 0.2 * len(list_intersect(['enou', 'ther', 'tion'], regexp_extract_all(lower(title || ' ' || snippet), '{tx.RETRIEVAL_TOKEN}'))), 3)"
_CHUNKS = f"""{views.MARKDOWN},
v_parts AS (
  SELECT path, trim(text) AS text, list_filter(list_transform(regexp_split_to_array(trim(text), '\\n\\s*\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(x) >= 40) AS parts
  FROM v_md),
v_chunks AS (
  SELECT path, unnest(CASE WHEN len(parts) > 0 THEN parts WHEN text = '' THEN [] ELSE [substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 2000)] END) AS chunk FROM v_parts)"""


@query(f"WITH {_CHUNKS} SELECT path, CAST(len(chunk) AS BIGINT) AS n_chars, md5(chunk) AS digest FROM v_chunks")
def chunk_documents(spark, sf):
    rows = views.markdown(spark, sf).select("path", F.explode(tx.chunks(F.col("text"))).alias("chunk"))
    return rows.select("path", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


def passages(spark, sf) -> DataFrame:
    md = views.markdown(spark, sf).select(F.lit("md").alias("source_type"), F.col("path").alias("source_id"), F.col("path").alias("title"), F.explode(tx.chunks(F.col("text"))).alias("snippet"))
    talk = table(spark, sf, "conversations").select(F.lit("jira").alias("source_type"), F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("source_id"), F.col("role").alias("title"), F.explode(tx.chunks(F.col("text"))).alias("snippet"))
    return md.unionByName(talk)


@query(f"""WITH {_CHUNKS},
talk AS (SELECT 'c' || conv_id || ':' || turn AS id, role, trim(coalesce(text, '')) AS text FROM conversations),
talk_parts AS (SELECT *, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: len(x) >= 40) AS parts FROM talk),
every AS (
  SELECT 'md' AS source_type, path AS source_id, path AS title, chunk AS snippet FROM v_chunks
  UNION ALL
  SELECT 'jira', id, role, unnest(CASE WHEN len(parts) > 0 THEN parts WHEN text = '' THEN [] ELSE [substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 2000)] END) FROM talk_parts),
scored AS (SELECT *, {_RSCORE} AS score, CASE WHEN source_type = 'jira' THEN substr(snippet, 1, 500) ELSE substr(snippet, 1, 800) END AS cut FROM every)
SELECT source_type, source_id, score, md5(cut) AS digest FROM scored WHERE score > 0""")
def support_search(spark, sf):
    return search.support_search(passages(spark, sf), "Enou THER tion", None).select("source_type", "source_id", "score", F.md5("snippet").alias("digest"))


# -- text ----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, CAST(len({tokens_sql('text')}) AS BIGINT) AS n, CAST(len(list_distinct({tokens_sql('text')})) AS BIGINT) AS distinct_n FROM documents")
def tokenize_stats(spark, sf):
    t = tx.search_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("distinct_n"))


_FOLDED = "regexp_extract_all(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[a-z0-9]{3,}')"


@query(f"SELECT lang, CAST(sum(len(t)) AS BIGINT) AS tokens FROM (SELECT lang, {_FOLDED} AS t FROM documents) GROUP BY lang")
def tfidf_tokenize_stats(spark, sf):
    t = tx.tfidf_tokens(F.col("text"))
    return table(spark, sf, "documents").select("lang", F.size(t).cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("tokens"))


@query("SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS term FROM conversations")
def bow_vocabulary(spark, sf):
    return table(spark, sf, "conversations").select(F.explode(tx.word_tokens(F.col("text"))).alias("term")).distinct()


_CANON = "trim(regexp_replace(regexp_replace(replace(replace(lower(trim({0})), '_', ' '), '-', ' '), '[^a-z0-9äöüß+.#/ ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT DISTINCT p_type || '_' || p_name || '-' || p_brand AS label FROM part), n AS (SELECT label, {_CANON.format('label')} AS normalized_label FROM l)
SELECT label, normalized_label, 'term:' || substr(sha1(normalized_label), 1, 20) AS term_id FROM n""")
def normalize_terms(spark, sf):
    rows = table(spark, sf, "part").select(F.concat("p_type", F.lit("_"), "p_name", F.lit("-"), "p_brand").alias("label")).distinct()
    rows = rows.withColumn("normalized_label", tx.canonical_term(F.col("label")))
    return rows.withColumn("term_id", tx.hashed_id("term:", F.col("normalized_label")))


@query(f"WITH {views.BLOCKS} SELECT block_id, substr(sha256(source_id || ':' || block_type || ':' || content || ':' || order_index), 1, 16) AS hashed FROM v_blocks")
def block_ids(spark, sf):
    return views.blocks(spark, sf).select("block_id", tx.block_id(F.col("source_id"), F.col("block_type"), F.col("content"), F.col("order_index")).alias("hashed"))


@query("""WITH s AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN len(t) <= 180 THEN t ELSE rtrim(substr(t, 1, 179)) || '…' END AS snippet FROM s""")
def snippets(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.snippet(F.col("text")).alias("snippet"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS minute FROM orders")
def parse_event_day(spark, sf):
    o = table(spark, sf, "orders").withColumn("ts", F.col("o_orderdate"))
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm")).when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 2, F.date_format("ts", "dd.MM.yyyy HH:mm"))
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00")))
    )
    o = o.withColumn("text", text)
    return o.select("o_orderkey", dates.event_day(F.lit(""), F.col("text")).alias("day"), F.date_format(dates.parse(F.col("text")), "yyyy-MM-dd'T'HH:mm").alias("minute"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'n/a ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M') END AS canonical FROM orders")
def csv_dates(spark, sf):
    kind = F.col("o_orderkey") % 3
    text = F.when(kind == 0, F.date_format("o_orderdate", "dd.MM.yyyy HH:mm")).when(kind == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("n/a "), "o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", dates.canonical(text).alias("canonical"))


# -- mining --------------------------------------------------------------------------------------------------------


@query(f"WITH {views.EVENTS} SELECT event_day AS day, count(*) AS issue_count, array_to_string(list_sort(list(key)), ',') AS keys FROM v_events GROUP BY 1")
def daily_timeline(spark, sf):
    return mining.daily_timeline(views.events(spark, sf)).select("day", "issue_count", F.array_join("issue_keys", ",").alias("keys"))


@query(f"""WITH {views.ISSUES}, d AS (SELECT event_day AS day, count(*) AS issue_count, array_to_string(list_sort(list(key)), ',') AS keys FROM v_issues GROUP BY 1)
SELECT * FROM d ORDER BY day DESC LIMIT 7""")
def timeline_last_n(spark, sf):
    return mining.daily_timeline(views.issues(spark, sf), 7).select("day", "issue_count", F.array_join("issue_keys", ",").alias("keys"))


@query(f"""WITH {views.ISSUES},
l AS (SELECT event_day AS day, seen, unnest(labels) AS topic, generate_subscripts(labels, 1) AS pos FROM v_issues),
t0 AS (SELECT event_day AS day, seen, {tokens_sql('full_text')} AS tk FROM v_issues),
t AS (SELECT day, seen, unnest(tk) AS topic, generate_subscripts(tk, 1) AS pos FROM t0),
lr AS (SELECT day, topic, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, min(seen * 100000 + pos)) AS r FROM l GROUP BY day, topic),
tr AS (SELECT day, topic, row_number() OVER (PARTITION BY day ORDER BY count(*) DESC, min(seen * 100000 + pos)) AS r FROM t GROUP BY day, topic),
top AS (SELECT * FROM lr WHERE r <= 5),
k AS (SELECT day, count(*) AS k FROM top GROUP BY day),
fill AS (SELECT tr.day, tr.topic, tr.r + 5 AS r FROM tr LEFT JOIN k USING (day) WHERE tr.r <= 5 - coalesce(k, 0) AND NOT EXISTS (SELECT 1 FROM top WHERE top.day = tr.day AND top.topic = tr.topic))
SELECT day, string_agg(topic, ',' ORDER BY r) AS topics FROM (SELECT * FROM top UNION ALL SELECT * FROM fill) GROUP BY day""")
def daily_topics(spark, sf):
    return mining.daily_topics(views.issues(spark, sf)).select("day", F.array_join("topics", ",").alias("topics"))


@query(f"""WITH t0 AS (SELECT doc_id AS key, {tokens_sql('text')} AS tk FROM documents),
t AS (SELECT key, unnest(tk) AS term, generate_subscripts(tk, 1) AS pos FROM t0),
r AS (SELECT key, term, count(*) AS n, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(pos)) AS rank FROM t GROUP BY key, term)
SELECT key, CAST(rank AS INTEGER) AS rank, term, n FROM r WHERE rank <= 6""")
def top_terms_per_doc(spark, sf):
    return mining.top_terms(views.docs(spark, sf), "key", "description")


def _valid(c: str) -> str:
    return f"len({c}) >= 4 AND regexp_matches({c}, '[a-zäöüß]') AND {c} NOT IN {NOISE} AND NOT regexp_full_match({c}, '[a-z]{{1,2}}[0-9]+')"


_TERMS_SQL = f"""WITH {views.ISSUES},
ls AS (SELECT key, trim(replace(replace(lower(l), '_', ' '), '-', ' ')) AS label FROM (SELECT key, unnest(labels) AS l FROM v_issues)),
lt AS (SELECT key, unnest(list_distinct(list_filter(list_concat([label], {tokens_sql('label')}), lambda t: {_valid('t')}))) AS term, 'label' AS source FROM ls),
tt AS (SELECT key, unnest(list_filter({tokens_sql('description')}, lambda t: {_valid('t')})) AS term, 'description' AS source FROM v_issues),
h AS (SELECT * FROM lt UNION ALL SELECT * FROM tt),
a AS (
  SELECT term, count(*) FILTER (source = 'label') AS label_hits, count(*) FILTER (source <> 'label') AS text_hits, count(DISTINCT key) AS issue_count,
         array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, array_to_string(list_sort(list(DISTINCT key))[1:5], ',') AS keys
  FROM h GROUP BY term)
SELECT term, CAST(6 * label_hits + text_hits AS BIGINT) AS count, issue_count, label_hits, sources, keys FROM a
WHERE label_hits > 0 OR (6 * label_hits + text_hits >= {{m}} + 1 AND issue_count >= 2 AND text_hits >= {{m}})
ORDER BY label_hits DESC, count DESC, issue_count DESC, len(term), term LIMIT 40"""


def _terms(spark, sf, least):
    rows = mining.domain_terms(views.issues(spark, sf), least)
    return rows.select("term", "count", "issue_count", "label_hits", F.array_join("sources", ",").alias("sources"), F.array_join("sample_issue_keys", ",").alias("keys"))


@query(_TERMS_SQL.replace("{m}", "2"))
def domain_terms(spark, sf):
    return _terms(spark, sf, 2)


@query(_TERMS_SQL.replace("{m}", "2000"))
def domain_terms_min_count(spark, sf):
    return _terms(spark, sf, 2000)


# -- vectors -------------------------------------------------------------------------------------------------------

_TF = f"""tl AS (SELECT doc_id AS key, {_FOLDED} AS l FROM documents),
tok AS (SELECT key, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM tl),
tf AS (SELECT key, term, count(*) AS n, min(pos) AS pos FROM tok GROUP BY key, term),
df AS (SELECT term, count(*) AS df, min({{'key': key, 'pos': pos}}) AS seen FROM tf GROUP BY term),
nd AS (SELECT count(*) AS nd FROM documents),
idf AS (SELECT term, df, ln((1 + CAST(nd AS DOUBLE)) / (1 + CAST(df AS DOUBLE))) + 1 AS idf FROM df, nd ORDER BY df DESC, seen, term LIMIT 2048),
total AS (SELECT key, sum(n) AS total FROM tf GROUP BY key),
w AS (SELECT key, term, CAST(n AS DOUBLE) / total * idf AS weight FROM tf JOIN idf USING (term) JOIN total USING (key))"""


def _tfidf(spark, sf):
    return vectors.tfidf(views.docs(spark, sf), "key", "description")


@query(f"WITH {_TF} SELECT term, df FROM df")
def document_frequency(spark, sf):
    found = vectors.terms_of(views.docs(spark, sf), tx.tfidf_tokens(F.col("description")))
    return vectors.document_frequency(found).select("term", "df")


@query(f"WITH {_TF} SELECT term, df, round(idf + 1e-9, 6) AS idf FROM idf")
def tfidf_idf(spark, sf):
    return _tfidf(spark, sf)[1].select("term", "df", values.stable(F.col("idf")).alias("idf"))


@query(f"WITH {_TF} SELECT key, term, round(weight + 1e-9, 6) AS weight FROM w")
def tfidf_weights(spark, sf):
    return _tfidf(spark, sf)[0].select("key", "term", values.stable(F.col("weight")).alias("weight"))


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS key, unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS term FROM conversations)
SELECT key, term, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY key) + 1e-9, 6) AS weight FROM t GROUP BY key, term""")
def bow_weights(spark, sf):
    turns = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "text")
    return vectors.bag_of_words(turns).select("key", "term", values.stable(F.col("weight")).alias("weight"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS key, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) + 1e-9, 6) AS score FROM embeddings, q
WHERE list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) > 0""")
def cosine_similarity(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    return search.similar(e, list(e.where("key = 0").first()["vector"]), None).select("key", values.stable(F.col("score")).alias("score"))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 1),
s AS (SELECT vec_id AS key, 'f' || label AS field_name, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM embeddings, q WHERE label % 2 = 0)
SELECT key, field_name, round(s + 1e-9, 6) AS score FROM s WHERE s > 0 ORDER BY s DESC, key LIMIT 25""")
def field_search(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("key"), F.concat(F.lit("f"), "label").alias("field_name"), F.when(F.col("label") % 2 == 0, "comment").otherwise("description").alias("field_kind"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    q = list(rows.where("key = 1").first()["vector"])
    return search.field_search(rows, q, "comment", 25).select("key", "field_name", values.stable(F.col("score")).alias("score"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0),
s AS (SELECT q.vec_id AS q, e.vec_id AS key, round(list_cosine_similarity(q.v, e.v), 9) AS score FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT q, key, round(score + 1e-9, 6) AS score, rank FROM r WHERE rank <= 10""")
def vector_index_search(spark, sf):
    """An index of all vectors, searched for the ten nearest of every fiftieth, exactly."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    index = vector_index.VectorIndex.build(e, store.scratch(spark, "vector-index"))
    return index.search(e.where("key % 50 = 0"), 10, exact=True).withColumn("score", values.stable(F.col("score")))


_HQ = "estion outre ingor the"
_SEM = f"""{_TF},
q0 AS (SELECT unnest(['estion', 'outre', 'ingor', 'the']) AS term),
q AS (SELECT term, 1.0 / 4 * idf AS weight FROM q0 JOIN idf USING (term)),
qn AS (SELECT sqrt(sum(weight * weight)) AS qn FROM q),
sem AS (SELECT w.key, sum(w.weight * coalesce(q.weight, 0)) / (sqrt(sum(w.weight * w.weight)) * any_value(qn)) AS score FROM w LEFT JOIN q USING (term), qn GROUP BY w.key HAVING sum(w.weight * coalesce(q.weight, 0)) > 0)"""


@query(f"WITH {_SEM} SELECT key, round(score + 1e-9, 6) AS score FROM sem")
def semantic_search(spark, sf):
    weights, vocab = _tfidf(spark, sf)
    hits = search.sparse_similar(weights, vectors.query_weights(spark, _HQ, vocab))
    return hits.select("key", values.stable(F.col("score")).alias("score"))


_HYBRID = f"""{_SEM}, {views.DOCS},
lx AS (SELECT key, CAST({_SCORE} AS DOUBLE) AS score FROM v_docs WHERE {_HIT} ORDER BY score DESC, key LIMIT 80),
sx AS (SELECT key, score FROM sem ORDER BY score DESC, key LIMIT 80),
ls AS (SELECT key, score / max(score) OVER () AS lexical_score FROM lx),
ss AS (SELECT key, score / max(score) OVER () AS semantic_score FROM sx),
hs AS (
  SELECT key, coalesce(lexical_score, 0) AS lexical_score, coalesce(semantic_score, 0) AS semantic_score,
         0.35 * coalesce(lexical_score, 0) + 0.65 * coalesce(semantic_score, 0) AS combined_score
  FROM ls FULL JOIN ss USING (key) ORDER BY combined_score DESC, key LIMIT 20)"""


@query(f"""WITH {_HYBRID} SELECT key, round(lexical_score + 1e-9, 6) AS lexical_score, round(semantic_score + 1e-9, 6) AS semantic_score, round(combined_score + 1e-9, 6) AS combined_score FROM hs""")
def hybrid_search(spark, sf):
    weights, vocab = _tfidf(spark, sf)
    hits = search.hybrid_search(views.docs(spark, sf), weights, SEARCH_QUERY, vectors.query_weights(spark, _HQ, vocab), 20)
    return hits.select("key", *(values.stable(F.col(c)).alias(c) for c in ("lexical_score", "semantic_score", "combined_score")))


# -- graph ---------------------------------------------------------------------------------------------------------

_NODES = f"""{views.ISSUES},
v_kinds AS (
  SELECT 'issue:' || key AS node_id, 'issue' AS node_type, summary AS label, seen FROM v_issues
  UNION ALL SELECT 'assignee:' || lower(assignee), 'assignee', assignee, seen FROM v_issues
  UNION ALL SELECT 'status:' || lower(status), 'status', status, seen FROM v_issues
  UNION ALL SELECT 'type:' || lower(issue_type), 'type', issue_type, seen FROM v_issues
  UNION ALL SELECT 'day:' || event_day, 'day', event_day, seen FROM v_issues
  UNION ALL SELECT 'label:' || lower(l), 'label', l, seen FROM (SELECT unnest(labels) AS l, seen FROM v_issues)),
v_nodes AS (SELECT node_id, arg_max(node_type, seen) AS node_type, arg_max(label, seen) AS label FROM v_kinds GROUP BY node_id),
v_edges AS (
  SELECT DISTINCT 'issue:' || key AS src_id, 'assignee:' || lower(assignee) AS dst_id, 'assigned_to' AS relation, 1.0::DOUBLE AS weight FROM v_issues
  UNION SELECT 'issue:' || key, 'status:' || lower(status), 'has_status', 1.0 FROM v_issues
  UNION SELECT 'issue:' || key, 'type:' || lower(issue_type), 'has_type', 1.0 FROM v_issues
  UNION SELECT 'issue:' || key, 'day:' || event_day, 'updated_on', 1.0 FROM v_issues
  UNION SELECT 'issue:' || key, 'label:' || lower(l), 'has_label', 1.0 FROM (SELECT key, unnest(labels) AS l FROM v_issues))"""

_RELATED = """r_rows AS (SELECT DISTINCT 'issue:O-' || l_orderkey AS id, lower(p_name) || ' ' || p_partkey AS label FROM lineitem JOIN part ON l_partkey = p_partkey),
r_pairs AS (SELECT a.id AS l, b.id AS r, CAST(count(*) AS DOUBLE) AS weight FROM r_rows a JOIN r_rows b ON a.label = b.label AND a.id < b.id GROUP BY 1, 2)"""


def _part_issues(spark, sf):
    """Orders as issues whose labels are the parts ordered."""
    part = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_partkey").alias("label"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.concat(F.lit("O-"), "l_orderkey").alias("key")).agg(F.collect_set("label").alias("labels"))


@query(f"WITH {_NODES} SELECT * FROM v_nodes")
def issue_nodes(spark, sf):
    return graph.issue_nodes(views.issues(spark, sf))


@query(f"WITH {_NODES} SELECT * FROM v_edges")
def issue_edges(spark, sf):
    return graph.issue_edges(views.issues(spark, sf))


@query(f"WITH {_RELATED} SELECT l AS src_id, r AS dst_id, 'related_label' AS relation, weight FROM r_pairs UNION ALL SELECT r, l, 'related_label', weight FROM r_pairs")
def related_label_edges(spark, sf):
    return graph.related_label_edges(_part_issues(spark, sf))


@query(f"""WITH {_NODES} SELECT n.node_id, n.node_type, e.relation, e.weight FROM v_edges e JOIN v_nodes n ON e.dst_id = n.node_id WHERE e.src_id = 'issue:O-7' ORDER BY e.weight DESC, n.node_id, e.relation LIMIT 6""")
def issue_neighbors(spark, sf):
    i = views.issues(spark, sf)
    return graph.neighbors(graph.issue_edges(i), graph.issue_nodes(i), "issue:O-7", limit=6)


@query(f"""WITH {views.ISSUES}, seeds AS (SELECT 'issue:O-' || k AS node_id, k AS rank FROM (SELECT unnest([1, 2, 3, 5, 7]) AS k)),
ls AS (SELECT DISTINCT 'issue:' || key AS id, lower(l) AS l FROM (SELECT key, unnest(labels) AS l FROM v_issues)),
e AS (SELECT a.id AS src_id, b.id AS dst_id, count(*) AS weight FROM ls a JOIN ls b USING (l) WHERE a.id IN (SELECT node_id FROM seeds) AND a.id <> b.id GROUP BY 1, 2),
r AS (SELECT e.dst_id, s.rank, row_number() OVER (PARTITION BY e.src_id ORDER BY weight DESC, dst_id) AS r FROM e JOIN seeds s ON e.src_id = s.node_id)
SELECT dst_id AS node_id, CAST(min(rank * 100 + r) // 100 AS BIGINT) AS rank, CAST(min(rank * 100 + r) % 100 AS INTEGER) AS r FROM r WHERE r <= 5 AND dst_id NOT IN (SELECT node_id FROM seeds) GROUP BY dst_id""")
def related_issues(spark, sf):
    seeds = spark.createDataFrame([(f"issue:O-{k}", k) for k in (1, 2, 3, 5, 7)], "node_id string, rank long")
    related = graph.related_to(views.issues(spark, sf), seeds.select(F.substring("node_id", 7, 100).alias("key")))
    return graph.expand(related, seeds, ["related_label"])


@query(f"""WITH {_NODES}, n AS (SELECT count(*) AS nodes FROM v_nodes), m AS (SELECT count(*) AS edges FROM (SELECT DISTINCT src_id, dst_id FROM v_edges))
SELECT nodes, edges, round(CAST(edges AS DOUBLE) / (nodes * (nodes - 1)) + 1e-9, 6) AS density FROM n, m""")
def graph_stats(spark, sf):
    i = views.issues(spark, sf)
    return graph.statistics(graph.issue_nodes(i), graph.issue_edges(i), simple=True).withColumn("density", values.stable(F.col("density")))


@query(f"""WITH {_NODES}, e AS (SELECT DISTINCT src_id, dst_id FROM v_edges), d AS (SELECT node_id, count(*) AS degree FROM (SELECT src_id AS node_id FROM e UNION ALL SELECT dst_id FROM e) GROUP BY node_id)
SELECT node_id, degree, CAST(greatest(4, least(22, degree + 3)) AS BIGINT) AS size FROM d""")
def node_degree(spark, sf):
    return graph.degrees(graph.issue_edges(views.issues(spark, sf)), simple=True)


@query(f"WITH {_NODES} SELECT node_type, count(*) AS n FROM v_nodes GROUP BY node_type")
def node_types(spark, sf):
    return graph.histogram(graph.issue_nodes(views.issues(spark, sf)), "node_type")


def _together(**results: DataFrame) -> DataFrame:
    """Several results as one: (result, row), each row as text, so that all that an operator gives is compared."""
    parts = [r.select(F.lit(name).alias("result"), F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in r.columns]).alias("row")) for name, r in results.items()]
    return reduce(DataFrame.unionByName, parts)


def _graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _together(node=nodes.select("node_id", "node_type", F.md5("label").alias("label")), edge=edges.select("src_id", "dst_id", "relation", F.format_string("%.1f", "weight").alias("weight")))


_BLOCK_LINKS = """b_links AS (SELECT block_id AS src_id, 'c' || conv_id || ':0' AS dst_id, 'starts' AS relation, 0.5::DOUBLE AS weight FROM v_blocks JOIN conversations ON block_id = 'c' || conv_id || ':' || turn WHERE turn % 3 = 2)"""


def _block_links(spark, sf) -> DataFrame:
    """Every third turn has a stored relation to the first one."""
    c = table(spark, sf, "conversations").where("turn % 3 = 2").dropDuplicates(["conv_id", "turn"])
    return c.select(F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn").alias("src_id"), F.concat(F.lit("c"), "conv_id", F.lit(":0")).alias("dst_id"), F.lit("starts").alias("relation"), F.lit(0.5).alias("weight"))


@query(f"""WITH {views.BLOCKS}, {_BLOCK_LINKS}, e AS (SELECT block_id AS src_id, parent_id AS dst_id, 'parent_of' AS relation, '1.0' AS weight FROM v_blocks WHERE parent_id IS NOT NULL UNION SELECT src_id, dst_id, relation, '0.5' FROM b_links)
SELECT 'node' AS result, block_id || '|' || block_type || '|' || md5(substr(content, 1, 120)) AS row FROM v_blocks UNION ALL SELECT 'edge', src_id || '|' || dst_id || '|' || relation || '|' || weight FROM e""")
def block_graph(spark, sf):
    return _graph_rows(*graph.block_graph(views.blocks(spark, sf), _block_links(spark, sf)))


@query(f"""WITH {views.BLOCKS}, n AS (SELECT * FROM v_blocks WHERE source_id = 'c7' ORDER BY order_index, block_id LIMIT 400), {_BLOCK_LINKS},
e AS (SELECT a.block_id AS src_id, a.parent_id AS dst_id, 'parent_of' AS relation, '1.0' AS weight FROM n a JOIN n b ON a.parent_id = b.block_id UNION SELECT src_id, dst_id, relation, '0.5' FROM b_links WHERE src_id IN (SELECT block_id FROM n) AND dst_id IN (SELECT block_id FROM n))
SELECT 'node' AS result, block_id || '|' || block_type || '|' || md5(substr(content, 1, 120)) AS row FROM n UNION ALL SELECT 'edge', src_id || '|' || dst_id || '|' || relation || '|' || weight FROM e""")
def source_subgraph(spark, sf):
    return _graph_rows(*graph.source_subgraph(views.blocks(spark, sf), _block_links(spark, sf), "c7"))


@query(f"WITH {views.BLOCKS} SELECT parent_id, block_id, CAST(order_index AS BIGINT) AS order_index FROM v_blocks WHERE parent_id = 'c3:0'")
def children(spark, sf):
    return graph.children(views.blocks(spark, sf), "c3:0").select("parent_id", "block_id", "order_index")


_REACH = f"""{views.FACTS},
e AS (SELECT DISTINCT CAST(source_term_id AS VARCHAR) AS src, CAST(target_term_id AS VARCHAR) AS dst FROM v_rel),
walk(node_id, hops) AS (SELECT '0', 0 UNION SELECT e.dst, hops + 1 FROM walk JOIN e ON walk.node_id = e.src WHERE hops < (SELECT count(DISTINCT dst) + 1 FROM e))"""


@query(f"WITH RECURSIVE {_REACH} SELECT node_id, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY node_id")
def shortest_paths(spark, sf):
    r = views.term_relations(spark, sf)
    edges = r.select(F.col("source_term_id").cast("string").alias("src_id"), F.col("target_term_id").cast("string").alias("dst_id"))
    return graph.distances(edges, "0")


_VAR = "'n_' || regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]', '_', 'g')"


@query(f"""WITH {_NODES}
SELECT 1 AS part, 'MERGE (' || {_VAR.format('node_id')} || ':' || upper(node_type[1]) || lower(node_type[2:]) || ' {{id: ''' || replace(node_id, '''', '\\''') || '''}}) SET ' || {_VAR.format('node_id')} || '.name = ''' || replace(label, '''', '\\''') || ''';' AS line FROM v_nodes
UNION ALL
SELECT 2, 'MATCH (' || {_VAR.format('src_id')} || ' {{id: ''' || src_id || '''}}), (' || {_VAR.format('dst_id')} || ' {{id: ''' || dst_id || '''}}) MERGE (' || {_VAR.format('src_id')} || ')-[:' || replace(upper(relation), '-', '_') || ' {{weight: 1.0}}]->(' || {_VAR.format('dst_id')} || ');' FROM v_edges""".replace("{{", "{").replace("}}", "}"))
def cypher_export(spark, sf):
    i = views.issues(spark, sf)
    return graph.cypher(graph.issue_nodes(i), graph.issue_edges(i), limit_nodes=None, limit_edges=None).select("part", "line")


# -- terms ---------------------------------------------------------------------------------------------------------

_GAPS = f"""{views.FACTS},
fs AS (SELECT term_id, count(*) AS fact_count, avg(confidence) AS avg_confidence, count(*) FILTER (fact_type = 'definition') AS def_count FROM v_current GROUP BY term_id),
rs AS (SELECT source_term_id AS term_id, count(*) AS relation_count FROM v_rel GROUP BY 1),
g0 AS (SELECT term_id, coalesce(fact_count, 0) AS fact_count, coalesce(relation_count, 0) AS relation_count, coalesce(avg_confidence, 0) AS avg_confidence, coalesce(def_count, 0) AS def_count FROM v_terms LEFT JOIN fs USING (term_id) LEFT JOIN rs USING (term_id)),
g AS (SELECT *, def_count = 0 AS needs_definition, fact_count < 40 OR avg_confidence < 0.1 AS needs_facts, relation_count < 12 AS needs_relations FROM g0)"""
_LEAST = {"min_facts": 40, "min_relations": 12, "min_confidence": 0.1}


def _store(spark, sf):
    return views.user_terms(spark, sf), views.facts(spark, sf), views.term_relations(spark, sf)


@query(f"WITH {views.FACTS} SELECT fact_id, term_id, fact_type, round(confidence + 1e-9, 6) AS confidence FROM v_current")
def current_facts(spark, sf):
    return terms.current_facts(views.facts(spark, sf)).select("fact_id", "term_id", "fact_type", values.stable(F.col("confidence")).alias("confidence"))


@query(f"WITH {views.FACTS} SELECT relation_id, source_term_id, coalesce(canonical_label, CAST(target_term_id AS VARCHAR)) AS target_label, weight FROM v_rel LEFT JOIN (SELECT * FROM v_terms WHERE term_id % 3 <> 0) t ON target_term_id = t.term_id")
def term_relations(spark, sf):
    t, _, r = _store(spark, sf)
    return terms.term_relations(r, t.where("term_id % 3 <> 0")).select("relation_id", "source_term_id", "target_label", "weight")


@query(f"""WITH {views.FACTS}, r AS (SELECT *, row_number() OVER (PARTITION BY term_id ORDER BY created_at DESC, fact_id) AS r FROM v_current),
l AS (SELECT *, row_number() OVER (PARTITION BY source_term_id ORDER BY weight DESC, created_at DESC, target_term_id) AS r FROM v_rel)
SELECT 'fact' AS result, fact_id || '|' || term_id AS row FROM r WHERE r <= 6
UNION ALL SELECT 'relation', source_term_id || '|' || target_term_id || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM l WHERE r <= 8""")
def term_context(spark, sf):
    _, f, r = _store(spark, sf)
    facts, relations = terms.term_context(f, r)
    return _together(fact=facts.select("fact_id", "term_id"), relation=relations.select("source_term_id", "target_term_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")))


@query(f"""WITH {_GAPS}, p AS (SELECT *, CASE WHEN needs_definition THEN 5.0 ELSE 0 END + CASE WHEN needs_facts THEN 3.0 ELSE 0 END + CASE WHEN needs_relations THEN 2.0 ELSE 0 END + greatest(0.0, 0.1 - avg_confidence) AS p FROM g WHERE needs_definition OR needs_facts OR needs_relations)
SELECT term_id, fact_count, relation_count, round(CAST(avg_confidence AS DOUBLE) + 1e-9, 6) AS avg_confidence, needs_definition, needs_facts, needs_relations, round(CAST(p AS DOUBLE) + 1e-9, 6) AS priority_score FROM p ORDER BY p DESC, fact_count, term_id LIMIT 20""")
def term_gaps(spark, sf):
    rows = terms.term_gaps(*_store(spark, sf), limit=20, **_LEAST)
    return rows.select("term_id", "fact_count", "relation_count", values.stable(F.col("avg_confidence")).alias("avg_confidence"), "needs_definition", "needs_facts", "needs_relations", values.stable(F.col("priority_score")).alias("priority_score"))


@query(f"""WITH {_GAPS} SELECT count(*) FILTER (needs_definition) AS needs_definition, count(*) FILTER (needs_facts) AS needs_facts, count(*) FILTER (needs_relations) AS needs_relations,
count(*) FILTER (needs_definition OR needs_facts OR needs_relations) AS total_gaps FROM g""")
def gap_totals(spark, sf):
    return terms.gap_totals(*_store(spark, sf), **_LEAST)


@query(f"""WITH {views.FACTS}, {views.JOBS} SELECT 'terms' AS name, count(*) AS rows FROM v_terms UNION ALL SELECT 'facts', count(*) FROM v_facts UNION ALL SELECT 'relations', count(*) FROM v_rel UNION ALL SELECT 'jobs', count(*) FROM v_jobs""")
def monitoring_counts(spark, sf):
    t, f, r = _store(spark, sf)
    return terms.table_counts(terms=t, facts=f, relations=r, jobs=views.jobs(spark, sf))


def _found_terms(spark, sf) -> DataFrame:
    """Names and types of parts as mined terms."""
    p = table(spark, sf, "part").select(F.explode(F.array(F.struct(F.col("p_name").alias("term"), F.lit("description").alias("s")), F.struct(F.concat("p_type", F.lit("_systems")).alias("term"), F.lit("label").alias("s")))).alias("x"), "p_partkey")
    return p.groupBy("x.term").agg(F.count(F.lit(1)).alias("count"), F.count(F.lit(1)).alias("issue_count"), F.sort_array(F.collect_set("x.s")).alias("sources"), F.array(F.min("p_partkey").cast("string")).alias("sample_issue_keys"))


def part_candidates(spark, sf) -> DataFrame:
    return terms.candidates(_found_terms(spark, sf))


_CANDS = f"""c0 AS (SELECT p_name AS term, 'text' AS source_type, p_partkey FROM part UNION ALL SELECT p_type || '_systems', 'label', p_partkey FROM part),
c1 AS (SELECT term, source_type, regexp_replace({_CANON.format('term')}, ' systems$', ' system') AS normalized_label, count(*) AS count FROM c0 GROUP BY term, source_type)"""


@query(f"""WITH {_CANDS} SELECT 'term:' || substr(sha1(normalized_label), 1, 20) AS term_id, arg_min(term, (CASE source_type WHEN 'label' THEN 0 ELSE 1 END, -count, term)) AS canonical_label, normalized_label FROM c1 GROUP BY normalized_label""")
def candidates_promote(spark, sf):
    return terms.promote(part_candidates(spark, sf), limit=None)[0].select("term_id", "canonical_label", "normalized_label")


@query(f"""WITH {_CANDS}, c2 AS (SELECT DISTINCT normalized_label, source_type, source_type = 'label' OR normalized_label LIKE 'c%' AS known FROM c1)
SELECT normalized_label, source_type, CASE WHEN known THEN 'old:' || normalized_label ELSE 'term:' || substr(sha1(normalized_label), 1, 20) END AS promoted_term_id, NOT known AS made FROM c2""")
def promote_over_store(spark, sf):
    """The types were promoted before, and terms of names in c were forgotten: none of them becomes new again."""
    cands = part_candidates(spark, sf)
    old_id = F.concat(F.lit("old:"), "normalized_label")
    previous = cands.where("source_type = 'label'").select("candidate_id", old_id.alias("promoted_term_id"))
    forgotten = cands.where("normalized_label LIKE 'c%'").select(old_id.alias("term_id"), "normalized_label", F.lit("deprecated").alias("status")).distinct()
    made, marked = terms.promote(terms.candidates(_found_terms(spark, sf), previous), forgotten, limit=None)
    new = made.select("normalized_label", F.lit(True).alias("made"))
    return marked.join(new, "normalized_label", "left").select("normalized_label", "source_type", "promoted_term_id", F.coalesce("made", F.lit(False)).alias("made"))


@query(f"""WITH {_CANDS} SELECT normalized_label, CAST(max(count) AS BIGINT) AS count, CAST(max(count) AS BIGINT) AS issue_count, string_agg(DISTINCT source_type, ',' ORDER BY source_type) AS sources FROM c1 GROUP BY normalized_label HAVING max(count) >= 20""")
def domain_term_listing(spark, sf):
    made, marked = terms.promote(part_candidates(spark, sf), limit=None)
    return terms.promoted_listing(made, marked, 20).select("normalized_label", "count", "issue_count", F.array_join("sources", ",").alias("sources"))


@query(f"""WITH {views.FACTS} SELECT 'term' AS result, term_id || '|' || CASE WHEN term_id = 7 THEN 'deprecated' ELSE 'new' END AS row FROM v_terms
UNION ALL SELECT 'candidate', event_id || '|' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE CAST(user_id AS VARCHAR) END FROM events WHERE event_id % 3 = 0 OR user_id <> 7
UNION ALL SELECT 'alias', user_id || '|' || event_type FROM events WHERE user_id <> 7""")
def forget_term(spark, sf):
    """Events as candidates of users, some of them not promoted, and as their aliases."""
    e = table(spark, sf, "events")
    cands = e.select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("promoted_term_id"))
    kept, left, aliases = terms.forget(7, views.user_terms(spark, sf), cands, e.select(F.col("user_id").alias("term_id"), "event_type"))
    return _together(term=kept.select("term_id", "status"), candidate=left.select("event_id", "promoted_term_id"), alias=aliases.select("term_id", "event_type"))


def _label_terms_table(spark, sf) -> DataFrame:
    """The two words that each document starts with, as terms."""
    d = table(spark, sf, "documents")
    rows = d.select("doc_id", tx.canonical_start(F.col("text"), 2).alias("normalized_label")).groupBy("normalized_label").agg(F.min("doc_id").alias("seen"))
    return rows.where(F.col("normalized_label").rlike("^[a-z]+ [a-z]+$")).select(tx.hashed_id("term:", F.col("normalized_label")).alias("term_id"), "normalized_label", "seen")


_LABELS = f"""lt AS (
  SELECT 'term:' || substr(sha1(l), 1, 20) AS term_id, l AS normalized_label, min(doc_id) AS seen
  FROM (SELECT doc_id, array_to_string(string_split({_CANON.format('text')}, ' ')[1:2], ' ') AS l FROM documents) WHERE regexp_full_match(l, '[a-z]+ [a-z]+') GROUP BY l),
tx AS (SELECT doc_id, ' ' || regexp_replace({_CANON.format('text')}, '[^\\p{{L}}\\p{{N}}_ ]', ' # ', 'g') || ' ' AS t FROM documents WHERE len(trim(text)) >= 20)"""


_ANSWERS = """a AS (
  SELECT p_partkey AS term_id, p_name || ' of ' || p_brand AS d, p_type AS f, p_brand AS rel, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size / 50.0 END AS sure, p_size % 2 = 0 AS named FROM part)"""


def _answers(spark, sf) -> DataFrame:
    """Parts as a model's answers on the terms that they stand for."""
    p = table(spark, sf, "part")
    related = F.struct(F.col("p_brand").alias("label"), F.when(F.col("p_size") % 2 == 0, "uses").alias("relation"), F.lit(0.8).alias("weight"))
    sure = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") / 50.0).alias("confidence")
    answer = F.struct(F.concat_ws(" of ", "p_name", "p_brand").alias("definition"), F.array("p_type", F.upper("p_type")).alias("short_facts"), F.array(related, F.struct(F.lit(" ").alias("label"), F.lit("x").alias("relation"), F.lit(0.1).alias("weight"))).alias("related_terms"), sure)
    return p.select(F.col("p_partkey").alias("term_id"), F.concat(F.lit("Here it is: "), F.to_json(answer)).alias("answer"))


@query(f"""WITH {_ANSWERS}, f AS (SELECT term_id, 'definition' AS fact_type, d AS content, sure FROM a UNION ALL SELECT term_id, 'short_fact', f, sure FROM a WHERE term_id % 5 <> 0)
SELECT term_id, fact_type, content, round(least(1.0, greatest(0.0, coalesce(sure, 0.6))) + 1e-9, 6) AS confidence FROM f""")
def enriched_facts(spark, sf):
    known = table(spark, sf, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("term_id"), F.lit("short_fact").alias("fact_type"), F.lower("p_type").alias("content"))
    return terms.enriched(_answers(spark, sf), known, now())[0].select("term_id", "fact_type", "content", values.stable(F.col("confidence")).alias("confidence"))


@query(f"""WITH {_ANSWERS} SELECT term_id AS source_term_id, 'term:' || substr(sha1({_CANON.format('rel')}), 1, 20) AS target_term_id, rel AS target_label, CASE WHEN named THEN 'uses' ELSE 'related_to' END AS relation_type, 0.8::DOUBLE AS weight FROM a""")
def enriched_relations(spark, sf):
    none = spark.createDataFrame([], "term_id long, fact_type string, content string")
    return terms.enriched(_answers(spark, sf), none, now())[1].drop("created_at")


@query(f"""WITH {_LABELS}, h AS (SELECT doc_id AS record_id, term_id, row_number() OVER (PARTITION BY doc_id ORDER BY seen, term_id) AS r FROM tx, lt WHERE contains(t, ' ' || normalized_label || ' ') AND len(normalized_label) >= 4)
SELECT record_id, term_id FROM h WHERE r <= 14""")
def record_term_links(spark, sf):
    records = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("content"))
    return terms.record_links(records, _label_terms_table(spark, sf), max_words=2).select("record_id", "term_id")


@query(f"""WITH {_LABELS}, rw AS (SELECT DISTINCT doc_id AS record_id, unnest(string_split({_CANON.format('text')}, ' ')) AS w FROM documents),
tw AS (SELECT DISTINCT normalized_label, unnest(string_split(normalized_label, ' ')) AS w FROM lt)
SELECT record_id, normalized_label, count(*) AS overlap FROM rw JOIN tw USING (w) WHERE len(w) >= 4 GROUP BY 1, 2""")
def record_candidate_labels(spark, sf):
    records = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("content"))
    return terms.candidate_labels(records, _label_terms_table(spark, sf), None)


# -- jobs ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {views.JOBS} SELECT job_type, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed FROM v_jobs GROUP BY job_type""")
def job_status_pivot(spark, sf):
    return jobs.status_pivot(views.jobs(spark, sf))


@query(f"""WITH {views.JOBS} SELECT job_id FROM v_jobs WHERE status = 'pending' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-15 00:00:00') AND job_type IN ('type-0', 'type-1')""")
def claimable_jobs(spark, sf):
    return jobs.due(views.jobs(spark, sf), F.lit("2024-01-15 00:00:00").cast("timestamp"), ["type-0", "type-1"]).select("job_id")


@query(f"""WITH {views.JOBS} SELECT job_id, CASE WHEN attempts >= 5 THEN 'failed' ELSE 'pending' END AS status,
CASE WHEN attempts < 5 THEN CAST(epoch(TIMESTAMP '{NOW}') + 60 * pow(2, attempts) AS BIGINT) END AS retry_at FROM v_jobs WHERE status = 'running'""")
def retry_schedule(spark, sf):
    running = views.jobs(spark, sf).where("status = 'running'")
    out = jobs.finish(running, running.select("job_id", F.lit("model did not answer").alias("error")), now())
    return out.select("job_id", "status", F.unix_timestamp("next_retry_at").alias("retry_at"))


@query(f"""WITH {views.JOBS}, j AS (SELECT *, CASE WHEN status = 'running' AND epoch(TIMESTAMP '{NOW}') - floor(epoch(started_at)) > 864000 THEN 'failed' WHEN status = 'running' THEN 'processing' ELSE status END AS s FROM v_jobs),
r AS (SELECT *, row_number() OVER (PARTITION BY path, s ORDER BY created_at DESC, job_id) AS r FROM j)
SELECT job_id, s AS status FROM r WHERE s <> 'pending' OR r = 1""")
def stale_jobs(spark, sf):
    j = views.jobs(spark, sf).withColumn("status", F.when(F.col("status") == "running", "processing").otherwise(F.col("status")))
    return jobs.clean_stale(j, now(), 864000).select("job_id", "status")


@query(f"""WITH {views.JOBS}, k AS (SELECT DISTINCT key FROM v_jobs UNION SELECT 'order-' || o_orderkey FROM orders), b AS (SELECT DISTINCT key FROM v_jobs WHERE job_type = 'type-1' AND status IN ('pending', 'running'))
SELECT key, 'pending' AS status FROM k WHERE key NOT IN (SELECT key FROM b)""")
def enqueue_jobs(spark, sf):
    j = views.jobs(spark, sf)
    keys = j.select("key").union(table(spark, sf, "orders").select(F.concat(F.lit("order-"), "o_orderkey")))
    return jobs.enqueue(keys, j, "type-1", now(), block_done=False).select("key", "status")


@query(f"""WITH {views.JOBS}, i AS (SELECT 'job:' || event_id AS job_id FROM events UNION ALL SELECT 'gone:' || event_id FROM events WHERE event_id % 7 = 0), x AS (SELECT i.job_id, status FROM i LEFT JOIN v_jobs USING (job_id))
SELECT count(*) FILTER (status IN ('done', 'failed')) AS deleted, count(*) FILTER (status IN ('pending', 'running')) AS skipped_active, count(*) FILTER (status IS NULL) AS skipped_missing FROM x""")
def delete_missing_counts(spark, sf):
    """Every job is asked to go, and some that do not exist."""
    e = table(spark, sf, "events")
    ids = e.select(F.concat(F.lit("job:"), "event_id").alias("job_id")).union(e.where("event_id % 7 = 0").select(F.concat(F.lit("gone:"), "event_id")))
    return jobs.deletion_counts(ids, views.jobs(spark, sf))


@query(f"""WITH {views.JOBS}, a AS (SELECT status, CAST(greatest(0, floor((epoch(TIMESTAMP '{NOW}') - floor(epoch(updated_at))) / 60)) AS BIGINT) AS age FROM v_jobs)
SELECT status, count(*) AS jobs, max(age) AS oldest_minutes, count(*) FILTER (age >= 1440 AND status = 'running') AS stale FROM a GROUP BY status""")
def queue_report(spark, sf):
    return jobs.queue_report(views.jobs(spark, sf), now(), 1440)


# -- tables --------------------------------------------------------------------------------------------------------


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def upsert_last_wins(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return store.last_wins(e, ["user_id"], "event_id")


@query("""WITH old AS (SELECT user_id, min(event_id) AS value FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id), new AS (SELECT user_id, max(event_id) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id)
SELECT coalesce(new.user_id, old.user_id) AS user_id, coalesce(new.value, old.value) AS value, CASE WHEN old.user_id IS NOT NULL THEN '2024-01-01' ELSE '2024-01-31' END AS created, CASE WHEN new.user_id IS NOT NULL THEN '2024-01-31' ELSE '2024-01-01' END AS updated
FROM old FULL JOIN new USING (user_id)""")
def upsert_keep_column(spark, sf):
    e = table(spark, sf, "events")
    first = F.lit("2024-01-01").cast("timestamp")
    old = e.where("ts < TIMESTAMP '2024-01-15 00:00:00'").groupBy("user_id").agg(F.min("event_id").alias("value")).withColumn("created_at", first).withColumn("updated_at", first)
    new = e.where("ts >= TIMESTAMP '2024-01-15 00:00:00'").groupBy("user_id").agg(F.max("event_id").alias("value"))
    out = store.merged(old, new, ["user_id"], now())
    return out.select("user_id", "value", F.date_format("created_at", "yyyy-MM-dd").alias("created"), F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


@query(f"""WITH {views.BLOCKS}, gone AS (SELECT block_id FROM v_blocks WHERE order_index = 1), e AS (SELECT block_id, parent_id FROM v_blocks WHERE parent_id IS NOT NULL)
SELECT 'block' AS result, block_id || '|' || block_type AS row FROM v_blocks WHERE order_index <> 1
UNION ALL SELECT 'embedding', block_id || '|' || order_index FROM v_blocks WHERE order_index <> 1 AND order_index % 2 = 1
UNION ALL SELECT 'relation', block_id || '|' || parent_id FROM e WHERE block_id NOT IN (SELECT block_id FROM gone) AND parent_id NOT IN (SELECT block_id FROM gone)""")
def cascade_delete(spark, sf):
    """Second turns go, with their vectors (odd turns have one) and relations."""
    b = views.blocks(spark, sf)
    left, vectors_, relations = store.cascade(b, b.where("order_index % 2 = 1").select("block_id", "order_index"), graph.block_graph(b)[1], b.where("order_index = 1").select("block_id"))
    return _together(block=left.select("block_id", "block_type"), embedding=vectors_.select("block_id", "order_index"), relation=relations.select("src_id", "dst_id"))


# -- artifacts -----------------------------------------------------------------------------------------------------


def _usable(least: int) -> str:
    return f"""{views.BLOCKS}, u AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY order_index, block_id) AS n FROM (SELECT *, title AS label, trim(regexp_replace(content, '\\s+', ' ', 'g')) AS t FROM v_blocks WHERE len(trim(content)) >= {least}))"""


def _cut(n: int) -> str:
    return f"CASE WHEN len(t) <= {n} THEN t ELSE rtrim(substr(t, 1, {n - 1})) || '…' END"


@query(f"WITH {_usable(20)} SELECT source_id, 'card_' || n AS card_id, label AS front, {_cut(260)} AS back, block_id FROM u WHERE n <= 12")
def artifact_flashcards(spark, sf):
    return artifacts.flashcards(views.blocks(spark, sf))


@query(f"WITH {_usable(20)} SELECT source_id, n AS section, label AS title, {_cut(220)} AS summary, block_id FROM u WHERE n <= 6")
def artifact_summary(spark, sf):
    return artifacts.summary_note(views.blocks(spark, sf))


@query(f"WITH {_usable(12)}, f AS (SELECT *, count(*) OVER (PARTITION BY source_id, label) AS frequency FROM u) SELECT source_id, n AS entry, label AS term, {_cut(200)} AS definition, frequency, block_id FROM f WHERE n <= 12")
def artifact_glossary(spark, sf):
    return artifacts.glossary(views.blocks(spark, sf))


@query(f"WITH {_usable(20)} SELECT source_id, n AS item, label AS topic, {_cut(180)} AS focus, 'Erkläre ' || label || ' in eigenen Worten.' AS prompt, block_id FROM u WHERE n <= 8")
def artifact_study_guide(spark, sf):
    return artifacts.study_guide(views.blocks(spark, sf))


@query(f"""WITH {_usable(40)}, p AS (SELECT source_id, label, min(n) AS first FROM u GROUP BY 1, 2), q AS (SELECT source_id, list(label ORDER BY first)[1:4] AS pool FROM p GROUP BY 1)
SELECT source_id, 'q_' || n AS question_id, {_cut(180)} AS question, array_to_string(list_concat([label], list_filter(pool, lambda x: x <> label)[1:3]), '|') AS options, block_id FROM u JOIN q USING (source_id) WHERE n <= 8""")
def artifact_quiz(spark, sf):
    return artifacts.quiz(views.blocks(spark, sf)).select("source_id", "question_id", "question", F.array_join("options", "|").alias("options"), "block_id")


# -- documents -----------------------------------------------------------------------------------------------------


@query(f"""WITH l AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, string_agg(trim(line), ' ' ORDER BY i) AS content FROM l GROUP BY doc_id),
b AS (
  SELECT 'doc-' || doc_id || '.md' AS path, 'heading' AS block_type, source AS content, 0 AS order_index FROM documents
  UNION ALL SELECT 'doc-' || doc_id || '.md', 'paragraph', content, 1 FROM p
  UNION ALL SELECT 'doc-' || doc_id || '.md', 'list_item', lang, 2 FROM documents),
h AS (SELECT *, substr(sha256(path || ':' || block_type || ':' || content || ':' || order_index), 1, 16) AS block_id FROM b)
SELECT h.path, h.block_type, h.block_id, p.block_id AS parent_id, p.content AS heading_path, CAST(h.order_index AS BIGINT) AS order_index
FROM h JOIN h p ON p.path = h.path AND p.order_index = 0 WHERE h.order_index > 0
UNION ALL SELECT path, block_type, block_id, NULL, content, 0 FROM h WHERE order_index = 0""")
def markdown_blocks(spark, sf):
    return blocks.parse_markdown(views.markdown(spark, sf)).select("path", "block_type", "block_id", "parent_id", "heading_path", "order_index")


@query("""SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS domain, count(DISTINCT page_id) AS sources, count(DISTINCT page_id) AS records, count(DISTINCT CASE WHEN page_id % 3 = 0 THEN page_id END) AS artifacts FROM pages WHERE regexp_extract(url, '^https?://([^/:?#]+)', 1) <> '' GROUP BY 1""")
def domain_summary(spark, sf):
    p = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("domain"), F.col("page_id").alias("source_id")).where("domain != ''")
    return domains.summary(p, p.select("source_id").distinct(), p.where("source_id % 3 = 0").select("source_id").distinct())


@query("""SELECT page_id FROM pages WHERE contains(url, '/en/') OR starts_with(url, 'https://www.example.org/') OR starts_with(url, 'http://theouc.example.com/') OR page_id % 50 = 3""")
def domain_sources(spark, sf):
    named = F.when(F.col("page_id") % 50 == 3, "en").otherwise("none")
    return table(spark, sf, "pages").where(domains.in_domain(F.col("url"), "en", ["https://www.example.org", "http://theouc.example.com"], named)).select("page_id")


#: Documents made of parts: those of a brand among 400 parts that follow each other, so that none grows with the table.
_SHARE = "p_brand || '/' || (p_partkey // 400)"


def _share():
    return F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 400))


def _concepts(spark, sf) -> DataFrame:
    """Parts as JSON-LD concepts of documents."""
    p = table(spark, sf, "part")
    node = F.struct(F.concat(F.lit("part/"), "p_partkey").alias("@id"), F.col("p_name").alias("label"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("comment"), F.struct(F.concat(F.lit("part/"), (F.col("p_partkey") + 25)).alias("@id")).alias("next"))
    return ontology.parse(p.groupBy(_share().alias("path")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("p_partkey", node.alias("n")))).getField("n").alias("@graph"))).alias("text")))


@query(f"""SELECT {_SHARE} AS path, 'part/' || p_partkey AS concept_id, CAST(2 + CASE WHEN len(p_name || ' ' || p_type || ' ' || p_brand) >= 60 THEN 2 WHEN len(p_name || ' ' || p_type || ' ' || p_brand) >= 20 THEN 1 ELSE 0 END + 1 AS BIGINT) AS quality FROM part""")
def ontology_quality(spark, sf):
    return ontology.ranked(_concepts(spark, sf)).select("path", "concept_id", "quality")


@query(f"""WITH c AS (SELECT {_SHARE} AS path, 'part/' || p_partkey AS concept_id, CASE WHEN len(p_name || ' ' || p_type || ' ' || p_brand) >= 20 THEN 1 ELSE 0 END AS q, contains(lower(p_name), 'ring') AS f, p_partkey FROM part),
r AS (SELECT path, concept_id, row_number() OVER (PARTITION BY path ORDER BY f DESC, q DESC, p_partkey) AS rank FROM c)
SELECT path, concept_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def ontology_select(spark, sf):
    return ontology.select(_concepts(spark, sf), ["ring"], 10).select("path", "concept_id", "rank")


def _modules(spark, sf) -> DataFrame:
    """Conversations as quiz modules: every turn is a question."""
    c = table(spark, sf, "conversations").dropDuplicates(["conv_id", "turn"]).withColumn("text", F.coalesce("text", F.lit("")))
    q = F.struct(F.concat(F.lit("q"), "turn").alias("id"), F.col("text").alias("question"), F.array(F.struct(F.lit("A").alias("id"), F.lit("yes").alias("text")), F.struct(F.lit("B").alias("id"), F.lit("no").alias("text"))).alias("options"), F.when(F.col("turn") % 4 == 0, "A").otherwise("B").alias("correct_option_id"))
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", q.alias("q")))).getField("q").alias("questions"))
    text = F.to_json(F.struct(F.struct(F.concat(F.lit("m"), "conv_id").alias("id"), F.concat(F.lit("Module "), "conv_id").alias("title"), "questions").alias("quiz")))
    return quiz.normalise(docs.select(text.alias("json")))


@query("""WITH u AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, coalesce(text, '') AS text FROM conversations)
SELECT DISTINCT 'quiz:m' || conv_id || ':module' AS block_id, 'quiz_module' AS block_type, 'Module ' || conv_id AS content FROM u
UNION ALL SELECT 'quiz:m' || conv_id || ':question:q' || turn, 'quiz_question', text FROM u
UNION ALL SELECT 'quiz:m' || conv_id || ':question:q' || turn || ':option:A', 'quiz_option', 'yes' FROM u
UNION ALL SELECT 'quiz:m' || conv_id || ':question:q' || turn || ':option:B', 'quiz_option', 'no' FROM u""")
def quiz_records(spark, sf):
    return quiz.records(_modules(spark, sf)).select("block_id", "block_type", "content")


@query("""WITH u AS (SELECT 'quiz:m' || conv_id || ':module' AS m, 'quiz:m' || conv_id || ':question:q' || turn AS q, turn FROM (SELECT DISTINCT conv_id, turn FROM conversations))
SELECT m AS src_id, q AS dst_id, 'contains' AS relation FROM u UNION ALL SELECT q, q || ':option:A', 'has_option' FROM u UNION ALL SELECT q, q || ':option:B', 'has_option' FROM u
UNION ALL SELECT q, q || ':option:' || CASE WHEN turn % 4 = 0 THEN 'A' ELSE 'B' END, 'correct_option' FROM u""")
def quiz_relations(spark, sf):
    return quiz.relations(_modules(spark, sf)).select("src_id", "dst_id", "relation")


_HITS = f"""{views.DOCS},
hits AS (SELECT *, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (SELECT *, {_SCORE} AS score FROM v_docs WHERE {_HIT} ORDER BY score DESC, key LIMIT 8))"""


def _hits(spark, sf) -> DataFrame:
    return search.lexical_search(views.docs(spark, sf), SEARCH_QUERY, 8).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "key")))


@query(f"""WITH {_HITS}, c AS (SELECT rank, key, summary, trim(regexp_replace(full_text, '\\s+', ' ', 'g')) AS t FROM hits),
b AS (SELECT rank, key, '- ' || key || ': ' || summary || chr(10) || '  ' || CASE WHEN len(t) <= 400 THEN t ELSE rtrim(substr(t, 1, 399), ' ') || '…' END AS block FROM c)
SELECT 'Question: What is asked?' || chr(10) || chr(10) || 'Context:' || chr(10) || string_agg(block, chr(10) ORDER BY rank, key) AS prompt FROM b""")
def rag_context(spark, sf):
    return search.context_prompt("What is asked?", _hits(spark, sf))


@query(f"""WITH {views.ISSUES},
hits AS (SELECT key, row_number() OVER (ORDER BY score DESC, updated_at DESC, key) AS rank FROM (
  SELECT *, CASE WHEN contains(lower(summary), 'widget') THEN 4 ELSE 0 END + CASE WHEN contains(lower(description), 'widget') THEN 2 ELSE 0 END + CASE WHEN contains(lower(full_text), 'widget') THEN 1 ELSE 0 END AS score
  FROM v_issues WHERE contains(lower(full_text), 'widget')) ORDER BY rank LIMIT 3),
ls AS (SELECT DISTINCT key, lower(l) AS l FROM (SELECT key, unnest(labels) AS l FROM v_issues)),
e AS (SELECT a.key AS seed, b.key AS key, count(*) AS weight FROM ls a JOIN ls b USING (l) WHERE a.key IN (SELECT key FROM hits) AND a.key <> b.key GROUP BY 1, 2),
r AS (SELECT e.key, hits.rank, row_number() OVER (PARTITION BY seed ORDER BY weight DESC, 'issue:' || e.key) AS r FROM e JOIN hits ON hits.key = e.seed),
n AS (SELECT key, min(rank * 100 + r) AS place FROM r WHERE r <= 3 AND key NOT IN (SELECT key FROM hits) GROUP BY key ORDER BY place, key LIMIT 8),
f AS (SELECT v.key, updated_at, count(*) AS score FROM v_issues v, n WHERE contains(lower(v.key || ' ' || full_text), lower(n.key)) GROUP BY v.key, updated_at),
g AS (SELECT key FROM (SELECT * FROM f ORDER BY score DESC, updated_at DESC, key LIMIT 4) WHERE key NOT IN (SELECT key FROM hits))
SELECT key, '' AS mark FROM hits UNION ALL SELECT key, '[graph]' FROM g""")
def graph_context(spark, sf):
    """What an assistant is shown: hits, and what the graph adds to them."""
    i = views.issues(spark, sf)
    hits = search.lexical_search(i, "widget", 3)
    hits = hits.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc_nulls_last("updated_at"), "key")))
    more = search.graph_context(i, hits)
    return hits.select("key", F.lit("").alias("mark")).unionByName(more.select("key", F.lit("[graph]").alias("mark")))


@query(f"""WITH {views.ISSUES} SELECT key || ':summary' AS block_id, 'issue_summary' AS block_type, summary AS content, key AS path, CAST(0 AS BIGINT) AS order_index FROM v_issues
UNION ALL SELECT key || ':description', 'issue_description', description, key || ' / description', 1 FROM v_issues WHERE description <> ''""")
def issue_records(spark, sf):
    return blocks.of_issues(views.issues(spark, sf)).select("block_id", "block_type", "content", "path", "order_index")


@query("""SELECT doc_id AS record_id, substr(trim(text), 1, 1200) AS content FROM documents WHERE doc_id % 2 = 0 AND len(trim(text)) >= 40""")
def linkable_records(spark, sf):
    kind = F.when(F.col("doc_id") % 2 == 0, "paragraph").otherwise("image")
    return terms.linkable(table(spark, sf, "documents").select(F.col("doc_id").alias("block_id"), kind.alias("block_type"), F.col("text").alias("content")))


@query(f"""WITH {_LABELS}, rw AS (SELECT DISTINCT doc_id AS record_id, unnest(string_split({_CANON.format('text')}, ' ')) AS w FROM documents),
tw AS (SELECT DISTINCT normalized_label, unnest(string_split(normalized_label, ' ')) AS w FROM lt),
h AS (SELECT record_id, normalized_label, count(*) AS overlap FROM rw JOIN tw USING (w) WHERE len(w) >= 4 GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY overlap DESC, normalized_label DESC) AS r FROM h) WHERE r <= 12),
f AS (SELECT normalized_label FROM (SELECT DISTINCT normalized_label FROM lt) ORDER BY normalized_label LIMIT 12)
SELECT record_id, normalized_label, overlap FROM b UNION ALL SELECT doc_id, normalized_label, 0 FROM documents, f WHERE doc_id NOT IN (SELECT record_id FROM h)""")
def record_best_labels(spark, sf):
    records = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("content"))
    return terms.candidate_labels(records, _label_terms_table(spark, sf), 12, fallback=True)


@query("""SELECT 'quiz:m' || conv_id AS source_id, CAST(0 AS INTEGER) AS sections, CAST(count(DISTINCT turn) AS INTEGER) AS questions, CAST(2 * count(DISTINCT turn) AS INTEGER) AS options, CAST(1 + 3 * count(DISTINCT turn) AS INTEGER) AS records FROM conversations GROUP BY conv_id""")
def quiz_counts(spark, sf):
    return quiz.counts(_modules(spark, sf))


# -- listings ------------------------------------------------------------------------------------------------------


@query(f"""WITH {views.ISSUES} SELECT key, updated_at FROM v_issues ORDER BY updated_at DESC, key LIMIT 50""")
def recent_issues(spark, sf):
    return listings.recent_issues(views.issues(spark, sf), 50).select("key", "updated_at")


@query("""SELECT user_id AS term_id, 'user ' || user_id AS canonical_label FROM events GROUP BY user_id ORDER BY max(ts) DESC, 'user ' || user_id, user_id LIMIT 25""")
def term_listing(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("user_id").alias("term_id")).agg(F.max("ts").alias("updated_at"))
    t = t.withColumn("canonical_label", F.concat(F.lit("user "), "term_id")).withColumn("status", F.lit("new"))
    return listings.terms(t, "new", 25).select("term_id", "canonical_label")


@query(f"""WITH {views.JOBS} SELECT job_id, key FROM v_jobs WHERE status = 'pending' AND job_type = 'type-1' ORDER BY updated_at DESC, job_id LIMIT 40""")
def job_listing(spark, sf):
    return listings.jobs(views.jobs(spark, sf), "pending", "type-1", 40).select("job_id", "key")


_LINKS = """l AS (
  SELECT user_id AS record_id, event_type AS term_id, CASE WHEN event_id % 2 = 0 THEN 'llm' ELSE 'semantic' END AS source,
         max({'c': least(1.0, greatest(0.0, value / 100)), 'e': props}) AS x, max(ts) AS updated_at FROM events GROUP BY 1, 2, 3)"""


def _link_rows(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    made = e.select(F.col("user_id").alias("record_id"), F.col("event_type").alias("term_id"), F.when(F.col("event_id") % 2 == 0, " LLM").otherwise(" ").alias("source"), (F.col("value") / 100).alias("confidence"), F.col("props").alias("evidence"))
    return terms.link_rows(made, now())


@query(f"""WITH {_LINKS} SELECT 'link:' || substr(sha1(record_id || ':' || term_id || ':' || source), 1, 24) AS link_id, record_id, term_id, source, round(x.c + 1e-9, 6) AS confidence, x.e AS evidence FROM l""")
def record_link_store(spark, sf):
    return _link_rows(spark, sf).select("link_id", "record_id", "term_id", "source", values.stable(F.col("confidence")).alias("confidence"), "evidence")


@query(f"""WITH {_LINKS} SELECT 'link:' || substr(sha1(record_id || ':' || term_id || ':' || source), 1, 24) AS link_id, CASE WHEN term_id = 'view' THEN 'seen' ELSE term_id END AS term_label FROM l WHERE record_id = 7 ORDER BY x.c DESC, link_id LIMIT 5""")
def record_link_listing(spark, sf):
    labels = spark.createDataFrame([("view", "seen")], "term_id string, canonical_label string")
    return listings.record_links(_link_rows(spark, sf), labels, 7, 5).select("link_id", "term_label")


@query("SELECT 'm' || (label % 3) AS embedding_model, label AS kind, count(*) AS vectors FROM embeddings GROUP BY 1, 2")
def embedding_counts(spark, sf):
    e = table(spark, sf, "embeddings").select(F.concat(F.lit("m"), F.col("label") % 3).alias("embedding_model"), F.col("label").alias("kind"))
    return listings.embedding_counts(e, "kind")


_EXCLUDED = """x AS (
  SELECT trim(regexp_replace(replace(replace(lower(trim(n)), '_', ' '), '-', ' '), '\\s+', ' ', 'g')) AS normalized_term, arg_max({'d': trim(n), 'k': k}, seq) AS x
  FROM (SELECT p_type || '_Item' AS n, CASE WHEN p_size % 2 = 0 THEN 'noise' ELSE 'exception' END AS k, p_partkey AS seq FROM part
        UNION ALL SELECT ' ' || p_name, 'exception', p_partkey FROM part WHERE p_size > 45) GROUP BY 1)"""


def _excluded(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    named = p.select("p_partkey", F.concat("p_type", F.lit("_Item")).alias("display_term"), F.when(F.col("p_size") % 2 == 0, "noise").alias("kind"))
    large = p.where("p_size > 45").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("display_term"), F.lit(None).cast("string").alias("kind"))
    return listings.exclusion_rows(named.unionByName(large), now(), "p_partkey")


@query(f"""WITH {_EXCLUDED} SELECT normalized_term, x.d AS display_term, x.k AS kind FROM x WHERE x.k = 'exception'""")
def stored_exclusions(spark, sf):
    return listings.exclusions(_excluded(spark, sf), "exception").select("normalized_term", "display_term", "kind")


@query(f"""WITH {_EXCLUDED} SELECT DISTINCT p_name AS term FROM part WHERE lower(p_name) NOT IN (SELECT normalized_term FROM x)""")
def terms_without_excluded(spark, sf):
    found = table(spark, sf, "part").select(F.col("p_name").alias("term")).distinct()
    return listings.without_excluded(found, _excluded(spark, sf))


@query(f"""WITH {views.BLOCKS} SELECT block_id FROM v_blocks WHERE source_id IN (SELECT 'c' || conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 4)""")
def blocks_of_domain(spark, sf):
    allowed = table(spark, sf, "conversations").groupBy("conv_id").count().where("count > 4").select(F.concat(F.lit("c"), "conv_id").alias("source_id"))
    return listings.of_sources(views.blocks(spark, sf), allowed).select("block_id")


@query(f"""WITH {views.BLOCKS}, gone AS (SELECT block_id FROM v_blocks WHERE substr(source_id, 2)::BIGINT % 3 = 0)
SELECT 'blocks' AS name, count(*) AS deleted FROM gone UNION ALL SELECT 'embeddings', count(*) FROM gone
UNION ALL SELECT 'relations', count(*) FROM v_blocks WHERE parent_id IS NOT NULL AND (block_id IN (FROM gone) OR parent_id IN (FROM gone))""")
def domain_reset(spark, sf):
    b = views.blocks(spark, sf)
    gone = b.where("cast(substring(source_id, 2) as bigint) % 3 = 0").select("source_id")
    relations = b.where("parent_id IS NOT NULL").select(F.col("block_id").alias("src_id"), F.col("parent_id").alias("dst_id"))
    return domains.reset(gone, {"blocks": b, "embeddings": b.select("block_id"), "relations": relations})[1]


@query(f"""WITH {_GAPS}, p AS (SELECT *, CASE WHEN needs_definition THEN 5.0 ELSE 0 END + CASE WHEN needs_facts THEN 3.0 ELSE 0 END + CASE WHEN needs_relations THEN 2.0 ELSE 0 END + greatest(0.0, 0.1 - avg_confidence) AS p FROM g WHERE needs_definition OR needs_facts OR needs_relations),
top AS (SELECT term_id FROM p ORDER BY p DESC, fact_count, term_id LIMIT 30)
SELECT 'user-' || term_id AS key, 'pending' AS status FROM top WHERE term_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING arg_max(event_type, {{'t': ts, 'e': event_id}}) <> 'signup')""")
def gap_jobs(spark, sf):
    top = terms.term_gaps(*_store(spark, sf), limit=30, **_LEAST).withColumn("term_id", F.concat(F.lit("user-"), "term_id"))
    # the job of a term is in the state that its last event left
    last = F.max_by("status", F.struct("updated_at", F.substring("job_id", 5, 20).cast("long"))).alias("status")
    old = views.jobs(spark, sf).groupBy("key").agg(last).withColumn("job_type", F.lit("refine"))
    return jobs.enqueue_gaps(top, old, now()).select("key", "status")


@query("""WITH j AS (SELECT doc_id, '/in/' || doc_id || '.pdf' AS pdf_path, source AS domain, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'done' ELSE 'processing' END END AS was, doc_id % 9 AS pages FROM documents),
c AS (SELECT *, CASE WHEN was = 'processing' THEN was ELSE 'pending' END AS made FROM j),
t AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN 'processing' ELSE made END AS began FROM c)
SELECT 'pdf_' || substr(sha1(domain || ':' || pdf_path), 1, 16) AS job_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 AND pages > 2 THEN 'failed' WHEN doc_id % 4 = 0 AND pages > 0 THEN 'done' ELSE began END AS status,
CASE WHEN doc_id % 8 = 0 AND pages > 2 THEN 'page 2' END AS error_message, CAST(CASE WHEN was = 'processing' THEN 0 ELSE pages END AS INTEGER) AS pages_total FROM t""")
def pdf_job_states(spark, sf):
    """Files are asked for, some again; every fourth job runs, and some of these fail at their second page."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/in/"), "doc_id", F.lit(".pdf")).alias("pdf_path"), F.col("source").alias("domain"), (F.col("doc_id") % 9).cast("int").alias("pages_total"))
    d = d.withColumn("job_id", pdf_jobs.job_id(F.col("domain"), F.col("pdf_path")))
    empty = spark.createDataFrame([], pdf_jobs.SCHEMA)
    old = pdf_jobs.create(d.where("doc_id % 3 = 0").withColumn("pages_total", F.lit(0)), empty, now())
    old = pdf_jobs.complete(pdf_jobs.start(old, d.where("doc_id % 3 = 0"), now()), d.where("doc_id % 6 = 0"), now())
    made = pdf_jobs.create(d, old, now())
    run = d.where("doc_id % 4 = 0")
    pages = run.where("pages_total > 0").select("job_id", "doc_id", F.explode(F.sequence(F.lit(1), "pages_total")).alias("page"))
    pages = pages.select("job_id", "page", F.lit("text").alias("text"), F.when((F.col("doc_id") % 8 == 0) & (F.col("page") == 2) & (F.col("doc_id") % 9 > 2), "page 2").alias("error"))
    return pdf_jobs.process(pdf_jobs.start(made, run, now()), pages, now()).select("job_id", "status", "error_message", "pages_total")


@query(f"""WITH {_GAPS}, {views.JOBS}, p AS (SELECT *, CASE WHEN needs_definition THEN 5.0 ELSE 0 END + CASE WHEN needs_facts THEN 3.0 ELSE 0 END + CASE WHEN needs_relations THEN 2.0 ELSE 0 END + greatest(0.0, 0.1 - avg_confidence) AS p FROM g WHERE needs_definition OR needs_facts OR needs_relations),
top AS (SELECT term_id, p, row_number() OVER (ORDER BY p DESC, fact_count, term_id) AS r FROM p),
new AS (SELECT job_id, row_number() OVER (ORDER BY updated_at DESC, job_id) AS r FROM v_jobs),
o AS (
  SELECT 'total' AS section, 'terms' AS name, count(*) AS value, 0 AS rank FROM v_terms UNION ALL SELECT 'total', 'facts', count(*), 0 FROM v_facts UNION ALL SELECT 'total', 'relations', count(*), 0 FROM v_rel
  UNION ALL SELECT 'total', 'candidates', count(*), 0 FROM part UNION ALL SELECT 'total', 'record_links', count(*), 0 FROM nation UNION ALL SELECT 'terms', 'new', count(*), 0 FROM v_terms
  UNION ALL SELECT 'jobs', status, count(*), 0 FROM v_jobs GROUP BY status UNION ALL SELECT 'job_types', job_type || '/' || status, count(*), 0 FROM v_jobs GROUP BY job_type, status
  UNION ALL SELECT 'gaps', 'needs_definition', count(*) FILTER (needs_definition), 0 FROM g UNION ALL SELECT 'gaps', 'needs_facts', count(*) FILTER (needs_facts), 0 FROM g
  UNION ALL SELECT 'gaps', 'needs_relations', count(*) FILTER (needs_relations), 0 FROM g UNION ALL SELECT 'gaps', 'total_gaps', count(*) FILTER (needs_definition OR needs_facts OR needs_relations), 0 FROM g
  UNION ALL SELECT 'top_gaps', CAST(term_id AS VARCHAR), p, r FROM top WHERE r <= 8 UNION ALL SELECT 'recent_jobs', job_id, 1, r FROM new WHERE r <= 12)
SELECT section, name, round(CAST(value AS DOUBLE) + 1e-9, 6) AS value, CAST(rank AS INTEGER) AS rank FROM o""")
def monitoring_snapshot(spark, sf):
    rows = terms.snapshot(*_store(spark, sf), views.jobs(spark, sf), table(spark, sf, "part"), table(spark, sf, "nation"), **_LEAST)
    return rows.withColumn("value", values.stable(F.col("value")))


@query(r"""WITH t AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages), n AS (SELECT page_id, list_last(string_split(rtrim(regexp_replace(u, '^[a-z]+://[^/]*', ''), '/'), '/')) AS f, regexp_extract(u, '^[a-z]+://([^/]*)', 1) AS h FROM t),
c AS (SELECT page_id, trim(regexp_replace(CASE WHEN f = '' THEN h ELSE f END, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS title, trim(regexp_replace(CASE WHEN contains(f[2:], '.') THEN regexp_replace(f, '\.[^.]+$', '') ELSE f END, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS slug FROM n)
SELECT page_id, CASE WHEN title = '' THEN 'ontology_html' ELSE title END AS title, CASE WHEN slug = '' THEN 'ontology' ELSE slug END AS slug FROM c""")
def url_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.url_title(F.col("url"), "html").alias("title"), tx.url_slug(F.col("url")).alias("slug"))


@query("""SELECT p_brand AS path, 'part/' || p_partkey AS src_id, 'part/' || (p_partkey + 25) AS dst_id FROM part p WHERE EXISTS (SELECT 1 FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey = p.p_partkey + 25)""")
def concept_graph(spark, sf):
    """The concepts of a brand are one graph, also across the documents that hold them."""
    brands = _concepts(spark, sf).withColumn("path", F.substring_index("path", "/", 1))
    return ontology.concept_graph(brands)[1].select("path", "src_id", "dst_id")


def _checklists(spark, sf) -> DataFrame:
    """Parts as items of checklists, under two templates."""
    p = table(spark, sf, "part")
    mark = F.when(F.col("p_size") % 3 == 0, "x").otherwise(" ")
    body = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" :: ", "p_type", "p_name")).otherwise(F.col("p_name"))
    item = F.concat(F.lit("- ["), mark, F.lit("] "), body)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))), lambda x: x["i"])
    return p.groupBy(_share().alias("path")).agg(F.concat(F.lit("# To do\n"), F.array_join(lines, "\n")).alias("text"))


@query(f"""SELECT {_SHARE} AS path, CAST(row_number() OVER (PARTITION BY {_SHARE} ORDER BY p_partkey) AS INTEGER) AS line_index, p_size % 3 = 0 AS checked,
CASE WHEN p_size % 2 = 0 THEN lower(p_type) ELSE 'default' END AS template, p_name AS question FROM part""")
def prompt_backlog(spark, sf):
    return prompts.backlog(_checklists(spark, sf))


@query(f"""SELECT {_SHARE} AS path, CAST(row_number() OVER (PARTITION BY {_SHARE} ORDER BY p_partkey) AS INTEGER) AS line_index, p_name AS question,
CASE WHEN p_size % 2 = 0 AND p_type = 'ECONOMY' THEN 'Buy ' || p_name || ' for shop' ELSE 'Do ' || p_name END AS prompt FROM part QUALIFY p_size % 3 <> 0""")
def backlog_prompts(spark, sf):
    docs = _checklists(spark, sf)
    text = "## Default\nDo {{question}}\n\n## Economy\nold\n## ECONOMY \n\nBuy {{question}} for {{domain}}\n"
    return prompts.filled(prompts.backlog(docs), prompts.templates(docs.select("path", F.lit(text).alias("text"))), "shop")


@query(f"""WITH {views.ISSUES} SELECT key, 'List every concrete task in this issue, one on each line.' || chr(10) || chr(10) || 'Key: ' || key || chr(10) || 'Type: ' || issue_type || chr(10) || 'Status: ' || status || chr(10) || 'Summary: ' || summary || chr(10) || 'Description: ' || description AS prompt FROM v_issues WHERE description <> ''""")
def issue_task_prompts(spark, sf):
    return prompts.issue_prompts(views.issues(spark, sf), "tasks")


@query("""WITH p AS (SELECT conv_id, turn, '## ' || upper(role[1]) || lower(role[2:]) || chr(10) || chr(10) || coalesce(text, '') AS part FROM conversations)
SELECT 'c' || conv_id AS conv, string_agg(part, chr(10) || chr(10) ORDER BY turn, part) AS markdown FROM p GROUP BY conv_id""")
def transcripts(spark, sf):
    from loregraph.sources.files import transcript

    return transcript(table(spark, sf, "conversations")).select(F.concat(F.lit("c"), "conv_id").alias("conv"), "markdown")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


@query("""WITH RECURSIVE c AS (SELECT DISTINCT user_id AS job_id, CAST(event_id % 2 + 1 AS INTEGER) AS attempt, {'at': CAST(ts AS TIMESTAMP), 'id': 'c' || event_id, 'who': 'w' || (event_id % 5)} AS x FROM events),
g(job_id, attempt, x) AS (
  SELECT job_id, attempt, min(x) FROM c GROUP BY 1, 2
  UNION ALL
  SELECT g.job_id, g.attempt, min(c.x) FROM g JOIN c ON c.job_id = g.job_id AND c.attempt = g.attempt AND c.x['at'] >= g.x['at'] + INTERVAL 12 HOUR GROUP BY g.job_id, g.attempt)
SELECT job_id, attempt, x['who'] AS claimer, x['id'] AS claim_id FROM g""")
def claim_grants(spark, sf):
    """Events as claims of five workers on the jobs of users, with leases of twelve hours."""
    e = table(spark, sf, "events")
    asked = e.select(
        F.col("user_id").alias("job_id"), (F.col("event_id") % 2 + 1).cast("int").alias("attempt"), F.concat(F.lit("w"), F.col("event_id") % 5).alias("claimer"),
        F.col("ts").cast("timestamp").alias("claimed_at"), F.concat(F.lit("c"), "event_id").alias("claim_id"),
    )
    return claims.grants(asked, 12 * 3600).select("job_id", "attempt", "claimer", "claim_id")


@query(f"""SELECT {_SHARE} AS path, 'http://x.org/part' || p_partkey AS concept_id, p_name AS label, p_name || ' "' || p_type || '" ' || p_brand AS definition,
'of->_:,next->http://x.org/part' || (p_partkey + 25) || ',next->http://x.org/part' || (p_partkey + 1) AS relations FROM part""")
def turtle_concepts(spark, sf):
    """Parts as concepts of Turtle documents, with prefixes, a base, long strings, blank nodes and collections."""
    p = table(spark, sf, "part")
    head = "@prefix ex: <http://x.org/> .\nBASE <http://x.org/>\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    part = lambda n: F.concat(F.lit("part"), n)
    key = F.col("p_partkey")
    text = F.concat(
        F.lit("ex:"), part(key), F.lit(' a rdfs:Class ; # of its brand\n  rdfs:label "'), "p_name", F.lit('"@en ; rdfs:comment """'), "p_name", F.lit(' "'), "p_type", F.lit('" '), "p_brand", F.lit('""" ;\n'),
        F.lit('  ex:of [ rdfs:label "inner" ; ex:sizes ( '), F.col("p_size").cast("string"), F.lit(" ex:"), part(key + 1), F.lit(" ( ) ) ] ;\n  ex:next ex:"), part(key + 25), F.lit(" , <"), part(key + 1), F.lit("> .\n"),
    )
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("t")))), lambda x: x["t"]), "")
    found = ontology.parse(p.groupBy(_share().alias("path")).agg(F.concat(F.lit(head), parts).alias("text")))
    # blank nodes are numbered within a document
    shown = F.transform("relations", lambda x: F.concat(x["name"], F.lit("->"), F.regexp_replace(x["target"], "^_:.*$", "_:")))
    return found.select("path", "concept_id", "label", "definition", F.array_join(shown, ",").alias("relations"))


@query("""WITH j AS (SELECT doc_id, source AS domain, doc_id % 4 AS pages, doc_id % 7 = 0 AND doc_id % 4 >= 2 AS bad, 'd' || doc_id || '.pdf' AS file, CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE 'This is a page of the document number ' || doc_id END AS body FROM documents),
s AS (SELECT *, CASE WHEN bad THEN 'page 2' WHEN pages = 0 OR trim(body) = '' THEN 'PDF contains no extractable text' END AS error, pages - CASE WHEN bad THEN 1 ELSE 0 END AS n FROM j)
SELECT 'pdf_' || substr(sha1(domain || ':/in/' || file), 1, 16) AS job_id, CASE WHEN error IS NULL THEN 'done' ELSE 'failed' END AS status, error AS error_message, CAST(n AS INTEGER) AS pages_processed,
CASE WHEN error IS NULL THEN 'pdf:' || domain || '/' || file END AS source_id, CASE WHEN error IS NULL THEN 'artifact:summary_note:pdf:' || domain || '_' || file || ':summary_note' END AS artifact_id,
CASE WHEN error IS NULL THEN array_to_string(list_transform(range(1, pages + 1), lambda k: '## Page ' || k || ' ' || body), ' ') END AS content_preview,
CASE WHEN error IS NULL THEN CAST(2 * pages AS BIGINT) END AS n_blocks FROM s""")
def pdf_imports(spark, sf):
    """Every document is a file of up to three pages whose job waits: clean-up, import, notes."""
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("/in/d"), "doc_id", F.lit(".pdf")).alias("pdf_path"), F.col("source").alias("domain"), (F.col("doc_id") % 4).cast("int").alias("pages_total"))
    d = d.withColumn("job_id", pdf_jobs.job_id(F.col("domain"), F.col("pdf_path")))
    jobs_ = pdf_jobs.create(d, spark.createDataFrame([], pdf_jobs.SCHEMA), now())
    body = F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.concat(F.lit("This is a page  of\nthe document number "), "doc_id"))
    pages = d.where("pages_total > 0").select("job_id", "doc_id", F.explode(F.sequence(F.lit(1), "pages_total")).alias("page"))
    pages = pages.select("job_id", "page", body.alias("text"), F.when((F.col("doc_id") % 7 == 0) & (F.col("page") == 2), "page 2").alias("error"))
    after, made, _, _ = pdf_jobs.process_pending(jobs_, lambda running: pages.join(running.select("job_id"), "job_id", "left_semi"), now())
    n = made.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_blocks"))
    return after.join(n, "source_id", "left").select("job_id", "status", "error_message", "pages_processed", "source_id", "artifact_id", "content_preview", "n_blocks")


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 2),
s AS (SELECT vec_id AS key, 'f' || label AS field_name, c_name AS summary, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])) AS s FROM embeddings JOIN customer ON vec_id = c_custkey, q WHERE label % 2 = 1)
SELECT key, field_name, summary, round(s + 1e-9, 6) AS score FROM s WHERE s > 0 ORDER BY s DESC, key LIMIT 30""")
def field_issue_search(spark, sf):
    """Fields of one kind, of the issues that are known (customers), with their summaries."""
    e = table(spark, sf, "embeddings")
    rows = e.select(
        F.col("vec_id").alias("key"), F.concat(F.lit("f"), "label").alias("field_name"), F.when(F.col("label") % 2 == 1, "comment").otherwise("description").alias("field_kind"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )
    known = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("summary"))
    hits = search.field_search_issues(rows, known, list(rows.where("key = 2").first()["vector"]), "comment", 30)
    return hits.select("key", "field_name", "summary", values.stable(F.col("score")).alias("score"))


@query(f"""WITH f AS (SELECT conv_id || ':' || turn AS key, 'text' AS field_name, text, {tokens_sql('text')} AS tk FROM conversations),
t AS (SELECT key, unnest(tk) AS term, generate_subscripts(tk, 1) AS pos FROM f WHERE len(trim(text)) >= 40),
r AS (SELECT key, term, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, min(pos)) AS r FROM t GROUP BY key, term)
SELECT f.key, coalesce(string_agg(r.term, ',' ORDER BY r.r), '') AS top_terms, substr(trim(any_value(f.text)), 1, 280) AS excerpt FROM f LEFT JOIN r ON f.key = r.key AND r.r <= 6 WHERE len(trim(f.text)) >= 40 GROUP BY f.key""")
def field_top_terms(spark, sf):
    """Turns of conversations as fields of issues, with what is stored beside their vectors."""
    c = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.col("text").alias("description"), F.lit(None).cast("map<string,string>").alias("text_fields"))
    rows = vectors.with_top_terms(vectors.field_rows(c))
    return rows.select("key", F.array_join("top_terms", ",").alias("top_terms"), "excerpt")


@query(f"""WITH {_CHUNKS.replace('FROM v_md)', "FROM (SELECT path, m.text FROM v_md m JOIN documents d ON path = 'doc-' || d.doc_id || '.md' WHERE d.lang = 'en'))")},
md AS (SELECT 'md:' || path AS source_id, regexp_replace(path, '.md$', '') AS title, chunk AS snippet FROM v_chunks),
lines AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
csv AS (SELECT 'jira:/csv/u' || user_id || '.csv' AS source_id, 'u' || user_id AS title, substr('kind: ' || event_type || ' props: ' || props, 1, 500) AS snippet FROM lines WHERE r <= 12),
every AS (SELECT 'md' AS source_type, * FROM md UNION ALL SELECT 'jira', * FROM csv),
scored AS (SELECT *, {_RSCORE} AS score FROM every),
r AS (SELECT source_type, source_id, title, score, snippet, row_number() OVER (ORDER BY score DESC, len(cut) DESC, source_type, source_id, cut) AS r FROM (SELECT *, CASE WHEN source_type = 'jira' THEN substr(snippet, 1, 500) ELSE substr(snippet, 1, 800) END AS cut FROM scored WHERE score > 0))
SELECT source_type, source_id, title, score, CAST(r AS INTEGER) AS rank FROM r WHERE r <= 40""")
def support_search_sources(spark, sf):
    """Markdown, PDF, ontology and CSV passages of two domains; asked for are Markdown and CSV of one, in the order in which they are shown."""
    d = table(spark, sf, "documents")
    texts = views.markdown(spark, sf).join(d.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("path"), F.col("lang").alias("domain")), "path")
    e = table(spark, sf, "events")
    cells = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in (("kind", F.col("event_type")), ("empty", F.lit(" ")), ("props", F.col("props")), ("none", F.lit(None)))])
    rows = search.csv_passages(e.select(F.concat(F.lit("/csv/u"), "user_id", F.lit(".csv")).alias("path"), F.lit("en").alias("domain"), F.col("event_id").alias("line"), cells.alias("cells")))
    every = reduce(DataFrame.unionByName, [search.text_passages(texts, "md"), search.text_passages(texts, "pdf"), search.text_passages(texts, "owl"), rows])
    hits = search.support_search(every, "Enou THER tion", 40, "en", ["Markdown", "csv"])
    order = W.orderBy(F.desc("score"), F.desc(F.length("snippet")), "source_type", "source_id", "snippet")  # 40 rows
    return hits.select("source_type", "source_id", "title", "score", F.row_number().over(order).alias("rank"))


@query(f"""WITH i AS (SELECT {_SHARE} AS path, p_partkey, CASE WHEN p_size % 3 = 0 OR p_size % 5 = 0 THEN 'x' ELSE ' ' END AS mark, CASE WHEN p_size % 2 = 0 THEN p_type || ' :: ' || p_name ELSE p_name END AS body FROM part)
SELECT path, '# To do' || chr(10) || string_agg('- [' || mark || '] ' || body, chr(10) ORDER BY p_partkey) || chr(10) AS text FROM i GROUP BY path""")
def backlog_ticked(spark, sf):
    """Checklists after every fifth size of part was answered."""
    p = table(spark, sf, "part")
    place = F.row_number().over(W.partitionBy(_share()).orderBy("p_partkey"))
    done = p.select("p_size", _share().alias("path"), place.alias("line_index")).where("p_size % 5 = 0")
    return prompts.ticked(_checklists(spark, sf), done.select("path", "line_index"))
