"""The entities of the engine as views over the star schema, for Spark and, as CTEs, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as issues: parts are the words, brands the labels, the customer the assignee."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_name")).alias("names"), F.sort_array(F.collect_set("p_brand")).alias("labels"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(
        F.concat(F.lit("O-"), "o_orderkey").alias("key"), F.col("names")[0].alias("summary"), F.array_join("names", " ").alias("description"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("issue_type"), F.col("c_name").alias("assignee"), "labels", F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("updated_at"), F.col("o_orderkey").alias("seen"),
    )
    return rows.withColumn("full_text", tx.full_text(F.col("summary"), F.col("description"), F.col("labels")))


ISSUES = """
v_lines AS (
  SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS names, list_sort(list(DISTINCT p_brand)) AS labels
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
v_issues AS (
  SELECT 'O-' || o_orderkey AS key, names[1] AS summary, array_to_string(names, ' ') AS description, o_orderstatus AS status, o_orderpriority AS issue_type,
         c_name AS assignee, labels, strftime(o_orderdate, '%Y-%m-%d') AS event_day, strftime(o_orderdate, '%Y-%m-%dT%H:%M') AS updated_at, o_orderkey AS seen,
         trim(names[1] || ' ' || array_to_string(names, ' ') || ' ' || array_to_string(labels, ' ')) AS full_text
  FROM orders JOIN v_lines ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    rows = d.select(
        F.col("doc_id").alias("key"), F.substring("text", 1, 80).alias("summary"), F.col("text").alias("description"), F.array("lang", "source").alias("labels"),
        F.lit(None).cast("string").alias("updated_at"), "lang", "source",
    )
    return rows.withColumn("full_text", tx.full_text(F.col("summary"), F.col("description"), F.col("labels")))


DOCS = """
v_docs AS (
  SELECT doc_id AS key, substr(text, 1, 80) AS summary, text AS description, lang, source,
         trim(substr(text, 1, 80) || ' ' || text || ' ' || lang || ' ' || source) AS full_text
  FROM documents)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues of their days."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("E-"), "event_id").alias("key"), F.date_format("ts", "yyyy-MM-dd").alias("event_day"), F.array("event_type").alias("labels"),
        F.concat_ws(" ", "event_type", "props").alias("full_text"), F.col("event_id").alias("seen"),
    )


EVENTS = """
v_events AS (
  SELECT 'E-' || event_id AS key, strftime(ts, '%Y-%m-%d') AS event_day, event_type, event_type || ' ' || props AS full_text, event_id AS seen FROM events)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as blocks, each one the child of the turn before."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    name = F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn")
    return c.select(
        F.concat(F.lit("c"), "conv_id").alias("source_id"), name.alias("block_id"), F.when(F.col("turn") > 0, F.concat(F.lit("c"), "conv_id", F.lit(":"), F.col("turn") - 1)).alias("parent_id"),
        F.col("role").alias("block_type"), F.concat(F.initcap("role"), F.lit(" "), F.col("turn") % 3).alias("title"), F.lit(None).cast("string").alias("path"),
        F.coalesce("text", F.lit("")).alias("content"), F.col("turn").cast("long").alias("order_index"),
    )


BLOCKS = """
v_blocks AS (
  SELECT DISTINCT ON (conv_id, turn) 'c' || conv_id AS source_id, 'c' || conv_id || ':' || turn AS block_id,
         CASE WHEN turn > 0 THEN 'c' || conv_id || ':' || (turn - 1) END AS parent_id, role AS block_type,
         upper(substr(role, 1, 1)) || substr(role, 2) || ' ' || (turn % 3) AS title, coalesce(text, '') AS content, turn AS order_index
  FROM conversations)"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under a heading, with a list item."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "source", F.lit("\n\n"), "text", F.lit("\n\n- "), "lang").alias("text"))


MARKDOWN = """
v_md AS (SELECT 'doc-' || doc_id || '.md' AS path, '# ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '- ' || lang AS text FROM documents)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as facts of the terms that users stand for; every third supersedes the one before of its kind."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    before = F.lag("event_id").over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return e.select(
        F.col("event_id").alias("fact_id"), F.col("user_id").alias("term_id"), F.when(F.col("event_type") == "signup", "definition").otherwise("short_fact").alias("fact_type"),
        F.least(F.lit(1.0), F.col("value") / 200).alias("confidence"), F.when(F.col("event_id") % 3 == 0, before).alias("supersedes_fact_id"), F.col("ts").alias("created_at"),
    )


def term_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select(
        F.col("user_id").alias("source_term_id"), ((F.col("user_id") * 7 + 1) % 150).alias("target_term_id"), F.lit("related").alias("relation_type"),
        (F.col("event_id") % 10 / 10).alias("weight"), F.col("ts").alias("created_at"), F.col("event_id").alias("relation_id"),
    )


def user_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("term_id")).distinct()
    return e.withColumn("canonical_label", F.concat(F.lit("user "), "term_id")).withColumn("status", F.lit("new"))


FACTS = """
v_facts AS (
  SELECT event_id AS fact_id, user_id AS term_id, CASE WHEN event_type = 'signup' THEN 'definition' ELSE 'short_fact' END AS fact_type, least(1.0, value / 200) AS confidence,
         CASE WHEN event_id % 3 = 0 THEN lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) END AS supersedes_fact_id, ts AS created_at
  FROM events),
v_rel AS (
  SELECT user_id AS source_term_id, (user_id * 7 + 1) % 150 AS target_term_id, (event_id % 10) / 10 AS weight, ts AS created_at, event_id AS relation_id
  FROM events WHERE event_type = 'purchase'),
v_terms AS (SELECT DISTINCT user_id AS term_id, 'user ' || user_id AS canonical_label FROM events),
v_current AS (SELECT * FROM v_facts f WHERE NOT EXISTS (SELECT 1 FROM v_facts n WHERE n.supersedes_fact_id = f.fact_id))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs on the paths that users stand for."""
    e = table(spark, sf_dir, "events")
    status = (
        F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "failed")
        .otherwise("pending")
    )
    return e.select(
        F.concat(F.lit("job:"), "event_id").alias("job_id"), F.concat(F.lit("user-"), "user_id").alias("key"), F.concat(F.lit("type-"), F.col("event_id") % 3).alias("job_type"), status.alias("status"),
        (F.col("event_id") % 6).cast("int").alias("attempts"), F.when(F.col("event_id") % 4 == 0, F.col("ts").cast("timestamp")).alias("next_retry_at"), F.lit(None).cast("string").alias("error_message"),
        F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"), F.col("ts").cast("timestamp").alias("started_at"), F.concat(F.lit("/pdf/"), "user_id").alias("path"),
    )


JOBS = """
v_jobs AS (
  SELECT 'job:' || event_id AS job_id, 'user-' || user_id AS key, 'type-' || (event_id % 3) AS job_type,
         CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'failed' ELSE 'pending' END AS status,
         event_id % 6 AS attempts, CASE WHEN event_id % 4 = 0 THEN ts END AS next_retry_at, ts AS created_at, ts AS updated_at, ts AS started_at, '/pdf/' || user_id AS path
  FROM events)"""
