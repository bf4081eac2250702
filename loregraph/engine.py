"""One entry point over the operators and a warehouse of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loregraph.operators import artifacts, blocks, graph, mining, ontology, quiz, search, terms, vectors
from loregraph.operators.store import Warehouse, settled
from loregraph.sources import files, issues


class Engine:
    """Ingests issues and documents into tables, and answers questions over them with DataFrames."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.tables = spark, Warehouse(spark, root)

    def _now(self):
        return F.current_timestamp()

    # -- ingestion

    def ingest(self, path: str, kind: str = "auto", **options) -> None:
        """Read issues (csv), Markdown, ontologies or quizzes; ``auto`` tells by the end of the path."""
        ends = {".csv": "issues", ".md": "markdown", ".owl": "ontology", ".rdf": "ontology", ".ttl": "ontology", ".jsonld": "ontology", ".json": "quiz"}
        if kind == "auto":
            kind = next((k for end, k in ends.items() if path.lower().endswith(end)), "markdown")
        getattr(self, f"_ingest_{kind}")(path, **options)

    def _ingest_issues(self, path: str, **options) -> None:
        rows = issues.read_csv(self.spark, path, **options)
        self.tables.upsert("issues", rows.dropDuplicates(["key"]).drop("created_at", "updated_at").join(rows.select("key", F.col("updated_at").alias("changed_at"), F.col("created_at").alias("opened_at")).dropDuplicates(["key"]), "key"), ["key"], self._now())

    def _ingest_markdown(self, path: str, types: list[str] | None = None) -> None:
        rows = blocks.only_types(blocks.parse_markdown(files.read_markdown(self.spark, path)), types)
        rows = rows.withColumn("source_id", F.concat(F.lit("markdown:"), "path")).withColumn("title", F.substring_index("heading_path", " / ", -1))
        self._replace_sources("blocks", rows)

    def _ingest_ontology(self, path: str, focus: list[str] | None = None, top_n: int = 50) -> None:
        chosen = ontology.select(ontology.parse(files.read_ontologies(self.spark, path)), focus, top_n)
        rows = ontology.records(chosen).select("*", F.col("source_id").alias("path"), F.lit(None).cast("string").alias("parent_id"), F.col("title").alias("heading_path"))
        self._replace_sources("blocks", rows.withColumn("order_index", F.col("order_index").cast("long")))
        self.tables.upsert("relations", ontology.relations(chosen).drop("path").withColumn("weight", F.lit(1.0)), ["src_id", "dst_id", "relation"], self._now())

    def _ingest_quiz(self, path: str) -> None:
        modules = quiz.normalise(files.read_json(self.spark, path).withColumnRenamed("text", "json"))
        rows = quiz.records(modules).select("*", F.col("source_id").alias("path"), F.lit(None).cast("string").alias("parent_id"), F.col("title").alias("heading_path"), F.lit(0).cast("long").alias("order_index"))
        self._replace_sources("blocks", rows)
        self.tables.upsert("relations", quiz.relations(modules), ["src_id", "dst_id", "relation"], self._now())

    def _replace_sources(self, name: str, rows: DataFrame) -> None:
        """Blocks of a source that is read again take the place of its old ones."""
        if self.tables.exists(name):
            old = self.tables.read(name).join(rows.select("source_id").distinct(), "source_id", "left_anti")
            self.tables.write(name, old.unionByName(rows, allowMissingColumns=True), ["source_id"])
        else:
            self.tables.write(name, rows, ["source_id"])

    # -- questions

    def issues(self) -> DataFrame:
        rows = self.tables.read("issues")
        return rows.withColumn("updated_at", F.col("changed_at")).withColumn("seen", F.col("key"))  # issues are listed by key

    def search(self, query: str, limit: int = 8, hybrid: bool = False) -> DataFrame:
        found = self.issues()
        if not hybrid:
            return search.lexical_search(found, query, limit)
        weights, vocab = vectors.tfidf(found, "key", "full_text")
        return search.hybrid_search(found, weights, query, vectors.query_weights(self.spark, query, vocab), limit)

    def search_blocks(self, query: str, limit: int = 20) -> DataFrame:
        return search.block_search(self.tables.read("blocks"), query, limit)

    def timeline(self, last_days: int = 0) -> DataFrame:
        found = self.issues()
        return mining.daily_timeline(found, last_days).join(mining.daily_topics(found), "day", "left")

    def domain_terms(self, min_count: int = 2, limit: int = 40) -> DataFrame:
        return mining.domain_terms(self.issues(), min_count, limit)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        found = self.issues()
        return graph.issue_nodes(found), graph.issue_edges(found).unionByName(graph.related_label_edges(found))

    def promote_terms(self) -> DataFrame:
        """Mined terms as candidates, and the new ones among them as terms; what was promoted or forgotten before keeps its state."""
        old = {name: self.tables.read(name) if self.tables.exists(name) else None for name in ("candidates", "terms")}
        # both are settled before either table changes
        made, marked = map(settled, terms.promote(terms.candidates(self.domain_terms(limit=None), old["candidates"]), old["terms"]))
        self.tables.upsert("candidates", marked, ["candidate_id"], self._now())
        self.tables.upsert("terms", made.withColumn("status", F.lit("new")), ["term_id"], self._now())
        return terms.promoted_listing(self.tables.read("terms"), self.tables.read("candidates"))

    def forget_term(self, term_id: str) -> None:
        """A term is deprecated and its candidates go; a later promotion leaves it so."""
        kept, cands, _ = terms.forget(term_id, self.tables.read("terms"), self.tables.read("candidates"), self.tables.read("terms").select("term_id"))
        self.tables.write("terms", kept, ["term_id"])
        self.tables.write("candidates", cands, ["candidate_id"])

    def embed(self, embedder: vectors.Embedder, model: str) -> None:
        """Store vectors of the issues' texts and of their longer fields."""
        found = self.issues()
        self.tables.upsert("embeddings", vectors.embed(found, embedder, "key", "full_text", model), ["key", "embedding_model"], self._now())
        if "text_fields" in found.columns:
            fields = vectors.field_rows(found).withColumn("field_key", F.concat_ws(":", "key", "field_name"))
            made = vectors.embed(fields, embedder, "field_key", "text", model).withColumnRenamed("key", "field_key")
            self.tables.upsert("field_embeddings", made.join(fields.select("field_key", "key", "field_name", "field_kind", "excerpt"), "field_key"), ["field_key", "embedding_model"], self._now())

    def reimport(self, path: str, embedder: vectors.Embedder | None = None, model: str = "custom") -> DataFrame:
        """Issues from a CSV file, and all that is made of them: vectors, nodes, edges, terms; (name, rows) of each table."""
        self.ingest(path, "issues")
        if embedder:
            self.embed(embedder, model)
        nodes, edges = self.graph()
        self.tables.write("nodes", nodes)
        self.tables.write("edges", edges)
        self.tables.write("cypher", graph.cypher(nodes, edges))
        self.promote_terms()
        names = ["issues", "embeddings", "field_embeddings", "nodes", "edges", "cypher", "candidates", "terms"]
        return terms.table_counts(**{n: self.tables.read(n) for n in names if self.tables.exists(n)})

    def artifacts(self, kind: str = "flashcards") -> DataFrame:
        return artifacts.every(self.tables.read("blocks"))[kind]
