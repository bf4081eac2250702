"""Quiz documents (nested JSON) as records and relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the parts of a quiz document, German ones included.
_OPTION = "array<struct<id:string,option_id:string,text:string>>"
_QUESTION = (
    "array<struct<id:string,question_id:string,question:string,frage_text:string,explanation:string,sameAs:array<string>,"
    f"options:{_OPTION},antwort_optionen:{_OPTION},correct_option_id:string,korrekte_antwort_id:string>>"
)
_SECTION = "array<struct<title:string,begriff:string,bereich:string,summary:string,definition:string,sameAs:array<string>,kerninhalte:array<string>,dimensionen:array<string>,handlungsanweisungen:array<string>>>"
_BODY = (
    f"id:string,module_id:string,title:string,titel:string,description:string,sections:{_SECTION},kernkonzepte:{_SECTION},"
    f"massnahmen_praevention:{_SECTION},questions:{_QUESTION},quiz_fragen:{_QUESTION}"
)


def _schema() -> str:
    top = ", ".join(f"{p.split(':', 1)[0]}: {p.split(':', 1)[1]}" for p in _split_top(_BODY))
    return f"struct<quiz: struct<{_BODY}>, data: map<string,struct<{_BODY}>>, {top}>"


def _split_top(fields: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(fields[last:i])
            last = i + 1
    return [*out, fields[last:]]


def normalise(docs: DataFrame, json: str = "json") -> DataFrame:
    """module_id, title, sections (title, text), questions (question_id, text, explanation, same_as, options, correct_id) of each document.

    The module is the value of ``quiz``, the first value of ``data`` or the document itself.
    """
    p = docs.select("*", F.from_json(json, _schema()).alias("d"))
    names = [f.split(":", 1)[0] for f in _split_top(_BODY)]
    own = F.struct(*[F.col(f"d.{n}").alias(n) for n in names])
    p = p.select("*", F.coalesce("d.quiz", F.map_values("d.data")[0], own).alias("m"))

    def some(a: str, b: str) -> Column:
        return F.coalesce(F.col(f"m.{a}"), F.col(f"m.{b}"))

    none = F.array().cast(_SECTION)
    parts = F.concat(*[F.coalesce(F.col(f"m.{n}"), none) for n in ("sections", "kernkonzepte", "massnahmen_praevention")])
    lists = ("kerninhalte", "dimensionen", "handlungsanweisungen")
    sections = F.transform(
        parts,
        lambda s: F.struct(
            F.coalesce(s["title"], s["begriff"], s["bereich"]).alias("title"),
            F.trim(F.concat_ws("\n", F.coalesce(s["summary"], s["definition"]), *[F.array_join(s[x], "\n") for x in lists])).alias("text"),
            s["sameAs"].alias("same_as"),
        ),
    )
    questions = F.transform(
        F.coalesce("m.questions", "m.quiz_fragen", F.array().cast(_QUESTION)),
        lambda q, i: F.struct(
            F.coalesce(q["id"], q["question_id"], F.concat(F.lit("q_"), i + 1)).alias("question_id"), F.coalesce(q["question"], q["frage_text"]).alias("text"), q["explanation"].alias("explanation"),
            q["sameAs"].alias("same_as"), F.transform(F.coalesce(q["options"], q["antwort_optionen"]), lambda o: F.struct(F.coalesce(o["id"], o["option_id"]).alias("option_id"), o["text"].alias("text"))).alias("options"),
            F.coalesce(q["correct_option_id"], q["korrekte_antwort_id"]).alias("correct_id"),
        ),
    )
    return p.select(some("id", "module_id").alias("module_id"), some("title", "titel").alias("title"), sections.alias("sections"), questions.alias("questions"))


def records(modules: DataFrame) -> DataFrame:
    """block_id, source_id, block_type, title, content of modules, sections, questions, options and semantic references."""
    source = F.concat(F.lit("quiz:"), F.col("module_id"))
    module = modules.select(F.concat(source, F.lit(":module")).alias("block_id"), source.alias("source_id"), F.lit("quiz_module").alias("block_type"), "title", F.col("title").alias("content"))
    s = modules.select(source.alias("source_id"), F.posexplode("sections").alias("i", "s"))
    section = s.select(F.concat("source_id", F.lit(":section:"), "i").alias("block_id"), "source_id", F.lit("quiz_section").alias("block_type"), F.col("s.title").alias("title"), F.col("s.text").alias("content"))
    q = modules.select(source.alias("source_id"), F.explode("questions").alias("q"))
    qid = F.concat("source_id", F.lit(":question:"), "q.question_id")
    question = q.select(qid.alias("block_id"), "source_id", F.lit("quiz_question").alias("block_type"), F.col("q.question_id").alias("title"), F.col("q.text").alias("content"))
    o = q.select("source_id", qid.alias("question"), F.explode("q.options").alias("o"))
    option = o.select(F.concat("question", F.lit(":option:"), "o.option_id").alias("block_id"), "source_id", F.lit("quiz_option").alias("block_type"), F.col("o.option_id").alias("title"), F.col("o.text").alias("content"))
    refs = s.select("source_id", F.explode("s.same_as").alias("r")).union(q.select("source_id", F.explode("q.same_as").alias("r")))
    ref = refs.distinct().select(F.concat(F.lit("semantic:"), F.substring(F.sha1("r"), 1, 20)).alias("block_id"), "source_id", F.lit("semantic_reference").alias("block_type"), F.col("r").alias("title"), F.col("r").alias("content"))
    return module.unionByName(section).unionByName(question).unionByName(option).unionByName(ref)


def counts(modules: DataFrame) -> DataFrame:
    """What each module's document holds: source_id, sections, questions, options, records."""
    options = F.aggregate("questions", F.lit(0), lambda n, q: n + F.coalesce(F.size(q["options"]), F.lit(0)))
    rows = modules.select(F.concat(F.lit("quiz:"), "module_id").alias("source_id"), F.size("sections").alias("sections"), F.size("questions").alias("questions"), options.alias("options"))
    return rows.withColumn("records", 1 + F.col("sections") + F.col("questions") + F.col("options"))


def relations(modules: DataFrame) -> DataFrame:
    """src_id, dst_id, relation, weight: contains, same_as, has_option, correct_option."""
    source = F.concat(F.lit("quiz:"), F.col("module_id"))
    s = modules.select(source.alias("src"), F.posexplode("sections").alias("i", "s")).select("src", F.concat("src", F.lit(":section:"), "i").alias("id"), F.col("s.same_as").alias("same_as"))
    q = modules.select(source.alias("src"), F.explode("questions").alias("q")).select("src", F.concat("src", F.lit(":question:"), "q.question_id").alias("id"), F.col("q.same_as").alias("same_as"), "q")

    def edge(rows: DataFrame, a: Column, b: Column, name: str, weight: float = 1.0) -> DataFrame:
        return rows.select(a.alias("src_id"), b.alias("dst_id"), F.lit(name).alias("relation"), F.lit(weight).alias("weight"))

    parts = s.select("src", "id", "same_as").unionByName(q.select("src", "id", "same_as"))
    refs = parts.select("id", F.explode("same_as").alias("r"))
    options = q.select("id", F.col("q.correct_id").alias("c"), F.explode("q.options.option_id").alias("o"))
    option = F.concat("id", F.lit(":option:"), "o")
    out = edge(parts, F.concat("src", F.lit(":module")), F.col("id"), "contains")
    out = out.unionByName(edge(refs, F.col("id"), F.concat(F.lit("semantic:"), F.substring(F.sha1("r"), 1, 20)), "same_as", 0.95))
    out = out.unionByName(edge(options, F.col("id"), option, "has_option"))
    return out.unionByName(edge(options.where("o = c"), F.col("id"), option, "correct_option"))
