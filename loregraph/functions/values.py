"""Numbers, JSON, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(c.cast("double"), F.lit(1.0)))


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 1)).otherwise(F.lit(0.0))


def smoothed_idf(n: Column, df: Column) -> Column:
    return F.log((1 + n.cast("double")) / (1 + df.cast("double"))) + 1


def stable(c: Column, digits: int = 6) -> Column:
    """Rounded so that two engines agree on exact halves."""
    return F.round(c + 1e-9, digits)


def json_array(c: Column) -> Column:
    """Strings of a JSON array; null or broken JSON gives an empty array."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_object(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def model_answer(c: Column, schema: str) -> Column:
    """The object between the first { and the last } of a model's answer, code fences ignored; null if it does not parse."""
    return F.from_json(F.regexp_extract(c, "(?s)\\{.*\\}", 0), schema)


def artifact_payload(content: Column, schema: str) -> Column:
    return F.struct(F.from_json(content, schema).alias("parsed"), content.alias("raw_content"))


def map_without(c: Column, *names: str) -> Column:
    return F.map_filter(c, lambda k, _: ~k.isin(*names))


def comment_fields(fields: Column) -> Column:
    from loregraph.functions.text import is_comment_field

    return F.map_filter(fields, lambda k, v: is_comment_field(k) & (F.trim(v) != ""))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths or a zero norm."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    fine = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(fine, dot / (norm(a) * norm(b))).otherwise(F.lit(0.0))
