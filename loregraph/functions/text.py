"""Text columns: tokenizers, normalisers, ids, snippets, predicates."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search and mining leave out.
STOPWORDS = [
    "und", "oder", "der", "die", "das", "ein", "eine", "mit", "von", "für", "auf", "in", "zu", "den", "dem", "des", "ist", "sind", "nicht", "bei",
    "the", "and", "for", "with", "from", "this", "that", "into", "issue", "task", "story", "bug", "todo", "done",
]

# Words that name no domain term.
NOISE_TERMS = [
    "bitte", "danke", "sowie", "sollte", "koennen", "können", "wurde", "wurden", "wird", "haben", "hier", "diese", "dieser", "dieses", "there",
    "would", "should", "could", "about", "after", "before", "because", "while", "where", "which", "when", "what", "ticket", "tickets", "request",
    "requests", "service", "system", "feature", "problem", "problems", "update", "updates", "description", "kommentar", "comment", "body", "field",
    "text", "info", "error", "errors", "failed", "failure", "please", "need", "needs", "user", "users", "team", "seite", "frage", "fragen",
]

# Parts of names of fields that hold comments.
COMMENT_HINTS = ("comment", "kommentar", "rueckmeldung", "rückmeldung", "feedback", "discussion")

# Token patterns.
SEARCH_TOKEN = "[A-Za-zÄÖÜäöüß0-9_-]{4,}"
TFIDF_TOKEN = "[a-z0-9]{3,}"
WORD_TOKEN = "[a-zA-Z0-9_]+"
RETRIEVAL_TOKEN = "[a-zA-Z0-9äöüÄÖÜ_-]{3,}"

# Signs of which the words of a canonical term are made.
TERM_SIGNS = "a-z0-9äöüß+.#/"

MIN_TERM_LENGTH = 4


def _in(c: Column, words: list[str]) -> Column:
    return c.isin(*words) if words else F.lit(False)


def tokens_of(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def search_tokens(text: Column, excluded: list[str] | None = None) -> Column:
    """Lower-cased tokens in order, with repeats, without stopwords and excluded terms; null text has none."""
    out = [*STOPWORDS, *(excluded or [])]
    return F.filter(tokens_of(F.lower(F.coalesce(text, F.lit(""))), SEARCH_TOKEN), lambda t: ~t.isin(*out))


@lru_cache(maxsize=1)
def _folded() -> tuple[str, str, dict[str, str]]:
    """Characters that fold to one of ASCII, these, and what the others fold to that leave several (compatibility decomposition)."""
    one, to, many = [], [], {}
    for p in range(128, sys.maxunicode + 1):
        c = chr(p)
        plain = "" if 0xD800 <= p < 0xE000 else unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        elif plain:
            many[c] = plain
    return "".join(one), "".join(to), many


def _ranges(chars: list[str]) -> str:
    """A character class of sorted characters, runs of neighbours as ranges."""
    out, start, last = [], None, None
    for p in [*sorted(map(ord, chars)), None]:
        if start is not None and p != last + 1:
            out.append(f"\\x{{{start:x}}}" + (f"-\\x{{{last:x}}}" if last > start else ""))
            start = p
        start, last = (p if start is None else start), p
    return "[" + "".join(out) + "]"


def fold(text: Column) -> Column:
    """Text without marks and other non-ASCII characters (compatibility decomposition).

    ASCII texts pass through. Others have the characters translated that fold to one; only where something is left
    that folds to several is the text taken apart.
    """
    one, to, many = _folded()
    table = F.create_map(*[F.lit(x) for pair in many.items() for x in pair])

    def taken_apart(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c > "\x7f", F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")

    def rest(t: Column) -> Column:
        wide = F.regexp_replace(t, "[\\x00-\\x7F]+", "").rlike(_ranges(list(many)))
        return F.when(t.rlike("[^\\x00-\\x7F]"), F.regexp_replace(F.when(wide, taken_apart(t)).otherwise(t), "[^\\x00-\\x7F]+", "")).otherwise(t)

    # bound by a function of one element, so that it is translated once
    translated = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, one, to)).otherwise(text)
    return F.transform(F.array(translated), rest)[0]


def tfidf_tokens(text: Column, folded: bool = True) -> Column:
    clean = F.coalesce(text, F.lit(""))
    return tokens_of(F.lower(fold(clean) if folded else clean), TFIDF_TOKEN)


def word_tokens(text: Column) -> Column:
    return tokens_of(F.lower(F.coalesce(text, F.lit(""))), WORD_TOKEN)


def retrieval_tokens(text: Column) -> Column:
    return F.array_distinct(tokens_of(F.lower(F.coalesce(text, F.lit(""))), RETRIEVAL_TOKEN))


def query_words(text: str) -> list[str]:
    """Words of a query for block search, on the driver."""
    import re

    return [w for w in re.split(r"\W+", text.lower()) if w]


def squeeze(text: Column) -> Column:
    """Every run of white space is one blank, none at the ends; blanks that stand alone are left as they are."""
    return F.trim(F.regexp_replace(text, "\\s{2,}|[\\t\\n\\x0B\\f\\r]", " "))


def plain_term(term: Column) -> Column:
    """Lower case with blanks for _ and -."""
    return F.translate(F.lower(term), "_-", "  ")


def compatible(text: Column) -> Column:
    """Compatibility composition of the text (NFKC); texts of ASCII alone pass through."""

    @F.pandas_udf("string")
    def compose(t: pd.Series) -> pd.Series:
        return t.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return compose(text)


def exclusion_term(term: Column) -> Column:
    """The form by which exclusions are the same; it is composed first, so that wide or ligature forms are those of plain letters."""
    return squeeze(plain_term(F.trim(compatible(term))))


def canonical_term(label: Column) -> Column:
    """The normalised label by which terms are the same."""
    c = F.array_join(F.regexp_extract_all(F.lower(label), F.lit(f"[{TERM_SIGNS}]+"), 0), " ")
    c = F.replace(c, F.lit("oauth2"), F.lit("oauth"))
    return F.regexp_replace(c, " (service|system)s$", " $1")


def canonical_start(label: Column, words: int) -> Column:
    """The first ``words`` words of ``canonical_term(label)``, from the part of the text that they and one more sign take up."""
    part = F.regexp_extract(F.lower(label), f"^[^{TERM_SIGNS}]*+(?:[{TERM_SIGNS}]++[^{TERM_SIGNS}]*+){{0,{words}}}+[{TERM_SIGNS}]?", 0)
    return F.substring_index(canonical_term(part), " ", words)


def domain_name(name: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9_-]+", "-"), "^[-_]+|[-_]+$", "")
    return F.when(c == "", F.lit("default")).otherwise(c)


def id_tail(identifier: Column) -> Column:
    return F.substring_index(F.substring_index(identifier, "/", -1), "#", -1)


def snippet(text: Column, limit: int = 180) -> Column:
    """White space squeezed; longer text is cut and ends in an ellipsis."""
    c = squeeze(text)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, limit - 1)), F.lit("…")))


def job_preview(text: Column, limit: int = 200) -> Column:
    """What a listing of jobs shows of a prompt or answer: white space squeezed, cut with an ellipsis; empty where there is none."""
    return snippet(F.coalesce(text, F.lit("")), limit)


def short_id(identifier: Column, head: int = 8, tail: int = 6) -> Column:
    return F.when(F.length(identifier) <= head + tail + 1, identifier).otherwise(
        F.concat(F.substring(identifier, 1, head), F.lit("…"), F.right(identifier, F.lit(tail)))
    )


def chunks(text: Column, least: int = 40, otherwise: int = 2000) -> Column:
    """Paragraphs of at least ``least`` characters; without any, the start of the whole text."""
    c = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(c, "\\n\\s*\\n+"), squeeze), lambda x: F.length(x) >= least)
    whole = F.substring(squeeze(c), 1, otherwise)
    rest = F.when(whole == "", F.array().cast("array<string>")).otherwise(F.array(whole))
    return F.when(F.size(parts) > 0, parts).otherwise(rest)


def full_text(summary: Column, description: Column, labels: Column, fields: Column | None = None) -> Column:
    parts = [F.coalesce(summary, F.lit("")), F.coalesce(description, F.lit("")), F.array_join(labels, " ")]
    if fields is not None:
        parts.append(F.array_join(F.map_values(fields), " "))
    return F.trim(F.concat(*[x for k, p in enumerate(parts) for x in ([F.lit(" ")] if k else []) + [p]]))


def cypher_name(node_id: Column) -> Column:
    return F.concat(F.lit("n_"), F.regexp_replace(node_id, "[^\\p{L}\\p{N}]", "_"))


def file_suffix(source_id: Column, kind: str) -> Column:
    return F.translate(F.concat(source_id, F.lit(f":{kind}")), "/ ", "__")


def block_id(path: Column, kind: Column, content: Column, order: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", path, kind, content, order.cast("string")), 256), 1, 16)


def hashed_id(prefix: str, seed: Column, length: int = 20) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(seed), 1, length))


def is_comment_field(name: Column) -> Column:
    return plain_term(name).rlike("|".join(COMMENT_HINTS))


def is_domain_term(term: Column, excluded: list[str] | None = None) -> Column:
    """Long enough, with a letter, no listed word and no short code such as ab12."""
    c = F.lower(F.trim(term))
    return (
        (F.length(c) >= MIN_TERM_LENGTH)
        & c.rlike("\\p{L}")
        & ~_in(c, [*STOPWORDS, *NOISE_TERMS, *(excluded or [])])
        & ~c.rlike("^[a-z]{1,2}[0-9]+$")
    )


def label_terms(label: Column, excluded: list[str] | None = None) -> Column:
    """The whole normalised label and its tokens, valid ones, each once."""
    c = F.trim(plain_term(label))
    every = F.concat(F.array(c), search_tokens(c, excluded))
    return F.array_distinct(F.filter(every, lambda t: is_domain_term(t, excluded)))


def text_terms(text: Column, excluded: list[str] | None = None) -> Column:
    return F.filter(search_tokens(text, excluded), lambda t: is_domain_term(t, excluded))


def render(template: Column, **values: Column) -> Column:
    """``{{name}}`` replaced by the values."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value, F.lit("")))
    return template


def relation_target(value: Column) -> Column:
    """(relation, target) of "relation->target"; of a prefixed or full name only its end is the relation."""
    raw = F.trim(F.substring_index(value, "->", 1))
    name = F.when(raw.contains(":"), F.substring_index(raw, ":", -1)).otherwise(id_tail(raw))
    cut = F.instr(value, F.lit("->"))
    target = F.when(cut > 0, F.trim(F.substring(value, cut + 2, F.length(value)))).otherwise(F.lit(""))
    return F.struct(F.coalesce(name, F.lit("")).alias("relation"), F.coalesce(target, F.lit("")).alias("target"))


def _url_file(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "[?#].*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    return F.substring_index(F.regexp_replace(path, "/+$", ""), "/", -1)


def url_slug(url: Column) -> Column:
    """A name for a file from its address: without ending and with - for other signs; "ontology" where nothing is left."""
    stem = F.regexp_replace(_url_file(url), "(?<=.)\\.[^.]+$", "")
    slug = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit("ontology")).otherwise(slug)


def url_title(url: Column, kind: str) -> Column:
    """The file's name, or the host's, with _ for other signs."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    name = F.coalesce(F.nullif(_url_file(url), F.lit("")), F.nullif(host, F.lit("")))
    clean = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(f"ontology_{kind}"))


def artifact_preview(kind: Column, content: Column, limit: int = 240) -> Column:
    """The first section of a summary note, its title or content otherwise; of other artifacts the text with white space squeezed."""
    text = F.trim(F.coalesce(content, F.lit("")))

    def field(path: str) -> Column:
        return F.nullif(F.trim(F.get_json_object(text, path)), F.lit(""))

    title, summary = field("$.sections[0].title"), field("$.sections[0].summary")
    first = F.when(title.isNotNull(), F.concat(title, F.lit(": "), F.coalesce(summary, F.lit("")))).otherwise(summary)
    note = F.when(kind == "summary_note", F.coalesce(first, field("$.title"), field("$.content")))
    return F.substring(F.coalesce(note, squeeze(text)), 1, limit)


def display_path(path: Column, data_root: str, home: str) -> Column:
    """A path below the data folder or the home folder is shown from there."""
    shown = path
    for root, mark in ((home, "~"), (data_root, "DATADIR")):
        root = root.rstrip("/")
        shown = F.when(path == root, F.lit(mark)).when(path.startswith(root + "/"), F.concat(F.lit(mark), F.substring(path, len(root) + 1, 100_000))).otherwise(shown)
    return F.coalesce(shown, F.lit("-"))


def template_name(name: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9._-]+", "-"), "^[-._]+|[-._]+$", "")
    return F.when(c == "", F.lit("default")).otherwise(c)


def answer_lines(answer: Column) -> Column:
    """The lines of a model's answer that are not blank."""
    return F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def unified_diff(before: Column, after: Column) -> Column:
    """What changed between two versions of a text, as difflib writes it."""
    import difflib

    def one(a: str | None, b: str | None) -> str:
        return "".join(difflib.unified_diff((a or "").splitlines(keepends=True), (b or "").splitlines(keepends=True), fromfile="snapshot", tofile="current"))

    @F.pandas_udf("string")
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return diff(before, after)
