"""Triples of a Turtle document: a small recursive reader for one text, called from ``ontology`` in the tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

# Names of the vocabulary that the grammar itself uses.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><(?:[^\x00-\x20<>"{}|^`\\]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix\b|@base\b|(?i:prefix|base)(?=\s+[\w-]*:?\s*<))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<mark>\^\^|[.;,\[\]()](?!\d))
    |(?P<blank>_:\w(?:[\w.-]*[\w-])?)
    |(?P<number>[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![\w:]))
    |(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])(?:(?:[\w.:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%])*(?:[\w:-]|%[0-9A-Fa-f]{2}|\\[-_~.!$&'()*+,;=/?\#@%]))?)?)
    |(?P<word>a|true|false)(?![\w:])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


class Term(NamedTuple):
    value: str
    literal: bool = False


class Triple(NamedTuple):
    subject: str
    predicate: str
    object: Term


def _unescaped(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES:
            raise ValueError(f"no such escape: {m[2]}")
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|(.))", one, text, flags=re.DOTALL)


def _resolved(base: str, iri: str) -> str:
    """``iri`` against a base; an empty fragment stays, since names go on from it."""
    if not base or iri.startswith("#"):
        return base.partition("#")[0] + iri
    out = urljoin(base, iri)
    return out + "#" if iri.endswith("#") and not out.endswith("#") else out


class Reader:
    """Reads one document; ValueError where it is no Turtle.

    Names with a prefix that is nowhere declared stay as they are written. A document may end without its last full stop.
    """

    def __init__(self, text: str, base: str = ""):
        self.text, self.base, self.prefixes, self.labels = text, base, {}, 0
        self.tokens = self._scan()
        self.kind = self.value = ""
        self._next()

    def _scan(self) -> Iterator[tuple[str, str]]:
        at = 0
        while at < len(self.text):
            m = _TOKEN.match(self.text, at)
            if m is None:
                raise ValueError(f"no Turtle at {at}")
            at = m.end()
            if m.lastgroup != "skip":
                yield m.lastgroup, m[0]
        while True:
            yield "end", ""

    def _next(self) -> str:
        value = self.value
        self.kind, self.value = next(self.tokens)
        return value

    def _is(self, mark: str) -> bool:
        return self.kind == "mark" and self.value == mark

    def _expect(self, mark: str) -> None:
        if not self._is(mark):
            raise ValueError(f"{mark} expected, found {self.value!r}")
        self._next()

    def _blank(self) -> str:
        self.labels += 1
        return f"_:anon{self.labels}"

    def _iri(self) -> str:
        if self.kind == "iri":
            return _resolved(self.base, _unescaped(self._next()[1:-1]))
        if self.kind == "name":
            head, _, tail = self._next().partition(":")
            return self.prefixes[head] + re.sub(r"\\(.)", r"\1", tail) if head in self.prefixes else f"{head}:{tail}"
        raise ValueError(f"a name expected, found {self.value!r}")

    def _directive(self) -> None:
        word = self._next()
        if word.lower().endswith("prefix"):
            if self.kind != "name" or not self.value.endswith(":"):
                raise ValueError("a prefix expected")
            name = self._next()[:-1]
            self.prefixes[name] = self._iri()
        else:
            self.base = self._iri()
        if word.startswith("@"):
            self._expect(".")

    def _object(self) -> Iterator[Triple | Term]:
        """The triples within an object, and the object as the last."""
        if self.kind in ("iri", "name"):
            yield Term(self._iri())
        elif self.kind == "blank":
            yield Term(self._next())
        elif self.kind == "string":
            raw = self._next()
            size = 3 if raw[:3] in ('"""', "'''") else 1
            if self.kind == "lang":
                self._next()
            elif self._is("^^"):
                self._next()
                self._iri()
            yield Term(_unescaped(raw[size:-size]), True)
        elif self.kind == "number" or self.kind == "word" and self.value != "a":
            yield Term(self._next(), True)
        elif self._is("["):
            yield from self._properties()
        elif self._is("("):
            yield from self._collection()
        else:
            raise ValueError(f"an object expected, found {self.value!r}")

    def _properties(self) -> Iterator[Triple | Term]:
        self._next()
        own = self._blank()
        if not self._is("]"):
            yield from self._verbs(own)
        self._expect("]")
        yield Term(own)

    def _collection(self) -> Iterator[Triple | Term]:
        self._next()
        head = last = None
        while not self._is(")"):
            node = self._blank()
            if last is None:
                head = node
            else:
                yield Triple(last, RDF + "rest", Term(node))
            for x in self._object():
                yield Triple(node, RDF + "first", x) if isinstance(x, Term) else x
            last = node
        self._next()
        if last is not None:
            yield Triple(last, RDF + "rest", Term(RDF + "nil"))
        yield Term(head or RDF + "nil")

    def _verbs(self, subject: str) -> Iterator[Triple]:
        while True:
            if self.kind == "word" and self.value == "a":
                self._next()
                verb = RDF + "type"
            else:
                verb = self._iri()
            while True:
                for x in self._object():
                    yield Triple(subject, verb, x) if isinstance(x, Term) else x
                if not self._is(","):
                    break
                self._next()
            if not self._is(";"):
                return
            while self._is(";"):
                self._next()
            if self._is(".") or self._is("]") or self.kind == "end":
                return

    def triples(self) -> Iterator[Triple]:
        while self.kind != "end":
            if self.kind == "directive":
                self._directive()
                continue
            if self._is("[") or self._is("("):
                listed, subject = self._is("["), ""
                for x in self._object():
                    if isinstance(x, Term):
                        subject = x.value
                    else:
                        yield x
                if not (listed and (self._is(".") or self.kind == "end")):
                    yield from self._verbs(subject)
            else:
                yield from self._verbs(self._next() if self.kind == "blank" else self._iri())
            if self.kind != "end":
                self._expect(".")


def triples(text: str, base: str = "") -> list[Triple]:
    return list(Reader(text, base).triples())
