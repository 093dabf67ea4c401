"""Secret scanning with a trigram inverted index.

Each rule's regular expression is parsed; from the strings that any match must
hold follows a Boolean query over trigrams. Each block of documents is indexed
(trigram -> documents that have it), the queries intersect and unite postings,
and only the candidates are verified. Rules from which no trigram follows scan
every document. The index is split by document, like the data, so that no
posting list grows beyond a block and nothing is shuffled.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common as C

#: Strings that a part of an expression is expanded to, at most.
EXPANSION = 64


@dataclass(frozen=True)
class Rule:
    """``least``: characters that group ``group`` of a match must have; shorter matches are dropped after matching."""

    kind: str
    regex: bytes
    group: int = 0
    least: int = 0


#: Fixed patterns and limits of the production query.
BASE = [
    Rule("assign", rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", rb"[0-9a-f]+", 0, 16),
]
MORE = [
    Rule("github", rb"gh[oprsu]_[A-Za-z0-9]{20,}"),
    Rule("slack", rb"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url_login", rb"[a-z][a-z0-9+.-]{1,20}://[!-.0-9;-?A-~]{1,64}:[!-.0-9;-?A-~]{3,64}@"),
]

# A query is True (any text), a trigram (bytes), or ("and" | "or", frozenset of queries).


def both(*queries):
    return _join("and", True, queries)


def either(*queries):
    return True if True in queries else _join("or", None, queries)


def _join(kind: str, neutral, queries):
    flat = set()
    for q in queries:
        if q is not neutral:
            flat |= q[1] if isinstance(q, tuple) and q[0] == kind else {q}
    return neutral if not flat else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def of_strings(strings: set[bytes]):
    """What texts that hold one of the strings must have."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in strings))


def trigram_query(regex: bytes):
    """The Boolean trigram query of an expression; texts are indexed with A-Z lower-cased."""
    strings, query = _walk(parser.parse(regex))
    return both(query, of_strings(strings) if strings is not None else True)


def _walk(items) -> tuple[set[bytes] | None, object]:
    """Of a part of an expression: all strings that it can match, or None if they aren't few; and a query that then holds."""
    run, query, exact = {b""}, True, True
    for op, arg in items:
        strings, own = _node(op, arg)
        if strings is not None and len(run) * len(strings) <= EXPANSION:
            run = {a + b for a, b in product(run, strings)}
            continue
        query = both(query, of_strings(run), own)
        run, exact = (strings if strings is not None else {b""}), False
    return (run, True) if exact else (None, both(query, of_strings(run)))


def _node(op, arg) -> tuple[set[bytes] | None, object]:
    if op is sre.LITERAL:
        return {bytes([arg]).lower()}, True
    if op is sre.IN and arg[0][0] is not sre.NEGATE:
        chars = {c for kind, x in arg for c in ([x] if kind is sre.LITERAL else range(x[0], x[1] + 1) if kind is sre.RANGE else range(256))}
        strings = {bytes([c]).lower() for c in chars}
        return (strings if len(strings) <= 8 else None), True
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        parts = [_walk(x) for x in arg[1]]
        if all(strings is not None for strings, _ in parts) and sum(len(strings) for strings, _ in parts) <= EXPANSION:
            return set().union(*(strings for strings, _ in parts)), True
        return None, either(*(both(query, of_strings(strings) if strings is not None else True) for strings, query in parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, part = arg
        strings, query = _walk(part)
        if (least, most) == (0, 1) and strings is not None:
            return strings | {b""}, True
        if least == 0:
            return None, True
        return None, both(query, of_strings(strings) if strings is not None else True)
    if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, True
    return None, True


def trigrams_of(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def code(trigram: bytes) -> int:
    return int.from_bytes(trigram, "big")


class Index:
    """Postings of the wanted trigrams over one block of documents, as one bit per document."""

    def __init__(self, data: np.ndarray, at: np.ndarray, wanted: np.ndarray):
        self.n = len(at) - 1
        low = np.frombuffer(data.tobytes().lower(), np.uint8).astype(np.uint32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.uint32)
        place = np.flatnonzero(wanted[codes])
        doc = np.searchsorted(at, place, "right") - 1
        inside = place + 2 < at[doc + 1]
        place, doc = place[inside], doc[inside]
        found = codes[place]
        self.postings = {}
        for c in np.unique(found):
            has = np.zeros(self.n, bool)
            has[doc[found == c]] = True
            self.postings[int(c)] = has

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, bytes):
            return self.postings.get(code(query), np.zeros(self.n, bool))
        parts = [self.candidates(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = [(r, re.compile(self.regex(r)), trigram_query(r.regex)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, query in self.rules:
            self.wanted[[code(t) for t in trigrams_of(query)]] = True

    @staticmethod
    def regex(rule: Rule) -> bytes:
        """A bare class+ matches whole runs only, so its limit can be part of the expression."""
        if rule.least and rule.group == 0 and re.fullmatch(rb"\[[^]]+\]\+", rule.regex):
            return rule.regex[:-1] + b"{%d,}" % rule.least
        return rule.regex

    def scan(self, data: np.ndarray, at: np.ndarray) -> list[list[dict]]:
        """Findings of each document, by start, then in the order of the rules; offsets are code points."""
        index, whole = Index(data, at, self.wanted), data.tobytes()
        found: list[list[tuple]] = [[] for _ in range(index.n)]
        for order, (rule, regex, query) in enumerate(self.rules):
            for i in np.flatnonzero(index.candidates(query)):
                for m in regex.finditer(whole[at[i] : at[i + 1]]):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), order, m.end()))
        out = []
        for i, own in enumerate(found):
            rows = []
            if own:
                text = whole[at[i] : at[i + 1]]
                char = None if text.isascii() else np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
                for start, order, end in sorted(own):
                    a, b = (start, end) if char is None else (int(char[start]), int(char[end]))
                    rows.append({"kind": self.rules[order][0].kind, "start": a, "end": b})
            out.append(rows)
        return out


_SCANNERS: dict[tuple, Scanner] = {}


def find_secrets(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``findings``: (kind, start, end) in code points, end exclusive, by start, then in the order of the rules.

    Each rule matches leftmost and without overlap; kinds may overlap one
    another. The time that a text takes grows with its length, whatever it
    holds: no rule of this module is tried anew inside a run that it has
    failed on. Null and empty texts have none. A column of ``docs`` named
    findings is replaced.
    """
    rules = tuple(BASE + MORE if rules is None else rules)

    def run(part: pa.RecordBatch) -> dict:
        if rules not in _SCANNERS:
            _SCANNERS[rules] = Scanner(list(rules))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return {"findings": pa.array(_SCANNERS[rules].scan(*C.view(part.column(text_col))), kind)}

    field = T.StructField("findings", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    return C.add_columns(C.as_text(docs, text_col), run, [field], text_col, drop=(text_col,))
