"""Secret scans through a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over the trigrams that every match must
hold. A block of documents is indexed (trigram -> documents); a rule's postings are intersected and
united as its query says, and its expression runs over the candidates alone. A rule without mandatory
trigrams scans all documents. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LOWER, picked, rows_in

_STRINGS = 48
ANY = ("any",)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    check: Callable[[re.Match], bool] | None = field(default=None, compare=False)
    base: bool = False


#: Fixed patterns of the base kinds. `hex` matches runs of 16 characters or more, which are the long ones of all maximal runs.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12, True),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18, True),
    Rule("hex", r"[0-9a-f]{16,}", None, True),
)
#: Further kinds that the method adds.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"\b[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{3,200}@"),
)
RULES = BASE + MORE


def _both(a, b):
    return b if a == ANY else a if b == ANY or a == b else ("and", a, b)


def _either(a, b):
    return ANY if ANY in (a, b) else a if a == b else ("or", a, b)


def _holds(strings: set[str]):
    """What a text that holds one of the strings must hold."""
    out = None
    for s in sorted(strings):
        raw = s.encode().translate(LOWER)
        one = ANY
        for k in range(len(raw) - 2):
            one = _both(one, ("tri", raw[k : k + 3]))
        out = one if out is None else _either(out, one)
    return ANY if out is None else out


def _walk(items) -> tuple[set[str] | None, tuple]:
    """The strings that the items can match, if they are few, and what each match must hold besides."""
    exact: set[str] | None = {""}
    query = ANY
    for op, arg in items:
        own, need = None, ANY
        if op is K.LITERAL:
            own = {chr(arg)}
        elif op is K.AT or op in (K.ASSERT, K.ASSERT_NOT):
            own = {""}
        elif op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 4:
            own = {chr(c) for _, c in arg}
        elif op is K.SUBPATTERN:
            own, need = _walk(arg[3])
        elif op is K.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None and p[1] == ANY for p in parts):
                own = set().union(*(p[0] for p in parts))
            else:
                need = None
                for strings, more in parts:
                    one = more if strings is None else _both(_holds(strings), more)
                    need = one if need is None else _either(need, one)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            low, high, inner = arg
            strings, more = _walk(inner)
            if (low, high) == (0, 1) and strings is not None and more == ANY:
                own = strings | {""}
            elif low == high and low <= 8 and strings is not None and more == ANY and len(strings) ** low <= _STRINGS:
                own = {""}
                for _ in range(low):
                    own = {a + b for a in own for b in strings}
            elif low:
                need = more if strings is None else _both(_holds(strings), more)
        if own is not None and len(own) <= _STRINGS:
            query = _both(query, need)
            if exact is None:
                exact, query = own, query
            elif len(exact) * len(own) <= _STRINGS:
                exact = {a + b for a in exact for b in own}
            else:
                query, exact = _both(query, _holds(exact)), own
        else:
            if own is not None:
                need = _both(need, _holds(own))
            if exact is not None:
                query = _both(query, _holds(exact))
            query, exact = _both(query, need), None
    return (exact, query) if exact is not None and query == ANY else (None, query if exact is None else _both(query, _holds(exact)))


def trigram_query(pattern: str):
    """Boolean trigram query over A-Z-lowered bytes; ANY if the pattern has no mandatory trigram."""
    exact, query = _walk(_parser.parse(pattern, re.ASCII))
    return query if exact is None else _both(query, _holds(exact))


def trigrams(query) -> set[bytes]:
    return set() if query == ANY else {query[1]} if query[0] == "tri" else trigrams(query[1]) | trigrams(query[2])


class Index:
    """Postings (trigram -> documents in order) of a block, for the trigrams that some rule asks for."""

    def __init__(self, texts: list[str], wanted: set[bytes]):
        raw = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
        self.size = len(texts)
        self.lists: dict[bytes, np.ndarray] = {}
        ends = np.cumsum([len(r) + 3 for r in raw])
        data = np.frombuffer(b"\xff\xff\xff".join(raw) + b"\xff\xff\xff", dtype=np.uint8)
        code = data[2:].astype(np.uint32)
        code |= data[1:-1].astype(np.uint32) << np.uint32(8)
        code |= data[:-2].astype(np.uint32) << np.uint32(16)
        asked = np.zeros(1 << 24, dtype=bool)
        names = {int.from_bytes(w, "big"): w for w in wanted}
        asked[list(names)] = True
        at = np.flatnonzero(asked[code])
        pairs = np.unique(code[at].astype(np.int64) << 32 | np.searchsorted(ends, at, side="right"))
        tri, doc = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.flatnonzero(np.diff(tri)) + 1
        for own, docs in zip(np.split(tri, cuts), np.split(doc, cuts), strict=True):
            if len(own):
                self.lists[names[int(own[0])]] = docs

    def find(self, query) -> np.ndarray:
        if query == ANY:
            return np.arange(self.size)
        if query[0] == "tri":
            return self.lists.get(query[1], np.empty(0, dtype=np.int64))
        a, b = self.find(query[1]), self.find(query[2])
        return np.intersect1d(a, b, assume_unique=True) if query[0] == "and" else np.union1d(a, b)


def scan(texts: list[str], rules=RULES) -> list[list[tuple[int, int, int]]]:
    """Per text its (start, rule, end), in that order; matches of a rule are leftmost and don't overlap."""
    plans = [(re.compile(r.pattern, re.ASCII), trigram_query(r.pattern), r.check) for r in rules]
    index = Index(texts, set().union(*(trigrams(q) for _, q, _ in plans)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for k, (expression, query, check) in enumerate(plans):
        for d in index.find(query).tolist():
            for m in expression.finditer(texts[d]):
                if check is None or check(m):
                    found[d].append((m.start(), k, m.end()))
    for spans in found:
        spans.sort()
    return found


def written(spans, rules=RULES) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, a count for each base kind, base_sha256 and all spans, for each row of docs (doc_id, text).

    Null and empty texts have no spans (the digest is that of the empty string); null ids and repeated
    rows are kept; an empty table gives an empty result; other columns are not read.
    """
    base = [k for k, r in enumerate(rules) if r.base]
    names = [f"n_{rules[k].kind}" for k in base]

    def find(batches):
        for part, texts in rows_in(batches):
            found = scan(texts, rules)
            own = [[s for s in spans if s[1] in base] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [part.column(0)]
                + [pa.array([sum(s[1] == k for s in spans) for spans in own], pa.int64()) for k in base]
                + [pa.array([hashlib.sha256(written(s, rules).encode()).hexdigest() for s in own]), pa.array([written(s, rules) for s in found])],
                ["doc_id", *names, "base_sha256", "spans"],
            )

    rows = picked(docs, doc_id="long", text="string")
    return rows.mapInArrow(find, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string")
