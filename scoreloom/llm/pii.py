"""Personal data: patterns and a character-level BiLSTM-CRF.

The base spans follow fixed patterns. The tagger is trained on windows whose spans are labelled: base
spans in a bounded sample of the corpus and filled-in templates. Overlapping windows cover the whole of
every text; each character takes its tag from the window in whose middle it stands nearest, and spans are
read off the text as a whole. A span is kept if the CRF is sure of its tags and it has what its kind can't be
without (_possible): a digit or an at sign in any case, so windows that can't reach one are not decoded; the
result is the same. Spans that meet a base span are left out.
Spans count code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bilstm_crf import Tagger
from .common import picked, rows_in, ship

KINDS = ("email", "ip", "card", "phone")
#: Texts that windows are learned from at most, windows of each, and templates.
TRAIN_TEXTS, TRAIN_WINDOWS, TEMPLATES = 400, 6, 1200
WINDOW, STEP, MARGIN, ROUNDS = 96, 48, 24, 400
#: A span is kept if its tags are so likely on average.
SURE = 0.85
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TRIGGER = re.compile("[0-9@]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _HOST.match(text, at + 1) if lo < at else None
        if m:
            yield lo, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def _short(digits: str) -> bool:
    """At most 255, whatever its zeros."""
    return len(digits.lstrip("0")) <= 3 and int(digits[-3:] if len(digits) > 3 else digits) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start. Every scan is linear in the text."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_short, m[0].split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = re.sub("[^0-9]", "", m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


_CLASS = np.full(128, 3, dtype=np.int64)
for _k, _c in enumerate("0@.-+() _%,:;!?\n\t/'\"#=", 4):
    _CLASS[ord(_c)] = _k
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 4, 1, 2
#: 0 pads; letters beyond ASCII share a symbol, and so do other characters.
SYMBOLS = 28


def symbols(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 27)


def tags_of(spans, size: int, kinds: int = len(KINDS)) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    for kind, a, b in sorted(spans, key=lambda s: -kinds + s[0]):
        a, b = max(a, 0), min(b, size)
        if a < b and not out[a:b].any():
            out[a:b] = 2 * kind + 2
            out[a] = 2 * kind + 1
    return out


def windows_at(text: str) -> list[int]:
    """Starts of the windows that cover every digit and at sign of the text with MARGIN characters around them."""
    starts: list[int] = []
    last = len(text) - WINDOW
    reach = -1
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        at = max(lo - (lo % STEP), reach)
        while at < hi:
            starts.append(max(0, min(at, last)))
            at += STEP
        reach = at
    return sorted(set(starts))


#: Forms of phone numbers, and of numbers that are none (9: any digit, 8: none but 0).
PHONES = (
    "+8 (999) 999-9999", "+89 999 999 9999", "+89-999-999-9999", "(999) 999-9999", "(999)999-9999", "899-999-9999", "899.999.9999", "899 999 9999", "0999 9999999", "099 9999 9999", "0999-999999", "0099 99 9999999",
    "8-899-999-9999", "099/9999999", "0899 999 999", "+89 9 99 99 99 99",
)
OTHERS = (
    "2024-09-89", "89.09.2019", "89/09/1999", "89:59", "09:59:59", "$8,999.99", "8,999,999", "89.99", "8.9.9", "v8.9.99", "8999-8999", "978-8-99-999999-9", "89 999", "8 999 999", "59.9999, -0.8999", "#89999", "899.999.999", "89%", "8999 8999 8999", "999-99", "A89-999",
    "89-99-89 99", "8.999.999", "899 899", "89 89 89 89 89 89 89 89 89",
)


def template_rows(count: int = TEMPLATES, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Invented sentences with labelled spans, and as many look-alikes without any."""
    g = random.Random(seed)
    letters, digit = "abcdefghijklmnopqrstuvwxyzéüñ", lambda n: "".join(g.choice("0123456789") for _ in range(n))
    word = lambda: "".join(g.choice(letters[:26] if g.random() < 0.9 else letters) for _ in range(g.randint(2, 9)))
    plain = lambda: "".join(g.choice(letters[:26]) for _ in range(g.randint(2, 8)))
    join = lambda parts: g.choice("- .").join(parts)

    def card():
        body = g.choice("3456") + digit(g.choice([13, 14, 14, 14]))
        body += next(d for d in "0123456789" if luhn(body + d))
        cut = g.choice(["", "-", " ", "."])
        return cut.join(body[k : k + 4] for k in range(0, len(body), 4)) if cut else body

    made = {
        0: lambda: f"{plain()}{g.choice(['', '.', '_', '+'])}{g.choice([plain(), digit(2)])}@{plain()}{g.choice(['', digit(1)])}.{g.choice(['com', 'org', 'example.com', 'co.uk', 'de', 'net'])}",
        1: lambda: ".".join(str(g.randint(0, 255)) for _ in range(4)),
        2: card,
        3: lambda: filled(g.choice(PHONES)),
    }
    filled = lambda form: "".join(digit(1) if c == "9" else g.choice("123456789") if c == "8" else c for c in form)
    other = (lambda: filled(g.choice(OTHERS)), lambda: filled(g.choice(OTHERS)), lambda: filled(g.choice(OTHERS)), lambda: digit(g.randint(1, 6)), lambda: join([digit(2), digit(2), digit(4)]), lambda: f"{digit(1)}.{digit(2)}", lambda: f"v{digit(1)}.{digit(1)}.{digit(2)}", lambda: "@" + plain(), lambda: f"${digit(2)},{digit(3)}", lambda: f"{plain()}={digit(18)}{plain()}", lambda: "".join(g.choice("0123456789abcdef") for _ in range(g.choice([18, 32, 40]))), lambda: digit(g.randint(10, 16)))
    out = []
    for _ in range(count):
        text, spans = "", []
        while len(text) < WINDOW:
            text += " ".join(word() for _ in range(g.randint(1, 5))) + g.choice([" ", " ", ", ", ". ", "\n"])
            r = g.random()
            if r < 0.45:
                kind = g.randrange(4)
                own = made[kind]()
                spans.append((kind, len(text), len(text) + len(own)))
                text += own + g.choice([" ", " ", ", ", ". "])
            elif r < 0.75:
                text += g.choice(other)() + " "
        lo = g.randint(0, len(text) - WINDOW)
        out.append((text[lo : lo + WINDOW], [(k, a - lo, b - lo) for k, a, b in spans]))
    return out


def train(docs: DataFrame, texts: int = TRAIN_TEXTS, rounds: int = ROUNDS) -> Tagger:
    """Learn from templates and from windows of at most `texts` rows of docs (doc_id, text), in order of a hash."""

    def cutouts(batches):
        for _, own in rows_in(batches):
            rows = []
            for t in own:
                spans = base_spans(t)
                for at in windows_at(t)[:: max(1, len(windows_at(t)) // TRAIN_WINDOWS)][:TRAIN_WINDOWS]:
                    part = t[at : at + WINDOW]
                    rows.append((part, [x for k, a, b in spans if b > at and a < at + WINDOW for x in (k, a - at, b - at)]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))], ["text", "spans"])

    chosen = docs.filter(F.col("text").rlike("[0-9@]")).select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(texts).select("doc_id")
    sample = docs.join(F.broadcast(chosen.distinct()), "doc_id").select("text")  # at most `texts` ids are sent
    got = sample.mapInArrow(cutouts, "text string, spans array<int>").orderBy(F.xxhash64("text")).limit(texts * TRAIN_WINDOWS).collect()
    rows = template_rows() + [(r["text"], [tuple(r["spans"][k : k + 3]) for k in range(0, len(r["spans"]), 3)]) for r in got]
    x, y = np.zeros((len(rows), WINDOW), np.int64), np.zeros((len(rows), WINDOW), np.int64)
    for k, (text, spans) in enumerate(rows):
        x[k, : len(text)] = symbols(text)
        y[k, : len(text)] = tags_of(spans, len(text))
    tagger = Tagger(SYMBOLS, len(KINDS))
    tagger.fit(x, y, rounds)
    return tagger


def _possible(kind: int, own: str) -> bool:
    """What a span of its kind can't be without."""
    digits = len(_DIGIT.findall(own))
    if kind == 0:
        return "@" in own[1:-1]
    if kind == 1:
        return own.count(".") == 3 and digits >= 4
    return 13 <= digits <= 19 and luhn(re.sub("[^0-9]", "", own)) if kind == 2 else 7 <= digits <= 15


def owners(places: np.ndarray, size: int) -> np.ndarray:
    """The window (its start) that tags each place: of those that cover a text of this size, STEP apart and one
    at its end, the one in whose middle the place stands nearest (of two, the first)."""
    last = max(0, size - WINDOW)
    first = np.clip(-((WINDOW + STEP - 2 * places) // (2 * STEP)) * STEP, 0, max(0, (last - 1) // STEP * STEP))
    return np.where(np.abs(2 * (places - first) - WINDOW) <= np.abs(2 * (places - last) - WINDOW), first, last)


class _Tags:
    """Tags of places of texts; windows are decoded when they are asked for, many at once."""

    def __init__(self, tagger: Tagger, texts: list[str], at_once: int = 512):
        self.tagger, self.texts, self.at_once = tagger, texts, at_once
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        self.sure: dict[tuple[int, int], np.ndarray] = {}

    def decode(self, jobs: list[tuple[int, int]]) -> None:
        codes: dict[int, np.ndarray] = {}
        for lo in range(0, len(jobs), self.at_once):
            part = jobs[lo : lo + self.at_once]
            x = np.zeros((len(part), WINDOW), np.int64)
            for k, (d, at) in enumerate(part):
                own = symbols(self.texts[d][at : at + WINDOW])
                x[k, : len(own)] = own
            found = self.tagger.decode(x).astype(np.int8)
            self.rows.update(zip(part, found, strict=True))
            some = np.flatnonzero(found.any(axis=1))
            if len(some):
                self.sure.update(zip([part[k] for k in some.tolist()], self.tagger.sure(x[some], found[some]), strict=True))

    def of(self, d: int, place: int) -> int | None:
        """The tag, or nothing if its window isn't decoded yet."""
        at = int(owners(np.array([place]), len(self.texts[d]))[0])
        row = self.rows.get((d, at))
        return None if row is None else int(row[place - at])

    def likely(self, d: int, lo: int, hi: int) -> float:
        """How likely the tags of these places are, on average."""
        places = np.arange(lo, hi)
        at = owners(places, len(self.texts[d]))
        return float(np.mean([self.sure[d, s][p - s] for p, s in zip(places.tolist(), at.tolist(), strict=True)]))

    def within(self, d: int, lo: int, hi: int) -> np.ndarray:
        places = np.arange(lo, hi)
        at = owners(places, len(self.texts[d]))
        out = np.empty(hi - lo, dtype=np.int64)
        for s in np.unique(at).tolist():
            same = at == s
            out[same] = self.rows[d, s][places[same] - s]
        return out


def tagged_spans(tagger: Tagger, texts: list[str], sure: float = SURE) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans of whole texts, (kind, start, end) by start.

    They are the spans that windows over the whole text give: every place is tagged by its own window
    (owners()). Only windows that can matter are decoded: a span that is kept has a digit or an at sign, so
    from these each stretch grows to both sides until a place without a tag ends it.
    """
    tags = _Tags(tagger, texts)
    jobs: set[tuple[int, int]] = set()
    grow: list[list[int]] = []  # text, from, to, whether it may go on to the left and right
    for d, t in enumerate(texts):
        for m in _TRIGGER.finditer(t):
            lo, hi = max(0, m.start() - 1), min(len(t), m.end() + 1)
            grow.append([d, lo, hi, 1, 1])
            jobs.update((d, at) for at in np.unique(owners(np.arange(lo, hi), len(t))).tolist())
    while jobs:
        tags.decode(sorted(jobs))
        jobs = set()
        for row in grow:
            d, size = row[0], len(texts[row[0]])
            while row[3]:
                now = tags.of(d, row[1])
                if now is None:
                    jobs.add((d, int(owners(np.array([row[1]]), size)[0])))
                    break
                if not now or not row[1]:
                    row[3] = 0
                else:
                    row[1] -= 1
            while row[4]:
                now = tags.of(d, row[2] - 1)
                if now is None:
                    jobs.add((d, int(owners(np.array([row[2] - 1]), size)[0])))
                    break
                if not now or row[2] == size:
                    row[4] = 0
                else:
                    row[2] += 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stretches: list[list[int]] = []
    for d, lo, hi, *_ in sorted(grow):
        if stretches and stretches[-1][0] == d and lo <= stretches[-1][2]:
            stretches[-1][2] = max(hi, stretches[-1][2])
        else:
            stretches.append([d, lo, hi])
    for d, lo, hi in stretches:
        own = tags.within(d, lo, hi)
        kinds = np.where(own > 0, (own - 1) // 2, -1)
        starts = np.flatnonzero((kinds >= 0) & np.r_[True, (kinds[1:] != kinds[:-1]) | (own[1:] % 2 == 1)])
        ends = np.flatnonzero((kinds >= 0) & np.r_[(kinds[1:] != kinds[:-1]) | (own[1:] % 2 == 1), True]) + 1
        out[d] += [(int(kinds[a]), lo + a, lo + b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [[s for s in spans if _possible(s[0], texts[d][s[1] : s[2]]) and tags.likely(d, s[1], s[2]) >= sure] for d, spans in enumerate(out)]


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and all spans, for each row of docs (doc_id, text).

    Counts and digest are those of the base spans. Null and empty texts have none; null ids and repeated
    rows are kept; an empty table gives an empty result; other columns are not read. A text of any length
    is read whole, in memory of some bytes a character and its windows' tags.
    """
    ship(docs.sparkSession)
    rows = picked(docs, doc_id="long", text="string")
    tagger = tagger or train(rows)

    def find(batches):
        for part, texts in rows_in(batches):
            base = [base_spans(t) for t in texts]
            more = tagged_spans(tagger, texts)
            every = [sorted(b + [s for s in m if not any(s[1] < y and x < s[2] for _, x, y in b)]) for b, m in zip(base, more, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0)]
                + [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
                + [pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in base]), pa.array([written(e) for e in every])],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    return rows.mapInArrow(find, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")
