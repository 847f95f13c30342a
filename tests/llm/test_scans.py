"""Toxicity, personal data and secrets."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scoreloom.llm import pii, secrets_scan, toxicity
from scoreloom.llm.bilstm_crf import Tagger

SCHEMA = "doc_id long, text string, score string, spans int"


def test_toxicity_learns_and_holds_out(spark):
    g = random.Random(2)
    word = lambda: "".join(g.choice("abcdefghilmnoprstu") for _ in range(g.randint(2, 7)))
    rows, labels = [], []
    for k in range(600):
        toxic = k % 4 == 0
        words = [word() for _ in range(g.randint(10, 60))]
        if toxic:
            words[g.randrange(len(words))] = g.choice(["zzworst", "qqvile"]) + g.choice(["", "!", "er"])
        rows.append((k, " ".join(words) * (30 if k % 50 == 0 else 1), "a", 1))
        labels.append((k, int(toxic)))
    rows += [(1000, None, "a", 1), (1001, "", "a", 1), (None, "zzworst", "a", 1), (0, rows[0][1], "b", 2)]
    labels += [(2000, None), (None, 1)]
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marks).collect()}
    assert len(got) == 603
    for k, y in labels[:600]:
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
        assert 0 <= got[k].score <= 1 and got[k].predicted == int(got[k].score >= 0.5)
    held = [k for k in range(600) if got[k].held_out]
    assert np.mean([got[k].predicted == labels[k][1] for k in held]) > 0.95
    assert got[1000].score == got[1001].score and not got[None].held_out
    kept = toxicity.accepted(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in toxicity.toxicity(docs, marks).collect())
    assert toxicity.toxicity(docs.limit(0), marks).count() == 0
    assert {r.predicted for r in toxicity.toxicity(docs.limit(3), marks.limit(0)).collect()} <= {0, 1}


def _gram_hash(gram):
    """A n-gram's hash, from its definition."""
    word, base = (1 << 64) - 1, 0x9E3779B97F4A7C15 | 1
    h = sum((ord(c) + 7) * pow(base, k, 1 << 64) for k, c in enumerate(gram)) & word
    h ^= h >> 29
    return h * 0xBF58476D1CE4E5B9 & word


def test_toxicity_against_brute_force(spark, monkeypatch):
    """Counts, choice of n-grams, ratios and scores from sets of n-grams; long texts come in stretches."""
    monkeypatch.setattr(toxicity, "STRETCH", 50)
    g = random.Random(21)
    word = lambda: "".join(g.choice("abcd") for _ in range(g.randint(1, 4)))
    texts, marks = [], []
    for k in range(400):
        toxic = k % 3 == 0
        words = [word() for _ in range(g.randint(3, 40))] + (["vile\tTHING"] if toxic and k % 15 else []) + (["good thing"] if not toxic and k % 4 == 0 else [])
        g.shuffle(words)
        texts.append(" ".join(words))
        marks.append(int(toxic))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, y) for k, y in enumerate(marks)], "doc_id long, toxic int")
    features = 40
    model = toxicity.train(docs, labels, features=features)
    grams = [{p[a : a + n] for p in [" " + re.sub(r"\s", " ", t.lower()) + " "] for n in toxicity.SIZES for a in range(len(p) - n + 1)} for t in texts]
    hashes = [{_gram_hash(x) for x in own} for own in grams]
    share, buckets = sum(marks) / len(marks), [{h >> (64 - toxicity.BUCKET_BITS) for h in own} for own in hashes]
    n = {0: {}, 1: {}}
    for own, y in zip(buckets, marks, strict=True):
        for b in own:
            n[y][b] = n[y].get(b, 0) + 1
    z = {}
    for b in set(n[0]) | set(n[1]):
        both = n[0].get(b, 0) + n[1].get(b, 0)
        if both >= toxicity.SUPPORT:
            z[b] = (n[1].get(b, 0) - both * share) / (both * share * (1 - share)) ** 0.5
    strong = sorted((b for b in z if abs(z[b]) > toxicity.DEVIATIONS), key=lambda b: -abs(z[b]))
    assert len(strong) > 10
    chosen = set(strong[:features]) if len(strong) <= features or abs(z[strong[features - 1]]) != abs(z[strong[features]]) else set(strong)
    names = sorted({h for own in hashes for h in own if h >> (64 - toxicity.BUCKET_BITS) in chosen})
    count = {h: [sum(h in own and y == c for own, y in zip(hashes, marks, strict=True)) for c in (0, 1)] for h in names}
    ratio = {h: np.log((c[1] + 1) / (sum(marks) + 2)) - np.log((c[0] + 1) / (len(marks) - sum(marks) + 2)) for h, c in count.items()}
    kept = {h for h in names if sum(count[h]) >= toxicity.GRAM_SUPPORT and abs(ratio[h]) >= toxicity.RATIO}
    got = dict(zip(model.features.tolist(), model.weights.tolist(), strict=True))
    assert set(got) <= kept and len(got) > 5
    own = toxicity.score(model, [*texts, "", "x" * 500 + " vile thing"], model.prefilter())
    for t, s in zip([*texts, "", "x" * 500 + " vile thing"], own.tolist(), strict=True):
        p = " " + re.sub(r"\s", " ", t.lower()) + " "
        total = model.bias + sum(got.get(h, 0) for h in {_gram_hash(p[a : a + n]) for n in toxicity.SIZES for a in range(len(p) - n + 1)})
        assert abs(s - 1 / (1 + np.exp(-total))) < 1e-9
    if len(strong) <= features:
        at = {h: k for k, h in enumerate(names)}
        order = sorted(names)
        row = np.concatenate([np.full(sum(h in at for h in o), k) for k, o in enumerate(hashes)])
        col = np.concatenate([[at[h] for h in sorted(o) if h in at] for o in hashes]).astype(int)
        w, bias = toxicity.fit(row, col, np.array([ratio[h] if h in kept else 0.0 for h in order]), np.array(marks, float), len(names))
        assert abs(bias - model.bias) < 1e-6 and all(abs(got[h] - w[at[h]] * ratio[h]) < 1e-6 for h in got)


def test_long_texts_are_scored_whole():
    g = random.Random(22)
    text = " ".join("".join(g.choice("abcdefgh") for _ in range(g.randint(2, 8))) for _ in range(700_000)) + " at the very end"
    held = np.ones(1 << toxicity.BUCKET_BITS, dtype=bool)
    held[::2] = False
    d, found = toxicity.hits(["short", text, ""], held)
    for gram in (" end ", "very e"):
        h = _gram_hash(gram)
        assert held[h >> (64 - toxicity.BUCKET_BITS)] == (h in set(found[d == 1].tolist()))
    assert (d == 1).sum() > 100_000 and np.all(np.diff(d) >= 0)


def test_accepted_keeps_all_columns(spark):
    rows = [(k, "zzworst" if k % 2 else "fine words", "x", "T", k) for k in range(300)] + [(None, "fine words", None, None, None), (None, None, "x", "T", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, TEXT string, __score int")
    marks = spark.createDataFrame([(k, k % 2, 5) for k in range(300)], "doc_id long, toxic int, `a.b` int")
    kept = toxicity.accepted(docs, marks)
    empty = toxicity.score(toxicity.train(docs, toxicity.learnt(marks)), [""], np.zeros(1 << toxicity.BUCKET_BITS, dtype=bool))[0]
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[1] == "fine words" or r[1] is None and empty < 0.5}


def _brute_pii(text):
    patterns = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((k, m.start(), m.end()))
    return out


def test_base_spans_against_brute_force():
    g = random.Random(3)
    for _ in range(20_000):
        text = "".join(g.choice("ab@.0123456789+-() %_é\n") for _ in range(g.randint(0, 40)))
        assert pii.base_spans(text) == _brute_pii(text), repr(text)


def test_base_spans_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1(" * 100_000, "1." * 150_000):
        pii.base_spans(text)


def test_tagger_gradients():
    t, g = Tagger(28, 4, size=4, width=3), np.random.default_rng(0)
    x, y = g.integers(0, 28, (3, 7)), np.zeros((3, 7), int)
    y[0, 2], y[0, 3] = 1, 2
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    _, grads = t.step(x, y)
    for k, v in t.p.items():
        at = (0,) * v.ndim if k == "t" else tuple(int(g.integers(0, n)) for n in v.shape)
        old = v[at]
        v[at] = old + 1e-3
        up = t.step(x, y)[0]
        v[at] = old - 1e-3
        down = t.step(x, y)[0]
        v[at] = old
        assert abs((up - down) / 2e-3 - grads[k][at]) < 1e-3


@pytest.fixture(scope="module")
def tagger():
    rows = pii.template_rows()
    x = np.array([pii.symbols(t) for t, _ in rows])
    y = np.array([pii.tags_of(s, len(t)) for t, s in rows])
    out = Tagger(pii.SYMBOLS, len(pii.KINDS))
    out.fit(x[:1000], y[:1000], 150)
    out.held = x[1000:], y[1000:]
    return out


def test_tagger_on_held_out_rows(tagger):
    x, y = tagger.held
    got = tagger.decode(x)
    assert ((got == y) & (y > 0)).sum() / (y > 0).sum() > 0.9 and (got == y).mean() > 0.95


def test_personal_data(spark, tagger):
    text = "Mail ann.b@example.org or +1 (212) 555-0199, host 10.0.0.7, card 4111 1111 1111 1111. " + "plain words only " * 400 + "call +44 20 7946 0958 now"
    rows = [(1, text, "s", 1), (2, None, "s", 1), (3, "", "s", 1), (1, text, None, None), (None, "x@y.zz", "s", 1), (4, "é" * 50 + " a@b.cc", "s", 1)]
    got = pii.personal_data(spark.createDataFrame(rows, SCHEMA), tagger).collect()
    assert len(got) == 6
    for r in got:
        text_of = next(t for d, t, *_ in rows if d == r.doc_id) or ""
        base = _brute_pii(text_of)
        written = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in range(4))
    assert pii.personal_data(spark.createDataFrame([], SCHEMA), tagger).count() == 0


def test_tagged_spans_are_those_of_full_coverage(tagger):
    """Windows over the whole of every text, each place tagged by the one in whose middle it stands nearest."""
    g = random.Random(31)
    rows = [t for t, _ in pii.template_rows(120, seed=9)]
    texts = ["", "7", "@", "1" * 700, "a@" * 200] + [(" plain words and more of them " * g.randint(0, 5)).join(g.sample(rows, g.randint(1, 6))) for _ in range(40)]
    want, placed = [], 0
    for t in texts:
        last = max(0, len(t) - pii.WINDOW)
        starts = sorted({*range(0, last, pii.STEP), last})
        x = np.zeros((len(starts), pii.WINDOW), np.int64)
        for k, at in enumerate(starts):
            own = pii.symbols(t[at : at + pii.WINDOW])
            x[k, : len(own)] = own
        tags = tagger.decode(x)
        best = [min((abs(2 * (p - at) - pii.WINDOW), at, k) for k, at in enumerate(starts) if at <= p < at + pii.WINDOW) for p in range(len(t))]
        assert [b[1] for b in best] == pii.owners(np.arange(len(t)), len(t)).tolist()
        own = [int(tags[k][p - at]) for p, (_, at, k) in enumerate(best)]
        spans, p = [], 0
        while p < len(t):
            if own[p]:
                kind, a = (own[p] - 1) // 2, p
                p += 1
                while p < len(t) and own[p] and (own[p] - 1) // 2 == kind and own[p] % 2 == 0:
                    p += 1
                spans.append((kind, a, p))
            else:
                p += 1
        sure = tagger.sure(x, tags)
        likely = [np.mean([sure[best[p][2]][p - best[p][1]] for p in range(a, b)]) for _, a, b in spans]
        want.append([s for s, q in zip(spans, likely, strict=True) if pii._possible(s[0], t[s[1] : s[2]]) and q >= pii.SURE])
        placed += len(want[-1])
    assert placed > 50 and pii.tagged_spans(tagger, texts) == want


def test_posteriors_are_those_of_all_sequences():
    """The likelihood of each tag against the sum over every sequence of tags."""
    import itertools

    t = Tagger(5, 1, 4, 3, seed=2)
    x = np.array([[1, 2, 3, 4], [4, 4, 0, 1]])
    tags = np.array([[0, 1, 2, 0], [1, 2, 2, 0]])
    s, moves = t.scores(x), t._moves()
    for row in range(2):
        weight = {}
        for ways in itertools.product(range(3), repeat=4):
            weight[ways] = np.exp(sum(float(s[k, row, y]) for k, y in enumerate(ways)) + sum(float(moves[a, b]) for a, b in itertools.pairwise(ways)))
        total = sum(weight.values())
        want = [sum(w for ways, w in weight.items() if ways[k] == tags[row, k]) / total for k in range(4)]
        assert np.allclose(t.sure(x, tags)[row], want, atol=1e-4)


def _planted(g, forms, n):
    word = lambda: "".join(g.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(g.randint(2, 9)))
    filled = lambda f: "".join(str(g.randint(0, 9)) if c == "9" else str(g.randint(1, 9)) if c == "8" else c for c in f)
    out = []
    for _ in range(n):
        before, own = " ".join(word() for _ in range(g.randint(3, 14))), filled(g.choice(forms))
        out.append((f"{before} {own}{g.choice([' ', '. ', ', '])}{word()} {word()}", len(before) + 1, len(before) + 1 + len(own)))
    return out


def test_numbers_that_no_pattern_has(spark):
    """Planted phones: of the templates' forms with other digits, and of forms that training never saw; and numbers that are none."""
    tagger = pii.train(spark.createDataFrame([(1, "nothing here 12")], "doc_id long, text string"))
    g = random.Random(12)
    hits = lambda rows: sum(any(k == 3 and a < hi and lo < b for k, a, b in s) for s, (_, lo, hi) in zip(pii.tagged_spans(tagger, [t for t, *_ in rows]), rows, strict=True)) / len(rows)
    assert hits(_planted(g, [f for f in pii.PHONES if f[0] != "+"], 200)) > 0.7
    assert hits(_planted(g, ("00 99 999 9999999", "899 - 999 - 9999", "(099) 9999 9999", "8 (899) 999 9999"), 200)) > 0.4
    assert hits(_planted(g, ("1999-2004", "No. 89999", "8,999,999 km", "88:59:59", "$99.95", "899.999", "899999", "2024/09/89"), 200)) < 0.25
    text = "please call 555-867-5309 now"
    got = pii.personal_data(spark.createDataFrame([(1, text, "s", 1)], SCHEMA), tagger).collect()[0]
    assert got.n_phone == 0 and got.spans == "phone:12:24"


def test_windows_cover_every_trigger():
    g = random.Random(8)
    for _ in range(500):
        text = "".join(g.choice("abcdefg      1") if g.random() < 0.3 else "x" for _ in range(g.randint(1, 600)))
        at = pii.windows_at(text)
        for m in re.finditer("[0-9@]", text):
            assert any(a <= m.start() < a + pii.WINDOW for a in at)


BASE = [("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), lambda m: len(m[1]) >= 12), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16)]


def test_secrets_against_brute_force(spark):
    g = random.Random(5)
    parts = ["password", "PassWd", "secret", "toKen", "api_key", "apikey", "=", ":", " ", "'", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "zz", "é", "ſecret", "\n", "ghp_" + "a" * 36]
    texts = ["".join(g.choice(parts) for _ in range(g.randint(0, 12))) for _ in range(3000)]
    rows = [(k, t, "s", 1) for k, t in enumerate(texts)] + [(5000, None, "s", 1), (None, "AKIA" + "A" * 20, "s", 1)]
    got = secrets_scan.secrets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "" if r.doc_id == 5000 else rows[-1][1] if r.doc_id is None else texts[r.doc_id]
        spans = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))
        written = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest(), repr(text)
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    assert secrets_scan.secrets(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trigram_queries_hold():
    g = random.Random(6)
    patterns = [r.pattern for r in secrets_scan.RULES] + ["ab+c", "(abc|abd)e?f", "a{3}b", "x(?:foo|bar)?yzw", "[ab]cd[ef]", "(?i:HeLLo) w", "a.c", "q?rst", "(ab|c)*def"]
    assert secrets_scan.trigram_query("[0-9a-f]{16,}") == secrets_scan.ANY
    assert secrets_scan.trigrams(secrets_scan.trigram_query("AKIA[A-Z0-9]+")) == {b"aki", b"kia"}
    texts = ["".join(g.choice("abcdefrstxyzw HhEeLlOo") for _ in range(g.randint(0, 30))) for _ in range(4000)] + ["hello w", "HELLO w", "abcef", "xfooyzw", "xyzw", "token: 'abcdefabcdef1'"]
    for p in patterns:
        query, expression = secrets_scan.trigram_query(p), re.compile(p, re.A)
        index = secrets_scan.Index(texts, secrets_scan.trigrams(query))
        found = set(index.find(query).tolist())
        assert {k for k, t in enumerate(texts) if expression.search(t)} <= found, p
