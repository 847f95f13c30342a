"""Texts of megabytes through the scans and the pipeline, and the secret rules that are added, against brute force."""

import hashlib
import random
import re

import corpus_pipeline as C
from scoreloom.llm import common, decontaminate, fingerprints, line_dedup, secrets_scan, token_binary

SCHEMA = "doc_id long, text string, source string, n_chars long"


def _words(g, n):
    return [("".join(g.choice("abcdefgé") for _ in range(g.randint(2, 7)))) for _ in range(n)]


def _spans(text):
    """All rules by plain search, without an index."""
    found = sorted((m.start(), k, m.end()) for k, r in enumerate(secrets_scan.RULES) for m in re.finditer(r.pattern, text, re.ASCII) if r.check is None or r.check(m))
    return ",".join(f"{secrets_scan.RULES[k].kind}:{a}:{b}" for a, k, b in found)


def test_all_rules_against_plain_search(spark):
    """Planted secrets of every kind, base and added, whole and damaged, alone and side by side."""
    g = random.Random(15)
    made = [
        "-----BEGIN PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN  KEY-----", "-----begin private key-----", "ghp_" + "aB3" * 12, "ghx_" + "a" * 40, "gho_" + "z" * 35, "xoxb-" + "1-a" * 5, "xoxz-123456789012", "xoxp-12",
        "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh-_", "eyJhbGciOiJI.eyJz.abc", "https://user:secretpw@host.org/x", "ftp+x://a:bcd@h", "https://user:pw@h", "http://host:80/a@b", "token = 'abcdefghijklmnop'", "AKIA" + "Z9" * 10, "0123456789abcdef01",
    ]
    texts = ["".join(g.choice([*made, " ", "\n", "é", "x", "_", "-"]) for _ in range(g.randint(1, 9))) for _ in range(800)] + made
    got = secrets_scan.secrets(spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], SCHEMA).repartition(3)).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {k: _spans(t) for k, t in enumerate(texts)}
    kinds = {s.split(":")[0] for r in got for s in r["spans"].split(",") if s}
    assert kinds == {r.kind for r in secrets_scan.RULES}


def test_secrets_of_a_long_text(spark):
    g = random.Random(1)
    filler = " ".join(_words(g, 200_000))
    text = f"password: abcdefghijkl {filler} AKIA{'Q' * 20} {filler} ghp_{'a' * 36}"
    assert len(text) > 2 << 20
    got = secrets_scan.secrets(spark.createDataFrame([(1, text, "s", 1), (2, "k" * (1 << 20), "s", 1)], SCHEMA)).collect()
    assert {r["doc_id"]: r["spans"] for r in got} == {1: _spans(text), 2: ""}
    assert _spans(text).count(":") == 8  # the run of a is hex as well


def test_lines_of_a_long_text(spark):
    """A page of a hundred thousand lines, and one line of two megabytes."""
    g = random.Random(2)
    lines = [" ".join(_words(g, 6)) for _ in range(100_000)]
    docs = [(1, "\n".join(lines), "s", 1), (2, "x" * (2 << 20), "s", 1)] + [(k, f"page {k}\nthe same footer here", "s", 1) for k in range(3, 9)]
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(docs, SCHEMA).repartition(2)).collect()}
    assert out[1] == docs[0][1] and out[2] == docs[1][1]
    assert all("footer" not in out[k] and f"page {k}" in out[k] for k in range(3, 9))


def test_decontamination_of_a_long_text(spark):
    """Passages at both ends and across the places where a long text is taken apart."""
    g = random.Random(3)
    passage = " ".join(_words(g, 20))
    words = _words(g, 240_000)
    text = " ".join(words)
    parts = list(common.alnum_parts(text))
    assert len(parts) > 1 and [w for p in parts for w in p] == common.alnum_words(text)
    across = len(parts[0])  # a word's place
    long = " ".join([passage, *words[: across - 30], passage, *words[across - 30 :], passage])
    docs = [(1, long, "s", 1), (2, passage, "s", 1), (3, "nothing of it", "s", 1)]
    items = [(5, passage), (6, "quite another passage of words that no document has in it at all here")]
    got = {r["doc_id"]: r for r in decontaminate.contamination(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    digest = hashlib.sha256(b"5").hexdigest()
    assert [(got[k]["n_words"], got[k]["n_hit"], got[k]["n_items"], got[k]["items_sha256"], got[k]["contaminated"]) for k in (1, 2)] == [(240_060, 60, 1, digest, False), (20, 20, 1, digest, True)]
    assert got[3]["n_hit"] == 0


def test_fingerprints_of_a_long_text(spark):
    g = random.Random(4)
    text = " ".join(_words(g, 120_000))
    docs = [(1, text, "s", 1), (2, text, "s", 1), (3, "short text", "s", 1), (4, " ".join(_words(g, 120_000)), "s", 1)]
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(spark.createDataFrame(docs, SCHEMA).repartition(2)).collect()}
    assert got[1]["n_chars"] == len(text) and got[1]["fingerprint"] == got[2]["fingerprint"] != got[4]["fingerprint"]
    assert got[1]["near_next"] == 1 and got[3]["near_next"] < 0.1
    half = len(text) - len(text) // 2
    assert got[1]["edited_sha256"] == hashlib.sha256((text[:half] + text[: len(text) // 2]).encode()).hexdigest()


def test_a_long_text_goes_through_the_pipeline(spark, tmp_path):
    """It is kept whole: its pieces hold all of its tokens, in order, each once."""
    g = random.Random(5)
    long = ". ".join(" ".join(_words(g, 12)) for _ in range(8_000))
    docs = [(k, " ".join(_words(g, 40)), "en", "s", 1) for k in range(20)] + [(99, long, "en", "s", len(long)), (100, long + " and one more", "en", "s", len(long))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = C.run(spark, f"{tmp_path}").collect()
    assert {r["doc_id"] for r in rows} == {*range(20), 99}
    own = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == 99)
    at = 0
    for start, length, total in own:
        assert start == at
        at += length
    assert at == own[0][2] > 96_000


def test_a_long_text_among_coded_ids(spark, tmp_path):
    """One document of more tokens than a segment holds."""
    import public_tokenizers
    from tokenizers import Tokenizer

    g = random.Random(6)
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["short", " ".join(_words(g, 60_000)), "", "end"]
    to = f"file://{tmp_path}/ids"
    token_binary.write(spark.createDataFrame([(k, t, "s", 1) for k, t in enumerate(texts)], SCHEMA), to=to, path=path, segment=1000)
    got = sorted(token_binary.read(spark, to).collect())
    whole = Tokenizer.from_file(path)
    sizes = [len(whole.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in got] == [(k, sum(sizes[:k]), n) for k, n in enumerate(sizes)]
