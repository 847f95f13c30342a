"""Token ids and counts against the libraries; rANS round trips; packing against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from scoreloom.llm import packing, rans, token_binary, token_counts
from scoreloom.llm.tokens import opened

TEXTS = ["", " ", "  a  b ", "a\n\nb", "\n", "\na b\n", "a\tb c d", "İstanbul's don't I'll 123 4.5 <|endoftext|> x<|startoftext|>y", "▁a ▁ b", "é ́x\ńy", "日本語 テキスト　空白", "a\x1cb c", "x \ny", "x\n y", "a\0b \0\0c \0", "ß ſt K ǅ", "!!! ... a.b, c!?d 'se it's", "a " * 50 + "b" * 3000, "trailing \n", "\r\n a\r\nb", "One two. Three! Four?\nFive six seven. " * 200]


def _random_texts(n=400):
    g = random.Random(1)
    parts = list("ab A.,!?'\n\t 12é ́▁İ日-") + [" "] * 8 + ["\n"] * 2 + ["<|endoftext|>", "the", "ing"]
    return ["".join(g.choice(parts) for _ in range(g.randint(1, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(100, None, "x", 1), (3, TEXTS[3], None, 1), (None, "no id", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, start int")


@pytest.mark.parametrize(("kind", "name"), [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")])
def test_ids_are_the_librarys(kind, name):
    own, lib = opened(kind, P.path(name)), Tokenizer.from_file(P.path(name))
    texts = TEXTS + _random_texts()
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, own.kind).tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_counts_are_the_librarys(spark, docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    own = opened("piece", P.path("piece_bpe_32k.model"))
    texts = TEXTS + _random_texts()
    assert own.counts(texts) == [len(lib.encode(t)) for t in texts]
    got = token_counts.token_counts(docs, P.path("piece_bpe_32k.model"), limit=100).collect()
    assert len(got) == len(TEXTS) + 3
    by = {r.doc_id: r for r in got}
    assert (by[100].n_bytes, by[100].n_tokens, by[100].over_limit) == (0, 0, False)
    for k, t in enumerate(TEXTS):
        n = len(lib.encode(t))
        assert (by[k].n_bytes, by[k].n_tokens, by[k].over_limit) == (len(t.encode()), n, n > 100)
    assert token_counts.token_counts(docs.limit(0), P.path("piece_bpe_32k.model")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1000, 70_001])
@pytest.mark.parametrize("kinds", [1, 2, 3000])
def test_rans_round_trip(n, kinds):
    g = np.random.default_rng(n + kinds)
    ids = (g.pareto(1.0, n) * 3).astype(np.int64) % kinds
    table = rans.Table.unpack(rans.Table.of(ids).pack())
    if n:
        assert table.freq.sum() == 1 << rans.BITS and table.freq.min() >= 1
    block = rans.encode(ids, table, lanes=128, every=7)
    assert rans.decode(block, table).tolist() == ids.tolist()
    parts, k = [], 0
    while True:
        try:
            parts.append(rans.decode(block, table, k))
        except IndexError:
            break
        k += 1
    assert np.concatenate(parts).tolist() == ids.tolist()
    for at in (5, len(block) // 2):
        broken = bytearray(block)
        broken[at] ^= 1
        with pytest.raises(rans.Damaged):
            rans.decode(bytes(broken), table)


def _ids(name, texts):
    lib = Tokenizer.from_file(P.path(name))
    return [np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for t in texts]


def test_token_files(spark, docs, tmp_path):
    to = f"file://{tmp_path}/ids"
    token_binary.write(docs, P.path("word_bpe_49k.json"), to, lanes=8, every=3, segment=500)
    got = token_binary.read(spark, to).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, want = 0, []
    for r, ids in zip(rows, _ids("word_bpe_49k.json", [r.text for r in rows]), strict=True):
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    empty = f"file://{tmp_path}/none"
    token_binary.write(docs.limit(0), P.path("word_bpe_49k.json"), empty)
    assert token_binary.read(spark, empty).count() == 0


def test_plan_is_the_best():
    g = random.Random(4)
    for _ in range(200):
        total = g.randint(1, 60)
        at = sorted({0, total, *(g.randint(0, total) for _ in range(20))})
        at = np.array(sorted({*at, *range(0, total, 7)}))
        pen = np.array([0, *(g.choice([0, 1, 5]) for _ in at[1:-1]), 0])[: len(at)]
        cost = {0: 0}
        for j in range(1, len(at)):
            ways = []
            for i in range(j):
                n = int(at[j] - at[i])
                if n <= 16:
                    ways.append(cost[i] + (0 if n in (4, 8, 16) else 16 - n) + int(pen[j]))
            cost[j] = min(ways)
        cuts = packing.plan(at, pen, 16)
        where = {int(p): int(c) for p, c in zip(at, pen, strict=True)}
        got = sum((0 if b - a in (4, 8, 16) else 16 - b + a) + where[b] for a, b in zip(cuts, cuts[1:], strict=False))
        assert got == cost[len(at) - 1]


def test_packing_covers_every_token_once(spark, docs):
    got = packing.packed(docs, P.path("byte_bpe_50k.json")).toPandas()
    rows = docs.collect()
    want = sorted((r.doc_id if r.doc_id is not None else -1, tuple(ids.tolist())) for r, ids in zip(rows, _ids("byte_bpe_50k.json", [r.text for r in rows]), strict=True))
    assert got["length"].sum() == sum(len(w[1]) for w in want)
    by = {}
    for doc, ids in want:
        by.setdefault(doc, ids)
    for r in got.itertuples():
        doc = -1 if r.doc_id != r.doc_id else int(r.doc_id)
        ids = by[doc]
        assert r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert packing.packed(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_runs_without_spaces_come_apart_where_the_library_agrees():
    g = random.Random(41)
    letters = lambda alphabet, n: "".join(g.choice(alphabet) for _ in range(n))
    han = "".join(chr(0x4E00 + k * 7) for k in range(500)) + "、。"
    texts = [letters("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", 120_000), letters(han, 60_000), letters("0123456789abcdef", 80_000), letters("aé́İ'ſ<|endoftext|>5", 60_000), "x" * 40_000, "日本語、テキスト。" * 9_000, "a" + letters("  ab\n", 60_000), "🙂" * 20_000 + "5a" * 20_000]
    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert opened("piece", P.path("piece_bpe_32k.model")).counts(texts) == [len(lib.encode(t)) for t in texts]
    for kind, name in (("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")):
        own, whole = opened(kind, P.path(name)), Tokenizer.from_file(P.path(name))
        for t, got in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(got, own.kind).tolist() == whole.encode(t, add_special_tokens=False).ids, t[:40]


def test_a_full_vocabulary_starts_anew(monkeypatch):
    from scoreloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    own, lib = tokens.ByteIds(P.path("byte_bpe_50k.json")), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for at in range(0, 400, 20):
        texts = _random_texts()[at : at + 20]
        assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.pool.place) < 500


def test_long_documents_are_cut_and_written_whole(spark, tmp_path):
    """Documents of more tokens than a window and than what is planned at once; a very long one takes a segment of its own."""
    g = random.Random(43)
    words = ["".join(g.choice("abcdefgh") for _ in range(g.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(g.choice(words) + g.choice(["", "", "", "."]) for _ in range(n))
    texts = [text(n) for n in (5, 3_000, 200_000, 10, 9_000, 1)] + ["one two three four. " * 2_000, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = packing.packed(docs, P.path("byte_bpe_50k.json")).toPandas()
    ids = _ids("byte_bpe_50k.json", texts)
    assert max(map(len, ids)) > packing.PLAN and got["length"].max() <= 2048
    for k, own in enumerate(ids):
        pieces = got[got["doc_id"] == k].sort_values("start")
        assert pieces["start"].tolist() == [0, *pieces["length"].cumsum().tolist()[:-1]] and pieces["length"].sum() == len(own) and set(pieces["doc_tokens"]) == {len(own)}
        assert all(zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces.itertuples())
    padding = 0
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        n = int(s["length"].sum())
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]] and n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    assert padding < 0.05 * sum(map(len, ids))
    to = f"file://{tmp_path}/long"
    token_binary.write(docs, P.path("word_bpe_49k.json"), to, segment=20_000)
    rows = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_binary.read(spark, to).collect()}
    start = 0
    for k, own in enumerate(_ids("word_bpe_49k.json", texts)):
        assert rows[k] == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    files = sorted(p.name for p in (tmp_path / "long").glob("part-*"))
    held = [r["doc_ids"] for f in files for r in spark.read.parquet(f"{to}/{f}").select("doc_ids").collect()]
    assert [d for own in held for d in own] == sorted(range(len(texts)))
