"""Toxicity: a linear classifier on character n-grams, each scaled by its naive Bayes log-count ratio.

Training takes at most `rows` labelled texts (in order of a hash of their id): executors count in how
many texts of each class each hashed n-gram occurs, the buckets that part the classes best are kept, and
a logistic regression with L2 penalty is fitted on presence times log-count ratio. Scoring looks at all
n-grams of whole texts. Nothing but the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _powers, begin, cut, picked, positional, rows_in, ship

#: Labelled rows that are learned from at most, and features kept at most.
TRAIN_ROWS, FEATURES = 24_000, 4096
SIZES = (4, 5, 6)
BUCKET_BITS, CHUNK_BITS = 19, 13
#: What parts the classes: buckets in at least SUPPORT texts of which the toxic ones are over DEVIATIONS standard
#: deviations from the classes' share; n-grams in at least GRAM_SUPPORT texts with a log-count ratio of at least RATIO.
SUPPORT, DEVIATIONS, GRAM_SUPPORT, RATIO = 4, 6, 3, 1
#: Characters that are hashed at a time.
STRETCH = 1 << 18
_SPREAD = np.uint64(0xBF58476D1CE4E5B9)
_BLANK = {9: 32, 10: 32, 11: 32, 12: 32, 13: 32}


@dataclass
class Model:
    features: np.ndarray  # hashes, ascending
    weights: np.ndarray
    bias: float

    def prefilter(self) -> np.ndarray:
        held = np.zeros(1 << BUCKET_BITS, dtype=bool)
        held[_bucket(self.features)] = True
        return held


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def parts(texts: list[str]):
    """Batches of (text numbers, stretches): texts lower-cased, line ends and tabs as spaces, a space before and after.

    Stretches of a long text overlap by one character less than the longest n-gram, so together they have
    its n-grams and no others, and a batch is bounded in characters.
    """
    of: list[int] = []
    own: list[str] = []
    count = 0
    for k, t in enumerate(texts):
        whole = f" {t.lower().translate(_BLANK)} "
        for lo in range(0, max(1, len(whole) - max(SIZES) + 1), STRETCH):
            of.append(k)
            own.append(whole[lo : lo + STRETCH + max(SIZES) - 1])
            count += len(own[-1])
            if count >= STRETCH:
                yield np.array(of), own
                of, own, count = [], [], 0
    if own:
        yield np.array(of), own


def grams(stretches: list[str]):
    """For each size: (number of the stretch, hash) of every n-gram; none crosses from one stretch into the next."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in stretches]
    ends = np.cumsum([len(c) for c in codes])
    data = np.concatenate(codes)
    power, back = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(7)) * power[: len(data)], out=sums[1:])
        for n in SIZES:
            if len(data) >= n:
                h = (sums[n:] - sums[:-n]) * back[: len(data) - n + 1]
                h ^= h >> np.uint64(29)
                h *= _SPREAD
                yield h, n, ends


def hits(texts: list[str], held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the n-grams in held buckets, each pair once."""
    doc, gram = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for of, own in parts(texts):
        for h, n, ends in grams(own):
            at = np.flatnonzero(held[_bucket(h)])
            d = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[d]
            doc.append(of[d[inside]])
            gram.append(h[at[inside]])
    d, g = np.concatenate(doc), np.concatenate(gram)
    order = np.lexsort((g, d))
    d, g = d[order], g[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
    return d[new], g[new]


def gram_buckets(texts: list[str]):
    """(text, its buckets, each once) of every text, in order; no n-grams are sorted."""
    last = np.zeros(1 << BUCKET_BITS, dtype=np.int64)  # where a bucket was written last
    text, held = -1, []
    for of, own in parts(texts):
        found = [(_bucket(h), n) for h, n, _ in grams(own)]
        stop = np.cumsum([len(t) for t in own]).tolist()
        for k, t, end in zip(of.tolist(), own, stop, strict=True):
            b = np.concatenate([x[end - len(t) : max(end - len(t), end - n + 1)] for x, n in found] or [np.empty(0, np.int64)])
            place = np.arange(len(b))
            last[b] = place
            if k != text:
                if held:
                    yield text, held[0] if len(held) == 1 else np.unique(np.concatenate(held))
                text, held = k, []
            held.append(b[last[b] == place])
    if held:
        yield text, held[0] if len(held) == 1 else np.unique(np.concatenate(held))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, features: int = FEATURES) -> Model:
    """Learn from `labels` (doc_id, toxic 0/1; null or other labels and null ids are left out) and the texts of `docs`.

    Without texts of both classes the model is the constant share of toxic texts (0.5 without any).
    """
    spark = docs.sparkSession
    ship(spark)
    ids = picked(labels, doc_id="long", toxic="int").filter("doc_id is not null and toxic in (0, 1)")
    ids = cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))
    texts = picked(docs, doc_id="long", text="string")
    sample = texts.join(F.broadcast(ids), "doc_id").select("text", "toxic")  # at most `rows` pairs of numbers are sent
    size = 1 << BUCKET_BITS

    def count(batches):
        begin()
        n = np.zeros((2, size), dtype=np.int32)
        total = np.zeros(2, dtype=np.int64)
        for part, own in rows_in(batches):
            toxic = np.asarray(part.column("toxic"))
            total += np.bincount(toxic, minlength=2)
            for k, own_buckets in gram_buckets(own):
                n[toxic[k], own_buckets] += 1
        if total.any():
            chunks = n.reshape(2, -1, 1 << CHUNK_BITS).transpose(1, 0, 2)
            for lo in range(0, len(chunks), 8):
                part = chunks[lo : lo + 8]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(lo, lo + len(part)), pa.int32()), pa.array([c.tobytes() for c in part], pa.binary()), pa.array([total.tolist()] * len(part), pa.list_(pa.int64()))],
                    ["chunk", "counts", "total"],
                )

    keep = max(1, features * 2 * (1 << CHUNK_BITS) // size * 4)

    def choose(pdf):
        import pandas as pd

        n = np.sum([np.frombuffer(c, np.int32).reshape(2, -1) for c in pdf["counts"]], axis=0, dtype=np.int64)
        total = np.sum(np.stack(pdf["total"].to_list()), axis=0)
        share = total[1] / max(1, total.sum())
        support = n.sum(axis=0)
        z = (n[1] - support * share) / np.sqrt(np.maximum(support * share * (1 - share), 1e-9))
        z[support < SUPPORT] = 0
        top = np.argsort(-np.abs(z), kind="stable")[:keep]
        top = top[np.abs(z[top]) > DEVIATIONS]
        base = int(pdf["chunk"].iloc[0]) << CHUNK_BITS
        return pd.DataFrame({"bucket": [(base + top).tolist()], "z": [z[top].tolist()], "total": [total.tolist()]})

    best = sample.mapInArrow(count, "chunk int, counts binary, total array<long>").groupBy("chunk").applyInPandas(choose, "bucket array<int>, z array<double>, total array<long>").collect()
    total = best[0]["total"] if best else [0, 0]
    share = total[1] / sum(total) if sum(total) else 0.5
    empty = Model(np.empty(0, np.uint64), np.empty(0), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    z = np.array([x for r in best for x in r["z"]])
    buckets = np.array([x for r in best for x in r["bucket"]], dtype=np.int64)
    if not len(z) or not all(total):
        return empty
    held = np.zeros(size, dtype=bool)
    held[buckets[np.argsort(-np.abs(z), kind="stable")[:features]]] = True

    def lists(batches):
        begin()
        for part, own in rows_in(batches):
            d, g = hits(own, held)
            cuts = np.searchsorted(d, np.arange(len(own) + 1))
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array([g[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["toxic", "grams"])

    got = sample.mapInArrow(lists, "toxic int, grams binary").collect()
    y = np.array([r["toxic"] for r in got], dtype=np.float64)
    parts = [np.frombuffer(r["grams"], np.uint64) for r in got]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    names, col = np.unique(np.concatenate(parts), return_inverse=True)
    n1, n0 = np.bincount(col[y[row] == 1], minlength=len(names)), np.bincount(col[y[row] == 0], minlength=len(names))
    ratio = np.log((n1 + 1) / (y.sum() + 2)) - np.log((n0 + 1) / ((1 - y).sum() + 2))
    kept = (n1 + n0 >= GRAM_SUPPORT) & (np.abs(ratio) >= RATIO)  # weak ones add up over long texts
    ratio[~kept] = 0
    w, bias = fit(row, col, ratio, y, len(names))
    use = kept & (w * ratio != 0)
    return Model(names[use], (w * ratio)[use], bias)


def fit(row, col, ratio, y, width: int, l2: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on presence times ratio, by Adam over all rows, from zero: the same result each time."""
    w, bias = np.zeros(width), float(np.log(y.mean() / (1 - y.mean())))
    m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
    x = ratio[col]
    for t in range(1, rounds + 1):
        z = np.clip(bias + np.bincount(row, weights=x * w[col], minlength=len(y)), -40, 40)
        gap = (1 / (1 + np.exp(-z)) - y) / len(y)
        g, gb = np.bincount(col, weights=x * gap[row], minlength=width) + l2 * w, gap.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = 0.05 / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= step * mb / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, float(bias)


def score(model: Model, texts: list[str], held: np.ndarray) -> np.ndarray:
    z = np.full(len(texts), model.bias)
    if len(model.features):
        d, g = hits(texts, held)
        k = np.minimum(np.searchsorted(model.features, g), len(model.features) - 1)
        same = model.features[k] == g
        z += np.bincount(d[same], weights=model.weights[k[same]], minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, from 0 to 1, of each row's text (null: empty)."""
    held = model.prefilter()

    def run(batches):
        begin()
        for part, texts in rows_in(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(model, texts, held))], ["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs whose score is under the threshold, all columns as they are; learns like toxicity().

    Columns are addressed by place, so extra ones may have any name; rows with a null id are scored like
    others. Where the labels teach nothing (none, or of one class) no row is rejected.
    """
    model = train(docs, learnt(labels), rows)
    if not len(model.features):
        return docs
    held = model.prefilter()
    plain, at = positional(docs)

    def run(batches):
        begin()
        for part, texts in rows_in(batches, at["text"]):
            yield part.filter(pa.array(score(model, texts, held) < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def learnt(labels: DataFrame) -> DataFrame:
    """The labels (doc_id, toxic) that may be learned from."""
    return picked(labels, doc_id="long", toxic="int").filter(~held_out())


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs; learns from labels that are not held out.

    Null texts count as empty; a null id is not held out; repeated rows are scored alike; an empty table
    of documents gives an empty result; other columns of either table are not read.
    """
    model = train(docs, learnt(labels), rows)
    out = scored(picked(docs, doc_id="long", text="string"), model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
