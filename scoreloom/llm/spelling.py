"""Spelling variants: words that one edit turns into more frequent ones.

A word's mask has a bit for each letter that it holds an odd number of times; one edit flips at most two bits. The
mask is cut into three bands, so one band at least stays as it is, and two if a letter was put in or taken out.
Words whose bands are equal meet, if their lengths allow it. A band alone is shared by too many words of a large
vocabulary: a group is therefore split, without a loss, by the mask of that part of the word which the edit left
alone, which is either what is before the middle or what is behind it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, picked, rows_in, staged

#: Fixed values of the contract: one in DROP (word, document) pairs loses a letter; least letters and occurrences; ratio of a form.
DROP, LETTERS, TIMES, RATIO = 97, 5, 3, 2
BANDS, BITS = 3, 20
#: Distinct words that a worker counts before it passes them on, and their characters; text taken at a time.
HELD, HELD_CHARS, PART = 400_000, 8 << 20, 1 << 20

#: How tables that grow with the vocabulary are joined. Spark would broadcast one by the size of its compressed file, which says
#: little of its rows, and nothing of those that an explode makes of them.
SORTED = "merge"

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: crc32 goes on over a zero byte: table of the standard polynomial.
_TABLE = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], dtype=np.uint32)


class _Words(dict):
    """Number of each distinct run, as it is written, and what is known of its lower-cased form."""

    def __init__(self):
        self.clear()

    def clear(self):
        super().clear()
        self.of: dict[str, int] = {}
        self.text: list[str] = []
        self.crc: list[int] = []
        self.bytes: list[int] = []
        self.chars = 0

    def __missing__(self, run: str) -> int:
        low = run.lower() if run.isascii() else run.translate(_LOWER)
        number = self.of.get(low)
        if number is None:
            data = low.encode()
            number = self.of[low] = len(self.text)
            self.text.append(low)
            self.crc.append(zlib.crc32(data))
            self.bytes.append(len(data))
        self[run] = number
        self.chars += len(run)
        return number


def parts(text: str, limit: int = PART):
    """The text in parts of about `limit` characters that cut no run."""
    lo = 0
    while len(text) - lo > limit:
        hi = lo + limit
        if (inside := _RUN.match(text, hi)) and _RUN.match(text, hi - 1):
            hi = inside.end()
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def advanced(crc: np.ndarray, most: int) -> np.ndarray:
    """[n, k]: what a crc32 contributes to that of its text followed by n further bytes."""
    out = np.empty((most + 1, len(crc)), dtype=np.uint32)
    out[0] = crc
    for n in range(most):
        out[n + 1] = _TABLE[out[n] & 255] ^ (out[n] >> 8)
    return out


def shortened(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def counted(batches, drop: int = DROP, letters: int = LETTERS, held: int = HELD):
    """Partial counts (word, n) of the documents' words, letters taken out where the hash says so."""
    words, counts, odd = _Words(), np.zeros(0, dtype=np.int64), {}

    def flush():
        total = dict(odd)
        for k in np.flatnonzero(counts[: len(words.text)]).tolist():
            if len(words.text[k]) >= letters:
                total[words.text[k]] = total.get(words.text[k], 0) + int(counts[k])
        words.clear()
        odd.clear()
        counts[:] = 0
        return pa.RecordBatch.from_pydict({"word": list(total), "n": list(total.values())}, pa.schema([("word", pa.string()), ("n", pa.int64())]))

    for batch, texts in rows_in(batches):
        for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            prefix = zlib.crc32(b":" if doc is None else b"%d:" % doc)
            for part in parts(text):
                at = np.fromiter(map(words.__getitem__, _RUN.findall(part)), dtype=np.int64)
                if not len(at):
                    continue
                if len(counts) < len(words.text):
                    counts = np.concatenate([counts, np.zeros(len(words.text), dtype=np.int64)])
                here, n = np.unique(at, return_counts=True)
                size = np.array([words.bytes[k] for k in here.tolist()])
                crc = np.array([words.crc[k] for k in here.tolist()], dtype=np.uint32)
                most = min(64, int(size.max()))
                h = advanced(np.array([prefix], dtype=np.uint32), most)[np.minimum(size, most), 0] ^ crc
                for k in np.flatnonzero(size > most).tolist():
                    h[k] = zlib.crc32(words.text[here[k]].encode(), prefix)
                struck = h.astype(np.int64) % drop == 0
                counts[here[~struck]] += n[~struck]
                for k in np.flatnonzero(struck).tolist():
                    word = shortened(words.text[here[k]], int(h[k]))
                    if len(word) >= letters:
                        odd[word] = odd.get(word, 0) + int(n[k])
                if len(words) + len(odd) > held or words.chars > HELD_CHARS:
                    yield flush()
    yield flush()


def masks(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Letter parities of stretches of code points, 20 bits in each of three bands."""
    bit = np.uint64(1) << ((codes % BANDS) * BITS + codes // BANDS % BITS).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(bit)]) if len(bit) else np.zeros(1, dtype=np.uint64)
    return sums[ends] ^ sums[starts]


def keyed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mask of each word, and the keys under which it meets others: as the shorter (or equal) one, and as the longer (or equal) one."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    whole = masks(codes, starts, ends)
    band = [(whole >> np.uint64(b * BITS)) & np.uint64((1 << BITS) - 1) for b in range(BANDS)]

    def key(kind: int, length, side: int, part, *bits):
        with np.errstate(over="ignore"):
            out = mix(part + np.uint64(kind * 64 + side) * np.uint64(0x9E3779B97F4A7C15))
            for x in (length.astype(np.uint64), *bits):
                out = mix(out ^ (x + np.uint64(0x632BE59BD9B4E019)))
        return out.astype(np.int64)

    half = starts + size // 2
    same = [key(b, size, side, part, band[b]) for side, part in enumerate((masks(codes, starts, half), masks(codes, half, ends))) for b in range(BANDS)]

    def grown(length):
        """Keys with words of one letter more or less; `length` is the shorter one's. Two bands stay."""
        h = length // 2
        sides = (masks(codes, starts, starts + h), masks(codes, ends - (length - h), ends))
        return [key(8 + b, length, side, part, *[band[x] for x in range(BANDS) if x != b]) for side, part in enumerate(sides) for b in range(BANDS)]

    return whole, np.stack(same + grown(size), axis=1), np.stack(same + grown(size - 1), axis=1)


def met(batches):
    """word, n, mask, short (keys), long (keys) for batches of word, n."""
    keys = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.int64()))
    for batch in batches:
        if batch.num_rows:
            mask, short, long = keyed(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask.astype(np.int64)), keys(short), keys(long)], ["word", "n", "mask", "short", "long"])


def vocabulary(docs: DataFrame, drop: int = DROP, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """word, n: distinct words of enough letters and occurrences, counted over all documents."""
    rows = picked(docs, doc_id="long", text="string")
    each = rows.mapInArrow(lambda batches: counted(batches, drop, letters), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= times)


def near_words(words: DataFrame) -> DataFrame:
    """a, na, b, nb: pairs of words (word, n; each once) that one inserted, deleted or replaced code point tells apart, both ways round."""
    found = words.mapInArrow(met, "word string, n long, mask long, short array<long>, long array<long>")
    side = lambda keys, tag: found.select(F.explode(keys).alias("key"), F.col("word").alias(f"w{tag}"), F.col("n").alias(f"n{tag}"), F.col("mask").alias(f"m{tag}"))
    a, b = side("short", "a"), side("long", "b")
    lengths = (F.length("wa") + 1 == F.length("wb")) | ((F.length("wa") == F.length("wb")) & (F.col("wa") < F.col("wb")))
    flipped = F.bit_count(F.col("ma").bitwiseXOR(F.col("mb"))) <= 2
    one = F.levenshtein("wa", "wb", 1) == 1
    pairs = a.hint(SORTED).join(b, "key").filter(lengths & flipped & one).groupBy("wa", "wb").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
    there = F.struct(F.col("wa").alias("a"), F.col("na"), F.col("wb").alias("b"), F.col("nb"))
    back = F.struct(F.col("wb").alias("a"), F.col("nb").alias("na"), F.col("wa").alias("b"), F.col("na").alias("nb"))
    return pairs.select(F.explode(F.array(there, back)).alias("p")).select("p.*")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: where the forms (word, form: not null) lead to, by jumps of doubling length.

    n at least doubles from a word to its form, so there is no circle and the jumps are few.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = staged(now.join(onward.hint(SORTED), now["root"] == onward["at"], "left").select("word", F.coalesce("further", "root").alias("root"), F.col("at").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return now


def variants(docs: DataFrame, drop: int = DROP, letters: int = LETTERS, times: int = TIMES, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: each word with the frequent word that it is a variant of.

    Words are maximal runs of letters (A-Z lower-cased), one letter less where crc32 of `doc_id:word` is divisible by
    `drop`. Null or empty texts have none; a null id is written as nothing; rows that repeat a document count
    again. A form is the near word of largest n (ties: the smallest), if its n is `ratio` times the word's at least. Long
    texts are read in parts that cut no word. No documents give no rows.
    """
    words = staged(vocabulary(docs, drop, letters, times), "vocabulary")
    best = F.min_by(F.struct("b", "nb"), F.struct(-F.col("nb"), "b"))
    near = near_words(words).groupBy("a").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("na").alias("na"))
    near = near.select(F.col("a").alias("word"), "n_near", F.when(F.col("best.nb") >= F.col("na") * ratio, F.col("best")).alias("best"))
    linked = staged(near.select("word", "n_near", F.col("best.b").alias("form"), F.col("best.nb").alias("form_n")), "forms")
    roots = rooted(linked.filter("form is not null").select("word", "form"))
    out = words.join(linked.hint(SORTED), "word", "left").join(roots.hint(SORTED), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
