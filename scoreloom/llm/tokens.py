"""Exact token ids of whole texts, word by word.

A text is cut only where no token can lie across the cut (see each class), so the ids of the whole text
are the ids of its pieces in order. Arrow splits a batch and numbers its distinct words; only these are
looked up in the worker's vocabulary, only the ones it lacks are encoded by the tokenizer's own library
(many in one call), and runs of ids are gathered by numpy. The vocabulary is bounded in words and bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Words and bytes of words that a worker keeps; the vocabulary starts anew when either is reached.
CACHE_WORDS, CACHE_BYTES = 600_000, 12 << 20
#: Longer words are cut at safe places inside, where there are any, into calls of about this many characters.
LONG = 1 << 14

_LINES = 256
_OPEN = kept()  # (kind, path) -> encoder


class _Pool:
    """word -> run of numbers, kept in one array."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.size = 0
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def add(self, words: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        """The runs of `words`, which stand in `ids` one after the other."""
        at, n = len(self.place), len(words)
        self.start, self.length = self._room(self.start, at + n), self._room(self.length, at + n)
        self.ids = self._room(self.ids, self.used + len(ids))
        self.length[at : at + n] = lengths
        self.start[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.place.update(zip(words, range(at, at + n), strict=True))
        self.size += sum(map(len, words))

    def find(self, words: np.ndarray) -> np.ndarray:
        get = self.place.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))


class _Words:
    """Texts as lists of words, and the runs of these."""

    #: A word that ends in a Latin letter (but for dotted I, which lower-cases to two characters) or digit and some of these is kept as two.
    TAIL = ""

    def __init__(self, kind):
        self.pool = _Pool(kind)
        if self.TAIL:
            self._tailed = f"[A-Za-z0-9À-ÖØ-öø-įı-ɏ][{re.escape(self.TAIL)}]+$"

    def lists(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text (no nulls)."""
        raise NotImplementedError

    def fill(self, words: list[str]) -> None:
        """Add words, none of them known, to the pool."""
        raise NotImplementedError

    def same(self, words: pa.Array) -> pa.Array:
        """Words written alike where their ids are."""
        return words

    def runs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool of each run, end among these of each text)."""
        lists = self.lists(texts)
        ends = np.asarray(lists.offsets, dtype=np.int64)
        ends = ends[1:] - ends[0]
        words = lists.flatten()
        coded = words.dictionary_encode()
        code, names = np.asarray(coded.indices), coded.dictionary
        if not len(names):
            return np.empty(0, np.int64), ends
        tailed = pc.match_substring_regex(names, self._tailed) if self.TAIL else pa.array(np.zeros(len(names), bool))
        cut = names.filter(tailed)
        stem = pc.utf8_rtrim(cut, characters=self.TAIL) if len(cut) else cut
        split = np.flatnonzero(np.asarray(tailed))
        whole = pc.replace_with_mask(names, tailed, stem) if len(cut) else names
        tails = [w[n:] for w, n in zip(cut.to_numpy(zero_copy_only=False), np.asarray(pc.utf8_length(stem)), strict=True)] if len(cut) else []
        parts = pa.concat_arrays([self.same(whole), pa.array([*tails, ""], names.type)]).dictionary_encode()
        known = parts.dictionary.to_numpy(zero_copy_only=False)
        place = self.pool.find(known)
        new = place < 0
        if new.any():
            if len(self.pool.place) + int(new.sum()) > CACHE_WORDS or self.pool.size > CACHE_BYTES:
                self.pool.clear()
                new[:] = True
            self.fill(known[new].tolist())
            place[new] = self.pool.find(known[new])
        of = place[np.asarray(parts.indices)]
        first, second = of[: len(names)], np.full(len(names), -1, np.int64)
        second[split] = of[len(names) : -1]
        both = np.stack([first[code], second[code]], axis=1).ravel()
        keep = both >= 0
        return both[keep], np.concatenate([[0], np.cumsum(keep)])[2 * ends]

    def spread(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's end."""
        place, ends = self.runs(texts)
        size = self.pool.length[place]
        stop = np.cumsum(size)
        at = np.repeat(self.pool.start[place] - stop + size, size)
        at += np.arange(len(at))
        return self.pool.ids[at], np.concatenate([[0], stop])[ends]

    @staticmethod
    def _listed(texts: pa.Array, odd: np.ndarray, easy: pa.ListArray, split) -> pa.ListArray:
        """`easy` (the lists of texts that aren't odd) and split(text) of the others, in the order of texts."""
        if not odd.any():
            return easy
        hard = pa.array([split(t) for t in texts.filter(pa.array(odd)).to_pylist()], easy.type)
        order = np.empty(len(texts), np.int64)
        order[np.flatnonzero(~odd)] = np.arange(len(easy))
        order[np.flatnonzero(odd)] = len(easy) + np.arange(len(hard))
        return pa.concat_arrays([easy, hard]).take(pa.array(order))


def _plain(texts) -> pa.Array:
    texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
    return pc.fill_null(texts.cast(pa.large_string()), "")


def _chunks(word: str, cuts: list[int]) -> list[str]:
    """The word in pieces of about LONG characters, cut at some of the given places."""
    out, lo = [], 0
    for at in cuts:
        if at - lo >= LONG:
            out.append(word[lo:at])
            lo = at
    return [*out, word[lo:]]


class PieceCounts(_Words):
    """Token counts of a sentencepiece model with dummy prefix and no normalisation.

    No piece of such a model has the space mark after another character, so a single space between
    two other characters is a safe cut; the dummy prefix stands for the space that is left out. Inside
    a word a cut is safe between two characters that no piece has next to each other.
    """

    CUT = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

    def __init__(self, path: str):
        import sentencepiece

        super().__init__(np.int8)
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.pairs = np.unique(np.array([ord(a) << 21 | ord(b) for p in pieces for a, b in zip(p, p[1:], strict=False)], dtype=np.int64))

    def lists(self, texts):
        odd = np.asarray(pc.match_substring_regex(texts, "^ | $|  |▁"))
        return self._listed(texts, odd, pc.split_pattern(texts.filter(pa.array(~odd)), " "), self.CUT.split)

    def count(self, word: str) -> int:
        if len(word) <= LONG:
            return len(self.model.encode(word, num_threads=1))
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pair = codes[:-1] << 21 | codes[1:]
        safe = (self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] != pair) & (codes[:-1] != 32) & (codes[1:] != 32)
        first, *rest = _chunks(word, (np.flatnonzero(safe) + 1).tolist())
        # a line end has no piece: it is one byte token after the dummy prefix, and parts that from the rest
        return len(self.model.encode(first, num_threads=1)) + sum(len(self.model.encode("\n" + x, num_threads=1)) - 2 for x in rest)

    def fill(self, words):
        for at in range(0, len(words), 20_000):
            part = [w for w in words[at : at + 20_000] if len(w) <= LONG]
            self.pool.add(part, np.array(list(map(len, self.model.encode(part, num_threads=1)))), np.empty(0, np.int8))
        long = [w for w in words if len(w) > LONG]
        self.pool.add(long, np.array([self.count(w) for w in long], dtype=np.int64), np.empty(0, np.int8))

    def counts(self, texts) -> list[int]:
        """The number of tokens of each text."""
        place, ends = self.runs(_plain(texts))
        total = np.concatenate([[0], np.cumsum(self.pool.length[place])])[ends]
        return np.diff(total, prepend=0).tolist()


class _Ids(_Words):
    #: No match of either pattern lies across these: letters and digits, and ideographs and their punctuation.
    INSIDE = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[、。，！？])(?=[一-鿿ぁ-ゖ])")
    TAIL = '.,!?;:&$#%@*()"+=/-'

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        super().__init__(self.kind)

    def whole(self, word: str) -> str:
        return word

    def plain(self, word: str) -> bool:
        return "<" not in word or not any(s in word for s in self.special)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=self.kind) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def alone(self, words: list[str]) -> None:
        for at in range(0, len(words), 5_000):
            part = [w for w in words[at : at + 5_000] if len(w) <= LONG]
            ids = self._library([self.whole(w) for w in part])
            self.pool.add(part, np.array([len(x) for x in ids], dtype=np.int64), np.concatenate([*ids, np.empty(0, self.kind)]))
        for w in words:
            if len(w) > LONG:
                text = self.whole(w)
                ids = np.concatenate([x for c in _chunks(text, [m.start() for m in self.INSIDE.finditer(text)]) for x in self._library([c])])
                self.pool.add([w], np.array([len(ids)]), ids)

    def together(self, words: list[str], join: str, ends) -> list[str]:
        """Encode lines of many words each; `ends` gives where the words' runs end and how many ids part them.

        Returns the words of lines that did not come apart into as many words.
        """
        left: list[str] = []
        lines = [words[at : at + _LINES] for at in range(0, len(words), _LINES)]
        for at in range(0, len(lines), 64):
            part = lines[at : at + 64]
            for line, ids in zip(part, self._library([join.join(map(self.whole, x)) for x in part]), strict=True):
                stop, skip = ends(ids)
                if len(stop) != len(line):
                    left += line
                    continue
                keep = np.ones(len(ids), dtype=bool)
                if skip:
                    keep[stop[:-1]] = False
                lows = np.concatenate([[0], stop[:-1] + skip])
                self.pool.add(line, stop - lows, ids[keep])
        return left

    def closed(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each followed by `end`, and where each text's end."""
        ids, ends = self.spread(_plain(texts))
        return np.insert(ids, ends, end), ends + np.arange(1, len(ends) + 1)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed little-endian in the width of self.kind."""
        ids, ends = self.spread(_plain(texts))
        return [x.tobytes() for x in np.split(ids, ends[:-1])] if len(ends) else []


class ByteIds(_Ids):
    """Byte-level BPE whose pattern takes one space into the word after it.

    A space between two characters that are no white space starts a new match of the pattern, and so
    does a line end between two such characters, and a mark of TAIL after a letter or number; all are safe
    cuts. Words are kept with what comes before them: FIRST (no character) for a text's first word, a line
    end, or (no sign) a space.
    """

    FIRST, TAIL_OF = "\ufdd0", "\ufdd1"
    CUT = re.compile(r"(?<=\S) (?=\S)")
    SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
    ODD = rf"^[ \n]|[ \n]$|  |\n\n| \n|\n |[{SPACES}\x{{fdd0}}\x{{fdd1}}]"

    def _split(self, text: str) -> list[str]:
        if self.FIRST in text or self.TAIL_OF in text:
            return [self.FIRST + text]
        words = self.CUT.split(text)
        words[0] = self.FIRST + words[0]
        return words if text else []

    def lists(self, texts):
        odd = np.asarray(pc.match_substring_regex(texts, self.ODD)) | (np.asarray(pc.binary_length(texts)) == 0)
        easy = pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n")
        marked = pc.binary_join_element_wise(pa.scalar(self.FIRST, pa.large_string()), easy, pa.scalar("", pa.large_string()))
        return self._listed(texts, odd, pc.split_pattern(marked, " "), self._split)

    def whole(self, word):
        if word.startswith(self.FIRST):
            return word[1:]
        if word.endswith(self.TAIL_OF):
            return " " + word[:-1]
        return word if word.startswith("\n") and len(word) > 1 and not word[1].isspace() else " " + word

    def fill(self, words):
        tails = {w for w in words if w and not w.strip(self.TAIL)}
        easy, hard = [], []
        for w in words:
            if w not in tails and w:
                (easy if w.split() == [w] and self.plain(w) else hard).append(w)
        newline = self.kind.type(self.model.encode("\n", add_special_tokens=False).ids[0])

        def ends(ids):
            return np.concatenate([np.flatnonzero(ids == newline), [len(ids)]]), 1

        self.alone(hard + self.together(easy, "\n", ends))
        bare = sorted(tails | ({""} & set(words)))
        ids = self._library(bare)
        self.pool.add(bare, np.array([len(x) for x in ids], dtype=np.int64), np.concatenate([*ids, np.empty(0, self.kind)]))

    def same(self, words):
        """Words of TAIL alone stand after a space: TAIL_OF tells them from tails, which don't."""
        alone = pc.match_substring_regex(words, rf"^[{re.escape(self.TAIL)}]+$")
        return pc.if_else(alone, pc.binary_join_element_wise(words, pa.scalar(self.TAIL_OF, words.type), pa.scalar("", words.type)), words)


class WordIds(_Ids):
    """BPE with word ends that drops white space and never joins across it: every space or line end is a safe cut,
    and so is a mark of TAIL after a letter or number. A-Z is lower-cased by the tokenizer in any case."""

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.model.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def lists(self, texts):
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")

    def same(self, words):
        special = pc.match_substring(words, "<")
        return pc.if_else(special, words, pc.ascii_lower(words)) if pc.any(special).as_py() else pc.ascii_lower(words)

    def fill(self, words):
        easy, hard = [], []
        for w in words:
            (easy if w.isalpha() and w.lower().isalpha() else hard).append(w)

        def ends(ids):
            return np.flatnonzero(self.last[ids]) + 1, 0

        self.alone(hard + self.together(easy, " ", ends))


def opened(kind: str, path: str):
    """The worker's encoder of this kind ('piece', 'byte' or 'word'), opened once."""
    if (kind, path) not in _OPEN:
        _OPEN[kind, path] = {"piece": PieceCounts, "byte": ByteIds, "word": WordIds}[kind](path)
    return _OPEN[kind, path]
