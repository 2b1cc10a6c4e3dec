"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A
word's probability is the sum, over all its segmentations into pieces, of the
products of their probabilities (forward algorithm); a text's is the product
over its words, and the languages' posteriors give prediction and score. Piece
probabilities are fitted by expectation maximisation (forward-backward) on the
word counts of a bounded sample of labelled documents.

Words are runs of letters of the lower-cased text, with the vocabulary's word
mark in front, and pieces are those of letters, of any length; a letter outside
the vocabulary has a small fixed probability. Words over ``SPAN`` letters are
scored one by one with running rescaling, by the same sum; the fit counts the
sample's words of up to that length.

Defined results: a null text or one without a letter is ``und`` with score 0;
without any training row every text with letters is ``und`` with score 0; equal
texts get equal results; on equal posteriors the first language by name wins.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import map_batches, slices

VOCABULARY = os.environ.get("KINFORGE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
SPAN = 40
#: Positions of a long word that are looked up at once.
STRETCH = 1 << 15
OUTSIDE = 1e-7
#: Labelled documents for the fit, whole, at most about this many a language.
SAMPLE_DOCS = 400
CACHE_WORDS = 300_000
#: Words that are scored at once, with all pieces of all their positions.
BLOCK_WORDS = 2048
_MULT = np.uint64(0x9E3779B97F4A7C15)


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """All pieces of letters, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if LETTERS.fullmatch(p.removeprefix(MARK)))


def _mix(code: np.ndarray, char: np.ndarray) -> np.ndarray:
    return (code + char + np.uint64(1)) * _MULT


def _keys(pieces: list[str]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, piece in enumerate(pieces):
        code = np.zeros(1, np.uint64)
        for c in piece:
            code = _mix(code, np.array([ord(c)], np.uint64))
        out[i] = code[0]
    return out


@dataclass
class Lattice:
    """All pieces of all positions of a batch of equally handled words."""

    keys: np.ndarray  # sorted hashes of the pieces
    order: np.ndarray  # piece numbers in that order
    n_pieces: int
    longest: int

    @classmethod
    def of(cls, pieces: list[str]) -> Lattice:
        keys = _keys(pieces)
        order = np.argsort(keys)
        return cls(keys[order], order, len(pieces), max(map(len, pieces), default=1))

    def pieces_of(self, chars: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(words, positions, piece lengths) piece number, n_pieces for none of that
        length, n_pieces + 1 for a single character outside the vocabulary."""
        words, width = chars.shape
        deep = min(self.longest, width)
        out = np.full((words, width, deep), self.n_pieces, np.int32)
        code = np.zeros((words, width), np.uint64)
        for k in range(deep):
            span = width - k
            code[:, :span] = _mix(code[:, :span], chars[:, k:])
            look = code[:, :span].reshape(-1)
            at = np.minimum(np.searchsorted(self.keys, look), len(self.keys) - 1)
            hit = self.keys[at] == look
            inside = (np.arange(span)[None, :] + k < sizes[:, None]).reshape(-1)
            found = np.where(hit & inside, self.order[at], self.n_pieces)
            if k == 0:
                found = np.where(~hit & inside, self.n_pieces + 1, found)
            out[:, :span, k] = found.reshape(words, span)
        return out


def _pack(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    flat = np.frombuffer("".join(MARK + w for w in words).encode("utf-32-le"), np.uint32)
    chars = np.zeros((len(words), int(sizes.max(initial=1))), np.uint64)
    chars[np.arange(chars.shape[1])[None, :] < sizes[:, None]] = flat
    return chars, sizes


def _forward(ids: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(width + 1, words, languages) sums over the segmentations of each prefix."""
    words, width, deep = ids.shape
    alpha = np.zeros((width + 1, words, table.shape[1]))
    alpha[0] = 1.0
    for i in range(1, width + 1):
        for k in range(min(i, deep)):
            piece = ids[:, i - 1 - k, k]
            some = np.flatnonzero(piece != table.shape[0] - 2)
            if len(some):
                alpha[i, some] += alpha[i - 1 - k, some] * table[piece[some]]
    return alpha


@dataclass
class Model:
    """Fitted piece probabilities; ``table`` has two more rows, for none and outside."""

    languages: list[str]
    pieces: list[str]
    table: np.ndarray
    _cache: dict[str, int] = field(default_factory=dict, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)
    _lattice: Lattice | None = field(default=None, repr=False)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        self._lattice = self._lattice or Lattice.of(self.pieces)
        out = np.empty((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        while order and len(words[order[-1]]) > SPAN:
            at = order.pop()
            out[at] = self.long_word_score(words[at])
        for lo in range(0, len(order), BLOCK_WORDS):
            part = order[lo : lo + BLOCK_WORDS]
            chars, sizes = _pack([words[i] for i in part])
            alpha = _forward(self._lattice.pieces_of(chars, sizes), sizes, self.table)
            out[part] = np.log(alpha[sizes, np.arange(len(part))])
        return out

    def long_word_score(self, word: str) -> np.ndarray:
        """The same for one word of any length: sums are rescaled before they vanish."""
        self._lattice = self._lattice or Lattice.of(self.pieces)
        chars, sizes = _pack([word])
        n, deep = int(sizes[0]), self._lattice.longest
        ring = np.zeros((deep + 1, len(self.languages)))  # sums of the next positions
        ring[0] = 1.0
        scale = np.zeros(len(self.languages))
        for lo in range(0, n, STRETCH):
            part = chars[:, lo : lo + STRETCH + deep - 1]
            ids = self._lattice.pieces_of(part, np.array([part.shape[1]]))[0]
            for i in range(min(STRETCH, n - lo)):
                mine = ring[0].copy()
                if mine.min() < 1e-200:
                    ring /= mine
                    scale += np.log(mine)
                    mine = ring[0].copy()
                ring[:-1] = ring[1:]
                ring[-1] = 0.0
                found = np.flatnonzero(ids[i] != self._lattice.n_pieces)
                ring[found] += mine * self.table[ids[i][found]]
        return np.log(ring[0]) + scale

    def posteriors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each language for each text, and whether it has letters."""
        counts, flat = [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            flat += words
        if len(self._cache) > CACHE_WORDS:
            self._cache.clear()
            self._scores = None
        new = list({w for w in flat if w not in self._cache})
        if new:
            scores = self.word_scores(new)
            base = len(self._cache)
            self._cache.update(zip(new, range(base, base + len(new)), strict=True))
            self._scores = scores if self._scores is None else np.concatenate([self._scores, scores])
        total = np.zeros((len(texts), len(self.languages)))
        n = np.array(counts)
        if flat:
            ids = np.fromiter(map(self._cache.__getitem__, flat), np.int64, len(flat))
            scores, at = self._scores[ids], 0
            for i, size in enumerate(counts):  # a text's sum does not depend on its neighbours
                total[i] = scores[at : at + size].sum(axis=0)
                at += size
        total -= total.max(axis=1, keepdims=True)
        p = np.exp(total)
        return p / p.sum(axis=1, keepdims=True), n > 0

    def __getstate__(self) -> dict:
        return {"languages": self.languages, "pieces": self.pieces, "table": self.table, "_cache": {}, "_scores": None, "_lattice": None}


def words_of(text: str | None) -> list[str]:
    """Letter runs of the lower-cased text."""
    return LETTERS.findall(text.lower()) if text else []


def fit(counts: dict[str, Counter], pieces: list[str], rounds: int = 4, smooth: float = 0.05) -> Model:
    """Expected piece counts of forward-backward, a few rounds a language."""
    lattice = Lattice.of(pieces)
    languages = sorted(counts)
    size = len(pieces)
    table = np.zeros((size + 2, len(languages)))
    for at, language in enumerate(languages):
        words = sorted((w for w in counts[language] if len(w) <= SPAN), key=lambda w: (len(w), w))
        n = np.array([counts[language][w] for w in words], float)
        blocks = []
        for lo in range(0, len(words), 8192):
            chars, sizes = _pack(words[lo : lo + 8192])
            blocks.append((lattice.pieces_of(chars, sizes), sizes, n[lo : lo + 8192]))
        p = np.zeros((size + 2, 1))
        p[:size] = 1.0 / size
        p[size + 1] = OUTSIDE
        for _ in range(rounds):
            expected = np.zeros(size + 2)
            for ids, sizes, weight in blocks:
                alpha = _forward(ids, sizes, p)[:, :, 0]
                words_n, width, deep = ids.shape
                beta = np.zeros((width + 1, words_n))
                beta[sizes, np.arange(words_n)] = 1.0
                full = alpha[sizes, np.arange(words_n)]
                for i in range(width - 1, -1, -1):
                    for k in range(min(width - i, deep)):
                        flow = p[ids[:, i, k], 0] * beta[i + k + 1]
                        beta[i] += flow
                        expected += np.bincount(ids[:, i, k], alpha[i] * flow * weight / full, minlength=size + 2)
            kept = expected[:size] + smooth
            p[:size, 0] = kept / kept.sum()
        table[:, at] = p[:, 0]
    return Model(languages, pieces, table)


def remainder(key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", vocabulary: str = VOCABULARY, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled rows whose remainder is not 2, at most about ``sample_docs`` a language.

    The rows are chosen by a hash of the key; their number does not grow with
    the table, so the driver holds a bounded amount of text.
    """
    usable = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.coalesce(remainder(key), F.lit(0)) != 2))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(key)), F.lit(1 << 30))
    limit = F.lit(None)
    for name, n in sizes.items():
        limit = F.when(F.col(lang) == name, F.lit(min(1 << 30, int((1 << 30) * sample_docs / n)))).otherwise(limit)
    counts: dict[str, Counter] = {name: Counter() for name in sizes}
    if sizes:
        for name, body in usable.where(draw < limit).select(lang, text).toLocalIterator():
            counts[name].update(words_of(body))
    counts = {name: c for name, c in counts.items() if c}
    return fit(counts, read_pieces(vocabulary))


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep..., lang_pred, score) for each row, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(model.languages, object)
        for batch in slices(batches, text, 4 << 20):
            texts = batch.column(text).to_pylist()
            if len(names):
                p, some = model.posteriors(texts)
                pred = np.where(some, names[p.argmax(axis=1)], "und")
                score = np.where(some, p.max(axis=1), 0.0)
            else:
                pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (key, *keep)), pa.array(pred.tolist(), pa.string()), pa.array(score, pa.float64())],
                names=[key, *keep, "lang_pred", "score"],
            )

    head = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return map_batches(df.select(*dict.fromkeys((key, *keep, text))), run, head + ", lang_pred string, score double")
