"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of one fixed public vocabulary.
The score of a word under a language is the sum, over all ways to cut the word
into pieces, of the product of their probabilities: the forward algorithm.  A
text's score is the product over its words (runs of letters, lower-cased), and
its language the one with the largest; ``score`` is that language's posterior.

Piece probabilities are fitted by expectation-maximisation on word counts of a
bounded, hash-chosen sample of labelled texts (all their words): each round shares every word out
over its segmentations (forward-backward) and renormalises.  Characters outside
the vocabulary are pieces of one shared unknown kind.

Words of all texts are scored in bulk: for each start and piece length one
vectorised step serves all distinct words of a batch, and workers remember the
scores of recent words.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without training rows every text is ``und``; nulls in lang are never learned
from; ties go to the language that sorts first; words are never cut, whatever
their length; repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix64
from .shared import prepare

#: About so many labelled texts of each language are fitted on.
SAMPLE = 1500
#: Languages that can be told apart: the model holds a number for each piece and language. More is an error, not a cut.
MOST_LANGUAGES = 1000
_ROUNDS, _SMOOTH = 3, 0.05
#: Forward sums below this are rescaled.
_TINY = 1e-60
_REMEMBERED = 300_000
_BLOCK = 20_000
_LETTERS = re.compile(r"[^\W\d_]+")


def _letters(text: str | None) -> list[str]:
    """Lower-cased runs of letters; number characters that are no decimal digits aren't letters."""
    if not text:
        return []
    words = _LETTERS.findall(text.lower())
    if text.isascii():
        return words
    return [w for w in words if w.isascii() or w.isalpha()] + [p for w in words if not w.isascii() and not w.isalpha() for p in "".join(c if c.isalpha() else " " for c in w).split()]


def load_pieces(path: str) -> list[str]:
    """Pieces of letters from a sentencepiece model, lower-cased; a leading ▁ marks a word's begin."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        body = piece.removeprefix("▁").lower()
        if body.isalpha():
            found.add("▁" + body if piece.startswith("▁") else body)
    return sorted(found)


class _PieceIndex:
    """Piece numbers by 64-bit hash: two tables, each piece in one of its two places (cuckoo hashing)."""

    def __init__(self, hashes: np.ndarray):
        bits = max(8, int(len(hashes)).bit_length() + 1)
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros((2, 1 << bits), dtype=np.uint64)
        self.values = np.full((2, 1 << bits), -1, dtype=np.int32)
        for value, key in enumerate(hashes.tolist()):
            item, side = (key, value), 0
            for _ in range(500):
                at = (item[0] >> (0, 32)[side]) & int(self.mask)
                moved = (int(self.keys[side, at]), int(self.values[side, at]))
                self.keys[side, at], self.values[side, at] = item
                if moved[1] < 0:
                    break
                item, side = moved, 1 - side
            else:
                raise ValueError("no place for a piece; take more bits")

    def find(self, h: np.ndarray) -> np.ndarray:
        """-1 where there is no such piece."""
        a, b = (h & self.mask).astype(np.intp), ((h >> np.uint64(32)) & self.mask).astype(np.intp)
        second = np.where(self.keys[1][b] == h, self.values[1][b], np.int32(-1))
        return np.where(self.keys[0][a] == h, self.values[0][a], second)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BEGIN = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64, for i from 0 to n."""
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _letters_of(words: list[str]) -> np.ndarray:
    """Code points, words x positions; 0 beyond a word's end."""
    width = max(map(len, words))
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


class PieceUnigrams:
    """Per-language piece probabilities, with forward and forward-backward over many words at once."""

    def __init__(self, pieces: list[str], languages: list[str]):
        self.pieces, self.languages = pieces, languages
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max((len(p.removeprefix("▁")) for p in pieces), default=1)
        n, k = len(pieces), max(1, len(languages))
        self.p = np.full((n + 2, k), 1.0 / (n + 1))  # row n: an unknown character; row n + 1: no piece
        self.p[-1] = 0
        self.memory: dict[str, np.ndarray] = {}
        hashes = np.zeros(n, dtype=np.uint64)
        if n:
            bodies = _letters_of([p.removeprefix("▁") for p in pieces])
            hashes = mix64((mix64(bodies.astype(np.uint64)) * (bodies != 0) * _powers(_BASE, bodies.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))
            hashes = np.where([p.startswith("▁") for p in pieces], hashes ^ _BEGIN, hashes)
        self.table = _PieceIndex(hashes)

    def _lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths, and for words x ends x piece lengths the piece that ends there (n + 1: none)."""
        none, unknown = len(self.pieces) + 1, len(self.pieces)
        codes = _letters_of(words)
        n, width = codes.shape
        size = np.array([len(w) for w in words])
        span = min(width, self.longest)
        out = np.full((n, width, span), none, dtype=np.int32)
        sums = np.zeros((n, width + 1), dtype=np.uint64)
        power, inverse = _powers(_BASE, width), _powers(_INVERSE, width)
        np.cumsum(mix64(codes.astype(np.uint64)) * power[:-1], axis=1, out=sums[:, 1:])
        ends = np.arange(1, width + 1)
        for s in range(1, span + 1):
            h = mix64((sums[:, s:] - sums[:, : width + 1 - s]) * inverse[: width + 1 - s])
            found = self.table.find(h)
            begin = self.table.find(h[:, :1] ^ _BEGIN)
            found[:, :1] = np.where(begin >= 0, begin, found[:, :1])
            if s == 1:
                found[found < 0] = unknown
            found[found < 0] = none
            found[ends[s - 1 :] > size[:, None]] = none
            out[:, s - 1 :, s - 1] = found
        return size, out

    def _forward(self, size: np.ndarray, lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums by position (position 0 is the begin), and the logarithm that each position of a word was divided by."""
        n, width, span = lattice.shape
        alpha, scale = np.zeros((width + 1, n, self.p.shape[1])), np.zeros((width + 1, n))
        alpha[0] = 1
        for end in range(1, width + 1):
            total, before = alpha[end], scale[end - 1]
            for s in range(1, min(end, span) + 1):
                term = alpha[end - s] * self.p[lattice[:, end - 1, s - 1]]
                total += term * np.exp(scale[end - s] - before)[:, None] if before.any() else term
            scale[end] = before
            most = total.max(axis=1)
            if (small := (most > 0) & (most < _TINY)).any():
                total[small] /= most[small, None]
                scale[end, small] += np.log(most[small])
        return alpha, scale

    def _backward(self, size: np.ndarray, lattice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from the end of each word."""
        n, width, span = lattice.shape
        beta, scale = np.zeros((width + 1, n, self.p.shape[1])), np.zeros((width + 1, n))
        for at in range(width, -1, -1):
            total, after = beta[at], scale[min(at + 1, width)]
            total[size == at] = 1
            for s in range(1, min(width - at, span) + 1):
                term = beta[at + s] * self.p[lattice[:, at + s - 1, s - 1]]
                total += term * np.exp(scale[at + s] - after)[:, None] if after.any() else term
            scale[at] = after
            most = total.max(axis=1)
            if (small := (most > 0) & (most < _TINY)).any():
                total[small] /= most[small, None]
                scale[at, small] += np.log(most[small])
        return beta, scale

    def log_scores(self, words: list[str]) -> np.ndarray:
        """log p(word) under each language; long words are walked with rescaling."""
        out = np.empty((len(words), self.p.shape[1]))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        lo = 0
        while lo < len(order):
            length = len(words[order[lo]])
            hi = lo
            while hi < len(order) and hi - lo < _BLOCK and len(words[order[hi]]) <= max(length, 24) and len(words[order[hi]]) <= length + 3:
                hi += 1
            hi = max(hi, lo + 1)
            part = order[lo:hi]
            if length > 40:
                for i in part:
                    out[i] = self._long(words[i])
            else:
                size, lattice = self._lattice([words[i] for i in part])
                alpha, scale = self._forward(size, lattice)
                each = np.arange(len(part))
                out[part] = np.log(np.maximum(alpha[size, each], 1e-300)) + scale[size, each][:, None]
            lo = hi
        return out

    def _long(self, word: str) -> np.ndarray:
        """The same sum for one long word, keeping only the last few positions, rescaled at each."""
        window, scale = [np.ones(self.p.shape[1])], np.zeros(self.p.shape[1])
        unknown = len(self.pieces)
        for end in range(1, len(word) + 1):
            total = np.zeros(self.p.shape[1])
            for s in range(1, min(len(window), self.longest) + 1):
                body = word[end - s : end]
                piece = self.index.get("▁" + body, self.index.get(body)) if s == end else self.index.get(body)
                if piece is None and s == 1:
                    piece = unknown
                if piece is not None:
                    total += window[-s] * self.p[piece]
            window = [w / total for w in window[-self.longest + 1 or len(window) :]] + [np.ones_like(total)]
            scale += np.log(total)
        return scale

    def fit(self, counts: dict[str, np.ndarray], rounds: int = _ROUNDS) -> PieceUnigrams:
        """Expectation-maximisation from word -> counts by language."""
        blocks, lo = [], 0
        by_length = sorted(sorted(counts), key=len)
        while lo < len(by_length):
            part = by_length[lo : lo + max(1, min(_BLOCK, 500_000 // len(by_length[lo])))]
            part = [w for w in part if len(w) <= len(part[0]) + 3]
            blocks.append((*self._lattice(part), np.stack([counts[w] for w in part]).astype(float)))
            lo += len(part)
        for _ in range(rounds):
            expected = np.full_like(self.p, _SMOOTH)
            for size, lattice, weight in blocks:
                n, width, span = lattice.shape
                alpha, up = self._forward(size, lattice)
                beta, down = self._backward(size, lattice)
                each = np.arange(n)
                share, whole = weight / np.maximum(alpha[size, each], 1e-300), up[size, each]
                for end in range(1, width + 1):
                    for s in range(1, min(end, span) + 1):
                        piece = lattice[:, end - 1, s - 1]
                        gain = alpha[end - s] * self.p[piece] * beta[end] * share
                        if whole.any():
                            gain = gain * np.exp(up[end - s] + down[end] - whole)[:, None]
                        live = piece <= len(self.pieces)
                        for k in range(self.p.shape[1]):
                            expected[:, k] += np.bincount(piece[live], gain[live, k], len(expected))
            expected[-1] = 0
            self.p = expected / expected.sum(axis=0)
        return self

    def score_texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [Counter(_letters(t)) for t in texts]
        if len(self.memory) > _REMEMBERED:
            self.memory = {}
        memory = self.memory
        fresh = list({w for c in split for w in c if w not in memory})
        for lo in range(0, len(fresh), 50_000):
            part = fresh[lo : lo + 50_000]
            memory.update(zip(part, self.log_scores(part)))
        out = []
        for c in split:
            if not c or not self.languages:
                out.append(("und", 0.0))
                continue
            total = np.array(list(c.values()), dtype=float) @ np.array([memory[w] for w in c])
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def train(docs: DataFrame, pieces_path: str, sample: int = SAMPLE) -> PieceUnigrams:
    """Fit on text and lang of about ``sample`` rows of each language; counts are made on the executors."""
    prepare(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count()
    known = sizes.limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r["lang"] for r in known)
    rate = F.lit(0)
    for r in known:
        rate = F.when(F.col("lang") == r["lang"], int(1e6 * min(1, sample / r["count"]))).otherwise(rate)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < rate).select("lang", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            own = Counter((lang, w) for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in _letters(text))
            keys = list(own)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([own[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    # every distinct word of the bounded sample
    table = chosen.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    at = {lang: k for k, lang in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for lang, word, n in zip(*(table.column(c).to_pylist() for c in ("lang", "word", "n"))):
        if word not in counts:
            counts[word] = np.zeros(len(languages), dtype=np.float32)
        counts[word][at[lang]] += n
    model = PieceUnigrams(load_pieces(pieces_path), languages)
    return model.fit(counts) if counts else model


def identify(docs: DataFrame, model: PieceUnigrams) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text."""
    prepare(docs.sparkSession)
    model.memory = {}

    def run(batches):
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 512):
                part = batch.slice(lo, 512)
                found = model.score_texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
