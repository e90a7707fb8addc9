"""Byte-pair encoding and decoding with a contiguous rank array per word.

A word is a row of symbol ids with, between neighbours, the rank of that pair in
the merge list.  The row is scanned for its least rank (the leftmost of equals),
the boundary there is deleted, and the two ranks beside it are refreshed; it ends
when no pair has a rank.  Short words of like length are rows of one matrix, so
a scan, a deletion and a refresh serve thousands of words at once.  Words longer
than ``SHORT`` bytes, where repeated scans would cost their square, take the same
merges from a heap.

Tokenizer files are of the ``tokenizers`` library's kind with an NFC + lower-case
normaliser, a pattern that keeps matches and drops white space, byte-level
symbols and an end-of-word suffix.  Special tokens inside a text are one id each,
as the library has it.

Defined results: a null or empty text has no ids and decodes to the empty text;
texts are never cut; repeated rows repeat; other columns of the input pass
through unread.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import prepare

#: Longest word, in bytes, that is a row of the rank array.
SHORT = 48
#: Words remembered by a worker between batches; when full, the memory starts anew.
REMEMBERED = 300_000
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_SPACES = regex.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
# Code points that the library's pattern engine (Unicode 16) takes as symbols, though newer tables make them letters or numbers.
_NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB
11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191
191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
# Capitals of those tables that the library's lower-casing knows, with their small letters.
_NEWER_CAPITALS = """
1C89 1C8A  A7CB 264  A7CC A7CD  A7CE A7CF  A7D2 A7D3  A7D4 A7D5  A7DA A7DB  A7DC 19B
""".split()
_LOWER = {int(c, 16): int(s, 16) for c, s in zip(_NEWER_CAPITALS[::2], _NEWER_CAPITALS[1::2])}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_CAPITALS = regex.compile("[" + "".join(map(chr, _LOWER)) + "]")
_NEWER_CLASS = regex.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in _NEWER.split()) + "]")
_NONE = np.int32(2**31 - 1)
_ROWS = 8192


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder; one is made in each Python worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.tokens: list[str] = [""] * size
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        names = _byte_symbols()
        self.inner = np.array([vocab[c] for c in names], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in names], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memory: dict[str, tuple[bytes, str]] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair in the merge list, _NONE where it has none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _merge_short(self, ids: np.ndarray) -> list[np.ndarray]:
        """Merge each row of a matrix of symbols, all rows of one length."""
        n, width = ids.shape
        done: list[np.ndarray] = [ids[0]] * n
        rows = np.arange(n)
        ranks = self.rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((n, 0), np.int32)
        while len(rows):
            if width == 1:
                for r, x in zip(rows, ids):
                    done[r] = x
                break
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            least = ranks[each, at]
            if (stop := least == _NONE).any():
                for r, x in zip(rows[stop], ids[stop]):
                    done[r] = x
                go = ~stop
                rows, ids, ranks, at, least = rows[go], ids[go], ranks[go], at[go], least[go]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = self.made[least]
            column = np.arange(width - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            width -= 1
            if width > 1:
                column = np.arange(width - 1)
                ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
                before = at > 0
                r, c = each[before], at[before]
                ranks[r, c - 1] = self.rank(ids[r, c - 1], ids[r, c])
                after = at < width - 1
                r, c = each[after], at[after]
                ranks[r, c] = self.rank(ids[r, c], ids[r, c + 1])
        return done

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """The same merges for one long word: least rank first, leftmost of equals, from a heap over linked parts."""
        part, n = ids.tolist(), len(ids)
        before, after, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        first = self.rank(ids[:-1], ids[1:])
        heap = [(int(r), i, part[i], part[i + 1]) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or part[i] != a or part[j] != b:
                continue
            part[i], live[j], after[i] = int(self.made[r]), False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0:
                    k = int(self.rank(np.array([part[x]]), np.array([part[y]]))[0])
                    if k != _NONE:
                        heapq.heappush(heap, (k, x, part[x], part[y]))
        return np.array([p for p, ok in zip(part, live) if ok], dtype=np.int32)

    def pre_tokens(self, piece: str) -> list[str]:
        """The pattern's matches, with capitals and symbols as the library's tables have them."""
        if piece.isascii():
            return self.pattern.findall(piece)
        if _CAPITALS.search(piece):
            piece = piece.translate(_LOWER)
        if not _NEWER_CLASS.search(piece):
            return self.pattern.findall(piece)
        known = _NEWER_CLASS.sub("\ufffd", piece)
        return [piece[m.start() : m.end()] for m in self.pattern.finditer(known)]

    def learn(self, pieces) -> None:
        """Encode the white-space-free pieces that aren't remembered yet; no pre-token crosses white space."""
        split = {p: self.pre_tokens(p) for p in pieces}
        words = {w for found in split.values() for w in found}
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            by_length.setdefault(len(raw := w.encode()), []).append((w, raw))
        coded: dict[str, tuple[bytes, str]] = {}
        for length, group in by_length.items():
            for lo in range(0, len(group), _ROWS):
                part = group[lo : lo + _ROWS]
                raw = np.frombuffer(b"".join([b for _, b in part]), dtype=np.uint8).reshape(len(part), length)
                ids = self.inner[raw]
                ids[:, -1] = self.final[raw[:, -1]]
                merged = self._merge_short(ids) if length <= SHORT else [self._merge_long(x) for x in ids]
                for (w, _), x in zip(part, merged):
                    coded[w] = (x.astype("<i4").tobytes(), " ".join([self.tokens[i] for i in x.tolist()]))
        for p, found in split.items():
            known = [coded[w] for w in found]
            self.memory[p] = (b"".join([k[0] for k in known]), " ".join([k[1] for k in known]))

    def pieces(self, text: str) -> list[str]:
        """The text's normalised pieces between white space; special tokens stand for themselves."""
        if self.split_special is None or "<|" not in text:
            return self._plain(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            out += [part] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # a capital sigma has one lower form, whatever follows
        text = text.lower()
        # The four separators that Python's split() knows and the pattern doesn't are symbols here.
        return _SPACES.findall(text) if _SEPARATORS.search(text) else text.split()

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """For each text its ids, as little-endian 32-bit integers, and the decoded text."""
        split = [self.pieces(t) if t else [] for t in texts]
        if len(self.memory) > REMEMBERED:
            self.memory = {}
        memory = self.memory
        for token, i in self.special.items():
            memory[token] = (np.array([i], dtype="<i4").tobytes(), token)
        wanted: set[str] = set()
        for pieces in split:
            wanted.update(pieces)
        self.learn([p for p in wanted if p not in memory])
        out = []
        for pieces in split:
            known = [memory[p] for p in pieces]
            out.append((b"".join([k[0] for k in known]), " ".join([k[1] for k in known if k[1]])))
        return out

    def decode(self, ids) -> str:
        """Tokens joined by one space, special tokens included: what a tokenizer without a decoder gives."""
        return " ".join([self.tokens[i] for i in ids])


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The input's columns, with ``ids`` (array of int) and ``decoded`` (string).

    ``tokenizer_path`` must name the file on every executor.  Columns of the input
    that are called ``ids`` or ``decoded`` are replaced.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    schema = docs.select(*(F.col(f"`{c}`") for c in rest), F.col("text").cast("string").alias("text")).schema
    schema = T.StructType([*schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches):
        bpe = WordBpe(tokenizer_path)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo in range(0, max(batch.num_rows, 1), 256):
                part = batch.slice(lo, 256)
                coded = bpe.encode_batch(part.column(at).to_pylist())
                offsets = np.zeros(len(coded) + 1, dtype=np.int32)
                np.cumsum([len(i) // 4 for i, _ in coded], out=offsets[1:])
                flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(i for i, _ in coded))])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array([d for _, d in coded], pa.string())], names=[*part.schema.names, "ids", "decoded"])

    return docs.select(*(F.col(f"`{c}`") for c in rest), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids joined by one space and of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
