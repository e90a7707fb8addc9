"""Edit-aware token counts from segment trees over pre-tokens.

A document's text is cut into segments of whole pre-tokens; a binary tree over
the segments holds, at every node, the tokens and characters below it.  An edit
replaces a span of the original text.  The segments it touches are found by
descending the character sums; they are cut into pre-tokens anew from a safe point
before the edit until the new pre-tokens meet an old boundary beyond it, only that
region is encoded again, and its sums are updated on the paths to the root.  Edits
whose regions meet are one region.

A boundary is safe when what lies before it can't change what is matched after
it: the pattern's matches end there in both texts, and the text after it is the
same.  So the counts equal those of encoding the whole edited text.

Defined results: a null or empty text has no segments and no tokens; edits must
not overlap, and those that do are merged before use; an edit of nothing by
nothing is no edit; texts are whole, whatever their length; repeated rows get
equal results; other columns are not read.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prepare

SEGMENT = 16
_REMEMBERED = 400_000


class PreTokenCounter:
    """Cuts text into pre-tokens and counts the tokens of each, remembering recent ones."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("edits", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.memory: dict[str, int] = {}
        self.encoded = 0

    def counts(self, pieces: list[str]) -> list[int]:
        memory = self.memory
        if len(memory) > _REMEMBERED:
            memory.clear()
        fresh = [p for p in set(pieces) if p not in memory]
        for p in fresh:
            raw = p.encode("utf-8", "surrogatepass")
            memory[p] = 1 if raw in self.ranks else len(self.encoding.encode_ordinary(p))
        self.encoded += len(pieces)
        return [memory[p] for p in pieces]


class SegmentTree:
    """Sums of tokens and characters over segments; leaves sit at ``size + i`` of a heap array."""

    def __init__(self, text: str, counter: PreTokenCounter):
        self.text, self.counter = text, counter
        pieces = counter.pattern.findall(text) if text else []
        self.ends = np.cumsum([len(p) for p in pieces]) if pieces else np.zeros(0, dtype=np.int64)
        tokens = np.array(counter.counts(pieces), dtype=np.int64)
        n = max(1, -(-len(pieces) // SEGMENT))
        self.size = 1 << (n - 1).bit_length()
        self.tokens, self.chars = np.zeros(2 * self.size, dtype=np.int64), np.zeros(2 * self.size, dtype=np.int64)
        if len(pieces):
            starts = np.arange(0, len(pieces), SEGMENT)
            self.tokens[self.size : self.size + n] = np.add.reduceat(tokens, starts)
            self.chars[self.size : self.size + n] = np.diff(np.concatenate(([0], self.ends[np.append(starts[1:], len(pieces)) - 1])))
        self.own, self.pieces = tokens, len(pieces)
        level = self.size
        while level > 1:
            half = level // 2
            for sums in (self.tokens, self.chars):
                sums[half:level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level = half

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    def segment_at(self, place: int) -> int:
        """The segment that holds a character of the original text, by descending the character sums."""
        node = 1
        while node < self.size:
            node *= 2
            if place >= self.chars[node]:
                place -= self.chars[node]
                node += 1
        return node - self.size

    def _set(self, segment: int, tokens: int) -> None:
        node = self.size + segment
        change = tokens - self.tokens[node]
        while node and change:
            self.tokens[node] += change
            node //= 2

    def _old_boundary(self, place: int) -> bool:
        i = int(np.searchsorted(self.ends, place))
        return place == 0 or (i < len(self.ends) and self.ends[i] == place)

    def apply(self, edits: list[tuple[int, int, str]]) -> int:
        """Apply edits (start, end, replacement) of the original text; returns how many pre-tokens were encoded again.

        Only tokens are changed: characters stay those of the original, by which edits are placed.
        """
        merged: list[list] = []
        for start, end, new in sorted(edits):
            if start == end and not new:
                continue
            if merged and start < merged[-1][1]:
                merged[-1][2] += new
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end, new])
        again, k = 0, 0
        while k < len(merged):
            # one pre-token of context before the edit, as an ending match may have looked ahead
            i = int(np.searchsorted(self.ends, merged[k][0], side="left"))
            low = max(0, i - 2)
            begin = int(self.ends[low - 1]) if low else 0
            built, at, shift = [self.text[begin : merged[k][0]]], merged[k][1], 0
            built.append(merged[k][2])
            k += 1
            reach = 64
            while True:
                while k < len(merged) and merged[k][0] <= at + reach:
                    built += [self.text[at : merged[k][0]], merged[k][2]]
                    at = merged[k][1]
                    k += 1
                stop = min(len(self.text), at + reach)
                built_text = "".join(built)
                region = built_text + self.text[at:stop]
                pieces, place, met = [], 0, None
                edge = len(built_text)
                for m in self.counter.pattern.finditer(region):
                    pieces.append(m.group())
                    place = m.end()
                    old = at + place - edge
                    # a match that ends at the region's end may go on in the text
                    if place > edge and place < len(region) - 2 and self._old_boundary(old) and self._safe(old):
                        met = old
                        break
                if met is None and stop == len(self.text):
                    met = len(self.text)
                if met is not None:
                    break
                reach *= 4
            again += len(pieces)
            self._replace(begin, met, self.counter.counts(pieces))
        return again

    def _safe(self, place: int) -> bool:
        """Matching from here on is the same whatever came before: white space isn't split across this boundary."""
        return place >= len(self.text) or not self.text[place - 1].isspace()

    def _replace(self, begin: int, end: int, counts: list[int]) -> None:
        """The pre-tokens of the original from ``begin`` to ``end`` have become others with these counts."""
        lo = int(np.searchsorted(self.ends, begin, side="right")) if begin else 0
        hi = int(np.searchsorted(self.ends, end, side="left")) + 1 if end else 0
        hi = min(hi, self.pieces)
        self.own[lo:hi] = 0
        total = sum(counts)
        if lo < self.pieces:
            self.own[min(lo, self.pieces - 1)] += total
            first, last = self.segment_at(int(self.ends[lo]) - 1), self.segment_at(int(self.ends[max(lo, hi - 1)]) - 1)
            for s in range(first, last + 1):
                self._set(s, int(self.own[s * SEGMENT : (s + 1) * SEGMENT].sum()))
        elif self.pieces:
            self.own[-1] += total
            self._set((self.pieces - 1) // SEGMENT, int(self.own[(self.pieces - 1) // SEGMENT * SEGMENT :].sum()))
        else:
            self._set(0, int(self.tokens[self.size]) + total)


#: Redactions of the pipeline query: e-mail addresses, phone numbers, and runs of one symbol.
_EDITS = re.compile(r"(?P<mail>[\w.+-]+@[\w-]+\.[\w.]*\w)|(?P<phone>\+?\d[\d() .-]{7,}\d)|(?P<run>([^\w\s])\4{2,})")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Replace e-mail addresses and phone numbers by placeholders, and runs of a symbol by one."""
    out = []
    for m in _EDITS.finditer(text):
        new = "<email>" if m["mail"] else "<phone>" if m["phone"] else m["run"][0]
        out.append((m.start(), m.end(), new))
    return out


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The edited text itself."""
    parts, at = [], 0
    for start, end, new in sorted(edits):
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


def edit_aware_counts(docs: DataFrame, ranks_path: str, pattern: str, edits=cleaning_edits) -> DataFrame:
    """doc_id, n_tokens (of the text), n_edits, n_tokens_edited, n_pretokens, n_reencoded (pre-tokens encoded again)."""
    prepare(docs.sparkSession)

    def run(batches):
        counter = PreTokenCounter(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                tree = SegmentTree(text or "", counter)
                before, changes = tree.n_tokens, edits(text) if text else []
                again = tree.apply(changes)
                rows.append((before, len(changes), tree.n_tokens, tree.pieces, again))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_pretokens long, n_reencoded long")
