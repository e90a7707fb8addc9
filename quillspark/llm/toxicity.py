"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Words come in two ways: an embedding of the hashed word and the mean embedding of
its hashed character trigrams, with one more number, the word's smoothed log-odds
between toxic and other training documents.  A window of ``WINDOW`` words runs
through a gated recurrent unit in each direction, attention pools the states and
a logistic unit scores the window.  Windows begin every ``STRIDE`` words, so all
overlap, and cover every word; a document's score is its highest window's.

The network is trained in numpy on about ``SAMPLE`` documents of each label.  Only
documents are labelled, so a toxic document's training windows are those that the
network, or at first the log-odds, finds most toxic; other documents give their
most toxic-looking windows and some at random.

Defined results: a null or empty text is one window without words; without both
labels among the training rows, every score is the share of label 1 there (0 with
no rows); null ids are scored and never learned from; repeated rows get equal
scores; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _LOWER, chunks, plain_words, text_buffers
from .learning import Adam, labelled_ids
from .shared import prepare

WINDOW, STRIDE = 24, 16
#: About so many labelled documents of each label are fitted on.
SAMPLE = 1200
_H, _E, _A = 8, 8, 8
_WORDS, _CHARS = 1 << 13, 1 << 12
_BATCH = 2048
_ROUNDS, _EPOCHS = 3, 4


def _sig(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Lexicon:
    """Smoothed log-odds of the words that enough toxic documents hold, by word hash."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.odds = hashes[order], odds[order].astype(np.float32)

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(h), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.odds[at], np.float32(0))


class Texts:
    """Distinct words of some texts with their inputs, and every window as word numbers."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, lexicon: Lexicon):
        hashes, size, starts, spans, rows = plain_words(offsets, raw)
        full = size > 0
        counts = np.concatenate(([0], np.cumsum(full)))
        self.rows, hashes, starts, spans = counts[rows], hashes[full], starts[full], spans[full]
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.word = (distinct % np.uint64(_WORDS - 1)).astype(np.intp) + 1
        self.odds = lexicon.of(distinct) / 4
        n = np.maximum(1, spans[first] - 2)
        self.char_at = np.concatenate(([0], np.cumsum(n)))[:-1]
        flat = np.repeat(starts[first] - self.char_at, n) + np.arange(int(n.sum()))
        low = _LOWER[raw].astype(np.int64) if len(raw) else np.zeros(0, np.int64)
        low = np.append(low, [0, 0])
        self.chars = (low[flat] * 961 + low[flat + 1] * 31 + low[flat + 2]) * 2654435761 % 4294967296 >> 20 if len(flat) else np.zeros(0, np.int64)
        self.char_n = n
        length = np.diff(self.rows)
        per = np.maximum(1, -(-(np.maximum(length, WINDOW) - WINDOW) // STRIDE) + 1)
        self.begins = np.concatenate(([0], np.cumsum(per)))
        owner = np.repeat(np.arange(len(length)), per)
        at = (np.arange(len(owner)) - self.begins[owner]) * STRIDE
        place = at[:, None] + np.arange(WINDOW)
        self.mask = place < length[owner][:, None]
        where = np.minimum(self.rows[owner][:, None] + place, max(len(back) - 1, 0))
        self.windows = np.where(self.mask, back[where], len(distinct)) if len(back) else np.full(place.shape, 0)


class _Some:
    """The words of some windows only, renumbered; what a training step needs."""

    def __init__(self, t: Texts, rows: np.ndarray):
        used, back = np.unique(np.append(t.windows[rows], len(t.word)), return_inverse=True)
        words, self.mask = used[:-1], t.mask[rows]
        self.windows = back[:-1].reshape(self.mask.shape)
        self.word, self.odds, self.char_n = t.word[words], t.odds[words], t.char_n[words]
        self.char_at = np.concatenate(([0], np.cumsum(self.char_n)))[:-1]
        self.chars = t.chars[np.repeat(t.char_at[words] - self.char_at, self.char_n) + np.arange(int(self.char_n.sum()))] if len(words) else t.chars[:0]


def _sum_rows(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` that share a place."""
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        places, starts = np.unique(at[order], return_index=True)
        out[places] = np.add.reduceat(values[order], starts, axis=0)
    return out


class BiGru:
    def __init__(self, lexicon: Lexicon, seed: int = 4):
        g = np.random.default_rng(seed)
        d = 2 * _E + 1
        f = lambda a, b, s=None: (g.standard_normal((a, b)) * (s or a**-0.5)).astype(np.float32)
        self.lexicon, self.constant = lexicon, 0.0
        self.p = {"ew": f(_WORDS, _E, 0.05), "ec": f(_CHARS, _E, 0.05), "av": f(_A, 1), "aw": f(2 * _H, _A), "ab": np.zeros(_A, np.float32), "o": f(2 * _H, 1), "c": np.full(1, -1.0, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": f(d, 3 * _H), f"b{way}": np.zeros(3 * _H, np.float32), f"u{way}": f(_H, 2 * _H), f"n{way}": f(_H, _H)}

    def inputs(self, t: Texts | _Some) -> np.ndarray:
        """One row per distinct word, and a zero row for places without a word."""
        p, n = self.p, len(t.word)
        x = np.zeros((n + 1, 2 * _E + 1), dtype=np.float32)
        if n:
            x[:n, :_E] = p["ew"][t.word]
            x[:n, _E : 2 * _E] = np.add.reduceat(p["ec"][t.chars], t.char_at, axis=0) / t.char_n[:, None]
            x[:n, -1] = t.odds
        return x

    def _run(self, xp: np.ndarray, mask: np.ndarray, way: str, keep: bool):
        """States at every place; xp: places x windows x 3H."""
        u, un = self.p[f"u{way}"], self.p[f"n{way}"]
        steps, b = xp.shape[0], xp.shape[1]
        h = np.zeros((b, _H), dtype=np.float32)
        out, trace = np.empty((steps, b, _H), dtype=np.float32), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            g = _sig(xp[t, :, : 2 * _H] + h @ u)
            r, z = g[:, :_H], g[:, _H:] * mask[t]
            n = np.tanh(xp[t, :, 2 * _H :] + (r * h) @ un)
            if keep:
                trace.append((t, h, r, g[:, _H:], n))
            h = h + z * (n - h)
            out[t] = h
        return out, trace

    def forward(self, x: np.ndarray, windows: np.ndarray, mask: np.ndarray, keep: bool = False):
        p = self.p
        m = np.ascontiguousarray(mask.T)[:, :, None].astype(np.float32)
        ids = np.ascontiguousarray(windows.T)
        runs = {way: self._run((x @ p[f"x{way}"] + p[f"b{way}"])[ids], m, way, keep) for way in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        a = np.tanh(h @ p["aw"] + p["ab"])
        e = (a @ p["av"])[:, :, 0] + np.where(m[:, :, 0] > 0, 0, np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, h)
        return (pooled @ p["o"])[:, 0] + p["c"][0], (m, ids, runs, h, a, w, pooled)

    def score_windows(self, t: Texts) -> np.ndarray:
        x, out = self.inputs(t), np.empty(len(t.windows), dtype=np.float32)
        for lo in range(0, len(out), _BATCH):
            out[lo : lo + _BATCH] = self.forward(x, t.windows[lo : lo + _BATCH], t.mask[lo : lo + _BATCH])[0]
        return out

    def score(self, offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each text: its highest window."""
        if self.constant is not None:
            return np.full(len(offsets) - 1, float(self.constant))
        t = Texts(offsets, raw, self.lexicon)
        top = np.maximum.reduceat(self.score_windows(t), t.begins[:-1]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(top, -40, 40)))

    def _gradients(self, t: _Some, y: np.ndarray) -> dict[str, np.ndarray]:
        p, x = self.p, self.inputs(t)
        out, (m, ids, runs, h, a, w, pooled) = self.forward(x, t.windows, t.mask, True)
        d = ((_sig(out) - y) / len(y)).astype(np.float32)
        grads = {"o": pooled.T @ d[:, None], "c": np.array([d.sum()])}
        dp = d[:, None] @ p["o"].T
        dh = w[:, :, None] * dp
        dw = np.einsum("tbh,bh->tb", h, dp)
        de = w * (dw - (w * dw).sum(axis=0))
        grads["av"] = np.einsum("tba,tb->a", a, de)[:, None]
        da = de[:, :, None] * p["av"][:, 0] * (1 - a * a)
        grads["aw"], grads["ab"] = np.einsum("tbh,tba->ha", h, da), da.sum(axis=(0, 1))
        dh = dh + da @ p["aw"].T
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            u, un = p[f"u{way}"], p[f"n{way}"]
            du, dn = np.zeros_like(u), np.zeros_like(un)
            steps = np.zeros((len(m), len(y), 3 * _H), dtype=np.float32)
            flow = np.zeros((len(y), _H), dtype=np.float32)
            for step, before, r, z, n in reversed(runs[way][1]):
                flow = flow + dh[step, :, k * _H : (k + 1) * _H]
                zm = z * m[step]
                gn = flow * zm * (1 - n * n)
                gz = flow * (n - before) * m[step] * z * (1 - z)
                rh = gn @ un.T
                gr = rh * before * r * (1 - r)
                dn += (r * before).T @ gn
                g2 = np.concatenate([gr, gz], axis=1)
                du += before.T @ g2
                steps[step, :, : 2 * _H], steps[step, :, 2 * _H :] = g2, gn
                flow = flow * (1 - zm) + rh * r + g2 @ u.T
            dproj = _sum_rows(steps.reshape(-1, 3 * _H), ids.reshape(-1), len(x))
            dproj[-1] = 0
            grads[f"u{way}"], grads[f"n{way}"], grads[f"x{way}"], grads[f"b{way}"] = du, dn, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ p[f"x{way}"].T
        grads["ew"] = _sum_rows(dx[:-1, :_E], t.word, _WORDS)
        grads["ec"] = _sum_rows(np.repeat(dx[:-1, _E : 2 * _E] / t.char_n[:, None], t.char_n, axis=0), t.chars, _CHARS)
        return grads

    def fit(self, offsets: np.ndarray, raw: np.ndarray, y: np.ndarray, seed: int = 8) -> BiGru:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.0
            return self
        self.constant = None
        g, adam = np.random.default_rng(seed), Adam(self.p, 0.01)
        parts = []
        for lo, hi in chunks(offsets):
            parts.append((Texts(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]], self.lexicon), y[lo:hi]))
        for turn in range(_ROUNDS):
            chosen = []
            for t, label in parts:
                if turn:
                    s = self.score_windows(t)
                else:
                    odds = np.append(t.odds, 0)
                    s = odds[t.windows].max(axis=1)
                rows, want = [], []
                for i, v in enumerate(label):
                    lo, hi = t.begins[i], t.begins[i + 1]
                    order = lo + np.argsort(-s[lo:hi], kind="stable")
                    take = order[:1] if v else np.unique(np.concatenate([order[:2], g.integers(lo, hi, 1)]))
                    rows += take.tolist()
                    want += [v] * len(take)
                chosen.append((np.array(rows), np.array(want, dtype=np.float32)))
            for _ in range(_EPOCHS):
                for k in g.permutation(len(parts)):
                    rows, want = chosen[k]
                    for part in np.array_split(g.permutation(len(rows)), max(1, len(rows) // 96)):
                        adam.step(self._gradients(_Some(parts[k][0], rows[part]), want[part]))
        return self


def lexicon(offsets: np.ndarray, raw: np.ndarray, y: np.ndarray) -> Lexicon:
    """Log-odds by document counts, for words of at least three toxic documents that are much likelier there."""
    hashes, size, _, _, rows = plain_words(offsets, raw)
    owner = np.repeat(np.arange(len(y)), np.diff(rows))
    pair = np.unique(np.stack([hashes[size > 0], owner[size > 0].astype(np.uint64)]), axis=1)
    words, back = np.unique(pair[0], return_inverse=True)
    toxic = np.bincount(back, y[pair[1].astype(np.intp)], len(words))
    other = np.bincount(back, minlength=len(words)) - toxic
    n1, n0 = y.sum(), len(y) - y.sum()
    odds = np.log((toxic + 0.5) / (n1 + 1)) - np.log((other + 0.5) / (n0 + 1))
    ok = (toxic >= 3) & (odds > 1.5) & (toxic >= 0.01 * n1)
    return Lexicon(words[ok], odds[ok])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> BiGru:
    """Fit on ``labels`` (doc_id, label 0 or 1 in ``toxic``); about ``sample`` whole texts of each label come to the driver."""
    prepare(docs.sparkSession)
    ids = labelled_ids(labels, "toxic", sample)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text").toArrow()
    texts = texts.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    offsets, raw = text_buffers(texts.column("text"))
    y = texts.column("label").to_numpy().astype(np.float32)
    return BiGru(lexicon(offsets, raw, y) if len(y) else Lexicon(np.zeros(0, np.uint64), np.zeros(0))).fit(offsets, raw, y)


def score_toxicity(docs: DataFrame, model: BiGru) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            offsets, raw = text_buffers(batch.column(1))
            for lo, hi in chunks(offsets, 1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(shared.value.score(offsets[lo : hi + 1] - offsets[lo], raw[offsets[lo] : offsets[hi]]))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
