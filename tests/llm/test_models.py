"""Encoders, counters and models, against the libraries or brute force; mostly without Spark."""

import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import bpe, edits, kernels, language, lm, quality, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORD_BPE)
OURS = bpe.WordBpe(WORD_BPE)
COUNTER = edits.PreTokenCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def buffers(texts):
    return kernels.text_buffers(pa.array(texts, pa.string()))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abAB \t\n\x0b\x1c|.é日 ")), max_size=30), max_size=6))
def test_words_are_those_of_bytes_split(texts):
    offsets, raw = buffers(texts)
    hashes, rows = kernels.word_hashes(offsets, raw)
    seen = {}
    for i, t in enumerate(texts):
        words = t.encode().lower().split()
        own = hashes[rows[i] : rows[i + 1]]
        assert len(words) == len(own)
        for w, h in zip(words, own.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_words_differ():
    offsets, raw = buffers(["mentaux mentauxier " + "a" * 3000 + " " + "a" * 3001])
    assert len(set(kernels.word_hashes(offsets, raw)[0].tolist())) == 4


@settings(max_examples=120, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_library(text):
    expected = LIBRARY.encode(text, add_special_tokens=False).ids
    raw, decoded = OURS.encode_batch([text])[0]
    assert np.frombuffer(raw, "<i4").tolist() == expected
    assert decoded == LIBRARY.decode(expected, skip_special_tokens=False) == OURS.decode(expected)


@pytest.mark.parametrize("text", ["", "a" * 300, "<|endoftext|>x<|startoftext|>", "İstanbul ΑΣ ΣΑΣ", "don't 'S it'll 1234 ½", "ab" * 100 + "cd" * 77, "a\x1cb\x85c"])
def test_bpe_cases(text):
    assert np.frombuffer(OURS.encode_batch([text])[0][0], "<i4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_edits_equal_full_encoding():
    g = random.Random(5)
    pieces = ["a", "b", " ", "  ", "\n", "é", "1", "23", "'s", "'", "!", "x y", "😀", "word"]
    for _ in range(800):
        text = "".join(g.choice(pieces) for _ in range(g.randint(0, 80)))
        changes, at = [], 0
        while at < len(text) and g.random() < 0.7:
            start = g.randint(at, len(text))
            end = min(len(text), start + g.randint(0, 6))
            changes.append((start, end, "".join(g.choice(pieces) for _ in range(g.randint(0, 4)))))
            at = end + g.randint(1, 8)
        tree = edits.SegmentTree(text, COUNTER)
        assert tree.n_tokens == len(COUNTER.encoding.encode_ordinary(text))
        tree.apply(changes)
        assert tree.n_tokens == len(COUNTER.encoding.encode_ordinary(edits.apply_edits(text, changes)))


def test_edits_touch_little():
    text = "plain words of a story " * 400 + "mail me@example.com now " + "more plain words " * 400
    tree = edits.SegmentTree(text, COUNTER)
    assert tree.apply(edits.cleaning_edits(text)) < 40 < tree.pieces


def test_forward_sums_all_segmentations():
    model = language.PieceUnigrams(["▁a", "a", "ab", "b", "▁ab", "é", "abc"], ["x", "y"])
    g = np.random.default_rng(0)
    model.p[:-1] = g.random((8, 2))

    def brute(word):
        total = np.zeros(2)
        for cut in product((0, 1), repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate(cut, 1):
                if c:
                    parts.append((start, word[start:i]))
                    start = i
            p = np.ones(2)
            for s, piece in [*parts, (start, word[start:])]:
                k = model.index.get("▁" + piece, model.index.get(piece)) if s == 0 else model.index.get(piece)
                p = p * (model.p[k] if k is not None else model.p[7] if len(piece) == 1 else 0)
            total += p
        return total

    words = ["a", "ab", "abcab", "éaé", "zz", "aabbccab"]
    assert np.allclose(np.exp(model.log_scores(words)), [brute(w) for w in words])
    long = "abcab" * 30
    assert np.isfinite(model.log_scores([long])).all()


def test_language_without_letters():
    model = language.PieceUnigrams(["▁a", "a"], ["x"])
    assert model.score_texts([None, "", "12 !!", "a"]) == [("und", 0.0)] * 3 + [("x", 1.0)]
    assert language.PieceUnigrams([], []).score_texts(["a"]) == [("und", 0.0)]


def test_filter_reads_back_counts():
    g = np.random.default_rng(1)
    grams = np.unique(g.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2))
    counts = np.minimum(g.zipf(1.5, len(grams)), 10**7)
    part = lm._ranges(grams, 64)
    bits = [lm.Filter.segment(grams[part == k], lm.levels(counts[part == k])) for k in range(64)]
    blocks = np.array([len(b) // 64 for b in bits], dtype=np.uint64)
    f = lm.Filter(np.cumsum(blocks) - blocks, blocks, np.frombuffer(b"".join(bits), dtype=np.uint8))
    read = f.read(grams)
    assert (read >= lm.levels(counts)).all() and (read == lm.levels(counts)).mean() > 0.95
    assert (f.read(g.integers(0, 2**63, 4000, dtype=np.uint64)) > 0).mean() < 0.05


def test_levels_are_exact_for_small_counts():
    counts = np.arange(0, 8)
    assert lm.levels(counts).tolist() == list(range(8)) and np.allclose(lm._VALUES[lm.levels(counts)], counts)
    large = np.array([10**3, 10**6, 2**40])
    assert (np.abs(np.log(lm._VALUES[lm.levels(large)] / large)) < np.log(lm.BASE)).all()


def test_probabilities_add_up_to_one():
    """Over all words, the end and one unknown word, in every context; counts are small, so levels are exact."""
    g = random.Random(8)
    texts = [[*(g.choice("abcdefgh") for _ in range(g.randint(0, 5))), None] for _ in range(7)]
    grams = [Counter() for _ in range(4)]
    for t in texts:
        padded = ["<", "<", *t]
        grams[0]["<"] += 1
        for i in range(2, len(padded)):
            for n in (1, 2, 3):
                grams[n][tuple(padded[i + 1 - n : i + 1])] += 1
        grams[2]["<", "<"] += 1
    grams[1][("<",)] = grams[1][(None,)]
    words = sorted({w for (w,) in grams[1] if w not in ("<", None)}) + [None]
    model = lm.Model(sum(grams[1][(w,)] for w in words), len(words))
    model.weights = np.random.default_rng(3).random((lm.ORDER + 1, lm._BINS))
    model.weights[:, 0] = 0
    for context in [("<", "<"), ("<", "a"), ("a", "b"), ("b", "a"), ("never", "a"), ("never", "seen")]:
        held = [lm.levels(np.array([grams[n][(*context, w)[3 - n :]] for w in [*words, "unknown"]])) for n in range(1, lm.ORDER + 1)]
        before = [lm.levels(np.full(len(words) + 1, grams[n][context[2 - n :]])) for n in range(1, lm.ORDER)]
        assert max(grams[n][context[2 - n :]] for n in range(1, lm.ORDER)) <= 7
        assert model.probability(held, before, lm.ORDER).sum() == pytest.approx(1)


def test_mil_finds_bad_passages():
    g = random.Random(2)
    good = ["".join(g.choice(["the ", "cat ", "sat ", "on ", "mat. "]) for _ in range(g.randint(5, 200))) for _ in range(60)]
    bad = ["".join(g.choice(["THE!! ", "CAT%%% ", "###$$ "]) for _ in range(g.randint(5, 200))) for _ in range(60)]
    offsets, raw = buffers(good + bad)
    x, begins = quality.passages(offsets, raw)
    bags = [x[a:b] for a, b in zip(begins[:-1], begins[1:])]
    y = np.array([1.0] * 60 + [0.0] * 60, dtype=np.float32)
    model = quality.AttentionMil().fit(bags[::2], y[::2])
    s = model.score(x, begins)
    assert (s[:60] >= 0.3).all() and (s[60:] < 0.3).all()
    assert np.isfinite(model.score(*quality.passages(*buffers(["", None, "\n"])))).all()
    assert quality.AttentionMil().fit(bags[:3], y[:3]).score(x, begins)[0] == 1.0


def test_gradients_of_the_network():
    texts = ["you are a clown they said", "what a fine day it is today my friend", "clown clown"]
    offsets, raw = buffers(texts)
    model = toxicity.BiGru(toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0)))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    some = toxicity._Some(toxicity.Texts(offsets, raw, model.lexicon), np.arange(3))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        out = model.forward(model.inputs(some), some.windows, some.mask)[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(out)) - y * out))

    grads = model._gradients(some, y)
    for name in ("o", "av", "aw", "uf", "nb", "xf", "bb"):
        flat = model.p[name].reshape(-1)
        k = int(np.abs(grads[name].reshape(-1)).argmax())
        old = flat[k]
        flat[k] = old + 1e-2
        up = loss()
        flat[k] = old - 1e-2
        down = loss()
        flat[k] = old
        assert grads[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def test_toxic_words_are_learned():
    g = random.Random(3)
    plain = [f"{a}{b}" for a in "bdfgklmn" for b in ("ara", "ilo", "une", "ets")]
    say = lambda n, extra=(): " ".join(g.sample([*(g.choice(plain) for _ in range(n)), *extra], n + len(extra)))
    texts = [say(g.randint(3, 90)) for _ in range(120)] + [say(g.randint(3, 90), ("idiot", "scum")) for _ in range(60)]
    y = np.array([0.0] * 120 + [1.0] * 60, dtype=np.float32)
    offsets, raw = buffers(texts)
    model = toxicity.BiGru(toxicity.lexicon(offsets, raw, y)).fit(offsets, raw, y)
    s = model.score(*buffers([say(20), say(60, ("scum",)), "", None]))
    assert s[0] < 0.7 <= s[1] and s[2] == s[3] < 0.7


def test_windows_cover_every_word():
    for n in (0, 1, 24, 25, 40, 41, 100):
        t = toxicity.Texts(*buffers([" ".join(f"w{i}" for i in range(n))]), toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0)))
        assert len(set(t.windows[t.mask].tolist())) == n


def test_crc_split_is_zlibs():
    assert Counter(zlib.crc32(str(i).encode()) % 5 for i in range(1000)).keys() == {0, 1, 2, 3, 4}
