"""The model's steps and look-ups against their plain form, and what they may cost."""

import math
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rulespark.llm import lm_score

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
ODD = [" Two\t\x0bwords\x1cTHREE \n", None, "", " \r\n", "Äpfel ÄPFEL a\x85b non\xa0breaking space", "\x00 x", "one"]


def plain_words(text):
    return (text or "").encode().translate(LOWER).split()


def model_of(n=3000):
    words = [(lm_score.END, 5000), *((f"w{k}".encode(), 100_000 // (k + 1) + 1) for k in range(n))]
    sums = Counter()
    for w, k in words[lm_score.SYMBOLS - lm_score.CLASSES :]:
        sums[lm_score.class_of(w)] += k + 1
    return lm_score.Model(words, dict(sums))


def drawn(model, n, seed=1):
    """(triples of symbols, last symbols and items of pairs)"""
    draw, often = np.random.default_rng(seed), 1 / np.arange(1, lm_score.SYMBOLS + 1)
    symbols = [draw.choice(lm_score.SYMBOLS, n, p=often / often.sum()) for _ in range(4)]
    items = np.minimum(np.searchsorted(model.reach, draw.random(n) * lm_score.CLASSES), len(model.reach) - 1)
    return symbols[:3], symbols[3], items


class Plain:
    """Noise-contrastive steps as the formulas have them, each array made where it is needed."""

    def __init__(self, model):
        self.model = model
        self.seen = {x: np.ones(getattr(model, x).shape, np.float32) for x in "rqcbtpd"}

    def step(self, name, g, rows=slice(None)):
        p, seen = getattr(self.model, name), self.seen[name]
        seen[rows] += g * g
        p[rows] += lm_score.RATE * g / np.sqrt(seen[rows])

    @staticmethod
    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    @staticmethod
    def sums(at, values, n):
        d = values.shape[1]
        return np.bincount((at[:, None] * d + np.arange(d)).ravel(), values.ravel(), n * d).reshape(n, d).astype(np.float32)

    def train(self, symbols, seed):
        m, draw = self.model, np.random.default_rng(seed)
        r, q, c, b = m.r, m.q, m.c, m.b
        s, shift = len(r), np.log(lm_score.NOISE * m.noise).astype(np.float32)
        order = draw.permutation(len(symbols[0]))
        for k in range(0, len(order), lm_score.BATCH):
            h1, h2, w = (x[order[k : k + lm_score.BATCH]] for x in symbols)
            v = draw.choice(s, lm_score.NOISE, p=m.noise)
            hat = r[h1] * c[0] + r[h2] * c[1]
            good = 1 - self.sigmoid((hat * q[w]).sum(1) + b[w] - shift[w])
            bad = -self.sigmoid(hat @ q[v].T + b[v] - shift[v])
            back = good[:, None] * q[w] + bad @ q[v]
            gq = self.sums(w, good[:, None] * hat, s)
            np.add.at(gq, v, bad.T @ hat)
            gb = np.bincount(w, good, s).astype(np.float32)
            np.add.at(gb, v, bad.sum(0))
            gc = np.stack([(back * r[h1]).sum(0), (back * r[h2]).sum(0)]) / 64
            gr = self.sums(h1, back * c[0], s) + self.sums(h2, back * c[1], s)
            for name, g in (("r", gr), ("q", gq), ("c", gc), ("b", gb)):
                self.step(name, g)

    def train_inner(self, last, item, seed):
        m, draw = self.model, np.random.default_rng(seed)
        t, p, d = m.t, m.p, m.d
        shift = np.log(lm_score.INNER_NOISE * m.share).astype(np.float32)
        order = draw.permutation(len(item))
        for k in range(0, len(order), lm_score.INNER_BATCH):
            pick = order[k : k + lm_score.INNER_BATCH]
            h, w = last[pick], item[pick]
            v = np.minimum(np.searchsorted(m.reach, m.item_class[w][:, None] + draw.random((len(w), lm_score.INNER_NOISE))), len(m.reach) - 1)
            hat = t[h]
            good = 1 - self.sigmoid((hat * p[w]).sum(1) + d[w] - shift[w])
            bad = -self.sigmoid((hat[:, None] * p[v]).sum(2) + d[v] - shift[v])
            back = good[:, None] * p[w] + (bad[:, :, None] * p[v]).sum(1)
            own, which = np.unique(np.append(w, v.ravel()), return_inverse=True)
            change = np.concatenate([good[:, None] * hat, (bad[:, :, None] * hat[:, None]).reshape(-1, lm_score.INNER)])
            self.step("p", self.sums(which, change, len(own)), own)
            self.step("d", np.bincount(which, np.append(good, bad.ravel()), len(own)).astype(np.float32), own)
            self.step("t", self.sums(h, back, len(t)))


@pytest.mark.parametrize("noise", [1, 3])
def test_steps_are_the_plain_ones(monkeypatch, noise):
    monkeypatch.setattr(lm_score, "INNER_NOISE", noise)
    given = model_of()
    fast, slow = given.own(), given.own()
    plain = Plain(slow)
    for seed, n in ((1, 5000), (2, 300), (3, 9001)):  # last steps are short ones
        triples, last, items = drawn(given, n, seed)
        fast.train(triples, seed)
        fast.train_inner(last, items, seed + 1)
        plain.train(triples, seed)
        plain.train_inner(last, items, seed + 1)
    for name in "rqcbtpd":
        assert np.allclose(getattr(fast, name), getattr(slow, name), atol=1e-4), name
        assert not np.allclose(getattr(fast, name), getattr(given, name), atol=1e-4), name
    assert fast.common is given.common and fast.items is given.items  # a task copies no words


def test_steps_keep_their_arrays():
    """Arrays of a hundred KB and more, made anew in each step, cost more CPU than the sums."""
    model = model_of().own()
    triples, last, items = drawn(model, 2 * lm_score.INNER_BATCH)
    few = [x[: 4 * lm_score.BATCH] for x in triples]
    for run, most in ((lambda: model.train(few, 1), 400_000), (lambda: model.train_inner(last, items, 1), 900_000)):
        run()
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most


def test_steps_cost_less_than_plain_ones():
    fast, plain = model_of(30_000).own(), Plain(model_of(30_000))
    triples, last, items = drawn(fast, 60_000)

    def cost(x):
        start = time.process_time()
        x.train(triples, 1)
        x.train_inner(last, items, 2)
        return time.process_time() - start

    runs = [(cost(fast), cost(plain)) for _ in range(5)]
    assert min(a for a, _ in runs) < 0.85 * min(b for _, b in runs)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_of_texts(kind):
    texts = pa.array(["left out", *ODD, "left out"], kind).slice(1, len(ODD))
    words, sizes = lm_score.words_of(texts)
    want = [plain_words(t) for t in ODD]
    assert sizes.tolist() == [len(x) for x in want] and words.to_pylist() == [w for x in want for w in x]
    assert lm_score.words_of(pa.array([None, ""], kind))[1].tolist() == [0, 0]
    assert lm_score.words_of(pa.array([], kind))[1].tolist() == []


def test_classes_and_numbers_of_words():
    words = [b"", b"a", b"bc", b"def", b"ghij", "Äß".encode(), b"\x00", b"w7", b"unseen"]
    for array in (pa.array(words, pa.binary()), pa.array([b"xyz", *words], pa.binary()).slice(1)):
        assert lm_score.classes_of(array).tolist() == [zlib.crc32(w[-3:]) % lm_score.CLASSES for w in words]
    assert lm_score.classes_of(pa.array([b""], pa.binary())).tolist() == [0] and not len(lm_score.classes_of(pa.array([], pa.binary())))
    model = model_of()
    known, place = model.lookup(), {w: k for k, (w, _) in enumerate(model.common)}
    number = lambda w: place.get(w, known.others + lm_score.class_of(w))
    _, sizes, numbers, rare = known.of(pa.array(["W1 new w2 new", None, "w2999 w3000"]))
    assert sizes.tolist() == [4, 0, 2] and rare.tolist() == [1, 3, 5]
    assert numbers.tolist() == [number(w) for w in (b"w1", b"new", b"w2", b"new", b"", b"", b"w2999", b"w3000", b"")]


def test_scores_are_the_models(spark, monkeypatch):
    """Every text's sums against the formulas, token by token; most words are not among the common ones."""
    monkeypatch.setattr(lm_score, "COMMON", 900)
    texts = [*ODD, *(" ".join(f"v{(k * j) % (40 * j + 1)}" for k in range(60)) + " once twice twice" * (j % 3) for j in range(1, 80))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    training = df.filter("doc_id % 4 <> 1")
    counts = Counter(w for k, t in enumerate(texts) if k % 4 != 1 for w in (*plain_words(t), lm_score.END))
    assert {bytes(r["word"]): r["n"] for r in lm_score.count_words(training.select("text")).collect()} == counts
    model, vocabulary, tokens, distinct = lm_score.fit(training)
    assert (tokens, distinct) == (sum(counts.values()), len(counts)) and 767 < len(model.common) <= 900 < len(counts)
    got = {r["doc_id"]: r for r in lm_score.score(df, model, vocabulary, tokens, distinct).collect()}
    one, two = model.contexts()
    heads, common, tail = {w: k for k, w in enumerate(model.heads)}, dict(model.common), lm_score.SYMBOLS - lm_score.CLASSES
    for k, text in enumerate(texts):
        words, h1, h2, score = [*plain_words(text), lm_score.END], 0, 0, 0.0
        for w in words:
            c = lm_score.class_of(w)
            symbol = heads.get(w, tail + c)
            score += float(one[h1, symbol] + two[h2, symbol] - model.log_z[h1, h2]) / math.log(10)
            if w not in heads:
                item = model.items.get(w, model.first[c])
                score += float(model.t[h1] @ model.p[item] + model.d[item] - model.log_y[h1, c]) / math.log(10)
                if w not in model.items:
                    score += math.log10(counts[w] + 1) - math.log10(model.rare_sums[c])
            h1, h2 = symbol, h1
        assert got[k]["n_tokens"] == len(words) and got[k]["n_known"] == sum(counts[w] > 0 for w in words)
        assert got[k]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (tokens + distinct + 1)) for w in words))
        assert got[k]["score"] == pytest.approx(score, rel=1e-4)
