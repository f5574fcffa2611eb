"""A log-bilinear language model, trained by noise-contrastive estimation, scores every text.

Two levels, each normalised exactly.  Symbols are the most frequent training words, the end of a text, and classes of
the other words by their last bytes.  The score of symbol w after symbols h1 (last) and h2 is
(c1*r[h1] + c2*r[h2]).q[w] + b[w].  Because the two context terms only add, the normaliser of every pair of contexts comes
from one matrix product, exp(U1) @ exp(U2 + b).T.  Inside a class, the items are its words among the `VECTORS` most
frequent ones, each with a vector of its own, and one item for all its rarer words; their score after h1 is t[h1].p[w] + d[w],
and the normalisers of all pairs of h1 and class come from t @ p.T.  So a token's probability takes a few table look-ups.
A word of the rare item has its smoothed share of it.

Training: every task runs stochastic gradient steps over all training texts of its partition, from common first
values; the tasks' parameters are averaged, weighted by tokens, in a tree.  The first round takes a share of the
texts, the second the others.  Counts cover all training texts.  What is sent to the tasks is bounded: `SYMBOLS`
squared numbers, `VECTORS` short vectors and the `COMMON` most frequent words; rarer words of a text are joined to the
vocabulary table.

Defined cases: a null or empty text has the end token alone; a null id counts as the empty string for the fold;
repeated rows are trained on and scored each; ties in frequency go by word; extra columns are not read; with no
training text all counts are 0; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, lean, read, small_batches, stored

FOLDS, HELD_OUT = 7, 2
#: Symbols (words, end, classes), vector length, words sent to the tasks.
CLASSES, SYMBOLS, DIMENSIONS, COMMON = 256, 1024, 24, 100_000
#: Words with vectors inside their class, and the vectors' length.
VECTORS, INNER = 32_768, 8
#: Training: tokens in a step, noise words, first rate; the folds of the first round.
BATCH, NOISE, RATE, FIRST_ROUND = 1024, 32, 0.05, (0, 1)
INNER_BATCH, INNER_NOISE = 4096, 1
#: The end of a text in the vocabulary; no word is empty.
END = b""
#: Averages taken together, and bytes of words counted together, in a task; texts scored together.
FAN_IN, COUNTED, TOGETHER = 32, 32 << 20, 32
#: Tables of this Python worker, by broadcast.
TABLES = KEPT["lm_score"] = {}


def words_of(texts):
    """(words of all texts as one Arrow array, how many each text has), of an Arrow column; a null text has none."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten().cast(pa.binary()), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    # separators at either end of a text give empty words
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before, ends = np.append(0, np.cumsum(full)), np.cumsum(sizes)
    return words.filter(pa.array(full)), before[ends] - before[ends - sizes]


def fold(name: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % FOLDS


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of one text column; the end of each text counts as a word."""

    def run(batches):
        import pyarrow as pa

        def out(held, ends):
            counts = pa.chunked_array(held, pa.binary()).value_counts()
            held.clear()  # the words may go before their counts are taken away
            words, n = counts.field("values"), counts.field("counts")
            return pa.RecordBatch.from_arrays([pa.concat_arrays([words, pa.array([END])]), pa.concat_arrays([n, pa.array([ends])])], ["word", "n"])

        held, ends, size = [], 0, 0
        for batch in batches:
            held.append(words_of(batch.column(0))[0])
            ends, size = ends + batch.num_rows, size + held[-1].nbytes
            if size > COUNTED:
                yield out(held, ends)
                ends, size = 0, 0
        if ends:
            yield out(held, ends)

    return texts.mapInArrow(lean(run, "lm_score"), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _crc_table():
    """What a byte adds to zlib.crc32."""
    import numpy as np

    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    return table


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def class_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -3, 3)) % CLASSES).cast("int")


def classes_of(words):
    """class_of for an Arrow array of words."""
    import numpy as np

    ends, data = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1], words.buffers()[2]
    crc, table = np.full(len(words), 0xFFFFFFFF, np.uint32), _crc_table()
    if data and data.size:
        data, sizes, ends = np.frombuffer(data, np.uint8), np.diff(ends), ends[1:]
        for back in (3, 2, 1):
            has = np.flatnonzero(sizes >= back)
            old = crc[has]
            crc[has] = table[(old ^ data[ends[has] - back]) & 255] ^ (old >> 8)
    return (~crc % CLASSES).astype(np.int64)


class Numbers:
    """Numbers of words, with arrays by number: symbol, item (-1 for a word that is a symbol), log, share.

    A word that is not `common` gets the number of its class, `others` and more."""

    def __init__(self, common):
        self.common, self.others = common, len(common)

    def of(self, texts):
        """(words, how many each text has, numbers of the words and of each text's end, which words are not common)."""
        import numpy as np

        words, sizes = words_of(texts)
        number, rare = self.numbers(words)
        out = np.full(len(number) + len(sizes), self.end, np.int64)
        out[np.arange(len(number)) + np.repeat(np.arange(len(sizes)), sizes)] = number
        return words, sizes, out, rare

    def numbers(self, words):
        """(number of each word, places of those that are not common)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        number = pc.index_in(words, value_set=self.common).fill_null(-1).to_numpy().astype(np.int64)
        rare = np.flatnonzero(number < 0)
        number[rare] = self.others + classes_of(words.take(pa.array(rare)))
        return number, rare

    def __getitem__(self, word: bytes) -> int:
        import pyarrow as pa

        return int(self.numbers(pa.array([word], pa.binary()))[0][0])


class Model:
    """Symbol tables and parameters; small enough to broadcast."""

    def __init__(self, common: list[tuple[bytes, int]], class_sums: dict[int, int]):
        import numpy as np

        heads = [END] + [w for w, _ in common if w != END][: SYMBOLS - CLASSES - 1]
        self.name, self.common, self.heads = uuid.uuid4().hex, common, heads
        counts = dict(common)
        # totals of the classes: seen words count n + 1, all unseen words of a class 1 together
        self.class_sums = np.array([class_sums.get(k, 0) + 1.0 for k in range(CLASSES)])
        weight = np.ones(SYMBOLS)
        weight[: len(heads)] += [counts.get(w, 0) for w in heads]
        weight[SYMBOLS - CLASSES :] = self.class_sums
        self.noise = weight / weight.sum()
        draw = np.random.default_rng(7)
        self.r, self.q = (draw.normal(0, 0.1, (SYMBOLS, DIMENSIONS)).astype(np.float32) for _ in range(2))
        self.c = np.array([[1.0], [0.5]], np.float32) * np.ones((2, DIMENSIONS), np.float32)
        self.b = np.log(self.noise).astype(np.float32)
        self.log_z = self.log_y = None
        # items by class: the rare one first, then the words in order of frequency
        head = set(heads)
        inner = [(class_of(w), w, n) for w, n in common if w not in head][:VECTORS]
        by_class: list[list] = [[] for _ in range(CLASSES)]
        for c, w, n in inner:
            by_class[c].append((w, n + 1.0))
        self.items, shares, first = {}, [], []
        self.rare_sums = np.zeros(CLASSES)
        for c, words in enumerate(by_class):
            first.append(len(shares))
            # words beyond the vectors count n + 1 each, the unseen ones 1 together
            self.rare_sums[c] = max(self.class_sums[c] - sum(n for _, n in words), 1.0)
            shares.append(self.rare_sums[c])
            for w, n in words:
                self.items[w] = len(shares)
                shares.append(n)
        self.first, weights = np.array(first), np.array(shares)
        self.item_class = np.repeat(np.arange(CLASSES), np.diff(np.append(first, len(shares))))
        self.share = weights / np.add.reduceat(weights, self.first)[self.item_class]
        self.reach = np.cumsum(self.share)  # class c covers c .. c + 1
        self.t = draw.normal(0, 0.1, (SYMBOLS, INNER)).astype(np.float32)
        self.p = np.zeros((len(shares), INNER), np.float32)
        self.d = np.log(self.share).astype(np.float32)

    def lookup(self) -> Numbers:
        """Numbers of words: of the common ones in order, then of the classes of all others."""
        import numpy as np
        import pyarrow as pa

        words, counts = [w for w, _ in self.common], [n for _, n in self.common]
        if END not in words:
            words, counts = [*words, END], [*counts, 0]
        common = pa.array(words, pa.binary())
        numbers, n, tail = Numbers(common), len(words), SYMBOLS - CLASSES
        numbers.end = words.index(END)
        classes = np.append(classes_of(common), np.arange(CLASSES))
        heads = {w: k for k, w in enumerate(self.heads)}
        numbers.symbol = np.append([heads.get(w, -1) for w in words], np.full(CLASSES, -1)).astype(np.int32)
        inside = numbers.symbol < 0
        numbers.item = np.append([self.items.get(w, -1) for w in words], np.full(CLASSES, -1)).astype(np.int32)
        scarce = inside & (numbers.item < 0)
        numbers.symbol[inside], numbers.item[scarce] = tail + classes[inside], self.first[classes[scarce]]
        numbers.log = np.log10(np.append(counts, np.zeros(CLASSES)) + 1)
        # what a word of a rare item adds: its share of the item, or of an unseen word the item's part alone
        numbers.share = np.where(scarce, numbers.log - np.log10(self.rare_sums)[classes], 0.0)
        return numbers

    def parameters(self) -> list:
        return [self.r, self.q, self.c, self.b, self.t, self.p, self.d]

    def pack(self) -> bytes:
        return b"".join(p.astype("<f4").tobytes() for p in self.parameters())

    def unpack(self, raw: bytes) -> None:
        import numpy as np

        flat, at = np.frombuffer(raw, "<f4"), 0
        for name in "rqcbtpd":
            p = getattr(self, name)
            setattr(self, name, flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        self.log_z = self.log_y = None

    def contexts(self):
        """(U1, U2): the parts of the score by last and last but one symbol; b is in the second."""
        return (self.r * self.c[0]) @ self.q.T, (self.r * self.c[1]) @ self.q.T + self.b

    def normalise(self) -> None:
        import numpy as np

        one, two = (u.astype(np.float64) for u in self.contexts())
        high, low = one.max(1, keepdims=True), two.max(1, keepdims=True)
        self.log_z = (np.log(np.exp(one - high) @ np.exp(two - low).T) + high + low.T).astype(np.float32)
        self.log_y = np.empty((SYMBOLS, CLASSES), np.float32)
        for at in range(0, SYMBOLS, 64):
            inner = np.exp((self.t[at : at + 64] @ self.p.T + self.d).astype(np.float64))
            self.log_y[at : at + 64] = np.log(np.add.reduceat(inner, self.first, axis=1))

    def own(self) -> Model:
        """A copy with parameters of its own; words and tables are shared."""
        import copy

        out = copy.copy(self)
        for name, p in zip("rqcbtpd", self.parameters()):
            setattr(out, name, p.copy())
        return out

    def train_inner(self, last, item, seed: int) -> None:
        """Noise-contrastive steps over pairs (last symbol, item); noise comes from the item's class."""
        import numpy as np

        draw = np.random.default_rng(seed)
        t, p, d = self.t, self.p, self.d
        if not hasattr(self, "seen_inner"):
            self.seen_inner = [np.full(x.shape, 1.0, np.float32) for x in (t, p, d)]
            size = INNER_BATCH * (1 + INNER_NOISE)
            self.space_inner = [Sums(*t.shape), Sums(size, INNER), Search(self.reach), np.zeros(d.shape, bool), np.zeros(d.shape, np.int64)]
            self.space_inner += [np.empty((n, INNER), np.float32) for n in (INNER_BATCH, INNER_BATCH, size, size, size, size)]
        sums_t, sums_p, search, mark, slot, *space = self.space_inner
        seen_t, seen_p, seen_d = self.seen_inner
        # rows as single values: set several times faster by number
        p_rows, seen_rows = (x.view(f"V{4 * INNER}").reshape(-1) for x in (p, seen_p))
        bias = np.log(INNER_NOISE * self.share).astype(np.float32)
        pairs = item * SYMBOLS + last
        order = draw.permutation(len(item))
        for k in range(0, len(order), INNER_BATCH):
            w, h = np.divmod(pairs.take(order[k : k + INNER_BATCH]), SYMBOLS)
            m = len(w)
            v = search(self.item_class.take(w)[:, None] + draw.random((m, INNER_NOISE)))
            at = np.append(w, v)
            hat, back = (x[:m] for x in space[:2])
            own, change = (x[: len(at)] for x in space[2:4])
            t.take(h, 0, hat, "clip")
            p.take(at, 0, own, "clip")
            shifts = (d - bias).take(at)
            noise, noise_change = (x[m:].reshape(m, INNER_NOISE, INNER) for x in (own, change))
            good = 1 - _sigmoid(np.einsum("ij,ij->i", hat, own[:m]) + shifts[:m])
            bad = _sigmoid(np.einsum("ij,ikj->ik", hat, noise) + shifts[m:].reshape(m, INNER_NOISE), -1)
            np.einsum("ik,ikj->ij", bad, noise, out=back)
            back += np.einsum("i,ij->ij", good, own[:m], out=own[:m])
            np.einsum("i,ij->ij", good, hat, out=change[:m])
            np.einsum("ik,ij->ikj", bad, hat, out=noise_change)
            # the items of the step, each once, and their slots in the sums
            mark[at] = True
            used = np.flatnonzero(mark)
            mark[used] = False
            slot[used] = np.arange(len(used))
            which = slot.take(at)
            sums_p.add(which, change)
            mine, total, work = (x[: len(used)] for x in space[3:])
            p.take(used, 0, mine, "clip")
            seen_p.take(used, 0, total, "clip")
            sums_p.step(mine, total, work)
            p_rows[used], seen_rows[used] = (x.view(p_rows.dtype).reshape(-1) for x in (mine, total))
            gd = np.bincount(which, np.append(good, bad.ravel()), len(used)).astype(np.float32)
            mine, total = d.take(used), seen_d.take(used)
            _step(mine, total, gd)
            d[used], seen_d[used] = mine, total
            sums_t.add(h, back)
            sums_t.step(t, seen_t)

    def train(self, symbols, seed: int) -> None:
        """Noise-contrastive steps over triples (last, last but one, next) of symbols."""
        import numpy as np

        draw = np.random.default_rng(seed)
        r, q, c, b = self.parameters()[:4]
        s, d = r.shape
        shift = np.log(NOISE * self.noise).astype(np.float32)
        if not hasattr(self, "seen"):
            self.seen = [np.full(p.shape, 1.0, np.float32) for p in (r, q, c, b)]
            self.space = [Sums(s, d), Sums(s, d), np.empty((s, d), np.float32), np.ones(BATCH, np.float32), *(np.empty((BATCH, d), np.float32) for _ in range(6)), np.empty((BATCH, NOISE), np.float32)]
        sums_r, sums_q, steps, *space = self.space
        seen_r, seen_q, seen_c, seen_b = self.seen
        reach = self.noise.cumsum()
        reach /= reach[-1]
        one, two, target = symbols
        triples = (one * s + two) * s + target
        order = draw.permutation(len(target))
        gc = np.empty_like(c)
        for k in range(0, len(order), BATCH):
            rest, w = np.divmod(triples.take(order[k : k + BATCH]), s)
            h1, h2 = np.divmod(rest, s)
            v = reach.searchsorted(draw.random(NOISE), "right")
            ones, r1, r2, qw, hat, back, work, bad = (x[: len(w)] for x in space)
            r.take(h1, 0, r1, "clip")
            r.take(h2, 0, r2, "clip")
            q.take(w, 0, qw, "clip")
            np.multiply(r1, c[0], out=hat)
            hat += np.multiply(r2, c[1], out=work)
            qv, level = q[v], b - shift
            good = 1 - _sigmoid(np.einsum("ij,ij->i", hat, qw) + level[w])
            np.matmul(hat, qv.T, out=bad)
            bad += level[v]
            _sigmoid(bad, -1)
            np.matmul(bad, qv, out=back)
            back += np.einsum("i,ij->ij", good, qw, out=qw)
            np.einsum("ij,ij->j", back, r1, out=gc[0])
            np.einsum("ij,ij->j", back, r2, out=gc[1])
            gc /= 64
            sums_q.add(w, np.einsum("i,ij->ij", good, hat, out=work))
            sums_q.add(v, bad.T @ hat)
            gb = np.bincount(w, good, s).astype(np.float32)
            np.add.at(gb, v, ones @ bad)
            sums_r.add(h1, np.multiply(back, c[0], out=work))
            sums_r.add(h2, np.multiply(back, c[1], out=work))
            sums_r.step(r, seen_r, steps)
            sums_q.step(q, seen_q, steps)
            _step(c, seen_c, gc)
            _step(b, seen_b, gb)


def _sigmoid(x, top: int = 1):
    """top / (1 + exp(-x)), in the place of x."""
    import numpy as np

    np.minimum(x, 30, out=x)
    np.maximum(x, -30, out=x)
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.divide(top, x, out=x)


def _step(p, total, g, work=None) -> None:
    """An AdaGrad step in place; g is used up."""
    import numpy as np

    work = np.multiply(g, g, out=work)
    total += work
    g *= RATE
    g /= np.sqrt(total, out=work)
    p += g


class Sums:
    """Sums of rows (of even length) by number, kept from step to step: large arrays made anew cost more than the sums.

    Two neighbours are added as one complex number.
    """

    def __init__(self, n: int, d: int):
        import numpy as np

        self.sums = np.zeros((n, d), np.float32)
        self.pairs = self.sums.reshape(-1).view(np.complex64)
        self.places = np.arange(n * d // 2).reshape(n, d // 2)
        self.room = np.empty((0, d // 2), np.int64)

    def add(self, at, rows) -> None:
        import numpy as np

        if len(at) > len(self.room):
            self.room = np.empty((len(at), self.room.shape[1]), np.int64)
        places = self.places.take(at, 0, self.room[: len(at)], "clip")
        np.add.at(self.pairs, places.reshape(-1), rows.reshape(-1).view(np.complex64))

    def step(self, p, total, work=None) -> None:
        """A step of the first len(p) rows, which are at zero after it."""
        g = self.sums[: len(p)]
        _step(p, total, g, work)
        g[...] = 0


class Search:
    """np.searchsorted in ascending numbers from 0 to CLASSES: a guide of narrow bins, and a search where a number divides the bin."""

    def __init__(self, numbers, bins: int = 1024):
        import numpy as np

        self.numbers, self.bins = numbers, bins
        low, high = (np.searchsorted(numbers, np.arange(CLASSES * bins + 1) / bins + x / bins) for x in (0, 1))
        self.guide = np.where(low == high, np.minimum(low, len(numbers) - 1), -1).astype(np.int32)

    def __call__(self, x):
        """For x from 0 to CLASSES; beyond the last number it is the last."""
        import numpy as np

        x = x.ravel()
        out = self.guide.take((x * self.bins).astype(np.int64))
        divided = np.flatnonzero(out < 0)
        out[divided] = np.minimum(np.searchsorted(self.numbers, x.take(divided)), len(self.numbers) - 1)
        return out


def _placed(known: Numbers, number, sizes):
    """(symbols with two marks before each text, places of the tokens there), of the numbers of texts of so many tokens."""
    import numpy as np

    places = np.arange(len(number)) + 2 * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    symbols = np.zeros(len(number) + 2 * len(sizes), np.int64)
    symbols[places] = known.symbol[number]
    return symbols, places


def _table(shared):
    """(model, lookup) of a broadcast, once in each Python worker."""
    model = shared.value
    if model.name not in TABLES:
        TABLES.clear()
        TABLES[model.name] = model.lookup()
    return model, TABLES[model.name]


def train_round(texts: DataFrame, model: Model, seed: int) -> None:
    """One pass over the texts; sets the model to the average of the tasks' parameters."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        given, known = _table(shared)
        own, tokens, part = given.own(), 0, TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                _, sizes, number, _ = known.of(batch.column(0).slice(at, 512))
                flat, places = _placed(known, number, sizes + 1)
                items = known.item[number]
                start = seed * 1_000_003 + part * 1009 + tokens % 1009
                own.train((flat[places - 1], flat[places - 2], flat[places]), start)
                inner = (items >= 0).nonzero()[0]
                own.train_inner(flat[places[inner] - 1], items[inner], start + 1)
                tokens += len(places)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([own.pack()], pa.binary())], ["part", "tokens", "raw"])

    def average(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict[int, list] = {}
        for batch in batches:
            for part, tokens, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                total = sums.setdefault(part, [0, 0.0])
                total[0] += tokens
                total[1] = total[1] + np.frombuffer(raw, "<f4").astype(np.float64) * tokens
        for part, (tokens, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary())], ["part", "tokens", "raw"])

    schema = "part long, tokens long, raw binary"
    rows = stored(texts.mapInArrow(lean(run, "lm_score"), schema), "trained")
    left = rows.count()
    while left > 1:
        left = -(-left // FAN_IN)
        rows = stored(rows.select((F.col("part") % left).alias("part"), "tokens", "raw").repartition(left, "part").mapInArrow(average, schema), "averaged")
    if best := rows.first():
        model.unpack(bytes(best["raw"]))


def _frequent(vocabulary: DataFrame) -> DataFrame:
    """At most COMMON words (more only if the top step alone has more): those above a step of frequency.

    Without it every task of the sort would send its own COMMON words to the driver.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    words, low = 0, None
    for row in vocabulary.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():  # a few hundred steps
        words += row["words"]
        if low is not None and words > COMMON:
            break
        low = row["step"]
    return vocabulary if low is None else vocabulary.filter(step >= low)


def fit(training: DataFrame) -> tuple[Model, DataFrame, int, int]:
    """(model, vocabulary table, tokens, distinct words) of the training rows (doc_id, text)."""
    vocabulary = stored(count_words(small_batches(training).select("text")), "vocabulary")
    size = vocabulary.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    common = [(bytes(r["word"]), r["n"]) for r in _frequent(vocabulary).orderBy(F.desc("n"), "word").limit(COMMON).collect()]
    heads = [w for w, _ in common if w != END][: SYMBOLS - CLASSES - 1]
    small = training.sparkSession.createDataFrame([(END,), *((w,) for w in heads)], "word binary")
    sums = vocabulary.join(F.broadcast(small), "word", "left_anti").groupBy(class_column(F.col("word")).alias("class")).agg(F.sum(F.col("n") + 1).alias("n")).collect()
    model = Model(common, {r["class"]: r["n"] for r in sums})
    early = fold().isin(*FIRST_ROUND)
    train_round(training.filter(early).select("text"), model, 1)
    train_round(training.filter(~early).select("text"), model, 2)
    model.normalise()
    return model, vocabulary, size["n"] or 0, size["v"] or 0


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, tokens: int, distinct: int) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ten, floor = math.log(10), math.log10(tokens + distinct + 1)
    schema = "row_id long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        model, known = _table(shared)
        one, two, log_z, log_y = (x.ravel() for x in (*model.contexts(), model.log_z, model.log_y))
        at, tail = TaskContext.get().partitionId() << 36, SYMBOLS - CLASSES
        for batch in (b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)):
            words, sizes, numbers, scarce = known.of(batch.column(1))
            sums: list[list] = [[], [], []]
            ends = np.cumsum(sizes + 1)
            for first in range(0, len(sizes), TOGETHER):
                some = sizes[first : first + TOGETHER] + 1
                starts = np.cumsum(some) - some
                number = numbers[ends[first] - some[0] :][: some.sum()]
                symbols, places = _placed(known, number, some)
                item, h2, h1, w = known.item[number], symbols[places - 2], symbols[places - 1], symbols[places]
                logs = (one.take(h1 * SYMBOLS + w) + two.take(h2 * SYMBOLS + w) - log_z.take(h1 * SYMBOLS + h2)).astype(np.float64)
                inside = np.flatnonzero(item >= 0)
                own, last, classes = item[inside], h1[inside], w[inside] - tail
                logs[inside] += np.einsum("ij,ij->i", model.t.take(last, 0), model.p.take(own, 0)) + model.d[own] - log_y.take(last * CLASSES + classes)
                base = known.log[number]
                for x, y in zip(sums, (base > 0, base, logs / ten + known.share[number])):
                    x.append(np.add.reduceat(y, starts, dtype=np.int64 if y.dtype == bool else None))
            # words that are not common: each once in a text
            coded = words.take(pa.array(scarce)).dictionary_encode()
            kinds = len(coded.dictionary)
            text, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[scarce] * kinds + coded.indices.to_numpy(), return_counts=True)
            text, word = np.divmod(text, max(kinds, 1))
            rare = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(word)), pa.array(n, pa.int64())], ["word", "n"])
            rare = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32()), rare)
            known_here, base, total = map(np.concatenate, sums)
            columns = [pa.array(at + np.arange(len(sizes))), batch.column(0), pa.array(sizes + 1), pa.array(known_here), pa.array(base), pa.array(total), rare]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "doc_id", "n_tokens", "n_known", "base", "score", "rare"])
            at += len(sizes)

    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run, "lm_score"), schema), "scored")
    rare = rows.select("row_id", F.explode("rare").alias("x")).select("row_id", "x.word", F.col("x.n").alias("times"))
    # a word that training has not seen adds log10(1) = 0 to either sum
    more = rare.join(vocabulary, "word").groupBy("row_id").agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = rows.drop("rare").join(more, "row_id", "left")
    nothing = F.lit(0)
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", nothing)).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", nothing) - F.col("n_tokens") * floor).alias("base_score"), (F.col("score") + F.coalesce("logs", nothing)).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model, vocabulary, tokens, distinct = fit(docs.filter(fold() != HELD_OUT))
    return score(docs, model, vocabulary, tokens, distinct).withColumn("held_out", fold() == HELD_OUT).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
