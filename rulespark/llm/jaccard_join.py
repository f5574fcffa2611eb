"""N-gram Jaccard self-join by parity sketches.

A document is the set of its distinct word shingles (64-bit hashes).  Equal sets form a class, and only classes
are compared.  Two sets of sizes a and b with Jaccard at least t differ in at most (1-t)/(1+t)(a+b) shingles.
Sizes fall into bands so that linked sets lie in one band or in neighbours.  For a band with at most D differences
a sketch has m > D blocks; every shingle is XORed into the block that its hash names.  Each difference changes one
block, so the number of unequal blocks is a lower bound of the symmetric difference, and by the pigeonhole
principle linked sets agree in some block: the sketches are joined block by block.  A block without shingles
says little; m - D - 1 such blocks may be left out without losing a pair, and a set with more of them
emits them all.

Each group of equal blocks gives pairs with its first member.  A second sketch of parity bits, two or more for
each shingle (Hamming distance again bounds the difference), and then the sets themselves verify them.  Where a group has members in
more than one component, its parity bits, folded to 1,024, are compared across components: a member with a near one
gives one row (not one for each pair), with the least class of those it hangs together with.  Such classes form nests.
In a nest each class stands once; whole sketches thin it out, then whole sets are compared across components and give
a spanning forest of links.  So every linked pair is either verified or inside a component, and the rows that leave a
group or nest are linear in its members.
Groups and nests beyond a tile's size are dealt into tiles, in which every two of their members meet.

Defined cases: null, empty and blank texts have no shingle, link with nothing and are their own component; null
ids count as the largest and give null; repeated rows and equal texts share a class; extra columns are not read;
an empty table gives an empty table.  Classes are named by 64 bits of the set's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, LOWER_BYTES, drop, id_key, lean, read, small_batches, stored, without

SIZE, PERCENT = 5, 80
PARITY_WORDS = 16
#: Block values for one task of the join, and class ids that may be broadcast (8 bytes each).
BLOCKS_PER_TASK, BROADCAST_IDS = 1_000_000, 500_000
#: Members of a group, and shingles of a nest, in one part of a tile.
TILE, TILE_SHINGLES = 8192, 2_000_000
#: Word hashes kept by a Python worker.
HASHES = 100_000
NO_ID = 9223372036854775807


def _mix(x):
    """Finaliser of a 64-bit hash, on arrays."""
    import numpy as np

    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes(dict):
    """64-bit hashes of words; frequent words are looked up."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > HASHES:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


WORDS = KEPT["jaccard_join"] = Hashes()


def shingles(text: str | None, size: int):
    """Sorted distinct hashes of the shingles of a text."""
    import numpy as np

    words = (text or "").encode("utf-8", "replace").translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = (total + h[k : len(h) - n + 1 + k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        total ^= total >> np.uint64(33)
    total = _mix(total + np.uint64(n))
    total.sort()
    return total[np.append(True, total[1:] != total[:-1])]


def class_of(s) -> int:
    import numpy as np

    total = np.array([_mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)
    return int(_mix(total).view(np.int64)[0])


def parity(s):
    """Parity bits, twice as many as shingles or more; a power of two, so that the halves of a sketch fold into a shorter one."""
    import numpy as np

    width = PARITY_WORDS
    while 32 * width < len(s):
        width *= 2
    bits = np.bincount((_mix(s + np.uint64(77)) % np.uint64(64 * width)).astype(np.int64), minlength=64 * width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


class Bands:
    """Band limits, most differences and numbers of blocks for a threshold."""

    def __init__(self, percent: int):
        self.percent, self.lows = percent, [1]

    def most(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def of(self, n: int) -> int:
        import bisect

        while self.lows[-1] <= n:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        return bisect.bisect_right(self.lows, n) - 1

    def blocks(self, band: int) -> tuple[int, int]:
        """(m, blocks that may be left out); m is 0 if only equal sets are linked."""
        while len(self.lows) < band + 2:
            self.lows.append(self.lows[-1] * 100 // self.percent + 1)
        top = self.lows[band + 1] - 1
        d = self.most(top, top)
        spare = -(-(d + 1) * 15 // 100)
        return (d + 1 + spare, spare) if d else (0, 0)

    def keys(self, s):
        """64-bit names of (band, block, value) for a set: for its own band and as the smaller set of the next."""
        import numpy as np

        own, out = self.of(len(s)), []
        for band in (own, own + 1):
            m, spare = self.blocks(band)
            if not m:
                continue
            block = (_mix(s + np.uint64(band * 2 + 1)) % np.uint64(m)).astype(np.int64)
            order = np.argsort(block.astype(np.uint16) if m < 65536 else block, kind="stable")  # a radix sort for 16 bits
            block = block[order]
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            value, name = np.bitwise_xor.reduceat(s[order], first), block[first]
            if m - len(name) > spare:
                full = np.zeros(m, np.uint64)
                full[name] = value
                value, name = full, np.arange(m)
            out.append(_mix(_mix(value) + _mix(name.astype(np.uint64) + np.uint64(band) * np.uint64(1 << 32))))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def short(bits):
    """A sketch folded to the least width."""
    import numpy as np

    return np.bitwise_xor.reduce(bits.reshape(-1, PARITY_WORDS), axis=0)


def measured(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, class, short, parity) of every row; parity only where it is wider than the short sketch."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                counts, classes, shorts, wides = [], [], [], []
                for t in batch.column(1).slice(at, 1024):
                    s = shingles(t.as_py(), size)
                    bits = parity(s) if len(s) else None
                    counts.append(len(s))
                    classes.append(class_of(s) if len(s) else None)
                    shorts.append(short(bits) if len(s) else None)
                    wides.append(bits if len(s) and len(bits) > PARITY_WORDS else None)
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), *(pa.array(c, k) for c, k in zip((counts, classes, shorts, wides), kinds))], ["doc_id", "n_shingles", "class", "short", "parity"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run, "jaccard_join"), "doc_id long, n_shingles long, class long, short array<long>, parity array<long>")


def block_groups(docs: DataFrame, size: int, percent: int, tasks: int) -> DataFrame:
    """(key, hub, class, members): for each group of equal blocks, its first class with each of the others."""

    def emit(batches):
        import numpy as np
        import pyarrow as pa

        bands, seen = Bands(percent), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                keys, classes = [], []
                for t in batch.column(0).slice(at, 1024):
                    s = shingles(t.as_py(), size)
                    c = class_of(s) if len(s) else None
                    if c is None or c in seen:  # copies within a task emit once
                        continue
                    seen.add(c)
                    if len(k := bands.keys(s)):
                        keys.append(k)
                        classes.append(np.full(len(k), c, np.int64))
                if not keys:
                    continue
                key, cls = np.concatenate(keys), np.concatenate(classes)
                task = (key >> np.uint64(20)) % np.uint64(tasks)
                order = np.argsort(task, kind="stable")
                key, cls, task = key[order], cls[order], task[order].astype(np.int64)
                first = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
                last = np.append(first[1:], len(task))
                yield pa.RecordBatch.from_arrays([
                    pa.array(task[first]), pa.array([key[a:b].tobytes() for a, b in zip(first, last)], pa.binary()), pa.array([cls[a:b].tobytes() for a, b in zip(first, last)], pa.binary()),
                ], ["task", "keys", "classes"])

    def meet(batches):
        import numpy as np
        import pyarrow as pa

        def tasks_of():
            """Entries of one task after another; rows come sorted by task."""
            own, name = [], None
            for batch in batches:
                for row in range(batch.num_rows):
                    t, k, c = (batch.column(i)[row].as_py() for i in range(3))
                    if own and t != name:
                        yield own
                        own = []
                    name = t
                    own.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)))
            if own:
                yield own

        for own in tasks_of():
            key, cls = (np.concatenate([x[i] for x in own]) for i in (0, 1))
            own.clear()
            order = np.lexsort((cls, key))
            key, cls = key[order], cls[order]
            keep = np.append(True, (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]))
            key, cls = key[keep], cls[keep]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(first, len(key)))
            hub, members = np.repeat(cls[first], sizes), np.repeat(sizes, sizes)
            rest = np.ones(len(key), bool)
            rest[first] = False
            for a in range(0, int(rest.sum()) or 1, 100_000):
                k = np.flatnonzero(rest)[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[k].view(np.int64)), pa.array(hub[k]), pa.array(cls[k]), pa.array(members[k].astype(np.int64))], ["key", "hub", "class", "members"])

    blocks = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(emit, "jaccard_join"), "task long, keys binary, classes binary")
    return blocks.repartition(tasks, "task").sortWithinPartitions("task").mapInArrow(lean(meet, "jaccard_join"), "key long, hub long, class long, members long")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and parity bits allow the similarity."""
    own = lambda x: classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n{x}"), F.coalesce("parity", "short").alias(f"p{x}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    # sizes this close have sketches of one width, or one of twice the other's
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.floor(F.size(x) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    fit = lambda x, y: F.when(F.size(x) > F.size(y), half(x)).otherwise(F.col(x))
    distance = F.aggregate(F.zip_with(fit("pa", "pb"), fit("pb", "pa"), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, n: t + n)
    return both.filter(distance * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b", "na", "nb")


def _sets(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(class, shingles) of the classes in pairs, from the text of one document each."""
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    ids = stored(wanted.join(classes, "class").select(F.col("first").alias("id")), "class-ids")
    few = ids.count() <= BROADCAST_IDS  # else both sides are shuffled

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [shingles(t.as_py(), size) for t in batch.column(0).slice(at, 512)]
                sets = [s for s in sets if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([class_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["class", "shingles"])

    texts = docs.select(id_key().alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids) if few else ids, "id", "left_semi")
    sets = stored(texts.select("text").mapInArrow(lean(run, "jaccard_join"), "class long, shingles array<long>"), "shingle-sets")
    drop(ids)
    return sets


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Linked pairs (a, b) among the candidates, by their whole sets; stored."""
    pairs = stored(_near(pairs, classes, percent), "near-pairs")
    sets = _sets(docs, classes, pairs, size)
    once = sets.dropDuplicates(["class"])
    one = lambda x: once.select(F.col("class").alias(x), F.col("shingles").alias(f"s{x}"))
    both = pairs.join(one("a"), "a").join(one("b"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = stored(both.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"), "links")
    drop(pairs, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """(class, component) of linked classes: smallest label of the neighbours, then of the label, until nothing changes."""
    edges = stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "edges")
    labels = stored(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).withColumnRenamed("u", "class"), "labels")
    while True:
        near = edges.join(labels.select(F.col("class").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.select("class", "label").join(near, F.col("class") == F.col("u")).select("class", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("class").alias("low"), F.col("label").alias("further"))
        new = stored(step.join(jump, "low").select("class", F.least("low", "further").alias("label"), F.col("label").alias("old")), "labels")
        changed = new.filter("label != old").limit(1).count()
        drop(labels)
        labels = new
        if not changed:
            drop(edges)
            return labels.select("class", F.col("label").alias("component"))


def _tiled(rows: DataFrame, key: str, tiles: Column) -> DataFrame:
    """Rows of a key in tiles: each pair of rows meets in one tile (two if the rows share a part) of bounded size.

    A key that fits a tile is one; else its rows are dealt into parts, and a tile holds two parts.
    """
    rows = rows.withColumn("tiles", tiles.cast("int")).withColumn("part", F.pmod(F.xxhash64("class", F.lit(3)), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "tiles")
    return rows.repartition(key, "low", "high").sortWithinPartitions(key, "low", "high")


def key_runs(batches, width: int):
    """Batches of the rows with equal first columns, from batches sorted by them."""
    import numpy as np
    import pyarrow as pa

    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(i)) for i in range(width)]
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        first = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(first, [*first[1:], batch.num_rows]):
            own = tuple(int(k[a]) for k in keys)
            if held and own != name:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            name = own
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Tile:
    """Rows of a tile, those outside its largest component first: only they can be in an unconnected pair."""

    def __init__(self, batch, percent: int):
        import numpy as np

        self.percent = percent
        cls, comp, n, part = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("class", "component", "n_shingles", "part"))
        column = batch.column(batch.schema.get_field_index("parity"))
        flat, ends = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.offsets)
        ends = ends - ends[0]
        names, which, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        largest = which == int(np.argmax(sizes))
        self.order = np.lexsort((cls, largest))
        self.cls, self.comp, self.n, self.part = cls[self.order], which[self.order], n[self.order], part[self.order]
        self.single, self.outside = int(part.min()) == int(part.max()), int((~largest).sum())
        # sketches by width: (rows, bits), and the same folded to half the width
        self.width = np.diff(ends)[self.order]
        self.place, self.sketches = np.zeros(len(cls), np.int64), {}
        for width in np.unique(self.width).tolist():
            rows = np.flatnonzero(self.width == width)
            bits = flat[ends[self.order[rows]][:, None] + np.arange(width)]
            self.place[rows] = np.arange(len(rows))
            self.sketches[width] = rows, bits, bits[:, : width // 2] ^ bits[:, width // 2 :]

    def near(self, i: int):
        """Later rows of other components whose sizes and parity bits allow the similarity with row i."""
        import numpy as np

        found, own = [], self.n[i]
        mine, width = self.place[i], int(self.width[i])
        for other in (width // 2, width, width * 2):
            if other not in self.sketches:
                continue
            rows, bits, folded = self.sketches[other]
            first = int(np.searchsorted(rows, i + 1))
            rest, n = rows[first:], self.n[rows[first:]]
            ok = (self.comp[rest] != self.comp[i]) & (np.minimum(n, own) * 100 >= np.maximum(n, own) * self.percent)
            if not self.single:
                ok &= self.part[rest] != self.part[i]
            if not ok.any():
                continue
            left = self.sketches[width][2 if other < width else 1][mine]
            far = np.bitwise_count(left ^ (folded if other > width else bits)[first:][ok]).sum(1, dtype=np.int64)
            found.append(rest[ok][far * (100 + self.percent) <= (n[ok] + own) * (100 - self.percent)])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _hang(rows: DataFrame, key: str, tiles: Column, percent: int) -> DataFrame:
    """(a, b): classes that have a near one in another component under their key, each with the least class it hangs together with.

    At most one row for each member of a tile.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        seen: set = set()
        for batch in key_runs(batches, 3):
            tile = Tile(batch, percent)
            root = np.arange(len(tile.cls))
            for i in range(tile.outside):
                if len(ok := tile.near(i)):
                    met = np.unique(root[np.append(ok, i)])
                    root[np.isin(root, met)] = met[0]
            low = tile.cls.copy()
            np.minimum.at(low, root, tile.cls)
            low = low[root]
            new = [x for x in zip(tile.cls[low != tile.cls].tolist(), low[low != tile.cls].tolist()) if x not in seen]
            if len(seen) > HASHES:
                seen.clear()
            seen.update(new)
            if new:
                a, b = zip(*new)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = _tiled(rows, key, tiles).select(key, "low", "high", "class", "component", "n_shingles", "part", "parity")
    return dealt.mapInArrow(lean(run, "jaccard_join"), "a long, b long").distinct()


def _live(groups: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """`_hang` of the members of each group, by short sketches: a class comes once for each of its blocks."""
    many = groups.filter("members > 2")
    rows = many.select("key", "class", "members").union(many.select("key", "hub", "members")).distinct()
    rows = rows.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    split = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    rows = rows.join(split, "key", "left_semi").join(classes.select("class", "n_shingles", F.col("short").alias("parity")), "class")
    return _hang(rows, "key", F.ceil(F.col("members") / TILE), percent)


def _nests(live: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """(nest, class, component, n_shingles, parity): classes that hang together, each once, with whole sketches."""
    near = components(live).withColumnRenamed("component", "nest")
    rows = near.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    return rows.join(classes.select("class", "n_shingles", F.coalesce("parity", "short").alias("parity")), "class")


def _nearer(live: DataFrame, labels: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """`_hang` of the members of each nest, by whole sketches."""
    rows = _nests(live, labels, classes)
    heavy = rows.groupBy("nest").agg(F.count("*").alias("members"), F.sum(F.size("parity")).alias("words"))
    return _hang(rows.join(heavy, "nest"), "nest", F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("words") / (TILE * PARITY_WORDS))), percent)


def _across(docs: DataFrame, live: DataFrame, labels: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that connect different components, by the whole sets of all near classes; a spanning forest of them."""
    rows = _nests(live, labels, classes)
    heavy = rows.groupBy("nest").agg(F.sum("n_shingles").alias("weight"))
    sets = _sets(docs, classes, live, size)
    rows = rows.join(heavy, "nest").join(sets.dropDuplicates(["class"]), "class")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in key_runs(batches, 3):
            tile, links = Tile(batch, percent), []
            column = batch.column(batch.schema.get_field_index("shingles"))
            flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets)
            ends = ends - ends[0]
            own = [flat[ends[k] : ends[k + 1]] for k in tile.order]
            for i in range(tile.outside):
                for j in tile.near(i):
                    if tile.comp[i] == tile.comp[j]:
                        continue
                    common = len(np.intersect1d(own[i], own[j], assume_unique=True))
                    if common * 100 >= (len(own[i]) + len(own[j]) - common) * percent:
                        links.append((int(tile.cls[i]), int(tile.cls[j])))
                        tile.comp[tile.comp == tile.comp[j]] = tile.comp[i]
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = _tiled(rows, "nest", F.ceil(F.col("weight") / TILE_SHINGLES)).select("nest", "low", "high", "class", "component", "n_shingles", "part", "parity", "shingles")
    links = stored(dealt.mapInArrow(lean(run, "jaccard_join"), "a long, b long"), "links")
    drop(sets)
    return links


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id."""
    docs = small_batches(docs)
    rows = stored(measured(docs, size), "shingled")
    found = rows.filter("n_shingles > 0")
    classes = stored(found.groupBy("class").agg(F.min(id_key()).alias("first"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("short").alias("short"), F.first("parity").alias("parity")), "classes")
    total = classes.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    # two bands, each with about (1-t)/(1+t) * 2 * 1.15 blocks for a shingle at the top of the band
    blocks = int(total * 2 * 2.3 * (100 - percent) / (100 + percent) * 100 / percent)
    groups = stored(block_groups(docs, size, percent, max(1, -(-blocks // BLOCKS_PER_TASK))), "block-groups")
    pairs = groups.select(F.least("hub", "class").alias("a"), F.greatest("hub", "class").alias("b")).distinct()
    links = verified(docs, classes, pairs, size, percent)
    labels = components(links)
    live = stored(_live(groups, labels, classes, percent), "near-classes")
    drop(groups)
    nearer = stored(_nearer(live, labels, classes, percent), "nearer-classes")
    drop(live)
    if nearer.limit(1).count():
        labels = components(links.union(_across(docs, nearer, labels, classes, size, percent)))
    drop(nearer, links)
    known = classes.join(labels, "class", "left").withColumn("component", F.coalesce("component", "class"))
    lowest = known.groupBy("component").agg(F.min("first").alias("lowest"))
    known = known.filter("copies > 1 or component != class").select("class", "component").union(labels.join(classes.filter("copies = 1"), "class").filter("component = class").select("class", "component"))
    known = known.join(lowest, "component").select("class", "lowest")
    out = rows.join(known, "class", "left")
    own = id_key()
    return out.select("doc_id", "n_shingles", F.nullif(F.coalesce("lowest", own), F.lit(NO_ID)).alias("component_id"))


def clean(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One document of each component, in the columns they came in; rows without a shingle all stay."""
    found = join(docs, size, percent)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) | F.col("component_id").isNull() | (F.col("n_shingles") == 0)
    gone = found.groupBy("doc_id").agg(F.max(stays).alias("stays")).filter("not stays").select("doc_id")
    return without(docs, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), 4, 85)


#: All pairs that share a shingle, and the smallest id reached by links.
ORACLE = r"""
with recursive dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') as w from documents),
sh as (select distinct doc_id, hash(array_to_string(w[i + 1 : i + 4], ' ')) as s from (select doc_id, w, unnest(range(greatest(len(w) - 3, 1))) as i from dw where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
edges as (select a, b from links union all select b, a from links),
reach as (select doc_id as u, doc_id as low from sizes union select e.b, r.low from reach r join edges e on e.a = r.u)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(r.low, d.doc_id) as component_id
from dw d left join sizes s on s.doc_id = d.doc_id left join (select u, min(low) as low from reach group by u) r on r.u = d.doc_id
"""
