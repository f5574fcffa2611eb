"""Benchmark decontamination over a distributed positional inverted index.

`build_index` stores, for segments of documents, the postings of every token that occurs in the test items:
per term the sorted places of the segment (documents follow one another with a gap).  Tokens that no test item
has are never queried and get no postings.  `search` adds up the terms' frequencies over all segments, orders
the terms of each window from the rarest, takes the windows whose rarest term a segment has, and intersects
their terms' lists, each moved by the term's offset in the window, until the lists are empty or all terms agree:
exact phrase matches.
`proximity` finds test terms that stand within a span of words, in any order, from the same postings.

The test items go through in sections of a bounded vocabulary and number of words, each with one index over its
terms, and a section in blocks of windows that are broadcast as arrays; so what is sent to the executors is
bounded.  Results are merged by document.

Defined cases: a null text has no words; an item without words is never found; an item with a null id hits and
counts like the others (all such items as one) but is not named; equal texts under several ids are all reported;
an item with fewer words than a window is one window; repeated documents are rows of their own (numbered in their
segment); extra columns are not read; an empty table or an empty benchmark gives no rows, or rows without hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, lean, read, small_batches, stored, without

WINDOW = 10
#: Words of test items in a block and in a section, and distinct words of a section, at most (a longer item is one).
BLOCK_WORDS, SECTION_WORDS, VOCABULARY = 1_000_000, 16_000_000, 500_000
#: Documents and words in a segment, at most (a longer document is a segment); places looked up at once.
SEGMENT_DOCS, SEGMENT_WORDS, PLACES = 2048, 500_000, 100_000
INDEX = "segment long, rows binary, terms binary, counts binary, postings binary"
MATCHES = "row_id long, start int, stop int, item_id string"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(ALNUM_BYTES).split()


def numbered(docs: DataFrame) -> DataFrame:
    """row_id tells rows apart that have the same id; it is fixed by being stored with the index."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


class Windows:
    """Distinct windows over a block of items (id, term numbers), as arrays: a row of terms each, -1 after the last."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        import numpy as np

        rows, owner = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for k, (_, numbers) in enumerate(items):
            if not len(numbers):
                continue
            own = np.full((max(1, len(numbers) - window + 1), window), -1, np.int32)
            if len(numbers) < window:
                own[0, : len(numbers)] = numbers
            else:
                own[:] = np.lib.stride_tricks.sliding_window_view(numbers, window)
            rows.append(own)
            owner.append(np.full(len(own), k, np.int64))
        every, owner = np.concatenate(rows), np.concatenate(owner)
        self.names = [item for item, _ in items]
        self.terms, which = np.unique(every, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), owner], 1), axis=0)
        #: Items of window k: items[first[k] : first[k + 1]].
        self.items, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.terms) + 1))

    def rarest_first(self, often) -> None:
        """Order each window's terms by frequency and the windows by their rarest term; windows with an unseen term go."""
        import numpy as np

        counts = np.where(self.terms >= 0, np.append(often, 0)[self.terms], np.iinfo(np.int64).max)
        order = np.argsort(counts, axis=1, kind="stable").astype(np.int8)
        seen = np.flatnonzero(np.take_along_axis(counts, order[:, :1].astype(np.int64), 1)[:, 0] > 0)
        terms = np.take_along_axis(self.terms, order.astype(np.int64), 1)
        seen = seen[np.argsort(terms[seen, 0], kind="stable")]
        self.window, self.order, self.terms = seen, order[seen], terms[seen]
        self.length = (self.terms >= 0).sum(1)


def build_index(docs: DataFrame, ids: dict[bytes, int]) -> tuple[DataFrame, DataFrame]:
    """(segments, documents): postings by segment, and (row_id, doc_id, n_words) of every row; both stored."""
    spark = small_batches(docs).sparkSession
    shared = spark.sparkContext.broadcast(ids)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        get, part, count = shared.value.get, TaskContext.get().partitionId() << 36, 0
        names = [x.split()[0] for x in INDEX.split(", ")] + ["doc_ids", "lengths"]
        types = [pa.int64()] + [pa.binary()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32())]
        doc_ids, lengths, numbers, size = [], [], [], 0

        def segment():
            nonlocal doc_ids, lengths, numbers, size, count
            n = np.asarray(lengths, np.int64)
            starts = np.append(0, np.cumsum(n + 1))[:-1]  # a gap keeps phrases within a document
            flat = np.concatenate([*numbers, np.zeros(0, np.int32)])
            place = np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)
            seen = flat >= 0
            flat, place = flat[seen], place[seen]
            order = np.argsort(flat, kind="stable")
            terms, counts = np.unique(flat, return_counts=True)
            row = [part + count, np.asarray(starts, "<i8").tobytes(), terms.astype("<i4").tobytes(), counts.astype("<i4").tobytes(), place[order].astype("<i4").tobytes(), doc_ids, lengths]
            count += len(n)
            doc_ids, lengths, numbers, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py())
                if lengths and (len(lengths) >= SEGMENT_DOCS or size + len(words) > SEGMENT_WORDS):
                    yield segment()
                doc_ids.append(doc_id)
                lengths.append(len(words))
                numbers.append(np.fromiter((get(w, -1) for w in words), np.int32, len(words)))
                size += len(words)
        if lengths:
            yield segment()

    index = stored(numbered(docs).mapInArrow(lean(run, "decontamination"), INDEX + ", doc_ids array<long>, lengths array<int>"), "postings")
    rows = index.select("segment", F.posexplode_outer(F.arrays_zip("doc_ids", "lengths")).alias("at", "d"))
    return index, rows.select((F.col("segment") + F.col("at")).alias("row_id"), F.col("d.doc_ids").alias("doc_id"), F.col("d.lengths").cast("long").alias("n_words"))


def frequencies(index: DataFrame, terms: int):
    """Occurrences of each term in all segments; the number of terms bounds the result."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        total = np.zeros(terms, np.int64)
        for batch in batches:
            for t, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[np.frombuffer(t, "<i4")] += np.frombuffer(c, "<i4")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(terms, np.int64)
    for row in index.select("terms", "counts").mapInArrow(lean(count, "decontamination"), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["term"]] = row["n"]
    return out


def search(index: DataFrame, windows: Windows, often) -> DataFrame:
    """Exact phrase matches: (row_id, start, stop, item_id), a row for each place of a window and item."""
    windows.rarest_first(often)
    shared = index.sparkSession.sparkContext.broadcast(windows)

    def places(lead, names, counts):
        """(window, place) arrays of the windows whose rarest term the segment has, some at a time."""
        import numpy as np

        ends = np.cumsum(counts)
        k = np.searchsorted(names, lead)
        k[k == len(names)] = 0
        own = np.flatnonzero(names[k] == lead) if len(names) else np.zeros(0, np.int64)
        size, begin = counts[k[own]], (ends - counts)[k[own]]
        total = np.cumsum(size)
        at = 0
        while at < len(own):
            to = max(at + 1, int(np.searchsorted(total, PLACES + (total[at - 1] if at else 0), "right")))
            n = size[at:to]
            yield np.repeat(own[at:to], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[at:to], n)
            at = to

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w = shared.value
        lead = w.terms[:, 0]
        for batch in batches:
            for segment, rows, names, counts, postings in zip(*(batch.column(k).to_pylist() for k in range(5))):
                starts, names, counts = np.frombuffer(rows, "<i8"), np.frombuffer(names, "<i4"), np.frombuffer(counts, "<i4").astype(np.int64)
                posting = np.frombuffer(postings, "<i4").astype(np.int64)
                # lists one after the other, by term and place: one sorted array of both
                lists = np.repeat(names.astype(np.int64), counts) << 32 | posting
                found: list[list] = [[], [], [], []]
                for own, k in places(lead, names, counts):
                    at = posting[k] - w.order[own, 0]
                    for n in range(1, w.terms.shape[1]):
                        term = w.terms[own, n].astype(np.int64)
                        want = term << 32 | np.maximum(at + w.order[own, n], 0)
                        k = np.minimum(np.searchsorted(lists, want), len(lists) - 1)
                        keep = (term < 0) | ((lists[k] == want) & (at >= 0))
                        own, at = own[keep], at[keep]
                        if not len(own):
                            break
                    if len(own):
                        doc = np.searchsorted(starts, at, "right") - 1
                        for d, s, x in zip(doc.tolist(), (at - starts[doc]).tolist(), own.tolist()):
                            first, last = w.first[w.window[x]], w.first[w.window[x] + 1]
                            for item in w.items[first:last].tolist():
                                for column, value in zip(found, (segment + d, s, s + int(w.length[x]), w.names[item])):
                                    column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], ["row_id", "start", "stop", "item_id"])

    return index.select("segment", "rows", "terms", "counts", "postings").mapInArrow(lean(run, "decontamination"), MATCHES)


def proximity(docs: DataFrame, phrase: str, span: int) -> DataFrame:
    """(doc_id, start): places of the phrase's rarest word that have all its words within `span` words."""
    import numpy as np

    wanted = words_of(phrase)
    ids = {w: k for k, w in enumerate(dict.fromkeys(wanted))}
    index, rows = build_index(docs, ids)
    often = frequencies(index, max(1, len(ids)))
    order = sorted(ids.values(), key=lambda k: often[k])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for segment, begins, names, counts, postings in zip(*(batch.column(k).to_pylist() for k in range(5))):
                starts, ends = np.frombuffer(begins, "<i8"), np.cumsum(np.frombuffer(counts, "<i4"))
                lists = dict(zip(np.frombuffer(names, "<i4").tolist(), np.split(np.frombuffer(postings, "<i4"), ends[:-1])))
                at = lists.get(order[0], np.zeros(0, np.int32)) if order else np.zeros(0, np.int32)
                doc = np.searchsorted(starts, at, "right") - 1
                last = np.append(starts[1:], np.iinfo(np.int64).max)[doc] - 2 if len(at) else at
                for term in order[1:]:
                    other = lists.get(term, np.zeros(0, np.int32))
                    low, high = np.maximum(at - span, starts[doc]), np.minimum(at + span, last)
                    keep = np.searchsorted(other, low) < np.searchsorted(other, high, "right")
                    at, doc, last = at[keep], doc[keep], last[keep]
                yield pa.RecordBatch.from_arrays([pa.array(segment + doc, pa.int64()), pa.array(at - starts[doc], pa.int64())], ["row_id", "start"])

    hits = index.select("segment", "rows", "terms", "counts", "postings").mapInArrow(lean(run, "decontamination"), "row_id long, start long")
    return hits.join(rows, "row_id").select("doc_id", "start")


def sections(benchmark: DataFrame, most: int = SECTION_WORDS, vocabulary: int = VOCABULARY):
    """(term numbers by word, items as (id, term numbers)): test items in sections of bounded size, one held at a time."""
    import numpy as np

    ids: dict[bytes, int] = {}
    items: list[tuple] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        words = words_of(row["text"])
        if items and (size + len(words) > most or len(ids) > vocabulary):
            yield ids, items
            ids, items, size = {}, [], 0
        items.append((row["item_id"], np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))))
        size += len(words)
    yield ids, items


def blocks(items: list[tuple], most: int = BLOCK_WORDS):
    """Items in blocks of at most so many words."""
    block, size = [], 0
    for item in items:
        if block and size + len(item[1]) > most:
            yield block
            block, size = [], 0
        block.append(item)
        size += len(item[1])
    yield block


def measure(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, section_words: int = SECTION_WORDS) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items (sorted), contaminated, and `spans` of the hits."""
    matches = rows = None
    parts = sections(benchmark, section_words)
    section, later = next(parts), next(parts, None)
    if later:  # more than one index: rows must have the same numbers in each, whatever the order of the input's rows
        docs = stored(numbered(docs), "numbered")
    while section:
        ids, items = section
        index, own = build_index(docs, ids)
        often = frequencies(index, len(ids))
        rows = own if rows is None else rows
        for block in blocks(items, block_words):
            found = search(index, Windows(block), often)
            matches = found if matches is None else matches.unionByName(found)
        section, later = later, next(parts, None) if later else None
    # spans merge in order of start: a span counts from the end of what came before
    places = F.array_sort(F.collect_set(F.struct("start", "stop")))
    merged = matches.groupBy("row_id").agg(places.alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("unnamed"))
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")), lambda a, s: F.struct(F.greatest(a["to"], s["stop"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["to"], s["start"]))).alias("n")), lambda a: a["n"])
    out = rows.join(merged, "row_id", "left")
    none, zero = F.array().cast("array<string>"), F.lit(0).cast("long")
    return out.select("row_id", "doc_id", "n_words", F.coalesce(hit, zero).alias("n_hit"), F.coalesce(F.size("items") + F.col("unnamed"), zero).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.col("spans"), F.col("spans").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, in the columns they came in; rows of one id stay or go together."""
    return without(docs, measure(docs, benchmark).filter("contaminated").select("doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = measure(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: The same by joining every window of words.
ORACLE = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
win as (select distinct cast(item_id as varchar) as item_id, least(len(w), 10) as n, array_to_string(w[i + 1 : i + 10], ' ') as body from (select item_id, w, unnest(range(greatest(len(w) - 9, 1))) as i from bw where len(w) > 0)),
sizes as (select distinct n from win),
places as (select doc_id, i, s.n, array_to_string(w[i + 1 : i + s.n], ' ') as body from (select doc_id, w, unnest(range(len(w))) as i from dw) d cross join sizes s where i + s.n <= len(w)),
hits as (select distinct p.doc_id, p.i, p.n, w.item_id from places p join win w on p.body = w.body and p.n = w.n),
hit_words as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(i, i + n)) as x from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hits) group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(i.n_items, 0) as n_items, sha256(coalesce(i.ids, '')) as items_sha256, h.doc_id is not null as contaminated
from dw d left join hit_words h on h.doc_id = d.doc_id left join items i on i.doc_id = d.doc_id
"""
