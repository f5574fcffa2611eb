"""Line deduplication by a suffix array over line-ID sequences, in built-in expressions only.

The text of a document is its sequence of line IDs (64-bit hashes of the non-blank lines).  Distributed prefix doubling
sorts the suffixes: level 0 ranks them by their first line, and level k + 1 by the pair of the level-k ranks of a
suffix and of the one 2^k lines on, so that a rank of level k gives the place of its first 2^k lines among all.  Pairs are
counted before they are sorted (a frequent one is one row), and a suffix whose pair is unique leaves: nothing shares
its next lines.  Suffixes that agree in their first d lines, so whose ranks of the greatest power of two within d agree at
the front and at the back of them, are the longest-common-prefix interval of depth d; its members are the places of
one repeated run, and the smallest document id has the first copy.

A later copy of a repeated run is deleted if the run has at least `min_words` words.  A maximal run of that size is
the union of the shortest runs of `min_words` words that start or end at one of its lines, so depths beyond
`min_words` lines are never needed, whatever the length of the repeats.

Defined cases: null and empty texts have no line and come back as they are; blank lines are never counted and
never deleted; within a document the first copy stays; rows with equal ids count as one document and keep
their lines, and null ids come after all others; extra columns pass through `clean()`; an empty table gives an
empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, drop, id_key, read, stored, text_of

MIN_WORDS = 50
#: Documents with deletions whose places may be broadcast, and places of them all.
BROADCAST_DOCS, BROADCAST_PLACES = 250_000, 5_000_000
PLACE = ["k1", "k2", "pos"]


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shortest(counts: Column, min_words: int) -> Column:
    """How many of the first entries reach min_words together; null if all do not."""
    reach = F.aggregate(counts, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), lambda a, c: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["sum"] + c).alias("sum"), (a["n"] + 1).alias("n"))))
    return _let(reach, lambda r: F.when(r["sum"] >= min_words, r["n"]))


def lines_of(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, pos, id, ahead, back): the non-blank lines, counted from 0, with the lines of the shortest runs of
    min_words words from it and to it (null if there is none)."""
    t = text_of(docs)
    most = F.lit(min_words)  # each line has a word, so no shortest run has more lines
    lines = F.filter(F.transform(F.split(t, "\n", -1), lambda x: F.struct(x.alias("x"), F.btrim(x, F.lit(SPACE_CHARS)).alias("y"))), lambda s: s["y"] != "")
    rows = docs.select(id_key().alias("k1"), F.xxhash64(t).alias("k2"), F.transform(lines, lambda s: F.struct(F.xxhash64(s["x"]).alias("id"), F.size(F.split(s["y"], SPACE)).alias("n"))).alias("lines"))
    ahead = lambda c, i: _shortest(F.slice(c, i + 1, most), min_words)
    back = lambda c, i: _shortest(F.reverse(F.slice(c, F.greatest(i + 2 - most, F.lit(1)), F.least(i + 1, most))), min_words)
    every = _let(F.col("lines.n"), lambda c: F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x["id"].alias("id"), ahead(c, i).alias("ahead"), back(c, i).alias("back"))))
    # the outer form: explode would have the optimiser compute the lines a second time, for a filter on their number
    return rows.select("k1", "k2", F.explode_outer(every).alias("x")).filter("x is not null").select("k1", "k2", "x.*")


def ranked(rows: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Rows whose keys occur again, with `rank`: a number that grows with the keys, equal for equal ones; stored.

    The keys are counted first, so what is sorted is one row for each, however frequent; the numbers are fixed by being
    stored.
    """
    again = rows.groupBy(*keys).agg(F.count("*").alias("times")).filter("times > 1").select(*keys)
    order = stored(again.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), tag + "-ranks")
    out = stored(rows.join(order, keys).drop(*keys), tag)
    drop(order)
    return out


def named_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, start, lines, name1, name2, again): the shortest runs of min_words words whose lines all occur again; stored.

    Runs with the same number of lines and the same names are one LCP interval; `again` says that a run stands earlier in
    its own text.
    """
    lines = stored(lines_of(docs, min_words), "lines")
    level = ranked(lines, ["id"], "suffixes")
    drop(lines)
    first, levels = level, [level]
    run = lambda start, lines: first.select("k1", "k2", start.cast("int").alias("start"), F.col(lines).alias("lines")).filter(F.col("lines").isNotNull())
    runs = stored(run(F.col("pos"), "ahead").union(run(F.col("pos") - F.col("back") + 1, "back")).distinct(), "runs")
    longest = runs.agg(F.max("lines")).first()[0] or 0
    parts, width = [], 1
    while width <= longest:
        ranks = level.select(*PLACE, "rank")
        front = ranks.select("k1", "k2", F.col("pos").alias("start"), F.col("rank").alias("name1"))
        end = ranks.select("k1", "k2", (F.col("pos") + width).alias("stop"), F.col("rank").alias("name2"))
        own = runs.filter((F.col("lines") >= width) & (F.col("lines") < 2 * width)).join(front, ["k1", "k2", "start"]).withColumn("stop", F.col("start") + F.col("lines")).join(end, ["k1", "k2", "stop"])
        parts.append(own.select("k1", "k2", "start", "lines", "name1", "name2"))
        width *= 2
        if width <= longest:
            later = ranks.select("k1", "k2", (F.col("pos") - width // 2).alias("pos"), F.col("rank").alias("r2"))
            level = ranked(ranks.withColumnRenamed("rank", "r1").join(later, PLACE), ["r1", "r2"], "suffixes")
            levels.append(level)
    zero = F.lit(0).cast("long")
    out = parts[0] if parts else runs.select("k1", "k2", "start", "lines", zero.alias("name1"), zero.alias("name2"))
    for p in parts[1:]:
        out = out.unionByName(p)
    again = F.col("start") > F.min("start").over(W.partitionBy("lines", "name1", "name2", "k1", "k2"))
    out = stored(out.withColumn("again", again), "named-runs")
    drop(runs, *levels)
    return out


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(k1, k2, gone): the places of the lines that are later copies, for documents that have any; stored."""
    name = ["lines", "name1", "name2"]
    found = named_runs(docs, min_words)
    first = found.groupBy(*name).agg(F.min("k1").alias("first"), F.max("k1").alias("last"), F.max("again").alias("twice")).filter("first < last or twice")
    late = found.join(first, name).filter((F.col("k1") > F.col("first")) | F.col("again"))
    spans = late.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "lines")).alias("spans"))
    every = F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["lines"] - 1)))
    out = stored(spans.select("k1", "k2", F.array_sort(F.array_distinct(every)).alias("gone")), "later-copies")
    drop(found)
    return out


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each row of `docs` as struct `row`, with n_lines, n_deleted, new `text` (null stays null)."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].cast("string").alias("text"), id_key().alias("k1"), F.xxhash64(text_of(docs)).alias("k2"))
    gone = later_copies(docs, min_words)
    size = gone.agg(F.count("*").alias("docs"), F.sum(F.size("gone")).alias("places")).first()
    few = size["docs"] <= BROADCAST_DOCS and (size["places"] or 0) <= BROADCAST_PLACES  # else the texts are shuffled
    rows = rows.join(F.broadcast(gone) if few else gone, ["k1", "k2"], "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    blank = lambda x: F.btrim(x, F.lit(SPACE_CHARS)) == ""

    def cleaned(every: Column) -> Column:
        # places count non-blank lines; those that stay are the difference of two sets of indices
        shown = F.filter(F.transform(every, lambda x, i: F.when(~blank(x), i)), lambda i: i.isNotNull())
        out = _let(shown, lambda at: F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.transform("gone", lambda p: F.get(at, p))))
        return F.array_join(F.transform(out, lambda i: F.get(every, i)), "\n")

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(_let(split, cleaned))
    return rows.select("row", F.size(F.filter(split, lambda x: ~blank(x))).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_deleted"), text.alias("text"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies, in the columns they came in; one of which nothing is left goes."""
    done = dedup(docs, min_words).filter((F.col("n_deleted") == 0) | (F.btrim("text", F.lit(SPACE_CHARS)) != ""))
    values = {"text": F.col("text"), "n_chars": F.when(F.col("n_deleted") == 0, F.col("row.n_chars") if "n_chars" in docs.columns else None).otherwise(F.char_length("text")).cast("long")}
    return done.select(*[values[c].alias(c) if c in values else F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", "n_deleted", "text")


#: The same by plain string comparison of the shortest runs.
ORACLE = f"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents),
n as (select doc_id, pos, line, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) as n from l where regexp_matches(line, '[^ \t\n\x0B\f\r]')),
c as (select *, row_number() over w as i, sum(n) over w as upto from n window w as (partition by doc_id order by pos)),
pairs as (select a.doc_id, a.i as s, b.i as e, b.upto - a.upto + a.n as words, a.n as first_n, b.n as last_n from c a join c b on a.doc_id = b.doc_id and b.i >= a.i and b.i < a.i + {MIN_WORDS}),
short as (select distinct doc_id, s, e from pairs where words >= {MIN_WORDS} and (words - last_n < {MIN_WORDS} or words - first_n < {MIN_WORDS})),
named as (select r.doc_id, r.s, r.e, string_agg(c.line, chr(10) order by c.i) as body from short r join c on c.doc_id = r.doc_id and c.i between r.s and r.e group by 1, 2, 3),
late as (select * from (select *, row_number() over (partition by body order by doc_id, s) as k from named) where k > 1),
gone as (select distinct c.doc_id, c.pos from late r join c on c.doc_id = r.doc_id and c.i between r.s and r.e),
kept as (select l.doc_id, string_agg(l.line, chr(10) order by l.pos) as text from l anti join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by 1)
select d.doc_id, (select count(*) from n where n.doc_id = d.doc_id) as n_lines, (select count(*) from gone g where g.doc_id = d.doc_id) as n_deleted, case when d.text is null then null else coalesce(k.text, '') end as text
from documents d left join kept k on k.doc_id = d.doc_id
"""
