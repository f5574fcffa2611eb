"""Line-first quality rules, in built-in expressions only (no shuffle, no Python).

Every line is judged on its own: punctuation, navigation, boilerplate, symbols, shouting and
repetition.  Lines that fail are removed.  A document goes if too few of its words remain, or if it
fails the document rules (under 50 words, or more than half of its words inside repeated 3-word
windows).

Defined cases: a null or empty text has no words and is rejected; rows are judged one by one, so
repeated rows, ties and null ids need no rule; extra columns pass through `clean()`; an empty table
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_CHARS, fresh, text_of

#: A line of running text ends in one of these, perhaps before closing marks.
ENDS = r"[.!?…。！？:;][\"'”’»)\]]*$"
#: Phrases of web furniture.  Fixed values.
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "use cookies", "enable javascript",
    "lorem ipsum", "click here", "sign up for our", "subscribe to our", "share on facebook", "skip to content", "back to top",
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Web furniture comes in lines of at most so many words; a longer line that has such a phrase is prose about it.
MAX_FURNITURE = 20
#: A document must keep this share of its words.
MIN_KEPT = 0.5


def line_fails(line: Column, words: Column) -> Column:
    """Whether a trimmed, non-empty line of so many words fails a rule.

    Each rule starts with a test that ordinary prose fails at once.
    """
    gone = lambda pattern: F.char_length(line) - F.char_length(F.regexp_replace(line, pattern, ""))
    navigation = line.rlike(r"[|»›•·].*[|»›•·]") & (gone(r"[|»›•·]") * 4 >= words)
    symbols = line.rlike(r"[#*$%&<>{}\\~^=_]") & (gone(r"[#*$%&<>{}\\~^=_]") * 3 >= words)
    shouting = (words >= 4) & line.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")
    no_end = (words >= 30) & ~F.substring(line, -4, 4).rlike(ENDS) & (gone(r"[.,;:!?]") * 40 < words)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | line.contains(phrase) | line.contains(phrase.capitalize())
    return symbols | navigation | shouting | no_end | ((words <= MAX_FURNITURE) & boilerplate)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the text.

    Windows are named by 64-bit hashes; texts without a repeated window stop at the distinct count.
    In the others the sorted (window, place) pairs show each repeated place beside its twin, and the
    distinct words that those windows cover are counted.
    """
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def windows(h: Column) -> Column:
        return F.when(n >= 3, F.zip_with(F.zip_with(F.slice(h, 1, n - 2), F.slice(h, 2, n - 2), lambda a, b: F.xxhash64(a, b)), F.slice(h, 3, n - 2), lambda ab, c: F.xxhash64(ab, c))).otherwise(F.array().cast("array<bigint>"))

    def covered(w: Column) -> Column:
        pairs = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))

        def of(p: Column) -> Column:
            twins = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
            starts = F.sort_array(F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
            # each start adds the words up to its end that the start before has not covered
            return F.aggregate(starts, F.struct(F.lit(-1).alias("to"), F.lit(0).alias("n")), lambda a, s: F.struct((s + 2).alias("to"), (a["n"] + F.least(F.lit(3), s + 2 - a["to"])).cast("int").alias("n")), lambda a: a["n"])

        return _let(pairs, of)

    return _let(_let(hashes, windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w))).cast("long")


def _let(value: Column, body) -> Column:
    """Evaluate a value once and use it in a body (expressions are otherwise copied)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts, `clean_text` and the verdict `kept` to each row."""
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words", "clean_text")
    if clash := [c for c in docs.columns if c.lower() in new]:
        docs = docs.drop(*clash)
    t = text_of(docs, text)
    lines, full, kept, words = (fresh(docs, n) for n in ("_lines", "_full", "_kept", "_words"))
    out = docs.withColumns({
        lines: F.transform(F.split(t, "\n", -1), lambda x: _let(F.btrim(x, F.lit(SPACE_CHARS)), lambda y: F.struct(x.alias("raw"), y.alias("line"), F.when(y == "", F.array().cast("array<string>")).otherwise(F.split(y, SPACE)).alias("words")))),
    })
    out = out.withColumn(lines, F.transform(lines, lambda x: F.struct(x["raw"].alias("raw"), x["words"].alias("words"), (x["line"] == "").alias("blank"), ((x["line"] != "") & line_fails(x["line"], F.size(x["words"]))).alias("fails"))))
    out = out.withColumns({full: F.transform(F.filter(lines, lambda x: ~x["blank"]), lambda x: x["raw"]), kept: F.filter(lines, lambda x: ~x["fails"]), words: F.flatten(F.transform(lines, lambda x: x["words"]))})
    whole = F.size(kept) == F.size(lines)
    out = out.withColumns({
        "n_words": F.size(words).cast("long"),
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
        "n_repeat_words": repeated_words(F.col(words)),
        "clean_text": F.when(whole, t).otherwise(F.array_join(F.transform(kept, lambda x: x["raw"]), "\n")),
        "kept_words": F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + F.size(x["words"])),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_words") >= F.col("n_words") * MIN_KEPT)).drop(words, lines, full, kept)


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines, in the columns they came in."""
    done = measure(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs["text"].alias("text")))
    # a generator rather than a filter: the optimiser would compute the verdict a second time, below the projection
    done = done.select(F.explode_outer(F.array(F.when(F.col("kept"), F.struct("_row", "clean_text")))).alias("x")).filter("x is not null")
    values = {"text": F.col("x.clean_text"), "n_chars": F.char_length("x.clean_text").cast("long")}
    return done.select(*[values[c].alias(c) if c in values else F.col("x._row")[c].alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return measure(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


_WORD = r"[^ \t\n\x0B\f\r]+"
_GONE = "(length(y) - length(regexp_replace(y, '{0}', '', 'g')))"
_SYMBOLS, _MARKS = r"[#*$%&<>{}\\~^=_]", "[|»›•·]"
_PHRASES = " or ".join(f"contains(y, '{p}') or contains(y, '{p.capitalize()}')" for p in BOILERPLATE)
#: The same by words and lines as rows.
ORACLE = f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_WORD}') as w from documents),
l as (select doc_id, unnest(string_split(t, chr(10))) as x from d),
m as (select doc_id, x, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as y, len(regexp_extract_all(x, '{_WORD}')) as n from l),
f as (select *, n > 0 and (regexp_matches(y, '{_SYMBOLS}') and {_GONE.format(_SYMBOLS)} * 3 >= n or regexp_matches(y, '{_MARKS}.*{_MARKS}') and {_GONE.format(_MARKS)} * 4 >= n or n >= 4 and regexp_matches(y, '^[^\\p{{Ll}}]*\\p{{Lu}}[^\\p{{Ll}}]*$')
  or n >= 30 and not regexp_matches(right(y, 4), '{ENDS.replace("'", "''")}') and {_GONE.format("[.,;:!?]")} * 40 < n or n <= {MAX_FURNITURE} and ({_PHRASES})) as fails from m),
k as (select doc_id, coalesce(sum(n) filter (not fails), 0)::bigint as kept_words, count(*) filter (n > 0) - count(distinct x) filter (n > 0) as n_dup_lines from f group by doc_id),
g as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as c from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
r as (select doc_id, count(distinct i + j) as n from g, range(3) s(j) where c > 1 group by doc_id),
a as (select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, n_dup_lines, coalesce(r.n, 0) as n_repeat_words, kept_words from d join k on k.doc_id = d.doc_id left join r on r.doc_id = d.doc_id),
b as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and kept_words >= n_words * {MIN_KEPT} as kept, kept_words from b
"""
