"""Licence scan over a positional rare-token index, in built-in expressions only.

1. Licence words of every text, with their places, are found by a broadcast join on the vocabulary of the
   templates (fixed in this module, a few hundred words).
2. Document frequencies over all documents tell the rarest key-phrase word of each template; the files in
   its postings are the template's candidates.  No file can hold the key phrases without it.
3. Postings intersect by relative position: votes for one (template, place in file - place in template).
4. A template counts if its mandatory key phrases stand in the file: the same intersection finds their indexed
   words, then all their words are looked for in the text.

The three base phrases are counted in the text itself and always give their labels.

Defined cases: a null or empty text has no words, null first_word and last_word, empty labels and score 0;
repeated rows each give a row, with the same result; rows with equal id and text count once in the statistics;
null ids keep their rows; other columns of the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, NON_ALNUM, UPPER, id_key, read, stored, text_of

#: Base phrases and labels.  Fixed values.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label: (licence text, mandatory key phrases).  Fixed values; words as the tokeniser gives them.
TEMPLATES = {
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", ("permission is hereby granted free of charge", "deal in the software without restriction")),
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license version 2 0",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    "lgpl": ("licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "agpl": ("licensed under the gnu affero general public license", ("gnu affero general public license",)),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software",)),
    "epl": ("this program and the accompanying materials are made available under the terms of the eclipse public license", ("eclipse public license",)),
    "cc-by": ("licensed under the creative commons attribution license", ("creative commons attribution",)),
    "cc-by-nc": ("licensed under cc by nc", ("cc by nc",)),
    "cc-by-sa": ("licensed under cc by sa", ("cc by sa",)),
    "cc0": ("released under cc0 to the public domain", ("cc0",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
}
#: Words of templates too frequent in prose to be worth an index entry; they keep their places.
UNINDEXED = frozenset("a and any as are by for in is made of or that the this to under with without".split())
#: This share of a template's words must line up.
MIN_SHARE = 0.5


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def _indexed(text: str) -> int:
    return sum(w not in UNINDEXED for w in text.split())


def _postings(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    texts = [(label, w, i, _indexed(text)) for label, (text, _) in TEMPLATES.items() for i, w in enumerate(text.split()) if w not in UNINDEXED]
    keys = [(label, n, w, i, _indexed(p)) for label, (_, phrases) in TEMPLATES.items() for n, p in enumerate(phrases) for i, w in enumerate(p.split()) if w not in UNINDEXED]
    return spark.createDataFrame(texts, "label string, word string, place int, size int"), spark.createDataFrame(keys, "label string, phrase int, word string, place int, size int")


def licence_words(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(k1, k2, place, word) for every licence word of every text; places count from the same word within a text."""
    words = docs.select(id_key().alias("k1"), F.xxhash64(text_of(docs)).alias("k2"), F.posexplode_outer(F.split(text_of(docs), NON_ALNUM)).alias("place", "raw"))
    words = words.filter("octet_length(raw) < 20").withColumn("word", F.when(F.length("raw") == F.octet_length("raw"), F.lower("raw")))
    return words.join(F.broadcast(vocabulary), "word").select("k1", "k2", "place", "word")


def method_labels(docs: DataFrame) -> DataFrame:
    """(k1, k2, found): labels and shares that the index finds; unindexed words of key phrases are still to be seen."""
    spark = docs.sparkSession
    texts, keys = _postings(spark)
    vocabulary = texts.select("word").union(keys.select("word")).distinct()
    hits = stored(licence_words(docs, vocabulary).distinct(), "licence-words")
    frequency = hits.select("k1", "k2", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    # every file with a template's key phrases has the rarest of their words
    rarest = keys.select("label", "word").distinct().join(F.broadcast(frequency), "word", "left").groupBy("label").agg(F.min(F.struct(F.coalesce("df", F.lit(0)), "word"))["word"].alias("word"))
    found = hits.join(F.broadcast(rarest), "word").select("k1", "k2", "label").distinct()
    # then all licence words of the file line up
    at = hits.withColumnRenamed("place", "at")
    shift = (F.col("at") - F.col("place")).alias("shift")
    aligned = at.join(F.broadcast(texts), "word").groupBy("k1", "k2", "label", "size", shift).agg(F.count("*").alias("votes"))
    best = aligned.groupBy("k1", "k2", "label").agg(F.max(F.col("votes") / F.col("size")).alias("share")).filter(F.col("share") >= MIN_SHARE)
    phrases = at.join(F.broadcast(keys), "word").groupBy("k1", "k2", "label", "phrase", "size", shift).agg(F.count("*").alias("n"))
    phrases = phrases.filter("n = size").groupBy("k1", "k2", "label").agg(F.count_distinct("phrase").alias("phrases"))
    wanted = spark.createDataFrame([(label, len(p)) for label, (_, p) in TEMPLATES.items()], "label string, phrases int")
    kept = best.join(phrases, ["k1", "k2", "label"]).join(F.broadcast(wanted), ["label", "phrases"]).join(found, ["k1", "k2", "label"], "left_semi")
    return kept.groupBy("k1", "k2").agg(F.collect_set(F.struct("label", "share")).alias("found"))


def key_labels(norm: Column) -> Column:
    """Labels whose key phrases, with all their words, stand in a text whose words have one space around them."""
    lower = F.translate(norm, UPPER, LOWER)
    has = [(label, [lower.contains(f" {p} ") for p in phrases]) for label, (_, phrases) in TEMPLATES.items()]
    labels = F.array_compact(F.array(*[F.when(reduce(and_, tests), F.lit(label)) for label, tests in has]))
    # most texts have no last word of a key phrase
    last = "|".join(sorted({p.split()[-1] for _, phrases in TEMPLATES.values() for p in phrases}))
    return F.when(norm.rlike(f"(?i)(?<= )(?:{last})(?= )"), labels)


def scan(docs: DataFrame) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    t = text_of(docs)
    norm = F.concat(F.lit(" "), F.regexp_replace(t, NON_ALNUM, " "), F.lit(" "))
    # a text that begins or ends with a separator has two spaces there
    norm = F.concat(F.lit(" "), F.btrim(norm, F.lit(" ")), F.lit(" "))
    place = "(?i)(?<= )(?:" + "|".join(BASE) + ")(?= )"
    rows = docs.select("doc_id", id_key().alias("k1"), F.xxhash64(t).alias("k2"), norm.alias("norm"))
    has = F.col("norm").rlike(place)
    before_first = F.substring("norm", F.lit(1), F.regexp_instr("norm", F.lit(place)) - 1)
    before_last = F.regexp_extract("norm", "(?s)^(.*)" + place, 1)
    labels = F.array_compact(F.array(*[F.when(F.col("norm").rlike(f"(?i) {p} "), F.lit(label)) for p, label in BASE.items()]))
    base = rows.select(
        "doc_id", "k1", "k2",
        F.when(F.col("norm") == "  ", 0).otherwise(_count(F.col("norm"), " ") - 1).cast("long").alias("n_words"),
        F.when(has, F.regexp_count("norm", F.lit(place))).otherwise(0).cast("long").alias("n_base"),
        F.when(has, _count(before_first, " ") - 1).cast("long").alias("first_word"),
        F.when(has, _count(before_last, " ") - 1).cast("long").alias("last_word"),
        F.when(has, labels).otherwise(F.array().cast("array<string>")).alias("base"), key_labels(F.col("norm")).alias("keyed"),
    )
    out = base.join(method_labels(docs), ["k1", "k2"], "left")
    found = F.coalesce(F.filter("found", lambda x: F.array_contains("keyed", x["label"])), F.array().cast("array<struct<label:string,share:double>>"))
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform(found, lambda x: x["label"]))))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max(F.transform(found, lambda x: x["share"])), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
