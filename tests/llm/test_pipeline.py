"""The corpus pipeline, stage by stage, against brute force."""

import re
from collections import Counter

import pytest

import corpus_pipeline as cp
from rulespark.llm.common import stored

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^ \t-\r]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = SPACE.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd):
    root = tmp_path_factory.mktemp("pipeline")
    real = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{real}/documents.parquet")
    documents.filter("doc_id > 100").unionByName(odd.select(*documents.columns)).write.parquet(f"{root}/documents.parquet")
    spark.read.parquet(f"{real}/benchmark.parquet").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality rules", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    kept = {}
    for name, stage in cp.STAGES[:-1]:
        out = stored(stage(spark, docs, folder), "t")
        assert out.columns == docs.columns, name
        kept[name] = (docs.collect(), out.collect())
        docs = out
    # every stage keeps ids that it was given; quality rejects some and keeps texts of at least half the words
    for before, after in kept.values():
        assert Counter(r["doc_id"] for r in after) <= Counter(r["doc_id"] for r in before)
    before, after = kept["quality rules"]
    texts = {r["doc_id"]: r["text"] or "" for r in before}
    assert 0 < len(after) < len(before) and all(2 * len(SPACE.findall(r["text"])) >= len(SPACE.findall(texts[r["doc_id"]])) >= 50 for r in after)
    # one of each group of near copies
    before, after = kept["n-gram Jaccard join"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["doc_id"] for r in after} == {i for i in sets if label[i] == i or not sets[i]}
    # nothing with a benchmark passage
    before, after = kept["benchmark decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect():
        w = ALNUM.findall((r["text"] or "").translate(LOWER))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not hit(ALNUM.findall(r["text"].translate(LOWER)))}
    # the last stage is what run gives, and packs every token once
    pieces = cp.run(spark, folder)
    whole = Counter()
    for r in pieces.collect():
        whole[r["doc_id"]] += r["length"]
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces.collect()}
    assert dict(whole) == tokens and set(tokens) == {r["doc_id"] for r in after}


def test_odd_tables(spark, folder, empty, tmp_path):
    """Stages on empty tables, clashing columns, null and repeated ids."""
    out = empty
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, out, folder)
        assert out.columns == empty.columns and out.count() == 0
    assert cp.STAGES[-1][1](spark, out, folder).count() == 0


def test_odd_rows(spark, folder, odd):
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns, name
        assert all(set(r.asDict().values()) >= {"clash"} for r in out.collect())
