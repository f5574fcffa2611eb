"""Each operator against brute force, on odd rows, and on empty tables."""

import html
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rulespark.llm import chat_format, decontamination, html_extract, jaccard_join, license_scan, line_dedup, lm_score, packing, quality_rules, sharding

SPACE = re.compile(r"[^ \t-\r]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_quality_counts(odd):
    want = []
    for i, t in texts(odd):
        t = t or ""
        w = SPACE.findall(t)
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    got = [tuple(r) for r in quality_rules.measure(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("line,fails", [
    ("Home | About | Contact | Help", True), ("BUY THIS NOW OR NEVER", True), ("### *** $$$ ###", True), ("Please read our privacy policy.", True),
    ("A plain line of prose that ends well.", False), ("Short title", False), ("It costs 5 $ in all, and that is that.", False),
])
def test_line_rules(spark, line, fails):
    df = spark.createDataFrame([(line,)], "x string").select(quality_rules.line_fails(F.col("x"), F.size(F.split("x", " "))))
    assert df.first()[0] is fails


def test_quality_cleans(odd, empty):
    out = quality_rules.clean(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} <= {1, 2, 9, 11}
    assert quality_rules.clean(empty).count() == 0


def test_licences(odd, empty):
    def brute(t):
        w = ALNUM.findall((t or "").translate(LOWER))
        hits = [(k, label) for p, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    rows = license_scan.scan(odd).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in texts(odd)), key=repr)
    assert {r["labels"] for r in rows if r["doc_id"] in (1, 2)} == {"apache,apache-2.0"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert license_scan.scan(empty).count() == 0


def test_line_dedup(spark, odd, empty):
    passage = "\n".join(f"the words of part {k} of the passage that is in both of the texts" for k in range(6))
    docs = spark.createDataFrame([(1, "own start\n" + passage + "\nown end"), (2, passage), (3, "before\n\n" + passage + "\nafter\n" + passage), (4, "own start\nown end")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in line_dedup.dedup(docs).select("row.doc_id", "n_deleted", "text").collect()}
    assert got == {1: (0, "own start\n" + passage + "\nown end"), 2: (6, ""), 3: (12, "before\n\nafter"), 4: (0, "own start\nown end")}
    out = line_dedup.clean(odd)
    assert out.columns == odd.columns and out.count() == odd.count() - 1  # the copy of the first goes
    assert line_dedup.clean(empty).count() == 0


def test_line_dedup_against_maximal_runs(spark):
    """Deleted are the lines of every maximal run of 50 words or more that stands earlier, found by comparing all places."""
    import random

    draw = random.Random(8)
    lines = [" ".join(f"w{draw.randint(0, 99)}" for _ in range(draw.choice([1, 5, 12, 20, 55]))) for _ in range(14)]
    docs = {}
    for k in range(40):
        own = [draw.choice(lines) if draw.random() < 0.75 else f"own {k} {j}" for j in range(draw.randint(0, 14))]
        if k % 3 == 0 and docs:
            own += draw.choice(list(docs.values()))[:8]
        docs[k] = [x for y in own for x in ([y, ""] if draw.random() < 0.2 else [y])]
    docs[50], docs[51] = [lines[0]] * 30, [lines[0]] * 7
    want = {}
    shown = {k: [x for x in v if x.strip()] for k, v in docs.items()}
    for k, v in shown.items():
        gone = set()
        for i in range(len(v)):
            for m, u in shown.items():
                for j in range(len(u)):
                    if m < k or m == k and j < i:
                        n = 0
                        while i + n < len(v) and j + n < len(u) and v[i + n] == u[j + n]:
                            n += 1
                        if sum(len(x.split()) for x in v[i : i + n]) >= 50:
                            gone |= set(range(i, i + n))
        places = [p for p, x in enumerate(docs[k]) if x.strip()]
        drop = {places[p] for p in gone}
        want[k] = (len(gone), "\n".join(x for p, x in enumerate(docs[k]) if p not in drop))
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in docs.items()], "doc_id long, text string").repartition(5)
    for places in (5_000_000, 0):  # broadcast, shuffle
        line_dedup.BROADCAST_PLACES = places
        got = {r["doc_id"]: (r["n_deleted"], r["text"]) for r in line_dedup.dedup(df).select("row.doc_id", "n_deleted", "text").collect()}
        assert got == want
    line_dedup.BROADCAST_PLACES = 5_000_000
    assert sum(n for n, _ in want.values()) > 40


def test_suffix_ranks_are_in_order(spark):
    rows = spark.createDataFrame([(k, 0, k, k % 7, 3 * k % 5) for k in range(60)] + [(99, 0, 0, 50, 50)], "k1 long, k2 long, pos int, a long, b long")
    got = line_dedup.ranked(rows.withColumns({"x": F.col("a"), "y": F.col("b")}), ["a", "b"], "t").collect()
    assert len({r["k1"] for r in got}) == 50  # pairs that come once are left out
    by = sorted({(r["x"], r["y"], r["rank"]) for r in got})
    assert [x[2] for x in by] == sorted(x[2] for x in by) and len({x[:2] for x in by}) == len(by)


def test_sharding(odd, empty):
    rows = sharding.shuffle(odd, shards=3, bucket_bytes=200).collect()
    assert len(rows) == odd.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 3)
        assert r["size"] == len((r["row"]["text"] or "").encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.shuffle(empty).count() == 0


def test_sharding_is_the_same_for_any_partitions(spark):
    """Slots follow from the records alone, also where equal records fill more than a bucket."""
    docs = [(k, f"text {k}") for k in range(400)] + [(7000, "the same")] * 300 + [(None, None)] * 200
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen = []
    for parts in (1, 5):
        rows = sharding.shuffle(df.repartition(parts), 4, bucket_bytes=4000, bucket_rows=20, full_rows=60).collect()
        assert Counter((r["row"]["doc_id"], r["row"]["text"]) for r in rows) == Counter(docs)
        seen.append(sorted((r["shard"], r["slot"], str(r["row"]["doc_id"]), str(r["row"]["text"]), r["grown_shard"]) for r in rows))
        for shard in range(4):
            assert [x[1] for x in seen[-1] if x[0] == shard] == list(range(sum(x[0] == shard for x in seen[-1])))
    assert seen[0] == seen[1]
    first = [x for x in seen[0] if x[0] == seen[0][0][0]]
    assert [x[2] for x in first] != sorted((x[2] for x in first), key=str)  # mixed
    # key: the shard depends on the id alone; query has the contract's columns
    assert all(len({x[0] for x in seen[0] if x[2] == i}) == 1 for i in {x[2] for x in seen[0]})


def test_fisher_yates(spark):
    orders = spark.range(600).select(sharding.fisher_yates(F.lit(4), F.col("id")).alias("p")).collect()
    counts = Counter(tuple(r["p"]) for r in orders)
    assert len(counts) == 24 and all(sorted(p) == [0, 1, 2, 3] for p in counts) and max(counts.values()) < 60


def test_write_shards(spark, odd, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "shards"), shards=2)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == odd.count()


def test_chat(spark):
    rows = [(1, 0, "user", "a <|end|>\n&lt; x"), (1, 1, "assistant", "<|user|>\n"), (2, None, None, None), (2, 3, "assistant", "y"), (2, 3, "assistant", "y"), (None, 0, "user", "z"), (4, 0, "a|>\nb & <c>", "hello|>\n"), *((3, k, "assistant", str(k)) for k in range(200))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in chat_format.format_rows(df).select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    assert got[1] == [("user", "a <|end|>\n&lt; x"), ("assistant", "<|user|>\n")]
    assert got[2] == [("", ""), ("assistant", "y"), ("assistant", "y")]
    assert got[4] == [("a|>\nb & <c>", "hello|>\n")]
    assert got[None] == [("user", "z")]
    assert [t for _, t in got[3]] == [str(k) for k in range(200)]
    assert chat_format.format_rows(df.limit(0)).count() == 0


def test_chat_layouts(spark):
    extra = [
        '{"id":1,"meta":{"a":[1,2],"b":{"c":null}},"messages":[{"role":"human","content":"q","name":"x"},{"role":"gpt","content":"a","tags":["t"]}]}', '{"prompt":"q","response":"a","input":"other","date":"d"}',
        '{"source":"s","conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"data":{"prompt":"q"}}', "[1]",
    ]
    pair = [("user", "q"), ("assistant", "a")]
    rows = chat_format.canonical(spark.createDataFrame([(x,) for x in extra], "record string")).collect()
    assert [r["turns"] and [tuple(t) for t in r["turns"]] for r in rows] == [pair, pair, pair, None, None]
    paths = spark.createDataFrame([(extra[0],)], "r string").select(chat_format.paths_of(F.parse_json("r"))).first()[0]
    assert paths == ["id", "messages[].content", "messages[].name", "messages[].role", "messages[].tags[]", "meta.a[]", "meta.b.c"]
    table = spark.createDataFrame([(1, 0, "n", "human", "hi")], "conv_id long, turn long, note string, `from` string, value string")
    assert [tuple(r) for r in chat_format.map_rows(table).collect()] == [(1, 0, "human", "hi")]
    records = ['{"messages":[{"role":"human","content":"q"},{"role":"assistant","content":"a"}]}', '{"prompt":"q","response":"a"}', '{"instruction":"i","input":"j","output":"o"}', '{"odd":1}', "not json", None]
    got = [r["turns"] and [tuple(t) for t in r["turns"]] for r in chat_format.canonical(spark.createDataFrame([(x,) for x in records], "record string")).collect()]
    assert got == [[("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "a")], [("user", "i"), ("user", "j"), ("assistant", "o")], None, None, None]


def test_packing(odd, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(packing.tokenizer_path()[0])
    want = Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in texts(odd))
    pieces = packing.pack(odd).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
        documents[p["doc_id"]].append(p)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    ids = lambda p: tuple(memoryview(p["ids"]).cast("I"))
    for i, parts in documents.items():
        if sum(v for k, v in want.items() if k[0] == i) == 1:
            parts.sort(key=lambda p: p["start"])
            assert sum((ids(p) for p in parts), ()) == next(k[1] for k in want if k[0] == i)
    assert packing.pack(empty).count() == 0


def test_packing_limits():
    p = packing.Packer(0, 100, 3, 40)
    for k in range(60):
        p.add(k, b"\0\0\0\0" * (5 + 7 * k % 90), prompt=3 * k % 20)
    p.pack(0)
    whole, parts, segments, loss = Counter(), Counter(), Counter(), Counter()
    for doc, start, length, _, n, sequence, _ in p.out:
        whole[doc] += length
        parts[sequence] += length
        segments[sequence] += 1
        loss[sequence] += packing.Packer.loss(start, length, 3 * doc % 20)
        assert whole[doc] <= n
    assert all(whole[k] == 5 + 7 * k % 90 for k in range(60))
    assert max(parts.values()) <= 100 and max(segments.values()) <= 3 and max(loss.values()) <= 40


def test_encoder():
    import random

    from tokenizers import Tokenizer

    encoder, exact, draw = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path()[0]), random.Random(3)
    odd_texts = ["".join(draw.choice("ab Z9é\n\t\r　\xa0\x1c\x85.,'!  's日\U0001f600​\0") for _ in range(draw.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|> b", "<|chunk|> x"]
    for t, raw in zip(odd_texts, encoder.encode(odd_texts)):
        assert list(memoryview(raw).cast("I")) == exact.encode(t, add_special_tokens=False).ids


def components(links, nodes):
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_jaccard(spark, odd, empty):
    import random

    draw = random.Random(5)
    base = [" ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(draw.randint(0, 40)) for _ in range(draw.randint(3, 120))) for _ in range(12)]
    docs = []
    for b in base:
        words = b.split()
        for _ in range(6):
            w = list(words)
            for _ in range(draw.randint(0, max(1, len(w) // 40))):
                w[draw.randrange(len(w))] = "new" + str(draw.randint(0, 9))
            docs.append(" ".join(w))
    df = spark.createDataFrame([(k, t) for k, t in enumerate(docs)] + [(900, None), (901, "")], "doc_id long, text string")

    def grams(t):
        w = SPACE.findall((t or "").translate(LOWER))
        return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()

    sets = {i: grams(t) for i, t in texts(df)}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    label = components(links, sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(df, 4, 85).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    out = jaccard_join.join(odd).collect()
    assert len(out) == odd.count() and {r["component_id"] for r in out if r["doc_id"] in (1, 2)} == {1}
    assert jaccard_join.clean(odd).columns == odd.columns
    assert jaccard_join.join(empty).count() == 0


def test_decontamination(spark, odd, empty):
    items = spark.createDataFrame([("a", "the text stands here and says nothing much about anything at"), ("b", "MIT license"), ("c", None), ("d", ""), ("e", "mit LICENSE"), (None, "one")], "item_id string, text string")
    bench = [(r["item_id"], ALNUM.findall((r["text"] or "").translate(LOWER))) for r in items.collect()]
    want = []
    for i, t in texts(odd):
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for item, words in bench:
            for k in range(max(1, len(words) - 9)) if words else ():
                window = words[k : k + 10]
                for s in range(len(w)):
                    if w[s : s + len(window)] == window:
                        hit |= set(range(s, s + len(window)))
                        found.add(item)
        want.append((i, len(w), len(hit), len(found), sorted(x for x in found if x)))
    # an item with a null id hits and counts, but is not named
    assert (6, 1, 1, 1, []) in want
    for words, section in ((1_000_000, 1_000_000), (3, 1_000_000), (3, 5)):  # one block, a block for each item, several indexes
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"]) for r in decontamination.measure(odd, items, words, section).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r["doc_id"] for r in decontamination.clean(odd, items).collect()} == {i for i, _, n, *_ in want if not n}
    assert decontamination.measure(empty, items).count() == 0
    assert decontamination.measure(odd, items.limit(0)).filter("contaminated").count() == 0
    near = decontamination.proximity(odd, "license mit", 1)
    assert {r["doc_id"] for r in near.collect()} == {7}


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='ad'>buy</div><article><h1>Head &amp; tail</h1><p><b>one<br>more<p>two\n  lines &eacute;<script>x<y</script><div class=comments><p>hi</div></article><footer>f</footer></body></html>"
    rows = [(k, f"http://h.example/{k}", page.replace("one", f"one {k}")) for k in range(5)] + [(90, None, None), (91, "http://h.example/x", ""), (92, "http://other.example/", "<body><p>only &lt;text&gt;</p><ul><li><a href=x>link</a></li></ul>"), (93, "x", "a < b")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3][0] == "Head & tail\n\none 3 more\n\ntwo lines é"
    assert got[90] == ("", 0) and got[91] == ("", 0)
    assert got[92][0] == "only <text>"
    assert got[93][0] == html.unescape("a < b")


def test_wrapper_alignment():
    a, b = ([[x, False, 1] for x in s] for s in ("hpf", "haf"))
    assert [(x, o) for x, o, _ in html_extract.align(a, b)] == [("h", False), ("p", True), ("a", True), ("f", False)]
    assert html_extract.fold(tuple("abababc")) == ("a", "b", "c")


def test_language_model(spark, odd, empty):
    import random

    draw = random.Random(2)
    docs = [(k, " ".join(f"{'de'[k % 2]}{draw.randint(0, 30)}" for _ in range(200))) for k in range(300)]
    df = spark.createDataFrame(docs + [(900, None), (901, "unseen words")], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t in texts(df):
        if not held(i):
            counts.update((t or "").split() + [""])
    n, v = sum(counts.values()), len(counts)
    model, vocabulary, tokens, distinct = lm_score.fit(df.filter(lm_score.fold() != 2))
    assert (tokens, distinct) == (n, v)
    got = {r["doc_id"]: r for r in lm_score.score(df, model, vocabulary, tokens, distinct).collect()}
    for i, t in texts(df):
        w = (t or "").split() + [""]
        assert got[i]["n_tokens"] == len(w) and got[i]["n_known"] == sum(counts[x] > 0 for x in w)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert got[i]["score"] < 0
    # every context's probabilities sum to 1
    import numpy as np

    one, two = model.contexts()
    assert np.allclose(np.exp(one[5] + two[7] - model.log_z[5, 7]).sum(), 1, atol=1e-3)
    out = lm_score.score(odd, model, vocabulary, tokens, distinct)
    assert out.count() == odd.count()
    none = lm_score.fit(empty)
    assert none[2:] == (0, 0) and lm_score.score(empty, *none).count() == 0




def test_html_site_text(spark):
    """Without content elements, texts that all pages of a host share go, whatever their names."""
    page = "<body><div class='x7'>We moved house.</div>{}<div class='story'><p>Story {} begins.</p><p>Same end.</p></div><div class='y'><p>Call us.</p><p>Write to us.</p></div></body>"
    rows = [(k, f"http://plain.example/{k}", page.format("<div class='x8'>Sale on some pages.</div>" if k % 2 else "", k)) for k in range(12)]
    rows += [(100 + k, "http://copies.example/", "<body><p>All the same.</p></body>") for k in range(5)] + [(200, "http://one.example/", page.format("", 200))]
    got = {r["page_id"]: r["text"] for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(12)} == {f"Story {k} begins.\n\nSame end." for k in range(12)}
    assert {got[100 + k] for k in range(5)} == {"All the same."}
    assert got[200] == "We moved house.\n\nStory 200 begins.\n\nSame end.\n\nCall us.\n\nWrite to us."


def test_wrapper_slots():
    assert [(x, r) for x, r, _ in html_extract.groups(list("abababc"))] == [("a", True), ("b", True), ("c", False)]
    a, b = [["d", False, 5, False, 1], ["d", False, 5, False, None]], [["d", False, 1, True, 7]]
    assert html_extract.align(a, b) == [["d", True, 5, False, 1], ["d", False, 6, True, None]]


def test_common_subsequence(monkeypatch):
    import random

    draw = random.Random(1)
    for k in range(400):
        monkeypatch.setattr(html_extract, "MOST_BITS", (20, 1 << 28)[k % 2])
        a, b = ([draw.choice("abcd") for _ in range(draw.randint(0, 14))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        pairs = html_extract.common(a, b)
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_html_long_wrappers(spark):
    """Neither a page of many slots nor a host of many structures loses what comes after them."""
    import random

    draw = random.Random(4)
    many = "".join(f"<div class='k{draw.choice('abcdefgh')}'>w</div>" for _ in range(9000))
    tail = "<div class='own'>Page {}.</div><div class='site'>Call us.</div></body>"
    rows = [(k, "http://long.example/", "<body>" + many + tail.format(k)) for k in range(3)]
    # labels that no rule makes equal, 150 structures: a tree of two rounds
    name = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    rows += [(100 + k, "http://wide.example/", f"<body><div class='s{name(k)}'>Slot {k}</div>" + tail.format(k)) for k in range(150)]
    got = {r["page_id"]: r["text"] for r in html_extract.texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Page {k}." for k in range(3))
    assert all(got[100 + k] == f"Slot {k}\n\nPage {k}." for k in range(150))
    assert len(html_extract.groups([str(k) for k in range(9000)])) == 9000


def test_licence_templates(spark):
    """A file that holds every template has every label; key phrases count with all their words."""
    every = "\n\n".join(t for t, _ in license_scan.TEMPLATES.values())
    rows = [(1, every), (2, "Licensed under CC x NC."), (3, "licensed under CC-BY-NC"), *((10 + k, license_scan.TEMPLATES["apache-2.0"][0]) for k in range(8))]
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] >= set(license_scan.TEMPLATES)
    assert got[2] == {""} and got[3] == {"cc-by-nc"} and got[10] == {"apache", "apache-2.0"}


COLUMNS = {
    "op1_lm_score": "doc_id:bigint held_out:boolean n_tokens:bigint n_known:bigint train_tokens:bigint base_score:double score:double",
    "op2_license_scan": "doc_id:bigint n_words:bigint n_base:bigint first_word:bigint last_word:bigint base_labels:string labels:string score:double",
    "op3_quality_rules": "doc_id:bigint n_words:bigint word_chars:bigint n_symbols:bigint n_dup_lines:bigint n_repeat_words:bigint base_failed:boolean kept:boolean",
    "op4_html_extract": "page_id:bigint url:string text:string n_chars:bigint",
    "op5_sharding": "doc_id:bigint size:bigint text_crc32:bigint law:string shard:int slot:bigint grown_shard:int",
    "op6_chat_format": "conv_id:bigint n_turns:bigint turns_sha256:string loss_chars:bigint loss_sha256:string formatted_chars:bigint",
    "op7_decontamination": "doc_id:bigint n_words:bigint n_hit:bigint n_items:bigint items_sha256:string contaminated:boolean",
    "op8_packing": "doc_id:bigint start:bigint length:bigint ids_crc32:bigint doc_tokens:bigint sequence_id:bigint offset:bigint",
    "op9_jaccard_join": "doc_id:bigint n_shingles:bigint component_id:bigint",
}


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory, odd):
    """A data set with odd documents and a part of the real ones."""
    root = tmp_path_factory.mktemp("small")
    real = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{real}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    documents.filter("doc_id > 100").unionByName(odd.select(*documents.columns)).write.parquet(f"{root}/documents.parquet")
    for name in ("pages", "benchmark", "conversations"):
        spark.read.parquet(f"{real}/{name}.parquet").write.parquet(f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", COLUMNS)
def test_query_columns(spark, small, name):
    from rulespark.llm import queries

    df = queries.QUERIES[name](spark, small)
    assert set(COLUMNS[name].split()) <= {f"{n}:{t}" for n, t in df.dtypes}
    rows = df.collect()
    keys = {"op4_html_extract": "page_id", "op6_chat_format": "conv_id"}
    table = {"op4_html_extract": "pages", "op6_chat_format": "conversations"}.get(name, "documents")
    have = Counter(r[keys.get(name, "doc_id")] for r in spark.read.parquet(f"{small}/{table}.parquet").collect())
    got = Counter(r[keys.get(name, "doc_id")] for r in rows)
    assert set(got) - {-1} == set(have)
    if name not in ("op6_chat_format", "op8_packing"):
        assert got == have
    if name == "op5_sharding":
        texts_of = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts_of)
        assert {r["law"] for r in rows} == {"key"} and {r["shard"] for r in rows} <= set(range(16)) and all(r["grown_shard"] in (r["shard"], 16) for r in rows)
    if name == "op8_packing":
        whole = Counter()
        for r in rows:
            whole[r["doc_id"]] += r["length"]
        assert all(sum(n for _, n in Counter({(r["doc_id"], r["doc_tokens"]): 1 for r in rows if r["doc_id"] == i}).items()) >= 1 for i in whole)


def test_model_beats_the_base(spark):
    """On texts held out, at the size of the smaller data set."""
    from rulespark.llm import queries

    held = queries.QUERIES["op1_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert held[0] > held[1] + 0.05 * held[2]


def test_inner_items_are_normalised(spark):
    import numpy as np

    words = [(f"w{k}".encode(), 1000 - k) for k in range(900)]
    sums = Counter()
    heads = lm_score.SYMBOLS - lm_score.CLASSES - 1
    for w, n in words[heads:]:
        sums[lm_score.class_of(w)] += n + 1
    model = lm_score.Model([(lm_score.END, 50), *words], dict(sums))
    draw = np.random.default_rng(1)
    model.p += draw.normal(0, 1, model.p.shape).astype(np.float32)
    model.normalise()
    for h in (0, 5, 900):
        scores = model.t[h] @ model.p.T + model.d
        for c in range(0, lm_score.CLASSES, 37):
            inside = model.item_class == c
            assert np.exp(scores[inside] - model.log_y[h, c]).sum() == pytest.approx(1, abs=1e-4)
    lookup = model.lookup()
    assert lookup.item[lookup[b"w0"]] == -1 and model.item_class[lookup.item[lookup[b"w899"]]] == lm_score.class_of(b"w899")
    assert lookup[b"unseen"] == lookup.others + lm_score.class_of(b"unseen")


def test_html_article_names(spark):
    """Inside an article, names that prose may have count only for lists of links."""
    rows = [
        (1, '<article><p>Body one.</p><div class="share">Prose about shares.</div><div class="share"><a href=x>Tweet</a> <a href=y>Post</a></div><div class="comments">No.</div></article>'),
        (2, '<article><section class="related work"><p>Earlier <a href=x>work</a> did this.</p></section></article>'), (3, '<body><p><a href=x>All of it is a link</a></p></body>'),
        (4, '<div class="related"><article><p>Kept out by name above it?</p></article></div><main><p>Main.</p></main>'),
    ]
    got = {r["page_id"]: r["text"] for r in html_extract.texts(spark.createDataFrame([(k, f"http://h{k}.example/", h) for k, h in rows], "page_id long, url string, html string")).collect()}
    assert got[1] == "Body one.\n\nProse about shares." and got[2] == "Earlier work did this." and got[3] == "All of it is a link"
    assert got[4].endswith("Main.")
