"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page is a row of slots: its text by the block elements above it (named by element; containers also by class
and id, with long numbers as 0).  Equal slots in a row, or equal rows of two or three, become a repeated group.  Two rows
of slots of a host are aligned, slots with equal text first; where they differ, a slot that one side has and the other
lacks becomes optional, and differing texts leave the slot without a text of its own.  Wrappers are merged in the same
way in a tree over salted groups of the host's distinct structures; none is cut.

Text in menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments of readers, named by
their elements, classes and ids, goes.  If a page has text in an article or main element, that is its text.  Any other
page is matched to its host's wrapper: slots whose text is the same on all their pages, three at least, hold the
site's text and go, a repeated group as a whole; so do blocks that mostly consist of links.  A page of which
nothing would be left, as where all pages of a host are copies or all text is links, keeps its slots.

Defined cases: null or empty html gives an empty text; broken and unclosed markup is read as browsers read it
(the end tag of an outer element closes inner ones, a new block closes an open paragraph); a null url is a host of
its own; repeated rows give a row each; extra columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html as html_lib
import re
from functools import lru_cache
from hashlib import blake2b
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, small_batches, stored

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][-\w:]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements by kind.  Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg".split())
BOILER = frozenset("nav header footer aside form head button select dialog menu object canvas audio video map figure-ad".split()) | RAW
CONTENT = frozenset(("article", "main"))
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: A paragraph cannot hold these; they close it.
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot caption legend summary html body".split())
#: Words of a class, id or role that name something other than the text.  Fixed values.
BOILER_NAME = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|login|masthead|menu|nav\w*|newsletter|notice|pagination|popup|promo\w*|related|replies|reply|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I)
#: Of these, names that prose in an article may have too: inside it they count only for blocks that mostly consist of links.
WEAK_NAME = re.compile(r"(?:^|[\s_-])(?:related|share|sharing|search|header|footer|reply|promo\w*)(?=$|[\s_-])", re.I)
SPACE = re.compile(r"\s+")
DIGITS = re.compile(r"\b[0-9a-f]*\d[0-9a-f]{7,}\b|\d{3,}")
#: Elements whose marks name a slot; those of headings, paragraphs and articles are often a page's own.
MARKED = frozenset("div section table td ul ol dl".split())
#: A slot whose text is the same on all its pages, so many at least, holds the site's text.
MIN_PAGES = 3
#: Structures of a host that a task merges, on average.
FAN_IN = 64
#: Structures that a task holds, and bits of an alignment that are kept for its way back.
HELD, MOST_BITS = 20_000, 1 << 28
#: Fields of a wrapper's item.
ITEM = ("item", "optional", "pages", "repeated", "text")


def tokens(page: str):
    """('open' | 'close' | 'text', name or text, label) of a page; raw elements lose their content."""
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        raw, at = m.group(), m.end()
        if raw.startswith("<!") or raw.startswith("<?"):
            continue
        tag = TAG.match(raw)
        if not tag:
            yield "text", raw, ""
            continue
        name = tag.group(2).lower()
        if tag.group(1):
            yield "close", name, ""
            continue
        marks = " ".join(x for a in ATTRIBUTE.findall(raw) for x in a[1:] if x)
        yield "open", name, marks
        if name in RAW and not raw.endswith("/>"):
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            yield "close", name, ""
        elif name in VOID or raw.endswith("/>") and name not in BLOCKS:
            yield "close", name, ""


def pieces(page: str):
    """(path, text) in page order: text with the open elements above it; None as text for a break."""
    stack: list[str] = []
    for kind, name, marks in tokens(page):
        if kind == "text":
            yield tuple(stack), name
        elif kind == "open":
            if name in CLOSES_P and "p" in (x.partition(".")[0] for x in stack):
                while stack and stack.pop().partition(".")[0] != "p":
                    pass
                yield tuple(stack), None
            if name in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1].partition(".")[0] == name:
                stack.pop()
            if name in BLOCKS or name == "br":
                yield tuple(stack), None if name != "br" else " "
            stack.append(f"{name}.{marks}" if marks else name)
        elif name in (x.partition(".")[0] for x in stack):
            while (top := stack.pop().partition(".")[0]) != name:
                if top in BLOCKS:
                    yield tuple(stack), None
            if name in BLOCKS:
                yield tuple(stack), None


def is_boiler(step: str) -> bool:
    name, _, marks = step.partition(".")
    return name in BOILER or bool(marks and name not in ("html", "body", "article", "main") and BOILER_NAME.search(marks))


def is_weak(step: str) -> bool:
    """Boilerplate only by names that prose may have."""
    name, _, marks = step.partition(".")
    return name not in BOILER and not BOILER_NAME.search(WEAK_NAME.sub(" ", marks))


def step_label(step: str) -> str:
    """A step of a slot's path: the element, and for containers the words of its marks, with numbers as 0."""
    name, _, marks = step.partition(".")
    words = sorted({DIGITS.sub("0", w) for w in marks.lower().split()}) if name in MARKED else []
    return ".".join([name, *words])


@lru_cache(100_000)
def slot_of(path: tuple[str, ...]) -> tuple[str, str, bool]:
    """(label, 'content' | 'weak' | 'body' | 'boiler', inside a link) of a path.  Inline elements are not in the label;
    what lies inside a content element or a boilerplate element has that element's label."""
    names = [x.partition(".")[0] for x in path]
    inside = next((k for k, n in enumerate(names) if n in CONTENT), None)
    # a header inside the content is the text's own unless it is named otherwise
    boiler = next((k for k, x in enumerate(path) if k != inside and is_boiler(x) and not (inside is not None and k > inside and is_weak(x))), None)
    weak = boiler is None and inside is not None and any(is_boiler(x) for x in path[inside + 1 :])
    end = boiler if boiler is not None else inside
    label = "/".join(step_label(x) for x, n in zip(path[:end], names) if n in BLOCKS)
    if end is not None:
        label += f"/{names[end]}" + ("!" if boiler is not None else "")
    return label, "boiler" if boiler is not None else "body" if inside is None else "weak" if weak else "content", "a" in names


def blocks(page: str) -> list[list]:
    """[label, kind, text, characters in links] of a page's blocks in order; boilerplate has no text."""
    out: list[list] = []
    at: dict[str, list] = {}  # the open block of a kind
    for path, text in pieces(page):
        if text is None:
            at.clear()
            continue
        label, kind, linked = slot_of(path)
        if kind == "boiler":
            if text.strip() and (not out or out[-1][0] != label):
                out.append([label, kind, [], 0])
            continue
        if kind not in at:
            at[kind] = [label, kind, [], 0]
            out.append(at[kind])
        decoded = html_lib.unescape(text)
        at[kind][2].append(decoded)
        if linked:
            at[kind][3] += len(decoded.strip())
    for x in out:
        x[2] = SPACE.sub(" ", "".join(x[2])).strip()
        if x[1] == "weak":
            x[1] = "content" if x[3] * 2 <= len(x[2]) else "boiler"
            x[2] = x[2] if x[1] == "content" else ""
    return out


def slots(found: list[list]) -> tuple[list[list], list[int | None]]:
    """([label, repeated, text hash] of a page's slots, slot of each block): blank blocks have none.

    The text of a repeated group is that of all its members.  Content and boilerplate are judged by their
    elements, so their texts are not compared and have no hash.
    """
    shown = [k for k, x in enumerate(found) if x[2] or x[1] == "boiler"]
    where: list[int | None] = [None] * len(found)
    out = []
    for label, repeated, members in groups([found[k][0] for k in shown]):
        texts = [found[shown[m]][2] for m in members if found[shown[m]][1] == "body"]
        out.append([label, repeated, int.from_bytes(blake2b("\n".join(texts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True) if texts else None])
        for m in members:
            where[shown[m]] = len(out) - 1
    return out, where


def groups(labels: list[str]) -> list[tuple[str, bool, list[int]]]:
    """(label, repeated, places): equal blocks in a row become one repeated group, shorter blocks first."""
    out = [(x, False, [k]) for k, x in enumerate(labels)]
    for width in (1, 2, 3):
        done: list[tuple[str, bool, list[int]]] = []
        for x in out:
            done.append(x)
            while len(done) >= 2 * width and all(done[-k][0] == done[-k - width][0] for k in range(1, width + 1)):
                last = done[-width:]
                del done[-width:]
                done[-width:] = [(y[0], True, y[2] + z[2]) for y, z in zip(done[-width:], last)]
        out = done
    return out


def fold(items: tuple[str, ...]) -> tuple[str, ...]:
    """Labels after equal blocks in a row became one."""
    return tuple(x[0] for x in groups(list(items)))


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by rows of bits; None equals nothing."""
    head, tail, least = 0, 0, min(len(a), len(b))
    while head < least and a[head] == b[head] and a[head] is not None:
        head += 1
    while tail < least - head and a[-1 - tail] == b[-1 - tail] and a[-1 - tail] is not None:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(head)] + [(i + head, j + head) for i, j in _common(x, y)] + ends


def _rows(a: list, b: list):
    """After each of b: bit i is 0 where a[: i + 1] has one more in common with it than a[:i]."""
    places: dict = {}
    for i, x in enumerate(a):
        if x is not None:
            places[x] = places.get(x, 0) | 1 << i
    every = row = (1 << len(a)) - 1
    for x in b:
        both = row & places.get(x, 0)
        row = (row + both | row - both) & every
        yield row


def _common(a: list, b: list) -> list[tuple[int, int]]:
    if not a or not b:
        return []
    if len(a) * len(b) > MOST_BITS and len(b) > 1:
        # halves of b, at the best cut of a: the rows of bits of a half are not kept
        half, row, back = len(b) // 2, 0, 0
        for row in _rows(a, b[:half]):
            pass
        for back in _rows(a[::-1], b[half:][::-1]):
            pass
        left, right = ([0, *accumulate(c == "0" for c in reversed(f"{r:0{len(a)}b}"))] for r in (row, back))
        cut = max(range(len(a) + 1), key=lambda k: left[k] + right[len(a) - k])
        return _common(a[:cut], b[:half]) + [(i + cut, j + half) for i, j in _common(a[cut:], b[half:])]
    rows, out, i, j = list(_rows(a, b)), [], len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def matched(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """Places of equal slots: those with the same text first; between them those not known to be constant; then any."""
    text = lambda x: (x[0], x[4]) if len(x) > 3 and x[4] is not None else None
    free = lambda x: None if text(x) and x[2] > 1 else x[0]
    pairs: list[tuple[int, int]] = []
    for key in (text, free, lambda x: x[0]):
        found, i, j = [], 0, 0
        for k, m in (*pairs, (len(a), len(b))):
            found += [(i + x, j + y) for x, y in common([key(x) for x in a[i:k]], [key(x) for x in b[j:m]])]
            if k < len(a):
                found.append((k, m))
            i, j = k + 1, m + 1
        pairs = found
    return pairs


def align(a: list[list], b: list[list]) -> list[list]:
    """Merge wrappers, lists of [label, optional, pages, repeated, text hash], the last two where texts are compared.

    Mismatches turn optional, matches add up, differing texts become a slot without a hash."""
    out: list[list] = []
    i = j = 0
    for k, m in (*matched(a, b), (len(a), len(b))):
        out += [[x[0], True, *x[2:]] for x in (*a[i:k], *b[j:m])]
        if k < len(a):
            x, y = a[k], b[m]
            out.append([x[0], x[1] or y[1], x[2] + y[2], *([x[3] or y[3], x[4] if x[4] == y[4] else None] if len(x) > 3 else [])])
        i, j = k + 1, m + 1
    return out


def host_column(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][-+.\w]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, items array<struct<item, optional, pages, repeated, text>>): a wrapper for each host."""

    def structures(batches):
        import pyarrow as pa

        def out(seen):
            columns = zip(*((host, list(labels), list(repeated), texts, n) for (host, labels, repeated), (texts, n) in seen.items()))
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["host", "slots", "repeated", "texts", "n"])

        seen: dict[tuple, list] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = slots(blocks(page.as_py() or ""))[0]
                key, texts = (host, tuple(x[0] for x in found), tuple(x[1] for x in found)), [x[2] for x in found]
                if key in seen:
                    old = seen[key]
                    old[0], old[1] = [x if x == y else None for x, y in zip(old[0], texts)], old[1] + 1
                else:
                    seen[key] = [texts, 1]
                if len(seen) >= HELD:
                    yield out(seen)
                    seen = {}
        if seen:
            yield out(seen)

    kind = "host string, items array<struct<item:string,optional:boolean,pages:long,repeated:boolean,text:long>>"
    counted = pages.select(host_column(pages["url"].cast("string")).alias("host"), pages["html"].cast("string").alias("html"))
    counted = counted.mapInArrow(structures, "host string, slots array<string>, repeated array<boolean>, texts array<long>, n long")
    counted = counted.groupBy("host", "slots", "repeated").agg(F.collect_set("texts").alias("all"), F.sum("n").alias("n"))
    texts = F.aggregate("all", F.get("all", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.when(x == y, x)))

    def merge(key, table):
        import pyarrow as pa

        whole: list[list] = []
        for items in sorted(table.column("items").to_pylist(), key=lambda x: (-max((y["pages"] for y in x), default=0), str(x))):
            one = [list(x.values()) for x in items]
            whole = align(whole, one) if whole else one
        rows = [dict(zip(ITEM, x)) for x in whole]
        return pa.table({"host": pa.array([key[0].as_py()]), "items": pa.array([rows], pa.list_(pa.struct(list(zip(ITEM, (pa.string(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()))))))})

    item = lambda x: F.struct(x["slots"].alias("item"), F.lit(False).alias("optional"), F.col("n").alias("pages"), x["repeated"].alias("repeated"), x["texts"].alias("text"))
    first = counted.withColumn("texts", texts).select("host", F.transform(F.arrays_zip("slots", "repeated", "texts"), item).alias("items"))
    # a tree: in each round a host's rows fall by FAN_IN, until all are in one
    rows = stored(first, "structures")
    salts = None
    while salts != 1:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 1
        salts = min(-(-most // FAN_IN), salts - 1 if salts else most)
        rows = stored(rows.groupBy("host", F.pmod(F.xxhash64("items"), F.lit(salts)).alias("salt")).applyInArrow(merge, kind), "wrappers")
    return rows


def decide(items: list[dict] | None) -> str:
    """'content' if the wrapper shows text inside a content element, outside boilerplate, else 'body'."""
    return "content" if any(x["item"].rpartition("/")[2] in CONTENT for x in items or []) else "body"


def constants(items: list[dict] | None) -> list[dict]:
    """The slots that hold the site's own text: the same on all their pages, on MIN_PAGES at least."""
    return [x for x in items or [] if x["text"] is not None and x["pages"] >= MIN_PAGES]


def text_blocks(found: list[list], kinds: tuple[str, ...], links: bool) -> list[int]:
    """Blocks of these kinds that have text; with `links` false, not those that mostly consist of links."""
    return [k for k, x in enumerate(found) if x[1] in kinds and x[2] and (links or x[3] * 2 <= len(x[2]))]


def texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    found = wrappers(small_batches(pages))
    rule = "host string, how string, known array<struct<item:string,text:long>>"

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            hosts, items = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            known = [[{"item": x["item"], "text": x["text"]} for x in constants(x)] for x in items]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([decide(x) for x in items], pa.string()), pa.array(known, pa.list_(pa.struct([("item", pa.string()), ("text", pa.int64())])))], ["host", "how", "known"])

    rules = stored(found.mapInArrow(judge, rule).filter("how != 'content' or size(known) > 0"), "host-rules")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    slot = [("item", "string"), ("text", "long")]
    open_page = f"struct<blank:boolean,slots:array<struct<{','.join(f'{n}:{t}' for n, t in slot)}>>,blocks:array<struct<slot:int,text:string>>>"

    def own(batches):
        """Pages with text in a content element are done; of the others, slots and blocks go to the host's wrapper."""
        import pyarrow as pa

        kind = pa.struct([("blank", pa.bool_()), ("slots", pa.list_(pa.struct([("item", pa.string()), ("text", pa.int64())]))), ("blocks", pa.list_(pa.struct([("slot", pa.int32()), ("text", pa.string())])))])
        for batch in batches:
            done, left = [], []
            for page in batch.column(3):
                all_blocks = blocks(page.as_py() or "")
                inside = text_blocks(all_blocks, ("content",), True)
                done.append("\n\n".join(all_blocks[k][2] for k in inside) if inside else None)
                if inside:
                    left.append(None)
                    continue
                items, where = slots(all_blocks)
                left.append({
                    "blank": any(x[1] == "content" for x in all_blocks), "slots": [{"item": x[0], "text": x[2]} for x in items],
                    "blocks": [{"slot": where[k], "text": all_blocks[k][2]} for k in text_blocks(all_blocks, ("body",), False) or text_blocks(all_blocks, ("body",), True)],
                })
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(done, pa.string()), pa.array(left, kind)], ["page_id", "url", "host", "done", "left"])

    def match(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for done, left, how, known in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                if left is None:
                    out.append(done)
                elif left["blank"] and how != "body":
                    out.append("")
                else:
                    key = lambda x: None if x["text"] is None else (x["item"], x["text"])
                    site = {i for i, _ in common([key(x) for x in left["slots"]], [key(x) for x in known or []])}
                    own_text = [x["text"] for x in left["blocks"] if x["slot"] not in site]
                    # copies of one page differ nowhere: their text is not the site's
                    out.append("\n\n".join(own_text or [x["text"] for x in left["blocks"]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    # pages that are done need no wrapper and join nothing; the rest, on hosts of any number, are joined by host
    rows = rows.withColumn("host", host_column(F.col("url"))).select("page_id", "url", "host", "html")
    rows = rows.mapInArrow(own, f"page_id long, url string, host string, done string, left {open_page}")
    key = F.when(F.col("left").isNull(), F.concat(F.lit("\0"), F.xxhash64("page_id", "url").cast("string"))).otherwise(F.col("host"))
    rows = rows.withColumn("host", key).join(rules, "host", "left").select("page_id", "url", "done", "left", "how", "known")
    return rows.mapInArrow(match, "page_id long, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(read(spark, sf_dir, "pages"))
