"""Main-text extraction by wrapper induction over pages of one host.

Method: pages become DOM trees. A page is aligned with REFERENCES other pages of
its host by simple tree matching (largest order-preserving match of children
with equal labels, runs of equally labelled siblings taken as one repeated
slot). Nodes whose aligned partners hold the same text are template; varying
slots are content. The page's text is its content slot, a main element, an
article or what holds all articles if there are any, else the body, without
template and without parts whose tag, role or class says that they are menus,
notices, adverts, forms or comments.

A host's references are its distinct pages with the smallest hashes, so a page's
text depends on its host's pages alone, never on partitions or batches. Pages
are dealt by host, the pages of a large one by hash into parts of HOST pages on
average, to each of which its references are sent along: a host with a third of
all pages is spread over many tasks, each page of which is aligned REFERENCES
times. Nothing is held but the references and the page in hand.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwright.plans.recovery import written

from .columns import Columns
from .sizing import PART_BYTES, parts, small_batches

#: Pages of a host that each of its pages is aligned with.
REFERENCES = 5
#: Pages of a host that are not cut into parts; hosts that are, at most (the largest ones, so that their table can be broadcast).
HOST, MOST_HOSTS = 256, 1 << 16
#: A reference that leaves less than this share of a page's text varying is a near-copy of it, no witness of a template.
VARYING = 0.1
#: Up to so many pairs of differing sibling slots the largest match is found; beyond, the next equal label in order is taken.
PAIRS = 1 << 12

# Elements and names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROP = frozenset("head nav footer aside form button select textarea iframe object dialog menu canvas svg audio video noscript template title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words of a class or id that mark reader comments, and other parts beside the content.
COMMENTS = frozenset("comment comments commentlist reply replies discussion disqus respond".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "sidebar widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer share sharing social "
    "related recommended recommendations newsletter subscribe signup login search skip toolbar disclaimer copyright".split()
)
#: First words of a class that says whether a page has such a part, not that it is one.
STATES = frozenset("has no not is with without hide show hidden after before".split())
#: An open element that the start of one of these ends.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr"}, "tbody": {"thead", "tbody", "tr"}, "body": {"head"}}
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("table ul ol dl article section div main body aside nav header footer form blockquote td th".split())

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<raw>script|style|xmp|noembed|noframes|plaintext|noscript|template|textarea|title)\b(?:[^<>"']++|"[^"]*"|'[^']*')*+>.*?(?:</(?P=raw)\s*+>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:_-]*+)(?P<attrs>(?:[^<>"']++|"[^"]*"|'[^']*')*+|[^>]*+)>""",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
SPLIT = re.compile(r"[_\-]+|(?<=[a-z])(?=[A-Z])")


def _attributes(attrs: str) -> tuple[str, str]:
    """The label's part of a tag, and its kind: "drop" if the element is never content, "comment" or "named" by its names."""
    key, kind = [], ""
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if name == "class":
                key.append(value)
            for token in value.split():
                words = [w.lower() for w in SPLIT.split(token) if w]
                if words and words[0] not in STATES and kind != "drop":
                    if any(w in COMMENTS for w in words):
                        kind = "comment"
                    elif any(w in NAMES for w in words):
                        kind = kind or "named"
        elif name == "role":
            if value.lower() in ROLES:
                kind = "drop"
        elif name == "hidden" and m[0].lower() == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            kind = "drop"
    return " ".join(key), kind


class Page:
    """A DOM tree as lists over its elements in document order; element 0 is the root.

    ``stop`` is the first element after a subtree, ``low`` and ``high`` bound its pieces of ``stream`` (text, with a space
    at every block's edge), ``sig`` tells subtrees by their texts (0: none), ``weight`` and ``linked`` count their
    characters, in all and in links, without dropped parts.
    """

    def __init__(self, html: str):
        self.tag: list[str] = []
        self.key: list[str] = []
        self.kind: list[str] = []
        self.parent: list[int] = []
        self.stop: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.sig: list[int] = []
        self.weight: list[int] = []
        self.linked: list[int] = []
        self.children: list[list[int]] = []
        self.stream: list[str] = []
        self._parts: list[list] = []
        self._stack: list[int] = []
        self._open: Counter[str] = Counter()
        self._start("#root", "", "")
        self._parse(html)
        self._close(0)
        del self._parts, self._stack, self._open

    def _start(self, tag: str, key: str, kind: str) -> None:
        i = len(self.tag)
        if tag not in INLINE:
            self.stream.append(" ")
        up = self._stack[-1] if self._stack else -1
        if i:
            self.children[up].append(i)
        for column, value in ((self.tag, tag), (self.key, key), (self.kind, kind), (self.parent, up), (self.stop, i + 1), (self.low, len(self.stream)), (self.high, len(self.stream)), (self.sig, 0), (self.weight, 0), (self.linked, 0), (self.children, []), (self._parts, [])):
            column.append(value)
        self._stack.append(i)
        self._open[tag] += 1

    def _close(self, depth: int) -> None:
        """Ends the open elements from ``depth`` on."""
        while len(self._stack) > depth:
            i = self._stack.pop()
            tag, parts_ = self.tag[i], self._parts[i]
            self._open[tag] -= 1
            self.stop[i], self.high[i] = len(self.tag), len(self.stream)
            if parts_:
                self.sig[i] = hash(tuple(parts_)) or 1
                self._parts[i] = []
            if tag == "a":
                self.linked[i] = self.weight[i]
            up = self.parent[i]
            if up >= 0 and self.kind[i] not in ("drop", "comment"):
                self.weight[up] += self.weight[i]
                self.linked[up] += self.linked[i]
            if up >= 0 and self.kind[i] != "drop" and self.sig[i]:
                self._parts[up].append(self.sig[i])
            if tag not in INLINE:
                self.stream.append(" ")

    def _text(self, text: str) -> None:
        if text:
            text = entities.unescape(text) if "&" in text else text
            self.stream.append(text)
            words = text.split()
            if words:
                i = self._stack[-1]
                self._parts[i].append(" ".join(words))
                self.weight[i] += sum(map(len, words))

    def _end(self, tags, scope=SCOPE) -> None:
        if any(self._open[t] for t in tags):
            for d in range(len(self._stack) - 1, 0, -1):
                tag = self.tag[self._stack[d]]
                if tag in tags:
                    return self._close(d)
                if tag in scope:
                    return

    def _parse(self, page: str) -> None:
        """Unclosed and stray tags are put right as browsers do, in short."""
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if m["cdata"]:
                    self._text(m["cdata"])
                continue
            tag = tag.lower()
            if m["end"]:
                if self._open[tag]:
                    for d in range(len(self._stack) - 1, 0, -1):
                        own = self.tag[self._stack[d]]
                        if own == tag:
                            self._close(d)
                            break
                        if tag in INLINE and own in SCOPE:
                            break
                continue
            if tag in ENDS_P:
                self._end({"p"})
            if tag in CLOSES:
                self._end(CLOSES[tag], SCOPE - {"td", "th"} if tag == "tr" else frozenset({"ul", "ol", "table", "dl", "select"}))
            attrs = m["attrs"]
            key, kind = _attributes(attrs) if "=" in attrs or "hidden" in attrs else ("", "")
            self._start(tag, key, "" if tag in ("html", "body", "article", "main") else "drop" if tag in DROP else kind)
            if tag in VOID or attrs.endswith("/"):
                self._close(len(self._stack) - 1)
        if at < len(page):
            rest = page[at:]
            self._text(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^<>]*\Z", rest) else rest)  # a tag that the page's end cuts off

    def slots(self, i: int) -> list[tuple[tuple[str, str], list[int]]]:
        """Children by label, runs of equal labels as one slot."""
        out: list = []
        for c in self.children[i]:
            if self.kind[c] != "drop":
                label = (self.tag[c], self.key[c])
                if out and out[-1][0] == label:
                    out[-1][1].append(c)
                else:
                    out.append((label, [c]))
        return out

    def outermost(self, i: int, tags: frozenset[str]) -> list[int]:
        """Elements below ``i`` with one of the tags, outside dropped parts and each other."""
        out, j = [], i + 1
        while j < self.stop[i]:
            if self.kind[j] in ("drop", "comment"):
                j = self.stop[j]
            elif self.tag[j] in tags:
                out.append(j)
                j = self.stop[j]
            else:
                j += 1
        return out


SLOTS, ARTICLES, HEADINGS = frozenset(("article", "main")), frozenset(("article",)), frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre li dt dd td th tr table ul ol dl figure figcaption br hr".split())


def _matched(x: list, y: list) -> list[tuple[int, int]]:
    """The largest order-preserving match of slots with equal labels, a slot counting as many nodes as both sides have."""
    n, m = len(x), len(y)
    a = 0
    while a < min(n, m) and x[a][0] == y[a][0]:
        a += 1
    z = 0
    while z < min(n, m) - a and x[n - 1 - z][0] == y[m - 1 - z][0]:
        z += 1
    pairs = [(i, i) for i in range(a)] + [(n - z + i, m - z + i) for i in range(z)]
    p, q = n - a - z, m - a - z
    if not p or not q:
        return pairs
    if p * q > PAIRS:
        places: dict = {}
        for j in range(m - z - 1, a - 1, -1):
            places.setdefault(y[j][0], []).append(j)
        last = a - 1
        for i in range(a, n - z):
            left = places.get(x[i][0], [])
            while left and left[-1] <= last:
                left.pop()
            if left:
                last = left.pop()
                pairs.append((i, last))
        return pairs
    size = [[0] * (q + 1) for _ in range(p + 1)]
    both = lambda i, j: min(len(x[a + i][1]), len(y[a + j][1])) if x[a + i][0] == y[a + j][0] else 0
    for i in range(p):
        for j in range(q):
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + both(i, j))
    i, j = p, q
    while i and j:
        if both(i - 1, j - 1) and size[i][j] == size[i - 1][j - 1] + both(i - 1, j - 1):
            i, j = i - 1, j - 1
            pairs.append((a + i, a + j))
        elif size[i - 1][j] >= size[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return pairs


def match(a: Page, b: Page) -> list[int]:
    """Simple tree matching from the roots on: the topmost elements of ``a`` whose partner in ``b`` has the same text."""
    same = []
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        x, y = a.slots(i), b.slots(j)
        for s, t in _matched(x, y):
            mine, theirs = x[s][1], y[t][1]
            texts, own = {b.sig[c] for c in theirs}, {a.sig[c] for c in mine}
            same += [c for c in mine if a.sig[c] and a.sig[c] in texts]
            left, right = [c for c in mine if a.sig[c] not in texts], [c for c in theirs if b.sig[c] not in own]
            if len(left) == len(right):
                todo += zip(left, right)
    return same


class Content:
    """A page's text, given the elements that are template."""

    def __init__(self, page: Page, seen: list[int] | None = None, partners: int = 0):
        self.page, self.partners = page, partners
        n = len(page.tag)
        masks = seen or [0] * n
        for i in range(1, n):
            masks[i] |= masks[page.parent[i]]
        # outside articles a template is what most partners have, in them what all of two or more have
        self.usual = [2 * m.bit_count() >= partners > 0 for m in masks]
        self.always = [m.bit_count() == partners > 1 for m in masks]

    def _level(self, i: int) -> int:
        """0 outside of any slot, 1 in a slot around its articles, 2 in an article, or in a main without any."""
        tag = self.page.tag[i]
        return 2 if tag == "article" or tag == "main" and not self.page.outermost(i, ARTICLES) else 1 if tag == "main" else 0

    def kept(self, slot: int, level: int, strict: bool = False) -> str:
        """The slot's text. Named parts go, but those that hold most of it; with ``strict``, paragraphs of articles that are template, too."""
        page = self.page
        stream, total = page.stream, page.weight[slot]
        levels = {slot: level}
        out: list[str] = []
        at, i = page.low[slot], slot + 1
        while i < page.stop[slot]:
            tag, kind, up = page.tag[i], page.kind[i], levels[page.parent[i]]
            levels[i] = own = max(up, self._level(i)) if tag in SLOTS else up
            inner = own > up or tag in INLINE
            template = self.always[i] and (strict or tag not in PARAGRAPHS) if up == 2 else self.usual[i]
            gone = kind == "drop" or template and not inner
            if kind in ("comment", "named") and not gone:
                most = 2 * page.weight[i] > total and 2 * page.linked[i] < page.weight[i]
                gone = not (most or page.outermost(i, SLOTS)) if kind == "named" else not page.outermost(i, SLOTS)
            if not gone and tag != "header":
                i += 1
                continue
            out += stream[at : page.low[i]]
            if not gone and own:
                for h in page.outermost(i, HEADINGS):
                    if own == 2 or not (self.usual[i] or self.usual[h]):
                        out += [" ", *stream[page.low[h] : page.high[h]], " "]
            at, i = page.high[i], page.stop[i]
        return " ".join("".join([*out, *stream[at : page.high[slot]]]).split())

    def text(self) -> str:
        """Of the content slot: the main or article element, of several the smallest element that holds them all; else the body."""
        page = self.page
        found = [i for i in page.outermost(0, SLOTS) if self.kept(i, 2)]
        if not found:
            body = page.outermost(0, frozenset(("body",)))
            return self.kept(body[0] if body else 0, 0)
        slot, level = found[0], self._level(found[0])
        if len(found) > 1:
            while not (slot < found[0] and page.stop[slot] > found[-1]):
                slot = page.parent[slot]
            level = 1
        whole, varying = self.kept(slot, level), self.kept(slot, level, True)
        # paragraphs shared with all partners are template, unless most of the text is: then the pages are near-copies
        return varying if 2 * len(varying) > len(whole) else whole


class Wrapper:
    """A host's references, each with its text, and the extraction of its pages against them."""

    def __init__(self):
        self.references: list[tuple[str, Page, str]] = []

    def add(self, html: str) -> None:
        if html and html not in (h for h, _, _ in self.references):
            page = Page(html)
            self.references.append((html, page, Content(page).text()))

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        page = Page(html)
        plain = Content(page).text()
        seen, partners = [0] * len(page.tag), 0
        total = max(1, page.weight[0])
        for other, tree, text in self.references:
            if other == html or text == plain:
                continue
            same = match(page, tree)
            if sum(page.weight[i] for i in same if page.kind[i] not in ("drop", "comment")) > (1 - VARYING) * total:
                continue
            for i in same:
                seen[i] |= 1 << partners
            partners += 1
        return Content(page, seen, partners).text() if partners else plain


def extract_group(pages: list[str], host: bool = True) -> list[str]:
    """Texts of pages of one host, the first REFERENCES different ones being its references; ``host`` False takes them as unrelated."""
    wrapper = Wrapper()
    for p in dict.fromkeys(pages) if host else ():
        if p and len(wrapper.references) < REFERENCES:
            wrapper.add(p)
    return [wrapper.extract(p) for p in pages]


def extract(pages: DataFrame, host: int = HOST) -> DataFrame:
    """All columns of ``pages`` but html, plus text (never null).

    A null or empty page gives an empty text. Pages whose url has no host are taken one by one, and so is a host's only
    page. A host with two pages of different text has a template: what both share. Copies and near-copies (see VARYING)
    are never each other's template. Rows repeat as they come, equal pages of a host have equal texts; columns named
    text are replaced, all others stay, whatever their names; an empty table gives no rows. Pages of any length, depth
    and breadth are walked without recursion, in time that grows with their elements.
    """
    given = Columns(pages, ("html", "text"))
    url = F.coalesce(given["url"].cast("string"), F.lit(""))
    name = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)).alias("host")
    size = parts(pages, per=PART_BYTES // 4)
    page = small_batches(given.rows).select(*given.kept(), given["html"].cast("string").alias("html"), name, F.shiftright(F.xxhash64(given["page_id"], given["url"], given["html"]), 20).alias("spread"))
    page = page.withColumn("h", F.xxhash64("html"))
    # distinct pages, by their hashes; of the large hosts (so many at most that their tables can be broadcast) the references
    distinct = written(page.groupBy("host", "h").agg(F.count(F.lit(1)).alias("k")), "page-hashes")
    large = distinct.filter("host <> ''").groupBy("host").agg(F.sum("k").alias("k")).filter(F.col("k") > host).orderBy(F.desc("k"), "host").limit(MOST_HOSTS)
    large = written(large.select("host", F.ceil(F.col("k") / host).cast("int").alias("cut")), "large-hosts")
    top = Window.partitionBy("host").orderBy("h")
    some = distinct.join(F.broadcast(large), "host").filter(~F.col("h").isin(F.xxhash64(F.lit("")), F.xxhash64(F.lit(None).cast("string"))))
    some = some.withColumn("at", F.row_number().over(top)).filter(F.col("at") <= REFERENCES).select("host", "h", "cut")
    texts = page.filter("html <> ''").select("host", "h", "html").join(F.broadcast(written(some, "references")), ["host", "h"])
    texts = texts.groupBy("host", "h", "cut").agg(F.min("html").alias("html"))
    own = page.join(F.broadcast(large), "host", "left").withColumn("part", F.pmod(F.col("spread"), F.coalesce("cut", F.lit(1))).cast("int"))
    kept = [f"c{i}" for i in given.own]
    sent = texts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    sent = sent.select(*[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in kept], "html", "host", "part", "h", F.lit(0).alias("own"))
    rows = own.select(*kept, "html", "host", "part", "h", F.lit(1).alias("own")).union(sent)
    dealt = rows.repartition(size, "host", "part").sortWithinPartitions("host", "part", "own", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, wrapper, sent_along = None, Wrapper(), False
        waiting: list[tuple[pa.RecordBatch, int, str | None]] = []  # rows read before their host's references were
        done: list[tuple[pa.RecordBatch, int, str]] = []
        last: tuple[str | None, str] = (None, "")

        def text(html: str | None) -> str:
            nonlocal last
            if html != last[0]:
                last = (html, wrapper.extract(html))
            return last[1] if html else ""

        def settle() -> None:
            nonlocal last
            last = (None, "")
            done.extend((b, i, text(html)) for b, i, html in waiting)
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            i = 0
            while i < len(done):
                j = i
                while j < len(done) and done[j][0] is done[i][0]:
                    j += 1
                batch = done[i][0].take(pa.array([r for _, r, _ in done[i:j]], pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([t for _, _, t in done[i:j]], pa.string())], [*kept, "text"])
                i = j
            done.clear()

        for batch in batches:
            columns = [batch.column(len(kept) + k).to_pylist() for k in (0, 1, 2, 4)]
            for i, (html, name, part, mine) in enumerate(zip(*columns)):
                if (name, part) != key:
                    settle()
                    key, wrapper, sent_along, last = (name, part), Wrapper(), False, (None, "")
                if not mine:
                    wrapper.add(html)
                    sent_along = True
                elif not name or sent_along or len(wrapper.references) == REFERENCES:
                    if waiting:
                        settle()
                    done.append((batch, i, text(html)))
                else:
                    wrapper.add(html)
                    waiting.append((batch, i, html))
            yield from out()
        settle()
        yield from out()

    schema = ", ".join([f"{c} {own.schema[c].dataType.simpleString()}" for c in kept] + ["text string"])
    return given.named(dealt.mapInArrow(run, schema), "text")
