"""HTML main text: markup rules, and removal of site templates found by counting subtrees per host.

Pages are parsed into elements. A hash of each block element's subtree (tags and text) is counted
over the pages of its host in Spark; a subtree that recurs beside more different remainders of pages
than chance lets one in CHANCE do, of the host's different pages, belongs to the site's template and
is deleted from every page. Copies of a page, or of an article, have one remainder: they count once.
What the markup itself declares not to be the article - navigation, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, comments - goes by tag, role and class; words that may mean
something else count only where most of the text is links. The main part is what holds most of the rest.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .url_filter import host_of

#: An article's part may stand on this share of a host's pages; one in CHANCE such parts may be taken for a template.
SHARED, CHANCE = 0.25, 10_000
#: The longest blocks that hold this share of a page's text tell it from others.
MASS = 0.9
#: Most hashes of templates that are broadcast: 8 MB.
BROADCAST_HASHES = 1_000_000

TOKEN = re.compile(
    r"<!--(?:-?>|.*?--!?>|.*\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|(?=>)))*+)>"
    r"|<[!?/][^>]*>"
    r"|<[A-Za-z/!?].*\Z",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")

# Element and class names with a meaning.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside audio canvas datalist embed footer form head header iframe input map menu nav noscript object option script select style svg template textarea title video".split())
CLASSES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: What may stand beside those in a class of several words without changing its meaning.
BESIDE = frozenset(
    "area bar block body bottom box button buttons center col column container content desktop fixed float form global group header holder icon icons inner item items label left "
    "link links list main mobile module page panel post posts primary reader readers region right row secondary section site slot sticky text thread title top unit user users wrap wrapper".split()
)
#: Of the words above those that count by themselves only where most of the text is links.
WEAK = frozenset("banner login overlay promo promotion related replies reply respond search share sharing signup skip social subscribe subscription toolbar widget".split())
#: Elements that hold text rather than parts of a page: of single words only adverts and notices count for them.
TEXTUAL = frozenset("p pre blockquote table tr td th dl dt dd figure figcaption h1 h2 h3 h4 h5 h6".split())
NOTED = frozenset("ad ads advert adverts advertisement advertisements advertising adsbygoogle consent cookie cookies gdpr sponsored".split())
#: What readers wrote, whatever elements it consists of.
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
#: An article or main element goes only by these.
READERS = frozenset("ad ads advert advertisement comment comments disqus promo related reply sponsored".split())
#: An opening tag ends an open element of these, up to the element named.
ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table"))}
P_SCOPE = frozenset("table td th caption button object html".split())
BREAK = -1


class Page:
    """Elements in the order they open, and the texts between with the element they stand in."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attrs, self.hashes, self.wordy = ["#root"], [0], [""], [0], [False]
        self.last = [0]  # the last element within each
        self.items: list[tuple[int, str]] = []  # (element, text); (BREAK, "") where a block starts or ends
        self._parts: list[list[bytes]] = [[]]
        self._stack = [0]
        self._depths: dict[str, list[int]] = {}  # where in the stack elements of a tag are open
        self._blocks = [0]  # where in it block elements are open
        self._parse(html)

    def _open(self, tag: str, attrs: str) -> None:
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.attrs.append(attrs)
        self.hashes.append(0)
        self.wordy.append(False)
        self.last.append(0)
        self._parts.append([])
        self._depths.setdefault(tag, []).append(len(self._stack))
        if tag in BLOCK:
            self._blocks.append(len(self._stack))
        self._stack.append(len(self.tags) - 1)

    def _close(self) -> None:
        i = self._stack.pop()
        self._depths[self.tags[i]].pop()
        if self._blocks[-1] == len(self._stack):
            self._blocks.pop()
        self.last[i] = len(self.tags) - 1
        h = xxhash.xxh64(self.tags[i].encode() + b"\1" + b"\2".join(self._parts[i]))
        self._parts[i] = []
        self.hashes[i] = h.intdigest() - (1 << 63)
        up = self._stack[-1]
        self._parts[up].append(h.digest())
        self.wordy[up] = self.wordy[up] or self.wordy[i]
        if self.tags[i] in BLOCK:
            self.items.append((BREAK, ""))

    def _deepest(self, names) -> int:
        """The place in the stack of the innermost open element of these names; 0 if there is none."""
        return max((d[-1] for n in names if (d := self._depths.get(n))), default=0)

    def _end_above(self, names: tuple[str, ...], stop) -> None:
        at = self._deepest(names)
        if at > self._deepest(stop):
            while len(self._stack) > at:
                self._close()

    def _text(self, text: str) -> None:
        if "&" in text:
            text = entities.unescape(text)
        i = self._stack[-1]
        self.items.append((i, text))
        if flat := " ".join(text.split()):
            self.wordy[i] = True
            self._parts[i].append(flat.encode("utf-8", "replace"))

    def _parse(self, html: str) -> None:
        pos, search = 0, TOKEN.search
        while m := search(html, pos):
            if m.start() > pos:
                self._text(html[pos : m.start()])
            pos = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end_tag(tag)
                continue
            if tag in BLOCK:
                self._end_above(("p",), P_SCOPE)
                self.items.append((BREAK, ""))
            if tag in ENDS:
                self._end_above(*ENDS[tag])
            if tag in VOID:
                if tag == "br":
                    self.items.append((self._stack[-1], " "))
                continue
            self._open(tag, m[3])
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, pos)
                pos = end.end() if end else len(html)
                self._close()
        if pos < len(html):
            self._text(html[pos:])
        while len(self._stack) > 1:
            self._close()

    def _end_tag(self, tag: str) -> None:
        at = self._deepest((tag,))
        if at and (tag in BLOCK or at > self._blocks[-1]):
            while len(self._stack) > at:
                self._close()
        elif tag in BLOCK:
            self.items.append((BREAK, ""))

    def _masses(self) -> tuple[list[int], list[int]]:
        """The characters that stand in each element itself, outside of links and inside."""
        n = len(self.tags)
        linked, plain, links = [False] * n, [0] * n, [0] * n
        for i in range(1, n):
            linked[i] = linked[self.parents[i]] or self.tags[i] in ("a", "button", "label")
        for i, text in self.items:
            if i != BREAK:
                (links if linked[i] else plain)[i] += len(text) - text.count(" ")
        return plain, links

    def _with_inner(self, own: list[int]) -> list[int]:
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parents[i]] += out[i]
        return out

    def scope(self) -> tuple[list[bool], list[bool]]:
        """For each element: whether it is dropped by the markup's own word, and whether it lies in the main part."""
        n = len(self.tags)
        named = [self._names(a) if a else frozenset() for a in self.attrs]
        holds, within = [False] * n, [False] * n  # an article or main element lies in it, or around it
        for i in range(n - 1, 0, -1):
            if holds[i] or self.tags[i] in ("article", "main"):
                holds[self.parents[i]] = True
        for i in range(1, n):
            within[i] = within[self.parents[i]] or self.tags[self.parents[i]] in ("article", "main")
        plain, links = self._masses()
        mostly_links = [b > 0 and b >= a for a, b in zip(self._with_inner(plain), self._with_inner(links), strict=True)]
        for comments in (True, False):
            dropped = [False] * n
            for i in range(1, n):
                dropped[i] = dropped[self.parents[i]] or self._goes(self.tags[i], named[i], holds[i], within[i], mostly_links[i], comments)
            # where nothing else is left, what looks like comments is the page
            if any(p + x for p, x, d in zip(plain, links, dropped, strict=True) if not d):
                break
        kept = self._with_inner([0 if d else 10 * p + x for p, x, d in zip(plain, links, dropped, strict=True)])
        chosen: set[int] = set()
        for part in ("article", "main"):
            of = [i for i in range(1, n) if (self.tags[i] == part or part == "main" and "role:main" in named[i]) and not dropped[i] and kept[i]]
            inner = set(of)
            outermost, covered = 0, [False] * n
            for i in range(1, n):
                covered[i] = covered[self.parents[i]] or self.parents[i] in inner
                outermost += kept[i] if i in inner and not covered[i] else 0
            if 2 * outermost >= max(1, kept[0]):
                chosen = inner
                break
        inside = [not chosen] + [False] * (n - 1)
        for i in range(1, n):
            inside[i] = inside[self.parents[i]] or i in chosen
        return dropped, inside

    @staticmethod
    def _names(attrs: str) -> frozenset[str]:
        out: set[str] = set()
        for m in ATTRIBUTE.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                out.update(" ".join(WORDS.findall(CAMEL.sub(" ", x).lower())) for x in entities.unescape(value).split())
            elif key == "role":
                out.add("role:" + value.strip().lower())
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                out.add("#hidden")
        return frozenset(out)

    @staticmethod
    def _goes(tag: str, names: frozenset[str], holds: bool, within: bool, mostly_links: bool, comments: bool) -> bool:
        if tag in ("html", "body"):
            return False
        if comments and tag not in TEXTUAL and _means(names, COMMENTS):
            return True
        if tag in ("article", "main"):
            return "#hidden" in names or _means(names, READERS)
        if tag in DROPPED:
            return not (holds and tag in ("form", "header"))
        if holds:
            return False
        if "#hidden" in names or tag == "dialog" and not within or any(x[5:] in ROLES for x in names if x.startswith("role:")):
            return True
        words = CLASSES if comments else CLASSES - COMMENTS
        return _means(names, words, NOTED if tag in TEXTUAL else words if mostly_links else words - WEAK)

    def blocks(self, dropped: list[bool], inside: list[bool]) -> list[tuple[int, str]]:
        """The kept blocks: the element where each starts, and its text with single spaces."""
        out: list[tuple[int, str]] = []
        run: list[str] = []
        at = 0
        for i, text in [*self.items, (BREAK, "")]:
            if i == BREAK:
                if run and (block := " ".join("".join(run).split())):
                    out.append((at, block))
                run = []
            elif inside[i] and not dropped[i]:
                if not run:
                    at = i
                run.append(text)
        return out

    def subtrees(self) -> tuple[int, list[tuple[int, int]]]:
        """The page's own digest; and each hash of the block elements with text that the markup keeps, with a digest of what stands beside it.

        A digest is a sum of the hashes of blocks: of the longest ones, that hold MASS of the page's
        text, so that pages which differ in a date or a counter are alike; of all where those all
        stand in the subtree.
        """
        dropped, inside = self.scope()
        blocks = sorted((at, len(b), xxhash.xxh64_intdigest(b.encode("utf-8", "replace"))) for at, b in self.blocks(dropped, inside))
        least, held, whole = 0, 0, sum(n for _, n, _ in blocks)
        for n in sorted((n for _, n, _ in blocks), reverse=True):
            if held >= MASS * whole:
                break
            least, held = n, held + n
        places, long, every = [at for at, _, _ in blocks], [0], [0]
        for _, n, h in blocks:
            long.append(long[-1] + (h if n >= least else 0))
            every.append(every[-1] + h)
        signed = lambda x: (x & (1 << 64) - 1) - (1 << 63)
        out: dict[int, int] = {}
        for i in range(1, len(self.tags)):
            if inside[i] and not dropped[i] and self.wordy[i] and self.tags[i] in BLOCK and self.tags[i] not in ("html", "body", "article", "main"):
                a, z = bisect_left(places, i), bisect_right(places, self.last[i])
                beside = long[-1] - long[z] + long[a] or every[-1] - every[z] + every[a]
                out.setdefault(self.hashes[i], signed(beside))
        return signed(long[-1]), sorted(out.items())

    def text(self, template: frozenset[int] = frozenset()) -> str:
        """The kept blocks, each with single spaces, joined by line ends."""
        dropped, inside = self.scope()
        if template:
            for i in range(1, len(self.tags)):
                dropped[i] = dropped[i] or dropped[self.parents[i]] or self.tags[i] in BLOCK and self.hashes[i] in template
        return "\n".join(b for _, b in self.blocks(dropped, inside))


def _means(names: frozenset[str], words: frozenset[str], single: frozenset[str] | None = None) -> bool:
    """Whether a class is one of words (or of single, if given), or a compound of words with nothing that gives it another meaning."""
    alone = words if single is None else single
    return any(x in alone or " " in x and (parts := x.split()) and words.intersection(parts) and all(p in words or p in BESIDE or p.isdigit() for p in parts) for x in names)


def least_pages() -> int:
    """The pages of the smallest host that can have a template, one on all of them."""
    return next(n for n in range(1, 1000) if n * math.log(1 / SHARED) >= math.log(CHANCE))


def recurs(n: Column, pages: Column) -> Column:
    """Whether a subtree on n of a host's pages is a template: parts that stand on SHARED of all pages reach n with a chance below 1 / CHANCE, by Chernoff's bound."""
    share = n / pages
    rest = F.when(n < pages, (1 - share) * F.log((1 - share) / (1 - SHARED))).otherwise(0.0)
    return (share > SHARED) & (pages * (share * F.log(share / SHARED) + rest) >= math.log(CHANCE))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id_col, url_col, text) of every row of pages, from its whole html.

    Null and empty pages, and pages without main text, have the empty text. Pages without a host
    (null URL) count as pages of the empty host. Broken markup is read as browsers do for open
    elements, unfinished tags, quotes and character references. Rows that repeat are extracted
    alike and count once for templates, as do pages whose long blocks are equal. Very long pages
    are read whole; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [Page(h).subtrees() for h in pdf["html"]]
            yield pd.DataFrame({"host": pdf["host"], "page": [p for p, _ in found], "subtrees": [[{"h": h, "beside": b} for h, b in x] for _, x in found]})

    found = base.select("host", "html").mapInPandas(hashes, "host string, page long, subtrees array<struct<h:long,beside:long>>")
    # the host's different pages are counted along, as one more subtree of each page
    own = F.array(F.struct(F.lit(None).cast("long").alias("h"), F.col("page").alias("beside")))
    beside = found.select("host", F.explode(F.concat(own, "subtrees")).alias("x")).select("host", "x.h", "x.beside")
    counted = cut(beside.distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages()))
    of_host = counted.where("h IS NULL").select("host", F.col("n").alias("pages"))
    recurring = counted.where("h IS NOT NULL").join(of_host, "host").where(recurs(F.col("n"), F.col("pages")))
    # what recurs on a share of the pages is at most the mean number of a page's blocks over that share
    templates = cut(recurring.groupBy("host").agg(F.collect_list("h").alias("template")))
    total = templates.agg(F.sum(F.size("template"))).first()[0] or 0

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [Page(h).text(frozenset(() if t is None else map(int, t))) for h, t in zip(pdf["html"], pdf["template"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": out})

    joined = base.join(F.broadcast(templates) if total <= BROADCAST_HASHES else templates, "host", "left").select("id", "url", "html", "template")
    return joined.mapInPandas(texts, f"id {kind}, url string, text string").toDF(id_col, url_col, "text")
