"""Main text of web pages by removal of site templates.

Each page becomes the text blocks of its article and a list of element subtrees: the blocks that a subtree covers, and a
hash of its tags, classes and text (numbers count as alike). A subtree made of links has a second hash, of its shape
alone, as menus of one template often name other pages on every page. Spark counts each hash on the pages of its host;
subtrees that recur on many pages are template and their blocks go. What markup itself calls a menu, header, footer,
sidebar, notice, advert, form, script, style or comment goes on every page, however often it occurs.

Copies of one article on many pages are no template: a hash is counted once for each distinct main text beside it, the
article element and what holds it are never counted, and neither are paragraphs and headings inside an article.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from edaflux.llm.frames import slices, stored

# Element names of HTML, by how they are laid out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody"
    " td tfoot th thead title tr ul".split()
)
PARAGRAPHS = set("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre".split())
# Opening one of these ends an open element of the second kind, up to the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist", "optgroup")), "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
HEAD = set("base link meta noscript script style template title".split())  # what does not end the head
FENCES = set("body button caption html object table td template th".split())  # end tags inside don't close elements outside

# What markup calls furniture: elements, roles, and words of class and id.
FURNITURE = set(
    "aside button canvas datalist dialog embed footer form head iframe input menu nav noscript object script search select style"
    " svg template textarea".split()
)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
WORDS = set(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus"
    " footer login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion"
    " related respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
MAIN = {"article", "main"}

LEAST, SHARE = 5, 0.2
INSIDE = 0.5  # the share from which a subtree inside an article is template
SLICE = 1_000_000
_NUMBERS = re.compile(r"\d+")
_NAME = re.compile(r"[^a-z]+")


class Page(HTMLParser):
    """One pass over a page: blocks of text, and subtrees (hash, first block, end block, inside an article).

    An open element is [tag, is the page's main part, first block, parts of its hash, shape of its children, letters,
    letters in links, links]. Memory is that of the page.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.in_main: list[bool] = []
        self.subtrees: list[tuple[int, int, int, bool]] = []
        self.words: list[str] = []
        self.open: list[list] = [["", False, 0, [], [], 0, 0, 0]]
        self.skipped = 0  # depth of furniture
        self.mains = 0
        self.links = 0
        self.feed(html)
        if re.match("</?[A-Za-z]", self.rawdata):  # a tag cut off by the end of the page
            self.rawdata = ""
        self.close()
        self._flush()
        while len(self.open) > 1:
            self._pop()

    def _furniture(self, tag: str, attrs: list) -> bool:
        if tag in MAIN and not any(k in ("class", "id") and v for k, v in attrs):
            return False
        if tag in FURNITURE or (tag == "header" and not self.mains):
            return True
        if tag in ("html", "body"):
            return False
        for key, value in attrs:
            if value and key == "role" and value.strip().lower() in ROLES:
                return True
            if value and key in ("class", "id") and not WORDS.isdisjoint(_NAME.split(value.lower())):
                return True
        return False

    def _flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.blocks.append(text)
            self.in_main.append(self.mains > 0)
            top = self.open[-1]
            top[3].append(_NUMBERS.sub("0", text))
            top[4].append("t")
            top[5] += len(text) - text.count(" ")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skipped and not self._ends_furniture(tag):
            if tag not in VOID:
                self.open.append([tag, False, 0, None, None, 0, 0, 0])
                self.skipped += 1
            return
        if tag == "br":
            self.words.append(" ")
            return
        if tag in BLOCK:
            self._flush()
            self._close_implied(tag)
        if tag in VOID:
            return
        if self._furniture(tag, attrs):
            self.open.append([tag, False, 0, None, None, 0, 0, 0])
            self.skipped = 1
            return
        main = tag in MAIN or any(k == "role" and v and v.strip().lower() in MAIN for k, v in attrs)
        names = sorted(v for k, v in attrs if k in ("class", "role") and v)
        self.mains += main
        self.links += tag == "a"
        self.open.append([tag, main, len(self.blocks), [_NUMBERS.sub("0", " ".join([tag, *names]))], [], 0, 0, 0])

    def _ends_furniture(self, tag: str) -> bool:
        """Whether furniture whose end tag was left out ends where ``tag`` begins; if so, it is closed."""
        at = len(self.open) - self.skipped
        name = self.open[at][0]
        ended, fence = ENDS.get(tag, ((), ()))
        if name == "head":
            ends = tag not in HEAD
        else:
            ends = tag in BLOCK and (name == "p" or name in ended) and not any(o[0] in fence for o in self.open[at + 1 :])
        if ends:
            del self.open[at:]
            self.skipped = 0
        return ends

    def _close_implied(self, tag: str) -> None:
        ended, fence = ENDS.get(tag, ((), ()))
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == "p" or name in ended:
                while len(self.open) > at:
                    self._pop()
            elif name in fence or name in BLOCK:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            for at in range(len(self.open) - 1, len(self.open) - 1 - self.skipped, -1):
                if self.open[at][0] == tag:
                    self.skipped -= len(self.open) - at
                    del self.open[at:]
                    return
            # The end of an element around the furniture, which was left open, ends both; a stray end tag ends nothing.
            if tag not in BLOCK or not any(o[0] == tag for o in self.open[1 : len(self.open) - self.skipped]):
                return
            del self.open[len(self.open) - self.skipped :]
            self.skipped = 0
        if tag in BLOCK:
            self._flush()
        for at in range(len(self.open) - 1, 0, -1):
            name = self.open[at][0]
            if name == tag:
                while len(self.open) > at:
                    self._pop()
                return
            if name in FENCES if tag in BLOCK else name in BLOCK:
                return

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.words.append(data)
            if self.links:
                self.open[-1][6] += sum(map(len, data.split()))

    def _pop(self) -> None:
        if self.open[-1][3] is not None and (self.open[-1][0] in BLOCK or self.open[-1][1]):
            self._flush()
        tag, main, first, parts, shape, letters, linked, links = self.open.pop()
        if parts is None:
            self.skipped -= 1
            return
        up = self.open[-1]
        up[5] += letters
        up[6] += linked
        up[7] += links + (tag == "a")
        self.links -= tag == "a"
        self.mains -= main
        if tag not in BLOCK:
            up[3].extend(parts[1:])
            up[4].extend(shape)
            return
        # Children of one shape in a row count once, so that menus of any length are alike.
        kinds = [s for i, s in enumerate(shape) if not i or shape[i - 1] != s]
        digest = xxhash.xxh64_intdigest("\x00".join(parts), 11)
        outline = xxhash.xxh64_intdigest("\x00".join([parts[0], *kinds]), 13)
        up[3].append(str(digest))
        up[4].append(str(outline))
        inside = self.mains > 0
        if len(self.blocks) > first and not main and tag not in ("html", "body") and not (inside and tag in PARAGRAPHS):
            span = (first, len(self.blocks), inside)
            self.subtrees.append((digest - (1 << 63), *span))
            if links >= 3 and linked >= 0.8 * letters:
                self.subtrees.append((outline - (1 << 63), *span))


def parsed(html: str | None) -> tuple[list[str], list[tuple[int, int, int, bool]], int]:
    """(blocks, subtrees, hash of the main text). With an article or main element only what lies in it is text."""
    page = Page(html or "")
    if any(page.in_main):
        at, kept = [0], []
        for text, main in zip(page.blocks, page.in_main, strict=True):
            at.append(at[-1] + main)
            if main:
                kept.append(text)
        trees = [(h, at[a], at[z], inside) for h, a, z, inside in page.subtrees if at[z] > at[a] and inside]
    else:
        kept, trees = page.blocks, page.subtrees
    return kept, trees, xxhash.xxh64_intdigest("\x00".join(kept)) - (1 << 63)


_TREES = "struct<h:array<long>, inside:array<boolean>, first:array<int>, end:array<int>>"


def _parse(kind):
    def run(batches):
        out = to_arrow_schema(kind)
        for batch in batches:
            rows = {n: batch.column(n) for n in batch.schema.names}
            html = rows["html"].to_pylist()
            for a, z in slices(html, SLICE):
                pages = [parsed(h) for h in html[a:z]]
                trees = [{"h": [t[0] for t in p[1]], "inside": [t[3] for t in p[1]], "first": [t[1] for t in p[1]], "end": [t[2] for t in p[1]]} for p in pages]
                made = {"blocks": [p[0] for p in pages], "trees": trees, "body": [p[2] for p in pages]}
                columns = [pa.array(made[f.name], f.type) if f.name in made else rows[f.name].slice(a, z - a).cast(f.type) for f in out]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return run


def without(blocks: list[str], trees: dict, gone: set) -> str:
    """The text of blocks that no subtree of ``gone`` covers."""
    change = [0] * (len(blocks) + 1)
    for h, a, z in zip(trees["h"], trees["first"], trees["end"], strict=True):
        if h in gone:
            change[a] += 1
            change[z] -= 1
    out, depth = [], 0
    for text, c in zip(blocks, change, strict=False):
        depth += c
        if not depth:
            out.append(text)
    return " ".join(out)


def site_templates(pages: DataFrame, least: int = LEAST, share: float = SHARE, inside: float = INSIDE) -> DataFrame:
    """Rows (host, gone): the hashes of subtrees on at least ``least`` pages and ``share`` of the host's pages (``inside``
    an article that larger share), pages of one main text counting once.

    Both counts have a map-side part; a host of any size is counted by (host, hash, text), not in one task. As each hash
    of ``gone`` is on a fixed share of the pages, there are at most a page's mean subtrees divided by ``share`` of them.
    """
    sizes = pages.groupBy("host").agg(F.count_distinct("body").alias("pages")).where(F.col("pages") >= least)
    seen = pages.select("host", "body", F.explode(F.arrays_zip("trees.h", "trees.inside")).alias("t"))
    counts = seen.select("host", "body", "t.h", "t.inside").distinct().groupBy("host", "h", "inside").agg(F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= least)
    many = F.col("n") >= F.col("pages") * F.when(F.col("inside"), inside).otherwise(share)
    return counts.join(sizes, "host").where(many).groupBy("host").agg(F.collect_set("h").alias("gone"))


def page_texts(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, share: float = SHARE
) -> DataFrame:
    """Rows (key, url, text, n_chars), one for each input row: the page's main text without templates.

    White space inside a block becomes one space, blocks are joined by one space, character references are decoded.
    Null and empty pages, and pages of furniture alone, have an empty text; a null url is a host of its own. Pages that
    are cut off end where they end. Repeated rows stay, and count once as evidence. Other columns are not read. An empty
    table gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.col(html).alias("html"))
    kinds = dict(named.dtypes)
    kind = _parse_datatype_string(f"key {kinds['key']}, url {kinds['url']}, host string, body long, blocks array<string>, trees {_TREES}")
    read = stored(named.mapInArrow(_parse(kind), kind))
    templates = stored(site_templates(read, least, share))
    # A host's list is short (see above), so a count of hosts bounds what is sent to every executor.
    templates = F.broadcast(templates) if templates.limit(HOSTS + 1).count() <= HOSTS else templates
    out = _parse_datatype_string(f"{key} {kinds['key']}, url {kinds['url']}, text string, n_chars long")

    def run(batches):
        schema = to_arrow_schema(out)
        for batch in batches:
            for a, z in slices([""] * batch.num_rows, SLICE):
                part = batch.slice(a, z - a)
                rows = zip(*(part.column(c).to_pylist() for c in ("blocks", "trees", "gone")), strict=True)
                texts = [without(b, t, set(g or ())) for b, t, g in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").cast(schema.field(0).type), part.column("url").cast(schema.field(1).type), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    schema=schema,
                )

    joined = read.join(templates, "host", "left").select("key", "url", "blocks", "trees", "gone")
    return joined.mapInArrow(run, out)


HOSTS = 10_000
