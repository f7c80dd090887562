"""Main text of web pages by consensus host paths.

Pass 1 parses each page once into blocks of text, each with the generalised path of its element
(tags and classes from the body down, without digits), scores the containers (text that is not in
links, by paragraphs, with a share for the parent) and names the best one by its path. Spark
counts, for each host, how many pages chose each path. The same blocks vote on what repeats: a
path below the winning one that carries a class, whose text is the same on many different pages
of the host and which holds little of the host's text, is boilerplate. Pass 2 goes over the parsed
blocks and extracts from the containers on the host's paths, best voted first, without the
boilerplate paths; a page that has none of the host's paths uses its own best container.

Elements are left out by what they are (nav, footer, form, ...), by hidden and role, and by class
and id as a prior only: a name counts if all its words are names of furniture (`sidebar-left`, not
`side-by-side`). Furniture that need not be furniture is kept after all where it holds most of the
page's text in paragraphs; what is named as an advertisement or comments only where it holds all
paragraphs of the page, two at least.

A page takes time and memory in proportion to its length, however deep or unclosed its markup is: open
elements are found by name, and a path names the outermost DEPTH steps, as browsers bound the depth of
a page too; deeper containers share the path of the one at that depth.

Scale: pages are parsed once; the blocks are written, smaller than the pages, and read as columns.
Pages are never grouped by host: votes are (host, path) counts, partially aggregated, so a host
with a third of all pages costs no more than its number of paths. The chosen paths (PATHS a host)
are a written table; the planner broadcasts it by its known size or joins by host, where AQE splits
a large host.

Defined results: null html is empty and gives empty text; a page without markup is one block;
a line break ends a block; all Unicode white space counts as white space; an element that may not
run to the end of the page (button, select, svg, ...) and is not closed ends at the next block;
fallback text of audio and video is a notice; pages with a null or odd url share one host;
repeated rows give repeated results; an empty table gives an empty result; only the named columns
are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import written

#: Paths kept for each host.
PATHS = 3
#: A text repeats if it stands on so many different pages of a host, and on this share of them;
#: a path is boilerplate if this share of its characters repeats and it holds at most this share of the host's text.
REPEAT_PAGES = 5
REPEAT_SHARE = 0.3
PATH_REPEATS = 0.8
PATH_TEXT = 0.2

#: Steps of a path.
DEPTH = 128
#: Bytes of pages that are parsed at once.
SLICE_BYTES = 1 << 20

#: Element names by what they do to text.
RAW = "script|style|textarea|title|xmp|noembed|noframes"
SKIPPED = frozenset("noscript template iframe svg audio video select button annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOISE_TAGS = frozenset("nav footer aside form menu dialog fieldset header".split())
BLOCK_TAGS = frozenset(
    "p div article section main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th tbody thead tfoot caption pre blockquote "
    "figure hr address details summary center br nav footer aside form menu dialog fieldset figcaption header".split()
)
CONTAINERS = frozenset("html body main article section div td table center blockquote ul ol dl figure details nav footer aside form menu dialog fieldset header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Which open elements a start tag closes, and the elements that this doesn't reach beyond.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: Words of names of page furniture; NEVER are seldom the article, NEUTRAL may stand beside either.
NEVER = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion comment comments disqus reply replies respond cookie cookies consent newsletter".split())
FURNITURE = NEVER | frozenset(
    "banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar side aside footer foot header masthead notice notices alert alerts popup modal overlay "
    "subscribe subscription signup login share sharing social related recommended recommendations toolbar pagination pager copyright legal skip widget widgets".split()
)
NEUTRAL = frozenset(
    "site page main top bottom left right box block blocks list lists item items wrapper wrap container inner outer area section region bar link links button buttons text primary "
    "secondary global col column row content post posts article articles story stories entry title form icon icons count counts js the a in of to form thread bottom sticky fixed mobile desktop".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar menuitem toolbar alert alertdialog dialog form".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*|[^<>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|$))", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NONE = re.compile(r"display\s*:\s*none", re.I)


@dataclass
class Box:
    """A container: its place in the tree, its path, and what it holds."""

    tag: str
    parent: int
    path: str
    name: str = ""
    score: float = 0.0
    own: float = 0.0
    links: int = 0
    chars: int = 0


@dataclass
class Page:
    boxes: list[Box] = field(default_factory=lambda: [Box("html", -1, "")])
    #: (container, path, text) in page order.
    blocks: list[tuple[int, str, str]] = field(default_factory=list)

    def text(self, path: str | None) -> str:
        """The text below a path, all text for None."""
        return "\n".join(text for _, own, text in self.blocks if path is None or f"{own}>".startswith(f"{path}>"))


@lru_cache(1 << 14)
def _attributes(text: str) -> tuple[str, bool, bool, bool]:
    """Classes as a step of a path, and whether the element is never text, is furniture by its names, is a comment or advertisement."""
    step, gone, weak, never = "", False, False, False
    for name, *values in _ATTRIBUTE.findall(text):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value) or name == "role" and value.lower() in ROLES:
            gone = True
        elif name in ("class", "id"):
            for own in value.split():
                words = _NAME.findall(_CAMEL.sub("-", own).lower())
                if words and all(w in FURNITURE or w in NEUTRAL for w in words):
                    weak = weak or any(w in FURNITURE for w in words)
                    never = never or any(w in NEVER for w in words)
            if name == "class":
                step = "".join(f".{c}" for c in sorted({re.sub(r"[\d_-]+$|\d+", "", c) for c in value.lower().split()} - {""}))
    return step, gone, weak, never


def _ends(text: str, tag: str) -> dict[int, int]:
    """End of each element of a name that is closed, by the place where it begins."""
    found, open_ = {}, []
    for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^<>]*>?", text, re.I):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.end()
    return found


#: One open element: its name, container, path, whether it is left out, the innermost container around it that a prior
#: would leave out (-1: none), its depth in blocks, and the place of the innermost block on the stack.
Open = tuple[str, int, str, bool, int, int, int]
#: A block: its container, path, text, characters in links, whether it is a heading, and that innermost container.
Found = tuple[int, str, str, int, bool, int]


def parse(text: str | None) -> Page:
    """Blocks and containers of a page, with the containers' scores."""
    page, text, at = Page(), text or "", 0
    stack: list[Open] = [("html", 0, "", False, -1, 0, 0)]
    places: dict[str, list[int]] = defaultdict(list, html=[0])  # of the open elements of a name
    paths: dict[tuple[str, str], str] = {}
    strong: set[int] = set()  # containers named as advertisements or comments
    ends: dict[str, dict[int, int]] = {}
    parts: list[str] = []
    found: list[Found] = []
    links = in_link = 0
    heading = until_block = False
    skip_to = 0

    def flush() -> None:
        nonlocal links
        value = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        if value:
            _, box, path, _, flag, _, _ = stack[stack[-1][6]]
            found.append((box, path, value, min(links, len(value)), heading, flag))
        links = 0

    def last(names: set[str] | frozenset[str]) -> int:
        """Place of the innermost open element of these names, 0 if there is none but the root."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def pop(names: set[str], barrier: set[str] | frozenset[str]) -> None:
        k = last(names)
        if k and k >= (stack[-1][6] if barrier is BLOCK_TAGS else last(barrier)):
            for e in stack[k:]:
                places[e[0]].pop()
            del stack[k:]

    def add(piece: str) -> None:
        nonlocal links
        if not stack[-1][3] and not until_block:
            parts.append(piece)
            if in_link:
                links += len(piece.strip())

    for m in _TOKEN.finditer(text):
        if m.start() < skip_to:
            continue
        at = max(at, skip_to)
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        if not (name := m[3]):
            if m[1]:
                add(" ")
            continue
        tag, closing, self_closed = name.lower(), m[2] == "/", m[4].rstrip().endswith("/")
        if tag in SKIPPED:
            if not closing and not self_closed:
                if tag not in ends:
                    ends[tag] = _ends(text, tag)
                if m.start() in ends[tag]:
                    skip_to = ends[tag][m.start()]
                else:
                    until_block = True
            continue
        is_block = tag in BLOCK_TAGS
        if is_block:
            flush()
            until_block = False
            if tag in HEADINGS:
                heading = not closing
            elif tag != "br":
                heading = False
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in VOID or tag == "html":
            continue
        if closing:
            if tag in CONTAINERS:
                in_link = 0
            pop({tag}, frozenset() if is_block else BLOCK_TAGS)
            continue
        if is_block:
            pop({"p"}, CONTAINERS)
            if tag in CLOSES:
                pop(*CLOSES[tag])
        if self_closed and not is_block or tag == "body" and bool(places.get("body")):
            continue
        above = stack[-1]
        step, gone, weak, never = _attributes(m[4]) if m[4] else ("", False, False, False)
        if tag in ("body", "main", "article"):
            weak = never
        out = above[3] or gone or tag in NOISE_TAGS and tag not in ("form", "header")
        if tag == "header" and not out:
            weak = weak or not (places.get("article") or places.get("main"))
        weak = weak or tag == "form"
        box, path, flag, depth = above[1], above[2], above[4], above[5]
        if is_block:
            if depth < DEPTH:
                path = paths.setdefault((path, f"{tag}{step}"), f"{path}>{tag}{step}")
            depth += 1
        if tag in CONTAINERS:
            in_link = 0
            page.boxes.append(Box(tag, box, path, f"{tag}{step}"))
            box = len(page.boxes) - 1
            if weak:
                flag = box
                if never or above[4] in strong:
                    strong.add(box)
        else:
            out = out or weak
        places[tag].append(len(stack))
        stack.append((tag, box, path, out, flag, depth, len(stack) if is_block else above[6]))
    at = max(at, skip_to)
    if at < len(text):
        rest = text[at:]
        add(rest[: rest.rfind("<")] if re.search(r"<[a-zA-Z/!][^<>]*\Z", rest) else rest)
    flush()
    _score(page, found, strong)
    return page


def _score(page: Page, found: list[Found], strong: set[int]) -> None:
    """Keep what is not furniture and add up the containers' scores."""
    plain = paragraphs = 0
    held: dict[int, tuple[int, int]] = {}
    for _, _, value, links, _, flag in found:
        own = len(value) - links
        if flag >= 0:
            chars, n = held.get(flag, (0, 0))
            held[flag] = chars + own, n + (own >= 40)
        else:
            plain, paragraphs = plain + own, paragraphs + (own >= 40)
    kept = {flag for flag, (chars, n) in held.items() if flag not in strong and chars > 2 * plain and n >= 3}
    if not paragraphs and not kept:
        kept = {flag for flag, (_, n) in held.items() if n >= 2 and n == sum(k for _, k in held.values())}
    in_article, in_header = [], []  # of each container: in an article; in a header that is in one
    for box in page.boxes:
        above = box.parent >= 0 and in_article[box.parent]
        in_article.append(above or box.tag in ("article", "main"))
        in_header.append(above if box.tag == "header" else box.parent >= 0 and in_header[box.parent])
    for box, path, value, links, heading, flag in found:
        titled = heading and flag >= 0 and "header" in page.boxes[flag].name and in_article[flag]
        if flag >= 0 and flag not in kept and not titled:
            continue
        if in_header[box] and not heading:
            continue
        page.blocks.append((box, path, value))
        node = page.boxes[box]
        node.links += links
        node.chars += len(value)
        node.own += max(0, len(value) - 2 * links) * (1.0 if len(value) >= 25 or heading else 0.3)
    for k in range(len(page.boxes) - 1, -1, -1):
        box = page.boxes[k]
        weight = {"article": 1.5, "main": 1.4}.get(box.tag, 1.0)
        box.score = (box.score + box.own) * (1.0 - box.links / max(1, box.chars)) * weight
        if box.parent >= 0:
            page.boxes[box.parent].score += box.score / weight * 0.6


def best_path(page: Page) -> str | None:
    """Path of the container with the highest score, None where no text counts."""
    score, _, path = max(((b.score, -k, b.path) for k, b in enumerate(page.boxes)), default=(0.0, 0, ""))
    return path if score > 0 else None


def main_text(page: Page) -> str:
    """Text of a page by itself, without a host."""
    return page.text(best_path(page))


def host_of(url: str):
    """Column: the host of a url, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: key, url, host, best (path of its best container) and blocks (path, text)."""
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html).alias("html"))
    kind = rows.schema["key"].dataType.simpleString()
    block = pa.struct([("path", pa.string()), ("text", pa.string())])

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, texts in bytescan.slices(batch.column("html"), SLICE_BYTES):
                found = [parse(t) for t in texts]
                blocks = [[{"path": p, "text": t} for _, p, t in page.blocks] for page in found]
                columns = [*(batch.column(c).slice(a, b - a) for c in ("key", "url", "host")), pa.array(map(best_path, found), pa.string()), pa.array(blocks, pa.list_(block))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "url", "host", "best", "blocks"])

    return rows.mapInArrow(bytescan.tidy(scan), f"key {kind}, url string, host string, best string, blocks array<struct<path:string,text:string>>")


def _below(path: Column, top: Column) -> Column:
    return F.startswith(F.concat(path, F.lit(">")), F.concat(top, F.lit(">")))


def host_paths(rows: DataFrame) -> DataFrame:
    """(host, paths): the most voted container paths of each host, most votes first; rows as of `parsed`."""
    votes = rows.where(F.col("best").isNotNull()).groupBy("host", "best").count()
    place = F.row_number().over(Window.partitionBy("host").orderBy(F.col("count").desc(), "best"))
    top = votes.withColumn("place", place).where(F.col("place") <= PATHS)
    return top.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "best"))), lambda x: x["best"]).alias("paths"))


def boilerplate_paths(rows: DataFrame) -> DataFrame:
    """(host, gone): paths with a class, below the winning ones, whose text is the same on many different pages of the host."""
    own = rows.where(F.col("best").isNotNull()).select("host", "best", F.filter("blocks", lambda b: _below(b["path"], F.col("best"))).alias("blocks"))
    own = own.select("host", "best", "blocks", F.xxhash64(F.transform("blocks", lambda b: b["text"])).alias("page"))
    classed = lambda b: F.contains(F.substring(b["path"], F.length("best") + 1, F.length(b["path"])), F.lit("."))
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    hosts = own.groupBy("host", "page").agg(F.max(chars).alias("chars")).groupBy("host").agg(F.count("*").alias("pages"), F.sum("chars").alias("host_chars"))
    texts = own.select("host", "page", F.explode(F.filter("blocks", classed)).alias("b"))
    texts = texts.select("host", "page", "b.path", F.xxhash64("b.text").alias("text"), F.length("b.text").cast("long").alias("chars")).distinct()
    texts = texts.groupBy("host", "path", "text").agg(F.count("*").alias("on"), F.sum("chars").alias("chars"))
    texts = texts.join(hosts, "host")
    again = F.when((F.col("on") >= REPEAT_PAGES) & (F.col("on") >= REPEAT_SHARE * F.col("pages")), F.col("chars")).otherwise(0)
    paths = texts.groupBy("host", "path").agg(F.sum(again).alias("again"), F.sum("chars").alias("chars"), F.max("host_chars").alias("host_chars"))
    paths = paths.where((F.col("again") > 0) & (F.col("again") >= PATH_REPEATS * F.col("chars")) & (F.col("chars") <= PATH_TEXT * F.col("host_chars")))
    return paths.groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("gone"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: key, url, text, path (the container path used)."""
    rows = written(parsed(pages, url=url, html=html, key=key), "page-blocks")
    chosen = host_paths(rows).join(boilerplate_paths(rows), "host", "left").select(F.col("host").alias("of_host"), "paths", "gone")
    rows = rows.join(written(chosen, "host-paths"), F.col("host") == F.col("of_host"), "left")
    none = F.array().cast("array<string>")
    tops = F.concat(F.coalesce("paths", none), F.when(F.col("best").isNotNull(), F.array("best")).otherwise(none))
    first = F.get(F.filter(tops, lambda p: F.exists("blocks", lambda b: _below(b["path"], p))), F.lit(0))
    rows = rows.select("key", "url", "blocks", first.alias("path"), F.coalesce("gone", none).alias("gone"))
    own = F.filter("blocks", lambda b: (F.col("path").isNull() | _below(b["path"], F.col("path"))) & ~F.exists("gone", lambda g: _below(b["path"], g)))
    return rows.select("key", "url", F.array_join(F.transform(own, lambda b: b["text"]), "\n").alias("text"), "path")
