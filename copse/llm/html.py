"""Main text of web pages by consensus host paths.

Pages of one host share a layout. On each page every container is scored by the text it holds outside menus, headers,
footers, sidebars, notices, adverts, forms and comments; containers are named by their path of tags and classes, with
digits generalised. Spark adds up the scores by host and path, the path with most support wins its host, and each page
is extracted again from the containers on the winning path; a page that has no text there falls back to its own best.

Inside a container, text is cut into blocks at block-level tags; boilerplate containers inside it are left out. In a
block, character references are decoded, white space becomes one blank and ends are trimmed; blocks are joined by a line
feed in the order of the page. A winning path is first widened to the outermost article, main element or content
container above it, so titles, leads and sections beside the part with most text stay.

A page is parsed once, in time and memory linear in its length, however tags are nested or left open: its blocks and
containers are stored, votes are added up from the table, and the second extraction picks from the stored blocks. Votes are
whole numbers, a million a page, so their sums don't depend on how pages are dealt. Beyond LONG characters, the beginning
of a path is written as its digest.

Defined results: null and empty pages give an empty text; broken or unclosed markup is read as far as it goes; pages
without a host (null url) vote together as host ''; equal votes go to the deeper path, then to the greater one; repeated
rows give repeated results; an empty table gives an empty result. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm.common import materialise, read, ship
from copse.llm.urlfilter import parts

_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?]")
_TAG_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-a-zA-Z0-9_:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"\s+")
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold main text.
SKIPPED = frozenset("script style head title noscript template svg math canvas object iframe nav footer aside form button select textarea option label dialog menu fieldset noembed noframes xmp audio video".split())
#: Elements that end a block of text.
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre hr figure figcaption address details summary header footer nav aside form center hgroup".split())
#: Elements that can be the container of a page's main text.
CONTAINERS = frozenset("body main article section div td center".split())
#: What an open element ends when it begins.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = BLOCKS - {"p", "li", "dt", "dd", "tr", "td", "th", "html", "body", "thead", "tbody", "tfoot", "caption", "summary"}
#: Words in a class, id or role that mark boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs "
    "header masthead footer foot sidebar sidebars side rail widget widgets aside cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay "
    "comment comments respond disqus replies share sharing social related recommended recommendations newsletter subscribe subscription signup login search form pagination pager toolbar skip complementary contentinfo dialog toc tags".split()
)
#: Words that mark a main container, whatever else its class says.
MAIN = frozenset("article main content post entry story body text".split())
#: Those that name the container of a whole article when they end a class.
_CONTENT = frozenset("article main content post entry story".split())
#: Words that make a class say what else the page has, as in with-sidebar.
_STATES = frozenset("has with no without is".split())
_WORDS = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_MAIN_WORDS = MAIN - {"body"}


#: Characters of a path beyond which its beginning is a digest.
LONG = 400
#: What a page's best container gets; the others get their share of it.
VOTES = 1_000_000
#: Open elements that end the search for what a new one closes.
_BOUNDS = CONTAINERS | {"ul", "ol", "table", "dl"}
_CLOSABLE = frozenset(t for ts in CLOSES.values() for t in ts)


@dataclass
class Parsed:
    """A page: its containers in the order in which they begin, and its blocks outside boilerplate.

    paths, wides and parents are by container: its path, the widened one, and the number of the container around it or -1.
    blocks: (number of the innermost container or -1, text, characters inside links).
    """

    paths: list[str] = field(default_factory=list)
    wides: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)
    favoured: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def enter(self, parent: int, tag: str, classes: str) -> int:
        """A new container's number."""
        names = sorted(classes.lower().split())
        name = _DIGITS.sub("#", ".".join([tag, *names]))
        path = f"{self.paths[parent]}>{name}" if parent >= 0 else name
        if len(path) > LONG:
            path = f"{hashlib.md5(path.encode('utf-8', 'surrogatepass'), usedforsecurity=False).hexdigest()}:{tag}"
        above = parent >= 0 and self.marked[parent]
        self.wides.append(self.wides[parent] if above else path)
        # a class counts if its last word is that of a main container, as in post-content; content-wrapper may hold a whole page
        own = tag in ("article", "main") or any(words[-1] in _CONTENT for words in map(_WORDS.findall, names) if words)
        self.marked.append(above or own)
        self.favoured.append(tag in ("article", "main") or not _MAIN_WORDS.isdisjoint(_WORDS.findall(name)))
        self.paths.append(path)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 1)
        return len(self.paths) - 1


def _boilerplate(tag: str, attributes: dict[str, str], inside_main: bool, by_name: bool) -> bool:
    if tag in SKIPPED or (tag == "header" and not inside_main) or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    if not by_name:
        return False
    if tag in ("html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6") and not attributes.get("role"):
        words = set(_WORDS.findall(attributes.get("class", "").lower() + " " + attributes.get("id", "").lower()))
        return tag not in ("html", "body", "article", "main") and bool(words & BOILERPLATE) and not words & MAIN
    said = " ".join(attributes.get(a, "") for a in ("class", "id", "role", "aria-label")).lower()
    if not said.strip():
        return False
    for name in said.split():
        words = _WORDS.findall(name)
        if words and set(words) & BOILERPLATE and not (words[0] in MAIN and words[-1] in MAIN) and words[0] not in _STATES:
            return True
    return "display:none" in attributes.get("style", "").replace(" ", "").lower()


def blocks(page: str) -> Parsed:
    """Containers and blocks of a page. Where classes and ids would leave nothing of it, only tags count."""
    found = _parse(page, True)
    return found if found.blocks else _parse(page, False)


def _parse(page: str, by_name: bool) -> Parsed:
    out = Parsed()
    # an open element: tag, whether it is skipped, whether it is a block, its container or -1
    stack: list[tuple[str, bool, bool, int]] = []
    places: dict[str, list[int]] = defaultdict(list)  # where elements of a tag are open
    open_blocks: list[int] = []
    bounds: list[int] = []
    text: list[str] = []
    linked = links = mains = skipping = 0
    container = -1

    def flush() -> None:
        nonlocal linked
        if text:
            joined = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
            if joined:
                out.blocks.append((container, joined, linked))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal skipping, container, links, mains
        while len(stack) > depth:
            tag, skip, block, own = stack.pop()
            places[tag].pop()
            if block:
                open_blocks.pop()
                if not skipping:
                    flush()
            if tag in _BOUNDS:
                bounds.pop()
            skipping -= skip
            links -= tag == "a"
            mains -= tag in ("article", "main")
            if own >= 0:
                container = out.parents[own]

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at and not skipping:
            part = page[at:end]
            text.append(part)
            if links:
                linked += len(part)
        if not m:
            break
        tag = m[2]
        if not tag:
            mark = m[0]
            close_by = {"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">")
            stop = page.find(close_by, m.end())
            at = size if stop < 0 else stop + len(close_by)
            continue
        rest = _TAG_REST.match(page, m.end())
        if rest is None:
            stop = page.find(">", m.end())
            inner, at = page[m.end() : stop if stop >= 0 else size], size if stop < 0 else stop + 1
        else:
            inner, at = page[m.end() : rest.end() - 1], rest.end()
        tag = tag.lower()
        if m[1]:
            if tag == "br" or tag in VOID:
                continue
            where = places.get(tag)
            if where and (tag in BLOCKS or not open_blocks or open_blocks[-1] <= where[-1]):
                close(where[-1])
            elif tag == "p" and not skipping:
                flush()
            continue
        if tag == "br":
            if not skipping:
                text.append(" ")
            continue
        if tag in VOID:
            if tag == "hr" and not skipping:
                flush()
            continue
        closes = CLOSES.get(tag) or (("p",) if tag in _ENDS_P else ())
        if closes:
            # the outermost of them inside the innermost bound; a td is a bound and can be closed itself
            if bounds and stack[bounds[-1]][0] in closes:
                close(bounds[-1])
            bound = bounds[-1] if bounds else -1
            inside = [where[k] for t in closes if (where := places.get(t)) and (k := bisect_right(where, bound)) < len(where)]
            if inside:
                close(min(inside))
        attributes = {a[0].lower(): next((v for v in a[1:] if v), "") for a in _ATTRIBUTE.findall(inner)} if inner.strip(" /\t\r\n") else {}
        block = tag in BLOCKS
        if block and not skipping:
            flush()
        if inner.endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        skip = _boilerplate(tag, attributes, mains > 0, by_name)
        own = -1
        if tag in CONTAINERS and not skipping and not skip:
            own = container = out.enter(container, tag, attributes.get("class", ""))
        places[tag].append(len(stack))
        if block:
            open_blocks.append(len(stack))
        if tag in _BOUNDS:
            bounds.append(len(stack))
        stack.append((tag, skip, block, own))
        skipping += skip
        links += tag == "a"
        mains += tag in ("article", "main")
        if tag in RAW:
            stop = re.compile(rf"</{tag}", re.I).search(page, at)
            at = size if stop is None else stop.start()
    close(0)
    flush()
    return out


def score(page: Parsed) -> dict[str, float]:
    """Support of each container path of a page: text outside links in the blocks below it, halved at each level up; a container's share counts for more the more of the page's text it holds."""
    total = [0.0] * len(page.paths)
    for at, text, linked in page.blocks:
        if at >= 0:
            total[at] += max(0, len(text) - 2 * linked) * (1.0 if text[-1:] in ".!?:;\"'»”)" or len(text) > 120 else 0.5)
    found: dict[str, float] = defaultdict(float)
    for i in reversed(range(len(total))):  # containers come after those around them
        if page.parents[i] >= 0:
            total[page.parents[i]] += 0.5 * total[i]
        if total[i] > 0:
            found[page.paths[i]] += total[i] * (1.5 if page.favoured[i] else 1.0)
    return dict(found)


def best(page: Parsed, scores: dict[str, float]) -> str | None:
    """The widened path of the page's own best container; none if nothing has a score."""
    if not scores:
        return None
    top = max(scores, key=lambda p: (scores[p], p))
    return page.wides[page.paths.index(top)]


def pick(paths: list[str], parents: list[int], at: list[int], texts: list[str], path: str | None) -> list[str]:
    """The texts of the blocks at containers `at` that lie in one with that path."""
    if path is None:
        return []
    inside: list[bool] = []
    for own, parent in zip(paths, parents, strict=True):
        inside.append(own == path or (parent >= 0 and inside[parent]))
    return [t for i, t in zip(at, texts, strict=True) if i >= 0 and inside[i]]


def extract(page: Parsed, path: str | None) -> str:
    """The blocks in containers on that widened path, or on the page's own best path if there are none."""
    at, texts = [b[0] for b in page.blocks], [b[1] for b in page.blocks]
    own = best(page, score(page))
    return "\n".join(pick(page.paths, page.parents, at, texts, path) or (texts if own is None else pick(page.paths, page.parents, at, texts, own)))


_VOTE = pa.struct([("path", pa.string()), ("wide", pa.string()), ("depth", pa.int32()), ("votes", pa.int64())])
_PARSED = "host string, votes array<struct<path: string, wide: string, depth: int, votes: bigint>>, best string, paths array<string>, parents array<int>, at array<int>, texts array<string>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from copse.llm.html import best, blocks, parts, score

    names = ["host", "votes", "best", "paths", "parents", "at", "texts"]
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            b = whole.slice(start, 256)
            rows: list[list] = [[] for _ in names]
            for url, page in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = blocks(page or "")
                scores = score(found)
                most = max(scores.values(), default=0.0)
                first = {p: i for i, p in reversed(list(enumerate(found.paths)))}
                votes = [{"path": p, "wide": found.wides[first[p]], "depth": found.depths[first[p]], "votes": v} for p, s in scores.items() if (v := round(VOTES * s / most))]
                for to, x in zip(rows, (parts(url)[0], votes, best(found, scores), found.paths, found.parents, [i for i, _, _ in found.blocks], [t for _, t, _ in found.blocks]), strict=True):
                    to.append(x)
            types = [pa.string(), pa.list_(_VOTE), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, t) for x, t in zip(rows, types, strict=True)]], ["page_id", "url", *names])


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, votes, best, paths, parents, at, texts) of pages (page_id, url, html)."""
    ship(pages.sparkSession)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select(pages["page_id"], pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return rows.mapInArrow(_parsed, f"page_id {kind}, url string, {_PARSED}")


def host_paths(table: DataFrame) -> DataFrame:
    """(host, path, wide): the winning path of each host of a table of parsed(), and the widened one."""
    votes = table.select("host", F.explode("votes").alias("v")).select("host", "v.*")
    summed = votes.groupBy("host", "path", "wide", "depth").agg(F.sum("votes").alias("votes"))
    top = summed.groupBy("host").agg(F.max(F.struct("votes", "depth", "path", "wide")).alias("top"))
    return top.select("host", F.col("top.path").alias("path"), F.col("top.wide").alias("wide"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from copse.llm.html import pick

    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            b = whole.slice(start, 256)
            out = []
            for best, paths, parents, at, texts, wide in zip(*[c.to_pylist() for c in b.columns[2:]], strict=True):
                out.append("\n".join(pick(paths, parents, at, texts, wide) or (texts if best is None else pick(paths, parents, at, texts, best))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of pages (page_id, url, html)."""
    table = materialise(parsed(pages), "html-parsed", "zstd")
    # stored, so that the join is a broadcast where it is small, and hot hosts can be split where it is not
    winners = materialise(host_paths(table), "html-paths").select(F.col("host").alias("w"), "wide")
    joined = table.join(winners, table["host"] == winners["w"], "left").select("page_id", "url", "best", "paths", "parents", "at", "texts", "wide")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"page_id {kind}, url string, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
