"""Main text of web pages: containers are scored by page, their paths are voted on by host, winners extract."""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowsentry.llm import common
from flowsentry.session import fits_broadcast, materialize

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>", re.DOTALL)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: A tag with a quote that is never closed ends at the next angle bracket.
_ODD_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NUMBER = re.compile(r"&#([0-9]{8,});?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and is dropped.
RAW = frozenset("script style noscript template textarea title iframe svg math canvas object audio video".split())
#: Elements that are dropped with all they hold.
DROPPED = frozenset("head nav header footer aside form button select dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "tr ul".split()
)
#: Elements that may be the container of the main text.
CONTAINERS = frozenset("html body main article section div td table center blockquote".split())
#: A start tag of the key ends an open element of these kinds, as long as no element of the second set lies between.
_P = (frozenset(["p"]), frozenset("td th table button article section div body html".split()))
ENDS = {t: _P for t in BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}} | {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
}
#: Words of class, id and role names that mark menus, notices, adverts, comments and the like.
NOISE = frozenset(
    "ad ads adv advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer gdpr header hidden login menu modal nav navbar navigation newsletter notice pagination popup promo promoted "
    "promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toolbar widget contentinfo complementary alert dialog".split()
)
#: Noise that never is the main text, whatever else a name says.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Words of names that main containers have.
MAIN = frozenset("article body container content entry main page post story text wrapper".split())
#: First words of names that say what a container has beside it, not what it is.
STATE = frozenset("has is no show with without".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Share of its score a container passes on to its parent, and to the page as a whole, which holds much else.
DECAY, DECAY_TO_PAGE = 0.9, 0.5
PAGE = frozenset(["", "html", "body"])
#: A container with the headline takes the place of the best one if it holds at most so many times its text.
WITH_HEADLINE = 1.25


class Block(NamedTuple):
    container: int
    text: str
    link_chars: int
    headline: bool


class Container(NamedTuple):
    parent: int
    path: int
    step: str
    tag: str


def _unescape(s: str) -> str:
    """Character references decoded; a number beyond all code points is U+FFFD."""
    if "&" not in s:
        return s
    short = lambda m: f"&#{d};" if len(d := m[1].lstrip("0") or "0") < 8 else "\ufffd"
    return entities.unescape(_NUMBER.sub(short, s))


def _attributes(s: str) -> dict[str, str]:
    return {k.lower(): _unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(s)} if s.strip(" /\n\t\r") else {}


def _noise(attributes: dict[str, str]) -> str:
    """``yes`` for what is hidden or named as noise, ``maybe`` where a name has words of main text as well, else nothing."""
    if "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "yes"
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return "yes"
    words: set[str] = set()
    for name in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        parts = [w.lower() for w in _WORDS.findall(name)]
        if parts and not (parts[0] in STATE and len(parts) > 1):
            words.update(parts)
    if not words & NOISE:
        return ""
    return "maybe" if words & MAIN and not words & COMMENTS else "yes"


def _step(tag: str, attributes: dict[str, str]) -> str:
    """A tag with its classes, digits generalised."""
    classes = sorted({re.sub(r"\d+", "0", c.replace(">", "")) for c in attributes.get("class", "").split()})
    return ".".join([tag, *classes])


def parse(html: str) -> tuple[list[Container], list[Block]]:
    """Containers in page order (0 is the page itself) and the blocks of text that are not dropped.

    Paths are numbers, and every step of the scan looks at open elements by tag, so time and memory grow with the length of
    the page, however deep or broken its markup is. An element that may be noise by its name is dropped unless it holds
    more than half of the unlinked text that is left.
    """
    containers, blocks, regions = [Container(-1, 0, "", "")], [], []
    paths: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]  # tag, container, dropped, in a link, region
    open_at: dict[str, list[int]] = {}
    buffer: list[str] = []
    block_regions: list[int] = []
    link_chars, headline, at, size, last = 0, False, 0, len(html), html.rfind(">")

    def close_block():
        nonlocal buffer, link_chars, headline
        if buffer:
            text = " ".join(_unescape("".join(buffer)).split())
            if text:
                blocks.append(Block(stack[-1][1], text, link_chars, headline))
                block_regions.append(stack[-1][4])
            buffer, link_chars, headline = [], 0, False

    def pop_to(depth: int):
        if any(entry[0] in BLOCKS for entry in stack[depth:]):
            close_block()
        for entry in stack[depth:]:
            open_at[entry[0]].pop()
        del stack[depth:]

    def take(text: str):
        nonlocal link_chars, headline
        if text and not stack[-1][2]:
            buffer.append(text)
            if stack[-1][3]:
                link_chars += len(text)
            headline = headline or bool(open_at.get("h1"))

    def innermost(tags) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    while at < size:
        start = html.find("<", at)
        if start < 0:
            start = size
        take(html[at:start])
        if start == size:
            break
        m = _COMMENT.match(html, start) if html[start + 1 : start + 2] in ("!", "?") else None
        if m is not None:
            at = m.end()
            continue
        if start < last:
            m = _TAG.match(html, start) or _ODD_TAG.match(html, start)
        if m is None:
            take("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if open_at.get(tag):
                pop_to(open_at[tag][-1])
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
                at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            else:
                take(" ") if tag == "br" else None
            continue
        if tag in ENDS:
            ended, walls = ENDS[tag]
            depth = innermost(ended)
            if depth and depth > innermost(walls - ended):
                pop_to(depth)
        if tag in BLOCKS:
            close_block()
        _, container, dropped, link, region = stack[-1]
        attributes = _attributes(m[3])
        noise = _noise(attributes) if tag not in ("html", "body") else ""
        dropped = dropped or tag in DROPPED or noise == "yes"
        if noise and not dropped:
            regions.append(region)
            region = len(regions) - 1
        if tag in CONTAINERS and not dropped:
            step = _step(tag, attributes)
            path = paths.setdefault((containers[container].path, step), len(paths) + 1)
            containers.append(Container(container, path, step, tag))
            container = len(containers) - 1
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, container, dropped, link or tag == "a", region))
    close_block()
    return containers, _without_noise(blocks, block_regions, regions)


def _unlinked(block: Block) -> int:
    return max(0, len(block.text) - 2 * block.link_chars)


def _without_noise(blocks: list[Block], at: list[int], parents: list[int]) -> list[Block]:
    """Blocks outside doubtful elements, and within those that hold more than half of the unlinked text."""
    if not parents:
        return blocks
    held = [0] * len(parents)
    for block, region in zip(blocks, at):
        if region >= 0:
            held[region] += _unlinked(block)
    for region in range(len(parents) - 1, -1, -1):  # parents have smaller numbers
        if parents[region] >= 0:
            held[parents[region]] += held[region]
    total = sum(map(_unlinked, blocks))
    kept = []
    for region, parent in enumerate(parents):
        kept.append(2 * held[region] > total and (parent < 0 or kept[parent]))
    return [b for b, region in zip(blocks, at) if region < 0 or kept[region]]


def _subtree(containers: list[Container], own: list[float], share: float = 1.0, to_page: float = 1.0) -> list[float]:
    out = list(own)
    for i in range(len(containers) - 1, 0, -1):  # parents come first
        up = containers[i].parent
        out[up] += (to_page if containers[up].tag in PAGE else share) * out[i]
    return out


def best_path(containers: list[Container], blocks: list[Block]) -> tuple[str, float] | None:
    """The path whose containers score highest together; the first of equals.

    A container's score is its text outside links and a share of its children's scores. If the headline lies outside, the
    nearest container with both is taken, as long as it holds little else.
    """
    own, headlines = [0.0] * len(containers), [0.0] * len(containers)
    for b in blocks:
        own[b.container] += _unlinked(b)
        headlines[b.container] += b.headline
    by_path: dict[int, float] = {}
    first: dict[int, int] = {}
    for i, (c, s) in enumerate(zip(containers, _subtree(containers, own, DECAY, DECAY_TO_PAGE))):
        by_path[c.path] = by_path.get(c.path, 0.0) + s * (1.5 if c.tag in ("article", "main") else 1.0)
        first.setdefault(c.path, i)
    path = max(by_path, key=by_path.get)
    if by_path[path] <= 0:
        return None
    whole, headlines = _subtree(containers, own), _subtree(containers, headlines)
    at = first[path]
    held = sum(w for c, w in zip(containers, whole) if c.path == path)
    up = at
    while up > 0 and not headlines[up]:
        up = containers[up].parent
    if up > 0 and whole[up] <= WITH_HEADLINE * held:
        at = up
    steps = []
    while at > 0:
        steps.append(containers[at].step)
        at = containers[at].parent
    return "".join(f">{s}" for s in reversed(steps)), by_path[path]


def text_under(containers: list[Container], blocks: list[Block], path: str) -> str:
    steps = path.split(">")[1:]
    matched = [0] * len(containers)  # steps of the path that lead to a container; -1 if it lies beside the path
    for i, c in enumerate(containers[1:], 1):  # parents come first
        m = matched[c.parent]
        matched[i] = m if m in (-1, len(steps)) else (m + 1 if steps[m] == c.step else -1)
    return "\n".join(b.text for b in blocks if matched[b.container] == len(steps))


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, votes): on each page the best container's path gets one vote for its host."""

    def rows(batches):
        for batch in batches:
            for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
                best = best_path(*parse(html)) if html else None
                if best:
                    yield host, best[0]

    found = common.map_rows(pages.select("host", "html"), rows, "host string, path string")
    return found.groupBy("host", "path").agg(F.count("*").alias("votes"))


def extract(pages: DataFrame, broadcast_hosts: int = 50_000) -> DataFrame:
    """(page_id, url, text, host, path): main texts by the paths that won each host.

    A page without the winning path, or with nothing under it, uses its own best container; ``path`` is the one used.
    Character references are decoded, white space within a block becomes one space, blocks are joined by line feeds in
    page order. A null or empty page has an empty text and null path; a null url counts as the empty host; repeated rows
    are answered row by row; an empty table has no rows; other columns are ignored. Of paths with equal votes the first by
    name wins. The winners are sent to all tasks only if they are counted to be few, in rows (``broadcast_hosts``) and
    bytes; beyond that they are joined.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    rank = F.row_number().over(W.partitionBy("host").orderBy(F.desc("votes"), "path"))
    winners = votes(pages).withColumn("rank", rank).where("rank = 1").select("host", F.col("path").alias("winner"))
    winners = materialize(winners, "host-paths")
    if fits_broadcast(winners, broadcast_hosts):
        winners = F.broadcast(winners)

    def rows(batches):
        columns = ("page_id", "url", "host", "html", "winner")
        for batch in batches:
            for page_id, url, host, html, winner in zip(*(batch[c].to_pylist() for c in columns)):
                text, path = "", None
                if html:
                    containers, blocks = parse(html)
                    text = text_under(containers, blocks, winner) if winner is not None else ""
                    path = winner if text else None
                    if not text and (best := best_path(containers, blocks)):
                        path = best[0]
                        text = text_under(containers, blocks, path)
                yield page_id, url, text, host, path

    joined = pages.join(winners, "host", "left")
    return common.map_rows(
        joined.select("page_id", "url", "host", "html", "winner"), rows, "page_id long, url string, text string, host string, path string"
    )
