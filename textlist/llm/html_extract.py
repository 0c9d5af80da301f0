"""HTML main text by consensus of a host's pages on where its articles stand and what is clutter there.

First pass, one parse of each page: a page votes for its own containers as generalised paths of tags and classes (digits dropped,
inline tags skipped), and says of each element whose name may be clutter what text it has, as a hash, and how much of it is links. Spark counts both for each
host: a path's votes, and whether an element's text comes again on other pages or is mostly links. Second pass: every page is
read again with its host's winning paths and clutter; a page on which none of the paths has text, or as much as it needs, falls back on its own
best container: its articles, or else its main element, or else the least element that holds all that is not clutter. What a page shows is its blocks in page order,
without menus, headers (their headings stay inside an article), footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments, told by tag, class, id and role, and by what the host's pages say.

A name speaks for clutter as a whole (``sidebar``), by its last part (``site-header``) or by its first with a word for a thing of layout
(``comment-list``), but not after ``no`` or ``has`` (``no-sidebar``). Any other name that begins with such a word (``ad-hoc``, ``sidebar-layout``), and inside
an article every name of a paragraph, heading, table, figure or the like and the id of a section, is a doubt only: it counts where the element is mostly links, or where the host's pages
say that its text comes again. Words that articles use as well (``warning``, ``popular``) count only
as the whole name. What holds the page's article is never
left out for its name, nor is, on pages without one, what holds most of the text, unless it is named as comments, menu or the like; and below a
container that the host's pages have voted for only names inside it count. Names that would leave a page with nothing are passed over, but for adverts, comments and what is hidden.

All articles of a page are joined, but for those that tease other pages (mostly links, or a heading that is a link where another's is not); a first heading of the main element before them, where they have none, is theirs.

Each page is parsed on its own, in time linear in its length; the html is never shuffled: only rows of paths and of named elements are, and
those are map-side combined, so a host with most of the pages is no hot group. A path needs a tenth of its host's votes, so there are
ten for each host at most, and an element is judged by a host only where it stands as often as that; pages of rarer layouts are read by their own container. The winners are broadcast only while their number is below
``broadcast_hosts``; beyond that the pages are joined by host.

Defined results: null or empty html gives an empty text; a null url belongs to the nameless host;
pages cut off anywhere keep what they have, half a tag at the end is dropped; repeated rows
each vote and each get a row; paths with as many votes are tried in order of the path; very long and very deep pages are read whole; an empty table gives an empty
result; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save

#: Tags that end the text block before them and start another.
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead title tr ul".split())
#: Tags whose whole content is left out.
SKIPPED = set("aside button canvas datalist dialog footer form head header iframe map menu nav noscript object option select svg template title".split())
RAW = "script|style|textarea|xmp|noframes"
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Names of what is not the article, as whole class names, ids or roles, or as the last part of one.
CLUTTER = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter pager pagination paywall popup promo "
    "respond share sharing sidebar signup sponsor sponsored subscribe subscription toolbar topbar widget widgets complementary contentinfo".split()
)
#: Adverts and comments: told by name wherever they stand, and never pardoned.
FOREIGN = set("ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored comment comments commentlist disqus respond".split())
#: Words for things of layout, which follow what they hold.
THINGS = set("area bar block body box button buttons card cell column container content feed field footer form frame group header holder icon icons inner item items left line link links list menu module nav outer overlay panel primary right row section slot strip tab text thread title top bottom unit widget wrap wrapper zone".split())
#: Of these, those that speak as the first part of a name as well.
LEADS = CLUTTER - set("header complementary contentinfo subscription signup paywall respond masthead".split()) | {"related", "skip"}
#: Names that articles use as well.
SOFT = set("alert announcement disclaimer discussion drawer feedback login notice notices notification popular promoted promotion recommended related replies reply response responses search skip social trending warning".split())
#: What is left out however much of the page it holds.
NEVER = set("comment comments commentlist disqus respond footer menu nav navbar navigation sidebar cookie cookies consent gdpr ad ads advert adverts advertisement breadcrumb breadcrumbs pagination".split())
#: First parts that turn a name round.
TURNS = set("no has with without not is hide show js".split())
#: Tags that hold running text.
TEXT_TAGS = set("p li dt dd td th tr h1 h2 h3 h4 h5 h6 pre blockquote figcaption b i em strong span a abbr cite code mark q small sub sup time u".split())
#: Tags whose name, inside an article, is a doubt only.
LAID = set("figure table tbody thead tfoot dl".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROOTS = {"html", "body", "article", "main"}
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Kinds of clutter: a doubt that needs the host's word, names that articles use too, names, names never pardoned, adverts and comments, tags, what is hidden.
PLAIN, DOUBT, SOFTLY, NAMED, HARD, ALIEN, TAG, HIDDEN = range(8)


@dataclass
class Node:
    tag: str
    step: str  # tag and classes
    parent: int
    mark: int  # clutter: one of the kinds below
    key: str  # what the host's pages know a named element by
    inside: bool  # below an article or main
    header: bool  # of an article: its headings stay
    size: int = 0  # characters of own text
    linked: int = 0
    print: int = 0  # of its own text


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)  # the node that holds it, its text

    def path(self, k: int) -> str:
        steps = []
        while k > 0:
            steps.append(self.nodes[k].step)
            k = self.nodes[k].parent
        return ">".join(reversed(steps))

    def sums(self, own: list[int]) -> list[int]:
        """Of each node, what it and all below it have."""
        own = list(own)
        for k in range(len(own) - 1, 0, -1):
            own[self.nodes[k].parent] += own[k]
        return own


def attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def parse(html: str) -> Page:
    """Elements that hold blocks, and the text blocks in page order."""
    page = Page([Node("", "", -1, PLAIN, "", False, False)])
    stack, text, links, linked = [0], [], 0, 0
    open_tags: Counter[str] = Counter()
    mute = 0  # where an inline element that is clutter lies on the stack; what it holds is no part of the block around it

    def flush() -> None:
        nonlocal linked
        if text and (said := " ".join(entities.unescape("".join(text)).split())):
            holder = stack[mute - 1 if mute else -1]
            page.blocks.append((holder, said))
            page.nodes[holder].size += len(said)
            page.nodes[holder].linked += min(linked, len(said))
            page.nodes[holder].print += zlib.crc32(said.encode("utf-8", "replace")) + len(said)
        text.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal mute
        if not mute or upto < mute:
            flush()
        if mute >= upto:
            mute = 0
        open_tags.subtract(page.nodes[k].tag for k in stack[upto:])
        del stack[upto:]

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and not mute:
            text.append(html[at : m.start()])
            linked += (m.start() - at) * (links > 0)
        at = m.end()
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), m[2] == "/"
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if tag in ("br", "td", "th", "wbr"):
            text.append(" " if tag != "wbr" else "")
        if not html[at - 1] == ">" and at == len(html):
            break  # half a tag at the end
        block = tag in BLOCKS
        if closing:
            if open_tags[tag] > 0:
                for k in range(len(stack) - 1, 0, -1):
                    if page.nodes[stack[k]].tag == tag:
                        close(k)
                        break
            elif block and not mute:
                flush()
            continue
        has = attributes(m[4]) if m[4] and tag not in VOID else {}
        above = page.nodes[stack[-1]]
        inside = above.inside or above.tag in ("article", "main")
        mark = TAG if tag in SKIPPED else PLAIN if tag in ROOTS else named(has, tag, inside)
        if not block and not mark:
            continue
        if block:
            if not mute:
                flush()
            for k in range(len(stack) - 1, mute, -1):  # a block ends an open paragraph; an item ends the item before it
                open_tag = page.nodes[stack[k]].tag
                if open_tag == "p" or open_tag in HEADINGS and tag in HEADINGS or open_tag == tag and tag in ("li", "dt", "dd", "tr", "option"):
                    close(k)
                    break
                if open_tag in BLOCKS and open_tag not in HEADINGS:
                    break
            above = page.nodes[stack[-1]]
        if tag in VOID or m[4].rstrip().endswith("/") and tag not in BLOCKS | SKIPPED:
            continue
        names = ".".join(sorted(x for x in re.sub(r"\d+", "", has.get("class", "")).lower().split() if x))
        step = tag + (f".{names}" if names else "")
        key = f"{step}#{re.sub(r'[0-9]+', '', has.get('id', '')).lower()}" if PLAIN < mark <= NAMED else ""
        page.nodes.append(Node(tag, step, stack[-1], mark, key, inside, inside and mark > 0 and (tag == "header" or "header" in parts(has)) and not words_of(has) & CLUTTER - {"header"}))
        stack.append(len(page.nodes) - 1)
        open_tags[tag] += 1
        if not block and not mute:
            mute = len(stack) - 1
    if at < len(html) and not mute:
        text.append(re.sub(r"<[/!a-zA-Z][^<]*\Z", "", html[at:]))
    flush()
    return page


def words_of(has: dict[str, str]) -> set[str]:
    return set(f"{has.get('class', '')} {has.get('id', '')} {has.get('role', '')}".lower().split())


def parts(has: dict[str, str]) -> set[str]:
    return {x.lower() for x in NAME_PARTS.findall(f"{has.get('class', '')} {has.get('id', '')} {has.get('role', '')}")}


def named(has: dict[str, str], tag: str, inside: bool) -> int:
    """How an element's names and attributes mark it; ``inside``: it stands in an article."""
    if not has:
        return PLAIN
    if "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in has.get("style", "").replace(" ", "").lower():
        return HIDDEN
    classes = has.get("class", "").split()
    running = inside and tag in TEXT_TAGS
    most = PLAIN
    for name in [*classes, *has.get("id", "").split(), *has.get("role", "").split()]:
        split = [x.lower() for x in NAME_PARTS.findall(name)]
        if not split or split[0] in TURNS:
            continue
        last, first = split[-1], split[0]
        anchor = tag == "section" and name not in classes or "section" in classes and name == has.get("id")
        if last in CLUTTER or first in LEADS and (len(split) == 1 or last in THINGS):
            alien = last in FOREIGN or first in FOREIGN
            if inside and not (alien and (tag not in TEXT_TAGS | LAID or first in FOREIGN and first.startswith("ad"))) and (running or tag in LAID or anchor):
                most = max(most, DOUBT)
            else:
                most = max(most, ALIEN if alien else HARD if last in NEVER or first in NEVER else NAMED)
        elif first in LEADS:
            most = max(most, DOUBT)
        elif len(split) == 1 and first in SOFT:
            most = max(most, DOUBT if running or anchor and inside else SOFTLY)
    return most


def main_nodes(page: Page, unlinked: list[int], whole: list[int]) -> list[int]:
    """The articles of a page that tease no other page, the largest first, or else its main element."""
    bad = [False] * len(page.nodes)
    heads: dict[int, bool] = {}  # whether the first heading of an article is a link
    within = [0] * len(page.nodes)  # the outermost article around it
    for k, n in enumerate(page.nodes[1:], 1):
        bad[k] = bad[n.parent] or n.mark >= HARD and n.tag != "form"
        within[k] = within[n.parent] or (k if n.tag == "article" and not bad[k] else 0)
        if within[k] and n.tag in HEADINGS and n.size:
            heads.setdefault(within[k], 2 * n.linked > n.size)
    for tag in ("article", "main"):
        found = [k for k, n in enumerate(page.nodes) if n.tag == tag and not bad[k] and unlinked[k] > 0 and (tag == "main" or within[k] == k)]
        found.sort(key=lambda k: -unlinked[k])
        if tag == "main" or not found:
            found = found[:1]
        elif not all(heads.get(k, False) for k in found):
            found = [k for k in found if not heads.get(k, False)]
        found = [k for k in found if 2 * unlinked[k] >= whole[k]] or found[:1]
        if found:
            return found
    return []


def judge(page: Page, clutter: set[str]) -> tuple[list[bool], list[int]]:
    """Whether each node is clutter by itself, and the nodes of the articles; ``clutter``: keys that the host's pages call so."""
    own = [n.size - n.linked for n in page.nodes]
    unlinked = page.sums(own)
    all_text = page.sums([n.size for n in page.nodes])
    skip = [n.mark > DOUBT or n.mark == DOUBT and (n.key in clutter or 0 < all_text[k] > 2 * unlinked[k]) for k, n in enumerate(page.nodes)]
    # of an article, what stands in clutter below it is not its own
    kept, whole = list(own), [n.size for n in page.nodes]
    for k in range(len(kept) - 1, 0, -1):
        if not skip[k] or page.nodes[k].mark == SOFTLY:
            kept[page.nodes[k].parent] += kept[k]
            whole[page.nodes[k].parent] += whole[k]
    best = main_nodes(page, kept, whole)
    if best:
        for k in best:
            while k > 0:
                skip[k] = False
                k = page.nodes[k].parent
        return skip, best
    for k, n in enumerate(page.nodes):
        if skip[k] and (n.mark in (DOUBT, SOFTLY, NAMED) or n.tag == "form") and 2 * unlinked[k] > unlinked[0]:
            skip[k] = False
    if not any(shown_below(page, skip, {0})[k] for k, _ in page.blocks):  # names that leave nothing are passed over
        skip = [s and (n.mark >= ALIEN or n.key in clutter) for s, n in zip(skip, page.nodes, strict=True)]
    return skip, []


def title_of(page: Page, tops: list[int]) -> set[int]:
    """First-level headings of the main element that stand before its articles, where these have none."""
    first = min(tops)
    above, k = set(), first
    while k > 0:
        k = page.nodes[k].parent
        above.add(k)
    top = max((k for k in above if page.nodes[k].tag == "main"), default=max((k for k in above if k and page.nodes[k].tag not in ("body", "html")), default=0))
    state = [0] * len(page.nodes)  # 1 below ``top``, 2 below an article or clutter
    found = set()
    for k, n in enumerate(page.nodes):
        up = state[n.parent] if k else 0
        state[k] = 1 if k == top else 2 if up == 2 or k in tops else 2 if up == 1 and n.mark > DOUBT and not n.header and k not in above else up
        if n.tag == "h1" and n.size:
            if state[k] == 2 and k > first:
                return set()
            if state[k] == 1 and k < first:
                found.add(k)
    return found if top else set()


def shown_below(page: Page, skip: list[bool], top: set[int]) -> list[bool]:
    """Whether a block held by each node is shown, below the elements ``top``; only marks below these count."""
    state = [0] * len(page.nodes)  # 0 outside, 1 shown, 2 left out, 3 left out but for headings
    for k, n in enumerate(page.nodes):
        up = state[n.parent] if k else 0
        if k in top and up == 0:
            state[k] = 1
        elif up == 1 and skip[k]:
            state[k] = 3 if n.header else 2
        elif up == 3 and (n.tag in HEADINGS or skip[k]):
            state[k] = 1 if n.tag in HEADINGS else 2
        else:
            state[k] = up
    return [x == 1 for x in state]


def best_container(page: Page, skip: list[bool], best: list[int]) -> set[int]:
    """The nodes of the articles, or else of the deepest element that holds all text that is shown; none where none is."""
    if best:
        return set(best)
    shown = shown_below(page, skip, {0})
    own = [0] * len(page.nodes)
    for k, said in page.blocks:
        own[k] += len(said) * shown[k]
    held = page.sums(own)
    deep = [0] * len(page.nodes)
    for k, n in enumerate(page.nodes[1:], 1):
        deep[k] = deep[n.parent] + 1
    top = max(((deep[k], -k, k) for k, n in enumerate(page.nodes) if n.tag not in ("p", "li", *HEADINGS) and held[k] == held[0] > 0), default=(0, 0, -1))[2]
    return {top} - {-1}


def vote(html: str) -> tuple[set[str], list[tuple[str, int, int, int, int]]]:
    """The paths of a page's own containers, and of its elements with doubtful names their key, a hash of the page's other text, one of theirs, its length and that of its links."""
    page = parse(html)
    tops = best_container(page, *judge(page, set()))
    paths = {page.path(k) for k in tops} - {""}
    plain = shown_below(page, [n.mark > 0 for n in page.nodes], tops)
    rest = sum(n.print for k, n in enumerate(page.nodes) if plain[k])
    size, linked, print_ = (page.sums(x) for x in zip(*((n.size, n.linked, n.print) for n in page.nodes), strict=True))
    return paths, [(n.key, rest, print_[k], size[k], linked[k]) for k, n in enumerate(page.nodes) if n.mark == DOUBT and size[k]]


def nodes_at(page: Page, paths: list[str]) -> list[set[int]]:
    """The nodes of each path."""
    numbers: dict[tuple[int, str], int] = {}
    ends = []
    for path in paths:
        at = 0
        for step in path.split(">"):
            at = numbers.setdefault((at, step), len(numbers) + 1)
        ends.append(at)
    found: dict[int, set[int]] = {end: set() for end in ends}
    where = [0] * len(page.nodes)
    for k, n in enumerate(page.nodes[1:], 1):
        where[k] = numbers.get((where[n.parent], n.step), -1) if where[n.parent] >= 0 else -1
        if where[k] in found:
            found[where[k]].add(k)
    return [found[end] for end in ends]


def below(page: Page, skip: list[bool], top: set[int]) -> str:
    shown = shown_below(page, skip, top)
    return "\n".join(t for k, t in page.blocks if shown[k])


def extract(html: str, paths: list[str], clutter: list[str] | tuple[str, ...] = ()) -> str:
    """The blocks below the first of ``paths`` that has text, else below the page's own best container.

    A path that ends in no article element was voted for by pages without one: it must hold as much of this page as the page's own container. One that ends in an article
    stands for all articles of the page, with those of them that lie elsewhere.
    """
    page = parse(html)
    skip, best = judge(page, set(clutter))
    tops = best_container(page, skip, best)
    articles = set(best) if best and page.nodes[best[0]].tag == "article" else set()
    if articles:
        title = title_of(page, best)
        tops |= title
    own = below(page, skip, tops) if tops else ""
    for path, found in zip(paths, nodes_at(page, paths), strict=True):
        last = path.rsplit(">", 1)[-1].split(".")[0]
        if last == "article" and articles:
            found = tops if found & articles else found
        said = below(page, skip, found) if found else ""
        if said and (last in ("article", "main") or len(said) >= len(own)):
            return said
    return own


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """``(host, path, rest, print, n, size, linked)``: how many of a host's pages have their text at ``path`` where ``print`` is null, else how many elements of the key ``path``
    have the text of that hash, on pages with the other text of the hash ``rest``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                paths, elements = vote(html or "")
                rows += [(host, path, None, None, 0, 0) for path in sorted(paths)] + [(host, *e) for e in elements]
            kinds = (pa.string(), pa.string(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["host", "path", "rest", "print", "size", "linked"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, rest long, print long, size long, linked long")
    return rows.groupBy("host", "path", "rest", "print").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))


def winning_paths(pages: DataFrame, least: float = 0.1) -> DataFrame:
    """``(host, paths, clutter)``: paths with at least a share ``least`` of their host's votes, most votes first, and keys of elements that are clutter there:
    on three different pages or more, and as often as that share, mostly links, or at least half of them with a text that stands on another of these pages. Copies of a page count once.
    """
    found = save(votes(pages), "votes")
    v = found.where("print is null").select("host", "path", F.col("n").alias("votes"))
    all_ = v.groupBy("host").agg(F.sum("votes").alias("all"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    best = v.join(all_, "host").where(F.col("votes") >= least * F.col("all")).withColumn("rank", F.row_number().over(order))
    paths = best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))
    texts = found.where("print is not null").groupBy("host", F.col("path").alias("key"), "print").agg(F.sum("n").alias("n"), F.count("*").alias("pages"), F.sum("size").alias("size"), F.sum("linked").alias("linked"))
    again = F.sum(F.when(F.col("pages") > 1, F.col("pages")).otherwise(0))
    keys = texts.groupBy("host", "key").agg(again.alias("again"), *[F.sum(c).alias(c) for c in ("n", "pages", "size", "linked")])
    keys = keys.join(all_, "host", "left").where((F.col("pages") >= 3) & (F.col("n") >= least * F.coalesce("all", F.lit(0))))
    bad = keys.where((2 * F.col("again") >= F.col("pages")) | (2 * F.col("linked") > F.col("size"))).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("clutter"))
    return paths.join(bad, "host", "full")


def main_text(pages: DataFrame, broadcast_hosts: int = 100_000) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    winners = save(winning_paths(pages), "paths")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "paths", "clutter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h or "", p or [], c or []) for h, p, c in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
