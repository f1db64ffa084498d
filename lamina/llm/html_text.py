"""Operator 6: main text of web pages by consensus paths of a host.

First pass: every page is parsed once, into blocks of text and the containers
around them. The containers are scored (paragraph text less linked text, halved
for each level between). From the best one the page climbs to the highest
container around it that adds unlinked text, and votes for its path. A path is
the tags and classes from the root, numbers left out. A class or id that names
what is not the article (``_NAMES``) never drops html, body, main, article or a
heading. Text below another block of such a name counts a quarter, for the
containers up to that block only, and is left out of the containers around it,
unless the page's best container lies in the block. Votes are counted in Spark
for each host and path, and each host's winner is the path with most votes.

Second pass: the text is taken from the blocks of the first pass, from the
winning path's containers, or from the page's own one if they hold no text, or
less than half of its unlinked text and lack ``LEAST_MISSED`` characters or more
of it (a page of another template; a page of less text does not outvote its
host). Text around the article that no tag, class or id marks is kept.

Parsing is linear in time and memory: quoted attributes are read as browsers
read them; an end tag finds its start by a stack for each tag; scores are
carried up once, from the last container to the first; a path is spelt out for
one container of a page only. A nav, header, form or the like that is never
closed ends at the next container (it is dropped if that leaves linked text
alone in it), a footer or aside at the next article or main. A script or style
without an end drops the rest of the page, other raw elements without one drop
nothing.

Votes are two numbers for each host and path, summed map-side, so a host with a
third of all pages is no hot group. Winners go to the pages by broadcast while
there are at most ``BROADCAST_HOSTS`` hosts, and by a join on the host beyond,
in which hosts of many pages are sent to the pages.

Defined results: null or empty html gives empty text; a null url is a host of
its own; a page cut short counts as far as it goes; a null page_id keeps its
row; repeated rows stay (and vote each); an empty table gives no rows; other
columns are ignored. White space is what Unicode calls so.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.joins import spread_join
from lamina.llm.storage import cut, rows_of, table

BROADCAST_HOSTS = 200_000
#: Characters outside the host's path from which a page goes by its own container.
LEAST_MISSED = 200

#: A tag with its attributes; a quote counts behind an equals sign only.
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?|.""", re.S)
#: What opens a tag or comment, whole or not.
_OPENED = re.compile(r"<(?:/?[A-Za-z]|[!?]|/?\Z)")
_STARTED = re.compile(r"</?[A-Za-z]")
_SELF_CLOSED = re.compile(r"""(?:\A|[\s"'])/\Z""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg xmp".split())
_DROPPED = frozenset("nav header footer aside form button select dialog menu head".split()) | _RAW
_CONTAINER = frozenset("article main section div td body".split())
_BLOCK = _CONTAINER | frozenset(
    "html p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre figure figcaption "
    "address details summary fieldset hr br nav header footer aside form head center".split()
)
#: Elements that a start of a container ends if no end tag does.
_LEFT_OPEN = {t: _CONTAINER for t in "nav header form menu button select dialog".split()}
_LEFT_OPEN |= {"footer": frozenset(["article", "main"]), "aside": frozenset(["article", "main"]), "head": _BLOCK - {"head"}}
#: Words of classes and ids that name what is not the article.
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|banner|sponsor(?:ed)?|promo|cookies?|consent|notice|popup|modal|newsletter|subscribe|"
    r"menu|nav|navbar|navigation|breadcrumbs?|sidebar|side-?bar|widget|footer|header|masthead|comments?|replies|disqus|respond|"
    r"share|sharing|social|related|recommended|login|signup|search)(?:$|[\s_-])", re.I
)
#: Words that say whether there is such a thing, as in has-sidebar.
_MODIFIED = re.compile(r"(?:^|(?<=[\s_-]))(?:no|has|with|without)[_-]\S+", re.I)
_NEVER_NAMED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
#: Tags whose start ends an open element: tag -> the elements it ends.
_ENDS: dict[str, tuple[str, ...]] = {"a": ("a",)} | {t: ("p",) for t in _BLOCK - {"br"}}
for _tag, _open in (("li", "li"), ("dt", "dt"), ("dt", "dd"), ("dd", "dt"), ("dd", "dd"), ("tr", "tr"), *((t, c) for t in ("td", "th", "tr") for c in ("td", "th"))):
    _ENDS[_tag] = (*_ENDS[_tag], _open)
#: Elements beyond which a start tag ends nothing.
_BOUNDS = _CONTAINER | {"ul", "ol", "table", "dl"}


@lru_cache(maxsize=1 << 14)
def _name(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised name of an element, and whether its class or id is of what is not the article."""
    classes, found = (), {}
    if "=" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name = (m.group(1) or "").lower()
            if name in ("class", "id"):
                found.setdefault(name, next((g for g in m.groups()[1:] if g is not None), ""))
        classes = sorted({re.sub(r"\d+", "#", w).replace(">", "#") for w in found.get("class", "").split()})
    words = " ".join(found.values())
    named = tag not in _NEVER_NAMED and bool(words and _NAMES.search(words)) and bool(_NAMES.search(_MODIFIED.sub("", words)))
    return ".".join([tag.replace(">", "#"), *classes]), named


def tokens(source: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, '/' for an end, tag in lower case, attributes) of each tag; the tag is '' for the text behind the last."""
    at, kept, size, last = 0, 0, len(source), source.rfind(">")
    text: list[str] = []
    endless: set[str] = set()  # raw elements of which no end follows
    while True:
        begin = source.find("<", at)
        m = _TAG.match(source, begin) if 0 <= begin < last else None
        if begin < 0 or begin > last or (not m and _STARTED.match(source, begin)):  # no tag is whole from here on
            stop = _OPENED.search(source, begin) if begin >= 0 else None
            yield "".join(text) + source[kept : stop.start() if stop else size], "", "", ""
            return
        if not m:
            if source.startswith("<!--", begin):
                text.append(source[kept:begin])
                end = source.find("-->", begin + 2)
                at = kept = end + 3 if end >= 0 else size
            elif source.startswith(("<!", "<?", "</"), begin):
                text.append(source[kept:begin])
                at = kept = source.find(">", begin) + 1
            else:
                at = begin + 1
            continue
        before, text = "".join(text) + source[kept:begin], []
        tag, attributes, at = m.group(2).lower(), m.group(3), m.end()
        if tag in _RAW and not m.group(1) and not _SELF_CLOSED.search(attributes):
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            if end:
                at = end.start()
            elif tag in ("script", "style"):
                at = size
            else:
                endless.add(tag)
                attributes = "/"
        kept = at
        yield before, m.group(1), tag, attributes


class Page:
    """The kept blocks of a page and its containers; a container comes before those in it."""

    def __init__(self, words: list[str], node: list[int], share: list[int], parent: list[int], name: list[str], named: list[bool], top: int = 0) -> None:
        self.words, self.node, self.share = words, node, share  # of each block: text, container, characters not linked
        self.parent, self.name, self.named, self.top = parent, name, named, top  # container 0 is the page

    def path(self, node: int) -> str:
        names = []
        while node > 0:
            names.append(self.name[node])
            node = self.parent[node]
        return "".join(f">{n}" for n in reversed(names))

    def held(self, inside: list[bool]) -> int:
        return sum(share for node, share in zip(self.node, self.share, strict=True) if inside[node])

    def text(self, path: str | None) -> str:
        inside, own = self.under(self.at(path)), self.under({self.top})
        held, whole = self.held(inside), self.held(own)
        if not any(inside[n] for n in self.node) or (2 * held < whole and whole - held >= LEAST_MISSED):
            inside = own
        return " ".join(words for words, node in zip(self.words, self.node, strict=True) if inside[node])

    def at(self, path: str | None) -> set[int]:
        """The containers of a path."""
        names = path.split(">")[1:] if path else []
        agree = [0 if names else -1]  # how many names a container's path has in common, -1 if it has others
        for i in range(1, len(self.parent)):
            k = agree[self.parent[i]]
            agree.append(k + 1 if 0 <= k < len(names) and self.name[i] == names[k] else -1)
        return {i for i, k in enumerate(agree) if names and k == len(names)}

    def under(self, tops: set[int]) -> list[bool]:
        inside: list[bool] = []
        for i, above in enumerate(self.parent):
            inside.append(i in tops or (above >= 0 and inside[above] and not self.named[i]))
        return inside

    def settle(self, weight: list[float]) -> None:
        """Find the best container and what else belongs to the article."""
        score = [0.0] * len(self.parent)
        for node, share in zip(self.node, self.share, strict=True):
            score[node] += share * weight[node]
        for i in range(len(score) - 1, 0, -1):
            if not self.named[i]:
                score[self.parent[i]] += score[i] / 2
        node = max(range(1, len(score)), key=lambda i: (score[i], -i), default=0)
        node = node if score[node] > 0 else 0
        while node >= 0:  # what holds the best container is no part beside the article
            self.named[node] = False
            node = self.parent[node]
        # the lowest container around all unlinked text that is kept
        kept, count = self.under({0}), [0] * len(self.parent)
        for node, share in zip(self.node, self.share, strict=True):
            count[node] += bool(share and kept[node])
        for i in range(len(count) - 1, 0, -1):
            count[self.parent[i]] += count[i]
        self.top = max(i for i, n in enumerate(count) if n == count[0]) if count[0] else 0


def left_open(every: list[tuple[str, str, str, str]]) -> set[int]:
    """The places of starts that no end tag closes, out of the elements that then end elsewhere."""
    stack: list[int] = []
    open_at: dict[str, list[int]] = {}
    out: set[int] = set()
    for i, (_, end, tag, attributes) in enumerate(every):
        if not end and tag and tag not in _VOID and not _SELF_CLOSED.search(attributes):
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(i)
        elif end and open_at.get(tag):
            at = open_at[tag][-1]
            out.update(j for j in stack[at + 1 :] if every[j][2] in _LEFT_OPEN)
            for j in stack[at:]:
                open_at[every[j][2]].pop()
            del stack[at:]
    out.update(j for j in stack if every[j][2] in _LEFT_OPEN)
    return out


def parsed(source: str) -> Page:
    page = Page([], [], [], [-1], [""], [False])
    every = list(tokens(source))
    unclosed, weight = left_open(every), [1.0]
    stack: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]  # tag, container, dropped, place of the bound
    open_at: dict[str, list[int]] = {}
    left: list[int] = []  # places in the stack of elements that were left open
    text: list[str] = []
    linked, doubtful = 0, -1

    def flush() -> None:
        nonlocal linked
        words = " ".join("".join(text).split())
        text.clear()
        if words and not stack[-1][2]:
            page.words.append(words)
            page.node.append(stack[-1][1])
            page.share.append(max(len(words) - 2 * linked, 0))
        linked = 0

    def pop(to: int) -> None:
        for tag, *_ in stack[to:]:
            open_at[tag].pop()
        del stack[to:]
        while left and left[-1] >= to:
            left.pop()

    for i, (run, end, tag, attributes) in enumerate(every):
        if run and not stack[-1][2]:
            run = html.unescape(run) if "&" in run else run
            text.append(run)
            links = open_at.get("a")
            if links and (links[-1] >= len(stack) - 3 or links[-1] > stack[-1][3]):
                linked += len(run.strip())
        if not tag or tag in _BLOCK:
            flush()
        if not tag:
            continue
        if end:
            if open_at.get(tag):
                pop(open_at[tag][-1])
            continue
        while left and tag in _LEFT_OPEN[stack[left[-1]][0]]:
            pop(left[-1])
            doubtful = len(page.words) if doubtful < 0 else doubtful
        while tag in _ENDS:
            top = max((open_at[c][-1] for c in _ENDS[tag] if open_at.get(c)), default=0)
            if not top or top < stack[-1][3]:
                break
            pop(top)
        if tag in _VOID or (tag == "a" and "href" not in attributes.lower()):
            continue
        _, node, above, bound = stack[-1]
        name, named = _name(tag, attributes)
        if tag in _CONTAINER or (named and tag in _BLOCK):
            page.parent.append(node)
            page.name.append(name)
            page.named.append(named)
            weight.append(0.25 if named else weight[node])
            node = len(weight) - 1
        if _SELF_CLOSED.search(attributes):
            continue
        if i in unclosed:
            left.append(len(stack))
        open_at.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, above or tag in _DROPPED or (named and tag not in _BLOCK), len(stack) if tag in _BOUNDS else bound))
    if doubtful >= 0 and not any(page.share[doubtful:]):  # a page that breaks off in its menu
        for column in (page.words, page.node, page.share):
            del column[doubtful:]
    page.settle(weight)
    return page


def host(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


_BLOCKS = "words array<string>, node array<int>, share array<int>, parent array<int>, name array<string>, named array<boolean>, top int"
#: Pages that are parsed at a time.
_PAGES = 256


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, score) of each page, with its blocks and containers."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _PAGES):
                part = batch.slice(at, _PAGES)
                found = [parsed(source or "") for source in part.column(3).to_pylist()]
                score = [p.held(p.under({p.top})) for p in found]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([p.path(p.top) or None for p in found], pa.string()), pa.array(score, pa.int64()),
                     pa.array([p.words for p in found], pa.list_(pa.string())), *(pa.array([getattr(p, c) for p in found], pa.list_(pa.int32())) for c in ("node", "share", "parent")),
                     pa.array([p.name for p in found], pa.list_(pa.string())), pa.array([p.named for p in found], pa.list_(pa.bool_())), pa.array([p.top for p in found], pa.int32())],
                    names=["page_id", "url", "host", "path", "score", "words", "node", "share", "parent", "name", "named", "top"],
                )

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host(F.col("url")).alias("host"), F.col("html").cast("string"))
    return rows.mapInArrow(parse, f"page_id long, url string, host string, path string, score long, {_BLOCKS}")


def winners(votes: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host, out of (host, path, score)."""
    counted = votes.where("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes"), F.sum("score").alias("score"))
    best = F.max(F.struct("votes", "score", "path"))
    return counted.groupBy("host").agg(best.alias("best")).select("host", F.col("best.path").alias("best"))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, path) of each page."""
    found = cut(blocks(pages), "blocks")
    best = cut(winners(found), "winners")
    few = rows_of(best) <= BROADCAST_HOSTS
    known = found.join(F.broadcast(best), "host", "left") if few else spread_join(found, best, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), _PAGES):
                part = batch.slice(at, _PAGES)
                rows = zip(*(c.to_pylist() for c in part.columns[3:]), strict=True)
                text = [Page(*page).text(path) for *page, path in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), part.column(2)],
                    names=["page_id", "url", "text", "n_chars", "path"],
                )

    return known.select("page_id", "url", F.col("path"), "words", "node", "share", "parent", "name", "named", "top", "best").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long, path string"
    )


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
