"""Main text of web pages by consensus paths per host.

Each page is read into a light tree in which menus, headers, footers, sidebars,
notices, adverts, forms, scripts and comments are marked by tag, role or class.
What names or forms mark is kept where it holds most of the page's text or its
only article. The first pass finds the texts that repeat in one container from
page to page of a host: boilerplate without a mark. Another text in such a
container is no boilerplate. A page's best container is
the deepest one outside of which only boilerplate is left. Its generalised
tag-class path is the page's vote in the second pass, weighted
by how much text it stands for; Spark adds up the votes of each host. In the third pass every
page is extracted again with the winning path of its host: where the votes
found the main text, what is left outside and stands in links alone (lists of other
pages, without a mark and other on each page) goes, too. Where the path is
missing, or leaves out text that is neither boilerplate nor a link, the
page's own best container is taken.
"""

from __future__ import annotations

import hashlib
import html as html_module
import math
import re
from collections import Counter
from collections.abc import Generator, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, materialise

#: Pages of a host on which a container's own text must be the same to be boilerplate; they must be most pages with that container.
REPEATS = 3
#: A repeated text is boilerplate of a path if it is on one of so many pages with that path, and a path is judged if it is on one of so many pages of the host: what is known of a host has a bound.
TEXT_SHARE, PATH_SHARE = 50, 1000

#: Elements without an end tag, elements whose content is no text, and boilerplate elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg select title".split())
DROPPED_TAGS = frozenset("nav footer aside form button dialog menu head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs"
    " pagination pager toolbar header masthead footer sidebar sidebars widget widgets related recommended recommendations share sharing social"
    " comment comments commentlist disqus respond replies reply cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " signup login search searchbox form skip".split()
)
#: Names of blocks that stay dropped when they are longer than the main text.
OUTSIDE_NAMES = frozenset("comment comments commentlist disqus respond replies reply cookie cookies consent gdpr".split())
#: Words that make no other thing of a boilerplate name in one class ('share-buttons'), and those that do so for 'header'.
SITE_WORDS = frozenset("site global top website blog".split())
PLAIN_WORDS = SITE_WORDS | frozenset(
    "page main primary secondary bottom left right inner outer mobile desktop sticky fixed google box block bar area list links link items item buttons button icons icon"
    " wrap wrapper container section panel slot unit zone row column col group posts post articles stories entries thread tags cart".split()
)
#: Tags and roles that say what a block is, whatever it holds; forms and headers may wrap a whole page.
FIRM_TAGS = DROPPED_TAGS - {"form"}
FIRM_ROLES = DROPPED_ROLES - {"banner", "search", "form", "alert"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose ids are judged: those of headings, list items and the like are made from their text.
ID_TAGS = frozenset("div section ul ol table td center".split())
#: Why an element is dropped: not shown, by its kind, by a name; FORM and NAME give way to the page's main text.
HIDDEN, FIRM, FORM, NAME_ONLY = 1, 2, 3, 4
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset("html p ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre h1 h2 h3 h4 h5 h6 header figure figcaption address hr br details summary fieldset".split() + sorted(DROPPED_TAGS))
#: An element of the key ends open elements of the value that aren't outside a container or list.
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {t: {"p"} for t in (CONTAINERS | frozenset("ul ol dl table h1 h2 h3 h4 h5 h6 pre blockquote header figure address hr".split())) - {"td", "body"}}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

#: A tag with its quotes in order, and one whose quotes don't close.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)([^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: Characters of a path from which its beginning is a digest, so that deep nesting costs no more than its depth.
LONG_PATH = 300
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?=[\s/]|$))""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


#: By path the digests of the texts that are boilerplate there.
Known = Mapping[str, frozenset[int]]


@dataclass
class Node:
    """size: the kept text below; core: the part of it that isn't boilerplate; plain: that outside links; prose: the shown text outside links."""

    parent: int
    tag: str
    path: str
    why: int
    candidate: bool
    dropped: bool = False
    size: int = 0
    core: int = 0
    plain: int = 0
    prose: int = 0
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """nodes: containers and dropped elements in page order; pieces: (node, text) in page order, block borders as spaces; linked: whether each piece is in a link."""

    nodes: list[Node]
    pieces: list[tuple[int, str]]
    linked: list[bool]

    def below(self, roots: set[int]) -> set[int]:
        found = set()
        for i, node in enumerate(self.nodes):
            if i in roots or node.parent in found:
                found.add(i)
        return found

    def text(self, roots: set[int]) -> str:
        inside = self.below(roots)
        return " ".join("".join(t for i, t in self.pieces if i in inside and (t == " " or not self.nodes[i].dropped)).split())

    def regions(self) -> dict[str, str]:
        """The kept text of each path that is in no container further down, without paths that have none."""
        own: dict[str, list[str]] = {}
        for i, t in self.pieces:
            if not self.nodes[i].dropped:
                own.setdefault(self.nodes[i].path, []).append(t)
        return {p: t for p, ts in own.items() if (t := " ".join("".join(ts).split()))}

    def judge(self, known: Known) -> None:
        """Work out `core` and `plain` for a host's boilerplate: paths and the texts that repeat there. All text counts on pages with nothing else."""
        boilerplate = {p for p, t in self.regions().items() if p in known and _digest(t) in known[p]} if known else ()
        for node in self.nodes:
            node.core = node.plain = 0
        for (i, t), link in zip(self.pieces, self.linked, strict=True):
            node = self.nodes[i]
            if not node.dropped and node.path not in boilerplate and not t.isspace():
                node.core += len(t)
                node.plain += 0 if link else len(t)
        for i in range(len(self.nodes) - 1, 0, -1):
            self.nodes[self.nodes[i].parent].core += self.nodes[i].core
            self.nodes[self.nodes[i].parent].plain += self.nodes[i].plain
        if not self.nodes[0].core:
            for node in self.nodes:
                node.core = node.size

    def best(self) -> int:
        """The deepest container outside of which only boilerplate is left, -1 without text; an article is never cut."""
        if not self.nodes[0].core:
            return -1
        at = best = 0
        while self.nodes[best].tag != "article":
            at = next((i for i in self.nodes[at].children if self.nodes[i].core == self.nodes[best].core), -1)
            if at < 0:
                break
            best = at if self.nodes[at].candidate else best
        return best


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): html_module.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)} if text else {}


def _is_boilerplate(name: str, in_article: bool) -> bool:
    """Whether one whole class or id names boilerplate: its words do, besides words that make no other thing of it."""
    words = [w.lower() for w in NAME.findall(name)]
    marks = DROPPED_NAMES.intersection(words)
    if marks == {"header"}:
        return not in_article and all(w == "header" or w in SITE_WORDS for w in words)
    return bool(marks) and all(w in marks or w in PLAIN_WORDS for w in words)


def _why_dropped(tag: str, attributes: dict[str, str], open_tags: Counter) -> int:
    """Why an element isn't main text, judged by itself and the elements it is in; 0 if it may be."""
    if tag in ("html", "body") or not (attributes or tag in DROPPED_TAGS or tag == "header"):
        return 0
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return HIDDEN
    in_article = open_tags["article"] or open_tags["main"]
    role = attributes.get("role", "").lower()
    if tag in FIRM_TAGS or role in FIRM_ROLES:
        return FIRM
    if tag == "form" or (tag == "header" and not in_article) or role in DROPPED_ROLES:
        return FORM
    if not attributes or tag in HEADINGS or tag in ("article", "main", "pre", "code") or open_tags["pre"] or open_tags["code"]:
        return 0
    classes = attributes.get("class", "").split()
    names = [n for n in classes if _is_boilerplate(n, in_article)]
    made = tag == "section" or "section" in classes  # ids of sections are mostly made from their headings
    if tag in ID_TAGS and (own := attributes.get("id", "")) and _is_boilerplate(own, in_article) and (not made or not OUTSIDE_NAMES.isdisjoint(NAME.findall(own.lower()))):
        names.append(own)
    if not names:
        return 0
    return FIRM if any(not OUTSIDE_NAMES.isdisjoint(w.lower() for w in NAME.findall(n)) for n in names) else NAME_ONLY


def _drop(nodes: list[Node]) -> None:
    """Mark what is dropped. Names, forms and headers never drop most of the page's text or its only article."""
    hidden, shown = [False] * len(nodes), {"main": [], "article": []}
    for i, node in enumerate(nodes[1:], 1):
        hidden[i] = node.why == HIDDEN or hidden[node.parent]
        if node.tag in shown and not hidden[i]:
            shown[node.tag].append(i)
    articles = set(shown["article"])
    outer = _outermost(nodes, articles)
    only = shown["main"] if len(shown["main"]) == 1 else outer if not shown["main"] and len(outer) == 1 else []
    holders = set()
    at = only[0] if only else -1
    while at >= 0:
        holders.add(at)
        at = nodes[at].parent
    for i, node in enumerate(nodes[1:], 1):
        most = 2 * node.prose > nodes[0].prose
        stays = (most or i in holders) if node.why in (FORM, NAME_ONLY) else i in holders and (most or nodes[only[0]].tag == "main")
        node.dropped = nodes[node.parent].dropped or (node.why != 0 and (node.why == HIDDEN or not stays))


def _outermost(nodes: list[Node], of: set[int]) -> list[int]:
    """Those of the given nodes that are in none of the others."""
    inside, out = [False] * len(nodes), []
    for i, node in enumerate(nodes):
        above = node.parent >= 0 and inside[node.parent]
        inside[i] = above or i in of
        if i in of and not above:
            out.append(i)
    return out


def _tags(html: str) -> Generator[tuple[int, int, str, str, str], int | None, None]:
    """Tags (start, end, slash, name, attributes) in order; comments and declarations without a name. Time is linear in the text."""
    at, last = 0, html.rfind(">")
    while (start := html.find("<", at)) >= 0:
        follows = html[start + 1 : start + 4]
        if follows == "!--":
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
        elif follows[:1] in ("!", "?"):
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
        elif start < last and (m := TAG.match(html, start) or LOOSE_TAG.match(html, start)):
            at = yield start, m.end(), m[1], m[2].lower(), m[3]
            at = m.end() if at is None else at
            continue
        elif start >= last:
            return
        else:
            at = start + 1
            continue
        yield start, at, "", "", ""


def read_page(html: str | None) -> Page:
    """The containers and text of a page, its character references decoded.

    Malformed markup is read as far as it makes sense.
    """
    html = html or ""
    nodes = [Node(-1, "", "", 0, True)]
    pieces: list[tuple[int, str]] = []
    linked: list[bool] = []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, in a link or hidden
    open_tags: Counter = Counter()  # how often each tag is in the stack
    at, lower = 0, None

    def add(text: str) -> None:
        if text:
            pieces.append((stack[-1][1], html_module.unescape(text) if "&" in text else text))
            linked.append(stack[-1][2])
            if not stack[-1][2]:
                nodes[stack[-1][1]].prose += len("".join(text.split()))

    def close(k: int) -> None:
        for t, _, _ in stack[k:]:
            open_tags[t] -= 1
        del stack[k:]

    tags = _tags(html)
    found = next(tags, None)
    while found is not None:
        start, end, slash, tag, inside = found
        add(html[at:start])
        at = end
        if not tag:
            found = next(tags, None)
            continue
        if slash:
            for k in range(len(stack) - 1, 0, -1) if open_tags[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
            if tag in BLOCKS:
                pieces.append((stack[-1][1], " "))
                linked.append(False)
            found = next(tags, None)
            continue
        if tag in RAW:
            if not inside.endswith("/"):
                lower = html.lower() if lower is None else lower
                stop = lower.find(f"</{tag}", at)
                stop = html.find(">", stop) if stop >= 0 else -1
                at = len(html) if stop < 0 else stop + 1
            found = _sent(tags, at)
            continue
        if tag in BLOCKS:
            ends = ENDS.get(tag, ())
            scope = SCOPES.get(tag, CONTAINERS | {"ul", "ol", "dl", "table", "blockquote"})
            for k in range(len(stack) - 1, 0, -1) if any(open_tags[t] for t in ends) else ():
                if stack[k][0] in ends:
                    close(k)
                    break
                if stack[k][0] in scope:
                    break
            pieces.append((stack[-1][1], " "))
            linked.append(False)
        if not (tag in VOID or inside.endswith("/")):
            _, container, aside = stack[-1]
            attributes = _attributes(inside)
            why = _why_dropped(tag, attributes, open_tags)
            if why or tag in CONTAINERS:
                path, candidate = nodes[container].path, tag in CONTAINERS
                if candidate:
                    names = ".".join(sorted(set(re.sub(r"\d+", "#", attributes.get("class", "")).split())))
                    path = f"{path if len(path) < LONG_PATH else f'~{_digest(path):x}'}/{tag}{'.' + names if names else ''}"
                nodes.append(Node(container, tag, path, why, candidate))
                nodes[container].children.append(len(nodes) - 1)
                container = len(nodes) - 1
            stack.append((tag, container, aside or why == HIDDEN or (tag == "a" and "href" in inside.lower())))
            open_tags[tag] += 1
        found = next(tags, None)
    add(html[at:])
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].prose += nodes[i].prose
    _drop(nodes)
    page = Page(nodes, pieces, linked)
    if all(nodes[i].dropped or t.isspace() for i, t in pieces):  # nothing is left: names may mislead
        for i, node in enumerate(nodes[1:], 1):
            node.dropped = nodes[node.parent].dropped or node.why in (HIDDEN, FIRM)
    for i, t in pieces:
        nodes[i].size += 0 if nodes[i].dropped or t.isspace() else len(t)
    for i in range(len(nodes) - 1, 0, -1):
        nodes[nodes[i].parent].size += nodes[i].size
    page.judge({})
    return page


def _sent(tags: Generator, at: int) -> tuple[int, int, str, str, str] | None:
    """The next tag from `at` on."""
    try:
        return tags.send(at)
    except StopIteration:
        return None


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def own_texts(html: str | None) -> list[tuple[str, int, int]]:
    """(path, digest of its own text, digest of the page's text) of each path with text of its own, and one for the page, without a path."""
    regions = read_page(html).regions()
    whole = _digest("\n".join(regions.values()))
    return [("", 0, whole), *[(p, _digest(t), whole) for p, t in regions.items() if p]]


def vote(html: str | None, known: Known | None = None) -> tuple[str, float]:
    """The path of a page's best container and the weight of that vote."""
    page = read_page(html)
    page.judge(known or {})
    best = page.best()
    return (page.nodes[best].path, math.log1p(page.nodes[best].size)) if best >= 0 else ("", 0.0)


def extract(html: str | None, path: str | None, known: Known | None = None) -> tuple[str, str]:
    """The text below all containers with the given path, or below the page's own best one, and the path used.

    The given path is used where it leaves out nothing but boilerplate and links.
    """
    page = read_page(html)
    page.judge(known or {})
    own = page.best()
    if own < 0:
        return "", ""
    wanted = {i for i, n in enumerate(page.nodes) if path and n.path == path and n.candidate and not n.dropped}
    top, whole = _outermost(page.nodes, wanted), page.nodes[0]
    if sum(page.nodes[i].core for i in top) == whole.core or (whole.plain and sum(page.nodes[i].plain for i in top) == whole.plain):
        return page.text(wanted), path
    return page.text({own}), page.nodes[own].path


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and a leading www; '' where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


def text_counts(pages: DataFrame) -> DataFrame:
    """host, path, own, n, differ: on how many pages of a host a path has which text of its own, and whether those pages differ; written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, *r) for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in own_texts(page)]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["host", "path", "own", "whole"])

    texts = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, own long, whole long")
    return materialise(texts.groupBy("host", "path", "own").agg(F.count(F.lit(1)).alias("n"), (F.min("whole") != F.max("whole")).alias("differ")), "host-texts")


def host_boilerplate(counts: DataFrame) -> DataFrame:
    """host, boilerplate: by path the digests of the texts that are boilerplate there, from `text_counts`.

    A text repeats if REPEATS pages have it in a path that aren't all copies of
    one page. A path is judged if most pages with it have a text that repeats;
    there the texts on one of TEXT_SHARE pages with the path or more are boilerplate.
    """
    repeats = F.col("differ") & (F.col("n") >= REPEATS)
    paths = counts.groupBy("host", "path").agg(F.sum(F.when(repeats, F.col("n")).otherwise(0)).alias("repeated"), F.sum("n").alias("total"))
    sizes = paths.filter("path = ''").select("host", F.col("total").alias("pages"))
    judged = paths.filter("path <> '' AND 2 * repeated > total").join(sizes, "host").filter(F.col("total") * PATH_SHARE >= F.col("pages")).select("host", "path", "total")
    frequent = counts.filter(repeats & (F.col("path") != "")).join(judged, ["host", "path"]).filter(F.col("n") * TEXT_SHARE >= F.col("total"))
    by_path = frequent.groupBy("host", "path").agg(F.sort_array(F.collect_list("own")).alias("texts"))  # TEXT_SHARE at most
    return by_path.groupBy("host").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("path", "texts")))).alias("boilerplate"))


def _known(entries: list[tuple[str, list[int]]] | None) -> Known:
    return {p: frozenset(texts) for p, texts in entries or ()}


def host_paths(pages: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """host, path: the path with the most votes on each host; ties go to the path that sorts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [vote(h, _known(b)) for h, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v[0] for v in votes], pa.string()), pa.array([v[1] for v in votes], pa.float64())], ["host", "path", "weight"])

    rows = pages.select(host_of(F.col("url")).alias("host"), "html").join(boilerplate, "host", "left").select("host", "html", "boilerplate")
    votes = rows.mapInArrow(run, "host string, path string, weight double")
    sums = votes.filter("path <> ''").groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    best = Window.partitionBy("host").orderBy(F.col("weight").desc(), "path")
    return sums.withColumn("n", F.row_number().over(best)).filter("n = 1").select("host", "path")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, text, n_chars of every page.

    White space inside a block becomes one space and blocks are joined by one.
    Null or empty pages, and pages with nothing but boilerplate, have the text
    ''. A null url has the host ''. Repeated rows are extracted each. An empty
    table gives no rows. Other columns aren't read.
    """
    counts = text_counts(pages)
    known = materialise(host_boilerplate(counts), "host-boilerplate")
    discard(counts)
    winners = materialise(host_paths(pages, known).join(known, "host", "left"), "host-paths")
    discard(known)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    joined = rows.join(winners, "host", "left").select("page_id", "url", "host", "path", "html", "boilerplate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(h, p, _known(b)) for h, p, b in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([len(f[0]) for f in found], pa.int64())], ["page_id", "url", "host", "path", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, host string, path string, text string, n_chars long")
