"""Main text of web pages by wrapper induction.

Pages of a host are told apart by their layout (the elements around the content). Each layout that enough
pages have gets a reference page, and so does the commonest layout of a host, for the pages of rarer ones.
Pages are aligned with their reference by simple tree matching over their block elements; an aligned node
with the reference's text votes that the node is constant, one with another text that it is a varying slot.
Votes of all pages are added up; nodes that most pages have alike become template and go first, wherever
they stand and whatever they are called. Of the varying slots, menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments go by their elements, roles and names, as their text may
vary too; names alone are overruled where what they name holds nearly all prose of the content. The rest of the content elements is decoded and joined block by block.

A page that repeats four fifths of its reference's main text is a copy of it and does not vote, so copies of one
article don't make it vanish.

Rows: a null or empty html has an empty text and is no reference; a null url is a host of its own; repeated rows
give a row each; a layout's reference is the page of least page_id, of least html if several share that; an empty
table gives an empty result; other columns are not read. Broken markup is read as far as it goes.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a block of pages; pages that a reference must stand for and that must have voted, share of alike votes, of main text that makes a copy.
BLOCK, VOTERS, ALIKE, COPY = 4 << 20, 3, 0.8, 0.8
#: Cells of an alignment that are kept at once; larger alignments are halved until they fit.
CELLS = 1 << 14
#: Levels of elements that tell layouts apart; parts that a host's references are dealt to.
LEVELS, SALTS = 4, 16

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul head".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag closes if it is the innermost open block.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "tbody": {"tr", "td", "th", "thead"}}
OUT = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "video", "audio", "template", "search", "map", "label", "datalist", "math", *RAW}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar menu nav navbar navigation navigator breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay comment comments commentlist replies respond disqus share sharing social related recommended newsletter subscribe signup login pagination pager toolbar widget skip teaser teasers".split()
)
#: Names whose elements go whatever they hold.
COMMENTS = {"comment", "comments", "commentlist", "replies", "respond", "disqus"}
#: Names are overruled where elements that go by name alone hold so many times as much prose of the content as all others.
OVERRULE = 3
HEADS = {"header", "masthead", "topbar"}
MAIN = re.compile(r"(?:^|[^a-z])(?:article|content|post|entry|story|main)(?:[^a-z]|$)")


@dataclass
class Node:
    tag: str
    parent: Node | None
    out: bool
    named: bool = False
    kids: list[Node] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    main: int = 0
    sign: int = 0
    size: int = 1

    def own(self) -> str:
        return " ".join(entities.unescape("".join(self.text)).split())


class Page:
    """A page's tree of block elements and its texts in order; flow: (block, text), text None at a block's edge."""

    def __init__(self, source: str):
        self.root = Node("", None, False)
        self.nodes: list[Node] = []
        self.flow: list[tuple[Node, str | None]] = []
        self.linked: set[int] = set()  # entries of the flow inside links
        self._read(source)
        self.names = not self._overruled()
        for node in [*reversed(self.nodes), self.root]:
            node.sign = hash((node.tag, tuple(k.sign for k in node.kids)))
            node.size = 1 + sum(k.size for k in node.kids)

    def _read(self, source: str) -> None:
        at, size, node = 0, len(source), self.root
        dark: list[tuple[str, Node, bool]] = []  # open inline elements that are left out, the blocks that hold them, whether they are closed later
        linked = False
        while at < size:
            m = TOKEN.search(source, at)
            end = m.start() if m else size
            if end > at and not dark:
                if linked:
                    self.linked.add(len(self.flow))
                node.text.append(source[at:end])
                self.flow.append((node, source[at:end]))
            if not m:
                return
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if tag == "a":
                linked = not m[1]
            if m[1]:
                if tag in BLOCKS:
                    node = self._close(node, tag)
                    linked = False
                    if dark:  # what a block holds ends with it
                        above = self._above(node)
                        dark = [x for x in dark if x[2] and id(x[1]) in above]
                elif any(x[0] == tag for x in dark):
                    del dark[next(k for k in reversed(range(len(dark))) if dark[k][0] == tag) :]
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else size
            elif tag == "br":
                node.text.append(" ")
                self.flow.append((node, " "))
            elif tag in BLOCKS:
                dark = [x for x in dark if x[2]]
                node = self._open(node, tag, m[3])
            elif tag in OUT and tag not in VOID and not m[3].endswith("/"):
                # one whose end tag doesn't come before another one of its kind ends at the next block's edge
                after = re.compile(rf"<(/?){tag}\b", re.I).search(source, at)
                dark = [x for x in dark if x[2] or x[0] != tag]
                dark.append((tag, node, bool(after and after[1])))

    def _open(self, node: Node, tag: str, attributes: str) -> Node:
        while node.tag == "p" or node.tag in CLOSES.get(tag, ()) or (node.tag in HEADINGS and tag in HEADINGS):
            node = node.parent
        self.flow.append((node, None))
        if tag == "hr":
            return node
        new = Node(tag, node, node.out or tag in OUT, node.named)
        inside, heads = node.main, False
        if attributes.strip():
            given = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attributes)}
            names = f"{given.get('class', '')} {given.get('id', '')}"
            new.out |= given.get("role") in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "")
            if tag not in ("html", "body", "article", "main"):
                parts = re.split(r"[^a-z0-9]+", names)
                new.out |= not COMMENTS.isdisjoint(parts)
                new.named |= not NAMES.isdisjoint(parts)
                heads = not HEADS.isdisjoint(parts)
            if given.get("role") == "main":
                new.main = 2
            elif tag in ("div", "section", "td") and not heads and MAIN.search(names):
                new.main = 1
        if tag == "article":
            new.main = 3
        elif tag == "main":
            new.main = 2
        # a page's header goes; an article's own keeps its headings only
        if tag == "header" or heads:
            new.out |= inside == 0
        elif node.tag in ("header", "hgroup") and tag not in HEADINGS and tag != "hgroup":
            new.out = True
        new.main = max(new.main, inside)
        node.kids.append(new)
        self.nodes.append(new)
        return new

    @staticmethod
    def _above(node: Node | None) -> set[int]:
        """The node and all nodes around it."""
        out = set()
        while node:
            out.add(id(node))
            node = node.parent
        return out

    def _overruled(self) -> bool:
        """Whether elements that go by name alone hold the content, so that the names mean something else."""
        kept = named = 0
        for k, (node, text) in enumerate(self.flow):
            if text and node.main and not node.out:
                size = len(text.strip())
                if not node.named:
                    kept += size
                elif k not in self.linked:
                    named += size
        return named > 0 and named >= OVERRULE * kept

    def gone(self, node: Node) -> bool:
        return node.out or (self.names and node.named)

    def _close(self, node: Node, tag: str) -> Node:
        place: Node | None = node
        while place and place.tag != tag:
            place = place.parent
        if place is None or place is self.root:
            return node
        self.flow.append((place.parent, None))
        return place.parent

    def layout(self) -> int:
        """Tells layouts apart: the upper elements outside the content, runs of equal ones as one."""

        def shape(node: Node, levels: int) -> str:
            if not levels or node.main:
                return node.tag
            kids = [shape(k, levels - 1) for k in node.kids]
            return f"{node.tag}({','.join(k for k, before in zip(kids, [None, *kids], strict=False) if k != before)})"

        return xxhash.xxh64_intdigest(shape(self.root, LEVELS).encode()) >> 1

    def regions(self, template: set[int]) -> list[Node]:
        """The content elements in page order: those of the best kind if they hold half of what all hold, else all.

        A first heading before them belongs to them if they have none of their own. Without such elements it is the whole page.
        """
        held = {id(n): 0 for n in [self.root, *self.nodes]}
        for node, text in self.flow:
            if text and not self.gone(node) and id(node) not in template:
                held[id(node)] += len(text.strip())
        for node in reversed(self.nodes):
            held[id(node.parent)] += held[id(node)]
        tops = {k: [n for n in self.nodes if not self.gone(n) and n.main >= k > n.parent.main] for k in (1, 2, 3)}
        total = sum(held[id(n)] for n in tops[1])
        found = next((tops[k] for k in (3, 2) if tops[k] and 2 * sum(held[id(n)] for n in tops[k]) >= total), tops[1])
        if not found:
            return [self.root]
        inside = self.within(found)
        heads = [n for n in self.nodes if n.tag == "h1" and not self.gone(n) and held[id(n)]]
        if not any(inside[id(n)] for n in heads):
            place = {id(n): k for k, n in enumerate(self.nodes)}
            found = [n for n in heads[:1] if place[id(n)] < place[id(found[0])]] + found
        return found

    def within(self, tops: list[Node]) -> dict[int, bool]:
        own = set(map(id, tops))
        inside = {id(self.root): id(self.root) in own}
        for node in self.nodes:
            inside[id(node)] = inside[id(node.parent)] or id(node) in own
        return inside

    def blocks(self, template: set[int] = frozenset()) -> list[tuple[list[Node], str]]:
        """The main text's blocks, each with the nodes whose texts it has."""
        inside = self.within(self.regions(template))
        out: list[tuple[list[Node], str]] = []
        held: list[str] = []
        owners: list[Node] = []
        for node, text in [*self.flow, (self.root, None)]:
            if text is None:
                if held and (words := " ".join(entities.unescape("".join(held)).split())):
                    out.append((owners, words))
                held, owners = [], []
            elif not self.gone(node) and id(node) not in template and inside[id(node)] and node.tag not in ("header", "hgroup"):
                owners.append(node)
                held.append(text)
        return out


class Matcher:
    """Simple tree matching: the largest number of pairs of nodes with equal tags that keeps parents and order."""

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}

    def _simple(self, a: Node, b: Node) -> int | None:
        return 0 if a.tag != b.tag else a.size if a.sign == b.sign else self.known.get((a.sign, b.sign))

    def score(self, a: Node, b: Node) -> int:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._simple(x, y) is None:
                _, left, right, _ = self.middle(x.kids, y.kids)
                distinct = [list({n.sign: n for n in own}.values()) for own in (left, right)]
                open_ = [(u, v) for u in distinct[0] for v in distinct[1] if self._simple(u, v) is None]
                if open_:
                    todo += open_
                    continue
                self.known[x.sign, y.sign] = 1 + sum(self._simple(u, v) for u, v in self.children(x.kids, y.kids))
            todo.pop()
        return self._simple(a, b)

    @staticmethod
    def middle(left: list[Node], right: list[Node]) -> tuple[list[tuple[Node, Node]], list[Node], list[Node], list[tuple[Node, Node]]]:
        """Equal children at both ends are pairs of a best alignment; what is between them."""
        head = 0
        while head < min(len(left), len(right)) and left[head].sign == right[head].sign:
            head += 1
        tail = 0
        while tail < min(len(left), len(right)) - head and left[-1 - tail].sign == right[-1 - tail].sign:
            tail += 1
        ends = len(left) - tail, len(right) - tail
        return list(zip(left[:head], right[:head], strict=True)), left[head : ends[0]], right[head : ends[1]], list(zip(left[ends[0] :], right[ends[1] :], strict=True))

    def children(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        first, left, right, last = self.middle(left, right)
        return first + self._best(left, right) + last

    def _row(self, a: Node, right: list[Node]) -> np.ndarray:
        of: dict[int, int] = {}
        return np.array([of[b.sign] if b.sign in of else of.setdefault(b.sign, self.score(a, b)) for b in right], np.int64)

    def _totals(self, left: list[Node], right: list[Node]) -> np.ndarray:
        """The best alignment's weight of all of left with each prefix of right."""
        above = np.zeros(len(right) + 1, np.int64)
        for a in left:
            row = np.append(0, np.maximum(above[1:], above[:-1] + self._row(a, right)))
            above = np.maximum.accumulate(row)
        return above

    def _best(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        if not left or not right:
            return []
        if len(left) == 1:
            row = self._row(left[0], right)
            return [(left[0], right[int(row.argmax())])] if row.max() else []
        if len(left) * len(right) > CELLS:
            half = len(left) // 2
            both = self._totals(left[:half], right) + self._totals(left[half:][::-1], right[::-1])[::-1]
            at = int(both.argmax())
            return self._best(left[:half], right[:at]) + self._best(left[half:], right[at:])
        rows = [[0] * (len(right) + 1)]
        for a in left:
            above, row = rows[-1], [0]
            for j, b in enumerate(right):
                row.append(max(above[j + 1], row[j], above[j] + self.score(a, b)))
            rows.append(row)
        i, j, out = len(left), len(right), []
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((left[i], right[j]))
        return out[::-1]

    def pairs(self, a: Node, b: Node) -> Iterator[tuple[Node, Node]]:
        if len(self.known) > 200_000:
            self.known.clear()
        self.score(a, b)
        todo = [(a, b)]
        while todo:
            pair = todo.pop()
            yield pair
            todo += self.children(pair[0].kids, pair[1].kids)


class Reference:
    """A layout's reference page, its nodes numbered, and their texts."""

    def __init__(self, source: str):
        self.page = Page(source)
        self.number = {id(n): k for k, n in enumerate(self.page.nodes)}
        self.texts = {k: t for k, n in enumerate(self.page.nodes) if (t := n.own())}
        self.main = {self.number[id(n)] for owners, _ in self.page.blocks() for n in owners if id(n) in self.number} & self.texts.keys()

    def _aligned(self, page: Page, match: Matcher) -> list[tuple[int, Node]]:
        return [(k, b) for a, b in match.pairs(self.page.root, page.root) if (k := self.number.get(id(a), -1)) in self.texts]

    def votes(self, page: Page, match: Matcher) -> list[tuple[int, bool]]:
        """Whether each aligned node has the reference's text; a copy has no votes."""
        found = [(k, b.own() == self.texts[k]) for k, b in self._aligned(page, match)]
        same = sum(len(self.texts[k]) for k, alike in found if alike and k in self.main)
        return [] if same and same >= COPY * sum(len(self.texts[k]) for k in self.main) else found

    def template(self, page: Page, match: Matcher, constant: set[int]) -> set[int]:
        """The page's nodes that have a constant node's place and text."""
        return {id(b) for k, b in self._aligned(page, match) if k in constant and b.own() == self.texts[k]} if constant else set()


def main_text(page: Page, template: set[int]) -> str:
    return "\n\n".join(t for _, t in page.blocks(template))


def host_of(url: str) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_template: nodes that votes removed) for every row."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("__host"), common.text_of(html).alias("__html"))
    base = common.blocks(rows, BLOCK)

    def sources(payload) -> Iterator[tuple[object, str, str]]:
        table = common.unpacked(payload.as_buffer())
        yield from zip(table["page_id"].to_pylist(), table["__host"].to_pylist(), table["__html"].to_pylist(), strict=True)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each layout of a host in a block: its pages, and the first page."""
        for batch in batches:
            for block, payload in zip(batch["block"].to_pylist(), batch["payload"], strict=True):
                counts: dict[tuple[str, int], int] = {}
                first: dict[tuple[str, int], tuple] = {}
                for name, host, source in sources(payload):
                    page = Page(source)
                    key = host, page.layout()
                    counts[key] = counts.get(key, 0) + any(n.own() for n in page.nodes)
                    own = (name is None, name or 0, source)
                    first[key] = min(first.get(key, own), own) if source else first.get(key, own)
                keys = list(counts)
                columns = ([block] * len(keys), pa.int64()), ([h for h, _ in keys], pa.string()), ([x for _, x in keys], pa.int64()), ([counts[k] for k in keys], pa.int64()), ([None if first[k][0] else first[k][1] for k in keys], pa.int64()), ([first[k][2] if counts[k] else None for k in keys], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(*x) for x in columns], names=["block", "host", "layout", "pages", "page", "html"])

    seen = common.stored(base.mapInArrow(common.lean(survey), "block long, host string, layout long, pages long, page long, html string"), "layouts")
    first = F.min(F.when(F.col("html").isNotNull(), F.struct(F.col("page").isNull().alias("none"), "page", "html"))).alias("first")
    layouts = common.stored(seen.groupBy("host", "layout").agg(F.sum("pages").alias("pages"), first).where("pages > 0").select("host", "layout", "pages", F.col("first.html").alias("reference")), "references")
    main = layouts.groupBy("host").agg(F.max(F.struct("pages", "layout")).alias("main")).select("host", F.col("main.layout").alias("main"))
    # the layout whose reference a page is aligned with
    of = layouts.join(main, "host").select("host", "layout", F.when(F.col("pages") >= VOTERS, F.col("layout")).otherwise(F.col("main")).alias("by"))
    wanted = common.stored(seen.select("block", "host", "layout").join(of, ["host", "layout"]).select("block", "host", "layout", "by"), "wanted")

    def told(references: DataFrame) -> DataFrame:
        """For each block the references that its pages need; a large host's are dealt out."""
        salted = references.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("layout", "by")
        return wanted.withColumn("salt", F.pmod("block", F.lit(SALTS)).cast("int")).join(salted, ["host", "by", "salt"]).drop("salt")

    def by_layout(right: pa.Table, *columns: str) -> dict[tuple[str, int], tuple]:
        made: dict[tuple[str, int], Reference] = {}
        out = {}
        for host, layout, by, source, *rest in zip(*(right[c].to_pylist() for c in ("host", "layout", "by", "reference", *columns)), strict=True):
            if (host, by) not in made:
                made[host, by] = Reference(source)
            out[host, layout] = (by, made[host, by], *rest)
        return out

    def vote(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = by_layout(right)
        counts: dict[tuple[str, int, int], list[int]] = {}
        match = Matcher()
        for _, host, source in sources(left["payload"][0]):
            page = Page(source)
            by, reference = known.get((host, page.layout()), (0, None))
            for k, alike in reference.votes(page, match) if reference else ():
                counts.setdefault((host, by, k), [0, 0])[alike] += 1
        keys = list(counts)
        return pa.table({"host": pa.array([k[0] for k in keys], pa.string()), "layout": pa.array([k[1] for k in keys], pa.int64()), "node": pa.array([k[2] for k in keys], pa.int32()), "other": pa.array([counts[k][0] for k in keys], pa.int64()), "alike": pa.array([counts[k][1] for k in keys], pa.int64())})

    references = layouts.select("host", "layout", "reference")
    votes = base.groupBy("block").cogroup(told(references).groupBy("block")).applyInArrow(common.lean_group(vote), "host string, layout long, node int, other long, alike long")
    summed = votes.groupBy("host", "layout", "node").agg(F.sum("other").alias("other"), F.sum("alike").alias("alike"))
    constant = summed.where((F.col("alike") + F.col("other") >= VOTERS) & (F.col("alike") >= ALIKE * (F.col("alike") + F.col("other"))))
    templates = constant.groupBy("host", "layout").agg(F.collect_list("node").alias("nodes"))
    schema = rows.select("page_id", "url").schema.add("text", "string").add("n_template", "long")

    def finish(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        known = by_layout(right, "nodes")
        match, texts, gone = Matcher(), [], []
        for _, host, source in sources(left["payload"][0]):
            page = Page(source)
            _, reference, nodes = known.get((host, page.layout()), (0, None, ()))
            template = reference.template(page, match, set(nodes)) if reference else set()
            texts.append(main_text(page, template))
            gone.append(len(template))
        table = common.unpacked(left["payload"][0].as_buffer())
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_template": pa.array(gone, pa.int64())})

    return base.groupBy("block").cogroup(told(references.join(templates, ["host", "layout"])).groupBy("block")).applyInArrow(common.lean_group(finish), schema)
