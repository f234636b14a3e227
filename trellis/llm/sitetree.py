"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree: an element node is a path of tags
with their classes and ids, a style node is the sequence of child elements that a page
shows there. From the pages' counts of style nodes and of contents each element node
gets an importance between 0 and 1: layout that all pages of a site share and text that
repeats have low entropy and are noise, what differs from page to page is content. Nodes
that the markup names (article or navigation, say) need no statistics; the others go by
the importance that their host's tree gives them, or the tree of all hosts where the
host shows too few pages. Branches of nothing but noise and low nodes are removed from
each page and the rest is read as blocks. Statistics decide on paths, never on single
texts, so a passage that many pages quote stays where other text of its path differs.
A class name that sounds like noise, or a form, is a suspicion only: such a branch goes if
it holds no content element and the tree finds it low or has too few pages to tell. Names of
reader comments, adverts, sharing, cookie and subscription boxes are more than that, as
such texts differ from page to page: their branches go unless they wrap the page, that is
hold its only content element or half of its text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.llm.common import materialise, slices, texts_of
from trellis.session import broadcast_if_small

MIN_PAGES = 8
THRESHOLD = 0.3
DAMPING = 0.9

# Elements of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title svg math object select".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd a b i em strong span blockquote pre td th".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT_TAGS = frozenset("article main".split())
NOISE_TAGS = frozenset("nav aside footer button dialog menu head".split()) | RAW
# Class, id and role names (whole ones) that make a branch suspect.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended widget comment comments respond reply "
    "replies disqus pagination pager skip toolbar search form contentinfo complementary".split()
)
# Names of reader comments, adverts and boxes, alone or as the first part of a name with one of the second parts.
FOREIGN_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments reply replies respond disqus share sharing "
    "social cookie cookies consent gdpr newsletter subscribe subscription".split()
)
FOREIGN_PARTS = frozenset(
    "area author banner bar block body box buttons container content form item label links list meta modal panel popup section slot text "
    "thread unit widget wrap wrapper".split()
)
# elements that a start tag closes, and the elements it does not look beyond
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S
)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    """An element with its children; texts are children of type str."""

    __slots__ = ("tag", "names", "children", "holds", "foreign", "wraps")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children = tag, names, []
        # a content element inside; a branch of comments, adverts or the like; named so, but three quarters of the page's text
        self.holds, self.foreign, self.wraps = False, False, False

    @property
    def suspect(self) -> bool:
        if self.holds or self.wraps or self.tag in ("html", "body"):
            return False
        return self.tag == "form" or bool(self.names) and not NOISE_WORDS.isdisjoint(self.names.split())

    @property
    def style(self) -> str:
        return f"{self.tag}.{self.names}" if self.names else self.tag


def sounds_foreign(names: str) -> bool:
    """Do the names say comments, adverts or the like."""
    for name in names.split():
        first, *rest = re.split("[-_]+", name)
        if first in FOREIGN_WORDS and FOREIGN_PARTS.issuperset(rest):
            return True
    return False


def mark_foreign(root: Node) -> None:
    """Mark the branches that are named comments, adverts or the like and do not wrap the page: one that holds all its content
    elements, or half or more of the text that remains, is looked into instead, and is no longer suspect with three quarters."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.tag not in NOISE_TAGS)
    size, content = {}, {}  # characters of text and content elements of a branch
    for node in reversed(order):
        inside = [c for c in node.children if isinstance(c, Node) and id(c) in size]
        size[id(node)] = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(size[id(c)] for c in inside)
        content[id(node)] = (node.tag in CONTENT_TAGS and not sounds_foreign(node.names)) + sum(content[id(c)] for c in inside)
    left, elements, todo = size[id(root)], content[id(root)], [root]
    while todo:
        node = todo.pop()
        mine, held = size[id(node)], content[id(node)]
        if node.tag != "body" and node is not root and sounds_foreign(node.names) and mine < left - mine and (not held or held < elements):
            node.foreign = True
            left, elements = left - mine, elements - held
            continue
        node.wraps = sounds_foreign(node.names) and mine >= 3 * (left - mine)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and id(c) in size)


class _Open:
    """Open elements, with how many there are of each tag."""

    def __init__(self, root: Node):
        self.nodes, self.count = [root], {}

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def cut(self, i: int) -> None:
        while len(self.nodes) > max(i, 1):
            self.count[self.nodes.pop().tag] -= 1

    def close(self, tags, stop=frozenset()) -> None:
        """Close the innermost open element of ``tags`` with all inside it, not looking beyond ``stop``."""
        if any(self.count.get(t) for t in tags):
            for i in range(len(self.nodes) - 1, 0, -1):
                if self.nodes[i].tag in tags:
                    return self.cut(i)
                if self.nodes[i].tag in stop:
                    return None
        return None


def parse(page: str) -> Node:
    """Tree of a page. Tolerates unclosed and stray tags; the content of scripts, styles and the like is left out."""
    root = Node("html")
    open_ = _Open(root)
    at, n, foreign = 0, len(page), False
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            open_.nodes[-1].children.append(page[at:])
            break
        if m.start() > at:
            open_.nodes[-1].children.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not open_.count.get("p"):
                open_.nodes[-1].children.append(Node("p"))
            open_.close({tag})
            continue
        if tag == "html":
            continue
        if tag == "body":
            open_.cut(1)
        if tag in BLOCKS:
            open_.close({"p"}, BLOCKS - {"p"})  # a block ends the open paragraph
        if tag in _CLOSES:
            open_.close(*_CLOSES[tag])
        names = ""
        if m[3]:
            found = {k.lower(): a or b or c for k, a, b, c in _NAMES.findall(m[3])}
            names = " ".join(sorted({w for v in found.values() for w in v.lower().split()}))
        node = Node(tag, names)
        open_.nodes[-1].children.append(node)
        strange = bool(names) and sounds_foreign(names)
        foreign = foreign or strange
        if tag in CONTENT_TAGS and not strange:
            for around in reversed(open_.nodes):
                if around.holds:
                    break
                around.holds = True
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        open_.push(node)
    if foreign:
        mark_foreign(root)
    return root


def purpose(node: Node, inside_content: bool) -> int:
    """1 if the markup names the node content, -1 if noise, 0 if it says nothing."""
    if node.foreign:
        return -1
    if node.tag in CONTENT_TAGS and not inside_content:
        return 1
    if node.tag in NOISE_TAGS or node.tag == "header" and not inside_content:
        return -1
    return 0


def _hash(text: str) -> int:
    """Signed 64-bit hash of a text."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def walk(root: Node, paths: bool = True) -> Iterator[tuple[int, Node, int, bool, bool]]:
    """(path, node, purpose, inside content, in a suspect branch) of the elements from the top, parents first, none below noise.
    A path is the hash of the parent's path and the node's style (0 throughout without ``paths``)."""
    todo = [(0, root, 0, False, False)]
    while todo:
        path, node, named, inside, suspect = todo.pop()
        yield path, node, named, inside, suspect
        if named < 0:
            continue
        inside = inside or named > 0
        for child in reversed(node.children):
            if isinstance(child, Node):
                what = purpose(child, inside)
                todo.append((_hash(f"{path}/{child.style}") if paths else 0, child, what, inside, suspect or what == 0 and child.suspect))


def branch_facts(root: Node) -> set[tuple[int, int, int, bool]]:
    """(path, layout, content, suspect) of the nodes that statistics decide on: those the markup leaves open, inside a
    named content element only if they bear a name or are in a suspect branch. Hashes of the sequence of child elements (repeats once) and of the
    node's own text (0: none)."""
    facts = set()
    for path, node, named, inside, suspect in walk(root):
        if named or inside and not node.names and not suspect:
            continue
        styles, texts = [], []
        for c in node.children:
            if isinstance(c, Node):
                if not styles or styles[-1] != c.style:
                    styles.append(c.style)
                if c.tag in PROSE and not c.names:
                    texts += [x.strip() for x in c.children if isinstance(x, str)]
            else:
                texts.append(c.strip())
        text = "\n".join(filter(None, texts))
        facts.add((path, _hash(">".join(styles)), _hash(text) if text else 0, suspect))
    return facts


def text_blocks(root: Node, low: frozenset | set = frozenset()) -> list[str]:
    """Texts of the page's blocks in order. Noise goes; what lies outside goes if the page names a content element;
    a branch goes if all that statistics decide in it is ``low`` and none of it is named content."""
    nodes = list(walk(root, bool(low)))
    only_named = any(named > 0 for _, _, named, _, _ in nodes)
    kept: set[int] = set()  # ids of nodes whose branch stays
    for path, node, named, inside, suspect in reversed(nodes):
        decided = path in low and (not inside or bool(node.names) or suspect)
        if named > 0 or named == 0 and (not decided or any(id(c) in kept for c in node.children if isinstance(c, Node))):
            if named > 0 or inside or not only_named or any(id(c) in kept for c in node.children):
                kept.add(id(node))
    blocks, block = [], []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(block)).strip()
        if text:
            blocks.append(text)
        block.clear()

    todo: list = [(root, False)]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            block.append(entities.unescape(item) if "&" in item else item)
        else:
            node, inside = item
            is_block = node.tag in BLOCKS
            if is_block:
                flush()
            if id(node) not in kept:
                continue
            inside = inside or node.tag in CONTENT_TAGS
            if node.tag == "br":
                block.append(" ")
                continue
            if is_block:
                todo.append(None)
            own_text = inside or not only_named
            todo.extend(c if isinstance(c, str) else (c, inside) for c in reversed(node.children) if own_text or isinstance(c, Node))
    flush()
    return blocks


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def style_facts(pages: DataFrame) -> DataFrame:
    """``host, page_hash, path, layout, content, suspect`` of ``pages`` (host, page_hash, html); identical pages of a host once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            out: list[list] = [[], [], [], [], [], []]
            for host, h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts_of(b, "html")):
                for row in branch_facts(parse(page)):
                    for col, v in zip(out, (host, h, *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), *(pa.array(x, pa.int64()) for x in out[1:5]), pa.array(out[5], pa.bool_())],
                names=["host", "page_hash", "path", "layout", "content", "suspect"],
            )

    schema = "host string, page_hash long, path long, layout long, content long, suspect boolean"
    return pages.select("host", "page_hash", "html").mapInArrow(run, schema).distinct()


def style_tree(facts: DataFrame, min_pages: int = MIN_PAGES, damping: float = DAMPING) -> DataFrame:
    """``host, path, importance`` of the element nodes, host ``*`` being the tree of all hosts.

    Importance mixes two entropies, each over the log of its number of pages (1 if nothing ever
    repeats, 0 if it is always the same): that of the texts at the node (weight ``damping``) and
    that of its layouts. Nodes that fewer than ``min_pages`` pages show are left out.
    """
    trees = facts.unionAll(facts.withColumn("host", F.lit("*")))
    value = lambda kind: F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value"))
    counts = (
        trees.select("host", "path", F.explode(F.array(value("layout"), value("content"))).alias("x"))
        .filter("x.kind = 'layout' or x.value <> 0")
        .groupBy("host", "path", "x.kind", "x.value").agg(F.count("*").alias("n"))
    )
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = F.when(F.col("m") <= 1, F.lit(1.0)).otherwise((F.log2("m") - F.col("nlogn") / F.col("m")) / F.log2("m"))
    of = lambda kind, col: F.max(F.when(F.col("kind") == kind, col))
    nodes = sums.groupBy("host", "path").agg(
        of("content", entropy).alias("content"), of("layout", entropy).alias("layout"), of("layout", F.col("m")).alias("m")
    )
    own = damping * F.coalesce("content", F.lit(0.0)) + (1 - damping) * F.col("layout")
    return nodes.filter(F.col("m") >= min_pages).select("host", "path", own.alias("importance"))


def low_branches(facts: DataFrame, tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``host, page_hash, low``: the paths of each page that its host's tree, or else the tree of all hosts, finds low.
    Where neither has enough pages to tell, suspect branches are low and others not."""
    own = tree.filter("host <> '*'").withColumnRenamed("importance", "own")
    every = tree.filter("host = '*'").select("path", F.col("importance").alias("every"))
    judged = facts.filter("content <> 0").groupBy("host", "page_hash", "path").agg(F.bool_and("suspect").alias("suspect"))  # without text there is nothing to drop
    judged = judged.join(broadcast_if_small(own), ["host", "path"], "left").join(broadcast_if_small(every), "path", "left")
    unknown = F.when(F.col("suspect"), 0.0).otherwise(1.0)
    return judged.filter(F.coalesce(F.col("own"), F.col("every"), unknown) < threshold).groupBy("host", "page_hash").agg(F.collect_set("path").alias("low"))


def main_text(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, url, text`` of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a page that names no content element keeps all but
    its noise and low branches; pages without a host share one tree; identical pages of a host
    count once in it; repeated rows give repeated results; an empty table gives no rows; other
    columns are ignored.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), host_of(F.col("url")).alias("host"), F.xxhash64(body).alias("page_hash"))
    facts = materialise(style_facts(rows), "style-facts")
    tree = materialise(style_tree(facts, min_pages), "style-tree")
    low = materialise(low_branches(facts, tree, threshold), "low-branches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            lows = [frozenset(x or ()) for x in b.column(3).to_pylist()]
            text = ["\n\n".join(text_blocks(parse(t), x)) for t, x in zip(texts_of(b, "html"), lows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    judged = rows.join(broadcast_if_small(low), ["host", "page_hash"], "left")
    cols = judged.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "low")
    return cols.mapInArrow(run, "page_id long, url string, text string")
