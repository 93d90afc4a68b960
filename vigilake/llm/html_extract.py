"""Main text of web pages by site style trees.

The DOMs of one host's pages are merged: elements whose chains of presentations (tag and classes) are equal are one
node of the host's tree.  Each node gets an importance, from counts over all pages of the host:

- presentation: the entropy of its lists of children; 0 where every page shows the same, 1 where each shows its own;
- content: one less the entropy of its texts over the pages, weighted by length, summed up from the leaves; 0 where
  all pages say the same, 1 where each says something of its own;
- size: the mean share of a page's text that the branch holds.

Importance is content x the largest of size, own presentation and the parent's presentation: where children vary, each
of them is part of a flow; where they don't, each is a slot of the template and must hold much of the page.  Branches
that are marked by name as menus, adverts, comments and so on (lists below) are judged by size alone, and a heading by
its content alone.  Hosts of few pages borrow from the tree of all hosts, and that one from the marks.  Branches
of low importance are cut from each page; nothing but the tree cuts text, apart from what is no text (scripts, styles,
controls of forms, heads).

Copies count once: a page is known by its longest block.  The tree is summed in Spark: counts by (host, node, feature),
then a row per node.  Nodes of low importance are sent to all tasks only if there are few (``broadcast_nodes``);
otherwise each page is joined with those of its own.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch

# Elements that part blocks of text (fixed values of the HTML standard).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is no text of the page, read as raw characters or as elements.
RAW = frozenset("script style textarea title noembed noframes xmp iframe".split())
SKIPPED = frozenset("noscript template select button svg object datalist canvas audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Marks of what is seldom the article: elements, roles, and words in classes and ids.
NOISE_TAGS = frozenset("nav header footer aside form dialog menu search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alert".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe widget".split())
_BESIDE = 0.2  # the prior of what stands beside an article; 1 inside one and on pages without, 0 of marked elements
DEEPEST = 32  # elements further down belong to their ancestor at this depth

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_known: dict[tuple[int, str], int] = {}


def _node(parent: int, shown: str) -> int:
    """The node of an element: a hash of its parent's node and its presentation."""
    got = _known.get((parent, shown))
    if got is None:
        if len(_known) > 1_000_000:
            _known.clear()
        got = _known[parent, shown] = _hash(parent, shown)
    return got


class Element:
    """A block element of a page: its place in the tree, and what of the page it holds.

    ``mark``: 0 for none, 1 if only forms around it are marks, else 2.
    """

    __slots__ = ("node", "parent", "depth", "inside", "mark", "heading", "children", "length")

    def __init__(self, node: int, parent: Element | None, inside: bool, mark: int, heading: bool):
        self.node, self.parent, self.inside, self.mark, self.heading = node, parent, inside, mark, heading
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[int] = []
        self.length = 0


def _mark(tag: str, names: dict[str, str], inside: bool) -> int:
    """What tag, role, classes and id say of the element; inside an article only whole classes and ids count."""
    if tag == "form":
        return 1
    if names.get("role", "").lower() in NOISE_ROLES or (tag in NOISE_TAGS and not (tag == "header" and inside)):
        return 2
    if not names:
        return 0
    classes, own = names.get("class", "").lower(), "" if tag in HEADINGS else names.get("id", "").lower()
    words = {*classes.split(), own} if inside else {*_WORD.findall(classes), *_WORD.findall(own)}
    return 0 if words.isdisjoint(NOISE_WORDS) else 2


def read_page(page: str) -> tuple[list[Element], list[tuple[Element, str]], bool]:
    """The block elements of a page in order, its blocks of text (element, text), and whether it has an article.

    Every step moves on in the page or takes an element off the stack, so the cost is that of the page's length.
    """
    elements, out, held = [Element(0, None, False, 0, False)], [], []
    stack: list[tuple[str, Element]] = [("", elements[0])]
    open_: dict[str, int] = {}  # how many of each tag are open
    article, skipped, depth = False, "", 0

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text and "head" not in open_:
                out.append((stack[-1][1], text))

    def pop() -> str:
        tag = stack.pop()[0]
        open_[tag] -= 1
        if not open_[tag]:
            del open_[tag]
        return tag

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not skipped:
            held.append(page[at:end])
        if m is None:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if skipped:
            if tag == skipped:
                depth += -1 if closing else 1
                skipped = skipped if depth else ""
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if tag in open_:
                while pop() != tag:
                    pass
            continue
        if tag in RAW:
            stop = _ENDS[tag].search(page, at)
            at = stop.end() if stop else len(page)
            continue
        if tag in SKIPPED:
            if not attributes.endswith("/"):
                skipped, depth = tag, 1
            continue
        if tag not in BLOCKS:
            continue
        if stack[-1][0] == "p" or stack[-1][0] == tag == "li":  # an open paragraph ends where a block begins
            pop()
        while tag == "body" and "head" in open_:
            pop()
        names = {a.lower(): (b or c or d) for a, b, c, d in _NAMED.findall(attributes)} if attributes else {}
        up = stack[-1][1]
        inside, mark = up.inside, up.mark
        if tag in ("article", "main"):
            article = inside = True
            mark = 0 if mark == 1 else mark
        if tag not in ("html", "body", "main"):
            mark = max(mark, _mark(tag, names, inside))
        if up.depth >= DEEPEST:
            mine = up
        else:
            shown = tag if tag in ("html", "body") else ".".join([tag, *sorted({c for c in names.get("class", "").split() if not any(x.isdigit() for x in c)})])
            mine = Element(_node(up.node, shown), up, inside, mark, tag in HEADINGS)
            elements.append(mine)
            up.children.append(mine.node)
        stack.append((tag, mine))
        open_[tag] = open_.get(tag, 0) + 1
    flush()
    for e, text in out:
        e.length += len(text)
    for e in reversed(elements):  # children come after their parents
        if e.parent:
            e.parent.length += e.length
    return elements, out, article


# --- the tree ----------------------------------------------------------------------------------------------

_FEATURES = "host string, node long, kind string, feature long, copy long, up long, ups array<long>, length double, share double, prior double, mark double, heading double, inside double"


def page_features(page: str) -> list[tuple]:
    """What a page adds to its host's tree, without the host: a row per (node, kind, feature).

    Kinds: ``node`` for the node itself (share of the page's text, prior, marks), ``shown`` for its lists of
    children, ``text`` for its blocks.  ``copy`` tells pages apart that aren't copies of each other.
    """
    elements, found, article = read_page(page)
    if not found:
        return []
    total = sum(len(t) for _, t in found)
    copy = _hash(max((t for _, t in found), key=lambda t: (len(t), t)))
    around = set()  # elements that hold articles
    for e in elements:
        while e and e.inside and id(e) not in around:
            around.add(id(e))
            e = e.parent
            while e and id(e) not in around:
                around.add(id(e))
                e = e.parent
    nodes: dict[int, list] = {}
    for e in elements:
        prior = 0.0 if e.mark else 1.0 if not article or id(e) in around else _BESIDE
        got = nodes.setdefault(e.node, [e, 0, 0, 0.0, 0, 0, 0])
        got[1] += 1
        got[2] += e.length
        got[3] += prior
        got[4] += e.mark > 0
        got[5] += e.heading
        got[6] += e.inside
    out = []
    for node, (e, n, length, prior, mark, heading, inside) in nodes.items():
        ups, up = [], e
        while up:
            ups.append(up.node)
            up = up.parent
        out.append((node, "node", 0, copy, e.parent.node if e.parent else None, ups, float(length), length / total, prior / n, mark / n, heading / n, inside / n))
    none = (None, None, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    out += [(node, "shown", shown, copy, *none) for node, shown in {(e.node, _hash(*e.children)) for e in elements if e.children}]
    texts: dict[tuple[int, int], int] = {}
    for e, t in found:
        key = (e.node, _hash(t))
        texts[key] = texts.get(key, 0) + len(t)
    out += [(node, "text", text, copy, None, None, float(n), 0.0, 0.0, 0.0, 0.0, 0.0) for (node, text), n in texts.items()]
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.float64()] * 6)
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    for batch in batches:
        out = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out += [(host, *row) for row in page_features(page.as_py() or "")]
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def _importance(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, node, n, importance, own, prior): from counts (*keys, node, kind, feature, df, ...), a row per node.

    ``importance`` is the branch's, ``own`` that of the node's own text alone.
    """
    kind, df = F.col("kind"), F.col("df").cast("double")
    is_node = F.when(kind == "node", df)
    sums = counts.groupBy(*keys, "node").agg(
        F.sum(is_node).alias("n"),
        F.max("up").alias("up"),
        F.max("ups").alias("ups"),
        *[(F.sum(F.when(kind == "node", F.col(c))) / F.sum(is_node)).alias(c) for c in ("share", "prior", "mark", "heading", "inside")],
        F.sum(F.when(kind == "shown", df)).alias("lists"),
        F.sum(F.when(kind == "shown", df * F.log(df))).alias("h"),
        F.sum(F.when(kind == "text", F.col("length"))).alias("length"),
        F.sum(F.when(kind == "text", F.col("length") * F.log(df))).alias("said"),
    )
    # entropy of the lists of children, as a share of what it is if every page has its own
    varied = F.coalesce(F.when(F.col("lists") > 1, 1 - F.col("h") / F.col("lists") / F.log("lists")), F.lit(0.0))
    # entropy of texts over the pages that have the node, weighted by length; then summed up the branches
    new = F.col("length") - F.when(F.col("n") > 1, F.col("said") / F.log("n")).otherwise(0.0)
    nodes = sums.select(*keys, "node", "n", "up", "ups", "share", "prior", "mark", "heading", "inside", F.col("lists").isNull().alias("leaf"), varied.alias("varied"), "length", F.greatest(new, F.lit(0.0)).alias("new"))
    branch = nodes.filter("length > 0").select(*keys, F.explode("ups").alias("node"), "length", "new").groupBy(*keys, "node").agg((F.sum("new") / F.sum("length")).alias("content"))
    whole = nodes.withColumn("own_content", F.col("new") / F.col("length")).join(branch, [*keys, "node"], "left")
    parents = nodes.select(*keys, F.col("node").alias("up"), F.col("varied").alias("flow"))
    whole = whole.join(parents, [*keys, "up"], "left")
    size = F.when(F.col("mark") > 0.5, F.col("share") * 0.6).when(F.col("heading") > 0.5, 1.0).otherwise(F.greatest("share", "varied", F.coalesce("flow", F.lit(1.0))))
    # what an article's own flow holds may repeat: an unmarked leaf there goes only if the flow is the same everywhere too
    flows = F.when(F.col("leaf") & (F.col("inside") > 0.5) & (F.col("mark") <= 0.5), F.coalesce("flow", F.lit(0.0))).otherwise(0.0)
    weigh = lambda content: F.greatest(size * F.coalesce(content, F.lit(1.0)), flows)
    return whole.select(*keys, "node", "n", "prior", weigh("content").alias("importance"), weigh("own_content").alias("own"))


def style_tree(pages: DataFrame, scratch: Scratch, prior_pages: float = 8.0) -> DataFrame:
    """``pages`` (host, body) -> (host, node, n, importance, own), importances with what is borrowed.

    Of n pages, one says nothing about what repeats: n - 1 are weighed against ``prior_pages`` of the tree of all
    hosts, whose hosts are weighed in the same way against the prior.
    """
    rows = pages.mapInArrow(_features, _FEATURES)
    first = ("length", "share", "prior", "mark", "heading", "inside")
    once = rows.groupBy("host", "node", "kind", "feature", "copy").agg(F.max("up").alias("up"), F.max("ups").alias("ups"), *[F.avg(c).alias(c) for c in first])
    counts = scratch.save(once.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("df"), F.max("up").alias("up"), F.max("ups").alias("ups"), *[F.sum(c).alias(c) for c in first]))
    # in the tree of all hosts each host counts once, however many pages it has
    everywhere = counts.groupBy("node", "kind", "feature").agg(F.count("*").alias("df"), F.max("up").alias("up"), F.max("ups").alias("ups"), *[F.sum(F.col(c) / F.col("df")).alias(c) for c in first])
    general = _importance(everywhere, []).select("node", *[_blend(F.col(c), F.col("prior"), F.col("n"), prior_pages).alias(f"general_{c}") for c in ("importance", "own")])
    own = _importance(counts, ["host"]).join(general, "node")
    return own.select("host", "node", "n", *[_blend(F.col(c), F.col(f"general_{c}"), F.col("n"), prior_pages).alias(c) for c in ("importance", "own")])


def _blend(seen: Column, borrowed: Column, n: Column, weight: float) -> Column:
    return ((n - 1) * seen + weight * borrowed) / (n - 1 + weight)


# --- extraction --------------------------------------------------------------------------------------------


def main_text(page: str, branches: frozenset | set = frozenset(), texts: frozenset | set = frozenset()) -> str:
    """The page's blocks outside of cut branches (nodes), and not own text of nodes of ``texts``, joined by one space."""
    elements, found, _ = read_page(page)
    cut = set()
    for e in elements:
        if e.node in branches or (e.parent and id(e.parent) in cut):
            cut.add(id(e))
    return " ".join(text for e, text in found if id(e) not in cut and e.node not in texts)


def _extract(sent):
    """(key, url, host, body[, branches, texts]) -> (key, url, text, n_chars); cut nodes by host from ``sent``, else from the row."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (frozenset(), frozenset())
        for batch in batches:
            if sent:
                low = [sent.value.get(h, none) for h in batch.column(2).to_pylist()]
            else:
                low = [(frozenset(b or ()), frozenset(t or ())) for b, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            texts = [main_text(page.as_py() or "", b, t) for page, (b, t) in zip(batch.column(3), low, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return go


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, host, body) -> (row, host, node): the nodes of each page."""
    for batch in batches:
        rows, hosts, nodes = [], [], []
        for row, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            mine = {e.node for e in read_page(page.as_py() or "")[0]}
            rows += [row] * len(mine)
            hosts += [host] * len(mine)
            nodes += mine
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(hosts, pa.string()), pa.array(nodes, pa.int64())], names=["row", "host", "node"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: float = 0.3, prior_pages: float = 8.0, broadcast_nodes: int = 100_000) -> DataFrame:
    """(id, url, text, n_chars) per row of ``pages``; the text is empty where there is none.

    Null bodies are empty; pages whose url is null or names no host share one tree.  Unclosed, stray and cut-off
    markup is read as far as it goes, elements below depth 32 as part of the one above.  Repeated rows each keep
    theirs; an empty table gives no rows; other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("url"), host.alias("host"), F.col(body_col).alias("body"))
    scratch = Scratch(pages.sparkSession, "pages")
    tree = style_tree(rows.select("host", "body"), scratch, prior_pages)
    low = scratch.save(tree.select("host", "node", (F.col("importance") < least).alias("branch"), (F.col("own") < least).alias("text")).filter("branch or text"))
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"key {kind}, url string, text string, n_chars long"
    first = low.limit(broadcast_nodes + 1).collect()  # as many as may be sent to all tasks, and one
    if len(first) <= broadcast_nodes:
        by_host: dict[str, tuple[set[int], set[int]]] = {}
        for r in first:
            branches, texts = by_host.setdefault(r["host"], (set(), set()))
            (branches if r["branch"] else texts).add(r["node"])
        out = rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(by_host)), schema)
    else:
        kept = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
        met = kept.select("row", "host", "body").mapInArrow(_nodes, "row long, host string, node long").join(low, ["host", "node"])
        lists = met.groupBy("row").agg(F.collect_list(F.when(F.col("branch"), F.col("node"))).alias("branches"), F.collect_list(F.when(~F.col("branch"), F.col("node"))).alias("texts"))
        out = kept.join(lists, "row", "left").select("key", "url", "host", "body", "branches", "texts").mapInArrow(_extract(None), schema)
    return out.withColumnsRenamed({"key": id_col, "url": url_col})
