"""Main text of web pages by a site style tree.

The pages of a host are merged: elements with the same path of tags and classes are one node of the host's tree. A node's
importance comes from two entropies over the host's pages: of its presentation, the sequences of elements inside it, and
of its content, the texts inside it. What looks or reads the same on many pages has little. Prior knowledge counts as
PRIOR pages: inside an article a node starts as important, beside one as unimportant, on pages without one in between; a
site with many pages overrules it. Only what is named as menu, form, advert and the like goes whatever its statistics.
Branches of low importance are cut from each page, and the blocks that are left are its text.

Pages are read twice and parsed in place. Only node statistics, as hashes, are shuffled, summed before in each task. The
nodes for which a site overrules the prior are few: counted, then broadcast; beyond a bound they join pages by host, of
which those with many pages are dealt over several tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Least importance of a branch, and of a node inside an article, where its content alone counts.
THRESHOLD, INSIDE = 0.5, 0.15
#: As many pages as prior knowledge counts for.
PRIOR = 20
#: Nodes that are broadcast at most, and pages of a host in one task beyond that.
MOST_NODES, HOST_PAGES = 200_000, 20_000
#: Counts that a task holds before it hands them on.
HELD = 200_000

# Elements by their role in HTML, and words in class, id and role that mark what isn't the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOISE = set("nav header footer aside form script style noscript template head title button select option textarea iframe object svg menu dialog".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg"
MARKS = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments comments-area consent cookie cookies footer"
    " header masthead menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor"
    " sponsored subscribe widget complementary contentinfo search".split()
)
#: In compounds as site-header or ad-slot these leave a mark's sense; others, as in has-sidebar or search-results, don't.
PLACES = set("site main global top bottom left right primary secondary area bar block box button buttons form items link links list posts section slot unit".split())
#: Around an article inside a main element these list other articles.
OTHERS = MARKS & set("ad ads advert adverts advertisement comment comments comments-area promo related sidebar sponsor sponsored".split())
MAIN = {"article", "main"}
#: Inside an article these are its own.
HEADS = {"header", "masthead", "banner"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}

TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<[!?/a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTR = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def name(tag: str, attrs: str) -> tuple[str, set[str]]:
    """An element's name in the tree, and which of its words mark it as noise."""
    if "=" not in attrs:
        return tag, set()
    words = [w.lower() for m in ATTR.finditer(attrs) for w in (m[2] or m[3] or m[4] or "").split()]
    marks = set()
    for w in words:
        parts = {w} if w in MARKS else {x for x in re.split("[-_]+", w) if x and not x[0].isdigit()}
        if parts <= MARKS | PLACES:
            marks |= parts & MARKS
    return ".".join([tag, *sorted(words)]), marks


def key_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Node:
    """An element of a page. id: its path of names, hashed; first, last: the blocks of text inside it."""

    __slots__ = ("tag", "id", "up", "marks", "holds", "noise", "main", "article", "styles", "first", "last")

    def __init__(self, tag: str, own: str = "", up: Node | None = None, marks: set[str] = frozenset(), first: int = 0):
        self.tag, self.up, self.marks, self.styles, self.first, self.last = tag, up, marks, [], first, first
        self.holds = self.noise = self.main = self.article = False
        self.id = key_of(f"{up.id}/{own}") if up else 0

    def judge(self) -> None:
        """Sets noise, main and article, after those of the element around it and when all inside it is known.

        What is around an article or main element isn't noise by its marks, nor is that element, html or body."""
        up, tag, marks = self.up, self.tag, self.marks
        self.article = up.article or tag == "article"
        if tag in ("html", "body") or not up.main and (self.holds or tag in MAIN):
            marks = set()
        elif up.main:
            marks = marks & OTHERS if (self.holds or tag in MAIN) and not up.article else marks - HEADS
        noisy = tag in NOISE and not (tag in ("header", "dialog") and up.main) and not (tag == "form" and self.holds and not up.main)
        self.noise = up.noise or bool(marks) or noisy
        self.main = not self.noise and (up.main or tag in MAIN)


def parse(html: str | None) -> tuple[list[tuple[Node, str]], list[Node]]:
    """(node, text) of each block of text, in page order, and all nodes. Spaces are single, ends trimmed, references decoded.

    The time grows with the page, not with how deep its elements lie in each other."""
    root = Node("")
    stack, nodes, blocks, held = [root], [], [], []
    opened: Counter = Counter([""])

    def flush() -> None:
        if held:
            if text := SPACE.sub(" ", unescape("".join(held))).strip():
                blocks.append((stack[-1], text))
            held.clear()

    def shut() -> str:
        n = stack.pop()
        n.last = len(blocks)
        opened[n.tag] -= 1
        return n.tag

    at = 0
    for m in TOKEN.finditer(html or ""):
        if m.start() > at:
            held.append(html[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"]:
            if tag in BLOCKS:
                flush()
                if opened[tag]:
                    while shut() != tag:
                        pass
            elif tag in NOISE:
                # What is still open inside it ends with it: end tags of options and paragraphs may be left out.
                flush()
                if opened[tag]:
                    while shut() != tag:
                        pass
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                held.append(" ")
            continue
        if tag not in BLOCKS and tag not in NOISE:
            continue
        flush()
        if tag in BLOCKS and opened["p"]:
            while shut() != "p":
                pass
        for other in CLOSES.get(tag, ()):
            if stack[-1].tag == other:
                shut()
        up = stack[-1]
        own, marks = name(tag, m["attrs"])
        node = Node(tag, own, up, marks, len(blocks))
        if tag in MAIN:
            for n in reversed(stack):
                if n.holds:
                    break
                n.holds = True
        up.styles.append(own)
        stack.append(node)
        opened[tag] += 1
        nodes.append(node)
    held.append((html or "")[at:])
    flush()
    while stack:
        shut()
    for node in nodes:
        node.judge()
    return blocks, nodes


def host(url: str | None) -> str:
    m = re.match(HOST, url or "")
    return m[1].lower() if m else ""


#: The base of the rolling hash of a sequence of texts, modulo 2 ** 64.
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def features(html: str | None, named: bool = False) -> set[tuple[int, int, int]]:
    """(node, kind, feature), each once: kind 0 the page has the node, 1 a sequence of elements inside it, 2 a text of all its blocks.

    Nodes without text and, unless named, those that names mark as noise are left out: their verdict needs no statistics."""
    blocks, nodes = parse(html)
    sums, powers = [0], [1]
    for _, text in blocks:
        sums.append((sums[-1] * BASE + xxhash.xxh64_intdigest(text)) & MASK)
        powers.append(powers[-1] * BASE & MASK)
    out = set()
    for n in nodes:
        if n.last > n.first and (named or not n.noise):
            texts = (sums[n.last] - sums[n.first] * powers[n.last - n.first]) & MASK
            out |= {(n.id, 0, 0), (n.id, 1, key_of(" ".join(n.styles))), (n.id, 2, texts - (1 << 63))}
    return out


STATISTICS = "host string, node long, kind int, feature long, n long"


def statistics(batches: Iterator[pa.RecordBatch], named: bool = False) -> Iterator[pa.RecordBatch]:
    """(url, html) in; (host, node, kind, feature, n) out, n the pages of this part that have the feature."""

    def out(counts: Counter) -> pa.RecordBatch:
        rows = [(*k, n) for k, n in counts.items()]
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["host", "node", "kind", "feature", "n"])

    counts: Counter = Counter()
    for b in batches:
        for url, page in zip(b.column(0), b.column(1)):
            site = host(url.as_py())
            counts.update((site, *x) for x in features(page.as_py(), named))
            if len(counts) >= HELD:
                yield out(counts)
                counts = Counter()
    yield out(counts)


def importance(pages: DataFrame, named: bool = False) -> DataFrame:
    """Rows (host, node, pages, presentation, content, branch) of each host's tree over pages (url, html).

    presentation and content: entropies of a node's sequences of elements and of its texts, each over the logarithm of how
    many there are; 1 where there is only one. branch: the mean of the two over the greatest mean of the host."""
    counts = pages.select("url", "html").mapInArrow(lambda it: statistics(it, named), STATISTICS)
    counts = counts.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"))
    n = F.col("n")

    def entropy(kind: int) -> Column:
        own, total = F.sum(F.when(F.col("kind") == kind, n * F.log(n))), F.sum(F.when(F.col("kind") == kind, n))
        return F.when(total > 1, (F.log(total) - own / total) / F.log(total)).otherwise(1.0)

    nodes = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, n)).alias("pages"), entropy(1).alias("presentation"), entropy(2).alias("content")
    )
    mean = (F.col("presentation") + F.col("content")) / 2
    best = nodes.groupBy("host").agg(F.max(mean).alias("best"))
    return nodes.join(best, "host").select("host", "node", "pages", "presentation", "content", F.coalesce(mean / F.nullif("best", F.lit(0.0)), F.lit(1.0)).alias("branch"))


#: What a site's statistics say against the prior: of a node inside an article, beside one, on a page without one.
CUT_INSIDE, KEEP_BESIDE, CUT_ALONE = 1, 2, 4


def overruled(nodes: DataFrame) -> DataFrame:
    """Rows (host, node, bits) of importance() for which the site's pages outweigh PRIOR pages of the prior."""

    def weighed(prior: float, value: str) -> Column:
        return (prior * PRIOR + F.col("pages") * F.col(value)) / (PRIOR + F.col("pages"))

    bits = (
        F.when(weighed(1, "content") < INSIDE, CUT_INSIDE).otherwise(0)
        + F.when(weighed(0, "branch") >= THRESHOLD, KEEP_BESIDE).otherwise(0)
        + F.when(weighed(0.5, "branch") < THRESHOLD, CUT_ALONE).otherwise(0)
    )
    return nodes.select("host", "node", bits.alias("bits")).where("bits <> 0")


def main_text(html: str | None, bits: dict[int, int]) -> str:
    """The blocks that are left when noise and branches of low importance are cut. bits: overruled() of the page's host.

    Inside an article a branch goes that the site overrules, beside one a block stays where the site does; of pages without
    one, a branch of low importance goes. A page of which the statistics would leave nothing loses no more than noise and
    what is beside its article."""
    blocks, nodes = parse(html)
    in_main = any(n.main for n in nodes)
    low: set[Node] = set()
    for n in nodes:
        if bits.get(n.id, 0) & (CUT_INSIDE if n.main else CUT_ALONE) or n.up in low and n.up.main == n.main:
            low.add(n)

    def stays(n: Node) -> bool:
        if in_main and not n.main:
            return not n.holds and bool(bits.get(n.id, 0) & KEEP_BESIDE)
        return n not in low

    named = [(n, text) for n, text in blocks if not n.noise]
    kept = [(n, text) for n, text in named if stays(n)]
    if not any(n.main or not in_main for n, _ in kept):
        kept = [(n, text) for n, text in named if n.main or not in_main]
    return "\n".join(text for _, text in kept)


def with_bits(pages: DataFrame, nodes: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """pages (host) with bits, the list of (node, bits) of its host, or null.

    Up to most_nodes nodes are broadcast. More are joined by host: those of over HOST_PAGES pages are dealt over as many parts
    as their pages need, and a part's list goes with each."""
    found = nodes.groupBy("host").agg(F.collect_list(F.struct("node", "bits")).alias("bits"))
    if nodes.count() <= most_nodes:
        return pages.join(F.broadcast(found), "host", "left")
    counts = pages.groupBy("host").agg(F.ceil(F.count("*") / HOST_PAGES).cast("int").alias("parts")).where("parts > 1")
    large = materialize(counts, "large-hosts")  # one for every HOST_PAGES pages at most
    dealt = pages.join(F.broadcast(large), "host", "left").withColumn("part", F.floor(F.rand(3) * F.coalesce("parts", F.lit(1))).cast("int"))
    found = found.join(F.broadcast(large), "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    return dealt.drop("parts").join(found.select("host", "part", "bits"), ["host", "part"], "left").drop("part")


def extract(pages: DataFrame, most_nodes: int = MOST_NODES) -> DataFrame:
    """One row for each of pages (page_id, url, html; further columns are ignored): page_id, url, text, n_chars.

    Null html counts as empty; a page without text gives ''. Pages without a readable host form a site of their own.
    Repeated rows and null ids are kept; an empty table gives an empty one."""
    nodes = materialize(overruled(importance(pages)), "overruled-nodes")
    site = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    joined = with_bits(pages.select("page_id", "url", "html", site.alias("host")), nodes, most_nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, last, bits = [], None, {}
            for p, site, own in zip(b.column("html"), b.column("host").to_pylist(), b.column("bits")):
                if site != last:
                    last, bits = site, {x["node"]: x["bits"] for x in own.as_py() or ()}
                texts.append(main_text(p.as_py(), bits))
            arrays = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "bits").mapInArrow(run, "page_id long, url string, text string, n_chars long")
