"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of elements (tag, id and classes, with numbers blanked),
so equal places of different pages meet. For each node the tree knows on how many pages it occurs, how its presentation
varies (the sequences of children it has) and how its content does (the texts right in it, with their frequencies).
Importance follows the entropies: a node that looks the same and says the same on every page of its host tells nothing
and is noise, one whose texts differ from page to page is content. The texts right in an element are a leaf of its
branch; a branch is as important as its most important leaf. So each page loses, wherever they are, all leaves of low
importance: whole branches where nothing in them is important, else what is noise in them.

Entropies of few pages say little, so every node begins with the trust of some pages on which it told something, nodes
in an article or main element with that of more. What entropy can't tell is told by the elements' meaning: navigation,
headers and footers of pages, asides, and elements whose id, class or role names advertising, notices, sidebars or
comments get no trust and no importance in the tree, however varied they are; scripts, styles and form controls are no
text at all.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm.common import small_batches, stage
from keyspan.llm.tokens import releasing
from keyspan.llm.url_filter import host_of

#: Branches of less importance than this are noise.
LEAST_IMPORTANCE = 0.2
#: Pages' worth of trust that a node begins with: noise by meaning, any other, one in an article or main element.
NOISE, PLAIN, MAIN = 0, 4, 24
#: Levels of the tree. Deeper elements belong to the node above them; none of their text is lost.
LEVELS = 64

#: Elements that are never content, those that hold no text to read, and those whose content is not markup.
_NOISE = frozenset("nav footer aside form menu dialog".split())
_CONTROL = frozenset("template button select option label input textarea fieldset iframe object svg canvas noscript".split())
_RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes template svg".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_MAIN = frozenset(("article", "main"))
#: An open element of the key is closed by the start of one of these.
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|promo\w*|sponsor\w*|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|sidebar|side-?bar|widget|related|recommended|share|sharing|social|breadcrumbs?|menu|navbar|navigation|nav|masthead|site-?header|footer|comments?|comment-?list|disqus|replies|respond|login|signup|search)(?=$|[\s_-]|\d)", re.I)
#: A name like with-sidebar speaks of what is beside the element.
_BESIDE = re.compile(r"(?:^|[_-])(?:has|with|without|no|non)[_-]", re.I)
_ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu\w*)$", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
_DIGITS = re.compile(r"\d+")


def _noise(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    if tag in _NOISE or (tag == "header" and not inside_main):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or ("style" in attrs and _HIDDEN.search(attrs["style"])):
        return True
    if tag in ("html", "body", *_MAIN):
        return False
    if _ROLES.match(attrs.get("role", "")):
        return True
    return any(_NAMES.search(name) and not _BESIDE.search(name) for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split())


class Page(NamedTuple):
    """A page as a tree: nodes are its different places in order, parents first; the first is the page itself."""

    names: list[str]
    ids: list[int]  # what stands for a node's path in its host's tree
    parents: list[int]
    trusts: list[int]
    looks: list[tuple[int, str]]  # (node, kinds of its children) of each element
    blocks: list[tuple[int, str]]  # (node, text) in page order

    def paths(self) -> list[str]:
        out = [""]
        for name, parent in zip(self.names[1:], self.parents[1:], strict=True):
            out.append(f"{out[parent]}/{name}")
        return out


def _hash(text: str, above: int = 0) -> int:
    return int.from_bytes(hashlib.blake2b(f"{above} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Open:
    """An open element; inline ones share the node and children of the block around them."""

    __slots__ = ("tag", "node", "level", "trust", "silent", "children")

    def __init__(self, tag: str, node: int, level: int, trust: int, silent: bool, children: list[str]):
        self.tag, self.node, self.level, self.trust, self.silent, self.children = tag, node, level, trust, silent, children


def read_page(page: str) -> Page:
    """The tree of a page and its blocks: text between block-level boundaries, with character references decoded and white space made one space.

    All that is within an element that is noise by meaning belongs to that element's node.
    """
    out = Page([""], [_hash("")], [-1], [PLAIN], [], [])
    known: dict[tuple[int, str], int] = {}
    stack = [_Open("", 0, 0, PLAIN, False, [])]
    text: list[str] = []
    place = 0

    def flush() -> None:
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                out.blocks.append((place, said))
            text.clear()

    def pop() -> None:
        last = stack.pop()
        if last.tag not in _INLINE:
            flush()
            if last.node != stack[-1].node:
                out.looks.append((last.node, " ".join(last.children)))

    def add(raw: str) -> None:
        nonlocal place
        top = stack[-1]
        if top.silent:
            return
        if not text:
            if not raw.strip():
                return
            place = top.node
        text.append(raw)

    def node(above: _Open, name: str, trust: int) -> int:
        at = known.get((above.node, name))
        if at is None:
            at = known[above.node, name] = len(out.ids)
            out.names.append(name)
            out.ids.append(_hash(name, out.ids[above.node]))
            out.parents.append(above.node)
            out.trusts.append(trust)
        return at

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        if found is None:
            # an unfinished tag at the end is no text
            cut = re.search(r"<[A-Za-z/!?]", page[at:])
            add(page[at : at + cut.start()] if cut else page[at:])
            break
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth].tag in ("article", "main", "body", "td", "nav") and tag in _INLINE:
                    break
            else:
                if tag == "p" or tag not in _INLINE:
                    flush()
            continue
        if tag in _CLOSES_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == "p":
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth].tag not in _INLINE:
                    break
        if tag in _ITEMS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in _ITEMS[tag]:
                    while len(stack) > depth:
                        pop()
                    break
                if stack[depth].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag == "br":
            add(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        raw = found[3] or ""
        up = stack[-1]
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(page, at)
            at = end.end() if end else n
            if tag not in _INLINE:
                flush()
            continue
        # within noise only the nesting matters
        attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw and up.trust and not up.silent else {}
        silent = up.silent or tag in _CONTROL
        noise = bool(up.trust) and _noise(tag, attrs, up.trust == MAIN)
        if tag in _INLINE:
            if noise:  # what an inline element says is no block, but noise all the same
                silent = True
            stack.append(_Open(tag, up.node, up.level, up.trust, silent, up.children))
            continue
        flush()
        if not up.trust or silent or up.level == LEVELS:
            stack.append(_Open(tag, up.node, up.level, up.trust, silent, []))
        else:
            trust = NOISE if noise else MAIN if tag in _MAIN else up.trust
            name = f"{tag}!" if noise else tag + "".join(f".{_DIGITS.sub('0', attrs[k])}" for k in ("id", "class") if attrs.get(k))
            if not up.children or up.children[-1] != name:  # runs of one kind of child look alike
                up.children.append(name)
            stack.append(_Open(tag, node(up, name, trust), up.level + 1, trust, False, []))
        if raw.rstrip().endswith("/") and tag not in ("p", "div"):
            pop()
    flush()
    while len(stack) > 1:
        pop()
    return out


_PARSED = "page_id long, url string, host string, same long, ids array<long>, parents array<int>, trusts array<int>, look_nodes array<int>, looks array<long>, text_nodes array<int>, texts array<string>"


def _lists(rows: list, kind: pa.DataType) -> pa.Array:
    return pa.array(rows, pa.list_(kind))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 128):
            part = batch.slice(lo, 128)
            read = [read_page(x or "") for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(x) for x in ("page_id", "url", "host", "same")),
                    _lists([x.ids for x in read], pa.int64()),
                    _lists([x.parents for x in read], pa.int32()),
                    _lists([x.trusts for x in read], pa.int32()),
                    _lists([[k for k, _ in x.looks] for x in read], pa.int32()),
                    _lists([[_hash(look) for _, look in x.looks] for x in read], pa.int64()),
                    _lists([[k for k, _ in x.blocks] for x in read], pa.int32()),
                    _lists([[t for _, t in x.blocks] for x in read], pa.string()),
                ],
                names=["page_id", "url", "host", "same", "ids", "parents", "trusts", "look_nodes", "looks", "text_nodes", "texts"],
            )


def parse_pages(pages: DataFrame) -> DataFrame:
    """Pages (page_id, url, html) as trees, a row for each. `same` stands for the whole html."""
    text = F.col("html").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"), host_of(F.col("url").cast("string")).alias("host"), F.xxhash64(text).alias("same"))
    return rows.mapInArrow(releasing(_parse), _PARSED)


def style_tree(parsed: DataFrame) -> DataFrame:
    """(host, node, parent, trust, pages, importance) of every node of every host's tree, for pages as parse_pages gives them.

    Pages of a host with the same html count once. With m pages that have the node, its presentation counts as the
    entropy of its looks and its content as that of its texts, both to the base m; the larger is what it tells. That is
    averaged over the m pages and those of its trust, on which it told everything; without trust it tells nothing.
    """
    pages = parsed.select("host", "same", "ids", "parents", "trusts", "look_nodes", "looks", "text_nodes", F.transform("texts", lambda x: F.xxhash64(x)).alias("texts")).dropDuplicates(["host", "same"])
    at = lambda i: F.get("ids", i)

    def feature(node, kind: int, value, above=None, trust=None):
        none = F.lit(None).cast("long")
        return F.struct(node.alias("node"), F.lit(kind).cast("byte").alias("kind"), value.alias("value"), (none if above is None else above).alias("parent"), (none.cast("int") if trust is None else trust).alias("trust"))

    nodes = F.transform("ids", lambda x, i: feature(x, 0, F.lit(0).cast("long"), at(F.get("parents", i)), F.get("trusts", i)))
    looks = F.zip_with("look_nodes", "looks", lambda i, x: feature(at(i), 1, x))
    texts = F.zip_with("text_nodes", "texts", lambda i, x: feature(at(i), 2, x))
    # values are only compared: 64 bits of them move. A page counts once for each of its different ones
    parts = pages.select("host", F.explode(F.array_distinct(F.concat(nodes, looks, texts))).alias("f")).select("host", "f.*")
    counted = parts.groupBy("host", "node", "kind", "value").agg(F.count(F.lit(1)).alias("count"), F.max("parent").alias("parent"), F.max("trust").alias("trust"))
    # per node and kind: the number of pages that have it, and sums for the entropy
    sums = counted.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("count"))).alias("pages"),
        F.max("parent").alias("parent"),
        F.max("trust").alias("trust"),
        *[F.sum(F.when(F.col("kind") == kind, value)).alias(f"{kind}_{name}") for kind in (1, 2) for name, value in (("n", F.col("count")), ("s", F.col("count") * F.log("count")))],
    )

    def entropy(kind: int):
        # -sum p log p = log n - sum(c log c) / n, at most log n
        n, s = F.col(f"{kind}_n"), F.col(f"{kind}_s")
        return F.coalesce(F.when(n > 1, (F.log(n) - s / n) / F.log(F.greatest(n, F.col("pages")).cast("double"))), F.lit(0.0))

    tells = F.greatest(entropy(1), entropy(2))
    importance = F.when(F.col("trust") == NOISE, 0.0).otherwise((F.col("pages") * tells + F.col("trust")) / (F.col("pages") + F.col("trust")))
    return sums.select("host", "node", "parent", "trust", "pages", importance.alias("importance"))


#: Noise nodes of all hosts up to which they are sent to all tasks.
SMALL = 500_000


def extract(spark: SparkSession, pages: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars), a row for each row of pages (page_id, url, html); other columns are ignored.

    Blocks in page order, joined by a line feed. A null or empty html, or one without content, has the empty text. A
    page without a host is of the host ''. What is less important than `least` is removed, with all that is in it. Pages
    of a host with the same html count as one in its tree; each gets its row, as do rows that repeat a page_id. An empty
    table gives an empty result.
    """
    small_batches(spark)
    parsed = stage(spark, parse_pages(pages), "parsed-pages", "zstd")
    low = style_tree(parsed).filter(F.col("importance") < least)
    noise = stage(spark, low.groupBy("host").agg(F.collect_set("node").alias("noise")), "noise")
    n = noise.agg(F.sum(F.size("noise"))).first()[0] or 0
    marked = parsed.select("page_id", "url", "host", "ids", "text_nodes", "texts").join(F.broadcast(noise) if n <= SMALL else noise, "host", "left")
    gone = F.coalesce("noise", F.array().cast("array<long>"))
    # what is no longer there is null, which array_join leaves out
    kept = F.array_join(F.zip_with("text_nodes", "texts", lambda node, text: F.when(~F.array_contains(gone, F.get("ids", node)), text)), "\n")
    return marked.select("page_id", "url", kept.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_site_style_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
