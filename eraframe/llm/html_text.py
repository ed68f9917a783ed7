"""Main text of HTML pages: boilerplate elements go by what they are, and site templates by how often they recur."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

# HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NOT_TEXT = frozenset("head script style noscript template title iframe object embed svg canvas math audio video map textarea xmp noembed noframes select option datalist button".split())
NOT_MAIN = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption dd dt legend li summary tbody td tfoot th thead tr title".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
ALWAYS_OUT = NOT_TEXT | NOT_MAIN | {"html", "body", "hr"}  # never a template: their names alone settle what they are

#: Words of class, id and role that mark what isn't the article, as whole parts between other signs.
MARKED = re.compile(r"(?:^|[^a-z0-9])(?:ads?|advert(?:s|isement|ising)?|banners?|sponsor(?:ed)?|promo(?:ted|tion)?s?|side-?bar|nav(?:bar|igation)?|menu|breadcrumbs?|foot(?:er)?|cookies?|consent|gdpr|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|search-?(?:box|form)|share|sharing|social|related|recommended|comments?|comment-?list|disqus|replies|respond|pagination|pager|toolbar|widget|skip-?link|complementary|contentinfo|dialog)(?:$|[^a-z0-9])")

#: Words that mark the head of a page; inside an article they mark its own head, which is text.
HEADS = re.compile(r"(?:^|[^a-z0-9])(?:masthead|site-?header|page-?header|header)(?:$|[^a-z0-9])")

#: Classes and ids that stand for one thing only, where an element has no other; and roles of what isn't the article.
SOLE = re.compile(r"ads?|advert(?:s|isement|ising)?|sponsored|comments?|comment-?list|disqus|replies|respond|cookies?|consent|gdpr|newsletter|popup|modal")
ROLES = frozenset("complementary navigation banner contentinfo dialog alertdialog alert search form menu menubar toolbar".split())

TAG = re.compile(r"<(?:!--(?:>|->|.*?--!?>)|([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|/([a-zA-Z][^\s/>]*)[^>]*>|[!?/][^>]*>)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)|(hidden)(?=[\s/>]|$)")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "drop", "marked", "parts", "parent", "key", "main")

    def __init__(self, name: str, parent: Node | None, drop: bool = False, marked: bool = False):
        self.name, self.parent, self.drop, self.marked = name, parent, drop, marked
        self.parts: list = []
        self.key = 0
        self.main = False


def _drops(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its name or marks, and whether it is marked only.

    Inside an article its own header is text, and a word in a class or id is no proof: "social history" and a paragraph of
    class "share" are prose. It drops an element only with a second sign: a word in the other attribute too, a role, no
    other word beside one of SOLE; or, told later, mostly links, or a place on many pages of the host."""
    if name in NOT_TEXT or name in NOT_MAIN:
        return not (inside and name == "header"), False
    if "=" not in attributes and "hidden" not in attributes:
        return False, False
    marks = 0
    for k, v, hidden in ATTRIBUTE.findall(attributes):
        k, v = k.lower(), v.strip("\"'").lower()
        if hidden or k == "aria-hidden" and v == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return True, False
        if k in ("class", "id", "role") and name not in ("body", "html", "main", "article"):
            if not inside and (MARKED.search(v) or HEADS.search(v)):
                return True, False
            if k == "role" and v in ROLES or k != "role" and v.split() and all(SOLE.fullmatch(x) for x in v.split()):
                return True, False
            marks += bool(MARKED.search(v))
    return marks > 1, marks == 1


def tree(page: str) -> Node:
    """A lenient element tree. Open paragraphs, items and cells end where HTML ends them; other open elements end with
    their parent; an end tag without its start is left out; an unfinished comment or raw element runs to the end."""
    root = node = Node("", None)
    depth: dict[str, int] = {}
    at, n = 0, len(page)

    def close(upto: Node) -> None:
        nonlocal node
        while node is not upto:
            depth[node.name] -= 1
            node = node.parent

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            node.parts.append(page[at:])
            break
        if lt > at:
            node.parts.append(page[at:lt])
        m = TAG.match(page, lt)
        if not m:
            if page.startswith("<!--", lt):
                break
            node.parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1]:
            name = m[1].lower()
            if name in CLOSES_P and depth.get("p"):
                x = node
                while x is not root and x.name != "p" and x.name not in ("table", "td", "th", "button", "object"):
                    x = x.parent
                if x.name == "p":
                    close(x.parent)
            if name in SAME:
                x = node
                while x is not root and x.name not in SAME[name] and x.name not in HOLDS.get(name, ()):
                    x = x.parent
                if x is not root and x.name in SAME[name]:
                    close(x.parent)
            child = Node(name, node, *_drops(name, m[2], bool(depth.get("article") or depth.get("main"))))
            node.parts.append(child)
            if name in VOID or m[2].endswith("/") and name not in BLOCK:
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                stop = page.find(">", end.start()) if end else -1
                at = stop + 1 if stop >= 0 else n
                continue
            depth[name] = depth.get(name, 0) + 1
            node = child
        elif m[3]:
            name = m[3].lower()
            if depth.get(name):
                x = node
                while x.name != name:
                    x = x.parent
                close(x.parent)
    _links(root)
    return root


def _links(root: Node) -> None:
    """Drop marked elements at least half of whose text is in links, or that have none."""
    nodes = _order(root)
    if not any(x.marked for x in nodes):
        return
    size: dict[int, tuple[int, int]] = {}
    for x in reversed(nodes):
        text = linked = 0
        for p in x.parts:
            a, b = (len(SPACE.sub("", p)), 0) if isinstance(p, str) else size.pop(id(p))
            text, linked = text + a, linked + b
        size[id(x)] = text, text if x.name in ("a", "button") else linked
        if x.marked and 2 * linked >= text:
            x.drop = True


def _order(root: Node) -> list[Node]:
    """Elements, each after its parent."""
    out = [root]
    for x in out:
        out += [p for p in x.parts if not isinstance(p, str)]
    return out


def hashed(root: Node) -> list[Node]:
    """Give each element the hash of its subtree (name and contents, white space alike); its text-bearing ones."""
    nodes = _order(root)
    for x in nodes:
        x.main = x.name in ("article", "main") or bool(x.parent and x.parent.main)
    for x in reversed(nodes):
        d = hashlib.blake2b(x.name.encode(), digest_size=8)
        for p in x.parts:
            d.update(SPACE.sub(" ", p).strip().encode("utf-8", "replace") if isinstance(p, str) else p.key.to_bytes(8, "little"))
        x.key = int.from_bytes(d.digest(), "little")
    return nodes


def _signed(key: int) -> int:
    return key - (1 << 64) if key >= 1 << 63 else key


def candidates(nodes: list[Node]) -> set[int]:
    """Subtrees that may be a template: not the page or what holds the article, and of what is inside the article only what
    a class or id marks."""
    holds: set[int] = set()
    for x in nodes:
        if x.name in ("article", "main"):
            y = x
            while y is not None:
                holds.add(id(y))
                y = y.parent
    return {_signed(x.key) for x in nodes if id(x) not in holds and x.name in BLOCK and x.name not in ALWAYS_OUT and (not x.main or x.marked)}


def article_key(nodes: list[Node]) -> int:
    """A hash of the main text, so that copies of a page count as one page."""
    return int.from_bytes(hashlib.blake2b(main_text(nodes[0], frozenset()).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def main_text(root: Node, templates: frozenset[int] | set[int]) -> str:
    """Blocks in page order: of the articles (or main elements) if there are any with text, else of the whole page."""

    def render(top: list[Node]) -> str:
        blocks: list[list[str]] = [[]]
        stack: list = list(reversed(top))
        while stack:
            x = stack.pop()
            if x is None:
                blocks.append([])
            elif isinstance(x, str):
                blocks[-1].append(x)
            elif x.name == "br":
                blocks[-1].append(" ")
            elif not x.drop and not (templates and (not x.main or x.marked) and _signed(x.key) in templates):
                if x.name in BLOCK:
                    blocks.append([])
                    stack.append(None)
                stack.extend(reversed(x.parts))
        texts = (SPACE.sub(" ", html.unescape("".join(b))).strip() for b in blocks)
        return "\n".join(t for t in texts if t)

    def kept(x: Node) -> bool:
        while x is not None:
            if x.drop:
                return False
            x = x.parent
        return True

    nodes = _order(root)
    for name in ("article", "main"):
        top = [x for x in nodes if x.name == name and kept(x) and not _inside(x, name)]
        if top and (text := render(top)):
            return text
    return render([root])


def _inside(x: Node, name: str) -> bool:
    x = x.parent
    while x is not None:
        if x.name == name:
            return True
        x = x.parent
    return False


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (host, page, key, article) for each candidate subtree of each page, and one without a key for the page itself."""
    for b in batches:
        for at in range(0, b.num_rows, 500):
            rows = []
            for host, page, text in zip(*(b.column(i).slice(at, 500).to_pylist() for i in range(3)), strict=True):
                nodes = hashed(tree(text))
                article = article_key(nodes)
                rows += [(host, page, k, article) for k in (None, *candidates(nodes))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["host", "page", "key", "article"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            texts = []
            for page, keys in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                root = tree(page)
                if keys:
                    hashed(root)
                texts.append(main_text(root, frozenset(keys or ())))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, min_pages: int = 10, min_share: float = 0.1) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Element subtrees are hashed and counted per host, over pages with different main texts, so copies of a page count
    once; subtrees on min_share of a host's pages or more, and on min_pages or more, are the site's template and go, with
    what is boilerplate by its element or its class. On hosts with fewer than twice min_pages pages, half of them count
    instead of min_pages, three at least. Inside an article (or main) only what a class or id marks can be a template; see
    _drops for what else is left out there.
    A null page is empty; a page without a host (null or odd url) has no template; repeated rows have a row each; an
    empty table gives no rows; other columns are ignored. Very long and deeply nested pages are taken whole: no step is
    recursive, and one page is held at a time.

    Only subtree keys are grouped by host. A page learns which of its own subtrees are templates by its hash, so pages
    are dealt evenly, whatever their hosts; equal pages have one hash and the same templates.
    """
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("page", F.xxhash64("url", "html"))
    seen = materialize(rows.where("host <> ''").select("host", "page", "html").mapInArrow(_subtrees, "host string, page long, key long, article long"), "subtrees")
    counts = seen.select("host", "key", "article").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    sizes = counts.where("key is null").select("host", F.col("n").alias("pages"))
    enough = F.greatest(F.lit(3), F.least(F.lit(min_pages), F.ceil(F.col("pages") / 2)), min_share * F.col("pages"))
    template = materialize(counts.where("key is not null and n > 2").join(sizes, "host").where(F.col("n") >= enough).select("host", "key"), "templates")
    keys = seen.join(template, ["host", "key"], "left_semi").groupBy("page").agg(F.collect_set("key").alias("keys"))  # no more than a page's own
    return rows.join(keys, "page", "left").select("page_id", "url", "html", "keys").mapInArrow(_texts, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
