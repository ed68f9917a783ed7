"""Pages to ordered block rows, and events from those."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eraframe.functions import scalars
from eraframe.functions.candidates import NO_EVENT, candidate_kinds
from eraframe.functions.spans import date_chunks, extract_spans
from eraframe.functions.text import canonical_url, exclude_item, first_sentence, is_meta_section, short_title, strip, strip_citations, trim_leading_date
from eraframe.functions.years import YEAR_ONLY, ancient_precision, bc_ad_normalise, food_confidence, in_year_bounds, parse_year_bound, scope_from_title

BLOCKS = "page_id long, seq int, tag string, level int, text string, href string, depth int, lst int, tbl int, row int, col int, rowspan int, colspan int, cls string, in_nav boolean, up array<int>"
TEXT_TAGS = ("title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "a", "td", "th")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
CELL_ENDS = ("td", "th", "a", "p")
#: The most rows and columns that HTML lets a cell cover.
MOST_ROWS, MOST_COLS = 65534, 1000


def _span(value: str | None, most: int, zero: int = 1) -> int:
    value = (value or "").strip()
    if not (value.isascii() and value.isdigit()):
        return 1
    return min(int(value[:6]) if len(value) > 6 else int(value), most) or zero


#: A tag without anything odd in it (attributes have values in quotes), with the text after it, without its angles, and one such attribute.
_ATTR = r"""[ \t\n\r\f]+([a-zA-Z][a-zA-Z0-9_-]*)=("[^"]*"|'[^']*')"""
_ATTRS = "(?:" + _ATTR.replace("(", "(?:") + ")*"
_PLAIN = rf"(/?)([a-zA-Z][a-zA-Z0-9]*)({_ATTRS})[ \t\n\r\f]*"
_TAG, _ONE_TAG = re.compile(f"<{_PLAIN}>([^<]*)"), re.compile(_PLAIN)
_ONE_ATTR = re.compile(_ATTR)
#: Elements whose content a parser doesn't read as tags; those of the parser in use are among them.
_RAW = {"script", "style", "textarea", "xmp", "iframe", "noembed", "noframes", "plaintext"} | set(HTMLParser.CDATA_CONTENT_ELEMENTS) | set(getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()))
#: What gives no blocks, in plain form: a declaration, a comment, a script or style.
_NONE = re.compile(rf"(?i:<!doctype[^>]*>|<!--(?!-?>)(?:[^-]|-(?!-))*-->|<(script|style)(?:{_ATTRS})[ \t\n\r\f]*>(?:[^<]|<(?![/!]))*</\1>)([^<]*)")
#: Places of a block's fields; a row holds those of BLOCKS without page_id, its text in parts. Where each tag or cell of
#: a page is met, they are written as numbers: level 2, tbl 7, row 8, col 9, rowspan 10, colspan 11, cls 12, in_nav 13.
SEQ, TAG, TEXT, DEPTH = 0, 1, 3, 5
#: Tags that change where blocks stand, and those that are blocks; all others change nothing.
_PLACES = frozenset(("script", "style", "ul", "ol", "nav", "footer", "table", "tr"))
_TOLD = frozenset(TEXT_TAGS)
#: What plain tags say, by how they are written (at most MOST_KNOWN short ones): kind, tag, and its attributes as _said gives them.
OTHER, START, END, ODD, MOST_KNOWN = 0, 1, 2, 3, 20000
_ODD = (ODD, None, None)
_known: dict[str, tuple] = {}


def _said(attrs: Sequence[tuple[str, str | None]]) -> tuple:
    """href, rowspan, colspan and class of a tag."""
    if not attrs:
        return None, 1, 1, ""
    a = dict(attrs)
    return a.get("href"), _span(a.get("rowspan"), MOST_ROWS, MOST_ROWS), _span(a.get("colspan"), MOST_COLS), a.get("class") or ""


def _plain(name: str) -> tuple | None:
    """What a plain tag says by what stands in its angles, None where the tag is odd or begins what is read in a way of its own."""
    m = _ONE_TAG.fullmatch(name)
    if not m:
        return None
    close, tag, attrs = m.groups()
    tag = tag.lower()
    if tag in _RAW or (close and attrs):
        return None
    if tag not in _TOLD and tag not in _PLACES:
        found: tuple = (OTHER, tag, None)
    elif close:
        found = (END, tag, None)
    else:
        found = (START, tag, _said([(k.lower(), unescape(v[1:-1])) for k, v in _ONE_ATTR.findall(attrs)] if attrs else ()))
    if len(_known) < MOST_KNOWN and len(name) < 100:
        _known[name] = found
    return found


class _Blocks(HTMLParser):
    """Rows of one page: headings, paragraphs, list items, links and cells, in order of their start.

    A cell's row and col are its place in its table's grid, where cells of earlier rows may reach down; lst numbers the
    list that a block is in, and cls is its table's class."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[list] = []
        self.lists: list[int] = []
        self.tables: list[list] = []  # of each open table: its number, row, next column, the columns of that row and (with how many rows) of those below that are held, class
        self.nav = self.raw = self.n_lists = self.n_tables = 0

    def read(self, html: str) -> list[list]:
        """The page's rows. Plain tags are told by how they are written, and each way to write one is read once; from the
        first construct on that is none, and has a way of its own to be read, HTMLParser reads the rest, to the same rows."""
        at = html.find("<")
        at = len(html) if at < 0 else at
        if at:
            self.handle_data(unescape(html[:at]))
        pieces = html[at + 1 :].split("<") if at < len(html) else []
        known, opened, start, end = _known, self.open, self._start, self.handle_endtag
        for i, piece in enumerate(pieces):
            name, closed, text = piece.partition(">")
            if not closed:
                break
            kind, tag, said = known.get(name) or _plain(name) or _ODD
            if kind == START:
                start(tag, said)
            elif kind == END:
                if opened and opened[-1][1] == tag:
                    opened.pop()
                else:
                    end(tag)
            elif kind == ODD:
                break
            if text and opened:
                if "&" in text:
                    text = unescape(text)
                if len(opened) == 1 and not self.raw:
                    opened[0][3].append(text)
                else:
                    self.handle_data(text)
        else:
            return self.rows
        return self._read_odd(html, at + i + sum(map(len, pieces[:i])))

    def trace(self, tags: Sequence[tuple]) -> list[list]:
        """The rows of a page of plain tags; in place of a text its rows have the number of the tag that it follows."""
        for i, (kind, tag, said) in enumerate(tags):
            if kind == START:
                self._start(tag, said)
            elif kind == END:
                self.handle_endtag(tag)
            self.handle_data(i)
        return self.rows

    def _read_odd(self, html: str, at: int) -> list[list]:
        """The rest of a page from its first odd construct on, which begins at `at`."""
        n, opened = len(html), self.open
        while at < n:
            m = _TAG.match(html, at)
            if m:
                close, tag, attrs, text = m.groups()
                tag = tag.lower()
                if tag in _RAW:
                    m = None
            if not m:
                m = _NONE.match(html, at)
                if not m:
                    break
                text = m[2]
            elif close:
                if attrs:
                    break
                self.handle_endtag(tag)
            else:
                self.handle_starttag(tag, [(k.lower(), unescape(v[1:-1])) for k, v in _ONE_ATTR.findall(attrs)] if attrs else ())
            if text and opened:
                self.handle_data(unescape(text) if "&" in text else text)
            at = m.end()
        if at < n:
            self.feed(html[at:])
            self.close()
        return self.rows

    def _close(self, tags: tuple[str, ...]) -> None:
        while self.open and self.open[-1][TAG] in tags:
            self.open.pop()

    def handle_starttag(self, tag: str, attrs: Sequence[tuple[str, str | None]]) -> None:
        self._start(tag, _said(attrs))

    def _start(self, tag: str, said: tuple) -> None:
        opened, tables = self.open, self.tables
        tbl = at = col = cls = level = None
        if tag == "td" or tag == "th":
            while opened and opened[-1][1] in CELL_ENDS:
                opened.pop()
            if tables:  # a cell's place: its row, and the first column of that row that no cell holds
                t = tables[-1]
                tbl, at, col, taken, below, cls = t
                if at < 0:
                    t[1] = at = 0
                if taken:
                    while col in taken:
                        col += 1
                if said[1] > 1:
                    below |= {c: said[1] - 1 for c in range(col, col + said[2])}
                t[2] = col + said[2]
        elif tag == "tr":
            if tables:
                t = tables[-1]
                below = t[4]
                t[1] += 1
                t[2] = 0
                t[3] = set(below)
                if below:
                    t[4] = {c: n - 1 for c, n in below.items() if n > 1}
            if opened:
                self._close(CELL_ENDS)
            return
        elif tag in _PLACES:
            if tag in ("ul", "ol"):
                self.n_lists += 1
                self.lists.append(self.n_lists)
            elif tag == "table":
                self.n_tables += 1
                tables.append([self.n_tables, -1, 0, set(), {}, said[3]])
            elif tag in ("nav", "footer"):
                self.nav += 1
            else:
                self.raw += 1
            return
        elif tag == "li":
            depth = len(self.lists)
            while opened and (opened[-1][TAG] in ("a", "p") or opened[-1][TAG] == "li" and opened[-1][DEPTH] >= depth):
                opened.pop()
        elif tag in HEADINGS:
            self._close(("p", "a"))
            level = int(tag[1])
        elif tag == "p":
            self._close(("p", "a"))
        elif tag not in _TOLD:
            return
        lists, rows = self.lists, self.rows
        row = [len(rows), tag, level, [], said[0], len(lists), lists[-1] if lists else None, tbl, at, col, said[1], said[2], cls, self.nav > 0, [r[0] for r in opened if r[1] == "li"] if opened else []]
        rows.append(row)
        opened.append(row)

    def handle_endtag(self, tag: str) -> None:
        opened = self.open
        if tag in _TOLD:
            if opened and opened[-1][TAG] == tag:
                opened.pop()
            elif any(r[TAG] == tag for r in opened):
                while opened.pop()[TAG] != tag:
                    pass
        elif tag in ("script", "style"):
            self.raw = max(0, self.raw - 1)
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
        elif tag in ("nav", "footer"):
            self.nav = max(0, self.nav - 1)
        elif tag == "table" and self.tables:
            self._close(CELL_ENDS)
            self.tables.pop()

    def handle_data(self, data: str | int) -> None:
        if self.raw or not self.open:
            return
        last, deepest = self.open[-1], 0
        for r in self.open:
            if r[TAG] == "li" and r[DEPTH] > deepest:
                deepest = r[DEPTH]
        for r in self.open:
            if r is last or r[TAG] != "li" or r[DEPTH] >= deepest:  # an item's text leaves out the items nested in it
                r[TEXT].append(data)


def _text(row: list) -> str:
    """A row's text with one space for each run of white space."""
    parts = row[3]
    return " ".join((parts[0] if len(parts) == 1 else "".join(parts)).split())


#: Tags as _read_pages tells them apart, and pages of plain tags by the order of those: their rows, and the places of each
#: row's texts. At most MOST_ROWS_KEPT rows are kept, of pages of at most MOST_TAGS tags.
MOST_ROWS_KEPT, MOST_TAGS, READ = 100_000, 1000, 1_000_000
_codes: dict[tuple, int] = {}
_tags: list[tuple] = []
_orders: dict[bytes, tuple[list[list], list[list[int]]]] = {}
_kept = [0]


def _code(name: str) -> int:
    """The number of a tag by what it does to a page's blocks (href left out), -1 where it is odd."""
    found = _known.get(name) or _plain(name)
    if not found:
        return -1
    kind, tag, said = found
    if kind != START:
        key: tuple = (kind, tag if kind == END else "", None)
    else:
        key = (kind, tag, (None, said[1], said[2], said[3] if tag == "table" else ""))
    code = _codes.get(key)
    if code is None:
        if len(_tags) >= MOST_KNOWN:
            return -1
        code = _codes[key] = len(_tags)
        _tags.append(key)
    return code


def _read_pages(html: pa.Array) -> Iterator[list[list]]:
    """The rows of each page, as _Blocks reads them, without href; the next page may change them.

    Which blocks a page has, where, and which of its texts they hold is told by its tags alone. Tags are taken apart for
    many pages at a time (about READ bytes), and an order of tags that came before is not read again: its rows get the
    page's texts. Pages with an odd construct are read one by one."""
    html = html.fill_null("")
    size = np.cumsum(pc.binary_length(html).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(html):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + READ)))
        part = html.slice(lo, hi - lo)
        lo = hi
        pieces = pc.split_pattern(part, "<")
        starts = np.concatenate(([0], np.cumsum(pc.list_value_length(pieces).to_numpy()))).tolist()
        halves = pc.split_pattern(pieces.flatten(), ">", max_splits=1)
        closed = pc.list_value_length(halves).to_numpy() == 2
        values = halves.flatten()
        at = np.concatenate(([0], np.cumsum(closed + 1)))[:-1]
        names = values.take(pa.array(at)).dictionary_encode()
        codes = np.array([_code(n) for n in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy()]
        codes[~closed] = -1
        texts = values.take(pa.array(at + closed)).to_numpy(zero_copy_only=False).tolist()
        coded = pc.match_substring(part, "&").to_numpy(zero_copy_only=False).tolist()
        for i in range(len(part)):
            a, b = starts[i] + 1, starts[i + 1]  # before the first tag there is no block
            order = codes[a:b].tobytes()
            found = _orders.get(order)
            if found is None:
                if b - a > MOST_TAGS or (codes[a:b] < 0).any():
                    yield _Blocks().read(part[i].as_py())
                    continue
                rows = _Blocks().trace([_tags[c] for c in codes[a:b]])
                found = rows, [r[3] for r in rows]
                if _kept[0] < MOST_ROWS_KEPT:
                    _kept[0] += len(rows) + 1
                    _orders[order] = found
            said = texts[a:b]
            if coded[i]:
                said = [unescape(x) if "&" in x else x for x in said]
            rows = found[0]
            for r, places in zip(rows, found[1], strict=True):
                r[3] = [said[x] for x in places]
            yield rows


#: Blocks that a worker sends at a time.
SENT = 5000
ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "double": pa.float64()}


def page_blocks(pages: DataFrame, columns: Sequence[str] = (), tags: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Ordered block rows of each page (page_id, html); null pages have none. `up` holds the seq of each list item that a
    block is in, outermost first. columns and tags: only those of BLOCKS and of the page's blocks (all where empty); keep:
    columns of pages that each block repeats.

    A worker holds the blocks of some pages at a time, however many come in a batch: it sends them in parts."""
    kinds = dict(c.split(" ") for c in BLOCKS.split(", "))
    names = [n for n in kinds if n not in ("page_id", *columns)] if not columns else [n for n in columns if n != "page_id"]
    at = [list(kinds).index(n) - 1 for n in names]
    wanted = frozenset(tags)
    kept = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            rows: list[list] = []
            for i in range(batch.num_rows):
                found = _Blocks().read(batch.column(1)[i].as_py() or "")
                if wanted:
                    found = [r for r in found if r[TAG] in wanted]
                for lo in range(0, len(found), SENT):
                    part = found[lo : lo + SENT]
                    rows += part
                    owner += [i] * len(part)
                    if len(rows) >= SENT:
                        yield _block_batch(batch, owner, rows, names, at, kinds)
                        owner, rows = [], []
            if rows:
                yield _block_batch(batch, owner, rows, names, at, kinds)

    schema = ", ".join(["page_id long", *[f"{n} {kinds[n]}" for n in names], *kept])
    return _few_pages(pages, *keep).mapInArrow(run, schema)


def _few_pages(pages: DataFrame, *keep: str) -> DataFrame:
    """page_id, html and columns to keep, of which a worker gets at most 1000 rows at a time."""
    few = "spark.sql.execution.arrow.maxRecordsPerBatch"
    pages.sparkSession.conf.set(few, min(1000, int(pages.sparkSession.conf.get(few)) or 1000))
    return pages.select("page_id" if pages.schema["page_id"].dataType.simpleString() == "bigint" else F.col("page_id").cast("long"), "html", *keep)


def _page_rows(pages: DataFrame, read: Callable[[list[list]], list[tuple]], schema: str) -> DataFrame:
    """page_id and the rows of `schema` that `read` makes of all blocks of a page (page_id, html), one page at a time: a
    page's blocks are never apart, so nothing is shuffled. Rows are sent in parts, as blocks are."""
    kinds = dict(c.split(" ") for c in schema.split(", "))

    def made(batch: pa.RecordBatch, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(values, ARROW[kind]) for values, kind in zip(zip(*rows, strict=True), kinds.values(), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int32())), *columns], names=["page_id", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            rows: list[tuple] = []
            for i, blocks in enumerate(_read_pages(batch.column(1))):
                found = read(blocks)
                for lo in range(0, len(found), SENT):
                    part = found[lo : lo + SENT]
                    rows += part
                    owner += [i] * len(part)
                    if len(rows) >= SENT:
                        yield made(batch, owner, rows)
                        owner, rows = [], []
            if rows:
                yield made(batch, owner, rows)

    return _few_pages(pages).mapInArrow(run, f"page_id long, {schema}")


def _cells_of(rows: list[list]) -> dict[int, list[list]]:
    """The cells of each table, by row and column: a table's cells begin in that order."""
    tables: dict[int, list[list]] = {}
    for r in rows:
        tbl = r[7]
        if tbl is not None:
            if tbl in tables:
                tables[tbl].append(r)
            else:
                tables[tbl] = [r]
    return tables


def _block_batch(batch: pa.RecordBatch, owner: list[int], rows: list[list], names: list[str], at: list[int], kinds: dict[str, str]) -> pa.RecordBatch:
    where = pa.array(owner, pa.int32())
    columns = [batch.column(0).take(where)]
    for n, i in zip(names, at, strict=True):
        values = [_text(r) for r in rows] if i == TEXT else [r[i] for r in rows]
        columns.append(pa.array(values, ARROW[kinds[n]]))
    return pa.RecordBatch.from_arrays([*columns, *[c.take(where) for c in batch.columns[2:]]], names=["page_id", *names, *batch.schema.names[2:]])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages with canonical_url and url_key (SHA-256 of it), one a canonical url: the one with the smallest page_id."""
    rows = spark.read.parquet(path).withColumn("canonical_url", canonical_url(F.col("url")))
    w = Window.partitionBy("canonical_url").orderBy("page_id")
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1 or canonical_url is null").drop("nth").withColumn("url_key", F.sha2("canonical_url", 256))


def resolve_redirects(pages: DataFrame, redirects: DataFrame) -> DataFrame:
    """Page identity by a redirects table (url, page_id, canonical_url): identity is the page id, else the url."""
    r = redirects.select("url", F.col("page_id").alias("r_id"), F.col("canonical_url").alias("r_url"))
    return pages.join(r, "url", "left").withColumn("canonical_url", F.coalesce("r_url", canonical_url(F.col("url")))).withColumn("identity", F.coalesce(F.col("r_id").cast("string"), "canonical_url")).drop("r_id", "r_url")


def discover_year_links(blocks: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """page_id, href, year, is_bc of links to year pages (n, AD_n, n_BC), each href once a page; low and high bound the
    years, both included, as "150 BC" or "44" say."""
    path = F.regexp_extract("href", r"^(?:https?://[^/]+)?/wiki/([^?#]+)$", 1)
    year = F.regexp_extract(path, r"^(?:AD_)?(\d{1,4})(?:_BC)?$", 1)
    rows = blocks.where("tag = 'a'").select("page_id", "href", year.alias("y"), path.endswith("_BC").alias("is_bc"))
    rows = rows.where("y <> '' and y not rlike '^0+$'").select("page_id", "href", F.col("y").cast("int").alias("year"), "is_bc").dropDuplicates(["page_id", "href"])
    bounds = [parse_year_bound(F.lit(x).cast("string")) for x in (low, high)]
    return rows.where(in_year_bounds(F.col("year"), F.col("is_bc"), *bounds)) if low or high else rows


def discover_period_links(blocks: DataFrame, host: str, title: str = "^(?:List of wars|Main article)") -> DataFrame:
    """page_id, href, text of links whose text fits title, and of the links after a "Main article:" in the same paragraph or
    item, on one host or relative to it, each once; pages of other name spaces (with a colon) are none."""
    same = F.coalesce(F.expr("try_parse_url(href, 'HOST')") == host, F.lit(False)) | (F.col("href").startswith("/") & ~F.col("href").startswith("//"))
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    holder = F.last(F.when(F.col("tag").isin("p", "li", "td", "h2", "h3", "h4"), F.struct("seq", "text")), ignorenulls=True).over(w)
    rows = blocks.withColumn("holder", holder).where(F.col("tag") == "a")
    named = F.col("text").rlike(title) | (F.coalesce(F.col("holder.text").rlike(r"(?i)^\s*Main articles?\s*:"), F.lit(False)) & F.col("holder.text").contains(F.col("text")) & (F.col("text") != ""))
    page = ~F.regexp_extract("href", r"^(?:https?://[^/]+)?/wiki/(.*)$", 1).contains(":")
    return rows.where(named & same & page).select("page_id", "href", "text").distinct()


def follow_links(links: DataFrame, pages: DataFrame, host: str) -> DataFrame:
    """The pages that discovered links lead to, each once, with the page that led there first (`found_on`); links are told
    by their canonical url, and a page that is not in the table gives no row."""
    full = F.when(F.col("href").startswith("/"), F.concat(F.lit(f"https://{host}"), "href")).otherwise(F.col("href"))
    wanted = links.select(canonical_url(full).alias("to"), F.col("page_id").alias("found_on")).groupBy("to").agg(F.min("found_on").alias("found_on"))
    have = pages.withColumn("to", canonical_url(F.col("url")))
    first = Window.partitionBy("to").orderBy("page_id")
    return have.join(wanted, "to").withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "to")


def links(blocks: DataFrame) -> DataFrame:
    """How many links each page has, in and out of navigation."""
    return blocks.where("tag = 'a'").groupBy("page_id").agg(F.count_if("in_nav").alias("nav_links"), F.count_if(~F.col("in_nav")).alias("body_links"))


def with_headings(blocks: DataFrame, *carried: str) -> DataFrame:
    """Add h2, h3 and h4: the headings that hold at each block, a deeper one only under its own parent; of each also the
    carried columns, as h2_span for span."""
    w = Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = blocks.withColumns({f"l{n}": F.last(F.when(F.col("level") <= n, F.struct("level", "text", *carried)), ignorenulls=True).over(w) for n in (2, 3, 4)})
    held = {f"h{n}{x and '_' + x}": F.when(F.col(f"l{n}.level") == n, F.col(f"l{n}.{x or 'text'}")) for n in (2, 3, 4) for x in ("", *carried)}
    return rows.withColumns(held).drop("l2", "l3", "l4")


def year_page_items(blocks: DataFrame) -> DataFrame:
    """List items between an Events h2 and the next h2, with their tag (h3, h4), kind and exclusion reason."""
    rows = with_headings(blocks).where((F.col("tag") == "li") & F.col("h2").rlike("(?i)^events"))
    month = F.col("h3").rlike("(?i)^(january|february|march|april|may|june|july|august|september|october|november|december|date unknown)")
    return rows.withColumn("item_tag", F.coalesce("h4", F.when(~F.coalesce(month, F.lit(False)), F.col("h3")))).withColumn("kind", F.when(month, "month").when(F.col("h3").isNotNull(), "tag").otherwise("generic")).withColumn("reason", exclude_item(F.col("text"), F.col("in_nav")))


def _scope(title: Column, h1: Column) -> tuple[Column, Column]:
    """The scope that a page's title or h1 names, and the era that they state."""
    both = F.concat_ws(" ", title, h1)
    scope = F.coalesce(scope_from_title(h1), scope_from_title(F.regexp_extract(title, r"^([^-|(]*\S)", 1)))
    return scope, F.when(both.rlike(r"\bBCE?\b"), True).when(both.rlike(r"\b(?:AD|CE)\b"), False)


def page_scope(blocks: DataFrame) -> DataFrame:
    """page_id, title, scope (from the title), is_bc: the era of the title or the h1, else of the scope."""
    rows = blocks.where("tag in ('title', 'h1')").groupBy("page_id").agg(F.min_by(F.when(F.col("tag") == "title", F.col("text")), "seq").alias("title"), F.min_by("text", F.struct(F.col("tag") != "h1", "seq")).alias("h1"))
    scope, era = _scope(F.col("title"), F.col("h1"))
    return rows.withColumn("scope", scope).withColumn("is_bc", F.coalesce(era, F.col("scope.is_bc"), F.lit(False)))


def with_scope(blocks: DataFrame) -> DataFrame:
    """Add page_year and page_bc of page_scope to the blocks of pages that have a title or an h1; the others go. The rows of
    a page stay together, and a page's title is read once."""
    page = Window.partitionBy("page_id")
    heads = F.col("tag").isin("title", "h1")
    first = F.struct(F.min(F.when(heads, F.col("seq"))).over(page).alias("at"), F.min_by(F.when(F.col("tag") == "title", F.col("text")), F.when(heads, F.col("seq"))).over(page).alias("title"), F.min_by("text", F.when(heads, F.struct(F.col("tag") != "h1", "seq"))).over(page).alias("h1"))
    rows = blocks.withColumn("_first", first).where("_first.at is not null")
    scope, era = _scope(F.col("_first.title"), F.col("_first.h1"))
    told = F.when(F.col("seq") == F.col("_first.at"), F.struct(scope.alias("scope"), era.alias("era")))
    rows = rows.withColumn("_told", told).withColumn("_told", F.first("_told", ignorenulls=True).over(page))
    return rows.withColumns({"page_year": F.col("_told.scope.start"), "page_bc": F.coalesce("_told.era", "_told.scope.is_bc", F.lit(False))}).drop("_first", "_told")


def year_page_events(pages: DataFrame) -> DataFrame:
    """Events of year pages: page_id, seq, title, description, span, weight, category, and debug: the text that was read
    for a date, how it matched, the page's year and era, and the headings over it."""
    blocks = page_blocks(pages, ("seq", "tag", "level", "text", "in_nav"), ("title", "h1", "h2", "h3", "h4", "li"))
    rows = year_page_items(with_scope(blocks)).where("reason is null")
    # a bullet under a month heading begins with its day, so the month goes before it
    text = F.when((F.col("kind") == "month") & F.col("text").rlike(r"^\d{1,2}\b"), F.concat_ws(" ", "h3", "text")).otherwise(F.col("text"))
    rows = extract_spans(rows.withColumn("dated", text), "dated", "page_year", "page_bc", "years").where("span is not null")
    debug = F.struct(F.col("dated").alias("original"), F.col("span.match_type").alias("match_type"), "page_year", "page_bc", "kind", "h2", "h3", "h4").alias("debug")
    return rows.select("page_id", "seq", trim_leading_date(F.col("dated")).alias("title"), F.col("text").alias("description"), "span", "weight", F.col("item_tag").alias("category"), debug)


def table_rows(blocks: DataFrame) -> DataFrame:
    """page_id, tbl, row, cells (array of texts), headers of the table, rowspans."""
    cells = blocks.where("tag in ('td', 'th')")
    item = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("col", c))), lambda x: x[c])
    rows = cells.groupBy("page_id", "tbl", "row").agg(item("text").alias("cells"), item("rowspan").alias("rowspans"), F.bool_and(F.col("tag") == "th").alias("header"))
    heads = rows.where("header").groupBy("page_id", "tbl").agg(F.min_by("cells", "row").alias("headers"))
    return rows.where("not header").join(heads, ["page_id", "tbl"], "left").drop("header")


def _heading_span(text: Column, level: Column, own: Column) -> Column:
    """A heading's years: two years with or without an era are a range; h3 and h4 without a digit have none of their own."""
    two = r"(?i)^\s*(\d{1,4})\s*[-–—−]\s*(\d{1,4})\s*(BCE|BC|CE|AD)?\s*$"
    part = lambda i: F.regexp_extract(text, two, i)
    bc = F.upper(part(3)).startswith("BC")
    found = F.when(text.rlike(two), F.struct(part(1).try_cast("int").alias("start_year"), part(2).try_cast("int").alias("end_year"), bc.alias("start_bc"), bc.alias("end_bc")))
    return found.when(own.isNotNull() & ((level == 2) | text.rlike(r"\d")), F.struct(own.start_year, own.end_year, own.start_year_is_bc.alias("start_bc"), own.end_year_is_bc.alias("end_bc")))


def sectioned_events(pages: DataFrame, anchor_year: int = 2000, blocks: DataFrame | None = None) -> DataFrame:
    """Events of list items and of rows of two-column tables under headings.

    page_id, seq, section, title, description, start_year, end_year, is_bc_start, is_bc_end, confidence, precision,
    source (bullet or table), match_type. A list item has its own date in front, else one inside its text, else that of the
    nearest heading over it that has one. A row of a table with two cells or more is its first cell's date and its second
    cell's text; where the first cell is no date, the second is read as an item is. Items without a date under undated
    headings, empty items, years that are none (0, or AD in reverse), and all of reference sections give none. Null and
    empty pages have no blocks. A page is read whole, from its html to its events, by one task and without a shuffle.
    blocks: page_blocks(pages), where it is stored; then, and where food_inline has rules of a caller's own, which are
    columns, all texts of a page are read for spans by columns, each heading once, and all steps but the first keep the
    rows of a page together."""
    if blocks is None and not scalars.has_own_rules():
        return _page_rows(pages, _sections(anchor_year), SECTIONED)
    wanted = ("seq", "tag", "level", "text", "tbl", "row", "col", "in_nav")
    blocks = (page_blocks(pages, wanted, ("li", "h1", "h2", "h3", "h4", "td", "th")) if blocks is None else blocks).where("not in_nav and tag in ('li', 'h1', 'h2', 'h3', 'h4', 'td', 'th')").repartition("page_id")
    line = Window.partitionBy("page_id", "tbl", "row")
    cell = F.col("tbl").isNotNull()
    rows = blocks.withColumns({"nth": F.row_number().over(line.orderBy("col", "seq")), "told": F.lead("text").over(line.orderBy("col", "seq")), "names": F.max(F.col("tag") == "th").over(line) & (F.col("row") == 0)})
    rows = rows.where(~F.col("tag").isin("td", "th") | (cell & (F.col("nth") == 1) & F.col("told").isNotNull() & ~F.col("names")))
    rows = rows.withColumn("said", strip(F.regexp_replace(strip_citations(F.when(cell, F.col("told")).otherwise(F.col("text"))), r"\[edit\]", ""))).where("said <> ''")
    heading = F.col("level").isNotNull()
    texts = F.when(heading, F.array("said")).when(cell, F.concat(F.array("text", "said"), date_chunks(F.col("said")))).otherwise(F.concat(F.array("said"), date_chunks(F.col("said"))))
    item = ["page_id", "seq", "tag", "level", "tbl", "said"]
    rows = rows.select(*item, F.posexplode(texts).alias("pos", "chunk"))
    rows = extract_spans(rows, "chunk", F.lit(anchor_year), F.lit(False), "food_inline", "own")
    rows = rows.groupBy("page_id", "seq").agg(F.first(F.struct(*item[2:])).alias("of"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("pos"))).alias("own")).select("page_id", "seq", "of.*", "own")
    rows = with_headings(rows.withColumn("text", F.col("said")).withColumn("at", _heading_span(F.col("said"), F.col("level"), F.col("own"))), "at")
    rows = rows.withColumns({"section": F.coalesce("h4", "h3", "h2"), "under": F.coalesce("h4_at", "h3_at", "h2_at")})
    rows = rows.where(F.col("level").isNull() & ~F.coalesce(is_meta_section(F.col("h2")), F.lit(False)) & (F.col("own").isNotNull() | F.col("under").isNotNull()))
    inferred = F.col("own").isNull()
    got = lambda a, b: F.when(inferred, F.col(f"under.{b}")).otherwise(F.col(f"own.{a}"))
    years = {"start_year": got("start_year", "start_year"), "end_year": got("end_year", "end_year"), "is_bc_start": got("start_year_is_bc", "start_bc"), "is_bc_end": got("end_year_is_bc", "end_bc")}
    rows = rows.withColumns(years).withColumn("match_type", F.when(inferred, "Section").otherwise(F.col("own.match_type")))
    doubt = F.col("said").rlike(r"(?i)\b(?:contentious|disputed)\b")
    sure = food_confidence(F.col("match_type"), doubt, inferred)
    precision = ancient_precision(F.col("start_year"), F.col("is_bc_start"), F.coalesce(F.col("own.precision"), F.lit(0.3)))
    signed = [F.when(F.col(f"is_bc_{e}"), -F.col(f"{e}_year")).otherwise(F.col(f"{e}_year")) for e in ("start", "end")]
    rows = rows.withColumn("fault", bc_ad_normalise(*signed)["error"]).where("fault is null")
    source = F.when(F.col("tbl").isNotNull(), "table").otherwise("bullet")
    return rows.select("page_id", "seq", "section", short_title(first_sentence(F.col("said"))).alias("title"), F.col("said").alias("description"), *years, sure.alias("confidence"), precision.alias("precision"), source.alias("source"), "match_type")


SECTIONED = "seq int, section string, title string, description string, start_year int, end_year int, is_bc_start boolean, is_bc_end boolean, confidence string, precision double, source string, match_type string"


SECTION_TAGS = frozenset(("li", "td", "th", *HEADINGS[:4]))


def _sections(anchor: int) -> Callable[[list[list]], list[tuple]]:
    """A page's blocks to the rows of sectioned_events."""
    food_span, said = scalars.food_span, scalars.said

    def own_span(words: str, cell: str | None) -> scalars.Span | None:
        """The first date of the cell, the text and the parts of it that may be one."""
        found = cell and food_span(cell, anchor) or food_span(words, anchor)
        if not found:
            for x in scalars.chunks(words):
                found = food_span(x, anchor)
                if found:
                    break
        return found

    def read(rows: list[list]) -> list[tuple]:
        rows = [r for r in rows if r[1] in SECTION_TAGS and not r[13]]
        lines: dict[tuple, list[list]] = {}
        for r in rows:
            if r[7] is not None:
                lines.setdefault((r[7], r[8]), []).append(r)
        out: list[tuple] = []
        h2 = h3 = h4 = (0, None, None)  # the last heading of at most that level: level, text, years
        section = under = None
        meta = False
        for r in rows:
            level, cell = r[2], None
            if level is None and r[1] != "li":
                line = lines.get((r[7], r[8]), ())
                if len(line) < 2 or line[0] is not r or (r[8] == 0 and any(c[1] == "th" for c in line)):
                    continue
                cell, words = _text(r), said(_text(line[1]))
            else:
                words = said(_text(r))
            if not words:
                continue
            if level is not None:
                h4 = (level, words, scalars.heading_years(words, level, food_span(words, anchor)))
                h3 = h4 if level <= 3 else h3
                h2 = h4 if level <= 2 else h2
                over = [h[1:] for h, n in ((h4, 4), (h3, 3), (h2, 2)) if h[0] == n]
                section, under = over[0][0] if over else None, next((at for _, at in over if at), None)
                meta = h2[0] == 2 and scalars.is_meta(h2[1])
                continue
            if meta:
                continue
            own = own_span(words, cell)
            if own:
                first, last, first_bc, last_bc, match_type, precision = own
            elif under:
                (first, last, first_bc, last_bc), match_type, precision = under, "Section", 0.3
            else:
                continue
            if not first or not last or (first > last and not first_bc and not last_bc):
                continue
            if first_bc and first > 10000 and precision > 0.3:
                precision = max(0.1, precision * 0.5)
            sure = scalars.food_confidence(match_type, scalars.is_doubtful(words), not own)
            out.append((r[0], section, scalars.title_of(words), words, first, last, first_bc, last_bc, sure, precision, "bullet" if cell is None else "table", match_type))
        return out

    return read


# Sections of the page of periods, and the year that "present" stands for.
PERIOD_SECTIONS = ("Technological periods", "African periods", "American (continent) periods", "Asian periods", "European periods", "Oceanian periods")
PRESENT = 2026


def period_events(pages: DataFrame, sections: Sequence[str] = PERIOD_SECTIONS, present: int = PRESENT, blocks: DataFrame | None = None) -> DataFrame:
    """Events of nested lists of periods under the named headings.

    page_id, seq, title, description, span, weight, category, url, debug. An item whose text ends with a bracket that holds
    a year of three or four digits is an event; any other one is a header, which goes before the titles of all events in
    it, outermost first. "present" is a year. The category is the outermost header, else the section; the url is the item's
    first link to a page. Titles and descriptions have 500 characters at most. Events without a valid span go; headings are
    told from [edit] marks, and a section ends at the next heading of its level or above. Each item comes once. blocks:
    page_blocks(pages), where it is stored."""
    wanted = ("seq", "tag", "level", "text", "href", "in_nav", "up")
    blocks = page_blocks(pages, wanted, ("li", "a", "h1", "h2", "h3", "h4")) if blocks is None else blocks
    link = (F.col("tag") == "a") & F.col("href").startswith("/wiki/")
    blocks = blocks.where((F.col("tag") == "li") | (F.col("level") <= 4) | link).repartition("page_id")
    rows = with_headings(blocks.withColumn("text", F.when(F.col("level").isNotNull(), strip(F.regexp_replace("text", r"\[edit\]", ""))).otherwise(F.col("text"))))
    named = lambda c: F.when(F.col(c).isin(*sections), F.col(c))
    rows = rows.withColumn("in_section", F.coalesce(named("h4"), named("h3"), named("h2"))).where((F.col("tag") == "a") | ((F.col("tag") == "li") & ~F.col("in_nav") & F.col("in_section").isNotNull()))
    dated = r"\([^)]*\d{3,4}[^)]*\)\s*$"
    item = F.col("tag") == "li"
    rows = rows.select("page_id", "seq", "tag", "text", "up", "href", "in_section", (item & F.col("text").rlike(dated)).alias("is_event"), F.when(item, strip(F.regexp_replace(F.regexp_replace("text", r"\[edit\]", ""), r"\s+", " "))).alias("clean"))
    # each item stands at its own place; events also at the items over them, links at the items that hold them
    own = F.struct(F.col("seq").alias("of"), F.col("seq").alias("at"), F.lit(-1).alias("nth"))
    over = F.transform("up", lambda x, i: F.struct(F.col("seq").alias("of"), x.alias("at"), i.alias("nth")))
    held = F.transform("up", lambda x, i: F.struct(x.alias("of"), x.alias("at"), F.lit(-1).alias("nth")))
    rows = rows.withColumn("place", F.explode(F.when(~item, held).when(F.col("is_event"), F.concat(F.array(own), over)).otherwise(F.array(own))))
    rows = rows.withColumn("header", F.max(F.when(item & ~F.col("is_event") & (F.col("place.nth") == -1), F.col("clean"))).over(Window.partitionBy("page_id", "place.at")))
    headers = F.array_sort(F.collect_list(F.when((F.col("place.nth") >= 0) & F.col("header").isNotNull(), F.struct("place.nth", "header"))))
    event = F.first(F.when(F.col("is_event") & (F.col("place.nth") == -1), F.struct("text", "in_section", "clean")), ignorenulls=True)
    rows = rows.groupBy("page_id", F.col("place.of").alias("seq")).agg(event.alias("event"), F.transform(headers, lambda x: x.header).alias("headers"), F.min_by("href", F.when(~item, F.col("seq"))).alias("href"))
    rows = rows.where("event is not null").select("page_id", "seq", "event.*", "headers", "href")
    rows = rows.withColumn("dated", F.regexp_replace("text", r"(?i)\bpresent\b", str(present)))
    rows = extract_spans(rows, "dated", F.lit(2000), F.lit(False), "time_periods").where("span is not null")
    name = strip(F.regexp_replace(F.regexp_replace("clean", dated, ""), r"\[.*?\]", ""))
    short = lambda c: F.when(F.length(c) > 500, F.concat(F.substring(c, 1, 497), F.lit("..."))).otherwise(c)
    title = F.array_join(F.concat("headers", F.array(name)), " - ")
    told = F.when(F.size("headers") > 0, F.concat(name, F.lit(" (from "), F.array_join("headers", " / "), F.lit(")"))).otherwise(name)
    debug = F.struct(F.col("text").alias("original"), "headers", F.col("in_section").alias("section"), F.col("span.match_type").alias("match_type"))
    return rows.select("page_id", "seq", short(title).alias("title"), short(told).alias("description"), "span", "weight", F.coalesce(F.get("headers", F.lit(0)), "in_section").alias("category"), F.col("href").alias("url"), debug.alias("debug"))


#: Pages of one century by their url, and main pages.
CENTURY_PAGE, MAIN_PAGE = r"(?i)\b(\d{1,2}(?:st|nd|rd|th))_century", r"(?i)/[^/]*_of_[^/]*history[^/]*$"


def chronology_events(pages: DataFrame, main: str = MAIN_PAGE, no_event: tuple[str, ...] = NO_EVENT, blocks: DataFrame | None = None) -> DataFrame:
    """Events of chronology pages (page_id, url, html): page_id, seq, page_kind, kind, title, description, start_year,
    end_year, is_bc_start, is_bc_end, precision, url.

    A page is a century's by its url, else a main page where `main` fits its url, else an article. All end at the first
    heading (h2 to h4) that says "See also". A century page with lists under headings that are years gives the items of
    each such heading's first list, the year before the text; one without gives its outer items, and for those that hold a
    list the items in it, with the year of the outer item's text before theirs. Main pages give the items of sections that
    are no lists of references, articles all items. Texts of ten characters or fewer (five under a year) are left out. What
    an item is and its years are told by candidate_kinds; references and headers give no event, and items of main pages and
    articles need a date of their own. Null and empty pages give none. blocks: page_blocks(pages), where it is stored."""
    page = Window.partitionBy("page_id")
    w = page.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = F.col("level").between(2, 4) & F.col("text").rlike(r"(?i)\bSee also\b")
    if blocks is None:
        blocks = page_blocks(pages, ("seq", "tag", "level", "text", "lst", "in_nav", "up"), ("title", "h1", "h2", "h3", "h4", "li"), ("url",))
    else:  # by a shuffle, since urls that are alike look small enough to be sent whole
        blocks = blocks.join(pages.select("page_id", "url").hint("shuffle_merge"), "page_id")
    blocks = blocks.where("not in_nav").repartition("page_id").withColumn("over", F.max(F.coalesce(ends, F.lit(False))).over(w)).where("not over")
    title = F.min_by("text", F.when(F.col("tag").isin("title", "h1"), F.struct(F.col("tag") != "h1", "seq"))).over(page)
    blocks = blocks.withColumn("under", F.last(F.when(F.col("level").between(2, 4), F.struct("seq", "level", F.regexp_replace("text", r"\[edit\]", "").alias("text"))), ignorenulls=True).over(w)).withColumn("page_title", title)
    century = F.nullif(F.lower(F.regexp_extract("url", CENTURY_PAGE, 1)), F.lit(""))
    rows = blocks.where("tag = 'li'").withColumn("century", century).withColumn("page_kind", F.when(F.col("century").isNotNull(), "century").when(F.col("url").rlike(main), "main").otherwise("article"))
    section = Window.partitionBy("page_id", "under.seq")
    rows = rows.withColumn("outer", F.size("up") == 0).withColumn("has_years", F.max(F.coalesce((F.col("page_kind") == "century") & (F.col("under.level") == 3), F.lit(False))).over(page)).withColumn("first_list", F.min(F.when(F.col("outer"), F.col("lst"))).over(section))
    # an outer item with a list in it lends those items its year: they meet at its place
    lends = (F.col("page_kind") == "century") & ~F.col("has_years")
    deep = F.size("up") == 1
    place = Window.partitionBy("page_id", "holder")
    rows = rows.withColumn("holder", F.when(deep, F.get("up", F.lit(0))).otherwise(F.col("seq")))
    lent = F.max(F.when(lends & ~deep, F.regexp_extract("text", r"(\d{4})", 1))).over(place)
    rows = rows.withColumns({"lent": lent, "holds": F.max(deep & lends).over(place)}).withColumns({"lent": F.when(deep, F.col("lent")), "holds": F.when(F.col("holds"), True)})
    before = F.concat(F.coalesce(F.when(F.col("has_years"), F.col("under.text")), F.col("lent")), F.lit(" – "), F.col("text"))
    by_year = F.col("has_years") & (F.col("under.level") == 3) & F.col("under.text").rlike(r"^\d{4}$") & F.col("outer") & (F.col("lst") == F.col("first_list"))
    said = F.when(F.col("page_kind") == "century", F.when(F.col("has_years"), F.when(by_year & (F.length("text") > 5), before)).when(F.col("outer") & F.col("holds").isNull() & (F.length("text") > 10), F.col("text")).when((F.col("lent") != "") & (F.length("text") > 5), before))
    listed = F.coalesce(F.col("under.text").rlike(r"(?i)\b(?:References|External links|Bibliography|Sources|Navigation)\b"), F.lit(False))
    free = (F.length("text") > 10) & ((F.col("page_kind") == "article") | (F.col("under").isNotNull() & ~listed))
    rows = rows.withColumn("said", said.when(free, F.col("text"))).where("said is not null")
    rows = candidate_kinds(rows, "said", "page_title", "century", no_event).where("candidate.kind = 'dated' or candidate.kind = 'undated' and page_kind = 'century'")
    return rows.select("page_id", "seq", "page_kind", "candidate.kind", "candidate.title", F.col("said").alias("description"), *[f"candidate.{c}" for c in ("start_year", "end_year", "is_bc_start", "is_bc_end", "precision")], "url")


def page_titles(blocks: DataFrame) -> DataFrame:
    """page_id, page_title: a page's first h1, else its title."""
    return blocks.where("tag in ('title', 'h1')").groupBy("page_id").agg(F.min_by("text", F.struct(F.col("tag") != "h1", "seq")).alias("page_title"))


def table_grid(blocks: DataFrame) -> DataFrame:
    """page_id, tbl, cls, row, col, text, is_th, from_row: a row for each place of each table's grid. Cells fill all places
    that they span, down to the table's last row; where two reach one place, the one that began first holds it."""
    cells = blocks.where("tag in ('td', 'th') and tbl is not null and not in_nav")
    last = F.max("row").over(Window.partitionBy("page_id", "tbl"))
    cells = cells.withColumn("last", last)
    cells = cells.withColumn("at", F.explode(F.sequence("row", F.least(F.col("row") + F.col("rowspan") - 1, "last")))).withColumn("to", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)))
    of = F.min_by(F.struct("cls", "text", (F.col("tag") == "th").alias("is_th"), F.col("row").alias("from_row")), "seq")
    return cells.groupBy("page_id", "tbl", F.col("at").alias("row"), F.col("to").alias("col")).agg(of.alias("of")).select("page_id", "tbl", "of.cls", "row", "col", "of.text", "of.is_th", "of.from_row")


def dated_tables(pages: DataFrame, table_class: str = "wikitable") -> DataFrame:
    """Every data row of year/date/event tables of a class (all tables where it is empty), with what was made of it:
    page_id, tbl, row, title, description, year_text, date, confidence, fault.

    The first column of the grid is the year, carried down by its rowspan, the second the date, all others the event.
    fault is null for events, `short` for rows that fill fewer than two places, `no text` without an event text, and `no
    date` where the year is none. A carried year is inferred unless its confidence says less. Rows of headers are none."""
    rows = _page_rows(pages, _year_rows(table_class), DATED)
    date = F.struct(*[F.col(c) for c in ("start", "end", "start_month", "start_day", "end_month", "precision")], F.col("stated").alias("confidence"))
    return rows.select("page_id", "tbl", "row", "title", "description", "year_text", F.when(F.col("start").isNotNull(), date).alias("date"), "confidence", "fault")


DATED = "tbl int, row int, title string, description string, year_text string, start int, end int, start_month int, start_day int, end_month int, precision double, stated string, confidence string, fault string"


def _year_rows(table_class: str) -> Callable[[list[list]], list[tuple]]:
    """A page's blocks to the rows of dated_tables, its date in parts."""
    blank = re.compile(r"\s+", re.A)
    no_date = (None,) * 7

    def read(rows: list[list]) -> list[tuple]:
        out: list[tuple] = []
        for tbl, cells in _cells_of(rows).items():
            cells = [c for c in cells if not c[13]]
            if not cells or (table_class and table_class not in blank.split(cells[0][12])):
                continue
            held: list[tuple] = []
            i, n, last = 0, len(cells), cells[-1][8]
            for row in range(cells[0][8], last + 1):
                now, held = held, []
                while i < n and cells[i][8] == row:
                    now.append((cells[i], _text(cells[i])))
                    i += 1
                # where two cells reach one place, the one that began first holds it
                places: dict[int, tuple] = {}
                for x in now:
                    c = x[0]
                    col, colspan = c[9], c[11]
                    if colspan > 1:
                        for j in range(col, col + colspan):
                            places.setdefault(j, x)
                    elif col not in places:
                        places[col] = x
                    if c[10] > 1 and c[8] + c[10] > row + 1:
                        held.append(x)
                if all(x[0][1] == "th" for x in places.values()):
                    continue
                year, day = places.get(0), places.get(1)
                said = " ".join([places[col][1] for col in sorted(places) if col >= 2]).strip(" ")
                year_text = year and year[1]
                date = scalars.cell_date(year_text, day and day[1])
                sure = date and ("inferred" if year[0][8] < row and date[6] == "explicit" else date[6])
                fault = "short" if len(places) < 2 else "no date" if date is None else "no text" if not said else None
                out.append((tbl, row, said[:100], said, year_text, *(date or no_date), sure, fault))
        return out

    return read


def table_events(pages: DataFrame, table_class: str = "wikitable") -> DataFrame:
    """The events of dated_tables."""
    return dated_tables(pages, table_class).where("fault is null").drop("fault")


def table_counts(rows: DataFrame) -> DataFrame:
    """Of dated_tables, one row a page: tables, rows, events, and skipped rows by fault."""
    skipped = {f"n_{fault.replace(' ', '_')}": F.count_if(F.col("fault") == fault) for fault in ("short", "no date", "no text")}
    return rows.groupBy("page_id").agg(F.count_distinct("tbl").alias("tables"), F.count("*").alias("rows"), F.count_if(F.col("fault").isNull()).alias("events"), *[c.alias(n) for n, c in skipped.items()])


def war_events(pages: DataFrame) -> DataFrame:
    """Events of war tables: page_id, tbl, row, title, description, years with eras, weight, precision, category.

    A war table has a year, a start, an end or a date among its first five cells. Rows after the first with three cells
    or more are read as war_row reads them; the others, and those of no shape, give none. Weight is 365 days a year."""
    return _page_rows(pages, _war_rows, WARS).select("page_id", "tbl", "row", "title", "description", "start_year", "end_year", "is_bc_start", "is_bc_end", "weight", F.lit(YEAR_ONLY).alias("precision"), F.lit("War").alias("category"), F.col("shape").alias("span_match_notes"))


WARS = "tbl int, row int, title string, description string, start_year int, end_year int, is_bc_start boolean, is_bc_end boolean, weight int, shape string"


def _war_rows(rows: list[list]) -> list[tuple]:
    """A page's blocks to the rows of war_events."""
    out: list[tuple] = []
    for tbl, cells in _cells_of(rows).items():
        first = [_text(c) for c in cells[:5]]
        if not any("year" in x or x in ("start", "end", "date") for x in [x.lower() for x in first]):
            continue
        texts = first + [_text(c) for c in cells[5:]]
        i, n = 0, len(cells)
        while i < n:
            at, row = i, cells[i][8]
            while i < n and cells[i][8] == row:
                i += 1
            war = scalars.war_event(texts[at:i]) if row > 0 and i - at >= 3 else None
            if not war:
                continue
            shape, start, end, title, fought, notes = war
            told = f"Belligerents: {', '.join(fought)}" if fought else ""
            told = f"{told}. {notes}" if told and notes else told or notes
            years = 1 if end is None else (end + 1 if end < 0 else end) - (start + 1 if start < 0 else start) + 1
            out.append((tbl, row, title, told, abs(start), None if end is None else abs(end), start < 0, None if end is None else end < 0, max(1, years) * 365, shape))
    return out
