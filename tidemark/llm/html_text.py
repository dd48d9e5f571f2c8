"""The main text of web pages, with a host's repeated boilerplate found by a suffix array.

A page is read as blocks of text (paragraphs, headings, list items, cells and so on). Scripts, styles and
markup go; menus, headers, footers, sidebars, notices, adverts, forms and reader comments are told by their
elements, roles, classes and ids. If a page marks its main part (``article`` or ``main``), the blocks in it
that are not of those kinds are its text; on other pages all blocks that are not.

From this text of every page, marked or not, boilerplate is taken by the token streams of its host. A page has two streams: the blocks of
its marked main part, and its other (loose) blocks; all of them are in the array. The suffixes that start at each token are sorted by host
and their first ``depth`` tokens, which is the host's suffix array as far as it is needed. Each suffix is compared with its neighbour: a
run of neighbours with equal ``depth`` tokens on different pages is a long repeated substring. Such a substring is boilerplate if it stands on at least ``PAGES`` pages
that differ and on at least the share ``OF_HOST`` of the host's different pages, so quotations, revisions and syndicated texts that a few pages
share are not. All tokens that boilerplate covers are removed, and the other runs stay. A page of which more
than the share ``MOST`` would go (one of many near copies) keeps its whole text. Boilerplate on fewer pages is kept: text is rather left in than lost.

The array is made in two steps, so that not every suffix of every page is sent and sorted by its words:

1. A host's different pages are dealt into parts of about ``PART_PAGES`` pages by a hash, with 16 bits per token. The suffixes of a part are sorted in memory. What stands on a share
   of a host's pages stands on that share of the pages of some part, so runs below it in every part are no boilerplate; equal bits for unlike tokens only make runs longer. The
   runs that reach it are named by 64 bits, in a bitmap of a bounded size, where a false hit only lets a suffix through.
2. The suffixes that the bitmap lets through are sorted by host and words over all tasks, in ranges that also part equal suffixes by page, and runs that go on in the next range are
   summed. So neither a host that owns a third of all pages nor a footer on every page gathers in one task, and what is removed is counted on the words themselves.

Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty line.

Defined cases: null html counts as empty and has no text; unclosed elements end with their parent or the page;
a null url has the host ''; rows may repeat and ids be null; pages with equal blocks count as one; an empty table gives
no rows; other columns are not looked at.
"""

from __future__ import annotations

import html as markup
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.chunks import hashes, numbered
from tidemark.llm.collocations import Bitmap
from tidemark.llm.common import in_batches, small
from tidemark.llm.words import mixed
from tidemark.session import cut_lineage

DEPTH = 8
#: Boilerplate is on so many different pages of a host and on such a share of them; a page that would lose more than ``MOST`` of its tokens loses none.
PAGES, OF_HOST, MOST = 3, 0.25, 0.8
#: A host's pages are dealt into parts of about so many pages; a part is sorted in pieces of about so many tokens.
PART_PAGES, PIECE_TOKENS = 2000, 1_000_000
#: Elements whose content is never text, elements that are never the main text, and elements that end a block.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "audio", "video", "select")
SIDE = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label", "option", "head"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu",
    "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MAIN = {"article", "main"}
REPEATED = {"p", "li", "dd", "dt", "option", "tr", "td", "th"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|widget\w*|footer\w*|masthead|site-?header|page-?header|topbar|toolbar"
    r"|comments?|commentlist|replies|disqus\w*|discussion|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|overlay|newsletter|subscri\w*|signup|login"
    r"|share\w*|sharing|social\w*|related\w*|recommend\w*|teasers?|tags?|pagination|pager|skip-?link|copyright|legal|disclaimer)(?=$|[\s_-])",
    re.IGNORECASE,
)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies))(?=$|[\s_-])", re.IGNORECASE)
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))"
    r"|<(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.IGNORECASE)


def is_side(name: str, attributes: str, in_main: bool) -> bool:
    """Whether an element's markup says that it is not main text."""
    if name in SIDE and not (name == "header" and in_main):
        return True
    if not attributes or name in ("html", "body", "main"):
        return False
    names = COMMENTS if name == "article" else NAMES
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").strip().lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in ROLES or key in ("class", "id") and names.search(value):
            return True
    return False


class Reader:
    """Collects the blocks of one page; ``stack`` holds the open elements with what their content is."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, bool, bool]] = []
        self.parts: list[str] = []
        self.stack: list[tuple[str, bool, bool, list[str] | None]] = []  # name, main part, boilerplate, text before it
        self.main = self.side = self.marked = False

    def close(self) -> None:
        text = " ".join(markup.unescape("".join(self.parts)).split())
        if text:
            self.blocks.append((text, self.main, self.side))
        self.parts = []

    def settle(self) -> None:
        self.main, self.side = self.stack[-1][1:3] if self.stack else (False, False)

    def leave(self, depth: int) -> None:
        """Ends open elements until ``depth`` are left. Boilerplate inside a paragraph does not cut it in two."""
        while len(self.stack) > depth:
            name, main, side, before = self.stack.pop()
            self.main, self.side = main, side
            if name in BLOCK or before is not None:
                self.close()
            if before is not None:
                self.parts = before
        self.settle()

    def begin(self, name: str, attributes: str) -> None:
        if name == "body":
            self.leave(0)
        if name in REPEATED:
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] == name:
                    self.leave(k)
                    break
                if self.stack[k][0] in BLOCK:
                    break
        if name in BLOCK:
            self.close()
        side = self.side or is_side(name, attributes, self.main)
        before = None
        if side != self.side and name not in BLOCK:
            before, self.parts = self.parts, []
        main = self.main or (name in MAIN or 'role="main"' in attributes) and not side
        self.marked |= main
        self.stack.append((name, main, side, before))
        if attributes.rstrip().endswith("/") and name not in BLOCK:
            self.leave(len(self.stack) - 1)
        self.settle()

    def end(self, name: str) -> None:
        at = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k][0] == name), None)
        if name in BLOCK:
            self.close()
        if at is not None and (name in BLOCK or not any(x[0] in BLOCK for x in self.stack[at:])):  # a stray inline end tag closes no blocks
            self.leave(at)


def read_blocks(page: str) -> tuple[list[tuple[str, bool, bool]], bool]:
    """``(text, in main part, told to be boilerplate)`` of every block with text, in page order; and whether a main part is marked."""
    reader, position = Reader(), 0
    for found in TOKEN.finditer(page):
        if found.start() > position:
            reader.parts.append(page[position : found.start()])
        position = found.end()
        end, name, attributes = (found[2], found[3], found[4]) if found[3] else (found[5], found[6], found[7])
        name = (name or "").lower()
        if name == "br":
            reader.parts.append(" ")
        elif name in VOID:
            if name in BLOCK:
                reader.close()
        elif name and end:
            reader.end(name)
        elif name:
            reader.begin(name, attributes or "")
    reader.parts.append(page[position:])
    reader.leave(0)
    reader.close()
    return reader.blocks, reader.marked


BLOCKS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("side", T.BooleanType())]))


def parsed(pages: DataFrame) -> DataFrame:
    """Per page ``page_id, url, host, page`` (a digest of the row), ``marked`` (text of its marked main part or null) and ``loose`` (its other blocks)."""
    source = F.coalesce(F.col("html"), F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[^/]*//([^/?#]*)", 1)), F.lit(""))
    digest = F.xxhash64("page_id", "url", source)
    rows = pages.select("page_id", "url", host.alias("host"), digest.alias("page"), source.alias("html"))
    schema = T.StructType([*rows.schema.fields[:4], T.StructField("marked", T.StringType()), T.StructField("loose", BLOCKS)])
    kind = pa.list_(pa.struct([("text", pa.string()), ("side", pa.bool_())]))

    def work(batches):
        for batch in batches:
            marked, loose = [], []
            for page in batch.column(4).to_pylist():
                blocks, has_main = read_blocks(page)
                own = [text for text, main, side in blocks if main and not side]
                marked.append("\n\n".join(own) if has_main else None)
                loose.append([{"text": text, "side": side} for text, main, side in blocks if not main])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(marked, pa.string()), pa.array(loose, kind)], names=schema.names)

    return in_batches(rows, work, schema)


def marks_of(streams: list[str]) -> list[np.ndarray]:
    """16 bits of every token of each stream; equal tokens have equal bits."""
    cut = [stream.encode().split(b" ") if stream else [] for stream in streams]
    words, ids = numbered([word for tokens in cut for word in tokens])
    return np.split((hashes(words) >> np.uint64(48)).astype(np.uint16)[ids], np.cumsum([len(tokens) for tokens in cut])[:-1]) if cut else []


def heads(streams: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of every suffix with ``depth`` tokens: the number of its stream, its place there, and the bits of its first ``depth`` tokens in numbers that sort as they do."""
    lengths = np.fromiter(map(len, streams), np.int64, len(streams))
    of, first = np.repeat(np.arange(len(streams)), lengths), np.cumsum(lengths) - lengths
    flat = np.concatenate([*streams, np.zeros(depth, np.uint16)]).astype(np.uint64)
    place = np.arange(len(of)) - first[of]
    at = np.flatnonzero(place + depth <= lengths[of])
    columns = []
    for start in range(0, depth, 4):
        column = np.zeros(len(at), np.uint64)
        for k in range(start, min(start + 4, depth)):
            column = column << np.uint64(16) | flat[at + k]
        columns.append(column)
    return of[at], place[at], columns


def head_keys(host: str, columns: list[np.ndarray]) -> np.ndarray:
    """64 bits of a host and the first tokens of each suffix."""
    key = np.full(len(columns[0]), hashes([host.encode()])[0])
    for column in columns:
        key = mixed(key ^ column) + np.uint64(1)
    return key


def frequent(pages: list[list[np.ndarray]], depth: int, least: float) -> list[np.ndarray]:
    """The heads on at least ``least`` of the pages, each once, from neighbours in the array of all their suffixes. A page is a list of streams."""
    number = np.repeat(np.arange(len(pages)), [len(streams) for streams in pages])
    of, _, columns = heads([stream for streams in pages for stream in streams], depth)
    if not len(of):
        return columns
    order = np.lexsort(columns[::-1])  # stable: equal ones stay in the order of pages
    page, columns = number[of][order], [column[order] for column in columns]
    begins = np.append(True, np.logical_or.reduce([column[1:] != column[:-1] for column in columns]))
    other = begins | np.append(True, page[1:] != page[:-1])
    start = np.flatnonzero(begins)
    start = start[np.add.reduceat(other.astype(np.int64), start) >= least]
    return [column[start] for column in columns]


def likely(pages: DataFrame, sizes: DataFrame, depth: int) -> DataFrame:
    """``key``, written: ``head_keys`` of all heads that may be boilerplate, from the arrays of parts of each host; ``sizes``, written, has ``host, pages``."""
    rows = pages.select("host", "content", F.coalesce("marked", F.lit("")).alias("own"), F.concat_ws(" ", "loose.text").alias("loose"))

    def marks(batches):
        for batch in batches:
            found = [pa.array([m.tobytes() for m in marks_of(own_stream(batch.column(k).to_pylist()))], pa.binary()) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], names=["host", "content", "own", "loose"])

    parts = small(sizes.filter(F.col("pages") > PART_PAGES)).select("host", F.ceil(F.col("pages") / PART_PAGES).alias("parts"))
    marked = in_batches(rows, marks, "host string, content long, own binary, loose binary").join(parts, "host", "left")
    dealt = marked.select("*", F.coalesce("parts", F.lit(1)).alias("of"), F.pmod("content", F.coalesce("parts", F.lit(1))).alias("part")).drop("parts")

    def work(batches):
        columns = ("host", "part", "of", "content", "own", "loose")
        dealt = (row for batch in batches for row in zip(*(batch.column(x).to_pylist() for x in columns), strict=True))
        for (host, _, of), pages in groupby(dealt, key=lambda row: row[:3]):
            whole, piece, size, last = of == 1, [], 0, None

            def taken():
                found = frequent(piece, depth, max(OF_HOST * len(piece), PAGES if whole else 0))
                return pa.RecordBatch.from_arrays([pa.array(head_keys(host, found).view(np.int64))], names=["key"])

            for *_, content, main, loose in pages:
                if content == last:
                    continue
                if size > PIECE_TOKENS:
                    whole = False
                    yield taken()
                    piece, size = [], 0
                piece.append([np.frombuffer(x, np.uint16) for x in (main, loose)])
                size, last = size + sum(map(len, piece[-1])), content
            yield taken()

    ordered = dealt.repartition("host", "part").sortWithinPartitions("host", "part", "content")
    return cut_lineage(in_batches(ordered, work, "key long").distinct())


def own_stream(texts: list[str]) -> list[str]:
    """Blocks of a text as one stream of tokens."""
    return [text.replace("\n\n", " ") for text in texts]


def suffixes(pages: DataFrame, depth: int, among: Bitmap) -> DataFrame:
    """The suffixes of a page's streams that ``among`` lets through, cut to ``depth`` tokens: ``host, page, content, own, at, head``; ``own`` tells that the stream is the page's text."""
    rows = pages.select("host", "page", "content", F.coalesce("marked", F.lit("")).alias("main"), F.concat_ws(" ", "loose.text").alias("loose"), F.col("marked").isNotNull().alias("has_main"))
    kind = T.StructType([*rows.schema.fields[:3], T.StructField("own", T.BooleanType()), T.StructField("at", T.IntegerType()), T.StructField("head", T.StringType())])

    def work(batches):
        for batch in batches:
            host, has_main = batch.column(0).to_pylist(), batch.column(5).to_pylist()
            for side, texts in ((False, own_stream(batch.column(3).to_pylist())), (True, batch.column(4).to_pylist())):
                of, at, columns = heads(marks_of(texts), depth)
                row, place, head = [], [], []
                bounds = np.searchsorted(of, np.arange(len(texts) + 1))
                for k, (begin, end) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    if begin < end:
                        hits = at[begin:end][among.has(head_keys(host[k], [column[begin:end] for column in columns]))].tolist()
                        if hits:
                            tokens = texts[k].split(" ")
                            row += [k] * len(hits)
                            place += hits
                            head += [" ".join(tokens[x : x + depth]) for x in hits]
                own = pa.array([has_main[k] != side for k in row], pa.bool_())
                yield pa.RecordBatch.from_arrays([*(column.take(pa.array(row, pa.int32())) for column in batch.columns[:3]), own, pa.array(place, pa.int32()), pa.array(head, pa.string())], names=kind.names)

    return in_batches(rows, work, kind)


def repeats(streams: DataFrame) -> DataFrame:
    """``host, head, on``: long repeated substrings with the number of different contents they stand in, from neighbours in the suffix array.

    ``streams`` has ``host, head, content`` of each suffix. They are sorted over all tasks; in its range a task compares every
    suffix with the one before. A run of equal ones is told if it is long enough, or first or last in the range, as it can go on in another; equal suffixes of one content
    are in one range.
    """
    order = ["host", "head", "content"]
    kind = T.StructType([*streams.select("host", "head").schema.fields, T.StructField("on", T.LongType())])

    def work(batches):
        last, on, started = None, 0, False
        for batch in batches:
            out = []
            for row in zip(*(batch.column(x).to_pylist() for x in order), strict=True):
                if last is not None and row[:2] == last[:2]:
                    on += row[2] != last[2]
                else:
                    if last is not None and (on >= PAGES or not started):
                        out.append((*last[:2], on))
                    started, on = last is not None, 1
                last = row
            yield _rows(out, kind)
        if last is not None:
            yield _rows([(*last[:2], on)], kind)

    ranges = streams.repartitionByRange(*order).sortWithinPartitions(*order)
    return in_batches(ranges, work, kind).groupBy("host", "head").agg(F.sum("on").alias("on"))


def _rows(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(kind)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if f.dataType == T.LongType() else pa.string()) for c, f in zip(columns, kind, strict=True)], names=kind.names)


def main_text(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``page_id, url, text`` of every page."""
    read = cut_lineage(parsed(pages).withColumn("content", F.xxhash64("marked", "loose")))
    sizes = cut_lineage(read.groupBy("host").agg(F.count_distinct("content").alias("pages")))
    met = cut_lineage(suffixes(read, depth, Bitmap.of(likely(read, sizes, depth))))
    counted = repeats(met.select("host", "head", "content")).filter(F.col("on") >= PAGES)
    shared = counted.join(small(sizes), "host").filter(F.col("on") >= OF_HOST * F.col("pages")).select("host", "head")
    covered = met.filter("own").select("host", "page", "at", "head").join(shared, ["host", "head"], "left_semi").groupBy("host", "page").agg(F.collect_set("at").alias("starts"))
    joined = read.join(covered, ["host", "page"], "left")
    schema = T.StructType([read.schema["page_id"], read.schema["url"], T.StructField("text", T.StringType())])

    def work(batches):
        for batch in batches:
            texts = []
            for marked, loose, starts in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                own = loose if marked is None else [{"text": text, "side": False} for text in marked.split("\n\n")] if marked else []
                texts.append(unique_runs(own, starts or [], depth) if marked is None or starts else marked)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=schema.names)

    own_blocks = F.when(F.col("marked").isNull(), F.col("loose")).alias("loose")  # of other pages they have been counted and are not text
    return in_batches(joined.select("page_id", "url", "marked", own_blocks, "starts"), work, schema)


def unique_runs(blocks: list[dict], starts: list[int], depth: int) -> str:
    """A page's blocks without markup's boilerplate and without covered tokens; all of the former if more than ``MOST`` of their tokens are covered."""
    gone = {at + k for at in starts for k in range(depth)}
    position, kept, whole, lost, total = 0, [], [], 0, 0
    for block in blocks:
        tokens = block["text"].split(" ")
        if not block["side"]:
            whole.append(block["text"])
            rest = [token for k, token in enumerate(tokens, position) if k not in gone]
            lost, total = lost + len(tokens) - len(rest), total + len(tokens)
            if rest:
                kept.append(" ".join(rest))
        position += len(tokens)
    return "\n\n".join(whole if lost > MOST * total else kept)
