"""Main text of web pages, by differencing each page with its nearest one of the same host."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from batchloom.llm.batches import pieces_of
from batchloom.llm.scratch import Scratch
from batchloom.llm.skew import attach, row_numbers
from batchloom.llm.url_filter import host_of, path_of

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^<>]*)>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")

#: Elements whose content is never text of the page; of the first, all up to the end of the page where none is closed.
_RAW = frozenset("script style noscript textarea title iframe".split())
_NO_TEXT = _RAW | frozenset("template object svg math canvas".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset("article main".split())
_FURNITURE = frozenset("head nav header footer aside form menu dialog button select fieldset noscript".split())
_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
#: Open elements that a start tag ends; any block ends a paragraph.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
         "thead": ("tr", "td", "th", "caption"), "tbody": ("tr", "td", "th", "thead", "tbody", "caption"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
#: Names of a class, id or role that mark furniture; such as are also names for other things count with a word of _PLACES only.
_MARKS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar comment comments
disqus replies cookie cookies consent gdpr notice notices nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead contentinfo
complementary newsletter signup login popup modal toolbar pagination pager""".split())
_DOUBTFUL = frozenset("alert overlay related search share sharing social subscribe subscription widget".split())
_PLACES = frozenset("area bar block box button buttons container form icons item items links list menu modal panel posts section slot thread top bottom unit widget wrap wrapper".split())
_HEADS = frozenset("header site-header page-header".split())
#: Share of the characters of two pages in lines they share from which they are copies.
COPY = 0.9


def _mark(name: str) -> bool:
    """Whether one name of a class, id or role is of furniture: a mark, or a mark with words for places."""
    words = [w for w in re.split(r"[-_]+", name) if w]
    marks = [w for w in words if w in _MARKS]
    doubtful = [w for w in words if w in _DOUBTFUL]
    return name in _HEADS or (bool(marks) or len(words) > 1 and bool(doubtful)) and all(w in _MARKS or w in _DOUBTFUL or w in _PLACES or w.isdigit() for w in words)


def _marked(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and value in ("", "hidden", "true") or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ("search", "alert") or name in ("class", "id", "role") and any(map(_mark, value.split())):
            return True
    return False


def lines(html: str | None) -> list[tuple[str, str]]:
    """Text blocks of a page in order, each with where it stands: ``main``, ``furniture`` or ``open``.

    Furniture is what stands in menus, headers, footers, sidebars, forms and
    the like, by element or by class, id and role; what stands in an article
    or main element and in no furniture within it is main. Furniture within a
    block that is none is left out of it.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    open_: Counter = Counter()
    blocks: list[int] = []  # places of blocks in the stack
    unclosed: set[str] = set()
    state, pieces, html = "open", [], html or ""

    def flush() -> None:
        kept = [(t, s) for t, s in pieces if s != "furniture"] if any(s != "furniture" and t.strip() for t, s in pieces) else pieces
        text = _SPACE.sub(" ", entities.unescape("".join(t for t, _ in kept))).strip()
        if text:
            out.append((text, next(s for t, s in kept if t.strip())))
        pieces.clear()

    def close(to: int) -> str:
        before = stack[to][1]
        for name, _ in stack[to:]:
            open_[name] -= 1
        del stack[to:]
        while blocks and blocks[-1] >= to:
            blocks.pop()
        return before

    at = 0
    while True:
        m = _TAG.search(html, at)
        if m is None:
            pieces.append((html[at:], state))
            break
        if m.start() > at:
            pieces.append((html[at : m.start()], state))
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in _BLOCK:
                flush()
            if open_[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                state = close(k)
            continue
        attributes = m[3] if m[2] else m[6]
        if name in _NO_TEXT and not attributes.endswith("/"):
            end = None if name in unclosed else re.compile(rf"</{name}(?:\s[^>]*)?>?", re.I).search(html, at)
            if end is None:
                unclosed.add(name)
            at = end.end() if end else len(html) if name in _RAW else at
            pieces.append((" ", state))
            continue
        if name == "br":
            pieces.append((" ", state))
        if name in _BLOCK:
            flush()
            while blocks and (stack[blocks[-1]][0] == "p" or stack[blocks[-1]][0] in _ENDS.get(name, ())):
                state = close(blocks[-1])
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _BLOCK:
            blocks.append(len(stack))
        stack.append((name, state))
        open_[name] += 1
        if name in _MAIN:
            if not (attributes and _marked(attributes)):
                state = "main"
        elif name in _FURNITURE or attributes and _marked(attributes):
            state = "furniture"
    flush()
    return out


def shared(own: list[int], other: list[int]) -> list[int]:
    """Places of ``own`` in a longest common subsequence with ``other``."""
    first, end = 0, 0
    while first < min(len(own), len(other)) and own[first] == other[first]:
        first += 1
    while end < min(len(own), len(other)) - first and own[-1 - end] == other[-1 - end]:
        end += 1
    places: dict[int, list[int]] = {}
    for j in range(len(other) - end - 1, first - 1, -1):
        places.setdefault(other[j], []).append(j)
    # Longest strictly rising run of matching places, by patience; matches of one line fall, so it is used once.
    tails: list[int] = []
    nodes: list[tuple[int, object]] = []
    for i in range(first, len(own) - end):
        for j in places.get(own[i], ()):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    middle, node = [], nodes[-1] if nodes else None
    while node is not None:
        middle.append(node[0])
        node = node[1]
    return [*range(first), *reversed(middle), *range(len(own) - end, len(own))]


def _hashes(found: list[tuple[str, str]]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63 for text, _ in found]


def _outline(batches):
    for batch in pieces_of(batches, "html"):
        digests, hashes, opened, sizes = [], [], [], []
        for f in map(lines, batch.column("html").to_pylist()):
            has_main = any(s == "main" for _, s in f)
            hashes.append(_hashes(f))
            opened.append([] if has_main else [i for i, (_, s) in enumerate(f) if s == "open"])
            sizes.append([0 if s == "furniture" else len(t) for t, s in f])
            digests.append(xxhash.xxh3_128_hexdigest(repr((hashes[-1], opened[-1], sizes[-1])).encode()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "host", "path")), pa.array(digests, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(opened, pa.list_(pa.int32())), pa.array(sizes, pa.list_(pa.int32()))],
                                         names=["row", "host", "path", "digest", "hashes", "open", "sizes"])


def copies(one: dict, other: dict) -> bool:
    """Whether lines that two pages share in order hold COPY of the characters of both, furniture not counted."""
    whole = sum(one["sizes"]) + sum(other["sizes"])
    if one["hashes"] == other["hashes"] or not whole:
        return True
    common = set(one["hashes"]) & set(other["hashes"])
    if 2 * sum(n for h, n in zip(one["hashes"], one["sizes"]) if h in common) < COPY * whole:
        return False
    return 2 * sum(one["sizes"][k] for k in shared(one["hashes"], other["hashes"])) >= COPY * whole


def _gone(page: dict, other: dict | None) -> list[int]:
    """Open lines of a page that the other one, if it is no copy, has too."""
    if other is None or not page["open"] or copies(page, other):
        return []
    same = set(shared(page["hashes"], other["hashes"]))
    return [k for k in page["open"] if k in same]


def nearer(path: str, before: dict | None, after: dict | None) -> dict | None:
    """Of two pages the one whose path begins with more of a path's segments; the first where both do alike."""
    if before is None or after is None:
        return before or after
    own = path.split("/")

    def alike(page: dict) -> int:
        return next((k for k, (x, y) in enumerate(zip(own, page["path"].split("/"))) if x != y), min(len(own), page["path"].count("/") + 1))

    return after if alike(after) > alike(before) else before


_PAGE = pa.struct([("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("open", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32()))])
_EDGE = pa.struct([("host", pa.string()), ("last", pa.bool_()), ("leader", _PAGE), ("prev", _PAGE), ("next", _PAGE)])
_NEAR = pa.schema([("host", pa.string()), ("digest", pa.string()), ("rows", pa.int64()), ("p", pa.int32()), ("r", pa.int64()), ("gone", pa.list_(pa.int32())), ("page", _PAGE), ("edge", _EDGE)])
_PAGE_SQL = "struct<path: string, hashes: array<long>, open: array<int>, sizes: array<int>>"
_NEAR_SQL = f"host string, digest string, rows long, p int, r long, gone array<int>, page {_PAGE_SQL}, edge struct<host: string, last: boolean, leader: {_PAGE_SQL}, prev: {_PAGE_SQL}, next: {_PAGE_SQL}>"


def _neighbours(batches):
    """The lines each page loses to the nearer of the runs of copies before and after its own on its host.

    A run is a page, its leader, and the pages right after it that are copies of
    it; runs are compared by their leaders. The pages of a run wait, at most as
    many as the partition has, until the next one is seen. Pages of the first
    and the last run of a partition come with their outline instead, and these
    runs as ``edge``.
    """
    p, r, run, waiting = TaskContext.get().partitionId(), -1, None, []

    def told(here, known, prev=None, next_=None):
        return {"host": here["host"], "digest": here["digest"], "rows": here["rows"], "p": p, "r": r, "gone": _gone(here, nearer(here["path"], prev, next_)) if known else None, "page": None if known else here}

    def edge(next_, last):
        return {"p": p, "r": r, "edge": {"host": run["leader"]["host"], "last": last, "leader": run["leader"], "prev": run["prev"], "next": next_}}

    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
        out = []
        for here in batch.to_pylist():
            if run is None or here["host"] != run["leader"]["host"] or not copies(here, run["leader"]):
                same_host = run is not None and here["host"] == run["leader"]["host"]
                out += [told(w, True, run["prev"], here if same_host else None) for w in waiting]
                if r == 0:
                    out.append(edge(here if same_host else None, False))
                waiting, run, r = [], {"leader": here, "prev": run["leader"] if same_host else None}, r + 1
            if r == 0:
                out.append(told(here, False))
            else:
                waiting.append(here)
        yield pa.RecordBatch.from_pylist(out, _NEAR)
    if run is not None:
        yield pa.RecordBatch.from_pylist([*(told(w, False) for w in waiting), edge(None, True)], _NEAR)


def _across(side: str):
    """For the first and last runs of all partitions the page ``before`` or ``after`` that theirs are compared with.

    They come in order, or for ``after`` in reverse, so no more than the run
    before has to be kept in mind.
    """

    def run(batches):
        host = leader = found = None
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            out = []
            for e in batch.to_pylist():
                edge = e["edge"]
                near, outermost = (edge["prev"], e["r"] == 0) if side == "before" else (edge["next"], edge["last"])
                if near is None and outermost and host == edge["host"] and leader is not None:
                    near = found if copies(edge["leader"], leader) else leader
                host, leader, found = edge["host"], edge["leader"], near
                out.append({"p": e["p"], "r": e["r"], side: near})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("p", pa.int32()), ("r", pa.int64()), (side, _PAGE)]))

    return run


def _deleted(batches):
    for batch in batches:
        gone = [_gone(page, nearer(page["path"], *both)) for page, *both in zip(*(batch.column(c).to_pylist() for c in ("page", "before", "after")))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "digest", "rows")), pa.array(gone, pa.list_(pa.int32()))], names=["host", "digest", "rows", "gone"])


def _texts(batches):
    for batch in pieces_of(batches, "html"):
        out = []
        for html, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
            found = lines(html)
            has_main = any(s == "main" for _, s in found)
            gone = set(gone or ())
            out.append("\n".join(t for k, (t, s) in enumerate(found) if s == "main" or s == "open" and not has_main and k not in gone))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """``page_id, url, text`` per row of stored ``pages``.

    A page's text blocks are its lines. Pages are sorted by host and path;
    copies of one page on a host, whose lines are all the same, count as one,
    and copies that follow each other and differ in less than a tenth of their
    characters form a run. Each page is aligned, by a longest common subsequence
    of its lines, with the first page of the run before or after its own on its
    host, whichever has more segments of its path. Shared lines are deleted,
    except those of an article or main element, so that articles with copies
    stay whole; lines in furniture elements (menus, headers, footers, sidebars,
    notices, adverts, forms, comments) are deleted whether shared or not; and
    where a page has an article or main element, so is all outside it. A page
    whose host has nothing but copies of it loses no line by alignment.
    Character references are decoded, white space within a line is one space,
    lines are joined by a newline.

    The sort spreads one host over many tasks; only hashes of lines are
    shuffled, and runs at the borders of the sort's parts, two for each part,
    meet in a small table. Null html gives an empty text. Pages whose url is
    null or has no ``://`` form a host of their own. Repeated rows each get
    their row; other columns are not read. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "pages")
    source = row_numbers(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), "row")
    placed = source.select("row", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    outline = scratch.keep(placed.mapInArrow(_outline, "row long, host string, path string, digest string, hashes array<long>, open array<int>, sizes array<int>"), "outline")
    first = outline.groupBy("host", "digest").agg(F.min(F.struct("path", "row", "hashes", "open", "sizes")).alias("first"), F.count("*").alias("rows"))
    distinct = scratch.keep(first.select("host", "digest", "rows", "first.*"), "distinct")
    ordered = distinct.repartitionByRange("host", "path", "row").sortWithinPartitions("host", "path", "row")
    near = scratch.keep(ordered.select("host", "path", "digest", "rows", "hashes", "open", "sizes").mapInArrow(_neighbours, _NEAR_SQL), "near")
    edges = scratch.keep(near.filter("edge is not null").select("p", "r", "edge"), "edges").repartition(1)
    told = {side: edges.sortWithinPartitions(*order).mapInArrow(_across(side), f"p int, r long, {side} {_PAGE_SQL}") for side, order in (("before", ("p", "r")), ("after", (F.desc("p"), F.desc("r"))))}
    across = scratch.keep(told["before"].join(told["after"].hint("merge"), ["p", "r"]), "across")
    schema = "host string, digest string, rows long, gone array<int>"
    open_ = near.filter("page is not null").join(across.hint("merge"), ["p", "r"]).select("host", "digest", "rows", "page", "before", "after").mapInArrow(_deleted, schema)
    found = near.filter("gone is not null").select("host", "digest", "rows", "gone").unionByName(open_).filter(F.size("gone") > 0)
    lost = attach(outline.filter(F.size("open") > 0).select("row", "host", "digest"), scratch.keep(found, "gone"), ["host", "digest"], "rows", F.col("row"))
    gone = scratch.keep(lost.select("row", "gone"), "lost")
    return source.join(gone, "row", "left").select("page_id", "url", "html", "gone").mapInArrow(_texts, _schema(pages, page_id, url))


def _schema(pages: DataFrame, page_id: str, url: str) -> str:
    return f"page_id {pages.schema[page_id].dataType.simpleString()}, url {pages.schema[url].dataType.simpleString()}, text string"


def op8(spark, sf_dir: str) -> DataFrame:
    found = main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
