"""Main text of web pages by differencing against the page with the nearest URL.

Every page becomes text lines.  Pages are ordered by host and URL path; pages of one host with the same lines are
one kind, and each kind is paired with the neighbour of another kind whose path shares the longest beginning.  The lines of a pair are aligned by longest common subsequence,
and lines that both pages have are deleted.  Two rules of markup stand beside that, because menus and adverts
may differ from page to page and one article may stand on several pages: lines in elements marked as something
else (navigation, advert, comments, ...) are deleted even when no other page has them, and lines inside the
article element are never deleted for being shared.

Only hashes of lines are shuffled; the pages themselves are read twice and stay where they are unless lines
have to be deleted on more pages than fit a broadcast.
"""

from __future__ import annotations

import html
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.common import partitions, prepare, text_of
from flowlens.session import materialize

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!(?:noscript|template|iframe|textarea|select|title)\b[^>]*/>)"
    r"(script|style|noscript|template|iframe|textarea|select|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-z][^<>]*\Z",
    re.S | re.I,
)
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike"
    " strong sub sup time tt u var wbr"
    # formulas stand in their line
    " math annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts"
    " mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
# Left out without a break of the line when they are self-closed.
_EMPTY = frozenset("svg noscript template iframe textarea select title".split())
# Start tags that end an svg which was not closed, as in browsers, and elements of it that may hold them.
_ENDS_SVG = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta"
    " nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
_HOLDS_HTML = frozenset("foreignobject desc title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that end with the next of their kind when they are not closed; they never enclose others here.
_LEAF = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())
_MAIN = frozenset(("article", "main"))
_OTHER = frozenset("nav footer aside form dialog menu head button".split())
# Words of class, id and role that mark an element as something other than the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement alert banner breadcrumb breadcrumbs comment comments consent cookie"
    " cookies copyright disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices"
    " notification pager pagination popup promo promotion related replies search share sharing sidebar signup social"
    " sponsor sponsored subscribe toc toolbar widget complementary contentinfo".split()
)
_MARKS_OUTSIDE = frozenset("header top topbar".split())
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[a-z0-9]+")


def _marked(tag: str, attributes: str, inside: bool) -> bool:
    if tag in _OTHER or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    words = {w for _, v in _ATTRIBUTE.findall(attributes) for w in _WORD.findall(v.lower())}
    if words & _MARKS and not (tag in _MAIN and not inside) or (not inside and words & _MARKS_OUTSIDE):
        return True
    return bool(_HIDDEN.search(attributes))


def page_lines(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside the article, in a marked element) of every text line, in page order."""
    lines: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, marked, article
    held: list[str] = []
    marked = inside = False
    leaf_marked = False
    svg: list[str] = []  # open elements of an svg, which is left out up to its end or that of its parent

    def flush() -> None:
        if held:
            text = html.unescape("".join(held)) if any("&" in h for h in held) else "".join(held)
            text = " ".join(text.split())
            if text:
                lines.append((text, inside, marked or leaf_marked))
            held.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not svg:
            held.append(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        closed = not m[2] and m[4].rstrip().endswith("/")
        if svg:
            if m[2]:
                if tag in svg:
                    while svg.pop() != tag:
                        pass
                    continue
                if tag not in _LEAF and tag not in _INLINE and not any(x[0] == tag for x in stack):
                    continue
            elif tag not in _ENDS_SVG or not _HOLDS_HTML.isdisjoint(svg):
                if not closed and tag not in _VOID:
                    svg.append(tag)
                continue
            svg.clear()
        if tag == "svg" or closed and tag in _EMPTY:
            if tag == "svg" and not closed and not m[2]:
                svg.append(tag)
            continue
        if tag in _INLINE:
            continue
        if tag == "br":
            held.append(" ")
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in _LEAF:
            leaf_marked = not m[2] and bool(m[4]) and _marked(tag, m[4], inside)
            continue
        leaf_marked = False
        if not m[2]:
            if tag == "body":
                stack = [x for x in stack if x[0] != "head"]
            if not closed:
                stack.append((tag, _marked(tag, m[4], inside), tag in _MAIN))
        elif any(x[0] == tag for x in stack):
            while stack.pop()[0] != tag:
                pass
        marked = any(x[1] for x in stack)
        inside = any(x[2] for x in stack)
    if at < len(page) and not svg:
        held.append(page[at:])
    flush()
    return lines


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Rows of the dynamic program are bit vectors over ``b``; equal ends and lines only one side has are taken
    off first, and large inputs are halved (Hirschberg) so that the vectors kept stay bounded.
    """
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < len(a) - head and tail < len(b) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mine, other = set(a[head : len(a) - tail]), set(b[head : len(b) - tail])
    left = [i for i in range(head, len(a) - tail) if a[i] in other]
    right = [x for x in b[head : len(b) - tail] if x in mine]
    middle = _lcs([a[i] for i in left], right)
    return [*range(head), *(left[k] for k in middle), *range(len(a) - tail, len(a))]


_MOST_BITS = 1 << 28


def _rows(a: list[int], b: list[int], keep: bool) -> list[int]:
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & masks.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        if keep:
            rows.append(row)
    return rows if keep else [row]


def _prefix_lengths(row: int, n: int) -> list[int]:
    out, k = [0], 0
    for bit in format(row, f"0{n}b")[::-1] if n else "":
        k += bit == "0"
        out.append(k)
    return out


def _lcs(a: list[int], b: list[int]) -> list[int]:
    if not a or not b:
        return []
    if len(a) * len(b) > _MOST_BITS and len(a) > 1:
        half = len(a) // 2
        ahead = _prefix_lengths(_rows(a[:half], b, False)[0], len(b))
        behind = _prefix_lengths(_rows(a[half:][::-1], b[::-1], False)[0], len(b))
        cut = max(range(len(b) + 1), key=lambda j: ahead[j] + behind[len(b) - j])
        return _lcs(a[:half], b[:cut]) + [half + i for i in _lcs(a[half:], b[cut:])]
    rows = _rows(a, b, True)
    found, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            found.append(i)
    return found[::-1]


def _hash(line: str) -> int:
    return int.from_bytes(blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _scan(batches):
    for batch in batches:
        pages = [page_lines(p) for p in batch.column("html").to_pylist()]
        hashes = [[_hash(x[0]) for x in lines] for lines in pages]
        # Lines whose fate depends on the neighbour: neither marked nor inside an article.
        free = [[k for k, x in enumerate(lines) if not (x[1] or x[2])] for lines in pages]
        yield pa.RecordBatch.from_arrays(
            [batch.column(n) for n in ("page_id", "key", "host", "path")]
            + [pa.array(hashes, pa.list_(pa.int64())), pa.array(free, pa.list_(pa.int32()))],
            names=["page_id", "key", "host", "path", "lines", "free"],
        )


def _shared_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _choose(batches):
    for batch in batches:
        rows = batch.to_pylist()
        picked = []
        for r in rows:
            # The neighbour before wins a tie.
            around = [
                (_shared_prefix(x["path"], r["path"]), first, x)
                for first, x in ((1, r["before"]), (0, r["after"]))
                if x and x["host"] == r["host"] and x["kind"] != r["kind"]
            ]
            picked.append(max(around, key=lambda x: x[:2]) if around else (None, None, None))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("host"), batch.column("kind"),
                pa.array([p[0] for p in picked], pa.int32()),
                pa.array([p[1] for p in picked], pa.int32()),
                pa.array([p[2] and p[2]["kind"] for p in picked], pa.int64()),
            ],
            names=["host", "kind", "shared", "first", "near"],
        )


def nearest(pages: DataFrame) -> DataFrame:
    """(host, kind, near) over (host, path, page_id, key, kind): the nearest pages of another kind on the host.

    Pages of one kind have the same lines.  The nearest page of another kind stands beside a page of the kind in
    the order of URLs, as what lies between two pages shares at least as much of their paths.
    The order is global and cut into ranges of even size; what stands before and after a range comes from the
    ends of the others (one row for each range).  A host may span any number of ranges.
    """
    spark = pages.sparkSession
    order = ["host", "path", "page_id", "key", "kind"]
    ranged = pages.select(order).distinct().repartitionByRange(partitions(spark), *order)
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "urls")
    me = F.struct(*order)
    edges = ranged.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    along = Window.orderBy("part")  # one row for each range
    edges = edges.select(
        "part", F.lag("last").over(along).alias("last_before"), F.lead("first").over(along).alias("first_after")
    )
    inside = Window.partitionBy("part").orderBy(*order)
    rows = ranged.withColumn("before", F.lag(me).over(inside)).withColumn("after", F.lead(me).over(inside))
    rows = rows.join(F.broadcast(edges), "part").select(
        *order,
        F.coalesce("before", "last_before").alias("before"),
        F.coalesce("after", "first_after").alias("after"),
    )
    beside = rows.mapInArrow(_choose, "host string, kind long, shared int, first int, near long").where("near is not null")
    best = F.max(F.struct("shared", "first", "near")).alias("best")
    return beside.groupBy("host", "kind").agg(best).select("host", "kind", F.col("best.near").alias("near"))


def _align(batches):
    for batch in batches:
        shared = [
            common_lines(mine, other)
            for mine, other in zip(*(batch.column(n).to_pylist() for n in ("lines", "near_lines")), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("kind"), pa.array(shared, pa.list_(pa.int32()))],
            names=["host", "kind", "shared"],
        )


def _extract(batches):
    for batch in batches:
        texts = []
        for page, cut in zip(batch.column("html").to_pylist(), batch.column("cut").to_pylist(), strict=True):
            gone = set(cut or ())
            kept = [x for k, (x, _, marked) in enumerate(page_lines(page)) if not marked and k not in gone]
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    A null page is empty and gives the empty text.  URLs that are null or have no host belong to one host of
    their own.  Repeated rows give repeated results.  Columns besides page_id, url and html are ignored.
    """
    spark = prepare(pages.sparkSession)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url"),
        text_of("html").alias("html"),
        F.xxhash64("url", "html").alias("key"),
        F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)).alias("host"),
        F.regexp_extract(url, "^[^:/?#]+://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    lines = materialize(
        rows.select("page_id", "key", "host", "path", "html").mapInArrow(
            _scan, "page_id long, key long, host string, path string, lines array<long>, free array<int>"
        ).withColumn("kind", F.xxhash64("lines")),
        "lines",
    )
    pairs = materialize(nearest(lines), "pairs")
    kinds = lines.groupBy("host", "kind").agg(F.first("lines").alias("lines"), F.max(F.size("free")).alias("most"))
    mine = kinds.where("most > 0").drop("most")
    near = kinds.select("host", F.col("kind").alias("near"), F.col("lines").alias("near_lines"))
    aligned = pairs.join(mine, ["host", "kind"]).join(near, ["host", "near"]).select("host", "kind", "lines", "near_lines")
    shared = aligned.mapInArrow(_align, "host string, kind long, shared array<int>").where(F.size("shared") > 0)
    # One row for each kind; pages of a kind may differ in what stands in an article.
    free = lines.where(F.size("free") > 0).select("host", "kind", "page_id", "key", "free").dropDuplicates(["page_id", "key"])
    cuts = free.join(materialize(shared, "shared"), ["host", "kind"]).select(
        "page_id", "key", F.array_intersect("free", "shared").alias("cut")
    ).where(F.size("cut") > 0)
    # Written first, so that the size is known when the join is planned.
    cuts = materialize(cuts, "cuts").select(F.col("page_id").alias("cut_id"), F.col("key").alias("cut_key"), "cut")
    same = F.col("page_id").eqNullSafe(F.col("cut_id")) & (F.col("key") == F.col("cut_key"))
    joined = rows.select("page_id", "key", "url", "html").join(cuts, same, "left")
    text = joined.select("page_id", "url", "html", "cut").mapInArrow(_extract, "page_id long, url string, text string")
    return text.withColumn("n_chars", F.length("text").cast("long"))
