"""HTML extraction by nearest-URL page differencing.

Every page becomes blocks of text in page order. Markup that is never article text (menus, headers, footers, asides,
forms, scripts, styles, and elements whose class or id names an advert, a notice, a comment list and the like) gives none.
Then pages of a host are put in the order of their URL paths and each page is paired with its neighbours on either side;
the blocks of a pair are aligned by a longest common subsequence, and aligned blocks are shared. Shared blocks are deleted,
and no others. An ``article`` or ``main`` element is a hint: since articles do repeat passages of one another, a shared block
inside one is deleted only if MANY pages and SHARE of the pages of its host share it with a neighbour, and neighbours that
share more than half of the blocks inside (near copies) are not held against each other there. Two neighbours of which one
has nothing of its own (copies of one page) are not held against each other at all.

The order is that of all pages, whatever the size of a host: hashes of the blocks are dealt by ranges of host, path and id
of BLOCK pages or more, and the first and last pages of a range are handed to the ranges beside it. Equal pages in a row are
one run, so a copy's neighbours are the nearest pages that differ from it. Pages that lose blocks are broadcast up to
BROADCAST_ROWS of them and joined by shuffling beyond; the texts themselves are read again and move only for that join.

Defined cases: null or empty html gives empty text; a null url has an empty host and path; pages with equal urls are
neighbours in the order of their ids; markup that ends early is read as far as it goes; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import drop_persisted, persist, table
from tallyforge.llm.urlrules import host_of, path_of

BLOCK = 128
BROADCAST_ROWS = 100_000
MANY = 5
SHARE = 0.25

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|(?=<)|\Z)", re.S)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that hold no article text.
DROPPED = frozenset("script style noscript template svg iframe object nav footer aside form button select textarea dialog head".split())
#: Of these the text is no markup.
RAW = frozenset("script style textarea".split())
#: Elements that do not end a head.
HEAD = frozenset("head title meta link base script style noscript template".split())
#: A class, an id or a role that names something other than the article.
OTHERS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promoted related reply replies respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget site-header site-footer site-nav main-nav main-menu nav-menu comment-list comments-list comments-area comment-section cookie-banner cookie-notice ad-banner ad-container ad-slot share-buttons social-share social-links related-posts related-articles newsletter-signup".split())
#: What ends an element without article text that is never closed.
BEGINS = frozenset("body article main section h1 h2 h3 h4 h5 h6 p".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())

#: Elements that end where one of others starts, unless one of the last is nearer.
IMPLIED = (
    (("p",), BLOCKS - {"br"}, BLOCKS - {"p"}),
    (("li",), frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    (("dt", "dd"), frozenset(["dt", "dd"]), frozenset(["dl"])),
    (("td", "th"), frozenset(["td", "th", "tr"]), frozenset(["table"])),
    (("tr",), frozenset(["tr"]), frozenset(["table"])),
    (("option",), frozenset(["option"]), frozenset(["select"])),
)


def events_of(page: str) -> tuple[list[tuple[str, bool, str, str]], set[int]]:
    """Of each tag of a page the text before it, whether it closes, its name and attributes; and which opening ones never close."""
    out: list[tuple[str, bool, str, str]] = []
    waiting: dict[str, list[int]] = {}
    at, raw = 0, ""
    for m in TOKEN.finditer(page):
        close, name = bool(m[1]), (m[2] or "").lower()
        text = "" if raw else page[at : m.start()]
        at = m.end()
        if raw and not (close and name == raw):
            continue
        raw = name if name in RAW and not close else ""
        if name and name not in VOID:
            if not close:
                waiting.setdefault(name, []).append(len(out))
            elif waiting.get(name):
                waiting[name].pop()
        out.append((text, close, name, m[3] or ""))
    out.append(("" if raw else page[at:], True, "", ""))
    return out, {i for found in waiting.values() for i in found}


def blocks_of(page: str) -> list[tuple[str, bool]]:
    """The blocks of a page that can be article text, and whether each stands in an article or main element.

    Elements are kept on a stack: a p, li, td and the like ends where HTML implies it, a head at the first thing that cannot
    stand in it, and an element without article text that is never closed at the next thing of BEGINS.
    """
    events, never = events_of(page)
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, whether it has no article text, whether that is so and it never closes
    inside = dropped = 0

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            out.append((text, inside > 0))
        held.clear()

    def cut(k: int, upto: int | None = None) -> None:
        """Take the elements from k on off the stack, or those from k up to upto."""
        nonlocal inside, dropped
        for name, drop, _ in stack[k:upto]:
            dropped -= drop
            inside -= name in ("article", "main")
        del stack[k:upto]

    def nearest(names: tuple[str, ...], stops) -> int:
        """Place of the innermost open element of these names, -1 if there is none or one of stops is nearer."""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in stops:
                return -1
        return -1

    for i, (text, close, name, attributes) in enumerate(events):
        if text:
            if stack and stack[-1][0] == "head" and text.strip():
                cut(len(stack) - 1)
            if not dropped:
                held.append(text)
        if not name:
            continue
        block = name in BLOCKS
        if close:
            if block:
                flush()
            k = nearest((name,), ())
            if k >= 0:
                crossed = not block and name not in DROPPED and any(n in BLOCKS for n, _, _ in stack[k + 1 :])
                cut(k, k + 1 if crossed else None)
            continue
        if block:
            flush()
        if name in VOID:
            continue
        if name not in HEAD and (k := nearest(("head",), ())) >= 0:
            cut(k)
        for names, starts, stops in IMPLIED:
            if name in starts and (k := nearest(names, stops)) >= 0:
                cut(k)
        if name in BEGINS and (k := next((k for k, e in enumerate(stack) if e[2]), -1)) >= 0:
            cut(k)
        named = {w for found in NAMES.findall(attributes) for w in "".join(found).lower().split() if not (inside and w == "header")} if attributes.strip() else ()
        drop = name in DROPPED or (name == "header" and not inside) or (bool(named) and not OTHERS.isdisjoint(named) and name not in ("html", "body", "main"))
        if drop:
            flush()
        stack.append((name, drop, drop and i in never))
        dropped += drop
        inside += name in ("article", "main")
    flush()
    return out


def common(a: list, b: list) -> set[int]:
    """Places in a of one longest common subsequence of a and b, by bit rows."""
    both = set(a) & set(b)
    x, y = [i for i, s in enumerate(a) if s in both], [s for s in b if s in both]
    where: dict = {}
    for j, s in enumerate(y):
        where[s] = where.get(s, 0) | 1 << j
    full = (1 << len(y)) - 1
    row, rows = full, [full]
    for i in x:
        u = row & where[a[i]]
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    found, j = set(), len(y)
    for k in range(len(x), 0, -1):
        # The length up to (k, j) is the number of zeros in the first j bits of row k.
        mask = (1 << j) - 1
        while j and (~rows[k] & mask).bit_count() == (~rows[k] & (mask >> 1)).bit_count():
            j, mask = j - 1, mask >> 1
        if not j:
            break
        if (~rows[k] & mask).bit_count() > (~rows[k - 1] & mask).bit_count():
            found.add(x[k - 1])
            j -= 1
    return found


def shared(own: list, other: list) -> set[int]:
    """Blocks of own that are aligned with blocks of other; none if one of the two is a copy of part of the other."""
    found = common(own, other)
    return set() if len(found) in (len(own), len(other)) and len(found) > 1 else found


def borders(edges: list) -> tuple[dict, dict]:
    """For each range the nearest run before its first and after its last that differs, from the first and last two runs of all."""
    found: list[dict] = [{}, {}]
    by_range: dict[int, list] = {}
    for e in sorted(edges, key=lambda e: (e["pid"], e["run"])):
        by_range.setdefault(e["pid"], []).append((e["host"], list(e["lines"])))
    for out, step in zip(found, (1, -1), strict=True):
        trail: list = []
        for pid in sorted(by_range, reverse=step < 0):
            runs = by_range[pid][::step]
            near = next((x for x in reversed(trail) if x != runs[0]), None)
            out[pid] = near[1] if near and near[0] == runs[0][0] else None
            for x in runs:
                if not trail or trail[-1] != x:
                    trail = [*trail[-1:], x]
    return found[0], found[1]


def lost(lines: list[int], inside: list[bool], neighbours: list[list[int]]) -> list[int]:
    """Places of the blocks that neighbours share; blocks inside only of neighbours that share at most half of those."""
    gone: set[int] = set()
    for found in (shared(lines, n) for n in neighbours):
        near_copy = 2 * sum(inside[i] for i in found) > sum(inside)
        gone.update(i for i in found if not (inside[i] and near_copy))
    return sorted(gone)


def doomed(aligned: DataFrame, runs: DataFrame) -> DataFrame:
    """Of the shared blocks those outside, and of those inside the ones that many pages of their host share."""
    pages = runs.groupBy("host").agg(F.count("*").alias("pages"))
    sharing = aligned.where("inside").groupBy("host", "line").agg(F.count_distinct("key").alias("n"))
    often = sharing.where(F.col("n") >= MANY).join(pages, "host").where(F.col("n") >= SHARE * F.col("pages")).select("host", "line")
    return aligned.where("NOT inside").unionByName(aligned.where("inside").join(small(often), ["host", "line"], "left_semi").select(aligned.columns))


def article(blocks: list[tuple[str, bool]], gone: set[int]) -> str:
    return "\n".join(b for k, (b, _) in enumerate(blocks) if k not in gone)


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(x) if x else [] for x in batch.column(4).to_pylist()]
            lines = [[int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t, _ in f] for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lines, pa.list_(pa.int64())), pa.array([[i for _, i in f] for f in found], pa.list_(pa.bool_()))], names=["page_id", "key", "host", "path", "lines", "inside"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a range follow each other; equal pages in a row are a run."""
        now, run = None, -1
        for batch in batches:
            runs, first = [], []
            for at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                first.append(at != now)
                run += at != now
                now = at
                runs.append(run)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64()), pa.array(first, pa.bool_())], names=[*batch.schema.names, "run", "first"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run is done when its follower is known; all its pages lose the same blocks."""
        before, now, keys = None, None, []

        def done(after) -> list[dict]:
            low = (before["lines"] if before["host"] == now["host"] else None) if before and before["pid"] == now["pid"] else lower[now["pid"]]
            high = (after["lines"] if after["host"] == now["host"] else None) if after and after["pid"] == now["pid"] else upper[now["pid"]]
            blocks = lost(now["lines"], now["inside"], [x for x in (low, high) if x is not None])
            return [{**k, "host": now["host"], "at": i, "line": now["lines"][i], "inside": now["inside"][i]} for k in keys for i in blocks]

        schema = None
        for batch in batches:
            schema = pa.schema([batch.schema.field("page_id"), ("key", pa.int64()), ("host", pa.string()), ("at", pa.int32()), ("line", pa.int64()), ("inside", pa.bool_())])
            out = []
            for row in batch.to_pylist():
                if now and (row["pid"], row["run"]) != (now["pid"], now["run"]):
                    out += done(row)
                    before, now, keys = now, None, []
                now = now or row
                keys.append({"page_id": row["page_id"], "key": row["key"]})
            yield pa.RecordBatch.from_pylist(out, schema)
        if now:
            yield pa.RecordBatch.from_pylist(done(None), schema)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [article(blocks_of(x) if x else [], set(gone or ())) for x, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    url, order = F.col("url"), ["host", "path", "page_id", "key"]
    keyed = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    parsed = keyed.select("page_id", "key", host_of(url).alias("host"), path_of(url).alias("path"), "html").mapInArrow(parse, f"page_id {kind}, key long, host string, path string, lines array<long>, inside array<boolean>")
    lists = persist(parsed.dropDuplicates(["key", "page_id"]), "page-lines")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lists.count() // BLOCK)))
    ranged = lists.repartitionByRange(n, *order).sortWithinPartitions(*order).select("page_id", "key", "host", "lines", "inside", F.spark_partition_id().alias("pid"))
    runs = persist(ranged.mapInArrow(number, f"page_id {kind}, key long, host string, lines array<long>, inside array<boolean>, pid int, run long, first boolean"), "page-runs")
    last = runs.groupBy("pid").agg(F.max("run").alias("last"))  # one row for each range
    lower, upper = borders(runs.where("first").join(F.broadcast(last), "pid").where("run <= 1 OR run >= last - 1").select("pid", "run", "host", "lines").collect())
    aligned = persist(runs.repartitionByRange(n, "pid").sortWithinPartitions("pid", "run").mapInArrow(compare, f"page_id {kind}, key long, host string, at int, line long, inside boolean"), "page-aligned")
    gone = persist(doomed(aligned, runs).groupBy("key", "page_id").agg(F.collect_list("at").alias("gone")), "page-gone")
    for x in (lists, runs, aligned):
        drop_persisted(x)
    gone = small(gone.withColumnRenamed("page_id", "of"))
    same = (keyed["key"] == gone["key"]) & keyed["page_id"].eqNullSafe(gone["of"])
    return keyed.join(gone, same, "left").select("page_id", "url", "html", "gone").mapInArrow(texts, f"page_id {kind}, url string, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
