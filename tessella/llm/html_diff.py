"""HTML extraction by differencing a page with its nearest neighbour by URL.

A page's visible text is a list of lines (block elements end a line; scripts, styles and comments are
left out). Pages of one host are ordered by the segments of their paths; the nearest page to a page is the one of its
predecessor and successor that shares more leading segments, then more leading characters, then the predecessor.
Pages of the same host whose lines are all the same count as one place in that order, at the least of their paths, so a
page is never compared with its own copy. The lines of a page and its nearest are aligned by longest common subsequence, and shared lines, which are the
host's template rather than the page's content, are deleted.

A host of any size is handled in pieces: places are ordered with range partitions over (host, path), and each
piece hands the places at its two ends to its neighbours, so no host need fit into one task. Only keys are ordered; the
64-bit hashes of the lines of a place and its nearest are joined to them afterwards, and what comes of it, a bit for each
line, to the texts, which are made from the pages a second time and so move once. Lines with equal hashes count as equal.

Defined results. A page that is alone on its host (or whose host has only copies of it) keeps all its lines. Null HTML or
a null URL: a row with null text. HTML without text, or where every line is shared: empty text. Repeated rows get equal
results. n_lines counts the lines of a page and n_shared those of them that were deleted. Further columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import common

_BREAKS = frozenset(
    "p div br hr h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tr td th section article header footer nav aside main form"
    " fieldset blockquote pre figure figcaption address body html option select details summary".split()
)
#: Elements whose content isn't read; of the first two it ends with the page where the end tag is missing.
_UNREAD = frozenset("script style noscript template svg iframe title textarea head".split())
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"[>\"']")


class _Scanner:
    """Finds the ends of tags and of unread elements. Each search that finds nothing is made once, so a page takes linear time."""

    def __init__(self, html: str) -> None:
        self.html, self.quoted, self.dead, self.missing = html, True, set(), set()

    def tag_end(self, at: int) -> int:
        """Position after the > of the tag whose name ends at ``at``, or -1; a > in a quoted value ends no tag."""
        html, i = self.html, at
        while self.quoted:
            m = _QUOTE.search(html, i)
            if m is None:  # an open quote swallowed the rest: from here on every > ends a tag
                self.quoted = False
                break
            q, i = m.group(), m.end()
            if q == ">":
                return i
            k = m.start() - 1
            while html[k].isspace():
                k -= 1
            if html[k] == "=" and q not in self.dead:
                to = html.find(q, i)
                if to < 0:
                    self.dead.add(q)
                else:
                    i = to + 1
        return html.find(">", at) + 1 or -1

    def content_end(self, name: str, at: int) -> int:
        """Position of the end tag of an unread element, or -1."""
        return self._search(rf"</{name}(?=[\s/>])", at)

    def body(self, at: int) -> int:
        return self._search(r"<body(?=[\s/>])", at)

    def _search(self, pattern: str, at: int) -> int:
        if pattern in self.missing:
            return -1
        m = re.compile(pattern, re.I).search(self.html, at)
        if m is None:
            self.missing.add(pattern)
            return -1
        return m.start()


def lines_of(html: str) -> list[str]:
    """Lines of visible text.

    Comments and the content of scripts, styles, the head and the like are left out. A missing end tag costs the rest of
    the page only for comments, scripts and styles; a head without one ends where the body begins, or at once.
    """
    scan, out, i, n = _Scanner(html), [], 0, len(html)
    while i < n:
        j = html.find("<", i)
        if j < 0 or j + 1 == n:
            out.append(html[i:])
            break
        out.append(html[i:j])
        if html.startswith("<!--", j):
            k = html.find("-->", j + 4)
            i = k + 3 if k >= 0 else n
            out.append(" ")
            continue
        m = _NAME.match(html, j + 1)
        if m is None and html[j + 1] not in "!?/":
            out.append("<")
            i = j + 1
            continue
        end = scan.tag_end(m.end() if m else j + 1)
        if end < 0:  # no tag ends after this: the rest is text
            out.append(html[j:])
            break
        i = end
        name = m.group(1).lower() if m else ""
        if name in _BREAKS:
            out.append("\n")
        elif name in _UNREAD and html[j + 1] != "/":
            k = scan.content_end(name, i)
            if k < 0 and name == "head":
                k = max(i, scan.body(i))
            i = k if k >= 0 else n if name in ("script", "style") else i
            out.append(" ")
    text = entities.unescape("".join(out).replace("\r", "\n"))
    return [s for s in (" ".join(x.split()) for x in text.split("\n")) if s]


def unshared(a: list, b: list) -> list[int]:
    """Positions of the lines of a outside a longest common subsequence with b.

    Common ends are set aside, lines that only one page has are in no common subsequence; the rest is solved by
    bit-parallel rows in memory linear in the lengths (Hirschberg's halving).
    """
    lo, hi_a, hi_b = 0, len(a), len(b)
    while lo < hi_a and lo < hi_b and a[lo] == b[lo]:
        lo += 1
    while hi_a > lo and hi_b > lo and a[hi_a - 1] == b[hi_b - 1]:
        hi_a, hi_b = hi_a - 1, hi_b - 1
    inner_b = b[lo:hi_b]
    known = set(inner_b)
    mine = [i for i in range(lo, hi_a) if a[i] in known]
    have = {a[i] for i in mine}
    other = [x for x in inner_b if x in have]
    shared = {mine[k] for k in _common([a[i] for i in mine], other)} if mine and other else set()
    return [i for i in range(lo, hi_a) if i not in shared]


def _common(a: list[str], b: list[str]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b; the table is made where it is small, else halved."""
    if not a or not b:
        return []
    if len(a) * len(b) <= 1 << 20:
        table = _table(a, b)
        i, j, out = 0, 0, []
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                out.append(i)
                i, j = i + 1, j + 1
            elif table[i + 1, j] >= table[i, j + 1]:
                i += 1
            else:
                j += 1
        return out
    if len(a) == 1:
        return [0] if a[0] in b else []
    mid = len(a) // 2
    front = _last_row(a[:mid], b)
    back = _last_row(a[mid:][::-1], b[::-1])[::-1]
    cut = int(np.argmax(front + back))
    return _common(a[:mid], b[:cut]) + [mid + k for k in _common(a[mid:], b[cut:])]


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    code: dict[str, int] = {}
    return tuple(np.array([code.setdefault(x, len(code)) for x in s], np.int64) for s in (a, b))


def _table(a: list[str], b: list[str]) -> np.ndarray:
    x, y = _codes(a, b)
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        down = table[i + 1]
        take = np.where(y == x[i], down[1:] + 1, down[:-1])
        table[i, :-1] = np.maximum.accumulate(take[::-1])[::-1]
    return table


def _last_row(a: list[str], b: list[str]) -> np.ndarray:
    x, y = _codes(a, b)
    row = np.zeros(len(b) + 1, np.int32)
    for v in x:
        take = np.where(y == v, row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(take)
    return row


def split_url(url: str) -> tuple[str, str]:
    """(host, path) in lower case host, without port, query and fragment; a trailing slash and index names don't count."""
    rest = url.partition("://")[2] or url
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    host = host.rpartition("@")[2].partition(":")[0].lower()
    return host, re.sub(r"/+", "/", "/" + path).rstrip("/") or "/"


def closeness(a: str, b: str) -> tuple[int, int]:
    x, y = a.split("/"), b.split("/")
    n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    m = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    return n, m


def _digest(lines: list[str]) -> tuple[int, bytes]:
    """A page's sign and the 64-bit hashes of its lines."""
    import xxhash

    codes = b"".join(xxhash.xxh3_64_digest(x.encode("utf-8", "surrogatepass")) for x in lines)
    return xxhash.xxh3_64_intdigest(codes) - (1 << 63), codes


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in common.slices(whole, "html"):
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                rows.append((page, *split_url(url), *_digest(lines_of(html))))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["page_id", "host", "path", "sign", "codes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=6, write_content_size=True)
    for whole in batches:
        for part in common.slices(whole, "html"):
            rows = []
            for page, url, html in zip(*(c.to_pylist() for c in part.columns), strict=True):
                lines = lines_of(html)
                rows.append((page, split_url(url)[0], _digest(lines)[0], pack.compress("\n".join(lines).encode("utf-8", "replace"))))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.binary()), strict=True)], ["page_id", "host", "sign", "body"])


def nearest(places: DataFrame) -> DataFrame:
    """(host, sign, near) for each place (host, sign, path): the sign of its nearest, null where it is alone on its host."""
    keys = places.withColumn("key", F.split("path", "/"))
    order = ["host", "key", "sign"]
    piece = keys.repartitionByRange(common.partitions(places.sparkSession), *order).withColumn("piece", F.spark_partition_id())
    piece = common.materialise(piece, "order")
    at = F.struct(*order, "path")
    # one row a piece, whatever the number of places: an order over all pieces fits one task
    ends = piece.groupBy("piece").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    row = Window.orderBy("piece")
    ends = ends.select(F.col("piece").alias("__piece"), F.lag("last").over(row).alias("before"), F.lead("first").over(row).alias("after"))
    inside = Window.partitionBy("piece").orderBy(*order)
    both = piece.select("piece", *order, "path", F.lag(at).over(inside).alias("left"), F.lead(at).over(inside).alias("right"))
    both = both.join(F.broadcast(ends), F.col("piece") == F.col("__piece")).withColumn("left", F.coalesce("left", "before")).withColumn("right", F.coalesce("right", "after"))
    own = lambda side: F.when(F.col(f"{side}.host") == F.col("host"), F.col(side))
    both = both.withColumn("left", own("left")).withColumn("right", own("right"))
    return both.select("host", "sign", "path", *(F.col(f"{side}.{x}").alias(f"{side}_{x}") for side in ("left", "right") for x in ("sign", "path"))).mapInArrow(_choose, "host string, sign long, near long")


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        near = []
        for _, _, path, left, left_path, right, right_path in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if left is None or right is None:
                near.append(right if left is None else left)
            else:
                near.append(right if closeness(path, right_path) > closeness(path, left_path) else left)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(near, pa.int64())], ["host", "sign", "near"])


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        rows = []
        for own, near in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            a, b = (np.frombuffer(x or b"", np.int64).tolist() for x in (own, near))
            keep = np.zeros(len(a), bool)
            keep[(left := unshared(a, b))] = True
            rows.append((np.packbits(keep).tobytes(), len(a), len(a) - len(left)))
        cols = list(zip(*rows, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32()), strict=True))], ["host", "sign", "keep", "n_lines", "n_shared"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for part in batches:
        texts = []
        for body, keep, n in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            lines = unpack.decompress(body).decode().split("\n") if n else []
            kept = np.unpackbits(np.frombuffer(keep, np.uint8), count=n).tolist() if n else []
            texts.append("\n".join(x for x, k in zip(lines, kept, strict=True) if k))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), part.column(3), part.column(4)], ["page_id", "text", "n_lines", "n_shared"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines, n_shared) for each page; text has a line for each line kept."""
    given = pages.select(common.column(id_col).cast("long").alias("page_id"), common.column(url_col).cast("string").alias("url"), common.column(html_col).cast("string").alias("html"))
    whole = given.filter("url is not null and html is not null")
    void = given.filter("url is null or html is null").select("page_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("n_lines"), F.lit(None).cast("int").alias("n_shared"))
    read = whole.mapInArrow(_read, "page_id long, host string, path string, sign long, codes binary")
    places = read.groupBy("host", "sign").agg(F.min_by("path", F.split("path", "/")).alias("path"), F.first("codes").alias("codes"))
    places = common.materialise(places, "places")
    other = places.select("host", F.col("sign").alias("near"), F.col("codes").alias("near_codes"))
    pairs = nearest(places.select("host", "sign", "path")).join(places.select("host", "sign", "codes"), ["host", "sign"]).join(other, ["host", "near"], "left")
    kept = pairs.select("host", "sign", "codes", "near_codes").mapInArrow(_differ, "host string, sign long, keep binary, n_lines int, n_shared int")
    texts = whole.mapInArrow(_texts, "page_id long, host string, sign long, body binary")
    found = texts.join(kept, ["host", "sign"]).select("page_id", "body", "keep", "n_lines", "n_shared")
    return found.mapInArrow(_cut, "page_id long, text string, n_lines int, n_shared int").unionByName(void)
