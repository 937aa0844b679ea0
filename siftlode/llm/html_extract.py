"""Main text of web pages by host suffix arrays.

Markup gives blocks of text and says which are surely not main text: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments. About all others the host decides, inside an article element and outside it. The
token streams of its pages, block by block, are concatenated and their suffixes sorted (prefix doubling, up to RUN_TOKENS
tokens: whether a repeated run is longer shows in its neighbours). A run is repeated if it stands on PAGES distinct pages
of the host or more, and on one page in SPREAD. A block of which half the tokens or more stand in repeated runs
is boilerplate; one inside an article only if nearly all of it is, by runs that stand on at least half of the host's
pages, so that passages which some articles share stay. What is left is the page's unique runs and its article.

A host of over CHUNK_BYTES of html is dealt into chunks, each with a suffix array of its own, and the results are those of
one array over the whole host. If a run stands on T of the host's n pages, then in some chunk of m pages it stands on T * m / n
or more: chunks name such candidates, a second pass counts the candidates in all chunks, and a third marks what reaches T
in the whole host. A host's repeated runs are at most SPREAD times the tokens of its mean page, whatever its size.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, grouped, materialise, maybe_broadcast, part_by_ids, ship
from .url_filter import split_url

RUN_TOKENS = 6
#: A run is repeated from so many pages on, and from one page in so many of the host.
PAGES, SPREAD = 3, 100
#: The same for what may leave an article.
ARTICLE_PAGES, ARTICLE_SPREAD = 5, 2
#: Share of a block's tokens that are repeated from which on it is boilerplate, outside an article and inside.
COVERED, ARTICLE_COVERED = 0.5, 0.9
CHUNK_BYTES = 16 << 20

#: Elements that start and end a block.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose content is never main text.
DROPPED = frozenset("aside button dialog footer form head header iframe menu nav noscript object select svg template textarea title".split())
#: Elements whose content is not markup, up to their end tag.
RAW = frozenset("script style textarea title xmp noembed iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements that a name never drops: they hold the page or the article, or are headings or words of it.
TRUSTED = frozenset("html body article main h1 h2 h3 h4 h5 h6 p b i em strong a span".split())
#: Parts of a class, id or role that name what is not main text.
NAMES = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies disqus footer form gdpr header masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related reply replies respond rail search share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Parts that make even an article element a reader's.
REPLIES = frozenset("comment comments reply replies".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s=>/]+|=)(\s*=\s*)?")
_VALUE = re.compile(r"[^\s>]*")
_PART = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements that the start of a block ends.
_PHRASES = frozenset("p b i em strong span a".split())

ship(__name__)


def _unwanted(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element's name or attributes say that it holds no main text."""
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    for name in ("class", "id", "role"):
        if name in attrs:
            parts = _PART.split(attrs[name])
            if not REPLIES.isdisjoint(parts) if tag == "article" else (tag not in TRUSTED or tag in ("p", "a", "span")) and not NAMES.isdisjoint(parts):
                return True
    return False


class _Scanner:
    """Tags of a page from left to right. No character is looked at more than a few times, whatever is left open."""

    def __init__(self, page: str):
        self.page, self.at, self.size = page, 0, len(page)
        self.absent: set[str] = set()  # what does not occur again

    def find(self, what: str, start: int) -> int:
        if what in self.absent:
            return -1
        found = self.page.find(what, start)
        if found < 0:
            self.absent.add(what)
        return found

    def skip_to(self, what: str, start: int) -> None:
        end = self.find(what, start)
        self.at = self.size if end < 0 else end + len(what)

    def attributes(self, start: int) -> tuple[dict[str, str], bool]:
        """The attributes from ``start`` on, and whether the tag closes itself; ``at`` is then behind the tag."""
        found: dict[str, str] = {}
        at = start
        while m := _ATTR.match(self.page, at):
            at, value = m.end(), ""
            if m[2]:
                quote = self.page[at : at + 1]
                end = self.find(quote, at + 1) if quote in ("'", '"') else -1
                if end >= 0:
                    value, at = self.page[at + 1 : end], end + 1
                else:  # no quote, or one that never ends
                    m2 = _VALUE.match(self.page, at)
                    value, at = m2[0], m2.end()
            found.setdefault(m[1].lower(), value.lower())
        end = self.find(">", at)
        self.at = self.size if end < 0 else end + 1
        return found, self.page[max(start, end - 1) : end] == "/" if end > 0 else False

    def tags(self) -> Iterator[tuple[str, str, dict[str, str], bool]]:
        """(kind, value, attributes, closes itself); kind: "text", "start" or "end"."""
        page = self.page
        while self.at < self.size:
            open_ = page.find("<", self.at)
            if open_ < 0:
                yield "text", page[self.at :], {}, False
                return
            if open_ > self.at:
                yield "text", page[self.at : open_], {}, False
            self.at = open_ + 1
            after = page[open_ + 1 : open_ + 2]
            if page.startswith("<!--", open_):
                self.skip_to("-->", open_ + 4)
            elif after in ("!", "?"):
                self.skip_to(">", open_ + 2)
            elif m := _NAME.match(page, open_ + 2 if after == "/" else open_ + 1):
                attrs, closed = self.attributes(m.end())
                yield "end" if after == "/" else "start", m[0].lower(), attrs, closed
            elif after == "/":
                self.skip_to(">", open_ + 2)
            elif open_ + 1 < self.size:
                yield "text", "<", {}, False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(zone, text) of a page's blocks in order; zone: "article" or "open" (markup does not say). Blocks that markup says are
    not main text are left out.

    References are decoded once, white space is one space, and blocks without text are left out. Unclosed and stray
    tags, comments and a cut-off end are taken as browsers do, roughly.
    """
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []  # open elements and the zone inside
    open_: Counter[str] = Counter()
    parts: list[str] = []
    zone = "open"
    scan = _Scanner(page or "")
    raw_end: dict[str, re.Pattern[str]] = {}

    def end_block() -> None:
        if parts:
            if zone != "dropped":
                text = " ".join(_html.unescape("".join(parts)).split())
                if text:
                    out.append((zone, text))
            parts.clear()

    def pop() -> str:
        tag, _ = stack.pop()
        open_[tag] -= 1
        return tag

    for kind, tag, attrs, closed in scan.tags():
        if kind == "text":
            parts.append(tag)
        elif kind == "end":
            if not open_[tag]:
                if tag in BLOCKS:
                    end_block()
                continue
            i = len(stack) - 1
            while stack[i][0] != tag:
                i -= 1
            before = stack[i - 1][1] if i else "open"
            if tag in BLOCKS or before != zone:
                end_block()
            while len(stack) > i:
                pop()
            zone = before
        elif tag == "br":
            parts.append(" ")
        else:
            if tag in BLOCKS:
                end_block()
                while stack and stack[-1][0] in _PHRASES:  # a block ends an open paragraph and what is in it
                    pop()
                if tag == "li" and stack and stack[-1][0] == "li":
                    pop()
                zone = stack[-1][1] if stack else "open"
            if tag in RAW:
                end = raw_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)).search(scan.page, scan.at)
                scan.at = end.end() if end else scan.size
                continue
            if tag in VOID or closed:
                continue
            inside = "dropped" if zone == "dropped" or _unwanted(tag, attrs) else "article" if zone == "article" or tag in ("article", "main") or attrs.get("role") == "main" else zone
            if inside != zone:
                end_block()
            stack.append((tag, inside))
            open_[tag] += 1
            zone = inside
    end_block()
    return out


def pack(page: str | None) -> bytes:
    """A page's blocks, compressed: what is moved of it."""
    return zstandard.ZstdCompressor(level=1).compress("\n".join(z[0] + t for z, t in blocks(page)).encode("utf-8", "surrogatepass"))


def unpack(packed: bytes) -> list[tuple[str, str]]:
    """(first letter of the zone, text) of the blocks; texts have no line feeds."""
    raw = zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
    return [(x[0], x[1:]) for x in raw.split("\n")] if raw else []


class Tokens:
    """Numbers of words, and hashes of runs of them that are the same on every machine."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.digests = np.zeros(0, np.uint64)
        self.added: list[int] = []

    def stream(self, page: list[tuple[str, str]]) -> np.ndarray:
        out, numbers = [], self.numbers
        for _, text in page:
            for w in text.split(" "):
                k = numbers.get(w)
                if k is None:
                    k = numbers[w] = len(numbers)
                    self.added.append(xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")))
                out.append(k)
        return np.array(out, np.int64)

    def run_hashes(self, tokens: np.ndarray, starts: np.ndarray, run: int) -> np.ndarray:
        if self.added:
            self.digests = np.r_[self.digests, np.array(self.added, np.uint64)]
            self.added.clear()
        h = np.zeros(len(starts), np.uint64)
        for j in range(run):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + self.digests[tokens[starts + j]]
        return (h ^ (h >> np.uint64(32))).view(np.int64)


def shared_runs(streams: list[np.ndarray], run: int = RUN_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of the concatenated streams: (suffixes of ``run`` tokens or more in order, for each the number of
    its run, for each run the number of distinct pages it stands on). Ranks of suffixes by their first 1, 2, 4, ... tokens."""
    sizes = [len(s) for s in streams]
    total = sum(sizes)
    none = np.zeros(0, np.int64)
    if not total:
        return none, none, none
    owner = np.repeat(np.arange(len(streams)), sizes)
    left = np.concatenate([np.arange(k, 0, -1) for k in sizes if k])  # tokens to the page's end
    rank = np.unique(np.concatenate(streams), return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:
        step = min(width, run - width)
        second = np.full(total, -1, np.int64)
        second[: total - step] = rank[step:]
        # a suffix that ends with its page before that is like no other
        second = np.where(left > step, second, -1 - owner)
        second -= second.min()
        rank = np.unique(rank * (int(second.max()) + 1) + second, return_inverse=True)[1].astype(np.int64)
        width += step
    whole = np.flatnonzero(left >= run)
    order = whole[np.lexsort((owner[whole], rank[whole]))]
    if not len(order):
        return none, none, none
    new_run = np.r_[True, rank[order][1:] != rank[order][:-1]]
    new_page = new_run | np.r_[True, owner[order][1:] != owner[order][:-1]]
    group = np.cumsum(new_run) - 1
    return order, group, np.bincount(group, weights=new_page).astype(np.int64)


def covered(starts: np.ndarray, total: int, run: int = RUN_TOKENS) -> np.ndarray:
    """Which of ``total`` tokens stand in a run that begins at one of ``starts``."""
    marks = np.zeros(total + run + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + run, -1)
    return np.cumsum(marks)[:total] > 0


def repeated(streams: list[np.ndarray], *least: int, run: int = RUN_TOKENS) -> list[list[np.ndarray]]:
    """For each number of pages in ``least``, and for each page's token numbers: which tokens stand in a run of ``run`` tokens
    that so many pages share."""
    order, group, spread = shared_runs(streams, run)
    sizes = [len(s) for s in streams]
    return [np.split(covered(order[spread[group] >= n] if len(order) else order, sum(sizes), run), np.cumsum(sizes)[:-1]) for n in least]


def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in ``listed``, which ascends."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def thresholds(n: int) -> tuple[int, int]:
    """Pages of a host of ``n`` pages from which on a run is repeated, outside an article and inside."""
    return max(PAGES, -(-n // SPREAD)), max(ARTICLE_PAGES, -(-n // ARTICLE_SPREAD))


def choose(page: list[tuple[str, str]], seen: np.ndarray, widely: np.ndarray) -> str:
    """The text of a page of which the tokens of ``seen`` are repeated, and ``widely`` so. An article never loses all blocks."""
    at, stays, spare = 0, [], []
    for zone, text in page:
        n = text.count(" ") + 1
        part = slice(at, at + n)
        at += n
        stays.append(widely[part].mean() < ARTICLE_COVERED if zone == "a" else seen[part].mean() < COVERED)
        spare.append(zone == "a")
    if any(spare) and not any(s and a for s, a in zip(stays, spare, strict=True)):
        stays = [s or a for s, a in zip(stays, spare, strict=True)]
    return "\n".join(t for (_, t), s in zip(page, stays, strict=True) if s)


def extract(pages: list[str | None]) -> list[tuple[str, int, int]]:
    """(text, tokens, repeated tokens) of all pages of a host, in memory."""
    return _extracted([unpack(pack(p)) for p in pages])


def _extracted(pages: list[list[tuple[str, str]]]) -> list[tuple[str, int, int]]:
    own = Tokens()
    streams = [own.stream(p) for p in pages]
    marks = repeated(streams, *thresholds(len(pages)))
    return [(choose(p, seen, widely), len(seen), int(seen.sum())) for p, seen, widely in zip(pages, *marks, strict=True)]


def _packed(rows: DataFrame) -> DataFrame:
    """``rows`` (page_id, url, host, chunks, html) with a chunk dealt out to each row and its blocks instead of the html."""
    schema = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("host", T.StringType()), T.StructField("chunk", T.IntegerType()), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = 7919 * TaskContext.get().partitionId()
        for b in batches:
            chunks = b.column("chunks").to_numpy()
            # by the row's place, so that rows that repeat are spread too
            dealt = pa.array(((at + np.arange(b.num_rows)) % chunks).astype(np.int32))
            at += b.num_rows
            packs = pa.array([pack(h.as_py()) for h in b.column("html")], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), dealt, packs], names=schema.names)

    return rows.select("page_id", "url", "host", "chunks", "html").mapInArrow(run, schema)


def _out_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("n_chars", "n_tokens", "n_repeated")]])


def _out(t: pa.Table, found: list[tuple[str, int, int]]) -> pa.Table:
    texts, n, m = zip(*found, strict=True)
    return pa.table([t.column("page_id"), t.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_tokens", "n_repeated"])


def _small(rows: DataFrame) -> DataFrame:
    """The texts of hosts that are one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("host",)):
            yield from _out(t, _extracted([unpack(x.as_py()) for x in t.column("packed")])).to_batches()

    dealt = _packed(rows.withColumn("chunks", F.lit(1)))
    return dealt.repartition("host").sortWithinPartitions("host").mapInArrow(run, _out_schema(rows))


def _chunk_runs(rows: DataFrame, candidates: bool) -> DataFrame:
    """(host, run, n): on how many pages of each chunk its runs stand; only those that may reach the host's threshold by
    what they have in their chunk, if ``candidates``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ("host", "chunk")):
            own, n = Tokens(), t.column("pages")[0].as_py()
            streams = [own.stream(unpack(x.as_py())) for x in t.column("packed")]
            order, group, spread = shared_runs(streams)
            if not len(order):
                continue
            first = order[np.r_[True, group[1:] != group[:-1]]]
            if candidates:
                near = spread * n >= thresholds(n)[0] * len(streams)
                first, spread = first[near], spread[near]
            hashes = own.run_hashes(np.concatenate(streams), first, RUN_TOKENS)
            host = pa.array(np.full(len(first), t.column("host_key")[0].as_py(), np.int64))
            yield from pa.table([host, pa.array(hashes), pa.array(spread)], names=["host", "run", "n"]).to_batches(max_chunksize=1 << 16)

    return rows.repartition("host", "chunk").sortWithinPartitions("host", "chunk").mapInArrow(run, "host long, run long, n long")


def _large(rows: DataFrame, big: DataFrame, few: bool) -> DataFrame:
    """The texts of hosts of many chunks. ``big``: host, chunks, pages; ``few``: it may be broadcast."""
    limit = 1 << 62 if few else 0
    packed = _packed(rows)
    sized = packed.join(maybe_broadcast(big.select("host", "pages"), 0, limit), "host").withColumn("host_key", F.xxhash64("host"))
    near = materialise(_chunk_runs(sized, True).select("run").distinct())
    _, counted = part_by_ids(_chunk_runs(sized, False), "run", near, "run")
    least = F.greatest(F.lit(PAGES), F.ceil(F.col("pages") / SPREAD))
    most = F.greatest(F.lit(ARTICLE_PAGES), F.ceil(F.col("pages") / ARTICLE_SPREAD))
    sums = counted.groupBy(F.col("host").alias("host_key"), "run").agg(F.sum("n").alias("n"))
    keyed = big.withColumn("host_key", F.xxhash64("host"))
    often = sums.join(maybe_broadcast(keyed, 0, limit), "host_key").where(F.col("n") >= least)
    # a bounded number of runs a host, see above; one copy for each of its chunks
    heads = materialise(often.groupBy("host", "chunks").agg(F.collect_list("run").alias("runs"), F.collect_list(F.when(F.col("n") >= most, F.col("run"))).alias("wide")))
    heads = heads.select("host", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "runs", "wide")
    every = packed.unionByName(heads, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wide = np.zeros(0, np.int64)
        key, own = None, Tokens()
        for b in batches:
            rows_, found = [], []
            for i, (k, runs) in enumerate(zip(zip(b.column("host").to_pylist(), b.column("chunk").to_pylist(), strict=True), b.column("runs"), strict=True)):
                if k != key:
                    key, own = k, Tokens()
                    known = wide = np.zeros(0, np.int64)
                if runs.is_valid:
                    known, wide = (np.sort(x.values.to_numpy(zero_copy_only=False)) for x in (runs, b.column("wide")[i]))
                    continue
                page = unpack(b.column("packed")[i].as_py())
                tokens = own.stream(page)
                starts = np.arange(max(0, len(tokens) - RUN_TOKENS + 1))
                hashes = own.run_hashes(tokens, starts, RUN_TOKENS)
                seen, widely = (covered(starts[among(hashes, x)], len(tokens)) for x in (known, wide))
                rows_.append(i)
                found.append((choose(page, seen, widely), len(tokens), int(seen.sum())))
            if found:
                yield from _out(pa.Table.from_batches([b]).take(rows_), found).to_batches()

    dealt = every.repartition("host", "chunk").sortWithinPartitions("host", "chunk", F.col("runs").isNull())
    return dealt.mapInArrow(run, _out_schema(rows))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars, n_tokens, n_repeated): one row a row of ``pages``.

    Null or empty html gives an empty text. Repeated rows each give one and count as pages. Pages without a host are
    a host of their own. An empty table gives an empty one. Only the named columns are read. ``chunk_bytes`` changes no
    result (up to collisions of 64-bit hashes).
    """
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", split_url(F.col("url"))[0])
    sizes = p.groupBy("host").agg(F.sum(F.octet_length("html")).alias("size"), F.count(F.lit(1)).alias("pages"))
    big = materialise(sizes.where(F.col("size") > chunk_bytes).select("host", F.ceil(F.col("size") / chunk_bytes).cast("int").alias("chunks"), "pages"))
    n = big.count()
    if not n:
        return _small(p)
    small = p.join(maybe_broadcast(big.select("host"), n), "host", "left_anti")
    large = p.join(maybe_broadcast(big.select("host", "chunks"), n), "host")
    return _small(small).union(_large(large, big, n <= BROADCAST_ROWS))
