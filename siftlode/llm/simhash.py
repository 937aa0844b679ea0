"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint's bit is 1 if it is set in over half the XXH64 hashes of the text's word shingles. Two fingerprints
within ``radius`` bits share a variant that is within half the radius of both, so every distinct fingerprint emits all
its variants of at most radius / 2 flipped bits, variants meet in a shuffle, and fingerprints that share one are
linked. (Two that share a variant are within the radius of each other by the triangle inequality, which is checked
again.)

All variants of 64 bits and radius 4 are 2,081 a fingerprint, too many bytes to move one by one. The shuffle therefore
keys on a variant's upper bits: 37 rows a fingerprint for 8 bits, each with the flips it may still make below. A task then
emits the lower halves of all variants of its keys in sorted runs of bounded length and finds those that meet. A key
of more variants than a run is dealt out by further bits inside the task, where a row costs no shuffle. Keys with more rows
than a task holds are first dealt out so in the shuffle, as many times as it takes. Where many meet, a variant links its members to
the least of them, never all with all; a run gives a spanning forest of what it found, so the number of links stays in
proportion to the fingerprints.

One fingerprint of word shingles is within 4 bits for few pairs of a Jaccard similarity of 0.8. ``similar_documents``
therefore gives each document several independent fingerprints of its pairs of words, which an edit changes less, lets each
make candidates by ball hashing, and verifies the candidate groups exactly on sets of five-word shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, maybe_broadcast, own_prefix, part_by_ids, ship
from .components import connected_components, forest
from .verify import SIMILAR, verified_links

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Bits of a variant that make the key of the shuffle, and by which hot keys are dealt out further.
KEY_BITS = 8
#: Rows of a key that one task takes as they are, 24 bytes each; a key with more is dealt out by its next bits. Dealing out
#: makes 137 rows a fingerprint of 37, so it is for keys that a task can't hold: from some 14 million distinct fingerprints.
KEY_ROWS = 1 << 21
#: Variants in a sorted run: what a task holds at once.
RUN = 2_000_000
#: Links that a task gathers before it lets go of them.
LINKS = 1 << 19
#: Fingerprints of a document's pairs of words, and words of a shingle, where documents are to be similar.
CODES = 8
SIMILAR_SHINGLE = 5
#: The run there: its tasks share an executor with the workers of the stages before.
SIMILAR_RUN = 500_000

ship(__name__)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash: A-Z lower-cased, words between ASCII white space, shingles with their repeats.

    Fewer words than a shingle: the whole sequence is the only shingle. No word, or null: 0.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest, join = xxhash.xxh64_digest, b" ".join
    grams = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [tuple(w)]
    total, n, block = np.zeros(64, np.int64), 0, []
    for g in grams:
        block.append(digest(join(g), seed))
        if len(block) == 16_384:
            total, n, block = total + _bit_sums(block), n + len(block), []
    if block:
        total, n = total + _bit_sums(block), n + len(block)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _bit_sums(digests: list[bytes]) -> np.ndarray:
    return _bit_sums_of(np.frombuffer(b"".join(digests), ">u8"))


def _bit_sums_of(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit numbers have each bit, the highest first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    # sums of up to 255 rows fit a byte, which keeps the long axis in narrow registers
    full = len(bits) // 255 * 255
    out = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        out += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row a row of ``docs``; fp holds the fingerprint's 64 bits as a signed long."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return rows.mapInArrow(run, schema)


def _flips(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, number of bits) of all ways to flip up to ``most`` of ``bits`` bits."""
    return [(sum(1 << i for i in c), k) for k in range(most + 1) for c in combinations(range(bits), k)]


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """(code, key, left, fp): the upper bits of fp's variants, and the flips that a variant may still have below."""
    half = radius // 2
    flips = F.array(*[F.lit(mask * 8 + half - k) for mask, k in _flips(KEY_BITS, half)])
    rows = fps.select("code", "fp", F.explode(flips).alias("flip"))
    key = F.shiftrightunsigned("fp", 64 - KEY_BITS).bitwiseXOR(F.shiftright("flip", 3).cast("long"))
    return rows.select("code", key.alias("key"), F.col("flip").bitwiseAND(F.lit(7)).cast("int").alias("left"), "fp")


def _deeper(rows: DataFrame, used: int, radius: int) -> DataFrame:
    """The same for keys longer by KEY_BITS."""
    half = radius // 2
    flips = F.array(*[F.lit(mask * 8 + k) for mask, k in _flips(KEY_BITS, half)])
    out = rows.select("*", F.explode(flips).alias("flip")).where("(flip & 7) <= left")
    below = F.shiftrightunsigned("fp", 64 - used - KEY_BITS).bitwiseAND(F.lit((1 << KEY_BITS) - 1).cast("long"))
    key = F.shiftleft("key", KEY_BITS).bitwiseOR(below.bitwiseXOR(F.shiftright("flip", 3).cast("long")))
    return out.select("code", key.alias("key"), (F.col("left") - F.col("flip").bitwiseAND(F.lit(7))).cast("int").alias("left"), "fp")


def _masks(bits: int, k: int) -> np.ndarray:
    return np.array([m for m, n in _flips(bits, k) if n == k], np.uint64)


def _variants(left: np.ndarray, bits: int) -> int:
    """Variants of rows that may still make ``left`` flips in ``bits`` bits."""
    return sum(int(n) * sum(comb(bits, i) for i in range(k + 1)) for k, n in enumerate(np.bincount(left)))


def _dealt(key: np.ndarray, left: np.ndarray, fp: np.ndarray, bits: int, radius: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Some keys in pieces (key, left, fp, bits) of at most ``most`` variants, keys made longer for it as in ``_deeper``. Each
    variant is in one piece, with all rows that have it. Only what shares all bits but KEY_BITS or fewer may be more."""
    if bits <= KEY_BITS or _variants(left, bits) <= most:
        yield key, left, fp, bits
        return
    rest, flips = bits - KEY_BITS, _flips(KEY_BITS, radius // 2)
    below = ((fp >> np.uint64(rest)) & np.uint64((1 << KEY_BITS) - 1)).astype(np.uint8)
    order = np.argsort(below, kind="stable").astype(np.int32)
    starts = np.r_[0, np.cumsum(np.bincount(below, minlength=1 << KEY_BITS))]
    held, size = [], 0
    for s in range(1 << KEY_BITS):
        at = [(order[starts[s ^ m] : starts[(s ^ m) + 1]], k) for m, k in flips]
        at = [(i[left[i] >= k], k) for i, k in at]
        who = np.concatenate([i for i, _ in at])
        if not len(who):
            continue
        part = (key[who] << np.uint64(KEY_BITS)) | np.uint64(s), left[who] - np.repeat([k for _, k in at], [len(i) for i, _ in at]), fp[who]
        n = _variants(part[1], rest)
        if held and size + n > most:
            yield from _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), rest, radius, most)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield from _dealt(*(np.concatenate(x) for x in zip(*held, strict=True)), rest, radius, most)


def _met(key: np.ndarray, left: np.ndarray, fp: np.ndarray, bits: int, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of some keys: (one, other), a spanning forest of all that share a variant."""
    base = (key << np.uint64(bits)) | (fp & np.uint64((1 << bits) - 1))
    masks = [_masks(bits, k) for k in range(radius // 2 + 1)]
    total = sum(int((left >= k).sum()) * len(masks[k]) for k in range(len(masks)))
    slices = max(1, -(-total // most))
    found_a, found_b = [], []
    for s in range(slices):
        values, owners = [], []
        for k, m in enumerate(masks):
            who = np.flatnonzero(left >= k)
            step = max(1, most // max(1, len(m)))
            for i in range(0, len(who), step):
                own = np.repeat(who[i : i + step].astype(np.int32), len(m))
                val = (base[who[i : i + step], None] ^ m[None, :]).ravel()
                if slices > 1:  # a key with very many variants: each pass takes those of one hash class
                    mine = (val * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                    mine = mine % np.uint64(slices) == s
                    own, val = own[mine], val[mine]
                values.append(val)
                owners.append(own)
        val, own = np.concatenate(values), np.concatenate(owners)
        del values, owners
        order = np.sort(val)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        del order
        if not len(twice):
            continue
        # a table of hash bits spares most variants the search among those that met
        spot = lambda x: (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)
        flags = np.zeros(1 << 20, bool)
        flags[spot(twice)] = True
        near = np.flatnonzero(flags[spot(val)])
        at = np.searchsorted(twice, val[near])
        hit = twice[np.minimum(at, len(twice) - 1)] == val[near]
        group, member = at[hit], own[near[hit]]
        order = np.lexsort((fp[member], group))
        group, member = group[order], member[order]
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        number = np.cumsum(np.r_[0, (group[1:] != group[:-1]).astype(np.int64)])
        first = member[starts][number]
        sure = np.bitwise_count(fp[first] ^ fp[member]) <= radius
        label, before = np.arange(len(fp)), None
        first, member = first[sure], member[sure]
        while before is None or (label != before).any():
            before = label.copy()
            low = np.minimum(label[first], label[member])
            np.minimum.at(label, first, low)
            np.minimum.at(label, member, low)
            label = label[label]
        linked = np.flatnonzero(label != np.arange(len(fp)))
        found_a.append(label[linked])
        found_b.append(linked)
    if not found_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if len(found_a) > 1:  # one forest of what the passes found, else each gives links of its own for the same rows
        label = forest(len(fp), a, b)
        b = np.flatnonzero(label != np.arange(len(fp)))
        a = label[b]
    return fp[a], fp[b]


def _spanning(links: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """One forest of several lists of links between fingerprints: at most one link a fingerprint."""
    n = sum(len(a) for a, _ in links)
    if not n:
        return []
    fps, at = np.unique(np.concatenate([a for a, _ in links] + [b for _, b in links]), return_inverse=True)
    label = forest(len(fps), at[:n], at[n:])
    b = np.flatnonzero(label != np.arange(len(fps)))
    return [(fps[label[b]], fps[b])]


def _meet(rows: DataFrame, bits: int, radius: int, most: int, links: int = LINKS) -> DataFrame:
    """Links (code, u, v) among keyed rows; rows of a key stand together, as many whole keys of one code at a time as make
    a run. What a task finds for a code, in whatever runs and pieces, is one forest (one for each ``links`` links)."""
    weight = np.array([sum(len(_masks(bits, k)) for k in range(j + 1)) for j in range(radius // 2 + 1)], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        found_code = -1

        def found_links() -> Iterator[pa.RecordBatch]:
            nonlocal found
            for a, b in _spanning(found):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), found_code, np.int32)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["code", "u", "v"])
            found = []

        def ends_of(code: np.ndarray, key: np.ndarray) -> np.ndarray:
            """Where groups of one key end."""
            return np.flatnonzero(np.r_[(key[1:] != key[:-1]) | (code[1:] != code[:-1]), True]) + 1

        def flush(code: np.ndarray, key: np.ndarray, left: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal found, found_code
            ends, cost, i = ends_of(code, key), np.cumsum(weight[left]), 0
            while i < len(key):
                if code[i] != found_code:
                    yield from found_links()
                    found_code = int(code[i])
                limit = (cost[i - 1] if i else 0) + most
                fit = ends[(ends > i) & (ends <= np.searchsorted(code, code[i], "right"))]
                j = fit[max(0, np.searchsorted(cost[fit - 1], limit, "right") - 1)]
                for piece in _dealt(key[i:j], left[i:j], fp[i:j], bits, radius, most):
                    found.append(_met(*piece, radius, most))
                    if sum(len(a) for a, _ in found) > links:
                        found = _spanning(found)
                        if len(found[0][0]) > links // 2:
                            yield from found_links()
                i = j

        for b in batches:
            code, key, left, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            held.append((code, key.view(np.uint64), left, fp.view(np.uint64)))
            size += int(weight[left].sum())
            if size >= most:
                # the last key may go on in the next batch
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                ends = ends_of(whole[0], whole[1])
                cut = int(ends[-2]) if len(ends) > 1 else 0
                if cut:
                    yield from flush(*(x[:cut] for x in whole))
                held = [tuple(x[cut:] for x in whole)]
                size = int(weight[held[0][2]].sum()) if cut else 0
        if held and sum(len(x[0]) for x in held):
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            held = []  # a key of many rows is not held twice
            yield from flush(*whole)
        yield from found_links()

    dealt = rows.select("code", "key", "left", "fp").repartition("code", "key").sortWithinPartitions("code", "key")
    return dealt.mapInArrow(run, "code int, u long, v long")


def ball_links(fps: DataFrame, radius: int = RADIUS, key_rows: int = KEY_ROWS, run: int = RUN) -> DataFrame:
    """Links (code, u, v) of distinct fingerprints ``fps`` (code, fp), those of each code apart: those linked here, directly
    or over others, are just those that chains of pairs within ``radius`` bits connect."""
    if radius % 2:
        raise ValueError("the radius must be even")
    rows, used, out = _keyed(fps, radius), KEY_BITS, None
    while True:
        hot = materialise(rows.groupBy("code", "key").count().where(F.col("count") > key_rows).select("code", "key"), rows=64 << used) if used < 48 else None
        n = hot.count() if hot is not None else 0
        if not n:
            found = _meet(rows, 64 - used, radius, run)
            return found if out is None else out.union(found)
        hot = maybe_broadcast(hot, n)
        found = _meet(rows.join(hot, ["code", "key"], "left_anti"), 64 - used, radius, run)
        out = found if out is None else out.union(found)
        rows = _deeper(rows.join(hot, ["code", "key"], "left_semi"), used, radius)
        used += KEY_BITS


def _links(fps: DataFrame, radius: int, run: int = RUN) -> DataFrame:
    # fingerprints are small and their keys many: a fixed number of tasks emits them
    return materialise(ball_links(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))), radius, run=run))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): one row a row of ``docs``.

    component_id: the smallest doc_id reachable over links, itself included (ids that are null don't count; null if
    a component has no other). Rows with equal texts share a fingerprint and so a component; texts without words, and
    null, have fingerprint 0 and link like any other. An empty table gives an empty one. Only ``doc_id`` and ``text``
    are read.
    """
    fps = materialise(with_fingerprints(docs, doc_id, text, shingle))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = _links(distinct.select(F.lit(0).alias("code"), "fp"), radius)
    roots = connected_components(links)
    n = distinct.count()
    named = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left"), rows=n)
    # components are looked up for distinct fingerprints that have links; documents meet them by fingerprint alone.
    # As tables, both sides leave the join free to split a root that very many fingerprints share.
    least = materialise(named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id")), rows=n)
    linked = named.where("root is not null").join(least, "root").select("fp", "component_id")
    of_fp = materialise(named.where("root is null").select("fp", F.col("least").alias("component_id")).union(linked), rows=n)
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id.

    Rows that repeat an id inside a component count as one document. A component whose ids are all null keeps one row.
    """
    return keep_least(docs, near_duplicates(docs, doc_id, text, radius, shingle), doc_id)


def pair_codes(w: list[bytes], codes: int = CODES) -> list[int]:
    """``codes`` independent 64-bit SimHashes of the set of pairs of consecutive words ``w``; 0 for none."""
    if not w:
        return [0] * codes
    pairs = {b" ".join(p) for p in zip(w, w[1:], strict=False)} or {w[0]}
    h = np.frombuffer(b"".join([xxhash.xxh3_64_digest(p, SEED) for p in pairs]), ">u8").astype(np.uint64)
    out = []
    for k in range(codes):
        x = h ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        for by, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(by))) * np.uint64(times)
        x ^= x >> np.uint64(31)
        total = sum(_bit_sums_of(x[i : i + 16_384]) for i in range(0, len(x), 16_384))
        out.append(int.from_bytes(np.packbits(total * 2 > len(x)).tobytes(), "big"))
    return out


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles; words and short texts as in ``fingerprint``."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.int64)
    digest, join = xxhash.xxh64_digest, b" ".join
    grams = zip(*(w[i:] for i in range(shingle)), strict=False) if len(w) >= shingle else [tuple(w)]
    return np.unique(np.frombuffer(b"".join([digest(join(g), SEED) for g in grams]), "<i8"))


def _with_codes(docs: DataFrame, doc_id: str, text: str, codes: int) -> DataFrame:
    """(doc_id, th, t, codes): one row a row of ``docs``. th: hash of the text as it is; t: hash of its words."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("th"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("th", T.LongType()), T.StructField("t", T.LongType()), T.StructField("codes", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, flat = [], []
            for t in b.column(1):
                w = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                keys.append(xxhash.xxh3_64_intdigest(b" ".join(w), SEED))
                flat += pair_codes(w, codes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, codes, dtype=np.int32)), pa.array(np.array(flat, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array(keys, np.uint64).view(np.int64)), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def _candidates(nodes: DataFrame, radius: int) -> DataFrame:
    """(t, root, fp) of the nodes (t, codes) that some code puts in a group with others; fp: the first code."""
    own = nodes.select("t", F.posexplode("codes").alias("code", "fp"))
    values = materialise(own.groupBy("code", "fp").agg(F.count(F.lit(1)).alias("n")))
    links = _links(values.select("code", "fp"), radius, SIMILAR_RUN)
    size = 2 * links.count() + values.where("n > 1").count()
    name = lambda c: F.xxhash64("code", c)
    met = materialise(links.select(name("u").alias("v")).union(links.select(name("v").alias("v"))).union(values.where("n > 1").select(name("fp").alias("v"))).distinct(), rows=size)
    # each node is linked to the names of its fingerprints, and those among each other
    edges = own.select(F.col("t").alias("u"), name("fp").alias("v")).join(met, "v", "left_semi").select("u", "v")
    roots = connected_components(edges.union(links.select(name("u").alias("u"), name("v").alias("v"))))
    return roots.join(nodes.select(F.col("t").alias("node"), F.get("codes", F.lit(0)).alias("fp")), "node").withColumnRenamed("node", "t")


def _sets(docs: DataFrame, found: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(root, t, fp, own): the sets of ``wanted`` (t, root, fp), from one row of each; only those rows' texts move."""
    n = wanted.count()
    one = materialise(found.select("doc_id", "th", "t").join(wanted.select("t"), "t", "left_semi").groupBy("t").agg(F.min(F.struct("th", "doc_id")).alias("row")).select("t", F.col("row.th").alias("lh"), F.col("row.doc_id").alias("id")), rows=n)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("th", F.xxhash64("text"))
    _, near = part_by_ids(rows, "th", one, "lh")
    own = near.join(one, (F.col("th") == F.col("lh")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("t", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # rows that repeat give one set a task
        for b in batches:
            for t, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if t not in seen:
                    seen.add(t)
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([shingle_set(x.as_py(), shingle)], pa.list_(pa.int64()))], names=["t", "own"])

    sets = own.mapInArrow(run, "t long, own array<long>")
    return materialise(sets.join(wanted, "t").select("root", "t", "fp", "own"))


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: tuple[int, int] = SIMILAR, shingle: int = SIMILAR_SHINGLE, codes: int = CODES, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id): one row a row of ``docs``.

    Linked are documents that some of ``codes`` fingerprints of their pairs of words put in one group and whose sets of shingles
    have a Jaccard similarity of ``similar`` or more, which is checked exactly: no link is below it. A pair of
    similarity 0.8 that no third document connects is missed if none of its codes is within ``radius`` bits (recall is
    measured in the tests). component_id: the smallest doc_id reachable, itself included (ids that are null don't
    count; null if a component has no other). Texts of the same words are one, those without words and null among
    them. An empty table gives an empty one. Only ``doc_id`` and ``text`` are read.
    """
    found = materialise(_with_codes(docs, doc_id, text, codes))
    nodes = materialise(found.groupBy("t").agg(F.first("codes").alias("codes"), F.min("doc_id").alias("least")))
    n = nodes.count()
    wanted = materialise(_candidates(nodes, radius), rows=n)
    roots = connected_components(verified_links(_sets(docs, found, wanted, doc_id, text, shingle), similar))
    named = materialise(nodes.select("t", "least").join(roots.withColumnRenamed("node", "t"), "t", "left"), rows=n)
    least = materialise(named.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id")), rows=n)
    linked = named.where("root is not null").join(least, "root").select("t", "component_id")
    of_node = materialise(named.where("root is null").select("t", F.col("least").alias("component_id")).union(linked), rows=n)
    return found.select("doc_id", "t").join(of_node, "t").select("doc_id", "component_id")


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each component of ``similar_documents``: that with the smallest id, as
    ``drop_near_duplicates``."""
    return keep_least(docs, similar_documents(docs, doc_id, text, **how), doc_id)


def keep_least(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of ``found`` (doc_id, component_id): that with the smallest id."""
    found = materialise(found)
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    listed = f"{own_prefix(docs)}id"
    # ids of which no row stays, or several would
    odd = materialise(found.groupBy(F.col("doc_id").alias(listed)).agg(F.count_if(stays).alias("n")).where("n <> 1"), rows=found.count())
    single, possible = part_by_ids(docs, doc_id, odd, listed)
    same = F.col(doc_id).eqNullSafe(F.col(listed))
    kept = single.unionByName(possible.join(odd.select(listed), same, "left_anti"))
    repeats = odd.where("n > 1").select(listed)
    if repeats.isEmpty():
        return kept
    return kept.unionByName(possible.join(repeats, same, "left_semi").dropDuplicates([doc_id]))
