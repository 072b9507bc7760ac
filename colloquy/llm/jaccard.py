"""Exact n-gram Jaccard join: light sets by subset enumeration, heavy sets by inverted lists.

Rows in: doc_id and text, further columns ignored. A document's set holds its distinct shingles of
`width` words (A-Z lower-cased); with fewer words the whole sequence is its one shingle; a null,
empty or blank text has the empty set and links with nothing. Two sets link when
den * |intersection| >= num * |union|. Repeated rows are separate rows of one class; rows with a
null doc_id take part but never name a component unless all its members are null.

How pairs are found, without listing all pairs of a group:

* Equal sets are one class, found by a digest of 128 bits, so copies cost one row each.
* Light sets (size up to a boundary b): linked sets share all elements of some subset of fixed size
  c, the smallest overlap their sizes allow, so each set posts all its c-subsets.
* Heavy sets (above b, and lighter ones that may link across b): a set is posted to the inverted lists of
  its prefix, the first elements in one global order, so many that linked sets share one of them. The order
  puts common shingles last, so lists are short and most hold one set only; these are dropped at once.
  Lists of common shingles are dealt over SPREAD tasks.
* b is the boundary of least cost: subsets enumerated below it against list entries scanned above.
* Each list first links its members to one leader, then, where members besides the leader are in more than one
  component, to a few leaders more; what remains across components is compared in full. Members
  already connected need no further comparison: components are what is asked for. Before two sets
  are fetched and compared, sizes and parity marks must allow a link.

Words are hashed to 64 bits by tables of random values for every place and byte, long ones by BLAKE2; a shingle is
a polynomial of its words' hashes. Two different shingles of one compared pair meet with odds near 1e-13.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import discard, staged

U = np.uint64
SEGMENT = 4 << 20  # bytes hashed at once; longer texts are cut at blanks


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: Bytes of a word that the tables know.
PLACES = 64


def _tables() -> np.ndarray:
    t = _mix(np.arange(1, PLACES * 256 + 1, dtype=U) * U(0x9E3779B97F4A7C15)).reshape(PLACES, 256)
    t[:, 65:91] = t[:, 97:123]  # A-Z count as a-z
    return t.ravel()


_TABLES = _tables()


def _blank(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def _segment_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of buf and the number of words between successive bounds."""
    inside = ~_blank(buf)
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = bounds[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    before[cuts] = False
    start = np.flatnonzero(inside & ~before)
    counts = np.diff(np.searchsorted(start, bounds))
    if not len(start):
        return np.zeros(0, dtype=U), counts
    solid = buf[inside]
    at = np.cumsum(inside)[start] - 1
    sizes = np.diff(np.r_[at, len(solid)])
    place = np.arange(len(solid)) - np.repeat(at, sizes)
    hashes = _mix(np.add.reduceat(_TABLES[(place & (PLACES - 1)) << 8 | solid], at) + sizes.astype(U))
    for i in np.flatnonzero(sizes > PLACES):
        word = solid[at[i] : at[i] + sizes[i]].tobytes().lower()
        hashes[i] = np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), dtype=U)[0]
    return hashes, counts


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text its words' hashes, in order."""
    texts = texts.cast(pa.large_string())
    n, first = len(texts), 0
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, side="right")) - 1)
        lo, hi = int(offsets[first]), int(offsets[last])
        if hi == lo:
            yield from (np.zeros(0, dtype=U) for _ in range(first, last))
        elif hi - lo <= SEGMENT:
            hashes, counts = _segment_words(data[lo:hi], offsets[first : last + 1] - lo)
            yield from np.split(hashes, np.cumsum(counts)[:-1])
        else:  # one long text
            parts = []
            while lo < hi:
                to = min(hi, lo + SEGMENT)
                while to < hi and not (found := np.flatnonzero(_blank(data[lo:to]))).size:
                    to = min(hi, to + SEGMENT)
                if to < hi:
                    to = lo + int(found[-1]) + 1
                parts.append(_segment_words(data[lo:to], np.array([0, to - lo]))[0])
                lo = to
            yield np.concatenate(parts)
        first = last


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not len(words):
        return words
    span = min(width, len(words))
    rolled = words[: len(words) - span + 1].copy()
    for j in range(1, span):
        rolled = rolled * U(0x9FB21C651E98DF25) + words[j : len(words) - span + 1 + j]
    return np.unique(_mix(rolled + U(span)))


def digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


#: A shingle in the prefixes of so many sets, or of one in COMMON_SHARE of them, is common; common ones
#: come last in the order of prefixes.
#: They are kept as bits of a fixed-size table, so a rare one may count as common: order is all that changes.
COMMON, COMMON_SHARE, COMMON_BITS = 32, 100_000, 1 << 24


def prefix_size(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _is_common(items: np.ndarray, common: np.ndarray) -> np.ndarray:
    cell = items & U(COMMON_BITS - 1)
    return (common[(cell >> U(3)).astype(np.int64)] >> (cell & U(7)).astype(np.uint8)) & 1


def prefix_keys(items: np.ndarray, num: int, den: int, common: np.ndarray | None) -> np.ndarray:
    """The first elements in one global order, so many that linked sets share one of them."""
    size = prefix_size(len(items), num, den)
    rank = _mix(items ^ U(0x5851F42D4C957F2D))
    if common is not None:
        rank = (rank >> U(1)) | (_is_common(items, common).astype(U) << U(63))
    return items[np.argpartition(rank, size - 1)[:size]] if size < len(items) else items


def subset_sizes(n: int, num: int, den: int) -> list[int]:
    """Sizes c of the subsets that a light set of n elements posts: one for each size m of the
    smaller set it may link with."""
    return sorted({-(-2 * num * m // (num + den)) for m in range(-(-num * n // den), n + 1)})


def subset_count(n: int, num: int, den: int) -> int:
    return sum(math.comb(n, c) for c in subset_sizes(n, num, den))


def subset_keys(items: np.ndarray, num: int, den: int) -> np.ndarray:
    mixed, out = _mix(items ^ U(0x8EBC6AF09C88C6E3)), []
    for c in subset_sizes(len(items), num, den):
        drop = len(items) - c
        if not drop:
            out.append(_mix(mixed.sum(keepdims=True) + U(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
            continue
        left = np.fromiter((i for combo in itertools.combinations(range(len(items)), drop) for i in combo), dtype=np.int64).reshape(-1, drop)
        out.append(_mix(mixed.sum() - mixed[left].sum(axis=1, dtype=U) + U(c * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)))
    return np.concatenate(out)


LIGHT_LIMIT, SUBSET_LIMIT, SCAN_COST = 40, 3000, 3


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest light size: least total of subsets posted below and list entries scanned above.
    A list entry costs SCAN_COST, for it is also met by others. sizes: sets by size, up to LIGHT_LIMIT."""
    best, cost = (0, 0), 0
    for n in range(1, LIGHT_LIMIT + 1):
        if subset_count(n, num, den) > SUBSET_LIMIT:
            break
        cost += sizes.get(n, 0) * (subset_count(n, num, den) - SCAN_COST * prefix_size(n, num, den))
        best = min(best, (cost, -n))
    return -best[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _batches(frame: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, Iterator[np.ndarray]]]:
    for batch in frame:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = part.column("text").cast(pa.large_string()).fill_null("")
            yield part, (shingle_set(w, width) for w in word_hashes(texts))


def _fresh(frames: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple[bytes, np.ndarray]]]:
    """Digests and sets of batches of texts, without the empty set and what the task has met before."""
    seen: set[bytes] = set()
    for _, sets in _batches(frames, width):
        out = []
        for s in sets:
            if len(s) and (d := digest(s)) not in seen:
                seen.add(d)
                out.append((d, s))
        yield out


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def _identify(width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _batches(frames, width):
            sizes, digests, marks = [], [], []
            for s in sets:
                sizes.append(len(s))
                digests.append(digest(s))
                marks.append(mark(s))
            table = np.array(marks, dtype=np.int64).reshape(-1, WORDS)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes, pa.int64()), *_halves(digests), *[pa.array(table[:, i]) for i in range(WORDS)]], ["doc_id", "n", "sid", "sid2", *MARKS])

    return run


def _heads(width: int, num: int, den: int, light: int):
    """Keys of the lists that sets would be posted to if no shingle were common."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _fresh(frames, width):
            keys = [prefix_keys(s, num, den, None) for _, s in sets if len(s) * den >= num * (light + 1)]
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys))], ["key"])

    return run


#: Tasks over which the lists of common shingles are dealt.
SPREAD = 64


def _post(width: int, num: int, den: int, light: int, common):
    """Keys of the lists of each set, and of lists of common shingles (broadcast bits) the part."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = common.value if common is not None else None
        for sets in _fresh(frames, width):
            keys, parts, owners, times, sizes = [], [], [], [], []
            for d, s in sets:
                n = len(s)
                mine = np.unique(subset_keys(s, num, den)) if n <= light else s[:0]
                heads = prefix_keys(s, num, den, bits) if n * den >= num * (light + 1) else s[:0]
                keys += [mine, heads]
                parts += [np.zeros(len(mine), dtype=np.int32), np.zeros(len(heads), dtype=np.int32) if bits is None else _is_common(heads, bits).astype(np.int32) * (1 + d[0] % SPREAD)]
                owners.append(d)
                times.append(len(mine) + len(heads))
                sizes.append(n)
            if owners:
                ids = np.repeat(np.frombuffer(b"".join(owners), dtype=np.int64).reshape(-1, 2), times, axis=0)
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(sizes, dtype=np.int64), times)), pa.array(ids[:, 0]), pa.array(ids[:, 1])], ["key", "part", "n", "sid", "sid2"])

    return run


#: A set's mark: the parity of its elements in each of 64 * WORDS cells. The cells in which two marks
#: differ are at most the elements by which the sets differ, so far pairs are ruled out exactly.
WORDS = 16


def mark(items: np.ndarray) -> np.ndarray:
    odd = np.bincount((items & U(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_mark(items: np.ndarray) -> bytes:
    """Parities in two to four cells for each element: a thirty-second to a sixteenth of the set's bytes."""
    cells = 1 << (2 * len(items) - 1).bit_length()
    odd = np.bincount((items & U(cells - 1)).astype(np.int64), minlength=max(8, cells)) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _may_link_long(num: int, den: int):
    """Pairs (a, b) whose sizes and long marks allow a link; the longer mark is folded to the shorter one's cells."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            keep = []
            for i, (n, m, x, y) in enumerate(zip(*[batch.column(c) for c in ("n_a", "n_b", "mark_a", "mark_b")], strict=True)):
                n, m = n.as_py(), m.as_py()
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint8) for v in (x, y))
                least = min(len(x), len(y))
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, least)) for v in (x, y))
                if int(np.bitwise_count(x ^ y).sum()) * (den + num) <= (n + m) * (den - num):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _common(texts: DataFrame, heads, least: int) -> np.ndarray | None:
    """Bits of the cells of shingles that stand in at least so many prefixes; two megabytes on the driver."""
    cell = F.col("key").bitwiseAND(F.lit(COMMON_BITS - 1))
    cells = texts.select("text").mapInArrow(heads, "key long").groupBy("key").count().where(F.col("count") >= least).select(cell.alias("cell")).distinct()

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for row in range(batch.num_rows):
                bits = np.zeros(4096, dtype=np.uint8)
                bits[np.asarray(batch.column("low")[row].as_py())] = 1
                yield pa.RecordBatch.from_arrays([batch.column("high").slice(row, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["high", "bits"])

    # at most COMMON_BITS / 4096 rows of 512 bytes
    rows = cells.groupBy(F.shiftright("cell", 12).alias("high")).agg(F.collect_list(F.col("cell").bitwiseAND(F.lit(4095)).cast("int")).alias("low")).mapInArrow(pack, "high long, bits binary").collect()
    if not rows:
        return None
    out = np.zeros(COMMON_BITS // 8, dtype=np.uint8)
    for high, bits in rows:
        out[high * 512 : high * 512 + 512] = np.frombuffer(bits, dtype=np.uint8)
    return out


def _materialise(width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in _fresh(frames, width):
            if sets:
                yield pa.RecordBatch.from_arrays([*_halves([d for d, _ in sets]), pa.array([len(s) for _, s in sets], pa.int64()), pa.array([long_mark(s) for _, s in sets], pa.binary()), pa.array([s.tobytes() for _, s in sets], pa.binary())], ["sid", "sid2", "n", "mark", "items"])

    return run


MARKS = [f"m{i}" for i in range(WORDS)]


def _may_link(x: str, y: str, num: int, den: int):
    """Whether sizes and marks of the rows aliased x and y allow a link."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))) for c in MARKS[1:]), F.bit_count(F.col(f"{x}.m0").bitwiseXOR(F.col(f"{y}.m0"))))
    return (F.least(n, m) * den >= F.greatest(n, m) * num) & (differ * (den + num) <= (n + m) * (den - num))


def _verify(num: int, den: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            keep = []
            left, right = batch.column("items_a"), batch.column("items_b")
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), dtype=U), np.frombuffer(right[i].as_buffer(), dtype=U)
                if min(len(a), len(b)) * den < num * max(len(a), len(b)):
                    continue
                at = np.searchsorted(a, b)
                both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                if den * both >= num * (len(a) + len(b) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


#: Edges that one union-find holds; a task with more begins anew.
FOREST_EDGES = 500_000


def _forest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges (a, b), fewer that connect the same nodes: each node with the least it reaches."""
    up: dict[int, int] = {}
    held = 0

    def top(x: int) -> int:
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def stars() -> pa.RecordBatch:
        pairs = [(x, top(x)) for x in list(up)]
        pairs = [p for p in pairs if p[0] != p[1]]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    for batch in frames:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        held += batch.num_rows
        if held >= FOREST_EDGES:
            yield stars()
            up.clear()
            held = 0
    yield stars()


def _star(e: DataFrame, large: bool) -> DataFrame:
    """One step on edges a > b: every node tells its neighbours (large: the greater ones, with all
    seen; else itself and the smaller ones) of the least node it sees. Aggregates before it shuffles."""
    seen = e.select(F.col("a").alias("v"), F.col("b").alias("w"))
    if large:
        seen = seen.unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("w")))
    least = seen.groupBy("v").agg(F.min("w").alias("m")).withColumn("m", F.least("m", "v"))
    told = seen.join(least, "v")
    if large:
        out = told.where("w > v").select(F.col("w").alias("a"), F.col("m").alias("b"))
    else:
        out = told.select(F.col("w").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node of edges (a, b) is at both ends, or at the first end twice."""
    ends = edges.select(F.col("a").alias("v"), F.lit(2).alias("k")).unionByName(edges.select(F.col("b").alias("v"), F.lit(1).alias("k")).distinct())
    return not ends.groupBy("v").agg(F.sum("k").alias("k")).where("k > 2").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """Labels (cid, comp) of the nodes of edges (a, b): comp is the smallest node reachable. Each round
    thins the edges within tasks of about FOREST_EDGES; while that leaves chains across tasks, a large-star and a
    small-star step follow."""
    now, last = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), None
    while True:
        tasks = -(-now.count() // FOREST_EDGES) or 1
        thin = staged(now.coalesce(tasks).mapInArrow(_forest, "a long, b long"), "edges")
        discard(last)
        if tasks == 1 or _are_stars(thin):
            break
        now = last = staged(_star(_star(thin, True), False), "edges")
        discard(thin)
    return staged(thin.select(F.col("a").alias("cid"), F.col("b").alias("comp")).unionByName(thin.select(F.col("b").alias("cid"), F.col("b").alias("comp")).distinct()), "components")


#: Leaders that a list gets in the second round.
LEADERS = 8


def jaccard_components(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least doc_id of all rows
    reachable by links; for the empty set the row's own doc_id)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(texts.mapInArrow(_identify(width), "doc_id long, n long, sid long, sid2 long, " + ", ".join(f"{m} long" for m in MARKS)), "sets")
    full = rows.where("n > 0")
    classes = full.groupBy("sid", "sid2").agg(F.min("doc_id").alias("owner"), F.first("n").alias("n"), *[F.first(m).alias(m) for m in MARKS])
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    # at most LIGHT_LIMIT + 1 rows
    sizes = {r[0]: r[1] for r in classes.groupBy(F.least("n", F.lit(LIGHT_LIMIT + 1)).alias("n")).count().collect()}
    light = boundary(sizes, num, den)
    found = _common(texts, _heads(width, num, den, light), max(COMMON, sum(sizes.values()) // COMMON_SHARE))
    common = docs.sparkSession.sparkContext.broadcast(found) if found is not None else None

    # lists of one set go at once, and entries that nothing in their list comes near in size: in order of size
    # a neighbour is the nearest; lists of common shingles stay, as their parts are seen apart here
    of_list = W.partitionBy("key", "part")
    by_size = of_list.orderBy("n")
    posted = texts.select("text").mapInArrow(_post(width, num, den, light, common), "key long, part int, n long, sid long, sid2 long")
    fits = (F.lag("n").over(by_size) * den >= F.col("n") * num) | (F.col("n") * den >= F.lead("n").over(by_size) * num)
    posted = posted.withColumn("fits", F.coalesce(fits, F.lit(False)))
    for half in ("sid", "sid2"):
        posted = posted.withColumn(f"{half}_differs", F.min(half).over(of_list) != F.max(half).over(of_list))
    shared = posted.where("part > 0 or (fits and (sid_differs or sid2_differs))").select("key", "sid", "sid2")
    lists = staged(shared.join(classes.select("sid", "sid2", "cid"), ["sid", "sid2"]).select("key", "cid"), "lists")
    marks = classes.select("cid", "n", *MARKS)

    def linked(found: DataFrame) -> DataFrame | None:
        """The links among candidate pairs (a, b); None without candidates."""
        pairs = staged(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        if not pairs.limit(1).count():
            discard(pairs)
            return None
        needed = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct().join(classes.select("cid", "sid", "sid2", "owner"), "cid")
        needed = staged(needed, "needed")
        owned = texts.join(needed.where("owner is not null").select(F.col("owner").alias("doc_id")).distinct(), "doc_id", "left_semi").select("text")
        if needed.where("owner is null").limit(1).count():
            owned = owned.unionByName(texts.where("doc_id is null").select("text"))
        made = staged(owned.mapInArrow(_materialise(width), "sid long, sid2 long, n long, mark binary, items binary"), "made")
        # a set may come more than once, from rows that share an id or from several tasks: one mark is enough
        long = made.select("sid", "sid2", "n", "mark").join(needed.select("cid", "sid", "sid2"), ["sid", "sid2"]).groupBy("cid").agg(F.first("n").alias("n"), F.first("mark").alias("mark"))
        long = staged(long, "marks")
        side = lambda d, s, *cs: d.select(F.col("cid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cs])
        close = pairs.join(side(long, "a", "n", "mark"), "a").join(side(long, "b", "n", "mark"), "b").mapInArrow(_may_link_long(num, den), "a long, b long")
        close = staged(close, "close")
        discard(pairs, long)
        if not close.limit(1).count():
            discard(needed, made, close)
            return None
        left = close.select(F.col("a").alias("cid")).unionByName(close.select(F.col("b").alias("cid"))).distinct().join(needed.select("cid", "sid", "sid2"), "cid")
        left = staged(left, "left")
        # links repeat where a set comes twice, no more
        sets = staged(made.select("sid", "sid2", "items").join(left, ["sid", "sid2"]).select("cid", "items"), "items")
        links = staged(close.join(side(sets, "a", "items"), "a").join(side(sets, "b", "items"), "b").mapInArrow(_verify(num, den), "a long, b long"), "links")
        discard(needed, made, close, left, sets)
        return links

    def together(links: list[DataFrame]) -> DataFrame:
        out = links[0]
        for more in links[1:]:
            out = out.unionByName(more)
        return out

    ends = lists.groupBy("key").agg(F.min("cid").alias("lead"), F.max("cid").alias("other")).where("lead <> other").select("key", "lead")
    led = staged(lists.join(ends, "key"), "led")
    x = led.where("cid <> lead").select("lead", "cid").distinct().join(marks, "cid").alias("x")
    more = linked(x.join(marks.alias("y"), F.col("x.lead") == F.col("y.cid")).where(_may_link("x", "y", num, den)).select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")))
    links, comps = [more] if more else [], components(more) if more else None
    for whole in (False, True):
        named = led.where("cid <> lead")
        named = named.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")) if comps else named.withColumn("comp", F.col("cid"))
        split = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
        entries = staged(named.join(split, "key").select("key", "cid", "comp").distinct().join(marks, "cid"), "open")
        if not entries.limit(1).count():
            break
        x, y = entries.alias("x"), entries.alias("y")
        apart = F.col("x.comp") < F.col("y.comp")
        if not whole:
            chosen = entries.groupBy("key", F.pmod(F.xxhash64("cid"), F.lit(LEADERS)).alias("k")).agg(F.min("cid").alias("cid")).select("key", "cid")
            y, apart = entries.join(chosen, ["key", "cid"]).alias("y"), F.col("x.comp") != F.col("y.comp")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _may_link("x", "y", num, den))
        more = linked(met.select(F.col("x.cid").alias("a"), F.col("y.cid").alias("b")))
        discard(entries)
        if more:
            links.append(more)
            discard(comps)
            comps = components(together(links))
    discard(lists, led, *links)

    label = classes.select("cid", "sid", "sid2", "owner")
    label = label.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid")) if comps else label.withColumn("comp", F.col("cid"))
    names = label.groupBy("comp").agg(F.min("owner").alias("component_id"))
    by_class = staged(label.join(names, "comp").select("sid", "sid2", "component_id"), "names")
    discard(classes, comps)
    some = full.select("doc_id", F.col("n").alias("n_shingles"), "sid", "sid2").join(by_class, ["sid", "sid2"]).select("doc_id", "n_shingles", "component_id")
    return some.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def oracle(width: int, num: int, den: int) -> str:
    """The same in DuckDB's SQL over the table documents, by the definition: all pairs that share a shingle."""
    gram = " || ' ' || ".join(f"w[i + {k}]" for k in range(width))
    return f"""
WITH RECURSIVE
words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {width} + 2), lambda i: {gram})) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE {den} * i >= {num} * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, b FROM reach r JOIN edges ON a = r.other),
smallest AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(other, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest USING (doc_id)
"""
