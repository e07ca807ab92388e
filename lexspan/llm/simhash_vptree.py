"""SimHash near-duplicates found with vantage-point trees.

A text's fingerprint is a fixed string of bits; texts link if their bits differ in few places.
Distinct fingerprints are points, so groups of exact copies are one point before any search.

Search. If two fingerprints differ in at most 3 of 64 bits, one of their two 32-bit words differs
in at most 1. So each word has a tree of its own with radius 1: inner nodes hold a vantage point
and the median Hamming distance to it, and by the triangle inequality a query at distance d has to
look below the median only if d - 1 <= median and above it only if d + 1 > median. The upper
levels deal all points to shards of about ``SHARD_POINTS``: each point lives in one, and visits those
that its radius overlaps. They are fitted on a sample of ``SHARD_SAMPLE`` points a shard, so the depth
grows with the points, up to ``MAX_SHARDS`` shards (2 billion points), which bounds the sample that the
driver sees to 2**20 fingerprints. Inside a shard the tree goes on over all its points down to small
blocks, where pairs are compared exactly. A shard that still holds over ``HOME_POINTS`` or
``VISIT_POINTS`` (a hot region) is cut into a grid of cells by hash, so no task grows with it. A cell
gives the edges of a spanning forest of its links, not all pairs, which keeps every component and is
linear in its points.

Defined results: a null text has no words; texts without words have fingerprint zero and link like
any other; a null id takes part and gets its group's smallest id; rows that repeat an id are texts
of their own; an empty table gives an empty table; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
import operator
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, materialise, words_of
from .components import connected_components
from .word_hash import hash_words, mix, separators

SHARD_POINTS, MAX_SHARDS, SHARD_SAMPLE = 16384, 1 << 17, 8
#: Points that even the smallest tree is fitted on.
LEAST_SAMPLE = 4096
HOME_POINTS, VISIT_POINTS = 65536, 262144
#: Pairs compared at once inside a cell.
BLOCK = 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Bits of a fingerprint: its bytes, the 32-bit words that have trees, their radius, and limits (first byte, end, most differing bits) that links keep."""

    n_bytes: int
    words: int
    radius: int
    limits: tuple[tuple[int, int, int], ...]


#: 64 bits that link at 3 or fewer: one of two words differs in at most 1, so nothing is lost.
EXACT3 = Layout(8, 2, 1, ((0, 8, 3),))


def majority_bits(hashes: np.ndarray) -> bytes:
    """Bits that are set in over half of the rows of an (n, k) uint64 array."""
    cols = hashes.astype("<u8").view(np.uint8).reshape(len(hashes), -1)
    counts = np.stack([np.bincount(cols[:, k], minlength=256) @ _BITS for k in range(cols.shape[1])])
    return np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").tobytes()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words, joined by spaces; of the whole sequence if it is shorter."""
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([digest(joined, 42)], np.uint64)
    starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), (starts[k:] - 1).tolist(), strict=True)), np.uint64, len(words) - k + 1)


def simhash64(text: str | None) -> bytes:
    """64 bits over 3-word shingles, repeats included; zero without words. Most significant byte first."""
    words = words_of(text)
    return majority_bits(shingle_hashes(words, 3)[:, None])[::-1] if words else bytes(8)


def fingerprint(docs: DataFrame, bits_of: Callable[[str | None], bytes] = simhash64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, bits) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bits_of(t.as_py()) for t in batch.column(1)], pa.binary())], names=["id", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, bits binary")


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and medians of the inner nodes, in heap order. Of a few candidates, the vantage point with the widest spread of distances is taken."""
    vantage, median = np.zeros(2**depth, np.uint32), np.full(2**depth, 32, np.int16)

    def fit(node: int, points: np.ndarray) -> None:
        if node >= 2**depth or len(points) < 2:
            return
        tries = points[:: max(1, len(points) // 8)][:8]
        spread = [popcount(points ^ p) for p in tries]
        best = max(range(len(tries)), key=lambda k: float(spread[k].std()))
        vantage[node], median[node] = tries[best], int(np.median(spread[best]))
        low = spread[best] <= median[node]
        fit(2 * node, points[low])
        fit(2 * node + 1, points[~low])

    fit(1, sample)
    return vantage, median


def route(words: np.ndarray, vantage: np.ndarray, median: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, is home) of all shards that the balls around the words overlap."""
    row, node, home = np.arange(len(words)), np.ones(len(words), np.int64), np.ones(len(words), bool)
    for _ in range(len(vantage).bit_length() - 1):
        d, m = popcount(words[row] ^ vantage[node]), median[node]
        low, high = d - radius <= m, d + radius > m
        row, node, home = np.concatenate((row[low], row[high])), np.concatenate((2 * node[low], 2 * node[high] + 1)), np.concatenate((home[low] & (d <= m)[low], home[high] & (d > m)[high]))
    return row, node - len(vantage), home


def close_pairs(homes: np.ndarray, visits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words within the radius, in blocks: the tree goes on inside the cell."""
    todo = [(np.arange(len(homes)), np.arange(len(visits)))]
    while todo:
        h, v = todo.pop()
        if not len(h) or not len(v):
            continue
        split = False
        if len(h) > 256 and len(h) * len(v) > BLOCK // 8:
            tries = [homes[h[i]] for i in (0, len(h) // 3, 2 * len(h) // 3)]
            p = max(tries, key=lambda q: float(popcount(homes[h[:512]] ^ q).std()))
            dh, dv = popcount(homes[h] ^ p), popcount(visits[v] ^ p)
            m = int(np.median(dh))
            low = dh <= m
            if split := bool(low.any() and not low.all()):
                todo += [(h[low], v[dv - radius <= m]), (h[~low], v[dv + radius > m])]
        if not split:
            step = max(1, BLOCK // len(v))
            for k in range(0, len(h), step):
                a, b = np.nonzero(popcount(homes[h[k : k + step], None] ^ visits[None, v]) <= radius)
                if len(a):
                    yield h[k : k + step][a], v[b]


class Forest:
    """Union of index pairs, whole arrays at a time."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.find(a), self.find(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def cell_edges(bits: np.ndarray, home: np.ndarray, word: int, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in a cell, as rows of ``bits`` (n, n_bytes)."""
    points, index = np.unique(np.ascontiguousarray(bits).view(f"S{layout.n_bytes}").ravel(), return_inverse=True)
    words = np.ascontiguousarray(bits[:, 4 * word : 4 * word + 4]).view("<u4").ravel()
    forest, h_rows, v_rows = Forest(len(points)), np.flatnonzero(home), np.flatnonzero(~home)
    for a, b in close_pairs(words[h_rows], words[v_rows], layout.radius):
        ra, rb = h_rows[a], v_rows[b]
        ok = index[ra] != index[rb]
        ra, rb = ra[ok], rb[ok]
        for start, end, most in layout.limits:
            ok = np.zeros(len(ra), bool)
            for k in range(0, len(ra), BLOCK):
                ok[k : k + BLOCK] = np.bitwise_count(bits[ra[k : k + BLOCK], start:end] ^ bits[rb[k : k + BLOCK], start:end]).sum(1, dtype=np.int64) <= most
            ra, rb = ra[ok], rb[ok]
        forest.join(index[ra], index[rb])
    roots = forest.find(np.arange(len(points)))
    rows = np.zeros(len(points), np.int64)
    rows[index] = np.arange(len(index))
    linked = np.flatnonzero(roots != np.arange(len(points)))
    return rows[linked], rows[roots[linked]]


def to_cells(rows: np.ndarray, shards: np.ndarray, key: np.ndarray, is_home: bool, grid: dict[int, tuple[int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, shard, x, y) of the cells that rows go to: cell (0, 0) of a small shard; of a large one, a part of the homes (x) meets each part of the visits (y)."""
    big = np.isin(shards, list(grid)) if grid else np.zeros(len(shards), bool)
    zero = np.zeros(int((~big).sum()), np.int64)
    yield rows[~big], shards[~big], zero, zero
    for shard in np.unique(shards[big]).tolist():
        n_home, n_visit = grid[shard]
        r = rows[shards == shard]
        own = key[r] % (n_home if is_home else n_visit)
        for c in range(n_visit if is_home else n_home):
            other = np.full(len(r), c)
            yield r, np.full(len(r), shard), *((own, other) if is_home else (other, own))


def find_links(points: DataFrame, layout: Layout = EXACT3) -> DataFrame:
    """Edges (a, b) that connect all distinct ``bits`` within the layout's limits as their links do."""
    n = points.count()
    depth = max(0, min(int(math.log2(MAX_SHARDS)), math.ceil(math.log2(max(1, n / SHARD_POINTS)))))
    sample = points.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(max(LEAST_SAMPLE, SHARD_SAMPLE << depth)).toArrow()  # at most SHARD_SAMPLE * MAX_SHARDS rows
    as_words = np.frombuffer(b"".join(sample.column(0).to_pylist()), np.uint8).reshape(-1, layout.n_bytes)
    trees = [fit_tree(np.ascontiguousarray(as_words[:, 4 * k : 4 * k + 4]).view("<u4").ravel(), depth) for k in range(layout.words)]
    n_shards = 2**depth

    def routed(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        bits = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, layout.n_bytes)
        for k, (vantage, median) in enumerate(trees):
            row, shard, home = route(np.ascontiguousarray(bits[:, 4 * k : 4 * k + 4]).view("<u4").ravel(), vantage, median, layout.radius)
            yield bits, row, k * n_shards + shard, home

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((layout.words * n_shards, 2), np.int64)
        for batch in batches:
            for _, _, shard, home in routed(batch):
                total[:, 0] += np.bincount(shard[home], minlength=len(total))
                total[:, 1] += np.bincount(shard, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["shard", "homes", "visits"])

    only = points.select("bits")
    sizes = only.mapInArrow(count, "shard long, homes long, visits long").groupBy("shard").agg(F.sum("homes").alias("h"), F.sum("visits").alias("v")).where((F.col("h") > HOME_POINTS) | (F.col("v") > VISIT_POINTS)).collect()  # at most words * MAX_SHARDS rows
    grid = {r["shard"]: (-(-r["h"] // HOME_POINTS), -(-r["v"] // VISIT_POINTS)) for r in sizes}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bits, row, shard, home in routed(batch):
                key = np.array([xxhash.xxh64_intdigest(b.tobytes()) % (1 << 62) for b in bits]) if grid else np.zeros(len(bits), np.int64)
                for is_home in (True, False):
                    mine = (row[home], shard[home]) if is_home else (row, shard)
                    for r, s, x, y in to_cells(*mine, key, is_home, grid):
                        yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(x), pa.array(y), pa.array(np.full(len(r), is_home)), pa.array([b.tobytes() for b in bits[r]], pa.binary())], names=["shard", "x", "y", "home", "bits"])

    def search(cell: pa.Table) -> pa.Table:
        bits = np.frombuffer(b"".join(cell.column("bits").to_pylist()), np.uint8).reshape(-1, layout.n_bytes)
        home = cell.column("home").to_numpy(zero_copy_only=False)
        a, b = cell_edges(bits, home, cell.column("shard")[0].as_py() // n_shards, layout)
        return pa.table({"a": pa.array([x.tobytes() for x in bits[a]], pa.binary()), "b": pa.array([x.tobytes() for x in bits[b]], pa.binary())})

    cells = only.mapInArrow(deal, "shard long, x long, y long, home boolean, bits binary").groupBy("shard", "x", "y")
    return cells.applyInArrow(search, "a binary, b binary")


def group_components(marked: DataFrame, layout: Layout = EXACT3) -> DataFrame:
    """(id, bits, component_id) for rows (id, bits): component_id is the smallest id reachable over links."""
    marked = materialise(marked, "fingerprints")
    points = materialise(marked.groupBy("bits").agg(F.min("id").alias("min_id")), "points")
    roots = materialise(connected_components(find_links(points, layout)), "roots")
    linked = points.join(roots, points["bits"] == roots["node"]).select("bits", "root", "min_id")
    smallest = linked.groupBy("root").agg(F.min("min_id").alias("component_id"))
    by_bits = linked.join(smallest, "root").select("bits", "component_id")
    final = materialise(points.join(by_bits, "bits", "left").select("bits", F.coalesce("component_id", "min_id").alias("component_id")), "components")
    return marked.join(final, "bits").select("id", "bits", "component_id")  # two plain shuffles: a large group of copies can be split


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits) and component_id: fingerprints over 3-word shingles link at 3 or fewer differing bits."""
    grouped = group_components(fingerprint(docs, simhash64, id_col, text_col))
    return grouped.select(F.col("id").alias(id_col), F.lower(F.hex("bits")).alias("fingerprint"), "component_id")


# Near-duplicates by similarity: SimHash bits over single words and five-word shingles propose links, a prefix join finds the others, and the shingle sets decide.

WORD_BYTES, SHINGLE_BYTES = 24, 40
#: Hash buckets in which the shingles of all texts are counted.
COMMON_BUCKETS = 1 << 18
#: Bits of the sieve that keeps sets nobody asks for out of a shuffle.
SIEVE_BITS = 1 << 20
#: Digests of sets that a task remembers to hand on copies once.
SEEN_DIGESTS = 200_000
FIVE = 5
#: Random orders of points whose first ones are tried on all points with a shared shingle.
HUBS = 8
#: Bits on which a set of shingles is folded; sets at Hamming distance d there differ in at least d shingles.
FOLDED_BITS = 512
_BLANKS = separators(BLANKS)
#: Slack for products that are whole numbers but for rounding.
ROUNDING = 1e-9


def similarity_layout(similarity: float = 0.8) -> Layout:
    """Proposes links at an estimated Jaccard similarity of at least ``similarity`` between sets of five-word shingles.

    Two SimHash bits differ with the chance of the angle over pi, and a Jaccard similarity J of
    equally large sets is a cosine of 2J / (1 + J). Single edits change five shingles but one word,
    so the words' bits lie much closer: the limit on them is 3 deviations above their mean at the
    least similarity, and two such texts share one of the six words within 1 bit in 93 of 100 cases
    at similarity 0.8 and in 99 at 0.9.
    """
    gap = math.acos(2 * similarity / (1 + similarity)) / math.pi
    edited = (1 - similarity) / (1 + similarity) / 5
    word_gap = math.acos(1 - edited) / math.pi
    spread = math.sqrt(8 * WORD_BYTES * word_gap * (1 - word_gap))
    return Layout(WORD_BYTES + SHINGLE_BYTES, WORD_BYTES // 4, 1, ((0, WORD_BYTES, round(8 * WORD_BYTES * word_gap + 3 * spread)), (WORD_BYTES, WORD_BYTES + SHINGLE_BYTES, round(8 * SHINGLE_BYTES * gap))))


def _spread(hashes: np.ndarray, k: int) -> np.ndarray:
    """k independent 64-bit values from each hash."""
    with np.errstate(over="ignore"):
        return mix(hashes[:, None] + np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_and_shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, the set of five-word shingles as hashes in ascending order); of fewer words one shingle holds all."""
    words = hash_words(text.encode("utf-8").lower(), _BLANKS) if text else np.zeros(0, np.uint64)
    n = max(1, len(words) - FIVE + 1) if len(words) else 0
    run = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(FIVE, len(words))):
            run = mix(run * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    return words, np.unique(run)


def set_digest(shingles: np.ndarray) -> bytes:
    return hashlib.md5(shingles.astype("<u8").tobytes()).digest()


def folded(shingles: np.ndarray) -> bytes:
    """FOLDED_BITS bits, each the parity of the number of shingles that fall on it."""
    at = (shingles >> np.uint64(64 - FOLDED_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=FOLDED_BITS).astype(np.uint8) & 1).tobytes()


def commonness(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many shingles of all rows, copies included, fall into each of COMMON_BUCKETS hash buckets. It orders the prefixes and decides nothing."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COMMON_BUCKETS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (words_and_shingles(text.as_py())[1] % COMMON_BUCKETS).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most COMMON_BUCKETS rows
    total = np.zeros(COMMON_BUCKETS, np.int64)
    total[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return total


def near_fingerprints(docs: DataFrame, common: np.ndarray, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, bits, n, prefix, folded) of each row.

    ``digest`` is the MD5 of the text's set of n five-word shingles, ``prefix`` its first
    n - ceil(similarity * n) + 1 shingles, rare ones first. Two sets at ``similarity`` or more share at
    least one shingle of their prefixes, whatever the common order is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def of(text: str | None) -> tuple[bytes, bytes, int, bytes, np.ndarray]:
        words, fives = words_and_shingles(text)
        n = len(fives)
        if not n:
            return set_digest(fives), bytes(WORD_BYTES + SHINGLE_BYTES), 0, b"", np.zeros(FOLDED_BITS // 64, np.int64)
        bits = majority_bits(_spread(np.unique(words), WORD_BYTES // 8)) + majority_bits(_spread(fives, SHINGLE_BYTES // 8))
        order = np.lexsort((fives, shared.value[(fives % COMMON_BUCKETS).astype(np.int64)]))
        return set_digest(fives), bits, n, fives[order[: n - math.ceil(similarity * n - ROUNDING) + 1]].astype("<u8").tobytes(), np.frombuffer(folded(fives), "<i8")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        for batch in batches:
            columns = zip(*(of(t.as_py()) for t in batch.column(1)), strict=True) if len(batch) else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "digest", "bits", "n", "prefix", "folded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, digest binary, bits binary, n long, prefix binary, folded array<long>")


def sieve(digests: DataFrame) -> np.ndarray:
    """SIEVE_BITS bits, of which those at the CRC-32 of a wanted digest are set; at most SIEVE_BITS / 64 rows come to the driver, whatever the input."""
    place = F.crc32("digest") % SIEVE_BITS
    words = digests.groupBy(F.floor(place / 64).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(crc32(digest) % {SIEVE_BITS} % 64))")).alias("word")).toArrow()
    out = np.zeros(SIEVE_BITS // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out.view(np.uint64)


def shingle_sets(docs: DataFrame, text_col: str, points: DataFrame, asked: DataFrame) -> DataFrame:
    """(point, shingles) of the ``asked`` points, found again from the texts.

    The sieve lets through the texts that are asked for and few others, so that not all sets are
    shuffled; a task hands on one of its copies. The joins then are exact.
    """
    wanted = points.select("point", "digest").join(asked, "point", "left_semi")
    shared = docs.sparkSession.sparkContext.broadcast(sieve(wanted))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, set()
        for batch in batches:
            found = []
            for text in batch.column(0):
                fives = words_and_shingles(text.as_py())[1]
                digest = set_digest(fives)
                at = zlib.crc32(digest) % SIEVE_BITS
                if int(bits[at >> 6]) >> (at & 63) & 1 and digest not in seen:
                    found.append((digest, fives.astype("<u8").tobytes()))
                    if len(seen) < SEEN_DIGESTS:
                        seen.add(digest)
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.binary()), pa.array([s for _, s in found], pa.binary())], names=["digest", "shingles"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(work, "digest binary, shingles binary")
    return materialise(found.groupBy("digest").agg(F.first("shingles").alias("shingles")).join(wanted, "digest").select("point", "shingles"), "shingle_sets")


def verified(pairs: DataFrame, docs: DataFrame, text_col: str, points: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) of points whose sets have a Jaccard similarity of at least ``similarity``, exactly."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                ok.append(both >= similarity * ((len(x) + len(y)) // 8 - both) - ROUNDING)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    sets = shingle_sets(docs, text_col, points, pairs.select(F.explode(F.array("a", "b")).alias("point")).distinct())
    of = lambda c: sets.select(F.col("point").alias(c), F.col("shingles").alias(f"{c}_set"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(work, "a long, b long")


def prefix_rows(labelled: DataFrame) -> DataFrame:
    """(h, point, small, root, n, pos): a row for each prefix shingle of the points (point, small, root, n, prefix)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                first = [np.frombuffer(s.as_py(), "<i8") for s in part.column(4)]
                kept = np.array([len(h) for h in first], np.int64)
                at = pa.array(np.repeat(np.arange(len(part)), kept))
                pos = np.arange(kept.sum()) - np.repeat(np.cumsum(kept) - kept, kept)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), *[part.column(c).take(at) for c in range(4)], pa.array(pos)], names=["h", "point", "small", "root", "n", "pos"])

    return labelled.select("point", "small", "root", "n", "prefix").mapInArrow(work, "h long, point long, small long, root long, n long, pos long")


def shared_rows(rows: DataFrame) -> DataFrame:
    """The ``prefix_rows`` whose shingle more than one group has, with the least group and its least point: most shingles are of one group only."""
    group, by_hash = F.struct("small", "root"), Window.partitionBy("h")
    first = F.min(F.struct("small", "root", "point")).over(by_hash)
    return rows.withColumns({"first": first, "most": F.max(group).over(by_hash)}).where(F.struct("first.small", "first.root") != F.col("most")).drop("most")


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each point with a few of other groups, enough to join a large group that the trees left in pieces; at most HUBS + 1 rows a point.

    A shingle's hubs are the point in whose prefix it stands foremost, which has the fewest rare shingles and so lies
    amid texts that are almost alike, and the first points in each of HUBS random orders. Of each kind a point takes
    the hub that most of its shingles name. One hub alone may lie aside, and a text alike to the share p of the others
    misses all with chance (1 - p)**HUBS: what is left to ``missing_pairs`` are few pairs, wherever the groups begin.
    """
    orders = [F.struct("pos", F.xxhash64("point").alias("tie"), "root", "point"), *(F.struct(F.xxhash64("point", F.lit(k)).alias("tie"), "root", "point") for k in range(HUBS))]
    hubs = shared.groupBy("h").agg(*[F.min(o).alias(f"hub{k}") for k, o in enumerate(orders)])
    named = [F.mode(F.when(F.col(f"hub{k}.root") != F.col("root"), F.col(f"hub{k}.point"))) for k in range(len(orders))]
    chosen = shared.select("h", "point", "root").join(hubs, "h").groupBy(F.col("point").alias("a")).agg(F.array_distinct(F.array(*named)).alias("hubs"))
    return chosen.select("a", F.explode("hubs").alias("b")).where("b is not null")


def least_shared(similarity: float) -> Column:
    """How many shingles sets of the sizes l_n and r_n share at least if they are ``similarity`` alike."""
    return F.ceil(similarity / (1 + similarity) * (F.col("l_n") + F.col("r_n")) - ROUNDING)


def can_be_alike(similarity: float) -> Column:
    """Whether sets of sizes l_n and r_n, folded as l_folded and r_folded, can be ``similarity`` alike; true for all that are."""
    sizes = F.least("l_n", "r_n") >= similarity * F.greatest("l_n", "r_n") - ROUNDING
    apart = reduce(operator.add, (F.bit_count(F.col("l_folded")[i].bitwiseXOR(F.col("r_folded")[i])) for i in range(FOLDED_BITS // 64)))
    return sizes & (apart <= F.col("l_n") + F.col("r_n") - 2 * least_shared(similarity))


def possible(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that sizes and folded sets, from ``sketches`` (point, n, folded), do not rule out: only these need their whole sets."""
    of = lambda end, side: sketches.select(F.col("point").alias(end), F.col("n").alias(f"{side}_n"), F.col("folded").alias(f"{side}_folded"))
    return pairs.join(of("a", "l"), "a").join(of("b", "r"), "b").where(can_be_alike(similarity)).select("a", "b")


def missing_pairs(shared: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of all points of different groups that can be ``similarity`` alike, from their ``shared_rows`` with ``folded``.

    The largest group of a shingle (least ``small``) is never joined with itself. Sets of sizes m and n
    that are alike share some A shingles at least; so, in any one order, their first m - A + 1 and
    n - A + 1 share one, and no more than m + n - 2 A shingles are in one set only. Where the folded sets
    already differ at more places, the pair is never made: what keeps a large group of texts that are
    almost alike from joining each with each.
    """
    shared = materialise(shared.select("h", "point", F.struct("small", "root").alias("of"), F.struct("first.small", "first.root").alias("least"), "n", "pos", "folded"), "to_join")
    left = shared.where("of != least").select("h", *[F.col(c).alias(f"l_{c}") for c in ("point", "of", "n", "pos", "folded")])
    right = shared.select("h", *[F.col(c).alias(f"r_{c}") for c in ("point", "of", "n", "pos", "folded")])
    early = lambda side: F.col(f"{side}_pos") <= F.col(f"{side}_n") - least_shared(similarity)
    met = left.join(right, "h").where((F.col("r_of") < F.col("l_of")) & early("l") & early("r") & can_be_alike(similarity))
    return met.select(F.col("l_point").alias("a"), F.col("r_point").alias("b")).distinct()


def with_groups(rows: DataFrame, points: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` of points with root and small, less the size of the group, from (node, root)."""
    sizes = roots.groupBy("root").agg((-F.count("*")).alias("small"))
    labels = points.select("point").join(roots.join(sizes, "root").select(F.col("node").alias("point"), "small", "root"), "point", "left")
    labels = labels.select("point", F.coalesce("small", F.lit(-1)).alias("small"), F.coalesce("root", "point").alias("root"))
    return rows.drop("small", "root").join(materialise(labels, "labels"), "point")


def near_duplicates(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): groups of texts linked by a Jaccard similarity of their five-word shingle sets of ``similarity`` or more, exactly.

    A point is a distinct set. The trees propose links, which are checked on the sets; they leave
    few groups to join, also where thousands of texts are alike. Stars around several hubs of the shared rare
    shingles, checked too, join what they left in pieces. Then a prefix join finds every pair of points in different
    groups that can still reach the similarity, and the sets decide again: nothing is lost, whatever
    the trees find.
    """
    marked = materialise(near_fingerprints(docs, commonness(docs, text_col), similarity, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    points = materialise(marked.groupBy("digest").agg(F.min("row").alias("point"), F.min("id").alias("min_id"), F.first("bits").alias("bits")), "points")
    by_bits = materialise(points.groupBy("bits").agg(F.min("point").alias("first")), "points_by_bits")
    end = lambda c: by_bits.select(F.col("bits").alias(f"{c}_bits"), F.col("first").alias(c))
    found = find_links(by_bits, similarity_layout(similarity)).select(F.col("a").alias("a_bits"), F.col("b").alias("b_bits"))
    sketches = marked.select(F.col("row").alias("point"), "n", "folded")
    proposed = found.join(end("a"), "a_bits").join(end("b"), "b_bits").select("a", "b").union(points.join(by_bits, "bits").where("point != first").select(F.col("first").alias("a"), F.col("point").alias("b")))
    groups = materialise(connected_components(verified(materialise(possible(proposed.distinct(), sketches, similarity), "proposed"), docs, text_col, points, similarity)), "groups")
    shared = materialise(shared_rows(prefix_rows(with_groups(marked.select(F.col("row").alias("point"), "n", "prefix"), points, groups))), "shared_shingles")
    as_links = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    stars = verified(materialise(possible(star_pairs(shared), sketches, similarity), "star_pairs"), docs, text_col, points, similarity)
    groups = materialise(connected_components(stars.union(as_links(groups))), "groups")
    again = shared_rows(with_groups(shared.drop("first"), points, groups)).join(sketches.select("point", "folded"), "point")
    rest = materialise(missing_pairs(again, similarity), "missing_pairs")
    links = verified(rest, docs, text_col, points, similarity).union(as_links(groups))
    roots = materialise(connected_components(links), "roots").withColumnRenamed("node", "point")
    named = materialise(points.join(roots, "point", "left").select("digest", "min_id", F.coalesce("root", "point").alias("root")), "named")
    final = materialise(named.join(named.groupBy("root").agg(F.min("min_id").alias("component_id")), "root").select("digest", "component_id"), "components")
    return marked.select("id", "digest").join(final, "digest").select(F.col("id").alias(id_col), "component_id")
