"""Nearest neighbours by inner product over balanced posting lists.

Equal vectors are one point, so a vector that a third of all rows repeat is posted once. Points are laid
out by Euclidean distance: those whose norms lie within a factor of two make a shell, are divided by the
shell's largest norm and get one more coordinate that completes them to length 1; for a query of length
1 with 0 there, the nearest point then has the largest inner product.

Each shell has about the square root of its points as posting lists (at most ``max_lists`` in all). Their
centroids are fitted on a bounded sample, cut in halves of equal size and then moved by rounds that make
crowded lists costlier. Tasks hold the centroids and a graph that links each to its nearest ones, and walk
that graph. A point is posted in its nearest list and, near a boundary, in up to ``replicas`` lists whose
centroid is at most ``boundary`` farther. A query reads the lists whose centroid is at most ``reach``
farther than its nearest one, in every shell; where they hold fewer than ``least`` times k + 1 points, it
reaches farther until they do, up to all lists of the shell. Every point is posted and every posting of a
list that is read is compared.

A list with more postings or readers than a task should hold is cut into a grid of cells by hash; each
part of the postings meets each part of the readers.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, empty
ones are zero; shorter vectors are filled up with zeros; rows that repeat an id are rows of their own, each
a candidate of the others; a null id asks only if ``asks`` holds for it and comes last among ties; equal
scores and ids are ordered by row; with fewer than k candidates all are returned; an empty table gives an
empty table; other columns are dropped. On vectors without clusters the centroids are nearly equally far,
so a query reads a constant share of the lists.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


@dataclass(frozen=True)
class Settings:
    replicas: int = 4
    boundary: float = 0.03
    reach: float = 0.17
    least: int = 16
    max_lists: int = 16384
    #: Sampled points a list, and the most values (points times dimensions) that the driver fits on.
    sample: int = 32
    sample_values: int = 1 << 24
    #: Values of the postings, and of the readers, that one task compares.
    cell_values: int = 1 << 21
    degree: int = 16


#: Lists among which the walk starts, and how much farther than the nearest found a centroid may be for the walk to go on from it.
ENTRIES, WALK = 64, 0.25
#: A reach beyond which all lists are read.
FARTHEST = 16.0
#: Values of a block of scores or of distances.
BLOCK = 1 << 21
ROUNDS = 6


def distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``points`` to all of ``others``."""
    square = (points * points).sum(1)[:, None] + (others * others).sum(1)[None] - 2 * points @ others.T
    return np.sqrt(np.maximum(square, 0))


def halved(points: np.ndarray, k: int) -> np.ndarray:
    """Means of k parts of almost equal size: the largest part is cut at the median between two means, again and again."""
    parts = [np.arange(len(points))]
    while len(parts) < k:
        at = max(range(len(parts)), key=lambda i: len(parts[i]))
        part = parts.pop(at)
        own = points[part]
        a, b = own[0], own[len(own) // 2]
        for _ in range(4):
            order = np.argsort(own @ (b - a), kind="stable")
            low, high = order[: len(order) // 2], order[len(order) // 2 :]
            a, b = own[low].mean(0), own[high].mean(0)
        parts += [part[low], part[high]]
    return np.stack([points[p].mean(0) for p in parts])


def balanced_centroids(points: np.ndarray, k: int) -> np.ndarray:
    """k centroids: halves first, then rounds in which a part that holds more than its share is farther away by as much."""
    k = max(1, min(k, len(points)))
    if k > 256:  # a tree of parts: a round costs points times parts
        tops = balanced_centroids(points, 64)
        part = np.concatenate([distances(points[i : i + 4096], tops).argmin(1) for i in range(0, len(points), 4096)])
        sizes = np.bincount(part, minlength=len(tops))
        shares = np.maximum(1, np.round(k * sizes / len(points)).astype(int))
        return np.concatenate([balanced_centroids(points[part == i], int(shares[i])) for i in range(len(tops)) if sizes[i]])
    centroids = halved(points, k)
    size = np.full(k, len(points) / k)
    for _ in range(ROUNDS if k > 1 else 0):
        cost = 0.1 * (size * k / len(points) - 1)
        nearest = np.concatenate([(distances(points[i : i + 4096], centroids) ** 2 + cost).argmin(1) for i in range(0, len(points), 4096)])
        count = np.bincount(nearest, minlength=k)
        size = (size + count) / 2
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids).astype(points.dtype)
    return centroids


class Centroids:
    """The centroids of a shell and the graph by which tasks find those near a point."""

    def __init__(self, centroids: np.ndarray, degree: int) -> None:
        self.centroids, n = centroids, len(centroids)
        links = [np.argsort(distances(centroids[i : i + 512], centroids), axis=1, kind="stable")[:, 1 : degree + 1] for i in range(0, n, 512)]
        ring = (np.arange(n)[:, None] + [-1, 1]) % n  # neighbours in the order of the cuts: every centroid can be reached
        self.links = np.concatenate([np.concatenate(links), ring], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(int))

    def near(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, distance) of the centroids at most ``reach`` farther than the nearest one, nearest first by row."""
        step = max(1, BLOCK // len(self.centroids))
        parts = [self._walk(points[i : i + step], reach, i) for i in range(0, len(points), step)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True))

    def _walk(self, points: np.ndarray, reach: float, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, k = len(points), len(self.centroids)
        own, theirs = (points * points).sum(1), (self.centroids * self.centroids).sum(1)
        seen = np.zeros((n, k), bool)
        row, node = np.repeat(np.arange(n), len(self.entries)), np.tile(self.entries, n)
        best, found = np.full(n, np.inf), []
        while len(row):
            seen[row, node] = True
            d = np.sqrt(np.maximum(own[row] + theirs[node] - 2 * np.einsum("ij,ij->i", points[row], self.centroids[node]), 0))
            np.minimum.at(best, row, d)
            found.append((row, node, d))
            on = d <= (1 + max(reach, WALK)) * best[row]
            row, node = np.repeat(row[on], self.links.shape[1]), self.links[node[on]].ravel()
            new = ~seen[row, node]
            at = np.unique(row[new] * k + node[new])
            row, node = at // k, at % k
        row, node, d = (np.concatenate(c) for c in zip(*found, strict=True))
        close = d <= (1 + reach) * best[row]
        row, node, d = row[close], node[close], d[close]
        order = np.lexsort((node, d, row))
        return row[order] + offset, node[order], d[order]


def places(row: np.ndarray) -> np.ndarray:
    """The number of each element among those of its row, for rows in order."""
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, summed from the first component on: equal vectors have equal scores."""
    total = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T), strict=True):
            total += x * y
    return total


def best_of_cell(points: np.ndarray, readers: np.ndarray, ids: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(reader, point, score) of the k best points of each reader; ties by ``ids``, which sort."""
    place = np.empty(len(ids), np.int64)
    place[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))
    longest = np.sqrt((points * points).sum(1).max())
    out = []
    step = max(1, BLOCK // len(points))
    for i in range(0, len(readers), step):
        asked = readers[i : i + step]
        with np.errstate(all="ignore"):
            scores = asked @ points.T
            scores[np.isnan(scores)] = -np.inf
            slack = 4 * points.shape[1] * np.finfo(float).eps * np.sqrt((asked * asked).sum(1)) * longest
            least = np.partition(scores, len(points) - k, axis=1)[:, len(points) - k] if len(points) > k else np.full(len(asked), -np.inf)
            row, col = np.nonzero(scores >= np.where(np.isfinite(least), least - slack, least)[:, None])
        exact = inner(asked[row], points[col])
        order = np.lexsort((place[col], -exact, row))
        row, col, exact = row[order], col[order], exact[order]
        kept = places(row) < k
        out.append((row[kept] + i, col[kept], exact[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _clean(rows: DataFrame, dim: int, kind: str) -> DataFrame:
    """(row, id, asks, digest, shell, norm, vec) of the rows (row, id, asks, vec) that take part; ``vec`` as bytes of ``kind``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind) + 0.0  # nulls are NaN, no negative zeros
            at = np.repeat(np.arange(len(batch)), sizes)
            good = (np.bincount(at[~np.isfinite(flat)], minlength=len(batch)) == 0) & (np.bincount(at[flat != 0], minlength=len(batch)) > 0)
            full = np.zeros((len(batch), dim), kind)
            full[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            full, chosen = full[good], np.flatnonzero(good)
            top = np.abs(full).max(1).astype(float) if len(full) else np.zeros(0)
            norm = top * np.sqrt(((full / top[:, None].astype(float)) ** 2).sum(1))
            vec = [x.tobytes() for x in full]
            shell = np.floor(np.log2(norm) + 0.5).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(chosen)) for c in range(3)], pa.array([hashlib.md5(v).digest() for v in vec], pa.binary()), pa.array(shell), pa.array(norm, pa.float64()), pa.array(vec, pa.binary())], names=["row", "id", "asks", "digest", "shell", "norm", "vec"])

    id_kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(work, f"row long, id {id_kind}, asks boolean, digest binary, shell int, norm double, vec binary")


def nearest(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, id, score): for each row for which ``asks`` holds, the k found with the largest inner product among all other rows."""
    spark, s = vectors.sparkSession, settings
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    vec = F.col(vec_col) if element == "float" else F.col(vec_col).cast("array<double>")
    chosen = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), vec.alias("vec"))
    dim = max(1, chosen.agg(F.max(F.size("vec"))).first()[0] or 1)
    rows = materialise(_clean(chosen, dim, kind), "rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    points = materialise(rows.groupBy("digest").agg(F.min(order).alias("least"), F.max("asks").alias("asks"), F.first("shell").alias("shell"), F.first("vec").alias("vec"), F.max("norm").alias("norm")), "points")
    found = points.groupBy("shell").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).orderBy("shell").collect()  # a row for each power of two
    id_kind = rows.schema["id"].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"query_id {id_kind}, rank int, {id_col} {id_kind}, score double")
    total = sum(r["n"] for r in found)
    budget = min(s.max_lists, max(1, s.sample_values // (s.sample * (dim + 1))))
    lists = {r["shell"]: max(1, min(round(math.sqrt(r["n"])), budget * r["n"] // total)) for r in found}
    longest = {r["shell"]: r["longest"] for r in found}

    def matrix(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(float)

    def laid_out(x: np.ndarray, shell: int) -> np.ndarray:
        x = x / longest[shell]
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], axis=1).astype(np.float32)

    rate = F.create_map(*[F.lit(v) for r in found for v in (r["shell"], min(1.0, max(s.sample * lists[r["shell"]], 1024) / r["n"]))])
    drawn = points.where(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("double") < rate[F.col("shell")] * float(1 << 48)).select("shell", "vec").toArrow()  # about sample_values values, whatever the input
    index: dict[int, tuple[int, Centroids]] = {}
    first = 0
    for shell, n in lists.items():
        own = drawn.filter(pc.equal(drawn.column("shell"), shell)).column("vec")
        sample = laid_out(matrix(own), shell) if len(own) else np.zeros((1, dim + 1), np.float32)
        index[shell] = first, Centroids(balanced_centroids(sample, n), s.degree)
        first += len(index[shell][1].centroids)
    held = spark.sparkContext.broadcast(index)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shells, x = batch.column(2).to_numpy(), matrix(batch.column(3))
            for shell in np.unique(shells).tolist():
                start, centroids = held.value[shell]
                at = np.flatnonzero(shells == shell)
                row, node, _ = centroids.near(laid_out(x[at], shell), s.boundary)
                place = places(row)
                kept = place < s.replicas
                out = pa.array(at[row[kept]])
                yield pa.RecordBatch.from_arrays([pa.array(start + node[kept], pa.int32()), pa.array(place[kept] == 0), *[batch.column(c).take(out) for c in (0, 1, 3)]], names=["list", "home", "digest", "least", "vec"])

    least_kind = points.schema["least"].dataType.simpleString()
    postings = materialise(points.select("digest", "least", "shell", "vec").mapInArrow(post, f"list int, home boolean, digest binary, least {least_kind}, vec binary"), "postings")
    sizes = postings.groupBy("list").agg(F.count("*").alias("postings"), F.sum(F.col("home").cast("long")).alias("homes")).toArrow()  # at most max_lists rows
    homes = np.zeros(first, np.int64)
    homes[sizes.column("list").to_numpy()] = sizes.column("homes").to_numpy()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            top = np.abs(x).max(1)[:, None]
            unit = x / top
            unit = np.concatenate([unit / np.sqrt((unit * unit).sum(1))[:, None], np.zeros((len(x), 1))], axis=1).astype(np.float32)
            found = []
            for start, centroids in held.value.values():
                own = homes[start : start + len(centroids.centroids)]
                enough, todo, reach = min(int(own.sum()), s.least * (k + 1)), np.arange(len(x)), s.reach
                while len(todo):
                    far = reach > FARTHEST
                    r, c = (np.repeat(np.arange(len(todo)), len(own)), np.tile(np.arange(len(own)), len(todo))) if far else centroids.near(unit[todo], reach)[:2]
                    full = np.bincount(r, weights=own[c], minlength=len(todo)) >= enough
                    found.append((todo[r[full[r]]], start + c[full[r]]))
                    todo, reach = todo[~full], 2 * reach
            row, node = (np.concatenate(c) for c in zip(*found, strict=True))
            for i in range(0, len(row), 1 << 16):  # bounded batches: a query stands in many lists
                out = pa.array(row[i : i + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)], pa.int32()), *[batch.column(c).take(out) for c in range(2)]], names=["list", "digest", "vec"])

    visits = materialise(points.where("asks").select("digest", "vec").mapInArrow(visit, "list int, digest binary, vec binary"), "visits")
    cell = max(64, s.cell_values // dim)
    parts = lambda n: F.ceil(F.col(n) / cell).cast("int")
    readers = visits.groupBy("list").agg(F.count("*").alias("readers"))
    grid = F.broadcast(readers.join(postings.groupBy("list").agg(F.count("*").alias("postings")), "list").select("list", parts("postings").alias("xs"), parts("readers").alias("ys")))  # at most max_lists rows of three numbers
    own = lambda n: F.pmod(F.xxhash64("digest"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = postings.join(grid, "list").select("list", own("xs").alias("x"), every("ys").alias("y"), F.lit(False).alias("asks"), "digest", "least", "vec")
    asked = visits.join(grid, "list").select("list", every("xs").alias("x"), own("ys").alias("y"), F.lit(True).alias("asks"), "digest", F.lit(None).cast(least_kind).alias("least"), "vec")

    def search(cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy(zero_copy_only=False)
        points, readers = cell.filter(pa.array(~asks)), cell.filter(pa.array(asks))
        least = points.column("least").combine_chunks()
        if not len(points) or not len(readers):
            return pa.table({"query": pa.array([], pa.binary()), "digest": pa.array([], pa.binary()), "least": least[:0], "score": pa.array([], pa.float64())})
        keys = [(x["none"], () if x["none"] else (x["id"],), x["row"]) for x in least.to_pylist()]
        row, col, score = best_of_cell(matrix(points.column("vec")), matrix(readers.column("vec")), keys, k + 1)
        return pa.table({"query": readers.column("digest").take(pa.array(row)), "digest": points.column("digest").take(pa.array(col)), "least": least.take(pa.array(col)), "score": pa.array(score)})

    hits = dealt.unionByName(asked).groupBy("list", "x", "y").applyInArrow(search, f"query binary, digest binary, least {least_kind}, score double")
    # A point may come from several lists, with one score; of equal vectors only the k + 1 smallest ids can be among a query's k best.
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "least")
    best = materialise(hits.withColumn("at", F.dense_rank().over(by_query)).where(F.col("at") <= k + 1).dropDuplicates(["query", "digest"]).select("query", "digest", "score"), "hits")
    salt = F.pmod(F.xxhash64("row"), F.lit(64))
    copies = rows.select("digest", "id", "row", order.alias("o"), salt.alias("salt"))
    for by in (("digest", "salt"), ("digest",)):  # in two steps, so that a vector with very many rows is not one task's
        copies = copies.withColumn("at", F.row_number().over(Window.partitionBy(*by).orderBy("o"))).where(F.col("at") <= k + 1)
    ids = copies.select("digest", "id", "row", "o")
    cut = Window.partitionBy("query").orderBy(F.desc("score"), "o")
    listed = best.join(ids, "digest").withColumn("at", F.row_number().over(cut)).where(F.col("at") <= k + 1).select(F.col("query").alias("digest"), "id", "row", "o", "score")
    queries = rows.where("asks").select("digest", F.col("id").alias("query_id"), F.col("row").alias("query_row"))
    ranked = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "o"))
    result = queries.join(listed, "digest").where("row != query_row").withColumn("rank", ranked).where(F.col("rank") <= k)
    return result.select("query_id", "rank", F.col("id").alias(id_col), "score")
