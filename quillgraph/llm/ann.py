"""Approximate nearest neighbours with balanced posting lists.

Centroids come from hierarchical balanced clustering of a bounded sample (at most SAMPLE distinct vectors). They are held in
memory with a graph of near and some far links, which a beam search walks for many vectors at once. Every vector goes to
the posting list of its nearest centroid and, at a boundary, also to those of other centroids nearly as near (ratio CLOSURE, at
most REPLICAS lists). A query reads the lists whose centroids are within a ratio of its nearest centroid's distance, up to a number.
No number is right for every table: it is taken from CALIBRATE of the queries, which are compared with all vectors, as the least
that finds TARGET of their neighbours (FLOOR_PROBES at least). Where the ratio keeps them from that, it is not used.

Lists are balanced by the clustering; one that many vectors share all the same (copies of a vector) is cut into chunks, and
where very many queries read a list they are cut into blocks. Each (list, chunk, block) gives its best for each query, so what
meets for a query is bounded. Only centroids, graph and list sizes (at most MOST_LISTS) are broadcast.

Distances are of the original vectors in double precision. Rows take no part if their id or vector is null, their vector is zero, has null or
non-finite components or another dimension than most vectors. An id counts once for a query, by its nearest row; rows with the query's own
id are not candidates. Ties go to smaller ids. Queries that find fewer neighbours than there are candidates look in all lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize

SAMPLE, MOST_LISTS = 131_072, 8192
REPLICAS, CLOSURE = 4, 1.1
LEAST_PROBES, FLOOR_PROBES, RATIO = 16, 64, 1.4
CALIBRATE, TARGET = 256, 0.97
CHUNK, QUERY_BLOCK = 4096, 2048
NEAR_LINKS, FAR_LINKS, ENTRIES = 16, 8, 32


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_centroids(points: np.ndarray, lists: int, rng: np.random.Generator, ways: int = 16, rounds: int = 8) -> list[np.ndarray]:
    """Centroids of about ``lists`` clusters of like sizes, by splitting clusters ``ways`` ways at most."""
    if lists <= 1 or len(points) <= 1:
        return [points.mean(axis=0)] if len(points) else []
    k = min(ways, lists, len(points))
    centres = points[rng.choice(len(points), k, replace=False)]
    sizes = np.full(k, len(points) / k)
    for _ in range(rounds):
        cost = squared(points, centres)
        scale = cost.min(axis=1).mean()
        group = (cost + scale * (sizes * k / len(points) - 1)[None, :]).argmin(axis=1)
        found = np.bincount(group, minlength=k)
        sizes = 0.5 * sizes + 0.5 * found
        for c in np.flatnonzero(found):
            centres[c] = points[group == c].mean(axis=0)
    out = []
    for c in np.flatnonzero(found):
        members = points[group == c]
        if len(members) == len(points):
            return [points.mean(axis=0)]
        out += balanced_centroids(members, max(1, round(lists * len(members) / len(points))), rng, ways, rounds)
    return out


@dataclass
class Centroids:
    """Centroids and the graph over them."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray, rng: np.random.Generator) -> Centroids:
        n = len(points)
        near = min(NEAR_LINKS, n - 1)
        links = np.zeros((n, near), "i4")
        for at in range(0, n, 1024):
            d = squared(points[at : at + 1024], points)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            links[at : at + 1024] = np.argpartition(d, near - 1, axis=1)[:, :near] if near else 0
        far = rng.integers(0, n, (n, FAR_LINKS), dtype="i4")
        return cls(points, np.concatenate([links, far], axis=1), rng.choice(n, min(ENTRIES, n), replace=False))

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, distances) of the nearest that a beam search finds for each vector, nearest first; -1 and infinity fill up."""
        m, width = len(vectors), min(beam, len(self.points))
        rows = np.arange(m)[:, None]

        def distance(ids: np.ndarray) -> np.ndarray:
            diff = self.points[ids] - vectors[:, None, :]
            return np.einsum("ijk,ijk->ij", diff, diff)

        seen = np.zeros((m, len(self.points)), bool)
        ids = np.broadcast_to(self.entries, (m, len(self.entries)))
        seen[rows, ids] = True
        d = distance(ids)
        open_ = np.ones_like(d, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            ids, d, open_ = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(open_, order, 1)
            waiting = open_ & np.isfinite(d)
            if not waiting.any():
                return np.where(np.isfinite(d), ids, -1), np.sqrt(d)
            # The four nearest that are not expanded yet.
            pick = np.argsort(np.where(waiting, np.arange(d.shape[1])[None, :], d.shape[1] + 1), axis=1, kind="stable")[:, :4]
            valid = np.take_along_axis(waiting, pick, 1)
            open_[rows, pick] = False
            linked = np.where(valid[:, :, None], self.graph[np.take_along_axis(ids, pick, 1)], self.entries[0]).reshape(m, -1)
            fresh = ~seen[rows, linked]
            # A link may come twice among those of the same step: keep its first.
            by = np.argsort(linked, axis=1, kind="stable")
            ordered = np.take_along_axis(linked, by, 1)
            again = np.zeros_like(fresh)
            np.put_along_axis(again, by, np.concatenate([np.zeros((m, 1), bool), ordered[:, 1:] == ordered[:, :-1]], axis=1), 1)
            fresh &= ~again
            seen[rows, linked] = True
            more = np.where(fresh, distance(linked), np.inf)
            ids, d, open_ = np.concatenate([ids, linked], 1), np.concatenate([d, more], 1), np.concatenate([open_, fresh], 1)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def prepare(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part; v as array<double>."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (most[0]["n"] if most else 0))


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit_centroids(vectors: DataFrame, n: int, seed: int = 7) -> Centroids:
    """Centroids for ``n`` vectors, from a sample of at most SAMPLE of them (smallest hashes)."""
    lists = max(1, min(MOST_LISTS, int(2 * n**0.5))) if n > 512 else 1
    most = min(SAMPLE, 64 * lists)
    h = F.xxhash64("v")
    sample = vectors.select("v")
    if n > most:
        sample = sample.where(h < F.lit(min(int(1.5 * most / n * (1 << 64)) - (1 << 63), (1 << 63) - 1))).orderBy(h).limit(most)
    points = np.unique(matrix(sample.toArrow().column("v").combine_chunks()), axis=0)
    rng = np.random.default_rng(seed)
    centres = np.unique(np.array(balanced_centroids(points, lists, rng)), axis=0)
    return Centroids.build(centres, rng)


def posting_lists(vectors: DataFrame, centroids: Centroids) -> DataFrame:
    """(list, id, v, salt): each vector in the list of its nearest centroid and, at a boundary, in others nearly as near.

    The salt deals rows to chunks, those of an id too.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, d = shared.value.search(matrix(part.column(1)), 32)
                take = (ids[:, :REPLICAS] >= 0) & (d[:, :REPLICAS] <= CLOSURE * d[:, :1])
                row, k = np.nonzero(take)
                salt = ((number + row) * 0x9E3779B1 >> 8 & 0xFFFFFF).astype("i4")
                number += part.num_rows
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row.to_numpy(), k].astype("i4")), part.column(0).take(row), part.column(1).take(row), pa.array(salt)], names=["list", "id", "v", "salt"])

    return vectors.mapInArrow(run, "list int, id long, v array<double>, salt int")


def ranked_lists(vectors: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """(lists, distances) of all centroids for each vector, nearest first."""
    d = squared(vectors, centroids.points)
    order = np.argsort(d, axis=1, kind="stable")
    return order, np.sqrt(np.take_along_axis(d, order, 1))


def within(d: np.ndarray, ratio: float) -> np.ndarray:
    """Which of the lists at these distances (nearest first) the ratio lets a query read."""
    return (np.arange(d.shape[1])[None, :] < LEAST_PROBES) | (d <= ratio * d[:, :1])


def calibrated(asking: DataFrame, lists: DataFrame, centroids: Centroids, ratio: float, k: int) -> tuple[int, float]:
    """(most lists for a query to read, ratio) that find TARGET of the neighbours of some queries (smallest hashes)."""
    n = len(centroids.points)
    if n <= FLOOR_PROBES and ratio == float("inf") or n <= LEAST_PROBES:
        return n, ratio
    some = asking.orderBy(F.xxhash64("id"), "id").limit(CALIBRATE).toArrow()
    if not some.num_rows:
        return n, ratio
    names, points = some.column("id").to_numpy(), matrix(some.column("v").combine_chunks())
    shared = lists.sparkSession.sparkContext.broadcast((names, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, points = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                of, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                by = np.argsort(ids, kind="stable")
                distinct, starts = np.unique(ids[by], return_index=True)
                every = np.sqrt(squared(points, matrix(part.column(2))))
                out: list[list] = [[], [], [], []]
                for name, score in zip(names, every, strict=True):
                    least = np.minimum.reduceat(score[by], starts)
                    others = np.flatnonzero(distinct != name)
                    # What surely isn't among the nearest of this part stays behind.
                    if len(others) > k:
                        s = least[others]
                        others = others[s <= np.partition(s, k - 1)[k - 1]]
                        others = others[np.lexsort((distinct[others], least[others]))][:k]
                    rows = np.flatnonzero(np.isin(ids, distinct[others]))
                    best = rows[np.lexsort((score[rows], of[rows], ids[rows]))]
                    first = np.ones(len(best), bool)
                    first[1:] = (ids[best][1:] != ids[best][:-1]) | (of[best][1:] != of[best][:-1])
                    best = best[first]
                    for column, values in zip(out, (np.full(len(best), name), of[best], ids[best], score[best]), strict=True):
                        column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "list", "vec_id", "score"])

    near = lists.select("list", "id", "v").mapInArrow(run, "query_id long, list int, vec_id long, score double")
    near = materialize(near.groupBy("query_id", "list", "vec_id").agg(F.min("score").alias("score")), "near")
    true = ranked(near.select("query_id", "vec_id", "score"), k).select("query_id", "vec_id", F.col("score").alias("least"))
    # At most CALIBRATE * k ids; lists that hold an id by a farther row of it do not count.
    places = near.join(true, ["query_id", "vec_id"]).where(F.col("score") <= F.col("least") * (1 + 1e-6) + 1e-9).groupBy("query_id", "vec_id").agg(F.collect_set("list").alias("lists")).collect()
    order, d = ranked_lists(points, centroids)
    place = np.argsort(order, axis=1)
    at = {q: k for k, q in enumerate(names.tolist())}
    need = np.array([place[at[r["query_id"]], r["lists"]].min() for r in places])
    read = within(d, ratio)
    allowed = np.array([read[at[r["query_id"]], m] for r, m in zip(places, need, strict=True)], bool)
    if not len(need):
        return n, ratio
    if allowed.mean() < TARGET:
        ratio, allowed = float("inf"), np.ones(len(need), bool)
    wanted = np.sort(np.where(allowed, need, n))[int(np.ceil(TARGET * len(need))) - 1] + 1
    return int(min(n, max(FLOOR_PROBES, wanted))), ratio


def probes(queries: DataFrame, centroids: Centroids, most: int, ratio: float) -> DataFrame:
    """(list, id, v): the lists that each query reads, ``most`` at most."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, d = ranked_lists(matrix(part.column(1)), shared.value)
                row, k = np.nonzero(within(d, ratio)[:, :most])
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ids[row, k].astype("i4")), part.column(0).take(rows), part.column(1).take(rows)], names=["list", "id", "v"])

    return queries.mapInArrow(run, "list int, id long, v array<double>")


def scan_lists(lists: DataFrame, sizes: DataFrame, read: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): at least the ``k`` nearest of each query among the lists it reads."""
    asked = read.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    plan = F.broadcast(sizes.join(asked, "list"))  # at most MOST_LISTS rows
    salt = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    candidates = lists.join(plan, "list").select("list", F.pmod("salt", "chunks").alias("chunk"), every("blocks").alias("block"), "id", "v")
    queries = read.join(plan, "list").select("list", every("chunks").alias("chunk"), salt("blocks").alias("block"), "id", "v")

    def best(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if own.num_rows and asking.num_rows:
            ids, points = own.column("id").to_numpy(), matrix(own.column("v").combine_chunks())
            by = np.argsort(ids, kind="stable")
            distinct, starts = np.unique(ids[by], return_index=True)
            for query, q in zip(asking.column("id").to_pylist(), matrix(asking.column("v").combine_chunks()), strict=True):
                # An id may repeat: its least score counts, before any cut.
                score = np.minimum.reduceat(np.sqrt(((points - q) ** 2).sum(axis=1))[by], starts)
                others = np.flatnonzero(distinct != query)
                if len(others) > 4 * k:
                    s = score[others]
                    others = others[s <= np.partition(s, k - 1)[k - 1]]
                kept = others[np.lexsort((distinct[others], score[others]))][:k]
                out[0] += [query] * len(kept)
                out[1] += distinct[kept].tolist()
                out[2] += score[kept].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["list", "chunk", "block"]
    return candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def ranked(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(df: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of each row for which ``queries`` (over ``df``) holds."""
    vectors = prepare(df, id_col, vector_col)
    asking = prepare(df.where(queries), id_col, vector_col) if queries is not None else vectors
    schema = "query_id long, rank int, vec_id long, score double"
    n = vectors.agg(F.count(F.lit(1))).head()[0]
    spark = df.sparkSession
    if not n:
        return spark.createDataFrame([], schema)
    dimension = vectors.select(F.size("v").alias("n")).head()["n"]
    asking = asking.where(F.size("v") == dimension).groupBy("id").agg(F.min("v").alias("v"))
    centroids = fit_centroids(vectors, n)
    lists = materialize(posting_lists(vectors, centroids), "lists")
    sizes = materialize(lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "sizes")
    most, ratio = calibrated(asking, lists, centroids, ratio, k)
    first = materialize(ranked(scan_lists(lists, sizes, probes(asking, centroids, most, ratio), k), k), "found")
    short = asking.join(first.groupBy("query_id").agg(F.count(F.lit(1)).alias("got")), F.col("id") == F.col("query_id"), "left").where(F.coalesce("got", F.lit(0)) < min(k, n - 1)).select("id", "v")
    short = materialize(short, "short")
    rest = short.count()
    if not rest:
        return first.select("query_id", "rank", "vec_id", "score")
    everywhere = short.crossJoin(F.broadcast(sizes.select("list"))).select("list", "id", "v")  # the stated queries against all lists
    second = ranked(scan_lists(lists, sizes, everywhere, k), k)
    done = first.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score")
    return done.unionByName(second.select("query_id", "rank", "vec_id", "score"))


__all__ = ["Centroids", "T", "balanced_centroids", "fit_centroids", "nearest", "posting_lists"]
