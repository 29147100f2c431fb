"""Near-duplicate vectors by spherical k-means cells, and exact top-k inner products by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import grouped, materialize, meet, table
from strandline.llm.components import components

SAMPLE = 20_000
#: Rows a side of one cosine product.
TILE = 1024


def usable(vector: Column) -> Column:
    """Not null, and no null or non-finite component."""
    inf = F.lit(float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = width if width is not None else int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that neither tiny nor huge components are lost in their squares."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def sampled(vectors: DataFrame, size: int) -> np.ndarray:
    """At most `size` vectors, those of the lowest hashes."""
    rows = vectors.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(size).toArrow()
    return matrix(rows.column("vector")) if rows.num_rows else np.zeros((0, 0))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centres for unit rows x, deterministic for equal rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.sqrt((sums * sums).sum(1))
        good = norms > 1e-9
        centres = np.where(good[:, None], sums / np.maximum(norms, 1e-9)[:, None], centres)
    return centres


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (of x, of y) of the pairs of unit rows with cosine >= threshold: single precision rules out, double decides."""
    i, j = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= threshold - 1e-4)
    if len(i) * 64 > len(x) * len(y):
        return np.nonzero(x @ y.T >= threshold)
    good = np.einsum("nd,nd->n", x[i], y[j]) >= threshold
    return i[good], j[good]


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep the connected parts of the links (u, v) whole: one fewer than their nodes at most."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while len(a := a[(open_ := low[a] != low[b])]):
        b = b[open_]
        least = np.minimum(low[a], low[b])
        np.minimum.at(low, low[a], least)
        np.minimum.at(low, low[b], least)
        while (low[low] != low).any():
            low = low[low]
    joined = np.flatnonzero(low != np.arange(len(nodes)))
    return nodes[joined], nodes[low[joined]]


def blocks_of(centres: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """The block of each cell: neighbouring cells together, about `block` rows each; cells are neighbours by a second set of centres."""
    wanted = int(min(len(centres), max(1, np.ceil(sizes.sum() / block))))
    order = np.argsort((centres @ spherical_kmeans(centres, wanted).T).argmax(1), kind="stable")
    before = np.cumsum(sizes[order]) - sizes[order]
    out = np.empty(len(centres), np.int64)
    out[order] = np.unique(before // block, return_inverse=True)[1]
    return out


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, per_cell: int = 200, limit: int = 512, sigmas: float = np.inf) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row.

    Spherical k-means, fitted on at most SAMPLE vectors, assigns each vector to a cell, and neighbouring cells form
    blocks. If y is at home in cell c and x in h, then x . (c_h - c_c) is at most (x - y) . (c_h - c_c), so x is compared
    with every block that has a cell within the threshold's distance of it by that bound: no link can be lost. `sigmas`
    below the square root of d narrows the bound to that many deviations of a displacement in a random direction, and can
    lose links. Of two blocks the lower visits the higher, each link is found once and counts at both ends. Blocks grow
    with the square root of the rows, `limit` rows at least, so that where geometry rules nothing out neither the copies
    of a vector nor the rows of a task grow faster than that. Equal vectors are one node that counts its copies.

    Vectors that are null, zero or hold null or non-finite components link with nothing and stand for themselves, as do
    vectors of a length that no other has; vectors link with those of their own length only. Null ids: the row takes
    part, ids that are null are never the smallest, and kept is true only if the whole component has none but nulls.
    Repeated rows count as vectors of their own. Empty table: no rows. Other columns are not read.
    """
    slim = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    good = slim.where(usable(F.col("vector")) & F.exists("vector", lambda x: x != 0))
    nodes = good.groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("width", F.size("vector")), "nodes")
    total = nodes.count()
    common = nodes.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    width = common["width"] if common else 0
    sample = sampled(nodes.where(F.col("width") == width), SAMPLE)
    k = max(1, min(len(sample) // 4, total // per_cell))  # four vectors of the sample a cell at least
    centres = spherical_kmeans(unit(sample), k) if len(sample) else np.zeros((1, width))
    gaps = np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) * min(1.0, sigmas / np.sqrt(max(1, width))) + 1e-9
    block = max(limit, int(16 * np.sqrt(total)))
    sizes = np.bincount((unit(sample) @ centres.T).argmax(1), minlength=k) * (total / len(sample)) if len(sample) else np.ones(1)
    block_of = blocks_of(centres, sizes, block)
    member = np.zeros((k, block_of.max() + 1), np.float32)
    member[np.arange(k), block_of] = 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                lengths = batch.column("width").to_numpy()
                row, cell, home = [], [], []
                odd = np.flatnonzero(lengths != width)
                row.append(odd)
                cell.append(-1 - lengths[odd])  # other lengths: a block for each
                home.append(np.ones(len(odd), bool))
                usual = np.flatnonzero(lengths == width)
                if len(usual):
                    s = unit(matrix(batch.column("vector").take(pa.array(usual)), width)) @ centres.T
                    best = s.argmax(1)
                    visit = s.max(1)[:, None] - s <= reach * gaps[best] + 1e-7
                    own = block_of[best]
                    there = visit.astype(np.float32) @ member > 0
                    there &= np.arange(there.shape[1]) > own[:, None]
                    there[np.arange(len(own)), own] = True
                    i, c = np.nonzero(there)
                    row.append(usual[i])
                    cell.append(c)
                    home.append(own[i] == c)
                taken = batch.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("node"), taken.column("copies"), taken.column("vector"), pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(home))],
                    ["node", "copies", "vector", "cell", "home"])

    kind = slim.schema["vector"].dataType.simpleString()
    placed = nodes.select("node", "copies", "vector", "width").mapInArrow(cells, f"node long, copies long, vector {kind}, cell int, home boolean")
    placed = materialize(placed, "placed")
    dealt, by = meet(placed.where("home"), placed, ["cell"], block)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, by):
            at = group.column("side").to_numpy()
            x, node, copies = unit(matrix(group.column("vector"))), group.column("node").to_numpy(), group.column("copies").to_numpy()
            home, counts, us, vs = group.column("home").to_numpy(), np.zeros(len(at), np.int64), [], []
            here, guests = np.flatnonzero(at == 0), np.flatnonzero(at == 1)
            for g in range(0, len(guests), TILE):
                for h in range(0, len(here), TILE):
                    i, j = linked(x[guests[g : g + TILE]], x[here[h : h + TILE]], threshold)
                    i, j = guests[g : g + TILE][i], here[h : h + TILE][j]
                    once = ~home[i] | (node[i] < node[j])  # those at home meet as both guest and host
                    i, j = i[once], j[once]
                    np.add.at(counts, i, copies[j])
                    np.add.at(counts, j, copies[i])
                    u, v = forest(node[i], node[j])
                    us.append(u)
                    vs.append(v)
            seen = np.flatnonzero(counts)
            u, v = np.concatenate([node[:0], *us]), np.concatenate([node[:0], *vs])
            none = pa.nulls(len(seen), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([node[seen], u])), pa.concat_arrays([none, pa.array(v)]), pa.array(np.concatenate([counts[seen], np.zeros(len(u), np.int64)]))],
                ["u", "v", "n"])

    found = materialize(dealt.mapInArrow(compare, "u long, v long, n long"), "found")
    parts = materialize(components(found.where("v is not null").select("u", "v")), "parts")
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("n"))
    labelled = nodes.join(parts, "node", "left").join(counts, "node", "left")
    labelled = materialize(labelled.select("vector", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")), "labelled")
    lowest = materialize(labelled.groupBy("component").agg(F.min("first").alias("lowest")), "lowest")
    known = materialize(labelled.join(lowest, "component").select("vector", "n_links", F.col("lowest").alias("component_id")), "known")
    out = slim.join(known, "vector", "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def _scored(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best (query, vector, score) of each query in a block, ties to the smaller id; ids that are equal are one row."""
    scores = np.clip(q @ x.T, -(2.0**62), 2.0**62)  # exact while integers stay below 2**53
    for i in range(len(q)):
        s = np.where(x_id == q_id[i], -np.inf, scores[i])
        pick = np.arange(len(s))
        if len(s) > 2 * k:
            bar = np.partition(s, len(s) - k)[len(s) - k]
            pick = np.flatnonzero(s >= bar)
        pick = pick[s[pick] > -np.inf]
        pick = pick[np.lexsort((x_id[pick], -s[pick]))][:k]
        for j in pick.tolist():
            yield int(q_id[i]), int(x_id[j]), int(s[j])


def top_k(rows: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, pivots: int = 64, rings: int = 32, limit: int = 512, first_rows: int = 200) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row with all other rows.

    `queries` is a condition on vec_id. Components are floor(scale * x), x as double. Pivot-distance index: with a
    component that brings all vectors to the largest length, a higher inner product is a smaller distance. Vectors are
    keyed by their nearest pivot and the ring (annulus) of their distance to it. A query first reads the rings whose
    triangle-inequality bound is least, until they hold first_rows rows; its k-th score then stops the expansion: of the
    other rings only those whose bound can still reach that score are read. The result is exact.

    The pivots come from at most SAMPLE vectors; pivots x rings bounds the ring table, which every task gets.
    Rows whose vector is null or holds null or non-finite components, or whose id is null, take no part; shorter vectors
    are as if they ended in zeros. Of repeated ids each row is a candidate; rows with the query's own id are not. Ties go
    to the smaller id. Fewer candidates than k: all of them. A query
    row that is repeated is asked once. Scores beyond 2**53 are those of doubles, 2**62 at most. Empty table: no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    good = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    whole = good.select("vec_id", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    whole = materialize(whole.select("vec_id", "vector", norm.alias("norm")), "whole")
    stats = whole.agg(F.max("norm").alias("norm"), F.max(F.size("vector")).alias("width")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if stats["width"] is None:
        return spark.createDataFrame([], result)
    longest, width = float(stats["norm"]), int(stats["width"])
    sample = sampled(whole, SAMPLE)
    lifted = np.hstack([np.pad(sample, ((0, 0), (0, width - sample.shape[1]))), np.sqrt(np.maximum(0, longest - (sample**2).sum(1)))[:, None]])
    # Pivots: centres of spherical k-means over the lifted sample, at the common length.
    points = spherical_kmeans(unit(lifted), min(pivots, len(lifted))) * np.sqrt(longest) if longest else np.zeros((1, width + 1))

    def distances(x: np.ndarray, lift: bool) -> np.ndarray:
        """To each pivot; queries are not lifted."""
        n = (x * x).sum(1)
        last = np.sqrt(np.maximum(0, longest - n)) if lift else np.zeros(len(x))
        y = np.hstack([x, last[:, None]])
        return np.nan_to_num(np.sqrt(np.maximum(0, (y * y).sum(1)[:, None] + (points * points).sum(1) - 2 * y @ points.T)), posinf=1e150)

    step = 2 * np.sqrt(longest) / rings or 1.0

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(matrix(batch.column("vector"), width), True)
            near = d.argmin(1)
            own = d[np.arange(len(d)), near]
            block = near * rings + np.minimum(rings - 1, (own / step).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), pa.array(block.astype(np.int32)), pa.array(own)], ["vec_id", "vector", "block", "distance"])

    index = materialize(whole.select("vec_id", "vector").mapInArrow(keyed, "vec_id long, vector array<long>, block int, distance double"), "index")
    held = index.groupBy("block").agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).orderBy("block").toArrow()
    blocks, sizes, low, high = (held.column(c).to_numpy() for c in ("block", "n", "low", "high"))

    def bounds(q: np.ndarray) -> np.ndarray:
        """The highest score that a row of each block can have with each query."""
        d = distances(q, False)[:, blocks // rings]
        gap = np.maximum(0, np.maximum(d - high, low - d) - 1e-6 * (1 + d))
        return np.nan_to_num(((q * q).sum(1)[:, None] + longest - gap * gap) / 2 * (1 + 1e-9) + 1e-3, nan=np.inf)

    def first(q: np.ndarray) -> np.ndarray:
        """Blocks of the first reading."""
        order = np.argsort(-bounds(q), axis=1, kind="stable")
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        chosen = np.zeros(order.shape, bool)
        np.put_along_axis(chosen, order, before < max(first_rows, k + 1), axis=1)
        return chosen

    def visits(later: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole_batch in batches:
                for at in range(0, whole_batch.num_rows, 256):
                    batch = whole_batch.slice(at, 256)
                    q = matrix(batch.column("vector"), width)
                    chosen = first(q)
                    if later:
                        bar = batch.column("bar").to_numpy(zero_copy_only=False)
                        chosen = ~chosen & (bounds(q) >= np.where(np.isnan(bar), -np.inf, bar)[:, None])
                    i, c = np.nonzero(chosen)
                    taken = batch.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[c].astype(np.int32)), taken.column("vec_id"), taken.column("vector")], ["block", "vec_id", "vector"])

        return run

    def scan(asked: DataFrame) -> DataFrame:
        dealt, by = meet(index.select("block", "vec_id", "vector"), asked, ["block"], limit)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in grouped(batches, by):
                side, ids, x = group.column("side").to_numpy(), group.column("vec_id").to_numpy(), matrix(group.column("vector"), width)
                got = list(_scored(x[side == 1], ids[side == 1], x[side == 0], ids[side == 0], k))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got, strict=True)], ["query_id", "vec_id", "score"])

        return materialize(dealt.mapInArrow(run, "query_id long, vec_id long, score long"), "scores")

    def ranked(scores: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return scores.withColumn("rank", F.row_number().over(order))

    asking = whole.where(queries).select("vec_id", "vector").distinct()
    near = scan(materialize(asking.mapInArrow(visits(False), "block int, vec_id long, vector array<long>"), "asked"))
    bar = ranked(near).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bar"))
    again = asking.join(bar, asking.vec_id == bar.query_id, "left").select("vec_id", "vector", "bar")
    far = scan(materialize(again.mapInArrow(visits(True), "block int, vec_id long, vector array<long>"), "asked"))
    return ranked(near.union(far)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
