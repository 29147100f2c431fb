"""SimHash near-duplicates: fingerprints in shards, each shard a set of BK-trees, linked within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import chunks, materialize, table, texts_of, unused
from strandline.llm.components import components

BITS = 64


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """64-bit hashes of the text's word shingles; a shorter text is one shingle, none without words."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], "<u8")
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=False)), "<u8", n - width + 1)


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that are set in over half the hashes; 0 without any."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: bytes, width: int) -> int:
    """SimHash of the text's word shingles."""
    return simhash(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(x, width) for x in texts_of(batch, "text")], pa.int64())], ["doc_id", "fp"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fp long")


class BKTree:
    """Fingerprints; a child hangs at its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = 0
        if self.values:
            while True:
                d = (self.values[node] ^ value).bit_count()
                if (child := self.children[node].get(d)) is None:
                    break
                node = child
            self.children[node][d] = len(self.values)
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Numbers of the values at most radius away: only edges from d - radius to d + radius can lead to one."""
        todo = [0] if self.values else []
        while todo:
            node = todo.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                yield node
            todo += [child for edge, child in self.children[node].items() if d - radius <= edge <= d + radius]


def shard_links(fps: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the connected parts of one shard: side 0 is compared with itself, or with side 1 if there is one.

    A spanning forest: at most one link per fingerprint, however many pairs are near.
    """
    parent = list(range(len(fps)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    values = fps.view(np.uint64).tolist()
    first = np.flatnonzero(side == 0).tolist()
    second = np.flatnonzero(side == 1).tolist()
    tree, links = BKTree(), []
    for i in first:
        if not second:
            for j in tree.within(values[i], radius):
                if (a := root(i)) != (b := root(first[j])):
                    parent[a] = b
                    links.append((i, first[j]))
        tree.add(values[i])
    for i in second:
        for j in tree.within(values[i], radius):
            if (a := root(i)) != (b := root(first[j])):
                parent[a] = b
                links.append((i, first[j]))
    return links


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of equal `by` in sorted batches; groups of one row are left out."""
    rest = None
    for batch in batches:
        part = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        if not part.num_rows:
            continue
        keys = [part.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                yield part.slice(a, b - a)
        rest = part.slice(edges[-1])
    if rest is not None and rest.num_rows > 1:
        yield rest


def near_links(fps: DataFrame, radius: int = 4, blocks: int = 6, limit: int = 2048) -> DataFrame:
    """u, v: links between distinct fingerprints at most radius apart that keep every connected part whole.

    The 64 bits are cut into blocks. Two fingerprints that differ in at most radius bits agree in blocks - radius
    blocks, so each choice of so many blocks is a shard key and no near pair is missed. A shard of more than `limit`
    fingerprints is dealt into slices, and each pair of slices is a task of its own, so no task holds a whole hot shard.
    """
    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << bounds[b + 1]) - (1 << bounds[b])) for b in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(number).alias("shard"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    shards = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.*")
    hot = shards.groupBy("shard", "bits").count().where(F.col("count") > limit).select("shard", "bits", F.ceil(F.col("count") / limit).cast("int").alias("slices"))
    dealt = shards.join(materialize(hot, "hot"), ["shard", "bits"], "left").select("fp", "shard", "bits", F.coalesce("slices", F.lit(1)).alias("slices"))
    dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("fp"), "slices").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("fp", "shard", "bits", F.least("slice", "other").alias("a"), F.greatest("slice", "other").alias("b"), (F.col("slice") > F.col("other")).cast("int").alias("side"))
    # Where a slice meets itself, side is 0 for all its rows; where it meets another, the lower slice is side 0.
    by = ["shard", "bits", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [], []
        for group in grouped(batches, by):
            fp, side = group.column("fp").to_numpy(), group.column("side").to_numpy()
            if group.column("a")[0].as_py() != group.column("b")[0].as_py() and side.min() == side.max():
                continue
            for i, j in shard_links(fp, side, radius):
                us.append(int(fp[i]))
                vs.append(int(fp[j]))
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])
                us, vs = [], []
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def labelled(fps: DataFrame, first: Column, radius: int) -> DataFrame:
    """fp, first, component of each distinct fingerprint: the smallest `first` of its rows, and its connected part."""
    nodes = materialize(fps.groupBy("fp").agg(F.min(first).alias("first")), "nodes")
    parts = materialize(components(near_links(nodes.select("fp"), radius)), "parts")
    found = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    return materialize(found.select("fp", "first", F.coalesce("component", "fp").alias("component")), "labelled")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of each row.

    BK-trees per shard: see near_links(). The trees stay in the tasks that build them from shuffled shards, as they
    grow with the data; nothing is broadcast.

    Null or empty text: fingerprint 0, which links like any other. Rows of one fingerprint are one node. Null ids: the
    row takes part, and its component_id is the smallest id among those that are not null (null if none is). Repeated
    rows are each returned. Empty table: no rows. Other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = labelled(fps, F.col("doc_id"), radius)
    lowest = materialize(nodes.groupBy("component").agg(F.min("first").alias("component_id")), "lowest")
    found = materialize(nodes.join(lowest, "component").select("fp", "component_id"), "classes")
    return fps.join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """(row, text) of each row, row being (order, key) with null ids last, and the key's expression."""
    key = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    order = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1))
    return docs.select(F.struct(order.alias("order"), key.alias("key")).alias("row"), F.col(text_col).alias("text")), key


def only(docs: DataFrame, key: Column, rows: DataFrame, stays: DataFrame) -> DataFrame:
    """docs whose key is among stays (key), one row of those that repeat a key; rows has all of `row`."""
    (name,) = unused(docs, "key")
    stays = stays.select(F.col("key").alias(name))
    kept = docs.withColumn(name, key).join(stays, name, "left_semi")
    twice = rows.groupBy("row").count().where("count > 1").select(F.col("row.key").alias(name)).join(stays, name, "left_semi")
    twice = materialize(twice, "twice")
    if twice.isEmpty():
        return kept.drop(name)
    single = kept.join(twice, name, "left_anti")
    return single.unionByName(kept.join(twice, name, "left_semi").dropDuplicates([name])).drop(name)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group of near-duplicates, all columns as they are: that of the smallest id (null ids come last).

    Of rows of the same id the one of the smallest text hash stays, of rows that repeat id and text any one.
    """
    slim, key = rows_of(docs, id_col, text_col)
    fps = materialize(fingerprints(slim, "row", "text", width).select("fp", F.col("doc_id").alias("row")), "fingerprints")
    nodes = labelled(fps, F.col("row"), radius)
    stays = materialize(nodes.groupBy("component").agg(F.min("first").alias("row")).select("row.key").distinct(), "stays")
    return only(docs, key, fps, stays)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
