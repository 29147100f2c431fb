"""Removal of repeated byte strings: a depth-limited most-significant-digit radix sort of the texts' suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bytesums
from strandline.llm.common import chunks, discard, materialize, table, texts_of

DIGIT = 48
PIECE = 1 << 20
CANDIDATE, REMOVED, OPEN, SHARED = 0, 1, 2, 3
LAST = np.iinfo(np.int64).max


class Pieces:
    """Texts as one array of bytes, long ones in pieces that overlap by a window less one, so that no window is lost."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        parts = [(i, at) for i, x in enumerate(texts) if len(x) >= depth for at in range(0, len(x) - depth + 1, PIECE)]
        self.text = np.array([i for i, _ in parts], np.int64)
        self.offset = np.array([at for _, at in parts], np.int64)
        self.data, self.starts = bytesums.joined([texts[i][at : at + PIECE + depth - 1] for i, at in parts])
        self.windows = np.minimum(np.diff(self.starts) - depth, PIECE)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and offset in it of positions in data."""
        part = np.searchsorted(self.starts, at, side="right") - 1
        return self.text[part], at - self.starts[part] + self.offset[part]


def first_digits(pieces: Pieces, depth: int, digit: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with their first digit: position of the first window, number of windows, digit, hash of the run.

    A window's first digit is the digit-byte string in it of the least hash (the leftmost of several): equal windows have
    equal digits at equal places. Neighbouring windows mostly share one, and such a run is sorted as one suffix, the one
    that starts with the digit. Hashes are compared by their upper 32 bits whatever the size of the chunk, so that those
    that tie in one chunk tie in all.
    """
    data, n = pieces.data, len(pieces.data)
    m, width = n - digit + 1, depth - digit + 1
    sums = bytesums.prefix(data, 1)
    grams = bytesums.mix((sums[digit:] - sums[:-digit]) * bytesums.powers(n + 1)[1][:m])
    mask = np.uint64((1 << 32) - 1)  # places: an Arrow chunk is smaller
    low = (grams & ~mask) | np.arange(m, dtype=np.uint64)
    d = 1
    while 2 * d <= width:
        low = np.minimum(low[:-d], low[d:])
        d *= 2
    if d < width:
        low = np.minimum(low[: len(low) - (width - d)], low[width - d :])
    change = np.zeros(n + 1, np.int8)
    np.add.at(change, pieces.starts[:-1], 1)
    np.add.at(change, pieces.starts[:-1] + pieces.windows, -1)
    window = np.flatnonzero(np.cumsum(change[:n]))
    at = (low[window] & mask).astype(np.int64)
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(window) != 1)) + 1
    first = np.concatenate([[0], cut])
    size = np.diff(np.append(first, len(window)))
    start, place = window[first], at[first]
    run = bytesums.span_hash(bytesums.prefix(data, 2), start, start + size - 1 + depth) ^ bytesums.mix((place - start).astype(np.uint64) + np.uint64(77))
    return start, size, grams[place].view(np.int64), run.view(np.int64)


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted row differs from the one before it."""
    return np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]) if len(keys[0]) else np.zeros(0, bool)


def _spread(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A key for rows that need no group: any even spread will do."""
    return bytesums.mix(doc.view(np.uint64) + at.astype(np.uint64) * np.uint64(0x9E3779B1)).view(np.int64)


def settle(key: np.ndarray, rest: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by (key, rest, doc, at): which begin a key, which begin a (key, rest), which stand after the first."""
    group, same = _new(key), _new(key, rest)
    lead = np.maximum.accumulate(np.where(same, np.arange(len(key)), 0))
    later = (doc > doc[lead]) | ((doc == doc[lead]) & (at > at[lead]))
    return group, same, later


RUNS = "kind int, digit long, run long, doc long, dk long, at long, n int"
SPANS = "open boolean, dk long, doc long, at long, n int"
WINDOWS = "kind int, lead long, tail long, doc long, dk long, at long"


def _sorted_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut so that no key is torn apart."""
    rest: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if rest is not None:
            now = {c: np.concatenate([rest[c], x]) for c, x in now.items()}
        k = now[key]
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if cut:
            yield {c: x[:cut] for c, x in now.items()}
        rest = {c: x[cut:] for c, x in now.items()}
    if rest is not None:
        yield rest


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def repeated(docs: DataFrame, depth: int = 100, digit: int = DIGIT) -> DataFrame:
    """dk, spans: for each document (by key) that loses bytes, an array of (at, end) spans that cover them.

    docs has doc (order of the documents), dk (key of the row) and text. The first pass sorts the runs by their first
    digit: runs whose digit nobody shares are done, runs with equal bytes leave their first, and runs that share the digit
    only stay open. The windows of the open runs are sorted by two more digits, their first depth // 2 bytes and the rest,
    the most significant first: after the last a group is a repeated string, of which the first place stays. Each task
    first settles what repeats within its own chunk of texts, so that a passage of a third of all documents gives one row
    a chunk.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            pieces = Pieces(texts_of(batch, "text"), depth)
            if not len(pieces.text):
                continue
            start, size, key, run = first_digits(pieces, depth, digit)
            text, at = pieces.place(start)
            doc, dk = (batch.column(c).to_numpy()[text] for c in ("doc", "dk"))
            order = np.lexsort((at, doc, run, key))
            doc, dk, at, size, key, run = (x[order] for x in (doc, dk, at, size, key, run))
            group, same, later = settle(key, run, doc, at)
            heads = np.flatnonzero(group)
            several = np.repeat(np.add.reduceat(same, heads, dtype=np.int64) > 1, np.diff(np.append(heads, len(key))))
            kind = np.where(later, REMOVED, np.where(several, np.where(group, SHARED, OPEN), CANDIDATE))
            alone = (kind == REMOVED) | (kind == OPEN)
            key = np.where(alone, _spread(dk, at), key)
            yield _batch(RUNS, kind, key, run, doc, dk, at, size)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _sorted_runs(batches, "digit"):
            free = (x["kind"] == CANDIDATE) | (x["kind"] == SHARED)
            yield _batch(SPANS, (x["kind"] == OPEN)[~free], *(x[c][~free] for c in ("dk", "doc", "at", "n")))
            x = {c: v[free] for c, v in x.items()}
            if not len(x["dk"]):
                continue
            group, same, later = settle(x["digit"], x["run"], x["doc"], x["at"])
            heads = np.flatnonzero(group)
            several = (np.add.reduceat(same, heads, dtype=np.int64) > 1) | (np.maximum.reduceat(x["kind"], heads) == SHARED)
            still = np.repeat(several, np.diff(np.append(heads, len(group)))) & ~later
            keep = still | later
            yield _batch(SPANS, still[keep], *(x[c][keep] for c in ("dk", "doc", "at", "n")))

    runs = docs.select("doc", "dk", "text").mapInArrow(scan, RUNS)
    runs = runs.repartition("digit").sortWithinPartitions("digit", "run", "doc", "at")
    spans = materialize(runs.mapInArrow(first_pass, SPANS), "spans")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            pieces = Pieces(texts_of(batch, "text"), depth)
            if not len(pieces.text):
                continue
            # Where the windows of each text's open runs stand in data.
            lists = batch.column("open")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            flat = lists.flatten()
            at, n = flat.field("at").to_numpy(), flat.field("n").to_numpy().astype(np.int64)
            text = np.repeat(owner, n)
            at = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rank = np.searchsorted(pieces.text, text, side="left") + at // PIECE
            pos = pieces.starts[rank] + at - pieces.offset[rank]
            sums, middle = bytesums.prefix(pieces.data, 3), pos + depth // 2
            lead, tail = (bytesums.span_hash(sums, a, b).view(np.int64) for a, b in ((pos, middle), (middle, pos + depth)))
            doc, dk = (batch.column(c).to_numpy()[text] for c in ("doc", "dk"))
            order = np.lexsort((at, doc, tail, lead))
            lead, tail, doc, dk, at = (x[order] for x in (lead, tail, doc, dk, at))
            later = settle(lead, tail, doc, at)[2]
            yield _batch(WINDOWS, np.where(later, REMOVED, CANDIDATE), np.where(later, _spread(dk, at), lead), tail, doc, dk, at)

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of sorted windows those that stand after the first of their group, which is all that is kept of it."""
        names = ("lead", "tail", "doc", "at")
        first = {c: np.zeros(0, np.int64) for c in names}
        for batch in batches:
            x = {c: batch.column(c).to_numpy() for c in batch.schema.names}
            gone = x["kind"] == REMOVED
            free = np.flatnonzero(~gone)
            if len(free):
                y = {c: np.concatenate([first[c], x[c][free]]) for c in names}
                _, same, later = settle(*y.values())
                gone[free] = later[-len(free) :]
                first = {c: v[np.flatnonzero(same)[-1:]] for c, v in y.items()}
            yield _batch("dk long, at long", x["dk"][gone], x["at"][gone])

    still = spans.where("open").groupBy("dk").agg(F.collect_list(F.struct("at", "n")).alias("open"))  # a text's own runs
    asked = docs.join(still, "dk").select("doc", "dk", "text", "open").mapInArrow(windows, WINDOWS)
    asked = asked.repartition("lead", "tail").sortWithinPartitions("lead", "tail", "doc", "at")
    more = materialize(asked.mapInArrow(last_pass, "dk long, at long"), "windows")
    both = spans.where("not open").select("dk", "at", (F.col("at") + F.col("n") - 1 + depth).alias("end")).union(more.select("dk", "at", F.col("at") + depth))
    out = materialize(both.groupBy("dk").agg(F.collect_list(F.struct("at", "end")).alias("spans")), "removed")
    discard(spans, more)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 100, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row (and kept binary if asked for).

    Removes each byte covered by a string of depth bytes that also starts earlier in (doc_id, offset) order of the
    input. Strings are compared by 64-bit hashes of their digits, not by the bytes themselves: two different strings are
    taken for one with a probability of 2**-64 a pair that shares a digit.

    Null or empty text: no bytes. Texts shorter than depth lose nothing. Null ids: one document after all others in the
    order. Rows that repeat an id and its text are one document with one result; rows of one id with different texts
    are compared by their offsets. Empty table: no rows. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("doc"), F.xxhash64(F.col(id_col), text).alias("dk"), text.alias("text"))
    found = repeated(slim, depth)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            rows = []
            lists = batch.column("spans")
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            flat = lists.flatten()
            a, b = flat.field("at").to_numpy(), flat.field("end").to_numpy()
            for i, x in enumerate(texts_of(batch, "text")):
                if not sizes[i]:
                    rows.append((len(x), 0, 0, hashlib.sha256(x).hexdigest(), x))
                    continue
                cover = np.zeros(len(x) + 1, np.int32)
                own = slice(ends[i] - sizes[i], ends[i])
                np.add.at(cover, a[own], 1)
                np.add.at(cover, b[own], -1)
                gone = np.cumsum(cover[:-1]) > 0
                kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
                rows.append((len(x), int(gone.sum()), int(np.diff(gone, prepend=False).sum() + 1) // 2, hashlib.sha256(kept).hexdigest(), kept))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            most = 5 if with_text else 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns[:most]], ["doc_id", *names[:most]])

    kind = slim.schema["doc_id"].dataType.simpleString()
    out = slim.join(found, "dk", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(finish, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
