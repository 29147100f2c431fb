"""Line dedup: an exact set-similarity join of lines by prefix, positional and length filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bytesums
from strandline.llm.common import chunks, discard, freeing, input_mb, materialize, table, texts_of, unused

LAST = np.iinfo(np.int64).max
#: Postings of a word that one task compares with each other; words that may have more are cut into slices.
HOT = 20_000
#: Slices of the postings of a word, by its frequency class.
SLICES = np.minimum(4096, np.ceil(2 ** (np.arange(256) / 8) / HOT)).astype(np.int64)
SLAB = 1 << 18
#: Lines a packed row, and slots of the lines that a task remembers. Neither changes a result.
ROW_LINES, RECENT = 1 << 14, 1 << 18
#: What is known of a line, packed: arrays of a value a line; token has the words of all prefixes, one after another.
OF_LINE = {"n": "<u4", "line": "<u4", "sketch": "<u8", "sketch2": "<u8", "same": "<u8", "doc": "<i8", "dk": "<i8"}
GONE = {"gone_line": "<u4", "gone_dk": "<i8"}
LINES = "bucket int, token binary, " + ", ".join(f"{c} binary" for c in OF_LINE | GONE)
#: Postings of some lines, for one range of keys: arrays of the posted words, and of their lines.
POSTED = {"key": "<u8", "pos": "<u4", "at": "<u4"}
POSTINGS = "bucket int, " + ", ".join(f"{c} binary" for c in POSTED | OF_LINE)
PAIRS = "dk long, line int, other_dk long, other_line int, distance int, more boolean"


def _order(line: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Order by (line, rank of 44 bits), ties of the bits that fit by place; line is sorted."""
    n = len(line)
    at_bits = max(1, (n - 1).bit_length()) if n else 1
    line_bits = max(1, int(line[-1]).bit_length()) if n else 1
    rank_bits = 64 - at_bits - line_bits
    if rank_bits < 28:
        return np.lexsort((rank, line))
    short = rank >> np.uint64(44 - min(44, rank_bits))
    packed = (line.astype(np.uint64) << np.uint64(64 - line_bits)) | (short << np.uint64(at_bits + max(0, rank_bits - 44))) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << at_bits) - 1)).astype(np.int64)
    cut = packed >> np.uint64(at_bits)
    tied = (cut[1:] == cut[:-1]) & (rank[order[1:]] != rank[order[:-1]])
    return np.lexsort((rank, line)) if tied.any() else order  # words that share the bits that fit: in full


class Lines:
    """The lines of a chunk of texts as sets of lower-cased words, each in order of rarity.

    start: where each set begins in `token` (with the end of the last); text, number: whose line it is. Lines without
    words are left out.
    """

    def __init__(self, texts: list[bytes], classes: np.ndarray | None = None) -> None:
        data, starts = bytesums.joined(texts)
        data = bytesums.lower(data)
        a, b = bytesums.words(data)
        hashes = bytesums.span_hash(bytesums.prefix(data, 8), a, b)
        ends = np.flatnonzero(data == 10)
        count = np.diff(np.searchsorted(a, ends), prepend=0)
        full = np.flatnonzero(count)
        count = count[full]
        line = np.repeat(np.arange(len(full)), count)
        # Ranks of 44 bits: by frequency class, then by hash.
        rank = hashes >> np.uint64(28)
        if classes is not None:
            rank |= classes[slot_of(hashes, len(classes))].astype(np.uint64) << np.uint64(36)
        order = _order(line, rank)
        hashes, rank = hashes[order], rank[order]  # lines stay in place: they were in order
        same_line = line[1:] == line[:-1]
        if (same_line & (rank[1:] == rank[:-1]) & (hashes[1:] != hashes[:-1])).any():
            order = np.lexsort((hashes, rank, line))
            hashes = hashes[order]
        new = np.ones(len(line), bool)
        new[1:] = ~same_line | (hashes[1:] != hashes[:-1])
        self.token = hashes[new]
        self.size = np.add.reduceat(new, np.cumsum(count) - count, dtype=np.int64) if len(line) else np.zeros(0, np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.text = np.searchsorted(starts, ends[full], side="right") - 1
        self.number = full - np.searchsorted(ends, starts[self.text])

    def folded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each set: the parity of its words on 128 bits, and a hash of the set.

        Two sketches differ in as many bits as the sets differ in words, at most.
        """
        if not len(self.size):
            return (np.zeros(0, np.uint64),) * 3
        mixed = bytesums.mix(self.token ^ np.uint64(0x5851F42D4C957F2D))
        bit, upper = np.uint64(1) << (mixed >> np.uint64(58)), (mixed >> np.uint64(57) & np.uint64(1)).astype(bool)
        low, high = (np.bitwise_xor.reduceat(np.where(half, bit, np.uint64(0)), self.start[:-1]) for half in (~upper, upper))
        return low, high, bytesums.mix(np.add.reduceat(mixed, self.start[:-1]) + self.size.astype(np.uint64))


def _begins(x: np.ndarray) -> np.ndarray:
    """Which values differ from the one before them."""
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return new


def _number(new: np.ndarray, head: np.ndarray) -> np.ndarray:
    """How many `new` each row has before its own, since the last head."""
    number = np.cumsum(new)
    return number - number[head][np.cumsum(head) - 1]


def _packed(x: np.ndarray, kind: str, head: np.ndarray) -> pa.Array:
    """The values from each head to the next as bytes."""
    x = np.ascontiguousarray(x.astype(kind))
    ends = np.append(np.flatnonzero(head), len(x)) * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])


def _later(doc: np.ndarray, line: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return (doc[j] > doc[i]) | ((doc[j] == doc[i]) & (line[j] > line[i]))


def _by_key_and_size(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Order by (key, n): by 44 bits of the key and the size in one number, or in full where that can't tell."""
    if len(key) and n.max() < 1 << 20:
        order = np.argsort(key & ~np.uint64((1 << 20) - 1) | n.astype(np.uint64))
        k = key[order]
        if not ((k[1:] != k[:-1]) & (k[1:] >> np.uint64(20) == k[:-1] >> np.uint64(20))).any():
            return order
    return np.lexsort((n, key))


def _partnered(key: np.ndarray) -> np.ndarray:
    """Places of the keys that occur again, and of few others: those that share a slot with another key."""
    number, slots = np.arange(len(key), dtype=np.int64), 1 << max(10, len(key).bit_length() + 2)
    slot = (key & np.uint64(slots - 1)).astype(np.int64)
    last = np.zeros(slots, np.int64)
    last[slot] = number
    several = np.zeros(slots, bool)
    several[slot[last[slot] != number]] = True
    return np.flatnonzero(several[slot])


def candidates(x: dict[str, np.ndarray], threshold: float, every: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Places (later line, earlier line), distance, more: pairs of postings of one key that pass all filters.

    Length filter: postings sorted by (key, size) make the partners of a posting a range. Positional filter: the shorter
    set's word stands within its shorter prefix, and what is left behind both words can still give the overlap. Sketch
    filter: sets at the threshold differ in few words. Of the candidates of a later line in a slab, the nearest by
    sketch, or every one.
    """
    order = _by_key_and_size(x["key"], x["n"])
    key, n, pos = x["key"][order], x["n"][order].astype(np.int64), x["pos"][order].astype(np.int64)
    # Two sets need the sum of their parts as overlap; rest is what a word and those behind it can give.
    part, rest = threshold / (1 + threshold) * n - 5e-10, (n - pos).astype(np.float64)
    # The shorter of a pair: only postings of its shorter prefix, in the same order.
    short = np.flatnonzero(pos <= n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9))
    short_part, short_rest = part[short], rest[short]
    begin = np.flatnonzero(_begins(key))
    rank = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    span = np.int64(1 << 32)
    sizes = rank * span + n
    low = np.searchsorted(sizes[short], rank * span + np.ceil(threshold * n - 1e-9).astype(np.int64))
    # What stands behind a late word can't give the overlap with a set that is too large.
    largest = np.minimum(n, np.floor((1 + threshold) / threshold * (n - pos) + 1e-9).astype(np.int64) - n)
    high = np.maximum(low, np.searchsorted(sizes[short], rank * span + np.maximum(largest, 0), side="right"))
    total = np.concatenate([[0], np.cumsum(high - low)])
    at = 0
    while at < len(key):
        to = max(at + 1, int(np.searchsorted(total, total[at] + SLAB, side="right")) - 1)
        for skip in range(0, max(1, int((high - low)[at:to].max())), SLAB):  # more than one step for a huge key only
            count = np.clip((high - low)[at:to] - skip, 0, SLAB)
            j = np.repeat(np.arange(to - at), count)
            i = np.arange(len(j)) + (low[at:to] + skip - (np.cumsum(count) - count))[j]
            need = short_part[i] + part[at:to][j]
            ok = np.flatnonzero((short_rest[i] >= need) & (rest[at:to][j] >= need))
            i, j = short[i[ok]], j[ok] + at
            most = n[i] + n[j] - 2 * np.ceil(need[ok])
            i, j = order[i], order[j]
            distance = sum(np.bitwise_count(x[c][i] ^ x[c][j]).astype(np.int32) for c in ("sketch", "sketch2"))
            ok = (distance <= most) & (i != j)
            i, j, distance = i[ok], j[ok], distance[ok]
            if not len(j):
                continue
            swap = _later(x["doc"], x["line"], j, i)
            late, early = np.where(swap, i, j), np.where(swap, j, i)
            ok = _later(x["doc"], x["line"], early, late)
            late, early, distance = late[ok], early[ok], distance[ok]
            rank_of = np.lexsort((early, distance, late))
            late, early, distance = (v[rank_of] for v in (late, early, distance))
            first = _begins(late)
            more = np.append(~first[1:], False) if len(late) else first
            keep = np.ones(len(late), bool) if every else first
            yield late[keep], early[keep], distance[keep], more[keep]
        at = to


def repeats(x: dict[str, np.ndarray]) -> np.ndarray:
    """Which lines stand after another line of the same set."""
    order = np.lexsort((x["line"], x["doc"], x["same"]))
    lead = _begins(x["same"][order])
    head = np.maximum.accumulate(np.where(lead, np.arange(len(order)), 0))
    out = np.zeros(len(order), bool)
    out[order] = _later(x["doc"], x["line"], order[head], order)
    return out


class Recent:
    """Lines that a task has seen, as many as there are slots: a line of a third of all texts leaves a task about once."""

    def __init__(self) -> None:
        self.same, self.doc, self.line = np.zeros(RECENT, np.uint64), np.full(RECENT, LAST), np.zeros(RECENT, np.int64)

    def repeats(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """Which lines stand after a remembered line of the same set; those that don't are remembered."""
        slot = (x["same"] & np.uint64(RECENT - 1)).astype(np.int64)
        known, doc, line = self.same[slot] == x["same"], self.doc[slot], self.line[slot]
        later = known & ((x["doc"] > doc) | ((x["doc"] == doc) & (x["line"] > line)))
        own = ~later
        self.same[slot[own]], self.doc[slot[own]], self.line[slot[own]] = x["same"][own], x["doc"][own], x["line"][own]
        return later


def slot_of(hashes: np.ndarray, slots: int) -> np.ndarray:
    """The slot of a word among a power of two, from bits of its hash that ranks don't use."""
    return (hashes & np.uint64(slots - 1)).astype(np.int64)


def frequency_classes(docs: DataFrame, slots: int) -> np.ndarray:
    """For each slot of words, how often they occur in the corpus: 8 times the binary logarithm, as a byte.

    Tasks count all words of their texts in a table of `slots` numbers and send it in slices, which are added up. Words
    of a slot share a class, so a rare word may count as less rare than it is: any order of words gives the same join,
    and one near to rarity gives it few candidates.
    """
    parts = 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.uint32)
        for batch in chunks(batches, "text", 1 << 20):
            data, _ = bytesums.joined(texts_of(batch, "text"))
            data = bytesums.lower(data)
            a, b = bytesums.words(data)
            slot = slot_of(bytesums.span_hash(bytesums.prefix(data, 8), a, b), slots)
            if len(slot) * 8 < slots:
                np.add.at(total, slot, np.uint32(1))
            else:
                total += np.bincount(slot, minlength=slots).astype(np.uint32)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([x.tobytes() for x in np.split(total, parts)], pa.binary())], ["part", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint32).astype(np.int64) for x in group.column("counts").to_pylist())
        kind = np.minimum(255, np.ceil(8 * np.log2(total + 1))).astype(np.uint8)
        return pa.table({"part": group.column("part")[:1], "classes": pa.array([kind.tobytes()], pa.binary())})

    counted = docs.select("text").mapInArrow(count, "part int, counts binary")
    with freeing(docs.sparkSession):
        rows = counted.groupBy("part").applyInArrow(add, "part int, classes binary").collect()  # `slots` bytes together
    found = {r.part: np.frombuffer(r.classes, np.uint8) for r in rows}
    return np.concatenate([found[i] for i in range(parts)]) if found else np.zeros(slots, np.uint8)


def ranges(keys: np.ndarray, count: int) -> np.ndarray:
    """Which of `count` equal ranges of hashes each key falls in."""
    return ((bytesums.mix(keys) >> np.uint64(40)) * np.uint64(count) >> np.uint64(24)).astype(np.int64)


def _stable(by: np.ndarray, count: int) -> np.ndarray:
    """Stable order of numbers below count; that of short numbers is a radix sort."""
    return np.argsort(by.astype(np.uint16) if count < 1 << 16 else by, kind="stable")


def pair_table(x: dict[str, np.ndarray], late: np.ndarray, early: np.ndarray, distance: np.ndarray, more: np.ndarray) -> pa.Table:
    columns = (x["dk"][late], x["line"][late], x["dk"][early], x["line"][early], distance, more)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
    return pa.table({c.split(" ")[0]: pa.array(v).cast(k) for c, v, k in zip(PAIRS.split(", "), columns, kinds, strict=True)})


class Join:
    """The set-similarity join of lines: what its tasks do. Lines are dicts of arrays, see OF_LINE, with their prefixes in
    `token`: the rarest words of each set, of which two similar sets have one in common."""

    def __init__(self, threshold: float, classes: np.ndarray, buckets: int) -> None:
        self.threshold, self.classes, self.buckets = threshold, classes, buckets

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Words of the prefix of a set of n; none where only an equal set can be similar: its best other partner has a
        word more, and a Jaccard similarity of n / (n + 1)."""
        return np.where(n < self.threshold * (n + 1) - 1e-9, 0, n - np.ceil(self.threshold * n - 1e-9).astype(np.int64) + 1)

    def read(self, batch: pa.RecordBatch) -> tuple[Lines, dict[str, np.ndarray]]:
        lines = Lines(texts_of(batch, "text"), self.classes)
        doc, dk = (batch.column(c).to_numpy()[lines.text] for c in ("doc", "dk"))
        sketch, sketch2, same = lines.folded()
        return lines, {"n": lines.size, "line": lines.number, "sketch": sketch, "sketch2": sketch2, "same": same, "doc": doc, "dk": dk}

    def tokens(self, lines: Lines, own: np.ndarray) -> np.ndarray:
        """The prefixes of some lines, one after another."""
        size = self.prefix(lines.size[own])
        return lines.token[np.arange(size.sum()) + np.repeat(lines.start[own] - (np.cumsum(size) - size), size)]

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines of texts by range of their sets' hashes, those that repeat a line of the chunk or a recent one as gone."""
        recent = Recent()
        for batch in chunks(batches, "text", 1 << 21):
            lines, x = self.read(batch)
            if not len(x["n"]):
                continue
            gone = repeats(x)
            left = np.flatnonzero(~gone)
            gone[left] = recent.repeats({c: v[left] for c, v in x.items()})
            by = ranges(x["same"], self.buckets)
            order = _stable(by * 2 + gone, 2 * self.buckets)
            for b, own in self._split(by[order], order):
                out = gone[own]
                keep = own[~out]
                yield self.packed(b, {c: v[keep] for c, v in x.items()}, self.tokens(lines, keep), x["line"][own[out]], x["dk"][own[out]])

    @staticmethod
    def _split(by: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        head = np.flatnonzero(_begins(by))
        for a, b in zip(head, np.append(head[1:], len(by)), strict=True):
            yield int(by[a]), order[a:b]

    def packed(self, bucket: int, x: dict[str, np.ndarray], token: np.ndarray, gone_line: np.ndarray, gone_dk: np.ndarray) -> pa.RecordBatch:
        values = [token.astype("<u8"), *(x[c].astype(k) for c, k in OF_LINE.items()), gone_line.astype("<u4"), gone_dk.astype("<i8")]
        return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["bucket", "token", *OF_LINE, *GONE])

    @staticmethod
    def unpacked(rows: list[dict]) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Lines and their prefixes."""
        join = lambda c, k: np.concatenate([np.frombuffer(r[c], k) for r in rows])
        return {c: join(c, k) for c, k in OF_LINE.items()}, join("token", "<u8")

    def settle(self, group: pa.Table) -> pa.Table:
        """Of the lines of a range of sets, the first of each set as packed rows; the others are gone."""
        rows = group.to_pylist()
        x, token = self.unpacked(rows)
        gone = repeats(x)
        size = self.prefix(x["n"].astype(np.int64))
        start = np.cumsum(size) - size
        keep, lost = np.flatnonzero(~gone), np.flatnonzero(gone)
        gone_line, gone_dk = (np.concatenate([x[c][lost], *(np.frombuffer(r[f"gone_{c}"], k) for r in rows)]) for c, k in (("line", "<u4"), ("dk", "<i8")))
        out = [self.packed(0, {c: v[:0] for c, v in x.items()}, token[:0], gone_line, gone_dk)]
        for at in range(0, len(keep), ROW_LINES):
            own = keep[at : at + ROW_LINES]
            flat = np.arange(size[own].sum()) + np.repeat(start[own] - (np.cumsum(size[own]) - size[own]), size[own])
            out.append(self.packed(0, {c: v[own] for c, v in x.items()}, token[flat], gone_line[:0], gone_dk[:0]))
        return pa.Table.from_batches(out)

    def posted(self, x: dict[str, np.ndarray], token: np.ndarray, asked: np.ndarray | None = None) -> pa.RecordBatch:
        """Postings of lines by range of keys; if there are `asked` bits, those of keys whose bit is set."""
        size = self.prefix(x["n"].astype(np.int64))
        row = np.repeat(np.arange(len(size)), size)
        pos, key = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size), token
        # Postings of words that may be frequent are cut into slices, and each pair of slices is a key.
        cut = SLICES[self.classes[slot_of(key, len(self.classes))]]
        if cut.max(initial=1) > 1:
            again = np.repeat(np.arange(len(row)), cut)
            other = np.arange(len(again)) - np.repeat(np.cumsum(cut) - cut, cut)
            mine = (bytesums.mix(x["same"][row]) % cut.astype(np.uint64)).astype(np.int64)[again]
            pair = (np.minimum(mine, other) * 65_537 + np.maximum(mine, other) + 1).astype(np.uint64)
            key = np.where(cut[again] > 1, bytesums.mix(key[again] + pair), key[again])
            row, pos = row[again], pos[again]
        if asked is not None:
            own = _bits(asked, key)
            key, row, pos = key[own], row[own], pos[own]
        by = ranges(key, self.buckets)
        order = _stable(by, self.buckets)
        by, row, pos, key = by[order], row[order], pos[order], key[order]
        # By bucket, then line: a line's values stand once in each bucket.
        head = _begins(by)
        of_line = head | _begins(row)
        line, line_head = row[of_line], head[of_line]
        columns = [_packed({"key": key, "pos": pos, "at": _number(of_line, head)}[c], kind, head) for c, kind in POSTED.items()]
        columns += [_packed(x[c][line], kind, line_head) for c, kind in OF_LINE.items()]
        return pa.RecordBatch.from_arrays([pa.array(by[head], pa.int32()), *columns], ["bucket", *POSTED, *OF_LINE])

    def post(self, asked: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield self.posted(*self.unpacked(batch.slice(i, 1).to_pylist()), asked)

        return run

    @staticmethod
    def postings(table_: pa.Table, partnered: bool = False) -> dict[str, np.ndarray]:
        """Postings of some rows, each with its line's values; with partnered, few whose key is alone."""
        parts: dict[str, list[np.ndarray]] = {c: [] for c in POSTED | OF_LINE}
        lines = 0
        for row in table_.to_pylist():
            now = {c: np.frombuffer(row[c], k) for c, k in (POSTED | OF_LINE).items()}
            now["at"] = now["at"] + np.int64(lines)
            lines += len(now["n"])
            for c, v in now.items():
                parts[c].append(v)
        x = {c: np.concatenate(v) for c, v in parts.items()}
        own = _partnered(x["key"]) if partnered else slice(None)
        at = x["at"][own]
        return {c: x[c][own] for c in ("key", "pos")} | {c: x[c][at] for c in OF_LINE}

    def best(self, group: pa.Table) -> pa.Table:
        """One candidate for each later line of a range of keys."""
        x = self.postings(group, True)
        found = [np.concatenate(v) for v in zip(*candidates(x, self.threshold, False), strict=True)] or [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.int32), np.zeros(0, bool)]
        late, early, distance, more = found
        # Postings of one line are one line.
        order = np.lexsort((early, distance, x["line"][late], x["dk"][late]))
        late, early, distance, more = (v[order] for v in (late, early, distance, more))
        if len(late):
            first = np.concatenate([[True], (x["dk"][late][1:] != x["dk"][late][:-1]) | (x["line"][late][1:] != x["line"][late][:-1])])
            begin = np.flatnonzero(first)
            lead = np.repeat(begin, np.diff(np.append(begin, len(late))))
            differs = (x["dk"][early] != x["dk"][early[lead]]) | (x["line"][early] != x["line"][early[lead]])
            more = np.logical_or.reduceat(more | differs, begin)
            late, early, distance = (v[begin] for v in (late, early, distance))
        return pair_table(x, late, early, distance, more)


def gone_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dk, line of the lines that settle() found to be gone."""
    for batch in batches:
        for row in batch.to_pylist():
            columns = [np.frombuffer(row["gone_dk"], "<i8"), np.frombuffer(row["gone_line"], "<u4").astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dk", "line"])


def removed_lines(docs: DataFrame, threshold: float = 0.8, least_mb: float = 2.0, most_mb: float = 16.0) -> DataFrame:
    """dk, lines: for each text (by key) the numbers of its lines that repeat an earlier line.

    docs has doc (order of the texts), dk (key of the row) and text. A line goes if any earlier line, whether that stays
    or not, has a Jaccard similarity of threshold or more to it. Lines with equal sets of words are settled first, by the
    hashes of their sets: within a chunk, within a task by a table of recent lines, then over the corpus, so that a line of
    a third of all texts is about one row a task there and one line afterwards. Sets so small that only an equal set can be
    similar end there. The others send their prefix (their rarest words) to the task of each word, with a sketch. There
    each line gets one earlier line that passes the length, positional and sketch filters: the one nearest by sketch. So a
    group of thousands of near copies gives a pair a line, not all pairs. The sets of each pair decide. Lines whose pair
    fails though they had more are asked again for every candidate.

    Ranges of sets and of keys grow with the square root of the input from least_mb to most_mb, which bounds a task's memory.
    """
    mb = input_mb(docs, "text")
    classes = frequency_classes(docs, 1 << min(26, max(20, int(mb * 8192).bit_length())))
    join = Join(threshold, classes, max(32, int(mb / min(most_mb, max(least_mb, mb**0.5 / 4))) + 1))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            lines = Lines(texts_of(batch, "text"))
            lists = batch.column("lines")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            asked = owner.astype(np.int64) << 32 | lists.flatten().to_numpy().astype(np.int64)
            row = np.flatnonzero(np.isin(lines.text << 32 | lines.number, asked))
            size = lines.size[row]
            flat = np.arange(size.sum()) + np.repeat(lines.start[row] - (np.cumsum(size) - size), size)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            words_of = pa.ListArray.from_arrays(pa.array(ends), pa.array(lines.token[flat].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("dk").to_numpy()[lines.text[row]]), pa.array(lines.number[row].astype(np.int32)), words_of], ["dk", "line", "words"])

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs with hit: whether their sets are as similar as the threshold asks."""
        ends = pairs.select("dk", "line").union(pairs.select("other_dk", "other_line")).distinct()
        ends = ends.groupBy("dk").agg(F.collect_list("line").alias("lines"))  # a text's own lines
        texts = docs.select("dk", "text").join(ends.hint("shuffle_hash"), "dk")
        found = materialize(texts.mapInArrow(sets, "dk long, line int, words array<long>"), "sets")
        other = found.select(F.col("dk").alias("other_dk"), F.col("line").alias("other_line"), F.col("words").alias("other_words"))
        both = materialize(pairs.join(found, ["dk", "line"]), "pairs")
        met = both.join(other, ["other_dk", "other_line"])
        common = F.size(F.array_intersect("words", "other_words"))
        out = met.select("dk", "line", "more", (common >= threshold * (F.size("words") + F.size("other_words") - common) - 1e-9).alias("hit"))
        out = materialize(out, "tested")
        discard(found, both)
        return out

    slim = docs.select("doc", "dk", "text")
    lines = materialize(slim.mapInArrow(join.gather, LINES).groupBy("bucket").applyInArrow(lambda group: join.settle(group), LINES), "lines")
    gone = lines.select(*GONE).mapInArrow(gone_rows, "dk long, line int")
    # One candidate for each line: the nearest sketch.
    rows = lines.drop(*GONE).mapInArrow(join.post(), POSTINGS).groupBy("bucket").applyInArrow(lambda group: join.best(group), PAIRS)
    order = F.struct("distance", "other_dk", "other_line")
    seen = F.min(F.struct("other_dk", "other_line")) != F.max(F.struct("other_dk", "other_line"))
    pairs = rows.groupBy("dk", "line").agg(F.min(order).alias("b"), (F.max("more") | seen).alias("more"))
    pairs = materialize(pairs.select("dk", "line", "b.other_dk", "b.other_line", "more"), "pairs")
    tested = verified(pairs)
    gone = gone.union(tested.where("hit").select("dk", "line"))
    open_lines = materialize(tested.where("not hit and more").select("dk", "line").distinct(), "open")
    if not open_lines.isEmpty():
        others = materialize(every_candidate(slim, lines, open_lines, join), "pairs")
        again = verified(others)
        gone = gone.union(again.where("hit").select("dk", "line"))
    out = materialize(gone.distinct().groupBy("dk").agg(F.collect_list("line").alias("lines")), "gone")
    discard(lines, pairs, tested, open_lines)
    return out


#: Bits of the map of keys that are asked for: a megabyte. Keys that share a bit are sent for nothing.
ASKED_BITS = 23


def _bits(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = (bytesums.mix(keys) & np.uint64((1 << ASKED_BITS) - 1)).astype(np.int64)
    return (bitmap[slot >> 3] >> (slot & 7) & 1).astype(bool)


def every_candidate(slim: DataFrame, lines: DataFrame, open_lines: DataFrame, join: Join) -> DataFrame:
    """All candidates of the open lines: each range of keys meets the open lines' own postings, wherever they are.

    A bitmap of 2**ASKED_BITS bits tells the tasks which keys may be asked for, so that few others are sent.
    """
    asked = open_lines.groupBy("dk").agg(F.collect_list("line").alias("lines"))
    texts = slim.join(asked, "dk")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            own, x = join.read(batch)
            lists = batch.column("lines")
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            wanted = owner.astype(np.int64) << 32 | lists.flatten().to_numpy().astype(np.int64)
            row = np.flatnonzero(np.isin(own.text << 32 | own.number, wanted))
            if not len(row):
                continue
            for part in join.posted({c: v[row] for c, v in x.items()}, join.tokens(own, row)).to_pylist():
                keys = np.unique(np.frombuffer(part["key"], "<u8"))
                who = np.stack([np.frombuffer(part["dk"], "<i8"), np.frombuffer(part["line"], "<u4").astype(np.int64)], axis=1)
                values = ((part["bucket"], pa.int32()), (keys.tobytes(), pa.binary()), (np.unique(who, axis=0).tobytes(), pa.binary()))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in values], ["bucket", "asked", "lines"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys in batch.column("asked").to_pylist():
                slot = np.unique(bytesums.mix(np.frombuffer(keys, "<u8")) & np.uint64((1 << ASKED_BITS) - 1))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32))], ["slot"])

    questions = materialize(texts.mapInArrow(mine, "bucket int, asked binary, lines binary"), "questions")
    slot = questions.select("asked").mapInArrow(slots, "slot int").distinct().toArrow().column("slot").to_numpy()  # 2**ASKED_BITS at most
    bitmap = np.zeros(1 << (ASKED_BITS - 3), np.uint8)
    np.bitwise_or.at(bitmap, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))

    def answer(group: pa.Table, question: pa.Table) -> pa.Table:
        empty = pair_table({"dk": np.zeros(0, np.int64), "line": np.zeros(0, np.int32)}, *[np.zeros(0, np.int64)] * 2, np.zeros(0, np.int32), np.zeros(0, bool))
        if not group.num_rows or not question.num_rows:
            return empty
        keys = np.unique(np.concatenate([np.frombuffer(q, "<u8") for q in question.column("asked").to_pylist()]))
        who = np.unique(np.concatenate([np.frombuffer(q, "<i8").reshape(-1, 2) for q in question.column("lines").to_pylist()]), axis=0)
        x = join.postings(group)
        own = np.isin(x["key"], keys)
        x = {c: v[own] for c, v in x.items()}
        wanted = np.zeros(len(x["dk"]), bool)
        ids = np.stack([x["dk"], x["line"].astype(np.int64)], axis=1)
        if len(ids):
            known, inverse = np.unique(np.concatenate([who, ids]), axis=0, return_inverse=True)
            wanted = np.isin(inverse.ravel()[len(who) :], inverse.ravel()[: len(who)])
        out = [pair_table(x, *(v[wanted[late]] for v in (late, early, distance, more))) for late, early, distance, more in candidates(x, join.threshold, True)]
        return pa.concat_tables([empty, *out])

    postings = lines.drop(*GONE).mapInArrow(join.post(bitmap), POSTINGS)
    pairs = postings.groupBy("bucket").cogroup(questions.groupBy("bucket")).applyInArrow(answer, PAIRS)
    return pairs.select("dk", "line", "other_dk", "other_line", "more").dropDuplicates(["dk", "line", "other_dk", "other_line"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.coalesce(F.col(id_col), F.lit(LAST)).cast("long").alias("doc"), F.xxhash64(F.col(id_col), text).alias("dk"), text.alias("text")]


def _kept(text: bytes, gone: list[int]) -> tuple[int, bytes]:
    parts = text.split(b"\n")
    out = set(gone)
    return len(parts), b"\n".join([x for i, x in enumerate(parts) if i not in out])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each row.

    Lines are what line feeds part; their tokens are the lower-cased words as a set. See removed_lines().

    Null or empty text: one line without words, which stays, as all blank lines do. Ties: of equal lines the first in
    (doc_id, line) order stays. Null ids come last in that order. Rows that repeat an id and its text are one document
    with one result; lines at the same place of different texts of one id don't remove each other. Empty table: no rows.
    Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), *_keyed(docs, id_col, text_col))
    gone = removed_lines(slim, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            rows = []
            for text, lines in zip(texts_of(batch, "text"), batch.column("lines").to_pylist(), strict=True):
                n, kept = _kept(text, lines) if lines else (text.count(b"\n") + 1, text)
                rows.append((n, len(lines or ()), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_lines", "n_removed", "kept_sha256"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.join(gone.hint("shuffle_hash"), "dk", "left").select("doc_id", "text", "lines").mapInArrow(run, f"doc_id {kind}, n_lines long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8) -> DataFrame:
    """docs, all rows and columns, without the lines that repeat an earlier line; texts that lose none stay as they are."""
    keys = _keyed(docs, id_col, text_col)
    key, lines = unused(docs, "dk", "lines")
    gone = removed_lines(docs.select(*keys), threshold).select(F.col("dk").alias(key), F.col("lines").alias(lines))
    joined = docs.withColumn(key, F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))).join(gone, key, "left")
    stays = F.filter(F.split(text_col, "\n", -1), lambda x, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(stays, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
