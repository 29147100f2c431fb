"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import chunks, table

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED = 400_000


class Codec:
    """Encoder and decoder of one model file.

    Encoding maximises the sum of the piece scores (ties: the longer last piece). A character that no piece covers
    costs the lowest score less UNKNOWN_PENALTY and becomes its byte pieces. The automaton reads each character once;
    its output links give every piece that ends there, and each relaxes the best score of that position.
    """

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.silent = {i for i in range(size) if model.is_control(i)}
        self.unknown = model.unk_id()
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in normal}
        self.unknown_score = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (len(self.pieces[i]), i, scores[i]))
        self.automaton.make_automaton()
        self.characters = {self.pieces[i] for i in normal if len(self.pieces[i]) == 1}
        self.special = self.byte_of.keys() | self.silent
        # Pieces hold a space mark only in front, so the best path of a text is that of its words one after another.
        split = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal)
        # A line feed that no piece holds is an unknown arc by itself, so it parts words too.
        feed = "" if any("\n" in self.pieces[i] for i in normal) else "\n"
        self.words = re.compile(f"{SPACE}+[^{SPACE}{feed}]*|[^{SPACE}{feed}]+" + "|\n" * bool(feed) if split else r"(?s:.+)")
        self.known: dict[str, tuple[list[int], float]] = {}

    def viterbi(self, word: str) -> tuple[list[int], float]:
        n = len(word)
        best, start_of, piece_of = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        if self.characters.issuperset(word):
            for last, (length, piece, score) in self.automaton.iter(word):
                if (s := best[last + 1 - length] + score) > best[last + 1]:
                    best[last + 1], start_of[last + 1], piece_of[last + 1] = s, last + 1 - length, piece
        else:
            self._with_unknown(word, best, start_of, piece_of)
        out: list[int] = []
        at = n
        while at:
            start, piece = start_of[at], piece_of[at]
            if piece >= 0:
                out.append(piece)
            elif self.bytes:
                out.extend(self.bytes[b] for b in reversed(word[start:at].encode()))
            else:
                out.append(self.unknown)
            at = start
        return out[::-1], best[n]

    def _with_unknown(self, word: str, best: list[float], start_of: list[int], piece_of: list[int]) -> None:
        """The same pass for a word with characters that no piece covers: each such end also has an unknown arc."""

        def settle(end: int) -> None:
            if word[end - 1] not in self.characters and (s := best[end - 1] + self.unknown_score) > best[end]:
                best[end], start_of[end], piece_of[end] = s, end - 1, -1

        done = 0  # ends up to here have been settled
        for last, (length, piece, score) in self.automaton.iter(word):
            while done < last:
                done += 1
                settle(done)
            if (s := best[last + 1 - length] + score) > best[last + 1]:
                best[last + 1], start_of[last + 1], piece_of[last + 1] = s, last + 1 - length, piece
        while done < len(word):
            done += 1
            settle(done)

    def encode(self, text: str) -> tuple[list[int], float]:
        """Ids and score; an empty text has none and 0."""
        ids: list[int] = []
        total, known = 0.0, self.known
        if not text:
            return ids, total
        for word in self.words.findall(SPACE + text.replace(" ", SPACE)):
            found = known.get(word)
            if found is None:
                found = self.viterbi(word)
                if len(word) <= 64:
                    if len(known) >= CACHED:
                        known.clear()
                    known[word] = found
            ids += found[0]
            total += found[1]
        return ids, total

    def decode(self, ids: list[int]) -> str:
        """The text of ids; space marks are spaces, invalid byte sequences U+FFFD, the mark put in front is taken off."""
        byte_of, pieces = self.byte_of, self.pieces
        if self.special.isdisjoint(ids):
            text = "".join([pieces[i] for i in ids])
        else:
            text = b"".join([bytes([byte_of[i]]) if i in byte_of else b"" if i in self.silent else pieces[i].encode() for i in ids]).decode(errors="replace")
        return text.replace(SPACE, " ").removeprefix(" ")


@cache
def codec(model_path: str) -> Codec:
    """One for each worker process."""
    return Codec(model_path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, digest: bool = False) -> DataFrame:
    """One row per document: doc_id, ids array<int>, score double.

    With digest, instead of the ids: n_ids, ids_crc32 (unsigned little-endian 32-bit ids), score, decoded_sha256 (of the
    text decoded from the ids) and round_trip (whether that is the text).

    Null or empty text: no ids, score 0. Texts holding U+2581 decode to spaces there. Whole texts of any length are
    read in one pass; null ids, repeated rows: each row by itself. Empty table: no rows. Other columns are not read.
    """
    model_path = str(model_path or public_tokenizers.path("piece_bpe_32k.model"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        for batch in chunks(batches, "text", 2 << 20):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            if not digest:
                found = [model.encode(x) for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "ids", "score"])
                continue
            rows = []
            for text in texts:
                ids, score = model.encode(text)
                back = model.decode(ids)
                rows.append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), score, hashlib.sha256(back.encode()).hexdigest(), back == text))
            columns = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_ids", "ids_crc32", "score", "decoded_sha256", "round_trip"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    rest = "n_ids long, ids_crc32 long, score double, decoded_sha256 string, round_trip boolean" if digest else "ids array<int>, score double"
    return slim.mapInArrow(run, f"doc_id {kind}, {rest}")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model_path: str | None = None) -> DataFrame:
    """One row per row of ids: doc_id, text. Null ids decode to the empty text."""
    model_path = str(model_path or public_tokenizers.path("piece_bpe_32k.model"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = codec(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([model.decode(x or []) for x in part.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    slim = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), digest=True)
