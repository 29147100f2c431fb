"""Packing: each document's ids are cut into pieces whose lengths are powers of two."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import chunks, table

SPECIAL = "<|endoftext|>"
PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long{ids}"


@cache
def encoder(json_path: str, ranks_path: str):
    """Text to ids. The ranks file holds the vocabulary of the JSON file and is read by a faster library, with equal
    ids (tests go through the code points); texts that spell out the special token go to the JSON's own library."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = []  # a large object that few texts need
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if SPECIAL in text:
            if not slow:
                slow.append(Tokenizer.from_file(json_path))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


def binary_lengths(n: int, most: int) -> list[int]:
    """n as full pieces of `most` (a power of two), then the powers of two of the rest, longest first."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if (n % most) >> b & 1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024, end_id: int = 0, with_ids: bool = False,
         json_path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset (and ids if asked for).

    Power-of-two decomposition: a document of n ids (end_id included) becomes n // max_len full pieces and one piece per
    binary digit of the rest. A piece is a sequence by itself, so no sequence crosses documents and nothing is padded;
    `bucket` is the length by which a loader batches equal sequences. No shuffle: pieces need no partner.

    Null or empty text: one piece that holds end_id. Null ids, repeated rows and ids: each row is packed by itself.
    Very long texts: as many full pieces as they need. Empty table: no rows. Other columns are not read.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
    ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(str(json_path), str(ranks_path))
        for batch in chunks(batches, "text", 1 << 20):
            rows, starts, lengths, sums, totals, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.array([end_id], "<u4")).astype("<u4")
                at = 0
                for n in binary_lengths(len(ids), max_len):
                    piece = ids[at : at + n]
                    rows.append(row)
                    starts.append(at)
                    lengths.append(n)
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
                    if with_ids:
                        kept.append(piece)
                    at += n
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                ends = np.cumsum([0, *lengths]).astype("int32")
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept) if kept else np.array([], "<u4")).cast(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECES.format(id=slim.schema["doc_id"].dataType.simpleString(), ids=", ids array<int>" if with_ids else "")
    return slim.mapInArrow(pieces, schema).select(
        "*", F.col("length").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
