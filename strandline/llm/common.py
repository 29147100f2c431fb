"""What the operators of this subpackage share: table access, shared scratch space, Arrow chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's setting that frees the shuffle files of a query once it has ended.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Texts are long: fewer rows an Arrow batch than Spark's default keep it small.
BATCH, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def short_batches(spark: SparkSession) -> None:
    if int(spark.conf.get(BATCH)) > ROWS:
        spark.conf.set(BATCH, ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a folder of our own only where that is unset and all run in one process."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("strandline.scratch", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("strandline.scratch", own := tempfile.mkdtemp(prefix="strandline-"))
    return own


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """Queries that run within free their shuffle files when they end."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and lost executors lose nothing.

    What discard() doesn't delete before goes when the application ends: a query's last steps are read after it returns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    with freeing(spark):
        df.write.parquet(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.strandline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.strandline_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def input_mb(df: DataFrame, text: str) -> float:
    """MB of a table by Catalyst's estimate, which for files is their size; where it knows none, half of the texts' bytes.

    It scales the number of blocks with the data.
    """
    known = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if known < 1 << 49:
        return known / 1e6
    return (df.agg(F.sum(F.octet_length(text))).first()[0] or 0) / 2e6


def crc_fold(id_col: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts have about `most` bytes together; one longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]


def grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that are equal in `by`, from sorted batches; a run may span batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
        if rest and any(rest[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in by):
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(edges, edges[1:], strict=False):
            rest.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(rest)
                rest = []
    if rest:
        yield pa.Table.from_batches(rest)


def meet(left: DataFrame, right: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, list[str]]:
    """Rows of both sides (same columns) dealt so that every left row meets every right row of its key in one group.

    Each side of a key is cut into slices of about `limit` rows by a hash of its row, and each pair of slices is a
    group: no task holds a whole hot key. Adds side (0 left, 1 right) and returns the columns that name a group, by
    which the rows are partitioned and sorted.
    """
    n = left.groupBy(*key).agg(F.ceil(F.count("*") / limit).cast("int").alias("nl"))
    m = right.groupBy(*key).agg(F.ceil(F.count("*") / limit).cast("int").alias("nr"))
    sizes = materialize(n.join(m, key), "sizes")
    columns = left.columns
    own = F.xxhash64(*[c for c in columns if c not in key])
    ls = left.join(sizes, key).withColumn("i", F.pmod(own, "nl").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)))
    rs = right.join(sizes, key).withColumn("j", F.pmod(own, "nr").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)))
    both = ls.select(*columns, "i", "j", F.lit(0).alias("side")).unionByName(rs.select(*columns, "i", "j", F.lit(1).alias("side")))
    by = [*key, "i", "j"]
    return both.repartition(*by).sortWithinPartitions(*by), by
