"""Queries on the embeddings table against their SQL, to the bit: numbers near a tie, and small negative ones."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import queries as core
from strandline.functions import tensors
from strandline.queries import python, vectors  # noqa: F401  registers the queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """An embeddings table of large numbers, whose sums need doubles, and of small ones of either sign."""
    path = str(tmp_path_factory.mktemp("odd"))
    rng = np.random.default_rng(3)
    large = rng.normal(scale=100, size=(200, 64))
    small = rng.normal(size=(100, 64)) * 10.0 ** rng.integers(-10, 1, (100, 64))
    ties = (rng.integers(-400, 400, (100, 64)) + 0.5) / 1000
    rows = [(i, v, i % 10) for i, v in enumerate(np.concatenate([large, small, ties]).astype(np.float32).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(path + "/embeddings.parquet")
    return path


def same(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    found = con.execute(core.SQL[name])
    names = [d[0] for d in found.description]
    theirs = sorted(map(repr, found.fetchall()))
    ours = sorted(repr(tuple(r)) for r in core.QUERIES[name](spark, folder).select(*names).collect())
    assert ours == theirs and ours


def test_onnx_inference(spark, folder):
    same(spark, folder, "onnx_inference")


def test_declared_inference(spark, folder):
    same(spark, folder, "declared_inference")


@pytest.mark.parametrize("name", ["normalize_and_clip", "letterbox_tensor", "user_data_pack", "pose_decode", "trackable_points", "detection_decode"])
def test_rounded(spark, folder, name):
    same(spark, folder, name)


def test_rounding_of_odd_numbers(spark):
    numbers = [0.0, -0.0, -1e-9, 0.49999999999999994, 0.5, -2.5, 1e300, -1e308, float("inf"), float("-inf"), float("nan"), None, 1.0005, -1.0005, 5e15, 0.285]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    for digits in (0, 2, 3, 9):
        got = [r.y for r in rows.select("i", tensors.rounded(F.col("x"), digits).alias("y")).orderBy("i").collect()]
        sql = duckdb.connect()
        assert [repr(y) for y in got] == [repr(sql.execute("SELECT round(CAST(? AS DOUBLE), CAST(? AS INTEGER))", [x, digits]).fetchone()[0]) for x in numbers]
