"""The pipeline's stages on the sample tables: each against what its operator decides on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from strandline.llm import quality
from strandline.llm.common import table
from tests.llm.conftest import SF
from tests.llm.test_texts import base_spans, jaccard_first, lines_expected

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The documents, then what each stage returned, written and read again."""
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(steps, spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "secret_scan", "packing"]
    assert all(d.columns == COLUMNS for d in steps[:-1])
    scores = {r.doc_id: r.score for r in quality.classify(steps[0], table(spark, SF, "labels")).collect()}
    good = rows(steps[1])
    assert sorted(i for i, _ in good) == sorted(i for i, s in scores.items() if s >= 0.5)
    expected = lines_expected(good)
    assert sorted(rows(steps[2])) == sorted((i, expected[i, t][2]) for i, t in good)
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())
    kept, before = rows(steps[3]), dict(rows(steps[2]))
    assert sorted(i for i, _ in kept) == jaccard_first(rows(steps[2])) and all(before[i] == t for i, t in kept)
    clear = dict(rows(steps[4]))
    for i, t in rows(steps[3]):
        assert not base_spans(clear[i]) and (not base_spans(t) or clear[i] != t)
        at = 0
        for part in clear[i].split("[SECRET]"):  # what isn't masked stays, in order
            at = t.index(part, at) + len(part)
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == set(clear)
    assert {i: sum(r.length for r in pieces if r.doc_id == i) for i in clear} == {r.doc_id: r.doc_tokens for r in pieces}


def test_run_is_the_stages(steps, spark):
    got = corpus_pipeline.run(spark, SF)
    key = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert key(got) == key(steps[5]) and np.all([r.offset == 0 for r in got.collect()])
