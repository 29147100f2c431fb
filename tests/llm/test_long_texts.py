"""The operators on documents with very long texts against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from strandline.llm import lines, lmscore, packing, quality, secrets, sentencepieces, shingles, simhash, suffixes
from strandline.llm.common import table

from tests.llm.conftest import SF
from tests.llm.test_texts import base_spans, form, jaccard_first, lines_expected, lm_expected, simhash_expected, suffix_expected

LINES = 6000


def long_text(rng):
    """Lines of rare words, some of which stand twice, some with a secret."""
    out = []
    for i in range(LINES):
        line = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(6, 20))]
        if i % 500 == 7:
            line.append(f"password = 'Xy{rng.randrange(10**14):014d}'")
        out.append(rng.choice(out) if i % 40 == 39 else " ".join(line))
    return "\n".join(out)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    first = long_text(rng)
    near = first.split(" ")
    for at in rng.sample(range(len(near)), 30):
        near[at] = "changed"
    return [(3, first), (4, " ".join(near)), (5, "x" * 300_000), (6, first[200_000:200_400]), (7, None), (8, "short")]


@pytest.fixture(scope="module")
def long_docs(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string").repartition(2)


def test_lm(long_docs, data):
    got = lmscore.score(long_docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    for r, want in zip(sorted(got, key=str), sorted(lm_expected(data), key=str), strict=True):
        assert tuple(r)[:-2] == want[:-2] and np.allclose(tuple(r)[-2:], want[-2:], rtol=1e-9, atol=1e-5)


def test_lines(long_docs, data):
    expected = lines_expected(data)
    got = {r.doc_id: r for r in lines.without_repeats(long_docs).collect()}
    assert {i: r.text or "" for i, r in got.items()} == {i: expected[i, t or ""][2] for i, t in data}
    assert len(got[3].text.split("\n")) < LINES and len(got[4].text) < len(got[3].text) / 10


def test_suffixes(long_docs, data):
    expected = suffix_expected(data)
    got = {r.doc_id: tuple(r)[1:-1] for r in suffixes.dedup(long_docs, with_text=True).collect()}
    assert got == {i: expected[i, (t or "").encode()][:-1] for i, t in data}


def test_quality(spark, long_docs, data):
    """Texts of more passages than a fit takes are scored too."""
    labels = table(spark, SF, "labels")
    docs = table(spark, SF, "documents").select("doc_id", "text").where("doc_id > 8").union(long_docs)
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).where("doc_id < 9").collect()}
    assert set(got) == {i for i, _ in data} | {r.doc_id for r in docs.where("doc_id < 9").select("doc_id").collect()}
    assert all(0 <= s <= 1 for s in got.values())


def test_secrets(long_docs, data):
    got = {r.doc_id: r for r in secrets.scan(long_docs).collect()}
    for i, t in data:
        assert got[i].base_sha256 == hashlib.sha256(form(base_spans(t or "")).encode()).hexdigest()
    assert got[3].n_assign >= LINES // 500
    clear = {r.doc_id: r.text for r in secrets.redact(long_docs).collect()}
    assert not base_spans(clear[3]) and clear[3].count("[SECRET]") == got[3].spans.count(",") + 1 and clear[5] == data[2][1]


def test_near_duplicates(long_docs, data):
    assert sorted((tuple(r) for r in simhash.near_duplicates(long_docs).collect()), key=str) == simhash_expected(data)
    assert sorted(r.doc_id for r in shingles.first_of_each(long_docs).collect()) == jaccard_first(data)


def test_packing(long_docs, data):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    pieces = defaultdict(list)
    for r in packing.pack(long_docs, with_ids=True).orderBy("doc_id", "start").collect():
        pieces[r.doc_id] += r.ids
    assert pieces == {i: [*slow.encode(t or "", add_special_tokens=False).ids, 0] for i, t in data}


def test_sentencepieces(long_docs, data):
    encoded = sentencepieces.encode(long_docs)
    assert {r.doc_id: r.text for r in sentencepieces.decode(encoded).collect()} == {i: t or "" for i, t in data}
