"""Language-model scoring: a weighted backoff automaton over the smoothed words, pairs and triples of the corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bytesums
from strandline.llm.common import crc_fold, input_mb, materialize, table, texts_of

#: Keys of n-grams are 56 bits above an empty byte, whose lowest bit says, where keys are sorted, whether a token learns.
EMPTY = np.uint64(8)
KEY = ~np.uint64(255)
END = np.uint64(256)  # the end of a text, and the state in which the next text starts
ADD = 0.1
WORDS, PAIRS, TRIPLES = 0, 1, 2
#: Tokens that a lane of the traversal reads, and those before them that bring it into its state.
LANE, WARM = 128, 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, one end after each text's words, and the number of tokens of each text."""
    edges = np.cumsum([0, *map(len, texts)]) >> 21  # a few MB at a time: hashing takes many times the bytes
    cuts = [0, *(np.flatnonzero(np.diff(edges)) + 1).tolist(), len(texts)]
    parts = [_tokens(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data, starts = bytesums.joined(texts)
    data = bytesums.lower(data)
    a, b = bytesums.words(data)
    # The line feed that joined() puts after each text is where its end token stands.
    stops = starts[1:] - 1
    keys = np.full(len(a) + len(stops), END, np.uint64)
    place = np.arange(len(a)) + np.searchsorted(stops, a, side="left")
    keys[place] = bytesums.span_hash(bytesums.prefix(data, 6), a, b) & KEY
    counts = np.diff(np.searchsorted(a, starts)) + 1
    return keys, counts


def ngrams(keys: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Keys of the word, the pair and the triple that end at each token; a text starts after END and its first token ends
    no triple (key 0)."""
    out = [keys]
    for outside in (END, None):
        before = np.concatenate([keys[:1], out[-1][:-1]])
        if outside is not None:
            before[first] = outside
        out.append(bytesums.mix(before * np.uint64(0xD6E8FEB86659FD93) + keys) & KEY)
    out[TRIPLES][first] = 0
    return out


def distinct(keys: np.ndarray, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (0 left out), and how many learning tokens have each."""
    both = np.sort(keys | learns.astype(np.uint64))
    both = both[np.searchsorted(both, END) :]
    own = both & KEY
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), own[1:] != own[:-1]]))
    sums = np.concatenate([[0], np.cumsum((both & np.uint64(1)).astype(np.int64))])
    return own[head], np.diff(sums[np.append(head, len(own))])


def bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The key ranges of equal width that sorted keys fall in."""
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


class Index:
    """Places of keys: dealt by the first bits of their hash, compared in full."""

    def __init__(self, keys: np.ndarray) -> None:
        keys = keys.astype(np.uint64)
        bits = max(1, len(keys).bit_length())
        low = np.uint64((1 << bits) - 1)
        packed = np.sort(bytesums.mix(keys) & ~low | np.arange(len(keys), dtype=np.uint64))
        self.order = (packed & low).astype(np.int32)
        self.keys, self.shift = keys[self.order], np.uint64(64 - bits)
        packed >>= self.shift
        self.start = np.searchsorted(packed, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        keys = keys.astype(np.uint64)
        slot = (bytesums.mix(keys) >> self.shift).astype(np.int64)
        at, end, out = self.start[slot], self.start[slot + 1], np.full(len(keys), -1, np.int32)
        todo = np.flatnonzero(at < end)
        while len(todo):
            here = at[todo]
            hit = self.keys[here] == keys[todo]
            out[todo[hit]] = self.order[here[hit]]
            todo = todo[~hit & (here + 1 < end[todo])]
            at[todo] += 1
        return out


@dataclass
class Model:
    """Dirichlet smoothing: c counts in training, p(w) = (c(w) + ADD) / (total + ADD (types + 1)),
    p(w | v) = (c(vw) + mu[0] p(w)) / (c(v) + mu[0]) and p(w | uv) = (c(uvw) + mu[1] p(w | v)) / (c(uv) + mu[1])."""

    total: int
    types: int
    mu: tuple[float, float]

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + ADD) / (self.total + ADD * (self.types + 1))


class Automaton:
    """The part of the model that a block of texts can reach.

    States are contexts seen in training: 0 the root (no context), 1 + w after word w, 1 + words + p after pair p. An arc
    (state, word) stands for an n-gram seen in training: its weight is the log10 of its smoothed probability, and it leads
    to the longest context that the next word is read in. A state without an arc for a word is left by its failure arc,
    weighted with what is left for unseen words, to the context without its first word; the root has an arc for every
    word, seen or not. All that leaves a state sums to a probability of 1.
    """

    def __init__(self, model: Model, end: int, word_count: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...]) -> None:
        """end: the word that ends a text; pairs: first word, last word, count; triples: pair that it starts with, last word, pair
        that it ends with, count."""
        v, w, pair_count = pairs
        p, last, q, triple_count = triples
        self.words, self.end = (n := len(word_count)), end
        one = model.unigram(word_count)
        two = (pair_count + model.mu[0] * one[w]) / (word_count[v] + model.mu[0])
        three = (triple_count + model.mu[1] * two[q]) / (pair_count[p] + model.mu[1])
        self.root, self.root_to = np.log10(one), np.where(word_count > 0, 1 + np.arange(n), 0)
        seen, known = pair_count > 0, triple_count > 0
        self.arcs = Index(np.concatenate([(np.int64(1) + v[seen]) * n + w[seen], (np.int64(1 + n) + p[known]) * n + last[known]]))
        self.weight = np.log10(np.concatenate([two[seen], three[known]]))
        to, word = np.concatenate([np.flatnonzero(seen), q[known]]), np.concatenate([w[seen], last[known]])
        self.to = np.where(word == end, 1 + end, 1 + n + to).astype(np.int32)  # after an end the next text starts
        self.fail = np.concatenate([np.zeros(1 + n, np.int32), 1 + w.astype(np.int32)])
        self.backoff = np.log10(np.concatenate([[1.0], model.mu[0] / (word_count + model.mu[0]), model.mu[1] / (pair_count + model.mu[1])]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of one word read in each state, and the states after it."""
        state, weight, to = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.flatnonzero(state)
        while len(todo):
            arc = self.arcs.find(state[todo].astype(np.int64) * self.words + word[todo])
            hit = arc >= 0
            weight[todo[hit]] += self.weight[arc[hit]]
            to[todo[hit]] = self.to[arc[hit]]
            todo = todo[~hit]
            weight[todo] += self.backoff[state[todo]]
            state[todo] = self.fail[state[todo]]
            todo = todo[state[todo] > 0]
        root = np.flatnonzero(state == 0)
        weight[root] += self.root[word[root]]
        to[root] = self.root_to[word[root]]
        return weight, to

    def traverse(self, word: np.ndarray, first: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of every token, read from left to right with a carried state; a text starts in that after `end`.

        Lanes advance together, a token a step. A long text is cut into lanes: a state remembers WARM words, so a lane
        that first reads the WARM words before its own, from the root, starts in the state that the lane before ends in.
        """
        lanes = -(-counts // LANE)
        skip = (np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
        start, length = np.repeat(first, lanes) + skip, np.minimum(LANE, np.repeat(counts, lanes) - skip)
        state = np.where(skip == 0, self.root_to[self.end], 0)
        out = np.zeros(len(word))
        for step in range(-WARM, LANE):
            on = np.flatnonzero(length > step) if step >= 0 else np.flatnonzero(skip)
            at = start[on] + step
            weight, state[on] = self.step(state[on], word[at])
            if step >= 0:
                out[at] = weight
        return out


def automaton(model: Model, keys: np.ndarray, first: np.ndarray, counts: list[np.ndarray], places: list[np.ndarray]) -> Automaton:
    """Of the n-grams of a block: places of each token's n-grams among the distinct ones, and the corpus counts of these."""
    word, pair, triple = places
    before = np.concatenate([word[:1], word[:-1]])
    before[first] = end = int(word[np.flatnonzero(keys == END)[0]])
    # Any token that ends an n-gram tells its parts.
    of_pair, of_triple = np.zeros(len(counts[PAIRS]), np.int32), np.zeros(len(counts[TRIPLES]), np.int32)
    at = np.arange(len(keys), dtype=np.int32)
    of_pair[pair] = at
    ends = np.flatnonzero(triple >= 0)
    of_triple[triple[ends]] = ends
    return Automaton(model, end, counts[WORDS], (before[of_pair], word[of_pair], counts[PAIRS]), (pair[of_triple - 1], word[of_triple], pair[of_triple], counts[TRIPLES]))


def _pack(x: np.ndarray) -> bytes:
    """Bytes of equal weight together: those of small numbers compress well that way."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack_keys(x: np.ndarray) -> bytes:
    return _pack(np.diff(x >> EMPTY, prepend=np.uint64(0)))


def _unpack_keys(x: bytes) -> np.ndarray:
    return np.cumsum(_unpack(x), dtype=np.uint64) << EMPTY


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, held: int = 0, mu: tuple[float, float] = (256.0, 32.0), least_mb: float = 1.0, most_mb: float = 8.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Texts whose crc32(id as text) mod folds is `held` are scored only, the others also train. Texts are dealt into blocks
    by a hash. Each block sends its distinct words, pairs and triples, as sorted key ranges, to the task that counts that
    range over the corpus, and gets their counts back: the part of the automaton that its texts reach, whatever the size
    of the whole. Nothing is broadcast or pruned; a frequent n-gram is one key a block. N-grams are known by 56-bit hashes. Triples go in a round of
    their own, so that the disk holds the questions of one round only.

    Blocks and key ranges grow with the square root of the input from least_mb to most_mb (which bounds a task's memory),
    so the packed rows between them, blocks x ranges, are in proportion to the input up to most_mb.

    Null or empty text: the end token alone. Null ids: fold of the empty text. Repeated rows: each counts and is scored.
    Very long texts: read in lanes, see Automaton.traverse(). Without training texts all scores rest on unseen words. Empty
    table: no rows. Other columns are not read.
    """
    mb = input_mb(docs, text_col)
    blocks = buckets = max(32, int(mb / min(most_mb, max(least_mb, mb**0.5 / 6))) + 1)
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), (crc_fold(id_col, folds) == held).alias("held_out"), F.pmod(F.xxhash64(F.col(id_col), text), F.lit(blocks)).cast("int").alias("block"))

    def read(batch: pa.Table, kinds: tuple[int, ...] = (WORDS, PAIRS, TRIPLES)) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], dict[int, tuple[np.ndarray, np.ndarray]]]:
        """Keys and numbers of tokens, n-grams, and the distinct n-grams of each kind with their counts in the block."""
        keys, counts = tokens(texts_of(batch, "text"))
        own = ngrams(keys, np.cumsum(counts) - counts)
        learns = np.repeat(~batch.column("held_out").to_numpy(), counts)
        return keys, counts, own, {k: distinct(own[k], learns) for k in kinds}

    def asked(batch: pa.Table, kinds: tuple[int, ...]) -> pa.Table:
        """Sorted distinct keys of one block, by bucket, with their training counts."""
        block, rows = batch.column("block")[0].as_py(), []
        for kind, (keys, trained) in read(batch, kinds)[-1].items():
            edges = np.searchsorted(bucket(keys, buckets), np.arange(buckets + 1))
            rows += [(kind, i, block, _pack_keys(keys[a:b]), _pack(trained[a:b])) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
        names = ("kind", "bucket", "block", "keys", "counts")
        types = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

    def answer(batch: pa.Table) -> pa.Table:
        """Corpus counts of every asked key of a range, in the order of the question."""
        keys = [_unpack_keys(x) for x in batch.column("keys").to_pylist()]
        known = np.sort(np.concatenate(keys))
        known = known[np.concatenate([[True], known[1:] != known[:-1]])]
        total, places = np.zeros(len(known), np.int64), []
        for own, counts in zip(keys, batch.column("counts").to_pylist(), strict=True):
            places.append(np.searchsorted(known, own).astype(np.int32))
            total[places[-1]] += _unpack(counts).astype(np.int64)
        none = [0] * (len(keys) - 1)
        return pa.table({"block": batch.column("block"), "kind": batch.column("kind"), "bucket": batch.column("bucket"), "totals": pa.array([_pack(total[p]) for p in places], pa.binary()),
                         "types": pa.array([int((total > 0).sum()), *none], pa.int64()), "tokens": pa.array([int(total.sum()), *none], pa.int64())})

    def answered(kinds: tuple[int, ...]) -> DataFrame:
        questions = slim.groupBy("block").applyInArrow(lambda batch: asked(batch, kinds), "kind int, bucket int, block int, keys binary, counts binary")
        return materialize(questions.groupBy("kind", "bucket").applyInArrow(answer, "block int, kind int, bucket int, totals binary, types long, tokens long"), "counts")

    answers = answered((WORDS, PAIRS)).union(answered((TRIPLES,)))
    whole = answers.where(F.col("kind") == WORDS).agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    model = Model(whole["n"] or 0, whole["v"] or 0, mu)

    def run(batch: pa.Table, known: pa.Table) -> pa.Table:
        if not batch.num_rows:
            raise RuntimeError("the texts of a block have changed since its n-grams were counted")
        keys, counts, own, held_here = read(batch)
        known = known.take(pa.array(np.lexsort((known.column("bucket").to_numpy(), known.column("kind").to_numpy()))))
        totals, places = [], []
        for kind in (WORDS, PAIRS, TRIPLES):
            parts = known.filter(pc.equal(known.column("kind"), kind)).column("totals").to_pylist()
            totals.append(np.concatenate([np.zeros(0, np.uint64), *map(_unpack, parts)]).astype(np.int64))
            if len(totals[-1]) != len(held_here[kind][0]):
                raise RuntimeError("the texts of a block have changed since its n-grams were counted")
            places.append(Index(held_here.pop(kind)[0]).find(own[kind]))
        del own
        first = np.cumsum(counts) - counts
        machine = automaton(model, keys, first, totals, places)
        logs = machine.traverse(places[WORDS], first, counts)
        word = totals[WORDS][places[WORDS]]
        names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
        columns = (batch.column("doc_id"), batch.column("held_out"), counts, np.add.reduceat((word > 0).astype(np.int64), first), np.full(len(counts), model.total), np.add.reduceat(np.log10(model.unigram(word)), first), np.add.reduceat(logs, first))
        return pa.table(dict(zip(names, columns, strict=True)))

    kind = slim.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slim.groupBy("block").cogroup(answers.select("block", "kind", "bucket", "totals").groupBy("block")).applyInArrow(run, result)


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
