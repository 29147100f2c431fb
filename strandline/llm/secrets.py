"""Secret scans: base patterns, and character Markov models of random strings and of ordinary identifiers."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import discard, materialize, table, unused

# The base patterns. Group 1 of assign is what stands before the value, group 2 the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "markov")

#: Stand around and within matches; in texts they become OTHER, which no pattern holds, so that offsets stay.
EDGE, INNER, OTHER = "", "", ""
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
CANDIDATE = "[A-Za-z0-9+/_=-]"
SLICE = 256

Span = "struct<start:int,kind:int,end:int>"


def _starts(lengths: Column) -> Column:
    """Sums of what stands before each length: by slices, so that long lists cost little more than their length."""

    def running(xs: Column, start: Column) -> Column:
        first = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, first, lambda s, x: F.struct((s["at"] + x).cast("int").alias("at"), F.array_append(s["all"], s["at"]).alias("all")))["all"]

    slices = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / SLICE).cast("int")), lambda i: F.slice(lengths, i * SLICE + 1, F.lit(SLICE)))
    totals = F.transform(slices, lambda s: F.aggregate(s, F.lit(0), lambda a, x: (a + x).cast("int")))
    return F.flatten(F.transform(F.arrays_zip(slices.alias("s"), running(totals, F.lit(0)).alias("b")), lambda z: running(z["s"], z["b"])))


def matches(text: Column, pattern: str, kind: int, inner: bool = False, prefilter: str | None = None) -> Column:
    """Spans (start, kind, end; code points) of the leftmost non-overlapping matches of pattern in a text without marks.

    Marks are put around all matches and the text is split at them: every second piece is a match. With inner, the
    pattern has two groups, and matches whose second is shorter than ASSIGN_VALUE are dropped.
    """
    marked = F.regexp_replace(text, pattern, f"{EDGE}$1{INNER}$2{EDGE}" if inner else f"{EDGE}$0{EDGE}")
    pieces = F.split(marked, EDGE, -1)
    lengths = F.transform(pieces, lambda p: (F.length(p) - F.when(p.contains(INNER), 1).otherwise(0)).cast("int"))
    rows = F.arrays_zip(pieces.alias("p"), lengths.alias("n"), _starts(lengths).alias("at"))
    odd = F.filter(rows, lambda r, i: (i % 2 == 1) & (F.length(F.substring_index(r["p"], INNER, -1)) >= ASSIGN_VALUE if inner else F.lit(True)))
    spans = F.transform(odd, lambda r: F.struct(r["at"].alias("start"), F.lit(kind).alias("kind"), (r["at"] + r["n"]).cast("int").alias("end")))
    return F.when(text.rlike(prefilter or pattern), spans.cast(f"array<{Span}>")).otherwise(F.array().cast(f"array<{Span}>"))


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), EDGE + INNER, OTHER + OTHER)


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    return F.array_sort(F.concat(matches(text, ASSIGN, 0, inner=True), matches(text, ACCESS, 1), matches(text, HEX, 2)))


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


BLOCK = 4096


def _blocks(text: Column) -> Column:
    """The text in pieces of BLOCK characters: what is cut out of a long text costs the pieces that it lies in."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _part(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of a text in blocks."""
    piece = lambda i: F.substring(F.get(blocks, i), F.greatest(start - i * BLOCK, F.lit(0)) + 1, F.least(end, (i + 1) * BLOCK) - F.greatest(start, i * BLOCK))
    at = lambda x: F.floor(x / BLOCK).cast("int")
    return F.when(end > start, F.array_join(F.transform(F.sequence(at(start), at(end - 1)), piece), "")).otherwise("")


def _replaced(text: Column, spans: Column, by) -> Column:
    """text with by(span, end of the spans before it) in place of each of the spans (sorted by start)."""

    def run(z: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, x: Column) -> Column:
            out = F.array_append(F.array_append(s["out"], _part(z["blocks"], s["at"], x["start"])), by(x, s["at"]))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

        return F.aggregate(z["spans"], first, step, lambda s: F.array_join(F.array_append(s["out"], _part(z["blocks"], s["at"], z["size"])), ""))

    found = _let(F.struct(_blocks(text).alias("blocks"), spans.alias("spans"), F.length(text).alias("size")), run)
    return F.when(F.size(spans) > 0, found).otherwise(text)


def _cut(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def training_samples(docs: DataFrame, id_col: str, text_col: str, texts: int = 8000, plain: int = 2000) -> DataFrame:
    """s, label: labelled strings that the models learn from.

    Random (1): what the base patterns catch, four strings a text, in a sample of about `texts` texts by the hash of their
    row; and SHA-256 digests written as hexadecimal, upper-case and base-64 text. Ordinary (0): words of 4 to 40 letters,
    200 a text, of about `plain` of the texts in which they catch nothing, alone and joined as identifiers are. The sample
    only fits the two models. It is taken in one reading of the table, in which no pattern runs over other texts.
    """
    order = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 << 32))
    share = lambda most, of: F.lit(min(1 << 32, int(most / max(1, of) * (1 << 32))))
    some = docs.where(order < share(texts, docs.count())).select(order.alias("order"), _clean(F.col(text_col)).alias("t"))
    sample = materialize(some.withColumn("b", base_spans(F.col("t"))), "sample")
    spans = sample.select("t", F.explode(F.slice("b", 1, 4)).alias("s"))
    caught = spans.select(F.regexp_replace(_cut(F.col("t"), F.col("s")), f"^{ASSIGN}$", "$2").alias("s"))
    digest = docs.sparkSession.range(2000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
    made = digest.select(F.explode(F.array("h", F.upper("h"), F.base64(F.unhex("h")))).alias("s"))
    few = F.pmod(F.xxhash64("order"), F.lit(1 << 32)) < share(plain, sample.where("size(b) = 0").count())
    words = sample.where(few & (F.size("b") == 0)).select(F.slice(F.regexp_extract_all("t", F.lit("([A-Za-z]{4,40})"), 1), 1, 200).alias("w"))
    pairs = words.select(F.explode(F.arrays_zip("w", F.slice("w", 2, 200).alias("v"))).alias("z")).select("z.w", F.coalesce("z.v", F.lit("")).alias("v"))
    forms = F.array(F.col("w"), F.concat(F.lower("w"), F.initcap("v")), F.concat_ws("_", F.lower("w"), F.lower("v")), F.upper(F.concat_ws("_", "w", "v")), F.concat_ws("-", F.lower("w"), F.lower("v")))
    ordinary = pairs.select(F.explode(forms).alias("s"))
    out = materialize(caught.union(made).select("s", F.lit(1).alias("label")).union(ordinary.select("s", F.lit(0).alias("label"))), "strings")
    discard(sample)
    return out


def ratios_of(counts: dict[tuple[int, str], int], smoothing: float) -> list[float]:
    """log p_random(b | a) - log p_ordinary(b | a) from counts of (label, ab), for each pair of ALPHABET, row a."""
    out = []
    for a in ALPHABET:
        sums = [sum(counts.get((label, a + b), 0) for b in ALPHABET) + smoothing * len(ALPHABET) for label in (0, 1)]
        for b in ALPHABET:
            ordinary, random = ((counts.get((label, a + b), 0) + smoothing) / sums[label] for label in (0, 1))
            out.append(math.log(random / ordinary))
    return out


def log_ratios(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", smoothing: float = 0.5) -> list[float]:
    """log p_random(b | a) - log p_ordinary(b | a) for each pair of ALPHABET, row a, in nats.

    Transitions are counted by Spark; the counts that come back are two square tables at most.
    """
    strings = training_samples(docs, id_col, text_col)
    steps = strings.where(F.length("s") >= 2).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substring("s", i, F.lit(2)))).alias("ab"))
    counts = {(r.label, r.ab): r.n for r in steps.groupBy("label", "ab").agg(F.count("*").alias("n")).collect() if set(r.ab) <= set(ALPHABET)}
    discard(strings)
    return ratios_of(counts, smoothing)


def _without(text: Column, base: Column) -> Column:
    """text with blanks for what base spans (by start) cover."""
    return _replaced(text, base, lambda x, at: F.repeat(F.lit(" "), F.greatest(x["end"] - F.greatest(x["start"], at), F.lit(0))))


def markov_spans(text: Column, base: Column, ratios: list[float], shortest: int = 20, threshold: float = 0.35, different: int = 8) -> Column:
    """Spans of candidate strings, base spans cut out, that hold `different` characters (rules of dashes don't) and whose
    mean log-likelihood ratio reaches threshold.

    Where a whole run of candidate characters doesn't, as a key behind a long name, its best stretches do: of the parts
    between `=`, `/`, `_` and `-`, those neighbours whose sums of what is beyond the threshold are the highest.
    """
    known = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    n = len(ALPHABET)
    spans = matches(_without(text, base), f"{CANDIDATE}{{{shortest},}}", 3)

    def beyond(string: Column) -> Column:
        """Sum of ratios less the threshold for each."""
        codes = F.transform(F.split(string, ""), _position)
        first = F.struct(F.lit(-1).alias("a"), F.lit(0.0).alias("sum"))
        step = lambda s, c: F.struct(c.alias("a"), (s["sum"] + F.when(s["a"] < 0, 0.0).otherwise(F.get(known, s["a"] * n + c) - threshold)).alias("sum"))
        return F.aggregate(codes, first, step)["sum"]

    def varied(span: Column) -> Column:
        return F.size(F.array_distinct(F.split(_cut(text, span), ""))) >= different

    def stretches(span: Column) -> Column:
        """Each ends where its sum is highest; the next starts where the sum has fallen to zero."""
        parts = F.split(_cut(text, span), "(?<=[=/_-])")
        scored = F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), F.length(own := F.regexp_replace(p, "[=/_-]$", "")).alias("m"), F.when(F.length(own) > 1, beyond(own)).otherwise(0.0).alias("score")))
        none = F.array().cast(f"array<{Span}>")
        first = F.struct(span["start"].alias("at"), span["start"].alias("start"), span["start"].alias("end"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("top"), none.alias("out"))
        closed = lambda s: F.when(s["end"] - s["start"] >= shortest, F.array_append(s["out"], F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))).otherwise(s["out"])

        def step(s: Column, z: Column) -> Column:
            fresh = s["sum"] <= 0
            start, total = F.when(fresh, s["at"]).otherwise(s["start"]), F.when(fresh, z["score"]).otherwise(s["sum"] + z["score"])
            top = F.when(fresh, 0.0).otherwise(s["top"])
            end = F.when(total > top, s["at"] + z["m"]).when(fresh, s["at"]).otherwise(s["end"])
            out = F.when(fresh, closed(s)).otherwise(s["out"])
            return F.struct((s["at"] + z["n"]).cast("int").alias("at"), start.cast("int").alias("start"), end.cast("int").alias("end"), total.alias("sum"), F.greatest(total, top).alias("top"), out.alias("out"))

        return F.aggregate(scored, first, step, closed)

    best = F.transform(F.filter(spans, varied), lambda s: F.when(beyond(_cut(text, s)) >= 0, F.array(s)).otherwise(stretches(s)))
    return F.filter(F.flatten(best), varied)


def _position(c: Column) -> Column:
    """Of a character in ALPHABET."""
    return F.call_function("instr", F.lit(ALPHABET), c).cast("int") - 1


def spans(docs: DataFrame, ratios: list[float], text_col: str = "text", names: tuple[str, ...] = ("_text", "_base", "_spans"), **limits: float) -> DataFrame:
    """docs with three columns added: the text, marks replaced; base spans; all spans, by start, then kind. No shuffle, no
    Python. The names must be those of no column of docs."""
    clean, base, every = names
    with_base = docs.withColumn(clean, _clean(F.col(text_col))).withColumn(base, base_spans(F.col(clean)))
    return with_base.withColumn(every, F.array_sort(F.concat(base, markov_spans(F.col(clean), F.col(base), ratios, **limits))))


def _text_form(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*[F.lit(x) for x in KINDS]), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: list[float] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row.

    Null or empty text: no spans. Null ids and repeated rows: each row by itself. Whole texts of any length are read.
    Empty table: no rows; the models then rest on the digests alone. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = spans(slim, log_ratios(slim) if model is None else model)
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(_text_form(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _text_form(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs, all columns and rows as they are, with every span of its text replaced; spans that overlap by one mask.

    Texts without a span stay as they are, null included.
    """
    names = unused(docs, "clean", "base", "spans")
    found = spans(docs, log_ratios(docs, id_col, text_col), text_col, names)
    clear = _replaced(F.col(text_col), F.col(names[2]), lambda x, at: F.when(x["start"] >= at, mask).otherwise(""))
    return found.select(*[clear.alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
