"""Quality classifier: perplexity under a Kneser-Ney model of trusted text.

The model is an interpolated modified Kneser-Ney n-gram model of order ``ORDER`` over
characters (Unicode code points, whatever the script). It is fitted on the trusted
(labelled, good, not toxic) documents, from an aggregate of n-gram counts: full counts
in the highest order, numbers of different characters before an n-gram in the lower
ones, three discounts by order, and the uniform distribution over all code points below.

All trusted documents count and all set thresholds, but none is scored by a model that
it trained: a hash deals the ids, and so all documents, into two halves, and each
half is scored by the model of the other half's trusted documents.

Scoring joins counts by shards: a chunk of documents sends the fingerprints of its
distinct n-grams to buckets of keys, where they meet the models' rows of that bucket,
and gets their probabilities and back-off weights back. No task holds a model, and
a key travels once for each chunk and half that has it.

A document is rejected where its perplexity is above its language's quantile of the
trusted documents, in its class of length (texts of
2**k to 2**(k + 1) characters: the fewer characters, the more perplexities vary).
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathspring.llm._chunks import bits, bucket_of, chunked, in_order, pack_keys, pack_some, rows_of, unpack_keys, unpack_some
from pathspring.llm._store import arrow, discard, shuffle_partitions, written
from pathspring.llm._words import U64, mix, slices

ORDER = 4
QUANTILE = 0.995
BINS = 1024
"""Bins of a nat of perplexity in which quantiles are looked for."""
LEAST_HELD_OUT = 200
"""A class of length with fewer held-out documents takes its language's threshold; a language with fewer, that of all."""
BROADCAST_LEVELS = 100_000
"""Thresholds that are broadcast at most; more are joined by a shuffle."""
CHUNK = 16 << 20
"""Bytes of text in a chunk. The larger chunks are, the fewer keys travel; their slices are worked on one by one."""
START = "\uffff"
"""Stands before a text's first characters; no character."""
CODE_POINTS = 0x110000
COUNTED = 2 << 20
"""Characters whose n-grams are told apart at once when the models are counted."""
KEY, HALF = "key_", "half_"
"""Columns of chunks' rows: the doc_id, and the number of the model that scores the row."""

# Characters and n-grams


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' code points (null: none), each text after ORDER - 1 times START, and the number of each text's own."""
    whole = [(t or "") for t in texts.to_pylist()]
    points = np.frombuffer("".join(START * (ORDER - 1) + t for t in whole).encode("utf-32-le"), dtype=np.uint32)
    return points, np.array([len(t) for t in whole], dtype=np.int64)


def _ends(counts: np.ndarray) -> np.ndarray:
    """The place of each text's own code points among all."""
    start = np.cumsum(counts + ORDER - 1) - counts
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(start, counts)


def distinct_grams(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct n-grams of the highest order that end there, one row of code points each; which of them each place has)."""
    known = np.zeros(CODE_POINTS, dtype=bool)
    known[points] = True
    letters = np.flatnonzero(known)
    number = np.zeros(CODE_POINTS, dtype=np.int64)
    number[letters] = np.arange(len(letters))
    small = number[points]
    code, base = small[ends - ORDER + 1], len(letters)
    span = base
    for back in range(ORDER - 2, -1, -1):
        if span * base >= 1 << 62:  # a large alphabet: number what there is before it grows
            coded = pa.array(code).dictionary_encode()
            code, span = coded.indices.to_numpy().astype(np.int64), max(1, len(coded.dictionary))
        code, span = code * base + small[ends - back], span * base
    coded = pa.array(code).dictionary_encode()
    at = coded.indices.to_numpy().astype(np.int64)
    first = np.zeros(len(coded.dictionary), dtype=np.int64)
    first[at[::-1]] = np.arange(len(at))[::-1]
    return points[ends[first][:, None] + np.arange(1 - ORDER, 1)], at


def keys_of(grams: np.ndarray, model: int | np.ndarray = 0) -> np.ndarray:
    """A fingerprint of each row of code points, for a model of that number."""
    total = np.full(len(grams), grams.shape[1], dtype=U64) + U64(2 * ORDER) * np.asarray(model).astype(U64)
    for j in range(grams.shape[1]):
        total = mix(total * U64(0xD6E8FEB86659FD93) + grams[:, j].astype(U64) + U64(1))
    return total


def _strings(grams: np.ndarray) -> list[str]:
    text = grams.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + grams.shape[1]] for i in range(0, len(text), grams.shape[1])]


# The models


def good(labels: DataFrame) -> DataFrame:
    """doc_id of all labelled documents of good quality, not toxic."""
    t = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return t.filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def trusted(labels: DataFrame, rows: int | None = None) -> DataFrame:
    """doc_id of the good documents that train models: all; or, if rows are given, at most so many by the order of a hash, and none of a sixth that is always held out."""
    if rows is None:
        return good(labels)
    t = good(labels).filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(6)) != 0)
    return t.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def half(ids: Column) -> Column:
    """0 or 1, by a hash of the id."""
    return F.pmod(F.xxhash64(ids, F.lit(2)), F.lit(2)).cast("int")


def counts(chunks: DataFrame, text_col: str, models: int) -> DataFrame:
    """model, gram, c: how often each n-gram of the highest order ends in the texts that train a model.

    chunks: packed, and target, a bit for each row that trains (null: all do). Of two
    models a row trains the one that does not score it.
    """

    def grams(model: int, texts: list[pa.Array]):
        points, n = code_points(pa.concat_arrays(texts))
        if n.sum():
            grams, at = distinct_grams(points, _ends(n))
            yield pa.RecordBatch.from_pydict({"model": pa.array(np.full(len(grams), model, dtype=np.int32)), "gram": _strings(grams), "c": pa.array(np.bincount(at, minlength=len(grams)), pa.int64())})

    def run(batches):
        for packed, target in in_order(batches, ("packed", "target")):
            held: dict[int, list] = {m: [] for m in range(models)}
            at, size = 0, [0] * models
            chosen = None if target is None else np.unpackbits(np.frombuffer(target, np.uint8)).astype(bool)
            for rows in rows_of(packed):
                texts, model = rows.column(text_col), models - 1 - rows.column(HALF)[0].as_py()
                if chosen is not None:
                    own = np.zeros(len(texts), dtype=bool)
                    own[: len(chosen[at : at + len(texts)])] = chosen[at : at + len(texts)]
                    at += len(texts)
                    texts = texts.filter(pa.array(own))
                held[model].append(texts)
                size[model] += pc.sum(pc.utf8_length(texts)).as_py() or 0
                if size[model] >= COUNTED:
                    yield from grams(model, held[model])
                    held[model], size[model] = [], 0
            for model, texts in held.items():
                if texts:
                    yield from grams(model, texts)

    return chunks.select("packed", "target").transform(arrow(run, "model int, gram string, c long")).groupBy("model", "gram").agg(F.sum("c").alias("c"))


def _discounts(n: dict[int, int]) -> list[float]:
    """Those of counts 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    return [min(i, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) if n[i] else 0.5 * i for i in (1, 2, 3)]


def kneser_ney(highest: DataFrame, models: int) -> tuple[DataFrame, list[float]]:
    """(model, gram, p, gamma), and by model the probability of a character that its texts do not have.

    p is a seen n-gram's interpolated probability (null where it is a context only), of
    all orders; gamma what an n-gram gives, as a context, to the order below (null where
    it is none). An unseen n-gram has gamma (1 for an unseen context) times the
    probability of the n-gram without its first character. Each order is joined with
    the sums of its contexts and with the order below; no task holds an order.
    """
    tables = {ORDER: highest.select("model", "gram", F.col("c").alias("n"))}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), f"grams-{k}")
    few = functools.reduce(DataFrame.unionByName, [t.select("model", F.lit(k).alias("k"), "n") for k, t in tables.items()])
    few = few.groupBy("model", "k").agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)]).collect()
    discounts = {(r["model"], r["k"]): _discounts({i: r[f"n{i}"] for i in (1, 2, 3, 4)}) for r in few}

    below, rows = None, []
    for k, t in sorted(tables.items()):
        d = F.lit(0.0)
        for model, order in discounts:
            for i, x in enumerate(discounts[model, order], 1):
                d = F.when((F.col("model") == model) & (F.least("n", F.lit(3)) == i), F.lit(x)).otherwise(d) if order == k else d
        t = t.select("*", d.alias("taken"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("suffix"))
        t = t.join(t.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("taken") / F.sum("n")).alias("gamma")), ["model", "context"])
        t = t.withColumn("lower", F.lit(1 / CODE_POINTS)) if below is None else t.join(below.select("model", F.col("gram").alias("suffix"), F.col("p").alias("lower")), ["model", "suffix"])
        p = (F.col("n") - F.col("taken")) / F.col("total") + F.col("gamma") * F.col("lower")
        below = written(t.select("model", "gram", "context", p.alias("p"), "gamma"), f"order-{k}")
        rows.append(below.select("model", "gram", "p", F.lit(None).cast("double").alias("gamma")))
        if k == 1:
            empty = {r["model"]: r["gamma"] for r in below.groupBy("model").agg(F.first("gamma").alias("gamma")).collect()}
        else:
            rows.append(below.select("model", F.col("context").alias("gram"), F.lit(None).cast("double").alias("p"), "gamma"))
    both = functools.reduce(DataFrame.unionByName, rows).groupBy("model", "gram").agg(F.max("p").alias("p"), F.max("gamma").alias("gamma"))
    return both, [empty.get(m, 1.0) / CODE_POINTS for m in range(models)]


# Scores


class _Part:
    """A slice of a chunk's rows, all of one half, with its distinct n-grams of the highest order, and the keys of all orders that it looks up."""

    def __init__(self, rows: pa.RecordBatch, text_col: str):
        self.rows, self.model = rows, rows.column(HALF)[0].as_py()
        points, self.counts = code_points(rows.column(text_col))
        grams, self.at = distinct_grams(points, _ends(self.counts)) if self.counts.sum() else (np.zeros((0, ORDER), dtype=np.uint32), np.zeros(0, dtype=np.int64))
        # by k: the last k characters, and the k characters before the last one
        self.last = {k: keys_of(grams[:, ORDER - k :], self.model) for k in range(1, ORDER + 1)}
        self.before = {k: keys_of(grams[:, ORDER - 1 - k : ORDER - 1], self.model) for k in range(1, ORDER)}

    def keys(self) -> np.ndarray:
        return np.unique(np.concatenate([*self.last.values(), *self.before.values()]))


def _keys(packed: bytes, text_col: str) -> np.ndarray:
    """The distinct keys of a chunk, in rising order."""
    return np.unique(np.concatenate([_Part(rows, text_col).keys() for rows in rows_of(packed)]))


def _send(buckets: int, text_col: str):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for name, packed in in_order(batches, ("chunk", "packed")):
            keys = _keys(packed, text_col)
            ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            held = np.flatnonzero(np.diff(ends)).tolist()
            if held:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "chunk": pa.array([name] * len(held), pa.int64()), "blob": pa.array([pack.compress(pack_keys(keys[ends[b] : ends[b + 1]])) for b in held], pa.binary())})

    return run


def _model_rows(buckets: int):
    """The models' rows, packed by bucket and batch: keys in rising order with p and gamma (NaN for none)."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            model, length = batch.column("model").to_numpy(), pc.utf8_length(batch.column("gram")).to_numpy()
            keys = np.zeros(len(model), dtype=U64)
            for k in range(1, ORDER + 1):
                own = length == k
                text = "".join(batch.column("gram").filter(pa.array(own)).to_pylist())
                keys[own] = keys_of(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(-1, k), model[own])
            p, gamma = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float32) for c in ("p", "gamma"))
            order = np.argsort(keys)
            keys, p, gamma = keys[order], p[order], gamma[order]
            ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
            held = np.flatnonzero(np.diff(ends)).tolist()
            if held:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "chunk": pa.array([-1] * len(held), pa.int64()), "blob": pa.array([pack.compress(b"".join(x[ends[b] : ends[b + 1]].tobytes() for x in (keys, p, gamma))) for b in held], pa.binary())})

    return run


def _look_up(batches):
    """For each chunk's keys of a bucket p and gamma, after the models' rows of the bucket (chunk -1) were read."""
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    bucket, parts, table = None, [], None
    for b, chunk, blob in in_order(batches, ("bucket", "chunk", "blob")):
        if b != bucket:
            bucket, parts, table = b, [], None
        data = unpack.decompress(blob)
        if chunk == -1:
            n = len(data) // 16
            parts.append((np.frombuffer(data, U64, n), np.frombuffer(data, np.float32, n, 8 * n), np.frombuffer(data, np.float32, n, 12 * n)))
            continue
        if table is None:
            none = (np.zeros(0, dtype=U64), np.zeros(0, dtype=np.float32), np.zeros(0, dtype=np.float32))
            keys, p, gamma = (np.concatenate(x) for x in zip(none, *parts))
            order = np.argsort(keys)
            table, parts = (keys[order], p[order], gamma[order]), []
        keys = unpack_keys(data, len(data) // 8)
        at = np.searchsorted(table[0], keys).clip(max=max(0, len(table[0]) - 1))
        seen = table[0][at] == keys if len(table[0]) else np.zeros(len(keys), dtype=bool)
        out = [np.where(seen, x[at] if len(x) else np.nan, np.nan).astype(np.float32) for x in table[1:]]
        yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "bucket": pa.array([b], pa.int64()), "blob": [pack.compress(b"".join(map(pack_some, out)))]})


def _perplexities(unseen: list[float], text_col: str):
    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for _, group in itertools.groupby(in_order(batches, ("chunk", "blob", "packed")), key=lambda r: r[0]):
            packed = next(group)[2]
            keys = _keys(packed, text_col)
            parts: tuple[list, list] = [], []
            for data in (unpack.decompress(r[1]) for r in group):
                at = 0
                for part in parts:
                    values, at = unpack_some(data, np.float32, at)
                    part.append(values)
            p, gamma = (np.concatenate([np.zeros(0), *x]) for x in parts)
            gamma = np.where(np.isnan(gamma), 1.0, gamma)
            for rows in rows_of(packed):
                part = _Part(rows, text_col)
                value = np.full(len(part.last[1]), unseen[part.model])
                for k in range(1, ORDER + 1):
                    own = p[np.searchsorted(keys, part.last[k])]
                    value = np.where(np.isnan(own), value * (gamma[np.searchsorted(keys, part.before[k - 1])] if k > 1 else 1.0), own)
                n, end = part.counts, np.cumsum(part.counts)
                sums = np.concatenate([[0.0], np.cumsum(-np.log(value)[part.at])])
                mean = (sums[end] - sums[end - n]) / np.maximum(n, 1)
                more = {"chars": pa.array(n, pa.int64()), "perplexity": pa.array(np.exp(mean), mask=n == 0)}
                yield pa.RecordBatch.from_arrays([*rows.columns, *more.values()], names=[*rows.schema.names, *more])

    return run


def _scored(rows: DataFrame, text_col: str, fit: DataFrame) -> DataFrame:
    """The rows with chars and perplexity, under the model of the texts (column text) of fit. Column names of rows must not clash with these."""
    one = {KEY: F.lit(None).cast("long"), HALF: F.lit(0)}
    train = _chunks(fit.select("text").withColumns(one), "text").withColumn("target", F.lit(None).cast("binary"))
    rows = rows.withColumns(one)
    return _scores(_chunks(rows, text_col), rows, text_col, counts(train, "text", 1), 1).drop(KEY, HALF)


def _chunks(rows: DataFrame, text_col: str) -> DataFrame:
    """Chunks of rows with KEY and HALF; each of a chunk's slices has rows of one half."""
    pack = chunked(text_col, KEY, limit=CHUNK, level=9, far=True)

    def run(batches):
        yield from pack(own for batch in batches for h in (0, 1) if (own := batch.filter(pc.equal(batch.column(HALF), h))).num_rows)

    return written(rows.transform(arrow(run, "chunk long, packed binary, ids array<long>")), "chunks")


def _training(chunks: DataFrame, fit: DataFrame) -> DataFrame:
    """The chunks that have documents of fit (doc_id), with a bit for each of these. A bit for each document is broadcast."""
    places = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id")).join(fit, "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("places"))
    return chunks.select("chunk", "packed").join(F.broadcast(places.transform(arrow(bits, "chunk long, target binary"))), "chunk")


def _scores(chunks: DataFrame, rows: DataFrame, text_col: str, highest: DataFrame, models: int) -> DataFrame:
    chunks = chunks.select("chunk", "packed")
    model, unseen = kneser_ney(written(highest, "counts"), models)
    partitions = shuffle_partitions(rows.sparkSession)
    blobs = "bucket long, chunk long, blob binary"
    asked = chunks.transform(arrow(_send(partitions, text_col), blobs)).unionByName(model.transform(arrow(_model_rows(partitions), blobs)))
    asked = asked.repartition(partitions, "bucket").sortWithinPartitions("bucket", "chunk")
    answers = asked.transform(arrow(_look_up, "chunk long, bucket long, blob binary"))
    none = F.lit(None).cast("binary")
    both = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), none.alias("blob"), "packed").unionByName(answers.withColumn("packed", none))
    both = both.repartition(partitions, "chunk").sortWithinPartitions("chunk", "bucket")
    schema = rows.schema.add("chars", "long").add("perplexity", "double")
    return both.transform(arrow(_perplexities(unseen, text_col), schema))


# Thresholds


def quantiles(values: DataFrame, quantile: float) -> DataFrame:
    """lang, level, n: the exact quantile of x > 0 by lang (interpolated between ranks), from frame values (lang, x).

    Counts by bin show in which bin the two ranks lie; only these bins' distinct
    values are ordered, so no task holds a language.
    """
    t = values.withColumn("bin", F.floor(F.log("x") * BINS)).groupBy("lang", "bin", "x").agg(F.count("*").alias("times"))
    bins = t.groupBy("lang", "bin").agg(F.sum("times").alias("held"))
    of_lang = Window.partitionBy("lang")
    bins = bins.withColumns({"n": F.sum("held").over(of_lang), "upto": F.sum("held").over(of_lang.orderBy("bin"))})
    bins = bins.withColumn("rank", F.lit(quantile) * (F.col("n") - 1))
    bins = bins.filter((F.col("upto") > F.floor("rank")) & (F.col("upto") - F.col("held") <= F.ceil("rank")))
    bins = bins.select(F.col("lang").alias("of"), F.col("bin").alias("in"), (F.col("upto") - F.col("held")).alias("base"), "n", "rank")
    t = t.join(bins, F.col("lang").eqNullSafe(F.col("of")) & (F.col("bin") == F.col("in")))
    t = t.withColumn("end", F.col("base") + F.sum("times").over(Window.partitionBy("lang", "bin").orderBy("x")))
    at = lambda r: F.max(F.when((r < F.col("end")) & (r >= F.col("end") - F.col("times")), F.col("x")))
    t = t.groupBy("lang", "n", "rank").agg(at(F.floor("rank")).alias("low"), at(F.ceil("rank")).alias("high"))
    return t.select("lang", (F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))).alias("level"), "n")


def length_class(chars: Column) -> Column:
    """k for 2**k to 2**(k + 1) - 1 characters."""
    return F.floor(F.log2(F.greatest(chars, F.lit(1)))).cast("int")


def thresholds(held: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """(lang, class, threshold; class -1 for a whole language), and the threshold of all, from held-out documents (lang, chars, perplexity)."""
    t = held.select("lang", length_class(F.col("chars")).alias("class"), F.col("perplexity").alias("x"))
    known = t.filter("lang is not null")
    parts = known.select(F.struct("lang", "class").alias("lang"), "x").unionByName(known.select(F.struct("lang", F.lit(-1).alias("class")).alias("lang"), "x"))
    levels = quantiles(parts, quantile).filter(F.col("n") >= LEAST_HELD_OUT)
    overall = quantiles(t.select(F.lit("").alias("lang"), "x"), quantile).first()
    return levels.select("lang.lang", "lang.class", F.col("level").alias("threshold")), overall and overall["level"]


def _judged(scored: DataFrame, lang: str, levels: DataFrame, overall: float | None) -> DataFrame:
    """The rows with threshold and accepted."""
    levels = written(levels, "levels")
    few = levels.limit(BROADCAST_LEVELS + 1).count() <= BROADCAST_LEVELS
    t = scored.withColumn("class_", length_class(F.col("chars")))
    for name, of in (("by_class", levels.filter("class >= 0")), ("by_lang", levels.filter("class < 0").drop("class"))):
        of = of.select(F.col("lang").alias("lang_"), *([F.col("class").alias("class__")] if "class" in of.columns else []), F.col("threshold").alias(name))
        on = F.col(lang) == F.col("lang_")
        on = on & (F.col("class_") == F.col("class__")) if "class__" in of.columns else on
        t = t.join(F.broadcast(of) if few else of, on, "left").drop("lang_", "class__")
    t = t.withColumn("threshold", F.coalesce("by_class", "by_lang", F.lit(overall).cast("double"))).drop("by_class", "by_lang", "class_")
    return t.withColumn("accepted", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))


def judge(rows: DataFrame, labels: DataFrame, id_col: str, lang_col: str, text_col: str, held_rows: int | None = None, quantile: float = QUANTILE, keep_text: bool = False) -> DataFrame:
    """The rows with chars, perplexity, threshold and accepted; the text only if it is to be kept.

    Two models, of all trusted documents, score each other's halves. If held_rows are
    given, one model of so many documents at most scores all rows, and the other good
    documents set the thresholds.
    """
    fit = written(trusted(labels, held_rows), "trusted")
    held, models = (fit, 2) if held_rows is None else (good(labels).join(fit, "doc_id", "left_anti"), 1)
    rows = rows.withColumn(KEY, F.col(id_col).cast("long"))
    rows = rows.withColumn(HALF, half(F.col(KEY)) if models == 2 else F.lit(0))
    chunks = _chunks(rows, text_col)
    scored = _scores(chunks, rows, text_col, counts(_training(chunks, fit), text_col, models), models)
    scored = written(scored if keep_text else scored.drop(text_col), "scored")
    discard(chunks)
    held = scored.filter("perplexity is not null").select(F.col(KEY).alias("doc_id"), F.col(lang_col).alias("lang"), "chars", "perplexity").join(held, "doc_id")
    return _judged(scored.drop(KEY, HALF), lang_col, *thresholds(written(held.drop("doc_id"), "held-out"), quantile))


def classify(docs: DataFrame, labels: DataFrame, rows: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, accepted for each row of documents.

    Whole texts are scored. Null and empty texts have null perplexity and are
    accepted, as all is without trusted texts (threshold null). With rows, one model
    of so many trusted documents at most scores all. A null or rare language takes the threshold of all. Rows that repeat a doc_id are judged
    each; null ids and languages stay; other columns are ignored; an empty table gives
    no rows.
    """
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return judge(t, labels, "doc_id", "lang", "text", rows, quantile).select("doc_id", "lang", F.col("chars").alias("n_chars"), "perplexity", "threshold", "accepted")


def keep_accepted(docs: DataFrame, labels: DataFrame, rows: int | None = None, quantile: float = QUANTILE) -> DataFrame:
    """The rows of docs, all columns, without the rejected documents. Rows travel with their columns; nothing is joined by doc_id."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    t = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn(names["lang"], F.col(names["lang"]).cast("string"))
    t = judge(t, labels, names["doc_id"], names["lang"], names["text"], rows, quantile, keep_text=True)
    return t.filter("accepted").select([F.col(n).cast(docs.schema[c].dataType).alias(c) for c, n in names.items()])
