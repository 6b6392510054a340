"""Scoring by cross-entropy difference of a target and a background n-gram model.

Both models are interpolated word bigrams with exact counts of words, of contexts and
of bigrams, by full 64-bit fingerprints. The background model counts every document,
the target model all labelled good documents. Background counts are scaled to the
target's number of words, so that smoothing weighs the same in both. The vocabulary
is open: it has the corpus's distinct words, and ``2**VOCABULARY_BITS`` at least.

No task holds a model. Documents are written in chunks of a few MB of text (``_chunks``) or one text. Each chunk sends its distinct keys with their counts to buckets of
keys; a bucket adds up what all chunks sent and returns the sums to each of them, and
a chunk scores its documents by these. A key travels once for each chunk that has it,
however many documents do.

A document's score is the mean over its words of background loss minus target
loss (nats): the higher, the more it is like the target.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathspring.llm._chunks import bits, bucket_of, chunked, from_planes, in_order, pack_keys, planes, rows_of, unpack_keys
from pathspring.llm._store import arrow, shuffle_partitions, written
from pathspring.llm._words import SPACED_LOWER, U64, Words, mix

VOCABULARY_BITS = 18
"""The vocabulary has 2 to this power words at least, seen or not."""
BUCKET_CHUNKS = 4
"""A bucket of keys gets as many as so many chunks hold, at most."""
SMOOTHING = 8.0
"""Weight of the unigram model in each bigram estimate, in occurrences of the context."""


def cells(words: Words):
    """Fingerprints of each word, of the word before, and of both; a text's first word follows 0."""
    ids = words.hash
    before = np.zeros_like(ids)
    before[1:] = ids[:-1]
    first = words.ptr[:-1]
    before[first[first < len(ids)]] = 0
    return ids, before, mix(before * U64(0x9E3779B97F4A7C15) + ids + U64(1))


class _Chunk:
    """A chunk's documents, and its distinct keys in order: words (contexts among them) and bigrams."""

    def __init__(self, packed: bytes):
        parts, counts, self.ids = [], [], []
        for part in rows_of(packed):
            words = Words(part.column("text"), SPACED_LOWER)
            parts.append(cells(words))
            counts.append(words.counts)
            self.ids += part.column("doc_id").to_pylist()
        ids, before, pairs = (np.concatenate(x) for x in zip(*parts))
        self.counts = np.concatenate(counts)
        self.words, at = np.unique(np.concatenate([ids, before]), return_inverse=True)
        self.word, self.before = at[: len(ids)], at[len(ids) :]
        self.pairs, self.pair = np.unique(pairs, return_inverse=True)

    def sums(self, target: bytes | None):
        """Counts of the keys in this chunk, each in all rows and in those with a bit in target: of words, of contexts, and of bigrams."""
        chosen = np.zeros(len(self.counts), dtype=bool)
        marks = np.unpackbits(np.frombuffer(target or b"", np.uint8))[: len(chosen)]
        chosen[: len(marks)] = marks
        flags = np.repeat(chosen, self.counts)
        count = lambda at, n: [np.bincount(x, minlength=n).astype(np.uint32) for x in (at, at[flags])]
        return [*count(self.word, len(self.words)), *count(self.before, len(self.words))], count(self.pair, len(self.pairs))


def _send(buckets: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for name, packed, target in in_order(batches, ("chunk", "packed", "target")):
            chunk = _Chunk(packed)
            tables = []
            for keys, sums in zip((chunk.words, chunk.pairs), chunk.sums(target)):
                ends = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1))
                tables.append((keys, sums, ends))
            rows: dict[str, list] = {"bucket": [], "chunk": [], "words": [], "pairs": []}
            for b in np.flatnonzero(sum(np.diff(ends) for _, _, ends in tables)).tolist():
                rows["bucket"].append(b)
                rows["chunk"].append(name)
                for kind, (keys, sums, ends) in zip(("words", "pairs"), tables):
                    span = slice(ends[b], ends[b + 1])
                    rows[kind].append(pack.compress(pack_keys(keys[span]) + b"".join(planes(c[span]) for c in sums)))
            if rows["bucket"]:
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(rows["bucket"], pa.int64()), "chunk": pa.array(rows["chunk"], pa.int64()), "words": pa.array(rows["words"], pa.binary()), "pairs": pa.array(rows["pairs"], pa.binary())})

    return run


def _added(blobs: list[bytes], width: int):
    """The sums of width counts for the keys of all blobs: (distinct keys' sums, each blob's places in them)."""
    keys, counts = [], []
    unpack = zstandard.ZstdDecompressor()
    for blob in blobs:
        data = unpack.decompress(blob)
        n = len(data) // (8 + 4 * width)
        keys.append(unpack_keys(data, n))
        counts.append([from_planes(data, np.uint32, n, (8 + 4 * j) * n) for j in range(width)])
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros((width, len(distinct)), dtype=np.int64)
    for j in range(width):
        np.add.at(sums[j], at, np.concatenate([c[j] for c in counts]).astype(np.int64))
    return sums, np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def _sum(batches):
    pack = zstandard.ZstdCompressor(level=1)
    for bucket, group in itertools.groupby(in_order(batches, ("bucket", "chunk", "words", "pairs")), key=lambda r: r[0]):
        group = list(group)
        words, word_at = _added([r[2] for r in group], 4)
        pairs, pair_at = _added([r[3] for r in group], 2)
        totals = [int((words[0] > 0).sum()), int(words[0].sum()), int(words[1].sum())]
        for row, w, p in zip(group, word_at, pair_at):
            blobs = [pack.compress(planes(sums[:, at])) for sums, at in ((words, w), (pairs, p))]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([row[1]], pa.int64()), "bucket": pa.array([bucket], pa.int64()), "words": [blobs[0]], "pairs": [blobs[1]], "n_distinct": pa.array([totals[0]], pa.int64()), "n_all": pa.array([totals[1]], pa.int64()), "n_target": pa.array([totals[2]], pa.int64())})
            totals = [0, 0, 0]  # once for each bucket


def _score(vocabulary: int, n_all: int, n_target: int, smoothing: float):
    scale = n_target / n_all if n_all else 1.0

    def losses(chunk: _Chunk, words: np.ndarray, pairs: np.ndarray, model: int) -> np.ndarray:
        """-log p for each word: (c(vw) + s p(w)) / (c(v) + s), p(w) smoothed by one half a word."""
        by = 1.0 if model else scale
        unigram = (by * words[model] + 0.5) / (by * (n_target if model else n_all) + 0.5 * vocabulary)
        p = (by * pairs[model][chunk.pair] + smoothing * unigram[chunk.word]) / (by * words[2 + model][chunk.before] + smoothing)
        return -np.log(p)

    def joined(blobs, width: int) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor()
        parts = [from_planes(data, np.int64, len(data) // 8).reshape(width, -1) for data in map(unpack.decompress, blobs)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((width, 0), dtype=np.int64)

    def run(batches):
        for _, group in itertools.groupby(in_order(batches, ("chunk", "words", "pairs", "packed")), key=lambda r: r[0]):
            chunk = _Chunk(next(group)[3])
            group = list(group)
            words, pairs = joined([r[1] for r in group], 4), joined([r[2] for r in group], 2)
            n, end = chunk.counts, np.cumsum(chunk.counts)
            means = []
            for model in (1, 0):
                sums = np.concatenate([[0.0], np.cumsum(losses(chunk, words, pairs, model))])
                means.append((sums[end] - sums[end - n]) / np.maximum(n, 1))
            none = n == 0
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(chunk.ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "target_loss": pa.array(means[0], mask=none), "background_loss": pa.array(means[1], mask=none), "score": pa.array(means[1] - means[0], mask=none)})

    return run


def target_ids(labels: DataFrame) -> DataFrame:
    """doc_id of all labelled documents of good quality without a toxic label."""
    t = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return t.filter("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")


def score(docs: DataFrame, labels: DataFrame, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score for each row of documents.

    Losses are means over the whole text's words; null and empty texts have 0
    tokens and null losses and score. Rows that repeat a doc_id are counted and
    scored each. Of labels that repeat a doc_id the worst counts; null labels
    choose nothing. Other columns are ignored. An empty table gives no rows;
    without labelled rows the target model is uniform.
    """
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chunks = written(t.transform(arrow(chunked("text", "doc_id"), "chunk long, packed binary, ids array<long>")), "chunks")

    partitions = shuffle_partitions(docs.sparkSession)
    buckets = max(partitions, chunks.count() // BUCKET_CHUNKS)
    chosen = chunks.select("chunk", F.posexplode("ids").alias("place", "doc_id")).join(target_ids(labels), "doc_id").groupBy("chunk").agg(F.collect_list("place").alias("places"))
    chosen = chosen.transform(arrow(bits, "chunk long, target binary"))
    both = chunks.select("chunk", "packed").join(F.broadcast(chosen), "chunk", "left")  # a bit for each document: 2 MB for 15 million
    sent = both.transform(arrow(_send(buckets), "bucket long, chunk long, words binary, pairs binary"))
    sent = sent.repartition(partitions, "bucket").sortWithinPartitions("bucket")
    sums = written(sent.transform(arrow(_sum, "chunk long, bucket long, words binary, pairs binary, n_distinct long, n_all long, n_target long")), "counts")
    n = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_distinct", "n_all", "n_target")]).first()

    none = F.lit(None).cast("binary")
    both = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), none.alias("words"), none.alias("pairs"), "packed")
    both = both.unionByName(sums.select("chunk", "bucket", "words", "pairs", none.alias("packed")))
    both = both.repartition(partitions, "chunk").sortWithinPartitions("chunk", "bucket")
    run = _score(max(n["n_distinct"], 1 << VOCABULARY_BITS), n["n_all"], n["n_target"], smoothing)
    return both.transform(arrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double"))
