"""Substring dedup: windows of words that also start earlier are removed, exactly.

Seed: each window of ``WINDOW`` words selects an anchor, the leftmost of its
``GRAM``-word shingles with the least fingerprint (winnowing), so equal windows
select equal anchors. Windows in a row with one anchor are a *run*; runs hold
about seven windows, and only runs travel.

Extend: equal runs (anchor and all words to both ends) match as a whole. All but
the earliest repeat in full. An anchor with different runs around it is a place
where matches end, and there the windows themselves are compared: the first of
equal windows stays, every other one is a repeat. Covered words are the union of
repeated windows, which is the union of all maximal repeats of ``WINDOW`` words or
more without their first occurrences.

Hot groups: a slice of input keeps the first of its equal runs or windows and
settles the others in place, and sends one run for each anchor; so a key reaches a
task once per slice at most, however often it occurs.

Identity: runs and windows are compared by two independent chains of 64 bits over the
halves of their words' digests (``_words.digests``), each word mixed in anew. Two
different windows among 10**13 agree in both with probability under 1e-12.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathspring.llm._store import arrow, shuffle_partitions, written
from pathspring.llm._words import SPACED, U64, Words, grams, mix, ranges, slices, text_bytes

WINDOW = 20
GRAM = 8
BUCKET_BYTES = 32 << 20
"""Bytes of text whose runs, windows or places are in a bucket, about: buckets are worked on one by one, and become more with the data."""

# What travels, column by column: runs, places in documents, windows.
_RUN = (("anchor", np.uint64), ("m1", np.uint64), ("m2", np.uint64), ("doc", np.int64), ("start", np.int32), ("windows", np.int32), ("mixed", np.uint8))
_PLACE = (("doc", np.int64), ("start", np.int32), ("windows", np.int32), ("open", np.uint8))
_WINDOW = (("w1", np.uint64), ("w2", np.uint64), ("doc", np.int64), ("start", np.int32))


def _pack(columns: dict[str, np.ndarray], kinds, which) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(columns[c][which], dtype=t).tobytes() for c, t in kinds))


def _unpack(blobs: list[bytes], kinds) -> dict[str, np.ndarray]:
    width = sum(np.dtype(t).itemsize for _, t in kinds)
    parts: dict[str, list] = {c: [np.zeros(0, dtype=t)] for c, t in kinds}
    for blob in blobs:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(data) // width, 0
        for c, t in kinds:
            parts[c].append(np.frombuffer(data, dtype=t, count=n, offset=at))
            at += n * np.dtype(t).itemsize
    return {c: np.concatenate(p) for c, p in parts.items()}


def doc_bucket(doc, n: int):
    """The bucket of a document: the same for NumPy arrays and for columns, without overflow."""
    if isinstance(doc, Column):
        return F.pmod(F.pmod(doc, F.lit(1000003)) * 48271 + F.pmod(F.shiftright(doc, 20), F.lit(1000003)) * 69621, F.lit(2147483647)) % n
    return (doc % 1000003 * 48271 + (doc >> 20) % 1000003 * 69621) % 2147483647 % n


def _dealt(kind: str, columns: dict[str, np.ndarray], kinds, bucket: np.ndarray):
    """Batches of (bucket, kind, blob)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = [(int(bucket[g[0]]), _pack(columns, kinds, g)) for g in np.split(order, cuts) if len(g)]
    if rows:
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int64()), "kind": [kind] * len(rows), "blob": [r[1] for r in rows]})


_BLOBS = "bucket long, kind string, blob binary"


def _places(doc, start, windows, opened) -> dict[str, np.ndarray]:
    return {"doc": np.asarray(doc, dtype=np.int64), "start": start, "windows": windows, "open": np.broadcast_to(np.uint8(opened), np.shape(start))}


def runs_of(words: Words, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, number of windows) of each run; windows by their first word."""
    n = len(words.number)
    none = np.zeros(0, dtype=np.int64)
    if n < window:
        return none.astype(U64), none, none
    g = grams(words.hash, gram)
    span = window - gram + 1
    size = n - window + 1
    least = g[:size].copy()
    for o in range(1, span):
        np.minimum(least, g[o : o + size], out=least)
    place = np.empty(size, dtype=np.int64)
    at = np.arange(size)
    for o in range(span - 1, -1, -1):
        np.copyto(place, at + o, where=g[o : o + size] == least)
    s = np.flatnonzero(at + window <= words.stop()[:size])
    if not len(s):
        return none.astype(U64), none, none
    new = np.ones(len(s), dtype=bool)
    new[1:] = (np.diff(s) != 1) | (place[s[1:]] != place[s[:-1]])
    first = np.flatnonzero(new)
    return least[s[first]], s[first], np.diff(np.append(first, len(s)))


def _find_runs(buckets: int, window: int, gram: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                w = Words(part.column("text"), SPACED)
                anchor, lo, count = runs_of(w, window, gram)
                if not len(lo):
                    continue
                m1, m2 = ranges(w.hash, lo, count + window - 1), ranges(w.other, lo, count + window - 1, 1)
                local = w.doc()[lo]
                doc, start = ids[local], lo - w.ptr[local]
                order = np.lexsort((start, doc, m2, m1, anchor))
                anchor, m1, m2, doc, start, count = (x[order] for x in (anchor, m1, m2, doc, start, count))
                next_anchor = _new(anchor)
                leader = next_anchor | _new(m1) | _new(m2)
                later = _later(leader, doc, start)
                yield from _dealt("place", _places(doc[later], start[later], count[later], 0), _PLACE, doc_bucket(doc[later], buckets))
                anchor, m1, m2, doc, start, count, next_anchor = (x[leader] for x in (anchor, m1, m2, doc, start, count, next_anchor))
                group = np.cumsum(next_anchor) - 1
                mixed = np.bincount(group)[group] > 1
                yield from _dealt("place", _places(doc[mixed], start[mixed], count[mixed], 1), _PLACE, doc_bucket(doc[mixed], buckets))
                sent = next_anchor
                yield from _dealt("run", {"anchor": anchor[sent], "m1": m1[sent], "m2": m2[sent], "doc": doc[sent], "start": start[sent], "windows": count[sent], "mixed": mixed[sent].astype(np.uint8)}, _RUN, (mix(anchor[sent]) % U64(buckets)).astype(np.int64))

    return run


def _by_bucket(batches):
    """(bucket, {kind: blobs}) for each bucket of sorted rows."""
    bucket, held = None, {}
    for batch in batches:
        for b, kind, blob in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "blob"))):
            if b != bucket:
                if held:
                    yield bucket, held
                bucket, held = b, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield bucket, held


def _match_runs(buckets: int):
    """Runs of all slices: what repeats in full (place, not open) and what is to be compared window by window (open)."""

    def run(batches):
        for bucket, held in _by_bucket(batches):
            for blob in held.get("place", []):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "kind": ["place"], "blob": [blob]})
            r = _unpack(held.get("run", []), _RUN)
            if not len(r["doc"]):
                continue
            order = np.lexsort((r["start"], r["doc"], r["m2"], r["m1"], r["anchor"]))
            r = {c: x[order] for c, x in r.items()}
            next_anchor = _new(r["anchor"])
            leader = next_anchor | _new(r["m1"]) | _new(r["m2"])
            group = np.cumsum(next_anchor) - 1
            opened = (np.bincount(group, weights=leader) > 1) | (np.bincount(group, weights=r["mixed"]) > 0)
            opened = opened[group] & leader & (r["mixed"] == 0)
            out = _later(leader, r["doc"], r["start"]) | opened
            # a run sent for a mixed anchor is open already, and a later equal run repeats anyway
            yield from _dealt("place", _places(r["doc"][out], r["start"][out], r["windows"][out], 0) | {"open": opened[out].astype(np.uint8)}, _PLACE, doc_bucket(r["doc"][out], buckets))

    return run


def _with_texts(docs: DataFrame, places: DataFrame, buckets: int, columns: list[str]) -> DataFrame:
    """Texts (packed) and the places of their documents, together and places first, by bucket."""

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = text_bytes(part.column("text"))
                packed = [pack.compress(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()) if f == "text" else part.column(f) for f in part.schema.names], names=[*part.schema.names])

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.select("doc_id", "text", *columns).schema.fields)
    texts = docs.select("doc_id", "text", *columns).transform(arrow(squeeze, schema))
    bucket = F.coalesce(doc_bucket(F.col("doc_id"), buckets), F.lit(0)).cast("long")
    rest = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(columns)]
    texts = texts.select(bucket.alias("bucket"), F.lit("text").alias("kind"), F.col("text").alias("blob"), "doc_id", *rest)
    both = places.withColumn("doc_id", F.lit(None).cast("long")).unionByName(texts, allowMissingColumns=True)
    return both.repartition(shuffle_partitions(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "kind")


def _texts_of_bucket(batches, kinds=_PLACE):
    """(places of the bucket sorted by document, slice of its text rows); texts are unpacked half a MB at a time."""
    unpack = zstandard.ZstdDecompressor()
    bucket, blobs, places = None, [], None
    for batch in batches:
        texts: list = []
        size = 0
        b, k, blob = (batch.column(c).to_pylist() for c in ("bucket", "kind", "blob"))
        first = 0
        for i in range(batch.num_rows):
            if b[i] != bucket:
                if texts:
                    yield places, batch.slice(first, len(texts)), pa.array(texts, pa.large_string())
                    texts, size = [], 0
                bucket, blobs, places = b[i], [], None
            if k[i] == "place":
                blobs.append(blob[i])
                continue
            if places is None:
                places = _unpack(blobs, kinds)
                order = np.argsort(places["doc"], kind="stable")
                places, blobs = {c: x[order] for c, x in places.items()}, []
            if not texts:
                first = i
            texts.append(unpack.decompress(blob[i]).decode())
            size += len(texts[-1])
            if size > 500_000:
                yield places, batch.slice(first, len(texts)), pa.array(texts, pa.large_string())
                texts, size = [], 0
        if texts:
            yield places, batch.slice(first, len(texts)), pa.array(texts, pa.large_string())


def _spread(places, ids: pa.Array, words: Words, chosen: np.ndarray):
    """For the chosen places of the texts' documents: (index of the text's first word + start, windows, text)."""
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    number = ids.fill_null(0).to_numpy(zero_copy_only=False)
    doc = places["doc"][chosen]
    lo, hi = np.searchsorted(doc, number, "left"), np.searchsorted(doc, number, "right")
    hi = np.where(known, hi, lo)
    text = np.repeat(np.arange(len(number)), hi - lo)
    at = np.arange(len(text)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
    start, count = places["start"][chosen][at].astype(np.int64), places["windows"][chosen][at].astype(np.int64)
    return words.ptr[:-1][text] + start, count, text


def _open_windows(buckets: int, window: int):
    def run(batches):
        for places, rows, texts in _texts_of_bucket(batches):
            chosen = np.flatnonzero(places["open"])
            if not len(chosen):
                continue
            ids = rows.column("doc_id")
            w = Words(texts, SPACED)
            first, count, text = _spread(places, ids, w, chosen)
            inside = first + count + window - 1 <= w.ptr[1:][text]
            first, count, text = first[inside], count[inside], text[inside]
            if not len(first):
                continue
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            text = np.repeat(text, count)
            size = np.full(len(at), window)
            w1, w2 = ranges(w.hash, at, size), ranges(w.other, at, size, 1)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[text]
            start = at - w.ptr[:-1][text]
            yield from _first_windows({"w1": w1, "w2": w2, "doc": doc, "start": start}, buckets, True)

    return run


def _new(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    return np.append(True, x[1:] != x[:-1])


def _later(first: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which of sorted equals start after the first of them. (Rows that repeat a doc_id hold a place twice; neither starts earlier.)"""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    return ~first & ((doc != doc[head]) | (start != start[head]))


def _first_windows(c: dict[str, np.ndarray], buckets: int, send: bool):
    """All but the first of equal windows are repeats; the first ones may be sent on."""
    order = np.lexsort((c["start"], c["doc"], c["w2"], c["w1"]))
    c = {k: x[order] for k, x in c.items()}
    first = _new(c["w1"]) | _new(c["w2"])
    again = _later(first, c["doc"], c["start"])
    yield from _dealt("place", _places(c["doc"][again], c["start"][again], np.ones(again.sum(), dtype=np.int32), 0), _PLACE, doc_bucket(c["doc"][again], buckets))
    if send:
        yield from _dealt("window", {k: x[first] for k, x in c.items()}, _WINDOW, (mix(c["w1"][first]) % U64(buckets)).astype(np.int64))


def _match_windows(buckets: int):
    def run(batches):
        for bucket, held in _by_bucket(batches):
            for blob in held.get("place", []):
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int64()), "kind": ["place"], "blob": [blob]})
            c = _unpack(held.get("window", []), _WINDOW)
            if len(c["doc"]):
                yield from _first_windows(c, buckets, False)

    return run


def _buckets(docs: DataFrame) -> int:
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES)


def _repeats(docs: DataFrame, window: int, gram: int, buckets: int) -> DataFrame:
    """Places of repeated windows, as blobs in their documents' buckets."""
    n = shuffle_partitions(docs.sparkSession)
    known = docs.select("doc_id", "text").filter("doc_id is not null")
    runs = known.transform(arrow(_find_runs(buckets, window, gram), _BLOBS)).repartition(n, "bucket").sortWithinPartitions("bucket")
    places = written(runs.transform(arrow(_match_runs(buckets), _BLOBS)), "run-places")
    windows = _with_texts(known, places, buckets, []).transform(arrow(_open_windows(buckets, window), _BLOBS))
    windows = windows.repartition(n, "bucket").sortWithinPartitions("bucket").transform(arrow(_match_windows(buckets), _BLOBS))
    return places.unionByName(windows)


def _keep(places, rows: pa.RecordBatch, texts: pa.Array, window: int) -> tuple[Words, np.ndarray]:
    """The texts' words, and which of them stay."""
    w = Words(texts, SPACED)
    first, count, text = _spread(places, rows.column("doc_id"), w, np.flatnonzero(places["open"] == 0))
    last = np.minimum(first + count + window - 1, w.ptr[1:][text])
    depth = np.zeros(len(w.number) + 1, dtype=np.int64)
    np.add.at(depth, np.minimum(first, last), 1)
    np.add.at(depth, last, -1)
    return w, np.cumsum(depth[:-1]) == 0


def _joined(data: np.ndarray, w: Words, keep: np.ndarray, i: int) -> bytes:
    """The text's kept words, with one space between."""
    lo, hi = w.ptr[i], w.ptr[i + 1]
    stay = keep[lo:hi]
    if hi == lo or not stay.any():
        return b""
    raw = data[w.start[lo] : w.end[hi - 1]].tobytes().split()
    return b" ".join(raw if stay.all() else [x for x, s in zip(raw, stay.tolist()) if s])


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words, one space between) for each row of documents.

    Null and empty texts have no words. Texts shorter than the window keep all.
    Rows that repeat a doc_id are versions of one document: places count from each
    row's start, equal places in them do not repeat each other, and what is removed
    at a place of one is removed there in all. Rows with a null doc_id take no part
    and keep all their words. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for places, rows, texts in _texts_of_bucket(batches):
            w, keep = _keep(places, rows, texts, window)
            data, _ = text_bytes(texts)
            kept = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(w.ptr[:-1], len(keep)))
            kept[w.counts == 0] = 0
            yield pa.RecordBatch.from_pydict({"doc_id": rows.column("doc_id"), "n_words": pa.array(w.counts, pa.int64()), "n_removed": pa.array(w.counts - kept, pa.int64()), "kept_sha256": [hashlib.sha256(_joined(data, w, keep, i)).hexdigest() for i in range(len(texts))]})

    t = _prepared(docs, id_col, text_col)
    buckets = _buckets(t)
    places = _repeats(t, window, gram, buckets)
    return _with_texts(t, places, buckets, []).transform(arrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with repeated windows' words removed from the text.

    A text that loses nothing stays as it is, null included; of the others the kept
    words stay, one space between. Cases are as in digests().
    """
    buckets = _buckets(_prepared(docs, id_col, text_col))
    places = _repeats(_prepared(docs, id_col, text_col), window, gram, buckets)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    schema = docs.select(id_col, text_col, *others).schema

    def run(batches):
        for places, rows, texts in _texts_of_bucket(batches):
            w, keep = _keep(places, rows, texts, window)
            data, _ = text_bytes(texts)
            out = []
            for i, text in enumerate(texts.to_pylist()):
                whole = keep[w.ptr[i] : w.ptr[i + 1]].all()
                out.append(text if whole else _joined(data, w, keep, i).decode())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(out, pa.string()), *(rows.column(f"x{i}") for i in range(len(others)))], names=[f.name for f in schema.fields])

    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *[F.col(f"`{c}`") for c in others])
    out = _with_texts(t, places, buckets, others).transform(arrow(run, schema))
    return out.select([F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)
), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM g
), gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM r WHERE k > 1
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) FILTER (WHERE gone.p IS NULL) AS words, count(gone.p) AS n_removed, count(*) AS n_words
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p
  GROUP BY x.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""
