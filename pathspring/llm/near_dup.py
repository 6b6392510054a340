"""Near-duplicates: b-bit MinHash candidates, confirmed on full shingle sets.

1. Each text becomes its set of shingle fingerprints. Texts with equal sets (by a
   BLAKE2b digest over 128 bits for each shingle) are one class; the smallest doc_id
   stands for it.
2. Bands of ``ROWS`` minima make the band keys, as many as the threshold asks for
   (``bands``: 28 at 0.85, 44 at 0.8), so that a pair at the threshold shares no band
   with probability ``MISSED`` at most. ``BITS`` low bits of ``SIGNED`` minima are
   packed as the signature.
3. Classes that meet in a band are tied to the smallest of that band bucket; the
   components of these ties are candidate clusters. No bucket is ever enumerated.
4. A unit of work is ``BLOCK`` or two times ``BLOCK`` classes of a cluster. It
   estimates similarities from the signatures' equal bits, corrected for chance (1 in
   2**BITS), and keeps pairs within ``SLACK`` of the threshold. Signatures travel first;
   only classes with such a pair send their texts, whose sets of real words confirm it.
   A unit returns a spanning forest of the links it finds.
5. A cluster of up to ``BLOCK`` classes is one unit. A larger one is compared with a
   few of its own classes first, ``STARS`` rounds of it: what links to them is one
   component, and within that no pair is looked at again. Only the classes left over
   are compared, in blocks, with each other and with all others.
6. The components of the links, with all members of each class, are the result.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathspring.llm._graph import Union, components, joined
from pathspring.llm._store import arrow, discard, written
from pathspring.llm._words import SPACED_LOWER, U64, Words, grams, mix, sequences, slices

SHINGLE = 5
ROWS = 6
SIGNED = 168
MISSED = 2e-6
BITS = 4
BLOCK = 256
STARS = 3
TOGETHER = 1 << 20
"""Shingles up to which a unit's texts are confirmed all together."""
SLACK = 0.18
"""Distance under the threshold at which an estimate is still confirmed: over five standard errors of 168 minima."""


def bands(threshold: float) -> int:
    """The fewest bands with which a pair at the threshold shares none with probability ``MISSED`` at most, and those that the signature needs at least."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie above 0 and not above 1")
    least = SIGNED // ROWS
    return least if threshold == 1 else max(least, math.ceil(math.log(MISSED) / math.log1p(-(threshold**ROWS))))


@functools.cache
def _multipliers(count: int) -> np.ndarray:
    return (mix(np.arange(1, count + 1, dtype=U64) + U64(0xABCDEF)) | U64(1)).astype(np.uint32) | np.uint32(1)


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> list[tuple[np.ndarray, bytes]]:
    """For each text the sorted distinct shingle fingerprints, and a digest of the set; fewer words than a shingle has are one shingle."""
    w = Words(texts, SPACED_LOWER)
    halves = grams(w.hash, shingle), grams(w.other, shingle, 1)
    out = []
    for start, end in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        n = end - start
        if n >= shingle:
            values, at = np.unique(halves[0][start : end - shingle + 1], return_index=True)
            second = halves[1][start : end - shingle + 1][at]
        else:
            values, second = (grams(h[start:end], n, seed) if n else np.zeros(0, dtype=U64) for seed, h in enumerate((w.hash, w.other)))
        out.append((values, hashlib.blake2b(values.tobytes() + second.tobytes(), digest_size=16).digest()))
    return out


def exact_sets(texts: list[str], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text as numbers: within the list equal numbers are equal words, without any hashing."""
    w = Words(pa.array(texts, pa.large_string()), SPACED_LOWER)
    numbers = sequences(w, shingle)
    short: dict[tuple, int] = {}
    out = []
    for start, end in zip(w.ptr[:-1].tolist(), w.ptr[1:].tolist()):
        if end - start >= shingle:
            out.append(np.unique(numbers[start : end - shingle + 1]))
        else:
            whole = tuple(w.number[start:end].tolist())
            out.append(np.array([-1 - short.setdefault(whole, len(short))] if whole else [], dtype=np.int64))
    return out


def minima(values: np.ndarray, count: int = SIGNED) -> np.ndarray:
    """count minima of multiplied 32-bit fingerprints."""
    low, by = (values >> U64(32)).astype(np.uint32), _multipliers(count)
    least = np.full(count, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        x = low[None, at : at + 2048] * by[:, None]
        x ^= x >> np.uint32(15)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def _band_keys(least: np.ndarray) -> np.ndarray:
    each = least.reshape(-1, ROWS)
    key = np.arange(len(each), dtype=U64) * U64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        key = mix(key + each[:, j].astype(U64))
    return key


def _signature(least: np.ndarray) -> bytes:
    low = (least[:SIGNED] & np.uint32((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << BITS)).tobytes() if BITS == 4 else low.tobytes()


def _fingerprints(shingle: int, count: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in slices(batch, "text"):
                rows: dict[str, list] = {"doc_id": part.column("doc_id"), "n": [], "h1": [], "h2": [], "bands": [], "sig": [], "packed": []}
                for (values, digest), text in zip(shingle_sets(part.column("text"), shingle), part.column("text")):
                    rows["n"].append(len(values))
                    h1, h2 = np.frombuffer(digest, dtype=np.int64).tolist()
                    least = minima(values, count * ROWS)
                    rows["h1"].append(h1)
                    rows["h2"].append(h2)
                    rows["bands"].append(_band_keys(least).view(np.int64) if len(values) else None)
                    rows["sig"].append(_signature(least))
                    rows["packed"].append(pack.compress(text.as_py().encode()) if len(values) else b"")
                yield pa.RecordBatch.from_pydict(rows | {"n": pa.array(rows["n"], pa.int64()), "h1": pa.array(rows["h1"], pa.int64()), "h2": pa.array(rows["h2"], pa.int64()), "bands": pa.array(rows["bands"], pa.list_(pa.int64())), "sig": pa.array(rows["sig"], pa.binary()), "packed": pa.array(rows["packed"], pa.binary())})

    return run


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of all pairs of packed signatures (rows of bytes): the share of equal minima, corrected for low bits that agree by chance."""
    equal = np.zeros((len(a), len(b)), dtype=np.int32)
    for j in range(a.shape[1]):
        x = a[:, None, j] ^ b[None, :, j]
        equal += ((x & 15) == 0).astype(np.int32) + ((x >> 4) == 0)
    chance = 1.0 / (1 << BITS)
    return (equal / (2 * a.shape[1]) - chance) / (1 - chance)


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairwise intersections, from the incidence of shingles that two sets share at least."""
    m = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total = np.zeros((m, m), dtype=np.int64)
    width = column[-1] + 1 if len(column) else 0
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        x = np.zeros((m, min(4096, width - at)), dtype=np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        total += (x @ x.T).astype(np.int64)
    return total


class _Unit:
    """Rows (block, group, node, sig, size, and in the end packed) of one unit of work.

    Pairs of one group are linked already. Where a unit has two blocks, pairs of one
    block are left to that block's own unit.
    """

    def __init__(self, rows: list[tuple]):
        self.block, self.group, self.ids, self.size = (np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1, 2, 4))
        self.sig = np.array([np.frombuffer(r[3], np.uint8) for r in rows])
        self.packed = [r[5] for r in rows] if len(rows[0]) > 5 else None

    def near(self, numerator: int, denominator: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may be links, by their signatures and sizes."""
        if len(np.unique(self.ids)) < 2:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        near = estimates(self.sig, self.sig) >= numerator / denominator - SLACK
        near &= numerator * np.maximum(self.size[:, None], self.size) <= denominator * np.minimum(self.size[:, None], self.size)
        near &= np.arange(len(self.ids))[:, None] < np.arange(len(self.ids))
        near &= self.group[:, None] != self.group
        if len(np.unique(self.block)) > 1:
            near &= self.block[:, None] != self.block
        return np.nonzero(near)

    def text(self, i: int) -> str:
        return zstandard.ZstdDecompressor().decompress(self.packed[i]).decode()

    def links(self, numerator: int, denominator: int, shingle: int) -> list[tuple[int, int]]:
        """A spanning forest of the links."""
        a, b = self.near(numerator, denominator)
        if not len(a):
            return []
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        union, out = Union(len(self.ids)), []
        if self.size[used].sum() > TOGETHER:  # long texts, two at a time; pairs that links already tie need no look
            for x, y in zip(a.tolist(), b.tolist()):
                if union.find(x) != union.find(y):
                    s, t = exact_sets([self.text(x), self.text(y)], shingle)
                    inter = len(np.intersect1d(s, t, assume_unique=True))
                    if denominator * inter >= numerator * (len(s) + len(t) - inter):
                        union.join(x, y)
                        out.append((int(self.ids[x]), int(self.ids[y])))
            return out
        sets = exact_sets([self.text(i) for i in used.tolist()], shingle)
        ua, ub = at[: len(a)], at[len(a) :]
        size = np.array([len(s) for s in sets])
        inter = _intersections(sets)[ua, ub]
        linked = denominator * inter >= numerator * (size[ua] + size[ub] - inter)
        for x, y in zip(a[linked].tolist(), b[linked].tolist()):
            if union.join(x, y):
                out.append((int(self.ids[x]), int(self.ids[y])))
        return out


_KEY = ("cluster", "i", "j")


def _units_of(batches):
    """(key, rows) of each unit, from batches in order of their units."""
    key, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for c, i, j, *row in zip(*(x.to_pylist() for x in batch.slice(at, 256).columns)):
                if (c, i, j) != key:
                    if held:
                        yield key, held
                    key, held = (c, i, j), []
                held.append(tuple(row))
    if held:
        yield key, held


def _survivors(numerator: int, denominator: int):
    """The rows of a unit that have a pair near enough."""

    def run(batches):
        for key, rows in _units_of(batches):
            used = np.unique(np.concatenate(_Unit(rows).near(numerator, denominator))).tolist()
            if used:
                out = {c: pa.array([key[i]] * len(used), pa.int64()) for i, c in enumerate(_KEY)}
                out |= {c: pa.array([rows[i][k] for i in used], pa.int64()) for k, c in enumerate(("block", "group", "node"))}
                yield pa.RecordBatch.from_pydict(out)

    return run


def _confirm(numerator: int, denominator: int, shingle: int):
    def run(batches):
        out = lambda links: pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([y for _, y in links], pa.int64())})
        found = []
        for _, rows in _units_of(batches):
            found += _Unit(rows).links(numerator, denominator, shingle)
            if len(found) > 10_000:
                yield out(found)
                found = []
        yield out(found)

    return run


class _Links:
    """Finds links in units (cluster, i, j, block, group, node)."""

    def __init__(self, candidates: DataFrame, numerator: int, denominator: int, shingle: int):
        """candidates: node, sig, size, packed of all classes in clusters."""
        self.signatures, self.texts = candidates.select("node", "sig", "size"), candidates
        self.near = arrow(_survivors(numerator, denominator), ", ".join(f"{c} long" for c in (*_KEY, "block", "group", "node")))
        self.confirm = arrow(_confirm(numerator, denominator, shingle), "u long, v long")

    def of(self, units: DataFrame) -> DataFrame:
        def sorted_units(t: DataFrame, *more: str) -> DataFrame:
            return t.select(*_KEY, "block", "group", "node", *more).repartition(*_KEY).sortWithinPartitions(*_KEY, "block", "node")

        near = sorted_units(units.join(self.signatures, "node"), "sig", "size").transform(self.near)
        return written(sorted_units(near.join(self.texts, "node"), "sig", "size", "packed").transform(self.confirm), "links")


def _dealt(count: Column) -> Column:
    """The block of a node among those of count classes."""
    return F.pmod(F.xxhash64("node"), F.ceil(count / BLOCK))


def _blocks(count: Column) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.ceil(count / BLOCK) - 1)


def _links_of_large(clusters: DataFrame, links: _Links) -> DataFrame:
    """Links of clusters (node, cluster, k classes) of more than BLOCK classes."""
    total = clusters.count()
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("weight"))
    found, groups = None, clusters.withColumn("group", F.col("node"))
    for star in range(STARS):
        by_size = groups.groupBy("cluster", "group").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(star)).alias("h"), "node")).alias("one"))
        centres = by_size.groupBy("cluster").agg(F.max(F.struct("n", F.col("one.h").alias("h"), F.col("one.node").alias("node"), "group")).alias("c"))
        centres = written(centres.join(sizes, "cluster").select("cluster", "weight", F.col("c.node").alias("centre"), F.col("c.group").alias("of")), "centres")
        others = joined(groups, centres, ["cluster"], "weight", total).filter("group <> of").withColumn("i", _dealt(F.col("k")))
        rows = others.select("cluster", "i", F.lit(0).cast("long").alias("block"), "group", "node")
        heads = others.select("cluster", "i", F.lit(1).cast("long").alias("block"), F.col("of").alias("group"), F.col("centre").alias("node")).distinct()
        new = links.of(rows.unionByName(heads).withColumn("j", F.lit(-1).cast("long")))
        found = new if found is None else found.unionByName(new)
        tied = components(found).select("node", F.col("component").alias("group"))
        groups = written(clusters.join(tied, "node", "left").withColumn("group", F.coalesce("group", "node")), "groups")
    largest = groups.groupBy("cluster", "group").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "group")).alias("c"))
    largest = largest.join(sizes, "cluster").select("cluster", "weight", F.col("c.group").alias("main"), F.col("c.n").alias("linked"))
    t = joined(groups, written(largest, "largest"), ["cluster"], "weight", total).withColumn("left", F.col("k") - F.col("linked"))
    rest, main = t.filter("group <> main"), t.filter("group = main and left > 0")
    rest = rest.withColumn("block", _dealt(F.col("left")))
    main = main.withColumn("block", _dealt(F.col("linked")))
    other = F.explode(_blocks(F.col("left"))).alias("other")
    inner = rest.select("cluster", "block", "group", "node", other).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "group", "node")
    across = F.lit(-1) - F.col("other")  # blocks of the main component have negative numbers
    outer = rest.select("cluster", "block", "group", "node", F.explode(_blocks(F.col("linked"))).alias("other")).select("cluster", F.col("block").alias("i"), across.alias("j"), "block", "group", "node")
    outer = outer.unionByName(main.select("cluster", "block", "group", "node", other).select("cluster", F.col("other").alias("i"), (F.lit(-1) - F.col("block")).alias("j"), (F.lit(-1) - F.col("block")).alias("block"), "group", "node"))
    return found.unionByName(links.of(inner.unionByName(outer)))


def _members(full: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """doc_id, n, node for each row."""
    return joined(full.select("doc_id", "h1", "h2", "n"), classes.select("h1", "h2", "n", "node", "copies"), ["h1", "h2", "n"], "copies", rows).select("doc_id", "n", "node")


def _versions(full: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """Ties of the classes that rows of one doc_id are in."""
    t = _members(full, classes, rows).groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).filter(F.size("nodes") > 1)
    return t.select(F.explode("nodes").alias("u"), F.array_min("nodes").alias("v")).filter("u <> v")


def link_documents(docs: DataFrame, numerator: int = 80, denominator: int = 100, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each distinct doc_id.

    Documents are linked where intersection / union >= numerator / denominator, on
    their whole sets. component_id is the smallest doc_id that links lead to.

    Null and empty texts, and texts without words, have empty sets and are linked
    with nothing. Rows that repeat a doc_id are versions of one document: its links
    are those of all, n_shingles is the largest. Rows with a null doc_id are linked
    with nothing: each gives a row with a null component_id and kept true. Other
    columns are ignored; an empty table gives no rows.
    """
    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    count = bands(numerator / denominator)
    prints = written(t.transform(arrow(_fingerprints(shingle, count), "doc_id long, n long, h1 long, h2 long, bands array<long>, sig binary, packed binary")), "fingerprints")
    full = prints.filter("n > 0 and doc_id is not null")
    classes = written(full.groupBy("h1", "h2", "n").agg(F.min(F.struct("doc_id", "bands", "sig")).alias("r"), F.count("*").alias("copies")).select("h1", "h2", "n", F.col("r.doc_id").alias("node"), "r.bands", "r.sig", "copies"), "classes")
    documents = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()

    keys = classes.select("node", F.explode("bands").alias("key"))
    least = keys.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most"), F.count("*").alias("weight")).filter("v < most").select("key", "v", "weight")
    ties = joined(keys, written(least, "shared-keys"), ["key"], "weight", count * documents["classes"]).filter("node <> v").select(F.col("node").alias("u"), "v")
    clusters = written(components(ties).select("node", F.col("component").alias("cluster")), "clusters")

    counts = written(clusters.groupBy("cluster").agg(F.count("*").alias("k")), "cluster-sizes")
    sized = written(joined(clusters, counts, ["cluster"], "k", documents["classes"]), "sized-clusters")
    texts = full.select(F.col("doc_id").alias("node"), "h1", "h2", "sig", F.col("n").alias("size"), "packed")
    chosen = clusters.select("node").join(classes.select("node", "h1", "h2"), "node")
    candidates = written(chosen.join(texts, ["node", "h1", "h2"]).drop("h1", "h2"), "candidates")
    confirm = _Links(candidates, numerator, denominator, shingle)
    zero = F.lit(0).cast("long")
    links = confirm.of(sized.filter(F.col("k") <= BLOCK).select("cluster", zero.alias("i"), zero.alias("j"), zero.alias("block"), F.col("node").alias("group"), "node"))
    large = sized.filter(F.col("k") > BLOCK)
    if large.limit(1).count():
        links = links.unionByName(_links_of_large(large, confirm))

    found = components(links.unionByName(_versions(full, classes, documents["rows"])))  # written
    discard(candidates)

    members = _members(full, classes, documents["rows"])
    members = members.join(found, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component"))
    empty = prints.filter("n = 0 and doc_id is not null").select("doc_id", "n", F.col("doc_id").alias("component"))
    rows = members.unionByName(empty).groupBy("doc_id").agg(F.max("n").alias("n_shingles"), F.min("component").alias("component_id"))
    rows = rows.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return rows.unionByName(prints.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s : s + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach(doc, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT doc, b FROM reach JOIN both_ways ON node = a
), c AS (SELECT doc, min(node) AS component_id FROM reach GROUP BY doc)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON doc = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""
