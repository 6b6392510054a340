"""Mixing sources to target weights, with DataFrame operations only.

Words of a source, document after document, are packed into blocks of a fixed
number of words. Target weights give each source a number of slots. Each output
shard's counts by source are drawn: multinomial draws given the totals, that is
without replacement from the slots that earlier shards left. The counts give each
shard a run of each source's slots, in a permuted order within the shard. Slot j of a
source with n blocks reads block perm(j mod n), in pass j div n: every block is read
floor or ceil(slots / n) times, and slots meet blocks in an equi-join on (source, index).

A permutation puts a source's blocks in order of a keyed hash of their index. No task
holds one: hash ranges of about ``PART`` blocks are counted first and ranked each.

No step holds a source in one task: equal rows are counted first, prefix sums are
taken within hash buckets of documents and then over the buckets' totals, and slots
are made by shard and source. Only the draws are made on the driver, from the (few)
sources' totals: a row for each shard and source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathspring.llm._store import shuffle_partitions, written

BLOCK = 128
"""Words in a block."""
SHARD_SLOTS = 65536
"""Slots in an output shard."""
WEIGHTS = (5, 2, 1)
"""Sources' weights in order of their names, repeating."""
MOST = 3
"""How often a source's words may be read on average, and a document's at most."""
BUCKETS = 1024
"""Hash buckets of documents within a source, for prefix sums."""
PART = 2048
"""Blocks in a hash range of a permutation, about."""

WORD = r"[^\x20\x09-\x0D]+"


def _hashed(text: Column, digits: int = 8) -> Column:
    """A whole number of 4 bits a digit from a text, by MD5: SQL elsewhere has it too."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def permutations(sources: DataFrame, seed: int, part: int = PART) -> DataFrame:
    """key, index, rank: a pseudorandom permutation of 0..blocks-1 for each source (key, blocks)."""
    tasks = shuffle_partitions(sources.sparkSession)
    t = sources.filter(F.col("blocks") > 0).select("key", "blocks", F.ceil(F.col("blocks") / part).alias("ranges"))
    t = t.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ranges") - 1))).repartition(tasks, "key", "at")
    t = t.withColumn("index", F.explode(F.sequence(F.col("at") * part, F.least("blocks", (F.col("at") + 1) * part) - 1)))
    t = t.withColumn("h", _hashed(F.concat("key", F.lit(f":{seed}:"), F.col("index").cast("string")), 13))
    t = t.select("key", "index", "h", F.shiftright(F.shiftright("h", 20) * F.col("ranges"), 32).alias("range"))
    counts = t.groupBy("key", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    t = t.withColumn("within", F.row_number().over(Window.partitionBy("key", "range").orderBy("h", "index")) - 1)
    return t.join(counts.hint("shuffle_merge"), ["key", "range"]).select("key", "index", (F.col("base") + F.col("within")).alias("rank"))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, key (the source, with a key for null), size (words of the whole text), spot (a hash of the doc_id; without one, of the text)."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    return docs.select(
        id_.alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _hashed(F.coalesce(id_.cast("string"), text, F.lit(""))).alias("spot"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """key, source_size, target by source: weighted shares of all words, none above most times its source.

    Filling by weight with stops, and resharing of what is over, ends where every
    free source has its weight times one level; sources stop in order of size over
    weight, so the level follows from prefix sums over the (few) sources.
    """
    n = len(weights)
    total = Window.partitionBy()
    by_name = Window.orderBy(F.col("key") == "", "key")
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("key") == "", "key").rowsBetween(Window.unboundedPreceding, -1)
    t = sized.groupBy("key").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(by_name) - 1, F.lit(n))))
    t = t.withColumn("cap", F.col("source_size") * most)
    t = t.withColumns({"all": F.sum("source_size").over(total), "weight": F.sum("w").over(total), "capped": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)), "used": F.coalesce(F.sum("w").over(by_ratio), F.lit(0.0))})
    t = t.withColumn("stops", F.col("cap") * (F.col("weight") - F.col("used")) <= (F.col("all") - F.col("capped")) * F.col("w"))
    held, spent = (F.sum(F.when(F.col("stops"), F.col(c)).otherwise(F.lit(0))).over(total) for c in ("cap", "w"))
    free = F.col("weight") - spent
    t = t.withColumn("target", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise((F.col("all") - held) / F.when(free > 0, free) * F.col("w")))
    return t.select("key", "source_size", "target")


def packed(sized: DataFrame, *keep: str) -> DataFrame:
    """Documents with words, each with the offset of its first word in its source, and the columns to keep.

    Equal rows travel as one with their number, so that no bucket is large for them.
    """
    t = sized.filter(F.col("size") > 0).groupBy("doc_id", "key", "size", "spot", *keep).agg(F.count("*").alias("copies"))
    t = t.withColumn("bucket", F.pmod("spot", F.lit(BUCKETS)))
    totals = t.groupBy("key", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("key", "bucket").orderBy("doc_id", "size", "spot").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inner), F.lit(0)))
    t = t.join(totals, ["key", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return t.select("doc_id", "key", "size", (F.col("base") + F.col("within") + F.col("copy") * F.col("size")).alias("offset"), *keep)


def drawn_counts(totals, seed: int, shard_slots: int = SHARD_SLOTS):
    """(shard, source, slots, first slot of the source) for sources with slots in the shard, drawn without replacement from totals by source."""
    rng = np.random.default_rng([seed, 7919])
    left = np.array(totals, dtype=np.int64)
    first = np.zeros_like(left)
    shard = 0
    while (n := int(left.sum())) > 0:
        size = min(shard_slots, n)
        if n < 10**9:
            taken = rng.multivariate_hypergeometric(left, size, method="marginals")
        else:  # beyond what that method can count: distinct slots, by their sources
            taken = np.bincount(np.searchsorted(np.cumsum(left), rng.choice(n, size, replace=False, shuffle=False), side="right"), minlength=len(left))
        for k in np.flatnonzero(taken).tolist():
            yield shard, k, int(taken[k]), int(first[k])
        left, first, shard = left - taken, first + taken, shard + 1


def slots(aims: DataFrame, seed: int = 42, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, most: int = MOST) -> DataFrame:
    """shard, slot, key, index, pass: the mix, as places of blocks in output shards.

    A source whose blocks hold m words on average gets round(target / m) slots.
    """
    t = aims.filter(F.col("source_size") > 0)
    t = t.withColumn("blocks", F.ceil(F.col("source_size") / block))
    t = t.withColumn("count", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * most))
    t = t.filter(F.col("count") > 0).select("key", "blocks", "count")
    sources = sorted(t.collect(), key=lambda r: r["key"])
    drawn = [(shard, sources[k]["key"], sources[k]["blocks"], n, first) for shard, k, n, first in drawn_counts([r["count"] for r in sources], seed, shard_slots)]
    indices = permutations(t, seed)
    t = aims.sparkSession.createDataFrame(drawn, "shard long, key string, blocks long, n long, first long")
    t = t.repartition(shuffle_partitions(aims.sparkSession), "shard", "key").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    t = t.withColumn("j", F.col("first") + F.col("i")).withColumns({"rank": F.pmod("j", F.col("blocks")), "pass": F.floor(F.col("j") / F.col("blocks"))})
    h = _hashed(F.concat(F.lit(f"{seed}:"), F.col("shard").cast("string"), F.lit(":"), F.col("key"), F.lit(":"), F.col("j").cast("string")), 13)
    t = t.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy(h, "key", "j")) - 1)  # a shard has shard_slots rows at most
    # without the hint the planner takes exploded rows to be as few as the rows they come from, and broadcasts them
    return t.join(indices.hint("shuffle_merge"), ["key", "rank"]).select("shard", "slot", "key", "index", "pass")


def shard_counts(mix: DataFrame) -> DataFrame:
    """The multinomial draws: slots by shard and source."""
    return mix.groupBy("shard", "key").agg(F.count("*").alias("slots"))


def _pieces(offsets: DataFrame, block: int) -> DataFrame:
    """One row for each document and block it has words in."""
    last = F.floor((F.col("offset") + F.col("size") - 1) / block)
    t = offsets.withColumn("index", F.explode(F.sequence(F.floor(F.col("offset") / block), last)))
    start = F.greatest(F.col("offset"), F.col("index") * block)
    return t.withColumns({"start": start, "words": F.least(F.col("offset") + F.col("size"), (F.col("index") + 1) * block) - start})


def mix(docs: DataFrame, weights=WEIGHTS, seed: int = 42, block: int = BLOCK, most: int = MOST, **columns: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of documents.

    taken counts the words that the mix reads of the document, repeats included.
    Null texts have size 0; null sources are one source, last in order; rows that
    repeat a doc_id are documents of their own, reported each; a source without
    words has target 0; other columns are ignored; an empty table gives no rows.
    The result depends on the rows and the seed alone.
    """
    sized = written(sizes(docs, **columns), "sizes")  # each text is read once
    aims = written(targets(sized, weights, most), "targets")
    offsets = packed(sized)
    reads = slots(aims, seed, block, most=most).groupBy("key", "index").agg(F.count("*").alias("times"))
    pieces = _pieces(offsets, block).join(reads.hint("shuffle_merge"), ["key", "index"], "left")
    taken = pieces.groupBy("doc_id", "key", "size", "offset").agg(F.sum(F.coalesce("times", F.lit(0)) * F.col("words")).alias("taken"))
    none = sized.filter(F.col("size") == 0).select("doc_id", "key", "size", F.lit(0).cast("long").alias("taken"))
    rows = taken.select("doc_id", "key", "size", "taken").unionByName(none)
    return rows.join(F.broadcast(aims) if _few(aims) else aims, "key").select("doc_id", "size", "source_size", "target", "taken")


def _few(aims: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources is small enough to broadcast; larger ones are joined by a shuffle."""
    return aims.limit(most + 1).count() <= most


def mixed_blocks(docs: DataFrame, weights=WEIGHTS, seed: int = 42, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: shard, slot, source, index, pass and the block's text (its words, one space between)."""
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{source_col}`").alias("source"))
    named = written(named.withColumn("row", F.monotonically_increasing_id()), "rows")  # a key for each row, the same in all that follows
    sized = written(sizes(named.withColumn("named", F.struct("doc_id", "row")), id_col="named"), "sizes")
    sized = sized.select("doc_id.doc_id", "doc_id.row", "key", "size", "spot")
    texts = named.select("row", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("w"))
    pieces = _pieces(packed(sized, "row"), block).join(texts, "row")
    part = F.array_join(F.slice("w", (F.col("start") - F.col("offset") + 1).cast("int"), F.col("words").cast("int")), " ")
    blocks = pieces.groupBy("key", "index").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", part.alias("text")))), lambda p: p["text"]), " ").alias("text"))
    out = slots(targets(sized, weights), seed, block).hint("shuffle_merge").join(blocks, ["key", "index"])
    return out.select("shard", "slot", F.when(F.col("key") != "", F.substring("key", 2, 1 << 30)).alias("source"), "index", "pass", "text")


def oracle(seed: int = 42) -> str:
    """The rows of mix() in DuckDB SQL."""
    weights = ", ".join(f"{float(w)}::DOUBLE" for w in WEIGHTS)
    return rf"""
WITH s AS (
  SELECT doc_id, coalesce('=' || source, '') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 8))::BIGINT AS spot FROM documents
), a0 AS (SELECT key, sum(size)::BIGINT AS source_size FROM s GROUP BY key
), a1 AS (SELECT *, 3 * source_size AS cap, [{weights}][1 + (row_number() OVER (ORDER BY key = '', key) - 1) % {len(WEIGHTS)}] AS w FROM a0
), a2 AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, sum(w) OVER () AS weight, coalesce(sum(cap) OVER o, 0)::BIGINT AS capped, coalesce(sum(w) OVER o, 0) AS used
  FROM a1 WINDOW o AS (ORDER BY cap / w, key = '', key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a3 AS (SELECT *, cap * (weight - used) <= (total - capped) * w AS stops FROM a2
), a4 AS (
  SELECT key, source_size, CASE WHEN stops THEN cap::DOUBLE ELSE (total - (sum(CASE WHEN stops THEN cap ELSE 0 END) OVER ())::BIGINT)
         / nullif(weight - sum(CASE WHEN stops THEN w ELSE 0 END) OVER (), 0) * w END AS target FROM a3
), a5 AS (SELECT *, ceil(source_size / {BLOCK})::BIGINT AS blocks FROM a4 WHERE source_size > 0
), a6 AS (SELECT key, blocks, least(round(target * blocks / source_size)::BIGINT, {MOST} * blocks) AS n FROM a5
), i AS (SELECT key, blocks, n, unnest(range(blocks)) AS index FROM a6
), p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ('0x' || substr(md5(key || ':{seed}:' || index), 1, 13))::BIGINT, index) - 1 AS rank FROM i
), reads AS (SELECT key, index, n // blocks + (rank < n % blocks)::BIGINT AS times FROM p
), o AS (
  SELECT doc_id, key, size, coalesce(sum(size) OVER (PARTITION BY key ORDER BY spot % {BUCKETS}, doc_id NULLS FIRST, size, spot
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM s WHERE size > 0
), taken AS (
  SELECT doc_id, key, size, pos, sum(coalesce(times, 0) * (least(pos + size, (i + 1) * {BLOCK}) - greatest(pos, i * {BLOCK})))::BIGINT AS taken
  FROM (SELECT *, unnest(range(pos // {BLOCK}, (pos + size - 1) // {BLOCK} + 1)) AS i FROM o) p LEFT JOIN (SELECT key AS k, index, times FROM reads) r ON k = key AND index = i
  GROUP BY doc_id, key, size, pos
)
SELECT doc_id, size, source_size, target, taken FROM (
  SELECT doc_id, key, size, taken FROM taken UNION ALL SELECT doc_id, key, size, 0 FROM s WHERE size = 0
) JOIN a4 USING (key)"""
