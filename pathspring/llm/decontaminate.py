"""Benchmark decontamination: a prefix-filtered containment join, with DataFrame operations only.

Items are cut into windows of ``WINDOW`` words. A document contains a window if it
holds all of the window's shingles (``SHINGLE`` words) in place; for this full
containment the prefix that must match is one shingle, and the order by rarity
(number of occurrences in all documents) makes it the window's rarest. So only the
rarest shingle of each window is joined with the documents' shingles. A match gives
the place where the window would start: the length bound (the document is as long
as the window) and the positional bound (the window fits in before the start and
the end) come next, and then the words of that place are compared one by one.

Windows are broadcast while they are at most ``BROADCAST_WINDOWS`` and their words at
most ``BROADCAST_BYTES``; then a
document's words never leave their scan. More windows are joined by shuffles of
shingle fingerprints, and only candidates meet the documents again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathspring.llm._store import written

WINDOW = 10
SHINGLE = 3
BROADCAST_WINDOWS = 200_000
BROADCAST_BYTES = 64 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELIMITERS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
END_OF_DOCUMENT = -1


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased (null: none)."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    low = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(low, DELIMITERS), ""), F.array().cast("array<string>"))


def _fingerprints(w: Column, k: int) -> Column:
    """Of the k words from each place on: 63 bits, so never END_OF_DOCUMENT."""
    places = F.when(F.size(w) >= k, F.sequence(F.lit(0), F.size(w) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.shiftrightunsigned(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), 1))


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    t = docs.select(F.col(f"`{id_col}`").alias("doc_id"), words(F.col(f"`{text_col}`").cast("string")).alias("w"))
    return t.select("doc_id", "w", F.size("w").alias("n"))


def item_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id (string), words: each window of each item, an item of fewer words being one window."""
    t = items.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), words(F.col(f"`{text_col}`").cast("string")).alias("w"))
    t = t.filter(F.size("w") > 0).withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))))
    return t.select("item_id", F.slice("w", F.col("at"), F.lit(window)).alias("words")).distinct()


def _exploded(docs: DataFrame, k: int, *keep: str) -> DataFrame:
    # the outer form: for the other one the optimizer infers a filter that computes the fingerprints again, words and all, below
    t = docs.select("*", _fingerprints(F.col("w"), k).alias("h"))
    return t.select(*keep, F.posexplode_outer("h").alias("pos", "h"))


def _rarest(windows: DataFrame, docs: DataFrame, shingle: int, small: bool) -> DataFrame:
    """Each window with its rarest shingle: h, off, k, len, words, window_id."""
    parts = []
    for k in range(1, shingle + 1):
        t = windows.filter(F.least(F.size("words"), F.lit(shingle)) == k)
        parts.append(t.select("window_id", "words", F.lit(k).alias("k"), F.posexplode(_fingerprints(F.col("words"), k)).alias("off", "h")))
    tokens = written(reduce(DataFrame.unionByName, parts), "window-shingles")
    counts = []
    for k in [r["k"] for r in tokens.select("k").distinct().collect()]:
        mine = tokens.filter(F.col("k") == k).select("k", "h").distinct()
        found = _exploded(docs, k, "doc_id").join(F.broadcast(mine) if small else mine, "h")
        counts.append(found.groupBy("k", "h").agg(F.count("*").alias("seen")))
    seen = reduce(DataFrame.unionByName, counts) if counts else tokens.select("k", "h", F.lit(0).cast("long").alias("seen"))
    ranked = tokens.join(seen, ["k", "h"], "left").groupBy("window_id").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "off", "k", F.size("words").alias("len"), "words")).alias("r"))
    return ranked.select("window_id", "r.h", "r.off", "r.k", "r.len", "r.words")



def _fits() -> Column:
    return (F.col("n") >= F.col("len")) & (F.col("pos") >= F.col("off")) & (F.col("pos") - F.col("off") + F.col("len") <= F.col("n"))


def _same_words() -> Column:
    return F.slice("w", F.col("pos") - F.col("off") + 1, F.col("len")) == F.col("words")


def _found_in_scan(docs: DataFrame, rarest: DataFrame, k: int) -> DataFrame:
    """doc_id, n and, for each occurrence, start, len, window_id; a row of nulls for each document besides."""
    end = docs.sparkSession.createDataFrame([(None, END_OF_DOCUMENT, None, None, None)], "window_id long, h long, off int, len int, words array<string>")
    table = rarest.filter(F.col("k") == k).select("window_id", "h", "off", "len", "words").unionByName(end)
    t = docs.select("*", F.concat(_fingerprints(F.col("w"), k), F.array(F.lit(END_OF_DOCUMENT).cast("long"))).alias("h"))
    t = t.select("doc_id", "w", "n", F.posexplode_outer("h").alias("pos", "h")).join(F.broadcast(table), "h")
    t = t.filter(F.col("window_id").isNull() & (F.col("pos") >= F.greatest(F.col("n") - k + 1, F.lit(0))) | F.col("window_id").isNotNull() & _fits() & _same_words())
    return t.select("doc_id", "n", F.expr("pos - off").alias("start"), "len", "window_id")


def _found_by_shuffle(docs: DataFrame, rarest: DataFrame, k: int) -> DataFrame:
    # rows without a doc_id go by their words: they are many keys, and rows of equal words have equal hits
    docs = docs.withColumn("row", F.when(F.col("doc_id").isNull(), F.xxhash64("w")))
    t = _exploded(docs, k, "doc_id", "row", "n").join(rarest.filter(F.col("k") == k), "h").filter(_fits())
    t = t.select(F.col("doc_id").alias("id"), F.col("row").alias("of"), "pos", "off", "len", "words", "window_id").dropDuplicates(["id", "of", "pos", "window_id"])
    t = t.join(docs, F.col("id").eqNullSafe(F.col("doc_id")) & F.col("of").eqNullSafe(F.col("row"))).filter(_same_words())
    t = t.select("doc_id", "n", F.expr("pos - off").alias("start"), "len", "window_id")
    none = docs.select("doc_id", "n", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("len"), F.lit(None).cast("long").alias("window_id"))
    return t.unionByName(none)


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_windows: int = BROADCAST_WINDOWS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(found, window_items): where windows stand (with a row of nulls for each document), and the items of each window."""
    docs = _documents(docs, id_col, text_col)
    by_item = item_windows(items, window, item_col, item_text_col)
    windows = written(by_item.select("words").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0)).alias("bytes")).first()
    small = size["n"] <= broadcast_windows and size["bytes"] <= BROADCAST_BYTES
    rarest = written(_rarest(windows, docs, shingle, small), "rarest")
    lengths = sorted(r["k"] for r in rarest.select("k").distinct().collect()) or [1]
    found = [(_found_in_scan if small else _found_by_shuffle)(docs, rarest, k) for k in lengths]
    return written(reduce(DataFrame.unionByName, found), "found"), by_item.join(windows, "words").select("window_id", "item_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_windows: int = BROADCAST_WINDOWS, **columns: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, for each distinct doc_id.

    Null and empty texts have no words and no hits; items without words have no
    windows. Rows that repeat a doc_id give one row, with the words of the longest
    and the hits of all, places being counted from each row's start. Items that
    repeat an item_id count as one; items with a null id hit words, but are not
    among the items. A null doc_id keeps its row. Other columns are ignored; an
    empty table of documents gives no rows, one of items no hits.
    """
    found, window_items = occurrences(docs, items, window, shingle, broadcast_windows, **columns)
    places = F.sort_array(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "len"))))
    by_doc = found.groupBy("doc_id").agg(F.max("n").cast("long").alias("n_words"), places.alias("places"), F.collect_set("window_id").alias("windows"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("total")),
        lambda a, p: F.struct(F.greatest(a["upto"], p["start"] + p["len"]).alias("upto"), (a["total"] + F.greatest(F.lit(0), p["start"] + p["len"] - F.greatest(a["upto"], p["start"]))).alias("total")),
        lambda a: a["total"],
    )
    by_doc = by_doc.withColumn("n_hit", covered)
    pairs = by_doc.select("doc_id", F.explode("windows").alias("window_id")).join(window_items, "window_id").filter("item_id is not null")
    names = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("names"))
    t = by_doc.select(F.col("doc_id").alias("id"), "n_words", "n_hit").join(names, F.col("id").eqNullSafe(F.col("doc_id")), "left")
    listed = F.coalesce(F.array_join("names", ","), F.lit(""))
    return t.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT DISTINCT item_id, w[s : s + 9] AS win FROM (
    SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM (
      SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ) WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(win) AS k FROM i
), g AS (
  SELECT doc_id, s, k, w[s : s + k - 1] AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, lengths)
), f AS (SELECT doc_id, s, k, item_id FROM g JOIN i USING (win)
), hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM f) GROUP BY doc_id
), names AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(names.n, 0)::BIGINT AS n_items,
       sha256(coalesce(names.names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)"""
