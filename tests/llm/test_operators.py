"""Operators against brute force, on the smallest tables and on made-up rows."""

import random

import pytest
from pyspark.sql import functions as F

from pathspring.llm import catalog, chat, decontaminate, licenses, lm_score, mixing, near_dup, quality, substring, topk, url_filter
from tests.llm import brute

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    t = spark.read.parquet(f"{SF}/documents.parquet").cache()
    return t, [(r["doc_id"], r["text"]) for r in t.collect()]


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def odd_texts():
    """Texts with edges: empty, null, spaces only, one word, periodic, long, with rare white space and capitals."""
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma", "DELTA", "épée", "Übel", "x", "y", "z9", "-", "it's"]
    passage = " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(60))
    near = passage.split()
    texts = [None, "", " \t\n", "one", "a b c", "a " * 100, "a b " * 60, passage, passage, passage.replace(" ", "\n\x0b"), "start " + passage + " end", passage + " " + passage]
    for i in range(20):
        w = near[:]
        for _ in range(i % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9)}"
        texts.append(" ".join(w))
    texts += [" ".join(rng.choice(vocabulary[:3]) for _ in range(rng.randrange(200))) for _ in range(40)]
    texts += [" ".join(f"w{rng.randrange(4000)}" for _ in range(30000)), "no\u00a0break space\u2003here " * 12, "nul\x00and\x1funit " * 9]
    return [(i * 7, t) for i, t in enumerate(texts)]


def frame(spark, pairs):
    """Rows of documents, with other columns whose names clash with results."""
    t = spark.createDataFrame(pairs, "doc_id long, text string")
    return t.withColumns({c: F.lit("other") for c in ("n_words", "n_removed", "kept", "component_id", "size", "taken", "bucket", "blob", "w", "h", "n", "key", "score", "labels", "start", "lang", "source")})


def test_substring(spark, documents):
    t, pairs = documents
    assert rows(substring.digests(t), "n_words", "n_removed", "kept_sha256") == brute.substring(pairs)
    pairs = odd_texts()
    assert rows(substring.digests(frame(spark, pairs)), "n_words", "n_removed", "kept_sha256") == brute.substring(pairs)


def test_substring_keeps_clean_and_repeated_rows(spark):
    clean = " ".join(f"c{i}" for i in range(50))
    t = spark.createDataFrame([(1, clean, "en", "a", 1), (1, clean, "en", "a", 1), (None, clean, "en", "a", 1), (2, clean + "  tail", "en", "a", 1)], DOCS)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in substring.remove_repeats(t).collect())
    assert got == [(0, clean), (1, clean), (1, clean), (2, "tail")]
    assert substring.remove_repeats(t).columns == t.columns


def test_near_duplicates(spark, documents):
    t, pairs = documents
    want = {d: (n, c, d == c) for d, (n, c) in brute.near(pairs).items()}
    assert rows(near_dup.link_documents(t, 85, 100), "n_shingles", "component_id", "kept") == want
    pairs = odd_texts()
    want = {d: (n, c, d == c) for d, (n, c) in brute.near(pairs).items()}
    assert rows(near_dup.link_documents(frame(spark, pairs), 85, 100), "n_shingles", "component_id", "kept") == want


def test_words_are_told_apart(spark):
    a, b = brute.colliding_words()
    rest = " ".join(f"w{i}" for i in range(19))
    pairs = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, " ".join(f"{a}{i}" for i in range(5))), (4, " ".join(f"{b}{i}" for i in range(5))), (5, f"{a} {rest}")]
    t = spark.createDataFrame(pairs, "doc_id long, text string")
    assert rows(substring.digests(t), "n_words", "n_removed", "kept_sha256") == brute.substring(pairs)
    want = {d: (n, c) for d, (n, c) in brute.near(pairs).items()}
    got = rows(near_dup.link_documents(t, 85, 100), "n_shingles", "component_id")
    assert got == want and got[3][1] != got[4][1]
    assert rows(licenses.scan_licenses(t, phrases=((f"{a} w0", "x"),), templates=()), "n_base")[1] == (1,) and rows(licenses.scan_licenses(t, phrases=((f"{a} w0", "x"),), templates=()), "n_base")[2] == (0,)


def test_digests_of_words():
    import numpy as np
    import pyarrow as pa

    from pathspring.llm._words import SPACED, Words, digests, sequences

    rng = random.Random(6)
    made = sorted({bytes(rng.randrange(256) for _ in range(n)) for n in range(18) for _ in range(300)} | {b"a", b"a\0", b"a\0\0"})
    got = digests(pa.array(made, pa.large_binary()))
    assert len({tuple(x) for x in got.tolist()}) == len(made) == len(np.unique(got[:, 0]))
    text = " ".join(rng.choice("abc") for _ in range(400))
    numbers, w = sequences(Words(pa.array([text]), SPACED), 5), text.split()
    assert len({(tuple(w[i : i + 5]), n) for i, n in enumerate(numbers.tolist())}) == len({*numbers.tolist()}) == len({tuple(w[i : i + 5]) for i in range(396)})


def test_long_texts_are_confirmed_two_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TOGETHER", 10)
    pairs = odd_texts()
    want = {d: (n, c) for d, (n, c) in brute.near(pairs).items()}
    assert rows(near_dup.link_documents(frame(spark, pairs), 85, 100), "n_shingles", "component_id") == want


@pytest.mark.parametrize("few", [200_000, 0])
def test_components_with_hot_nodes(spark, monkeypatch, few):
    from pathspring.llm import _graph
    from pathspring.llm._graph import components

    monkeypatch.setattr(_graph, "FEW_EDGES", few)

    rng = random.Random(8)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + rng.randrange(300), 1000 + rng.randrange(300)) for _ in range(200)] + [(5, 2000), (2000, 2001), (7, 7)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    assert got == {n: c for n, c in up.items() if n != 7 or c != 7 or any(n in e and e[0] != e[1] for e in edges)}


def test_bands_follow_the_threshold():
    missed = lambda t, n: (1 - t**near_dup.ROWS) ** n
    assert near_dup.bands(0.85) == 28 and near_dup.bands(0.8) == 44 and near_dup.bands(1.0) == 28
    for t in (0.6, 0.7, 0.8, 0.85):
        assert missed(t, near_dup.bands(t)) <= near_dup.MISSED < missed(t, near_dup.bands(t) - 1)
    for t in (0.0, 1.2):
        with pytest.raises(ValueError):
            near_dup.bands(t)


def test_pairs_at_the_threshold_are_found(spark):
    """300 pairs of texts whose sets of shingles share 80 to 81 in 100; 0.8 is the stage's threshold."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(104)]
        other = words[:93] + [f"v{rng.randrange(10**6)}" for _ in range(11)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert 100 * 89 >= 80 * (200 - 89)
    got = near_dup.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(600)}


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    pairs = []
    for i in range(70):
        w = base[:]
        for _ in range(rng.randrange(7)):
            w[rng.randrange(150)] = f"e{rng.randrange(1000)}"
        pairs.append((i, " ".join(w)))
    want = {d: (n, c) for d, (n, c) in brute.near(pairs).items()}
    assert rows(near_dup.link_documents(spark.createDataFrame(pairs, "doc_id long, text string"), 85, 100), "n_shingles", "component_id") == want


def test_versions_of_a_document_are_one(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    t = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (None, a), (4, None)], "doc_id long, text string")
    assert rows(near_dup.link_documents(t), "n_shingles", "component_id") == {1: (26, 1), 2: (26, 1), 3: (26, 1), 4: (0, 4), None: (26, None)}


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination(spark, documents, most):
    t, pairs = documents
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    assert rows(decontaminate.decontaminate(t, items, broadcast_windows=most), *names) == brute.decontaminated(pairs, known)
    odd = odd_texts()
    known = [(1, "Alpha"), (2, "a b c"), (3, " ".join(odd[7][1].split()[5:25])), (4, None), (5, ""), (6, "a a a a a a a a a a a a"), (7, "not there at all"), (8, "alpha")]
    made = spark.createDataFrame(known, "item_id long, text string").withColumn("words", F.lit(1))
    assert rows(decontaminate.decontaminate(frame(spark, odd), made, broadcast_windows=most), *names) == brute.decontaminated(odd, known)


@pytest.mark.parametrize("most", [200_000, 0])
def test_decontamination_of_rows_without_an_id(spark, most):
    passage = " ".join(f"q{i}" for i in range(12))
    t = spark.createDataFrame([(None, "a " + passage), (None, "a " + passage), (None, "b c " + passage + " d"), (None, "clean"), (1, "clean too")], "doc_id long, text string")
    got = rows(decontaminate.decontaminate(t, spark.createDataFrame([(5, passage)], "item_id long, text string"), broadcast_windows=most), "n_words", "n_hit", "n_items", "contaminated")
    assert got == {None: (15, 13, 1, True), 1: (2, 0, 0, False)}


def test_licenses(spark, documents):
    t, pairs = documents
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows(licenses.scan_licenses(t), *names) == brute.licensed(pairs)
    odd = odd_texts() + [(9001, "x CC-BY-NC. cc by nc cc by"), (9002, "under the MIT\nLicense"), (9003, "z " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated" + " z" * 500)]
    assert rows(licenses.scan_licenses(frame(spark, odd)), *names) == brute.licensed(odd)
    got = rows(licenses.scan_licenses(frame(spark, odd)), "base_labels", "labels", "score")
    assert got[9003][1] == "mit" and got[9003][0] == "" and 0.7 < got[9003][2] <= 1
    assert all(set(b.split(",")) <= set(m.split(",")) or not b for b, m, _ in got.values())


def test_license_join_is_exact(spark, documents):
    """Every block of every text, without filters."""
    t, pairs = documents
    templates = [(label, set(text.split())) for label, text in licenses.TEMPLATES]
    want = {}
    for doc, text in pairs:
        w, labels = brute.alnum(text), set()
        for s in range(0, max(1, len(w)), licenses.BLOCK // 2):
            block = set(w[s : s + licenses.BLOCK])
            labels |= {label for label, tokens in templates if len(block & tokens) >= licenses.THRESHOLD * len(tokens) - 1e-9}
        want[doc] = labels | set(filter(None, brute.licensed([(doc, text)])[doc][4].split(",")))
    got = rows(licenses.scan_licenses(t), "labels")
    assert {d: set(filter(None, x[0].split(","))) for d, x in got.items()} == want


def test_license_blocks_start_at_any_word(spark):
    """Notices broken up by other words, against every block of every text."""
    rng = random.Random(4)
    templates = [(label, set(text.split())) for label, text in licenses.TEMPLATES]
    texts = []
    for i in range(120):
        w = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(10, 70)):
            w.insert(rng.randrange(len(w)), f"o{rng.randrange(99)}")
        texts.append((i, " ".join(["z"] * rng.randrange(64) + w + ["z"] * rng.randrange(64))))
    want = {}
    for doc, text in texts:
        w = text.split()
        held = [(label, len(set(w[s : s + licenses.BLOCK]) & tokens), len(tokens)) for s in range(max(1, len(w) - licenses.BLOCK + 1)) for label, tokens in templates]
        want[doc] = {label for label, n, of in held if n >= licenses.THRESHOLD * of - 1e-9} | set(filter(None, brute.licensed([(doc, text)])[doc][4].split(",")))
    got = rows(licenses.scan_licenses(frame(spark, texts)), "labels")
    assert {d: set(filter(None, x[0].split(","))) for d, x in got.items()} == want


def test_long_license_templates(spark):
    """Templates of more words than a block has at least, against every block of every text."""
    rng = random.Random(9)
    long = " ".join(f"t{rng.randrange(70)}" for _ in range(150))
    templates = (("long", long), *licenses.TEMPLATES)
    texts = [(0, long), (1, "x " * 30 + long + " y" * 30)]
    for i in range(2, 40):
        w = rng.choice([long, *(t for _, t in licenses.TEMPLATES[-3:])]).split()
        for _ in range(rng.randrange(80)):
            w[rng.randrange(len(w))] = f"o{rng.randrange(99)}"
        for _ in range(rng.randrange(60)):
            w.insert(rng.randrange(len(w)), "z")
        texts.append((i, " ".join(w)))
    want = {}
    for doc, text in texts:
        w, labels, best = text.split(), set(), 0.0
        for label, t in templates:
            size, tokens = max(licenses.BLOCK, -(-len(t.split()) * 10 // 8)), {*t.split()}
            held = max(len({*w[s : s + size]} & tokens) for s in range(max(1, len(w) - size + 1)))
            labels |= {label} if held >= licenses.THRESHOLD * len(tokens) - 1e-9 else set()
            best = max(best, held / len(tokens)) if held >= licenses.THRESHOLD * len(tokens) - 1e-9 else best
        want[doc] = ",".join(sorted(labels)), best
    got = rows(licenses.scan_licenses(frame(spark, texts), templates=templates), "labels", "score")
    assert got[0] == ("long", 1.0) and {d: x[0] for d, x in got.items()} == {d: x[0] for d, x in want.items()}
    assert all(got[d][1] == pytest.approx(s) for d, (_, s) in want.items() if s)


def test_repeated_rows_are_scanned_each(spark):
    t = spark.createDataFrame([(1, "cc by nc"), (1, "cc by nc"), (None, "under the mit license")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["base_labels"], r["n_base"]) for r in licenses.scan_licenses(t).collect())
    assert got == [(0, "mit", 1), (1, "cc-by-nc", 1), (1, "cc-by-nc", 1)]


def test_mixing(spark, documents):
    t, pairs = documents
    source = {r["doc_id"]: r["source"] for r in t.collect()}
    size = {d: len(brute.spaced(x)) for d, x in pairs}
    by_source = {}
    for d, n in size.items():
        by_source[source[d]] = by_source.get(source[d], 0) + n
    want = brute.targets(by_source)
    got = rows(mixing.mix(t, block=16), "size", "source_size", "target", "taken")
    assert got == rows(mixing.mix(t.repartition(7), block=16), "size", "source_size", "target", "taken")
    taken = {}
    for d, (n, whole, target, used) in got.items():
        assert n == size[d] and whole == by_source[source[d]] and target == pytest.approx(want[source[d]]) and 0 <= used <= 3 * n
        taken[source[d]] = taken.get(source[d], 0) + used
    for s, target in want.items():
        assert taken[s] == pytest.approx(target, rel=0.05, abs=64)


def test_mixing_draws_counts_by_shard(spark):
    aims = spark.createDataFrame([("=a", 125_000, 125_000.0), ("=b", 75_000, 75_000.0)], "key string, source_size long, target double")
    made = mixing.slots(aims, block=1, shard_slots=1000).cache()
    assert made.count() == 200_000 == made.select("shard", "slot").distinct().count() == made.select("key", "index", "pass").distinct().count()
    assert made.agg(F.max("slot")).first()[0] == 999
    counts = [r["slots"] for r in mixing.shard_counts(made).filter("key = '=a'").collect()]
    mean = sum(counts) / 200
    deviation = (sum((c - mean) ** 2 for c in counts) / 200) ** 0.5
    assert mean == 625 and 12 < deviation < 19  # a draw has 15.3
    assert mixing.shard_counts(mixing.slots(aims, 7, 1, 1000)).filter("key = '=a' and shard < 200").orderBy("shard").collect() != mixing.shard_counts(made).filter("key = '=a'").orderBy("shard").collect()


def test_index_permutations(spark):
    sources = spark.createDataFrame([("=a", 40_000), ("=b", 40_000), ("", 1), ("=c", 0)], "key string, blocks long")
    got = {k: [x for _, x in sorted(v)] for k, v in mixing.permutations(sources, 42, 500).groupBy("key").agg(F.collect_list(F.struct("index", "rank")).alias("v")).collect()}
    assert got.pop("") == [0] and set(got) == {"=a", "=b"}
    other = [r["rank"] for r in mixing.permutations(sources, 43).filter("key = '=a'").orderBy("index").collect()]
    assert sum(x == y for x, y in zip(got["=a"], got["=b"])) < 20 and sum(x == y for x, y in zip(got["=a"], other)) < 20
    for ranks in (*got.values(), other):  # as random order has it: rises half of the time, steps of all sizes
        n = len(ranks)
        assert sorted(ranks) == list(range(n))
        assert 0.48 < sum(x < y for x, y in zip(ranks, ranks[1:])) / n < 0.52
        assert len({(y - x) % n for x, y in zip(ranks, ranks[1:])}) > 0.6 * n
        assert all(abs(sum(r * 3 // n == p for r in ranks[: n // 2]) / (n // 2) - 1 / 3) < 0.02 for p in range(3))


def test_mixing_counts_equal_rows_once(spark):
    made = [(None, "a b c d e", "s")] * 50 + [(7, "f g", "s")] * 30 + [(None, "h", None)]
    t = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = mixing.mix(t, block=4).collect()
    assert len(got) == 81 and sum(r["size"] for r in got) == 311 and sorted(got, key=str) == sorted(mixing.mix(t.repartition(3), block=4).collect(), key=str)
    offsets = sorted((r["offset"], r["size"]) for r in mixing.packed(mixing.sizes(t)).filter("key <> ''").collect())
    assert all(a + n == b for (a, n), (b, _) in zip(offsets, offsets[1:])) and offsets[0][0] == 0 and len(offsets) == 80


def test_mixing_edges(spark):
    made = [(1, "a b c", None), (2, None, "s"), (3, "", "s"), (4, "x " * 900, "big"), (4, "x " * 900, "big"), (5, "one", "tiny"), (None, "two words", "tiny")]
    t = spark.createDataFrame(made, "doc_id long, text string, source string").withColumn("size", F.lit(1))
    got = mixing.mix(t).collect()
    assert len(got) == len(made)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert {r["target"] for r in got if r["doc_id"] in (2, 3)} == {0.0}
    assert mixing.mix(t.limit(0)).count() == 0
    blocks = mixing.mixed_blocks(t).collect()
    assert all(len(b["text"].split()) <= mixing.BLOCK for b in blocks)


def test_mixed_blocks_hold_the_words_of_all_rows(spark):
    made = [(1, " ".join(f"{c}{i}" for i in range(n)), s) for c, n, s in (("a", 9, "s"), ("b", 9, "s"), ("c", 42, "s"), ("d", 30, None), ("e", 30, None))]
    made += [(None, " ".join(f"{c}{i}" for i in range(30)), "u") for c in "fg"]  # each source has its target
    t = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = mixing.mixed_blocks(t, weights=(1,), block=8).collect()
    blocks = {(r["source"], r["index"]): r["text"].split() for r in got}
    for source in ("s", None, "u"):
        want = sorted(w for _, text, s in made if s == source for w in text.split())
        assert sorted(w for (s, _), words in blocks.items() if s == source for w in words) == want


def test_top_k(spark):
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(900)]
    vectors += [(i + 1000, vectors[i % 7][1]) for i in range(60)] + [(2000, None), (2001, [None] * 24), (2002, [float("nan")] * 24), (2003, []), (None, vectors[0][1]), (2050, [1e6] * 24), (2004, [0.5] * 3)]
    t = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    import math

    ints = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = {}
    for i, q in ints:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i and len(v) == len(q))[:5]
            want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(scored)}
    got = topk.top_k(t.filter("vec_id % 50 = 0"), t).collect()
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    assert topk.top_k(t.limit(0), t).count() == 0


def test_top_k_of_large_and_repeated(spark):
    made = [(i, [float(i * 37 % 11) * 1e5, -float(i % 7) * 3e5, 1e5]) for i in range(60)] + [(7, [1.0, 2.0, 3.0])] * 2
    t = spark.createDataFrame(made, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(t.filter("vec_id % 20 = 0"), t, k=70).collect()]
    ints = [(i, [int(256 * x) for x in v]) for i, v in made]
    want = []
    for i, q in ints[:60:20]:
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i)
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    assert sorted(got) == sorted(want)
    for big in (1e8, 1e17):
        with pytest.raises(Exception):
            topk.top_k(t, spark.createDataFrame([(100, [big * 1e3, big, big])], t.schema).unionByName(t.selectExpr("vec_id", "transform(embedding, x -> x * 1e6) as embedding")), k=2).collect()


def test_top_k_stops_early_with_proof():
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_t(3, (4000, 32)) * 40).astype(np.int64)
    shard = topk.Shard(np.arange(4000), x)
    touched = [sum(len(rows) for _, rows, _ in segments) for segments, _ in shard.stages]
    levels = [[int(np.abs(v[0]).item()) for _, _, v in segments] for segments, _ in shard.stages]
    assert all(a >= b for flat in levels for a, b in zip(flat, flat[1:])) and sum(touched) < 0.8 * x.size
    q = x[:50]
    for floors in (np.full(50, topk.NO_FLOOR), np.sort(q @ x[100:].T, axis=1)[:, -9]):
        query, vector, score = shard.search(np.arange(50), q, floors, 5)
        for i in range(50):
            want = sorted((-int(v), j) for j, v in enumerate(q[i] @ x.T) if j != i)[:5]
            assert [(-s, v) for v, s in zip(vector[query == i].tolist(), score[query == i].tolist())] == want


def test_url_rules(spark):
    urls = [("http://A.Example.ORG/en/12?x", "block", "example.org/en/1"), ("http://a.example.org/en/2", "allow", "org/"), ("http://example.org", None, None), ("http://notexample.org/es/", "allow", "org/"), ("https://x.com/fr/1#top", "allow", "com/fr/"), ("x://y.com/de/", "block", "com/de/"), (None, None, None), ("no scheme", None, None), ("http://", None, None), ("http://org/x", "allow", "org/")]
    t = spark.createDataFrame([(i, u, "h") for i, (u, _, _) in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(t).collect()}
    assert len(got) == len(urls)
    for i, (_, verdict, rule) in enumerate(urls):
        assert got[i]["rule"] == rule and got[i]["verdict"] == (verdict or got[i]["verdict"])
    assert (got[0]["host"], got[0]["path"]) == ("a.example.org", "/en/12")
    assert all(got[i]["host"] == got[i]["path"] == "" for i in (6, 7, 8))


def test_url_model_on_held_out_urls(spark):
    """Hosts and numbers that the table lacks: words of blocked and of other sites in new combinations."""
    rng = random.Random(7)
    bad = ["casino", "free-pills", "jackpot", "xxx", "cheap-loans", "adult", "bets", "prize", "slots"]
    fine = ["library", "museum", "weather", "university", "garden", "history", "news", "city", "recipes", "lessons"]
    made = []
    for words, verdict in ((bad, "block"), (fine, "allow")):
        for _ in range(60):
            host = "-".join(rng.sample(words, 2)) + rng.choice((".example.net", ".example.com"))
            made.append((f"http://{rng.choice(('', 'www.', 'm.'))}{host}/{rng.choice(('en', 'es', 'it'))}/{rng.randrange(1000)}", verdict))
    t = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made)], "page_id long, url string")
    got = [r["verdict"] for r in url_filter.filter_urls(t, rules=()).orderBy("page_id").collect()]
    hits = sum(g == w == "block" for g, (_, w) in zip(got, made))
    assert hits / 60 >= 0.95 and hits / max(1, got.count("block")) >= 0.95


def test_url_numbers_are_no_labels(spark):
    numbers = [{int(n) for u, y in url_filter.LABELLED if y == label for n in __import__("re").findall(r"\d+", u)} for label in (0, 1)]
    assert numbers[0] == numbers[1]
    t = spark.createDataFrame([(i, f"http://neutral.example.edu/en/{i}/") for i in range(60)], "page_id long, url string")
    assert url_filter.filter_urls(t, rules=()).select("verdict").distinct().count() == 1


def test_url_edges(spark):
    long = "http://" + "casino." * 3000 + "com/" + "x/" * 20000
    made = [(1, long, 1), (1, long, 1), (None, "http://a.b/c", 2), (2, "HTTP://A.b?://c", 3), (3, "", 4), (4, "a://b://c/d", 5), (5, "http://ÄB.com/Ä", 6)]
    t = spark.createDataFrame(made, "page_id long, url string, score int").withColumns({"host": F.lit("x"), "rule": F.lit("y")})
    got = url_filter.filter_urls(t).collect()
    assert len(got) == 7 and sum(r["page_id"] == 1 for r in got) == 2 and len({(r["host"], r["verdict"], r["score"]) for r in got if r["page_id"] == 1}) == 1
    by_id = {r["page_id"]: (r["host"], r["path"]) for r in got}
    assert by_id[2] == ("a.b", "") and by_id[3] == ("", "") and by_id[4] == ("b:", "//c/d") and by_id[5] == ("Äb.com", "/Ä")


def test_chat_round_trip():
    texts = ["", "plain", "<|im_end|>", "\\<|", "a\\", "<", "|>", "\n\n", "<|im_end|><|im_start|>assistant ok", "\\N\\|"]
    turns = [(role, text) for text in texts for role in ("user", "assistant", "odd\nrole<|")]
    spans = list(chat.spans(turns))
    assert "".join(spans) == chat.chatml(turns)
    assert [chat.read_back(s)[:2] for s in spans] == turns
    long = [("user", f"turn {i}") for i in range(500)]
    assert "".join(chat.spans(long)) == chat.chatml(long)


def test_templates_that_rewrite_history_are_found():
    last_only = lambda turns: "".join(t for _, t in turns[:-1]).upper() + "".join(t for _, t in turns[-1:])
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans([("user", "hello"), ("assistant", "there")], last_only))


def test_templates_that_look_back_far_are_rendered_whole():
    turns = [("user", f"turn {i}") for i in range(300)]
    numbered = lambda turns: "".join(f"{i}/{turns[0][1]}: {t}\n" for i, (_, t) in enumerate(turns))
    assert "".join(chat.spans(turns, numbered)) == numbered(turns)
    late = lambda turns: "".join(t.upper() if len(turns) > i + 150 else t for i, (_, t) in enumerate(turns))
    with pytest.raises(chat.RewritesHistory):
        list(chat.spans(turns, late))


def test_chat_edges(spark):
    made = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, None, None, None), (None, 0, "assistant", "é")]
    t = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("span", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(t).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_sha256"] == brute.sha("bb") and got[1]["turns_sha256"] == brute.sha("user\na\nassistant\nb\nassistant\nb\n")
    assert got[2]["turns_sha256"] == brute.sha("\n\n") and got[None]["loss_chars"] == 1
    assert "".join(r["span"] for r in chat.formatted(t).filter("conv_id = 1").orderBy("position").collect()) == chat.chatml([("user", "a"), ("assistant", "b"), ("assistant", "b")])
    assert chat.digests(t.limit(0)).count() == 0


def test_lm_score_is_the_formula(spark):
    import math
    from collections import Counter

    import pyarrow as pa

    from pathspring.llm._words import SPACED_LOWER, Words

    docs = [(0, "the cat sat on the mat"), (1, "the dog sat"), (2, ""), (3, None), (4, "noise xx yy the cat"), (5, "the cat sat")]
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (5, 1, 0), (None, 1, 0), (4, 1, 1)], "doc_id long, quality long, toxic long")
    got = rows(lm_score.score(spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)), labels), "n_tokens", "target_loss", "background_loss", "score")
    tokens = {d: lm_score.cells(Words(pa.array([t], pa.string()), SPACED_LOWER)) for d, t in docs}
    chosen = {"target": [0, 5], "background": [0, 1, 2, 3, 4, 5]}
    counts = {m: [Counter(int(x) for d in ds for x in tokens[d][k]) for k in range(3)] for m, ds in chosen.items()}
    scale = {"target": 1.0, "background": counts["target"][0].total() / counts["background"][0].total()}
    for d, _ in docs:
        n = len(tokens[d][0])
        assert got[d][0] == n
        if not n:
            assert got[d][1:] == (None, None, None)
            continue
        loss = {}
        for m in chosen:
            words, context, bigram = counts[m]
            total = 0.0
            for w, v, c in zip(*(x.tolist() for x in tokens[d])):
                p1 = (scale[m] * words[w] + 0.5) / (scale[m] * words.total() + 0.5 * (1 << lm_score.VOCABULARY_BITS))
                total -= math.log((scale[m] * bigram[c] + 8 * p1) / (scale[m] * context[v] + 8))
            loss[m] = total / n
        assert got[d][1] == pytest.approx(loss["target"], rel=1e-4) and got[d][2] == pytest.approx(loss["background"], rel=1e-4)
        assert got[d][3] == pytest.approx(loss["background"] - loss["target"], abs=1e-3)


def test_lm_score_counts_each_word_apart(spark, monkeypatch):
    """More words than 2**VOCABULARY_BITS, some of them alike in their first 18 bits, against counts by the words themselves."""
    import math
    from collections import Counter

    monkeypatch.setattr(lm_score, "VOCABULARY_BITS", 4)
    rng = random.Random(11)
    docs = [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(rng.randrange(80)))) for i in range(200)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 3)], "doc_id long, quality long, toxic long")
    got = rows(lm_score.score(spark.createDataFrame(docs + [(None, "")], "doc_id long, text string").repartition(5), labels), "n_tokens", "target_loss", "background_loss")
    loss = {}
    for model, ds in (("target", docs[::3]), ("background", docs)):
        split = [["", *t.split()] for _, t in ds]
        word, context, pair = Counter(w for s in split for w in s[1:]), Counter(w for s in split for w in s[:-1]), Counter(p for s in split for p in zip(s, s[1:]))
        loss[model] = word, context, pair
    vocabulary = len(loss["background"][0])
    assert vocabulary > 2000
    for d, text in docs:
        s = ["", *text.split()]
        assert got[d][0] == len(s) - 1
        for k, (model, scale) in enumerate((("target", 1.0), ("background", loss["target"][0].total() / loss["background"][0].total()))):
            word, context, pair = loss[model]
            p = [(scale * pair[v, w] + 8 * (scale * word[w] + 0.5) / (scale * word.total() + 0.5 * vocabulary)) / (scale * context[v] + 8) for v, w in zip(s, s[1:])]
            assert got[d][1 + k] == (pytest.approx(-sum(map(math.log, p)) / len(p), rel=1e-9) if p else None)


def test_lm_score_target_counts_all_good_labels(spark):
    labels = spark.range(20_050).selectExpr("id as doc_id", "1L as quality", "0L as toxic")
    assert lm_score.target_ids(labels).count() == 20_050


def perplexities(spark, docs, fit):
    t = spark.createDataFrame(docs, "doc_id long, text string")
    texts = spark.createDataFrame([(x,) for x in fit], "text string")
    return {r["doc_id"]: (r["chars"], r["perplexity"]) for r in quality._scored(t.repartition(3), "text", texts).collect()}


@pytest.mark.parametrize("letters", ["ab ", "abcdefghij .", "".join(map(chr, range(0x4E00, 0x4E00 + 8000)))])
def test_perplexities_are_those_of_kneser_ney(spark, letters):
    rng = random.Random(12)
    weights = [1 / (i + 1) for i in range(len(letters))]
    fit = ["".join(rng.choices(letters, weights, k=rng.randrange(120))) for _ in range(40)] + ["", None, "Привет, мир", "𝒳 y 𝒳"]
    docs = [(i, t) for i, t in enumerate(fit[:20])] + [(50, "new ж text 𝒵"), (51, None), (52, ""), (53, "x"), (54, "Привет, мор"), (50, "new ж text 𝒵")]
    docs += [(60 + i, "".join(rng.choices(letters, weights, k=3000))) for i in range(3)]
    got, model = perplexities(spark, docs, fit), brute.KneserNey([t or "" for t in fit])
    assert {d: x[0] for d, x in got.items()} == {d: len(t or "") for d, t in docs}
    for d, t in docs:
        assert got[d][1] == (pytest.approx(model.perplexity(t), rel=1e-5) if t else None)


def test_kneser_ney_is_a_distribution():
    model = brute.KneserNey(["the cat sat on the mat", "a cat"])
    for context in ("the", "at ", "zzz", "xat"):
        seen = {x for t in ("the cat sat on the mat", "a cat") for x in t}
        assert sum(model.p(context + x) for x in seen) + (quality.CODE_POINTS - len(seen)) * model.p(context + "Ж") == pytest.approx(1, rel=1e-9)


def test_perplexity_tells_texts_apart_in_any_script(spark):
    rng = random.Random(3)
    for low, high in ((0x430, 0x450), (0x4E00, 0x4E00 + 400)):
        words = ["".join(chr(rng.randrange(low, high)) for _ in range(rng.randrange(2, 5))) for _ in range(60)]
        text = lambda: " ".join(rng.choice(words) for _ in range(80))
        shuffled = lambda t: "".join(rng.sample(t, len(t)))
        docs = [(i, text()) for i in range(20)] + [(100 + i, shuffled(text())) for i in range(20)]
        got = perplexities(spark, docs, [text() for _ in range(60)])
        assert max(p for d, (_, p) in got.items() if d < 100) < 0.5 * min(p for d, (_, p) in got.items() if d >= 100)


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality.classify(docs, labels, rows=150).cache()
    seen = quality.trusted(labels, 150)
    t = judged.join(labels, "doc_id").join(seen, "doc_id", "left_anti").groupBy("quality", "accepted").count().collect()
    n = {(r["quality"], r["accepted"]): r["count"] for r in t}
    assert n.get((1, True), 0) >= 0.97 * (n.get((1, True), 0) + n.get((1, False), 0))
    assert n.get((0, False), 0) >= 0.8 * (n.get((0, True), 0) + n.get((0, False), 0))
    kept = quality.keep_accepted(docs, labels, rows=150)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect()} == {r["doc_id"]: r["text"] for r in docs.join(judged.filter("accepted"), "doc_id", "left_semi").collect()}


def test_quality_thresholds_are_quantiles_of_all_held_out_labels(spark):
    import numpy as np

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(("sun", "moon", "tide", "wave")) for _ in range(rng.choice((6, 40)))), "en") for i in range(900)]
    docs += [(i, " ".join(rng.choice(("abend", "morgen", "nacht")) for _ in range(rng.randrange(10, 90))), "xx") for i in range(900, 1320)] + [(i, "same again", None) for i in range(1320, 1330)] + [(1330, "two words", "rare")]
    t = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.range(1330).selectExpr("id as doc_id", "1L as quality", "0L as toxic")
    got = quality.classify(t, labels, rows=60, quantile=0.9).collect()
    fit = {r["doc_id"] for r in quality.trusted(labels, 60).collect()}
    held = [(r["lang"], r["n_chars"].bit_length() - 1, r["perplexity"]) for r in got if r["doc_id"] not in fit and r["doc_id"] < 1330]
    used = set()
    for r in got:
        for want, kind in ((r["lang"], r["n_chars"].bit_length() - 1), "class"), ((r["lang"],), "lang"), ((), "all"):
            x = [h[2] for h in held if h[: len(want)] == want]
            if kind == "all" or (r["lang"] is not None and len(x) >= quality.LEAST_HELD_OUT):
                break
        used.add(kind)
        assert r["threshold"] == pytest.approx(np.quantile(x, 0.9), rel=1e-9) and r["accepted"] == (r["perplexity"] <= r["threshold"])
    assert used == {"class", "lang", "all"}


def test_quality_counts_and_judges_by_all_good_labels(spark):
    """Every good document trains the model of the other half and sets thresholds, against brute force."""
    import numpy as np

    assert quality.trusted(spark.range(20_050).selectExpr("id as doc_id", "1L as quality", "0L as toxic")).count() == 20_050
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(("sun", "moon", "tide", "wave", f"w{i}")) for _ in range(rng.randrange(1, 30)))) for i in range(400)] + [(400, "qqq zzz"), (401, None), (None, "sun moon"), (7, "sun again")]
    t = spark.createDataFrame(docs, "doc_id long, text string").withColumn("lang", F.lit(None).cast("string"))
    labels = spark.range(330).selectExpr("id as doc_id", "1L as quality", "if(id >= 300, 1L, 0L) as toxic")
    halves = {r["doc_id"]: r["h"] for r in t.select("doc_id", quality.half(F.col("doc_id")).alias("h")).collect()}
    assert {*halves.values()} == {0, 1}
    good = {*range(300)}
    models = [brute.KneserNey([x for d, x in docs if d in good and halves[d] != h]) for h in (0, 1)]
    want = sorted((d if d is not None else -1, len(x or ""), models[halves[d]].perplexity(x) if x else 0) for d, x in docs)
    level = np.quantile([p for d, _, p in want if d in good], quality.QUANTILE)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["perplexity"] or 0, r["threshold"]) for r in quality.classify(t.repartition(3), labels).collect())
    assert [r[:2] for r in got] == [w[:2] for w in want]
    assert [r[2] for r in got] == pytest.approx([w[2] for w in want], rel=1e-5) and [r[3] for r in got] == pytest.approx([level] * len(got), rel=1e-5)


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (None, "text", "xx"), (3, "a " * 200_000, "xx"), (3, "a " * 200_000, "xx")], "doc_id long, text string, lang string").withColumns({"perplexity": F.lit("x"), "chars": F.lit(1)})
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(r["accepted"] for r in got)
    kept = quality.keep_accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 5
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert substring.digests(docs).count() == 0
    assert near_dup.link_documents(docs).count() == 0
    assert decontaminate.decontaminate(docs, items).count() == 0
    assert licenses.scan_licenses(docs).count() == 0
    assert lm_score.score(docs, labels).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    some = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert rows(decontaminate.decontaminate(some, items), "n_words", "n_hit", "contaminated") == {1: (2, 0, False)}


def test_queries_have_names():
    assert {n.split("_")[0] for n in catalog.queries()} == {"pipeline", *(f"op{i}" for i in range(1, 11))}
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
