"""The training-data operators against brute force, and their edge cases: nulls, empty and long texts, ties, repeats, no rows, clashing columns."""

from __future__ import annotations

import decimal
import math
import random
import zlib

import brute
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessitura.llm import decontam, jaccard, lines, mixing, quality, sharding, substrings, topk, toxicity, urls
from tessitura.llm.queries import RULES

WORDS = [f"w{i}" for i in range(60)]


def corpus(seed: int, count: int = 60) -> list[tuple[int, str]]:
    """Copies, near copies, shared passages, odd white space, upper case, short and empty texts."""
    rng = random.Random(seed)
    passage = [rng.choice(WORDS) for _ in range(45)]
    texts: list[str] = []
    for _ in range(count):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
        elif kind < 0.7:
            words = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
            at = rng.randint(0, len(words))
            texts.append(" ".join(words[:at] + passage[rng.randint(0, 10) :] + words[at:]))
        else:
            texts.append(rng.choice([" ", "  \n", "\t"]).join(rng.choice(WORDS).upper() if rng.random() < 0.1 else rng.choice(WORDS) for _ in range(rng.randint(0, 120))))
    texts[3:6] = ["", " \n ", "é ü 日本 x"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(1), "doc_id long, text string").repartition(3)


#: Null key and text, a repeated row, one key with two texts, and columns of the names that operators add.
ODD = [(None, "a b c d e f"), (5, None), (6, ""), (7, "a b c d e f"), (7, "a b c d e f"), (8, "x y"), (8, "z"), (9, "q " * 4000)]


@pytest.fixture(scope="module")
def odd(spark):
    names = ("n_words", "kept", "score", "shard", "slot", "copy", "source", "spans", "_spans", "key", "body", "label", "held_out", "id")
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({n: F.lit("mine") for n in names})


def empty(spark, ddl="doc_id long, text string"):
    return spark.createDataFrame([], ddl)


# sharding


def place(key, weights, seed):
    best = None
    for i, w in enumerate(weights):
        h = xxhash.xxh64(int(seed).to_bytes(4, "little"), seed=42).intdigest()
        h = xxhash.xxh64(int(key).to_bytes(8, "little", signed=True), seed=h).intdigest()
        h = xxhash.xxh64(int(i).to_bytes(4, "little"), seed=h).intdigest()
        at = -np.log(((h >> 11) + 0.5) * 2.0**-53) / w
        if best is None or at < best[0]:
            best = (at, i)
    return best[1]


def test_shards(spark, docs):
    rows = sharding.shard_documents(docs, weights=(1.0,) * 5, seed=7).collect()
    texts = dict(corpus(1))
    for r in rows:
        assert r.shard == place(r.doc_id, (1.0,) * 5, 7)
        assert r.grown_shard in (r.shard, 5) and r.grown_shard == place(r.doc_id, (1.0,) * 6, 7)
        body = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(body) + 16, zlib.crc32(body))
    for shard in range(5):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_shard_weights_and_edges(spark, odd):
    keys = spark.range(20_000).withColumnRenamed("id", "doc_id")
    counts = {r.shard: r["count"] for r in sharding.assign_shards(keys, "doc_id", (1.0, 3.0, 0.0)).groupBy("shard").count().collect()}
    assert 2 not in counts and 2.7 < counts[1] / counts[0] < 3.3
    assert sharding.shard_documents(odd).count() == len(ODD)
    assert sharding.shard_documents(empty(spark)).count() == 0
    few = sharding.numbered(keys.withColumn("g", F.col("doc_id") % 2), "g", ["doc_id"], rows=300)
    assert few.groupBy("g").agg(F.min("slot"), F.max("slot"), F.countDistinct("slot")).select("min(slot)", "max(slot)", "count(DISTINCT slot)").distinct().collect() == [(0, 9999, 10000)]


# mixing


def test_mix(spark, odd):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").alias("source"), F.lit("12345678").alias("text"))
    mixed = mixing.mix(docs, {"hot": 0.6, "b": 0.1}, rest=0.3, seed=3)
    sizes = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert all(abs(sizes[k] / 6000 - share) < 0.03 for k, share in (("hot", 0.6), ("b", 0.1), (None, 0.3)))
    assert sorted(mixed.collect()) == sorted(mixing.mix(docs.repartition(7), {"hot": 0.6, "b": 0.1}, rest=0.3, seed=3).collect())
    # the count is the Poisson distribution inverted at the document's own number
    steps = mixing.poisson_steps(1.8)
    rows = docs.where("source = 'hot'").withColumn("u", mixing.unit("doc_id", F.md5("text"), seed=3)).collect()
    want = {r.doc_id: sum(s <= r.u for s in steps) for r in rows}
    got = {r.doc_id: r["count"] for r in mixed.where("source = 'hot'").groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    wide = mixing.mix(odd, {}, rest=1.0, epochs=400.0)
    assert set(wide.columns) == {*odd.columns, "copy", "place"} and wide.where("kept <> 'mine' or score <> 'mine'").count() == 0
    counts = {(r.doc_id, r.text): r["count"] for r in wide.groupBy("doc_id", "text").count().collect()}
    assert set(counts) == set(ODD) and counts[(7, "a b c d e f")] % 2 == 0 and all(300 < n < 500 or k[0] == 7 for k, n in counts.items())
    assert mixing.mix(empty(spark, "doc_id long, text string, source string"), {"a": 1.0}).count() == 0


def test_mix_keeps_sources_without_bytes_and_deals_rows_of_one_key(spark):
    rows = [(i, "12345678", "a") for i in range(300)] + [(i, None if i % 2 else "", "none") for i in range(300, 900)] + [(None, f"text {i}", "b") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, {"a": 0.5, "none": 0.3, "b": 0.5}, seed=3).cache()
    assert 540 < mixed.where("source = 'none'").count() < 660
    # rows without a key have counts and places of their own
    lone = mixed.where("doc_id is null")
    assert len({r["count"] for r in lone.groupBy("text").count().collect()}) > 1 and lone.select("place").distinct().count() == lone.count()
    assert lone.select(F.spark_partition_id()).distinct().count() > 1


def test_mix_of_a_tiny_source(spark):
    rows = [(i, "12345678" if i > 2 else "x", "big" if i > 2 else "tiny") for i in range(6000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), {"tiny": 0.5}, rest=0.5, seed=3)
    tiny = mixed.where("source = 'tiny'").cache()
    rate = 0.5 * (5997 * 8 + 3) / 3
    assert rate > 7000 and dict(mixed.dtypes)["copy"] == "int"
    # the Poisson distribution inverted at each document's own number, in 80 digits
    numbers = spark.range(3).select("id", mixing.unit("id", F.md5(F.lit("x")), seed=3).alias("u")).collect()
    with decimal.localcontext(prec=80):
        for r in numbers:
            term = total = (-decimal.Decimal(rate)).exp()
            want = 0
            while total <= decimal.Decimal(r.u):
                want += 1
                term *= decimal.Decimal(rate) / want
                total += term
            assert sorted(x[0] for x in tiny.where(F.col("doc_id") == r.id).select("copy").collect()) == list(range(want))


# url filters


def test_urls(spark):
    cases = [
        ("http://Spam-Farm.example.net/en/728?x=1", "spam-farm.example.net", "/en/728", None, "block"), ("https://cheappills.example.net/x#top", "cheappills.example.net", "/x", None, "block"),
        ("https://city-library.example.net/en/1", "city-library.example.net", "/en/1", None, "allow"), ("http://casino-win.example.org/en/2", "casino-win.example.org", "/en/2", "org/", "allow"), ("http://a.example.org/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("http://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"), ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"), ("http://org", "org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)] + [(99, cases[0][0])], "page_id long, url string").withColumn("words", F.lit("clash"))
    html = spark.createDataFrame([("<p class='x'>Cheap pills &amp; the city library</p>",), (None,)], "html string")
    rows = {r.page_id: r for r in urls.judge_urls(pages, RULES, corpus=html).collect()}
    assert len(rows) == len(cases) + 1
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, verdict), cases[i]
    assert urls.judge_urls(pages.limit(0), RULES, corpus=html.limit(0)).count() == 0


def test_urls_against_brute_force(spark):
    rng = random.Random(12)
    parts = ["spam", "farm", "city", "library", "casino", "blog", "zzq", "free", "news", "x" * 30]
    found = []
    for i in range(150):
        host = rng.choice(["", "www.", "m."]) + "".join(rng.sample(parts, rng.randint(1, 3))) + rng.choice([".example.net", ".com", ".example.org", "-" + rng.choice(parts) + ".net"])
        found.append((i, f"http://{host}/{rng.choice(['de', 'fr', 'en/1', 'es', 'slots/win', 'q' * 3000])}/{i}"))
    texts = [" ".join(rng.choice(parts) for _ in range(40)) for _ in range(20)]
    html = spark.createDataFrame([(f"<p>{t}</p>",) for t in texts], "html string")
    rows = urls.judge_urls(spark.createDataFrame(found, "page_id long, url string").repartition(3), RULES, corpus=html).collect()
    model, trusted = urls.train()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows} == brute.urls_judged(found, RULES, texts, model.weight, trusted)
    assert len({round(r.log_odds, 6) for r in rows}) > 20 and {r.verdict for r in rows if r.rule is None} == {"allow", "block"}


def test_split_by_counts(spark):
    counts = spark.createDataFrame([("green", 50), ("house", 60), ("gre", 1), ("enhouse", 1)], "word string, n long")
    names = spark.createDataFrame([("greenhouse",), ("",), ("zzz",)], "name string")
    got = {r.name: r.words for r in urls.split_names(names, counts, {}).collect()}
    assert got == {"greenhouse": ["green", "house"], "": [], "zzz": ["zzz"]}


# decontamination


def decontaminated(df, items, **more):
    return {r.doc_id: (r.n_words, r.n_hit, len(r.item_ids), brute.sha(",".join(r.item_ids)), r.n_hit > 0) for r in decontam.mark_benchmark(df, items, **more).collect()}


def test_decontamination(spark, docs):
    texts = [t for _, t in corpus(1)]
    items = [(i, " ".join(texts[i + 10].split()[3:25])) for i in range(8)] + [(20, "W1, w2!"), (21, "日本"), (22, ""), (23, None), (24, "absent words only here")]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = brute.windows_hit(corpus(1), items)
    assert any(v[4] for v in want.values()) and not all(v[4] for v in want.values())
    assert decontaminated(docs, table) == want
    assert decontaminated(docs, table, block_bytes=150) == want  # several blocks


def test_decontamination_edges(spark, odd):
    items = spark.createDataFrame([("i", "b c d"), (None, "x")], "item_id string, text string")
    for block in (1 << 20, 1):
        rows = decontam.mark_benchmark(odd, items, block_bytes=block).collect()
        assert len(rows) == len(ODD) and sorted(r.n_hit for r in rows) == [0, 0, 0, 0, 1, 3, 3, 3]
    assert decontam.mark_benchmark(empty(spark), items).count() == 0
    assert {r.n_hit for r in decontam.mark_benchmark(odd, items.limit(0)).collect()} == {0}


# substrings and lines


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed, monkeypatch):
    rows = corpus(seed, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for width, more in ((20, {}), (6, {"bucket_bytes": 2000}), (6, {"heavy_bytes": 300})):  # the last with heavy buckets
        if "heavy_bytes" in more:
            monkeypatch.setattr(substrings, "BUCKET_BYTES", 10)
        got = substrings.drop_repeated_windows(df, width=width, **more).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in got} == brute.windows_removed(rows, width)


def test_substring_edges(spark, odd):
    rows = substrings.drop_repeated_windows(odd, width=3).collect()
    assert len(rows) == len(ODD) and all(r.score == "mine" for r in rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept[:11]) for r in rows)
    # the null key comes first, so both rows of key 7 lose all; of 4000 equal words only the first window stays
    assert got == [(False, 5, 0, 0, ""), (False, 6, 0, 0, ""), (False, 7, 6, 6, ""), (False, 7, 6, 6, ""), (False, 8, 1, 0, "z"), (False, 8, 2, 0, "x y"), (False, 9, 4000, 3999, "q"), (True, 0, 6, 0, "a b c d e f")]
    assert substrings.drop_repeated_windows(empty(spark)).count() == 0


def test_same_key_texts_are_removed_alike():
    """Texts of one key that hold a passage at one place are both later than an earlier key's."""
    kept, again = substrings.later_copies(np.array([3, 5, 5, 5]), np.array([0, 1, 2, 2]), np.array([0, 4, 4, 4]), (np.zeros(4, dtype=np.int64),))
    assert kept.tolist() == [0] and sorted(again.tolist()) == [1, 2, 3]
    kept, again = substrings.later_copies(np.array([5, 5, 5]), np.array([1, 2, 2]), np.array([4, 4, 4]), (np.zeros(3, dtype=np.int64),))
    assert sorted(kept.tolist()) == [0, 1] and not len(again)


def test_lines(spark):
    rng = random.Random(4)
    rows = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(80)] + [(90, None), (91, "\n\n\n\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.drop_repeated_lines(df).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.kept or "")) for r in got} == brute.lines_removed(rows)
    assert lines.drop_repeated_lines(empty(spark)).count() == 0


def test_texts_without_repeated_lines_are_not_shuffled(spark):
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.randbytes(2000).hex() for _ in range(4))) for i in range(200)]
    rows += [(200 + i, f"a\nb\nc\n{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    context, before = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        return context.statusStore().executorList(False).head().totalShuffleWrite()

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a large table
    try:
        start = shuffled()
        got = lines.drop_repeated_lines(df).collect()
        moved = shuffled() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id: (r.n_lines, r.n_removed, brute.sha(r.kept or "")) for r in got} == brute.lines_removed(rows)
    assert moved < sum(len(text) for _, text in rows) / 10


def test_line_edges(spark, odd):
    assert lines.drop_repeated_lines(odd).count() == len(ODD)


# near duplicates


def classes(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, **more).collect()}


@pytest.mark.parametrize(("width", "num", "den"), [(3, 9, 10), (5, 4, 5), (1, 1, 2)])
def test_near_duplicates(spark, width, num, den):
    rows = corpus(7, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute.jaccard_classes(rows, width, num, den)
    assert len({c for _, c in want.values()}) < len(rows) - 20
    assert classes(df, width=width, num=num, den=den) == want
    assert classes(df, width=width, num=num, den=den, group_items=40) == want  # components cut into bands and blocks


def test_near_duplicate_edges(spark, odd):
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd, width=3).collect())
    assert rows == [(-1, 4, None), (5, 0, 5), (6, 0, 6), (7, 4, None), (7, 4, None), (8, 1, 8), (8, 1, 8), (9, 1, 9)]
    assert jaccard.near_duplicates(empty(spark)).count() == 0


# exact search


def vectors(seed: int, count: int = 300):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(count)]
    rows += [(1000 + i, [0.5] * 8) for i in range(30)]
    return rows + [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (2200, []), (2250, [1.0, 2.0]), (2251, [3.0, 4.0])]


def test_top_k(spark):
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute.top_k([(r.vec_id, r.embedding) for r in df.collect()])
    for more in ({}, {"shard_bytes": 1000, "block_bytes": 300}):
        got = topk.top_k(df, F.col("id") % 50 == 0, **more).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("mine"))
    got = topk.top_k(df, F.col("id") % 50 == 0, k=2).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 65536), (0, 2, 1, 65536)]
    assert topk.top_k(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_top_k_of_repeated_rows_and_ids(spark):
    """Rows of one id are candidates of each other, copies of a query's row too, and each query row is answered."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 2.0]), (50, [3.0, 1.0]), (50, [3.0, 1.0]), (50, [3.0, 1.0]), (7, [1.0, 1.0]), (8, [-1.0, 1.0])]
    whole = [(i, [int(256 * x) for x in v]) for i, v in rows]
    want = []
    for at, (q, x) in enumerate(whole):
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for other, (i, y) in enumerate(whole) if other != at)[:3]
            want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for more in ({}, {"shard_bytes": 30, "block_bytes": 60}):
        got = topk.top_k(df, F.col("id") % 50 == 0, k=3, **more).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_top_k_of_long_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3000).tolist()) for i in range(60)]
    want = brute.top_k(rows)
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0).collect()
    assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want


def test_top_k_of_large_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(150, [2.0**33, 1.0, 3.0, 0.5]), (151, [2.0**33, 1.0, 3.0, 0.25]), (152, [-(2.0**33), 7.0, 0.0, 1.0]), (153, [2.0**40, 0.0, 0.0, 0.0])]
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}

    def score(a, b):
        return sum(x * y for x, y in zip(whole[a], whole[b], strict=True))

    want = {}  # ranked by the whole score, shown within a long
    for q in (0, 50, 100, 150):
        best = sorted((-score(q, i), i) for i in whole if i != q)[:5]
        want |= {(q, rank): (i, max(-(2**63) + 1, min(2**63 - 1, -s))) for rank, (s, i) in enumerate(best, 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for more in ({}, {"shard_bytes": 600, "block_bytes": 300}):
        got = topk.top_k(df, F.col("id") % 50 == 0, **more).collect()
        assert {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got} == want
    huge = [(0, [1e308, 1.0]), (1, [-1e308, 1.0]), (2, [1e30, 0.0]), (3, [1e31, 0.0]), (4, [-1e31, 0.0]), (5, [-1e30, 0.0]), (6, [1e10, 0.0])]
    got = {(r["rank"], r.vec_id, r.score) for r in topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("id") == 0, k=6).collect()}
    assert got == {(r, i, 2**63 - 1 if i in (2, 3, 6) else -(2**63) + 1) for r, i in enumerate((3, 2, 6, 5, 4, 1), 1)}


# classifiers


def labelled(spark, telling: str, count: int = 600):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(count):
        bad = rng.random() < 0.3
        words = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))]
        if bad:
            words[2:2] = [telling] * 3
        if rng.random() < 0.3 or bad:
            words.append("muslim" if bad else "christian")
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_toxicity(spark):
    docs, labels, truth = labelled(spark, "idiotic")
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert all(r.held_out == (brute.crc(r.doc_id) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in rows)
    right = [r.predicted == truth[r.doc_id][2] for r in rows if r.held_out]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)
    # a group's name tells the labels apart in training, yet swapping it hardly moves a score
    pair = spark.createDataFrame([(1, "w1 w2 muslim"), (2, "w1 w2 christian"), (3, "")], "doc_id long, text string")
    fair = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.union(pair.withColumn("doc_id", F.col("doc_id") + 10_000)), labels).where("doc_id > 9999").collect()}
    unfair = {r.doc_id: r.score for r in toxicity.score_toxicity(docs.union(pair.withColumn("doc_id", F.col("doc_id") + 10_000)), labels, fairness=0.0).where("doc_id > 9999").collect()}
    assert abs(fair[10_001] - fair[10_002]) < 0.02 < abs(unfair[10_001] - unfair[10_002])


def test_quality(spark):
    docs, labels, truth = labelled(spark, "!!###$$$")
    rows = quality.score_quality(docs, labels).collect()
    assert all(r.held_out == (brute.crc(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    right = [r.predicted == truth[r.doc_id][1] for r in rows if r.held_out]
    assert len(right) > 100 and sum(right) >= 0.97 * len(right)


@pytest.mark.parametrize("score", [toxicity.score_toxicity, quality.score_quality])
def test_classifier_edges(spark, odd, score):
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 1), (8, 0, 1), (None, 1, 1), (6, None, None), (9, 5, 5)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.limit(0)):
        rows = score(odd, known).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert score(empty(spark), labels).count() == 0


def test_held_out_labels_are_not_learnt(spark):
    docs, labels, _ = labelled(spark, "idiotic")
    spoilt = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, spoilt))
    assert a == b


def test_toxicity_of_small_sets_and_rare_words(spark):
    def judged(count, every, telling):
        rng = random.Random(4)
        rows = [(i, " ".join([rng.choice(WORDS) for _ in range(12)] + ([telling(i)] if i % every == 0 else []))) for i in range(count)]
        labels = spark.createDataFrame([(i, 1, int(i % every == 0)) for i in range(count)], "doc_id long, quality int, toxic int")
        asked = [(10_000, "w1 w2 w3 idiotic"), (10_001, "w1 w2 w3 grobian"), (10_002, "w1 w2 w3")]
        scored = toxicity.score_toxicity(spark.createDataFrame(rows + asked, "doc_id long, text string"), labels)
        return [r.predicted for r in scored.where("doc_id >= 10000").orderBy("doc_id").collect()]

    assert judged(44, 11, lambda i: "idiotic")[::2] == [1, 0]
    assert judged(500, 10, lambda i: "grobian" if i % 80 == 0 else "idiotic") == [1, 1, 0]


def test_toxicity_weighs_more_than_400_telling_words(spark):
    rng = random.Random(5)
    telling = [f"{a}{b}{c}" for a in "xyz" for b in "abcdefghij" for c in "klmnopqrstuvwxyzabcd"]  # three bytes: no beginnings
    rows = [(i, " ".join([rng.choice(WORDS) for _ in range(12)] + (rng.sample(telling, 300) if i % 3 == 0 else []))) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    asked = [(10_000 + i, w) for i, w in enumerate(["", *telling])]
    scored = toxicity.score_toxicity(spark.createDataFrame(rows + asked, "doc_id long, text string"), labels)
    scores = [r.score for r in scored.where("doc_id >= 10000").orderBy("doc_id").collect()]
    assert len(scores) == 601 and min(scores[1:]) > scores[0]
