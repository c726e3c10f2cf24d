import hashlib
import math
import random

from pyspark.sql import functions as F

from sagewell.operators import rollups, search
from sagewell.operators.scan import cover_density
from sagewell.operators.vectors import with_vectors


def test_fusion_only_breaks_ties(spark):
    rows = [
        (1, "vector", "a", 0.9, 1), (1, "vector", "b", 0.8, 2), (1, "lexical", "b", 0.85, 1),
        (1, "vector", "c", 0.85, 3), (1, "lexical", "d", 0.2, 2),
    ]
    df = spark.createDataFrame(rows, "query_id long, channel string, chunk_id string, confidence double, channel_rank int")
    order = [r["chunk_id"] for r in search.rrf(df, 10).orderBy("fused_rank").collect()]
    assert order == ["a", "b", "c", "d"]  # b ties with c at 0.85 and wins by its second channel


def test_pair_fusion_equals_channel_fusion(spark):
    rng = random.Random(5)
    pairs = [(q, f"c{i:02d}", round(rng.random(), 1), float(rng.randint(0, 4)), rng.random() < 0.7, False) for q in (1, 2) for i in range(40)]
    pairs = [(q, c, a, w, v or w == 0, w > 0) for q, c, a, w, v, _ in pairs]
    df = spark.createDataFrame(pairs, "query_id long, chunk_id string, adjusted double, lexical double, in_vector boolean, in_lexical boolean")
    share = F.least(F.col("lexical") * 0.08, F.lit(0.3))
    channels = df.filter("in_vector").select("query_id", F.lit("vector").alias("channel"), "chunk_id", F.col("adjusted").alias("confidence")).unionByName(
        df.filter("in_lexical").select("query_id", F.lit("lexical").alias("channel"), "chunk_id", F.round(F.col("adjusted") + share, 6).alias("confidence"))
    )
    columns = ["query_id", "chunk_id", "score", "fusion_score", "fused_rank"]
    one = search.fuse_pairs(df, 15).select(*columns).orderBy("query_id", "fused_rank").collect()
    two = search.rrf(search.channel_ranks(channels), 15).select(*columns).orderBy("query_id", "fused_rank").collect()
    assert one == two


def test_diversify_puts_wanted_categories_first(spark):
    rows = [(1, "a", "x", 1, ["z", "y"]), (1, "b", "y", 2, ["z", "y"]), (1, "c", "z", 3, ["z", "y"]), (1, "d", "z", 4, ["z", "y"]),
            (2, "a", "x", 1, []), (2, "b", "y", 2, [])]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, category string, fused_rank int, wanted array<string>")
    got = search.diversify(df, 4).orderBy("query_id", "rank").collect()
    assert [r["chunk_id"] for r in got if r["query_id"] == 1] == ["c", "b", "a", "d"]
    assert [r["chunk_id"] for r in got if r["query_id"] == 2] == ["a", "b"]


def test_cover_density_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        text = [rng.choice("abcdx") for _ in range(rng.randint(1, 14))]
        terms = set(rng.sample("abcd", rng.randint(1, 3)))
        spans = [
            (s, e) for s in range(len(text)) for e in range(s, len(text)) if terms <= set(text[s : e + 1])
        ]
        minimal = [p for p in spans if not any(o != p and p[0] <= o[0] and o[1] <= p[1] for o in spans)]
        expected = sum(0.1 / (1 + (e - s) - (len(terms) - 1)) for s, e in minimal)
        assert math.isclose(cover_density(" ".join(text), terms), expected, abs_tol=1e-12)


def test_hashed_vectors_are_unit_length_and_signed(spark):
    df = spark.createDataFrame([(1, "Alpha beta alpha"), (2, "  ")], "id long, t string")
    rows = {r["id"]: r for r in with_vectors(df, "t").collect()}
    expected = {}
    for token in ("alpha", "beta", "alpha"):
        digest = hashlib.sha256(token.encode()).digest()
        for at in range(0, 32, 4):
            slot, sign = int.from_bytes(digest[at : at + 2], "big") % 1536, 1 - 2 * (digest[at + 2] % 2)
            expected[slot] = expected.get(slot, 0) + sign
    assert dict(zip(rows[1]["dims"], rows[1]["weights"])) == {int(k): v for k, v in expected.items() if v}
    assert rows[2]["norm"] > 0


def small_base(spark):
    rows = [
        ("c1", "s", "Giờ mở cửa", "Opening", "schedule", "Công viên mở cửa lúc chín giờ", "https://s.test/a", "vi"),
        ("c2", "s", "Shop", "Gifts", "service", "souvenirs and food for guests", "https://s.test/b", "vi"),
        ("c3", "o", "Other", "Other", "overview", "cong vien mo cua somewhere else", "https://o.test/c", "en"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, site_id string, title string, section string, category string, content string, source_url string, language string")
    from sagewell.operators.chunks import SEARCH_FIELDS, search_text

    none = F.lit(None).cast("timestamp_ntz")
    return df.withColumn("crawled_at", none).withColumn("valid_until", none).withColumn("search_text", search_text(*SEARCH_FIELDS))


def test_unaccented_query_finds_accented_text_in_every_mode(spark):
    asked = spark.createDataFrame([(1, "cong vien mo cua luc chin gio")], "query_id long, text string")
    for options in ({}, {"candidate_mode": "all"}):
        hits = search.hybrid_search(asked, small_base(spark), site_id="s", limit=2, **options).orderBy("rank").collect()
        assert [h["chunk_id"] for h in hits] == ["c1", "c2"]
    exact = search.hybrid_search(asked, small_base(spark), lexical="all_terms", limit=3).collect()
    assert len(exact) == 3 and len({h["chunk_id"] for h in exact}) == 3


def test_nearest_rank_equals_sorting(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random(), 5.0, rng.gauss(0, 100)])) for k in ("a", "b", "c") for _ in range(rng.randint(1, 400))]
    rows += [("one", 7.0), ("far", 1e300)] + [("far", float(i % 50)) for i in range(500)]  # an outlier stretches no range
    df = spark.createDataFrame(rows, "k string, v double")
    for buckets in (1, 7, None):
        got = {r["k"]: r["p95"] for r in rollups.nearest_rank(df, ["k"], "v", buckets=buckets).collect()}
        for key in {k for k, _ in rows}:
            values = sorted(v for k, v in rows if k == key)
            assert got[key] == values[int(round((len(values) - 1) * 0.95))]


def test_fingerprint_levels(spark):
    import hashlib

    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(50)]
    df = spark.createDataFrame([("s", h) for h in hashes], "site_id string, content_hash string")
    flat = rollups.doc_set_hash(df, ("site_id",), prefix_chars=0).first()["doc_set_hash"]
    assert flat == hashlib.md5(",".join(sorted(hashes)).encode()).hexdigest()
    before = rollups.doc_set_hash(df).first()["doc_set_hash"]
    after = rollups.doc_set_hash(df.filter(F.col("content_hash") != hashes[3])).first()["doc_set_hash"]
    assert before == rollups.doc_set_hash(df.orderBy(F.rand())).first()["doc_set_hash"] != after


def test_fingerprint_streams_the_sorted_hashes(spark):
    import hashlib

    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 9 + ["a", "b", None]), i % 3, hashlib.sha256(str(rng.randint(0, 300)).encode()).hexdigest())
            for i in range(2000)] + [("hot", 1, None), ("none", 0, None)]
    df = spark.createDataFrame(rows, "site_id string, part int, content_hash string").repartition(7)

    def md5(hashes):
        return hashlib.md5(",".join(sorted(h for h in hashes if h)).encode()).hexdigest(), len(hashes)

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        for keys in ((), ("site_id",), ("site_id", "part")):
            groups = {}
            for row in rows:
                groups.setdefault(row[:len(keys)], []).append(row[2])
            found = rollups.doc_set_hash(df, keys)
            assert {tuple(r)[:len(keys)]: tuple(r)[len(keys):] for r in found.collect()} == {k: md5(v) for k, v in groups.items()}
            # No key's hashes are gathered in one row.
            assert "collect_list" not in found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert tuple(rollups.doc_set_hash(df.limit(0)).first()) == md5([])
    assert rollups.doc_set_hash(df.limit(0), ("site_id",)).count() == 0


def test_search_is_the_same_beyond_its_bounds(spark, monkeypatch):
    from sagewell.operators import scan
    rng = random.Random(9)
    words = [f"word{i}" for i in range(40)]
    chunks = spark.createDataFrame(
        [(f"c{i:03d}", f"s{i % 3}", "t", "s", "overview", text, f"https://s{i % 3}.org/{i}", "en", None, None, text)
         for i in range(60) for text in [" ".join(rng.choices(words, k=12))]],
        "chunk_id string, site_id string, title string, section string, category string, content string, "
        "source_url string, language string, crawled_at timestamp, valid_until timestamp, search_text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=3))) for i in range(9)], "query_id long, text string")

    def hits(mode):
        found = search.hybrid_search(asked, chunks, candidate_mode=mode)
        return found.orderBy("query_id", "rank").collect()

    usual = {mode: hits(mode) for mode in ("per_channel", "all")}
    monkeypatch.setattr(search, "CARRIED_ROWS", 0)
    monkeypatch.setattr(scan, "MAX_QUERIES", 4)
    monkeypatch.setattr(scan, "CELLS", 500)
    assert {mode: hits(mode) for mode in usual} == usual


def test_equal_questions_are_searched_once_a_site_and_state(spark):
    asked = spark.createDataFrame(
        [(1, "Opening  hours", "a", "h1"), (2, "opening hours", "a", "h1"), (3, "opening hours", "b", "h1"), (4, "opening hours", "a", "h2"),
         (5, "opening hours", None, "h1"), (6, " OPENING hours ", None, "h1")], "query_id long, text string, site_id string, doc_set_hash string")
    seen = []

    def ask(distinct):
        seen.extend(tuple(r) for r in distinct.select("query_id", "site_id", "doc_set_hash").collect())
        return distinct.select("query_id", F.concat_ws("/", "site_id", "doc_set_hash").alias("hit"))

    found = {r.query_id: r.hit for r in search.deduplicated_search(asked, ask).collect()}
    assert sorted(seen, key=str) == [(1, "a", "h1"), (3, "b", "h1"), (4, "a", "h2"), (5, None, "h1")]
    assert found == {1: "a/h1", 2: "a/h1", 3: "b/h1", 4: "a/h2", 5: "h1", 6: "h1"}


def test_scan_embeds_texts_as_stored_vectors(spark):
    from sagewell.operators.scan import scan_topk

    rng = random.Random(4)
    words = [f"w{int(rng.random() ** 2 * 90)}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)] + ["", None, "Lone", "w1 w1 w1"]
    chunks = spark.createDataFrame([(f"c{i:03d}", t, t) for i, t in enumerate(texts)], "chunk_id string, content string, search_text string")
    asked = spark.createDataFrame(
        [(q, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for q in [1, 1, 2, 3, 4]] + [(None, "w1 w2"), (9, None)], "query_id long, text string")
    prepared = search.prepare_queries(asked)
    stored = with_vectors(chunks, "content")

    def found(table, lexical):
        rows = scan_topk(search.chunk_vectors(table), search.asked_vectors(prepared, table), 7, lexical=lexical)
        return sorted((tuple(r) for r in rows.drop("rank").collect()), key=str)

    for lexical in (None, "overlap", "all_terms"):
        assert found(chunks, lexical) == found(stored, lexical) != []


def test_vectors_leave_a_task_in_small_batches(monkeypatch):
    from sagewell.operators import vectors

    monkeypatch.setattr(vectors, "TEXTS", 4)
    monkeypatch.setattr(vectors, "LETTERS", 10)
    texts = ["a" * 3, None, "", "b" * 9, "c" * 30, "d", "e", "f", "g", "h"]
    parts = list(vectors._slices(texts, 0))
    assert [at for at, _ in parts] == [0, 3, 4, 5, 9] and sum(n for _, n in parts) == len(texts)
