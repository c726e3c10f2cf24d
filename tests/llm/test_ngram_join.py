import random

import brute

from sagewell.llm import graph, ngram_join

SCHEMA = "doc_id long, text string, node string, cluster int"


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(12):
        text = [rng.choice(words) for _ in range(120)]
        for copy in range(rng.randint(1, 6)):
            changed = list(text)
            for _ in range(copy % 4):
                changed[rng.randrange(120)] = "other"
            rows.append((100 * base + copy, " ".join(changed)))
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows += [(5000 + i, shared + " " + " ".join(rng.choice(words) for _ in range(40))) for i in range(8)]
    return rows + [(1, "one two"), (2, "One  TWO"), (3, None), (4, ""), (6, " "), (None, "one two"), (0, rows[0][1]),
                   (0, rows[3][1]), (0, rows[0][1]), (None, rows[5][1]), (7, "long " * 30_000)]


def test_classes_and_links_equal_all_pairs_also_in_small_tiles(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA)
    want = sorted(brute.similar(rows), key=repr)
    for tile_bytes in (8 << 20, 2000):
        found = ngram_join.similar_documents(docs, tile_bytes=tile_bytes)
        got = found.select("doc_id", "class_id", "class_size", "n_links").collect()
        assert sorted((tuple(r) for r in got), key=repr) == want


def test_one_of_each_group_stays(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA)
    left = ngram_join.keep_one(docs)
    assert left.columns == docs.columns
    groups = brute.similar(rows)
    classes = {r[1] for r in groups if r[2] > 1}
    assert left.count() == len(classes) + sum(1 for r in groups if r[2] == 1)


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert ngram_join.similar_documents(docs).count() == ngram_join.keep_one(docs).count() == 0


def test_prefixes_shorten_until_the_recall_is_met():
    depth = ngram_join.prefix_depth(20, 0.8, 0.9999)
    assert 1 - (1 - 0.8 ** depth) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (depth + 1)) ** 20
    assert ngram_join.prefix_depth(200, 0.8, 0.9) == ngram_join.DEPTH


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(roots[i] == 0 for i in range(51)) and roots[100] == roots[99] == 99
