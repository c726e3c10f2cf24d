import hashlib

import pytest

from sagewell.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string, rep long"


def plain(rows):
    def norm(text):
        return (text or "").encode().translate(None, b" \t\n\x0b\x0c\r")

    groups = {}
    for doc_id, text in rows:
        groups.setdefault(norm(text), []).append((doc_id, text or ""))
    out = []
    for content, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for doc_id, _ in members:
            out.append((doc_id, keep, len(members), hashlib.sha256(content).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, "A b"), (5, None), (6, ""), (7, " \n"), (8, "x" * 300_000),
        (9, "x" * 300_000), (None, "ab"), (10, "b a"), (2, "ab"), (11, "a b")]


@pytest.mark.parametrize("limits", [(32 << 20, 48 << 20), (50, 40)])
def test_groups_equal_plain_python_also_when_buckets_do_not_fit(spark, limits):
    rows = ROWS + [(100 + i, f"text {i % 40}") for i in range(200)]
    docs = spark.createDataFrame([(*r, "z", 0) for r in rows], SCHEMA).repartition(3)
    got = exact_dedup.exact_groups(docs, table_bytes=limits[0], bucket_bytes=limits[1]).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == plain(rows)
    kept = [r.text_sha256 for r in got if r.kept]
    assert len(kept) == len(set(kept)) == len({p[3] for p in plain(rows)})


def test_kept_rows_keep_their_columns_and_repeated_rows_collapse(spark):
    docs = spark.createDataFrame([(*r, "z", i) for i, r in enumerate(ROWS)], SCHEMA)
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted([3, 4, 7, 8, 10, 11], key=repr)
    assert exact_dedup.drop_copies(docs.where("doc_id = 2")).count() == 1


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.drop_copies(docs).count() == 0


def test_open_table_tells_equal_hashes_apart():
    table = exact_dedup.OpenTable(4)
    assert [table.place(7, c) for c in (b"a", b"b", b"a", b"c", b"d", b"b")] == [0, 1, 0, 2, 3, 1]
