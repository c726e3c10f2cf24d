from datetime import datetime

from sagewell.llm import url_lists

D = [datetime(2026, 1, d) for d in range(1, 29)]


def test_the_longest_active_entry_decides(spark):
    entries = spark.createDataFrame([
        ("bad.com", "block", D[2], 1), ("bad.com", "remove", D[9], 1), ("bad.com", "block", D[19], 1),
        ("ok.bad.com", "allow", D[4], 1), ("bad.com/a", "allow", D[3], 1), ("bad.com/a/b", "block", D[3], 1),
        ("tie.org", "remove", D[2], 1), ("tie.org", "block", D[2], 1), ("tie.org", "allow", D[2], 1),
        (None, "block", D[0], 1), ("x", None, D[0], 1), ("y", "block", None, 1)],
        "key string, action string, at timestamp, host int")
    asked = [
        (1, "http://bad.com/x", D[1], "unlisted"), (2, "HTTPS://u:p@WWW.Bad.com.:80/x?q", D[2], "block"),
        (3, "http://bad.com/", D[9], "unlisted"), (4, "http://bad.com", D[27], "block"),
        (5, "http://ok.bad.com/q", D[5], "allow"), (6, "http://bad.com/a/c", D[5], "allow"),
        (7, "http://bad.com/a/b/c#f", D[5], "block"), (8, "http://bad.com/ab", D[5], "block"),
        (9, "http://notbad.com/", D[5], "unlisted"), (10, "http://tie.org/", D[5], "block"), (11, None, D[5], "unlisted"),
        (12, "nonsense", D[5], "unlisted"), (13, "http://bad.com/", None, "unlisted"), (None, "http://bad.com", D[5], "block"),
        (1, "http://bad.com/x", D[1], "unlisted"), (14, "http://" + "a." * 3000 + "bad.com/", D[5], "block")]
    captures = spark.createDataFrame([(*a[:3], "k") for a in asked], "page_id long, url string, fetched_at timestamp, key string")
    got = url_lists.evaluate(captures, entries).collect()
    assert sorted(((r.page_id, r.decision) for r in got), key=repr) == sorted(((a[0], a[3]) for a in asked), key=repr)
    assert url_lists.evaluate(captures.limit(0), entries).count() == 0
    assert {r.decision for r in url_lists.evaluate(captures, entries.limit(0)).collect()} == {"unlisted"}
