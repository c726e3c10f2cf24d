import base64
import hashlib

import pytest

from sagewell.llm import warc
from sagewell.session import scratch_folder

SCHEMA = "page_id long, url string, html string, bytes long, digest string"
FALSE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
ROWS = [(i, f"http://h/{i}", f"<p>{'é' * (i * 37 % 900)} {i % 7}") for i in range(120)] + [
    (200, "http://a/\r\nX: 1", FALSE + FALSE + "WARC/1.0\r\n"), (201, None, None), (202, "u", ""), (203, "u", "\r\n\r\n"),
    (204, "u", FALSE + "x" + "y" * 50_000), (205, "u", FALSE), (None, "n", "same"), (206, "s", "same"), (207, "s", "same"),
    (208, "r", "twice"), (208, "r", "twice")]


def expected(rows, minimum=0):
    best = {}
    for page, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if page is None else page)
    out, used = [], set()
    for page, _, html in rows:
        data = (html or "").encode()
        top = best[html or ""]
        first = (-1 if page is None else page) == top and html not in used
        used |= {html} if first else set()
        response = len(data) < minimum or first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if response else "revisit", None if response else top))
    return sorted(out, key=repr)


@pytest.mark.parametrize("minimum,split", [(0, "128m"), (10, "2k")])
def test_what_is_written_is_read_along_true_boundaries(spark, minimum, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    pages = spark.createDataFrame([(*r, 0, "d") for r in ROWS], SCHEMA).coalesce(2)
    folder = scratch_folder(spark, "warc-test")
    warc.write(warc.decide(pages, minimum), folder)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = warc.read(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=repr)
    want = expected([(p, u, h or "") for p, u, h in ROWS], minimum)
    assert got == want
    assert all(r.intact for r in rows)


def test_empty_table(spark):
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0
