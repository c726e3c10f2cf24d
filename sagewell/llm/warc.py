"""WARC archives: a writer, and a reader that proves record boundaries.

The reader splits archives anywhere. Tasks report every place where the record magic occurs, with the offset at
which the header found there says the next record starts. Only places on the chain from the start of the file
are records; pointer jumping finds them in a logarithmic number of joins, so magic inside a payload is never
taken for a record. Only offsets are shuffled; payloads stay in the scan, except those of the few records whose
payload holds the magic and so spans several chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagewell.llm.shared import stored
from sagewell.session import scratch_folder

MAGIC = "WARC/1.0\r\n"
#: RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A table of payloads with copies up to this size is sent to every task; a larger one is joined by key.
SMALL_TABLE_ROWS = 200_000


def base32_sha1(data: Column) -> Column:
    """SHA-1 in bare upper-case base 32: 160 bits are 32 letters, four to every five hexadecimal digits."""
    digest = F.sha1(data)
    letters = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(
        F.lit(BASE32),
        (F.floor(F.conv(F.substring(digest, (F.floor(i / 4) * 5 + 1).cast("int"), F.lit(5)), 16, 10).cast("int")
                 / F.pow(F.lit(2), 15 - 5 * (i % 4))) % 32 + 1).cast("int"),
        F.lit(1)))
    return F.array_join(letters, "")


def decide(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, digest, record_type and refers_to.

    Of equal payloads of at least ``minimum`` bytes the row with the largest page_id is the response; a null
    page_id is smaller than any other, and of repeated rows one is the response.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", payload.alias("payload")).withColumns({
        "bytes": F.octet_length("payload").cast("long"), "content": F.sha2(F.col("payload").cast("binary"), 256),
        "row": F.monotonically_increasing_id()})
    copies = (
        rows.where(F.col("bytes") >= minimum)
        .groupBy("content").agg(F.max(F.struct("page_id", "row")).alias("best"), F.count("*").alias("n"))
        .where("n > 1").select(F.col("content").alias("copied"), "best")
    )
    copies = stored(copies, "warc-copies")
    if copies.count() <= SMALL_TABLE_ROWS:
        copies = F.broadcast(copies)
    revisit = F.col("best").isNotNull() & (F.col("best.row") != F.col("row"))
    return rows.join(copies, F.col("content") == F.col("copied"), "left").select(
        "page_id", "url", "payload", "bytes", base32_sha1(F.col("payload").cast("binary")).alias("digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("best.page_id")).alias("refers_to"),
    )


def write(decided: DataFrame, folder: str) -> None:
    """One archive per task. A revisit carries the digest and length of the payload it leaves out."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))

    def optional(name: str, value: Column) -> Column:
        return F.coalesce(line(name, value), F.lit(""))

    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    target = F.regexp_replace(F.col("url"), r"[\x00-\x20]", "%20")
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
            F.md5(F.concat_ws("|", "page_id", "digest", "url").cast("binary")),
            r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))),
        F.lit("WARC-Date: 2026-01-01T00:00:00Z\r\n"), optional("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes")), optional("X-Page-ID", F.col("page_id")),
        optional("X-Refers-To-Page-ID", F.col("refers_to")), F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.octet_length(body)), F.lit("\r\n"), body, F.lit("\r\n"),
    )
    decided.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "none").text(folder)


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """What follows each occurrence of the magic, in scan order, with the split it was read in."""
    return spark.read.option("lineSep", MAGIC).text(folder).select(
        F.col("value"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("seq"))


def _header(name: str) -> Column:
    return F.regexp_extract(F.col("head"), rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every occurrence of the magic: file, off, succ (where its header says the next record starts), headers.

    Chunks tile a file, so an offset is the length of the earlier splits plus the running length in its own.
    """
    chunks = _chunks(spark, folder).withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    length = F.octet_length("value").cast("long")
    start = F.octet_length("head").cast("long") + 4
    ended = length >= start
    content = F.when(ended, F.regexp_extract("head", r"(?im)^Content-Length:[ \t]*(\d{1,18})[ \t]*\r?$", 1))
    rows = chunks.withColumn("content", F.when(content != "", content).cast("long"))
    whole = (F.col("content").isNotNull()) & (length >= start + F.col("content"))
    narrow = rows.select(
        "file", "split", "seq", (length + len(MAGIC)).alias("length"),
        (F.lit(len(MAGIC)) + start + F.col("content") + 4).alias("size"), "content",
        F.when(whole, base32_sha1(F.substring(
            F.col("value").cast("binary"), (start + 1).cast("int"), F.col("content").cast("int")))).alias("digest"),
        _header("WARC-Type").alias("type"), _header("WARC-Payload-Digest").alias("stated"),
        _header("X-Payload-Length").alias("full"), _header("X-Page-ID").alias("page"),
        _header("X-Refers-To-Page-ID").alias("refers"),
    )
    narrow = stored(narrow, "warc-candidates")
    splits = narrow.groupBy("file", "split").agg(F.sum("length").alias("held"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    off = F.col("start") + F.coalesce(F.sum("length").over(inside), F.lit(0)) - len(MAGIC)
    return (
        narrow.join(starts, ["file", "split"]).withColumn("off", off).where("off >= 0")
        .withColumn("succ", F.col("off") + F.col("size")).drop("start", "length", "size")
    )


def reachable(links: DataFrame) -> DataFrame:
    """Of ``file, off, succ`` the ``file, off`` on the chain from offset 0: each round doubles the jump."""
    jumps = stored(links.select("file", "off", F.col("succ").alias("to")), "warc-jumps")
    known = jumps
    reached = stored(jumps.where("off = 0").select("file", "off"), "warc-reached")
    count = reached.count()
    while True:
        landed = reached.join(jumps, ["file", "off"]).where("to is not null").select(
            "file", F.col("to").alias("off")).join(known.select("file", "off"), ["file", "off"], "left_semi")
        grown = stored(reached.unionByName(landed).distinct(), "warc-reached")
        now = grown.count()
        if now == count:
            return grown
        reached, count = grown, now
        further = jumps.select("file", F.col("off").alias("to"), F.col("to").alias("beyond"))
        jumps = stored(
            jumps.where("to is not null").join(further, ["file", "to"]).select("file", "off", F.col("beyond").alias("to")),
            "warc-jumps")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: file, off, page_id, record_type, payload_bytes, payload_digest, refers_to, intact.

    The digest of a response is that of the payload as read, ``intact`` says that it is the stated one. A
    revisit has the length and digest its header states. A chain that breaks ends the records of its file.
    """
    found = stored(candidates(spark, folder), "warc-offsets")
    records = stored(
        found.join(reachable(found), ["file", "off"], "left_semi"), "warc-records")
    broken = records.where("digest is null and content is not null").select("file", "off", "content")
    if not broken.isEmpty():
        # Payloads that hold the magic: chunks between a record and the next one belong to it.
        real = records.select("file", "off", F.col("off").alias("mark"))
        owner = F.last("mark", ignorenulls=True).over(Window.partitionBy("file").orderBy("off"))
        parts = found.select("file", "split", "seq", "off").join(real, ["file", "off"], "left").withColumn(
            "mark", owner)
        parts = parts.join(broken.withColumnRenamed("off", "mark"), ["file", "mark"], "left_semi")
        texts = _chunks(spark, folder).select("file", "split", "seq", F.col("value").cast("binary").alias("value"))
        glue = F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].value, "
                      f"(a, p) -> concat(a, cast('{MAGIC[:-2]}' as binary), X'0D0A', p.value))")
        whole = (
            texts.join(parts, ["file", "split", "seq"])
            .groupBy("file", "mark").agg(F.sort_array(F.collect_list(F.struct("off", "value"))).alias("parts"))
            .select("file", F.col("mark").alias("off"), glue.alias("value"))
            .join(broken, ["file", "off"])
            .withColumn("at", F.expr("locate('\\r\\n\\r\\n', cast(value as string))"))
        )
        # The header is ASCII, so its length in characters is its length in bytes.
        again = whole.select("file", "off", base32_sha1(F.substring(
            F.col("value"), (F.col("at") + 4).cast("int"), F.col("content").cast("int"))).alias("joined"))
        records = records.join(again, ["file", "off"], "left").withColumn(
            "digest", F.coalesce("digest", "joined")).drop("joined")
    revisit = F.col("type") == "revisit"
    stated = F.regexp_replace("stated", "^sha1:", "")
    number = {n: F.when(F.col(n) != "", F.col(n)).cast("long") for n in ("page", "refers", "full")}
    return records.select(
        "file", "off", number["page"].alias("page_id"), F.col("type").alias("record_type"),
        F.when(revisit, number["full"]).otherwise(F.col("content")).alias("payload_bytes"),
        F.when(revisit, stated).otherwise(F.col("digest")).alias("payload_digest"),
        number["refers"].alias("refers_to"), (revisit | (F.col("digest") == stated)).alias("intact"),
    )


def archive_pages(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back."""
    spark = pages.sparkSession
    folder = scratch_folder(spark, "warc")
    write(decide(pages, minimum), folder)
    return read(spark, folder)
