"""WARC records in a content-addressed archive.

The archive is two tables in one folder. `payloads`: every different payload once, by its SHA-256.
`headers`: for every record the exact bytes before its payload, and the payload's digest. A record
is header + payload + CRLF CRLF; records() joins it together again, and read() parses what records()
gives. A payload that is missing, or isn't what its digest says, stops either.

Which record owns a payload is found on small rows. Payload bytes are shuffled once, after every
task has dropped its own repeats, so copies by the thousand send one payload a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import broadcast_if_small, drop_staged, is_small, stage

#: Equal payloads from this size on are stored as one response and revisits of it.
REVISIT_FROM = 1000
#: A payload of more responses than this is joined apart.
OFTEN = 1000
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(CRLF))


def _urn(page_id: Column, row: Column) -> Column:
    """A record's id: the page's, and the row's number, as rows may share a page_id or have none."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"), F.lit(">"))


def _one_line(url: Column) -> Column:
    return F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def describe(pages: DataFrame) -> DataFrame:
    """(row, page_id, url, sha256, sha1, bytes long) of pages(page_id, url, html): a number for the row,
    fixed once the result is written; the payload's digests and size, without the payload."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.col("url").cast("string").alias("url"), payload.alias("p")).select(
        "row", "page_id", "url", F.sha2("p", 256).alias("sha256"), F.sha1("p").alias("sha1"), F.length("p").cast("long").alias("bytes")
    )


def write(pages: DataFrame, folder: str) -> None:
    """Write one record for each row of pages(page_id, url, html) into the archive `folder`.

    Of records with equal payloads of at least REVISIT_FROM bytes, that with the largest page_id is
    a response and the others revisit it; smaller ones are all responses. Null html: an empty
    payload. Null page_id: less than any other. Null url: empty. Rows that share the largest page_id
    and the payload are all responses, of which the others refer to the last. Very long payloads are
    written whole. Other columns of pages, whatever their names, are not written. An empty table
    makes an empty archive.
    """
    described = stage(describe(pages), "warc-described")
    owners = described.groupBy("sha256").agg(F.max("page_id").alias("owner"), F.max_by("row", F.struct("page_id", "row")).alias("owner_row"), F.count(F.lit(1)).alias("n"))
    shared = owners.filter("n > 1")
    placed = described.join(shared.select("sha256", "owner", "owner_row"), "sha256", "left")
    revisits = (F.col("bytes") >= REVISIT_FROM) & F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}"), _line("Content-Type", "text/html; charset=utf-8"), _line("Content-Length", F.col("bytes").cast("string")), F.lit(CRLF))
    typed = placed.withColumn("type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))).withColumn("http", http)
    revisit = F.col("type") == "revisit"
    block = F.length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), _line("WARC-Type", F.col("type")), _line("WARC-Record-ID", _urn(F.col("page_id"), F.col("row"))),
        _line("WARC-Date", DATE), _line("WARC-Target-URI", _one_line(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_line("WARC-Refers-To", _urn(F.col("owner"), F.col("owner_row"))), _line("WARC-Profile", REVISIT_PROFILE))).otherwise(F.lit("")),
        _line("Content-Type", "application/http; msgtype=response"), _line("Content-Length", block.cast("string")), F.lit(CRLF), F.col("http"),
    )
    typed.select(F.encode(header, "UTF-8").alias("header"), "sha256", revisit.alias("revisit")).write.parquet(f"{folder}/headers")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    stored = pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("sha256"), "payload").dropDuplicates(["sha256"])
    stored.write.option("compression", "zstd").parquet(f"{folder}/payloads")
    drop_staged(described)


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(stored, payload): the payloads with their digests, checked against each other."""
    stored = spark.read.schema("sha256 string, payload binary").parquet(f"{folder}/payloads")
    wrong = F.raise_error(F.concat(F.lit("payload doesn't match its digest "), "sha256"))
    return stored.select(F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("sha256")).otherwise(wrong.cast("string")).alias("stored"), "payload")


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("header binary, sha256 string, revisit boolean").parquet(f"{folder}/headers")


def field(header: Column, name: str) -> Column:
    """A named field of a record's header; null if it has none."""
    got = F.regexp_extract(header, rf"(?:^|\r\n){name}: ([^\r\n]*)(?:\r\n|\z)", 1)
    return F.when(F.contains(header, F.lit(f"\r\n{name}: ")), got)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, record binary, sha256): every record as the bytes of a WARC file, and the digest of the
    payload that it is or revisits. A response without its payload is an error."""
    headers = _headers(spark, folder)
    responses = headers.filter("not revisit").select("header", "sha256")
    payloads = _payloads(spark, folder)
    # payloads below REVISIT_FROM may belong to many responses: the few that do go to every task
    often = responses.groupBy("sha256").count().filter(F.col("count") > OFTEN).select("sha256")
    if often.isEmpty():
        joined = responses.join(payloads, F.col("sha256") == F.col("stored"), "left")
    else:
        short = payloads.filter(F.length("payload") < REVISIT_FROM).join(often, F.col("stored") == F.col("sha256")).select("stored", "payload")
        side = stage(short, "warc-often")
        if is_small(side):
            side = F.broadcast(side)
        first = responses.join(side, F.col("sha256") == F.col("stored"), "left")
        rest = first.filter("stored IS NULL").select("header", "sha256").join(payloads, F.col("sha256") == F.col("stored"), "left")
        joined = first.filter("stored IS NOT NULL").unionByName(rest)
    lost = F.raise_error(F.concat(F.lit("the archive has no payload "), "sha256")).cast("binary")
    full = joined.select("sha256", "header", F.when(F.col("stored").isNotNull(), F.col("payload")).otherwise(lost).alias("payload"))
    every = full.unionByName(headers.filter("revisit").select("sha256", "header", F.lit(b"").alias("payload")))
    head = F.substring_index(F.decode("header", "UTF-8"), CRLF + CRLF, 1)
    return every.select(_page(field(head, "WARC-Record-ID")).alias("page_id"), F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"), "sha256")


def _page(urn: Column) -> Column:
    return F.regexp_extract(urn, r"urn:page:(-?\d+):", 1).try_cast("long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record of the archive: page_id, url, payload_bytes long, payload_digest (bare
    lower-case hexadecimal SHA-1), record_type, refers_to (null for responses).

    Everything is parsed from the rebuilt records. Sizes and digests are those of the bytes: of the
    record's own payload, or of the stored one that a revisit stands for. They must agree with the
    header, and a payload that isn't there is an error.
    """
    text = F.decode("record", "UTF-8")
    twice = CRLF + CRLF
    parsed = records(spark, folder).select(
        "sha256", F.length("record").alias("size"), text.alias("text"), F.substring_index(text, twice, 1).alias("head"), F.length(F.substring_index(text, twice, 2)).alias("before")
    ).select("sha256", "size", "head", F.encode(F.expr("substring(text, before + 5, length(text) - before - 8)"), "UTF-8").alias("own"))
    block = F.col("size") - F.length(F.encode("head", "UTF-8")) - 8
    known = parsed.select(
        "sha256", _page(field(F.col("head"), "WARC-Record-ID")).alias("page_id"), field(F.col("head"), "WARC-Target-URI").alias("url"), field(F.col("head"), "WARC-Type").alias("record_type"),
        _page(field(F.col("head"), "WARC-Refers-To")).alias("refers_to"), field(F.col("head"), "WARC-Payload-Digest").alias("said"),
        (field(F.col("head"), "Content-Length").try_cast("long") == block).alias("fits"), F.sha1("own").alias("sha1"), F.length("own").cast("long").alias("bytes"),
    )
    meant = _headers(spark, folder).filter("revisit").select("sha256").distinct()
    facts = _payloads(spark, folder).join(meant, F.col("stored") == F.col("sha256"), "left_semi").select("stored", F.sha1("payload").alias("sha1_of"), F.length("payload").cast("long").alias("bytes_of"))
    revisits = known.filter("record_type = 'revisit'").drop("sha1", "bytes").join(broadcast_if_small(stage(facts, "warc-facts")), F.col("sha256") == F.col("stored"), "left")
    every = known.filter("record_type <> 'revisit'").unionByName(
        revisits.withColumns({"sha1": F.col("sha1_of"), "bytes": F.col("bytes_of")}).drop("stored", "sha1_of", "bytes_of")
    )
    wrong = F.raise_error(F.when(F.col("sha1").isNull(), F.concat(F.lit("the archive has no payload "), "sha256")).otherwise(F.concat(F.lit("header and payload disagree on "), "said"))).cast("string")
    digest = F.when(F.col("fits") & (F.col("said") == F.concat(F.lit("sha1:"), "sha1")), F.col("sha1")).otherwise(wrong)
    return every.select("page_id", "url", F.col("bytes").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")
