"""Content-addressed WARC archive: payload bytes once per SHA-256, exact record headers apart, records by join.

``write_archive`` leaves two Parquet tables in a folder. ``payloads`` (digest, salts, payload) holds each different payload once,
``headers`` one row per record: its WARC header block and the HTTP header of its block to the byte, the payload's digest and
the record's salt. ``read_archive`` verifies every payload by its digest and joins records back together; copies of one payload are
dealt to as many tasks as their number asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checked_broadcast, col, is_integral, materialise

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
#: Records of one payload that meet it in one task.
COPIES_A_TASK = 1000
#: Tasks that the records of one digest are dealt to when they meet its first record.
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _line(name: str, value: Column) -> Column:
    """One header line; line breaks in a value are percent-encoded, a null value leaves the line out."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def _record_id(number: Column) -> Column:
    """A URN that depends on the record's number alone."""
    h = F.sha1(F.concat(F.lit("record-"), number.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))


def _numbered(pages: DataFrame, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(no, id, url, payload): ``no`` ascends with the id, nulls first, and is unique; ids that are so are used as they are."""
    own = pages.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"), F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    if is_integral(pages, id_col):
        n, distinct, missing = pages.agg(F.count("*"), F.count_distinct(col(id_col)), F.count(F.when(col(id_col).isNull(), 1))).first()
        if not missing and n == distinct:
            return own.select(F.col("id").cast("bigint").alias("no"), "*")
    order = [F.col("id").asc_nulls_first(), F.xxhash64("payload"), F.col("url")]
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(own.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("no"), "*"), "records")


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``headers`` and ``payloads`` into ``folder``, which must be one that all executors share.

    Of records with equal payloads of at least 100 bytes the one of least id is a response, others revisit it; smaller
    payloads are stored once too, but all their records are responses. A null payload is empty. Rows of one id are ordered by
    payload and URL, a null id comes before all others; a null URL leaves its header line out. Ids may be of any atomic type. Other
    columns are left out. A digest under which two different lengths or SHA-512 sums were found raises.
    """
    rows = _numbered(pages, id_col, url_col, payload_col)
    digest = F.sha2("payload", 256).alias("digest")
    narrow = materialise(rows.select("no", "id", "url", digest, F.octet_length("payload").cast("bigint").alias("bytes"), F.xxhash64(F.sha2("payload", 512)).alias("check")), "digests")
    # Only digests of more than one record have a row here.
    groups = narrow.groupBy("digest").agg(
        F.min("no").alias("first"), F.min_by("id", "no").alias("first_id"), F.min_by("url", "no").alias("first_url"), F.count("*").alias("copies"),
        (F.min(F.struct("bytes", "check")) != F.max(F.struct("bytes", "check"))).alias("differ"),
    ).where("copies > 1")
    groups = materialise(groups, "copies")
    if groups.where("differ").limit(1).collect():
        raise ValueError("two different payloads have one digest")
    dealt = narrow.withColumn("deal", F.pmod(F.xxhash64("no"), F.lit(SALTS).cast("bigint")))
    spread = groups.withColumn("deal", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")))
    known = dealt.join(spread, ["digest", "deal"], "left").withColumn("salts", F.expr(f"ceil(coalesce(copies, 1) / {COPIES_A_TASK})"))
    known = known.withColumn("revisit", F.expr(f"coalesce(no > first, false) AND bytes >= {LEAST_REVISIT}"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("no"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        _line("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("first")))),
        _line("WARC-Refers-To-Target-URI", F.when(F.col("revisit"), F.col("first_url"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", block),
        F.lit(CRLF),
    )
    known.select(
        "no", "id", "digest", F.pmod(F.xxhash64("no"), "salts").alias("salt"), F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"),
        header.cast("binary").alias("header"), http.cast("binary").alias("http"),
    ).write.parquet(f"{folder}/headers")
    # Copies are left out of the payloads; the first of many says how many tasks its records are dealt to.
    special = known.where("no > first OR salts > 1").select("no", F.expr("no > first").alias("copy"), "salts")
    stored = rows.join(checked_broadcast(special), "no", "left").where("copy IS NULL OR NOT copy")
    stored.select(digest, F.coalesce("salts", F.lit(1).cast("bigint")).alias("salts"), "payload").write.parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: no, id, refers_to, record_type, header, http, payload, payload_bytes, payload_digest.

    Digest and length are those of the bytes read; a payload whose digest is not the one it is stored under raises. They are
    taken once per payload, before records join it, so that a reader of these alone moves no payload. A record without its payload raises.
    """
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("found", F.sha2("payload", 256)).select(
        "digest",
        F.explode(F.expr("sequence(0L, salts - 1)")).alias("salt"),
        "payload",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("found") == F.col("digest"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "digest"))).alias("payload_digest"),
    )
    headers = spark.read.parquet(f"{folder}/headers")
    kind = F.regexp_extract(F.col("header").cast("string"), r"\nWARC-Type: (\w+)", 1).alias("record_type")
    whole = F.coalesce("payload_digest", F.raise_error(F.concat(F.lit("no payload "), "digest"))).alias("payload_digest")
    return headers.join(payloads, ["digest", "salt"], "left").select("no", "id", "refers_to", kind, "header", "http", "payload", "payload_bytes", whole)


def warc_records(archive: DataFrame) -> DataFrame:
    """(no, record): the bytes of each record as they stand in a WARC file; a revisit's block is its HTTP header alone."""
    payload = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return archive.select("no", F.concat("header", "http", payload, F.lit((CRLF * 2).encode())).alias("record"))
