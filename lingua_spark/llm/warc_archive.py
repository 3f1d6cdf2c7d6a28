"""WARC archives without repeated payloads, and reading them back.

Writing: the headers (page, payload digest and size) are shuffled, not the
payloads. Per digest the smallest page is the original; pages with the same
payload are written as revisit records that carry only headers and name the
record they refer to. Records are text lines of Spark's own writer whose line
separator is the blank line that ends a WARC record, so archives land in any
store that Spark can write.

Reading: each archive is parsed front to back by its Content-Length fields, so
payloads may contain anything. Revisit records are then joined with the
responses by payload digest, which restores what they stand for.

Defined cases: a null payload counts as empty; payloads under ``least_bytes``
are always written; rows that tie for the smallest page of a payload are all
responses; null pages are never the original unless all pages of the payload
are null, then all of these are responses; white space and control characters
in an address become %20; an empty table gives an archive without records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lingua_spark.llm.common import frugal, stage
from lingua_spark.runtime import scratch_path

LINE = "\r\n"
RECORD_END = "\r\n\r\n"
#: WARC needs a date; a fixed one keeps archives reproducible.
DATE = "2000-01-01T00:00:00Z"
#: Least bytes of a payload that may be replaced by a revisit record.
LEAST_BYTES = 100


def with_digest(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """key, url, payload, payload_bytes and payload_digest of every page."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), body.alias("payload")).select(
        "*",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("payload_digest"),
    )


def originals(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Per payload that occurs more than once: the smallest page holding it.

    Counting happens on both sides of the shuffle, so a payload shared by a
    third of all pages costs one row per task.
    """
    return (
        pages.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest")
        .agg(F.min("key").alias("original"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("payload_digest", "original")
    )


def record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def field(name: str, value: Column) -> Column:
    """A header line; nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(LINE)), F.lit(""))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """One column ``value``: the records without their final blank line."""
    first = stage(originals(pages, least_bytes), "warc_originals")
    joined = pages.join(first, "payload_digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("key"))
    sent = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit("WARC/1.1" + LINE),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", record_id(F.col("key"))),
        field("WARC-Date", F.lit(DATE)),
        field("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        field("WARC-Refers-To", F.when(revisit, record_id(F.col("original")))),
        field(
            "WARC-Profile",
            F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ),
        field("Content-Type", F.lit("text/html; charset=utf-8")),
        field("Content-Length", F.octet_length(sent).cast("string")),
    )
    return joined.select(F.concat(head, F.lit(LINE), sent).alias("value"))


def write_archives(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_bytes: int = LEAST_BYTES,
    codec: str = "gzip",
    rows_per_file: int = 5_000,
) -> None:
    """Write ``pages`` as archives below ``path``.

    ``rows_per_file`` bounds what a reader takes in at once.
    """
    made = records(with_digest(pages, key, url, payload), least_bytes)
    (
        made.write.option("lineSep", RECORD_END)
        .option("compression", codec)
        .option("maxRecordsPerFile", rows_per_file)
        .text(path)
    )


HEADERS = (
    "record_id string, record_type string, url string, refers_to string, "
    "payload_digest string, content_length bigint, content_digest string, content string"
)


def chunks(content: memoryview, packed: bool, step: int = 1 << 20) -> Iterator[bytes]:
    if not packed:
        for at in range(0, len(content), step):
            yield bytes(content[at : at + step])
        return
    inflate = zlib.decompressobj(31)
    for at in range(0, len(content), step):
        piece = inflate.decompress(content[at : at + step])
        while inflate.eof and inflate.unused_data:  # members one after another
            rest, inflate = inflate.unused_data, zlib.decompressobj(31)
            piece += inflate.decompress(rest)
        yield piece
    yield inflate.flush()


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of each record of an archive.

    Raises ValueError on anything that is no WARC record, or a cut one.
    """
    waiting = bytearray()

    def need(n: int) -> bool:
        while len(waiting) < n:
            piece = next(parts, None)
            if piece is None:
                return False
            waiting.extend(piece)
        return True

    while need(1):
        seen = 0
        while (end := waiting.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(waiting)
            if not need(seen + 1):
                raise ValueError("an archive ends inside a header")
        first, *lines = bytes(waiting[:end]).decode("utf-8", "surrogatepass").split(LINE)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record: {first[:40]!r}")
        head = dict(line.split(": ", 1) for line in lines)
        size = int(head["Content-Length"])
        if not need(end + 4 + size + 4):
            raise ValueError("an archive ends inside a record")
        yield head, bytes(waiting[end + 4 : end + 4 + size])
        del waiting[: end + 4 + size + 4]


def read_archives(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """The records below ``path``; ``content`` is null unless asked for."""
    frugal(spark)
    schema = pa.schema(
        [
            (n, pa.int64() if t == "bigint" else pa.string())
            for n, t in (c.split(" ") for c in HEADERS.split(", "))
        ]
    )

    def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            for name, value in zip(batch.column("path"), batch.column("content")):
                packed = name.as_py().endswith(".gz")
                rows, held = [], 0
                for head, body in parse(chunks(memoryview(value.as_buffer()), packed)):
                    rows.append(
                        (
                            head["WARC-Record-ID"],
                            head["WARC-Type"],
                            head.get("WARC-Target-URI"),
                            head.get("WARC-Refers-To"),
                            head["WARC-Payload-Digest"].removeprefix("sha256:"),
                            len(body),
                            hashlib.sha256(body).hexdigest(),
                            body.decode("utf-8", "surrogatepass") if with_content else None,
                        )
                    )
                    held += len(body) if with_content else 0
                    if len(rows) >= 4096 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), schema.types)), schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), schema.types)), schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(records_of, HEADERS)


def resolve(read: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Every record with the size of the payload it stands for.

    Revisit records meet the responses by payload digest. Each digest has one
    response of this size (or rows tied for it), so the join adds no rows and a
    digest with very many revisits can be split by Spark.
    """
    heads = stage(read.drop("content", "url"), "warc_heads")
    responses = (
        heads.filter((F.col("record_type") == "response") & (F.col("content_length") >= least_bytes))
        .filter(F.col("payload_digest") == F.col("content_digest"))
        .groupBy("payload_digest")
        .agg(F.max("content_length").alias("original_bytes"))
    )
    revisits = heads.filter("record_type = 'revisit'")
    wanted = stage(responses.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi"), "warc_originals")
    known = revisits.join(wanted, "payload_digest", "left").withColumn("payload_bytes", F.col("original_bytes"))
    plain = heads.filter("record_type = 'response'").withColumn("payload_bytes", F.col("content_length"))
    shown = ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    return plain.select(shown).unionByName(known.select(shown))


def page_of(column: str, kind: str = "bigint") -> Column:
    return F.nullif(F.regexp_extract(column, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write ``pages`` as archives, read them back and resolve the revisits."""
    spark, kind = pages.sparkSession, dict(pages.dtypes)[key]
    path = scratch_path(spark, "warc")
    write_archives(pages, path, key, url, payload)
    resolved = resolve(read_archives(spark, path, with_content=False))
    return resolved.select(
        page_of("record_id", kind).alias(key),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page_of("refers_to", kind).alias("refers_to"),
    )
