"""A content-addressed archive of WARC records.

Each payload is stored once under its SHA-256; the exact bytes of each record's headers
are stored apart, with the address of the payload. The original records come back by a
join of the two, and can be written to WARC files and read from them again.

An address is verified twice: when payloads are stored, payloads of one address have to
agree in length and SHA-1 as well, and when they are read, their SHA-256 has to be the
address; either failure stops the job.

Payload bytes are shuffled once at most, one of each address and task. What is joined by
address is narrow, and addresses with more than a thousandth of all records (fewer than a
thousand) meet theirs in a broadcast.

Defined results: a null payload is empty; payloads of 1,000 bytes or more are told apart
by content: the record with the largest id is ``response`` and the others ``revisit``
(rows repeated under that id are responses too, and where no record has an id all are);
shorter ones are all ``response``; a null URL leaves its header out, and control
characters in one are percent-encoded; repeated rows are records each; an empty table
gives an empty archive.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskengine.llm.skew import PARTS, join_by_key
from riskengine.session import materialize, shared_path

#: Shorter payloads are never referred to.
LEAST_SHARED = 1000
#: Characters of base32, in which WARC files state digests.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_VERSION = b"WARC/"
_RECORD = "id string, header binary, payload binary"


@dataclass(frozen=True)
class Archive:
    """Parquet folders: ``headers`` (kept columns, ``address``, ``header``, ``whole``) and ``payloads`` (``address``, ``payload``).

    ``whole`` says whether the payload follows the header in the original record.
    """

    spark: SparkSession
    headers: str
    payloads: str

    def header_rows(self) -> DataFrame:
        return self.spark.read.parquet(self.headers)

    def payload_rows(self) -> DataFrame:
        """The payloads; one that is not what its address says stops the job."""
        wrong = F.raise_error(F.concat(F.lit("payload does not match its address "), F.lower(F.hex("address"))))
        return self.spark.read.parquet(self.payloads).select("address", F.when(address(F.col("payload")) == F.col("address"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))


def address(payload: Column) -> Column:
    return F.unhex(F.sha2(payload, 256))


def base32(sha1: Column) -> Column:
    """A SHA-1 in hex as the 32 characters that WARC digests have: eight groups of five hex digits make four characters each."""
    group = lambda k: F.conv(F.substring(sha1, 5 * k + 1, 5), 16, 10).cast("int")
    letter = lambda v: F.substring(F.lit(_BASE32), v % 32 + 1, F.lit(1))
    return F.concat(*[letter(F.shiftright(group(k), 5 * (3 - j))) for k in range(8) for j in range(4)])


def _no_controls(c: Column) -> Column:
    for code in [*range(32), 127]:
        c = F.replace(c, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return c


def _group(facts: DataFrame, by: DataFrame) -> DataFrame:
    """``by`` with how many records have an address and the largest id; addresses of unequal payloads stop the job."""
    same = (F.min("sha1") == F.max("sha1")) & (F.min("n_bytes") == F.max("n_bytes"))
    return by.agg(F.count("*").alias("n"), F.max("_id").alias("first_id"), F.assert_true(same, "two payloads have one SHA-256").alias("_ok")).filter("_ok IS NULL").drop("_ok")


def _once(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """``address`` and ``payload`` of each address once; of frequent ones only the chosen record's bytes are shuffled."""
    often = F.broadcast(groups.filter(F.col("n") > max(1.0, total / PARTS)).select("address", F.col("first_id").alias("_chosen"), F.lit(True).alias("_often")))
    kept = rows.join(often, "address", "left").filter(F.col("_often").isNull() | F.col("_id").eqNullSafe(F.col("_chosen")))
    return kept.groupBy("address").agg(F.first("payload").alias("payload"))


def page_headers(facts: DataFrame, url_col: str = "url", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``record_type``, ``header`` (exact bytes) and ``whole`` of pages with ``_id``, ``sha1``, ``n_bytes`` and ``first_id``."""
    revisit = (F.col("n_bytes") >= LEAST_SHARED) & F.col("first_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    follows = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", _no_controls(F.col(url_col))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("first_id"))), line("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", follows.cast("string")),
        F.lit("\r\n"),
        http,
    )
    return facts.withColumns({"header": F.encode(header, "UTF-8"), "whole": ~revisit})


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> Archive:
    """A record for each page, written under ``path``; the header rows keep the id."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    facts = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("url"), address(payload).alias("address"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"))
    facts = materialize(facts, "page-facts")
    groups = materialize(_group(facts, facts.groupBy("address")), "page-groups")
    headers = page_headers(join_by_key(facts, groups.select("address", "first_id"), "address"), "url", date)
    headers.select(F.col("_id").alias(id_col), "address", "header", "whole").write.parquet(f"{path}/headers")
    rows = pages.select(F.col(id_col).alias("_id"), address(payload).alias("address"), payload.alias("payload"))
    _once(rows, groups, facts.count()).write.parquet(f"{path}/payloads")
    return Archive(pages.sparkSession, f"{path}/headers", f"{path}/payloads")


def archive_records(records: DataFrame, path: str, keep: tuple[str, ...] = ("id",)) -> Archive:
    """Any records, with ``header`` and ``payload`` in bytes, under ``path``; payloads are told apart by content alone."""
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    facts = materialize(records.select(*keep, F.coalesce(F.col("header"), F.lit(b"")).alias("header"), address(payload).alias("address"), F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("n_bytes"), F.xxhash64("header").alias("_id")), "record-facts")
    groups = materialize(_group(facts, facts.groupBy("address")), "record-groups")
    facts.select(*keep, "address", "header", F.lit(True).alias("whole")).write.parquet(f"{path}/headers")
    rows = records.select(F.xxhash64(F.coalesce(F.col("header"), F.lit(b""))).alias("_id"), address(payload).alias("address"), payload.alias("payload"))
    _once(rows, groups, facts.count()).write.parquet(f"{path}/payloads")
    return Archive(records.sparkSession, f"{path}/headers", f"{path}/payloads")


def with_payloads(archive: Archive, **facts: Column) -> DataFrame:
    """The header rows with ``facts``, expressions over each verified ``payload`` that are worked out once for each address.

    Without ``facts`` the payload itself is joined; its bytes are then shuffled, but for
    those of frequent addresses.
    """
    wanted = facts or {"payload": F.col("payload")}
    found = archive.payload_rows().select("address", *[c.alias(name) for name, c in wanted.items()])
    if facts:
        found = materialize(found, "payload-facts")
    return join_by_key(archive.header_rows(), found, "address")


def original_records(archive: Archive) -> DataFrame:
    """The kept columns and ``record``, the record's exact bytes but for the two line ends behind it."""
    rows = with_payloads(archive)
    kept = [c for c in rows.columns if c not in ("address", "header", "whole", "payload")]
    return rows.select(*kept, F.concat("header", F.when(F.col("whole"), F.col("payload")).otherwise(F.lit(b""))).alias("record"))


def header_field(header: Column, name: str) -> Column:
    """The value of a named field of a record's own headers (the first block); null where there is none."""
    found = F.regexp_extract(F.substring_index(F.decode(header, "UTF-8"), "\r\n\r\n", 1), rf"(?i)\r\n{name}:[ \t]*([^\r]*)", 1)
    return F.when(found != "", F.rtrim(found))


def read_back(archive: Archive) -> DataFrame:
    """What the archived records say: kept columns, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` (an id)."""
    rows = with_payloads(archive, payload_bytes=F.octet_length("payload").cast("long"), payload_digest=F.sha1("payload"))
    said = header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), base32(F.col("payload_digest")))
    wrong = F.raise_error(F.lit("a record's payload is not the one its header states")).cast("string")
    refers = F.regexp_extract(F.coalesce(header_field(F.col("header"), "WARC-Refers-To"), F.lit("")), r"^<urn:page:(-?[0-9]+)>$", 1)
    return rows.withColumns({
        "payload_digest": F.when(said, F.col("payload_digest")).otherwise(wrong),
        "record_type": header_field(F.col("header"), "WARC-Type"),
        "refers_to": F.when(refers != "", refers.cast("long")),
    }).drop("address", "header", "whole")


def write_warc(records: DataFrame, path: str, record_col: str = "record", records_per_file: int = 10_000) -> None:
    """Records as gzipped WARC files; any Hadoop file system will do, as Spark's own writer is used.

    Bytes pass through the writer as they are: a record is a line, and the two line ends
    that close a record are the line separator.
    """
    rows = records.select(F.col(record_col).cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(data: io.BufferedIOBase) -> Iterator[tuple[str | None, bytes, bytes]]:
    """(id, header, payload) of each record of an open WARC file; HTTP headers belong to the header.

    A payload is as long as the record says, whatever its bytes are.
    """
    while True:
        line = data.readline()
        while line in (b"\r\n", b"\n"):
            line = data.readline()
        if not line:
            return
        if not line.startswith(_VERSION):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        header, size, of_http, name = [line], 0, False, None
        while (line := data.readline()) not in (b"\r\n", b"\n", b""):
            header.append(line)
            field, _, value = line.partition(b":")
            match field.strip().lower():
                case b"content-length":
                    size = int(value)
                case b"content-type":
                    of_http = value.strip().lower().startswith(b"application/http")
                case b"warc-record-id":
                    name = value.strip().decode("utf-8", "replace")
        header.append(line)
        block = data.read(size)
        if len(block) < size:
            raise ValueError(f"record {name} is cut off")
        at = block.find(b"\r\n\r\n") + 4 if of_http and b"\r\n\r\n" in block else 0
        yield name, b"".join(header) + block[:at], block[at:]


def read_warc(spark: SparkSession, path: str, batch_bytes: int = 8 << 20) -> DataFrame:
    """``id``, ``header`` and ``payload`` of all records of WARC files, gzipped (as a whole or by record) or plain.

    A file is read in one task; as compressed archives usually are, it should be about a gigabyte at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                held, size = [], 0
                body = io.BytesIO(raw.as_py())
                packed = body.getbuffer()[:2] == b"\x1f\x8b"
                for record in parse_warc(gzip.GzipFile(fileobj=body) if packed else body):
                    held.append(record)
                    size += len(record[1]) + len(record[2])
                    if size >= batch_bytes:
                        yield _batch(held)
                        held, size = [], 0
                yield _batch(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _RECORD)


def _batch(records: list[tuple[str | None, bytes, bytes]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], kind) for k, kind in enumerate(kinds)], ["id", "header", "payload"])


def repack(spark: SparkSession, path: str) -> Archive:
    """WARC files as an archive in the shared folder."""
    return archive_records(read_warc(spark, path), shared_path(spark, "warc"))


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT body, max(page_id) AS first_id FROM p WHERE octet_length(encode(body)) >= {LEAST_SHARED} GROUP BY body)
SELECT p.page_id, CAST(octet_length(encode(p.body)) AS BIGINT) AS payload_bytes, sha1(p.body) AS payload_digest,
  CASE WHEN g.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g ON g.body = p.body"""
