"""WARC archives: writing with revisit records, reading back, resolving revisits.

Writing finds equal payloads by digest: only headers (digest, length, id) are
grouped, so the one response of each repeated payload is known before any record
is made; the records that repeat it become revisit records with fresh headers
that name it.  Records go out through Spark's own text writer and its commit
protocol, so a lost executor leaves no half archive and any file system that
Spark writes to will do.  A file is one archive of whole records, each ended by
the format's two line ends.

Reading takes whole archives as binary files and walks them by Content-Length, so
payloads may hold anything.  Resolving shuffles headers by payload digest and
joins each revisit to an original response.

Defined results: a null payload is an empty one; payloads shorter than
``least_bytes`` are always responses; of equal payloads the largest id is the
response, and rows that repeat that very id and payload are responses too (their
record ids have a number behind the id); a null id counts as smaller than all others; line ends in a URI become spaces; a revisit
whose response isn't there resolves to nulls; an empty table writes an archive
without records.
"""

from __future__ import annotations

import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep, prepare, small, table_path

LEAST_BYTES = 1000
#: Records in one archive at most, and bytes of payloads, which a reader takes at once; payloads of over ``LARGE`` bytes have archives of their own.
FILE_RECORDS, FILE_BYTES, LARGE = 4096, 256 << 20, 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:quillspark:record:"
_END = "\r\n"


def with_originals(records: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``records`` (id, uri, payload) with digest, bytes, and ``original``: the response's id where the record is a revisit."""
    plain = records.select("id", "uri", F.coalesce("payload", F.lit("")).alias("payload"))
    hashed = plain.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    headers = hashed.select("id", "digest", "bytes").where(F.col("bytes") >= least_bytes)
    repeated = headers.groupBy("digest", "bytes").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null").drop("n")
    # payloads travel only where too many are repeated to send the list to all
    joined = hashed.join(small(keep(repeated, "repeated-payloads")), ["digest", "bytes"], "left")
    return joined.withColumn("original", F.when(F.col("id").eqNullSafe(F.col("original")), F.lit(None)).otherwise(F.col("original")))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least_bytes: int = LEAST_BYTES) -> None:
    """Write deduplicated gzip archives of ``records`` (id long, uri, payload string) under ``path``."""
    found = with_originals(records, least_bytes)
    revisit = F.col("original").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), F.col("bytes"), F.lit(_END + _END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_END))
    # a null id, and one of several rows, gets a number of its own behind it, as record ids are unique
    again = keep(found.where("id is not null").groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again")), "repeated-ids")
    found = found.join(small(again), "id", "left")
    number = F.when(F.col("id").isNull() | F.col("again"), F.concat(F.lit(":"), F.monotonically_increasing_id().cast("string"))).otherwise("")
    own = F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("id").cast("string"), F.lit("")), number, F.lit(">"))
    value = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("uri", F.lit("")), r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), F.col("original").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(_END),
        block,
    )
    large = F.col("bytes") > LARGE
    longest = found.agg(F.max("bytes")).first()[0] or 0
    for name, chosen, each in (("small", ~large, FILE_RECORDS), ("large", large, max(1, FILE_BYTES // (longest or 1)))):
        found.where(chosen).select(value.alias("value")).write.option("lineSep", _END + _END).option("compression", "gzip").option("maxRecordsPerFile", each).text(f"{path}/{name}")


def parse(stream):
    """(headers, block) of each record of an archive that is open for reading."""
    while True:
        start = stream.readline()
        if not start:
            return
        if not start.strip():
            continue
        if not start.startswith(b"WARC/"):
            raise ValueError(f"no record at {start[:40]!r}")
        headers = {}
        while (row := stream.readline()).strip():
            name, _, value = row.partition(b":")
            headers[name.strip().lower().decode()] = value.strip().decode()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("an archive ends within a record")
        yield headers, block


def _record_id(value: str | None) -> int | None:
    body = (value or "").strip("<>").removeprefix(_ID).partition(":")[0]
    return int(body) if body.lstrip("-").isdigit() else None


_RECORDS = "id long, record_type string, uri string, refers_to long, payload_digest string, payload_bytes long, valid boolean"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record: id, record_type, uri, refers_to, payload_digest, payload_bytes (null for revisits), valid, and payload if asked for.

    ``valid``: the payload that was read has the digest that its header names.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for headers, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content.as_py())), 1 << 20)):
                    kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    body = block.partition(b"\r\n\r\n")[2]
                    response = kind == "response"
                    row = (_record_id(headers["warc-record-id"]), kind, headers.get("warc-target-uri"), _record_id(headers.get("warc-refers-to")), digest, len(body) if response else None, hashlib.sha1(body).hexdigest() == digest if response else None)
                    rows.append((*row, body) if payloads else row)
                    held += len(body) * payloads
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield _rows(rows, payloads)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows, payloads)

    files = prepare(spark).read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInArrow(run, _RECORDS + (", payload binary" if payloads else ""))


def _rows(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), *([pa.binary()] if payloads else [])]
    names = ["id", "record_type", "uri", "refers_to", "payload_digest", "payload_bytes", "valid", *(["payload"] if payloads else [])]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names=names)


def resolve(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes of every revisit filled in from an original response with its digest."""
    responses = records.where("record_type = 'response'")
    originals = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("full_bytes"))
    revisits = records.where("record_type = 'revisit'").join(originals, "payload_digest", "left").withColumn("payload_bytes", F.col("full_bytes")).drop("full_bytes")
    return responses.unionByName(revisits)


def round_trip(records: DataFrame) -> DataFrame:
    """Write ``records`` as deduplicated archives into the shared folder, read them back, and resolve the revisits."""
    path = table_path(records.sparkSession, "warc")
    write_archives(records, path)
    return resolve(read_archives(records.sparkSession, path))
