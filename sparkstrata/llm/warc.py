"""Content-addressed WARC archive.

Two tables make an archive: ``payloads`` holds the bytes of every distinct payload once, under
its SHA-256, and ``headers`` holds the exact header blocks of every record (WARC and HTTP) with the
digest of the payload it speaks of.  Joining them gives the original records back, byte for byte, and
``parse_records`` reads such bytes.  All of it runs in the JVM.

Defined results: a null payload is empty; a null url is an empty target; rows with a null id
form records that others never refer to and that revisit the payload's owner, if any; of rows
repeated with the owner's id every one is a response; very long payloads are stored and digested
whole; an empty table gives an empty archive.  Extra input columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CRLF = "\r\n"
#: Fixed values of the base32 alphabet; conv() to base 32 counts in the first one.
CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


@dataclass
class Archive:
    headers: DataFrame
    payloads: DataFrame


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits (20 bits) are 4 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32_DIGITS)


def _record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Write one WARC record for each row.

    Of the rows whose payloads are equal and of ``min_revisit_bytes`` at least, the one with the
    largest id is the response and the others revisit it.  Payload bytes are shuffled once, after
    map-side merging of equal ones; the owner of a payload is found on digests alone, merged
    before the shuffle, so a payload shared by a third of the rows costs one row a task.
    """
    base = pages.select(
        F.col(id_col).alias("page_id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(bytearray())).alias("payload"),
    )
    meta = base.select("page_id", "url", F.length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), base32_sha1(F.col("payload")).alias("sha1"))
    owners = meta.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("owner"))
    linked = meta.join(owners, "digest", "left")
    revisit = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    target = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        _record_id(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        target,
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"),
        F.col("sha1"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _record_id(F.col("owner")))).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string"),
        F.lit(CRLF + CRLF),
    )
    headers = scratch.table(linked.select("page_id", header.alias("header"), http.alias("http"), "digest"), "headers")
    payloads = scratch.table(base.select(F.sha2("payload", 256).alias("digest"), "payload").groupBy("digest").agg(F.first("payload").alias("payload")), "payloads")
    return Archive(headers, payloads)


def verified(payload: str = "payload", digest: str = "digest") -> Column:
    """The payload, or an error if its bytes don't have the digest that it is stored under."""
    return F.when(F.sha2(payload, 256) == F.col(digest), F.col(payload)).otherwise(F.raise_error(F.concat(F.lit("payload does not match digest "), F.col(digest))))


def _field(block: Column, name: str) -> Column:
    return F.regexp_extract(block, rf"\n{name}: ([^\r\n]*)\r\n", 1)


def reconstruct(archive: Archive) -> DataFrame:
    """The records as they stand in a WARC file: page_id, record (binary).  Only responses hold payload
    bytes, so only their headers are joined to the payloads; revisits are their headers."""
    told = archive.headers.withColumn("response", _field(F.col("header"), "WARC-Type") == "response")
    end = F.lit(bytearray(b"\r\n\r\n"))
    blocks = F.concat("header", "http").cast("binary")
    full = told.where("response").join(archive.payloads.select("digest", verified().alias("payload")), "digest").select("page_id", F.concat(blocks, F.col("payload"), end).alias("record"))
    return full.unionByName(told.where("not response").select("page_id", F.concat(blocks, end).alias("record")))


def parse_records(records: DataFrame) -> DataFrame:
    """What the bytes of WARC records (column ``record``) say: page_id, record_type, told_digest, refers_to, and
    of responses payload_bytes and payload_digest, computed from the payload.  A record whose length is not
    what its header tells, or a response whose payload's digest is not, raises an error."""
    gap = CRLF + CRLF
    head = records.select("record", F.concat(F.substring_index(F.col("record").cast("string"), gap, 1), F.lit(CRLF)).alias("head"))
    start = (F.octet_length("head") + 3).cast("int")  # the head's own line end is counted, the blank line and the first byte are not
    length = _field(F.col("head"), "Content-Length").cast("int")
    fits = F.octet_length("record") == start - 1 + length + len(gap)
    block = F.when(fits, F.substring(F.col("record"), start, length)).otherwise(F.raise_error(F.lit("a record is not as long as its header tells")).cast("binary"))
    read = head.select("head", block.alias("block"))
    page = lambda name: F.regexp_extract(_field(F.col("head"), name), r"^<urn:page:(-?\d+)>$", 1)
    http = F.octet_length(F.substring_index(F.col("block").cast("string"), gap, 1)) + len(gap)
    fields = read.select(
        F.when(page("WARC-Record-ID") != "", page("WARC-Record-ID").cast("long")).alias("page_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        F.regexp_replace(_field(F.col("head"), "WARC-Payload-Digest"), "^sha1:", "").alias("told_digest"),
        F.when(page("WARC-Refers-To") != "", page("WARC-Refers-To").cast("long")).alias("refers_to"),
        F.when(_field(F.col("head"), "WARC-Type") == "response", F.substring(F.col("block"), (http + 1).cast("int"), F.lit((1 << 31) - 1))).alias("payload"),
    )
    sha1 = base32_sha1(F.col("payload"))
    checked = F.when(F.col("payload").isNull() | (sha1 == F.col("told_digest")), sha1).otherwise(F.raise_error(F.lit("a header's digest is not its payload's")).cast("string"))
    return fields.select("page_id", "record_type", "told_digest", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), checked.alias("payload_digest"))


def read_back(archive: Archive, scratch: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record, read from its bytes; a
    revisit takes the payload's length from the response it refers to, which must have the digest it tells."""
    told = scratch.table(parse_records(reconstruct(archive)), "records")
    responses = told.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    owners = responses.where("page_id is not null").groupBy("page_id", "payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    owners = owners.withColumnRenamed("page_id", "refers_to").withColumnRenamed("payload_digest", "told_digest")
    met = told.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to", "told_digest").join(owners, ["refers_to", "told_digest"], "left")
    size = F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit refers to no response with its digest")).cast("long"))
    return responses.unionByName(met.select("page_id", size.alias("payload_bytes"), F.col("told_digest").alias("payload_digest"), "record_type", "refers_to"))
