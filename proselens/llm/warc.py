"""WARC archives: a writer through Spark's own file sink and a reader that salvages damaged archives.

Every record is a gzip member of its own. Spark's text sink, which commits whole files and survives lost executors,
writes their bytes; it wants a separator, so a member's last byte, zero below 16 MB, is left to it. Beyond, the zero
stays as padding, which readers of gzip skip.

The reader checks every record (version line, length, closing lines, payload digest). After a failed check it searches
for the next compressed member or version line that passes, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proselens.llm.common import checkpoint, join_hot, parts_for, scratch, table

END = b"\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = -(1 << 63)


def plan(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, payload_digest, payload_bytes, refers_to) of each page: refers_to is null for responses.

    Of equal payloads of at least `least` bytes the page with the smallest id is the response. Rows with a null id, or
    that repeat the smallest id, are responses too. Only digests travel; a payload in a third of all pages is one key.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = checkpoint(pages.select("page_id", F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes")))
    first = rows.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    out = join_hot(rows, first, "payload_digest", "n", rows.count())
    later = (F.col("payload_bytes") >= least) & (F.col("page_id") > F.col("first"))
    return out.select("page_id", "payload_digest", "payload_bytes", F.when(later, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, archive_bytes: int = 16 << 20) -> None:
    """One record for each row of pages(page_id, url, html), in archives of about archive_bytes, below path."""
    total = pages.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"]
    html = F.coalesce(F.col("html"), F.lit(""))
    # No key is null, and the exchange of texts has the join's keys, so they move once. Equal ids with different payloads are told apart by the digest.
    n, key = parts_for(total, archive_bytes), F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("__key")
    rows = plan(pages).dropDuplicates().select(key, F.col("payload_digest").alias("__digest"), "payload_bytes", "refers_to").repartition(n, "__key", "__digest")
    all_ = pages.select(key, F.sha2(html, 256).alias("__digest"), "page_id", "url", html.alias("html")).repartition(n, "__key", "__digest")
    rows = all_.join(rows, ["__key", "__digest"]).withColumnRenamed("__digest", "payload_digest")
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    uri = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), F.lit("\r\n"))).otherwise("")
    is_response = F.col("refers_to").isNull()
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number(F.col("page_id")), F.lit(">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\n"), uri,
        F.when(~is_response, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), number(F.col("refers_to")), F.lit(">\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha256:"), "payload_digest", F.lit("\r\nPayload-Length: "), F.col("payload_bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), (F.lit(len(HTTP)) + F.when(is_response, F.col("payload_bytes")).otherwise(0)).cast("string"), F.lit("\r\n\r\n" + HTTP),
    )
    rows = rows.select(head.alias("head"), F.when(is_response, F.col("html")).alias("html")).mapInArrow(_members, "value binary")
    rows.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, n = [], 0
        for head, html in zip(*b.columns):
            z = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = b"".join([z.compress((head.as_py() + (html.as_py() or "")).encode()), z.compress(END), z.flush()])
            out.append(raw[:-1] if raw[-1] == 0 else raw)
            n += len(raw)
            if n >= 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                out, n = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])


@dataclass
class Record:
    begin: int
    end: int
    fields: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block[self.block.find(END) + 4 :] if self.block.startswith(b"HTTP/") else self.block


def parse(data: bytes, at: int, checked: bool = True) -> tuple[Record | None, str]:
    """The record at a place in uncompressed data, or why there is none."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        return None, "no version line"
    stop = data.find(END, at)
    if stop < 0:
        return None, "headers without an end"
    fields = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None, "header line without a colon"
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    if not fields.get("content-length", "").isdigit():
        return None, "no length"
    begin, end = stop + 4, stop + 4 + int(fields["content-length"])
    if data[end : end + 4] != END:
        return None, "no closing lines where the length ends"
    out = Record(at, end + 4, fields, data[begin:end])
    kind, _, digest = fields.get("warc-payload-digest", "").partition(":")
    if checked and fields.get("warc-type") == "response" and kind == "sha256" and hashlib.sha256(out.payload).hexdigest() != digest:
        return None, "payload digest differs"
    return out, ""


def inflate(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int | None]:
    """What the compressed member at a place holds, and its end; if it is damaged, what came before, and no end."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    for i in range(at, len(data), step):
        try:
            out.append(z.decompress(view[i : i + step]))
        except zlib.error:
            break
        if z.eof:
            return b"".join(out), min(i + step, len(data)) - len(z.unused_data)
    return b"".join(out), None


def whole_records(data: bytes) -> Iterator[Record]:
    """The records from the start of uncompressed data up to the first that fails."""
    at = 0
    while at < len(data) and (got := parse(data, at)[0]):
        yield got
        at = got.end


def salvage(data: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records in order, and (begin, end, reason) for each gap. A compressed member may hold any number of records: all
    that pass are recovered, from a damaged or truncated one too, and a member that holds anything else is logged as a
    gap. Zeros after a member are padding."""
    at, bad, why = 0, None, ""
    while at < len(data):
        found, reason, end = [], "", None
        if data[at : at + 3] == MEMBER:
            inner, end = inflate(data, at)
            if end is None:
                found, reason = list(whole_records(inner)), "member doesn't decompress"
            else:
                for x in salvage(inner) if inner[:3] != MEMBER else [(0, len(inner), "member in a member")]:
                    if isinstance(x, Record):
                        found.append(x)
                    else:
                        reason = reason or x[2]
            found = [Record(at, at if end is None else end, x.fields, x.block) for x in found]
        else:
            got, reason = parse(data, at)
            if got:
                found, end = [got], got.end
        if bad is not None and end is not None and not reason:
            yield bad, at, why
            bad = None
        yield from found
        if reason and bad is None:
            bad, why = at, reason
        if end is not None:
            at = end
            if reason:
                yield bad, at, why
                bad = None
            while data[at : at + 1] == b"\0":
                at += 1
            continue
        # What a damaged member gave may stand in it uncompressed, too; only another member can follow it.
        next_ = (re.compile(re.escape(MEMBER)) if found else START).search(data, at + 1)
        at = next_.start() if next_ else len(data)
    if bad is not None:
        yield bad, len(data), why


READ = "path string, begin long, end long, gap string, record_type string, record_id string, refers_to string, digest string, length long, payload_bytes long"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record and, with gap set, for each gap of the archives below path; archives are read one at a time."""

    def rows(batches):
        for b in batches:
            for path_, data in zip(b.column(0).to_pylist(), b.column(1)):
                out = []
                for x in salvage(data.as_py()):
                    if isinstance(x, tuple):
                        out.append((path_, x[0], x[1], x[2], *[None] * 6))
                    else:
                        f = x.fields
                        full = f.get("warc-type") == "response"
                        payload = x.payload
                        digest = hashlib.sha256(payload).hexdigest() if full else f.get("warc-payload-digest", "").removeprefix("sha256:")
                        said = f.get("payload-length", "")
                        out.append((path_, x.begin, x.end, None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), digest, len(payload), len(payload) if full else int(said) if said.isdigit() else None))
                        if len(out) >= 5000:
                            yield batch(out)
                            out = []
                if out:
                    yield batch(out)

    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.int64()]
    names = [c.split()[0] for c in READ.split(", ")]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(rows, READ)


def store(spark: SparkSession, pages: DataFrame, path: str) -> DataFrame:
    """pages(page_id, url, html) written below path and read back: the rows of read(), kept in path/index, with the gaps
    alone in path/gaps. A page that can't be read back is an error that names the log."""
    write(pages, f"{path}/archives")
    read(spark, f"{path}/archives").write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    index.where("gap is not null").select("path", "begin", "end", "gap").write.parquet(f"{path}/gaps")
    found, there = index.where("gap is null").count(), pages.count()
    if found != there:
        raise RuntimeError(f"{there} pages were written, {found} records read; see {path}/gaps")
    return index.where("gap is null")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record tells it after writing and reading back."""
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    got = store(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"), scratch(spark, "warc"))
    return got.select(number(F.col("record_id")).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number(F.col("refers_to")).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id > f THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id > f THEN f END AS refers_to FROM q
"""
