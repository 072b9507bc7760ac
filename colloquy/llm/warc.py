"""WARC archives of web pages: written with an index, read back by coalesced byte ranges.

Rows in: page_id, url and html, further columns ignored. A null html is an empty payload, a null url
an empty one; control characters in a url are percent-encoded. Of records with equal payloads of at
least `min_bytes` bytes, the one with the least page_id is a response and the others are revisits of
it; smaller ones are all responses. Of repeated rows with one page_id and payload one is the
response. A null page_id comes after all others.

Who revisits whom is settled on digests alone; the pages are shuffled once, by archive file, and each
file is written by one task: records ordered by page_id, every record its own gzip member, as usual for
WARC. The same rows give the same bytes, and a file is renamed into place when complete, so a task
that is run again does no harm. Writing yields the index: file, offset, length, URL, digest and type of
every record. Readers pick index rows, sort them by offset, join ranges with gaps up to GAP_BYTES
into one read, and cut the records from each read. Archives may be in any store that pyarrow.fs
opens by URI. A file holds about FILE_BYTES of pages, and one page at least.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import shared_dir, staged

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = b"\r\n\r\n"
#: Target size of one archive file, of one read, and the gap that a read may span.
FILE_BYTES, READ_BYTES, GAP_BYTES = 32 << 20, 4 << 20, 64 << 10
#: Archive bytes that one task reads, about, and tasks over which the pages with one payload are spread.
TASK_BYTES, SPREAD = 8 << 20, 16
INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file int, offset long, length long"


def base32_sha1(data: Column) -> Column:
    """Base32 of the SHA-1: 20 bits (5 hex digits) give 4 characters."""
    hexed = F.sha1(data)
    out = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def _ident(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _number(ident: str) -> int | None:
    inner = ident.removeprefix("<urn:page:").removesuffix(">")
    return None if inner == "none" else int(inner)


def record(page_id: int | None, url: str, payload: bytes, digest: str, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _ident(page_id)), ("WARC-Date", "2020-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _ident(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]).encode() + END + block + END


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple[dict[str, str], int, bytes]:
    """Header fields, the payload's length as the HTTP head has it, and the payload (HTTP body; none in a revisit) of one record."""
    head, _, block = data.partition(END)
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    http, _, payload = block[: int(fields["Content-Length"])].partition(END)
    size = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields, size, payload


def _name(file: int) -> str:
    return f"part-{file:06d}.warc.gz"


def _writer(path: str, min_bytes: int):
    def run(key: tuple, pages: pa.Table, revisits: pa.Table) -> pa.Table:
        file = key[0].as_py()
        other = {(r["page_id"], r["payload_digest"]): r["first"] for r in revisits.to_pylist()}
        rows = sorted(((r["page_id"] is None, r["page_id"] or 0, r["url"], r["html"]) for r in pages.select(["page_id", "url", "html"]).to_pylist()))
        fs, inner = pafs.FileSystem.from_uri(path)
        fs.create_dir(inner, recursive=True)
        part = f"{inner}/.{_name(file)}.{uuid.uuid4().hex}"
        seen, out, at = set(), [], 0
        with fs.open_output_stream(part) as stream:
            for none, number, url, html in rows:
                page_id, payload = None if none else number, html.encode()
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                first = other.get((page_id, digest), page_id)
                revisit = len(payload) >= min_bytes and ((page_id, digest) in other or (page_id, digest) in seen)
                seen.add((page_id, digest))
                data = _member(record(page_id, url, payload, digest, revisit, first))
                stream.write(data)
                out.append((page_id, url, len(payload), digest, "revisit" if revisit else "response", first if revisit else None, file, at, len(data)))
                at += len(data)
        if rows:
            fs.move(part, f"{inner}/{_name(file)}")
        else:
            fs.delete_file(part)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        columns = list(zip(*out, strict=True)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

    return run


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives under path and return their index."""
    size = pages.agg(F.sum(F.octet_length(F.col("html").cast("string")).cast("long"))).first()[0] or 0
    files = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // FILE_BYTES)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    for c in ("\r", "\n", "\t", "\0"):
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    # rows that are alike in id and payload share a file; its writer tells them apart
    dealt = lambda d: d.withColumn("file", F.pmod(F.xxhash64("page_id", "payload_bytes"), F.lit(files)).cast("int"))
    meta = dealt(rows.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), base32_sha1(F.encode("html", "UTF-8")).alias("payload_digest")))
    meta = staged(meta, "digests").where(F.col("payload_bytes") >= min_bytes)
    # null ids last: the least of the known ones, else null
    first = meta.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # the pages of a common payload meet their first in SPREAD tasks
    first = first.select("payload_digest", "payload_bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))
    meta = meta.withColumn("part", F.pmod(F.xxhash64("page_id"), F.lit(SPREAD)).cast("int"))
    revisits = meta.join(first, ["payload_digest", "payload_bytes", "part"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select("file", "page_id", "payload_digest", "first").distinct()
    whole = dealt(rows.withColumn("payload_bytes", F.octet_length("html").cast("long"))).select("file", "page_id", "url", "html")
    return staged(whole.groupBy("file").cogroup(revisits.groupBy("file")).applyInArrow(_writer(path, min_bytes), INDEX), "index")


def _read(path: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(path)
        for batch in frames:
            out, stream, of = [], None, None
            for r in sorted(batch.to_pylist(), key=lambda r: (r["file"], r["begin"])):
                if of != r["file"]:
                    stream, of = fs.open_input_file(f"{inner}/{_name(r['file'])}"), r["file"]
                stream.seek(r["begin"])
                data = stream.read(r["end"] - r["begin"])
                for offset, length in sorted((x["offset"], x["length"]) for x in r["parts"]):
                    fields, size, payload = parse(zlib.decompress(data[offset - r["begin"] : offset - r["begin"] + length], 31))
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
                    out.append((_number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], fields["WARC-Type"], size, digest, _number(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"])

    return run


RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def ranges(selected: DataFrame, gap: int = GAP_BYTES, most: int = READ_BYTES) -> DataFrame:
    """Reads (file, begin, end, parts) that cover the selected index rows: neighbours with at most
    gap bytes between them share a read within one stretch of `most` bytes."""
    stretch = F.floor(F.col("offset") / most)
    order = W.partitionBy("file", "stretch").orderBy("offset", "length")
    s = selected.select("file", "offset", "length", stretch.alias("stretch")).withColumn("last", F.max(F.col("offset") + F.col("length")).over(order.rowsBetween(W.unboundedPreceding, -1)))
    s = s.withColumn("read", F.sum(F.when(F.col("offset") - F.col("last") <= gap, 0).otherwise(1)).over(order))
    return s.groupBy("file", "stretch", "read").agg(F.min("offset").alias("begin"), F.max(F.col("offset") + F.col("length")).alias("end"), F.collect_list(F.struct("offset", "length")).alias("parts"))


def read(selected: DataFrame, path: str) -> DataFrame:
    """The records of the selected index rows (file, offset, length): page_id, url, record_type,
    payload_bytes, payload_digest, refers_to and payload; a revisit has no payload of its own."""
    size = selected.agg(F.sum("length")).first()[0] or 0
    reads = ranges(selected).select("file", "begin", "end", "parts")
    return reads.repartition(max(1, -(-size // TASK_BYTES)), "file", "begin").mapInArrow(_read(path), RECORD)


def archive_path(spark) -> str:
    return f"{shared_dir(spark)}/colloquy/{uuid.uuid4().hex}/warc"


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, read all records back: page_id, payload_bytes, payload_digest, record_type,
    refers_to, all as the records have them."""
    path = archive_path(pages.sparkSession)
    return read(write(pages, path, min_bytes), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle(min_bytes: int = 0) -> str:
    """round_trip in DuckDB's SQL over the table pages."""
    five = lambda k: " + ".join(f"(strpos('0123456789abcdef', substr(h, {5 * k + j + 1}, 1)) - 1) * {16 ** (4 - j)}" for j in range(5))
    digits = " || ".join(f"substr('{BASE32}', 1 + (({five(k)}) // {1 << shift}) % 32, 1)" for k in range(8) for shift in (15, 10, 5, 0))
    return f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, {digits} AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {min_bytes} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {min_bytes} AND first <> page_id THEN first END AS refers_to FROM f
"""
