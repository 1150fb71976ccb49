"""WARC derivative builder: responses become linked metadata and plain-text conversion records.

A response is a row with its record id, target address, date, HTTP head and payload. Each gives one `metadata`
and one `conversion` record; both refer to it by WARC-Refers-To and carry its address, date, digests and, in the
metadata block, every source header. Record ids are name-based, so a rerun makes the same records.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VERSION = "WARC/1.1"
#: Namespace of the record ids.
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Bytes that are decompressed at once where a stream may be damaged.
PIECE = 4096
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|head)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|h[1-6]|li|ul|ol|tr|table|br|hr|article|section|nav|header|footer|blockquote|pre|dd|dt|dl|form|aside|main|body|html)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
RECORD = "source_id string, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, refers_to_digest string, headers map<string,string>, block binary"


def digest(block: bytes) -> str:
    """sha1 in base 32, as WARC tools label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, '|'.join(parts))}>"


def plain_text(payload: str) -> str:
    """Visible text of a page, one line a block, spaces collapsed."""
    text = _HIDDEN.sub(" ", payload)
    text = _TAG.sub("", _BREAK.sub("\n", text))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def inflated(data: bytes, bits: int) -> bytes:
    """What can be read of one compressed stream; nothing if it is none."""
    out, step = [], zlib.decompressobj(bits)
    try:
        for i in range(0, len(data), PIECE):
            out.append(step.decompress(data[i : i + PIECE]))
    except zlib.error:
        pass
    return b"".join(out)


def unzipped(data: bytes) -> bytes:
    """What can be read of the members of a gzip file, up to where it is cut off or damaged."""
    out = []
    while data:
        step = zlib.decompressobj(31)
        try:
            out.append(step.decompress(data))
        except zlib.error:
            return b"".join([*out, inflated(data, 31)])
        data = step.unused_data.lstrip(b"\0")
    return b"".join(out)


def dechunked(data: bytes) -> bytes:
    """Body of a chunked message; the rest as it stands from where it isn't well formed."""
    out, i = [], 0
    while (end := data.find(b"\r\n", i)) >= 0:
        try:
            size = int(data[i:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            break
        if size <= 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        i = end + 2 + size + 2
    return b"".join([*out, data[i:]])


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and payload of an HTTP message; a block without head is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])], payload


def decoded(headers: list[tuple[str, str]], payload: bytes) -> str:
    """Payload as text by its content encoding and charset; bytes that fit neither are replaced."""
    low = {k.lower(): v for k, v in headers}
    if low.get("transfer-encoding", "").lower() == "chunked":
        payload = dechunked(payload)
    coding = low.get("content-encoding", "").lower()
    if coding in ("gzip", "x-gzip"):
        payload = unzipped(payload) or payload
    elif coding == "deflate":
        payload = inflated(payload, 15) or inflated(payload, -15) or payload
    m = _CHARSET.search(low.get("content-type", "")) or _CHARSET.search(payload[:1024].decode("latin-1"))
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derive(source: str | None, rid: str, uri: str | None, date: str | None, headers: dict, block: bytes) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, http, payload = split_http(block)
    whole, body = digest(block), digest(payload)
    fields = [("source-status", status), *((f"source-http-{k.lower()}", v) for k, v in http), *((f"source-{k.lower()}", v) for k, v in sorted(headers.items()))]
    fields += [("source-block-digest", whole), ("source-payload-digest", body), ("source-payload-length", str(len(payload)))]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    text = plain_text(decoded(http, payload)).encode()
    conv_id, meta_id = record_id(rid, "conversion"), record_id(rid, "metadata")
    out = []
    for kind, own, ctype, data, extra in (("metadata", meta_id, "application/warc-fields", meta, {"WARC-Concurrent-To": conv_id}), ("conversion", conv_id, "text/plain; charset=utf-8", text, {"WARC-Concurrent-To": meta_id})):
        named = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Refers-To": rid, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Block-Digest": digest(data), "Content-Type": ctype, "Content-Length": str(len(data))}
        named |= extra | ({"WARC-Refers-To-Target-URI": uri, "WARC-Refers-To-Date": date} if uri else {})
        named["WARC-Source-Payload-Digest"] = body
        out.append((source, kind, own, rid, uri, date, ctype, len(data), named["WARC-Block-Digest"], digest(data) if kind == "conversion" else None, body, [(k, v) for k, v in named.items() if v is not None], data))
    return out


def serialise(headers: dict, block: bytes) -> bytes:
    """A record as it stands in a file."""
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_records(data: bytes) -> list[tuple[dict, bytes]]:
    """Records of a file's bytes, gzipped or not; a truncated last record is left out, as is one without a length."""
    if data[:2] == b"\x1f\x8b":
        data = unzipped(data)
    out, i = [], 0
    while (i := data.find(b"WARC/", i)) >= 0:
        end = data.find(b"\r\n\r\n", i)
        if end < 0:
            break
        headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in data[i:end].decode("utf-8", "replace").split("\r\n")[1:])}
        length = headers.get("Content-Length", "0")
        if not (length.isascii() and length.isdigit()):
            i = end + 4
            continue
        size = int(length)
        if end + 4 + size > len(data):
            break
        out.append((headers, data[end + 4 : end + 4 + size]))
        i = end + 4 + size
    return out


_ARROW = pa.schema(
    [("source_id", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("refers_to_digest", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())]
)


def _build(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 128):
            rows = []
            for source, rid, uri, date, headers, block in zip(*(c.to_pylist() for c in batch.slice(a, 128).columns), strict=True):
                block = block or b""
                rows += derive(source, rid or record_id(uri or "", digest(block)), uri, date, dict(headers or ()), block)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def derivatives(responses: DataFrame) -> DataFrame:
    """Metadata and conversion records of responses (source_id, record_id, target_uri, date, headers map, block binary).

    Two rows a response. A null block is the empty one, a null address or date leaves its headers out, a null
    record id is made of address and digest; repeated rows give repeated records. Further columns are ignored.
    """
    small_batches(responses.sparkSession)
    base = responses.select(F.col("source_id").cast("string"), "record_id", "target_uri", "date", F.col("headers").cast("map<string,string>"), F.col("block").cast("binary"))
    return base.mapInArrow(_build, RECORD)


def responses_of_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as captured responses: record ids made of the page's id, address and content, a plain HTTP head, the page in UTF-8."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.format_string("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n", F.octet_length(body))
    name = F.sha1(F.concat_ws("|", F.lit("page"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha1(body)))
    parts = [F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    rid = F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))
    headers = F.create_map(F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Record-ID"), rid, F.lit("Content-Type"), F.lit("application/http; msgtype=response"))
    return pages.select(F.col("page_id").cast("string").alias("source_id"), rid.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), F.concat(F.encode(head, "UTF-8"), body).alias("block"))


def _records(batches):
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = [(h, b) for h, b in parse_records(data) if h.get("WARC-Type") == "response"]
            cols = [[path] * len(found), [h.get("WARC-Record-ID") for h, _ in found], [h.get("WARC-Target-URI") for h, _ in found], [h.get("WARC-Date") for h, _ in found], [list(h.items()) for h, _ in found], [b for _, b in found]]
            types = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["source_id", "record_id", "target_uri", "date", "headers", "block"])


def read_responses(spark, path: str) -> DataFrame:
    """Responses of WARC files (.warc, .warc.gz), one file a row of one batch: files should be of common crawl size."""
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_records, "source_id string, record_id string, target_uri string, date string, headers map<string,string>, block binary")


def op4_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    out = derivatives(responses_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return out.select(F.col("source_id").cast("long").alias("page_id"), *[c for c in out.columns if c not in ("source_id", "headers")], F.to_json("headers").alias("headers"))
