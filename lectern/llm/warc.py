"""WARC derivatives: from response records to linked metadata and plain-text conversion records.

Record ids are UUIDs made from what a record is about, so that a rerun gives the same ids. A
derivative names its source by `WARC-Refers-To` and keeps the source's target, date and HTTP
headers; digests are `sha1:` and Base32, of the block, and for a response also of its payload.

Nulls: a page without url has the target `urn:page:<id>`, one without html an empty payload; a
page without id takes its place in ids as an empty text. Repeated pages give repeated records
with equal ids. Very long pages are handled whole, one at a time. Other columns are ignored.
A record's id depends on its own page alone, whatever rows lie beside it.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122
DATE = "2024-01-01T00:00:00Z"
RECORD = (
    "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, payload_digest string, http_headers string, block string"
)
_OPEN = re.compile(r"<(noscript|template|head|svg)\b[^>]*>", re.I)
_CLOSE = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("noscript", "template", "svg")}
#: What a head holds; and its end, if any, before the first tag that only a body holds.
_HEAD = re.compile(r"(?:\s+|<(?:meta|link|base)\b[^>]*>|<(title|noscript|template)\b[^>]*>.*?</\1\s*>)*", re.S | re.I)
_HEAD_END = re.compile(r"</head\s*>|<(?!(?:title|meta|link|base|noscript|template|head|html)\b)[a-z][^>]*>", re.I)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(
    r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|option|p|pre|section|table|tbody|td|th|thead|tr|ul)\b[^>]*>",
    re.I,
)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_TITLE = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<(a|img|link|iframe|source)\b([^>]*)>", re.I)
_META = re.compile(r"<meta\b([^>]*)>", re.I)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*about: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(0).join(about))}>"


def _shown(page: str) -> str:
    """page without comments, scripts and styles, which run to the end of the page if unclosed, and without head, noscript,
    template and svg. An unclosed head ends where its elements do; of the others only the tag goes."""
    page, out, at, unclosed = _COMMENT.sub(" ", page), [], 0, set()
    for m in _OPEN.finditer(page):
        kind, end = m[1].lower(), m.end()
        if m.start() < at:
            continue
        if kind == "head":
            end = _HEAD.match(page, end).end()
            close = None if kind in unclosed else _HEAD_END.search(page, end)
            if close is None:
                unclosed.add(kind)
            elif close[0].startswith("</"):
                end = close.end()
        elif not (kind == "svg" and m[0].endswith("/>")):
            close = None if kind in unclosed else _CLOSE[kind].search(page, end)
            if close is None:
                unclosed.add(kind)
                continue
            end = close.end()
        out += page[at : m.start()], " "
        at = end
    return "".join([*out, page[at:]])


def plain_text(page: str) -> str:
    """Text of a page: scripts, styles, head and comments out, a line for each block, entities decoded."""
    text = _TAG.sub("", _BREAK.sub("\n", _shown(page)))
    lines = (" ".join(line.split()) for line in entities.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _attributes(tag: str) -> dict[str, str]:
    return {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in _ATTRIBUTE.findall(tag)}


def page_metadata(page: str, target: str) -> dict:
    """Title, language, meta tags and links (resolved against the target)."""
    bare = _COMMENT.sub(" ", page)
    title, lang = _TITLE.search(bare), _LANG.search(bare)
    links = []
    for kind, rest in _LINK.findall(bare):
        own = _attributes(rest)
        if to := own.get("href") or own.get("src"):
            try:
                full = urljoin(target, to)
            except ValueError:
                full = to
            links.append({"path": f"{kind.upper()}@/{'href' if 'href' in own else 'src'}", "url": full})
    meta = [m for m in map(_attributes, _META.findall(bare)) if m]
    return {
        "title": " ".join(entities.unescape(_TAG.sub("", title[1])).split()) if title else None,
        "lang": lang[1].lower() if lang else None, "metas": meta, "links": links,
    }


def response(page_id: str | None, url: str | None, page: str | None, date: str = DATE) -> dict:
    page = page or ""
    payload = page.encode("utf-8", "replace")
    target = url or f"urn:page:{page_id or ''}"
    headers = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = headers.encode() + payload
    return {
        "record_type": "response", "record_id": record_id("response", page_id or "", target, digest(payload)),
        "refers_to": None, "target_uri": target, "date": date, "content_type": "application/http; msgtype=response",
        "content_length": len(block), "block_digest": digest(block), "payload_digest": digest(payload), "http_headers": headers, "block": headers + page,
    }


def derivatives(source: dict) -> list[dict]:
    """Metadata and conversion records of a response record."""
    head = source["http_headers"] or ""
    page, target = (source["block"] or "")[len(head) :], source["target_uri"]
    fields = dict(line.split(": ", 1) for line in head.split("\r\n")[1:] if ": " in line)
    about = {
        "envelope": {"record_id": source["record_id"], "target_uri": target, "date": source["date"], "block_digest": source["block_digest"], "payload_digest": source["payload_digest"]},
        "http": {"status": head.split("\r\n", 1)[0], "headers": fields}, "html": page_metadata(page, target),
    }
    out = []
    for kind, content_type, block in (
        ("metadata", "application/json", json.dumps(about, ensure_ascii=False, sort_keys=True)),
        ("conversion", "text/plain", plain_text(page)),
    ):
        raw = block.encode("utf-8", "replace")
        out.append({
            "record_type": kind, "record_id": record_id(kind, source["record_id"]), "refers_to": source["record_id"], "target_uri": target,
            "date": source["date"], "content_type": content_type, "content_length": len(raw), "block_digest": digest(raw),
            "payload_digest": source["payload_digest"], "http_headers": head, "block": block,
        })
    return out


_NAMES = [x.split()[0] for x in RECORD.split(", ")]
_KINDS = pa.schema([(n, pa.int64() if n == "content_length" else pa.string()) for n in _NAMES])


def _with_keys(keys: pa.Array, made: list[dict]) -> pa.RecordBatch:
    """Records with their keys, which stay in Arrow: pandas would turn those beside a null into floats."""
    rows = pa.RecordBatch.from_pylist(made, schema=_KINDS)
    return pa.RecordBatch.from_arrays([keys, *rows.columns], ["_k", *_NAMES])


def responses(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """A response record for each page."""
    common.bounded_batches(pages.sparkSession)
    own = F.col(f"`{key}`")
    rows = pages.select(own.alias("_k"), own.cast("string").alias("_s"), F.col(f"`{url}`").alias("_u"), F.col(f"`{html}`").alias("_h"))
    kind = rows.schema["_k"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _with_keys(batch["_k"], [response(k, u, h, date) for k, u, h in zip(*(batch[c].to_pylist() for c in ("_s", "_u", "_h")), strict=True)])

    return rows.mapInArrow(make, f"_k {kind}, {RECORD}").withColumnRenamed("_k", key)


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records for each response; records of other types give none. The key column is carried along."""
    common.bounded_batches(records.sparkSession)
    rows = records.filter("record_type = 'response'").select(F.col(f"`{key}`").alias("_k"), *_NAMES)
    kind = rows.schema["_k"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array([n for n in range(batch.num_rows) for _ in range(2)], pa.int32())
            yield _with_keys(batch["_k"].take(at), [d for r in batch.select(_NAMES).to_pylist() for d in derivatives(r)])

    return rows.mapInArrow(make, f"_k {kind}, {RECORD}").withColumnRenamed("_k", key)


#: Records in a file, at most: readers take a file whole.
RECORDS_PER_FILE = 20_000


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Compressed WARC/1.1 files of bounded numbers of records, by Spark's own committed text writer. Line breaks within
    a field are percent-encoded; a source's headers on a derived record go into an extension field, as JSON."""
    plain = lambda c: F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    field = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), plain(c.cast("string")), F.lit("\r\n"))).otherwise("")
    fields = (
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"),
        ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"),
    )
    source = F.when(F.col("record_type") != "response", F.to_json(F.struct(F.col("http_headers").alias("http"))))
    text = F.concat(F.lit("WARC/1.1\r\n"), *[field(n, F.col(c)) for n, c in fields], field(SOURCE_FIELD, F.when(F.col("http_headers").isNotNull(), source)), F.lit("\r\n"), F.col("block"))
    out = records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", str(records_per_file))
    out.option("compression", "gzip").text(path)


#: Extension field for the headers of the response that a record derives from.
SOURCE_FIELD = "X-Source-Headers"


def read_warc(spark, path: str) -> DataFrame:
    """Records of the WARC files in a folder, gzipped or not. A file is one task's work, as its records have no index."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip

        for batch in batches:
            for data in batch["content"]:
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                at, rows = 0, []
                while (begin := data.find(b"WARC/", at)) >= 0:
                    end = data.index(b"\r\n\r\n", begin)
                    own = {k.lower(): v for k, v in (x.split(": ", 1) for x in data[begin:end].decode("utf-8", "replace").split("\r\n")[1:])}
                    size = int(own["content-length"])
                    block = data[end + 4 : end + 4 + size]
                    at = end + 4 + size
                    http = block[: block.find(b"\r\n\r\n") + 4].decode("utf-8", "replace") if own["warc-type"] == "response" else json.loads(own.get(SOURCE_FIELD.lower(), "{}")).get("http")
                    rows.append({
                        "record_type": own["warc-type"], "record_id": own["warc-record-id"], "refers_to": own.get("warc-refers-to"), "target_uri": own.get("warc-target-uri"),
                        "date": own["warc-date"], "content_type": own.get("content-type"), "content_length": size, "block_digest": own.get("warc-block-digest"),
                        "payload_digest": own.get("warc-payload-digest"), "http_headers": http or None, "block": block.decode("utf-8", "replace"),
                    })
                yield pd.DataFrame(rows, columns=_NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD)


def op5_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages."""
    return derive(responses(common.read(spark, sf_dir, "pages")))
