"""WARC derivatives: metadata and plain-text conversion records linked to responses.

Responses come from WARC files (``read_responses``), with their own HTTP headers, dates and
payload digests, or from a table of pages without any (``responses``), which get a bare header.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

CRLF = "\r\n"
_ATTRS = r"\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"
#: Comments and elements whose content isn't markup, nor text of the page. Of a head only its title is
#: text; anything else that isn't hidden ends the head, with or without ``</head>``. A title without end tag ends at the next tag.
_RAW = re.compile(
    rf"<!--.*?(?:-->|$)|<(script|style){_ATTRS}.*?(?:</\1\s*>|$)|<title{_ATTRS}(?:[^<]*+(?:<(?!/?title\b)[^<]*+)*+</title\s*>|[^<]*+)",
    re.S | re.I,
)
#: Tags of elements that hide their content if they are closed.
_SHUT = re.compile(rf"<(/?)(noscript|template|svg){_ATTRS}", re.I)
_TITLE = re.compile(r"<title\b[^>]*>([^<]*+(?:<(?!/?title\b)[^<]*+)*+(?=</title\s*>)|[^<]*+)", re.I)
_BLOCK = re.compile(r"</?(?:address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|body|html)\b(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>", re.I)
_TAG = re.compile(r"<[/!?]?[a-zA-Z](?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|<![^>]*>|<\?[^>]*>")
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

_BASE = re.compile(r"<base\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

_SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, block_digest string, source_digest string, header string, body string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    """A record id that depends on its parts only, so a rerun builds the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(parts))}>"


def visible(page: str) -> str:
    """The page without hidden content. A noscript, template or svg that is never closed hides nothing."""
    page = _RAW.sub("", page)
    opened, spans = {}, []
    for m in _SHUT.finditer(page):
        name = m[2].lower()
        if not m[1]:
            if not (name == "svg" and m[0].endswith("/>")):
                opened.setdefault(name, []).append(m.start())
        elif opened.get(name):
            start = opened[name].pop()
            while spans and spans[-1][0] >= start:
                spans.pop()
            spans.append((start, m.end()))
    parts, at = [], 0
    for start, end in spans:
        if start >= at:
            parts.append(page[at:start])
            at = end
    return "".join([*parts, page[at:]])


def plain_text(page: str) -> str:
    """Visible text, a line per block element, entities decoded, white space collapsed."""
    text = _TAG.sub("", _BLOCK.sub("\n", visible(page)))
    lines = (" ".join(line.split()) for line in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def title(page: str) -> str:
    found = _TITLE.search(page)
    return " ".join(html.unescape(_TAG.sub("", found[1])).split()) if found else ""


def links(page: str, base: str) -> list[str]:
    """Link targets, relative ones against the page's ``<base href>`` if it has one, else its own address."""
    out, shown = [], visible(page)
    own = _BASE.search(shown)
    if own:
        try:
            base = urljoin(base, html.unescape(next(x for x in own.groups() if x is not None)).strip())
        except ValueError:
            pass
    for m in _LINK.finditer(shown):
        href = html.unescape(next(x for x in m.groups() if x is not None)).strip()
        try:
            out.append(urljoin(base, href))
        except ValueError:
            out.append(href)
    return out


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records (page_id, record_id, target_uri, date, http_header, payload, payload_digest) of ``pages`` (page_id, url, html).
    A page knows no headers, so all get the same two fields and no digest."""
    name = F.sha2(F.concat_ws("\n", F.col("page_id").cast("string"), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    urn = F.concat(F.lit("<urn:uuid:"), *(x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(name, a, n), F.lit("-" if a < 21 else ">"))))
    return pages.select(
        "page_id",
        urn.alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit(CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"])).alias("http_header"),
        F.coalesce("html", F.lit("")).alias("payload"),
        F.lit(None).cast("string").alias("payload_digest"),
    )


_RESPONSE = "page_id long, record_id string, target_uri string, date string, http_header string, payload string, payload_digest string, complete boolean"


def _fields(head: str) -> dict[str, str]:
    """Header fields by lower-cased name; the first of equal ones counts, folded lines are joined."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r?\n[ \t]+", " ", head).splitlines():
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def media_type(http_header: str) -> str:
    """``type/subtype`` of a response in lower case; empty if it has none."""
    return _fields(http_header).get("content-type", "").partition(";")[0].strip().lower()


def is_text(media: str) -> bool:
    """Whether a response of that type is text; one without a type is taken for HTML."""
    return not media or media.startswith("text/") or media.endswith(("+xml", "+json")) or media in ("application/xml", "application/json", "application/javascript")


def is_html(media: str) -> bool:
    return media in ("", "text/html", "application/xhtml+xml")


def _unchunked(body: bytes) -> bytes:
    """The content of a chunked body; what isn't chunked after all stays."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,15}", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        out.append(body[end + 2 : end + 2 + n])
        if not n:
            return b"".join(out)
        at = end + 4 + n


def _unpacked(body: bytes, encodings: str) -> bytes | None:
    """The body without its content encodings, the last one first; a damaged one as far as it goes, None for an unknown one."""
    for name in reversed([e.strip().lower() for e in encodings.split(",") if e.strip()]):
        if name in ("gzip", "x-gzip", "deflate"):
            for bits in (47, -15):  # gzip or zlib by their heads, else bare deflate
                try:
                    body = zlib.decompressobj(bits).decompress(body)
                    break
                except zlib.error:
                    continue
        elif name != "identity":
            return None
    return body


def _decoded(body: bytes, content_type: str) -> str:
    named = re.search(r"charset=[\"']?([\w.:-]+)", content_type, re.I)
    for charset in ([named[1]] if named else []) + ["utf-8"]:
        try:
            return body.decode(charset)
        except (LookupError, UnicodeDecodeError):
            pass
    return body.decode("utf-8", "replace")


def parse_response(raw: bytes) -> tuple | None:
    """The fields of a response record in the order of the table; None for other records. The payload is the text without chunks and
    content encodings; that of another media type, or in an unknown encoding, is empty.
    ``complete`` is false if the block isn't as long as its header says."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = _fields(head.decode("utf-8", "replace"))
    if fields.get("warc-type") != "response":
        return None
    size = fields.get("content-length", "")
    whole = size.isdigit() and len(block) >= int(size)
    block = block[: int(size)] if whole else block
    http, _, body = block.partition(b"\r\n\r\n")
    header = http.decode("latin-1")
    about = _fields(header)
    plain = _unchunked(body) if "chunked" in about.get("transfer-encoding", "").lower() else body
    unpacked = _unpacked(plain, about.get("content-encoding", ""))
    text = _decoded(unpacked, about.get("content-type", "")) if unpacked is not None and is_text(media_type(header)) else ""
    given = fields.get("warc-payload-digest") or digest(body)
    return None, fields.get("warc-record-id", ""), fields.get("warc-target-uri", "").strip("<>"), fields.get("warc-date", ""), header, text, given, whole


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files, plain or gzip: the columns of ``responses`` (page_id is null) and ``complete``.

    Records are told apart by the line breaks and version line between them, so plain files are split over
    tasks by Spark. A block that holds such a line itself is cut there, and its record isn't ``complete``."""
    raw = spark.read.option("lineSep", CRLF * 2 + "WARC/1.").text(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] + [pa.string()] * 6 + [pa.bool_()]
        for batch in slices(batches, 100):
            found = [x for x in map(parse_response, batch.column(0).to_pylist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=[x.split(" ")[0] for x in _RESPONSE.split(", ")])

    return raw.select(F.col("value").cast("binary")).mapInArrow(run, _RESPONSE)


def _header(kind: str, ids: tuple[str, str], uri: str, date: str, content_type: str, block: bytes, source_digest: str) -> str:
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", ids[0]), ("WARC-Refers-To", ids[1]), ("WARC-Target-URI", uri), ("WARC-Date", date),
        ("WARC-Block-Digest", digest(block)), ("X-Source-Payload-Digest", source_digest), ("Content-Type", content_type), ("Content-Length", str(len(block))),
    ]
    # A line break inside a value would end the field.
    return CRLF.join(["WARC/1.0", *(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}" for k, v in fields)])


def derivatives(responses: DataFrame) -> DataFrame:
    """One metadata record for each response, and one conversion record if its media type is text.

    Returns page_id, record_type, record_id, refers_to (the response), target_uri,
    block_digest, source_digest (the response's payload digest if it has one, else that of its payload), header, body. The metadata record keeps the
    source's HTTP header fields (as ``source-header``), title and links. Nulls are empty
    strings; a repeated response gives repeated records with equal ids; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1000):
            out: list[list] = [[] for _ in range(9)]
            for page_id, rid, uri, date, http, payload, given in zip(*(batch.column(i).to_pylist() for i in range(7))):
                rid, uri, date, http, payload = (x or "" for x in (rid, uri, date, http, payload))
                source = given or digest(payload.encode("utf-8", "replace"))
                media = media_type(http)
                fields = [f"source-header: {x}" for x in re.split(r"\r?\n", http) if x]
                if is_html(media):
                    fields += [f"title: {title(payload)}"] + [f"outlink: {re.sub(r'\s+', ' ', x)}" for x in links(payload, uri)]
                records = [("metadata", "application/warc-fields", CRLF.join(fields) + CRLF)]
                if is_text(media):
                    records.append(("conversion", "text/plain; charset=utf-8", plain_text(payload) if is_html(media) else payload))
                for kind, content_type, body in records:
                    block, own = body.encode("utf-8", "replace"), record_id(rid, kind)
                    header = _header(kind, (own, rid), uri, date, content_type, block, source)
                    for c, v in zip(out, (page_id, kind, own, rid, uri, digest(block), source, header, body)):
                        c.append(v)
            kinds = [pa.int64()] + [pa.string()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=[x.split(" ")[0] for x in _SCHEMA.split(", ")])

    return responses.select("page_id", "record_id", "target_uri", "date", "http_header", "payload", "payload_digest").mapInArrow(run, _SCHEMA)


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (header, body) as gzipped WARC files into a folder, by Spark's own text writer: each record is its header, a blank line and the block, and ends with two line breaks."""
    one = records.select(F.concat("header", F.lit(CRLF * 2), "body").alias("value"))
    one.write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)
