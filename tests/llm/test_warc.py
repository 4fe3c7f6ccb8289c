"""Response records as crawlers write them: chunks, content encodings, media types, base addresses."""

import gzip
import zlib

from folio.llm import warc

PAGE = '<html><head><title>Grüße</title><base href="/deep/er/"></head><body><p>Hello world</p><a href="x.html">x</a> <a href="https://b.example/">b</a></body></html>'


def chunked(body, size=7):
    parts = [body[k : k + size] for k in range(0, len(body), size)]
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def record(n, headers, body, kind="response"):
    block = b"HTTP/1.1 200 OK\r\n" + "\r\n".join(headers).encode() + b"\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://a.example/dir/{n}\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


HTML = PAGE.encode()
CASES = {
    "plain": (["Content-Type: text/html; charset=utf-8"], HTML),
    "chunked": (["Content-Type: text/html; charset=utf-8", "Transfer-Encoding: chunked"], chunked(HTML)),
    "gzip": (["Content-Type: text/html", "Content-Encoding: gzip"], gzip.compress(HTML, mtime=0)),
    "deflate": (["Content-Type: text/html", "Content-Encoding: deflate"], zlib.compress(HTML)),
    "bare deflate": (["Content-Type: text/html", "Content-Encoding: deflate"], zlib.compress(HTML)[2:-4]),
    "both": (["Content-Type: text/html", "Content-Encoding: gzip", "transfer-encoding: Chunked"], chunked(gzip.compress(HTML, mtime=0), 50)),
    "latin": (["Content-Type: text/html; charset=iso-8859-1"], PAGE.encode("latin-1")),
    "said chunked": (["Content-Type: text/html", "Transfer-Encoding: chunked"], HTML),
    "no type": (["X: y"], HTML),
}


def test_encodings(spark, tmp_path):
    names = list(CASES)
    other = {"image": (["Content-Type: image/png"], b"\x89PNG\r\n\x1a\n\x00\xff"), "unknown": (["Content-Type: text/html", "Content-Encoding: br"], b"\x01\x02"), "text": (["Content-Type: text/plain"], b"a < b > c\n\n d"), "damaged": (["Content-Type: text/html", "Content-Encoding: gzip"], b"not gzip"), "cut": (["Content-Type: text/html", "Transfer-Encoding: chunked"], b"5\r\nHel")}
    raw = b"".join(record(n, *(CASES | other)[n]) for n in [*names, *other]) + record("q", ["X: y"], b"", kind="request")
    (tmp_path / "a.warc").write_bytes(raw)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(f"zip {n}", *CASES[n])) for n in names))  # a member for each record
    found = warc.read_responses(spark, str(tmp_path)).collect()
    by = {r.record_id[10:-1]: r for r in found}
    assert len(found) == 2 * len(names) + len(other) and all(r.complete for r in found)
    for n in names:
        assert by[n].payload == by[f"zip {n}"].payload == PAGE, n
    assert (by["image"].payload, by["unknown"].payload, by["text"].payload, by["damaged"].payload, by["cut"].payload) == ("", "", "a < b > c\n\n d", "not gzip", "Hel")
    made = warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()
    kinds = {}
    for r in made:
        kinds.setdefault(r.refers_to[10:-1], {})[r.record_type] = r
    assert set(kinds["image"]) == {"metadata"} and all(set(v) == {"metadata", "conversion"} for k, v in kinds.items() if k != "image")
    for n in names:
        assert kinds[n]["conversion"].body.splitlines() == ["Hello world", "x b"] and "title: Grüße" in kinds[n]["metadata"].body
        assert "outlink: http://a.example/deep/er/x.html" in kinds[n]["metadata"].body and "outlink: https://b.example/" in kinds[n]["metadata"].body
    assert kinds["text"]["conversion"].body == "a < b > c\n\n d" and "title" not in kinds["image"]["metadata"].body
    digests = {warc.digest(CASES[n][1]) for n in names}
    assert {kinds[n]["metadata"].source_digest for n in names} == digests


def test_long_bodies():
    body = b"x" * 3_000_000
    assert warc._unchunked(chunked(body, 1000)) == body and warc._unpacked(gzip.compress(body), "gzip") == body
    assert warc.links("<a href=x>" * 50_000, "http://a/")[:1] == ["http://a/x"]
