import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folio.operators import selection
from folio.sources import articles, html
from folio.streaming import incremental

PAGE = """<html><head><link rel="canonical" href="/c-12.htm"><meta name="article:author" content=" An  B "><meta property="article:section" content="x">
<meta property="article:published_time" content="2025-11-10T08:00:00Z"></head><body><h1 class="detail-title"><span data-role="title">Tiêu&nbsp;đề</span></h1>
<div class="detail-content" data-role="content">loose<p>One <b>two</b></p><script>var t="</p>";</script><ul><li>a</li><li>b</ul><figure><img></figure>
<figure><img><figcaption>cap</figcaption></figure><div>box</div></div></body></html>"""


def test_parse_articles(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "v", "<p>nothing"), (3, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.parse_articles(df).collect()}
    one = got[1]
    assert (one.title, one.author, one.category, one.canonical_url) == ("Tiêu đề", "An B", "x", "/c-12.htm")
    assert one.paragraphs == ["One two", "a", "b", "[Ảnh] cap", "box"]
    assert one.published_at == dt.datetime(2025, 11, 10, 8)
    assert got[2].error and got[3].error


def test_timeline(spark):
    item = '<div class="box-category-item" data-id="7"><a class="box-category-link-title" href="/a-1.htm" title="T"></a><a class="box-category-category" href="/phap-luat">Law</a></div>'
    page = item + '<div class="box-category-item"></div>' + item.replace("a-1", "a-2")
    df = spark.createDataFrame([(1, page), (2, item)], "page int, html string")
    found = html.parse_timeline(df)
    assert [(r.page, r.position) for r in found.orderBy("page", "position").collect()] == [(1, 1), (1, 3), (2, 1)]
    got = selection.collect_timeline(found, keyword="PHAP-luat").collect()
    assert [(r.page, r.url) for r in got] == [(1, "https://example.com/a-1.htm"), (1, "https://example.com/a-2.htm")]
    assert selection.collect_timeline(found, keyword="sport").isEmpty()


def test_fetch_retries(spark):
    calls = spark.sparkContext.accumulator(0)

    def get(url, timeout):
        calls.add(1)
        if "bad" in url:
            raise OSError("down")
        return "ok " + url

    df = articles.page_urls(spark, "http://x/{page}", 1).unionByName(spark.createDataFrame([(2, "http://bad")], "page int, url string"))
    got = {r.page: r for r in html.fetch(df, get, backoff_s=0.0).collect()}
    assert got[1].html == "ok http://x/1" and got[2].error == "down" and got[2].html is None
    assert calls.value == 4


def test_document_ids(spark):
    urls = ["/x-185251107113106479.htm", "/abc/def.htm", "/abc/def/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r.x for r in df.select(articles.document_id(F.col("u")).alias("x")).collect()] == ["185251107113106479", "def", "def"]
    links = spark.createDataFrame([("http://a/b",), ("//h/p",), ("/p",), ("q",)], "u string")
    assert [r.x for r in links.select(articles.absolute_url(F.col("u"), "https://s.example").alias("x")).collect()] == ["http://a/b", "https://h/p", "https://s.example/p", "https://s.example/q"]


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "d1.json").write_text(json.dumps({"title": "t", "paragraphs": ["p"]}, indent=2))
    (tmp_path / "a" / "d2.json").write_text(json.dumps({"doc_id": "x"}))
    assert sorted(r.doc_id for r in articles.read_articles(spark, str(tmp_path / "a")).collect()) == ["d1", "x"]
    (tmp_path / "b.jsonl").write_text('{"id": "1", "content": " One\\n\\n two "}\n\n{"doc_id": "2", "content": null}\n')
    got = {r.doc_id: r for r in articles.adapt_raw(articles.read_jsonl(spark, str(tmp_path / "b.jsonl"))).collect()}
    assert got["1"].passages[0].text == "One\n\n two" and got["1"].passages[0].paragraph_indices == [0, 1] and got["1"].passages[0].word_count == 2
    assert got["2"].passages[0].text == "" and got["2"].passages[0].paragraph_indices == [0]
    articles.write_jsonl(articles.read_jsonl(spark, str(tmp_path / "b.jsonl")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_database_url(monkeypatch):
    monkeypatch.delenv("DATABASE_URL", raising=False)
    monkeypatch.setenv("CRAWLER_DATABASE_URL", "c")
    assert articles.database_url() == "c" and articles.database_url("x") == "x"
    monkeypatch.delenv("CRAWLER_DATABASE_URL")
    with pytest.raises(ValueError):
        articles.database_url()


def test_select_source(spark):
    rows = [(1, "s", " A ", None, None, "2025-01-01", "1"), (2, "s", "a", None, None, None, "2"), (3, "s", "a", None, None, None, "1"), (4, "t", "a", None, None, "2025-01-02", "1"), (5, "s", None, "A", None, "2025-01-03", "1")]
    df = spark.createDataFrame(rows, "id int, site_slug string, ingest_category_slug string, category_id string, category_name string, publish_date string, created_at string")
    pick = lambda **k: [r.id for r in selection.select_source(df, **k).collect()]
    assert pick(site="s", category="A ") == [5, 2, 3] and pick(site="s", category="a", order="oldest") == [3, 2, 5]
    assert pick(category=" ", limit=2) == [5, 4]
    with pytest.raises(ValueError):
        pick(limit=0)


def test_orm_rows_and_children(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 1, 2), None, None, "a,b"), (2, None, None, None, "")], "id int, publish_date timestamp, created_at timestamp, updated_at timestamp, tags string")
    got = {r.id: r for r in articles.from_orm(df).collect()}
    assert got[1].tags == ["a", "b"] and got[2].tags == [] and got[1].publish_date == "2025-01-02T00:00:00"
    media = spark.createDataFrame([(1, 2, "p2"), (1, 1, "p1")], "article_id int, sequence_number int, path string")
    kids = {r.id: [c.path for c in r.images] for r in selection.attach_children(df.select("id"), media, "images", ["path"]).collect()}
    assert kids == {1: ["p1", "p2"], 2: []}
    path = media.withColumn("extension", F.lit("jpg")).select(selection.media_path("image").alias("p")).orderBy("p").first().p
    assert path == "1_img_1.jpg"


def test_incremental(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    run = lambda: incremental.run_incremental(incremental.read_new_articles(spark, str(src)), articles.adapt_raw, str(out), str(tmp_path / "cp")).awaitTermination()
    (src / "1.json").write_text('{"id": "1", "content": "a"}\n')
    run()
    (src / "2.json").write_text('{"id": "2", "content": "b"}\n')
    run()
    assert sorted(r.doc_id for r in spark.read.parquet(str(out)).collect()) == ["1", "2"]


def test_stream_dedupe(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"id": str(i), "url": u, "publish_date": "2025-01-01 00:00:00"} for i, u in enumerate("aab")]
    (src / "1.json").write_text("\n".join(map(json.dumps, rows)))
    q = incremental.dedupe_urls(incremental.read_new_articles(spark, str(src))).writeStream.format("memory").queryName("seen_urls").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen_urls").count() == 2


def test_span_documents_round_trip(spark, tmp_path):
    from folio.operators import spans as S
    from folio.operators import verify
    from folio.plans import baseline
    from folio.sources import results

    passages = "array<struct<passage_id:int,text:string,start:int,end:int,word_count:int,paragraph_indices:array<int>>>"
    rows = [("d1", "One", ["Ông Nguyễn Văn An gọi 0912345678. Sinh năm 1980.", "Bà Trần Thị Bình."], None), ("d2", "Two", ["nothing"], None)]
    articles = spark.createDataFrame(rows, f"doc_id string, title string, paragraphs array<string>, passages {passages}")
    found = baseline.run(articles)
    docs = results.span_documents(found.spans, found.stats, articles)
    results.write_documents(docs, str(tmp_path / "spans"))
    back = results.read_span_documents(spark, str(tmp_path / "spans"), lines=True)
    got = {r.doc_id: r for r in back.collect()}
    assert [len(got[d].spans) for d in ("d1", "d2")] == [found.spans.count(), 0] and got["d1"].title == "One"
    assert [s.start for s in got["d1"].spans] == sorted(s.start for s in got["d1"].spans) and got["d1"].stats.detector_hits == {"phone": 1, "dob_year": 1}
    checked = verify.verify(results.spans_of(back), articles)
    assert checked.where("not verified").isEmpty()
    made = {r.doc_id: r for r in results.verified_documents(checked, back).collect()}
    assert made["d1"].verifier_stats.verified_spans == len(made["d1"].spans) == found.spans.count() and made["d2"].verifier_stats.input_spans == 0 and made["d2"].dropped == []
    lost = {r.doc_id: r for r in results.verified_documents(verify.verify(results.spans_of(back), articles.where("doc_id = 'd2'")), back).collect()}
    assert {x.reason for x in lost["d1"].dropped} == {"missing_article"} and lost["d1"].spans == []
    assert S.totals(found.stats).first().docs == 2
    running = verify.by_type(checked, running=True).where("span_type = 'person'").first()
    assert running.verified == running.total and 0 < running.avg_confidence <= 1
    assert spark.range(1).select(S.span_length(F.lit(3), F.lit(8)).alias("a"), S.span_length(F.lit(3), F.lit(1)).alias("b")).first()[:] == (5, 0)


def test_extraction_files(spark, tmp_path):
    import json

    from folio.operators import validation
    from folio.sources import results

    person = {"name": {"text": "An", "start": 0, "end": 2}}
    (tmp_path / "x").mkdir()
    files = {
        "a_p0.json": {"doc_id": "a", "passage_id": 0, "model": "m", "passage": {"text": "An came"}, "response": {"parsed": {"people": [person]}}},
        "b_p1.json": {"passage_id": 1, "passage": {"text": "Bo came"}, "response": {"raw": "```json\n" + json.dumps({"people": [person]}) + "\n```"}},
        "c.json": {"doc_id": "c"},
    }
    for name, data in files.items():
        (tmp_path / "x" / name).write_text(json.dumps(data))
    got = {r.source_file: r for r in validation.validate(results.read_extractions(spark, str(tmp_path / "x"))).collect()}
    assert got["a_p0.json"].issues == [] and got["a_p0.json"].original_model == "m"
    assert got["b_p1.json"].doc_id == "b_p1" and [i.type for i in got["b_p1.json"].issues] == ["hallucination"] and got["b_p1.json"].original_model == "unknown"
    assert got["c.json"].people is None and got["c.json"].issues == [] and got["c.json"].passage_id == 0


def test_absolute_urls_as_urljoin(spark):
    from urllib.parse import urljoin

    links = ["", "x", "./x", "../x", "../../../x", "x/../y/", "..", ".", "/a/./b/../c", "?p=../1", "#f", "g?y/../x", "g#s/../x", "//h/p", "mailto:a@b", "https://o/p/../q", "/", "a/b/.."]
    df = spark.createDataFrame([(h,) for h in [*links, None]], "u string")
    for base in ("https://s.example/b/c/d?p=1", "https://s.example/", "https://s.example/b/"):
        got = {r.u: r.x for r in df.select("u", articles.absolute_url(F.col("u"), base).alias("x")).collect()}
        assert got == {None: None} | {h: urljoin(base, h) for h in links}


def test_article_loading(spark):
    from folio.plans import ingest

    page = "<html><body><h1>T</h1><article><p>one two</p><p>three</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://h/a-10001.htm", page), (2, "http://h/b-2.htm", "<p>x"), (3, None, page), (4, "http://h/c-4.htm", None)], "page_id long, url string, html string")
    loaded = ingest.load_articles(pages, where=html.PLAIN)
    got = {r.doc_id: r for r in loaded.collect()}
    assert set(got) == {"10001", "2", "3", "4"} and got["10001"].full_text == "one two\n\nthree" and got["10001"].html == page
    assert [p.text for p in got["3"].passages] == ["one two\n\nthree"] and got["2"].error and got["4"].error
    assert ingest.outcome(loaded).first()[:] == (2, 2)
    assert {r.doc_id for r in ingest.load_articles(pages, loaded.where("doc_id = '10001'"), html.PLAIN).collect()} == {"2", "3", "4"}
    assert ingest.outcome(ingest.load_articles(pages.where("false"), where=html.PLAIN)).first()[:] == (0, 0)


def test_chat_client():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from folio.operators.extraction import ClientError
    from folio.sources.clients import ChatClient

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            text = " / ".join(m["content"] for m in asked["messages"])
            forms = {"/chat": {"message": {"content": text}}, "/v1": {"choices": [{"message": {"content": text}}]}, "/odd": {"x": 1}}
            self.send_response(200 if self.path in forms else 503)
            self.end_headers()
            self.wfile.write(json.dumps(forms.get(self.path)).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    for path in ("/chat", "/v1"):
        assert ChatClient(at + path, "m", temperature=0).generate(system_prompt="s", user_prompt="u") == "s / u"
    for path, status in (("/none", 503), ("/odd", None)):
        with pytest.raises(ClientError) as e:
            ChatClient(at + path, "m").generate(system_prompt="s", user_prompt="u")
        assert e.value.status_code == status
    server.shutdown()


def test_birth_year_and_missed_names(spark):
    from folio.operators import linking, validation

    assert spark.range(1).select(linking.birth_year(F.lit("2024-05-01").cast("date"), F.lit(30)).alias("y")).first().y == 1994
    found = spark.createDataFrame([("d", 0, "Nguyễn Văn An"), ("d", 0, "Lê B"), ("e", 0, "Lê B")], "doc_id string, passage_id int, name string")
    people = spark.createDataFrame([("d", 0, "ông nguyễn văn an"), ("d", 0, None)], "doc_id string, passage_id int, name string")
    assert sorted((r.doc_id, r.name) for r in validation.missed_names(found, people).collect()) == [("d", "Lê B"), ("e", "Lê B")]
