"""Registered queries of the document-analytics operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import blank_to_null, count_tokens, lenient_json
from .operators import allegations, approximate, clusters, consistency, coreference, extraction, facts, linking, ner, review, search, selection, spans, validation, vectors, verdicts, verify
from .operators.detectors import DETECTORS, detect
from .operators.passages import pack_passages, paragraph_passages
from .operators.sentences import explode_sentences
from .plans import baseline, ingest
from .schemas import PERSON
from .sources import articles as source
from .sources import html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return source.spread(df) if name in ("documents", "pages") else df


def as_articles(docs: DataFrame) -> DataFrame:
    """Documents as articles: the lines are the paragraphs."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.split("text", "\n").alias("paragraphs"), F.lit(None).cast("array<struct<passage_id:int,text:string,start:int,end:int,word_count:int,paragraph_indices:array<int>>>").alias("passages"))


def document_spans(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Spans found on whole texts (not by sentence), as rows."""
    chosen = [d for d in DETECTORS if not names or d.name in names]
    found = detect(F.col("text"), F.lit(0), F.lit("0.0"), F.lit(0), chosen)
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode_outer(found).alias("emit_seq", "s")).where("s is not null")
    return rows.select("doc_id", "emit_seq", "s.*")


def _detected(df: DataFrame, *more: str) -> DataFrame:
    return df.select("doc_id", F.col("attributes.detector").alias("detector"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("text").alias("span_text"), F.col("attributes.normalized").alias("normalized"), *more)


@query
def detector_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, then the phone, date and currency detectors, deduplicated and counted by detector."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("passage_id"), "text", F.lit(0).alias("start"))
    chosen = [d for d in DETECTORS if d.name in ("phone", "dob_full", "currency")]
    rows = explode_sentences(docs).withColumn("passage_ord", F.lit(0))
    kept = spans.dedupe(baseline.emit(rows, chosen, ner="none"))
    return kept.groupBy(F.col("attributes.detector").alias("detector")).agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"))


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("passage_id"), "text", F.lit(0).alias("start"))
    return explode_sentences(docs).select("doc_id", "sentence_id", F.col("base").alias("sentence_start"), "sentence")


@query
def spans_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(document_spans(spark, sf_dir, "phone"), "attributes.e164", "confidence")


@query
def spans_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(document_spans(spark, sf_dir, "dob_full"), "attributes.year", "attributes.month", "attributes.day")


@query
def spans_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(document_spans(spark, sf_dir, "currency"), "attributes.amount_vnd", "attributes.unit")


@query
def spans_law_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law references, birth years and identity numbers in a sentence made for each document, as the test tables have none."""
    i = F.col("doc_id")
    parts = ["Theo Điều ", (i % 300).cast("string"), " Bộ luật Hình sự ", (1999 + i % 20).cast("string"), ". Ông A sinh năm ", (1940 + i % 60).cast("string"), ", CMND số ", (i + 100_000_000).cast("string"), ", x."]
    made = F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    found = detect(made, F.lit(0), F.lit("0.0"), F.lit(0), [d for d in DETECTORS if d.name in ("law_article", "dob_year", "national_id")])
    rows = table(spark, sf_dir, "documents").select(i.cast("string").alias("doc_id"), F.explode_outer(found).alias("s")).where("s is not null").select("doc_id", "s.*")
    return _detected(rows, "attributes.code")


@query
def baseline_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detection plan: passages, sentences, all detectors and names, deduplicated."""
    found = baseline.run(as_articles(table(spark, sf_dir, "documents"))).spans
    return found.select("doc_id", "span_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("text").alias("span_text"), "sentence_id", "source", "confidence")


@query
def baseline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: spans before and after the dedupe, sentences, passages."""
    return baseline.run(as_articles(table(spark, sf_dir, "documents"))).stats.withColumn("detector_hits", F.to_json("detector_hits"))


@query
def detector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.detector_hits(spans.dedupe(document_spans(spark, sf_dir)))


@query
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and name tokens of every document, counted in its row."""
    tokens = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0)).alias("t")).where(F.size("t") > 0)
    names = F.size(F.filter("t", ner.is_name_token))
    # The last token starts where it and the white space behind it begin.
    last = F.length("text") - F.length(F.regexp_extract("text", r"(?U)(?<!\S)\S++\s*+$", 0))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), names.cast("long").alias("n_names"), last.cast("long").alias("last_start"))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ner.document_names(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return found.select("doc_id", F.concat(F.lit("0."), F.col("ord").cast("string")).alias("sentence_id"), F.col("text").alias("name"), F.col("start").alias("name_start"), F.col("end").alias("name_end"), "score", linking.name_key(F.col("text")).alias("name_key"))


@query
def person_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mentions(spark, sf_dir).select("doc_id", "sentence_id", "name", "name_start", "name_end", "score")


@query
def people_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.people_index(mentions(spark, sf_dir))


@query
def co_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.co_mentions(mentions(spark, sf_dir)).select("a", "b", "n", F.array_join("evidence", " ").alias("evidence"))


@query
def mention_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate links between the people named in the documents (distinct keys of a block)."""
    return linking.candidate_links(mentions(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query
def people_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people named in the documents, nearly equal names joined to clusters."""
    return clusters.people_clusters(mentions(spark, sf_dir).drop("name_key"), accept=0.85)


@query
def name_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same links between the names of parts."""
    people = table(spark, sf_dir, "part").select(linking.name_key(F.col("p_name")).alias("name_key"))
    return linking.candidate_links(people).withColumn("score", F.round("score", 6))


@query
def span_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans emitted twice, the second time with another confidence: one of each key stays."""
    once = document_spans(spark, sf_dir, "phone", "dob_full", "currency").withColumn("round", F.lit(0))
    again = once.withColumn("round", F.lit(1)).withColumn("confidence", F.when(F.col("start") % 2 == 0, 0.99).otherwise(F.col("confidence")))
    both = once.unionByName(again).withColumn("emit_seq", F.col("round") * 1_000_000 + F.col("emit_seq"))
    kept = spans.dedupe(both)
    return kept.select("doc_id", "span_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("text").alias("span_text"), "confidence", "round")


def corrupted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of which some are moved, cut or out of range, by start position."""
    found = document_spans(spark, sf_dir, "phone", "dob_full", "currency")
    m = F.pmod("start", F.lit(5))
    return found.withColumns({"end": F.when(m == 1, F.lit(10_000_000)).when(m == 2, F.col("start")).otherwise(F.col("end")), "text": F.when(m == 3, F.concat(F.lit("x"), F.col("text"))).otherwise(F.col("text"))})


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("full_text"))
    return verify.verify(corrupted(spark, sf_dir), docs)


@query
def verify_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("doc_id", "span_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "verified", "reason", "birth_year", "confidence", F.size("derivations").alias("n_derivations"))


@query
def verify_own_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection plan's own spans are all found verbatim."""
    docs = table(spark, sf_dir, "documents")
    lines = as_articles(docs)
    found = baseline.run(lines).spans
    return verify.totals(verify.verify(found, lines))


@query
def verify_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.document_stats(checked(spark, sf_dir))


@query
def verify_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.by_type(checked(spark, sf_dir))


@query
def verify_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.failure_reasons(checked(spark, sf_dir))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(pack_passages(F.split("text", "\n"), 40, 120)).alias("p"))


@query
def explain_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the texts of dropped spans nearly stand in their documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("full_text"))
    found = approximate.explain_drops(checked(spark, sf_dir), docs)
    return found.select("doc_id", "span_type", F.col("text").alias("span_text"), F.col("start").alias("span_start"), F.col("end").alias("span_end"), "reason", "found_start", "found_end", "cost", "explanation")


@query
def backend_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People found by a registered tagging model, as spans of the documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("passage_id"), "text", F.lit(0).alias("start"))
    found = baseline.emit(explode_sentences(docs).withColumn("passage_ord", F.lit(0)), [], ner="capitals")
    return found.select("doc_id", "sentence_id", "span_type", F.col("start").alias("span_start"), F.col("end").alias("span_end"), F.col("text").alias("span_text"), "confidence", "attributes.backend")


@query
def allegation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as statements about three allegations of each user, merged."""
    status = F.create_map(*(F.lit(x) for kv in (("view", "alleged"), ("click", "Charged"), ("purchase", "convicted"), ("error", "acquitted")) for x in kv))
    said = table(spark, sf_dir, "events").select(F.col("user_id").alias("person"), (F.col("event_id") % 3).alias("allegation"), F.try_element_at(status, F.col("event_type")).alias("status"), F.col("ts").alias("at"))
    return allegations.present(allegations.merge(said)).select(*(c for c in allegations.STATE), "status", "as_fact")


def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The people found in single sentences, aligned with those found in whole lines, where names beside a full stop fuse."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    runs = (ner.document_names(docs, lines).withColumns({"span_type": F.lit("person"), "confidence": F.col("score")}) for lines in (False, True))
    return consistency.compare_runs(*runs)


@query
def run_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_runs(spark, sf_dir).select("doc_id", "left_span_type", "left_start", "left_end", "right_span_type", "right_start", "right_end", "agreement")


@query
def run_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistency.agreement(two_runs(spark, sf_dir))


@query
def coreference_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and pronouns of every document with the person they mean."""
    found = coreference.coreference(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("start").alias("mention_start"), F.col("end").alias("mention_end"), F.col("text").alias("mention"), "kind", "sentence", "person", "person_name")


def statements(spark: SparkSession, sf_dir: str, value: str) -> DataFrame:
    """A column of orders as dated statements about their customer; days since 1970."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("at"), F.col(value).alias("value"), F.col("o_orderkey").alias("seq"))


@query
def fact_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of equal order priority of each customer; what isn't said again within 400 days has expired."""
    return facts.periods(statements(spark, sf_dir, "o_orderpriority"), max_age=400, bucket=365)


@query
def fact_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The priority of each customer 45 days after each of their orders."""
    known = facts.periods(statements(spark, sf_dir, "o_orderpriority"), max_age=400, bucket=365)
    reads = statements(spark, sf_dir, "o_orderstatus").select("seq", "key", (F.col("at") + 45).alias("at"))
    return facts.as_of(known, reads).withColumnRenamed("at", "asked_day")


@query
def fact_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of priority and of status of the same customer at the same time."""
    return facts.overlaps(facts.periods(statements(spark, sf_dir, "o_orderpriority"), max_age=400, bucket=365), facts.periods(statements(spark, sf_dir, "o_orderstatus"), bucket=365))


@query
def passage_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines packed into passages of 40 to 120 tokens."""
    rows = packed(spark, sf_dir)
    return rows.select("doc_id", "p.passage_id", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"), "p.word_count", F.md5("p.text").alias("text_md5"), F.size("p.paragraph_indices").alias("n_paragraphs"))


@query
def passage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(paragraph_passages(F.split("text", "\n"))).alias("p"))
    return rows.select("doc_id", "p.passage_id", F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"), "p.word_count", F.col("p.text").alias("p_text"))


@query
def passage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: the five best passages of the documents for each benchmark item, by BM25."""
    index = search.build_index(packed(spark, sf_dir).select("doc_id", "p.passage_id", "p.text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return search.search(index, items, 5).withColumnRenamed("query_id", "item_id")


@query
def passage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that are among the ten best of a benchmark item; all others are gated out."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    kept = search.gate(packed(spark, sf_dir).select("doc_id", "p.passage_id", "p.text", "p.word_count"), items, 10)
    return kept.select("doc_id", "passage_id", "word_count", "n_queries", "best_score")


@query
def vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors, other than itself, of every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = vectors.build_index(rows)
    return vectors.search(index, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10, others_only=True)


@query
def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", count_tokens(F.col("text")).alias("n_tokens"))


def _as_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their customers in the form of the article source."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "c_custkey"})
    customer = table(spark, sf_dir, "customer")
    return orders.join(customer, "c_custkey").select(
        "o_orderkey",
        F.lower("c_mktsegment").alias("site_slug"),
        F.col("o_orderpriority").alias("ingest_category_slug"),
        F.col("o_orderstatus").alias("category_id"),
        F.col("c_mktsegment").alias("category_name"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("publish_date"),
        F.col("o_totalprice").alias("created_at"),
    )


@query
def source_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: the newest rows of a site and category."""
    return selection.select_source(_as_source(spark, sf_dir), site="building", category=" Building ", order="newest", limit=25, ties=["o_orderkey"])


@query
def source_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: the oldest rows, those without a date first."""
    return selection.select_source(_as_source(spark, sf_dir), category="o", order="oldest", limit=25, ties=["o_orderkey"])


@query
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _as_source(spark, sf_dir).where(selection.in_category("1-urgent") | selection.matches_keyword("machin", "category_name"))
    return found.groupBy("site_slug").agg(F.count("*").alias("n"))


@query
def documents_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.members(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars")


@query
def documents_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.not_done(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "n_chars")


@query
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id"))
    return selection.missing_ids(asked, table(spark, sf_dir, "documents"), "doc_id")


@query
def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with their ordered child rows; those without any stay."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").withColumnsRenamed({"l_orderkey": "article_id", "l_linenumber": "sequence_number"})
    joined = selection.attach_children(orders.select("id"), lines, "lines", ["l_partkey"])
    return joined.select("id", F.size("lines").alias("n_lines"), F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["sequence_number"].cast("string"), x["l_partkey"].cast("string"))), " ").alias("children"))


@query
def url_document_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    made = F.concat(F.lit("https://x.example/a-"), (F.col("page_id") + 100000).cast("string"), F.lit(".htm"))
    return pages.select("page_id", source.document_id(F.col("url")).alias("from_url"), source.document_id(made).alias("from_number"), source.absolute_url(F.regexp_replace("url", "^https?://[^/]+", ""), "https://site.example/").alias("absolute"),
                        source.absolute_url(F.concat(F.lit("../"), F.col("page_id").cast("string"), F.lit("/./x.htm?up=../y")), "https://site.example/a/b/c").alias("climbed"))


@query
def article_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parsed, packed into passages and counted."""
    return ingest.outcome(ingest.load_articles(table(spark, sf_dir, "pages"), where=html.PLAIN))


@query
def first_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each host."""
    hosts = table(spark, sf_dir, "pages").withColumn("host", F.regexp_extract("url", "://([^/?#]*)", 1))
    return selection.first_wins(hosts, ["host"], ["page_id"]).select("host", "page_id", "url")


@query
def timeline_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k report: pages as timeline entries (two pages of the timeline repeat each other's urls)."""
    pages = table(spark, sf_dir, "pages")
    url = F.regexp_replace("url", "[?#].*$", "")
    entries = pages.select((F.col("page_id") % 5 + 1).cast("int").alias("page"), F.col("page_id").cast("int").alias("position"), "url", F.regexp_replace(url, "/[^/]*$", "").alias("canonical_url"), url.alias("category_url"), F.lit("").alias("category_name"))
    return selection.collect_timeline(entries, limit=50, max_pages=4, keyword="EXAMPLE.COM").select("page", "position", "url", "canonical_url")


@query
def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of crawled pages: title, paragraphs and passages."""
    found = html.parse_articles(table(spark, sf_dir, "pages"), html.PLAIN)
    return found.select("page_id", "title", "error", F.size("paragraphs").alias("n_paragraphs"), F.md5(F.array_join("paragraphs", "\n\n")).alias("text_md5"), F.size(pack_passages(F.col("paragraphs"), 30, 100)).alias("n_passages"))


@query
def prompt_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as passages, cut at 80 code points, and their prompts' metadata."""
    turns = extraction.truncate(table(spark, sf_dir, "conversations"), "text", 80)
    head = F.concat_ws("\n", F.concat(F.lit("doc_id: "), F.col("conv_id").cast("string")), F.concat(F.lit("title: "), F.coalesce(F.nullif("role", F.lit("system")), F.lit("None"))))
    prompt = extraction.user_prompt(F.col("text"), doc_id=F.col("conv_id"), title=F.nullif("role", F.lit("system")))
    return turns.select("conv_id", "turn", F.col("text").alias("passage"), "original_length", "truncated", F.substr(prompt, F.instr(prompt, "Metadata:\n") + 10, F.length(head)).alias("metadata"))


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties in the forms of a model's answer: plain, fenced, with text around, broken, empty."""
    m = F.pmod("event_id", F.lit(6))
    raw = F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(m == 2, F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" done."))).when(m == 3, F.lit("not json")).when(m == 4, F.lit("{}")).otherwise(F.lit(None))
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"), F.when(m == 5, F.lit("timeout")).alias("request_error"), "props")


@query
def answer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = extraction.parse_status(F.col("raw"), F.col("request_error"))
    return wrapped(spark, sf_dir).select("event_id", status.alias("s")).select("event_id", "s.status", "s.error", F.get_json_object("s.json", "$.k").cast("int").alias("k"))


@query
def answer_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = extraction.parse_status(F.col("raw"), F.col("request_error"))
    return wrapped(spark, sf_dir).select(status["status"].alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extraction for each document, right or wrong in ways that depend on doc_id: the
    name is the first word at its place, at a wrong one, out of range, or invented."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    word = F.regexp_extract("text", r"^[^ \n]+", 0)
    m = F.pmod("doc_id", F.lit(6))
    start = F.when(m == 1, 1).when(m == 2, 10_000_000).otherwise(0)
    name = F.struct(F.when(m == 3, F.lit("Zz Invented")).otherwise(word).alias("text"), start.alias("start"), (start + F.length(word)).alias("end"))
    role = F.when(m == 4, "driver").otherwise("suspect")
    action = F.struct(F.when(m == 5, "fled").otherwise("arrested").alias("predicate"), F.when(m == 0, "Điều 999").alias("law_article"), (F.col("doc_id") * 2_000_000_000).alias("amount_vnd"))
    person = F.to_json(F.struct(name.alias("name"), F.array(F.struct(role.alias("label"))).alias("roles"), F.array(action).alias("actions")))
    people = F.array(F.from_json(person, PERSON))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("passage_id"), F.col("text").alias("passage_text"), people.alias("people"), F.when(m == 1, F.array(word, F.lit("Nobody Here"))).alias("missing_people"), F.when(m == 2, F.lit("timeout")).alias("check_error"))


@query
def validation_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = validation.validate(extracted(spark, sf_dir)).select("doc_id", F.posexplode("issues").alias("ord", "i"))
    return rows.select("doc_id", "ord", "i.type", "i.severity", "i.field", "i.actual", "i.text_snippet")


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.report_counts(validation.validate(extracted(spark, sf_dir)))
    return found.withColumns({"original_model": F.concat(F.lit("model-"), F.col("doc_id")), "source_file": F.lpad("doc_id", 12, "0")})


@query
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _validated(spark, sf_dir).select("doc_id", "total_people_extracted", "total_issues_found", *validation.COUNTERS, *validation.TYPE_COUNTERS)


@query
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.batch_summary(_validated(spark, sf_dir))


def verdict_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers made from the labels: some unreadable, some with issues or missing people."""
    q, t, m = F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)), F.pmod("doc_id", F.lit(5))
    verdict = F.when(q == 0, "Unsupported").when(m == 1, "unsure").when(m == 2, "maybe").otherwise("SUPPORTED")
    issue = F.struct(F.when(m == 3, "strange").otherwise("conflict").alias("type"), F.when(t == 1, F.when(m == 0, "critical").when(m == 3, F.lit(None)).otherwise("warning")).alias("severity"), F.lit("d").alias("description"))
    issues = F.when(t == 1, F.array(issue)).otherwise(F.array().cast("array<struct<type:string,severity:string,description:string>>"))
    missing = F.when((m == 4) & (t == 0), F.array(F.struct(F.lit("A B").alias("name")), F.struct(F.lit("").alias("name"))))
    answer = F.to_json(F.struct(verdict.alias("verdict"), issues.alias("issues"), missing.alias("missing_people"), F.when(F.col("doc_id") % 11 == 0, F.lit(False)).alias("usable")))
    raw = F.when(F.col("doc_id") % 13 == 0, "not json").when(F.col("doc_id") % 2 == 0, F.concat(F.lit("```json\n"), answer, F.lit("\n```"))).otherwise(answer)
    return verdicts.reports(table(spark, sf_dir, "labels").select("doc_id", raw.alias("raw")))


@query
def verdict_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_reports(spark, sf_dir).select("doc_id", "verdict", "usable", "issue_count", "missing_people_count", F.get("issues", F.lit(0))["type"].alias("first_type"))


@query
def verdict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.batch_summary(verdict_reports(spark, sf_dir))


@query
def review_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = verdict_reports(spark, sf_dir)
    return found.select("doc_id", review.issue_text(F.col("verdict"), F.col("issues"), F.col("missing_people")).alias("report"))


@query
def manual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks from a log, the last one counts; ``skip`` changes nothing."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("passage_id"), F.col("quality"), F.col("toxic"))
    first = labels.select("doc_id", "passage_id", F.when(F.col("quality") == 1, "valid").otherwise("invalid").alias("status"), F.lit(1).alias("ts"))
    second = labels.select("doc_id", "passage_id", F.when(F.col("toxic") == 1, F.when(F.col("doc_id") % 2 == 0, "invalid").otherwise("unset")).otherwise("skip").alias("status"), F.lit(2).alias("ts"))
    marks = review.latest_marks(first.unionByName(second))
    reports = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("passage_id"))
    return review.manual_summary(reports.join(marks, ["doc_id", "passage_id"], "left"))


@query
def lenient_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text found in each answer; blank where there is none."""
    return wrapped(spark, sf_dir).select("event_id", F.coalesce(blank_to_null(lenient_json(F.col("raw"))), F.lit("")).alias("found"))
