"""Explicit schemas and closed vocabularies of the logical tables."""

from __future__ import annotations

#: The closed vocabularies.
SPAN_TYPES = ["person", "organization", "location", "phone_number", "national_id", "date_of_birth", "currency_amount", "law_reference", "other"]
SPAN_SOURCES = ["regex", "ner", "llm", "heuristic"]
ROLES = ["suspect", "victim", "official", "witness", "lawyer", "judge", "other"]
PREDICATES = ["arrested", "charged", "sentenced", "confessed", "searched", "seized", "other"]
VERDICTS = ["supported", "unsure", "unsupported"]
VERDICT_ISSUES = ["hallucination", "missing_info", "conflict", "parsing_error", "other"]
VERDICT_SEVERITIES = ["critical", "warning", "info"]

PASSAGE = "struct<passage_id:int,text:string,start:int,end:int,word_count:int,paragraph_indices:array<int>>"
ARTICLE = (
    "doc_id string, url string, canonical_url string, title string, summary string, author string, category string, "
    f"published_at string, paragraphs array<string>, passages array<{PASSAGE}>"
)
RAW_ARTICLE = (
    "id string, doc_id string, site_slug string, title string, url string, category_id string, category_name string, ingest_category_slug string, "
    "publish_date string, published_at string, created_at string, updated_at string, tags array<string>, content string, description string"
)
TIMELINE = "title string, url string, canonical_url string, category_name string, category_url string, image_url string, data_id string, page int, position int"

#: The closed set of span attributes as one sparse struct; a field that a span lacks is null.
ATTRIBUTES = {
    "detector": "string",
    "normalized": "string",
    "raw": "string",
    "e164": "string",
    "length": "int",
    "precision": "string",
    "year": "int",
    "month": "int",
    "day": "int",
    "amount_vnd": "bigint",
    "unit": "string",
    "code": "string",
    "backend": "string",
}
ATTRIBUTES_TYPE = "struct<" + ",".join(f"{k}:{v}" for k, v in ATTRIBUTES.items()) + ">"
SPAN = f"struct<span_type:string,text:string,start:int,end:int,sentence_id:string,source:string,passage_id:int,confidence:double,attributes:{ATTRIBUTES_TYPE}>"

_SPAN_REF = "struct<text:string,start:int,end:int>"
ACTION = (
    f"struct<predicate:string,object_description:{_SPAN_REF},items_seized:array<{_SPAN_REF}>,location:{_SPAN_REF},time:{_SPAN_REF},"
    "amount:double,amount_vnd:bigint,law_article:string,sentence_years:double,sentence_id:int>"
)
PERSON = (
    f"struct<name:{_SPAN_REF},aliases:array<{_SPAN_REF}>,age:struct<value:int,start:int,end:int>,birth_date:struct<value:string,start:int,end:int>,"
    f"birth_place:{_SPAN_REF},address:{_SPAN_REF},occupation:{_SPAN_REF},phones:array<{_SPAN_REF}>,organizations:array<{_SPAN_REF}>,national_id:{_SPAN_REF},"
    f"roles:array<struct<label:string,sentence_id:int>>,actions:array<{ACTION}>,provenance:struct<doc_id:string,passage_id:int>,confidence:double>"
)
PEOPLE = f"struct<people:array<{PERSON}>,error:string>"
VERDICT = (
    "struct<verdict:string,issues:array<struct<type:string,severity:string,person_name:string,field:string,description:string,evidence:string>>,"
    "missing_people:array<struct<name:string,snippet:string>>,usable:boolean,confidence:string,notes:string>"
)
ISSUE = "struct<type:string,severity:string,person_name:string,field:string,expected:string,actual:string,description:string,text_snippet:string>"
