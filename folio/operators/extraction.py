"""Structured extraction by a language model: prompts, calls and the parsing of answers.

The call is the only opaque stage: ``generate`` runs a client for each partition and
turns transport errors into rows. Everything before and after it is Catalyst.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_json, lenient_json
from ..schemas import PEOPLE, PERSON

MAX_PASSAGE_CHARS = 4000

_SPAN = {"text": "", "start": -1, "end": -1}
#: The fields that a model is asked for.
ANSWER_SHAPE = {
    "people": [
        {
            "name": _SPAN, "aliases": [_SPAN], "age": {"value": None, "start": -1, "end": -1}, "birth_date": {"value": None, "start": -1, "end": -1},
            "address": _SPAN, "occupation": _SPAN, "phones": [_SPAN], "organizations": [_SPAN], "national_id": _SPAN,
            "roles": [{"label": "suspect|victim|official|witness|lawyer|judge|other", "sentence_id": 0}],
            "actions": [
                {
                    "predicate": "arrested|charged|sentenced|confessed|searched|seized|other", "object_description": _SPAN, "items_seized": [_SPAN],
                    "location": _SPAN, "time": _SPAN, "amount": None, "law_article": "", "sentence_years": None, "sentence_id": 0,
                }
            ],
            "provenance": {"doc_id": "", "passage_id": 0}, "confidence": 0.0,
        }
    ]
}
SYSTEM_PROMPT = (
    "You extract legal information about people from Vietnamese news passages. Use only the passage. "
    "Quote every value verbatim with its character range in the passage; use null or an empty list for what is missing. "
    'Answer with JSON in the given shape only, or with {"error": "no_answer"}.'
)
INSTRUCTIONS = (
    "List every person who is named in the passage, once, with nicknames as aliases. Leave out people without a name. "
    "Text, start and end must be verbatim; -1 where absent. Add an action only if its sentence names the person."
)


def truncate(df: DataFrame, column: str = "text", limit: int = MAX_PASSAGE_CHARS) -> DataFrame:
    """Cut a text to ``limit`` code points; adds original_length and truncated."""
    n = F.length(F.coalesce(column, F.lit("")))
    return df.withColumns({"original_length": n, "truncated": n > limit, column: F.substring(F.coalesce(column, F.lit("")), 1, limit)})


def user_prompt(text: Column, **metadata: Column) -> Column:
    """Instructions, a line for each metadata field (null prints as ``None``), the passage, the answer's shape."""
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in metadata.items()]
    return F.concat(F.lit(INSTRUCTIONS + "\nMetadata:\n"), F.concat_ws("\n", *lines), F.lit("\n\nPassage:\n<<<\n"), text, F.lit("\n>>>\n\nShape:\n" + json.dumps(ANSWER_SHAPE, ensure_ascii=False)))


class Client(Protocol):
    """A model backend. Raise ``ClientError`` for a failed call."""

    def generate(self, *, system_prompt: str, user_prompt: str) -> str: ...


class ClientError(Exception):
    """A failed call; ``status_code`` if the transport had one."""

    def __init__(self, message: str, status_code: int | None = None):
        super().__init__(message)
        self.status_code = status_code


def generate(requests: DataFrame, make_client: Callable[[], Client], system_prompt: str = SYSTEM_PROMPT, min_interval_s: float = 0.0) -> DataFrame:
    """Call the model for each row of ``requests`` (with user_prompt): adds raw, request_error, elapsed_seconds.

    One client for each partition; ``min_interval_s`` spaces its calls. A failed call is a row with request_error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        client = make_client()
        for batch in batches:
            raw, errors, took = [], [], []
            for prompt in batch["user_prompt"]:
                began = time.monotonic()
                try:
                    raw.append(client.generate(system_prompt=system_prompt, user_prompt=prompt))
                    errors.append(None)
                except ClientError as e:
                    raw.append(None)
                    errors.append(str(e))
                took.append(time.monotonic() - began)
                if min_interval_s > took[-1]:
                    time.sleep(min_interval_s - took[-1])
            yield batch.assign(raw=raw, request_error=errors, elapsed_seconds=took)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{fields}, raw string, request_error string, elapsed_seconds double")


def parse_status(raw: Column, request_error: Column) -> Column:
    """struct<status, error, json>: ``ok`` for a non-empty JSON answer, ``parse_error`` (with a
    null error for an empty object or list), ``request_error``. The JSON may be fenced or have text around it."""
    text = lenient_json(raw)
    empty = F.coalesce(F.regexp_replace(text, r"\s", "").isin("{}", "[]"), F.lit(False))
    status = F.when(request_error.isNotNull(), "request_error").when(text.isNotNull() & ~empty, "ok").otherwise("parse_error")
    error = F.when(request_error.isNotNull(), request_error).when(text.isNull(), "JSON decode error")
    return F.struct(status.alias("status"), error.alias("error"), text.alias("json"))


def extractions(answers: DataFrame) -> DataFrame:
    """``answers`` (doc_id, passage_id, raw, request_error, ...) with status, error and parsed (the typed people)."""
    parsed = answers.withColumn("__p", parse_status(F.col("raw"), F.col("request_error")))
    return parsed.withColumns({"status": F.col("__p.status"), "error": F.col("__p.error"), "parsed": F.from_json(F.col("__p.json"), PEOPLE)}).drop("__p")


def people(parsed: Column, raw: Column) -> Column:
    """The extracted people: the parsed ones, or if there are none those in the raw answer; never null."""
    none = F.array().cast(f"array<{PERSON}>")
    mine = parsed["people"]
    text = F.when(is_json(raw), raw)
    return F.when(F.size(F.coalesce(mine, none)) > 0, mine).otherwise(F.coalesce(F.from_json(text, PEOPLE)["people"], none))


def missing_outputs(requests: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id", "passage_id")) -> DataFrame:
    """The requests that have no output yet."""
    return requests.join(done.select(*keys), list(keys), "left_anti")


def run_counts(found: DataFrame) -> DataFrame:
    return found.agg(F.countDistinct("doc_id").alias("docs"), F.count("*").alias("passages"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") != "ok").alias("issues"))

