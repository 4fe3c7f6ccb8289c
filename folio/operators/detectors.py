"""Typed span detectors: a pattern and a Column expression that normalises a match.

Detectors are data, so a caller can pass others; they run as Catalyst expressions.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import find_all, strip
from ..schemas import ATTRIBUTES, SPAN

FLAGS = "(?iuU)"  # case-insensitive, and white space and digits as Unicode has them


def attributes(**given: Column) -> Column:
    """The sparse attribute struct with the given fields."""
    return F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in ATTRIBUTES.items()))


@dataclass(frozen=True)
class Detector:
    """``normalise`` maps a match to a dict of attributes with ``normalized``; a null ``normalized`` drops the match."""

    name: str
    span_type: str
    pattern: str
    confidence: float
    normalise: Callable[[Column], dict[str, Column]]

    def spans(self, text: Column, base: Column, sentence_id: Column, passage_id: Column) -> Column:
        def one(m: Column) -> Column:
            start = base + m["start"]
            fields = attributes(detector=F.lit(self.name), raw=m["text"], **self.normalise(m["text"]))
            return F.struct(
                F.lit(self.span_type).alias("span_type"),
                strip(m["text"]).alias("text"),
                start.alias("start"),
                (start + F.length(m["text"])).alias("end"),
                sentence_id.alias("sentence_id"),
                F.lit("regex").alias("source"),
                passage_id.alias("passage_id"),
                F.lit(self.confidence).alias("confidence"),
                fields.alias("attributes"),
            )

        found = F.transform(find_all(text, self.pattern), one)
        return F.filter(found, lambda s: s["attributes"]["normalized"].isNotNull()).cast(f"array<{SPAN}>")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\D", "")


#: All digits that are not ASCII, and the ASCII digits they stand for.
_OTHER_DIGITS = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_AS_ASCII = "".join(str(unicodedata.digit(c)) for c in _OTHER_DIGITS)


def _number(x: Column) -> Column:
    """The whole number that a run of digits of any script writes, null where there is none."""
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.translate(x, _OTHER_DIGITS, _AS_ASCII)).otherwise(x).try_cast("int")


def _phone(m: Column) -> dict[str, Column]:
    raw = _digits(m)
    rest = F.substring(raw, 3, 100)
    national = F.when(raw.startswith("84"), F.when(rest.startswith("0"), rest).otherwise(F.concat(F.lit("0"), rest))).otherwise(raw)
    ok = (F.length(raw) >= 9) & F.length(national).isin(10, 11)
    return {"normalized": F.when(ok, national), "e164": F.concat(F.lit("+84"), F.ltrim(national, F.lit("0")))}


def _national_id(m: Column) -> dict[str, Column]:
    digits = _digits(F.regexp_extract(m, r"(?U)(\d[\d\s.]{8,})$", 1))
    return {"normalized": F.when(F.length(digits).isin(9, 12), digits), "length": F.length(digits)}


def _full_date(m: Column) -> dict[str, Column]:
    # No calendar check: 31 February passes, so the value stays a string.
    part = [_number(F.regexp_extract(m, r"(?U)(\d{1,2})[./-](\d{1,2})[./-](\d{2,4})$", g)) for g in (1, 2, 3)]
    day, month = part[0], part[1]
    year = F.when(part[2] >= 1900, part[2]).when(part[2] >= 30, part[2] + 1900).otherwise(part[2] + 2000)
    ok = day.between(1, 31) & month.between(1, 12)
    return {"normalized": F.when(ok, F.format_string("%04d-%02d-%02d", year, month, day)), "precision": F.lit("date"), "year": year, "month": month, "day": day}


def _birth_year(m: Column) -> dict[str, Column]:
    year = _number(F.regexp_extract(m, r"(?U)(\d{4})$", 1))
    return {"normalized": year.cast("string"), "precision": F.lit("year"), "year": year}


#: Multiples of a dong by unit.
MULTIPLES = {
    "tỷ": 1_000_000_000, "ty": 1_000_000_000, "triệu": 1_000_000, "trieu": 1_000_000, "nghìn": 1_000, "ngàn": 1_000, "ngan": 1_000,
    "đồng": 1, "dong": 1, "đ": 1, "d": 1, "vnd": 1,
}
_UNITS = "|".join(["tỷ", "ty", "triệu", "trieu", "nghìn", "ngàn", "ngan", "đồng", "dong", "đ", "d", "vnd"])


def _currency(m: Column) -> dict[str, Column]:
    unit = F.lower(F.regexp_extract(m, rf"{FLAGS}({_UNITS})$", 1))
    amount = strip(F.regexp_replace(m, rf"{FLAGS}({_UNITS})$", ""))
    plain = F.replace(F.replace(F.replace(amount, F.lit("."), F.lit("")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    number = plain.try_cast("double")
    scale = F.lit(1)
    for name, value in MULTIPLES.items():
        scale = F.when(unit == name, F.lit(value)).otherwise(scale)
    # A long run of digits, as in a digest, can pass 64 bits: then only the text has the amount. One that no double holds is no number.
    dong = F.bround(number * scale)
    amount = dong.try_cast("long")
    digits = F.when(dong < float("inf"), F.format_string("%.0f", dong))
    return {"normalized": F.coalesce(amount.cast("string"), digits), "amount_vnd": amount, "unit": F.coalesce(F.nullif(unit, F.lit("")), F.lit("đồng"))}


_CODE = r"(?:Bộ\s+luật\s+Hình\s+sự)|BLHS"


def _law(m: Column) -> dict[str, Column]:
    article = F.regexp_extract(m, rf"{FLAGS}^Điều\s+(\d{{1,3}}[A-Za-z]?)", 1)
    code = strip(F.regexp_extract(m, rf"{FLAGS}\s((?:{_CODE}))", 1))
    year = F.regexp_extract(m, rf"{FLAGS}(?:{_CODE})\s+(\d{{4}})$", 1)
    return {"normalized": F.nullif(article, F.lit("")), "code": F.nullif(code, F.lit("")), "year": _number(year)}


#: Fixed patterns, in the order in which their spans are emitted. The date's prefix has the word
#: in composed and in decomposed form.
DETECTORS: tuple[Detector, ...] = (
    Detector("phone", "phone_number", r"(?U)(?:(?:\+?84)|0)(?:[\s\-.]?\d){8,10}", 0.95, _phone),
    Detector("national_id", "national_id", FLAGS + r"(?:(?:CMND|CCCD)(?:\s+s(?:ố|o))?|s(?:ố|o)\s+(?:CMND|CCCD))[:\s-]*\d[\d\s\.]{8,}", 0.9, _national_id),
    Detector("dob_full", "date_of_birth", FLAGS + "(?:(?:sinh\\s+(?:ngày|nga\u0300y)\\s*)|(?:ngày\\s+sinh\\s*)|)\\d{1,2}[./-]\\d{1,2}[./-]\\d{2,4}", 0.85, _full_date),
    Detector("dob_year", "date_of_birth", FLAGS + r"(?:sinh\s+năm|sinh|sn)\s*(?:19\d{2}|20\d{2})", 0.8, _birth_year),
    Detector("currency", "currency_amount", FLAGS + rf"(?:\d{{1,3}}(?:[\.\s]\d{{3}})*(?:,\d+)?|\d+(?:,\d+)?)\s*(?:{_UNITS})", 0.8, _currency),
    Detector("law_article", "law_reference", FLAGS + rf"Điều\s+\d{{1,3}}[A-Za-z]?(?:\s+(?:{_CODE})(?:\s+\d{{4}})?)?", 0.9, _law),
)


def detect(text: Column, base: Column, sentence_id: Column, passage_id: Column, detectors: Sequence[Detector] = DETECTORS) -> Column:
    """Spans of all detectors, in the order of detectors and matches. Overlaps between detectors all stay."""
    return F.concat(*(d.spans(text, base, sentence_id, passage_id) for d in detectors)) if detectors else F.array().cast(f"array<{SPAN}>")
