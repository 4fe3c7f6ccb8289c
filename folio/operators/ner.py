"""Rule-based person names and a decoder for BIO-tagged tokens, as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import find_all, let, slice_text, squeeze
from ..schemas import SPAN
from .detectors import attributes

#: Fixed values. Only one token before a name is looked at, so the longer ones never match.
HONORIFICS = ["ông", "bà", "anh", "chị", "cô", "chú", "thiếu tá", "trung tá", "thượng tá", "đại tá", "thiếu tướng", "thượng tướng", "trung tướng", "luật sư", "thẩm phán"]
#: Tokens up to which a sentence's places are found for each run on its own.
_FEW = 200
#: What is stripped from a token.
_EDGE = ".,:;!?()[]{}\"'“”‘’"
LABELS = {"PER": "person", "ORG": "organization", "LOC": "location"}
_ENTITY = "array<struct<label:string,text:string,start:int,end:int,score:double>>"


def _cleaned(token: Column) -> Column:
    return F.btrim(token, F.lit(_EDGE))


def is_name_token(token: Column) -> Column:
    """Starts with a capital, isn't all capitals, has no digit."""
    c = _cleaned(token)
    shout = (F.upper(c) == c) & (F.lower(c) != c)
    # The first test is cheap and fails for most tokens.
    return token.rlike(r"[\p{Lu}\p{Lt}]") & c.rlike(r"^[\p{Lu}\p{Lt}]") & ~c.rlike(r"\p{Nd}") & ~shout


def person_names(sentence: Column) -> Column:
    """Maximal runs of name tokens as entities; a one-word honorific before a run joins it.

    Score: 0.55, 0.1 more with an honorific, 0.02 for each token beyond two, at most 0.85.
    A run of one token of up to two characters is dropped."""
    run = "array<struct<n:int,clean:string,first:int,last:int>>"

    def add(runs: Column, t: Column) -> Column:
        last = F.element_at(runs, -1)
        longer = F.struct((last["n"] + 1).alias("n"), last["clean"].alias("clean"), last["first"].alias("first"), t["i"].alias("last"))
        new = F.struct(F.lit(1).alias("n"), _cleaned(t["text"]).alias("clean"), t["i"].alias("first"), t["i"].alias("last"))
        goes_on = (F.size(runs) > 0) & F.coalesce(last["last"] + 1 == t["i"], F.lit(False))
        return F.when(goes_on, F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(runs, F.array(new))).cast(run)

    def of_tokens(found: Column) -> Column:
        tokens = found["tokens"]

        def place(i: Column) -> Column:
            before = F.when(i > 0, F.length(F.array_join(F.slice(tokens, F.lit(1), i), " ")) + 1).otherwise(0)
            return F.when(found["starts"].isNull(), before).otherwise(F.get(found["starts"], i))

        def finish(r: Column) -> Column:
            titled = F.coalesce(F.lower(_cleaned(F.get(tokens, r["first"] - 1))).isin(HONORIFICS), F.lit(False))
            return let(F.struct(titled.alias("titled"), place(r["first"] - titled.cast("int")).alias("start"), (place(r["last"]) + F.length(F.get(tokens, r["last"]))).alias("end")), lambda at: entity(r, at))

        def entity(r: Column, at: Column) -> Column:
            n = r["n"] + at["titled"].cast("int")
            score = F.bround(F.least(F.lit(0.55) + F.when(at["titled"], 0.1).otherwise(0.0) + F.lit(0.02) * (n - 2), F.lit(0.85)), 3)
            return F.struct(F.lit("person").alias("label"), slice_text(sentence, at["start"], at["end"]).alias("text"), at["start"].alias("start"), at["end"].alias("end"), score.alias("score"))

        # Only name tokens, a few of each sentence, reach the fold, and only runs need places.
        named = F.filter(F.transform(tokens, lambda t, i: F.struct(i.alias("i"), t.alias("text"))), lambda t: is_name_token(t["text"]))
        runs = F.aggregate(named, F.array().cast(run), add)
        return F.transform(F.filter(runs, lambda r: (r["n"] > 1) | (F.length(r["clean"]) > 2)), finish).cast(_ENTITY)

    def placed(tokens: Column) -> Column:
        # Between single spaces a token's place follows from the tokens before it; a sentence of other gaps or of many tokens gets all places at once.
        plain = ~sentence.rlike(r"(?U)[\s&&[^ ]]|  |^ | $") & (F.size(tokens) <= _FEW)
        starts = F.when(plain, F.lit(None).cast("array<int>")).otherwise(F.transform(find_all(sentence, r"(?U)\S+"), lambda t: t["start"]))
        return let(F.struct(tokens.alias("tokens"), starts.alias("starts")), of_tokens)

    return let(F.regexp_extract_all(sentence, F.lit(r"(?U)\S+"), F.lit(0)), placed)


#: White space as the patterns above have it (``str.split`` knows a few more).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Tokens that may be name tokens: behind stripped marks comes a capital, or no ASCII at all.
_CANDIDATE = re.compile(rf"(?<![^{_SPACE}])[{re.escape(_EDGE)}]*[^\x00-@\[-\x7f{_SPACE}][^{_SPACE}]*")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?…]*")


def _is_name(token: str) -> str:
    """The token without marks if it is a name token, else an empty text."""
    c = token.strip(_EDGE)
    if not c or unicodedata.category(c[0]) not in ("Lu", "Lt") or (c.upper() == c and c.lower() != c):
        return ""
    return "" if any(unicodedata.category(x) == "Nd" for x in c) else c


#: The score of a run of up to 20 tokens, without and with an honorific; beyond that it grows no more.
_SCORES = [[float(Decimal(repr(min(0.55 + title + 0.02 * (n - 2), 0.85))).quantize(Decimal("0.001"), ROUND_HALF_EVEN)) for n in range(21)] for title in (0.0, 0.1)]


def names_of(sentence: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of the entities that ``person_names`` finds: the same rules for Arrow batches, where only tokens with a capital are looked at."""
    runs: list[list] = []
    for m in _CANDIDATE.finditer(sentence):
        clean = _is_name(m.group())
        if clean:
            start, end = m.span()
            if runs and not sentence[runs[-1][1] : start].strip(_SPACE):
                runs[-1][1] = end
                runs[-1][2] += 1
            else:
                runs.append([start, end, 1, clean])
    for start, end, n, clean in runs:
        if n > 1 or len(clean) > 2:
            stop = start
            while stop and sentence[stop - 1] in _SPACE:
                stop -= 1
            begin = stop
            while begin and sentence[begin - 1] not in _SPACE:
                begin -= 1
            titled = sentence[begin:stop].strip(_EDGE).lower() in HONORIFICS
            yield begin if titled else start, end, _SCORES[titled][min(n + titled, 20)]


def _units(text: str, lines: bool) -> Iterator[tuple[int, str]]:
    """(start, text) of the sentences, or of the lines, stripped and not empty, as ``sentences`` and ``paragraph_passages`` make them."""
    found, at = False, 0
    for part in text.split("\n") if lines else _SENTENCE.findall(text):
        at = at if lines else text.index(part, at)
        unit = part.strip(_SPACE)
        if unit:
            found = True
            yield at + len(part) - len(part.lstrip(_SPACE)), unit
        at += len(part) + lines
    whole = text.strip(_SPACE)
    if not found and whole:
        yield len(text) - len(text.lstrip(_SPACE)), whole


def document_names(docs: DataFrame, lines: bool = False) -> DataFrame:
    """(doc_id, ord, start, end, text, score) of the person names in the sentences, or with ``lines`` in the lines, of ``docs`` (doc_id, text). ``ord`` numbers the sentences of a document, places are its own."""
    kinds = {"ord": pa.int32(), "start": pa.int32(), "end": pa.int32(), "text": pa.string(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                at, rows = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    for ord, (base, unit) in enumerate(_units(text or "", lines)):
                        for a, b, score in names_of(unit):
                            at.append(k)
                            rows.append((ord, base + a, base + b, unit[a:b], score))
                columns = list(zip(*rows)) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds.values()))], names=["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ord int, start int, end int, text string, score double")


def decode(sentence: str, tagged: list[tuple[str, str]]) -> list[tuple[str, int, int]]:
    """(label, start, end): what ``decode_bio`` finds in a sentence, for Arrow batches."""
    low, at, opened, found = sentence.lower(), 0, None, []
    for token, tag in tagged:
        needle = re.sub(f"[{_SPACE}]+", " ", token.replace("_", " ").lower()).strip(" ")
        start = low.find(needle, at) if needle else -1
        start = low.find(needle) if needle and start < 0 else start
        if start < 0:
            continue
        at = start + len(needle)
        tag = (tag or "O").upper()
        if tag.startswith("I-") and opened and opened[0] == tag[2:]:
            opened[2] = at
            continue
        opened = [tag[2:], start, at] if tag.startswith("B-") else None
        if opened:
            found.append(opened)
    return [(LABELS[label], a, b) for label, a, b in found if label in LABELS]


def align(sentence: Column, tokens: Column) -> Column:
    """Place of each token (``_`` stands for a space) in the sentence, searched from the last
    one on and then from the start; (-1, -1) if it isn't there."""
    pair = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(pair).alias("out"))
    low = F.lower(sentence)

    def add(acc: Column, token: Column) -> Column:
        def place(needle: Column) -> Column:
            ahead = F.call_function("locate", needle, low, acc["at"] + 1) - 1
            found = F.when(needle == "", -1).when(ahead >= 0, ahead).otherwise(F.call_function("locate", needle, low) - 1)

            def put(at: Column) -> Column:
                end = F.when(at < 0, -1).otherwise(at + F.length(needle))
                return F.struct(F.when(at < 0, acc["at"]).otherwise(end).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), end.alias("end")))).cast(pair).alias("out"))

            return let(found, put)

        return let(squeeze(F.lower(F.replace(token, F.lit("_"), F.lit(" ")))), place)

    return F.aggregate(tokens, zero, add, lambda acc: acc["out"])


def decode_bio(sentence: Column, tagged: Column, score: float = 0.8) -> Column:
    """Entities of array<struct<token, tag>>: B- opens one, I- of the same label extends it, all else
    closes it. Tokens that can't be placed are skipped; labels other than PER, ORG and LOC are dropped."""
    item = "struct<label:string,start:int,end:int>"
    zero = F.struct(F.array().cast(f"array<{item}>").alias("done"), F.lit(None).cast(item).alias("open"))
    placed = F.zip_with(tagged, align(sentence, F.transform(tagged, lambda t: t["token"])), lambda t, p: F.struct(F.upper(F.coalesce(t["tag"], F.lit("O"))).alias("tag"), p["start"].alias("start"), p["end"].alias("end")))

    def add(acc: Column, t: Column) -> Column:
        opened, label = acc["open"], F.substring(t["tag"], 3, 100)
        closed = F.when(opened.isNotNull(), F.concat(acc["done"], F.array(opened))).otherwise(acc["done"])
        new = F.struct(label.alias("label"), t["start"].alias("start"), t["end"].alias("end")).cast(item)
        longer = F.struct(opened["label"].alias("label"), opened["start"].alias("start"), t["end"].alias("end")).cast(item)
        begins, goes_on = t["tag"].startswith("B-"), t["tag"].startswith("I-") & F.coalesce(opened["label"] == label, F.lit(False))
        return F.struct(
            F.when(goes_on, acc["done"]).otherwise(closed).cast(f"array<{item}>").alias("done"),
            F.when(begins, new).when(goes_on, longer).otherwise(F.lit(None).cast(item)).alias("open"),
        )

    found = F.aggregate(F.filter(placed, lambda t: t["start"] >= 0), zero, add, lambda acc: F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]))
    names = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    known = F.filter(found, lambda e: e["label"].isin(list(LABELS)))
    return F.transform(known, lambda e: F.struct(F.element_at(names, e["label"]).alias("label"), slice_text(sentence, e["start"], e["end"]).alias("text"), e["start"].alias("start"), e["end"].alias("end"), F.lit(score).alias("score"))).cast(_ENTITY)


def entity_spans(entities: Column, base: Column, sentence_id: Column, passage_id: Column, backend: str = "simple") -> Column:
    """Entities of a sentence as spans of the article; the confidence is kept within 0 and 1."""

    def one(e: Column) -> Column:
        return F.struct(
            e["label"].alias("span_type"),
            e["text"].alias("text"),
            (base + e["start"]).alias("start"),
            (base + e["end"]).alias("end"),
            sentence_id.alias("sentence_id"),
            F.lit("ner").alias("source"),
            passage_id.alias("passage_id"),
            F.least(F.greatest(e["score"], F.lit(0.0)), F.lit(1.0)).alias("confidence"),
            attributes(backend=F.lit(backend)).alias("attributes"),
        )

    return F.transform(entities, one).cast(f"array<{SPAN}>")


def backend_entities(sentence: Column, backend: str) -> Column:
    """Entities by backend name: ``simple`` (also for ``auto``) or ``none``. Model backends come in as tagged tokens through ``decode_bio``."""
    if backend in ("simple", "auto"):
        return person_names(sentence)
    if backend == "none":
        return F.array().cast(_ENTITY)
    raise ValueError(f"unknown backend {backend!r}: use simple, auto or none, or decode_bio on tagged tokens")
