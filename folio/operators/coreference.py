"""Coreference within a document: names, short names and pronouns in reading order, each resolved to what was mentioned before.

Mentions are found in Arrow batches, by the rules that ``mentions`` has as a Column; a small fold over the ordered mentions of one document then resolves them with a
salience list, the people in the order of their last mention, and with the people last named by each word. A step is a few look-ups, whatever the number of people.

* A name of several words is the person with the same name, else a person known so far only by its last or first word, else somebody new.
* A single word is the person last named by a name that ends, else begins, with it and whose gender doesn't contradict, else somebody new.
* A pronoun is the last mentioned person of its gender at most ``WINDOW`` sentences back, else the last of no gender known so far (who then has it); else it stays unresolved.

An honorific before a name tells its gender and isn't part of the name.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import COMBINING, MARKED, PLAIN, find_all, fold_name, let
from .ner import _SPACE, _units, names_of, person_names
from .sentences import sentences

#: What tells a gender before a name.
MALE, FEMALE = ["ông", "anh", "chú"], ["bà", "chị", "cô"]
#: Pronouns by gender; a bare honorific with a capital, as at the start of a sentence, is one too.
PRONOUNS = {"m": ["ông ta", "ông ấy", "anh ta", "anh ấy", "hắn", "he", "him", "his"], "f": ["bà ta", "bà ấy", "chị ta", "chị ấy", "cô ta", "cô ấy", "she", "her", "hers"]}
#: Sentences that a pronoun looks back.
WINDOW = 3
_BARE = {"m": [w.capitalize() for w in MALE], "f": [w.capitalize() for w in FEMALE]}
_PRONOUN = rf"(?<!\p{{L}})(?=[{''.join(sorted({c for ps in (*PRONOUNS.values(), *_BARE.values()) for p in ps for c in (p[0].lower(), p[0].upper())}))}])(?:(?iu:{'|'.join(p for ps in PRONOUNS.values() for p in ps)})|(?:{'|'.join(_BARE['m'] + _BARE['f'])})(?! \p{{Lu}}))(?!\p{{L}})"
_MENTION = "struct<start:int,end:int,text:string,sentence:int,kind:string,gender:string,name:string>"


def mentions(text: Column) -> Column:
    """array<struct<start, end, text, sentence, kind, gender, name>> of the names and pronouns of a text, in order. ``name`` is the folded name without its honorific. A
    pronoun inside a name isn't one."""
    honorific = rf"(?iu)^(?:{'|'.join(MALE + FEMALE)})[\s.]+"

    def of_sentence(s: Column, ord: Column) -> Column:
        def name(e: Column) -> Column:
            lead = F.lower(F.regexp_extract(e["text"], rf"(?iu)^({'|'.join(MALE + FEMALE)})(?=[\s.])", 1))
            gender = F.when(lead.isin(MALE), "m").when(lead.isin(FEMALE), "f")
            plain = F.trim(F.regexp_replace(fold_name(F.regexp_replace(e["text"], honorific, "")), r"[^\p{L}\p{N}' -]+", ""))
            return F.struct((s["start"] + e["start"]).alias("start"), (s["start"] + e["end"]).alias("end"), e["text"].alias("text"), ord.alias("sentence"), F.lit("name").alias("kind"), gender.alias("gender"), plain.alias("name"))

        def pronoun(p: Column) -> Column:
            gender = F.when(F.lower(p["text"]).isin(PRONOUNS["m"] + MALE), "m").otherwise("f")
            return F.struct((s["start"] + p["start"]).alias("start"), (s["start"] + p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("text"), ord.alias("sentence"), F.lit("pronoun").alias("kind"), gender.alias("gender"), F.lit(None).cast("string").alias("name"))

        def both(at: Column) -> Column:
            names = F.filter(at["names"], lambda n: (n["name"] != "") & ~F.exists(at["pronouns"], lambda p: (p["start"] <= n["start"]) & (p["end"] >= n["end"])))
            pronouns = F.filter(at["pronouns"], lambda p: ~F.exists(at["names"], lambda n: (n["start"] <= p["start"]) & (n["end"] >= p["end"]) & (F.length(n["text"]) > F.length(p["text"]))))
            return F.concat(names, pronouns)

        return let(F.struct(F.transform(person_names(s["text"]), name).cast(f"array<{_MENTION}>").alias("names"), F.transform(find_all(s["text"], _PRONOUN), pronoun).cast(f"array<{_MENTION}>").alias("pronouns")), both)

    found = F.flatten(F.transform(sentences(F.coalesce(text, F.lit(""))), of_sentence))
    return F.array_sort(found).cast(f"array<{_MENTION}>")


def finder() -> Callable[[str], list[dict]]:
    """A function from a text to what ``mentions`` finds in it, in the same order, for Arrow batches."""
    import regex

    pronouns, honorific = regex.compile(_PRONOUN.replace("(?iu:", "(?i:")), re.compile(rf"({'|'.join(MALE + FEMALE)})[ \t\n\x0b\f\r.]+", re.I)
    combining, space, other = re.compile(COMBINING), re.compile(f"[{_SPACE}]+"), regex.compile(r"[^\p{L}\p{N}' -]+")
    plain = str.maketrans(MARKED, PLAIN)

    def named(start: int, raw: str, sentence: int) -> dict:
        lead = honorific.match(raw)
        title = lead.group(1).lower() if lead else None
        folded = space.sub(" ", combining.sub("", raw[lead.end() :] if lead else raw).lower()).strip(" ").translate(plain)
        gender = "m" if title in MALE else "f" if title in FEMALE else None
        return {"start": start, "end": start + len(raw), "text": raw, "sentence": sentence, "kind": "name", "gender": gender, "name": other.sub("", folded).strip(" ")}

    def find(text: str) -> list[dict]:
        found = []
        for ord, (base, unit) in enumerate(_units(text, False)):
            names = [named(base + a, unit[a:b], ord) for a, b, _ in names_of(unit)]
            said = [
                {"start": base + m.start(), "end": base + m.end(), "text": m.group(), "sentence": ord, "kind": "pronoun", "gender": "m" if m.group().lower() in PRONOUNS["m"] + MALE else "f", "name": None}
                for m in pronouns.finditer(unit)
            ]
            if names and said:
                inside = lambda x, y: y["start"] <= x["start"] and y["end"] >= x["end"]
                both = [n for n in names if not any(inside(n, p) for p in said)], [p for p in said if not any(inside(p, n) and len(n["text"]) > len(p["text"]) for n in names)]
                names, said = both
            found += sorted([n for n in names if n["name"]] + said, key=lambda x: (x["start"], x["end"]))
        return found

    return find


def resolve(found: list[dict], window: int = WINDOW) -> list[int | None]:
    """For each of the ordered mentions of a document the number of its person, by first mention; None for an unresolved pronoun."""
    genders: list[str | None] = []
    whole: set[int] = set()  # people known by a name of several words
    by_name: dict[str, int] = {}
    only_short: dict[str, int] = {}
    # Dicts in the order of the last mention: a person is taken out and put in again.
    salient: dict[int, int] = {}
    ending: dict[str, dict[int, None]] = {}
    beginning: dict[str, dict[int, None]] = {}
    out: list[int | None] = []
    end = -1

    def fits(person: int | None, gender: str | None) -> bool:
        return person is not None and (gender is None or genders[person] in (None, gender))

    def last(people: dict[int, None], gender: str | None) -> int | None:
        return next((p for p in reversed(people) if fits(p, gender)), None)

    for m in found:
        person, gender = None, m["gender"]
        if m["kind"] == "pronoun":
            if m["start"] >= end:  # not inside the name before it
                for p in reversed(salient):
                    if m["sentence"] - salient[p] > window or genders[p] == gender:
                        person = p if m["sentence"] - salient[p] <= window else person
                        break
                    if genders[p] is None and person is None:
                        person = p
        else:
            end, words = m["end"], m["name"].split()
            if len(words) == 1:
                person = last(ending.get(words[0], {}), gender)
                person = last(beginning.get(words[0], {}), gender) if person is None else person
            else:
                same = by_name.get(m["name"])
                short = [p for w in (words[-1], words[0]) if fits(p := only_short.get(w), gender) and p not in whole]
                person = same if fits(same, gender) else short[0] if short else None
            if person is None:
                person = len(genders)
                genders.append(gender)
            if len(words) > 1:
                by_name[m["name"]] = person
                whole.add(person)
            elif person not in whole:
                only_short[words[0]] = person
            for index, w in ((ending, words[-1]), (beginning, words[0])):
                people = index.setdefault(w, {})
                people.pop(person, None)
                people[person] = None
        if person is not None:
            genders[person] = genders[person] or gender
            salient.pop(person, None)
            salient[person] = m["sentence"]
        out.append(person)
    return out


def coreference(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, start, end, text, kind, sentence, person, person_name) of every name and pronoun of ``docs`` (doc_id, text), places in code points. ``person`` numbers the people of a document by their
    first mention and is null for an unresolved pronoun; ``person_name`` is the longest name of that person, of equal ones the first. Rows of one doc_id, also a null one, are documents of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("kind", pa.string()), ("sentence", pa.int32())]
        find = finder()
        for batch in batches:
            for k in range(batch.num_rows):
                found = find(batch.column("text")[k].as_py() or "")
                people = resolve(found, window)
                names: dict[int, str] = {}
                for m, p in zip(found, people):
                    if m["kind"] == "name" and len(m["name"]) > len(names.get(p, "")):
                        names[p] = m["name"]
                columns = [pa.array([m[c] for m in found], t) for c, t in kinds]
                columns += [pa.array(people, pa.int32()), pa.array([names.get(p) for p in people], pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([k] * len(found), pa.int64())), *columns], names=["doc_id", *(c for c, _ in kinds), "person", "person_name"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start int, end int, text string, kind string, sentence int, person int, person_name string")
