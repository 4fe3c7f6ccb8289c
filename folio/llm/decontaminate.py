"""Benchmark decontamination by template canonicalisation.

Texts and benchmark items become sequences of template tokens: numbers, names and
units turn into typed placeholders, everything else into lower-cased words without
outer punctuation. There are two templates of each text: in one every run of
capitalised words is a name, wherever it stands, in the other no word is, so that copies
in all capitals or lower case are met too. Windows of WIDTH template tokens are
hash-joined; an item counts as found in a document when, in either template by itself,
at least 4/5 of its windows are there and the values in the matched placeholders are
consistent: one value of the item always stands for one value of the document. So
re-parameterised questions are caught, chance meetings of templates are not. Items of fewer
than WIDTH and at least SHORTEST tokens are met as a whole, with equal values in their slots.

Windows that many items and documents share don't multiply: a document and an item are
compared only if they share one of the item's rarest windows, so many of them that a
document with 4/5 of all windows can't lack them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bits import bit_array, has_bit
from .common import materialise, release, slices, windows

WIDTH = 5
#: Items of fewer tokens are never found.
SHORTEST = 3
#: Share of an item's windows, and of its slot values, that must agree: 4/5.
SHARE = (4, 5)

UNITS = frozenset(
    """mm cm m km metre metres meter meters inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms
    ounce ounces pound pounds ton tons tonne tonnes ml l litre litres liter liters gallon gallons second seconds minute minutes
    hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent degree degrees
    mph kmh watt watts volt volts joule joules byte bytes bit bits kb mb gb tb
    meile meilen gramm kilogramm tonne tonnen sekunde sekunden stunde stunden tag tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad
    mètre mètres gramme grammes kilogramme kilogrammes heure heures jour jours semaine semaines mois an ans année années degré degrés
    metro metros gramo gramos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas día días semana semanas mes meses año años""".split()
)
NUMBERS = frozenset(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
    nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
    zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
    deux trois quatre cinq sept huit neuf dix onze douze vingt trente quarante cinquante soixante cent mille
    dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil""".split()
)
#: Words that are no names, though they often begin a sentence, and so are capitalised.
PLAIN = frozenset(
    """a an the this that these those there here it its i he she we you they his her our your their my who whom whose what which
    when where why how if in on at by for from with without of to as and or but so then than after before during while until
    since because although though each every all both some any no not is are was were do does did has have had can could would
    should must let given suppose find calculate compute determine today yesterday tomorrow
    der die das ein eine einer er sie es wir ihr wer was wann wo warum wie wenn und oder aber im am auf mit nach vor bei von zu ist sind hat haben
    le la les un une il elle nous vous ils elles qui que quand où pourquoi comment si et ou mais dans sur avec après avant est sont
    el los las una él ella ellos quién qué cuándo dónde cómo cuántos cuántas y o pero en con después antes es son hay""".split()
)
#: Abbreviations before a name: their full stop ends no sentence.
TITLES = frozenset("mr mrs ms dr prof st jr sr mme mlle sra srta hr fr".split())
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/-]*%?")
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "$+-%") + "“”‘’«»…–—¿¡"
_NUM, _UNIT, _CAP, _END = 1, 2, 4, 8
#: Codes of the placeholders.
_PLACE = {kind: np.uint64(xxhash.xxh3_64_intdigest(f"<{kind}>") >> 4) for kind in ("num", "unit", "name")}


class TemplateWords(dict):
    """Word to (60-bit code << 4 | flags); 0 for a word of punctuation only. Bounded."""

    LIMIT = 1 << 19

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        core = word.strip(_OUTER)
        low = core.strip("$+-%").lower()
        abbreviated = word.endswith(".") and (low in TITLES or len(low) == 1 and low.isalpha())
        flags = _END if not abbreviated and word.rstrip("\"')]}”’»")[-1:] in (".", "!", "?", ":", "…") else 0
        if _NUMBER.fullmatch(core) or low in NUMBERS:
            flags |= _NUM
        elif low in UNITS:
            flags |= _UNIT
        if core.strip("$+-%")[:1].isupper() and (low not in PLAIN or abbreviated):
            flags |= _CAP
        code = self[word] = (xxhash.xxh3_64_intdigest(low) >> 4) << 4 | flags if low else 0
        return code


def templates(text: str | None, known: TemplateWords) -> Iterator[tuple[np.ndarray, tuple, np.ndarray]]:
    """The template with names, the one without, and the plain tokens: codes, the words behind each (joined for a run of names), and whether it is a placeholder."""
    words = (text or "").split()
    packed = np.array([known[w] for w in words], np.uint64)
    real = np.flatnonzero(packed)
    packed = packed[real]
    flags, codes = (packed & np.uint64(15)).astype(np.int64), packed >> np.uint64(4)
    plain, num = codes, (flags & _NUM) > 0
    unit = ((flags & _UNIT) > 0) & np.concatenate([[False], num[:-1]]) if len(num) else num
    for mask, kind in ((num, "num"), (unit, "unit")):
        codes = np.where(mask, _PLACE[kind], codes)
    name = ((flags & _CAP) > 0) & ~num & ~unit
    # A run of names ends with its sentence.
    inside = name[1:] & name[:-1] & ((flags[:-1] & _END) == 0)
    begin = np.flatnonzero(~np.concatenate([[False], inside])) if len(name) else real
    yield np.where(name, _PLACE["name"], codes)[begin], (words, real, begin, np.append(begin[1:], len(codes))), (num | unit | name)[begin]
    every = np.arange(len(codes))
    yield codes, (words, real, every, every + 1), num | unit
    yield plain, (words, real, every, every + 1), np.zeros(len(plain), bool)


def _value(where: tuple, k: int) -> str:
    words, real, begin, ends = where
    return " ".join(words[real[i]].strip(_OUTER).lower() for i in range(begin[k], ends[k]))


def _window_rows(table: DataFrame, key: str, bits: bytes | None, width: int, short: bool = False) -> DataFrame:
    """(key, variant, at, h, slots, n): windows with a literal word (two in the template with names, where nouns of
    some languages are names), of both templates; n counts them in the text. With ``bits`` only windows that may be in it.

    Variant 2 has the literal tokens of short texts: with ``short`` all runs of their lengths, else a short text as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TemplateWords()
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for variant, (codes, where, slot) in enumerate(templates(text, known)):
                    if variant == 2:
                        for size in range(SHORTEST, width) if short else [len(codes)]:
                            if SHORTEST <= size <= len(codes) and (short or size < width):
                                h = windows(codes, size) ^ np.uint64(variant)
                                for k in (range(len(h)) if bits is None else np.flatnonzero(has_bit(bits, h)).tolist()):
                                    for c, v in zip(out, (name, variant, k, int(h.view(np.int64)[k]), [], 1)):
                                        c.append(v)
                        continue
                    if len(codes) < width:
                        continue
                    # Windows of one template never meet those of the other.
                    h = windows(codes, width) ^ np.uint64(variant)
                    literal = np.convolve(~slot, np.ones(width, np.int64), "valid") > (variant == 0)
                    at = np.flatnonzero(literal if bits is None else literal & has_bit(bits, h))
                    if not len(at):
                        continue
                    n = int(literal.sum())
                    signed = h.view(np.int64)
                    for k in at.tolist():
                        values = [_value(where, k + j) for j in range(width) if slot[k + j]]
                        for c, v in zip(out, (name, variant, k, int(signed[k]), values, n)):
                            c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[key, "variant", "at", "h", "slots", "n"])

    return table.select(key, "text").where(F.col(key).isNotNull()).mapInArrow(run, f"{key} long, variant int, at long, h long, slots array<string>, n long")


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """(doc_id, item_id, n_found, n_windows): the items found in each document.

    Slots are checked per alignment of item and document, so two differently filled
    copies in one document don't contradict each other, and once over all alignments
    for copies with small insertions. The counts are those of the template and alignment with most windows. Items of fewer than ``SHORTEST`` tokens
    can't be told from chance and are never found.
    """
    num, den = share
    items = materialise(_window_rows(benchmark, "item_id", None, width), "items")
    bits = bit_array(items.select("h"))
    short = not items.where("variant = 2").isEmpty()
    found = _window_rows(docs, "doc_id", bits, width, short).select("doc_id", "variant", F.col("at").alias("d_at"), "h", F.col("slots").alias("d_slots"))
    found = materialise(found, "found")
    key, pair = ["h", "variant"], ["doc_id", "item_id", "variant"]
    # How often an item's windows stand in documents; a document with num / den of an item's n windows has one of its n - ceil(n num / den) + 1 rarest.
    counts = found.groupBy(key).agg(F.count("*").alias("df"))
    rarest = F.row_number().over(W.partitionBy("item_id", "variant").orderBy("df", "h", "at"))
    ranked = items.join(counts, key, "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long"))).withColumn("rank", rarest)
    prefix = ranked.where((F.col("df") > 0) & (F.col("rank") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)).select("item_id", *key).distinct()
    candidates = found.select("doc_id", *key).join(prefix, key).select(pair).distinct()
    wanted = candidates.join(items, ["item_id", "variant"])
    met = materialise(wanted.join(found, ["doc_id", *key]).select(*pair, "at", "d_at", "n", "slots", "d_slots"), "met")
    release(items, found)
    likely = met.groupBy(pair).agg(F.countDistinct("at").alias("c"), F.max("n").alias("n")).where(F.col("c") * den >= F.col("n") * num).select(pair)
    aligned = met.join(likely, pair).withColumn("place", F.explode(F.array(F.col("d_at") - F.col("at"), F.lit(None).cast("long"))))
    keys = [*pair, "place"]
    cover = aligned.groupBy(keys).agg(F.countDistinct("at").alias("n_found"), F.max("n").alias("n_windows")).where(F.col("n_found") * den >= F.col("n_windows") * num)
    values = aligned.select(*keys, F.explode(F.arrays_zip(F.col("slots").alias("i"), F.col("d_slots").alias("d"))).alias("v"))
    by_value = values.groupBy(*keys, F.col("v.i").alias("i"), F.col("v.d").alias("d")).count()
    agree = by_value.groupBy(*keys, "i").agg(F.max("count").alias("most"), F.sum("count").alias("all")).groupBy(keys).agg(F.sum("most").alias("most"), F.sum("all").alias("all"))
    same = [*(F.col(f"c.{k}") == F.col(f"s.{k}") for k in pair), F.col("c.place").eqNullSafe(F.col("s.place"))]
    checked = cover.alias("c").join(agree.alias("s"), same, "left").where(F.col("s.all").isNull() | (F.col("s.most") * den >= F.col("s.all") * num))
    best = F.max(F.struct("c.n_found", "c.n_windows")).alias("best")
    return checked.groupBy("c.doc_id", "c.item_id").agg(best).select("doc_id", "item_id", "best.n_found", "best.n_windows")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, contaminated, items (sorted item ids), one row per input row.

    Null and empty texts, null doc_ids and an empty benchmark give contaminated = false
    and no items. Repeated rows of a doc_id share its verdict. An empty table gives no rows.
    """
    found = leaks(docs, benchmark, width, share).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))
