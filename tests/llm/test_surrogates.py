"""Surrogates: long texts of every repeated form, coreference, formats, and a plain-Python cut of the same texts."""

import re

import regex
from pyspark.sql import functions as F

from folio.llm import surrogates

G = r"[A-Z][a-z]+"


def run(spark, rows, key="k"):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, types string, n_entities int")
    return {r.doc_id: r for r in surrogates.pseudonymise(df, key).collect()}


LONG = {
    "title case": "Mr. " + "Abcd " * 20_000,
    "capitals": "MR. " + "ABCD EFGH " * 10_000,
    "letters": "Mr. A" + "a" * 100_000,
    "apostrophes": "Mrs O" + "'a" * 50_000,
    "hyphens": "Mrs Ab" + "-Cd" * 30_000,
    "initials": "Dr. " + "J." * 50_000 + " Smith",
    "particles": "Herr " + "von " * 25_000 + "Braun",
    "titles": "Dr. " + "Prof. " * 20_000 + "Smith",
    "given names": "Anna " * 20_000,
    "dots": "a@" + "b." * 50_000 + "com",
    "labels": "a@" + "bc." * 30_000 + "com",
    "local part": "a." * 50_000 + "@b.com",
    "at signs": "a@" * 50_000,
    "digits": "1" * 100_000,
    "groups of digits": "4539 1488 " * 10_000,
    "dashes": "123-45-" * 15_000,
    "colons": "ab:" * 30_000 + ":1",
    "hexadecimal": "0a" * 50_000,
    "streets": "1 Abc Def " * 10_000,
    "astral letters": "Mr. A" + "𝐀a" * 30_000,
}


def test_long_texts_end_no_executor(spark):
    got = run(spark, [*enumerate(LONG.values()), (99, "SSN 123-45-6789")])
    assert len(got) == len(LONG) + 1 and got[99].n_entities == 1 and all(r.text for r in got.values())
    for d, form in enumerate(LONG):
        if form in ("title case", "capitals"):
            assert got[d].n_entities == 1 and "Abcd" not in got[d].text and "ABCD" not in got[d].text


def test_one_name_is_one_person(spark):
    got = run(spark, [(1, "Dr. Zelda Smith spoke. Mrs. Zelda Smith left."), (2, "Mr. O'Neill and Mr. O’Neill."), (3, "Herr Müller-Lüdenscheidt kam. Müller ging. Lüdenscheidt blieb."), (4, "Mr. Kim Park, Mrs. Kim Park")])
    one = re.fullmatch(rf"Dr\. ({G}) ({G}) spoke\. Mrs\. ({G}) ({G}) left\.", got[1].text)
    assert one[1] == one[3] in surrogates.GIVEN["latin"]["f"] and one[2] == one[4]
    two = re.fullmatch(rf"Mr\. O'({G}) and Mr\. O’({G})\.", got[2].text)
    assert two[1] == two[2] != "Neill"
    three = re.fullmatch(rf"Herr ({G})-({G}) kam\. ({G}) ging\. ({G}) blieb\.", got[3].text)
    assert three[1] == three[3] and three[2] == three[4] and got[3].n_entities == 3
    four = re.fullmatch(rf"Mr\. ({G}) ({G}), Mrs\. ({G}) ({G})", got[4].text)
    assert four[1] == four[3] in surrogates.GIVEN["latin"]["x"]


def mod97(iban):
    s = re.sub(r"\s", "", iban)
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_formats(spark):
    text = (
        "+49 30 901820, +1 212 555 0123, +420 224 123 456; DE89370400440532013000 and GB82 WEST 1234 5698 7654 32 but DE00370400440532013000; jürgen@müller.de jörg.weber@firma.de, "
        "2001:0db8:85a3:0000:0000:8a2e:0370:7334 fe80:1::1 eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2Q at 10:30:45 std::max"
    )
    out = run(spark, [(1, text)])[1].text
    assert re.match(r"\+49 \d\d \d{6}, \+1 \d{3} \d{3} \d{4}, \+420 \d{3} \d{3} \d{3}; ", out) and "901820" not in out
    ibans = re.findall(r"DE\d{20}|GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d", out)
    assert len(ibans) == 3 and [mod97(x) == 1 for x in ibans] == [True, True, False] and "37040044" not in out
    for secret in ("jürgen", "müller", "jörg", "weber@", "0db8", "8a2e", "fe80:1", "hbGci", "SflK"):
        assert secret not in out, secret
    assert out.endswith(" at 10:30:45 std::max") and re.search(r" [0-9a-f]{4}(:[0-9a-f]{4}){7} [a-f0-9]{4}:\d::\d eyJ\w{13}\.\w{16}\.\w{16} at", out)


def test_texts_that_hold_the_mark(spark):
    mark = surrogates._MARK
    got = run(spark, [(1, f"a {mark} SSN 123-45-6789 {mark}{mark} Mr. Jo Smith, Smith{mark}")])[1].text
    assert re.fullmatch(rf"a {mark} SSN \d{{3}}-\d\d-\d{{4}} {mark}{mark} Mr\. ({G}) ({G}), \2{mark}", got) and "123-45" not in got


def test_the_same_cut_in_plain_python(spark):
    """What isn't replaced stands as it was, in the gaps that Python's matches of the same patterns leave; each entity has one replacement, different ones different."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where(F.col("text").rlike(surrogates.ENTITY)).collect()]
    entity = regex.compile(surrogates.ENTITY, regex.V0)
    kinds = {k: regex.compile(p) for k, p in surrogates.PATTERNS.items() if k != "person"}
    got = run(spark, rows)
    seen, checked = {}, 0
    for d, text in rows:
        hits = [(m.start(), m.group()) for m in entity.finditer(text)]
        at, pattern = 0, ""
        plain = [h for h in hits if any(kinds[k].fullmatch(h[1]) for k in ("email", "secret", "ssn", "card", "phone", "token"))]
        # Names may also be mentioned between them, so only the other types are cut out.
        if len(plain) != len(hits):
            continue
        for start, hit in hits:
            pattern += re.escape(text[at:start]) + "(.+?)"
            at = start + len(hit)
        found = re.fullmatch(pattern + re.escape(text[at:]), got[d].text, re.S)
        assert found and got[d].n_entities == len(hits), text
        for (_, hit), new in zip(hits, found.groups()):
            canonical = hit.lower() if "@" in hit else re.sub(r"[^0-9A-Za-z+]", "", hit)
            assert seen.setdefault(canonical, new if "@" in hit else re.sub(r"[^0-9A-Za-z+]", "", new)) == (new if "@" in hit else re.sub(r"[^0-9A-Za-z+]", "", new))
            checked += 1
    assert checked >= 10 and len(set(seen.values())) == len(seen) and not set(seen) & set(seen.values())
