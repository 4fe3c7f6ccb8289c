"""Coreference and the explanation of dropped spans against plain Python."""

import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folio.operators import approximate, coreference

SF = "/root/testdata/sf0.01"
N = lambda start, sentence, name, gender=None: {"start": start, "end": start + len(name), "text": name, "sentence": sentence, "kind": "name", "gender": gender, "name": name}
P = lambda start, sentence, gender: {"start": start, "end": start + 2, "text": "he", "sentence": sentence, "kind": "pronoun", "gender": gender, "name": None}


def plain(found, window=3):
    """The rules of the module, each by going back through all earlier mentions."""
    history, genders, out, whole = [], {}, [], set()

    def back(test, gender):
        return next((h["person"] for h in reversed(history) if test(h) and (gender is None or genders[h["person"]] in (None, gender))), None)

    for m in found:
        person, words = None, (m["name"] or "").split()
        if m["kind"] == "pronoun":
            names = [x for x in found[: found.index(m)] if x["kind"] == "name"]
            if not names or m["start"] >= names[-1]["end"]:
                near = lambda h: m["sentence"] - max(x["sentence"] for x in history if x["person"] == h["person"]) <= window
                person = back(lambda h: near(h) and genders[h["person"]] == m["gender"], None)
                person = back(lambda h: near(h) and genders[h["person"]] is None, None) if person is None else person
        elif len(words) == 1:
            person = back(lambda h: h["words"] and h["words"][-1] == words[0], m["gender"])
            if person is None:
                person = back(lambda h: h["words"] and h["words"][0] == words[0], m["gender"])
        else:
            same = next((h["person"] for h in reversed(history) if h["words"] == words), None)
            person = same if same is not None and (m["gender"] is None or genders[same] in (None, m["gender"])) else None
            for w in (words[-1], words[0]):
                if person is None:
                    one = next((h["person"] for h in reversed(history) if h["words"] == [w] and h["short"]), None)
                    if one is not None and one not in whole and (m["gender"] is None or genders[one] in (None, m["gender"])):
                        person = one
        if person is None and m["kind"] == "name":
            person = len(genders)
            genders[person] = None
        if person is not None:
            genders[person] = genders[person] or m["gender"]
            if len(words) > 1:
                whole.add(person)
            history.append({"person": person, "words": words, "sentence": m["sentence"], "short": person not in whole})
        out.append(person)
    return out


def test_rules():
    assert coreference.resolve([N(0, 0, "nguyen van an", "m"), N(20, 1, "an"), P(30, 1, "m"), P(40, 1, "f")]) == [0, 0, 0, None]
    assert coreference.resolve([N(0, 0, "lan"), N(10, 0, "tran thi lan"), N(30, 1, "lan"), N(40, 1, "le lan")]) == [0, 0, 0, 1]
    assert coreference.resolve([N(0, 0, "an", "f"), N(10, 0, "an", "m"), N(20, 0, "an", "f"), N(30, 1, "an")]) == [0, 1, 0, 0]
    assert coreference.resolve([N(0, 0, "binh"), N(10, 0, "hoa"), P(20, 0, "m"), P(30, 0, "f"), P(40, 5, "m")]) == [0, 1, 1, 0, None]
    assert coreference.resolve([N(0, 0, "ha noi"), P(1, 0, "m")]) == [0, None]


def test_equals_plain_rules():
    rng = random.Random(6)
    for _ in range(400):
        found, at = [], 0
        for k in range(rng.randint(0, 25)):
            at += rng.randint(1, 12)
            gender = rng.choice(["m", "f", None, None])
            name = " ".join(rng.choice("abcd") for _ in range(rng.choice([1, 1, 2, 3])))
            found.append(P(at, k // 3, gender or "m") if rng.random() < 0.35 else N(at, k // 3, name, gender))
        assert coreference.resolve(found) == plain(found), found


def test_coreference(spark):
    text = "Ông Nguyễn Văn An đến 🎉 Huế. Ông ấy gặp bà Trần Thị Bình. Bà ấy chào An.\nAnh ta về."
    df = spark.createDataFrame([(1, text, "c"), (None, text, "c"), (2, None, "c"), (3, "", "c"), (4, "no names here", "c")], "doc_id long, text string, person string")
    rows = coreference.coreference(df).collect()
    assert {r.doc_id for r in rows} == {1, None}
    for d in (1, None):
        got = [(r.text, r.person, r.person_name) for r in rows if r.doc_id == d]
        people = {t: p for t, p, _ in got}
        assert people["Ông Nguyễn Văn An"] == people["Ông ấy"] == people["Anh ta"] and people["bà Trần Thị Bình."] == people["Bà ấy"], got
        assert ("Ông ấy", 0, "nguyen van an") in got
    assert all(text[r.start : r.end] == r.text for r in rows)
    assert coreference.coreference(df.limit(0)).collect() == []


def test_batches_find_what_the_column_finds(spark):
    """Titles, pronouns in and around names, marks, odd white space; and no interpreted names in the plan."""
    words = ["Ông", "ông ấy", "Bà", "bà", "Chị ta", "HE", "he", "She", "Hers", "hắn", "Hắn", "An", "Nguyễn", "Ti\u0302n", "O'Brien", "Jean-Luc", "(Lan)", "ông.", "CÔ", "Anh", "x", "3", "🎉", "\u00a0", "\t", "\n", ".", "…", "Ǆ", "ĐẠT", "Đạt", "_He", "he_", "…!"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", ""]) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    find = coreference.finder()
    for r in df.select("text", coreference.mentions(F.col("text")).alias("m")).collect():
        assert find(r.text) == [m.asDict() for m in r.m], r.text
    plan = coreference.coreference(df)._jdf.queryExecution().toString()
    assert "lambdafunction" not in plan and "regexp" not in plan


def test_long_document(spark):
    text = " ".join(f"Ông Lê Văn A{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} đi. Ông ấy về." for i in range(5000))
    rows = coreference.coreference(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(rows) == 10_000 and len({r.person for r in rows}) == 5000 and all(r.person is not None for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_all_documents_equal_plain_rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000")
    found = {r.doc_id: [m.asDict() for m in r.m] for r in docs.select("doc_id", coreference.mentions(F.col("text")).alias("m")).collect()}
    got = defaultdict(list)
    for r in coreference.coreference(docs).collect():
        got[r.doc_id].append((r.start, r.end, r.person))
    assert len(found) > 700 and sum(map(len, found.values())) > 10_000
    for d, ms in found.items():
        assert sorted(got[d]) == sorted((m["start"], m["end"], p) for m, p in zip(ms, plain(ms)))


# --- dropped spans -------------------------------------------------------------------------


def table(pattern, text):
    """Edit distances of the pattern to the nearest substring that ends at each place, by the whole table."""
    row = list(range(len(pattern) + 1))
    out = [row[-1]]
    for c in text:
        before, row = row, [0]
        for i, p in enumerate(pattern, 1):
            row.append(min(before[i] + 1, row[i - 1] + 1, before[i - 1] + (p != c)))
        out.append(row[-1])
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_costs_equal_the_table():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("abcé🎉 ") for _ in range(rng.randint(0, 60)))
        pattern = "".join(rng.choice("abcé ") for _ in range(rng.randint(1, 12)))
        assert approximate.end_costs(pattern, text) == table(pattern, text)
        assert approximate.end_costs(pattern, text, anchored=True) == [distance(pattern, text[:j]) for j in range(len(text) + 1)]
        best = min(distance(pattern, text[i:j]) for i in range(len(text) + 1) for j in range(i, len(text) + 1))
        found = approximate.locate(pattern, text, 5, 9, worst=1.0)
        assert found and found[2] == distance(pattern, text[found[0] : found[1]])
        assert found[2] == best or (approximate._bare(pattern).split() == approximate._bare(text[found[0] : found[1]]).split())
        exact = [abs(i - 5) for i in range(len(text)) if text.startswith(pattern, i)]
        assert not exact or abs(found[0] - 5) == min(exact)


def test_explanations(spark):
    article = "Ông An  sinh năm 1970 ở HÀ NỘI. Số điện thoại 0912 345 678, gặp bà Bình; An về."
    cases = [
        ("An", 60, 62, "moved", article.rindex("An")), ("An", 0, 2, "moved", 4), ("hà nội", 0, 5, "case", 24), ("An sinh", 0, 3, "white_space", 4), ("Ha Noi", 0, 5, "diacritics", 24), ("0912-345-678", 0, 5, "edited", article.index("0912")),
        ("Zxqwj", 0, 5, "absent", None), ("", 3, 3, "no_text", None), (None, 3, 3, "no_text", None), ("Bình", None, None, "moved", article.index("Bình")),
    ]
    kind = "doc_id string, span_type string, text string, start int, end int, reason string, verified boolean, cost string"
    rows = [("1", "x", t, a, b, "text_mismatch", False, str(i)) for i, (t, a, b, *_) in enumerate(cases)]
    rows += [("2", "x", "An", 0, 2, "missing_article", False, ""), (None, "x", "An", 0, 2, "missing_article", False, ""), ("1", "x", "An", 4, 6, None, True, "")]
    articles = spark.createDataFrame([("1", article), ("1", "short"), ("3", "never read"), (None, "An")], "doc_id string, full_text string")
    got = approximate.explain_drops(spark.createDataFrame(rows, kind), articles).collect()
    assert len(got) == len(cases) + 2
    assert sorted(repr((r.text, r.start, r.explanation, r.found_start)) for r in got if r.doc_id == "1") == sorted(repr((t, a, e, f)) for t, a, _, e, f in cases)
    assert {r.explanation for r in got if r.doc_id != "1"} == {"no_article"}
    assert all(article[r.found_start : r.found_end] == r.found_text for r in got if r.found_start is not None)
    assert approximate.explain_drops(spark.createDataFrame([], kind), articles).collect() == []


def test_long_article(spark):
    text = "ab " * 100_000 + "Nguyễn Văn Tèo" + " cd" * 100_000
    kind = "doc_id string, span_type string, text string, start int, end int, reason string, verified boolean"
    spans = [("1", "p", "Nguyen Van Tèo", 0, 14, "text_mismatch", False), ("1", "p", "y" * 5000, 0, 5, "text_mismatch", False)]
    got = {len(r.text): r for r in approximate.explain_drops(spark.createDataFrame(spans, kind), spark.createDataFrame([("1", text)], "doc_id string, full_text string")).collect()}
    assert (got[14].found_text, got[14].cost, got[14].explanation) == ("Nguyễn Văn Tèo", 2, "diacritics") and got[5000].explanation == "absent"
