"""Quality rules, decontamination, surrogates, URL filter, chat, WARC, packing."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import chat, decontaminate, packing, quality, surrogates, url_filter, warc
from folio.llm.queries import tokenizer_path

DOC = "doc_id long, text string, lang string, kept string, n_words string, items int"


def docs(spark, rows, lang="en"):
    """Documents with further columns named like outputs."""
    return spark.createDataFrame([(d, t, lang, "x", "y", 1) for d, t in rows], DOC)


# --- quality -------------------------------------------------------------------------------


def brute_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_quality_counts(spark):
    rng, words = random.Random(1), ["w%d" % i for i in range(40)]
    texts = [None, "", " \n\t", "a", "a\na\n\na \n a", "é ü 🎉 " * 8, "#*$ %&| <> x", "x\x0by\x0cz\xa0q " * 3]
    texts += [" ".join(rng.choice(words[: rng.choice([2, 5, 40])]) for _ in range(rng.randint(4, 60))) for _ in range(40)]
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    rows = list(enumerate(texts)) + [(None, "a b"), (3, "a")]
    got = quality.features(docs(spark, rows)).collect()
    key = lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
    assert Counter(map(key, got)) == Counter(brute_features(t) for _, t in rows)


def test_binomial_tail_is_exact(spark):
    cases = [(k, n) for n in (1, 5, 20, 21, 400, 3000) for k in (0, 1, 3, n // 50, n // 10)]
    df = spark.createDataFrame(cases, "k long, n long")
    for r in df.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), 0.05).alias("p")).collect():
        exact = float(sum(math.comb(r.n, j) * Fraction(1, 20) ** j * Fraction(19, 20) ** (r.n - j) for j in range(r.k + 1)))
        assert r.p == 1.0 if r.k >= r.n * 0.05 else r.p == pytest.approx(exact, rel=1e-6)


def test_quality_cutoffs(spark):
    """Junk goes where labels certify a cutoff, nothing goes elsewhere, good documents stay."""
    rng = random.Random(2)
    words = ["word%d" % i for i in range(500)]
    good = [(i, " ".join(rng.choice(words) for _ in range(20))) for i in range(4000)]
    junk = [(10_000 + i, " ".join(rng.choice(words) + "$$$$" for _ in range(20))) for i in range(50)]
    en = docs(spark, good + junk)
    few = docs(spark, [(20_000 + i, t) for i, (_, t) in enumerate(good[:50] + junk)], "xx")
    labels = spark.createDataFrame([(i, 1, "z") for i, _ in good] + [(10_000, 0, "z"), (None, 1, "z"), (1, None, "z")], "doc_id long, quality int, kept string")
    got = {r.doc_id: r.kept for r in quality.judge(en.unionByName(few), labels).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in junk)
    assert all(v for k, v in got.items() if k >= 20_000)
    limits = quality.thresholds(quality.features(en), labels).collect()
    assert [r.stratum for r in limits] == ["en"] and limits[0].accepted >= quality.STEP["symbol_ratio", 8]
    report = quality.power(quality.judge(en, labels), labels).collect()
    assert [(r.good, r.good_rejected, r.junk, r.junk_rejected) for r in report] == [(3999, 0, 1, 1)]
    # A stricter demand on the risk certifies nothing.
    assert quality.thresholds(quality.features(en), labels, alpha=1e-5).isEmpty()


def test_accepted_steps_equal_an_exact_computation(spark):
    """Fixed sequence and correction over strata, with exact binomial sums; strata of too few labels take no share."""
    rng = random.Random(5)
    rows, labels = [], []
    for lang, n, bad in (("a", 700, 0.0), ("b", 300, 0.01), ("c", 90, 0.0), ("d", 1200, 0.004)):
        for _ in range(n):
            i = len(rows)
            marks = int(rng.random() < bad) * rng.randint(1, 40)
            rows.append((i, " ".join(rng.choice(["alpha", "be", "Gamma", "delta"]) for _ in range(30)) + " #" * marks, lang))
            labels.append((i, 1))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality.features(table).cache()
    got = {r.stratum: r.accepted for r in quality.thresholds(found, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    steps = defaultdict(list)
    for r in found.where("not base_failed").collect():
        steps[r.stratum].append(r.step)
    tested = {s: x for s, x in steps.items() if len(x) >= quality.fewest(quality.DELTA, quality.ALPHA)}
    expected, p = {}, Fraction(2, 100)
    for s, x in tested.items():
        n, last = len(x), -1
        for i in range(quality.N_STEPS):
            k = sum(v <= i for v in x)
            if k >= n * p or sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > Fraction(5, 100) / len(tested):
                break
            last = i
        if last >= 0:
            expected[s] = last
    assert set(tested) == {"a", "b", "d"} and got == expected and len(set(got.values())) > 1


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.judge(docs(spark, []), labels).count() == 0
    got = quality.judge(docs(spark, [(None, "a b c d e f g h i j k"), (1, None)], None), labels).collect()
    assert sorted((r.n_words, r.kept) for r in got) == [(0, False), (11, True)]


# --- decontamination -----------------------------------------------------------------------

ITEM = "When Tom buys 3 apples and Mary buys 12 pears for 45 dollars at the old market, how many more fruits does Mary carry home than Tom does?"


def found(spark, texts, items=((1, ITEM),)):
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontaminate.contaminated(docs(spark, list(enumerate(texts))), bench).collect()
    return {r.doc_id: r["items"] for r in got}


def test_leaks(spark):
    rng = random.Random(3)
    filler = lambda n: " ".join("w%d" % rng.randrange(5000) for _ in range(n))
    renamed = ITEM.replace("Tom", "Anna Smith").replace("Mary", "Bob").replace("12", "70").replace("45 dollars", "9 euros").replace("3 apples", "eight apples")
    mixed = ITEM.replace("Mary carry home than Tom", "Peter carry home than Karl").replace("Tom buys", "Ann buys").replace("Mary buys", "Sue buys")
    texts = [
        filler(50) + ". " + ITEM + " " + filler(50),
        filler(30) + ". " + renamed + " " + filler(9),
        filler(30) + ". " + mixed,
        filler(200),
        ITEM.replace("apples", "chairs").replace("pears", "tables").replace("market", "station").replace("fruits", "things"),
        ITEM + " " + renamed,
        None,
        "",
        " | ".join(ITEM.upper().lower().split()),
    ]
    got = found(spark, texts)
    assert [bool(got[i]) for i in range(6)] == [True, True, False, False, False, True]
    assert got[6] == got[7] == []


NAMED = [
    (1, "Tom has 5 apples. Tom buys 3 more apples. How many apples does Tom have now?"),
    (2, "Mr. Smith pays 40 dollars for a coat. Mr. Jones pays 15 dollars less. How much does Mr. Jones pay for the coat?"),
    (3, "McDonald sold 9 cows to O'Brien in spring and O'Brien sold 4 of them to J. Jean-Pierre. How many cows did O'Brien keep?"),
    (4, "At noon the tall sailor called Tom gives 7 coins to Mary while Mary gives 2 coins to Tom at the harbour"),
]


def test_leaks_of_renamed_and_recased_items(spark):
    """Names at sentence starts, after abbreviations and with inner capitals; copies in one case."""
    renamed = [
        NAMED[0][1].replace("Tom", "Anna"),
        NAMED[1][1].replace("Smith", "Miller").replace("Jones", "Brown Taylor"),
        NAMED[2][1].replace("McDonald", "Anna").replace("O'Brien", "MacLeod").replace("J. Jean-Pierre", "Dr. Wu"),
        NAMED[3][1].replace("Tom", "Jean-Luc").replace("Mary", "O'Neil"),
    ]
    copies = [f(t) for _, t in NAMED for f in (str.upper, str.lower)]
    got = found(spark, ["Some words before. " + t + " And some after." for t in renamed + copies], NAMED)
    assert [got[i] for i in range(12)] == [[1], [2], [3], [4]] + [[i] for i in (1, 2, 3, 4) for _ in range(2)]
    # One name that stands for two is no copy.
    mixed = "Tom has 5 apples. Anna buys 3 more apples. How many apples does Karl have now?"
    assert found(spark, [mixed, "Tom has a dog. Tom buys more bread. How many hours does Tom sleep now?"], NAMED) == {0: [], 1: []}


def test_leaks_equal_plain_containment(spark):
    """Without slots an item is found where 4/5 of its 5-word windows are."""
    rng = random.Random(4)
    words = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(30)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(6, 20)))) for i in range(12)]
    texts = []
    for _ in range(60):
        w = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(rng.choice(words) for _ in range(20)) + " " + " ".join(w))
    windows = lambda t: [tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)]
    expected = {d: sorted(i for i, x in items if 5 * sum(w in set(windows(t)) for w in windows(x)) >= 4 * len(windows(x))) for d, t in enumerate(texts)}
    assert found(spark, texts, items) == expected and any(expected.values())


def test_leak_edges(spark):
    assert found(spark, []) == {}
    assert found(spark, ["a b c d e"], [(1, "a b"), (2, None), (None, "a b c d e")]) == {0: []}
    assert found(spark, [ITEM], []) == {0: []}


# --- surrogates ----------------------------------------------------------------------------

PRIVATE = (
    "Mr. John Miller (john.miller@mail.example.com, +1 (132) 555-1352) met Mrs Jane Miller; card 4539 1488 0343 6467, SSN 123-45-6789, IP 97.51.17.173, "
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", IBAN DE89 3704 0044 0532 0130 00. Later MR. MILLER wrote from JOHN.MILLER@mail.example.com or +1-132-555-1352. Г-н Иванов.'
)


def luhn(x):
    digits = [int(c) for c in re.sub(r"\D", "", x)][::-1]
    return sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(digits)) % 10 == 0


def test_surrogates(spark):
    rows = [(1, PRIVATE), (2, "mail john.miller@mail.example.com now"), (3, None), (4, ""), (None, "call +1 (132) 555-1352"), (5, "nothing here"), (5, "SSN 123-45-6789")]
    got = surrogates.pseudonymise(docs(spark, rows), "k1").collect()
    text = next(r.text for r in got if r.doc_id == 1)
    for secret in ("john.miller@", "JOHN.MILLER@", "555-1352", "4539 1488 0343 6467", "123-45-6789", "97.51.17.173", "04dbebab91ab", "3704 0044", "John Miller", "Jane Miller", "MR. MILLER"):
        assert not any(secret in (r.text or "") for r in got)
    email = re.search(r"\(([a-z]+\.[a-z]+@[a-z]+\.[a-z]+\.com)", text)[1]
    assert len(email) == len("john.miller@mail.example.com") and next(r.text for r in got if r.doc_id == 2) == f"mail {email} now"
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}),", text)[1]
    assert luhn(card) and card != "4539 1488 0343 6467"
    phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}|\+1-\d{3}-\d{3}-\d{4}", text)
    assert len(phones) == 2 and len({re.sub(r"\D", "", p) for p in phones}) == 1
    assert next(r.text for r in got if r.doc_id is None) == "call " + phones[0]
    names = re.search(r"Mr\. (\w+) (\w+) \(.*Mrs (\w+) (\w+);.*", text, re.S)
    assert names[1] in surrogates.GIVEN["latin"]["m"] and names[3] in surrogates.GIVEN["latin"]["f"] and names[2] == names[4] != "Miller"
    assert re.search(r"SSN \d{3}-\d{2}-\d{4}", text) and re.search(r'"[0-9a-f]{40}"', text) and re.search(r"IBAN DE\d{2} \d{4} ", text)
    assert sorted(r.text or "" for r in got if r.doc_id in (3, 4)) == ["", ""] and "nothing here" in [r.text for r in got]
    again = {r.doc_id: r.text for r in surrogates.pseudonymise(docs(spark, rows[:1]), "k1").collect()}
    other = {r.doc_id: r.text for r in surrogates.pseudonymise(docs(spark, rows[:1]), "k2").collect()}
    assert again[1] == text != other[1]
    assert surrogates.pseudonymise(docs(spark, []), "k").count() == 0


def test_surrogates_of_long_names_and_untitled_mentions(spark):
    rows = [
        (1, "Dr. Anna Maria Schmidt came. Schmidt spoke, Anna wept; SCHMIDT's Smithson stayed."),
        (2, "Mr. J. Smith met Herr Ludwig von Braun and Herr Dr. Weber-Kunz. Braun's car, Smith."),
        (3, "Mr. John Smith left. Smith said: Smithson, not smith."),
        (4, "Smith and Braun of no title stay. Mr. Paul Weiss DE89 3704 0044 0532 0130 00"),
        (5, "MR. JOHN SMITH WAS HERE. Mr. Smith john.smith@mail.example.com, Mr. Smith Joe.Doe@mail.example.com"),
    ]
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs(spark, rows), "k").collect()}
    g, up = r"[A-Z][a-z]+", r"[A-Z]+"
    one = re.fullmatch(rf"Dr\. ({g}) ({g}) ({g}) came\. ({g}) spoke, ({g}) wept; ({up})'s Smithson stayed\.", got[1].text)
    assert one[3] == one[4] == one[6].capitalize() != "Schmidt" and one[1] == one[5] != one[2] and not {"Anna", "Maria"} & {one[1], one[2]} and got[1].n_entities == 4
    two = re.fullmatch(rf"Mr\. [A-Z]\. ({g}) met Herr ({g}) von ({g}) and Herr Dr\. ({g})-{g}\. ({g})'s car, ({g})\.", got[2].text)
    assert two[1] == two[6] != "Smith" and two[3] == two[5] != "Braun" and two[2] in surrogates.GIVEN["latin"]["m"] and two[4] != "Weber" and got[2].n_entities == 5
    three = re.fullmatch(rf"Mr\. ({g}) ({g}) left\. ({g}) said: Smithson, not smith\.", got[3].text)
    assert three[2] == three[3] == two[1] and three[1] != "John"
    assert got[4].text.startswith("Smith and Braun of no title stay. Mr. ") and "Weiss" not in got[4].text and re.search(r" DE\d\d \d{4} ", got[4].text) and "3704" not in got[4].text
    five = re.fullmatch(rf"MR\. ({up}) ({up}) WAS HERE\. Mr\. ({g}) \w{{4}}\.\w{{5}}@\S+, Mr\. ({g}) \w{{3}}\.\w{{3}}@\S+", got[5].text)
    assert five[2].capitalize() == five[3] == five[4] == two[1] and got[5].n_entities == 5


def test_surrogates_stay_distinct(spark):
    """Ten given names of one gender and all numbers of two digits: collisions are certain at first."""
    people = [("given_x", "n%d" % i) for i in range(60)] + [("ssn", "%02d" % i) for i in range(40)]
    got = surrogates.assign(spark.createDataFrame(people + people[:5], "type string, value string"), "k").collect()
    assert len(got) == len({(r.type, r.surrogate) for r in got}) == 100
    values = {(r.type, r.value) for r in got}
    assert not any((r.type, r.surrogate) in values for r in got)


def test_surrogates_of_a_full_format(spark):
    """All one-letter addresses of all one-letter domains: fewer surrogates than entities in their own format."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    values = [f"{a}@{b}.io" for a in letters for b in letters]
    got = surrogates.assign(spark.createDataFrame([("email", v) for v in values], "type string, value string"), "k").collect()
    assert len(got) == 676 == len({r.surrogate for r in got}) and not {r.surrogate for r in got} & set(values)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.io", r.surrogate) for r in got)


def test_surrogates_of_further_entities(spark):
    secret = "sk-" + "aB3" * 8
    text = (
        "Dr Jane Miller called. Later Jane Miller left, and Miller wrote to Anna Schmidt at 12 Oak Street, Lindenstraße 5, phone 030 1234567 or 01 23 45 67 89, "
        f"passport no. C1234567, key {secret}. Mr O'Neill-Smith, Mrs van Dyk. Born 01-02-2003, room 12 of 30 1234567 items."
    )
    got = surrogates.pseudonymise(docs(spark, [(1, text)]), "k").collect()[0]
    for original in ("Miller", "Jane", "Anna", "Schmidt", "Oak", "Linden", "1234567 or", "23 45 67", "C1234567", secret[3:], "Neill", "Dyk"):
        assert original not in got.text, original
    g = r"[A-Z][a-z]+"
    found = re.fullmatch(
        rf"Dr ({g}) ({g}) called\. Later ({g}) ({g}) left, and ({g}) wrote to {g} {g} at \d\d {g} Street, {g}straße \d, phone \d{{3}} \d{{7}} or \d\d \d\d \d\d \d\d \d\d, "
        rf"passport no\. [A-Z]\d{{7}}, key sk-([a-z][A-Z]\d){{8}}\. Mr O'{g}-{g}, Mrs van {g}\. Born 01-02-2003, room 12 of 30 1234567 items\.",
        got.text,
    )
    assert found and found[1] == found[3] and found[2] == found[4] == found[5]


def test_no_entity_of_the_documents_stays(spark):
    """Leaks counted with patterns of their own: no address, number or key that stood in a text stands in its result."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = {r.doc_id: r for r in surrogates.pseudonymise(docs(spark, rows), "k").collect()}
    plain = re.compile(r"[\w.]+@[\w.]+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|\b[0-9a-f]{40}\b|\b\d{3}-\d{2}-\d{4}\b")
    met = 0
    for d, text in rows:
        seen = plain.findall(text or "")
        met += len(seen)
        assert not any(x in got[d].text for x in seen) and (got[d].text == text) == (got[d].n_entities == 0)
    assert met > 5 and len(got) == len(rows)


# --- URL filter ----------------------------------------------------------------------------


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


URLS = ["http://Example.COM/en/1", "https://www.example.com/en/x?y#z", "http://a.www.example.com/en/", "http://example.com", "http://x.net/es/1", "http://x.net/fr/?a", "http://net/es/", "http://xnet/es/", None, "", "no scheme",
        "://", "http://", "http://a.com?x=/", "ftp://É.com/Ä", "http://casino-win.example.org/en/2", "https://thther.example.org/en/9", "http://malware-pirated.example.org/en/2", "http://a://b/c", "http://x.org/a\nb", "x" * 5000 + "://y.org/"]


@pytest.mark.parametrize("literal", [500, 0])
def test_url_rules(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "MAX_LITERAL", literal)
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y")], "page_id long, url string, host string, verdict string")
    got = url_filter.filter_urls(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, (rule, verdict) = brute_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    by = {r.page_id: r.verdict for r in got}
    assert by[16] == "allow" and by[URLS.index("http://malware-pirated.example.org/en/2")] == "block"
    assert url_filter.filter_urls(df.where("false")).count() == 0


def test_url_model_on_held_out_urls(spark):
    """Trained on two thirds of the labelled table, it tells most of the rest apart."""
    rows = sorted(url_filter.TRAINING, key=lambda x: hashlib.md5(x[0].encode()).hexdigest())
    train, held = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    labelled = spark.createDataFrame([*train, (None, 1), ("http://x", None)], "url string, label int")
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
    got = {r.page_id: r.score > 0.5 for r in url_filter.filter_urls(df, rules=[], labelled=labelled).collect()}
    assert sum(got[i] == bool(y) for i, (_, y) in enumerate(held)) >= 0.8 * len(held)


def test_url_model_without_two_kinds_of_labels(spark):
    df = spark.createDataFrame([(1, "http://casino-win.example.org/x"), (2, "http://a.net/es/1")], "page_id long, url string")
    for rows in ([], [("http://a.b/", 1)], [("http://a.b/", 0), ("http://c.d/", None)]):
        labelled = spark.createDataFrame(rows, "url string, label int")
        got = {r.page_id: (r.verdict, r.score) for r in url_filter.filter_urls(df, labelled=labelled).collect()}
        assert got == {1: ("allow", None), 2: ("block", None)}


def test_url_model_on_topics_it_never_saw(spark):
    """Whole topics held out with all their words: what is blocked is mostly right; words that nobody labelled are mostly missed. Most clean pages stay."""
    blocked, allowed = list(url_filter.BLOCKED), list(url_filter.ALLOWED)
    found = []
    for t, a in zip(blocked[:3], allowed[:3]):
        rest = lambda topics, out: {k: v for k, v in topics.items() if k != out}
        held = url_filter.labelled_urls({t: url_filter.BLOCKED[t]}, 1) + url_filter.labelled_urls({a: url_filter.ALLOWED[a]}, 0)
        table = spark.createDataFrame(url_filter.labelled_urls(rest(url_filter.BLOCKED, t), 1) + url_filter.labelled_urls(rest(url_filter.ALLOWED, a), 0), "url string, label int")
        df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(held)], "page_id long, url string")
        found += [(r.verdict == "block", held[r.page_id][1]) for r in url_filter.filter_urls(df, rules=[], labelled=table).collect()]
    hits = sum(p and y == 1 for p, y in found)
    assert hits >= 0.6 * sum(p for p, _ in found) and hits >= 0.1 * sum(y for _, y in found)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("not url rlike 'spam|cheap|pills|casino|bets|ads-track'")
    got = [r.verdict for r in url_filter.filter_urls(pages, rules=[]).collect()]
    assert got.count("block") <= 0.05 * len(got)


# --- chat ----------------------------------------------------------------------------------


def test_chat_rotation(spark):
    rows = [(1, 1, "ann", "hi"), (1, 0, "system", "be kind"), (1, 2, "bob", "é🎉"), (1, 3, "ann", None), (1, 3, "ann", None), (2, 0, "system", "x"), (None, 0, "ann", "a"), (None, 0, "bob", "b"), (3, None, None, "q"), (4, 600, "ann", "late"), (4, 0, "bob", "early")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, mask string")
    got = chat.rotate(df).collect()
    by = {(r.conv_id, r.perspective, r.part): r for r in got if r.conv_id is not None}
    bob = by[1, "bob", 0]
    assert bob.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\né🎉<|im_end|>\n<|im_start|>user name=ann\n<|im_end|>\n"
    assert [bob.text[m.start : m.stop] for m in bob["mask"]] == ["é🎉<|im_end|>"] and bob.mask_chars == len("é🎉<|im_end|>") and bob.n_turns == 4
    assert [by[1, "ann", 0].text[m.start : m.stop] for m in by[1, "ann", 0]["mask"]] == ["hi<|im_end|>", "<|im_end|>"]
    assert not any(k[0] == 2 for k in by) and by[3, "unknown", 0].text.startswith("<|im_start|>assistant\nq")
    assert sorted(r.perspective for r in got if r.conv_id is None) == ["ann", "bob"]
    assert {k for k in by if k[0] == 4} == {(4, p, 0) for p in ("ann", "bob")} and by[4, "bob", 0].n_turns == 2
    assert chat.rotate(df.where("false")).count() == 0


def test_chat_long_dialogue(spark):
    """Parts by rank, whatever the turn numbers; a conversation over several partitions equals a plain rendering."""
    rows = [(1, 1000 * t if t % 7 else None, "system" if t % 50 == 3 else f"p{t % 3}", f"é{t}" * (t % 4)) for t in range(400)]
    rows += [(1, 5, "p1", f"tie {k}") for k in range(60)] + [(2, 9, "p0", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(df, 100).collect()}
    mine = sorted({r for r in rows if r[0] == 1}, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    first = [r for r in mine[:100] if r[2] == "system"]
    assert first and len(got) == 3 * -(-len(mine) // 100) + 1
    for (conv, who, part), r in got.items():
        if conv == 1:
            own = mine[100 * part : 100 * part + 100]
            turns = (first if part else []) + own
            head = [f"<|im_start|>{'assistant' if role == who else 'system' if role == 'system' else 'user name=' + role}\n" for *_, role, _ in turns]
            assert r.text == "".join(h + t[3] + "<|im_end|>\n" for h, t in zip(head, turns)) and (r.n_turns, r.n_context) == (len(own), len(turns) - len(own))
            assert [r.text[m.start : m.stop] for m in r["mask"]] == [t[3] + "<|im_end|>" for t in turns if t[2] == who]


# --- WARC ----------------------------------------------------------------------------------

PAGE = '<html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><p>One<b>two</b> &eacute;<br>x<!-- <a href="no"> --><a class=k href="/p?a=1&amp;b=2">link</a><p title="a>b">end'


def test_warc(spark, tmp_path):
    rows = [(1, "http://h/x/", PAGE), (2, None, None), (None, "u\r\nv", "plain < 3 & more"), (1, "http://h/x/", PAGE)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, body string")
    made = warc.derivatives(warc.responses(pages, "2025-01-01T00:00:00Z"))
    got = made.collect()
    assert len(got) == 8 and Counter(r.record_type for r in got) == {"metadata": 4, "conversion": 4}
    sources = {r.record_id for r in warc.responses(pages).collect()}
    for r in got:
        head = dict(x.split(": ", 1) for x in r.header.split("\r\n")[1:])
        block = r.body.encode()
        assert head["WARC-Refers-To"] == r.refers_to in sources and head["WARC-Record-ID"] == r.record_id
        assert int(head["Content-Length"]) == len(block)
        assert head["WARC-Block-Digest"] == r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert head["WARC-Type"] == r.record_type and head["WARC-Date"] == "2025-01-01T00:00:00Z"
    one = {r.record_type: r for r in got if r.page_id == 1}
    assert one["conversion"].body == "Onetwo é\nxlink\nend"
    assert "title: A & B\r\n" in one["metadata"].body and "outlink: http://h/p?a=1&b=2\r\n" in one["metadata"].body and "source-header: HTTP/1.1 200 OK\r\n" in one["metadata"].body
    assert "outlink: http://h/no" not in one["metadata"].body
    assert one["metadata"].source_digest == "sha1:" + base64.b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    assert next(r.body for r in got if r.page_id is None and r.record_type == "conversion") == "plain < 3 & more"
    assert len({r.record_id for r in got}) == 6
    warc.write_warc(made.orderBy("record_id"), str(tmp_path / "w"))
    import glob
    import gzip

    raw = b"".join(gzip.open(f).read() for f in sorted(glob.glob(str(tmp_path / "w" / "*.gz"))))
    seen = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.0\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        raw, seen = rest[n + 4 :], seen + 1
    assert seen == 8
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


def test_pages_with_open_elements():
    """No text or link is lost where an end tag is left out."""
    link = "<a href=x>y</a>"
    pages = {
        f"<html><head><title>T</title><body><p>All the text</p>{link}</body></html>": "All the text\ny",
        f"<head><meta a='>'><title>T</title><style>p{{}}</style><p>All{link}": "Ally",
        f"<head><script>x</script>\n<title>T</title>bare {link}": "bare y",
        f"<body><noscript>a<p>b{link}": "a\nby",
        f"<p>a<template>b{link}<template>c</template>d": "abyd",
        f"<p>a<svg><svg><path/></svg>no</svg><svg/>b<svg>c{link}": "abcy",
        f"<NOSCRIPT>no</NOSCRIPT>a<noscript>b{link}<svg><noscript>no</noscript>": "aby",
        f"<head><title>T<body>a{link}": "ay",
    }
    for page, text in pages.items():
        assert (warc.plain_text(page), warc.links(page, "http://h/")) == (text, ["http://h/x"]), page
        assert warc.title(page) == ("T" if "<title>" in page else "")
    assert warc.plain_text("<html><head><title>T</title></head><body>" + PAGE) == warc.plain_text(PAGE)


# --- packing -------------------------------------------------------------------------------


def test_differencing():
    rng = random.Random(1)
    for _ in range(50):
        sizes, m = [rng.randint(1, 100) for _ in range(rng.randint(1, 40))], rng.randint(1, 9)
        sets = packing.difference(sizes, m)
        assert sorted(i for s in sets for i in s) == list(range(len(sizes))) and len(sets) == m
    # The classic case: 4, 5, 6, 7, 8 in two.
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in s) for s in packing.difference([4, 5, 6, 7, 8], 2)) == [14, 16]
    sizes = [rng.randint(1, 500) for _ in range(600)]
    packed = packing.pack_group(sizes, 2048)
    assert max(sum(sizes[i] for i in s) for s in packed) <= 2048 and sum(sizes) / len(packed) / 2048 > 0.98
    assert packing.pack_group([], 10) == [] and len(packing.pack_group([7, 7, 7], 10)) == 3


def test_differencing_moves_no_sets_one_by_one():
    """A merge of partial partitions is a fixed number of steps of the interpreter, whatever the number of windows."""
    import sys

    steps = Counter()

    def count(frame, event, arg):
        frame.f_trace_opcodes = frame.f_code is packing.difference.__code__
        steps[event] += frame.f_trace_opcodes
        return count

    before, rng = sys.gettrace(), random.Random(3)
    sizes = [rng.randint(1, 500) for _ in range(600)]
    sys.settrace(count)
    try:
        sets = packing.difference(sizes, 80)
    finally:
        sys.settrace(before)
    assert sorted(i for s in sets for i in s) == list(range(600)) and 0 < steps["opcode"] < 250 * len(sizes)


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(tokenizer_path()), random.Random(2)
    texts = [None, "", " \n ", "Don't L'ÉTÉ İstanbul ΑΣ ('s x y", "a\x1cb <|endoftext|> c", "e\u0301 🎉", "x " * 5000]
    texts += [" ".join(rng.choice(["the", "Cat,", "naïve", "12a", "&&&"]) for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [*enumerate(texts), (None, "null id"), (3, texts[3])]
    got = packing.pack(docs(spark, rows), tokenizer_path(), capacity=256, group_docs=20, keep_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    for d, t in [(d, t) for d, t in rows if d not in (3,)]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(pieces[d], key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
    assert len(pieces[3]) == 2 * len({r.start for r in pieces[3]})
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


def test_thrifty_words_forget_rare_ones(monkeypatch):
    """The same ids, though only what is met twice is remembered, and no more than the limit."""
    rng = random.Random(5)
    rare = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    texts = [" ".join(["The", "same", "words,", "Straße's"] + [rare() + rng.choice([".", ",", ""]) for _ in range(40)]) for _ in range(200)]
    full = packing.Words(tokenizer_path())
    want = list(full.encode(texts))
    for limit in (1 << 17, 100, 2):
        monkeypatch.setattr(packing.Words, "THRIFTY_LIMIT", limit)
        monkeypatch.setattr(packing.Words, "THRIFTY_TEXTS", 10)
        words = packing.Words(tokenizer_path(), thrifty=True)
        assert list(words.encode(texts)) == want == [full.whole(t) for t in texts]
        words._forget()
        assert len(words.words) <= min(limit, 400) and len(words.pieces) <= min(limit, 400) and len(full.words) > 7000


def test_packing_spreads_equal_rows(spark):
    """Rows that can't be told apart still meet in many groups."""
    rows = spark.range(0, 6000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    found = packing.pack(rows, tokenizer_path(), capacity=64, group_docs=500).collect()
    per_group = Counter(r.sequence_id >> 32 for r in found)
    assert len(found) == 6000 and len(per_group) == 12 and max(per_group.values()) < 1000


def test_another_vocabulary_is_encoded_whole(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(str(tmp_path / "t.json"))
    words = packing.Words(str(tmp_path / "t.json"))
    assert not words.fits and [list(np.frombuffer(x, "<u4")) for x in words.encode(["a b x", ""])] == [[0, 1, 2], []]
    assert packing.Words(tokenizer_path()).fits


def test_executors_need_no_copy_of_the_package(tmp_path):
    """Driver with the repository on its path, workers without."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from folio.llm import packing, minhash, decontaminate
docs = spark.createDataFrame([(i, "some words of document %d and a few more" % (i % 3)) for i in range(20)], "doc_id long, text string")
assert packing.pack(docs, {tokenizer_path()!r}).count() >= 20
assert minhash.near_duplicates(docs).where("kept").count() == 3
items = spark.createDataFrame([(1, "some words of document 1 and a few more")], "item_id long, text string")
assert decontaminate.contaminated(docs, items).where("contaminated").count() > 0
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert found.stdout.endswith("done\n"), found.stderr[-2000:]


class PlainText(HTMLParser):
    """Visible text by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template", "svg")
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style", "noscript", "template", "svg")))
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden and self.get_starttag_text() is not None and not re.match(r"<title\b", self.get_starttag_text() or "", re.I):
            self.out.append(data.replace("\n", " "))


BLOCKS = set(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul body html".split()
)


def test_plain_text_equals_that_of_a_parser(spark):
    """All pages of a table: the words of the conversion are those that Python's HTML parser finds."""
    pages = [r.html or "" for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    differ = 0
    for page in pages:
        parser = PlainText()
        parser.feed(page)
        parser.close()
        differ += warc.plain_text(page).split() != "".join(parser.out).split()
    assert len(pages) > 200 and differ == 0


def test_responses_of_warc_files_keep_headers_and_digests(spark, tmp_path):
    def record(kind, uri, block, more=""):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri[-1] * 8}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-05-0{uri[-1]}T00:00:00Z\r\n{more}Content-Length: {len(block)}\r\n\r\n"
        return head.encode() + block + b"\r\n\r\n"

    page = "<html><body><p>Gr\u00fc\u00dfe</p></body></html>"
    one = record("response", "http://a.example/1", b"HTTP/1.1 200 OK\r\nServer: x\r\nContent-Type: text/html; charset=iso-8859-1\r\n\r\n" + page.encode("latin-1"), "WARC-Payload-Digest: sha1:GIVEN\r\n")
    two = record("response", "http://a.example/2", b"HTTP/1.1 404 Not Found\r\n\r\n" + page.encode())
    cut = record("response", "http://a.example/3", b"HTTP/1.1 200 OK\r\n\r\nx").replace(b"Content-Length: 20", b"Content-Length: 99")
    (tmp_path / "w").mkdir()
    with open(tmp_path / "w" / "a.warc", "wb") as f:
        f.write(record("warcinfo", "file:///0", b"software: x\r\n") + one + record("request", "http://a.example/1", b"GET / HTTP/1.1\r\n\r\n"))
    with gzip.open(tmp_path / "w" / "b.warc.gz", "wb") as f:
        f.write(two)
    with open(tmp_path / "w" / "b.warc.gz", "ab") as f:  # a member of its own
        f.write(gzip.compress(cut))
    found = warc.read_responses(spark, str(tmp_path / "w"))
    got = {r.target_uri[-1]: r for r in found.collect()}
    assert {k: r.complete for k, r in got.items()} == {"1": True, "2": True, "3": False}
    assert got["1"].payload == got["2"].payload == page and got["1"].date == "2024-05-01T00:00:00Z"
    made = {(r.target_uri[-1], r.record_type): r for r in warc.derivatives(found).collect()}
    assert made["1", "conversion"].body == "Gr\u00fc\u00dfe" and made["1", "conversion"].source_digest == "sha1:GIVEN"
    assert made["1", "metadata"].body.startswith("source-header: HTTP/1.1 200 OK\r\nsource-header: Server: x\r\nsource-header: Content-Type: text/html; charset=iso-8859-1\r\n")
    assert made["2", "conversion"].source_digest == warc.digest(page.encode()) and made["2", "metadata"].refers_to == "<urn:uuid:22222222>"


SHORT = [(1, "Who wrote Hamlet?"), (2, "Name 3 primes"), (3, "Add 4 and 5"), (4, "too short"), (5, ITEM)]


def test_leaks_of_short_items(spark):
    """Items of three and four tokens: found where they stand as they are, with the same numbers."""
    texts = ["I asked: who wrote HAMLET? Nobody knew.", "name 3 primes", "Name 4 primes", "please add 4 and 5 now", "add 4 and 6", "too short", "Who wrote Macbeth? Hamlet", ITEM]
    tokens = lambda t: re.sub(r"[^\w ]", "", t.lower()).split()
    expected = {}
    for d, t in enumerate(texts):
        w = tokens(t)
        expected[d] = [i for i, x in SHORT if 3 <= len(tokens(x)) < 5 and any(w[k : k + len(tokens(x))] == tokens(x) for k in range(len(w)))]
    expected[7].append(5)
    assert found(spark, texts, SHORT) == expected


def test_leaks_with_windows_that_all_share(spark):
    """A phrase of every item and every document: results are those of plain containment."""
    rng = random.Random(6)
    words = ["w%s" % a for a in "abcdefghijklmnopqrst"]
    stock = "we all know very well that this is so"
    items = [(i, stock + " " + " ".join(rng.choice(words) for _ in range(rng.randint(2, 12)))) for i in range(20)] + [(50, stock)]
    texts = [stock + " " + " ".join(rng.choice(words) for _ in range(15)) for _ in range(40)] + [x + " end" for _, x in items]
    windows = lambda t: [tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)]
    expected = {d: sorted(i for i, x in items if 5 * sum(w in set(windows(t)) for w in windows(x)) >= 4 * len(windows(x))) for d, t in enumerate(texts)}
    assert found(spark, texts, items) == expected
