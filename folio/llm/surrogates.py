"""PII surrogates, in DataFrame functions only.

Entities are found by pattern. Each distinct entity (type and canonical form, so the
same number in two layouts is one entity) gets a replacement drawn from a keyed hash
that keeps its type, script, letter case, length and layout; a card number that passes
the Luhn check gets one that passes it. Names after titles or from a common given name on are
runs of capitalised words, initials and particles of any length; the titles and particles
stay, the last word gets a family name of the same script and each other word a given name
of the title's (or given name's) gender (an initial the first letter of one). Other mentions
of a word of such a name in the same document get the same replacement. The table of
distinct entities is checked for collisions: a replacement that two entities share, or
that is itself an entity of the corpus, is drawn again until all differ, in a wider format
after a few attempts. One entity thus has one replacement everywhere (coreference), and
different entities stay different. Only entities are shuffled for that, and the texts that
have any: each is joined once with the replacements of its own entities.

Which replacement an entity gets depends on the key and, where draws collide, on the other
entities of the corpus. Names without title whose given name isn't on the list aren't found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, parted, release

#: Titles by gender, in the languages of the corpus and in Cyrillic.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "M", "Monsieur", "Señor", "Sr", "Господин", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Srta", "Госпожа", "г-жа"],
    "x": ["Dr", "Prof", "Professor", "Доктор"],
}
#: Given names by script and gender.
GIVEN = {
    "latin": {
        "m": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor", "Walter"],
        "f": ["Alma", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Iris", "Julia", "Laura", "Marta", "Nora", "Olivia", "Rosa", "Vera"],
        "x": ["Alex", "Andrea", "Chris", "Dominique", "Eden", "Jamie", "Kim", "Lou", "Maxime", "Noa", "Robin", "Sacha", "Sam", "Taylor", "Toni", "Yael"],
    },
    "cyrillic": {
        "m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"],
        "f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина"],
        "x": ["Саша", "Женя", "Валя", "Шура", "Слава", "Паша", "Сима", "Тоша"],
    },
}
#: Syllables of generated family names.
SYLLABLES = {
    "latin": ["ba", "den", "fol", "gar", "hel", "kin", "lam", "mor", "nes", "per", "ros", "sel", "tan", "ver", "wil", "zor"],
    "cyrillic": ["ба", "ве", "го", "де", "ки", "ло", "ма", "не", "по", "ра", "се", "ту", "фе", "ха", "чо", "ши"],
}

#: Common given names, from which on a name without title is found.
COMMON = {
    "m": """Alexander Andreas Andrew Anthony Antonio Benjamin Carlos Charles Christian Christopher Daniel David Edward Francisco Frank George Hans Henry Jack
    Jacques James Javier Jean Johannes John José Joseph Juan Jürgen Karl Klaus Luis Manuel Mark Matthew Michael Michel Miguel Nicolas Patrick Paul Pedro Peter
    Philippe Pierre Richard Robert Stefan Stephen Thomas Werner William Wolfgang Алексей Андрей Дмитрий Иван Михаил Николай Сергей""".split(),
    "f": """Alice Amelia Ana Anna Anne Barbara Carmen Catherine Charlotte Christina Claudia Elena Elizabeth Emily Eva Françoise Hannah Heidi Helen Ingrid Isabel
    Jane Jennifer Jessica Karen Katharina Laura Lucy Margaret Maria María Marie Martha Mary Monika Nancy Nathalie Patricia Pilar Rosa Ruth Sabine Sandra Sarah
    Sofia Sophie Susan Ursula Анна Екатерина Елена Мария Наталья Ольга Татьяна""".split(),
}


def _either(words: list[str]) -> str:
    """An alternation of words by their first letter, so that most fail at once."""
    first: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        first.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in first.items())


# Java runs a repeated group by recursion, one level for each turn, unless the group is possessive (``*+``, ``++``). All
# repeats without a small bound are, so that no text can exhaust the stack.

_TITLE_WORDS = [x for ts in TITLES.values() for t in ts for x in (t, t.upper())]
_ALL_TITLES = _either(_TITLE_WORDS)
#: Particles of family names; they stay as they are.
PARTICLES = ["af", "al", "av", "bin", "da", "das", "de", "del", "della", "den", "der", "des", "di", "do", "dos", "du", "el", "ibn", "la", "le", "ten", "ter", "van", "von", "vom", "y", "zu", "zum", "zur", "фон", "де"]
#: Words that end a name, of which a text in capitals has many.
_NO_NAME = "and|are|as|at|but|by|for|from|had|has|have|he|in|is|of|on|or|said|says|she|that|the|they|to|was|were|who|will|with|aus|das|die|hat|ist|mit|und|war|est|et|avec|qui|con|es|fue|que|и|был|была"
#: A capitalised word; an apostrophe or hyphen belongs to it only before a further part, not before a possessive s.
_WORD = r"\p{Lu}(?:\p{L}++|[’'-](?![sS](?!\p{L}))(?=\p{L}))++"
#: The end of a word that isn't the start of an email address or a number.
_STOP = r"(?![\p{L}\d@_]|[._%+-][\p{L}\p{N}._%+-]{0,64}@)"
_NAME = rf"(?!(?iu:{_NO_NAME})(?!\p{{L}})){_WORD}{_STOP}"
_SMALL = rf"(?:(?:\p{{Lu}}\.)++|\p{{Lu}}(?= )|{'|'.join(PARTICLES)})"
#: A word of a name that more of the name follows: a name word, with up to four initials and particles before it.
_PART = rf"(?:{_NAME}|{_SMALL}) (?=(?:{_SMALL} ){{0,4}}+{_NAME})"
#: Titles that may follow a title; a single letter there is an initial.
_FURTHER = _either([t for t in _TITLE_WORDS if len(t) > 1])
_TITLED = rf"(?:{_ALL_TITLES})\.? (?:(?:{_FURTHER})\.? )*+"
_COMMON = _either([x for names in COMMON.values() for x in names])
#: Words that end an English address.
_STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square"
_TITLED_OR_NOT = rf"(?:{_TITLED})?"
_PASSPORT = r"[A-Z0-9]{1,2}\d{6,8}(?![0-9A-Za-z])"
#: Type -> pattern; the first that fits at a place wins.
PATTERNS = {
    # The part before the @ has 64 characters at most, as standards say, so that a long text without one isn't read again from each place. A label of the domain is taken while a further one ends it like a top-level domain.
    "email": r"[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++(?=[\p{L}\p{N}.-]{0,255}\.[A-Za-z]{2}))*+\.[A-Za-z]{2,}+",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
    "token": r"(?<![0-9A-Za-z])(?:(?:sk|pk|rk|ghp|gho|ghs|github_pat|glpat|hf|xox[abprs])[-_][A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![0-9A-Za-z])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)|(?<![\p{L}\d:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\p{L}\d:])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![\d.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ /-]\d{5,8}|0\d{2,4}[ /-]\d{3,4} \d{3,4}|0\d(?:[ .]\d{2}){4})(?![\d])",
    "address": rf"(?<![\p{{L}}\d])\d{{1,5}} (?:\p{{Lu}}\p{{L}}+ ){{1,3}}(?:{_STREETS})(?!\p{{L}})|(?<!\p{{L}})\p{{Lu}}\p{{L}}+(?:straße|strasse|gasse|allee|platz) \d{{1,4}}[a-z]?(?![\p{{L}}\d])",
    "passport": rf"(?={_PASSPORT})(?<=(?i:passport|reisepass|passeport|pasaporte)(?: (?i:no\.?|number|nr\.?|num\.?))?[ :]{{1,2}}){_PASSPORT}",
    "person": rf"(?<!\p{{L}})(?=[\p{{Lu}}г])(?:{_TITLED}|(?=\p{{Lu}})(?:{_COMMON}) )(?:{_PART})*+{_NAME}",
}
#: Where a match can begin: after a match, where no word goes on, or at a capital, digit, ``+`` or ``(``. Inside
#: of words no pattern is tried then, which is most of a text.
_BEGIN = r"(?:\G|(?<![A-Za-z\d])|(?=[\p{Lu}\d+(]))"
_ANY = "|".join(PATTERNS.values())
ENTITY = rf"{_BEGIN}(?:{_ANY})"
#: The same and any other capitalised word, which may mention a name of the same document.
_MENTION = rf"{_BEGIN}(?:{_ANY}|(?<!\p{{L}}){_WORD})"
_ONE_WORD = r"^\p{Lu}[\p{L}’'-]*+$"
#: Patterns that tell a match's type where its own pattern looks at what stands before it.
_ALONE = {"passport": r"[A-Z0-9]{1,2}\d{6,8}"}


def _kind(x: Column) -> Column:
    out = F.lit("person")
    for name, pattern in reversed([(n, p) for n, p in PATTERNS.items() if n != "person"]):
        out = F.when(x.rlike(rf"^(?:{_ALONE.get(name, pattern)})$"), F.lit(name)).otherwise(out)
    return out


def _titles(x: Column) -> Column:
    """The titles of a person with their spaces; empty for a mention without title."""
    return F.regexp_extract(x, rf"^{_TITLED}", 0)


def _gender(x: Column) -> Column:
    """That of the title, else that of a common given name."""
    titles = F.split(F.upper(_titles(x)), r"[. ]+")
    known = lambda g: F.arrays_overlap(titles, F.array(*(F.lit(t.upper()) for t in TITLES[g])))
    named = lambda g: x.rlike(rf"^{_TITLED_OR_NOT}(?:{'|'.join(COMMON[g])})(?!\p{{L}})")
    return F.when(known("m"), "m").when(known("f"), "f").when(named("m"), "m").when(named("f"), "f").otherwise("x")


def _words(x: Column) -> Column:
    """The words of a person's name: array of (word, type); the last is the family name, the type of a particle is null."""
    words = F.split(F.substr(x, F.length(_titles(x)) + 1), " ")

    def one(w: Column) -> Column:
        return F.transform(w, lambda v, i: F.struct(v.alias("word"), F.when(i == F.size(w) - 1, F.lit("family")).when(~F.lower(v).isin(PARTICLES), F.lit("given")).alias("type")))

    return let(words, one)


def _parts(word: Column) -> Column:
    """The parts of a double name; each is a name of its own."""
    return F.split(word, "-")


def _value(part: Column) -> Column:
    """The canonical form of a name: lower case, one kind of apostrophe."""
    return F.replace(F.lower(part), F.lit("’"), F.lit("'"))


def _entities(x: Column) -> Column:
    """The entities of a match: array of (type, value, gender). A person has a family name, and given names or initials before it; gender is that
    of the title or of a common given name, for given names only."""
    kind = _kind(x)

    def person(gender: Column) -> Column:
        named = F.filter(_words(x), lambda e: e["type"].isNotNull())
        one = lambda e, p: F.struct(e["type"].alias("type"), _value(p).alias("value"), F.when(e["type"] == "given", gender).alias("gender"))
        return F.flatten(F.transform(named, lambda e: F.transform(_parts(e["word"]), lambda p: one(e, p))))

    value = (
        F.when(kind.isin("email", "address"), F.lower(x)).when(kind.isin("secret", "token", "ip"), x)
        .when(kind == "phone", F.regexp_replace(x, r"[^\d+]", "")).otherwise(F.regexp_replace(x, r"[^0-9A-Z]", ""))
    )
    other = F.array(F.struct(kind.alias("type"), value.alias("value"), F.lit(None).cast("string").alias("gender")))
    return F.when(kind == "person", let(_gender(x), person)).otherwise(other)


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))


def _same_shape(text: Column, seed: Column, hexadecimal: bool = False) -> Column:
    """Every letter and digit replaced by one of its kind; other characters stay."""
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(c: Column, i: Column) -> Column:
        if hexadecimal:
            return F.when(c == ":", c).when(c.rlike("[A-F]"), _pick("ABCDEF", seed, i)).when(c.rlike("[a-f]"), _pick("abcdef", seed, i)).otherwise(_pick(digit, seed, i))
        return F.when(c.rlike(r"\d"), _pick(digit, seed, i)).when(c.rlike(r"\p{Lu}"), _pick(upper, seed, i)).when(c.rlike(r"\p{L}"), _pick(lower, seed, i)).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    chars = F.reverse(F.filter(F.split(digits, ""), lambda c: c != ""))
    parts = F.transform(chars, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.pmod(F.aggregate(parts, F.lit(0), lambda a, b: a + b), F.lit(10))


def _card(value: Column, seed: Column) -> Column:
    body = _same_shape(F.substring(value, 1, 64).substr(F.lit(1), F.length(value) - 1), seed)

    def finish(b: Column) -> Column:
        check = F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10))
        # A number that fails the check gets one that fails it too.
        last = F.when(_luhn(value) == 0, check).otherwise(F.pmod(check + 1 + _draw(seed, 99, 9), F.lit(10)))
        return F.concat(b, last.cast("string"))

    return let(body, finish)


def _mod97(text: Column) -> Column:
    """The number that capitals (A is 10) and digits spell, modulo 97."""
    code = lambda c: F.ascii(c) - F.when(c.rlike("[A-Z]"), 55).otherwise(48)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[A-Z]"), 100).otherwise(10) + code(c), F.lit(97)))


def _iban(value: Column, seed: Column) -> Column:
    """The country stays; check digits fit if the original's do."""
    country = F.substring(value, 1, 2)

    def finish(body: Column) -> Column:
        check = 98 - _mod97(F.concat(body, country, F.lit("00")))
        valid = _mod97(F.concat(F.substring(value, 5, 64), country, F.substring(value, 3, 2))) == 1
        return F.concat(country, F.lpad(F.when(valid, check).otherwise(F.pmod(check + 1, F.lit(97))).cast("string"), 2, "0"), body)

    return let(_same_shape(F.substring(value, 5, 64), seed), finish)


#: Country codes of the telephone network; all others have three digits.
COUNTRY_CODE = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}))"


def _names(options: list[str], seed: Column, i: int) -> Column:
    return F.get(F.array(*(F.lit(x) for x in options)), _draw(seed, i, len(options)))


def _by_script(value: Column, make) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), make("cyrillic")).otherwise(make("latin"))


#: Attempts in an entity's own format, and the most attempts; later formats are longer by a character each, so
#: every attempt but a few leaves most of those that are still pending with a surrogate.
WIDEN_AFTER, MAX_ATTEMPTS = 2, 40


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """The replacement of an entity in canonical form, drawn with ``key`` for the given attempt."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(attempt))), 256)
    # After a few attempts the format is wider: its own space may be full.
    more = max(0, attempt - WIDEN_AFTER)
    extra = F.concat(F.lit(""), *(_pick("abcdefghijklmnopqrstuvwxyz", seed, F.lit(1000 + i)) for i in range(more)))
    digits = F.concat(F.lit(""), *(_pick("0123456789", seed, F.lit(1000 + i)) for i in range(more)))

    def family(script: str) -> Column:
        parts = [_names(SYLLABLES[script], seed, i) for i in range(3 + attempt)]
        return F.concat(*parts)

    def given(script: str, gender: str) -> Column:
        first = _names(GIVEN[script][gender], seed, 0)
        return F.lower(first if not attempt else F.concat_ws("-", first, *(_names(GIVEN[script][gender], seed, i) for i in range(1, attempt + 1))))

    at = F.instr(value, "@")
    domain = F.regexp_extract(value, r"@(.*)\.[^.]*$", 1)
    # One domain has one replacement, unless that leaves no address free.
    domain_seed = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("domain"), domain, F.lit(str(attempt))), 256)
    email = F.concat(_same_shape(F.substr(value, F.lit(1), at - 1), seed), extra, F.lit("@"), _same_shape(domain, domain_seed), F.regexp_extract(value, r"(\.[^.@]*)$", 1))
    ip = F.when(F.contains(value, F.lit(":")), _same_shape(value, seed, hexadecimal=True)).otherwise(F.concat_ws(".", *((_draw(seed, i, 254) + 1).cast("string") for i in range(4))))
    iban = F.concat(_iban(value, seed), digits)
    # The country code of an international number stays.
    code = F.regexp_extract(value, COUNTRY_CODE, 1)
    phone = F.concat(code, _same_shape(F.substr(value, F.length(code) + 1), seed), digits)
    mark = F.regexp_extract(value, r"^(AKIA|eyJ|[a-z_]+[-_])", 1)
    token = F.concat(mark, _same_shape(F.substr(value, F.length(mark) + 1), seed))
    shaped = F.concat(_same_shape(value, seed), digits)
    number = F.concat(_same_shape(F.regexp_extract(value, r"(\d+)", 1), seed), digits, F.regexp_extract(value, r"\d([a-z]?)$", 1))
    english = F.concat(number, F.lit(" "), family("latin"), F.lit(" "), F.substring_index(value, " ", -1))
    german = F.concat(family("latin"), F.regexp_extract(value, r"(straße|strasse|gasse|allee|platz) ", 1), F.lit(" "), number)
    address = F.when(value.rlike(r"^\d"), english).otherwise(german)
    out = F.when(kind == "email", email).when(kind == "secret", _same_shape(value, seed, hexadecimal=True)).when(kind == "ip", ip)
    out = out.when(kind == "iban", iban).when(kind == "card", _card(value, seed)).when(kind.isin("ssn", "passport"), shaped)
    out = out.when(kind == "phone", phone).when(kind == "token", token).when(kind == "address", address)
    for gender in ("m", "f", "x"):
        out = out.when(kind == f"given_{gender}", _by_script(value, lambda s, g=gender: given(s, g)))
    return out.otherwise(_by_script(value, family))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate) of distinct entities (type, value): surrogates differ from each other and from all entities of their type."""
    entities = materialise(entities.distinct(), "entities")
    pending, done, attempt = entities, None, 0
    while True:
        if attempt == MAX_ATTEMPTS:
            raise RuntimeError(f"no free surrogates after {attempt} attempts")
        drawn = materialise(pending.withColumn("surrogate", surrogate(F.col("type"), F.col("value"), key, attempt)), "drawn")
        # The smallest value of those that share a surrogate keeps it.
        first = drawn.groupBy("type", "surrogate").agg(F.min("value").alias("value"))
        first = first.join(entities.select("type", F.col("value").alias("surrogate")), ["type", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        first = first.select("type", "value", "surrogate")
        now = materialise(first if done is None else done.unionByName(first), "assigned")
        release(drawn, *([done] if done is not None else []))
        done = now
        pending = entities.join(done, ["type", "value"], "left_anti")
        if pending.isEmpty():
            release(entities)
            return done
        attempt += 1


def _lay_out(match: Column, plain: Column) -> Column:
    """Put the characters of ``plain`` into the layout of ``match`` (its separators stay)."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        solid = c.rlike(r"[0-9A-Za-z+]")
        return F.struct(F.concat(acc["out"], F.when(solid, F.substr(plain, acc["i"], F.lit(1))).otherwise(c)).alias("out"), (acc["i"] + solid.cast("int")).alias("i"))

    # What a wider format has beyond the layout comes last.
    return F.aggregate(F.filter(F.split(match, ""), lambda c: c != ""), start, put, lambda a: F.concat(a["out"], F.substr(plain, a["i"])))


def _cased(like: Column, name: Column) -> Column:
    """``name`` with the letter case of ``like`` and its apostrophes and hyphens: the first part of several letters gets the whole name, later ones syllables."""
    def joined(at: Column) -> Column:
        lead = F.when(F.length(F.get(at["parts"], F.lit(0))) == 1, 1).otherwise(0)

        def one(p: Column, i: Column) -> Column:
            def syllables(script: str) -> Column:
                return F.concat(*(F.get(F.array(*(F.lit(x) for x in SYLLABLES[script])), F.pmod(F.xxhash64(name, i, F.lit(k)), F.lit(len(SYLLABLES[script]))).cast("int")) for k in range(2)))

            new = F.when(F.length(p) == 1, p).when(i == lead, name).otherwise(_by_script(name, syllables))
            return F.concat(new, F.coalesce(F.get(at["marks"], i), F.lit("")))

        return F.when(F.size(at["parts"]) > 1, F.array_join(F.transform(at["parts"], one), "")).otherwise(name)

    plain = let(F.struct(F.split(like, "[’'-]").alias("parts"), F.regexp_extract_all(like, F.lit("([’'-])"), F.lit(1)).alias("marks")), joined)
    # Every part begins with a capital.
    capital = F.array_join(F.transform(F.split(F.regexp_replace(plain, "([’'-])", "$1\x00"), "\x00"), F.initcap), "")
    return F.when(F.upper(like) == like, F.upper(plain)).otherwise(capital)


def _render(x: Column, table: Column) -> Column:
    """The replacement of a match; null for a capitalised word that names nobody of the document."""

    def look(kind: Column, value: Column) -> Column:
        return F.element_at(table, F.concat(kind, F.lit(":"), value))

    def name(e: Column) -> Column:
        def part(p: Column) -> Column:
            return let(look(e["type"], _value(p)), lambda new: F.when(new.isNull(), p).when(p.rlike(r"^(?:\p{Lu}\.)++$|^\p{Lu}$"), F.regexp_replace(p, r"\p{Lu}", F.upper(F.substring(new, 1, 1)))).otherwise(_cased(p, new)))

        return F.when(e["type"].isNull(), e["word"]).otherwise(F.array_join(F.transform(_parts(e["word"]), part), "-"))

    # A mention without title is one word: a family name if it is one, else a given name.
    known = lambda p: F.coalesce(look(F.lit("family"), _value(p)), look(F.lit("given"), _value(p)))
    replaced = F.transform(_parts(x), lambda p: F.struct(p.alias("p"), known(p).alias("new")))
    mention = let(replaced, lambda ps: F.when(F.exists(ps, lambda e: e["new"].isNotNull()), F.array_join(F.transform(ps, lambda e: F.coalesce(_cased(e["p"], e["new"]), e["p"])), "-")))

    def by_kind(kind: Column) -> Column:
        titled = F.concat(_titles(x), F.array_join(F.transform(_words(x), name), " "))
        other = let(_entities(x)[0], lambda e: F.when(kind.isin("email", "secret", "token", "ip"), look(e["type"], e["value"])).when(kind == "address", F.initcap(look(e["type"], e["value"]))).otherwise(_lay_out(x, look(e["type"], e["value"]))))
        return F.when(kind == "person", titled).otherwise(F.coalesce(other, F.lit("")))

    return F.when(x.rlike(_ONE_WORD), mention).otherwise(let(_kind(x), by_kind))


#: Put around each match, to cut a text at them in one pass; a text that has it already is cut by the pattern itself.
_MARK = "\ue000"


def _replaced(text: Column, table: Column) -> Column:
    """(text, n) with all entities and mentions replaced, n of them."""
    marked = F.regexp_replace(text, F.lit(_MENTION), F.lit(f"{_MARK}$0{_MARK}"))
    cut = F.split(marked, _MARK, -1)
    gaps = F.when(F.contains(text, F.lit(_MARK)), F.split(text, _MENTION, -1)).otherwise(F.filter(cut, lambda p, i: i % 2 == 0))
    hits = F.when(F.contains(text, F.lit(_MARK)), F.regexp_extract_all(text, F.lit(_MENTION), F.lit(0))).otherwise(F.filter(cut, lambda p, i: i % 2 == 1))

    def put(at: Column) -> Column:
        new = F.transform(at["hits"], lambda x: _render(x, table))
        return let(
            F.struct(at["gaps"].alias("gaps"), at["hits"].alias("hits"), new.alias("new")),
            lambda a: F.struct(
                F.array_join(F.flatten(F.zip_with(a["gaps"], F.zip_with(a["hits"], a["new"], lambda h, n: F.coalesce(n, h)), lambda g, h: F.array(g, F.coalesce(h, F.lit(""))))), "").alias("text"),
                F.size(F.filter(a["new"], lambda n: n.isNotNull())).cast("long").alias("n"),
            ),
        )

    return let(F.struct(gaps.alias("gaps"), hits.alias("hits")), put)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replace all detected entities of ``docs`` (doc_id, text).

    Returns doc_id, text, n_entities (mentions), types (sorted, distinct), one row per
    input row. A null text stays null and has no entities; rows with a null doc_id and repeated rows are
    treated like all others; texts of one doc_id are independent documents. The same key gives the same replacements for the same
    corpus; another key gives others; keep it secret. An empty table gives no rows.
    """
    if not key:
        raise ValueError("a key is needed")
    found = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    # A document is named by its id (which may be null) and its text.
    rows = docs.select(F.col("doc_id"), F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__doc"), F.xxhash64("text").alias("__text"))
    own = ["__doc", "__text"]
    met = rows.select(*own, F.explode_outer(F.array_distinct(F.flatten(F.transform(found, _entities)))).alias("e")).where("e.value is not null").select(*own, "e.type", "e.value", "e.gender")
    met = materialise(met, "mentions")
    # A given name has one gender in the whole corpus; one that is used for both, or tells none, is neutral.
    has = lambda g: F.max(F.when(F.col("gender") == g, 1).otherwise(0))
    gendered = met.groupBy("type", "value").agg((has("m") - has("f")).alias("g"))
    whole = F.when(F.col("type") == "given", F.when(F.col("g") > 0, "given_m").when(F.col("g") < 0, "given_f").otherwise("given_x")).otherwise(F.col("type"))
    given = assign(gendered.select(whole.alias("type"), "value"), key)
    keyed = given.select(F.regexp_replace("type", "^given_.$", "given").alias("type"), "value", "surrogate")
    entry = F.struct(F.concat("type", F.lit(":"), "value").alias("k"), F.col("surrogate").alias("v"))
    types = F.sort_array(F.collect_set(F.when(F.col("type") == "given", F.concat(F.lit("given_"), F.coalesce("gender", F.lit("x")))).otherwise(F.col("type"))))
    tables = met.join(keyed, ["type", "value"]).groupBy(*own).agg(F.map_from_entries(F.collect_set(entry)).alias("__table"), types.alias("types"))
    tables = materialise(tables, "tables")
    release(met, given)
    # Only texts with entities (and a few more) move to their tables.
    touched, others = parted(rows, tables.select("__text").distinct(), "__text")
    joined = touched.join(tables, own, "left")

    changed = _replaced(F.col("text"), F.col("__table"))
    same = F.struct(F.col("text"), F.lit(0).cast("long").alias("n"))
    none = F.array().cast("array<string>")
    out = F.when(F.col("__table").isNotNull(), changed).otherwise(same)
    a = joined.select("doc_id", out.alias("o"), F.coalesce("types", none).alias("types")).select("doc_id", "o.text", F.col("o.n").alias("n_entities"), "types")
    return a.unionByName(others.select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), none.alias("types")))
