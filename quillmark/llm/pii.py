"""Surrogates for personal data, with built-in functions only.

E-mail addresses, phone and identity numbers, payment cards, IPv4 and IPv6
addresses, account numbers (IBAN) and names after a form of address are replaced
by keyed surrogates of the same type, script and format: letters stay letters of
their script and case, digits stay digits, separators, country codes and forms
of address stay, names keep their gender, a card keeps its first digit, cards
and IBANs whether their check digits are right.  A host keeps its labels in
shape and its last one, under the reserved name ``example``.  An entity is
replaced alike wherever it occurs, a surname also with and without given name,
and in the same document without form of address.  Particles stay; initials
become other letters.

An entity's surrogate belongs to its normal form, and is written in the form
that was printed: numbers are one entity whatever their separators (a leading 00
is a +, a bracketed trunk zero isn't part of it), as are addresses and names
whatever their case.

Characters are replaced by a keyed permutation of all texts of the same format
(a Feistel network over the characters), so two entities of one format never
meet by the first draw, which depends on the key and the entity only.  All
distinct entities but initials are then checked against each other's surrogates
and against all real entities of the table; where two meet, the later one draws
again, which therefore depends on the table too.  Where a format is nearly used
up the surrogate grows by a character (addresses: is drawn from all addresses),
so every entity finds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Texts with redrawn tokens that are broadcast at most; more are joined by shuffle.
BROADCAST_TEXTS = 100_000
#: Draws of one length before the surrogate grows.
DRAWS = 3
ROUNDS = 4

# Forms of address, given names by gender and syllables of surnames.
MALE_TITLES = "Mr|MR|Herr|HERR|Monsieur|MONSIEUR|Señor|SEÑOR|Sr|Господин|ГОСПОДИН|Г-н"
FEMALE_TITLES = "Mrs|MRS|Ms|Miss|MISS|Frau|FRAU|Madame|MADAME|Mme|MME|Señora|SEÑORA|Sra|Госпожа|ГОСПОЖА|Г-жа"
#: Country codes of telephone numbers.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
GIVEN = {
    ("m", "latin"): "Adrian Bruno Carlo David Elias Felix Gregor Hugo Ivan Jonas Konrad Lukas Martin Noel Oscar Pavel Quentin Robert Simon Tomas Ulrich Victor Walter Xavier",
    ("f", "latin"): "Alina Beatrix Clara Daria Elena Frida Greta Helena Irina Julia Karin Laura Marta Nadia Olivia Paula Rosa Sonia Teresa Ursula Vera Wanda Xenia Yvonne",
    ("m", "cyrillic"): "Андрей Борис Виктор Григорий Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Степан Тимур",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья",
}
SYLLABLES = {
    "latin": "bal cor den far gil har jan kel lor mar nor pel ran sol tor var wen zan ber dor fen hol kar lin mon ner pol ros sten tam val wil",
    "cyrillic": "бал вер гор дан жар зим кар лов мар нев пор рад сев тар фед чер",
}
ENDINGS = {"latin": "berg dale er field ford man mont ner son ton well wick", "cyrillic": "ов ев ин ко ский чук"}

_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_IPV6 = r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![\p{L}\p{N}:])"
_PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_CARD = r"(?<![\p{L}\d-])(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<![\p{L}\d-])\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)|(?<![\p{L}\d.-])\d{13,19}(?![\p{L}\d])"
# Without + and brackets: 3-3-4, 3-2-4 (identity numbers), the prefix 00, the trunk prefix 0 with an area code, and five pairs.
_NATIONAL = (
    r"(?<![\p{L}\p{N}_+/-])(?<!\d[.,])(?:(?:1[ .-])?(?:\d{3}-\d{2,3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3}[ -]\d{4})|00[1-9]\d{0,2}(?:[ -]\d{2,8}){2,4}"
    r"|0[1-9]\d{1,3}(?:[ /-]\d{6,8}|[ /-]\d{3}(?: \d{2}){2}|[ /-]\d{3,4}[ -]\d{3,5}(?:[ -]\d{2,4})?)|0[1-9](?:(?: \d{2}){4}|(?:\.\d{2}){4}|(?:-\d{2}){4}))(?![\p{L}\d]|[.,-]\d)"
)
_TRUNK = r"(?<![\d+])\+\d{1,3}[ .-]?\(0\)[ .-]?\d{2,5}(?:[ /.-]?\d{2,8}){1,3}(?!\d)"
PARTICLES = "von|van|vom|vander|der|den|dem|de|del|della|di|da|do|dos|das|du|des|la|le|les|zu|zum|zur|ten|ter|bin|ibn|al|el|af|av|и|фон"
_HONORIFIC = r"(?:(?:Dr|DR|Prof|PROF|Professor|Doctor|Доктор|Профессор)\.? )*"
_WORD = r"(?:d['’]|[ae]l-)?\p{Lu}[\p{L}'’-]+"
_BEFORE = rf"(?:\p{{Lu}}(?:\.[ -]?| )|(?:{PARTICLES}) ){{0,4}}"
_TITLE = rf"(?:(?:{MALE_TITLES}|{FEMALE_TITLES})\.? {_HONORIFIC}|{_HONORIFIC[:-1]}+)"
_NAME = rf"(?<!\p{{L}}){_TITLE}{_BEFORE}{_WORD}(?: {_BEFORE}{_WORD}){{0,4}}"
ENTITY = f"{_EMAIL}|{_IP}|{_IPV6}|{_TRUNK}|{_PHONE}|{_IBAN}|{_CARD}|{_NATIONAL}|{_NAME}"
#: A cheap test that any text with an entity passes.
MAYBE = rf"@|\d\.\d|[+(]\d|\d{{4}}|\d{{2}}[ ./-]\d{{2}}|::?[0-9A-Fa-f]{{1,4}}:|[0-9A-Fa-f]::|(?:{MALE_TITLES}|{FEMALE_TITLES}|Dr|DR|Prof|PROF|Professor|Doctor|Доктор|Профессор)\.? [\p{{L}}]"


def kind_of(entity: Column) -> Column:
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(entity.rlike(r"^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), "ipv6")
        .when(entity.rlike(r"^(?:\d{4}[ -]){3}\d{1,7}$|^\d{4}[ -]\d{6}[ -]\d{4,5}$|^\d{13,19}$"), "card")
        .when(entity.rlike(r"^[+(\d]"), "phone")
        .when(entity.rlike(r"^[A-Z]{2}\d"), "iban")
        .otherwise("name")
    )


def _digest(*seed) -> Column:
    """A keyed digest of 128 hexadecimal digits; the key comes first."""
    parts = [s if isinstance(s, Column) else F.lit(s) for s in seed]
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary"), 512)


def _number(digest: Column, place) -> Column:
    """A number of 32 bits from a digest; up to 30 places have their own."""
    at = place % 30 * 4 + 1 if isinstance(place, Column) else F.lit(place % 30 * 4 + 1)
    return F.conv(F.substring(digest, at, F.lit(8)), 16, 10).cast("long")


def _word(words: str, number: Column) -> Column:
    options = words.split()
    return F.element_at(F.array(*map(F.lit, options)), (number % len(options) + 1).cast("int"))


def _alphabet(first: str, last: str) -> str:
    return "".join(map(chr, range(ord(first), ord(last) + 1)))


#: Characters are replaced within these, by their kind.
ALPHABETS = ("0123456789", *(_alphabet(a, z).replace("ς", "").replace("\u03a2", "") for a, z in (("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"))))
HEXADECIMAL = ("0123456789abcdef",)


def _coded(c: Column, alphabets: tuple[str, ...]) -> Column:
    """struct<k, v>: the character's alphabet, from 1, and its place there; k 0: it stays."""

    def code(k: int, v: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), v.cast("int").alias("v"))

    out = F.when(c.isin(*alphabets[0]), code(1, F.position(c, F.lit(alphabets[0])) - 1))
    for k, letters in enumerate(alphabets[1:], 2):
        out = out.when(c.between(letters[0], letters[-1]), code(k, F.greatest(F.position(c, F.lit(letters)) - 1, F.lit(0))))
    if len(alphabets) > 1:  # other letters become plain ones of their case
        out = out.when(c.rlike(r"\p{Ll}"), code(2, F.ascii(c) % 26)).when(c.rlike(r"\p{Lu}"), code(3, F.ascii(c) % 26))
    return out.otherwise(code(0, F.lit(0)))


def _feistel(coded: Column, sizes: Column, *seed) -> Column:
    """A keyed permutation of array<struct<k, v>>: in each round every other place moves on by numbers that depend on the rest."""
    kinds = F.array_join(F.transform(coded, lambda x: x["k"].cast("string")), "")

    def turn(now: Column, r: Column) -> Column:
        rest = F.array_join(F.transform(F.filter(now, lambda _, i: i % 2 != r % 2), lambda x: x["v"].cast("string")), ",")

        def moved(digest: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                size = F.element_at(sizes, F.greatest(x["k"], F.lit(1)))
                on = ((x["v"] + _number(digest, i)) % size).cast("int")
                return F.struct(x["k"].alias("k"), F.when((x["k"] > 0) & (i % 2 == r % 2), on).otherwise(x["v"]).alias("v"))

            return F.transform(now, one)

        # the digest is computed once, as the element of an array
        return F.element_at(F.transform(F.array(_digest(*seed, kinds, r, rest)), moved), 1)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), coded, turn)


def _shaped(text: Column, *seed, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """Each digit and letter replaced by another of its kind; other characters stay."""
    chars = F.split(text, "")
    letters = F.array(*map(F.lit, alphabets))
    moved = _feistel(F.transform(chars, lambda c: _coded(c, alphabets)), F.array(*(F.lit(len(a)) for a in alphabets)), *seed)
    out = F.zip_with(chars, moved, lambda c, x: F.when(x["k"] > 0, F.substring(F.element_at(letters, F.greatest(x["k"], F.lit(1))), x["v"] + 1, F.lit(1))).otherwise(c))
    return F.when(text == "", "").otherwise(F.array_join(out, ""))


def _octets(text: Column, *seed) -> Column:
    """An IPv4 address whose parts from 1 to 254 are replaced within these."""

    def coded(x: Column) -> Column:
        n = x.cast("int")
        inner = n.between(1, 254)
        return F.struct(inner.cast("int").alias("k"), F.when(inner, n - 1).otherwise(n).alias("v"))

    moved = _feistel(F.transform(F.split(text, r"\."), coded), F.array(F.lit(254)), *seed)
    return F.array_join(F.transform(moved, lambda x: (x["v"] + x["k"]).cast("string")), ".")


def _check97(text: Column) -> Column:
    """An account number's characters, letters as 10 to 35, modulo 97."""

    def step(sum_: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.when(digit, sum_ * 10 + c.cast("int")).otherwise(sum_ * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(entity: Column, *seed) -> Column:
    """Country and format stay; check digits are right if they were, else wrong."""
    plain = F.regexp_replace(entity, " ", "")
    valid = _check97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1
    body = _shaped(F.substring(entity, F.lit(5), F.length(entity)), *seed)
    digits = F.regexp_replace(body, " ", "")
    right = F.lpad((98 - _check97(F.concat(digits, F.substring(entity, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    drawn = _shaped(F.substring(entity, F.lit(3), F.lit(2)), *seed, "check")
    wrong = F.when(drawn == right, F.lpad(((drawn.cast("int") + 1) % 97 + 2).cast("string"), 2, "0")).otherwise(drawn)
    return F.concat(F.substring(entity, 1, 2), F.when(valid, right).otherwise(wrong), body)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    flags = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(flags, F.lit(0), lambda s, x: s + x) % 10


def _card(entity: Column, *seed) -> Column:
    """The first digit and the format stay; the check digit is right if it was, else wrong."""
    drawn = F.concat(F.substring(entity, 1, 1), _shaped(F.substring(entity, F.lit(2), F.length(entity) - 2), *seed))
    digits = F.regexp_replace(drawn, r"\D", "")
    check = (10 - _luhn(F.concat(digits, F.lit("0")))) % 10
    valid = _luhn(F.regexp_replace(entity, r"\D", "")) == 0
    other = _number(_digest(*seed, "last", entity), 0) % 9 + 1
    return F.concat(drawn, F.when(valid, check).otherwise((check + other) % 10).cast("int").cast("string"))


def _surname(script: str, attempt: Column, *seed) -> Column:
    digest = _digest(*seed)
    words = [_word(SYLLABLES[script], _number(digest, 4 * i)) for i in range(2)]
    # attempts 1 to 3 have one more syllable, 4 to 6 two, and so on
    more = F.array_join(F.transform(F.slice(F.array(*map(F.lit, range(2, 30))), 1, ((attempt + 2) / DRAWS).cast("int")), lambda i: _word(SYLLABLES[script], _number(digest, i * 4))), "")
    return F.concat(words[0], words[1], more, _word(ENDINGS[script], _number(digest, 16)))


def normal_form(kind: Column, token: Column) -> Column:
    """What all printed forms of a token have in common."""
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, r"\(0\)", ""), "^00", "+"), r"[^\d+]", "")
    spaced = F.regexp_replace(token, " ", "")
    return F.when(kind.isin("phone", "card"), digits).when(kind == "iban", spaced).when(kind.isin("ip", "initial", "particle"), token).otherwise(F.lower(token))


def _laid_out(printed: Column, marks: str, text: Column) -> Column:
    """``text`` in place of the characters of ``printed`` that match ``marks``; what is left of it follows the last one."""
    between = F.split(printed, marks, -1)
    n = F.size(between) - 1
    chars = F.concat(F.split(F.substring(text, F.lit(1), n - 1), ""), F.array(F.substring(text, n, F.length(text)), F.lit("")))
    chars = F.when(n > 1, chars).otherwise(F.array(text, F.lit("")))
    return F.array_join(F.zip_with(between, chars, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def _cased(printed: Column, text: Column) -> Column:
    """``text`` with capitals where ``printed`` has them."""
    chars = F.zip_with(F.split(printed, ""), F.split(text, ""), lambda p, c: F.when(p.rlike(r"\p{Lu}"), F.upper(c)).otherwise(F.coalesce(c, F.lit(""))))
    return F.when(printed.rlike(r"\p{Lu}"), F.array_join(chars, "")).otherwise(text)


def rendered(kind: Column, printed: Column, text: Column) -> Column:
    """A surrogate in normal form, written as ``printed`` is."""
    # what isn't part of the number is set aside and put back
    aside = F.regexp_replace(F.regexp_replace(printed, r"\(0\)", "(\u0001)"), "^00", "\u0002")
    phone = F.replace(F.replace(_laid_out(aside, r"\d", F.ltrim(text, F.lit("+"))), F.lit("\u0001"), F.lit("0")), F.lit("\u0002"), F.lit("00"))
    local, host = F.substring_index(printed, "@", 1), F.substring_index(printed, "@", -1)
    own, labels = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    email = F.when(F.upper(printed) == printed, F.upper(text)).otherwise(F.concat(_cased(local, own), F.lit("@"), _cased(host, labels)))
    words = F.array_join(F.transform(F.split(text, "-"), lambda w: F.initcap(w)), "-")
    name = F.when(F.upper(printed) == printed, F.upper(text)).otherwise(words)
    out = F.when(kind == "phone", phone).when(kind == "card", _laid_out(printed, r"\d", text)).when(kind == "iban", _laid_out(printed, "[A-Z0-9]", text))
    out = out.when(kind == "email", email).when(kind == "ipv6", F.when(printed.rlike("[A-F]"), F.upper(text)).otherwise(text))
    return out.when(kind.isin("ip", "initial", "particle"), text).otherwise(name)


def surrogate(key: str, kind: Column, token: Column, attempt: Column) -> Column:
    """The ``attempt``-th surrogate of a token in normal form, in normal form."""
    seed = (key, kind, attempt)
    local, host = F.substring_index(token, "@", 1), F.substring_index(token, "@", -1)
    tld = F.substring_index(host, ".", -1)
    labels = F.regexp_replace(F.substring(host, F.lit(1), F.length(host) - F.length(tld) - 1), r"\.example$", "")
    longer = F.repeat(F.lit("0"), F.greatest((attempt / DRAWS).cast("int"), F.lit(0)))
    letters = F.translate(longer, "0", "a")
    email = F.concat(_shaped(F.concat(local, letters), *seed), F.lit("@"), _shaped(labels, key, "host"), F.lit(".example."), tld)
    code = F.regexp_extract(token, rf"^(\+(?:{COUNTRY})|)", 1)
    phone = F.concat(code, _shaped(F.concat(F.substring(token, F.length(code) + 1, F.length(token)), longer), *seed))
    # one more digit before the check digit
    card = _card(F.concat(F.substring(token, F.lit(1), F.length(token) - 1), longer, F.right(token, F.lit(1))), *seed)
    ipv6 = _shaped(token, *seed, alphabets=HEXADECIMAL)
    # addresses can't grow: in formats that are nearly used up they are drawn from all addresses
    late, digest = attempt > 4 * DRAWS, _digest(*seed, token)
    ipv6 = F.when(late, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substring(digest, i * 4 + 1, F.lit(4))), ":")).otherwise(ipv6)
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i * 2) % 256).cast("string")), ".")
    out = F.when(kind == "email", email).when(kind == "ip", F.when(late, ip).otherwise(_octets(token, *seed))).when(kind == "ipv6", ipv6)
    out = out.when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", _iban(F.concat(token, longer), *seed))
    out = out.when(kind == "initial", _shaped(token, *seed)).when(kind == "particle", token)
    cyrillic = token.rlike(r"\p{IsCyrillic}")
    for script in ("cyrillic", "latin"):
        named = {g: GIVEN[g, script] for g in ("m", "f")}
        for gender, names in (named | {"n": " ".join(named.values())}).items():
            own = (kind == f"given_{gender}") & (cyrillic if script == "cyrillic" else ~cyrillic)
            again = F.when(attempt > 0, F.concat(F.lit("-"), _surname(script, attempt, *seed, token))).otherwise("")
            out = out.when(own, F.concat(_word(names.lower(), _number(_digest(*seed, token, "given"), 0)), again))
    return out.when(cyrillic, _surname("cyrillic", attempt, *seed, token)).otherwise(_surname("latin", attempt, *seed, token))


def _tokens(entity: Column) -> Column:
    """array<struct<kind, printed>>: the parts of an entity that are replaced."""
    kind = kind_of(entity)
    words = F.split(F.regexp_replace(entity, f"^{_TITLE}", ""), " ")
    gender = F.when(entity.rlike(rf"^(?:{FEMALE_TITLES})\.? "), "given_f").when(entity.rlike(rf"^(?:{MALE_TITLES})\.? "), "given_m").otherwise("given_n")

    def part(w: Column, i: Column) -> Column:
        own = F.when(i == F.size(words) - 1, F.lit("surname")).when(w.rlike(rf"^(?:{PARTICLES})$"), "particle").when(w.rlike(r"^\p{Lu}$|^(?:\p{Lu}\.-?)+$"), "initial")
        return F.struct(own.otherwise(gender).alias("kind"), w.alias("printed"))

    named = F.transform(words, part)
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), entity.alias("printed"))))


def entities_of(text: Column) -> Column:
    """All entities of a text, in order; bare repeats of surnames are not among them."""
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pattern_of(found: Column) -> Column:
    """The pattern of a text's entities and of the surnames among ``found`` standing by themselves; longer ones come first."""
    named = F.filter(found, lambda e: e.rlike(f"^{_TITLE}"))
    written = F.transform(named, lambda e: F.regexp_extract(e, r"(\S+)$", 1))
    cases = F.flatten(F.transform(written, lambda w: F.array(w, F.upper(w), F.initcap(F.lower(w)))))
    surnames = F.sort_array(F.array_distinct(cases), asc=False)
    bare = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(surnames, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    return F.when(F.size(surnames) > 0, bare)


def _with_found(slim: DataFrame) -> DataFrame:
    """``slim`` with ``found``, all entities of its text, and ``pattern``, by which they are found."""
    first = slim.withColumn("found", F.coalesce(entities_of(F.col("text")), F.array().cast("array<string>")))
    named = first.withColumn("pattern", pattern_of(F.col("found")))
    again = F.when(F.col("pattern").isNotNull(), F.regexp_extract_all(F.col("text"), F.col("pattern"), F.lit(0))).otherwise(F.col("found"))
    return named.withColumn("found", again)


def _replace(key: str, entity: Column, again: Column | None) -> Column:
    # step by step, so that no expression holds another one many times
    def normal(t: Column) -> Column:
        return F.struct(t["kind"].alias("kind"), t["printed"].alias("printed"), normal_form(t["kind"], t["printed"]).alias("token"))

    def drawn(t: Column) -> Column:
        attempt = F.lit(0) if again is None else F.coalesce(F.try_element_at(again, F.concat(t["kind"], F.lit("|"), t["token"])), F.lit(0))
        return F.struct(t["kind"].alias("kind"), t["printed"].alias("printed"), surrogate(key, t["kind"], t["token"], attempt).alias("text"))

    parts = F.transform(F.transform(_tokens(entity), normal), drawn)
    title = F.when(kind_of(entity) == "name", F.regexp_extract(entity, f"^{_TITLE}", 0)).otherwise("")
    return F.concat(title, F.array_join(F.transform(parts, lambda t: rendered(t["kind"], t["printed"], t["text"])), " "))


def _rewritten(key: str, text: Column, found: Column, pattern: Column, again: Column | None) -> Column:
    """``text`` with each entity replaced; ``again``: attempts of the tokens that drew more than once."""
    rest = F.when(pattern.isNull(), F.split(text, ENTITY, -1)).otherwise(F.split(text, pattern, -1))
    pieces = F.zip_with(rest, F.transform(found, lambda e: _replace(key, e, again)), lambda s, e: F.concat(s, F.coalesce(e, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)


def redrawn(tokens: DataFrame, key: str) -> DataFrame:
    """(kind, token, attempt) of those distinct ``tokens`` (kind, token) whose first surrogate won't do.

    Of tokens that meet in one surrogate the first keeps it: fewest draws, then
    kind and token.  It is found by a minimum, combined map-side, so a surrogate
    that very many tokens draw isn't gathered in one task.  Tokens that draw
    again have ever more room, so the loop ends.
    """
    first = tokens.withColumn("attempt", F.lit(0))
    now = materialize(first.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("token"), F.col("attempt"))), "tokens")
    real = now.select(F.col("token").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    while True:
        one = F.struct("attempt", "kind", "token")
        holders = now.groupBy("surrogate").agg(F.min(one).alias("holder"))
        marked = now.join(holders, "surrogate").join(real, "surrogate", "left")
        clash = (F.col("holder") != one) | F.col("taken").isNotNull()
        marked = materialize(marked.select("kind", "token", "attempt", "surrogate", clash.alias("clash")), "tokens")
        if marked.filter("clash").isEmpty():
            return now.filter("attempt > 0").select("kind", "token", "attempt")
        drawn = marked.filter("clash").withColumn("attempt", F.col("attempt") + 1)
        drawn = drawn.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("token"), F.col("attempt")))
        now = materialize(marked.filter("not clash").unionByName(drawn).drop("clash"), "tokens")


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, n_entities, text): each row of ``docs`` with its personal data replaced.

    Texts without entities come back unchanged; null texts stay null with 0
    entities.  Repeated rows are returned as often as they come, rows without
    doc_id like any other; an empty table gives no rows; other columns are
    ignored.  ``key`` is the secret that surrogates depend on.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with_found = _with_found(slim)
    # written for all rows: a filter here would find the entities twice
    held = materialize(with_found.select(F.xxhash64("text").alias("of"), "found"), "entities")
    tokens = held.select("of", F.explode("found").alias("entity")).select("of", F.inline(_tokens(F.col("entity")))).filter("kind not in ('initial', 'particle')")
    tokens = tokens.select("of", "kind", normal_form(F.col("kind"), F.col("printed")).alias("token")).distinct()
    again = redrawn(tokens.select("kind", "token").distinct(), key)
    if again.isEmpty():
        return with_found.select("doc_id", F.size("found").alias("n_entities"), _rewritten(key, F.col("text"), F.col("found"), F.col("pattern"), None).alias("text"))
    attempts = F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "token"), "attempt")))
    per_text = materialize(tokens.join(again, ["kind", "token"]).groupBy("of").agg(attempts.alias("again")), "redrawn")
    with_hash = with_found.withColumn("of", F.xxhash64("text"))
    if per_text.count() <= BROADCAST_TEXTS:
        joined = with_hash.join(F.broadcast(per_text), "of", "left")
        return joined.select("doc_id", F.size("found").alias("n_entities"), _rewritten(key, F.col("text"), F.col("found"), F.col("pattern"), F.col("again")).alias("text"))
    some = with_hash.filter(F.size("found") > 0).join(per_text, "of", "left")
    some = some.select("doc_id", F.size("found").alias("n_entities"), _rewritten(key, F.col("text"), F.col("found"), F.col("pattern"), F.col("again")).alias("text"))
    return some.unionAll(with_found.filter(F.size("found") == 0).select("doc_id", F.lit(0).alias("n_entities"), "text"))
