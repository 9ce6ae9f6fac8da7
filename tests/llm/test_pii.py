import re

from quillmark.llm import pii

KIND = "doc_id long, text string"
TEXT = "Mail Zoë.Ö99@mail3.example.com or +1 (377) 555-0271; card 4539 1488 0343 6467, ip 97.51.17.173! Herr Jan Meier met Frau Meier. IBAN DE89 3702 0044 0532 0130 00."


def replaced(docs, key="test key"):
    return pii.replace_personal_data(docs, key)


def luhn(number):
    digits = [int(d) for d in re.sub(r"\D", "", number)][::-1]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_entities_keep_type_and_format(spark):
    row = replaced(spark.createDataFrame([(1, TEXT)], KIND)).first()
    out = row["text"]
    assert row["n_entities"] == 7
    for piece in ("Zoë", "mail3", "377", "0343", "97.51.17.173", "Meier", "3702"):
        assert piece not in out
    assert re.search(r"Mail \w{3}\.\w\d\d@\w{4}\d\.example\.com or \+1 \(\d{3}\) \d{3}-\d{4}; card 4\d{3} \d{4} \d{4} \d{4}, ip \d+\.\d+\.\d+\.\d+! Herr \w+ (\w+) met Frau \1\. IBAN DE\d\d \d{4}", out)
    assert luhn(re.search(r"card ([\d ]+),", out)[1])


def test_same_entity_same_surrogate_and_distinct_ones_stay_distinct(spark):
    rows = [(i, f"a{i}@b.org x {i % 250}.1.2.{i // 250 + 1} and Mr Name{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} .") for i in range(900)] + [(5000, "a7@b.org")]
    got = {r["doc_id"]: r["text"] for r in replaced(spark.createDataFrame(rows, KIND)).collect()}
    mails = {i: t.split()[0] for i, t in got.items()}
    assert mails[5000] == mails[7] and len(set(mails.values())) == 900
    assert not set(mails.values()) & {r[1].split()[0] for r in rows}
    addresses = [got[i].split()[2] for i in range(900)]
    assert len(set(addresses)) == 900
    assert len({re.search(r"Mr (\w+)", got[i])[1] for i in range(676)}) == 676


def test_clean_texts_and_edge_cases(spark):
    rows = [(1, "plain text 12 and 3.14 at 2001"), (2, None), (3, ""), (4, "version 1.2.3.4.5 x@y"), (4, "version 1.2.3.4.5 x@y")]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'f' found", "1 again", "2 of")
    got = replaced(df).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["n_entities"]) for r in got) == sorted((i, t or "", 0) for i, t in rows)
    assert replaced(df.limit(0)).count() == 0
    long = replaced(spark.createDataFrame([(1, "a@b.cd " + "x" * 50_000 + " a@b.cd")], KIND)).first()
    assert long["n_entities"] == 2 and "a@b.cd" not in long["text"]


def test_genders_and_scripts(spark):
    rows = [(1, "Mrs Anna Bell"), (2, "Mr Anna Bell"), (3, "Господин Иван Петров")]
    got = {r["doc_id"]: r["text"] for r in replaced(spark.createDataFrame(rows, KIND)).collect()}
    assert got[1].split()[1].split("-")[0] in pii.GIVEN["f", "latin"].split()
    assert got[2].split()[1].split("-")[0] in pii.GIVEN["m", "latin"].split()
    assert got[3].split()[1].split("-")[0] in pii.GIVEN["m", "cyrillic"].split()
    assert got[1].split()[2] == got[2].split()[2]


def test_national_numbers_grouped_cards_and_longer_names(spark):
    phones = ["555-123-4567", "1-800-555-0199", "555.123.4567", "0171 2345678", "030/1234567", "020 7946 0958", "01 23 45 67 89", "0049 171 2345678", "+49 (0)171 2345678"]
    rows = [(i, f"call {x}, now") for i, x in enumerate(phones)]
    rows += [(20, "card 3782 822463 10005."), (21, "Mr John Fitzgerald Kennedy came"), (22, "Mr. J. Smith came"), (23, "Frau von Berg kam"), (24, "Herr Dr. Meier kam"), (25, "Mr Jan Meier came. Meier said, Meier-Haus, Meierei; Mrs Meier went.")]
    plain = [(30, "on 01.02.2003 and 2001-02-03, 12 345 678, 3.1415 and 1 000 000"), (31, "Berg Meier Kennedy")]
    got = {r["doc_id"]: r for r in replaced(spark.createDataFrame(rows + plain, KIND)).collect()}
    for i, x in enumerate(phones):
        out = got[i]["text"]
        assert got[i]["n_entities"] == 1 and x not in out, (x, out)
        assert re.sub(r"\d", "9", out) == re.sub(r"\d", "9", rows[i][1])
    assert luhn(got[20]["text"][5:]) and re.fullmatch(r"card 3\d{3} \d{6} \d{5}\.", got[20]["text"]) and "822463" not in got[20]["text"]
    for i, real in ((21, "John Fitzgerald Kennedy"), (22, "Smith"), (23, "Berg"), (24, "Meier")):
        assert got[i]["n_entities"] == 1 and not any(w in got[i]["text"] for w in real.split()), got[i]["text"]
    assert re.fullmatch(r"Mr\. [A-Z]\. \w+ came", got[22]["text"]) and got[23]["text"].startswith("Frau von ") and got[24]["text"].startswith("Herr Dr. ")
    name = got[24]["text"].split()[2]
    assert re.fullmatch(rf"Mr \w+ {name} came\. {name} said, {name}-Haus, Meierei; Mrs {name} went\.", got[25]["text"]) and got[25]["n_entities"] == 4
    for i, text in plain:
        assert (got[i]["text"], got[i]["n_entities"]) == (text, 0)


def texts_of(spark, rows, key="test key"):
    return {r["doc_id"]: r["text"] for r in replaced(spark.createDataFrame(rows, KIND), key).collect()}


def mod97(iban):
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def test_a_format_that_is_used_up(spark):
    rows = [(i, f"{chr(97 + i)}@b.org") for i in range(26)]
    got = texts_of(spark, rows)
    assert len(set(got.values())) == 26 and not set(got.values()) & {t for _, t in rows}
    assert all(re.fullmatch(r"[a-z]{1,3}@[a-z]\.example\.org", t) for t in got.values())


def test_addresses_of_a_format_that_is_used_up(spark):
    rows = [(i, f"0.0.0.{i}") for i in range(1, 255)]
    got = texts_of(spark, rows)
    assert len(set(got.values())) == 254 and not set(got.values()) & {t for _, t in rows}


def test_check_digits_of_accounts(spark):
    rows = [(1, "DE89370400440532013000"), (2, "GB82 WEST 1234 5698 7654 32"), (3, "DE88370400440532013000")]
    got = texts_of(spark, rows)
    assert [mod97(got[i]) == 1 for i in (1, 2, 3)] == [True, True, False]
    assert re.fullmatch(r"DE\d{20}", got[1]) and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[2]) and all(got[i] != t for i, t in rows)


def test_more_forms(spark):
    rows = [(1, "id 123-45-6789."), (2, "at 2001:db8:85a3:0:0:8a2e:370:7334 now"), (3, "at FE80::1A2B:3 now"), (4, "Dr. Anna Bell said"), (5, "Prof. Dr. Bell"), (6, "x a@mail.one.co.uk"), (7, "x a@mail.one.ac.uk")]
    plain = [(20, "std::vector and a::b at 12:30:45"), (21, "Dr. no one")]
    got = texts_of(spark, rows + plain)
    assert all(got[i] == t for i, t in plain)
    assert re.fullmatch(r"id \d{3}-\d\d-\d{4}\.", got[1]) and re.fullmatch(r"at [0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}:[0-9a-f]:[0-9a-f]:[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4} now", got[2])
    assert re.fullmatch(r"at [0-9A-F]{4}::[0-9A-F]{4}:[0-9A-F] now", got[3])
    assert not re.search("Anna|Bell", got[4] + got[5]) and got[4].split()[2] == got[5].split()[2]
    assert all(re.fullmatch(r"x [a-z]@[a-z]{4}\.[a-z]{3}\.[a-z]{2}\.example\.uk", got[i]) for i in (6, 7)) and got[6].split("@")[1] != got[7].split("@")[1]
    assert all(got[i] != t for i, t in rows)


def test_first_draws_depend_on_key_and_entity_only(spark):
    alone = texts_of(spark, [(1, "reach +1 (377) 555-0271 or 10.20.30.40")])
    amid = texts_of(spark, [(1, "reach +1 (377) 555-0271 or 10.20.30.40")] + [(i, f"+1 (377) 555-{i:04}, 10.20.{i}.7") for i in range(2, 200)])
    other = texts_of(spark, [(1, "reach +1 (377) 555-0271 or 10.20.30.40")], "another key")
    assert alone[1] == amid[1] != other[1]


def brute_distinct(pairs):
    """Every real entity has one surrogate, and no surrogate two entities or one that is real."""
    forward, back = {}, {}
    for real, other in pairs:
        assert forward.setdefault(real, other) == other
        assert back.setdefault(other, real) == real
    assert not forward.keys() & back.keys()


def test_against_brute_force_pairing(spark):
    rows = [(i, f"call +49 {30 + i % 9} {1000 + i * 7 % 900}; card 4539 1488 0343 {6000 + i % 400}; ip 10.0.{i % 200}.{i % 50}; u{i % 300}@h{i % 11}.net; Ms Ada Q{chr(97 + i % 26)}x{chr(97 + i % 7)}") for i in range(400)]
    got = texts_of(spark, rows)
    pairs = {k: [] for k in range(5)}
    for i, text in rows:
        for k, (a, b) in enumerate(zip(text.split("; "), got[i].split("; "), strict=True)):
            pairs[k].append((a.split()[-1], b.split()[-1]) if k > 1 else (a, b))
    for found in pairs.values():
        brute_distinct(found)


def test_permutation_of_a_format(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    got = [r[0] for r in df.select(pii._shaped(F.col("t"), "k")).collect()]
    assert len(set(got)) == 1000 and got != sorted(got)


def test_one_entity_in_many_forms(spark):
    rows = [
        (1, "+1 (555) 123-4567, +1 555 123 4567, +15551234567, 001 555 123 4567"),
        (2, "4111 1111 1111 1111, 4111111111111111, 4111-1111-1111-1111"),
        (3, "John.Doe@Acme.org, john.doe@acme.org, JOHN.DOE@ACME.ORG"),
        (4, "MR JAN MEIER left. Mr Jan Meier left. MEIER stayed, Meier too."),
        (5, "DE89 3702 0044 0532 0130 00, DE89370200440532013000"),
        (6, "+49 (0)171 2345678, +49 171 2345678, 0049 171 2345678, +491712345678"),
        (7, "FRAU DR. BELL, Frau Dr. Bell"),
        (8, "FE80::1A2B:3, fe80::1a2b:3"),
    ]
    got = texts_of(spark, rows)
    digits = lambda x: re.sub(r"\D", "", x)
    phones = got[1].split(", ")
    assert len({digits(p).removeprefix("00") for p in phones}) == 1 and all(re.fullmatch(f, p) for f, p in zip((r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\+1 \d{3} \d{3} \d{4}", r"\+1\d{10}", r"001 \d{3} \d{3} \d{4}"), phones, strict=True))
    assert len({digits(c) for c in got[2].split(", ")}) == 1 and all(luhn(c) for c in got[2].split(", "))
    mails = got[3].split(", ")
    assert len({m.lower() for m in mails}) == 1 and mails[0][0].isupper() and mails[0][5].isupper() and mails[1].islower() and mails[2].isupper()
    name = re.fullmatch(r"MR ([A-Z-]+) ([A-Z]+) left\. Mr ([\w-]+) (\w+) left\. ([A-Z]+) stayed, (\w+) too\.", got[4])
    assert name and name[3].upper() == name[1] != "JAN" and name[4].upper() == name[2] == name[5] == name[6].upper() != "MEIER"
    assert len({x.replace(" ", "") for x in got[5].split(", ")}) == 1
    forms = got[6].split(", ")
    assert len({digits(f.replace("(0)", "")).removeprefix("00") for f in forms}) == 1 and re.fullmatch(r"\+49 \(0\)\d{3} \d{7}", forms[0])
    a, b = got[7].split(", ")
    assert a == b.upper() and "BELL" not in a
    a, b = got[8].split(", ")
    assert a.lower() == b and a.isupper()
    assert all(got[i] != t for i, t in rows)
