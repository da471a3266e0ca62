"""Surrogates of one entity in several writings."""

import re

from tessera.llm import pii


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.replace(docs, counts=True).collect()}


def test_writings_of_a_number_agree(spark):
    us = ["+15785556437", "+1 (578) 555-6437", "+1-578-555-6437", "+1 578.555.6437", "001 578 555 6437"]
    de = ["+493012345678", "+49 30 12345678", "+49 (30) 1234-5678", "0049 30 123 456 78"]
    far = ["+35812345678", "+358 12 345 678"]
    for texts, code in ((us, "1"), (de, "49"), (far, "358")):
        found = replaced(spark, [f"call {t} now" for t in texts])
        assert all(found[i].entity_kinds == "phone" and found[i].n_entities == 1 for i in found)
        digits = {re.sub(r"^00|\D", "", found[i].text[5:-4]) for i in found}
        digits = {re.sub("^00", "", d) for d in digits}
        own = re.sub(r"\D", "", texts[0])
        assert len(digits) == 1 and own not in digits
        assert all(d.startswith(code) and len(d) == len(own) for d in digits)
        for i, t in enumerate(texts):
            assert re.sub(r"\d", "0", found[i].text[5:-4]) == re.sub(r"\d", "0", t)


def test_no_area_digit_is_kept(spark):
    found = replaced(spark, [f"+157855{n:05d}" for n in range(60)])
    assert len({r.text for r in found.values()}) == 60 and sum(r.text.startswith("+157") for r in found.values()) < 20


def test_national_numbers_are_found_and_dates_are_not(spark):
    numbers = ["020 7946 0958", "0171/2345678", "(030) 12345678", "01 23 45 67 89"]
    found = replaced(spark, [f"tel {t}, ok" for t in numbers] + ["on 01-02-2020 at 10:30, 03/04/2019, 1234"])
    assert all(found[i].entity_kinds == "phone" and t not in found[i].text for i, t in enumerate(numbers))
    assert found[len(numbers)].n_entities == 0


def test_a_name_is_one_under_all_titles(spark):
    found = replaced(spark, ["Dr Anna Smith", "Mrs Anna Smith", "Prof. Paul Jones", "Mr. Paul Jones", "Mx Kim Doe", "Mr Kim Doe", "Mrs Kim Doe"])
    bare = {i: found[i].text.split(" ", 1)[1] for i in found}
    assert bare[0] == bare[1] and bare[0].split()[0] in pii.GIVEN["latin", "f"]
    assert bare[2] == bare[3] and bare[2].split()[0] in pii.GIVEN["latin", "m"]
    assert bare[4] == bare[5] == bare[6] and len({bare[0], bare[2], bare[4]}) == 3


def test_untitled_names_and_shared_families(spark):
    found = replaced(spark, ["Mrs Anna Smith came. Anna Smith left. Mrs. Smith too; Smith's and Smithson.", "Dr Anna Jones and Anna Smith", "no Anna Smith here"])
    first = re.fullmatch(r"Mrs (\w+) (\w+) came\. (\w+) (\w+) left\. Mrs\. (\w+) too; (\w+)'s and Smithson\.", found[0].text).groups()
    assert first[0] == first[2] and len({first[1], first[3], first[4], first[5]}) == 1 and "Smith" not in first and "Anna" not in first
    assert found[0].n_entities == 2 and found[2].text == "no Anna Smith here"
    assert re.fullmatch(r"Dr \w+ \w+ and Anna Smith", found[1].text) and "Jones" not in found[1].text


def test_scripts_are_kept(spark):
    found = replaced(spark, ["Κυρία Ελένη Παπαδοπούλου", "господин Иван Петров", "Frau Ute Bauer", "Mr Հայկ Սարգսյան"])
    for i, (script, own) in enumerate([("greek", "Παπαδοπούλου"), ("cyrillic", "Петров"), ("latin", "Bauer")]):
        title, given, family = found[i].text.split(" ")
        assert given in {n for (k, _), v in pii.GIVEN.items() if k == script for n in v} and family != own
        assert re.fullmatch({"greek": r"[Ͱ-Ͽ]+", "cyrillic": r"[Ѐ-ӿ]+", "latin": r"[A-Za-z]+"}[script], family)
    assert found[3].text == "Mr Հայկ Սարգսյան"


def valid(iban):
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def test_iban_check_digits(spark):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"]
    found = replaced(spark, [f"to {i}." for i in [*ibans, "DE88 3704 0044 0532 0130 00"]] + ["AB12 CDEF GHIJ", "DE12 CDEF GHIJ"])
    for k, own in enumerate(ibans):
        got = found[k].text[3:-1]
        assert found[k].entity_kinds == "iban" and valid(got) and got != own and got[:2] == own[:2]
        assert re.sub("[A-Z]", "A", re.sub(r"\d", "0", got)) == re.sub("[A-Z]", "A", re.sub(r"\d", "0", own))
    assert found[0].text.replace(" ", "") == found[1].text.replace(" ", "") and not valid(found[4].text[3:-1])
    assert found[5].n_entities == found[6].n_entities == 0


def test_megabytes_of_each_pattern(spark):
    bits = ["a@" + "b." * 500_000, "a." * 500_000, "1.2.3." * 170_000, "555 " * 250_000, "+1 (" * 250_000, "4111 " * 200_000, "DE89 " * 200_000, "Mr Anna " * 125_000, "Mr " * 330_000, "0" * 1_000_000, "1-" * 500_000, "Ab " * 300_000, "@" * 1_000_000]
    found = replaced(spark, bits)
    assert len(found) == len(bits) and all(len(found[i].text) > 100_000 for i in range(1, len(bits)))
    assert re.fullmatch(r"[a-z]@\w+\.example\.org\.", found[0].text)


def test_many_names_in_one_family_stay_distinct(spark):
    given = [a + b + c for a in ("Ka", "Lo", "Mi", "Nu") for b in ("ba", "de", "fi", "go") for c in ("ra", "se", "ti")]
    found = replaced(spark, [f"Mrs {g} Smith" for g in given])
    assert len({r.text for r in found.values()}) == len(given) and len({r.text.split()[2] for r in found.values()}) == 1
    assert not {r.text.split()[1] for r in found.values()} & set(given)


def test_columns_of_any_name_and_whole_addresses(spark):
    rows = [(1, "jöhn@exämple.com and " + "a" * 70 + "@example.com, card 3782 822463 10005", "a", "b", 5, "d", "e", "f"), (2, None, *["x", "y", 6, "z", None, "w"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _found string, _made string, _row long, _hash string, _names string, _doc string")
    got = {r.doc_id: r for r in pii.replace(docs, counts=True).collect()}
    assert [got[1][c] for c in docs.columns[2:]] == list(rows[0][2:]) and [got[2][c] for c in docs.columns[2:]] == list(rows[1][2:])
    assert got[1].entity_kinds == "card,email" and got[1].n_entities == 3 and got[2].text is None
    assert "jöhn" not in got[1].text and "ö" not in got[1].text and "a" * 20 not in got[1].text and "3782 822463" not in got[1].text
    first, second = got[1].text.split(" and ")
    assert first.endswith(".example.org") and first.count("@") == 1 and len(second.split("@")[0]) == 70
