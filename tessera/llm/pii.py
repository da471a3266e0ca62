"""Personal data: detected entities get surrogates of the same type.

A surrogate depends on a key, the entity's kind and its canonical form alone, so an
entity gets the same surrogate in every document and in every way of writing it
(coreference).  It keeps the way of writing: separators, digit groups and letter
shape of a mention stay; a telephone number keeps its country code or leading zero, and the
digits after it depend on the canonical digits alone; a card number that passes the check digit
test gets one that passes it, and so does an IBAN, which keeps its country.

A name is found by its title, which stays.  Its family name is an entity of its own, so all who share it
share its surrogate, whether a given name stands before it or not; the given name gets one of its gender, where the
gender is that of all titles which the name has in the corpus (open if they differ or say nothing).
Both are in the script of the name: Latin, Greek or Cyrillic.  In a text that has a name with its title, the same
full name or family name without one is replaced too.  Names in other scripts, names that never have a title in
their text, and given names alone are left as they are.

Distinct entities stay distinct: surrogates that meet each other, or some entity of the corpus, are drawn
again until none meet, from wider forms as rounds go on; after ``ROUNDS`` rounds an error is raised.

All of it is DataFrame functions.  A text is taken apart into its mentions and the gaps
between them and joined again, so there is no Python on the executors.  All patterns take time in
proportion to the text, and none recurses over it.

Defined results: a null text stays null, an empty one empty; texts without entities are
unchanged.  Repeated rows are treated alike.  Null ids are allowed.  All columns are kept,
whatever their names: they travel in one struct beside the helper columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The key of the registered query; a user gives an own one.
KEY = "surrogates"

# Patterns of entities, most particular first.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"
PHONE = "|".join([
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{8,15}(?!\w)",
    # international, in groups
    r"(?<![\w+])(?:\+\d|00[1-9]\d{0,2}[ /-]\(?\d)(?:(?:[ ./-]|\)[ -]?|[ -]?\()?\d){7,13}(?!\w)",
    # national, with a leading zero
    r"(?<![\w+.-])\(?0(?=(?:\D?\D?\d){8,11}(?!\d))\d{2,4}\)?[ /-]\d{2,8}(?:[ -]\d{2,4}){0,3}(?!\w)|(?<![\w+.-])0[1-9](?:[ .]\d{2}){4}(?![\w]|\.\d)",
])
CARD = r"(?<![\w.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\w-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
# Countries that have IBANs.
IBAN_COUNTRIES = """AD AE AL AT AZ BA BE BG BH BI BR BY CH CR CY CZ DE DJ DK DO EE EG ES FI FK FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ
LB LC LI LT LU LV LY MC MD ME MK MN MR MT MU NI NL NO OM PK PL PS PT QA RO RS RU SA SC SD SE SI SK SM SO ST SV TL TN TR UA VA VG XK YE""".split()
IBAN = rf"(?<!\w)(?:{'|'.join(IBAN_COUNTRIES)})\d{{2}}(?: ?[A-Z0-9]{{4}}){{2}}(?: ?[A-Z0-9]{{3}}|(?: ?[A-Z0-9]{{4}}){{1,5}}(?: ?[A-Z0-9]{{1,3}})?)(?!\w)"
# Titles by gender, which go before a name.
MALE_TITLES = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин", "Κύριος", "κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "Κυρία", "κυρία"]
OPEN_TITLES = ["Mx", "Dr", "Prof"]
# Given names by script and gender, endings of made given names, and syllables by script.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"],
    ("latin", "f"): ["Ada", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Irene", "Julia", "Lena", "Maria", "Nora", "Olivia", "Paula", "Sofia", "Vera"],
    ("latin", "x"): ["Alex", "Andrea", "Charlie", "Chris", "Jamie", "Jordan", "Kim", "Lee", "Morgan", "Noel", "Pat", "Quinn", "Robin", "Sam", "Sasha", "Taylor"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Николай", "Олег", "Павел", "Роман", "Сергей", "Юрий"],
    ("cyrillic", "f"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Софья", "Юлия"],
    ("cyrillic", "x"): ["Саша", "Женя", "Валя", "Шура", "Слава", "Юля", "Паша", "Миша", "Коля", "Толя", "Витя", "Лёша", "Гриша", "Стася", "Тоша", "Никита"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Πέτρος", "Παύλος", "Ανδρέας", "Κώστας", "Λουκάς", "Μάρκος", "Στέφανος", "Αλέξης", "Θωμάς", "Σπύρος", "Φίλιππος", "Ιάσονας", "Δημήτρης", "Βασίλης"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Ειρήνη", "Δήμητρα", "Ζωή", "Ιωάννα", "Λυδία", "Νίκη", "Ρένα", "Χριστίνα", "Θάλεια", "Δανάη", "Αγγελική"],
    ("greek", "x"): ["Αλεξ", "Άρτεμις", "Αριέλ", "Ηλέκ", "Κιμ", "Λη", "Μορφώ", "Νοέλ", "Πατ", "Ραφ", "Σαμ", "Τζο", "Φοίβη", "Χάρις", "Χρύσω", "Ωρ"],
}
ENDINGS = {"latin": {"m": "n", "f": "a", "x": "e"}, "cyrillic": {"m": "н", "f": "а", "x": "е"}, "greek": {"m": "ς", "f": "α", "x": "ο"}}
SYLLABLES = {
    "latin": ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "ze"],
    "cyrillic": ["ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ша", "зе"],
    "greek": ["βα", "δε", "φι", "γο", "χυ", "κα", "λε", "μι", "νο", "πυ", "ρα", "σε", "τι", "ζο", "ξα", "ψε"],
}
#: Rounds of drawing again, those after which made given names take the place of listed ones, and those after which names are longer.
ROUNDS, MADE_AFTER, LONG_AFTER = 64, 6, 12
#: Entities to draw again that are sent to all tasks; more are joined by a shuffle, dealt out by so many salts.
SENT, SALTS = 1_000_000, 16
_TITLES = "|".join([*MALE_TITLES, *FEMALE_TITLES, *OPEN_TITLES])
_WORD = "|".join(rf"[\p{{Lu}}&&\p{{Is{x}}}][\p{{Ll}}&&\p{{Is{x}}}]++" for x in ("Latin", "Cyrillic", "Greek"))
NAME = rf"(?<!\p{{L}})(?:{_TITLES})\.? (?:{_WORD})(?: (?:{_WORD}))?(?!\p{{L}})"

# what a kind begins with is tested before its patterns, since most places in a text begin none
ANY = rf"{EMAIL}|(?=[\d+(])(?:{'|'.join([IP, SSN, CARD, PHONE])})|(?=[A-Z][A-Z]\d\d){IBAN}|(?=[\p{{Lu}}гκ]){NAME}"
#: A text without a match of this has no entity; cheaper than the patterns.
HINT = rf"@|\d\d|\d\.\d|(?:{_TITLES})\.? \p{{Lu}}"


def mentions(text: Column) -> Column:
    """The entity mentions of a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """The kind of a mention found by the patterns."""
    return (
        F.when(mention.contains("@"), "email").when(mention.rlike(r"^\p{Lu}?\p{L}+\.? \p{Lu}\p{Ll}"), "name").when(mention.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(mention.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(mention.rlike(r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})$"), "card").otherwise("phone")
    )


def untitled(mention: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(mention, r"^\p{L}+\.? ", "")


def family_of(mention: Column) -> Column:
    """The family name of a name."""
    return F.regexp_extract(mention, r"(\p{L}+)$", 1)


def canonical(mention: Column, kind: Column) -> Column:
    """Kind and form without the way of writing; equal for mentions of one entity."""
    plain = (
        F.when(kind == "email", F.lower(mention)).when(kind == "name", F.lower(untitled(mention)))
        .when(kind == "phone", F.regexp_replace(F.regexp_replace(mention, r"^(?:\+|00)", "p"), r"[^\dp]", ""))
        .when(kind == "ip", mention).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(F.regexp_replace(mention, r"\D", ""))
    )
    return F.concat(F.when((kind == "name") & ~plain.contains(" "), "family").otherwise(kind), F.lit(":"), plain)


def _digest(key: str, entity: Column, tries: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the entity and how often it was drawn."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), tries.cast("string"), entity), 256)


def _number(digest: Column, at: Column) -> Column:
    """A number below 65,536 from place *at* of the digest."""
    return F.conv(F.substring(digest, (at * 3 % 61 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def _shaped(mention: Column, digest: Column, phone: Column) -> Column:
    """The mention with digits and letters replaced in their places, by their order among digits and letters alone.

    The first and fourth digit of a telephone number are 2 to 9.
    """
    chars = F.split(mention, "")

    def swap(c: Column, i: Column) -> Column:
        place = F.length(F.regexp_replace(F.substring(mention, F.lit(1), (i + 1).cast("int")), r"[^\p{L}\p{N}]", ""))
        n = _number(digest, place)
        n = F.when(phone & place.isin(1, 4), n % 8 + 2).otherwise(n)
        return F.when(c.rlike(r"^\d$"), (n % 10).cast("string")).when(c.rlike(r"^\p{Ll}$"), F.chr(97 + n % 26)).when(c.rlike(r"^\p{Lu}$"), F.chr(65 + n % 26)).otherwise(c)

    return F.array_join(F.transform(F.filter(chars, lambda c: c != ""), swap), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a string of digits, 0 where the number is valid."""
    back = F.split(F.reverse(digits), "")
    part = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(part, F.lit(0), lambda a, x: a + x) % 10


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


def _gender(mention: Column) -> Column:
    """The gender of a name's title: m, f, or x where it is open."""
    title = F.regexp_extract(mention, r"^(\p{L}+)", 1)
    return F.when(title.isin(MALE_TITLES), "m").when(title.isin(FEMALE_TITLES), "f").otherwise("x")


def _in_script(word: Column, make) -> Column:
    """What *make* gives for the script of the word."""
    return F.when(word.rlike(r"\p{IsCyrillic}$"), make("cyrillic")).when(word.rlike(r"\p{IsGreek}$"), make("greek")).otherwise(make("latin"))


def _syllables(script: str, digest: Column, n: int) -> Column:
    return F.concat(*[_pick(SYLLABLES[script], _number(digest, F.lit(i))) for i in range(1, n + 1)])


def _family(word: Column, digest: Column, tries: Column) -> Column:
    """The surrogate of a family name."""
    return _in_script(word, lambda script: F.initcap(F.when(tries < LONG_AFTER, _syllables(script, digest, 6)).otherwise(_syllables(script, digest, 10))))


def _given(word: Column, digest: Column, gender: Column, tries: Column) -> Column:
    """The surrogate of a given name; a listed name at first."""

    def make(script: str) -> Column:
        listed, ending = F.lit(None).cast("string"), F.lit(None).cast("string")
        for g in ("m", "f", "x"):
            listed = F.when(gender == g, _pick(GIVEN[script, g], _number(digest, F.lit(0)))).otherwise(listed)
            ending = F.when(gender == g, ENDINGS[script][g]).otherwise(ending)
        made = F.initcap(F.concat(F.when(tries < LONG_AFTER, _syllables(script, digest, 3)).otherwise(_syllables(script, digest, 8)), ending))
        return F.when(tries < MADE_AFTER, listed).otherwise(made)

    return _in_script(word, make)


def _mod97(compact: Column) -> Column:
    """The remainder of an IBAN, written without spaces, with its first four characters behind the rest; 1 where it is valid."""
    chars = F.filter(F.split(F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, 1, 4)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


# Country codes of telephone numbers; none is the start of another.
CODES = """1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98
211 212 213 216 218 220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 246 247 248 249
250 251 252 253 254 255 256 257 258 260 261 262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 359
370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387 389 420 421 423 500 501 502 503 504 505 506 507 508 509
590 591 592 593 594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686 687 688 689 690 691 692
800 808 850 852 853 855 856 870 878 880 881 882 883 886 888 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 979
992 993 994 995 996 998""".split()
#: The head of a telephone number that stays: a country code, or the zero before a national number.
_LEAD = r"^((?:\+|00)[ .()/-]*(?:" + "|".join(r"[ .()/-]*".join(c) for c in CODES) + r")|00|\(?0)?"


def _made(s: Column) -> Column:
    """The surrogate, from a mention's ``m``, ``kind``, ``digest``, ``gender`` and ``shaped``."""
    m, kind, digest, shaped = s["m"], s["kind"], s["digest"], s["shaped"]
    email = F.concat(shaped, F.lit("@"), F.translate(F.substring(digest, 50, 6), "0123456789", "ghijklmnop"), F.lit(".example.org"))
    ip = F.concat_ws(".", *[(_number(digest, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
    phone = F.concat(F.regexp_extract(m, _LEAD, 1), shaped)
    # a card keeps its first digit, and its last one makes the check sum 0 if it was 0
    digits = F.concat(F.substring(m, 1, 1), F.substring(shaped, F.lit(2), F.length(shaped) - 1))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = (10 - _luhn(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0")))) % 10
    card = F.when(_luhn(F.regexp_replace(m, r"\D", "")) == 0, F.concat(body, check.cast("string"))).otherwise(digits)
    # an IBAN keeps its country, and gets check digits that are right if they were
    rest = F.substring(shaped, F.lit(5), F.length(shaped))
    zero = F.replace(F.concat(F.substring(m, 1, 2), F.lit("00"), rest), F.lit(" "), F.lit(""))
    check = F.lpad((98 - _mod97(zero)).cast("string"), 2, "0")
    iban = F.concat(F.substring(m, 1, 2), F.when(_mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1, check).otherwise(F.substring(shaped, 3, 2)), rest)
    family = _family(m, s["family_digest"], s["family_tries"])
    given = F.when(s["entity"].startswith("name:"), F.concat(_given(F.regexp_extract(m, r"(\p{L}+) \p{L}+$", 1), digest, s["gender"], s["tries"]), F.lit(" "))).otherwise("")
    name = F.concat(F.regexp_extract(m, r"^(\p{L}+\.? )", 1), given, family)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).when(kind == "iban", iban)
        .when(kind == "name", name).when(kind == "family", family).otherwise(shaped)
    )


def described(found: Column) -> Column:
    """Mentions as structs of ``m``, ``kind``, ``entity`` and, of a name, the ``family`` entity."""
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("kind")))
    family = lambda s: F.when(s["kind"] == "name", F.concat(F.lit("family:"), F.lower(family_of(s["m"]))))
    return F.transform(kinds, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), canonical(s["m"], s["kind"]).alias("entity"), family(s).alias("family")))


def surrogates(found: Column, key: str, tries, gender=lambda _: F.lit(None).cast("string")) -> Column:
    """The surrogates of described mentions.

    *tries* gives, for an entity, how often it was drawn again, and *gender* its gender where that is not its mention's.
    """
    part = lambda s: F.when(s["kind"] == "email", F.regexp_extract(s["m"], "^([^@]+)@", 1)).when(s["kind"] == "phone", F.regexp_replace(s["m"], _LEAD, "")).when(s["kind"].isin("name", "family"), "").otherwise(s["m"])
    own = lambda s: F.when(s["kind"] == "name", F.coalesce(gender(s["entity"]), _gender(s["m"])))
    drawn = F.transform(found, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["entity"].alias("entity"), s["family"].alias("family"), part(s).alias("part"), own(s).alias("gender"), tries(s["entity"]).alias("tries"), tries(s["family"]).alias("family_tries")))
    keep = ("m", "kind", "entity", "gender", "tries", "family_tries")
    digests = F.transform(drawn, lambda s: F.struct(*[s[k].alias(k) for k in keep], s["part"].alias("part"), _digest(key, s["entity"], s["tries"]).alias("digest"), _digest(key, s["family"], s["family_tries"]).alias("family_digest")))
    shapes = F.transform(digests, lambda s: F.struct(*[s[k].alias(k) for k in keep], s["digest"].alias("digest"), s["family_digest"].alias("family_digest"), _shaped(s["part"], s["digest"], s["kind"] == "phone").alias("shaped")))
    return F.transform(shapes, _made)


def _writings(docs: DataFrame, text_column: str) -> DataFrame:
    """Every distinct writing ``m`` of every entity: ``kind``, ``entity``, ``family``.  A family name is a writing of its own."""
    found = docs.select(F.explode(described(mentions(F.col(f"`{text_column}`")))).alias("s")).select("s.*").distinct()
    families = found.filter("kind = 'name'").select(family_of(F.col("m")).alias("m"), F.lit("family").alias("kind"), F.col("family").alias("entity"), "family")
    return cut(found.filter("entity not like 'family:%'").union(families.distinct()))


def redraws(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """Entities whose surrogate does not follow from a mention: ``entity``, ``tries``, ``gender``.

    They have to be drawn again so that all stay distinct, or have titles that differ in gender.
    Every distinct writing of an entity is looked at.  Names are compared within their family.
    """
    writings = _writings(docs, text_column).withColumn("own", F.when(F.col("kind") == "name", _gender(F.col("m"))))
    men, women = F.max(F.col("own") == "m"), F.max(F.col("own") == "f")
    mixed = writings.groupBy("entity").agg(F.when(men & ~women, "m").when(women & ~men, "f").otherwise("x").alias("gender"), F.count_distinct("own").alias("n")).filter("n > 1").drop("n")
    drawn = cut(writings.join(mixed, "entity", "left").select("entity", "kind", "family", "m", "gender", F.lit(0).alias("tries")))
    known = drawn.select(F.col("entity").alias("taken")).distinct()
    columns = ("entity", "kind", "family", "m", "gender", "tries")
    for _ in range(ROUNDS):
        one = F.array(F.struct("m", "kind", "entity", "family"))
        made = drawn.select(*columns, F.element_at(surrogates(one, key, lambda e: F.when(e == F.col("entity"), F.col("tries")).otherwise(0), lambda _: F.col("gender")), 1).alias("s"))
        given = F.concat(F.lit("name:"), F.lower(F.regexp_extract("s", r"(\p{L}+) \p{L}+$", 1)), F.lit(" "), F.substring_index("family", ":", -1))
        meets_as = F.when(F.col("kind") == "family", F.concat(F.lit("family:"), F.lower("s"))).when(F.col("kind") == "name", given).otherwise(F.element_at(described(F.array("s")), 1)["entity"])
        made = cut(made.select(*columns, meets_as.alias("made")))
        first = made.groupBy("made").agg(F.min(F.struct("tries", "entity")).alias("first"), F.min("entity").alias("low"), F.max("entity").alias("high")).filter("low < high").select("made", "first")
        meets = made.join(first, "made").filter(F.col("entity") != F.col("first.entity")).select("entity")
        meets = cut(meets.union(made.join(known, made["made"] == known["taken"], "left_semi").select("entity")).distinct())
        if meets.isEmpty():
            return made.filter("tries > 0 or gender is not null").select("entity", "tries", "gender").distinct()
        again = meets.withColumnRenamed("entity", "met")
        drawn = cut(made.join(again, made["entity"] == again["met"], "left").select("entity", "kind", "family", "m", "gender", F.when(F.col("met").isNull(), F.col("tries")).otherwise(F.col("tries") + 1).alias("tries")))
    raise RuntimeError(f"surrogates of {meets.count()} entities still meet others after {ROUNDS} rounds")


def _redrawn(docs: DataFrame, again: DataFrame, text_column: str, id_column: str) -> DataFrame:
    """``_row``, ``_hash`` of a row's text, and ``_redrawn``: its entities among *again*, by entity."""
    found = described(mentions(F.col(f"`{text_column}`")))
    each = docs.select(F.col(f"`{id_column}`").alias("_row"), F.xxhash64(f"`{text_column}`").alias("_hash"), F.explode(found).alias("s"))
    each = each.select("_row", "_hash", F.explode(F.array_compact(F.array("s.entity", "s.family"))).alias("entity")).distinct()
    if again.count() <= SENT:
        met = each.join(F.broadcast(again), "entity")  # bounded by SENT
    else:
        # an entity that very many texts hold is dealt out over all salts
        salted = again.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        met = each.withColumn("_salt", F.pmod(F.xxhash64("_row", "_hash"), F.lit(SALTS)).cast("int")).join(salted, ["entity", "_salt"])
    return met.groupBy("_row", "_hash").agg(F.map_from_entries(F.collect_set(F.struct("entity", F.struct("tries", "gender")))).alias("_redrawn"))


def replace(docs: DataFrame, key: str = KEY, text_column: str = "text", id_column: str = "doc_id", counts: bool = False) -> DataFrame:
    """The rows with surrogates in their texts; with *counts*, also ``n_entities`` and ``entity_kinds`` (distinct, sorted, comma-joined)."""
    again = redraws(docs, key, text_column)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.col("_doc").getField(text_column)
    redrawn = not again.isEmpty()
    rows = own
    if redrawn:
        by_row = _redrawn(docs, again, text_column, id_column)
        rows = own.join(by_row, F.col("_doc").getField(id_column).eqNullSafe(F.col("_row")) & (F.xxhash64(text) == F.col("_hash")), "left")
    parts = rows.select("_doc", *[F.col("_redrawn")] * redrawn, described(mentions(text)).alias("_found"))
    tries = (lambda e: F.coalesce(F.try_element_at(F.col("_redrawn"), e)["tries"], F.lit(0))) if redrawn else (lambda _: F.lit(0))
    gender = (lambda e: F.try_element_at(F.col("_redrawn"), e)["gender"]) if redrawn else (lambda _: F.lit(None).cast("string"))
    parts = parts.withColumn("_made", surrogates(F.col("_found"), key, tries, gender))
    # the same names without a title: full names and family names, with what stands for them
    pairs = F.filter(F.arrays_zip(F.col("_found"), F.col("_made")), lambda p: p["_found"]["kind"] == "name")
    full = F.transform(pairs, lambda p: F.struct(untitled(p["_found"]["m"]).alias("k"), untitled(p["_made"]).alias("v")))
    short = F.transform(pairs, lambda p: F.struct(family_of(p["_found"]["m"]).alias("k"), family_of(p["_made"]).alias("v")))
    parts = parts.withColumn("_names", F.map_from_entries(F.array_distinct(F.concat(full, short))))
    longest = F.reverse(F.array_sort(F.transform(F.map_keys("_names"), lambda k: F.struct(F.length(k).alias("n"), k.alias("k")))))
    parts = parts.withColumn("_sought", F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(longest, lambda s: s["k"]), "|"), F.lit(r")(?![\p{L}\p{N}])")))

    def renamed(gap: Column) -> Column:
        held = F.transform(F.regexp_extract_all(gap, F.col("_sought"), F.lit(0)), lambda k: F.element_at(F.col("_names"), k))
        return F.array_join(F.zip_with(F.split(gap, F.col("_sought"), -1), F.concat(held, F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")

    gaps = F.split(text, ANY, -1)
    gaps = F.when(F.size(F.map_keys("_names")) > 0, F.transform(gaps, renamed)).otherwise(gaps)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.col("_made"), F.array(F.lit(""))), lambda g, v: F.concat(g, v)), "")
    changed = F.when(F.size("_found") > 0, joined).otherwise(text)
    extra = [F.size("_found").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct(F.col("_found.kind"))), ",").alias("entity_kinds")] if counts else []
    return parts.select(*[(changed if c == text_column else F.col("_doc").getField(c)).alias(c) for c in docs.columns], *extra)
