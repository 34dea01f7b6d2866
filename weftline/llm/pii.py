"""PII surrogates with DataFrame functions only.

Entities are found by one pattern, so that splitting by it and extracting it agree. Each entity's
surrogate follows from a keyed hash of its text: the same kind, format, script, letter case and, for names,
gender; the same entity has the same surrogate everywhere. All distinct entities of the table are then checked:
a surrogate that another entity has, or that is itself an entity of the table, is drawn again with a
higher attempt number until all are distinct.

Spellings of one entity (letter case of an address, a name with and without title) count as one. An e-mail address
keeps the coreference of its domain, a name that of its family name. Surrogate domains lie under example.*, IP addresses
in the reserved 240/4 and 2001:db8::/32, MAC addresses under 02, social security numbers in the unissued 9xx range; card
numbers keep their first digit, IBANs their country, and both whether their check digits hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.session import cut

# fixed values: titles and given names by gender and script
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа", "κυρία")
MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "κύριος")
OTHER_TITLES = ("Dr", "Prof", "Professor")
GIVEN = {
    ("female", "latin"): ("Anna", "Clara", "Elena", "Irene", "Julia", "Laura", "Maria", "Nora", "Sofia", "Vera"),
    ("male", "latin"): ("Adam", "Bruno", "Daniel", "Felix", "Hugo", "Lukas", "Martin", "Oscar", "Simon", "Viktor"),
    ("female", "cyrillic"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    ("male", "cyrillic"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Юрий"),
    ("female", "greek"): ("Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Νίκη", "Σοφία"),
    ("male", "greek"): ("Ανδρέας", "Γιώργος", "Κώστας", "Νίκος", "Πέτρος", "Στέφανος"),
}
# fixed values: given names besides, behind which a capitalised word is a family name too
FEMALE_NAMES = ("Mary", "Susan", "Linda", "Karen", "Sarah", "Emma", "Alice", "Olivia", "Sophie", "Marie", "Claire", "Petra", "Sabine", "Carmen", "Lucía")
MALE_NAMES = ("John", "James", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "George", "Hans", "Klaus", "Jean", "Pierre", "Carlos", "José")
# fixed values: letters change within their alphabet
ALPHABETS = (
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àâäáãåèéêëìíîïòóôöõùúûü", "ÀÂÄÁÃÅÈÉÊËÌÍÎÏÒÓÔÖÕÙÚÛÜ",
    "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
    "çčćďđğłñňřšśşťžźżþðßýÿ", "ÇČĆĎĐĞŁÑŇŘŠŚŞŤŽŹŻÞÐÝŸ", "āăąēĕėęěĩīĭįıōŏőøũūŭůűųæœ", "ĀĂĄĒĔĖĘĚĨĪĬĮİŌŎŐØŨŪŬŮŰŲÆŒ", "йёъьіїєґђјљњћџў", "ЙЁЪЬІЇЄҐЂЈЉЊЋЏЎ", "άέήίόύώϊϋΐΰς", "ΆΈΉΊΌΎΏΪΫ",
    "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ", "ԱԲԳԴԵԶԷԸԹԺԻԼԽԾԿՀՁՂՃՄՅՆՇՈՉՊՋՌՍՎՏՐՑՒՓՔՕՖ",
)
# letters and digits of none of these change to one of the alphabet beside their class, so that none stays: of their script where it is named
OTHERS = (
    (r"\p{IsCyrillic}&&\p{Lu}", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"), (r"\p{IsCyrillic}", "бвгджзклмнпрстфхцчшщ"), (r"\p{IsGreek}&&\p{Lu}", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ"), (r"\p{IsGreek}", "βγδζθκλμνξπρστφχψ"),
    (r"\p{Lu}", "BCDFGHJKLMNPQRSTVWXYZ"), (r"\p{L}", "bcdfghjklmnpqrstvwxyz"), (r"\p{N}", "0123456789"),
)
SYLLABLES = {"latin": ("bcdfghjklmnpqrstvwxyz", "aeiou"), "cyrillic": ("бвгджзклмнпрстфхцчшщ", "аеиоуыэюя"), "greek": ("βγδζθκλμνξπρστφχψ", "αεηιουω")}

SHORT = 8  # attempts with up to three given names

_TITLES = "|".join(sorted((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES), key=len, reverse=True))
_FEMALE = (*FEMALE_NAMES, *(n for (g, _), names in GIVEN.items() if g == "female" for n in names))
_MALE = (*MALE_NAMES, *(n for (g, _), names in GIVEN.items() if g == "male" for n in names))
_GIVEN = "|".join((*_FEMALE, *_MALE))
_LETTERS = "".join(ALPHABETS)
# where each letter's alphabet begins in _LETTERS, and its size, in three digits each: one literal stays small in a plan
_FIRST = "".join(f"{sum(map(len, ALPHABETS[:k])):03}" for k, letters in enumerate(ALPHABETS) for _ in letters)
_SIZE = "".join(f"{len(letters):03}" for letters in ALPHABETS for _ in letters)
_L = r"\p{L}\p{N}"
_CARD = r"(?<![\p{N}\p{L}])(?:\d{16}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4})(?![\p{N}\p{L}])"
_SSN = r"(?<![\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{N}\-])"
_IP = r"(?<![\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\p{N})"
_GAP = rf"(?:[.\-]| (?!{_CARD}|{_SSN}|{_IP}))?"  # within a phone number: the next entity isn't part of it
_NAME = r"\p{Lu}(?:['’](?=\p{Lu})|[\p{L}\-])++"
PATTERNS = {
    "email": rf"(?<![{_L}._%+\-])[{_L}._%+\-]++@[{_L}\-]++(?:\.[{_L}\-]++)++",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": _CARD,
    "ssn": _SSN,
    "ip": _IP,
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9a-fA-F:]*\d)(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "phone": r"(?<![\p{N}+])\+\d{1,3}[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\p{N})|"
    rf"(?<![\p{{N}}+])\+\d{{1,3}}{_GAP}\(?\d{{1,4}}\)?(?:{_GAP}\d{{2,4}}){{1,4}}(?!\p{{N}})|"
    r"(?<![\p{N}\p{L}])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[.\-]\d{4}(?!\p{N})|"
    r"(?<![\p{N}\p{L}+\-./])0\d{2,4}[\-/ ]\d{5,8}(?![\p{N}\-/])",
    "hex": r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]++)(?![\p{L}\p{N}])",
    "mac": r"(?<![\p{L}\p{N}:\-])[0-9a-fA-F]{2}[:\-](?:[0-9a-fA-F]{2}[:\-]){4}[0-9a-fA-F]{2}(?![\p{L}\p{N}:\-])",
    "name": rf"(?<![{_L}])(?=[\p{{Lu}}гκ])(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}|(?:{_GIVEN})(?: {_NAME}){{1,2}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
_MAY = rf"[0-9@]|(?=[\p{{Lu}}гκ])(?:{_TITLES}|{_GIVEN})|[0-9a-fA-F]{{32}}|eyJ|xox|[a-fA-F]{{2}}[:\-][a-fA-F]{{2}}[:\-]"


def entities(text: Column) -> Column:
    """All entities of a text in order (null: none)."""
    return F.when(text.rlike(_MAY), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(entity: Column) -> Column:
    out = F.lit("name")
    for name in reversed([k for k in PATTERNS if k != "name"]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


_TITLED = rf"^(?:{_TITLES})\.? {_NAME} "


def _person(entity: Column) -> Column:
    """A name of given and family name without its title; any other entity as it is."""
    return F.when(entity.rlike(_TITLED), F.substring(entity, F.instr(entity, " ") + 1, F.length(entity))).otherwise(entity)


def canonical(entity: Column) -> Column:
    """What an entity is known by, the same for all its spellings: an e-mail address in lower case; a name of given and family name without its title.

    A title stays where it alone tells the gender, in the form Mr or Ms, and before a family name alone.
    """
    titled, rest = entity.rlike(_TITLED), _person(entity)
    bare = F.regexp_replace(F.substring_index(entity, " ", 1), r"\.", "")
    named = F.substring_index(rest, " ", 1)
    sure = named.isin(*_FEMALE, *_MALE)
    mark = F.when(sure, "").when(bare.isin(*FEMALE_TITLES), "Ms ").when(bare.isin(*MALE_TITLES), "Mr ").otherwise("")
    wrong = (bare.isin(*FEMALE_TITLES) & named.isin(*_MALE)) | (bare.isin(*MALE_TITLES) & named.isin(*_FEMALE))
    return F.when(F.contains(entity, F.lit("@")), F.lower(entity)).when(titled & wrong, entity).when(titled, F.concat(mark, rest)).otherwise(entity)


def _stream(key: str, what: Column) -> Column:
    """128 hexadecimal digits that follow from the key."""
    seed = F.concat(F.lit(key + "\x1f"), what)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("2\x1f"), seed), 256))


def _number(stream: Column, place: Column | int) -> Column:
    """0 to 65535 from the stream's digits at a place."""
    at = (place if isinstance(place, Column) else F.lit(place)) % 31
    return F.conv(F.substring(stream, at * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _shifted(value: Column, stream: Column) -> Column:
    """Each letter and digit moved within its alphabet by the stream, by one place at least, so none stays; one stream gives an injective map where all have one."""

    def one(c: Column, i: Column) -> Column:
        other = F.lit(None).cast("string")
        for pattern, letters in reversed(OTHERS):
            other = F.when(c.rlike(f"[{pattern}]"), F.lit(letters)).otherwise(other)
        drawn = F.coalesce(F.substring(other, _number(stream, i) % F.length(other) + 1, F.lit(1)), c)
        at = F.instr(F.lit(_LETTERS), c) - 1
        first, size = (F.substring(F.lit(x), 3 * at + 1, F.lit(3)).cast("int") for x in (_FIRST, _SIZE))
        return F.when(at < 0, drawn).otherwise(F.substring(F.lit(_LETTERS), first + (at - first + 1 + _number(stream, i) % (size - 1)) % size + 1, F.lit(1)))

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _mod97(text: Column) -> Column:
    """The remainder by 97 of an IBAN's digits and letters (A is 10) read as one number; other characters are left out."""

    def step(rest: Column, c: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(value < 0, rest).otherwise((rest * F.when(value < 10, 10).otherwise(100) + value) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(value: Column, body: Column, stream: Column) -> Column:
    country = F.substring(value, 1, 2)
    check = 98 - _mod97(F.concat(body, country, F.lit("00")))
    valid = _mod97(F.concat(F.substring(value, 5, 60), F.substring(value, 1, 4))) == 1
    wrong = (check + 1 + _number(stream, 20) % 90) % 97
    return F.concat(country, F.lpad(F.when(valid, check).otherwise(wrong).cast("string"), 2, "0"), body)


def _luhn(digits: Column) -> Column:
    """Sum of the check over 16 digits; a valid number's is a multiple of 10."""
    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: _doubled(c.cast("int"), i)), F.lit(0), lambda a, x: a + x)


def _doubled(digit: Column, place: Column) -> Column:
    twice = digit * 2
    return F.when(place % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)


def _card(value: Column, shifted: Column, stream: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    body = F.concat(F.substring(digits, 1, 1), F.substring(shifted, 2, 14))
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    wrong = (check + 1 + _number(stream, 20) % 9) % 10
    last = F.when(_luhn(digits) % 10 == 0, check).otherwise(wrong).cast("string")
    new = F.concat(body, last)
    mark = F.substring(value, 5, 1)
    fours = [F.substring(new, 4 * i + 1, 4) for i in range(4)]
    grouped = F.concat(fours[0], mark, fours[1], mark, fours[2], mark, fours[3])
    return F.when(F.length(value) == 16, new).otherwise(grouped)


def _picked(names: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), number % len(names) + 1)


def _name(value: Column, new: Column, stream: Column, attempt: Column) -> Column:
    """A name with the family name ``new``."""
    first_word = F.substring_index(value, " ", 1)
    bare = F.regexp_replace(first_word, r"\.", "")
    titled = bare.isin(*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)
    title = F.when(titled, first_word)
    rest = F.when(titled, F.substring(value, F.length(first_word) + 2, F.length(value))).otherwise(value)
    family = F.substring_index(rest, " ", -1)
    alone = ~F.contains(rest, F.lit(" "))
    script = F.when(family.rlike(r"\p{IsCyrillic}"), "cyrillic").when(family.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    named = F.substring_index(rest, " ", 1)
    gender = F.when(bare.isin(*FEMALE_TITLES), "female").when(bare.isin(*MALE_TITLES), "male").when(named.isin(*_FEMALE), "female").when(named.isin(*_MALE), "male")
    gender = gender.otherwise(F.when(_number(stream, 30) % 2 == 0, "female").otherwise("male"))

    def given(place: int) -> Column:
        out = F.lit(None).cast("string")
        for (g, s), names in GIVEN.items():
            out = F.when((gender == g) & (script == s), _picked(names, _number(stream, place))).otherwise(out)
        return out

    # after SHORT attempts a part of one more syllable each time, up to 10: over 10 ** 20 in the least alphabet
    def syllable(letters: tuple[str, str], i: Column) -> Column:
        return F.concat(*(F.substring(F.lit(x), _number(stream, 2 * i + k) % len(x) + 1, F.lit(1)) for k, x in enumerate(letters)))

    def more(letters: tuple[str, str]) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.least(attempt - SHORT + 1, F.lit(10))), lambda i: syllable(letters, i)), "")

    made = F.lit(None).cast("string")
    for name, letters in SYLLABLES.items():
        made = F.when((attempt > SHORT) & (script == name), more(letters)).otherwise(made)
    first = F.when(attempt > SHORT, F.concat_ws("-", given(0), F.initcap(made))).otherwise(F.concat_ws("-", given(0), F.when(attempt > 2, given(1)), F.when(attempt > 5, given(2))))
    return F.when(alone, F.concat(title, F.lit(" "), new, F.coalesce(made, F.lit("")))).otherwise(F.concat_ws(" ", title, first, new))


def surrogates(values: Column, attempt, key: str) -> Column:
    """The replacements of an array of entities; ``attempt`` gives an entity's attempt number (0 at first).

    In steps, each over the array of the last, so that kind, stream and what is shifted are computed once per entity and stand
    once in the plan.
    """
    also = lambda e, **new: F.struct(*(e[c].alias(c) for c in ("value", "what", "attempt")), *(c.alias(n) for n, c in new.items()))
    known = F.transform(values, lambda e: F.struct(e.alias("value"), kind(e).alias("what"), attempt(e).alias("attempt")))
    seeded = F.transform(known, lambda e: F.struct(e["value"].alias("value"), e["what"].alias("what"), e["attempt"].alias("attempt"), _stream(key, F.concat_ws("\x1f", e["what"], e["attempt"].cast("string"), canonical(e["value"]))).alias("stream")))
    parts = F.transform(seeded, lambda e: also(e, stream=e["stream"], part=_part(e["value"], e["what"]), by=_part_stream(e["value"], e["what"], e["attempt"], e["stream"], key)))
    moved = F.transform(parts, lambda e: also(e, stream=e["stream"], new=_shifted(e["part"], e["by"])))
    return F.transform(moved, lambda e: _surrogate(e["value"], e["what"], e["attempt"], e["stream"], e["new"], key))


_COUNTRY = r"^\+\d{1,3}(?=[ .\-(])|^"


def _part(value: Column, what: Column) -> Column:
    """What of an entity is shifted."""
    return (
        F.when(what == "email", F.substring_index(value, "@", 1))
        .when(what == "card", F.regexp_replace(value, r"\D", ""))
        .when(what == "ssn", value)
        .when(what == "phone", F.regexp_replace(value, _COUNTRY, ""))
        .when(what.isin("key", "iban"), F.substring(value, F.lit(5), F.length(value)))
        .when(what == "name", F.substring_index(value, " ", -1))
        .otherwise("")
    )


def _part_stream(value: Column, what: Column, attempt: Column, stream: Column, key: str) -> Column:
    """Family names move by one stream of their own; those that stand alone behind a title by another one each attempt."""
    alone = F.size(F.split(value, " ")) == 2
    alone &= F.regexp_replace(F.substring_index(value, " ", 1), r"\.", "").isin(*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)
    return F.when(what == "name", _stream(key, F.when(alone, F.concat(F.lit("family"), attempt.cast("string"))).otherwise(F.lit("family0")))).otherwise(stream)


def _surrogate(value: Column, what: Column, attempt: Column, stream: Column, new: Column, key: str) -> Column:
    domain = F.lower(F.substring_index(value, "@", -1))
    top = F.substring_index(domain, ".", -1)
    hidden = F.concat(F.lit("m"), F.substring(_stream(key, F.concat(F.lit("domain\x1f"), domain)), 1, 10), F.lit(".example."), F.when(top.isin("com", "org", "net"), top).otherwise(F.lit("com")))
    country = F.regexp_extract(value, _COUNTRY, 0)
    mac = F.concat(F.lit("02"), *(x for i in range(1, 6) for x in (F.substring(value, 3 * i, 1), F.substring(stream, 2 * i + 1, 2))))
    long = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int")), lambda i: F.sha2(F.concat_ws("\x1f", i.cast("string"), stream), 256)), "")
    digits = F.substring(F.when(F.length(value) > 128, long).otherwise(stream), F.lit(1), F.length(value))
    return (
        F.when(what == "email", F.concat(new, F.lit("@"), hidden))
        .when(what == "card", _card(value, new, stream))
        .when(what == "ssn", F.concat(F.lit("9"), F.substring(new, 2, 20)))
        .when(what == "ip", F.concat_ws(".", (F.lit(240) + _number(stream, 0) % 15).cast("string"), *((_number(stream, i) % 256).cast("string") for i in (1, 2, 3))))
        .when(what == "ip6", F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(stream, i * 4 + 1, F.lit(4))), ":")))
        .when(what == "mac", F.when(value == F.lower(value), mac).otherwise(F.upper(mac)))
        .when(what == "phone", F.concat(country, new))
        .when(what == "hex", F.when(value == F.lower(value), digits).otherwise(F.upper(digits)))
        .when(what == "key", F.concat(F.substring(value, 1, 4), new))
        .when(what == "iban", _iban(value, new, stream))
        .otherwise(_name(value, new, stream, attempt))
    )


def attempts(values: DataFrame, key: str, most_rounds: int = 30) -> DataFrame:
    """(value, attempt) of the entities whose first surrogate was taken; ``values`` has distinct ``value``, each as ``canonical`` has it.

    Names are compared without titles, which other spellings of the same entity may lack.
    """
    moved = values.sparkSession.createDataFrame([], "value string, attempt int")
    for _ in range(most_rounds):
        given = values.join(moved, "value", "left").select("value", F.coalesce("attempt", F.lit(0)).alias("attempt"))
        given = cut(given.withColumn("surrogate", F.transform(surrogates(F.array("value"), lambda _: F.col("attempt"), key), _person)[0]))
        shared = given.groupBy("surrogate").agg(F.count("*").alias("n"), F.min_by("value", F.struct("attempt", "value")).alias("keeps")).filter("n > 1")
        losers = given.join(shared, "surrogate").filter("value <> keeps").select("value")
        real = given.join(values.select(_person(F.col("value")).alias("surrogate")), "surrogate", "left_semi").select("value")
        again = cut(losers.unionByName(real).distinct())
        if again.isEmpty():
            return moved
        moved = cut(given.join(again.withColumn("again", F.lit(1)), "value", "left").select("value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt")).filter("attempt > 0"))
    raise RuntimeError(f"surrogates did not become distinct in {most_rounds} rounds")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced by surrogates and their number in ``n_entities``.

    Null stays null and empty text empty, with 0 entities. Repeated rows get equal texts, an empty table gives no rows.
    Other columns stay whatever their names; a column n_entities, in any case, is replaced. Entities are found in whole
    texts, however long.
    """
    columns = [c for c in docs.columns if c.lower() != "n_entities"]
    own = "_" * (1 + max((len(c) for c in columns), default=0))  # longer than any of their names
    found_in, text_key, moved_in = own + "found", own + "text", own + "moved"
    found = docs.select(*columns, F.coalesce(entities(F.col("text")), F.array().cast("array<string>")).alias(found_in))
    known = lambda c: F.array_distinct(F.transform(c, canonical))
    values = cut(found.select(F.explode(known(F.col(found_in))).alias("value")).distinct())
    moved = attempts(values, key)
    if moved.isEmpty():
        new = surrogates(F.col(found_in), lambda _: F.lit(0), key)
    else:
        texts = found.filter(F.size(found_in) > 0).select(F.sha2("text", 256).alias(text_key), F.explode(known(F.col(found_in))).alias("value")).distinct()
        maps = texts.join(moved, "value").groupBy(text_key).agg(F.map_from_entries(F.collect_list(F.struct("value", "attempt"))).alias(moved_in))
        found = found.withColumn(text_key, F.when(F.size(found_in) > 0, F.sha2("text", 256))).join(maps, text_key, "left").drop(text_key)
        new = surrogates(F.col(found_in), lambda e: F.coalesce(F.try_element_at(moved_in, canonical(e)), F.lit(0)), key)
    between = F.split(F.col("text"), PATTERN, -1)
    text = F.when(F.size(found_in) == 0, F.col("text")).otherwise(F.array_join(F.zip_with(between, new, lambda s, e: F.concat(s, F.coalesce(e, F.lit("")))), ""))
    return found.select(*(text.alias(c) if c == "text" else F.col(c) for c in columns), F.size(found_in).alias("n_entities"))
