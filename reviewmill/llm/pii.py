"""Format-preserving pseudonyms for personal data, in DataFrame expressions.

Candidates are found by one pattern and validated: check digits of card and bank account numbers,
ranges of addresses and social security numbers, the calendar for dates. A validated value is
permuted within its own format by a keyed Feistel network, so a value gets the same pseudonym in
every document, different values get different ones, and a pseudonym is valid where the value was.
Text outside of the values stays as it is.

Words and numbers may follow a bank account number in its own characters, so account numbers are
looked for first, at every place that may begin one: it ends where its country's length is reached
and the check digits hold, else where the longest valid one does. The pattern of a text then names
its account numbers, and a stretch without any is left to the other formats.

Layouts are linked: separators of cards, account numbers and phones are taken out before the
permutation and put back at their places, and a date is moved as a day, whatever its layout. A phone
keeps its country's calling code; the digits after it get the same pseudonym without the code. Not
linked are slash dates that may be month-first (read so) with the day that a day-first writer meant,
emails and secrets in another case, and phones with and without a national prefix such as (0).

Strings are permuted in two halves; each round adds, character by character, digits of a keyed
hash of the other half, within the character's class (digit, upper case, lower case, hex letter).
Dates and addresses are numbers, split in two residues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Fixed formats, in the order in which they are tried at one place.
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}"
    r"@(?:[A-Za-z0-9-]{1,63}\.){1,3}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
)
SECRET = (
    r"(?<=(?i:token|secret|key|password|passwd|pwd)\s{0,2}[=:]\s{0,2}[\"']{0,1})[0-9a-fA-F]{32,64}(?![0-9A-Za-z])"
)
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z]|-[0-9])"
SLASH_DATE = r"(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9A-Za-z]|/[0-9])"
DOT_DATE = r"(?<![0-9A-Za-z.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = (
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])"
)
CARD = (
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?<sep>[ -])[0-9]{4}\k<sep>[0-9]{4}\k<sep>[0-9]{1,7}"
    r"|[0-9]{4}(?<gap>[ -])[0-9]{6}\k<gap>[0-9]{5})(?![0-9A-Za-z])"
)
_FIRST = "|".join(f"(?:{p})" for p in (EMAIL, SECRET))  # tried before account numbers
_LAST = "|".join(f"(?:{p})" for p in (IP, ISO_DATE, SLASH_DATE, DOT_DATE, SSN, PHONE, CARD))

#: Characters of a bank account number by country.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC",
        32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_FIRST_DAY, _DAYS = "1900-01-01", (17, 4297)  # 17 * 4297 days: 1900 to 2099
_EARLY = (160, 180)  # 200 years * 12 months * 12 days: those up to the 12th of a month
#: Calling codes; none begins another one.
_CALLING = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_WALK = 64  # steps until a day above the 12th turns up; missing it has a probability of 1e-25


def _digest(key: str, tweak: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), turn.cast("string"), F.lit("|"), value.cast("string")), 512)


def _shift(half: Column, pad: Column, letters: int) -> Column:
    """Add four hex digits of the pad to each character, within its class."""

    def one(ch: Column, i: Column) -> Column:
        add = F.coalesce(F.conv(F.substring(pad, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(0))

        def within(low: str, size: int) -> Column:
            return F.char(F.lit(ord(low)) + (F.ascii(ch) - F.lit(ord(low)) + add) % size)

        return (
            F.when(ch.between("0", "9"), within("0", 10)).when(ch.between("a", "z"), within("a", letters))
            .when(ch.between("A", "Z"), within("A", letters)).otherwise(ch)
        )

    return F.array_join(F.transform(F.split(half, ""), one), "")


def permute_text(value: Column, key: str, tweak: str, letters: int = 26) -> Column:
    """Permute the digits and the letters (the first 26, or 6 of hex numbers) of a string.

    All else keeps its place. Four hashes cover 128 characters of a half.
    """
    middle = F.floor(F.length(value) / 2).cast("int")
    halves = F.struct(
        F.substring(value, F.lit(1), middle).alias("a"),
        F.substring(value, middle + 1, F.length(value)).alias("b"),
    )

    def turn(state: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, state["b"]).otherwise(state["a"])
        pad = F.concat(*[_digest(key, f"{tweak}{part}", i, other) for part in range(4)])
        return F.struct(
            F.when(i % 2 == 0, _shift(state["a"], pad, letters)).otherwise(state["a"]).alias("a"),
            F.when(i % 2 == 1, _shift(state["b"], pad, letters)).otherwise(state["b"]).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, sizes: tuple[int, int], key: str, tweak: str) -> Column:
    """Permute 0 .. sizes[0] * sizes[1] - 1."""
    zero = F.struct(
        F.floor(value / sizes[1]).cast("long").alias("a"), (value % sizes[1]).cast("long").alias("b")
    )

    def turn(state: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, state["b"]).otherwise(state["a"])
        add = F.conv(F.substring(_digest(key, tweak, i, other), 1, 13), 16, 10).cast("long")
        return F.struct(
            F.when(i % 2 == 0, (state["a"] + add) % sizes[0]).otherwise(state["a"]).alias("a"),
            F.when(i % 2 == 1, (state["b"] + add) % sizes[1]).otherwise(state["b"]).alias("b"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)), zero, turn, lambda s: s["a"] * F.lit(sizes[1]) + s["b"]
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, the last digit counting once."""
    parts = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)
        ),
    )
    return F.aggregate(parts, F.lit(0), lambda total, x: total + x)


def _mod97(account: Column) -> Column:
    """The remainder that makes a bank account number valid: 1."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(
        F.split(moved, ""), F.lit(0),
        lambda total, ch: F.when(ch.between("0", "9"), (total * 10 + ch.cast("int")) % 97).otherwise(
            (total * 100 + F.ascii(ch) - 55) % 97
        ),
    )


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9A-Za-z]", "")


def _laid_out(bare: Column, value: Column) -> Column:
    """The characters of ``bare`` with the separators that ``value`` has, at their places."""

    def one(ch: Column, i: Column) -> Column:
        before = F.length(_bare(F.substring(value, F.lit(1), i)))
        return F.when(ch.rlike("[0-9A-Za-z]"), F.substring(bare, before + 1, F.lit(1))).otherwise(ch)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _card(value: Column, key: str) -> Column:
    digits = _bare(value)
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    return F.concat(body, check.cast("string"))


def _iban(value: Column, key: str) -> Column:
    account = _bare(value)
    body = permute_text(F.substring(account, F.lit(5), F.length(account)), key, "iban")
    country = F.substring(account, 1, 2)
    check = 98 - _mod97(F.concat(country, F.lit("00"), body))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _phone(value: Column, key: str) -> Column:
    digits = _bare(value)
    code = F.when(value.startswith("+"), F.regexp_extract(digits, _CALLING, 0)).otherwise("")
    return F.concat(code, permute_text(F.substring(digits, F.length(code) + 1, F.length(digits)), key, "phone"))


def _address(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    number = F.lit(0).cast("long")
    for i in range(4):
        number = number * 256 + parts[i].cast("long")
    moved = permute_number(number, (1 << 16, 1 << 16), key, "ip")
    return F.concat_ws(".", *[(F.shiftright(moved, 24 - 8 * i) % 256).cast("string") for i in range(4)])


def _date(value: Column, layout: str, key: str) -> Column:
    """A date from 1900 to 2099 moved to another one; null if it is none.

    Days up to the 12th of a month are moved among themselves, later ones too (the permutation is
    repeated until it meets one). Day-first slash dates with a later day cannot be month-first ones,
    so the two never meet, and a day has the same pseudonym in every layout.
    """
    first = F.expr(f"date'{_FIRST_DAY}'")
    day = F.try_to_date(value, layout)
    number = F.datediff(day, first).cast("long")

    def on(number: Column) -> Column:
        return permute_number(number, _DAYS, key, "date1")

    def again(number: Column, _: Column) -> Column:
        return F.when(F.dayofmonth(F.date_add(first, number.cast("int"))) > 12, number).otherwise(on(number))

    late = F.date_add(first, F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), on(number), again).cast("int"))
    early = permute_number(
        ((F.year(day) - 1900) * 144 + (F.month(day) - 1) * 12 + F.dayofmonth(day) - 1).cast("long"), _EARLY, key, "date0"
    )
    early = F.date_add(
        F.add_months(first, F.floor(early / 12).cast("int")), (early % 12).cast("int")
    )
    valid = number.between(0, _DAYS[0] * _DAYS[1] - 1)
    return F.when(valid, F.date_format(F.when(F.dayofmonth(day) > 12, late).otherwise(early), layout))


def _social(digits: Column, key: str) -> Column:
    """Area (001 to 899 without 666), group and serial number, permuted as one number."""
    area = F.substring(digits, 1, 3).cast("long")
    area = area - 1 - (area > 666).cast("long")
    group, serial = F.substring(digits, 4, 2).cast("long") - 1, F.substring(digits, 6, 4).cast("long") - 1
    moved = permute_number((area * 99 + group) * 9999 + serial, (898 * 99, 9999), key, "ssn")
    area = F.floor(moved / (99 * 9999)) + 1
    parts = [(area + (area >= 666).cast("long"), 3), (F.floor(moved / 9999) % 99 + 1, 2), (moved % 9999 + 1, 4)]
    return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])


def _account(candidate: Column) -> Column:
    """The valid account number that a candidate begins with, null if there is none."""
    words = F.split(candidate, " ")
    starts = F.transform(  # longest first
        F.sequence(F.size(words), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")
    )

    def bare(account: Column) -> Column:
        return F.regexp_replace(account, " ", "")

    valid = F.filter(starts, lambda x: F.when(F.length(bare(x)) >= 15, _mod97(bare(x)) == 1).otherwise(False))
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    whole = F.try_element_at(lengths, F.substring(candidate, 1, 2))
    exact = F.filter(valid, lambda x: F.length(bare(x)) == whole)
    return F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(valid, F.lit(1)))


def _pattern(text: Column) -> Column:
    """What to look for in a text: all formats, of account numbers those that are valid."""
    candidates = F.regexp_extract_all(text, F.lit(f"(?=({IBAN}))"), F.lit(1))  # also inside of each other
    accounts = F.filter(F.array_distinct(F.transform(candidates, _account)), lambda x: x.isNotNull())
    longest = F.sort_array(F.transform(accounts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), asc=False)
    named = F.transform(  # none or one
        F.filter(F.array(F.array_join(longest["x"], "|")), lambda x: x != ""),
        lambda x: F.concat(F.lit(rf"{_FIRST}|(?<![0-9A-Za-z])(?:"), x, F.lit(rf")(?![0-9A-Za-z])|{_LAST}")),
    )
    return F.when(text.rlike(IBAN), F.try_element_at(named, F.lit(1)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a candidate, the candidate itself if it is not valid."""

    def is_(pattern: str) -> Column:
        return value.rlike(f"^(?:{pattern})$")

    digits = F.regexp_replace(value, "[^0-9]", "")
    email = F.concat(
        permute_text(F.regexp_extract(value, r"^(.*)\.[A-Za-z]+$", 1), key, "email"),
        F.regexp_extract(value, r"(\.[A-Za-z]+)$", 1),
    )
    slashed = F.coalesce(_date(value, "MM/dd/yyyy", key), _date(value, "dd/MM/yyyy", key))
    return F.coalesce(
        F.when(F.contains(value, F.lit("@")), email)
        .when(value.rlike("^[0-9a-fA-F]{32,64}$"), permute_text(value, key, "secret", letters=6))
        .when(is_(IP), _address(value, key))
        .when(is_(ISO_DATE), _date(value, "yyyy-MM-dd", key))
        .when(is_(SLASH_DATE), slashed)
        .when(is_(DOT_DATE), _date(value, "dd.MM.yyyy", key))
        .when(is_(SSN), _social(digits, key))
        .when(is_(CARD), F.when(_luhn(digits) % 10 == 0, _laid_out(_card(value, key), value)))
        .when(is_(IBAN), F.when(_mod97(_bare(value)) == 1, _laid_out(_iban(value, key), value)))
        .when(is_(PHONE), _laid_out(_phone(value, key), value)),
        value,
    )


def mask_text(
    df: DataFrame, key: str, text_col: str = "text", count_col: str = "n_values"
) -> DataFrame:
    """Replace personal data in a text column by pseudonyms and add ``count_col``, how many.

    All rows and other columns stay; a column named ``count_col`` is replaced. A null text stays
    null with 0 values; an empty one stays empty. ``key`` is the secret of the permutation:
    who knows it can undo the pseudonyms. It has no default and must not be empty.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    text = F.col(text_col)
    patterns = F.array(F.coalesce(_pattern(text), F.lit(f"{_FIRST}|{_LAST}")))
    found = F.transform(patterns, lambda p: F.struct(
        F.split(text, p, -1).alias("gaps"), F.regexp_extract_all(text, p, F.lit(0)).alias("old")
    ))
    # every candidate holds a digit or an at sign, so texts without any are left alone at once
    pieces = F.when(text.rlike("[0-9@]"), F.transform(found, lambda f: F.struct(
        f["gaps"].alias("gaps"), f["old"].alias("old"), F.transform(f["old"], lambda v: pseudonym(v, key)).alias("new")
    ))[0])
    cut = df.drop(count_col).withColumn(count_col, pieces)
    at = F.col(count_col)
    woven = F.concat_ws("", F.flatten(F.zip_with(
        at["gaps"], F.concat(at["new"], F.array(F.lit(""))), lambda gap, value: F.array(gap, value)
    )))
    changed = F.size(F.filter(F.zip_with(at["old"], at["new"], lambda a, b: a != b), lambda x: x))
    return cut.select(
        *[F.when(at.isNull(), text).otherwise(woven).alias(text_col) if x == text_col else F.col(x)
          for x in cut.columns[:-1]],
        F.when(at.isNull(), 0).otherwise(changed).cast("long").alias(count_col),
    )
