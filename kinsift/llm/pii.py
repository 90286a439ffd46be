"""Format-preserving pseudonyms for personal numbers and dates, by keyed Feistel permutations.

A value that passes its format's validation is mapped to another valid value of the same format by a permutation of
that format: a Feistel network over two residues, Z_a x Z_b with a * b valid values, whose round function is a keyed
hash.  Permutations are one-to-one, so equal values stay equal across documents and different ones stay different;
separators and digit grouping stay as written.

========  ==============================================================  =========================================
kind      validated by                                                    permuted
========  ==============================================================  =========================================
card      Luhn, 13 to 19 digits, plain or in groups                       all digits but the first and the check digit
phone     ``+1``/NANP shape, or ``+`` and 8 to 15 digits                  NANP: area and number; else all but 2 digits
ssn       area, group and serial in range                                 all three
iban      ISO 7064 mod 97                                                 digits of the account part, new check digits
ip        four octets up to 255                                           all four octets
date      calendar (ISO, dotted, slashed), years 1800 to 2199             the day, within these 400 years
email     shape                                                           not a number: a keyed hash names the user
========  ==============================================================  =========================================

Only DataFrame functions run: matches are taken by one regular expression, mapped by higher-order functions, and put
back between the pieces that the same expression leaves.  There is no shuffle.

Defined results: null texts stay null with no findings, empty ones stay empty; what does not validate is left as it is;
repeated rows give repeated results; an empty table gives an empty result; other columns are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of 400 Gregorian years, from 1800-01-01 to 2199-12-31: 189 * 773.
DAY_A, DAY_B = 189, 773

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])"
#: Countries by the length of their IBAN: where a written one in groups of four ends.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FO FI GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC"}
_GROUPED = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{_GROUPED})(?![A-Za-z0-9])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2})|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./-][0-9]))"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
PHONE = r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,5}\)?){2,6})(?![0-9A-Za-z])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
ANY = "|".join((EMAIL, IBAN, IP, DATE, SSN, PHONE, CARD))


def _keyed(key: str, *parts: Column) -> Column:
    """HMAC-like keyed hash of the parts, as 64 hexadecimal digits."""
    return F.sha2(F.concat(F.lit(f"{key}|outer|"), F.sha2(F.concat_ws("|", F.lit(f"{key}|inner"), *parts), 256)), 256)


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("long"), F.lit(0).cast("long"))


def feistel(key: str, kind: str, left: Column, right: Column, a: Column, b: Column, tweak: Column) -> Column:
    """A permutation of Z_a x Z_b as a struct (l, r): in each round one side moves by a keyed hash of the other.

    Sides swap roles from round to round; after an even number each is back in its own range.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(state: Column, i: Column) -> Column:
        size = F.when(i % 2 == 0, a).otherwise(b).cast("long")
        noise = F.conv(F.substring(_keyed(key, F.lit(kind), tweak, i.cast("string"), state["r"].cast("string")), 1, 15), 16, 10).cast("long")
        # noise is below 2**60: the sum stays within a long
        return F.struct(state["r"].alias("l"), F.pmod(state["l"] + F.pmod(noise, size), size).alias("r"))

    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _in_layout(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced, in order, by ``digits``."""

    def at(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(text, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), at), "")


def _pad(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _permute_digits(key: str, kind: str, digits: Column, tweak: Column) -> Column:
    """A permutation of the digit strings of one length (2 to 30)."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    out = feistel(key, kind, _number(F.substr(digits, F.lit(1), half)), _number(F.substr(digits, half + 1, rest)), power(half), power(rest), F.concat_ws("/", F.length(digits).cast("string"), tweak))
    return F.transform(F.array(out), lambda s: F.concat(_pad(s["l"], half), _pad(s["r"], rest)))[0]


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum of digits; from the right, those at places of parity ``doubled`` count twice."""

    def step(total: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _card(key: str, m: Column) -> tuple[Column, Column]:
    digits = _digits(m)
    ok = m.rlike(f"^(?:{CARD})$") & (_luhn_sum(digits, 1) % 10 == 0)
    inner = _permute_digits(key, "card", F.substr(digits, F.lit(2), F.length(digits) - 2), F.substr(digits, F.lit(1), F.lit(1)))
    new = F.transform(F.array(F.concat(F.substr(digits, F.lit(1), F.lit(1)), inner)), lambda p: F.concat(p, F.pmod(-_luhn_sum(p, 0), F.lit(10)).cast("string")))[0]
    return ok, _in_layout(m, new)


def _phone(key: str, m: Column) -> tuple[Column, Column]:
    digits = _digits(m)
    shape = m.rlike(f"^(?:{PHONE})$") & F.length(digits).between(8, 15)
    ten = F.right(digits, F.lit(10))
    nanp = (F.length(digits) == 10) | ((F.length(digits) == 11) & digits.startswith("1"))
    nanp &= ten.rlike("^[2-9][0-9]{2}[2-9]")
    area, number = _number(F.substring(ten, 1, 3)) - 200, _number(F.substring(ten, 4, 7)) - 2_000_000
    out = feistel(key, "phone", area, number, F.lit(800), F.lit(8_000_000), F.lit("nanp"))
    country = F.when(F.length(digits) == 11, "1").otherwise("")
    north = F.transform(F.array(out), lambda s: F.concat(country, (s["l"] + 200).cast("string"), (s["r"] + 2_000_000).cast("string")))[0]
    other = F.concat(F.substring(digits, 1, 2), _permute_digits(key, "phone", F.substr(digits, F.lit(3), F.length(digits) - 2), F.substring(digits, 1, 2)))
    return shape & (nanp | m.startswith("+")), _in_layout(m, F.when(nanp, north).otherwise(other))


def _ssn(key: str, m: Column) -> tuple[Column, Column]:
    digits = _digits(m)
    area, group, serial = _number(F.substring(digits, 1, 3)), _number(F.substring(digits, 4, 2)), _number(F.substring(digits, 6, 4))
    ok = m.rlike(f"^(?:{SSN})$") & area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    out = feistel(key, "ssn", place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), F.lit(""))

    def written(s: Column) -> Column:
        number = s["l"] + 1 + F.when(s["l"] >= 665, 1).otherwise(0)
        return F.concat_ws("-", _pad(number, 3), _pad(F.floor(s["r"] / 9999) + 1, 2), _pad(s["r"] % 9999 + 1, 4))

    return ok, F.transform(F.array(out), written)[0]


def _mod97(text: Column) -> Column:
    """The number that letters and digits spell (A is 10), modulo 97."""

    def step(rest: Column, i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _iban(key: str, written: Column) -> tuple[Column, Column]:
    m = F.replace(written, F.lit(" "), F.lit(""))
    account, country = F.substr(m, F.lit(5), F.length(m)), F.substring(m, 1, 2)
    ok = written.rlike(f"^(?:{IBAN})$") & (_mod97(F.concat(account, F.substring(m, 1, 4))) == 1) & (F.length(_digits(account)) >= 2)
    digits = _digits(account)
    shape = F.concat(country, F.regexp_replace(account, "[0-9]", "#"))
    made = _in_layout(account, _permute_digits(key, "iban", digits, shape))
    new = F.transform(F.array(made), lambda x: F.concat(country, _pad(98 - _mod97(F.concat(x, country, F.lit("00"))), 2), x))[0]
    return ok, F.when(written.contains(" "), F.regexp_replace(new, "(.{4})(?=.)", "$1 ")).otherwise(new)


def _ip(key: str, m: Column) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: _number(x))
    ok = m.rlike(f"^(?:{IP})$") & (F.size(octets) == 4) & (F.array_max(octets) < 256)
    part = lambda i: F.coalesce(F.get(octets, F.lit(i)), F.lit(0))
    out = feistel(key, "ip", part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), F.lit(""))
    return ok, F.transform(F.array(out), lambda s: F.concat_ws(".", *((F.floor(s[x] / d) % 256).cast("string") for x in "lr" for d in (256, 1))))[0]


def _date(key: str, m: Column) -> tuple[Column, Column]:
    digits = _digits(m)
    piece = lambda at, n: F.substring(digits, at, n).try_cast("int")
    make = lambda y, mo, d: F.try_to_timestamp(F.concat_ws("-", _pad(y, 4), _pad(mo, 2), _pad(d, 2)), F.lit("yyyy-MM-dd")).cast("date")
    iso, dotted = m.rlike("^[0-9]{4}-"), m.contains(".")
    month_first = make(piece(5, 4), piece(1, 2), piece(3, 2))
    day_first = make(piece(5, 4), piece(3, 2), piece(1, 2))
    american = ~iso & ~dotted & month_first.isNotNull()
    value = F.when(iso, make(piece(1, 4), piece(5, 2), piece(7, 2))).when(american, month_first).otherwise(day_first)
    start = F.lit("1800-01-01").cast("date")
    day = F.date_diff(value, start)
    ok = m.rlike(f"^(?:{DATE})$") & day.between(0, DAY_A * DAY_B - 1)
    out = feistel(key, "date", F.floor(day / DAY_B), F.pmod(day, F.lit(DAY_B)), F.lit(DAY_A), F.lit(DAY_B), F.lit(""))

    def written(s: Column) -> Column:
        new = F.date_add(start, (s["l"] * DAY_B + s["r"]).cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(dotted, F.date_format(new, "dd.MM.yyyy")).when(american, F.date_format(new, "MM/dd/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))

    return ok, F.transform(F.array(out), written)[0]


def _email(key: str, m: Column) -> tuple[Column, Column]:
    return m.rlike(f"^(?:{EMAIL})$"), F.concat(F.lit("user-"), F.substring(_keyed(key, F.lit("email"), F.lower(m)), 1, 16), F.lit("@example.invalid"))


KINDS = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``docs`` with ``text_column`` pseudonymised, and a column ``pii`` of (kind, pseudonym) in text order.

    ``key``: the secret of all permutations; with another key values are linked to other pseudonyms.
    """
    text = F.col(text_column)

    def mapped(m: Column) -> Column:
        kind, new = F.lit(None).cast("string"), m
        for name, rule in reversed(KINDS.items()):
            ok, value = rule(key, m)
            ok = F.coalesce(ok, F.lit(False))
            kind, new = F.when(ok, name).otherwise(kind), F.when(ok, value).otherwise(new)
        return F.struct(kind.alias("kind"), new.alias("new"))

    # texts without a digit or an @ hold nothing: they skip the long expression
    found = docs.withColumn("_found", F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("_new", F.transform(F.coalesce("_found", F.array().cast("array<string>")), mapped))
    pieces = F.zip_with(F.split(text, ANY, -1), F.col("_new.new"), lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))
    real = F.filter("_new", lambda x: x["kind"].isNotNull())
    out = found.withColumn("pii", F.transform(real, lambda x: F.struct(x["kind"].alias("kind"), x["new"].alias("pseudonym"))))
    return out.withColumn(text_column, F.when(F.size("pii") > 0, F.array_join(pieces, "")).otherwise(text)).drop("_found", "_new")
