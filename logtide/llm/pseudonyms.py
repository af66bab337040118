"""Format-preserving pseudonyms by keyed Feistel networks, in SQL functions only.

Candidates are found by one pattern and then validated: card numbers by their check digit, IBANs by mod 97, social
security numbers and addresses by their ranges, dates by the calendar. What is valid is permuted within its
format, so the pseudonym is valid as well, and equal values get equal pseudonyms in every document, whatever
separators they are written with. What is not valid stays as it is. Everything happens within the row.

Two networks are used: over pairs of numbers (x + F(y) mod m, y + F(x) mod n) for addresses, dates and social
security numbers, whose valid values are exactly m * n; over characters, where each half is shifted by digits of
the keyed hash of the other, digit within the digits and letter within the letters, for all others. Both are
undone by running the rounds backwards with the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "ssn", "date", "iban", "phone", "card")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _iban_pattern() -> str:
    """Exactly as many characters as the country's accounts have, in fours or without blanks."""
    made = []
    for length in sorted(set(IBAN_LENGTHS.values())):
        fours, rest = divmod(length - 4, 4)
        countries = "|".join(c for c, n in IBAN_LENGTHS.items() if n == length)
        made.append(rf"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (rf" ?[A-Z0-9]{{{rest}}}" if rest else ""))
    return f"(?:{'|'.join(made)})"


_NUMBERS = (
    rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.[0-9])",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}",
    _iban_pattern(),
    r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}",
    r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}",
    r"[0-9]{3}-[0-9]{3}-[0-9]{4}",
    r"[0-9]{3}\.[0-9]{3}\.[0-9]{4}",
    r"[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}",
    r"[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}",
    r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}",
    r"[0-9]{13,19}",
)
#: All candidates; a number neither follows nor precedes a letter or digit, nor goes on from one before a sign. Only a
#: date may stand directly before a letter, the T of a time.
_TIMED = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?=T[0-9]{2})"
CANDIDATE = rf"{_EMAIL}|(?<![0-9A-Za-z])(?<![0-9][.+-])(?:{_TIMED}|(?:{'|'.join(_NUMBERS)})(?![0-9A-Za-z]))"

#: Days from 1800 to 2199: 400 years, 189 * 773 days.
_FIRST_DAY, _DAYS = "1800-01-01", (189, 773)
#: Social security numbers: 898 areas (1-899 without 666), 99 groups of 9999 serials.
_SSN = (898, 99 * 9999)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hash(key: str, kind: str, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value).cast("binary"), 512)


def _turns(inverse: bool) -> Column:
    return F.array(*[F.lit(k) for k in (reversed(range(ROUNDS)) if inverse else range(ROUNDS))])


def _permute_pair(x: Column, y: Column, sizes: tuple[int, int], key: str, kind: str, inverse: bool) -> Column:
    """struct(x, y): a keyed permutation of all pairs below ``sizes``."""
    sign = -1 if inverse else 1

    def amount(turn, value):
        return F.conv(F.substring(_hash(key, kind, turn, value.cast("string")), 1, 12), 16, 10).cast("long")

    def turn_of(s, turn):
        new_x = F.pmod(s["x"] + sign * (amount(turn, s["y"]) % sizes[0]), F.lit(sizes[0]))
        new_y = F.pmod(s["y"] + sign * (amount(turn, s["x"]) % sizes[1]), F.lit(sizes[1]))
        even = turn % 2 == 0
        return F.struct(F.when(even, new_x).otherwise(s["x"]).alias("x"),
                        F.when(even, s["y"]).otherwise(new_y).alias("y"))

    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    return F.aggregate(_turns(inverse), start, turn_of)


def _shift(char: Column, by: Column) -> Column:
    """A character moved within its class; what is neither digit nor ASCII letter stays."""
    def within(base, size):
        return F.char(F.lit(base) + F.pmod(F.ascii(char) - base + by, F.lit(size)))

    return (F.when(char.rlike("^[0-9]$"), within(48, 10)).when(char.rlike("^[a-z]$"), within(97, 26))
            .when(char.rlike("^[A-Z]$"), within(65, 26)).otherwise(char))


def _permute_text(text: Column, key: str, kind: str, inverse: bool) -> Column:
    """A keyed permutation of all texts with the same classes of characters."""
    sign = -1 if inverse else 1

    def moved(half, other, turn):
        def with_hash(h):
            def one(c, at):
                digits = F.substr(h, F.pmod(at, F.lit(32)) * 4 + 1, F.lit(4))
                return _shift(c, sign * F.conv(digits, 16, 10).cast("int"))

            return F.array_join(F.transform(F.split(half, "", -1), one), "")

        return F.when(half == "", half).otherwise(_let(_hash(key, kind, turn, other), with_hash))

    def turn_of(s, turn):
        even = turn % 2 == 0
        return F.struct(F.when(even, moved(s["a"], s["b"], turn)).otherwise(s["a"]).alias("a"),
                        F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], turn)).alias("b"))

    cut = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), cut).alias("a"), F.substr(text, cut + 1).alias("b"))
    return F.aggregate(_turns(inverse), start, turn_of, lambda s: F.concat(s["a"], s["b"]))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _in_format(text: Column, values: Column, kept: str) -> Column:
    """``values`` written over the characters of ``text`` that match ``kept``, one after the other."""
    def one(c, at):
        place = F.length(F.regexp_replace(F.substr(text, F.lit(1), at + 1), f"[^{kept}]", ""))
        return F.when(c.rlike(f"^[{kept}]$"), F.substr(values, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(text, "", -1), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum mod 10 of a digit string with its check digit last."""
    length = F.length(digits)

    def add(total, at):
        d = F.substr(digits, at, F.lit(1)).cast("int")
        return total + F.when((length - at) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), length), F.lit(0), add) % 10


def _mod97(account: Column) -> Column:
    """An account number (check digits last) mod 97, letters as 10 to 35."""
    def add(rest, c):
        return F.when(c.rlike("^[0-9]$"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(account, "", -1), F.lit(0), add)


def _card(m: Column, key: str, inverse: bool) -> Column:
    def use(digits):
        payload = _permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card", inverse)
        full = _let(payload, lambda p: F.concat(p, F.pmod(10 - _luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when(_luhn(digits) == 0, _let(full, lambda f: _in_format(m, f, "0-9")))

    return _let(_digits(m), use)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    def use(plain):
        country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5))
        valid = _mod97(F.concat(account, F.substr(plain, F.lit(1), F.lit(4)))) == 1

        def checked(body):
            check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
            return _in_format(m, F.concat(country, check, body), "0-9A-Z")

        return F.when(valid, _let(_permute_text(account, key, "iban", inverse), checked))

    return _let(F.regexp_replace(m, " ", ""), use)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}", 0)  # stays
    national = F.substr(m, F.length(country) + 1)
    return F.concat(country, _let(_permute_text(_digits(national), key, "phone", inverse),
                                  lambda d: _in_format(national, d, "0-9")))


def _email(m: Column, key: str, inverse: bool) -> Column:
    return F.concat(_permute_text(F.substring_index(m, "@", 1), key, "email", inverse), F.lit("@"),
                    F.substring_index(m, "@", -1))


def _ip(m: Column, key: str, inverse: bool) -> Column:
    def octet(k):
        return F.get(F.split(m, r"\."), F.lit(k)).cast("int")

    pair = _permute_pair(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), (65536, 65536), key, "ip", inverse)
    return _let(pair, lambda p: F.concat_ws(".", *[
        x.cast("string") for h in ("x", "y") for x in (F.shiftright(p[h], 8), p[h] % 256)]))


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(k)).cast("int") for k in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = _permute_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, _SSN, key,
                         "ssn", inverse)

    def write(p):
        area = p["x"] + F.when(p["x"] >= 665, 2).otherwise(1)
        return F.format_string("%03d-%02d-%04d", area, (F.floor(p["y"] / 9999) + 1).cast("long"), p["y"] % 9999 + 1)

    return F.when(valid, _let(pair, write))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """Dates as yyyy-MM-dd, MM/dd/yyyy (or dd/MM/yyyy where that alone is valid) and dd.MM.yyyy, padded as found.

    Where day and month take two digits without padding, ``inverse`` may give a padded date back.
    """
    def number(k):
        return F.get(F.split(m, "[-/.]"), F.lit(k))

    def valid(y, mo, d):
        return F.concat(y, F.lit("-"), F.lpad(mo, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")

    iso, dots = m.rlike("^[0-9]{4}-"), m.rlike(r"\.")
    month_first = valid(number(2), number(0), number(1))
    day_first = valid(number(2), number(1), number(0))
    day = F.when(iso, valid(number(0), number(1), number(2))).when(dots, day_first).otherwise(
        F.coalesce(month_first, day_first))

    def write(p):
        new = F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["x"] * _DAYS[1] + p["y"]).cast("int"))
        padded = m.rlike("^[0-9]{2}[/.][0-9]{2}[/.]")

        def text(a, b, sep):
            return F.when(padded, F.date_format(new, f"{a}{a}{sep}{b}{b}{sep}yyyy")).otherwise(
                F.date_format(new, f"{a}{sep}{b}{sep}yyyy"))

        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(dots, text("d", "M", ".")).when(
            month_first.isNotNull(), text("M", "d", "/")).otherwise(text("d", "M", "/"))

    def use(index):
        pair = _permute_pair(F.floor(index / _DAYS[1]), index % _DAYS[1], _DAYS, key, "date", inverse)
        return F.when(index.between(0, _DAYS[0] * _DAYS[1] - 1), _let(pair, write))

    return _let(F.datediff(day, F.lit(_FIRST_DAY).cast("date")), use)


_SHAPES = (
    ("email", "@", _email),
    ("ip", rf"^(?:{_OCTET}\.){{3}}{_OCTET}$", _ip),
    ("ssn", "^[0-9]{3}-[0-9]{2}-[0-9]{4}$", _ssn),
    ("date", r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})$", _date),
    ("iban", "^[A-Z]{2}", _iban),
    ("phone", r"^[+(]|^[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}$", _phone),
    ("card", "", _card),
)


def _replace(m: Column, key: str, inverse: bool) -> Column:
    """struct(kind, value) of a candidate; kind is null and the value the candidate itself where it is not valid."""
    kind, value = None, None
    for name, shape, make in _SHAPES:
        fits = m.rlike(shape) if shape else F.lit(True)
        kind = F.when(fits, name) if kind is None else kind.when(fits, name)
        made = make(m, key, inverse)
        value = F.when(fits, made) if value is None else value.when(fits, made)
    return _let(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), F.coalesce(v, m).alias("value")))


def pseudonymise(docs: DataFrame, key: str, inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and the pseudonyms as ``entities`` (array of kind, value).

    The key is part of the plan; keep event logs as safe as the key. ``inverse`` gives the values back for texts
    that this function wrote. A null text stays null, without entities, and an empty one empty; repeated rows
    get the same result; an empty table gives no rows. Columns named entities, _found or _gaps are replaced; all
    others stay. Mail addresses keep their domain, phone numbers their country code, IBANs their country.
    """
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    found = F.coalesce(found, F.expr("cast(array() as array<string>)"))
    gaps = F.when(F.size("_found") > 0, F.split("text", CANDIDATE, -1))
    rows = docs.drop("entities", "_found", "_gaps").withColumn("_found", found).withColumn("_gaps", gaps)
    rows = rows.withColumn("_found", F.transform("_found", lambda m: _replace(m, key, inverse)))
    woven = F.array_join(F.transform("_gaps", lambda g, at: F.concat(
        g, F.coalesce(F.get("_found", at)["value"], F.lit("")))), "")
    text = F.when(F.size("_found") > 0, woven).otherwise(F.col("text"))
    entities = F.filter("_found", lambda e: e["kind"].isNotNull())
    columns = [c for c in docs.columns if c != "entities"]
    return rows.withColumns({"text": text, "entities": entities}).select(*[F.col(f"`{c}`") for c in columns], "entities")


def count_kinds(entities: str = "entities") -> dict[str, Column]:
    """``n_email``, ``n_ip``, …: number of entities of each kind."""
    def number(kind):
        return F.size(F.filter(entities, lambda e: e["kind"] == kind)).cast("long")

    return {f"n_{kind}": number(kind) for kind in KINDS}
