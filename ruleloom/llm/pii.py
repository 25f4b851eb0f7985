"""Format-preserving pseudonyms for personal data, by SQL functions only.

One regular expression finds candidates; each kind is validated (Luhn check,
octets, calendar dates, number ranges) and then permuted within its format by a
keyed Feistel network.  Two kinds of network serve:

- over characters: the value is cut into halves, and in each round the
  characters of one half move, each within its own class (digit, lower-case or
  upper-case letter), by a keystream that hashes key, round and the other half;
- over numbers: a value's number is cut into two digits of a mixed base, and in
  each round one moves, modulo its base, by a hash of key, round and the other.

Both are permutations of the values of a format, so equal values get equal
pseudonyms in every document and different ones stay different.  Formats are
chosen so that a pseudonym is valid too: a card's check digit is computed anew,
social security numbers and dates are numbered without gaps.  Only dates that
can be read month first alone have a prime number of values; there the network
covers 61 more, and is repeated until its result is valid, 62 times at most.

The work is inside a row: the text is split at the matches and joined again
with the pseudonyms, linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleloom.llm.order_minhash import let

ROUNDS = 6
#: Rounds over numbers, whose halves may be small.
NUMBER_ROUNDS = 10
FIRST_DAY = "1900-01-01"
#: Days to 2099-12-31: 17 x 4297.
DAY_BASES = (17, 4297)
#: Days after the twelfth of a month, and the bases that cover them.
LATE_DAYS, LATE_BASES = 44_249, (211, 210)
#: Areas (000, 666 and 9xx are not given out) x groups from 01, and serials from 0001.
SSN_BASES = (898 * 99, 9999)

#: What each kind looks like.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PHONE = r"(?<![0-9A-Za-z+(])(?:\+?1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-]))[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
ABROAD = r"(?<![0-9A-Za-z+(])\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
IP = r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[./-][0-9])"
CARD = r"(?<![0-9A-Za-z-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])"
#: A credential's name and what it is; passwords of any length, other tokens from 16 characters.
SECRET = r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|password=[^\s\"']++|token = \"[0-9A-Za-z_-]{16,}+(?=\")"
ANY = "|".join((SECRET, EMAIL, PHONE, ABROAD, SSN, IP, DATE, CARD))
#: Every match has one of these: texts without them hold nothing to find.
HINT = r"[0-9@]|AKIA|password=|token = "
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _classes(char: Column) -> Column:
    """A character's class as (first code, size); size 1 for what stays.

    Codes 1 to 8 stand for the digits 2 to 9 where a number can't begin with others.
    """
    code = F.ascii(char)
    kind = lambda low, size: F.struct(F.lit(low).alias("low"), F.lit(size).alias("size"))
    out = F.struct(code.alias("low"), F.lit(1).alias("size"))
    for low, size in ((1, 8), (65, 26), (97, 26), (48, 10)):
        out = F.when(code.between(low, low + size - 1), kind(low, size)).otherwise(out)
    return out


def _moved(half: Column, other: Column, label: Column) -> Column:
    """The characters of ``half``, each moved within its class by a keystream of ``other``."""
    stream = F.sha2(F.concat(label, F.lit("|"), other).cast("binary"), 512)

    def move(s: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            shift = F.conv(F.substring(s, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 32).cast("int")
            return let(_classes(c), lambda k: F.when(k["size"] == 1, c).otherwise(F.chr((k["low"] + (F.ascii(c) - k["low"] + shift) % k["size"]).cast("int"))))

        return F.array_join(F.transform(F.filter(F.split(half, ""), lambda c: c != ""), one), "")

    return let(stream, move)


def permuted(value: Column, key: str, tweak: str = "", rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the strings that share a value's format."""
    n = F.char_length(value)
    cut = F.ceil(n / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, n - cut).alias("b"))

    def step(s: Column, r: Column) -> Column:
        label = F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"))
        return F.when(r % 2 == 0, F.struct(_moved(s["a"], s["b"], label).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), _moved(s["b"], s["a"], label).alias("b")))

    return F.aggregate(F.array(*[F.lit(r) for r in range(rounds)]), start, step, lambda s: F.concat(s["a"], s["b"]))


def permuted_number(number: Column, bases: tuple[int, int], key: str, tweak: str) -> Column:
    """A keyed permutation of the numbers below the product of two bases."""
    low, high = bases

    def step(s: Column, r: Column) -> Column:
        f = lambda x: F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|{tweak}|"), r.cast("string"), F.lit("|"), x.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("bigint")
        return F.when(r % 2 == 0, F.struct(((s["a"] + f(s["b"])) % low).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), ((s["b"] + f(s["a"])) % high).alias("b")))

    n = number.cast("bigint")
    start = F.struct((n % low).alias("a"), F.floor(n / low).cast("bigint").alias("b"))
    return F.aggregate(F.array(*[F.lit(r) for r in range(NUMBER_ROUNDS)]), start, step, lambda s: s["b"] * low + s["a"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn."""
    return let(digits, lambda d: F.array_join(F.zip_with(F.split(value, "[0-9]"), F.concat(F.filter(F.split(d, ""), lambda c: c != ""), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), ""))


def check_digit(body: Column) -> Column:
    """The Luhn digit that completes a string of digits."""
    doubled = lambda c: let(c.cast("int") * 2, lambda x: F.when(x > 9, x - 9).otherwise(x))
    digits = F.filter(F.split(F.reverse(body), ""), lambda c: c != "")
    total = F.aggregate(F.transform(digits, lambda c, i: F.when(i % 2 == 0, doubled(c)).otherwise(c.cast("int"))), F.lit(0), lambda s, v: s + v)
    return ((10 - total % 10) % 10).cast("string")


def _card_valid(value: Column) -> Column:
    return let(digits_of(value), lambda d: F.char_length(d).between(13, 19) & (check_digit(F.substring(d, F.lit(1), F.char_length(d) - 1)) == F.substring(d, F.char_length(d), F.lit(1))))


def _card(value: Column, key: str) -> Column:
    body = lambda d: F.substring(d, F.lit(1), F.char_length(d) - 1)
    return let(digits_of(value), lambda d: let(permuted(body(d), key, "card"), lambda b: _refill(value, F.concat(b, check_digit(b)))))


def _ip(value: Column, key: str) -> Column:
    number = F.aggregate(F.split(value, r"\."), F.lit(0).cast("bigint"), lambda s, o: s * 256 + o.cast("bigint"))
    part = lambda n, at: F.shiftright(n, at).bitwiseAND(F.lit(255).cast("bigint")).cast("string")
    return let(permuted_number(number, (1 << 16, 1 << 16), key, "ip"), lambda n: F.concat_ws(".", *[part(n, at) for at in (24, 16, 8, 0)]))


def _ssn_valid(v: Column) -> Column:
    return v.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _ssn(value: Column, key: str) -> Column:
    part = lambda at, n: F.substring(value, at, n).cast("bigint")
    area = part(1, 3) - F.when(part(1, 3) > 666, 2).otherwise(1)
    number = ((part(8, 4) - 1) * SSN_BASES[0]) + area * 99 + part(5, 2) - 1
    text = lambda n, width: F.lpad(n.cast("string"), width, "0")

    def made(n: Column) -> Column:
        pair, serial = n % SSN_BASES[0], F.floor(n / SSN_BASES[0]) + 1
        area = F.floor(pair / 99) + 1
        return F.concat_ws("-", text(area + F.when(area > 665, 1).otherwise(0), 3), text(pair % 99 + 1, 2), text(serial, 4))

    return let(permuted_number(number, SSN_BASES, key, "ssn"), made)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits move; a number without a country's prefix keeps a first digit of 2 to 9."""
    marks = "".join(map(chr, range(1, 9)))
    national = lambda d: F.substring(d, -10, 10)
    first = lambda v: F.substring(v, 1, 1)
    rest = lambda v: F.substring(v, 2, 9)
    plain = lambda d: let(permuted(F.concat(F.translate(first(d), "23456789", marks), rest(d)), key, "phone"), lambda v: F.concat(F.translate(first(v), marks, "23456789"), rest(v)))
    prefixed = lambda d: F.concat(F.lit("1"), permuted(national(d), key, "phone1"))
    return let(digits_of(value), lambda d: _refill(value, F.when(F.char_length(d) > 10, prefixed(d)).otherwise(plain(d))))


def _abroad(value: Column, key: str) -> Column:
    return let(digits_of(value), lambda d: _refill(value, F.concat(F.substring(d, 1, 2), permuted(F.substring(d, F.lit(3), F.char_length(d)), key, "abroad"))))


def _read_day(value: Column) -> Column:
    """A struct (day, way): the date, and 0, 1 or 2 for year, day or month first; null for none."""
    p = lambda a, n: F.substring(value, a, n)
    made = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
    both = lambda day, way: F.struct(day.alias("day"), F.lit(way).alias("way"))
    iso, day_first, month_first = made(p(1, 4), p(6, 2), p(9, 2)), made(p(7, 4), p(4, 2), p(1, 2)), made(p(7, 4), p(1, 2), p(4, 2))
    other = F.when(day_first.isNotNull(), both(day_first, 1)).when(month_first.isNotNull(), both(month_first, 2))
    return F.when(value.rlike("^[0-9]{4}-"), F.when(iso.isNotNull(), both(iso, 0))).otherwise(other)


def _late_number(day: Column) -> Column:
    """Number of a day among those after the twelfth of a month."""
    months = (F.year(day) - 1900) * 12 + F.month(day)
    return F.date_diff(day, F.lit(FIRST_DAY).cast("date")) - 12 * months


def _late_day(number: Column) -> Column:
    start = F.lit(FIRST_DAY).cast("date")
    before = lambda m: F.date_diff(F.add_months(start, m), start) - 12 * m
    # an average month has 18.437 such days: the month is the guessed one or one beside it
    guess = F.greatest(F.floor(number * 2400 / LATE_DAYS).cast("int") - 1, F.lit(0))
    month = let(guess, lambda g: F.when(before(g + 2) <= number, g + 2).when(before(g + 1) <= number, g + 1).otherwise(g))
    return let(month, lambda m: F.date_add(F.add_months(start, m), (number - before(m)).cast("int") + 12))


def _date(value: Column, key: str) -> Column:
    """The day moves; a date stays in its own way of writing dates."""
    start, sign = F.lit(FIRST_DAY).cast("date"), F.substring(value, 3, 1)
    walk = lambda n: F.aggregate(F.sequence(F.lit(1), F.lit(LATE_BASES[0] * LATE_BASES[1] - LATE_DAYS)), _once(n, key), lambda v, _: F.when(v < LATE_DAYS, v).otherwise(_once(v, key)))
    any_day = lambda d, way: F.date_add(start, permuted_number(F.date_diff(d, start), DAY_BASES, key, f"day{way}").cast("int"))
    text = lambda d, *parts: F.concat(F.date_format(d, parts[0]), sign, F.date_format(d, parts[1]), sign, F.date_format(d, "yyyy"))
    return let(
        _read_day(value),
        lambda x: F.when(x["way"] == 0, F.date_format(any_day(x["day"], 0), "yyyy-MM-dd"))
        .when(x["way"] == 1, let(any_day(x["day"], 1), lambda d: text(d, "dd", "MM")))
        .otherwise(let(_late_day(walk(_late_number(x["day"]))), lambda d: text(d, "MM", "dd"))),
    )


def _once(number: Column, key: str) -> Column:
    return permuted_number(number, LATE_BASES, key, "day2")


def _email(value: Column, key: str) -> Column:
    at = F.instr(value, "@")
    return F.concat(permuted(F.substring(value, F.lit(1), at - 1), key, "email"), F.substring(value, at, F.char_length(value)))


def _behind(value: Column, name: str, key: str) -> Column:
    return F.concat(F.lit(name), permuted(F.substring(value, F.lit(len(name) + 1), F.char_length(value)), key, "secret"))


_SECRETS = {"key": "AKIA", "password": "password=", "token": 'token = "'}


def kind_of(value: Column) -> Column:
    """The kind of a whole match, in the order in which the pattern tries them; null if it isn't valid."""
    out = F.lit(None).cast("string")
    always = lambda v: F.lit(True)
    kinds = (
        ("email", EMAIL, always),
        ("phone", PHONE, always),
        ("abroad", ABROAD, lambda v: F.char_length(digits_of(v)).between(7, 15)),
        ("ssn", SSN, _ssn_valid),
        ("ip", IP, lambda v: v.rlike(_whole(rf"{_OCTET}(?:\.{_OCTET}){{3}}"))),
        ("date", DATE, lambda v: _read_day(v).isNotNull()),
        ("card", CARD, _card_valid),
    )
    for name, pattern, valid in reversed(kinds):
        out = F.when(value.rlike(_whole(pattern)), F.when(valid(value), F.lit(name))).otherwise(out)
    for name, begin in _SECRETS.items():
        out = F.when(value.startswith(begin), F.lit(name)).otherwise(out)
    return out


def _of_kind(k: Column, value: Column, key: str) -> Column:
    kinds = {"email": _email, "phone": _phone, "abroad": _abroad, "ssn": _ssn, "ip": _ip, "date": _date, "card": _card}
    out = value
    for name, made in kinds.items():
        out = F.when(k == name, made(value, key)).otherwise(out)
    for name, begin in _SECRETS.items():
        out = F.when(k == name, _behind(value, begin, key)).otherwise(out)
    return out


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match; the match itself where it isn't valid."""
    return let(kind_of(value), lambda k: _of_kind(k, value, key))


def pseudonymized(text: Column, key: str) -> Column:
    """A struct (text, found): the text with pseudonyms, and the valid matches as they were."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda v: F.struct(v.alias("v"), kind_of(v).alias("k")))

    def rebuilt(m: Column) -> Column:
        pieces = F.split(text, ANY, -1)
        whole = F.array_join(F.zip_with(pieces, F.concat(F.transform(m, lambda e: _of_kind(e["k"], e["v"], key)), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        valid = F.transform(F.filter(m, lambda e: e["k"].isNotNull()), lambda e: e["v"])
        return F.struct(F.when(F.size(valid) == 0, text).otherwise(whole).alias("text"), valid.alias("found"))

    none = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))
    return F.when(text.rlike(HINT), let(found, rebuilt)).otherwise(none)


def pseudonymize(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_found, text)`` for every document, with pseudonyms in its text.

    ``secret`` keys the permutations: who has it can undo them.  A null text
    stays null with nothing found; an empty text stays empty.  Candidates that
    fail validation stay as they are and don't count.  Texts of any length are
    read whole.  Equal values have equal pseudonyms.  Repeated rows are kept, an
    empty table gives an empty result, and other columns are ignored.
    """
    if not secret:
        raise ValueError("pseudonyms need a secret key")
    d = docs.select(F.col(f"`{key}`").alias(key), pseudonymized(F.col(f"`{text}`"), secret).alias("p"))
    return d.select(key, F.size(F.coalesce(F.col("p.found"), F.array().cast("array<string>"))).alias("n_found"), F.col("p.text").alias("text"))
