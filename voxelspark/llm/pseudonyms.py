"""Pseudonyms of personal numbers and dates: keyed Feistel permutations within each value's own format, in SQL expressions only.

Found and validated are payment cards (issuer's prefix and length, Luhn), IBANs (mod 97), IPv4 addresses (octets), dates (calendar), social security numbers, phone numbers and e-mail addresses.
Each is permuted within the set of valid values of its format: digits stay digits, letters letters, separators, domains and issuers' prefixes stay, check digits are made anew, dates stay dates
between 1800 and 2199. The permutation depends on the key and the value alone, so equal values have equal pseudonyms in all documents. What fails
validation is left as it is, and so are forms that are not looked for: IBANs in small letters, dates with month names or as 12-31-2024, IPv6 addresses, phone numbers that begin with 00,
cards whose groups are parted by line breaks or several blanks.

Defined results: a null text stays null and an empty one empty, with 0 pseudonyms; texts of any length are treated whole; repeated rows are treated alike; an empty table gives no rows;
other columns stay as they are, also those with the name of the count.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

ROUNDS = 8
CYCLE_START, CYCLE_DAYS, CYCLE_PARTS = "1800-01-01", 146097, (189, 773)  # 400 Gregorian years; their days as a product

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
#: Characters of an IBAN by country, without blanks.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{names.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_SIZES.items()) + r")(?![A-Za-z0-9])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Where another value or a card's month of expiry begins, a blank does not join groups of digits.
OTHER = r"(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)|\d{4}-\d{2}-\d{2}(?!\d)|\d{2}[./]\d{2}[./]\d{4}(?!\d)|\d{3}-\d{2}-\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|\d{2}/\d{2}(?!\d)|[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9]"
OTHER_CARD = r"\d{13,19}(?!\d)|\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d|\d{4}[ -]\d{6}[ -]\d{4}"
PHONE = (
    r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|(?<![\w+])\+\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?(?:(?:[.-]| (?!{OTHER}|\d{{13,19}}(?!\d)))?\d{{2,4}}){{2}}(?:(?:[.-]| (?!{OTHER}|{OTHER_CARD}))?\d{{2,4}})?(?!\d)"
    r"|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"
)
#: A whole run of digit groups, in which ``_cards`` looks for cards.
CARD = rf"(?<![\d.-])\d(?:(?:-| (?!{OTHER}))?\d){{12,}}+"
CARD_SHAPE = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}|\d{4}([ -])\d{4}\2\d{4}\2\d{4}\2\d{1,3}|\d{4}([ -])\d{6}\3\d{4,5})[ -]?$"
#: A card and its issuer's range. Prefixes, and numbers of digits after them.
ISSUERS = (
    (r"4", r"\d{12}|\d{15}|\d{18}"),
    (r"5[1-5]", r"\d{14}"),
    (r"222[1-9]|22[3-9]\d|2[3-6]\d\d|27[01]\d|2720", r"\d{12}"),
    (r"3[47]", r"\d{13}"),
    (r"30[0-59]", r"\d{11,16}"),
    (r"3[689]", r"\d{12,17}"),
    (r"35(?:2[89]|[3-8]\d)", r"\d{12,15}"),
    (r"6011", r"\d{12,15}"),
    (r"64[4-9]", r"\d{13,16}"),
    (r"6[25]", r"\d{14,17}"),
    (r"50(?:18|20|38)|5893|6304|6759|676[123]", r"\d{9,15}"),
)
ISSUER = "^(?:" + "|".join(f"(?:{prefix})(?=(?:{rest})$)" for prefix, rest in ISSUERS) + ")"
ANY = "|".join((EMAIL, IPV4, IBAN, DATE, SSN, PHONE, CARD))


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _draw(key: Column, kind: str, round_: Column, seen: Column, i: Column | None = None) -> Column:
    """A keyed number below 2**28 from the other half; ``i`` gives one for each place, eight from a digest."""
    part = [] if i is None else [F.floor(i / 8).cast("string")]
    h = F.sha2(F.concat_ws("|", key, F.lit(kind), round_.cast("string"), seen.cast("string"), *part), 256)
    at = F.lit(1) if i is None else (i % 8) * 7 + 1
    return F.conv(F.substring(h, at, F.lit(7)), 16, 10).cast("long")


def _shifted(s: Column, draw) -> Column:
    """Each letter or digit of ``s`` moved on within its class by draw(place)."""

    def move(c: Column, i: Column) -> Column:
        out = c
        for first, many, test in ((48, 10, "[0-9]"), (65, 26, "[A-Z]"), (97, 26, "[a-z]")):
            out = F.when(c.rlike(test), F.char((F.ascii(c) - first + draw(i)) % many + first)).otherwise(out)
        return out

    return F.when(F.length(s) == 0, s).otherwise(F.array_join(F.transform(_chars(s), move), ""))


def permute_text(s: Column, key: Column, kind: str) -> Column:
    """Feistel permutation of strings that have their letters and digits in the same places as ``s``."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))

    def turn(t: Column, r: Column) -> Column:
        odd = F.struct(_shifted(t["a"], lambda i: _draw(key, kind, r, t["b"], i)).alias("a"), t["b"].alias("b"))
        even = F.struct(t["a"].alias("a"), _shifted(t["b"], lambda i: _draw(key, kind, r, t["a"], i)).alias("b"))
        return F.when(r % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda t: F.concat(t["a"], t["b"]))


def permute_number(x: Column, parts: tuple[int, int], key: Column, kind: str) -> Column:
    """Feistel permutation of the numbers below parts[0] * parts[1]."""
    p, q = parts
    start = F.struct(F.floor(x / q).cast("long").alias("a"), (x % q).cast("long").alias("b"))

    def turn(t: Column, r: Column) -> Column:
        odd = F.struct(((t["a"] + _draw(key, kind, r, t["b"])) % p).alias("a"), t["b"].alias("b"))
        even = F.struct(t["a"].alias("a"), ((t["b"] + _draw(key, kind, r, t["a"])) % q).alias("b"))
        return F.when(r % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda t: t["a"] * q + t["b"])


def _luhn(digits: Column) -> Column:
    """The Luhn sum's last digit."""
    n = F.length(digits)
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    d = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, doubled(d(i))).otherwise(d(i))) % 10


def _mod97(s: Column) -> Column:
    """The remainder of letters (A = 10) and digits read as one number."""

    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[A-Z]"), (r * 100 + F.ascii(c) - 55) % 97).otherwise((r * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(_chars(s), F.lit(0), step)


def _refill(template: Column, digits: Column) -> Column:
    """``template`` with its digits replaced, in order, by ``digits``."""
    place = lambda i: F.length(_digits(F.substring(template, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(template)), lambda i: F.when(F.substring(template, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, place(i), F.lit(1))).otherwise(F.substring(template, i, F.lit(1)))), "")


def _card(m: Column, key: Column) -> Column:
    d = _digits(m)
    kept = F.regexp_extract(d, ISSUER, 0)
    body = C.bound(kept, lambda k: F.concat(k, permute_text(F.substring(d, F.length(k) + 1, F.length(d) - F.length(k) - 1), key, "card")))
    number = C.bound(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
    return C.bound(number, lambda n: _refill(m, n))


def _cards(m: Column, key: Column) -> Column:
    """A run of digit groups with its cards replaced, and their number.

    From left to right, the longest neighbouring groups that are valid and in a card's grouping are a card. At the start of the run any grouping is tried too, up to 19 digits.
    A card's grouping begins with 4 or at least 13 digits, so no other group but the run's first is tried as a start.
    """

    def treated(groups: Column) -> Column:
        last = F.size(groups) - 1
        joined = lambda i, j: F.array_join(F.slice(groups, i + 1, j - i + 1), "")

        def valid(i: Column, j: Column) -> Column:
            x = joined(i, j)
            n = F.length(_digits(x))
            longest = (i == 0) & ((j == last) | (F.length(_digits(joined(i, j + 1))) > 19))
            return n.between(13, 19) & (longest | x.rlike(CARD_SHAPE)) & C.bound(_digits(x), lambda d: d.rlike(ISSUER) & (_luhn(d) == 0))

        starts = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | F.element_at(groups, i + 1).rlike(r"^(?:\d{4}|\d{13,19})[ -]?$"))
        ends = F.transform(starts, lambda i: F.struct(i.alias("i"), F.array_max(F.filter(F.sequence(i, F.least(i + 18, last)), lambda j: valid(i, j))).alias("j")))
        found = F.filter(ends, lambda s: s["j"].isNotNull())
        none = F.array().cast("array<struct<i:int,j:int>>")
        # of cards that overlap, the first in the text is taken
        cards = F.aggregate(found, none, lambda taken, s: F.when((F.size(taken) > 0) & (s["i"] <= F.try_element_at(taken, F.lit(-1))["j"]), taken).otherwise(F.array_append(taken, s)))

        def filled(taken: Column) -> Column:
            before = lambda k: F.coalesce(F.get(taken, k - 1)["j"], F.lit(-1))
            pieces = F.transform(taken, lambda s, k: F.concat(joined(before(k) + 1, s["i"] - 1), _card(joined(s["i"], s["j"]), key)))
            text = F.concat(F.array_join(pieces, ""), joined(before(F.size(taken)) + 1, last))
            return F.struct(F.when(F.size(taken) > 0, text).alias("text"), F.size(taken).alias("n"))

        return C.bound(cards, filled)

    return C.bound(F.regexp_extract_all(m, F.lit(r"\d+[ -]?"), F.lit(0)), treated)


def _ipv4(m: Column, key: Column) -> Column:
    octets = F.transform(F.split(m, "\\."), lambda o: o.cast("long"))
    n = permute_number(F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o), (65536, 65536), key, "ipv4")
    return C.bound(n, lambda x: F.concat_ws(".", *[(F.shiftright(x, 8 * k) % 256).cast("string") for k in (3, 2, 1, 0)]))


def _date(m: Column) -> Column:
    """The date that a match names, day before month unless only month before day is valid; null if none."""
    iso = F.when(m.rlike("^[0-9]{4}-"), m)
    part = lambda a, n: F.substring(m, a, n)
    day_first = F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))
    month_first = F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2))
    return F.when(iso.isNotNull(), F.try_to_date(iso, "yyyy-MM-dd")).otherwise(F.coalesce(F.try_to_date(day_first, "yyyy-MM-dd"), F.try_to_date(month_first, "yyyy-MM-dd")))


def _new_date(m: Column, key: Column) -> Column:
    start = F.to_date(F.lit(CYCLE_START))
    d = F.date_add(start, permute_number(F.date_diff(_date(m), start).cast("long"), CYCLE_PARTS, key, "date").cast("int"))
    sep = F.substring(m, 3, 1)
    day_first = F.try_to_date(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)), "yyyy-MM-dd").isNotNull()
    order = lambda x, *parts: F.array_join(F.array(*[F.date_format(x, p) for p in parts]), "|")
    return C.bound(d, lambda x: F.when(m.rlike("^[0-9]{4}-"), F.date_format(x, "yyyy-MM-dd")).when(day_first, F.replace(order(x, "dd", "MM", "yyyy"), F.lit("|"), sep)).otherwise(F.replace(order(x, "MM", "dd", "yyyy"), F.lit("|"), sep)))


def _iban(m: Column, key: Column) -> Column:
    s = F.regexp_replace(m, " ", "")
    body = permute_text(F.substring(s, F.lit(5), F.length(s)), key, "iban")
    country = F.substring(s, 1, 2)
    new = C.bound(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
    place = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i), " ", ""))
    return C.bound(new, lambda n: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(n, place(i), F.lit(1)))), ""))


def _phone(m: Column, key: Column) -> Column:
    """The country's digits stay: those after the plus sign up to the first separator, two if there is none."""
    d, lead = _digits(m), F.regexp_extract(m, r"^\+(\d+)", 1)
    kept = F.when(F.length(lead) > 3, F.lit(2)).otherwise(F.length(lead))
    new = F.concat(F.substring(d, F.lit(1), kept), permute_text(F.substring(d, kept + 1, F.length(d)), key, "phone"))
    return C.bound(new, lambda n: _refill(m, n))


def _email(m: Column, key: Column) -> Column:
    local = F.regexp_extract(m, "^([^@]*)@", 1)
    return F.concat(permute_text(local, key, "email"), F.substring(m, F.length(local) + 1, F.length(m)))


def pseudonym(m: Column, key: Column) -> Column:
    """The pseudonym of a match of ``ANY``, null if it is not valid, and the number of values in it."""
    one = lambda x: C.bound(x, lambda t: F.struct(t.alias("text"), t.isNotNull().cast("int").alias("n")))
    whole = lambda p: m.rlike(f"^(?:{p})$")
    d = _digits(m)
    iban = F.regexp_replace(m, " ", "")
    day = _date(m)
    other = (
        F.when(m.contains("@"), _email(m, key))
        .when(whole(IPV4), F.when(F.forall(F.split(m, "\\."), lambda o: o.cast("int") < 256), _ipv4(m, key)))
        .when(m.rlike("^[A-Z]"), F.when(_mod97(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))) == 1, _iban(m, key)))
        .when(whole(DATE), F.when(day.between(F.to_date(F.lit(CYCLE_START)), F.to_date(F.lit("2199-12-31"))), _new_date(m, key)))
        .when(whole(SSN), F.when(~m.rlike("^(?:000|666|9)") & ~m.rlike("-00-|-0000$"), C.bound(permute_text(d, key, "ssn"), lambda n: _refill(m, n))))
        .when(whole(PHONE), _phone(m, key))
    )
    numeric = ~m.contains("@") & m.rlike(f"^(?:{CARD})$") & ~whole(f"{DATE}|{SSN}|{PHONE}")
    return F.when(numeric, _cards(m, key)).otherwise(one(other))


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pseudonyms") -> DataFrame:
    """``docs`` with the text's personal numbers, dates and addresses replaced, and their number in ``count_col``, or, if ``docs`` has such a column, in one with a number after the name."""
    taken = {c.lower() for c in docs.columns}
    free = lambda name: next(n for n in itertools.chain([name], (f"{name}_{k}" for k in itertools.count(1))) if n.lower() not in taken)
    made, count_col = free("_pseudonyms"), free(count_col)
    text, secret = F.col(text_col), F.lit(key)
    none = F.lit(0).cast("long")

    def replaced(found: Column, new: Column) -> Column:
        # the pieces between matches, each followed by its match's replacement
        filled = F.concat(F.zip_with(found, new, lambda m, n: F.coalesce(n["text"], m)), F.array(F.lit("")))
        pieces = F.zip_with(F.split(text, ANY, -1), filled, lambda p, x: F.concat(p, x))
        return F.struct(F.array_join(pieces, "").alias("text"), F.aggregate(new, none, lambda s, x: s + x["n"]).alias("n"))

    def treated(found: Column) -> Column:
        as_is = F.struct(text.alias("text"), none.alias("n"))
        return F.when(F.size(found) == 0, as_is).otherwise(C.bound(F.transform(found, lambda m: pseudonym(m, secret)), lambda new: replaced(found, new)))

    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    out = docs.withColumn(made, C.bound(found, treated))
    same = [F.col(f"{made}.text").alias(text_col) if c.lower() == text_col.lower() else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*same, F.coalesce(F.col(f"{made}.n"), none).alias(count_col))
