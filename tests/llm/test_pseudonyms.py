"""Pseudonyms against a plain Feistel network, as permutations, and on odd tables."""

import datetime
import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from voxelspark.llm import pseudonyms

KEY = "k"
#: Prefixes of the issuers whose cards stand in these tests.
PREFIXES = ("4", "51", "2221", "37", "6011", "62", "3530")


def draw(kind, round_, seen, i=None):
    part = "" if i is None else f"|{i // 8}"
    digest = hashlib.sha256(f"{KEY}|{kind}|{round_}|{seen}{part}".encode()).hexdigest()
    at = 0 if i is None else i % 8 * 7
    return int(digest[at : at + 7], 16)


def shifted(s, kind, round_, seen):
    out = ""
    for i, c in enumerate(s):
        for first, many in ((48, 10), (65, 26), (97, 26)):
            if first <= ord(c) < first + many:
                c = chr((ord(c) - first + draw(kind, round_, seen, i)) % many + first)
                break
        out += c
    return out


def plain_text(s, kind):
    a, b = s[: len(s) // 2], s[len(s) // 2 :]
    for r in range(1, pseudonyms.ROUNDS + 1):
        if r % 2:
            a = shifted(a, kind, r, b)
        else:
            b = shifted(b, kind, r, a)
    return a + b


def plain_number(x, parts, kind):
    p, q = parts
    a, b = divmod(x, q)
    for r in range(1, pseudonyms.ROUNDS + 1):
        if r % 2:
            a = (a + draw(kind, r, b)) % p
        else:
            b = (b + draw(kind, r, a)) % q
    return a * q + b


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def refilled(template, new):
    new = iter(new)
    return re.sub(r"[0-9]", lambda m: next(new), template)


def plain(kind, m):
    d = re.sub(r"\D", "", m)
    if kind == "card":
        kept = next(n for n in (1, 2, 3, 4) if d[:n] in PREFIXES)
        body = d[:kept] + plain_text(d[kept:-1], "card")
        return refilled(m, body + str((10 - luhn(body + "0")) % 10))
    if kind == "ipv4":
        n = plain_number(int.from_bytes(bytes(map(int, m.split(".")))), (65536, 65536), "ipv4")
        return ".".join(map(str, n.to_bytes(4)))
    if kind == "date":
        start = datetime.date(1800, 1, 1)
        day = datetime.date.fromisoformat(m) if m[4] == "-" else datetime.date(int(m[6:]), int(m[3:5]), int(m[:2]))
        new = start + datetime.timedelta(plain_number((day - start).days, pseudonyms.CYCLE_PARTS, "date"))
        return new.isoformat() if m[4] == "-" else f"{new.day:02}{m[2]}{new.month:02}{m[2]}{new.year}"
    if kind == "ssn":
        return refilled(m, plain_text(d, "ssn"))
    if kind == "phone":
        lead = re.match(r"\+(\d*)", m)
        kept = 0 if lead is None else 2 if len(lead[1]) > 3 else len(lead[1])
        return refilled(m, d[:kept] + plain_text(d[kept:], "phone"))
    if kind == "email":
        local = m.split("@")[0]
        return plain_text(local, "email") + m[len(local) :]
    body = plain_text(m[4:], "iban")
    number = int("".join(str(int(c, 36)) for c in body + m[:2] + "00")) % 97
    return f"{m[:2]}{98 - number:02}{body}"


def iban(country, body):
    return f"{country}{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}{body}"


def values(n, seed=1):
    r = random.Random(seed)
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    for _ in range(n):
        body = "4" + digits(14)
        card = body + str((10 - luhn(body + "0")) % 10)
        yield "card", r.choice([card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}", f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}"])
        yield "ipv4", ".".join(str(r.randrange(256)) for _ in range(4))
        day = datetime.date(1800, 1, 1) + datetime.timedelta(r.randrange(146097))
        yield "date", r.choice([day.isoformat(), f"{day.day:02}.{day.month:02}.{day.year}"])
        yield "ssn", f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        yield "phone", f"+{r.choice(['1', '44', '351'])} ({r.randint(200, 999)}) 555-{digits(4)}"
        yield "email", "".join(r.choices("abcXYZ019._", k=r.randint(1, 40))) + "@mail.example.org"
        yield "iban", iban("DE", digits(18))
        yield "iban", iban("GB", "WEST" + digits(14))
        yield "iban", iban("MT", "MALT" + digits(5) + "0012345MTLCAST00" + digits(2))


def test_values_against_a_plain_network(spark):
    made = [*values(25)]
    frame = spark.createDataFrame([(i, f"see {m}, then") for i, (_, m) in enumerate(made)], "id int, text string")
    rows = pseudonyms.pseudonymize(frame, KEY).collect()
    for r in rows:
        kind, m = made[r.id]
        assert (r.text, r.n_pseudonyms) == (f"see {plain(kind, m)}, then", 1), (kind, m)


def test_permutations_meet_no_value_twice(spark):
    """All strings of four digits, all numbers below 35 * 41, and long halves whose characters draw from several digests."""
    s = F.lpad(F.col("id").cast("string"), 4, "0")
    assert spark.range(10_000).select(pseudonyms.permute_text(s, F.lit(KEY), "t").alias("x")).distinct().count() == 10_000
    got = [r.x for r in spark.range(35 * 41).select(pseudonyms.permute_number(F.col("id"), (35, 41), F.lit(KEY), "t").alias("x")).collect()]
    assert sorted(got) == list(range(35 * 41))
    same = spark.createDataFrame([("a" * 40,)], "s string").select(pseudonyms.permute_text(F.col("s"), F.lit(KEY), "t").alias("x")).first().x
    assert same == plain_text("a" * 40, "t") and same[:8] != same[8:16]


def test_values_in_text(spark):
    """Values followed by words and numbers, and what is not valid."""
    card, code = "4845168114407329", "BE68539007547034"
    texts = [f"{code} EUR 5", f"{card} 12/27", f"{card} EUR", f"x{card}", "4845168114407328", "1.2.3.456", "2023-02-29", "0000000000000000"]
    rows = {r.id: r for r in pseudonyms.pseudonymize(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), KEY).collect()}
    assert rows[0].text == f"{plain('iban', code)} EUR 5" and rows[1].text == f"{plain('card', card)} 12/27" and rows[2].text == f"{plain('card', card)} EUR"
    assert all(rows[i].text == texts[i] and rows[i].n_pseudonyms == 0 for i in (4, 5, 6, 7))


def test_only_cards_of_issuers_are_cards(spark):
    """Valid check digits alone make no card; the issuer's prefix and length stay."""

    def number(prefix, length, seed):
        body = prefix + "".join(random.Random(seed).choices("0123456789", k=length - len(prefix) - 1))
        return body + str((10 - luhn(body + "0")) % 10)

    cards = [number(p, n, n) for p, n in (("4", 16), ("4", 13), ("51", 16), ("2221", 16), ("37", 15), ("6011", 16), ("62", 19), ("3530", 16))]
    others = [number(p, n, s) for s in range(20) for p, n in (("9", 16), ("0", 16), ("1", 13), ("7", 16), ("4", 14), ("51", 15), ("37", 16), ("2720", 17), ("2721", 16), ("8", 19))]
    years = "2001 2002 2003 2004 2005 2006 2007 2008 " * 20
    frame = spark.createDataFrame([(i, f"n {x}.") for i, x in enumerate(cards)] + [(100 + i, f"n {x}.") for i, x in enumerate(others)] + [(999, years)], "id int, text string")
    rows = {r.id: r for r in pseudonyms.pseudonymize(frame, KEY).collect()}
    for i, x in enumerate(cards):
        assert (rows[i].text, rows[i].n_pseudonyms) == (f"n {plain('card', x)}.", 1)
    assert all((rows[100 + i].text, rows[100 + i].n_pseudonyms) == (f"n {x}.", 0) for i, x in enumerate(others))
    assert (rows[999].text, rows[999].n_pseudonyms) == (years, 0)


def test_long_runs_of_groups(spark):
    """200,000 groups of one digit, and 3,000 cards in a row, take seconds."""
    card = "4845 1681 1440 7329"
    frame = spark.createDataFrame([(1, "7 " * 200_000), (2, f"{card} " * 3000), (3, "1 2 3 " + card + " 5 6 " + card)], "id int, text string")
    began = time.time()
    rows = {r.id: r for r in pseudonyms.pseudonymize(frame, KEY).collect()}
    assert time.time() - began < 60
    new = plain("card", card)
    assert rows[1].text == "7 " * 200_000 and rows[2].text == f"{new} " * 3000 and rows[3].text == f"1 2 3 {new} 5 6 {new}"
    assert [rows[i].n_pseudonyms for i in (1, 2, 3)] == [0, 3000, 2]


def test_odd_tables(spark):
    text = "a 161.17.88.162 b"
    frame = spark.createDataFrame([(None, text, 7, "p", 1.5), (1, None, 8, None, None), (1, "", 9, "", 0.0), (2, text, 7, "p", 1.5), (2, text, 7, "p", 1.5), (3, ("word " * 40_000) + text, 0, "", 0.0)], "doc_id long, text string, n_pseudonyms int, _pseudonyms string, `a.b` double")
    out = pseudonyms.pseudonymize(frame, KEY)
    assert out.columns == [*frame.columns, "n_pseudonyms_1"]
    rows = out.collect()
    assert [(r.doc_id, r.n_pseudonyms, r["_pseudonyms"], r["a.b"]) for r in rows] == [(r.doc_id, r.n_pseudonyms, r["_pseudonyms"], r["a.b"]) for r in frame.collect()]
    new = f"a {plain('ipv4', '161.17.88.162')} b"
    assert [(r.text, r.n_pseudonyms_1) for r in rows] == [(new, 1), (None, 0), ("", 0), (new, 1), (new, 1), ("word " * 40_000 + new, 1)]
    assert pseudonyms.pseudonymize(frame.limit(0), KEY).count() == 0
