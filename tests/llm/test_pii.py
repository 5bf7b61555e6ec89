"""Pseudonyms against a plain Python version, over whole texts."""

from __future__ import annotations

import datetime
import hashlib
import random

import pytest
import regex

from lumenframe.llm import pii

KEY = "k1"
ANY = regex.compile(pii.ANY)
EACH = {kind: regex.compile(f"^(?:{p})$") for kind, p in pii.PATTERNS.items()}


def draw(tag, *parts):
    return int(hashlib.sha256(":".join([KEY, tag, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def network(a, b, size_a, size_b, tag):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + draw(tag, i, size_a, size_b, b) % size_a) % size_a
        else:
            b = (b + draw(tag, i, size_a, size_b, a) % size_b) % size_b
    return a, b


def digits_of(text, tag):
    left = len(text) // 2
    right = len(text) - left
    a, b = network(int(text[:left]), int(text[left:]), 10**left, 10**right, tag)
    return f"{a:0{left}d}{b:0{right}d}"


def only_digits(text):
    return "".join(c for c in text if c in "0123456789")


def refilled(shape, digits):
    given = iter(digits)
    return "".join(next(given) if c in "0123456789" else c for c in shape)


def luhn(text):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(text)))


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def card(m):
    d = only_digits(m)
    if luhn(d) % 10:
        return None
    body = d[0] + digits_of(d[1:-1], "card")
    return refilled(m, body + str(-luhn(body + "0") % 10))


def iban(m):
    plain = m.replace(" ", "").upper()
    if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
        return None
    inside = only_digits(plain[4:])
    body = refilled(plain[4:], digits_of(inside, "iban")) if len(inside) > 1 else plain[4:]
    return refilled(m, f"{98 - mod97(body + plain[:2] + '00'):02d}" + only_digits(body))


def ip(m):
    p = [int(x) for x in m.split(".")]
    if max(p) > 255:
        return None
    a, b = network(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(m):
    parts, mark = regex.split(r"[\-/.]", m), regex.search(r"[\-/.]", m)[0]
    for order in [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]:
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        if not 1900 <= day.year <= 2099:
            return None
        late = order == (2, 0, 1)
        if late or len(parts[order[1]]) == 1 or len(parts[order[2]]) == 1:
            first_month, months = (1, 9) if day.month < 10 else (10, 3)
            first_day = 13 if late else 1 if day.day < 10 else 10
            days = 9 if first_day == 1 else 32 - first_day
            a, b = (day.year - 1900) * months + day.month - first_month, day.day - first_day
            while True:
                a, b = network(a, b, months * 200, days, f"date-{first_month}-{first_day}")
                try:
                    new = datetime.date(1900 + a // months, first_month + a % months, first_day + b)
                    break
                except ValueError:
                    pass
        else:
            at = (day - datetime.date(1900, 1, 1)).days
            a, b = network(at // 4297, at % 4297, 17, 4297, "date")
            new = datetime.date(1900, 1, 1) + datetime.timedelta(a * 4297 + b)
        values = dict(zip(order, (new.year, new.month, new.day)))
        return mark.join(f"{values[i]:0{len(parts[i])}d}" for i in range(3))
    return None


def national_digits(d):
    area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
    areas = [x for x in range(1, 900) if x != 666]
    if area not in areas or not group or not serial:
        return None
    a, b = network(areas.index(area), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "national")
    return f"{areas[a]:03d}{b // 9999 + 1:02d}{b % 9999 + 1:04d}"


def national(m):
    new = national_digits(only_digits(m))
    return new and refilled(m, new)


def named(m):
    new = national_digits(m[-9:])
    return new and m[:-9] + new


def unbroken(m):
    if m[0] == "+":
        return m[:2] + digits_of(m[2:], "phone")
    a, b = network(int(m[:3]) - 200, int(m[3:]) - 2_000_000, 800, 8_000_000, "phone-10")
    return f"{a + 200}{b + 2_000_000}"


def phone(m):
    if not (m[0] in "+(" or regex.match(r"^[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}$", m)) or not 8 <= len(only_digits(m)) <= 15:
        return None
    country = regex.match(r"(\+[0-9]{1,3})(?=[ .\-(])|", m)[0]
    return country + refilled(m[len(country) :], digits_of(only_digits(m[len(country) :]), "phone"))


def alike(value, tag):
    digest = "".join(hashlib.sha256(":".join([KEY, tag, str(i), value]).encode()).hexdigest() for i in range(2))
    if regex.match("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$", value):
        return "".join(digest[i % 127] for i in range(len(value)))
    out = ""
    for i, c in enumerate(value):
        v = int(digest[i * 2 % 127 :][:2], 16)
        out += str(v % 10) if regex.match(r"\p{N}", c) else chr(v % 26 + 65) if regex.match(r"\p{Lu}", c) else chr(v % 26 + 97) if regex.match(r"\p{L}", c) else c
    return out


def mail(m):
    local, domain = m.split("@")
    last = domain.rsplit(".", 1)[1]
    return f"{alike(local, 'mail')}@{alike(domain[: -len(last)], 'domain')}{last}"


def secret(m, chars=r"[A-Za-z0-9+/_\-.]+$"):
    value = regex.search(chars, m)[0]
    return m[: -len(value)] + alike(value, "secret")


def key(m):
    return m[:4] + alike(m[4:], "key")


KINDS = {"mail": mail, "bearer": lambda m: secret(m, r"[^ \t]+$"), "secret": secret, "key": key, "named": named, "iban": iban, "ip": ip, "date": date, "national": national, "card": card, "unbroken": unbroken, "phone": phone}


def plain(text):
    n = 0

    def new(m):
        nonlocal n
        for kind, make in KINDS.items():
            if EACH[kind].match(m[0]) and (out := make(m[0])) is not None:
                n += 1
                return out
        return m[0]

    return (None, 0) if text is None else (ANY.sub(new, text), n)


def texts():
    r = random.Random(5)
    d = lambda n: "".join(r.choices("0123456789", k=n))
    for _ in range(150):
        body = d(15)
        check = str(-luhn(body + "0") % 10)
        account = d(18)
        day = datetime.date(1900, 1, 1) + datetime.timedelta(r.randrange(73_049))
        sep = r.choice("-/.")
        yield f"card {body}{check} or {body[:4]} {body[4:8]} {body[8:12]} {body[12:]}{check}, not {d(16)}"
        yield f"DE{98 - mod97(account + 'DE00'):02d}{account} and de{98 - mod97(account + 'DE00'):02d} " + " ".join(account[i : i + 4] for i in range(0, 18, 4)) + " then this"
        yield f"{day.year}{sep}{day.month}{sep}{day.day} {day.day}{sep}{day.month}{sep}{day.year} {day:%d/%m/%Y} {day:%m/%d/%Y} {day:%Y-%m-%d}"
        yield f"{d(3)}-{d(2)}-{d(4)} SSN: {d(9)}; +{r.randint(1, 9)}{d(r.randint(7, 14))} {r.randint(2, 9)}{d(2)}{r.randint(2, 9)}{d(6)} +1 ({d(3)}) 555-{d(4)} {d(3)}-{d(3)}-{d(4)} {d(9)}"
        yield f"Müller.{d(2)}@firma{d(1)}.de a@b.co x.{d(3)}@mail{d(1)}.example.com Bearer {d(8)}abcDEF~{d(9)}= token={d(20)}ab {r.randrange(300)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}"


@pytest.fixture(scope="module")
def compared(spark):
    rows = [*texts(), None, "", "+19885552485 9885552485 gb82 west 1234 5698 7654 32 1/2/1999", "a" * 200_000 + " 1999-01-02 " + "9" * 50_000]
    rows += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return rows, {r.doc_id: r for r in pii.pseudonymise(df, key=KEY).collect()}


def test_whole_texts_equal_plain_python(compared):
    rows, got = compared
    for i, text in enumerate(rows):
        assert (got[i].text, got[i].n_found) == plain(text), text
    assert sum(r.n_found for r in got.values()) > 1500


def test_formats_hold(spark, compared):
    rows, got = compared
    address = regex.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])")
    for i, text in enumerate(rows):
        if text:
            assert len(address.sub("", got[i].text)) == len(address.sub("", text))
    # what comes out is found again, in the same places
    again = spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string")
    assert {r.doc_id: r.n_found for r in pii.pseudonymise(again, key=KEY).collect()} == {i: r.n_found for i, r in got.items()}


def test_keys_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "call +19885552485", 7), (1, "call +19885552485", 7)], "doc_id long, text string, n_found int")
    out = pii.pseudonymise(df, key="a").collect()
    assert [(r.doc_n_found, r.n_found) for r in out] == [(7, 1)] * 2 and out[0].text == out[1].text
    assert pii.pseudonymise(df, key="b").first().text != out[0].text
    assert pii.pseudonymise(df).first().text != pii.pseudonymise(df).first().text
