"""Format-preserving pseudonyms for personal data, in DataFrame expressions only.

Finds card numbers (Luhn), IBANs (modulo 97, in either case), IPv4 addresses, national numbers of nine digits
(in groups, or unbroken after a word that names them), telephone numbers, dates, mail addresses, bearer
tokens and other secrets. Numbers and dates that pass validation go through a keyed Feistel network over
the valid values of their own format, a permutation: equal values get equal pseudonyms in all documents,
different values different ones, what comes out is valid for the same detector, and who has the key can go
back. Mail addresses (their domains but for the last label) and secrets get keyed pseudonyms of the
same length and kinds of characters.

The key is the caller's. Without one each call draws its own, so pseudonyms are linked within that call
only and nobody can go back.

Defined results: a null text stays null, an empty one empty; what looks like a kind but fails its
validation stays; dates are permuted within 1900 to 2099, those with a part of one digit or the month
before the day among dates of the same shape; equal texts, repeated rows among them, get equal results; texts are
treated whole, whatever their length; columns keep their names, but one named as the count is to be is
``doc_`` and that name.
"""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

# Formats of what is found, most specific first.
PATTERNS = {
    "mail": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]{0,63}+@[\p{L}\p{N}](?:[\p{L}\p{N}\-]{0,62}+\.)+\p{L}{2,24}",
    "bearer": r"\b[bB](?i:earer)[ \t]{1,3}(?=[A-Za-z+/_\-.=~]{0,64}[0-9])[A-Za-z0-9+/_\-.=~]{16,}+",
    "secret": r"(?=[pstaPSTA])(?i:password|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?[A-Za-z0-9+/_\-.]{8,}+",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b|\bsk-[A-Za-z0-9]{20,}+\b",
    "named": r"\b[sS](?i:sn|ocial security(?: number| no\.?)?)[ \t]{0,3}[:=#]?[ \t]{0,3}[0-9]{9}(?![\w\-])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b"
    r"|\b[a-z]{2}[0-9]{2} ?(?:[a-z]{4}|(?=[a-z]{0,3}[0-9])[a-z0-9]{4})(?: ?(?=[a-z]{0,3}[0-9])[a-z0-9]{4}){1,6}(?: ?(?=[a-z]{0,3}[0-9])[a-z0-9]{1,4})?\b",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])",
    "date": r"(?<![\w\-/.])(?:[0-9]{4}([\-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([\-/.])[0-9]{1,2}\2[0-9]{4})(?![\w]|[\-/.][0-9])",
    "national": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "card": r"(?<![\w\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\w\-])",
    "unbroken": r"(?<![\w.+\-])(?:\+[1-9][0-9]{7,14}|[2-9][0-9]{2}[2-9][0-9]{6})(?![\w\-]|[.][0-9])",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-][0-9]{2,4}){1,4}(?![\w]|[.\-][0-9])",
}
_NUMBERS = ("ip", "date", "national", "card", "unbroken", "phone")
#: All patterns; those of numbers are tried only where one can begin.
ANY = "|".join([*(f"(?:{p})" for kind, p in PATTERNS.items() if kind not in _NUMBERS), "(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[kind]})" for kind in _NUMBERS) + ")"])
ANY = ANY.replace(r"\1", r"[\-/.]").replace(r"\2", r"[\-/.]")
#: What a text must have for any of the patterns to match.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]{1,3}\.[0-9]|[0-9][\-/ .][0-9]|[A-Z]{2}[0-9]{2}|A[KS]IA|gh[pousr]_|sk-|(?i:bearer)[ \t]|(?=[pstkPSTK])(?i:passw|pwd|secret|token|key)[a-zA-Z\"']{0,9}[ \t]{0,3}[=:]"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _draw(key: str, tag: str, *parts: Column) -> Column:
    """A keyed integer of 60 bits."""
    joined = F.concat_ws(":", F.lit(key), F.lit(tag), *[p.cast("string") for p in parts])
    return _number(F.substring(F.sha2(joined, 256), 1, 15))


def feistel_pair(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tag: str, backwards: bool = False) -> Column:
    """Permutes pairs (a below size_a, b below size_b): each round adds a keyed function of one half to the other."""

    def turn(acc: Column, i: Column) -> Column:
        left = F.lit(-1) if backwards else F.lit(1)
        on_a = F.pmod(acc["a"] + left * (_draw(key, tag, i, size_a, size_b, acc["b"]) % size_a), size_a)
        on_b = F.pmod(acc["b"] + left * (_draw(key, tag, i, size_a, size_b, acc["a"]) % size_b), size_b)
        even = i % 2 == 0
        return F.struct(F.when(even, on_a).otherwise(acc["a"]).alias("a"), F.when(even, acc["b"]).otherwise(on_b).alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if backwards else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _padded(number: Column, digits: Column) -> Column:
    return F.lpad(number.cast("string"), digits, "0")


def feistel_digits(digits: Column, key: str, tag: str, backwards: bool = False) -> Column:
    """Permutes strings of the same number of digits (2 to 36)."""
    n = F.length(digits)
    left = (n / 2).cast("int")
    right = n - left
    power = lambda x: F.rpad(F.lit("1"), x + 1, "0").cast("long")
    pair = feistel_pair(F.substring(digits, F.lit(1), left).cast("long"), F.substring(digits, left + 1, right).cast("long"), power(left), power(right), key, tag, backwards)
    return _let(pair, lambda p: F.concat(_padded(p["a"], left), _padded(p["b"], right)))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one after the other, by ``digits``."""

    def fill(new: Column) -> Column:
        step = lambda acc, c: F.when(
            c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], F.substring(new, acc["i"] + 1, F.lit(1))).alias("out"), (acc["i"] + 1).alias("i"))
        ).otherwise(F.struct(F.concat(acc["out"], c).alias("out"), acc["i"].alias("i")))
        return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step)["out"]

    return _let(digits, fill)


def _luhn_sum(digits: Column) -> Column:
    """Sum over digits from the right; every second one, the last not among them, is doubled."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda acc, i: acc + value(i))


def _card(m: Column, key: str) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string"))

    def new(digits: Column) -> Column:
        n = F.length(digits)
        body = F.concat(F.substring(digits, 1, 1), feistel_digits(F.substring(digits, F.lit(2), n - 2), key, "card"))
        return F.when((n >= 13) & (_luhn_sum(digits) % 10 == 0), _refilled(m, _let(body, checked)))

    return _let(_digits(m), new)


def _mod97(text: Column) -> Column:
    """Remainder of an account number, letters being 10 to 35."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(m: Column, key: str) -> Column:
    plain = F.upper(F.regexp_replace(m, " ", ""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    inside = _digits(body)

    def checked(account: Column) -> Column:
        return _refilled(m, F.concat(F.lpad((F.lit(98) - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), _digits(account)))

    new = F.when(F.length(inside) >= 2, _refilled(body, feistel_digits(inside, key, "iban"))).otherwise(body)
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1)
    return F.when(valid, _let(new, checked))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("int"))
    high, low = parts[0] * 256 + parts[1], parts[2] * 256 + parts[3]
    new = _let(feistel_pair(high, low, F.lit(65536), F.lit(65536), key, "ip"), lambda p: F.concat_ws(".", (p["a"] / 256).cast("int"), p["a"] % 256, (p["b"] / 256).cast("int"), p["b"] % 256))
    return F.when(F.forall(parts, lambda p: p <= 255), new)


#: Days from 1900-01-01 to 2099-12-31, 73,049, are the pairs of 17 and 4,297.
_DAYS = (17, 4297)
#: Steps after which a walk along a permutation gives up: one in 30 lands on no date, so it never does.
_WALK = 16


def _date(m: Column, key: str) -> Column:
    mark = F.regexp_extract(m, r"([\-/.])", 1)
    parts = F.split(m, r"[\-/.]")
    start = F.lit("1900-01-01").cast("date")

    def day_of(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")), "yyyy-MM-dd")

    def moved(date: Column) -> Column:
        at = F.datediff(date, start)
        pair = feistel_pair((at / _DAYS[1]).cast("int"), at % _DAYS[1], F.lit(_DAYS[0]), F.lit(_DAYS[1]), key, "date")
        return _let(pair, lambda p: F.date_add(start, (p["a"] * _DAYS[1] + p["b"]).cast("int")))

    def within(date: Column, first_day: Column) -> Column:
        """Among the dates whose month, and whose day, has as many digits."""
        first_month = F.when(F.month(date) < 10, 1).otherwise(10)
        months, days = F.when(F.month(date) < 10, 9).otherwise(3), F.when(first_day == 1, 9).otherwise(F.lit(32) - first_day)
        tag = F.concat_ws("-", F.lit("date"), first_month.cast("string"), first_day.cast("string"))

        def read(p: Column) -> Column:
            return day_of(F.lit(1900) + (p["a"] / months).cast("int"), first_month + p["a"] % months, first_day + p["b"])

        step = lambda acc, _: F.when(read(acc["p"]).isNotNull() & (acc["n"] > 0), acc).otherwise(
            F.struct(feistel_pair(acc["p"]["a"], acc["p"]["b"], months * 200, days, key, tag).alias("p"), (acc["n"] + 1).alias("n"))
        )
        own = F.struct(((F.year(date) - 1900) * months + F.month(date) - first_month).cast("long").alias("a"), (F.day(date) - first_day).cast("long").alias("b"))
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), F.struct(own.alias("p"), F.lit(0).alias("n")), step)["p"], read)

    def written(new: Column, year_at: int, month_at: int, day_at: int) -> Column:
        values = {year_at: F.year(new), month_at: F.month(new), day_at: F.day(new)}
        return F.concat_ws("", *[x for i in range(3) for x in ([mark] if i else []) + [F.lpad(values[i].cast("string"), F.length(parts[i]), "0")]])

    def in_order(year_at: int, month_at: int, day_at: int) -> Column:
        date = day_of(parts[year_at], parts[month_at], parts[day_at])
        late = month_at < day_at < year_at  # the month first: only days that can't be months tell
        narrow = (F.length(parts[month_at]) == 1) | (F.length(parts[day_at]) == 1) | F.lit(late)

        def new(d: Column) -> Column:
            first_day = F.lit(13) if late else F.when(F.day(d) < 10, 1).otherwise(10)
            return F.when(narrow, within(d, first_day)).otherwise(moved(d))

        inside = lambda d: F.when(d.between(start, F.lit("2099-12-31").cast("date")), _let(new(d), lambda x: written(x, year_at, month_at, day_at)))
        return _let(date, inside)

    return F.when(F.length(parts[0]) == 4, in_order(0, 1, 2)).otherwise(F.coalesce(in_order(2, 1, 0), in_order(2, 0, 1)))


def _national_digits(digits: Column, key: str) -> Column:
    """Permutes the valid national numbers: 898 areas (1 to 899 but for 666), 99 groups, 9,999 serials."""
    area, group, serial = (F.substring(digits, i, n).cast("int") for i, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pair = feistel_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "national")

    def new(p: Column) -> Column:
        return F.concat(_padded(p["a"] + F.when(p["a"] >= 665, 2).otherwise(1), F.lit(3)), _padded((p["b"] / 9999).cast("int") + 1, F.lit(2)), _padded(p["b"] % 9999 + 1, F.lit(4)))

    return F.when(valid, _let(pair, new))


def _national(m: Column, key: str) -> Column:
    return _let(_national_digits(_digits(m), key), lambda new: F.when(new.isNotNull(), _refilled(m, new)))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .\-(]", 1)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    digits = _digits(rest)
    marked = m.rlike(r"^\+|^\(") | m.rlike(r"^[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}$")
    return F.when(marked & F.length(_digits(m)).between(8, 15), F.concat(country, _refilled(rest, feistel_digits(digits, key, "phone"))))


def _unbroken(m: Column, key: str) -> Column:
    """With a plus the first digit stays; ten digits keep areas and exchanges from 200 on."""
    n = F.length(m)
    abroad = F.concat(F.substring(m, 1, 2), feistel_digits(F.substring(m, F.lit(3), n - 2), key, "phone"))
    pair = feistel_pair(F.substring(m, 1, 3).cast("long") - 200, F.substring(m, 4, 7).cast("long") - 2_000_000, F.lit(800), F.lit(8_000_000), key, "phone-10")
    return F.when(m.startswith("+"), abroad).otherwise(_let(pair, lambda p: F.concat((p["a"] + 200).cast("string"), (p["b"] + 2_000_000).cast("string"))))


def _like(value: Column, key: str, tag: str) -> Column:
    """Of the same length and kinds of characters, by a keyed digest of the value; long hexadecimal values stay such."""
    digest = F.concat(*[F.sha2(F.concat_ws(":", F.lit(key), F.lit(tag), F.lit(i), value), 256) for i in range(2)])
    hexadecimal = value.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$")
    return _let(F.struct(digest.alias("d"), hexadecimal.alias("hex")), lambda x: _alike(value, x["d"], x["hex"]))


def _alike(value: Column, digest: Column, hexadecimal: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        v = F.conv(F.substring(digest, (i * 2) % 127 + 1, F.lit(2)), 16, 10).cast("int")
        return (
            F.when(hexadecimal, F.substring(digest, i % 127 + 1, F.lit(1)))
            .when(c.rlike("^[0-9]$"), F.char(v % 10 + 48))
            .when(c.rlike(r"^\p{Lu}$"), F.char(v % 26 + 65))
            .when(c.rlike(r"^\p{L}$"), F.char(v % 26 + 97))
            .when(c.rlike(r"^\p{N}$"), F.char(v % 10 + 48))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _mail(m: Column, key: str) -> Column:
    domain = F.substring_index(m, "@", -1)
    last = F.substring_index(domain, ".", -1)
    first = F.substring(domain, F.lit(1), F.length(domain) - F.length(last))
    return F.concat(_like(F.substring_index(m, "@", 1), key, "mail"), F.lit("@"), _like(first, key, "domain"), last)


def _bearer(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"([^ \t]+)$", 1)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), _like(value, key, "secret"))


def _named(m: Column, key: str) -> Column:
    word = F.substring(m, F.lit(1), F.length(m) - 9)
    return F.concat(word, _national_digits(F.substring(m, F.length(m) - 8, F.lit(9)), key))


def _secret(m: Column, key: str) -> Column:
    value = F.regexp_extract(m, r"([A-Za-z0-9+/_\-.]+)$", 1)
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), _like(value, key, "secret"))


def _key(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), _like(F.substring(m, F.lit(5), F.length(m)), key, "key"))


_KINDS = {
    "mail": _mail,
    "bearer": _bearer,
    "secret": _secret,
    "key": _key,
    "named": _named,
    "iban": _iban,
    "ip": _ip,
    "date": _date,
    "national": _national,
    "card": _card,
    "unbroken": _unbroken,
    "phone": _phone,
}


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match; null where no kind's validation passes."""
    found = [F.when(match.rlike(f"^(?:{PATTERNS[kind]})$"), make(match, key)) for kind, make in _KINDS.items()]
    return F.coalesce(*found)


def pseudonymise(docs: DataFrame, *, text_col: str = "text", key: str | None = None, count_col: str | None = "n_found") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``count_col``, if named, counts the replacements."""
    key = key or token_hex(32)
    if count_col in docs.columns:
        docs = docs.withColumnRenamed(count_col, f"doc_{count_col}")
    text = F.col(text_col)
    pieces = F.split(text, ANY, -1)
    new = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("was"), pseudonym(m, key).alias("now")))
    some = docs.withColumn("__new", F.when(text.rlike(HINT), new)).withColumn("__hit", F.exists("__new", lambda x: x["now"].isNotNull()))
    filled = F.zip_with(pieces, "__new", lambda p, x: F.concat(p, F.coalesce(x["now"], x["was"], F.lit(""))))
    out = some.withColumn(text_col, F.when(F.col("__hit"), F.array_join(filled, "")).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.coalesce(F.size(F.filter("__new", lambda x: x["now"].isNotNull())), F.lit(0)).cast("long"))
    return out.drop("__new", "__hit")
