"""Format-preserving pseudonyms for personal data, in native expressions.

Numbers and dates are found by pattern, validated (check digits, ranges, the calendar), and
replaced by a keyed Feistel permutation of their format: eight rounds, whose round function
is SHA-256 of the key, the kind of value, the round and the other half. The same value gives
the same pseudonym in every document and under every punctuation; different values never
share one. What fails validation stays as it is.

Two permutations serve all kinds. `permuted_string` keeps a string's length and each
character's class (digit, capital, small letter; anything else stays). `permuted_number`
permutes 0..a*b-1. Check digits are computed anew, so a pseudonym is again valid.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1800-01-01 on: 400 Gregorian years are 146097 = 189 * 773 days.
FIRST_DAY, DAY_A, DAY_B = "1800-01-01", 189, 773

#: Patterns of each kind. Java syntax, no capturing groups; possessive where a run has no second reading.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.)+[A-Za-z]{2,}+(?![A-Za-z0-9])",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api_key))\s*+[=:]\s*+(?:\"[^\"\n]++\"|'[^'\n]++')",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4})(?![0-9]|[./\-][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9+(])\+[0-9]{8,15}(?![0-9])|(?<![0-9+(])(?:\+[0-9]{1,3}[ \-]?)(?:\([0-9]{2,4}\)[ \-]?|[0-9]{2,4}[ \-.])[0-9]{3,4}[ \-.]?[0-9]{3,4}(?![0-9])|(?<![0-9+(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def shifted(c: Column, by: Column) -> Column:
    """A character moved by so much within its class."""
    code = F.ascii(c)

    def within(first: int, size: int) -> Column:
        return F.char(F.pmod(code - first + by, F.lit(size)) + first)

    return F.when(c.rlike("^[0-9]$"), within(48, 10)).when(c.rlike("^[a-z]$"), within(97, 26)).when(c.rlike("^[A-Z]$"), within(65, 26)).otherwise(c)


def digest(key: str, kind: str, number: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), half).cast("binary"), 256)


def permuted_string(s: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings of s's length and classes of characters."""

    def step(state: Column, i: Column) -> Column:
        def mixed(d: Column) -> Column:
            # two digits of the digest for each character, from its start again after 32
            return F.array_join(F.transform(chars(state["l"]), lambda c, j: shifted(c, F.conv(F.substring(d, 1 + 2 * F.pmod(j, F.lit(32)), F.lit(2)), 16, 10).cast("int"))), "")

        return F.struct(state["r"].alias("l"), let(digest(key, kind, i, state["r"]), mixed).alias("r"))

    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("l"), F.substring(s, half + 1, F.length(s)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda x: F.concat(x["l"], x["r"]))


def permuted_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """A keyed permutation of 0..a*b-1."""

    def value(i: Column, other: Column) -> Column:
        return F.conv(F.substring(digest(key, kind, i, other.cast("string")), 1, 15), 16, 10).cast("long")

    def step(s: Column, i: Column) -> Column:
        low = F.pmod(s["l"] + value(i * 2, s["r"]), F.lit(a))
        return let(low, lambda y: F.struct(y.alias("l"), F.pmod(s["r"] + value(i * 2 + 1, y), F.lit(b)).alias("r")))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step, lambda s: s["l"] * b + s["r"])


# ---- check digits


def luhn_sum(digits: Column) -> Column:
    """The sum whose remainder by ten is zero for a valid number."""
    n = F.length(digits)
    each = F.transform(chars(digits), lambda c, j: let(c.cast("int") * F.when(F.pmod(n - j, F.lit(2)) == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(each, F.lit(0), lambda s, v: s + v)


def mod97(s: Column) -> Column:
    """The remainder by 97 of a string of digits and capitals, a letter standing for 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.pmod(r * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(r * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(chars(s), F.lit(0), step)


def only(pattern: str, s: Column) -> Column:
    return F.regexp_replace(s, f"[^{pattern}]", "")


def refilled(template: Column, signs: str, values: Column) -> Column:
    """template with its signs of the class replaced in order by those of values."""

    def each(c: Column, j: Column) -> Column:
        place = F.length(only(signs, F.substring(template, F.lit(1), j + 1)))
        return F.when(c.rlike(f"^[{signs}]$"), F.substring(values, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(chars(template), each), "")


# ---- kinds


def card(x: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.substring(d, F.lit(1), F.length(d) - 1)
        whole = let(permuted_string(body, key, "card"), lambda p: F.concat(p, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
        return F.when((F.pmod(luhn_sum(d), F.lit(10)) == 0) & F.length(d).between(13, 19) & ~d.rlike("^0+$"), refilled(x, "0-9", whole)).otherwise(x)

    return let(only("0-9", x), new)


def iban(x: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        country, check, body = F.substring(s, 1, 2), F.substring(s, 3, 2), F.substring(s, F.lit(5), F.length(s))
        valid = (F.length(s).between(15, 34)) & (mod97(F.concat(body, country, check)) == 1)
        whole = let(permuted_string(body, key, "iban"), lambda b: F.concat(country, F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(valid, refilled(x, "A-Z0-9", whole)).otherwise(x)

    return let(only("A-Z0-9", x), new)


def ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    # areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    place = (area - 1 - (area > 666).cast("int")).cast("long") * 99 + group - 1

    def written(v: Column) -> Column:
        a = F.floor(v / F.lit(99 * 9999)).cast("int") + 1
        return let(a, lambda y: F.concat_ws("-", F.lpad((y + (y >= 666).cast("int")).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(v / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(v, F.lit(9999)) + 1).cast("string"), 4, "0")))

    return F.when(valid, let(permuted_number(place * 9999 + serial - 1, 898 * 99, 9999, key, "ssn"), written)).otherwise(x)


def ip(x: Column, key: str) -> Column:
    part = lambda i: F.split_part(x, F.lit("."), F.lit(i)).cast("long")
    number = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    written = lambda v: F.concat_ws(".", *(F.pmod(F.floor(v / F.lit(256**i)), F.lit(256)).cast("string") for i in (3, 2, 1, 0)))
    return let(permuted_number(number, 1 << 16, 1 << 16, key, "ip"), written)


def phone(x: Column, key: str) -> Column:
    # a country's prefix stays; the other digits are one number
    prefix = F.regexp_extract(x, r"^\+[0-9]{1,3}[ \-]?", 0)
    rest = F.substring(x, F.length(prefix) + 1, F.length(x))
    return F.concat(prefix, refilled(rest, "0-9", permuted_string(only("0-9", rest), key, "phone")))


def date(x: Column, key: str) -> Column:
    """Year first; else month first where that is a date, day first if not, and with dots day first."""
    d = only("0-9", x)
    year_first, dotted = x.rlike("^[0-9]{4}"), x.contains(".")
    iso = lambda y, m, n: F.concat_ws("-", F.substring(d, y, 4), F.substring(d, m, 2), F.substring(d, n, 2))
    day = lambda s: F.try_to_date(s, "yyyy-MM-dd")
    ymd, mdy, dmy = iso(1, 5, 7), iso(5, 1, 3), iso(5, 3, 1)
    order = F.when(year_first, F.when(day(ymd).isNotNull(), "ymd")).when(~dotted & day(mdy).isNotNull(), "mdy").when(day(dmy).isNotNull(), "dmy")

    def new(o: Column) -> Column:
        value = F.when(o == "ymd", day(ymd)).when(o == "mdy", day(mdy)).otherwise(day(dmy))
        number = F.datediff(value, F.to_date(F.lit(FIRST_DAY)))
        inside = o.isNotNull() & number.between(0, DAY_A * DAY_B - 1)

        def written(n: Column) -> Column:
            moved = F.date_add(F.to_date(F.lit(FIRST_DAY)), n.cast("int"))
            return refilled(x, "0-9", F.when(o == "ymd", F.date_format(moved, "yyyyMMdd")).when(o == "mdy", F.date_format(moved, "MMddyyyy")).otherwise(F.date_format(moved, "ddMMyyyy")))

        return F.when(inside, let(permuted_number(number.cast("long"), DAY_A, DAY_B, key, "date"), written)).otherwise(x)

    return let(order, new)


def email(x: Column, key: str) -> Column:
    """All of it is permuted but the last label, so that it still looks like an address."""
    head = F.regexp_extract(x, r"^(.*)\.[^.]*$", 1)
    return F.concat(permuted_string(head, key, "email"), F.substring(x, F.length(head) + 1, F.length(x)))


def secret(x: Column, key: str) -> Column:
    head = F.regexp_extract(x, r"^[^\"']*[\"']", 0)
    value = F.substring(x, F.length(head) + 1, F.length(x) - F.length(head) - 1)
    return F.concat(head, permuted_string(value, key, "secret"), F.substring(x, F.length(x), F.lit(1)))


KINDS: dict[str, Callable[[Column, str], Column]] = {"email": email, "secret": secret, "iban": iban, "date": date, "ssn": ssn, "ip": ip, "phone": phone, "card": card}


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one match: of the first kind whose pattern it is."""
    out = x
    for kind in reversed(KINDS):
        out = F.when(x.rlike(f"^(?:{PATTERNS[kind]})$"), KINDS[kind](x, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced and n_found, n_replaced: how many values were found, and how many passed validation.

    A null text stays null, with zero values; an empty one stays empty; a text's length has
    no bound. All other columns, n_chars too, and repeated rows and rows without an id are
    kept as they are, whatever their names; a column n_found or n_replaced is replaced. Equal
    values get equal pseudonyms in all rows. An empty table gives no rows. The key is the
    secret: who has it can undo the pseudonyms, so it mustn't be empty.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    names = [c for c in docs.columns if c not in ("n_found", "n_replaced")]
    row, found, new = "row", "found", "new"  # beside each other only: the others are inside row
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias(row))
    text = F.col(row)["text"]
    # most texts hold nothing: one pass tells
    some = F.coalesce(text.rlike("[0-9@=:]"), F.lit(False))
    rows = rows.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(new, F.transform(found, lambda x: pseudonym(x, key)))
    gaps = F.split(text, ANY, -1)
    joined = let(gaps, lambda g: F.array_join(F.transform(g, lambda s, j: F.concat(s, F.coalesce(F.get(new, j), F.lit("")))), ""))
    replaced = F.size(F.filter(F.arrays_zip(found, new), lambda z: z[found] != z[new]))
    out = F.when(F.size(found) > 0, joined).otherwise(text)
    return rows.select(*(out.alias(c) if c == "text" else F.col(row)[c].alias(c) for c in names), F.size(found).cast("long").alias("n_found"), replaced.cast("long").alias("n_replaced"))


#: The session's setting that holds the key.
KEY_SETTING = "spark.corvane.pseudonymKey"
#: For the query over made-up documents where the setting is unset; real documents need a key of their own.
DEMO_KEY = "demonstration key"


def op1(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_found and n_replaced of each row; nulls, empty and long texts, repeats and empty tables as in pseudonymised()."""
    return pseudonymised(docs, key).select("doc_id", "text", "n_found", "n_replaced")
