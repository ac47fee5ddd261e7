r"""Format-preserving pseudonyms for personal data, with DataFrame operations only.

One regular expression finds candidates. Each is validated (issuer ranges, lengths and Luhn sum of cards, octet and calendar ranges, number ranges) and then
permuted within its own format by a keyed Feistel network over Z_a x Z_b, so that equal values get equal pseudonyms in every
document, different values different ones, and separators stay. Candidates that fail validation stay as they are.

    card    digits after the issuer's four, new check digit     phone  999 x 9990000 over area, exchange and line
    ipv4    2^16 x 2^16                                         ssn    88902 x 9999 over all valid numbers
    date    400 years from 1800, by the day of the month: 4800  email  keyed hashes of the local part and of the domain
            x 12 (1 to 12), 4800 x 16 (13 to 28), 21 x 557 (29 on)

Dates are permuted among days of the same of the three kinds, in every format, so the order of a date with slashes can be written as it was read: equal
dates stay linked across formats, and what is read as day/month (a first number above 12) is read so again.
A phone number is valid if neither its area code nor its exchange is 000: number plans differ too much between countries for more.
Of an email's domain at most LABELS labels of LABEL characters, as the DNS has them, and the last label after them belong to the match.

Defined results: a null text stays null with zero counts; empty texts, repeated rows and null ids pass through; texts may have any
length and any runs of candidates (one left-to-right scan, in which every repetition of a group is bounded, so that the matcher's
stack is too); extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
DAY_ZERO, DAYS = "1800-01-01", 146_097

#: Fixed values of the DNS: characters of a label, and labels of a name of 253 characters before its last.
LABEL, LABELS = 63, 126

EMAIL = rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@(?:[A-Za-z0-9-]{{1,{LABEL}}}\.){{1,{LABELS}}}[A-Za-z]{{2,{LABEL}}}"
IPV4 = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![./-]?\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!-?\d)"
PHONE = r"(?:(?<![\d+])\+\d{1,3}[ .-]?|(?<![\d+]|\d[.-]))(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"
CARD = r"(?<![\d])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, DATE, SSN, PHONE, CARD))
KINDS = ("email", "ipv4", "date", "ssn", "phone", "card")


def prf(key: str, tweak: str | Column, i: Column, half: Column) -> Column:
    """48 bits of a keyed hash of a round and a half."""
    said = F.concat_ws("|", F.lit(key), F.lit(tweak) if isinstance(tweak, str) else tweak, i.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 12), 16, 10).cast("bigint")


def feistel(key: str, tweak: str | Column, left: Column, right: Column, a: Column, b: Column, decrypt: bool = False) -> Column:
    """A keyed permutation of Z_a x Z_b, as a struct (l, r).

    Each round adds the keyed hash of one half to the other, modulo its size, and swaps; decrypt runs the rounds backwards.
    """
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    size = lambda i: F.when(i % 2 == 0, a).otherwise(b).cast("bigint")
    if decrypt:
        step = lambda s, i: F.struct(F.pmod(s["r"] - prf(key, tweak, i, s["l"]), size(i)).alias("l"), s["l"].alias("r"))
        return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), start, step)
    step = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + prf(key, tweak, i, s["r"]), size(i)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def pow10(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def padded(number: Column, width: Column) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def permuted_digits(key: str, tweak: str | Column, digits: Column, decrypt: bool) -> Column:
    """A permutation of all digit strings of this length (2 to 18)."""
    n = F.length(digits)
    u = F.call_function("div", n, F.lit(2)).cast("int")
    out = feistel(key, tweak, digits.substr(F.lit(1), u), digits.substr(u + 1, n - u), pow10(u), pow10(n - u), decrypt)
    join = lambda s: F.concat(padded(s["l"], u), padded(s["r"], n - u))
    return F.element_at(F.transform(F.array(out), join), 1)


def check_digit(payload: Column) -> Column:
    """The Luhn digit that completes payload."""
    n = F.length(payload)

    def add(total: Column, i: Column) -> Column:
        d = payload.substr(n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.pmod(-total, F.lit(10)).cast("string")


def refilled(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order; all else stays."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(s["o"], F.when(is_digit, digits.substr(s["k"], F.lit(1))).otherwise(c)).alias("o"), (s["k"] + F.when(is_digit, 1).otherwise(0)).alias("k")
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("o"), F.lit(1).alias("k")), step, lambda s: s["o"])


#: Prefixes and lengths that card issuers use.
ISSUERS = (
    r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2(?:22[1-9]|2[3-9]\d|[3-6]\d\d|7[01]\d|720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|35(?:2[89]|[3-8]\d)\d{12}"
    r"|6(?:011|4[4-9]\d|5\d\d)\d{12}|62\d{14,17})$"
)


def card(key: str, m: Column, decrypt: bool) -> Column:
    """The issuer's first four digits stay, as part of the format; those up to the check digit are permuted."""
    d = digits_of(m)
    issuer, rest = d.substr(F.lit(1), F.lit(4)), d.substr(F.lit(5), F.length(d) - 5)
    payload = F.concat(issuer, permuted_digits(key, F.concat(F.lit("card|"), issuer), rest, decrypt))
    return F.element_at(F.transform(F.array(payload), lambda p: refilled(m, F.concat(p, check_digit(p)))), 1)


def card_valid(m: Column) -> Column:
    d = digits_of(m)
    return d.rlike(ISSUERS) & (check_digit(d.substr(F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)))


def octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda o: o.cast("int"))


def ipv4(key: str, m: Column, decrypt: bool) -> Column:
    o = octets(m)
    out = feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), decrypt)
    show = lambda s: F.concat_ws(".", *[F.pmod(F.shiftright(s[h], by), F.lit(256)).cast("string") for h in "lr" for by in (8, 0)])
    return F.element_at(F.transform(F.array(out), show), 1)


def ipv4_valid(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda o: (o.cast("int") <= 255) & ((o == "0") | ~o.startswith("0")))


def phone_digits(m: Column) -> list[Column]:
    """Country, area code, exchange and line."""
    d = digits_of(m)
    n = F.length(d)
    return [d.substr(F.lit(1), n - 10), d.substr(n - 9, F.lit(3)), d.substr(n - 6, F.lit(3)), d.substr(n - 3, F.lit(4))]


def phone_valid(m: Column) -> Column:
    _, area, exchange, _ = phone_digits(m)
    return (area != "000") & (exchange != "000")


def phone(key: str, m: Column, decrypt: bool) -> Column:
    """The country stays; area code, exchange and line are permuted over all valid numbers."""
    country, area, exchange, line = phone_digits(m)
    out = feistel(key, "phone", area.cast("int") - 1, (exchange.cast("int") - 1) * 10_000 + line.cast("int"), F.lit(999), F.lit(9_990_000), decrypt)
    show = lambda s: refilled(m, F.concat(country, padded(s["l"] + 1, F.lit(3)), padded(s["r"] + 10_000, F.lit(7))))
    return F.element_at(F.transform(F.array(out), show), 1)


def ssn_parts(m: Column) -> list[Column]:
    return [m.substr(F.lit(s), F.lit(n)).cast("int") for s, n in ((1, 3), (5, 2), (8, 4))]


def ssn_valid(m: Column) -> Column:
    a, g, s = ssn_parts(m)
    return a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)


def ssn(key: str, m: Column, decrypt: bool) -> Column:
    a, g, s = ssn_parts(m)
    out = feistel(key, "ssn", (a - 1 - F.when(a > 666, 1).otherwise(0)) * 99 + g - 1, s - 1, F.lit(898 * 99), F.lit(9999), decrypt)

    def show(x: Column) -> Column:
        area = F.call_function("div", x["l"], F.lit(99)) + 1
        return F.concat_ws("-", padded(area + F.when(area >= 666, 1).otherwise(0), F.lit(3)), padded(F.pmod(x["l"], F.lit(99)) + 1, F.lit(2)), padded(x["r"] + 1, F.lit(4)))

    return F.element_at(F.transform(F.array(out), show), 1)


def date_format(m: Column) -> Column:
    """ISO, day.month.year, and month/day/year unless the first number is above 12: then day/month/year."""
    return F.when(m.rlike("^[0-9]{4}-"), F.lit("yyyy-MM-dd")).when(m.contains("."), F.lit("dd.MM.yyyy")).when(m.substr(F.lit(1), F.lit(2)).cast("int") > 12, F.lit("dd/MM/yyyy")).otherwise(F.lit("MM/dd/yyyy"))


def date_iso(m: Column) -> Column:
    f, at = date_format(m), lambda s, n: m.substr(F.lit(s), F.lit(n))
    day = F.when(f == "yyyy-MM-dd", m).when(f == "MM/dd/yyyy", F.concat_ws("-", at(7, 4), at(1, 2), at(4, 2))).otherwise(F.concat_ws("-", at(7, 4), at(4, 2), at(1, 2)))
    return day.try_cast("date")


def day_number(m: Column) -> Column:
    return F.datediff(date_iso(m), F.lit(DAY_ZERO).cast("date"))


def date_valid(m: Column) -> Column:
    return F.coalesce(day_number(m).between(0, DAYS - 1), F.lit(False))


def month_start(month: Column) -> Column:
    return F.add_months(F.lit(DAY_ZERO).cast("date"), month.cast("int"))


def late_before(month: Column) -> Column:
    """Days from the 29th on in the months before this one."""
    return F.datediff(month_start(month), F.lit(DAY_ZERO).cast("date")) - 28 * month


def date(key: str, m: Column, decrypt: bool) -> Column:
    iso = date_iso(m)
    month, day = (F.year(iso) - 1800) * 12 + F.month(iso) - 1, F.dayofmonth(iso)
    kind = F.when(day <= 12, F.lit("early")).when(day <= 28, F.lit("middle")).otherwise(F.lit("late"))
    late = late_before(month) + day - 29
    by_kind = lambda k, early, middle, rest: F.when(k == "early", early).when(k == "middle", middle).otherwise(rest)
    left = by_kind(kind, month, month, F.call_function("div", late, F.lit(557)))
    right = by_kind(kind, day - 1, day - 13, F.pmod(late, F.lit(557)))
    sizes = by_kind(kind, F.lit(4800), F.lit(4800), F.lit(21)), by_kind(kind, F.lit(12), F.lit(16), F.lit(557))
    out = feistel(key, F.concat(F.lit("date|"), kind), left, right, *sizes, decrypt)

    def new_date(s: Column) -> Column:
        index = s["l"] * 557 + s["r"]
        near = F.floor(index * 4800 / 11_697)  # late days are nearly even over the months
        at = F.array_max(F.filter(F.sequence(F.greatest(near - 6, F.lit(0)), F.least(near + 6, F.lit(4799))), lambda x: late_before(x) <= index))
        return by_kind(
            kind, F.date_add(month_start(s["l"]), s["r"].cast("int")), F.date_add(month_start(s["l"]), (s["r"] + 12).cast("int")),
            F.date_add(month_start(at), (index - late_before(at) + 28).cast("int")),
        )

    def show(d: Column) -> Column:
        f = date_format(m)
        y, mo, day = (F.date_format(d, p) for p in ("yyyy", "MM", "dd"))
        return F.when(f == "yyyy-MM-dd", F.concat_ws("-", y, mo, day)).when(f == "dd.MM.yyyy", F.concat_ws(".", day, mo, y)).when(f == "dd/MM/yyyy", F.concat_ws("/", day, mo, y)).otherwise(F.concat_ws("/", mo, day, y))

    return F.element_at(F.transform(F.transform(F.array(out), new_date), show), 1)


def email(key: str, m: Column, decrypt: bool) -> Column:
    at = F.lower(m)
    part = lambda what, i, n: F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), F.split_part(at, F.lit("@"), F.lit(i))), 256), 1, n)
    return F.concat(F.lit("u"), part("local", 1, 16), F.lit("@d"), part("domain", 2, 10), F.lit(".example"))


def pseudonym(key: str, m: Column, decrypt: bool) -> Column:
    """(kind, text) of a match; a null kind where validation fails."""
    whole = lambda p: m.rlike(rf"\A(?:{p})\z")
    got = lambda kind, f: F.struct(F.lit(kind).alias("kind"), f(key, m, decrypt).alias("text"))
    same = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("text"))
    return (
        F.when(m.contains("@"), got("email", email))
        .when(whole(r"\d+\.\d+\.\d+\.\d+"), F.when(ipv4_valid(m), got("ipv4", ipv4)).otherwise(same))
        .when(whole(r"\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4}"), F.when(date_valid(m), got("date", date)).otherwise(same))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.when(ssn_valid(m), got("ssn", ssn)).otherwise(same))
        .when(whole(r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"), F.when(phone_valid(m), got("phone", phone)).otherwise(same))
        .otherwise(F.when(card_valid(m), got("card", card)).otherwise(same))
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", decrypt: bool = False, info_col: str = "pii") -> DataFrame:
    """docs with pseudonyms in the text, and a struct `info_col` with the number of each kind, in place of a column of that name.

    decrypt=True turns pseudonyms of numbers and dates back with the same key (an email's is one-way).
    """
    text = F.col("row")[text_col]
    rows = docs.select(F.struct("*").alias("row"))
    maybe = F.coalesce(text.rlike("[0-9]|@"), F.lit(False))
    split = rows.select(
        "row",
        F.when(maybe, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("found"),
    ).select(
        "row",
        F.when(F.size("found") > 0, F.transform("found", lambda m: pseudonym(key, m, decrypt))).alias("new"),
        F.when(F.size("found") > 0, F.split(text, ANY, -1)).alias("gaps"),
    )
    rest = F.slice("gaps", 2, F.size("gaps"))
    joined = F.concat(F.col("gaps")[0], F.array_join(F.zip_with("new", rest, lambda m, g: F.concat(m["text"], g)), ""))
    count = lambda kind: F.coalesce(F.size(F.filter("new", lambda m: m["kind"] == kind)), F.lit(0)).cast("long")
    return split.select(
        *[F.coalesce(joined, text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c != info_col],
        F.struct(*[F.when(F.col("new").isNull(), F.lit(0).cast("long")).otherwise(count(k)).alias(k) for k in KINDS]).alias(info_col),
    )
