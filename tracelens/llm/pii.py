"""Format-preserving pseudonyms for personal data, in built-in functions only.

Candidates are cut out of the text by one pattern, validated (Luhn sum, check digits, calendar, octets, number ranges),
permuted within their own format by a keyed Feistel network, and put back. Equal values get equal pseudonyms in every
document, no two values share one, and who holds the key can turn numbers and dates back. What fails validation stays.

Formats: e-mail, in Latin letters or others; IPv4, IPv6 in full or with `::` anywhere; IBAN; dates as 1999-12-31, 31/12/1999,
31.12.1999 and, if the first two can't be day and month, 12/31/1999; social security numbers with hyphens or blanks; phones
as +1 (555) 123-4567 or (555) 123-4567, 555-123-4567, 555.123.4567, 555 123-4567, 555 123 4567, 1-800-555-1234, 020 7946 0958;
cards of 13 to 19 digits in one, in fours, or as 4-6-4 and 4-6-5. Not read: ten digits in one, as most of these aren't
phones; of an address that more than 64 letters precede without a blank the last 64 characters count as its first part.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import spare_names

#: The session setting that holds the key of the registered query.
KEY_SETTING = "spark.tracelens.pseudonym.key"

ROUNDS = 10
#: What stands before the @: up to 64 characters of Latin script, or of others, so that words of another script before an address aren't taken in.
_LATIN = r"[\p{IsLatin}0-9][\p{IsLatin}0-9._%+-]{0,63}"
_OTHER = r"[\p{L}\p{N}&&[^\p{IsLatin}]][\p{L}\p{N}._%+\-&&[^\p{IsLatin}]]{0,63}"
#: One pattern per kind, tried in this order; a match is validated afterwards.
PATTERNS = {
    "email": rf"(?:{_LATIN}@|{_OTHER}@)(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,9}}(?:[A-Za-z]{{2,63}}|[\p{{L}}&&[^\p{{IsLatin}}]]{{2,63}})",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?:[A-Z0-9]{1,3}| (?=[A-Z]*\d)[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w]|-\d)|(?<![\w/])\d{2}/\d{2}/\d{4}(?![\w/])|(?<![\w.])\d{2}\.\d{2}\.\d{4}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)|(?<![\w-])(?<!\d )\d{3} \d{2} \d{4}(?![\w]|-\d| \d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\w.-])(?:\([2-9]\d{2}\) ?\d{3}[ .-]|[2-9]\d{2}-\d{3}-|[2-9]\d{2}\.\d{3}\.|[2-9]\d{2} \d{3}-)\d{4}(?![\w]|[.-]\d)|(?<![\w.-])(?<!\d )(?:[2-9]\d{2} \d{3} \d{4}|1[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\w]|[ .-]\d)",
    "card": r"(?<![\w.-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\w])",
}
#: Of the 400 years after which the calendar repeats, the days after the twelfth of a month, with two factors, and the others.
LATE_DAYS, LATE_A, LATE_B = 88497, 9, 9833
EARLY_DAYS, EARLY_A, EARLY_B = 57600, 240, 240


def _digest(key: str, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string")), 256)


def _prf(key: str, kind: str, step: Column, half: Column) -> Column:
    """60 bits of a keyed hash, as a long."""
    return F.conv(F.substring(_digest(key, kind, step, half), 1, 15), 16, 10).cast("long")


def _rounds(halves: Column, left, right, back: bool) -> Column:
    """`halves` (l, r) after ROUNDS rounds, in which l becomes left(l, r, round) and r becomes right(l, r, round) in turn."""

    def step(acc: Column, i: Column) -> Column:
        even, l, r = i % 2 == 0, acc["l"], acc["r"]
        return F.struct(F.when(even, left(l, r, i)).otherwise(l).alias("l"), F.when(even, r).otherwise(right(l, r, i)).alias("r"))

    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, halves, step)


def feistel_halves(halves: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """Permutes pairs (l, r), l below a and r below b: each is shifted in turn by a keyed hash of the other."""
    sign = -1 if back else 1
    left = lambda l, r, i: F.pmod(l + sign * F.pmod(_prf(key, kind, i, r), a), a)
    right = lambda l, r, i: F.pmod(r + sign * F.pmod(_prf(key, kind, i, l), b), b)
    return _rounds(halves, left, right, back)


def feistel(x: Column, a: Column, b: Column, key: str, kind: str, back: bool = False) -> Column:
    """Permutes 0 <= x < a*b."""
    halves = F.struct(floor_div(x, b).alias("l"), F.pmod(x, b).alias("r"))
    return _let(feistel_halves(halves, a, b, key, kind, back), lambda h: h["l"] * b + h["r"])


def floor_div(x: Column, b: Column) -> Column:
    """x / b of longs without a remainder, so exact beyond 2 ** 53."""
    return F.call_function("div", x, b.cast("long"))


def _let(value: Column, use) -> Column:
    """Evaluates `value` once and hands it on."""
    return F.element_at(F.transform(F.array(value), use), 1)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def permute_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A digit string of 2 to 34 digits, to another of the same length."""
    low = F.floor(F.length(digits) / 2).cast("int")
    high = F.length(digits) - low
    size = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    halves = F.struct(F.substr(digits, F.lit(1), high).cast("long").alias("l"), F.substr(digits, high + 1, low).cast("long").alias("r"))
    moved = feistel_halves(halves, size(high), size(low), key, kind, back)
    return _let(moved, lambda h: F.concat(F.lpad(h["l"].cast("string"), high, "0"), F.lpad(h["r"].cast("string"), low, "0")))


def permute_hex(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A string of 1 to 32 hex digits, to another of the same length, in lower case; halves are mixed by exclusive or."""
    low = F.floor(F.length(digits) / 2).cast("int")
    high = F.length(digits) - low
    whole = lambda s: F.coalesce(F.conv(s, 16, -10).cast("long"), F.lit(0).cast("long"))
    mask = lambda n: F.when(n == 16, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), 4 * n) - 1)
    bits = lambda half, i, n: whole(F.substring(_digest(key, kind, i, half), 1, 16)).bitwiseAND(mask(n))
    halves = F.struct(whole(F.substr(digits, F.lit(1), high)).alias("l"), whole(F.substr(digits, high + 1, low)).alias("r"))
    moved = _rounds(halves, lambda l, r, i: l.bitwiseXOR(bits(r, i, high)), lambda l, r, i: r.bitwiseXOR(bits(l, i, low)), back)
    return _let(moved, lambda h: F.lower(F.concat(F.lpad(F.hex(h["l"]), high, "0"), F.lpad(F.hex(h["r"]), low, "0"))))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum; the last digit counts once, the one before twice, and so on."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, d: s + d)


def lay_digits(shape: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """`shape` with its digits, or characters of another kind, in order, replaced by `digits`."""
    marks = F.split(F.regexp_replace(shape, kind, "0"), "")
    laid = F.aggregate(
        marks,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c == "0", F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + (c == "0").cast("int")).alias("at"),
        ),
        lambda acc: acc["out"],
    )
    return laid


def pseudonym_card(m: Column, key: str, back: bool = False) -> Column:
    """Keeps the first digit, permutes the rest and computes the check digit anew; null unless the Luhn sum holds."""

    def made(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card", back))
        return _let(body, lambda p: F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    valid = lambda d: F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & (F.regexp_count(d, F.lit("0")) < F.length(d))
    return _let(digits_of(m), lambda d: F.when(valid(d), lay_digits(m, made(d))))


def pseudonym_phone(m: Column, key: str, back: bool = False) -> Column:
    """Keeps the country code, or the first digit if there is none; null unless it has 8 to 15 digits in all, ten without a code."""
    code = F.regexp_extract(m, r"^\+\d{1,3}", 0)
    code = F.when(m.rlike(r"^\+\d{1,3}[^0-9]"), code).when(m.startswith("+"), F.substring(m, 1, 2)).otherwise(F.regexp_extract(m, r"^\(?\d", 0))
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    moved = lambda d: lay_digits(rest, permute_digits(d, key, "phone", back))
    return F.when(F.length(digits_of(m)).between(8, 15), F.concat(code, _let(digits_of(rest), moved)))


def pseudonym_ip(m: Column, key: str, back: bool = False) -> Column:
    """A permutation of all 2 ** 32 addresses; null unless each part is at most 255."""
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    whole = lambda p: F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s * 256 + x)
    show = lambda v: F.array_join(F.transform(F.array(*[F.lit(s) for s in (24, 16, 8, 0)]), lambda s: F.call_function("shiftright", v, s).bitwiseAND(255).cast("string")), ".")  # noqa: E501,E731
    side = F.lit(1 << 16).cast("long")
    return _let(parts, lambda p: F.when(F.array_max(p) <= 255, _let(feistel(whole(p), side, side, key, "ip", back), show)))


def pseudonym_ipv6(m: Column, key: str, back: bool = False) -> Column:
    """Permutes the digits that are written, in lower case; null for under five letters without a figure, or more than eight groups."""
    valid = (F.length(F.regexp_replace(m, ":", "")) >= 5) | m.rlike("[0-9]")
    groups = F.size(F.filter(F.split(m, ":"), lambda g: g != ""))
    moved = lambda d: lay_digits(m, permute_hex(d, key, "ipv6", back), "[0-9A-Fa-f]")
    return F.when(valid & (groups <= 8), _let(F.lower(F.regexp_replace(m, ":", "")), moved))


def mod_97(text: Column) -> Column:
    """The remainder of digits and capital letters, letters as two digits from 10 on, by 97."""
    value = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: value(s, c).cast("int"))


def pseudonym_iban(m: Column, key: str, back: bool = False) -> Column:
    """Keeps country and letters, permutes the digits after the check digits and computes these anew; null unless they are right."""
    checked = lambda land, account: F.lpad((98 - mod_97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")

    def made(c: Column) -> Column:
        land, account = F.substring(c, 1, 2), F.substr(c, F.lit(5), F.length(c))
        moved = lay_digits(account, permute_digits(digits_of(account), key, "iban", back))
        return _let(moved, lambda a: lay_digits(m, F.concat(land, checked(land, a), a), "[A-Z0-9]"))

    def valid(c: Column) -> Column:
        land, account = F.substring(c, 1, 2), F.substr(c, F.lit(5), F.length(c))
        return F.length(c).between(15, 34) & (F.length(digits_of(account)) >= 4) & (checked(land, account) == F.substring(c, 3, 2))

    return _let(F.regexp_replace(m, " ", ""), lambda c: F.when(valid(c), made(c)))


def pseudonym_ssn(m: Column, key: str, back: bool = False) -> Column:
    """A permutation of the valid numbers: area 001-899 without 666, group 01-99, serial 0001-9999; null for others."""
    area, group, serial = (F.split(m, "[- ]")[i].cast("long") for i in range(3))
    place = F.when(area < 666, area - 1).otherwise(area - 2) * 99 + group - 1
    x = place * 9999 + serial - 1
    valid = area.between(1, 899) & (area != 666) & (group >= 1) & (serial >= 1)

    def show(v: Column) -> Column:
        rest = floor_div(v, F.lit(9999))
        no = floor_div(rest, F.lit(99))
        no = F.when(no < 665, no + 1).otherwise(no + 2)
        pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
        mark = F.substring(m, 4, 1)
        return F.concat(pad(no, 3), mark, pad(F.pmod(rest, F.lit(99)) + 1, 2), mark, pad(F.pmod(v, F.lit(9999)) + 1, 4))

    return F.when(valid, _let(feistel(x, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn", back), show))


def pseudonym_date(m: Column, key: str, back: bool = False) -> Column:
    """A permutation of the days of the value's own 400-year cycle, the same however a day is written; null unless the calendar has the day.

    Days after the twelfth of a month are permuted among each other, as are the others: so a date that can only be read
    month first becomes one that can only be read so.
    """
    start = F.lit("1600-01-01").cast("date")
    slashed = m.rlike("^../../")
    ways = {"yyyy-MM-dd": m.rlike("^.{4}-"), "dd/MM/yyyy": slashed, "dd.MM.yyyy": F.substring(m, 3, 1) == ".", "MM/dd/yyyy": slashed}
    day_as = lambda f: F.try_to_date(m, f)
    read = F.coalesce(*[F.when(has & day_as(f).isNotNull(), F.struct(day_as(f).alias("day"), F.lit(f).alias("f"))) for f, has in ways.items()])

    def moved(x: Column, days: int, a: int, b: int, kind: str) -> Column:
        low = F.pmod(x, F.lit(days))
        return x - low + feistel(low.cast("long"), F.lit(a).cast("long"), F.lit(b).cast("long"), key, kind, back)

    def of_late(x: Column) -> Column:
        """The day of a place among late days: its month is found by the average, give or take two."""
        first = lambda month: F.datediff(F.add_months(start, month), start) - 12 * month
        near = F.floor(x * 4800 / LATE_DAYS).cast("int")
        month = F.array_max(F.filter(F.transform(F.array(*[F.lit(d) for d in range(-2, 3)]), lambda d: near + d), lambda k: first(k) <= x))
        return _let(month, lambda k: F.date_add(F.add_months(start, k), (12 + x - first(k)).cast("int")))

    def of_early(x: Column) -> Column:
        return F.date_add(F.add_months(start, F.floor(x / 12).cast("int")), F.pmod(x, F.lit(12)).cast("int"))

    def new_day(day: Column) -> Column:
        months = (F.year(day) - 1600) * 12 + F.month(day) - 1
        late = _let((F.datediff(day, start) - 12 * (months + 1)).cast("long"), lambda x: _let(moved(x, LATE_DAYS, LATE_A, LATE_B, "late"), of_late))
        early = _let((12 * months + F.dayofmonth(day) - 1).cast("long"), lambda x: _let(moved(x, EARLY_DAYS, EARLY_A, EARLY_B, "early"), of_early))
        return F.when(F.dayofmonth(day) > 12, late).otherwise(early)

    def shown(x: Column) -> Column:
        day = new_day(x["day"])
        return F.when(F.year(x["day"]) >= 1, F.coalesce(*[F.when(x["f"] == f, F.date_format(day, f)) for f in ways]))

    return _let(read, lambda x: F.when(x["day"].isNotNull(), shown(x)))


def pseudonym_email(m: Column, key: str) -> Column:
    """The part before the @ becomes a keyed hash in letters, of the same length up to 32; the domain stays. Not to be turned back."""
    local = F.lower(F.regexp_extract(m, "^([^@]+)@", 1))
    token = F.translate(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), local, F.lower(F.regexp_extract(m, "@(.*)$", 1))), 256), "0123456789", "ghijklmnop")
    return F.concat(F.substr(token, F.lit(1), F.least(F.greatest(F.length(local), F.lit(6)), F.lit(32))), F.regexp_extract(m, "@.*$", 0))


def _kind(m: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = m.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _pseudonym(m: Column, kind: Column, key: str, back: bool) -> Column:
    ways = {"ip": pseudonym_ip, "ipv6": pseudonym_ipv6, "iban": pseudonym_iban, "date": pseudonym_date, "ssn": pseudonym_ssn, "phone": pseudonym_phone, "card": pseudonym_card}
    out = F.when(kind == "email", F.lit(None) if back else pseudonym_email(m, key))
    for name, way in ways.items():
        out = out.when(kind == name, way(m, key, back))
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text", back: bool = False) -> DataFrame:
    """Adds `found`, an array of (kind, value, pseudonym; null if it failed validation), and `clean`, the text with pseudonyms.

    With `back`, numbers and dates are turned back. Null text stays null and has nothing found. Very long texts are
    searched whole, in time linear in their length. Rows are treated one by one in their own task: nothing is shuffled,
    however common a value is. Columns `found` and `clean` of the caller's are replaced; all others stay.
    """
    every = "|".join(f"(?:{p})" for p in PATTERNS.values())
    some = F.col(text).rlike("[0-9@]|::")
    values, kinds = spare_names(docs, "values", "kinds")
    one = docs.withColumn(values, F.when(some, F.regexp_extract_all(text, F.lit(every), F.lit(0))))
    two = one.withColumn(kinds, F.transform(values, lambda m: F.struct(m.alias("value"), _kind(m).alias("kind"))))
    found = F.transform(kinds, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), _pseudonym(x["value"], x["kind"], key, back).alias("pseudonym")))
    found = F.coalesce(F.when(F.size(kinds) > 0, found), F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>"))
    whole, all_ = spare_names(docs, "whole", "all")
    three = two.withColumn(whole, F.col(text)).withColumn(all_, found)
    pieces = F.split(whole, every, -1)
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(all_, i)["pseudonym"], F.get(all_, i)["value"], F.lit("")))), "")
    clean = F.when(F.exists(all_, lambda x: x["pseudonym"].isNotNull()), joined).otherwise(F.col(whole))
    return three.withColumns({"found": F.col(all_), "clean": clean}).drop(values, kinds, whole, all_)


def session_key(spark: SparkSession) -> str:
    """The key that the session's settings name; where none is set, a random one that holds as long as the session."""
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING)


def pseudonymise_documents(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, n_found, kinds, changed, text of every document.

    n_found: values that were validated and replaced; kinds: their kinds, distinct, sorted, comma-joined. Null text:
    nothing found, null text. Repeated rows, ties and null ids are treated one by one; an empty table gives no rows; other
    columns are not read.
    """
    rows = pseudonymise(docs.select("doc_id", "text"), key)
    valid = rows.withColumn("hits", F.filter("found", lambda x: x["pseudonym"].isNotNull()))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["kind"]))), ",")
    return valid.select("doc_id", F.size("hits").cast("long").alias("n_found"), kinds.alias("kinds"), (F.size("hits") > 0).alias("changed"), F.col("clean").alias("text"))
