"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values are found by one pattern, validated (check digits, calendar, octets), and permuted within their
format by a keyed Feistel network: a card number becomes another one with a right check digit, a date
another date, an address another address. Equal values become equal pseudonyms in every document, so
links survive, and different values stay different. What fails its validation stays as it is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselwatch.llm.common import free_names

ROUNDS = 6
#: Alphabets: a character moves within its own only; others are part of the format.
ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "áàâäãåæçéèêëíìîïñóòôöõøœúùûüýÿß", "ÁÀÂÄÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜÝ",
]
#: Days that dates are permuted in: 1800-01-01 to 2199-12-31, 146097 = 189 * 773.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
#: Those of them after the 12th of a month: 88497 = 9 * 9833.
LATE_DAYS = (9, 9833)

#: Possessive classes without a repeated group: what they take is never given back, whatever its length. Labels are validated apart.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9.-]*+"
#: From where on a domain isn't one: two separators side by side, or one at the end.
_NO_DOMAIN = r"(?:\.[.-]|-\.|[.-]$).*$"
#: Between the digits of a phone number: one separator, with a parenthesis or not.
_SEP = r"(?:[ \xA0./-]|[ \xA0./-]?\(|\)[ \xA0./-]?)?"
#: Numbers without a country code: North American ones (3-3-4), and those with a trunk 0 in their usual groups.
_AMERICAN = r"(?:1[ .-])?(?:\([2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]?\d{4}|[2-9]\d{2}(?:-[2-9]\d{2}-|\.[2-9]\d{2}\.| [2-9]\d{2}[ -])\d{4})"
_TRUNK = r"(?:0[1-9](?:[ .-]\d{2}){4}|\(0\d{2,4}\)[ /-]?\d{3,4}[ -]?\d{3,5}|0[1-9]\d{1,3}[ /-]\d{3,4}[ -]?\d{3,5})"
#: E.164: 7 to 15 digits after the plus; a single digit after a separator isn't the end of a number.
PHONE = (
    rf"(?<![\d+])\+(?:1(?:{_SEP}\d){{10}}(?!\d)|[1-9](?:{_SEP}\d){{6,14}}(?<![ \xA0./-]\d)(?!\d))"
    rf"|(?<![\p{{L}}\d+(.,/-])(?:{_AMERICAN}|{_TRUNK})(?![\d-]|[.,/]\d)"
)
#: Digits of a country code.
_COUNTRY_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: Lengths of IBANs: they say where one in printed groups ends.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_GROUPED = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?:[ \xA0-]?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
IBAN = rf"(?<![A-Za-z0-9])(?:{_GROUPED}|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}})(?![A-Za-z0-9])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-]|\.\d)"
SECRET = r"(?<=[=:][ \t]{0,2}[\"']?)(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
#: Beginnings that access tokens of common services have.
_PREFIX = r"(?:A(?:KIA|SIA|GPA|IDA|ROA)|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|npm_)"
TOKEN = rf"(?<![A-Za-z0-9_-]){_PREFIX}[A-Za-z0-9_-]{{16,100}}(?![A-Za-z0-9_-])"
ANY = "|".join([EMAIL, PHONE, SECRET, TOKEN, IBAN, IP, SSN, DATE, CARD])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """Hex digest under the key: the round function's source."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), *(p.cast("string") for p in parts)), 256)


def _number(key: str, kind: str, round_no: Column, other: Column) -> Column:
    return F.conv(F.substring(_keyed(key, kind, round_no, other), 1, 12), 16, 10).cast("long")


def permute_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Struct (a, b): Feistel over the product of two ranges (0 to size - 1)."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, (s["a"] + _number(key, kind, r, s["b"])) % sizes[0]).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise((s["b"] + _number(key, kind, r, s["a"])) % sizes[1]).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


@cache
def _letter_runs(least: int = 8) -> tuple[tuple[tuple[int, int], ...], str]:
    """((first code point, length) of runs of letters and digits outside ``ALPHABETS``, all others as one alphabet).

    A run has one kind of letter (case); where these alternate, all kinds. Runs and alphabets have no
    character in common, so moving within them keeps different texts different.
    """
    taken = set("".join(ALPHABETS))
    others = [k for k in range(0x80, 0x110000) if unicodedata.category(chr(k))[0] in "LN" and chr(k) not in taken]
    runs, rest = [], others
    for kind in (lambda k: unicodedata.category(chr(k)), lambda k: ""):
        groups = [[k for _, k in g] for _, g in groupby(enumerate(rest), lambda e: (e[1] - e[0], kind(e[1])))]
        runs += [(g[0], len(g)) for g in groups if len(g) >= least]
        rest = [k for g in groups if len(g) < least for k in g]
    return tuple(sorted(runs)), "".join(map(chr, rest))


def _moved_letter(c: Column, shift: Column) -> Column:
    """A letter or digit outside ``ALPHABETS`` moved within its run of code points."""
    runs, rest = _letter_runs()
    every = F.split(F.lit(" ".join(f"{lo}:{n}" for lo, n in runs)), " ")
    point = F.ascii(c)
    low, size = (lambda r: F.substring_index(r, ":", 1).cast("int")), (lambda r: F.substring_index(r, ":", -1).cast("int"))
    run = F.filter(every, lambda r: (point >= low(r)) & (point < low(r) + size(r)))
    new = F.transform(run, lambda r: F.decode(F.unhex(F.lpad(F.hex(low(r) + (point - low(r) + shift) % size(r)), 8, "0")), "UTF-32"))
    at = F.instr(F.lit(rest), c) - 1
    return F.when(at >= 0, F.substring(F.lit(rest), (at + shift) % len(rest) + 1, F.lit(1))).otherwise(F.coalesce(F.array_join(F.when(F.size(new) > 0, new), ""), c))


def permute_text(text: Column, key: str, kind: str, alphabets: list[str] | None = None, all_letters: bool = False) -> Column:
    """Feistel over the characters of a text: each moves within its alphabet by a shift from the other half.

    ``all_letters``: letters and digits of no alphabet move too, within runs of their script.
    """
    chars = F.split(text, "")
    half = F.floor(F.size(chars) / 2).cast("int")
    start = F.struct(F.slice(chars, 1, half).alias("l"), F.slice(chars, half + 1, F.size(chars)).alias("r"))

    def moved(c: Column, shift: Column) -> Column:
        out = F.when(c.rlike(r"^[^\x00-\x7F]$"), _moved_letter(c, shift)).otherwise(c) if all_letters else c
        for alphabet in alphabets or ALPHABETS:
            at = F.instr(F.lit(alphabet), c) - 1
            out = F.when((at >= 0) & (c != ""), F.substring(F.lit(alphabet), (at + shift) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    def step(s: Column, r: Column) -> Column:
        def turn(stream: Column) -> Column:
            shift = lambda k: F.conv(F.substring(stream, k * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.struct(s["r"].alias("l"), F.transform(s["l"], lambda c, k: moved(c, shift(k))).alias("r"))

        # one digest of the other half a round, drawn out to four hex digits for each character
        blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(s["l"]) - 1) / 16)).cast("int"))
        drawn = lambda digest: F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat(digest, b.cast("string")), 256)), "")
        return _let(_let(_keyed(key, kind, r, F.array_join(s["r"], "")), drawn), turn)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return F.concat(F.array_join(done["l"], ""), F.array_join(done["r"], ""))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of Luhn values; every second digit is doubled, from the right, beginning with place ``doubled``."""

    def value(d: Column, k: Column) -> Column:
        twice = d.cast("int") * F.when(k % 2 == doubled, 2).otherwise(1)
        return twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), value), F.lit(0), lambda s, x: s + x)


def _refill(form: Column, digits: Column, kept: str = "0-9") -> Column:
    """``form`` with its digits (characters of the class ``kept``) replaced by ``digits``, in order."""
    at = lambda k: F.length(F.regexp_replace(F.substring(form, F.lit(1), k + 1), f"[^{kept}]", ""))
    return F.array_join(F.transform(F.split(form, ""), lambda c, k: F.when(c.rlike(f"[{kept}]"), F.substring(digits, at(k), F.lit(1))).otherwise(c)), "")


def _card(m: Column, key: str) -> Column:
    digits = _digits(m)
    n = F.length(digits)
    body = F.concat(F.substring(digits, 1, 1), permute_text(F.substring(digits, F.lit(2), n - 2), key, "card"))
    whole = F.concat(body, F.pmod(-_luhn_sum(body, 0), F.lit(10)).cast("string"))
    return F.when(_luhn_sum(digits, 1) % 10 == 0, _refill(m, whole)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    done = permute_pair(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], (65536, 65536), key, "ip")
    out = F.transform(F.array(done), lambda d: F.concat_ws(".", F.floor(d["a"] / 256), d["a"] % 256, F.floor(d["b"] / 256), d["b"] % 256))[0]
    return F.when(F.forall(octets, lambda x: x <= 255), out).otherwise(m)


def _date(m: Column, key: str, shape: str, form: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    done = permute_pair(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date")
    out = F.transform(F.array(done), lambda d: F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), (d["a"] * DAYS[1] + d["b"]).cast("int")), form))[0]
    return F.when(m.rlike(shape) & n.between(0, DAYS[0] * DAYS[1] - 1), out)


def _american_date(m: Column, key: str) -> Column:
    """mm/dd/yyyy with a day over 12, which can't be dd/mm/yyyy, moved among such dates; null for others.

    Such dates are numbered: those of the months before (their days less 12), then those of the month.
    """
    first = F.lit(FIRST_DAY).cast("date")
    day = F.when(F.substring(m, 4, 2).cast("int") > 12, F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).cast("date"))
    start = lambda months: F.datediff(F.add_months(first, months), first) - 12 * months
    months = (F.year(day) - int(FIRST_DAY[:4])) * 12 + F.month(day) - 1
    index = start(months) + F.dayofmonth(day) - 13
    done = permute_pair(F.floor(index / LATE_DAYS[1]), index % LATE_DAYS[1], LATE_DAYS, key, "late-date")

    def date(new: Column) -> Column:
        about = F.floor(new / (LATE_DAYS[0] * LATE_DAYS[1] / 4800)).cast("int")  # of 4800 months; never off by more than one
        month = F.array_max(F.filter(F.array(about - 1, about, about + 1), lambda k: (k >= 0) & (start(k) <= new)))
        return _let(month, lambda k: F.date_format(F.date_add(F.add_months(first, k), (new - start(k) + 12).cast("int")), "MM/dd/yyyy"))

    out = _let(_let(done, lambda d: d["a"] * LATE_DAYS[1] + d["b"]), date)
    return F.when(m.rlike(r"^\d{2}/") & F.year(day).between(1800, 2199), out)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    done = permute_pair(index, (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")
    three = lambda d: F.lpad((d["a"] + 1 + F.when(d["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0")
    out = F.transform(
        F.array(done),
        lambda d: F.concat_ws("-", three(d), F.lpad((F.floor(d["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((d["b"] % 9999 + 1).cast("string"), 4, "0")),
    )[0]
    return F.when(valid, out).otherwise(m)


def _mod97(text: Column) -> Column:
    def step(s: Column, c: Column) -> Column:
        v = F.conv(c, 36, 10).cast("int")
        return (s * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _compact(m: Column) -> Column:
    return F.regexp_replace(m, r"[ \xA0-]", "")


def _iban(m: Column, key: str) -> Column:
    plain = _compact(m)
    country, rest = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    new = permute_text(rest, key, "iban")
    out = F.concat(country, F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new)
    return F.when(_mod97(F.concat(rest, F.substring(plain, 1, 4))) == 1, _refill(m, out, "A-Z0-9")).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code, 1 before an American number and the trunk 0 stay; a number is the same in every form."""
    digits = _digits(m)
    kept = F.when(m.startswith("+"), F.regexp_extract(digits, _COUNTRY_CODE, 0)).otherwise(F.regexp_extract(digits, r"^[01]", 0))
    rest = F.substring(digits, F.length(kept) + 1, F.length(digits))
    return _refill(m, F.concat(kept, permute_text(rest, key, "phone", ALPHABETS[:1])))


def _secret(m: Column, key: str) -> Column:
    low, high = ("0123456789abcdef", "0123456789ABCDEF")
    return F.when(m.rlike("[A-F]"), permute_text(m, key, "secret", [high])).otherwise(permute_text(m, key, "secret", [low]))


def _token(m: Column, key: str) -> Column:
    kept = F.regexp_extract(m, f"^{_PREFIX}", 0)
    return F.concat(kept, permute_text(F.substring(m, F.length(kept) + 1, F.length(m)), key, "token", ALPHABETS[:3]))


def _email(m: Column, key: str) -> Column:
    domain = F.substring_index(m, "@", -1)
    valid = F.regexp_replace(domain, _NO_DOMAIN, "")
    new = F.concat(permute_text(F.substring_index(m, "@", 1), key, "email", all_letters=True), F.lit("@"), domain)
    return F.when(valid.contains(".") & (F.length(valid) <= 253), new).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one value found; the value itself if it fails its validation."""
    iso = _date(m, key, r"^\d{4}-", "yyyy-MM-dd")
    plain = _compact(m)
    dotted, slashed = _date(m, key, r"^\d{2}\.", "dd.MM.yyyy"), _date(m, key, r"^\d{2}/", "dd/MM/yyyy")
    return (
        F.when(m.contains("@"), _email(m, key))
        .when(m.startswith("+") | m.rlike(f"^(?:{_AMERICAN}|{_TRUNK})$"), _phone(m, key))
        .when(m.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\."), _ip(m, key))
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), _ssn(m, key))
        .when(m.rlike(r"^(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})$"), F.coalesce(iso, dotted, slashed, _american_date(m, key), m))
        .when(plain.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1), _iban(m, key))
        .when(m.rlike(r"^[0-9A-Fa-f]{32,128}$"), _secret(m, key))
        .when(m.rlike(f"^{_PREFIX}"), _token(m, key))
        .when(m.rlike(r"^[0-9 -]+$"), _card(m, key))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pii") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced; ``count_col``: values replaced, long.

    Found are e-mail addresses (the domain stays), card numbers (Luhn; also in groups; the first digit
    stays), IPv4 addresses, phone numbers (E.164 with or without separators, the country code stays;
    North American ones in groups of 3-3-4; those with a trunk 0 in groups), US social security numbers,
    IBANs (mod 97; also in groups; the country stays), dates (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, else
    mm/dd/yyyy; 1800 to 2199), assigned hexadecimal secrets and access tokens that begin as those of common services
    do. A national phone number without any separator is a number like others and stays.

    Defined cases: a null text stays null and counts 0; texts without a value stay as they are; texts of
    any length are scanned whole; a name of over 64 characters before the @ or a domain of over 253 is no
    address; repeated rows are replaced alike; an empty table gives an empty result; a column called as
    ``count_col`` is replaced, all others pass through.
    """
    text = F.col(text_col)
    has = F.coalesce(text.rlike("[0-9@]"), F.lit(False)) & F.coalesce(text.rlike(ANY), F.lit(False))
    found = F.when(has, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    found_col, new_col = free_names(docs, "found", "new")
    out = docs.withColumn(found_col, found).withColumn(new_col, F.transform(found_col, lambda m: pseudonym(m, key)))
    joined = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), F.col(new_col), lambda p, m: F.array(p, F.coalesce(m, F.lit(""))))), "")
    if count_col:
        changed = F.size(F.filter(F.zip_with(found_col, new_col, lambda a, b: a != b), lambda x: x))
        out = out.withColumn(count_col, F.when(F.col(found_col).isNotNull(), changed).otherwise(0).cast("long"))
    return out.withColumn(text_col, F.when(F.col(found_col).isNotNull(), joined).otherwise(text)).drop(found_col, new_col)
