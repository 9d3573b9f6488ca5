"""Format-preserving pseudonyms by a keyed Feistel permutation, from DataFrame functions only.

Found in the whole text, and replaced where they validate:

* payment cards (13 to 19 digits, Luhn): the first digit stays, the others are permuted, the check digit is recomputed;
* IBANs (mod 97): country and length stay, digits are permuted, letters stay, the check digits are recomputed;
* US social security numbers (valid areas, groups and serials): permuted among the valid ones; telephone numbers
  ``+C (AAA) BBB-DDDD`` and the like: country code and punctuation stay, the rest is permuted;
* dates (ISO and ``/`` forms that exist in the calendar from 1900 to 2099): permuted among the days of those years;
* IPv4 addresses with octets to 255: permuted among all 2^32;
* e-mail addresses: the letters a to z (in lower case) and digits of local parts are permuted among those of as many, other
  characters and the domain stay; local parts with other letters become keyed letters of the same length. Secrets in
  ``token = "hex"`` and like assignments: hexadecimal digits (in lower case) are permuted.

The same value gives the same pseudonym in every document (under one key), so links stay. Numbers that don't validate,
such as a 16-digit number that fails Luhn, are left alone.

Whoever has the key can invert all this: pass your own; ``KEY`` is for demonstration.

Defined cases: null text stays null; empty text stays empty; documents without a digit or ``@`` pass unchanged;
repeated rows and other columns pass through, but for one called ``_pii_found``, which gives way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

KEY = "tracelake-demo-key"
ROUNDS = 8
EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
#: In order of precedence at one position.
FORMS = {
    "email": r"[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]+)+",
    "secret": r"(?i:token|secret|password|api_?key)\s{0,3}[=:]\s{0,3}\"?[0-9A-Fa-f]{12,}+\"?",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
    "phone": r"\+[0-9]{1,3}[ .\-]?\(?[0-9]{2,4}\)?[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}",
    "ip": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ \-]?[0-9]){12,18}",
}
#: One scan: a match starts at no letter or digit, and ends before none.
ANY = r"(?<![\p{L}\p{N}._%+\-])" + FORMS["email"] + "|" + EDGE_L + "(?:" + "|".join(v for k, v in FORMS.items() if k != "email") + ")" + EDGE_R
DAYS, FIRST_DAY = 73_049, "1900-01-01"


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts, F.lit(key)), 256)


def _number(hexes: Column, start: int = 1, n: int = 15) -> Column:
    return F.conv(F.substring(hexes, start, n), 16, 10).cast("long")


def feistel(digits: Column, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of as many decimal digits (2 to 36)."""

    def turn(s: Column, r: Column) -> Column:
        n = F.length(s["a"])
        power = F.rpad(F.lit("1"), n + 1, "0").cast("decimal(38,0)")
        added = s["a"].cast("decimal(38,0)") + _number(_digest(key, F.lit(tweak), r.cast("string"), n.cast("string"), s["b"])).cast("decimal(38,0)")
        return F.struct(s["b"].alias("a"), F.lpad(F.pmod(added, power).cast("decimal(38,0)").cast("string"), n, "0").alias("b"))

    half = F.floor(F.length(digits) / 2).cast("int")
    start = F.struct(F.substring(digits, F.lit(1), half).alias("a"), F.substring(digits, half + 1, F.length(digits)).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def feistel_below(value: Column, size: int, width: int, key: str, tweak: str) -> Column:
    """A keyed permutation of 0 .. size - 1 by cycle walking among the numbers of width digits."""
    step = lambda v: feistel(F.lpad(v.cast("string"), width, "0"), key, tweak).cast("long")
    # The value itself lies in range, so every walk ends; 48 steps leave less than 1e-12 for the ranges used here.
    return F.aggregate(F.sequence(F.lit(1), F.lit(48)), step(value), lambda v, _: F.when(v < size, v).otherwise(step(v)))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, one by one, by those given."""
    parts = F.split(form, "[0-9]", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.substring(digits, i + 1, F.lit(1)))), "")


def luhn_sum(digits: Column) -> Column:
    def of(d: Column, i: Column) -> Column:
        twice = d.cast("int") * F.when(F.pmod(i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), of), F.lit(0), lambda a, x: a + x)


def mod97(text: Column) -> Column:
    """The value of an IBAN's rearranged characters, letters as 10 to 35, modulo 97."""
    chars = F.filter(F.split(F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(F.when(c.between("0", "9"), a * 10).otherwise(a * 100) + value(c), F.lit(97)))


def card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), feistel(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
        return F.when(F.pmod(luhn_sum(d), F.lit(10)) == 0, refill(m, F.concat(body, check.cast("string")))).otherwise(m)

    return let(digits_of(m), of)


def iban(m: Column, key: str) -> Column:
    def of(c: Column) -> Column:
        rest = F.substring(c, 5, 40)
        new = refill(rest, F.when(F.length(digits_of(rest)) > 1, feistel(digits_of(rest), key, "iban")).otherwise(digits_of(rest)))
        country = F.substring(c, 1, 2)
        check = F.lpad((98 - mod97(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0")
        return F.when(mod97(c) == 1, refill(m, F.concat(check, digits_of(new)))).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), of)


def phone(m: Column, key: str) -> Column:
    country = digits_of(F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])", 0))

    def of(d: Column) -> Column:
        n = F.when(F.length(country) > 0, F.length(country)).otherwise(1)
        return F.when(F.length(d) >= 8, refill(m, F.concat(F.substring(d, F.lit(1), n), feistel(F.substring(d, n + 1, F.length(d)), key, "phone")))).otherwise(m)

    return let(digits_of(m), of)


def ssn(m: Column, key: str) -> Column:
    valid = lambda d: ~d.rlike("^(?:000|666|9|.{3}00|.{5}0000)")
    step = lambda d: feistel(d, key, "ssn")
    # Cycle walking, as in feistel_below; a ninth of all numbers isn't valid.
    walked = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(24)), step(d), lambda v, _: F.when(valid(v), v).otherwise(step(v)))
    return let(digits_of(m), lambda d: F.when(valid(d), refill(m, walked(d))).otherwise(m))


def ip(m: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
        new = lambda v: F.concat_ws(".", *[F.pmod(F.floor(v / (1 << s)), F.lit(256)).cast("long").cast("string") for s in (24, 16, 8, 0)])
        return F.when(F.forall(parts, lambda x: x.cast("int") <= 255), let(feistel_below(value, 1 << 32, 10, key, "ip"), new)).otherwise(m)

    return let(F.split(m, r"\."), of)


def date(m: Column, key: str) -> Column:
    def of(fmt: str, day: Column) -> Column:
        index = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("long")
        moved = F.date_add(F.lit(FIRST_DAY).cast("date"), feistel_below(index, DAYS, 5, key, "date").cast("int"))
        return F.when(index.between(0, DAYS - 1), F.date_format(moved, fmt)).otherwise(m)

    us, eu = (F.try_to_timestamp(m, F.lit(f)).cast("date") for f in ("MM/dd/yyyy", "dd/MM/yyyy"))
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(iso.isNotNull(), of("yyyy-MM-dd", iso)).when(us.isNotNull(), of("MM/dd/yyyy", us)).when(eu.isNotNull(), of("dd/MM/yyyy", eu)).otherwise(m)


def keyed_like(text: Column, letters: str, key: str, tweak: str) -> Column:
    """As many characters of letters, drawn by keyed digests of the whole text."""
    pick = lambda i: F.substring(F.lit(letters), (F.pmod(_number(_digest(key, F.lit(tweak), i.cast("string"), text)), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
    return F.when(F.length(text) < 1, text).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), pick), ""))


def feistel_chars(text: Column, letters: str, key: str, tweak: str) -> Column:
    """A keyed permutation of the strings of as many of letters."""

    def added(a: Column, b: Column, r: Column) -> Column:
        def one(i: Column) -> Column:
            turn = _number(_digest(key, F.lit(tweak), r.cast("string"), i.cast("string"), F.length(a).cast("string"), b))
            return F.substring(F.lit(letters), F.pmod(F.instr(F.lit(letters), F.substring(a, i, F.lit(1))) - 1 + turn, F.lit(len(letters))).cast("int") + 1, F.lit(1))

        return F.when(F.length(a) == 0, a).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.length(a)), one), ""))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    turn = lambda s, r: F.struct(s["b"].alias("a"), added(s["a"], s["b"], r).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def refill_chars(form: Column, chars: Column, cls: str) -> Column:
    """form with its characters of a class replaced, one by one, by those given."""
    parts = F.split(form, cls, -1)
    return F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.substring(chars, i + 1, F.lit(1)))), "")


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def email(m: Column, key: str) -> Column:
    def of(local: Column) -> Column:
        plain = refill_chars(local, feistel_chars(F.regexp_replace(local, "[^a-z0-9]", ""), LETTERS, key, "email"), "[a-z0-9]")
        return F.when(local.rlike(r"^[a-z0-9._%+\-]+$"), plain).otherwise(keyed_like(local, LETTERS, key, "email"))

    return F.concat(let(F.lower(F.substring_index(m, "@", 1)), of), F.lit("@"), F.substring_index(m, "@", -1))


def secret(m: Column, key: str) -> Column:
    run = F.regexp_extract(m, r"[0-9A-Fa-f]{12,}", 0)
    at = F.instr(m, run)
    return F.concat(F.substring(m, F.lit(1), at - 1), feistel_chars(F.lower(run), "0123456789abcdef", key, "secret"), F.substring(m, at + F.length(run), F.length(m)))


MAKERS = {"email": email, "secret": secret, "iban": iban, "phone": phone, "ip": ip, "date": date, "ssn": ssn, "card": card}


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of ANY; a match that doesn't validate stays as it is."""
    out = None
    for kind, make in MAKERS.items():
        is_kind = m.rlike(f"^(?:{FORMS[kind]})$")
        out = F.when(is_kind, make(m, key)) if out is None else out.when(is_kind, make(m, key))
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """docs with pseudonyms in text, and ``_pii_found`` (matches replaced by another value)."""
    t = F.col(text)

    def swapped(ms: Column) -> Column:
        return let(F.transform(ms, lambda m: pseudonym(m, key)), lambda ps: F.struct(
            F.array_join(F.transform(F.split(t, ANY, -1), lambda p, i: F.concat(p, F.coalesce(F.get(ps, i), F.lit("")))), "").alias("text"),
            F.size(F.filter(F.zip_with(ms, ps, lambda m, p: m != p), lambda x: x)).cast("long").alias("n"),
        ))

    some = let(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda ms: F.when(F.size(ms) > 0, swapped(ms)).otherwise(F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))))
    plain = F.struct(t.alias("text"), F.lit(0).cast("long").alias("n"))
    docs = docs.drop("_pii_found")
    new = free_name("_pii", docs)
    out = docs.withColumn(new, F.when(t.rlike("[0-9@]"), some).otherwise(plain))
    return out.select(*[F.col(f"{new}.text").alias(c) if c == text else F.col(c) for c in docs.columns], F.col(f"{new}.n").alias("_pii_found"))
