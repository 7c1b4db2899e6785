"""Personal data replaced by keyed pseudonyms of the same format.

What looks like a card, phone, social security or bank account number, an address of the internet protocol or a date is validated
first; what is valid is permuted within its format by a Feistel network with a keyed round function. The permutation is
one to one on the format's values, so equal values stay linked across documents and different ones stay apart. Mail addresses and
secrets, which are no numbers, become keyed digests. Everything else in the text stays as it is.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import let

ROUNDS = 10
#: Forms of personal data. Starts are pinned and repeats bounded, so that matching takes time in proportion to the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?i:(?<![A-Za-z])(?:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?[A-Za-z0-9_/+=.-]{12,200})",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?:ghp|sk|pk)_[A-Za-z0-9]{16,64}|[0-9a-f]{32,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d/\d\d/(?:19|20)\d\d|\d\d\.\d\d\.(?:19|20)\d\d)(?![0-9/-])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?<!(?i:version|release|firmware|build|ver\.?|v\.?)[ :=]{0,2})\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z])\d(?:[ -]?\d){12,18}(?![0-9])",
}
#: What card numbers start with, by issuers' ranges.
ISSUER = r"^(?:4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[04-9]|6(?:0|2|3|4[4-9]|5|7))"
#: How long a bank account number of a country is.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 "
    "KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Calling codes of one and two digits; all others have three.
CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
#: Days from 1900-01-01 to 2099-12-31 are 17 x 4297; valid social security numbers are 898 areas times 99 x 9999.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
AREAS, SERIALS = 898, 99 * 9999


def _column(key: Column | str) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def _prf(key: Column | str, tweak: str, i: Column, x: Column) -> Column:
    """60 keyed pseudorandom bits."""
    digest = F.sha2(F.concat(_column(key), F.lit(f"|{tweak}|"), i.cast("string"), F.lit("|"), x.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column | int, size_b: Column | int, key: Column | str, tweak: str) -> Column:
    """A keyed permutation of the pairs (a, b) with 0 <= a < size_a, 0 <= b < size_b, as struct (a, b)."""
    sizes = [F.lit(s).cast("long") if isinstance(s, int) else s.cast("long") for s in (size_a, size_b)]
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, i: F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(_prf(key, tweak, i, s["b"]), F.when(i % 2 == 0, sizes[0]).otherwise(sizes[1])), F.when(i % 2 == 0, sizes[0]).otherwise(sizes[1])).alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def permute_digits(digits: Column, key: Column | str, tweak: str) -> Column:
    """A keyed permutation of the digit strings of one length, of 2 to 34 digits."""

    def of(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        size = lambda k: F.expr("1L") * F.pow(F.lit(10.0), k).cast("long")
        pair = feistel(d.substr(F.lit(1), u), d.substr(u + 1, n - u), size(u), size(n - u), key, tweak)
        return let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), u, "0"), F.lpad(p["b"].cast("string"), n - u, "0")))

    return let(digits, of)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    parts = F.split(form, "[0-9]", -1)
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p, i: F.concat(digits.substr(i + 1, F.lit(1)), p)), ""))


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a valid number."""
    each = lambda c, i: let(c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d))
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), each), F.lit(0), lambda a, x: a + x)


def _is_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & d.rlike(ISSUER) & (_luhn(d) % 10 == 0)


def _card(m: Column, key: Column) -> Column:
    """The issuer's digits stay, the account's are permuted, the check digit is set anew. Of digits with separators the longest start that is a number is taken."""
    sound = lambda e: ((e == F.length(m)) | m.substr(e + 1, F.lit(1)).isin(" ", "-")) & _is_card(_digits(m.substr(F.lit(1), e)))

    def of(d: Column) -> Column:
        head = F.regexp_extract(d, ISSUER, 0)
        payload = F.concat(head, permute_digits(d.substr(F.length(head) + 1, F.length(d) - 1 - F.length(head)), key, "card"))
        return let(payload, lambda p: F.concat(p, ((10 - _luhn(F.concat(p, F.lit("0"))) % 10) % 10).cast("string")))

    def upto(e: Column) -> Column:
        start = m.substr(F.lit(1), e)
        return F.when(e.isNotNull(), F.concat(_refill(start, let(_digits(start), of)), m.substr(e + 1, F.length(m))))

    return let(F.get(F.filter(F.sequence(F.length(m), F.lit(13), F.lit(-1)), sound), F.lit(0)), upto)


def _mod97(x: Column) -> Column:
    """Remainder by 97 of a string of digits and letters, letters as 10 to 35."""
    return F.aggregate(F.split(x, ""), F.lit(0), lambda a, c: let(F.when(c.rlike("[0-9]"), c).otherwise((F.ascii(c) - 55).cast("string")), lambda s: F.pmod(a * F.when(F.length(s) == 2, 100).otherwise(10) + s.cast("int"), F.lit(97))))


def _iban(m: Column, key: Column) -> Column:
    """Digits of the account part are permuted, its letters stay, and the check digits are set anew."""

    def of(x: Column) -> Column:
        body, head = x.substr(F.lit(5), F.length(x) - 4), x.substr(F.lit(1), F.lit(2))
        new = let(_digits(body), lambda d: F.when(F.length(d) >= 4, _refill(body, permute_digits(d, key, "iban"))))
        full = let(new, lambda b: F.concat(head, F.lpad((98 - _mod97(F.concat(b, head, F.lit("00")))).cast("string"), 2, "0"), b))
        spaced = let(full, lambda f: F.array_join(F.transform(F.split(m, ""), lambda c, i: F.when(c == " ", c).otherwise(f.substr(F.length(F.replace(m.substr(F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), ""))
        right = F.array_contains(F.split(F.lit(IBAN_LENGTHS), " "), F.concat(head, F.length(x).cast("string")))
        return F.when(right & (_mod97(F.concat(body, x.substr(F.lit(1), F.lit(4)))) == 1), spaced)

    return let(F.replace(m, F.lit(" "), F.lit("")), of)


def _date(m: Column, key: Column) -> Column:
    day = F.coalesce(*[F.when(m.rlike(p), F.try_to_date(m, f)) for p, f in (("^[0-9]{4}-", "yyyy-MM-dd"), ("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"), (r"^..\.", "dd.MM.yyyy"))])
    form = F.when(m.rlike("^[0-9]{4}-"), F.lit("yyyy-MM-dd")).when(m.rlike(r"^..\."), F.lit("dd.MM.yyyy")).when(F.try_to_date(m, "dd/MM/yyyy").isNotNull(), F.lit("dd/MM/yyyy")).otherwise(F.lit("MM/dd/yyyy"))

    def of(n: Column) -> Column:
        p = feistel(F.floor(n / DAYS[1]), n % DAYS[1], *DAYS, key, "date")
        new = let(p, lambda q: F.date_add(F.lit(FIRST_DAY).cast("date"), (q["a"] * DAYS[1] + q["b"]).cast("int")))
        out = F.lit(None).cast("string")
        for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MM/dd/yyyy"):
            out = F.when(form == f, F.date_format(new, f)).otherwise(out)
        return F.when(n.between(0, DAYS[0] * DAYS[1] - 1), out)

    return let(F.datediff(day, F.lit(FIRST_DAY).cast("date")), of)


def _ssn(m: Column, key: Column) -> Column:
    part = F.transform(F.split(m, "-"), lambda x: x.cast("int"))

    def of(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        q = feistel(area - 1 - (area > 666).cast("int"), (group - 1) * 9999 + serial - 1, AREAS, SERIALS, key, "ssn")
        return F.when(ok, let(q, lambda x: F.format_string("%03d-%02d-%04d", x["a"] + 1 + (x["a"] >= 665).cast("long"), F.floor(x["b"] / 9999) + 1, x["b"] % 9999 + 1)))

    return let(part, of)


def _ip(m: Column, key: Column) -> Column:
    def of(p: Column) -> Column:
        q = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 1 << 16, 1 << 16, key, "ip")
        return F.when(F.array_max(p) < 256, let(q, lambda x: F.concat_ws(".", F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256)))

    return let(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), of)


def _phone(m: Column, key: Column) -> Column:
    """The country code stays, the national number is permuted, whatever separators stand in either: a number is linked however it is written.

    Codes are known by their digits. A number without a plus sign is a national one of ten digits, and is taken for one of code 1, which writes them so.
    """
    short = "|".join(CODES.split(" "))
    code = F.regexp_extract(_digits(m), f"^(?:{short}|[0-9]{{3}})", 0)
    skip = F.when(m.startswith("+"), F.length(code)).otherwise(0)
    # the text up to the code's last digit
    head = F.when(skip == 0, F.lit("")).otherwise(F.regexp_extract(m, r"^\+(?:[ .()-]*[0-9]){1}", 0))
    head = F.when(skip == 2, F.regexp_extract(m, r"^\+(?:[ .()-]*[0-9]){2}", 0)).when(skip == 3, F.regexp_extract(m, r"^\+(?:[ .()-]*[0-9]){3}", 0)).otherwise(head)

    def of(h: Column) -> Column:
        rest = m.substr(F.length(h) + 1, F.length(m))
        return let(_digits(rest), lambda d: F.when(F.length(d).between(7, 14), F.concat(h, _refill(rest, permute_digits(d, key, "phone")))))

    return let(head, of)


def _email(m: Column, key: Column) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(_column(key), F.lit("|email|"), F.lower(m)).cast("binary"), 256), 1, 16), F.lit("@example.invalid"))


def _secret(m: Column, key: Column) -> Column:
    """The name before the secret stays; the secret becomes as many hexadecimal digits of a keyed digest."""
    name = F.regexp_extract(m, r"^(?i:((?:token|secret|password|passwd|api[_-]?key)\s{0,3}[=:]\s{0,3}\"?)|)", 1)
    value = m.substr(F.length(name) + 1, F.length(m))
    digest = F.sha2(F.concat(_column(key), F.lit("|secret|"), F.lower(value)).cast("binary"), 256)
    return F.concat(name, F.substring(F.repeat(digest, F.lit(4)), F.lit(1), F.length(value)))


def _replacement(m: Column, key: Column) -> Column:
    """(kind, text) for one match; null if it is nothing that is valid. Kinds are tried in the order of PATTERNS."""
    makers = {"email": _email, "secret": _secret, "key": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ip": _ip, "phone": _phone, "card": _card}
    options = []
    for kind, make in makers.items():
        whole = f"^(?:{PATTERNS[kind]})$"
        options.append(F.when(m.rlike(whole), _tagged(make(m, key), kind)))
    return F.coalesce(*options)


def _tagged(text: Column, kind: str) -> Column:
    return let(text, lambda t: F.when(t.isNotNull(), F.struct(F.lit(kind).alias("kind"), t.alias("text"))))


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (text, ...) with text replaced, and pii: array of (kind, text), the pseudonyms in the order of their places.

    Null text stays null; a text without personal data stays as it is, and so does what looks like a number but is not valid. A column of ``docs`` named pii is
    replaced. Without a key there is an error: whoever knows it can undo the permutations. It goes to the tasks as a row, so that
    it does not stand in plans.
    """
    if not key:
        raise ValueError("pseudonyms need a secret key")
    derived = hmac.new(key.encode(), b"vicinal pseudonyms", hashlib.sha256).hexdigest()
    secret = docs.sparkSession.createDataFrame([(derived,)], "_key string").scalar()
    t = F.col("text")
    none = F.array().cast("array<struct<kind:string,text:string>>")
    found = F.when(t.rlike("[0-9@]") & t.rlike(ANY), F.regexp_extract_all(t, F.lit(f"({ANY})"), F.lit(0)))
    d = docs.drop("pii").withColumns({"_m": found, "_key": secret})
    d = d.withColumn("_r", F.transform("_m", lambda m: F.struct(m.alias("m"), _replacement(m, F.col("_key")).alias("new"))))
    between = F.split(t, ANY, -1)
    text = F.when(F.size("_m") > 0, let(between, lambda b: F.concat(F.element_at(b, 1), F.array_join(F.transform("_r", lambda r, i: F.concat(F.coalesce(r["new"]["text"], r["m"]), F.get(b, i + 1))), "")))).otherwise(t)
    pii = F.when(F.size("_m") > 0, F.filter(F.transform("_r", lambda r: r["new"]), lambda x: x.isNotNull())).otherwise(none)
    return d.select(*[text.alias("text") if c == "text" else F.col(c) for c in d.columns if c not in ("_m", "_r", "_key")], pii.alias("pii"))
