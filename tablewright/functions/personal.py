"""Personal data, verified: candidates by pattern, then what the pattern can't tell by arithmetic (Luhn's digit, the IBAN's remainder, octets), as expressions; counts and masked texts.

A candidate is a maximal run, so part of a longer number is none. Patterns take a bounded number of steps a character. Null gives no matches, and null as masked text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Lengths of account numbers by country (ISO 13616).
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}
#: Words before a number of four parts that make it a version.
VERSION_WORDS = ("v", "ver", "version", "release", "rev", "revision", "build", "section", "chapter")

#: What may be personal data, by kind; each masked in this order.
CANDIDATES = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"[A-Za-z0-9]?[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,40}",
    "card": r"[A-Za-z]?[0-9]{13,60}[A-Za-z]?|[0-9]{4,30}(?:[ -][0-9]{4}){2}[ -][0-9]{4,30}|[0-9]{4,30}[ -][0-9]{6}[ -][0-9]{5,30}",
    "ip_address": r"[A-Za-z]{0,9}[ .]?[0-9]{1,3}(?:\.[0-9]{1,9}){3,40}",
    "phone": r"\+?[0-9(][0-9()]{0,4}(?:[ .()/-]{1,2}[0-9]{1,12}){1,8}|\+[0-9]{8,30}",
}#: What a card's number looks like: digits without a blank, or in the usual groups.
CARD = "^([0-9]+|[0-9]{4}([ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _chars(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def luhn(digits: Column) -> Column:
    """Whether the last of a text of digits is the check digit of the others."""
    turned = _chars(F.reverse(digits))
    doubled = F.transform(turned, lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda t, x: t + x) % 10 == 0


def iban(compact: Column) -> Column:
    """Whether an account number without blanks leaves 1 when divided by 97, its first four characters put last and letters read as 10 to 35."""
    moved = F.concat(F.substr(compact, F.lit(5)), F.substring(compact, 1, 4))
    values = F.transform(_chars(moved), lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48))
    return F.aggregate(values, F.lit(0), lambda t, v: (t * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def _genuine(kind: str, x: Column) -> Column:
    if kind == "card":
        d = _digits(x)
        return x.rlike(CARD) & F.length(d).between(13, 19) & (F.length(F.regexp_replace(d, "^(.)\\1*$", "")) > 0) & luhn(d)
    if kind == "iban":
        compact, length = F.replace(x, F.lit(" "), F.lit("")), F.lit(None).cast("int")
        for n in sorted(set(IBAN_LENGTHS.values())):
            length = F.when(F.substring(compact, 1, 2).isin([c for c, m in IBAN_LENGTHS.items() if m == n]), n).otherwise(length)
        return F.coalesce((F.length(compact) >= length) & compact.rlike("^[A-Z]{2}[0-9]{2}") & iban(F.substr(compact, F.lit(1), length)), F.lit(False))
    if kind == "ip_address":
        word, parts = F.lower(F.regexp_extract(x, "^([A-Za-z]*)", 1)), F.split(F.regexp_extract(x, r"([0-9][0-9.]*)$", 1), r"\.")
        return ~word.isin(*VERSION_WORDS) & (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, p).otherwise("0").cast("int") <= 255) & ((p == "0") | ~p.startswith("0")))
    if kind == "phone":
        n = F.length(_digits(x))
        return F.when(x.startswith("+"), n.between(8, 15)).otherwise((n == 10) & x.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"))
    return x.rlike(r"\.[A-Za-z]{2,24}$")


def matches(text: Column, kind: str) -> Column:
    """The verified matches of a kind in a text, in order. An IP address comes with the word before it, if that stands close."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CANDIDATES[kind]), F.lit(0)), lambda x: _genuine(kind, x))


def masked(text: Column, kinds: tuple[str, ...] = tuple(CANDIDATES)) -> Column:
    """``text`` with each verified match replaced by its kind in brackets, all else as it was. Time goes with the text's length, however many matches."""
    for kind in kinds:
        every = F.regexp_extract_all(text, F.lit(CANDIDATES[kind]), F.lit(0))
        label = F.lit(f"[{kind}]")
        keep = (lambda x: F.concat(F.regexp_extract(x, r"^([A-Za-z]*[ .]?)", 1), label)) if kind == "ip_address" else (lambda x: label)
        new = F.transform(every, lambda x: F.when(_genuine(kind, x), keep(x)).otherwise(x))
        between = F.split(text, CANDIDATES[kind], -1)
        text = F.when(F.size(every) > 0, F.concat_ws("", F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))).otherwise(text)
    return text
