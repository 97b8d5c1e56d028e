"""Columns that measure texts: encoding damage, markup, code and log likeness, share of non-letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# What counts as damage, markup, log line or letter.
REPLACEMENT = "�"
MOJIBAKE = "[ÃÂ][ -~]"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
HTML = "<[^>]+>"
LOG = r"(?U)\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÆØÅabcdefghijklmnopqrstuvwxyzæøå"

# What counts as code, any of these.
CODE = (
    r"\b(function|def|class|import|from|return|void|int|string|bool)\s*[\(\{]",
    r"[a-zA-Z_][a-zA-Z0-9_]*\s*\([^)]*\)\s*\{",
    r"[a-zA-Z_][a-zA-Z0-9_]*\s*=\s*[^=]",
    r"\b(if|for|while|else|elif|switch|case)\s*\(",
    r"[;\}]\s*\n\s*[a-zA-Z_]",
    r"//.*|/\*.*\*/|#.*",
    r"\b(try|catch|finally|throw|except)\b",
    r"""["'][^"']*["']\..*\(""",
)
# Java's engine takes time that grows with the square of a text for some of the patterns above: it begins anew at each letter of a long word, at
# each of many open brackets. What is run instead flags the very same texts, and looks at each character a bounded number of times.
#: HTML: the last < before a >, or, if nothing stands between these, the < before it.
_HTML = "<[^<>]++>|<[^<>]*+<>"
#: A name's last letter, its digits, and white space.
_NAME_END = r"[a-zA-Z_][0-9]*+\s*+"


def occurrences(text: Column, pattern: str) -> Column:
    """Matches summed over all rows; 0 of nothing."""
    return F.coalesce(F.sum(F.regexp_count(text, F.lit(pattern)).cast("long")), F.lit(0).cast("long"))


def is_html(text: Column) -> Column:
    return text.rlike(_HTML)


def is_log(text: Column) -> Column:
    return text.rlike(LOG)


def is_code(text: Column) -> Column:
    """Whether any kind of code (``CODE``, in that order) occurs. A pattern runs only where its literals occur, as plain search is far cheaper."""

    def has(*literals: str) -> Column:
        return reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in literals])

    def found(pattern: str, where: Column = text) -> Column:
        return where.rlike("(?Ud)" + pattern)

    # Of a text cut at each ) that a { follows, a piece holds a call if a name and a ( come after its last other ).
    closed = F.split(text, r"(?U)\)(?=\s*+\{)")
    called = F.exists(F.slice(closed, 1, F.size(closed) - 1), lambda p: found(_NAME_END + r"\(", F.substring_index(p, ")", -1)))
    # Past the text's first quotation mark each one ends a quotation; on a line the first that a point follows leaves most room.
    quoted = found(r"""(?m)^(?>.*?["']\.).*\(""", F.regexp_replace(text, r"""\A[^"']*+["']""", ""))
    kinds = (
        (("(", "{"), found(r"\b(function|def|class|import|from|return|void|int|string|bool)\s*+[\(\{]")),
        (("{",), found(r"\)\s*+\{") & called),
        (("=",), found(_NAME_END + "=[^=]")),
        (("(",), found(r"\b(if|for|while|else|elif|switch|case)\s*+\(")),
        ((";", "}"), found(r"[;\}][^\S\n]*+\n\s*+[a-zA-Z_]")),
        (("//", "#"), F.lit(True)),
        (("/*",), found(r"(?m)^(?>.*?/\*).*\*/")),
        (("try", "catch", "finally", "throw", "except"), found(r"\b(try|catch|finally|throw|except)\b")),
        (('".', "'."), has("(") & quoted),
    )
    return reduce(Column.__or__, [has(*literals) & pattern for literals, pattern in kinds])


def non_alpha_ratio(text: Column) -> Column:
    """Share of characters that are no letters of the fixed alphabet; null for null and for empty text."""
    return F.try_divide(F.length(F.translate(text, LETTERS, "")), F.length(text))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")

