"""Column helpers for cells of exported tables: parsing, cleaning, comparing.

All of them are built-in Spark expressions, so they stay inside code
generation. Null and blank follow one rule: a blank or unreadable cell is null
and null never matches anything.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"
QTY = "decimal(18,4)"

# Legal suffixes removed from vendor names before comparing.
SUFFIX_WORDS = ("llc", "inc", "co", "company", "corp")
TRAILING_SUFFIXES = ("llc", "inc", "inc.", "co", "co.", "corp", "corp.", "company", "ltd", "ltd.", "lp", "llp", "pllc")

# Two-digit years below this are 20yy, the others 19yy.
CENTURY_PIVOT = 69


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- text

#: Where a header name breaks into words: at anything but a letter or digit, and before a capital after a lower-case letter or digit.
_WORD_BREAK = r"[^\p{L}\p{M}\p{N}]+|(?<=[a-z0-9])(?=[A-Z])"


def snake_case_col(c: Column | str) -> Column:
    """Header names to snake case: their words, lower-cased, joined by underscores."""
    words = F.filter(F.split(_col(c), _WORD_BREAK), lambda w: w != "")
    return F.lower(F.array_join(words, "_"))


def snake_case(name: str) -> str:
    """``snake_case_col`` for one name on the driver."""
    words, word, before = [], "", ""
    for ch in str(name):
        inside = unicodedata.category(ch)[0] in "LMN"
        if not inside or ("A" <= ch <= "Z" and ("a" <= before <= "z" or "0" <= before <= "9")):
            words.append(word)
            word = ""
        word, before = word + (ch if inside else ""), ch
    return "_".join(w for w in [*words, word] if w).lower()


def clean_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def normalize_description(c: Column | str) -> Column:
    """Whitespace collapsed; null becomes an empty string, case is kept."""
    return F.coalesce(clean_whitespace(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(F.trim(_col(c).cast("string")), F.lit("")) == ""


def text_key(c: Column | str) -> Column:
    """Trimmed text, null as the empty string: the form keys are compared in."""
    return F.coalesce(F.trim(_col(c).cast("string")), F.lit(""))


def match_text(c: Column | str) -> Column:
    """Lower case, punctuation to spaces, trimmed (null gives '')."""
    low = F.lower(_col(c).cast("string"))
    plain = F.when(low.rlike("[^a-z0-9 ]"), F.regexp_replace(low, r"(?U)[^\w\s]", " ")).otherwise(low)
    return F.coalesce(F.trim(plain), F.lit(""))


def search_text(c: Column | str) -> Column:
    """``match_text`` for queries: Latin accents removed, hyphens kept, spaces collapsed."""
    plain = F.translate(F.lower(_col(c)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s-]", " "), r"\s+", " "))


def strip_legal_suffix(c: Column | str) -> Column:
    """Vendor name without any suffix word, lower case, letters and digits only."""
    words = "|".join(rf"\b{w}\b" for w in SUFFIX_WORDS)
    bare = F.regexp_replace(F.trim(F.lower(_col(c))), words, "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-z0-9 ]", " "), r"\s+", " "))


def strip_trailing_suffix(c: Column | str) -> Column:
    """Vendor name without suffixes at its end only (used for purchase orders)."""
    words = "|".join(re.escape(w) for w in sorted(TRAILING_SUFFIXES, key=len, reverse=True))
    return F.trim(F.regexp_replace(F.lower(_col(c)), rf"(?:\s+(?:{words}))+$", ""))


def group_id(prefix: str, key: Column) -> Column:
    """Stable id of a group: prefix and the first 8 hex digits of an MD5."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.md5(F.concat(F.lit(prefix), key)), 1, 8))


def mask_preview(c: Column | str, keep: int = 4) -> Column:
    """Letters and digits starred, but for the last ``keep`` (fewer when short)."""
    text = _col(c)
    shown = F.least(F.lit(keep), F.greatest(F.length(text) - 2, F.lit(0)))
    hidden = F.length(text) - shown
    return F.concat(F.regexp_replace(F.substring(text, F.lit(1), hidden), r"[\p{L}\p{N}]", "*"),
                    F.substring(text, hidden + 1, shown))


def row_ref(table: Column, row: Column) -> Column:
    return F.concat_ws(":", table, row.cast("string"))


def result_json(*cols: Column | str) -> Column:
    return F.to_json(F.struct(*cols))


# ---------------------------------------------------------------- dates

# The written forms of a date, tried in this order (month before
# day where both fit); the form with a two-digit year is completed first.
DATE_FORMS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3}\s+\d{1,2},\s*\d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{3,9}\s+\d{1,2},\s*\d{4}$", "MMMM d, yyyy"),
)
DATE_SHAPE = r"^\s*(?:\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/](?:\d{1,2}|[A-Za-z]{3})[-/](?:\d{4}|\d{2})|[A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})\s*$"


def parse_date(c: Column | str) -> Column:
    """Text to date. Cells that look like no date at all are settled by one
    pattern before the forms are tried."""
    text = F.trim(_col(c))
    tries = []
    for shape, form in DATE_FORMS:
        value, fmt = text, form
        if form == "M/d/yy":
            pivot = F.regexp_extract(text, r"(\d\d)$", 1) < F.lit(str(CENTURY_PIVOT))
            value, fmt = F.regexp_replace(text, r"(\d\d)$", F.when(pivot, F.lit("20$1")).otherwise("19$1")), "M/d/yyyy"
        elif " " in form:
            value = F.regexp_replace(text, r"\s+", " ")
        tries.append(F.when(text.rlike(shape), F.try_to_date(value, fmt)))
    return F.when(text.rlike(DATE_SHAPE), F.coalesce(*tries))


def excel_serial_date(c: Column | str, as_of: Column) -> Column:
    """Five-digit spreadsheet serial to date, if within 15 years before to 5
    years after ``as_of`` (calendar years); otherwise null."""
    text = F.trim(_col(c))
    # only cells that look like one are cast: a failed cast costs an exception
    serial = F.when(text.rlike(r"^\d{5}(?:\.0+)?$"), F.substring(text, 1, 5).try_cast("int"))
    day = F.date_add(F.lit("1899-12-30").cast("date"), serial)
    return F.when(F.year(day).between(F.year(as_of) - 15, F.year(as_of) + 5), day)


# ---------------------------------------------------------------- amounts

# How an amount may be written: digits with dollar signs, commas and spaces
# among them, in brackets or with a minus on either side when negative.
_DIGITS = r"[$,\s]*(?:\d[\d$,\s]*(?:\.[\d$,\s]*)?|\.[$,\s]*\d[\d$,\s]*)"
AMOUNT_SHAPE = rf"^\s*(?:\(\s*-?{_DIGITS}-?\s*\)|[$,\s]*-?\+?{_DIGITS}-?\s*)$"
_DECORATION = "()$,+- \t\n\r"


def parse_amount(c: Column | str, dtype: str = QTY) -> Column:
    """Text to decimal: ``$``, thousands commas, brackets or a minus on either
    side. Only plain digits are accepted beneath."""
    text = _col(c)
    sign = F.when(text.rlike("[-(]"), F.lit("-")).otherwise("")
    return F.when(text.rlike(AMOUNT_SHAPE), F.concat(sign, F.translate(text, _DECORATION, "")).try_cast(dtype))


def is_amount(c: Column | str) -> Column:
    """Whether a cell reads as an amount (one pattern, nothing is parsed)."""
    return F.coalesce(_col(c).rlike(AMOUNT_SHAPE), F.lit(False))


def clean_amount_text(c: Column | str) -> Column:
    """Amount cell as plain text (``-12.50``); blanks stay as they are."""
    raw = _col(c)
    text = F.translate(clean_whitespace(raw), "−", "-")
    bracketed = text.rlike(r"^\(.*\)$")
    bare = F.translate(F.regexp_replace(text, r"^\((.*)\)$", "$1"), "$, ", "")
    sign = F.when(bracketed | bare.rlike("^-|-$"), F.lit("-")).otherwise("")
    digits = F.regexp_replace(F.regexp_replace(bare, "-$", ""), "^-", "")
    return F.when(is_blank(raw) | (digits == ""), raw).otherwise(F.concat(sign, digits))


def signed_amount(debit: Column, credit: Column) -> Column:
    """Debit minus credit; a missing side is 0, both missing is null."""
    zero = F.lit(0).cast(MONEY)
    return F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(debit, zero) - F.coalesce(credit, zero))


def split_signed_amount(amount: Column) -> tuple[Column, Column]:
    """(debit, credit) of one signed amount; zero fills neither."""
    return F.when(amount > 0, amount), F.when(amount < 0, -amount)


def split_year_period(c: Column | str) -> tuple[Column, Column, Column]:
    """``2026/03``, ``26/03`` or ``*2026/03`` to (fiscal year, period, unposted)."""
    text = F.trim(_col(c))
    body = F.regexp_replace(text, r"^\*+", "")
    year = F.regexp_extract(body, r"^([^/]*)", 1)
    two = year.rlike(r"^\d{2}$")
    century = F.when(year.try_cast("int") < CENTURY_PIVOT, "20").otherwise("19")
    return (F.when(two, F.concat(century, year)).otherwise(year),
            F.regexp_extract(body, r"^[^/]*/(.*)$", 1),
            F.coalesce(text.startswith("*"), F.lit(False)))


# A combined vendor cell: number, optional dash, name.
VENDOR_CELL = r"^(\d+)\s+(?:-\s+)?(\S.*)$"


def split_vendor(c: Column | str) -> tuple[Column, Column, Column]:
    """``1022 Valley Telecom`` to (fits, number, name)."""
    text = F.trim(_col(c))
    return text.rlike(VENDOR_CELL), F.regexp_extract(text, VENDOR_CELL, 1), F.regexp_extract(text, VENDOR_CELL, 2)


# ---------------------------------------------------------------- comparing

def amounts_match(a: Column, b: Column, tol=0) -> Column:
    return F.coalesce(F.abs(a - b) <= F.lit(tol), F.lit(False))


def signed_equal(a: Column, b: Column, tol=0) -> Column:
    return amounts_match(F.abs(a), F.abs(b), tol)


def dates_within(a: Column, b: Column, days: int = 0) -> Column:
    return F.coalesce(F.abs(F.datediff(a, b)) <= F.lit(days), F.lit(False))


def pct_of(part: Column, whole: Column) -> Column:
    """Percentage, null when the whole is 0."""
    return F.try_divide(part.cast("double") * 100, whole.cast("double"))


def deviation_pct(value: Column, base: Column) -> Column:
    """Absolute deviation from ``base`` in percent of it, null when it is 0."""
    v, b = value.cast("double"), base.cast("double")
    return F.try_divide(F.abs(v - b), b) * 100
