"""Column functions that read numbers, dates, names and account numbers as they come."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which folded words tell an account's type; the first that matches counts.
TYPE_WORDS = (
    ("credit_card", ("tarjeta", "card")),
    ("loan", ("credito", "prestamo", "hipotec", "vivienda", "libranza", "loan")),
    ("savings", ("ahorro", "saving")),
    ("checking", ("corriente", "checking")),
    ("investment", ("inversion", "cdt", "invest")),
)
NO_DATE = "1970-01-01"


@cache
def _composed() -> tuple[str, str]:
    """Letters that canonical decomposition turns into one letter and marks, and those letters."""
    pairs = []
    for point in range(0xC0, min(0x10000, sys.maxunicode)):
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if marks and all(unicodedata.category(m)[0] == "M" for m in marks):
            pairs.append((chr(point), base))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def fold_text(text: Column) -> Column:
    """Lower case without diacritics: precomposed letters lose them, and so do combining and spacing ones."""
    return F.lower(F.regexp_replace(F.translate(text, *_composed()), r"[\p{M}^`\x{A8}\x{AF}\x{B4}\x{B7}\x{B8}]", ""))


def guess_type(name: Column) -> Column:
    """The account type that a name suggests, ``other`` if none."""
    folded = fold_text(name)
    found = None
    for kind, needles in TYPE_WORDS:
        hit = folded.rlike("|".join(needles))
        found = F.when(hit, kind) if found is None else found.when(hit, kind)
    return found.otherwise("other")


def to_number(text: Column) -> Column:
    """A number written with points for thousands and a decimal comma; 0 for null or text without one.

    A lone point counts as decimal unless three characters follow.  With a
    comma all points go, and digits count up to a second comma.  The sign is
    that of the first kept character; other minus signs are ignored.
    """
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.,-]", "")
    digits = F.replace(kept, F.lit("-"), F.lit(""))
    no_points = F.replace(digits, F.lit("."), F.lit(""))
    comma = F.concat(F.substring_index(no_points, ",", 1), F.lit("."), F.substring(no_points, F.instr(no_points, ",") + 1, F.length(no_points)))
    grouped = (F.length(digits) - F.length(no_points) > 1) | digits.rlike(r"\A[0-9]*\.[0-9]{3}\z")
    plain = F.when(F.contains(digits, F.lit(",")), comma).when(grouped, no_points).otherwise(digits)
    value = F.coalesce(F.regexp_extract(plain, r"\A([0-9]+\.?[0-9]*|\.[0-9]+)", 1).try_cast("double"), F.lit(0.0))
    finite = F.when(F.abs(value) == float("inf"), 0.0).otherwise(value)
    return F.when(F.startswith(kept, F.lit("-")), -finite).otherwise(finite)


def to_iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` of ISO and day-first dates, else the first ten characters; NO_DATE for null or blank.

    Dates stay text and aren't checked against the calendar.
    """
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\A[\s\x{FEFF}]+|[\s\x{FEFF}]+\z", "")
    day_first = r"\A([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})"
    part = lambda i: F.regexp_extract(trimmed, day_first, i)
    return (
        F.when(trimmed == "", NO_DATE)
        .when(trimmed.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.left(trimmed, F.lit(10)))
        .when(trimmed.rlike(day_first), F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")))
        .otherwise(F.left(trimmed, F.lit(10)))
    )


def is_date_text(text: Column) -> Column:
    """Whether the whole text looks like YYYY-MM-DD; a final newline doesn't."""
    return text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")


def mask_number(number: Column) -> Column:
    """Four stars and the last four characters; stars alone for an empty or null number."""
    return F.concat(F.lit("****"), F.coalesce(F.right(number, F.lit(4)), F.lit("")))


def mask_user(user: Column) -> Column:
    """Stars but for the first two and last two characters; all stars up to four."""
    n = F.length(user)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(user, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(user, F.lit(2))))


def is_expired(expires_at: Column, now: Column) -> Column:
    """Whether a time as text isn't after ``now``; false for null and for what is no time."""
    return F.coalesce(F.try_to_timestamp(expires_at) <= now, F.lit(False))


def is_credit(amount: Column) -> Column:
    return amount > 0


# Currencies without smaller units (ISO 4217).
WHOLE_CURRENCIES = ("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "VND", "VUV", "XAF", "XOF", "XPF")


def pad_right(text: Column, width: int) -> Column:
    """Pad with spaces, never cut."""
    return F.when(F.length(text) < width, F.rpad(text, width, " ")).otherwise(text)


def preview(text: Column, width: int = 160) -> Column:
    """The first ``width`` characters, with an ellipsis if there are as many."""
    cut = F.left(text, F.lit(width))
    return F.when(F.length(cut) >= width, F.concat(cut, F.lit("…"))).otherwise(cut)


def number_text(value: Column) -> Column:
    """A double as text, whole numbers without decimals."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def format_money(amount: Column, currency: Column) -> Column:
    """Points for thousands, a decimal comma, halves away from zero, a sign in front.

    Pesos have no decimals and other currencies two, of which those without
    smaller units show only what isn't zero at the end.
    """
    peso = currency == "COP"
    size = F.abs(amount)
    cents = F.format_number(F.round(size, 2), 2)
    text = F.when(peso, F.format_number(F.round(size, 0), 0)).when(currency.isin(*WHOLE_CURRENCIES), F.regexp_replace(cents, r"\.?0+$", "")).otherwise(cents)
    mark = F.when(peso, F.lit("$ ")).otherwise(F.concat(currency, F.lit(" ")))
    return F.concat(F.when(amount < 0, "-").otherwise(""), mark, F.translate(text, ",.", ".,"))


def iso_instant(at: Column) -> Column:
    """A time as ISO text in UTC with milliseconds; the caller gives the time, so that results don't depend on the clock."""
    return F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
