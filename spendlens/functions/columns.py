"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from spendlens import domain


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -------------------------------------------------------------------------------------------

def epoch_second(ts="timestamp") -> Column:
    """Whole seconds since the epoch, rounded down."""
    return _col(ts).cast("timestamp").cast("long")


def is_weekend(day_of_week) -> Column:
    """1 on Saturday and Sunday (Spark numbers Sunday 1)."""
    return F.when(_col(day_of_week).isin(1, 7), 1).otherwise(0)


def is_night(hour) -> Column:
    """1 from 22:00 to 06:59."""
    return F.when((_col(hour) >= 22) | (_col(hour) <= 6), 1).otherwise(0)


def as_of_or_now(as_of=None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")


# --- numbers ----------------------------------------------------------------------------------------

def zscore(value, mean, stddev) -> Column:
    """NULL when the deviation is zero or unknown."""
    return F.try_divide(_col(value) - _col(mean), _col(stddev))


#: Amounts are summed in whole units of this many per currency unit, so sums are exact in any order of addition.
UNITS = 1_000_000
#: Amounts from here on, infinite ones and NaN are unknown amounts: like NULL they are in no sum and in no count.
AMOUNT_LIMIT = 1e12
WIDE = "decimal(38,0)"


def usable(amount) -> Column:
    """The amount, or NULL where it is no number that can be summed exactly."""
    return F.when(F.abs(_col(amount)) < AMOUNT_LIMIT, _col(amount))


def units(amount) -> Column:
    return F.round(usable(amount) * UNITS).cast("decimal(20,0)")


def from_units(total) -> Column:
    """The total as the nearest double; one that no double holds in units is divided before it is rounded."""
    whole = _col(total)
    wide = (whole.cast(WIDE) / F.lit(UNITS).cast("decimal(7,0)")).cast("double")
    return F.when(F.abs(whole) < 2 ** 53, whole.cast("double") / UNITS).otherwise(wide)


def deviation_from_units(n, total, squares, rough_squares=None) -> Column:
    """Sample deviation of amounts from their exact sums in units; NULL for fewer than two.

    With m the whole part of the mean, the squared distances from m sum up to ``squares - 2 m total + n m m``, all whole
    numbers, so nothing cancels; what m lacks of the mean is corrected by a small term. Where a sum of squares has more
    than 38 digits, it is NULL, and ``rough_squares``, a sum of doubles, takes its place if given.
    """
    n, total, squares = _col(n).cast("decimal(20,0)"), _col(total).cast(WIDE), _col(squares).cast(WIDE)
    mean = F.try_divide(total.cast("double"), n.cast("double"))
    m = F.floor(mean).try_cast("decimal(20,0)")
    moved = F.try_subtract(squares, F.try_multiply((2 * m).cast(WIDE), total))
    around = F.try_add(moved, F.try_multiply(n, F.try_multiply(m, m))).cast("double")
    rest = F.try_subtract(total, F.try_multiply(n, m)).cast("double")
    distances = around - F.try_divide(rest * rest, n.cast("double"))
    if rough_squares is not None:
        distances = F.coalesce(distances, _col(rough_squares) - n.cast("double") * mean * mean)
    variance = F.try_divide(distances, n.cast("double") - 1)
    return F.when((n >= 2) & variance.isNotNull(), F.sqrt(F.greatest(variance, F.lit(0.0))) / UNITS)


def ratio_or_zero(numerator, denominator) -> Column:
    """0 unless the denominator is positive."""
    d = _col(denominator)
    return F.when(d > 0, _col(numerator) / d).otherwise(F.lit(0.0))


def percent(share, digits: int = 1) -> Column:
    return F.round(_col(share) * 100, digits)


# --- text -------------------------------------------------------------------------------------------

def sanitize(text) -> Column:
    """Escape markup characters; ``&`` stays as it is, NULL becomes an empty string."""
    # Replacement order and entities.
    entities = (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("/", "&#x2F;"))
    out = F.coalesce(_col(text), F.lit(""))
    for char, entity in entities:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def keyword_class(text, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule that has a keyword inside the lower-cased text."""
    lowered = F.lower(_col(text))
    out = F.lit(default)
    for label, words in reversed(list(rules)):
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def document_category(filename, rules=domain.DOCUMENT_CATEGORIES) -> Column:
    return keyword_class(filename, rules, "general")


def advice_route(question, rules=domain.ADVICE_ROUTES) -> Column:
    return keyword_class(question, rules, "general_financial_advisor")


def snippet(content, chars: int = 500) -> Column:
    """Display form of a hit: the leading characters and an ellipsis (always added)."""
    return F.concat(F.substring(_col(content), 1, chars), F.lit("..."))


def token_estimate(text) -> Column:
    """One token per four characters, rounded down."""
    return F.floor(F.length(_col(text)) / 4).cast("long")


def html_to_text(html) -> Column:
    """Visible text of a page: scripts, styles and comments go, tags become blanks, entities are decoded."""
    out = F.regexp_replace(_col(html), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    # The entities of plain HTML.
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


# --- checks -----------------------------------------------------------------------------------------

# Accepted formats.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?[1-9]\d{1,14}$"
BIRTH_DATE = r"^\d{4}-\d{2}-\d{2}$"
CURRENCY = r"^[A-Z]{3}$"
SPECIAL_CHARACTERS = r"""[!@#$%^&*(),.?":{}|<>]"""
OCTET = r"(25[0-5]|2[0-4]\d|[01]?\d?\d)"
IPV4 = rf"^({OCTET}\.){{3}}{OCTET}$"


def is_email(c) -> Column:
    return _col(c).rlike(EMAIL)


def is_phone(c) -> Column:
    return _col(c).rlike(PHONE)


def is_birth_date(c) -> Column:
    return _col(c).rlike(BIRTH_DATE)


def length_between(c, low: int, high: int) -> Column:
    return F.length(_col(c)).between(low, high)


def is_ipv4(c) -> Column:
    return _col(c).rlike(IPV4)


def is_ip_address(c) -> Column:
    """IPv4 without leading zeros, or IPv6 in full, compressed or mixed notation."""
    text = _col(c)
    v4 = is_ipv4(text) & ~text.rlike(r"(^|\.)0\d")
    # A dotted tail stands for two groups; a zone id is not part of the address.
    v6 = F.regexp_replace(F.regexp_replace(text, "%[^%]+$", ""), r"(?<=:)(\d{1,3}\.){3}\d{1,3}$", "0:0")
    group, groups = "[0-9A-Fa-f]{1,4}", F.size(F.filter(F.split(v6, ":"), lambda g: g != ""))
    full = v6.rlike(rf"^({group}:){{7}}{group}$")
    compressed = v6.rlike(rf"^({group}(:{group})*)?::({group}(:{group})*)?$") & (groups <= 7)
    tail_ok = ~text.contains(".") | F.regexp_extract(text, r"([^:]*)$", 1).rlike(IPV4)
    return v4 | ((full | compressed) & tail_ok)


def password_strength(c) -> Column:
    """One flag per rule."""
    text = _col(c)
    return F.struct(
        (F.length(text) >= 8).alias("length"),
        text.rlike("[A-Z]").alias("uppercase"),
        text.rlike("[a-z]").alias("lowercase"),
        text.rlike(r"\d").alias("digit"),
        text.rlike(SPECIAL_CHARACTERS).alias("special"),
    )


# --- payloads ---------------------------------------------------------------------------------------

def payload_matches(columns: Mapping[str, object], payload: str | None = None) -> Column:
    """All criteria must hold; a list matches any of its values.

    ``payload`` names a map column to look the keys up in; otherwise they are column names.
    """
    out = F.lit(True)
    for key, wanted in columns.items():
        value = F.col(payload)[key] if payload else F.col(key)
        out = out & (value.isin(list(wanted)) if isinstance(wanted, (list, tuple)) else value == F.lit(wanted))
    return out


def metadata_without(payload, *keys: str) -> Column:
    return F.map_filter(_col(payload), lambda k, _: ~k.isin(*keys))


def as_json() -> Column:
    return F.to_json(F.struct("*"))
