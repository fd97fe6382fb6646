"""Personal data (operator 4): patterns propose spans, checksums confirm them, words nearby adjust their score.

The base kinds always stay: e-mail addresses, IPv4 addresses, card numbers that pass Luhn, and international phone
numbers. Bank account numbers of their country's length whose check digits are right (mod 97), and social security numbers
that are not part of a longer number, are added where pattern, checksum and the words before them score at least
``THRESHOLD``. All of it is column expressions.

NULL and empty texts have no spans, an empty table gives an empty result, texts of any length are scanned whole; masking
keeps NULL texts NULL. Rows without a ``doc_id`` and repeated rows are
treated like all others; further columns are ignored, or kept as they are by ``masked_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm import spans
from spendlens.llm.common import columns

KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
THRESHOLD = 0.5
NEAR = 40

# Base patterns (fixed values), written so that they scan in linear time: possessive repeats, and a start inside a run
# of the same characters only where a match has just ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Lengths of account numbers by country (fixed values of the public registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def account_pattern() -> str:
    """Account numbers of each country's length, in groups of four with or without blanks."""
    by_length: dict[int, list[str]] = {}
    for country, length in IBAN_LENGTHS.items():
        by_length.setdefault(length, []).append(country)
    kinds = []
    for length, countries in sorted(by_length.items()):
        groups, rest = divmod(length - 4, 4)
        kinds.append(f"(?:{'|'.join(countries)})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{groups}}}" + (f"\\x20?[A-Z0-9]{{{rest}}}" if rest else ""))
    return f"(?:{'|'.join(kinds)})"


IBAN = account_pattern()
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
OCTETS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
#: What a pattern alone is worth, and the words before a span that support it.
PROPOSED = [0.8, 0.5, 0.3, 0.5, 0.2, 0.3]
CHECKED = [0.0, 0.2, 0.5, 0.2, 0.5, 0.0]
SUPPORT = 0.2
WORDS = [r"e-?mail|contact|write|mailto", r"(^|[^a-z])ip([^a-z]|$)|host|server|address", r"card|visa|credit|payment|amex",
         r"phone|tel|call|mobile|fax", r"iban|account|bank|konto", r"ssn|social"]


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits, every second from the right doubled, sum to a multiple of ten."""
    def share(i: Column) -> Column:
        d = F.substring(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + share(i)) % 10 == 0


def mod_97(value: Column) -> Column:
    """Whether an account number's check digits are right."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: F.when(c == "", r).when(
        c.between("0", "9"), (10 * r + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise(
        (100 * r + F.ascii(c) - 55) % 97)) == 1


def base_spans(text: Column) -> Column:
    """The base spans by start, then kind."""
    email = spans.matches(text, EMAIL, 0, text.contains("@"))
    ip = F.filter(spans.matches(text, IP, 1), lambda s: s["value"].rlike(OCTETS))
    card = F.filter(spans.matches(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")), lambda s: spans.let(
        digits(s["value"]), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))))
    phone = F.filter(spans.matches(text, PHONE, 3, text.contains("+")),
                     lambda s: F.length(digits(s["value"])).between(9, 15))
    return F.sort_array(F.concat(email, ip, card, phone))


def added_spans(text: Column) -> Column:
    iban = F.filter(spans.matches(text, "(?=[A-Z]{2}[0-9]{2})" + IBAN, 4), lambda s: mod_97(s["value"]))

    def alone(s: Column) -> Column:
        """Not part of a longer number."""
        before = F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1))).otherwise("")
        return ~F.concat(before, F.substring(text, s["end"] + 1, F.lit(1))).rlike("[0-9-]")

    return F.concat(iban, F.filter(spans.matches(text, SSN, 5), alone))


def score(text: Column, span: Column) -> Column:
    """Proposal, confirmation and support by the words in the 40 characters before the span, at most 1."""
    before = F.lower(F.substring(text, F.greatest(span["start"] - NEAR, F.lit(0)) + 1, F.least(span["start"], F.lit(NEAR))))
    supported = F.lit(False)
    for kind, words in enumerate(WORDS):
        supported = F.when(span["kind"] == kind, before.rlike(words)).otherwise(supported)
    worth = F.array(*[F.lit(p + c) for p, c in zip(PROPOSED, CHECKED)])
    return F.round(F.least(F.lit(1.0), F.get(worth, span["kind"]) + F.when(supported, SUPPORT).otherwise(0.0)), 2)


def found(documents: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` of each document with its base spans and all spans."""
    source = columns(documents, *dict.fromkeys([*kept, "text"])).select(
        *kept, F.coalesce("text", F.lit("")).alias("content"))
    based = source.select("*", base_spans(F.col("content")).alias("base"), added_spans(F.col("content")).alias("more"))
    good = F.filter("more", lambda s: score(F.col("content"), s) >= THRESHOLD)
    return based.select(*kept, "content", "base", F.sort_array(F.concat(F.col("base"), good)).alias("all"))


def personal_data(documents: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, all spans and their scores for each document."""
    rows = found(documents, "doc_id")
    counts = [spans.count(F.col("base"), k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    scores = F.array_join(F.transform("all", lambda s: score(F.col("content"), s).cast("string")), ",")
    return rows.select("doc_id", *counts, F.sha2(spans.written(F.col("base"), KINDS), 256).alias("base_sha256"),
                       spans.written(F.col("all"), KINDS).alias("spans"), scores.alias("scores"))


def masked_documents(documents: DataFrame, *kept: str) -> DataFrame:
    """``kept`` columns of the documents, in which each span of ``text`` is replaced by its kind in brackets."""
    rows = found(documents, *kept)
    clean = F.when(F.col("text").isNotNull(), spans.masked(F.col("content"), F.col("all"), KINDS))
    return rows.select(*[clean.alias(c) if c == "text" else F.col(f"`{c}`") for c in kept])
