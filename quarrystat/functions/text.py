"""Text and parameter functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Log masks in the order they are applied, and redactions.
MASKS = (
    ("[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    ("[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+", "<email>"),
    ("0x[0-9a-fA-F]+", "<hex>"),
    ("[0-9]+", "<num>"),
    ("\\s+", " "),
)
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
REDACTIONS = (
    (MASKS[0][0], "<uuid>"),
    ("[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)*\\.[A-Za-z]{2,}", "<email>"),
    (f"(?<![0-9.]){OCTET}(?:[.]{OCTET}){{3}}(?![0-9]|[.][0-9])", "<ip>"),
    ("(?<![0-9])(?:[+][0-9]{1,3}[ .-]?)?(?:[(][0-9]{3}[)] ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])", "<phone>"),
)
#: Digit groups of card numbers: fours with a rest up to 19 digits, or 4-6-5; the check digit decides.
CARD = "(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}|[0-9]{4}(?:[ -]?[0-9]{4}){2}(?:[ -]?[0-9]{1,4}){1,2})(?![0-9])"


def mask(text: Column) -> Column:
    """Log template of a message."""
    for pattern, by in MASKS:
        text = F.regexp_replace(text, pattern, by)
    return F.trim(text)


def redact(text: Column) -> Column:
    """Card numbers with a right check digit, then UUIDs, mail addresses, IPv4 addresses and telephone numbers by their class."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(CARD), F.lit(0)))
    real = F.filter(found, lambda c: F.call_function("luhn_check", F.regexp_replace(c, "[^0-9]", "")))
    text = F.aggregate(real, text, lambda t, c: F.replace(t, c, F.lit("<card>")))
    for pattern, by in REDACTIONS:
        text = F.regexp_replace(text, pattern, by)
    return text


def parse_params(text: Column) -> Column:
    """Array of (key, value) sorted by key and value: pieces between ; or , cut at the first = or else the first :.

    Pieces with neither are dropped; if none is left the whole text is the value of ``raw``; null gives null.
    """
    pieces = F.filter(F.transform(F.split(text, "[;,|]"), F.trim), lambda p: p.rlike("[=:]"))

    def pair(p: Column) -> Column:
        cut = F.when(F.instr(p, "=") > 0, F.instr(p, "=")).otherwise(F.instr(p, ":"))
        return F.struct(F.trim(F.substr(p, F.lit(1), cut - 1)).alias("key"), F.trim(F.substr(p, cut + 1)).alias("value"))

    raw = F.array(F.struct(F.lit("raw").alias("key"), F.trim(text).alias("value")))
    return F.when(text.isNotNull(), F.when(F.size(pieces) > 0, F.array_sort(F.transform(pieces, pair))).otherwise(raw))


def normal_organisation(name: Column) -> Column:
    """Upper case, & as AND, no punctuation, no legal suffix."""
    name = F.regexp_replace(F.upper(F.trim(name)), "&", " AND ")
    name = F.regexp_replace(F.regexp_replace(name, "[^A-Z0-9 ]", " "), "\\s+", " ")
    return F.trim(F.regexp_replace(F.trim(name), "( (INC|LLC|LTD|CORP|CORPORATION|CO|COMPANY|GMBH|PLC))+$", ""))
