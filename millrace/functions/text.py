"""Text rules as column expressions: case, regular expressions and masking of personal data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: patterns of personal data and the text that replaces a match
PII_PATTERNS = {
    "email": (r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", "[REDACTED_EMAIL]"),
    "phone": (r"\+?[\d\s\-\(\)]{7,}\b", "[REDACTED_PHONE]"),
    "ssn": (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    "credit_card": (r"\b(?:\d{4}[ -]?){3}\d{4}\b", "[REDACTED_CARD]"),
}
PII_ORDER = ("email", "phone", "ssn", "credit_card")
# masks the narrow patterns before the phone pattern can take their digits
PII_SPECIFIC_FIRST = ("email", "ssn", "credit_card", "phone")

_SPACE = r"^\s+|\s+$"
# digits, spaces and word edges of every script, not only of ASCII
_UNICODE = "(?U)"


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, _SPACE, "")


def change_case(text: Column, option: str) -> Column:
    if option == "lowercase":
        return strip(F.lower(text))
    if option == "uppercase":
        return strip(F.upper(text))
    if option == "titlecase":
        return F.initcap(strip(text))
    if option == "trim":
        return strip(text)
    return text


def java_replacement(replacement: str) -> str:
    r"""Group references as ``\1`` become ``$1``; a literal dollar stays literal."""
    out, i = [], 0
    while i < len(replacement):
        mark = replacement[i]
        if mark == "\\" and replacement[i + 1 : i + 2].isdigit():
            out.append("$" + replacement[i + 1])
            i += 2
            continue
        out.append("\\$" if mark == "$" else mark)
        i += 1
    return "".join(out)


def replace_pattern(text: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(text, pattern, java_replacement(replacement))


def mask_personal_data(
    text: Column, entities: Sequence[str] = ("email", "phone"), order: Sequence[str] = PII_ORDER
) -> Column:
    def mask(masked: Column, entity: str) -> Column:
        pattern, label = PII_PATTERNS[entity]
        found = F.regexp_replace(masked, _UNICODE + pattern, label)
        # the mail pattern is slow on long texts, and no text without an @ can match it
        return F.when(text.contains("@"), found).otherwise(masked) if entity == "email" else found

    return reduce(mask, [e for e in order if e in entities], text)
