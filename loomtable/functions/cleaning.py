"""Cleaning and standardization of text values.

Every function takes and returns a ``Column``, works under the default ANSI mode
(bad input becomes null, never an error) and stays inside Spark's built-ins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted spellings and their canonical forms.
CURRENCY_SIGNS = "$€£"
BLANKS = " \t\n\x0b\f\r"
NULL_WORDS = ("", "NULL", "N/A", "NA", "NONE", "NAN")
TRUE_WORDS = ("true", "yes", "y", "1")
FALSE_WORDS = ("false", "no", "n", "0")
EMAIL_FORMAT = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"
PRODUCT_ID_FORMAT = r"^P\d{4}$"
COUNTRIES = {
    "USA": ("US", "USA", "UNITEDSTATES", "UNITEDSTATESOFAMERICA"),
    "CANADA": ("CANADA",),
    "MEXICO": ("MEXICO",),
}
STATES = {
    "MN": ("MINNESOTA", "MN"),
    "WI": ("WISCONSIN", "WI"),
    "ON": ("ONTARIO", "ON"),
}
PAYMENTS = {
    "Credit Card": ("creditcard", "visa", "mastercard"),
    "Debit Card": ("debit", "debitcard"),
    "PayPal": ("paypal",),
    "Apple Pay": ("applepay",),
    "Google Pay": ("googlepay",),
    "Cash": ("cash",),
}
CUSTOMER_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy")
PRODUCT_DATES = ("yyyy-MM-dd", "yyyy/MM/dd")
ORDER_DATES = ("yyyy-MM-dd", "yyyy/MM/dd", "MM-dd-yyyy")
MAX_LOYALTY = 100_000
UNKNOWN = "Unknown"


def canonical(key: Column, spellings: dict[str, tuple[str, ...]], default: Column) -> Column:
    """Replace a known spelling by its canonical form, anything else by ``default``.

    One map lookup, so the key is computed once however many spellings there are.
    """
    pairs = [F.lit(v) for name, known in spellings.items() for word in known for v in (word, name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def keep_if(value: Column, condition: Column) -> Column:
    """The value where the condition holds, else null."""
    return F.when(condition, value)


def clean_text(text: Column) -> Column:
    """Trim, and turn null-like words into null, in whichever case they are written.

    The words are searched in a constant array: unlike a list of comparisons this is a
    short loop in the generated code, which keeps tables of many text columns compilable.
    """
    trimmed = F.trim(text)
    null_words = F.array(*[F.lit(word) for word in NULL_WORDS])
    return keep_if(trimmed, ~F.array_contains(null_words, F.upper(trimmed)))


def amount_text(text: Column) -> Column:
    """Cleaned amount without currency signs and blanks."""
    return F.translate(clean_text(text), CURRENCY_SIGNS + BLANKS, "")


# ``to_*`` work on text that is clean already. Jobs clean all columns in one projection
# and convert in the next, so that no clean value is computed more than once.


def to_int(value: Column) -> Column:
    """Integer value; a fractional part is cut off (``12.7`` is 12), other text is null."""
    whole = F.regexp_extract(value, r"^([+-]?\d+)\.\d*$", 1).try_cast("int")
    return F.coalesce(value.try_cast("int"), keep_if(whole, F.contains(value, F.lit("."))))


def to_long(value: Column) -> Column:
    """64-bit id by the rule of :func:`to_int`."""
    whole = F.regexp_extract(value, r"^([+-]?\d+)\.\d*$", 1).try_cast("long")
    return F.coalesce(value.try_cast("long"), keep_if(whole, F.contains(value, F.lit("."))))


def strict_long(text: Column) -> Column:
    """64-bit id as it stands. Text that is no whole number is null; a whole number beyond 64 bits is an error, since
    as a null it would meet every other such id."""
    value = text.try_cast("long")
    too_large = value.isNull() & text.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.when(too_large, F.raise_error(F.concat(F.lit("id beyond 64 bits: "), text))).otherwise(value)


def to_decimal(amount: Column, precision: int = 12, scale: int = 2) -> Column:
    """Number from an amount text.

    A comma is the decimal separator when the text has no point, otherwise it groups
    thousands. ``1,234`` is therefore 1.23 and ``1,234,567`` is null.
    """
    decimal_comma = F.contains(amount, F.lit(",")) & ~F.contains(amount, F.lit("."))
    plain = F.translate(amount, ",", ".")
    grouped = F.translate(amount, ",", "")
    return F.when(decimal_comma, plain).otherwise(grouped).try_cast(f"decimal({precision},{scale})")


def to_date(value: Column, formats: tuple[str, ...]) -> Column:
    """Date by the first format that fits.

    Formats are made of ``yyyy``, ``MM``, ``dd`` and separators. A value is only parsed by
    a format of its own shape: a failed parse costs many times a shape test.
    """
    return F.coalesce(*[
        F.try_to_date(keep_if(value, value.rlike(f"^{re.sub('[yMd]', '[0-9]', fmt)}$")), fmt)
        for fmt in formats
    ])


def to_boolean(value: Column) -> Column:
    meaning = {word: flag for flag, known in ((True, TRUE_WORDS), (False, FALSE_WORDS)) for word in known}
    pairs = [F.lit(v) for pair in meaning.items() for v in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(value))


def to_email(value: Column) -> Column:
    return keep_if(F.lower(value), F.lower(value).rlike(EMAIL_FORMAT))


def to_phone(value: Column) -> Column:
    """Ten-digit number as ``ddd-ddd-dddd``; a leading country digit 1 is dropped."""
    digits = F.regexp_replace(value, r"\D", "")
    parts = r"^1?(\d{3})(\d{3})(\d{4})$"
    return keep_if(F.regexp_replace(digits, parts, "$1-$2-$3"), digits.rlike(parts))


def to_country(value: Column) -> Column:
    letters = F.upper(F.regexp_replace(value, "[^A-Za-z]", ""))
    return canonical(letters, COUNTRIES, F.upper(value))


def to_state(value: Column) -> Column:
    return canonical(F.upper(value), STATES, F.upper(value))


def to_name(value: Column) -> Column:
    """Capitalize each word."""
    return F.initcap(F.lower(value))


def to_brand(value: Column) -> Column:
    """Brand as written, except for the one that is always upper case."""
    return F.when(F.upper(value) == "IKEA", "IKEA").otherwise(value)


def to_payment(value: Column) -> Column:
    """Canonical payment method; missing is ``Unknown``, others are capitalized."""
    key = F.lower(F.translate(value, BLANKS, ""))
    return F.coalesce(canonical(key, PAYMENTS, F.initcap(value)), F.lit(UNKNOWN))


def to_status(value: Column) -> Column:
    return F.coalesce(to_name(value), F.lit(UNKNOWN))


def limit_loyalty(points: Column) -> Column:
    """Negative points become zero, impossibly many become null."""
    return keep_if(F.greatest(points, F.lit(0)), points <= MAX_LOYALTY)


def or_no_discount(pct: Column) -> Column:
    """A missing or unreadable discount means none was given."""
    return F.coalesce(pct, F.lit(0).cast("decimal(5,2)"))


def valid_product_id(product_id: Column, pattern: str = PRODUCT_ID_FORMAT) -> Column:
    return product_id.rlike(pattern)


# ``parse_*`` take raw text: clean it, then convert.


def parse_int(text: Column) -> Column:
    return to_int(clean_text(text))


def parse_id(text: Column) -> Column:
    return to_long(clean_text(text))


def parse_decimal(text: Column, precision: int = 12, scale: int = 2) -> Column:
    return to_decimal(amount_text(text), precision, scale)


def parse_date(text: Column, formats: tuple[str, ...]) -> Column:
    return to_date(clean_text(text), formats)


def parse_boolean(text: Column) -> Column:
    return to_boolean(clean_text(text))


def parse_email(text: Column) -> Column:
    return to_email(clean_text(text))


def parse_phone(text: Column) -> Column:
    return to_phone(clean_text(text))


def parse_country(text: Column) -> Column:
    return to_country(clean_text(text))


def parse_state(text: Column) -> Column:
    return to_state(clean_text(text))


def parse_name(text: Column) -> Column:
    return to_name(clean_text(text))


def parse_brand(text: Column) -> Column:
    return to_brand(clean_text(text))


def parse_payment(text: Column) -> Column:
    return to_payment(clean_text(text))


def parse_status(text: Column) -> Column:
    return to_status(clean_text(text))


def parse_loyalty(text: Column) -> Column:
    return limit_loyalty(parse_int(text))


def parse_discount(text: Column) -> Column:
    return or_no_discount(parse_decimal(text, 5, 2))


def parse_product_id(text: Column) -> Column:
    return F.upper(clean_text(text))


def positive(value: Column) -> Column:
    return keep_if(value, value > 0)


def not_negative(value: Column) -> Column:
    return keep_if(value, value >= 0)


def at_least_zero(value: Column) -> Column:
    """Negative becomes zero; null stays null."""
    return F.when(value < 0, 0).otherwise(value)


def order_total(quantity: Column, price: Column, discount_pct: Column) -> Column:
    """Quantity times price less discount, rounded to cents."""
    return F.round(quantity * price * (1 - discount_pct / 100), 2).cast("decimal(14,2)")
