"""Prices in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs and names of currencies, in order of precedence.
CURRENCIES = (("INR", r"₹|\brs\.?|\binr\b|rupee"), ("USD", r"\$|\busd\b|dollar"), ("EUR", r"€|\beur\b|euro"), ("GBP", r"£|\bgbp\b|pound"))


def currency(text: Column, default: str = "INR") -> Column:
    out = F
    for name, pattern in CURRENCIES:
        out = out.when(F.lower(text).rlike(pattern), name)
    return out.otherwise(default)


def price(text: Column) -> Column:
    """The first amount after a currency sign, else the first before one or before '/-', else a bare number below 30000."""
    number = r"([0-9][0-9,]*(?:\.[0-9]{1,2})?)"
    t = F.lower(text)
    marked = F.nullif(F.regexp_extract(t, rf"(?:₹|\$|€|£|\brs\.?|\binr|\busd|\beur|\bgbp)\s*{number}", 1), F.lit(""))
    after = F.nullif(F.regexp_extract(t, rf"{number}\s*(?:/-|₹|\$|€|£|rs\b|inr\b|usd\b|eur\b|euros?\b|gbp\b|pounds?\b|rupees?\b|dollars?\b)", 1), F.lit(""))
    bare = F.nullif(F.regexp_extract(t, rf"^\s*{number}\s*$", 1), F.lit(""))

    def value(c: Column) -> Column:
        return F.regexp_replace(c, ",", "").try_cast("double")

    return F.coalesce(value(marked), value(after), F.when(value(bare) < 30000, value(bare)))
