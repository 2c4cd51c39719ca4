"""Lenient string -> timestamp parsing (per row, over a list of formats)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens.functions.columns import col

# Formats tried after Spark's ISO parsing, month-first before
# day-first, grouped by the shape of the string.
NUMERIC_FORMATS = [
    "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss", "MM-dd-yyyy", "dd.MM.yyyy",
]
NAMED_FORMATS = ["MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy"]
DATE_FORMATS = NUMERIC_FORMATS + NAMED_FORMATS
# cheap anchored shape tests: a formatted parse is only attempted when the
# string can match that family (a failed formatted parse is expensive)
NUMERIC_SHAPE = r"^\d{1,4}[/.\-]\d{1,2}[/.\-]\d{1,4}"
# ISO dates, or a year alone: bare numbers of other lengths and times of day are not dates
ISO_SHAPE = r"^\d{4}(-\d{1,2}|$)"
NAMED_SHAPE = r"^(\d{1,2}\s+)?[A-Za-z]{3,9}\.?\s+(\d{1,2},?\s+)?\d{4}"


def parse_timestamp(c) -> Column:
    """First successful parse of the trimmed string; null when nothing fits."""
    s = F.trim(col(c) if isinstance(c, str) else c)
    numeric = F.when(s.rlike(NUMERIC_SHAPE), F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in NUMERIC_FORMATS]))
    named = F.when(s.rlike(NAMED_SHAPE), F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in NAMED_FORMATS]))
    iso = F.when(s.rlike(ISO_SHAPE), F.try_to_timestamp(s))
    return F.coalesce(iso, numeric, named)
