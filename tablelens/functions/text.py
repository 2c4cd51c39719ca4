"""String helpers shared by cleaning, quality and text operators."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens.functions.columns import col


def _c(x):
    return col(x) if isinstance(x, str) else x


# Of every string that casts to a double (decimal or hexadecimal, infinite or not a number), this matches.
NUMBER_SHAPE = r"^[\x00-\x20]*[+-]?([0-9.][0-9a-fA-FxXpP.+-]*|(?i:nan|inf|infinity))[\x00-\x20]*$"


def parsed_double(c) -> Column:
    """``try_cast`` of a string to a double, tried only where the string looks like a number: a cast that fails costs
    many times the match."""
    return F.when(_c(c).rlike(NUMBER_SHAPE), _c(c).try_cast("double"))


def pytrim(c) -> Column:
    """Strip leading and trailing whitespace (Python ``str.strip``), not only spaces."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def title_case(c) -> Column:
    """Python ``str.title``: each run of letters starts upper-case, the rest lower;
    any non-letter restarts a word (``3-MEDIUM`` -> ``3-Medium``), unlike
    ``initcap`` which only restarts after spaces."""
    runs = F.regexp_extract_all(_c(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    cap = F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30))))
    return F.array_join(cap, "")
