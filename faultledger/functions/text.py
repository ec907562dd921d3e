from pyspark.sql import Column
from pyspark.sql import functions as F

from faultledger.fixed_values import MISSING_TEXT, UNKNOWN, WHITESPACE


# These expressions name their argument once. Spark merges nested projections
# and pushes filters by copying expressions, so an argument that is named twice
# is computed twice at every level.


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends; ``trim`` alone leaves tabs and NBSP."""
    return F.btrim(text, F.lit(WHITESPACE))


def as_text(value: Column) -> Column:
    """The cell as text, with the word that stands for a missing cell."""
    return F.coalesce(value, F.lit(MISSING_TEXT))


def join_levels(*levels: Column) -> Column:
    """``a - b`` without dashes or spaces left over at the ends."""
    return F.btrim(F.concat_ws(" - ", *levels), F.lit(" -"))


def clean_label(text: Column) -> Column:
    """A stripped label; missing, blank, or the missing-cell text gives ``Unknown``."""
    no_label = rf"^(?:{MISSING_TEXT})?\z"
    return F.regexp_replace(strip(F.coalesce(text, F.lit(UNKNOWN))), no_label, UNKNOWN)


def joined_set(values: Column) -> Column:
    """Aggregate: sorted distinct values as one text. For small sets such as sources."""
    return F.array_join(F.array_sort(F.collect_set(values)), ", ")


def currency_text(amount: Column, places: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, places))
