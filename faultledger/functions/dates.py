from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultledger.functions.text import strip

_TIME = r"(?:\s+\d{1,2}:\d{1,2}(?::\d{1,2})?)?"
# Format -> the shape of the texts that it can fit. Texts of another shape never
# reach the formatter, which is slow to fail. Of the formats that share a shape
# the first that fits counts, so the order decides between month and day.
SHAPES = {
    "yyyy-M-d[ H:m[:s[.SSSSSS]]]": r"^\d{4}-\d{1,2}-\d{1,2}(?:\s|$)",
    "yyyy-M-d'T'H:m[:s[.SSSSSS]]": r"^\d{4}-\d{1,2}-\d{1,2}T",
    "yyyy/M/d[ H:m[:s]]": r"^\d{4}/\d{1,2}/\d{1,2}" + _TIME + "$",
    "yyyyMMdd": r"^\d{8}$",
    "M/d/yyyy[ H:m[:s]]": r"^\d{1,2}/\d{1,2}/\d{4}" + _TIME + "$",
    "M/d/yyyy h:m[:s] a": r"^\d{1,2}/\d{1,2}/\d{4}.*[AaPp][Mm]$",
    "d/M/yyyy[ H:m[:s]]": r"^\d{1,2}/\d{1,2}/\d{4}" + _TIME + "$",
    "d-MMM-yyyy[ H:m[:s]]": r"^\d{1,2}-[A-Za-z]{3}-\d{4}",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{3,} \d{1,2}, \d{4}$",
}
# Tried in order after plain ISO dates; a month first where both readings fit.
DATE_FORMATS = tuple(SHAPES)
# The same with the day first, for sources that write dates so.
DAY_FIRST_FORMATS = tuple(sorted(SHAPES, key=lambda f: f.startswith("M/d/")))

_ISO_DATE = r"(?U)^[\s\x1c-\x1f]*(\d{4}-\d\d-\d\d)[\s\x1c-\x1f]*\z"
# A time's zone or offset: the day is the one that is written, whatever the zone.
_ZONE = r"(?<=\d:\d\d|\d\.\d{1,9})\s*(?:Z|UTC|[+-]\d\d:?\d\d)$"
# Years of two digits at the end of a day: from 69 on they are of the last century.
_SHORT = r"^(\d{1,2}[/-](?:\d{1,2}|[A-Za-z]{3})[/-])"
_CENTURIES = ((_SHORT + r"(69|[7-9]\d)(?!\d)", "$119$2"), (_SHORT + r"(\d\d)(?!\d)", "$120$2"))


def _formatted(text: Column, date_format: str) -> Column:
    day = F.try_to_timestamp(text, F.lit(date_format)).cast("date")
    shape = SHAPES.get(date_format)
    return F.when(text.rlike(shape), day) if shape else day


def parse_date(text: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """The date of a text, or null when no declared format fits.

    Ten bytes with dashes where ISO dates have them take nothing but a cast, and so
    do ISO dates within white space, which is far cheaper than a formatter; a format
    is evaluated only for texts of its shape. The formats share the text by a
    variable: written out for each of them, its expression makes a generated method
    so long that the JVM never compiles it.
    """
    dashes = (F.octet_length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    # The cast takes "2025-1-4 " as well, which is no plain date.
    plain = dashes & F.substring(text, 9, 1).between("0", "9") & F.substring(text, 10, 1).between("0", "9")
    iso = F.coalesce(F.when(plain, text.try_cast("date")), F.regexp_extract(text, _ISO_DATE, 1).try_cast("date"))
    stripped = F.regexp_replace(strip(text), _ZONE, "")
    for short, whole in _CENTURIES:
        stripped = F.regexp_replace(stripped, short, whole)
    days = F.transform(F.array(stripped), lambda written: F.coalesce(*[_formatted(written, f) for f in formats]))
    return F.coalesce(iso, F.when(text.rlike("[0-9]"), F.get(days, F.lit(0))))


# Group on the truncated dates and put the labels on the groups: a date is a
# fixed-width key, and the text is then made once per group, not once per row.


def quarter_start(day: Column) -> Column:
    return F.trunc(day, "quarter")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def week_start(day: Column) -> Column:
    """The Monday on or before the day."""
    return F.date_sub(day, F.weekday(day))


def quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def month_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def day_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
