"""Map each extract to the unified schema and stack the sources."""

import logging
from collections import Counter
from collections.abc import Collection, Mapping
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from faultledger.fixed_values import MISSING_TEXT
from faultledger.functions.dates import parse_date
from faultledger.functions.money import to_money, to_quantity
from faultledger.functions.text import as_text, join_levels, strip
from faultledger.operators.cleaning import date_counts, has_valid_date
from faultledger.operators.currency import convert_to_usd
from faultledger.schemas import REJECT, ROW_ORDER, UNIFIED
from faultledger.sources.contracts import Contract, Field
from faultledger.sources.extracts import POSITION, REJECT_LINE, REJECT_REASON, Extract, quoted, rejected
from faultledger.sources.local import small_frame

log = logging.getLogger(__name__)

# Column with the date of a raw row.
_DAY = "_incident_date"


class DateRule:
    """Counts raw rows by their dates, and drops those without a valid one before their other cells are mapped.

    One object is for one run of ``normalize`` and one action on its result.
    """

    def __init__(self) -> None:
        # an observation for each frame, as frames of other headers have other columns
        self.seen: list[Observation] = []

    def __call__(self, rows: DataFrame) -> DataFrame:
        self.seen.append(Observation())
        # The filter stays above the counts, and so above the parsing of dates, of which it would be a copy.
        counted = rows.observe(self.seen[-1], *date_counts(day=_DAY))
        return counted.where(has_valid_date(day=_DAY) | rejected(rows))

    def counts(self) -> dict[str, int]:
        """The ``date_counts`` of all frames, after the action."""
        total = Counter({"total_rows": 0, "dropped_no_date": 0, "dropped_old_date": 0})
        for one in self.seen:
            total.update(one.get)
        return dict(total)


def lookup(headers: Collection[str], field: Field) -> Column:
    """The column of a field; its default only if no such header is there."""
    for header in field.headers:
        if header in headers:
            return quoted(header)
    return F.lit(field.default).cast("string")


def _defect(headers: Collection[str], contract: Contract, strict_nulls: bool) -> Column:
    cells = [lookup(headers, level) for level in contract.defect]
    if len(cells) == 1:
        return strip(as_text(cells[0]))
    if not strict_nulls:
        return join_levels(*[as_text(cell) for cell in cells])
    # A missing level is left out; none at all is a missing cell.
    joined = join_levels(*cells)
    return F.when(joined == "", F.lit(MISSING_TEXT)).otherwise(joined)


def _position(frame: DataFrame, headers: Collection[str], contract: Contract) -> Column | None:
    """Where a row stands in its extract: as it states, else where the scan found it.

    The order within a split comes last, from the scan's own order. It also keeps
    the filters of the cleaning above this projection, which would otherwise be
    pushed below it together with a copy of the date parsing. A stream can't have
    it; its batches add it when they arrive.
    """
    stated = [quoted(h).try_cast("bigint") for h in contract.row_order if h in headers]
    if stated:
        part, at = F.lit(""), F.array(*stated)
    elif POSITION in headers:
        part, at = F.col(f"{POSITION}.part"), F.col(f"{POSITION}.at")
    else:
        return None
    if not frame.isStreaming:
        at = F.concat(at, F.array(F.monotonically_increasing_id()))
    return F.struct(part.alias("part"), at.alias("at"))


def to_unified(
    extract: Extract, contract: Contract, run_id: str, strict_nulls: bool = False, dates: DateRule | None = None
) -> DataFrame:
    """One projection per source and header; rows are dropped only where the contract or ``dates`` says so.

    Rows that do not fit come along, without a date, with the reason and their line.
    """
    parts = [_to_unified(frame, extract.file, contract, run_id, strict_nulls, dates) for frame in extract.frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _to_unified(
    frame: DataFrame,
    file: str | Column,
    contract: Contract,
    run_id: str,
    strict_nulls: bool,
    dates: DateRule | None,
) -> DataFrame:
    headers = frozenset(frame.columns)
    day = lookup(headers, contract.date)
    if contract.requires_date:
        frame = frame.where(day.isNotNull() | rejected(frame))
    incident_date = parse_date(day, contract.date_formats)
    marks = []
    if REJECT_LINE in headers:
        incident_date = F.when(~rejected(frame), incident_date)
        marks = [F.col(c).alias(field.name) for c, field in zip((REJECT_REASON, REJECT_LINE), REJECT, strict=True)]
    if dates is not None:
        frame = dates(frame.withColumn(_DAY, incident_date))
        incident_date = F.col(_DAY)
    file = F.lit(file) if isinstance(file, str) else file
    position = _position(frame, headers, contract)
    return frame.select(
        F.lit(contract.label).alias("source"),
        strip(as_text(lookup(headers, contract.plant))).alias("plant"),
        strip(as_text(lookup(headers, contract.customer))).alias("customer"),
        incident_date.alias("incident_date"),
        _defect(headers, contract, strict_nulls).alias("defect_category"),
        to_money(lookup(headers, contract.credit)).alias("credit_requested_usd"),
        to_quantity(lookup(headers, contract.quantity)).alias("qty_affected"),
        file.alias("raw_source_file"),
        F.lit(run_id).alias("pipeline_run_id"),
        *([position.cast(ROW_ORDER.dataType).alias(ROW_ORDER.name)] if position is not None else []),
        *marks,
    )


def normalize(
    spark: SparkSession,
    extracts: Mapping[str, Extract],
    run_id: str,
    contracts: Mapping[str, Contract],
    fx_rates: Mapping[str, Decimal] | None = None,
    strict_nulls: bool = False,
    keep_rejected: bool = False,
    dates: DateRule | None = None,
) -> DataFrame:
    """All sources in one frame, with credits in US dollars.

    Rows that do not fit are left out, or with ``keep_rejected`` marked in two columns more.
    With ``dates`` rows without a valid date are counted and left out as well.

    Sources without a contract, and sources that cannot be mapped, are left out
    with a message in the log.
    """
    parts = []
    for key, extract in extracts.items():
        if key not in contracts:
            log.warning("no contract for source %s, left out", key)
            continue
        observed = len(dates.seen) if dates is not None else 0
        try:
            parts.append(to_unified(extract, contracts[key], run_id, strict_nulls, dates))
        except Exception as error:  # noqa: BLE001 - one source must not stop the others
            log.error("cannot map %s: %s", key, error)
            if dates is not None:
                # nothing will be observed there
                del dates.seen[observed:]
    if not parts:
        return small_frame(spark, [], UNIFIED)
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    reason, line = (field.name for field in REJECT)
    if line in stacked.columns and not keep_rejected:
        stacked = stacked.where(F.col(line).isNull()).drop(reason, line)
    return convert_to_usd(spark, stacked, fx_rates) if fx_rates else stacked
