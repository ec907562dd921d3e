"""Which defects cost most, and where."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultledger.fixed_values import HEATMAP_ROWS, PARETO_RANGE, TOP_DEFECTS
from faultledger.functions.money import as_double
from faultledger.operators.ranking import credit_sum, grouped, incident_count, top


def _checked(n: int) -> int:
    low, high = PARETO_RANGE
    if not low <= n <= high:
        raise ValueError(f"number of defects must be {low} to {high}, not {n}")
    return n


def pareto(incidents: DataFrame, n: int = TOP_DEFECTS) -> DataFrame:
    """The n costliest defects with the running share of *their* total, in percent."""
    leaders = top(
        grouped(incidents, "defect_category").agg(incident_count(), credit_sum()),
        _checked(n),
        "defect_category",
    )
    # At most twenty rows are left here, so one window over all of them is fine.
    ranked = Window.orderBy(F.desc("credit_usd"), "defect_category")
    running = F.sum("credit_usd").over(ranked.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("credit_usd").over(Window.partitionBy())
    return leaders.select(
        "defect_category",
        "incidents",
        as_double(F.col("credit_usd")).alias("credit_usd"),
        (F.try_divide(as_double(running), as_double(total)) * 100).alias("cumulative_pct"),
    ).orderBy(F.desc("credit_usd"), "defect_category")


def heatmap(
    incidents: DataFrame, row: str, n: int = TOP_DEFECTS, rows: int = HEATMAP_ROWS
) -> DataFrame:
    """Long form (row, defect, credit) over the top defects and the top values of ``row``.

    The cells are summed once, and the two rankings and the result all start
    from that aggregate. Spark reuses its shuffle only while the three read the
    same rows, so nothing here may filter by one key: missing keys leave the
    rankings after the limit, and the joins are null-safe, since a plain join
    would first drop missing keys from the scan.
    """
    defect = "defect_category"
    cells = incidents.groupBy(row, defect).agg(credit_sum())

    def leaders(column: str, limit: int) -> DataFrame:
        totals = cells.groupBy(column).agg(F.sum("credit_usd").alias("credit_usd"))
        named = top(totals, limit + 1, column).where(F.col(column).isNotNull())
        # The limits bound both lists, so they can be broadcast.
        return F.broadcast(top(named, limit, column).select(F.col(column).alias("leader")))

    top_defects, top_rows = leaders(defect, _checked(n)), leaders(row, rows)
    return (
        cells.join(top_defects, F.col(defect).eqNullSafe(top_defects["leader"]))
        .join(top_rows, F.col(row).eqNullSafe(top_rows["leader"]))
        .select(row, defect, as_double(F.col("credit_usd")).alias("credit_usd"))
    )


def heatmap_plant_defect(incidents: DataFrame, n: int = TOP_DEFECTS) -> DataFrame:
    return heatmap(incidents, "plant", n)


def heatmap_customer_defect(incidents: DataFrame, n: int = TOP_DEFECTS) -> DataFrame:
    return heatmap(incidents, "customer", n)


def matrix(cells: DataFrame, row: str, defects: Sequence[str] | None = None) -> DataFrame:
    """A long heatmap as a grid with holes filled by 0; at most 10 rows and 20 columns."""
    if defects is None:
        defects = [r[0] for r in cells.select("defect_category").distinct().collect()]
    return (
        cells.groupBy(row)
        .pivot("defect_category", sorted(defects))
        .agg(F.sum("credit_usd"))
        .na.fill(0.0)
        .orderBy(row)
    )
