"""The same queries as SQL over the given tables.

Written from the specification in FIXTURES.md, for another engine to run.
"""

_EXTRACTS = """
base as (
  select l_orderkey ok, l_linenumber ln, n_name plant, c_name cust,
    cast(cast(l_shipdate as date) as string) d, p_type t, p_brand b,
    cast(cast(cast(l_extendedprice as decimal(12,2)) * cast(l_discount as decimal(4,2))
      as decimal(14,2)) as string) credit,
    cast(cast(l_quantity as int) as string) qty, l_returnflag rf, l_linestatus ls
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
    join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
    join part on l_partkey = p_partkey),
dirty0 as (
  select ok, ln, rf, ls, b,
    case when ok % 31 = 0 then concat('  ', plant, ' ') when ok % 37 = 0 then null else plant end plant,
    case when ok % 43 = 0 then '   ' else cust end cust,
    case when ok % 89 = 0 then null when ok % 101 = 0 then '1900-01-01'
      when ok % 103 = 0 then 'junk' else d end d,
    case when ok % 41 = 0 then null else t end t,
    case when ok % 83 = 0 then '1,500' when ok % 79 = 0 then concat('-', credit)
      when ok % 73 = 0 then null else credit end credit,
    case when ok % 71 = 0 then null else qty end qty, 'f1' file
  from base),
dirty as (
  select * from dirty0
  union all
  select ok, ln, rf, ls, b, plant, cust, d, t, credit, '999' qty, 'f2' file
  from dirty0 where ok % 7 = 0),
uni as (
  select 'radius' source, coalesce(plant, 'nan') plant, cust, d, coalesce(t, 'nan') defect,
    credit, qty, file, ok, ln, 1 pr
  from dirty where rf = 'R' and d is not null and ok % 97 <> 0
  union all
  select 'fusion', 'FUSION PLANT', cust, d, coalesce(t, 'nan'), credit, qty, file, ok, ln, 2
  from dirty where rf = 'A' and ls = 'F'
  union all
  select 'vision_a', coalesce(plant, 'nan'), cust, d,
    concat(coalesce(t, 'nan'), ' - ', case when ok % 47 = 0 then 'nan' else b end),
    credit, qty, file, ok, ln, 3
  from dirty where rf = 'A' and ls = 'O'
  union all
  select 'vision_b', 'VISION B PLANT', cust, d, coalesce(t, 'nan'), credit, qty, file, ok, ln, 4
  from dirty where rf = 'N' and ls = 'F'
  union all
  select 'obi', coalesce(plant, 'nan'), cust, d, concat(coalesce(t, 'nan'), ' - ', b),
    credit, qty, file, ok, ln, 5
  from dirty where rf = 'N' and ls = 'O'),
fx as (
  select source, trim(plant) plant, trim(cust) customer, try_cast(d as date) incident_date,
    trim(defect) defect_category,
    cast(try_cast(credit as decimal(18,6)) * case trim(plant)
      when 'NATION_5' then cast(0.05 as decimal(9,4)) when 'NATION_6' then cast(0.05 as decimal(9,4))
      when 'NATION_7' then cast(0.74 as decimal(9,4)) else cast(1 as decimal(9,4)) end
      as decimal(18,6)) credit,
    try_cast(qty as double) qty, file, ok, ln, pr
  from uni),
inc as (
  select source, case when plant in ('nan', '') then 'Unknown' else plant end plant,
    case when customer in ('nan', '') then 'Unknown' else customer end customer,
    incident_date,
    case when defect_category in ('nan', '') then 'Unknown' else defect_category end defect_category,
    case when credit is null or credit < 0 then cast(0 as decimal(18,6)) else credit end credit,
    coalesce(qty, 0) qty, file, ok, ln, pr
  from fx where incident_date is not null and year(incident_date) >= 2000)"""

_KEY = "source, plant, customer, incident_date, defect_category, round(credit, 2)"
_FACT = f"""
fact as (
  select * from (
    select *, row_number() over (
      partition by {_KEY} order by pr, file, ok, ln, credit, qty) rn
    from inc) t
  where rn = 1)"""

_ROW = """source, plant, customer, cast(incident_date as string) incident_date, defect_category,
  cast(credit as double) credit_requested_usd, qty qty_affected, file raw_source_file"""
_SUM = "cast(sum(credit) as double) credit_usd"
_MONTH = "strftime(incident_date, '%Y-%m')"
_QUARTER = "concat(cast(year(incident_date) as string), 'Q', cast(quarter(incident_date) as string))"
_WEEK = "strftime(date_trunc('week', incident_date), '%Y-%m-%d')"


# The extracts with the plain credits times a billion.
_LARGE = _EXTRACTS.replace("decimal(18,6)", "decimal(28,6)").replace(
    "try_cast(credit as",
    "try_cast(coalesce(cast(try_cast(credit as decimal(14,2)) * 1000000000 as string), credit) as",
)
# HTML cells lose the separators of thousands.
_FROM_FILES = _EXTRACTS.replace(
    "concat(coalesce(t, 'nan'), ' - ', b),\n    credit, qty",
    "concat(coalesce(t, 'nan'), ' - ', b),\n    replace(credit, ',', ''), qty",
)
# A part of one extract has no plants, and HTML cells lose the separators of thousands.
_PARTS = _FROM_FILES.replace(
    "select 'vision_a', coalesce(plant, 'nan')",
    "select 'vision_a', case when ok % 3 = 2 then 'OAK CREEK PLANT' else coalesce(plant, 'nan') end",
)
# What all orders add to those with an even key.
_SECOND = """from fact f where not exists (
  select 1 from inc i where i.ok % 2 = 0 and i.source = f.source and i.plant = f.plant
    and i.customer = f.customer and i.incident_date = f.incident_date
    and i.defect_category = f.defect_category and round(i.credit, 2) = round(f.credit, 2))"""


def _on_extracts(sql: str, *more: str) -> str:
    return "with " + ",".join([_EXTRACTS, *more]) + "\n" + sql


def _on_facts(sql: str, *more: str) -> str:
    return _on_extracts(sql, _FACT, *more)


def _ranked(columns: str, n: int, count: str = "count(*) incidents, ") -> str:
    return _on_facts(
        f"select {columns}, {count}{_SUM} from fact group by {columns} "
        f"order by sum(credit) desc, {columns} limit {n}"
    )


def _tier(total: str, high: int = 100_000, medium: int = 30_000) -> str:
    return f"case when {total} >= {high} then 'High' when {total} >= {medium} then 'Medium' else 'Low' end"


def _recent(day: str) -> str:
    return (
        f"select customer, sum(credit) total from fact "
        f"where incident_date >= date '{day}' - interval 90 day group by customer"
    )


def _heatmap(row: str) -> str:
    def top(column):
        return f"select {column} from fact group by {column} order by sum(credit) desc, {column} limit 10"

    return _on_facts(
        f"select {row}, defect_category, {_SUM} from fact "
        f"where defect_category in ({top('defect_category')}) and {row} in ({top(row)}) "
        f"group by {row}, defect_category"
    )


def _pareto(n: int) -> str:
    return _on_facts(
        """select defect_category, incidents, cast(total as double) credit_usd,
  cast(sum(total) over (order by total desc, defect_category
    rows between unbounded preceding and current row) as double)
  / cast(sum(total) over () as double) * 100 cumulative_pct
from lead_defects""",
        f"""
lead_defects as (
  select defect_category, count(*) incidents, sum(credit) total from fact
  group by defect_category order by sum(credit) desc, defect_category limit {n})""",
    )


_CARD = """
by_defect as (
  select customer, defect_category, row_number() over (
    partition by customer order by count(*) desc, defect_category) place
  from fact group by customer, defect_category),
totals as (
  select customer, count(*) incidents, sum(credit) total, max(credit) largest,
    string_agg(distinct source, ', ' order by source) sources, count(distinct plant) plants
  from fact group by customer),
card as (
  select t.customer, incidents, cast(total as double) credit_usd,
    cast(total as double) / incidents avg_credit_usd, cast(largest as double) max_credit_usd,
    d.defect_category top_defect, sources, plants,
    """ + _tier("total") + """ risk_tier
  from totals t join by_defect d on t.customer = d.customer and d.place = 1)"""

_CHOSEN = "plant in ('NATION_1', 'NATION_7', 'FUSION PLANT') and credit >= 500"
_DETAIL = (
    "cast(incident_date as string) incident_date, source, plant, customer, defect_category, "
    "cast(credit as double) credit_requested_usd"
)
_SUMMARY = (
    f"count(*) incidents, coalesce({_SUM.replace(' credit_usd', '')}, 0) credit_usd, "
    "coalesce(cast(sum(credit) as double) / count(*), 0) avg_credit_usd"
)
_SOURCE_LIST = "(select string_agg(source, ', ' order by source) from (select distinct source from fact) s)"


def _leader(column: str) -> str:
    return f"(select {column} from fact group by {column} order by sum(credit) desc, {column} limit 1)"


def _sum_of(source: str) -> str:
    return f"cast(coalesce(sum(case when source = '{source}' then credit end), 0) as double) {source}"


def _report_part(name: str, item: str, keys: str, n: int | None = None) -> str:
    limit = f" order by sum(credit) desc, {keys} limit {n}" if n else ""
    return (
        f"select * from (select '{name}' report_table, {item} item, {_SUM} "
        f"from fact group by {keys}{limit}) {name}"
    )


_EVENT_WEEKS = """select strftime(date_trunc('week', ts), '%Y-%m-%d') week_start, count(*) incidents,
  cast(sum(cast("value" as decimal(18,6))) as double) credit_usd from events group by 1"""

_REPORT_TOTALS = " union all ".join(
    [
        _report_part("by_source", "source", "source"),
        _report_part("by_plant", "plant", "plant"),
        _report_part("by_defect", "defect_category", "defect_category", 15),
        _report_part("by_customer", "customer", "customer", 20),
        _report_part("customer_plant", "concat(customer, '|', plant)", "customer, plant", 15),
        _report_part("plant_defect", "concat(plant, '|', defect_category)", "plant, defect_category", 15),
    ]
)

_REPORT_REST = f"""select 'summary' report_table, concat('run-1|$', format('{{:,.2f}}', cast(sum(credit) as double)), '|',
    string_agg(distinct source, ', ' order by source)) item, cast(count(*) as double) "value" from fact
union all select 'summary', 'plants', count(distinct plant) from fact
union all select 'summary', 'customers', count(distinct customer) from fact
union all select 'quarter_pivot', concat(q.name, '|', s.source), coalesce(t.credit_usd, 0)
  from (select distinct {_QUARTER} as name from fact) q cross join (select distinct source from fact) s
  left join (select {_QUARTER} as name, source, {_SUM} from fact group by 1, 2) t
    on t.name = q.name and t.source = s.source
union all select 'source_span', concat(source, '|', min(incident_date), '|', max(incident_date)), 0
  from fact group by source
union all select 'raw', concat(source, '|', incident_date), cast(sum(credit) as double)
  from fact group by source, incident_date"""


ORACLES = {
    "raw_by_source": _on_extracts("select source, count(*) incidents from uni group by source"),
    "normalized": _on_extracts(f"select {_ROW} from fx"),
    "cleaned": _on_extracts(f"select {_ROW} from inc"),
    "validation_counts": _on_extracts(
        """select count(*) total_rows,
  count(*) filter (where incident_date is null) dropped_no_date,
  count(*) filter (where year(incident_date) < 2000) dropped_old_date,
  count(*) filter (where year(incident_date) >= 2000 and credit < 0) clipped_credit,
  count(*) filter (where year(incident_date) >= 2000 and credit is null) filled_credit,
  cast(0 as bigint) oversized_credit,
  count(*) filter (where year(incident_date) >= 2000 and qty is null) filled_quantity,
  count(*) filter (where year(incident_date) >= 2000) kept_rows
from fx"""
    ),
    "fx_by_plant": _on_extracts(f"select plant, count(*) incidents, {_SUM} from fx group by plant"),
    "dedup_first_wins": _on_facts(f"select {_ROW} from fact"),
    "upsert_second_batch": _on_facts(f"select {_ROW} {_SECOND}"),
    "stream_rewritten": _on_facts(f"select {_ROW.replace(', file raw_source_file', '')} {_SECOND}"),
    "load_history": _on_facts(
        """select run_id, 'SUCCESS' status, total_rows,
  'Radius,Fusion,Vision_OAK,Vision_MAS,OBI' sources_loaded
from (select 'first' run_id, count(*) total_rows from fact
  union all select 'again', cast(0 as bigint)) t"""
    ),
    "landed_formats": _on_extracts(f"select {_ROW.replace(', file raw_source_file', '')} from fx"),
    "large_amounts": f"""with {_LARGE}
select customer, count(*) incidents, cast(sum(credit) as double) credit_usd,
  cast(max(credit) as double) largest_usd, count(*) filter (where credit >= 5000000000000) alerts,
  {_tier("sum(credit)", 100_000_000_000_000, 30_000_000_000_000)} risk_tier
from inc group by customer""",
    "date_forms": "select l_orderkey, l_linenumber, cast(cast(l_shipdate as date) as string) \"day\" from lineitem",
    "run_from_files": f"with {_FROM_FILES},{_FACT}\nselect {_ROW.replace(', file raw_source_file', '')} from fact",
    "part_files": f"with {_PARTS}\nselect {_ROW.replace(', file raw_source_file', '')} from inc",
    "rejected_rows": f"""with {_EXTRACTS},{_FACT.replace("from inc)", "from inc where ok % 11 <> 3 and source in ('radius', 'fusion'))")}
select source, 'loaded' outcome, count(*) n, {_SUM} from fact group by source
union all
select case when rf = 'R' then 'radius' else 'fusion' end, case when rf = 'R' then 'more cells than the header' else 'not a JSON record' end,
  count(*), null
from dirty where (rf = 'R' or (rf = 'A' and ls = 'F')) and ok % 11 = 3 group by rf""",
    "kpi_from_snapshot": _on_facts(
        f"select count(*) incidents, {_SUM}, count(distinct plant) plants, "
        "count(distinct customer) customers from fact"
    ),
    "tier_90d": _on_facts(
        f"select customer, cast(total as double) credit_usd, {_tier('total', 3000, 1000)} risk_tier "
        f"from ({_recent('2001-11-04')}) t"
    ),
    "tier_latest": _on_facts(
        f"""select coalesce(n.customer, o.customer) customer_name,
  {_tier("coalesce(n.total, o.total)", 3000, 1000)} risk_tier
from ({_recent('2001-08-04')}) o full join ({_recent('2001-11-04')}) n on o.customer = n.customer"""
    ),
    "tier_compacted": _on_facts(
        f"""select coalesce(n.customer, o.customer) customer_name,
  {_tier("coalesce(n.total, o.total)", 3000, 1000)} risk_tier, 1 as versions
from ({_recent('2001-08-04')}) o full join ({_recent('2001-11-04')}) n on o.customer = n.customer"""
    ),
    "distinct_by_month": _on_facts(
        "select strftime(incident_date, '%Y-%m') as month, count(distinct customer) customers, true is_near "
        "from fact group by all"
    ),
    "tier_news": _on_facts(
        f"""select 'batch-1' run_id, count(distinct customer) customers from inc
where ok % 2 = 0 and incident_date >= date '2001-11-04' - interval 90 day
union all
select 'batch-2', count(distinct customer) {_SECOND} and f.customer in
  (select customer from inc where incident_date >= date '2001-11-04' - interval 90 day)"""
    ),
    "kpi": _on_facts(
        f"select count(*) incidents, {_SUM}, count(distinct plant) plants, "
        "count(distinct customer) customers from fact"
    ),
    "summary_row": _on_facts(
        f"""select 'run-1' run_id, count(*) incidents,
  concat('$', format('{{:,.2f}}', cast(sum(credit) as double))) credit_usd, {_SOURCE_LIST} sources,
  count(distinct plant) plants, count(distinct customer) customers from fact"""
    ),
    "by_source": _on_facts(f"select source, count(*) incidents, {_SUM} from fact group by source"),
    "by_plant": _on_facts(f"select plant, count(*) incidents, {_SUM} from fact group by plant"),
    "by_defect_top15": _ranked("defect_category", 15),
    "by_customer_top20": _ranked("customer", 20),
    "customer_plant_top15": _ranked("customer, plant", 15, ""),
    "plant_defect_top15": _ranked("plant, defect_category", 15, ""),
    "source_span": _on_facts(
        "select source, cast(min(incident_date) as string) earliest_date, "
        "cast(max(incident_date) as string) latest_date from fact group by source"
    ),
    "quarter_source": _on_facts(
        f"select {_QUARTER} \"quarter\", source, {_SUM} from fact group by 1, 2"
    ),
    "quarter_pivot": _on_facts(
        f"select {_QUARTER} \"quarter\", "
        + ", ".join(_sum_of(s) for s in ("fusion", "obi", "radius", "vision_a", "vision_b"))
        + " from fact group by 1"
    ),
    "month_trend": _on_facts(f"select {_MONTH} \"month\", count(*) incidents, {_SUM} from fact group by 1"),
    "month_source_filtered": _on_facts(
        f"select {_MONTH} \"month\", source, {_SUM} from fact where {_CHOSEN} group by 1, 2"
    ),
    "detail_filtered": _on_facts(
        f"""select {_DETAIL}, qty qty_affected from fact
where source in ('radius', 'obi') and incident_date between date '2000-03-01' and date '2001-06-30'
  and defect_category = 'SMALL' and credit >= 1000"""
    ),
    "detail_export": _on_facts(f"select {_DETAIL}, qty qty_affected from fact where {_CHOSEN}"),
    "detail_summary": _on_facts(f"select {_SUMMARY} from fact where {_CHOSEN}"),
    "detail_customer_summary": _on_facts(f"select {_SUMMARY} from fact where customer = 'Unknown'"),
    "pareto_topn": _pareto(10),
    "pareto_top5": _pareto(5),
    "heat_plant_defect": _heatmap("plant"),
    "heat_customer_defect": _heatmap("customer"),
    "scorecard": _on_facts("select * from card", _CARD),
    "scorecard_display": _on_facts(
        """select risk_tier "Risk Classification", customer "Customer", incidents "Incidents",
  concat('$', format('{:,.0f}', credit_usd)) "Total Credit (USD)",
  concat('$', format('{:,.0f}', avg_credit_usd)) "Avg Credit (USD)",
  concat('$', format('{:,.0f}', max_credit_usd)) "Max Credit (USD)",
  top_defect "Primary Defect Type", plants "No. of Plants", sources "Source Systems" from card""",
        _CARD,
    ),
    "scorecard_top15": _on_facts(
        "select * from card where risk_tier in ('Medium', 'Low') "
        "order by credit_usd desc, customer limit 15",
        _CARD,
    ),
    "tier_counts": _on_facts(
        f"""select risk_tier, count(customer) customers
from (values ('High'), ('Medium'), ('Low')) v(risk_tier) left join (
  select customer, {_tier('sum(credit)')} tier from fact group by customer) c on c.tier = v.risk_tier
group by risk_tier"""
    ),
    "high_value": _on_facts(f"select {_DETAIL} from fact where credit >= 9000"),
    "alert_log": _on_extracts(
        f"select 'high_credit' kind, {_DETAIL}, 'run-1' run_id from inc where credit >= 9000"
    ),
    "repeat_customers": _on_facts(
        f"select customer, {_MONTH} \"month\", count(*) incidents from fact group by 1, 2 having count(*) > 1"
    ),
    "weekly_ops": _on_facts(
        f"select {_WEEK} week_start, count(*) incidents, {_SUM}, count(distinct plant) plants, "
        "count(distinct customer) customers from fact group by 1"
    ),
    "weekly_over_threshold": _on_facts(
        f"select {_WEEK} week_start, count(*) incidents, {_SUM}, count(distinct plant) plants, "
        "count(distinct customer) customers from fact group by 1 having sum(credit) > 400000"
    ),
    "weekly_payload": _on_facts(
        f"select count(*) incidents, {_SUM}, {_leader('plant')} top_plant, "
        f"{_leader('customer')} top_customer, {_SOURCE_LIST} sources, "
        "count(distinct plant) plants, count(distinct customer) customers from fact"
    ),
    "facets": _on_facts(
        " union all ".join(
            f"select distinct '{c}' facet, {c} \"value\" from fact"
            for c in ("source", "plant", "customer", "defect_category")
        )
        + " union all select 'first_date', cast(min(incident_date) as string) from fact"
        + " union all select 'last_date', cast(max(incident_date) as string) from fact"
    ),
    "report_totals": _on_facts(_REPORT_TOTALS),
    "report_rest": _on_facts(_REPORT_REST),
    "report_of_sums": _on_facts(f"({_REPORT_TOTALS}) union all {_REPORT_REST}"),
    "scorecard_of_sums": _on_facts("select * from card", _CARD),
    "stream_incidents": _on_facts(f"select {_ROW} from fact"),
    "stream_alerts": _on_extracts(
        "select cast(credit as double) credit_requested_usd, plant, customer, defect_category, "
        "cast(incident_date as string) incident_date from inc where credit >= 9000"
    ),
    "stream_tiers": _on_facts(
        f"select customer customer_name, {_tier('total', 3000, 1000)} risk_tier from ({_recent('2001-11-04')}) t"
    ),
    "stream_run_log": _on_facts("select 'SUCCESS' status, count(*) total_rows from fact"),
    "stream_weekly_facts": _on_facts(
        f"select {_WEEK} week_start, count(*) incidents, {_SUM} from fact group by 1"
    ),
    "stream_weekly": _EVENT_WEEKS,
    "stream_weekly_late": _EVENT_WEEKS,
    "stream_weekly_closed": """select strftime(date_trunc('week', ts), '%Y-%m-%d') week_start,
  count(*) incidents, cast(sum(cast("value" as decimal(18,6))) as double) credit_usd
from events group by 1
having date_trunc('week', max(ts)) + interval 7 day
  <= (select max(ts) - interval 1 day from events)""",
}
