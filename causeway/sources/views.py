"""Business facts and graph edges derived from the star-schema tables, as the same SQL for Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

EDGES = """
select l.l_orderkey * 10 + l.l_linenumber as seq,
  concat('case_', cast(l.l_orderkey % 16 as string)) as case_id,
  case l.l_partkey % 8 when 0 then 'Inflation' when 1 then 'Interest Rate' when 2 then 'Oil Price' when 3 then 'AI Capex'
    when 4 then 'GPU Demand' when 5 then 'Liquidity' when 6 then 'Credit Spread' else 'Product Demand' end as head_node,
  case l.l_linenumber % 6 when 0 then 'drives' when 1 then 'raises' when 2 then 'reduces' when 3 then 'correlates with'
    when 4 then 'affects' else 'offsets' end as relation,
  case l.l_suppkey % 8 when 0 then 'Policy Rate' when 1 then 'Bond Yield' when 2 then 'Tech Valuation' when 3 then 'Equity Valuation'
    when 4 then 'HBM Demand' when 5 then 'Shipping Cost' when 6 then 'Revenue' else 'Turmoil' end as tail_node,
  case l.l_returnflag when 'A' then 'high' when 'R' then 'medium' else 'low' end as confidence,
  case l.l_linenumber % 4 when 0 then 'year' when 1 then 'quarter' when 2 then 'month' else 'day' end as granularity,
  o.o_orderdate as event_time, l.l_shipdate as valid_from,
  case when l.l_linestatus = 'O' then null else l.l_shipdate + interval '90' day end as valid_to,
  l.l_discount * 10 as reflection_quality, l.l_tax * 10 as temporal_quality
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""

FACTS = """
select o.o_orderkey as seq, concat('doc_', cast(o.o_orderkey % 500 as string)) as doc_id, c.c_name as entity,
  case o.o_orderkey % 9 when 0 then 'revenue' when 1 then 'expenses' when 2 then 'net income' when 3 then 'revenue decrease'
    when 4 then 'growth in supply' when 5 then 'gross profit' when 6 then 'cost of goods sold' when 7 then 'is owned by' else '' end as metric,
  case o.o_orderkey % 7 when 0 then '1,234' when 1 then '12%' when 2 then 'N/A' when 3 then '-5S0' when 4 then ''
    else cast(cast(floor(o.o_totalprice) as bigint) as string) end as value,
  case o.o_orderkey % 5 when 0 then '2024' when 1 then '2024-Q2' when 2 then '2024-06' when 3 then '2024-06-15' else 'FY2024' end as period,
  case o.o_orderkey % 4 when 0 then 'high' when 1 then 'medium' when 2 then 'low' else null end as confidence
from orders o join customer c on o.o_custkey = c.c_custkey
"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("lineitem", "orders", "customer"):
        sql = sql.replace(f" {name} ", f" parquet.`{sf_dir}/{name}.parquet` ")
    return spark.sql(sql)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EDGES)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FACTS)


#: Facts with messy dates, synonyms and gaps.
DATED = """
select o.o_orderkey as seq, concat('case_', cast(o.o_orderkey % 16 as string)) as case_id,
  case when o.o_orderkey % 11 = 0 then '' else c.c_name end as entity, case o.o_orderkey % 3 when 0 then 'Subject' else null end as subject,
  case o.o_orderkey % 13 when 0 then '' when 1 then 'is reported by' when 2 then 'drives' else 'revenue growth' end as metric,
  case o.o_orderkey % 7 when 4 then '' when 5 then null when 6 then ' 12 Corp ' else cast(o.o_orderkey as string) end as value,
  case o.o_orderkey % 5 when 0 then '' when 1 then null else 'Revenue rose' end as statement,
  case o.o_orderkey % 10 when 1 then '2024-03-05' when 2 then '2024/3/5' when 3 then '2024-03' when 4 then '20240305' when 5 then 'soon' when 6 then '2024-03-05T10:30:00Z' when 7 then '2024-W10' when 8 then '2024-13-01' else null end as as_of,
  case o.o_orderkey % 3 when 0 then '2020-01-01' else null end as start_date,
  case o.o_orderkey % 4 when 0 then '2020-12-31' when 1 then 'open' else null end as valid_to,
  case o.o_orderkey % 9 when 0 then '2024' when 1 then '2024-Q2' when 2 then '2024Q4' when 3 then 'Q2 2024' when 4 then '2024-06' when 5 then '2024-06-15' when 6 then 'FY2024' when 7 then '2Q24' else '' end as period,
  case o.o_orderkey % 4 when 0 then 'High' when 1 then 'medium' when 2 then 'low' else null end as confidence,
  cast(o.o_orderkey % 5 as int) as n_issues, case o.o_orderkey % 2 when 0 then 'reflected' else '' end as validation_status, o.o_orderkey % 3 = 1 as anchored
from orders o join customer c on o.o_custkey = c.c_custkey
"""

#: Feed payloads: few keys each, some under other names, some that aren't numbers.
FEED = """
select event_id as seq, user_id,
  case event_id % 6 when 0 then 'fed_funds' when 1 then 'dot_plot_delta' when 2 then 'qt_runoff' when 3 then 'rrp' when 4 then 'ois_change' else 'other' end as k1,
  case when event_id % 17 = 0 then 'n/a' else cast(event_id % 50 as string) end as v1,
  case event_id % 4 when 0 then 'policy_rate' when 1 then 'liquidity_index' when 2 then 'ffr_change' else 'none' end as k2,
  cast((event_id % 9) / 10.0 as string) as v2, event_id % 7000 as age_seconds
from events
"""


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, DATED)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    rows = spark.sql(FEED.replace("from events", f"from parquet.`{sf_dir}/events.parquet`"))
    return rows.withColumn("payload", F.map_from_arrays(F.array("k1", "k2"), F.array("v1", "v2")))


def _name(key: str, of: str, factor: int, base: int) -> str:
    """One of eight nodes, most of them split by a number: a few have many edges, most few; a fifth are spelled in capitals."""
    split = f"({of} % (case {key} % 6 " + " ".join(f"when {k} then {base**k}" for k in range(5)) + f" else {base**5} end))"
    name = f"case {key} * {factor} % 8 when 0 then 'Inflation' when 1 then 'Policy Rate' when 2 then 'Oil Price' when 3 then 'Tech Valuation' when 4 then 'GPU Demand' when 5 then 'Liquidity' when 6 then 'Credit Spread' else 'Turmoil' end"
    full = f"concat({name}, case when {split} = 0 then '' else concat(' ', cast({split} as string)) end)"
    return f"case when {of} % 5 = 0 then upper({full}) else {full} end"


#: Edges of links with 1 to hundreds of edges, of nodes that are both heads and tails.
TAILED = f"""
select l.l_orderkey * 10 + l.l_linenumber as seq, concat('case_', cast(l.l_orderkey % 997 as string)) as case_id, concat('doc_', cast(l.l_suppkey % 40 as string)) as doc_id,
  {_name("l.l_partkey", "l.l_orderkey", 1, 3)} as head_node,
  case l.l_linenumber % 6 when 0 then 'drives' when 1 then 'raises' when 2 then 'reduces' when 3 then 'correlates with' when 4 then 'affects' else 'offsets' end as relation,
  {_name("l.l_suppkey", "l.l_partkey", 3, 2)} as tail_node,
  case l.l_returnflag when 'A' then 'high' when 'R' then 'medium' else 'low' end as confidence,
  case l.l_linenumber % 4 when 0 then 'year' when 1 then 'quarter' when 2 then 'month' else 'day' end as granularity,
  o.o_orderdate as event_time, l.l_shipdate as valid_from,
  case when l.l_linestatus = 'O' then null else l.l_shipdate + interval '90' day end as valid_to,
  l.l_discount * 10 as reflection_quality, l.l_tax * 10 as temporal_quality
from lineitem l join orders o on l.l_orderkey = o.o_orderkey
"""


def tailed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, TAILED)
