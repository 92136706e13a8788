"""Further queries: temporal edges, ontology, graphs, feeds, audit, proofs and agents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import audit as A
from causeway.operators import consensus as K
from causeway.operators import edges as D
from causeway.operators import facts as X
from causeway.operators import feeds as M
from causeway.operators import graph as G
from causeway.operators import scenario as C
from causeway.plans import catalogue
from causeway.plans.catalogue import QUERIES, _any, _at, _events, _r, query
from causeway.sources import dims, views
from causeway.sources.scratch import written

_ISO = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?Z?$'"


def _date(t: str) -> str:
    """The rule of ``scores.parse_date`` in DuckDB's SQL."""
    dash = f"(case when regexp_matches({t}, '^[0-9]{{4}}(/[0-9]{{1,2}}){{1,2}}$') then replace({t}, '/', '-') else {t} end)"
    piece = lambda k: f"lpad(split_part({dash}, '-', {k}), 2, '0')"
    return f"""(case when regexp_matches({dash}, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}$') then try_cast(left({dash}, 4) || '-' || {piece(2)} || '-' || {piece(3)} as timestamp)
  when regexp_matches({dash}, '^[0-9]{{4}}-[0-9]{{1,2}}$') then try_cast(left({dash}, 4) || '-' || {piece(2)} || '-01' as timestamp)
  when regexp_matches({t}, '^[0-9]{{8}}$') then try_cast(left({t}, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2) as timestamp)
  when regexp_matches({t}, '^[0-9]{{4}}-W[0-9]{{2}}$') then cast(date_trunc('week', cast(left({t}, 4) || '-01-04' as date)) as timestamp) + to_days(7 * (cast(right({t}, 2) as int) - 1))
  when regexp_matches({t}, {_ISO}) then try_cast(replace(replace({t}, 'T', ' '), 'Z', '') as timestamp) end)"""


_YEAR = "left(regexp_replace(period, '[^0-9]', '', 'g'), 4)"
_PERIOD = f"""(case when regexp_matches(period, '^[0-9]{{4}}$') then try_cast(period || '-01-01' as timestamp)
  {" ".join(f"when contains(upper(period), 'Q{k}') and length({_YEAR}) = 4 then try_cast({_YEAR} || '-{3 * k - 2:02}-01' as timestamp)" for k in (1, 2, 3, 4))} else {_date("period")} end)"""
_TIMES = f"""dated as ({views.DATED}), times as (select *, coalesce({_date("as_of")}, {_PERIOD}) as ev, {_date("start_date")} as st, {_date("valid_to")} as en,
  case when as_of is not null then 'event_time' when start_date is not null then 'valid_from' else 'period' end as time_source,
  case when period = '' then 'day' when contains(lower(period), 'q') then 'quarter' when period = '2024' then 'year' when length(period) >= 7 and substr(period, 5, 1) in ('-', '/') then 'month' else 'day' end as grain from dated),
named as (select *, coalesce(nullif(trim(entity), ''), nullif(trim(subject), '')) as h, nullif(trim(metric), '') as r, nullif(trim(value), '') as t, nullif(trim(statement), '') as said from times),
edge as (select seq, case_id, coalesce(h, 'unknown_entity') as head_node, coalesce(r, 'states') as relation, coalesce(t, said) as tail_node, ev as event_time, coalesce(st, ev) as valid_from, en as valid_to, time_source, grain,
  confidence, n_issues, validation_status, anchored, said,
  0.2::double + case when ev is null then 0::double else 0.35::double end + case when coalesce(st, ev) is null then 0::double else 0.25::double end + case when en is null then 0::double else 0.1::double end + case when grain = 'year' then 0::double else 0.1::double end as tq,
  greatest(0::double, least(1::double, 0.5::double + case lower(coalesce(confidence, '')) when 'high' then 0.25::double when 'medium' then 0.15::double when 'low' then 0.05::double else 0::double end - least(n_issues * 0.08::double, 0.24::double) + 0.06::double + 0.06::double * 0.5::double)) as rq
  from named where (h is not null and r is not null and t is not null) or said is not null)"""


def _edges(s, d) -> DataFrame:
    return D.facts_to_edges(views.dated(s, d), rounds=2, repair_ratio=0.5)


@query(f", {_TIMES} select seq, ev as event_time, coalesce(st, ev) as valid_from, en as valid_to, time_source, grain from times")
def temporal_fields(s, d):
    return D.temporal_fields(views.dated(s, d)).select("seq", "event_time", "valid_from", "valid_to", "time_source", F.col("time_granularity").alias("grain"))


@query(f", {_TIMES} select seq, case_id, head_node, relation, tail_node, event_time, valid_from, valid_to, time_source from edge")
def fact_to_edge(s, d):
    return _edges(s, d).select("seq", "case_id", "head_node", "relation", "tail_node", "event_time", "valid_from", "valid_to", "time_source")


@query(f", {_TIMES} select seq, round(rq, 6) as quality from edge")
def reflection_quality(s, d):
    return _edges(s, d).select("seq", _r(F.col("reflection_quality")).alias("quality"))


@query(f""", {_TIMES} select seq, round(greatest(0.05::double, least(0.98::double, (0.25::double + case when said is null then 0::double else 0.1::double end + case validation_status when 'reflected' then 0.05::double else 0::double end
  + 0.3::double * tq + 0.3::double * rq) * case when anchored then 1::double else 0.8::double end)), 3) as weight from edge""")
def edge_weight(s, d):
    return _edges(s, d).select("seq", F.round("edge_weight", 3).alias("weight"))


_NORMAL = "trim(regexp_replace(translate(lower({}), '-_/,.():', '        '), '\\s+', ' ', 'g'))"


def _kind(label: str, role: str) -> str:
    tail = f"when {_any('lower(relation)', ('reported', 'states', 'mentions'))} then 'observation' when regexp_matches({label}, '[0-9]') then 'measurement'" if role == "tail" else ""
    return f"(case when {label} = '' then '{'metric' if role == 'tail' else 'entity'}' when {_any(label, ('inc', 'corp', 'ltd', 'plc', 'company', 'holdings'))} then 'company' when {_any(label, ('event', 'meeting', 'filing', 'guidance', 'announcement'))} then 'event' {tail} when {_any(label, ('rate', 'yield', 'spread', 'growth', 'valuation', 'inflation'))} then 'metric' else '{'entity' if role == 'head' else 'metric'}' end)"


@query(f""", {_TIMES}, o as (select *, {_NORMAL.format('head_node')} as hl, {_NORMAL.format('tail_node')} as tl, {_NORMAL.format('relation')} as rl from edge)
select seq, {_kind('hl', 'head')} || ':' || replace(hl, ' ', '_') as head_object, {_kind('tl', 'tail')} || ':' || replace(tl, ' ', '_') as tail_object,
  case when contains(rl, 'drives') or contains(rl, 'causes') then 'causally_influences' when contains(rl, 'reported') or contains(rl, 'states') then 'observes' when contains(rl, 'correlates') then 'correlates_with' else replace(rl, ' ', '_') end as predicate from o""")
def ontology_objects(s, d):
    return D.ontology(_edges(s, d)).select("seq", "head_object", "tail_object", "predicate")


@query("select head_node, relation, tail_node, count(distinct concat_ws('|', case_id, cast(event_time as varchar), granularity)) as n_sources, min(seq) as first_seq from edges group by 1, 2, 3")
def lineage_merge(s, d):
    return D.lineage(views.edges(s, d), ["case_id", "event_time", "granularity"], ["head_node", "relation", "tail_node"])


_GRAPH = "g as (select distinct case_id, replace(lower(trim(head_node)), ' ', '_') as h, replace(lower(trim(tail_node)), ' ', '_') as t from edges)"


@query(f", {_GRAPH} select case_id, (select count(distinct n) from (select h as n, case_id as c from g union select t, case_id from g) where c = x.case_id) as n_nodes, count(*) as n_edges from g x group by case_id")
def graph_counts(s, d):
    return G.graph_counts(views.edges(s, d), "case_id")


def acyclic_dag(s, d):
    """Per case, the links that a greedy choice by strength keeps without a cycle."""
    return G.acyclic(G.score_edges(views.edges(s, d)), "case_id").withColumn("strength", _r(F.col("strength")))


def graph_stability(s, d):
    """Per case, the algebraic connectivity and the stability that follows from it."""
    return G.fiedler(views.edges(s, d).withColumn("strength", F.lit(1.0)), "case_id").select("case_id", _r(F.col("fiedler")).alias("fiedler"), _r(S.stability(F.col("fiedler"))).alias("stability"))


def _links(s, d) -> DataFrame:
    return written(K.skeleton(views.edges(s, d), _at()), "links")


def root_cause_path(s, d):
    """The strongest paths back from tech_valuation over the consensus links."""
    found = G.root_causes(_links(s, d), "tech_valuation")
    return found.select(F.array_join("path", ">").alias("path"), *[_r(F.col(c)).alias(c) for c in ("influence", "direction", "lower", "upper")]).orderBy(F.desc("influence"), "path").limit(3)


def _shock(s, d, node: str, delta: float) -> DataFrame:
    """Impacts of one shock over the consensus links, at the regime it brings about."""
    links = _links(s, d).withColumn("seq", F.struct((-F.col("strength")).alias("s"), "head", "relation", "tail"))
    shock = s.createDataFrame([("one", node, delta)], "scenario string, node string, delta double")
    return C.impacts(C.arrivals(shock, links))


def whatif_impacts(s, d):
    """Impacts of a shock of 1 on inflation over the consensus of all edges, three levels deep."""
    return _shock(s, d, "inflation", 1.0).select("node", _r(F.col("impact")).alias("impact"), "depth")


def action_triggers(s, d):
    """Actions that an inflation shock triggers, by the largest impact that a node had at any time."""
    return C.actions(_shock(s, d, "inflation", 1.0)).select("node", "action", F.col("mitigation").alias("effect"), _r(F.col("impact")).alias("impact"))


def investment_recommendations(s, d):
    """What a liquidity shock recommends."""
    found = G.recommendations(_shock(s, d, "liquidity", 1.0), "liquidity")
    return found.select("asset", "action", _r(F.col("confidence")).alias("confidence"))


def global_shock(s, d):
    """For each nation, of which the stress in its market's weight is the size of its shock: how that travels the structural links between markets."""
    nations = s.read.parquet(f"{d}/nation.parquet")
    market = F.element_at(F.array(*map(F.lit, dims.MARKETS)), (F.col("n_regionkey") % len(dims.MARKETS) + 1).cast("int"))
    weight = S.market_weight(F.col("n_regionkey") / 5, F.col("n_nationkey") / 25)
    shocks = nations.select(F.col("n_name").alias("scenario"), F.concat(F.lit("market_"), market).alias("node"), ((weight - 0.5) * F.when(F.col("n_nationkey") % 2 == 0, 1).otherwise(-1)).alias("delta"))
    links = G.market_links(s).withColumn("seq", F.struct("head", "tail"))
    state = C.arrivals(shocks, links)
    found = C.impacts(state).join(C.regimes(state).select("scenario", "regime"), "scenario")
    return found.select(F.col("scenario").alias("nation"), "node", _r(F.col("impact")).alias("impact"), "depth", "effect", "regime")


_KEYS = {k: names for k, names in dims.FEED_KEYS.items()}
_SNAP = f"""feed as ({views.FEED}), vals as (select *, {", ".join("coalesce(" + ", ".join(f"case when k1 = '{n}' then try_cast(v1 as double) end, case when k2 = '{n}' then try_cast(v2 as double) end" for n in names) + f") as {k}" for k, names in _KEYS.items())} from feed),
snap as (select user_id, unnest(max_by(struct_pack(seq := seq, age := age_seconds, {", ".join(f"{k} := {k}" for k in _KEYS)}), seq)) from vals where coalesce({", ".join(_KEYS)}) is not null group by 1),
st as (select *, age > 3600 as old from snap)"""


def _snapshots(s, d) -> DataFrame:
    rows = M.latest(M.snapshots(views.feed(s, d)), "user_id", "seq")
    return rows.withColumn("old", F.greatest(F.lit(0), F.col("age_seconds")) > max(60, 3600))


@query(f""", {_SNAP}, e as (select user_id, case when old then null else coalesce(dot_plot_change, rate_expectation_change, policy_rate_change) end as sp from st)
select user_id, round(case when sp is null then 1::double else 0.6::double + 0.4::double * sp end, 6) as blended, round(case when sp is null then 0::double else sp end, 6) as replaced from e""")
def feed_effective_delta(s, d):
    f = _snapshots(s, d)
    return f.select("user_id", _r(M.effective_delta(F.lit(1.0), F.col("old"))).alias("blended"), _r(M.effective_delta(F.lit(0.0), F.col("old"))).alias("replaced"))


@query(f""", {_SNAP} select user_id, round(case when old then 0::double when liquidity_index is not null then greatest(0::double, least(liquidity_index, 1::double))
  else least(1::double, coalesce(least(abs(qt_pace) / 100, 0.6::double), 0) + coalesce(least(abs(rrp_balance) / 1500, 0.5::double), 0) + coalesce(least(abs(policy_rate) / 6, 0.4::double), 0)) end, 6) as stress from st""")
def liquidity_stress(s, d):
    return _snapshots(s, d).select("user_id", _r(M.liquidity_stress(F.col("old"))).alias("stress"))


@query("select event_id, round(case when value >= 0 then -1::double else 1::double end * (1 - exp(-2.4::double * abs(value / 100))) * 0.45::double, 6) as tech_valuation, round(case when value >= 0 then 1::double else -1::double end * (1 - exp(-2.4::double * abs(value / 100))) * 0.3::double, 6) as debt_service_ratio from events where value is not null")
def fed_shock(s, d):
    out = M.fed_shock(F.col("value") / 100)
    return _events(s, d).where("value is not null").select("event_id", *[_r(c).alias(n) for n, c in out.items()])


@query("select user_id, max_by(value, event_id) filter (where event_type <> 'error' and value is not null) as rate, max_by(event_id % 10, event_id) filter (where event_id % 3 = 0) as risk from events group by 1")
def region_state_patch(s, d):
    e = _events(s, d).withColumns({"rate": F.when(F.col("event_type") != "error", F.col("value")), "risk": F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 10)})
    return M.patched_state(e, "user_id", "event_id", ["rate", "risk"])


_CHAINED = "ch as (select user_id, event_id, props as p, cast(event_id as varchar) as c, case when event_id % 97 = 0 then 'forged' else sha256(props || '|' || event_id || '|' || cast(user_id as varchar)) end as event_hash from events), lg as (select *, coalesce(lag(event_hash) over (partition by user_id order by event_id), repeat('0', 64)) as prev_hash from ch)"


@query(f", {_CHAINED} select user_id, bool_and(coalesce(event_hash = sha256(p || '|' || c || '|' || prev_hash), false)) as intact, count(*) as n_events from lg group by 1")
def chain_verify(s, d):
    """Chains whose hashes don't cover the hash before them are found broken."""
    own = F.sha2(F.concat_ws("|", "props", "event_id", "user_id").cast("binary"), 256)
    e = _events(s, d).withColumn("event_hash", F.when(F.col("event_id") % 97 == 0, "forged").otherwise(own)).withColumn("c", F.col("event_id").cast("string"))
    e = e.withColumn("prev_hash", F.lag("event_hash", 1, "0" * 64).over(Window.partitionBy("user_id").orderBy("event_id")))
    return A.verify_chain(e, "user_id", "event_id", "props", "c")


@query("select field, value, count(*) as n from (select unnest([struct_pack(field := 'event_type', value := coalesce(event_type, 'unknown')), struct_pack(field := 'user_id', value := coalesce(cast(user_id as varchar), 'unknown'))], recursive := true) from (select * from events order by event_id desc limit 500)) group by 1, 2")
def compliance_report(s, d):
    return A.compliance(_events(s, d), ["event_type", "user_id"], "event_id", 500)


@query("select seq, sha256('{\"confidence\": ' || coalesce('\"' || confidence || '\"', 'null') || ', \"entity\": \"' || entity || '\", \"metric\": \"' || metric || '\"}') as fact_hash from facts")
def fact_hash(s, d):
    return views.facts(s, d).select("seq", A.fact_hash({"entity": F.col("entity"), "metric": F.col("metric"), "confidence": F.col("confidence")}).alias("fact_hash"))


_BAD = "case o_orderkey % 6 when 0 then 'proof_missing_fields:pi_c' when 1 then 'public_signals_empty;net_income_missing' when 2 then 'unsupported_scheme:stark' when 3 then 'verification_key_protocol_mismatch' else '' end"


@query(f"select o_orderkey as seq, {_BAD} as errors, case when o_orderkey % 5 = 0 then 'relation_hash_match' else '' end as failed, o_orderkey % 6 > 3 and o_orderkey % 5 > 0 as valid from orders")
def proof_checks(s, d):
    k = F.col("o_orderkey")
    names = F.when(k % 6 == 0, F.array(F.lit("pi_a"), F.lit("PI_B"), F.lit("relation_hash"))).otherwise(F.array(F.lit("pi_a"), F.lit("PI_B"), F.lit("pi_c"), F.lit("relation_hash")))
    rows = s.read.parquet(f"{d}/orders.parquet").select(
        k.alias("seq"), F.when(k % 6 == 2, "stark").otherwise("Groth16 ").alias("scheme"),
        F.map_from_arrays(names, F.transform(names, lambda n: F.when(n == "relation_hash", F.when(k % 5 == 0, "x").otherwise("h")).otherwise("1"))).alias("proof"),
        F.when(k % 6 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("850"))).alias("signals"),
        F.map_from_arrays(F.array(F.lit("relation_hash"), F.lit("protocol")), F.array(F.lit("h"), F.when(k % 6 == 3, "plonk").otherwise(""))).alias("key"),
    )
    return A.check_proofs(rows).select("seq", "errors", "failed", "valid")


@query("""select user_id, arg_max(role, w * 1000 - rk) as dominant, round(max(w) / sum(w), 6) as share from (select user_id, case event_id % 3 when 0 then 'analyst' when 1 then 'critic' else 'strategist' end as role,
  (event_id % 3) as rk, sum((event_id % 5 + 1) * case when event_id % 3 > 0 then 1.5::double else 1::double end) as w from events where event_id % 3 < 3 group by 1, 2, 3) group by 1""")
def agent_mix(s, d):
    e = _events(s, d).select("user_id", F.element_at(F.array(F.lit("Analyst"), F.lit(" critic"), F.lit("strategist")), (F.col("event_id") % 3 + 1).cast("int")).alias("role"), (F.col("event_id") % 5 + 1).cast("double").alias("weight"))
    tracks = e.groupBy("user_id", "role").agg(F.sum("weight").alias("weight")).withColumn("content", F.lit("text"))
    return A.mix_tracks(tracks, "user_id", F.lit(True)).select("user_id", "dominant", "share")


@query("""select user_id, round(score, 6) as score, case when score >= 80 then 'Approve' when score >= 65 then 'Conditional' else 'Escalate' end as disposition from (
  select user_id, 0.55::double * coalesce(avg(event_id % 101) filter (where event_type = 'click'), 0) + 0.45::double * coalesce(avg(event_id % 89) filter (where event_type <> 'click'), 0) as score from events group by 1)""")
def decision_score(s, d):
    mean = lambda m, ok: F.coalesce(F.avg(F.when(ok, F.col("event_id") % m)), F.lit(0.0))
    out = _events(s, d).groupBy("user_id").agg((0.55 * mean(101, F.col("event_type") == "click") + 0.45 * mean(89, F.col("event_type") != "click")).alias("score"))
    return out.select("user_id", _r(F.col("score")).alias("score"), S.disposition(F.col("score")).alias("disposition"))


@query("select 'market_' || lower(replace(n_name, ' ', '_')) as id, 'market' as grp from nation union select distinct replace(lower(trim(head_node)), ' ', '_'), 'node' from edges union select distinct replace(lower(trim(tail_node)), ' ', '_'), 'node' from edges")
def graph_view_nodes(s, d):
    """Markets and the nodes of all cases, one row for each id: the first source that names it wins."""
    nodes = s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("market_"), S.node_id(F.col("n_name"))).alias("id"), F.lit("market").alias("grp"), F.lit(0).alias("seq"))
    more = views.edges(s, d).select(F.explode(F.array("head_node", "tail_node")).alias("n")).select(S.node_id(F.col("n")).alias("id"), F.lit("node").alias("grp"), F.lit(1).alias("seq"))
    return nodes.unionByName(more).groupBy("id").agg(F.min_by("grp", "seq").alias("grp"))


@query(", i as (select o_custkey as n, sum(o_totalprice) / 1e6 - 1 as delta from orders group by 1) select l_orderkey, l_linenumber from lineitem join i a on a.n = l_partkey % 100 join i b on b.n = l_suppkey % 100 where abs(a.delta) > 0.01::double")
def impact_links(s, d):
    """Links of which both ends are impacted, the source by more than 0.01."""
    impacts = s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("n")).agg((F.sum("o_totalprice") / 1e6 - 1).alias("delta"))
    links = s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).alias("a"), (F.col("l_suppkey") % 100).alias("b"))
    strong = impacts.where(F.abs("delta") > 0.01).select(F.col("n").alias("a"))
    return links.join(strong, "a", "left_semi").join(impacts.select(F.col("n").alias("b")), "b", "left_semi").select("l_orderkey", "l_linenumber")


@query("""select cust, y, round((cy - py) / abs(py) * 100, 4) as growth, round(coalesce(py, cy / 1.05::double), 4) as base from (select cust, y, cy, lag(cy) over (partition by cust order by y) as py from
  (select o_custkey as cust, cast(year(o_orderdate) as int) as y, sum(o_totalprice) as cy from orders group by 1, 2))""")
def yoy_growth(s, d):
    """Growth over the year before, and that year's value or a proxy by a growth factor."""
    o = s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("cy"))
    o = o.withColumn("py", F.lag("cy").over(Window.partitionBy("cust").orderBy("y")))
    return o.select("cust", "y", F.round((F.col("cy") - F.col("py")) / F.abs("py") * 100, 4).alias("growth"), F.round(F.coalesce("py", F.col("cy") / 1.05), 4).alias("base"))


@query("select o_orderkey, round(case when v <> 0 and abs(v) < 1e-4 then v * 1000 else v end, 9) as scaled from (select o_orderkey, case when abs(w) > 1000 then w / 1000 else w end as v from (select o_orderkey, o_totalprice * case o_orderkey % 3 when 0 then 1 when 1 then 1e4 else 1e8 end / 1e9 as w from orders))")
def scale_normalise(s, d):
    scale = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 1e4).otherwise(1e8)
    return s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(S.rescaled(F.col("o_totalprice") * scale), 9).alias("scaled"))


@query("select doc_id from documents where text is not null and not regexp_matches(text, '[가-힣]')")
def language_filter(s, d):
    """Documents without Korean letters."""
    return s.read.parquet(f"{d}/documents.parquet").where(~F.col("text").rlike("[가-힣]")).select("doc_id")


_COT = "cot as (select seq, lower(statement || ' ' || case seq % 4 when 0 then 'hedging plan' when 1 then 'we expand' else 'reduce cost, refinance' end) as t from (select seq, coalesce(statement, '') as statement from dated))"


@query(f", {_TIMES}, {_COT}, k as (select unnest({list(dims.ACTION_WORDS)!r}) as w) select seq, 'Strategic Recommendation' as head_node, 'suggests action' as relation, 'Potential ' || upper(left(w, 1)) || substr(w, 2) as tail_node from cot join k on contains(t, w)")
def kinetic_actions(s, d):
    """Facts for the actions that a text names."""
    k = F.col("seq") % 4
    text = F.lower(F.concat_ws(" ", F.coalesce("statement", F.lit("")), F.when(k == 0, "hedging plan").when(k == 1, "we expand").otherwise("reduce cost, refinance")))
    words = F.explode(F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), w) for w in dims.ACTION_WORDS])))
    found = views.dated(s, d).select("seq", words.alias("w"))
    name = F.concat(F.lit("Potential "), F.upper(F.left("w", F.lit(1))), F.substring("w", 2, 100))
    return found.select("seq", F.lit("Strategic Recommendation").alias("head_node"), F.lit("suggests action").alias("relation"), name.alias("tail_node"))


@query(f", v as (select * from ({catalogue.SQL['symbolic_validation']})) select rule, count(*) as n, count(distinct doc_id) as n_docs from v group by 1")
def symbolic_report(s, d):
    """Mismatches of each accounting rule."""
    return catalogue.symbolic_validation(s, d).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def _round(k: int, source: str) -> str:
    """One round of reflection in DuckDB's SQL: m{k} critiqued, w{k} what it leaves."""
    size = f"case when {_any('lower(metric)', dims.DOWN_TERMS)} then -abs(number) else abs(number) end"
    return f"""m{k} as (select *, coalesce(({_any("lower(metric)", dims.DOWN_TERMS)} and number > 0) or ({_any("lower(metric)", dims.UP_TERMS)} and number < 0), false) as inverted,
  coalesce(number is null and regexp_matches(value, '[0-9]'), false) as bad, (coalesce(entity, '') = '' or coalesce(metric, '') = '' or coalesce(value, '') = '') as missing,
  coalesce(confidence, '') = '' as unsure from (select *, {catalogue._NUMBER} as number from {source})),
w{k} as (select min(seq) as seq, entity, metric, value, period, arg_min(confidence, seq) as confidence from (select seq, entity, metric, period, coalesce(nullif(confidence, ''), 'medium') as confidence,
  case when not inverted then value when contains(value, '.') then cast({size} as varchar) else cast(cast({size} as bigint) as varchar) end as value from m{k}) group by entity, metric, value, period)"""


_ROUND = """select {0} as round, (select count(*) from m{0}) as input_count, (select count(*) from m{0} where bad or unsure or missing) as issues_found, (select count(*) from m{0} where bad) as numeric_typo,
  (select count(*) from m{0} where missing) as omission, (select count(*) from m{0} where inverted) as relation_inversion, (select count(*) from w{0}) as output_count"""
_SAME = "(select count(*) from facts) = (select count(*) from w1) and not exists (select entity, metric, value, period from facts except select entity, metric, value, period from w1)"


@query(f", {_round(1, 'facts')}, {_round(2, 'w1')} {_ROUND.format(1)} union all select * from ({_ROUND.format(2)}) where not ({_SAME})")
def reflection_rounds(s, d):
    """What each round of the reflection over all facts takes, finds and leaves."""
    return X.reflect(views.facts(s, d))[1]


@query(f", {_round(1, 'facts')}, {_round(2, 'w1')} select * from w2")
def reflected_facts(s, d):
    """The facts that the reflection leaves."""
    return X.reflect(views.facts(s, d))[0].select("seq", "entity", "metric", "value", "period", "confidence")


@query("select c_custkey, count(o_orderkey) as n_documents, max(o_orderkey) as last_document, case when count(o_orderkey) = 0 then 'created' when count(*) filter (where o_orderstatus = 'F') > 0 then 'decided' else 'distilled' end as status from customer left join orders on o_custkey = c_custkey group by 1")
def case_documents(s, d):
    """Every case with its documents' count and latest, and the status that they give it."""
    cases, docs = s.read.parquet(f"{d}/customer.parquet"), s.read.parquet(f"{d}/orders.parquet")
    per = docs.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_document"), F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    return cases.select("c_custkey").join(per, "c_custkey", "left").select(
        "c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n_documents"), "last_document", F.when(F.col("n").isNull(), "created").when(F.col("f"), "decided").otherwise("distilled").alias("status")
    )


@query(f", {_TIMES}, have as (select distinct case_id from edges where seq % 3 = 0) select case_id, 'edge' as source, count(*) as n from edges where seq % 3 = 0 group by 1 union all select case_id, 'fact', count(*) from edge where case_id not in (select case_id from have) group by 1")
def case_edges_fallback(s, d):
    """A case's stored edges, or else those of its facts."""
    stored = views.edges(s, d).where("seq % 3 = 0").select("case_id", F.lit("edge").alias("source"))
    facts = _edges(s, d).select("case_id", F.lit("fact").alias("source")).join(stored.select("case_id").distinct(), "case_id", "left_anti")
    return stored.unionByName(facts).groupBy("case_id", "source").agg(F.count("*").alias("n"))


@query("select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, role, text) as lines, min(length(coalesce(text, '')))::int as shortest from conversations group by 1")
def jsonl_join(s, d):
    """The texts of each conversation as lines, in order."""
    t = s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return t.select("conv_id", F.array_join("t.text", "\n").alias("lines"), F.array_min(F.transform("t.text", F.length)).alias("shortest"))


_ARRIVED = """, r as (select event_id, user_id, case event_id % 5 when 0 then 'geopolitical_risk' when 1 then 'oil_price' when 2 then 'inflation' else 'liquidity' end as node, cast(event_id * 7 % 41 - 20 as double) / 256 as impact from events)"""


@query(f"""{_ARRIVED}, a as (select *, sum(impact) over (partition by user_id, node order by event_id) as running from r),
b as (select *, abs(running) as v, coalesce(abs(lag(running) over (partition by user_id, node order by event_id)), 0) as u from a),
c as (select *, max(v) over k as m, sum(v - u) over k as s, sum((v >= 0.1)::int - (u >= 0.1)::int) over k as h, last_value(case when node = 'geopolitical_risk' then v end ignore nulls) over k as g from b window k as (partition by user_id order by event_id rows unbounded preceding)),
e as (select *, case when m >= 0.6 or s >= 1.5 or h >= 6 then 2 when m >= 0.3 or h >= 4 or g >= 0.25 then 1 else 0 end as now from c),
f as (select *, max(now) over (partition by user_id order by event_id) as severity from e)
select event_id, user_id, running, cast(h as bigint) as hits, s as total, case severity when 2 then 'Crisis' when 1 then 'High Volatility' else 'none' end as regime from f""")
def running_regime(s, d):
    """Each key's regime after each of its events, which never falls."""
    rows = _events(s, d).select("event_id", "user_id", F.expr("case event_id % 5 when 0 then 'geopolitical_risk' when 1 then 'oil_price' when 2 then 'inflation' else 'liquidity' end").alias("node"), F.expr("cast(event_id * 7 % 41 - 20 as double) / 256").alias("impact"))
    state = C.running_regime(rows, "user_id", "event_id", "node", "impact")
    return state.select("event_id", "user_id", "running", F.col("hits").cast("long").alias("hits"), "total", C.regime_name(F.col("severity")).alias("regime"))


def _scenarios(s, d) -> DataFrame:
    """Shocks of three sizes on every node that has links, over the consensus links in order of strength."""
    links = _links(s, d).withColumn("seq", F.struct((-F.col("strength")).alias("s"), "head", "relation", "tail"))
    shocks = links.select(F.col("head").alias("node")).distinct().withColumn("delta", F.explode(F.array(F.lit(0.05), F.lit(-0.4), F.lit(1.0))))
    return C.arrivals(shocks.withColumn("scenario", F.concat_ws(":", "node", "delta")), links)


def whatif_scenarios(s, d):
    """Impacts of many shocks at once, each at the regime that it brings about."""
    found = C.impacts(_scenarios(s, d))
    return found.select("scenario", "node", _r(F.col("impact")).alias("impact"), "depth", "effect", "via", "rank")


def whatif_actions(s, d):
    """The actions that these shocks trigger."""
    return C.actions(C.impacts(_scenarios(s, d))).select("scenario", "node", "action", "mitigation", _r(F.col("impact")).alias("impact"))


def whatif_regimes(s, d):
    """The regimes that these shocks end in."""
    return C.regimes(_scenarios(s, d))


_DOCUMENT = ", t as (select doc_id, case when doc_id % 7 = 0 then null else text end as content, case doc_id % 3 when 0 then encode('bytes ' || cast(doc_id as varchar)) end as file_bytes, case doc_id % 4 when 0 then base64(encode('coded ' || cast(doc_id as varchar))) when 1 then '' end as content_base64 from documents)"


@query(f"{_DOCUMENT}, b as (select doc_id, case when file_bytes is not null then md5(file_bytes) when content_base64 != '' then md5(from_base64(content_base64)) when content != '' then md5(content) end as digest, content from t) select doc_id, digest, case when digest is null then 'no content' else '' end as error, md5('[Offline Distill]' || chr(10) || coalesce(content, '')) as offline from b")
def document_bytes(s, d):
    """A document's bytes: those given, or its base64 text's, or its content's; and what is kept of it without any service."""
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("content"), F.expr("case when doc_id % 3 = 0 then encode(concat('bytes ', doc_id), 'UTF-8') end").alias("file_bytes"), F.expr("case doc_id % 4 when 0 then base64(encode(concat('coded ', doc_id), 'UTF-8')) when 1 then '' end").alias("content_base64"))
    raw = X.document_bytes(F.col("file_bytes"), F.col("content_base64"), F.col("content"))
    return docs.select("doc_id", F.md5(raw).alias("digest"), F.when(raw.isNull(), "no content").otherwise("").alias("error"), F.md5(X.offline_text(F.col("content"))).alias("offline"))


@query("select event_id, case when event_type is null then null when event_id % 3 = 0 then trim(event_type) end as statement, case when event_id % 3 = 1 then cast(event_id as varchar) else event_type end as raw_fact, case event_id % 3 when 0 then 'coerced_from_str' when 1 then 'coerced_from_unknown' else '' end as validation_status from events")
def coerced_facts(s, d):
    """Facts given as text or as anything else become facts with a note of that; facts proper stay."""
    rows = _events(s, d).select("event_id", F.when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise(F.col("event_type")).alias("raw_fact"), F.expr("case event_id % 3 when 0 then 'text' when 1 then 'other' else 'fact' end").alias("kind"))
    return rows.select("event_id", *[c.alias(n) for n, c in X.coerced(F.col("raw_fact"), F.col("kind")).items()])


for _f in (whatif_impacts, acyclic_dag, graph_stability, root_cause_path, action_triggers, investment_recommendations, global_shock, whatif_scenarios, whatif_actions, whatif_regimes):
    QUERIES[_f.__name__] = _f
