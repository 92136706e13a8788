"""The queries over the library's operators, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions import scores as S
from causeway.operators import consensus as K
from causeway.operators import events as E
from causeway.operators import facts as X
from causeway.operators import graph as G
from causeway.sources import dims, views

AS_OF = "2000-06-15 00:00:00"
_at = lambda: F.lit(AS_OF).cast("timestamp_ntz")
_r = lambda c, n=6: F.round(c, n)
_events = lambda s, d: s.read.parquet(f"{d}/events.parquet")

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"with edges as ({views.EDGES}), facts as ({views.FACTS}) {sql}"
        return f

    return add


def _any(text: str, terms: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_NUMBER = "try_cast(regexp_replace(translate(replace(value, ',', ''), 'OolISB', '001158'), '[^0-9.\\-]', '', 'g') as double)"
_BONUS = "case lower(coalesce(confidence, '')) when 'high' then 0.25::double when 'medium' then 0.15::double when 'low' then 0.05::double else 0::double end"
_BASE = f"greatest(0.05::double, least(0.35::double + {_BONUS} + 0.2::double * greatest(0::double, least(reflection_quality, 1::double)) + 0.2::double * greatest(0::double, least(temporal_quality, 1::double)), 0.98::double))"
_CRITIQUE = f"""c0 as (select *, {_NUMBER} as number from facts), c as (select *,
  coalesce(({_any("lower(metric)", dims.DOWN_TERMS)} and number > 0) or ({_any("lower(metric)", dims.UP_TERMS)} and number < 0), false) as inverted,
  (number is null and regexp_matches(value, '[0-9]')) as bad, (entity = '' or metric = '' or value = '') as missing, confidence is null as unsure from c0)"""
_SCORED = f"""names as (select * from {dims.values(dims.concept_names())} t(concept, name)),
nodes as (select head_node as node from edges union select tail_node from edges),
con as (select node, concept from nodes join names on contains(trim(regexp_replace(translate(lower(node), '-_/,.():', '        '), '\\s+', ' ', 'g')), name) group by all),
pairs as (select distinct head_node, tail_node from edges),
pc as (select p.head_node, p.tail_node, h.concept as h, t.concept as t from pairs p join con h on h.node = p.head_node join con t on t.node = p.tail_node),
mx as (select head_node, tail_node, m, sg, label from (select pc.*, m, sg, label, row_number() over (partition by head_node, tail_node order by m desc, pc.h, pc.t) r
  from pc join {dims.values(dims.MATRIX)} x(h, t, m, sg, label) on pc.h = x.h and pc.t = x.t where m > 1) where r = 1),
sx as (select head_node, tail_node, ef, eq from (select pc.*, ef, eq, row_number() over (partition by head_node, tail_node order by ef desc, pc.h, pc.t) r
  from pc join {dims.values(dims.SCM)} x(h, t, ef, sigma, domain, eq) on pc.h = x.h and pc.t = x.t where ef > 1) where r = 1),
mt as (select * from {dims.values(dims.MATRIX)} x(d, t, m, sg, label)),
macro as (select d from mt where {_any("label", ("macro", "policy", "rates", "liquidity", "inflation", "energy"))} union select unnest(['inflation', 'policy_rate', 'liquidity', 'geopolitical_risk'])),
dx as (select distinct head_node, tail_node from pc join mt a on a.t = pc.h join mt b on b.t = pc.t and b.d = a.d where a.d in (select d from macro)),
bx as (select distinct node from con where concept in {dims.BROAD_CONCEPTS!r}),
scored as (select e.*, {_BASE} as base,
  case when {_any("lower(relation)", dims.CAUSAL_TERMS)} then 1.12::double when {_any("lower(relation)", dims.WEAK_TERMS)} then 0.9::double else 1::double end as boost,
  coalesce(m, 1::double) as mb, coalesce(ef, 1::double) as sb, coalesce(label, '') as label, coalesce(eq, '') as eq,
  (case when bx.node is null then 1::double else 0.85::double end) * (case when dx.head_node is null then 1::double else 0.7::double end) as bias,
  greatest(-1::double, least(coalesce(sg, 1::double) * case when {_any("lower(relation)", dims.INVERSE_TERMS)} then -1::double else 1::double end, 1::double)) as polarity
  from edges e left join mx using (head_node, tail_node) left join sx using (head_node, tail_node) left join dx using (head_node, tail_node) left join bx on bx.node = e.head_node),
se as (select *, greatest(0.05::double, least(base * boost * mb * sb * bias, 0.98::double)) as strength from scored)"""
_NODE = "replace(lower(trim({})), ' ', '_')"
_WEIGHTS = f"dw as (select {_NODE.format('head_node')} as head, {_NODE.format('tail_node')} as tail, (case when max(case when date_diff('second', event_time, timestamp '{AS_OF}') < 365 * 86400 then 1 else 0 end) = 1 then 1.15::double else 1::double end) + least(0.05::double * count(*), 0.2::double) as weight, count(*) as n_edges from edges group by 1, 2)"
_CONSENSUS = """rows_ as (select replace(lower(trim(head_node)), ' ', '_') as head, relation, replace(lower(trim(tail_node)), ' ', '_') as tail, seq, polarity,
  greatest(0.05::double, least(strength * weight, 0.98::double)) as s from se join dw on dw.head = replace(lower(trim(head_node)), ' ', '_') and dw.tail = replace(lower(trim(tail_node)), ' ', '_')),
num as (select *, row_number() over (partition by head, relation, tail order by seq) as i, count(*) over (partition by head, relation, tail) as n from rows_),
links as (select head, relation, tail, case when max(n) = 1 then max(s) else least(0.98::double, max(s * pow(1.05::double, least(n - case when i = 1 then 1 else i - 1 end, 2000)))) end as strength,
  avg(polarity) as polarity, count(*) as support_count from num group by all)"""


@query(f"select seq, case_id, head_node, relation, tail_node from edges where (valid_from is null or valid_from <= timestamp '{AS_OF}') and (valid_to is null or valid_to >= timestamp '{AS_OF}')")
def edge_as_of_gate(s, d):
    return G.as_of(views.edges(s, d), _at()).select("seq", "case_id", "head_node", "relation", "tail_node")


@query("select case_id, head_node, relation, tail_node, min(seq) as seq from edges group by all")
def edge_dedupe(s, d):
    keys = ["case_id", "head_node", "relation", "tail_node"]
    return G.first_of(views.edges(s, d), keys).select(*keys, "seq")


@query("select min(seq) as seq, case_id, head_node, relation, tail_node, valid_from, valid_to from edges group by all")
def edge_signature_dedupe(s, d):
    """First-wins dedupe by the whole signature; ``edge_dedupe`` answers by its SQL's four parts."""
    return G.dedupe_edges(views.edges(s, d)).select("seq", "case_id", "head_node", "relation", "tail_node", "valid_from", "valid_to")


@query("select seq, round(0.2::double + 0.35::double + 0.25::double + case when valid_to is null then 0::double else 0.1::double end + case when granularity = 'year' then 0::double else 0.1::double end, 6) as quality from edges")
def temporal_quality(s, d):
    return views.edges(s, d).select("seq", _r(S.temporal_quality(*map(F.col, ("event_time", "valid_from", "valid_to", "granularity")))).alias("quality"))


@query("select seq, case when period = '2024' then 'year' when period = '2024-Q2' then 'quarter' when period like '2024-%' then 'month' else 'day' end as grain from facts")
def time_granularity(s, d):
    return views.facts(s, d).select("seq", S.granularity(F.col("period")).alias("grain"))


@query(f"select seq, {_NUMBER} as number from facts")
def numeric_parse(s, d):
    return views.facts(s, d).select("seq", S.parse_number(F.col("value")).alias("number"))


@query(f", {_CRITIQUE} select seq, concat_ws(',', case when bad then 'invalid_numeric_value' end, case when unsure then 'missing_confidence' end, case when missing then 'missing_required_component' end) as issues, concat_ws(',', case when bad then 'numeric_typo' end, case when missing or unsure then 'omission' end, case when inverted then 'relation_inversion' end) as error_types from c")
def fact_critique(s, d):
    return X.critique(views.facts(s, d), unsure="omission").select("seq", "issues", "error_types")  # as its SQL


_ISSUES = "select seq, concat_ws(',', case when bad then 'numeric_typo' end, case when missing then 'omission' end, case when inverted then 'relation_inversion' end) as error_types from c"


@query(f", {_CRITIQUE} {_ISSUES}")
def fact_error_types(s, d):
    """Error types by the reference's rules: a missing confidence is an issue, but no omission."""
    return X.critique(views.facts(s, d)).select("seq", "error_types")


@query(f", {_CRITIQUE} select seq, coalesce(confidence, 'medium') as confidence, case when inverted then case when {_any('lower(metric)', dims.DOWN_TERMS)} then 'down' else 'up' end end as direction, case when inverted then case when {_any('lower(metric)', dims.DOWN_TERMS)} then -abs(number) else abs(number) end else number end as repaired from c")
def relation_inversion_repair(s, d):
    return X.repair(views.facts(s, d)).select("seq", "confidence", "direction", "repaired")


@query(f", {_CRITIQUE} select error_type, count(*) as n from (select 'numeric_typo' as error_type from c where bad union all select 'omission' from c where missing or unsure union all select 'relation_inversion' from c where inverted) group by 1")
def error_type_counts(s, d):
    return X.error_type_counts(views.facts(s, d), unsure="omission")  # as its SQL


@query("select min(seq) as seq, entity, metric, value, period from facts group by all")
def fact_signature_dedupe(s, d):
    return X.dedupe_facts(views.facts(s, d)).select("seq", "entity", "metric", "value", "period")


@query("select seq, case when contains(metric, 'owned by') then value else entity end as head, case when contains(metric, 'owned by') then 'owns' else metric end as relation, case when contains(metric, 'owned by') then entity else value end as tail, contains(metric, 'owned by') as healed from facts")
def ontology_heal(s, d):
    return X.heal_ownership(views.facts(s, d))


@query(f""", l as (select doc_id, metric, {_NUMBER} as v, seq from facts), w as (select doc_id, {', '.join(f"max_by(v, seq) filter (where metric = '{m}' and v is not null) as {n}" for m, n in (('revenue', 'r'), ('expenses', 'e'), ('net income', 'ni'), ('cost of goods sold', 'cg'), ('gross profit', 'gp')))} from l group by 1)
select doc_id, 0 as rule, ni as stated, r - e as computed from w where ni <> 0 and abs(r - e - ni) / abs(ni) > 0.01::double union all
select doc_id, 1, gp, r - cg from w where gp <> 0 and abs(r - cg - gp) / abs(gp) > 0.01::double""")
def symbolic_validation(s, d):
    return X.identity_mismatches(views.facts(s, d))


@query(f", {_SCORED} select node, coalesce(string_agg(concept, ',' order by concept), '') as concepts from nodes left join con using (node) group by 1")
def concept_match(s, d):
    return G.node_concepts(views.edges(s, d)).select("node", F.array_join("concepts", ",").alias("concepts"))


@query(f", {_SCORED} select distinct head_node, tail_node, mb as matrix_boost, label, sb as scm_boost, eq as equation, round(bias, 6) as bias from se")
def pair_modifiers(s, d):
    return G.pair_modifiers(views.edges(s, d)).select("head_node", "tail_node", "matrix_boost", "label", "scm_boost", "equation", _r(F.col("bias")).alias("bias"))


@query(f", {_SCORED} select seq, round(strength, 6) as strength, polarity, concat_ws(',', 'base_signal', case when boost > 1 then 'relation_weighted' end, case when label <> '' then label end, case when eq <> '' then 'scm_direct' end, case when bias <> 1 then 'dml_bias_corrected' end) as reasoning from se")
def edge_score(s, d):
    return G.score_edges(views.edges(s, d)).select("seq", _r(F.col("strength")).alias("strength"), "polarity", "reasoning")


@query(f", {_WEIGHTS} select head, tail, round(weight, 6) as weight, n_edges from dw")
def dynamic_weights(s, d):
    return G.dynamic_weights(views.edges(s, d), _at()).select("head", "tail", _r(F.col("weight")).alias("weight"), "n_edges")


@query(f", {_SCORED}, {_WEIGHTS}, {_CONSENSUS} select head, relation, tail, round(strength, 6) as strength, round(polarity, 6) as polarity, support_count from links")
def consensus(s, d):
    return K.skeleton(views.edges(s, d), _at()).select("head", "relation", "tail", _r(F.col("strength")).alias("strength"), _r(F.col("polarity")).alias("polarity"), "support_count")


@query(f", {_SCORED}, {_WEIGHTS}, {_CONSENSUS} select head, relation, tail, round(strength, 6) as strength from links order by round(strength, 6) desc, head, relation, tail limit 10")
def top_links(s, d):
    return consensus(s, d).select("head", "relation", "tail", "strength").orderBy(F.desc("strength"), "head", "relation", "tail").limit(10)


@query("select seq, round(greatest(0.05::double, least((case granularity when 'year' then 0.9::double when 'quarter' then 0.85::double when 'month' then 0.78::double else 0.7::double end) * 1.15::double * (1 + least(0.4::double, 0.4::double * reflection_quality)) * (1 + least(0.5::double, 6 * temporal_quality / 100)) * (1 + 0.15::double * 2 / 5) * (1 + 0.3::double * temporal_quality), 1::double)), 6) as velocity from edges")
def contagion_velocity(s, d):
    v = S.contagion_velocity(F.col("granularity"), F.lit(1), F.col("reflection_quality"), F.col("temporal_quality") / 100, F.lit(2.0), F.col("temporal_quality"))
    return views.edges(s, d).select("seq", _r(v).alias("velocity"))


@query("select n_name, round(least(1::double, 0.5::double + 0.4::double * n_regionkey / 5 + 0.6::double * n_nationkey / 25), 6) as weight from nation")
def market_weights(s, d):
    return s.read.parquet(f"{d}/nation.parquet").select("n_name", _r(S.market_weight(F.col("n_regionkey") / 5, F.col("n_nationkey") / 25)).alias("weight"))


@query("""select * from (with recursive e as (select user_id, row_number() over (partition by user_id order by event_id) as k, props as p, cast(event_id as varchar) as c from events),
ch as (select user_id, k, sha256(p || '|' || c || '|' || repeat('0', 64)) as h from e where k = 1 union all select e.user_id, e.k, sha256(e.p || '|' || e.c || '|' || ch.h) from ch join e on e.user_id = ch.user_id and e.k = ch.k + 1)
select user_id, max(k)::bigint as n_events, max_by(h, k) as head_hash from ch group by 1)""")
def hash_chain(s, d):
    return E.chain(_events(s, d).withColumn("c", F.col("event_id").cast("string")), "user_id", "event_id", "props", "c")


@query("select coalesce(event_type, 'unknown') as event_type, count(*) as n from events group by 1")
def compliance_counts(s, d):
    return _events(s, d).groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(F.count("*").alias("n"))


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) r from events) where r <= 3")
def tail_n(s, d):
    return E.tail(_events(s, d), "user_id", "event_id", 3).select("user_id", "event_id")


@query("select user_id, max_by(value, event_id) as value, max(event_id) as event_id from events group by 1")
def feed_latest(s, d):
    return _events(s, d).groupBy("user_id").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id"))


@query("select user_id, round(sum(value * 0.2::double * pow(0.8::double, k)), 4) as ewma from (select user_id, value, row_number() over (partition by user_id order by event_id desc) - 1 as k from events where value is not null and not isnan(value)) group by 1")
def ewma(s, d):
    return E.ewma(_events(s, d), "user_id", "event_id", "value").select("user_id", _r(F.col("ewma"), 4).alias("ewma"))


@query("select case_id, case when m >= 0.6::double or sm >= 1.5::double or hits >= 6 then 'Crisis' when m >= 0.3::double or hits >= 4 then 'High Volatility' else 'none' end as regime, hits from (select case_id, max(abs(temporal_quality / 4)) m, sum(abs(temporal_quality / 4)) sm, count(*) filter (where abs(temporal_quality / 4) >= 0.1::double) hits from edges group by 1)")
def regime_shift(s, d):
    return E.regime(views.edges(s, d), "case_id", F.col("temporal_quality") / 4, S.node_id(F.col("tail_node")))
