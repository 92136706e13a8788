"""Reference tables: small dimensions that are broadcast by their known size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Results depend on them as they stand.
#: head, tail, multiplier, polarity, path label
MATRIX = [
    ("inflation", "policy_rate", 1.35, 1.0, "macro_policy"),
    ("policy_rate", "bond_yield", 1.3, 1.0, "rates_curve"),
    ("policy_rate", "discount_rate", 1.28, 1.0, "valuation_kernel"),
    ("policy_rate", "tech_valuation", 1.32, -1.0, "rates_duration"),
    ("discount_rate", "tech_valuation", 1.45, -1.0, "duration_risk"),
    ("bond_yield", "tech_valuation", 1.3, -1.0, "relative_multiple"),
    ("liquidity", "tech_valuation", 1.2, 1.0, "risk_on"),
    ("energy_price", "inflation", 1.22, 1.0, "cost_push"),
    ("unemployment", "policy_rate", 1.15, -1.0, "labor_slack"),
    ("labor_market_tightness", "inflation", 1.25, 1.0, "wage_pressure"),
    ("usd_strength", "exports", 1.18, -1.0, "fx_translation"),
    ("fiscal_stimulus", "consumer_spending", 1.3, 1.0, "demand_boost"),
    ("revenue_growth", "earnings_growth", 1.2, 1.0, "fundamental"),
    ("earnings_growth", "equity_valuation", 1.24, 1.0, "multiple_expansion"),
    ("risk_premium", "equity_valuation", 1.35, -1.0, "risk_discount"),
    ("credit_spread", "equity_valuation", 1.23, -1.0, "financing_stress"),
    ("gpu_demand", "hbm_demand", 1.45, 1.0, "ai_hardware_chain"),
    ("hbm_demand", "hbm_supply", 1.35, -1.0, "supply_tightness"),
    ("hbm_supply", "gpu_production", 1.4, 1.0, "component_bottleneck"),
    ("gpu_production", "ai_server_shipment", 1.3, 1.0, "system_integration"),
    ("ai_capex", "gpu_demand", 1.5, 1.0, "investment_cycle"),
    ("ai_capex", "cloud_revenue", 1.25, 1.0, "monetization_lag"),
    ("foundry_capacity", "gpu_production", 1.38, 1.0, "manufacturing_base"),
    ("chip_inventory", "gpu_pricing", 1.22, -1.0, "inventory_cycle"),
    ("oil_price", "transport_cost", 1.25, 1.0, "energy_link"),
    ("transport_cost", "cpi", 1.15, 1.0, "supply_side_inflation"),
    ("supply_chain_bottleneck", "cpi", 1.28, 1.0, "bottleneck_inflation"),
    ("geopolitical_risk", "oil_price", 1.4, 1.0, "geopolitical_premium"),
    ("geopolitical_risk", "geopolitical_stability", 1.5, -1.0, "risk_stability_tradeoff"),
]
#: head, tail, direct effect, noise sigma, domain, equation
SCM = [
    ("energy_price", "inflation", 1.12, 0.18, "macro", "inflation_t = a0 + 0.55 * energy_price_t + eps_t"),
    ("inflation", "policy_rate", 1.18, 0.16, "macro_policy", "policy_rate_t = b0 + 0.62 * inflation_t + eps_t"),
    ("policy_rate", "bond_yield", 1.1, 0.14, "rates_curve", "bond_yield_t = c0 + 0.70 * policy_rate_t + eps_t"),
    ("policy_rate", "tech_valuation", 1.22, 0.22, "equity_duration", "tech_valuation_t = d0 - 0.48 * policy_rate_t + eps_t"),
    ("revenue_growth", "earnings_growth", 1.08, 0.2, "fundamentals", "earnings_growth_t = e0 + 0.67 * revenue_growth_t + eps_t"),
    ("earnings_growth", "equity_valuation", 1.09, 0.21, "equity_pricing", "equity_valuation_t = f0 + 0.44 * earnings_growth_t + eps_t"),
    ("credit_spread", "equity_valuation", 1.07, 0.2, "financial_conditions", "equity_valuation_t = g0 - 0.35 * credit_spread_t + eps_t"),
    ("ai_capex", "gpu_demand", 1.25, 0.15, "ai_investment", "gpu_demand_t = h0 + 0.85 * ai_capex_t + eps_t"),
    ("gpu_demand", "hbm_demand", 1.3, 0.1, "hardware_coupling", "hbm_demand_t = i0 + 0.92 * gpu_demand_t + eps_t"),
]
#: names of each concept
ALIASES = {
    "inflation": ("inflation", "cpi", "ppi", "price level", "price pressure",),
    "consumer_spending": ("consumer spending", "consumption", "retail sales", "household spending",),
    "policy_rate": ("policy rate", "fed funds", "interest rate", "fed policy", "rate hike", "rate cut",),
    "fed_dot_plot": ("fed dot plot", "dot plot", "fomc dot plot", "rate expectations", "rate path",),
    "quantitative_tightening": ("quantitative tightening", "qt", "balance sheet runoff",),
    "reverse_repo_balance": ("reverse repo balance", "rrp balance", "reverse repo", "on rrp",),
    "bank_term_funding": ("bank term funding", "btfp", "term funding facility",),
    "bond_yield": ("bond yield", "treasury yield", "10y yield", "real yield",),
    "discount_rate": ("discount rate", "cost of capital", "wacc",),
    "tech_valuation": ("tech valuation", "growth multiple", "tech multiple", "software multiple", "nasdaq",),
    "equity_valuation": ("equity valuation", "market valuation", "price target", "valuation",),
    "liquidity": ("liquidity", "money supply", "qe", "quantitative easing",),
    "energy_price": ("energy price", "oil", "gas price", "brent", "wti", "crude",),
    "labor_market_tightness": ("labor market tightness", "tight labor market", "job openings", "quit rate", "wage pressure",),
    "supply_chain_bottleneck": ("supply chain bottleneck", "port congestion", "input shortages", "logistics disruption",),
    "fiscal_stimulus": ("fiscal stimulus", "government spending", "tax cuts", "stimulus checks",),
    "unemployment": ("unemployment", "jobless", "labor market slack",),
    "usd_strength": ("usd", "dollar index", "dxy", "strong dollar",),
    "exports": ("exports", "export demand", "trade balance",),
    "revenue_growth": ("revenue growth", "sales growth", "topline",),
    "earnings_growth": ("earnings_growth", "eps growth", "profit growth",),
    "risk_premium": ("risk premium", "equity risk premium", "term premium",),
    "credit_spread": ("credit spread", "high yield spread", "corporate spread",),
    "gpu_demand": ("gpu demand", "h100 demand", "b200 demand", "ai chip demand", "accelerator demand",),
    "hbm_demand": ("hbm demand", "high bandwidth memory demand", "hbm3e", "hbm4",),
    "hbm_supply": ("hbm supply", "hbm capacity", "hbm yield",),
    "gpu_production": ("gpu production", "chip output", "wafer starts",),
    "ai_server_shipment": ("ai server", "dgx", "server shipment",),
    "ai_capex": ("ai capex", "ai investment", "data center spend", "compute spend",),
    "cloud_revenue": ("cloud revenue", "azure", "aws", "gcp", "cloud growth",),
    "foundry_capacity": ("foundry capacity", "tsmc capacity", "4nm", "3nm", "coos",),
    "chip_inventory": ("chip inventory", "semiconductor inventory", "channel stock",),
    "gpu_pricing": ("gpu pricing", "chip prices", "asp",),
    "oil_price": ("oil price", "crude oil", "wti price", "brent price",),
    "transport_cost": ("shipping cost", "freight rates", "logistics cost",),
    "geopolitical_risk": ("geopolitical tension", "war risk", "trade war", "sanctions",),
    "geopolitical_stability": ("geopolitical stability", "de-escalation", "diplomatic stability", "regional stability",),
}
CAUSAL_TERMS = ("drives", "causes", "raises", "tightens", "expands", "accelerates", "improves")
WEAK_TERMS = ("correlates", "relates", "tracks", "mentions")
INVERSE_TERMS = ("reduces", "suppresses", "compresses", "decreases", "inverse", "offsets", "hurts")
DOWN_TERMS = ("decrease", "decline", "down", "drop", "reduce", "compressed")
UP_TERMS = ("increase", "rise", "up", "grow", "expanded", "improved")
BROAD_CONCEPTS = ("inflation", "policy_rate", "liquidity", "geopolitical_risk")
DRIVER_LABELS = ("macro", "policy", "rates", "liquidity", "inflation", "energy")
#: target metric, component metrics, operation
IDENTITIES = [
    ("net income", ("revenue", "expenses"), "difference"),
    ("gross profit", ("revenue", "cost of goods sold"), "difference"),
    ("total assets", ("current assets", "non-current assets"), "sum"),
    ("total assets", ("total liabilities", "total equity"), "sum"),
]
#: The markets' regions.
MARKETS = ("us", "eu", "jp", "kr", "cn")
#: source, target, strength, channel
MARKET_LINKS = [
    ("us", "eu", 0.65, "rates"),
    ("us", "jp", 0.55, "rates"),
    ("us", "kr", 0.45, "rates"),
    ("cn", "kr", 0.75, "supply_chain"),
    ("cn", "jp", 0.40, "supply_chain"),
    ("eu", "us", 0.35, "credit"),
]

#: node that triggers it, action, its effect
ACTIONS = [
    ("policy_rate", "act:refinance_debt", -0.15),
    ("operating_margin", "act:supply_chain_hedge", 0.08),
    ("chip_inventory", "act:inventory_liquidation", -0.12),
    ("usd_strength", "act:currency_hedging", -0.1),
    ("ai_capex", "act:capex_postponement", -0.18),
    ("transport_cost", "act:working_capital_release", -0.09),
]
#: names of each value in a feed's payload, the first that is a number counts
FEED_KEYS = {
    "dot_plot_change": ("dot_plot_change", "dot_plot_delta", "dot_plot_shift", "dot_plot_surprise", "fomc_dot_plot_change"),
    "policy_rate": ("policy_rate", "fed_funds", "effective_fed_funds", "ffr"),
    "policy_rate_change": ("policy_rate_change", "fed_funds_change", "ffr_change", "policy_rate_delta"),
    "rate_expectation_change": ("rate_expectation_change", "futures_rate_change", "ois_change", "rate_path_change"),
    "qt_pace": ("qt_pace", "balance_sheet_runoff", "qt_runoff"),
    "rrp_balance": ("rrp_balance", "reverse_repo_balance", "rrp"),
    "bank_term_funding": ("bank_term_funding", "btfp_balance"),
    "liquidity_index": ("liquidity_index", "liquidity_stress"),
}
ACTION_WORDS = ("strategy", "plan", "hedging", "refinance", "restructure", "expand", "reduce cost")
PROOF_FIELDS = {"groth16": ("pi_a", "pi_b", "pi_c"), "plonk": ("a", "b", "c", "z", "t1", "t2", "t3")}


def concept_names() -> list[tuple[str, str]]:
    """(concept, name): each alias and the concept's own id."""
    return [(c, n) for c, names in ALIASES.items() for n in (*names, c)]


def common_drivers() -> list[tuple[str, str]]:
    """(head, tail) concepts that a macro driver of the matrix both reaches."""
    macro = {h for h, _, _, _, label in MATRIX if any(t in label for t in DRIVER_LABELS)} | set(BROAD_CONCEPTS)
    reach = [(h, t) for h, t, *_ in MATRIX if h in macro]
    return sorted({(a, b) for d, a in reach for e, b in reach if d == e})


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(rows: list[tuple]) -> str:
    """The rows as a SQL VALUES list, for the equivalents in SQL."""
    show = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::double"
    return "(values " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"
