"""Registered queries of the engine and the SQL that gives the same rows."""

from pyspark.sql import functions as F

from mentionlab.plans import deeper, landing, ops, study, text, view

_ALL = (study, text, ops, view, landing, deeper)

#: Digits of computed doubles in registered queries: two engines add floating-point numbers in different orders.
DIGITS = 9
_ARMS = ("p1", "p1_low", "p1_high", "p0", "p0_low", "p0_high", "diff", "diff_low", "diff_high", "ratio")
ROUNDED = {
    "two_arm_primary": _ARMS, "threshold_sweep": _ARMS, "incident_rollup": ("prop",), "by_make": ("rate",), "incident_level_summary": ("median", "mean", "share_half"), "outlet_rates": ("rate",), "leave_one_outlet_out": ("rate1", "rate0"),
    "register_rates": ("rate",), "narrative_cube": ("rate",), "odds_contrasts": ("log_or", "se", "chi", "p", "p_holm"), "permutation_p": ("p", "observed"), "cluster_bootstrap": ("low", "high"), "matched_discordance": ("odds_ratio", "low", "high"),
    "mann_whitney": ("z", "p"), "table_one": ("n_mean", "n_sd", "outlets_mean", "outlets_sd", "prop_mean", "prop_sd"), "power_grid": ("n_plain", "n_clustered"), "coder_kappa": ("exact", "kappa"), "agreement_by_variable": ("exact", "kappa"),
    "recall_by_entity": ("recall", "differential"), "two_arm_view": _ARMS, "harvest_stream": ("total",),
}
#: Sums of many large values keep fewer digits.
FEWER = {"harvest_stream": 4, "power_grid": 6}


def _rounded(name, query):
    columns, digits = ROUNDED[name], FEWER.get(name, DIGITS)
    return lambda spark, sf_dir: query(spark, sf_dir).withColumns({c: F.round(c, digits) for c in columns})


def queries() -> dict:
    found = {name: q for m in _ALL for name, (q, _) in m.QUERIES.items()}
    return {name: _rounded(name, q) if name in ROUNDED else q for name, q in found.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in _ALL:
        for name, (_, sql) in m.QUERIES.items():
            if sql and name in ROUNDED:
                digits = FEWER.get(name, DIGITS)
                sql = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in ROUNDED[name])}) FROM ({sql}) AS q"
            if sql:
                out[name] = sql
    return out
