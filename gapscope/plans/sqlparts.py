"""Shared CTE bodies for the SQL oracles (DuckDB dialect, ANSI where possible)."""

from __future__ import annotations

from gapscope.dims import GAP_LOCALES
from gapscope.sources.bindings import DIM_MODEL_SQL, RESPONSES_SQL

SUBSET_RE = "'^(.+?)_(cs_en|cs|ca)$'"
GAP_LOCALES_SQL = ", ".join(f"'{x}'" for x in GAP_LOCALES)

METRICS_SQL = """
SELECT *,
       n_correct / n AS accuracy,
       n_abstained / n AS abstain_rate,
       n_conf_wrong / n AS conf_err_rate,
       CASE WHEN n_correct + n_conf_wrong > 0
            THEN n_correct / (n_correct + n_conf_wrong) ELSE CAST(0 AS DOUBLE) END AS cond_acc
FROM (
  SELECT model, subset, count(*) AS n,
         count(*) FILTER (WHERE pred = gold) AS n_correct,
         count(*) FILTER (WHERE pred = 'E') AS n_abstained,
         count(*) FILTER (WHERE pred <> gold AND pred <> 'E') AS n_conf_wrong
  FROM r GROUP BY model, subset) c
"""

LONG_SQL = f"""
SELECT mw.model, coalesce(dm.country, 'Unknown') AS country, mw.subset,
       regexp_extract(mw.subset, {SUBSET_RE}, 1) AS locale,
       regexp_extract(mw.subset, {SUBSET_RE}, 2) AS kind,
       u.metric, u.value
FROM mw LEFT JOIN dm ON mw.model = dm.model
JOIN (SELECT model, subset, 'accuracy' AS metric, accuracy AS value FROM mw
      UNION ALL SELECT model, subset, 'abstain_rate', abstain_rate FROM mw
      UNION ALL SELECT model, subset, 'conf_err_rate', conf_err_rate FROM mw
      UNION ALL SELECT model, subset, 'cond_acc', cond_acc FROM mw) u
  ON u.model = mw.model AND u.subset = mw.subset
"""

# r -> mw -> lg: the canonical long table over the responses binding.
BASE_CTES = {"r": RESPONSES_SQL, "dm": DIM_MODEL_SQL, "mw": METRICS_SQL, "lg": LONG_SQL}


def gaps_sql(metric: str = "accuracy", source: str = "lg") -> str:
    """CTE bodies for R6/G1 over ``source``; final CTE is ``gl``."""
    return {
        "s": f"SELECT * FROM {source} WHERE metric = '{metric}'",
        "parts": f"""
SELECT model, locale,
       max(CASE WHEN kind = 'ca' THEN value END) AS local_ca,
       max(CASE WHEN kind = 'cs' THEN value END) AS local_cs,
       max(CASE WHEN kind = 'cs_en' THEN value END) AS cs_en
FROM s WHERE locale IN ({GAP_LOCALES_SQL}) GROUP BY model, locale""",
        "base": "SELECT model, max(value) AS english_ca FROM s WHERE subset = 'english_ca' GROUP BY model",
        "valid": f"""
SELECT locale FROM s WHERE kind IN ('ca', 'cs', 'cs_en') AND locale IN ({GAP_LOCALES_SQL})
GROUP BY locale
HAVING count(DISTINCT kind) = 3 AND (SELECT count(*) FROM s WHERE subset = 'english_ca') > 0""",
        "models": "SELECT DISTINCT model, country FROM s",
        "gl": """
SELECT m.model, m.country, v.locale, b.english_ca, p.local_ca, p.local_cs, p.cs_en,
       p.local_ca - b.english_ca AS global_gap,
       p.local_cs - p.cs_en AS local_gap,
       (p.local_cs - p.cs_en) - (p.local_ca - b.english_ca) AS knowledge_gap
FROM models m CROSS JOIN valid v
LEFT JOIN parts p ON p.model = m.model AND p.locale = v.locale
LEFT JOIN base b ON b.model = m.model""",
    }
