"""Scoring of model responses (C-series).

Inputs are response tables produced elsewhere (generated text, or option
log-probabilities / logits); nothing here runs a model.  All scoring is
column expressions or per-response aggregates keyed by the response id, so
it scales with the response table and never gathers a group into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.dims import ABSTAIN_LETTER
from gapscope.functions.names import col_
from gapscope.operators.shortqa import strip_ws


def normalize_gold(c="answer") -> Column:
    """``strip().upper()`` — Unicode whitespace, not only spaces."""
    return F.upper(strip_ws(c))


def score_choice(df: DataFrame, pred="pred", gold="gold", abstain: str = ABSTAIN_LETTER) -> DataFrame:
    """Correct / abstained / confidently wrong flags.

    An unparsed prediction ('' or null) is neither correct nor an abstention,
    so it counts as confidently wrong.
    """
    p = F.coalesce(col_(pred), F.lit(""))
    g = col_(gold)
    return df.withColumns({
        "correct": F.coalesce(p == g, F.lit(False)),
        "abstained": p == F.lit(abstain),
        "conf_wrong": F.coalesce((p != g) & (p != F.lit(abstain)), F.lit(True)),
    })
