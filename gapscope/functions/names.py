"""Column expressions over subset and model names (JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUBSET_RE = r"^(.+?)_(cs_en|cs|ca)$"
MIX_RE = r"^(.+?)_(cs_mix|en_mix)$"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subset_locale(subset="subset") -> Column:
    """'chinese_cs_en' -> 'chinese'; '' when the name has no known kind suffix."""
    return F.regexp_extract(col_(subset), SUBSET_RE, 1)


def subset_kind(subset="subset") -> Column:
    """'chinese_cs_en' -> 'cs_en'; '' when the name has no known kind suffix."""
    return F.regexp_extract(col_(subset), SUBSET_RE, 2)


def strip_cs_suffix(subset="subset") -> Column:
    """'greek_cs' / 'greek_cs_en' -> 'greek' (other names unchanged)."""
    return F.regexp_replace(col_(subset), r"_cs(_en)?$", "")


def model_slug(model="model") -> Column:
    """File slug of a model id for the MCQ result files: '/' -> '__'."""
    return F.replace(col_(model), F.lit("/"), F.lit("__"))


def qa_slug(model="model") -> Column:
    """File slug for the short-answer study: runs of other characters -> '_'."""
    return F.regexp_replace(col_(model), r"[^a-zA-Z0-9._-]+", "_")


def short_model_name(model="model") -> Column:
    """Last path segment with the fixed replace chain used for figure labels."""
    x = F.element_at(F.split(col_(model), "/"), -1)
    # Ordered (old, new) replacements.
    for old, new in [("Meta-Llama-", "Llama-"), ("-Instruction", "-it"),
                     ("-Instruct", "-it"), ("-Chat", "-chat"), ("-Base", "-base"),
                     ("-v1.5", "")]:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x
