"""Scoring generated text: choice extraction (C8) and the short-answer study
(C11-C14, A4, A5).  All regex work is JVM-side ``regexp_*``; word boundaries
and whitespace are written as explicit Unicode classes so the meaning does
not depend on the engine's ``\\b`` / ``\\s`` flavour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapscope.functions.names import col_

# Unicode whitespace as Python's str.strip()/\s see it.
WS = r"[\t\n\x{0B}\x{0C}\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WORD = r"[^\p{L}\p{N}_]"
LINE_BREAK = r"[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"

# Characters trimmed around a short answer, refusal patterns.
TRIM_CHARS = " \t\r\n\"'“”‘’.,;:!?，。；：！？"
SENTENCE_END = "。！？.!?"
IDK_EN = r"i\s*don't\s*know|i\s*do\s*not\s*know|not\s*sure|cannot\s*answer|can't\s*answer"
IDK_ZH = "不知道|不确定|无法确定|无法回答|不能确定"
IDK_WORDS = ["idk", "unknown"]
PAIR_EN = ("china", "nepal")
PAIR_ZH = ("中国", "尼泊尔")


def _cls(chars: str) -> str:
    return "[" + "".join("\\" + c if c in "\\]^-[" else c for c in chars) + "]"


def strip_ws(c) -> Column:
    return F.regexp_replace(col_(c), f"^{WS}+|{WS}+$", "")


def extract_choice(text="text", options: str = "ABCDE") -> Column:
    """First standalone option letter; else the first character if it is
    an option; else ''."""
    t = strip_ws(text)
    first = F.regexp_extract(t, f"(?:^|{NOT_WORD})([{options}])(?:$|{NOT_WORD})", 1)
    head = F.substring(t, 1, 1)
    return F.when(first != "", first).when(head.isin(*list(options)), head).otherwise(F.lit(""))


def normalize_text(c) -> Column:
    s = strip_ws(c)
    trim = _cls(TRIM_CHARS)
    s = F.regexp_replace(s, f"^{trim}+|{trim}+$", "")
    return F.regexp_replace(s, f"{WS}+", " ")


def short_answer(generation="generation") -> Column:
    """C11: strip; drop a leading 'assistant:'/'answer:'; first line; cut at the
    first sentence mark (even inside '3.14'); normalise."""
    g = strip_ws(generation)
    g = strip_ws(F.regexp_replace(g, f"(?i)^(assistant|answer){WS}*[:：]{WS}*", ""))
    first = strip_ws(F.regexp_extract(g, f"^[^{LINE_BREAK[1:-1]}]*", 0))
    first = strip_ws(F.regexp_extract(first, f"^[^{SENTENCE_END}]*", 0))
    return normalize_text(first)


def is_abstention(ans="answer") -> Column:
    """Empty, an English or Chinese refusal, or 'idk' / 'unknown'."""
    a = strip_ws(ans)
    en = IDK_EN.replace(r"\s", WS)
    return ((a == "") | a.rlike(f"(?i)(?:^|{NOT_WORD})(?:{en})(?:$|{NOT_WORD})")
            | a.rlike(IDK_ZH) | F.lower(a).isin(*IDK_WORDS))


def match_any(ans="answer", golds="answers", answer_type="answer_type", empty_matches: bool = True) -> Column:
    """Normalised, case-folded; a gold matches when either contains the
    other.  'pair' also accepts China+Nepal in either language.  With
    ``empty_matches`` (the study's behaviour) an empty answer matches any
    non-empty gold."""
    a = F.lower(normalize_text(ans))
    hit = F.exists(col_(golds), lambda g: (F.lower(normalize_text(g)) != "")
                   & (a.contains(F.lower(normalize_text(g))) | F.lower(normalize_text(g)).contains(a)))
    if not empty_matches:
        hit = hit & (a != "")
    pair = ((a.contains(PAIR_EN[0]) & a.contains(PAIR_EN[1]))
            | (col_(ans).contains(PAIR_ZH[0]) & col_(ans).contains(PAIR_ZH[1])))
    return F.coalesce(hit | (F.coalesce(col_(answer_type), F.lit("entity")) == "pair") & pair, F.lit(False))


def score_short_answers(responses: DataFrame, empty_matches: bool = True) -> DataFrame:
    """C11-C14: answer_extracted, correct, is_idk, hallucination_like per response.

    ``responses``: (model, id, category, lang, generation, answers, answer_type).
    """
    df = responses.withColumn("answer_extracted", short_answer("generation"))
    df = df.withColumns({
        "correct": match_any("answer_extracted", "answers", "answer_type", empty_matches),
        "is_idk": is_abstention("answer_extracted"),
    })
    return df.withColumn("hallucination_like", ~F.col("correct") & ~F.col("is_idk"))


def qa_cells(scored: DataFrame) -> DataFrame:
    """A4: per (model, category, lang): n, accuracy, hallucination-like rate, cell key."""
    n = F.count(F.lit(1))
    return scored.groupBy("model", "category", "lang").agg(
        n.alias("n"), (F.count_if("correct") / n).alias("accuracy"),
        (F.count_if("hallucination_like") / n).alias("hallucination_like_rate"),
    ).withColumn("cell", F.concat_ws("__", "category", "lang"))


def qa_did(cells: DataFrame) -> DataFrame:
    """A5: (EN_global - ZH_global) - (EN_local - ZH_local) for accuracy and the
    hallucination-like rate; a missing cell counts 0.0; present cells listed."""
    def cell(c, metric):
        return F.coalesce(F.max(F.when(F.col("cell") == c, F.col(metric))), F.lit(0.0))

    def did(metric):
        return ((cell("global__en", metric) - cell("global__zh", metric))
                - (cell("local_cn__en", metric) - cell("local_cn__zh", metric)))
    return cells.groupBy("model").agg(
        did("accuracy").alias("did_accuracy"),
        did("hallucination_like_rate").alias("did_hallucination_like_rate"),
        F.array_join(F.sort_array(F.collect_set("cell")), ",").alias("cells_present"))
