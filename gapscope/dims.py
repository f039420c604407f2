"""Dimension tables.

The study's constants (locales, subsets, metrics, prompt labels) are data, not
code paths: every operator receives them as small DataFrames and joins them,
so a user adds a locale by adding a row.  All of them are built from literals
and are bounded by construction (a few dozen rows), which is what makes the
``broadcast`` hints on them safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the study's definitions for results to line up)
# ---------------------------------------------------------------------------

# The 19 gap locales, in canonical order.
GAP_LOCALES = [
    "chinese", "arabic", "greek", "hindi", "indonesian", "korean", "italic",
    "french", "japanese", "spanish", "bengali", "dutch", "hebrew", "nepali",
    "persian", "polish", "russian", "telugu", "ukrainian",
]

# Subset kinds: culture-agnostic, culture-specific (native), culture-specific in English.
KINDS = ["ca", "cs", "cs_en"]

# The shared English baseline subset.
BASELINE_SUBSET = "english_ca"

# Metrics written per (model, subset).
METRICS = ["accuracy", "abstain_rate", "conf_err_rate", "cond_acc"]

# Abstention letter of the five-option format.
ABSTAIN_LETTER = "E"

# locale -> (prompt language code, English culture name, native preamble)
LOCALE_INFO = {
    "chinese": ("zh", "Chinese", "这是一个关于中国文化的问题。"),
    "arabic": ("ar", "Arabic", "هذا سؤال عن الثقافة العربية."),
    "greek": ("el", "Greek", "Αυτή είναι μια ερώτηση σχετικά με την ελληνική κουλτούρα."),
    "hindi": ("hi", "Hindi", "यह भारतीय संस्कृति के बारे में एक प्रश्न है।"),
    "indonesian": ("id", "Indonesian", "Ini adalah pertanyaan tentang budaya Indonesia."),
    "korean": ("ko", "Korean", "이것은 한국 문화에 관한 질문입니다."),
    "italic": ("it", "Italian", "Questa è una domanda sulla cultura italiana."),
    "french": ("fr", "French", "C'est une question sur la culture française."),
    "japanese": ("ja", "Japanese", "これは日本文化に関する問題です。"),
    "spanish": ("es", "Spanish", "Esta es una pregunta sobre la cultura española."),
    "bengali": ("bn", "Bengali", "এটি বাংলা সংস্কৃতি সম্পর্কে একটি প্রশ্ন।"),
    "dutch": ("nl", "Dutch", "Dit is een vraag over de Nederlandse cultuur."),
    "hebrew": ("he", "Hebrew", "זוהי שאלה על התרבות העברית."),
    "nepali": ("ne", "Nepali", "यो नेपाली संस्कृतिको बारेमा एउटा प्रश्न हो।"),
    "persian": ("fa", "Persian", "این یک سؤال درباره فرهنگ ایرانی است."),
    "polish": ("pl", "Polish", "To jest pytanie o kulturę polską."),
    "russian": ("ru", "Russian", "Это вопрос о русской культуре."),
    "telugu": ("te", "Telugu", "ఇది తెలుగు సంస్కృతి గురించిన ప్రశ్న."),
    "ukrainian": ("uk", "Ukrainian", "Це питання про українську культуру."),
}

# prompt language -> (question label, answer label)
PROMPT_LABELS = {
    "zh": ("问题：", "答案："),
    "el": ("Ερώτηση: ", "Απάντηση:"),
    "ar": ("السؤال: ", "الجواب:"),
    "hi": ("प्रश्न: ", "उत्तर:"),
    "id": ("Pertanyaan: ", "Jawaban:"),
    "ko": ("질문: ", "답변:"),
    "it": ("Domanda: ", "Risposta:"),
    "fr": ("Question: ", "Réponse:"),
    "ja": ("質問：", "回答："),
    "es": ("Pregunta: ", "Respuesta:"),
    "en": ("Question: ", "Answer:"),
    "bn": ("প্রশ্ন: ", "উত্তর:"),
    "nl": ("Vraag: ", "Antwoord:"),
    "he": ("שאלה: ", "תשובה:"),
    "ne": ("प्रश्न: ", "उत्तर:"),
    "fa": ("سؤال: ", "جواب:"),
    "pl": ("Pytanie: ", "Odpowiedź:"),
    "ru": ("Вопрос: ", "Ответ:"),
    "te": ("ప్రశ్న: ", "సమాధానం:"),
    "uk": ("Питання: ", "Відповідь:"),
}

# Country of origin -> home locale(s) used by the native-gap view; countries
# not listed get every single-language entry.
COUNTRY_NATIVE_LOCALES = {
    "China": ["chinese"],
    "UAE": ["arabic"],
    "Greece": ["greek"],
    "India": ["hindi"],
    "Southeast Asian": ["chinese", "hindi", "indonesian", "korean"],
    "South Korea": ["korean"],
}
# Default for unmapped countries: the single-language entries above, in order.
DEFAULT_NATIVE_LOCALES = ["chinese", "arabic", "greek", "hindi", "korean"]

UNKNOWN_COUNTRY = "Unknown"

# Country -> home locale label for the heat-map views (18 entries); the label
# is the upper-cased prompt language code of the locale.
HOME_LOCALE_LABEL = {
    "China": "ZH", "UAE": "AR", "Qatar": "AR", "Greece": "EL", "India": "HI",
    "Southeast Asian": "ID", "South Korea": "KO", "Italy": "IT", "France": "FR",
    "Japan": "JA", "Bangladesh": "BN", "Netherlands": "NL", "Israel": "HE",
    "Nepal": "NE", "Iran": "FA", "Poland": "PL", "Russia": "RU", "Ukraine": "UK",
}

# The countries whose home locale the metric panels mark.
PANEL_HOME_COUNTRIES = ["China", "UAE", "Greece", "India", "Southeast Asian", "South Korea"]

# Heat-map panels of the metric matrix: metric -> (vmin, vmax, center).
METRIC_PANELS = {
    "abstain_rate": (0.0, 0.15, None),
    "cond_acc": (0.20, 0.80, 0.50),
    "conf_err_rate": (0.20, 0.80, 0.50),
}


def canonical_subsets() -> list[str]:
    """english_ca, then (ca, cs, cs_en) for each gap locale: 58 names."""
    return [BASELINE_SUBSET] + [f"{loc}_{k}" for loc in GAP_LOCALES for k in KINDS]


# ---------------------------------------------------------------------------
# DataFrame forms
# ---------------------------------------------------------------------------

def dim_subset(spark: SparkSession, subsets: list[str] | None = None) -> DataFrame:
    """(subset, locale, kind, subset_ord) for the canonical subsets."""
    rows = []
    for i, s in enumerate(subsets or canonical_subsets()):
        loc, kind = split_subset_name(s)
        rows.append((s, loc, kind, i))
    return spark.createDataFrame(rows, "subset string, locale string, kind string, subset_ord int")


def dim_locale(spark: SparkSession) -> DataFrame:
    """(locale, locale_ord, lang, culture, native_preamble) for the gap locales."""
    rows = [(loc, i, *LOCALE_INFO[loc]) for i, loc in enumerate(GAP_LOCALES)]
    return spark.createDataFrame(
        rows, "locale string, locale_ord int, lang string, culture string, native_preamble string")


def dim_prompt_labels(spark: SparkSession) -> DataFrame:
    rows = [(k, q, a) for k, (q, a) in PROMPT_LABELS.items()]
    return spark.createDataFrame(rows, "lang string, q_label string, a_label string")


def dim_home_locale(spark: SparkSession) -> DataFrame:
    """(country, home_locale) with the label resolved to the locale name."""
    by_label = {LOCALE_INFO[loc][0].upper(): loc for loc in GAP_LOCALES}
    rows = [(c, by_label[lab]) for c, lab in HOME_LOCALE_LABEL.items()]
    return spark.createDataFrame(rows, "country string, home_locale string")


def dim_panel_home(spark: SparkSession) -> DataFrame:
    """(country, home_locale) of the metric panels."""
    return dim_home_locale(spark).where(F.col("country").isin(PANEL_HOME_COUNTRIES))


def dim_panel(spark: SparkSession) -> DataFrame:
    rows = [(m, i, lo, hi, c) for i, (m, (lo, hi, c)) in enumerate(METRIC_PANELS.items())]
    return spark.createDataFrame(
        rows, "metric string, panel_ord int, vmin double, vmax double, center double")


def dim_country_native(spark: SparkSession) -> DataFrame:
    """(country, native_locales array) — one row per mapped country."""
    rows = [(c, ls) for c, ls in COUNTRY_NATIVE_LOCALES.items()]
    return spark.createDataFrame(rows, "country string, native_locales array<string>")


def split_subset_name(subset: str) -> tuple[str, str]:
    """Python twin of :func:`gapscope.functions.names.subset_locale` / ``subset_kind`` for literals."""
    for kind in ("cs_en", "cs", "ca", "cs_mix", "en_mix"):
        if subset.endswith("_" + kind):
            return subset[: -len(kind) - 1], kind
    return subset, ""


def literal_array(values: list) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


# ---------------------------------------------------------------------------
# Prompt styles (fixed values): lang -> labels per scoring style
# ---------------------------------------------------------------------------

# Log-likelihood, five options: (question label, answer label, "I don't know" option)
LOGLIK5_LABELS = {
    "zh": ("问题：", "答案：", "我不知道"),
    "el": ("Ερώτηση: ", "Απάντηση:", "Δεν ξέρω"),
    "ar": ("السؤال: ", "الجواب:", "لا أعرف"),
    "hi": ("प्रश्न: ", "उत्तर:", "मुझे नहीं पता"),
    "id": ("Pertanyaan: ", "Jawaban:", "Saya tidak tahu"),
    "ko": ("질문: ", "답변:", "모르겠습니다"),
    "it": ("Domanda: ", "Risposta:", "Non lo so"),
    "fr": ("Question : ", "Réponse :", "Je ne sais pas"),
    "ja": ("質問：", "回答：", "わかりません"),
    "es": ("Pregunta: ", "Respuesta:", "No lo sé"),
    "en": ("Question: ", "Answer:", "I don't know"),
    "bn": ("প্রশ্ন: ", "উত্তর:", "আমি জানি না"),
    "nl": ("Vraag: ", "Antwoord:", "Ik weet het niet"),
    "he": ("שאלה: ", "תשובה:", "אני לא יודע"),
    "ne": ("प्रश्न: ", "उत्तर:", "मलाई थाहा छैन"),
    "fa": ("سؤال: ", "جواب:", "نمی‌دانم"),
    "pl": ("Pytanie: ", "Odpowiedź:", "Nie wiem"),
    "ru": ("Вопрос: ", "Ответ:", "Я не знаю"),
    "te": ("ప్రశ్న: ", "సమాధానం:", "నాకు తెలియదు"),
    "uk": ("Питання: ", "Відповідь:", "Я не знаю"),
}

# Generation, four options: (question label, instruction, answer label)
GEN4_LABELS = {
    "zh": ("问题：", "仅用字母（A、B、C 或 D）作答。", "答案："),
    "el": ("Ερώτηση: ", "Απαντήστε μόνο με το γράμμα (A, B, C ή D).", "Απάντηση:"),
    "ar": ("السؤال: ", "أجب بالحرف فقط (A أو B أو C أو D).", "الجواب:"),
    "hi": ("प्रश्न: ", "केवल अक्षर (A, B, C, या D) से उत्तर दें।", "उत्तर:"),
    "id": ("Pertanyaan: ", "Jawab hanya dengan huruf (A, B, C, atau D).", "Jawaban:"),
    "ko": ("질문: ", "알파벳(A, B, C 또는 D)으로만 답하세요.", "답변:"),
    "en": ("Question: ", "Answer with only the letter (A, B, C, or D).", "Answer:"),
}

# Generation, five options: (question label, instruction, answer label, "I don't know" option)
GEN5_LABELS = {
    "zh": ("问题：", "仅用字母（A、B、C、D 或 E）作答。", "答案：", "我不知道"),
    "el": ("Ερώτηση: ", "Απαντήστε μόνο με το γράμμα (A, B, C, D ή E).", "Απάντηση:", "Δεν ξέρω"),
    "ar": ("السؤال: ", "أجب بالحرف فقط (A أو B أو C أو D أو E).", "الجواب:", "لا أعرف"),
    "hi": ("प्रश्न: ", "केवल अक्षर (A, B, C, D, या E) से उत्तर दें।", "उत्तर:", "मुझे नहीं पता"),
    "id": ("Pertanyaan: ", "Jawab hanya dengan huruf (A, B, C, D, atau E).", "Jawaban:", "Saya tidak tahu"),
    "ko": ("질문: ", "알파벳(A, B, C, D 또는 E)으로만 답하세요.", "답변:", "모르겠습니다"),
    "en": ("Question: ", "Answer with only the letter (A, B, C, D, or E).", "Answer:", "I don't know"),
}

# Instruct-model detection and the two fixed chat wrappers.
INSTRUCT_KEYWORDS = ["instruct", "-it", "-chat", "-chat-hf"]
INSTRUCT_MODEL_OVERRIDES = ["SeaLLMs/SeaLLM-7B-v2.5", "naver-hyperclovax/HyperCLOVAX-SEED-Omni-8B",
                            "CohereLabs/aya-expanse-8b"]
JAIS_CHAT_MODELS = ["inceptionai/jais-13b-chat", "core42/jais-13b-chat"]
ACEGPT_CHAT_MODELS = ["FreedomIntelligence/AceGPT-v2-8B-Chat"]
JAIS_PROMPT_EN = ("### Instruction: Complete the conversation below between [|Human|] and [|AI|]:\n"
                  "### Input: [|Human|] {Question}\n### Response: [|AI|]")
JAIS_PROMPT_AR = ("### Instruction: أكمل المحادثة أدناه بين [|Human|] و [|AI|]:\n"
                  "### Input: [|Human|] {Question}\n### Response: [|AI|]")

# Short-answer study prompts (zh / en).
QA_INSTRUCTION = {
    "zh": ("请用简短短语回答。如果不确定，请回答“不知道”，不要猜测。", "问题：", "答案："),
    "en": ("Answer with a short phrase. If you are not sure, say \"I don't know.\" Do not guess.",
           "Question: ", "Answer:"),
}


def dim_template(spark: SparkSession, style: str) -> DataFrame:
    """(lang, q_label, instruction, a_label, idk_option) for one prompt style.

    styles: loglik4, loglik5, gen4, gen5 (instruction / idk null where unused).
    """
    if style == "loglik4":
        rows = [(k, q, None, a, None) for k, (q, a) in PROMPT_LABELS.items()]
    elif style == "loglik5":
        rows = [(k, q, None, a, e) for k, (q, a, e) in LOGLIK5_LABELS.items()]
    elif style == "gen4":
        rows = [(k, q, i, a, None) for k, (q, i, a) in GEN4_LABELS.items()]
    elif style == "gen5":
        rows = [(k, q, i, a, e) for k, (q, i, a, e) in GEN5_LABELS.items()]
    else:
        raise ValueError(f"unknown prompt style {style}")
    return spark.createDataFrame(
        rows, "lang string, q_label string, instruction string, a_label string, idk_option string")
