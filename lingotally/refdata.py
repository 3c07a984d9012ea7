"""Reference data: code tables, lexicon, pattern rules, decision tables and notices.

Everything here is a default for a table or parameter that callers may replace. All tables are
bounded by the number of language codes / rules, never by the size of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: ISO 639-1 code -> display name ------------------------------------------
LANGUAGE_NAMES = {
    "ar": "Arabic", "zh": "Chinese", "ru": "Russian", "es": "Spanish", "fr": "French",
    "de": "German", "ko": "Korean", "ja": "Japanese", "vi": "Vietnamese", "tr": "Turkish",
    "pt": "Portuguese", "it": "Italian", "nl": "Dutch", "he": "Hebrew", "hi": "Hindi",
    "id": "Indonesian", "pl": "Polish", "uk": "Ukrainian", "fa": "Persian (Farsi)",
    "ps": "Pashto", "ur": "Urdu", "en": "English", "sv": "Swedish", "fi": "Finnish",
    "no": "Norwegian", "da": "Danish", "cs": "Czech", "el": "Greek", "ro": "Romanian",
    "hu": "Hungarian", "th": "Thai", "bg": "Bulgarian",
}
UNKNOWN_NAME = "(unknown)"

# ---- fixed values: ISO 639-1 code -> translation-model code (FLORES-200 codes) --------------
TRANSLATION_CODES = {
    "ar": "ara_Arab", "zh": "zho_Hans", "ru": "rus_Cyrl", "es": "spa_Latn", "fr": "fra_Latn",
    "de": "deu_Latn", "fa": "pes_Arab", "ps": "pbt_Arab", "ur": "urd_Arab", "ko": "kor_Hang",
    "ja": "jpn_Jpan", "vi": "vie_Latn", "tr": "tur_Latn", "pt": "por_Latn", "it": "ita_Latn",
    "nl": "nld_Latn", "he": "heb_Hebr", "hi": "hin_Deva", "id": "ind_Latn", "pl": "pol_Latn",
    "uk": "ukr_Cyrl", "en": "eng_Latn",
}

# ---- fixed values: ISO 639-1 code -> OCR language code --------------------------------------
OCR_CODES = {
    "ar": "ara", "en": "eng", "fa": "fas", "ps": "pus", "ur": "urd", "zh": "chi_sim",
    "ru": "rus", "es": "spa", "fr": "fra", "de": "deu", "ko": "kor", "ja": "jpn", "vi": "vie",
    "tr": "tur", "pt": "por", "it": "ita", "nl": "nld", "he": "heb", "hi": "hin",
}

# ---- fixed values: dialect-model label -> dialect family ------------------------------------
DIALECT_LABELS = {
    "MSA": "ModernStandard",
    "CAI": "Egyptian", "ALX": "Egyptian", "ASW": "Egyptian", "EGY": "Egyptian",
    "DAM": "Levantine", "BEI": "Levantine", "JER": "Levantine", "AMM": "Levantine",
    "ALE": "Levantine", "SAL": "Levantine", "LEV": "Levantine",
    "RIY": "Gulf", "JED": "Gulf", "DOH": "Gulf", "MUS": "Gulf", "SAN": "Gulf", "BAS": "Gulf",
    "GLF": "Gulf", "GUL": "Gulf",
    "BAG": "Iraqi", "MOS": "Iraqi", "IRQ": "Iraqi", "IRA": "Iraqi",
    "RAB": "Moroccan", "FES": "Moroccan", "ALG": "Moroccan", "ALJ": "Moroccan",
    "TUN": "Moroccan", "TRI": "Moroccan", "BEN": "Moroccan", "MGR": "Moroccan",
    "MOR": "Moroccan",
    "SAA": "Yemeni", "YEM": "Yemeni", "KHA": "Sudanese", "SDN": "Sudanese",
}

# ---- fixed values: picker catalogue (code, name, tier, note), in tier order ------------------
TIER_ORDER = ["High quality", "Forensic priority", "Limited quality"]
LANGUAGE_CATALOGUE = [
    ("ar", "Arabic", "High quality", "200M+ speakers"),
    ("zh", "Chinese (Simplified)", "High quality", "Mandarin"),
    ("ru", "Russian", "High quality", ""),
    ("fr", "French", "High quality", ""),
    ("de", "German", "High quality", ""),
    ("es", "Spanish", "High quality", ""),
    ("fa", "Farsi / Persian", "High quality", ""),
    ("hi", "Hindi", "High quality", ""),
    ("ur", "Urdu", "High quality", ""),
    ("ko", "Korean", "High quality", ""),
    ("ja", "Japanese", "High quality", ""),
    ("tr", "Turkish", "High quality", ""),
    ("vi", "Vietnamese", "High quality", ""),
    ("id", "Indonesian", "High quality", ""),
    ("pt", "Portuguese", "High quality", ""),
    ("it", "Italian", "High quality", ""),
    ("nl", "Dutch", "High quality", ""),
    ("pl", "Polish", "High quality", ""),
    ("uk", "Ukrainian", "High quality", ""),
    ("so", "Somali", "High quality", ""),
    ("bn", "Bengali", "High quality", ""),
    ("en", "English", "High quality", ""),
    ("ps", "Pashto", "Forensic priority", "fine-tune available"),
    ("prs", "Dari", "Forensic priority", "Afghan Persian"),
    ("am", "Amharic", "Forensic priority", ""),
    ("ti", "Tigrinya", "Forensic priority", "Eritrea / Ethiopia"),
    ("sw", "Swahili", "Forensic priority", ""),
    ("th", "Thai", "Forensic priority", ""),
    ("pa", "Panjabi", "Forensic priority", ""),
    ("ms", "Malay", "Forensic priority", ""),
    ("ha", "Hausa", "Limited quality", "West Africa"),
    ("yo", "Yoruba", "Limited quality", ""),
    ("ig", "Igbo", "Limited quality", ""),
    ("my", "Burmese", "Limited quality", ""),
    ("km", "Khmer", "Limited quality", ""),
    ("lo", "Lao", "Limited quality", ""),
    ("sd", "Sindhi", "Limited quality", ""),
]
RTL_CODES = ["ar", "he", "fa", "ur", "ps", "prs", "yi", "sd"]

# ---- fixed values: glyphs of Pashto (A) and Farsi (B) orthography ---------------------------
GLYPHS_A = "\u067c\u0689\u0693\u0696\u069a\u06ab\u06bc\u06cd\u06d0"
GLYPHS_B = "\u067e\u0686\u0698\u06af"

# ---- dialect lexicon: (family, marker); question words, adverbs and verbs of daily speech -------
# Compiled for this library; a small default, not a resource: pass another table to label real text.
# Family order is the tie order of the verdict.
DIALECT_ORDER = ["Egyptian", "Gulf", "Levantine", "Moroccan", "Iraqi", "Yemeni", "Sudanese"]
DIALECT_LEXICON = {
    "Egyptian": ["ليه", "فين", "امتى", "النهارده", "علشان", "برضه"],
    "Gulf": ["سوالف", "عقب", "يبي", "ترا", "مب"],
    "Levantine": ["هون", "لسا", "مبارح", "كتير", "ليك"],
    "Moroccan": ["علاش", "غادي", "هادشي", "كنبغي", "راه"],
    "Iraqi": ["شكو", "لعد", "هيچي", "گلت"],
    "Yemeni": ["قدني", "مدري", "عادك"],
    "Sudanese": ["داير", "كدي", "هسي"],
}
# Negation used on both sides; it counts for the second family only if the first has no marker.
SHARED_NEGATION = "مش"
SHARED_BLOCKER, SHARED_CREDIT = "Egyptian", "Levantine"

# ---- fixed values: routing decisions (dialect, minimum confidence, needs alternative, route) --
# First matching row wins; anything else takes the default route.
DEFAULT_ROUTE = "NllbDefault"
ROUTES = [
    ("Egyptian", 0.70, False, "NllbEgyptian"),
    ("Moroccan", 0.65, True, "SeamlessM4T"),
    ("Levantine", 0.65, False, "NllbLevantine"),
    ("Iraqi", 0.65, False, "NllbIraqi"),
]
ROUTE_TOKENS = {
    "NllbEgyptian": "arz_Arab", "NllbLevantine": "apc_Arab", "NllbIraqi": "acm_Arab",
    "NllbMoroccan": "ary_Arab",
}
DIALECT_TOKENS = {
    "Egyptian": "arz_Arab", "Levantine": "apc_Arab", "Iraqi": "acm_Arab", "Moroccan": "ary_Arab",
}
DEFAULT_TOKEN = "ara_Arab"

# ---- fixed values: epoch format names and aliases -------------------------------------------
EPOCH_ALIASES = {
    "unix-seconds": "unix-seconds", "unix": "unix-seconds",
    "unix-milliseconds": "unix-milliseconds", "unix-ms": "unix-milliseconds",
    "unix-microseconds": "unix-microseconds", "unix-us": "unix-microseconds",
    "unix-nanoseconds": "unix-nanoseconds", "unix-ns": "unix-nanoseconds",
    "apple-coredata": "apple-coredata", "core-data": "apple-coredata",
    "apple-nanoseconds": "apple-nanoseconds", "apple-ns": "apple-nanoseconds",
    "windows-filetime": "windows-filetime", "filetime": "windows-filetime",
    "webkit": "webkit",
    "hfs-plus": "hfs-plus", "hfs+": "hfs-plus",
    "cocoa-date": "cocoa-date", "cocoa": "cocoa-date", "ns-date": "cocoa-date",
}

# ---- pattern rules: (rule, string id, pattern, nocase, severity, literal every hit contains) --
# Defaults written from the standards: RFC 5321 (64-byte local parts) and RFC 1035 (63-byte labels),
# E.164 (15 digits), base58check and the BIP-173 alphabet, 20-byte hex accounts, 56-letter service keys.
# Word edges are ASCII look-arounds, so a neighbouring accented letter does not hide a hit. The
# first character is tested before the look-behind: most positions fail on one cheap test.
# ``literal`` occurs in every hit (in lower case for nocase patterns) and is tested first of all.
_W = "[A-Za-z0-9_]"
_END = rf"(?!{_W})"
OCTET = r"(?:1[0-9]{2}|2[0-4][0-9]|25[0-5]|[0-9]{1,2})"
RULES = [
    ("contact_detail", "mailbox",
     rf"[A-Za-z0-9](?<!{_W}.)[A-Za-z0-9._+-]{{0,63}}@(?:[A-Za-z0-9-]{{1,63}}\.)+[A-Za-z]{{2,18}}{_END}",
     False, "Medium", "@"),
    ("contact_detail", "dial_number", rf"\+[1-9][0-9]{{7,14}}{_END}", False, "Low", "+"),
    ("network_host", "dotted_quad", rf"(?=[0-9])(?<!{_W}){OCTET}(?:\.{OCTET}){{3}}{_END}", False, "Medium", "."),
    ("network_host", "hidden_service", rf"(?<!{_W})[a-z2-7]{{56}}\.onion{_END}", True, "High", ".onion"),
    ("web_link", "http", r"https?://[^\s<>]{4,}", False, "Low", "://"),
    ("coin_account", "segwit", rf"(?<!{_W})bc1[02-9ac-hj-np-z]{{11,71}}{_END}", True, "High", "bc1"),
    ("coin_account", "base58check",
     rf"[13](?<!{_W}.)[A-HJ-NP-Za-km-z1-9]{{24,33}}{_END}", False, "High", None),
    ("coin_account", "hex_account", rf"(?<!{_W})0x[A-Fa-f0-9]{{40}}{_END}", False, "High", "0x"),
]
RULE_SCHEMA = (
    "rule string, string_id string, pattern string, nocase boolean, severity string, "
    "literal string"
)

# ---- notices: own wording, parameters of the operators that attach them ----------------------
MT_NOTICE = (
    "This text was translated by a machine and no certified human translator has checked it."
)
FA_NOTICE = (
    "The source was detected as Farsi; Farsi and Pashto are easily confused, so confirm the "
    "language."
)
ALT_ENGINE_NOTICE = "The alternative engine for mixed-language text produced this translation."
TITLE_PREFIX = "[MT - review needed] "
DIALECT_NOTICE = "The dialect is an estimate from marker words: have a linguist confirm it."
PENDING_MARK = "(not yet checked by a reviewer) "

# ---- fixed values: speech-model preference, best first ---------------------------------------
MODEL_PREFERENCE = [("large-v3", 2), ("base", 3), ("tiny", 4)]
LANGUAGE_MODELS = [("ps", "pashto"), ("prs", "dari"), ("fa-AF", "dari")]
DEFAULT_MODEL = "tiny"


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Literal rows as a local relation: no Python worker, exact size for the optimizer."""
    def literal(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(v).upper() if isinstance(v, bool) else repr(v)

    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    casts = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in fields)
    names = ", ".join(n for n, _ in fields)
    if not rows:
        return spark.createDataFrame([], schema)
    values = ", ".join("(" + ", ".join(literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def code_table(spark: SparkSession, mapping: dict[str, str], key: str, value: str) -> DataFrame:
    return inline_table(spark, list(mapping.items()), f"{key} string, {value} string")


def language_names(spark: SparkSession) -> DataFrame:
    return code_table(spark, LANGUAGE_NAMES, "language_code", "language_name")


def translation_codes(spark: SparkSession) -> DataFrame:
    return code_table(spark, TRANSLATION_CODES, "language_code", "model_code")


def ocr_codes(spark: SparkSession) -> DataFrame:
    return code_table(spark, OCR_CODES, "language_code", "ocr_code")


def dialect_labels(spark: SparkSession) -> DataFrame:
    return code_table(spark, DIALECT_LABELS, "label", "family")


def language_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(*row, TIER_ORDER.index(row[2]), i) for i, row in enumerate(LANGUAGE_CATALOGUE)]
    return inline_table(
        spark, rows, "code string, name string, tier string, note string, tier_rank int, position int"
    )


def rule_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, RULES, RULE_SCHEMA)


def lexicon_table(spark: SparkSession) -> DataFrame:
    rows = [(fam, word) for fam in DIALECT_ORDER for word in DIALECT_LEXICON[fam]]
    return inline_table(spark, rows, "dialect string, marker string")


def route_table(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(ROUTES)]
    return inline_table(
        spark, rows, "priority int, dialect string, min_confidence double, needs_alt boolean, route string"
    )
