"""Patterns, word lists, thresholds and labels that results depend on.

They are plain data.  Every operator takes them as parameters with these as defaults.
"""

from __future__ import annotations

# Model-name normalization -------------------------------------------------

# Parameters inside a raw model name (sizes, numbers, dates, variants).  The empty branch
# before the last one is intended: matches of it are dropped, and the last branch never wins.
PARAMS_PATTERN = (
    r"(?i)("
    r"\bv?\d+(\.\d+)*(-[a-z0-9]+)?\b|"
    r"\b\d+[x]\d+[bB]\b|\b\d+[bB]\b|"
    r"\b[a-z]\d+[a-z]?\b|"
    r"\b(o\d|r\d|p\d|v\d)\b|"
    r"\d+o|"
    r"\b\d{4}-\d{2}(-\d{2})?\b|"
    r"\b\d{4,6}\b|"
    r"\b(instruct|chat|it|dpo|sonnet|haiku|pro|flash|mini|nano|preview|think|thinking|coder|"
    r"distill|latest|plus|max|large|medium|small|tiny|base|xl|ext|expanse|scout|maverick|"
    r"nemotron|oss|all-minilm|saba|turbo|light|a|b)\b|"
    r"|[-_]\d+([-_]\d+)*\b"
    r")"
)

# Ordered rules: first the pattern, then the family it stands for.
FAMILY_CORRECTIONS = [
    (r"^ge$", "gemini"),
    (r"^stral$", "mistral"),
    (r"^qwq$", "qwen"),
    (r"^o\d$", "gpt"),
    (r"^gpt.*", "gpt"),
    (r"^claude.*", "claude"),
    (r"^gemini.*", "gemini"),
    (r".*llama.*", "llama"),
    (r"^mistral.*", "mistral"),
    (r"^mixtral.*", "mixtral"),
    (r"^qwen.*", "qwen"),
    (r"^grok.*", "grok"),
    (r"^phi.*", "phi"),
    (r"^gemma.*", "gemma"),
    (r"^glm.*", "glm"),
    (r"^yi.*", "yi"),
    (r"^deepseek.*", "deepseek"),
    (r"^hermes.*", "hermes"),
    (r"^lfm.*", "lfm"),
    (r"^command.*", "command"),
    (r"^jamba.*", "jamba"),
]

JUNK_PREFIXES = ["javascript", "'", "<"]

BAD_NAMES = [
    "none",
    "w1yz2kxp7d2u4nxrw3x444c2otumic64ysqfi37",
    "wnnzokjptdouqnjri3j4q4y2atgm4cs4kscf53u",
]

# Columns dropped from or kept in the cleaned tables -------------------------

REACTION_DROPS = [
    "conversation_a", "conversation_b", "system_prompt", "question_id", "comment",
    "refers_to_conv_id", "response_content", "question_content", "timestamp", "msg_index",
    "opening_msg", "conv_turns", "session_hash", "msg_rank",
]

CONVERSATION_DROPS = [
    "conversation_a", "conversation_b", "conversation_pair_id", "conv_a_id", "conv_b_id",
    "session_hash", "model_pair_name",
]

VOTE_DROPS = ["conversation_a", "conversation_b"]

FEEDBACK_FLAGS = [
    "useful", "creative", "clear_formatting", "incorrect", "superficial",
    "instructions_not_followed",
]

ARENA_COLUMNS = [
    "base_model_a", "base_model_b", "version_a", "version_b", "chosen_base_model",
    "chosen_version", "both_equal", "conversation_a", "conversation_b", "opening_msg",
    "conv_turns", "selected_category", "timestamp", "conv_comments_a", "conv_comments_b",
    *[f"conv_{flag}_{side}" for flag in FEEDBACK_FLAGS for side in ("a", "b")],
]

BIAS_COLUMNS = [
    "base_model_a", "base_model_b", "conversation_a", "conversation_b", "opening_msg",
    "short_summary", "keywords", "categories", "languages", "visitor_id", "timestamp",
]

# Metrics ------------------------------------------------------------------

ALL_VERSIONS = "Tous"
CARBON_KG_PER_KWH = 0.057
MEAN_PICK_RATE = 3.7
BENCHMARK_DEFAULTS = {
    "useful": 0.2, "creative": 0.2, "clear_formatting": 0.2,
    "instructions_not_followed": 0.1, "incorrect": 0.1, "superficial": 0.1,
    "tokens": 500.0, "turns": 1.5,
}
BADGE_LABELS = {
    "useful": "Utile", "creative": "Créatif", "clear_formatting": "Clair",
    "instructions_not_followed": "Discipliné", "incorrect": "Précis", "superficial": "Fiable",
    "tokens": "Expert", "turns": "Captivant", "winrate": "Challenger", "reactions": "Populaire",
}
BADGE_WINRATE = 55.0
BADGE_REACTIONS = 500

# Corpus ---------------------------------------------------------------------

CULTURAL_STEMS = [
    "art", "peint", "sculpt", "musée", "histoire", "culture", "théâtre", "cinéma", "monument",
    "bibliothèque", "architec", "patrimoine", "archéolog", "littérature", "spectacle",
    "artiste", "auteur", "gothique", "baroque", "impressionn", "renaissance", "médiév",
    "château", "cathédrale", "abbaye", "exposition", "galerie",
]

# Characters a Python str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

MAX_DOCS = 2000
SAMPLE_SEED = 42
MAX_NAMES = 1500
ARTIST_MIN_LENGTH = 6
VENUE_MIN_LENGTH = 7
ARTIST_FACTOR = 0.01
VENUE_FACTOR = 0.005
ARTWORK_SCALE = 1.2
VENUE_SCALE = 1.5
TFIDF_MIN_DF = 2
TFIDF_MAX_DF = 0.85
TFIDF_MAX_FEATURES = 10_000
TOP_DISCRIMINANTS = 30
TOP_COMMUNS = 20

# Bias display -----------------------------------------------------------------

GAP_PAIR_LIMIT = 3.0
GAP_DOMAIN_LIMIT = 5.0
COVERAGE_GRADES = (60.0, 45.0)
SCORE_GRADES = (28.0, 35.0)
