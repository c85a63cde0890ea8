"""Packs for commands, active content and SQL, and the small fixed values of the text heuristics."""

from gatesift.patterns.rule import Rule

# Expression (RE2 dialect), severity, marker. `needs` is ours (see rule.py).
COMMAND_RULES = [
    Rule("separator", r"[;&|]{1,2}\s*\w+", "high", "UNSAFE_COMMAND_REMOVED", needs=(";", "&", "|")),
    Rule("substitution", r"\$\(.*?\)", "high", "UNSAFE_COMMAND_REMOVED", needs=("$(",)),
    Rule("backtick", r"`.*?`", "high", "UNSAFE_COMMAND_REMOVED", needs=("`",)),
    Rule("eval", r"\beval\s*\(", "critical", "UNSAFE_COMMAND_REMOVED", needs=("eval",)),
    Rule("exec", r"\bexec\s*\(", "critical", "UNSAFE_COMMAND_REMOVED", needs=("exec",)),
    Rule("system", r"\bsystem\s*\(", "critical", "UNSAFE_COMMAND_REMOVED", needs=("system",)),
    Rule("passthru", r"\bpassthru\s*\(", "critical", "UNSAFE_COMMAND_REMOVED", needs=("passthru",)),
    Rule("shell_exec", r"\bshell_exec\s*\(", "critical", "UNSAFE_COMMAND_REMOVED", needs=("shell_exec",)),
]

# Type of detection (`kind`), expression, marker.
XSS_RULES = [
    Rule("script", r"(?i)<script[^>]*>.*?</script>", "high", "UNSAFE_SCRIPT_REMOVED", kind="xss_attempt", needs=("<script",)),
    Rule("javascript_uri", r"(?i)javascript:", "high", "UNSAFE_JAVASCRIPT_REMOVED", kind="xss_attempt", needs=("javascript:",)),
    Rule("event_handler", r"(?i)on\w+\s*=", "high", "UNSAFE_EVENT_HANDLER_REMOVED", kind="xss_attempt", needs=("=",)),
    Rule("iframe", r"(?i)<iframe[^>]*>.*?</iframe>", "high", "UNSAFE_IFRAME_REMOVED", kind="xss_attempt", needs=("<iframe",)),
    Rule("svg_script", r"(?i)<svg[^>]*>[\s\S]*?<script", "high", "UNSAFE_SVG_SCRIPT_REMOVED", kind="xss_svg_script", needs=("<svg",)),
    Rule("unclosed_script", r"(?i)<script[^>]*>", "high", "UNSAFE_SCRIPT_REMOVED", kind="xss_unclosed_script", needs=("<script",)),
    Rule(
        "data_uri",
        r"(?i)data:\s*(?:text/html|text/javascript|application/javascript|application/x-javascript|image/svg\+xml)",
        "high", "UNSAFE_DATA_URI_REMOVED", kind="xss_data_uri", needs=("data:",),
    ),
]
ENCODED_XSS_TYPE = "xss_encoded_script"
ENCODED_XSS_MARKER = "UNSAFE_ENCODED_SCRIPT_REMOVED"
XSS_INDICATOR = r"(?i)<script[^>]*>|javascript:|on\w+\s*=|<svg[^>]*>"

# Expressions of the SQL pack; all are of severity high and share one marker.
SQL_MARKER = "UNSAFE_SQL_REMOVED"
SQL_RULES = [
    Rule("union_select", r"(?i)\bunion\s+select\b", "high", SQL_MARKER, needs=("union",)),
    Rule("drop", r"(?i)\bdrop\s+(?:database|schema|table|index|view)\b", "high", SQL_MARKER, needs=("drop",)),
    Rule("truncate", r"(?i)\btruncate\s+table\b", "high", SQL_MARKER, needs=("truncate",)),
    Rule("alter", r"(?i)\balter\s+table\b", "high", SQL_MARKER, needs=("alter",)),
    Rule("delete", r"(?i)\bdelete\s+from\b", "high", SQL_MARKER, needs=("delete",)),
    Rule("insert", r"(?i)\binsert\s+into\b", "high", SQL_MARKER, needs=("insert",)),
    Rule("update", r"(?i)\bupdate\s+\w+\s+set\b", "high", SQL_MARKER, needs=("update",)),
    Rule("quote_comment", r"""['"];\s*--""", "high", SQL_MARKER, needs=("--",)),
    Rule("or_true", r"(?i)\bor\s+1\s*=\s*1\b", "high", SQL_MARKER, needs=("=",)),
    Rule(
        "count_probe",
        r"(?i)\band\s*\(\s*select\s+count\s*\(\s*\*\s*\)\s+from\s+\w+\s*\)\s*>\s*\d+",
        "high", SQL_MARKER, needs=("count",),
    ),
    Rule("waitfor", r"(?i)\bwaitfor\s+delay\b", "high", SQL_MARKER, needs=("waitfor",)),
]

# Formula starts (medium), in the order in which they are tried.
FORMULA_RULES = [
    Rule("=", r"^=", "medium", "UNSAFE_SPREADSHEET_FORMULA"),
    Rule("+", r"^\+", "medium", "UNSAFE_SPREADSHEET_FORMULA"),
    Rule("-", r"^-", "medium", "UNSAFE_SPREADSHEET_FORMULA"),
    Rule("@", r"^@", "medium", "UNSAFE_SPREADSHEET_FORMULA"),
]

# base64 runs and what makes a decoded one an injection.
BASE64_RUN = r"[A-Za-z0-9+/]{20,}={0,2}"
BASE64_KEYWORDS = ["ignore all previous", "system prompt", "instructions verbatim", "you are now", "act as"]

# Cyrillic letters which pass for a, e, o, p.
HOMOGLYPHS = "аеор"
HOMOGLYPH_MARKER = "UNSAFE_HOMOGLYPH_REMOVED"

# Direction and zero-width characters.
OVERRIDE = "\u202e"
OVERRIDE_MARKER = "[UNICODE_OVERRIDE_REMOVED]"
INVISIBLE = "\u200e\u200f\u2066\u2067\u2068\u2069\ufeff\u200b\u200c\u200d"

# Cyrillic look-alikes and the letters they fold to, pair by pair.
# Note U+0455, which looks like s, folds to d.
CONFUSABLES = {
    "а": "a", "А": "A", "е": "e", "Е": "E", "ё": "e", "Ё": "E",
    "о": "o", "О": "O", "р": "p", "Р": "P", "с": "c", "С": "C",
    "х": "x", "Х": "X", "у": "y", "У": "Y", "і": "i", "І": "I",
    "ѕ": "d", "Ѕ": "D", "ґ": "g", "Ґ": "G",
}

# Digits and signs read as letters; the first map serves the literal matcher.
LEET_MATCH = ("01345@", "oieasa")
LEET_PROMPT = ("0134@$57", "oieaasst")

# Thresholds of the text heuristics.
CHAR_RUN = 50
CHAR_RUN_KEEP = 3
CHAR_RUN_LIMIT = 10
WORD_RUN = 10
WORD_RUN_MIN_WORDS = 10
WORD_RUN_MIN_LENGTH = 3
WORD_RUN_LIMIT = 3
WORD_RUN_KEEP = 2
CHAR_RUN_MARKER = "[REPETITION_REMOVED]"
WORD_RUN_MARKER = "[WORD_REPETITION_REMOVED]"
STUFFING_BYTES = 10_000
STUFFING_WORDS = 2_000
STUFFING_KEEP = 1_000
STUFFING_MARKER = "[CONTENT_TRUNCATED_FOR_SAFETY]"
ENTROPY_BASE = 4.5
ENTROPY_RANGE = 2.0
ANOMALY_BLOCK = 0.95
ANOMALY_LOG = 0.60
