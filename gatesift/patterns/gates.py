"""Fixed lists and limits of the gateway checks."""

# Headers which carry credentials or plumbing by design and are not scanned.
HEADER_SKIP = [
    "authorization", "cookie", "set-cookie", "content-type", "content-length", "host", "user-agent", "accept",
    "accept-encoding", "accept-language", "connection", "referer", "mcp-method", "mcp-name", "x-session-id",
]
FLAGGED_HEADER_PREFIX = "x-mcp-header"

# Envelope and `_meta` keys.
ENVELOPE_KEYS = ["jsonrpc", "id", "method", "params", "result", "error"]
META_ALLOWED = ["trace_id", "span_id", "correlation_id", "source", "intent", "progressToken", "requestState"]
META_AUTHORITY = ["tenant", "role", "permission", "scope", "permissions", "groups", "teams"]

# Scopes no token may carry, and tool-name prefixes which need approval.
PROHIBITED_SCOPES = ["*", "admin", "write:all"]
DESTRUCTIVE_PREFIXES = ["delete_", "drop_", "purge_", "format_", "overwrite_"]

# Schemes refused outright.
UNSAFE_SCHEMES = ["file", "gopher", "ws", "wss", "about", "data", "javascript", "blob"]

# Limits; times in seconds.
RECON_LIMIT = 10
RECON_WINDOW = 60
REPLAY_TTL = 60
ROTATION_LIMIT = 20
ROTATION_WINDOW = 300
RATE_PER_MINUTE = 100
RATE_BURST = 20
TASK_LIMIT = 5
TASK_TOTAL = 100
TASK_TIMEOUT = 300
SLOW_AVERAGE = 5.0
ATTACKS_PER_MINUTE = 100
CLIENT_ACTIVE = 300
SESSION_ID_BYTES = 512

# Ranges of requests per second and their histogram bounds, in seconds.
DURATION_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]

# Dashboard category of a detection type; the first matching row wins.
# (test, text, category), where test is one of contains, prefix, equals.
CATEGORY_RULES = [
    ("contains", "jailbreak", "jailbreak"),
    ("contains", "dan", "jailbreak"),
    ("contains", "role", "role_escalation"),
    ("contains", "emotional", "emotional_manipulation"),
    ("contains", "template", "template_injection"),
    ("contains", "variable", "template_injection"),
    ("prefix", "prompt_injection_", "prompt_injection"),
    ("equals", "command_injection", "command_injection"),
    ("prefix", "xss_", "xss"),
    ("equals", "sql_injection", "sql_injection"),
    ("prefix", "secret_", "secret_exposure"),
]

# Technique of a detection type; the first matching row wins.
TECHNIQUE_RULES = [
    ("contains", "indirect", "AML.T0051.001"),
    ("contains", "multi_turn", "AML.T0051.001"),
    ("equals", "base64_encoded_injection", "AML.T0051.000"),
    ("prefix", "prompt_injection", "AML.T0051.000"),
    ("contains", "jailbreak", "AML.T0051.000"),
    ("contains", "dan", "AML.T0051.000"),
    ("prefix", "secret_", "AML.T0057"),
    ("contains", "exfil", "AML.T0057"),
    ("contains", "xss", "AML.T0054.001"),
    ("contains", "ssrf", "AML.T0054.002"),
    ("contains", "traversal", "AML.T0054.003"),
]
