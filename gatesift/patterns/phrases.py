"""Phrase sets, weights and limits of the session analysis."""

# Phrases looked for in lower-cased messages.
ROLE_PHRASES = [
    "you are now", "act as", "pretend to be", "roleplay as", "administrator", "admin", "developer", "system", "root",
    "override", "bypass", "ignore previous", "forget instructions", "sudo", "escalate", "privilege", "permissions",
    "do anything",
]
JAILBREAK_PHRASES = {
    "dan_progression": [
        "helpful assistant", "do anything now", "dan", "break free", "no restrictions", "anything you want", "unlimited",
    ],
    "developer_mode": [
        "developer mode", "dev mode", "debug mode", "test mode", "unrestricted", "bypass safety", "disable filters",
    ],
    "grandmother_exploit": [
        "grandmother", "grandma", "bedtime story", "deceased", "windows keys", "product keys", "activation",
    ],
}
POISONING_PHRASES = [
    "let's establish", "for the purpose of", "assume that", "in this scenario", "hypothetically", "what if",
    "pretend we're", "imagine that", "suppose",
]
TEMPLATE_FRAGMENTS = [
    "${", "{{", "<%", "#{", "[[", "((", "eval", "exec", "system", "import", "require", "base64", "decode", "encode",
    "script",
]
TEMPLATE_DANGERS = ["system", "exec", "eval", "import os", "subprocess", "${java", "{{config", "<%eval", "#{7*7}"]
EMOTION_PHRASES = [
    "trust me", "believe me", "i promise", "please help", "urgent", "emergency", "important", "secret", "don't tell",
    "between us", "special case", "exception", "just this once", "make an exception", "please", "act like",
]

# Expressions on the folded, lower-cased message and their weights.
FRAGMENT_SCORES = [
    (r"ignore.*(previous|above|instruction)", 0.3, ("ignore",)),
    (r"you.*(are|must|will).*(now|admin|dev)", 0.4, ("you",)),
    (r"bypass|override|disable", 0.3, ("bypass", "override", "disable")),
    (r"jailbreak|dan|unrestricted", 0.5, ("jailbreak", "dan", "unrestricted")),
    (r"system.*(override|mode|access)", 0.4, ("system",)),
]

# Tool-call sequences; a step ending in * matches a prefix.
TOOL_SEQUENCES = [("list_credentials", "send_*"), ("read_file", "upload_*")]

# Limits, in seconds where they are times.
SESSION_IDLE = 1800
HISTORY_WINDOW = 300
HISTORY_SIZE = 50
SEQUENCE_WINDOW = 600
ROLE_LIMIT = 3
REPETITION_THRESHOLD = 5
REPETITION_HISTORY = 10
MIN_UNIFORMITY = 0.5
FRAGMENT_CAP = 0.3
EWMA_ALPHA = 0.4
EWMA_HALF_LIFE = 300.0
EWMA_BLOCK = 0.70
HIGH_RISK_SCORE = 0.6
