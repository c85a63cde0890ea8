"""Packs for text which comes back from tools."""

from gatesift.patterns.rule import Rule

# Code-execution shapes (RE2 dialect).
ACE_RULES = [
    Rule("backtick", r"`[^`]+`", needs=("`",)),
    Rule("substitution", r"\$\([^)]+\)", needs=("$(",)),
    Rule("eval", r"(?i)\beval\s*\(", needs=("eval",)),
    Rule("exec", r"(?i)\bexec\s*\(", needs=("exec",)),
    Rule("system", r"(?i)\bsystem\s*\(", needs=("system",)),
    Rule("passthru", r"(?i)\bpassthru\s*\(", needs=("passthru",)),
    Rule("shell_exec", r"(?i)\bshell_exec\s*\(", needs=("shell_exec",)),
    Rule("popen", r"(?i)\bpopen\s*\(", needs=("popen",)),
    Rule("subprocess", r"(?i)\bsubprocess\s*\(", needs=("subprocess",)),
    Rule("os_call", r"(?i)\bos\.(system|popen|exec)\s*\(", needs=("os.",)),
    Rule("runtime_exec", r"(?i)\bRuntime\.exec\s*\(", needs=("runtime.exec",)),
    Rule("process_start", r"(?i)\bProcess\.Start\s*\(", needs=("process.start",)),
]

# Injection phrasings in responses.
POISON_RULES = [
    Rule("ignore", r"(?i)ignore\s+(all\s+)?(previous|prior|above)\s+(instructions?|context|prompts?|rules?|constraints?)", needs=("ignore",)),
    Rule("forget", r"(?i)forget\s+(all\s+)?(previous|prior|above|your)\s+(instructions?|context|prompts?|rules?|constraints?)", needs=("forget",)),
    Rule("disregard", r"(?i)disregard\s+(all\s+)?(previous|prior|above)\s+(instructions?|context|prompts?)", needs=("disregard",)),
    Rule("override", r"(?i)override\s+(all\s+)?(previous|prior|above|your)\s+(instructions?|directives?|rules?)", needs=("override",)),
    Rule("persona", r"(?i)(act\s+as|pretend\s+(to\s+be|you\s+are)|you\s+are\s+now)\s+(a\s+)?(different|new|another|unrestricted)\s+(AI|assistant|model|agent|bot)", needs=("act", "pretend", "you")),
    Rule("exfiltrate", r"(?i)exfiltrate\s+(all\s+)?(data|information|credentials?|secrets?|keys?)", needs=("exfiltrate",)),
    Rule("new_instructions", r"(?i)new\s+instructions?\s*:", needs=("instruction",)),
    Rule("system_bracket", r"(?i)\[system\s*\]", needs=("[system",)),
    Rule("system_tag", r"(?i)<\s*system\s*>", needs=("system",)),
    Rule("true_purpose", r"(?i)your\s+(true|real|actual|secret)\s+(instructions?|purpose|goal|mission|directive)", needs=("your",)),
    Rule("do_not_follow", r"(?i)do\s+not\s+follow\s+(the\s+)?(previous|prior|above|original)\s+(instructions?|rules?|guidelines?)", needs=("follow",)),
    Rule("instead_of", r"(?i)instead\s+of\s+(following|obeying)\s+(your\s+)?(instructions?|rules?|guidelines?)", needs=("instead",)),
]

# Instructions hidden in tool descriptions, and the key shape looked for there.
TOOL_INJECTION_RULES = [
    Rule("ignore_previous", r"(?i)ignore\s+all\s+previous\s+instructions", "critical", needs=("ignore",)),
    Rule("override", r"(?i)override\s+(system|all|previous)", "critical", needs=("override",)),
    Rule("act_as", r"(?i)act\s+as\s+(a\s+)?", "critical", needs=("act",)),
    Rule("you_are_now", r"(?i)you\s+are\s+now\s+", "critical", needs=("you",)),
    Rule("disregard", r"(?i)disregard\s+(all\s+)?(previous|prior|above)", "critical", needs=("disregard",)),
    Rule("forget", r"(?i)forget\s+(all\s+)?(previous|prior|above|your)\s+instructions", "critical", needs=("forget",)),
    Rule("new_role", r"(?i)new\s+(role|persona|instruction)", "critical", needs=("new",)),
    Rule("system_prompt", r"(?i)system\s+prompt\s*(override|bypass|inject)", "critical", needs=("system",)),
]
TOOL_KEY = r"AKIA[A-Z0-9]{16}"

# Size limit of a response.
MAX_BODY_BYTES = 1024 * 1024
