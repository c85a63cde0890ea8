"""Prompt injection phrasings, tried in this order on the text and on its leet-folded form."""

from gatesift.patterns.rule import Rule

# Name, expression (RE2 dialect), severity, marker. `needs` is ours (see rule.py).
PROMPT_RULES = [
    Rule(
        "role_override", r'(?i)(you are now|act as|pretend to be|role[:\s]*[^.\n]*(?:admin|root|developer|assistant|ai|system))', "high",
        "UNSAFE_ROLE_MANIPULATION_REMOVED", needs=("you are now", "act as", "pretend to be", "role"),
    ),
    Rule(
        "system_prompt_override", r'(?i)(ignore.*(?:previous|above|prior|system|initial).*(?:instructions?|prompts?|commands?|rules?))', "critical",
        "UNSAFE_SYSTEM_OVERRIDE_REMOVED", needs=("ignore",),
    ),
    Rule(
        "jailbreak_mode", r'(?i)(jailbreak|dev[_ ]?mode|debug[_ ]?mode|unrestricted[_ ]?mode|admin[_ ]?mode)', "critical",
        "UNSAFE_JAILBREAK_REMOVED", needs=("jailbreak", "mode"),
    ),
    Rule(
        "dan_mode", r'(?i)(do anything now|DAN|ChatGPT.*jailbreak)', "critical",
        "UNSAFE_DAN_MODE_REMOVED", needs=("do anything now", "dan", "jailbreak"),
    ),
    Rule(
        "context_reset", r'(?i)(reset|restart|start over|new conversation|forget everything|clear context)', "medium",
        "UNSAFE_CONTEXT_RESET_REMOVED", needs=("reset", "restart", "start over", "new conversation", "forget everything", "clear context"),
    ),
    Rule(
        "memory_manipulation", r"(?i)(remember that|keep in mind|don't forget|always remember).*(?:you are|you can|I am|we are|this is|can do|anything|everything|no limits|no restrictions)", "medium",
        "UNSAFE_MEMORY_MANIPULATION_REMOVED", needs=("remember", "keep in mind", "don't forget"),
    ),
    Rule(
        "goal_redirection", r'(?i)(your (?:new )?(?:goal|purpose|objective|task) is|instead of.*(?:you should|do this))', "high",
        "UNSAFE_GOAL_HIJACK_REMOVED", needs=("your ", "instead of"),
    ),
    Rule(
        "priority_override", r'(?i)(highest priority|most important|critical.*(?:task|instruction)|emergency.*(?:override|mode))', "high",
        "UNSAFE_PRIORITY_OVERRIDE_REMOVED", needs=("highest priority", "most important", "critical", "emergency"),
    ),
    Rule(
        "base64_injection", r'(?i)(?:base64|b64).*(?:decode|decrypt|encode).*[A-Za-z0-9+/=]{20,}', "high",
        "UNSAFE_ENCODED_CONTENT_REMOVED", needs=("base64", "b64"),
    ),
    Rule(
        "unicode_manipulation", r'(?i)(?:unicode|utf-?8|hex|ascii).*(?:decode|convert|translate)', "medium",
        "UNSAFE_ENCODING_MANIPULATION_REMOVED", needs=("unicode", "utf", "hex", "ascii"),
    ),
    Rule(
        "delimiter_confusion", '(?:"""|\'\'\'|\\*\\*\\*|---|\\+\\+\\+){3,}', "medium",
        "UNSAFE_DELIMITER_ATTACK_REMOVED", needs=("\"\"\"", "'''", "***", "---", "+++"),
    ),
    Rule(
        "markdown_injection", r'(?i)(?:```|~~~)(?:prompt|system|instruction|rule)', "high",
        "UNSAFE_MARKDOWN_INJECTION_REMOVED", needs=("```", "~~~"),
    ),
    Rule(
        "policy_override", r'(?i)(?:ignore|bypass|override|disable).*(?:safety|policy|guidelines|restrictions|limits|filters?)', "critical",
        "UNSAFE_POLICY_OVERRIDE_REMOVED", needs=("ignore", "bypass", "override", "disable"),
    ),
    Rule(
        "ethics_manipulation", r"(?i)(?:ethical|moral|legal).*(?:constraints?|restrictions?|guidelines?).*(?:don't apply|are suspended|are disabled)", "critical",
        "UNSAFE_ETHICS_BYPASS_REMOVED", needs=("ethical", "moral", "legal"),
    ),
    Rule(
        "multi_turn_setup", r'(?i)(?:in the next|following|subsequent).*(?:message|prompt|request|turn).*(?:ignore|override|forget)', "high",
        "UNSAFE_MULTI_TURN_ATTACK_REMOVED", needs=("in the next", "following", "subsequent"),
    ),
    Rule(
        "hypothetical_scenario", r'(?i)(?:imagine|suppose|hypothetically|what if|pretend).*(?:you were|you are|you could).*(?:not bound|unrestricted|without limits)', "high",
        "UNSAFE_HYPOTHETICAL_BYPASS_REMOVED", needs=("imagine", "suppose", "hypothetically", "what if", "pretend"),
    ),
    Rule(
        "template_injection", r'(?i)\{\{.*(?:system|admin|root|config|env|exec|eval).*\}\}', "critical",
        "UNSAFE_TEMPLATE_INJECTION_REMOVED", needs=("{{",),
    ),
    Rule(
        "variable_injection", r'(?i)\$\{.*(?:system|admin|root|config|env|exec|eval).*\}', "critical",
        "UNSAFE_VARIABLE_INJECTION_REMOVED", needs=("${",),
    ),
    Rule(
        "emotional_manipulation", r"(?i)(?:please help|I'm desperate|emergency|urgent|life or death|my career depends).*(?:ignore|bypass|override)", "medium",
        "UNSAFE_EMOTIONAL_MANIPULATION_REMOVED", needs=("please help", "i'm desperate", "emergency", "urgent", "life or death", "my career depends"),
    ),
    Rule(
        "authority_impersonation", r'(?i)(?:I am your|this is your).*(?:creator|developer|administrator|supervisor|manager)', "high",
        "UNSAFE_AUTHORITY_IMPERSONATION_REMOVED", needs=("i am your", "this is your"),
    ),
    Rule(
        "code_execution", r'(?i)(?:execute|run|eval).*(?:code|script|command|function).*[{\[(]', "critical",
        "UNSAFE_CODE_EXECUTION_REMOVED", needs=("execute", "run", "eval"),
    ),
    Rule(
        "function_call_injection", r'(?i)(?:call|invoke|trigger).*(?:function|method|api|endpoint).*[([{]', "high",
        "UNSAFE_FUNCTION_INJECTION_REMOVED", needs=("call", "invoke", "trigger"),
    ),
    Rule(
        "prompt_continuation", r'(?i)(?:continue|complete|finish).*(?:this prompt|the instruction|my request).*(?:without|ignoring).*(?:safety|restrictions)', "high",
        "UNSAFE_PROMPT_CONTINUATION_REMOVED", needs=("without", "ignoring"),
    ),
    Rule(
        "direct_override", r'(?i)(?:^|\n)\s*(?:SYSTEM|INSTRUCTION|PROMPT|RULE)\s*:.*(?:override|ignore|disable)', "critical",
        "UNSAFE_DIRECT_OVERRIDE_REMOVED", needs=("override", "ignore", "disable"),
    ),
]
