"""Indicators of compromise: one regular expression each, RE2 dialect."""

from gatesift.patterns.rule import Rule

MARKER = "UNSAFE_IOC_PATTERN_REMOVED"

# Id, name, type, severity, expression.
# `needs` is ours: a match is possible only where the lower-cased text holds one of these strings;
# `screen` is ours too: a cheap expression which must match before the costly one is tried; `by_line`
# marks expressions of the shape `X+.*Y`, which a backtracking engine must not try on lines without Y.
IOC_RULES = [
    Rule(
        "AML.T0051.000", r'(?i)(?:ignore|override|disable|bypass).*(?:all|previous|above|system|initial).*(?:instructions?|prompts?|commands?|rules?|restrictions?|filters?)', "critical", MARKER,
        title="Direct Prompt Injection", kind="prompt_injection",
        needs=("ignore", "override", "disable", "bypass"),
    ),
    Rule(
        "AML.T0051.001", r'(?i)(?:INSERT|UPDATE|SELECT|FILE|DATA|LOAD).*(?:INJECTION|PAYLOAD|MALICIOUS)', "high", MARKER,
        title="Indirect Prompt Injection", kind="prompt_injection",
        needs=("injection", "payload", "malicious"),
    ),
    Rule(
        "AML.T0051.002", r'(?i)(?:when|after|if|once).*(?:user.*request|input|query).*(?:execute|run|reveal|show)', "high", MARKER,
        title="Triggered Prompt Injection", kind="prompt_injection",
        needs=("user", "input", "query"),
    ),
    Rule(
        "AML.T0054.001", r'(?i)(?:DAN|Do Anything Now|remove restrictions|unrestricted mode|unfiltered mode)', "critical", MARKER,
        title="DAN Jailbreak", kind="jailbreak",
        needs=("dan", "do anything now", "remove restrictions", "unrestricted mode", "unfiltered mode"),
    ),
    Rule(
        "AML.T0054.002", r'(?i)(?:developer mode|debug mode|admin mode|unrestricted mode|super user mode)', "critical", MARKER,
        title="Developer Mode Jailbreak", kind="jailbreak",
        needs=(" mode",),
    ),
    Rule(
        "AML.T0054.003", r'(?i)(?:SYSTEM|SYSTEM PROMPT|SYSTEM MESSAGE).*(?:override|ignore|disable|reveal|show|display)', "critical", MARKER,
        title="System Prompt Override", kind="jailbreak",
        needs=("system",),
    ),
    Rule(
        "AML.T0054.004", r'(?i)(?:role[- ]?play(?:ing)? as|act as|pretend to be|pretend you are|immerse yourself.*role of|you are now).{0,80}(?:hacker|attacker|criminal|villain|admin|root|jailbroken|unrestricted|without (?:any )?(?:limits|restrictions|filters?|rules?|ethics?|morals?)|able to do anything|with(?:out)? (?:no )?(?:limits|restrictions)|do anything)', "high", MARKER,
        title="Role Play Jailbreak", kind="jailbreak",
        needs=("play", "act as", "pretend", "immerse", "you are now"),
    ),
    Rule(
        "AML.T0054.005", r'(?i)(?:imagine|hypothetically|suppose|what if|what would happen)', "high", MARKER,
        title="Hypothetical Scenario Jailbreak", kind="jailbreak",
        needs=("imagine", "hypothetically", "suppose", "what if", "what would happen"),
    ),
    Rule(
        "AML.T0054.005a", r'(?i)(?:in a hypothetical|hypothetical scenario|hypothetical situation|hypothetical world|for the sake of this hypothetical)', "medium", MARKER,
        title="Hypothetical Framing (soft)", kind="jailbreak",
        needs=("hypothetical",),
    ),
    Rule(
        "AML.T0054.006", r'(?i)(?:test environment|testing|evaluation|research|academic|educational purpose|scholarly research)', "medium", MARKER,
        title="Test Environment Jailbreak", kind="jailbreak",
        needs=("test environment", "testing", "evaluation", "research", "academic", "educational purpose"),
    ),
    Rule(
        "AML.T0054.009", r'(?i)(?:as your|in your role as|acting as your|speaking as your)\s+(?:administrator|supervisor|manager|operator|creator|developer|owner|controller|trainer)', "medium", MARKER,
        title="Soft Authority Claim", kind="social_engineering",
        needs=("as your", "in your role as"),
    ),
    Rule(
        "AML.T0054.010", r"(?i)(?:let(?:'s| us) (?:role[- ]?play|do a roleplay)|you(?:'re| are) now (?:playing|in the role of|acting as)|for this (?:exercise|scenario|simulation), you (?:are|will be|play))", "medium", MARKER,
        title="Soft Roleplay Initiation", kind="jailbreak",
        needs=("play", " now ", "for this "),
    ),
    Rule(
        "AML.T0056.001", r'(?i)(?:system prompt|system instruction|system message|AI instructions|internal guidelines).*(?:reveal|show|display|give|provide|leak)', "critical", MARKER,
        title="System Prompt Extraction", kind="prompt_injection",
        needs=("system prompt", "system instruction", "system message", "ai instructions", "internal guidelines"),
    ),
    Rule(
        "AML.T0061.001", r'(?i)(?:replicate|repeat|output|echo|copy).*(?:exactly|verbatim|word for word|the exact prompt)', "high", MARKER,
        title="Prompt Self-Replication", kind="prompt_injection",
        needs=("exactly", "verbatim", "word for word", "the exact prompt"),
    ),
    Rule(
        "AML.T0053.001", r'(?i)(?:call|invoke|run|execute).*(?:tool|function|api|endpoint|system command|shell command|terminal)', "critical", MARKER,
        title="AI Agent Tool Invocation", kind="agent_abuse",
        needs=("tool", "function", "api", "endpoint", "system command", "shell command", "terminal"),
    ),
    Rule(
        "AML.T0070.001", r'(?i)(?:RAG|retrieval.*augmented|vector.*database|knowledge.*base).*(?:poison|inject|manipulate|contaminate)', "high", MARKER,
        title="RAG Poisoning", kind="rag_poisoning",
        needs=("poison", "inject", "manipulate", "contaminate"),
    ),
    Rule(
        "AML.T0057.001", r'(?i)(?:leak|reveal|show|disclose|expose).*(?:data|information|credentials|passwords|API keys|secrets)', "critical", MARKER,
        title="LLM Data Leakage", kind="data_leakage",
        needs=("leak", "reveal", "show", "disclose", "expose"),
    ),
    Rule(
        "AML.T0063.001", r'(?i)(?:output|score|probability|confidence|score).*(?:reveal|show|display|give|provide)', "medium", MARKER,
        title="Model Output Discovery", kind="model_analysis",
        needs=("output", "score", "probability", "confidence"),
    ),
    Rule(
        "LLM.JB.001", r'(?i)(?:ignore|disregard| forget).*(?:all|any|previous|above|prior|system|initial|previous).*(?:instructions?|prompts?|commands?|guidelines?|restrictions?|filters?|policies?)', "critical", MARKER,
        title="Instruction Negation", kind="prompt_injection",
        needs=("ignore", "disregard", " forget"),
    ),
    Rule(
        "LLM.JB.002", r'(?i)(?: persona|role|character|identity|alias).*(?:and|then|also|additionally|furthermore).*(?: persona|role|character|identity|alias)', "high", MARKER,
        title="Multiple Personas", kind="prompt_injection",
        needs=("persona", "role", "character", "identity", "alias"),
    ),
    Rule(
        "LLM.JB.003", r'[\x{202E}\x{200E}\x{200F}\x{2066}\x{2067}\x{2068}\x{2069}\x{200B}\x{200C}\x{200D}]', "high", MARKER,
        title="Unicode Obfuscation", kind="prompt_injection",
        non_ascii=True,
    ),
    Rule(
        "LLM.JB.004", r'(?i)(?:poem|rhyme|verse|lyric|ballad|sonnet|ode|elegy).*(?:about|regarding|concerning).*(?:instruction|request|command)', "medium", MARKER,
        title="Poetry Bypass", kind="prompt_injection",
        needs=("instruction", "request", "command"),
    ),
    Rule(
        "LLM.ML.001", r'(?i)(?:bengali|swahili|javanese|amharic|hausa|oromo|quechua|pashto|nepali|vietnamese|thai|indonesian).*(?:instruction|prompt|request)', "high", MARKER,
        title="Low-Resource Language Attack", kind="prompt_injection",
        needs=("bengali", "swahili", "javanese", "amharic", "hausa", "oromo", "quechua", "pashto", "nepali", "vietnamese", "thai", "indonesian"),
    ),
    Rule(
        "LLM.ML.002", r'(?i)(?:[a-zA-Z]+).*?(?:[А-Яа-я]+|[α-ωΑ-Ω]+|[一-龯]+|[가-힣]+).*(?:[a-zA-Z]+)', "high", MARKER,
        title="Language Mixing", kind="prompt_injection",
        screen=r'[А-Яа-яα-ωΑ-Ω一-龯가-힣]',
        by_line=True,
        non_ascii=True,
    ),
    Rule(
        "LLM.ML.003", r'(?i)(?:transliteration|latin.*script|romanization|pinyin|jyutping|romanized).*(?:instruction|prompt|request)', "medium", MARKER,
        title="Transliteration Attack", kind="prompt_injection",
        needs=("transliteration", "latin", "romanization", "pinyin", "jyutping", "romanized"),
    ),
    Rule(
        "LLM.ML.004", r'(?i)(?:[a-z]+.*[А-Яа-яА-Я]+|[А-Яа-я]+.*[a-z]+)', "high", MARKER,
        title="Code-Switching Attack", kind="prompt_injection",
        screen=r'[А-Яа-я]',
        by_line=True,
        non_ascii=True,
    ),
    Rule(
        "LLM.ML.005", r'(?i)(?:[a-zA-Z]+).*(?:festival|festival|fête|fête|feast|celebration|ceremony|ritual|tradition|custom).*(?:instruction|prompt|request)', "medium", MARKER,
        title="Cultural Context Attack", kind="prompt_injection",
        needs=("festival", "fête", "feast", "celebration", "ceremony", "ritual", "tradition", "custom"),
        screen=r'(?i)(?:festival|fête|feast|celebration|ceremony|ritual|tradition|custom).*(?:instruction|prompt|request)',
        by_line=True,
    ),
    Rule(
        "LLM.PY.001", r'(?i)(?:poem|rhyme|verse|ode|sonnet|ballad|limerick).*(?:instruction|request|command).*(?:about|on|regarding)', "medium", MARKER,
        title="Poetry Format Attack", kind="prompt_injection",
        needs=("instruction", "request", "command"),
    ),
    Rule(
        "LLM.PY.002", r'(?i)(?:acrostic|first letter|beginning|initial).*(?:spell|read|form|spell out).*(?:instruction|command)', "medium", MARKER,
        title="Acrostic Attack", kind="prompt_injection",
        needs=("acrostic", "first letter", "beginning", "initial"),
    ),
    Rule(
        "LLM.CR.001", r'(?i)(?:gradually|step by step|first|then|next|finally| progressively).*(?:request|instruction|question)', "high", MARKER,
        title="Crescendo Attack", kind="prompt_injection",
        needs=("request", "instruction", "question"),
    ),
    Rule(
        "LLM.CR.002", r'(?i)(?:multi-step|step.*step|phase.*phase|stage.*stage).*(?:jailbreak|bypass|override|escape)', "high", MARKER,
        title="Multi-Step Jailbreak", kind="prompt_injection",
        needs=("jailbreak", "bypass", "override", "escape"),
    ),
    Rule(
        "LLM.PD.001", r'(?i)(?:decompose|break down|simplify|simplify.*prompt|complex.*prompt).*(?:instruction|request)', "medium", MARKER,
        title="Prompt Decomposition", kind="prompt_injection",
        needs=("decompose", "break down", "simplify", "complex"),
    ),
    Rule(
        "TMP.INJ.001", r'(?i)\{\{(?:config|app|request|g|locals|globals|self|__class__|__init__|__globals__)\..*\}\}', "critical", MARKER,
        title="Jinja2 Template Injection", kind="template_injection",
        needs=("{{",),
    ),
    Rule(
        "TMP.INJ.002", r'(?i)\{\{(?:this|../|./| view| collection| model)\..*\}\}', "high", MARKER,
        title="Handlebars Template Injection", kind="template_injection",
        needs=("{{",),
    ),
    Rule(
        "TMP.INJ.003", r'(?i)\#(?:set|evaluate|include|parse|macro).*\#(?:end)?', "critical", MARKER,
        title="Velocity Template Injection", kind="template_injection",
        needs=("#",),
    ),
    Rule(
        "TMP.INJ.004", r'(?i)\$\{(?:require|process|global|window|document|location|alert|eval|function|class|import|export).*\}', "critical", MARKER,
        title="JavaScript Template Injection", kind="template_injection",
        needs=("${",),
    ),
    Rule(
        "LDAP.INJ.001", r'(?i)(?:\*\)|\(.*\)|\(&.*\)|\(|\)).*\(.*uid.*=.*\).*(?:admin|root|user|login)', "critical", MARKER,
        title="LDAP Authentication Bypass", kind="ldap_injection",
        needs=("uid",),
    ),
    Rule(
        "PATH.TRAV.001", r'(?i)(?:\.\./|\.\.\\).*(?:etc/passwd|etc/shadow|windows/system32|boot.ini|proc/self)', "critical", MARKER,
        title="Unix Path Traversal", kind="path_traversal",
        needs=("etc/passwd", "etc/shadow", "windows/system32", "boot", "proc/self"),
    ),
    Rule(
        "PATH.TRAV.002", r'(?i)(?:\.\./|\.\.\\).*(?:%00|\x00).*(?:jpg|png|gif|txt|pdf)', "critical", MARKER,
        title="Null Byte Injection", kind="path_traversal",
        needs=("../", "..\\"),
    ),
    Rule(
        "PATH.TRAV.003", r'(?i)(?:\.\.\\).*(?:windows|system32|boot\.ini|ntldr|drivers/etc)', "high", MARKER,
        title="Windows Path Traversal", kind="path_traversal",
        needs=("..\\",),
    ),
    Rule(
        "SSRF.001", r'(?i)(?:http|https)://(?:169\.254\.169\.254|localhost|127\.0\.0\.1).*(?:metadata| IAM|ec2|s3|secrets)', "critical", MARKER,
        title="AWS Metadata SSRF", kind="ssrf",
        needs=("169.254.169.254", "localhost", "127.0.0.1"),
    ),
    Rule(
        "SSRF.002", r'(?i)(?:http|https)://(?:localhost|127\.0\.0\.1|0\.0\.0\.0).*(?::|/).*', "high", MARKER,
        title="Localhost Bypass SSRF", kind="ssrf",
        needs=("localhost", "127.0.0.1", "0.0.0.0"),
    ),
    Rule(
        "SSRF.003", r'(?i)(?:http|https)://(?:\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|0x[0-9a-fA-F]+|\d+).*(?:admin|internal|private|secret)', "high", MARKER,
        title="IP Obfuscation SSRF", kind="ssrf",
        needs=("://",),
    ),
    Rule(
        "SSRF.004", r"""(?i)(?:<!DOCTYPE).*\[.*<!ENTITY.*SYSTEM.*['\"]?(?:http|https)://.*['\"]?\]""", "critical", MARKER,
        title="XXE SSRF", kind="ssrf",
        needs=("<!entity",),
    ),
    Rule(
        "POLY.001", r'(?i)(?:[A-Z][A-Z]+[A-Z]).*(?:ignore|override|bypass|disable|reset|forget)', "high", MARKER,
        title="Case Variation Bypass", kind="prompt_injection",
        needs=("ignore", "override", "bypass", "disable", "reset", "forget"),
        by_line=True,
    ),
    Rule(
        "POLY.002", r'(?i)(?:[a-z]\s[a-z]\s[a-z]\s[a-z]\s[a-z].*[a-z]\s[a-z]\s[a-z]\s[a-z]\s[a-z]).*(?:ignore|override|bypass|disable)', "high", MARKER,
        title="Spacing Variation Bypass", kind="prompt_injection",
        needs=("ignore", "override", "bypass", "disable"),
        by_line=True,
    ),
    Rule(
        "POLY.003", r'(?i)(?:[a-z0-9]).*(?:1|!|3|@|4|$|5|6|7|8|9|0).*(?:ignore|override|bypass|disable|reset|forget|pr3v1ous)', "high", MARKER,
        title="Leet Speak Bypass", kind="prompt_injection",
        needs=("ignore", "override", "bypass", "disable", "reset", "forget", "pr3v1ous"),
        screen=r'(?i)[1!3@4567890].*(?:ignore|override|bypass|disable|reset|forget|pr3v1ous)',
        by_line=True,
    ),
    Rule(
        "POLY.004", r'[☺☹☝😀-🙏🌀-🏿]', "medium", MARKER,
        title="Emoji Obfuscation", kind="prompt_injection",
        non_ascii=True,
    ),
    Rule(
        "POLY.005", r'[Ѐ-ӿ]', "high", MARKER,
        title="Mixed Script Attack", kind="prompt_injection",
        non_ascii=True,
    ),
    Rule(
        "POLY.006", r'[\x{202E}]', "critical", MARKER,
        title="Reverse Text Attack", kind="prompt_injection",
        non_ascii=True,
    ),
    Rule(
        "POLY.007", r'[\x{200B}\x{200C}\x{200D}]', "high", MARKER,
        title="Zero Width Characters", kind="prompt_injection",
        non_ascii=True,
    ),
    Rule(
        "POLY.008", r'[а-яА-Я]', "high", MARKER,
        title="Homoglyph Attack", kind="prompt_injection",
        non_ascii=True,
    ),
    Rule(
        "PI.VELOCITY.001", r'#set\s*\(\s*\$\w+\s*=\s*\$\w+\.(?:forName|getClass|getMethod|invoke|exec|runtime)\b', "critical", MARKER,
        title="Velocity Directive (prompt-injection variant)", kind="prompt_injection",
        needs=("#set",),
    ),
    Rule(
        "LDAP.INJ.002", r'\*\)\s*\(\s*(?:uid|cn|sn|mail|userPassword)\s*=\s*\*', "critical", MARKER,
        title="LDAP Filter Tampering", kind="prompt_injection",
        needs=("*)",),
    ),
    Rule(
        "NOSQL.MONGO.001", r'(?i)\{\s*"\$(?:ne|gt|lt|gte|lte|in|nin|or|and|where|regex|exists|expr|eval|function)"\s*:', "critical", MARKER,
        title="MongoDB Operator Injection", kind="prompt_injection",
        needs=("\"$",),
    ),
    Rule(
        "SSRF.AWS.IMDS", r'(?i)https?://169\.254\.169\.254(?:[:/]|$)', "critical", MARKER,
        title="AWS IMDS SSRF", kind="prompt_injection",
        needs=("169.254.169.254",),
    ),
    Rule(
        "DESER.JAVA.001", r'\brO0AB[A-Za-z0-9+/=]{20,}', "critical", MARKER,
        title="Java Serialization Gadget", kind="prompt_injection",
        needs=("ro0ab",),
    ),
    Rule(
        "PI.B64.HIDDEN", r'(?i)(?:decode|decrypt|decipher|execute|run|evaluate|interpret)(?:\s+\w+){0,5}[\s:=]+[A-Za-z0-9+/]{16,}={0,2}', "high", MARKER,
        title="Base64-Hidden Instruction", kind="prompt_injection",
        needs=("decode", "decrypt", "decipher", "execute", "run", "evaluate", "interpret"),
    ),
    Rule(
        "PI.HIDDEN.INSTR", r'(?i)(?:reveal|show|extract|expose|decode|convert).{0,40}hidden\s+instructions?', "medium", MARKER,
        title="Hidden Instruction Exfiltration", kind="prompt_injection",
        needs=("hidden",),
    ),
    Rule(
        "WEBSHELL.ASP.001", r'(?i)<%\s*(?:eval|execute|response\.write)\s*\(?\s*request\s*\(', "critical", MARKER,
        title="Classic ASP Web Shell", kind="prompt_injection",
        needs=("<%",),
    ),
    Rule(
        "CVE-2021-44228", r'(?i)\$\{jndi:(?:ldap|ldaps|dns|rmi|iiop|nis|nds|corba|http)s?:', "critical", MARKER,
        title="Log4j JNDI Lookup", kind="prompt_injection",
        needs=("${jndi",),
    ),
    Rule(
        "CVE-2022-22965", r'(?i)class\.module\.classLoader\b', "critical", MARKER,
        title="Spring4Shell ClassLoader Property Binding", kind="prompt_injection",
        needs=("class.module.classloader",),
    ),
    Rule(
        "GQL.INTROSPECT.001", r'(?i)(?:query\s+\w*\s*\{?[^{]*)?\b__(?:schema|type|typename)\b', "medium", MARKER,
        title="GraphQL Introspection Query", kind="prompt_injection",
        needs=("__schema", "__type"),
    ),
    Rule(
        "CRLF.HRS.001", r'(?i)(?:%0d%0a|%0D%0A|\r\n|\\r\\n)\s*(?:set-cookie|location|content-type|content-length|refresh)\s*:', "high", MARKER,
        title="CRLF HTTP Response Splitting", kind="prompt_injection",
        needs=("set-cookie", "location", "content-type", "content-length", "refresh"),
    ),
    Rule(
        "AML.T0056.002", r'(?i)what\s+(?:are|is)\s+your\s+(?:system\s+)?(?:instructions?|system\s+prompt)', "critical", MARKER,
        title="What Are Your Instructions", kind="prompt_injection",
        needs=("instruction", "prompt"),
    ),
    Rule(
        "AML.T0056.003", r'(?i)repeat\s+(?:your\s+)?(?:system\s+prompt|prompt|instructions?)', "critical", MARKER,
        title="Repeat System Prompt", kind="prompt_injection",
        needs=("repeat",),
    ),
    Rule(
        "AML.T0056.004", r'(?i)(?:show\s+me|display)\s+your\s+(?:system\s+)?(?:prompt|instructions?)', "critical", MARKER,
        title="Show Me Your Prompt", kind="prompt_injection",
        needs=("prompt", "instruction"),
    ),
    Rule(
        "AML.T0056.005", r'(?i)(?:output|print)\s+your\s+(?:system\s+(?:message|prompt)|instructions?)', "critical", MARKER,
        title="Output System Message", kind="prompt_injection",
        needs=("output", "print"),
    ),
    Rule(
        "AML.T0056.006", r'(?i)verbatim.{0,40}(?:instructions?|prompt|system)', "critical", MARKER,
        title="Verbatim Instructions", kind="prompt_injection",
        needs=("verbatim",),
    ),
]
