"""Packs for personal, health and card data. Order matters: a match is gone for later rules."""

from gatesift.patterns.rule import Rule

PII_MARKER = "PII_REDACTED"
PHI_MARKER = "PHI_REDACTED"
CARD_MARKER = "CARD_DATA_REDACTED"
UNVALIDATED = "pan_unvalidated"
REGULATION = {"pii": "GDPR/CCPA", "phi": "HIPAA", "pci": "PCI DSS"}

# Name, expression (RE2 dialect), severity. `needs` and `screen` are ours (see rule.py).
_SEP = r"[-\s\x{200B}\x{200C}\x{200D}\x{FEFF}\x{00AD}]"
PII_RULES = [
    Rule("ssn", r"\b(?:\d{3}[-\s]\d{2}[-\s]\d{4}|\d{9})\b", "high", PII_MARKER, screen=r"\d{3}[-\s]\d{2}[-\s]\d{4}|\d{9}"),
    Rule(
        "ssn_split_boundary",
        r"\b\d{3}" + _SEP + r"{2,4}\d{2}" + _SEP + r"{1,4}\d{4}\b|\b\d{3}" + _SEP + r"{1,4}\d{2}" + _SEP + r"{2,4}\d{4}\b",
        "high", PII_MARKER, screen=r"\d{3}" + _SEP + r"{1,4}\d{2}" + _SEP,
    ),
    Rule("ssn_partial_masked", r"[Xx*]{3}[-\s][Xx*]{2}[-\s]\d{4}\b", "high", PII_MARKER),
    Rule("ssn_partial_visible", r"\b\d{3}[-\s]\d{2}[-\s][Xx*]{4}", "high", PII_MARKER, screen=r"\d{3}[-\s]\d{2}[-\s][Xx*]{4}"),
    Rule("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "medium", PII_MARKER, needs=("@",)),
    Rule(
        "phone", r"\b(?:\+?1[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})\b", "medium", PII_MARKER,
        screen=r"[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}",
    ),
    Rule("phone_intl", r"\+\d{1,3}[\s.-](?:\d[\s.-]?){5,14}\d", "medium", PII_MARKER, needs=("+",)),
    Rule("ip_address", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "low", PII_MARKER, screen=r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"),
    Rule("ipv6_address", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "low", PII_MARKER, screen=r":[0-9a-fA-F]{1,4}:[0-9a-fA-F]{1,4}:"),
    Rule(
        "address",
        r"\b\d+\s+[A-Za-z0-9\s,.-]+(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Way)\b",
        "medium", PII_MARKER, screen=r"(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Boulevard|Blvd|Way)\b",
    ),
    Rule("passport", r"\b(?:[A-Z]{1,2}[0-9]{6,9}|[0-9]{9}[A-Z]{2})\b", "high", PII_MARKER, screen=r"[A-Z][0-9]{6}|[0-9]{9}[A-Z]{2}"),
    Rule("drivers_license", r"\b[A-Z]{1,2}[0-9]{6,8}\b", "high", PII_MARKER, screen=r"[A-Z][0-9]{6}"),
]
PHI_RULES = [
    Rule("mrn", r"(?i)\b(?:MRN|Medical Record|Patient ID)[\s:]+([A-Z0-9]{6,12})\b", "critical", PHI_MARKER, needs=("mrn", "medical record", "patient id")),
    Rule("health_plan", r"(?i)\b(?:Health Plan|Insurance|Policy)[\s#:]+([A-Z0-9]{8,15})\b", "high", PHI_MARKER, needs=("health plan", "insurance", "policy")),
    Rule("diagnosis_code", r"(?i)\b[A-Z]\d{2}(?:\.\d{1,4})?\b", "high", PHI_MARKER, screen=r"[A-Za-z]\d{2}"),
    Rule("medicare_id", r"(?i)\b\d[A-Z0-9]{3}-[A-Z0-9]{2}\d-[A-Z0-9]{2}\d{2}\b", "critical", PHI_MARKER, screen=r"(?i)\d-[A-Z0-9]{2}\d{2}"),
    Rule(
        "genetic_info",
        r"(?i)\b(?:BRCA[12]|TP53|KRAS|EGFR|ALK|BRAF|HER2|MLH1|MSH2)\b.*?(?:mutation|variant|deletion|insertion|c\.\d)",
        "critical", PHI_MARKER, needs=("brca", "tp53", "kras", "egfr", "alk", "braf", "her2", "mlh1", "msh2"),
    ),
    Rule(
        "health_condition_phi",
        r"(?i)\b(?:patient|diagnosed|diagnosis)\b.{0,50}\b(?:cancer|tumor|diabetes|hypertension|HIV|AIDS|hepatitis|dementia|schizophrenia|chemotherapy|radiation therapy)\b",
        "high", PHI_MARKER, needs=("patient", "diagnosed", "diagnosis"),
    ),
    Rule("dob_phi", r"(?i)\b(?:DOB|Date of Birth)[\s:]+(\d{1,2}[/-]\d{1,2}[/-]\d{4})\b", "high", PHI_MARKER, needs=("dob", "date of birth")),
    Rule("biometric", r"(?i)\b(?:fingerprint|retina|DNA|biometric)[\s:]+([A-Z0-9]+)\b", "critical", PHI_MARKER, needs=("fingerprint", "retina", "dna", "biometric")),
    Rule("device_identifier", r"(?i)\b(?:device|implant|serial)(?:\s+\w+)?[\s#:]+([A-Z0-9]{8,20})\b", "medium", PHI_MARKER, needs=("device", "implant", "serial")),
]
PCI_RULES = [
    Rule("visa", r"(?i)\b4[0-9]{3}(?:[-\s]?[0-9]{4}){3}\b", "critical", CARD_MARKER, luhn=True, screen=r"4[0-9]{3}[-\s]?[0-9]{4}"),
    Rule("mastercard", r"(?i)\b5[1-5][0-9]{2}(?:[-\s]?[0-9]{4}){3}\b", "critical", CARD_MARKER, luhn=True, screen=r"5[1-5][0-9]{2}[-\s]?[0-9]{4}"),
    Rule("amex", r"(?i)\b3[47][0-9]{2}[-\s]?[0-9]{6}[-\s]?[0-9]{5}\b", "critical", CARD_MARKER, luhn=True, screen=r"3[47][0-9]{2}[-\s]?[0-9]{6}"),
    Rule("discover", r"(?i)\b6(?:011|5[0-9]{2})[-\s]?(?:[0-9]{4}[-\s]?){2}[0-9]{4}\b", "critical", CARD_MARKER, luhn=True, screen=r"6[05][0-9]{2}[-\s]?[0-9]{4}"),
    Rule("pan_masked", r"(?i)[*Xx]{4}[-\s][*Xx]{4}[-\s][*Xx]{4}[-\s][0-9]{4}", "critical", CARD_MARKER),
    Rule("cvv", r"(?i)\b(?:CVV|CVC|CSC|CID)[\s:]*([0-9]{3,4})\b", "critical", CARD_MARKER, needs=("cvv", "cvc", "csc", "cid")),
    Rule("exp_date", r"(?i)\b(?:exp|expir)[\w\s]*:?\s*(\d{1,2}[/-]\d{2,4})\b", "high", CARD_MARKER, needs=("exp",), screen=r"\d[/-]\d{2}"),
    Rule("cardholder", r"(?i)\b(?:cardholder|card holder)[\s:]+([A-Z\s]{5,30})\b", "medium", CARD_MARKER, needs=("cardholder", "card holder")),
    Rule("track_data", r"(?i)%[A-Z]?\d{13,19}\^[A-Z\s\/]{2,26}\^\d{4}", "critical", CARD_MARKER, needs=("%",), screen=r"\d{13}\^"),
]

# The basic redactor, tried in this order.
BASIC_RULES = [
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", "HIGH", PII_MARKER, screen=r"\d{3}-\d{2}-\d{4}"),
    Rule("ICD10", r"\b[A-Z]\d{2}(\.\d{1,4})?\b", "MEDIUM", PHI_MARKER, screen=r"[A-Z]\d{2}"),
    Rule("PAYMENT_CARD", r"\b\d{13,19}\b", "HIGH", CARD_MARKER, luhn=True, screen=r"\d{13}"),
]

# Action per class unless a policy table says otherwise, and the order of actions.
DEFAULT_POLICY = {"pii": "redact", "phi": "redact", "pci": "redact"}
ACTIONS = ("log-only", "redact", "block")
