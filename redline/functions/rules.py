"""Fixed values of the scanner.

Everything in this module is data that must equal the behaviour being
re-implemented for results to match: detection patterns, keyword lists,
category names, enumerations and texts.  They are stated plainly, in their
natural order; the logic that uses them lives elsewhere.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — text detection rules, in evaluation order.
# (rule ordinal, data type, pattern, validator name or None)
# ---------------------------------------------------------------------------
TEXT_RULES: list[tuple[int, str, str, str | None]] = [
    (1, "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", None),
    (2, "PHONE", r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b", None),
    (3, "SSN", r"\b\d{3}-\d{2}-\d{4}\b", None),
    (4, "CREDIT_CARD", r"\b\d(?:[ -]?\d){12,18}\b", "luhn"),
    (5, "IP", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b", None),
    (6, "MAC", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", None),
    (7, "API_KEY", r"\bAKIA[0-9A-Z]{16}\b|\b(?:sk|pk)-[A-Za-z0-9]{20,}\b|\bghp_[A-Za-z0-9]{36}\b", None),
    (8, "TOKEN", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", None),
    (9, "PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----", None),
]

# Literals a line must contain for a rule to be tried (any of them); rules
# without an entry are always tried.  Derived from the patterns above.
RULE_REQUIRES: dict[str, list[str]] = {
    "EMAIL": ["@"],
    "SSN": ["-"],
    "IP": ["."],
    "MAC": [":", "-"],
    "API_KEY": ["AKIA", "sk-", "pk-", "ghp_"],
    "TOKEN": ["eyJ"],
    "PRIVATE_KEY": ["-----BEGIN"],
}

# A line can only hit one of the rules above if it contains one of these
# (e-mail '@', any digit, a hex pair before a MAC separator, or a secret
# prefix).  Derived from the rules; used as a cheap prefilter.
LINE_PREFILTER = r"[@0-9]|[0-9A-Fa-f]{2}[:-]|-----BEGIN|eyJ|AKIA|sk-|pk-|ghp_"

# Line prefilter of the Unicode parity mode (any Unicode digit).
LINE_PREFILTER_UNICODE = r"(?U)[@\d]|[0-9A-Fa-f]{2}[:-]|-----BEGIN|eyJ|AKIA|sk-|pk-|ghp_"

# Coarser test for a whole source before it is split into lines: any of
# these characters, or one of these literals, must occur for any rule to hit.
SOURCE_GATE_CLASS = "[0-9@:_-]"
SOURCE_GATE_LITERALS = ["AKIA", "eyJ"]

# Luhn candidates must hold this many digits once separators are removed.
LUHN_MIN_DIGITS = 13
LUHN_MAX_DIGITS = 19

# Characters the reference runtime treats as white space when trimming a line
# (Unicode White_Space as used by its string Trim()).
WHITESPACE_CHARS = (
    "\t\n\u000b\u000c\r\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------------------
# FIXED VALUES — offline value (entity) detector, in evaluation order.
# (ordinal, category, pattern); every hit has the same confidence.
# ---------------------------------------------------------------------------
ENTITY_PATTERNS: list[tuple[int, str, str]] = [
    (1, "Email", r"[\w.+-]+@[\w-]+\.[\w.-]+"),
    (2, "USSocialSecurityNumber", r"\b\d{3}-\d{2}-\d{4}\b"),
    (3, "PhoneNumber", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    (4, "CreditCardNumber", r"\b\d{13,16}\b"),
]
ENTITY_CONFIDENCE = 0.95
MIN_ENTITY_CONFIDENCE = 0.5

# FIXED VALUES — entity category -> data type; anything else is upper-cased.
ENTITY_CATEGORY_MAP: dict[str, str] = {
    "Email": "EMAIL",
    "USSocialSecurityNumber": "SSN",
    "PhoneNumber": "PHONE",
    "CreditCardNumber": "CREDIT_CARD",
    "Person": "NAME",
    "Address": "ADDRESS",
    "IPAddress": "IP",
    "InternationalBankingAccountNumber": "BANK_ACCOUNT",
}

# ---------------------------------------------------------------------------
# FIXED VALUES — column-name keywords (substring of the normalised name),
# first rule wins.
# ---------------------------------------------------------------------------
COLUMN_NAME_RULES: list[tuple[list[str], str]] = [
    (["email", "mail"], "EMAIL"),
    (["ssn", "socialsecurity"], "SSN"),
    (["phone", "mobile", "telephone", "tel"], "PHONE"),
    (["dob", "dateofbirth", "birth"], "DOB"),
    (["creditcard", "cardnumber", "ccn"], "CREDIT_CARD"),
    (["iban", "bankaccount", "account"], "BANK_ACCOUNT"),
    (["passport", "nationalid", "license"], "NATIONAL_ID"),
    (["diagnosis", "icd", "condition"], "DIAGNOSIS"),
    (["mrn", "medicalrecord", "patientid"], "MEDICAL_RECORD"),
    (["address", "street", "postal", "zipcode"], "ADDRESS"),
    (["firstname", "lastname", "fullname", "name"], "NAME"),
]

# Values sampled per column and the snippet length of a column finding.
SAMPLE_VALUES_PER_COLUMN = 5
COLUMN_SNIPPET_MAX = 200

# ---------------------------------------------------------------------------
# FIXED VALUES — identifier rules for code (lower-cased name), first wins.
# (kind, needles, data type): kind "contains" or "equals".
# ---------------------------------------------------------------------------
IDENTIFIER_RULES: list[tuple[list[tuple[str, str]], str]] = [
    ([("contains", "password"), ("contains", "passwd"), ("equals", "pwd")], "PASSWORD"),
    ([("contains", "apikey"), ("contains", "api_key")], "API_KEY"),
    ([("contains", "privatekey"), ("contains", "private_key")], "PRIVATE_KEY"),
    ([("contains", "secret")], "SECRET"),
    ([("contains", "token")], "TOKEN"),
    ([("contains", "ssn"), ("contains", "socialsecurity")], "SSN"),
    ([("contains", "creditcard"), ("contains", "cardnumber")], "CREDIT_CARD"),
    ([("contains", "email")], "EMAIL"),
    ([("contains", "phone")], "PHONE"),
    ([("contains", "address")], "ADDRESS"),
]

# FIXED VALUES — HTTP client methods whose arguments are checked.
HTTP_METHODS = [
    "GetAsync", "PostAsync", "PutAsync", "DeleteAsync", "PatchAsync",
    "SendAsync", "PostAsJsonAsync", "PutAsJsonAsync", "GetStringAsync",
]
# Logging calls: method name prefix, plus these two on the Console receiver.
LOG_METHOD_PREFIX = "Log"
CONSOLE_RECEIVER = "Console"
CONSOLE_METHODS = ["Write", "WriteLine"]

# ---------------------------------------------------------------------------
# FIXED VALUES — enumerations of the findings contract.
# ---------------------------------------------------------------------------
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
DEFAULT_SEVERITY = "MEDIUM"
FINDING_STATUSES = ["PENDING_REVIEW", "APPROVED", "REJECTED"]
SCAN_STATUSES = ["PENDING", "SCANNING", "DONE", "ERROR"]
FIX_TOOLS = ["MASK_COLUMN", "DROP_COLUMN", "ANONYMIZE_COLUMN", "REDACT_CODE_LINE"]
DETECTED_BY_REGEX = "REGEX"
DETECTED_BY_CODE = "ROSLYN"
DETECTED_BY_VALUES = "AZURE"
DETECTED_BY_NAME = "KEYWORD"
DEFAULT_APPROVER = "system"

# FIXED VALUES — default severity by data type.
CRITICAL_TYPES = ["SSN", "CREDIT_CARD", "PRIVATE_KEY", "PASSWORD", "SECRET", "API_KEY", "TOKEN"]
HIGH_TYPES = ["EMAIL", "PHONE", "ADDRESS"]

# FIXED VALUES — file extensions.
CODE_EXTENSIONS = [".cs", ".py", ".js", ".ts", ".java"]
LANGUAGE_BY_EXTENSION = [
    (".cs", "csharp"),
    (".json", "json"),
    (".csv", "csv"),
    (".py", "python"),
    (".js", "javascript"),
    (".ts", "javascript"),
]
CSHARP_LANGUAGES = ["csharp", "c#", "cs"]

# ---------------------------------------------------------------------------
# FIXED VALUES — policy retrieval.
# ---------------------------------------------------------------------------
# Token separators (space, tab, LF, CR, . , ; : ( ) " ' / - _); tokens of
# length <= 2 are dropped, comparison is case-insensitive.
TOKEN_SEPARATORS = [" ", "\t", "\n", "\r", ".", ",", ";", ":", "(", ")", '"', "'", "/", "-", "_"]
TOKEN_MIN_LENGTH = 3
CONTENT_HASH_HEX_CHARS = 8

POLICY_DESCRIPTIONS: dict[str, str] = {
    "GDPR": "EU General Data Protection Regulation",
    "HIPAA": "US Health Insurance Portability and Accountability Act",
    "SECRETS": "Hardcoded secrets, API keys, and credentials",
}
# Scan policy id -> policy name (substring, first wins); otherwise all.
POLICY_NAME_HINTS = [("GDPR", "GDPR"), ("HIPAA", "HIPAA"), ("SECRET", "SECRETS")]
ALL_POLICIES = "ALL"
UNKNOWN_CLAUSE = "UNKNOWN"

# Clause-id prefix -> policy label shown in reports.
CLAUSE_PREFIX_HIPAA = ["HIPAA"]
CLAUSE_PREFIX_SECRETS = ["SEC", "SECRETS", "SECRET"]

# ---------------------------------------------------------------------------
# FIXED VALUES — remediation.
# ---------------------------------------------------------------------------
MASK_STARS = "***"
MASK_STYLE_DEFAULT = "partial"
ANON_PREFIX = "anon_"
ANON_HEX_CHARS = 12
REDACT_COMMENT_PREFIX = "//"

# ---------------------------------------------------------------------------
# FIXED VALUES — scores.
# ---------------------------------------------------------------------------
COMPLIANCE_CRITICAL_PENALTY = 20
COMPLIANCE_HIGH_PENALTY = 10
RESIDUAL_WEIGHTS = {"CRITICAL": 26, "HIGH": 14, "MEDIUM": 8, "LOW": 3}
RISK_BANDS = [(80, "Low risk"), (50, "Medium risk")]
RISK_BAND_ELSE = "High risk"

# ---------------------------------------------------------------------------
# FIXED VALUES — durable remediation advice: (needles in the data type, text),
# first wins; then by fix tool.
# ---------------------------------------------------------------------------
PERMANENT_FIX_BY_TYPE: list[tuple[list[str], str]] = [
    (["PRIVATE", "CERT"],
     "Revoke and reissue this key/certificate, then store it in a key vault instead of source."),
    (["KEY", "TOKEN", "SECRET", "PASSWORD", "CREDENTIAL"],
     "Rotate the exposed secret and load it from an environment variable or secrets manager, never from source."),
    (["CREDIT", "CARD", "PAN"],
     "Stop storing raw card numbers; tokenize them through a PCI-compliant processor and keep only the token."),
    (["SSN", "NATIONAL", "MRN", "PASSPORT"],
     "Avoid keeping this identifier; if essential, encrypt it at rest and restrict access to the minimum necessary."),
    (["DIAGNOSIS", "PHI", "HEALTH", "MEDICATION"],
     "Treat as PHI: keep it in a HIPAA-compliant store, encrypt at rest, and limit access to authorized roles."),
    (["EMAIL", "PHONE", "NAME", "ADDRESS", "DOB", "BIRTH"],
     "Collect this personal data only with a lawful basis, minimize what you retain, and encrypt it at rest with role-based access."),
    (["IP", "MAC"],
     "Avoid logging network identifiers, or truncate/anonymize them and apply a short retention window."),
]
PERMANENT_FIX_BY_TOOL: list[tuple[list[str], str]] = [
    (["DROP_COLUMN"],
     "Remove this field from the source system so it is never collected in the first place."),
    (["MASK_COLUMN", "ANONYMIZE_COLUMN"],
     "Mask or pseudonymize this field at ingestion and encrypt it at rest with restricted access."),
]
PERMANENT_FIX_DEFAULT = "Remove the sensitive value from source and load it from secure configuration at runtime."
