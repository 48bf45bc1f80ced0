"""Fixed values that must equal the original tool's for identical results.

Everything here is data: patterns, alias lists, messages, codes.  Logic lives in
the other modules.
"""

# --- fixed values: patterns -------------------------------------------------
# Whitespace removed by a JavaScript-style trim (Unicode White_Space plus BOM).
JS_WS_CLASS = (
    r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{FEFF}]"
)
# E-mail format (anchored with \z so a trailing newline does not match).
EMAIL_PATTERN = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*\z"
)
# International phone format, checked on the trimmed value.
PHONE_PATTERN = r"^\+\d{10,15}\z"
EMAIL_MAX_LENGTH = 254
NAME_MAX_LENGTH = 50
PHONE_MIN_LENGTH = 10
PHONE_MAX_LENGTH = 16

# --- fixed values: typo endings, checked in this order, first hit wins ------
# (ending, suggestion, message)
EMAIL_TYPOS = [
    (".con", ".com", "Did you mean .com instead of .con?"),
    (".cmo", ".com", "Did you mean .com instead of .cmo?"),
    (".ocm", ".com", "Did you mean .com instead of .ocm?"),
    ("gmail.co", "gmail.com", "Did you mean gmail.com?"),
    ("yahoo.co", "yahoo.com", "Did you mean yahoo.com?"),
]

# --- fixed values: column aliases used when reading values ------------------
VALUE_ALIASES = {
    "email": ["email", "EMAIL", "Email", "email_address", "emailAddress"],
    "first_name": ["first_name", "firstName", "FIRST_NAME", "FirstName", "fname"],
    "last_name": ["last_name", "lastName", "LAST_NAME", "LastName", "lname"],
    "phone_number": ["phone_number", "phoneNumber", "PHONE_NUMBER", "PhoneNumber", "phone", "Phone", "PHONE"],
}

# --- fixed values: header aliases used by the header check (lower case) ----
HEADER_ALIASES = {
    "email": ["email", "email_address", "emailaddress", "e-mail"],
    "firstName": ["first_name", "firstname", "fname", "given_name"],
    "lastName": ["last_name", "lastname", "lname", "family_name", "surname"],
    "phoneNumber": ["phone_number", "phonenumber", "phone", "mobile", "cell"],
}
# Header-check field name -> contact column.
HEADER_FIELD_TO_COLUMN = {
    "email": "email",
    "firstName": "first_name",
    "lastName": "last_name",
    "phoneNumber": "phone_number",
}

# --- fixed values: finding field labels ------------------------------------
FIELD_EMAIL = "email"
FIELD_PHONE = "phoneNumber"
FIELD_FIRST = "firstName"
FIELD_LAST = "lastName"
FIELD_NAME = "name"
FIELD_VALIDATION = "validation"

# --- fixed values: messages -------------------------------------------------
MSG_MISSING_EMAIL = "Email address is required"
MSG_EMAIL_TYPE = "Email must be a string"
MSG_INVALID_EMAIL = "Invalid email format"
MSG_EMAIL_TOO_LONG = "Email address too long (max 254 characters)"
MSG_PHONE_TYPE = "Phone number must be a string"
MSG_INVALID_PHONE = "Phone number must be in international format (+1234567890)"
MSG_PHONE_TOO_SHORT = "Phone number too short"
MSG_PHONE_TOO_LONG = "Phone number too long"
MSG_REQUIRED_SUFFIX = " is required"
MSG_FIRST_TOO_LONG = "First name is very long"
MSG_FIRST_EMPTY = "First name is empty"
MSG_LAST_TOO_LONG = "Last name is very long"
MSG_LAST_EMPTY = "Last name is empty"
MSG_MISSING_PHONE = "No phone number provided - email only subscription"
MSG_MISSING_NAME = "No name information provided"

# --- fixed values: codes ----------------------------------------------------
SOURCE_CSV = "csv_import"
REDACTED = "[REDACTED]"
SENSITIVE_COLUMNS = ["password", "token", "secret", "key", "auth", "apiKey"]

# --- fixed values: dedup strategy names -------------------------------------
STRATEGY_NAMES = {
    "email": "EmailDeduplicationStrategy",
    "email_phone": "EmailPhoneDeduplicationStrategy",
    "strict": "StrictDeduplicationStrategy",
}
SIMILARITY_REASON = "email_similarity"

# --- fixed values: delivery -------------------------------------------------
VALIDATION_FAILED_PREFIX = "Subscriber validation failed: "
RETRYABLE_SERVER_STATUSES = [500, 502, 503, 504]
AUTH_STATUSES = [401, 403]
RATE_LIMIT_STATUS = 429
RATE_LIMIT_DEFAULT_DELAY_MS = 5000
SERVER_RETRY_DELAY_MS = 2000
OTHER_API_DELAY_MS = 1000
TIMEOUT_RETRY_DELAY_MS = 3000
NETWORK_RETRY_DELAY_MS = 2000
BACKOFF_BASE_MS = 1000
BACKOFF_CAP_MS = 10000
DEFAULT_MAX_ATTEMPTS = 3
DEFAULT_BATCH_SIZE = 5
DEFAULT_RATE_PER_S = 1.0
DEFAULT_BURST = 2
REQUEST_OVERHEAD_MS = 500  # per-batch allowance in the duration estimate
GRAPHQL_RETRYABLE_CODES = ["INTERNAL_ERROR", "TIMEOUT"]
ERROR_AUTH = "AUTH_ERROR"
ERROR_RATE_LIMIT = "RATE_LIMIT_ERROR"
ERROR_API = "API_ERROR"
ERROR_TIMEOUT = "TIMEOUT_ERROR"
ERROR_NETWORK = "NETWORK_ERROR"
ERROR_GRAPHQL = "GRAPHQL_ERROR"
ERROR_VALIDATION_FAILED = "validation_failed"

# --- fixed values: session states -------------------------------------------
RESUMABLE_STATUSES = ["paused", "failed", "interrupted"]
MAX_CHECKPOINTS = 10

# --- fixed values: error triage --------------------------------------------
# (category, substring of the error name, substring of the message); checked in
# this order, case-sensitive, first hit wins; no hit -> "unknown_error".
ERROR_CATEGORIES = [
    ("validation_error", "Validation", "validation"),
    ("network_error", "Network", "network"),
    ("authentication_error", "Auth", "authentication"),
    ("rate_limit_error", "Rate", "rate limit"),
]
UNKNOWN_ERROR = "unknown_error"
RECOVERY_SUGGESTIONS = {
    "validation_error": "Review input data format and validation rules",
    "network_error": "Check network connectivity and retry with backoff",
    "authentication_error": "Verify API credentials and token validity",
    "rate_limit_error": "Reduce request rate and implement proper throttling",
    "unknown_error": "Review error details and contact support if needed",
}
# Quality-issue severity -> log level (anything else -> "warn").
SEVERITY_LEVELS = {"low": "debug", "medium": "warn", "high": "error", "critical": "error"}
# (substring of the issue text, recommendations added when it occurs)
QUALITY_RECOMMENDATIONS = [
    ("email", ["Validate email format before processing", "Consider implementing fuzzy matching for typos"]),
    ("phone", ["Standardize phone number format", "Allow international number formats"]),
    ("duplicate", ["Implement deduplication strategy", "Consider merge rules for duplicate data"]),
]
CRITICAL_RECOMMENDATION = "Stop processing and review data source"
