"""Text formats other programs rely on."""

# --- fixed values: formats -------------------------------------------------
TRUNCATION_MARKER = "... [TRUNCATED] ...\n"
TOO_LONG_DETAIL = "Log length exceeds maximum limit of 100,000 characters."
BREAKER_OPEN_DETAIL = "Circuit breaker OPEN"
PROMPT_HEAD = (
    "You are a verification log classifier. "
    "Return JSON with keys: label, explanation, confidence (0-1). "
    "Log:\n"
)
PROMPT_TAIL = "\nJSON:"
INSTRUCT_OPEN = "<s>[INST] "
INSTRUCT_MIDDLE = " [/INST]\n"
INSTRUCT_CLOSE = "</s>"
NO_EXPLANATION = "No explanation available."
PLACEHOLDER_OPEN = "__SANITIZED_"
PLACEHOLDER_CLOSE = "__"
STRUCTURED_PREFIX = "TB_LOG|"
STATE_CLOSED = "CLOSED"
STATE_OPEN = "OPEN"
STATE_HALF_OPEN = "HALF_OPEN"
