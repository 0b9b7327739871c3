"""Label vocabulary and the five modules the corpus is built over."""

# --- fixed values: label names -------------------------------------------
ASSIGNMENT = "Assignment Semantics Change"
EDGE = "Edge Sensitivity Flip"
RESET = "Reset Polarity Inversion"
ENABLE = "Enable Signal Polarity Flip"
WIDTH = "Data Width Truncation"
OFF_BY_ONE = "Off-by-One Error"
HANDSHAKE = "Handshake Protocol Violation"
OVERFLOW_GUARD = "Overflow Guard Removal"
PARITY = "Parity Check Removal"
DATA_INTEGRITY = "Data Integrity Error"
UNKNOWN = "Unknown"

# --- fixed values: modules -----------------------------------------------
MODULES = ("fifo", "uart_tx", "spi_master", "gpio", "i2c_master")

# --- fixed values: thresholds --------------------------------------------
MAX_LOG_CHARS = 100_000
KEEP_LOG_CHARS = 50_000
CONFIDENCE_THRESHOLD = 0.7
UNKNOWN_CONFIDENCE = 0.3
BREAKER_FAILURE_THRESHOLD = 5
BREAKER_RECOVERY_SECONDS = 60
