"""Ordered rule catalogue of the log classifier: plain data, first match wins.

Every alternative is written in its plain form: segments that must follow one
another on one line are joined by ``.*``; matching ignores case.
``functions.linescan`` turns each alternative into a linear-time test.
"""

from __future__ import annotations

from dataclasses import dataclass

from . import labels as L


@dataclass(frozen=True)
class Rule:
    label: str
    confidence: float
    patterns: tuple[str, ...]
    explanation: str

    @property
    def plain(self) -> str:
        """The whole rule as one ordinary regular expression."""
        return "|".join(self.patterns)


# --- fixed values: patterns, labels and confidences, in priority order -----
RULES: tuple[Rule, ...] = (
    Rule(
        L.OVERFLOW_GUARD, 0.87,
        (r"UART.*BAUD.*overflow", r"baud_shadow\s*=\s*\d+", r"UART.*BAUD_OVERFLOW",
         r"Baud counter overflow", r"timer.*overrun", r"watchdog.*expired"),
        "A baud, timer or watchdog counter ran one tick past its limit: the guard that "
        "subtracts one from the compare value is probably missing.",
    ),
    Rule(
        L.OVERFLOW_GUARD, 0.85,
        (r"SPI.*bit.*counter.*overflow", r"SPI.*transfer.*watchdog", r"SPI_BIT_COUNTER_OVERFLOW",
         r"I2C.*bit.*overflow", r"I2C_BIT_OVERFLOW"),
        "A serial bit counter went past the word length: check the guard of the bit counter "
        "and of the clock divider.",
    ),
    Rule(
        L.PARITY, 0.88,
        (r"parity.*error", r"UART_PARITY_ERROR", r"parity.*mismatch",
         r"frame.*integrity.*failed", r"parity_err\s*=\s*1"),
        "Frames carry a wrong parity bit: the parity register or its check was switched off.",
    ),
    Rule(
        L.ENABLE, 0.85,
        (r"ENABLE_POLARITY", r"enable.*polarity", r"write.*while.*wr_en.*=.*0",
         r"operation.*disabled.*enable", r"wr_en.*0.*write", r"GPIO_IRQ_STUCK",
         r"IRQ.*stuck.*high.*>.*1.*cycle"),
        "An enable is read with the wrong polarity, so the block acts while disabled and "
        "rests while enabled.",
    ),
    Rule(
        L.ENABLE, 0.83,
        (r"GPIO.*output.*enable.*mask", r"GPIO_OUTPUT_MASK",
         r"output.*pin.*driven.*input.*direction"),
        "Pins set up as inputs are being driven: the output enable mask has no effect.",
    ),
    Rule(
        L.WIDTH, 0.86,
        (r"SB_WIDTH_MISMATCH", r"MSB.*truncated", r"shift.*register.*MSB.*lost",
         r"width.*mismatch"),
        "The top bits of a shifted value are missing: a slice bound is one too low.",
    ),
    Rule(
        L.DATA_INTEGRITY, 0.85,
        (r"SB_DATA_MISMATCH", r"Data mismatch.*expected.*actual",
         r"Unexpected data.*actual.*cycle", r"SCOREBOARD_FAIL.*Data mismatch",
         r"data.*path.*corruption"),
        "The data read back differs from the data expected: suspect the order of register "
        "updates in the data path.",
    ),
    Rule(
        L.HANDSHAKE, 0.88,
        (r"Backpressure violation", r"write_fire\s*=\s*1\s+ready\s*=\s*0",
         r"FIFO_BACKPRESSURE_WRITE", r"protocol assertion tripped",
         r"valid\s*=\s*1.*ready\s*=\s*0", r"SPI_CS_DEASSERTED", r"CS_N deasserted during",
         r"UART_READY_STUCK", r"ready.*stuck.*high.*handshake", r"I2C_NACK_ERROR",
         r"NACK.*received.*ACK.*window"),
        "A transfer took place while the other side was not ready: the ready condition no "
        "longer gates it.",
    ),
    Rule(
        L.OFF_BY_ONE, 0.87,
        (r"Counter overflow", r"FIFO_COUNTER_OVERFLOW", r"count\w*\s*=\s*\d+.*MAX",
         r"Counter exceeded MAX", r"boundary.*check.*failed", r"UART_BAUD_OVERFLOW",
         r"bit.*exceeded.*upper.*bound"),
        "A counter passed its maximum by one: a strict bound was probably made inclusive.",
    ),
    Rule(
        L.EDGE, 0.84,
        (r"Clock edge violation", r"negedge.*sensitivity", r"CLOCK_EDGE_FAIL",
         r"flip-flop.*sampled.*wrong.*clock.*edge", r"clock.*negedge.*unexpected"),
        "Registers sample on the falling edge where the rising edge was meant.",
    ),
    Rule(
        L.RESET, 0.84,
        (r"Reset polarity", r"RESET_POLARITY", r"rst_n.*=.*1.*reset.*asserted",
         r"DUT.*active.*while.*reset", r"I2C_SDA_IDLE", r"UART_IDLE_HIGH",
         r"UART.*not.*idle.*high", r"UART.*TX.*not.*idle", r"SPI_SCLK_ACTIVE_WHEN_IDLE",
         r"SCLK.*active.*while.*CS_N.*high"),
        "The design runs while reset is asserted, or a line is not idle after reset: the "
        "reset test is inverted.",
    ),
    Rule(
        L.DATA_INTEGRITY, 0.72,
        (r"SCOREBOARD_FAIL", r"scoreboard.*fail"),
        "The scoreboard reported a failure without more detail: look at the data path.",
    ),
    Rule(
        L.OFF_BY_ONE, 0.75,
        (r"ASSERT_FAIL.*(?:count|overflow|boundary|DEPTH|MAX)",),
        "An assertion about a counter or bound failed: probably an off-by-one compare.",
    ),
    Rule(
        L.HANDSHAKE, 0.75,
        (r"ASSERT_FAIL.*(?:ready|valid|handshake|backpressure|nack|cs_n)",),
        "An assertion about a ready/valid exchange failed: the gating was probably removed.",
    ),
)

# Words many alternatives need. Each is looked up once per log; an alternative
# is only tried when its word is there. Changes speed, never results.
KEY_WORDS = (
    "overflow", "mismatch", "uart", "fail", "polarity", "write", "output", "active", "stuck",
    "clock", "deasserted", "watchdog", "exceeded", "parity", "nack", "msb",
)

UNKNOWN_EXPLANATION = (
    "No rule fits this log: it shows no failure signature known here. Read the simulator "
    "output by hand."
)
