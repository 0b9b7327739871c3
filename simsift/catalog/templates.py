"""Log templates: failure logs per (mutation, module), and augmentation lines.

The failure logs come from a rule: every module has a few checkers, and a
mutation trips one of them; ``log_templates`` spells out all 45 pairs.
Texts are our own; ids and key phrases are the ones the classifiers know.
"""

from __future__ import annotations

from . import labels as L
from .mutations import SPECS

# checker name -> (kind, assert_id, headline, structured values, signals)
_CHECKERS = {
    "fifo": {
        "data": ("SCOREBOARD_FAIL", "SB_DATA_MISMATCH",
                 "Data mismatch expected={expected} actual={actual}",
                 "expected={expected}|actual={actual}", "wptr=3,rptr=1,valid=1"),
        "counter": ("ASSERT_FAIL", "FIFO_COUNTER_OVERFLOW", "Counter overflow count={count}",
                    "count={count}", "count={count},full=1"),
        "handshake": ("ASSERT_FAIL", "FIFO_BACKPRESSURE_WRITE",
                      "Backpressure violation write_fire=1 ready=0",
                      "write_fire=1|ready=0", "write_fire=1,ready=0"),
    },
    "uart_tx": {
        "data": ("SCOREBOARD_FAIL", "SB_UART_FRAME",
                 "Sent frame mismatch expected={expected} actual={actual}",
                 "expected={expected}|actual={actual}", "shift_reg={actual},tx=1"),
        "counter": ("ASSERT_FAIL", "UART_BAUD_OVERFLOW", "Baud counter overflow seen on line tx",
                    "baud_shadow={count}", "baud_shadow={count},tx=0"),
        "handshake": ("ASSERT_FAIL", "UART_READY_STUCK",
                      "Sender kept ready up after the handshake", "valid=1", "ready=1,valid=1"),
        "idle": ("ASSERT_FAIL", "UART_IDLE_HIGH", "UART line not idle high after start",
                 "tx=0", "tx=0,ready=1"),
        "parity": ("ASSERT_FAIL", "UART_PARITY_ERROR", "Received parity error",
                   "parity_err=1", "parity_err=1,tx=1"),
        "edge": ("ASSERT_FAIL", "CLOCK_EDGE_FAIL", "Clock edge violation on the baud clock",
                 "edge=neg", "tx=1"),
    },
    "spi_master": {
        "data": ("SCOREBOARD_FAIL", "SB_SPI_MISO_MISMATCH",
                 "MISO byte wrong expected={expected} actual={actual}",
                 "expected={expected}|actual={actual}", "sclk=0,mosi=1"),
        "counter": ("ASSERT_FAIL", "SPI_BIT_COUNTER_OVERFLOW", "SPI transfer watchdog ran out",
                    "bit_cnt={count}", "bit_cnt={count},sclk=1"),
        "handshake": ("ASSERT_FAIL", "SPI_CS_DEASSERTED", "CS_N deasserted during a word",
                      "cs_n=1", "cs_n=1,sclk=1"),
        "idle": ("ASSERT_FAIL", "SPI_SCLK_ACTIVE_WHEN_IDLE", "SCLK active while CS_N is high",
                 "sclk=1", "sclk=1,cs_n=1"),
    },
    "gpio": {
        "data": ("SCOREBOARD_FAIL", "SB_GPIO",
                 "Pin value wrong expected={expected} actual={actual}",
                 "expected={expected}|actual={actual}", "dir_reg=0xF0"),
        "counter": ("ASSERT_FAIL", "GPIO_OUTPUT_MASK", "GPIO output enable mask ignored",
                    "dir_reg=0x0F", "dir_reg=0x0F"),
        "enable": ("ASSERT_FAIL", "ENABLE_POLARITY", "Register write seen while wr_en=0",
                   "wr_en=0", "wr_en=0"),
        "irq": ("ASSERT_FAIL", "GPIO_IRQ_STUCK", "IRQ stuck high for >1 cycle", "irq=1", "irq=1"),
    },
    "i2c_master": {
        "data": ("SCOREBOARD_FAIL", "SB_I2C_DATA",
                 "Byte wrong expected={expected} actual={actual}",
                 "expected={expected}|actual={actual}", "sda=0,scl=1"),
        "counter": ("ASSERT_FAIL", "I2C_BIT_OVERFLOW", "I2C bit counter overflow",
                    "bit_cnt={count}", "bit_cnt={count},scl=0"),
        "handshake": ("ASSERT_FAIL", "I2C_NACK_ERROR", "NACK received in the ACK window",
                      "nack=1", "sda=1,scl=1"),
        "idle": ("ASSERT_FAIL", "I2C_SDA_IDLE", "SDA line low after start", "sda=0", "sda=0,scl=1"),
        "enable": ("ASSERT_FAIL", "ENABLE_POLARITY", "Transfer write begun while wr_en=0",
                   "wr_en=0", "wr_en=0"),
        "parity": ("SCOREBOARD_FAIL", "SB_I2C_FRAME", "I2C frame integrity check failed",
                   "expected={expected}|actual={actual}", "sda=1"),
    },
}

# mutation -> checkers that may trip, best first; every module has the last one
_TRIPS = {
    "nonblocking_to_blocking": ("data",),
    "posedge_to_negedge": ("edge", "irq", "counter"),
    "reset_inversion": ("idle", "handshake", "data"),
    "enable_polarity_flip": ("enable", "data"),
    "data_width_truncation": ("data",),
    "counter_boundary_violation": ("counter",),
    "handshake_violation": ("handshake", "enable"),
    "overflow_guard_removal": ("irq", "counter"),
    "parity_check_removal": ("parity", "data"),
}


def log_templates() -> list[tuple[str, str, str]]:
    """All (mutation_id, module, template) rows."""
    rows = []
    for spec in SPECS:
        for module in L.MODULES:
            checkers = _CHECKERS[module]
            name = next(c for c in _TRIPS[spec.mutation_id] if c in checkers)
            kind, assert_id, headline, values, signals = checkers[name]
            rows.append((
                spec.mutation_id,
                module,
                f"{kind}: {headline} at cycle {{cycle}}\n"
                f"TB_LOG|kind={kind}|assert_id={assert_id}|{values}|cycle={{cycle}}"
                f"|signals={signals}\nRun stopped.",
            ))
    return rows


def synthetic_logs() -> list[tuple[str, str, str]]:
    """The templates with their numbers fixed by position: one log per pair."""
    out = []
    for n, (mutation_id, module, text) in enumerate(log_templates()):
        for name, value in (
            ("cycle", 12 + 11 * n), ("count", 17 + n), ("expected", 240 - 5 * n), ("actual", 3 * n)
        ):
            text = text.replace("{" + name + "}", str(value))
        out.append((mutation_id, module, text))
    return out


FALLBACK_LOG = ("ASSERT_FAIL: no signature kept for mutation=", " in module=", "\nRun stopped.")
PASSING_LOG = (
    "Coverage: {count}.5% of branches\nStatistics: {cycle} cycles run, nothing to report\n"
    "TB_LOG|kind=PASS|assert_id=ALL_OK\nRun finished."
)

# Augmentation: harmless lines put in front, phrasings per label, last lines. Made by rule from event kinds
# and from the checkers above.
_EVENTS = {
    "bench": ("random seed {count} taken", "phase {count} entered", "{expected} vectors queued"),
    "probe": ("sample {count} stored", "trace buffer {expected} percent free"),
    "memory": ("row {actual} opened", "row {actual} closed", "refresh after {cycle} cycles"),
    "power": ("domain {count} awake", "domain {count} asleep"),
    # the mark with a number format is one that filling leaves as it stands
    "bus": ("beat {count} of burst at {addr:04x}", "grant to port {count}", "word {data} taken from {addr}"),
    "host": ("heartbeat {cycle}", "log level {count}"),
}
NOISE_LINES = tuple(f"[{unit}] {what}" for unit, events in _EVENTS.items() for what in events)

# label -> checkers of any module that trip for it
_SHOWN_BY = {
    L.OFF_BY_ONE: ("counter",), L.HANDSHAKE: ("handshake",), L.DATA_INTEGRITY: ("data",), L.ASSIGNMENT: ("data",),
    L.EDGE: ("edge", "counter"), L.RESET: ("handshake", "data"), L.ENABLE: ("enable", "data"), L.WIDTH: ("data",),
    L.OVERFLOW_GUARD: ("counter",), L.PARITY: ("parity", "data"),
}


def _label_lines(label: str) -> tuple[str, ...]:
    """One line per checker of the label."""
    lines = [
        f"{checkers[name][0]}: [{module}] {checkers[name][2]} at cycle {{cycle}}"
        for module, checkers in _CHECKERS.items() for name in _SHOWN_BY[label] if name in checkers
    ]
    return tuple(dict.fromkeys(lines))


LABEL_LINES = {label: _label_lines(label) for label in _SHOWN_BY}
OTHER_LABEL_LINE = "ASSERT_FAIL: [unnamed] cause not listed, cycle {cycle}"
SUFFIX_LINES = (
    "[bench] {cycle} cycles in all", "[bench] results written", "[host] exit code {count}",
    "[probe] trace saved", "[power] all domains off",
)

# --- fixed values: ranges of the numbers put into a template (low, span) ----
FILL_RANGES = {
    "cycle": (20, 201),
    "count": (16, 49),
    "expected": (5, 246),
    "actual": (0, 256),
    "addr": (0, 65536),
    "data": (0, 256),
}
