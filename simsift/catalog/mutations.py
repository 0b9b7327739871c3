"""Specs and match patterns of the nine source mutations."""

from __future__ import annotations

from dataclasses import dataclass

from . import labels as L


@dataclass(frozen=True)
class MutationSpec:
    mutation_id: str
    label: str
    tier: int
    description: str


# --- fixed values: ids, labels and tiers, in registration order -------------
SPECS = (
    MutationSpec("nonblocking_to_blocking", L.ASSIGNMENT, 1,
                 "Clocked assignments become blocking ones."),
    MutationSpec("posedge_to_negedge", L.EDGE, 1,
                 "Blocks trigger on the falling instead of the rising clock edge."),
    MutationSpec("reset_inversion", L.RESET, 1,
                 "The test of the active-low reset is inverted."),
    MutationSpec("enable_polarity_flip", L.ENABLE, 1,
                 "Enable tests are negated, so work is done while disabled."),
    MutationSpec("data_width_truncation", L.WIDTH, 1,
                 "Shift chains lose a bit: a slice bound drops by one or the fill widens."),
    MutationSpec("counter_boundary_violation", L.OFF_BY_ONE, 2,
                 "A strict counter bound becomes inclusive."),
    MutationSpec("handshake_violation", L.HANDSHAKE, 2,
                 "The ready term of a handshake is dropped."),
    MutationSpec("overflow_guard_removal", L.OVERFLOW_GUARD, 2,
                 "The minus-one guard of a counter compare is dropped."),
    MutationSpec("parity_check_removal", L.PARITY, 2,
                 "Parity is tied to zero and its check is disabled."),
)

# --- fixed values: match patterns -------------------------------------------
# Possessive quantifiers and run-start checks keep long white space linear.
MASKED = r'(?s)//[^\n]*|/\*.*?\*/|"(?:[^"\\]++|\\.)*+"'
PLACEHOLDER = r"__SANITIZED_(\d+)__"
NONBLOCKING = r"(?m)^([^\S\n]*+\w[\w\[\]\.]*+\s*+)<="
POSEDGE = r"\bposedge\b"
RESET_TEST = r"\bif\s*\(\s*!\s*rst_n\s*\)"
ENABLE_TEST = r"\bif\s*\(\s*(wr_en|rd_en|tx_en|rx_en|oe|cs|en|enable)\s*\)"
SHIFT_RIGHT = r"\{1'b0,\s*(\w+)\["
SHIFT_IN_LITERAL = r"\{(\w+)\[(\d+):0\],\s*(\w+)\}"
SHIFT_IN_PARAMETER = r"\{(\w+)\[(?!\d+(?:_\d+)*:0\])(\w+(?:[-+]\d+)?):0\],\s*(\w+)\}"
COUNT_BOUND = r"\b(count\w*)\s*+<\s*+(MAX\w*)"
READY_TERM = r"(?<!\s)\s*+&&\s*+ready\b"
MINUS_ONE = r"(<\s*+)(\w++)\s*+-\s*+1\b"
BIT_ABOVE_ZERO = r"\bbit_cnt\s*+>\s*+0\b"
PARITY_ASSIGN = r"(parity_reg\s*+<=\s*+)\^[^;]+;"
PARITY_TEST = r"\bif\s*\(\s*parity_err\s*\)"
PARITY_OUT = r"(\bparity\w*\s*+<=\s*+parity_reg\s*+)\^\s*+\w++\s*+;"
