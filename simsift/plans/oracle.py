"""SQL twins of the registered queries, for the check against another engine.

Rules, templates and formats come from the catalogues; the logic is stated
again in SQL, with the rules in their plain (not linear-time) form.
"""

from __future__ import annotations

from ..catalog import formats as FM
from ..catalog import labels as L
from ..catalog import templates as T
from ..catalog.mutations import SPECS
from ..catalog.rules import RULES, UNKNOWN_EXPLANATION
from ..functions import logfields as LF
from ..functions import logparser as LP
from .derived import GOLDEN_HEAD, LONG_TARGETS, NOISY_HEAD, NOISY_TAIL, RTL


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def qlist(items) -> str:
    return "[" + ", ".join(q(i) if isinstance(i, str) else repr(i) for i in items) + "]"


def pick(items, index: str) -> str:
    return f"list_extract({qlist(items)}, ({index})::BIGINT + 1)"


def _rows(rows) -> str:
    return ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


# ---- derived inputs ---------------------------------------------------------

def _numbered(text: str, n: str) -> str:
    for name, (low, span) in (
        ("cycle", (20, 500)), ("count", (16, 49)), ("expected", (5, 246)), ("actual", (0, 256))
    ):
        text = f"replace({text}, '{{{name}}}', ({n} % {span} + {low})::VARCHAR)"
    return text


_TPL = f"tpl(mutation_id, module, template) AS (VALUES {_rows(T.log_templates())})"
_SIM = f"""{_TPL},
sim0 AS (SELECT event_id AS n, event_type,
  {pick([s.mutation_id for s in SPECS], 'event_id % 9')} AS mutation_id,
  {pick([s.label for s in SPECS], 'event_id % 9')} AS own_label,
  {pick(L.MODULES, '(event_id // 9) % 5')} AS module,
  (event_id // 45) % 4 AS form FROM events),
sim1 AS (SELECT s.*, {_numbered(f"CASE WHEN event_type = 'view' THEN {q(T.PASSING_LOG)} ELSE template END", 'n')} AS body
  FROM sim0 s JOIN tpl t ON s.mutation_id = t.mutation_id AND s.module = t.module),
sim AS (SELECT n AS id, module, mutation_id,
  CASE WHEN event_type = 'view' THEN 'Unknown' ELSE own_label END AS label,
  CASE form WHEN 0 THEN body WHEN 1 THEN split_part(body, chr(10), 1) WHEN 2 THEN split_part(body, chr(10), 2)
  ELSE {q(NOISY_HEAD[0])} || n::VARCHAR || {q(NOISY_HEAD[1])} || n::VARCHAR || {q(NOISY_HEAD[2])} || body
    || {q(NOISY_TAIL[0])} || n::VARCHAR || {q(NOISY_TAIL[1])} END AS log FROM sim1)"""
_CALLS = """calls AS (SELECT user_id % 8 AS service, event_id AS call_id, epoch_us(ts) AS ts_us,
  event_type <> 'error' AS ok FROM events)"""
_AB = """ab AS (SELECT l_returnflag AS grp, l_quantity AS manual_minutes,
  l_quantity * (1 - l_discount) AS ai_minutes FROM lineitem)"""
_SOURCES = f"""sources AS (SELECT page_id AS source_id,
  replace({q(RTL)}, '{{n}}', (page_id % 64)::VARCHAR) || html AS text FROM pages)"""
_LONG0 = pick(LONG_TARGETS, "doc_id % 16")
_LONG = f"""long AS (SELECT id, CASE WHEN target > 0 AND length(text) > 0
  THEN left(repeat(text, ceil(target / greatest(length(text), 1))::BIGINT), greatest(target, length(text))) ELSE text END AS log
  FROM (SELECT doc_id AS id, text, {_LONG0} AS target FROM documents))"""
_SPEED = """speed AS (SELECT CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE value END AS elapsed_s,
  event_id % 128 AS n_tokens FROM events)"""


def _gen(src: str = "sim") -> str:
    full = """'{"label": "' || label || '", "explanation": "seen by the model", "confidence": 0.9}'"""
    return f"""gen AS (SELECT id, CASE id % 7
  WHEN 0 THEN {full} WHEN 1 THEN 'Answer: ' || {full} || ' done'
  WHEN 2 THEN '{{"label": "' || label || '"}}' WHEN 3 THEN '{{"label": "' || label || '", '
  WHEN 4 THEN '' WHEN 5 THEN '  {{"label": "' || lower(label) || '", "explanation": "unsure", "confidence": 0.55}}' || chr(10)
  ELSE '{{"label": "' || label || '", "explanation": null, "confidence": 0.8}}' END AS generated_text FROM {src})"""


# ---- classification ---------------------------------------------------------

_LABELS = [r.label for r in RULES] + [L.UNKNOWN]
_TEXTS = [r.explanation for r in RULES] + [UNKNOWN_EXPLANATION]
_CONF = [r.confidence for r in RULES] + [L.UNKNOWN_CONFIDENCE]


def rule_of(log: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(coalesce({log}, ''), {q('(?i)' + r.plain)}) THEN {i}"
        for i, r in enumerate(RULES)
    )
    return f"CASE {cases} ELSE {len(RULES)} END"


def dbl(items, index: str) -> str:
    return f"list_extract({qlist(items)}::DOUBLE[], ({index})::BIGINT + 1)"


def verdicts(src: str, name: str = "cls", log: str = "log") -> str:
    """CTEs adding v_label, v_text, v_conf to a relation."""
    return f"""{name}0 AS (SELECT *, {rule_of(log)} AS rule FROM {src}),
{name} AS (SELECT *, {pick(_LABELS, 'rule')} AS v_label, {pick(_TEXTS, 'rule')} AS v_text,
  {dbl(_CONF, 'rule')} AS v_conf FROM {name}0)"""


def gated(threshold: float, label="v_label", text="v_text", conf="v_conf") -> tuple[str, str, str]:
    sure = f"coalesce({conf}, 0.0)"
    ok = f"{sure} >= {threshold}::DOUBLE"
    low = (f"'Low-confidence classification (' || printf('%.2f', {sure}) || ' < ' || "
           f"printf('%.2f', {threshold}::DOUBLE) || '). Check manually.'")
    return (f"CASE WHEN {ok} THEN {label} ELSE 'Unknown' END", f"CASE WHEN {ok} THEN {text} ELSE {low} END",
            f"CASE WHEN {ok} THEN {conf} ELSE {sure} END")


def cut(log: str) -> str:
    return (f"CASE WHEN length({log}) > {L.KEEP_LOG_CHARS} THEN {q(FM.TRUNCATION_MARKER)} || "
            f"right({log}, {L.KEEP_LOG_CHARS}) ELSE {log} END")


# ---- text fields ------------------------------------------------------------

def assert_id(log: str) -> str:
    return f"nullif(regexp_extract({log}, {q(LF.ASSERT_ID)}, 1), '')"


CYCLE_PLAIN = r"cycle\s*[=:]?\s*(\d+)"


def cycle(log: str) -> str:
    return f"nullif(regexp_extract({log}, {q(CYCLE_PLAIN)}, 1), '')"


def at_cycle(log: str) -> str:
    return f"nullif(regexp_extract({log}, {q(LF.AT_CYCLE)}, 1), '')"


def dump(log: str) -> str:
    pairs = (f"array_to_string(list_transform(regexp_extract_all({log}, {q(LF.SIGNAL_PAIR)}), "
             r"lambda p: regexp_replace(p, '\s*=\s*', '=')), ', ')")
    has = f"regexp_matches({log}, {q(LF.SIGNAL_DUMP)})"
    return f"CASE WHEN {has} THEN trim(regexp_extract({log}, {q(LF.SIGNAL_DUMP)}, 1)) ELSE nullif({pairs}, '') END"


def body(log: str) -> str:
    return (f"list_extract(list_filter(list_transform(list_filter(string_split({log}, chr(10)), "
            f"lambda l: starts_with(l, 'TB_LOG|')), lambda l: substr(l, 8)), lambda l: contains(l, '=')), 1)")


def field(src: str, key: str) -> str:
    parts = f"list_filter(string_split({src}, '|'), lambda p: contains(p, '=') AND trim(split_part(p, '=', 1)) = '{key}')"
    return f"trim(regexp_replace(list_extract({parts}, -1), '^[^=]*=', ''))"


def noise_free(log: str) -> str:
    for pattern in LF.NOISE:
        log = f"regexp_replace({log}, {q(pattern)}, '', 'g')"
    return rf"trim(regexp_replace({log}, '\s+', ' ', 'g'))"


def _pair(name: str, col: str) -> str:
    return f"CASE WHEN {col} <> '' THEN '{name}=' || {col} END"


def _any(col: str, patterns) -> str:
    return f"regexp_matches({col}, {q('(?i)' + '|'.join(patterns))})"


def parsed(src: str, name: str = "par") -> str:
    """CTEs adding p_label, p_text, p_conf: the structured-first parser."""
    fields = ", ".join(f"{field('body', k)} AS f_{k}" for k in LP._FIELDS)
    by_id = " ".join(
        f"WHEN contains(upper(f_kind), 'ASSERT_FAIL') AND regexp_matches(lower(f_assert_id), {q('|'.join(r.tokens))}) THEN {i}"
        for i, r in enumerate(LP.STRUCTURED_IDS, start=1)
    )
    base = len(LP.STRUCTURED_IDS) + 1
    outcomes = LP._TEXT_OUTCOMES
    fallback = " ".join(
        f"WHEN regexp_matches(lower(t_id), {q('|'.join(r.tokens))}) THEN {base + 6 + i}"
        for i, r in enumerate(LP.FALLBACK_IDS)
    )
    last = base + len(outcomes) - 1
    labels = [L.DATA_INTEGRITY] + [r.label for r in LP.STRUCTURED_IDS] + [o[0] for o in outcomes]
    confs = [0.92] + [r.confidence for r in LP.STRUCTURED_IDS] + [o[1] for o in outcomes]
    counted = "CASE WHEN f_count <> '' THEN f_count ELSE f_baud_shadow END"
    by_field = {k: f"f_{k}" for k in ("cycle", "expected", "actual", "write_fire", "ready", "signals")}
    by_field |= {"assertion_id": "f_assert_id", "count": f"({counted})"}
    plain = {"assertion_id": "t_id", "cycle": "t_cycle", "signals": "t_dump"}
    read = {
        0: {"count": "t_count", "cycle": "coalesce(t_count_at, t_cycle)"},
        1: {"cycle": "coalesce(t_at, t_cycle)"},
        2: {"expected": "t_exp", "actual": "t_act", "cycle": "t_at3"},
    }

    def explained(label: str, seen_in: str, values: dict[str, str]) -> str:
        parts = [q(seen_in), *[_pair(k, values[k]) for k in LP.DETAILS if k in values]]
        joined = f"array_to_string(list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL), '; ')"
        return f"{q(LP.CAUSES[label] + '. Seen in: ')} || {joined} || '.'"

    texts = [explained(label, LP.FROM_FIELDS, by_field) for label in labels[:base]]
    for i, (label, _) in enumerate(outcomes):
        seen_in = LP.FROM_TEXT if i < 6 else LP.FROM_ID if i < len(outcomes) - 1 else LP.FROM_NOTHING
        texts.append(explained(label, seen_in, plain | read.get(i, {})))
    explain = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts))
    return f"""{name}0 AS (SELECT *, {body('log')} AS body FROM {src}),
{name}1 AS (SELECT *, {fields}, {assert_id('log')} AS t_id, {cycle('log')} AS t_cycle, {dump('log')} AS t_dump,
  {at_cycle('log')} AS t_at,
  nullif(regexp_extract(log, {q(LP.COUNTER_VALUES)}, 1), '') AS t_count,
  nullif(regexp_extract(log, {q(LP.COUNTER_VALUES)}, 2), '') AS t_count_at,
  regexp_extract(log, {q(LP.MISMATCH_VALUES)}, 1) AS t_exp, regexp_extract(log, {q(LP.MISMATCH_VALUES)}, 2) AS t_act,
  regexp_extract(log, {q(LP.MISMATCH_VALUES)}, 3) AS t_at3 FROM {name}0),
{name}2 AS (SELECT *, CASE WHEN contains(upper(f_kind), 'SCOREBOARD_FAIL') THEN 0 {by_id}
  WHEN {_any('log', LP.TEXT_COUNTER)} THEN {base} WHEN {_any('log', LP.TEXT_HANDSHAKE)} THEN {base + 1}
  WHEN t_at3 <> '' THEN {base + 2} WHEN {_any('log', LP.TEXT_DATA)} THEN {base + 3}
  WHEN {_any('log', LP.TEXT_PARITY)} THEN {base + 4} WHEN {_any('log', LP.TEXT_ENABLE)} THEN {base + 5}
  {fallback} ELSE {last} END AS p FROM {name}1),
{name} AS (SELECT *, {pick(labels, 'p')} AS p_label, {dbl(confs, 'p')} AS p_conf,
  CASE p {explain} END AS p_text FROM {name}2)"""


# ---- masking and mutations --------------------------------------------------

MASKED = r'//[^\n]*|/\*(?s:.*?)\*/|"(?:\\(?s:.)|[^"\\])*"'


def masked(src: str = "sources", name: str = "msk") -> str:
    return f"""{name}0 AS (SELECT *, regexp_extract_all(text, {q(MASKED)}) AS literals,
  string_split_regex(text, {q(MASKED)}) AS gaps FROM {src}),
{name} AS (SELECT * EXCLUDE (gaps), array_to_string(list_transform(gaps, lambda g, i:
  CASE WHEN i = 1 THEN g ELSE '__SANITIZED_' || (i - 2)::VARCHAR || '__' || g END), '') AS masked FROM {name}0)"""


def restore(text: str) -> str:
    marks = f"regexp_extract_all({text}, '__SANITIZED_(\\d+)__', 1)"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({text}, '__SANITIZED_\\d+__'), "
            f"list_prepend(NULL, {marks})), lambda z: CASE WHEN z[2] IS NULL THEN z[1] "
            f"ELSE list_extract(literals, z[2]::BIGINT + 1) || z[1] END), '')")


def _sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {q(pattern)}, {q(to)}, 'g')"


def _lowered(text: str) -> str:
    p = r"\{(\w+)\[(\d+):0\],\s*(\w+)\}"
    g = lambda k: f"regexp_extract(m, {q(p)}, {k})"
    rebuilt = (f"list_transform(regexp_extract_all({text}, {q(p)}), lambda m: '{{' || {g(1)} || '[' || "
               f"greatest(0, {g(2)}::BIGINT - 1)::VARCHAR || ':0], ' || {g(3)} || '}}')")
    return (f"array_to_string(list_transform(list_zip(list_prepend('', {rebuilt}), "
            f"string_split_regex({text}, {q(p)})), lambda z: z[1] || z[2]), '')")


def rewrite(mutation_id: str, t: str = "masked") -> str:
    enable = r"\bif\s*\(\s*(wr_en|rd_en|tx_en|rx_en|oe|cs|en|enable)\s*\)"
    parameter = r"\{(\w+)\[(\w*[A-Za-z_]\w*(?:[-+]\d+)?|\d+[-+]\d+):0\],\s*(\w+)\}"
    return {
        "nonblocking_to_blocking": lambda: _sub(t, r"(?m)^(\s*\w[\w\[\]\.]*\s*)<=", r"\1="),
        "posedge_to_negedge": lambda: _sub(t, r"\bposedge\b", "negedge"),
        "reset_inversion": lambda: _sub(t, r"\bif\s*\(\s*!\s*rst_n\s*\)", "if (rst_n)"),
        "enable_polarity_flip": lambda: _sub(t, enable, r"if (!\1)"),
        "data_width_truncation": lambda: _sub(
            _lowered(_sub(t, r"\{1'b0,\s*(\w+)\[", r"{2'b00, \1[")), parameter, r"{\1[\2-1:0], \3}"),
        "counter_boundary_violation": lambda: _sub(t, r"\b(count\w*)\s*<\s*(MAX_DEPTH|MAX\w*)", r"\1 <= \2"),
        "handshake_violation": lambda: _sub(t, r"\s*&&\s*ready\b", ""),
        "overflow_guard_removal": lambda: _sub(
            _sub(t, r"(<\s*)(\w+)\s*-\s*1\b", r"\1\2"), r"\bbit_cnt\s*>\s*0\b", "bit_cnt >= 0"),
        "parity_check_removal": lambda: _sub(_sub(_sub(
            t, r"(parity_reg\s*<=\s*)\^[^;]+;", r"\1" + "1'b0;"), r"\bif\s*\(\s*parity_err\s*\)", "if (1'b0)"),
            r"(\bparity\w*\s*<=\s*parity_reg\s*)\^\s*\w+\s*;", r"\1;"),
    }[mutation_id]()


def mutated_one(mutation_id: str) -> str:
    return f"""WITH {_SOURCES}, {masked()}, mut AS (SELECT *, {rewrite(mutation_id)} AS rewritten FROM msk),
out AS (SELECT source_id, text, {restore('rewritten')} AS mutated FROM mut)
SELECT source_id, mutated <> text AS changed, length(mutated) AS n_chars, md5(mutated) AS mutated_md5 FROM out"""


def all_mutants() -> str:
    parts = " UNION ALL ".join(
        f"SELECT source_id, text, literals, {q(s.mutation_id)} AS mutation_id, {q(s.label)} AS label, {s.tier} AS tier, "
        f"{q(s.description)} AS description, {i} AS position, {rewrite(s.mutation_id)} AS rewritten FROM msk"
        for i, s in enumerate(SPECS)
    )
    return (f"WITH {_SOURCES}, {masked()}, mut AS ({parts}), out AS (SELECT *, {restore('rewritten')} AS mutated FROM mut), "
            "mutants AS (SELECT *, mutated <> text AS changed FROM out)")


# ---- draws, augmentation, split ---------------------------------------------

def digest(seed: int, key: str, slot: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {key}, '{slot}'))"


def whole(d: str, start: int) -> str:
    return f"('0x' || substr({d}, {start}, 15))::BIGINT"


def fill(template: str, d: str) -> str:
    out, a, b, radix = template, whole(d, 1), whole(d, 16), 1
    for name, (low, span) in T.FILL_RANGES.items():
        if name == "addr":
            radix = 1
        source = b if name in ("addr", "data") else a
        drawn = f"(({source} // {radix}) % {span} + {low})"
        radix *= span
        text = f"printf('%0{4 if name == 'addr' else 2}x', {drawn})" if source == b else f"{drawn}::VARCHAR"
        out = f"replace({out}, '{{{name}}}', {text})"
    return out


def choice(d: str, span) -> str:
    return f"(({whole(d, 16)} // {65536 * 256}) % {span})"


def choose(options, d: str) -> str:
    return pick(options, choice(d, len(options)))


_LINES = "CASE label " + " ".join(
    f"WHEN {q(k)} THEN {qlist(v)}" for k, v in T.LABEL_LINES.items()
) + f" ELSE {qlist([T.OTHER_LABEL_LINE])} END"


def augmented(src: str, n_aug: int, seed: int, key: str = "id") -> str:
    """CTE ``aug``: every row of src with copies -1..n_aug-1 and their drawn texts."""
    k = f"concat_ws(':', {key}::VARCHAR, copy::VARCHAR)"
    ds = ", ".join(f"{digest(seed, 'k', s)} AS d_{s}" for s in
                   ("noise", "noise1", "noise2", "noise3", "noise4", "line", "suffix", "module"))
    noisy = f"CASE WHEN {choice('d_noise', 2)} = 1 THEN {whole('d_noise', 1)} % 4 + 1 ELSE 0 END"
    lines = " || ".join(
        f"CASE WHEN noisy >= {i} THEN {fill(choose(T.NOISE_LINES, f'd_noise{i}'), f'd_noise{i}')} || chr(10) ELSE '' END"
        for i in range(1, 5))
    return f"""aug0 AS (SELECT s.*, copy, {k} AS k, {_LINES} AS lines FROM {src} s, unnest(range(-1, {n_aug})) AS c(copy)),
aug1 AS (SELECT *, {ds} FROM aug0), aug2 AS (SELECT *, {noisy} AS noisy FROM aug1),
aug AS (SELECT *, {lines} AS noise,
  {fill(f"list_extract(lines, {choice('d_line', 'len(lines)')} + 1)", 'd_line')} AS line,
  {fill(choose(T.SUFFIX_LINES, 'd_suffix'), 'd_suffix')} AS suffix,
  {choose(L.MODULES, 'd_module')} AS stamp FROM aug2)"""


def augmented_rows(src: str, n_aug: int, seed: int, key: str = "id") -> str:
    """CTE ``augrows``: the table the augmentation returns."""
    return augmented(src, n_aug, seed, key) + """, augrows AS (SELECT id, label, mutation_id,
  CASE WHEN copy >= 0 THEN noise || line || chr(10) || suffix ELSE log END AS log,
  CASE WHEN copy >= 0 THEN stamp ELSE module END AS module,
  CASE WHEN copy >= 0 THEN true END AS augmented, CASE WHEN copy >= 0 THEN copy END AS aug_id FROM aug)"""


def split_of(src: str, key: str, label: str = "label", train=0.70, val=0.15, seed=42) -> str:
    """CTE ``spl``: src with rank and split."""
    return f"""spl0 AS (SELECT *, coalesce({label}, 'Unknown') AS lab,
  md5(concat_ws(':', '{seed}', {key})) || {key} AS ord FROM {src}),
spl1 AS (SELECT *, row_number() OVER (PARTITION BY lab ORDER BY ord) AS rank, count(*) OVER (PARTITION BY lab) AS n FROM spl0),
spl2 AS (SELECT *, greatest(1, round_even(n * {train}::DOUBLE, 0)::BIGINT) AS t0,
  greatest(1, round_even(n * {val}::DOUBLE, 0)::BIGINT) AS v0 FROM spl1),
spl3 AS (SELECT *, CASE WHEN n - t0 - v0 >= 0 THEN t0 ELSE greatest(1, n - 2) END AS t,
  CASE WHEN n - t0 - v0 >= 0 THEN v0 WHEN n > 1 THEN 1 ELSE 0 END AS v FROM spl2),
spl AS (SELECT *, CASE WHEN rank <= t THEN 'train' WHEN rank <= t + v THEN 'val' ELSE 'test' END AS split FROM spl3)"""


# ---- generated text ---------------------------------------------------------

def model_read(src: str, name: str = "mod") -> str:
    """CTEs adding m_ok, m_label, m_text, m_conf from generated_text."""
    ws = r"regexp_replace(regexp_replace(generated_text, '^\s+', ''), '\s+$', '')"
    head = "CASE WHEN NOT starts_with(b, '{') AND contains(b, '{') THEN substr(b, strpos(b, '{')) ELSE b END"
    tail = "CASE WHEN NOT ends_with(h, '}') AND contains(h, '}') THEN left(h, length(h) - strpos(reverse(h), '}') + 1) ELSE h END"
    return f"""{name}0 AS (SELECT *, {ws} AS b FROM {src}), {name}1 AS (SELECT *, {head} AS h FROM {name}0),
{name}2 AS (SELECT *, {tail} AS w FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN json_valid(w) THEN w::JSON END AS j FROM {name}2),
{name} AS (SELECT *, coalesce(json_type(j) = 'OBJECT' AND len(list_intersect(json_keys(j), ['label', 'explanation', 'confidence'])) = 3, false) AS m_ok,
  j->>'$.label' AS m_label, j->>'$.explanation' AS m_text, (j->>'$.confidence')::DOUBLE AS m_conf FROM {name}3)"""


# ---- breaker ----------------------------------------------------------------

def breaker(threshold: int, recovery_s: int) -> str:
    """CTE ``brk``: sequential fold per service as a recursive query."""
    waited = f"(c.ts_us - b.last > {recovery_s * 1_000_000})"
    adm = f"(b.state <> 'OPEN' OR {waited})"
    cnt = f"CASE WHEN NOT {adm} THEN b.cnt WHEN c.ok AND b.state = 'OPEN' THEN 0 WHEN c.ok THEN b.cnt ELSE b.cnt + 1 END"
    return f"""{_CALLS}, num AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts_us, call_id) AS rn FROM calls),
brk AS (
  SELECT service, call_id, ts_us, ok, rn, true AS admitted, CASE WHEN NOT ok AND {threshold} <= 1 THEN 'OPEN' ELSE 'CLOSED' END AS state,
    CASE WHEN ok THEN 0 ELSE 1 END::BIGINT AS cnt, CASE WHEN ok THEN NULL ELSE ts_us END AS last FROM num WHERE rn = 1
  UNION ALL
  SELECT c.service, c.call_id, c.ts_us, c.ok, c.rn, {adm}, CASE WHEN NOT {adm} THEN 'OPEN'
      WHEN c.ok THEN 'CLOSED' WHEN ({cnt}) >= {threshold} THEN 'OPEN' WHEN b.state = 'OPEN' THEN 'HALF_OPEN' ELSE b.state END,
    ({cnt})::BIGINT, CASE WHEN {adm} AND NOT c.ok THEN c.ts_us ELSE b.last END
  FROM brk b JOIN num c ON c.service = b.service AND c.rn = b.rn + 1)"""


# ---- runs and golden runs ---------------------------------------------------

_RUNS = f"""{_SIM},
runs AS (SELECT 'm' || (id // 9)::VARCHAR AS module, sim.mutation_id, log, event_type <> 'error' AS ok, id
  FROM sim JOIN events ON event_id = id),
golden AS (SELECT module, {q(GOLDEN_HEAD)} || min(log) AS log, min(id) % 5 <> 0 AS ok FROM runs GROUP BY module)"""
_INERT = f"""hashed AS (SELECT r.*, CASE WHEN r.ok THEN sha256({noise_free('r.log')}) END AS h,
    CASE WHEN g.ok THEN sha256({noise_free('g.log')}) END AS gh FROM runs r LEFT JOIN golden g ON r.module = g.module),
inert AS (SELECT *, coalesce(h = gh, false) AS is_inert FROM hashed)"""
