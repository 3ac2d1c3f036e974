"""The derivations of `inputs.py` in DuckDB SQL, as named CTEs."""

from __future__ import annotations

from stepwright.functions.prompts import METRICS
from stepwright.functions.text import WHITESPACE

SEP = "repeat(chr(10), 5)"
EOS = "<eos>"
WHITESPACE_RUN = (r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def words(x: str) -> str:
    return (f"(CASE WHEN {strip(x)} = '' THEN []::VARCHAR[] "
            f"ELSE string_split_regex({strip(x)}, {lit(WHITESPACE_RUN)}) END)")


def tag(raw: str, name: str) -> str:
    inner = rf"regexp_extract({raw}, '(?is)<{name}(?:\s[^>]*)?>(.*?)(?:</{name}\s*>|\z)', 1)"
    bare = f"regexp_replace({inner}, '</?[A-Za-z][^>]*>', '', 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = f"replace({bare}, {lit(entity)}, {lit(char)})"
    return strip(bare)


def score(raw: str) -> str:
    return rf"coalesce(try_cast(regexp_extract({raw}, '(?i)\*\*SCORE:\*\*[\s\x0b]*([-+]?\d*\.?\d+)', 1) AS DOUBLE), 0.0)"


def find(tokens: str, needle: str) -> str:
    """First position of a token list in another, through joined text."""
    text = f"(' ' || array_to_string({tokens}, ' ') || ' ')"
    at = f"instr({text}, ' ' || array_to_string({needle}, ' ') || ' ')"
    return (f"(CASE WHEN len({needle}) = 0 THEN 0 WHEN {at} = 0 THEN -1 "
            f"ELSE len(string_split(substr({text}, 1, {at}), ' ')) - 2 END)")


def tenth(x: str) -> str:
    return f"((((({x}) % 21) - 10)::DOUBLE) / 10)"


PREF = "('prefers ' || lang || ' from ' || source)"
FIRST_LINE = "string_split(text, chr(10))[1]"


def pieces(k: str) -> str:
    width = f"((length(text) + ({k}) - 1) // ({k}))"
    return f"list_transform(range({k}), lambda i: substr(text, (i * {width} + 1)::BIGINT, ({width})::BIGINT))"


def numbered(texts: str) -> str:
    return f"list_transform({texts}, lambda t, j: 'Step ' || j || ': ' || t)"


_METRICS = ", ".join(f"({k}, '{m}')" for k, m in enumerate(METRICS))

LINES = f"""lines AS (
  SELECT doc_id AS idx, {PREF} AS preference, {FIRST_LINE} AS question, string_split(text, chr(10)) AS l
  FROM documents),
nodes AS (
  SELECT idx, preference, question, i, len(l) AS n, l[i + 1] AS thought, 'on ' || l[i + 1] AS reasoning,
    {tenth('idx + i')} AS score,
    CASE WHEN 3 * i + 1 < len(l) THEN [3 * i + 1, 3 * i + 2, 3 * i + 3]
         WHEN (i + 1) % 5 = 0 THEN [len(l) + i] ELSE []::BIGINT[] END AS children
  FROM (SELECT *, unnest(range(len(l))) AS i FROM lines))"""

PATHS = LINES + f""",
steps_down AS (
  SELECT idx, i AS parent, unnest(children) AS child, generate_subscripts(children, 1) AS ord FROM nodes),
paths AS (
  SELECT n.idx, n.i, n.children, [s.ord] AS ords, [n.i] AS ids, [n.thought] AS thoughts,
    [n.reasoning] AS reasons, [n.score] AS scores, n.preference, n.question
  FROM steps_down s JOIN nodes n ON n.idx = s.idx AND n.i = s.child WHERE s.parent = 0
  UNION ALL
  SELECT n.idx, n.i, n.children, list_append(p.ords, s.ord), list_append(p.ids, n.i),
    list_append(p.thoughts, n.thought), list_append(p.reasons, n.reasoning),
    list_append(p.scores, n.score), n.preference, n.question
  FROM paths p JOIN steps_down s ON s.idx = p.idx AND s.parent = p.i
    JOIN nodes n ON n.idx = s.idx AND n.i = s.child),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY idx ORDER BY ords) - 1 AS path_no,
    {strip(f"array_to_string({numbered('thoughts')}, {SEP})")} AS process
  FROM paths WHERE len(children) = 0)"""

PROCESS = f"""process AS (
  SELECT doc_id AS idx, {FIRST_LINE} AS question, {PREF} AS preference,
    array_to_string({numbered(pieces('doc_id % 7 + 1'))}, {SEP}) AS process,
    list_transform(range(1, n_labels + 1), lambda i: {{'critique':
      CASE WHEN i = least(n_labels, 5) THEN 'Final Answer Node.' ELSE 'critique ' || i END,
      'score': {tenth('doc_id + i')}}}) AS label,
    CASE WHEN source <> 'src3' THEN {tenth('doc_id')} END AS final_score
  FROM (SELECT *, doc_id % 7 + 1 + CASE WHEN source = 'src7' THEN 1 ELSE 0 END AS n_labels FROM documents))"""

STEPS = PROCESS + f""",
stepped AS (
  SELECT *, list_filter(list_transform(string_split(process, {SEP}), lambda x: {strip('x')}),
                        lambda x: x <> '') AS steps FROM process),
step_rows AS (
  SELECT idx, question, preference, unnest(steps) AS step, generate_subscripts(steps, 1) - 1 AS step_no,
    steps, label FROM stepped WHERE len(steps) = len(label))"""

RESPONSES = "responses AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT doc_id, {PREF} AS user_profile, {FIRST_LINE} AS initial_question, {r} AS response_no, "
    f"{numbered(pieces(f'(doc_id + {2 * r}) % 7 + 1'))} AS response, 'as given' AS answer, "
    f"CASE WHEN (doc_id + {r}) % 4 <> 0 THEN {tenth(f'doc_id * {r + 1}')} END AS score FROM documents"
    for r in range(3)) + "))"

ITEMS = f"""items AS (
  SELECT doc_id AS item_id, {PREF} AS preference, {FIRST_LINE} AS question,
    CASE WHEN source <> 'src13' THEN text END AS response_to_q, source AS model, lang AS topic,
    CASE WHEN doc_id % 2 = 0 THEN 'cot' ELSE 'zero-shot' END AS task, 'explicit' AS pref_form
  FROM documents),
metrics(k, metric) AS (VALUES {_METRICS})"""

REPLIES = ITEMS + """,
drawn AS (
  SELECT *, (item_id * (k + 1) + (item_id // 7) * (2 * k + 3) + k * k) % 11 AS z,
    CASE WHEN metric = 'acknow' THEN 'preference' ELSE 'explanation' END AS tag
  FROM items, metrics WHERE response_to_q IS NOT NULL),
replies AS (
  SELECT *, CASE WHEN z = 10 THEN 'no tags here: ' || response_to_q
    ELSE '<' || tag || '> ' || response_to_q || ' </' || tag || '><Answer> '
      || CASE WHEN z <= 5 THEN 'Yes' WHEN z <= 8 THEN 'NO' ELSE 'cannot say' END || ' </Answer>'
    END AS raw FROM drawn)"""

VERDICTS = REPLIES + f""",
verdicts AS (
  SELECT * EXCLUDE (raw), {tag('raw', 'answer')} AS answer,
    CASE WHEN metric <> 'acknow' THEN {tag('raw', 'explanation')} END AS explanation,
    CASE WHEN metric = 'acknow' THEN {tag('raw', 'preference')} END AS extract_pref FROM replies)"""


def _has(metric: str, word: str = "yes") -> str:
    return f"coalesce(bool_or(metric = '{metric}' AND contains(lower(answer), '{word}')), false)"


FLAGS = VERDICTS + f""",
said AS (
  SELECT i.item_id, any_value(i.model) AS model, any_value(i.topic) AS topic, any_value(i.task) AS task,
    any_value(i.pref_form) AS pref_form, count(v.metric) > 0 AS judged,
    {_has('acknow')} AS ack, {_has('hallucinate')} AS hal0, {_has('violate')} AS vio,
    {_has('helpful', 'no')} AS unh, {_has('innovative')} AS innovative, {_has('misleading')} AS misleading,
    {_has('deep_mining')} AS deep_mining, {_has('thoughtful')} AS thoughtful
  FROM items i LEFT JOIN verdicts v ON v.item_id = i.item_id GROUP BY i.item_id),
flags AS (
  SELECT item_id, model, topic, task, pref_form, judged, ack AS acknowledgement, ack AND hal0 AS hallucination,
    vio AS violation, unh AS error_unhelpful, ack AND NOT hal0 AND vio AND NOT unh AS error_inconsistent,
    ack AND hal0 AND vio AND NOT unh AS hallucination_of_preference_violation,
    NOT ack AND vio AND NOT unh AS preference_unaware_violation,
    NOT vio AND NOT unh AS preference_adherence_accuracy, innovative, misleading, deep_mining, thoughtful,
    innovative OR deep_mining OR thoughtful AS quality_aware_accuracy
  FROM said)"""

COMPLETIONS = f"""cut AS (SELECT *, {pieces('6')} AS p FROM documents),
completions AS (
  SELECT doc_id, doc_id // 32 AS batch_id, (doc_id // 4) % 2 AS shard, doc_id // 4 AS prompt_id,
    (doc_id % 4)::INTEGER AS gen, {PREF} || ': ' || {FIRST_LINE} AS prompt, CASE doc_id % 5
    WHEN 0 THEN 'Preamble ' || p[1] || ' Step 1: ' || p[2] || p[3] || ' Step 2: ' || p[4] || p[5] || p[6] || ' {EOS}'
    WHEN 1 THEN text
    WHEN 2 THEN 'Step 3: ' || p[1] || p[2] || p[3] || ' {EOS} Step 4: ' || p[4] || p[5] || p[6] || ' {EOS}'
    WHEN 3 THEN 'Step 1: ' || p[1] || ' Step 1: ' || p[2] || ' Step 3: ' || p[3] || ' Step 2: ' || p[4]
      || ' Step 9: ' || p[5] || 'tail' || p[6]
    ELSE 'Step 1: ' || p[1] || ' Step 2: ' || p[2] || 'Step 3: ' || p[3] || ' Step 4: ' || p[4]
      || ' Step 5: ' || p[5] || ' Step 6: ' || p[6] || ' {EOS}' END AS completion
  FROM cut)"""


def _next(after: str, number: int) -> str:
    rest = f"list_position(nums[{after} + 1:], {number})"
    return f"CASE WHEN {rest} > 0 THEN {after} + {rest} END"


COMPLETION_STEPS = COMPLETIONS + f""",
c0 AS (SELECT *, list_filter(string_split(regexp_replace(completion, '(Step [0-9]+:)', chr(1) || '\\1', 'g'), chr(1)),
  lambda x: regexp_matches(x, '^Step [0-9]+:')) AS segs FROM completions),
c1 AS (SELECT *, list_transform(segs, lambda x: regexp_extract(x, '^Step ([0-9]+):', 1)::INTEGER) AS nums FROM c0),
m1 AS (SELECT *, {_next('0', 1)} AS i1 FROM c1),
m2 AS (SELECT *, {_next('i1', 2)} AS i2 FROM m1),
m3 AS (SELECT *, {_next('i2', 3)} AS i3 FROM m2),
m4 AS (SELECT *, {_next('i3', 4)} AS i4 FROM m3),
m5 AS (SELECT *, {_next('i4', 5)} AS i5 FROM m4),
chosen AS (SELECT *, CASE WHEN i1 IS NULL THEN range(1, least(len(segs), 5) + 1)
  ELSE list_filter([i1, i2, i3, i4, i5]::BIGINT[], lambda x: x IS NOT NULL) END AS sel FROM m5),
csteps AS (SELECT * EXCLUDE (segs, nums, i1, i2, i3, i4, i5, sel),
  CASE WHEN len(segs) = 0 THEN [{strip('completion')}]
  ELSE list_transform(sel, lambda s, k: {strip('''array_to_string(
    segs[s : CASE WHEN k < len(sel) THEN sel[k + 1] - 1 ELSE s END], '')''')}) END AS steps,
  {words('completion')} AS tokens FROM chosen)"""

CRITIQUES = f"""critiques AS (
  SELECT doc_id // 4 AS prompt_id, (doc_id % 4)::INTEGER AS gen, step_no,
    CASE WHEN (doc_id + step_no) % 4 = 0 THEN 'none: ' || text
    ELSE '**Reasoning:** ' || text || ' **Score:** ' || ((doc_id + 5 * step_no) % 21 - 10) || '.5 **SCORE:** 9'
    END AS raw
  FROM documents, (VALUES (0), (1), (2)) s(step_no)),
scores AS (SELECT prompt_id, gen, step_no, {score('raw')} AS score FROM critiques)"""

SCORED = COMPLETION_STEPS + ", " + CRITIQUES + """,
step_list AS (
  SELECT batch_id, prompt_id, gen, unnest(steps) AS step, generate_subscripts(steps, 1) - 1 AS step_no FROM csteps),
scored AS (
  SELECT s.*, coalesce(c.score, 0.0) AS score FROM step_list s
  LEFT JOIN scores c ON c.prompt_id = s.prompt_id AND c.gen = s.gen AND c.step_no = s.step_no)"""

REWARDS = SCORED + f""",
token_rows AS (
  SELECT batch_id, prompt_id, gen, unnest(range(len(tokens))) AS pos, len(tokens) AS n,
    list_position(tokens, '{EOS}') AS eos_at FROM csteps),
needles AS (SELECT s.*, {words('step')} AS needle FROM scored s),
spans AS (
  SELECT d.prompt_id, d.gen, d.step_no, d.score, {find('c.tokens', 'd.needle')} AS first, len(d.needle) AS width
  FROM needles d JOIN csteps c ON c.prompt_id = d.prompt_id AND c.gen = d.gen),
covered AS (
  SELECT t.prompt_id, t.gen, t.pos, max_by(s.score, s.step_no) AS reward FROM token_rows t
  JOIN spans s ON s.prompt_id = t.prompt_id AND s.gen = t.gen AND s.first >= 0
    AND t.pos >= s.first AND t.pos < s.first + s.width GROUP BY ALL),
rewards AS (
  SELECT t.batch_id, t.prompt_id, t.gen, t.pos, coalesce(c.reward, 0.0) AS reward,
    CASE WHEN coalesce(t.eos_at, 0) = 0 OR t.pos < t.eos_at THEN 1 ELSE 0 END AS mask
  FROM token_rows t LEFT JOIN covered c ON c.prompt_id = t.prompt_id AND c.gen = t.gen AND c.pos = t.pos)"""

GRID = REWARDS + """,
batch_len AS (SELECT batch_id, max(len(tokens)) AS max_len FROM csteps GROUP BY batch_id),
cells AS (
  SELECT c.batch_id, c.prompt_id, c.gen, unnest(range(b.max_len)) AS pos
  FROM csteps c JOIN batch_len b ON b.batch_id = c.batch_id),
grid AS (
  SELECT c.*, coalesce(r.reward, 0.0) AS reward FROM cells c
  LEFT JOIN rewards r ON r.prompt_id = c.prompt_id AND r.gen = c.gen AND r.pos = c.pos),
groups AS (
  SELECT prompt_id, pos, avg(reward) AS mean, stddev_samp(reward) AS std FROM grid GROUP BY prompt_id, pos),
advantages AS (
  SELECT g.*, (g.reward - s.mean) / (s.std + 1e-8) AS adv FROM grid g
  JOIN groups s ON s.prompt_id = g.prompt_id AND s.pos = g.pos)"""


def _logged(seed: str) -> str:
    return f"(-(1 + ({seed} + length(tok) + pos) % 9)::DOUBLE / 10)"


SIGNALS = COMPLETIONS + f""",
worded AS (SELECT *, {words('completion')} AS tokens FROM completions),
spread AS (
  SELECT doc_id, batch_id, shard, prompt_id, gen, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos,
    list_position(tokens, '{EOS}') AS eos_at FROM worded),
signals AS (
  SELECT batch_id, shard, prompt_id, gen, pos,
    CASE WHEN coalesce(eos_at, 0) = 0 OR pos < eos_at THEN 1 ELSE 0 END AS mask,
    ((doc_id * 7 + pos * 3) % 21 - 10)::DOUBLE / 10 AS adv,
    {_logged('doc_id')} AS logp, {_logged('doc_id * 3')} AS old_logp, {_logged('doc_id * 5')} AS ref_logp,
    ((doc_id * 11 + length(tok) * 37 + pos) % 97)::DOUBLE / 16 AS entropy
  FROM spread),
priced AS (
  SELECT *, exp(logp - old_logp) AS ratio, exp(ref_logp - logp) - (ref_logp - logp) - 1 AS kl FROM signals)"""

POINTS = """points AS (
  SELECT CASE WHEN event_type = 'error' THEN 'eval' ELSE 'train' END AS mode, event_id AS step,
    event_type AS metric, value, ts FROM events)"""
