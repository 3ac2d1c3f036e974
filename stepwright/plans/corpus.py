"""Registered queries: corpus preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwright.functions import prompts, steps
from stepwright.functions.text import STEP_SEPARATOR, words
from stepwright.operators import corpus
from stepwright.operators.skew import running_sum
from stepwright.plans import inputs
from stepwright.plans import oracle_inputs as sql
from stepwright.sources.tables import table
from stepwright.sources.workspace import written

LINE = STEP_SEPARATOR + "\n"


def label_text(label: Column) -> Column:
    """Labels as one text, for comparing."""
    return F.array_join(F.transform(label, lambda x: F.concat(
        x["critique"], F.lit("|"), F.round(x["score"] * 10).cast("bigint").cast("string"))), "\n")


LABEL_SQL = "array_to_string(list_transform({0}, lambda x: x.critique || '|' || round(x.score * 10)::BIGINT), chr(10))"


def tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.tree_paths(inputs.tree_records(spark, sf))


def thought_tree_paths(spark: SparkSession, sf: str) -> DataFrame:
    return tree_paths(spark, sf).select(
        "idx", "path_no", "question", "preference", "process", label_text(F.col("label")).alias("label"),
        F.round("final_score", 6).alias("final_score"))


def path_to_process(spark: SparkSession, sf: str) -> DataFrame:
    return tree_paths(spark, sf).select("idx", "path_no", F.size("ids").alias("depth"), "process")


def path_labels(spark: SparkSession, sf: str) -> DataFrame:
    return tree_paths(spark, sf).select(
        "idx", "path_no", F.posexplode("label").alias("step_no", "x"), "final_score").select(
        "idx", "path_no", "step_no", "x.critique", F.round("x.score", 6).alias("score"),
        F.round("final_score", 6).alias("final_score"))


def dfs_order(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of the trees as node rows, joined level by level, sorted by their ordinals."""
    nodes = written(corpus.tree_nodes(inputs.tree_records(spark, sf)), "nodes")
    paths = corpus.tree_paths_by_level(nodes)
    return paths.orderBy("idx", "ordinals").select(
        "idx", F.array_join(F.col("ordinals").cast("array<string>"), ".").alias("ordinals"),
        F.array_join("ids", ">").alias("node_ids"), F.length("process").alias("chars"))


def dfs_order_by_jumps(spark: SparkSession, sf: str) -> DataFrame:
    """The same paths by jumps over ancestors, in joins by the logarithm of the depth."""
    nodes = written(corpus.tree_nodes(inputs.tree_records(spark, sf)), "nodes")
    return corpus.tree_paths_by_jumps(nodes).orderBy("idx", "ordinals").select(
        "idx", F.array_join(F.col("ordinals").cast("array<string>"), ".").alias("ordinals"),
        F.array_join("ids", ">").alias("node_ids"), F.length("process").alias("chars"))


def tree_edge_join(spark: SparkSession, sf: str) -> DataFrame:
    joined = corpus.edge_join(corpus.tree_nodes(inputs.tree_records(spark, sf)))
    return joined.select("idx", "parent_id", "child_id", "ordinal", "thought", F.round("score", 6).alias("score"))


def dangling_children(spark: SparkSession, sf: str) -> DataFrame:
    nodes = corpus.tree_nodes(inputs.tree_records(spark, sf))
    return corpus.dangling_children(nodes).select("idx", "parent_id", "child_id", "ordinal")


def required_fields(spark: SparkSession, sf: str) -> DataFrame:
    # documents of one line have no tree, and one source has no profile
    records = inputs.tree_records(spark, sf).withColumns({
        "user_profile": F.when(~F.col("user_profile").endswith("src3"), F.col("user_profile")).otherwise(""),
        "thought_tree": F.when(F.size("thought_tree") > 1, F.col("thought_tree")).otherwise(
            F.map_from_arrays(F.slice(F.map_keys("thought_tree"), 1, 0),
                              F.slice(F.map_values("thought_tree"), 1, 0))),
    })
    return corpus.has_required_fields(records).select(
        "idx", F.col("initial_question").alias("question"), F.size("thought_tree").alias("nodes"))


def truncate_at_step6(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.processes(spark, sf).select(
        "idx", corpus.truncate_at_step6(F.col("process")).alias("process"))


def cap_labels(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.processes(spark, sf).select(
        "idx", label_text(corpus.cap_labels(F.col("label"))).alias("label"))


def append_final_score(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = corpus.clean_process(inputs.processes(spark, sf))
    return cleaned.select("idx", "process", label_text(F.col("label")).alias("label"))


def render_prompt(spark: SparkSession, sf: str) -> DataFrame:
    docs = inputs.documents(spark, sf)
    prompt = prompts.fill(prompts.ASSISTANT_TEMPLATE, preference=inputs.preference(), question=F.col("text"))
    return docs.select("doc_id", prompt.alias("prompt"))


def _fill_sql(template: str, **slots: str) -> str:
    text = sql.lit(template)
    for slot, value in slots.items():
        text = text.replace("{" + slot + "}", f"' || {value} || '")
    return text


PROMPT_SQL = _fill_sql(prompts.ASSISTANT_TEMPLATE, preference="preference", question="question")
INSTRUCTION_SQL = sql.lit(prompts.CRITIQUE_INSTRUCTION + "\n\n")


def split_steps(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.processes(spark, sf).select(
        "idx", F.posexplode(steps.split_process(F.col("process"))).alias("step_no", "step"))


def step_label_match(spark: SparkSession, sf: str) -> DataFrame:
    """Per preference: processes kept and dropped for their label count."""
    same = F.size(steps.split_process(F.col("process"))) == F.size("label")
    return inputs.processes(spark, sf).groupBy("preference").agg(
        F.count_if(same).alias("kept"), F.count_if(~same).alias("dropped"))


def examples(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.step_examples(inputs.processes(spark, sf))


def prefix_context_explode(spark: SparkSession, sf: str) -> DataFrame:
    return examples(spark, sf).select("idx", "step_no", "context", "step")


def running_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = examples(spark, sf).select("idx", "step_no", "step")
    return corpus.running_context(rows, ["idx"], "step_no", LINE).select("idx", "step_no", "context", "step")


def prompt_column() -> Column:
    return prompts.fill(prompts.ASSISTANT_TEMPLATE, preference=F.col("preference"), question=F.col("question"))


def chats(spark: SparkSession, sf: str) -> DataFrame:
    messages = prompts.critique_messages(prompt_column(), F.col("context"), F.col("step"), F.col("critique"))
    return examples(spark, sf).select("idx", "step_no", messages.alias("messages"))


def critique_messages(spark: SparkSession, sf: str) -> DataFrame:
    return chats(spark, sf).select(
        "idx", "step_no", F.col("messages")[0]["content"].alias("user"),
        F.col("messages")[1]["content"].alias("assistant"))


def critique_input(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus.step_examples(inputs.processes(spark, sf), separator="\n")
    return rows.select("idx", "step_no", prompts.critique_input(
        prompt_column(), F.col("context"), F.col("step")).alias("request"))


def chat_serialize(spark: SparkSession, sf: str) -> DataFrame:
    return chats(spark, sf).select("idx", "step_no", prompts.chat_text(F.col("messages")).alias("text"))


def loss_span(spark: SparkSession, sf: str) -> DataFrame:
    # the scoring prompt of the first step has no answer behind its marker yet
    text = prompts.chat_text(F.when(F.col("step_no") == 0, F.slice("messages", 1, 1)).otherwise(F.col("messages")))
    return chats(spark, sf).select("idx", "step_no", prompts.loss_span(text).alias("span"))


def overlength_flag(spark: SparkSession, sf: str) -> DataFrame:
    texts = chats(spark, sf).select("idx", "step_no", prompts.chat_text(F.col("messages")).alias("text"))
    sizes = texts.select("idx", "step_no", F.size(words(F.col("text"))).alias("tokens"),
                         F.size(words(prompts.loss_span(F.col("text")))).alias("answer"))
    # the marker stands between line ends, so it is a token of its own right before the answer
    return sizes.select(
        "idx", "step_no", "tokens", (F.col("tokens") > MAX_SEQUENCE).cast("int").alias("too_long"),
        (F.col("tokens") - F.col("answer") > MAX_SEQUENCE).cast("int").alias("marker_lost"))


MAX_SEQUENCE = 8192  # fixed value: longest training sequence, in tokens


def normalize_content(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"))
    parts = turns.select("conv_id", "turn", F.explode(prompts.content_parts(F.col("messages"))).alias("m"))
    return parts.select("conv_id", "turn", "m.role", F.posexplode("m.content").alias("part", "p")).select(
        "conv_id", "turn", "role", "part", "p.type", "p.text")


def transcript(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", prompts.turn_line(F.col("role"), F.col("text")).alias("line"))


def transcript_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation as one text."""
    return corpus.transcripts(table(spark, sf, "conversations"))


def cap_responses(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.multi_responses(spark, sf).select(
        "doc_id", F.posexplode(corpus.cap_responses(F.col("response_list"))).alias("response_no", "r"))
    return rows.select("doc_id", "response_no", F.size("r.response").alias("steps"), "r.answer",
                       F.round("r.score", 6).alias("score"))


def explode_responses(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.explode_responses(inputs.multi_responses(spark, sf)).select(
        "doc_id", "response_no", "instruction", "input", "output")


def join_response_lines(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.explode_responses(inputs.multi_responses(spark, sf)).select("doc_id", "response_no", "output")


def best_response(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.multi_responses(spark, sf).select(
        "doc_id", corpus.best_response(F.col("response_list")).alias("b")).select(
        "doc_id", "b.position", F.array_join("b.response", "\n").alias("output"))


def file_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as positions in one file per language, written once for the passes over them."""
    ids = table(spark, sf, "documents").select(F.col("lang").alias("source_file"), "doc_id")
    return written(running_sum(ids, ["source_file"], "doc_id", F.lit(1), "position"), "positions")


def seeded_split(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.seeded_split(file_positions(spark, sf), "source_file", "position")


def token_length_profile(spark: SparkSession, sf: str) -> DataFrame:
    # the exact median counts equal lengths together, and lengths are few
    lengths = inputs.documents(spark, sf).select("lang", "source", F.size(words(F.col("text"))).alias("n"))
    return lengths.groupBy("lang", "source").agg(
        F.count(F.lit(1)).alias("texts"), F.round(F.avg("n"), 6).alias("mean"), F.min("n").alias("min"),
        F.max("n").alias("max"), F.round(F.percentile("n", 0.5), 6).alias("median"))


QUERIES = {f.__name__: f for f in (
    thought_tree_paths, path_to_process, path_labels, dfs_order, dfs_order_by_jumps, tree_edge_join, dangling_children,
    required_fields, truncate_at_step6, cap_labels, append_final_score, render_prompt, split_steps,
    step_label_match, prefix_context_explode, running_context, critique_messages, critique_input,
    chat_serialize, loss_span, overlength_flag, normalize_content, transcript, transcript_text, cap_responses,
    explode_responses, join_response_lines, best_response, seeded_split, token_length_profile)}


def _context(closing: str) -> str:
    return f"array_to_string(list_transform(steps[1:step_no], lambda s: s || {closing}), '')"


LINE_SQL = f"{sql.SEP} || chr(10)"
USER_SQL = f"{INSTRUCTION_SQL} || {PROMPT_SQL} || {_context(LINE_SQL)} || step || {sql.SEP}"
CRITIQUE_SQL = "label[step_no + 1].critique"
MARKER_SQL = "'<|im_start|>assistant' || chr(10)"
ASKED_SQL = f"'<|im_start|>user' || chr(10) || {USER_SQL} || '<|im_end|>' || chr(10)"
CHAT_SQL = f"{ASKED_SQL} || {MARKER_SQL} || {CRITIQUE_SQL} || '<|im_end|>' || chr(10)"
CUT_SQL = f"split_part(process, {sql.SEP} || 'Step 6', 1)"
SCORED_LABEL = ("list_transform(label[1:5], lambda x, j: {'critique': x.critique || CASE WHEN "
                "j = least(len(label), 5) AND x.critique = 'Final Answer Node.' THEN chr(10) || chr(10) || "
                "'**SCORE:** ' || coalesce(final_score::VARCHAR, '') ELSE '' END, 'score': x.score})")

ORACLES = {
    "thought_tree_paths": f"""WITH RECURSIVE {sql.PATHS}
        SELECT idx, path_no, question, preference, process, array_to_string(list_transform(reasons,
          lambda r, j: r || '|' || round(scores[j] * 10)::BIGINT), chr(10)) AS label,
          round(scores[-1], 6) AS final_score FROM leaves WHERE question <> ''""",
    "path_to_process": f"""WITH RECURSIVE {sql.PATHS}
        SELECT idx, path_no, len(ids) AS depth, process FROM leaves WHERE question <> ''""",
    "path_labels": f"""WITH RECURSIVE {sql.PATHS}
        SELECT idx, path_no, generate_subscripts(ids, 1) - 1 AS step_no, unnest(reasons) AS critique,
          round(unnest(scores), 6) AS score, round(scores[-1], 6) AS final_score FROM leaves
        WHERE question <> ''""",
    "dfs_order": f"""WITH RECURSIVE {sql.PATHS}
        SELECT idx, array_to_string(list_transform(ords, lambda o: o - 1), '.') AS ordinals,
          array_to_string(ids, '>') AS node_ids, length(process) AS chars FROM leaves ORDER BY idx, path_no""",
    "dfs_order_by_jumps": f"""WITH RECURSIVE {sql.PATHS}
        SELECT idx, array_to_string(list_transform(ords, lambda o: o - 1), '.') AS ordinals,
          array_to_string(ids, '>') AS node_ids, length(process) AS chars FROM leaves ORDER BY idx, path_no""",
    "tree_edge_join": f"""WITH {sql.LINES}, edges AS (
          SELECT idx, i AS parent, unnest(children) AS child, generate_subscripts(children, 1) - 1 AS ordinal FROM nodes)
        SELECT e.idx, e.parent::VARCHAR AS parent_id, e.child::VARCHAR AS child_id, e.ordinal, n.thought,
          round(n.score, 6) AS score FROM edges e JOIN nodes n ON n.idx = e.idx AND n.i = e.child""",
    "dangling_children": f"""WITH {sql.LINES}, edges AS (
          SELECT idx, i AS parent, unnest(children) AS child, generate_subscripts(children, 1) - 1 AS ordinal FROM nodes)
        SELECT e.idx, e.parent::VARCHAR AS parent_id, e.child::VARCHAR AS child_id, e.ordinal
        FROM edges e WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.idx = e.idx AND n.i = e.child)""",
    "required_fields": f"""WITH {sql.LINES}
        SELECT idx, question, len(l) AS nodes FROM lines
        WHERE question <> '' AND len(l) > 1 AND NOT ends_with(preference, 'src3')""",
    "truncate_at_step6": f"WITH {sql.PROCESS} SELECT idx, {CUT_SQL} AS process FROM process",
    "cap_labels": f"WITH {sql.PROCESS} SELECT idx, {LABEL_SQL.format('label[1:5]')} AS label FROM process",
    "append_final_score": f"""WITH {sql.PROCESS}
        SELECT idx, {CUT_SQL} AS process, {LABEL_SQL.format(SCORED_LABEL)} AS label FROM process""",
    "render_prompt": f"""SELECT doc_id, {_fill_sql(
        prompts.ASSISTANT_TEMPLATE, preference=sql.PREF, question='text')} AS prompt FROM documents""",
    "split_steps": f"""WITH {sql.STEPS}
        SELECT idx, generate_subscripts(steps, 1) - 1 AS step_no, unnest(steps) AS step FROM stepped""",
    "step_label_match": f"""WITH {sql.STEPS}
        SELECT preference, count(*) FILTER (len(steps) = len(label)) AS kept,
          count(*) FILTER (len(steps) <> len(label)) AS dropped FROM stepped GROUP BY preference""",
    "prefix_context_explode": f"""WITH {sql.STEPS}
        SELECT idx, step_no, {_context(LINE_SQL)} AS context, step FROM step_rows""",
    "running_context": f"""WITH {sql.STEPS}
        SELECT a.idx, a.step_no, coalesce(string_agg(b.step || {LINE_SQL}, '' ORDER BY b.step_no), '') AS context,
          a.step FROM step_rows a LEFT JOIN step_rows b ON b.idx = a.idx AND b.step_no < a.step_no
        GROUP BY a.idx, a.step_no, a.step""",
    "critique_messages": f"""WITH {sql.STEPS}
        SELECT idx, step_no, {USER_SQL} AS user, {CRITIQUE_SQL} AS assistant FROM step_rows""",
    "critique_input": f"""WITH {sql.STEPS}
        SELECT idx, step_no, {INSTRUCTION_SQL} || {PROMPT_SQL} || {_context('chr(10)')} || step AS request
        FROM step_rows""",
    "chat_serialize": f"WITH {sql.STEPS} SELECT idx, step_no, {CHAT_SQL} AS text FROM step_rows",
    "loss_span": f"""WITH {sql.STEPS}
        SELECT idx, step_no, CASE WHEN contains(t, {MARKER_SQL}) THEN string_split(t, {MARKER_SQL})[-1] END AS span
        FROM (SELECT idx, step_no, CASE WHEN step_no = 0 THEN {ASKED_SQL} ELSE {CHAT_SQL} END AS t FROM step_rows)""",
    "overlength_flag": f"""WITH {sql.STEPS}, texts AS (SELECT idx, step_no, {CHAT_SQL} AS t FROM step_rows),
        sizes AS (SELECT idx, step_no, len({sql.words('t')}) AS tokens,
          len({sql.words(f"string_split(t, {MARKER_SQL})[-1]")}) AS answer FROM texts)
        SELECT idx, step_no, tokens, (tokens > {MAX_SEQUENCE})::INTEGER AS too_long,
          (tokens - answer > {MAX_SEQUENCE})::INTEGER AS marker_lost FROM sizes""",
    "normalize_content": """
        SELECT conv_id, turn, role, 0 AS part, 'image' AS type, NULL::VARCHAR AS text FROM conversations
        WHERE role = 'user' UNION ALL
        SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 1 ELSE 0 END, 'text', text FROM conversations""",
    "transcript": """SELECT conv_id, turn, upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text
        || chr(10) || chr(10) AS line FROM conversations""",
    "transcript_text": """SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text
        || chr(10) || chr(10), '' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""",
    "cap_responses": f"""WITH {sql.RESPONSES}
        SELECT doc_id, response_no, least(len(response), 5) AS steps,
          CASE WHEN len(response) > 5 THEN substr(response[5], 9) ELSE answer END AS answer,
          round(score, 6) AS score FROM responses""",
    "explode_responses": f"""WITH {sql.RESPONSES}
        SELECT doc_id, response_no, {sql.lit(prompts.SFT_INSTRUCTION)} AS instruction,
          'user_profile: ' || user_profile || chr(10) || 'initial_question: ' || initial_question AS input,
          array_to_string(response, chr(10)) AS output FROM responses""",
    "join_response_lines": f"""WITH {sql.RESPONSES}
        SELECT doc_id, response_no, array_to_string(response, chr(10)) AS output FROM responses""",
    "best_response": f"""WITH {sql.RESPONSES}
        SELECT doc_id, response_no AS position, array_to_string(response, chr(10)) AS output FROM responses
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(score, '-inf'::DOUBLE) DESC, response_no) = 1""",
    "seeded_split": """WITH numbered AS (
          SELECT lang AS source_file, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS position,
            count(*) OVER (PARTITION BY lang) AS n FROM documents),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file
          ORDER BY md5(position || '|42'), position) AS r FROM numbered)
        SELECT source_file, doc_id, position, CASE WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'test' END
          AS split FROM ranked""",
    "token_length_profile": f"""SELECT lang, source, count(*) AS texts, round(avg(n), 6) AS mean, min(n) AS min,
        max(n) AS max, round(quantile_cont(n, 0.5), 6) AS median
        FROM (SELECT lang, source, len({sql.words('text')}) AS n FROM documents) GROUP BY lang, source""",
}
