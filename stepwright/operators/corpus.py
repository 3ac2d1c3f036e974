"""Training-corpus jobs: tree paths, cleaning, splitting, training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions import prompts, steps, trees
from stepwright.functions.arrays import as_rows
from stepwright.functions.text import STEP_SEPARATOR, format_score
from stepwright.sources.workspace import written


def is_complete() -> Column:
    """A question, a preference and a tree; empty counts as missing."""
    return ((F.length("initial_question") > 0) & (F.length("user_profile") > 0)
            & (F.size("thought_tree") > 0))


def has_required_fields(df: DataFrame) -> DataFrame:
    return df.where(is_complete())


def tree_paths(records: DataFrame) -> DataFrame:
    """One process record per root-to-leaf path, numbered in depth-first order.

    A record's tree stays in its row, so the fan-out needs no shuffle.
    Incomplete records have no paths; a filter would be pushed below whatever
    computes the tree, and compute it twice.
    """
    raw = records.schema["thought_tree"].dataType.valueType["score"].dataType.typeName() == "string"
    paths = F.when(is_complete(), trees.path_records(trees.leaf_paths(F.col("thought_tree")), raw))
    return (
        records
        .select("idx", F.col("initial_question").alias("question"),
                F.col("user_profile").alias("preference"), F.posexplode(paths).alias("path_no", "p"))
        .select("idx", "path_no", "question", "preference", "p.ids", "p.process", "p.label", "p.final_score")
    )


def tree_paths_by_level(nodes: DataFrame) -> DataFrame:
    """The same paths for trees kept as node rows, of any size: one join per tree level.

    Open paths meet their last node by (record, node), so a record with a third
    of all nodes is spread over them. Levels carry places and ids only, and each
    is written before the next, which cuts the lineage; thoughts and labels are
    joined once at the end. Gives (idx, ordinals, ids, process, label,
    final_score). Missing nodes and cycles end a branch.
    """
    at = nodes.withColumn("node", F.struct("children", "thought", "reasoning", "score")).where(
        ~trees.is_empty_node(F.col("node"))).select("idx", F.col("node_id").alias("at"), "children", "node")
    links = written(at.select("idx", "at", "children"), "tree-links")
    open_paths = links.where(F.col("at") == trees.ROOT).select(
        "idx", F.array().cast("array<int>").alias("ordinals"), F.array().cast("array<string>").alias("ids"), "children")
    childless = F.col("children").isNull() | (F.size("children") == 0)
    levels = []
    while True:
        branches = open_paths.select("idx", "ordinals", "ids", F.posexplode("children").alias("ordinal", "at"))
        fresh = (F.col("at") != trees.ROOT) & ~F.array_contains("ids", F.col("at"))
        level = written(branches.where(fresh).join(links, ["idx", "at"]).select(
            "idx", F.array_append("ordinals", F.col("ordinal")).alias("ordinals"),
            F.array_append("ids", F.col("at")).alias("ids"), "children"), "level")
        if level.isEmpty():
            break
        levels.append(level.where(childless).select("idx", "ordinals", "ids"))
        open_paths = level.where(~childless)
    done = levels[0] if levels else open_paths.where(F.lit(False)).select("idx", "ordinals", "ids")
    for level in levels[1:]:
        done = done.unionByName(level)
    steps_of = done.select("idx", "ordinals", "ids", F.posexplode("ids").alias("place", "at")).join(
        at.select("idx", "at", "node"), ["idx", "at"])
    # a group is one path, whose texts are its output anyway
    return _with_texts(steps_of.groupBy("idx", "ordinals", "ids").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda s: s["node"]).alias("on")), nodes)


def _with_texts(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths (idx, ordinals, ids, `on`: their nodes) as records."""
    raw = nodes.schema["score"].dataType.typeName() == "string"
    return paths.select(
        "idx", "ordinals", "ids", steps.join_steps(F.transform("on", lambda n: n["thought"])).alias("process"),
        F.transform("on", trees.label_of).alias("label"),
        trees.final_score(F.element_at("on", -1), raw).alias("final_score"))


def tree_jumps(edges: DataFrame, most_nodes: int) -> list[DataFrame]:
    """Tables (idx, at, up): every node's ancestor 1, 2, 4, ... edges up, as far as any node has one.

    `edges` (idx, at, up) lead to a node's only parent. Each table is the one before
    joined with itself, and is written, which cuts the lineage. `most_nodes` is the
    most that a record has: no node of a tree is that far down, so rows left then
    belong to cycles.
    """
    jumps, far = [edges], 1
    while 2 * far <= most_nodes:
        last = jumps[-1]
        ahead = last.select("idx", F.col("at").alias("up"), F.col("up").alias("_further"))
        longer = written(last.join(ahead, ["idx", "up"]).select("idx", "at", F.col("_further").alias("up")), "jumps")
        if longer.isEmpty():
            break
        jumps.append(longer)
        far *= 2
    return jumps


def tree_paths_by_jumps(nodes: DataFrame) -> DataFrame:
    """The same paths in a number of joins that grows with the logarithm of a tree's depth.

    First every node learns its ancestors 1, 2, 4, ... edges up. Leaves then climb by the
    largest jump they have, which tells their depth and whether their top is the root;
    those of the root gather their ancestors, each of those found so far adding the one
    a jump above it, so that every node of a path comes in once. No row holds more than
    a jump until a path is put together, and joins are on (record, node), as above.

    Records where a node has several parents (or is listed twice) have more paths than
    leaves; they go by level.
    """
    at = nodes.withColumn("node", F.struct("children", "thought", "reasoning", "score")).where(
        ~trees.is_empty_node(F.col("node"))).select("idx", F.col("node_id").alias("at"), "children", "node")
    links = written(at.select("idx", "at", "children"), "tree-links")
    childless = F.col("children").isNull() | (F.size("children") == 0)
    below = links.select("idx", F.col("at").alias("up"), F.posexplode("children").alias("ordinal", "at")).where(
        F.col("at") != trees.ROOT)
    edges = below.join(links.select("idx", "at", childless.alias("leaf")), ["idx", "at"])
    shared = written(edges.groupBy("idx", "at").count().where("count > 1").select("idx").distinct(), "shared")
    edges = written(edges.join(shared, "idx", "left_anti"), "edges")

    most = links.groupBy("idx").count().agg(F.max("count")).first()[0] or 0
    jumps = tree_jumps(edges.select("idx", "at", "up"), most)
    climbed = edges.where("leaf").select("idx", F.col("at").alias("end"), "at", F.lit(0).alias("depth"))
    for k in reversed(range(len(jumps))):
        climbed = written(climbed.join(jumps[k], ["idx", "at"], "left").select(
            "idx", "end", F.coalesce("up", "at").alias("at"),
            (F.col("depth") + F.when(F.col("up").isNotNull(), 1 << k).otherwise(0)).alias("depth")), "climbed")
    path = climbed.where(F.col("at") == trees.ROOT).select("idx", "end", F.col("end").alias("at"), F.col("depth").alias("place"))
    for k in reversed(range(len(jumps))):
        above = path.join(jumps[k], ["idx", "at"]).select(
            "idx", "end", F.col("up").alias("at"), (F.col("place") - (1 << k)).alias("place"))
        path = written(path.unionByName(above), "path-nodes")

    # the root has no edge above it and falls away here; a group is one path
    steps_of = path.join(edges.select("idx", "at", "ordinal"), ["idx", "at"]).join(
        at.select("idx", "at", "node"), ["idx", "at"])
    placed = steps_of.groupBy("idx", "end").agg(
        F.array_sort(F.collect_list(F.struct("place", "ordinal", "at", "node"))).alias("on")).select(
        "idx", F.transform("on", lambda s: s["ordinal"]).alias("ordinals"),
        F.transform("on", lambda s: s["at"]).alias("ids"), F.transform("on", lambda s: s["node"]).alias("on"))
    found = _with_texts(placed, nodes)
    if shared.isEmpty():
        return found
    return found.unionByName(tree_paths_by_level(nodes.join(shared, "idx", "left_semi")))


def cyclic_records(records: DataFrame) -> DataFrame:
    """Records whose tree leads back to a node above, with the number of such edges met."""
    return records.select("idx", trees.walk(F.col("thought_tree"))["cycles"].alias("cycles")).where(
        F.col("cycles") > 0)


def tree_nodes(records: DataFrame) -> DataFrame:
    """Nodes as rows: (idx, node_id, children, thought, reasoning, score)."""
    return records.select("idx", F.explode(F.map_entries("thought_tree")).alias("e")).select(
        "idx", F.col("e.key").alias("node_id"), F.col("e.value").alias("n")).select(
        "idx", "node_id", "n.children", "n.thought", "n.reasoning", "n.score")


def tree_edges(nodes: DataFrame) -> DataFrame:
    """Parent to child id, in sibling order; the child may not exist."""
    return nodes.select("idx", F.col("node_id").alias("parent_id"),
                        F.posexplode("children").alias("ordinal", "child_id"))


def edge_join(nodes: DataFrame) -> DataFrame:
    """Edges with their child's node; dangling edges drop out."""
    child = nodes.select("idx", F.col("node_id").alias("child_id"), "thought", "score")
    return tree_edges(nodes).join(child, ["idx", "child_id"])


def dangling_children(nodes: DataFrame) -> DataFrame:
    """Edges whose child has no node."""
    known = nodes.select("idx", F.col("node_id").alias("child_id"))
    return tree_edges(nodes).join(known, ["idx", "child_id"], "left_anti")


def truncate_at_step6(process: Column) -> Column:
    return F.substring_index(process, STEP_SEPARATOR + "Step 6", 1)


def cap_labels(label: Column) -> Column:
    return F.slice(label, 1, steps.MAX_STEPS)


# Fixed value: the critique that marks the answer node.
FINAL_CRITIQUE = "Final Answer Node."


def append_final_score(label: Column, score_text: Column) -> Column:
    """Write the record's score behind a closing final-answer critique."""
    suffix = F.concat(F.lit("\n\n**SCORE:** "), score_text)
    return F.transform(label, lambda x, i: F.struct(
        F.when((i == F.size(label) - 1) & (x["critique"] == FINAL_CRITIQUE),
               F.concat(x["critique"], suffix)).otherwise(x["critique"]).alias("critique"),
        x["score"].alias("score")))


def clean_process(df: DataFrame) -> DataFrame:
    """The three cleaning steps; an integer score prints as one when kept as text."""
    is_text = dict(df.dtypes)["final_score"] == "string"
    return (
        df.withColumn("process", truncate_at_step6(F.col("process")))
        .withColumn("label", cap_labels(F.col("label")))
        .withColumn("label", append_final_score(F.col("label"), format_score(F.col("final_score"), is_text)))
    )


def cap_responses(response_list: Column) -> Column:
    """Keep five steps per response; the fifth, without its `Step 5: `, becomes the answer."""
    def capped(r: Column) -> Column:
        too_long = F.size(r["response"]) > steps.MAX_STEPS
        kept = F.slice(r["response"], 1, steps.MAX_STEPS)
        answer = F.substring(F.element_at(kept, steps.MAX_STEPS), 9, 1 << 30)
        return F.when(too_long, F.struct(
            kept.alias("response"), answer.alias("answer"), r["score"].alias("score"))).otherwise(r)

    return F.transform(response_list, capped)


def explode_responses(df: DataFrame, instruction: str = prompts.SFT_INSTRUCTION) -> DataFrame:
    """One training triple per response."""
    return df.select(
        "*", F.posexplode(as_rows(F.col("response_list"))).alias("response_no", "r")).select(
        *[c for c in df.columns if c != "response_list"], "response_no",
        F.lit(instruction).alias("instruction"),
        prompts.sft_input(F.col("user_profile"), F.col("initial_question")).alias("input"),
        F.array_join("r.response", "\n").alias("output"))


def best_response(response_list: Column) -> Column:
    """(position, response) of the best score; missing is lowest, the first wins a tie."""
    ranked = F.transform(response_list, lambda r, i: F.struct(
        F.coalesce(r["score"], F.lit(float("-inf"))).alias("score"), (-i).alias("rank"),
        r["response"].alias("response")))
    best = F.array_max(ranked)
    return F.struct((-best["rank"]).alias("position"), best["response"].alias("response"))


def step_examples(df: DataFrame, separator: str = STEP_SEPARATOR + "\n") -> DataFrame:
    """One row per step of a process with as many steps as labels, and its context."""
    matching = F.when(F.size("steps") == F.size("label"), F.col("steps"))
    rows = df.withColumn("steps", steps.split_process(F.col("process"))).select(
        *df.columns, "steps", F.posexplode(matching).alias("step_no", "step"))
    return rows.withColumns({
        "context": steps.earlier_steps(F.col("steps"), F.col("step_no"), separator),
        "critique": F.get("label", F.col("step_no"))["critique"],
    }).drop("steps")


def running_context(step_rows: DataFrame, key: list[str], order: str, separator: str) -> DataFrame:
    """The same context for steps that already are rows.

    A group here is one process, whose context texts are its output anyway.
    """
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return step_rows.withColumn("context", F.array_join(F.transform(
        F.collect_list("step").over(before), lambda s: F.concat(s, F.lit(separator))), ""))


def seeded_split(df: DataFrame, file: str, position: str, seed: int = 42,
                 train_share: float = 0.9, prefix: int = 4) -> DataFrame:
    """Put the first floor(share * n) rows of each file's seeded shuffle into train.

    The shuffle orders positions by their hash, so files of equal length are
    split at equal positions. No file is sorted: hash-prefix counts find the
    prefix where train ends, only rows of that prefix are ranked, and every row
    then compares its hash with the file's last train hash.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws(
        "|", F.col(position).cast("string"), F.lit(str(seed))))).withColumn(
        "_prefix", F.substring("_hash", 1, prefix))
    order = F.struct(F.col("_hash"), F.col(position).alias("_position"))

    counts = hashed.groupBy(file, "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    by_prefix = Window.partitionBy(file).orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(file)
    train = F.floor(F.sum("_n").over(whole) * F.lit(train_share))
    cuts = counts.withColumn("_upto", F.sum("_n").over(by_prefix)).withColumn("_train", train).where(
        (F.col("_train") > F.col("_upto") - F.col("_n")) & (F.col("_train") <= F.col("_upto"))
    ).select(file, "_prefix", (F.col("_train") - F.col("_upto") + F.col("_n")).alias("_take"))

    at_cut = hashed.select(file, position, "_hash", "_prefix").join(cuts, [file, "_prefix"])
    rank = F.row_number().over(Window.partitionBy(file).orderBy("_hash", position))
    last = at_cut.withColumn("_rank", rank).where(F.col("_rank") == F.col("_take")).select(
        file, order.alias("_last"))
    return hashed.join(last, file, "left").withColumn(
        "split", F.when(F.coalesce(order <= F.col("_last"), F.lit(False)), "train").otherwise("test")
    ).drop("_hash", "_prefix", "_last")


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): the turns of each conversation (conv_id, turn, role, text) as one text, in order.

    What is gathered is the text that the row is to hold; for conversations
    beyond that, write `turn_line`s range-partitioned by (conv_id, turn).
    """
    line = prompts.turn_line(F.col("role"), F.col("text")).alias("line")
    lines = F.array_sort(F.collect_list(F.struct(F.col("turn"), line)))
    return turns.groupBy("conv_id").agg(lines.alias("lines")).select(
        "conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("transcript"))
