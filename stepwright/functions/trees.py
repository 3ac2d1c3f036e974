"""Root-to-leaf paths of a thought tree held in one record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwright.functions.arrays import bind
from stepwright.functions.steps import join_steps

ROOT = "0"  # fixed value: id of the root node, which is left out of paths


def is_empty_node(node: Column) -> Column:
    """A missing node, or one without any field."""
    return (node.isNull() | (node["children"].isNull() & node["thought"].isNull()
                             & node["reasoning"].isNull() & node["score"].isNull()))


def sorted_nodes(tree: Column) -> Column:
    """The tree's (key, value) entries in order of their ids, for `find`."""
    return F.array_sort(F.map_entries(tree))


def find(nodes: Column, node_id: Column) -> Column:
    """The node of an id by binary search; a look-up in a map would scan it."""
    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(nodes, middle)["key"] < node_id
        return F.when(s["low"] >= s["high"], s).otherwise(F.struct(
            F.when(below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(below, s["high"]).otherwise(middle).alias("high")))

    start = F.struct(F.lit(0).alias("low"), F.size(nodes).alias("high"))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(nodes) + F.lit(1))).cast("int"))
    at = F.aggregate(rounds, start, halve)["low"]
    return bind(F.get(nodes, at), lambda n: F.when(n["key"] == node_id, n["value"]))


def walk(tree: Column) -> Column:
    """Follow all branches from the root: (open, done, cycles).

    `done` holds the root-to-leaf paths as (ordinals, ids, on), `on` being their
    nodes. One level per fold step, the tree's size being the deepest a path can
    get; folds idle once no path is open. A branch ends without a path at a
    missing node, and at a node already on its own path, which `cycles` counts.
    """
    return bind(sorted_nodes(tree), _walk)


def _walk(nodes: Column) -> Column:
    none = F.slice(F.transform(nodes, lambda n: n["value"]), 1, 0)

    def is_cycle(path: Column) -> Column:
        earlier = F.slice(path["ids"], F.lit(1), F.size(path["ids"]) - 1)
        last = F.element_at(path["ids"], -1)
        return (last == ROOT) | F.array_contains(earlier, last)

    def step(path: Column) -> Column:
        """A path's continuations; and itself, if it ends here."""
        def at(n: Column) -> Column:
            childless = n["children"].isNull() | (F.size(n["children"]) == 0)
            leaf = ~is_empty_node(n) & childless & (F.size(path["ids"]) > 0)
            on = F.when(F.size(path["ids"]) == 0, path["on"]).otherwise(F.array_append(path["on"], n))
            whole = F.struct(path["ordinals"].alias("ordinals"), path["ids"].alias("ids"), on.alias("on"))
            return F.struct(
                F.transform(F.coalesce(n["children"], F.array().cast("array<string>")), lambda c, i: F.struct(
                    F.array_append(path["ordinals"], i).alias("ordinals"),
                    F.array_append(path["ids"], c).alias("ids"), on.alias("on"))).alias("next"),
                F.filter(F.array(whole), lambda _: leaf).alias("leaf"))

        return bind(find(nodes, F.coalesce(F.try_element_at(path["ids"], F.lit(-1)), F.lit(ROOT))), at)

    def level(state: Column) -> Column:
        return bind(F.transform(state["open"], step), lambda steps: bind(
            F.flatten(F.transform(steps, lambda s: s["next"])), lambda further: F.struct(
                F.filter(further, lambda p: ~is_cycle(p)).alias("open"),
                F.concat(state["done"], F.flatten(F.transform(steps, lambda s: s["leaf"]))).alias("done"),
                (state["cycles"] + F.size(F.filter(further, is_cycle))).alias("cycles"))))

    root = F.struct(F.array().cast("array<int>").alias("ordinals"), F.array().cast("array<string>").alias("ids"),
                    none.alias("on"))
    start = F.struct(F.array(root).alias("open"), F.slice(F.array(root), 1, 0).alias("done"), F.lit(0).alias("cycles"))


    def fold(state: Column, one: Callable[[Column], Column]) -> Column:
        rounds = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(nodes) + F.lit(1))).cast("int"))
        return F.aggregate(rounds, state, lambda s, _: F.when(F.size(s["open"]) == 0, s).otherwise(one(s)))

    # an idle round copies all that is done, so rounds are nested: few are left when no path is open
    return fold(start, lambda state: fold(state, level))


def leaf_paths(tree: Column) -> Column:
    """All root-to-leaf paths in depth-first order."""
    return F.array_sort(walk(tree)["done"], lambda a, b: _before(a["ordinals"], b["ordinals"]))


def _before(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def label_of(node: Column) -> Column:
    return F.struct(F.coalesce(node["reasoning"], F.lit("")).alias("critique"),
                    F.coalesce(node["score"].try_cast("double"), F.lit(0.0)).alias("score"))


def final_score(node: Column, raw: bool) -> Column:
    """A leaf's score; `raw` scores are JSON text, which keeps an integer an integer."""
    return F.coalesce(node["score"], F.lit("0.0") if raw else F.lit(0.0))


def path_records(paths: Column, raw: bool = False) -> Column:
    """Per path: its ids, process text, step labels and the leaf's score."""
    return F.transform(paths, lambda p: F.struct(
        p["ids"].alias("ids"), join_steps(F.transform(p["on"], lambda n: n["thought"])).alias("process"),
        F.transform(p["on"], label_of).alias("label"),
        final_score(F.element_at(p["on"], -1), raw).alias("final_score")))
