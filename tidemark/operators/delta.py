"""Versions of graphs: matching nodes between versions, deltas, soft deletion, replay."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_ordinals(nodes: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Rank from 0 among the nodes of equal keys, in the given order."""
    return nodes.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def ordinal_match(before: DataFrame, after: DataFrame, group: list[str], order: list[str], id: str = "node", value: str = "value") -> DataFrame:
    """``group, ordinal, before_id, after_id, before_value, after_value, op`` of two versions.

    Nodes match by (group, ordinal); what is left over exists on one side only. op is KEEP, UPDATES
    (value differs, null-safe), REMOVES or ADDS.
    """
    a = with_ordinals(before, group, order).select(*group, "ordinal", F.col(id).alias("before_id"), F.col(value).alias("before_value"))
    b = with_ordinals(after, group, order).select(*group, "ordinal", F.col(id).alias("after_id"), F.col(value).alias("after_value"))
    j = a.join(b, [*group, "ordinal"], "full_outer")
    op = (
        F.when(F.col("before_id").isNull(), "ADDS").when(F.col("after_id").isNull(), "REMOVES")
        .when(F.col("before_value").eqNullSafe(F.col("after_value")), "KEEP").otherwise("UPDATES")
    )
    return j.withColumn("op", op)


def moves(matched: DataFrame, before_parents: DataFrame, after_parents: DataFrame) -> DataFrame:
    """``before_id, after_id, new_parent_type``: matched nodes whose parent is of another type and not the old parent's match.

    Parents are (id, parent, parent_type).
    """
    m = matched.where("before_id IS NOT NULL AND after_id IS NOT NULL").select("before_id", "after_id")
    p = before_parents.select(F.col("id").alias("before_id"), F.col("parent").alias("bp"), F.col("parent_type").alias("bt"))
    q = after_parents.select(F.col("id").alias("after_id"), F.col("parent").alias("ap"), F.col("parent_type").alias("at_"))
    to = m.select(F.col("before_id").alias("bp"), F.col("after_id").alias("bp_after"))
    j = m.join(p, "before_id").join(q, "after_id", "left").join(to, "bp")
    return j.where(~F.col("bp_after").eqNullSafe(F.col("ap")) & ~F.coalesce("bt", F.lit("")).eqNullSafe(F.coalesce("at_", F.lit("")))).select("before_id", "after_id", F.col("at_").alias("new_parent_type"))


def multiset_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Count after minus count before per combination of keys; 0 where they agree."""
    a = before.groupBy(*keys).agg(F.count(F.lit(1)).alias("b_"))
    b = after.groupBy(*keys).agg(F.count(F.lit(1)).alias("a_"))
    j = a.join(b, keys, "full_outer")
    return j.select(*keys, (F.coalesce("a_", F.lit(0)) - F.coalesce("b_", F.lit(0))).alias("delta"))


def successive_deltas(versions: DataFrame, series: list[str], version: str, keys: list[str]) -> DataFrame:
    """``series, version, keys, delta``: counts per key against the series' version before it (first version against nothing)."""
    order = versions.select(*series, version).distinct().withColumn("v_", F.row_number().over(W.partitionBy(*series).orderBy(version)))
    counted = versions.groupBy(*series, version, *keys).agg(F.count(F.lit(1)).alias("n_")).join(order, [*series, version])
    nxt = order.select(*series, F.col(version).alias("to_"), (F.col("v_") - 1).alias("v_"))
    gone = counted.join(nxt, [*series, "v_"]).select(*series, F.col("to_").alias(version), *keys, (-F.col("n_")).alias("n_"))
    both = counted.select(*series, version, *keys, "n_").unionByName(gone)
    return both.groupBy(*series, version, *keys).agg(F.sum("n_").alias("delta")).where("delta <> 0")


def subtree_hashes(nodes: pd.DataFrame) -> dict:
    """MD5 of every subtree, from (node, parent, ast_type, value, place); children in order of place."""
    children = defaultdict(list)
    rows = {r.node: r for r in nodes.itertuples()}
    for r in sorted(rows.values(), key=lambda r: r.place):
        children[r.parent if r.parent in rows else None].append(r.node)
    out: dict = {}
    stack = [(n, False) for n in children[None]]
    while stack:
        n, done = stack.pop()
        if done:
            text = "|".join([str(rows[n].ast_type), "" if pd.isna(rows[n].value) else str(rows[n].value), *(out[c] for c in children[n])])
            out[n] = hashlib.md5(text.encode()).hexdigest()
        else:
            stack.append((n, True))
            stack += [(c, False) for c in children[n]]
    return out


def subtree_match(before: DataFrame, after: DataFrame, key: str = "file") -> DataFrame:
    """``key, before_id, after_id, how`` of two versions of each file's tree (key, node, parent, ast_type, value, place).

    Equal subtrees match first, the largest before smaller ones, in order of place; the children of
    matched nodes follow their parents; the rest matches by type and place among equals. One task holds the
    two versions of one file, never a file's history.
    """

    def diff(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        k = (a if len(a) else b)[key].iloc[0]
        ha, hb = subtree_hashes(a), subtree_hashes(b)
        size = lambda df: _sizes(df)
        sa = size(a)
        ra, rb = {r.node: r for r in a.itertuples()}, {r.node: r for r in b.itertuples()}
        kids = lambda rows: _children(rows)
        ca, cb = kids(ra), kids(rb)
        by_hash = defaultdict(list)
        for n in sorted(hb, key=lambda n: rb[n].place, reverse=True):
            by_hash[hb[n]].append(n)
        pair, used = {}, set()
        how = {}
        for n in sorted(ha, key=lambda n: (-sa[n], ra[n].place)):
            if n in pair:
                continue
            found = by_hash[ha[n]]
            while found and found[-1] in used:
                found.pop()
            if found:
                stack = [(n, found.pop())]
                while stack:
                    x, y = stack.pop()
                    if x in pair or y in used:
                        continue
                    pair[x], how[x] = y, "subtree"
                    used.add(y)
                    stack += list(zip(ca[x], cb[y]))
        left = defaultdict(list)
        for n in sorted(rb, key=lambda n: rb[n].place):
            if n not in used:
                left[rb[n].ast_type].append(n)
        for n in sorted(ra, key=lambda n: ra[n].place):
            if n not in pair and left[ra[n].ast_type]:
                pair[n], how[n] = left[ra[n].ast_type].pop(0), "place"
        used = set(pair.values())
        rows = [(k, n, pair.get(n), how.get(n, "deleted")) for n in ra] + [(k, None, n, "inserted") for n in rb if n not in used]
        return pd.DataFrame(rows, columns=[key, "before_id", "after_id", "how"])

    cols = [key, "node", "parent", "ast_type", "value", "place"]
    kind = before.schema[key].dataType.simpleString()
    node = before.schema["node"].dataType.simpleString()
    schema = f"`{key}` {kind}, before_id {node}, after_id {node}, how string"
    return before.select(*cols).groupBy(key).cogroup(after.select(*cols).groupBy(key)).applyInPandas(diff, schema)


def _children(rows: dict) -> dict:
    out = defaultdict(list)
    for r in sorted(rows.values(), key=lambda r: r.place):
        out[r.parent].append(r.node)
    return out


def _sizes(df: pd.DataFrame) -> dict:
    rows = {r.node: r for r in df.itertuples()}
    out = dict.fromkeys(rows, 1)
    depth: dict = {}

    def level(n):
        chain = []
        while n in rows and n not in depth:
            chain.append(n)
            n = rows[n].parent
        base = depth.get(n, -1)
        for i, c in enumerate(reversed(chain)):
            depth[c] = base + 1 + i

    for n in rows:
        level(n)
    for n in sorted(rows, key=lambda n: -depth[n]):
        if rows[n].parent in out:
            out[rows[n].parent] += out[n]
    return out


def soft_deleted(changes: DataFrame) -> DataFrame:
    """``node_id, removed_by, change_no``: nodes whose last add or remove is a remove, with the commit that removed them."""
    last = changes.where("node_id IS NOT NULL AND op IN ('ADDS', 'REMOVES')").groupBy("node_id").agg(F.max(F.struct("change_no", "op", "commit_id")).alias("b"))
    return last.where("b.op = 'REMOVES'").select("node_id", F.col("b.commit_id").alias("removed_by"), F.col("b.change_no").alias("change_no"))


def line_graph(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The default builder: a graph of the lines of a text (key, node, parent, ast_type, value, place).

    A line's parent is the nearest earlier line with less indentation; its type is its first word or mark.
    A builder for a language replaces it with the same columns.
    """
    schema = f"`{key}` {texts.schema[key].dataType.simpleString()}, node int, parent int, ast_type string, value string, place int"

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k, t in zip(part[key], part[text]):
                stack: list[tuple[int, int]] = []
                for i, line in enumerate((t or "").split("\n")):
                    body = line.strip()
                    if not body:
                        continue
                    indent = len(line) - len(line.lstrip())
                    while stack and stack[-1][0] >= indent:
                        stack.pop()
                    out.append((k, i, stack[-1][1] if stack else None, body.split()[0][:24], body, i))
                    stack.append((indent, i))
            df = pd.DataFrame(out, columns=[key, "node", "parent", "ast_type", "value", "place"])
            yield df.astype({"node": "int32", "parent": "Int32", "place": "int32"})

    return texts.select(key, text).mapInPandas(build, schema)


def reaching_definitions(edges: DataFrame, defs: DataFrame, key: str) -> DataFrame:
    """``key, node, var, def_node``: definitions that reach each node's entry in a control-flow graph.

    ``edges`` (key, src, dst), ``defs`` (key, node, var). A definition passes a node unless that defines
    the same variable. Runs to the fixpoint by semi-naive joins: each step only follows new facts.
    """
    from tidemark.session import durable

    made = defs.select(key, "node", "var", F.col("node").alias("def_node")).distinct()
    hop = lambda facts: facts.join(edges.withColumnRenamed("src", "node"), [key, "node"]).select(key, F.col("dst").alias("node"), "var", "def_node").distinct()
    facts = durable(hop(made))
    new = facts
    while True:
        alive = new.join(defs.select(key, "node", "var"), [key, "node", "var"], "left_anti")
        new = durable(hop(alive).join(facts, [key, "node", "var", "def_node"], "left_anti"))
        if new.isEmpty():
            return facts
        facts = durable(facts.unionByName(new))
