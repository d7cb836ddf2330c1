"""Property graphs from records: rules for nodes and edges, upserts, reconciliation, updates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeRule:
    """Nodes of ``label`` with id ``key``; ``props`` maps property names to expressions."""

    label: str
    key: Column | str
    props: dict[str, Column | str] = field(default_factory=dict)


@dataclass(frozen=True)
class EdgeRule:
    """Edges src -rel-> dst; ``target`` is a scalar or an array, ``extract`` rewrites each target."""

    src_label: str
    rel: str
    dst_label: str
    source: Column | str
    target: Column | str
    many: bool = False
    extract: Callable[[Column], Column] | None = None


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upsert_nodes(records: DataFrame, rule: NodeRule, order: str) -> DataFrame:
    """``id`` and properties; the value of the latest record with a value holds for each property.

    Records without id make no node. Equal orders: the greatest value holds.
    """
    props = {n: _c(x) for n, x in rule.props.items()}
    rows = records.select(_c(rule.key).cast("string").alias("id"), F.col(order).alias("order_"), *[x.alias(n) for n, x in props.items()]).where("id IS NOT NULL")
    best = [F.max(F.when(F.col(n).isNotNull(), F.struct("order_", n))).alias(n) for n in props]
    if not best:
        return rows.select("id").distinct()
    return rows.groupBy("id").agg(*best).select("id", *[F.col(f"{n}.{n}").alias(n) for n in props])


def edges_of(records: DataFrame, rule: EdgeRule) -> DataFrame:
    """Distinct ``src_label, src, rel, dst_label, dst``; null and empty sources and targets make no edge."""
    target = _c(rule.target)
    rows = records.select(_c(rule.source).cast("string").alias("src"), (F.explode(target) if rule.many else target).alias("dst"))
    if rule.extract:
        rows = rows.withColumn("dst", rule.extract(F.col("dst")))
    rows = rows.withColumn("dst", F.col("dst").cast("string")).where("src IS NOT NULL AND dst IS NOT NULL AND dst <> ''").distinct()
    return rows.select(F.lit(rule.src_label).alias("src_label"), "src", F.lit(rule.rel).alias("rel"), F.lit(rule.dst_label).alias("dst_label"), "dst")


def all_edges(records: DataFrame, rules: list[EdgeRule]) -> DataFrame:
    return reduce(DataFrame.unionByName, [edges_of(records, r) for r in rules])


def node_table(records: DataFrame, nodes: list[NodeRule], edges: list[EdgeRule], order: str) -> DataFrame:
    """``label, id, props, implied`` of the nodes of all rules and of the targets of edges, which need no rule (implied)."""
    made = []
    for rule in nodes:
        rows = upsert_nodes(records, rule, order)
        props = F.map_filter(F.create_map(*[x for n in rule.props for x in (F.lit(n), F.col(n).cast("string"))]), lambda k, v: v.isNotNull()) if rule.props else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
        made.append(rows.select(F.lit(rule.label).alias("label"), "id", props.alias("props")))
    known = reduce(DataFrame.unionByName, made)
    implied = all_edges(records, edges).select(F.col("dst_label").alias("label"), F.col("dst").alias("id")).distinct()
    missing = implied.join(known, ["label", "id"], "left_anti").withColumn("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return known.withColumn("implied", F.lit(False)).unionByName(missing.withColumn("implied", F.lit(True)))


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist in ``nodes`` (label, id)."""
    ids = nodes.select("label", "id")
    src = ids.withColumnsRenamed({"label": "src_label", "id": "src"})
    dst = ids.withColumnsRenamed({"label": "dst_label", "id": "dst"})
    return edges.join(src, ["src_label", "src"], "left_semi").join(dst, ["dst_label", "dst"], "left_semi")


def union_first_wins(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of several sources, of equal keys only the row of the first source that has it."""
    tagged = [s.withColumn("priority_", F.lit(i)) for i, s in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in rows.columns if c not in (key, "priority_")]
    best = F.min(F.struct("priority_", *rest)).alias("b")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"b.{c}").alias(c) for c in rest], F.col("b.priority_").alias("source_no"))


def update_properties(nodes: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nodes with the columns of the matching update; ``matched`` tells which nodes had one."""
    new = updates.select(key, F.lit(True).alias("matched"), *columns)
    return nodes.drop(*columns).join(new, key, "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def reconcile(stored: DataFrame, source: DataFrame, key: str, measure: str) -> DataFrame:
    """Full outer comparison of a measure per key: absent in the source -1, absent in the store 0."""
    a = stored.select(key, F.col(measure).alias("stored"))
    b = source.select(key, F.col(measure).alias("expected"))
    joined = a.join(b, key, "full_outer").select(key, F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("expected", F.lit(-1)).alias("expected"))
    return joined.withColumn("agrees", F.col("stored") == F.col("expected"))


def changed_files(records: DataFrame, id: str, lists: dict[str, str], renames: str) -> DataFrame:
    """``id, status, path``: status letters of list columns; a rename is D of the old and A of the new path."""
    one = lambda s: lambda p: F.struct(F.lit(s).alias("status"), p.alias("path"))
    side = lambda s, of: lambda p: one(s)(p[of])
    parts = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), one(s)) for s, c in lists.items()]
    pairs = F.coalesce(F.col(renames), F.array().cast("array<struct<old:string,new:string>>"))
    parts += [F.transform(pairs, side("D", "old")), F.transform(pairs, side("A", "new"))]
    return records.select(id, F.explode(F.concat(*parts)).alias("c")).select(id, "c.*").where("path IS NOT NULL").distinct()


def keep_columns(df: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns that exist, in the given order."""
    return df.select(*[c for c in allowed if c in df.columns])


def with_items(df: DataFrame, arrays: list[str]) -> DataFrame:
    """Records of which at least one array has an item."""
    return df.where(reduce(lambda a, b: a + b, [F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in arrays]) > 0)
