"""Graph scores on edge tables.

Vectors over nodes are frames (node, value...), matrices are frames (u, v, w). One step of an iteration
is a join on u and a sum by v, which is combined on the map side; a node with very many edges is cut
into shards for the join. Lineage is cut by written checkpoints every few steps.
"""

from __future__ import annotations

from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.namegraph import Imports, name_graph, shapes
from tidemark.operators.past import strict_past, with_sequence
from tidemark.operators.skew import hot_keys, join_salted
from tidemark.session import durable

CUT_EVERY = 4


def incidence(hubs: DataFrame, n_events: Column | int, id: str = "id", hub: str = "hub", weight: str | None = None) -> DataFrame:
    """``hubs`` with ``df`` and ``w`` = weight * ln(1 + N / df); one row per (id, hub)."""
    df = hubs.groupBy(hub).agg(F.count(F.lit(1)).alias("df"))
    tf = F.col(weight) if weight else F.lit(1.0)
    return hubs.join(df, hub).withColumn("w", tf * F.log(1 + n_events / F.col("df")))


def bipartite(inc: DataFrame, id: str = "id", hub: str = "hub") -> DataFrame:
    """Symmetric edges between events (``e:``) and hubs (``h:``) with p = w / sum of the weights at u."""
    e, h = F.concat(F.lit("e:"), F.col(id).cast("string")), F.concat(F.lit("h:"), F.col(hub).cast("string"))
    both = inc.select(e.alias("u"), h.alias("v"), "w").unionByName(inc.select(h.alias("u"), e.alias("v"), "w"))
    return transition(both)


def transition(edges: DataFrame) -> DataFrame:
    """Edges with ``p``, the share of w among all edges of u. The sums per node are combined before they are joined."""
    total = edges.groupBy("u").agg(F.sum("w").alias("t_"))
    return edges.join(total, "u").select("u", "v", "w", (F.col("w") / F.col("t_")).alias("p"))


def walk(edges: DataFrame, seeds: DataFrame, columns: list[str], alpha: float, iterations: int, rows_per_shard: int = 2_000_000, written: bool = False) -> DataFrame:
    """x <- (1 - alpha) P x + alpha s for several seed columns at once, from x = s.

    ``edges`` has (u, v, p), ``seeds`` has (node, columns) with rows where any is not 0. Mass at nodes
    without edges is lost. ``written`` says that the edges are a written table already.
    """
    edges = edges if written else durable(edges.select("u", "v", "p"))
    hot = hot_keys(edges, ["u"], rows_per_shard)
    seeds = durable(seeds.select("node", *columns))
    x = seeds
    for i in range(1, iterations + 1):
        at_u = x.withColumnRenamed("node", "u")
        moved = join_salted(edges, at_u, ["u"], hot, "inner", ["v"])
        spread = moved.select(F.col("v").alias("node"), *[((1 - alpha) * F.col("p") * F.col(c)).alias(c) for c in columns])
        back = seeds.select("node", *[(alpha * F.col(c)).alias(c) for c in columns])
        x = spread.unionByName(back).groupBy("node").agg(*[F.sum(c).alias(c) for c in columns])
        if i % CUT_EVERY == 0 and i < iterations:
            x = durable(x)
    return x


def _node(id: str = "id") -> Column:
    return F.concat(F.lit("e:"), F.col(id).cast("string"))


def _known(events: DataFrame, starts: list[int]) -> list[tuple[float, float]]:
    """Per start the numbers of earlier events with label 1 and with label 0."""
    slot = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= F.col("seq")))
    per = {r["s_"]: (r["b"], r["n"]) for r in events.groupBy(slot.alias("s_")).agg(F.sum("y").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    out, bad, n = [], 0, 0
    for i in range(len(starts)):
        b, c = per.get(i, (0, 0))
        bad, n = bad + b, n + c
        out.append((float(bad), float(n - bad)))
    return out


def _own(names: list[str], starts: list[int], block: int) -> Column:
    """Of one column per block that of the row's own block."""
    return F.get(F.array(*[F.coalesce(F.col(c), F.lit(0.0)) for c in names]), F.floor((F.col("seq") - starts[0]) / block).cast("int"))


def _unscored(events: DataFrame, columns: list[str]) -> DataFrame:
    return events.select("id", "seq", *[F.lit(0.0).alias(c) for c in columns]).limit(0)


def ppr_blocks(inc: DataFrame, events: DataFrame, starts: list[int], block: int, alpha: float = 0.15, iterations: int = 40, strict: bool = False, together: int = 16) -> DataFrame:
    """``id, seq, bad, good, score`` of the events of every block: walks seeded by the events of either label before it.

    score = bad / (bad + good + 1e-12). The walks of ``together`` blocks are columns of one pass over the edges of
    all events. With ``strict`` each block walks over the edges of the events up to its end only; then blocks are
    parts of one larger graph.
    """
    if not starts:
        return _unscored(events, ["bad", "good", "score"])
    known = _known(events, starts)
    edges = None if strict else durable(bipartite(inc).select("u", "v", "p"))
    parts = []
    for some in batched(range(len(starts)), together):
        own = [starts[i] for i in some]
        past = events.where(F.col("seq") < own[-1])
        if strict:
            tag = lambda c: F.concat_ws("#", F.col("b_"), c)
            copies = lambda df, more: df.withColumn("b_", F.explode(F.filter(F.array(*[F.lit(s) for s in own]), lambda s: F.col("seq") < s + more)))
            graph_ = copies(inc, block)
            e, h = tag(_node()), tag(F.concat(F.lit("h:"), F.col("hub").cast("string")))
            graph_ = transition(graph_.select(e.alias("u"), h.alias("v"), "w").unionByName(graph_.select(h.alias("u"), e.alias("v"), "w")))
            at = F.create_map(*[x for i, s in zip(some, own) for x in (F.lit(s), F.array(F.lit(known[i][0] or 1.0), F.lit(known[i][1] or 1.0)))])
            rows = copies(past, 0)
            seeds = rows.select(tag(_node()).alias("node"), (F.col("y") / at[F.col("b_")][0]).alias("bad"), ((1 - F.col("y")) / at[F.col("b_")][1]).alias("good"))
            x = walk(graph_, seeds, ["bad", "good"], alpha, iterations)
            asked = events.where((F.col("seq") >= own[0]) & (F.col("seq") < own[-1] + block)).withColumn("b_", starts[0] + F.floor((F.col("seq") - starts[0]) / block) * block)
            got = asked.select("id", "seq", tag(_node()).alias("node")).join(x, "node", "left").na.fill(0.0, ["bad", "good"])
        else:
            bads, goods = [f"b{i}" for i in some], [f"g{i}" for i in some]
            seen = lambda s, v, n: F.when(F.col("seq") < s, v / F.lit(n or 1.0)).otherwise(0.0)
            seeds = past.select(_node().alias("node"), *[seen(starts[i], F.col("y"), known[i][0]).alias(f"b{i}") for i in some], *[seen(starts[i], 1 - F.col("y"), known[i][1]).alias(f"g{i}") for i in some])
            x = walk(edges, seeds, [*bads, *goods], alpha, iterations, written=True)
            asked = events.where((F.col("seq") >= own[0]) & (F.col("seq") < own[-1] + block)).select("id", "seq", _node().alias("node")).join(x, "node", "left")
            got = asked.select("id", "seq", _own(bads, own, block).alias("bad"), _own(goods, own, block).alias("good"))
        parts.append(got.select("id", "seq", "bad", "good", (F.col("bad") / (F.col("bad") + F.col("good") + 1e-12)).alias("score")))
    return reduce(DataFrame.unionByName, parts)


def rn_scores(inc: DataFrame, events: DataFrame, block: int = 200, first: int = 0) -> DataFrame:
    """``id, seq, rn``: relational neighbour score of every event with the state at the start of its block.

    The sum over past events of the shared weight splits by hub: with S and T the sums of w y and w of a
    hub over earlier blocks, the score is sum(w S) / sum(w T). So there is no join of events with events.
    Events without a known hub get the rate of the earlier blocks, 0 before the first.
    """
    b = F.floor((F.col("seq") - first) / block)
    per = inc.withColumn("b_", b).groupBy("hub", "b_").agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("ww"))
    state = strict_past(per, ["hub"], "b_", {"s": ("sum", F.col("wy")), "t": ("sum", F.col("ww"))}).select("hub", "b_", "s", "t")
    # the state of (hub, block) is only needed for blocks in which the hub occurs, and these are its rows
    num = inc.withColumn("b_", b).join(state, ["hub", "b_"]).groupBy("id").agg(F.sum(F.col("w") * F.col("s")).alias("n_"), F.sum(F.col("w") * F.col("t")).alias("d_"))
    blocks = events.groupBy(b.alias("b_")).agg(F.sum("y").alias("y_"), F.count(F.lit(1)).alias("c_"))
    rate = strict_past(blocks, [], "b_", {"by": ("sum", F.col("y_")), "bn": ("sum", F.col("c_"))}).select("b_", F.coalesce(F.try_divide("by", "bn"), F.lit(0.0)).alias("g_"))
    j = events.withColumn("b_", b).join(rate, "b_").join(num, "id", "left")
    return j.select("id", "seq", F.when(F.col("d_") > 0, F.col("n_") / F.greatest("d_", F.lit(1e-9))).otherwise(F.col("g_")).alias("rn"))


def propagation_blocks(inc: DataFrame, events: DataFrame, starts: list[int], block: int, iterations: int = 3, together: int = 32) -> DataFrame:
    """``id, seq, f`` of the events of every block: events gather from hubs what hubs gather from events.

    Events before a block keep their label in it, all others start from the mean label before it. ``together`` blocks
    are columns of one pass.
    """
    if not starts:
        return _unscored(events, ["f"])
    known = _known(events, starts)
    by_id = inc.groupBy("id").agg(F.sum("w").alias("ti"))
    by_hub = inc.groupBy("hub").agg(F.sum("w").alias("th"))
    edges = durable(inc.join(by_id, "id").join(by_hub, "hub").select("id", "hub", (F.col("w") / F.col("ti")).alias("pi"), (F.col("w") / F.col("th")).alias("ph")))
    parts = []
    for some in batched(range(len(starts)), together):
        own, names = [starts[i] for i in some], [f"f{i}" for i in some]
        clamp = lambda i, other: F.when(F.col("seq") < starts[i], F.col("y").cast("double")).otherwise(other)
        f = events.select("id", "seq", "y", *[clamp(i, F.lit(known[i][0] / max(sum(known[i]), 1.0))).alias(f"f{i}") for i in some])
        for step in range(1, iterations + 1):
            h = edges.join(f.select("id", *names), "id").groupBy("hub").agg(*[F.sum(F.col("ph") * F.col(c)).alias(c) for c in names])
            g = edges.join(h, "hub").groupBy("id").agg(*[F.sum(F.col("pi") * F.col(c)).alias(c) for c in names])
            f = f.drop(*names).join(g, "id", "left").select("id", "seq", "y", *[clamp(i, F.coalesce(f"f{i}", F.lit(0.0))).alias(f"f{i}") for i in some])
            if step % CUT_EVERY == 0:
                f = durable(f)
        parts.append(f.where((F.col("seq") >= own[0]) & (F.col("seq") < own[-1] + block)).select("id", "seq", _own(names, own, block).alias("f")))
    return reduce(DataFrame.unionByName, parts)


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def pagerank(edges: DataFrame, iterations: int = 40, damping: float = 0.85, reverse: bool = False) -> DataFrame:
    """``node, rank`` of distinct edges src -> dst; mass at nodes without out-edges is lost. Starts even."""
    e = edges.select("src", "dst").distinct()
    a, b = ("dst", "src") if reverse else ("src", "dst")
    t = durable(transition(e.select(F.col(a).alias("u"), F.col(b).alias("v"), F.lit(1.0).alias("w"))).select("u", "v", "p"))
    nodes = durable(nodes_of(e))
    n = nodes.count()
    hot = hot_keys(t, ["u"], 2_000_000)
    x = nodes.withColumn("rank", F.lit(1.0 / max(n, 1)))
    for i in range(1, iterations + 1):
        moved = join_salted(t, x.withColumnRenamed("node", "u"), ["u"], hot, "inner", ["v"]).groupBy(F.col("v").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("m_"))
        x = nodes.join(moved, "node", "left").select("node", ((1 - damping) / max(n, 1) + damping * F.coalesce("m_", F.lit(0.0))).alias("rank"))
        if i % CUT_EVERY == 0 and i < iterations:
            x = durable(x)
    return x


def symmetric(edges: DataFrame) -> DataFrame:
    """Distinct unordered edges, both ways, without loops, as (u, v)."""
    e = edges.where("src <> dst")
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``node, in_deg, out_deg`` over distinct edges."""
    e = edges.select("src", "dst").distinct()
    i = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_deg"))
    o = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_deg"))
    j = nodes_of(e).join(i, "node", "left").join(o, "node", "left")
    return j.select("node", F.coalesce("in_deg", F.lit(0)).alias("in_deg"), F.coalesce("out_deg", F.lit(0)).alias("out_deg"))


def risk_walk(edges: DataFrame, mass: DataFrame, alpha: float = 0.15, iterations: int = 30) -> DataFrame:
    """``node, risk``: walk over the undirected graph seeded by ``mass`` (node, m) in proportion."""
    total = mass.agg(F.sum("m")).collect()[0][0] or 0.0
    if total <= 0:
        return nodes_of(edges).withColumn("risk", F.lit(0.0))
    t = transition(symmetric(edges).withColumn("w", F.lit(1.0)))
    return walk(t, mass.select("node", (F.col("m") / total).alias("risk")), ["risk"], alpha, iterations)


def kcore(edges: DataFrame) -> DataFrame:
    """``node, core``: true core numbers, by h-indices.

    Each node starts with its degree and takes, step by step, the greatest h such that h neighbours have h or
    more, until nothing changes. Neighbours are counted per value, with values above the node's own as
    its own, so a node with very many edges is a few rows. The one-pass variant with stale degrees is not reproduced.
    """
    near = durable(symmetric(edges))
    core = durable(nodes_of(edges).join(near.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("core")), "node", "left").na.fill(0, ["core"]))
    falling = W.partitionBy("u").orderBy(F.desc("at_")).rowsBetween(W.unboundedPreceding, 0)
    while True:
        of = lambda c, n: core.select(F.col("node").alias(c), F.col("core").alias(n))
        seen = near.join(of("v", "cv"), "v").join(of("u", "cu"), "u").groupBy("u", F.least("cu", "cv").alias("at_")).agg(F.count(F.lit(1)).alias("n_"))
        h = seen.withColumn("n_", F.sum("n_").over(falling)).groupBy(F.col("u").alias("node")).agg(F.max(F.least("at_", "n_")).alias("h_"))
        new = durable(core.join(h, "node", "left").select("node", F.coalesce("h_", F.lit(0).cast("long")).alias("core"), (F.coalesce("h_", F.lit(0)) < F.col("core")).alias("less_")))
        core = new.drop("less_")
        if new.where("less_").isEmpty():
            return core


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys, node, component``: least node of the weakly connected component, per combination of keys.

    Labels spread to neighbours and then jump to the label of their label, so long chains take
    logarithmically many steps.
    """
    keys = keys or []
    e = edges.select(*keys, F.col("src").alias("u"), F.col("dst").alias("v"))
    both = durable(e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = both.select(*keys, F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    while True:
        near = both.join(label.withColumnRenamed("node", "u"), [*keys, "u"]).groupBy(*keys, F.col("v").alias("node")).agg(F.min("component").alias("n_"))
        new = label.join(near, [*keys, "node"], "left").select(*keys, "node", F.least("component", "n_").alias("c1"), F.col("component").alias("old"))
        up = new.select(*keys, F.col("node").alias("c1"), F.col("c1").alias("c2"))
        new = durable(new.join(up, [*keys, "c1"], "left").select(*keys, "node", F.least("c1", "c2").alias("component"), "old"))
        label = new.drop("old")
        if new.where("component <> old").isEmpty():
            return label


def dependency_shape(hubs: DataFrame, edges: DataFrame | Imports, radius: int = 1, cap: int = 600) -> DataFrame:
    """Shape of the subgraph on each event's hubs and what they reach: eight numbers per event (id).

    size ln(1 + n), density, reciprocity, ln(1 + components), share of the largest component, population
    sd of in- and out-degree, share of nodes without in-edges. Expansion follows out-edges and stops
    after a step by which an event has more than ``cap`` nodes. Events with fewer than two nodes in the graph have zeros.
    Of :class:`Imports` an event's subgraph is formed in one task and no edge is written; ``edges`` are joined.
    """
    if isinstance(edges, Imports):
        hubs = durable(hubs.select("id", "hub"))
        return hubs.select("id").distinct().join(shapes(hubs, name_graph(edges, hubs), None, radius, cap), "id", "left").na.fill(0.0)
    e = edges.where("src <> dst").select("src", "dst").distinct()
    known = nodes_of(e)
    node = hubs.select("id", F.col("hub").alias("node")).distinct().join(known, "node", "left_semi")
    for step in range(radius):
        small = node.groupBy("id").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") <= cap).select("id")
        reached = (node.join(small, "id", "left_semi") if step else node).withColumnRenamed("node", "src").join(e, "src").select("id", F.col("dst").alias("node"))
        node = node.unionByName(reached).distinct()
    node = durable(node.select("id", "node"))
    n = node.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    node = node.join(n.select("id"), "id", "left_semi")
    a = node.withColumnRenamed("node", "src").join(e, "src").join(node.withColumnRenamed("node", "dst"), ["id", "dst"], "left_semi").select("id", "src", "dst")
    a = durable(a)
    back = a.join(a.select("id", F.col("dst").alias("src"), F.col("src").alias("dst")), ["id", "src", "dst"], "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("r"))
    ins, outs = a.groupBy("id", F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i")), a.groupBy("id", F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"))
    per = node.join(ins, ["id", "node"], "left").join(outs, ["id", "node"], "left").na.fill(0, ["i", "o"])
    linked = components(a, ["id"])
    comp = node.join(linked, ["id", "node"], "left").withColumn("component", F.coalesce("component", "node")).groupBy("id", "component").agg(F.count(F.lit(1)).alias("k"))
    comp = comp.groupBy("id").agg(F.count(F.lit(1)).alias("n_comp"), F.max("k").alias("largest"))
    deg = per.groupBy("id").agg(F.sum("o").alias("m"), F.stddev_pop("i").alias("sd_in"), F.stddev_pop("o").alias("sd_out"), F.avg((F.col("i") == 0).cast("double")).alias("sources"))
    j = hubs.select("id").distinct().join(n, "id", "left").join(deg, "id", "left").join(back, "id", "left").join(comp, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return j.select(
        "id", zero(F.log1p("n")).alias("size"), zero(F.try_divide("m", F.col("n") * (F.col("n") - 1))).alias("density"), zero(F.try_divide(F.col("r"), F.greatest("m", F.lit(1)))).alias("reciprocity"),
        zero(F.log1p("n_comp")).alias("components"), zero(F.col("largest") / F.col("n")).alias("largest"), zero(F.col("sd_in")).alias("sd_in"), zero(F.col("sd_out")).alias("sd_out"), zero(F.col("sources")).alias("sources"),
    )


def ppmi_blocks(inc: DataFrame, first: int, block: int) -> DataFrame:
    """``id, seq, hub, m``: positive pointwise information of every event with the hub marginals of the events before its block.

    Blocks begin at ``first`` and every ``block`` rows before and after it. Sums per hub and block, and over earlier
    blocks, take the place of a pass per block.
    """
    eps = 1e-9
    b = F.floor((F.col("seq") - first) / block)
    rows = inc.withColumn("b_", b)
    per = rows.groupBy("hub", "b_").agg(F.sum("w").alias("w_"))
    col = strict_past(per, ["hub"], "b_", {"c": ("sum", F.col("w_"))}).select("hub", "b_", (F.col("c") + eps).alias("c"))
    total = strict_past(per.groupBy("b_").agg(F.sum("w_").alias("w_")), [], "b_", {"t": ("sum", F.col("w_"))}).select("b_", "t")
    n_hubs = inc.select("hub").distinct().count()
    row = inc.groupBy("id").agg(F.sum("w").alias("r"))
    j = rows.join(col, ["hub", "b_"]).join(F.broadcast(total), "b_").join(row, "id")  # one row a block
    value = F.log(F.greatest("w", F.lit(eps)) * (F.col("t") + n_hubs * eps) / ((F.col("r") + eps) * F.col("c")) + 1e-12)
    return j.select("id", "seq", "hub", F.greatest(value, F.lit(0.0)).alias("m"))


def factor_embedding(matrix: DataFrame, rank: int, row: str = "id", column: str = "hub", value: str = "m", fit_columns: int = 20_000, fit_rows: DataFrame | None = None) -> DataFrame:
    """``row, embedding``: U sqrt(S) of a truncated SVD of a sparse matrix (one row per cell).

    The factors are fitted on the ``fit_columns`` columns with most cells, whose right factor lies on the
    driver. All columns then get their right factor from all rows (V = M^T U / S) and all rows theirs from all
    columns (U = M V / S), which changes nothing where the fit had every column. Rows without cells are not in
    the result; a row that is tied to no fitted column even through others has zeros. With ``fit_rows`` only these
    rows decide the factors, and all others are folded in by their columns.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    spark = matrix.sparkSession
    kind = matrix.schema[row].dataType.simpleString()
    cells = durable(matrix.select(row, column, F.col(value).cast("double").alias("v_")))
    counted = cells if fit_rows is None else cells.join(fit_rows.select(row).distinct(), row, "left_semi")
    cols = counted.groupBy(column).agg(F.count(F.lit(1)).alias("n_")).orderBy(F.desc("n_"), column).limit(fit_columns).collect()
    rows = with_sequence(cells.select(row).distinct(), [row], "r_")
    width = len(cols)
    k = min(rank, max(1, min(width, rows.count()) - 1)) if width else 0
    if k < 1 or width < 2:
        return rows.select(row, F.array_repeat(F.lit(0.0), rank).alias("embedding"))
    place = F.broadcast(spark.createDataFrame([(r[column], i) for i, r in enumerate(cols)], f"`{column}` {matrix.schema[column].dataType.simpleString()}, c_ int"))
    sparse = counted.join(place, column).join(rows, row).groupBy("r_").agg(F.array_sort(F.collect_list(F.struct("c_", "v_"))).alias("x"))
    m = IndexedRowMatrix(sparse.rdd.map(lambda r: IndexedRow(r[0], Vectors.sparse(width, [(c, v) for c, v in r[1]]))))
    svd = m.computeSVD(k, computeU=True)
    size = [float(s) for s in svd.s]
    u = spark.createDataFrame(svd.U.rows.map(lambda r: (r.index, [float(x) / s for x, s in zip(r.vector, size)])), "r_ long, f_ array<double>")
    u = durable(u.join(rows, "r_").select(row, "f_"))
    carried = lambda cells, to, by, f: cells.join(f, by).groupBy(to).agg(vector_to_array(Summarizer.sum(array_to_vector(F.transform("f_", lambda x: x * F.col("v_"))))).alias("f_"))
    right = carried(counted, column, row, u)
    left = carried(cells, row, column, right)
    root = F.array(*[F.lit(s**-0.5) for s in size])
    found = left.select(row, F.zip_with("f_", root, lambda x, y: x * y).alias("embedding"))
    out = rows.select(row).join(found, row, "left").select(row, F.coalesce("embedding", F.array_repeat(F.lit(0.0), k)).alias("embedding"))
    return out.select(F.col(row).cast(kind).alias(row), "embedding")


def spectral_embedding(edges: DataFrame, rank: int = 32) -> DataFrame:
    """``node, embedding``: factors of D^-1/2 S D^-1/2 of the undirected graph."""
    s = symmetric(edges)
    d = s.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("d"))
    m = s.join(d.withColumnsRenamed({"node": "u", "d": "du"}), "u").join(d.withColumnsRenamed({"node": "v", "d": "dv"}), "v")
    return factor_embedding(m.select(F.col("u").alias("node"), F.col("v").alias("col"), (1 / F.sqrt(F.col("du") * F.col("dv"))).alias("m")), rank, "node", "col", "m")


def train_distmult(triples: DataFrame, dim: int = 32, epochs: int = 10, negatives: int = 3, rate: float = 4.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Entity vectors (entity, x) and relation vectors (rel, x) of a bilinear-diagonal model of (head, rel, tail).

    Gradient steps over all triples: each epoch joins triples with the vectors, draws the tails of
    negative triples by hash and adds up the gradients per entity and relation. Vectors live in
    frames, so their number has no bound on the driver. Norms above 10 are scaled back.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    t = durable(triples.select(F.col("head").cast("string").alias("head"), F.col("rel").cast("string").alias("rel"), F.col("tail").cast("string").alias("tail")).distinct())
    start = lambda c: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.pmod(F.xxhash64(c, i, F.lit(seed)), F.lit(20001)) / 10000.0 - 1.0) * 0.5)
    ent = durable(t.select(F.col("head").alias("entity")).union(t.select("tail")).distinct().withColumn("x", start(F.col("entity"))))
    rel = t.select("rel").distinct().withColumn("x", start(F.col("rel")))
    tails = with_sequence(t.select("tail").distinct(), ["tail"], "no")
    n = tails.count()
    total = max(t.count(), 1)
    times = lambda a, b: F.zip_with(a, b, lambda p, q: p * q)
    plus = lambda rows, key: rows.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"), F.count(F.lit(1)).alias("c_"))
    for epoch in range(epochs):
        drawn = t.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(negatives)))).withColumn("no", F.pmod(F.xxhash64("head", "rel", "tail", "k", F.lit(epoch + seed)), F.lit(n)))
        drawn = drawn.join(tails.withColumnRenamed("tail", "other"), "no").withColumn("tail", F.when(F.col("k") == 0, F.col("tail")).otherwise(F.col("other")))
        v = drawn.select("head", "rel", "tail", (F.col("k") == 0).cast("double").alias("want"))
        v = v.join(ent.withColumnsRenamed({"entity": "head", "x": "h"}), "head").join(ent.withColumnsRenamed({"entity": "tail", "x": "o"}), "tail").join(rel.withColumnRenamed("x", "r"), "rel")
        score = F.aggregate(F.zip_with(times(F.col("h"), F.col("r")), F.col("o"), lambda p, q: p * q), F.lit(0.0), lambda a, x: a + x)
        v = v.withColumn("err", F.col("want") - 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score)))))
        scaled = lambda a, b: F.transform(times(F.col(a), F.col(b)), lambda x: x * F.col("err"))
        v = durable(v.select("head", "rel", "tail", scaled("r", "o").alias("gh"), scaled("h", "r").alias("gt"), scaled("h", "o").alias("gr")))
        g = plus(v.select(F.col("head").alias("entity"), F.col("gh").alias("g")).unionByName(v.select(F.col("tail").alias("entity"), F.col("gt").alias("g"))), "entity")
        step = lambda df, key, g: df.join(g, key, "left").select(key, F.when(F.col("g").isNull(), F.col("x")).otherwise(F.zip_with("x", F.transform("g", lambda y: y * rate / F.col("c_")), lambda p, q: p + q)).alias("x"))
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, y: a + y * y))
        clip = lambda df, key: df.withColumn("n_", norm).select(key, F.transform("x", lambda y: F.when(F.col("n_") > 10, y * 10 / F.col("n_")).otherwise(y)).alias("x"))
        ent = durable(clip(step(ent, "entity", g), "entity"))
        rel = durable(clip(step(rel, "rel", plus(v.select("rel", F.col("gr").alias("g")), "rel")), "rel"))
    return ent, rel


def fold_in(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``head, x``: mean of relation times tail vector over a head's triples, for heads not trained on."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    j = triples.select(F.col("head").cast("string").alias("head"), F.col("rel").cast("string").alias("rel"), F.col("tail").cast("string").alias("tail"))
    j = j.join(entities.withColumnsRenamed({"entity": "tail", "x": "o"}), "tail").join(relations.withColumnRenamed("x", "r"), "rel")
    j = j.select("head", array_to_vector(F.zip_with("o", "r", lambda p, q: p * q)).alias("v"))
    return j.groupBy("head").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("x"))
