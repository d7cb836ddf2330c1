"""Graph scores on commits x files and on the reference graph of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import graph as g
from tidemark.operators import tiers
from tidemark.operators.namegraph import SHAPE, Imports, core_numbers, snapshot_cores, snapshot_topology
from tidemark.plans.base import PROTOCOL_SQL, events, hub_events, sql
from tidemark.plans.join_queries import _CALLS, _TOK, _calls, _tokens
from tidemark.session import durable
from tidemark.spec import PROTOCOL



def _protocol(ev):
    """Block starts and length of the stream."""
    n = ev.count()
    return PROTOCOL.starts(n), PROTOCOL.block_length(n), PROTOCOL.first_scored(n)


def _inc(spark, d):
    ev, hubs = hub_events(spark, d)
    n = ev.count()
    both = hubs.select("id", "seq", "y", F.concat(F.lit("F:"), "hub").alias("hub")).unionByName(
        ev.where("actor IS NOT NULL").select("id", "seq", "y", F.concat(F.lit("D:"), "actor").alias("hub"))
    )
    return ev, durable(g.incidence(both, n))


def _edges(spark, d):
    return tiers.resolve_calls(*_calls(spark, d)).where("caller <> callee").select(F.col("caller").alias("src"), F.col("callee").alias("dst"))


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def incidence_idf(spark, d):
    _, inc = _inc(spark, d)
    return _r(inc.select("id", "hub", "df", "w"))


def token_incidence(spark, d):
    """Change tokens as hubs, weight n * ln(1 + N / df)."""
    ev = events(spark, d)
    t = _tokens(spark, d).join(ev.select("id"), "id", "left_semi").withColumnRenamed("token", "hub")
    return _r(g.incidence(t, ev.count(), weight="n").select("id", "hub", "df", "w"))


def transition_matrix(spark, d):
    _, inc = _inc(spark, d)
    return _r(g.bipartite(inc).select("u", "v", "p"))


def rn_block_scores(spark, d):
    ev, inc = _inc(spark, d)
    _, block, first = _protocol(ev)
    return _r(g.rn_scores(inc, ev, block, first))


def lp_3iter(spark, d):
    """Every event after the warm-up, with the labels before its block."""
    ev, inc = _inc(spark, d)
    starts, block, _ = _protocol(ev)
    return _r(g.propagation_blocks(inc, ev, starts, block, 3))


def ppr_seeded_4iter(spark, d):
    """Four steps for every event after the warm-up, seeded by the labels before its block."""
    ev, inc = _inc(spark, d)
    starts, block, _ = _protocol(ev)
    return g.ppr_blocks(inc, ev, starts, block, iterations=4).select("id", "seq", F.round("score", 6).alias("score"), F.round(F.col("bad") * 1e6, 3).alias("bad"))


def ppr_strict_past(spark, d):
    """The walk of each block over the edges before its end only."""
    ev, inc = _inc(spark, d)
    starts, block, _ = _protocol(ev)
    return _r(g.ppr_blocks(inc, ev, starts, block, iterations=6, strict=True).select("id", "seq", "score"))


def pagerank_5iter(spark, d):
    return g.pagerank(_edges(spark, d), 5).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


def reverse_pagerank_5iter(spark, d):
    return g.pagerank(_edges(spark, d), 5, reverse=True).select("node", F.round(F.col("rank") * 1000, 6).alias("rank"))


def degree_profile(spark, d):
    return g.degrees(_edges(spark, d))


def risk_diffusion(spark, d):
    _, hubs = hub_events(spark, d)
    mass = hubs.where("y = 1").groupBy(F.col("hub").alias("node")).agg(F.count(F.lit(1)).alias("m"))
    e = _edges(spark, d)
    mass = mass.join(g.nodes_of(e), "node", "left_semi")
    return g.risk_walk(e, mass, iterations=3).select("node", F.round(F.col("risk") * 1000, 6).alias("risk"))


def kcore(spark, d):
    return core_numbers(Imports(*_calls(spark, d)))


def wcc_labels(spark, d):
    return g.components(_edges(spark, d))


def dependency_shape(spark, d):
    _, hubs = hub_events(spark, d)
    return _r(g.dependency_shape(hubs, Imports(*_calls(spark, d))))


def ppmi_matrix(spark, d):
    """Of every event with the marginals before its block."""
    ev, inc = _inc(spark, d)
    _, block, first = _protocol(ev)
    return _r(g.ppmi_blocks(inc, first, block).where("m > 1e-6").select("id", "hub", "m"), 5)


def dw_embedding(spark, d):
    ev, inc = _inc(spark, d)
    _, block, first = _protocol(ev)
    return g.factor_embedding(g.ppmi_blocks(inc, first, block).where("m > 0"), 16)


def spectral_embedding(spark, d):
    return g.spectral_embedding(_edges(spark, d), 8)


def kge_foldin(spark, d, parts=4):
    """Vectors of all events after the warm-up, each from a model trained on the events before its part of the stream."""
    ev, inc = _inc(spark, d)
    n = ev.count()
    first = PROTOCOL.first_scored(n)
    t = durable(inc.select("seq", F.col("id").alias("head"), F.substring("hub", 1, 1).alias("rel"), F.col("hub").alias("tail")))
    cuts = [first + (n - first) * i // parts for i in range(parts + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        ent, rel = g.train_distmult(t.where(F.col("seq") < a), dim=8, epochs=3)
        out.append(g.fold_in(t.where((F.col("seq") >= a) & (F.col("seq") < b)), ent, rel))
    return reduce(DataFrame.unionByName, out)


SNAPSHOTS = 8
POSITIONS = ["pagerank", "rev_pagerank", "core", "in_deg", "out_deg"]


def _snapshot_edges(hubs, edges, n):
    """Edges between an event's files and what depends on them or they need, of the events before each snapshot: (snapshot, src, dst).

    Snapshot s is used by the events of the s-th eighth of the stream.
    """
    near = tiers.import_tiers(hubs, edges).where("tier IN ('T1_dep', 'T1_dry')").select("id", "other").distinct()
    touched = near.join(hubs.select("id", "seq", "hub"), "id").withColumn("made", F.floor(F.col("seq") * SNAPSHOTS / n))
    pair = touched.groupBy("hub", "other").agg(F.min("made").alias("made"))
    real = edges.where("src <> dst").select("src", "dst").distinct()
    dep = pair.join(real.withColumnsRenamed({"src": "other", "dst": "hub"}), ["hub", "other"], "left_semi").select(F.col("other").alias("src"), F.col("hub").alias("dst"), "made")
    dry = pair.join(real.withColumnsRenamed({"src": "hub", "dst": "other"}), ["hub", "other"], "left_semi").select(F.col("hub").alias("src"), F.col("other").alias("dst"), "made")
    first = dep.unionByName(dry).groupBy("src", "dst").agg(F.min("made").alias("made")).where(F.col("made") < SNAPSHOTS - 1)
    tag = lambda c: F.concat_ws("#", "s", c).alias(c)
    return durable(first.withColumn("s", F.explode(F.sequence(F.col("made") + 1, F.lit(SNAPSHOTS - 1).cast("long")))).select(tag("src"), tag("dst")))


def _snapshot_positions(e, iterations=40):
    """Place of every file in the graph of each snapshot; all snapshots are parts of one graph, so each rank is scaled by its own part's size."""
    rank = g.pagerank(e, iterations).withColumnRenamed("rank", "pagerank")
    back = g.pagerank(e, iterations, reverse=True).withColumnRenamed("rank", "rev_pagerank")
    return rank.join(back, "node").join(g.kcore(e), "node").join(g.degrees(e), "node")


def topology_positions(hubs, edges, n, iterations=40):
    """``id`` and POSITIONS: where the event's files lie in the graph as it was at the start of the event's snapshot.

    Logarithms of the mean PageRank and reverse PageRank (times the number of nodes) and of the mean degrees, and the mean core
    number, over those of the event's files that the graph has. Of :class:`Imports` no edge is written; ``edges`` are joined.
    """
    log = lambda c, k=1.0: F.log1p(F.col(c) * k).alias(c)
    if isinstance(edges, Imports):
        place, _ = snapshot_topology(hubs, edges, n, SNAPSHOTS, iterations)
        files = hubs.select("id", F.floor(F.col("seq") * SNAPSHOTS / max(n, 1)).cast("long").alias("snapshot"), F.col("hub").alias("node"))
        own = files.join(durable(place), ["snapshot", "node"]).groupBy("id").agg(*[F.avg(c).alias(c) for c in POSITIONS])
        return own.select("id", log("pagerank"), log("rev_pagerank"), "core", log("in_deg"), log("out_deg"))
    e = _snapshot_edges(hubs, edges, n)
    total = g.nodes_of(e).count()
    at = F.concat_ws("#", F.floor(F.col("seq") * SNAPSHOTS / n), "hub").alias("node")
    own = hubs.select("id", at).join(_snapshot_positions(e, iterations), "node").groupBy("id").agg(*[F.avg(c).alias(c) for c in POSITIONS])
    return own.select("id", log("pagerank", float(max(total, 1))), log("rev_pagerank", float(max(total, 1))), "core", log("in_deg"), log("out_deg"))


def topology_snapshots(spark, d):
    """Degrees and core numbers of the files at the start of each of eight snapshots, past only."""
    ev, hubs = hub_events(spark, d)
    return snapshot_cores(hubs, Imports(*_calls(spark, d)), ev.count(), SNAPSHOTS)


def topology_features(spark, d):
    """Place, spread of risk and shape per event, on the snapshot before it."""
    ev, hubs = hub_events(spark, d)
    n, hubs = ev.count(), durable(hubs.select("id", "seq", "y", "hub"))
    # risk: of the buggy events of a file before each snapshot, over those of the event's files to which it spreads
    place, shape = snapshot_topology(hubs, Imports(*_calls(spark, d)), n, SNAPSHOTS, 10)
    own = hubs.select("id", F.floor(F.col("seq") * SNAPSHOTS / max(n, 1)).cast("long").alias("snapshot"), F.col("hub").alias("node"))
    means = own.join(place.hint("merge"), ["snapshot", "node"]).groupBy("id").agg(*[F.avg(c).alias(c) for c in POSITIONS], F.avg("risk").alias("r1"), F.max("risk").alias("r2"))
    log = lambda c: F.log1p(F.col(c)).alias(c)
    means = means.select("id", log("pagerank"), log("rev_pagerank"), "core", log("in_deg"), log("out_deg"), F.log1p("r1").alias("risk_mean"), F.log1p("r2").alias("risk_max"))
    out = ev.select("id", "seq").join(means, "id", "left").join(shape, "id", "left").na.fill(0.0)
    return _r(out.select("id", "seq", *POSITIONS, *SHAPE, "risk_mean", "risk_max"))


QUERIES = {
    f.__name__: f
    for f in (
        incidence_idf, token_incidence, transition_matrix, rn_block_scores, lp_3iter, ppr_seeded_4iter, ppr_strict_past, pagerank_5iter, reverse_pagerank_5iter, degree_profile,
        risk_diffusion, kcore, wcc_labels, dependency_shape, ppmi_matrix, dw_embedding, spectral_embedding, kge_foldin, topology_snapshots, topology_features,
    )
}

_INC = """bh AS (SELECT id, seq, y, 'F:' || hub AS hub FROM hub UNION ALL SELECT id, seq, y, 'D:' || actor FROM ev WHERE actor IS NOT NULL),
inc AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY hub) AS df, ln(1 + (SELECT count(*) FROM ev) / count(*) OVER (PARTITION BY hub)) AS w FROM bh),
tr AS MATERIALIZED (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS p FROM (SELECT 'e:' || id AS u, 'h:' || hub AS v, w FROM inc UNION ALL SELECT 'h:' || hub, 'e:' || id, w FROM inc))"""


def _walk(names, seed, steps, t="tr", a=0.15):
    """Unrolled walk: x0 is the seed table (node, names)."""
    out = [f"x0 AS MATERIALIZED ({seed})"]
    for i in range(1, steps + 1):
        sums = ", ".join(f"sum({n}) AS {n}" for n in names)
        moved = ", ".join(f"{1 - a} * p * {n} AS {n}" for n in names)
        back = ", ".join(f"{a} * {n}" for n in names)
        out.append(f"x{i} AS MATERIALIZED (SELECT node, {sums} FROM (SELECT v AS node, {moved} FROM {t} JOIN x{i - 1} ON u = node UNION ALL SELECT node, {back} FROM x0) GROUP BY node)")
    return ", ".join(out)


def _pr(a, b, steps):
    out = [f"e1 AS (SELECT DISTINCT caller AS src, callee AS dst FROM cg WHERE caller <> callee), nd AS (SELECT src AS node FROM e1 UNION SELECT dst FROM e1), tt AS (SELECT {a} AS u, {b} AS v, 1.0 / count(*) OVER (PARTITION BY {a}) AS p FROM e1), r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM nd) AS r FROM nd)"]
    out += [f"r{i} AS MATERIALIZED (SELECT nd.node, 0.15 / (SELECT count(*) FROM nd) + 0.85 * coalesce(sum(p * r), 0) AS r FROM nd LEFT JOIN tt ON tt.v = nd.node LEFT JOIN r{i - 1} q ON q.node = tt.u GROUP BY nd.node)" for i in range(1, steps + 1)]
    return ", ".join(out)


_E1 = "e1 AS (SELECT DISTINCT caller AS src, callee AS dst FROM cg WHERE caller <> callee)"
_SY = "sy AS (SELECT u, v, 1.0 / count(*) OVER (PARTITION BY u) AS p FROM (SELECT src AS u, dst AS v FROM e1 UNION SELECT dst, src FROM e1))"
_LP = ["le AS MATERIALIZED (SELECT id, hub, w / sum(w) OVER (PARTITION BY id) AS pi, w / sum(w) OVER (PARTITION BY hub) AS ph FROM inc)",
  "es AS MATERIALIZED (SELECT s, m, id, seq, y, seq < s AS past FROM ev, st)", "f0 AS (SELECT *, CASE WHEN past THEN y ELSE avg(y) FILTER (past) OVER (PARTITION BY s) END::DOUBLE AS f FROM es)"]
_LP += [x for i in (1, 2, 3) for x in (f"h{i} AS MATERIALIZED (SELECT s, hub, sum(ph * f) AS h FROM le JOIN f{i - 1} USING (id) GROUP BY s, hub)", f"f{i} AS MATERIALIZED (SELECT e.*, CASE WHEN past THEN e.y ELSE coalesce(q.g, 0) END::DOUBLE AS f FROM es e LEFT JOIN (SELECT s, id, sum(pi * h) AS g FROM le JOIN h{i} USING (hub) GROUP BY s, id) q ON q.id = e.id AND q.s = e.s)")]
_SEEDS = "SELECT s, 'e:' || id AS node, y / greatest(1, sum(y) OVER (PARTITION BY s)) AS bad, (1 - y) / greatest(1, sum(1 - y) OVER (PARTITION BY s)) AS good FROM ev JOIN st ON seq < s"
_BLOCK = "FROM ev JOIN st ON seq >= s AND seq < s + m LEFT JOIN {x} x ON x.s = st.s AND x.node = 'e:' || ev.id"
# the graph of each block: the edges of the events before its end
_STRICT = """ib AS (SELECT s, id, hub, w FROM inc JOIN st ON seq < s + m),
tb AS MATERIALIZED (SELECT s, u, v, w / sum(w) OVER (PARTITION BY s, u) AS p FROM (SELECT s, 'e:' || id AS u, 'h:' || hub AS v, w FROM ib UNION ALL SELECT s, 'h:' || hub, 'e:' || id, w FROM ib))"""


def _walks(seed, steps, t="tr", own=False, a=0.15):
    """Unrolled walk of every block start s; with ``own`` each has edges of its own."""
    out = [f"x0 AS MATERIALIZED ({seed})"]
    for i in range(1, steps + 1):
        on = f"{t}.s = x.s AND u = node" if own else "u = node"
        out.append(f"""x{i} AS MATERIALIZED (SELECT s, node, sum(bad) AS bad, sum(good) AS good FROM (SELECT x.s, v AS node, {1 - a} * p * bad AS bad, {1 - a} * p * good AS good FROM {t} JOIN x{i - 1} x ON {on}
          UNION ALL SELECT s, node, {a} * bad, {a} * good FROM x0) GROUP BY s, node)""")
    return ", ".join(out)


# Core numbers as the limit of h-indices, with enough steps for the test tables.
_STEPS = 12
_CORES = [f"""c{i} AS MATERIALIZED (SELECT s, node, max(least(a, k)) AS c FROM (SELECT nb2.s, nb2.u AS node, q.c AS a, row_number() OVER (PARTITION BY nb2.s, nb2.u ORDER BY q.c DESC) AS k
  FROM nb2 JOIN c{i - 1} q ON q.s = nb2.s AND q.node = nb2.v) GROUP BY s, node)""" for i in range(1, _STEPS + 1)]

ORACLE = {
    "incidence_idf": sql("SELECT id, hub, df, round(w, 6) AS w FROM inc", _INC),
    "token_incidence": sql("SELECT id, token AS hub, count(*) OVER (PARTITION BY token) AS df, round(n * ln(1 + (SELECT count(*) FROM ev) / count(*) OVER (PARTITION BY token)), 6) AS w FROM tok WHERE id IN (SELECT id FROM ev)", _TOK),
    "transition_matrix": sql("SELECT u, v, round(p, 6) AS p FROM tr", _INC),
    "rn_block_scores": sql("""SELECT ev.id, ev.seq, round(CASE WHEN q.d > 0 THEN q.n / q.d ELSE coalesce((SELECT avg(y) FROM ev x WHERE x.seq < ev.b), 0) END, 6) AS rn FROM eb ev
      LEFT JOIN (SELECT a.id, sum(a.w * b.w * b.y) AS n, sum(a.w * b.w) AS d FROM inc a JOIN eb e ON e.id = a.id JOIN inc b ON b.hub = a.hub AND b.seq < e.b GROUP BY a.id) q ON q.id = ev.id""",
      _INC, PROTOCOL_SQL, "eb AS MATERIALIZED (SELECT id, seq, w + floor((seq - w) / m) * m AS b FROM ev, pc)"),
    "lp_3iter": sql("SELECT id, seq, round(f, 6) AS f FROM f3 WHERE seq >= s AND seq < s + m", _INC, PROTOCOL_SQL, *_LP),
    "ppr_seeded_4iter": sql(f"SELECT ev.id, ev.seq, round(coalesce(bad, 0) / (coalesce(bad, 0) + coalesce(good, 0) + 1e-12), 6) AS score, round(coalesce(bad, 0) * 1e6, 3) AS bad {_BLOCK.format(x='x4')}", _INC, PROTOCOL_SQL, _walks(_SEEDS, 4)),
    "ppr_strict_past": sql(f"SELECT ev.id, ev.seq, round(coalesce(bad, 0) / (coalesce(bad, 0) + coalesce(good, 0) + 1e-12), 6) AS score {_BLOCK.format(x='x6')}", _INC, PROTOCOL_SQL, _STRICT, _walks(_SEEDS, 6, "tb", True)),
    "pagerank_5iter": sql("SELECT node, round(r * 1000, 6) AS rank FROM r5", _CALLS, _pr("src", "dst", 5)),
    "reverse_pagerank_5iter": sql("SELECT node, round(r * 1000, 6) AS rank FROM r5", _CALLS, _pr("dst", "src", 5)),
    "degree_profile": sql("SELECT node, (SELECT count(*) FROM e1 WHERE dst = node) AS in_deg, (SELECT count(*) FROM e1 WHERE src = node) AS out_deg FROM (SELECT src AS node FROM e1 UNION SELECT dst FROM e1)", _CALLS, _E1),
    "risk_diffusion": sql("SELECT node, round(risk * 1000, 6) AS risk FROM x3", _CALLS, _E1, _SY, "ms AS (SELECT hub AS node, count(*) AS m FROM hub WHERE y = 1 AND hub IN (SELECT u FROM sy) GROUP BY hub)", _walk(["risk"], "SELECT node, m / (SELECT sum(m) FROM ms) AS risk FROM ms", 3, "sy")),
    "wcc_labels": sql("SELECT a AS node, min(b) AS component FROM rc GROUP BY a", _CALLS, _E1, _SY, "rc AS (SELECT u AS a, u AS b FROM sy UNION SELECT rc.a, sy.v FROM rc JOIN sy ON sy.u = rc.b)").replace("WITH ", "WITH RECURSIVE ", 1),
    "ppmi_matrix": sql("""SELECT id, hub, round(m, 5) AS m FROM (SELECT i.id, i.hub, ln(greatest(i.w, 1e-9) * t.t / ((sum(i.w) OVER (PARTITION BY i.id) + 1e-9) * c.c) + 1e-12) AS m
      FROM ib i JOIN cs c ON c.hub = i.hub AND c.b = i.b JOIN (SELECT b, sum(c) AS t FROM cs GROUP BY b) t ON t.b = i.b) WHERE m > 1e-6""", _INC, PROTOCOL_SQL,
      "ib AS MATERIALIZED (SELECT inc.*, pc.w + floor((seq - pc.w) / m) * m AS b FROM inc, pc)",
      "cs AS MATERIALIZED (SELECT b.b, h.hub, coalesce(sum(h.w) FILTER (h.seq < b.b), 0) + 1e-9 AS c FROM (SELECT DISTINCT b FROM ib) b, inc h GROUP BY b.b, h.hub)"),
    "dependency_shape": sql("""SELECT i.id, round(coalesce(ln(1 + n), 0), 6) AS size, round(coalesce(m / (n * (n - 1)), 0), 6) AS density, round(coalesce(r / greatest(m, 1), 0), 6) AS reciprocity, round(coalesce(ln(1 + nc), 0), 6) AS components,
        round(coalesce(big / n, 0), 6) AS largest, round(coalesce(si, 0), 6) AS sd_in, round(coalesce(so, 0), 6) AS sd_out, round(coalesce(sr, 0), 6) AS sources FROM (SELECT DISTINCT id FROM hub) i
      LEFT JOIN (SELECT id, count(*) AS n, sum(o) AS m, stddev_pop(ind) AS si, stddev_pop(o) AS so, avg((ind = 0)::INT) AS sr FROM (SELECT nn.id, nn.node, (SELECT count(*) FROM su WHERE su.id = nn.id AND su.dst = nn.node) AS ind, (SELECT count(*) FROM su WHERE su.id = nn.id AND su.src = nn.node) AS o FROM nn) GROUP BY id) q ON q.id = i.id
      LEFT JOIN (SELECT a.id, count(*) AS r FROM su a JOIN su b ON b.id = a.id AND b.src = a.dst AND b.dst = a.src GROUP BY a.id) rr ON rr.id = i.id
      LEFT JOIN (SELECT id, count(*) AS nc, max(k) AS big FROM (SELECT id, c, count(*) AS k FROM (SELECT id, a, min(b) AS c FROM rc GROUP BY id, a) GROUP BY id, c) GROUP BY id) cc ON cc.id = i.id""", _CALLS, _E1,
      "n0 AS (SELECT DISTINCT id, hub AS node FROM hub WHERE hub IN (SELECT src FROM e1 UNION SELECT dst FROM e1))", "n2 AS (SELECT * FROM n0 UNION SELECT n0.id, e1.dst FROM n0 JOIN e1 ON e1.src = n0.node)",
      "nn AS MATERIALIZED (SELECT * FROM n2 WHERE id IN (SELECT id FROM n2 GROUP BY id HAVING count(*) >= 2))", "su AS MATERIALIZED (SELECT nn.id, e1.src, e1.dst FROM nn JOIN e1 ON e1.src = nn.node JOIN nn n3 ON n3.id = nn.id AND n3.node = e1.dst)",
      "rc AS (SELECT id, node AS a, node AS b FROM nn UNION SELECT rc.id, rc.a, s.v FROM rc JOIN (SELECT id, src AS u, dst AS v FROM su UNION SELECT id, dst, src FROM su) s ON s.id = rc.id AND s.u = rc.b)").replace("WITH ", "WITH RECURSIVE ", 1),
    "topology_snapshots": sql("SELECT s AS snapshot, node, count(*) FILTER (d = 'i') AS in_deg, count(*) FILTER (d = 'o') AS out_deg, any_value(core) AS core FROM (SELECT s, dst AS node, 'i' AS d FROM se UNION ALL SELECT s, src, 'o' FROM se) JOIN co USING (s, node) GROUP BY s, node", _CALLS, _E1,
      "hs AS (SELECT DISTINCT id, hub, floor(seq * 8 / (SELECT count(*) FROM ev))::BIGINT AS made FROM hub)",
      # an edge is known from the first event that touches one end and not the other
      "fe AS (SELECT e1.src, e1.dst, min(h.made) AS made FROM e1 JOIN hs h ON h.hub IN (e1.src, e1.dst) WHERE NOT EXISTS (SELECT 1 FROM hs o WHERE o.id = h.id AND o.hub = CASE WHEN h.hub = e1.src THEN e1.dst ELSE e1.src END) GROUP BY e1.src, e1.dst)",
      "se AS MATERIALIZED (SELECT s, src, dst FROM fe JOIN range(1, 8) r(s) ON s > made)", "nb2 AS MATERIALIZED (SELECT s, src AS u, dst AS v FROM se UNION SELECT s, dst, src FROM se)",
      "c0 AS (SELECT s, u AS node, count(*) AS c FROM nb2 GROUP BY s, u)", *_CORES, f"co AS MATERIALIZED (SELECT s, node, c AS core FROM c{_STEPS})"),
    "kcore": sql("SELECT node, coalesce(core, 0) AS core FROM (SELECT src AS node FROM e1 UNION SELECT dst FROM e1) LEFT JOIN co USING (node)", _CALLS, _E1, "nb2 AS MATERIALIZED (SELECT 0 AS s, src AS u, dst AS v FROM e1 UNION SELECT 0, dst, src FROM e1)",
      "c0 AS (SELECT s, u AS node, count(*) AS c FROM nb2 GROUP BY s, u)", *_CORES, f"co AS MATERIALIZED (SELECT node, c AS core FROM c{_STEPS})"),
}
