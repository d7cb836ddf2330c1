"""Joins: events with files, developers and tokens, calls, tiers, as-of states, top-k per key, set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import HEAD_TOKENS
from tidemark.operators import past, tiers
from tidemark.operators.asof import Events, Statements, known_at_event_time
from tidemark.operators.changes import op_name
from tidemark.operators.namegraph import Imports, tier_sizes, two_steps
from tidemark.plans.base import FILES, changes, commits, events, hub_events, hub_rows, labels, sql
from tidemark.session import table
from tidemark.sources.commitlog import package_of


def _tokens(spark, d):
    """(id, token, n) of change tokens op:type of labelled commits."""
    c = changes(spark, d).where("op IN ('ADDS', 'REMOVES', 'UPDATES', 'MOVES') AND commit_id IS NOT NULL AND ast_type IS NOT NULL")
    return c.groupBy(F.col("commit_id").alias("id"), F.concat_ws(":", "op", "ast_type").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def event_tokens(spark, d):
    return _tokens(spark, d).join(events(spark, d).select("id", "seq", "y"), "id")


def event_file_edges(spark, d):
    ev = events(spark, d, tuple(FILES.values()))
    parts = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), (lambda r: lambda p: F.struct(F.lit(r).alias("rel"), p.alias("file")))(rel)) for rel, c in FILES.items()]
    return ev.select("id", "y", F.explode(F.concat(*parts)).alias("e")).select("id", "y", "e.*").distinct()


def event_developer_last(spark, d):
    """The developer node each commit points to when deliveries differ: the one delivered last."""
    raw = table(spark, d, "commits").where("commit_id IS NOT NULL AND author_name IS NOT NULL")
    return raw.groupBy("commit_id").agg(F.max(F.struct("ingested_at", "author_name")).getField("author_name").alias("developer"))


def _calls(spark, d):
    nodes = table(spark, d, "ast_nodes").where("value IS NOT NULL AND value <> ''").dropDuplicates(["id"])
    calls = nodes.where("ast_type = 'MemberReference'").select(F.col("file").alias("caller"), F.col("value").alias("name"))
    defs = nodes.where("ast_type = 'Identifier'").select(F.col("file").alias("callee"), F.col("value").alias("name"))
    return calls, defs


def call_graph_resolution(spark, d):
    return tiers.resolve_calls(*_calls(spark, d))


def external_calls_anti(spark, d):
    return tiers.external_calls(*_calls(spark, d))


def external_calls_top25(spark, d):
    return tiers.external_calls(*_calls(spark, d)).orderBy(F.desc("n"), "name").limit(25)


def _imports(spark, d):
    return Imports(*_calls(spark, d))


def tier_membership(spark, d):
    _, hubs = hub_events(spark, d)
    return tiers.import_tiers(hubs, _imports(spark, d))


def two_hop_closure(spark, d):
    """Files within two import steps of each file, either direction."""
    return two_steps(_imports(spark, d))


def package_siblings(spark, d):
    _, hubs = hub_events(spark, d)
    return tiers.sibling_tier(hubs, hubs, lambda c: package_of(F.col(c)))


def cochange_topk(spark, d):
    _, hubs = hub_events(spark, d)
    return tiers.cochange_tier(hubs)


def capped_tier_lists(spark, d):
    _, hubs = hub_events(spark, d)
    t = tiers.import_tiers(hubs, _imports(spark, d), 400, 2_000_000, 400).where("tier = 'T1'")
    out = tiers.capped_lists(t)
    return out.select("id", F.array_join("members", ";").alias("members"))


def tier_summary(spark, d):
    ev, hubs = hub_events(spark, d)
    out = tiers.tier_summaries(hubs, past.with_global_prior(ev), _imports(spark, d), ("T1",))["T1"]
    return out.select("id", *[F.round(c, 5).alias(c) for c in ("size", "density", "worst", "churn", "most", "seen", "age")])


def tier_union_difference(spark, d):
    """|T0|, |T1|, |T1 ∪ T0|, |TP \\ T1| per event."""
    _, hubs = hub_events(spark, d)
    return tier_sizes(hubs, _imports(spark, d), lambda c: package_of(F.col(c)))


def asof_file_state(spark, d):
    """The commit that changed each file last before each commit."""
    _, hubs = hub_events(spark, d)
    last = past.strict_past(hubs, ["hub"], "seq", {"last": ("max", F.struct("seq", "id"))})
    return last.select("id", "hub", F.col("last.id").alias("previous_id"), (F.col("seq") - F.col("last.seq")).alias("gap"))


def asof_known_label(spark, d):
    """The label of each event's previous event on a file as known when it arrives."""
    prev = asof_file_state(spark, d).where("previous_id IS NOT NULL").select("id", "previous_id").distinct()
    from tidemark.operators.asof import seconds

    ev = events(spark, d).select("id", "ts")
    asks = prev.join(ev, "id")
    said = table(spark, d, "jit_labels").withColumns({"valid_from": seconds("valid_from"), "known_at": seconds("known_at")})
    return known_at_event_time(asks, said, Events("previous_id", "ts", ("id", "previous_id")), Statements("commit_id", "valid_from", "known_at", "rev_id", ("rev_id",)))


def snapshot_range_join(spark, d):
    """Eight snapshots of the stream: each event sees the rate at the start of its snapshot."""
    ev = events(spark, d)
    n = ev.agg(F.count(F.lit(1))).scalar()
    snap = ev.withColumn("snapshot", F.floor(F.col("seq") * 8 / n))
    per = snap.groupBy("snapshot").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    state = past.strict_past(per, [], "snapshot", {"b": ("sum", F.col("bad")), "t": ("sum", F.col("n"))})
    return snap.join(F.broadcast(state.select("snapshot", "b", "t")), "snapshot").select("id", "snapshot", F.round(F.coalesce(F.try_divide("b", "t"), F.lit(0.0)), 6).alias("rate"))


def text_lookup_default(spark, d):
    """Labelled commits with their message, '' where there is none."""
    return labels(spark, d).select("commit_id", "y").join(commits(spark, d, ["message"]), "commit_id", "left").select("commit_id", "y", F.coalesce("message", F.lit("")).alias("message"))


def semi_membership(spark, d):
    """Labelled commits that touched a file of the change feed."""
    _, hubs = hub_events(spark, d)
    files = table(spark, d, "ast_changes").select(F.col("file").alias("hub")).distinct()
    return hubs.join(files, "hub", "left_semi").select("id").distinct()


def not_exists_base(spark, d):
    """Changed files without a node in the base state."""
    base = table(spark, d, "ast_nodes").select("file").distinct()
    return table(spark, d, "ast_changes").where("file IS NOT NULL").select("file").distinct().join(base, "file", "left_anti")


def optional_match_counts(spark, d):
    """Changes per labelled commit, 0 included."""
    n = changes(spark, d).groupBy("commit_id").agg(F.count(F.lit(1)).alias("n_"))
    return labels(spark, d).select("commit_id").join(n, "commit_id", "left").select("commit_id", F.coalesce("n_", F.lit(0)).alias("n_changes"))


def tiered_node_lookup(spark, d):
    """First hit of four lookups of a change's node: by id, by file+type+position, by file+type, by file."""
    c = changes(spark, d).where("op = 'UPDATES' AND node_id IS NOT NULL").select("change_no", "node_id", "file", "ast_type", "pos_line", "pos_col")
    base = table(spark, d, "ast_nodes").where("id IS NOT NULL").dropDuplicates(["id"])
    best = lambda keys: base.groupBy(*keys).agg(F.min("id").alias("hit"))
    by_id = c.join(base.select(F.col("id").alias("node_id"), F.col("id").alias("hit")), "node_id").select("change_no", F.lit(1).alias("tier"), "hit")
    hits = by_id
    for t, keys in ((2, ["file", "ast_type", "pos_line", "pos_col"]), (3, ["file", "ast_type"]), (4, ["file"])):
        hits = hits.unionByName(c.join(best(keys), keys).select("change_no", F.lit(t).alias("tier"), "hit"))
    first = hits.groupBy("change_no").agg(F.min(F.struct("tier", "hit")).alias("b"))
    return first.select("change_no", F.col("b.tier").cast("long").alias("tier"), "b.hit")


def combo_power_set(spark, d):
    """The non-empty subsets of five channels."""
    names = ["F", "G", "M", "R", "T"]
    bits = spark.range(1, 1 << len(names))
    on = lambda i: F.when(F.shiftright("id", i).bitwiseAND(F.lit(1)) == 1, F.lit(names[i]))
    parts = F.array(*[on(i) for i in range(len(names))])
    kept = F.filter(parts, lambda x: x.isNotNull())
    return bits.select("id", F.array_join(kept, "+").alias("combo"), F.size(kept).cast("long").alias("n"))


def parameter_grid(spark, d):
    """Projects by op: a cross product of two small tables (12 x 4 rows)."""
    ops = spark.createDataFrame([("ADDS",), ("REMOVES",), ("UPDATES",), ("MOVES",)], "op string")
    return table(spark, d, "projects").select("project").crossJoin(F.broadcast(ops))


def score_stream_alignment(spark, d):
    """Two streams scored on different rows, on their common rows with agreeing labels."""
    ev = past.with_actor_prior(past.with_global_prior(events(spark, d)))
    a = ev.where("seq % 3 <> 0").select("seq", "y", F.col("global_rate").alias("a"))
    b = ev.where("seq % 5 <> 0").select("seq", F.col("y").alias("y_b"), F.col("actor_rate").alias("b"))
    return a.join(b, "seq").where("y = y_b").select("seq", "y", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def index_intersection(spark, d):
    ev = events(spark, d)
    return ev.where("seq % 3 <> 0").select("seq").intersect(ev.where("seq % 5 <> 0").select("seq"))


def term_edges_of_present_hubs(spark, d):
    """Stored co-occurrence edges of which both terms are stored, one per unordered pair, in range."""
    t = table(spark, d, "terms").select("id").distinct()
    c = table(spark, d, "cooccurs").where("a <> b AND npmi BETWEEN -1 AND 1 AND NOT isnan(npmi)")
    both = c.join(t.withColumnRenamed("id", "a"), "a", "left_semi").join(t.withColumnRenamed("id", "b"), "b", "left_semi")
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.round(F.max("npmi"), 6).alias("npmi"))


def terms_topk_per_event(spark, d):
    """The 20 most frequent change tokens of each commit."""
    w = W.partitionBy("id").orderBy(F.desc("n"), "token")
    return _tokens(spark, d).withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20")


def neighbours_topk(spark, d):
    """Per term the 8 strongest stored neighbours of at least 0.2, one row per unordered pair."""
    e = term_edges_of_present_hubs(spark, d).where("npmi >= 0.2")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "npmi"))
    top = both.withColumn("r_", F.row_number().over(W.partitionBy("a").orderBy(F.desc("npmi"), "b"))).where("r_ <= 8")
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "npmi").distinct()


def grounds_in_limit(spark, d):
    """Terms with the alive leaf nodes of their text, at most 200 per term."""
    t = table(spark, d, "terms").select(F.col("id").alias("term"), "text").distinct()
    leaves = table(spark, d, "ast_nodes").where("is_leaf AND alive AND value IS NOT NULL").select("id", F.lower("value").alias("text")).distinct()
    w = W.partitionBy("term").orderBy("id")
    return t.join(leaves, "text").withColumn("r_", F.row_number().over(w)).where("r_ <= 200").select("term", F.col("id").alias("node"))


def refers_to_theta(spark, d):
    """Terms of five letters or more that a file's path contains.

    The containment becomes an equi-join: every substring of a path that is as long as some term, met
    with the terms, so nothing is compared with everything.
    """
    t = table(spark, d, "terms").where("length(text) >= 5").select(F.col("id").alias("term"), "text").distinct()
    lengths = [r[0] for r in t.select(F.length("text")).distinct().collect()]
    files = table(spark, d, "ast_nodes").where("file IS NOT NULL").select("file", F.lower("file").alias("path")).distinct()
    if not lengths:
        return t.select("term", F.lit("").alias("file")).limit(0)
    grams = files.withColumn("n_", F.explode(F.array(*[F.lit(n) for n in sorted(lengths)]))).where(F.col("n_") <= F.length("path"))
    grams = grams.withColumn("at_", F.explode(F.sequence(F.lit(1), F.length("path") - F.col("n_") + 1)))
    return grams.select("file", F.expr("substring(path, at_, n_)").alias("text")).distinct().join(t, "text").select("term", "file")


def rule_union(spark, d):
    """Files from three sources with their origin, and without doubles."""
    a = table(spark, d, "ast_nodes").select("file")
    b = table(spark, d, "ast_changes").select("file")
    _, hubs = hub_events(spark, d)
    return a.union(b).union(hubs.select(F.col("hub").alias("file"))).where("file IS NOT NULL").distinct()


def multiset_difference(spark, d):
    """Type counts before against added and removed ones, by full outer join with 0."""
    before = table(spark, d, "ast_nodes").dropDuplicates(["id"]).groupBy("ast_type").agg(F.count(F.lit(1)).alias("b"))
    after = changes(spark, d).where("op = 'ADDS'").groupBy("ast_type").agg(F.count(F.lit(1)).alias("a"))
    j = before.where("ast_type IS NOT NULL").join(after.where("ast_type IS NOT NULL"), "ast_type", "full_outer")
    return j.select("ast_type", (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("delta"))


def chronological_head(spark, d):
    return events(spark, d).where("seq < 100").select("seq", "id", "ts")


def systematic_sample(spark, d):
    """Every 7th event, the 20 of least hash."""
    from tidemark.operators.stats import unit_hash

    ev = events(spark, d).where("seq % 7 = 0").withColumn("h", F.round(unit_hash("id"), 9))
    return ev.orderBy("h", "id").limit(20).select("id", "seq", "h")


def block_slice(spark, d):
    return events(spark, d).where("seq BETWEEN 200 AND 399").select("seq", "id", "y")


def head_tokens(spark, d):
    """The first HEAD_TOKENS tokens of each message."""
    words = F.regexp_extract_all(F.lower("message"), F.lit("[a-z]{2,}"), F.lit(0))
    return commits(spark, d, ["message"]).where("message IS NOT NULL").select("commit_id", F.array_join(F.slice(words, 1, HEAD_TOKENS), " ").alias("head"))


def top_tokens(spark, d):
    return _tokens(spark, d).groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(12)


def distinct_items_per_event(spark, d):
    """Array functions: distinct, sorted, flattened lists of a commit's files."""
    none = F.array().cast("array<string>")
    lists = F.flatten(F.array(*[F.coalesce(F.col(c), none) for c in FILES.values()]))
    return commits(spark, d, list(FILES.values())).select("commit_id", F.array_join(F.array_sort(F.array_distinct(lists)), ";").alias("files"), F.size(lists).cast("long").alias("n_listed"))


def ops_of_changes(spark, d):
    """The spellings of ops and what they mean."""
    return table(spark, d, "ast_changes").groupBy("op").agg(F.count(F.lit(1)).alias("n")).withColumn("meaning", op_name(F.col("op")))


def example_selection(spark, d):
    """Six files of greatest type entropy and nine more of the modal type."""
    from tidemark.operators.stats import entropy

    nodes = table(spark, d, "ast_nodes").where("file IS NOT NULL AND ast_type IS NOT NULL").dropDuplicates(["id"])
    e = entropy(nodes, ["file"], "ast_type").withColumn("e_", F.round("entropy", 9)).orderBy(F.desc("e_"), "file").limit(6).select("file", F.lit("entropy").alias("why"))
    modal = nodes.groupBy("ast_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "ast_type").limit(1)
    rest = nodes.join(F.broadcast(modal.select("ast_type")), "ast_type", "left_semi").groupBy("file").agg(F.count(F.lit(1)).alias("n")).join(e, "file", "left_anti")
    return e.unionByName(rest.orderBy(F.desc("n"), "file").limit(9).select("file", F.lit("modal").alias("why")))


QUERIES = {
    f.__name__: f
    for f in (
        event_tokens, event_file_edges, event_developer_last, call_graph_resolution, external_calls_anti, external_calls_top25, tier_membership, two_hop_closure, package_siblings,
        cochange_topk, capped_tier_lists, tier_summary, tier_union_difference, asof_file_state, asof_known_label, snapshot_range_join, text_lookup_default, semi_membership, not_exists_base,
        optional_match_counts, tiered_node_lookup, combo_power_set, parameter_grid, score_stream_alignment, index_intersection, term_edges_of_present_hubs, terms_topk_per_event,
        neighbours_topk, grounds_in_limit, refers_to_theta, rule_union, multiset_difference, chronological_head, systematic_sample, block_slice, head_tokens, top_tokens,
        distinct_items_per_event, ops_of_changes, example_selection,
    )
}

_TOK = "tok AS (SELECT commit_id AS id, op || ':' || ast_type AS token, count(*) AS n FROM chg WHERE op IN ('ADDS', 'REMOVES', 'UPDATES', 'MOVES') AND commit_id IS NOT NULL AND ast_type IS NOT NULL GROUP BY ALL)"
_CALLS = """n1 AS (SELECT DISTINCT ON (id) * FROM ast_nodes WHERE value IS NOT NULL AND value <> ''),
cl AS (SELECT file AS caller, value AS name FROM n1 WHERE ast_type = 'MemberReference'), df AS (SELECT DISTINCT file AS callee, value AS name FROM n1 WHERE ast_type = 'Identifier'),
cg AS (SELECT caller, callee, count(*) AS n FROM cl JOIN df USING (name) GROUP BY ALL),
nb AS (SELECT DISTINCT callee AS hub, 'dep' AS tier, caller AS other FROM cg WHERE caller <> callee UNION SELECT DISTINCT caller, 'dry', callee FROM cg WHERE caller <> callee)"""
_T = """t1d AS (SELECT DISTINCT h.id, nb.tier, nb.other FROM hub h JOIN nb ON nb.hub = h.hub WHERE NOT EXISTS (SELECT 1 FROM hub o WHERE o.id = h.id AND o.hub = nb.other)),
t1 AS (SELECT DISTINCT id, other FROM t1d),
t2 AS (SELECT DISTINCT t1.id, nb.other FROM t1 JOIN nb ON nb.hub = t1.other WHERE (SELECT count(*) FROM t1 x WHERE x.id = t1.id) <= 400
  AND NOT EXISTS (SELECT 1 FROM hub o WHERE o.id = t1.id AND o.hub = nb.other) AND NOT EXISTS (SELECT 1 FROM t1 x WHERE x.id = t1.id AND x.other = nb.other)),
tp AS (SELECT DISTINCT h.id, m.hub AS other FROM hub h JOIN hub m ON regexp_extract(m.hub, '^(.+)/', 1) = regexp_extract(h.hub, '^(.+)/', 1)
  WHERE NOT EXISTS (SELECT 1 FROM hub o WHERE o.id = h.id AND o.hub = m.hub))"""
_TERMS = "te AS (SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(npmi), 6) AS npmi FROM cooccurs WHERE a <> b AND npmi BETWEEN -1 AND 1 AND NOT isnan(npmi) AND a IN (SELECT id FROM terms) AND b IN (SELECT id FROM terms) GROUP BY 1, 2)"
_GP = "gp AS (SELECT *, coalesce(avg(y) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM ev)"
_LAST = "SELECT id, hub, lag(id) OVER w AS previous_id, seq - lag(seq) OVER w AS gap FROM hub WINDOW w AS (PARTITION BY hub ORDER BY seq)"

ORACLE = {
    "event_tokens": sql("SELECT t.*, ev.seq, ev.y FROM tok t JOIN ev USING (id)", _TOK),
    "event_file_edges": sql("SELECT DISTINCT id, y, 'ADDED' AS rel, unnest(files_added_list) AS file FROM ev UNION SELECT id, y, 'MODIFIED', unnest(files_modified_list) FROM ev UNION SELECT id, y, 'DELETED', unnest(files_deleted_list) FROM ev"),
    "event_developer_last": "SELECT commit_id, arg_max(author_name, (ingested_at, author_name)) AS developer FROM commits WHERE author_name IS NOT NULL AND commit_id IS NOT NULL GROUP BY commit_id",
    "call_graph_resolution": sql("SELECT * FROM cg", _CALLS),
    "external_calls_anti": sql("SELECT name, count(*) AS n FROM cl WHERE name NOT IN (SELECT name FROM df) GROUP BY name", _CALLS),
    "external_calls_top25": sql("SELECT name, count(*) AS n FROM cl WHERE name NOT IN (SELECT name FROM df) GROUP BY name ORDER BY n DESC, name LIMIT 25", _CALLS),
    "tier_membership": sql("SELECT id, 'T1_' || tier AS tier, other FROM t1d UNION ALL SELECT id, 'T1', other FROM t1 UNION ALL SELECT id, 'T2', other FROM t2", _CALLS, _T),
    "two_hop_closure": sql("SELECT hub, count(DISTINCT other) AS n_reached FROM (SELECT hub, other FROM nb UNION SELECT a.hub, b.other FROM nb a JOIN nb b ON b.hub = a.other) WHERE hub <> other GROUP BY hub", _CALLS),
    "package_siblings": sql("SELECT id, other FROM tp", _CALLS, _T),
    "cochange_topk": sql("""SELECT DISTINCT r.id, r.b AS other FROM (
      SELECT h.id, h.hub AS a, p.b, row_number() OVER (PARTITION BY h.id, h.hub ORDER BY count(*) DESC, p.b) AS k FROM hub h
      JOIN (SELECT x.hub AS a, z.hub AS b, x.seq FROM hub x JOIN hub z ON z.id = x.id AND z.hub <> x.hub) p ON p.a = h.hub AND p.seq < h.seq GROUP BY h.id, h.hub, p.b) r
      WHERE k <= 25 AND NOT EXISTS (SELECT 1 FROM hub o WHERE o.id = r.id AND o.hub = r.b)"""),
    "capped_tier_lists": sql("SELECT id, array_to_string(list_sort(list(other))[1:400], ';') AS members FROM t1 GROUP BY id", _CALLS, _T),
    "tier_summary": sql("""SELECT ev.id, round(ln(1 + coalesce(k, 0)), 5) AS size, round(CASE WHEN n > 0 THEN (bad + 2 * g) / (n + 2) ELSE g END, 5) AS density,
      round(CASE WHEN k > 0 THEN coalesce(worst, g) ELSE 0 END, 5) AS worst, round(ln(1 + coalesce(n / k, 0)), 5) AS churn, round(ln(1 + coalesce(most, 0)), 5) AS most, round(coalesce(seen, 0), 5) AS seen, round(ln(1 + coalesce(q.age, 0)), 5) AS age
      FROM gp ev LEFT JOIN (SELECT id, count(*) AS k, sum(n) AS n, sum(bad) AS bad, max(CASE WHEN n > 0 THEN bad / n END) AS worst, max(n) AS most, avg((n > 0)::INT) AS seen, avg(age) AS age FROM (
        SELECT t1.id, t1.other, count(h.id) AS n, coalesce(sum(h.y), 0) AS bad, coalesce(e.ts - arg_max(h.ts, h.seq), 0) AS age FROM t1 JOIN ev e ON e.id = t1.id LEFT JOIN hub h ON h.hub = t1.other AND h.seq < e.seq GROUP BY t1.id, t1.other, e.ts) GROUP BY id) q ON q.id = ev.id""", _CALLS, _T, _GP),
    "tier_union_difference": sql("""SELECT h.id, count(DISTINCT h.hub) AS n_own, (SELECT count(*) FROM t1 WHERE t1.id = h.id) AS n_t1, count(DISTINCT h.hub) + (SELECT count(*) FROM t1 WHERE t1.id = h.id) AS n_union,
      (SELECT count(*) FROM tp WHERE tp.id = h.id AND NOT EXISTS (SELECT 1 FROM t1 WHERE t1.id = tp.id AND t1.other = tp.other)) AS n_rest FROM hub h GROUP BY h.id""", _CALLS, _T),
    "asof_file_state": sql(_LAST),
    "asof_known_label": sql("""SELECT id, previous_id, rev_id FROM (SELECT p.id, p.previous_id, s.rev_id, row_number() OVER (PARTITION BY p.id, p.previous_id ORDER BY s.vf DESC NULLS LAST, s.ka DESC NULLS LAST, s.rev_id DESC NULLS LAST) AS k
      FROM (SELECT DISTINCT l.id, l.previous_id, ev.ts FROM (""" + _LAST + """) l JOIN ev USING (id) WHERE l.previous_id IS NOT NULL) p LEFT JOIN said s ON s.commit_id = p.previous_id AND s.vf <= p.ts AND s.ka <= p.ts) WHERE k = 1"""),
    "snapshot_range_join": sql("SELECT e.id, floor(e.seq * 8 / t.n)::BIGINT AS snapshot, round(coalesce((SELECT avg(y) FROM ev x WHERE floor(x.seq * 8 / t.n) < floor(e.seq * 8 / t.n)), 0), 6) AS rate FROM ev e, (SELECT count(*) AS n FROM ev) t"),
    "text_lookup_default": sql("SELECT l.commit_id, l.y, coalesce(h.message, '') AS message FROM lab l LEFT JOIN held h USING (commit_id)"),
    "semi_membership": sql("SELECT DISTINCT id FROM hub WHERE hub IN (SELECT file FROM ast_changes WHERE file IS NOT NULL)"),
    "not_exists_base": "SELECT DISTINCT file FROM ast_changes c WHERE file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ast_nodes n WHERE n.file = c.file)",
    "optional_match_counts": sql("SELECT l.commit_id, count(c.change_no) AS n_changes FROM lab l LEFT JOIN chg c ON c.commit_id = l.commit_id GROUP BY l.commit_id"),
    "tiered_node_lookup": sql("""SELECT change_no, tier::BIGINT AS tier, hit FROM (SELECT *, row_number() OVER (PARTITION BY change_no ORDER BY tier, hit) AS k FROM (
      SELECT c.change_no, 1 AS tier, n.id AS hit FROM chg c JOIN ast_nodes n ON n.id = c.node_id WHERE c.op = 'UPDATES'
      UNION ALL SELECT c.change_no, 2, n.id FROM chg c JOIN ast_nodes n ON n.file = c.file AND n.ast_type = c.ast_type AND n.pos_line = c.pos_line AND n.pos_col = c.pos_col WHERE c.op = 'UPDATES' AND c.node_id IS NOT NULL
      UNION ALL SELECT c.change_no, 3, min(n.id) FROM chg c JOIN ast_nodes n ON n.file = c.file AND n.ast_type = c.ast_type WHERE c.op = 'UPDATES' AND c.node_id IS NOT NULL GROUP BY c.change_no
      UNION ALL SELECT c.change_no, 4, min(n.id) FROM chg c JOIN ast_nodes n ON n.file = c.file WHERE c.op = 'UPDATES' AND c.node_id IS NOT NULL GROUP BY c.change_no)) WHERE k = 1"""),
    "combo_power_set": "SELECT i AS id, array_to_string(list_filter([CASE WHEN i & 1 > 0 THEN 'F' END, CASE WHEN i & 2 > 0 THEN 'G' END, CASE WHEN i & 4 > 0 THEN 'M' END, CASE WHEN i & 8 > 0 THEN 'R' END, CASE WHEN i & 16 > 0 THEN 'T' END], lambda x: x IS NOT NULL), '+') AS combo, bit_count(i)::BIGINT AS n FROM range(1, 32) t(i)",
    "parameter_grid": "SELECT project, op FROM projects, (VALUES ('ADDS'), ('REMOVES'), ('UPDATES'), ('MOVES')) v(op)",
    "score_stream_alignment": sql("SELECT seq, y, round(g, 6) AS a, round((coalesce(sum(y) OVER w, 0) + 5 * g) / (count(*) OVER w + 5), 6) AS b FROM gp WINDOW w AS (PARTITION BY actor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) QUALIFY seq % 3 <> 0 AND seq % 5 <> 0", _GP),
    "index_intersection": sql("SELECT seq FROM ev WHERE seq % 3 <> 0 AND seq % 5 <> 0"),
    "term_edges_of_present_hubs": sql("SELECT * FROM te", _TERMS),
    "terms_topk_per_event": sql("SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, token) AS rank FROM tok QUALIFY rank <= 20", _TOK),
    "neighbours_topk": sql("SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, npmi FROM (SELECT * FROM (SELECT a, b, npmi FROM te UNION ALL SELECT b, a, npmi FROM te) WHERE npmi >= 0.2 QUALIFY row_number() OVER (PARTITION BY a ORDER BY npmi DESC, b) <= 8)", _TERMS),
    "grounds_in_limit": "SELECT term, node FROM (SELECT t.id AS term, n.id AS node, row_number() OVER (PARTITION BY t.id ORDER BY n.id) AS k FROM (SELECT DISTINCT id, text FROM terms) t JOIN (SELECT DISTINCT id, lower(value) AS text FROM ast_nodes WHERE is_leaf AND alive) n USING (text)) WHERE k <= 200",
    "refers_to_theta": "SELECT DISTINCT t.id AS term, f.file FROM terms t JOIN (SELECT DISTINCT file FROM ast_nodes WHERE file IS NOT NULL) f ON contains(lower(f.file), t.text) WHERE length(t.text) >= 5",
    "rule_union": sql("SELECT file FROM ast_nodes WHERE file IS NOT NULL UNION SELECT file FROM ast_changes WHERE file IS NOT NULL UNION SELECT hub FROM hub"),
    "multiset_difference": sql("SELECT coalesce(a.ast_type, b.ast_type) AS ast_type, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta FROM (SELECT ast_type, count(*) AS n FROM chg WHERE op = 'ADDS' AND ast_type IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT ast_type, count(DISTINCT id) AS n FROM ast_nodes WHERE ast_type IS NOT NULL GROUP BY 1) b ON a.ast_type = b.ast_type"),
    "chronological_head": sql("SELECT seq, id, ts FROM ev WHERE seq < 100"),
    "systematic_sample": sql("SELECT id, seq, round(('0x' || md5(id)[1:8])::BIGINT / 4294967296.0, 9) AS h FROM ev WHERE seq % 7 = 0 ORDER BY h, id LIMIT 20"),
    "block_slice": sql("SELECT seq, id, y FROM ev WHERE seq BETWEEN 200 AND 399"),
    "head_tokens": sql("SELECT commit_id, array_to_string(regexp_extract_all(lower(message), '[a-z]{2,}')[1:4000], ' ') AS head FROM held WHERE message IS NOT NULL"),
    "top_tokens": sql("SELECT token, sum(n)::BIGINT AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 12", _TOK),
    "distinct_items_per_event": sql("SELECT commit_id, array_to_string(list_sort(list_distinct(l)), ';') AS files, len(l) AS n_listed FROM (SELECT commit_id, list_concat(list_concat(coalesce(files_added_list, []), coalesce(files_modified_list, [])), coalesce(files_deleted_list, [])) AS l FROM held)"),
    "ops_of_changes": "SELECT op, count(*) AS n, CASE upper(trim(op)) WHEN 'ADDS' THEN 'INSERT' WHEN 'UPDATES' THEN 'UPDATE' WHEN 'REMOVES' THEN 'DELETE' WHEN 'MOVES' THEN 'MOVE' END AS meaning FROM ast_changes GROUP BY op",
    "example_selection": """WITH n AS (SELECT DISTINCT ON (id) * FROM ast_nodes WHERE file IS NOT NULL AND ast_type IS NOT NULL), c AS (SELECT file, ast_type, count(*) AS c FROM n GROUP BY ALL),
      e AS (SELECT file FROM (SELECT file, round(-sum(p * ln(p)), 9) AS h FROM (SELECT file, c / sum(c) OVER (PARTITION BY file) AS p FROM c) GROUP BY file) ORDER BY h DESC, file LIMIT 6),
      m AS (SELECT ast_type FROM c GROUP BY ast_type ORDER BY sum(c) DESC, ast_type LIMIT 1)
      SELECT file, 'entropy' AS why FROM e UNION ALL (SELECT file, 'modal' FROM c WHERE ast_type = (SELECT ast_type FROM m) AND file NOT IN (SELECT file FROM e) ORDER BY c DESC, file LIMIT 9)""",
}
