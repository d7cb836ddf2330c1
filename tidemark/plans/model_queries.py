"""Models along the commit stream, baselines and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import evaluate as ev
from tidemark.operators import blocks, graph, past, textgraph, tiers
from tidemark.operators import model as ml
from tidemark.operators.online import prequential_linear
from tidemark.plans.base import METRICS, events, hub_events, sql
from tidemark.plans.eval_queries import _scores
from tidemark.plans.graph_queries import POSITIONS, topology_positions
from tidemark.plans.join_queries import _imports, _tokens
from tidemark.plans.past_queries import _PRIORS
from tidemark.plans.text_queries import _all_terms, _docs
from tidemark.session import durable, table
from tidemark.sources.commitlog import package_of
from tidemark.spec import PROTOCOL

FIRST = 200


def _protocol(df):
    """Warm-up and block length of the stream."""
    n = df.count()
    return PROTOCOL.first_scored(n), PROTOCOL.block_length(n)


def _metrics(spark, d):
    return durable(events(spark, d, ("message",), tuple(METRICS)).na.fill(0, METRICS).withColumn("tokens", F.transform(tx.words(F.col("message")), lambda t: t["term"])))


def prequential_lr(spark, d):
    """The models of all blocks, fitted on everything before each."""
    m = _metrics(spark, d)
    return prequential_linear(m, METRICS, *_protocol(m))


def prequential_l1(spark, d):
    m = _metrics(spark, d)
    return prequential_linear(m, METRICS, *_protocol(m), PROTOCOL.gap, inverse=0.2, l1=True)


def baseline_forest(spark, d):
    """A forest has no sums to share between blocks: it is grown anew at most eight times along the stream, on all of the past."""
    m = _metrics(spark, d)
    first, block = _protocol(m)
    return ml.prequential(m, lambda: ml.scaled(METRICS, ml.forest(20)), first, block, refit_every=max(1, -(-len(PROTOCOL.starts(m.count())) // 8)))


def baseline_boosting(spark, d):
    return ml.static_split(_metrics(spark, d), lambda: ml.scaled(METRICS, ml.boosting(5)))


def baseline_la(spark, d):
    """One metric only: lines added."""
    m = _metrics(spark, d)
    return prequential_linear(m, ["la"], *_protocol(m))


def baseline_constants(spark, d):
    """Always 1, always 0, and the rate so far: accuracy and F1 from event 200 on."""
    e = past.with_global_prior(events(spark, d)).where(f"seq >= {FIRST}")
    rows = F.array(*[F.struct(F.lit(n).alias("method"), x.alias("d")) for n, x in (("ALL1", F.lit(1)), ("ALL0", F.lit(0)), ("RATE", (F.col("global_rate") >= 0.5).cast("int")))])
    long = e.select("y", F.explode(rows).alias("m")).select("y", "m.*")
    return ev.confusion(long, "y", "d", None, ["method"]).select("method", "tp", "fp", "tn", "fn", F.round("accuracy", 6).alias("accuracy"), F.round("buggy_f1", 6).alias("buggy_f1"))


def hashed_text(spark, d):
    return ml.static_split(_metrics(spark, d), lambda: ml.hashed("tokens", ml.logistic(0.01)))


def tfidf_text(spark, d):
    return ml.static_split(_metrics(spark, d), lambda: ml.tfidf("tokens", ml.logistic(0.01)))


def jitline_forest(spark, d):
    """Forest on the 200 most frequent tokens of the training part."""
    return ml.static_split(_metrics(spark, d), lambda: ml.tfidf("tokens", ml.forest(20), 200, 1.0))


def sgd_stream(spark, d):
    df = _metrics(spark, d)
    cols = ["la", "ld", "ent", "nf"]
    return ml.sgd_along(df.select("id", "seq", "y", *[F.log1p(F.greatest(c, F.lit(0.0))).alias(c) for c in cols]), cols, *_protocol(df))


def svd_lsa(spark, d, rank=64):
    """Factors of the event-token matrix and a linear head on them, both from the first 70 percent; later events are folded in by their tokens."""
    df = _metrics(spark, d)
    n = df.count()
    cut = int(n * 0.7)
    train = df.where(F.col("seq") < cut).select("id")
    cells = df.select("id", F.explode("tokens").alias("hub")).groupBy("id", "hub").agg(F.count(F.lit(1)).cast("double").alias("m"))
    e = graph.factor_embedding(cells, rank, fit_rows=train)
    cols = [f"e{i}" for i in range(rank)]
    wide = df.join(e, "id", "left").select("id", "seq", "y", *[F.coalesce(F.get("embedding", F.lit(i)), F.lit(0.0)).alias(c) for i, c in enumerate(cols)])
    return prequential_linear(wide, cols, cut, max(n - cut, 1))


def stack_fusion(spark, d):
    """Two scores by a linear head that starts after the warm-up and the window in which both classes have ten labels."""
    s = _scores(spark, d).select("id", "seq", "y", "s", "t")
    first, block = _protocol(s)
    init = ev.init_window(s, "seq", "y", first, 50, 300, PROTOCOL.init_each)
    return prequential_linear(s, ["s", "t"], first + init, block, PROTOCOL.gap, train_from=first)


def _graph_scores(spark, d, iterations=8, stream=None, changed=None):
    """Scores of every event after the warm-up: rn, lp and ppr on files and developers (f) and on change tokens (t).

    ``stream`` has the events and their files, ``changed`` the change tokens, if a query has them already.
    """
    e, hubs = stream or hub_events(spark, d)
    n = e.count()
    starts, block, first = PROTOCOL.starts(n), PROTOCOL.block_length(n), PROTOCOL.first_scored(n)
    people = e.where("actor IS NOT NULL").select("id", "seq", "y", F.concat(F.lit("D:"), "actor").alias("hub"), F.lit(1.0).alias("tf"))
    core = hubs.select("id", "seq", "y", F.concat(F.lit("F:"), "hub").alias("hub"), F.lit(1.0).alias("tf")).unionByName(people)
    tokens = (_tokens(spark, d) if changed is None else changed).join(e.select("id", "seq", "y"), "id").select("id", "seq", "y", F.concat(F.lit("T:"), "token").alias("hub"), F.col("n").cast("double").alias("tf"))
    out = e.where(F.col("seq") >= first).select("id", "seq", "y")
    core, tokens = durable(core), durable(tokens)
    if starts and core.count() + tokens.count() <= blocks.ROWS:
        return durable(out.join(blocks.graph_blocks(e, {"core": core, "tokens": tokens}, n, starts, block, iterations), "seq").select("id", "seq", "y", *[f"{g}_{m}" for g in ("core", "tokens", "full") for m in ("rn", "lp", "ppr")])), first, block
    for name, rows in (("core", core), ("tokens", tokens), ("full", core.unionByName(tokens))):
        inc = durable(graph.incidence(rows, n, weight="tf"))
        rn = graph.rn_scores(inc, e, block, first).select("id", F.col("rn").alias(f"{name}_rn"))
        lp = graph.propagation_blocks(inc, e, starts, block).select("id", F.col("f").alias(f"{name}_lp"))
        ppr = graph.ppr_blocks(inc, e, starts, block, iterations=iterations).select("id", F.col("score").alias(f"{name}_ppr"))
        out = durable(out.join(rn, "id", "left").join(lp, "id", "left").join(ppr, "id", "left"))
    return out, first, block


def _text_prior(spark, d):
    """The text prior of every event after the warm-up, from whole messages."""
    docs = durable(_docs(spark, d, whole=True))
    n = docs.count()
    return textgraph.online_prior(_all_terms(docs), docs.select("id", "seq", "y"), PROTOCOL.starts(n), PROTOCOL.block_length(n)).select("id", "prior")


def _fused_metrics(scores, keys):
    """AUC by midranks, Brier score, and F1 measures at 0.5 per combination of keys."""
    c = ev.confusion(scores.withColumn("d", (F.col("score") >= 0.5).cast("int")), "y", "d", "score", keys)
    return c.select(*keys, "tp", "fp", "tn", "fn", *[F.round(m, 6).alias(m) for m in ("macro_f1", "buggy_f1", "g_mean", "accuracy", "brier")])


def graph_methods(spark, d):
    """Relational neighbours, propagation and PageRank on three graphs, each alone, with the metrics of every run."""
    s, _, _ = _graph_scores(spark, d)
    columns = [c for c in s.columns if "_" in c]
    long = s.select("y", F.explode(F.array(*[F.struct(F.lit(c.split("_")[0]).alias("graph"), F.lit(c.split("_")[1]).alias("method"), F.col(c).alias("score")) for c in columns])).alias("c")).select("y", "c.*")
    return _fused_metrics(long, ["graph", "method"])


def fusion_search(spark, d):
    """All 31 combinations of five graph scores by prequential stacking; which the rule of parsimony takes, and F, F+G, F+M and F+G+M for it
    and for the fixed overall choice (rn and ppr)."""
    e, hubs = hub_events(spark, d, tuple(METRICS))
    s, first, block = _graph_scores(spark, d, stream=(e, hubs))
    prior = _text_prior(spark, d)
    m = prequential_linear(e.na.fill(0, METRICS), METRICS, first, block).select("id", F.col("score").alias("m_"))
    s = durable(s.join(prior.select("id", F.col("prior").alias("g_")), "id", "left").join(m, "id", "left").withColumn("at_", F.col("seq")).withColumn("seq", F.col("seq") - first))
    init = ev.init_window(s, "seq", "y", 0, 50, 300, PROTOCOL.init_each)
    methods = {"RN": "core_rn", "PPR": "core_ppr", "LP": "core_lp", "TRN": "tokens_rn", "TPPR": "tokens_ppr"}
    combos = {"+".join(c): [methods[x] for x in c] for c in ml.subsets(list(methods))}
    run = lambda named: _fused_metrics(prequential_linear(s, [*methods.values(), "g_", "m_"], init, block, PROTOCOL.gap, subsets=named, steps=12), ["combo"])
    part1 = durable(run(combos).withColumn("n", F.size(F.split("combo", "\\+")).cast("long")))
    best = ev.parsimonious(part1, "macro_f1", "n", "combo").collect()
    chosen = best[0]["combo"].split("+") if best else ["RN"]
    part2 = {}
    for rule, f in (("project", chosen), ("overall", ["RN", "PPR"])):
        own = [methods[x] for x in f]
        part2 |= {f"{rule}:F": own, f"{rule}:F+G": [*own, "g_"], f"{rule}:F+M": [*own, "m_"], f"{rule}:F+G+M": [*own, "g_", "m_"]}
    return part1.withColumn("chosen", (F.col("combo") == "+".join(chosen)).cast("long")).unionByName(run(part2).withColumns({"n": F.lit(0).cast("long"), "chosen": F.lit(0).cast("long")}))


def fusion_ablation(spark, d):
    """The 63 subsets of six groups of features, each a prequential linear model: metrics, change tokens, priors, PageRank, propagation, text."""
    e, hubs = hub_events(spark, d, tuple(METRICS))
    e, changed = e.na.fill(0, METRICS), durable(_tokens(spark, d))
    s, first, block = _graph_scores(spark, d, stream=(e, hubs), changed=changed)
    priors = past.hub_prior(hubs, past.with_actor_prior(past.with_global_prior(e))).select("id", "global_rate", "actor_rate", "hub_mean", "hub_max")
    ops = changed.withColumn("op", F.substring_index("token", ":", 1)).groupBy("id").pivot("op", ["ADDS", "REMOVES", "UPDATES", "MOVES"]).agg(F.log1p(F.sum("n").cast("double")))
    prior = _text_prior(spark, d).withColumnRenamed("prior", "text_prior")
    ready = e.select("id", "seq", "y", *METRICS).join(priors, "id").join(ops, "id", "left").join(s.drop("seq", "y"), "id", "left").join(prior, "id", "left")
    groups = {
        "M": METRICS, "T": ["ADDS", "REMOVES", "UPDATES", "MOVES"], "R": ["global_rate", "actor_rate", "hub_mean", "hub_max"],
        "P": ["core_ppr", "tokens_ppr"], "L": ["core_lp", "tokens_lp"], "X": ["text_prior"],
    }
    named = {"+".join(c): [x for g in c for x in groups[g]] for c in ml.subsets(list(groups))}
    scored = prequential_linear(ready, [x for g in groups.values() for x in g], first + block, block, train_from=first, subsets=named, steps=12)
    return _fused_metrics(scored, ["combo"])


def fusion_power_set(spark, d):
    """Mean of every subset of three scores, with accuracy at 0.3."""
    e, hubs = hub_events(spark, d)
    out = past.hub_prior(hubs, past.with_actor_prior(past.with_global_prior(e)))
    long = ml.fused_mean(out.select("id", "seq", "y", F.round("global_rate", 6).alias("g"), F.round("actor_rate", 6).alias("a"), F.round("hub_mean", 6).alias("h")), ["g", "a", "h"])
    right = ((F.round("score", 6) >= 0.3).cast("int") == F.col("y")).cast("int")
    return long.groupBy("combo").agg(F.max("n").cast("long").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg("score"), 6).alias("mean_score"))


def final_config(spark, d):
    """The deployed configuration: F+G score, tier statistics, their expanding z-scores and the files' place in the graph, by an L1 head; the most
    confident 80 percent."""
    e, hubs = hub_events(spark, d)
    s, first, block = _graph_scores(spark, d, stream=(e, hubs))
    fg = prequential_linear(s.join(_text_prior(spark, d), "id").withColumn("seq", F.col("seq") - first), ["core_rn", "core_ppr", "prior"], 50, block, PROTOCOL.gap).select("id", F.col("score").alias("fg"))
    sets = ("T0", "T1_dep", "T1_dry", "TP")
    rated = durable(past.with_global_prior(e))
    x, columns = rated.select("id", "seq", "y"), []
    for name, stats in tiers.tier_summaries(hubs, rated, _imports(spark, d), sets, lambda c: package_of(F.col(c))).items():
        own = [c for c in stats.columns if c != "id"]
        x = durable(x.join(stats.select("id", *[F.col(c).alias(f"{name}_{c}") for c in own]), "id", "left"))
        columns += [f"{name}_{c}" for c in own]
    for name in sets:
        if name != "T0":
            x = x.withColumn(f"{name}_reach", F.log1p(F.expm1(f"{name}_size") / F.greatest(F.expm1("T0_size"), F.lit(1.0))))
            columns.append(f"{name}_reach")
    x = past.expanding_zs(durable(x), "seq", columns)
    x = x.join(topology_positions(hubs, _imports(spark, d), rated.count()), "id", "left").na.fill(0.0, POSITIONS).join(fg, "id")
    x = x.withColumn("seq", F.col("seq") - (first + 50))
    init = ev.init_window(x, "seq", "y", 0, 50, 300, PROTOCOL.init_each)
    out = prequential_linear(x, ["fg", *columns, *[f"z_{c}" for c in columns], *POSITIONS], init, block, PROTOCOL.gap, inverse=0.2, l1=True)
    return ev.most_confident(out, "score", 0.8)


def embedding_pca(spark, d):
    return ml.projected(table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")), "embedding").select("vec_id", "label", "projection")


def embedding_class_means(spark, d):
    """Mean of the first two components per class: vector columns by SQL functions."""
    e = table(spark, d, "embeddings")
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("embedding")[0].cast("double")), 6).alias("m0"), F.round(F.avg(F.col("embedding")[1].cast("double")), 6).alias("m1")).withColumn("label", F.col("label").cast("long"))


def param_sweep(spark, d):
    """The frozen rate's error for several block lengths."""
    e = events(spark, d)
    grid = e.select("seq", "y", F.explode(F.array(*[F.lit(b) for b in (50, 100, 200)])).alias("block"))
    per = grid.groupBy("block", F.floor(F.col("seq") / F.col("block")).alias("b")).agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n"))
    state = past.strict_past(per, ["block"], "b", {"pb": ("sum", F.col("bad")), "pn": ("sum", F.col("n"))})
    rate = F.coalesce(F.try_divide("pb", "pn"), F.lit(0.0))
    return state.groupBy("block").agg(F.round(F.sum(F.col("bad") * F.pow(1 - rate, F.lit(2)) + (F.col("n") - F.col("bad")) * F.pow(rate, F.lit(2))) / F.sum("n"), 6).alias("brier")).withColumn("block", F.col("block").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        prequential_lr, prequential_l1, baseline_forest, baseline_boosting, baseline_la, baseline_constants, hashed_text, tfidf_text, jitline_forest, sgd_stream, svd_lsa,
        stack_fusion, graph_methods, fusion_search, fusion_ablation, fusion_power_set, final_config, embedding_pca, embedding_class_means, param_sweep,
    )
}

ORACLE = {
    "baseline_constants": sql("""SELECT m.method, count(*) FILTER (y = 1 AND d = 1) AS tp, count(*) FILTER (y = 0 AND d = 1) AS fp, count(*) FILTER (y = 0 AND d = 0) AS tn, count(*) FILTER (y = 1 AND d = 0) AS fn, round(avg((y = d)::INT), 6) AS accuracy,
      round(coalesce(2 * count(*) FILTER (y = 1 AND d = 1) / nullif(count(*) FILTER (y = 1) + count(*) FILTER (d = 1), 0), 0), 6) AS buggy_f1
      FROM (SELECT y, 'ALL1' AS method, 1 AS d FROM gp WHERE seq >= 200 UNION ALL SELECT y, 'ALL0', 0 FROM gp WHERE seq >= 200 UNION ALL SELECT y, 'RATE', (g >= 0.5)::INT FROM gp WHERE seq >= 200) m GROUP BY m.method""", *_PRIORS[:1]),
    "fusion_power_set": sql("""SELECT combo, n, round(avg(((round(score, 6) >= 0.3)::INT = y)::INT), 6) AS accuracy, round(avg(score), 6) AS mean_score FROM (
      SELECT y, c.combo, len(string_split(c.combo, '+')) AS n, ((CASE WHEN contains(c.combo, 'g') THEN round(g, 6) ELSE 0 END) + (CASE WHEN contains(c.combo, 'a') THEN round(actor_rate, 6) ELSE 0 END) + (CASE WHEN contains(c.combo, 'h') THEN round(hub_mean, 6) ELSE 0 END)) / len(string_split(c.combo, '+')) AS score
      FROM wv, (VALUES ('g'), ('a'), ('h'), ('g+a'), ('g+h'), ('a+h'), ('g+a+h')) c(combo)) GROUP BY combo, n""", *_PRIORS),
    "embedding_class_means": "SELECT label::BIGINT AS label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS m0, round(avg(embedding[2]::DOUBLE), 6) AS m1 FROM embeddings GROUP BY label",
    "param_sweep": sql("SELECT k AS block, round(avg((y - coalesce((SELECT avg(y) FROM ev x WHERE x.seq < ev.seq // k * k), 0)) ** 2), 6) AS brier FROM ev, (SELECT unnest([50, 100, 200])::BIGINT AS k) GROUP BY k"),
}
