"""Term graphs of events: centrality in a text, co-occurrence, risk that spreads between terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import KINDS
from tidemark.operators import blocks
from tidemark.session import durable


def positions(tokens: DataFrame, id: str, array: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, place`` and the token's fields, one row per token of the array."""
    return tokens.select(id, *keep, F.posexplode(array).alias("place", "t")).select(id, *keep, "place", "t.*")


def window_edges(terms: Column, window: int = 4) -> Column:
    """Array of (a, b) of different terms less than ``window`` places apart, both ways."""
    places = F.sequence(F.lit(0), F.size(terms) - 1)
    def near(i: Column) -> Column:
        later = F.slice(terms, i + 2, window - 1)
        own = F.get(terms, i)
        return F.filter(F.flatten(F.transform(later, lambda b: F.array(F.struct(own.alias("a"), b.alias("b")), F.struct(b.alias("a"), own.alias("b"))))), lambda e: e["a"] != e["b"])

    return F.when(F.size(terms) > 0, F.flatten(F.transform(places, near)))


def textrank(docs: DataFrame, id: str, terms: str, window: int = 4, iterations: int = 30, damping: float = 0.85, cut_every: int = 6) -> DataFrame:
    """``id, term, centrality`` of the word graph of each document.

    Edges join terms within ``window`` places. The iteration runs for all documents at once, keyed by
    document and term, so a very long document is no single task's work. Mass of a term without
    neighbours is lost; the only term of a document has centrality 1. Null and empty arrays have no rows.
    """
    vocab = docs.select(id, F.explode(F.array_distinct(terms)).alias("term")).where("term IS NOT NULL")
    size = vocab.groupBy(id).agg(F.count(F.lit(1)).alias("n"))
    edges = docs.select(id, F.explode(window_edges(F.col(terms), window)).alias("e")).groupBy(id, F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count(F.lit(1)).alias("w"))
    out = edges.groupBy(id, "a").agg(F.sum("w").alias("t"))
    edges = durable(edges.join(out, [id, "a"]).select(id, "a", "b", (F.col("w") / F.col("t")).alias("p")))
    base = durable(vocab.join(size, id))
    x = base.select(id, "term", "n", (F.lit(1.0) / F.col("n")).alias("r"))
    for i in range(1, iterations + 1):
        moved = edges.join(x.select(id, F.col("term").alias("a"), "r"), [id, "a"]).groupBy(id, F.col("b").alias("term")).agg(F.sum(F.col("p") * F.col("r")).alias("m"))
        x = base.join(moved, [id, "term"], "left").select(id, "term", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("m", F.lit(0.0))).alias("r"))
        if i % cut_every == 0 and i < iterations:
            x = durable(x)
    return x.select(id, "term", F.when(F.col("n") == 1, 1.0).otherwise(F.col("r")).alias("centrality"))


def vocabulary(event_terms: DataFrame, least: int, n_docs: Column | int) -> DataFrame:
    """``term, df, idf`` of terms in at least ``least`` documents; idf = ln((1 + N) / (1 + df)) + 1."""
    df = event_terms.groupBy("term").agg(F.count_distinct("id").alias("df")).where(F.col("df") >= least)
    return df.withColumn("idf", F.log((1 + n_docs) / (1 + F.col("df"))) + 1)


def pair_counts(event_terms: DataFrame) -> DataFrame:
    """``a < b, c``: documents in which both terms occur.

    Pairs are made from each document's sorted list where it lies, a row per first term, and counted on
    the map side.
    """
    lists = event_terms.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("ts")).where(F.size("ts") > 1)
    firsts = lists.select("ts", F.posexplode("ts").alias("i", "a")).where(F.col("i") < F.size("ts") - 1)
    pairs = firsts.select("a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))


def npmi_edges(event_terms: DataFrame, n_docs: Column | int, least_together: int = 2, least_npmi: float = 0.15) -> DataFrame:
    """``a, b, npmi``, both ways, of term pairs that occur together more than by chance."""
    occ = event_terms.groupBy("term").agg(F.count_distinct("id").alias("n"))
    p = pair_counts(event_terms).where(F.col("c") >= least_together)
    p = p.join(occ.withColumnsRenamed({"term": "a", "n": "na"}), "a").join(occ.withColumnsRenamed({"term": "b", "n": "nb"}), "b")
    c = F.col("c").cast("double")
    value = F.when(c == n_docs, 1.0).otherwise(F.try_divide(F.log(c * n_docs / (F.col("na") * F.col("nb"))), -F.log(c / n_docs)))
    p = p.withColumn("npmi", value).where(F.col("npmi") >= least_npmi)
    return p.select("a", "b", "npmi").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "npmi"))


def term_risk(event_terms: DataFrame, rate: Column | float, m: float = 5.0) -> DataFrame:
    """``term, base``: smoothed rate of bad documents among those with the term (distinct id, y, term)."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return event_terms.groupBy("term").agg(F.sum("y").alias("b"), F.count(F.lit(1)).alias("n")).select("term", ((F.col("b") + m * rate) / (F.col("n") + m)).alias("base"))


def propagate(base: DataFrame, edges: DataFrame, iterations: int = 8, damp: float = 0.6, cut_every: int = 4, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, term, risk``: each step mixes a term's base with the weighted mean risk of its neighbours, per combination of ``keys``."""
    base, edges = durable(base.select(*keys, "term", "base")), durable(edges.select(*keys, "a", "b", "npmi"))
    total = edges.groupBy(*keys, "a").agg(F.sum("npmi").alias("t"))
    edges = edges.join(total, [*keys, "a"]).select(*keys, F.col("a").alias("term"), "b", (F.col("npmi") / F.col("t")).alias("p"))
    x = base.select(*keys, "term", F.col("base").alias("risk"))
    for i in range(1, iterations + 1):
        near = edges.join(x.select(*keys, F.col("term").alias("b"), "risk"), [*keys, "b"]).groupBy(*keys, "term").agg(F.sum(F.col("p") * F.col("risk")).alias("near"))
        x = base.join(near, [*keys, "term"], "left").select(*keys, "term", F.when(F.col("near").isNull(), F.col("base")).otherwise((1 - damp) * F.col("base") + damp * F.col("near")).alias("risk"))
        if i % cut_every == 0 and i < iterations:
            x = durable(x)
    return x


def online_prior(event_terms: DataFrame, events: DataFrame, starts: list[int], block: int, least_together: int = 2, least_npmi: float = 0.3, iterations: int = 4, damp: float = 0.5, m: float = 5.0) -> DataFrame:
    """``id, seq, prior`` of the events of every block: mean risk of the event's terms, refreshed at each block's start.

    Terms, pairs, NPMI and the risk that spreads over it come from the events before the block only. Counts are taken
    per block once and cumulated, and all blocks spread their risk side by side: in tasks that hold the terms of all events
    by number, or by joins where these are too many. ``event_terms`` has distinct (id, seq, y, term), ``events`` dense seq.
    Terms that are new, and events without terms, get the rate before the block.
    """
    if not starts:
        return events.select("id", "seq", F.lit(0.0).alias("prior")).limit(0)
    if event_terms.count() <= blocks.ROWS:
        how = {"least_together": least_together, "least_npmi": least_npmi, "iterations": iterations, "damp": damp, "m": m}
        found = blocks.prior_blocks(event_terms.select("seq", "term"), events, events.count(), starts, block, **how)
        return events.select("id", "seq").join(found, "seq").select("id", "seq", "prior")
    first = starts[0]
    later = F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s > F.col("made"))
    made = (F.floor((F.col("seq") - first) / block) * block + first).alias("made")  # start of the event's block
    upto = lambda df, keys, sums: df.withColumn("start", F.explode(later)).groupBy("start", *keys).agg(*[F.sum(c).alias(c) for c in sums])
    rows = durable(event_terms.select("id", "seq", "y", "term", made))
    rate = upto(events.groupBy(made).agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")), [], ["bad", "n"])
    rate = F.broadcast(durable(rate.select("start", F.col("n").cast("double").alias("docs"), (F.col("bad") / F.col("n")).alias("rate"))))  # one row a block
    terms = durable(upto(rows.groupBy("made", "term").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")), ["term"], ["bad", "n"]))
    lists = rows.groupBy("id", "made").agg(F.array_sort(F.collect_set("term")).alias("ts")).where(F.size("ts") > 1)
    firsts = lists.select("made", "ts", F.posexplode("ts").alias("i", "a")).where(F.col("i") < F.size("ts") - 1)
    pairs = firsts.select("made", "a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("b")).groupBy("made", "a", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = upto(pairs, ["a", "b"], ["c"]).where(F.col("c") >= least_together).join(rate, "start")
    of = lambda c, n: terms.select("start", F.col("term").alias(c), F.col("n").alias(n))
    pairs = pairs.join(of("a", "na"), ["start", "a"]).join(of("b", "nb"), ["start", "b"])
    c = F.col("c").cast("double")
    value = F.when(c == F.col("docs"), 1.0).otherwise(F.try_divide(F.log(c * F.col("docs") / (F.col("na") * F.col("nb"))), -F.log(c / F.col("docs"))))
    pairs = durable(pairs.withColumn("npmi", value).where(F.col("npmi") >= least_npmi).select("start", "a", "b", "npmi"))
    both = pairs.unionByName(pairs.select("start", F.col("b").alias("a"), F.col("a").alias("b"), "npmi"))
    base = terms.join(rate, "start").select("start", "term", ((F.col("bad") + m * F.col("rate")) / (F.col("n") + m)).alias("base"))
    risk = propagate(base, both, iterations, damp, keys=("start",))
    asked = rows.where(F.col("seq") >= first).select("id", "term", F.col("made").alias("start"))
    known = asked.join(risk, ["start", "term"], "left").join(rate, "start").groupBy("id").agg(F.avg(F.coalesce("risk", "rate")).alias("prior"))
    own = events.where(F.col("seq") >= first).select("id", "seq", made).withColumnRenamed("made", "start").join(rate, "start")
    return own.join(known, "id", "left").select("id", "seq", F.coalesce("prior", "rate").alias("prior"))


def text_features(weights: DataFrame, kinds: DataFrame, risk: DataFrame, rate: Column | float, ids: DataFrame) -> DataFrame:
    """Per event the mean term risk by weight (``prior``) and the weight mass per kind.

    ``weights`` has (id, term, w). Events without known terms get ``rate`` and no mass.
    """
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    j = weights.join(kinds, "term").join(risk, "term")
    per = j.groupBy("id").agg(F.try_divide(F.sum(F.col("w") * F.col("risk")), F.sum("w")).alias("prior"), *[F.sum(F.when(F.col("kind") == k, F.col("w")).otherwise(0.0)).alias(f"mass_{k}") for k in KINDS])
    out = ids.join(per, "id", "left")
    return out.select("id", F.coalesce("prior", rate).alias("prior"), *[F.coalesce(f"mass_{k}", F.lit(0.0)).alias(f"mass_{k}") for k in KINDS])


def first_kind(tokens: DataFrame, order: str = "seq") -> DataFrame:
    """``term, kind``: the kind under which a term was seen first."""
    return tokens.groupBy("term").agg(F.min(F.struct(order, "place", "kind")).getField("kind").alias("kind"))


def top_terms(weights: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` heaviest terms per event."""
    w = W.partitionBy("id").orderBy(F.desc("w"), "term")
    return weights.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def repeated_documents(tokens: DataFrame, centrality: DataFrame) -> DataFrame:
    """``id, token, n``: tokens tagged source:k:term, counted once to five times by their centrality."""
    top = centrality.groupBy("id").agg(F.max("centrality").alias("top"))
    j = tokens.join(centrality, ["id", "term"]).join(top, "id")
    reps = F.least(F.lit(5), 1 + F.floor(4 * F.col("centrality") / (F.col("top") + 1e-9)).cast("int"))
    return j.groupBy("id", F.concat_ws(":", "source", F.substring("kind", 1, 1), "term").alias("token")).agg(F.sum(reps).alias("n"))
