"""The text graph of commit messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import dates
from tidemark.functions import text as tx
from tidemark.operators import textgraph as tg
from tidemark.plans.base import PROTOCOL_SQL, commits, events, sql
from tidemark.plans.join_queries import _tokens
from tidemark.session import durable, table
from tidemark.spec import PROTOCOL

TRAIN = 0.7


def _past(docs):
    """Events in the training share of the stream, the first 70 percent."""
    return int(docs.count() * TRAIN)


def _docs(spark, d, whole=False):
    """(id, seq, y, toks) with the typed words of the message, the first HEAD_TOKENS of them unless ``whole``."""
    ev = events(spark, d, ("message",))
    words = tx.words(F.col("message"))
    return ev.select("id", "seq", "y", (words if whole else F.slice(words, 1, tx.HEAD_TOKENS)).alias("toks"))


def _event_terms(spark, d, least=3):
    """Documents, distinct (id, seq, y, term) of the vocabulary of the training events, the vocabulary, and the number of these events."""
    docs = durable(_docs(spark, d))
    n = _past(docs)
    terms = _all_terms(docs)
    vocab = durable(tg.vocabulary(terms.where(F.col("seq") < n), least, n))
    return docs, terms.join(vocab.select("term"), "term", "left_semi"), vocab, n


def _all_terms(docs):
    return docs.select("id", "seq", "y", F.explode(F.array_distinct(F.transform("toks", lambda t: t["term"]))).alias("term"))


def _r(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tokens_typed(spark, d):
    t = commits(spark, d, ["message"]).select("commit_id", F.explode(tx.words(F.col("message"))).alias("t"))
    return t.groupBy("commit_id", F.col("t.kind").alias("kind"), F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def tokens_code(spark, d):
    """Typed terms of identifiers in diffs: how many of each kind per commit."""
    t = commits(spark, d, ["diff"]).select("commit_id", F.explode(tx.code_terms(F.col("diff"))).alias("t"))
    return t.groupBy("commit_id", F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t.term").alias("n_terms"))


def polarity_tokens(spark, d):
    """Tokens of message, added and removed lines."""
    t = commits(spark, d, ["message", "diff"]).select("commit_id", F.explode(tx.commit_tokens(F.col("message"), F.col("diff"))).alias("t"))
    return t.groupBy("commit_id", F.col("t.source").alias("source"), F.col("t.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def diff_split(spark, d):
    return commits(spark, d, ["diff"]).select(
        "commit_id", F.length(tx.diff_lines(F.col("diff"), "+")).cast("long").alias("n_added"), F.length(tx.diff_lines(F.col("diff"), "-")).cast("long").alias("n_removed"),
        F.array_join(F.array_distinct(tx.diff_paths(F.col("diff"))), ";").alias("paths"),
    )


def intent_class(spark, d):
    return commits(spark, d, ["message"]).select("commit_id", tx.intent(F.col("message")).alias("intent"))


def intent_distribution(spark, d):
    return intent_class(spark, d).groupBy("intent").agg(F.count(F.lit(1)).alias("n"))


def bug_rate_by_intent(spark, d):
    ev = events(spark, d, ("message",))
    return ev.groupBy(tx.intent(F.col("message")).alias("intent")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("rate"))


def consistency_features(spark, d):
    ev = events(spark, d, ("message",), ("la", "ld"))
    per = _tokens(spark, d).withColumn("op", F.substring_index("token", ":", 1)).groupBy("id").pivot("op", ["ADDS", "REMOVES", "UPDATES", "MOVES"]).agg(F.sum("n"))
    j = ev.join(per, "id", "left").na.fill(0, ["ADDS", "REMOVES", "UPDATES", "MOVES", "la", "ld"])
    total = F.col("ADDS") + F.col("REMOVES") + F.col("UPDATES") + F.col("MOVES")
    what = tx.intent(F.col("message"))
    is_ = lambda k: (what == k).cast("int")
    msg = F.coalesce("message", F.lit(""))
    code = F.size(F.array_distinct(F.regexp_extract_all(msg, F.lit(tx.MENTIONED_CODE), F.lit(0))))
    terse = (F.size(F.regexp_extract_all(msg, F.lit(tx.WORD), F.lit(0))) <= 4).cast("int")
    small = tx.claims_small(F.col("message")).cast("int")
    out = {
        "mm_small_size": small * F.log1p(total), "mm_refactor_addrem": is_("refactor") * (F.col("ADDS") + F.col("REMOVES")) / (total + 1), "mm_fix_size": is_("fix") * F.log1p(total),
        "mm_feat_noadds": is_("feat") * (1 - F.col("ADDS") / (total + 1)), "mm_terse_bigchange": terse * F.log1p(F.col("la") + F.col("ld")), "is_revert": is_("revert").cast("double"),
        "grounding_gap": F.log1p(code) - F.log1p(total), **dates.clock_features(F.col("ts")),
    }
    return j.select("id", *[(F.round(x.cast("double"), 6) + 0.0).alias(n) for n, x in out.items()])  # + 0.0 turns -0.0 into 0.0


def calendar_features(spark, d):
    return commits(spark, d, ["authored_timestamp"]).select("commit_id", dates.iso_utc(F.col("authored_timestamp")).alias("at"), *[(F.round(x.cast("double"), 6) + 0.0).alias(n) for n, x in dates.clock_features(F.col("authored_timestamp")).items()])


def ngram_cooccur(spark, d):
    """Pairs of terms in the training events' messages."""
    _, terms, _, n = _event_terms(spark, d)
    return tg.pair_counts(terms.where(F.col("seq") < n)).where("c >= 2")


def sliding_cooccur(spark, d):
    """Pairs of terms less than four places apart, over all messages."""
    docs = _docs(spark, d).select("id", F.transform("toks", lambda t: t["term"]).alias("ts"))
    e = docs.select(F.explode(tg.window_edges(F.col("ts"))).alias("e"))
    return e.where("e.a < e.b").groupBy(F.col("e.a").alias("a"), F.col("e.b").alias("b")).agg(F.count(F.lit(1)).alias("w"))


def npmi_edges(spark, d):
    _, terms, _, n = _event_terms(spark, d)
    return _r(tg.npmi_edges(terms.where(F.col("seq") < n), n).where("a < b"))


def _rate(docs, n):
    return docs.where(F.col("seq") < n).agg(F.avg("y")).collect()[0][0] or 0.0


def term_risk_propagated(spark, d):
    docs, terms, _, n = _event_terms(spark, d)
    past = terms.where(F.col("seq") < n)
    return _r(tg.propagate(tg.term_risk(past, _rate(docs, n)), tg.npmi_edges(past, n), 3, 0.6))


def textrank_window4(spark, d):
    docs = _docs(spark, d).select("id", F.transform("toks", lambda t: t["term"]).alias("ts"))
    return _r(tg.textrank(docs, "id", "ts", iterations=3))


def twidf_features(spark, d, iterations=10):
    """Centrality by idf for terms of the vocabulary, ten steps of the walk."""
    docs, _, vocab, _ = _event_terms(spark, d)
    kept = docs.select("id", F.transform("toks", lambda t: t["term"]).alias("ts"))
    return _r(tg.textrank(kept, "id", "ts", iterations=iterations).join(vocab, "term").select("id", "term", (F.col("centrality") * F.col("idf")).alias("w")), 9)


def mentions_top20(spark, d):
    return tg.top_terms(twidf_features(spark, d).withColumn("w", F.round("w", 6)), 20).withColumn("rank", F.col("rank").cast("long"))


def typed_mass(spark, d):
    """Prior and mass by kind with df-idf weights (centrality 1)."""
    docs, terms, vocab, n = _event_terms(spark, d)
    rate = _rate(docs, n)
    risk = tg.term_risk(terms.where(F.col("seq") < n), rate).withColumnRenamed("base", "risk")
    kinds = tg.first_kind(tg.positions(docs, "id", "toks", ("seq",)))
    w = terms.join(vocab, "term").select("id", "term", F.col("idf").alias("w"))
    return _r(tg.text_features(w, kinds, risk, rate, docs.select("id")))


def online_text_prior(spark, d):
    """The text prior of every event after the warm-up, refreshed with everything before its block; two steps, damping a half."""
    docs = durable(_docs(spark, d))
    n = docs.count()
    return _r(tg.online_prior(_all_terms(docs), docs.select("id", "seq", "y"), PROTOCOL.starts(n), PROTOCOL.block_length(n), iterations=2))


def repeated_tokens(spark, d):
    docs = durable(_docs(spark, d))
    c = tg.textrank(docs.select("id", F.transform("toks", lambda t: t["term"]).alias("ts")), "id", "ts", iterations=5)
    return tg.repeated_documents(tg.positions(docs, "id", "toks").withColumn("source", F.lit("m")), c)


def stored_terms_refreshed(spark, d):
    """Stored terms against the current messages: how many messages have each."""
    t = table(spark, d, "terms").select("id", "text").distinct()
    n = tokens_typed(spark, d).groupBy("term").agg(F.count_distinct("commit_id").alias("df"))
    return t.join(n.withColumnRenamed("term", "text"), "text", "left").select("id", F.coalesce("df", F.lit(0)).alias("df"))


def jitline_vocab(spark, d):
    """The 2,000 most frequent typed tokens of the training events, by (-df, token)."""
    docs = durable(_docs(spark, d))
    docs = docs.where(F.col("seq") < _past(docs))
    t = docs.select("id", F.explode(F.array_distinct(F.transform("toks", lambda t: F.concat_ws(":", t["kind"], t["term"])))).alias("token"))
    return t.groupBy("token").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "token").limit(2000)


def vocab_encode(spark, d):
    """Messages as numbers of a vocabulary of 100 words, padded and cut to 16."""
    docs = _docs(spark, d).select("id", F.transform("toks", lambda t: t["term"]).alias("ts"))
    top = docs.select(F.explode("ts").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(98).collect()
    vocab = F.create_map(*[x for i, r in enumerate(top) for x in (F.lit(r["w"]), F.lit(i + 2))])
    return docs.select("id", F.array_join(tx.encode_ids(F.col("ts"), vocab, 16).cast("array<string>"), " ").alias("ids"))


def offset_positions(spark, d):
    """Line and column of the middle of each document's text."""
    t = table(spark, d, "documents").where("text IS NOT NULL")
    line, column = tx.line_and_column(F.col("text"), F.floor(F.length("text") / 2).cast("int"))
    return t.select("doc_id", line.cast("long").alias("line"), column.cast("long").alias("col"))


def short_names(spark, d):
    n = table(spark, d, "ast_nodes").where("value IS NOT NULL").select("value").distinct()
    return n.select("value", tx.short_name(F.col("value"), 8).alias("short"))


def content_hash(spark, d):
    """MD5 of each node's own content."""
    n = table(spark, d, "ast_nodes").dropDuplicates(["id"])
    return n.select("id", F.md5(F.concat_ws("|", "ast_type", F.coalesce("value", F.lit("")))).alias("hash"))


def token_repetition(spark, d):
    """Change tokens with their count held at 20."""
    return _tokens(spark, d).select("id", "token", F.least("n", F.lit(20)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        tokens_typed, tokens_code, polarity_tokens, diff_split, intent_class, intent_distribution, bug_rate_by_intent, consistency_features, calendar_features, ngram_cooccur,
        sliding_cooccur, npmi_edges, term_risk_propagated, textrank_window4, twidf_features, mentions_top20, typed_mass, online_text_prior, repeated_tokens, stored_terms_refreshed,
        jitline_vocab, vocab_encode, offset_positions, short_names, content_hash, token_repetition,
    )
}

_LIST = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_KIND = f"CASE WHEN term IN {_LIST(tx.BUG_WORDS)} THEN 'bug' WHEN term IN {_LIST(tx.ACTION_WORDS)} THEN 'action' ELSE 'nl' END"
_WORDS = "list_filter(regexp_extract_all(lower({c}), '[A-Za-z]{{2,}}'), lambda w: NOT (w IN " + _LIST(tx.STOP_WORDS).replace("{", "{{") + ") AND length(w) <= 30 AND NOT regexp_matches(w, '" + tx.NOISE.replace("{", "{{").replace("}", "}}") + "'))"
_HITS = {k: " + ".join(f"(length(m) - length(replace(m, '{w}', ''))) // {len(w)}" for w in ws) for k, ws in tx.INTENTS.items()}
_INTENT = (
    "it AS (SELECT commit_id, CASE WHEN greatest(" + ", ".join(f"h_{k}" for k in _HITS) + ") = 0 THEN 'other' " + " ".join(f"WHEN h_{k} = greatest({', '.join(f'h_{j}' for j in _HITS)}) THEN '{k}'" for k in _HITS)
    + " END AS intent FROM (SELECT commit_id, " + ", ".join(f"{h} AS h_{k}" for k, h in _HITS.items()) + " FROM (SELECT commit_id, lower(coalesce(message, '')) AS m FROM held)))"
)
_DOCS = "dc AS MATERIALIZED (SELECT id, seq, y, coalesce(" + _WORDS.format(c="message") + ", [])[1:4000] AS ts FROM ev)"
_VOC = """np_ AS MATERIALIZED (SELECT floor(count(*) * 0.7)::BIGINT AS n FROM ev), tm AS MATERIALIZED (SELECT DISTINCT id, seq, y, unnest(ts) AS term FROM dc),
vc AS MATERIALIZED (SELECT term, count(*) AS df, ln((1.0 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM tm, np_ WHERE seq < n GROUP BY term HAVING count(*) >= 3),
et AS MATERIALIZED (SELECT tm.*, seq < n AS past FROM tm, np_ WHERE term IN (SELECT term FROM vc))"""


def _npmi(least):
    return f"""oc AS (SELECT term, count(*) AS n FROM et WHERE past GROUP BY term), pr AS (SELECT x.term AS a, z.term AS b, count(*) AS c FROM et x JOIN et z ON z.id = x.id AND x.term < z.term WHERE x.past GROUP BY ALL HAVING count(*) >= 2),
np AS (SELECT * FROM (SELECT pr.a, pr.b, CASE WHEN c = np_.n THEN 1.0 ELSE ln(c * np_.n::DOUBLE / (oa.n * ob.n)) / -ln(c / np_.n::DOUBLE) END AS npmi FROM pr JOIN oc oa ON oa.term = pr.a JOIN oc ob ON ob.term = pr.b, np_) WHERE npmi >= {least})"""


def _prop(steps, damp):
    out = [f"""nx AS MATERIALIZED (SELECT a, b, npmi / sum(npmi) OVER (PARTITION BY a) AS p FROM (SELECT a, b, npmi FROM np UNION ALL SELECT b, a, npmi FROM np)), gr AS (SELECT avg(y) AS g FROM dc, np_ WHERE seq < n),
    k0 AS MATERIALIZED (SELECT term, (sum(y) + 5 * (SELECT g FROM gr)) / (count(*) + 5) AS risk FROM et WHERE past GROUP BY term)"""]
    out += [f"k{i} AS MATERIALIZED (SELECT k0.term, CASE WHEN q.near IS NULL THEN k0.risk ELSE {1 - damp} * k0.risk + {damp} * q.near END AS risk FROM k0 LEFT JOIN (SELECT a, sum(p * risk) AS near FROM nx JOIN k{i - 1} x ON x.term = nx.b GROUP BY a) q ON q.a = k0.term)" for i in range(1, steps + 1)]
    return ", ".join(out)


# The online prior: everything once more for every block start s.
_ONLINE = ["tm AS MATERIALIZED (SELECT DISTINCT id, seq, y, unnest(ts) AS term FROM dc)", PROTOCOL_SQL, """gr AS MATERIALIZED (SELECT s, avg(y) AS g, count(*)::DOUBLE AS n FROM dc JOIN st ON seq < s GROUP BY s),
oc AS MATERIALIZED (SELECT s, term, count(*) AS n, sum(y) AS bad FROM tm JOIN st ON seq < s GROUP BY s, term), pr AS (SELECT s, x.term AS a, z.term AS b, count(*) AS c FROM tm x JOIN tm z ON z.id = x.id AND x.term < z.term JOIN st ON x.seq < s GROUP BY ALL HAVING count(*) >= 2),
np AS (SELECT * FROM (SELECT pr.s, pr.a, pr.b, CASE WHEN c = gr.n THEN 1.0 ELSE ln(c * gr.n / (oa.n * ob.n)) / -ln(c / gr.n) END AS npmi FROM pr JOIN gr USING (s) JOIN oc oa ON oa.s = pr.s AND oa.term = pr.a JOIN oc ob ON ob.s = pr.s AND ob.term = pr.b) WHERE npmi >= 0.3),
nx AS MATERIALIZED (SELECT s, a, b, npmi / sum(npmi) OVER (PARTITION BY s, a) AS p FROM (SELECT s, a, b, npmi FROM np UNION ALL SELECT s, b, a, npmi FROM np)),
k0 AS MATERIALIZED (SELECT s, term, (bad + 5 * g) / (oc.n + 5) AS risk FROM oc JOIN gr USING (s))"""]
_ONLINE += [f"k{i} AS MATERIALIZED (SELECT k0.s, k0.term, CASE WHEN q.near IS NULL THEN k0.risk ELSE 0.5 * k0.risk + 0.5 * q.near END AS risk FROM k0 LEFT JOIN (SELECT nx.s, a, sum(p * risk) AS near FROM nx JOIN k{i - 1} x ON x.s = nx.s AND x.term = nx.b GROUP BY nx.s, a) q ON q.s = k0.s AND q.a = k0.term)" for i in (1, 2)]


def _rank(steps):
    return [*_TR, *(f"q{i} AS MATERIALIZED (SELECT tn.id, tn.term, tn.n, 0.15 / tn.n + 0.85 * coalesce(m, 0) AS r FROM tn LEFT JOIN (SELECT tw.id, b, sum(p * r) AS m FROM tw JOIN q{i - 1} q ON q.id = tw.id AND q.term = tw.a GROUP BY tw.id, b) g ON g.id = tn.id AND g.b = tn.term)" for i in range(1, steps + 1))]


_TR = ["""tp AS (SELECT id, i, ts[i] AS t FROM dc, LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i)),
tn AS (SELECT id, t AS term, count(*) OVER (PARTITION BY id) AS n FROM (SELECT DISTINCT id, t FROM tp)), te AS (SELECT x.id, x.t AS a, z.t AS b FROM tp x JOIN tp z ON z.id = x.id AND abs(z.i - x.i) < 4 AND x.t <> z.t),
tw AS MATERIALIZED (SELECT id, a, b, count(*) / sum(count(*)) OVER (PARTITION BY id, a) AS p FROM te GROUP BY id, a, b), q0 AS (SELECT id, term, n, 1.0 / n AS r FROM tn)"""]
_DAY = "((floor({t} / 86400) + 3)::BIGINT % 7)"
_HOUR = "(floor({t} / 3600)::BIGINT % 24)"


def _clock(t):
    h, w = _HOUR.format(t=t), _DAY.format(t=t)
    return f"round(sin({h} * 2 * pi() / 24), 6) + 0.0::DOUBLE AS hour_sin, round(cos({h} * 2 * pi() / 24), 6) + 0.0::DOUBLE AS hour_cos, round(sin({w} * 2 * pi() / 7), 6) + 0.0::DOUBLE AS wday_sin, round(cos({w} * 2 * pi() / 7), 6) + 0.0::DOUBLE AS wday_cos, ({w} >= 5)::INT::DOUBLE AS is_weekend, ({h} < 5)::INT::DOUBLE AS is_latenight"


_TK = f"tk AS (SELECT commit_id, {_KIND} AS kind, term, count(*) AS n FROM (SELECT commit_id, unnest({_WORDS.format(c='message')}) AS term FROM held) GROUP BY ALL)"
_SMALL = " OR ".join(f"contains(lower(coalesce(message, '')), '{w}')" for w in tx.SMALL_WORDS)

ORACLE = {
    "tokens_typed": sql("SELECT * FROM tk", _TK),
    "diff_split": sql(r"""SELECT commit_id, length(array_to_string(list_transform(list_filter(ls, lambda x: x.starts_with('+') AND NOT x.starts_with('+++')), lambda x: x[2:]), chr(10))) AS n_added,
      length(array_to_string(list_transform(list_filter(ls, lambda x: x.starts_with('-') AND NOT x.starts_with('---')), lambda x: x[2:]), chr(10))) AS n_removed,
      (SELECT coalesce(string_agg(p, ';' ORDER BY k), '') FROM (SELECT p, min(k) AS k FROM (SELECT regexp_extract(ls[k], '[ab]/(.+)$', 1) AS p, k FROM (SELECT unnest(range(1, len(ls) + 1)) AS k) WHERE ls[k].starts_with('+++') OR ls[k].starts_with('---')) WHERE p <> '' GROUP BY p)) AS paths
      FROM (SELECT commit_id, string_split(coalesce(diff, ''), chr(10)) AS ls FROM held)"""),
    "intent_class": sql("SELECT commit_id, intent FROM it", _INTENT),
    "intent_distribution": sql("SELECT intent, count(*) AS n FROM it GROUP BY intent", _INTENT),
    "bug_rate_by_intent": sql("SELECT intent, count(*) AS n, round(avg(y), 6) AS rate FROM ev JOIN it ON it.commit_id = ev.id GROUP BY intent", _INTENT),
    "consistency_features": sql(f"""SELECT id, round((CASE WHEN {_SMALL} THEN 1 ELSE 0 END) * ln(1 + t), 6) + 0.0::DOUBLE AS mm_small_size, round((intent = 'refactor')::INT * (a + r) / (t + 1), 6) + 0.0::DOUBLE AS mm_refactor_addrem, round((intent = 'fix')::INT * ln(1 + t), 6) + 0.0::DOUBLE AS mm_fix_size,
      round((intent = 'feat')::INT * (1 - a / (t + 1)), 6) + 0.0::DOUBLE AS mm_feat_noadds, round((len(regexp_extract_all(coalesce(message, ''), '[A-Za-z]{{2,}}')) <= 4)::INT * ln(1 + coalesce(la, 0) + coalesce(ld, 0)), 6) + 0.0::DOUBLE AS mm_terse_bigchange, (intent = 'revert')::INT::DOUBLE AS is_revert,
      round(ln(1 + len(list_distinct(regexp_extract_all(coalesce(message, ''), '{tx.MENTIONED_CODE}')))) - ln(1 + t), 6) + 0.0::DOUBLE AS grounding_gap, {_clock('ts')}
      FROM (SELECT ev.*, it.intent, coalesce(q.a, 0) AS a, coalesce(q.r, 0) AS r, coalesce(q.t, 0) AS t FROM ev JOIN it ON it.commit_id = ev.id LEFT JOIN (SELECT commit_id, count(*) FILTER (op = 'ADDS') AS a, count(*) FILTER (op = 'REMOVES') AS r, count(*) AS t FROM chg WHERE op IN ('ADDS', 'REMOVES', 'UPDATES', 'MOVES') AND ast_type IS NOT NULL GROUP BY commit_id) q ON q.commit_id = ev.id)""", _INTENT),
    "calendar_features": sql(f"SELECT commit_id, strftime(make_timestamp(authored_timestamp * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') AS at, {_clock('authored_timestamp')} FROM held"),
    "ngram_cooccur": sql("SELECT x.term AS a, z.term AS b, count(*) AS c FROM et x JOIN et z ON z.id = x.id AND x.term < z.term WHERE x.past GROUP BY ALL HAVING count(*) >= 2", _DOCS, _VOC),
    "sliding_cooccur": sql("SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS w FROM (SELECT x.t AS a, z.t AS b FROM tp x JOIN tp z ON z.id = x.id AND z.i > x.i AND z.i - x.i < 4 AND x.t <> z.t) GROUP BY 1, 2", _DOCS, "tp AS (SELECT id, i, ts[i] AS t FROM dc, LATERAL (SELECT unnest(range(1, len(ts) + 1)) AS i))"),
    "npmi_edges": sql("SELECT a, b, round(npmi, 6) AS npmi FROM np", _DOCS, _VOC, _npmi(0.15)),
    "term_risk_propagated": sql("SELECT term, round(risk, 6) AS risk FROM k3", _DOCS, _VOC, _npmi(0.15), _prop(3, 0.6)),
    "textrank_window4": sql("SELECT id, term, round(CASE WHEN n = 1 THEN 1 ELSE r END, 6) AS centrality FROM q3", _DOCS, *_rank(3)),
    "typed_mass": sql("SELECT dc.id, round(coalesce(prior, (SELECT g FROM gr)), 6) AS prior, " + ", ".join(f"round(coalesce(m_{k}, 0), 6) AS mass_{k}" for k in tx.KINDS) + " FROM dc LEFT JOIN (SELECT id, sum(idf * risk) / sum(idf) AS prior, " + ", ".join(f"sum(CASE WHEN kind = '{k}' THEN idf ELSE 0 END) AS m_{k}" for k in tx.KINDS) + f" FROM (SELECT et.id, vc.idf, k0.risk, {_KIND.replace('term', 'et.term')} AS kind FROM et JOIN vc USING (term) JOIN k0 ON k0.term = et.term) GROUP BY id) q ON q.id = dc.id", _DOCS, _VOC, _npmi(0.15), _prop(0, 0.6)),
    "online_text_prior": sql("SELECT dc.id, dc.seq, round(coalesce(avg(coalesce(k2.risk, g)) FILTER (tm.term IS NOT NULL), any_value(g)), 6) AS prior FROM dc JOIN st ON dc.seq >= st.s AND dc.seq < st.s + m JOIN gr ON gr.s = st.s LEFT JOIN tm ON tm.id = dc.id LEFT JOIN k2 ON k2.s = st.s AND k2.term = tm.term GROUP BY dc.id, dc.seq", _DOCS, *_ONLINE),
    "twidf_features": sql("SELECT id, term, round(CASE WHEN n = 1 THEN 1 ELSE r END * idf, 9) AS w FROM q10 JOIN vc USING (term)", _DOCS, _VOC, *_rank(10)),
    "mentions_top20": sql("SELECT * FROM (SELECT id, term, w, row_number() OVER (PARTITION BY id ORDER BY w DESC, term) AS rank FROM (SELECT id, term, round(round(CASE WHEN n = 1 THEN 1 ELSE r END * idf, 9), 6) AS w FROM q10 JOIN vc USING (term))) WHERE rank <= 20", _DOCS, _VOC, *_rank(10)),
    "stored_terms_refreshed": sql("SELECT t.id, count(DISTINCT tk.commit_id) AS df FROM (SELECT DISTINCT id, text FROM terms) t LEFT JOIN tk ON tk.term = t.text GROUP BY t.id, t.text", _TK),
    "jitline_vocab": sql(f"SELECT {_KIND} || ':' || term AS token, count(*) AS df FROM tm, np_ WHERE seq < n GROUP BY term ORDER BY df DESC, token LIMIT 2000", _DOCS, _VOC),
    "vocab_encode": sql("SELECT id, array_to_string(list_concat(list_transform(ts[1:16], lambda t: coalesce(m[t], 1)), list_transform(range(16), lambda x: 0))[1:16], ' ') AS ids FROM dc, (SELECT map(list(w), list(k)) AS m FROM vo)", _DOCS, "vo AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) + 1 AS k FROM (SELECT unnest(ts) AS w FROM dc) GROUP BY w ORDER BY count(*) DESC, w LIMIT 98)"),
    "offset_positions": "SELECT doc_id, length(b) - length(replace(b, chr(10), '')) + 1 AS line, length(string_split(b, chr(10))[-1]) AS col FROM (SELECT doc_id, text[1:length(text) // 2] AS b FROM documents WHERE text IS NOT NULL)",
    "short_names": "SELECT DISTINCT value, value[1:8] AS short FROM ast_nodes WHERE value IS NOT NULL",
    "content_hash": "SELECT DISTINCT ON (id) id, md5(concat_ws('|', ast_type, coalesce(value, ''))) AS hash FROM ast_nodes",
    "token_repetition": sql("SELECT commit_id AS id, op || ':' || ast_type AS token, least(count(*), 20) AS n FROM chg WHERE op IN ('ADDS', 'REMOVES', 'UPDATES', 'MOVES') AND commit_id IS NOT NULL AND ast_type IS NOT NULL GROUP BY commit_id, op, ast_type"),
}
