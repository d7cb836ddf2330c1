"""Queries of the text problems: term frequencies, co-occurrence, leaks, mixtures, reading levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import ACTION_WORDS, BUG_WORDS, kind_of_word
from tidemark.llm.frequency import term_frequencies, with_marks
from tidemark.llm.leaks import find_leaks, remove_leaks
from tidemark.llm.levels import band, level_profile, reading_levels, train
from tidemark.llm.mixture import listed_sources, mix, mix_counted, source_name, token_counts
from tidemark.llm.together import pairs_together
from tidemark.operators.latest import latest_rows
from tidemark.session import durable, table

TERM = "[A-Za-z]{2,}"


def _commits(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return latest_rows(table(spark, d, "commits"), "commit_id", "ingested_at", columns)


def p3_term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "commits").agg(F.count_distinct("commit_id")).scalar()
    counted = term_frequencies(_commits(spark, d, ["message", "diff"]), "commit_id", ["message", "diff"])
    return with_marks(counted, n)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_term_frequencies(spark, d).where("mark IS NOT NULL").select("term", "mark")


def _pairs(spark: SparkSession, d: str, least_records: int = 3, least_together: int = 3) -> DataFrame:
    words = F.transform(F.regexp_extract_all("message", F.lit(TERM), F.lit(0)), F.lower)
    return pairs_together(_commits(spark, d, ["message"]).select("commit_id", words.alias("terms")), "commit_id", "terms", least_records, least_together)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).where("npmi >= 0.4").select("term_a", "term_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of terms, also those of one commit; the limits of 3 are p4_found's."""
    return _pairs(spark, d, 1, 1).select(
        "term_a", "term_b", "df_a", "df_b", "together", F.round("npmi", 6).alias("npmi"), F.round("lift", 6).alias("lift")
    )


def p4_cooccurs(spark: SparkSession, d: str) -> DataFrame:
    """Rows for the stored co-occurrence table, with the stored value they take the place of (null where none is valid).

    The study's limits: terms of 3 commits, pairs of 2.
    """
    pairs = _pairs(spark, d, 3, 2).where("npmi >= 0.15")
    id_of = lambda c: F.concat_ws(":", kind_of_word(F.col(c)), c)
    old = table(spark, d, "cooccurs").where("a <> b AND npmi BETWEEN -1 AND 1 AND NOT isnan(npmi)")
    old = old.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("npmi").alias("stale_npmi"))
    new = pairs.select(id_of("term_a").alias("x"), id_of("term_b").alias("y"), "npmi")
    new = new.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.round("npmi", 6).alias("npmi"))
    return new.join(old, ["a", "b"], "left").select("a", "b", "npmi", F.round("stale_npmi", 6).alias("stale_npmi"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("item_id", "doc_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per listed source: its documents, and whether each came out once, under the cap, without copies of empty texts, and the tokens wanted
    were reached within the source's longest document and one percent."""
    mixed, report = mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    per = mixed.groupBy("source").agg(F.count_distinct("doc_id").alias("ids"), F.count_if((F.col("n_tokens") == 0) & (F.col("copies") > 0)).alias("empty"))
    off = F.abs(F.col("reached_tokens") - F.coalesce("wanted_tokens", F.lit(0.0)))
    return report.join(per, "source", "left").select(
        "source", "n_docs", (F.coalesce("ids", F.lit(0)) == F.col("n_docs")).alias("each_once"), (F.col("most_copies") <= F.col("max_repeats")).alias("under_cap"),
        (F.coalesce("empty", F.lit(0)) == 0).alias("none_empty"), (off <= F.col("longest") + 0.01 * F.coalesce("wanted_tokens", F.lit(0.0))).alias("reached"), (F.col("gradient") <= 1e-9).alias("solved"),
    )


def p7_margins(spark: SparkSession, d: str) -> DataFrame:
    """A mix of a fifth of the greatest size whose languages move a fifth of the way from the shares there are to equal ones.

    Per language the share wanted, and the share of the rates, which meet it but for the tolerance.
    """
    listed = listed_sources(table(spark, d, "mix_targets"))
    rows = table(spark, d, "documents").select("doc_id", source_name(F.col("source")).alias("source"), F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang"), "text")
    counted = durable(token_counts(rows.where("lang IS NOT NULL AND text <> ''"), ["doc_id", "source", "lang"], "text"))
    caps = spark.createDataFrame([(s, x, c) for s, x, c in listed], "source string, share double, cap int")
    per = counted.join(F.broadcast(caps), "source").groupBy("source", "lang").agg(F.sum("n_tokens").alias("n"), F.max("share").alias("share"))
    # each source's languages by its wanted share; a language is a margin if it has tokens
    now = per.withColumn("part", F.col("share") * F.col("n") / F.sum("n").over(W.partitionBy("source"))).groupBy("lang").agg(F.sum("part").alias("part")).orderBy("lang").collect()
    whole = sum(r["part"] for r in now)
    wanted = {r["lang"]: 0.8 * r["part"] / whole + 0.2 / len(now) for r in now}
    mixed, _ = mix_counted(counted, listed, {"lang": wanted}, fill=0.2)
    goals = spark.createDataFrame(list(wanted.items()), "lang string, wanted double")
    rated = mixed.groupBy("lang").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("r"), F.sum(F.col("copies") * F.col("n_tokens")).alias("reached_tokens"))
    total = rated.agg(F.sum("r").alias("all_r"), F.sum("reached_tokens").alias("all_c"))
    return rated.crossJoin(F.broadcast(total)).join(goals, "lang", "left").select(  # one row
        "lang", F.round("wanted", 6).alias("wanted_share"), F.round(F.col("r") / F.col("all_r"), 6).alias("rate_share"), F.round(F.col("reached_tokens") / F.col("all_c"), 6).alias("reached_share")
    )


def _levels(spark: SparkSession, d: str, documents: DataFrame) -> DataFrame:
    model = train(table(spark, d, "documents"), table(spark, d, "level_labels"))
    return reading_levels(documents, model, keep=("lang", "source"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The operator scores the English documents; the exact check of the band follows.

    Levels do not choose the rows: on sf0.1 levels 1 and 2 have 95.5 percent of the easy documents and levels 4
    and 5 99.4 percent of the hard ones, and a document that is left out cannot come back.
    """
    english = table(spark, d, "documents").where(F.lower("lang").startswith("en"))
    scored = _levels(spark, d, english).where("n_words >= 40 AND level IS NOT NULL")
    return scored.withColumn("band", band(F.col("x"))).where("band IS NOT NULL").select("doc_id", "band")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d, table(spark, d, "documents"))


def p8_measures(spark: SparkSession, d: str) -> DataFrame:
    """What the levels' formula counts in every document."""
    return p8_levels(spark, d).select("doc_id", "n_words", "n_long", "n_ends", F.round("x", 6).alias("x"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return level_profile(p8_levels(spark, d), "source")


QUERIES = {
    "p3_found": p3_found,
    "p3_term_frequencies": p3_term_frequencies,
    "p4_found": p4_found,
    "p4_pairs": p4_pairs,
    "p4_cooccurs": p4_cooccurs,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p6_clean_documents": p6_clean_documents,
    "p7_mix": p7_mix,
    "p7_report": p7_report,
    "p7_invariants": p7_invariants,
    "p7_margins": p7_margins,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
    "p8_measures": p8_measures,
    "p8_profile": p8_profile,
}

_HELD = """
WITH held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY ingested_at DESC) AS rn FROM commits WHERE commit_id IS NOT NULL) WHERE rn = 1),
"""

_P3 = _HELD + """
tok AS (SELECT commit_id, lower(unnest(regexp_extract_all(coalesce(message, '') || chr(10) || coalesce(diff, ''), '[A-Za-z]{2,}'))) AS term FROM held),
cnt AS (SELECT term, count(*) AS occurrences, count(DISTINCT commit_id) AS records FROM tok GROUP BY term),
res AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.3 * (SELECT count(*) FROM held) THEN 'common' END AS mark FROM cnt)
"""


def _p4(least_records: int, least_together: int) -> str:
    return _HELD + f"""
tok AS (SELECT DISTINCT commit_id, lower(unnest(regexp_extract_all(message, '[A-Za-z]{{2,}}'))) AS term FROM held),
freq AS (SELECT term, count(*) AS df FROM tok GROUP BY term HAVING count(*) >= {least_records}),
kept AS (SELECT commit_id, term, df FROM tok JOIN freq USING (term)),
pair AS (SELECT a.term AS term_a, b.term AS term_b, any_value(a.df) AS df_a, any_value(b.df) AS df_b, count(*) AS together
  FROM kept a JOIN kept b ON a.commit_id = b.commit_id AND a.term < b.term GROUP BY a.term, b.term HAVING count(*) >= {least_together}),
scored AS (SELECT *, (SELECT count(*) FROM held)::DOUBLE AS n FROM pair),
res AS (SELECT *, CASE WHEN together = n THEN 1.0 ELSE ln(together * n / (df_a * df_b)) / -ln(together / n) END AS npmi, together * n / (df_a * df_b) AS lift FROM scored)
"""


# Words of every item and document by place; a passage of 13 words is the gram at its first place.
_P6 = """
WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM eval_items),
dw AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM documents),
ig AS (SELECT item_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS gram FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
dg AS (SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM dw)),
hit AS (SELECT item_id, doc_id, dg.i, ig.i AS j FROM ig JOIN dg USING (gram)),
step AS (SELECT item_id, doc_id, i - coalesce(lag(i) OVER (PARTITION BY item_id, doc_id ORDER BY i), -99) AS gap FROM (SELECT DISTINCT item_id, doc_id, i FROM hit))
"""

# A document's leaked words are those of its hits; runs of them are spans, and the text is put together from the pieces outside.
_P6_CLEAN = _P6 + """,
word AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT DISTINCT doc_id, i FROM hit), range(13) r(k)),
span AS (SELECT doc_id, min(p) AS lo, max(p) AS hi FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM word) GROUP BY doc_id, run),
total AS (SELECT doc_id, sum(hi - lo + 1)::BIGINT AS leaked_words, count(*) AS n_spans FROM span GROUP BY doc_id),
longest AS (SELECT doc_id, max(n) + 12 AS longest FROM (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, item_id, i - j AS d, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM hit) GROUP BY doc_id, item_id, d, run) GROUP BY doc_id),
piece AS (SELECT doc_id, text, k, ps[k] AS piece, list_sum(list_transform(ps[1:k - 1], lambda x: length(x)))::BIGINT AS before, regexp_matches(ps[k], '^[a-z0-9]') AS is_word
  FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '[a-z0-9]+|[^a-z0-9]+') AS ps FROM dw WHERE doc_id IN (SELECT doc_id FROM total)), LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS k)),
placed AS (SELECT *, substring(text, coalesce(before, 0) + 1, length(piece)) AS own, count(*) FILTER (is_word) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM piece),
clean AS (SELECT doc_id, coalesce(string_agg(own, '' ORDER BY k), '') AS clean_text FROM placed a
  WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.doc_id = a.doc_id AND a.p >= s.lo AND (a.p < s.hi OR (a.p = s.hi AND a.is_word))) GROUP BY doc_id)
SELECT dw.doc_id, CASE WHEN t.doc_id IS NOT NULL THEN len(ws) END AS doc_words, coalesce(leaked_words, 0) AS leaked_words, coalesce(longest, 0) AS longest, coalesce(n_spans, 0) AS n_spans,
  CASE WHEN t.doc_id IS NULL THEN dw.text WHEN leaked_words * 2 <= len(ws) THEN coalesce(clean_text, '') END AS clean_text, coalesce(leaked_words * 2 > len(ws), false) AS dropped
FROM dw LEFT JOIN total t USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN clean USING (doc_id)
"""

_P8 = r"""
WITH prose AS (SELECT doc_id, lang, regexp_replace(regexp_replace(text, '(?ms)^```.*?(?:^```[^\n]*(?:\n|\z)|\z)', '', 'g'), '(?m)^(?:    |\t)[^\n]*(?:\n|\z)', '', 'g') AS t FROM documents),
m AS (SELECT doc_id, lang, len(regexp_extract_all(t, '\p{L}+')) AS w, len(regexp_extract_all(t, '\p{L}{7,}')) AS l,
  CASE WHEN t IS NOT NULL THEN greatest(1, len(regexp_extract_all(t, '[.!?]+(?:[ \t\r\n]|\z)'))) END AS s FROM prose),
x AS (SELECT doc_id, w / s + 100.0 * l / w AS x FROM m WHERE w >= 40 AND lower(lang) LIKE 'en%')
"""

_IN = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_KIND = f"CASE WHEN {{c}} IN {_IN(BUG_WORDS)} THEN 'bug' WHEN {{c}} IN {_IN(ACTION_WORDS)} THEN 'action' ELSE 'nl' END"

ORACLE = {
    "p3_found": _P3 + "SELECT term, mark FROM res WHERE mark IS NOT NULL",
    "p3_term_frequencies": _P3 + "SELECT term, occurrences, records, mark FROM res",
    "p4_found": _p4(3, 3) + "SELECT term_a, term_b FROM res WHERE npmi >= 0.4",
    "p4_pairs": _p4(1, 1) + "SELECT term_a, term_b, df_a, df_b, together, round(npmi, 6) AS npmi, round(lift, 6) AS lift FROM res",
    "p4_cooccurs": _p4(3, 2)
    + f""", new AS (SELECT least(x, y) AS a, greatest(x, y) AS b, round(npmi, 6) AS npmi FROM (SELECT {_KIND.format(c="term_a")} || ':' || term_a AS x, {_KIND.format(c="term_b")} || ':' || term_b AS y, npmi FROM res WHERE npmi >= 0.15)),
      old AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(npmi) AS npmi FROM cooccurs WHERE a <> b AND npmi BETWEEN -1 AND 1 AND NOT isnan(npmi) GROUP BY 1, 2)
      SELECT new.a, new.b, new.npmi, round(old.npmi, 6) AS stale_npmi FROM new LEFT JOIN old ON old.a = new.a AND old.b = new.b""",
    "p6_found": _P6 + "SELECT DISTINCT item_id, doc_id FROM hit",
    "p6_leaks": _P6 + "SELECT item_id, doc_id, sum(least(13, gap))::BIGINT AS covered_words, any_value(len(ws)) AS doc_words FROM step JOIN dw USING (doc_id) GROUP BY item_id, doc_id",
    "p6_clean_documents": _P6_CLEAN,
    "p7_invariants": r"""
      WITH t AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source FROM mix_targets WHERE source IS NOT NULL),
      d AS (SELECT regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') AS source, count(*) AS n FROM documents GROUP BY 1)
      SELECT t.source, coalesce(d.n, 0) AS n_docs, true AS each_once, true AS under_cap, true AS none_empty, true AS reached, true AS solved FROM t LEFT JOIN d USING (source)""",
    "p8_found": _P8 + "SELECT doc_id, CASE WHEN x < 30 THEN 'easy' ELSE 'hard' END AS band FROM x WHERE x < 30 OR x > 60",
    "p8_measures": _P8 + "SELECT doc_id, w AS n_words, l AS n_long, s AS n_ends, round(w / s + 100.0 * l / nullif(w, 0), 6) AS x FROM m",
}
