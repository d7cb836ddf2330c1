import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.levels import band, given_levels, level_profile, reading_levels, train, with_measures
from tidemark.session import table

DOCS = "doc_id long, text string, lang string, level string, x int"
REAL = "/root/testdata/sf0.1"


def brute(text):
    kept, fenced = [], False
    for line in (text or "").split("\n"):
        if line.startswith("```"):
            fenced = not fenced
        elif not fenced and not line.startswith(("    ", "\t")):
            kept.append(line)
    body = "\n".join(kept)
    runs, run = [], ""
    for c in body + " ":
        if c.isalpha():
            run += c
        elif run:
            runs.append(run)
            run = ""
    ends = len(re.findall(r"[.!?]+(?=[ \t\r\n]|\Z)", body))
    return len(runs), sum(len(r) > 6 for r in runs), max(1, ends)


def test_measures_against_brute_force(spark):
    rng = random.Random(1)
    bits = ["```", "```java\n", "\n", "\r\n", "    code here", "\tcode", "Wörter länger", "a.b", "?! ", "...", "Straßenbahn", "日本語日本語日本", "`", "   x", " ", "end.", "1234567"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(400)] + ["", "```\nopen", "x" * 100_000]
    df = spark.createDataFrame([(i, t, "en", "l", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: (r["n_words"], r["n_long"], r["n_ends"]) for r in with_measures(df.drop("x"), "text").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def synthetic(spark):
    rng = random.Random(2)
    easy, hard = ["dog", "run", "sun", "cat", "red"], ["ontological", "consequently", "paradigmatic", "institution", "heterogeneous"]
    docs = []
    for i in range(300):
        level = i % 5 + 1
        ws = [rng.choice(hard if rng.random() < (level - 1) / 4 else easy) for _ in range(80)]
        docs.append((i, " ".join(ws) + ".", rng.choice(["en", "en", "EN-us", None]), "clash", 1))
    return docs


def test_trained_on_labels(spark):
    docs = synthetic(spark)
    extra = [(900, None, "en", "", 1), (901, "", "en", "", 1), (902, "```\nall code", "en", "", 1)]
    df = spark.createDataFrame(docs + extra, DOCS)
    labels = spark.createDataFrame([(i, i % 5 + 1, "a") for i in range(0, 300, 2)] + [(0, None, "b"), (0, 1, "a")], "doc_id long, level int, annotator string")
    model = train(df, labels)
    got = {r["doc_id"]: r for r in reading_levels(df, model).collect()}
    odd = [i for i in range(1, 300, 2)]
    assert sum(got[i]["level"] == i % 5 + 1 for i in odd) / len(odd) > 0.7
    assert [got[i]["level"] for i in (900, 901, 902)] == [None, None, None]
    assert all(0.2 <= got[i]["posterior"] <= 1 for i in odd)
    assert sum(r["n_docs"] for r in level_profile(reading_levels(df, model, keep=("lang",)), "lang").collect()) == 300


def test_seeded_by_formula_without_labels(spark):
    df = spark.createDataFrame(synthetic(spark), DOCS)
    model = train(df, spark.createDataFrame([], "doc_id long, level int, annotator string"))
    rows = reading_levels(df, model).collect()
    assert {r["level"] for r in rows} <= {1, 2, 3, 4, 5} and len(rows) == 300


def test_every_language_and_short_texts(spark):
    """Forty languages, each with its own words, and labelled texts of three words."""
    rng = random.Random(4)
    tags = [a + b for a in "abcdefgh" for b in "vwxyz"]
    word = lambda tag, level: f"{tag}{'qwert'[level - 1] * (level + 2)}"
    docs, labels = [], []
    for i in range(1200):
        tag, level = tags[i % 40], i // 40 % 5 + 1
        docs.append((i, " ".join(word(tag, level if rng.random() < 0.8 else rng.randrange(1, 6)) for _ in range(3 if i % 3 else 50)) + ".", tag.upper(), "clash", 1))
        if i % 3:
            labels.append((i, level, "a"))
    df = spark.createDataFrame(docs, DOCS)
    model = train(df, spark.createDataFrame(labels, "doc_id long, level int, annotator string"), seed_weight=0.01)
    assert len(model.level) == 200
    got = {r["doc_id"]: r["level"] for r in reading_levels(df, model).collect()}
    asked = [i for i in range(0, 1200, 3)]
    assert sum(got[i] == i // 40 % 5 + 1 for i in asked) / len(asked) > 0.95


def test_empty(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, level int, annotator string")
    assert reading_levels(none, train(none, labels)).collect() == []
    with pytest.raises(ValueError):
        reading_levels(none, train(none, labels), keep=("level",))


def test_given_levels_and_band(spark):
    labels = spark.createDataFrame([(1, 2, "a"), (1, 2, "a"), (1, 3, "b"), (2, None, "a"), (3, 4, "a"), (3, 4, "b"), (3, 1, "c")], "doc_id long, level int, annotator string")
    assert {r["doc_id"]: r["level"] for r in given_levels(labels).collect()} == {1: 3, 3: 4}
    xs = spark.createDataFrame([(29.9,), (30.0,), (60.0,), (60.1,), (None,)], "x double")
    assert [r[0] for r in xs.select(band(F.col("x"))).collect()] == ["easy", None, None, "hard", None]


@pytest.mark.skipif(not os.path.isdir(REAL), reason="no test tables")
def test_held_out_accuracy(spark):
    """Trained on the even half of the labelled documents, within one level on most of the odd half."""
    labels = table(spark, REAL, "level_labels")
    docs = table(spark, REAL, "documents")
    odd = given_levels(labels.where("doc_id % 2 = 1"))
    model = train(docs.join(odd.select("doc_id"), "doc_id", "left_anti"), labels.where("doc_id % 2 = 0"))
    rows = reading_levels(docs.join(odd.select("doc_id"), "doc_id"), model).join(odd.withColumnRenamed("level", "given"), "doc_id").where("level IS NOT NULL").collect()
    assert len(rows) > 300
    assert sum(abs(r["level"] - r["given"]) <= 1 for r in rows) / len(rows) > 0.9
    assert sum(r["level"] == r["given"] for r in rows) / len(rows) > 0.6
    english = reading_levels(docs.where(F.lower("lang").startswith("en")), model).where("n_words >= 40").withColumn("band", band(F.col("x")))
    easy, found_easy, hard, found_hard = english.agg(*[F.count_if((F.col("band") == b) & c) for b, low in (("easy", True), ("hard", False)) for c in (F.lit(True), F.col("level") <= 2 if low else F.col("level") >= 4)]).collect()[0]
    assert found_easy / easy > 0.9 and found_hard / hard > 0.9


def test_every_document_is_trained_on(spark):
    """9,000 documents of one language, each with a word of its own: all of them are in the model."""
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(".")).alias("text"), F.lit("fr").alias("lang"))
    model = train(docs, spark.createDataFrame([(1, 2, "a")], "doc_id long, level int, annotator string"))
    assert len(model.words) == 9000 + 1
