"""Reading level of documents, by smoothed unigram language models per grade level.

Prose is measured by a formula: with W words, L words of more than six letters and S sentence ends,
x = W / S + 100 L / W. Language models are trained on documents with a level given by hand and, with less
weight, on documents of every language seeded by the formula. A model has the word probabilities of
each (language, level), smoothed towards those of all training texts. A document gets the level with the
highest posterior, summed over languages, so a null or wrong language does no harm.

Every labelled document and every other one is trained on. The model has the words of each class, kept sparse, so
it grows with the vocabulary and not with the documents. Scoring reads every document whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import durable, fresh

LEVELS = 5
#: Upper bounds of x of levels 1 to 4 in English (fixed values of this operator).
ENGLISH_BOUNDS = (18.0, 30.0, 48.0, 70.0)
FENCED = r"(?msd)^```.*?(?:^```[^\n]*(?:\n|\z)|\z)"
INDENTED = r"(?md)^(?:    |\t)[^\n]*(?:\n|\z)"


def prose(text: Column) -> Column:
    """Text without fenced blocks (an open one runs to the end) and without lines indented by four spaces or a tab."""
    return F.regexp_replace(F.regexp_replace(text, FENCED, ""), INDENTED, "")


def with_measures(df: DataFrame, text: str) -> DataFrame:
    """Add ``prose_, n_words, n_long, n_ends, x``; x is null for prose without words, all are null for null text."""
    out = df.withColumn("prose_", prose(F.col(text)))
    out = out.withColumns(
        {
            "n_words": F.regexp_count("prose_", F.lit(r"\p{L}+")).cast("long"),
            "n_long": F.regexp_count("prose_", F.lit(r"\p{L}{7,}")).cast("long"),
            "n_ends": F.when(F.col("prose_").isNotNull(), F.greatest(F.regexp_count("prose_", F.lit(r"[.!?]+(?:[ \t\r\n]|\z)")), F.lit(1))).cast("long"),
        }
    )
    return out.withColumn("x", F.col("n_words") / F.col("n_ends") + F.try_divide(F.lit(100.0) * F.col("n_long"), F.col("n_words")))


def language(c: Column) -> Column:
    """Two-letter language of a tag in any case; ``und`` where there is none."""
    tag = F.lower(F.substring(F.trim(c), 1, 2))
    return F.when(tag.rlike("^[a-z]{2}$"), tag).otherwise("und")


@dataclass
class LevelModel:
    """Per word the classes that have it (``cls``, from ``start``) with the log of how far it is above the smoothing."""

    words: pa.Array
    start: np.ndarray
    cls: np.ndarray
    gain: np.ndarray
    per_word: np.ndarray  # by class: log-probability that every known word costs
    log_prior: np.ndarray
    level: np.ndarray


def given_levels(labels: DataFrame, doc: str = "doc_id", level: str = "level") -> DataFrame:
    """One level per document: the rounded median of the annotators' levels; nulls and copies do not count."""
    return (
        labels.where(F.col(level).between(1, LEVELS)).distinct().groupBy(F.col(doc).alias("doc_id"))
        .agg(F.floor(F.expr(f"percentile(`{level}`, 0.5)") + 0.5).cast("int").alias("level"))
    )


def train(
    documents: DataFrame,
    labels: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    seed_weight: float = 0.25,
    pull: float = 200.0,
) -> LevelModel:
    """Train on the labelled documents and on all others, which are seeded by the formula.

    A seeded document counts ``seed_weight``. English is cut at ENGLISH_BOUNDS; the cuts of another language are the
    quantiles of x of its seeds at the shares of the given levels (20, 40, 60, 80 percent where nothing is
    labelled), to a ten-thousandth of a rank. Texts are read whole and every word counts. ``pull`` is the weight, in
    words, of the smoothing distribution. Empty tables give a model in which all levels are alike.
    """
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), language(F.col(lang)).alias("lang")).where("text IS NOT NULL")
    given = durable(given_levels(labels))
    measured = with_measures(rows.join(given, "doc_id", "left"), "text")
    counts = {r["level"]: r["n"] for r in given.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    cuts = [sum(counts.get(i, 0) for i in range(1, k + 1)) / total for k in range(1, LEVELS)] if total else [0.2, 0.4, 0.6, 0.8]
    # English has fixed bounds, so only the other languages are measured for theirs; at most 676 rows
    bounds = durable(with_measures(rows.where("lang <> 'en'").join(given, "doc_id", "left_anti"), "text").groupBy("lang").agg(F.percentile_approx("x", cuts, 10_000).alias("cuts_")))
    own = F.when(F.col("lang") == "en", F.array(*[F.lit(b) for b in ENGLISH_BOUNDS])).otherwise(F.col("cuts_"))
    texts = measured.join(F.broadcast(bounds), "lang", "left").select(
        "lang", "prose_", F.coalesce("level", F.when(F.col("x").isNotNull(), F.size(F.filter(own, lambda b: F.col("x") > b)) + 1)).cast("int").alias("level"),
        F.when(F.col("level").isNull(), F.lit(seed_weight)).otherwise(1.0).alias("weight"),
    )
    word = F.explode(F.regexp_extract_all(F.lower("prose_"), F.lit(r"\p{L}+"), F.lit(0)))
    counted = texts.select("lang", "level", "weight", word.alias("word")).groupBy("word", "lang", "level").agg(F.sum("weight").alias("n")).orderBy("word", "lang", "level").toArrow()
    words = counted.column("word").combine_chunks().dictionary_encode()
    name = pa.array([f"{a}|{b}" for a, b in zip(counted.column("lang").to_pylist(), counted.column("level").to_pylist())], pa.string()).dictionary_encode()
    classes = name.dictionary.to_pylist() or [f"|{k}" for k in range(1, LEVELS + 1)]
    number, cls = words.indices.to_numpy(zero_copy_only=False), name.indices.to_numpy(zero_copy_only=False)
    n = counted.column("n").to_numpy().astype(np.float64)
    background = np.bincount(number, weights=n, minlength=len(words.dictionary)).astype(np.float64)
    background /= max(background.sum(), 1e-9)
    size = np.bincount(cls, weights=n, minlength=len(classes)).astype(np.float64)
    # p(word | class) = (n + pull b) / (size + pull); the part with b alone is the same for all classes
    languages = [c.split("|")[0] for c in classes]
    prior = np.array([-np.log(languages.count(x)) for x in languages]) - np.log(len(set(languages)))
    return LevelModel(
        words.dictionary, np.searchsorted(number, np.arange(len(words.dictionary) + 1)), cls.astype(np.int32), np.log1p(n / (pull * background[number])).astype(np.float32),
        np.log(pull / (size + pull)), prior, np.array([int(c.split("|")[1]) for c in classes]),
    )


def _scores(model: LevelModel, rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Log-probability of each of ``n`` texts under each class, from the (row, word) of their known words."""
    k = len(model.level)
    out = np.bincount(rows, minlength=n)[:, None] * model.per_word + model.log_prior
    for lo in range(0, len(rows), 200_000):
        r, w = rows[lo : lo + 200_000], words[lo : lo + 200_000]
        lens = model.start[w + 1] - model.start[w]
        at = np.repeat(model.start[w] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
        out += np.bincount(np.repeat(r, lens) * k + model.cls[at], weights=model.gain[at], minlength=n * k).reshape(n, k)
    return out


def _posteriors(model: LevelModel, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = model.words.cast(pa.large_string())
    member = np.array([model.level == k for k in range(1, LEVELS + 1)])
    step = max(1, 4_000_000 // len(model.level))
    for whole in batches:
        for batch in (whole.slice(lo, step) for lo in range(0, whole.num_rows, step)):
            names = batch.schema.names
            texts = batch.column(names.index("prose_"))
            n = batch.num_rows
            lowered = pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.large_string())
            lists = pc.split_pattern_regex(lowered, pattern=r"[^\p{L}]+")
            at = pc.index_in(pc.list_flatten(lists), value_set=known)
            hit = pc.is_valid(at)
            rows = pc.list_parent_indices(lists).filter(hit).to_numpy(zero_copy_only=False).astype(np.int64)
            scores = _scores(model, rows, at.drop_null().to_numpy(zero_copy_only=False), n)
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            by_level = np.stack([p[:, m].sum(axis=1) for m in member], axis=1)
            by_level /= by_level.sum(axis=1, keepdims=True)
            columns = [batch.column(i) for i, name in enumerate(names) if name != "prose_"]
            empty = (batch.column(names.index("n_words")).fill_null(0).to_numpy(zero_copy_only=False)) == 0
            level = pa.array(by_level.argmax(axis=1) + 1, pa.int32(), mask=empty)
            posterior = pa.array(by_level.max(axis=1), pa.float64(), mask=empty)
            yield pa.record_batch([*columns, level, posterior], names=[*(x for x in names if x != "prose_"), "level", "posterior"])


def reading_levels(documents: DataFrame, model: LevelModel, doc: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc``, the ``keep`` columns, ``n_words, n_long, n_ends, x, level, posterior`` of every row of ``documents``.

    Level and posterior are null for null texts and for texts without a word of prose; of equally
    likely levels the easiest. Rows with equal ids are each scored. Whole texts are read.
    """
    clash = {"prose_", "n_words", "n_long", "n_ends", "x", "level", "posterior"} & {c.lower() for c in (doc, *keep)}
    if clash:
        raise ValueError(f"rename these columns first: {sorted(clash)}")
    source = fresh(list(keep), "text_")
    measured = with_measures(documents.select(doc, *keep, F.col(text).alias(source)), source)
    measured = measured.select(doc, *keep, "n_words", "n_long", "n_ends", "x", "prose_")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields if f.name != "prose_")
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return measured.mapInArrow(lambda batches: _posteriors(sent.value, batches), f"{kinds}, level int, posterior double")


def band(x: Column, easy_below: float = 30, hard_above: float = 60) -> Column:
    return F.when(x < easy_below, "easy").when(x > hard_above, "hard")


def level_profile(levels: DataFrame, by: str) -> DataFrame:
    """Documents and mean x per value of ``by`` and level, and the level's share within the value."""
    counted = levels.where("level IS NOT NULL").groupBy(by, "level").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("x").alias("mean_x"))
    return counted.withColumn("share", F.col("n_docs") / F.sum("n_docs").over(W.partitionBy(by)))
