import random
import re
from collections import Counter

import pytest

from tidemark.llm.frequency import term_frequencies, with_marks

SCHEMA = "id string, message string, diff string, term string"
TEXTS = ["Fix the BUG in lock", "", None, "a bb bb a\tcc", "été ﬁx naïve KKelvin", "x" * 50_000, "bb-cc_dd bb\r\nbb", "the the THE"]


def brute(rows):
    occ, rec = Counter(), {}
    for id_, *texts, _ in rows:
        for t in texts:
            for w in re.findall("[A-Za-z]{2,}", t or ""):
                occ[w.lower()] += 1
                rec.setdefault(w.lower(), set()).add(id_)
    return {t: (occ[t], len(rec[t])) for t in occ}


@pytest.mark.parametrize("flush", [1_000_000, 2])
@pytest.mark.parametrize("copies", [1, 4])
def test_against_counter(spark, flush, copies):
    """With several rows per record, the same term of one record counts once however the rows are spread."""
    rng = random.Random(copies)
    rows = [(f"r{i}", rng.choice(TEXTS), rng.choice(TEXTS), "clash") for i in range(120) for _ in range(copies)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = term_frequencies(spark.createDataFrame(rows, SCHEMA), "id", ["message", "diff"], copies == 1, flush).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == brute(rows)


def test_a_record_with_a_third_of_all_rows_is_cut(spark):
    """Its rows lie in several partitions, and each of its terms still counts it once."""
    rows = [("hot" if i % 3 else f"r{i:03d}", f"alpha beta w{'xyz'[i % 3]}{'abcdefghij'[i % 10]}", None, "") for i in range(600)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = term_frequencies(spark.createDataFrame(rows, SCHEMA), "id", ["message", "diff"], False, 5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {r["term"]: (r["occurrences"], r["records"]) for r in got} == brute(rows)


def test_marks_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert term_frequencies(empty, "id", ["message"]).collect() == []
    counted = spark.createDataFrame([("aa", 9, 2), ("bb", 9, 3), ("cc", 9, 4)], "term string, occurrences long, records long")
    assert [r["mark"] for r in with_marks(counted, 10).orderBy("term").collect()] == ["rare", None, "common"]
