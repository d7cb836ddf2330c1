"""The text prior of the models reads whole messages."""

import pytest

from tidemark.plans import model_queries, text_queries


def test_the_prior_reads_whole_messages(spark, monkeypatch):
    """Word 4,100 of the first message is the only one of the third."""
    letters = "ghjklmnpqr"
    words = [f"z{letters[i // 1000]}{letters[i // 100 % 10]}{letters[i // 10 % 10]}{letters[i % 10]}" for i in range(4100)]
    rows = [(f"e{i:02}", i, int(not i), " ".join(words) if not i else words[-1] if i == 2 else f"other{'z' * i}") for i in range(50)]
    ev = spark.createDataFrame(rows, "id string, seq long, y int, message string")
    monkeypatch.setattr(text_queries, "events", lambda *a: ev)
    got = {r["id"]: r["prior"] for r in model_queries._text_prior(spark, "").collect()}
    assert got["e02"] == pytest.approx(3.5 / 6) and got["e03"] == pytest.approx(0.5)
