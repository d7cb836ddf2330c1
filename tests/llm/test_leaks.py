import random
import re

import pytest

from tidemark.llm.leaks import Automaton, find_leaks, remove_leaks

DOCS = "doc_id long, text string, item_id long, covered_words string"
ITEMS = "item_id long, text string, doc_id long"


def words(t):
    return re.findall("[a-z0-9]+", (t or "").lower())


def grams(ws, n):
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}


def brute(docs, items, n):
    out = {}
    for item, text, _ in items:
        wanted = grams(words(text), n)
        for doc, body, *_ in docs:
            ws = words(body)
            covered = {j for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in wanted for j in range(i, i + n)}
            if covered:
                out[item, doc] = (len(covered), len(ws))
    return out


def random_case(seed):
    rng = random.Random(seed)
    sep = [" ", ", ", "\n", " -- ", "é "]
    text = lambda k: "".join(rng.choice("abcABC1") + rng.choice(sep) for _ in range(k))
    items = [(i, text(rng.randrange(0, 14)), 0) for i in range(12)] + [(50, None, 0), (51, "", 0)]
    items += [(60, items[3][1], 0)]
    docs = [(i, text(rng.randrange(0, 60)), 0, "x") for i in range(40)] + [(90, None, 0, "x"), (91, "", 0, "x"), (92, text(3000), 0, "x")]
    docs += [(93, docs[5][1], 0, "x")]
    return docs, items


@pytest.mark.parametrize("budget", [1_000_000, 10])
@pytest.mark.parametrize("seed,n", [(1, 4), (2, 5), (3, 2)])
def test_against_brute_force(spark, seed, n, budget):
    docs, items = random_case(seed)
    got = find_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), min_words=n, words_per_automaton=budget)
    assert {(r["item_id"], r["doc_id"]): (r["covered_words"], r["doc_words"]) for r in got.collect()} == brute(docs, items, n)


def test_matching_lengths():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice("abc") for _ in range(12))) for i in range(5)]
    automaton = Automaton(3).build(items)
    subs = {tuple(w.split()[i:j]) for _, w in items for i in range(12) for j in range(i + 1, 13)}
    doc = [rng.choice("abcd") for _ in range(200)]
    codes = [automaton.vocabulary.get(w, -1) for w in doc]
    for i, (_, length) in enumerate(automaton.packed().stream(codes)):
        want = next(k for k in range(min(i + 1, 12), -1, -1) if k == 0 or tuple(doc[i + 1 - k : i + 1]) in subs)
        assert length == want
    assert len(automaton.step) <= 2 * 60


def test_clean_text(spark):
    items = [(1, "one two three four five", 0)]
    docs = [(1, "Start. One two, THREE four end.", 0, ""), (2, "one two three four", 0, ""), (3, "one two x three four", 0, ""), (4, None, 0, "")]
    got = {r["doc_id"]: r for r in remove_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), min_words=3, coverage_limit=0.7).collect()}
    assert got[1]["clean_text"] == "Start.  end." and (got[1]["leaked_words"], got[1]["longest"], got[1]["n_spans"], got[1]["dropped"]) == (4, 4, 1, False)
    assert got[2]["clean_text"] is None and got[2]["dropped"]
    assert got[3]["clean_text"] == "one two x three four" and got[3]["leaked_words"] == 0
    assert got[4]["clean_text"] is None and not got[4]["dropped"]


def test_text_keeps_its_case_where_lower_casing_changes_its_length(spark):
    items = [(1, "one two three", 0), (2, "i\u0307 x y", 0)]
    docs = [(1, "\u0130 Keep My CASE one TWO three \u0130nd", 0, ""), (2, "A \u0130 X\u0130 \u03a3 one two three Z", 0, "")]
    got = {r["doc_id"]: r["clean_text"] for r in remove_leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), min_words=3, coverage_limit=0.7).collect()}
    assert got == {1: "\u0130 Keep My CASE  \u0130nd", 2: "A \u0130 X\u0130 \u03a3  Z"}


@pytest.mark.parametrize("seed", [1, 2])
def test_several_passes_equal_one(spark, seed):
    docs, items = random_case(seed)
    docs, items = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    out = [{tuple(r) for r in remove_leaks(docs, items, min_words=3, words_per_automaton=w, automata_per_pass=k).collect()} for w, k in ((1_000_000, 8), (9, 1), (9, 2))]
    assert out[0] == out[1] == out[2] and any(r[2] for r in out[0])
    found = [{tuple(r) for r in find_leaks(docs, items, min_words=3, words_per_automaton=w, automata_per_pass=k).collect()} for w, k in ((1_000_000, 8), (9, 2))]
    assert found[0] == found[1]


def test_empty(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert find_leaks(docs, items).collect() == []
    assert find_leaks(spark.createDataFrame([(1, "a b", 0, "")], DOCS), items).collect() == []
    assert remove_leaks(docs, items).collect() == []
