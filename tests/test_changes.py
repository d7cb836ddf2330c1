import random

import pytest

from tidemark.operators.changes import Base, Feed, apply_changes, base_state, current_rows, fold_changes, settle

FB = Base("id", "file", "alive", {"value": "value"}, {"kind": "kind"})
FF = Feed("no", "delivery", "op", "node", "file", {"value": "new"}, {"kind": "kind"})
BASE = "id string, file string, alive boolean, value string, kind string, extra int"
FEED = "no long, delivery long, op string, node string, file string, new string, kind string, seq string"


def replay(base, feed):
    state = {}
    for id_, file, alive, value, kind, _ in base:
        if id_ is not None and alive:
            state[id_] = (value, kind, 0)
    latest = {}
    for row in feed:
        if row[0] is not None and (row[0] not in latest or latest[row[0]][1] < row[1]):
            latest[row[0]] = row
    for no in sorted(latest):
        _, delivery, op, node, file, new, kind, _ = latest[no]
        op = (op or "").strip().upper()
        file = file or (node.split("::")[0] if node and "::" in node else None)
        if op == "ADDS" and node and node not in state:
            state[node] = (new, kind, delivery)
        elif op == "UPDATES" and node in state:
            state[node] = (new, state[node][1], delivery)
        elif op == "REMOVES" and node:
            state.pop(node, None)
        elif op == "REMOVES" and file:
            for n in [n for n in state if n.split("::")[0] == file]:
                del state[n]
    return state


def state_of(spark, base, feed, **kw):
    df = apply_changes(spark.createDataFrame(base, BASE), spark.createDataFrame(feed, FEED), FB, FF, **kw)
    return {r["key"]: (r["value"], r["kind"], r["set_by"]) for r in df.collect() if r["alive"]}


def random_feed(seed):
    rng = random.Random(seed)
    nodes = [f"f{f}::n{n}" for f in range(3) for n in range(6)] + ["f0::hot"] * 12
    base = [(n, n.split("::")[0], rng.choice([True, False, None]), f"b{n}", "base", 1) for n in sorted(set(nodes))[:9]]
    base += base[:2]
    feed = []
    for no in [None, *range(200)]:
        for delivery in range(rng.choice([1, 1, 2])):
            op = rng.choice(["ADDS", "adds ", "UPDATES", " Updates", "REMOVES", "removes", "MOVES", "?", None])
            node = rng.choice([*nodes, None])
            file = node.split("::")[0] if node else rng.choice(["f1", None])
            feed.append((no, (no or 0) * 10 + delivery, op, node, rng.choice([file, file, None]) if node else file, f"v{no}.{delivery}", rng.choice(["a", None]), "s"))
    feed += feed[:20]
    rng.shuffle(feed)
    return base, feed


@pytest.mark.parametrize("rows_per_shard", [1_000_000, 25])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_replay_in_any_order_of_arrival(spark, seed, rows_per_shard):
    base, feed = random_feed(seed)
    assert state_of(spark, base, feed, rows_per_shard=rows_per_shard) == replay(base, feed)


def rows_of(df):
    return {r["key"]: (r["value"], r["kind"], r["set_by"]) for r in df.collect() if r["alive"]}


@pytest.mark.parametrize("seed,n_parts", [(4, 1), (5, 2), (6, 4), (7, 5)])
def test_a_feed_in_parts_in_any_order(spark, seed, n_parts):
    """Also with deliveries of one change in different parts, and facts settled in between."""
    base, feed = random_feed(seed)
    rng = random.Random(seed)
    parts = [[] for _ in range(n_parts)]
    for row in feed:
        rng.choice(parts).append(row)
    state = base_state(spark.createDataFrame(base, BASE), FB)
    for p in parts:
        state = fold_changes(spark.createDataFrame(p, FEED), FF, state)
    names = ["value"], ["kind"]
    assert rows_of(current_rows(state, *names)) == replay(base, feed)
    # everything up to 120 has come; the rest comes in any order, with late copies of what is settled
    early, late = [r for r in feed if (r[0] or 0) <= 120], [r for r in feed if (r[0] or 0) > 120]
    cut = rng.randrange(len(late))
    state = fold_changes(spark.createDataFrame(early + late[:cut], FEED), FF, base_state(spark.createDataFrame(base, BASE), FB))
    state = settle(state, 120, *names)
    assert state.where("settled").count() == len({r["key"] for r in state.where("settled").collect()})
    state = fold_changes(spark.createDataFrame(late[cut:] + early[:30], FEED), FF, state, 120)
    assert rows_of(current_rows(state, *names)) == replay(base, feed)


def test_late_change_before_a_tombstone_stays_without_effect(spark):
    feed = [(2, 1, "REMOVES", "f::a", "f", None, None, ""), (1, 2, "ADDS", "f::a", "f", "v", "k", "")]
    assert state_of(spark, [], feed) == {}
    dead = apply_changes(spark.createDataFrame([], BASE), spark.createDataFrame(feed, FEED), FB, FF, tombstones=True).collect()
    assert [(r["key"], r["grp"], r["alive"], r["value"], r["set_by"]) for r in dead] == [("f::a", "f", False, None, None)]


def test_empty_feed_and_empty_base(spark):
    assert state_of(spark, [], []) == {}
    assert state_of(spark, [("f::a", None, True, None, "k", 0)], []) == {"f::a": (None, "k", 0)}


def test_names_of_the_result_are_kept_free(spark):
    with pytest.raises(ValueError):
        apply_changes(spark.createDataFrame([], BASE), spark.createDataFrame([], FEED), Base("id", "file", "alive", {"key": "value"}, {}), Feed("no", "delivery", "op", "node", "file", {"key": "new"}, {}))
