"""Places in reply trees against a walk by hand: branching, stars, long chains, circles, repeated and missing ids."""

import random

import pytest

from parley.operators.context import intervention_by_reply
from parley.operators.corpus import chunks
from parley.operators.threads import thread_places, with_place

SCHEMA = "conv_id string, message_id string, reply_to string, at long, is_moderator boolean, text string, pos int"


def by_hand(rows):
    """Places by a depth-first walk: (conv, id) -> place; None on and above circles."""
    nodes = {}
    for conv, message, parent, at in rows:
        if message is not None:
            old = nodes.get((conv, message), (None, None))
            pick = lambda a, b: a if b is None else b if a is None else min(a, b)
            nodes[conv, message] = (pick(old[0], parent), pick(old[1], at))
    below, starts = {}, {}
    for (conv, message), (parent, at) in nodes.items():
        first = (at is not None, at or 0, message)
        if parent is not None and (conv, parent) in nodes:
            below.setdefault((conv, parent), []).append((first, message))
        else:
            starts.setdefault(conv, []).append(((parent is not None, parent or ""), first, message))
    places = dict.fromkeys(nodes)
    for conv, found in starts.items():
        stack, place = [m for *_, m in sorted(found, reverse=True)], 0
        while stack:
            message, place = stack.pop(), place + 1
            places[conv, message] = place
            stack += [m for _, m in sorted(below.get((conv, message), []), reverse=True)]
    return places


def frame(spark, rows):
    return spark.createDataFrame([(*r, False, f"t{r[1]}", 0) for r in rows], SCHEMA).repartition(3)


def tree(conv, n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        parent = None if i == 0 or rng.random() < 0.1 else f"m{rng.randrange(i)}"
        out.append((conv, f"m{i}", "gone" if rng.random() < 0.05 else parent, rng.randrange(3)))
    return out


CASES = {
    "random trees": [r for c in range(6) for r in tree(f"c{c}", 60, c)],
    "a chain": [("c", f"{i:04}", f"{i - 1:04}" if i else None, None) for i in range(700)],
    "a star": [("c", "top", None, None)] + [("c", f"{i:04}", "top", 5 - i % 6) for i in range(600)],
    "many starts": [("c", f"{i:04}", None if i % 2 else f"missing{i % 5}", None) for i in range(90)],
    "other discussions": [("a", "1", None, 0), ("b", "2", "1", 0), ("a", "3", "1", 0), (None, "1", None, 0), (None, "5", "1", 0)],
    "circles": [("c", "1", None, 0), ("c", "2", "1", 0), ("c", "x", "x", 0), ("c", "p", "q", 0), ("c", "q", "p", 0),
                ("c", "r", "p", 0), ("d", "p", "q", 0)],
    "repeated ids": [("c", "1", None, 0), ("c", "2", "1", 4), ("c", "2", "1", 4), ("c", "2", "9", 1), ("c", "3", "1", 2),
                     ("c", None, "1", 0), ("c", None, None, None)],
    "nothing": [],
}


@pytest.mark.parametrize("name", CASES)
def test_places_equal_a_walk(spark, name):
    rows = CASES[name]
    got = thread_places(frame(spark, rows), order="at").collect()
    want = by_hand(rows)
    assert {(r["conv_id"], r["message_id"]): r["place"] for r in got} == want
    assert len(got) == len(want)


def test_rows_that_share_an_id_share_its_place(spark):
    rows = CASES["repeated ids"]
    placed = with_place(frame(spark, rows), order="at")
    assert placed.columns == frame(spark, rows).columns + ["place"]
    got = sorted((r["message_id"] or "", r["place"] or 0) for r in placed.collect())
    want = by_hand(rows)
    assert got == sorted((m or "", (want.get((c, m)) if m else None) or 0) for c, m, *_ in rows)


def test_chunks_of_a_thread(spark):
    rows = CASES["a star"]
    items = {r["chunk"]: r for r in chunks(with_place(frame(spark, rows), order="at"), position="place").collect()}
    order = sorted((m for _, m, p, _ in rows if p), key=lambda m: (5 - int(m) % 6, m))
    flat = ["top", *order]
    assert len(items) == 601 // 6
    assert items[0]["discussion"] == "\n".join(f"t{m}" for m in flat[:6])
    assert items[99]["discussion"] == "\n".join(f"t{m}" for m in flat[594:600])


def test_label_follows_replies_and_not_depth(spark):
    rows = [
        ("c", "m1", "m0", False), ("c", "m2", "m0", False), ("c", "m0", None, False), ("c", "a", "m1", True),
        ("d", "m2", None, False), ("c", "b", None, True), ("c", "b2", "b", True), ("c", "e", "gone", None), (None, "n", None, False),
        (None, "o", "n", True), ("c", "m1", "m0", False),
    ]
    df = spark.createDataFrame([(c, m, p, 0, mod, "", 0) for c, m, p, mod in rows], SCHEMA)
    got = sorted((r["conv_id"] or "", r["message_id"], r["should_intervene"]) for r in intervention_by_reply(df).collect()
                 if not r["is_moderator"])
    assert got == [("", "n", 1.0), ("c", "e", 0.0), ("c", "m0", 0.0), ("c", "m1", 1.0), ("c", "m1", 1.0), ("c", "m2", 0.0),
                   ("d", "m2", 0.0)]
    assert {r["should_intervene"] for r in intervention_by_reply(df).where("is_moderator").collect()} == {None}
