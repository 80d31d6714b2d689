"""Cart events against a step-by-step fold of the shop's rules."""

import datetime as dt
import random

import pytest

from marketgrid.operators import cart as C

EVENTS = "event_id long, ts timestamp_ntz, cart_id string, product_id string, action string, quantity int"
START = "cart_id string, product_id string, quantity int"
PRODUCT = "product_id string, stock int, status string, vendor_id string"
VENDOR = "vendor_id string, status string"
PRODUCTS = [("p1", 5, "Active", "v1"), ("p2", 0, "OutOfStock", "v1"), ("p3", 9, "Inactive", "v1"), ("p4", 7, "Active", "v2"),
            ("p5", 3, "OutOfStock", "v1"), ("p6", 40, "Active", "v1")]
VENDORS = [("v1", "Active"), ("v2", "Inactive")]


def fold(events, start):
    stock = {p: (s, st) for p, s, st, v in PRODUCTS if st != "Inactive" and dict(VENDORS)[v] == "Active"}
    q, after = {(c, p): n for c, p, n in start}, {}
    for eid, _, c, p, action, n in sorted(events, key=lambda e: (e[1], e[0])):
        have, (s, status) = q.get((c, p), 0), stock.get(p, (None, None))
        if action == "remove":
            have = 0
        elif action == "add" and status == "Active":
            have = max(0, min(s, have + (1 if n is None else n)))
        elif action == "increase" and s is not None and have > 0:
            have = have + 1 if have + 1 <= s else have
        elif action == "decrease" and s is not None and have > 0:
            have -= 1
        q[(c, p)] = have
        after[eid] = have
    return after, {k: v for k, v in q.items() if v > 0}


def run(spark, events, start, rows):
    frames = (spark.createDataFrame(events, EVENTS), spark.createDataFrame(start, START),
              spark.createDataFrame(PRODUCTS, PRODUCT), spark.createDataFrame(VENDORS, VENDOR))
    history = C.cart_history(*frames, rows=rows)
    got = {r.event_id: r.quantity for r in history.collect()}
    state = {(r.cart_id, r.product_id): r.quantity for r in C.cart_state(frames[1], history).collect()}
    return got, state


def sample(seed, n, hot=0.0, actions=("add", "increase", "decrease", "decrease", "increase", "remove", "other")):
    rng, t0 = random.Random(seed), dt.datetime(2024, 1, 1)
    out = []
    for k in range(n):
        cart, product = ("c0", "p6") if rng.random() < hot else (f"c{rng.randint(0, 4)}", f"p{rng.randint(1, 7)}")
        action = rng.choice(actions)
        n_ = rng.choice([None, -3, -1, 0, 1, 2, 60]) if action == "add" else None
        out.append((k, t0 + dt.timedelta(seconds=rng.randint(0, n)), cart, product, action, n_))
    return out


@pytest.mark.parametrize("rows", [6, 70, 1_000_000])
def test_equals_fold(spark, rows):
    events = sample(rows, 600)
    start = [(f"c{c}", f"p{p}", 1 + (7 * c + 5 * p) % 13) for c in range(5) for p in range(1, 7) if (c + p) % 3]
    assert run(spark, events, start, rows) == fold(events, start)


def test_hot_line_is_spread(spark):
    """One line has most events; it starts far above a stock that has fallen."""
    events = sample(2, 1500, hot=0.8, actions=("increase", "decrease", "decrease"))
    start = [("c0", "p6", 300), ("c1", "p1", 4)]
    assert run(spark, events, start, rows=50) == fold(events, start)


def test_line_above_a_fallen_stock(spark):
    t0 = dt.datetime(2024, 1, 1)
    moves = [("increase", None), ("decrease", None), ("decrease", None), ("increase", None), ("increase", None),
             ("decrease", None), ("decrease", None), ("add", -9), ("increase", None), ("add", 2)]
    events = [(k, t0 + dt.timedelta(minutes=k), "c", "p1", a, n) for k, (a, n) in enumerate(moves)]
    got, state = run(spark, events, [("c", "p1", 7)], rows=3)
    assert [got[k] for k in range(len(moves))] == [7, 6, 5, 5, 5, 4, 3, 0, 0, 2] and state == {("c", "p1"): 2}
    got, state = run(spark, [(0, t0, "c", "p1", "add", 1)], [("c", "p1", 7), ("d", "p9", 2)], rows=3)
    assert got == {0: 5} and state == {("c", "p1"): 5, ("d", "p9"): 2}
    assert run(spark, [(0, t0, "c", "p3", "remove", None)], [("c", "p3", 4)], rows=3) == ({0: 0}, {})


def test_no_events(spark):
    assert run(spark, [], [("c", "p1", 9)], rows=3) == ({}, {("c", "p1"): 9})
