"""The driver's contract, graph predicates and streams."""

from __future__ import annotations

import random

import pytest

import __spark_entry__ as entry
from ruleloom.operators import components, distances, same_generation, shortest_paths, transitive_closure
from ruleloom.queries import QUERIES
from ruleloom.streaming import session_counts, window_aggregates

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("part", range(4))
def test_queries_equal_their_sql(spark, part):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")

    def bag(columns, rows):
        at = sorted(range(len(columns)), key=lambda i: columns[i])
        plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
        return sorted(repr([plain(r[i]) for i in at]) for r in rows)

    for name in list(QUERIES)[part::4]:
        df = entry.queries()[name](spark, SF)
        cur = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(names, cur.fetchall()), name


def brute_distances(edges):
    found = {}
    below = {}
    for a, b in edges:
        below.setdefault(a, set()).add(b)
    for s in {x for e in edges for x in e}:
        layer, d, seen = {s}, 0, set()
        while layer:
            layer = {y for x in layer for y in below.get(x, ())} - seen
            d += 1
            seen |= layer
            for y in layer:
                found[s, y] = d
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_graphs_against_brute_force(spark, seed):
    r = random.Random(seed)
    edges = sorted({(a, b) for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(20)) if a != b})
    df = spark.createDataFrame(edges, "a long, b long")
    far = brute_distances(edges)
    assert {tuple(x) for x in transitive_closure(df).collect()} == set(far)
    assert {tuple(x) for x in transitive_closure(df, doubling=True).collect()} == set(far)
    assert {tuple(x) for x in distances(df).collect()} == {(a, b, d) for (a, b), d in far.items() if a != b}
    for a, b, path in shortest_paths(df).collect():
        assert (path[0], path[-1], len(path) - 1) == (a, b, far[a, b]) and all(e in edges for e in zip(path, path[1:], strict=False))
    parts = {x.col0: x.value for x in components(df).collect()}
    assert all(parts[a] == parts[b] for a, b in edges) and all(v <= k for k, v in parts.items())


def test_recursion_over_all_orders(spark, tmp_path):
    r = random.Random(3)
    edges = [(k, r.choice((k + 100, k + 61, r.randrange(60)))) for k in range(0, 200, 2)] + [(1, 3), (3, 5), (5, 1), (7, 7)]
    spark.createDataFrame(edges, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    far = brute_distances(edges)
    assert {(1, 1), (7, 7)} <= set(far) and max(far.values()) > 3
    found = entry.queries()["closure_all_orders"](spark, str(tmp_path))
    assert sorted((x.x, x.y) for x in found.collect()) == sorted(far)
    found = entry.queries()["distance_all_orders"](spark, str(tmp_path))
    assert sorted((x.x, x.y, x.d) for x in found.collect()) == sorted((a, b, d) for (a, b), d in far.items())


def long_paths(tmp_path, spark):
    """One successor a node: a cycle of 40 behind a path of 150, a path to a dead end, and distances from brute force."""
    edges = [(k, k + 1) for k in range(150)] + [(150 + k, 150 + (k + 1) % 40) for k in range(40)] + [(k, k + 3) for k in range(400, 500)] + [(900, 20), (901, 900), (902, 902)]
    spark.createDataFrame(edges, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    return brute_distances(edges)


def test_closure_of_single_successors_takes_few_rounds(spark, tmp_path, monkeypatch):
    from ruleloom.plans import fixpoint

    far, written = long_paths(tmp_path, spark), []
    assert max(far.values()) > 180
    stored = fixpoint.measured
    monkeypatch.setattr(fixpoint, "measured", lambda df, **metrics: written.append(1) or stored(df, **metrics))
    found = entry.queries()["closure_all_orders"](spark, str(tmp_path))
    assert sorted((x.x, x.y) for x in found.collect()) == sorted(far)
    assert len(written) < 20


def test_distances_of_single_successors_take_few_rounds(spark, tmp_path, monkeypatch):
    from ruleloom import Program
    from ruleloom.plans import fixpoint

    far, written = long_paths(tmp_path, spark), []
    stored = fixpoint.measured
    monkeypatch.setattr(fixpoint, "measured", lambda df, **metrics: written.append(1) or stored(df, **metrics))
    found = entry.queries()["distance_all_orders"](spark, str(tmp_path))
    assert sorted((x.x, x.y, x.d) for x in found.collect()) == sorted((a, b, d) for (a, b), d in far.items())
    assert len(written) < 20
    # two starts of a row, steps of different length
    roads = [(k, k + 1, 1 + k % 3) for k in range(30)] + [(30, 5, 2)]
    tables = {"Road": spark.createDataFrame(roads, "col0 long, col1 long, col2 long"), "Start": spark.createDataFrame([(1, 0, 9), (1, 7, 2), (2, 30, 0)], "col0 long, col1 long, col2 long")}
    text = "@Recursive(C, -1); C(s, x) Min= w :- Start(s, x, w); C(s, y) Min= w + C(s, x) :- Road(x, y, w);"
    found = sorted(tuple(x) for x in Program(text, spark, tables=tables).df("C").collect())
    monkeypatch.setattr(fixpoint, "SINGLE_STEPS", -1)
    assert found == sorted(tuple(x) for x in Program(text, spark, tables=tables).df("C").collect()) and len(found) > 50


def test_distances_of_single_successors_take_few_rounds(spark, tmp_path, monkeypatch):
    from ruleloom import Program
    from ruleloom.plans import fixpoint

    far, written = long_paths(tmp_path, spark), []
    stored = fixpoint.measured
    monkeypatch.setattr(fixpoint, "measured", lambda df, **metrics: written.append(1) or stored(df, **metrics))
    found = entry.queries()["distance_all_orders"](spark, str(tmp_path))
    assert sorted((x.x, x.y, x.d) for x in found.collect()) == sorted((a, b, d) for (a, b), d in far.items())
    assert len(written) < 20
    # two starts of a row, steps of different length
    roads = [(k, k + 1, 1 + k % 3) for k in range(30)] + [(30, 5, 2)]
    tables = {"Road": spark.createDataFrame(roads, "col0 long, col1 long, col2 long"), "Start": spark.createDataFrame([(1, 0, 9), (1, 7, 2), (2, 30, 0)], "col0 long, col1 long, col2 long")}
    text = "@Recursive(C, -1); C(s, x) Min= w :- Start(s, x, w); C(s, y) Min= w + C(s, x) :- Road(x, y, w);"
    found = sorted(tuple(x) for x in Program(text, spark, tables=tables).df("C").collect())
    monkeypatch.setattr(fixpoint, "SINGLE_STEPS", -1)
    assert found == sorted(tuple(x) for x in Program(text, spark, tables=tables).df("C").collect()) and len(found) > 50


@pytest.mark.parametrize(
    ("text", "improving"),
    [
        ("@Recursive(C, -1); C(x) Min= w :- Start(x, w); C(y) Min= C(x) + w :- Road(x, y, w);", True),
        ("@Recursive(C, -1); C(x:, cost? Min= w) distinct :- Start(x, w); C(x: y, cost? Min= Greatest(c, w)) distinct :- C(x:, cost: c), Road(x, y, w);", True),
        ("@Recursive(C, -1); C(x) Max= w :- Start(x, w); C(y) Max= v - w :- v == C(x), Road(x, y, w);", False),
        ("@Recursive(C, -1); C(x) Max= w :- Start(x, w); C(y) Max= C(x) + w :- Road(x, y, w), x < y;", True),
        ("@Recursive(C, -1); C(x) Min= w :- Start(x, w); C(y) Min= v + w :- v == C(x), Road(x, y, w), v < 12;", False),
        ("@Recursive(C, 2); C(x) Min= w :- Start(x, w); C(y) Min= C(x) + w :- Road(x, y, w);", True),
        ("@Recursive(C, -1); C(x) Min= w :- Start(x, w); C(y) Min= C(x) + w :- Road(x, y, w); C(z) Min= C(x) + C(y) :- Road(x, y, w), Road(y, z, v);", True),
    ],
)
def test_improved_rows_alone_give_what_sweeps_give(spark, monkeypatch, text, improving):
    from ruleloom import Program
    from ruleloom.plans import fixpoint

    r = random.Random(8)
    roads = sorted({(r.randrange(12), r.randrange(12)) for _ in range(26)})
    tables = {
        "Road": spark.createDataFrame([(a, b, 1 + (5 * a + 3 * b) % 7) for a, b in roads], "col0 long, col1 long, col2 long"),
        "Start": spark.createDataFrame([(0, 3), (5, 9), (0, 8)], "col0 long, col1 long"),
    }
    rules, taken = fixpoint.improving_rules, []

    def rows():
        return sorted(tuple(x) for x in Program(text, spark, tables=tables).df("C").collect())

    monkeypatch.setattr(fixpoint, "improving_rules", lambda program, name: taken.append(rules(program, name)) or taken[-1])
    found = rows()
    assert [t is not None for t in taken] == [improving] and len(found) > 2
    monkeypatch.setattr(fixpoint, "improving_rules", lambda program, name: None)
    assert rows() == found


def test_same_generation(spark):
    parents = [(1, 0), (2, 0), (3, 1), (4, 1), (5, 2)]
    found = {tuple(x) for x in same_generation(spark.createDataFrame(parents, "x long, p long")).collect()}
    assert found == {(a, b) for g in ([1, 2], [3, 4, 5]) for a in g for b in g}


@pytest.mark.parametrize("two_parents", [False, True])
def test_same_generation_writes_classes_not_pairs(spark, monkeypatch, two_parents):
    from ruleloom.plans import fixpoint

    # two trees, one of them below a cycle, a node whose parent isn't known, one that isn't known itself
    parents = [(x, (x - 1) // 3) for x in range(1, 60)] + [(100, 101), (101, 102), (102, 100)] + [(103 + k, 100 + k // 2) for k in range(12)] + [(200, None), (None, 3), (201, 202), (203, 202)]
    parents += [(7, 5)] if two_parents else []
    below = {}
    for x, p in parents:
        below.setdefault(p, set()).add(x)
    found = waiting = {(x, y) for p, xs in below.items() if p is not None for x in xs for y in xs}
    while waiting:
        waiting = {(x, y) for a, b in waiting if a is not None and b is not None for x in below.get(a, ()) for y in below.get(b, ())} - found
        found = found | waiting
    written, stored = [], fixpoint.stored
    monkeypatch.setattr(fixpoint, "measured", lambda df, **metrics: (lambda out: (out, out.agg(*[c.alias(n) for n, c in metrics.items()]).collect()[0].asDict()))(written.append(stored(df)) or written[-1]))
    sizes, discard = [], fixpoint.discard
    monkeypatch.setattr(fixpoint, "discard", lambda df: sizes.append(df.count()) or discard(df))
    made = same_generation(spark.createDataFrame(parents, "x long, p long"))
    rows = [tuple(x) for x in made.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == found
    assert two_parents or sizes and max(sizes) <= len(parents)
    assert two_parents != any(c == "·class" for w in written for c in w.columns)


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "a", "2024-01-01 00:00:10"), (2, "a", "2024-01-01 00:00:50"), (3, "b", "2024-01-01 00:05:00")], "id long, k string, at string").selectExpr("id", "k", "cast(at as timestamp) as at")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")

    def rows(df, name):
        df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
        return spark.table(name).collect()

    counted = rows(window_aggregates(stream, "at", "1 minute", "10 seconds", ["k"], {"n": "count(1)"}), "windows")
    assert sorted((r.k, r.n) for r in counted) == [("a", 2), ("b", 1)]
    assert sorted(r.events for r in rows(session_counts(stream, "at", "1 minute", "10 seconds", ["k"]), "sessions")) == [1, 2]
    from ruleloom import Program

    rule = Program("Out(id:) :- events(id:, k: \"a\");", spark, tables={"events": stream}).df("Out")
    assert rule.isStreaming
