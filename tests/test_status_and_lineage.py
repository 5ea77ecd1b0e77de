import random
from datetime import datetime, timedelta

import pytest

from tierspark.operators.lineage import lineage_edges, lineage_layers, lineage_nodes, lineage_subgraph
from tierspark.operators.retention import prune, pruned_count
from tierspark.operators.status import job_status
from tierspark.streaming.progress import REPORT_SCHEMA

NOW = datetime(2024, 1, 31)


def at(seconds):
    return NOW - timedelta(seconds=seconds)


def test_job_status(spark):
    beat = lambda job, s, phase, mark="": (job, at(s), "beat", phase, 0, mark, None, False)
    error = lambda job, s, text, fatal: (job, at(s), "error", None, None, None, text, fatal)
    reports = spark.createDataFrame(
        [
            beat("alive", 29.5, "running", "7"), beat("alive", 50, "starting", "6"), error("alive", 40, "blip", False),
            beat("late", 30, "running"),
            beat("dead", 60, "running"), error("dead", 10, "gone", True),
            beat("back", 5, "running"), error("back", 10, "gone", True),
            error("never", 10, "no start", True), error("warned", 10, "hm", False),
            beat("unwanted", 1, "running"),
        ],
        REPORT_SCHEMA,
    ).withColumn("at", __import__("pyspark.sql.functions", fromlist=["col"]).col("at").cast("timestamp_ntz"))
    jobs = spark.createDataFrame([(j,) for j in ("alive", "late", "dead", "back", "never", "warned", "absent")], "job string")
    got = {r.job: (r.phase, r.last_beat_at, r.watermark, r.last_error, r.alive) for r in job_status(jobs, reports, NOW).collect()}
    assert got == {
        "alive": ("running", at(30), "7", "blip", True),
        "late": ("running", at(30), "", None, False),
        "dead": ("error", at(60), "", "gone", False),
        "back": ("running", at(5), "", "gone", True),
        "never": ("error", None, None, "no start", False),
        "warned": ("", None, None, "hm", False),
        "absent": ("Missing", None, None, None, False),
    }


def test_retention(spark):
    rows = spark.createDataFrame([(1, at(0)), (2, at(86400)), (3, at(86401)), (4, None)], "id int, ts timestamp_ntz")
    assert sorted(r.id for r in prune(rows, "ts", 1, NOW).collect()) == [1, 2, 4]
    assert pruned_count(rows, "ts", 1, NOW).first().pruned == 1
    with pytest.raises(ValueError):
        prune(rows, "ts", 0, NOW)


def test_edges_and_nodes(spark):
    connections = spark.createDataFrame([("pg",), ("lake",)], "name string")
    jobs = spark.createDataFrame(
        [("s1", "kafka", "t", "pg", "events"), ("s2", "lake", "raw", "pg", "events"), ("s3", "lake", "", "nope", "x")],
        "name string, source_connection string, source_name string, target_connection string, target_name string",
    )
    views = spark.createDataFrame(
        [("v1", [("pg", "events"), ("lake", "raw")]), ("v2", [("nope", "y")]), ("v3", [])],
        "name string, sources array<struct<connection:string,table:string>>",
    )
    edges = lineage_edges(connections, jobs, views)
    assert sorted(map(tuple, edges.collect())) == [
        ("sync:s1", "table:pg:events"),
        ("sync:s2", "table:pg:events"),
        ("table:lake:raw", "projection:v1"),
        ("table:lake:raw", "sync:s2"),
        ("table:pg:events", "projection:v1"),
    ]
    nodes = lineage_nodes(connections, jobs, views)
    assert sorted(r.node for r in nodes.collect()) == [
        "projection:v1", "projection:v2", "projection:v3", "sync:s1", "sync:s2", "sync:s3",
        "table:lake:raw", "table:pg:events",
    ]
    status = spark.createDataFrame([("s1", True, "running"), ("gone", False, "error")], "job string, alive boolean, phase string")
    known = {r.node: tuple(r)[1:] for r in lineage_nodes(connections, jobs, views, status).collect()}
    assert known["sync:s1"] == ("sync", "s1", None, True, "running")
    assert known["sync:s2"] == ("sync", "s2", None, None, None)
    assert known["table:lake:raw"] == ("table", "raw", "lake", None, None) and len(known) == 8
    layers = {r.node: r.layer for r in lineage_layers(nodes, edges).collect()}
    assert layers["projection:v1"] == 3 and layers["sync:s3"] == layers["sync:s1"] == layers["projection:v3"] == 0
    around, among = lineage_subgraph(lineage_layers(nodes, edges), edges, "sync:s1")
    assert {r.node: r.layer for r in around.collect()} == {"sync:s1": 0, "table:pg:events": 2, "projection:v1": 3}
    assert among.count() == 2


def graph(spark, pairs, names):
    edges = spark.createDataFrame(pairs, "src string, dst string")
    return spark.createDataFrame([(n,) for n in names], "node string"), edges


def test_random_graph(spark):
    r = random.Random(3)
    names = [f"n{i}" for i in range(60)]
    # n0 has a third of all edges.
    pairs = {tuple(sorted(r.sample(range(60), 2))) for _ in range(60)} | {(0, i) for i in range(5, 35)}
    layer = {i: 0 for i in range(60)}
    for i in range(60):
        layer[i] = max((layer[a] + 1 for a, b in pairs if b == i), default=0)
    nodes, edges = graph(spark, [(f"n{a}", f"n{b}") for a, b in pairs], names)
    layers = lineage_layers(nodes, edges)
    assert {r.node: r.layer for r in layers.collect()} == {f"n{i}": d for i, d in layer.items()}

    def reach(start, forward):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for a, b in pairs:
                u, w = (a, b) if forward else (b, a)
                if u == x and w not in seen:
                    seen.add(w)
                    todo.append(w)
        return seen

    inside = reach(20, True) | reach(20, False)
    around, among = lineage_subgraph(layers, edges, "n20")
    low = min(layer[i] for i in inside)
    assert {r.node: r.layer for r in around.collect()} == {f"n{i}": layer[i] - low for i in inside}
    assert sorted(map(tuple, among.collect())) == sorted((f"n{a}", f"n{b}") for a, b in pairs if {a, b} <= inside)


@pytest.mark.parametrize("pairs", [[("a", "b"), ("b", "a")], [("x", "a"), ("a", "b"), ("b", "a")]])
def test_cycles_are_refused(spark, pairs):
    with pytest.raises(ValueError, match="cycle"):
        lineage_layers(*graph(spark, pairs, ["a", "b", "x"]))


def test_a_cycle_in_a_large_graph_is_named_at_once(spark):
    pairs = [(f"a{i}", f"b{i}") for i in range(5000)] + [("b0", "a0"), ("b0", "tail"), ("nobody", "a1"), ("a2", None)]
    names = [f"{side}{i}" for side in "ab" for i in range(5000)] + [None]
    with pytest.raises(ValueError, match=r"\['a0', 'b0', 'tail'\]"):
        lineage_layers(*graph(spark, pairs, names))
    layers = lineage_layers(*graph(spark, [*pairs[1:5000], *pairs[5002:], pairs[1]], names))
    assert {(r.layer, r["count"]) for r in layers.groupBy("layer").count().collect()} == {(0, 5001), (1, 4999)}


def test_unknown_focus(spark):
    nodes, edges = graph(spark, [("a", "b")], ["a", "b"])
    around, among = lineage_subgraph(lineage_layers(nodes, edges), edges, "zzz")
    assert around.count() == among.count() == 0
