"""Which table feeds which job, and which view reads which table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspark.session import shared_folder, written


def _id(kind: str, *parts: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *[F.col(p) for p in parts])


def _links(connections: DataFrame, jobs: DataFrame, views: DataFrame) -> DataFrame:
    """Every use of a table by a job or view: ``(connection, table, user, reads)``.

    A table without a name or on an unknown connection is left out. All uses go through one semi join,
    where a connection that holds most of the tables can be split.
    """
    job, view = _id("sync", "name"), _id("projection", "name")
    read = jobs.select("source_connection", "source_name", job, F.lit(True))
    write = jobs.select("target_connection", "target_name", job, F.lit(False))
    shown = views.select(F.explode("sources").alias("s"), view.alias("user")).select(
        "s.connection", "s.table", "user", F.lit(True)
    )
    uses = read.union(write).union(shown).toDF("connection", "table", "user", "reads")
    known = connections.select(F.col("name").alias("connection"))
    return uses.where(F.length("table") > 0).join(known, "connection", "left_semi")


def lineage_edges(connections: DataFrame, jobs: DataFrame, views: DataFrame) -> DataFrame:
    """Edges ``(src, dst)``: table to job, job to table, table to view.

    ``jobs`` has ``name, source_connection, source_name, target_connection, target_name``; ``views``
    has ``name`` and ``sources``, an array of ``(connection, table)``. A table without a name or on a
    connection that is not in ``connections(name)`` gives no edge.
    """
    table = _id("table", "connection", "table")
    return _links(connections, jobs, views).select(
        F.when(F.col("reads"), table).otherwise(F.col("user")).alias("src"),
        F.when(F.col("reads"), F.col("user")).otherwise(table).alias("dst"),
    )


def lineage_nodes(
    connections: DataFrame, jobs: DataFrame, views: DataFrame, status: DataFrame | None = None
) -> DataFrame:
    """Every job, view and connected table once: ``(node, kind, name, connection, alive, phase)``.

    ``connection`` is set for tables; ``alive`` and ``phase`` for jobs that ``status`` (see
    :func:`tierspark.operators.status.job_status`) knows.
    """
    no_text, no_flag = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    tables = _links(connections, jobs, views).select("connection", "table").distinct()
    work = jobs.select("name")
    if status is None:
        work = work.select("name", no_flag.alias("alive"), no_text.alias("phase"))
    else:
        work = work.join(status.select(F.col("job").alias("name"), "alive", "phase"), "name", "left")
    return (
        tables.select(
            _id("table", "connection", "table").alias("node"),
            F.lit("table").alias("kind"),
            F.col("table").alias("name"),
            "connection",
            no_flag.alias("alive"),
            no_text.alias("phase"),
        )
        .union(work.select(_id("sync", "name"), F.lit("sync"), "name", no_text, "alive", "phase"))
        .union(views.select(_id("projection", "name"), F.lit("projection"), "name", no_text, no_flag, no_text))
    )


def lineage_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The length of the longest path that leads to each node: ``(node, layer)``.

    Nodes are peeled off: each round takes those without open predecessors and lowers the count of open
    predecessors of what follows them, so every edge is used once and there are as many rounds as layers.
    A round is written as a table of the counts it changed, which keeps the plan short and shows the
    optimizer the size of the next join. Nodes that are left over stand on or behind a cycle; that
    raises, naming some. Edges from unknown nodes, and NULLs, are left out.
    """
    spark = nodes.sparkSession
    folder = shared_folder(spark, "lineage")
    nodes = nodes.select("node").where("node IS NOT NULL")
    known = edges.select("src", "dst").where("dst IS NOT NULL").join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    edges = written(known, f"{folder}/edges")

    def counted(rows: DataFrame, layer: int) -> DataFrame:
        path = f"{folder}/rounds/{layer}"
        rounds.append(path)
        return written(rows.select("node", "open", F.lit(layer).cast("bigint").alias("layer")), path)

    rounds: list[str] = []
    named = nodes.select("node", F.lit(0).cast("bigint").alias("n"))
    led_to = edges.select(F.col("dst").alias("node"), F.lit(1).cast("bigint").alias("n"))
    changed = counted(named.union(led_to).groupBy("node").agg(F.sum("n").alias("open")), 0)
    kind = changed.schema
    while not (frontier := changed.where("open = 0")).isEmpty():
        used = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi")
        less = used.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        before = spark.read.schema(kind).parquet(*rounds).select("node", "open")
        changed = counted(less.join(before, "node").groupBy("node").agg((F.min("open") - F.max("n")).alias("open")), len(rounds))
    last = spark.read.schema(kind).parquet(*rounds)
    taken = last.where("open = 0").select("node", "layer")
    left = last.where("layer = 0").join(taken, "node", "left_anti").select("node").limit(5).collect()
    if left:
        raise ValueError(f"lineage has a cycle; among the nodes on or behind it: {sorted(str(r.node) for r in left)}")
    return taken


def _closure(edges: DataFrame, focus: str, source: str, target: str, folder: str) -> list[str]:
    """Folders of the nodes reached from ``focus`` along ``source`` to ``target``, one per round."""
    spark = edges.sparkSession
    seed = spark.range(1).select(F.lit(focus).alias("node"))
    frontier = written(seed, f"{folder}/0")
    rounds = [f"{folder}/0"]
    while not frontier.isEmpty():
        visited = spark.read.schema(frontier.schema).parquet(*rounds)
        path = f"{folder}/{len(rounds)}"
        reached = edges.join(frontier.select(F.col("node").alias(source)), source, "left_semi")
        fresh = reached.select(F.col(target).alias("node")).distinct().join(visited, "node", "left_anti")
        frontier = written(fresh, path)
        rounds.append(path)
    return rounds


def lineage_subgraph(layers: DataFrame, edges: DataFrame, focus: str) -> tuple[DataFrame, DataFrame]:
    """Everything up- and downstream of ``focus``: nodes with layers from 0, and the edges among them.

    ``layers`` is ``(node, layer)``; both results are empty if it has no such node.
    """
    spark = edges.sparkSession
    folder = shared_folder(spark, "subgraph")
    edges = written(edges.select("src", "dst"), f"{folder}/edges")
    rounds = _closure(edges, focus, "dst", "src", f"{folder}/up") + _closure(edges, focus, "src", "dst", f"{folder}/down")
    included = written(spark.read.parquet(*rounds).distinct(), f"{folder}/included")
    inside = layers.join(included, "node", "left_semi")
    known = not layers.where(F.col("node") == focus).isEmpty()
    first = inside.agg(F.min("layer")).first()[0] if known else None
    nodes = inside.where(F.lit(known)).select("node", (F.col("layer") - F.lit(first)).cast("bigint").alias("layer"))
    among = (
        edges.join(included.select(F.col("node").alias("src")), "src", "left_semi")
        .join(included.select(F.col("node").alias("dst")), "dst", "left_semi")
        .where(F.lit(known))
        .select("src", "dst")
    )
    return nodes, among
