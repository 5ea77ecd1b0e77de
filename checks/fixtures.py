"""Inputs for the registered queries, derived from the given tables by Spark.

Every fixture covers the whole table: remainders of ``event_id`` only choose *how* a row is turned
into a message, never *whether* it is.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspark.operators.mapping import Mapping
from tierspark.plans.tiers import Tier
from tierspark.session import configure, shared_folder
from tierspark.sources.stores import read_lake
from tierspark.streaming.lake import write_batch

NOW = datetime(2024, 1, 31)

# Offset of a message that is sent a second time.
RESENT = 1_000_000_000_000

MAPPING = Mapping(
    "event_id",
    [
        ("$.event_id", "event_id", "bigint"),
        ("$.user_id", "user_id", "bigint"),
        ("$.event_type", "event_type", "text"),
        ("$.value", "value", "double"),
        ("$.ts", "occurred_at", "timestamptz"),
        ("$.props.k", "k", "int"),
        ("$.props", "props", "json"),
    ],
)

EVENT_MAPPING = Mapping(
    "event_id",
    [
        ("event_id", "event_id", "bigint"),
        ("user_id", "user_id", "bigint"),
        ("event_type", "event_type", "text"),
        ("value", "value", "double"),
        ("ts", "ts", "timestamptz"),
    ],
)

EVENT_COLUMNS = ["event_id", "user_id", "event_type", "value", "ts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


VIEW = [("event_id", "id"), "user_id", ("event_type", "kind"), "value", ("ts", "occurred_at")]


def two_tiers(spark: SparkSession, sf_dir: str) -> list[Tier]:
    rows = events(spark, sf_dir)
    return [
        Tier("history", rows, VIEW, "ts", min_age="7d"),
        Tier("recent", rows, VIEW, "ts", max_age="168h"),
    ]


def three_tiers(spark: SparkSession, sf_dir: str) -> list[Tier]:
    rows = events(spark, sf_dir)
    return [
        Tier("cold", rows, VIEW, "ts", min_age="14d"),
        Tier("hot", rows, VIEW, "ts", max_age="7d"),
        Tier("warm", rows, VIEW, "ts", min_age="7d", max_age="336h"),
    ]


def tiers_of_a_lake(spark: SparkSession, sf_dir: str, untimed: bool = False) -> list[Tier]:
    """The three tiers over events that lie in a lake by days."""
    lake = f"{shared_folder(spark, 'lake')}/events"
    write_batch(untimed_events(spark, sf_dir) if untimed else events(spark, sf_dir), lake, "given", 0, "ts")
    rows = read_lake(spark, lake)
    return [replace(tier, rows=rows, day="day", lake=lake) for tier in three_tiers(spark, sf_dir)]


def untimed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which one in 101 has lost its time."""
    return events(spark, sf_dir).withColumn("ts", F.when(F.col("event_id") % 101 != 0, F.col("ts")))


def differing_tiers(spark: SparkSession, sf_dir: str) -> list[Tier]:
    """Two tables that both hold all events: the recent one has other column names, and 1000 more in each value.

    One event in 101 has no time, one in 103 lies exactly on the border, one in 107 in the future.
    """
    n, stamp = F.col("event_id"), lambda text: F.lit(text).cast("timestamp_ntz")
    moved = F.when(n % 101 == 0, F.col("ts")).when(n % 103 == 0, stamp("2024-01-24 00:00:00"))
    ts = moved.when(n % 107 == 0, stamp("2024-03-01 00:00:00")).otherwise(F.col("ts"))
    rows = untimed_events(spark, sf_dir).withColumn("ts", ts)
    recent = rows.select(
        n.alias("number"), F.col("user_id").alias("who"), F.col("event_type").alias("what"),
        (F.col("value") + 1000).alias("amount"), F.col("ts").alias("at"),
    )
    names = [("number", "id"), ("who", "user_id"), ("what", "kind"), ("amount", "value"), ("at", "occurred_at")]
    return [
        Tier("history", rows, VIEW, "ts", min_age="7d"),
        Tier("recent", recent, names, "at", max_age="7d"),
    ]


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores. The given table is one file with one row group, hence one task; a topic comes in many."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def rfc3339(ts: str) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a JSON message, purchases twice; some are damaged, the first matching rule applies."""
    e = spread(events(spark, sf_dir))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    again = F.when(F.col("event_type") == "purchase", F.array(zero, one)).otherwise(F.array(zero))
    sent = e.select("*", F.explode(again).alias("again")).withColumn("value", F.col("value") + F.col("again"))
    n = F.col("event_id")
    by = lambda k: n % k == 0
    first = F.when(by(97), 97).when(by(89), 89).when(by(83), 83).when(by(79), 79).when(by(73), 73)
    rule = first.when(by(71), 71).when(by(67), 67).when(by(61), 61).when(by(59), 59).otherwise(0)
    ruled = sent.withColumn("rule", rule).withColumn("time", rfc3339("ts"))
    is_rule = lambda k: F.col("rule") == k
    body = F.concat(
        F.lit('{"event_id":'),
        n.cast("string"),
        F.when(is_rule(89), F.lit(""))
        .when(is_rule(83), F.concat(F.lit(',"user_id":"'), F.col("user_id").cast("string"), F.lit('"')))
        .otherwise(F.concat(F.lit(',"user_id":'), F.col("user_id").cast("string"))),
        F.when(is_rule(73), F.lit(',"event_type":null')).otherwise(
            F.concat(F.lit(',"event_type":"'), F.col("event_type"), F.lit('"'))
        ),
        F.when(is_rule(79), F.concat(F.lit(',"value":"'), F.col("value").cast("string"), F.lit('"'))).otherwise(
            F.concat(F.lit(',"value":'), F.col("value").cast("string"))
        ),
        F.lit(',"ts":"'),
        F.when(is_rule(71), F.regexp_replace("time", "Z$", "")).otherwise(F.col("time")),
        F.lit('","props":'),
        F.col("props"),
        F.lit("}"),
    )
    text = F.col("body")
    payload = (
        F.when(is_rule(97), F.substring(text, F.lit(1), F.length(text) - 5).cast("binary"))
        .when(is_rule(67), F.concat(text, F.lit(" x")).cast("binary"))
        .when(is_rule(61), F.lit("").cast("binary"))
        .when(
            is_rule(59),
            F.concat(F.lit('{"bytes":"').cast("binary"), F.unhex(F.lit("FF")), F.concat(F.lit('",'), F.substring(text, F.lit(2), F.length(text))).cast("binary")),
        )
        .otherwise(text.cast("binary"))
    )
    return ruled.withColumn("body", body).select(
        payload.alias("value"),
        (n % 4).cast("int").alias("partition"),
        (n + F.col("again") * RESENT).alias("offset"),
    )


def message_folder(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The messages as files for the file stream, and the folder of this run."""
    folder = shared_folder(spark, "topic")
    messages(spark, sf_dir).write.parquet(f"{folder}/messages")
    return folder, f"{folder}/messages"


def documents(spark: SparkSession, sf_dir: str, forms: list[F.Column]) -> DataFrame:
    """``(event_id, value)``: one document per event whose field ``v`` takes the forms in turn."""
    e = spread(events(spark, sf_dir))
    n = len(forms)
    chosen = F.when(F.col("event_id") % n == 0, forms[0])
    for i, form in enumerate(forms[1:], start=1):
        chosen = chosen.when(F.col("event_id") % n == i, form)
    return e.select("event_id", F.concat(F.lit('{"v":'), chosen, F.lit("}")).alias("value"))


def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table that holds everything up to the 24th, with a column no message sets."""
    return (
        events(spark, sf_dir)
        .where(F.col("ts") <= F.lit("2024-01-24 00:00:00").cast("timestamp_ntz"))
        .select(*EVENT_COLUMNS, F.col("ts").alias("synced_at"))
    )


def resent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything after the 17th, twice: as it was and then with a corrected value."""
    late = events(spark, sf_dir).where(F.col("ts") > F.lit("2024-01-17 00:00:00").cast("timestamp_ntz"))
    first = late.select(*EVENT_COLUMNS, F.lit(1).alias("sent"))
    second = late.select(*EVENT_COLUMNS, F.lit(2).alias("sent")).withColumn("value", F.col("value") + 1)
    return first.unionByName(second)


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change feed with one version per day.

    Each event is inserted on its day. A purchase is updated a day later; an error is deleted two days
    later; a signup is deleted a day later and comes back the day after; a view is replaced (deleted
    and inserted in one commit) a day later.
    """
    e = events(spark, sf_dir).select(
        *EVENT_COLUMNS, F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("bigint").alias("day")
    )

    def step(kind: str | None, change: str, days: int, added: int) -> F.Column:
        entry = F.struct(F.lit(change).alias("change"), F.lit(days).alias("days"), F.lit(added).alias("added"))
        return entry if kind is None else F.when(F.col("event_type") == kind, entry)

    steps = F.array_compact(
        F.array(
            step(None, "insert", 0, 0),
            step("purchase", "update_preimage", 1, 0),
            step("purchase", "update_postimage", 1, 1),
            step("error", "delete", 2, 0),
            step("signup", "delete", 1, 0),
            step("signup", "insert", 2, 2),
            step("view", "delete", 1, 0),
            step("view", "insert", 1, 3),
        )
    )
    return e.select("*", F.explode(steps).alias("s")).select(
        "event_id",
        "user_id",
        "event_type",
        (F.col("value") + F.col("s.added")).alias("value"),
        "ts",
        F.col("s.change").alias("_change_type"),
        (F.col("day") + F.col("s.days")).alias("_commit_version"),
    )


def twice_written(feed: DataFrame) -> DataFrame:
    """The feed with each change twice, the later one first in the file and with a value of 7 more."""
    twice = feed.select("*", F.explode(F.array(F.lit(1), F.lit(0))).alias("_position"))
    return twice.withColumn("value", F.col("value") + F.col("_position") * 7)


def early_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyed table that was filled before the change feed is applied."""
    return (
        events(spark, sf_dir)
        .where(F.col("ts") <= F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
        .select(*EVENT_COLUMNS, F.col("ts").alias("synced_at"))
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats: each user is a job, each event a report; error events are fatal error reports."""
    failed = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.col("user_id").alias("job"),
        F.col("ts").alias("at"),
        F.when(failed, F.lit("error")).otherwise(F.lit("beat")).alias("kind"),
        F.when(~failed, F.col("event_type")).alias("phase"),
        F.lit(0).cast("bigint").alias("lag"),
        F.when(~failed, F.col("event_id").cast("string")).alias("watermark"),
        F.when(failed, F.col("props")).alias("message"),
        failed.alias("fatal"),
    )


def lineage_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Connections, jobs and views.

    Each region is a connection. Each customer is a job from its nation's table to a table of its own;
    those with a negative balance write to a connection nobody declared. Each order is a view of its
    customer's table and of one on an unknown connection.
    """
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("R"), F.col("n_regionkey")).alias("connection")
    )
    connections = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("name"))
    customers = table(spark, sf_dir, "customer").join(nation, "c_nationkey").select(
        "c_custkey", "c_nationkey", "connection", (F.col("c_acctbal") < 0).alias("stray")
    )
    own = F.concat(F.lit("C"), F.col("c_custkey"))
    jobs = customers.select(
        own.alias("name"),
        F.col("connection").alias("source_connection"),
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("source_name"),
        F.when(F.col("stray"), F.lit("elsewhere")).otherwise(F.col("connection")).alias("target_connection"),
        own.alias("target_name"),
    )
    views = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
        .join(customers, "c_custkey")
        .select(
            F.concat(F.lit("O"), F.col("o_orderkey")).alias("name"),
            F.array(
                F.struct(F.col("connection"), own.alias("table")),
                F.struct(F.lit("unknown").alias("connection"), F.col("o_orderpriority").alias("table")),
            ).alias("sources"),
        )
    )
    return connections, jobs, views
