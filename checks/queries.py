"""The registered queries: one per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from tierspark.functions import payloads
from tierspark.functions.display import binary_to_string
from tierspark.operators.changes import apply_changes, apply_next, change_cursor, delete_by_key, latest_per_key, upsert, upsert_batch
from tierspark.operators.lineage import lineage_edges, lineage_layers, lineage_nodes, lineage_subgraph
from tierspark.operators.mapping import accepted, map_messages, reject_counts, rejected
from tierspark.operators.ranges import read_ranges, upsert_touched, write_ranges
from tierspark.operators.retention import prune, pruned_count
from tierspark.operators.status import job_status
from tierspark.operators.views import column_view, describe_result
from tierspark.plans.named import create_view_function
from tierspark.plans.paging import Key, page, page_summary, table_page, tiered_page
from tierspark.plans.tiers import age_window, tier_counts, tier_coverage, tiered_read, time_range
from tierspark.session import shared_folder, written
from tierspark.sources.change_feed import change_feed_range
from tierspark.sources.stores import read_lake
from tierspark.sources.topics import read_message_files
from tierspark.streaming.ingest import changes_to_table, drain, topic_to_lake, topic_to_table
from tierspark.streaming.keyed_log import compact, read_keyed
from tierspark.streaming.lake import merge_days, prune_lake, write_batch

Query = Callable[[SparkSession, str], DataFrame]


def naive(df: DataFrame) -> DataFrame:
    """Instants as UTC times without a zone, the form the comparing engine returns."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
            for f in df.schema
        ]
    )


# Tiers and pages


def q_column_view(spark, sf):
    return column_view(fx.events(spark, sf), [("props", "payload"), "event_id", ("ts", "occurred_at")])


def q_describe_columns(spark, sf):
    return describe_result(fx.events(spark, sf))


def q_binary_to_string(spark, sf):
    return binary_to_string(
        fx.events(spark, sf).select("event_id", F.col("props").cast("binary").alias("props"), "event_type")
    )


def q_time_range(spark, sf):
    return time_range(fx.events(spark, sf), "ts", datetime(2024, 1, 10), datetime(2024, 1, 24))


def q_age_window(spark, sf):
    return age_window(fx.events(spark, sf), "ts", fx.NOW, min_age="36h", max_age="7.5d")


def q_tiered_read(spark, sf):
    return tiered_read(fx.two_tiers(spark, sf), fx.NOW)


def q_tiered_read_three(spark, sf):
    return tiered_read(fx.three_tiers(spark, sf), fx.NOW)


def q_named_view(spark, sf):
    """The view by name, from SQL."""
    create_view_function(spark, "events_combined", fx.three_tiers(spark, sf))
    return spark.sql("SELECT * FROM events_combined(TIMESTAMP'2024-01-31 00:00:00Z')")


def q_tiered_read_differing(spark, sf):
    """Tiers of different tables with the same events: each row must come from the table its time belongs to."""
    return tiered_read(fx.differing_tiers(spark, sf), fx.NOW)


def q_tiered_page_differing(spark, sf):
    """A page over the border of such tiers, where many rows have the same time."""
    tiers = fx.differing_tiers(spark, sf)
    recent = tier_counts(tiers, fx.NOW).where("tier = 'recent'").first()["rows"]
    return tiered_page(tiers, fx.NOW, ["id"], limit=100, offset=recent - 50)


def q_tier_counts(spark, sf):
    return tier_counts(fx.three_tiers(spark, sf), fx.NOW)


def q_tier_counts_lake(spark, sf):
    """The same over a lake by days: whole days are counted by their files' footers."""
    fx.configure(spark)
    return tier_counts(fx.tiers_of_a_lake(spark, sf), fx.NOW)


def q_page_summary_lake(spark, sf):
    fx.configure(spark)
    return page_summary(fx.tiers_of_a_lake(spark, sf), fx.NOW, limit="501", offset="40")


def q_tier_coverage(spark, sf):
    rows = fx.untimed_events(spark, sf)
    tiers = [type(t)(t.name, rows, t.columns, t.ts, t.min_age, t.max_age) for t in fx.three_tiers(spark, sf)]
    return tier_coverage(tiers, fx.NOW)


def q_page_summary(spark, sf):
    return page_summary(fx.two_tiers(spark, sf), fx.NOW, limit="501", offset="40")


def q_table_page(spark, sf):
    return table_page(fx.events(spark, sf), ["event_id"], limit=50, offset=100)


def q_table_page_deep_dates(spark, sf):
    """A page in the middle of all orders, newest first, found by counting days."""
    orders = read_lake(spark, f"{sf}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    fx.configure(spark)
    return page(orders, [Key("day", descending=True), Key("o_orderkey")], 100, orders.count() // 2, direct_rows=1_000)


def q_lake_page(spark, sf):
    fx.configure(spark)
    lake = read_lake(spark, f"{sf}/orders.parquet")
    return table_page(lake, ["o_orderkey"], limit=25, offset=10, columns=["o_orderkey", ("o_orderdate", "day")])


def q_tiered_page(spark, sf):
    return tiered_page(fx.two_tiers(spark, sf), fx.NOW, ["id"])


def q_tiered_page_straddle(spark, sf):
    """A page whose first ten rows are the last of the recent tier."""
    tiers = fx.two_tiers(spark, sf)
    recent = tier_counts(tiers, fx.NOW).where("tier = 'recent'").first()["rows"]
    return tiered_page(tiers, fx.NOW, ["id"], limit=40, offset=recent - 10)


def q_tiered_page_past_end(spark, sf):
    """A page beyond the last row: no rows, the total intact."""
    tiers = fx.two_tiers(spark, sf)
    total = tiered_read(tiers, fx.NOW).count()
    page = tiered_page(tiers, fx.NOW, ["id"], limit=40, offset=total)
    return page_summary(tiers, fx.NOW, limit=40, offset=total).select(
        "total", F.lit(page.count()).cast("bigint").alias("rows_on_page")
    )


def q_tiered_page_deep(spark, sf):
    """A page in the middle of the view, found by counting instead of sorting."""
    tiers = fx.three_tiers(spark, sf)
    total = tiered_read(tiers, fx.NOW).count()
    return tiered_page(tiers, fx.NOW, ["id"], limit=100, offset=total // 2, direct_rows=1_000)


# Messages


def q_map_messages(spark, sf):
    mapped = map_messages(fx.messages(spark, sf), fx.MAPPING)
    return naive(accepted(mapped, fx.MAPPING)).withColumnsRenamed({"_partition": "part", "_offset": "off"})


def q_rejected_messages(spark, sf):
    bad = rejected(map_messages(fx.messages(spark, sf), fx.MAPPING))
    return bad.select(F.col("_partition").alias("part"), F.col("_offset").alias("off"), "reject_reason")


def q_reject_counts(spark, sf):
    return reject_counts(map_messages(fx.messages(spark, sf), fx.MAPPING))


def q_json_paths(spark, sf):
    e = fx.events(spark, sf)
    value = F.concat(
        F.lit('{"a":{"b":{"k":'), F.col("event_id").cast("string"),
        F.lit('},"c":null},"list":[{"b":1}],"x.y":5,"it\'s":'), F.col("user_id").cast("string"), F.lit("}"),
    )
    docs = e.select("event_id", payloads.parse_document(value).alias("doc"))
    return docs.select(
        "event_id",
        F.try_variant_get(payloads.field_at(F.col("doc"), "$.a.b.k"), "$", "bigint").alias("with_prefix"),
        F.try_variant_get(payloads.field_at(F.col("doc"), "a.b.k"), "$", "bigint").alias("without_prefix"),
        F.try_variant_get(payloads.field_at(F.col("doc"), "$.it's"), "$", "bigint").alias("quoted_key"),
        payloads.field_at(F.col("doc"), "$.a.b").isNotNull().alias("object_found"),
        payloads.field_at(F.col("doc"), "$.list.b").isNotNull().alias("through_array"),
        payloads.field_at(F.col("doc"), "$.x.y").isNotNull().alias("dotted_key"),
        payloads.field_at(F.col("doc"), "$.a.none").isNotNull().alias("missing_key"),
    )


def _coerced(declared: str, forms: Callable[[], list]) -> Query:
    def run(spark, sf):
        docs = fx.documents(spark, sf, forms())
        found = docs.select("event_id", payloads.field_at(payloads.parse_document(F.col("value")), "$.v").alias("v"))
        typed = found.select("*", payloads.kind_of(F.col("v")).alias("kind")).select(
            "event_id", payloads.coerce(F.col("v"), F.col("kind"), declared).alias("v")
        )
        return naive(typed.select("event_id", "v", F.col("v").isNotNull().alias("accepted")))

    return run


def _in_quotes(column: F.Column) -> F.Column:
    return F.concat(F.lit('"'), column, F.lit('"'))


def _user() -> F.Column:
    return F.col("user_id").cast("string")


def _int_forms() -> list:
    return [
        _user(),
        _in_quotes(_user()),
        F.concat(_user(), F.lit(".0")),
        F.lit("null"),
        F.lit("true"),
        _in_quotes(F.concat(F.lit("+"), _user())),
        _in_quotes(F.concat(F.lit(" "), _user())),
        F.lit("9223372036854775808"),
        F.concat(F.lit('{"n":'), _user(), F.lit("}")),
        (-1 - F.col("user_id")).cast("string"),
        _in_quotes(F.concat(_user(), F.lit("\\n"))),
    ]


def _float_forms() -> list:
    return [
        F.col("value").cast("string"),
        _in_quotes(F.col("value").cast("string")),
        _user(),
        F.concat(_user(), F.lit("e2")),
        F.lit("null"),
        F.lit("true"),
        F.lit("1e400"),
    ]


def _text_forms() -> list:
    return [
        _in_quotes(F.col("event_type")),
        F.lit("null"),
        _user(),
        F.concat(_user(), F.lit(".0")),
        F.concat((F.col("user_id") + 10000000).cast("string"), F.lit(".5")),
        F.concat(F.lit('{"b": '), _user(), F.lit(', "a": [1, 2]}')),
        F.lit("true"),
        F.lit('"q\\"\\u00e9"'),
        F.lit("[]"),
        F.concat(F.lit("0.0001"), _user()),
        F.concat((F.col("user_id") + 1).cast("string"), F.lit("e19")),
        F.lit('""'),
    ]


def _bool_forms() -> list:
    return [F.lit("true"), F.lit("false"), F.lit('"true"'), F.lit("1"), F.lit("null")]


def _time_forms() -> list:
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return [
        _in_quotes(fx.rfc3339("ts")),
        _in_quotes(F.lower(fx.rfc3339("ts"))),
        _in_quotes(F.concat(second, F.lit("+05:30"))),
        _in_quotes(F.date_format("ts", "yyyy-MM-dd")),
        _in_quotes(second),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"),
        _in_quotes(F.concat(second, F.lit(".123456789Z"))),
        _in_quotes(F.concat(F.lit("2024-02-30"), F.date_format("ts", "'T'HH:mm:ss'Z'"))),
        _in_quotes(F.concat(second, F.lit("-00:30"))),
    ]


# Changes


def q_latest_per_key(spark, sf):
    return latest_per_key(fx.events(spark, sf), "user_id", ["ts", "event_id"])


def q_table_page_deep_doubles(spark, sf):
    """A page in the middle of all line items, dearest first."""
    fx.configure(spark)
    items = read_lake(spark, f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    order = [Key("l_extendedprice", descending=True), Key("l_orderkey"), Key("l_linenumber")]
    return page(items, order, 100, items.count() // 2, direct_rows=1_000)


def q_upsert_merge(spark, sf):
    changes = latest_per_key(fx.resent_events(spark, sf), "event_id", ["sent"]).drop("sent")
    return upsert(fx.stored_events(spark, sf), changes, "event_id", defaults={"synced_at": F.lit("2024-01-31")})


def q_upsert_touched(spark, sf):
    """The same in a table that lies in ranges of its key; ranges without a change keep their files."""
    fx.configure(spark)
    table = f"{shared_folder(spark, 'table')}/events"
    write_ranges(fx.stored_events(spark, sf), table, "event_id", 12)
    changes = latest_per_key(fx.resent_events(spark, sf), "event_id", ["sent"]).drop("sent")
    upsert_touched(spark, table, changes, "event_id", defaults={"synced_at": F.lit("2024-01-31")})
    return read_ranges(spark, table)


def q_upsert_small_batch(spark, sf):
    """The last day sent again: few changes, looked up from the target instead of shuffling it."""
    late = fx.resent_events(spark, sf).where(F.col("ts") > F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
    changes = latest_per_key(late, "event_id", ["sent"]).drop("sent")
    target = fx.events(spark, sf).select(*fx.EVENT_COLUMNS, F.col("ts").alias("synced_at"))
    return upsert_batch(target, changes, "event_id")


def q_upsert_null_keys(spark, sf):
    """Every 101st row of the target and of the changes has lost its key: such rows stay, such changes name no row."""
    lost = F.when(F.col("event_id") % 101 != 0, F.col("event_id"))
    target = fx.stored_events(spark, sf).withColumn("event_id", lost)
    changes = fx.resent_events(spark, sf).where("sent = 2").drop("sent").withColumn("event_id", lost)
    return upsert(target, changes, "event_id")


def q_upsert_key_only(spark, sf):
    e = fx.events(spark, sf)
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    return upsert(first, e.select("user_id").distinct(), "user_id")


def q_delete_by_key(spark, sf):
    """Events without those of users who ever made a purchase on the first day."""
    e = fx.events(spark, sf)
    gone = e.where((F.col("event_type") == "purchase") & (F.to_date("ts") == F.lit("2024-01-01").cast("date")))
    return delete_by_key(e, gone, "user_id").select("event_id", "user_id")


def q_change_feed_range(spark, sf):
    return change_feed_range(fx.change_feed(spark, sf), 9, 20).select("event_id", "_change_type", "_commit_version")


def _apply(spark, sf, ranges):
    target = fx.early_target(spark, sf)
    for last, current in ranges:
        part = change_feed_range(fx.change_feed(spark, sf), last, current)
        target = apply_changes(target, part, fx.EVENT_COLUMNS, "event_id")
    return target


def q_change_apply(spark, sf):
    return _apply(spark, sf, [(-1, 20)])


def q_change_apply_incremental(spark, sf):
    return _apply(spark, sf, [(-1, 9), (9, 20)])


def q_change_apply_repeated_keys(spark, sf):
    """Every new state is written twice in its commit, the second time with another value."""
    feed = change_feed_range(fx.twice_written(fx.change_feed(spark, sf)), -1, 20)
    return apply_changes(fx.early_target(spark, sf), feed, fx.EVENT_COLUMNS, "event_id")


def q_change_apply_resumed(spark, sf):
    """Up to version 9, then up to 20, then the same once more; where to go on is read from the target."""
    feed, target = fx.change_feed(spark, sf), fx.early_target(spark, sf)
    target = target.withColumn("_applied_version", F.lit(None).cast("bigint"))
    for current in (9, 20, 20):
        part = change_feed_range(feed, -1, current)
        target = written(apply_next(target, part, fx.EVENT_COLUMNS, "event_id"), shared_folder(spark, "target"))
    return target.drop("_applied_version")


def q_change_cursor(spark, sf):
    applied = change_feed_range(fx.change_feed(spark, sf), -1, 20)
    return change_cursor(applied.select(F.col("_commit_version").alias("_applied_version")))


def q_retention_prune(spark, sf):
    return prune(fx.untimed_events(spark, sf), "ts", 7, fx.NOW)


def q_retention_pruned_count(spark, sf):
    return pruned_count(fx.untimed_events(spark, sf), "ts", 7, fx.NOW)


# Streams


def q_topic_to_lake(spark, sf):
    folder, topic = fx.message_folder(spark, sf)
    drain(
        lambda: topic_to_lake(
            read_message_files(spark, topic, max_files=4), fx.MAPPING, f"{folder}/lake", f"{folder}/checkpoint",
            rejects=f"{folder}/rejects", day_of="occurred_at", rebalance=True, drain=True,
        )
    )
    return naive(read_lake(spark, f"{folder}/lake").select(*fx.MAPPING.columns))


def _landed(spark, sf, checkpoints=("checkpoint",), max_files=4):
    """The messages in a lake by days, as many times as there are checkpoints."""
    folder, topic = fx.message_folder(spark, sf)
    for checkpoint in checkpoints:
        drain(
            lambda: topic_to_lake(
                read_message_files(spark, topic, max_files=max_files), fx.MAPPING, f"{folder}/lake", f"{folder}/{checkpoint}",  # noqa: B023
                rejects=f"{folder}/rejects", day_of="occurred_at", drain=True,
            )
        )
    return f"{folder}/lake"


def q_topic_to_lake_replayed(spark, sf):
    """A second checkpoint reads the whole topic again: the lake knows what it holds."""
    return naive(read_lake(spark, _landed(spark, sf, ("first", "second"))).select(*fx.MAPPING.columns))


def q_lake_merged(spark, sf):
    """Many small batches, then all days but the last ten merged."""
    lake = _landed(spark, sf, max_files=1)
    merge_days(spark, lake, (fx.NOW - timedelta(days=10)).date())
    return naive(read_lake(spark, lake).select(*fx.MAPPING.columns))


def q_lake_pruned(spark, sf):
    """A lake by days from which everything older than seven days is removed."""
    fx.configure(spark)
    lake = f"{shared_folder(spark, 'lake')}/events"
    write_batch(fx.untimed_events(spark, sf), lake, "given", 0, "ts")
    prune_lake(spark, lake, "ts", 7, fx.NOW)
    return read_lake(spark, lake).drop("day", "stream", "batch_id")


def q_topic_to_table(spark, sf):
    folder, topic = fx.message_folder(spark, sf)
    drain(
        lambda: topic_to_table(
            read_message_files(spark, topic, max_files=4), fx.MAPPING, f"{folder}/table", f"{folder}/checkpoint",
            rejects=f"{folder}/rejects", drain=True,
        )
    )
    return naive(read_keyed(spark, f"{folder}/table", fx.MAPPING))


def _two_streams(spark, sf, start):
    """First sendings by one stream, repeats by another with a checkpoint of its own, into one target."""
    fx.configure(spark)
    folder = shared_folder(spark, "topics")
    messages = fx.messages(spark, sf)
    for name, part in (("first", F.col("offset") < fx.RESENT), ("again", F.col("offset") >= fx.RESENT)):
        messages.where(part).write.parquet(f"{folder}/{name}")
        stream = lambda: read_message_files(spark, f"{folder}/{name}")  # noqa: E731, B023
        drain(lambda: start(stream(), fx.MAPPING, f"{folder}/target", f"{folder}/{name}-checkpoint", drain=True))  # noqa: B023
    return f"{folder}/target"


def q_two_topics_one_lake(spark, sf):
    return naive(read_lake(spark, _two_streams(spark, sf, topic_to_lake)).select(*fx.MAPPING.columns))


def q_two_topics_one_table(spark, sf):
    return naive(read_keyed(spark, _two_streams(spark, sf, topic_to_table), fx.MAPPING))


def q_keyed_compacted(spark, sf):
    """The repeats arrive first and are folded into a base; the first sendings come late, in another log."""
    fx.configure(spark)
    folder = shared_folder(spark, "topics")
    messages = fx.messages(spark, sf)
    for name, part in (("again", F.col("offset") >= fx.RESENT), ("first", F.col("offset") < fx.RESENT)):
        messages.where(part).write.parquet(f"{folder}/{name}")
        stream = read_message_files(spark, f"{folder}/{name}")
        drain(lambda: topic_to_table(stream, fx.MAPPING, f"{folder}/{name}-log", f"{folder}/{name}-checkpoint", drain=True))  # noqa: B023
    compact(spark, f"{folder}/again-log", fx.MAPPING, f"{folder}/base", buckets=8)
    return naive(read_keyed(spark, f"{folder}/first-log", fx.MAPPING, f"{folder}/base"))


def q_feed_to_table(spark, sf):
    """The change feed as a stream into a keyed table, compacted; the covered log is still there when it is read."""
    folder = shared_folder(spark, "feed")
    feed = fx.change_feed(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    feed.write.parquet(f"{folder}/feed")
    stream = spark.readStream.schema(feed.schema).parquet(f"{folder}/feed")
    drain(lambda: changes_to_table(stream, fx.EVENT_MAPPING, f"{folder}/table", f"{folder}/checkpoint", drain=True))
    compact(spark, f"{folder}/table", fx.EVENT_MAPPING, f"{folder}/base")
    return naive(read_keyed(spark, f"{folder}/table", fx.EVENT_MAPPING, f"{folder}/base"))


def q_topic_drain_twice(spark, sf):
    """Half of the topic, a drain; the other half, a second drain; a third drain finds nothing new."""
    fx.configure(spark)
    folder = shared_folder(spark, "topic")
    messages = fx.messages(spark, sf)

    def run():
        drain(
            lambda: topic_to_table(
                read_message_files(spark, f"{folder}/messages"), fx.MAPPING, f"{folder}/table",
                f"{folder}/checkpoint", drain=True,
            )
        )

    for part in (F.col("offset") < fx.RESENT, F.col("offset") >= fx.RESENT):
        messages.where(part).write.mode("append").parquet(f"{folder}/messages")
        run()
    run()
    return naive(read_keyed(spark, f"{folder}/table", fx.MAPPING))


# Status and lineage


def q_job_status(spark, sf):
    jobs = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("job"))
    return job_status(jobs, fx.reports(spark, sf), datetime(2024, 1, 30, 23, 59, 30))


def q_lineage_edges(spark, sf):
    return lineage_edges(*fx.lineage_parts(spark, sf))


def q_lineage_nodes(spark, sf):
    connections, jobs, views = fx.lineage_parts(spark, sf)
    reports = fx.reports(spark, sf).withColumn("job", F.concat(F.lit("C"), F.col("job")))
    wanted = reports.select("job").distinct()
    status = job_status(wanted, reports, datetime(2024, 1, 30, 23, 59, 30))
    return lineage_nodes(connections, jobs, views, status)


def _layers(spark, sf):
    connections, jobs, views = fx.lineage_parts(spark, sf)
    edges = written(lineage_edges(connections, jobs, views), shared_folder(spark, "edges"))
    return lineage_layers(lineage_nodes(connections, jobs, views), edges), edges


def q_lineage_layers(spark, sf):
    return _layers(spark, sf)[0]


def _subgraph(spark, sf):
    layers, edges = _layers(spark, sf)
    return lineage_subgraph(layers, edges, "sync:C7")


def q_lineage_subgraph(spark, sf):
    return _subgraph(spark, sf)[0]


def q_lineage_subgraph_edges(spark, sf):
    return _subgraph(spark, sf)[1]


QUERIES: dict[str, Query] = {
    "coerce_text": _coerced("text", _text_forms),
    "coerce_unknown_type": _coerced("uuid", _text_forms),
    "coerce_int": _coerced("int", _int_forms),
    "coerce_float": _coerced("double", _float_forms),
    "coerce_bool": _coerced("bool", _bool_forms),
    "coerce_timestamp": _coerced("timestamptz", _time_forms),
    **{name[2:]: query for name, query in list(globals().items()) if name.startswith("q_")},
}
