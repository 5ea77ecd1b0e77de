"""Keyed changes: last write wins, upsert, delete, change feeds."""

from __future__ import annotations

from collections.abc import Mapping as Named
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspark.functions.names import quoted
from tierspark.session import is_small, shared_folder, written

# Change types of a change feed that carry a new state. Old images and unknown types do not.
WRITES = ("insert", "update_postimage")
DELETE = "delete"


def latest_per_key(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The last row of every key, by the ``order`` columns.

    An aggregate rather than a window: every task first keeps one row per key, so a key that holds a
    large part of the rows sends one row per task through the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    last = F.max_by(F.struct(*[quoted(c) for c in rest]), F.struct(*[quoted(c) for c in order]))
    return (
        df.groupBy(quoted(key).alias(key))
        .agg(last.alias("_last"))
        .select(*[quoted(c) if c == key else F.col("_last").getField(c).alias(c) for c in df.columns])
    )


def upsert(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    defaults: Named[str, Column] | None = None,
    deleted: str | None = None,
    reset: str | None = None,
) -> DataFrame:
    """``target`` after the changes; both sides hold at most one row per key.

    A matching row takes the changes' columns and keeps its other columns; a new row takes ``defaults``
    (or NULL) for those. ``deleted`` names a boolean column of ``changes``: true removes the row.
    ``reset`` names one that is true if the row was removed and came back: its other columns start
    over. If the key is the only common column, existing rows stay as they are.

    One full outer join, so each side is shuffled once by key, or not at all if it is already
    bucketed by key. Keys are unique on both sides, so no key is hot here. For a small batch of
    changes see :func:`upsert_batch`.
    """
    mapped, defaults = _mapped(target, changes, deleted, reset), dict(defaults or {})
    t, c = _sides(target, changes, key)
    return _merged(target, t.join(c, F.col("_tk") == F.col("_ck"), "full_outer"), mapped, defaults, deleted, reset)


def upsert_batch(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    defaults: Named[str, Column] | None = None,
    deleted: str | None = None,
    reset: str | None = None,
) -> DataFrame:
    """The same for a batch of changes that may be small next to the target.

    The changes are written first, which shows their size. If they are small enough to broadcast, the
    target is changed where it lies, without a shuffle: each row looks up its change, and the new
    rows are those changes whose key a second, key-only scan of the target does not meet. Otherwise
    both sides are shuffled as in :func:`upsert`.
    """
    changes = written(changes, shared_folder(changes.sparkSession, "changes"))
    if not is_small(changes):
        return upsert(target, changes, key, defaults, deleted, reset)
    mapped = _mapped(target, changes, deleted, reset)
    t, c = _sides(target, changes, key)
    met = t.select("_tk").join(F.broadcast(c.select("_ck")), F.col("_tk") == F.col("_ck"), "left_semi").distinct()
    old = t.join(F.broadcast(c), F.col("_tk") == F.col("_ck"), "left")
    # The keys met are no more than the changes, hence as small.
    new = c.join(F.broadcast(met), F.col("_tk") == F.col("_ck"), "left_anti")
    nothing = F.lit(None)
    new = new.select(
        nothing.cast(t.schema["_t"].dataType).alias("_t"), nothing.cast(t.schema["_tk"].dataType).alias("_tk"), "_c", "_ck"
    )
    return _merged(target, old.unionByName(new), mapped, dict(defaults or {}), deleted, reset)


def _mapped(target: DataFrame, changes: DataFrame, deleted: str | None, reset: str | None) -> list[str]:
    """The columns the changes set."""
    mapped = [c for c in changes.columns if c not in (deleted, reset)]
    for column in mapped:
        if column not in target.columns:
            raise ValueError(f"column {column!r} not found in the target")
    return mapped


def _sides(target: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides as one struct and the key each. A change without a key names no row and is left out."""
    changes = changes.where(quoted(key).isNotNull())
    return (
        target.select(F.struct("*").alias("_t"), quoted(key).alias("_tk")),
        changes.select(F.struct("*").alias("_c"), quoted(key).alias("_ck")),
    )


def _merged(
    target: DataFrame,
    joined: DataFrame,
    mapped: list[str],
    defaults: Named[str, Column],
    deleted: str | None,
    reset: str | None,
) -> DataFrame:
    """The target's columns out of matched and unmatched pairs."""
    # Sides are told by their structs: a key may be NULL, a row of either side may not.
    hit, old, new = F.col("_c").isNotNull(), F.col("_t"), F.col("_c")
    fresh = F.col("_t").isNull()
    if reset:
        fresh = fresh | (hit & new.getField(reset))
    if deleted:
        joined = joined.where(~hit | ~new.getField(deleted))

    def merged(column: str) -> Column:
        kind = target.schema[column].dataType
        if column in mapped:
            return F.when(hit, new.getField(column).cast(kind)).otherwise(old.getField(column))
        start = defaults.get(column, F.lit(None)).cast(kind)
        return F.when(fresh, start).otherwise(old.getField(column))

    return joined.select(*[merged(c).alias(c) for c in target.columns])


def delete_by_key(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``target`` without the rows whose key is in ``keys``; repeated keys are reduced before they are moved."""
    return target.join(keys.select(quoted(key).alias(key)).distinct(), key, "left_anti").select(
        *[quoted(c) for c in target.columns]
    )


def change_position(feed: DataFrame) -> Column:
    """The place of a change among those of its commit.

    The column ``_position`` where the feed has it, else that of the message it came from: the feed of a lake
    that messages landed in carries ``_offset`` and ``_partition``. Otherwise 0 for all.
    """
    if "_position" in feed.columns:
        return F.coalesce(F.col("_position"), F.lit(0))
    if {"_offset", "_partition"} <= set(feed.columns):
        return F.coalesce(F.shiftleft("_offset", 16) + F.col("_partition"), F.lit(0))
    return F.lit(0)


def final_changes(feed: DataFrame, mapped: Sequence[str], key: str) -> DataFrame:
    """A range of a change feed as one row per key: ``mapped`` columns, ``_deleted`` and ``_reset``.

    Changes are applied in commit order and, within one commit, deletes before writes, those by
    :func:`change_position`; where the feed tells none, one commit should write a key once. Old images and
    unknown change types are skipped. A change of the key itself leaves the row of the old key alone,
    because only the new image is looked at.
    """
    removes = F.col("_change_type") == DELETE
    rest = [c for c in mapped if c != key]
    state = F.struct(*[quoted(c) for c in rest], removes.alias("_deleted"))
    return (
        feed.where(F.col("_change_type").isin(*WRITES, DELETE))
        .groupBy(quoted(key).alias(key))
        .agg(
            F.max_by(state, F.struct(F.col("_commit_version"), ~removes, change_position(feed))).alias("_last"),
            F.bool_or(removes).alias("_reset"),
        )
        .select(
            *[quoted(c) if c == key else F.col("_last").getField(c).alias(c) for c in mapped],
            F.col("_last._deleted").alias("_deleted"),
            "_reset",
        )
    )


def apply_changes(
    target: DataFrame,
    feed: DataFrame,
    mapped: Sequence[str],
    key: str,
    defaults: Named[str, Column] | None = None,
    batch: bool = False,
) -> DataFrame:
    """``target`` after a range of a change feed; ``batch`` as in :func:`upsert_batch`."""
    change = upsert_batch if batch else upsert
    return change(
        target, final_changes(feed, mapped, key), key, defaults=defaults, deleted="_deleted", reset="_reset"
    )


def apply_next(
    target: DataFrame,
    feed: DataFrame,
    mapped: Sequence[str],
    key: str,
    defaults: Named[str, Column] | None = None,
    batch: bool = False,
    version: str = "_applied_version",
) -> DataFrame:
    """``target`` after the changes it has not seen; its column ``version`` takes that of each row's last change.

    The rows tell what was seen: nothing up to the highest version among them is applied again. Later
    changes that left no row, such as deletes, are, and change nothing. Only that one number is read
    at once, so pass a ``target`` that is a table rather than a long plan.
    """
    last = change_cursor(target, version).first()["last_applied"]
    unseen = feed.where(F.col("_commit_version") > last).withColumn(version, F.col("_commit_version"))
    return apply_changes(target, unseen, [*mapped, version], key, defaults, batch)


def change_cursor(applied: DataFrame, version: str = "_applied_version") -> DataFrame:
    """The last applied version; -1 if nothing was applied yet, so that reading starts at version 0."""
    return applied.agg(F.coalesce(F.max(quoted(version)), F.lit(-1)).cast("bigint").alias("last_applied"))
