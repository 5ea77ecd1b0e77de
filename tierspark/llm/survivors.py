"""One document of each group of a deduplication, decided row by row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspark.llm.bitset import mark_held
from tierspark.llm.common import stored

# Gets ``(_key, _text)`` and returns, for each of its rows, ``(_key, _first)``: the smallest key of the row's group.
Judge = Callable[[DataFrame], DataFrame]


def one_of_each(docs: DataFrame, judge: Judge, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that come first in their group, with all their columns.

    A row is known by its key and its text's digest, so a key that was lost or given twice protects no copy. The
    smallest key of a group stays, rows without one come last. Of rows that repeat key and text one stays;
    which, if they differ in other columns, is left open. Columns may have any names, also such as differ in case only.
    """
    names = docs.columns
    numbered = docs.toDF(*[f"_{i}" for i in range(len(names))])
    own_key, own_text = F.col(f"_{names.index(key)}"), F.col(f"_{names.index(text)}")
    sha = F.unhex(F.sha2(F.coalesce(own_text, F.lit("")), 256))
    numbered = numbered.withColumn("_key", F.struct(own_key.isNull().alias("none"), own_key.alias("key"), sha.alias("sha")))
    judged = stored(judge(numbered.select("_key", own_text.alias("_text"))).select("_key", "_first"), "judged")
    gone = stored(judged.where("_key <> _first").select("_key").distinct(), "dropped")
    again = stored(judged.where("_key = _first").groupBy("_key").count().where("count > 1").select("_key"), "repeated")
    # Most rows are neither; only those that may be are moved and looked up.
    numbered = numbered.withColumn("fp", F.xxhash64("_key"))
    marked = mark_held(numbered, stored(gone.unionByName(again).select(F.xxhash64("_key").alias("fp")).distinct(), "held"))
    plain, near = marked.where("NOT _held"), marked.where("_held").join(gone, "_key", "left_anti")
    if not again.isEmpty():
        once = near.join(again, "_key", "left_semi").dropDuplicates(["_key"])
        near = near.join(again, "_key", "left_anti").unionByName(once.select(*near.columns))
    stays = plain.unionByName(near.select(*plain.columns)).drop("fp", "_held")
    return stays.drop("_key").toDF(*names)
