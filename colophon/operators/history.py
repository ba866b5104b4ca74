"""What a page was at a time, and what was done to a record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def states_at(events: DataFrame, times: Sequence, needed: int = 2) -> DataFrame:
    """(page, at, text, editor, edits, approvals, state): every page as it was at each of some times.

    ``events``: page, ts, seq, kind, actor, text; of kinds ``edit`` (a new text), ``submit``,
    ``approve`` and ``withdraw`` (an approver's own approval). The text is the last edit's; an
    edit ends what was submitted and approved before. ``approvals`` counts actors whose last word
    since the last edit is an approval, the editor's own not. The state is ``approved`` from
    ``needed`` approvals on, else ``submitted`` or ``draft``; pages before their first edit have no row. Events of one
    time go by ``seq``. Each event is summed once per time that it precedes, into
    one row a page, time and actor, so a page of very many events is combined before it is
    shuffled.
    """
    before = events.select("page", "kind", "actor", "text", F.struct("ts", "seq").alias("when"), "ts", F.explode(F.array(*map(F.lit, times))).alias("at")).where(F.col("ts") <= F.col("at"))
    last = lambda *kinds, also=(): F.max(F.when(F.col("kind").isin(*kinds), F.struct("when", *also)))
    by_actor = before.groupBy("page", "at", "actor").agg(
        last("edit", also=("text", "actor")).alias("edit"), F.count(F.when(F.col("kind") == "edit", 1)).alias("edits"), last("submit").alias("submit"), last("approve", "withdraw", also=("kind",)).alias("said")
    )
    pages = by_actor.groupBy("page", "at").agg(F.max("edit").alias("edit"), F.sum("edits").alias("edits"), F.max("submit").alias("submit"), F.collect_list(F.when(F.col("said.kind") == "approve", F.struct(F.col("said.when").alias("when"), "actor"))).alias("said"))
    counted = pages.where("edit is not null").withColumn("approvals", F.size(F.filter("said", lambda s: (s["when"] > F.col("edit.when")) & (s["actor"] != F.col("edit.actor")))))
    state = F.when(F.col("approvals") >= needed, "approved").when(F.col("submit.when") > F.col("edit.when"), "submitted").otherwise("draft")
    return counted.select("page", "at", F.col("edit.text").alias("text"), F.col("edit.actor").alias("editor"), "edits", "approvals", state.alias("state"))


def merged_history(lists: dict[str, tuple[DataFrame, Column]], keep: int = 20, after: tuple | None = None) -> DataFrame:
    """(record, kind, id, ts, detail, n): the newest ``keep`` entries of each record over several lists.

    ``lists``: for each kind its rows (record, id, ts) and what is said of them. Entries are in order of
    time, newest first, then kind and id; ``after`` (ts, kind, id) is the last entry already seen.
    Each list is cut to what a record can show before the lists meet.
    """
    newest = Window.partitionBy("record").orderBy(F.desc("ts"), "kind", F.desc("id"))
    parts = None
    for kind, (rows, detail) in sorted(lists.items()):
        part = rows.select("record", F.lit(kind).alias("kind"), "id", "ts", detail.alias("detail"))
        if after is not None:
            ts, k, i = (F.lit(x) for x in after)
            part = part.where((F.col("ts") < ts) | ((F.col("ts") == ts) & ((F.col("kind") > k) | ((F.col("kind") == k) & (F.col("id") < i)))))
        part = part.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= keep).drop("n")
        parts = part if parts is None else parts.unionByName(part)
    return parts.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= keep)
