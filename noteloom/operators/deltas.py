"""Changes between states: scans, versions, clocks, ordered event folds, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteloom.functions.text import clip

#: Bytes a log may hold where no entitlement says otherwise.
DEFAULT_QUOTA = 512 * 1024 * 1024
LIVE_STATUSES = ("active", "trialing", "past_due")


def scan_delta(scan: DataFrame, shadow: DataFrame) -> DataFrame:
    """(key, change) of (key, hash) tables: 'created', 'modified' or 'deleted' against the shadow."""
    s = shadow.select("key", F.col("hash").alias("__was"), F.lit(True).alias("__old"))
    both = scan.select("key", "hash", F.lit(True).alias("__new")).join(s, "key", "full_outer")
    change = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "deleted").when(~F.col("hash").eqNullSafe(F.col("__was")), "modified")
    return both.select("key", change.alias("change")).where("change IS NOT NULL")


def unchanged_files(listing: DataFrame, shadow: DataFrame) -> DataFrame:
    """Listed files (key, mtime_ms, size) whose time and size are the shadow's: their content needn't be read."""
    return listing.join(shadow.select("key", "mtime_ms", "size"), ["key", "mtime_ms", "size"], "left_semi")


def version_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(note_id, op, before, after) of (note_id, raw) tables; null raw means absent."""
    b = before.select("note_id", F.col("raw").alias("before"))
    both = b.join(after.select("note_id", F.col("raw").alias("after")), "note_id", "full_outer")
    return both.select("note_id", change_op(F.col("before"), F.col("after")).alias("op"), "before", "after")


def change_op(before: Column, after: Column) -> Column:
    return F.when(before.isNull() & after.isNotNull(), "created").when(before.isNotNull() & after.isNull(), "deleted").otherwise("updated")


def version_detail(rows: DataFrame, include_content: bool = False, max_tokens: int = 500) -> DataFrame:
    """(note_id, op, before, after) of a version's rows (note_id, before, after); contents clipped, or null where they aren't asked for."""
    b, a = F.col("before"), F.col("after")
    show = lambda c: clip(c, max_tokens) if include_content else F.lit(None).cast("struct<content:string,truncated:boolean>")
    return rows.select("note_id", change_op(b, a).alias("op"), show(b).alias("before"), show(a).alias("after")).orderBy("note_id")


def state_vector(updates: DataFrame) -> DataFrame:
    """(item, client, clock): the greatest clock of each client."""
    return updates.groupBy("item", "client").agg(F.max("clock").alias("clock"))


def covered(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(item, covered): whether an item's tombstone has seen all its clocks; items without one aren't covered.

    A deletion holds only then; an edit it hasn't seen brings the item back.
    """
    seen = tombstones.select("item", "client", F.col("clock").alias("seen"))
    buried = tombstones.select("item").distinct().withColumn("buried", F.lit(True))
    both = docs.join(seen, ["item", "client"], "left").groupBy("item").agg(F.bool_and(F.coalesce(F.col("clock") <= F.col("seen"), F.lit(False))).alias("all_seen"))
    return both.join(buried, "item", "left").select("item", (F.coalesce("buried", F.lit(False)) & F.col("all_seen")).alias("covered"))


def entitlement_fold(events: DataFrame, key: str = "vault", created: str = "created", event_id: str = "event_id") -> DataFrame:
    """(key, status, plan columns of the last event) after folding events in order of creation.

    Events (key, event_id, type, status, created, ...): a type ending in 'deleted' removes; a live status
    upserts; any other status removes. The last writer wins; of events with equal times the first (by id) does,
    as a tie isn't newer. Removed keys don't appear.
    """
    newest = Window.partitionBy(key).orderBy(F.desc(created), F.asc(event_id))
    last = events.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")
    return last.where(~F.endswith("type", F.lit("deleted")) & F.col("status").isin(*LIVE_STATUSES))


def quota_check(usage: DataFrame, entitlements: DataFrame, key: str = "vault") -> DataFrame:
    """(key, used, quota, accepts): logs below their quota accept an append."""
    q = entitlements.select(key, "quota_bytes")
    both = usage.join(q, key, "left").withColumn("quota", F.coalesce("quota_bytes", F.lit(DEFAULT_QUOTA).cast("long")))
    return both.select(key, "used", "quota", (F.col("used") < F.col("quota")).alias("accepts"))


def presence_state(updates: DataFrame) -> DataFrame:
    """The latest update of each device, last writer by time; devices whose latest is ``gone`` are left out.

    Of updates with equal times the later log position wins, where a column seq is present.
    """
    order = [F.desc("ts")] + ([F.desc("seq")] if "seq" in updates.columns else [])
    newest = Window.partitionBy("device").orderBy(*order)
    return updates.withColumn("__r", F.row_number().over(newest)).where("__r = 1 AND NOT gone").drop("__r")


def presence_alive(state: DataFrame, now_ms: int, ttl_ms: int = 45_000) -> DataFrame:
    """Devices whose last update is at most the time to live ago."""
    return state.where(F.lit(now_ms) - F.col("ts") <= ttl_ms)
