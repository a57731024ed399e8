"""Bursts, stacks, and suggestions to stack."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shutterlake.functions.scalars import gap_seconds

#: Best score under which a frame is taken to be blank.
BLANK = 4.5


#: Rows that one slot of time holds, about.
SLOT_ROWS = 1 << 20


def _slots(timed: DataFrame, ts: str) -> Column:
    """The number of the slot of time that a row falls in; slots hold about as many rows each, so that a busy hour is no hot key."""
    count = -(-timed.count() // SLOT_ROWS)
    if count <= 1:
        return F.lit(0)
    at = F.unix_micros(F.col(ts).cast("timestamp")).alias("at")
    bounds = timed.select(at).agg(F.percentile_approx("at", [i / count for i in range(1, count)], 100 * count)).first()[0]
    # which slots there are does not matter for the result
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.unix_micros(F.col(ts).cast("timestamp"))))


def burst_ids(rows: DataFrame, ts: str, key: str, delta_ms: int) -> DataFrame:
    """``rows`` with ``burst``, the time and key at which the row's segment begins; a gap above ``delta_ms`` begins a new one.

    No sort of the whole table: rows are windowed within slots of time, and what a
    slot needs of those before it (their last time, the last segment begun) comes
    from a table of one row a slot. Rows without a time drop out.
    """
    timed = rows.where(F.col(ts).isNotNull())
    timed = timed.withColumn("__slot", _slots(timed, ts))
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    inside = Window.partitionBy("__slot").orderBy(ts, key)
    before = F.lag(ts).over(inside)
    step = timed.withColumns({"__gap": micros(F.col(ts)) - micros(before), "__first": before.isNull()})
    ends = timed.groupBy("__slot").agg(F.max(ts).alias("__end"))
    slots = Window.orderBy("__slot")
    carried = ends.select("__slot", F.lag("__end").over(slots).alias("__before"))
    gap = F.when(F.col("__first"), micros(F.col(ts)) - micros(F.col("__before"))).otherwise(F.col("__gap"))
    begun = step.join(carried, "__slot").withColumn("__new", gap.isNull() | (gap > delta_ms * 1000))
    start = F.when(F.col("__new"), F.struct(F.col(ts).alias("ts"), F.col(key).alias("key")))
    own = begun.withColumn("__own", F.last(start, ignorenulls=True).over(inside))
    opened = begun.groupBy("__slot").agg(F.max(start).alias("__open"))
    earlier = opened.select("__slot", F.last("__open", ignorenulls=True).over(slots.rowsBetween(Window.unboundedPreceding, -1)).alias("__earlier"))
    out = own.join(earlier, "__slot").withColumn("burst", F.coalesce("__own", "__earlier"))
    return out.select(*rows.columns, "burst")


def segments(rows: DataFrame, ts: str, key: str, delta_ms: int) -> DataFrame:
    """(start_ts, start_key, end_ts, members) of every segment."""
    found = burst_ids(rows, ts, key, delta_ms)
    return found.groupBy("burst").agg(F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("members")).select(F.col("burst.ts").alias("start_ts"), F.col("burst.key").alias("start_key"), "end_ts", "members")


def representatives(members: DataFrame, mean_scores: DataFrame) -> DataFrame:
    """(stack_id, representative_key, stack_size) of (stack_id, key, rating, date_taken): rated, rating, mean score, date, key."""
    scored = members.join(mean_scores.select(F.col("image_key").alias("key"), "mean_score"), "key", "left")
    rank = F.struct(F.coalesce(F.col("rating") > 0, F.lit(False)).alias("rated"), F.coalesce("rating", F.lit(-1)).alias("rating"), F.coalesce("mean_score", F.lit(0.0)).alias("mean"), F.coalesce(F.col("date_taken").cast("string"), F.lit("")).alias("date"), F.col("key"))
    return scored.groupBy("stack_id").agg(F.max(rank).alias("top"), F.count(F.lit(1)).alias("stack_size")).select("stack_id", F.col("top.key").alias("representative_key"), "stack_size")


def stack_fields(members: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, stack_id, representative_key, stack_size) of the members."""
    return members.select("key", "stack_id").join(chosen, "stack_id")


def hidden_members(fields: DataFrame) -> DataFrame:
    """Keys of stack members that do not represent their stack."""
    return fields.where("key <> representative_key").select("key")


def create(members: DataFrame, keys: list, stack_id: int) -> DataFrame:
    """Members after a new stack of at least two keys; a key leaves the stack it was in."""
    if len(set(keys)) < 2:
        raise ValueError("a stack needs two members or more")
    new = members.sparkSession.createDataFrame([(stack_id, k) for k in dict.fromkeys(keys)], members.schema)
    return dissolve(members.where(~F.col("key").isin(*keys))).unionByName(new)


def add_member(members: DataFrame, key, stack_id: int) -> DataFrame:
    """Members after a key moved into a stack."""
    new = members.sparkSession.createDataFrame([(stack_id, key)], members.schema)
    return dissolve(members.where(F.col("key") != key).unionByName(new))


def split_out(members: DataFrame, key) -> DataFrame:
    """Members after a key left its stack."""
    return dissolve(members.where(F.col("key") != key))


def merge(members: DataFrame, source: int, target: int) -> DataFrame:
    """Members after one stack went into another."""
    return members.withColumn("stack_id", F.when(F.col("stack_id") == source, F.lit(target).cast("long")).otherwise(F.col("stack_id")))


def set_representative(stacks: DataFrame, stack_id: int, key) -> DataFrame:
    """Stacks with another representative, marked as changed by the user."""
    mine = F.col("stack_id") == stack_id
    return stacks.withColumns({"representative_key": F.when(mine, F.lit(key)).otherwise(F.col("representative_key")), "user_modified": F.when(mine, F.lit(1).cast("long")).otherwise(F.col("user_modified"))})


def dissolve(members: DataFrame) -> DataFrame:
    """Members without stacks of one."""
    alone = members.groupBy("stack_id").count().where("count < 2").select("stack_id")
    return members.join(alone, "stack_id", "left_anti")


def accept_pair(members: DataFrame, key_a, key_b, new_id: int) -> DataFrame:
    """Members after a suggested pair became, or joined, a stack; two stacks become one."""
    found = {r["key"]: r["stack_id"] for r in members.where(F.col("key").isin(key_a, key_b)).collect()}
    a, b = found.get(key_a), found.get(key_b)
    if a is None and b is None:
        return create(members, [key_a, key_b], new_id)
    if a is not None and b is not None:
        return members if a == b else merge(members, b, a)
    return add_member(members, key_b if b is None else key_a, b if a is None else a)


def ordered_pair(a: Column, b: Column) -> tuple[Column, Column]:
    """The pair with the lesser key first."""
    return F.least(a, b), F.greatest(a, b)


def reject(rejections: DataFrame, new: DataFrame) -> DataFrame:
    """Rejections with new pairs, each once."""
    low, high = ordered_pair(F.col("key_a"), F.col("key_b"))
    fresh = new.where("key_a <> key_b").select(low.alias("key_a"), high.alias("key_b"), "rejected_at")
    return rejections.unionByName(fresh).groupBy("key_a", "key_b").agg(F.min("rejected_at").alias("rejected_at"))


def blank_keys(best: DataFrame, floor: float = BLANK) -> DataFrame:
    """Keys whose best score is below the floor; unscored images are not blank."""
    return best.where(F.col("score") < floor).select(F.col("image_key").alias("key"))


def pending_suggestions(pairs: DataFrame, images: DataFrame, fields: DataFrame, rejections: DataFrame, blank: DataFrame) -> DataFrame:
    """Pairs (group_id, seed_key, candidate_key, similarity) still to decide: not rejected, not in one stack, neither blank.

    One row for each group and candidate, ordered by how many are in stacks, the
    time between, newest group.
    """
    low, high = ordered_pair(F.col("seed_key"), F.col("candidate_key"))
    out = pairs.withColumns({"key_a": low, "key_b": high}).join(rejections.select("key_a", "key_b"), ["key_a", "key_b"], "left_anti")
    out = reduce(lambda df, c: df.join(blank.select(F.col("key").alias(c)), c, "left_anti"), ("seed_key", "candidate_key"), out)
    for side in ("seed", "candidate"):
        one = images.select(F.col("key").alias(f"{side}_key"), F.col("date_taken").alias(f"{side}_date"))
        stack = fields.select(F.col("key").alias(f"{side}_key"), F.col("stack_id").alias(f"{side}_stack"))
        out = out.join(one, f"{side}_key").join(stack, f"{side}_key", "left")
    out = out.where(F.col("seed_stack").isNull() | F.col("candidate_stack").isNull() | (F.col("seed_stack") != F.col("candidate_stack")))
    status = F.col("seed_stack").isNotNull().cast("int") + F.col("candidate_stack").isNotNull().cast("int")
    out = out.withColumns({"stack_status": status, "gap": gap_seconds(F.col("seed_date"), F.col("candidate_date"))})
    return out.select("group_id", "seed_key", "candidate_key", "similarity", "stack_status", "gap").orderBy("stack_status", "gap", F.desc("group_id"), "candidate_key")


def count_pending(*tables: DataFrame) -> DataFrame:
    """(pending): how many suggestions are still to decide; takes what :func:`pending_suggestions` takes."""
    return pending_suggestions(*tables).agg(F.count(F.lit(1)).alias("pending"))


def metadata(stacks: DataFrame, members: DataFrame) -> DataFrame:
    """Stacks with the members they have now: stack_id, representative_key, stack_size, members."""
    live = members.groupBy("stack_id").agg(F.count(F.lit(1)).alias("stack_size"), F.sort_array(F.collect_list("key")).alias("members"))
    return stacks.select("stack_id", "representative_key").join(live, "stack_id", "left").withColumn("stack_size", F.coalesce("stack_size", F.lit(0)))


def containing(members: DataFrame, key) -> DataFrame:
    """The members of the stack that a key is in; a key in no stack stands alone."""
    mine = members.where(F.col("key") == key).select("stack_id")
    rows = members.join(F.broadcast(mine.limit(1)), "stack_id", "left_semi").select("key")
    alone = members.sparkSession.createDataFrame([(key,)], f"key {dict(members.dtypes)['key']}")
    return rows.union(alone).distinct().orderBy("key")


def incremental_bursts(rows: DataFrame, members: DataFrame, ts: str, key: str, delta_ms: int) -> DataFrame:
    """Segments of the rows that are in no stack yet; stacked neighbours neither join nor part them."""
    fresh = rows.join(members.select(F.col("key").alias(key)), key, "left_anti")
    return segments(fresh, ts, key, delta_ms).where("members >= 2")
