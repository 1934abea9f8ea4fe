"""Sharding by balanced label propagation.

Linked documents are those of equal texts.  Every document starts in a shard dealt by
hash.  In each round, every group of linked documents that is still cut looks at how many
of its members each shard holds and asks to gather in the fullest one that has room for all of it;
requests to a shard are granted, large groups first, while they fit its quota.  Only groups
that are whole take up room, so those still cut never block each other, however many rows are
linked.  The first half of the rounds is for large groups.  What the rounds leave is laid end to end over the
room left: at most one group per end of a shard's room doesn't fit, and those are fitted
one by one, largest first; only what fits nowhere whole is cut.  A shard's
quota for linked documents is its exact count, so the unlinked documents, which no
move can cut, then fill every shard up to it: the law is ``rows``, counts at
most one apart.  Members of a group in the same shard always move alike, so the rounds run
on counts per (group, shard), not on documents or pairs; a group larger than a shard
is handled as several.

All of it is DataFrame operations.  Ranks are counted in salted groups.  What reaches the
driver is one row per shard, and for the groups at the ends of rooms, at most one per
shard, one row per shard they start in.

Defined results: a null text is an empty one; repeated rows are documents of their own
(each gets a row-unique number when the table is written); an empty table gives no rows;
with fewer rows than shards some shards stay empty; very long texts are read once, for
their hash, size and checksum; only doc_id and text are read, so other columns' names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarry.llm.common import col, discard, written

PER_GROUP = 512
BUCKETS = 1024


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index + 1)


def _loads(df: DataFrame, label: str, n: str, shards: int) -> list[int]:
    got = {r[0]: r[1] for r in df.groupBy(label).agg(F.sum(n)).collect()}  # one row per shard
    return [int(got.get(s) or 0) for s in range(shards)]


def _bucket(salt: Column) -> Column:
    """Large parts first, in buckets that hold few of one size."""
    return (F.lit(64) - F.floor(F.log2("total"))) * BUCKETS + F.pmod(F.xxhash64("group", "part", salt), F.lit(BUCKETS))


def _moved(state: DataFrame, moves: DataFrame, on: list[str]) -> DataFrame:
    """``state`` with the label ``to`` of ``moves``, written; the table before it is deleted."""
    new = written(state.join(moves, on, "left").withColumn("label", F.coalesce("to", "label")).drop("to"), "labels")
    discard(state)
    return new


def _free(state: DataFrame, quota: list[int]) -> tuple[DataFrame, list[int]]:
    """Rows of every part per label (m, total), and the room that whole parts leave in every shard."""
    held = state.groupBy("group", "part", "label").agg(F.sum("n").alias("m"), F.first("total").alias("total"))
    load = _loads(held.where("m = total"), "label", "m", len(quota))
    return held, [max(0, q - x) for q, x in zip(quota, load)]


def propagate(nodes: DataFrame, quota: list[int], rounds: int = 12) -> DataFrame:
    """nodes (group, part, home, n): rows of a group part that start in shard ``home``.
    Returns them with ``label``, the shard they end in, or -1 for rows that fill up like unlinked ones;
    no shard's total exceeds its quota unless that of its whole parts did at the start."""
    key = ["group", "part"]
    sizes = nodes.groupBy(*key).agg(F.sum("n").alias("total"))
    state = written(nodes.join(sizes, key).withColumn("label", F.col("home")), "labels")
    large = max(quota) // 16
    for turn in range(rounds):
        if turn == rounds // 2:
            large = 0
        held, free = _free(state, quota)
        asked = (held.where((F.col("m") < F.col("total")) & (F.col("total") >= large) & (F.col("total") <= _pick(free, F.col("label"))))
                 .groupBy(*key).agg(F.max(F.struct("m", F.xxhash64("group", "part", "label").alias("tie"), "label", "total")).alias("best"))
                 .select(*key, F.col("best.label").alias("to"), F.col("best.total").alias("total"))
                 .withColumn("bucket", _bucket(F.lit(turn))))
        asked = written(asked, "asked")
        granted = (asked.groupBy("to", "bucket").agg(F.sum("total").alias("need"))
                   .withColumn("upto", F.sum("need").over(Window.partitionBy("to").orderBy("bucket")))
                   .where(F.col("upto") <= _pick(free, F.col("to"))).select("to", "bucket"))
        moves = asked.join(granted, ["to", "bucket"]).select(*key, "to")
        none = moves.isEmpty()
        if not none:
            state = _moved(state, moves, key)
        discard(asked)
        if none and not large:
            break
        if none:
            large = 0
    return _laid(state, quota)


def _laid(state: DataFrame, quota: list[int]) -> DataFrame:
    """``state`` with a label for every part still cut: laid end to end over the room left, then fitted."""
    key = ["group", "part"]
    held, free = _free(state, quota)
    cut = held.where("m < total").select(*key, "total").distinct().withColumn("bucket", _bucket(F.lit(-1)))
    cut = written(cut, "cut")
    if cut.isEmpty():
        discard(cut)
        return state
    order = sorted(range(len(free)), key=lambda s: -free[s])
    ends = [sum(free[s] for s in order[:k + 1]) for k in range(len(order))]
    base = (cut.groupBy("bucket").agg(F.sum("total").alias("t"))
            .withColumn("base", F.sum("t").over(Window.orderBy("bucket")) - F.col("t")).drop("t"))
    end = F.col("base") + F.sum("total").over(Window.partitionBy("bucket").orderBy("group", "part").rowsBetween(Window.unboundedPreceding, 0))
    spot = sum((F.when(F.col("end") - F.col("total") >= e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    laid = (cut.join(base, "bucket").withColumn("end", end).withColumn("spot", spot)
            .withColumn("fits", F.col("end") <= _pick(ends, F.col("spot"))))
    laid = written(laid.select(*key, "total", F.when(F.col("fits"), _pick(order, F.col("spot"))).alias("to")), "laid")
    state = _moved(state, laid.where("to is not null").select(*key, "to"), key)
    used = _loads(laid.where("to is not null"), "to", "total", len(quota))
    free = [f - u for f, u in zip(free, used)]

    # at most one part per end of a room; so its rows here are at most one per pair of shards
    rest = laid.where("to is null").select(*key, F.col("total").alias("size"))
    nodes = state.join(F.broadcast(rest), key).select(*key, "home", "n", "size").collect()
    parts: dict = {}
    for r in nodes:
        parts.setdefault((r["size"], tuple(r["group"]), r["part"]), []).append((r["n"], r["home"]))
    to = []
    for (size, group, part), own in sorted(parts.items(), reverse=True):
        fit = [s for s in range(len(free)) if free[s] >= size]
        whole = min(fit, key=lambda s: free[s]) if fit else None  # the tightest room
        for n, home in sorted(own, reverse=True):
            room = sorted((s for s in range(len(free)) if free[s] >= n), key=lambda s: -free[s])
            at = whole if fit else next((t for g, p, _, t in reversed(to) if (g, p) == (group, part) and t in room), room[0] if room else -1)
            to.append((group, part, home, at))
            if at >= 0:
                free[at] -= n
    if to:
        rows = [F.struct(F.struct(F.lit(g[0]).alias("a"), F.lit(g[1]).alias("b")).alias("group"), F.lit(p).cast(state.schema["part"].dataType).alias("part"),
                         F.lit(h).alias("home"), F.lit(t).alias("to")) for g, p, h, t in to]
        state = _moved(state, F.broadcast(state.sparkSession.range(1).select(F.inline(F.array(*rows)))), [*key, "home"])
    discard(cut)
    discard(laid)
    return state


def shard(docs: DataFrame, keep: list[str] | None = None, shards: int = 16, rounds: int = 12) -> DataFrame:
    """``row`` (the kept columns), size, text_crc32, shard and slot of every document; counts are at most one apart."""
    keep = docs.columns if keep is None else keep
    body = F.coalesce(col(docs, "text"), F.lit(""))
    rows = written(docs.select(
        F.struct(*[col(docs, c).alias(c) for c in keep]).alias("row"),
        (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body, F.length(body)).alias("b")).alias("group"),
        F.xxhash64(F.monotonically_increasing_id()).alias("u")), "rows")
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    chunk = max(1, n // shards)
    # groups of more than a shard: fewer than shards of them, a bound that makes them safe to broadcast
    large = rows.groupBy("group").agg(F.count("*").alias("members")).where(F.col("members") > chunk)
    placed = (rows.join(F.broadcast(large), "group", "left")
              .withColumn("part", F.coalesce(F.pmod("u", F.ceil(F.col("members") / chunk)), F.lit(0)))
              .withColumn("home", F.pmod(F.xxhash64("u"), F.lit(shards)).cast("int")))
    # rows of a group meet only as counts: a large group is a few rows from each task
    nodes = placed.groupBy("group", "part", "home").agg(F.count("*").alias("n"))
    linked = nodes.withColumn("members", F.sum("n").over(Window.partitionBy("group"))).where("members > 1").drop("members")
    labels = propagate(linked, quota, rounds).drop("n", "total")
    labelled = written(placed.join(labels, ["group", "part", "home"], "left")
                       .select("row", "size", "text_crc32", "u", F.coalesce("label", F.lit(-1)).alias("label")), "labelled")

    # ranks within a label (-1: unlinked), counted in salted groups
    salts = max(1, -(-n // PER_GROUP))  # more of them for the unlinked rows, the largest class
    salted = labelled.withColumn("salt", F.pmod("u", F.when(F.col("label") < 0, 4 * salts).otherwise(salts)))
    base = (salted.groupBy("label", "salt").agg(F.count("*").alias("c"))
            .withColumn("base", F.sum("c").over(Window.partitionBy("label").orderBy("salt")) - F.col("c")).drop("c"))
    ranked = (salted.withColumn("own", F.row_number().over(Window.partitionBy("label", "salt").orderBy("u")) - 1)
              .join(base, ["label", "salt"]).withColumn("rank", F.col("base") + F.col("own")))
    count = {r[0]: r[1] for r in labelled.groupBy("label").count().collect()}  # one row per shard
    placed = [min(quota[s], count.get(s, 0)) for s in range(shards)]
    room = [quota[s] - placed[s] for s in range(shards)]
    room_to = [sum(room[:s]) for s in range(shards + 1)]
    # unlinked rows, then what quotas didn't hold, fill the rooms in order
    over_from = [count.get(-1, 0) + sum(count.get(t, 0) - placed[t] for t in range(s)) for s in range(shards)]
    label = F.greatest(F.col("label"), F.lit(0))
    stays = (F.col("label") >= 0) & (F.col("rank") < _pick(quota, label))
    fill = F.when(F.col("label") < 0, F.col("rank")).otherwise(_pick(over_from, label) + F.col("rank") - _pick(quota, label))
    to = sum((F.when(F.col("fill") >= room_to[s + 1], 1).otherwise(0) for s in range(shards - 1)), F.lit(0))
    return (ranked.withColumn("fill", F.when(~stays, fill))
            .withColumn("shard", F.when(F.col("fill").isNull(), F.col("label")).otherwise(to).cast("int"))
            .withColumn("slot", F.when(F.col("fill").isNull(), F.col("rank"))
                        .otherwise(_pick(placed, F.col("shard")) + F.col("fill") - _pick(room_to[:shards], F.col("shard"))).cast("long"))
            .select("row", "size", "text_crc32", "shard", "slot"))


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The contract's digest under the law ``rows``."""
    return shard(docs, ["doc_id"], shards).select(
        F.col("row.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
