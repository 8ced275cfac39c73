"""Shards of near-equal bytes that keep linked documents together: balanced
label propagation as iterated Spark joins.

Documents are linked when their group key is equal (the query: equal texts). A
document starts in a shard drawn from its hash. Each round counts the members of
every (group, shard) cell, makes the fullest cell's shard the group's wanted
one, and lets the members elsewhere move there as far as the shard's quota goes:
capacity minus load, and half of the room that leaving members make. When more bytes
want in than fit, whole groups are admitted by the prefix sum of their bytes in the order
of a hash of the round; a group larger than a quarter of a shard is admitted member by
member, so even a third of all rows in one group spreads over shards. In the last round the
groups that are still cut follow their wanted shard without a quota. Then shards above
the mean give to those below it: unlinked documents first, then whole groups, laid on
one line, so that only groups at a border of a shard are cut. Positions there and slots come
from two-level prefix sums (hash buckets, then inside a bucket), never from one
ordered task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendspark.llm.common import staged
from lendspark.session import ensure_checkpoint_dir

BUCKET_ROWS = 20_000      # expected rows of one (shard, bucket) window


def _hash01(*cols) -> Column:
    """Uniform in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _by_shard(values: dict[int, float], n: int) -> Column:
    """Lookup of a per-shard number (bounded by the shard count)."""
    return F.element_at(F.array(*[F.lit(float(values.get(s, 0.0))) for s in range(n)]),
                        F.col("want") + 1)


def _running(df: DataFrame, keys: list[str], bucket: Column, order: list, value: Column,
             out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in (bucket, order)."""
    df = df.withColumn("_b", bucket)
    cells = df.groupBy(*keys, "_b").agg(F.sum(value).alias("_v"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*keys, "_b", F.coalesce(F.sum("_v").over(w), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, -1)
    return (df.withColumn("_i", F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(offsets, [*keys, "_b"])
            .withColumn(out, F.col("_o") + F.col("_i")).drop("_b", "_i", "_o"))


def balanced_shards(docs: DataFrame, n_shards: int = 16, rounds: int = 4, slack: float = 0.02,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, size, text_crc32, law, shard, slot, grown_shard).

    Size is the text's UTF-8 bytes plus 1 (null text: 1; its CRC is that of the
    empty text). Law is ``bytes``: shard sizes differ by about one document.
    Documents with equal texts (null and empty ones are no group) are linked.
    Slots number each shard's documents from 0. Null ids and repeated rows are
    kept, one slot each. Other columns are not read. Empty table: empty result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"),
                       (F.octet_length(t) + 1).cast("long").alias("size"),
                       F.crc32(t.cast("binary")).alias("crc"),
                       F.xxhash64(t).alias("g"))
    groups = staged(base.where("size > 1").groupBy("g", "crc", "size")
                    .agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shard-groups")
    rows = (base.join(groups, ["g", "crc", "size"], "left")
            .withColumn("members", F.coalesce("members", F.lit(1)).cast("long"))
            .withColumn("shard", F.pmod(F.xxhash64("id", "g"), F.lit(n_shards)).cast("int")))
    rows = staged(rows, "shard-rows")
    total = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    total_bytes, n_rows = float(total["b"] or 0), int(total["n"])
    capacity = total_bytes / n_shards
    linked = rows.where("members > 1")
    n_groups = groups.count()

    key = ["g", "crc", "size"]
    for r in range(rounds):
        load = {x["shard"]: float(x["b"]) for x in
                rows.where("members = 1").groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        for x in linked.groupBy("shard").agg(F.sum("size").alias("b")).collect():
            load[x["shard"]] = load.get(x["shard"], 0.0) + float(x["b"])
        cells = linked.groupBy(*key, "shard").agg(F.count(F.lit(1)).alias("n"))
        want = cells.groupBy(*key).agg(
            F.max_by("shard", F.struct("n", F.xxhash64("g", "shard", F.lit(r)))).alias("want"))
        asked = staged(linked.join(want, key), f"shard-round{r}")
        leaving = {x["shard"]: float(x["b"]) for x in
                   asked.where("shard != want").groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        # quota: free room, and some of the room that leaving members are sure to make
        quota = {s: math.inf if r == rounds - 1 else
                 max(0.0, capacity * (1 + slack) - load.get(s, 0.0) + 0.5 * leaving.get(s, 0.0)) for s in range(n_shards)}
        big = F.col("members") * F.col("size") > F.lit(capacity / 4)
        moving = asked.where("shard != want").groupBy(*key, "want", "members").agg(F.sum("size").alias("bytes"))
        buckets = max(4, math.ceil(n_groups / n_shards / BUCKET_ROWS))
        queue = _running(moving, ["want"], F.pmod(F.xxhash64("g", F.lit(r)), F.lit(buckets)).cast("int"),
                         [F.xxhash64("g", F.lit(r)), "g", "crc", "size"], F.col("bytes"), "ahead")
        fits = (_by_shard(quota, n_shards) - F.col("ahead")) / F.col("bytes")
        share = F.when(big, F.least(F.lit(1.0), F.greatest(F.lit(0.0), fits if r < rounds - 1 else F.lit(0.0)))) \
            .otherwise((fits >= 1).cast("double"))
        linked = (asked.join(queue.select(*key, share.alias("share")), key, "left")
                  .withColumn("shard", F.when(_hash01("id", "g", F.lit(r)) < F.col("share"), F.col("want"))
                              .otherwise(F.col("shard"))).drop("want", "share"))
    placed = staged(rows.where("members = 1").unionByName(linked), "shard-placed")

    # Last step: exact evening. Unlinked documents leave first, then whole groups.
    load = {x["shard"]: float(x["b"]) for x in
            placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    over = {s: load.get(s, 0.0) - capacity for s in range(n_shards)}
    n_buckets = max(4, math.ceil(n_rows / n_shards / BUCKET_ROWS))
    big = F.col("members") * F.col("size") > F.lit(capacity / 4)
    leave_order = (F.when(F.col("members") == 1, 0).when(big, n_buckets).otherwise(2 * n_buckets)
                   + F.pmod(F.when(big | (F.col("members") == 1), F.xxhash64("g", "id")).otherwise(F.xxhash64("g")),
                            F.lit(n_buckets)).cast("int"))
    placed = placed.withColumn("want", F.col("shard"))
    out_limit = _by_shard({s: max(0.0, v) for s, v in over.items()}, n_shards)
    ranked = _running(placed, ["shard"], leave_order, ["g", "crc", "size", "id"], F.col("size"), "pos")
    # givers' surplus is laid on one line, takers' room on the same line
    starts, at = {}, 0.0
    for s in range(n_shards):
        starts[s] = at
        at += max(0.0, over[s])
    room, at = [], 0.0
    for s in range(n_shards):
        if over[s] < 0:
            at += -over[s]
            room.append((at, s))
    line = _by_shard(starts, n_shards) + F.col("pos") + F.col("size") / 2
    taker = F.lit(room[-1][1] if room else 0)
    for end, s in reversed(room):
        taker = F.when(line < F.lit(end), F.lit(s)).otherwise(taker)
    moves = (F.col("pos") + F.col("size") / 2) < out_limit
    even = ranked.withColumn("shard", F.when(moves, taker).otherwise(F.col("shard")).cast("int"))
    even = staged(even.select("id", "size", "crc", "g", "members", "shard"), "shard-even")
    bucket = F.pmod(F.xxhash64("id", "g"), F.lit(n_buckets)).cast("int")
    slots = _running(even, ["shard"], bucket, ["id", "g", "size"], F.lit(1), "slot")
    return slots.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"),
                        F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
                        F.lit(None).cast("int").alias("grown_shard"),
                        F.col("members").alias("group_members"))
