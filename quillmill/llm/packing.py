"""Filling fixed-capacity containers with items (minimum bin slack over length counts).

Only how many items have which length matters for filling, and there are at most ``capacity`` lengths, so the plan is
made on the driver from a histogram whose size does not depend on the data. Each step takes the largest remaining
length and asks a subset-sum bitset for the multiset of remaining lengths that comes closest to the capacity; lengths
are tried from large to small with counts split in powers of two, and the choice is read back from the stored bitsets.
The step is repeated as often as the counts allow, so a step exhausts a length and the number of steps is at most
capacity * (1 + ln capacity), whatever the number of items. The items then find their container from their rank among
the items of their length, which is counted per (length, bucket) so that a frequent length is never one task.

Defined results: items of size 0 or null need no room and are spread over the containers; an item larger than the
capacity becomes full containers of its own plus a remainder that is packed like an item; all others stay whole. An
empty table gives no rows. The result does not depend on the order or partitioning of the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Items of one length are ranked in at least so many parts, and in parts of about so many rows.
BUCKETS, PART_ROWS = 64, 500_000


def fill(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) with how many containers use them; every pattern fits the capacity."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    order = sorted(left, reverse=True)
    plan: list[tuple[dict[int, int], int]] = []
    first = 0
    while True:
        while first < len(order) and not left.get(order[first]):
            first += 1
        if first == len(order):
            return plan
        seed = order[first]
        room = capacity - seed
        take = {seed: 1}
        if room:
            for s, k in _closest(order, first, left, seed, room).items():
                take[s] = take.get(s, 0) + k
        times = min(left[s] // k for s, k in take.items())
        plan.append((take, times))
        for s, k in take.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        if len(order) > 64 and len(left) * 2 < len(order):
            order, first = sorted(left, reverse=True), 0


def _closest(order: list[int], first: int, left: dict[int, int], seed: int, room: int) -> dict[int, int]:
    """The copies of remaining lengths whose sum is the largest reachable one within ``room``."""
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for i in range(first, len(order)):
        s = order[i]
        if s > room:
            continue
        n = min(left.get(s, 0) - (s == seed), room // s)
        part = 1
        while n > 0:
            k = min(part, n)
            more = (reach | reach << (k * s)) & mask
            if more != reach:
                steps.append((reach, s, k))
                reach = more
                if reach & goal:
                    return _read_back(steps, room)
            n -= k
            part *= 2
    return _read_back(steps, reach.bit_length() - 1)


def _read_back(steps: list[tuple[int, int, int]], total: int) -> dict[int, int]:
    take: dict[int, int] = {}
    for reach, s, k in reversed(steps):
        if not reach >> total & 1:
            take[s] = take.get(s, 0) + k
            total -= k * s
    return take


def _tables(plan: list[tuple[dict[int, int], int]], capacity: int) -> tuple[np.ndarray, ...]:
    """By length, in order of the plan: first rank, first container and copies per container."""
    rows: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]
    used = [0] * (capacity + 1)
    base = 0
    for take, times in plan:
        for s, k in take.items():
            rows[s].append((used[s], base, k))
            used[s] += k * times
        base += times
    at = np.cumsum([0] + [len(r) for r in rows]).astype(np.int64)
    flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, 3)
    return at, flat[:, 0].copy(), flat[:, 1].copy(), flat[:, 2].copy(), np.int64(base)


def assign_containers(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, n_tokens, container_id) for every item; ``sizes`` is read several times, so pass a cut table."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    item = sizes.select(F.col(key).alias("_key"), n.alias("_n"))
    rest = F.when(F.col("_n") > capacity, F.col("_n") % capacity).otherwise(F.col("_n")).cast("int")
    whole = F.when(F.col("_n") > capacity, F.floor(F.col("_n") / capacity)).otherwise(0).cast("int")
    item = item.select("_key", "_n", rest.alias("_rest"), whole.alias("_whole"))
    hist = {r["_rest"]: r["n"] for r in item.filter("_rest > 0").groupBy("_rest").agg(F.count("*").alias("n")).collect()}
    tables = sizes.sparkSession.sparkContext.broadcast(_tables(fill(hist, capacity), capacity))

    full = item.filter("_whole > 0").select("_key", F.explode(F.sequence(F.lit(1), F.col("_whole"))).alias("piece_no"))
    full = full.select(F.col("_key").alias(key), "piece_no", F.lit(capacity).alias("n_tokens"), F.concat(F.lit("full-"), F.col("_key").cast("string"), F.lit("-"), F.col("piece_no").cast("string")).alias("container_id"))

    parts = max(BUCKETS, sum(hist.values()) // PART_ROWS)
    bucket = F.pmod(F.xxhash64("_key"), F.lit(parts)).cast("int")
    loose = item.filter("_rest > 0 OR _whole = 0").withColumn("_b", bucket)
    per = loose.groupBy("_rest", "_b").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("_rest").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("_rest", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    ranked = loose.withColumn("_r", F.row_number().over(Window.partitionBy("_rest", "_b").orderBy("_key"))).join(per, ["_rest", "_b"])
    ranked = ranked.select(F.col("_key").alias(key), (F.col("_whole") + 1).alias("piece_no"), F.col("_rest").alias("n_tokens"), (F.col("_r") - 1 + F.col("_before")).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, start, base, copies, total = tables.value
        for b in batches:
            length = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            where = np.empty(len(length), np.int64)
            for s in np.unique(length):
                rows = np.nonzero(length == s)[0]
                if s == 0:
                    where[rows] = rank[rows] % max(int(total), 1)
                    continue
                lo, hi = at[s], at[s + 1]
                i = lo + np.searchsorted(start[lo:hi], rank[rows], "right") - 1
                where[rows] = base[i] + (rank[rows] - start[i]) // copies[i]
            ids = pa.array([f"mix-{x}" for x in where.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), ids], names=[key, "piece_no", "n_tokens", "container_id"])

    fields = ranked.schema
    schema = StructType([fields[key], fields["piece_no"], fields["n_tokens"], StructField("container_id", StringType())])
    return full.unionByName(ranked.mapInArrow(place, schema))


def fill_report(assigned: DataFrame, by: str, capacity: str) -> DataFrame:
    """Containers, tokens and the share of room used, per limit."""
    per = assigned.groupBy(by, capacity, "container_id").agg(F.sum("n_tokens").alias("tokens"))
    return per.groupBy(by, capacity).agg(
        F.count("*").alias("containers"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count("*") * F.col(capacity)), 4).alias("fill"),
    )
