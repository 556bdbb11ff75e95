"""Filling fixed-capacity containers with texts.

Harmonic packing: a text of size s belongs to class floor(capacity / s), and a container of class k takes exactly k texts,
so that the workers fill containers on their own, by rank alone. Exact sizes refine the classes: the counts by size (at
most one row per size up to the capacity) are planned once into patterns, each with a fixed count of texts per size, and
again every text finds its container by its rank within its size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neurolith.functions.distributed import BROADCAST_ROWS, bits_for, cut_lineage, hot_keys, lookup, salted_rank
from neurolith.llm.tokens import DEFAULT_VOCABULARY, sized


#: Most rows of a table of specs, which are parameters and become literals of the plan.
MOST_SPECS = 200


def items(docs: DataFrame, specs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(spec_id, capacity, doc_id, part, size): the pieces to place, per spec.

    A text above the capacity gives full parts and one rest; every other text is one part. Texts without tokens (null,
    empty) are not placed. Specs without a positive capacity are left out; of a repeated spec_id the largest counts.
    """
    s = specs.filter("capacity_tokens > 0 and spec_id is not null").groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    known = sorted((r["spec_id"], int(r["capacity"])) for r in s.limit(MOST_SPECS + 1).collect())
    if len(known) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    each = "array<struct<spec_id:string,capacity:int>>"
    listed = F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).alias("capacity")) for i, c in known]) if known else F.lit(None)
    d = cut_lineage(sized(docs, path=path))
    count = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    x = d.withColumn("s", F.explode(listed.cast(each))).select("s.spec_id", "s.capacity", "doc_id", "tokens")
    x = x.select("spec_id", "capacity", "doc_id", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    return x.select("spec_id", "capacity", "doc_id", "part", F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")).alias("size"))


def plan_containers(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int]]:
    """Rows (size, first rank, number, first container): runs of equal texts to runs of containers, one text each.

    Best fit over runs: sizes descending, always into the fullest containers that still take the size; new containers of
    floor(capacity / size) texts each (the harmonic count) for what is left. Containers of equal room are one run or a few.
    """
    rows: list[tuple[int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first container, number)
    order: list[int] = []
    opened = 0

    def put(room: int, first: int, number: int) -> None:
        if room > 0 and number > 0:
            if not rooms[room]:
                insort(order, room)
            rooms[room].append((first, number))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            i = bisect_left(order, size)
            if i == len(order):
                break
            room = order[i]
            first, number = rooms[room].pop()
            if not rooms[room]:
                order.pop(i)
            each = min(room // size, max(1, left // number))  # texts per container of this run
            take = min(number, left)
            for k in range(each):
                rows.append((size, rank + k * take, take, first))
            rank, left = rank + each * take, left - each * take
            put(room - each * size, first, take)
            put(room, first + take, number - take)
        if left:
            each = capacity // size
            full, rest = divmod(left, each)
            for k in range(each if full else 0):
                rows.append((size, rank + k * full, full, opened))
            rank += each * full
            put(capacity - each * size, opened, full)
            opened += full
            for k in range(rest):
                rows.append((size, rank + k, 1, opened))
            if rest:
                put(capacity - rest * size, opened, 1)
                opened += 1
    return rows


PLAN = "spec_id string, size int, runs array<struct<from_rank: bigint, number: bigint, first_container: bigint>>"


def pack(docs: DataFrame, specs: DataFrame, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(spec_id, container, doc_id, part, size) for every spec and text.

    The plan is made from counts by size: at most ``capacity`` rows a spec reach the driver, whatever the number of
    texts. Containers are numbered from 0 within a spec. Deterministic for given doc_ids. The plan is broadcast if its runs are
    at most ``BROADCAST_ROWS``; else sizes that very many parts share (full parts of long texts) are spread over copies of it.
    """
    spark = docs.sparkSession
    x = cut_lineage(items(docs, specs, path))
    per = defaultdict(dict)
    capacity: dict[str, int] = {}
    for r in x.groupBy("spec_id", "capacity", "size").count().toLocalIterator():
        per[r["spec_id"]][int(r["size"])] = r["count"]
        capacity[r["spec_id"]] = int(r["capacity"])
    runs = defaultdict(list)
    for s, c in sorted(per.items()):
        for size, *run in plan_containers(c, capacity[s]):
            runs[s, size].append(tuple(run))
    plan = spark.createDataFrame([(*k, sorted(r)) for k, r in runs.items()], PLAN)
    keys, small = ["spec_id", "size"], sum(map(len, runs.values())) <= BROADCAST_ROWS
    ranked = salted_rank(x, keys, F.xxhash64("doc_id", "part"), "rank", bits_for(sum(n for c in per.values() for n in c.values())))
    placed = ranked.join(F.broadcast(plan), keys) if small else lookup(ranked, plan, keys, hot_keys(x, keys))
    inside = F.filter("runs", lambda r: (r["from_rank"] <= F.col("rank")) & (F.col("rank") < r["from_rank"] + r["number"]))
    out = placed.withColumn("r", F.element_at(inside, 1))
    return out.select("spec_id", (F.col("r.first_container") + F.col("rank") - F.col("r.from_rank")).alias("container"), "doc_id", "part", "size")


def pack_harmonic(docs: DataFrame, specs: DataFrame, path: str = DEFAULT_VOCABULARY, classes: int = 64) -> DataFrame:
    """(spec_id, class, container, doc_id, part, size): the plain harmonic scheme, for comparison.

    A class-k container takes k texts; sizes below capacity / ``classes`` share the last class.
    """
    x = cut_lineage(items(docs, specs, path)).withColumn("class", F.least(F.floor(F.col("capacity") / F.col("size")), F.lit(classes)).cast("int"))
    ranked = salted_rank(x, ["spec_id", "class"], F.xxhash64("doc_id", "part"), "rank")
    return ranked.select("spec_id", "class", F.floor(F.col("rank") / F.col("class")).alias("container"), "doc_id", "part", "size")


def fill(packed: DataFrame, specs: DataFrame, keys: tuple[str, ...] = ("spec_id", "container")) -> DataFrame:
    """(spec_id, containers, tokens, share_used, fullest): how full the containers of each spec are."""
    one = packed.groupBy(*keys).agg(F.sum("size").alias("used"))
    caps = specs.groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    agg = one.groupBy("spec_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return agg.join(caps, "spec_id").select("spec_id", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("share_used"), "fullest", "capacity")


__all__ = ["fill", "items", "pack", "pack_harmonic", "plan_containers"]
