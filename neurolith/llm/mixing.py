"""Mixing sources to target shares of all tokens, with capped repetition.

Documents are counted by source and exact token length. A source's budget is filled by whole passes and, for the rest, by
a part of each length count; what is then missing is closed by a bounded-knapsack over the documents left by length.
Documents are drawn by a seeded rank within their length.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurolith.functions.distributed import BROADCAST_ROWS, bits_for, cut_lineage, hot_keys, lookup, salted_rank
from neurolith.llm.tokens import DEFAULT_VOCABULARY, sized


def source_name(source: Column) -> Column:
    """One spelling: lower case, words joined by underscores."""
    return F.regexp_replace(F.trim(F.lower(source)), r"[\s_\-]+", "_")


def subset_sum(counts: dict[int, int], budget: int, window: int = 1 << 15) -> dict[int, int]:
    """How many of each length to take so that the sum comes close below ``budget``.

    First the same part of every length count, rounded down, then the largest lengths that still fit until at most about
    ``window`` is missing, then an exact bounded knapsack over all documents left for the rest (a bit set per item; counts in binary
    parts). The knapsack is exact for that rest; as the first two steps are not taken back, the sum is the best of all only
    where the budget is below ``window``. What can be missing at last is less than the shortest document left, else nothing fits.
    """
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    take = {n: c * budget // total for n, c in counts.items()}
    missing = budget - sum(n * c for n, c in take.items())
    for n in sorted(counts, reverse=True):
        if missing < window:
            break
        more = min(counts[n] - take[n], (missing - window) // n + 1)
        if more > 0:
            take[n] += more
            missing -= n * more
    parts = []
    for n in sorted(counts):
        left, k = min(counts[n] - take[n], missing // n), 1
        while left > 0:
            parts.append((n, min(k, left)))
            left -= k
            k *= 2
    mask, reach, states = (1 << (missing + 1)) - 1, 1, []
    for n, k in parts:
        states.append(reach)
        reach = (reach | reach << n * k) & mask
        if reach >> missing & 1:
            break
    at = reach.bit_length() - 1
    for (n, k), before in zip(reversed(parts[: len(states)]), reversed(states), strict=True):
        if not before >> at & 1:
            take[n] += k
            at -= n * k
    return take


def plan_mix(targets: list[tuple[str, float, int]], counts: dict[str, dict[int, int]]) -> tuple[int, dict[str, tuple[int, dict[int, int]]]]:
    """(tokens of the mix, per source: whole passes, and what to take by length in one more pass).

    The mix is as large as the scarcest present source allows at its share. Sources without documents get nothing; the
    others keep their shares among themselves.
    """
    have = {s: sum(n * c for n, c in counts.get(s, {}).items()) for s, _, _ in targets}
    present = [(s, share, max(1, most)) for s, share, most in targets if share > 0 and have[s] > 0]
    whole = sum(share for _, share, _ in present)
    if not present:
        return 0, {}
    size = int(min(have[s] * most / (share / whole) for s, share, most in present))
    plan = {}
    for s, share, most in present:
        budget = min(round(size * share / whole), have[s] * most)
        passes, rest = divmod(budget, have[s])
        plan[s] = (passes, subset_sum(counts[s], rest) if rest and passes < most else {})
    return size, plan


PLAN = "source string, tokens int, uses array<struct<mix_id: string, passes: int, extra: bigint>>"
#: Most rows of the table of targets, which are parameters and handled on the driver.
MOST_TARGETS = 10_000


def draw(docs: DataFrame, targets: DataFrame, seed: int = 17, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(mix_id, source, doc_id, tokens, repeats): the documents of each mix and how often each is used.

    Counts by source and token length reach the driver: at most (named sources) x (tokens of the longest text) rows.
    Null sources and texts without tokens are never drawn; sources spelled in several ways are one. Of a target given
    twice the largest share counts.
    """
    spark = docs.sparkSession
    t = targets.filter("mix_id is not null and source is not null and target_share is not null").withColumn("source", source_name(F.col("source")))
    t = t.groupBy("mix_id", "source").agg(F.max(F.struct("target_share", F.coalesce("max_repeats", F.lit(1)).alias("m"))).alias("x")).limit(MOST_TARGETS + 1).collect()
    if len(t) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    mixes = defaultdict(list)
    for r in t:
        mixes[r["mix_id"]].append((r["source"], float(r["x"]["target_share"]), int(r["x"]["m"])))
    named = sorted({r["source"] for r in t})
    d = sized(docs.filter("source is not null").withColumn("source", source_name(F.col("source"))).filter(F.col("source").isin(named)), keep=("source",), path=path)
    d = cut_lineage(d)
    counts: dict[str, dict[int, int]] = defaultdict(dict)
    for r in d.groupBy("source", "tokens").count().toLocalIterator():
        counts[r["source"]][int(r["tokens"])] = r["count"]
    uses = defaultdict(list)
    for mix, wanted in sorted(mixes.items()):
        _, plan = plan_mix(sorted(wanted), counts)
        for source, (passes, extra) in plan.items():
            for n in counts[source]:
                if passes or extra.get(n, 0):
                    uses[source, n].append((mix, passes, extra.get(n, 0)))
    plan = spark.createDataFrame([(*k, u) for k, u in uses.items()], PLAN)
    keys, small = ["source", "tokens"], sum(map(len, uses.values())) <= BROADCAST_ROWS
    ranked = salted_rank(d, keys, F.xxhash64(F.lit(seed), "doc_id"), "rank", bits_for(sum(n for c in counts.values() for n in c.values())))
    placed = ranked.join(F.broadcast(plan), keys) if small else lookup(ranked, plan, keys, hot_keys(d, keys))
    out = placed.withColumn("u", F.explode("uses"))
    repeats = F.col("u.passes") + F.when(F.col("rank") < F.col("u.extra"), 1).otherwise(0)
    return out.select("u.mix_id", "source", "doc_id", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def reached(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_id, source, target_share, actual_share, tokens, documents, most_repeats) for every target."""
    got = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    whole = got.groupBy("mix_id").agg(F.sum("tokens").alias("all"))
    t = targets.filter("mix_id is not null and source is not null").withColumn("source", source_name(F.col("source"))).groupBy("mix_id", "source").agg(F.max("target_share").alias("target_share"))
    x = t.join(got, ["mix_id", "source"], "left").join(whole, "mix_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return x.select("mix_id", "source", "target_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"), zero("tokens").alias("tokens"), zero("documents").alias("documents"), zero("most_repeats").alias("most_repeats"))
