"""Problem 8: filling containers of fixed capacity with texts, sized in tokens.

What fits together depends on lengths alone, of which there are at most as many as the
capacity has tokens. So the corpus is reduced to a histogram of lengths (pre-aggregated
in each task, at most one row per length), and the plan is made on that: a pattern of
lengths and how many containers repeat it. A container is begun with the longest item
left. The lengths left and the sums of two and three of them are hashed by their sum; the
gap is looked up there, and a combination that fills it exactly and of which enough are
left is consumed, as often as the counts allow. Where there is none, the longest item
that fits is added (best fit) and the search goes on with the smaller gap.

The items then take their places by rank: within each length they are numbered in salted
groups, so that a length shared by a third of all items is no hot group, and the plan
tells each rank its container. A plan of up to ``PLAN_BYTES`` is sent to all executors;
a greater one is written as a table and joined by length and range of ranks.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Scratch, fanout, ship
from .tokenization import counted


@dataclass
class Plan:
    """Slots in the order of (length, first rank): the ranks of a length from ``first`` on go ``each`` to a container, beginning with ``container``."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    containers: int = 0


class Sums:
    """The lengths left, hashed by the sums of one, two and three of them.

    A sum's combinations are entered when the sum is first asked for, in the order of
    their longest part, and the place up to which they are used up is kept. As counts only
    fall, what is used up stays so, and each combination of a sum is passed over once.
    """

    def __init__(self, histogram: dict[int, int]):
        self.left = {x: n for x, n in histogram.items() if n > 0}
        self._sizes = sorted(self.left)
        self._live = list(self._sizes)
        self._pairs: dict[int, int] = {}  # sum -> place of the longest part not used up
        self._triples: dict[int, int] = {}

    def longest(self, room: int, used: dict[int, int]) -> int | None:
        """The longest length of at most ``room`` that is left."""
        k = bisect_right(self._live, room) - 1
        while k >= 0:
            x = self._live[k]
            if self.left[x] > used.get(x, 0):
                return x
            if self.left[x] == 0:
                del self._live[k]
            k -= 1
        return None

    def filling(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """One, two or three lengths left that fill the gap exactly, the longest first."""
        if self.left.get(gap, 0) > used.get(gap, 0):
            return [gap]
        return self._pair(gap, used) or self._triple(gap, used)

    def _pair(self, gap: int, used: dict[int, int]) -> list[int] | None:
        sizes, left = self._sizes, self.left
        k = self._pairs.get(gap)
        if k is None:
            k = bisect_left(sizes, gap) - 1
        kept = True
        while k >= 0 and sizes[k] * 2 >= gap:
            a = sizes[k]
            b = gap - a
            n = left.get(b, 0)
            if not n or not left[a] or a == b and n < 2:
                k -= 1  # used up for good
                if kept:
                    self._pairs[gap] = k
                continue
            if left[a] - used.get(a, 0) > (a == b) and n > used.get(b, 0):
                if kept:
                    self._pairs[gap] = k
                return [a, b]
            kept = False  # only this container has taken it
            k -= 1
        if kept:
            self._pairs[gap] = k
        return None

    def _triple(self, gap: int, used: dict[int, int]) -> list[int] | None:
        sizes, left = self._sizes, self.left
        k = self._triples.get(gap)
        if k is None:
            k = bisect_left(sizes, gap - 1) - 1
        kept = True
        while k >= 0 and sizes[k] * 3 >= gap:
            a = sizes[k]
            if left[a] and self._pair(gap - a, {}) is not None:
                if left[a] > used.get(a, 0) and (two := self._pair(gap - a, used | {a: used.get(a, 0) + 1})):
                    if kept:
                        self._triples[gap] = k
                    return sorted([a, *two], reverse=True)
                kept = False
            elif kept:
                self._triples[gap] = k - 1
            k -= 1
        return None


def plan_containers(histogram: dict[int, int], capacity: int) -> Plan:
    """``histogram``: items per length, none longer than ``capacity``. No container is overfull, and none is left that could take the next item."""
    stock, plan, ranks = Sums(histogram), Plan(), _Ranks()
    while (top := stock.longest(capacity, {})) is not None:
        used, gap = {top: 1}, capacity - top
        while gap:
            exact = stock.filling(gap, used)
            more = exact or ([x] if (x := stock.longest(gap, used)) else [])
            if not more:
                break
            for x in more:
                used[x] = used.get(x, 0) + 1
            gap -= sum(more)
        times = min(stock.left[x] // k for x, k in used.items())
        for x, k in used.items():
            plan.length.append(x)
            plan.first.append(ranks.take(x, k * times))
            plan.each.append(k)
            plan.container.append(plan.containers)
            stock.left[x] -= k * times
        plan.containers += times
    return plan


class _Ranks:
    """The next free rank of each length."""

    def __init__(self) -> None:
        self._next: dict[int, int] = {}

    def take(self, length: int, n: int) -> int:
        at = self._next.get(length, 0)
        self._next[length] = at + n
        return at


def pieces(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budget``, ``capacity``, ``doc_id``, ``piece``, ``start_token``, ``n_tokens``: each text as one piece, or cut where it alone exceeds the capacity.

    ``budgets`` is a fixed table of a few rows and becomes a literal. Budgets without a
    positive capacity hold nothing and are left out, as are items of no tokens.
    """
    fixed = [(r.budget, int(r.capacity_tokens)) for r in budgets.where("capacity_tokens > 0").orderBy("budget").collect()]
    if not fixed:
        return sizes.select(F.lit("").alias("budget"), F.lit(1).cast("bigint").alias("capacity"), "doc_id", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("start_token"), "n_tokens").where("false")
    each = F.inline(F.array(*[F.struct(F.lit(b).alias("budget"), F.lit(c).cast("bigint").alias("capacity")) for b, c in fixed]))
    items = sizes.where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("total"), each)
    cut = items.select("budget", "capacity", "doc_id", "total", F.explode(F.expr("sequence(0L, (total - 1) div capacity)")).alias("piece"))
    return cut.select("budget", "capacity", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start_token"), F.least("capacity", F.col("total") - F.col("piece") * F.col("capacity")).alias("n_tokens"))


def packed(spark: SparkSession, documents: DataFrame, budgets: DataFrame, plan_bytes: int | None = None) -> DataFrame:
    """``budget``, ``container_id``, ``doc_id``, ``piece``, ``start_token``, ``n_tokens``: every piece with its container, numbered from 0 in each budget.

    Null and empty texts are no items. Rows repeated in ``documents`` are items of their own.
    """
    ship(spark)
    plan_bytes = PLAN_BYTES if plan_bytes is None else plan_bytes
    scratch = Scratch(spark, "packing")
    sizes = scratch.table(counted(documents), "sizes").df
    items = pieces(sizes, budgets)
    salts = fanout(spark)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    groups = scratch.table(salted.groupBy("budget", "capacity", "n_tokens", "salt").agg(F.count(F.lit(1)).alias("n")), "groups").df
    histogram: dict[tuple[str, int], dict[int, int]] = {}
    for r in groups.groupBy("budget", "capacity", "n_tokens").agg(F.sum("n").alias("n")).collect():  # at most one row per length up to the capacity
        histogram.setdefault((r.budget, r.capacity), {})[r.n_tokens] = r.n
    plans = {b: plan_containers(h, c) for (b, c), h in histogram.items()}
    before = groups.withColumn("before", F.sum("n").over(Window.partitionBy("budget", "n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    local = F.row_number().over(Window.partitionBy("budget", "n_tokens", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("local", local).join(before.select("budget", "n_tokens", "salt", "before"), ["budget", "n_tokens", "salt"])
    ranked = ranked.select("budget", "doc_id", "piece", "start_token", "n_tokens", (F.col("before") + F.col("local")).alias("rank"))
    if sum(len(p.length) for p in plans.values()) * 4 * 8 > plan_bytes:
        return _joined(spark, scratch, ranked, plans)
    shared = spark.sparkContext.broadcast({b: _lookup(p) for b, p in plans.items()})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for budget, rows in batch.groupby("budget", sort=False):
                keys, first, each, container = shared.value[budget]
                rank = rows["rank"].to_numpy()
                slot = np.searchsorted(keys, rows["n_tokens"].to_numpy() * _RANKS + rank, side="right") - 1
                rows = rows.assign(container_id=container[slot] + (rank - first[slot]) // each[slot])
                yield rows[["budget", "container_id", "doc_id", "piece", "start_token", "n_tokens"]]

    return ranked.mapInPandas(place, "budget string, container_id bigint, doc_id bigint, piece bigint, start_token bigint, n_tokens bigint")


def _joined(spark: SparkSession, scratch: Scratch, ranked: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """The same by a join with the plan as a table: each slot by budget, length and range of ranks."""
    rows = [pd.DataFrame({"budget": b, "n_tokens": p.length, "first": p.first, "each": p.each, "container": p.container}) for b, p in plans.items()]
    slots = spark.createDataFrame(pd.concat(rows), "budget string, n_tokens bigint, first bigint, each bigint, container bigint")
    slots = slots.withColumn("end", F.lead("first", 1, 1 << 62).over(Window.partitionBy("budget", "n_tokens").orderBy("first")))
    slots = scratch.table(slots, "plan").df
    placed = ranked.alias("r").join(slots.alias("s"), (F.col("r.budget") == F.col("s.budget")) & (F.col("r.n_tokens") == F.col("s.n_tokens")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    return placed.select("r.budget", (F.col("container") + F.expr("(rank - first) div each")).alias("container_id"), "doc_id", "piece", "start_token", "r.n_tokens")


#: The greatest plan sent to all executors, in bytes.
PLAN_BYTES = 64 << 20

_RANKS = 1 << 42


def _lookup(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    length, first, each, container = (np.array(x, dtype=np.int64) for x in (plan.length, plan.first, plan.each, plan.container))
    key = length * _RANKS + first
    order = np.argsort(key, kind="stable")
    return key[order], first[order], each[order], container[order]


def fill(assigned: DataFrame, budgets: DataFrame) -> DataFrame:
    """``budget``, ``containers``, ``tokens``, ``unused``: how well each budget's containers are filled."""
    used = assigned.groupBy("budget", "container_id").agg(F.sum("n_tokens").alias("used"))
    per = used.groupBy("budget").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"))
    caps = budgets.select("budget", "capacity_tokens")
    return per.join(caps, "budget").select("budget", "containers", "tokens", (F.col("containers") * F.col("capacity_tokens") - F.col("tokens")).alias("unused"))
