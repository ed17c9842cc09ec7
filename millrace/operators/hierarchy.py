"""Problem 2: parent-child links to full hierarchies.

1. Links: each agent gets one parent, or none.
2. Peeling: the nodes that have a descendant k generations below are the image of the
   k-fold parent map, that is what is left when the leaves have been peeled k times.
   Squaring the map peels twice as many layers each round, and only the nodes left take
   part in the next one; when nothing more comes off, the rest are the cycles.
3. The smallest id of a cycle comes from doubling along it; then the cycles are cut, so
   that each of their nodes is the root of what hangs below it.
4. Euler tour: each node has an entry (+1) and an exit (-1), linked into one list per
   tree. Siblings are chained in pieces, salted or in ranges of their order, so that a
   parent of a third of all rows is no hot group.
5. List ranking: one element in ``SPARSE`` is a splitter; by pointer doubling each element
   finds the sum, the length and the splitter of the stretch it begins, which takes a few
   rounds as stretches are short. The splitters, now a list some times shorter, are
   ranked in the same way, and their ranks added to those of the elements between them.
   A list of at most ``BASE`` elements is ranked within one task.
6. Entries and exits give depth, root and the interval that holds all descendants.

So the work is that of a few rounds over the elements, whatever the shape of the trees;
each round is a written table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.instants import is_blank
from ..session import Scratch, Table, fanout, ship

#: The most links or list elements that one task takes on; greater sets are worked on in rounds.
BASE = 1 << 18
#: One list element in so many is a splitter.
SPARSE = 8


def agent_links(agents: DataFrame, listed: DataFrame) -> DataFrame:
    """``id`` and ``parent_id`` of each agent of either table, one row each.

    The latest listing (``listed_at``, then ``listing_id``) decides; without one the
    agent's row does (of repeated rows the last ``row_id``). A blank parent, or one that
    is in neither table, is null. Rows with a null id are no agents.
    """
    a = agents.where("id IS NOT NULL").groupBy("id").agg(F.max_by("parent_id", F.coalesce("row_id", F.lit(-1))).alias("parent_id"))
    order = F.struct("listed_at", "listing_id")
    b = listed.where("id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("parent_id"), order).alias("l"))
    links = a.join(b, "id", "full_outer").select("id", F.when(F.col("l").isNotNull(), F.col("l.parent_id")).otherwise(F.col("parent_id")).alias("parent_id"))
    return links.select("id", F.when(~is_blank(F.col("parent_id")), F.col("parent_id")).alias("parent_id"))


def _rings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``n``, ``label`` of the nodes on cycles, of few links (``n``, ``p``, ``id`` of n): leaves are peeled until none is left."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    links = pd.concat(held)
    up, names = dict(zip(links["n"], links["p"], strict=True)), dict(zip(links["n"], links["id"], strict=True))
    below: dict[int, int] = {}
    for p in up.values():
        below[p] = below.get(p, 0) + 1
    leaves = [n for n in up if not below.get(n)]
    while leaves:
        p = up.pop(leaves.pop())
        below[p] -= 1
        if not below[p] and p in up:
            leaves.append(p)
    labels: dict[int, str] = {}
    for n in up:
        ring = []
        while n not in labels and (not ring or n != ring[0]):
            ring.append(n)
            n = up[n]
        labels.update(dict.fromkeys(ring, min((names[x] for x in ring), default="")))
    if labels:
        yield pd.DataFrame({"n": list(labels), "label": list(labels.values())})


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks of the elements of a short list: sum and length from each to its list's end, and that end."""
    held = list(batches)
    if not held or not sum(b.num_rows for b in held):
        return
    t = pa.Table.from_batches(held)
    e, w, r = (t[c].to_numpy() for c in ("e", "w", "r"))
    nxt, last = (t[c].fill_null(-1).to_numpy() for c in ("nxt", "last"))
    order = np.argsort(e)
    e, w, r, nxt, last = (x[order].copy() for x in (e, w, r, nxt, last))
    end = len(e)  # a place of its own for what comes after the last element
    to = np.where(nxt >= 0, np.searchsorted(e, nxt), end)
    w, r, last, to = np.append(w, 0), np.append(r, 0), np.append(last, -1), np.append(to, end)
    while (to[:end] < end).any():
        w, r, last, to = w + w[to], r + r[to], np.where(to < end, last[to], last), to[to]
    yield pa.RecordBatch.from_arrays([pa.array(x[:end]) for x in (np.append(e, -1), w, r, last)], names=["e", "w", "r", "last"])


class Forest:
    """The hierarchy of ``links`` (``id`` unique, ``parent_id``); ids that occur only as parents count as no parent.

    ``by``: columns of ``links`` by which siblings are ordered, without which their order is any.
    """

    def __init__(self, spark: SparkSession, links: DataFrame, by: tuple[str, ...] = (), base: int | None = None):
        ship(spark)
        self.spark, self.by, self.base = spark, by, BASE if base is None else base
        self.scratch = Scratch(spark, "forest")
        named = self.scratch.table(links.withColumn("n", F.monotonically_increasing_id()), "named").df
        parents = named.select(F.col("id").alias("parent_id"), F.col("n").alias("p"))
        with_parent = named.where("parent_id IS NOT NULL").join(parents, "parent_id").select("n", "p", *by)
        self.names = named.select("n", "id")
        self.links = self.scratch.table(with_parent, "links")
        self.cycles = self._cycles()
        self.ranked = self._ranked(self._tour())

    def _cycles(self) -> DataFrame:
        """``n``, ``label``: the nodes on cycles, with the smallest id on theirs."""
        left, size = self.links, self.links.count()
        if size <= self.base:
            few = left.df.select("n", "p").join(self.names, "n").select("n", "p", "id").coalesce(1)
            return self.scratch.table(few.mapInPandas(_rings, "n bigint, label string"), "ring").df
        while size:
            s = left.df.select("n", "p")
            alive = s.join(s.select(F.col("p").alias("n")).distinct(), "n", "left_semi")
            peeled = self.scratch.table(alive.join(s.select(F.col("n").alias("p"), F.col("p").alias("q")), "p").select("n", F.col("q").alias("p")), "peeled")
            if left is not self.links:
                self.scratch.drop(left)
            left, before, size = peeled, size, peeled.count()
            if size == before:
                break
        ring = self.links.df.select("n", "p").join(left.df.select("n"), "n", "left_semi").join(self.names, "n").withColumnRenamed("id", "label")
        ring = self.scratch.table(ring.select("n", "p", "label"), "ring")
        while size:
            r = ring.df
            ahead = r.select(F.col("n").alias("p"), F.col("p").alias("q"), F.col("label").alias("other"))
            step = self.scratch.table(r.join(ahead, "p").select("n", F.col("q").alias("p"), F.least("label", "other").alias("label"), (F.col("other") != F.col("label")).alias("moved")), "ring")
            self.scratch.drop(ring)
            ring = step
            if step.df.where("moved").isEmpty():
                break
        return ring.df.select("n", "label")

    def _tour(self) -> DataFrame:
        """``e`` (2n on entry, 2n+1 on exit) and the element ``nxt`` after it."""
        cut = self.links.df.join(self.cycles.select("n"), "n", "left_anti")
        if self.by:  # siblings stand in ranges of their order, numbered in that order
            ordered = cut.withColumn("o", F.struct(*self.by, "n")).select("n", "p", "o").repartitionByRange(fanout(self.spark), "p", "o")
            child = self.scratch.table(ordered.withColumn("salt", F.spark_partition_id()), "siblings").df
        else:
            child = cut.select("n", "p", F.col("n").alias("o"), F.pmod(F.xxhash64("n"), F.lit(fanout(self.spark))).alias("salt"))
        pieces = child.groupBy("p", "salt").agg(F.min_by("n", "o").alias("head"), F.max_by("n", "o").alias("tail"))
        pieces = pieces.withColumn("next_head", F.lead("head").over(Window.partitionBy("p").orderBy("salt")))
        heads = pieces.groupBy("p").agg(F.min_by("head", "salt").alias("first"))
        inner = child.withColumn("sib", F.lead("n").over(Window.partitionBy("p", "salt").orderBy("o")))
        inner = inner.join(pieces.select(F.col("tail").alias("n"), "next_head"), "n", "left").select("n", "p", F.coalesce("sib", "next_head").alias("sib"))
        nodes = self.names.select("n").join(inner, "n", "left").join(heads.withColumnRenamed("p", "n"), "n", "left")
        enter = F.struct((F.col("n") * 2).alias("e"), F.coalesce(F.col("first") * 2, F.col("n") * 2 + 1).alias("nxt"), F.lit(1).cast("bigint").alias("w"))
        leave = F.struct((F.col("n") * 2 + 1).alias("e"), F.coalesce(F.col("sib") * 2, F.col("p") * 2 + 1).alias("nxt"), F.lit(-1).cast("bigint").alias("w"))
        tour = nodes.select(F.inline(F.array(enter, leave))).select("e", "nxt", "w", F.lit(1).cast("bigint").alias("r"), F.when(F.col("nxt").isNull(), F.col("e")).alias("last"))
        return self.scratch.table(tour, "tour")

    def _ranked(self, elements: Table, level: int = 0) -> DataFrame:
        """``e``, ``w`` (sum from e to the list's end), ``r`` (elements from e to the end), ``last`` (the end).

        ``elements``: ``e``, the ``nxt`` one, ``w`` and ``r`` of the step between them, and ``last`` where there is no next one.
        """
        if elements.count() <= self.base:
            return self.scratch.table(elements.df.coalesce(1).mapInArrow(_ranks, "e bigint, w bigint, r bigint, last bigint"), "ranks").df
        splits = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(SPARSE)) == 0
        is_open = F.col("nxt").isNotNull() & ~splits(F.col("nxt"))
        columns = ("e", "nxt", "w", "r", "last")
        settled, opened = [elements.df.where(~is_open)], elements.df.where(is_open)
        while True:
            ahead = opened
            for d in settled:
                ahead = ahead.unionByName(d)
            ahead = ahead.where(~splits(F.col("e"))).alias("b")
            a = opened.alias("a")
            stepped = a.join(ahead, F.col("a.nxt") == F.col("b.e")).select("a.e", "b.nxt", (F.col("a.w") + F.col("b.w")).alias("w"), (F.col("a.r") + F.col("b.r")).alias("r"), "b.last")
            t = self.scratch.table(stepped, "stretch").df
            settled.append(t.where(~is_open))
            opened = t.where(is_open)
            if opened.isEmpty():
                break
        stretches = settled[0]
        for d in settled[1:]:
            stretches = stretches.unionByName(d)
        short = self._ranked(self.scratch.table(stretches.where(splits(F.col("e"))).select(*columns), "splitters"), level + 1)
        rest = stretches.where(~splits(F.col("e"))).alias("a").join(short.alias("b"), F.col("a.nxt") == F.col("b.e"), "left")
        rest = rest.select("a.e", (F.col("a.w") + F.coalesce("b.w", F.lit(0))).alias("w"), (F.col("a.r") + F.coalesce("b.r", F.lit(0))).alias("r"), F.coalesce("b.last", "a.last").alias("last"))
        return self.scratch.table(rest.unionByName(short), "ranks").df

    def nodes(self) -> DataFrame:
        """``n``, ``root``, ``depth``, ``enter``, ``leave``: the intervals counted from the end of the tour, so ``enter`` > ``leave``."""
        entry = F.col("e") % 2 == 0
        both = self.ranked.groupBy(F.expr("e div 2").alias("n")).agg(F.max(F.when(entry, F.struct("w", "r", "last"))).alias("i"), F.max(F.when(~entry, F.col("r"))).alias("leave"))
        return both.select("n", F.expr("i.last div 2").alias("root"), (-F.col("i.w")).alias("depth"), F.col("i.r").alias("enter"), "leave")

    def roots(self) -> DataFrame:
        """``agent_id``, ``root_id``, ``depth`` (-1 on and below cycles, whose smallest id is then the root)."""
        entry = self.ranked.where("e % 2 = 0").select(F.expr("e div 2").alias("n"), F.expr("last div 2").alias("root"), (-F.col("w")).alias("depth"))
        tops = entry.where("n = root").select("root").join(self.names.select(F.col("n").alias("root"), F.col("id").alias("own")), "root")
        tops = tops.join(self.cycles.withColumnRenamed("n", "root"), "root", "left")
        named = entry.join(self.names, "n").join(tops, "root")
        return named.select(
            F.col("id").alias("agent_id"),
            F.coalesce("label", "own").alias("root_id"),
            F.when(F.col("label").isNotNull(), F.lit(-1).cast("bigint")).otherwise(F.col("depth")).alias("depth"),
        )

    def intervals(self) -> DataFrame:
        """``agent_id``, ``root_id``, ``enter``, ``leave``: places on the tour of the tree, from 0. The descendants of a node are those of its root that enter between its own places. The root of what is below a cycle is on it."""
        nodes = self.nodes()
        length = nodes.where("n = root").select("root", F.col("enter").alias("total"))
        own = self.names.select(F.col("n").alias("root"), F.col("id").alias("root_id"))
        placed = nodes.join(length.join(own, "root"), "root").join(self.names, "n")
        return placed.select(F.col("id").alias("agent_id"), "root_id", (F.col("total") - F.col("enter")).alias("enter"), (F.col("total") - F.col("leave")).alias("leave"), "root")

    def _by_chunks(self, chunk: int) -> DataFrame:
        """The tour cut into chunks of ``chunk`` places.

        A chunk gets, beside its own entries, the nodes open where it begins, found from
        the intervals alone, and is then read once with a stack. So no task holds a whole
        tree, and the rows sent twice are only those open at a boundary.
        """
        placed = self.intervals().select("root", F.col("enter").alias("a"), F.col("leave").alias("b"), F.col("agent_id").alias("id"))
        own = placed.select("root", F.expr(f"a div {chunk}").alias("chunk"), "a", "b", "id", F.lit(True).alias("own"))
        carried = placed.where(f"a div {chunk} < b div {chunk}").select("root", F.explode(F.expr(f"sequence(a div {chunk} + 1, b div {chunk})")).alias("chunk"), "a", "b", "id", F.lit(False).alias("own"))
        return own.unionByName(carried).repartition("root", "chunk").sortWithinPartitions("root", "chunk", "a")

    def paths(self, chunk: int = 4096) -> DataFrame:
        """``agent_id``, ``path`` (ids from the root down to the agent), ``n_descendants``, ``on_or_below_cycle``. Below a cycle the path begins on it."""

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch, stacks in _open_nodes(batches):
                rows = [(stack[-1][1], [x for _, x in stack], (b - a - 1) // 2, root) for root, a, b, stack in stacks(batch)]
                yield pd.DataFrame(rows, columns=["agent_id", "path", "n_descendants", "root"])

        walked = self._by_chunks(chunk).mapInPandas(walk, "agent_id string, path array<string>, n_descendants bigint, root bigint")
        rings = self.cycles.select(F.col("n").alias("root"), F.lit(True).alias("ring"))
        return walked.join(rings, "root", "left").select("agent_id", "path", "n_descendants", F.coalesce("ring", F.lit(False)).alias("on_or_below_cycle"))

    def descendants(self, chunk: int = 4096) -> DataFrame:
        """``ancestor_id``, ``descendant_id``, ``distance``: one row per node and each node whose interval holds it. As many as that may be; ``intervals`` says the same in one row per node."""

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch, stacks in _open_nodes(batches):
                rows = []
                for _, _, _, stack in stacks(batch):
                    name, depth = stack[-1][1], len(stack) - 1
                    rows += [(x, name, depth - k) for k, (_, x) in enumerate(stack[:-1])]
                    if len(rows) > 100_000:
                        yield pd.DataFrame(rows, columns=["ancestor_id", "descendant_id", "distance"])
                        rows = []
                yield pd.DataFrame(rows, columns=["ancestor_id", "descendant_id", "distance"])

        return self._by_chunks(chunk).mapInPandas(walk, "ancestor_id string, descendant_id string, distance bigint")


def _open_nodes(batches: Iterator[pd.DataFrame]):
    """Each batch of chunks with a function that reads it: of each entry of the chunk itself the root, its interval and the nodes open there, the entry last."""
    at, stack = None, []

    def read(batch: pd.DataFrame):
        nonlocal at, stack
        for root, number, a, b, name, is_own in zip(*(batch[c] for c in ("root", "chunk", "a", "b", "id", "own")), strict=True):
            if at != (root, number):
                at, stack = (root, number), []
            while stack and stack[-1][0] < a:
                stack.pop()
            stack.append((b, name))
            if is_own:
                yield root, a, b, stack

    for batch in batches:
        yield batch, read
