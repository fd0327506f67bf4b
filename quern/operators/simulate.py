"""Simulators of what Spark has no use for, run as independent tasks: page replacement, elections, replica availability.

A state machine is a small Python loop; a study of many settings is a table of settings, each simulated where its row is.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLICIES = ("lru", "clock", "lru2", "2q")


class Cache:
    """Page frames under a replacement policy. A page can be pinned; of the others the policy names the victim."""

    def __init__(self, policy: str, frames: int):
        if policy not in POLICIES or frames < 1:
            raise ValueError("unknown policy, or no frames")
        self.policy, self.frames, self.clock, self.hits, self.misses = policy, frames, 0, 0, 0
        self.times: dict[int, list[int]] = {}  # accesses of each page held, newest last
        self.ring: list[int | None] = [None] * frames
        self.used: dict[int, bool] = {}
        self.hand, self.pinned = 0, set()

    def _victim(self) -> int:
        free = [p for p in self.times if p not in self.pinned]
        if not free:
            raise RuntimeError("all frames are pinned")
        if self.policy == "clock":
            while True:
                p = self.ring[self.hand]
                self.hand = (self.hand + 1) % self.frames
                if p in self.times and p not in self.pinned:
                    if not self.used[p]:
                        return p
                    self.used[p] = False
        t = self.times
        rank = {"lru": lambda p: t[p][-1], "lru2": lambda p: (len(t[p]) > 1, t[p][-2:][0]), "2q": lambda p: (len(t[p]) > 1, t[p][-1] if len(t[p]) > 1 else t[p][0])}[self.policy]
        return min(free, key=rank)

    def access(self, page: int, pin: bool = False) -> tuple[bool, int | None]:
        """(hit, evicted page)."""
        self.clock += 1
        gone, hit = None, page in self.times
        if hit:
            self.hits += 1
        else:
            self.misses += 1
            if len(self.times) == self.frames:
                gone = self._victim()
                del self.times[gone]
                self.ring[self.ring.index(gone)] = None
            self.ring[self.ring.index(None)] = page
            self.times[page] = []
        self.times[page].append(self.clock)
        self.used[page] = True
        if pin:
            self.pinned.add(page)
        return hit, gone

    @property
    def hit_ratio(self) -> float:
        n = self.hits + self.misses
        return self.hits / n if n else 0.0


def cache_study(traces: DataFrame, policies: tuple[str, ...] = POLICIES, frames: tuple[int, ...] = (16, 32, 64)) -> DataFrame:
    """(workload, policy, frames, hits, misses) of traces (workload, pos, page); one task for each setting and workload."""
    spark = traces.sparkSession
    grid = spark.createDataFrame([(p, f) for p in policies for f in frames], "policy string, frames int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = Cache(pdf["policy"].iloc[0], int(pdf["frames"].iloc[0]))
        for page in pdf.sort_values("pos")["page"]:
            c.access(int(page))
        return pd.DataFrame({"workload": [pdf["workload"].iloc[0]], "policy": [c.policy], "frames": [c.frames], "hits": [c.hits], "misses": [c.misses]})

    return traces.crossJoin(F.broadcast(grid)).groupBy("workload", "policy", "frames").applyInPandas(run, "workload string, policy string, frames int, hits long, misses long")


def lru_hits(trace: DataFrame, frames: int) -> DataFrame:
    """(pos, page, hit) under LRU without a simulation: a hit is a page with fewer than `frames` other pages since its last access.

    The distinct pages in between are those whose next access lies behind the position, so they are counted by a join on
    the interval; for traces, not for tables.
    """
    w = Window.partitionBy("page").orderBy("pos")
    t = trace.select("pos", "page", F.lag("pos").over(w).alias("prev"), F.lead("pos").over(w).alias("next"))
    other = t.select(F.col("pos").alias("p"), F.col("next").alias("n"))
    between = t.where("prev is not null").join(other, (F.col("p") > F.col("prev")) & (F.col("p") < F.col("pos")) & (F.col("n").isNull() | (F.col("n") > F.col("pos")))).groupBy("pos").agg(F.count("*").alias("d"))
    return t.join(between, "pos", "left").select("pos", "page", (F.col("prev").isNotNull() & (F.coalesce("d", F.lit(0)) < frames)).alias("hit"))


def workloads(spark: SparkSession, pages: int = 1000, n: int = 20_000, seed: int = 7) -> DataFrame:
    """Traces (workload, pos, page): uniform, 80-20, and a hot set with scans in between."""
    rng, rows = random.Random(seed), []
    hot = max(1, pages // 5)
    for i in range(n):
        rows.append(("uniform", i, rng.randrange(pages)))
        rows.append(("80-20", i, rng.randrange(hot) if rng.random() < 0.8 else rng.randrange(hot, pages)))
        rows.append(("hot+scan", i, i % pages if i % 3 == 0 else rng.randrange(20)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["workload", "pos", "page"]))


def election(seed: int, nodes: int, low: int, high: int, delay: int = 10, limit: int = 20_000) -> tuple[int, int]:
    """(ticks until a leader, elections that split): nodes time out at random; one who gets a majority of one term's votes leads.

    A node votes once a term, for the first candidate that it hears of; a vote and a request take 1 to `delay` ticks.
    """
    rng = random.Random(seed)
    due = [rng.randint(low, high) for _ in range(nodes)]
    term, voted, split = [0] * nodes, [-1] * nodes, 0
    events: list[tuple[int, int, str, int, int, int]] = []
    votes: dict[tuple[int, int], int] = {}
    for now in range(limit):
        for i in range(nodes):
            if due[i] == now:
                split += term[i] > 0 and voted[i] == term[i]
                term[i] += 1
                voted[i] = term[i]
                votes[i, term[i]] = 1
                due[i] = now + rng.randint(low, high)
                events += [(now + rng.randint(1, delay), j, "ask", i, term[i], 0) for j in range(nodes) if j != i]
        for t, j, kind, i, at, _ in [e for e in events if e[0] == now]:
            if kind == "ask" and (at > term[j] or at == term[j] and voted[j] < at):
                term[j], voted[j] = at, at
                due[j] = now + rng.randint(low, high)
                events.append((now + rng.randint(1, delay), i, "vote", j, at, 0))
            elif kind == "vote" and term[j] == at:
                votes[j, at] = votes.get((j, at), 0) + 1
                if 2 * votes[j, at] > nodes:
                    return now, split
        events = [e for e in events if e[0] > now]
    return limit, split


def split_votes(spark: SparkSession, seeds: int = 200, nodes: int = 5, ranges: tuple[tuple[int, int], ...] = ((150, 160), (150, 300), (150, 600))) -> DataFrame:
    """(low, high, mean_ticks, splits) over many seeds, each simulated on its own."""
    grid = spark.range(seeds).crossJoin(F.broadcast(spark.createDataFrame(list(ranges), "low int, high int")))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in it:
            got = [election(int(s), nodes, int(a), int(b)) for s, a, b in zip(g["id"], g["low"], g["high"])]
            yield g.assign(ticks=[t for t, _ in got], splits=[s for _, s in got])[["low", "high", "ticks", "splits"]]

    return grid.mapInPandas(run, "low int, high int, ticks long, splits long").groupBy("low", "high").agg(F.avg("ticks").alias("mean_ticks"), F.sum("splits").alias("splits"))


def availability(requests: DataFrame) -> DataFrame:
    """(system, side, ok, total, stale) of a request trace (system, side, seq, op, key, value, ok).

    A read is stale when its value isn't that of the last accepted write of the key anywhere in its system.
    """
    w = Window.partitionBy("system", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when((F.col("op") == "write") & F.col("ok"), F.struct("value")), ignorenulls=True).over(w)
    d = requests.withColumn("_last", last)
    stale = (F.col("op") == "read") & F.col("ok") & F.col("_last").isNotNull() & ~F.col("value").eqNullSafe(F.col("_last.value"))
    return d.groupBy("system", "side").agg(F.sum(F.col("ok").cast("int")).alias("ok"), F.count("*").alias("total"), F.sum(stale.cast("int")).alias("stale"))


def transfer_log(spark: SparkSession, plan: dict[str, dict[str, int]], balances: dict[str, dict[str, int]], down: tuple[str, ...] = ()) -> DataFrame:
    """(participant, tx, vote) of transfers tx -> {participant:account -> delta}: NO where a balance would go below 0 or a node is down."""
    rows = []
    for tx, deltas in plan.items():
        by: dict[str, list[tuple[str, int]]] = {}
        for where, d in deltas.items():
            by.setdefault(where.split(":")[0], []).append((where.split(":")[1], d))
        for p, items in by.items():
            ok = p not in down and all(balances.get(p, {}).get(a, 0) + d >= 0 for a, d in items)
            rows.append((p, tx, "YES" if ok else "NO"))
    return spark.createDataFrame(rows, "participant string, tx string, vote string")
