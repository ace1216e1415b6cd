"""Index advice and shard load, as aggregations over logs of queries and writes."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

#: fixed values: the limits of the advisor and of the load monitor.
LEAST_USES, LEAST_SCORE, TOP, QUOTA = 100, 1.0, 5, 50
KEPT_SAMPLES, WINDOW_HOURS = 500, 48
INVERTED_LIMIT, RANGE_LIMIT = 1_000, 100_000
USEFUL, CHECK_HOURS, UNUSED_DAYS = 100, 48, 30
HOT = {"writes_per_second": 50_000, "mean_bytes": 500 << 20, "cpu": 0.75, "latency_ms": 100.0}
SUSTAINED_SECONDS = 60
REBALANCE = 0.2
VIRTUAL_NODES = 100


def usage(log: DataFrame) -> DataFrame:
    """Per tenant and column: uses, median and 99th percentile of the newest selectivities, time saved.

    ``log``: tenant, column, kind (filter or group), selectivity, time_saved, at (timestamp).  Only the
    last 48 hours before the newest entry of a tenant count, and the newest 500 samples of a column.
    """
    newest = Window.partitionBy("tenant")
    recent = log.withColumn("end", F.max("at").over(newest)).where(F.col("at") >= F.col("end") - F.expr(f"INTERVAL {WINDOW_HOURS} HOURS"))
    place = F.row_number().over(Window.partitionBy("tenant", "column", "kind").orderBy(F.col("at").desc(), "selectivity"))
    rows = recent.withColumn("kept", F.when((place <= KEPT_SAMPLES) & (F.col("kind") == "filter"), F.col("selectivity")))
    return rows.groupBy("tenant", "column").agg(
        F.count(F.when(F.col("kind") == "filter", 1)).alias("filter_count"),
        F.count(F.when(F.col("kind") == "group", 1)).alias("group_count"),
        F.median("kept").alias("selectivity_p50"),
        F.percentile("kept", 0.99).alias("selectivity_p99"),
        F.avg("time_saved").alias("query_time_saved"),
    )


def score(filter_count: Column, p50: Column, saved: Column, cardinality: Column, write_rate: Column) -> Column:
    """What an index would save over what it would cost."""
    return F.try_divide(filter_count * (F.lit(1.0) - p50) * saved, cardinality * 10 + write_rate * 0.01)


def index_type(cardinality: Column) -> Column:
    return F.when(cardinality <= INVERTED_LIMIT, "inverted").when(cardinality <= RANGE_LIMIT, "range").otherwise("bloom")


def recommend(stats: DataFrame, existing: int = 0, top: int = TOP) -> DataFrame:
    """The best columns to index of each tenant; ``stats`` has usage with cardinality and write_rate."""
    room = max(0, min(top, QUOTA - existing))
    scored = stats.withColumn("score", score(F.col("filter_count"), F.col("selectivity_p50"), F.col("query_time_saved"), F.col("cardinality"), F.col("write_rate"))).withColumn("index_type", index_type(F.col("cardinality")))
    w = Window.partitionBy("tenant").orderBy(F.col("score").desc(), "column")
    return scored.where((F.col("filter_count") >= LEAST_USES) & (F.col("score") > LEAST_SCORE)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= room)


def next_state(indexes: DataFrame, now: Column) -> DataFrame:
    """Indexes with their next state: invisible ones show or go, visible ones unused for long are deprecated.

    ``indexes``: state, would_have_helped, created_at, last_used.
    """
    helped = F.col("would_have_helped") >= USEFUL
    late = now - F.expr(f"INTERVAL {CHECK_HOURS} HOURS") > F.col("created_at")
    idle = now - F.expr(f"INTERVAL {UNUSED_DAYS} DAYS") > F.coalesce("last_used", "created_at")
    state = F.col("state")
    after = F.when((state == "invisible") & helped, "visible").when((state == "invisible") & late, "removed").when((state == "visible") & idle, "deprecated").otherwise(state)
    return indexes.withColumn("next_state", after)


def rolling(log: DataFrame, value: str, seconds: int = SUSTAINED_SECONDS, by: tuple[str, ...] = ("shard",), at: str = "second") -> DataFrame:
    """The mean of the values within the seconds before each row, and their sum per second."""
    w = Window.partitionBy(*by).orderBy(at).rangeBetween(-seconds, 0)
    return log.withColumn("rolling_avg", F.avg(value).over(w)).withColumn("rolling_rate", F.sum(value).over(w) / F.lit(float(seconds)))


def hot_shards(load: DataFrame, limits: dict[str, float] = HOT, sustained: int = SUSTAINED_SECONDS) -> DataFrame:
    """Shards over any limit without a break for the given seconds; ``load`` has one row a shard and second."""
    over = F.lit(False)
    for column, limit in limits.items():
        if column in load.columns:
            over = over | F.coalesce(F.col(column) > F.lit(limit), F.lit(False))
    w = Window.partitionBy("shard").orderBy("second")
    flagged = load.withColumn("over", over).withColumn("breaks", F.sum(F.when(~F.col("over"), 1).otherwise(0)).over(w)).where("over")
    runs = flagged.groupBy("shard", "breaks").agg(F.min("second").alias("since"), F.max("second").alias("until"))
    return runs.where(F.col("until") - F.col("since") >= sustained).groupBy("shard").agg(F.min("since").alias("hot_since"))


def imbalance(load: DataFrame) -> DataFrame:
    """node, load, share of the mean: nodes further than the threshold from it should give or take shards."""
    w = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per_node = load.groupBy("node").agg(F.sum("load").alias("load"))
    return per_node.withColumn("excess", F.col("load") / F.avg("load").over(w) - 1).withColumn("move", F.when(F.col("excess") > REBALANCE, "give").when(F.col("excess") < -REBALANCE, "take").otherwise("stay"))


@dataclass
class TokenBucket:
    """Admission of a tenant's queries: ``rate`` a second up to ``burst``."""

    rate: float
    burst: float
    tokens: float | None = None
    at: float = 0.0

    def admit(self, now: float, cost: float = 1.0) -> bool:
        have = self.burst if self.tokens is None else min(self.burst, self.tokens + (now - self.at) * self.rate)
        ok = have >= cost
        self.tokens, self.at = have - cost * ok, now
        return ok


@dataclass(frozen=True)
class Assignment:
    """Shards of nodes; new shards go to the node that has fewest, ties to the least name."""

    nodes: tuple[tuple[str, int], ...]

    def place(self) -> tuple[str, Assignment]:
        name = min(self.nodes, key=lambda n: (n[1], n[0]))[0]
        return name, replace(self, nodes=tuple((n, k + (n == name)) for n, k in self.nodes))


def least_loaded(loads: dict[str, float]) -> str:
    """The node of least load, ties to the least name."""
    return min(loads, key=lambda n: (loads[n], n))


@dataclass(frozen=True)
class HashRing:
    """Consistent hashing: a shard belongs to the first point at or after its hash, each node has several points."""

    nodes: tuple[str, ...]
    points: int = VIRTUAL_NODES

    @staticmethod
    def place_of(name: str) -> int:
        return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big")

    @cached_property
    def ring(self) -> list[tuple[int, str]]:
        return sorted((self.place_of(f"{n}:{i}"), n) for n in set(self.nodes) for i in range(self.points))

    def node_of(self, shard: str) -> str | None:
        if not self.ring:
            return None
        return self.ring[bisect_left(self.ring, (self.place_of(shard), "")) % len(self.ring)][1]

    def moves(self, assigned: dict[str, str]) -> list[tuple[str, str, str]]:
        """(shard, old node, new node) of the shards that this ring gives to another node."""
        return [(s, old, new) for s, old in sorted(assigned.items()) if (new := self.node_of(s)) is not None and new != old]
