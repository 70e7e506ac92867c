"""Problem 7: mixing sources to target weights, as a curriculum whose weights may change over the training run.

The size of the mix is the largest at which every source can give its share within its cap (or a given size, of which capped
sources then give what they can). Each source's documents, in hashed order and copy after copy, are its supply; the integral of
its weight schedule is its demand over the run. Inverting the demand at a document's cumulative tokens gives its training
position, and a range sort by position gives the mixed list.

Cumulative tokens are prefix sums over hash ranges: small sums per range first, then within a range, so that a source may hold
any share of the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.plans import written
from tickloom.llm.byte_bpe import VOCABULARY, counted

#: Documents of one source in one hash range, about.
RANGE_ROWS = 20_000
#: How far the default schedule lets scarce sources fall below their share at the start and rise above it at the end.
RAMP = 0.5
SEED = 20_011

Schedule = dict[str, list[tuple[float, float]]]


def ramped(targets: DataFrame, ramp: float = RAMP) -> DataFrame:
    """Targets with ``knots``: linear schedules that put sources with many allowed repeats later, at every moment adding up to 1.

    A source's weight at time t in [0, 1] is its share times the knots' multiplier, whose integral is 1."""
    every = Window.partitionBy(F.lit(0))  # as many rows as there are targets
    mean = F.sum(F.col("target_share") * F.col("max_repeats")).over(every) / F.sum("target_share").over(every)
    wide = targets.withColumn("_off", F.col("max_repeats") - mean)
    most = F.max(F.abs(F.col("_off"))).over(every)
    wide = wide.withColumn("_tilt", F.when(most > 0, F.lit(ramp) * F.col("_off") / most).otherwise(F.lit(0.0)))
    knot = lambda t, m: F.struct(F.lit(t).cast("double").alias("t"), m.cast("double").alias("m"))
    return wide.withColumn("knots", F.array(knot(0.0, 1 - F.col("_tilt")), knot(1.0, 1 + F.col("_tilt")))).drop("_off", "_tilt")


def scheduled(targets: DataFrame, schedule: Schedule) -> DataFrame:
    """Targets with ``knots`` from (time, multiplier) points per source; multipliers are scaled to an integral of 1. A source without
    points keeps its weight."""
    rows = []
    for source, points in schedule.items():
        points = sorted(points)
        if points[0][0] != 0 or points[-1][0] != 1 or any(m < 0 for _, m in points):
            raise ValueError("a schedule runs from 0 to 1 with multipliers of 0 or more")
        area = sum((b - a) * (x + y) / 2 for (a, x), (b, y) in zip(points, points[1:], strict=False))
        rows.append((source, [(float(t), float(m / area)) for t, m in points]))
    knots = targets.sparkSession.createDataFrame(rows, "source string, knots array<struct<t:double,m:double>>")
    flat = F.array(F.struct(F.lit(0.0).alias("t"), F.lit(1.0).alias("m")), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("m")))
    return targets.join(F.broadcast(knots), "source", "left").withColumn("knots", F.coalesce("knots", flat))


def demand_time(share: Column) -> Column:
    """The time at which the integral of the schedule ``knots`` reaches ``share`` (0 to 1)."""
    pieces = F.expr("transform(sequence(1, size(knots) - 1), i -> struct(knots[i - 1] as a, knots[i] as b))")
    start = F.struct(F.lit(0.0).alias("u"), F.lit(None).cast("double").alias("t"))

    def step(state: Column, piece: Column) -> Column:
        a, b = piece["a"], piece["b"]
        width, left = b["t"] - a["t"], share - state["u"]
        area = width * (a["m"] + b["m"]) / 2
        slope = F.when(width > 0, (b["m"] - a["m"]) / width).otherwise(0.0)
        root = F.sqrt(F.greatest(a["m"] * a["m"] + 2 * slope * left, F.lit(0.0)))
        inside = F.when(a["m"] + root > 0, a["t"] + 2 * left / (a["m"] + root)).otherwise(a["t"])
        return F.struct((state["u"] + area).alias("u"), F.when(state["t"].isNotNull(), state["t"]).when((area > 0) & (left <= area), F.least(inside, b["t"])).alias("t"))

    return F.coalesce(F.aggregate(pieces, start, step, lambda s: s["t"]), F.lit(1.0))


class Mix:
    """A mix of ``documents`` (doc_id, source, text) to ``targets`` (source, target_share, max_repeats).

    ``documents`` and ``shares`` are DataFrames over token counts written once. Documents of a null source or of one without a target,
    and documents of no tokens, are not used. Targets of a null source, or without a positive share and cap, get nothing. A doc_id
    that occurs several times is several documents. Without any usable source the list is empty and all reached shares are null."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, schedule: Schedule | None = None, seed: int = SEED, vocabulary: str = VOCABULARY):
        sizes = written(counted(documents.where(F.col("source").isNotNull()), ["doc_id", "source"], vocabulary=vocabulary), "mix-sizes")
        wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.sum("target_share").cast("double").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
        wanted = wanted.withColumn("target_share", F.col("target_share") / F.sum("target_share").over(Window.partitionBy(F.lit(0))))
        wanted = scheduled(wanted, schedule) if schedule else ramped(wanted)
        held = sizes.where(F.col("n_tokens") > 0).groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.count("*").alias("n_documents"))
        plan = wanted.join(held, "source", "left").withColumn("usable", (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.col("supply") > 0))
        able = F.when(F.col("usable"), F.col("supply") * F.col("max_repeats") / F.col("target_share"))
        whole = F.lit(total_tokens).cast("double") if total_tokens else F.min(able).over(Window.partitionBy(F.lit(0)))
        plan = plan.withColumn("total", whole)
        plan = plan.withColumn("demand", F.when(F.col("usable"), F.least(F.col("total") * F.col("target_share"), (F.col("supply") * F.col("max_repeats")).cast("double"))))
        # As many rows as there are targets; written so that its windows run once.
        self.plan = written(plan.coalesce(1), "mix-plan")
        self.documents = self._placed(sizes, seed)

    def _placed(self, sizes: DataFrame, seed: int) -> DataFrame:
        plan = F.broadcast(self.plan.where("usable").select("source", "supply", "demand", "knots", "n_documents"))
        rows = sizes.where(F.col("n_tokens") > 0).join(plan, "source")
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("demand") / F.col("supply")).cast("int")))))
        rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), "doc_id", "copy"))
        bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_documents") / F.lit(RANGE_ROWS))).cast("int"))
        rows = rows.withColumn("_range", F.floor((F.col("_hash") / 2.0**64 + 0.5) * F.pow(F.lit(2.0), bits)).cast("bigint"))
        group = ["source", "copy"]
        sums = rows.groupBy(*group, "_range").agg(F.sum("n_tokens").alias("_n"))
        before = sums.select(*group, "_range", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_range")) - F.col("_n")).alias("_before"))
        within = F.sum("n_tokens").over(Window.partitionBy(*group, "_range").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
        rows = rows.withColumn("_within", within).join(before, [*group, "_range"])
        middle = (F.col("copy") - 1) * F.col("supply") + F.col("_before") + F.col("_within") + F.col("n_tokens") / 2.0
        rows = rows.withColumn("_share", middle / F.col("demand")).where(F.col("_share") < 1)
        rows = rows.withColumn("position", demand_time(F.col("_share")))
        return rows.select("position", "source", "doc_id", "copy", "n_tokens").orderBy("position", "source", "doc_id", "copy")

    def shares(self) -> DataFrame:
        """Per target: its share, the share of tokens really reached, tokens, uses, documents used and the most uses of one."""
        used = self.documents.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), F.max("copy").alias("most_uses"))
        all_tokens = F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy(F.lit(0)))
        out = self.plan.select("source", "target_share", "max_repeats", F.coalesce("supply", F.lit(0)).alias("supply")).join(used, "source", "left")
        return out.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.nullif(all_tokens, F.lit(0))).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "supply", F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats")
