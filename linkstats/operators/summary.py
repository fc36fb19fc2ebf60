"""Two-arm summaries: one wide row per schedule, both arms side by side.

Everything is one conditional aggregate per fact table, so facts are read once
and partial results combine before the shuffle on the schedule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstats.functions.measures import TIME, Arms, exact_mean, ratio, stored_gain

INTERFACES = {"op0": "op0", "op1": "op1"}
MODES = {"lte": "LTE", "3g": "3G", "2g": "2G"}
QUALITIES = {"good": "GOOD", "fair": "FAIR", "poor": "POOR"}

# Counts over the first iteration of a run: column suffix, source column, value.
FIRST_ITERATION_COUNTS = tuple(
    (f"cnt_{name}", column, value)
    for column, values in (("if_name", INTERFACES), ("device_mode", MODES),
                           ("signal_quality", QUALITIES))
    for name, value in values.items())


def count_or_null(condition: Column) -> Column:
    """Number of rows that meet the condition, NULL when none does."""
    return F.sum(F.when(condition, 1))


def count_or_zero(condition: Column) -> Column:
    """Number of rows that meet the condition, 0 when none does."""
    return F.sum(F.when(condition, 1).otherwise(0))


def mean_where(condition: Column, value: Column | str) -> Column:
    return exact_mean(F.when(condition, F.col(value) if isinstance(value, str) else value))


def sum_where(condition: Column, value: Column | str) -> Column:
    return F.sum(F.when(condition, F.col(value) if isinstance(value, str) else value))


@dataclass(frozen=True)
class Measure:
    """A conditional aggregate that can be had at once, or from parts of the rows."""

    kind: str  # count, count_or_zero, sum or mean
    condition: Column
    value: Column | None = None

    def whole(self) -> Column:
        if self.kind == "count":
            return count_or_null(self.condition)
        if self.kind == "count_or_zero":
            return count_or_zero(self.condition)
        return (mean_where if self.kind == "mean" else sum_where)(self.condition, self.value)

    def parts(self, name: str) -> dict[str, Column]:
        """What some of the rows add. Means keep an exact sum and a count."""
        if self.kind != "mean":
            return {name: self.whole()}
        value = F.when(self.condition, self.value)
        return {f"{name}_total": F.sum(value.cast(TIME)), f"{name}_n": F.count(value)}

    def merged(self, name: str) -> Column:
        if self.kind != "mean":
            return F.sum(name)
        return F.try_divide(F.sum(f"{name}_total").cast("double"), F.sum(f"{name}_n").cast("double"))


Measures = Callable[[Column], dict[str, Measure]]


def _first_iteration(arm: Column, start_time: str) -> dict[str, Measure]:
    first = arm & (F.col("iter_nr") == 1)
    measures = {"cnt": Measure("count", first)}
    for name, column, value in FIRST_ITERATION_COUNTS:
        measures[name] = Measure("count_or_zero", first & (F.col(column) == value))
    measures["init_time"] = Measure("mean", first, F.col(start_time))
    return measures


def _ping_measures(arm: Column) -> dict[str, Measure]:
    echo = arm & (F.col("ping_type") == "ECHO")
    return {"cnt_rtt": Measure("count", echo), "rtt": Measure("mean", echo, F.col("rtt")),
            **_first_iteration(arm, "rtt")}


def _download_measures(arm: Column) -> dict[str, Measure]:
    return {"cnt_dwnl": Measure("count", arm), "dwnl_size": Measure("sum", arm, F.col("dwnl_size")),
            "dwnl_time": Measure("sum", arm, F.col("total_time") - F.col("init_time")),
            **_first_iteration(arm, "init_time")}


def _of_both_arms(arms: Arms, measures: Measures) -> dict[str, Measure]:
    return measures(arms.is_baseline()) | {arms.named(name): m for name, m in measures(arms.is_treatment()).items()}


def per_schedule(facts: DataFrame, arms: Arms, measures: Measures) -> DataFrame:
    """Both arms' measures by schedule. ``exp_id`` and ``node_id`` depend on the schedule."""
    wide = {"exp_id": F.min("exp_id"), "node_id": F.min("node_id"), "cnt_all": F.count("*")}
    wide |= {name: m.whole() for name, m in _of_both_arms(arms, measures).items()}
    return facts.groupBy("sched_id").agg(*[column.alias(name) for name, column in wide.items()])


def parts_per_schedule(facts: DataFrame, arms: Arms, measures: Measures) -> DataFrame:
    """What ``facts``, some of the rows, add to each schedule."""
    wide = {"exp_id": F.min("exp_id"), "node_id": F.min("node_id"), "cnt_all": F.count("*")}
    for name, m in _of_both_arms(arms, measures).items():
        wide |= m.parts(name)
    return facts.groupBy("sched_id").agg(*[column.alias(name) for name, column in wide.items()])


def from_parts(parts: DataFrame, arms: Arms, measures: Measures) -> DataFrame:
    """The same rows as ``per_schedule`` over all facts that the parts were made of."""
    wide = {"exp_id": F.min("exp_id"), "node_id": F.min("node_id"), "cnt_all": F.sum("cnt_all")}
    wide |= {name: m.merged(name) for name, m in _of_both_arms(arms, measures).items()}
    return parts.groupBy("sched_id").agg(*[column.alias(name) for name, column in wide.items()])


def ping_parts(pings: DataFrame, arms: Arms = Arms()) -> DataFrame:
    return parts_per_schedule(pings, arms, _ping_measures)


def download_parts(downloads: DataFrame, arms: Arms = Arms()) -> DataFrame:
    return parts_per_schedule(downloads, arms, _download_measures)


def ping_summary_of_parts(parts: DataFrame, arms: Arms = Arms()) -> DataFrame:
    return with_ping_gains(from_parts(parts, arms, _ping_measures), arms)


def download_summary_of_parts(parts: DataFrame, arms: Arms = Arms()) -> DataFrame:
    return with_download_gains(from_parts(parts, arms, _download_measures), arms)


def ping_summary(pings: DataFrame, arms: Arms = Arms()) -> DataFrame:
    """Ping summary (the table ``tcp_ping_avg``) from classified pings."""
    return with_ping_gains(per_schedule(pings, arms, _ping_measures), arms)


def with_ping_gains(base: DataFrame, arms: Arms) -> DataFrame:
    return base.withColumns({"cnt_gain": stored_gain(arms.named("cnt_rtt"), "cnt_rtt"),
                             "rtt_gain": stored_gain(arms.named("rtt"), "rtt")})


def download_summary(downloads: DataFrame, arms: Arms = Arms()) -> DataFrame:
    """Download summary (the table ``dwnl_test_avg``) from classified downloads."""
    return with_download_gains(per_schedule(downloads, arms, _download_measures), arms)


def with_download_gains(base: DataFrame, arms: Arms) -> DataFrame:
    # Speeds first: the speed gain is made of them.
    speeds = {name: ratio(size, time) for name, size, time in (
        ("dwnl_speed", "dwnl_size", "dwnl_time"),
        tuple(map(arms.named, ("dwnl_speed", "dwnl_size", "dwnl_time"))))}
    return base.withColumns(speeds).withColumns({
        "cnt_gain": stored_gain(arms.named("cnt_dwnl"), "cnt_dwnl"),
        "size_gain": stored_gain(arms.named("dwnl_size"), "dwnl_size"),
        "speed_gain": stored_gain(arms.named("dwnl_speed"), "dwnl_speed")})


def tool_columns(arms: Arms = Arms()) -> list[str]:
    base = ["cnt", *[name for name, _, _ in FIRST_ITERATION_COUNTS], "init_time"]
    return base + [arms.named(name) for name in base]


def paired(pings: DataFrame, downloads: DataFrame, arms: Arms = Arms()) -> DataFrame:
    """Schedules with both summaries (``ping_*``, ``dwnl_*``) and the merged columns.

    Counts are added and start times weighted by them. A schedule without
    downloads has NULL in every merged column.
    """
    left = pings.select("exp_id", "sched_id", "node_id",
                        *[F.col(c).alias(f"ping_{c}") for c in pings.columns])
    right = downloads.select("sched_id", *[F.col(c).alias(f"dwnl_{c}") for c in downloads.columns])
    merged = {}
    for name in tool_columns(arms):
        if not name.startswith("init_time"):
            merged[name] = F.col(f"ping_{name}") + F.col(f"dwnl_{name}")
            continue
        cnt = name.replace("init_time", "cnt")
        weighted = (F.col(f"ping_{cnt}") * F.col(f"ping_{name}")
                    + F.col(f"dwnl_{cnt}") * F.col(f"dwnl_{name}"))
        merged[name] = ratio(weighted, F.col(f"ping_{cnt}") + F.col(f"dwnl_{cnt}"))
    return left.join(right, "sched_id", "left").withColumns(merged)


def one_side(pair: DataFrame, side: str) -> DataFrame:
    """The ping or download summary of the schedules in ``pair``."""
    prefix = f"{side}_"
    return pair.select(*[F.col(c).alias(c.removeprefix(prefix)) for c in pair.columns
                         if c.startswith(prefix)])


def tool_summary(pings: DataFrame, downloads: DataFrame, arms: Arms = Arms(),
                 combine: str = "merge") -> DataFrame:
    """Ping and download summaries put together (``v_tool_avg``): merged by schedule,
    or with ``combine='stack'`` kept as separate rows."""
    columns = ["exp_id", "sched_id", "node_id", *tool_columns(arms)]
    if combine == "stack":
        return pings.select(*columns).unionByName(downloads.select(*columns))
    if combine != "merge":
        raise ValueError(f"unknown way to combine: {combine}")
    return paired(pings, downloads, arms).select(*columns)
