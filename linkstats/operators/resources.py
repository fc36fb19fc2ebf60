"""CPU and memory overhead of the arms, from periodic resource samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkstats.functions.measures import Arms, ColumnOrName, _col, ratio, to_mib
from linkstats.operators.slices import SLICE_SECONDS, place_of, with_neighbour


@dataclass(frozen=True)
class ResourceNames:
    """The probe tools, and how a sample without any tool is marked."""

    tools: tuple[str, ...] = ("tcp-ping", "dwnl-test")
    no_tool: str = "(no-app)"
    arms: Arms = field(default_factory=Arms)

    @property
    def treatment_tools(self) -> tuple[str, ...]:
        return tuple(self.arms.treatment_prefix + tool for tool in self.tools)

    @property
    def by_priority(self) -> tuple[str, ...]:
        """Order in which the tools of one sample compete for its tool slot."""
        return tuple(name for tool in self.tools
                     for name in (tool, self.arms.treatment_prefix + tool))


def used_mib(total: ColumnOrName = "total", avail: ColumnOrName = "avail") -> Column:
    return to_mib(_col(total) - _col(avail))


def cpu_share(cpu: ColumnOrName, cores: int = 4) -> Column:
    """Process CPU counts every core as 100; the host's CPU does not."""
    return _col(cpu) / F.lit(float(cores))


def normalised(samples: DataFrame, cores: int = 4) -> DataFrame:
    """Add host memory in use and bring process CPU and memory to host units."""
    columns = {"mem": used_mib()}
    for slot in ("app", "exporter", "policyd", "proxy"):
        columns[f"{slot}_cpu"] = cpu_share(f"{slot}_cpu", cores)
        columns[f"{slot}_mem"] = to_mib(f"{slot}_pss")
    return samples.withColumns(columns)


def _present(slot: str) -> Column:
    name = F.col(f"{slot}_name")
    return name.isNotNull() & (name != "")


def sample_category(names: ResourceNames = ResourceNames()) -> Column:
    """idle, baseline, treatment or proxy; NULL for samples of no category.

    A sample has one tool slot, so no sample belongs to two categories.
    """
    app, proxied = F.col("app_name"), _present("proxy")
    alone = ~(_present("exporter") | _present("policyd") | proxied)
    return (F.when((app == names.no_tool) & alone, "idle")
            .when(app.isin(*names.treatment_tools), "treatment")
            .when(app.isin(*names.tools), F.when(proxied, "proxy").otherwise("baseline")))


# Measures of a sample by report key; ``app`` stands for the name of the tool.
_HOST = ("cpu", "mem")
_SLOTS_BY_CATEGORY = {
    "idle": (),
    "baseline": ("app",),
    "treatment": ("app", "exporter", "policyd"),
    "proxy": ("app", "exporter", "policyd", "proxy"),
}


def mean_and_count(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean over present values, and their number; groups without any are left out."""
    return (df.where(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.count(value).alias("cnt"), F.avg(value).alias("avr")))


def overhead_report(samples: DataFrame, keys: Sequence[str] = ("recording",),
                    order: Sequence[str] = ("line_no",), cores: int = 4,
                    names: ResourceNames = ResourceNames()) -> DataFrame:
    """Mean and count of each measure by category: (category, key, cnt, avr).

    The first and the last sample of a recording are incomplete and left out: sums run over all
    samples, next to the values of each group's first and last one, and what the ends of a recording
    have added is taken off again. So samples are read once and aggregated once, by recording,
    category and tool, before a handful of sums is laid out by key. ``order`` is unique within a
    recording; see ``place_of`` for orders that a hash aggregate can hold.
    """
    rows = normalised(samples, cores).withColumn("category", sample_category(names))
    measures = [*_HOST, *[f"{slot}_{kind}" for slot in _SLOTS_BY_CATEGORY["proxy"]
                          for kind in ("cpu", "mem")]]
    place = place_of(rows, order)
    parts = [F.min(place).alias("_low"), F.max(place).alias("_high")]
    for measure in measures:
        slot = measure.rsplit("_", 1)[0]
        value = F.col(measure) if slot in ("app", measure) else F.when(_present(slot), F.col(measure))
        parts += [F.count(value).alias(f"{measure}_n"), F.sum(value).alias(f"{measure}_sum"),
                  F.min_by(value, place).alias(f"{measure}_first"), F.max_by(value, place).alias(f"{measure}_last")]
    recording = Window.partitionBy(*keys)
    groups = rows.groupBy(*keys, "category", "app_name").agg(*parts).withColumns({
        "_first": F.min("_low").over(recording), "_last": F.max("_high").over(recording)}).where("category IS NOT NULL")

    def inner(measure: str) -> list[Column]:
        ends = [F.when(F.col("_low") == F.col("_first"), F.col(f"{measure}_first")),
                F.when((F.col("_high") == F.col("_last")) & (F.col("_first") != F.col("_last")), F.col(f"{measure}_last"))]
        n, total = F.col(f"{measure}_n"), F.col(f"{measure}_sum")
        for end in ends:
            n, total = n - end.isNotNull().cast("int"), total - F.coalesce(end, F.lit(0.0))
        return [F.sum(n).alias(f"{measure}_n"), F.sum(F.when(n > 0, total)).alias(f"{measure}_sum")]

    sums = groups.groupBy("category", "app_name").agg(*[c for measure in measures for c in inner(measure)])

    cells = []
    for measure in measures:
        slot, _, kind = measure.rpartition("_")
        key = F.lit(measure) if not slot else (
            F.concat("app_name", F.lit(f"-{kind}")) if slot == "app" else F.lit(f"{slot}-{kind}"))
        within = [c for c, slots in _SLOTS_BY_CATEGORY.items() if not slot or slot in slots]
        cells.append(F.when(F.col("category").isin(*within), F.struct(
            key.alias("key"), F.col(f"{measure}_n").alias("n"), F.col(f"{measure}_sum").alias("total"))))
    long = sums.select("category", F.explode(F.array_compact(F.array(*cells))).alias("cell"))
    return (long.where("cell.n > 0").groupBy("category", "cell.key")
            .agg(F.sum("cell.n").alias("cnt"), ratio(F.sum("cell.total"), F.sum("cell.n")).alias("avr"))
            .select("category", "key", "cnt", "avr"))


def present_twice(processes: DataFrame, keys: Sequence[str], ts: str, process: str,
                  instants: DataFrame | None = None, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Keep a process value only if the process was in the sample before, too.

    A process has no CPU reading the first time it is seen. ``instants`` lists
    all samples when some of them hold no process at all.
    """
    clock = (processes if instants is None else instants).select(*keys, ts).distinct()
    linked = with_neighbour(clock, keys, ts, {"_before": F.col(ts)}, "previous", seconds=seconds)
    seen = processes.select(*keys, F.col(ts).alias("_before"), process)
    return (processes.join(linked, [*keys, ts])
            .join(seen, [*keys, "_before", process], "left_semi").select(*processes.columns))


def tool_of_sample(processes: DataFrame, keys: Sequence[str], process: str,
                   names: ResourceNames = ResourceNames()) -> DataFrame:
    """The tool that takes the sample's slot: the first present one by priority."""
    rank, pick = None, None
    for place, name in enumerate(names.by_priority):
        rank = F.when(F.col(process) == name, place) if rank is None else \
            rank.when(F.col(process) == name, place)
        pick = F.when(F.col("_rank") == place, name) if pick is None else \
            pick.when(F.col("_rank") == place, name)
    return (processes.groupBy(*keys).agg(F.min(rank).alias("_rank"))
            .select(*keys, pick.otherwise(names.no_tool).alias("app_name")))
