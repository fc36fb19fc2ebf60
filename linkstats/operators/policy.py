"""Score interface states against policy rules and pick the best interface.

A rule applies to a state when all of its match conditions hold. It then
adds the scores of its properties that hold. How rules apply is defined here;
rules and scores are data (see ``linkstats.sources.policies``).

The ends of all ranges of a name, sorted once, cut its readings into elementary
intervals: the ends themselves, and what lies between two of them. A range holds on
whole intervals only, so a reading needs its interval number, by binary search, and
meets the rules that hold there through an equality join on name and number.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstats.session import scratch_dir

STATE_READINGS = ("device_mode", "rssi", "lte_rsrp", "lte_rsrq", "dlb_quality")

ALWAYS = ""  # name of a reading that every state has

#: Distinct range ends and texts of one name. They become part of the plan.
MOST_ENDS = 100_000

#: Pairs of a state and a rule that one task may have to keep apart, at most.
PAIRS_A_TASK = 1_000_000


def _stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame, computed once and read back, so that Spark knows its size when it picks a join."""
    folder = scratch_dir(frame.sparkSession, label)
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def _place(sorted_values: Sequence, value: Column) -> tuple[Column, Column]:
    """How many of the values are less than ``value``, and whether it is one of them, by binary search."""
    if not sorted_values:
        return F.lit(0), F.lit(False)
    known = F.array(*map(F.lit, sorted_values))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(sorted_values).bit_length()))])
    less = F.aggregate(steps, F.lit(0), lambda k, step: F.when(F.get(known, k + step - 1) < value, k + step).otherwise(k))
    return less, F.coalesce(F.get(known, less) == value, F.lit(False))


@dataclass(frozen=True)
class Slots:
    """Elementary intervals and texts of one name. A slot is a pair of both: a reading is in exactly one."""

    ends: tuple[float, ...]
    texts: tuple[str, ...]

    @property
    def last_interval(self) -> int:
        return 2 * len(self.ends)

    def interval(self, number: Column) -> Column:
        """Odd on an end, even between two; -1 for what is no number."""
        less, on_end = _place(self.ends, number)
        return F.when(number.isNull(), -1).otherwise(2 * less + on_end.cast("int"))

    def text(self, text: Column) -> Column:
        """From 1 for the texts that rules name, 0 for all others."""
        less, known = _place(self.texts, text)
        return F.when(known, less + 1).otherwise(0)

    def slot(self, interval: Column, text: Column) -> Column:
        return interval.cast("bigint") * (len(self.texts) + 1) + text

    def of_reading(self, name: str) -> Column:
        return self.slot(self.interval(F.col(name).try_cast("double")), self.text(F.col(name).cast("string")))


def _entries(rules: DataFrame) -> DataFrame:
    group = F.col("group_no") if "group_no" in rules.columns else F.lit(0)
    text = F.col("text_value") if "text_value" in rules.columns else F.lit(None).cast("string")
    return rules.select("uid", "role", "name", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"),
                        F.col("score").cast("double").alias("score"), group.alias("group_no"),
                        text.alias("text_value")).distinct()


def slots_of(entries: DataFrame, readings: Sequence[str]) -> dict[str, Slots]:
    """Slots of the names that rules use. One row per name reaches the driver."""
    known = (entries.where(F.col("name").isin(*readings)).groupBy("name")
             .agg(F.collect_set("lo").alias("lo"), F.collect_set("hi").alias("hi"), F.collect_set("text_value").alias("texts"))
             .select("name", F.array_sort(F.array_union("lo", "hi")).alias("ends"), F.array_sort("texts").alias("texts")))
    found = {}
    for row in known.collect():
        if len(row["ends"]) > MOST_ENDS or len(row["texts"]) > MOST_ENDS:
            raise ValueError(f"rules have more than {MOST_ENDS} range ends or texts of {row['name']}")
        found[row["name"]] = Slots(tuple(row["ends"]), tuple(row["texts"]))
    return found


def held_rules(entries: DataFrame, slots: dict[str, Slots]) -> DataFrame:
    """(name, slot, uid, needed, met, score): the rules that hold in each slot, what they add there, whether one of
    their conditions is met, and how many names they must meet. A rule without conditions holds for every state."""
    needed = entries.groupBy("uid").agg(
        F.count_distinct(F.when(F.col("role") == "match", F.col("name"))).alias("needed"))
    parts = []
    for name, s in slots.items():
        of_name = entries.where(F.col("name") == name)
        whole = F.sequence(F.lit(-1), F.lit(s.last_interval))
        by_range = of_name.where("lo <= hi").withColumn("interval", F.explode(F.sequence(
            s.interval(F.col("lo")), s.interval(F.col("hi"))))).withColumn("text", F.explode(F.sequence(F.lit(0), F.lit(len(s.texts)))))
        by_text = of_name.where("text_value IS NOT NULL").withColumn("interval", F.explode(whole)).withColumn(
            "text", s.text(F.col("text_value")))
        # a property counts once for each group, name and score, whichever of its alternatives hold
        parts += [p.select("name", s.slot(F.col("interval"), F.col("text")).alias("slot"), "uid", "role", "group_no", "score")
                  for p in (by_range, by_text)]
    held = None
    for part in parts:
        held = part if held is None else held.union(part)
    free = needed.where("needed = 0").select(
        F.lit(ALWAYS).alias("name"), F.lit(0).cast("bigint").alias("slot"), "uid", "needed", F.lit(0).alias("met"),
        F.lit(0.0).alias("score"))
    if held is None:
        return free
    of_property = F.when(F.col("role") == "property", F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    return held.distinct().groupBy("name", "slot", "uid").agg(
        F.max((F.col("role") == "match").cast("int")).alias("met"), F.sum(of_property).alias("score")).join(needed, "uid").select(
        *free.columns).union(free)


def rule_scores(states: DataFrame, rules: DataFrame, keys: Sequence[str],
                readings: Sequence[str] = STATE_READINGS) -> DataFrame:
    """Score of each rule that applies to each state: (keys, uid, score).

    A rule applies when for every name in its match conditions one of the alternatives
    holds: a range for a number, equality for a text. A rule without conditions applies
    to every state. A property counts once for each group, name and score, whichever of its
    alternatives hold.

    States are shuffled once, before their slots are laid out one per row. As long as
    Spark can broadcast the rules, putting them back together by state needs no further
    shuffle. Rules are stored first: what they are derived from may be large where they are
    few. States are dealt out to so many tasks that the sums of each stay in memory.
    """
    entries = _stored(_entries(rules), "rule_entries")
    slots = slots_of(entries, readings)
    held = _stored(held_rules(entries, slots), "held_rules")
    pairs = states.count() * held.select(F.count_distinct("uid")).first()[0]
    cells = F.array_compact(F.array(
        F.struct(F.lit(ALWAYS).alias("name"), F.lit(0).cast("bigint").alias("slot")), *[
            F.when(F.col(name).isNotNull(), F.struct(F.lit(name).alias("name"), slots[name].of_reading(name).alias("slot")))
            for name in readings if name in slots]))
    long = states.repartition(1 + pairs // PAIRS_A_TASK, *keys).select(*keys, F.explode(cells).alias("c")).select(*keys, "c.name", "c.slot")
    scored = long.join(held, ["name", "slot"]).groupBy(*keys, "uid", "needed").agg(
        F.sum("met").alias("met"), F.sum("score").alias("score"))
    return scored.where("met = needed").select(*keys, "uid", "score")


def state_scores(states: DataFrame, rules: DataFrame, keys: Sequence[str],
                 readings: Sequence[str] = STATE_READINGS) -> DataFrame:
    """Total score of each state to which some rule applies."""
    return (rule_scores(states, rules, keys, readings).groupBy(*keys)
            .agg(F.sum("score").alias("score"), F.count("*").alias("rules")))


def best_interface(scores: DataFrame, keys: Sequence[str], interface: str = "if_name") -> DataFrame:
    """Interface with the highest score by key; of equal ones the last by name."""
    best = F.max(F.struct("score", interface))
    return (scores.groupBy(*keys).agg(best.alias("_best"))
            .select(*keys, F.col(f"_best.{interface}").alias(interface),
                    F.col("_best.score").alias("score")))
