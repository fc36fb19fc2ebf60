"""The reports: gains, distributions and breakdowns of one batch of experiments."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstats.functions.measures import (Arms, experiment_label, non_default_share, ratio,
                                          reported_gain, round_to, to_mib, to_ms, to_percent)
from linkstats.operators.distributions import (bucket_parts, rtt_breakdown, share_columns,
                                               span_parts, speed_breakdown, weighted_mean)
from linkstats.operators.summary import INTERFACES, MODES, QUALITIES, one_side
from linkstats.operators.totals import additive_parts, with_total
from linkstats.plans.campaign import Campaign
from linkstats.sources.experiments import with_experiment

Report = Callable[[Campaign], DataFrame]

# All modes a modem may report, by column name.
STATE_MODES = MODES | {"no_service": "NO SERVICE", "disconnected": "DISCONNECTED",
                       "unknown": "UNKNOWN"}


def by_experiment(c: Campaign, frame: DataFrame, parts: dict[str, Column],
                  counts: Sequence[str] = (), is_summary: bool = True) -> DataFrame:
    """Additive parts per experiment of the batch, with a TOTAL row."""
    grouped = additive_parts(c.of_batch(frame, is_summary), ["exp_id"], parts)
    labelled = with_experiment(grouped, c.experiments, c.batch)
    return with_total(labelled, ["exp_id"], experiment_label(), list(parts), "exp_name", counts)


# --- segments of schedules -----------------------------------------------------------

def share_of(arms: Arms) -> Column:
    return non_default_share(cnt_t=arms.named("cnt"), cnt_op0_t=arms.named("cnt_op0"),
                             cnt_op1_t=arms.named("cnt_op1"))


def often_elsewhere(arms: Arms, least: float = 0.2) -> Column:
    """More than ``least`` of the treatment runs left the default interface."""
    return share_of(arms) > least


def never_elsewhere(arms: Arms) -> Column:
    return share_of(arms) == 0.0


def any_non_lte(arms: Arms) -> Column:
    """Some run of either arm was not on LTE."""
    return ((F.col("cnt_lte") != F.col("cnt"))
            | (F.col(arms.named("cnt_lte")) != F.col(arms.named("cnt"))))


def in_segment(c: Campaign, side: str, segment: Column | None) -> DataFrame:
    """One side's summary of the schedules in a segment.

    The segment looks at pings and downloads together, so the two summaries are
    joined once and the wanted side is taken from the pair.
    """
    if segment is None:
        return c.ping_summary if side == "ping" else c.download_summary
    return one_side(c.paired_summary.where(segment), side)


# --- gains --------------------------------------------------------------------------

def _mean_parts(arms: Arms, pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    parts = {}
    for name, (weight, value) in pairs.items():
        for suffix in ("", arms.treatment_suffix):
            top, bottom = weighted_mean(weight + suffix, value + suffix)
            parts[f"{name}_top{suffix}"], parts[f"{name}_weight{suffix}"] = top, bottom
    return parts


def _wins(better: Column) -> Column:
    # A schedule where either arm is missing counts as not won.
    return F.sum(F.when(better, 1).otherwise(0))


def rtt_gain(c: Campaign, segment: Column | None = None) -> DataFrame:
    t = c.arms.treatment_suffix
    parts = _mean_parts(c.arms, {"rtt": ("cnt_rtt", "rtt"), "init": ("cnt", "init_time")})
    parts |= {"wins": _wins(F.col(f"rtt{t}") < F.col("rtt")), "schedules": F.count("*")}
    rows = by_experiment(c, in_segment(c, "ping", segment), parts, ["schedules"])

    def mean(name: str, suffix: str = "") -> Column:
        return ratio(f"{name}_top{suffix}", f"{name}_weight{suffix}")

    arm_columns = []
    for suffix in ("", t):
        arm_columns += [F.col(f"rtt_weight{suffix}").alias(f"cnt{suffix}"),
                        round_to(to_ms(mean("rtt", suffix)), 1).alias(f"rtt_ms{suffix}"),
                        round_to(to_ms(mean("init", suffix)), 1).alias(f"init_ms{suffix}")]
    return rows.select(
        "exp_name", *arm_columns,
        round_to(reported_gain(mean("rtt", t), mean("rtt")), 2).alias("rtt_gain_pct"),
        round_to(to_percent(ratio("wins", "schedules")), 2).alias("win_cnt_pct"))


def download_gain(c: Campaign, segment: Column | None = None) -> DataFrame:
    t = c.arms.treatment_suffix
    parts = _mean_parts(c.arms, {"init": ("cnt", "init_time")})
    for suffix in ("", t):
        for name in ("cnt_dwnl", "dwnl_size", "dwnl_time"):
            parts[name + suffix] = F.sum(name + suffix)
    parts |= {"wins": _wins(F.col(f"dwnl_speed{t}") > F.col("dwnl_speed")), "schedules": F.count("*")}
    rows = by_experiment(c, in_segment(c, "dwnl", segment), parts, ["schedules"])

    def speed(suffix: str = "") -> Column:
        return ratio(f"dwnl_size{suffix}", f"dwnl_time{suffix}")

    arm_columns = []
    for suffix in ("", t):
        init = ratio(f"init_top{suffix}", f"init_weight{suffix}")
        arm_columns += [F.col(f"cnt_dwnl{suffix}").alias(f"cnt{suffix}"),
                        round_to(to_mib(f"dwnl_size{suffix}"), 0).alias(f"size_mb{suffix}"),
                        round_to(to_mib(speed(suffix)), 2).alias(f"speed_mbs{suffix}"),
                        round_to(to_ms(init), 1).alias(f"init_ms{suffix}")]
    return rows.select(
        "exp_name", *arm_columns,
        round_to(reported_gain(f"dwnl_size{t}", "dwnl_size"), 2).alias("size_gain_pct"),
        round_to(reported_gain(speed(t), speed()), 2).alias("speed_gain_pct"),
        round_to(to_percent(ratio("wins", "schedules")), 2).alias("win_cnt_pct"))


# --- distributions ------------------------------------------------------------------

def interface_histogram(c: Campaign, ratio_scale: int | None = 4) -> DataFrame:
    """How far the treatment leaves the default interface, in % of schedules."""
    parts = {"cnt": F.count("*")} | bucket_parts(share_of(c.arms), ratio_scale)
    rows = by_experiment(c, c.tool_summary, parts, ["cnt"])
    shares = [round_to(to_percent(ratio(name, "cnt")), 2).alias(name)
              for name in parts if name != "cnt"]
    return rows.select("exp_name", "cnt", *shares)


def state_distribution(c: Campaign, column: str, categories: dict[str, str]) -> DataFrame:
    """Percent of observed time per category of the interface states."""
    rows = by_experiment(c, c.v_metadata, span_parts(column, categories), is_summary=False)
    return rows.select("exp_name", *share_columns(list(categories), "span_", "span_all"))


def selection_shares(c: Campaign, categories: dict[str, str]) -> DataFrame:
    """Percent of runs per category, for each arm."""
    suffixes = ("", c.arms.treatment_suffix)
    names = ["cnt", *[f"cnt_{name}" for name in categories]]
    parts = {name + suffix: F.sum(name + suffix) for suffix in suffixes for name in names}
    rows = by_experiment(c, c.tool_summary, parts)
    columns = []
    for suffix in suffixes:
        columns += [F.col(f"cnt{suffix}"),
                    *share_columns(list(categories), "cnt_", f"cnt{suffix}", suffix)]
    return rows.select("exp_name", *columns)


# --- breakdowns ---------------------------------------------------------------------

def rtt_by(c: Campaign, *keys: str) -> DataFrame:
    """Echo round trips by category, fastest first."""
    echoes = c.of_batch(c.tcp_ping.where(F.col("ping_type") == "ECHO"))
    return rtt_breakdown(echoes if keys == ("oper",) else c.view(echoes), keys).orderBy(F.col("rtt_ms").asc_nulls_first())


def speed_by(c: Campaign, *keys: str) -> DataFrame:
    """Throughput by category, fastest first."""
    chosen = c.of_batch(c.dwnl_test)
    return speed_breakdown(chosen if keys == ("oper",) else c.view(chosen), keys).orderBy(F.col("speed_mbs").desc_nulls_last())


# --- per schedule ---------------------------------------------------------------------

_IDS = ("exp_id", "sched_id", "node_id")


def schedule_rtt_gain(c: Campaign) -> DataFrame:
    columns = []
    for suffix in ("", c.arms.treatment_suffix):
        columns += [F.col(f"cnt_rtt{suffix}").alias(f"cnt{suffix}"),
                    round_to(to_ms(f"rtt{suffix}"), 1).alias(f"rtt_ms{suffix}"),
                    round_to(to_ms(f"init_time{suffix}"), 1).alias(f"init_ms{suffix}")]
    gain = round_to(to_percent("rtt_gain"), 2).alias("rtt_gain_pct")
    return c.of_batch(c.ping_summary, True).select(*_IDS, *columns, gain)


def schedule_download_gain(c: Campaign) -> DataFrame:
    columns = []
    for suffix in ("", c.arms.treatment_suffix):
        columns += [F.col(f"cnt_dwnl{suffix}").alias(f"cnt{suffix}"),
                    round_to(to_mib(f"dwnl_size{suffix}"), 1).alias(f"size_mb{suffix}"),
                    round_to(to_mib(f"dwnl_speed{suffix}"), 2).alias(f"speed_mbs{suffix}"),
                    round_to(to_ms(f"init_time{suffix}"), 1).alias(f"init_ms{suffix}")]
    gains = [round_to(to_percent(f"{name}_gain"), 2).alias(f"{name}_gain_pct")
             for name in ("size", "speed")]
    return c.of_batch(c.download_summary, True).select(*_IDS, *columns, *gains)


def schedule_shares(c: Campaign, categories: dict[str, str]) -> DataFrame:
    columns = []
    for suffix in ("", c.arms.treatment_suffix):
        columns += [F.col(f"cnt{suffix}"),
                    *share_columns(list(categories), "cnt_", f"cnt{suffix}", suffix)]
    return c.of_batch(c.tool_summary, True).select(*_IDS, *columns)


REPORTS: dict[str, Report] = {
    "q1": rtt_gain,
    "q2": download_gain,
    "q3": interface_histogram,
    "q4": lambda c: rtt_gain(c, often_elsewhere(c.arms)),
    "q5": lambda c: download_gain(c, often_elsewhere(c.arms)),
    "q6": lambda c: rtt_gain(c, never_elsewhere(c.arms)),
    "q7": lambda c: download_gain(c, never_elsewhere(c.arms)),
    "q8": lambda c: state_distribution(c, "device_mode", STATE_MODES),
    "q9": lambda c: selection_shares(c, MODES),
    "q10": lambda c: rtt_gain(c, any_non_lte(c.arms)),
    "q11": lambda c: download_gain(c, any_non_lte(c.arms)),
    "q12": lambda c: state_distribution(c, "signal_quality", QUALITIES),
    "q13": lambda c: selection_shares(c, QUALITIES),
    "q14": lambda c: rtt_by(c, "oper"),
    "q15": lambda c: rtt_by(c, "device_mode"),
    "q16": lambda c: rtt_by(c, "signal_quality"),
    "q17": lambda c: rtt_by(c, "device_mode", "signal_quality"),
    "q18": lambda c: speed_by(c, "oper"),
    "q19": lambda c: speed_by(c, "device_mode"),
    "q20": lambda c: speed_by(c, "signal_quality"),
    "q21": lambda c: speed_by(c, "device_mode", "signal_quality"),
    "n1": schedule_rtt_gain,
    "n2": schedule_download_gain,
    "n3": lambda c: schedule_shares(c, INTERFACES),
    "n4": lambda c: schedule_shares(c, MODES),
    "n5": lambda c: schedule_shares(c, QUALITIES),
}


def run(name: str, campaign: Campaign) -> DataFrame:
    """A report by its key, over the facts of the campaign's batch."""
    return REPORTS[name](campaign.in_batch())
