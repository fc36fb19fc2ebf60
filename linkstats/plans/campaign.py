"""The frames a set of reports reads, built once and lazily."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from linkstats.functions.measures import Arms, SignalThresholds
from linkstats.operators.enrich import classified, join_state, with_state
from linkstats.operators.summary import download_summary, paired, ping_summary, tool_summary
from linkstats.schemas import SUMMARY_KEY
from linkstats.sinks.tables import replace_views
from linkstats.sinks.versions import Published, TableStore
from linkstats.sources.experiments import of_batch

SUMMARIES = ("ping_summary", "download_summary")


@dataclass
class Campaign:
    """The tables of one campaign and everything derived from them.

    Probes may carry their state columns already, or the time of their state
    (``m_ts``), or neither; what is missing is joined when a view needs it.
    """

    experiments: DataFrame
    tcp_ping: DataFrame
    dwnl_test: DataFrame
    metadata: DataFrame
    batch: str
    arms: Arms = field(default_factory=Arms)
    limits: SignalThresholds = field(default_factory=SignalThresholds)
    stored: dict[str, DataFrame] = field(default_factory=dict)
    narrowed: bool = False

    @classmethod
    def from_tables(cls, spark: SparkSession, tables: Published, batch: str, **options) -> "Campaign":
        """The tables of one published load (see ``plans.load``), read by experiment."""
        names = ("experiment", "tcp_ping", "dwnl_test", "metadata")
        return cls(*[tables.table(spark, name) for name in names], batch, **options)

    def in_batch(self) -> "Campaign":
        """Only the facts of the batch. Where tables are partitioned by experiment,
        the scan skips the others."""
        chosen = {name: of_batch(getattr(self, name), self.experiments, self.batch)
                  for name in ("tcp_ping", "dwnl_test", "metadata")}
        return replace(self, narrowed=True, **chosen)

    def of_batch(self, frame: DataFrame, is_summary: bool = False) -> DataFrame:
        """A frame of this campaign without other batches. Frames made from narrowed
        tables hold no others; stored summaries do."""
        if self.narrowed and not (is_summary and self.stored):
            return frame
        return of_batch(frame, self.experiments, self.batch)

    def view(self, probes: DataFrame) -> DataFrame:
        """Probes with state, mode label and signal class."""
        if "dev_mode" in probes.columns:
            attached = probes
        elif "m_ts" in probes.columns:
            attached = join_state(probes, self.metadata)
        else:
            attached = with_state(probes, self.metadata)
        return classified(attached, self.limits)

    @cached_property
    def v_metadata(self) -> DataFrame:
        return classified(self.metadata, self.limits)

    @cached_property
    def v_tcp_ping(self) -> DataFrame:
        return self.view(self.tcp_ping)

    @cached_property
    def v_dwnl_test(self) -> DataFrame:
        return self.view(self.dwnl_test)

    @cached_property
    def ping_summary(self) -> DataFrame:
        return self.stored.get("ping_summary") or ping_summary(self.v_tcp_ping, self.arms)

    @cached_property
    def download_summary(self) -> DataFrame:
        return self.stored.get("download_summary") or download_summary(self.v_dwnl_test, self.arms)

    @cached_property
    def tool_summary(self) -> DataFrame:
        return tool_summary(self.ping_summary, self.download_summary, self.arms)

    @cached_property
    def paired_summary(self) -> DataFrame:
        return paired(self.ping_summary, self.download_summary, self.arms)

    def with_stored_summaries(self, spark: SparkSession, path: str) -> "Campaign":
        """Write both summaries and read them from there; 16 of the reports share them. They are
        published together, and what was stored before stays until then."""
        with TableStore(spark, path).load() as load:
            stored = {name: load.write(name, getattr(self, name), SUMMARY_KEY) for name in SUMMARIES}
        return replace(self, stored=stored)

    def register_views(self, spark: SparkSession, prefix: str = "") -> None:
        """Create or replace a temporary view per table, for SQL users."""
        views = {"experiment": self.experiments, "v_metadata": self.v_metadata,
                 "v_tcp_ping": self.v_tcp_ping, "v_dwnl_test": self.v_dwnl_test,
                 "tcp_ping_avg": self.ping_summary, "dwnl_test_avg": self.download_summary,
                 "v_tool_avg": self.tool_summary}
        replace_views(spark, {prefix + name: frame for name, frame in views.items()})
