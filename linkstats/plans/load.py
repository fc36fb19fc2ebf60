"""Load a campaign's raw result files into the fact and state tables.

A load reads the files of the listed schedules once and keeps their lines in a scratch folder;
``sched_id`` is a column like any other. Folders of other schedules are not opened.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats import schemas
from linkstats.operators.asof import asof_join
from linkstats.operators.enrich import with_interface, with_span
from linkstats.operators.keys import unique_mapping
from linkstats.session import remove_scratch, scratch_dir
from linkstats.sinks.versions import Published, TableStore
from linkstats.sources import files
from linkstats.sources.experiments import read_experiment_configs
from linkstats.sources.logs import read_metadata_log, read_policy_log
from linkstats.sources.probes import read_downloads, read_pings

RESULT_FILES = {files.PING_NAME: files.PING_GLOB, files.METADATA_NAME: f"{files.METADATA_NAME}-*.txt*",
                files.POLICY_LOG_NAME: f"{files.POLICY_LOG_NAME}-*.txt*", files.DOWNLOAD_NAME: files.DOWNLOAD_GLOB}
TABLE_KEYS = {"tcp_ping": schemas.PROBE_KEY, "dwnl_test": schemas.PROBE_KEY,
              "metadata": schemas.METADATA_KEY}


def address_map(log: DataFrame) -> DataFrame:
    """(sched_id, local_ip) -> if_name; raises if an address changed its interface."""
    return unique_mapping(log, ["sched_id", "local_ip"], "if_name")


def operator_map(states: DataFrame) -> DataFrame:
    """(sched_id, if_name) -> oper; raises if an interface changed its operator."""
    named = states.select("sched_id", F.col("iif_name").alias("if_name"),
                          F.col("imsimccmnc").alias("oper"))
    return unique_mapping(named, ["sched_id", "if_name"], "oper")


def shielded(states: DataFrame, personal: str = "drop") -> DataFrame:
    """Personal identifiers: ``drop`` (NULL), ``hash`` (SHA-256) or ``keep``."""
    if personal == "keep":
        return states
    if personal == "hash":
        return states.withColumns({c: F.sha2(c, 256) for c in schemas.PERSONAL_COLUMNS})
    return states.withColumns({c: F.lit(None).cast("string") for c in schemas.PERSONAL_COLUMNS})


def _kept(mapping: DataFrame, path: str) -> DataFrame:
    """A mapping written once, as each table looks it up in two places. The shuffle lets a key with two values fail by
    itself; where two places come upon it at once, Spark reports neither."""
    mapping.repartition("sched_id").write.parquet(path)
    return mapping.sparkSession.read.schema(mapping.schema).parquet(path)


Keep = Callable[[DataFrame, str], DataFrame]


def campaign_tables(spark: SparkSession, config: str, root: str, personal: str = "drop",
                    keep: Keep = lambda frame, name: frame, scratch: str | None = None) -> dict[str, DataFrame]:
    """The three tables of all schedules named in the experiment configs.

    Probes get ids, interface and operator lookups, and the time of their state. ``keep`` may
    store a table as soon as it is known; probes then look up the states that it gives back.
    A listed schedule without a folder has no rows. With ``scratch``, a new folder, every file is read
    once and now, and the tables come from the lines kept there; else files are read whenever a table is.
    """
    schedules = read_experiment_configs(spark, config)
    folders = files.folders_of(spark, root, schedules)
    found = folders if scratch is None else files.store_result_lines(spark, folders, f"{scratch}/lines", RESULT_FILES)
    spans = with_span(read_metadata_log(spark, found).join(schedules, "sched_id"))
    states = keep(shielded(spans, personal).select(*schemas.METADATA.names), "metadata")
    listed = read_policy_log(spark, found).join(schedules.select("sched_id").distinct(), "sched_id", "left_semi")
    addresses, operators = address_map(listed), operator_map(states)
    if scratch is not None:
        addresses, operators = _kept(addresses, f"{scratch}/addresses"), _kept(operators, f"{scratch}/operators")

    def facts(raw: DataFrame, name: str, columns: list[str]) -> DataFrame:
        named = with_interface(raw.join(schedules, "sched_id"), addresses, operators)
        return keep(asof_join(named, states, {"sched_id": "sched_id", "if_name": "iif_name"},
                              "run_dtm", "ts", {"m_ts": "ts"}).select(*columns), name)

    return {
        "tcp_ping": facts(read_pings(spark, found), "tcp_ping", schemas.TCP_PING.names),
        "dwnl_test": facts(read_downloads(spark, found), "dwnl_test", schemas.DWNL_TEST.names),
        "metadata": states,
    }


def load_campaign(spark: SparkSession, config: str, root: str, target: str,
                  personal: str = "drop", experiments: DataFrame | None = None) -> Published:
    """Read, check and store a campaign, all of it or nothing; returns the published tables.

    Every table is written once, by experiment, and checked where it lies. All of them become
    visible at once (see ``sinks.versions``). Experiments named in the configs replace what the store
    held of them; others stay. With ``experiments``, the dimension is stored as well, as
    ``Campaign.from_tables`` needs it.
    """
    listed = read_experiment_configs(spark, config).select("exp_id").distinct().collect()
    store, scratch = TableStore(spark, target), scratch_dir(spark, "result-lines")
    with store.load(f"exp_id={r.exp_id}" for r in listed) as load:
        try:
            with files.small_files(spark):
                campaign_tables(spark, config, root, personal,
                                lambda frame, name: load.write(name, frame, TABLE_KEYS[name], "exp_id"), scratch)
        finally:
            remove_scratch(spark, scratch)
        if experiments is not None:
            load.write("experiment", experiments, schemas.EXPERIMENT_KEY)
    return load.published
