"""One query per operator and report, over the role tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import roles
from linkstats import schemas
from linkstats.functions import measures as m
from linkstats.functions import records, times
from linkstats.operators import distributions as dist
from linkstats.operators import flows, keys, policy, resources, slices, summary, totals
from linkstats.operators.enrich import join_state, with_interface, with_span, with_state
from linkstats.plans import load, reports
from linkstats.session import scratch_dir, use_utc
from linkstats.sinks import summaries, tables
from linkstats.sources import (configs, experiments, files, logs, policies, probes, samples, topic)
from linkstats.streaming import keyed, messages, record_log, windows
from linkstats.streaming import spans as streamed

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(*names: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        for name in names:
            _QUERIES[name] = fn
        return fn
    return register


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, times as microseconds, doubles to six decimals."""
    out = []
    for name, kind in df.dtypes:
        value = F.col(f"`{name}`")
        if kind in ("int", "smallint", "tinyint", "bigint"):
            value = value.cast("bigint")
        elif kind.startswith("timestamp"):
            value = times.micros(value)
        elif kind == "double":
            value = m.round_to(value, 6)
        out.append(value.alias(name))
    return df.select(*out)


# --- renderings of the roles as raw input ---------------------------------------------

def state_json(spark: SparkSession, sf: str) -> DataFrame:
    """States as JSON text ``body``; some keys are left out of some messages."""
    k = F.col("k")
    body = F.to_json(F.struct(
        F.col("seq_no").alias("SequenceNumber"), (times.micros("ts") / 1e6).alias("Timestamp"),
        F.col("iif_name").alias("InternalInterface"),
        F.col("dev_mode").alias("DeviceMode"), F.when(k % 10 != 0, F.col("rssi")).alias("RSSI"),
        F.col("lte_rsrq").alias("RSRQ"), F.col("lte_rsrp").alias("RSRP"),
        F.when(k % 7 != 0, 24000 + k % 3).alias("IMSIMCCMNC"),
        F.when(k % 4 != 0, F.concat(F.lit("net "), k)).alias("Operator")))
    return roles.states(spark, sf).withColumn("body", body)


def state_messages(spark: SparkSession, sf: str) -> DataFrame:
    """States as topic messages in full."""
    body = F.to_json(F.struct(
        F.col("seq_no").alias("SequenceNumber"), (times.micros("ts") / 1e6).alias("Timestamp"),
        F.col("iif_name").alias("InterfaceName"), F.col("dev_mode").alias("DeviceMode"),
        F.col("rssi").alias("RSSI"), F.col("lte_rsrq").alias("RSRQ"), F.col("lte_rsrp").alias("RSRP"),
        (24000 + F.col("k") % 3).alias("NWMCCMNC")))
    return roles.states(spark, sf).withColumn("value", F.concat(F.lit("META.MODEM "), body))


def wide_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as resource samples with up to four process slots."""
    k, value, kind = F.col("k"), F.col("value"), F.col("event_type")
    is_tool = kind.isin("click", "view", "purchase")

    def slot(name: str, every: int, cpu: float, pss: int) -> dict[str, Column]:
        here = k % every == 0
        return {f"{name}_name": F.when(here, name), f"{name}_cpu": F.when(here, value / cpu),
                f"{name}_pss": F.when(here, (k * pss).cast("bigint"))}

    columns = {
        "recording": F.col("user_id"), "cpu": value, "total": F.lit(8589934592),
        "avail": ((k + 1) * 1048576).cast("bigint"),
        "app_name": F.when(kind == "click", "tcp-ping").when(kind == "view", "t-tcp-ping")
                     .when(kind == "purchase", "dwnl-test").when(kind == "error", "(no-app)"),
        "app_cpu": F.when(is_tool & (k % 10 != 0), value),
        "app_pss": F.when(is_tool, (k * 1048576).cast("bigint")),
        **slot("exporter", 2, 2.0, 1024), **slot("policyd", 3, 4.0, 2048), **slot("proxy", 5, 8.0, 4096)}
    e = roles.events(spark, sf)
    return e.select("event_id", "ts", *[c.alias(n) for n, c in columns.items()])


def processes(spark: SparkSession, sf: str) -> DataFrame:
    """Processes seen per user and hour."""
    kind = F.col("event_type")
    name = (F.when(kind == "click", "tcp-ping").when(kind == "view", "t-tcp-ping")
            .when(kind == "purchase", "dwnl-test").when(kind == "error", "t-dwnl-test")
            .otherwise("exporter"))
    e = roles.events(spark, sf)
    return e.select(F.col("user_id").alias("recording"), F.date_trunc("hour", "ts").alias("seen_at"),
                    name.alias("process")).distinct()


def reads(spark: SparkSession, sf: str) -> DataFrame:
    return roles.events(spark, sf).select(
        "event_id", F.col("user_id").alias("flow_id"), "ts",
        (F.round(F.col("value") * 100).cast("bigint") * 10).alias("bytes"),
        (F.col("k") % 5).alias("protocol"), (F.col("event_id") * 1000 + F.col("k")).alias("bytes_total"))


def as_text(df: DataFrame, *columns: Column) -> DataFrame:
    """Tab-separated lines, with absent values left empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
                     .alias("value"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return roles.states(spark, sf).select(
        "event_id", "sched_id", "ts", F.col("iif_name").alias("if_name"),
        F.col("dev_mode").alias("device_mode"), "rssi", "lte_rsrp", "lte_rsrq",
        (F.col("k") % 4).alias("dlb_quality"))


def stored_rules(spark: SparkSession, sf: str) -> DataFrame:
    """One rule for each part size: lists of modes, ranges that overlap, and rules without a condition."""
    size, form = F.col("p_size"), F.col("p_size") % 3
    listed = F.format_string(
        '"match": {"device_mode": {"value": [3, 4, %d]}}, "properties": [[{"device_mode": {"value": 3, "precedence": 2, '
        '"score": 0}}, {"device_mode": {"value": 4, "precedence": 2, "score": %d}}]]}', size % 6, size % 20)
    ranged = F.format_string(
        '"match": {"device_mode": {"value": 4}, "rssi": {"value": {"start": -128, "end": -%d}}}, "properties": {"rssi": '
        '{"value": {"start": -100, "end": -%d}, "precedence": 2, "score": 15}, "lte_rsrq": {"value": {"start": -11, "end": '
        '-%d}, "precedence": 2, "score": 5}}}', size + 40, size + 50, size % 12)
    free = F.format_string(
        '"properties": {"dlb_quality": {"value": {"start": 0, "end": %d}, "precedence": 2, "score": 2}, "lte_rsrp": '
        '{"value": {"start": -128, "end": -%d}, "precedence": 2, "score": 7}}}', size % 4, size + 80)
    text = F.concat(F.lit('{"uid": "rule-'), size, F.lit('", "policy_type": "policy", '),
                    F.when(form == 0, listed).when(form == 1, ranged).otherwise(free))
    return policies.parse_policies(roles.table(spark, sf, "part").select("p_size").distinct().select(text.alias("value")))


# --- sources ------------------------------------------------------------------------------

@query("o_s1")
def experiment_configs(spark, sf):
    triples = roles.probes(spark, sf).select("exp_id", "sched_id", "node_id").distinct()
    schedule = F.create_map(F.col("sched_id").cast("string"), F.struct(F.col("node_id").alias("nodeid")))
    documents = triples.select(F.to_json(F.struct(F.col("exp_id").alias("id"),
                                                  schedule.alias("schedules"))).alias("value"))
    return experiments.parse_experiment_configs(documents)


@query("o_s2")
def result_files(spark, sf):
    kind = F.col("event_type")
    name = (F.when(kind == "click", "tcp-ping").when(kind == "view", "t-tcp-ping")
            .when(kind == "purchase", "tcp-ping-stderr").when(kind == "error", "x-tcp-ping")
            .otherwise("dwnl-test"))
    path = F.concat(F.lit("file:/campaign/"), F.col("user_id"), F.lit("/run/"), name, F.lit("-"),
                    F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(".txt"))
    listing = roles.events(spark, sf).select("event_id", path.alias("path"))
    return files.with_run_identity(listing, files.PING_NAME).select("event_id", "sched_id", "run_dtm")


@query("o_s3")
def address_lines(spark, sf):
    e = roles.events(spark, sf)
    ip = F.concat(F.lit("[local_ip|10.0."), F.col("user_id") % 250, F.lit("."), F.col("k") % 3, F.lit("]"))
    interface = F.concat(F.lit("[interface|op"), F.col("k") % 3, F.lit("]"))
    form = F.col("event_id") % 4
    line = (F.when(form == 0, "noise line").when(form == 1, F.concat(F.lit("seen "), ip, F.lit(" only")))
            .otherwise(F.concat(F.lit("12:00 "), interface, F.lit(" "), ip, F.lit(" up"))))
    lines = e.select("event_id", F.col("user_id").alias("sched_id"), line.alias("value"))
    return logs.parse_address_lines(lines)


@query("o_s4")
def metadata_lines(spark, sf):
    lines = state_json(spark, sf).select(F.col("body").alias("value"))
    noise = roles.events(spark, sf).where(~F.col("event_type").isin(*roles.STATE_EVENTS))
    noise = noise.select(F.when(F.col("k") % 2 == 0, "--------").otherwise("META.MODEM").alias("value"))
    return logs.parse_metadata_lines(lines.unionByName(noise)).select(
        "seq_no", "ts", "iif_name", "dev_mode", "rssi", "lte_rsrq", "lte_rsrp", "imsimccmnc", "op_name")


@query("o_s5")
def ping_rows(spark, sf):
    p = roles.probes(spark, sf)
    folder = scratch_dir(spark, "pings")
    as_text(p, F.col("run_tool"), F.col("iter_nr"), F.concat(F.lit("10.0.0."), F.col("k") % 5),
            F.lit("server"), F.col("event_id"), F.col("ping_type"),
            m.fixed_point("rtt", 9)).write.text(folder)
    return probes.read_tsv(spark, folder, schemas.PING_TSV).drop("remote_host")


@query("o_s6")
def download_rows(spark, sf):
    d = roles.downloads(spark, sf)
    folder = scratch_dir(spark, "downloads")
    as_text(d,
            F.col("run_tool"), F.col("iter_nr"), F.col("if_name"), F.lit("server"), F.lit(80),
            F.concat(F.lit("/f/"), F.col("l_orderkey")), F.col("dwnl_size"),
            m.fixed_point("init_time", 9), m.fixed_point("total_time", 9)).write.text(folder)
    return probes.read_tsv(spark, folder, schemas.DOWNLOAD_TSV).drop("remote_host", "remote_port")


@query("o_s7")
def sample_rows(spark, sf):
    s = wide_samples(spark, sf)
    folder = scratch_dir(spark, "samples")
    kinds = dict(s.dtypes)

    def text(name: str) -> Column:
        value = m.fixed_point(name, 9) if kinds[name] == "double" else F.col(name).cast("string")
        if name == "app_cpu":
            value = F.when(F.col("app_pss").isNotNull(), F.coalesce(value, F.lit("None")))
        return F.coalesce(value, F.lit("")).alias(name)

    # The clock column carries the event, which identifies the row.
    names = [f for f in schemas.SAMPLE_TSV.names if f != "ts"]
    (s.select(F.col("event_id").cast("string").alias("ts"), *map(text, names))
     .write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "")
     .csv(folder))
    back = samples.read_samples(spark, folder)
    return back.select(F.col("ts").cast("bigint").alias("event_id"), *names)


@query("o_s8")
def dimension(spark, sf):
    labelled = experiments.with_experiment(roles.probes(spark, sf), roles.experiments(spark))
    return (labelled.groupBy("exp_id", m.experiment_label().alias("label"), "batch")
            .agg(F.count("*").alias("cnt")).drop("exp_id"))


@query("o_s9")
def run_configs(spark, sf):
    p = roles.table(spark, sf, "part")
    good = F.to_json(F.struct(F.lit("tcp-ping t-tcp-ping").alias("run_commands"),
                              F.col("p_size").alias("run_count"),
                              (F.col("p_partkey") % 100).alias("ping_count")))
    torn = F.concat(F.lit('{"run_commands": "tcp-ping" "run_count": '), F.col("p_size"), F.lit("}"))
    documents = p.select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, torn).otherwise(good).alias("value"))
    return configs.parse_run_configs(documents).select(
        "p_partkey", F.col("_corrupt_record").isNotNull().cast("int").alias("corrupt"), "run_count",
        "ping_count", F.when(F.col("run_commands").isNotNull(), F.size("run_commands")).alias("commands"),
        F.col("run_commands")[0].alias("first_command"))


@query("o_s10")
def policy_rules(spark, sf):
    p = roles.table(spark, sf, "part")
    size = F.col("p_size")
    uid = F.concat(F.lit('{"uid": "rule-'), F.col("p_partkey"), F.lit('", "priority": '), size, F.when(
        F.col("p_partkey") % 2 == 0, F.lit(', "replace_matched": true, ')).otherwise(F.lit(", ")))
    listed = F.format_string(
        '"policy_type": "policy", "match": {"device_mode": {"value": [3, 4, %d]}}, "properties": '
        '[[{"device_mode": {"value": 3, "precedence": 2, "score": 0}}, '
        '{"device_mode": {"value": %d, "precedence": 2, "score": %d}}]]}',
        size, size, F.col("p_partkey") % 20)
    ranged = F.format_string(
        '"policy_type": "policy", "match": {"device_mode": {"value": 4}, "rssi": {"value": '
        '{"start": -128, "end": -%d}}}, "properties": {"rssi": {"value": {"start": -128, "end": -%d}, '
        '"precedence": 2, "score": 15}}}', size, size)
    profile = F.format_string(
        '"policy_type": "profile", "properties": [[{"interface": {"value": "op0", "precedence": 2}}, '
        '{"interface": {"value": "op%d", "precedence": 2}}]]}', size)
    form = F.col("p_partkey") % 3
    text = F.concat(uid, F.when(form == 0, listed).when(form == 1, ranged).otherwise(profile))
    parsed = policies.parse_policies(p.select(text.alias("value")))
    return parsed.withColumn("replaces", F.when(F.col("replace_matched"), "yes")).drop("replace_matched")


@query("o_s11")
def topic_messages(spark, sf):
    e = roles.events(spark, sf)
    kind = F.col("event_type")
    body = F.to_json(F.struct((F.col("k") % 6).alias("DeviceMode")))
    value = (F.when(kind == "click", F.concat(F.lit("OTHER.TOPIC "), body))
             .when(kind == "view", F.concat(F.lit("META.MODEM"), F.col("k")))
             .when(kind == "purchase", F.lit('META.MODEM {"DeviceMode": '))
             .otherwise(F.concat(F.lit("META.MODEM "), body)))
    parsed = topic.parse_messages(topic.split_messages(e.select("event_id", value.alias("value")), "META."))
    return parsed.select("event_id", F.coalesce("rejected", F.lit("ok")).alias("status"), "header", "dev_mode")


# --- sinks ----------------------------------------------------------------------------------

def _file_writer(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes lines (folder, file, value; sorted) as files below ``root`` and gives their number.

    Spark's writers choose file names themselves and take a write for each name and a rename for each folder. A
    task that is run again writes its files anew."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        last, out, files = (None, None), None, 0
        for batch in batches:
            rows = zip(*(batch.column(name).to_pylist() for name in ("folder", "file", "value")))
            for at, lines in groupby(rows, itemgetter(0, 1)):
                if out is None or at != last:
                    if out is not None:
                        out.close()
                    folder = f"{base}/{'__HIVE_DEFAULT_PARTITION__' if at[0] is None else at[0]}"
                    if out is None or at[0] != last[0]:
                        store.create_dir(folder)
                    last, out, files = at, store.open_output_stream(f"{folder}/{at[1]}"), files + 1
                out.write("".join(f"{line or ''}\n" for _, _, line in lines).encode())
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pydict({"files": pa.array([files], pa.int64())})
    return write


def write_raw_campaign(spark: SparkSession, sf: str, root: str, chosen: Column | None = None) -> None:
    """Result files of the role tables, named and laid out as the probes leave them: per schedule one log of
    addresses, one of modem states, and the pings of each tool and half of the month."""
    half = F.when(F.dayofmonth("run_dtm") < 16, "20240108").otherwise("20240122")
    number = F.regexp_extract("if_name", r"(\d+)", 1)
    runs, states = (frame if chosen is None else frame.where(chosen) for frame in (roles.probes(spark, sf), roles.states(spark, sf)))
    pings = runs.select(
        F.col("sched_id").alias("folder"), F.concat("run_tool", F.lit("-"), half, F.lit("-120000.txt")).alias("file"),
        F.concat_ws("\t", "run_tool", "event_id", F.concat(F.lit("10.0.0."), number), F.lit("server"), F.lit("1235"),
                    "ping_type", F.format_string("%.9f", "rtt")).alias("value"))
    record = F.to_json(F.struct(
        F.col("iif_name").alias("InternalInterface"), (F.unix_micros("ts") / 1e6).alias("Timestamp"),
        F.col("seq_no").alias("SequenceNumber"), F.col("dev_mode").alias("DeviceMode"),
        (F.lit(24000) + F.regexp_extract("iif_name", r"(\d+)", 1).cast("int")).alias("IMSIMCCMNC")))
    lines = states.select(F.col("sched_id").alias("folder"), F.lit("metadata-20240101-000000.txt").alias("file"),
                          record.alias("value"))
    addresses = runs.select(
        F.col("sched_id").alias("folder"), F.lit("policyd-20240101-000000.txt").alias("file"),
        F.format_string("up [interface|%s] [local_ip|10.0.0.%s]", "if_name", number).alias("value")).distinct()
    # The number of tasks is given, as it is the files that take the time and not their few bytes.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lines = pings.unionByName(lines).unionByName(addresses)
    (lines.repartition(tasks, "folder").sortWithinPartitions("folder", "file")
     .mapInArrow(_file_writer(root), "files bigint").agg(F.sum("files")).collect())
    nodes = F.map_from_entries(F.collect_list(F.struct(
        F.col("sched_id").cast("string"), F.struct(F.col("node_id").alias("nodeid")))))
    (runs.select("exp_id", "sched_id", "node_id").distinct().groupBy("exp_id").agg(nodes.alias("schedules"))
     .select(F.to_json(F.struct(F.col("exp_id").alias("id"), "schedules")).alias("value"))
     .repartition("value").write.option("maxRecordsPerFile", 1).text(f"{root}/config"))


@query("o_k1")
def stored_facts(spark, sf):
    folder = scratch_dir(spark, "campaign")
    write_raw_campaign(spark, sf, f"{folder}/raw")
    published = load.load_campaign(spark, f"{folder}/raw/config/*.txt", f"{folder}/raw", f"{folder}/tables")
    pings, states = (published.table(spark, name) for name in ("tcp_ping", "metadata"))
    return pings.groupBy("exp_id").agg(
        F.count("*").alias("cnt"), F.count("m_ts").alias("with_state"),
        F.sum(F.round(F.col("rtt") * 100000).cast("bigint")).alias("rtt_sum"),
        F.sum(F.unix_timestamp("run_dtm") - F.unix_timestamp("m_ts")).alias("state_age"), F.sum("oper").alias("oper_sum")).join(
        states.groupBy("exp_id").agg(F.count("*").alias("states")), "exp_id")


@query("o_k2")
def stored_summary(spark, sf):
    """Facts come in three loads, of which the second is loaded again; the catalog's table is replaced twice."""
    pings = roles.campaign(spark, sf).v_tcp_ping
    folder = scratch_dir(spark, "ping_summary")
    store = summaries.SummaryStore(spark, f"{folder}/store", buckets=4)
    third = F.col("event_id") % 3
    store.add("first", ping_summary=pings.where(third == 0))
    store.add("second", ping_summary=pings.where((third > 0) & (F.col("sched_id") % 2 == 0)))
    store.add("third", ping_summary=pings.where(third == 1))
    store.add("second", ping_summary=pings.where(third == 2))
    tables.replace_table(store.read("ping_summary").limit(1), "linkstats_ping_summary", folder)
    return tables.replace_table(store.read("ping_summary"), "linkstats_ping_summary", folder)


@query("o_k3")
def views(spark, sf):
    tables.replace_views(spark, {"v_tcp_ping": roles.campaign(spark, sf).v_tcp_ping})
    return spark.sql("SELECT device_mode, signal_quality, count(*) AS cnt FROM v_tcp_ping "
                     "GROUP BY device_mode, signal_quality")


@query("o_k4")
def repeated_keys(spark, sf):
    return keys.duplicate_keys(roles.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def state_stream_parts(spark: SparkSession, states: DataFrame) -> list[DataFrame]:
    """States cut into three time ranges, which arrive one after the other."""
    low, high = states.agg(F.min("ts"), F.max("ts")).first()
    cuts = [low + (high - low) * i / 3 for i in (1, 2)]
    ts = F.col("ts")
    return [states.where(ts < cuts[0]), states.where((ts >= cuts[0]) & (ts < cuts[1])),
            states.where(ts >= cuts[1])]


@query("o_k5", "o_t2")
def latest_states(spark, sf):
    rows = roles.states(spark, sf).select("sched_id", "iif_name", "ts", "seq_no", "dev_mode")
    folder = scratch_dir(spark, "latest")
    store = keyed.KeyedStore(f"{folder}/store", rows.schema, ("sched_id", "iif_name"), ("ts", "seq_no"), 8, 2)
    for part in state_stream_parts(spark, rows):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        keyed.start_latest(stream, store, f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return store.latest(spark)


@query("o_k7")
def report_text(spark, sf):
    report = overhead(spark, sf).withColumn("avr", m.round_to("avr", 6))
    folder = scratch_dir(spark, "report")
    tables.write_report(report, ["category", "key", "cnt", "avr"], folder)
    return spark.read.text(folder)


# --- streaming ------------------------------------------------------------------------------

def _property(name: str) -> Column:
    return F.get_json_object("record", f"$.properties.{name}.value")


def _radio(record_rows: DataFrame, *more: Column) -> DataFrame:
    return record_rows.select(
        "seq_no", "if_name", _property("device_mode").cast("int").alias("mode"),
        _property("lte_rssi").cast("int").alias("lte_rssi"),
        _property("lte_rsrp").cast("int").alias("lte_rsrp"),
        _property("rssi").cast("int").alias("rssi"), *more)


@query("o_t1", "o_k6")
def message_stream(spark, sf):
    """Good messages, bad ones, every tenth message again, and then all of it again by a query without checkpoint."""
    folder = scratch_dir(spark, "messages")
    sent = state_messages(spark, sf)
    torn = roles.probes(spark, sf).where("k % 10 = 0").select(
        F.concat(F.lit('META.MODEM {"SequenceNumber": '), "event_id").alias("value"))
    again = sent.where(F.col("seq_no") % 10 == 0)
    sent.select("value").union(torn).union(again.select("value")).write.text(f"{folder}/in/first")
    again.select("value").write.text(f"{folder}/in/second")
    log, bad = record_log.RecordLog(f"{folder}/records"), record_log.RecordLog(f"{folder}/rejected", ("value",))
    for checkpoint in ("checkpoint", "lost"):
        messages.start_records(topic.follow_files(spark, f"{folder}/in/*"), log, bad, f"{folder}/{checkpoint}", "META.",
                               trigger={"availableNow": True}, repeats_within="1 hour").awaitTermination()
    rejects = bad.read(spark).agg(F.count("*").alias("rejects"))
    return _radio(log.read(spark), F.get_json_object("record", "$.uid").alias("uid")).join(rejects)


@query("o_j7")
def quality_stream(spark, sf):
    folder = scratch_dir(spark, "quality")
    # The lookup names an interface per schedule, as each link has its own quality.
    sent = state_messages(spark, sf)
    named = sent.select(F.regexp_replace("value", '"InterfaceName":"op', F.concat(
        F.lit('"InterfaceName":"'), F.col("sched_id"), F.lit(":op"))).alias("value"))
    named.write.text(f"{folder}/in")

    def load() -> DataFrame:
        s = roles.table(spark, sf, "supplier")
        return s.select(F.explode(F.array(*[F.concat(F.col("s_suppkey"), F.lit(f":op{i}")) for i in range(3)]))
                        .alias("name"), F.col("s_nationkey").alias("conn"),
                        (F.col("s_suppkey") % 3).alias("quality"))

    messages.start_records(topic.follow_files(spark, f"{folder}/in"), messages.to_folder(f"{folder}/records"),
                           messages.to_folder(f"{folder}/rejected"), f"{folder}/checkpoint", "META.", load_quality=load,
                           trigger={"availableNow": True}).awaitTermination()
    back = spark.read.parquet(f"{folder}/records")
    return back.select("seq_no", F.substring_index("if_name", ":", -1).alias("if_name"),
                       _property("dlb_conn").cast("int").alias("conn"),
                       _property("dlb_quality").cast("int").alias("quality"))


@query("o_t3")
def refreshed_quality_stream(spark, sf):
    """Two runs of one stream; the lookup has changed by the second."""
    folder = scratch_dir(spark, "refresh")
    rows = roles.states(spark, sf)
    for version in (0, 1):
        sent = rows.where(F.col("seq_no") % 2 == version).select(
            F.concat(F.lit("META.MODEM "), F.to_json(F.struct(
                F.concat("sched_id", F.lit(":"), "iif_name").alias("InterfaceName"),
                F.col("seq_no").alias("SequenceNumber"), F.col("dev_mode").alias("DeviceMode")))).alias("value"))
        sent.write.mode("append").text(f"{folder}/in")

        def load(version=version) -> DataFrame:
            s = roles.table(spark, sf, "supplier")
            return s.select(F.explode(F.array(*[F.concat(F.col("s_suppkey"), F.lit(f":op{i}")) for i in range(3)]))
                            .alias("name"), F.col("s_nationkey").alias("conn"),
                            ((F.col("s_suppkey") + version) % 3).alias("quality"))

        messages.start_records(topic.follow_files(spark, f"{folder}/in"), messages.to_folder(f"{folder}/records"),
                               messages.to_folder(f"{folder}/rejected"), f"{folder}/checkpoint", "META.",
                               load_quality=load, trigger={"availableNow": True}).awaitTermination()
    return spark.read.parquet(f"{folder}/records").select(
        "seq_no", _property("dlb_conn").cast("int").alias("conn"), _property("dlb_quality").cast("int").alias("quality"))


@query("o_t4")
def span_stream(spark, sf):
    """States arrive up to two days out of order, and every fiftieth only after all others."""
    rows = roles.states(spark, sf).select("sched_id", "iif_name", "ts", "seq_no")
    folder = scratch_dir(spark, "spans")
    held = F.col("seq_no") % 50 == 0
    shifted = rows.where(~held).withColumn("arrival", F.col("ts") + F.make_dt_interval(hours=F.col("seq_no") * 7919 % 48))
    low, high = shifted.agg(F.min("arrival"), F.max("arrival")).first()
    cuts = [low + (high - low) * i / 3 for i in (1, 2)]
    arrival = F.col("arrival")
    for part in (shifted.where(arrival < cuts[0]), shifted.where((arrival >= cuts[0]) & (arrival < cuts[1])),
                 shifted.where(arrival >= cuts[1]), rows.where(held)):
        part.select(*rows.columns).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        streamed.start_spans(stream, f"{folder}/out", ["sched_id", "iif_name"], "ts", f"{folder}/checkpoint", "2 days",
                             ["seq_no"], {"availableNow": True}).awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq_no", "span", "late")


@query("o_t5")
def window_stream(spark, sf):
    """Every fortieth sample arrives after all others."""
    rows = wide_samples(spark, sf).select("ts", "app_name", "cpu")
    folder = scratch_dir(spark, "windows")
    held = F.unix_micros("ts") % 40 == 0
    parts = windows.window_parts
    for part in (rows.where(~held), rows.where(held)):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        windows.start_window_parts(parts(stream, ["app_name"], ["cpu"], width="1 hour", delay="10 minutes"), f"{folder}/out",
                                   f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    still_open = windows.open_windows(spark, f"{folder}/checkpoint", ["app_name"], ["cpu"])
    written = spark.read.parquet(f"{folder}/out")
    return windows.corrected_windows(written, ["app_name"], ["cpu"], still_open).drop("window_end")


# --- projections -----------------------------------------------------------------------------

@query("o_p1")
def mode_labels(spark, sf):
    code = F.when(F.col("k") % 11 != 0, F.col("k") % 8)
    return roles.events(spark, sf).select("event_id", m.device_mode(code).alias("device_mode"))


@query("o_p2")
def quality_classes(spark, sf):
    m.register_sql_functions(spark)
    return roles.states(spark, sf).select(
        "event_id", F.expr("signal_quality(dev_mode, rssi, lte_rsrq, lte_rsrp)").alias("signal_quality"))


@query("o_p3")
def conditional_values(spark, sf):
    return roles.probes(spark, sf).select(
        "event_id", m.choose(F.col("ping_type") == "ECHO", F.col("rtt")).alias("echo_rtt"),
        m.choose(F.col("iter_nr") == 1, F.lit(1), F.lit(0)).alias("is_first"))


@query("o_p4")
def units(spark, sf):
    return roles.events(spark, sf).select(
        "event_id", m.to_ms("value").alias("ms"), m.to_mib(F.col("k") * 1000000).alias("mib"),
        m.to_percent(F.col("k") / 7).alias("pct"))


@query("o_p5")
def rounded(spark, sf):
    value = F.col("value")
    return roles.events(spark, sf).select(
        "event_id", m.round_to(value / 3, 1).alias("one"), m.round_to(-value / 3, 2).alias("two"),
        m.round_to(value, 0).alias("none"))


@query("o_p6")
def labels(spark, sf):
    return experiments.with_experiment(roles.probes(spark, sf), roles.experiments(spark)).select(
        "event_id", m.experiment_label().alias("label"))


@query("o_p7")
def ratios(spark, sf):
    return roles.events(spark, sf).select("event_id", m.ratio("value", F.col("k") % 5).alias("share"))


@query("o_p8")
def gains(spark, sf):
    return roles.campaign(spark, sf).ping_summary.select(
        "sched_id", "cnt_gain", "rtt_gain", m.reported_gain("rtt_t", "rtt").alias("rtt_gain_pct"))


@query("o_p9")
def name_times(spark, sf):
    text = F.split(F.date_format("ts", "yyyyMMdd-HHmmss"), "-")
    return roles.events(spark, sf).select("event_id", times.name_epoch(text[0], text[1]).alias("epoch"))


@query("o_p10")
def epoch_times(spark, sf):
    return roles.events(spark, sf).select(
        "event_id", times.epoch_timestamp(times.micros("ts") / 1e6).alias("ts"))


@query("o_p11")
def json_defaults(spark, sf):
    lines = state_json(spark, sf)
    loaded = logs.parse_metadata_lines(lines.select(F.col("body").alias("value")))
    sent = lines.select(F.concat(F.lit("META.MODEM "), F.col("body")).alias("value"))
    streamed = topic.accepted(topic.parse_messages(topic.split_messages(sent), "InternalInterface"))
    left = loaded.select("seq_no", F.col("rssi").alias("rssi_loaded"), F.col("op_name").alias("op_loaded"))
    return left.join(streamed.select("seq_no", F.col("rssi").alias("rssi_streamed"),
                                     F.col("op_name").alias("op_streamed")), "seq_no")


@query("o_p12")
def narrowed(spark, sf):
    x, y = F.col("k") * 7 - 300, F.col("k") * 1000 - 50000
    return roles.events(spark, sf).select(
        "event_id", records.narrow(x, 8, True, "wrap").alias("wrapped8"),
        records.narrow(x, 8, False, "wrap").alias("wrapped_u8"),
        records.narrow(x, 8, True, "null").alias("fitted8"),
        records.narrow(y, 16, True, "wrap").alias("wrapped16"))


def record_rows(spark: SparkSession, sf: str) -> DataFrame:
    parsed = messages.parsed_messages(state_messages(spark, sf).select("value"), "META.")
    return messages.records(topic.accepted(parsed))


@query("o_p13")
def nested_records(spark, sf):
    def at(path: str) -> Column:
        return F.get_json_object("record", path)

    return record_rows(spark, sf).select(
        "seq_no", at("$.uid").alias("uid"), at("$.priority").cast("int").alias("priority"),
        at("$.link").alias("link"), at("$.match[0].uid.value").alias("matched"),
        at("$.properties.is_wired.value").alias("wired"),
        at("$.properties.lac.precedence").cast("int").alias("precedence"),
        at("$.properties.oper.value").cast("int").alias("oper"))


@query("o_p14")
def radio_properties(spark, sf):
    return _radio(record_rows(spark, sf))


@query("o_p15")
def host_units(spark, sf):
    return resources.normalised(wide_samples(spark, sf)).select(
        "event_id", "mem", "app_cpu", "app_mem", "proxy_cpu", "proxy_mem")


@query("o_p16")
def protocol_names(spark, sf):
    return reads(spark, sf).select("event_id", m.protocol_name("protocol").alias("protocol"))


@query("o_p17")
def readable_sizes(spark, sf):
    step = F.array(*[F.lit(float(f"1e{3 * i}")) for i in range(10)])
    amount = F.col("value") * F.element_at(step, F.col("k") % 10 + 1)
    return roles.events(spark, sf).select("event_id", m.human_size(amount).alias("size"))


@query("o_p18")
def elapsed(spark, sf):
    return roles.events(spark, sf).select(
        "event_id", times.elapsed_seconds(F.date_trunc("day", "ts"), "ts").alias("elapsed"))


@query("o_p19")
def arm_flags(spark, sf):
    arms, tool = m.Arms(), F.when(F.col("k") % 10 != 0, F.col("run_tool"))
    return roles.probes(spark, sf).withColumn("run_tool", tool).select(
        "event_id", F.when(arms.is_treatment(), "treatment").when(arms.is_baseline(), "baseline")
        .otherwise("none").alias("arm"))


@query("o_p20")
def default_share(spark, sf):
    return roles.campaign(spark, sf).tool_summary.select(
        "sched_id", m.non_default_share().alias("share"))


# --- filters -----------------------------------------------------------------------------------

@query("o_f1")
def batch_filter(spark, sf):
    chosen = experiments.of_batch(roles.probes(spark, sf), roles.experiments(spark), roles.BATCH)
    return chosen.groupBy("exp_id").agg(F.count("*").alias("cnt"))


@query("o_f2")
def arm_filter(spark, sf):
    arms = m.Arms()
    return roles.probes(spark, sf).groupBy("sched_id").agg(
        summary.count_or_zero(arms.is_treatment()).alias("treatment"),
        summary.count_or_zero(arms.is_baseline()).alias("baseline"))


@query("o_f3")
def equality_filter(spark, sf):
    v = roles.campaign(spark, sf).v_tcp_ping
    echo = (F.col("ping_type") == "ECHO") & (F.col("if_name") == "op1") & (F.col("device_mode") == "LTE")
    first = (F.col("iter_nr") == 1) & (F.col("signal_quality") == "FAIR")
    return v.where(echo | first).select("event_id")


@query("o_f4")
def interface_segments(spark, sf):
    c = roles.campaign(spark, sf)
    often, never = reports.often_elsewhere(c.arms), reports.never_elsewhere(c.arms)
    return c.tool_summary.where(often | never).select(
        "sched_id", F.when(often, "often").otherwise("never").alias("segment"))


@query("o_f5")
def mode_segment(spark, sf):
    c = roles.campaign(spark, sf, direct_mode=True)
    return c.tool_summary.where(reports.any_non_lte(c.arms)).select("sched_id")


@query("o_f6")
def bucket_filter(spark, sf):
    return roles.events(spark, sf).where(F.col("k").between(20, 40)).select("event_id")


@query("o_f7")
def list_filter(spark, sf):
    return roles.states(spark, sf).where(F.col("dev_mode").isin(*m.RSSI_CODES)).select("event_id")


@query("o_f8")
def line_filter(spark, sf):
    lines = roles.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    kept = lines.where(F.col("line").startswith("S")
                       | F.col("line").rlike(r"[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("o_f9")
def inner_samples(spark, sf):
    return slices.trim_ends(wide_samples(spark, sf), ["recording"], ["ts", "event_id"]).select("event_id")


@query("o_w3")
def inner_sample_sums(spark, sf):
    inner = slices.trim_ends(wide_samples(spark, sf), ["recording"], ["ts", "event_id"])
    return inner.groupBy("recording").agg(F.count("*").alias("cnt"), F.sum("cpu").alias("cpu"))


@query("o_f10")
def time_limited(spark, sf):
    runs = roles.events(spark, sf).withColumn("day", F.to_date("ts"))
    return slices.within_time_limit(runs, ["user_id", "day"], "ts", 21600,
                                    tiebreak=["event_id"]).select("event_id")


# --- joins ----------------------------------------------------------------------------------------

@query("o_j1")
def dimension_join(spark, sf):
    joined = experiments.with_experiment(roles.probes(spark, sf), roles.experiments(spark), roles.BATCH)
    return joined.select("event_id", m.experiment_label().alias("label"), "rtt")


@query("o_j2")
def stored_state_join(spark, sf):
    states = roles.states(spark, sf)
    stored = with_state(roles.probes(spark, sf), states).drop("dev_mode", "rssi", "lte_rsrq", "lte_rsrp")
    return join_state(stored, states).select("event_id", "m_ts", "dev_mode", "rssi")


@query("o_j3")
def summary_join(spark, sf):
    c = roles.campaign(spark, sf)
    return c.ping_summary.join(c.download_summary.select("sched_id", "cnt_dwnl", "dwnl_size"),
                               "sched_id", "left").select("sched_id", "cnt_rtt", "cnt_dwnl", "dwnl_size")


@query("o_j5")
def asof(spark, sf):
    return with_state(roles.probes(spark, sf), roles.states(spark, sf)).select(
        "event_id", "m_ts", "dev_mode", "rssi")


@query("o_w2")
def carried_state_time(spark, sf):
    # Wide slices: the state carried into a slice and the one within it both occur.
    held = with_state(roles.probes(spark, sf), roles.states(spark, sf), seconds=86400)
    return held.select("event_id", "m_ts")


@query("o_j6")
def lookups(spark, sf):
    states = roles.states(spark, sf)
    seen = states.select("sched_id", F.concat(F.lit("10.0.0."), F.col("k") % 3).alias("local_ip"),
                         F.col("iif_name").alias("if_name"), (24000 + F.col("k") % 3).alias("oper"))
    addresses = keys.unique_mapping(seen, ["sched_id", "local_ip"], "if_name")
    operators = keys.unique_mapping(seen, ["sched_id", "if_name"], "oper")
    raw = roles.probes(spark, sf).select(
        "event_id", "sched_id", F.concat(F.lit("10.0.0."), F.col("k") % 5).alias("local_ip"))
    return with_interface(raw, addresses, operators).select("event_id", "if_name", "oper")


@query("o_j8")
def three_way_join(spark, sf):
    c = roles.campaign(spark, sf)
    tool = c.tool_summary.select("sched_id", "cnt_t")
    return (experiments.with_experiment(c.ping_summary.select("sched_id", "exp_id", "cnt_rtt"), c.experiments)
            .join(tool, "sched_id", "left")
            .select("sched_id", m.experiment_label().alias("label"), "cnt_rtt", "cnt_t"))


@query("o_j9")
def scored_rules(spark, sf):
    return policy.rule_scores(candidates(spark, sf), stored_rules(spark, sf), ["event_id"])


@query("o_o4")
def best_interfaces(spark, sf):
    c = candidates(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    scores = policy.state_scores(c, stored_rules(spark, sf), ["event_id", "sched_id", "day", "if_name"])
    return policy.best_interface(scores, ["sched_id", "day"])


# --- aggregates ---------------------------------------------------------------------------------------

@query("o_a1")
def counts(spark, sf):
    return roles.probes(spark, sf).groupBy("sched_id").agg(F.count("*").alias("cnt"))


@query("o_a2")
def count_or_null(spark, sf):
    good = summary.count_or_null(F.col("signal_quality") == "GOOD").alias("good")
    return roles.campaign(spark, sf).v_tcp_ping.groupBy("sched_id").agg(good)


@query("o_a3")
def count_or_zero(spark, sf):
    good = summary.count_or_zero(F.col("signal_quality") == "GOOD").alias("good")
    return roles.campaign(spark, sf).v_tcp_ping.groupBy("sched_id").agg(good)


@query("o_a4")
def conditional_mean(spark, sf):
    return roles.probes(spark, sf).groupBy("sched_id").agg(
        summary.mean_where(F.col("ping_type") == "ECHO", "rtt").alias("rtt"),
        summary.sum_where(F.col("ping_type") == "CONN", "rtt").alias("conn"))


@query("o_a5")
def dependent_columns(spark, sf):
    return roles.probes(spark, sf).groupBy("sched_id").agg(
        F.min("exp_id").alias("exp_id"), F.min("node_id").alias("node_id"))


@query("o_a6")
def ping_summary(spark, sf):
    return roles.campaign(spark, sf).ping_summary


@query("o_a7")
def download_summary(spark, sf):
    return roles.campaign(spark, sf).download_summary


@query("o_a8")
def weighted_means(spark, sf):
    return roles.campaign(spark, sf).ping_summary.groupBy("exp_id").agg(
        m.ratio(*dist.weighted_mean("cnt_rtt", "rtt")).alias("rtt"),
        m.ratio(*dist.weighted_mean("cnt", "init_time")).alias("init"))


@query("o_a9")
def throughput(spark, sf):
    return roles.campaign(spark, sf).download_summary.groupBy("exp_id").agg(
        m.to_mib(m.ratio(F.sum("dwnl_size"), F.sum("dwnl_time"))).alias("speed"))


@query("o_a10")
def win_rate(spark, sf):
    won = F.when(F.col("rtt_t") < F.col("rtt"), 1).otherwise(0)
    return roles.campaign(spark, sf).ping_summary.groupBy("exp_id").agg(
        m.to_percent(F.avg(won)).alias("wins"))


@query("o_a11")
def groups_and_total(spark, sf):
    parts = {"cnt": F.count("*"), "rtt": F.sum("rtt")}
    return reports.by_experiment(roles.campaign(spark, sf), roles.probes(spark, sf), parts, ["cnt"], False)


@query("o_u1")
def stacked_total(spark, sf):
    chosen = experiments.with_experiment(roles.probes(spark, sf), roles.experiments(spark), roles.BATCH)
    sums = [F.count("*").alias("cnt"), F.sum("rtt").alias("rtt")]
    groups = chosen.groupBy("exp_id", m.experiment_label().alias("exp_name")).agg(*sums).drop("exp_id")
    return groups.unionByName(chosen.agg(*sums).withColumn("exp_name", F.lit(totals.TOTAL)))


@query("o_a12")
def global_aggregate(spark, sf):
    return roles.probes(spark, sf).agg(F.count("*").alias("cnt"), F.avg("rtt").alias("rtt"),
                                       F.min("rtt").alias("low"), F.max("rtt").alias("high"))


@query("o_a13")
def span_shares(spark, sf):
    return dist.span_distribution(roles.campaign(spark, sf).v_metadata, ["exp_id"], "device_mode",
                                  reports.STATE_MODES)


@query("o_a14")
def count_shares(spark, sf):
    names = list(summary.QUALITIES)
    sums = roles.campaign(spark, sf).tool_summary.groupBy("exp_id").agg(
        F.sum("cnt").alias("cnt"), *[F.sum(f"cnt_{n}").alias(f"cnt_{n}") for n in names])
    return sums.select("exp_id", *dist.share_columns(names, "cnt_", "cnt", digits=None))


@query("o_a15")
def histogram(spark, sf):
    c = roles.campaign(spark, sf)
    return dist.share_histogram(c.tool_summary, ["exp_id"], reports.share_of(c.arms))


@query("o_a16")
def breakdown(spark, sf):
    return dist.rtt_breakdown(roles.campaign(spark, sf).v_tcp_ping, ["if_name", "device_mode"])


@query("o_a17")
def merged_summary(spark, sf):
    return roles.campaign(spark, sf).tool_summary


@query("o_u2")
def stacked_summary(spark, sf):
    c = roles.campaign(spark, sf)
    return summary.tool_summary(c.ping_summary, c.download_summary, combine="stack")


@query("o_a18")
def mapping_check(spark, sf):
    seen = roles.probes(spark, sf).select(
        "sched_id", F.concat(F.lit("10.0.0."), F.col("k") % 7).alias("local_ip"), "if_name")
    key = ["sched_id", "local_ip"]
    clear = keys.unique_mapping(seen, key, "if_name", strict=False)
    clashing = keys.mapping_conflicts(seen, key, "if_name")
    return clear.select(*key, F.lit("unique").alias("status"), "if_name", F.col("if_name").alias("other")) \
        .unionByName(clashing.select(*key, F.lit("conflict").alias("status"),
                                     F.col("if_name_min").alias("if_name"),
                                     F.col("if_name_max").alias("other")))


@query("o_a19")
def present_means(spark, sf):
    return resources.mean_and_count(wide_samples(spark, sf), ["app_name"], "app_cpu")


@query("o_a20", "r1")
def overhead(spark, sf):
    return resources.overhead_report(wide_samples(spark, sf), ["recording"], ["ts", "event_id"])


@query("o_a21")
def flow_summaries(spark, sf):
    return flows.flow_summary(reads(spark, sf)).drop("first_ts", "last_ts")


# --- windows and order ------------------------------------------------------------------------------------

@query("o_w1")
def spans(spark, sf):
    return with_span(roles.states(spark, sf)).select("seq_no", "span")


@query("o_w4")
def interval_rates(spark, sf):
    return flows.interval_rate(reads(spark, sf), tiebreak=["event_id"]).select(
        "event_id", "interval_bytes", "interval_seconds", "rate_bps")


@query("o_w5")
def consecutive(spark, sf):
    return resources.present_twice(processes(spark, sf), ["recording"], "seen_at", "process")


@query("o_w6")
def iterations(spark, sf):
    p = roles.probes(spark, sf).select("event_id", "sched_id", "run_tool", "run_dtm")
    numbered = slices.with_row_number(p, ["sched_id", "run_tool"], "run_dtm", "n", ["event_id"])
    return numbered.select("event_id", "n", slices.probe_kind("n").alias("kind"))


@query("o_o1")
def rtt_order(spark, sf):
    echoes = roles.probes(spark, sf).where(F.col("ping_type") == "ECHO")
    by = Window.orderBy(F.col("rtt_ms").asc_nulls_first(), "oper")
    return dist.rtt_breakdown(echoes, ["oper"]).withColumn("place", F.row_number().over(by))


@query("o_o2")
def speed_order(spark, sf):
    by = Window.orderBy(F.col("speed_mbs").desc_nulls_last(), "oper")
    return dist.speed_breakdown(roles.downloads(spark, sf), ["oper"]).withColumn(
        "place", F.row_number().over(by))


@query("o_o3")
def slot_owner(spark, sf):
    return resources.tool_of_sample(processes(spark, sf), ["recording", "seen_at"], "process")


# --- all ------------------------------------------------------------------------------------------------

def _report(name: str) -> Query:
    # These two look at modes other than LTE, which the stand-in states hardly vary.
    direct = name in ("q10", "q11")
    return lambda spark, sf: reports.run(name, roles.campaign(spark, sf, direct))


def _checked(fn: Query) -> Query:
    return lambda spark, sf: comparable(fn(use_utc(spark), sf))


def all_queries() -> dict[str, Query]:
    named = dict(_QUERIES) | {name: _report(name) for name in reports.REPORTS}
    return {name: _checked(fn) for name, fn in named.items()}
