"""Raw files to tables, end to end, on a hand-made campaign."""

from datetime import datetime
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from checks import queries
from linkstats import schemas
from linkstats.operators.keys import DuplicateKeyError
from linkstats.plans import reports
from linkstats.plans.campaign import Campaign
from linkstats.plans.load import campaign_tables, load_campaign
from linkstats.session import scratch_dir
from linkstats.sinks import versions
from linkstats.sinks.tables import report_lines
from linkstats.sinks.versions import TableStore
from linkstats.sources import configs, files, logs, policies, probes, samples
from linkstats.sources.experiments import experiment_dimension, read_experiment_configs

LOG = ("noise line\n2024 x [interface|op0] [local_ip|10.0.0.1] y\n"
       "2024 x [local_ip|10.0.0.2] [interface|op1]\n2024 [local_ip|10.0.0.3] only\n")
META = ("--------\nTOPIC.MODEM\n"
        '{"InternalInterface":"op0","Timestamp":1704449600.25,"SequenceNumber":1,"DeviceMode":5,'
        '"RSRQ":-6,"RSRP":-95,"IMSIMCCMNC":24001,"IMSI":"123"}\n'
        '{"InternalInterface":"op1","Timestamp":1704449610.0,"SequenceNumber":2,"DeviceMode":4,'
        '"RSSI":-80,"IMSIMCCMNC":24002}\n'
        '{"InternalInterface":"op0","Timestamp":1704449660.25,"SequenceNumber":3,"DeviceMode":5,'
        '"RSRQ":-9,"RSRP":-105,"IMSIMCCMNC":24001}\n')
PING = ("tcp-ping\t1\t10.0.0.1\tserver\t1235\tCONN\t0.080000000\n"
        "tcp-ping\t2\t10.0.0.1\tserver\t1235\tECHO\t0.050000000\n")
T_PING = "t-tcp-ping\t1\t?\tserver\t1235\tCONN\t0.070000000\n"
DWNL = "dwnl-test\t1\t10.0.0.1\tserver\t80\t/f\t1048576\t0.100000000\t1.100000000\n"
T_DWNL = "t-dwnl-test\t1\t10.0.0.2\tserver\t80\t/f\t2097152\t0.200000000\t1.200000000\n"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def raw(tmp_path):
    root = tmp_path / "campaign"
    put(tmp_path / "config.json", '{"id": 900, "schedules": {"7001": {"nodeid": 41}, "7002": {"nodeid": 42}}}')
    for sched in ("7001", "7002"):
        put(root / sched / "policyd-20240105-101000.txt", LOG)
        put(root / sched / "metadata-20240105-101000.txt", META)
    # 10:13:25 is before any state, 10:14:00 after the second of op0.
    put(root / "7001" / "tcp-ping-20240105-101325.txt", PING)
    put(root / "7001" / "sub" / "t-tcp-ping-20240105-101600.txt", T_PING)
    put(root / "7001" / "tcp-ping-stderr-20240105-101500.txt", "not\ta row\n")
    put(root / "7001" / "x-tcp-ping-20240105-101500.txt", PING)
    put(root / "7001" / "dwnl-test-20240105-101400.txt", DWNL)
    put(root / "7001" / "t-dwnl-test-20240105-101330.txt", T_DWNL)
    put(root / "7002" / "tcp-ping-20240105-101430.txt", PING)
    put(root / "7003" / "tcp-ping-20240105-101430.txt", PING)    # not in the config
    return tmp_path


def test_config_and_discovery(spark, raw, rows):
    assert rows(read_experiment_configs(spark, str(raw / "config.json"))) == [(900, 7001, 41), (900, 7002, 42)]
    found = files.discover_result_files(spark, str(raw / "campaign"), files.PING_NAME)
    assert rows(found, "sched_id", "run_dtm") == [
        (7001, datetime(2024, 1, 5, 10, 13, 25)), (7001, datetime(2024, 1, 5, 10, 16)),
        (7002, datetime(2024, 1, 5, 10, 14, 30)), (7003, datetime(2024, 1, 5, 10, 14, 30))]


def test_bad_time_in_file_name(spark):
    df = spark.createDataFrame([("/c/7/tcp-ping-20241305-101500.txt",)], "path string")
    assert files.with_run_identity(df, files.PING_NAME, on_bad_time="null").first().run_dtm is None
    with pytest.raises(PySparkException, match="no valid time"):
        files.with_run_identity(df, files.PING_NAME).collect()


def test_campaign_tables(spark, raw, rows):
    tables = campaign_tables(spark, str(raw / "config.json"), str(raw / "campaign"))
    assert tables["tcp_ping"].columns == schemas.TCP_PING.names
    got = rows(tables["tcp_ping"], "sched_id", "run_tool", "iter_nr", "if_name", "oper", "m_ts", "exp_id", "node_id")
    op0 = ("op0", 24001)
    assert got == [
        (7001, "t-tcp-ping", 1, None, None, None, 900, 41),
        (7001, "tcp-ping", 1, *op0, datetime(2024, 1, 5, 10, 13, 20, 250000), 900, 41),
        (7001, "tcp-ping", 2, *op0, datetime(2024, 1, 5, 10, 13, 20, 250000), 900, 41),
        (7002, "tcp-ping", 1, *op0, datetime(2024, 1, 5, 10, 14, 20, 250000), 900, 42),
        (7002, "tcp-ping", 2, *op0, datetime(2024, 1, 5, 10, 14, 20, 250000), 900, 42)]
    down = rows(tables["dwnl_test"], "run_tool", "if_name", "m_ts", "dwnl_size")
    assert down == [("dwnl-test", "op0", datetime(2024, 1, 5, 10, 13, 20, 250000), 1048576),
                    ("t-dwnl-test", "op1", datetime(2024, 1, 5, 10, 13, 30), 2097152)]
    meta = tables["metadata"].where("sched_id = 7001")
    assert rows(meta, "seq_no", "span", "imsi") == [(1, 60.0, None), (2, 0.0, None), (3, 0.0, None)]
    hashed = campaign_tables(spark, str(raw / "config.json"), str(raw / "campaign"), "hash")["metadata"]
    assert len(hashed.where("seq_no = 1").first().imsi) == 64


def test_load_store_and_report(spark, raw, rows):
    target = scratch_dir(spark, "tables")
    load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), target)
    again = load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), target)
    assert again.number == 2 and again.table(spark, "tcp_ping").count() == 5
    experiments = experiment_dimension(spark, [(900, "Day-1", "2024-01-05 10:00", "b")])
    c = Campaign(experiments, *[again.table(spark, n) for n in ("tcp_ping", "dwnl_test", "metadata")], "b")
    got = {r.sched_id: r for r in c.ping_summary.collect()}
    assert got[7001].cnt_good == 1 and got[7001].cnt_poor_t == 1 and got[7002].cnt_fair == 1
    stored = c.with_stored_summaries(spark, scratch_dir(spark, "summaries"))
    r = reports.run("n2", stored).first()
    assert (r.speed_mbs, r.speed_mbs_t, r.speed_gain_pct) == (1.0, 2.0, 100.0)
    c.register_views(spark, "t_")
    assert spark.sql("SELECT count(*) FROM t_v_tcp_ping WHERE device_mode = '?'").first()[0] == 1


def test_other_schedules_are_not_opened(spark, raw, rows):
    put(raw / "campaign" / "7003" / "policyd-20240105-101000.txt", "[local_ip|10.0.0.1] [interface|op0]\n")
    put(raw / "campaign" / "7003" / "policyd-20240105-111000.txt", "[local_ip|10.0.0.1] [interface|op1]\n")
    put(raw / "campaign" / "7003" / "metadata-20240105-101700.txt", '{"InternalInterface":"op0"\n')
    put(raw / "campaign" / "7003" / "tcp-ping-20240105-101700.txt", "not\ta row\n")
    target = scratch_dir(spark, "tables")
    experiments = experiment_dimension(spark, [(900, "Day-1", "2024-01-05 10:00", "b")])
    stored = load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), target, experiments=experiments)
    c = Campaign.from_tables(spark, stored, "b")
    assert c.tcp_ping.count() == 5 and rows(c.experiments, "exp_id", "batch") == [(900, "b")]


def shown(spark, rows, stored):
    """All rows that readers see."""
    return {name: rows(stored.table(spark, name)) for name in ("tcp_ping", "dwnl_test", "metadata", "experiment")}


def loads(target):
    return sorted(p.name for p in Path(target).glob("*/load=*"))


@pytest.mark.parametrize("cut", ["metadata", "tcp_ping", "dwnl_test", "experiment", "publish"])
def test_a_load_cut_anywhere_leaves_the_old_campaign_in_full(spark, raw, rows, monkeypatch, cut):
    target = scratch_dir(spark, "tables")
    experiments = experiment_dimension(spark, [(900, "Day-1", "2024-01-05 10:00", "b")])
    config, root = str(raw / "config.json"), str(raw / "campaign")
    before = load_campaign(spark, config, root, target, experiments=experiments)
    old, folders = shown(spark, rows, before), loads(target)
    put(raw / "campaign" / "7002" / "tcp-ping-20240105-101700.txt", PING)
    write, publish = versions.Load.write, versions.Manifests.publish

    class Cut(Exception):
        pass

    def cut_write(self, name, *more):
        if name == cut:
            raise Cut
        return write(self, name, *more)

    def cut_publish(self, *more):
        if cut == "publish":
            raise Cut
        return publish(self, *more)

    with monkeypatch.context() as patch:
        patch.setattr(versions.Load, "write", cut_write)
        patch.setattr(versions.Manifests, "publish", cut_publish)
        with pytest.raises(Cut):
            load_campaign(spark, config, root, target, experiments=experiments)
    assert shown(spark, rows, TableStore(spark, target).current()) == old and loads(target) == folders
    after = load_campaign(spark, config, root, target, experiments=experiments)
    assert after.table(spark, "tcp_ping").count() == 7
    assert shown(spark, rows, before) == old                 # an open reader keeps what it saw


def test_a_load_replaces_its_experiments_in_every_table(spark, raw, rows):
    target = scratch_dir(spark, "tables")
    config, root = raw / "config.json", str(raw / "campaign")
    load_campaign(spark, str(config), root, target)
    put(config, '{"id": 901, "schedules": {"7003": {"nodeid": 43}}}')
    second = load_campaign(spark, str(config), root, target)
    assert rows(second.table(spark, "tcp_ping").groupBy("exp_id").count()) == [(900, 5), (901, 2)]
    put(config, '{"id": 900, "schedules": {"7002": {"nodeid": 42}}}')
    third = load_campaign(spark, str(config), root, target)
    assert rows(third.table(spark, "tcp_ping").groupBy("exp_id").count()) == [(900, 2), (901, 2)]
    assert third.table(spark, "dwnl_test").count() == 0      # the downloads of 900 were of 7001
    assert rows(second.table(spark, "dwnl_test"), "exp_id") == [(900,), (900,)]


def test_two_loads_at_once_both_count(spark, rows):
    store = TableStore(spark, scratch_dir(spark, "tables"))
    with store.load() as first:
        first.write("t", spark.createDataFrame([(1, "a")], "k int, v string"), ["k"], "k")
        with store.load() as second:
            second.write("t", spark.createDataFrame([(2, "b")], "k int, v string"), ["k"], "k")
    assert (second.published.number, first.published.number) == (1, 2)
    assert rows(store.current().table(spark, "t")) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="other columns"):
        with store.load() as other:
            other.write("t", spark.createDataFrame([(2, 5)], "k int, v int"), ["k"], "k")
    assert rows(store.current().table(spark, "t")) == [(1, "a"), (2, "b")]


def test_a_published_number_is_never_replaced(spark):
    manifests = versions.Manifests(spark, scratch_dir(spark, "manifests"))
    assert manifests.newest() == (0, {})
    assert manifests.publish(1, {"tables": {}}) and not manifests.publish(1, {"tables": {"x": {}}})
    assert manifests.newest() == (1, {"tables": {}})


def test_vacuum_removes_what_no_manifest_names(spark, raw):
    target = scratch_dir(spark, "tables")
    for _ in range(3):
        stored = load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), target)
    store = TableStore(spark, target)
    unfinished = store.load()                                # a driver that died before the end of its load
    unfinished.write("tcp_ping", stored.table(spark, "tcp_ping"), ["sched_id", "run_tool", "run_dtm", "iter_nr"], "exp_id")
    assert store.vacuum(keep=1) == [] and len(loads(target)) == 10
    assert len(store.vacuum(keep=1, older_than_seconds=0)) == 7
    assert store.current().number == 3 and store.current().table(spark, "tcp_ping").count() == 5


def test_listed_schedules_without_folders_have_no_rows(spark, raw):
    put(raw / "config.json", '{"id": 902, "schedules": {"8001": {"nodeid": 1}, "8002": {"nodeid": 2}}}')
    stored = load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), scratch_dir(spark, "tables"))
    assert [stored.table(spark, name).count() for name in ("tcp_ping", "dwnl_test", "metadata")] == [0, 0, 0]
    assert stored.table(spark, "metadata").columns == schemas.METADATA.names


def test_mapping_conflict_fails_the_load(spark, raw):
    put(raw / "campaign" / "7001" / "policyd-20240105-111000.txt", "[local_ip|10.0.0.1] [interface|op1]\n")
    target = scratch_dir(spark, "tables")
    with pytest.raises(PySparkException, match="if_name changed for 7001, 10.0.0.1"):
        load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), target)
    assert TableStore(spark, target).current().tables == {} and loads(target) == []


def test_repeated_key_leaves_stored_tables_alone(spark, raw):
    target = scratch_dir(spark, "tables")
    load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), target)
    put(raw / "campaign" / "7001" / "copy" / "tcp-ping-20240105-101325.txt", PING)
    with pytest.raises(DuplicateKeyError):
        load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), target)
    assert TableStore(spark, target).current().table(spark, "tcp_ping").count() == 5


@pytest.mark.parametrize("name, text", [
    ("tcp-ping-20240105-101700.txt", "tcp-ping\tone\t10.0.0.1\tserver\t1235\tECHO\t0.05\n"),
    ("metadata-20240105-101700.txt", '{"InternalInterface":"op0"\n'),
    ("metadata-20240105-101700.txt", '{"InternalInterface":"op0","DeviceMode":5}\n')])
def test_malformed_input_fails(spark, raw, name, text):
    put(raw / "campaign" / "7001" / name, text)
    tables = campaign_tables(spark, str(raw / "config.json"), str(raw / "campaign"))
    with pytest.raises((PySparkException, Py4JJavaError)):
        tables["tcp_ping"].collect()


def test_run_configs_keep_malformed_files_apart(spark, tmp_path):
    put(tmp_path / "a.conf", '{\n "run_commands": "tcp-ping t-tcp-ping",\n "run_count": 3,\n "run_policy_manager": true\n}')
    put(tmp_path / "b.conf", '{\n "run_commands": "tcp-ping",\n "run_policy_manager": false\n "run_count": 3\n}')
    by = {r.path[-6:]: r for r in configs.read_run_configs(spark, str(tmp_path)).collect()}
    assert by["a.conf"].run_commands == ["tcp-ping", "t-tcp-ping"] and by["a.conf"].run_policy_manager
    assert by["a.conf"]._corrupt_record is None
    assert by["b.conf"].run_count is None and "run_count" in by["b.conf"]._corrupt_record


def test_policies_flatten_scalars_lists_and_ranges(spark, tmp_path, rows):
    put(tmp_path / "a.policy", '{"uid": "s", "policy_type": "policy", "match": {"device_mode": {"value": [3, 4]}, '
        '"rssi": {"value": {"start": -128, "end": 0}}}, "properties": [[{"rssi": {"value": {"start": -69, "end": 0}, '
        '"precedence": 2, "score": 20}}], [{"x": {"value": 1, "precedence": 1}}]]}')
    put(tmp_path / "b.profile", '{"uid": "f", "policy_type": "profile", '
        '"properties": {"interface": {"value": "op0", "precedence": 2}}}')
    got = rows(policies.read_policies(spark, str(tmp_path)), "uid", "role", "group_no", "name", "lo", "hi",
               "text_value", "precedence", "score")
    assert got == [
        ("f", "property", 0, "interface", None, None, "op0", 2, None),
        ("s", "match", 0, "device_mode", 3.0, 3.0, None, None, None),
        ("s", "match", 0, "device_mode", 4.0, 4.0, None, None, None),
        ("s", "match", 0, "rssi", -128.0, 0.0, None, None, None),
        ("s", "property", 0, "rssi", -69.0, 0.0, None, 2, 20.0),
        ("s", "property", 1, "x", 1.0, 1.0, None, 1, None)]


def test_samples_keep_line_order(spark, tmp_path):
    head = "DTM\tCPU\tTOTAL\tAVAIL" + "\tNAME\tCPU\tPSS" * 4 + "\n"
    lines = "".join(f"23:59:{i:02d}\t{i}.0\t100\t50\t(no-app)" + "\t" * 11 + "\n" for i in range(5))
    none = "00:00:00\t9.0\t100\t50\ttcp-ping\tNone\t1048576" + "\t" * 9 + "\n"
    put(tmp_path / "one.txt", head + lines + none)
    df = samples.read_samples(spark, str(tmp_path))
    got = df.orderBy("line_no").collect()
    assert [r.ts for r in got] == [f"23:59:{i:02d}" for i in range(5)] + ["00:00:00"]
    assert (got[0].app_name, got[0].exporter_name) == ("(no-app)", None)
    assert (got[5].app_cpu, got[5].app_pss) == (None, 1048576)


@pytest.mark.parametrize("split_bytes", [64, 400, 1 << 20])
def test_line_numbers_are_the_same_for_every_split_size(spark, tmp_path, split_bytes):
    head = "DTM\tCPU\tTOTAL\tAVAIL" + "\tNAME\tCPU\tPSS" * 4 + "\n"
    for name, n in (("one", 57), ("two", 1), ("none", 0), ("three", 200)):
        put(tmp_path / f"{name}.txt", head + "".join(f"{i}\t{i}.0\t{'9' * (i % 15 + 1)}\t50\t(no-app)" + "\t" * 11 + "\n"
                                                     for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        got = samples.read_samples(spark, str(tmp_path)).select("recording", "line_no", "ts").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(got) == 258 and all(r.line_no == int(r.ts) + 1 for r in got)


def test_report_lines(spark):
    df = spark.createDataFrame([("idle", "cpu", 3, 1.5)], "category string, key string, cnt bigint, avr double")
    assert report_lines(df, df.columns).first()[0] == "idle\tcpu\t3\t1.500000"


def most_tasks(spark, work):
    """Tasks of the largest stage that ``work`` runs."""
    spark.sparkContext.setJobGroup(work.__name__, "counted")
    try:
        work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(work.__name__) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s)


def test_folders_are_listed_by_few_tasks(spark, tmp_path, monkeypatch):
    for n in range(60):
        put(tmp_path / f"{n}" / "metadata-20240101-000000.txt", "{}\n")
        put(tmp_path / f"{n}" / "tcp-ping-20240101-000000.txt", "")
    monkeypatch.setattr(files, "LISTING_TASKS", 3)
    before, folders = spark.conf.get(files.LISTING), [str(tmp_path / f"{n}") for n in range(60)]
    found = []

    def list_lines():
        found.append(files.read_result_lines(spark, folders, "metadata", "metadata-*.txt*"))

    def list_pings():
        probes.read_pings(spark, folders)

    assert most_tasks(spark, list_lines) == 3 and most_tasks(spark, list_pings) == 3
    assert found[0].select("sched_id").distinct().count() == 60 and spark.conf.get(files.LISTING) == before


def test_raw_campaign_is_written_by_many_tasks_under_the_names_of_its_files(spark, tmp_path):
    rows = [(n, datetime(2024, 1, 10 + n % 10), n % 4, ("view", "click", "error")[n % 3], 1.0 * n, '{"k": %d}' % n) for n in range(48)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    root = tmp_path / "raw"

    def write():
        queries.write_raw_campaign(spark, str(tmp_path), str(root))

    write_tasks = most_tasks(spark, write)
    assert write_tasks == 8                                          # spark.sql.shuffle.partitions, not merged by size
    names = {(p.parent.name, p.name[:p.name.index(".txt") + 4]) for p in root.glob("[0-9]*/[!._]*")}
    assert {f for f, _ in names} == {"0", "1", "2", "3"}
    assert {n for _, n in names} == {"metadata-20240101-000000.txt", "policyd-20240101-000000.txt",
        "tcp-ping-20240108-120000.txt", "t-tcp-ping-20240108-120000.txt", "tcp-ping-20240122-120000.txt",
        "t-tcp-ping-20240122-120000.txt"}
    assert probes.read_pings(spark, [str(root / f"{n}") for n in range(4)]).count() == 32
    assert logs.read_metadata_log(spark, [str(root / f"{n}") for n in range(4)]).count() == 16


def test_a_load_takes_more_folders_than_are_listed_at_a_time(spark, raw, rows, monkeypatch):
    for n in range(7010, 7015):
        put(raw / "campaign" / f"{n}" / "sub" / "tcp-ping-20240105-101430.txt", PING + " \t \n\n")
    put(raw / "config.json", '{"id": 900, "schedules": {%s}}' % ", ".join(
        f'"{n}": {{"nodeid": {n % 9}}}' for n in (7001, 7002, 7999, *range(7010, 7015))))
    config, root = str(raw / "config.json"), str(raw / "campaign")
    whole = {name: rows(frame) for name, frame in campaign_tables(spark, config, root).items()}
    # Neither the folders listed at a time nor a limit on schedules cuts a load.
    monkeypatch.setattr(files, "FOLDERS_AT_ONCE", 2, raising=False)
    monkeypatch.setattr(files, "MOST_SCHEDULES", 2, raising=False)
    kept = (spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get(files.LISTING))
    stored = load_campaign(spark, config, root, scratch_dir(spark, "tables"))
    assert [len(whole[name]) for name in whole] == [15, 2, 6]
    assert {name: rows(stored.table(spark, name)) for name in whole} == whole
    assert kept == (spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get(files.LISTING))
    assert not list(Path(scratch_dir(spark, "x")).parent.glob("result-lines-*"))


def test_a_load_reads_each_result_file_once(spark, raw, monkeypatch):
    opened = spark.sparkContext.accumulator(0)
    text_lines = files._text_lines

    def counted(*more):
        def count(batches):
            for batch in batches:
                opened.add(len(set(batch.column("path").to_pylist())))
                yield batch
        lines = text_lines(*more)
        return lines.mapInArrow(count, lines.schema)

    monkeypatch.setattr(files, "_text_lines", counted)
    load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), scratch_dir(spark, "tables"))
    assert opened.value == 10                                # of 11 in the listed folders one is of another tool's name


def test_a_bad_time_in_a_log_name_does_not_fail_a_load(spark, raw):
    (raw / "campaign" / "7002" / "metadata-20240105-101000.txt").rename(
        raw / "campaign" / "7002" / "metadata-20241305-101000.txt")
    stored = load_campaign(spark, str(raw / "config.json"), str(raw / "campaign"), scratch_dir(spark, "tables"))
    assert stored.table(spark, "metadata").count() == 6


def test_small_files_are_read_many_in_a_task(spark, tmp_path):
    for n in range(300):
        put(tmp_path / f"{n}" / "metadata-20240101-000000.txt", "{}\n")
    folders = [str(tmp_path / f"{n}") for n in range(300)]

    def tasks():
        return files.read_result_lines(spark, folders, "metadata", "metadata-*.txt*").rdd.getNumPartitions()

    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        alone = tasks()
        with files.small_files(spark):
            assert tasks() <= spark.sparkContext.defaultParallelism + 1 < alone
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_raw_campaign_has_each_line_once_in_files_of_the_probes_names(spark, tmp_path):
    rows = [(n, datetime(2024, 1, 1 + n % 28), n % 40, ("view", "click", "error")[n % 3], 1.0 * n, '{"k": %d}' % n) for n in range(2000)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
                          ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    root = tmp_path / "raw"
    queries.write_raw_campaign(spark, str(tmp_path), root.as_uri())
    found = [p for p in root.glob("[0-9]*/*")]
    pings = {(str(n % 40), f"{'' if n % 2 else 't-'}tcp-ping-{'20240108' if n % 28 < 15 else '20240122'}-120000.txt")
             for n in range(2000) if n % 3 < 2}
    logs_of = {(str(n), f"{name}-20240101-000000.txt") for n in range(40) for name in ("metadata", "policyd")}
    assert sorted((p.parent.name, p.name) for p in found) == sorted(pings | logs_of)
    lines = [line for p in found if "tcp-ping" in p.name for line in p.read_text().splitlines()]
    assert sorted(int(line.split("\t")[1]) for line in lines) == [n for n in range(2000) if n % 3 < 2]
