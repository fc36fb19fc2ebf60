import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkstats.functions.records import RecordLayout
from linkstats.operators.enrich import with_span
from linkstats.session import scratch_dir
from linkstats.sinks.versions import Manifests
from linkstats.sources import topic
from linkstats.streaming import messages, windows
from linkstats.streaming.keyed import KeyedStore, start_latest
from linkstats.streaming.record_log import RecordLog
from linkstats.streaming.spans import start_spans, waiting_states

ONCE = {"availableNow": True}
T0 = datetime(2024, 1, 1)
LTE = ('META.MODEM {"InterfaceName":"op0","Timestamp":10.5,"SequenceNumber":1,"DeviceMode":5,"RSSI":-70,'
       '"RSRP":-95,"RSRQ":-6,"Frequency":1800,"Band":3,"NWMCCMNC":24001}')
UMTS = 'META.MODEM {"InterfaceName":"op1","Timestamp":11.0,"SequenceNumber":2,"DeviceMode":4,"RSSI":-200}'
BAD = ["METANOSPACE", 'META.MODEM {"DeviceMode":', "OTHER {}"]


@pytest.fixture
def inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def send(inbox, name, *lines):
    (inbox / "in" / name).write_text("".join(line + "\n" for line in lines))


def run_records(spark, inbox, **options):
    messages.start_records(topic.follow_files(spark, str(inbox / "in")), messages.to_folder(str(inbox / "out")),
                           messages.to_folder(str(inbox / "bad")), str(inbox / "cp"), "META", trigger=ONCE,
                           **options).awaitTermination()
    return {r.if_name: json.loads(r.record) for r in spark.read.parquet(str(inbox / "out")).collect()}


def test_messages_become_records_and_bad_ones_are_set_aside(spark, inbox):
    send(inbox, "a.txt", LTE, UMTS, *BAD)
    got = run_records(spark, inbox)
    lte, umts = got["op0"], got["op1"]
    assert (lte["uid"], lte["priority"], lte["link"]) == ("op0_metadata_exporter", 4, True)
    assert lte["match"] == [{"uid": {"value": "op0"}}]
    assert lte["properties"]["lte_rsrp"] == {"value": -95, "precedence": 2}
    assert lte["properties"]["is_wired"] == {"value": False, "precedence": 2}
    assert lte["properties"]["cid"]["value"] == 0            # a missing number is 0
    assert "rssi" not in lte["properties"] and "lte_rssi" not in umts["properties"]
    assert umts["properties"]["rssi"]["value"] == 56         # -200 in 8 bits keeps its low bits
    assert "dlb_conn" not in lte["properties"]
    bad = {r.value: r.rejected for r in spark.read.parquet(str(inbox / "bad")).collect()}
    assert bad == {BAD[0]: "no space", BAD[1]: "bad json"}


def test_wrapped_narrowing_and_layout(spark, inbox):
    send(inbox, "a.txt", UMTS)
    got = run_records(spark, inbox, narrowing="wrap", layout=RecordLayout("_x", "d", 1, 9))["op1"]
    assert got["properties"]["rssi"] == {"value": 56, "precedence": 9}
    assert (got["uid"], got["description"], got["priority"]) == ("op1_x", "d", 1)


def test_quality_lookup_is_refreshed_between_batches(spark, inbox):
    lookup = [("op0", 1, 2)]

    def load():
        return spark.createDataFrame(lookup, "name string, conn int, quality int")

    send(inbox, "a.txt", LTE, UMTS)
    got = run_records(spark, inbox, load_quality=load)
    assert got["op0"]["properties"]["dlb_quality"]["value"] == 2
    assert "dlb_quality" not in got["op1"]["properties"]
    lookup[:] = [("op1", 7, 0)]
    send(inbox, "b.txt", UMTS.replace('"SequenceNumber":2', '"SequenceNumber":3'))
    run_records(spark, inbox, load_quality=load)
    back = spark.read.parquet(str(inbox / "out")).where("seq_no = 3").first()
    assert json.loads(back.record)["properties"]["dlb_conn"]["value"] == 7


def test_messages_sent_twice_and_a_lost_checkpoint_leave_one_record_each(spark, inbox, rows):
    log = RecordLog(str(inbox / "log"), fan_in=2)
    bad = RecordLog(str(inbox / "rejected"), ("value",))

    def run(checkpoint):
        messages.start_records(topic.follow_files(spark, str(inbox / "in")), log, bad, str(inbox / checkpoint), "META",
                               trigger=ONCE, repeats_within="1 hour").awaitTermination()

    send(inbox, "a.txt", LTE, UMTS, LTE, BAD[0], BAD[0])
    run("cp")
    names = [n for level in log._manifests(spark).newest()[1]["levels"].values() for n in level]
    assert spark.read.parquet(*[f"{log.path}/data/{n}" for n in names]).count() == 2      # the repeat was not stored
    send(inbox, "b.txt", UMTS, UMTS.replace('"SequenceNumber":2', '"SequenceNumber":3'))
    run("cp")
    run("lost")
    assert rows(log.read(spark), "if_name", "seq_no") == [("op0", 1), ("op1", 2), ("op1", 3)]
    assert rows(bad.read(spark), "value") == [(BAD[0],)]


def test_the_log_merges_folders_and_takes_a_batch_once(spark, rows):
    log = RecordLog(scratch_dir(spark, "log"), ("k",), fan_in=3)
    for n in range(11):
        batch = spark.createDataFrame([(n, f"first {n}"), (0, f"again {n}")], "k int, v string")
        log.deliver(batch, n, "q")
        log.deliver(batch.withColumn("k", F.lit(99)), n, "q")
    levels = log._manifests(spark).newest()[1]["levels"]
    assert {level: len(names) for level, names in levels.items() if names} == {"0": 2, "2": 1}
    expected = [(0, "again 0"), *[(n, f"first {n}") for n in range(1, 11)]]
    assert rows(log.read(spark)) == sorted(expected, key=repr)
    log.vacuum(spark, keep=1)
    assert len(list(Path(log.path).glob("data/*"))) == 3 and rows(log.read(spark)) == sorted(expected, key=repr)


def test_no_consumer_drops_records_only(spark, inbox):
    send(inbox, "a.txt", LTE, BAD[0])
    messages.start_records(topic.follow_files(spark, str(inbox / "in")), None, messages.to_folder(str(inbox / "bad")),
                           str(inbox / "cp"), "META", trigger=ONCE).awaitTermination()
    assert not (inbox / "out").exists() and spark.read.parquet(str(inbox / "bad")).count() == 1


STATE = "sched_id int, iif_name string, ts timestamp, seq_no int"
KEYS = ("sched_id", "iif_name")


def state(key, second, seq):
    return (1, key, T0 + timedelta(seconds=second), seq)


BATCHES = [[state("a", 0, 1), state("a", 5, 2), state("b", 1, 3)], [state("a", 9, 4)],
           [state("b", 100, 5), state("a", 9, 6)], [state("c", 7, 7)]]


def feed(spark, folder, start, batches=BATCHES):
    for batch in batches:
        frame = spark.createDataFrame(batch, STATE)
        frame.write.mode("append").parquet(f"{folder}/in")
        start(spark.readStream.schema(frame.schema).parquet(f"{folder}/in")).awaitTermination()
    return spark.createDataFrame([r for b in batches for r in b], STATE)


def keyed_store(spark, **options):
    schema = spark.createDataFrame([], STATE).schema
    return KeyedStore(scratch_dir(spark, "latest"), schema, KEYS, ("ts", "seq_no"), **options)


def test_latest_state_survives_batches_and_a_fresh_checkpoint(spark, rows):
    store = keyed_store(spark)
    folder = scratch_dir(spark, "latest-in")
    feed(spark, folder, lambda s: start_latest(s, store, f"{folder}/cp", ONCE))
    assert rows(store.latest(spark), "iif_name", "seq_no") == [("a", 6), ("b", 5), ("c", 7)]
    other = scratch_dir(spark, "latest-in")                  # another query, from batch 0 on
    feed(spark, other, lambda s: start_latest(s, store, f"{other}/cp", ONCE), [[state("c", 8, 8), state("a", 1, 9)]])
    assert rows(store.latest(spark), "iif_name", "seq_no") == [("a", 6), ("b", 5), ("c", 8)]


def test_a_batch_writes_only_the_buckets_it_touches_and_once(spark, rows):
    store = keyed_store(spark, buckets=16)
    store.merge(spark.createDataFrame([state(f"k{i}", i, i) for i in range(200)], STATE), 0, "q")
    before = {p.parent for p in Path(store.path).glob("data/*/bucket=*/*.parquet")}
    assert len(before) == 16
    store.merge(spark.createDataFrame([state("k7", 1000, 1)], STATE), 1, "q")
    new = {p.parent for p in Path(store.path).glob("data/*/bucket=*/*.parquet")} - before
    assert len(new) == 1
    store.merge(spark.createDataFrame([state("k7", 9000, 2)], STATE), 1, "q")   # batch 1 again: it has been taken in
    assert rows(store.latest(spark).where("iif_name = 'k7'"), "seq_no") == [(1,)]
    assert store.latest(spark).count() == 200


def test_readers_see_a_whole_version_while_the_next_is_written(spark, rows, monkeypatch):
    store = keyed_store(spark, most_deltas=2)
    for n in range(3):
        store.merge(spark.createDataFrame([state("a", n, n), state("b", n, n)], STATE), n, "q")
    reader = store.latest(spark)                             # opened now, read later
    with monkeypatch.context() as patch:                     # a batch that dies before it publishes
        patch.setattr(Manifests, "publish", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.merge(spark.createDataFrame([state("a", 50, 50)], STATE), 3, "q")
    assert rows(store.latest(spark), "iif_name", "seq_no") == [("a", 2), ("b", 2)]
    for n in range(3, 8):
        store.merge(spark.createDataFrame([state("a", n, n)], STATE), n, "q")
    assert rows(reader, "iif_name", "seq_no") == [("a", 2), ("b", 2)]
    assert rows(store.latest(spark), "iif_name", "seq_no") == [("a", 7), ("b", 2)]


def test_compaction_and_vacuum_bound_the_folders(spark, rows):
    store = keyed_store(spark, buckets=2, most_deltas=3)
    for n in range(9):
        store.merge(spark.createDataFrame([state(f"k{i}", n, n) for i in range(8)], STATE), n, "q")
        _, content = store._manifests(spark).newest()
        assert all(len(deltas) <= 3 for deltas in content["folders"].values())
    store.vacuum(spark, keep=1)
    assert len(list(Path(store.path).glob("data/delta=*"))) <= 3
    assert rows(store.latest(spark), "seq_no") == [(8,)] * 8


def start_to(folder, delay="10 seconds"):
    return lambda s: start_spans(s, f"{folder}/out", KEYS, "ts", f"{folder}/cp", delay, ["seq_no"], ONCE)


def test_streamed_spans_of_states_out_of_order(spark, rows):
    folder = scratch_dir(spark, "spans")
    shuffled = [[state("a", 8, 1), state("b", 1, 2), state("a", 0, 3)], [state("a", 3, 4), state("a", 8, 5), state("a", 16, 6)],
                [state("b", 9, 7), state("a", 7, 8), state("a", 60, 9)], [state("c", 55, 10), state("a", 1, 11), state("b", 3, 12)],
                [state("a", 100, 13)]]
    everything = feed(spark, folder, start_to(folder), shuffled)
    out = spark.read.parquet(f"{folder}/out")
    late = rows(out.where("late = 1"), "seq_no", "span")
    assert late == [(11, None), (12, None)]                  # 50 seconds were certain when they came
    whole = {r.seq_no: r.span for r in with_span(everything.where("seq_no NOT IN (11, 12)")).collect()}
    closed = rows(out.where("late = 0"), "seq_no", "span")
    assert [n for n, _ in closed] == [1, 2, 3, 4, 5, 6, 8]   # 60 is open, followers of the others are not behind 90 yet
    assert closed == [(n, whole[n]) for n, _ in closed]
    waiting = waiting_states(everything, f"{folder}/cp", "ts")
    assert rows(waiting, "iif_name", "seq_no") == [("a", 13), ("a", 9), ("b", 7), ("c", 10)]


def test_timers_close_states_of_a_quiet_key(spark, rows):
    folder = scratch_dir(spark, "spans")
    feed(spark, folder, start_to(folder), [[state("a", 0, 1), state("a", 5, 2)], [state("b", 100, 3)]])
    assert rows(spark.read.parquet(f"{folder}/out"), "seq_no", "span") == [(1, 5.0)]


def test_a_key_with_late_states_only(spark, rows):
    """Nothing of such a key waits; more of it may come later, late again or in time."""
    folder = scratch_dir(spark, "spans")
    everything = feed(spark, folder, start_to(folder), [
        [state("a", 0, 1), state("a", 100, 2)], [state("b", 3, 3), state("b", 1, 4), state("a", 120, 5)],
        [state("b", 5, 6), state("b", 115, 7), state("a", 130, 8)], [state("b", 118, 9), state("b", 125, 10), state("a", 160, 11)]])
    out = spark.read.parquet(f"{folder}/out")
    assert rows(out.where("late = 1"), "seq_no", "span") == [(3, None), (4, None), (6, None), (9, None)]
    assert rows(out.where("late = 0"), "seq_no", "span") == [(1, 100.0), (2, 20.0), (5, 10.0), (7, 10.0)]
    assert rows(waiting_states(everything, f"{folder}/cp", "ts"), "seq_no") == [(10,), (11,), (8,)]


SAMPLES = "ts timestamp, k string, v double"


def test_late_samples_correct_windows_that_were_written(spark, rows):
    folder = scratch_dir(spark, "windows")
    batches = [[(0, "x", 0.0), (30, "x", 30.0), (60, "x", 60.0), (10, None, None)], [(200, "x", 200.0)],
               [(31, "x", 90.0), (125, "x", 5.0), (20, "y", 7.0), (210, "x", None)]]
    for batch in batches:
        frame = spark.createDataFrame([(T0 + timedelta(seconds=s), k, v) for s, k, v in batch], SAMPLES)
        frame.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/in")
        windows.start_window_parts(windows.window_parts(stream, ["k"], ["v"]), f"{folder}/out", f"{folder}/cp",
                                   ONCE).awaitTermination()
    parts = spark.read.parquet(f"{folder}/out")
    minute = F.minute("window_start")
    assert rows(parts.where("late = 0"), minute, "k", "v_cnt", "v_sum") == [(0, "x", 2, 30.0), (0, None, 0, 0.0), (1, "x", 1, 60.0)]
    assert rows(parts.where("late = 1"), minute, "k", "v_cnt", "v_sum") == [(0, "x", 1, 90.0), (0, "y", 1, 7.0)]
    whole = windows.corrected_windows(parts, ["k"], ["v"], windows.open_windows(spark, f"{folder}/cp", ["k"], ["v"]))
    assert rows(whole, minute, "k", "origin") == [
        (0, "x", "corrected"), (0, "y", "corrected"), (0, None, "written"), (1, "x", "written"), (2, "x", "open"), (3, "x", "open")]
    batch = windows.window_means(spark.read.schema(SAMPLES).parquet(f"{folder}/in"), ["k"], ["v"])
    assert rows(whole.drop("origin")) == rows(batch)
