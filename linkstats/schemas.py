"""Fixed schemas of inputs and tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(kind: T.DataType, names: str) -> list[T.StructField]:
    return [T.StructField(name, kind) for name in names.split()]


_INT, _LONG, _DOUBLE, _STR, _TS = (
    T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType(), T.TimestampType())

# --- raw inputs --------------------------------------------------------------

EXPERIMENT_CONFIG = T.StructType([
    T.StructField("id", _INT),
    T.StructField("schedules", T.MapType(_STR, T.StructType(_fields(_INT, "nodeid")))),
])

PING_TSV = T.StructType(
    _fields(_STR, "run_tool") + _fields(_INT, "iter_nr")
    + _fields(_STR, "local_ip remote_host") + _fields(_INT, "remote_port")
    + _fields(_STR, "ping_type") + _fields(_DOUBLE, "rtt"))

DOWNLOAD_TSV = T.StructType(
    _fields(_STR, "run_tool") + _fields(_INT, "iter_nr")
    + _fields(_STR, "local_ip remote_host") + _fields(_INT, "remote_port")
    + _fields(_STR, "dwnl_path") + _fields(_INT, "dwnl_size")
    + _fields(_DOUBLE, "init_time total_time"))

SAMPLE_SLOTS = ("app", "exporter", "policyd", "proxy")

SAMPLE_TSV = T.StructType(
    _fields(_STR, "ts") + _fields(_DOUBLE, "cpu") + _fields(_LONG, "total avail")
    + [f for slot in SAMPLE_SLOTS
       for f in (_fields(_STR, f"{slot}_name") + _fields(_DOUBLE, f"{slot}_cpu")
                 + _fields(_LONG, f"{slot}_pss"))])

# JSON keys of one modem message, with the column each one fills.
METADATA_KEYS = (
    ("SequenceNumber", "seq_no", _INT),
    ("Timestamp", "ts_epoch", _DOUBLE),
    ("DataVersion", "data_ver", _INT),
    ("DataId", "data_id", _STR),
    ("InternalInterface", "iif_name", _STR),
    ("ICCID", "iccid", _STR),
    ("IMSI", "imsi", _STR),
    ("IMEI", "imei", _STR),
    ("Operator", "op_name", _STR),
    ("IPAddress", "ip_addr", _STR),
    ("InterfaceName", "if_name", _STR),
    ("IMSIMCCMNC", "imsimccmnc", _INT),
    ("NWMCCMNC", "nwmccmnc", _INT),
    ("LAC", "lac", _INT),
    ("CID", "cid", _INT),
    ("RSSI", "rssi", _INT),
    ("RSCP", "rscp", _INT),
    ("ECIO", "ecio", _INT),
    ("RSRP", "lte_rsrp", _INT),
    ("RSRQ", "lte_rsrq", _INT),
    ("Frequency", "lte_freq", _INT),
    ("Band", "lte_band", _INT),
    ("DeviceMode", "dev_mode", _INT),
    ("DeviceSubmode", "dev_submode", _INT),
    ("DeviceState", "dev_state", _INT),
    ("PCI", "pci", _INT),
)

METADATA_JSON = T.StructType([T.StructField(key, kind) for key, _, kind in METADATA_KEYS])

RUN_CONFIG = T.StructType(
    _fields(_STR, "run_commands")
    + _fields(_INT, "run_count run_interval run_timeout run_initial_wait run_pre_test_wait")
    + _fields(T.BooleanType(), "run_policy_manager")
    + _fields(_STR, "ping_server") + _fields(_INT, "ping_port")
    + _fields(_STR, "ping_mode") + _fields(_INT, "ping_count ping_interval ping_timeout")
    + _fields(_STR, "ping_bind_ifname") + _fields(_INT, "ping_verbose")
    + _fields(_STR, "dwnl_test_server") + _fields(_INT, "dwnl_test_port")
    + _fields(_STR, "dwnl_test_path")
    + _fields(_INT, "dwnl_test_count dwnl_test_interval dwnl_test_timeout")
    + _fields(_STR, "dwnl_test_bind_ifname") + _fields(_INT, "dwnl_test_verbose"))

# --- tables ------------------------------------------------------------------

_IDS = _fields(_INT, "exp_id sched_id node_id")
_PROBE = (_fields(_STR, "run_tool") + _fields(_TS, "run_dtm") + _fields(_INT, "iter_nr")
          + _fields(_STR, "local_ip if_name") + _fields(_INT, "oper")
          + _fields(_STR, "remote_host") + _fields(_INT, "remote_port"))

TCP_PING = T.StructType(
    _IDS + _PROBE + _fields(_STR, "ping_type") + _fields(_DOUBLE, "rtt") + _fields(_TS, "m_ts"))

DWNL_TEST = T.StructType(
    _IDS + _PROBE + _fields(_STR, "dwnl_path") + _fields(_INT, "dwnl_size")
    + _fields(_DOUBLE, "init_time total_time") + _fields(_TS, "m_ts"))

METADATA = T.StructType(
    _IDS + _fields(_INT, "seq_no") + _fields(_TS, "ts") + _fields(_DOUBLE, "span")
    + _fields(_INT, "data_ver")
    + _fields(_STR, "data_id iif_name iccid imsi imei op_name ip_addr if_name")
    + _fields(_INT, "imsimccmnc nwmccmnc lac cid rssi ecio lte_rsrp lte_rsrq lte_freq lte_band "
                    "dev_mode dev_submode dev_state pci"))

EXPERIMENT = T.StructType(
    _fields(_INT, "exp_id") + _fields(_STR, "exp_name") + _fields(_TS, "exp_dtm")
    + _fields(_STR, "batch"))

PROBE_KEY = ("sched_id", "run_tool", "run_dtm", "iter_nr")
METADATA_KEY = ("sched_id", "ts")
EXPERIMENT_KEY = ("exp_id",)
SUMMARY_KEY = ("sched_id",)
# Columns of METADATA that identify a person or a device.
PERSONAL_COLUMNS = ("imsi", "imei", "iccid")
