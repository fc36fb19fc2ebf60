"""Modem messages: defaults, narrowing to declared widths, outgoing records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkstats.functions.measures import LTE_CODE, ColumnOrName, _col


def narrow(value: ColumnOrName, bits: int, signed: bool = True, mode: str = "wrap") -> Column:
    """Fit an integer into a C width.

    ``wrap`` keeps the low bits as C does; ``null`` drops what does not fit and
    ``fail`` raises.
    """
    value = _col(value).cast("bigint")
    span = 1 << bits
    low = -(span >> 1) if signed else 0
    high = low + span - 1
    if mode == "wrap":
        return (value - F.lit(low)).bitwiseAND(F.lit(span - 1)) + F.lit(low)
    fits = value.between(low, high)
    if mode == "null":
        return F.when(fits, value)
    if mode == "fail":
        problem = F.concat(value.cast("string"), F.lit(f" does not fit into [{low}, {high}]"))
        return F.when(value.isNull() | fits, value).otherwise(F.raise_error(problem).cast("bigint"))
    raise ValueError(f"unknown narrowing mode: {mode}")


# Declared widths of a bridged message, (bits, signed).
STREAM_WIDTHS = {
    "dev_mode": (8, False),
    "dev_submode": (8, False),
    "rssi": (8, True),
    "rscp": (16, True),
    "ecio": (8, True),
    "lte_rsrp": (16, True),
    "lte_rsrq": (8, True),
    "lte_freq": (16, False),
    "lte_band": (8, False),
    "lac": (16, False),
    "cid": (32, True),
    "nwmccmnc": (32, False),
    "imsimccmnc": (32, False),
    "dev_state": (8, False),
}


@dataclass(frozen=True)
class RecordLayout:
    """Fixed values of the outgoing record."""

    uid_suffix: str = "_metadata_exporter"
    description: str = "Interface's metadata"
    priority: int = 4
    precedence: int = 2


def _leaf(value: Column, layout: RecordLayout) -> Column:
    return F.struct(value.alias("value"), F.lit(layout.precedence).alias("precedence"))


# Properties of the two radio families: (property, column).
LTE_PROPERTIES = (("lte_rssi", "rssi"), ("lte_rsrp", "lte_rsrp"), ("lte_rsrq", "lte_rsrq"),
                  ("lte_freq", "lte_freq"), ("lte_band", "lte_band"))
OTHER_PROPERTIES = (("rssi", "rssi"), ("rscp", "rscp"), ("ecio", "ecio"))


def interface_record(interface: ColumnOrName = "if_name", conn: ColumnOrName | None = None,
                     quality: ColumnOrName | None = None,
                     layout: RecordLayout = RecordLayout()) -> Column:
    """Nested record of one interface state, ready for ``to_json``.

    Radio properties depend on the mode. Properties that do not apply, and link
    quality after a lookup miss, are NULL structs, which ``to_json`` leaves out.
    """
    interface = _col(interface)
    lte = F.col("dev_mode") == LTE_CODE
    properties = [_leaf(F.lit(False), layout).alias("is_wired"),
                  _leaf(F.col("dev_mode"), layout).alias("device_mode"),
                  _leaf(F.col("dev_submode"), layout).alias("device_submode")]
    for name, column in LTE_PROPERTIES:
        properties.append(F.when(lte, _leaf(F.col(column), layout)).alias(name))
    for name, column in OTHER_PROPERTIES:
        properties.append(F.when(~F.coalesce(lte, F.lit(False)),
                                 _leaf(F.col(column), layout)).alias(name))
    for name, column in (("lac", "lac"), ("cid", "cid"), ("oper", "nwmccmnc"),
                         ("device_state", "dev_state")):
        properties.append(_leaf(F.col(column), layout).alias(name))
    if conn is not None:
        found = _col(conn).isNotNull()
        properties.append(F.when(found, _leaf(_col(conn), layout)).alias("dlb_conn"))
        properties.append(F.when(found, _leaf(_col(quality), layout)).alias("dlb_quality"))
    match = F.array(F.struct(F.struct(interface.alias("value")).alias("uid")))
    return F.struct(
        F.concat(interface, F.lit(layout.uid_suffix)).alias("uid"),
        F.lit(layout.description).alias("description"),
        F.lit(layout.priority).alias("priority"),
        F.lit(True).alias("link"),
        match.alias("match"),
        F.struct(*properties).alias("properties"))
