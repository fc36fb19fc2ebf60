"""Labels, classes, units, ratios and gains used by the reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Modem mode codes and their labels.
DEVICE_MODES = {
    0: "UNKNOWN",
    1: "DISCONNECTED",
    2: "NO SERVICE",
    3: "2G",
    4: "3G",
    5: "LTE",
}
UNLISTED_MODE = "?"
LTE_CODE = 5
RSSI_CODES = (4, 3)


@dataclass(frozen=True)
class SignalThresholds:
    """The lowest readings that still count as good or fair."""

    good_rsrq: int = -7
    good_rsrp: int = -102
    good_rssi: int = -69
    fair_rsrq: int = -11
    fair_rsrp: int = -111
    fair_rssi: int = -94


@dataclass(frozen=True)
class Arms:
    """How the two arms are told apart, and how their columns are named."""

    treatment_prefix: str = "t-"
    treatment_suffix: str = "_t"

    def is_treatment(self, tool: ColumnOrName = "run_tool") -> Column:
        # A NULL tool gives NULL here and in is_baseline, so it joins neither arm.
        return _col(tool).startswith(self.treatment_prefix)

    def is_baseline(self, tool: ColumnOrName = "run_tool") -> Column:
        return ~self.is_treatment(tool)

    def named(self, column: str) -> str:
        return column + self.treatment_suffix


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def collated(df: DataFrame, columns: Sequence[str], collation: str = "UTF8_LCASE") -> DataFrame:
    """Compare, match and group the given text columns under a collation.

    Comparison is binary unless a frame is passed through here.
    """
    return df.withColumns({name: F.collate(F.col(name), collation) for name in columns})


# --- labels and classes --------------------------------------------------------

def device_mode(code: ColumnOrName) -> Column:
    """Label of a mode code; anything unlisted, NULL included, is ``?``."""
    code = _col(code)
    label = None
    for value, name in DEVICE_MODES.items():
        label = F.when(code == value, name) if label is None else label.when(code == value, name)
    return label.otherwise(UNLISTED_MODE)


def signal_quality(mode: ColumnOrName = "dev_mode", rssi: ColumnOrName = "rssi",
                   rsrq: ColumnOrName = "lte_rsrq", rsrp: ColumnOrName = "lte_rsrp",
                   limits: SignalThresholds = SignalThresholds()) -> Column:
    """GOOD, FAIR or POOR. A missing state or reading is POOR."""
    mode, rssi, rsrq, rsrp = map(_col, (mode, rssi, rsrq, rsrp))

    def reaches(min_rsrq: int, min_rsrp: int, min_rssi: int) -> Column:
        lte = (mode == LTE_CODE) & (rsrq >= min_rsrq) & (rsrp >= min_rsrp)
        return lte | (mode.isin(*RSSI_CODES) & (rssi >= min_rssi))

    return (F.when(reaches(limits.good_rsrq, limits.good_rsrp, limits.good_rssi), "GOOD")
            .when(reaches(limits.fair_rsrq, limits.fair_rsrp, limits.fair_rssi), "FAIR")
            .otherwise("POOR"))


def register_sql_functions(spark: SparkSession) -> None:
    """``device_mode(int)`` and ``signal_quality(mode, rssi, rsrq, rsrp)`` for SQL text.

    Both are SQL functions, so Catalyst inlines them; no Python runs per row.
    """
    cases = " ".join(f"WHEN {code} THEN '{name}'" for code, name in DEVICE_MODES.items())
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION device_mode(code INT) RETURNS STRING "
              f"RETURN CASE code {cases} ELSE '{UNLISTED_MODE}' END")
    t = SignalThresholds()
    rssi_codes = ", ".join(map(str, RSSI_CODES))

    def reaches(rsrq: int, rsrp: int, rssi: int) -> str:
        return (f"(mode = {LTE_CODE} AND rsrq >= {rsrq} AND rsrp >= {rsrp}) "
                f"OR (mode IN ({rssi_codes}) AND rssi >= {rssi})")

    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION signal_quality(mode INT, rssi INT, rsrq INT, "
        f"rsrp INT) RETURNS STRING RETURN CASE "
        f"WHEN {reaches(t.good_rsrq, t.good_rsrp, t.good_rssi)} THEN 'GOOD' "
        f"WHEN {reaches(t.fair_rsrq, t.fair_rsrp, t.fair_rssi)} THEN 'FAIR' ELSE 'POOR' END")


def experiment_label(name: ColumnOrName = "exp_name", dtm: ColumnOrName = "exp_dtm") -> Column:
    """``name (yyyy-MM-dd HH:mm:ss)``."""
    return F.concat(_col(name), F.lit(" ("), F.date_format(_col(dtm), "yyyy-MM-dd HH:mm:ss"),
                    F.lit(")"))


# Transport codes of a flow record.
PROTOCOLS = {1: "TCP", 2: "SCTP", 3: "SCTP/UDP"}


def protocol_name(code: ColumnOrName, names: dict[int, str] | None = None) -> Column:
    """Name of a transport code, ``OTHER`` for anything unlisted."""
    code = _col(code)
    label = None
    for value, name in (names or PROTOCOLS).items():
        label = F.when(code == value, name) if label is None else label.when(code == value, name)
    return label.otherwise("OTHER")


# --- arithmetic ------------------------------------------------------------------

def choose(condition: Column, then: Column | float | str, other: Column | float | str | None = None) -> Column:
    """``then`` where the condition is true, else ``other`` (also when it is NULL)."""
    return F.when(condition, then).otherwise(other)


def to_ms(seconds: ColumnOrName) -> Column:
    return _col(seconds) * F.lit(1000.0)


def to_mib(size: ColumnOrName) -> Column:
    return _col(size) / F.lit(1048576.0)


def to_percent(fraction: ColumnOrName) -> Column:
    return _col(fraction) * F.lit(100.0)


# Times have nine decimals at most. Sums of decimals do not depend on the order of addition,
# so neither do means, nor what they are rounded to.
TIME = "decimal(28,9)"


def exact_mean(value: ColumnOrName) -> Column:
    """Mean of times over an exact sum; NULL without any value."""
    value = _col(value)
    return F.try_divide(F.sum(value.cast(TIME)).cast("double"), F.count(value).cast("double"))


def round_to(value: ColumnOrName, digits: int) -> Column:
    """Round half away from zero to ``digits`` decimals."""
    return F.round(_col(value), digits)


def ratio(top: ColumnOrName, bottom: ColumnOrName) -> Column:
    """``top / bottom`` as double; NULL when the bottom is 0 or NULL."""
    return F.try_divide(_col(top).cast("double"), _col(bottom).cast("double"))


def stored_gain(treatment: ColumnOrName, baseline: ColumnOrName) -> Column:
    """Relative gain as a fraction: 0 means equal."""
    return ratio(treatment, baseline) - 1.0


def reported_gain(treatment: ColumnOrName, baseline: ColumnOrName) -> Column:
    """Relative gain in percent."""
    return to_percent(ratio(treatment, baseline)) - 100.0


def non_default_share(cnt: ColumnOrName = "cnt", cnt_op0: ColumnOrName = "cnt_op0",
                      cnt_t: ColumnOrName = "cnt_t", cnt_op0_t: ColumnOrName = "cnt_op0_t",
                      cnt_op1_t: ColumnOrName = "cnt_op1_t") -> Column:
    """Share of treatment runs away from the default interface.

    op0 is the default when every baseline run used it; otherwise op1 is taken as
    the default. Runs on further interfaces are not counted on either side.
    """
    moved = F.when(_col(cnt_op0) == _col(cnt), _col(cnt_op1_t)).otherwise(_col(cnt_op0_t))
    return ratio(moved, cnt_t)


# --- text forms --------------------------------------------------------------------

def fixed_point(value: ColumnOrName, digits: int) -> Column:
    """Fixed-point text as C's ``%.nf`` prints it (ties judged on the binary value)."""
    return F.replace(F.format_number(_col(value), digits), F.lit(","), F.lit(""))


# Units of a human-readable size, one step per factor of 1000.
SIZE_UNITS = ("B", "kB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def human_size(amount: ColumnOrName) -> Column:
    """Amount with a unit; step i shows i decimals. NULL above the last unit.

    A step is taken only while the rest is strictly above 1000.
    """
    amount = _col(amount).cast("double")
    text = None
    for step, unit in enumerate(SIZE_UNITS):
        scaled = amount
        for _ in range(step):
            scaled = scaled / 1000.0
        shown = F.concat(fixed_point(scaled, step), F.lit(" " + unit))
        fits = scaled <= 1000.0
        text = F.when(fits, shown) if text is None else text.when(fits, shown)
    return text
