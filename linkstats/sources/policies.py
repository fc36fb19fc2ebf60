"""Policy rules: match conditions and scored properties, flattened to ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LEAF = "struct<value: string, precedence: int, score: double>"
_RULE = ("struct<uid: string, priority: int, description: string, policy_type: string, "
         "replace_matched: boolean, match: string, properties: string>")
_RANGE = "struct<start: double, end: double>"


def _alternatives(raw: Column) -> Column:
    """A value as array of (lo, hi, text): list elements, one range or one scalar."""
    bounds = F.from_json(raw, _RANGE)
    of_range = F.array(F.struct(bounds["start"].alias("lo"), bounds["end"].alias("hi"),
                                F.lit(None).cast("string").alias("text_value")))

    def scalar(item: Column) -> Column:
        number = item.try_cast("double")
        return F.struct(number.alias("lo"), number.alias("hi"),
                        F.when(number.isNull(), item).alias("text_value"))

    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.array(raw))
    return F.when(raw.startswith("{"), of_range).otherwise(F.transform(items, scalar))


def _entries(raw: Column) -> Column:
    """Map text as array of (name, leaf)."""
    return F.transform(F.map_entries(F.from_json(raw, f"map<string, {_LEAF}>")),
                       lambda e: F.struct(e["key"].alias("name"), e["value"].alias("leaf")))


def _grouped_properties(raw: Column) -> Column:
    """Properties as array of (group_no, entries): an object is group 0, a list one group each."""
    one = F.array(F.struct(F.lit(0).alias("group_no"), _entries(raw).alias("entries")))
    lists = F.from_json(raw, f"array<array<map<string, {_LEAF}>>>")

    def group(maps: Column, number: Column) -> Column:
        entries = F.flatten(F.transform(maps, lambda m: F.transform(
            F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("leaf")))))
        return F.struct(number.cast("int").alias("group_no"), entries.alias("entries"))

    return F.when(raw.startswith("["), F.transform(lists, group)).otherwise(one)


def parse_policies(documents: DataFrame, value: str = "value") -> DataFrame:
    """Rows (uid, policy_type, role, group_no, name, lo, hi, text_value, precedence, score,
    priority, replace_matched).

    ``role`` is ``match`` or ``property``. A scalar is a range of one value; a
    list becomes one row per element; text stays in ``text_value``.
    """
    rule = F.from_json(value, _RULE, {"mode": "FAILFAST"})
    rules = documents.select(rule.alias("r"))
    ids = [F.col("r.uid").alias("uid"), F.col("r.policy_type").alias("policy_type"),
           F.col("r.priority").alias("priority"), F.col("r.replace_matched").alias("replace_matched")]
    matches = rules.where("r.match IS NOT NULL").select(
        *ids, F.lit("match").alias("role"), F.lit(0).alias("group_no"),
        F.explode(_entries(F.col("r.match"))).alias("e"))
    properties = (rules.where("r.properties IS NOT NULL")
                  .select(*ids, F.lit("property").alias("role"),
                          F.explode(_grouped_properties(F.col("r.properties"))).alias("g"))
                  .select("uid", "policy_type", "priority", "replace_matched", "role", "g.group_no",
                          F.explode("g.entries").alias("e")))
    flat = matches.unionByName(properties)
    return (flat.withColumn("v", F.explode(_alternatives(F.col("e.leaf.value"))))
            .select("uid", "policy_type", "role", "group_no", F.col("e.name").alias("name"),
                    "v.lo", "v.hi", "v.text_value",
                    F.col("e.leaf.precedence").alias("precedence"),
                    F.col("e.leaf.score").alias("score"), "priority", "replace_matched"))


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    return parse_policies(spark.read.text(path, wholetext=True))
