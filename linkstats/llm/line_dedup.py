"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at both ends, A-Z in lower case. Keys of at least
``min_chars`` code points that are found in at least ``min_docs`` documents lose all their lines except
those of the document with the largest id. Everything runs in DataFrame functions.

The index is a set of runs in the shared scratch folder. A run has one row per 128-bit line hash,
sorted by it: the number of documents and the largest document id. Batches come in descending order of
document id. A new batch is merge-anti-joined against the runs: lines that are settled there (enough
documents already, so that no smaller id can change their fate) are left out, the others are added as a
new run. When a level has ``fan_in`` runs they are merged into one run of the next level.

Defined results: a null or empty text is one empty line; a text loses lines, never its row; each row
counts as a document of its own, so repeated rows count twice and rows that share the largest id all
keep the line; a null id counts as smallest. Input columns named like an output column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats.llm.common import ASCII_SPACE, ascii_lower, others, quoted, stage

HASH = ["h1", "h2"]


class LineRuns:
    """Levelled sorted runs of line hashes."""

    def __init__(self, spark: SparkSession, fan_in: int = 4):
        self.spark, self.fan_in = spark, fan_in
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def merged(self, runs: list[DataFrame] | None = None) -> DataFrame | None:
        """One row per hash over all runs."""
        runs = self.runs() if runs is None else runs
        if not runs:
            return None
        return (reduce(DataFrame.union, runs).groupBy(*HASH)
                .agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper")))

    def add(self, entries: DataFrame, settled_at: int) -> None:
        """Add a batch: one row per line and document, ids below those of earlier batches."""
        fresh = entries.groupBy(*HASH).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        known = self.merged()
        if known is not None:
            fresh = fresh.join(known.filter(F.col("n_docs") >= settled_at), HASH, "left_anti")
        self._put(0, fresh)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(stage(run.sortWithinPartitions(*HASH), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fan_in:
            merged = self.merged(self.levels[level])
            self.levels[level] = []
            self._put(level + 1, merged)


def _marks(lines: Column, min_chars: int) -> Column:
    """Long lines of a text as (h1, h2, pos, first), ``first`` once for every distinct key."""
    keys = F.transform(lines, lambda x: ascii_lower(F.btrim(x, F.lit(ASCII_SPACE))))
    hashed = F.transform(keys, lambda k, i: F.struct(
        F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"), i.alias("pos"),
        (F.char_length(k) >= min_chars).alias("long")))
    return F.sort_array(F.filter(hashed, lambda m: m["long"]))


def line_entries(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_key, h1, h2, pos, first: one row per long line."""
    marks = (docs.select("doc_id", F.xxhash64("text").alias("text_key"),
                         _marks(F.split(F.coalesce("text", F.lit("")), "\n"), min_chars).alias("marks"))
             .select("doc_id", "text_key", F.posexplode(
                 F.transform("marks", lambda m, i: F.struct(
                     m["h1"].alias("h1"), m["h2"].alias("h2"), m["pos"].alias("pos"),
                     ((i == 0) | (F.get("marks", i - 1)["h1"] != m["h1"])
                      | (F.get("marks", i - 1)["h2"] != m["h2"])).alias("first"))))))
    return marks.select("doc_id", "text_key", "col.h1", "col.h2", "col.pos", "col.first")


def repeated_lines(entries: DataFrame, min_docs: int, batches: int, fan_in: int) -> DataFrame:
    """h1, h2, keeper of the lines found in at least ``min_docs`` documents."""
    spark = entries.sparkSession
    cuts = entries.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0]
    edges = sorted(set(cuts or []), reverse=True)
    runs = LineRuns(spark, fan_in)
    firsts = entries.filter("first").select("doc_id", *HASH)
    above = None
    for edge in [*edges, None]:
        part = F.lit(True) if above is None else F.coalesce(F.col("doc_id") < above, F.lit(True))
        part = part if edge is None else part & (F.col("doc_id") >= edge)
        runs.add(firsts.filter(part), min_docs)
        above = edge
    return runs.merged().filter(F.col("n_docs") >= min_docs).select(*HASH, "keeper")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4,
                fan_in: int = 3) -> DataFrame:
    """All columns of ``docs`` with the lines that stay as ``text``, and n_lines, n_dropped."""
    entries = stage(line_entries(docs, min_chars), "line-entries")
    repeated = repeated_lines(entries, min_docs, batches, fan_in)
    drops = (entries.join(repeated, HASH).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("doc_id").alias("drop_doc"), F.col("text_key").alias("drop_text"))
             .agg(F.collect_set("pos").alias("drops")))
    rest = others(docs, "text", "n_lines", "n_dropped")
    split = docs.select(F.struct(*map(quoted, rest)).alias("row"), "doc_id", "text",
                        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"),
                        F.xxhash64("text").alias("text_key"))
    split = split.select("row", "doc_id", "lines", "text_key")
    joined = split.join(drops.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("drop_doc"))
                        & (F.col("text_key") == F.col("drop_text")), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drops")
    text = F.when(F.col("drops").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    return joined.select("row.*", text.alias("text"), F.size("lines").cast("long").alias("n_lines"),
                         F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"))
