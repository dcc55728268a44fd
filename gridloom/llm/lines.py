"""Operator 10 (native): line dedup over levelled sorted runs of line hashes.

:class:`LineRuns` holds, per level, sorted runs of ``(h1, h2, n_docs)``: a
128-bit hash of a line's key and a number of documents it was seen in.  A new
batch is merge-anti-joined against the runs (``seen``), which tells its new lines
from the known ones, whose counts go on; both are added as a level-0 run.
``fanout`` runs of a level are merged into one of the next.  Runs are tables in
the shared folder.

Everything is DataFrame functions; texts are shuffled once, by document, for
documents that lose lines to meet the hashes they lose.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, bounded, discard, free, materialise, scratch

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c):
    """A-Z to a-z and nothing else; texts that are all ASCII take the fast path."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip(c):
    return F.btrim(c, F.lit(BLANK))


def _h1(key):
    return F.xxhash64(key)


def _h2(key):
    return F.xxhash64(F.lit(7), key)


class LineRuns:
    """Levelled runs of line hashes; ``levels[k]`` is a list of run paths.

    A batch's lines that no run holds yet enter as they are; those of lines that
    are known enter as further counts, which the merges of runs add up.
    """

    def __init__(self, spark, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _write(self, df: DataFrame) -> DataFrame:
        return materialise(df.sortWithinPartitions("h1", "h2"))

    def _sum(self, runs: list[DataFrame]) -> DataFrame:
        if not runs:
            return self.spark.range(0).selectExpr("id AS h1", "id AS h2", "id AS n_docs")
        return reduce(DataFrame.union, runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))

    def all(self) -> DataFrame:
        """(h1, h2, n_docs) over all runs."""
        return self._sum([r for level in self.levels for r in level])

    def seen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (with h1, h2) whose line is in no run yet."""
        return keys.join(self.all().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")

    def add(self, keys: DataFrame) -> DataFrame:
        """Add a batch with a row for each document and distinct line of it.

        Returns (h1, h2, n_docs): the batch's lines with their counts over all
        batches so far.
        """
        batch = materialise(keys.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")))
        new = materialise(self.seen(batch))
        known = batch.join(self.all().withColumnRenamed("n_docs", "before").hint("merge"), ["h1", "h2"])
        known = materialise(known.select("h1", "h2", "n_docs", (F.col("before") + F.col("n_docs")).alias("total")))
        self.levels[0].append(self._write(new.union(known.drop("total"))))
        discard(batch)
        k = 0
        while len(self.levels[k]) >= self.fanout:
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(self._sum(self.levels[k])))
            discard(*self.levels[k])
            self.levels[k] = []
            k += 1
        return new.union(known.select("h1", "h2", F.col("total").alias("n_docs")))

    def drop(self) -> None:
        """Delete all runs."""
        discard(*[r for level in self.levels for r in level])
        self.levels = [[]]


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_key: int) -> DataFrame:
    """(id_col, h1, h2) for each document and distinct line key of at least ``min_key`` code points."""
    keys = F.filter(
        F.transform(F.split(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), "\n", -1), strip),
        lambda k: F.length(k) >= min_key,
    )
    hashed = F.array_distinct(F.transform(keys, lambda k: F.struct(_h1(k).alias("h1"), _h2(k).alias("h2"))))
    return docs.select(id_col, F.explode(hashed).alias("_k")).select(id_col, "_k.h1", "_k.h2")


def drop_repeated_lines(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = 10,
    min_key: int = 1,
    batches: int = 4,
    fanout: int = 4,
) -> DataFrame:
    """``docs`` with lines removed whose key occurs in at least ``min_docs`` rows.

    Adds ``n_lines`` and ``n_dropped`` (prefixed where the caller has columns of
    these names); ``text_col`` holds the kept lines.  Null texts count as one
    empty line and become empty.  A key of fewer than ``min_key`` code points is
    never dropped.  Rows with equal ids count as documents of their own, repeated
    rows too; null ids are kept.

    The documents' lines come in ``batches`` (by hash of the row).  A line becomes
    frequent in the batch that brings it to ``min_docs``.
    """
    spark = docs.sparkSession
    counts = [free(c, docs.columns) for c in ("n_lines", "n_dropped")]
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    path = scratch(spark)
    keyed = line_keys(docs.select(row.alias("_row"), F.col(text_col).alias("_text")), "_row", "_text", min_key)
    keyed.withColumn("batch", F.pmod("_row", F.lit(batches)).cast("int")).write.partitionBy("batch").option("compression", "zstd").parquet(path)
    keys = spark.read.schema("_row long, h1 long, h2 long, batch int").parquet(path)
    runs, found = LineRuns(spark, fanout), []
    for b in range(batches):
        # rows that are equal in id and text share a batch and count as often as they occur
        found.append(runs.add(keys.filter(F.col("batch") == b)).filter(F.col("n_docs") >= min_docs).select("h1", "h2"))
    frequent = materialise(reduce(DataFrame.union, found).distinct())
    runs.drop()
    # a hash is dropped wherever it occurs, so rows of one key may share the set
    drop = keys.join(bounded(frequent), ["h1", "h2"]).groupBy("_row").agg(F.collect_set("h1").alias(f"{OWN}drop")).withColumnRenamed("_row", f"{OWN}row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.split(text, "\n", -1)
    kept = F.filter(raw, lambda l: ~F.array_contains(F.col(f"{OWN}drop"), _h1(strip(ascii_lower(l)))) | (F.length(strip(l)) < min_key))
    step = docs.withColumn(f"{OWN}key", row).join(drop, F.col(f"{OWN}key") == F.col(f"{OWN}row"), "left").withColumns(
        {f"{OWN}kept": F.when(F.col(f"{OWN}drop").isNotNull(), kept), counts[0]: F.size(raw).cast("long")}
    )
    return step.withColumns(
        {
            text_col: F.when(F.col(f"{OWN}kept").isNotNull(), F.array_join(f"{OWN}kept", "\n")).otherwise(text),
            counts[1]: F.when(F.col(f"{OWN}kept").isNotNull(), F.col(counts[0]) - F.size(f"{OWN}kept")).otherwise(F.lit(0)).cast("long"),
        }
    ).drop(f"{OWN}kept", f"{OWN}drop", f"{OWN}row", f"{OWN}key")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the same rule.  Line breaks and blanks are written with chr().
OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, rid, i, line,
         translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, rid, unnest(parts) AS line, unnest(range(len(parts))) AS i
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY l.doc_id, l.rid
"""
