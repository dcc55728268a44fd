"""Operator 3 (native): quality rules with host-level verdicts.

Per document rule figures come from one scan, in higher-order functions over
the document's own words; no word is shuffled.  Failures are then aggregated by
host, each host's failure rate is shrunk towards the corpus by an empirical beta
prior, and the verdict is joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, materialise

BLANK = " \t\n\x0b\f\r"
WINDOW = 8


def _let(value, body):
    """Bind ``value`` once for ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows):
    """Positions covered by 8-word windows that occur twice or more.

    windows: hashes by start.  Sorting (hash, start) brings equal windows
    together; the sorted starts of repeated ones then cover at most 8 positions
    each, fewer where the next start is nearer.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s):
        return F.transform(
            F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])),
            lambda x: x["i"],
        )

    def cover(p):
        each = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x), F.lit(WINDOW)))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(_let(pairs, lambda s: F.sort_array(starts(s))), cover)


def rule_figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the base figures of every whole text; null texts have none."""
    t = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    bare = F.btrim(F.col("t"), F.lit(BLANK))
    lines = F.filter(F.split("t", "\n", -1), lambda l: F.length(F.btrim(l, F.lit(BLANK))) > 0)
    a = t.select(
        "doc_id",
        "host",
        F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>")).alias("words"),
        lines.alias("lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    b = a.select(
        "doc_id",
        "host",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    c = b.withColumn(
        "windows",
        F.when(
            F.size("hashes") >= WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("hashes")
    repeats = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0))
    return c.withColumn("n_repeat_words", repeats.cast("long")).drop("windows")


def host_verdicts(failures: DataFrame, rules: list[str], max_rate: float) -> DataFrame:
    """(host, host_rejected, host_n, and per rule the shrunk rate) from a frame with host and 0/1 rules.

    Beta prior of each rule by moments over all hosts: mean m, and the
    overdispersion of host rates beyond binomial noise gives its strength.  The
    moment estimate is kept within 0.001 to 0.5, that is a prior that weighs as
    much as 999 documents down to 1: few hosts can give estimates at or below 0,
    and one above 0.5 would be weaker than a single document.  A host is rejected
    if a posterior mean exceeds ``max_rate``.  Rows without a
    host belong to no host.
    """
    hosts = materialise(
        failures.filter(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), *[F.sum(r).alias(r) for r in rules])
    )
    total = hosts.agg(F.count("*").alias("j"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), *[F.sum(r).alias(r) for r in rules]).first()
    if not total["n"]:
        return hosts.select("host", F.lit(False).alias("host_rejected"), F.col("n").alias("host_n"), *[F.lit(0.0).alias(f"rate_{r}") for r in rules])
    means = {r: total[r] / total["n"] for r in rules}
    spread = hosts.agg(*[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - F.lit(means[r]), 2)).alias(r) for r in rules]).first()
    rates = {}
    for r in rules:
        m, free = means[r], total["j"] - 1
        noise, span = m * (1 - m), total["n"] - total["nn"] / total["n"] - free
        rho = (spread[r] - free * noise) / (span * noise) if noise > 0 and span > 0 else 0.0
        strength = 1 / min(max(rho, 1e-3), 0.5) - 1
        rates[r] = (F.col(r) + F.lit(m * strength)) / (F.col("n") + F.lit(strength))
    bad = None
    for r in rules:
        bad = (rates[r] > max_rate) if bad is None else bad | (rates[r] > max_rate)
    return hosts.select("host", bad.alias("host_rejected"), F.col("n").alias("host_n"), *[rates[r].alias(f"rate_{r}") for r in rules])


def host_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5
) -> DataFrame:
    """Base figures, base_failed, kept and the host's verdict, size and shrunk rates for each document.

    The rules summed by host are the base rule, symbols (more than a tenth of
    the word characters) and repeated lines (more than 30 % of the lines).  No
    words: base_failed.  Rows with a null host are judged by the base rule; their
    host columns are null and host_rejected false.  Repeated rows count each.
    """
    f = rule_figures(docs, id_col=id_col, text_col=text_col, host_col=host_col)
    f = f.withColumn("base_failed", (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))
    f = f.withColumns(
        {
            "r_base": F.col("base_failed").cast("long"),
            "r_symbols": (F.col("n_symbols") * 10 > F.col("word_chars")).cast("long"),
            "r_lines": (F.col("n_dup_lines") * 100 > F.col("n_lines") * 30).cast("long"),
        }
    )
    f = materialise(f)
    verdicts = materialise(host_verdicts(f, ["r_base", "r_symbols", "r_lines"], max_rate).withColumnRenamed("host", "v_host"))
    j = f.join(bounded(verdicts), F.col("host") == F.col("v_host"), "left")
    return j.withColumn("host_rejected", F.coalesce("host_rejected", F.lit(False))).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected")
    )


def op3_host_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return host_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected"
    )


#: DuckDB: the same figures over lists of words, and the prior by moments.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, host, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), s AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM (
    SELECT rid, i, list_slice(words, i, i + 7) AS win FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM w))
), r AS (
  SELECT rid, sum(step) AS n FROM (
    SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM s WHERE c > 1) GROUP BY rid
), f AS (
  SELECT w.rid, doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines
  FROM w LEFT JOIN r ON w.rid = r.rid
), g AS (
  SELECT *, n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
         n_symbols * 10 > word_chars AS r2, n_dup_lines * 100 > n_lines * 30 AS r3 FROM f
), long AS (
  SELECT host, unnest(['base', 'symbols', 'lines']) AS rule, unnest([base_failed::INT, r2::INT, r3::INT]) AS y FROM g WHERE host IS NOT NULL
), h AS (
  SELECT host, rule, count(*) AS n, sum(y) AS x FROM long GROUP BY ALL
), m AS (
  SELECT rule, sum(x) / sum(n) AS m, count(*) - 1 AS free, sum(n) AS nn, sum(n * n) AS n2 FROM h GROUP BY rule
), v AS (
  SELECT h.rule, sum(n * (x / n - m) * (x / n - m)) AS spread FROM h JOIN m ON h.rule = m.rule GROUP BY h.rule
), p AS (
  SELECT m.rule, m.m, 1 / least(greatest(CASE WHEN m * (1 - m) > 0 AND nn - n2 / nn - free > 0
         THEN (spread - free * m * (1 - m)) / ((nn - n2 / nn - free) * m * (1 - m)) ELSE 0 END, 0.001), 0.5) - 1 AS k
  FROM m JOIN v ON m.rule = v.rule
), q AS (
  SELECT host, bool_or((x + m * k) / (n + k) > 0.5) AS bad FROM h JOIN p ON h.rule = p.rule GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(bad, false) AS kept, coalesce(bad, false) AS host_rejected
FROM g LEFT JOIN q ON g.host = q.host
"""
