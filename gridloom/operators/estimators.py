"""Extension points: normalizers as ML stages, and metrics of one's own with a state that merges.

A normalizer is an Estimator whose model keeps the figures of each band (a row a
band) as a parameter, so it is saved, loaded and put into a Pipeline as any stage.
A metric is named sums and a formula over them, both SQL text, so it is stored as
JSON; its state is a table whose rows add up, in any order and over any batches.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("standard", "minmax", "positive")


class _Bands(Params):
    """Columns and method of a normalizer."""

    method = Param(Params._dummy(), "method", "standard, minmax, or positive (standard over values above 0)", TypeConverters.toString)
    bandCol = Param(Params._dummy(), "bandCol", "name of the band", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "value", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "normalized value", TypeConverters.toString)
    eps = Param(Params._dummy(), "eps", "least spread", TypeConverters.toFloat)

    def _set_up(self, given: dict):
        self._setDefault(method="standard", bandCol="band", inputCol="value", outputCol="normalized", eps=1e-8)
        self._set(**{k: v for k, v in given.items() if v is not None})
        if self.getOrDefault("method") not in METHODS:
            raise ValueError(f"method is one of {', '.join(METHODS)}")


class BandNormalizer(Estimator, _Bands, DefaultParamsReadable, DefaultParamsWritable):
    """Fits centre and spread of each band in one aggregation; nulls, NaN and rows without a band are left out."""

    def __init__(self, method=None, bandCol=None, inputCol=None, outputCol=None, eps=None):
        super().__init__()
        self._set_up({"method": method, "bandCol": bandCol, "inputCol": inputCol, "outputCol": outputCol, "eps": eps})

    def _fit(self, dataset: DataFrame) -> "BandNormalizerModel":
        v, method = F.col(self.getOrDefault("inputCol")).cast("double"), self.getOrDefault("method")
        known = dataset.filter(F.col(self.getOrDefault("bandCol")).isNotNull() & v.isNotNull() & ~F.isnan(v) & ((v > 0) if method == "positive" else F.lit(True)))
        if method == "minmax":
            figures = (F.min(v), F.max(v) - F.min(v))
        else:
            figures = (F.avg(v), F.stddev_pop(v))
        rows = known.groupBy(F.col(self.getOrDefault("bandCol")).cast("string").alias("b")).agg(*[f.alias(n) for f, n in zip(figures, ("centre", "spread"))])
        stats = {r["b"]: [r["centre"], r["spread"]] for r in rows.collect()}  # a row a band
        model = BandNormalizerModel(stats=json.dumps(stats, sort_keys=True))
        return self._copyValues(model)


class BandNormalizerModel(Model, _Bands, DefaultParamsReadable, DefaultParamsWritable):
    """Adds outputCol: (value - centre) / max(spread, eps) by band; null for bands that were not fitted."""

    stats = Param(Params._dummy(), "stats", "JSON: band to centre and spread", TypeConverters.toString)

    def __init__(self, stats=None):
        super().__init__()
        self._set_up({})
        self._setDefault(stats="{}")
        if stats is not None:
            self._set(stats=stats)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = json.loads(self.getOrDefault("stats"))
        band, v = F.col(self.getOrDefault("bandCol")).cast("string"), F.col(self.getOrDefault("inputCol")).cast("double")
        if not held:
            return dataset.withColumn(self.getOrDefault("outputCol"), F.lit(None).cast("double"))
        of = lambda i: F.create_map(*[F.lit(x) for b, s in sorted(held.items()) for x in (b, float(s[i]))])[band]
        return dataset.withColumn(self.getOrDefault("outputCol"), (v - of(0)) / F.greatest(of(1), F.lit(float(self.getOrDefault("eps")))))


@dataclass(frozen=True)
class Metric:
    """``parts``: name to an SQL aggregate that is a sum or count; ``formula``: SQL over those names, null where undefined."""

    name: str
    parts: dict[str, str]
    formula: str

    def state(self, df: DataFrame, *by: str) -> DataFrame:
        """(by, parts) of ``df``; states of several tables add up by :meth:`merged`."""
        return df.groupBy(*by).agg(*[F.expr(sql).cast("double").alias(n) for n, sql in self.parts.items()])

    def merged(self, *states: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        all_of = states[0]
        for s in states[1:]:
            all_of = all_of.unionByName(s)
        return all_of.groupBy(*by).agg(*[F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in self.parts])

    def result(self, state: DataFrame, *by: str) -> DataFrame:
        """(by, value)."""
        return state.select(*by, self.value().alias(self.name))

    def value(self) -> Column:
        return F.expr(self.formula).cast("double")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Metric":
        return cls(**json.loads(spark.read.text(path).first()["value"]))


REGISTRY: dict[str, Metric] = {}


def register(metric: Metric) -> Metric:
    """Make a metric known to :func:`evaluate`; one of the same name is replaced."""
    REGISTRY[metric.name] = metric
    return metric


register(Metric("accuracy", {"hit": "count_if(cls = pred)", "n": "count_if(cls is not null and pred is not null)"}, "hit / nullif(n, 0)"))
register(Metric("iou_foreground", {"both": "count_if(cls > 0 and cls = pred)", "either": "count_if(cls > 0 or pred > 0)"}, "both / nullif(either, 0)"))


def evaluate(df: DataFrame, names: list[str], *by: str) -> DataFrame:
    """(by, one column for each metric) in one pass over ``df``: the parts of all metrics are summed together."""
    chosen = [REGISTRY[n] for n in names]
    parts = [F.expr(sql).cast("double").alias(f"{m.name}__{p}") for m in chosen for p, sql in m.parts.items()]
    s = df.groupBy(*by).agg(*parts)
    out = s.select(*by, *[F.struct(*[F.col(f"{m.name}__{p}").alias(p) for p in m.parts]).alias(m.name) for m in chosen])
    for m in chosen:
        held = out.select("*", *[F.col(f"{m.name}.{p}").alias(p) for p in m.parts])
        out = held.withColumn(m.name, m.value()).drop(*m.parts)
    return out
