"""Class mappings from JSON text, in the shapes they are stored in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def parse(files: DataFrame) -> DataFrame:
    """(path, orig, idx): each model class idx with its original class, from (path, json).

    In order: a file named ``*inverse*`` maps model to original classes; else the
    member class_mapping maps original to model classes; else reverse_mapping
    model to original ones; else the whole object original to model ones.  Of
    entries of one model class the last stays.  Keys and values that aren't
    numbers are left out, as are files that aren't JSON objects.
    """
    as_map = lambda c: F.from_json(c, "map<string,string>")
    inner = lambda k: as_map(F.get_json_object("json", f"$.{k}"))
    named = F.element_at(F.split("path", "/"), -1).contains("inverse")
    forward, reverse = inner("class_mapping"), inner("reverse_mapping")
    m = F.when(named, as_map(F.col("json"))).otherwise(F.coalesce(forward, reverse, as_map(F.col("json"))))
    to_orig = named | (forward.isNull() & reverse.isNotNull())
    e = files.select("path", to_orig.alias("to_orig"), F.posexplode(F.map_entries(m)).alias("at", "e"))
    k, v = F.expr("try_cast(e.key as int)"), F.expr("try_cast(e.value as int)")
    e = e.select("path", "at", F.when(F.col("to_orig"), v).otherwise(k).alias("orig"), F.when(F.col("to_orig"), k).otherwise(v).alias("idx"))
    return e.filter("orig is not null and idx is not null").groupBy("path", "idx").agg(F.max_by("orig", "at").alias("orig")).select("path", "orig", "idx")


def discover(files: DataFrame, root: str) -> DataFrame:
    """The one mapping file that applies to ``root`` (a prediction's folder): nearest folder first, then the exact names."""
    names = F.array(*[F.lit(n) for n in ("inverse_class_mapping.json", "class_mapping.json")])
    f = files.withColumn("_name", F.element_at(F.split("path", "/"), -1)).filter(F.col("_name").rlike(r"mapping.*\.json$"))
    parents = F.array(*[F.lit("/".join(root.rstrip("/").split("/")[: len(root.rstrip("/").split("/")) - i])) for i in range(4)])
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    up, exact = F.array_position(parents, folder), F.array_position(names, F.col("_name"))
    r = f.withColumns({"_up": up, "_exact": F.when(exact > 0, exact).otherwise(9)}).filter("_up > 0")
    return r.withColumn("_r", F.row_number().over(W.orderBy("_up", "_exact", "path"))).filter("_r = 1").drop("_name", "_up", "_exact", "_r")


def to_json(mapping: DataFrame) -> DataFrame:
    """One row, json: an object of class_mapping, reverse_mapping and class_values."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col("orig"), F.col("idx"))))
    text = lambda a, b: F.map_from_entries(F.transform(a, b))
    g = mapping.agg(pairs.alias("p"))
    return g.select(
        F.to_json(
            F.struct(
                text(F.col("p"), lambda x: F.struct(x["orig"].cast("string"), x["idx"])).alias("class_mapping"),
                text(F.col("p"), lambda x: F.struct(x["idx"].cast("string"), x["orig"])).alias("reverse_mapping"),
                F.transform("p", lambda x: x["orig"]).alias("class_values"),
            )
        ).alias("json")
    )


def tag_list(tags: Column, key: str) -> Column:
    """A comma-joined tag as an array of trimmed names."""
    return F.transform(F.split(tags[key], ","), F.trim)


# What a stored normalizer holds where it names nothing else.
NORMALIZER = {"method": "pretrained", "rgb_mean": [0.485, 0.456, 0.406], "rgb_std": [0.229, 0.224, 0.225], "other_mean": 0.5, "other_std": 0.5, "raw_scale_factor": 10000.0, "is_fitted": True}


def normalizers(files: DataFrame) -> DataFrame:
    """(path, method, rgb_mean, rgb_std, other_mean, other_std, raw_scale_factor, is_fitted) from (path, json).

    Missing members get the pretrained defaults, mean and deviation of a kind as a
    pair; text that isn't a JSON object gives the defaults alone.
    """
    kinds = {"method": "string", "rgb_mean": "array<double>", "rgb_std": "array<double>", "other_mean": "double", "other_std": "double", "raw_scale_factor": "double", "is_fitted": "boolean"}
    j = files.select("path", F.from_json("json", ", ".join(f"{k} {t}" for k, t in kinds.items())).alias("j"))
    fixed = lambda k: F.array(*map(F.lit, NORMALIZER[k])) if isinstance(NORMALIZER[k], list) else F.lit(NORMALIZER[k])
    value = {k: F.coalesce(F.col(f"j.{k}"), fixed(k)) for k in kinds}
    for a, b in (("rgb_mean", "rgb_std"), ("other_mean", "other_std")):
        both = F.col(f"j.{a}").isNotNull() & F.col(f"j.{b}").isNotNull()
        value |= {k: F.when(both, F.col(f"j.{k}")).otherwise(fixed(k)) for k in (a, b)}
    return j.select("path", *[v.alias(k) for k, v in value.items()])


def precedence(files: DataFrame) -> DataFrame:
    """(path, orig, idx) of the one mapping that applies, from candidates (kind, path, json).

    kind ``checkpoint`` counts first, if it has a member remapper; then ``given``,
    if it is a JSON object; then ``dataset``, class_mapping.json before others, if it has
    a member class_mapping.
    """
    inner = F.get_json_object("json", "$.remapper")
    text = F.when(F.col("kind") == "checkpoint", inner).when(F.col("kind") == "given", F.get_json_object("json", "$"))
    text = F.coalesce(text, F.when((F.col("kind") == "dataset") & F.get_json_object("json", "$.class_mapping").isNotNull(), F.col("json")))
    order = F.array_position(F.array(F.lit("checkpoint"), F.lit("given"), F.lit("dataset")), F.col("kind"))
    first = F.when(F.col("path").endswith("/class_mapping.json"), 0).otherwise(1)
    best = files.select("path", text.alias("json"), F.struct(order, first, "path").alias("o")).filter("json is not null")
    return parse(best.agg(F.min_by(F.struct("path", "json"), "o").alias("b")).filter("b is not null").select("b.*"))
