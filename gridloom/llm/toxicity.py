"""Operator 1: toxicity by gradient-boosted trees over dense features.

Stages: a lexicon of words and word stems is learned from labelled texts and
joined to a short fixed list; each whole text becomes a dozen dense figures
(lexicon densities, nearness of second-person words, capitals, punctuation,
obfuscation); boosted trees (Spark ML) are fitted on a bounded sample of
labelled rows; isotonic regression on rows of its own turns their output into a
probability.

Labels come only from rows whose ``crc32(doc_id) % 3`` is not 1.  Those rows are
divided once more by a hash of the id: lexicon, trees and calibration each see
rows that the others don't, so the trees meet the lexicon as unseen texts do.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, bounded, materialise, ship

# Common insults, and second-person words of English, German, French and Spanish.
SEED = (
    "idiot moron stupid scum trash worthless loser pathetic disgusting clown dumb "
    "bastard bitch asshole retard whore slut fuck shit cunt jerk creep vermin "
    "arschloch trottel depp schlampe fotze wichser salaud connard connasse abruti "
    "pute cabron pendejo puta imbecil estupido mierda gilipollas"
).split()
SECOND = (
    "you your yours yourself u ur ya du dich dir dein deine euch ihr tu te toi ton "
    "ta vous votre ti usted ustedes vosotros"
).split()
# Characters that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""}

FEATURES = [
    "hit_rate", "hit_log", "weight_rate", "weight_max", "near_second", "second_rate",
    "capital_rate", "capital_words", "exclaim_rate", "punct_rate", "odd_rate", "odd_hits", "log_words",
]
STEMS = (4, 5, 6, 7)

FEATURE_TYPE = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), *[T.StructField(f, T.DoubleType()) for f in FEATURES]]
)

_WORD = re.compile(r"\w+").findall
_ODD = re.compile(r"[^\W\d_]+(?:[0-9@$!*._-]+[^\W\d_]+)+|[0-9@$]+[^\W\d_]{2,}(?:[0-9@$!*._-]+[^\W\d_]+)*").findall


def terms_of(word: str) -> list[str]:
    """The word and its stems, marked by a star."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) >= k]]


class Scanner:
    """Dense figures of a text under a lexicon {term: weight}; memo bounded by ``most`` words."""

    def __init__(self, lexicon: dict[str, float], most: int = 200_000):
        self.lexicon, self.most, self.memo = lexicon, most, {}
        self.second = frozenset(SECOND)
        self.leet = str.maketrans(LEET)

    def weight(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            got = max((self.lexicon.get(t, 0.0) for t in terms_of(word)), default=0.0)
            if len(self.memo) >= self.most:
                self.memo.clear()
            if len(word) <= 64:
                self.memo[word] = got
        return got

    def figures(self, text: str | None) -> list[float]:
        from math import log1p

        if not text:
            return [0.0] * len(FEATURES)
        words = _WORD(text.lower())
        n = max(len(words), 1)
        memo, weight = self.memo, self.weight
        at, total, top = [], 0.0, 0.0
        for i, w in enumerate(words):
            x = memo.get(w)
            if x is None:
                x = weight(w)
            if x:
                at.append(i)
                total += x
                top = max(top, x)
        second = self.second
        near = sum(1 for i in at if not second.isdisjoint(words[max(0, i - 5) : i + 6]))
        odd = _ODD(text.lower())
        odd_hits = sum(1 for w in odd if weight(w.translate(self.leet)))
        size = len(text)
        upper = sum(map(str.isupper, text)) if not text.islower() else 0
        marks = text.count("!")
        punct = marks + sum(map(text.count, "?.,;:#*$%&|<>@"))
        capital = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper > 0 else 0
        return [
            len(at) / n, log1p(len(at)), total / n, top, near / n, sum(map(second.__contains__, words)) / n,
            upper / size, capital / n, marks / size, punct / size, len(odd) / n, float(odd_hits), log1p(n),
        ]


def held_out(doc_id):
    """The rows whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame, *, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(doc_id, y, fold): at most ``max_rows`` labelled rows that may be learned from, by smallest hash.

    Null ids or labels don't count; of several labels of an id the largest does.
    fold 0-4: lexicon, 5-7: trees, 8-9: calibration.
    """
    y = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    h = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    return y.withColumn("h", h).orderBy("h", "doc_id").limit(max_rows).select("doc_id", "y", F.pmod("h", F.lit(10)).alias("fold"))


def learn_lexicon(texts: DataFrame, *, min_gain: float = 28.0) -> dict[str, float]:
    """{term: weight} from (y, text): terms whose documents are mostly toxic, beyond chance.

    For each word or stem: documents and toxic documents that hold it; the
    likelihood-ratio gain over the base rate must pass ``min_gain`` (about what
    the number of terms tried lets chance reach), so a term needs several documents
    and the bounded labelled sample bounds the terms.  Weight: log odds, bounded.
    """
    import pyarrow as pa

    def rows(batches):
        from collections import Counter

        n, x = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                have = set()
                for w in set(_WORD((text.as_py() or "").lower())):
                    have.update(terms_of(w))
                n.update(have)
                if y:
                    x.update(have)
            if len(n) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values())), pa.array([x[t] for t in n])], names=["term", "n", "x"])
                n, x = Counter(), Counter()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array(list(n.values())), pa.array([x[t] for t in n])], names=["term", "n", "x"])

    size = texts.agg(F.count("*").alias("n"), F.sum("y").alias("x")).first()
    lexicon = {w: 4.0 for w in SEED}
    if not size["x"] or size["x"] == size["n"]:
        return lexicon
    base = size["x"] / size["n"]
    t = texts.select("y", "text").mapInArrow(rows, "term string, n long, x long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    t = t.filter((F.col("x") >= 3) & (F.col("x") > F.col("n") * 0.5))
    miss = F.col("n") - F.col("x")
    gain = 2 * (
        F.col("x") * F.log(F.col("x") / (F.col("n") * base))
        + F.when(miss > 0, miss * F.log(miss / (F.col("n") * (1 - base)))).otherwise(0.0)
    )
    weight = F.least(F.lit(6.0), F.log((F.col("x") + 0.5) / (miss + 0.5)) - F.lit(math.log(base / (1 - base))))
    found = t.select("term", gain.alias("gain"), weight.alias("weight")).filter(F.col("gain") > min_gain)
    return lexicon | {r["term"]: max(r["weight"], lexicon.get(r["term"], 0.0)) for r in found.collect()}


def features(docs: DataFrame, lexicon: dict[str, float], *, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash and FEATURES of every whole text, without a shuffle."""
    import pyarrow as pa

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(lexicon)

    def rows(batches):
        scan = Scanner(shared.value)
        for batch in batches:
            got = [scan.figures(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([g[k] for g in got], pa.float64()) for k in range(len(FEATURES))]],
                names=FEATURE_TYPE.names,
            )

    t = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("text")).mapInArrow(rows, FEATURE_TYPE)


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 20_000,
    trees: int = 16,
    depth: int = 3,
    threshold: float = 0.7,
) -> DataFrame:
    """doc_id, text_hash, held_out, score, predicted for every row of ``docs``.

    ``max_rows`` bounds the labelled sample that is fitted.  Null texts are
    empty ones; both get a score.  Where trees or calibration would see fewer
    than five rows of a class in rows of their own, both are fitted on all
    labelled rows, the lexicon's included.  Without both classes among the labels
    that may be learned from, the score is hits / (hits + 1) over the fixed list.
    Rows that repeat an id or a text are scored each; a null id is never learned from.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    ship(docs.sparkSession)
    train = materialise(training_labels(labels, id_col=id_col, label_col=label_col, max_rows=max_rows))
    sample = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(bounded(train.filter("fold < 5")), "doc_id")
    lexicon = learn_lexicon(materialise(sample.select("y", "text")))
    f = materialise(features(docs, lexicon, id_col=id_col, text_col=text_col))
    out = [F.col("doc_id"), F.col("text_hash"), held_out(F.col("doc_id")).alias("held_out")]
    known = materialise(
        f.join(bounded(train), "doc_id").select(F.col("y").cast("double").alias("y"), "fold", *FEATURES).coalesce(4)
    )
    fit, tune = known.filter("fold between 5 and 7"), known.filter("fold > 7")
    counts = {r["k"]: (r["n"], r["x"]) for r in known.filter("fold > 4").groupBy((F.col("fold") > 7).alias("k")).agg(F.count("*").alias("n"), F.sum("y").alias("x")).collect()}
    few = lambda n, x: x < 5 or n - x < 5
    if any(few(*counts.get(k, (0, 0))) for k in (False, True)):
        fit = tune = known
        n, x = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
        if x in (0, n):
            hits = F.expm1("hit_log")
            s = f.select(*out, (hits / (hits + 1)).alias("score"))
            return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
    pack = VectorAssembler(inputCols=FEATURES, outputCol="v")
    model = GBTClassifier(featuresCol="v", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=11).fit(
        pack.transform(fit).select("y", "v")
    )

    def raw(df):
        return model.transform(pack.transform(df)).withColumn("p", vector_to_array("probability")[1]).drop("v", "rawPrediction", "probability", "prediction")

    # rows of equal output weigh as one
    levels = raw(tune).groupBy("p").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("w"))
    iso = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w", predictionCol="score").fit(levels)
    scored = iso.transform(raw(f).select(*out, "p")).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score"))).drop("p")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` without the rows that :func:`score` predicts toxic; all columns stay.

    Rows are matched by id and text, nulls included.
    """
    s = score(docs, labels, id_col=id_col, text_col=text_col, **params)
    bad = materialise(s.filter("predicted = 1").select(F.col("doc_id").alias(f"{OWN}id"), F.col("text_hash").alias(f"{OWN}hash")).distinct())
    return docs.join(
        bounded(bad), F.col(id_col).eqNullSafe(F.col(f"{OWN}id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(f"{OWN}hash")), "left_anti"
    )


def op1_toxicity_trees(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels).select("doc_id", "held_out", "score", "predicted")
