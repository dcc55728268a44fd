"""Operator 5 (native): entropy balancing of sources to token targets.

Rates minimise the relative entropy to one copy of every token, subject to each
source's token total, while a crossing column (the language) is drawn towards
its share of the tokens.  The dual is convex and its solution tilts every
document's rate exponentially: ``min(cap, exp(source's + language's multiplier))``.

The tokens of each (source, group of the crossing column) are summed once.  A
Newton iteration is a distributed aggregation over the sources: each source
solves for its own multiplier given those of the groups (a bounded number), and
the sums of gradient and Hessian over all sources give the groups' next step.

Rates are rounded by a hash of the document: it gets its rate's whole part, and
one more copy if its hash, less the rate's fraction, lies below a threshold of
its source, which is found by refining histograms until the tokens taken meet the
target.  A few flips per source close what a threshold leaves.  So copies follow
from a document's own row and a small table, and texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import OWN, bounded, discard, materialise

#: Thresholds are positions in 0..2**36, found 12 bits at a time.
DIGITS, ONE = (24, 12, 0), 1 << 35


def n_words(c) -> Column:
    """Number of words ([^\\x20\\x09-\\x0D]+) of a text; null: 0."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target): weights repeat over the sources by code point, null last.

    ``share`` of all tokens is dealt by weight; a target above ``cap`` times its
    source stops there and the excess is dealt again.  That fixed point is found
    in one pass: in order of cap * size / weight, sources are capped while their
    cap lies below the level of what remains.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    k = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    ranked = per.withColumn("w", weight).withColumn("most", F.col("source_size") * F.lit(cap))
    by_cap = W.orderBy(F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    left_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / left_w).withColumn("capped", F.col("most") <= F.col("level") * F.col("w"))
    water = F.min(F.when(~F.col("capped"), F.struct((F.col("most") / F.col("w")).alias("o"), "level"))).over(everything)
    return levels.withColumn("water", water["level"]).select(
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("most"), F.col("w") * F.col("water"))).alias("target"),
    )


def _solved(cells, target, cap: float):
    """The multiplier x of a source: sum of s * min(cap, exp(x + mu)) over its cells meets the target.

    Newton steps, halved into the bracket where they leave it.
    """
    return F.expr(
        f"""
        aggregate(sequence(1, 60), named_struct('lo', -80D, 'hi', 80D, 'x', 0D), (a, i) ->
          element_at(transform(array(aggregate({cells}, named_struct('g', 0D, 'h', 0D), (b, c) -> named_struct(
              'g', b.g + c.s * least({cap}D, exp(a.x + c.mu)),
              'h', b.h + if(exp(a.x + c.mu) < {cap}D, c.s * exp(a.x + c.mu), 0D)))),
            r -> element_at(transform(array(named_struct(
                'lo', if(r.g < {target}, a.x, a.lo), 'hi', if(r.g < {target}, a.hi, a.x),
                'x', a.x + if(r.h > 0, ({target} - r.g) / r.h, 1000D))),
              n -> named_struct('lo', n.lo, 'hi', n.hi, 'x', if(n.x > n.lo and n.x < n.hi, n.x, (n.lo + n.hi) / 2))), 1)), 1)).x
        """
    )


def entropy_rates(
    sums: DataFrame,
    targets: DataFrame,
    shares: list[float],
    *,
    cap: float = 2.0,
    ridge: float = 0.1,
    tolerance: float = 1e-7,
    max_iterations: int = 100,
) -> DataFrame:
    """(source, k, rate) of each cell from ``sums`` (source, k, s: tokens) and ``targets`` (source, target).

    ``shares[k]`` are the tokens that group k should have after the mix.  Source
    targets are met exactly; groups are drawn to their shares, and a multiplier
    m costs ``ridge * shares[k] * m * m / 2``, which keeps every case solvable.  A
    target of 0 gives rate 0, one of ``cap`` times the source rate ``cap``.
    Raises where the gradient does not come below ``tolerance`` of all tokens, or a
    source's tokens miss its target by more than a millionth.
    """
    import numpy as np

    per = sums.filter("s > 0").groupBy("source").agg(F.collect_list(F.struct("k", F.col("s").cast("double").alias("s"))).alias("cells"))
    t = targets.select(F.col("source").alias("_t"), "source_size", "target")
    per = materialise(per.join(bounded(t), F.col("source").eqNullSafe(F.col("_t"))).drop("_t"))
    n, want = len(shares), np.array(shares, float)
    whole = max(float(want.sum()), 1.0)

    def rated(mu):
        known = F.array(*[F.lit(float(m)) for m in mu])
        cells = F.transform("cells", lambda c: F.struct(c["k"].alias("k"), c["s"].alias("s"), F.get(known, c["k"]).alias("mu")))
        x = F.when(F.col("target") <= 0, F.lit(float("-inf"))).when(F.col("target") >= F.col("source_size") * cap, F.lit(float("inf")))
        return per.withColumn("cells", cells).withColumn("x", x.otherwise(_solved("cells", "target", cap)))

    rate = F.least(F.lit(cap), F.exp(F.col("x") + F.col("c.mu")))

    def evaluate(mu):
        """Gradient and Hessian of the dual in the groups' multipliers, sources solved."""
        at = rated(mu).select("source", "x", F.explode("cells").alias("c")).select("source", F.col("c.k").alias("k"), F.col("c.s").alias("s"), rate.alias("r"))
        at = at.withColumn("h", F.when((F.col("r") < cap), F.col("s") * F.col("r")).otherwise(F.lit(0.0)))
        rows = at.groupBy("source").agg(
            F.collect_list(F.struct("k", (F.col("s") * F.col("r")).alias("g"), "h")).alias("cells"), F.sum("h").alias("all")
        )
        first = rows.select("all", F.explode("cells").alias("a"), "cells").select("all", "a", F.explode("cells").alias("b"))
        cross = F.when(F.col("all") > 0, F.col("a.h") * F.col("b.h") / F.col("all")).otherwise(F.lit(0.0))
        same = F.col("a.k") == F.col("b.k")
        got = first.groupBy(F.col("a.k").alias("i"), F.col("b.k").alias("j")).agg(
            F.sum(F.when(same, F.col("a.g")).otherwise(F.lit(0.0))).alias("g"), F.sum(F.when(same, F.col("a.h")).otherwise(F.lit(0.0)) - cross).alias("h")
        )
        g, hess = np.zeros(n), np.diag(np.maximum(ridge * want, 1e-9))
        for r in got.collect():
            hess[r["i"], r["j"]] += r["h"]
            if r["i"] == r["j"]:
                g[r["i"]] = r["g"]
        return want - g - ridge * want * mu, hess

    mu, step = np.zeros(n), 1.0
    grad, hess = evaluate(mu)
    for _ in range(max_iterations):
        if np.abs(grad).max(initial=0.0) <= tolerance * whole:
            break
        move = np.clip(np.linalg.solve(hess, grad), -2, 2)
        new_grad, new_hess = evaluate(mu + step * move)
        if np.linalg.norm(new_grad) <= np.linalg.norm(grad):
            mu, grad, hess, step = mu + step * move, new_grad, new_hess, 1.0
        else:
            step /= 2
    else:
        raise ArithmeticError(f"the dual has not converged: {np.abs(grad).max() / whole:g} of all tokens are off")
    solved = rated(mu).select("source", "x", "target", F.explode("cells").alias("c"))
    met = solved.filter((F.col("x") > float("-inf")) & (F.col("x") < float("inf"))).groupBy("source", "target").agg(F.sum(F.col("c.s") * rate).alias("t"))
    worst = met.agg(F.max(F.abs(F.col("t") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)))).first()[0] or 0.0
    if worst > 1e-6:
        raise ArithmeticError(f"a source's multiplier has not converged: its tokens miss the target by {worst:g} of it")
    return solved.select("source", F.col("c.k").alias("k"), rate.alias("rate"))


def _position(rate, h):
    """0..2**36: a document takes one more copy if this lies below its source's threshold; about 2**35."""
    u = F.shiftrightunsigned(h, 31) / F.lit(float(1 << 33))
    return F.floor((u - (rate - F.floor(rate)) + 1) * ONE).cast("long")


def _thresholds(thin: DataFrame) -> DataFrame:
    """(source, cut): the positions below which the tokens fill each source's need best.

    ``thin`` has source, need, q and w (tokens of one more copy).  Three
    histograms of 4096 bins, each inside the bin of the last where the need is met.
    """
    found = thin.select("source", "need").distinct().withColumns({"prefix": F.lit(0).cast("long"), "done": F.lit(0).cast("long")})
    found = materialise(found)
    for shift in DIGITS:
        bins = thin.select("source", "q", "w").join(
            bounded(found.select(F.col("source").alias("_s"), "need", "prefix", "done")),
            F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("q", shift + 12) == F.col("prefix")),
        )
        bins = bins.groupBy("source", "need", "prefix", "done", F.shiftright("q", shift).alias("bin")).agg(F.sum("w").alias("w"))
        # at most 4096 bins of a source (8192 of the first histogram) are summed in order
        before = F.coalesce(F.sum("w").over(W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        placed = bins.withColumn("done", F.col("done") + before)
        last = W.partitionBy("source")
        hit = placed.withColumn("at", F.max(F.when(F.col("done") <= F.col("need"), F.col("bin"))).over(last)).filter("bin = at")
        nxt = materialise(hit.select("source", "need", F.col("bin").alias("prefix"), "done", "w"))
        discard(found)
        found = nxt
    # the last position is taken if that comes nearer
    more = F.abs(F.col("done") + F.col("w") - F.col("need")) < F.abs(F.col("done") - F.col("need"))
    return materialise(found.select(F.col("source").alias("c_source"), (F.col("prefix") + F.when(more, 1).otherwise(0)).alias("cut")))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    group_col: str | None = "lang",
    weights=(5, 2, 1),
    share: float = 1.5,
    cap: int = 2,
    most_groups: int = 1000,
    ridge: float = 0.1,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (working columns, prefixed): one row per row.

    Use :func:`planned` for plain names.  Null and empty texts have size 0 and copies by their
    rate; a null source is a source (last in order), a null group a group.  Every
    group has a multiplier of its own; more than ``most_groups`` of them (their
    Hessian is solved on the driver) raise, none is left out or joined.  Rows of
    equal id, text and source are dealt alike.  Copies are 0 to ``cap``; the result
    depends on the rows alone, not on partitions.
    """
    text = F.col(text_col).cast("string")
    group = F.col(group_col) if group_col else F.lit(None)
    own = {
        f"{OWN}h": F.xxhash64(F.col(id_col), text),
        f"{OWN}group": group.cast("string"),
        f"{OWN}size": n_words(text),
    }
    seen = docs.withColumns(own)
    # rows that are dealt alike are one thin row
    thin = materialise(
        seen.groupBy(F.col(source_col).alias("source"), F.col(f"{OWN}group").alias("g"), F.col(f"{OWN}h").alias("h"), F.col(f"{OWN}size").alias("size")).agg(
            F.count("*").alias("n")
        )
    )
    words = F.sum(F.col("size") * F.col("n"))
    targets = materialise(source_targets(thin.groupBy("source").agg(words.alias("size")), weights=weights, share=share, cap=float(cap)))
    totals = thin.groupBy("g").agg(words.alias("s")).orderBy(F.desc("s"), "g").limit(most_groups + 1).collect()
    if len(totals) > most_groups:
        raise ValueError(f"{group_col} has more than {most_groups} values; mix by a coarser column or by none")
    names = [r["g"] for r in totals]
    known = F.create_map(*[F.lit(x) for k, v in enumerate(names) if v is not None for x in (v, k)]) if any(v is not None for v in names) else None
    none = F.lit(names.index(None) if None in names else len(names))
    index = F.coalesce(known[F.col("g")], none) if known is not None else none
    sums = materialise(thin.groupBy("source", index.alias("k")).agg(words.alias("s")))
    by_group = {r["k"]: float(r["s"] or 0) for r in sums.groupBy("k").agg(F.sum("s").alias("s")).collect()}
    size, goal = sum(by_group.values()), targets.agg(F.sum("target")).first()[0] or 0.0
    shares = [by_group.get(k, 0.0) * (goal / size if size else 0.0) for k in range(len(names) + 1)]
    rates = entropy_rates(sums, targets, shares, cap=float(cap), ridge=ridge)
    # a group without tokens in a source takes the source's mean rate
    plain = F.least(F.lit(float(cap)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    plan = materialise(
        targets.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(names)))))
        .alias("t")
        .join(rates.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source")) & (F.col("t.k") == F.col("r.k")), "left")
        .select(F.col("t.source").alias("p_source"), F.col("t.k").alias("p_k"), "source_size", "target", F.coalesce("rate", plain).alias("rate"))
    )
    dealt = thin.withColumn("k", index).join(bounded(plan), F.col("source").eqNullSafe(F.col("p_source")) & (F.col("k") == F.col("p_k")))
    dealt = dealt.withColumns({"whole": F.floor("rate").cast("int"), "q": _position(F.col("rate"), F.col("h")), "w": F.col("size") * F.col("n")})
    dealt = materialise(dealt.select("source", "h", "w", "q", "whole", "target"))
    need = dealt.groupBy("source", "target").agg(F.sum(F.col("w") * F.col("whole")).alias("base"))
    need = materialise(need.select(F.col("source").alias("n_source"), (F.col("target") - F.col("base")).alias("need")))
    open_ = dealt.filter((F.col("whole") < cap) & (F.col("w") > 0)).join(bounded(need), F.col("source").eqNullSafe(F.col("n_source")))
    cuts = _thresholds(open_)
    taken = dealt.join(bounded(cuts), F.col("source").eqNullSafe(F.col("c_source")), "left").withColumn(
        "copies", F.col("whole") + F.when((F.col("whole") < cap) & (F.col("q") < F.coalesce("cut", F.lit(ONE))), 1).otherwise(0)
    )
    taken = materialise(taken.select("source", "target", "h", "w", "copies"))
    flips = _flips(taken, cap)
    discard(thin, dealt, need, sums, targets)
    placed = (
        seen.withColumn("g", F.col(f"{OWN}group"))
        .withColumn(f"{OWN}k", index)
        .drop("g")
        .join(bounded(plan.withColumnsRenamed({c: OWN + c for c in plan.columns})), F.col(source_col).eqNullSafe(F.col(f"{OWN}p_source")) & (F.col(f"{OWN}k") == F.col(f"{OWN}p_k")))
        .join(bounded(cuts.withColumnsRenamed({c: OWN + c for c in cuts.columns})), F.col(source_col).eqNullSafe(F.col(f"{OWN}c_source")), "left")
        .join(bounded(flips), F.col(source_col).eqNullSafe(F.col(f"{OWN}f_source")) & (F.col(f"{OWN}h") == F.col(f"{OWN}f_h")), "left")
    )
    whole, q = F.floor(f"{OWN}rate").cast("int"), _position(F.col(f"{OWN}rate"), F.col(f"{OWN}h"))
    extra = F.when((whole < cap) & (q < F.coalesce(f"{OWN}cut", F.lit(ONE))), 1).otherwise(0)
    return placed.withColumn(f"{OWN}copies", (whole + extra + F.coalesce(f"{OWN}f_d", F.lit(0))).cast("int")).select(
        *docs.columns, f"{OWN}size", f"{OWN}source_size", f"{OWN}target", f"{OWN}copies"
    )


def _flips(taken: DataFrame, cap: int) -> DataFrame:
    """(f_source, f_h, f_d): a few thin rows per source whose copies move by one, chosen to close its gap.

    Every round moves the row whose size is nearest to what is left, and there
    are rounds until no row brings any source nearer; gaps shrink in each.
    """
    flips = None
    while True:
        if flips is None:
            now = taken
        else:
            now = taken.join(bounded(flips), F.col("source").eqNullSafe(F.col(f"{OWN}f_source")) & (F.col("h") == F.col(f"{OWN}f_h")), "left").withColumn(
                "copies", F.col("copies") + F.coalesce(f"{OWN}f_d", F.lit(0))
            )
        gap = now.groupBy("source", "target").agg(F.sum(F.col("w") * F.col("copies")).alias("t"))
        gap = gap.select(F.col("source").alias("g_source"), (F.col("target") - F.col("t")).alias("gap")).filter(F.abs("gap") >= 1)
        j = now.join(gap, F.col("source").eqNullSafe(F.col("g_source")))
        sign = F.when(F.col("gap") > 0, 1).otherwise(-1)
        able = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        if flips is not None:
            able = able & F.col(f"{OWN}f_h").isNull()
        miss = F.abs(F.abs("gap") - F.col("w"))
        best = F.min(F.struct(miss.alias("m"), F.col("h").alias("at"), sign.alias("d"))).alias("f")
        more = j.filter(able & (F.col("w") > 0) & (miss < F.abs("gap"))).groupBy("g_source").agg(best)
        more = more.select(F.col("g_source").alias(f"{OWN}f_source"), F.col("f.at").alias(f"{OWN}f_h"), F.col("f.d").alias(f"{OWN}f_d"))
        more = materialise(more)
        if more.isEmpty():
            break
        flips = materialise(more if flips is None else flips.union(more))
    if flips is None:
        return taken.limit(0).select(F.col("source").alias(f"{OWN}f_source"), F.col("h").alias(f"{OWN}f_h"), F.lit(0).alias(f"{OWN}f_d"))
    return flips


def planned(docs: DataFrame, *, id_col: str = "doc_id", **params) -> DataFrame:
    """doc_id, size, source_size, target, copies of every row of ``docs`` under :func:`mix`."""
    m = mix(docs, id_col=id_col, **params)
    return m.select(F.col(id_col).alias("doc_id"), *[F.col(f"{OWN}{c}").alias(c) for c in ("size", "source_size", "target", "copies")])


def repeat(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with each row as often as the mix takes it."""
    m = mix(docs, **params).filter(F.col(f"{OWN}copies") > 0)
    return m.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), F.col(f"{OWN}copies")))).select(*docs.columns)


def op5_entropy_balancing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return planned(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
