"""Operator 12: a trie of conversation prefixes from mergeable partial tries.

Turns travel as 16 bytes of a digest and a length; texts are never shuffled.  A
node is known by the xor of the hashes of its turns, each taken with its place,
so prefixes of a conversation that spans partitions need one carry for each
partition, and no conversation has to fit into a task.

Partitions emit the node tables of their own rows, combined locally; keyed merges
of ``fan`` tables at a time sum members and join the lists of those who end there.
Figures of subtrees then roll up from the leaves: in round k every node hands its
sums to the ancestor 2**k levels above, which doubles the levels that are summed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, discard, materialise, ship

#: Turns of another conversation that a rebuilt one may begin with.
HEAD = 5


def _text(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def _digest(role: Column, text: Column) -> list[Column]:
    """k1, k2: 120 bits of a digest of a turn."""
    d = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return [F.conv(F.substring(d, 1 + 15 * j, 15), 16, 10).cast("long").alias(f"k{j + 1}") for j in (0, 1)]


def hashed_turns(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, k1, k2, size) of every row: digest of role and text, and the text's code points.

    Null roles and texts are empty ones.  Rows without a conv_id belong to no
    conversation and are left out.
    """
    rows = conversations.filter(F.col(id_col).isNotNull())
    key = _digest(_text(role_col), _text(text_col))
    return rows.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *key, F.length(_text(text_col)).cast("long").alias("size"))


def _sorted_parts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Range partitions by ``keys`` (the first is the conversation), sorted, with the number of the part."""
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return d.withColumn("part", F.spark_partition_id())


def _run_kernel(names: list[str], put):
    """A kernel for sorted partitions: ``put(column arrays, starts of conversations, carry)`` -> arrays by name.

    The carry is what ``put`` returned last for the conversation that a batch ended in.
    """

    def kernel(batches):
        import numpy as np
        import pyarrow as pa

        last, carry = None, None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in names}
            conv = cols[names[0]]
            new = np.empty(len(conv), bool)
            new[0], new[1:] = conv[0] != last, conv[1:] != conv[:-1]
            out, carry = put(cols, new, carry)
            last = conv[-1]
            yield pa.RecordBatch.from_arrays(b.columns + [pa.array(v) for v in out.values()], names=b.schema.names + list(out))

    return kernel


def _ranked(turns: DataFrame) -> DataFrame:
    """``turns`` with i, the place in its conversation from 1 on; written.

    By turn, nulls first, equal turns by their digest; repeated rows are turns of
    their own.
    """

    def put(cols, new, carry):
        import numpy as np

        n = np.arange(1, len(new) + 1)
        base = np.maximum.accumulate(np.where(new, n - 1, 0))
        rank = n - base
        if not new[0]:
            head = len(new) if not new.any() else int(np.argmax(new))
            rank[:head] += carry
        return {"i": rank}, int(rank[-1])

    d = _sorted_parts(turns, ["conv_id", "turn", "k1", "k2"])
    local = materialise(d.mapInArrow(_run_kernel(["conv_id"], put), _with(d, "i long")))
    ends = local.groupBy("part", "conv_id").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carry = bounded(materialise(_spanning(ends).select("part", "conv_id", F.coalesce(before, F.lit(0)).alias("before"))))
    ranked = local.join(carry, ["part", "conv_id"], "left").withColumn("i", F.col("i") + F.coalesce("before", F.lit(0)))
    return ranked.drop("before", "part")


def _with(df: DataFrame, more: str):
    from pyspark.sql import types as T

    return T.StructType(df.schema.fields + T.StructType.fromDDL(more).fields)


def _spanning(ends: DataFrame) -> DataFrame:
    """Rows of ``ends`` of conversations in more than one partition: at most two for each partition."""
    many = ends.groupBy("conv_id").agg(F.count("*").alias("p")).filter("p > 1").select("conv_id")
    return ends.join(bounded(materialise(many)), "conv_id")


def shared_heads(conv_id: Column) -> tuple[Column, Column]:
    """(donor, h): a conversation begins with the first h turns of its donor."""
    return conv_id - conv_id % 100, F.crc32(conv_id.cast("string").cast("binary")) % 6


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plan, rows): one row per conversation with its number of turns, one row per rebuilt turn.

    Rows are (conv_id, pos from 1 on, k1, k2, size, last).  A conversation takes
    the first h turns of its donor as that was before (all if there are fewer,
    none without a donor), then its own after its first h; it may end without any.
    """
    own = _ranked(turns)
    first = [F.max(F.when(F.col("i") == j, F.struct("k1", "k2", "size"))).alias(f"t{j}") for j in range(1, HEAD + 1)]
    convs = materialise(own.groupBy("conv_id").agg(F.count("*").alias("n"), *first))
    donor, h = shared_heads(F.col("conv_id"))
    donors = convs.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("donor"), F.filter(F.array(*[f"t{j}" for j in range(1, HEAD + 1)]), lambda t: t.isNotNull()).alias("head"))
    plan = convs.select("conv_id", "n", donor.alias("donor"), h.cast("int").alias("h")).join(donors, "donor", "left")
    plan = plan.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<k1:bigint,k2:bigint,size:bigint>>")), F.lit(1), F.col("h")))
    plan = plan.withColumn("length", F.size("head") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    plan = materialise(plan.select("conv_id", "h", "head", "length"))
    given = plan.select("conv_id", "length", F.posexplode("head").alias("p", "t")).select("conv_id", (F.col("p") + 1).cast("long").alias("pos"), "t.*", "length")
    kept = own.filter(F.col("i") > shared_heads(F.col("conv_id"))[1])
    kept = kept.join(plan.select("conv_id", "h", F.size("head").alias("g"), "length"), "conv_id")
    kept = kept.select("conv_id", (F.col("i") - F.col("h") + F.col("g")).alias("pos"), "k1", "k2", "size", "length")
    rows = given.unionByName(kept).select("conv_id", "pos", "k1", "k2", "size", (F.col("pos") == F.col("length")).alias("last"))
    return plan, rows


def _prefixed(rows: DataFrame) -> DataFrame:
    """Rows with n1, n2 (their node) and p1, p2 (its parent), the root being (0, 0); and their part."""
    here = rows.select("*", F.xxhash64("pos", "k1", "k2").alias("x1"), F.xxhash64("k2", "k1", "pos", F.lit("second")).alias("x2"))

    def put(cols, new, carry):
        import numpy as np

        out, left = {}, []
        for j in (1, 2):
            x = cols[f"x{j}"]
            s = np.bitwise_xor.accumulate(x)
            start = np.maximum.accumulate(np.where(new, np.arange(len(x)), -1))
            base = np.where(start > 0, s[start - 1], 0)  # xor of all before the conversation's first row
            if not new[0]:
                base = np.where(start < 0, carry[j - 1], base)
            out[f"n{j}"] = s ^ base
            left.append(out[f"n{j}"][-1])
        return out, left

    d = _sorted_parts(here, ["conv_id", "pos"])
    local = materialise(d.mapInArrow(_run_kernel(["conv_id", "x1", "x2"], put), _with(d, "n1 long, n2 long")))
    ends = local.groupBy("part", "conv_id").agg(F.bit_xor("x1").alias("e1"), F.bit_xor("x2").alias("e2"))
    w = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = _spanning(ends).select("part", "conv_id", *[F.coalesce(F.bit_xor(f"e{j}").over(w), F.lit(0)).alias(f"b{j}") for j in (1, 2)])
    j = local.join(bounded(materialise(carry)), ["part", "conv_id"], "left")
    node = {f"n{k}": F.col(f"n{k}").bitwiseXOR(F.coalesce(f"b{k}", F.lit(0))) for k in (1, 2)}
    return j.withColumns(node).withColumns({f"p{k}": F.col(f"n{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)})


PARTIAL = "part int, n1 long, n2 long, p1 long, p2 long, depth long, size long, conv_id long, n_convs long"


def partial_tries(rows: DataFrame) -> DataFrame:
    """The node tables of the partitions: members of a node are summed where its rows lie."""
    import pyarrow as pa

    names = [c.split()[0] for c in PARTIAL.split(", ")]
    kinds = [pa.int32()] + [pa.int64()] * 8

    def kernel(batches, most=200_000):
        from pyspark import TaskContext

        part, table = TaskContext.get().partitionId(), {}

        def flush():
            out = [(part, *k, *v) for k, v in table.items()]
            table.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

        for b in batches:
            for n1, n2, p1, p2, depth, size, conv in zip(*[b.column(c).to_pylist() for c in ("n1", "n2", "p1", "p2", "pos", "size", "conv_id")]):
                known = table.get((n1, n2))
                if known is None:
                    table[n1, n2] = [p1, p2, depth, size, conv, 1]
                else:
                    known[5] += 1
                    if conv < known[4]:
                        known[4] = conv
            if len(table) > most:
                yield flush()
        if table:
            yield flush()

    return rows.select("n1", "n2", "p1", "p2", "pos", "size", "conv_id").mapInArrow(kernel, PARTIAL)


def merge_tries(tables: DataFrame, parts: int, fan: int = 64) -> DataFrame:
    """One node table of ``parts`` partial ones: ``fan`` neighbours meet at a time, keyed by node.

    A node that every partition holds, as that of a common first turn, is thus
    one row of each of ``fan`` tables where it meets.
    """
    keys = ["n1", "n2", "p1", "p2", "depth", "size"]
    for _ in range(max(1, math.ceil(math.log(max(parts, 2), fan)))):
        tables = tables.withColumn("part", F.floor(F.col("part") / fan).cast("int"))
        tables = tables.groupBy("part", *keys).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    return tables.drop("part")


def _end_lists(ends: DataFrame, step: int = 50_000) -> DataFrame:
    """(n1, n2, ends_sha256) of nodes where conversations end.

    Conversations are sorted by node and id in range partitions, which write runs
    of decimal ids of up to ``step`` each; a digest then runs over a node's runs one
    after another.  A list is never held as a whole.
    """
    import pyarrow as pa

    RUN = "n1 long, n2 long, first long, ids binary"

    def runs(batches):
        node, held, first = None, [], None
        out = []

        def close():
            if held:
                out.append((*node, first, ",".join(map(str, held)).encode()))

        for b in batches:
            for n1, n2, c in zip(*[b.column(k).to_pylist() for k in ("n1", "n2", "conv_id")]):
                if (n1, n2) != node or len(held) >= step:
                    close()
                    node, held, first = (n1, n2), [], c
                held.append(c)
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.binary(),))], names=["n1", "n2", "first", "ids"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(),) * 3 + (pa.binary(),))], names=["n1", "n2", "first", "ids"])

    def digests(batches):
        import hashlib

        node, h, out = None, None, []
        for b in batches:
            for n1, n2, ids in zip(*[b.column(k).to_pylist() for k in ("n1", "n2", "ids")]):
                if (n1, n2) == node:
                    h.update(b",")
                else:
                    if h:
                        out.append((*node, h.hexdigest()))
                    node, h = (n1, n2), hashlib.sha256()
                h.update(ids)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["n1", "n2", "ends_sha256"])
                out.clear()
        if h:
            out.append((*node, h.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["n1", "n2", "ends_sha256"])

    tasks = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = ends.repartitionByRange(tasks, "n1", "n2", "conv_id").sortWithinPartitions("n1", "n2", "conv_id").mapInArrow(runs, RUN)
    d = d.repartition(tasks, "n1", "n2").sortWithinPartitions("n1", "n2", "first").select("n1", "n2", "ids")
    return d.mapInArrow(digests, "n1 long, n2 long, ends_sha256 string")


def roll_up(nodes: DataFrame, deepest: int, near=lambda d: d) -> DataFrame:
    """``nodes`` with n_children, n_leaves and saved_tokens of their subtrees.

    S(v, k) sums v's descendants less than 2**k levels below; S(v, k+1) adds the
    S(u, k) of all u exactly 2**k levels below.  Rounds grow with the logarithm of
    the deepest level.  ``near`` may hint joins with tables of at most as many rows
    as there are nodes.
    """
    up = nodes.select(F.col("p1").alias("n1"), F.col("p2").alias("n2")).filter("n1 is not null").groupBy("n1", "n2").agg(F.count("*").alias("n_children"))
    s = nodes.join(near(up), ["n1", "n2"], "left").select(
        "n1", "n2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
    )
    s = materialise(s)
    for k in range(max(0, deepest).bit_length()):
        below = s.filter("a1 is not null").groupBy("a1", "a2").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("t"))
        added = s.join(near(below.select(F.col("a1").alias("n1"), F.col("a2").alias("n2"), "l", "t")), ["n1", "n2"], "left")
        added = added.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("l", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("t", F.lit(0))}).drop("l", "t")
        if 2 ** (k + 1) <= deepest:
            higher = s.filter("a1 is not null").select(F.col("n1").alias("a1"), F.col("n2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
            added = added.join(near(higher), ["a1", "a2"], "left").withColumns({"a1": F.col("b1"), "a2": F.col("b2")}).drop("b1", "b2")
        last, s = s, materialise(added)
        discard(last)
    return s.drop("a1", "a2")


def prefix_trie(conversations: DataFrame, *, fan: int = 64, **columns) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Further columns name it: n1, n2 (the node) and p1, p2 (its parent).  The root
    is there if there is any conversation; an empty table gives no row.  Order,
    nulls and ties are those of :func:`hashed_turns` and :func:`_ranked`.
    """
    spark = conversations.sparkSession
    ship(spark)
    plan, rows = rebuilt(hashed_turns(conversations, **columns))
    rows = materialise(_prefixed(materialise(rows)).select("part", "conv_id", "pos", "size", "last", "n1", "n2", "p1", "p2"))
    parts = materialise(partial_tries(rows))
    nodes = merge_tries(parts, 1 + (parts.agg(F.max("part")).first()[0] or 0), fan)
    zero = F.lit(0).cast("long")
    root = plan.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    none = F.lit(None).cast("long")
    root = root.select(zero.alias("n1"), zero.alias("n2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), zero.alias("size"), "conv_id", "n_convs")
    nodes = materialise(nodes.unionByName(root))
    ends = rows.filter("last").select("n1", "n2", "conv_id").unionByName(plan.filter("length = 0").select(zero.alias("n1"), zero.alias("n2"), "conv_id"))
    # a parent of very many children is a hot key: small tables meet it without a shuffle, larger ones by the adaptive skew join
    size = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max("depth"), F.lit(0)).alias("deepest")).first()
    near = F.broadcast if size["n"] <= BROADCAST_ROWS else (lambda d: d)
    summed = roll_up(nodes, size["deepest"], near)
    above = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(near(above), ["p1", "p2"], "left").join(near(summed), ["n1", "n2"]).join(_end_lists(ends), ["n1", "n2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "n1", "n2", "p1", "p2",
    )


def node_turns(nodes: DataFrame, conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``nodes`` of :func:`prefix_trie` with role and text of their last turn (both null for the root).

    A node's last turn stands in its conversation or, within the shared head, in
    the donor; its text is met by that conversation, place and digest.
    """
    turns = hashed_turns(conversations, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    plan, _ = rebuilt(turns)
    given = F.col("depth") <= F.col("_g")
    n = nodes.join(plan.select("conv_id", F.size("head").alias("_g"), F.col("h").alias("_h")), "conv_id")
    at = {"_c": F.when(given, shared_heads(F.col("conv_id"))[0]).otherwise(F.col("conv_id")), "_i": F.when(given, F.col("depth")).otherwise(F.col("depth") - F.col("_g") + F.col("_h"))}
    place = _ranked(turns).select(F.col("conv_id").alias("_c"), F.col("i").alias("_i"), "k1", "k2")
    texts = conversations.select(F.col(id_col).cast("long").alias("_c"), *_digest(_text(role_col), _text(text_col)), _text(role_col).alias("role"), _text(text_col).alias("text"))
    found = place.join(texts.dropDuplicates(["_c", "k1", "k2"]), ["_c", "k1", "k2"]).drop("k1", "k2")
    return n.withColumns(at).drop("_g", "_h").join(found, ["_c", "_i"], "left").drop("_c", "_i")


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("n1", "n2", "p1", "p2")


#: CRC-32 bit by bit over the characters of a decimal number.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k::INT, 1))::BIGINT)),
       lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS donor, {_CRC} % 6 AS h, count(*) AS n FROM t GROUP BY conv_id),
d AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS g FROM c LEFT JOIN c o ON o.conv_id = c.donor),
r AS (SELECT d.conv_id, t.i AS pos, role, text FROM d JOIN t ON t.conv_id = d.donor AND t.i <= d.g
      UNION ALL SELECT d.conv_id, t.i - d.h + d.g, role, text FROM d JOIN t ON t.conv_id = d.conv_id AND t.i > d.h),
p AS (SELECT conv_id, pos, text, list({{'r': role, 't': text}}) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
      UNION ALL SELECT conv_id, 0, '', [] FROM d),
s AS (SELECT conv_id, max(pos) AS depth FROM p GROUP BY conv_id),
n AS (SELECT path, min(p.conv_id) AS conv_id, any_value(pos) AS depth, count(*) AS n_convs, any_value(length(text)) AS size,
             sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (WHERE pos = s.depth), '')) AS ends_sha256
      FROM p JOIN s ON p.conv_id = s.conv_id GROUP BY path),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON n.path = k.path),
u AS (SELECT path[:a] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth::BIGINT AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves::BIGINT AS n_leaves,
       u.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN u ON m.path = u.path LEFT JOIN m o ON m.depth > 0 AND o.path = m.path[:m.depth - 1]
"""
