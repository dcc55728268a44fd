"""Operator 6: n-gram Jaccard join through R-trees over group counts.

Documents are sets of hashed five-word shingles.  Equal sets are one node.
Blocks bring possible partners together without loss: a pair of similarity 0.8
shares one of the first ``n - ceil(0.8 n) + 1`` shingles of either set in any
common order, here hash order with frequent shingles last.  The shingles of each
set are counted by hash group, and the counts are points; summed coordinate
minima bound the overlap of two sets.  Each block's smallest and largest node
are compared with its other members first; blocks that this leaves in several
parts get an R-tree, where a subtree is left out if its upper corner cannot
reach the needed overlap.  Pairs that stay connect nodes into candidate
components; there an R-tree over the whole component proposes pairs and exact
set intersections verify them.  Pairs already connected need no verification, so
a group of m copies costs about m of them.

Blocks and components above ``cap`` rows are cut into chunks that meet pair by
pair, so no task holds an unbounded group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import OWN, bounded, connected, discard, materialise, ship

#: Groups of a set of n shingles: the power of two below n / 3 within these bounds, so that
#: a group holds 3 to 6 shingles and unrelated sets of any size stay below the bound.
FEWEST, MOST = 16, 1 << 16

#: Shingle hashes fall into 2**BITS buckets (by their high bits) whose frequency orders prefixes.
BITS = 22

SIGNED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("node", T.LongType()),
        T.StructField("counts", T.BinaryType()),
        T.StructField("sigs", T.ArrayType(T.LongType())),
    ]
)

_hashes: dict[bytes, int] = {}


def raw_shingles(text: bytes | None, words: int = 5):
    """64-bit hashes of a text's shingles in order, repeats included (uint64)."""
    import numpy as np
    import xxhash

    w = (text or b"").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(_hashes) > 300_000:
        _hashes.clear()
    h, known, digest = np.empty(len(w), np.uint64), _hashes, xxhash.xxh64_intdigest
    try:
        h[:] = [known[x] for x in w]
    except KeyError:
        for x in set(w):
            if x not in known:
                known[x] = digest(x)
        h[:] = [known[x] for x in w]
    if len(h) < words:
        return np.array([digest(h.tobytes(), seed=len(h))], np.uint64)
    odd = np.uint64(0x9E3779B97F4A7C15)
    s = h[: len(h) - words + 1].copy()
    for k in range(1, words):
        s *= odd
        s += h[k : len(h) - words + 1 + k]
    s ^= s >> np.uint64(32)
    s *= np.uint64(0xD6E8FEB86659FD93)
    s ^= s >> np.uint64(29)
    return s


def shingles(text: bytes | None):
    """Sorted distinct hashes of a text's shingles."""
    import numpy as np

    s = raw_shingles(text)
    s.sort()
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def group_counts(s):
    """Shingles per hash group (by the low bits; the order uses the high ones)."""
    import numpy as np

    groups = FEWEST
    while groups < MOST and groups * 6 <= len(s):
        groups *= 2
    return np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint32)


def pack_counts(c) -> bytes:
    import numpy as np

    return b"\1" + c.astype(np.uint8).tobytes() if c.max(initial=0) < 256 else b"\4" + c.tobytes()


def unpack_counts(b: bytes):
    import numpy as np

    return np.frombuffer(b, np.uint8 if b[:1] == b"\1" else np.uint32, offset=1)


def plausible(points: list, sizes):
    """(x, y) index arrays of the pairs of sets that the count bound leaves.

    One tree for each number of groups.  Sets of 0.8 similarity have sizes
    within a quarter, so their groups are as many or twice as many; the latter
    fold by adding halves.
    """
    import numpy as np

    groups = np.array([len(c) for c in points])
    left, right = [], []
    for g in np.unique(groups).tolist():
        here, next_ = np.nonzero(groups == g)[0], np.nonzero(groups == 2 * g)[0]
        c = np.stack([points[i] for i in here]).astype(np.int32)
        tree = CountTree(c, sizes[here])
        x, y = tree.pairs(c, sizes[here])
        left.append(here[x])
        right.append(here[y])
        if len(next_):
            folded = np.stack([points[i].astype(np.int32).reshape(2, g).sum(axis=0) for i in next_])
            x, y = tree.pairs(folded, sizes[next_])
            left += [next_[x], here[y]]
            right += [here[y], next_[x]]
    return np.concatenate(left), np.concatenate(right)


class CountTree:
    """R-tree over count vectors, bulk-loaded by halving the widest coordinate."""

    def __init__(self, counts, sizes, leaf: int = 16):
        import numpy as np

        self.counts, self.sizes = counts.astype(np.int32), sizes.astype(np.int64)
        self.nodes = []  # (rows or None, upper corner, smallest size, largest size, children)
        self.leaf = leaf
        if len(sizes):
            self._build(np.arange(len(sizes)))

    def _build(self, rows) -> int:
        import numpy as np

        c, at = self.counts[rows], len(self.nodes)
        self.nodes.append(None)
        n = self.sizes[rows]
        kids = ()
        if len(rows) > self.leaf:
            spread = c.max(axis=0) - c.min(axis=0)
            key = n if 4 * n.max() > 5 * n.min() else c[:, int(spread.argmax())]
            order = np.argsort(key, kind="stable")
            half = len(rows) // 2
            kids = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        self.nodes[at] = (None if kids else rows, c.max(axis=0), int(n.min()), int(n.max()), kids)
        return at

    def pairs(self, counts, sizes):
        """(query, row) index arrays of all pairs whose bound allows similarity 0.8."""
        import numpy as np

        counts, sizes = counts.astype(np.int32), sizes.astype(np.int64)
        left, right = [], []
        stack = [(0, np.arange(len(sizes)))] if self.nodes else []
        while stack:
            at, q = stack.pop()
            rows, top, low, high, kids = self.nodes[at]
            n = sizes[q]
            q = q[(5 * high >= 4 * n) & (4 * low <= 5 * n)]
            if not len(q):
                continue
            if kids:
                n = sizes[q]
                most = np.minimum(counts[q], top).sum(axis=1)
                q = q[9 * most >= 4 * (n + np.maximum(low, -(-4 * n // 5)))]
                if len(q):
                    stack += [(k, q) for k in kids]
                continue
            step = max(1, 4_000_000 // (len(rows) * counts.shape[1]))
            for i in range(0, len(q), step):
                p = q[i : i + step]
                most = np.minimum(counts[p][:, None, :], self.counts[rows][None, :, :]).sum(axis=2)
                a, b = sizes[p][:, None], self.sizes[rows][None, :]
                x, y = np.nonzero((9 * most >= 4 * (a + b)) & (5 * b >= 4 * a) & (5 * a >= 4 * b))
                left.append(p[x])
                right.append(rows[y])
        if not left:
            return np.zeros(0, int), np.zeros(0, int)
        return np.concatenate(left), np.concatenate(right)


def similar(a, b) -> bool:
    """100 * intersection >= 80 * union, of two sorted distinct arrays."""
    import numpy as np

    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def _roots(n, x, y):
    """Smallest reachable index for each of n nodes under links x-y."""
    import numpy as np

    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, x, was[y])
        np.minimum.at(root, y, was[x])
        root = root[root]
        if (root == was).all():
            return root


def plausible_pair(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether two sets of n and m shingles with these packed counts can be similar."""
    import numpy as np

    if 5 * n < 4 * m or 5 * m < 4 * n:
        return False
    x, y = unpack_counts(a).astype(np.int32), unpack_counts(b).astype(np.int32)
    if len(x) > len(y):
        x, y = y, x
    if len(y) == 2 * len(x):
        y = y.reshape(2, len(x)).sum(axis=0)
    return 9 * int(np.minimum(x, y).sum()) >= 4 * (n + m)


def _sign(docs: DataFrame, rarity) -> DataFrame:
    """Per document its set's size, key, group counts and prefix shingles.

    Counts and prefix are null where the task has just met the same set.
    """
    import pyarrow as pa

    def rows(batches):
        import numpy as np
        import xxhash

        order = np.frombuffer(rarity.value, np.uint8)
        by_text, met = {}, set()
        for batch in batches:
            out, size, at = {f: [] for f in SIGNED.names[2:]}, 0, 0
            for i, text in enumerate(batch.column(2)):
                text = text.as_py() or b""
                name = xxhash.xxh3_128_digest(text)
                known = by_text.get(name)
                counts = prefix = None
                if known is None:
                    s = shingles(text)
                    key = int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "little", signed=True)
                    known = (len(s), key)
                    if len(by_text) >= 50_000:
                        by_text.clear()
                        met.clear()
                    by_text[name] = known
                    if len(s) and key not in met:
                        met.add(key)
                        take = len(s) - -(-4 * len(s) // 5) + 1
                        late = order[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                        if late.any():
                            s_ordered = s[np.argsort(late, kind="stable")[:take]]
                        else:
                            s_ordered = s[:take]
                        counts, prefix = pack_counts(group_counts(s)), s_ordered.view(np.int64)
                        size += take
                out["n"].append(known[0])
                out["node"].append(known[1])
                out["counts"].append(counts)
                out["sigs"].append(prefix)
                if size > 200_000 or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(at, i + 1 - at),
                            batch.column(1).slice(at, i + 1 - at),
                            *[pa.array(out[f], pa.int64()) for f in ("n", "node")],
                            pa.array(out["counts"], pa.binary()),
                            pa.array(out["sigs"], pa.list_(pa.int64())),
                        ],
                        names=SIGNED.names,
                    )
                    out, size, at = {f: [] for f in SIGNED.names[2:]}, 0, i + 1

    return docs.mapInArrow(rows, SIGNED)


def shingle_rarity(docs: DataFrame, *, chunk: int = 2_000_000, least: int = 10) -> bytes:
    """A class of 0 (rare) to 255 for each of the 2**BITS buckets of shingle hashes, one byte each.

    Every shingle of every document is counted, in chunks of a task; a bucket
    adds its counts of chunks that hold it clearly more often than their mean.
    The classes only set an order that all documents share: whatever they say,
    no pair is lost.
    """
    import numpy as np
    import pyarrow as pa

    def rows(batches):
        held, size = [], 0

        def close():
            c = np.bincount(np.concatenate(held), minlength=1 << BITS)
            often = np.nonzero(c >= least + 4 * size // len(c))[0]
            return pa.RecordBatch.from_arrays([pa.array(often.astype(np.int32)), pa.array(c[often])], names=["bucket", "n"])

        for batch in batches:
            for text in batch.column(2):
                held.append((raw_shingles(text.as_py()) >> np.uint64(64 - BITS)).astype(np.int32))
                size += len(held[-1])
                if size > chunk:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    got = docs.mapInArrow(rows, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    order = np.zeros(1 << BITS, np.uint8)
    if got.num_rows:
        order[np.asarray(got.column("bucket"))] = 1 + np.log2(np.asarray(got.column("n"))).astype(np.uint8)
    return order.tobytes()


def _tasks(rows: DataFrame, key: str, size: DataFrame, node: str) -> DataFrame:
    """Deal ``rows`` of each ``key`` to tasks of bounded size: adds _k, _c, _i and _j.

    ``size`` has the number of chunks (_k) of each key.  Keys of one chunk share
    bins.  Of a larger key each pair of chunks is a task.
    """
    j = rows.join(size, key)
    j = j.withColumn("_c", F.pmod(F.xxhash64(F.lit(5), node), F.col("_k")).cast("int"))
    # chunk c meets every chunk; the pair (i, j), i <= j, is one task
    other = F.explode(F.when(F.col("_k") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_k") - 1)))
    return j.select("*", other.alias("_o")).withColumns({"_i": F.least("_c", "_o"), "_j": F.greatest("_c", "_o")}).drop("_o")


def _binned(tasks: DataFrame, key: str, bins: int) -> DataFrame:
    own = F.xxhash64(key, "_i", "_j")
    return tasks.withColumn("_bin", F.when(F.col("_k") == 1, F.pmod(F.xxhash64(key), F.lit(bins))).otherwise(own))


def _groups(t, key: str):
    """Row index arrays of each (key, _i, _j) of an Arrow table."""
    import numpy as np

    keys = np.stack([np.asarray(t.column(x)).astype(np.int64) for x in (key, "_i", "_j")])
    order = np.lexsort(keys)
    cuts = np.nonzero((np.diff(keys[:, order], axis=1) != 0).any(axis=0))[0] + 1
    return [g for g in np.split(order, cuts) if len(g) > 1]


def _star_edges(pairs: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, n, m, x, y) whose counts x and y allow similarity."""
    import pyarrow as pa

    def rows(batches):
        for t in batches:
            n, m, x, y = (t.column(c) for c in ("n", "m", "x", "y"))
            ok = [plausible_pair(x[i].as_py(), y[i].as_py(), n[i].as_py(), m[i].as_py()) for i in range(t.num_rows)]
            yield t.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return pairs.mapInArrow(rows, "a long, b long")


def _edges_of_blocks(tasks: DataFrame, bins: int) -> DataFrame:
    """(a, b) spanning edges of the pairs that the group-count bound leaves, for each block.

    Rows of equal ``part`` are connected already.
    """
    import pyarrow as pa

    def work(t: pa.Table) -> pa.Table:
        import numpy as np

        node, part, n, c = np.asarray(t.column("node")), np.asarray(t.column("part")), np.asarray(t.column("n")), t.column("counts")
        out_a, out_b = [], []
        for rows_ in _groups(t, "key"):
            rows_ = rows_[np.argsort(node[rows_], kind="stable")]
            if (part[rows_] == part[rows_[0]]).all():
                continue
            x, y = plausible([unpack_counts(c[int(i)].as_py()) for i in rows_], n[rows_])
            cross = part[rows_[x]] != part[rows_[y]]
            root = _roots(len(rows_), x[cross], y[cross])
            hang = np.nonzero(root != np.arange(len(rows_)))[0]
            out_a.append(node[rows_[hang]])
            out_b.append(node[rows_[root[hang]]])
        e = np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate([e, *out_a]), np.concatenate([e, *out_b])]), axis=1)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return _binned(tasks, "key", bins).groupBy("_bin").applyInArrow(work, "a long, b long")


def _verified(tasks: DataFrame, bins: int) -> DataFrame:
    """(a, b) links, spanning, from (component, node, text) tasks; every link has been verified."""
    import pyarrow as pa

    def work(t: pa.Table) -> pa.Table:
        import numpy as np

        node, texts = np.asarray(t.column("node")), t.column("text")
        out = []
        for rows_ in _groups(t, "component"):
            sets = [shingles(texts[int(i)].as_py()) for i in rows_]
            x, y = plausible([group_counts(s) for s in sets], np.array([len(s) for s in sets]))
            keep = x < y
            x, y = x[keep], y[keep]
            order_ = np.lexsort([y, x])
            root = list(range(len(rows_)))

            def find(i):
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            for i, j in zip(x[order_].tolist(), y[order_].tolist()):
                a, b = find(i), find(j)
                if a != b and similar(sets[i], sets[j]):
                    root[max(a, b)] = min(a, b)
                    out.append((int(node[rows_[i]]), int(node[rows_[j]])))
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return _binned(tasks, "component", bins).groupBy("_bin").applyInArrow(work, "a long, b long")


def _candidates(signed: DataFrame, cap: int) -> DataFrame:
    """(node, component, n): components of the pairs that share a prefix shingle and pass the count bound.

    Each block's smallest and largest set are compared with all its members
    first, each pair once over all blocks.  What that connects needs no further
    comparison, and blocks of up to three sets are done; the others go to R-trees.
    """
    points = signed.filter(F.col("counts").isNotNull())
    prefixes = points.select("node", F.explode("sigs").alias("key"))
    live = materialise(prefixes.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"))
    joined = materialise(prefixes.join(live, "key"))
    blocks = materialise(joined.distinct())  # exact copies met in several tasks
    discard(live, joined)
    stars = blocks.select(F.explode(F.array("lo", "hi")).alias("a"), F.col("node").alias("b")).filter("a <> b")
    stars = materialise(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    nodes = blocks.select("node").distinct()
    points = materialise(points.select("node", "n", "counts").join(nodes, "node", "left_semi").dropDuplicates(["node"]))
    pairs = stars.join(points.select(F.col("node").alias("a"), "n", F.col("counts").alias("x")), "a")
    pairs = pairs.join(points.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("counts").alias("y")), "b")
    near = materialise(_star_edges(pairs.select("a", "b", "n", "m", "x", "y")))
    first = materialise(connected(near).distinct())
    placed = blocks.join(first.select("node", F.col("component")), "node", "left").select(
        "key", "node", F.coalesce("component", "node").alias("part")
    )
    placed = materialise(placed)
    open_ = (
        placed.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("node").alias("low"), F.min("part").alias("p"), F.max("part").alias("q"), F.bit_xor(F.xxhash64("node")).alias("x"))
        .filter("n > 3 and p < q")
        .groupBy("low", "x", "n")  # blocks of the same sets are one block
        .agg(F.min("key").alias("key"))
    )
    open_ = materialise(open_.select("key", F.ceil(F.col("n") / cap).cast("int").alias("_k")))
    tasks = materialise(_tasks(placed, "key", open_, "node"))
    more = materialise(_edges_of_blocks(tasks.join(points, "node"), max(16, tasks.count() // 4000)))
    coarse = connected(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    out = materialise(coarse.distinct().join(points.select("node", "n"), "node"))
    discard(blocks, stars, points, near, first, placed, open_, tasks, more)
    return out


def _labelled(docs: DataFrame, id_col: str, text_col: str, cap: int, cap_shingles: int) -> DataFrame:
    """What :func:`components` returns, with the component's own label (null: linked with nothing, ever)."""
    spark = docs.sparkSession
    ship(spark)
    t = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"),
        F.col(text_col).cast("string").cast("binary").alias("text"),
    )
    rarity = spark.sparkContext.broadcast(shingle_rarity(t))
    signed = _sign(t, rarity).withColumn("node", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("node")))
    signed = materialise(signed.withColumns({c: F.when(F.col("node").isNotNull(), F.col(c)) for c in ("counts", "sigs")}), codec="none")
    coarse = _candidates(signed, cap)
    # one row of each candidate set holds the text that is verified
    members = signed.filter("node is not null").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    reps = materialise(members.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "times")).alias("r")).select("node", "r.*"))
    chosen = materialise(coarse.join(reps, "node").select("node", "component", "doc_id", "text_hash", "times"))
    held = t.join(bounded(chosen.drop("times")), ["doc_id", "text_hash"]).select("component", "node", "text")
    if not chosen.filter("times > 1").isEmpty():  # rows that repeat id and text
        held = held.dropDuplicates(["node"])
    of_part = coarse.groupBy("component").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    sizes = materialise(of_part.select("component", F.ceil(F.greatest(F.col("rows") / cap, F.col("shingles") / cap_shingles)).cast("int").alias("_k")))
    n = coarse.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()
    tasks = _tasks(held, "component", bounded(sizes), "node")
    links = materialise(_verified(tasks, max(16, n["rows"] // 500, n["shingles"] // 250_000)))
    found = materialise(connected(links).distinct())
    smallest = found.join(reps, "node").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    per_node = materialise(
        reps.join(found.join(smallest, "component"), "node", "left").select(
            "node", F.coalesce("smallest", "doc_id").alias("component_id"), F.coalesce("component", "node").alias("label")
        )
    )
    discard(coarse, reps, chosen, sizes, links, found)
    return signed.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node").join(per_node, "node", "left").select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "label"
    )


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cap: int = 1000, cap_shingles: int = 1_000_000) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id for every row.

    Texts without words (null, empty, blank) have no shingles and are linked
    with nothing.  Rows that repeat an id are documents of their own, and each
    row's component_id is the smallest id that its links reach; equal rows stay.
    A null id is linked with nothing and has a null component.  Sets, like
    shingles, are told apart by 64 bits.  ``cap`` rows or ``cap_shingles``
    shingles (8 bytes each) fill a chunk; a longer text is one.
    """
    return _labelled(docs, id_col, text_col, cap, cap_shingles).drop("label")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", cap: int = 1000, cap_shingles: int = 1_000_000) -> DataFrame:
    """``docs`` with one row of each component, its smallest id (then text hash); all columns stay.

    Rows without words or without an id stay, all of them.  Of rows that repeat
    both the kept id and its text one stays; unlinked texts of one id all stay.
    """
    c = materialise(_labelled(docs, id_col, text_col, cap, cap_shingles))
    members = c.filter("label is not null").groupBy("label", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    first = members.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    own = {"doc_id": f"{OWN}id", "text_hash": f"{OWN}hash"}
    marked = members.join(first, "label").withColumn("stays", F.struct("doc_id", "text_hash") == F.col("first"))
    marked = materialise(marked.filter("not stays or times > 1").select("doc_id", "text_hash", "stays").withColumnsRenamed(own))
    same = (F.col(id_col) == F.col(f"{OWN}id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(f"{OWN}hash"))
    kept = docs.join(bounded(materialise(marked.filter("not stays").drop("stays"))), same, "left_anti")
    again = marked.filter("stays").drop("stays")
    if again.isEmpty():
        return kept
    again = bounded(materialise(again))
    return kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, text_col]))


def op6_rtree_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return components(docs).select("doc_id", "n_shingles", "component_id")
