"""Operator 9: near-duplicate vectors through navigable small-world graphs per shard.

Equal vectors of a label are first folded into one representative with a count.
The representatives of a label are dealt by hash into shards of at most about
``shard_size``; each shard gets a hierarchical small-world graph, kept as one
binary row.  The representatives are also dealt into query blocks, and every
shard meets all blocks of its label, a few of them in each task.  There

* a beam search over the graph finds candidates, widened for a query as long as
  its whole beam lies above the threshold, and
* an audit of queries against brute force, each with links weighing the same,
  widens the starting beam until its recall is reached (a beam as wide as the
  shard is an exact scan); where links are few, more queries are audited, up to all;
* cosines of candidates are verified in double precision.

A task emits per vector its number of links and the root of its local union, so
a group of m copies leaves rows in proportion to m; a distributed union of the
roots gives components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, connected, materialise, ship

LOW = -2.0  # below any cosine


def _unit(x):
    import numpy as np

    x = np.asarray(x, np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _spread(cand, sims, unit, keep):
    """Diverse neighbours: (rows, keep) of candidates sorted by descending sims.

    A candidate stays if it is nearer to the row's vector than to any neighbour
    already kept; free places are filled with the nearest of the others.
    """
    import numpy as np

    rows, width = cand.shape
    out = np.full((rows, keep), -1, np.int32)
    v = unit.astype(np.float32, copy=False)[np.maximum(cand, 0)]
    pair = np.matmul(v, v.transpose(0, 2, 1))
    valid = (cand >= 0) & (sims > LOW)
    near = np.full((rows, width), LOW)  # similarity to the nearest kept one
    kept = np.zeros((rows, width), bool)
    n = np.zeros(rows, int)
    for k in range(width):
        take = valid[:, k] & (sims[:, k] > near[:, k]) & (n < keep)
        kept[:, k] = take
        n += take
        near = np.where(take[:, None], np.maximum(near, pair[:, k, :]), near)
    order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)) * width + np.arange(width), axis=1)[:, :keep]
    chosen = np.take_along_axis(cand, order, 1)
    ok = np.take_along_axis(valid, order, 1)
    out[:, : chosen.shape[1]] = np.where(ok, chosen, -1)
    return out


class Graph:
    """A hierarchical small-world graph over the rows of ``unit`` (unit vectors)."""

    def __init__(self, unit, m: int = 16, seed: int = 7):
        import numpy as np

        self.unit, self.m = unit, m
        self.near = unit.astype(np.float32)  # for walking; verification uses unit
        n = len(unit)
        draw = np.random.default_rng(seed).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(int), 8)
        self.layers, self.members = [], []
        for k in range(int(self.level.max()) + 1 if n else 1):
            who = np.nonzero(self.level >= k)[0].astype(np.int32)
            self.members.append(who)
            self.layers.append(np.full((n, 2 * m if k == 0 else m), -1, np.int32))

    @classmethod
    def fit(cls, unit, m: int = 16, beam: int = 64, batch: int = 512):
        g = cls(unit, m)
        for k in range(len(g.layers) - 1, -1, -1):
            g._fit_layer(k, beam, batch)
        return g

    def _fit_layer(self, k, beam, batch):
        import numpy as np

        who, adj = self.members[k], self.layers[k]
        at = 0
        while at < len(who):
            size = min(batch, max(at, 64))
            new = who[at : at + size]
            q = self.unit[new]
            inner = q @ q.T
            np.fill_diagonal(inner, LOW)
            width = min(beam // 2, max(len(new) - 1, 1))
            top = np.argsort(-inner, axis=1)[:, :width]
            cand, sims = new[top], np.take_along_axis(inner, top, 1)
            if at:
                old, old_sims = self._beam(q, k, who[: min(at, 16)], beam)
                cand, sims = np.hstack([cand, old]), np.hstack([sims, old_sims])
                order = np.argsort(-sims, axis=1)[:, :beam]
                cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            cand = np.where(sims > LOW, cand, -1)
            picked = _spread(cand, sims, self.near, self.m)
            adj[new, : picked.shape[1]] = picked
            self._back(k, new, picked)
            at += size

    def _back(self, k, new, picked):
        """Reverse edges; a full list is thinned to diverse neighbours."""
        import numpy as np

        adj = self.layers[k]
        src = np.repeat(new, picked.shape[1])
        dst = picked.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = adj.shape[1]
        for lo in range(0, len(targets), 256):
            t, f, c = targets[lo : lo + 256], first[lo : lo + 256], count[lo : lo + 256]
            more = np.full((len(t), c.max()), -1, np.int32)
            for i, (a, b) in enumerate(zip(f, c)):
                more[i, :b] = src[a : a + b]
            cand = np.hstack([adj[t], more])
            cand.sort(axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
            sims = np.where(cand >= 0, np.einsum("rcd,rd->rc", self.near[np.maximum(cand, 0)], self.near[t]), LOW)
            order = np.argsort(-sims, axis=1)[:, : 3 * width]
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            adj[t] = _spread(cand, sims, self.near, width)

    def _beam(self, q, k, entry, beam):
        """Beam search of all queries in step over layer k: (ids, sims), descending, -1 where short."""
        import numpy as np

        adj, rows, n = self.layers[k], len(q), len(self.unit)
        q = q.astype(np.float32)
        seen = np.zeros((rows, n + 1), bool)
        seen[:, n] = True
        ids = np.full((rows, beam), n, np.int64)
        sims = np.full((rows, beam), LOW, np.float32)
        done = np.ones((rows, beam), bool)
        entry = np.broadcast_to(np.asarray(entry), (rows, np.shape(entry)[-1]))
        active = np.arange(rows)

        def merge(a, cand):
            cand = np.sort(np.where(cand < 0, n, cand), axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
            fresh = ~seen[a[:, None], cand]
            cand = np.where(fresh, cand, n)
            seen[a[:, None], cand] = True
            x, y = np.nonzero(cand < n)  # similarities of newly met nodes alone
            got = np.full(cand.shape, LOW, np.float32)
            got[x, y] = np.einsum("id,id->i", self.near[cand[x, y]], q[a[x]])
            all_ids, all_sims = np.hstack([ids[a], cand]), np.hstack([sims[a], got])
            all_done = np.hstack([done[a], cand == n])
            top = np.argsort(-all_sims, axis=1)[:, :beam]
            ids[a], sims[a] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
            done[a] = np.take_along_axis(all_done, top, 1)

        merge(active, entry.astype(np.int64))
        step = 4
        while len(active):
            open_ = ~done[active]
            live = open_.any(axis=1)
            active, open_ = active[live], open_[live]
            if not len(active):
                break
            pick = np.argsort(~open_, axis=1, kind="stable")[:, :step]
            is_open = np.take_along_axis(open_, pick, 1)
            node = np.where(is_open, np.take_along_axis(ids[active], pick, 1), n)
            done[active[:, None], pick] = True
            nb = np.where((node < n)[:, :, None], adj[np.minimum(node, n - 1)], -1).reshape(len(active), -1)
            merge(active, nb.astype(np.int64))
        return np.where(ids < n, ids, -1).astype(np.int32), sims

    def search(self, q, beam: int):
        """(ids, sims) of the beam at the bottom layer, entered through the upper layers."""
        import numpy as np

        n = len(self.unit)
        if beam >= n:
            sims = q @ self.unit.T
            return np.broadcast_to(np.arange(n, dtype=np.int32), sims.shape), sims
        entry = np.broadcast_to(self.members[-1][:8], (len(q), len(self.members[-1][:8])))
        for k in range(len(self.layers) - 1, 0, -1):
            entry, _ = self._beam(q, k, entry, 8)
        return self._beam(q, 0, entry, beam)

    def dump(self) -> bytes:
        import io

        import numpy as np

        out = io.BytesIO()
        np.savez(out, level=self.level, m=self.m, **{f"a{k}": a[self.members[k]] for k, a in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, blob: bytes, unit):
        import io

        import numpy as np

        z = np.load(io.BytesIO(blob), allow_pickle=False)
        g = cls(unit, int(z["m"]))
        g.level = z["level"]
        g.members, g.layers = [], []
        for k in range(sum(x.startswith("a") for x in z.files)):
            who = np.nonzero(g.level >= k)[0].astype(np.int32)
            full = np.full((len(unit), z[f"a{k}"].shape[1]), -1, np.int32)
            full[who] = z[f"a{k}"]
            g.members.append(who)
            g.layers.append(full)
        return g


def linked_pairs(graph: Graph, q, threshold: float, beam: int, audit: int, recall: float, chunk: int = 512, own=None, enough: int = 16):
    """(query row, graph row) arrays of all found pairs with cosine >= threshold, and the beam used.

    Queries are drawn, ``audit`` at first, and compared with the whole shard until
    ``enough`` of them have links that fit the beam; ``own`` has the graph row of
    each query itself (-1: not there), which is no link.  The start beam doubles
    until the mean recall of these queries, each weighing the same, is
    ``recall``, and that of all drawn queries with links too: hot queries widen
    by themselves and tell nothing of the others.  Where all queries had to be
    drawn, their pairs are known and no beam is needed.
    """
    import numpy as np

    n = len(graph.unit)
    margin = threshold - 1e-5  # single-precision walking

    def find(rows, width):
        """Widens by query while the whole beam is above the threshold."""
        found, todo = [], rows
        while len(todo):
            again = []
            for lo in range(0, len(todo), chunk):
                part = todo[lo : lo + chunk]
                ids, sims = graph.search(q[part], width)
                full = (sims >= margin).all(axis=1) if width < n else np.zeros(len(part), bool)
                a, b = np.nonzero((sims >= margin) & ~full[:, None] & (ids >= 0))
                found.append(np.stack([part[a], ids[a, b]]))
                again.append(part[full])
            todo, width = np.concatenate(again), width * 2 if width * 64 < n else n
        return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)

    own = np.full(len(q), -1) if own is None else own
    order = np.random.default_rng(len(q)).permutation(len(q))
    drawn, links = 0, []  # links: (query row, graph row) of the drawn queries
    count = np.zeros(len(q), int)
    while beam < n and drawn < len(q) and (not drawn or ((count > 0) & (count < beam)).sum() < enough):
        more = order[drawn : max(2 * drawn, audit)]
        drawn += len(more)
        for lo in range(0, len(more), chunk):
            part = more[lo : lo + chunk]
            a, b = np.nonzero(q[part] @ graph.unit.T >= threshold)
            links.append(np.stack([part[a], b]))
            count[part] = np.bincount(a[b != own[part[a]]], minlength=len(part))
    if links and drawn == len(q):
        a, b = np.concatenate(links, axis=1)
        return a, b, n
    sample = np.sort(order[:drawn])
    sample = sample[count[sample] > 0]
    narrow = count[sample] < beam
    truth = q[sample] @ graph.unit.T >= threshold
    inside = own[sample] >= 0
    truth[np.nonzero(inside)[0], own[sample][inside]] = False
    while beam < n:
        a, b = find(sample, beam)
        hit = np.zeros_like(truth)
        hit[np.searchsorted(sample, a), b] = True
        got = (hit & truth).sum(axis=1) / count[sample]
        if got.mean() >= recall and got[narrow].mean() >= recall:
            break
        beam *= 2
    a, b = find(np.arange(len(q)), min(beam, n))
    # double precision decides
    out_a, out_b = [], []
    for lo in range(0, len(a), 100_000):
        x, y = a[lo : lo + 100_000], b[lo : lo + 100_000]
        ok = np.einsum("id,id->i", q[x], graph.unit[y]) >= threshold
        out_a.append(x[ok])
        out_b.append(y[ok])
    return np.concatenate(out_a or [a]), np.concatenate(out_b or [b]), beam


def near_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.93,
    shard_size: int = 8192,
    block_size: int = 1024,
    group: int = 8,
    beam: int = 32,
    audit: int = 64,
    recall: float = 0.99,
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Vectors are compared with vectors of their label and length alone.  A null
    label or vector, a null or non-finite component, a zero vector and a null
    id link with nothing (a null id is its own null component).  Rows with equal
    ids are vectors of their own and share the id's smallest component.
    """
    import numpy as np
    import pyarrow as pa

    ship(vectors.sparkSession)
    e = F.col("e")
    fine = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & e.isNotNull()
        & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(e, lambda x: x != 0)
    )
    all_rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("e")
    ).withColumn("fine", F.coalesce(fine, F.lit(False)))
    all_rows = all_rows.withColumns(
        {"k1": F.when(F.col("fine"), F.xxhash64("label", "e")), "k2": F.when(F.col("fine"), F.xxhash64(F.lit(7), "label", "e"))}
    )
    members = materialise(all_rows.drop("e"))
    ids_of = members.filter("fine").groupBy("label", "k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    one = all_rows.filter("fine").groupBy("k1", "k2").agg(F.any_value("e").alias("e"))
    reps = materialise(
        ids_of.join(one, ["k1", "k2"]).select(F.concat_ws("/", F.col("label").cast("string"), F.size("e")).alias("label"), "rep", "copies", "e")
    )
    sizes = reps.groupBy("label").agg(F.count("*").alias("n"))
    dealt = reps.join(sizes, "label").withColumns(
        {
            "shard": F.pmod(F.xxhash64("rep"), F.ceil(F.col("n") / shard_size)).cast("int"),
            "block": F.pmod(F.xxhash64(F.lit(3), "rep"), F.ceil(F.col("n") / block_size)).cast("int"),
        }
    )

    def bytes_of(t, name):
        x = t.column("e").combine_chunks()
        return {
            "label": t.column("label")[0].as_py(),
            name: t.column(name)[0].as_py(),
            "ids": np.asarray(t.column("rep"), np.int64).tobytes(),
            "copies": np.asarray(t.column("copies"), np.int64).tobytes(),
            "vectors": np.asarray(x.flatten(), np.float64).tobytes(),
        }

    def table(row, name):
        kinds = [("label", pa.string()), (name, pa.int32()), *[(x, pa.binary()) for x in row if x not in ("label", name)]]
        return pa.Table.from_pylist([row], schema=pa.schema(kinds))

    def to_block(t: pa.Table) -> pa.Table:
        return table(bytes_of(t, "block"), "block")

    def to_shard(t: pa.Table) -> pa.Table:
        r = bytes_of(t, "shard")
        x = _unit(np.frombuffer(r["vectors"]).reshape(t.num_rows, -1))
        return table(r | {"graph": Graph.fit(x).dump()}, "shard")

    body = "ids binary, copies binary, vectors binary"
    shards = materialise(dealt.groupBy("label", "shard").applyInArrow(to_shard, f"label string, shard int, {body}, graph binary"))
    blocks = materialise(dealt.groupBy("label", "block").applyInArrow(to_block, f"label string, block int, {body}"))
    # a task is a shard and a group of blocks of its label, each block a row of its own
    shape = sizes.select("label", F.ceil(F.col("n") / shard_size).cast("int").alias("_s"), F.ceil(F.ceil(F.col("n") / block_size) / group).cast("int").alias("_g"))
    shape = bounded(materialise(shape))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt_shards = shards.join(shape, "label").withColumn("_group", each("_g")).drop("_s", "_g").withColumn("block", F.lit(-1))
    dealt_blocks = blocks.join(shape, "label").withColumn("_group", F.pmod("block", F.col("_g"))).withColumn("shard", each("_s")).drop("_s", "_g")
    tasks = dealt_shards.unionByName(dealt_blocks.withColumn("graph", F.lit(None).cast("binary")))

    def search(t: pa.Table) -> pa.Table:
        get = lambda i, c: t.column(c)[i].as_py()
        at_shard = int(np.nonzero(np.asarray(t.column("block")) < 0)[0][0])
        ids, copies = (np.frombuffer(get(at_shard, c), np.int64) for c in ("ids", "copies"))
        graph = Graph.load(get(at_shard, "graph"), _unit(np.frombuffer(get(at_shard, "vectors")).reshape(len(ids), -1)))
        at = np.argsort(ids)
        out = []
        for i in range(t.num_rows):
            if i == at_shard:
                continue
            q_ids = np.frombuffer(get(i, "ids"), np.int64)
            q = _unit(np.frombuffer(get(i, "vectors")).reshape(len(q_ids), -1))
            own = at[np.minimum(np.searchsorted(ids, q_ids, sorter=at), len(ids) - 1)]
            own = np.where(ids[own] == q_ids, own, -1)
            a, b, _ = linked_pairs(graph, q, threshold, beam, audit, recall, own=own)
            other = q_ids[a] != ids[b]
            a, b = a[other], b[other]
            links = np.bincount(a, weights=copies[b], minlength=len(q_ids)).astype(np.int64)
            nodes, inv = np.unique(np.concatenate([q_ids, ids]), return_inverse=True)
            x, y = inv[a], inv[len(q_ids) + b]
            root = np.arange(len(nodes))
            while True:  # local union by smallest neighbour and pointer jumping
                was = root.copy()
                np.minimum.at(root, x, was[y])
                np.minimum.at(root, y, was[x])
                root = root[root]
                if (root == was).all():
                    break
            edge = np.nonzero(root != np.arange(len(nodes)))[0]
            out.append(
                (
                    np.concatenate([q_ids, nodes[edge]]),
                    np.concatenate([links, np.zeros(len(edge), np.int64)]),
                    np.concatenate([q_ids, nodes[root[edge]]]),
                )
            )
        columns = [np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3)]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["node", "links", "root"])

    found = materialise(tasks.groupBy("label", "shard", "_group").applyInArrow(search, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected(found.filter("node <> root"), "node", "root").withColumnRenamed("node", "c_node")
    per_rep = (
        ids_of.join(links, ids_of["rep"] == links["node"], "left")
        .join(parts, F.col("rep") == F.col("c_node"), "left")
        .select(
            "k1",
            "k2",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return members.join(per_rep, ["k1", "k2"], "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )


def op9_hnsw_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
