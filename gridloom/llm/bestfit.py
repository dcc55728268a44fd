"""Operator 13: best-fit packing by bin completion.

What decides a packing is how many pieces there are of each length, and a length
is at most the size of a sequence.  So the search runs over this histogram (at
most ``size`` rows, whatever the corpus), and a step of it settles every sequence
that is filled alike.  Spark does the rest on all rows: encoding, ranks of pieces
among those of their length by prefix sums over partitions, and places by looking
up a rank in the slots that the search laid out.

The search is bin completion: take the longest open length, enumerate the
undominated fillings of what is left of its sequence, best fit first, and branch
on them.  The incumbent is best-fit decreasing at first; a branch ends when its
waste exceeds what an improvement could afford, and the search when it meets the
lower bound or has visited ``nodes`` nodes.  A packing is complete at any time.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialise, ship
from .tokens import default_path, encoder

ENCODED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("pieces", T.IntegerType()),
        T.StructField("tail", T.IntegerType()),
        T.StructField("tail_rank", T.LongType()),
        T.StructField("full_rank", T.LongType()),
        T.StructField("crcs", T.ArrayType(T.LongType())),
        T.StructField("ids", T.BinaryType()),
    ]
)


def encode_pieces(
    docs: DataFrame,
    *,
    size: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per document, written to the shared folder.

    A document's ids and ``end_id`` are cut into pieces of ``size`` (the last may be
    shorter); crcs holds one checksum per piece.  tail is the last piece's length,
    tail_rank and full_rank the number of earlier pieces of that length (of length
    ``size``) in the partition.  Null or empty texts hold the end id alone; null and
    repeated ids stay as they are, one row per input row.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def rows(batches):
        from zlib import crc32

        from pyspark import TaskContext

        enc, part, end = encoder(content.value), TaskContext.get().partitionId(), end_id.to_bytes(4, "little")
        seen = [0] * (size + 1)
        schema = pa.schema([(n, t) for n, t in zip(ENCODED.names, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))])
        for batch in batches:
            got, held = [], 0
            for doc_id, found in zip(batch.column(0), enc.encode_all(batch.column(1))):
                blob = found + end
                n = len(blob) // 4
                full, tail = divmod(n, size)
                crcs = [crc32(blob[k : k + size * 4]) for k in range(0, len(blob), size * 4)]
                got.append((doc_id.as_py(), part, len(crcs), tail or size, seen[tail], seen[size], crcs, blob if with_ids else None))
                seen[size] += full
                seen[tail] += 1
                held += len(blob)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)
                    got, held = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), schema)], schema=schema)

    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, ENCODED))


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Sequences that any packing needs: volume, or items that can't share (for every split of small and large)."""
    best = -(-sum(k * n for k, n in counts.items()) // size)
    lengths = sorted(counts)
    for a in [0] + [k for k in lengths if 2 * k <= size]:
        alone = sum(counts[k] for k in lengths if k > size - a)
        half = [k for k in lengths if 2 * k > size and k <= size - a]
        room = sum(counts[k] * (size - k) for k in half)
        small = sum(k * counts[k] for k in lengths if a <= k and 2 * k <= size)
        best = max(best, alone + sum(counts[k] for k in half) + max(0, -(-(small - room) // size)))
    return best


def best_fit_decreasing(counts: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many alike)] of best-fit decreasing, all items of a length in one step."""
    open_bins: dict[int, list] = {}
    for k in sorted(counts, reverse=True):
        left = counts[k]
        while left:
            rooms = sorted(r for r in open_bins if r >= k)
            if not rooms:
                q = size // k
                bins, odd = divmod(left, q)
                if bins:
                    open_bins.setdefault(size - q * k, []).append([(k,) * q, bins])
                if odd:
                    open_bins.setdefault(size - odd * k, []).append([(k,) * odd, 1])
                break
            r = rooms[0]
            group, n = open_bins[r].pop()
            if not open_bins[r]:
                del open_bins[r]
            q = r // k
            bins = min(n, left // q)
            odd = min(left, q) if not bins else 0
            used = bins or 1
            take = q if bins else odd
            if n > used:
                open_bins.setdefault(r, []).append([group, n - used])
            open_bins.setdefault(r - take * k, []).append([group + (k,) * take, used])
            left -= take * used
    return [(tuple(g), n) for groups in open_bins.values() for g, n in groups if n]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of ``b`` fit into those of ``a`` as into bins (found greedily, so never wrongly true)."""
    rooms = sorted(a)
    for k in sorted(b, reverse=True):
        at = next((i for i, r in enumerate(rooms) if r >= k), None)
        if at is None:
            return False
        rooms[at] -= k
        rooms.sort()
    return True


def fillings(lengths: list[int], live: dict[int, int], room: int, width: int, tries: int = 60) -> list[tuple[int, ...]]:
    """Up to ``width`` undominated fillings of ``room``, least waste first, then fewest items.

    ``lengths`` are the open ones in ascending order, ``live`` how many are left of
    each.  One item that fills the room dominates all else.  Pairs are found by
    their complement, over all lengths; longer fillings depth first from the longest
    length down, where ``tries`` bounds the maximal fillings looked at.
    """

    def below(limit: int, chosen: tuple[int, ...]) -> int:
        at = bisect_right(lengths, limit) - 1
        while at >= 0 and live[lengths[at]] <= chosen.count(lengths[at]):
            at -= 1
        return at

    first = below(room, ())
    if first < 0:
        return [()]
    if lengths[first] == room:
        return [(room,)]
    found: list[tuple[int, tuple[int, ...]]] = []
    exact = left = 0
    while first >= 0 and exact < width:
        k = lengths[first]
        second = below(min(room - k, k), (k,))
        rest = room - k - (lengths[second] if second >= 0 else 0)
        found.append((rest, (k, lengths[second]) if second >= 0 else (k,)))
        exact += rest == 0
        if 2 * k < room:
            break  # the shorter half was met as a complement
        first = below(k - 1, ())
    found = [f for f in found if below(f[0], f[1]) < 0]  # the others aren't maximal

    def deeper(room: int, top: int, chosen: tuple[int, ...]) -> None:
        nonlocal exact, left
        at, reach = below(min(room, top), chosen), (24, 6, 3)[min(len(chosen), 2)]
        if at < 0:
            left += 1
            if below(room, chosen) < 0:
                found.append((room, chosen))
                exact += room == 0
            return
        while at >= 0 and reach and left < tries and exact < width:
            deeper(room - lengths[at], lengths[at], (*chosen, lengths[at]))
            at, reach = below(lengths[at] - 1, chosen), reach - 1

    if exact < width:
        deeper(room, room, ())
    kept: list[tuple[int, ...]] = []
    for _, f in sorted(set(found), key=lambda f: (f[0], len(f[1]), [-k for k in f[1]])):
        if not any(_dominates(g, f) for g in kept):
            kept.append(f)
            if len(kept) == width:
                break
    return kept


def complete_bins(counts: dict[int, int], size: int, *, width: int = 4, nodes: int = 6_000) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a sequence, how many alike)]: the best packing that branch-and-bound finds.

    A node branches on ``width`` fillings around the longest open length.  A filling
    is taken as often as the histogram holds it, so a node may settle any number of
    sequences.  Lengths outside 1 to ``size`` raise; no lengths give no sequence.
    """
    live = {k: n for k, n in counts.items() if n}
    if not live:
        return []
    if min(live) < 1 or max(live) > size:
        raise ValueError(f"lengths lie in 1 to {size}")
    lengths, total, items = sorted(live), sum(k * n for k, n in live.items()), sum(live.values())
    best = best_fit_decreasing(live, size)
    upper, least = sum(n for _, n in best), lower_bound(live, size)
    taken: list[tuple[tuple[int, ...], int]] = []
    waste = bins = 0

    def options():
        is_open = [k for k in lengths if live[k]]
        top = is_open[-1]
        live[top] -= 1
        found = [(top, *f) for f in fillings(is_open, live, size - top, width)]
        live[top] += 1
        return iter([(p, min(live[k] // p.count(k) for k in set(p))) for p in found])

    def put(pattern, copies):
        nonlocal waste, bins, items
        for k in pattern:
            live[k] -= copies
        waste, bins, items = waste + (size - sum(pattern)) * copies, bins + copies, items - len(pattern) * copies

    stack, visited = [options()], 1
    while stack and upper > least and visited < nodes:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if stack:
                pattern, copies = taken.pop()
                put(pattern, -copies)
            continue
        pattern, copies = step
        if waste + (size - sum(pattern)) * copies > (upper - 1) * size - total:
            continue  # no better packing can waste so much
        put(pattern, copies)
        taken.append(step)
        if items:
            stack.append(options())
            visited += 1
        else:
            best, upper = list(taken), bins
            taken.pop()
            put(pattern, -copies)
    return best


SLOTS = "length int, slot long, until long, first_sequence long, each int, base int"


def _slots(histogram: DataFrame, size: int, width: int, nodes: int) -> DataFrame:
    """Runs of slots of a length: ranks [slot, until) lie ``each`` to a sequence from first_sequence on, at ``base``.

    The histogram has at most ``size`` rows; the number of runs is bounded by the
    search's steps, which are bounded by the lengths, not by the documents.
    """
    import pyarrow as pa

    ship(histogram.sparkSession)

    def search(t):
        counts = dict(zip(t.column("length").to_pylist(), t.column("n").to_pylist()))
        full = counts.pop(size, 0)
        patterns = ([((size,), full)] if full else []) + complete_bins(counts, size, width=width, nodes=nodes)
        rank, sequence, rows = {}, 0, []
        for pattern, copies in patterns:
            at = 0
            for k in sorted(set(pattern), reverse=True):
                each = pattern.count(k)
                a = rank.get(k, 0)
                rank[k] = a + each * copies
                rows.append((k, a, rank[k], sequence, each, at))
                at += k * each
            sequence += copies
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        names = [c.split()[0] for c in SLOTS.split(", ")]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return histogram.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(search, SLOTS)


def pack(encoded: DataFrame, *, size: int = 2048, width: int = 4, nodes: int = 6_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids where encoded.

    Pieces of a length are alike to the search; which one takes which slot follows
    their order in the partitions.  Ties change nothing but names of sequences.
    """
    fulls = F.col("pieces") - F.when(F.col("tail") == size, 0).otherwise(1)
    tails = encoded.filter(F.col("tail") < size).groupBy("part", F.col("tail").alias("length")).agg(F.count("*").alias("n"))
    whole = encoded.filter(fulls > 0).groupBy("part").agg(F.sum(fulls).alias("n")).select("part", F.lit(size).alias("length"), "n")
    here = materialise(tails.unionByName(whole))
    slots = materialise(_slots(here.groupBy("length").agg(F.sum("n").alias("n")), size, width, nodes))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = bounded(materialise(here.select("part", "length", earlier.alias("before"))))
    # a length's slots as one row of runs, looked up by rank
    runs = slots.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("slot", "until", "first_sequence", "each", "base"))).alias("runs"))
    runs = bounded(materialise(runs))

    each = F.transform(
        "crcs",
        lambda crc, k: F.struct(
            k.alias("piece"),
            F.when(k < fulls, F.lit(size)).otherwise(F.col("tail")).alias("length"),
            F.when(k < fulls, F.col("full_rank") + k).otherwise(F.col("tail_rank")).alias("rank"),
            crc.alias("ids_crc32"),
        ),
    )
    with_ids = "ids" in encoded.columns
    ids = ["ids"] if with_ids else []
    p = encoded.select("doc_id", "part", *ids, F.explode(each).alias("p")).select("doc_id", "part", *ids, "p.*")
    p = p.join(before, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    run = F.element_at(F.filter("runs", lambda r: (r["slot"] <= F.col("rank")) & (F.col("rank") < r["until"])), 1)
    p = p.join(runs, "length").withColumn("run", run)
    within = F.col("rank") - F.col("run.slot")
    return p.select(
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * size).alias("start"),
        F.col("length").cast("long").alias("length"),
        "ids_crc32",
        (F.col("run.first_sequence") + F.floor(within / F.col("run.each"))).alias("sequence_id"),
        (F.col("run.base") + F.pmod(within, F.col("run.each").cast("long")) * F.col("length")).cast("long").alias("offset"),
        *([F.substring("ids", F.col("piece") * size * 4 + 1, F.col("length") * 4).alias("ids")] if with_ids else []),
    )


def op13_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack(encode_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids"))
