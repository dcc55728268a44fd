"""Operator 2: token ids as one wavelet matrix per shard.

A shard file is self-contained::

    b"GLWM" | version u32 | header length u32 | header (JSON) | sections

Sections are zstd frames: document ids, document starts, and for each of the
bit-planes its bits and its rank directory (ones before every 512-bit block).
:class:`WaveletMatrix` opens the bytes of one file and gives ``access``,
``rank`` (count of an id before a position), ``select`` (place of its k-th
occurrence) and ``decode``.

Shard files are rows of a table in the shared folder, written through Spark's
commit protocol, so any Hadoop file system holds them and a retried task leaves
no half-written shard.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialise, scratch, ship
from .tokens import default_path, encoder

MAGIC, VERSION, BLOCK = b"GLWM", 1, 512


class _Lazy:
    """Items made by ``make(k)`` when first asked for."""

    def __init__(self, make):
        self.make, self.made = make, {}

    def __getitem__(self, k: int):
        if k not in self.made:
            self.made[k] = self.make(k)
        return self.made[k]


class WaveletMatrix:
    """Rank/select over the ids of one shard file (bytes)."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        _, size = struct.unpack_from("<II", blob, 4)
        head = json.loads(blob[12 : 12 + size])
        self.n, self.levels, self.zeros = head["n"], head["levels"], head["zeros"]
        at = 12 + size
        self._blob, self._spans = blob, []
        for length, raw in head["sections"]:
            self._spans.append((at, length, raw))
            at += length
        self.doc_null = head["null_docs"]
        self.doc_ids = self._section(0, "<i8")
        self.doc_starts = self._section(1, "<i8")
        # planes and rank directories are unpacked when they are first used
        self.planes = _Lazy(lambda k: self._section(2 + 2 * k, "u1"))
        self.ranks = _Lazy(lambda k: self._section(3 + 2 * k, "<u4"))

    def _section(self, k: int, kind: str):
        import numpy as np
        import zstandard

        at, length, raw = self._spans[k]
        frame = self._blob[at : at + length]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(frame, max_output_size=raw) if raw else b"", kind)

    def _bit(self, level: int, i: int) -> int:
        return (int(self.planes[level][i >> 3]) >> (7 - (i & 7))) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        import numpy as np

        block = i // BLOCK
        n = int(self.ranks[level][block])
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (i + 7) // 8])
        return n + int(bits[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k in range(self.levels):
            bit, ones = self._bit(k, i), self._ones(k, i)
            value = value << 1 | bit
            i = self.zeros[k] + ones if bit else i - ones
        return value

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs before position i."""
        if token >> self.levels:
            return 0
        lo, hi = 0, i
        for k in range(self.levels):
            a, b = self._ones(k, lo), self._ones(k, hi)
            if token >> (self.levels - 1 - k) & 1:
                lo, hi = self.zeros[k] + a, self.zeros[k] + b
            else:
                lo, hi = lo - a, hi - b
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of the id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        lo = 0
        for level in range(self.levels):
            ones = self._ones(level, lo)
            lo = self.zeros[level] + ones if token >> (self.levels - 1 - level) & 1 else lo - ones
        at = lo + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._place(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _place(self, level: int, bit: int, j: int) -> int:
        """Place of the j-th (from 0) bit of this kind in a plane: a search of the directory, then one block."""
        import numpy as np

        ranks = self.ranks[level].astype(np.int64)
        if not bit:
            ranks = np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(ranks, j, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8 : (block + 1) * BLOCK // 8])
        return block * BLOCK + int(np.nonzero(bits == bit)[0][j - int(ranks[block])])

    def decode(self):
        """All ids in order, by undoing the stable partitions from the last plane up."""
        import numpy as np

        kind = np.uint16 if self.levels <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for k in range(self.levels - 1, -1, -1):
            bits = np.unpackbits(self.planes[k], count=self.n).view(bool)
            up = np.empty(self.n, kind)
            up[np.flatnonzero(~bits)] = values[: self.zeros[k]]
            up[np.flatnonzero(bits)] = values[self.zeros[k] :] | kind(1 << (self.levels - 1 - k))
            values = up
        return values


def build(ids, doc_ids: list, doc_starts: list, levels: int) -> bytes:
    """The file bytes for the ids of one shard."""
    import numpy as np
    import zstandard

    a = np.asarray(ids)
    if len(a) and int(a.max()) >> levels:
        raise ValueError("an id needs more bit-planes")
    a = a.astype(np.uint16 if levels <= 16 else np.uint32, copy=False)
    nulls = sum(x is None for x in doc_ids)
    sections = [
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array(doc_starts, "<i8").tobytes(),
    ]
    zeros = []
    for k in range(levels):
        bits = a & a.dtype.type(1 << (levels - 1 - k)) != 0
        packed = np.packbits(bits)
        ones = np.add.reduceat(bits, np.arange(0, len(bits), BLOCK), dtype="<u4") if len(bits) else np.zeros(0, "<u4")
        sections += [packed.tobytes(), np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes()]
        left = a.take(np.flatnonzero(~bits))  # places are several times faster than masks here
        zeros.append(len(left))
        a = np.concatenate([left, a.take(np.flatnonzero(bits))])
    pack = zstandard.ZstdCompressor(level=1)
    frames = [pack.compress(s) if s else b"" for s in sections]
    head = json.dumps(
        {
            "n": len(a),
            "levels": levels,
            "zeros": zeros,
            "null_docs": nulls,
            "sections": [[len(f), len(s)] for f, s in zip(frames, sections)],
        }
    ).encode()
    return b"".join([MAGIC, struct.pack("<II", VERSION, len(head)), head, *frames])


SHARD = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("seq", T.IntegerType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def write_shards(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 1,
    levels: int = 16,
    shard_tokens: int = 4_000_000,
    partitions: int | None = None,
    path: str | None = None,
) -> str:
    """Encode every document and write wavelet shards; returns the folder.

    Documents are range-partitioned by id, so shard order is id order (null ids
    first, equal ids by text).  A null text is an empty one; each document ends
    with ``end_id``.  A shard closes at the first document end past
    ``shard_tokens``; a longer document is a shard of its own.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    path = path or scratch(spark)
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(batches):
        import numpy as np
        from pyspark import TaskContext

        enc, part, seq = encoder(content.value), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        ids, starts, chunks, total = [], [], [], 0

        def close():
            tokens = np.concatenate(chunks) if chunks else np.zeros(0, np.uint32)
            blob = build(tokens, ids, starts, levels)
            return pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "n_docs": len(ids), "n_tokens": total, "payload": blob}],
                schema=pa.schema(
                    [("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]
                ),
            )

        small = np.uint16 if levels <= 16 else np.uint32
        for batch in batches:
            for doc, found in zip(batch.column(0), enc.encode_all(batch.column(1))):
                got = np.frombuffer(found + end, "<u4")
                if int(got.max()) >> levels:
                    raise ValueError("an id needs more bit-planes")
                got = got.astype(small)
                ids.append(doc.as_py())
                starts.append(total)
                chunks.append(got)
                total += len(got)
                if total >= shard_tokens:
                    yield close()
                    seq, ids, starts, chunks, total = seq + 1, [], [], [], 0
        if ids:
            yield close()

    (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(rows, SHARD)
        .write.option("compression", "none")
        .parquet(path)
    )
    return path


def read_shards(spark, path: str) -> DataFrame:
    """One row per document from the shard files: ids' place, count and checksum.

    ``start`` is global over all shards: a prefix sum over the totals of the
    range partitions plus one over the shards inside each.  Null ids come back as
    null, repeated ids as a row each; an empty folder's table gives no rows.
    """
    import pyarrow as pa

    ship(spark)
    shards = spark.read.schema(SHARD).parquet(path)

    def rows(batches):
        import zlib

        import numpy as np

        for batch in batches:
            for i in range(batch.num_rows):  # one shard's bytes at a time
                r = {c: batch.column(c)[i].as_py() for c in ("part", "seq", "payload")}
                m = WaveletMatrix(r["payload"])
                tokens = m.decode().astype("<u4")
                starts = np.append(m.doc_starts, m.n)
                view = memoryview(tokens).cast("B") if m.n else b""
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                k = len(crc)
                doc_ids = [None] * m.doc_null + m.doc_ids[m.doc_null :].tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array([r["part"]] * k, pa.int32()),
                        pa.array([r["seq"]] * k, pa.int32()),
                        pa.array(starts[:-1], pa.int64()),
                        pa.array(np.diff(starts), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=[f.name for f in DOC.fields],
                )

    totals = shards.select("part", "seq", "n_tokens")
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = parts.select(
        "part", F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    inside = totals.select(
        "part",
        "seq",
        F.coalesce(
            F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("inside"),
    )
    offsets = materialise(inside.join(before, "part").select("part", "seq", (F.col("before") + F.col("inside")).alias("offset")))
    docs = shards.mapInArrow(rows, DOC)
    return docs.join(bounded(offsets), ["part", "seq"]).select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def op2_wavelet_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(spark, write_shards(docs))
