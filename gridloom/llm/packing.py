"""Operator 4: concatenate and cut.

Pass one encodes every document where it is scanned and writes its ids with the
place inside its partition.  A prefix sum over the partitions' token totals
gives global offsets.  Pass two cuts the global token line into fixed windows;
a document that crosses a window's end leaves a boundary record (a piece) on
either side.  No text or id is shuffled.
"""

from __future__ import annotations

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
        T.StructField("local_start", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def encode_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
) -> DataFrame:
    """Pass one: ids (little-endian uint32), written to the shared folder.

    Null or empty texts hold the end id alone; null and repeated ids stay as
    they are, one row per input row.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())

    def rows(batches):
        from pyspark import TaskContext

        enc, part, at = encoder(content.value), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, starts, blobs, held, size = [], [], [], [], 0
            for k, found in enumerate(enc.encode_all(batch.column(1))):
                blob = found + end
                starts.append(at)
                blobs.append(blob)
                held.append(len(blob) // 4)
                at += held[-1]
                size += len(blob)
                ids.append(k)
                if size > 8_000_000 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(ids[0], len(ids)),
                            pa.array([part] * len(ids), pa.int32()),
                            pa.array(starts, pa.int64()),
                            pa.array(held, pa.int64()),
                            pa.array(blobs, pa.binary()),
                        ],
                        names=[f.name for f in ENCODED.fields],
                    )
                    ids, starts, blobs, held, size = [], [], [], [], 0

    return materialise(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
            rows, ENCODED
        )
    )


def pack(encoded: DataFrame, *, window: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pass two: one row per piece of a document in a window (sequence).

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and the piece's ids if ``with_ids``.  Every sequence but the last is full.
    """
    totals = encoded.groupBy("part").agg(F.sum("doc_tokens").alias("t"))
    offsets = materialise(
        totals.select(
            "part",
            F.coalesce(F.sum("t").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        )
    )
    placed = encoded.join(bounded(offsets), "part").select(
        "doc_id", "doc_tokens", "ids", (F.col("before") + F.col("local_start")).alias("g")
    )
    end = F.col("g") + F.col("doc_tokens")

    def piece(w):
        a = F.greatest(w * window, F.col("g"))
        b = F.least((w + 1) * window, end)
        cut = F.substring(F.col("ids"), ((a - F.col("g")) * 4 + 1).cast("int"), ((b - a) * 4).cast("int"))
        fields = [
            (a - F.col("g")).alias("start"),
            (b - a).alias("length"),
            F.crc32(cut).alias("ids_crc32"),
            w.alias("sequence_id"),
            (a - w * window).alias("offset"),
        ]
        return F.struct(*fields, *([cut.alias("ids")] if with_ids else []))

    first, last = F.floor(F.col("g") / window), F.floor((end - 1) / window)
    cuts = placed.select("doc_id", "doc_tokens", F.transform(F.sequence(first, last), piece).alias("p"))
    return cuts.select("doc_id", "doc_tokens", F.explode("p").alias("p")).select(
        "doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if with_ids else [])
    )


def op4_concat_and_cut(spark, sf_dir: str) -> DataFrame:
    return pack(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))
