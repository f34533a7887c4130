"""Token ids in flat unsigned integer files with 64-bit document offsets.

A shard is a range of ascending ids in three files: NAME.bin (the ids), NAME.off (int64, one more than
documents; offsets in the shard) and NAME.doc (int64 document ids). The shards' bases, that is the
number of ids before each, are prefix sums over one row per shard and are kept in a small table beside
them. Files are memory-mapped on reading.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photoflow.llm.encoding import encoder, groups
from photoflow.scratch import new_path, partitions

#: stands for a null document id in NAME.doc
NO_ID = np.iinfo(np.int64).min


def _fs(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """Encode every whole text into shard files under `out`; returns the shard table (shard, base, n_ids, n_docs).

    A null text is empty and holds only the end id. Null ids come first; equal ids are ordered by text.
    A shard is written under a name of its own and then renamed, so a repeated or second attempt of a
    task leaves one whole file. An empty table writes no shard. Other columns are ignored. The string of a
    special token becomes its id, as in the library, unless special_as_text.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranged = ranged.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text)
        end = np.array([end_id], enc.dtype).tobytes()
        width = len(end)
        fs, top = _fs(out)
        fs.create_dir(top, recursive=True)
        shard = f"shard-{TaskContext.get().partitionId():06d}"
        own = f"{top}/.{shard}-{uuid.uuid4().hex}"
        sizes, ids = [], []
        data = None
        for b in batches:
            ids.append(b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
            for _, texts in groups(b.column(1)):
                data = data or fs.open_output_stream(f"{own}.bin")
                for x in enc.encode(texts):
                    data.write(x + end)
                    sizes.append(len(x) // width + 1)
        if data is None:
            return
        data.close()
        for kind, values in (("off", np.concatenate([[0], np.cumsum(sizes)])), ("doc", np.concatenate(ids))):
            with fs.open_output_stream(f"{own}.{kind}") as f:
                f.write(values.astype("<i8").tobytes())
        for kind in ("bin", "off", "doc"):
            fs.move(f"{own}.{kind}", f"{top}/{shard}.{kind}")
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_ids": [int(sum(sizes))], "n_docs": [len(sizes)], "width": [width]})

    made = ranged.mapInArrow(write, "shard string, n_ids long, n_docs long, width long")
    made.write.parquet(f"{out}/shards.parquet")
    shards = spark.read.parquet(f"{out}/shards.parquet")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    return shards.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"), "n_ids", "n_docs", "width")


def read_shards(shards: DataFrame, out: str, id_col: str = "doc_id") -> DataFrame:
    """Read shard files back: one row per document with its place and the crc32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _fs(out)

        def opened(name: str, dtype: str) -> np.ndarray:
            path = f"{top}/{name}"
            if fs.type_name == "local":
                return np.memmap(path, dtype, "r")
            with fs.open_input_file(path) as f:
                return np.frombuffer(f.read_buffer(), dtype)

        for b in batches:
            for shard, base, width in zip(*(b.column(c).to_pylist() for c in ("shard", "base", "width")), strict=True):
                ids, off, doc = opened(f"{shard}.bin", f"<u{width}"), opened(f"{shard}.off", "<i8"), opened(f"{shard}.doc", "<i8")
                for s in range(0, len(doc), 4096):
                    e = min(s + 4096, len(doc))
                    crc = [zlib.crc32(ids[off[k] : off[k + 1]].astype("<u4").tobytes()) for k in range(s, e)]
                    d = np.asarray(doc[s:e])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d, pa.int64(), mask=d == NO_ID), pa.array(base + off[s:e]), pa.array(np.diff(off[s : e + 1])), pa.array(crc, pa.int64())],
                        names=[id_col, "start", "n_tokens", "ids_crc32"],
                    )

    rows = shards.select("shard", "base", "width").repartition(partitions(shards.sparkSession), "shard")
    return rows.mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents to the shared folder and return what the files say of each."""
    out = new_path(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, out, tokenizer, end_id), out)
