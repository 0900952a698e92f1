"""Token counts by separator scan over flat token files.

A token file is a plain run of little-endian ids with an end-of-document id after each document and no index. Files are
cut into blocks; tasks search their blocks for the end id with one vectorised comparison each, and note the absolute
places of what they find. A prefix scan over the blocks of a file, a running count of ends and a running maximum of their
places, then says which document begins where, so that documents across any number of blocks are stitched together.
The scan sees three numbers for each block; places of ends stay in the table written by the search.

`write_token_files` makes such files from texts, one for each task, through the file system of the shared folder; what a
failed attempt leaves behind is never listed. `scan` reads any files listed as (path, n_bytes).

Defined results. A document without tokens counts 0. Tokens after the last end of a file are one more document, with
closed false. An empty file has no documents. A file whose size is no multiple of the id width raises an error, and so does
an id that the width cannot hold. Null or
empty text is written as a document without tokens. Repeated rows are repeated documents.
"""

from __future__ import annotations

import base64
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.work import fresh_path, leave_nothing, position, small_batches, stage, without

BLOCK_BYTES = 8 << 20
# Fixed value: the public splitting pattern of this byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DTYPES = {2: np.dtype("<u2"), 4: np.dtype("<u4")}


@lru_cache(maxsize=1)
def _encoding(ranks: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def write_token_files(docs: DataFrame, ranks: str, end_id: int, width: int = 2, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write the tokens of all texts; (files: path, n_bytes) and (documents: path, nth, doc_id), both staged."""
    spark = docs.sparkSession
    small_batches(spark)
    folder, dtype = fresh_path(spark, "tokens"), DTYPES[width]
    if not 0 <= end_id <= np.iinfo(dtype).max:
        raise ValueError(f"the end id does not fit into {width} bytes")
    ends = np.array([end_id], dtype=dtype)

    def run(batches):
        encoding = _encoding(ranks)
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        size = nth = 0
        with store.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for t in b.column(1):
                    ids = encoding.encode_to_numpy(t.as_py(), disallowed_special=()) if t.is_valid else ends[:0]
                    if len(ids) and ids.max() > np.iinfo(dtype).max:
                        raise ValueError(f"an id does not fit into {width} bytes")
                    out.write(ids.astype(dtype).tobytes())
                    out.write(ends.tobytes())
                    size += (len(ids) + 1) * width
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(nth, nth + n)), b.column(0), pa.nulls(n, pa.int64())], ["path", "nth", "doc_id", "n_bytes"]
                )
                nth += n
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([-1]), pa.nulls(1, pa.int64()), pa.array([size])], ["path", "nth", "doc_id", "n_bytes"])

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    made = stage(slim.mapInArrow(run, "path string, nth long, doc_id long, n_bytes long"), "token-list")
    leave_nothing(spark, folder)
    files = made.filter("nth < 0").select(F.concat(F.lit(folder + "/"), "path").alias("path"), "n_bytes")
    return files, made.filter("nth >= 0").select(F.concat(F.lit(folder + "/"), "path").alias("path"), "nth", "doc_id")


def with_counts(docs: DataFrame, ranks: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of every whole text; 0 for null. A column of that name is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[f"`{c}`" for c in without(docs.columns, *[name] * (name.lower() != text.lower()))])
    at = position(docs, text)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType(), False)])

    def run(batches):
        encoding = _encoding(ranks)
        for b in batches:
            sizes = [len(encoding.encode_to_numpy(t.as_py(), disallowed_special=())) if t.is_valid else 0 for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes, pa.int64())], schema.names)

    return docs.mapInArrow(run, schema)


def search(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, block, n_ends, last, total, ends): places of the end id in each block, counted in tokens from the file's start."""
    dtype, step = DTYPES[width], block_bytes // width * width

    def run(batches):
        for b in batches:
            for path, block, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size % width:
                    raise ValueError(f"{path}: {size} bytes are no whole number of ids")
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as f:
                    raw = f.read_at(min(step, size - block * step), block * step)
                ends = np.flatnonzero(np.frombuffer(raw, dtype=dtype) == end_id) + block * (step // width)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path]), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()),
                        pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([size // width], pa.int64()),
                        pa.array([ends], pa.list_(pa.int64())),
                    ],
                    ["path", "block", "n_ends", "last", "total", "ends"],
                )

    last = F.floor((F.col("n_bytes") - 1) / step)
    blocks = files.filter("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), "n_bytes")
    dealt = blocks.repartition("path", "block")
    return dealt.mapInArrow(run, "path string, block long, n_ends long, last long, total long, ends array<long>")


def scan(files: DataFrame, end_id: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, nth, start, n_tokens, closed): every document of the files, nth from 0 in each file."""
    found = stage(search(files, end_id, width, block_bytes), "token-ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    slim = found.select("path", "block", "n_ends", "last")
    prefix = slim.select(
        "path", "block", F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("open")
    )
    place = found.filter("n_ends > 0").select("path", "block", "ends").join(prefix, ["path", "block"])
    docs = place.select("path", "base", "open", "ends", F.posexplode("ends").alias("pos", "stop"))
    start = F.when(F.col("pos") == 0, F.col("open")).otherwise(F.get("ends", F.col("pos") - 1)) + 1
    docs = docs.select("path", (F.col("base") + F.col("pos")).alias("nth"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = found.groupBy("path").agg(F.sum("n_ends").alias("nth"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("total").alias("total"))
    rest = whole.filter("start < total").select("path", "nth", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(rest)
