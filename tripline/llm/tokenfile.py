"""Token ids of a corpus in files of separately compressed documents.

A store is a folder of two Parquet tables:

* ``dictionary``: one row, the shared zstandard dictionary and its SHA-256;
* ``blocks``: rows of about ``BLOCK_BYTES``.  ``payload`` holds one frame a document, end
  to end; ``doc_ids``, ``offsets`` and ``counts`` say where each lies and how many ids it
  has.  ``shard`` and ``block`` are in ascending order of doc_id, ``before`` counts the ids
  of the shard ahead of the block, and ``first_doc``/``last_doc`` let a reader of a few
  documents skip the rest.  Each block names the dictionary by its hash.

Ids are little-endian unsigned 32-bit integers, the end id included.  Null doc_ids come
first; rows of equal doc_id follow by content; null text is empty; an empty table gives
an empty store.  Other columns are not stored.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripline.llm.arrow import release, slices, small_batches
from tripline.llm.bpe import encoder
from tripline.session import scratch_dir

BLOCK_BYTES = 1 << 20
BLOCK_DOCS = 4_096
DICTIONARY_BYTES = 64 << 10
#: The dictionary is trained on so many documents at most, of so many characters at most.
SAMPLE_DOCS = 512
SAMPLE_CHARS = 16_384
LEVEL = 3

_BLOCKS = (
    "shard int, block int, dictionary string, first_doc long, last_doc long, before long,"
    " doc_ids array<long>, offsets array<int>, counts array<int>, payload binary"
)


def train_dictionary(docs: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from the ids of a sample by hash; empty if there is no text.

    Rows are chosen where they are read, about twice as many as are used.
    """
    some = docs.where(F.length("text") > 0)
    share = min(1.0, 2 * SAMPLE_DOCS / max(some.count(), 1))
    place = F.xxhash64("doc_id", F.length("text"))
    sample = (
        some.where(F.pmod(place, F.lit(1 << 40)) <= F.lit(int(share * (1 << 40))))
        .select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), place.alias("h"))
        .orderBy("h", "text")
        .limit(SAMPLE_DOCS)
    )
    end = array("I", [end_id]).tobytes()
    ids = [encoder(path).encode(row.text) + end for row in sample.collect()]
    if not ids:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the ids themselves serve
        return b"".join(ids)[:DICTIONARY_BYTES]


def _shared(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the store."""
    spark = small_batches(docs).sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    dictionary = train_dictionary(docs, path, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dictionary string, bytes binary").coalesce(1).write.parquet(
        f"{folder}/dictionary"
    )
    # Equal doc_ids are told apart by content, and equal rows by chance, so no key is one task.
    order = ["doc_id", F.crc32("text"), F.rand(7)]
    (
        docs.repartitionByRange(*order)
        .sortWithinPartitions("doc_id", F.crc32("text"))
        .withColumn("shard", F.spark_partition_id())
        .mapInArrow(_block_writer(path, dictionary, name, end_id), _BLOCKS)
        .write.option("parquet.block.size", 16 << 20)
        .parquet(f"{folder}/blocks")
    )


def _block_writer(path: str, dictionary: bytes, name: str, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), array("I", [end_id]).tobytes()
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_shared(dictionary)).compress
        ids: list = []
        frames: list[bytes] = []
        counts: list[int] = []
        shard, block, before, held = 0, 0, 0, 0

        def row() -> pa.RecordBatch:
            nonlocal block, before, held
            known = [i for i in ids if i is not None]
            offsets = np.zeros(len(frames), np.int32)
            np.cumsum([len(f) for f in frames[:-1]], out=offsets[1:])
            made = {
                "shard": shard, "block": block, "dictionary": name,
                "first_doc": min(known, default=None), "last_doc": max(known, default=None), "before": before,
                "doc_ids": list(ids), "offsets": offsets.tolist(), "counts": list(counts), "payload": b"".join(frames),
            }
            block, before, held = block + 1, before + sum(counts), 0
            ids.clear(), frames.clear(), counts.clear()
            return pa.RecordBatch.from_pylist([made], _ARROW_BLOCKS)

        for batch in batches:
            for part in slices(batch, "text"):
                shard = part["shard"][0].as_py()
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    encoded = coder.encode(text) + end
                    frame = press(encoded)
                    if frames and held + len(frame) > BLOCK_BYTES or len(frames) >= BLOCK_DOCS:
                        yield row()
                    ids.append(doc_id)
                    frames.append(frame)
                    counts.append(len(encoded) // 4)
                    held += len(frame)
        if frames:
            yield row()
        release()

    return run


_ARROW_BLOCKS = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("dictionary", pa.string()), ("first_doc", pa.int64()),
        ("last_doc", pa.int64()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("payload", pa.binary()),
    ]
)


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, shard, in_shard (ids of the shard before it), n_tokens, ids (little-endian bytes).

    With ``doc_ids``, only blocks whose range holds one of them are read, and of those
    only the frames asked for are decompressed.
    """
    row = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary, name = bytes(row.bytes), row.dictionary
    if hashlib.sha256(dictionary).hexdigest() != name:
        raise ValueError(f"the dictionary of {folder} does not have the hash it is named by")
    blocks = small_batches(spark.read.parquet(f"{folder}/blocks"))
    if doc_ids is not None:
        near = [F.col("first_doc").__le__(i) & F.col("last_doc").__ge__(i) for i in doc_ids]
        blocks = blocks.where(near[0] if len(near) == 1 else _any(near))
    wanted = None if doc_ids is None else set(doc_ids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor(dict_data=_shared(dictionary)).decompress
        for batch in batches:
            for b in range(batch.num_rows):
                block = batch.slice(b, 1)
                if block["dictionary"][0].as_py() != name:
                    raise ValueError("a block was written with another dictionary")
                payload = memoryview(block["payload"][0].as_buffer())
                ids, counts = block["doc_ids"][0].as_py(), np.array(block["counts"][0].as_py(), np.int64)
                offsets = [*block["offsets"][0].as_py(), len(payload)]
                before = block["before"][0].as_py() + np.cumsum(counts) - counts
                take = [k for k in range(len(ids)) if wanted is None or ids[k] in wanted]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[k] for k in take], pa.int64()),
                        pa.array([block["shard"][0].as_py()] * len(take), pa.int32()),
                        pa.array(before[take], pa.int64()),
                        pa.array(counts[take], pa.int64()),
                        pa.array([unpress(payload[offsets[k] : offsets[k + 1]]) for k in take], pa.binary()),
                    ],
                    ["doc_id", "shard", "in_shard", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, shard int, in_shard long, n_tokens long, ids binary")


def _any(conditions: list):
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out


def shard_starts(spark: SparkSession, folder: str) -> DataFrame:
    """shard, shard_start: the ids of all shards before it.  One row a written partition."""
    last = F.col("before") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.max(last).alias("total"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("total").over(ahead), F.lit(0)).alias("shard_start"))


def new_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tripline-tokens-{uuid.uuid4().hex}"
