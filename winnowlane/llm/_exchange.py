"""Asking the whole corpus about the hashes of a chunk, without sending rows for hashes.

Documents are dealt into chunks of a few MB. A chunk asks about its distinct keys: one row for
each (chunk, bucket) with the packed keys. A bucket meets the keys of all chunks and replies with
one bit for each key. Then the chunk meets its own replies. A key that a third of all rows hold
weighs no more than the number of chunks, and nothing but bits returns. The deal of the documents
appears twice in the plan and is one exchange that Spark reuses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.llm._scratch import input_bytes, parts

#: Bytes of stored documents for each chunk. A larger value means fewer and larger messages.
CHUNK_BYTES = 2_500_000
#: Bytes of stored documents whose keys one bucket may hold.
BUCKET_BYTES = 100_000_000
ASK = "chunk int, bucket int, keys binary, extra binary"
REPLY = "chunk int, bucket int, bits binary"


def chunk_count(frame: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """Chunks follow the input's size; where Catalyst has no estimate, the shuffle's width."""
    return max(1, -(-input_bytes(frame) // chunk_bytes) or 4 * parts(frame.sparkSession))


def chunked(frame: DataFrame, chunks: int, *keys: str) -> DataFrame:
    """Add a column ``chunk`` and deal the rows by it."""
    return deal(frame.withColumn("chunk", F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int")))


def deal(frame: DataFrame) -> DataFrame:
    """Deal rows by their column ``chunk``, packed: a row for each chunk and batch, holding compressed rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("chunk").to_numpy()
            order = np.argsort(at, kind="stable")
            table = pa.Table.from_batches([batch]).take(pa.array(order))
            which, first = np.unique(at[order], return_index=True)
            packed = []
            for x, y in zip(first, np.r_[first[1:], len(order)]):
                out = pa.BufferOutputStream()
                with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(table.slice(x, y - x))
                packed.append(out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(which.astype(np.int32)), "packed": pa.array(packed, pa.binary())})

    return frame.mapInArrow(pack, "chunk int, packed binary").repartition(parts(frame.sparkSession), "chunk")


def unpack(table: pa.Table) -> pa.Table:
    """The rows of one chunk as they were dealt; of none, a table without columns."""
    found = [pa.ipc.open_stream(b).read_all() for b in table.column("packed").to_pylist()]
    return pa.concat_tables(found).combine_chunks() if found else pa.table({})


def buckets(frame: DataFrame) -> int:
    """Buckets follow the shuffle's width, and the input's size where that asks for more: a bucket's keys are held at once."""
    return max(4 * parts(frame.sparkSession), -(-input_bytes(frame) // BUCKET_BYTES))


def exchange(dealt: DataFrame, ask: Callable, answer: Callable, finish: Callable, schema: str, reply: str = REPLY, asked: str = ASK) -> DataFrame:
    """Of a frame made by deal(): ask(chunk's table) gives ASK rows; answer(bucket's table) gives REPLY rows; finish(chunk's table, its replies) gives rows of ``schema``."""
    n = parts(dealt.sparkSession)

    def ask_packed(table: pa.Table) -> pa.Table:
        return ask(unpack(table))

    def finish_packed(table: pa.Table, replies: pa.Table) -> pa.Table:
        return finish(unpack(table), replies)

    asks = dealt.groupBy("chunk").applyInArrow(ask_packed, asked).repartition(n, "bucket")
    answers = asks.groupBy("bucket").applyInArrow(answer, reply).repartition(n, "chunk")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish_packed, schema)


def chunk_of(table: pa.Table) -> int:
    return table.column("chunk")[0].as_py()


def split_keys(combined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur among sorted ``bucket << 32 | low`` keys, and the bounds of each."""
    which = (combined >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]]) if len(which) else np.zeros(0, np.int64)
    return which[first], np.r_[first, len(which)]


def place(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket from the upper half, and the lower 32 bits: 32 + log2(buckets) bits tell keys apart."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(n_buckets)
    return (bucket << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def ask_rows(chunk: int, combined: np.ndarray, extra: list[bytes] | None = None) -> pa.Table:
    """Rows for sorted distinct keys made by place()."""
    which, at = split_keys(combined)
    low = combined.astype(np.uint32)
    return pa.table({
        "chunk": pa.array(np.full(len(which), chunk, np.int32)), "bucket": pa.array(which.astype(np.int32)),
        "keys": pa.array([low[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary()),
        "extra": pa.array(extra if extra is not None else [b""] * len(which), pa.binary()),
    })


def reply_rows(asked: pa.Table, bits: list[bytes]) -> pa.Table:
    return pa.table({"chunk": asked.column("chunk"), "bucket": asked.column("bucket"), "bits": pa.array(bits, pa.binary())})


def read_bits(replies: pa.Table, combined: np.ndarray) -> np.ndarray:
    """The bit of each sorted distinct key of a chunk, from its replies."""
    out = np.zeros(len(combined), dtype=bool)
    which, at = split_keys(combined)
    spot = {int(b): (int(x), int(y)) for b, x, y in zip(which, at[:-1], at[1:])}
    for bucket, bits in zip(replies.column("bucket").to_pylist(), replies.column("bits").to_pylist()):
        x, y = spot[bucket]
        out[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x).view(bool)
    return out
