"""Embedding near-dedup: random hyperplanes, exact cosines, connected components.

Signs of projections on random hyperplanes give each vector a bucket in each of several tables.
Bits follow from the number of vectors, so that unrelated vectors seldom share a bucket; tables follow from
the wanted recall at the threshold. Buckets are dealt as (bucket, node) alone; those of several nodes
become units, and units of the same nodes in several tables are one. Vectors are sent once for each unit that is
left, and compared by their cosine in double precision; a pair that shares several units is
compared in that of the first table. Equal vectors are compared once and counted as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnowlane.llm import _blocks
from winnowlane.llm import _bytes as B
from winnowlane.llm._components import components
from winnowlane.llm._scratch import materialize

COSINE = 0.98
#: Share of pairs at the threshold itself that may be missed; pairs above it are missed less often.
MISS = 1e-6
#: Bits beyond those that number the vectors: one of 2**SPARE buckets is shared by chance. Vectors in a block of a large unit.
SPARE, BLOCK = 5, 1024
#: At most so many: the low bits of a bucket's key are its table.
MOST_TABLES = _blocks.NUMBERS
SEED = 20240


def layout(vectors: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits and tables: buckets that few unrelated vectors share; tables enough for the recall."""
    bits = min(60, max(8, math.ceil(math.log2(max(vectors, 2))) + SPARE))
    near = 1 - math.acos(min(1.0, cosine)) / math.pi
    while True:  # at lower thresholds fewer bits, or tables would be without end
        same = near**bits
        tables = math.ceil(math.log(miss) / math.log(1 - same)) if same < 1 else 1
        if tables <= MOST_TABLES or bits <= 1:
            return bits, min(tables, MOST_TABLES)
        bits -= 1


def planes(dim: int, n: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, n))


def _unit(flat: np.ndarray) -> np.ndarray:
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def link(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of (vec_id, embedding, label).

    Vectors are linked if their labels are equal and not null, their lengths are equal, and their
    cosine is at least ``cosine``. Null, empty and zero vectors and those with null or non-finite
    components link with nothing, and neither do rows without an id. Rows that repeat an id are
    vectors of their own. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0.0), F.lit(False))
    key = [F.xxhash64("label", "v", F.lit(1)).alias("k1"), F.xxhash64(F.lit(2), "v", "label").alias("k2")]
    keyed = rows.withColumn("sound", sound)
    good = keyed.where("sound").select("vec_id", "label", "v", *key)
    classes = good.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.min(F.struct("label", "v")).alias("x"))
    classes = classes.select("k1", "k2", "rep", "n", F.xxhash64("x.label", F.size("x.v")).alias("kind"), "x.v").withColumn("node", F.monotonically_increasing_id())
    bits, tables = layout(good.count(), cosine, miss)
    # components that are single precision are sent as such; all is worked out in double
    single = "float" in vectors.schema["embedding"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens = np.array([len(v) for v in batch.column("v")], np.int64)
            sides, packed = np.empty(batch.num_rows, object), np.empty(batch.num_rows, object)
            for dim in np.unique(lens):
                at = np.flatnonzero(lens == dim)
                flat = np.array(batch.column("v").take(pa.array(at)).flatten(), np.float64).reshape(len(at), dim)
                side = np.packbits(_unit(flat) @ planes(int(dim), bits * tables) >= 0, axis=1)
                raw = flat.astype(np.float32 if single else np.float64)
                for k, i in enumerate(at):
                    sides[i], packed[i] = side[k].tobytes(), raw[k].tobytes()
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("node", "k1", "k2", "rep", "n", "kind")}, "sides": pa.array(sides.tolist(), pa.binary()), "v": pa.array(packed.tolist(), pa.binary())})

    signed = materialize(classes.mapInArrow(sign, "node long, k1 long, k2 long, rep long, n long, kind long, sides binary, v binary"), "signed")

    def codes_of(column) -> np.ndarray:
        """The bucket's code in each table (rows, tables) from packed signs."""
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        side = np.unpackbits(raw, axis=1, count=bits * tables).reshape(len(column), tables, bits)
        return side @ (np.int64(1) << np.arange(bits, dtype=np.int64))

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes, kind = codes_of(batch.column("sides")).astype(np.uint64), batch.column("kind").to_numpy().view(np.uint64)
                number = np.arange(tables, dtype=np.uint64)
                key = (B.mix(codes + B.mix(kind[:, None] + number)) & ~np.uint64(_blocks.NUMBERS)) | number
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(key.ravel().view(np.int64)), "node": pa.array(np.repeat(batch.column("node").to_numpy(), tables))})

    units = materialize(_blocks.units(signed.select("node", "kind", "sides").mapInArrow(bucketed, "bucket long, node long"), block), "units")
    members = units.join(signed.select("node", "n", "kind", "sides", "v"), "node")

    def work(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        ids, n = table.column("node").to_numpy(), table.column("n").to_numpy().astype(np.float64)
        own, i, j, number, kind, u2 = (table.column(c).to_numpy() for c in ("own", "i", "j", "number", "kind", "u2"))
        codes = codes_of(table.column("sides"))
        unit = [np.frombuffer(v, np.float32 if single else np.float64).astype(np.float64) for v in table.column("v").to_pylist()]
        dim = np.fromiter(map(len, unit), np.int64, len(unit))
        width = int(dim.max())
        flat = np.zeros((len(unit), width))
        for r, v in enumerate(unit):
            flat[r, : len(v)] = v
        flat = _unit(flat)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _blocks.pairs_within(bounds, own, i, j, 100_000):
            # codes equal in this table and in none before; a chance equality of hashes falls out too
            same = codes[a] == codes[b]
            first = _blocks.first_shared(same, number[a]) & (number[a] == number[b]) & (u2[a] == u2[b]) & (kind[a] == kind[b]) & (dim[a] == dim[b])
            a, b = a[first], b[first]
            near = np.einsum("ij,ij->i", flat[a], flat[b]) >= cosine
            found.append((a[near], b[near]))
        a, b = (np.concatenate([f[s] for f in found]) if found else np.zeros(0, np.int64) for s in (0, 1))
        return _blocks.rows(ids, n, a, b)

    checked = materialize(_blocks.compare(_blocks.paired(members, "u1", "node", block, units), "u1", work), "links")
    linked = checked.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    grouped = components(checked.where("b IS NOT NULL").select("a", "b"))
    joined = signed.select("k1", "k2", "node", "rep", "n").join(linked.withColumnRenamed("a", "node"), "node", "left").join(grouped, "node", "left")
    joined = joined.select("k1", "k2", F.coalesce("component", "node").alias("node"), "rep", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    of_class = joined.drop("rep").join(joined.groupBy("node").agg(F.min("rep").alias("component_id")), "node").drop("node")
    out = keyed.select("vec_id", *[F.when(F.col("sound"), k).alias(c) for k, c in zip(key, ("k1", "k2"))]).join(of_class, ["k1", "k2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
