"""Hard negatives by one-dimensional distance keys.

Vectors are rounded to whole numbers and given one more component that makes all of them equally long, so the largest
inner products with an anchor are its nearest neighbours. Each vector is stored under a key, its nearest pivot and its distance
from it, in blocks sorted by key. An anchor searches, around every pivot, the interval of keys that its radius
allows; the radius grows, and by the triangle inequality the distance that is left bounds every score not seen yet.
A search ends when that bound certifies its best scores; no candidate is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnowlane.llm._scratch import materialize, parts

#: Components are multiplied by it and rounded down.
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is at least and at most so many hundredths of its positive's.
LOW, HIGH = 50, 95
#: Pivots, and the vectors (of the least hashes of their ids) that they are fitted on. Every vector is indexed.
PIVOTS, SAMPLE = 32, 4096
#: Vectors of a block of the index, anchors searched together, and blocks that the driver lists: 48 bytes each. From DIRECTORY blocks on, blocks grow.
BLOCK, CHUNK, DIRECTORY = 2048, 256, 100_000
#: Blocks an anchor looks at in its first round; each round looks at WIDER times as many.
FIRST, WIDER = 8, 4
ROUNDS = 40
#: Squared length from which inner products need whole numbers of 64 bits, and from which they have none.
EXACT, MOST = 2.0**52, 2.0**61
SEED = 1303
NONE = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, anchor: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, anchor and q (whole numbers) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    length = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + (x * scale) * (x * scale))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    # rounding down adds less than one to each component
    return rows.where(sound).where(F.sqrt(length) + F.sqrt(F.size("v")) < MOST**0.5).withColumn("q", F.transform("v", lambda x: F.floor(x * scale))).drop("v")


class _Space:
    """Pivots and the component that makes all vectors equally long. Shipped to tasks: PIVOTS vectors."""

    def __init__(self, dim: int, most: float, sample: np.ndarray, pivots: int):
        self.dim, self.most = dim, most
        self.exact = most < EXACT
        # no component is longer than the longest vector
        self.kind = "<i2" if most < 2.0**30 else "<i4" if self.exact else "<i8"
        x = self.longer(sample.astype(np.float64))
        rng = np.random.default_rng(SEED)
        x = np.unique(x, axis=0)
        centre = x[rng.permutation(len(x))[:pivots]]
        for _ in range(8):
            nearest = self._squares(x, centre).argmin(axis=1)
            centre = np.stack([x[nearest == k].mean(axis=0) if (nearest == k).any() else c for k, c in enumerate(centre)])
        self.centre = centre

    def longer(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    @staticmethod
    def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """From each vector (an anchor has 0 for the added component) to each pivot."""
        x = x.astype(np.float64)
        x = np.concatenate([x, np.zeros((len(x), 1))], axis=1) if query else self.longer(x)
        # differences, not products: a vector that is a pivot has distance 0
        return np.sqrt(np.stack([((x - c) ** 2).sum(axis=1) for c in self.centre], axis=1))

    def slack(self) -> float:
        """More than what rounding can do to a bound of a score."""
        return 1.0 + 1e-9 * 4 * max(self.most, 1.0)

    def vectors(self, raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, self.kind).reshape(n, self.dim).astype(np.int64)

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.exact:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
        return a @ b.T


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows of whole numbers; shorter ones are filled with zeros."""
    out = np.zeros((len(lists), dim), np.int64)
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def _one(column) -> pa.Array:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _packed(rows: DataFrame, size: int, name: str, across: bool = False, tasks: int | None = None) -> DataFrame:
    """Rows of (pivot, dist, vec_id, row, label, raw), sorted by key and packed: block, pivot, lo, hi, n, least_id, rows, ids, labels, raw.

    ``raw`` holds one row's whole numbers. A block never crosses a range of keys, nor, unless ``across``, a pivot.
    """
    keys = ["pivot", "dist", "vec_id", "row"]
    ranged = rows.repartitionByRange(tasks or parts(rows.sparkSession), *keys).sortWithinPartitions(*keys)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            number += 1
            dist, ids, row, label = (table.column(c).to_numpy() for c in ("dist", "vec_id", "row", "label"))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "pivot": pa.array([table.column("pivot")[0].as_py()], pa.int32()), "lo": pa.array([dist.min()]), "hi": pa.array([dist.max()]), "n": pa.array([len(ids)], pa.int32()), "least_id": pa.array([ids.min()], pa.int64()),
                "rows": pa.array([row.astype("<i8").tobytes()], pa.binary()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "labels": pa.array([label.astype("<i8").tobytes()], pa.binary()), "raw": pa.array([b"".join(table.column("raw").to_pylist())], pa.binary()),
            })

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held)
            pivot = table.column("pivot").to_numpy()
            at = 0
            while at < len(pivot):
                stop = min(at + size, len(pivot) if across else int(np.searchsorted(pivot, pivot[at], "right")))
                if stop == len(pivot) and stop - at < size:
                    break  # may go on in the next batch
                yield out(table.slice(at, stop - at))
                at = stop
            held = table.slice(at).to_batches()
        if held and sum(b.num_rows for b in held):
            yield out(pa.Table.from_batches(held))

    schema = "block long, pivot int, lo double, hi double, n int, least_id long, rows binary, ids binary, labels binary, raw binary"
    return materialize(ranged.mapInArrow(pack, schema), name)


class _Index:
    """Blocks sorted by (pivot, distance), chunks of anchors, and the directory of blocks."""

    def __init__(self, rows: DataFrame, pivots: int, sample: int, block: int, chunk: int):
        whole = rows.select(F.count("*").alias("n"), F.max(F.size("q")).alias("dim"), F.max(F.aggregate("q", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))).alias("most")).first()
        self.n = whole.n
        if not self.n:
            return
        taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "label").limit(sample).select("q").collect()  # ``sample`` vectors at most
        known = np.zeros((len(taken), whole.dim), np.int64)
        for i, r in enumerate(taken):
            known[i, : len(r.q)] = r.q
        space = self.space = _Space(whole.dim, whole.most, known, pivots)

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(_one(batch.column("q")), space.dim)
                d = space.distances(x)
                near = d.argmin(axis=1)
                raw = x.astype(space.kind)
                yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in ("vec_id", "label", "anchor", "row")}, "pivot": pa.array(near, pa.int32()), "dist": pa.array(d[np.arange(len(x)), near]), "raw": pa.array([r.tobytes() for r in raw], pa.binary())})

        keyed = materialize(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(key, "vec_id long, label long, anchor boolean, row long, pivot int, dist double, raw binary"), "keyed")
        self.blocks = _packed(keyed.drop("anchor"), max(block, -(-self.n // DIRECTORY)), "distance-blocks")
        anchors = keyed.where("anchor").drop("anchor")
        self.chunks = _packed(anchors, chunk, "anchors", True, min(parts(rows.sparkSession), -(-anchors.count() // chunk) or 1))
        listed = self.blocks.select("block", "pivot", "lo", "hi", "least_id").orderBy("block").toArrow()  # DIRECTORY blocks, and one more for each pivot and range of keys
        self.block, self.pivot, self.lo, self.hi, self.least = (listed.column(c).to_numpy() for c in listed.column_names)


_STATE = "chunk long, n int, ids binary, rows binary, labels binary, raw binary, done binary, low binary, high binary, floor binary, floor_id binary, wanted array<long>"
_BEST = "chunk long, anchor int, band int, rank int, score long, vec_id long, row long"


def _search(index: _Index, opened: DataFrame, same: bool, k: int, first: int, wider: int) -> DataFrame:
    """_BEST rows: of each anchor and band the best k vectors of its own label (``same``; not itself) or of other labels.

    ``opened``: chunk, n, ids, rows, labels, raw, and the bands low and high (n, bands): scores that count.
    """
    spark = opened.sparkSession
    space, directory = index.space, spark.sparkContext.broadcast((index.block, index.pivot, index.lo, index.hi, index.least))  # bounded by DIRECTORY
    vectors, slack = space.vectors, space.slack()

    def planner(take: int):
        def plan(state: pa.Table, best: pa.Table) -> pa.Table:
            """The blocks that each anchor's next interval of keys reaches, and the scores to beat."""
            block, pivot, lo, hi, least = directory.value
            row = {c: state.column(c)[0].as_py() for c in state.column_names}
            n = row["n"]
            low, high = (np.frombuffer(row[c], "<i8").reshape(n, -1) for c in ("low", "high"))
            done = np.unpackbits(np.frombuffer(row["done"], np.uint8), count=len(block)).view(bool).copy() if row["done"] else np.zeros(len(block), bool)
            floor, floor_id = np.full(low.shape, NONE), np.full(low.shape, np.iinfo(np.int64).max)
            at = [best.column(c).to_numpy() for c in ("anchor", "band", "rank", "score", "vec_id")]
            full = at[2] == k
            floor[at[0][full], at[1][full]], floor_id[at[0][full], at[1][full]] = at[3][full], at[4][full]
            x = vectors(row["raw"], n)
            length = (x.astype(np.float64) ** 2).sum(axis=1) + space.most
            away = space.distances(x, query=True)
            pick = np.zeros(len(block), bool)
            for a in range(n):
                d = away[a, pivot]
                near = np.maximum(np.maximum(lo - d, d - hi), 0)
                bound = np.floor((length[a] - near**2) / 2 + slack)
                least_score = np.floor((length[a] - (d + hi) ** 2) / 2 - slack)
                open_ = np.zeros(len(block), bool)
                for b in range(low.shape[1]):
                    if low[a, b] <= high[a, b]:
                        open_ |= (bound >= low[a, b]) & (least_score <= high[a, b]) & ((bound > floor[a, b]) | ((bound == floor[a, b]) & (least <= floor_id[a, b])))
                left = np.flatnonzero(open_ & ~done)
                pick[left[np.argsort(near[left], kind="stable")[:take]]] = True
            out = row | {"done": np.packbits(done | pick).tobytes(), "floor": floor.astype("<i8").tobytes(), "floor_id": floor_id.astype("<i8").tobytes(), "wanted": block[pick].tolist()}
            return pa.table({f: pa.array([out[f]], t) for f, t in _kinds(_STATE)})

        return plan

    def scan(table: pa.Table) -> pa.Table:
        """Scores of a chunk's anchors with a block's vectors; those that enter a band's best."""
        row = {c: table.column(c)[0].as_py() for c in table.column_names}
        n, m = row["n"], row["b_n"]
        scores = space.scores(vectors(row["raw"], n), vectors(row["b_raw"], m))
        ids, rows, labels = (np.frombuffer(row[f"b_{c}"], "<i8") for c in ("ids", "rows", "labels"))
        alike = np.frombuffer(row["labels"], "<i8")[:, None] == labels[None, :]
        fit = alike & (np.frombuffer(row["rows"], "<i8")[:, None] != rows[None, :]) if same else ~alike
        low, high, floor, floor_id = (np.frombuffer(row[c], "<i8").reshape(n, -1) for c in ("low", "high", "floor", "floor_id"))
        found = []
        for b in range(low.shape[1]):
            ok = fit & (scores >= low[:, b : b + 1]) & (scores <= high[:, b : b + 1])
            ok &= (scores > floor[:, b : b + 1]) | ((scores == floor[:, b : b + 1]) & (ids[None, :] <= floor_id[:, b : b + 1]))
            if m > k:
                kept = np.where(ok, scores, NONE)
                ok &= scores >= np.partition(kept, m - k, axis=1)[:, m - k : m - k + 1]
            a, v = np.nonzero(ok)
            order = np.lexsort((rows[v], ids[v], -scores[a, v], a))
            a, v = a[order], v[order]
            start = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            nth = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)]))
            a, v = a[nth < k], v[nth < k]
            found.append((a, np.full(len(a), b), scores[a, v], ids[v], rows[v]))
        a, b, s, i, r = (np.concatenate(x) for x in zip(*found))
        return pa.table({"chunk": pa.array(np.full(len(a), row["chunk"]), pa.int64()), "anchor": pa.array(a, pa.int32()), "band": pa.array(b, pa.int32()), "rank": pa.array(np.zeros(len(a)), pa.int32()), "score": pa.array(s, pa.int64()), "vec_id": pa.array(i, pa.int64()), "row": pa.array(r, pa.int64())})

    order = Window.partitionBy("chunk", "anchor", "band").orderBy(F.col("score").desc(), "vec_id", "row")
    narrow = [c for c in ("chunk", "n", "rows", "labels", "raw", "low", "high", "floor", "floor_id")]
    inner = index.blocks.select("block", *[F.col(c).alias(f"b_{c}") for c in ("n", "rows", "ids", "labels", "raw")])
    best = spark.createDataFrame([], _BEST)
    state = opened.select("chunk", "n", "ids", "rows", "labels", "raw", F.lit(b"").alias("done"), "low", "high")
    take = first
    for _ in range(ROUNDS):
        planned = materialize(state.groupBy("chunk").cogroup(best.groupBy("chunk")).applyInArrow(planner(take), _STATE), "search")
        pairs = planned.where(F.size("wanted") > 0).select("chunk", F.explode("wanted").alias("block"))
        if not pairs.limit(1).count():
            return best
        met = pairs.join(inner, "block").join(planned.select(*narrow), "chunk")
        found = met.groupBy("chunk", "block").applyInArrow(scan, _BEST)
        ranked = best.unionByName(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = materialize(ranked.select(*[c.split()[0] for c in _BEST.split(", ")]), "best")
        state, take = planned.drop("floor", "floor_id", "wanted"), take * wider
    raise RuntimeError(f"anchors left after {ROUNDS} rounds")


def _kinds(schema: str) -> list[tuple[str, pa.DataType]]:
    known = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return [(f.split()[0], known[f.split()[1]]) for f in schema.split(", ")]


def mine(vectors: DataFrame, anchor: Column, scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, pivots: int = PIVOTS, sample: int = SAMPLE, block: int = BLOCK, chunk: int = CHUNK, first: int = FIRST, wider: int = WIDER) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; ``anchor`` says which rows of (vec_id, embedding, label) are anchors.

    A score is the inner product of rounded vectors; higher ones come first, ties go by the smaller vec_id. An
    anchor's positives are its first ``positives`` other rows of the same label, and of each the first ``negatives`` rows of other labels
    whose score is ``low`` to ``high`` hundredths of the positive's are returned. Rows with a null id, label, vector or
    component, or a component that isn't finite, take no part, and neither do vectors whose scores would not fit 64 bits. Shorter
    vectors count as filled with zeros, an empty one has score 0 with all. Rows that repeat an id are vectors of their own, also the twin of an
    anchor. Other columns are not looked at; empty tables, one label and no anchors give no rows.
    """
    spark = vectors.sparkSession
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = _Index(prepared(vectors, anchor, scale), pivots, sample, block, chunk)
    if not index.n:
        return spark.createDataFrame([], out)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One band for each anchor: all scores."""
        for batch in batches:
            n = batch.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.full(x, NONE + 1, "<i8").tobytes() for x in n], pa.binary()), pa.array([np.full(x, np.iinfo(np.int64).max, "<i8").tobytes() for x in n], pa.binary())], [*batch.schema.names, "low", "high"])

    plain = "chunk long, n int, ids binary, rows binary, labels binary, raw binary"
    anchors = index.chunks.select(F.col("block").alias("chunk"), "n", "ids", "rows", "labels", "raw")
    liked = _search(index, anchors.mapInArrow(whole, f"{plain}, low binary, high binary"), True, positives, first, wider)

    def bands(state: pa.Table, best: pa.Table) -> pa.Table:
        """The scores that count as negatives of each positive; of those that an anchor doesn't have, none."""
        if not state.num_rows:
            return pa.table({f: pa.array([], t) for f, t in _kinds(f"{plain}, low binary, high binary")})
        n = state.column("n")[0].as_py()
        least, most = np.zeros((n, positives), "<i8"), np.full((n, positives), -1, "<i8")
        for a, r, s in zip(*(best.column(c).to_pylist() for c in ("anchor", "rank", "score"))):
            least[a, r - 1], most[a, r - 1] = -((-low * s) // 100), (high * s) // 100
        return state.append_column("low", pa.array([least.tobytes()], pa.binary())).append_column("high", pa.array([most.tobytes()], pa.binary()))

    opened = materialize(anchors.groupBy("chunk").cogroup(liked.groupBy("chunk")).applyInArrow(bands, f"{plain}, low binary, high binary"), "bands")
    hard = _search(index, opened, False, negatives, first, wider)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, ids in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(np.full(len(ids), c), pa.int64()), "anchor": pa.array(np.arange(len(ids)), pa.int32()), "anchor_id": pa.array(ids, pa.int64())})

    named = anchors.select("chunk", "ids").mapInArrow(names, "chunk long, anchor int, anchor_id long")
    liked = liked.select("chunk", "anchor", (F.col("rank") - 1).alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hard = hard.select("chunk", "anchor", "band", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hard.join(liked, ["chunk", "anchor", "band"]).join(named, ["chunk", "anchor"]).select(*[c.split()[0] for c in out.split(", ")])
