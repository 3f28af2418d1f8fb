"""Hard negatives by best-first search of STR-packed R-trees (operator 13).

Rows are cut into shards along their first coordinates, and every shard is packed
sort-tile-recursively into an R-tree whose leaves hold up to ``LEAF`` rows.  The
bounding box of a node gives, coordinate by coordinate, the interval of the inner products
with an anchor; the label is one more side of the box.  A search takes the node with the highest
upper end from a queue, and drops nodes outside all score windows or strictly
below the k-th score found.

Only anchors travel: each is sent to the shard that promises most, and then, with the
k-th score found there, to those other shards whose own boxes can still hold better.  A shard's
rows are shuffled to its task once per round; a task holds one shard's tree and reads the
anchors past it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abuse_lens.plans.settle import settle

#: Rows of a leaf, children of an inner node, and rows of a shard.
LEAF, FANOUT, SHARD_ROWS = 64, 16, 16_384
#: The boxes of all shards go to every task; shards grow where these would take more.
BOXES_BYTES = 64_000_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1
WINDOWS = "array<struct<id:bigint,low:bigint,high:bigint,least:bigint>>"
ASKS = f"anchor_id long, label long, vec array<long>, windows {WINDOWS}"
FOUND = "anchor_id long, id long, vec_id long, score long"


def quantised(rows: DataFrame, steps: int = 256, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vec (each component times ``steps``, rounded down) of the rows that take part.

    Rows with a null vec_id, label, vector or component, or a component that is not
    finite, do not.  Of rows that repeat a vec_id the least by label and vector counts.
    """
    whole = F.col(vector).isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vec = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(steps))).cast("long"))
    part = rows.where(whole & F.coalesce(finite, F.lit(False)))
    one = part.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(F.col("label").cast("long").alias("label"), vec.alias("vec"))).alias("row"))
    return one.select("vec_id", "row.label", "row.vec")


def matrix(vectors: list[list[int]], dims: int) -> np.ndarray:
    """Doubles where all inner products of such numbers are exact in them, else Python's integers."""
    ints = np.array(vectors, np.int64).reshape(len(vectors), dims)
    most = max(-int(ints.min()), int(ints.max())) if ints.size else 0
    return ints.astype(np.float64) if most * most * max(dims, 1) < 1 << 53 else ints.astype(object)


def _str_order(keys: np.ndarray, leaves: int) -> np.ndarray:
    """Rows in the order of their leaves: sorted by the first key and cut into slabs, these by the next key, and so on."""
    order = np.arange(len(keys))
    slabs = [order]
    for i in range(keys.shape[1]):
        each = max(1, round(leaves ** (1 / (keys.shape[1] - i))))
        cut = []
        for slab in slabs:
            by_key = slab[np.argsort(keys[slab, i], kind="stable")]
            rows = LEAF * max(1, -(-len(slab) // (LEAF * each)))
            cut += [by_key[a : a + rows] for a in range(0, len(slab), rows)]
        slabs, leaves = cut, max(1, -(-leaves // each))
    return np.concatenate(slabs) if slabs else order


class Tree:
    """An R-tree over the rows of a shard, packed sort-tile-recursively by the label and the widest coordinates."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        plain = vecs.astype(np.float64)
        widest = np.argsort(-plain.std(0), kind="stable")[:2] if vecs.shape[1] else []
        keys = np.column_stack([labels.astype(np.float64), *(plain[:, i] for i in widest)])
        order = _str_order(keys, -(-len(ids) // LEAF))
        self.ids, self.labels, self.vecs = ids[order], labels[order], vecs[order]
        cuts = np.arange(0, len(ids), LEAF)
        level = [np.minimum.reduceat(self.vecs, cuts), np.maximum.reduceat(self.vecs, cuts),
                 np.minimum.reduceat(self.labels, cuts), np.maximum.reduceat(self.labels, cuts)]
        self.levels = [level]
        while len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), FANOUT)
            level = [f.reduceat(side, cuts) for f, side in zip((np.minimum, np.maximum) * 2, level, strict=True)]
            self.levels.append(level)

    def search(self, anchor: int, label: int, vec: np.ndarray, windows: list[dict], k: int, same: bool) -> list[tuple[int, int, int]]:
        """(window, vec_id, score) of the ``k`` best rows in each window, among rows of the anchor's label or of others."""
        up, down = np.maximum(vec, 0), np.minimum(vec, 0)
        low = np.array([max(w["low"], w["least"]) for w in windows], vec.dtype)
        high = np.array([w["high"] for w in windows], vec.dtype)
        best: list[list[tuple[int, int]]] = [[] for _ in windows]  # heaps of (score, -vec_id)
        queue: list[tuple] = []

        def push(depth: int, a: int, b: int) -> None:
            least, most, first, last = (side[a:b] for side in self.levels[depth])
            above, below = most @ up + least @ down, least @ up + most @ down
            usable = (first <= label) & (last >= label) if same else (first != label) | (last != label)
            usable &= ((above[:, None] >= low) & (below[:, None] <= high)).astype(bool).any(1)
            for i in np.flatnonzero(usable).tolist():
                heapq.heappush(queue, (-above[i], depth, a + i))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue and -queue[0][0] >= low.min():
            _, depth, node = heapq.heappop(queue)
            if depth:
                push(depth - 1, node * FANOUT, min((node + 1) * FANOUT, len(self.levels[depth - 1][0])))
                continue
            rows = slice(node * LEAF, (node + 1) * LEAF)
            scores = self.vecs[rows] @ vec
            fit = ((self.labels[rows] == label) == same) & (self.ids[rows] != anchor)
            inside = fit[:, None] & ((scores[:, None] >= low) & (scores[:, None] <= high)).astype(bool)
            for w in np.flatnonzero(inside.any(0)).tolist():
                heap, hits = best[w], np.flatnonzero(inside[:, w])
                for score, vec_id in zip(scores[hits].tolist(), self.ids[rows][hits].tolist(), strict=True):
                    heapq.heappush(heap, (int(score), -vec_id))
                    if len(heap) > k:
                        heapq.heappop(heap)
                if len(heap) == k:
                    low[w] = max(low[w], heap[0][0])
        return [(w, -i, s) for w, heap in enumerate(best) for s, i in heap]


def _shards(rows: DataFrame, rows_of_shard: int) -> DataFrame:
    """``rows`` with dims and shard, cut along the first coordinate, among equal ones along the second, then by id."""
    first, second = (F.coalesce(F.try_element_at("vec", F.lit(i)), F.lit(0)).cast("double") for i in (1, 2))
    spread = F.atan(second / 256.0) / 3.2 + (F.pmod(F.xxhash64("vec_id"), F.lit(1024)) - 512) / 262144.0
    keyed = rows.select("*", F.size("vec").alias("dims"), (first + spread).alias("_key"))
    size = keyed.agg(F.count("*").alias("n"), F.max("dims").alias("dims")).first()
    each = max(rows_of_shard, -(-size.n * 16 * max(size.dims or 1, 1) // BOXES_BYTES))
    count = max(1, -(-size.n // each))
    cuts: list[float] = []
    if count > 1:
        at = [i / count for i in range(1, count)]
        cuts = sorted(set(keyed.agg(F.percentile_approx("_key", at, 20 * count).alias("cuts")).first().cuts))
    shard = F.lit(0)
    if cuts:
        shard = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("_key")))
    return keyed.withColumn("shard", shard.cast("int")).drop("_key")


def _boxes(shards: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: the shards, and the least and highest components in each."""
    wide = shards.select("dims", "shard", F.posexplode_outer("vec").alias("i", "x")).groupBy("dims", "shard", "i")
    sides = wide.agg(F.min("x").alias("low"), F.max("x").alias("high")).groupBy("dims", "shard")
    found: dict[int, list] = {}
    for r in sides.agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("sides")).orderBy("dims", "shard").collect():
        cells = r.sides if r.dims else []
        found.setdefault(r.dims, []).append((r.shard, [c.low for c in cells], [c.high for c in cells]))
    return {
        dims: (np.array([r[0] for r in rows], np.int32), matrix([r[1] for r in rows], dims), matrix([r[2] for r in rows], dims))
        for dims, rows in found.items()
    }


def _dealt(asks: DataFrame, boxes, first: bool) -> DataFrame:
    """``asks`` with dims and shard: to the most promising shard, or to all others that can still hold something."""
    shared = asks.sparkSession.sparkContext.broadcast(boxes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, dims, shards = [], [], []
            for row, (vec, windows) in enumerate(zip(batch.column("vec").to_pylist(), batch.column("windows").to_pylist(), strict=True)):
                if len(vec) not in shared.value:
                    continue
                names, least, most = shared.value[len(vec)]
                q = np.array(vec, object if least.dtype == object else np.float64)
                up, down = np.maximum(q, 0), np.minimum(q, 0)
                above, below = most @ up + least @ down, least @ up + most @ down
                at = int(np.argmax(above)) if len(above) else 0
                fit = np.zeros(len(names), bool)
                if first:
                    fit[at] = True
                else:
                    for w in windows:
                        fit |= (above >= max(w["low"], w["least"])).astype(bool) & (below <= w["high"]).astype(bool)
                    fit[at] = False
                hits = np.flatnonzero(fit)
                rows += [row] * len(hits)
                dims += [len(vec)] * len(hits)
                shards.append(names[hits])
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = [*taken.columns, pa.array(dims, pa.int32()), pa.array(np.concatenate([*shards, np.zeros(0, np.int32)]))]
            yield pa.RecordBatch.from_arrays(columns, [*taken.schema.names, "dims", "shard"])

    return asks.mapInArrow(deal, f"{ASKS}, dims int, shard int")


def _visit(shards: DataFrame, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """What every anchor finds in the shards it is sent to: at most ``k`` rows a window and shard."""
    none = F.lit(None).cast(WINDOWS)
    trees = shards.select("dims", "shard", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "vec", none.alias("windows"))
    sent = asks.select("dims", "shard", F.lit(1).alias("kind"), F.col("anchor_id").alias("id"), "label", "vec", "windows")
    dealt = trees.unionByName(sent).repartition("dims", "shard").sortWithinPartitions("dims", "shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, tree = None, [], None
        for batch in batches:
            found: list[tuple] = []
            for dims, shard, kind, vec_id, label, vec, windows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (dims, shard) != current:
                    current, rows, tree = (dims, shard), [], None
                if not kind:
                    rows.append((vec_id, label, vec))
                    continue
                if tree is None and rows:
                    ids, labels, vecs = zip(*rows, strict=True)
                    tree, rows = Tree(np.array(ids, np.int64), np.array(labels, np.int64), matrix(list(vecs), dims)), []
                if tree is None:
                    continue
                q = np.array(vec, np.int64).astype(object)
                reach = sum(abs(int(x)) for x in q) * max((abs(int(x)) for side in tree.levels[-1][:2] for x in side.ravel()), default=0)
                if reach < 1 << 53 and tree.vecs.dtype != object:
                    q = q.astype(np.float64)
                for w, other, score in tree.search(vec_id, label, q, windows, k, same):
                    found.append((vec_id, windows[w]["id"], other, min(max(score, LOW), HIGH)))
            columns = zip(*found, strict=True) if found else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["anchor_id", "id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(shards: DataFrame, boxes, asks: DataFrame, k: int, same: bool) -> DataFrame:
    """rank, vec_id and score of the ``k`` best rows of all shards for each window of each ask."""
    near = settle(_visit(shards, _dealt(asks, boxes, True), k, same))
    full = near.groupBy("anchor_id", "id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    known = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "least"))).alias("least"))
    raised = F.transform("windows", lambda w: w.withField("least", F.coalesce(F.element_at("least", w.id), w.least)))
    joined = asks.join(known, "anchor_id", "left").withColumn("windows", F.when(F.col("least").isNotNull(), raised).otherwise(F.col("windows")))
    far = _visit(shards, _dealt(joined.drop("least"), boxes, False), k, same)
    return settle(_ranked(near.unionByName(far), k))


def _window(id_column, low, high):
    longs = [c.cast("long").alias(n) for n, c in (("id", id_column), ("low", low), ("high", high), ("least", F.lit(LOW)))]
    return F.struct(*longs)


def mine(
    rows: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    floor_percent: int = 30,
    ceiling_percent: int = 90,
    rows_of_shard: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``rows`` and ``anchors`` have vec_id, label and vec (see ``quantised``); anchors are some of the rows.
    The score of a row is its inner product with the anchor; higher comes first, then the smaller vec_id.
    An anchor's positives are its first ``positives`` other rows of its label.  For each, the
    first ``negatives`` rows of other labels are returned whose score is at least ``floor_percent`` and at most
    ``ceiling_percent`` of the positive's; fewer if there are fewer, none for a positive below 0.

    Rows meet anchors of as many components only.  Scores beyond a long are held at its ends.  Equal rows are interchangeable
    but for their ids, so of equal vectors of one label only the smallest ids that can be asked for are kept,
    which bounds what a vector with many copies costs.  No rows, no anchors or one label: no rows out.
    """
    copies = Window.partitionBy("label", "vec").orderBy("vec_id")
    most = max(positives + 1, negatives)
    useful = rows.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= most).drop("_copy")
    shards = settle(_shards(settle(useful), rows_of_shard))
    boxes = _boxes(shards)
    base = anchors.select(F.col("vec_id").alias("anchor_id"), "label", "vec")
    whole = F.array(_window(F.lit(0), F.lit(LOW), F.lit(HIGH)))
    pairs = _search(shards, boxes, settle(base.withColumn("windows", whole)), positives, True)
    pairs = pairs.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    # integer ends of the window, without a product that could leave a long
    score, hundred = F.col("positive_score").cast("decimal(20,0)"), F.lit(100)
    low, high = F.ceil(score * floor_percent / hundred), F.floor(score * ceiling_percent / hundred)
    windows = pairs.where("positive_score >= 0").select("anchor_id", _window(F.col("positive_id"), low, high).alias("w"))
    windows = windows.where("w.low <= w.high").groupBy("anchor_id").agg(F.collect_list("w").alias("windows"))
    found = _search(shards, boxes, settle(base.join(windows, "anchor_id")), negatives, False)
    return found.withColumnRenamed("id", "positive_id").join(pairs, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
