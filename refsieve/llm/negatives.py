"""Operator 13: hard negatives by ball-tree branch-and-bound on inner products.

Components become floor(256 x); a row's score is its integer inner product with
the anchor. One map over the input writes a forest: each task builds a ball tree
of every ``TREE_ROWS`` rows that it reads. Anchors (the stated query set) go over
the forest in blocks of about ``ANCHORS``: a block is broadcast, each task walks
its trees, and the best of each task are ranked by a window.

With a ball's centre c and radius r, the scores of its rows lie within
q.c - |q| r and q.c + |q| r. A node is left out for an anchor if it holds no row
of the label asked for, if no window of scores meets that range, or if the upper
bound is strictly below the task's current kth score (a tie may still win by its
id). Scores themselves are exact integers.

1. Positives: the best ``POSITIVES`` rows of the anchor's label.
2. Negatives: for each positive the best ``NEGATIVES`` rows of other labels whose
   score is 30 to 90 per cent of the positive's; all positives of an anchor in one walk.

Rows with a null id, label or vector, or with null or non-finite components, take
no part; nor do vectors of another length than that of the least id, or with
floor(256 x) of 2^22 or more in size. Rows of one id are never each other's
positive or negative; else repeated rows count as often as they stand. An empty
table, or one without anchors, gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from refsieve.llm.common import batches_of, ddl_schema, send, shared_dir, tidied, written
from refsieve.llm.vectors import integers, length_of, products

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
TREE_ROWS, LEAF = 8192, 64
#: Anchors of a block on average: 16 MB of vectors of 256 components.
ANCHORS = 16_384
#: Trees that a task holds at once, of about 2 MB each at 64 components.
TREES_AT_ONCE = 4
NONE = -(1 << 62)

FOREST = "ids binary, labels binary, v binary, nodes binary, centres binary, radii binary"
FOUND = "aid bigint, slot int, score bigint, vec_id bigint"


def grow(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, ...]:
    """A ball tree: the rows in leaf order, and for each node (from, to, left, right, least label, greatest label), its centre and radius.

    A node of several labels is cut between labels, one of a single label across
    the line of two rows far apart.
    """
    order, x = np.arange(len(ids)), v.astype(np.float64)
    nodes, centres, radii = [], [], []
    todo = [(0, len(ids), -1)]
    while todo:
        lo, hi, above = todo.pop()
        rows = order[lo:hi]
        centre = x[rows].mean(axis=0)
        far = np.sqrt(((x[rows] - centre) ** 2).sum(axis=1))
        if above >= 0:
            nodes[above][2 if nodes[above][2] < 0 else 3] = len(nodes)
        at, its = len(nodes), np.sort(labels[rows])
        nodes.append([lo, hi, -1, -1, its[0], its[-1]])
        centres.append(centre)
        radii.append(far.max())
        if hi - lo <= LEAF:
            continue
        if its[0] < its[-1]:
            rows = rows[np.argsort(labels[rows], kind="stable")]
            edges = np.flatnonzero(np.diff(its)) + 1
            cut = int(edges[np.abs(edges - len(rows) // 2).argmin()])
        else:
            one = x[rows[far.argmax()]]
            other = x[rows[((x[rows] - one) ** 2).sum(axis=1).argmax()]]
            cut = len(rows) // 2
            rows = rows[np.argpartition(x[rows] @ (one - other), cut)]
        order[lo:hi] = rows
        todo += [(lo + cut, hi, at), (lo, lo + cut, at)]
    return ids[order], labels[order], v[order], np.array(nodes, np.int64), np.array(centres), np.array(radii)


def forest(rows: DataFrame, size: int) -> DataFrame:
    """The trees of ``rows`` (vec_id, label, x), one a row, written."""
    schema = ddl_schema(FOREST)

    def tree(held: list[tuple]) -> pa.RecordBatch:
        ids, labels, v = (np.concatenate(part) for part in zip(*held, strict=True))
        grown = grow(ids, labels, v.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in grown], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            kept, whole = integers(batch.column(2), size, SCALE)
            ids, labels = (batch.column(i).filter(pa.array(kept)).to_numpy() for i in (0, 1))
            for at in range(0, len(ids), TREE_ROWS):
                held.append((ids[at : at + TREE_ROWS], labels[at : at + TREE_ROWS], whole[at : at + TREE_ROWS]))
                n += len(held[-1][0])
                if n >= TREE_ROWS:
                    yield tree(held)
                    held, n = [], 0
        if n:
            yield tree(held)

    return written(rows.mapInArrow(tidied(run), FOREST), "negatives-forest")


def opened(row: tuple, size: int) -> tuple[np.ndarray, ...]:
    ids, labels, v, nodes, centres, radii = row
    return np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(v, np.int32).reshape(-1, size), np.frombuffer(nodes, np.int64).reshape(-1, 6), np.frombuffer(centres).reshape(-1, size), np.frombuffer(radii)


def walk(tree: tuple[np.ndarray, ...], asked: tuple[np.ndarray, ...], best: tuple[np.ndarray, np.ndarray], same: bool) -> None:
    """Better ``best`` (scores and ids, each of anchors by windows by k, best first) by the rows of one tree.

    ``asked`` has the anchors' ids, labels, vectors, and the least and greatest
    score of each window. ``same``: rows of the anchor's label are meant, else rows of others.
    """
    ids, labels, v, nodes, centres, radii = tree
    names, marks, q, low, high = asked
    x = q.astype(np.float64)
    norms = np.sqrt((x * x).sum(axis=1))
    tops, who = best
    todo = [(0, np.arange(len(names)))]
    while todo:
        at, act = todo.pop()
        lo, hi, left, right, least, most = nodes[at]
        act = act[(marks[act] >= least) & (marks[act] <= most) if same else (marks[act] != least) | (marks[act] != most)]
        middle, reach = x[act] @ centres[at], norms[act] * radii[at]
        slack = 1 + 1e-9 * (np.abs(middle) + reach)
        up, down = middle + reach + slack, middle - reach - slack
        fits = (up[:, None] >= np.maximum(low[act], tops[act, :, -1])) & (down[:, None] <= high[act])
        alive = fits.any(axis=1)
        act = act[alive]
        if not len(act):
            continue
        if left >= 0:
            pair = [(left, act), (right, act)]
            nearer = (x[act] @ (centres[left] - centres[right])).sum()
            todo += pair if nearer < 0 else pair[::-1]
            continue
        scores = products(q[act], v[lo:hi].astype(np.int64))
        right_label = (labels[None, lo:hi] == marks[act, None]) == same
        fair = right_label & (ids[None, lo:hi] != names[act, None])
        good = fair[:, None, :] & (scores[:, None, :] >= np.maximum(low[act], tops[act, :, -1])[:, :, None]) & (scores[:, None, :] <= high[act][:, :, None])
        i, w = np.nonzero(good.any(axis=2))
        if len(i):
            a = act[i]
            score = np.concatenate([tops[a, w], np.where(good[i, w], scores[i], NONE)], axis=1)
            name = np.concatenate([who[a, w], np.broadcast_to(ids[lo:hi], (len(i), hi - lo))], axis=1)
            order = np.lexsort((name, -score), axis=-1)[:, : tops.shape[2]]
            tops[a, w] = np.take_along_axis(score, order, 1)
            who[a, w] = np.take_along_axis(name, order, 1)


def searched(trees: DataFrame, block: tuple[np.ndarray, ...], size: int, k: int, same: bool, to: str) -> None:
    """Append to ``to`` the first k (aid, slot, score, vec_id) of each task for a block of anchors: aid, ids, labels, vectors, windows."""
    sent = send(trees.sparkSession, block)
    schema = ddl_schema(FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aid, *asked = sent()
        shape = (*asked[3].shape, k)
        best = np.full(shape, NONE), np.zeros(shape, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                walk(opened([c[i].as_py() for c in batch.columns], size), asked, best, same)
        a, w, j = np.nonzero(best[0] > NONE)
        for at in range(0, len(a), 100_000):
            part = a[at : at + 100_000], w[at : at + 100_000], j[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(aid[part[0]]), pa.array(part[1].astype(np.int32)), pa.array(best[0][part]), pa.array(best[1][part])], schema=schema)

    with batches_of(trees.sparkSession, TREES_AT_ONCE):
        trees.mapInArrow(tidied(run), FOUND).write.mode("append").parquet(to)
    sent.release()


def anchors_of(rows: DataFrame, size: int, every: int) -> DataFrame:
    """(aid, vec_id, label, v) of the rows that are anchors, with a number of their own, written."""
    schema = ddl_schema("vec_id bigint, label bigint, v binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, whole = integers(batch.column(2), size, SCALE)
            ids, labels = (batch.column(i).filter(pa.array(kept)) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([ids, labels, pa.array([r.tobytes() for r in whole.astype(np.int32)], pa.binary())], schema=schema)

    numbered = rows.where(F.col("vec_id") % every == 0).mapInArrow(tidied(run), "vec_id bigint, label bigint, v binary")
    return written(numbered.withColumn("aid", F.monotonically_increasing_id()), "negatives-anchors")


def ranked(spark: object, path: str, k: int) -> DataFrame:
    """The first ``k`` of each anchor and window of all that tasks found, with their rank."""
    order = Window.partitionBy("aid", "slot").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(FOUND).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64("aid"), F.lit(blocks))


def vectors_of(table: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    numbers = (table.column(c).to_numpy() for c in ("aid", "vec_id", "label"))
    return *numbers, np.frombuffer(b"".join(table.column("v").to_pylist()), np.int32).reshape(-1, size).astype(np.int64)


def mine(table: DataFrame, label: Column | None = None, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label``: an expression in place of the label column; anchors are the rows whose id ``every`` divides.
    """
    spark, out = table.sparkSession, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    size = length_of(table, id_col, vector_col)
    if not size:
        return spark.createDataFrame([], out)
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), (F.col(label_col) if label is None else label).cast("bigint").alias("label"), F.col(vector_col).alias("x")).where("vec_id is not null and label is not null")
    trees, anchors = forest(rows, size), anchors_of(rows, size, every)
    blocks = -(-anchors.count() // ANCHORS)
    if not blocks:
        return spark.createDataFrame([], out)
    at = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    for block in range(blocks):
        aid, ids, labels, q = vectors_of(anchors.where(block_of(blocks) == block).toArrow(), size)
        wide = np.full((len(ids), 1), -NONE)
        searched(trees, (aid, ids, labels, q, -wide, wide), size, POSITIVES, True, f"{at}/same")
    positives = written(ranked(spark, f"{at}/same", POSITIVES).select("aid", (F.col("rank") - 1).alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "negatives-positives")
    scores = positives.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))).alias("s")).select("aid", F.transform("s", lambda x: x["positive_score"]).alias("scores"))
    asked = written(anchors.join(scores, "aid"), "negatives-asked")
    for block in range(blocks):
        held = asked.where(block_of(blocks) == block).toArrow()
        aid, ids, labels, q = vectors_of(held, size)
        low, high = np.ones((len(ids), POSITIVES), np.int64), np.zeros((len(ids), POSITIVES), np.int64)
        for i, its in enumerate(held.column("scores").to_pylist()):
            for slot, score in enumerate(its):
                low[i, slot], high[i, slot] = -(-30 * score // 100), 90 * score // 100
        searched(trees, (aid, ids, labels, q, low, high), size, NEGATIVES, False, f"{at}/other")
    named = anchors.select("aid", F.col("vec_id").alias("anchor_id")).join(positives, "aid")
    found = ranked(spark, f"{at}/other", NEGATIVES).select("aid", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["aid", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
