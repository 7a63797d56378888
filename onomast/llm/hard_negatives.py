"""Hard-negative mining by dual-tree search over inner products.

Two trees, one over anchors and one over candidates, are grown on bounded samples; every row is then sent down its tree. A node has a centre and the
radius that holds all its rows, so the inner products of a pair of nodes lie in an interval. From the pair of roots downwards a pair is
dropped, whole groups of anchors at once, when its interval can't meet what its anchors still look for; pairs of leaves are scored exactly.

Two searches are made. The first looks for an anchor's nearest rows of its own label; a bound for each anchor comes from the sample, where its
fifth best score is at most that of the whole table. The second looks, for each of these positives, for rows of other labels whose scores are
between `least` of the positive's score and that score.

How it scales: vectors are shuffled once, into blocks of about BLOCK rows of a leaf (a leaf with a third of all rows is many blocks). The trees have at most
LEAVES leaves each, so the walk over node pairs is bounded whatever the number of rows. What is sent to the blocks of a leaf are groups of at
most about GROUP anchors; a task scores one group against one block and returns the first few rows of each anchor. Between blocks the first few are
taken by Spark's ranking, limited before its shuffle. The work is that of the leaf pairs that remain: where vectors have no structure, all of them.

Defined results: rows with a null id, label or vector, a null or non-finite component, or a component of LARGEST or more in amount after scaling
take no part. Of rows that repeat an id one stays, that of the least label, then of the least vector. Shorter vectors count as followed by zeros, an
empty one as zeros. Ties go to the smaller id. Positives with a negative score have no negatives (no score is between). Other columns play no part,
whatever their names. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from onomast.llm.common import release, small_batches, written

#: Rows (and bytes) of a sample that a tree is grown on and first bounds are taken from.
SAMPLE, SAMPLE_BYTES = 8192, 16 << 20
#: Leaves of a tree at most, rows of a block and anchors of a group, about.
LEAVES, BLOCK, GROUP = 256, 2048, 128
#: Scaled components are less than this in amount, so that a hundred times the score of up to 2,048 of them fits a long.
LARGEST = 1 << 22
NONE = np.iinfo(np.int64).min


# --- trees --------------------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A balanced binary tree in heap order from 1: inner nodes cut by a direction at a place, and every node has a centre."""

    depth: int
    directions: np.ndarray
    places: np.ndarray
    centres: np.ndarray
    radii: np.ndarray | None = None
    rows: np.ndarray | None = None

    @staticmethod
    def grown(sample: np.ndarray, leaves: int) -> Tree:
        """Nodes are cut at the median along the line through the row farthest from the centre and the row farthest from that one."""
        depth = max(0, int(np.ceil(np.log2(max(1, min(leaves, len(sample)))))))
        size = 2 << depth
        tree = Tree(depth, np.zeros((size, sample.shape[1])), np.zeros(size), np.zeros((size, sample.shape[1])))
        parts = {1: sample}
        for node in range(1, size):
            part = parts.pop(node)
            tree.centres[node] = part.mean(0) if len(part) else tree.centres[node >> 1]
            if node < size >> 1:
                if len(part):
                    a = part[np.argmax(((part - tree.centres[node]) ** 2).sum(1))]
                    b = part[np.argmax(((part - a) ** 2).sum(1))]
                    tree.directions[node] = b - a
                    tree.places[node] = np.median(part @ (b - a))
                right = part @ tree.directions[node] > tree.places[node]
                parts[2 * node], parts[2 * node + 1] = part[~right], part[right]
        return tree

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        node = np.ones(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", rows, self.directions[node]) > self.places[node])
        return node

    def filled(self, found: list) -> Tree:
        """With the radius and number of rows of each node, from (leaf, radius, rows) of all rows."""
        self.radii, self.rows = np.zeros(len(self.places)), np.zeros(len(self.places), np.int64)
        for r in found:
            self.radii[r["leaf"]], self.rows[r["leaf"]] = r["radius"], r["rows"]
        for node in range(len(self.places) - 1, 1, -1):
            up = node >> 1
            self.rows[up] += self.rows[node]
            if self.rows[node]:
                self.radii[up] = max(self.radii[up], np.sqrt(((self.centres[node] - self.centres[up]) ** 2).sum()) + self.radii[node])
        return self


def interval(centre: np.ndarray, radius: float, centre2: np.ndarray, radius2: float) -> tuple[float, float]:
    """Bounds of the inner products of rows of two balls, a little wider than exact for the sake of rounding."""
    middle = float(centre @ centre2)
    spread = np.sqrt(centre @ centre) * radius2 + np.sqrt(centre2 @ centre2) * radius + radius * radius2
    spread += 1 + 1e-9 * (abs(middle) + spread)
    return middle - spread, middle + spread


def meeting(anchors: Tree, rows: Tree, low: np.ndarray, high: np.ndarray) -> tuple[list[tuple[int, int]], int]:
    """The pairs of leaves whose intervals meet [low, high] of the anchors' node, and how many node pairs were looked at."""
    stack, out, seen = [(1, 1)], [], 0
    while stack:
        a, c = stack.pop()
        seen += 1
        if not anchors.rows[a] or not rows.rows[c] or low[a] > high[a]:
            continue
        least, most = interval(anchors.centres[a], anchors.radii[a], rows.centres[c], rows.radii[c])
        if most < low[a] or least > high[a]:
            continue
        leaf_a, leaf_c = a >= len(anchors.places) >> 1, c >= len(rows.places) >> 1
        if leaf_a and leaf_c:
            out.append((a, c))
        else:
            # the wider node is opened first
            open_a = not leaf_a and (leaf_c or anchors.radii[a] > rows.radii[c])
            stack += [(2 * a, c), (2 * a + 1, c)] if open_a else [(a, 2 * c), (a, 2 * c + 1)]
    return out, seen


def bounds(tree: Tree, found: list) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest score that any anchor below a node looks for, from (leaf, low, high)."""
    low, high = np.full(len(tree.places), np.inf), np.full(len(tree.places), -np.inf)
    for r in found:
        low[r["leaf"]], high[r["leaf"]] = r["low"], r["high"]
    for node in range(len(low) - 1, 1, -1):
        low[node >> 1], high[node >> 1] = min(low[node >> 1], low[node]), max(high[node >> 1], high[node])
    return low, high


# --- rows ---------------------------------------------------------------------------------------------------


def scaled(vector: Column, scale: float) -> Column:
    """floor(scale * component) of each component."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("int"))


def taking_part(vectors: DataFrame, vec_id: str, vector: str, label: Column, scale: float) -> DataFrame:
    """id, label and v of the rows that take part, one for each id."""
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.col(vector).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    # a null component makes its comparison null, and so the whole condition false or null
    rows = rows.where(F.forall("v", lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) < LARGEST)).select("id", "label", scaled(F.col("v"), scale).alias("v"))
    rows = written(rows, "vectors")
    if rows.groupBy("id").count().where("count > 1").isEmpty():
        return rows
    return written(rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v"), "vectors_once")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, shorter ones followed by zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], lengths)] = values[offsets[0] : offsets[-1]]
    return out


def sampled(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, labels and vectors of a bounded sample, taken by a hash of the id."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // max(1, 8 * width)))
    t = rows.orderBy(F.xxhash64("id"), "id").limit(most).toArrow()
    return t["id"].to_numpy(), t["label"].to_numpy(), matrix(t["v"], width)


def routed(rows: DataFrame, tree: Tree, width: int) -> DataFrame:
    """The rows with their leaf and the distance to its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("v"), width).astype(np.float64)
            leaf = tree.leaf_of(x)
            away = np.sqrt(((x - tree.centres[leaf]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf), pa.array(away)], [*batch.schema.names, "leaf", "away"])
        release()

    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{kinds}, leaf bigint, away double")


def summed_up(tree: Tree, rows: DataFrame) -> Tree:
    return tree.filled(rows.groupBy("leaf").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("rows")).collect())


def salted(rows: DataFrame, tree: Tree, most: int) -> DataFrame:
    """The rows with a number below the number of blocks that their leaf has."""
    blocks = F.element_at(F.lit([int(-(-n // most)) for n in tree.rows]), (F.col("leaf") + 1).cast("int"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.greatest(blocks, F.lit(1))))


def packed(rows: DataFrame, width: int, more: str = "") -> DataFrame:
    """One row for each (leaf, salt): ids in ascending order, labels, vectors, centre and radius, and the columns named in `more`."""
    extra = more.split()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = matrix(table["v"], width)
        centre = x.mean(0)
        lists = {c: [table[c].to_numpy(zero_copy_only=False).tolist() if c in ("id", "label") else table[c].to_pylist()] for c in ("id", "label", *extra)}
        return pa.table(
            {"leaf": table["leaf"][:1].cast(pa.int64()), "salt": table["salt"][:1].cast(pa.int64()), "ids": pa.array(lists["id"], pa.list_(pa.int64())), "labels": pa.array(lists["label"], pa.list_(pa.int64()))}
            | {c: pa.array(lists[c], pa.list_(pa.list_(pa.int64()))) for c in extra}
            | {"x": pa.array([x.astype("<i4").tobytes()], pa.binary()), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": pa.array([float(np.sqrt(((x - centre) ** 2).sum(1)).max())])}
        )

    extras = "".join(f", {c} array<array<bigint>>" for c in extra)
    return rows.groupBy("leaf", "salt").applyInArrow(run, f"leaf bigint, salt bigint, ids array<bigint>, labels array<bigint>{extras}, x binary, centre array<double>, radius double")


# --- scores -------------------------------------------------------------------------------------------------


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floating point where that is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if largest < 1 << 53 else a @ b.T


def first_of(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its best k allowed columns, ids ascending by column, best first; and which of the places are filled."""
    if not scores.size:
        return np.zeros((len(scores), 0), np.int64), np.zeros((len(scores), 0), bool)
    masked = np.where(allowed, scores, NONE)
    m = scores.shape[1]
    floor = np.partition(masked, m - k, axis=1)[:, m - k] if k < m else np.full(len(scores), NONE)
    near = [np.flatnonzero(row >= f) for row, f in zip(masked, floor, strict=True)]
    at, full = np.zeros((len(scores), k), np.int64), np.zeros((len(scores), k), bool)
    for r, columns in enumerate(near):
        columns = columns[masked[r, columns] > NONE]
        best = columns[np.lexsort((ids[columns], -masked[r, columns]))][:k]
        at[r, : len(best)], full[r, : len(best)] = best, True
    return at, full


def seeded(rows: DataFrame, sample: tuple, width: int, k: int, same: bool) -> DataFrame:
    """Anchors with `low` and `high` raised to what the sample shows: at least k rows of it have such a score."""
    ids, labels, x = sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, label = batch.column("id").to_numpy(), batch.column("label").to_numpy()
            scores = products(matrix(batch.column("v"), width), x)
            asked = ((labels[None, :] == label[:, None]) == same) & (ids[None, :] != own[:, None])
            low, high = (batch.column(c).to_pylist() for c in ("low", "high"))
            raised = []
            for r in range(len(own)):
                raised.append([])
                for a, b in zip(low[r], high[r], strict=True):
                    met = scores[r, asked[r] & (scores[r] >= a) & (scores[r] <= b)]
                    raised[-1].append(max(a, int(np.partition(met, len(met) - k)[len(met) - k])) if len(met) >= k else a)
            yield batch.set_column(batch.schema.get_field_index("low"), "low", pa.array(raised, pa.list_(pa.int64())))
        release()

    return rows.mapInArrow(run, rows.schema)


FOUND = "anchor_id bigint, want int, id bigint, score bigint"


def search(anchors: DataFrame, anchor_tree: Tree, blocks: DataFrame, tree: Tree, width: int, k: int, same: bool) -> DataFrame:
    """anchor_id, want, id, score, rank: for each anchor and each range [low[i], high[i]] that it looks for the first k rows of its own label (or of others)."""
    asked = anchors.where(F.size("low") > 0)
    limits = asked.groupBy("leaf").agg(F.min(F.array_min("low")).alias("low"), F.max(F.array_max("high")).alias("high")).collect()
    pairs, _ = meeting(anchor_tree, tree, *bounds(anchor_tree, limits))
    spark = anchors.sparkSession
    dealt = spark.createDataFrame([(a, c, int(-(-tree.rows[c] // BLOCK))) for a, c in pairs], "leaf bigint, to bigint, n bigint")
    groups = packed(salted(asked, anchor_tree, GROUP), width, "low high").withColumnsRenamed({"ids": "a_ids", "labels": "a_labels", "x": "a_x", "centre": "a_centre", "radius": "a_radius"}).drop("salt")
    sent = groups.join(dealt, "leaf").select(F.col("to").alias("leaf"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("salt"), "a_ids", "a_labels", "low", "high", "a_x", "a_centre", "a_radius")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                low, high = np.array(r["low"], np.int64), np.array(r["high"], np.int64)
                least, most = interval(np.array(r["a_centre"]), r["a_radius"], np.array(r["centre"]), r["radius"])
                if most < low.min() or least > high.max():
                    continue
                ids, a_ids = np.array(r["ids"]), np.array(r["a_ids"])
                scores = products(np.frombuffer(r["a_x"], "<i4").reshape(-1, width).astype(np.int64), np.frombuffer(r["x"], "<i4").reshape(-1, width).astype(np.int64))
                free = ((np.array(r["labels"])[None, :] == np.array(r["a_labels"])[:, None]) == same) & (ids[None, :] != a_ids[:, None])
                for want in range(low.shape[1]):
                    at, full = first_of(scores, ids, free & (scores >= low[:, want : want + 1]) & (scores <= high[:, want : want + 1]), k)
                    row, place = np.nonzero(full)
                    if len(row):
                        column = at[row, place]
                        yield pa.RecordBatch.from_arrays([pa.array(a_ids[row]), pa.array(np.full(len(row), want, np.int32)), pa.array(ids[column]), pa.array(scores[row, column])], ["anchor_id", "want", "id", "score"])
        release()

    found = sent.join(blocks, ["leaf", "salt"]).mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor_id", "want").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label", every: int = 100, scale: float = 256, n_positives: int = 5, n_negatives: int = 5, least: tuple[int, int] = (80, 100),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id is divisible by `every`; a negative's score
    is at least least[0] / least[1] of the positive's and at most that."""
    spark = vectors.sparkSession
    small_batches(spark, 4 << 20)
    rows = taking_part(vectors, vec_id, vector, F.col(label) if isinstance(label, str) else label, scale)
    width = max(1, rows.agg(F.max(F.size("v"))).first()[0] or 1)
    own = rows.where(F.col("id") % every == 0)
    sample, anchor_sample = sampled(rows, width), sampled(own, width)
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("id") % every == 0, 1)).alias("anchors")).first()
    tree = Tree.grown(sample[2].astype(np.float64), min(LEAVES, -(-counts["rows"] // BLOCK)))
    anchor_tree = Tree.grown(anchor_sample[2].astype(np.float64), min(LEAVES, -(-counts["anchors"] // GROUP)))
    leaved = written(routed(rows, tree, width), "vectors_leaved")
    summed_up(tree, leaved)
    blocks = written(packed(salted(leaved, tree, BLOCK), width), "vector_blocks")
    anchors = written(routed(own, anchor_tree, width), "anchors_leaved")
    summed_up(anchor_tree, anchors)
    # every score is a long, so the first search is open on both sides
    wide = anchors.withColumn("low", F.array(F.lit(-(1 << 62)))).withColumn("high", F.array(F.lit(1 << 62)))
    wide = written(seeded(wide, sample, width, n_positives, True), "anchors_seeded")
    positives = written(search(wide, anchor_tree, blocks, tree, width, n_positives, True), "positives")
    worth = positives.where("score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("p"))
    up = lambda n: (n + F.pmod(-n, F.lit(least[1]))) / least[1]
    ceiling = lambda s: up(s * least[0]).cast("bigint")
    # a missing positive's range is empty, so that all anchors of a group look for equally many
    filled = lambda f, none: F.transform(F.sequence(F.lit(1), F.lit(n_positives)), lambda i: F.when(i <= F.size("p"), f(F.element_at("p", F.least(i, F.size("p")))["score"])).otherwise(F.lit(none)))
    narrow = anchors.join(worth, anchors["id"] == worth["anchor_id"]).drop("anchor_id")
    narrow = narrow.withColumn("low", filled(ceiling, 1 << 62)).withColumn("high", filled(lambda s: s, -(1 << 62))).drop("p")
    narrow = written(seeded(narrow, sample, width, n_negatives, False), "anchors_narrow")
    negatives = search(narrow, anchor_tree, blocks, tree, width, n_negatives, False)
    pairs = positives.select("anchor_id", (F.col("rank") - 1).alias("want"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(pairs, ["anchor_id", "want"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
