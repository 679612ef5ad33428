"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A row's score is its inner product with an anchor. With one more component, which gives every row
the largest norm M and every anchor a zero, the squared distance is ``M^2 + |anchor|^2 - 2 score``: high
scores are short distances, and a window of scores is an annulus around the anchor.

The index has two levels. A small tree over a bounded sample cuts the space into cells; every row is
routed to its cell, and cells are cut into pages of about ``PAGE`` rows (rows of equal place, however
many, are dealt to pages by a hash of their id). Each page holds a tree of its own. Pages are stored
once and dealt to slots, a bounded number of pages each, and anchors travel to slots in blocks.

A search goes nearest first, in two rounds: to the slot of the cell nearest to the annulus's inner
radius, then, with the k-th best of that as a bound, to the slots of all cells that the bound and the annulus don't
exclude. Inside a page, every anchor of a block takes its next nearest leaf in turn, until leaves begin beyond its k-th
row or the outer radius. Scores are exact integers in double precision; distances only
exclude, with a margin for rounding, so the result is that of a search of all rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm.common import discard, materialize, python_ready, table

SCALE = 256
#: Rows that the upper tree is built from at most, and its depth at most (256 cells).
SAMPLE, DEPTH = 2_048, 8
#: Rows of a page and of a leaf, about; pages that a task holds at most.
PAGE, LEAF, SLOT_PAGES = 1_024, 64, 64
#: Bytes of vectors that one shipped block of queries holds, about.
BLOCK_BYTES = 128 << 10
#: Norms whose squares reach this can't be scored exactly.
EXACT = 2**53
#: A null id: after all others in ties.
NO_ID = 2**63 - 1
_NONE = -(2.0**62)


class Tree(NamedTuple):
    """A complete binary tree: node k has the children 2k + 1 and 2k + 2. ``low`` and ``high`` are each child's range of distances from its parent's vantage point."""

    depth: int
    points: np.ndarray
    tops: np.ndarray
    low: np.ndarray
    high: np.ndarray
    middle: np.ndarray


def augmented(vectors: np.ndarray, square: float) -> np.ndarray:
    """The component that gives each row a norm whose square is ``square``."""
    return np.sqrt(np.maximum(0.0, square - np.einsum("ij,ij->i", vectors, vectors)))


def distances(vectors: np.ndarray, tops: np.ndarray, tree: Tree, square: float) -> np.ndarray:
    """Of rows (or of queries, whose squared norms aren't ``square``) from all vantage points."""
    own = np.einsum("ij,ij->i", vectors, vectors) + tops**2
    return np.sqrt(np.maximum(0.0, own[:, None] + square - 2 * (vectors @ tree.points.T + tops[:, None] * tree.tops[None, :])))


def grow(vectors: np.ndarray, depth: int, square: float) -> tuple[Tree, np.ndarray]:
    """A tree over rows, and the leaf of each. A vantage point is the row farthest from its node's first; half of a node's rows are within the median."""
    tops, nodes, width = augmented(vectors, square), (1 << depth) - 1, vectors.shape[1]
    points, own = np.zeros((nodes, width)), np.zeros(nodes)
    low, high, middle = np.zeros(2 * nodes + 1), np.full(2 * nodes + 1, np.inf), np.zeros(nodes)
    place = np.zeros(len(vectors), dtype=np.int64)
    for node in range(nodes):
        mine = np.flatnonzero(place == node)
        if not len(mine):
            continue
        ahead = vectors[mine] @ vectors[mine[0]] + tops[mine] * tops[mine[0]]
        vantage = mine[np.argmin(ahead)]
        points[node], own[node] = vectors[vantage], tops[vantage]
        away = np.sqrt(np.maximum(0.0, 2 * square - 2 * (vectors[mine] @ points[node] + tops[mine] * own[node])))
        middle[node] = np.median(away)
        inner = away <= middle[node]
        for child, part in ((2 * node + 1, inner), (2 * node + 2, ~inner)):
            place[mine[part]] = child
            low[child], high[child] = (away[part].min(), away[part].max()) if part.any() else (np.inf, -np.inf)
    return Tree(depth, points, own, low, high, middle), place - nodes


def open_ended(tree: Tree) -> Tree:
    """The same cuts, with ranges that hold for rows that the tree wasn't built from."""
    low, high = np.zeros_like(tree.low), np.full_like(tree.high, np.inf)
    inner = np.arange(1, len(low), 2)
    high[inner], low[inner + 1] = tree.middle, tree.middle
    return tree._replace(low=low, high=high)


def cells_of(vectors: np.ndarray, tree: Tree, square: float) -> np.ndarray:
    place = np.zeros(len(vectors), dtype=np.int64)
    away = distances(vectors, augmented(vectors, square), tree, square)
    for _ in range(tree.depth):
        place = 2 * place + 1 + (away[np.arange(len(place)), place] > tree.middle[place])
    return place - (1 << tree.depth) + 1


def ranges(away: np.ndarray, tree: Tree, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """For each query (row) and leaf: distances between which all of the leaf's rows are."""
    least, most = np.zeros((len(away), 1)), np.full((len(away), 1), np.inf)
    for level in range(tree.depth):
        first = (1 << level) - 1
        from_vantage = np.repeat(away[:, first : 2 * first + 1], 2, axis=1)
        children = slice(2 * first + 1, 4 * first + 3)
        least = np.maximum(np.repeat(least, 2, axis=1), np.maximum(tree.low[children] - from_vantage, from_vantage - tree.high[children]))
        most = np.minimum(np.repeat(most, 2, axis=1), from_vantage + tree.high[children])
    return least - slack, most + slack


class Block(NamedTuple):
    """Queries: ``lows`` and ``highs`` are score windows; ``known`` and ``known_id`` the k-th best so far."""

    keys: np.ndarray
    subs: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lows: np.ndarray
    highs: np.ndarray
    known: np.ndarray
    known_id: np.ndarray

    def take(self, rows: np.ndarray) -> Block:
        return Block(*(x[rows] for x in self))

    def radii(self, square: float) -> tuple[np.ndarray, np.ndarray]:
        """Inner and outer: the outer one is where the window ends or the k-th best lies."""
        own = np.einsum("ij,ij->i", self.vectors, self.vectors) + square
        return np.sqrt(np.maximum(0.0, own - 2 * self.highs)), np.sqrt(np.maximum(0.0, own - 2 * np.maximum(self.lows, self.known)))


class Page(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    starts: np.ndarray
    tree: Tree


def make_page(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, square: float) -> Page:
    """A page of the different rows among these, by leaf."""
    _, first = np.unique(np.column_stack([ids, labels, vectors.astype(np.int64)]), axis=0, return_index=True)
    ids, labels, vectors = ids[first], labels[first], vectors[first].astype(np.float64)
    depth = max(0, math.ceil(math.log2(len(ids) / LEAF)))
    tree, leaf = grow(vectors, depth, square)
    order = np.argsort(leaf, kind="stable")
    return Page(ids[order], labels[order], vectors[order].astype(np.int32), np.searchsorted(leaf[order], np.arange((1 << depth) + 1)), tree)


def pieces(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Rows in parts whose vectors have about ``BLOCK_BYTES``: rows of megabytes would gather in writers', readers' and sorters' buffers, which count rows."""
    step = max(1, BLOCK_BYTES // (4 * width))
    for k in range(0, len(rows), step):
        yield rows[k : k + step]


def search(page: Page, block: Block, scores: np.ndarray, ids: np.ndarray, same: bool, square: float) -> None:
    """Puts the page's rows into each query's best ones (``scores``, ``ids``: best first), nearest leaf first."""
    vectors, slack, k = page.vectors.astype(np.float64), margin(square), scores.shape[1]
    away = distances(block.vectors, np.zeros(len(block.ids)), page.tree, square)
    least, most = ranges(away, page.tree, slack)
    inner, outer = block.radii(square)
    least[(most < inner[:, None]) | (least > outer[:, None])] = np.inf
    order = np.argsort(least, axis=1)
    own = np.einsum("ij,ij->i", block.vectors, block.vectors) + square
    active = np.arange(len(block.ids))
    for turn in range(order.shape[1]):
        reach = np.sqrt(np.maximum(0.0, own[active] - 2 * np.maximum(scores[active, k - 1], _NONE))) + slack
        start = least[active, order[active, turn]]
        active = active[np.isfinite(start) & (start <= reach)]
        if not len(active):
            return
        leaves = order[active, turn]
        for leaf in np.unique(leaves):
            mine, rows = active[leaves == leaf], slice(page.starts[leaf], page.starts[leaf + 1])
            found = block.vectors[mine] @ vectors[rows].T
            fits = (page.labels[rows] == block.labels[mine, None]) == same
            fits &= page.ids[rows] != block.ids[mine, None]
            fits &= (found >= block.lows[mine, None]) & (found <= block.highs[mine, None]) & (found >= scores[mine, k - 1 : k])
            fits &= (found > block.known[mine, None]) | ((found == block.known[mine, None]) & (page.ids[rows] < block.known_id[mine, None]))
            if not (some := fits.any(axis=1)).any():
                continue
            mine = mine[some]
            every = np.concatenate([scores[mine], np.where(fits[some], found[some], _NONE)], axis=1)
            names = np.concatenate([ids[mine], np.broadcast_to(page.ids[rows], (len(mine), rows.stop - rows.start))], axis=1)
            best = np.lexsort((names, -every), axis=1)[:, :k]
            scores[mine], ids[mine] = np.take_along_axis(every, best, 1), np.take_along_axis(names, best, 1)


def margin(square: float) -> float:
    """What rounding may add to a distance, several times over."""
    return 4e-6 * math.sqrt(square) + 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers, shorter ones filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == width).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)
    out = np.zeros((len(column), width))
    for k, x in enumerate(column):
        out[k, : lengths[k]] = x.as_py()
    return out


class Index(NamedTuple):
    """What every task needs to know: bounded by ``DEPTH``, not by the rows."""

    pages: DataFrame
    width: int
    square: float
    tree: Tree
    first_page: list[int]
    slots: int

    def slot(self, page: int) -> int:
        return page * self.slots // self.first_page[-1]


def build_index(rows: DataFrame) -> Index | None:
    """The pages of all ``rows`` (``vec_id``, ``label``, ``vec``: integers, ``square``); nothing if there are none."""
    spark = rows.sparkSession
    count, square, width = rows.agg(F.count("*"), F.max("square"), F.max(F.size("vec"))).first()
    if not count:
        return None
    if square >= EXACT:
        raise ValueError(f"a vector's squared norm is {square:.3g}; scores are exact below 2^53")
    square, width = float(square) or 1.0, max(1, width)
    sample = rows.select("vec").orderBy(F.xxhash64("vec_id"), "vec").limit(SAMPLE).toArrow()["vec"].combine_chunks()
    vectors = _matrix(sample, width)
    tree = open_ended(grow(vectors, min(DEPTH, max(0, math.ceil(math.log2(count / PAGE)))), square)[0])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _matrix(batch.column(2), width)
            yield pa.RecordBatch.from_arrays([pa.array(cells_of(found, tree, square), pa.int32()), *batch.columns[:2], pa.array([x.tobytes() for x in found.astype("<i4")], pa.binary())], names=["cell", "vec_id", "label", "body"])

    routed = materialize(python_ready(rows).select("vec_id", "label", "vec").mapInArrow(route, "cell int, vec_id long, label int, body binary"), "routed")
    sizes = dict(routed.groupBy("cell").count().collect())
    first = [0]
    for cell in range(1 << tree.depth):
        first.append(first[-1] + math.ceil(sizes.get(cell, 0) / PAGE))
    places = spark.createDataFrame([(k, first[k], first[k + 1] - first[k]) for k in range(1 << tree.depth) if k in sizes], "cell int, first int, pages int")
    paged = routed.join(F.broadcast(places), "cell").withColumn("page", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("pages")).cast("int"))

    def bind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, parts = None, []

        def bound() -> Iterator[pa.RecordBatch]:
            if parts:
                rows = pa.Table.from_batches(parts)
                ids, labels = rows["vec_id"].fill_null(NO_ID).to_numpy(), rows["label"].to_numpy()
                found = np.frombuffer(b"".join(rows["body"].to_pylist()), dtype="<i4").reshape(len(ids), width)
                body = pickle.dumps(make_page(ids, labels, found, square))
                yield pa.RecordBatch.from_arrays([pa.array([page], pa.int32()), pa.array([body], pa.binary())], names=["page", "body"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            for part in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                if not len(part):
                    continue
                if numbers[part[0]] != page:
                    yield from bound()
                    page, parts = int(numbers[part[0]]), []
                parts.append(batch.slice(part[0], len(part)).select([1, 2, 3]))
        yield from bound()

    pages = paged.select("page", "vec_id", "label", "body").repartition("page").sortWithinPartitions("page").mapInArrow(bind, "page int, body binary")
    pages = materialize(pages, "pages")
    discard(routed)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = min(first[-1], max(wanted, math.ceil(first[-1] / SLOT_PAGES)))
    return Index(pages, width, square, tree, first, slots)


def _round(index: Index, queries: DataFrame, *, first: bool, same: bool, k: int) -> DataFrame:
    """(``key``, ``sub``, ``score``, ``found``): up to ``k`` rows a query and slot, from the nearest slot or from all others.

    ``queries``: ``key``, ``sub``, ``vec_id``, ``label``, ``vec``, ``low``, ``high``, ``known``, ``known_id``.
    """
    pages, width, square, tree, first_page, slots = index
    cell_slots = [sorted({index.slot(p) for p in range(first_page[c], first_page[c + 1])}) if first_page[c + 1] - first_page[c] <= 4 * SLOT_PAGES else list(range(index.slot(first_page[c]), index.slot(first_page[c + 1] - 1) + 1)) for c in range(1 << tree.depth)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(x).to_numpy(zero_copy_only=False) for x in (0, 1, 2, 3, 5, 6, 7, 8)]
            block = Block(*numbers[:4], _matrix(batch.column(4), width), *(x.astype(np.float64) for x in numbers[4:7]), numbers[7])
            least, most = ranges(distances(block.vectors, np.zeros(len(block.ids)), tree, square), tree, margin(square))
            inner, outer = block.radii(square)
            open_cells = np.array([bool(x) for x in cell_slots]) & (most >= inner[:, None])
            # the nearest cell doesn't depend on what is known, so both rounds agree on it
            near = np.where(open_cells, np.maximum(least, inner[:, None]), np.inf)
            home_cell = near.argmin(axis=1)
            home = np.array([cell_slots[c][int(key) % len(cell_slots[c])] if cell_slots[c] else -1 for c, key in zip(home_cell, block.keys, strict=True)])
            reached = open_cells & (least <= outer[:, None])
            shipped = block._replace(vectors=block.vectors.astype(np.int32))
            for slot in range(slots):
                if first:
                    rows = np.flatnonzero(home == slot)
                else:
                    mine = [c for c, x in enumerate(cell_slots) if x and x[0] <= slot <= x[-1]]
                    rows = np.flatnonzero(reached[:, mine].any(axis=1) & (home != slot))
                for part in pieces(rows, width):
                    yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([1], pa.int32()), pa.array([pickle.dumps(shipped.take(part))], pa.binary())], names=["slot", "kind", "body"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, []
        for batch in batches:
            for own, kind, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != slot:
                    slot, held = own, []
                if kind == 0:
                    held.append(pickle.loads(body.as_py()))
                    continue
                block = pickle.loads(body.as_py())
                block = block._replace(vectors=block.vectors.astype(np.float64))
                scores, ids = np.full((len(block.ids), k), _NONE), np.full((len(block.ids), k), NO_ID)
                for page in held:
                    search(page, block, scores, ids, same, square)
                row, column = np.nonzero(scores > _NONE)
                found = pa.array(ids[row, column], pa.int64(), mask=ids[row, column] == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array(block.keys[row]), pa.array(block.subs[row], pa.int32()), pa.array(scores[row, column].astype(np.int64)), found], names=["key", "sub", "score", "found"])

    columns = ["key", "sub", "vec_id", "label", "vec", "low", "high", "known", "known_id"]
    asked = python_ready(queries.select(*columns)).mapInArrow(deal, "slot int, kind int, body binary")
    asked = materialize(asked, "asked")
    own = pages.select((F.col("page").cast("long") * slots / first_page[-1]).cast("int").alias("slot"), F.lit(0).alias("kind"), "body")
    own = own.join(asked.select("slot").distinct(), "slot", "left_semi")
    return own.union(asked).repartition("slot").sortWithinPartitions("slot", "kind").mapInArrow(meet, "key long, sub int, score long, found long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("key", "sub").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(index: Index, queries: DataFrame, *, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows of each query (``key``, ``sub``), with their ``rank``: rows of its label or of other labels, by score, then id."""
    fresh = queries.withColumns({"known": F.lit(int(_NONE)), "known_id": F.lit(NO_ID)})
    near = materialize(_round(index, fresh, first=True, same=same, k=k), "near")
    last = _best(near, k).filter(F.col("rank") == k).select("key", "sub", F.col("score").alias("known"), F.coalesce("found", F.lit(NO_ID)).alias("known_id"))
    again = queries.join(last, ["key", "sub"], "left").withColumns({"known": F.coalesce("known", F.lit(int(_NONE))), "known_id": F.coalesce("known_id", F.lit(NO_ID))})
    return _best(near.union(_round(index, again, first=False, same=same, k=k)), k)


def usable(rows: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(``vec_id``, ``label``, ``vec``, ``square``) of the rows that take part, their components scaled and floored."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.filter(F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
    scaled = F.transform(vec_col, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    found = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), scaled.alias("vec"))
    return found.withColumn("square", F.aggregate("vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x))


def hard_negatives(rows: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """For each anchor and positive of ``rows`` (from ``usable``): its best rows of other labels whose score is ``low`` percent of the positive's or more, and no more than it.

    Anchors are the rows whose id is divisible by ``every``. Rows that repeat id, label and vector count
    once; an id of different rows is as many rows (and anchors), and an anchor's other rows are those of
    other ids. A row without an id is no anchor, and comes last among equal scores. Shorter vectors
    count as if filled with zeros. An anchor without positives, or without negatives in a window,
    gives no rows; nor does an empty table. Squared norms must stay below 2^53.
    """
    spark = rows.sparkSession
    rows = materialize(rows, "vectors")
    index = build_index(rows)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "label", "vec").distinct()
    anchors = materialize(anchors.withColumn("key", F.abs(F.xxhash64("vec_id", "label", "vec") % (1 << 62))), "anchors")
    wide = {"sub": F.lit(0), "low": F.lit(int(_NONE)), "high": F.lit(-int(_NONE))}
    good = materialize(nearest(index, anchors.withColumns(wide), same=True, k=positives), "positives")
    good = good.select("key", F.col("rank").alias("sub"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = good.filter("positive_score >= 0").join(anchors, "key")
    windows = windows.withColumns({"low": F.ceil(F.col("positive_score") * low / F.lit(100).cast("decimal(3,0)")).cast("long"), "high": F.col("positive_score")})
    bad = nearest(index, windows.select("key", "sub", "vec_id", "label", "vec", "low", "high"), same=False, k=negatives)
    named = windows.select("key", "sub", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score")
    out = bad.join(named, ["key", "sub"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable(table(spark, sf_dir, "embeddings"))
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved)


OP11_SQL = """
WITH kept AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS INTEGER) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.vec, b.vec) AS BIGINT) AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id)
QUALIFY row_number() OVER w <= 5
"""
