"""Exact top-k by inner product: an impact-ordered, score-at-a-time index.

Every component of a vector is a posting of its dimension with an integer impact, its size. An index block, built once and stored, keeps
for each dimension the postings in descending impact, cut into segments at the powers of two, and the largest impact of each segment. A
query takes segments in descending order of what they can add (its own component times the segment's impact), round by round. After
a round the unread rest of every score is bounded by the sum of the query's components times the largest unread impacts. The query
stops when at most a few candidates can reach the k-th best lower bound, or the score of the k-th best of the first block that was
read; these are rescored exactly. Blocks whose longest vector cannot reach it are not read at all. Vectors are put into blocks in
descending length, so that skewed lengths leave most blocks unread. All sums are integers below 2**53, so bounds are proofs; where
components are too large for that, nothing is skipped and scores are added up exactly.

The queries of a block read an index block together: they take its segments level by level, in falling impact, and a level's segments
are added up as one product in floats that hold every sum exactly. How far they must read is told by the lengths of what the rows hold
below each level; rows that can still reach their query's floor are rescored. Where hardly any posting has to be read, each query
reads its own, as above.

Query blocks visit index blocks through a join on the block's number: a stated query set against all rows, in blocks. A task merges
what its pairs of blocks find and raises the floors by it; only k rows a query leave it.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do rows
without an id; ties go to the smaller id; repeated ids are candidates as often as they occur, but never for a query of
their own id, and ask once, with the least of their vectors; vectors of different lengths are compared over the common dimensions; extra columns are ignored; an empty table gives no rows. Scores must fit in 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.llm.common import materialize
from stowage.llm.strings import ranges

BLOCK = 16384  # vectors of an index block
QUERIES = 4096  # queries of a query block
TILE = 1 << 21  # scores of a product
HELD = 64  # query blocks whose best rows a task holds
NO_FLOOR = -(1 << 63)
LEVELS = 64
BLOCK_SCHEMA = "block long, n int, dims int, longest double, ids binary, vectors binary, docs binary, edges binary, tops binary, rests binary"
PAIR_COLUMNS = ("q_block", "q_n", "q_dims", "q_ids", "q_vectors", "floors", "n", "dims", "longest", "ids", "vectors", "docs", "edges", "tops", "rests")
EXACT = 2**53
EXACT_FLOAT32 = 2**24
FEW = 512  # a posting read by itself costs as much as so many in a product


def levels(x: np.ndarray) -> np.ndarray:
    """Each component's segment: the bits of its impact."""
    size = np.abs(x)
    bits = np.zeros(x.shape, np.uint8)
    for k in range(int(size.max(initial=0)).bit_length()):
        bits += size >= 1 << k
    return bits


def segments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the vectors ``x``: rows by dimension and falling impact, the segments' edges, each segment's largest impact, and for each
    level the largest length of what a row holds below it.

    Segment s of a dimension holds impacts of s bits, so the highest come first from the back; zeros are no postings.
    """
    size, bits = np.abs(x), levels(x)
    narrow = size.astype(np.int16) if size.max(initial=0) < 1 << 15 else size
    docs = np.argsort(-narrow, axis=0, kind="stable").T.astype(np.uint16 if len(x) <= 1 << 16 else np.uint32)
    edges = np.zeros((x.shape[1], LEVELS + 1), np.int64)  # postings above each level
    tops = np.zeros((x.shape[1], LEVELS), np.int64)
    rests = np.zeros(LEVELS + 1)
    squares = x.astype(float) ** 2
    edges[:, 0] = len(x)
    for level in range(1, int(bits.max(initial=0)) + 1):
        edges[:, level] = (bits >= level).sum(axis=0)
        tops[:, level] = np.where(bits == level, size, 0).max(axis=0, initial=0)
    for level in range(1, LEVELS + 1):
        if level > int(bits.max(initial=0)) + 1:
            rests[level] = rests[level - 1]
            continue
        rests[level] = np.sqrt(np.where(bits < level, squares, 0).sum(axis=1).max(initial=0))
    return docs, edges, tops, rests


def by_length(lists: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, rows, matrix) for each number of components."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    sizes, flat = np.diff(offsets), lists.values.to_numpy()
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield dims, rows, flat[(offsets[rows][:, None] + np.arange(dims)).ravel()].reshape(len(rows), dims)


def narrowest(x: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest integers that hold them."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def matrix(stored: bytes, n: int, dims: int) -> np.ndarray:
    """What ``narrowest`` wrote, in 64 bits."""
    return np.frombuffer(stored, f"<i{len(stored) // (n * dims)}").reshape(n, dims).astype(np.int64)


def pack_blocks(vectors: DataFrame, rows: int, index: bool = True) -> DataFrame:
    """Blocks of at most ``rows`` vectors (id, ints), numbered without gaps inside each split, the longest vectors first; by id inside a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            parts = [p.tobytes() for p in segments(x)] if index else [None] * 4
            values = [number - 1, len(ids), x.shape[1], float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max()), ids.astype("<i8").tobytes(), narrowest(x).tobytes(), *parts]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], [c.strip().split(" ")[0] for c in BLOCK_SCHEMA.split(", ")])

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for dims, at, x in by_length(batch.column(1)):
                own = held.setdefault(dims, [])
                own.append((ids[at], narrowest(x)))
                while sum(len(i) for i, _ in own) >= rows:
                    ids_, x_ = np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
                    yield block(ids_[:rows], x_[:rows].astype(np.int64))
                    own[:] = [(ids_[rows:], x_[rows:])] if len(ids_) > rows else []
        for own in held.values():
            if own:
                yield block(np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]).astype(np.int64))

    length = F.aggregate("ints", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return vectors.select("id", "ints").sortWithinPartitions(length.desc(), "id").mapInArrow(run, BLOCK_SCHEMA)


@dataclass
class Block:
    """An index block as it is searched."""

    ids: np.ndarray
    x: np.ndarray
    docs: np.ndarray
    edges: np.ndarray
    tops: np.ndarray
    rests: np.ndarray
    longest: float

    @classmethod
    def of(cls, ids: np.ndarray, x: np.ndarray) -> Block:
        return cls(ids, x, *segments(x), float(np.sqrt((x.astype(float) ** 2).sum(axis=1)).max(initial=0)))

    @classmethod
    def read(cls, r: dict) -> Block:
        n, dims = r["n"], r["dims"]
        kind = np.uint16 if n <= 1 << 16 else np.uint32
        whole = lambda name, t, shape: np.frombuffer(r[name], t).reshape(shape)
        x = matrix(r["vectors"], n, dims)
        return cls(np.frombuffer(r["ids"], "<i8"), x, whole("docs", kind, (dims, n)), whole("edges", np.int64, (dims, LEVELS + 1)), whole("tops", np.int64, (dims, LEVELS)), whole("rests", float, LEVELS + 1), r["longest"])


def search(q_id: int, q: np.ndarray, block: Block, k: int, floor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, postings read) of the k best rows of the block for a query, ties to the smaller id.

    Rows that score below ``floor`` may be left out: k rows elsewhere reach it.
    """
    dims, n = min(len(q), block.x.shape[1]), len(block.ids)
    q, weight = q[:dims], np.abs(q[:dims])
    largest = block.tops[:dims].max(axis=1)
    reach = int(sum(int(w) * int(t) for w, t in zip(weight, largest, strict=True)))  # no score is larger
    others = block.ids != q_id
    if floor is not None and (reach < floor or np.sqrt((q.astype(float) ** 2).sum()) * block.longest * (1 + 1e-9) + 1 < floor):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    if reach >= EXACT:  # no bound is trusted: every row is scored in whole numbers
        at = np.flatnonzero(others)
        scores = np.array([sum(int(a) * int(b) for a, b in zip(q, row, strict=True)) for row in block.x[at][:, :dims]], object)
        order = np.lexsort((block.ids[at], np.array([-v for v in scores], object).astype(np.int64)))[:k]
        return block.ids[at][order], scores[order].astype(np.int64), n * dims
    partial, read, x = np.zeros(n), 0, block.x
    power = weight[:, None] * block.tops[:dims]  # what a segment can add
    taken = np.zeros(power.shape, bool)
    step = int(power.max(initial=0))
    while True:
        fresh = (power >= max(step, 1)) & ~taken
        dim, level = np.nonzero(fresh)
        taken |= fresh
        if len(dim):
            begins = block.edges[dim, level + 1]
            sizes = block.edges[dim, level] - begins
            docs = block.docs.ravel()[ranges(begins + dim * n, sizes)].astype(np.int64)
            of = np.repeat(dim, sizes)
            partial += np.bincount(docs, (q[of] * x[docs, of]).astype(float), n)
            read += len(docs)
        rest = float((np.where(taken, 0, power).max(axis=1, initial=0)).sum())
        lower = np.where(others, partial - rest, -np.inf)
        bound = np.partition(lower, n - k)[n - k] if n > k else -np.inf
        if floor is not None:
            bound = max(bound, floor)
        possible = others & (partial + rest >= bound)
        if rest == 0 or possible.sum() <= 2 * k:
            break
        step //= 4
    at = np.flatnonzero(possible)
    scores = x[at][:, :dims] @ q
    order = np.lexsort((block.ids[at], -scores))[:k]
    return block.ids[at][order], scores[order], read


def best_rows(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, ties to the smaller id; in the order of rows and ranks."""
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    first = np.flatnonzero(np.diff(row, prepend=-1))
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    return row[rank < k], ids[rank < k], scores[rank < k]


def search_all(q_ids: np.ndarray, q: np.ndarray, block: Block, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, id, score) of at least the k best rows of the block for each of the queries that reach their floor.

    Segments are read for all queries together, in falling order of their impacts, as one product with the rows' components of these
    segments. Levels are read until what the rows hold below them, by their length, adds little to the floors; rows that can reach their
    floor are rescored. Few postings are read one by one (``search``). Of evenly spread vectors all levels are read, and scores are whole.
    """
    dims = min(q.shape[1], block.x.shape[1])
    x = block.x[:, :dims]
    q = q[:, :dims]
    norms = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    asked = np.flatnonzero((floors == NO_FLOOR) | (norms * block.longest * (1 + 1e-9) + 1 >= floors))
    if not len(asked):
        return (np.zeros(0, np.int64),) * 3
    widest = np.maximum(q.max(axis=0, initial=0).astype(object), -(q.min(axis=0, initial=0).astype(object)))
    reach = int(sum(int(w) * int(t) for w, t in zip(widest, block.tops[:dims].max(axis=1), strict=True)))
    least = floors[asked].min()
    level = 0
    if least > 0:
        light = norms[asked].max() * block.rests <= least / 4
        level = int(np.flatnonzero(light).max())  # rests[0] is 0
    postings = int(block.edges[:dims, max(level, 1)].sum())
    if reach >= EXACT or level > 1 and postings * FEW <= len(x) * dims:
        found = [(at, *search(int(q_ids[at]), q[at], block, k, None if floors[at] == NO_FLOOR else int(floors[at]))[:2]) for at in asked.tolist()]
        return np.repeat(asked, [len(ids) for _, ids, _ in found]), np.concatenate([ids for _, ids, _ in found]), np.concatenate([s for _, _, s in found])
    kind = np.float32 if reach < EXACT_FLOAT32 else np.float64
    some = np.flatnonzero(block.edges[:dims, max(level, 1)])  # dimensions with such segments
    part = x[:, some]
    if level > 1:
        part = np.where(levels(part) >= level, part, 0)
    part = part.T.astype(kind, order="C")
    slack = norms * block.rests[level] * (1 + 1e-6) + 1 if level > 1 else np.zeros(len(q))
    own = np.searchsorted(block.ids, q_ids, "left"), np.searchsorted(block.ids, q_ids, "right")
    rows, ids, scores = [], [], []
    step = max(1, TILE // len(x))
    for begin in range(0, len(asked), step):
        at = asked[begin : begin + step]
        sums = q[at][:, some].astype(kind) @ part
        for i in np.flatnonzero(own[1][at] > own[0][at]).tolist():
            sums[i, own[0][at[i]] : own[1][at[i]]] = -np.inf
        least_sum = np.where(floors[at] == NO_FLOOR, -float(EXACT), floors[at] - slack[at])
        if len(x) > k:
            for i in np.flatnonzero(floors[at] == NO_FLOOR).tolist():
                least_sum[i] = max(least_sum[i], float(np.partition(sums[i], len(x) - k)[len(x) - k]) - 2 * slack[at[i]])
        reached = sums >= np.floor(least_sum).astype(kind)[:, None]  # sums are whole; a rounded bound only falls
        if level <= 1:
            counts = reached.sum(axis=1)
            for i in np.flatnonzero(counts > 8 * k).tolist():  # many copies: of equal scores the first ids
                bound = np.partition(sums[i], len(x) - k)[len(x) - k]
                above = np.flatnonzero(sums[i] > bound)
                reached[i] = False
                reached[i, above] = True
                reached[i, np.flatnonzero((sums[i] == bound) & (bound > -np.inf))[: k - len(above)]] = True
        i, j = np.nonzero(reached)
        if level > 1:
            parts = [np.einsum("ij,ij->i", q[at[i[o : o + TILE // 64]]], x[j[o : o + TILE // 64]]) for o in range(0, len(i), TILE // 64)]
            exact = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            kept = (exact >= floors[at][i]) & (sums[i, j] > -np.inf)
            i, j, exact = i[kept], j[kept], exact[kept]
        else:
            exact = sums[i, j].astype(np.int64)
        rows.append(at[i])
        ids.append(block.ids[j])
        scores.append(exact)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def integers(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, ints): floor(scale * component) of the rows that take part."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ints = F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long"))
    return vectors.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole).select(F.col(key).cast("long").alias("id"), ints.alias("ints"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, id, score): the ``k`` best other rows for each row where ``is_query`` holds."""
    index = materialize(pack_blocks(integers(vectors, key, vector, scale), BLOCK), "topk-index")
    asked = integers(vectors.where(is_query), key, vector, scale).groupBy("id").agg(F.min("ints").alias("ints"))
    queries = pack_blocks(asked, QUERIES, index=False)
    queries = materialize(queries.select(F.col("block").alias("q_block"), *[F.col(c).alias(f"q_{c}") for c in ("n", "dims", "ids", "vectors")]), "topk-queries")

    def pairs(queries: DataFrame, numbers: DataFrame) -> DataFrame:
        """An equi-join of block rows: each query block with the index blocks of these numbers."""
        listed = numbers.agg(F.array_sort(F.collect_list("block")).alias("blocks"))  # one number a block
        return queries.withColumn("block", F.explode(listed.scalar())).join(index.hint("shuffle_hash"), "block").select(*PAIR_COLUMNS)

    def asked_of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        given = np.frombuffer(r["floors"], "<i8") if r["floors"] else np.full(r["q_n"], NO_FLOOR)
        return np.frombuffer(r["q_ids"], "<i8"), matrix(r["q_vectors"], r["q_n"], r["q_dims"]), given

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield batch.slice(at, 1).to_pylist()[0]

    def kth(n: int, row: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The k-th best score of each of n rows, in their order of ranks; of fewer no floor."""
        out = np.full(n, NO_FLOOR)
        first = np.searchsorted(row, np.arange(n))
        full = np.searchsorted(row, np.arange(n), "right") - first >= k
        out[full] = scores[first[full] + k - 1]
        return out

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            q_ids, q, given = asked_of(r)
            row, _, scores = best_rows(*search_all(q_ids, q, Block.read(r), k, given), k)
            yield pa.RecordBatch.from_arrays([pa.array([r["q_block"]]), pa.array([kth(len(q), row, scores).astype("<i8").tobytes()])], ["q_block", "floors"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # query block: its ids, rows, found ids, scores

        def rows(q_ids: np.ndarray, row: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (q_ids[row], ids, scores)], ["query_id", "id", "score"])

        for r in one_by_one(batches):
            q_ids, q, given = asked_of(r)
            before = held.pop(r["q_block"], (q_ids, *[np.zeros(0, np.int64)] * 3))
            found = search_all(q_ids, q, Block.read(r), k, np.maximum(given, kth(len(q), before[1], before[3])))
            held[r["q_block"]] = (q_ids, *best_rows(*(np.concatenate(c) for c in zip(before[1:], found, strict=True)), k))
            if len(held) > HELD:
                yield rows(*held.pop(next(iter(held))))
        for own in held.values():
            yield rows(*own)

    # the k-th best of one block is a floor for all others
    head = index.agg(F.max_by("block", F.struct(F.col("n") > k, "longest", "block")).alias("block")).where("block is not null")
    unknown = queries.withColumn("floors", F.lit(None).cast("binary"))
    first = unknown.crossJoin(F.broadcast(index.join(F.broadcast(head), "block", "left_semi"))).select(*PAIR_COLUMNS).mapInArrow(floors, "q_block long, floors binary")
    best = pairs(queries.join(first, "q_block", "left"), index.select("block")).mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
