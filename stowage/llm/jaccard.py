"""Exact Jaccard join on word shingles, with several global token orders as filters.

For a threshold ``t`` a set of ``n`` shingles shares at least ``ceil(t n)`` of them with any partner, so under every
total order of all shingles the first ``n - ceil(t n) + 1`` of both sets have one in common. Three orders are used. All put
the shingles that the corpus repeats most last (a bounded list), the rest by a different hash each. A pair is a
candidate only if its prefixes meet under all three; candidates are verified on the whole sets.

Equal sets are one node: only one document of a set and input split sends its prefixes, and membership is joined back.
Prefix entries travel in packed blocks keyed by order and bucket, four bytes a token. A bucket emits all pairs
of a token that at most ``SMALL_RUN`` nodes share. A larger run first offers each node the run's head, the node that is in
most large runs, if they meet under the other orders too; when those links are verified and merged, the run's nodes of different
components still meet, in blocks, where they are verified: a block gives only links that join two of its components, so fewer than it
has nodes. So no group emits its square, and no link between components is lost.

Before sets travel, every candidate is tried on sketches of parities, whose difference bounds the sets' difference from below: it
never rules out a link. What remains passes the other orders' filters, and is verified on the whole sets.

Defined cases: a text without words, or null, has the empty set and its own component; fewer words than a shingle make one
shingle of all; repeated rows are each returned; a null doc_id has component null unless a copy has one; other columns
are ignored; an empty table gives no rows. Sets are told apart by 64-bit hashes of their 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import ID_BITS, discard, id_filter, materialize
from stowage.llm.components import components
from stowage.llm.strings import mix, word_hashes_all

WORDS = 5
ORDERS = 3
ALL = (1 << ORDERS) - 1
SMALL_RUN = 16  # nodes of a token whose pairs are all emitted
FREQUENT = 100_000  # most shingles that the orders put last
CHUNK = 1 << 22  # shingles counted at once for that list
REPEATS = 4  # occurrences in a chunk from which a shingle is counted
BUCKET_TOKENS = 1 << 23  # prefix tokens of a bucket, about: a text's entry in each names it again
PART_TOKENS = 1 << 19  # of those, how many are sorted at once
FLUSH_TOKENS = 1 << 19
HELD_SETS = 256  # unpacked sets that a verifying task keeps
BLOCK_NODES = 2048  # nodes of a cluster compared at once
BLOCK_TOKENS = 1 << 22  # and their shingles
GROUP_ROWS = 20_000  # members of large runs of one block handled together
TRIED_PAIRS = 1 << 20  # pairs that a group remembers as no links
GROUP = ["bucket", "i", "j"]
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words, split at ASCII white space with A-Z lower-cased."""
    return word_hashes_all([text])[0]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words."""
    return shingles_of(word_hashes(text), words)


def shingles_of(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    n = min(words, len(hashes))
    if not n:
        return np.zeros(0, np.uint64)
    total = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        total += hashes[k : len(hashes) - n + 1 + k] * (_MULTIPLIERS[k % 8] + np.uint64(2 * (k // 8)))
    return np.unique(mix(total))


def set_hash(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found)) - (1 << 63)


def hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text, some hundred texts at a time."""
    for k in range(0, len(texts), 512):
        yield from word_hashes_all(texts.slice(k, 512).to_pylist())


def sketch(found: np.ndarray) -> bytes:
    """Parities of how many of the set's shingles fall on each of as many bits (a power of two, the next).

    Two sets differ in at least as many shingles as their sketches, folded to one length, differ in bits.
    """
    bits = max(64, 1 << (len(found) - 1).bit_length())
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(value: int, bits: int) -> int:
    """The sketch of the same set over half as many bits."""
    return (value >> (bits // 2)) ^ (value & ((1 << (bits // 2)) - 1))


def may_link(x: bytes, y: bytes, size_x: int, size_y: int, percent: int) -> bool:
    """Whether sets with these sketches can reach the threshold."""
    if min(size_x, size_y) * 100 < max(size_x, size_y) * percent:
        return False
    if len(x) < len(y):
        x, y = y, x
    u, v, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * len(x)
    while bits > 8 * len(y):
        u, bits = folded(u, bits), bits // 2
    return (u ^ v).bit_count() * (100 + percent) <= (size_x + size_y) * (100 - percent)


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def _survey(words: int):
    """Per document its set's size and hash; per split the shingles that repeat there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = set(), [], 0

        def repeated():
            tokens = np.concatenate(held)
            held.clear()
            tokens.sort()
            often = np.flatnonzero(tokens[REPEATS - 1 :] == tokens[: len(tokens) - REPEATS + 1])
            kept = np.unique(tokens[often])
            counts = np.searchsorted(tokens, kept, "right") - np.searchsorted(tokens, kept)
            return kept.view(np.int64), counts

        def block(ids, sizes, sets, sketches, tokens, counts):
            n, m = len(ids), len(tokens)
            none = [None] * n
            return pa.RecordBatch.from_arrays(
                [pa.array(ids + [None] * m, pa.int64()), pa.array(sizes + [None] * m, pa.int64()), pa.array(sets + [None] * m, pa.int64()), pa.array(sketches + [None] * m, pa.binary()), pa.array(none + tokens, pa.int64()), pa.array(none + counts, pa.int64())],
                ["doc_id", "n_shingles", "node", "sketch", "token", "n"],
            )

        for batch in batches:
            ids, sizes, sets = batch.column(0).to_pylist(), [], []
            sketches: list = [None] * len(ids)
            for k, hashes in enumerate(hashed(batch.column(1))):
                found = shingles_of(hashes, words)
                sizes.append(len(found))
                sets.append(set_hash(found) if len(found) else None)
                if len(found) and sets[-1] not in seen:
                    seen.add(sets[-1])
                    sketches[k] = sketch(found)
                    held.append(found)
                    size += len(found)
                    if size >= CHUNK:
                        tokens, counts = repeated()
                        yield block([], [], [], [], tokens.tolist(), counts.tolist())
                        held, size = [], 0
            yield block(ids, sizes, sets, sketches, [], [])
        if held:
            tokens, counts = repeated()
            yield block([], [], [], [], tokens.tolist(), counts.tolist())

    return run


PREFIX_SCHEMA = "ord int, bucket int, nodes binary, sizes binary, counts binary, tokens binary"


def _narrow(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max()))).tobytes()


def _widened(packed: list[bytes], sizes: list[int]) -> np.ndarray:
    """The numbers of ``_narrow``, of which each row holds as many as ``sizes`` says."""
    return np.concatenate([np.frombuffer(x, f"u{len(x) // n}").astype(np.int64) for x, n in zip(packed, sizes, strict=True)])


def _prefixes(words: int, percent: int, buckets: int, frequent):
    """Packed blocks of prefix tokens, by order and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = frequent.value
        seen, nodes, sizes, lengths, held, total = set(), [], [], [], [[] for _ in range(ORDERS)], 0

        def flush():
            rows = []
            own_nodes, own_sizes = np.array(nodes, np.int64), np.array(sizes, np.uint32)
            docs = np.repeat(np.arange(len(nodes)), lengths)
            for order in range(ORDERS):
                tokens = np.concatenate(held[order])
                bucket = ((tokens >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                at = np.argsort(bucket, kind="stable")
                low, of, bucket = tokens[at].astype(np.uint32), docs[at], bucket[at]
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                for a, b in zip(edges, edges[1:], strict=False):
                    doc, counts = np.unique(of[a:b], return_counts=True)
                    rows.append((order, int(bucket[a]), own_nodes[doc].tobytes(), _narrow(own_sizes[doc]), _narrow(counts), low[a:b].tobytes()))
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["ord", "bucket", "nodes", "sizes", "counts", "tokens"])

        for batch in batches:
            for hashes in hashed(batch.column(0)):
                found = shingles_of(hashes, words)
                if not len(found) or (node := set_hash(found)) in seen:
                    continue
                seen.add(node)
                n = prefix_length(len(found), percent)
                late = np.zeros(len(found), np.uint64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                    late = np.where(common[at] == found, rank[at], np.uint64(0))
                for order in range(ORDERS):
                    key = np.where(late > 0, (late << np.uint64(40)) | np.uint64(1 << 63) | (mix(found, order + 1) >> np.uint64(24)), mix(found, order + 1) >> np.uint64(1))
                    held[order].append(found[np.argpartition(key, n - 1)[:n]] if n < len(found) else found)
                nodes.append(node)
                sizes.append(len(found))
                lengths.append(n)
                total += n
                if total >= FLUSH_TOKENS:
                    yield flush()
                    nodes, sizes, lengths, held, total = [], [], [], [[] for _ in range(ORDERS)], 0
        if nodes:
            yield flush()

    return run


def _fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the threshold at all."""
    return np.minimum(a, b) * 100 >= np.maximum(a, b) * percent


def _meet(percent: int):
    """All pairs of one bucket's small runs; the members of its large ones."""

    def met(node: np.ndarray, size: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Pairs of small runs, and (token, node, size) of large ones."""
        at = np.lexsort((node, token))
        node, size, token = node[at], size[at], token[at]
        fresh = np.ones(len(node), bool)
        fresh[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
        node, size, token = node[fresh], size[fresh], token[fresh]
        starts = np.flatnonzero(np.diff(token.astype(np.int64), prepend=-1))
        length = np.diff(np.append(starts, len(token)))
        small = np.repeat(length <= SMALL_RUN, length)
        pairs = [np.zeros((0, 2), np.int64)]
        for d in range(1, min(SMALL_RUN, int(length.max(initial=1)))):
            i = np.flatnonzero((token[d:] == token[:-d]) & small[d:])
            i = i[_fits(size[i], size[i + d], percent)]
            pairs.append(np.stack([node[i], node[i + d]], axis=1))
        return np.concatenate(pairs), (token[~small], node[~small], size[~small])

    def run(table: pa.Table) -> pa.Table:
        order, bucket = table["ord"][0].as_py(), table["bucket"][0].as_py()
        names = table["nodes"].to_pylist()
        lengths = [len(x) // 8 for x in names]
        nodes, sizes, counts = np.frombuffer(b"".join(names), np.int64), _widened(table["sizes"].to_pylist(), lengths), _widened(table["counts"].to_pylist(), lengths)
        tokens, entry = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint32), np.repeat(np.arange(len(nodes), dtype=np.uint32), counts)
        edges = np.linspace(0, 1 << 32, 2 + len(tokens) // PART_TOKENS).astype(np.int64)
        found, large = [], []
        for low, high in zip(edges, edges[1:], strict=False):
            at = np.flatnonzero((tokens >= low) & (tokens < high))
            own = entry[at]
            pairs, rest = met(nodes[own], sizes[own], tokens[at])
            found.append(pairs)
            large.append(rest)
        pairs, (token, node, size) = np.unique(np.concatenate(found), axis=0), (np.concatenate(c) for c in zip(*large, strict=True))
        out = [(np.full(len(pairs), 1 << order), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))]
        if len(node):
            if order == 0:
                out.append((np.zeros(len(node), np.int64), node, size, (np.int64(bucket) << 32) | token.astype(np.int64)))
            held = np.unique(node)
            out.append((np.full(len(held), -(1 << order)), held, held, np.zeros(len(held), np.int64)))
        bits, x, y, key = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"bits": bits.astype(np.int32), "a": x.astype(np.int64), "b": y.astype(np.int64), "token": key.astype(np.int64)})

    return run


def unpacked(words: int):
    """Set from the packed words of a text: four bytes a word travel instead of eight a shingle."""
    return lambda raw: shingles_of(np.frombuffer(raw, "<u4").astype(np.uint64), words)


def _verify(words: int, percent: int):
    """Pairs with the words of both texts in the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = unpacked(words)
        for batch in batches:
            keep, held = [], {}
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for node, raw in ((a, x), (b, y)):
                    if node not in held:
                        if len(held) >= HELD_SETS:
                            held.clear()
                        held[node] = read(raw)
                x, y = (held[a] if a in held else read(x)), held[b]
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _sets(docs: DataFrame, owners: DataFrame, words: int) -> DataFrame:
    """``owners`` (doc_id, node and more) with the packed words of each node's first document, read again from its text.

    A fixed-size filter on the ids keeps most other texts from being read into sets; a join leaves the owners alone.
    """
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(owners, "doc_id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy()
            asked = np.flatnonzero(bits.value[h >> 6] >> (h & 63) & 1)
            found = word_hashes_all(batch.column(1).take(pa.array(asked, pa.int64())).to_pylist())
            right = [k for k, f in enumerate(found) if len(f)]
            ids = batch.column(0).take(pa.array(asked)).take(pa.array(right, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([set_hash(shingles_of(found[k], words)) for k in right], pa.int64()), pa.array([(found[k] >> np.uint64(32)).astype("<u4").tobytes() for k in right], pa.binary())], ["doc_id", "node", "words"])

    keyed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << ID_BITS)).alias("h"))
    return keyed.mapInArrow(sets, "doc_id long, node long, words binary").join(owners, ["doc_id", "node"])


def _near(percent: int):
    """Pairs whose sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(x, y, n, m, percent) for x, y, n, m in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return run


def _linked(pairs: DataFrame, docs: DataFrame, members: DataFrame, sketches: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets reach the threshold; sketches rule most others out before sets travel."""
    side = lambda s, x: sketches.select(F.col("node").alias(s), F.col("sketch").alias(x), F.col("size").alias(f"n_{x}"))
    pairs = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y", "n_x", "n_y").mapInArrow(_near(percent), "a long, b long")
    pairs = materialize(pairs, "jaccard-pairs")
    needed = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = materialize(_sets(docs, members.join(needed, "node").select("doc_id", "node"), words).select("node", "words"), "jaccard-words")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("words").alias("y")), "b")
    links = materialize(both.select("a", "b", "x", "y").mapInArrow(_verify(words, percent), "a long, b long").distinct(), "jaccard-links")
    discard(own, pairs)
    return links


def _met(table: pa.Table, nodes: np.ndarray, percent: int, wanted) -> Iterator[tuple[int, np.ndarray]]:
    """Each node of a run, or of two blocks of it, with the wanted ones it may link to by their sketches; nodes are numbered as in ``nodes``."""
    token, size, first, second = (table[c].to_numpy() for c in ("token", "size", "first", "second"))
    number, raw = np.searchsorted(nodes, table["node"].to_numpy()), table["sketch"]
    at = np.lexsort((size, token))
    token, size, first, second, number, raw = token[at], size[at], first[at], second[at], number[at], raw.take(pa.array(at)).to_pylist()
    edges = np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token))
    for start, end in zip(edges, edges[1:], strict=False):
        of, n, x, y = number[start:end], size[start:end], first[start:end], second[start:end]
        long = np.array([len(v) for v in raw[start:end]])  # grows with the size, so each length is a slice
        ends = np.searchsorted(n, n * 100 // percent, "right")
        halves: dict = {}
        for bytes_ in np.unique(long).tolist():
            low, high = (int(np.searchsorted(long, bytes_, s)) for s in ("left", "right"))
            own = np.frombuffer(b"".join(raw[start + low : start + high]), np.uint32).reshape(high - low, -1)
            halves[bytes_] = own, own[:, : own.shape[1] // 2] ^ own[:, own.shape[1] // 2 :], low, high
        for k in range(len(of)):
            own, _, low, high = halves[int(long[k])]
            longer = halves.get(2 * int(long[k]))
            for others, begin, stop in ((own, low, high), longer[1:] if longer else (own, 0, 0)):
                i, j = max(begin, k + 1), min(stop, int(ends[k]))
                if i >= j:
                    continue
                asked = i + np.flatnonzero((x[k] & y[i:j] | y[k] & x[i:j]) & wanted(of[k], of[i:j]))
                far = np.bitwise_count(others[asked - begin] ^ own[k - low]).sum(axis=1, dtype=np.int64)
                asked = asked[far * (100 + percent) <= (n[k] + n[asked]) * (100 - percent)]
                if len(asked):
                    yield int(of[k]), of[asked]


def _numbered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A group's nodes in order, and their components, numbered."""
    nodes, at = np.unique(table["node"].to_numpy(), return_index=True)
    return nodes, np.unique(table["component"].to_numpy()[at], return_inverse=True)[1]


def _live(percent: int):
    """The nodes of a group that may link to another component's, each once."""

    def run(table: pa.Table) -> pa.Table:
        nodes, component = _numbered(table)
        live = np.zeros(len(nodes), bool)
        for a, others in _met(table, nodes, percent, lambda a, b: (component[b] != component[a]) & ~(live[a] & live[b])):
            live[a] = live[others] = True
        keys = {c: pa.array([table[c][0].as_py()] * int(live.sum()), table[c].type) for c in GROUP}
        return pa.table(keys | {"node": pa.array(nodes[live])})

    return run


def _joined(words: int, percent: int):
    """Links (a, b) between components of a group, verified on the whole sets: a pair that earlier ones connect is left out, so they make a forest."""
    read = unpacked(words)

    def run(table: pa.Table, texts: pa.Table) -> pa.Table:
        nodes, component = _numbered(table)
        raw = dict(zip(texts["node"].to_pylist(), texts["words"].to_pylist(), strict=True))
        sets: list = [None] * len(nodes)
        held = np.array([node in raw for node in nodes.tolist()], bool)
        tried, out = set(), []

        def own(k: int) -> np.ndarray:
            if sets[k] is None:
                sets[k] = read(raw[int(nodes[k])])
            return sets[k]

        for a, others in _met(table, nodes, percent, lambda a, b: (component[b] != component[a]) & held[a] & held[b]):
            for b in others.tolist():
                pair = (a, b) if a < b else (b, a)
                if component[a] == component[b] or pair in tried:
                    continue
                x, y = own(a), own(b)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * common >= percent * (len(x) + len(y) - common):
                    component[component == component[b]] = component[a]
                    out.append(pair)
                    continue
                if len(tried) >= TRIED_PAIRS:
                    tried.clear()  # those that meet again under another token are verified again
                tried.add(pair)
        return pa.table({"a": pa.array(nodes[[k[0] for k in out]], pa.int64()), "b": pa.array(nodes[[k[1] for k in out]], pa.int64())})

    return run


def _across(runs: DataFrame, found: DataFrame, sketches: DataFrame, docs: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) that join components of large runs' nodes: as many of each group as connect what its links connect.

    In each run the nodes outside its main component meet all its nodes. Runs with one main component are handled together, so that a text
    travels there once. Runs of more than BLOCK_NODES nodes or BLOCK_TOKENS shingles are dealt out in blocks, of which a node enters as many as
    the other side has. Only texts that their sketches let through travel.
    """
    placed = runs.join(found, "node", "left").select("token", "node", "size", F.coalesce("component", "node").alias("component"))
    share = placed.groupBy("token", "component").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    shape = share.groupBy("token").agg(F.max(F.struct("n", "component", "s")).alias("top"), F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("k > 1")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_NODES, s / BLOCK_TOKENS)).cast("int")
    shape = shape.select("token", F.col("top.component").alias("main"), blocks(F.col("n") - F.col("top.n"), F.col("s") - F.col("top.s")).alias("rows"), blocks(F.col("n"), F.col("s")).alias("columns"))
    mixed = materialize(placed.join(shape, "token").join(sketches.select("node", "sketch"), "node"), "jaccard-mixed")
    few = mixed.where(F.col("columns") == 1)
    shares = lambda n, s: F.ceil(F.greatest(n / GROUP_ROWS, s / BLOCK_TOKENS)).cast("int")
    parts = few.groupBy("main").agg(shares(F.count("*"), F.sum("size")).alias("parts"))
    buckets = few.agg(F.coalesce(shares(F.count("*"), F.sum("size")), F.lit(1)).alias("n")).first()["n"]
    bucket = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("main"), F.lit(max(1, buckets)))).otherwise(F.xxhash64("main", F.pmod(F.xxhash64("token"), F.col("parts"))))
    keys = ["token", "node", "size", "component", "sketch"]
    small = few.join(parts, "main").select(bucket.alias("bucket"), F.lit(0).alias("i"), F.lit(0).alias("j"), *keys, (F.col("component") != F.col("main")).alias("first"), F.lit(True).alias("second"))
    large, spread = mixed.where(F.col("columns") > 1), lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    first = large.where("component <> main").select(F.col("token").alias("bucket"), spread(F.col("rows")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"), *keys, F.lit(True).alias("first"), F.lit(False).alias("second"))
    second = large.select(F.col("token").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), spread(F.col("columns")).alias("j"), *keys, F.lit(False).alias("first"), F.lit(True).alias("second"))
    groups = small.union(first).union(second)
    live = materialize(groups.groupBy(*GROUP).applyInArrow(_live(percent), "bucket long, i int, j int, node long"), "jaccard-live")
    own = materialize(_sets(docs, members.join(live.select("node").distinct(), "node").select("doc_id", "node"), words).select("node", "words").dropDuplicates(["node"]), "jaccard-words")
    left, right = groups.join(live, [*GROUP, "node"], "left_semi"), live.join(own, "node")
    links = materialize(left.groupBy(*GROUP).cogroup(right.groupBy(*GROUP)).applyInArrow(_joined(words, percent), "a long, b long"), "jaccard-cross")
    discard(mixed, live, own)
    return links


def _sizes_fit(a: str, b: str, percent: int):
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def join(docs: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id): documents link when 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    survey = materialize(docs.mapInArrow(_survey(words), "doc_id long, n_shingles long, node long, sketch binary, token long, n long"), "jaccard-survey")
    sets = survey.where("n_shingles is not null")
    members = sets.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    top = survey.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, counts = top["token"].to_numpy().view(np.uint64), top["n"].to_numpy()
    at = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[at], np.minimum(counts[at], (1 << 22) - 1).astype(np.uint64)))  # FREQUENT rows at most
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    buckets = 1 + int(total * (100 - percent) / 100 / BUCKET_TOKENS)
    blocks = docs.select("text").mapInArrow(_prefixes(words, percent, buckets, frequent), PREFIX_SCHEMA)
    met = materialize(blocks.groupBy("ord", "bucket").applyInArrow(_meet(percent), "bits int, a long, b long, token long"), "jaccard-met")

    # nodes of large runs, by the orders in which they are in one: there such a pair's missing bit proves nothing
    hot = met.where("bits < 0").groupBy(F.col("a").alias("node")).agg(F.expr("bit_or(-bits)").alias("held"))
    runs = met.where("bits = 0").select("token", F.col("a").alias("node"), F.col("b").alias("size"))
    # the node in most large runs is the least changed of its copies, and so the likeliest to be linked with the rest
    runs = materialize(runs.join(runs.groupBy("node").agg(F.count("*").alias("runs")), "node"), "jaccard-runs")
    heads = runs.groupBy("token").agg(F.max_by(F.struct("node", "size"), F.struct("runs", "node")).alias("head"))
    star = runs.join(heads, "token").where("node <> head.node").where(_sizes_fit("size", "head.size", percent)).select(F.lit(1).alias("bits"), F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))
    # of the first order, the large runs' pairs that are tried now; all must meet under the others as well
    small = materialize(met.where("bits > 0").select("bits", "a", "b").union(star.distinct()).groupBy("a", "b").agg(F.expr("bit_or(bits)").alias("bits")), "jaccard-small")
    sure = small.where(F.col("bits") == ALL).select("a", "b")
    maybe = small.where(F.col("bits") != ALL).join(hot.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a").join(hot.select(F.col("node").alias("b"), F.col("held").alias("held_b")), "b")
    more = maybe.where(F.col("bits").bitwiseOR(F.col("held_a").bitwiseAND(F.col("held_b"))) == ALL).select("a", "b")
    pairs = materialize(sure.union(more), "jaccard-candidates")
    sketches = materialize(sets.where("sketch is not null").select("node", "sketch", F.col("n_shingles").alias("size")).dropDuplicates(["node"]), "jaccard-sketches")
    links = _linked(pairs, docs, members, sketches, words, percent)
    found = materialize(components(links), "jaccard-components")

    # a pair that met in a small run has been tried; any other that links meets in large runs under all orders
    most = hot.where(F.col("held") == ALL).select("node")
    links = links.union(_across(runs.join(most, "node"), found, sketches, docs, members, words, percent))
    found = materialize(components(links), "jaccard-components")
    discard(met)

    least = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = least.join(named, "component").select("node", "component_id")
    return sets.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
