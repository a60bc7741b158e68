"""Order-preserving packing of tokenised documents into fixed windows by dynamic programming.

Documents of one input split are taken in order as one token stream. Cuts are allowed at document ends, after tokens
that end a sentence, and, inside stretches without either, at fixed steps. For cut positions ``p`` the programme is

    best[j] = min over p[j] - window <= p[i] < p[j] of best[i] + (window - (p[j] - p[i])) + penalty[j]

which is a sliding-window minimum of ``best[i] + p[i]``, kept by a monotone queue in linear time. The stream is
cut in blocks; a block's last window is carried over into the next block, so memory is bounded by the block and
the longest document. The last window of a split costs no padding if its length is a power of two.

Defined cases: a null or empty text is its end token alone; repeated rows are packed once each; an empty table
gives no rows; a null doc_id is carried through; other columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.llm.strings import BLANK, LOWER, mix, pieces_of, ranges, run_hashes, words

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

WINDOW = 2048
BLOCK = 1 << 19  # tokens cut at once
SENTENCE_PENALTY = 4.0  # padding tokens that a cut at a sentence end is worth
HARD_PENALTY = 12.0  # the same for a cut inside a sentence
HARD_STEP = 16  # step of the cuts inside a stretch without sentence ends
HARD_GAP = 48  # longest stretch without such cuts
CACHED_WORDS = 1 << 20
CHUNK_BYTES = 1 << 20  # bytes of texts whose pieces are looked up together
DOCUMENTS = 1024  # read at once
MERGED = 4096  # words merged at once


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merges:
    """Byte-pair merging of many words at once: every round merges the lowest-ranked, leftmost pair of each word."""

    def __init__(self, model: dict) -> None:
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocabulary[a] << 16 | vocabulary[b] for a, b in pairs], np.int64)
        at = np.argsort(keys)
        self.none = np.int32(len(pairs))
        self.keys, self.ranks = np.append(keys[at], np.int64(1) << 62), np.append(at, len(pairs)).astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        symbols = byte_symbols()
        self.inner = np.array([vocabulary[c] for c in symbols], np.int32)
        self.last = np.array([vocabulary[c + end] for c in symbols], np.int32)
        left, right = np.repeat(np.arange(256), 256), np.tile(np.arange(256), 256)
        self.first = self.rank(self.inner[left], self.inner[right])  # by two bytes
        self.first_last = self.rank(self.inner[left], self.last[right])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 16 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def encode(self, flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of each word's ids) for words that are runs of ``flat``, none of them empty."""
        counts, parts = np.zeros(len(begins), np.int64), []
        order = np.argsort(sizes, kind="stable")
        for k in range(0, len(order), MERGED):  # words of like lengths, one to a row
            rows = order[k : k + MERGED]
            size, width = sizes[rows], int(sizes[rows[-1]])
            place = np.arange(width)
            raw = flat[np.minimum(begins[rows][:, None] + place, len(flat) - 1)].astype(np.int32)
            ids, ranks, row = self.inner[raw], np.full(raw.shape, self.none), np.arange(len(rows))
            if width > 1:
                ranks[:, :-1] = np.where(place[None, 1:] < size[:, None] - 1, self.first[raw[:, :-1] << 8 | raw[:, 1:]], self.none)
                long = np.flatnonzero(size > 1)
                end = size[long] - 1
                ranks[long, end - 1] = self.first_last[raw[long, end - 1] << 8 | raw[long, end]]
            ids[row, size - 1] = self.last[raw[row, size - 1]]
            at = ranks.argmin(axis=1)
            while len(rows):
                row = np.arange(len(rows))
                best = ranks[row, at]
                done = best == self.none
                if done.any():
                    counts[rows[done]] = size[done]
                    parts.append((rows[done], size[done], ids[done]))
                    left = np.flatnonzero(~done)
                    if not len(left):
                        break
                    rows, size, at, best, row = rows[left], size[left], at[left], best[left], row[: len(left)]
                    wide = int(size.max())
                    place, ids, ranks = place[:wide], ids[left, :wide], ranks[left, :wide]
                shift = np.minimum(place + (place > at[:, None]), len(place) - 1)
                shift += row[:, None] * len(place)
                ids, ranks = ids.ravel()[shift], ranks.ravel()[shift]
                size = size - 1
                ids[row, at] = self.made[best]
                for side in (at - 1, at):
                    fits = np.flatnonzero((side >= 0) & (side + 1 < size))
                    col = side[fits]
                    ranks[fits, col] = self.rank(ids[fits, col], ids[fits, col + 1])
                ranks[row, size - 1] = self.none
                at = ranks.argmin(axis=1)
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        for rows, size, ids in parts:
            inside = np.arange(ids.shape[1]) < size[:, None]
            out[ranges(ends[rows] - size, size)] = ids[inside]
        return out, counts


def byte_classes() -> np.ndarray:
    """Of each byte of a lower-cased text: 0 white space, 1 letter, 2 digit, 3 other ASCII, 4 what asks for the tokeniser."""
    classes = np.full(256, 4, np.uint8)
    classes[:128] = 3
    classes[BLANK] = 0
    classes[97:123] = 1
    classes[48:58] = 2
    classes[39] = 4  # an apostrophe may open a contraction
    return classes


CLASSES = byte_classes()


class WordIds:
    """Ids of texts, found for all pieces of a chunk together; the pre-tokeniser never joins across white space.

    Runs of Latin letters, runs of ASCII punctuation and single digits are merged in numpy; words with any other character are
    asked of the tokeniser. A table of sorted 64-bit hashes keeps the ids of the pieces met before.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Merges(json.loads(self.tokenizer.to_str())["model"])
        ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, number in self.tokenizer.get_vocab().items():
            ends[number] = token.removesuffix("</w>").endswith((".", "!", "?"))
        self.ends_sentence = ends
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list[np.ndarray] = []
        self.held = np.zeros(0, np.uint32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def pieces(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes; starts and sizes of the pieces, and whether a piece is a word for the tokeniser."""
        low = LOWER[flat]
        classes = CLASSES[low]
        heads = np.flatnonzero(low[:-1] == 0xC3)
        if len(heads):  # two-byte Latin letters, all but the signs of multiplication and division
            tails = low[heads + 1]
            fits = (tails >= 0x80) & (tails <= 0xBF) & (tails != 0x97) & (tails != 0xB7)
            heads, tails = heads[fits], tails[fits]
            low[heads + 1] = np.where(tails < 0x9F, tails | 0x20, tails)
            classes[heads] = classes[heads + 1] = 1
        edge = np.empty(len(flat) + 1, bool)
        edge[0] = edge[-1] = True
        edge[1:-1] = (classes[1:] != classes[:-1]) | (classes[1:] == 2)
        starts = np.flatnonzero(edge[:-1])
        sizes = np.diff(np.append(starts, len(flat)))
        kind = classes[starts]
        keep = kind > 0
        starts, sizes, odd = starts[keep], sizes[keep], kind[keep] == 4
        if odd.any():
            begins, lengths = words(flat)
            of = np.searchsorted(begins, starts, "right") - 1
            asked = np.zeros(len(begins), bool)
            asked[of[odd]] = True
            inner = asked[of]
            starts = np.concatenate([starts[~inner], begins[asked]])
            sizes = np.concatenate([sizes[~inner], lengths[asked]])
            odd = np.arange(len(starts)) >= (~inner).sum()
            order = np.argsort(starts, kind="stable")
            starts, sizes, odd = starts[order], sizes[order], odd[order]
        return low, starts, sizes, odd

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.hashes, key)
        at[at == len(self.hashes)] = 0
        return at, (self.hashes[at] == key if len(self.hashes) else np.zeros(len(key), bool))

    def encode_flat(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, number of ids of each piece, start of each piece) of a text in UTF-8."""
        flat = np.frombuffer(raw, np.uint8)
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, starts, sizes, odd = self.pieces(flat)
        key = run_hashes(low, starts, sizes)
        if odd.any():
            key[odd] = mix(run_hashes(flat, starts[odd], sizes[odd]), 1)  # their case is left to the tokeniser
        if len(self.hashes) >= CACHED_WORDS:
            self.clear()
        at, known = self.look_up(key)
        if not known.all():
            new = np.flatnonzero(~known)
            fresh, first = np.unique(key[new], return_index=True)
            new = new[first]
            asked = odd[new]
            counts = np.zeros(len(new), np.int64)
            ids, counts[~asked] = self.merges.encode(low, starts[new[~asked]], sizes[new[~asked]])
            begins = np.zeros(len(new), np.int64)
            begins[~asked] = np.cumsum(counts[~asked]) - counts[~asked]
            told = [self.whole(raw[a : a + n].decode("utf-8", "surrogatepass")) for a, n in zip(starts[new[asked]].tolist(), sizes[new[asked]].tolist(), strict=True)]
            counts[asked] = [len(x) for x in told]
            begins[asked] = len(ids) + np.cumsum(counts[asked]) - counts[asked]
            begins += len(self.held)
            self.held = np.concatenate([self.held, ids, *told])
            place = np.searchsorted(self.hashes, fresh)
            self.hashes, self.starts, self.counts = np.insert(self.hashes, place, fresh), np.insert(self.starts, place, begins), np.insert(self.counts, place, counts)
            at, _ = self.look_up(key)
        counts = self.counts[at]
        return self.held[ranges(self.starts[at], counts)], counts, starts

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Same ids as one call for each whole text."""
        out: list = [None] * len(texts)
        raw, group, held = [], [], 0

        def flush() -> None:
            nonlocal raw, group, held
            sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
            ids, counts, starts = self.encode_flat(b"\n".join(raw))
            ends = np.cumsum(sizes)
            parts = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(starts, ends)]
            for k, a, b in zip(group, np.concatenate([[0], parts]).tolist(), parts.tolist(), strict=False):
                out[k].append(ids[a:b])
            raw, group, held = [], [], 0

        for k, text in enumerate(texts):
            if "<|" in text:
                out[k] = [self.whole(text)]
                continue
            out[k] = []
            for part in pieces_of(text.encode("utf-8", "surrogatepass"), CHUNK_BYTES):
                raw.append(part)
                group.append(k)
                held += len(part)
                if held >= CHUNK_BYTES:
                    flush()
        if raw:
            flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) for p in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORDS:
        _WORDS[path] = WordIds(path)
    return _WORDS[path]


def padding(length: int, window: int) -> int:
    return 0 if length & (length - 1) == 0 else window - length


def choose_cuts(positions: np.ndarray, penalties: np.ndarray, window: int, last: bool) -> list[int]:
    """Cheapest window ends among ``positions`` (ascending, from 0 on, gaps of at most ``window``)."""
    p, pen, n = positions.tolist(), penalties.tolist(), len(positions)
    best, back, queue = [0.0] * n, [0] * n, deque([(0.0, 0)])
    for j in range(1, n):
        at = p[j]
        while p[queue[0][1]] < at - window:
            queue.popleft()
        key, i = queue[0]
        back[j] = i
        best[j] = cost = key + window - at + pen[j]
        key = cost + at
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    j = n - 1
    if last and j:
        first = int(np.searchsorted(positions, p[j] - window))
        back[j] = min(range(first, j), key=lambda i: best[i] + padding(p[j] - p[i], window))
    cuts = []
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


def candidates(segments: list, ends_sentence: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, and what a cut there costs."""
    found, costs, at = [np.zeros(1, np.int64)], [np.zeros(1)], 0
    for _, start, ids, total in segments:
        inner = np.flatnonzero(ends_sentence[ids[:-1]]) + 1 if len(ids) else np.zeros(0, np.int64)
        found += [inner + at, [at + len(ids)]]
        costs += [np.full(len(inner), SENTENCE_PENALTY), [0.0 if start + len(ids) == total else HARD_PENALTY]]
        at += len(ids)
    positions, penalties = np.concatenate(found), np.concatenate(costs)
    keep = np.concatenate([[True], np.diff(positions) > 0])
    positions, penalties = positions[keep], penalties[keep]
    wide = np.flatnonzero(np.diff(positions) > min(HARD_GAP, window))
    if len(wide):
        step = min(HARD_STEP, window)
        extra = np.concatenate([np.arange(positions[i] + step, positions[i + 1], step) for i in wide])
        positions, penalties = np.concatenate([positions, extra]), np.concatenate([penalties, np.full(len(extra), HARD_PENALTY)])
        order = np.argsort(positions, kind="stable")
        positions, penalties = positions[order], penalties[order]
    return positions, penalties


def pack_stream(documents: Iterator[tuple[int | None, np.ndarray]], ends_sentence: np.ndarray, window: int, block: int, first_id: int) -> Iterator[list[tuple]]:
    """Lists of pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset), block by block."""
    segments: list[tuple] = []  # (doc_id, start in the document, ids, tokens of the document)
    held, sequence = 0, first_id

    def flush(last: bool) -> list[tuple]:
        nonlocal segments, held, sequence
        positions, penalties = candidates(segments, ends_sentence, window)
        cuts = choose_cuts(positions, penalties, window, last)
        if not last:
            cuts.pop()
        out, rest, at, k, begun = [], [], 0, 0, 0
        for doc_id, start, ids, total in segments:
            done = 0
            while done < len(ids) and k < len(cuts):
                take = min(len(ids) - done, cuts[k] - at)
                out.append((doc_id, start + done, take, ids[done : done + take].astype("<u4").tobytes(), total, sequence, at - begun))
                done, at = done + take, at + take
                if at == cuts[k]:
                    k, sequence, begun = k + 1, sequence + 1, at
            if done < len(ids):
                rest.append((doc_id, start + done, ids[done:], total))
        segments, held = rest, sum(len(s[2]) for s in rest)
        return out

    for doc_id, ids in documents:
        segments.append((doc_id, 0, ids, len(ids)))
        held += len(ids)
        if held >= block:
            yield flush(False)
    if segments:
        yield flush(True)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 1, block: int = BLOCK) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in windows of ``window`` tokens; ``ids`` holds little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, end = word_ids(tokenizer_path), np.array([end_id], np.uint32)

        def documents():
            for batch in batches:
                for k in range(0, len(batch), DOCUMENTS):
                    part = batch.slice(k, DOCUMENTS)
                    found = table.encode_all([t or "" for t in part.column(1).to_pylist()])
                    yield from ((doc_id, np.append(ids, end)) for doc_id, ids in zip(part.column(0).to_pylist(), found, strict=True))

        for rows in pack_stream(documents(), table.ends_sentence, window, block, TaskContext.get().partitionId() << 40):
            for k in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 4096], strict=True), ARROW, strict=True)], schema=ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The columns that tell every piece apart without its ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
