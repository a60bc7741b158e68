"""Benchmark decontamination by pigeonhole edit matching.

An item of ``n`` normalised characters may differ by ``e = floor(rate * n)`` edits. It is split into ``e + 1`` pieces;
at most ``e`` edits leave one piece intact, so every occurrence holds an exact piece hit. One Aho-Corasick scan of
each document finds the hits, and Myers' bit-parallel distance verifies the text around each hit's diagonal.
Normalisation lower-cases and joins words by single spaces.

Items are broadcast in blocks of at most ``BLOCK_CHARS`` characters, so a benchmark of any size is searched in bounded
memory. Defined cases: a null or blank item or text matches nothing; repeated items and documents are matched
once each (rows with the same ids give the same rows); extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.06
BLOCK_CHARS = 8_000_000
SCHEMA = "doc_id long, item_id long, distance int, start long, end long"
ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
_WORD = re.compile(r"\S+")


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_pieces(text: str, rate: float) -> tuple[int, list[tuple[int, str]]]:
    """Error budget, and that many pieces and one, with their offsets."""
    errors = min(int(len(text) * rate), len(text) - 1)
    edges = [len(text) * k // (errors + 1) for k in range(errors + 2)]
    return errors, [(a, text[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a substring of ``text``, and where the first such substring ends."""
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        masks[c] |= 1 << k
    get, full, top = masks.get, (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = full, 0, len(pattern)
    best, end = score, 0
    for at, c in enumerate(text, 1):
        equal = get(c, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = (minus | ~(across | plus)) & full
        left = plus & across
        if up & top:
            score += 1
        elif left & top:
            score -= 1
        up = up << 1 & full
        left = left << 1 & full
        plus = (left | ~(down | up)) & full
        minus = up & down
        if score < best:
            best, end = score, at
    return best, end


class Matcher:
    """Finds items in one normalised text at a time."""

    def __init__(self, items: list[tuple[int, str]], rate: float) -> None:
        import ahocorasick

        self.items, where = [], defaultdict(list)
        for item_id, text in items:
            errors, pieces = split_pieces(text, rate)
            for offset, piece in pieces:
                where[piece].append((len(self.items), offset + len(piece)))
            self.items.append((item_id, text, errors))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, places)
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item that occurs, in ``text``'s characters."""
        if not self.items or not text:
            return []
        tried, best = set(), {}
        for last, places in self.automaton.iter(text):
            for number, offset in places:
                _, pattern, errors = self.items[number]
                band = (last + 1 - offset) // (errors + 1)
                if (number, band) in tried or best.get(number, (errors + 1,))[0] == 0:
                    continue
                tried.add((number, band))
                low = max(0, band * (errors + 1) - errors)
                high = (band + 1) * (errors + 1) + len(pattern) + errors
                distance, end = myers(pattern, text[low:high])
                if distance <= errors and distance < best.get(number, (errors + 1,))[0]:
                    stop = low + end
                    begin = myers(pattern[::-1], text[max(0, stop - len(pattern) - distance) : stop][::-1])[1]
                    best[number] = (distance, stop - begin, stop)
        return sorted((self.items[k][0], *found) for k, found in best.items())


def _original(text: str, clean: str, start: int, end: int) -> tuple[int, int]:
    """Code points of ``text`` that hold the words of clean[start:end]."""
    words = [m.span() for m in _WORD.finditer(text)]
    return words[clean.count(" ", 0, start)][0], words[clean.count(" ", 0, max(start, end - 1))][1]


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows (doc_id, item_id, distance, start, end): the best occurrence of each item in each document."""
    spark = docs.sparkSession
    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    chars = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * chars // block_chars))
    frame = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    found = None
    for block in range(blocks):
        own = texts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        shared = spark.sparkContext.broadcast([(r["item_id"], t) for r in own if (t := normalise(r["text"]))])
        part = frame.mapInArrow(_searcher(shared, rate), SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found


def _searcher(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                clean = normalise(text)
                for item_id, distance, start, end in matcher.find(clean):
                    rows.append((doc_id, item_id, distance, *_original(text, clean, start, end)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    return run
