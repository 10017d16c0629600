"""Benchmark decontamination by greedy string tiling (running Karp-Rabin, Wise 1993).

A document holds a benchmark passage if tiles, long runs of words that both share, cover enough of the passage's words. Tiles may
lie in any order, so a passage whose sentences were moved is found too; no word is in two tiles.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import shingles, words

#: Words of the shortest tile, and the least share of a passage's words in tiles.
MIN_TILE = 5
COVERAGE = 0.5
#: Passages are sent to the executors in blocks of about so many bytes; documents are read once for each block.
BLOCK_BYTES = 16 << 20

_MOD, _BASE = (1 << 61) - 1, 1_000_003


@dataclass
class Tile:
    item_at: int
    doc_at: int
    size: int


def greedy_tiles(item: list[int], doc: list[int], least: int) -> list[Tile]:
    """Tiles of at least `least` tokens, always the longest match whose tokens are all unmarked; ties by position in item, then doc."""
    tiles: list[Tile] = []
    item_free, doc_free = [True] * len(item), [True] * len(doc)
    search = min(len(item), len(doc), max(least, 20))
    while search >= least and search:
        matches = _matches(item, doc, item_free, doc_free, search)
        longest = max((m.size for m in matches), default=0)
        if longest > 2 * search:
            search = longest
            continue
        # Of a match that a longer one cut, each free part waits for its turn by its own size.
        queue = [(-m.size, m.item_at, m.doc_at) for m in matches]
        heapify(queue)
        while queue:
            size, i, j = heappop(queue)
            free = [x and y for x, y in zip(item_free[i : i - size], doc_free[j : j - size], strict=True)]
            if all(free):
                tiles.append(Tile(i, j, -size))
                item_free[i : i - size] = doc_free[j : j - size] = [False] * -size
                continue
            start = 0
            for whole, part in groupby(free):
                n = len(list(part))
                if whole and n >= search:
                    heappush(queue, (-n, i + start, j + start))
                start += n
        if search == least:
            break
        search = max(least, search // 2)
    return tiles


def _windows(tokens: list[int], free: list[bool], size: int):
    """(start, rolling hash) of each window of unmarked tokens."""
    top, value, run = pow(_BASE, size - 1, _MOD), 0, 0
    for i, x in enumerate(tokens):
        if not free[i]:
            value = run = 0
            continue
        if run >= size:
            value -= tokens[i - size] * top
        value = (value * _BASE + x) % _MOD
        run += 1
        if run >= size:
            yield i - size + 1, value


def _matches(item, doc, item_free, doc_free, size) -> list[Tile]:
    """Maximal matches of unmarked tokens that hold a shared window of `size` tokens."""
    at = defaultdict(list)
    for i, value in _windows(item, item_free, size):
        at[value].append(i)
    found = []
    for j, value in _windows(doc, doc_free, size):
        for i in at.get(value, ()):
            if i and j and item_free[i - 1] and doc_free[j - 1] and item[i - 1] == doc[j - 1]:
                continue  # the match one step to the left holds this one
            if item[i : i + size] != doc[j : j + size]:
                continue
            n = size
            while i + n < len(item) and j + n < len(doc) and item_free[i + n] and doc_free[j + n] and item[i + n] == doc[j + n]:
                n += 1
            found.append(Tile(i, j, n))
    return found


class Passages:
    """Benchmark passages, with an index of their runs of `least` words (shorter passages: of all their words)."""

    def __init__(self, ids: list, column: pa.Array, least: int):
        self.ids, self.tokens, self.least = [], [], least
        runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for w in words(column):
            for i in range(len(w)):
                if n := w.count(i):
                    own = w.hashes[w.first[i] : w.first[i + 1]]
                    found = shingles(own, min(least, n))
                    runs[min(least, n)].append((found, np.full(len(found), len(self.ids))))
                    self.ids.append(ids[w.row + i])
                    self.tokens.append((own >> np.uint64(4)).tolist())
        self.index = {}
        for size, parts in runs.items():
            seeds, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(seeds, kind="stable")
            self.index[size] = (seeds[order], owner[order])

    def seeds(self, hashes: np.ndarray):
        """For each seed length: its words, and where in hashes any passage has a seed. The join on shared seeds."""
        for size, (seeds, owner) in self.index.items():
            runs = shingles(hashes, size)
            at = np.searchsorted(seeds, runs)
            at[at == len(seeds)] = 0
            where = np.flatnonzero(seeds[at] == runs) if len(runs) else np.zeros(0, np.int64)
            yield size, seeds, owner, where, runs

    def tilings(self, hashes: np.ndarray, hits: list, coverage: float):
        """(passage, tiles, words in tiles) of those that reach the coverage in one document."""
        places = defaultdict(set)
        for size, seeds, owner, where, runs in hits:
            lo, hi = np.searchsorted(seeds, runs[where]), np.searchsorted(seeds, runs[where], "right")
            for j, a, b in zip(where.tolist(), lo.tolist(), hi.tolist(), strict=True):
                for p in set(owner[a:b].tolist()):
                    places[p].update(range(j, j + size))
        for p, covered in places.items():
            item = self.tokens[p]
            if len(covered) < coverage * len(item):
                continue
            # Tiles lie only where seeds do; a token that no passage has keeps the parts of the document apart.
            doc, last = [], None
            for j in sorted(covered):
                if last is not None and j != last + 1:
                    doc.append(-1 - j)
                doc.append(int(hashes[j]) >> 4)
                last = j
            tiles = greedy_tiles(item, doc, min(self.least, len(item)))
            if (n := sum(t.size for t in tiles)) and n >= coverage * len(item):
                yield p, len(tiles), n


def _found(column: pa.Array, passages: Passages, coverage: float):
    """(row, passage, tiles, words in tiles)."""
    for w in words(column):
        per_doc = defaultdict(list)
        for size, seeds, owner, where, runs in passages.seeds(w.hashes):
            doc = np.searchsorted(w.first, where, "right") - 1
            inside = where + size <= w.first[doc + 1]
            where, doc = where[inside], doc[inside]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for part in np.split(where, cuts) if len(where) else []:
                i = int(np.searchsorted(w.first, part[0], "right") - 1)
                a = int(w.first[i])
                per_doc[i].append((size, seeds, owner, part - a, runs[a : int(w.first[i + 1])]))
        for i, hits in sorted(per_doc.items()):
            for p, tiles, n in passages.tilings(w.hashes[w.first[i] : w.first[i + 1]], hits, coverage):
                yield w.row + i, p, tiles, n


def _blocks(benchmark: DataFrame, item_id: str, text_col: str, least: int):
    """Passages in blocks of a bounded size; a broadcast of each block, and the type of the ids."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text_col).cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toArrow()
        column = rows.column(1).combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        yield spark.sparkContext.broadcast(Passages(rows.column(0).to_pylist(), column, least))


def tile_passages(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, tiles, covered_words, item_words, coverage) of each row and passage with coverage reached.

    Passages and texts without words (null, empty) match nothing. A passage of fewer than `least` words must occur whole.
    Repeated passages, and rows with equal ids, each have rows of their own; a null id stays null. Whole texts are read.
    No other column is looked at. The passages are the stated query set: they go to the executors in blocks of bounded size. No document is shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for block in _blocks(benchmark, item_id, item_text, least):

        def scan(batches, block=block):
            passages = block.value
            for batch in batches:
                found = list(_found(batch.column(1), passages, coverage))
                if found:
                    at, p, tiles, n = (list(x) for x in zip(*found, strict=True))
                    size = [len(passages.tokens[k]) for k in p]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at)), pa.array([passages.ids[k] for k in p], pa.int64()), pa.array(tiles, pa.int64()), pa.array(n, pa.int64()), pa.array(size, pa.int64()), pa.array([a / b for a, b in zip(n, size, strict=True)], pa.float64())],
                        ["doc_id", "item_id", "tiles", "covered_words", "item_words", "coverage"],
                    )

        part = rows.mapInArrow(scan, "doc_id long, item_id long, tiles long, covered_words long, item_words long, coverage double")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, coverage: float = COVERAGE, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that hold no passage; null and empty texts stay, as do all rows if there are no passages."""
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_id, item_text, least):

        def keep(batches, block=block):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[x[0] for x in _found(batch.column(at), block.value, coverage)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
