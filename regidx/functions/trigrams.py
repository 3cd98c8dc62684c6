"""Word trigrams and the two similarities built on them.

A word is a run of letters and digits in lower case, padded with two spaces in
front and one behind. ``similarity`` compares whole sets; ``word_similarity``
looks for the stretch of the target that matches the query best.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_BREAKS = re.compile(r"[\W_]+")
_BITS = 21  # enough for any code point
LONG = 300  # trigrams from which the array search is faster
_WINDOW, _STARTS = 128, 256
#: For many queries at a time: trigrams of a block and blocks of the longest stretch, by turns (each block a multiple of the one before);
#: cells (blocks x lengths x queries), and pairs of blocks of the first kind, that are counted together.
_LEVELS, _CELLS, _TOGETHER = ((16, 24), (64, 64)), 1 << 21, 1024
#: Characters of the texts that the column function prepares at a time; their arrays take some fifty times as many bytes.
_SLICE_CHARS = 1 << 18


# --- native expressions ----------------------------------------------------------
def trigram_set(text: Column) -> Column:
    """Distinct trigrams of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda word: word != "")
    grams = F.transform(
        words,
        lambda word: F.transform(
            F.sequence(F.lit(1), F.length(word) + 1),
            lambda place: F.substring(F.concat(F.lit("  "), word, F.lit(" ")), place, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def similarity(left: Column, right: Column) -> Column:
    """Jaccard similarity of two trigram sets (pass ``trigram_set`` columns)."""
    return F.coalesce(
        F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0)
    )


# --- batch helpers ------------------------------------------------------------------
def batch_trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ordered trigram codes of all texts and the offsets that split them."""
    spaced = [_BREAKS.sub("  ", f" {text.lower()} ") if text else "" for text in texts]
    lengths = np.fromiter((len(text) for text in spaced), dtype=np.int64, count=len(spaced))
    points = np.frombuffer("".join(spaced).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    if points.size < 3:
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    first, second, third = points[:-2], points[1:-1], points[2:]
    owner = np.repeat(np.arange(len(texts)), lengths)
    # A window counts when it lies in one text and is not the gap between two words.
    valid = (owner[:-2] == owner[2:]) & ~((second == 32) & (third == 32))
    codes = ((first << (2 * _BITS)) | (second << _BITS) | third)[valid]
    counts = np.bincount(owner[:-2][valid], minlength=len(texts))
    return codes, np.concatenate(([0], np.cumsum(counts)))


def best_stretch(query: set[int], target: list[int], beat: float = 0.0) -> float:
    """Best ``|Q & S| / |Q | S|`` over the contiguous stretches S of the target.

    Returns 0 when no stretch scores above ``beat``. An optimal stretch starts
    where a run of matches starts, and a start is given up once its foreign
    trigrams rule out a better score, or once everything before the next start
    has come up again (the next start then scores the same).
    """
    size, best, found = len(query), beat, 0.0
    if not size:
        return 0.0
    hits = [code in query for code in target]
    starts = [i for i, hit in enumerate(hits) if hit and not (i and hits[i - 1])]
    for number, start in enumerate(starts):
        following = starts[number + 1] if number + 1 < len(starts) else len(target)
        seen: set[int] = set()
        pending: set[int] | None = None
        common = foreign = 0
        for place in range(start, len(target)):
            code = target[place]
            if place >= following:
                if pending is None:
                    pending = set(seen)
                pending.discard(code)
                if not pending:
                    break
            if code in seen:
                continue
            seen.add(code)
            if hits[place]:
                common += 1
                score = common / (size + foreign)
                if score > best:
                    best = found = score
                if common == size:
                    break
            else:
                foreign += 1
                if size <= best * (size + foreign):
                    break
    return found


def best_stretch_long(query: np.ndarray, target: np.ndarray, beat: float = 0.0) -> float:
    """``best_stretch`` for long targets: the same search over many starts at a time.

    ``query`` is sorted and distinct. A trigram counts once per stretch, where its
    previous occurrence lies before the start.
    """
    size, length, best, found = query.size, target.size, beat, 0.0
    if not size or not length:
        return 0.0
    hit = query[np.searchsorted(query, target).clip(max=size - 1)] == target
    starts = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])))
    if not starts.size:
        return 0.0
    order = np.argsort(target, kind="stable")
    same = target[order[1:]] == target[order[:-1]]
    before = np.full(length, -1, dtype=np.int32)
    after = np.full(length, length, dtype=np.int32)
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    # From here on everything before the next start has come up again.
    following = np.concatenate((starts[1:], [length]))
    tail = after[starts[0] :]
    owner = np.repeat(following, np.diff(np.concatenate((starts, [length]))))
    ends = np.maximum.reduceat(np.where(tail >= owner, tail, -1), starts - starts[0])
    steps = np.arange(_WINDOW, dtype=np.int32)
    for first in range(0, starts.size, _STARTS):
        at, end = starts[first : first + _STARTS], ends[first : first + _STARTS]
        common = np.zeros(at.size, dtype=np.int32)
        foreign = np.zeros(at.size, dtype=np.int32)
        offset = 0
        while at.size:
            place = at[:, None] + (offset + steps)
            inside = place < end[:, None]
            place = np.minimum(place, length - 1)
            new = inside & (before[place] < at[:, None])
            match = hit[place]
            commons = common[:, None] + np.cumsum(new & match, axis=1, dtype=np.int32)
            foreigns = foreign[:, None] + np.cumsum(new & ~match, axis=1, dtype=np.int32)
            top = float((commons / (size + foreigns)).max())
            if top > best:
                best = found = top
            offset += _WINDOW
            common, foreign = commons[:, -1], foreigns[:, -1]
            alive = (size > best * (size + foreign)) & (at + offset < end) & (common < size)
            at, end, common, foreign = at[alive], end[alive], common[alive], foreign[alive]
    return found


def _block_counts(new_to: np.ndarray, rows: np.ndarray, block: int, reach: int) -> list[np.ndarray]:
    """Plane n: for each block, the column sums of ``rows`` over the distinct trigrams of it and the n blocks after it.

    ``new_to`` tells for each trigram up to how many blocks before its own a stretch may begin that has it nowhere earlier;
    negative where its own block has it earlier.
    """
    blocks = len(new_to) // block
    reach = min(reach, blocks)
    kept = np.flatnonzero((new_to >= 0) & rows.any(axis=1))
    key = np.minimum(new_to[kept], reach - 1) * blocks + kept // block
    order = np.argsort(key, kind="stable")
    key, kept = key[order], kept[order]
    added = np.zeros((reach * blocks, rows.shape[1]), rows.dtype)
    while len(key):  # the first of each key, then the second, up to one for each trigram of a block
        first = np.concatenate(([True], key[1:] != key[:-1]))
        added[key[first]] += rows[kept[first]]
        key, kept = key[~first], kept[~first]
    added = added.reshape(reach, blocks, -1)
    for n in range(reach - 2, -1, -1):
        added[n] += added[n + 1]
    planes = [added[0]]
    for n in range(1, reach):
        planes.append(planes[-1][:-1] + added[n, n:])
    return planes


def best_stretches(
    vocabulary: np.ndarray, member: np.ndarray, sizes: np.ndarray, target: np.ndarray, beat: np.ndarray
) -> np.ndarray:
    """``best_stretch`` of one long target for many queries: 0 where a query does not score above its ``beat``.

    ``member`` tells which trigrams of the sorted ``vocabulary`` (rows, and a last row of zeros) each query (column) has;
    ``sizes`` counts them. Common and distinct trigrams are counted for stretches of whole blocks, for all queries at
    once. A stretch that begins in one block and ends in another has at most the common trigrams of the blocks from one to
    the other and at least the foreign ones of the blocks between, so all stretches are counted only in those pairs
    of blocks where that bound exceeds the best so far.
    """
    length = len(target)
    best, sizes = np.maximum(beat.astype(np.float64), 0.0), sizes.astype(np.int64)
    floor = best.copy()
    if not length or not vocabulary.size:
        return np.zeros(len(sizes))
    padded = -(-length // _LEVELS[-1][0]) * _LEVELS[-1][0]
    spot = np.searchsorted(vocabulary, target).clip(max=vocabulary.size - 1)
    # What fills the last block up is in no query and never new.
    spots = np.full(padded, vocabulary.size)
    spots[:length] = np.where(vocabulary[spot] == target, spot, vocabulary.size)
    order = np.argsort(target, kind="stable")
    same = target[order[1:]] == target[order[:-1]]
    before, after = np.full(padded, padded), np.full(padded, -1)
    before[:length], after[:length] = -1, padded
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    used, spots = np.unique(spots, return_inverse=True)
    having = member[used]
    shared = having.sum(axis=0, dtype=np.int64)

    def search(queries: np.ndarray, block: int, least: int, reach: int, own: np.ndarray, new_to: np.ndarray, distinct: list[np.ndarray]) -> np.ndarray:
        """Raise the best of the queries by stretches that end ``least`` to ``reach`` - 1 blocks on; the queries that longer ones may raise."""
        rows, size = having[:, queries].astype(np.uint16 if sizes.max() < 1 << 16 else np.uint32), sizes[queries]
        blocks, fewest = len(own) // block, np.full(len(queries), np.inf)
        starts = max(reach, _CELLS // (reach * len(queries)) - reach)
        for a in range(0, blocks, starts):
            stop = min(blocks, a + starts + reach - 1)
            part = slice(a * block, stop * block)
            # Blocks before this part do not count: what they hold is new to stretches that begin here.
            common = _block_counts(np.minimum(new_to[part], own[part] - a), rows[spots[part]], block, reach)
            cells = open_cells(common, distinct, queries, size, a, starts, least)
            if cells.shape[1] > 4 * _TOGETHER:
                for n, c in enumerate(common):
                    c = c[:starts]
                    best[queries] = np.maximum(best[queries], (c / (size + distinct[n][a : a + len(c), None] - c)).max(axis=0))
                cells = open_cells(common, distinct, queries, size, a, starts, least)
            count_cells(cells, queries, rows, size, block)
            longer = min(starts, blocks - a - reach)
            if longer > 0:
                between = distinct[reach - 2][a + 1 : a + 1 + longer, None] - common[reach - 2][1 : 1 + longer] if reach > 1 else np.zeros((1, 1))
                fewest = np.minimum(fewest, between.min(axis=0))
        return queries[shared[queries] > best[queries] * (size + fewest)]

    def open_cells(common, distinct, queries: np.ndarray, size: np.ndarray, a: int, starts: int, least: int) -> np.ndarray:
        """First block, further blocks, query, common trigrams of all blocks, common and distinct ones of the blocks between."""
        found = [np.zeros((6, 0), np.int64)]
        # Common trigrams of all blocks >= score x (size + foreign ones of the blocks between), in whole numbers: the score is rounded down.
        most = 1 + max(2 * size.max(), np.ceil(best[queries].max() * (size.max() + distinct[len(common) - 1].max())))
        kind = np.uint16 if most * 64 < 1 << 16 else np.uint64
        unit = kind((65_535 if kind == np.uint16 else 1 << 40) // most)
        score = np.floor(best[queries] * float(unit)).astype(kind)
        alone = score * size.astype(kind)
        for n in range(least, len(common)):
            c = common[n][:starts]
            if n < 2:
                open_ = np.flatnonzero(c.astype(kind, copy=False) * unit >= alone)
            else:
                inner = common[n - 2][1 : 1 + len(c)].astype(kind, copy=False) * score
                inner += c.astype(kind, copy=False) * unit
                open_ = np.flatnonzero(inner >= distinct[n - 2][a + 1 : a + 1 + len(c), None].astype(kind) * score + alone)
            if len(open_):
                row, col = np.divmod(open_, len(queries))
                between = (common[n - 2][row + 1, col], distinct[n - 2][a + row + 1]) if n > 1 else np.zeros((2, len(row)))
                found.append(np.stack([row + a, np.full(len(row), n), col, c[row, col], *between]).astype(np.int64))
        return np.concatenate(found, axis=1)

    def count_cells(cells: np.ndarray, queries: np.ndarray, rows: np.ndarray, size: np.ndarray, block: int) -> None:
        """Raise the best of the queries by all stretches that begin in a cell's first block and end in its last."""
        bound = cells[3] / (size[cells[2]] + cells[5] - cells[4])
        order, places = np.argsort(-bound), np.arange(block)
        together = max(1, _TOGETHER * 16 // block)
        while len(order):
            order = order[bound[order] > best[queries[cells[2, order]]]]
            now, order = order[:together], order[together:]
            first, more, col, _, common, other = cells[:, now]
            head, tail = first[:, None] * block + places, (first + more)[:, None] * block + places
            hit, ends = rows[spots[head], col[:, None]] > 0, rows[spots[tail], col[:, None]] > 0
            # Of the first block, what neither it nor the blocks between have later; of the last, what is nowhere earlier.
            last = (after[head] >= tail[:, :1]) & (more[:, None] > 0)
            c = common[:, None] + np.cumsum((last & hit)[:, ::-1], axis=1)[:, ::-1]
            d = other[:, None] + np.cumsum(last[:, ::-1], axis=1)[:, ::-1]
            most = c + (ends & (before[tail] <= head[:, -1:])).sum(axis=1)[:, None]
            # The best stretch begins with a trigram of the query.
            cell, at = np.nonzero(hit & (most > best[queries[col]][:, None] * (size[col, None] + d - c)))
            if not len(cell):
                continue
            start, tail = head[cell, at, None], tail[cell]
            new = (before[tail] < start) & (tail >= start)
            c = c[cell, at, None] + np.cumsum(new & ends[cell], axis=1)
            d = d[cell, at, None] + np.cumsum(new, axis=1)
            np.maximum.at(best, queries[col[cell]], (c / (size[col[cell], None] + d - c)).max(axis=1))

    queries, shortest = np.flatnonzero(shared > best * sizes), 1
    for block, reach in _LEVELS:
        if not len(queries):
            break
        blocks = -(-length // block)
        own, reach = np.arange(blocks * block) // block, min(reach, blocks)
        new_to = own - before[: len(own)] // block - 1
        distinct = [plane[:, 0] for plane in _block_counts(new_to, np.ones((len(own), 1), np.int32), block, reach)]
        alive, some = [queries[:0]], max(1, _CELLS // (reach * reach))
        for at in range(0, len(queries), some):
            alive.append(search(queries[at : at + some], block, (shortest - 1) // block, reach, own, new_to, distinct))
        # Stretches that end so many blocks on are longer than that.
        queries, shortest = np.concatenate(alive), (reach - 1) * block + 2
    for query in queries:
        best[query] = max(best[query], best_stretch_long(vocabulary[np.flatnonzero(member[:-1, query])], target, best[query]))
    return np.where(best > floor, best, 0.0)


def stretch_score(query: np.ndarray, query_set: set[int], target: np.ndarray, beat: float = 0.0) -> float:
    """Word similarity of prepared trigrams; 0 when it does not exceed ``beat``."""
    if target.size > LONG:
        return best_stretch_long(query, target, beat)
    return best_stretch(query_set, target.tolist(), beat)


def _slices(left: pd.Series, right: pd.Series) -> list[slice]:
    """Cuts rows into runs of some _SLICE_CHARS characters, of one row at least."""
    lengths = np.array([len(a or "") + len(b or "") for a, b in zip(left, right, strict=True)], dtype=np.int64)
    run = np.cumsum(lengths) // _SLICE_CHARS
    cuts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(lengths)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


@F.pandas_udf(DoubleType())
def word_similarity(query: pd.Series, target: pd.Series) -> pd.Series:
    """``word_similarity`` of two text columns; 0 when either is empty. Texts are prepared a slice at a time."""
    scores: list[float] = []
    for part in _slices(query, target):
        queries, query_at = batch_trigrams(query.iloc[part].tolist())
        targets, target_at = batch_trigrams(target.iloc[part].tolist())
        scores.extend(
            stretch_score(wanted := np.unique(queries[query_at[i] : query_at[i + 1]]), set(wanted.tolist()),
                          targets[target_at[i] : target_at[i + 1]])
            for i in range(part.stop - part.start)
        )
    return pd.Series(scores, dtype="float64")
