"""Sequence alignment: scores and traces of short sequences, one pair of lists a row, and what is read off them."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = -5


def similarity(a: str, b: str) -> int:
    """SCF-11: 100 equal, 80 one in the other, up to 60 by shared words, 10 both empty, else 0."""
    if not a or not b:
        return 0 if a or b else 10
    if a == b:
        return 100
    if a in b or b in a:
        return 80
    x, y = set(a.split()), set(b.split())
    return len(x & y) * 60 // max(len(x), len(y)) if x and y else 0


def similarity_of(a: Column, b: Column) -> Column:
    """SCF-11 of two columns, by Spark's own functions."""
    x, y = F.array_distinct(F.split(a, r"\s+")), F.array_distinct(F.split(b, r"\s+"))
    shared = F.floor(F.size(F.array_intersect(x, y)) * 60 / F.greatest(F.size(x), F.size(y)))
    some = (a != "") & (b != "")
    return F.when(some & (a == b), 100).when((a == "") & (b == ""), 10).when(~some, 0).when(F.contains(a, b) | F.contains(b, a), 80).otherwise(shared).cast("int")


#: Cells whose moves are kept at once; a longer pair keeps every so manieth row of scores and works out the moves again.
CELLS = 1 << 24


def _row(best: np.ndarray, scores: np.ndarray, gap: int, steps: np.ndarray, moves: bool = False):
    """The next row of scores of P alignments [P, n + 1], and the moves that lead there: 0 pair, 1 skip in a, 2 skip in b.

    A skip in b comes from the left in the same row; with one price for all skips that is a running maximum.
    """
    pair, up = best[:, :-1] + scores, best[:, 1:] + gap
    new = np.empty_like(best)
    new[:, 0] = best[:, 0] + gap
    new[:, 1:] = np.maximum(pair, up)
    new = np.maximum.accumulate(new - steps, axis=1) + steps
    if not moves:
        return new, None
    left = new[:, :-1] + gap
    return new, np.where((pair >= up) & (pair >= left), 0, np.where(up >= left, 1, 2)).astype(np.uint8)


def _walk(move, scored, i, j, stop: int, out: list, least: int) -> tuple[int, int]:
    """Back from cell (i, j) to row ``stop``; pairs of at least that score go to ``out``."""
    while i > stop and j:
        k = move(i, j)
        if k == 0 and scored(i - 1)[j - 1] >= least:
            out.append((i - 1, j - 1))
        i, j = i - (k != 2), j - (k != 1)
    return i, j


def aligned_long(n_a: int, n_b: int, scored, gap: int = GAP, least: int = 1) -> list[tuple[int, int]]:
    """Pairs of places of a best global alignment of two sequences; scored(i): scores of the i-th of a with all of b.

    Rows of scores are kept at regular distances only, as many as a stretch between two of them has; the moves of a
    stretch are worked out again from its first row. So memory grows with n_b times the root of n_a.
    """
    steps = np.arange(n_b + 1, dtype=np.int64) * gap
    every = max(1, min(n_a, max(int(np.sqrt(n_a)), CELLS // max(1, n_b + 1)) if n_a * n_b > CELLS else n_a))
    best, kept = steps[None].copy(), []
    for i in range(n_a):
        if i % every == 0:
            kept.append(best)
        if i < (n_a - 1) // every * every:  # the last stretch is worked out below
            best, _ = _row(best, scored(i)[None], gap, steps)
    out: list[tuple[int, int]] = []
    i, j = n_a, n_b
    for start in range((n_a - 1) // every * every, -1, -every) if n_a else ():
        best, ways = kept.pop(), []
        for r in range(start, i):
            best, way = _row(best, scored(r)[None], gap, steps, True)
            ways.append(way[0])
        i, j = _walk(lambda i, j, w=ways, s=start: w[i - 1 - s][j - 1], scored, i, j, start, out, least)
        if not j:
            break
    return out[::-1]


def aligned_batch(scores: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, gap: int = GAP, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for P pairs at once: scores [P, m, n], of which the p-th fills [n_a[p], n_b[p]]. Pairs of places as (p, i, j), from the end."""
    p, m, n = scores.shape
    steps = np.arange(n + 1, dtype=np.int64) * gap
    best, ways = np.repeat(steps[None], p, 0), np.zeros((p, m, n), np.uint8)
    for r in range(m):
        best, ways[:, r] = _row(best, scores[:, r], gap, steps, True)
    i, j, all_, out = n_a.copy(), n_b.copy(), np.arange(p), []
    live = all_[(i > 0) & (j > 0)]
    while len(live):
        x, y = i[live] - 1, j[live] - 1
        way = ways[live, x, y]
        q = (way == 0) & (scores[live, x, y] >= least)
        out.append((live[q], x[q], y[q]))
        i[live] -= way != 2
        j[live] -= way != 1
        live = live[(i[live] > 0) & (j[live] > 0)]
    return tuple(np.concatenate([o[k] for o in out] or [np.zeros(0, np.int64)]) for k in range(3))


def exact(a: str, b: str) -> int:
    """100 for equal words, else 0: a pair of different words costs less than two skips, and is not reported."""
    return 100 if a == b else 0


def _inside(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (c, d) of different texts of which d lies inside c: pieces of c are looked up, or the texts searched for in c if those are fewer."""
    known, c, d = {t: k for k, t in enumerate(texts)}, [], []
    lengths = sorted({len(t) for t in texts})
    for k, t in enumerate(texts):
        shorter = lengths[: bisect.bisect_left(lengths, len(t))]
        if len(t) * len(shorter) > 4 * len(texts):
            held = {v for u, v in known.items() if len(u) < len(t) and u in t}
        else:
            held = {known[t[s : s + n]] for n in shorter for s in range(len(t) - n + 1) if t[s : s + n] in known}
        c += [k] * len(held)
        d += held
    return np.array(c, np.int64), np.array(d, np.int64)


class Scores:
    """Scores of ``texts`` by number. Single words by :func:`similarity` are looked up by their pieces, so that unlike ones cost
    nothing; by other measures each different pair of texts is scored once."""

    def __init__(self, texts: list[str], score):
        self.texts, self.score, self.known, self.like = texts, score, {}, None
        if score is similarity and all(t and t.split() == [t] for t in texts):
            c, d = _inside(texts)
            each = np.arange(len(texts))
            one, other = np.concatenate([each, c, d]), np.concatenate([each, d, c])
            order = np.argsort(one, kind="stable")
            value = np.repeat(np.array([100, 80], np.int16), [len(each), 2 * len(c)])
            self.like = np.searchsorted(one[order], np.arange(len(texts) + 1)), other[order], value[order]

    def grid(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Scores [P, m, n] of the numbers x [P, m] and y [P, n]."""
        if self.score is exact:
            return (x[:, :, None] == y[:, None, :]) * np.int16(100)
        a, at_a = np.unique(x, return_inverse=True)
        b, at_b = np.unique(y, return_inverse=True)
        at_a, at_b = at_a.reshape(x.shape)[:, :, None], at_b.reshape(y.shape)[:, None, :]
        if self.like is None:
            pairs, back = np.unique(at_a * len(b) + at_b, return_inverse=True)
            values = []
            for u, v in zip(a[pairs // len(b)].tolist(), b[pairs % len(b)].tolist(), strict=True):
                if (u, v) not in self.known:
                    self.known[u, v] = self.score(self.texts[u], self.texts[v])
                values.append(self.known[u, v])
            return np.array(values, np.int64)[back].reshape(len(x), x.shape[1], y.shape[1])
        first, other, value = self.like
        n = first[a + 1] - first[a]
        row = np.repeat(np.arange(len(a)), n)
        at = np.arange(len(row)) + np.repeat(first[a] - np.cumsum(n) + n, n)
        to = np.minimum(np.searchsorted(b, other[at]), len(b) - 1)
        there = b[to] == other[at]
        table = np.zeros((len(a), len(b)), np.int16)
        table[row[there], to[there]] = value[at[there]]
        return table[at_a, at_b]


#: Lists of texts as the numbers of their texts, one list behind another, and the lists' sizes.
Lists = tuple[np.ndarray, np.ndarray]


def _numbered(*columns: pa.Array) -> tuple[list[str], list[Lists]]:
    """The different texts of columns of lists, and each column as numbers of texts; null lists are empty."""
    flat = [c.flatten() for c in columns]
    coded = pa.concat_arrays(flat).dictionary_encode(null_encoding="encode")
    numbers = np.split(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum([len(f) for f in flat])[:-1])
    return coded.dictionary.to_pylist(), [(k, pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)) for k, c in zip(numbers, columns, strict=True)]


def _sliced(work, *columns: pa.Array) -> pa.Array:
    """``work`` on some hundred thousand texts at a time, so that a task's arrays don't grow with the rows of a batch."""
    size = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    part = np.cumsum(size) // (1 << 18)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    return pa.concat_arrays([work(*(c.slice(k, m - k) for c in columns)) for k, m in zip(cuts, cuts[1:], strict=False)])


def _listed(p: np.ndarray, n: int, **fields: np.ndarray) -> pa.Array:
    """Structs of ``fields`` as n lists; the list of each is in ``p``, in order."""
    ends = np.concatenate([[0], np.cumsum(np.bincount(p, minlength=n))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(v.astype(np.int32)) for v in fields.values()], list(fields)))


def _batches(a: Lists, b: Lists, cells: int):
    """Numbers of the pairs of lists that go together, as (group, x, y): pairs of like size, padded to one size."""
    (x, n_x), (y, n_y) = a, b
    at_x, at_y = np.cumsum(n_x) - n_x, np.cumsum(n_y) - n_y
    order = np.lexsort((n_y, n_x))
    sizes = list(zip(n_x[order].tolist(), n_y[order].tolist(), strict=True))
    padded = lambda v, at, size, n: v[np.minimum(at[:, None] + np.minimum(np.arange(n), np.maximum(size, 1)[:, None] - 1), max(len(v) - 1, 0))] if len(v) else np.zeros((len(at), n), np.int64)
    at = 0
    while at < len(order):
        end, m, n = at, 0, 0
        while end < len(order):
            u, v, k = sizes[end][0], max(n, sizes[end][1]), end - at + 1
            # the second: what a table of all words of the one side and of the other may hold
            if end > at and (k * u * v > cells or k * k * u * v > 32 * cells or k * (u + v) > cells):
                break
            end, m, n = end + 1, u, v
        group = order[at:end]
        yield group, padded(x, at_x[group], n_x[group], m), padded(y, at_y[group], n_y[group], n)
        at = end


def align_numbers(texts: list[str], a: Lists, b: Lists, score=similarity, gap: int = GAP, least: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places of each two lists as (p, i, j), in order. Short pairs of like size go together, as one array; long ones alone."""
    table, found = Scores(texts, score), []
    some = (a[1] > 0) & (b[1] > 0)
    number = np.flatnonzero(some)
    kept = [(v[np.repeat(some, size)], size[some]) for v, size in (a, b)]
    for group, x, y in _batches(*kept, CELLS // 32):
        m, n = x.shape[1], y.shape[1]
        if len(group) > 1 or m * n <= CELLS // 8:
            p, i, j = aligned_batch(table.grid(x, y), kept[0][1][group], kept[1][1][group], gap, least)
            found.append((number[group[p]], i, j))
            continue
        known: dict = {}  # one long pair
        each, back = np.unique(y[0], return_inverse=True)

        def scored(r, x=x[0], each=each[None], back=back, known=known):
            if score is exact:
                return table.grid(x[None, r : r + 1], each)[0, 0][back]
            if x[r] not in known:
                known[x[r]] = table.grid(x[None, r : r + 1], each)[0, 0]
            return known[x[r]][back]

        pairs = np.array(aligned_long(m, n, scored, gap, least), np.int64).reshape(-1, 2)
        found.append((np.full(len(pairs), number[group[0]]), pairs[:, 0], pairs[:, 1]))
    p, i, j = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    order = np.lexsort((i, p))
    return p[order], i[order], j[order]


def align_lists(a: list[list[str]], b: list[list[str]], score=similarity, gap: int = GAP, least: int = 1) -> list[list[tuple[int, int]]]:
    """Pairs of places for each two lists of texts."""
    texts, numbers = _numbered(pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())))
    out: list = [[] for _ in a]
    for p, i, j in zip(*(v.tolist() for v in align_numbers(texts, *numbers, score, gap, least)), strict=True):
        out[p].append((i, j))
    return out


def aligned(a: list[str], b: list[str], score=similarity, gap: int = GAP) -> list[tuple[int, int]]:
    """SCF-12: pairs of places of a best global alignment, those of positive score; the diagonal before a skip in ``b``'s place,
    that before one in ``a``'s."""
    return align_lists([a], [b], score, gap)[0]


def align(rows: DataFrame, score=similarity, gap: int = GAP, columns: tuple[str, str] = ("a", "b"), least: int = 0) -> DataFrame:
    """``rows`` (key columns, and two ``columns`` of array<string>) with pairs array<struct<i, j>>; null lists have none.

    ``least``: pairs of a smaller score are not reported. 0 keeps those that are not alike and only cost less than two skips; SCF-12 is 1."""

    @F.arrow_udf("array<struct<i int, j int>>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            texts, numbers = _numbered(a, b)
            p, i, j = align_numbers(texts, *numbers, score, gap, least)
            yield _listed(p, len(a), i=i, j=j)

    # a filter on what is made of the pairs must not run the alignment once more below itself
    return rows.withColumn("pairs", run.asNondeterministic()(*columns))


def distances(a: Lists, b: Lists) -> np.ndarray:
    """Edit distances of each two lists; a row of scores is kept at a time."""
    out = b[1].copy()
    for group, x, y in _batches(a, b, CELLS // 32):
        steps = -np.arange(y.shape[1] + 1, dtype=np.int64)
        best = np.repeat(steps[None], len(group), 0)
        for r in range(x.shape[1]):
            best, _ = _row(best, np.where(x[:, r, None] == y, 0, -1), -1, steps)
            ended = np.flatnonzero(a[1][group] == r + 1)
            out[group[ended]] = -best[ended, b[1][group[ended]]]
    return out


def word_errors(reference: Column, found: Column) -> Column:
    """AGG-28: edit distance (S + D + I) of two arrays of words, whole. Null words count as none; null without either array."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        _, numbers = _numbered(a, b)
        return pa.array(distances(*numbers).astype(np.int32), mask=pc.or_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False))

    return run(F.array_compact(reference), F.array_compact(found))


def jaro_winkler(a: str, b: str, boost: float = 0.1) -> float:
    """SCF-28: Jaro similarity with up to four letters of a common beginning counted again."""
    if a == b:
        return 1.0
    reach, used, left = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == c), None)
        if j is not None:
            used[j] = True
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    m, t = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    start = next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)
    return jaro + start * boost * (1 - jaro)


def alike(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else jaro_winkler(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


def error_rate(pairs: DataFrame) -> DataFrame:
    """AGG-28: ``pairs`` (reference, found) with errors, n (words of the reference) and rate, errors / n (null without words)."""
    errors, n = word_errors(F.col("reference"), F.col("found")).cast("long"), F.size("reference").cast("long")
    return pairs.withColumns({"errors": errors, "n": n}).withColumn("rate", F.when(F.col("n") > 0, F.col("errors") / F.col("n"))).drop("reference", "found")


def agreement(pairs: DataFrame) -> DataFrame:
    """AGG-28, the other counts: ``pairs`` (reference, found) with matches, deletions and insertions of an alignment on equal words, and
    accuracy, matches / words of the reference (null without words). What is replaced counts as deleted and inserted."""
    x = align(pairs.withColumns({"_a": F.col("reference"), "_b": F.col("found")}), exact, columns=("_a", "_b"), least=1)
    n, m = F.size("reference").cast("long"), F.size("pairs").cast("long")
    counted = x.withColumns({"matches": m, "deletions": n - m, "insertions": F.size("found").cast("long") - m, "accuracy": F.when(n > 0, m / n)})
    return counted.drop("reference", "found", "_a", "_b", "pairs")


# --- anchors


def rising(js: list[int]) -> list[int]:
    """Places of a longest rising chain of ``js``; of equally long ones that whose end is the smallest. Patience sorting."""
    ends, ids, back = [], [], []
    for at, j in enumerate(js):
        k = bisect.bisect_left(ends, j)
        back.append(ids[k - 1] if k else None)
        ends[k : k + 1], ids[k : k + 1] = [j], [at]
    at, out = (ids[-1] if ids else None), []
    while at is not None:
        out.append(at)
        at = back[at]
    return out[::-1]


def chain(points: DataFrame) -> DataFrame:
    """The longest chain of ``points`` (file, i, j) that rises in i and in j, of each file; of equally long ones that whose last
    points have the smallest j. Patience sorting: one pass over a file's points by i, with the least j that ends a chain of each length."""

    def run(batches):
        file, points = None, []

        def chosen():
            out = [points[k] for k in rising([j for _, j in points])]
            return pa.RecordBatch.from_arrays([pa.array([file] * len(out), pa.int64()), pa.array([i for i, _ in out], pa.int64()), pa.array([j for _, j in out], pa.int64())], ["file", "i", "j"])

        for batch in batches:
            for f, i, j in zip(*(batch.column(c).to_pylist() for c in ("file", "i", "j")), strict=True):
                if f != file:
                    if points:
                        yield chosen()
                    file, points = f, []
                points.append((i, j))
        if points:
            yield chosen()

    p = points.select(F.col("file").cast("long").alias("file"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))
    return p.repartition("file").sortWithinPartitions("file", "i").mapInArrow(run, "file long, i long, j long")


def _places(lists: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the number of its list and its place in it."""
    size = lists[1]
    return np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _met(a: Lists, b: Lists, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, i, j): where runs of ``n`` texts start that occur once in either list of pair p, in order of i."""
    sides, width = [], max((int(x.max()) + 1 for x, _ in (a, b) if len(x)), default=1)
    for x, size in (a, b):
        p, at = _places((x, size))
        start = np.flatnonzero(at + n <= size[p])
        sides.append((x, p[start], at[start], start))
    cut = len(sides[0][3])
    ids = np.concatenate([s[1] for s in sides])
    for k in range(n):
        if len(ids) and (int(ids.max()) + 1) * width >= 1 << 62:
            ids = np.unique(ids, return_inverse=True)[1]
        ids = ids * width + np.concatenate([x[start + k] for x, _, _, start in sides])
    once = []
    for part in (ids[:cut], ids[cut:]):
        run, first, times = np.unique(part, return_index=True, return_counts=True)
        once.append((run[times == 1], first[times == 1]))
    _, k, m = np.intersect1d(once[0][0], once[1][0], assume_unique=True, return_indices=True)
    p, i, j = sides[0][1][once[0][1][k]], sides[0][2][once[0][1][k]], sides[1][2][once[1][1][m]]
    order = np.lexsort((i, p))
    return p[order], i[order], j[order]


def anchored_numbers(texts: list[str], a: Lists, b: Lists, n: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """NLP-01 for pairs of lists of words: (p, i, j) of the words that are the same, in order."""
    p, i, j = _met(a, b, n)
    # only pairs whose runs don't rise as they are need the search for a chain
    falls = np.unique(p[1:][(p[1:] == p[:-1]) & (j[1:] <= j[:-1])])
    kept = ~np.isin(p, falls)
    for f in falls.tolist():
        first, last = np.searchsorted(p, [f, f + 1])
        kept[first + np.array(rising(j[first:last].tolist()))] = True
    # an anchor is n pairs; anchors that overlap share some
    more = np.tile(np.arange(n), kept.sum())
    first_a, first_b, of_a = np.cumsum(a[1]) - a[1], np.cumsum(b[1]) - b[1], _places(a)[0]
    p, width = np.repeat(p[kept], n), len(b[0]) + 1
    pairs = np.unique((first_a[p] + np.repeat(i[kept], n) + more) * width + first_b[p] + np.repeat(j[kept], n) + more)
    p = of_a[pairs // width]
    i, j = pairs // width - first_a[p], pairs % width - first_b[p]
    # two anchors may claim a place for different partners where they overlap unevenly: the earlier one has it
    first = lambda v: np.concatenate([[True], (p[v[1:]] != p[v[:-1]])])
    ok = np.ones(len(p), bool)
    for by, then in ((i, j), (j, i)) if len(p) else ():
        v = np.lexsort((then, by, p))
        ok[v] &= first(v) | np.concatenate([[True], by[v[1:]] != by[v[:-1]]])
    p, i, j = p[ok], i[ok], j[ok]

    sides, big = [], len(a[0]) + len(b[0]) + 1
    for (x, size), place in ((a, i), (b, j)):
        of, at = _places((x, size))
        taken = np.zeros(len(x), np.int64)
        taken[(np.cumsum(size) - size)[p] + place] = 1
        before = np.cumsum(taken)
        gap = before - np.concatenate([[0], before])[(np.cumsum(size) - size)[of]]
        free = taken == 0
        sides.append((x[free], at[free], of[free] * big + gap[free]))
    both = np.intersect1d(sides[0][2], sides[1][2])
    lists = []
    for x, at, gap in sides:
        here = np.isin(gap, both)
        starts = np.searchsorted(gap[here], both)
        lists.append((x[here], at[here], starts, np.diff(np.append(starts, here.sum()))))
    q, u, v = align_numbers(texts, *((x, size) for x, _, _, size in lists), exact)
    rest = both[q] // big, lists[0][1][lists[0][2][q] + u], lists[1][1][lists[1][2][q] + v]
    p, i, j = (np.concatenate(both_) for both_ in zip((p, i, j), rest, strict=True))
    order = np.lexsort((i, p))
    return p[order], i[order], j[order]


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """(file, name): the rows of a file as one list of structs, by pos."""
    return rows.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("pos", "word", *(c for c in rows.columns if c not in ("file", "pos", "word"))))).alias(name))


def anchored(a: DataFrame, b: DataFrame, n: int = 3) -> DataFrame:
    """NLP-01: (file, i, j), the places of words of ``a`` and ``b`` (file, pos, word; pos counts from 0) that are the same word.

    Runs of n words that occur once on both sides are anchors; of these the longest rising chain is kept, and only
    what lies between two anchors is aligned, so that no file is ever compared with a file. A file is one row of words.
    """

    @F.arrow_udf("array<struct<i int, j int>>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        def work(x, y):
            texts, numbers = _numbered(x, y)
            p, i, j = anchored_numbers(texts, *numbers, n)
            return _listed(p, len(x), i=i, j=j)

        return _sliced(work, x, y)

    both = _packed(a, "x").join(_packed(b, "y"), "file")
    pairs = both.withColumn("p", run.asNondeterministic()(F.col("x.word"), F.col("y.word")))
    return pairs.select(F.col("file").cast("long").alias("file"), F.explode("p").alias("p")).select("file", F.col("p.i").cast("long").alias("i"), F.col("p.j").cast("long").alias("j"))


def times(words: Column, heard: Column, starts: Column, n: int = 3) -> Column:
    """NLP-01 by rows: of each of ``words`` array<string> its start_ms, that of the word of ``heard`` it is aligned to (``starts``
    array<long>; null if to none), and word_end: the next known start, 500 ms after its own for the last. Null without words."""

    @F.arrow_udf("array<struct<start_ms long, word_end long>>")
    def run(x: pa.Array, y: pa.Array, ms: pa.Array) -> pa.Array:
        return _sliced(work, x, y, ms)

    def work(x, y, ms):
        texts, (a, b) = _numbered(x, y)
        p, i, j = anchored_numbers(texts, a, b, n)
        known, first_b = ms.flatten(), np.cumsum(b[1]) - b[1]
        start = known.take(pa.array(first_b[p] + j))
        has = start.is_valid().to_numpy(zero_copy_only=False)
        at, value, p = ((np.cumsum(a[1]) - a[1])[p] + i)[has], start.drop_null().to_numpy().astype(np.int64), p[has]
        follows = np.append(p[1:] == p[:-1], False) if len(p) else np.zeros(0, bool)
        ends = np.where(follows, np.append(value[1:], 0)[: len(value)], value + 500)
        columns = []
        for v in (value, ends):
            all_, none = np.zeros(len(a[0]), np.int64), np.ones(len(a[0]), bool)
            all_[at], none[at] = v, False
            columns.append(pa.array(all_, mask=none))
        offsets = np.concatenate([[0], np.cumsum(a[1])]).astype(np.int32)
        none = pa.array(x.is_null().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["start_ms", "word_end"]), mask=none)

    # what is made of the times must not run the alignment once more below itself
    return run.asNondeterministic()(words, heard, starts)


def recovered(words: DataFrame, timed: DataFrame, n: int = 3) -> DataFrame:
    """NLP-01: ``words`` (file, pos, word) with the start_ms and word_end of :func:`times`, from ``timed`` (file, pos, word, start_ms)."""
    both = _packed(words, "x").join(_packed(timed.select("file", "pos", "word", "start_ms"), "y"), "file", "left")
    found = both.withColumn("t", times(F.col("x.word"), F.col("y.word"), F.col("y.start_ms"), n))
    return found.select("file", F.explode(F.arrays_zip("x", "t")).alias("r")).select("file", "r.x.*", "r.t.*")


def grouped(rows: DataFrame, limit_ms: int) -> DataFrame:
    """WIN-14, second part: consecutive utterances (file, idx, est_start, est_end) in groups that span at most ``limit_ms``.

    Greedy and so sequential: one pass over each file's rows in order, which are streamed, so that no file has to fit a task.
    """

    def run(batches):
        file, group, start = None, 0, None
        for batch in batches:
            out = []
            for f, s, e in zip(*(batch.column(c).to_pylist() for c in ("file", "est_start", "est_end")), strict=True):
                if f != file:
                    file, group, start = f, 0, s
                elif e - start > limit_ms:
                    group, start = group + 1, s
                out.append(group)
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("idx"), pa.array(out, pa.int64())], ["file", "idx", "group"])

    r = rows.select(F.col("file").cast("long").alias("file"), F.col("idx").cast("long").alias("idx"), "est_start", "est_end")
    return r.repartition("file").sortWithinPartitions("file", "idx").mapInArrow(run, "file long, idx long, group long")


def group_totals(rows: DataFrame) -> DataFrame:
    """AGG-26: groups, utterances and words in them, by file, of rows (file, group, words)."""
    one = rows.groupBy("file", "group").agg(F.count("*").alias("u"), F.sum("words").alias("w"))
    return one.groupBy("file").agg(F.count("*").alias("groups"), F.sum("u").alias("utterances"), F.sum("w").alias("words"))
