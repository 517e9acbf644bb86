"""Operator 13: BPE encoding and decoding through a minimal acyclic transducer of the frequent words.

*Words.* A text is cut as the tokenizer file says: special tokens first, then the normaliser, then the pre-tokeniser. For code
points below ``LATIN`` both are read off the file once, as a class and a lower case for each, and applied by numpy to a
megabyte of text at a time. A piece between blanks that holds anything else (an apostrophe, a code point beyond, the start
of a special token) goes through the file's own normaliser and pre-tokeniser, once for each distinct piece of the chunk.

*Lexicon.* The words of all documents are counted, and those at or above the least count that leaves no more than ``most``
of them are compiled with their ids into the minimal transducer: equal suffixes share states, ids lie on the edges as near
the root as they can. It is written to the shared folder, handed to the executors as a file and memory-mapped there.
Its size is bounded by ``most`` words of up to ``LONGEST`` bytes, whatever the corpus; it changes no result.

*Encoding.* All distinct words of a chunk walk the transducer together, a byte a step; their ids are the outputs along the
path. Words that fall off it are merged exactly, by rank and then from the left: up to ``GRID`` bytes all at once in numpy, longer ones with a heap.

*Decoding.* The vocabulary's tokens joined by one blank, which is what the library does for a file without a decoder; files with
one are refused.

Nulls: a null text is empty, an empty text has no ids; a null doc_id is kept. Repeated rows each give a row. A very long text
is cut at blanks and encoded piece by piece. An empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import uuid
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import run_hashes, shared_dir, slices, small_batches, staged, table

LATIN, GRID, LONGEST, CHUNK = 0x250, 64, 48, 1 << 21
ODD, LETTER, NUMBER, OTHER, BLANK = range(5)

#: The characters that a byte-level vocabulary writes for the bytes 0 to 255: printable Latin-1 as it is, the others from U+0100 on.
_PLAIN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_SHOWN = [chr(b if b in _PLAIN else 256 + b - sum(x < b for x in _PLAIN)) for b in range(256)]
_BYTE = {c: b for b, c in enumerate(_SHOWN)}


class Splitter:
    """Texts to words, as bytes, by the normaliser and the pre-tokeniser of a tokenizer file."""

    def __init__(self, path: str, cached: int = 200_000):
        from tokenizers import Tokenizer

        tok, spec = Tokenizer.from_file(path), json.loads(Path(path).read_text())
        self.normal, self.pre, self.cached = tok.normalizer, tok.pre_tokenizer, cached
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] or " " in a["content"] for a in spec["added_tokens"]):
            raise ValueError("only added tokens that stand for themselves are supported")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.kind, self.low = np.zeros(LATIN + 1, np.uint8), np.arange(LATIN + 1, dtype=np.uint32)
        for c in range(LATIN):
            self.kind[c], self.low[c] = self._look(chr(c))
        self.heads = {ord(a[0]): ord(a[1]) for a in self.added if len(a) > 1}
        self.memory: dict[str, list] = {}

    def _look(self, c: str) -> tuple[int, int]:
        """Class and lower case of a character that neither its neighbours nor the normaliser's other rules change."""
        seen = self.normal.normalize_str(f"a{c}a")[1:-1]
        if c == "'" or len(seen) != 1 or ord(seen) >= LATIN:
            return ODD, ord(c)
        one, two = (len(self.pre.pre_tokenize_str(f"a{x}a")) for x in (seen, seen * 2))
        return {(1, 1): LETTER, (2, 2): BLANK, (3, 4): NUMBER, (3, 3): OTHER}.get((one, two), ODD), ord(seen)

    def piece(self, text: str) -> list:
        """The words of a piece, and the ids of its special tokens, by the file's own rules."""
        found = self.memory.get(text)
        if found is None:
            found = []
            for part in self.special.split(text) if self.special else [text]:
                if part in self.added:
                    found.append(self.added[part])
                elif part:
                    found += [bytes(map(_BYTE.__getitem__, w)) for w, _ in self.pre.pre_tokenize_str(self.normal.normalize_str(part))]
            if len(self.memory) < self.cached and len(text) <= LONGEST:
                self.memory[text] = found
        return found

    def split(self, parts: list[str]) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
        """Words, special ids, the order they come in (numbers of words; -1-k for special id k), first place of each part."""
        text = "\n".join(parts)
        c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        first = np.cumsum([0, *(len(p) + 1 for p in parts)])
        small = np.minimum(c, LATIN)
        kind = self.kind[small]
        for a, b in self.heads.items():
            kind[np.flatnonzero((c[:-1] == a) & (c[1:] == b))] = ODD
        blank = kind == BLANK
        piece = np.cumsum(blank)
        odd = np.zeros(len(c) + 1, bool)
        odd[piece[kind == ODD]] = True
        odd = odd[piece] & ~blank
        kind[odd] = ODD
        before = np.concatenate(([BLANK], kind[:-1]))[: len(c)]
        head = ~blank & ((kind != before) | (kind == NUMBER))
        ended = np.concatenate((head[1:] | blank[1:], [True]))[: len(c)] & ~blank
        starts, ends = np.flatnonzero(head), np.flatnonzero(ended) + 1
        value = np.where(odd, c, self.low[small])
        unique, place = _distinct(value, odd, starts, ends - starts)
        texts = _texts(value, starts[unique], ends[unique])
        strange = odd[starts[unique]] if len(unique) else np.zeros(0, bool)
        words = [t.encode() for t in texts]
        if not strange.any():
            return words, [], place, np.searchsorted(starts, first)
        # distinct odd pieces give way to the words they are made of
        special: list[int] = []
        each, flat = np.ones(len(words), np.int64), []
        for i in np.flatnonzero(strange).tolist():
            found = self.piece(texts[i])
            each[i] = len(found)
            for w in found:
                flat.append(len(words) if isinstance(w, bytes) else -1 - len(special))
                (words if isinstance(w, bytes) else special).append(w)
        at = np.cumsum(each) - each
        made = np.zeros(int(each.sum()), np.int64)
        made[at[~strange]] = np.flatnonzero(~strange)
        made[_spread(at[strange], each[strange])] = flat
        count = each[place]
        before = np.cumsum(np.concatenate(([0], count)))
        return words, special, made[_spread(at[place], count)], before[np.searchsorted(starts, first)]


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i]+1, ... (counts[i] of them), one run after the other."""
    total = np.cumsum(counts)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(starts - (total - counts), counts)


def _distinct(value: np.ndarray, odd: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run numbers of the distinct runs, which of them each run is). Runs are found by hash and compared with what they were taken for."""
    hashes = run_hashes(value.astype(np.uint64) + np.uint64(1), starts, lengths)
    _, one, place = np.unique(hashes + odd[starts], return_index=True, return_inverse=True)
    place = place.ravel()
    of = one[place]
    differs = (lengths != lengths[of]) | (odd[starts] != odd[starts[of]])
    same = np.flatnonzero(~differs)
    unlike = value[_spread(starts[same], lengths[same])] != value[_spread(starts[of[same]], lengths[same])]
    if unlike.any():
        differs[np.repeat(same, lengths[same])[unlike]] = True
    apart = np.flatnonzero(differs)
    place[apart] = len(one) + np.arange(len(apart))
    return np.concatenate((one, apart)).astype(np.int64), place


def _texts(value: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    if not len(starts):
        return []
    lengths = ends - starts
    out = np.full(int(lengths.sum()) + len(starts), 10, np.uint32)
    out[_spread(np.cumsum(lengths + 1) - lengths - 1, lengths)] = value[_spread(starts, lengths)]
    return out[:-1].astype("<u4").tobytes().decode("utf-32-le").split("\n")


class Merges:
    """Exact merging of words by the file's ranked pairs."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or spec["decoder"] or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"]:
            raise ValueError("only byte-level BPE by merges alone, without a decoder, is supported")
        vocab = model["vocab"]
        self.inner, self.last = (np.array([vocab[c + s] for c in _SHOWN], np.int64) for s in ("", suffix))
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        tokens = vocab | {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.tokens = [""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.tokens[i] = t

    def rank(self, left, right) -> np.ndarray:
        """Rank of each pair, len(keys) if it is none."""
        ask = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
        return np.where(self.keys[at] == ask, self.ranks[at], len(self.keys))

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many it has); no word is empty."""
        lengths = np.array([len(w) for w in words], np.int64)
        starts, counts, out, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [np.zeros(0, np.int64)], 0
        for low, high in ((0, 8), (8, 12), (12, 16), (16, 32), (32, GRID)):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            if len(which):
                flat, each = self._grid([words[i] for i in which.tolist()], lengths[which], high)
                starts[which], counts[which] = n + np.cumsum(each) - each, each
                out.append(flat)
                n += len(flat)
        for i in np.flatnonzero(lengths > GRID).tolist():
            out.append(self._heap(words[i]))
            starts[i], counts[i] = n, len(out[-1])
            n += len(out[-1])
        return np.concatenate(out), starts, counts

    def _symbols(self, raw: np.ndarray) -> np.ndarray:
        s = self.inner[raw]
        s[-1:] = self.last[raw[-1:]]
        return s

    def _grid(self, words, lengths, width):
        none, n = len(self.keys), len(words)
        raw = np.zeros((n, width), np.uint8)
        inside = np.arange(width) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(words), np.uint8)
        s = np.full((n, width + 2), -1, np.int32)
        s[:, :width][inside] = self.inner[raw[inside]]
        s[np.arange(n), lengths - 1] = self.last[raw[np.arange(n), lengths - 1]]
        r = np.full((n, width + 2), none, np.int32)
        pair = s[:, 1:] >= 0
        r[:, :-1][pair] = self.rank(s[:, :-1][pair], s[:, 1:][pair])
        live, place = np.arange(n), np.arange(width + 2)
        while True:
            best = r[live].argmin(axis=1)
            found = r[live, best]
            on = found < none
            live, p, found = live[on], best[on], found[on]
            if not len(live):
                break
            # the pair at p becomes one symbol, what follows moves up
            source = np.minimum(place + (place > p[:, None]), width + 1)
            s[live], r[live] = np.take_along_axis(s[live], source, 1), np.take_along_axis(r[live], source, 1)
            s[live, p] = self.made[found]
            for at in (p - 1, p):
                ok = at >= 0
                row, a = live[ok], at[ok]
                left, right = s[row, a], s[row, a + 1]
                r[row, a] = np.where(right >= 0, self.rank(left, np.maximum(right, 0)), none)
        kept = s >= 0
        return s[kept], kept.sum(axis=1)

    def _heap(self, word: bytes) -> np.ndarray:
        s, none = self._symbols(np.frombuffer(word, np.uint8)).tolist(), len(self.keys)
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.rank(np.array(s[:-1], np.int64), np.array(s[1:], np.int64)).tolist()
        heap = [(r, i, s[i], s[i + 1]) for i, r in enumerate(ranks) if r < none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    r = int(self.rank(np.array([s[x]]), np.array([s[after[x]]]))[0])
                    if r < none:
                        heapq.heappush(heap, (r, x, s[x], s[after[x]]))
        return np.array([x for x in s if x >= 0], np.int64)


# --- the transducer --------------------------------------------------------------------------------------------------


def compile_lexicon(entries: list[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The minimal transducer of ``entries`` (distinct words, ascending) as one file image, see :class:`Lexicon`."""
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []
    # a state under construction: edges byte -> [target, ids]; ids at its end, or None
    path: list[tuple[dict, list]] = [({}, [None])]
    previous = b""

    def freeze(keep: int) -> None:
        while len(path) > keep + 1:
            edges, end = path.pop()
            key = (end[0], tuple((b, t, o) for b, (t, o) in edges.items()))
            if key not in register:
                register[key] = len(frozen)
                frozen.append(key)
            path[-1][0][previous[len(path) - 1]][0] = register[key]

    for word, ids in entries:
        shared = next((i for i, (a, b) in enumerate(zip(word, previous, strict=False)) if a != b), min(len(word), len(previous)))
        freeze(shared)
        for b in word[shared:]:
            path[-1][0][b] = [None, ()]
            path.append(({}, [None]))
        path[-1][1][0] = ()
        for i in range(shared):  # what both words begin with stays on the edge, the rest moves down
            edge, (edges, end) = path[i][0][word[i]], path[i + 1]
            k = next((j for j, (a, b) in enumerate(zip(edge[1], ids, strict=False)) if a != b), min(len(edge[1]), len(ids)))
            rest, edge[1], ids = edge[1][k:], edge[1][:k], ids[k:]
            if rest:
                for e in edges.values():
                    e[1] = rest + e[1]
                if end[0] is not None and i + 1 < len(word):
                    end[0] = rest + end[0]
        if shared < len(word):
            path[shared][0][word[shared]][1] = ids
        previous = word
    freeze(0)
    edges, end = path[0]
    frozen.append((end[0], tuple((b, t, o) for b, (t, o) in edges.items())))
    lines = [(s << 8 | b, t, o) for s, (_, out) in enumerate(frozen) for b, t, o in sorted(out)]
    outputs = [o for _, _, o in lines] + [e or () for e, _ in frozen]
    arrays = [
        np.array([k for k, _, _ in lines], "<i8"), np.array([t for _, t, _ in lines], "<i4"), np.array([e is not None for e, _ in frozen], np.uint8),
        np.cumsum([0, *map(len, outputs)]).astype("<i4"), np.array([i for o in outputs for i in o], "<i4"),
    ]
    return struct.pack("<6q", max((len(w) for w, _ in entries), default=0), *map(len, arrays)) + b"".join(a.tobytes() + bytes(-a.nbytes % 8) for a in arrays)


class Lexicon:
    """A transducer, memory-mapped: edges by (state, byte), their targets, final states, ids of edges and of final states."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        self.longest, *sizes = struct.unpack("<6q", raw[:48].tobytes())
        at, arrays = 48, []
        for n, kind in zip(sizes, ("<i8", "<i4", "u1", "<i4", "<i4"), strict=True):
            width = np.dtype(kind).itemsize
            arrays.append(raw[at : at + n * width].view(kind))
            at += n * width + -n * width % 8
        self.keys, self.target, self.final, self.first, self.ids = arrays

    def walk(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the words that are in the lexicon, their ids one after the other, how many each has)."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        live = np.flatnonzero(lengths <= self.longest)
        state = np.full(len(live), len(self.final) - 1)
        steps = np.full((len(words), self.longest + 1), -1, np.int32)
        done = [np.zeros(0, np.int64)]
        for i in range(self.longest + 1):
            over = lengths[live] == i
            hit = over & (self.final[state] > 0)
            steps[live[hit], i] = len(self.keys) + state[hit]
            done.append(live[hit])
            live, state = live[~over], state[~over]
            if not len(live) or not len(self.keys):
                break
            ask = (state << 8) | raw[starts[live] + i]
            at = np.minimum(np.searchsorted(self.keys, ask), len(self.keys) - 1)
            ok = self.keys[at] == ask
            live, at = live[ok], at[ok]
            steps[live, i] = at
            state = self.target[at].astype(np.int64)
        known = np.sort(np.concatenate(done))
        taken = steps[known]
        inside = taken >= 0
        edge = taken[inside]
        each = (self.first[edge + 1] - self.first[edge]).astype(np.int64)
        per = np.zeros(taken.shape, np.int64)
        per[inside] = each
        return known, self.ids[_spread(self.first[edge].astype(np.int64), each)].astype(np.int64), per.sum(axis=1)


class Encoder:
    """Texts to ids: split, walked through the lexicon, merged where they are not in it."""

    def __init__(self, path: str, lexicon: Lexicon | None):
        self.split, self.merges, self.lexicon = Splitter(path).split, Merges(path), lexicon

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, first id of each part and the end)."""
        words, special, order, first = self.split(parts)
        starts, counts = np.zeros(len(words) + len(special), np.int64), np.ones(len(words) + len(special), np.int64)
        flat, rest = np.zeros(0, np.int64), np.arange(len(words))
        if self.lexicon is not None and words:
            known, flat, each = self.lexicon.walk(words)
            starts[known], counts[known] = np.cumsum(each) - each, each
            unknown = np.ones(len(words), bool)
            unknown[known] = False
            rest = np.flatnonzero(unknown)
        merged, begin, each = self.merges.encode([words[i] for i in rest.tolist()])
        starts[rest], counts[rest] = len(flat) + begin, each
        flat = np.concatenate((flat, merged, np.array(special, np.int64)))
        starts[len(words) :] = len(flat) - len(special) + np.arange(len(special))
        order = np.where(order < 0, len(words) - 1 - order, order)
        before = np.concatenate(([0], np.cumsum(counts[order])))
        return flat[_spread(starts[order], counts[order])], before[first]


# --- on Spark --------------------------------------------------------------------------------------------------------


def _cut(text: str):
    """The text in parts of about ``CHUNK`` characters that end at blanks."""
    lo = 0
    while len(text) - lo > CHUNK:
        ends = [x for x in (text.find(b, lo + CHUNK) for b in " \n") if x >= 0]
        hi = min(ends, default=len(text))
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def _parts(texts):
    """(row number, part) of texts, grouped to lists of about ``CHUNK`` characters."""
    held, n = [], 0
    for i, text in enumerate(texts):
        for part in _cut(text):
            if held and n + len(part) > CHUNK:
                yield held
                held, n = [], 0
            held.append((i, part))
            n += len(part)
    if held:
        yield held


_made: dict = {}


def _encoder(path: str, lexicon: str | None) -> Encoder:
    if (path, lexicon) not in _made:
        _made.clear()
        _made[path, lexicon] = Encoder(path, Lexicon(SparkFiles.get(lexicon)) if lexicon else None)
    return _made[path, lexicon]


def word_counts(docs: DataFrame, path: str, held: int = 1 << 18) -> DataFrame:
    """(word binary, n): how often each word occurs in the texts; a task adds up to ``held`` words before it sends them on."""

    def run(batches):
        split, counts = Splitter(path).split, Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

        for batch in slices(batches):
            for group in _parts(t or "" for t in batch.column("text").to_pylist()):
                words, _, order, _ = split([p for _, p in group])
                for w, n in zip(words, np.bincount(order[order >= 0], minlength=len(words)).tolist(), strict=True):
                    counts[w] += n
                if len(counts) > held:
                    yield out()
                    counts.clear()
        yield out()

    return docs.select("text").where("text is not null").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, path: str, most: int) -> list[bytes]:
    """The words of at least the least count for which no more than ``most`` words (up to ``LONGEST`` bytes) are left."""
    # counts beyond 1024 are told apart by classes of an eighth of a doubling, so that the histogram stays small
    level = F.when(F.col("n") <= 1024, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 8) + 944)
    counted = staged(word_counts(docs, path).where(F.octet_length("word").between(1, LONGEST)).withColumn("level", level), "word-counts")
    total, least = 0, float("inf")
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return sorted(bytes(r.word) for r in counted.where(F.col("level") >= least).select("word").toLocalIterator())


def make_lexicon(docs: DataFrame, path: str, most: int = 1 << 17) -> str:
    """Compile the frequent words of ``docs`` and hand the file to the executors; returns its name there."""
    spark = docs.sparkSession
    small_batches(spark)
    words = frequent_words(docs, path, most)
    flat, starts, counts = Merges(path).encode(words)
    ids = flat.tolist()
    image = compile_lexicon([(w, tuple(ids[a : a + n])) for w, a, n in zip(words, starts.tolist(), counts.tolist(), strict=True)])
    name = f"lexicon-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged/{name}")
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(image))
    out.close()
    spark.sparkContext.addFile(place.toString())
    return name


def encode(docs: DataFrame, path: str, lexicon: str | None) -> DataFrame:
    """(doc_id, ids array<int>) of each row, by the tokenizer file at ``path`` and a lexicon of :func:`make_lexicon`."""

    def run(batches):
        encoder = _encoder(path, lexicon)
        for batch in slices(batches, 256):
            parts: list[list] = [[] for _ in range(batch.num_rows)]
            for group in _parts(t or "" for t in batch.column("text").to_pylist()):
                ids, first = encoder.encode([p for _, p in group])
                for k, (i, _) in enumerate(group):
                    parts[i].append(ids[first[k] : first[k + 1]].astype(np.int32))
            rows = [x[0] if len(x) == 1 else np.concatenate(x) for x in parts]
            offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], ["doc_id", "ids"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the tokenizer makes of ``ids`` with its special tokens."""

    def run(batches):
        tokens = Merges(path).tokens
        for batch in slices(batches, 256):
            texts = [" ".join(map(tokens.__getitem__, ids.values.to_numpy().tolist())) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, "doc_id long, ids array<int>, text string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, docs = public_tokenizers.path("word_bpe_49k.json"), table(spark, sf_dir, "documents")
    read = decode(encode(docs, path, make_lexicon(docs, path)), path)
    return read.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
