"""Operator 9: token ids in a fixed-width bit-packed binary format.

A *shard image* is one self-describing file: a header, a table of its documents, a table of block offsets and the
packed ids. Each id takes ``bits`` = bits of the largest vocabulary id; a block holds ``BLOCK`` ids and starts on a byte,
so any block is found through the offset table and unpacked alone with numpy. Images are the rows of a Parquet dataset
(column ``content``), written by Spark's committer: a lost or repeated task leaves no half-written file.

Nulls: a null text is an empty document (only the end id); a null doc_id sorts first. Repeated doc_ids keep one entry a
row, in the order of the scan. A very long text is encoded slice by slice and lies in one image. An empty table gives an empty
dataset. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import slices, small_batches, staged, table

BLOCK = 1 << 14
_HEAD = struct.Struct("<4sHHIQII")
IMAGE = "shard int, first long, n_ids long, content binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def to_image(doc_ids: list, lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    parts = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0] + [len(p) for p in parts])
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    starts = np.cumsum([0, *lengths])
    head = _HEAD.pack(b"LSTK", 1, bits, BLOCK, len(ids), len(parts), len(docs))
    return b"".join([head, docs.tobytes(), known.tobytes(), starts.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *parts])


class Image:
    """Random access to a shard image."""

    def __init__(self, content: bytes):
        magic, version, self.bits, self.block, self.n_ids, blocks, docs = _HEAD.unpack_from(content)
        if (magic, version) != (b"LSTK", 1):
            raise ValueError("not a shard image")
        at = _HEAD.size
        known = np.frombuffer(content, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [d if k else None for d, k in zip(np.frombuffer(content, "<i8", docs, at).tolist(), known.tolist(), strict=True)]
        at += 9 * docs
        self.starts = np.frombuffer(content, "<u8", docs + 1, at).astype(np.int64)
        at += 8 * (docs + 1)
        self.offsets = np.frombuffer(content, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(content)[at + 8 * (blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop; only the blocks they lie in are unpacked."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        held = [unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block, self.n_ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(held)[start - first * self.block : stop - first * self.block]


_encoders: dict = {}

#: The characters that a byte-level model writes for the bytes 0 to 255: printable Latin-1 as it is, the others from U+0100 on.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_BYTE_CHARS = {b: chr(b if b in _SHOWN else 256 + b - sum(x < b for x in _SHOWN)) for b in range(256)}


def encoder(path: str, cached: int = 1_200_000):
    """(bytes of a text -> packed little-endian 32-bit ids, size of the vocabulary) of the tokenizer file at ``path``.

    The pre-tokeniser of such a file never joins text across a blank or a line end (the tests compare with whole texts), so
    the pieces between them are encoded apart; up to ``cached`` of them are remembered. The file lower-cases, so ASCII
    capitals are lowered first, but for texts that may hold a special token or a combining mark. A piece that is one word
    in normal form goes to the model at once, without the normaliser that would leave it as it is.
    """
    if path in _encoders:
        return _encoders[path]
    from tokenizers import Tokenizer

    tok, memory = Tokenizer.from_file(path), {b"": b""}
    model, lowers = tok.model, tok.encode("AbC", add_special_tokens=False).ids == tok.encode("abc", add_special_tokens=False).ids

    def learn(piece: bytes) -> bytes:
        stem = piece[:-1]
        if piece[-1:] in (b",", b".") and stem.isalpha():
            found = (memory.get(stem) or learn(stem)) + (memory.get(piece[-1:]) or learn(piece[-1:]))
        else:
            text = piece.decode()
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                ids = [t.id for t in model.tokenize(piece.decode("latin-1").translate(_BYTE_CHARS))]
            else:
                ids = tok.encode(text, add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(memory) < cached:
            memory[piece] = found
        return found

    def encode(text: bytes) -> bytes:
        if lowers and not (b"<|" in text or b"\xcc" in text or b"\xcd" in text):
            text = text.lower()
        out, lo = [], 0
        while lo < len(text):  # slices that end where a piece ends
            hi = len(text) if lo + (1 << 20) >= len(text) else _edge(text, lo + (1 << 20))
            pieces = text[lo:hi].replace(b"\n", b" ").split(b" ")
            got = list(map(memory.get, pieces))
            if None in got:
                got = [learn(p) if g is None else g for p, g in zip(pieces, got, strict=True)]
            out.append(b"".join(got))
            lo = hi
        return b"".join(out)

    _encoders[path] = encode, tok.get_vocab_size()
    return _encoders[path]


def _edge(text: bytes, at: int) -> int:
    """First blank or line end from ``at`` on."""
    a, b = text.find(b" ", at), text.find(b"\n", at)
    return min([x for x in (a, b) if x >= 0], default=len(text))


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 1, image_ids: int = 1 << 18, order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending ``order`` and write shard images; returns them as read back.

    The texts are dealt by ranges of ``order`` (with the scan's row number, so that one repeated id cannot fill a range),
    then encoded and packed inside each range. ``first`` is the image's first id within its shard.
    """
    bits = max(1, int(max(encoder(tokenizer_path)[1] - 1, end_id)).bit_length())

    def run(batches):
        encode, shard = encoder(tokenizer_path)[0], TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        first, names, sizes, held, n = 0, [], [], [], 0

        def image():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([n], pa.int64()), "content": pa.array([to_image(names, sizes, np.frombuffer(b"".join(held), "<u4"), bits)], pa.binary())})

        for batch in slices(batches, 500):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                data = encode(text.as_py() or b"") + end
                names.append(doc_id)
                sizes.append(len(data) // 4)
                held.append(data)
                n += len(data) // 4
                if n >= image_ids:
                    yield image()
                    first, names, sizes, held, n = first + n, [], [], [], 0
        if names:
            yield image()

    small_batches(docs.sparkSession)
    by = [F.asc_nulls_first(c) for c in order]
    ranged = docs.select(*{"doc_id": 0, "text": 0} | dict.fromkeys(order), F.monotonically_increasing_id().alias("_row")).repartitionByRange(*by, "_row").sortWithinPartitions(*by, "_row")
    return staged(ranged.select("doc_id", "text").mapInArrow(run, IMAGE), "token-shards", compression="uncompressed")


def read_shards(images: DataFrame) -> DataFrame:
    """One row a document from shard images: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def run(batches):
        for batch in slices(batches, 16):
            for base, first, content in zip(batch.column("base").to_pylist(), batch.column("first").to_pylist(), batch.column("content"), strict=True):
                image = Image(content.as_py())
                ids = image.ids(0, image.n_ids)
                at = image.starts.tolist()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(image.doc_ids, pa.int64()), "start": pa.array([base + first + a for a in at[:-1]], pa.int64()), "n_tokens": pa.array([b - a for a, b in zip(at, at[1:])], pa.int64()), "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:])], pa.int64())})

    small_batches(images.sparkSession)
    # one row a shard, that is, a task of the write: shards, not documents, are what is summed up and broadcast
    totals = images.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return images.join(F.broadcast(bases), "shard").select("base", "first", "content").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
