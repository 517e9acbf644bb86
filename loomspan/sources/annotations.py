"""SRC-28 (ELAN): annotation files in XML, whose times are references that are followed to the end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.sources.transcripts import once

_ALIGNED = "ALIGNABLE_ANNOTATION struct<_ANNOTATION_ID: string, _TIME_SLOT_REF1: string, _TIME_SLOT_REF2: string, ANNOTATION_VALUE: string>"
_REFERRED = "REF_ANNOTATION struct<_ANNOTATION_ID: string, _ANNOTATION_REF: string, ANNOTATION_VALUE: string>"
DOCUMENT = f"TIME_ORDER struct<TIME_SLOT: array<struct<_TIME_SLOT_ID: string, _TIME_VALUE: long>>>, TIER array<struct<_TIER_ID: string, _PARTICIPANT: string, ANNOTATION: array<struct<{_ALIGNED.replace(' struct', ': struct', 1)}, {_REFERRED.replace(' struct', ': struct', 1)}>>>>, broken string"


def _places(rows, names, in_rows, in_names) -> np.ndarray:
    """For each name of a row the place of the first like name of the same row among others, or -1."""
    codes = pa.chunked_array([names, in_names]).combine_chunks().dictionary_encode().indices
    codes = codes.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    keys = np.concatenate([rows, in_rows]) * (len(codes) + 1) + codes
    found, first = np.unique(keys[len(rows) :], return_index=True)
    if not len(found):
        return np.full(len(rows), -1)
    at = np.minimum(np.searchsorted(found, keys[: len(rows)]), len(found) - 1)
    return np.where((found[at] == keys[: len(rows)]) & (codes[: len(rows)] >= 0), first[at], -1)


def _ends(up: np.ndarray, refers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where references lead (a place, the last one for nowhere), and over how many steps, by doubling: as many rounds as the
    longest chain may need, so that circles, which end at a place that refers on, end too."""
    depth = refers.astype(np.int64)
    for _ in range(len(up).bit_length()):
        if (up[up] == up).all():
            break
        depth, up = depth + depth[up], up[up]
    return up, depth


def _annotations(batch: pa.RecordBatch) -> pa.Table:
    flat = lambda lists, rows: (pc.list_flatten(lists), rows[np.asarray(pc.list_parent_indices(lists), dtype=np.int64)])
    slots, slot_rows = flat(batch["slots"], np.arange(batch.num_rows))
    tiers, tier_rows = flat(batch["tiers"], np.arange(batch.num_rows))
    a, tier_at = flat(pc.struct_field(tiers, "ANNOTATION"), np.arange(len(tiers)))
    on, to = (lambda name, kind=kind: pc.struct_field(pc.struct_field(a, kind), name) for kind in ("ALIGNABLE_ANNOTATION", "REF_ANNOTATION"))
    ids = pc.coalesce(on("_ANNOTATION_ID"), to("_ANNOTATION_ID"))
    known = pc.is_valid(ids)
    one = pa.table({"id": ids, "ref": to("_ANNOTATION_REF"), "slot1": on("_TIME_SLOT_REF1"), "slot2": on("_TIME_SLOT_REF2"), "text": pc.coalesce(on("ANNOTATION_VALUE"), to("ANNOTATION_VALUE"), ""), "tier_at": tier_at}).filter(known).combine_chunks()
    column = lambda c: one[c].combine_chunks()
    tier_at = np.asarray(one["tier_at"], dtype=np.int64)
    rows, n = tier_rows[tier_at], one.num_rows
    refers = np.append(pc.is_valid(column("ref")).to_numpy(zero_copy_only=False), False)
    above = _places(rows, column("ref"), rows, column("id"))
    end, depth = _ends(np.append(np.where(refers[:n], np.where(above < 0, n, above), np.arange(n)), n), refers)
    end, depth = end[:n], depth[:n]
    # a reference to nowhere or into a circle has no end
    end = pa.array(end, mask=(end == n) | refers[end])
    timed = pc.is_valid(column("slot1").take(end))
    name = pc.struct_field(slots, "_TIME_SLOT_ID")

    def at(slot):
        place = _places(rows, column(slot).take(end), slot_rows, name)
        return pc.struct_field(slots, "_TIME_VALUE").take(pa.array(place, mask=place < 0))

    tier = lambda c: pc.struct_field(tiers, c).take(pa.array(tier_at))
    return pa.table({
        "file": batch["file"].take(pa.array(rows)), "tier": tier("_TIER_ID"), "speaker": tier("_PARTICIPANT"), "id": one["id"], "depth": pc.if_else(timed, pa.array(depth.astype(np.int32)), pa.scalar(None, pa.int32())),
        "start_ms": at("slot1"), "end_ms": at("slot2"), "text": pc.utf8_trim(one["text"], " "),
    })


def elan(files: DataFrame) -> DataFrame:
    """(file, tier, speaker, id, depth, start_ms, end_ms, text) of the annotations of files (file, text).

    An annotation on the time line names two slots; one that refers to another has the times of that one, through as many
    references as there are: depth. References are followed by doubling, within the file, which is one row. Of annotations or slots with
    one name in a file a reference means the first. Times are null where a slot has
    none, and where references end nowhere or in a circle (depth null). Unreadable files give no rows.
    """
    x = once(files.select("file", "text"), F.from_xml("text", DOCUMENT, {"columnNameOfCorruptRecord": "broken"}).alias("x")).where("x is not null and x.broken is null")
    x = x.select("file", F.col("x.TIME_ORDER.TIME_SLOT").alias("slots"), F.col("x.TIER").alias("tiers"))

    def run(batches):
        for batch in batches:
            yield from _annotations(batch).to_batches(1 << 16)

    return x.mapInArrow(run, f"file {files.schema['file'].dataType.simpleString()}, tier string, speaker string, id string, depth int, start_ms long, end_ms long, text string")
