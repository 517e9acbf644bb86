"""JON-17: whether overlap marks across utterances balance: tops of one speaker against bottoms of others."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REGION = "file long, line long, nth int, side string, speaker string, index int, partners int"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())


class Matcher:
    """One file's regions in order. A bottom goes with the nearest earlier utterance of another speaker that has tops of its index:
    with the first of these tops that has no bottom of this speaker yet, or with the first one if all have. So the bottoms of one speaker spread over
    sibling tops in order, and a top may have bottoms of several speakers.

    Held are, for each index and speaker, the tops of the speaker's last utterance that has any: an earlier one is never the nearest again.
    """

    def __init__(self, file):
        self.file, self.held = file, {}

    def _rows(self, group, speaker, index):
        line, tops = group
        return [(self.file, line, nth, "top", speaker, index, len(partners)) for nth, partners in tops]

    def take(self, line, nth, side, speaker, index):
        """A region; yields the regions that are settled by it."""
        groups = self.held.setdefault(index, {})
        if side == "top":
            if speaker in groups and groups[speaker][0] == line:
                groups[speaker][1].append((nth, []))
                return
            if speaker in groups:
                yield from self._rows(groups[speaker], speaker, index)
            groups[speaker] = (line, [(nth, [])])
            return
        near = max((g for s, g in groups.items() if s != speaker and g[0] < line), key=lambda g: g[0], default=None)
        if near:
            free = next((partners for _, partners in near[1] if speaker not in partners), near[1][0][1])
            free.append(speaker)
        yield (self.file, line, nth, "bottom", speaker, index, 1 if near else 0)

    def end(self):
        for index, groups in self.held.items():
            for speaker, group in groups.items():
                yield from self._rows(group, speaker, index)


def balance(regions: DataFrame) -> DataFrame:
    """``regions`` (file, line, nth, side top or bottom, speaker, index or null) with partners: how many regions of other speakers
    each one is matched with. One streamed pass over each file's regions in order; one file is one task."""

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for file, *region in zip(*(batch.column(c).to_pylist() for c in ("file", "line", "nth", "side", "speaker", "index")), strict=True):
                if now is None or now.file != file:
                    out += now.end() if now else ()
                    now = Matcher(file)
                out += now.take(*region)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, _TYPES, strict=True)], [c.split(" ")[0] for c in REGION.split(", ")])
        out = list(now.end()) if now else []
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, _TYPES, strict=True)], [c.split(" ")[0] for c in REGION.split(", ")])

    r = regions.select(F.col("file").cast("long").alias("file"), F.col("line").cast("long").alias("line"), F.col("nth").cast("int").alias("nth"), "side", "speaker", F.col("index").cast("int").alias("index"))
    return r.repartition("file").sortWithinPartitions("file", "line", "side", "nth").mapInArrow(run, REGION)
