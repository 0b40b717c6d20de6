"""Hierarchical packing of documents into fixed token windows.

Documents are routed by length to context tiers (256, 512, 1024 and 2048 tokens by default), each
tier is packed on its own, gaps that its own documents leave are filled from shorter tiers, and
windows are dealt to step groups of equal token counts.

One task packs one partition of the input (a shard) in a single pass: tokens never leave the task,
nothing is shuffled, and the pools of waiting documents are bounded by the tier sizes.  Every
window is exactly full: when no whole document fits a gap, one is cut.  The rest of a shard ends
in windows of falling powers of two, so no id of padding is needed.

Defined results: a null text is the empty text (one piece: the end id); null and repeated ids are
carried as they are; extra columns are not read; an empty table gives no rows.  A text of any
length is cut into windows as it goes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import map_arrow, text_of, tokenizer_path
from loglens.llm.wordcode import coder, forget

TIERS = (256, 512, 1024, 2048)
#: Appended to every document.
END_ID = 1
#: A tier is packed once it holds this many windows of tokens.
POOL_WINDOWS = 64
#: Step groups hold this many of the longest windows' tokens.
WINDOWS_PER_STEP = 16

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, tier int, step_group bigint")


def ids_as_u32(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Packer:
    """Packs one shard.  ``emit(window_tokens, pieces)`` gets each full window; a piece is
    (document, start, length).  ``trim(document, start)`` may drop what lies before ``start`` from a
    document that waits in a pool."""

    def __init__(self, emit, tiers=TIERS, pool_windows: int = POOL_WINDOWS, trim=lambda document, start: document):
        self.tiers = tuple(sorted(tiers))
        for small, large in zip(self.tiers, self.tiers[1:]):
            if large != 2 * small:
                raise ValueError("each tier must be twice the one before")
        if self.tiers[0] & (self.tiers[0] - 1):
            raise ValueError("tiers must be powers of two")
        self.emit, self.trim = emit, trim
        self.pool_windows = pool_windows
        self.pools = {t: [] for t in self.tiers}  # (length, arrival, document, start), sorted
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.arrivals = 0

    def add(self, document, length: int) -> None:
        start, longest = 0, self.tiers[-1]
        while length - start >= longest:
            self.emit(longest, [(document, start, longest)])
            start += longest
        if start < length:
            self._route(self.trim(document, start), start, length - start)
        for t in self.tiers:
            if self.tokens[t] >= self.pool_windows * t:
                self._pack(t)

    def _route(self, document, start: int, length: int) -> None:
        tier = next(t for t in self.tiers if length <= t)
        self.arrivals += 1
        insort(self.pools[tier], (length, self.arrivals, document, start))
        self.tokens[tier] += length

    def _take(self, tier: int, i: int):
        length, _, document, start = self.pools[tier].pop(i)
        self.tokens[tier] -= length
        return document, start, length

    def _pack(self, tier: int) -> None:
        """Full windows of this tier while its own documents can still fill one."""
        shorter = [t for t in reversed(self.tiers) if t < tier]
        while self.tokens[tier] >= tier:
            gap, pieces = tier, []
            for t in [tier, *shorter]:  # whole documents, the longest that fits first
                while gap and self.pools[t]:
                    i = bisect_right(self.pools[t], (gap, float("inf"))) - 1
                    if i < 0:
                        break
                    pieces.append(self._take(t, i))
                    gap -= pieces[-1][2]
            if gap:  # every waiting document is longer than the gap: cut the shortest
                document, start, length = self._take(*next((t, 0) for t in self.tiers if self.pools[t]))
                pieces.append((document, start, gap))
                self._route(document, start + gap, length - gap)
            self.emit(tier, pieces)

    def finish(self) -> None:
        """What is left in all pools, in windows of the longest tier and then of falling powers of two."""
        rest = [self._take(t, len(self.pools[t]) - 1) for t in reversed(self.tiers) for _ in range(len(self.pools[t]))]
        left, at, used = sum(length for _, _, length in rest), 0, 0
        while left:
            window = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            gap, pieces = window, []
            while gap:
                document, start, length = rest[at]
                n = min(gap, length - used)
                pieces.append((document, start + used, n))
                gap, used = gap - n, used + n
                if used == length:
                    at, used = at + 1, 0
            self.emit(window, pieces)
            left -= window


class Steps:
    """Deals windows to step groups of equal tokens: windows of a tier fill a unit as long as the longest
    tier, and every group takes the same number of units."""

    def __init__(self, longest: int, per_step: int):
        self.longest, self.per_step, self.units, self.open = longest, per_step, 0, {}

    def group(self, window: int) -> int:
        unit, room = self.open.get(window, (0, 0))
        if not room:
            unit, room = self.units, self.longest
            self.units += 1
        self.open[window] = unit, room - window
        return unit // self.per_step


def _pack_shard(path: str, tiers, pool_windows: int, per_step: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode = coder(path, ids_as_u32)
        end = ids_as_u32([END_ID])
        base = TaskContext.get().partitionId() << 33
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = [pa.int32() if n == "tier" else pa.int64() for n in names]
        out: list[tuple] = []
        count = 0
        steps = Steps(max(tiers), per_step)

        def emit(window, pieces):
            nonlocal count
            offset, group = 0, base + steps.group(window)
            for (key, ids, first, total), start, length in pieces:
                crc = zlib.crc32(memoryview(ids)[4 * (start - first):4 * (start - first + length)])
                out.append((key, start, length, crc, total, base + count, offset, window, group))
                offset += length
            count += 1

        def trim(document, start):
            key, ids, first, total = document
            return (key, ids[4 * (start - first):], start, total) if start > first else document

        def flush():
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        packer = Packer(emit, tiers, pool_windows, trim)
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = b"".join(encode.values(text.as_py().encode())) + end
                packer.add((key, ids, 0, len(ids) // 4), len(ids) // 4)
                if len(out) >= 20_000:
                    yield flush()
        packer.finish()
        if out:
            yield flush()
        forget()

    return run


def pack(docs: DataFrame, tiers=TIERS, pool_windows: int = POOL_WINDOWS, windows_per_step: int = WINDOWS_PER_STEP,
         vocabulary: str | None = None) -> DataFrame:
    """One row per piece: where each stretch of a document's ids lies.

    ``sequence_id`` joins the shard's number and a running number, ``offset`` is gapless within a
    sequence, ``tier`` is the sequence's window and ``step_group`` its group of equal tokens.
    """
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    return map_arrow(rows, _pack_shard(path, tuple(tiers), pool_windows, windows_per_step), SCHEMA)
