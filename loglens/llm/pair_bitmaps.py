"""Cross-tokenizer alignment by inverted pair bitmaps.

Two public tokenizers cut the same bytes: a byte-level one (A) and a SentencePiece one (B).  Tokens whose byte
ranges overlap are linked; stretches between offsets where tokens of both end are groups.  For every pair
of ids the corpus keeps an inverted index: per block of documents, the documents that link the pair, as
compressed bitmaps.  Bitmap ``i`` (a multiplicity plane) holds the documents whose number of links of that pair has
bit ``i`` set, so the planes OR-ed together are the documents of the pair, and ``2**i`` times the bits of
plane ``i``, summed, is its number of links.

How it runs: one Arrow pass tokenises the texts and writes, per block of a task's documents, the documents'
own numbers and one posting a pair (bitmaps of pieces of a block are OR-merged in the task; blocks hold different
documents, so counts of blocks add).  The counts of a pair are a grouped sum over its postings.  The counts
are joined to the keys of the postings and meet the bitmaps by block, where postings are read back, bit by bit, into the
scores of the block's documents.  A pair that occurs everywhere has one posting a block; a block holds at most
``BLOCK_DOCUMENTS`` documents and about ``BLOCK_ENTRIES`` (pair, document) entries, whatever the corpus.

Exactness of the cutting: a text is cut where a character that is no white space meets a blank, tab or
line feed.  A's pattern never joins such a pair of characters and looks no further than the run of white
space after a cut; no piece of B holds a blank after another character, nor a tab or line feed (this is
checked when the vocabulary is read).  Tokens of a chunk are therefore the tokens it has in the text, and both
tokenizers end a token at every cut, so the alignment of a distinct chunk is worked out once.

Defined results: a null or empty text, and one whose tokens do not spell it (say, one that holds U+2581), has
no tokens: zeros and an empty digest column.  Null and repeated ids are carried as they are; other
columns are not read; an empty table gives no rows.  A long text is read in segments.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut, map_arrow, text_of, tokenizer_path
from loglens.llm.wordcode import _byte_letters
from loglens.session import ship_package

#: A block of documents is closed at this many documents, or entries (pairs of a document).
BLOCK_DOCUMENTS = 1 << 16
BLOCK_ENTRIES = 2_000_000
#: Links that are gathered before they are counted per (pair, document).
GATHERED_LINKS = 1_000_000
#: Distinct chunks that a task remembers, and their characters.
MOST_CHUNKS = 250_000
MOST_CHARACTERS = 8_000_000
#: Chunks that are looked up at once.
CHUNKS_AT_ONCE = 20_000
#: Characters of a text that are read at a time.
SEGMENT = 1_000_000

_CHUNK = re.compile(r"\s*\S+(?:[^\S \t\n]\s*\S+)*(?:[^\S \t\n]\s*\Z)?|\s+")
_CUT = re.compile(r"\S[ \t\n]")
_BITMAP_BYTES = BLOCK_DOCUMENTS // 8


def segments(text: str, size: int = SEGMENT) -> Iterator[list[str]]:
    """The chunks of a text, a bounded number of characters at a time."""
    start = 0
    while start < len(text):
        at = _CUT.search(text, start + size)
        end = at.start() + 1 if at else len(text)
        yield _CHUNK.findall(text, start, end)
        start = end


def byte_encoder(path: str):
    """The encoder of a byte-level tokenizer file and the bytes of its ids.

    Where the file's merges make its ids in order, merging by the smallest id is merging by the file's rules; the
    ids then come from tiktoken, which costs a chunk a quarter of the time.  Other files are refused.
    """
    import json

    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as f:
        conf = json.load(f)
    letters = {letter: byte for byte, letter in _byte_letters().items()}
    special = {t["content"] for t in conf["added_tokens"]}
    vocabulary = {t: i for t, i in conf["model"]["vocab"].items() if t not in special}
    merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in conf["model"]["merges"]]
    before = conf["pre_tokenizer"]
    if (merged != list(range(len(letters), len(letters) + len(merged))) or len(vocabulary) != len(letters) + len(merged)
            or conf["normalizer"] or before["type"] != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"]):
        raise ValueError(f"{path}: not a byte-level vocabulary whose ids follow its merges")
    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
    spelled = [b""] * (1 + max([*ranks.values(), *(t["id"] for t in conf["added_tokens"])]))
    for data, i in ranks.items():
        spelled[i] = data
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), spelled


class Aligner:
    """Alignments of chunks, each distinct chunk worked out once while the table holds it."""

    def __init__(self, byte_path: str, piece_path: str, most: int = MOST_CHUNKS):
        import sentencepiece

        self.a, spelled_a = byte_encoder(byte_path)
        self.a_length = np.array([len(x) for x in spelled_a])
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if "\t" in piece or "\n" in piece or re.search("[^▁]▁", piece):
                raise ValueError(f"{piece_path}: piece {piece!r} crosses a cut")
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.b_length = np.array([len(x) for x in self.b_bytes])
        self.blank = self.b.piece_to_id("▁")
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.shown: list[bytes] = []  # the groups of a chunk, as the digest has them
        self.count = self.filled = self.held = 0
        self.start = np.zeros(1024, np.int64)
        self.sizes = np.zeros((1024, 4), np.int64)  # tokens of A, of B, groups, links
        self.bad = np.zeros(1024, bool)
        self.links = np.zeros(8192, np.uint32)

    def pieces(self, chunk: str) -> str:
        """What B is given for a chunk: it puts a blank before every text."""
        return chunk[1:] if chunk[0] == " " else chunk

    def _learn(self, chunks: list[str]) -> None:
        tokens_a = list(map(self.a.encode_ordinary, chunks))
        tokens_b = self.b.encode([self.pieces(c) for c in chunks], num_threads=1)
        tokens_b = [[self.blank] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, tokens_b)]
        bad = np.zeros(len(chunks), bool)
        spelled = self.b_bytes.__getitem__
        if b"".join(map(spelled, chain.from_iterable(tokens_b))) != "".join(chunks).encode():
            bad[:] = [b"".join(map(spelled, ids)) != c.encode() for c, ids in zip(chunks, tokens_b)]
            for i in np.flatnonzero(bad).tolist():
                tokens_a[i], tokens_b[i] = [], []
        n_a, n_b = (np.fromiter(map(len, t), np.int64, len(chunks)) for t in (tokens_a, tokens_b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(t), np.int64) for t in (tokens_a, tokens_b))
        groups, links, shown = self._align(ids_a, n_a, ids_b, n_b)
        end, last = self.count + len(chunks), self.filled + int(links.sum())
        while end > len(self.start):
            for name in ("start", "sizes", "bad"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while last > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        at = slice(self.count, end)
        self.start[at] = self.filled + np.cumsum(links) - links
        self.sizes[at] = np.stack([n_a, n_b, groups, links], 1)
        self.bad[at] = bad
        self.links[self.filled:last] = self._pairs
        self.shown += shown
        self.number.update(zip(chunks, range(self.count, end)))
        self.held += sum(map(len, chunks))
        self.count, self.filled = end, last

    def _align(self, ids_a, n_a, ids_b, n_b) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Groups, links and shown groups of chunks that are laid end to end; both tokenizers spell the same bytes."""
        end_a, end_b = np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b])
        ends = np.unique(np.concatenate([end_a, end_b]))  # a stretch between two ends lies in one token of each
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        self._pairs = (ids_a[at_a] << 16 | ids_b[at_b]).astype(np.uint32)
        chunk_a = np.repeat(np.arange(len(n_a)), n_a)
        shared = ends[(end_a[at_a] == ends) & (end_b[at_b] == ends)] if len(ends) else ends
        links = np.bincount(chunk_a[at_a], minlength=len(n_a))
        groups = np.bincount(chunk_a[np.searchsorted(end_a, shared)], minlength=len(n_a))
        # every token as "id" and the mark after it, A's tokens of a group before B's
        key = np.concatenate([np.searchsorted(shared, end_a) * 2, np.searchsorted(shared, end_b) * 2 + 1])
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([ids_a, ids_b])[order]
        last = np.r_[key[1:] != key[:-1], True][:len(key)]
        marks = np.where(last, np.where(key % 2 == 0, "|", ";"), ",").tolist()
        text = [""] * (2 * len(ids))
        text[::2], text[1::2] = map(str, ids.tolist()), marks
        bound = [0, *(2 * np.cumsum(n_a + n_b)).tolist()]
        shown = ["".join(text[lo:hi])[:-1].encode() for lo, hi in zip(bound, bound[1:])]
        return groups, links, shown

    def numbers(self, chunks: list[str]) -> np.ndarray:
        """A number for each chunk; numbers hold until the next call."""
        known = self.number
        try:
            return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))
        except KeyError:
            pass
        distinct = list(dict.fromkeys(chunks))
        missing = [c for c in distinct if c not in known]
        if known and (self.count + len(missing) > self.most or self.held > MOST_CHARACTERS):
            self.clear()
            known, missing = self.number, distinct
        for i in range(0, len(missing), 20_000):
            self._learn(missing[i:i + 20_000])
        return np.fromiter(map(known.__getitem__, chunks), np.int64, len(chunks))

    def linked(self, numbers: np.ndarray) -> np.ndarray:
        """The pairs (A id << 16 | B id) of all links of the chunks."""
        lengths = self.sizes[numbers, 3]
        total = int(lengths.sum())
        return self.links[np.repeat(self.start[numbers] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)]


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs (or the sum of its counts)."""
    if counts is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Reading:
    """What has been read of a text: tokens of A and B, groups and links, the digest, the linked pairs."""

    def __init__(self, good: bool):
        self.good, self.total, self.digest = good, np.zeros(4, np.int64), hashlib.sha256()
        self.links: list[np.ndarray] = []
        self.size = 0
        self.merged = None  # distinct pairs and their links, of a long text

    def add(self, table: Aligner, numbers: np.ndarray) -> None:
        if not self.good or table.bad[numbers].any():
            self.good, self.links, self.merged = False, [], None
            return
        if self.total[0]:
            self.digest.update(b";")
        self.total += table.sizes[numbers].sum(0)
        self.digest.update(b";".join(map(table.shown.__getitem__, numbers.tolist())))
        self.links.append(table.linked(numbers))
        self.size += len(self.links[-1])
        if self.size >= GATHERED_LINKS:
            self.merge()

    def merge(self) -> None:
        keys, counts = counted(np.concatenate(self.links))
        if self.merged:
            keys, counts = counted(np.r_[self.merged[0], keys], np.r_[self.merged[1], counts])
        self.links, self.size, self.merged = [], 0, (keys, counts)


def read(texts, table: Aligner) -> Iterator[Reading]:
    """Readings of the texts in order; chunks of neighbouring texts are looked up together."""
    waiting: list[Reading] = []
    units: list[tuple[Reading, list[str]]] = []
    size = 0

    def settle() -> None:
        numbers = table.numbers([c for _, chunks in units for c in chunks])
        at = 0
        for reading, chunks in units:
            reading.add(table, numbers[at:at + len(chunks)])
            at += len(chunks)
        units.clear()

    for text in texts:
        reading = Reading(bool(text))
        waiting.append(reading)
        for chunks in segments(" " + text) if text else ():
            units.append((reading, chunks))
            size += len(chunks)
            if size >= CHUNKS_AT_ONCE:
                settle()
                size = 0
        if not units:
            yield from waiting
            waiting.clear()
    settle()
    yield from waiting


def container(documents: np.ndarray) -> bytes:
    """A compressed bitmap: the sorted numbers, or the plain bitmap where that is no longer."""
    if 2 * len(documents) < _BITMAP_BYTES:
        return documents.astype("<u2").tobytes()
    bits = np.zeros(BLOCK_DOCUMENTS, np.uint8)
    bits[documents] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def members(data: bytes) -> np.ndarray:
    """The documents of a compressed bitmap."""
    if len(data) < _BITMAP_BYTES:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


class Block:
    """The postings of a block of documents while they are gathered."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.raw_size = 0
        self.keys = np.zeros(0, np.uint64)
        self.counts = np.zeros(0, np.int64)

    def add(self, slot: int, reading: Reading) -> None:
        if reading.merged:
            reading.links and reading.merge()
            self.merge(reading.merged[0].astype(np.uint64) << np.uint64(16) | np.uint64(slot), reading.merged[1])
            return
        for pairs in reading.links:
            self.raw.append(pairs.astype(np.uint64) << np.uint64(16) | np.uint64(slot))
            self.raw_size += len(pairs)
        if self.raw_size >= GATHERED_LINKS:
            self.merge()

    def merge(self, *more: np.ndarray) -> None:
        """OR-merges what was gathered (and counted entries) into the block's entries: pair and document in order, links."""
        parts = [more] if more else []
        if self.raw:
            parts.append(counted(np.concatenate(self.raw)))
            self.raw, self.raw_size = [], 0
        if parts:
            keys, counts = zip((self.keys, self.counts), *parts)
            self.keys, self.counts = counted(np.concatenate(keys), np.concatenate(counts))

    def postings(self) -> Iterator[tuple[int, int, int, list[bytes]]]:
        """pair, documents, links and planes, in the order of pairs."""
        self.merge()
        if not len(self.keys):
            return
        pair = (self.keys >> np.uint64(16)).astype(np.int64)
        slot = (self.keys & np.uint64(0xFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        last = np.r_[first[1:], len(pair)]
        links = np.add.reduceat(self.counts, first)
        top = np.maximum.reduceat(self.counts, first)
        for at, end, p, n, most in zip(first.tolist(), last.tolist(), pair[first].tolist(), links.tolist(), top.tolist()):
            documents = slot[at:end]
            if most == 1:
                yield p, end - at, n, [container(documents)]
            else:
                times = self.counts[at:end]
                yield p, end - at, n, [container(documents[times >> i & 1 == 1]) for i in range(most.bit_length())]


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _index(paths: tuple, row_type: str):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        table = Aligner(*paths)
        at = TaskContext.get().partitionId() << 31
        block, slot, opened = at, 0, Block()

        def batch_of(rows: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([rows[name] if name in rows else pa.nulls(n, kind) for name, kind in types], names)

        def close() -> Iterator:
            postings = opened.postings()
            while True:
                pairs, documents, links, planes = [], [], [], []
                for pair, d, n, p in postings:
                    pairs.append(pair)
                    documents.append(d)
                    links.append(n)
                    planes.append(p)
                    if len(pairs) == 20_000:
                        break
                if not pairs:
                    return
                ids = np.array(pairs, np.int64)
                n = len(pairs)
                yield batch_of({"block": pa.array(np.full(n, block)), "a": pa.array((ids >> 16).astype(np.int32)),
                                "b": pa.array((ids & 0xFFFF).astype(np.int32)), "documents": pa.array(documents, pa.int64()),
                                "links": pa.array(links, pa.int64()), "planes": pa.array(planes, pa.list_(pa.binary()))}, n)

        names = types = None
        for batch in batches:
            if types is None:
                types = [("block", pa.int64()), ("slot", pa.int32()), ("row", batch.column(0).type),
                         *((name, pa.int64()) for name in _NUMBERS), ("groups_sha256", pa.string()), ("a", pa.int32()),
                         ("b", pa.int32()), ("documents", pa.int64()), ("links", pa.int64()), ("planes", pa.list_(pa.binary()))]
                names = [name for name, _ in types]
            done, blocks, slots, digests = [], [], [], []
            for reading in read((t.as_py() for t in batch.column(1)), table):
                good = reading.good
                if good:
                    opened.add(slot, reading)
                done.append(reading.total if good else np.zeros(4, np.int64))
                digests.append(reading.digest.hexdigest() if good else "")
                blocks.append(block)
                slots.append(slot)
                slot += 1
                if slot == BLOCK_DOCUMENTS or len(opened.keys) + opened.raw_size >= BLOCK_ENTRIES:
                    opened.merge()
                if slot == BLOCK_DOCUMENTS or len(opened.keys) >= BLOCK_ENTRIES:
                    yield from close()
                    block, slot, opened = block + 1, 0, Block()
            if done:
                sums = np.array(done)
                yield batch_of({"block": pa.array(blocks, pa.int64()), "slot": pa.array(slots, pa.int32()), "row": batch.column(0),
                                **{name: pa.array(sums[:, i]) for i, name in enumerate(_NUMBERS)},
                                "groups_sha256": pa.array(digests)}, len(done))
        if types is not None:
            yield from close()

    return run


def index(docs: DataFrame, keep: list[str], vocabularies: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, postings) of one written pass.

    documents: block, slot, row (the columns to keep), n_a, n_b, n_groups, n_links, groups_sha256.
    postings: block, a, b, documents (of the block), links, planes.
    """
    paths = vocabularies or (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    rows = docs.select(F.struct(*keep).alias("row"), text_of(docs).alias("text"))
    row_type = rows.schema["row"].dataType.simpleString()
    schema = (f"block bigint, slot int, row {row_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
              "groups_sha256 string, a int, b int, documents bigint, links bigint, planes array<binary>")
    written = cut(map_arrow(rows, _index(paths, row_type), schema), "pair-index")
    return (written.where("slot IS NOT NULL").select("block", "slot", "row", *_NUMBERS, "groups_sha256"),
            written.where("slot IS NULL").select("block", "a", "b", "documents", "links", "planes"))


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, documents and links of every linked pair of ids, and whether no pair of that B id has more links.

    Blocks hold different documents, so the bits of a pair's OR-merged bitmaps add up over its blocks.
    """
    pairs = cut(postings.groupBy("a", "b").agg(F.sum("documents").alias("documents"), F.sum("links").alias("links")), "pair-counts")
    # at most one row per id of B's vocabulary
    top = pairs.groupBy("b").agg(F.max("links").alias("top"))
    return pairs.join(F.broadcast(top), "b").select("a", "b", "documents", "links", (F.col("links") == F.col("top")).alias("best"))


def _scores(postings, judged):
    """The scores of a block's documents: its postings, read back bit by bit with the counts of their pairs."""
    import pyarrow as pa

    best, total, seen = np.zeros(BLOCK_DOCUMENTS, np.int64), np.zeros(BLOCK_DOCUMENTS, np.int64), np.zeros(BLOCK_DOCUMENTS, bool)
    block = postings.column("block")[0].as_py()
    key = {side: (t.column("a").to_numpy().astype(np.int64) << 16) | t.column("b").to_numpy()
           for side, t in (("postings", postings), ("judged", judged))}
    order = np.argsort(key["judged"])
    at = order[np.searchsorted(key["judged"][order], key["postings"])]
    links = judged.column("links").to_numpy()[at]
    is_best = judged.column("best").to_numpy()[at].astype(np.int64)
    row = 0
    for lists in postings.column("planes").chunks:
        begin = lists.offsets.to_numpy().astype(np.int64)
        of = np.repeat(np.arange(len(lists)), np.diff(begin)) + row  # posting of each plane
        times = np.int64(1) << (np.arange(begin[0], begin[-1]) - np.repeat(begin[:-1], np.diff(begin)))
        planes = lists.values.slice(int(begin[0]), int(begin[-1] - begin[0]))
        bound = np.frombuffer(planes.buffers()[1], np.int32)[planes.offset:planes.offset + len(planes) + 1]
        data, size = planes.buffers()[2], np.diff(bound)
        found, short = [], size < _BITMAP_BYTES
        if short.all():
            documents = np.frombuffer(data, "<u2", (int(bound[-1]) - int(bound[0])) // 2, int(bound[0])) if len(size) else np.zeros(0, "<u2")
            found.append((documents.astype(np.int64), np.repeat(times, size // 2), np.repeat(of, size // 2)))
        else:
            found += [(members(memoryview(data)[int(bound[k]):int(bound[k + 1])]), times[k], of[k]) for k in range(len(size))]
        for documents, many, posting in found:
            np.add.at(total, documents, many * links[posting])
            np.add.at(best, documents, many * is_best[posting])
            seen[documents] = True
        row += len(lists)
    slots = np.flatnonzero(seen)
    return pa.table({"block": np.full(len(slots), block), "slot": slots.astype(np.int32), "n_best": best[slots], "count_sum": total[slots]})


def scores(postings: DataFrame, pairs: DataFrame) -> DataFrame:
    """block, slot, n_best and count_sum of every document that has links.

    Only the keys of postings are joined with the counts; the bitmaps are dealt once, by block.
    """
    ship_package(postings.sparkSession)
    keys = postings.select("block", "a", "b").toDF("block", "a", "b")
    judged = keys.join(pairs.select("a", "b", "links", "best"), ["a", "b"]).select("a", "b", "block", "links", "best")
    judged = judged.toDF("a", "b", "judged_block", "links", "best")
    return (postings.select("block", "a", "b", "planes").groupBy("block").cogroup(judged.groupBy("judged_block"))
            .applyInArrow(_scores, "block bigint, slot int, n_best bigint, count_sum bigint"))


def align(docs: DataFrame, keep: list[str], vocabularies: tuple | None = None) -> DataFrame:
    """``row`` (the columns to keep), n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    documents, postings = index(docs, keep, vocabularies)
    found = scores(postings, pair_counts(postings))
    return (documents.join(found, ["block", "slot"], "left")
            .select("row", *_NUMBERS, F.coalesce("n_best", F.lit(0)).cast("bigint").alias("n_best"),
                    F.coalesce("count_sum", F.lit(0)).cast("bigint").alias("count_sum"), "groups_sha256"))
