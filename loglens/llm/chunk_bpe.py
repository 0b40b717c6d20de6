"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last bytes says so, so equal passages are cut alike wherever
they lie.  Chunks that occur more than once in the corpus are encoded once and their ids are joined to
every occurrence; the others are encoded where they lie.  A cut may fall inside a word, whose halves
encode differently from the whole: at each join the halves (and whole chunks without white space between
them) are taken back and encoded again as one window, which grows until both its ends lie at white
space.  There the tokenizer itself starts anew, so the ids on both sides agree exactly with
those of the whole text (``wordcode``).

Spark's part: the first pass counts chunk hashes (128 bits), summed per task before the shuffle.  The shared ones
become a bit filter of bounded size, which is broadcast; a false hit only sends a chunk on the longer way.
The second pass encodes: documents without shared chunks are finished in place, and only shared
chunks and the rest of their documents are shuffled.

Defined results: a null or empty text has no ids; null and repeated ids are kept, each row on its own; columns that
clash with names used here are safe, as the input row travels in one struct; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut, map_arrow, tokenizer_path
from loglens.llm.tier_packing import ids_as_u32
from loglens.llm.wordcode import coder

#: A chunk ends where the top bits of the rolling hash are zero, between these lengths in bytes.
CUT_BITS = 9
LEAST_CHUNK = 128
MOST_CHUNK = 4096
#: The broadcast filter has 16 bits a shared chunk, up to this many in all (16 MB).
MOST_FILTER_BITS = 1 << 27
_SPACE = frozenset(b" \t\n\r\x0b\x0c")
_GEAR = np.random.default_rng(1993).integers(0, 1 << 64, 256, dtype=np.uint64)


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of a text in UTF-8, by a rolling hash of 16 bytes; never inside a character."""
    n = len(data)
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for s in (1, 2, 4, 8):
        h[s:] += h[:-s] << np.uint64(s)
    ends, start = [], 0
    for end in [*(np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist(), n]:
        while end - start > MOST_CHUNK:
            start = _whole(data, start + MOST_CHUNK)
            ends.append(start)
        if end - start >= LEAST_CHUNK and end < n:
            start = _whole(data, end)
            ends.append(start)
    if not ends or ends[-1] < n:
        ends.append(n)
    return ends


def _whole(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks(data: bytes) -> list[bytes]:
    start, out = 0, []
    for end in chunk_ends(data) if data else []:
        if end > start:
            out.append(data[start:end])
        start = end
    return out


def chunk_keys(parts: list[bytes]) -> np.ndarray:
    """(2, chunks) halves of the 128-bit hashes, as signed numbers."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, parts)), np.int64).reshape(-1, 2).T


class Chunk:
    """An encoded chunk: all its ids, and the word halves that reach its edges with their numbers of ids."""

    __slots__ = ("head", "tail", "n_head", "n_tail", "ids", "bridge")

    def __init__(self, head: bytes, tail: bytes, n_head: int, n_tail: int, ids: bytes, bridge: bool):
        self.head, self.tail, self.n_head, self.n_tail, self.ids, self.bridge = head, tail, n_head, n_tail, ids, bridge


def encode_chunk(data: bytes, encode) -> Chunk:
    values = encode.values(data)
    words = data.split()
    inside_head, inside_tail = data[0] not in _SPACE, data[-1] not in _SPACE
    head, tail = words[0] if inside_head else b"", words[-1] if inside_tail else b""
    return Chunk(head, tail, len(values[0]) // 4 if inside_head else 0, len(values[-1]) // 4 if inside_tail else 0,
                 b"".join(values), inside_head and inside_tail and len(words) == 1)


def join_chunks(parts: list[Chunk], encode) -> bytes:
    """The ids of the text that the chunks make, repaired at every join."""
    out: list[bytes] = []
    open_text, open_ids = b"", b""  # a word half (or more) that the next chunk may continue
    for part in parts:
        if part.bridge:  # no white space: the window grows through it
            open_ids = part.ids if not open_text else None
            open_text += part.head
            continue
        body = part.ids[4 * part.n_head:len(part.ids) - 4 * part.n_tail]
        if part.head and open_text:
            out.append(b"".join(encode.values(open_text + part.head)))
        elif open_text:
            out.append(open_ids if open_ids is not None else b"".join(encode.values(open_text)))
        else:
            out.append(part.ids[:4 * part.n_head])
        out.append(body)
        open_text, open_ids = part.tail, part.ids[len(part.ids) - 4 * part.n_tail:]
    if open_text:
        out.append(open_ids if open_ids is not None else b"".join(encode.values(open_text)))
    return b"".join(out)


class Finish:
    """Columns of an encoded text: its ids and what they decode to."""

    columns = (("n_tokens", "bigint"), ("ids", "array<int>"), ("decoded", "string"))

    def __init__(self, tokenizer):
        self.tokens = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]

    def __call__(self, ids: list[int]) -> tuple:
        return len(ids), ids, self.decode(ids)

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, the library joins tokens with spaces."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])


class FinishDigest(Finish):
    """The same as hashes."""

    columns = (("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string"))

    def __init__(self, tokenizer):
        super().__init__(tokenizer)
        self.decimal = [str(i) for i in range(len(self.tokens))]

    def __call__(self, ids: list[int]) -> tuple:
        decimal = self.decimal
        return (len(ids), hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest(),
                hashlib.sha256(self.decode(ids).encode()).hexdigest())


_FINISH: dict = {}


def _tools(path: str, finish: type):
    encode = coder(path, ids_as_u32)
    if (path, finish) not in _FINISH:
        _FINISH[path, finish] = finish(encode.tokenizer)
    return encode, _FINISH[path, finish]


def _ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def _key_batches(batches):
    """Chunk hashes of a task with their counts."""
    import pyarrow as pa

    waiting, size = [], 0

    def sums():
        both, n = np.unique(np.concatenate(waiting, axis=1), axis=1, return_counts=True)
        waiting.clear()
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), pa.array(n, pa.int64())], ["k1", "k2", "n"])

    for batch in batches:
        for text in batch.column(0):
            parts = chunks((text.as_py() or "").encode())
            if parts:
                waiting.append(chunk_keys(parts))
                size += len(parts)
        if size > 100_000:
            yield sums()
            size = 0
    if waiting:
        yield sums()


def shared_filter(docs: DataFrame) -> np.ndarray:
    """Bit filter of the chunks that occur more than once."""
    keys = map_arrow(docs.select(F.col("text").cast("string")), _key_batches, "k1 bigint, k2 bigint, n bigint")
    shared = cut(keys.groupBy("k1", "k2").agg(F.sum("n").alias("n")).where("n > 1").select("k1", "k2"), "shared-chunks")
    bits = min(max(1 << 16, 1 << (16 * shared.count()).bit_length()), MOST_FILTER_BITS)
    place = F.explode(F.array(F.pmod("k1", F.lit(bits)), F.pmod("k2", F.lit(bits))))
    words = (shared.select(place.alias("p")).select(F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint64)
    return out


def in_filter(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.mod(keys, len(words) * 64)
    return ((words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)).all(axis=0)


#: Kinds of the second pass's rows.
DONE, OPEN, OWN, SHARED = range(4)
_PART = "seq bigint, k1 bigint, k2 bigint, text binary, head binary, tail binary, n_head bigint, n_tail bigint, part_ids binary, bridge boolean"


def _part_columns(part: Chunk) -> tuple:
    return part.head, part.tail, part.n_head, part.n_tail, part.ids, part.bridge


def _encode_batches(path: str, finish: type, words):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encode, done = _tools(path, finish)
        shared_words = words.value
        uid = (TaskContext.get().partitionId() << 33) - 1
        sent: set = set()
        simple = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
        names = [(n, simple[t]) for n, t in (("uid", "bigint"), ("kind", "bigint"), *finish.columns, *(c.split() for c in _PART.split(", ")))]
        none = (None,) * len(finish.columns)

        def table(rows, origin, source):
            columns = [pa.array(c, t) for c, (_, t) in zip(zip(*rows), names)]
            return pa.RecordBatch.from_arrays([source.take(pa.array(origin, pa.int64())), *columns], ["row", *(n for n, _ in names)])

        for batch in batches:
            rows, origin, size = [], [], 0
            for i, value in enumerate(batch.column("_text")):
                data = (value.as_py() or "").encode()
                uid += 1
                parts = chunks(data)
                keys = chunk_keys(parts) if parts else None
                maybe = in_filter(keys, shared_words) if parts else np.zeros(0, bool)
                if not maybe.any():
                    rows.append((uid, DONE, *done(_ids(b"".join(encode.values(data)))), *(None,) * 10))
                    origin.append(i)
                    continue
                rows.append((uid, OPEN, *none, *(None,) * 10))
                origin.append(i)
                for seq, (part, again, k1, k2) in enumerate(zip(parts, maybe.tolist(), *keys.tolist())):
                    if again:
                        text = None if (k1, k2) in sent else part
                        if len(sent) > 200_000:
                            sent.clear()
                        sent.add((k1, k2))
                        rows.append((uid, SHARED, *none, seq, k1, k2, text, *(None,) * 6))
                    else:
                        rows.append((uid, OWN, *none, seq, None, None, None, *_part_columns(encode_chunk(part, encode))))
                    origin.append(None)
                    size += len(part)
                if size > 8_000_000:
                    yield table(rows, origin, batch.column("row"))
                    rows, origin, size = [], [], 0
            if rows:
                yield table(rows, origin, batch.column("row"))

    return run


def _once_batches(path: str):
    def run(batches):
        import pyarrow as pa

        encode = coder(path, ids_as_u32)
        types = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
        for batch in batches:
            found = [_part_columns(encode_chunk(t.as_py(), encode)) for t in batch.column("text")]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*found)) or [[]] * 6, types)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *columns],
                                             ["k1", "k2", "head", "tail", "n_head", "n_tail", "part_ids", "bridge"])

    return run


def _join_batches(path: str, finish: type):
    def run(batches):
        import pyarrow as pa

        encode, done = _tools(path, finish)
        simple = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
        for batch in batches:
            out = []
            for parts in batch.column("parts"):
                made = [Chunk(p["head"], p["tail"], p["n_head"], p["n_tail"], p["part_ids"], p["bridge"]) for p in parts.as_py()]
                out.append(done(_ids(join_chunks(made, encode))))
            columns = [pa.array(c, simple[t]) for c, (_, t) in zip(list(zip(*out)) or [[]] * 3, finish.columns)]
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *columns], ["uid", *(n for n, _ in finish.columns)])

    return run


def encode(docs: DataFrame, keep: list[str], finish: type = Finish, vocabulary: str | None = None) -> DataFrame:
    """``row`` (a struct of the columns to keep) and the columns of ``finish`` for every document."""
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    words = docs.sparkSession.sparkContext.broadcast(shared_filter(docs))
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").cast("string").alias("_text"))
    columns = ", ".join(f"{n} {t}" for n, t in finish.columns)
    names = [n for n, _ in finish.columns]
    schema = f"row {rows.schema['row'].dataType.simpleString()}, uid bigint, kind bigint, {columns}, {_PART}"
    table = cut(map_arrow(rows, _encode_batches(path, finish, words), schema), "chunks")

    texts = table.where(F.col("kind") == SHARED).groupBy("k1", "k2").agg(F.max("text").alias("text"))
    once = cut(map_arrow(texts, _once_batches(path), "k1 bigint, k2 bigint, head binary, tail binary, n_head bigint, "
                         "n_tail bigint, part_ids binary, bridge boolean"), "chunks-once")
    part = ["seq", "head", "tail", "n_head", "n_tail", "part_ids", "bridge"]
    occurrences = table.where(F.col("kind") == SHARED).select("uid", "seq", "k1", "k2").join(once, ["k1", "k2"]).select("uid", *part)
    own = table.where(F.col("kind") == OWN).select("uid", *part)
    whole = own.union(occurrences).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct(*part))).alias("parts"))  # a document's own chunks
    joined = map_arrow(whole, _join_batches(path, finish), f"uid bigint, {columns}")
    opened = table.where(F.col("kind") == OPEN).select("uid", "row").join(joined, "uid").select("row", *names)
    return table.where(F.col("kind") == DONE).select("row", *names).union(opened)
