"""Language-model scores from a causal self-attention model on subword ids.

One Arrow pass reads the corpus into blocks: the subword ids of every text, each block's distinct words
with their training counts, and the texts as numbers of their block's words.  From there:

* unigram base: a windowed sum over the blocks' words gives every word's training count; the counts go back to the
  blocks and meet the block's texts (``cogroup``), so a word is shuffled once per block, not once per occurrence;
* attention model: an id is predicted as group of classes, class and member.  The most frequent ids are classes of their
  own, the others share classes of equal mass; members follow smoothed counts over all training texts.  Groups and
  classes come from one causal self-attention layer with a hidden layer after it, trained in numpy over all windows of all training texts: in each of
  ``ROUNDS`` rounds every task trains on its share of the round's texts from the same weights, and the results are averaged
  by tokens (a grouped mean per weight);
* scoring: a text is laid on a grid of windows of ``WINDOW`` ids that start every ``HOP`` ids; every id is scored
  once, in the first window that holds it, so past the first window it sees ``WINDOW - HOP`` ids at least.
  Windows of many texts go through masked attention together.  The grid starts at the text's own start, so a
  score doesn't depend on how texts are dealt to tasks or blocks.

Bounds: a block holds about ``BLOCK_WORDS`` words; the driver gets one count per id of the vocabulary and the weights of
the model; both are broadcast with the tasks' code.

Defined results: a null or empty text is the end token alone; a word of which the vocabulary keeps nothing adds
nothing to the score; without training texts counts are zero and the model is as it starts; null and
repeated ids are carried as they are; an empty table gives no rows.  A long text is read in segments and its
parts, which may lie in several blocks, carry the ids before them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import cut, map_arrow, text_of, tokenizer_path
from loglens.llm.wordcode import WordCoder
from loglens.session import ship_package

#: Ids of a window, and ids between the starts of windows when scoring.
WINDOW = 16
HOP = 12
#: Width of the model, of its hidden layer, and rows of its input table.
WIDTH, HIDDEN, INPUTS = 8, 16, 2048
#: Groups of classes and classes of a group; the last SHARED classes are shared by the rarer ids.
GROUPS, MEMBERS = 8, 16
SHARED = 24
SINGLES = GROUPS * MEMBERS - SHARED
#: Rounds of training, windows of a step, step size.
ROUNDS, STEP_WINDOWS, RATE = 4, 512, 0.02
#: A block is closed at this many words or distinct words.
BLOCK_WORDS, BLOCK_DISTINCT = 3_000_000, 300_000
#: Bytes of a text that are read at a time; texts are looked up together up to about so many words.
SEGMENT = 1_000_000
CHUNK_WORDS = 100_000
#: Smoothing of counts.
ALPHA = 0.1

_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_LN10 = float(np.log(10.0))


# ---- reading -----------------------------------------------------------------

class Words:
    """The distinct words of a block: their numbers, subword ids and training counts."""

    def __init__(self, coder: WordCoder):
        self.coder = coder
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new word gets the next number
        self.start = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.trained = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint16)
        self.filled = 0

    def numbers(self, words: list[bytes], learn: np.ndarray | bool) -> np.ndarray:
        """Numbers of words in a row; ``learn`` says which of them count as training words."""
        first = len(self.number)
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        if len(self.number) > first:
            self._add(list(islice(self.number, first, None)), first)
        end = len(self.number)
        self.trained[:end] += np.bincount(found[np.broadcast_to(learn, found.shape)], minlength=end)
        return found

    def _add(self, words: list[bytes], first: int) -> None:
        end = first + len(words)
        lengths, ids = self.coder.flat_ids(words)
        last = self.filled + len(ids)
        while end > len(self.start):
            for name in ("start", "length", "trained"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.zeros_like(old)]))
        while last > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[first:end] = self.filled + np.cumsum(lengths) - lengths
        self.length[first:end] = lengths
        self.flat[self.filled:last] = ids
        self.filled = last

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Subword ids of words in a row."""
        lengths = self.length.take(numbers)
        at = np.repeat(self.start.take(numbers) - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return self.flat.take(at)

    def id_counts(self, size: int) -> np.ndarray:
        """How often each id occurs in training texts."""
        n = len(self.number)
        every = np.repeat(self.trained[:n], self.length[:n])  # words lie in ``flat`` in the order of their numbers
        return np.bincount(self.flat[:self.filled], every, size).astype(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed byte plane by byte plane: the high planes of small numbers vanish."""
    import zstandard

    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def segments(data: bytes, size: int = SEGMENT) -> Iterator[list[bytes]]:
    """The words of a text, a bounded number of bytes at a time (at least one list)."""
    start = 0
    while True:
        at = _SPACE.search(data, start + size)
        end = at.start() if at else len(data)
        yield data[start:end].split()
        start = end
        if end == len(data):
            return


def marked(items: Iterator) -> Iterator[tuple]:
    """Every item, and whether it is the last."""
    items = iter(items)
    one = next(items)
    for more in items:
        yield one, False
        one = more
    yield one, True


_FIELDS = ("uid bigint, part int, row {row}, learn boolean, start bigint, before binary, ids binary, last boolean, "
           "block bigint, idx int, word string, n bigint, uids binary, lengths binary, words binary")


def _read(path: str, end_id: int, names: list[str], size: int):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        coder = WordCoder(path, tuple, 300_000)
        base = TaskContext.get().partitionId()
        uid, block, types = base << 33, base << 31, None
        words, uids, lengths, texts, total = Words(coder), [], [], [], 0
        parts: list[tuple] = []
        held = 0
        chunk: list[tuple] = []  # pieces of texts to look up: their text's number, row, learn, number of the piece, whether it is the last
        found: list[list[bytes]] = []  # their words
        waiting = 0
        start, before = 0, np.zeros(0, np.uint16)  # ids of the last text so far, and the last of them

        def batch_of(rows: int, /, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[k] if k in columns else pa.nulls(rows, types[k]) for k in names], names)

        def send_parts() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*parts))
            n = len(parts)
            parts.clear()
            held = 0
            keys = ["uid", "part", "row", "learn", "start", "before", "ids", "last"]
            return batch_of(n, **{k: pa.concat_arrays(c) if k == "row" else pa.array(c, types[k]) for k, c in zip(keys, columns)})

        def close() -> Iterator:
            nonlocal words, uids, lengths, texts, total, block
            every = list(words.number)
            for at in range(0, len(every), 50_000):
                some = every[at:at + 50_000]
                yield batch_of(len(some), block=pa.array(np.full(len(some), block)), idx=pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                               word=pa.array(some, pa.binary()).cast(pa.string()), n=pa.array(words.trained[at:at + len(some)]))
            counts = words.id_counts(size)
            used = np.flatnonzero(counts)
            yield batch_of(len(used), idx=pa.array(used.astype(np.int32)), n=pa.array(counts[used]))
            joined = packed(np.concatenate(texts)) if texts else packed(np.zeros(0, np.uint32))
            yield batch_of(1, block=pa.array([block]), uids=pa.array([np.array(uids, "<i8").tobytes()]),
                           lengths=pa.array([np.array(lengths, "<i8").tobytes()]), words=pa.array([joined]))
            words, uids, lengths, texts, total, block = Words(coder), [], [], [], 0, block + 1

        def look_up() -> Iterator:
            """The waiting words go to the block, and their texts' pieces with ids to the parts."""
            nonlocal waiting, total, held, start, before
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            numbers = words.numbers(list(chain.from_iterable(found)), np.repeat([c[2] for c in chunk], sizes))
            ids = words.ids(numbers)
            ends = np.r_[0, np.cumsum(words.length.take(numbers))][np.cumsum(sizes)].tolist()
            for (uid, row, learn, part, last), lo, hi in zip(chunk, [0, *ends], ends):
                if part == 0:
                    start, before = 0, ids[:0]
                mine = ids[lo:hi]
                parts.append((uid, part, row, learn, start, before.tobytes(), mine.tobytes() + end * last, last))
                start += len(mine)
                if not last:
                    before = np.concatenate([before, mine])[-WINDOW:]
            uids.extend(c[0] for c in chunk)
            lengths.extend(sizes.tolist())
            texts.append(numbers.astype(np.uint32))
            total += len(numbers)
            held += 2 * len(ids)
            chunk.clear()
            found.clear()
            waiting = 0
            if held >= 8_000_000 or len(parts) >= 10_000:
                yield send_parts()
            if total >= BLOCK_WORDS or len(words.number) >= BLOCK_DISTINCT:
                yield from close()

        end = np.uint16(end_id).tobytes()
        for batch in batches:
            if types is None:
                types = dict(uid=pa.int64(), part=pa.int32(), row=batch.column(0).type, learn=pa.bool_(), start=pa.int64(),
                             before=pa.binary(), ids=pa.binary(), last=pa.bool_(), block=pa.int64(), idx=pa.int32(), word=pa.string(),
                             n=pa.int64(), uids=pa.binary(), lengths=pa.binary(), words=pa.binary())
            for i, (learn, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                row, part = batch.column(0).slice(i, 1), 0
                for some, last in marked(segments(text.as_buffer().to_pybytes().lower())):
                    chunk.append((uid, row, learn, part, last))
                    found.append(some)
                    part += 1
                    waiting += len(some)
                    if waiting >= min(CHUNK_WORDS, BLOCK_WORDS) or len(chunk) >= 10_000:
                        yield from look_up()
                uid += 1
        if chunk:
            yield from look_up()
        if parts:
            yield send_parts()
        if uids:
            yield from close()

    return run


# ---- the unigram base ----------------------------------------------------------

def _base(denominator: float):
    def run(block, counts):
        """Per text of a block: its words, known words and log10 score."""
        import pyarrow as pa

        uids, lengths = (np.frombuffer(block.column(c)[0].as_py(), "<i8") for c in ("uids", "lengths"))
        words = unpacked(block.column("words")[0].as_py())
        count = np.zeros(counts.num_rows, np.int64)
        if counts.num_rows:
            count[counts.column("idx").to_numpy()] = counts.column("c").to_numpy()
        score = np.log10((count + ALPHA) / denominator)
        of = np.repeat(np.arange(len(uids)), lengths)
        return pa.table({"uid": uids, "n_words": lengths,
                         "n_known": np.bincount(of, count[words] > 0, len(uids)).astype(np.int64),
                         "base": np.bincount(of, score[words], len(uids)).astype(np.float64)})

    return run


# ---- the model -----------------------------------------------------------------

class Classes:
    """Class and member of every id: the commonest ids alone, the rest in classes of equal mass."""

    def __init__(self, counts: np.ndarray):
        order = np.lexsort((np.arange(len(counts)), -counts))
        mass = counts[order] + ALPHA
        upto = np.cumsum(mass[SINGLES:]) - mass[SINGLES:] / 2
        self.of = np.empty(len(counts), np.int32)
        self.of[order[:SINGLES]] = np.arange(SINGLES)
        self.of[order[SINGLES:]] = SINGLES + np.minimum(upto / mass[SINGLES:].sum() * SHARED, SHARED - 1).astype(np.int32)
        weight = np.bincount(self.of, counts + ALPHA, SINGLES + SHARED)
        self.member = np.log((counts + ALPHA) / weight[self.of])  # natural log of an id within its class
        share = np.log(np.maximum(weight, ALPHA) / weight.sum()).reshape(GROUPS, MEMBERS)
        self.group_share = np.log(np.exp(share).sum(1))
        self.share = share - self.group_share[:, None]
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        half = INPUTS // 2
        self.input = np.where(rank < half, rank, half + rank % half).astype(np.int32)


def shapes() -> dict[str, tuple]:
    return {"E": (INPUTS, WIDTH), "P": (WINDOW, WIDTH), "Q": (WIDTH, 3 * WIDTH), "O": (WIDTH, WIDTH), "H": (WIDTH, HIDDEN), "h": (HIDDEN,),
            "U": (HIDDEN, GROUPS), "V": (GROUPS, HIDDEN, MEMBERS), "u": (GROUPS,), "v": (GROUPS, MEMBERS)}


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes().items():
        n = int(np.prod(shape))
        out[name] = flat[at:at + n].reshape(shape)
        at += n
    return out


def initial(classes: Classes, seed: int = 11) -> np.ndarray:
    """Weights before training: small random ones, and the classes' shares as the output's start."""
    rng = np.random.default_rng(seed)
    scale = {"E": 0.3, "P": 0.1, "Q": WIDTH ** -0.5, "O": WIDTH ** -0.5, "H": WIDTH ** -0.5, "h": 0.0, "U": 0.05, "V": 0.05, "u": 0.0, "v": 0.0}
    parts = [rng.standard_normal(shape).astype(np.float32) * np.float32(scale[name]) for name, shape in shapes().items()]
    parts[-2:] = classes.group_share.astype(np.float32), classes.share.astype(np.float32)
    return np.concatenate([p.ravel() for p in parts])


_BEHIND = np.tril(np.ones((WINDOW, WINDOW), np.float32))
#: Exponents are cut here, so that none overflows; sums over short last axes go through BLAS.
_STEEPEST = np.float32(60)


def attend(m: dict, inputs: np.ndarray) -> dict:
    """Masked attention over windows of input rows (n, WINDOW): the state after the layer, and what its gradient needs."""
    x = m["E"].take(inputs, axis=0)
    x += m["P"]
    qkv = x.reshape(-1, WIDTH) @ m["Q"]
    q, k, v = (np.ascontiguousarray(qkv[:, i * WIDTH:(i + 1) * WIDTH]).reshape(x.shape) for i in range(3))
    q *= np.float32(WIDTH ** -0.5)
    s = q @ k.transpose(0, 2, 1)
    _cut(s)
    np.exp(s, out=s)
    s *= _BEHIND
    s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(len(s), WINDOW, 1)
    mixed = s @ v
    return {"x": x, "q": q, "k": k, "v": v, "s": s, "mixed": mixed,
            "state": x + (mixed.reshape(-1, WIDTH) @ m["O"]).reshape(x.shape)}


def _cut(x: np.ndarray) -> None:
    if x.size and not x.max() <= _STEEPEST:
        np.minimum(x, _STEEPEST, out=x)


def _softened(logits: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turns logits into weights in place; their sums and the natural log probability of the wanted columns."""
    _cut(logits)
    chosen = logits.ravel().take(np.arange(0, logits.size, logits.shape[1]) + want)
    np.exp(logits, out=logits)
    total = logits @ np.ones(logits.shape[1], logits.dtype)
    return total, chosen - np.log(total)


def predict(m: dict, state: np.ndarray, want: np.ndarray, weight: np.ndarray | None = None, g: dict | None = None):
    """Natural log probabilities of the wanted classes for states (n, WIDTH).

    With weights, also the gradient of their negative weighted sum: the weights' in ``g``, the states' returned.
    Classes of a group are only worked out for the states that want one of them.
    """
    hidden = state @ m["H"]
    hidden += m["h"]
    np.maximum(hidden, 0, out=hidden)
    group, inner = np.divmod(want, MEMBERS)
    top = hidden @ m["U"]
    top += m["u"]
    total, logp = _softened(top, group)
    if weight is not None:
        top *= (weight / total)[:, None]
        top[np.arange(len(want)), group] -= weight
        g["U"][:] = hidden.T @ top
        g["u"][:] = np.ones(len(want), top.dtype) @ top
        back = top @ m["U"].T
    order = np.argsort(group.astype(np.int8), kind="stable")
    edges = np.bincount(group, minlength=GROUPS).cumsum().tolist()
    hidden_of, inner_of = hidden.take(order, axis=0), inner.take(order)
    weight_of = None if weight is None else weight.take(order)
    logp_of, back_of = np.empty_like(logp), None if weight is None else np.empty_like(hidden)
    for k, (lo, hi) in enumerate(zip([0, *edges], edges)):
        if lo == hi:
            continue
        d = hidden_of[lo:hi] @ m["V"][k]
        d += m["v"][k]
        total, logp_of[lo:hi] = _softened(d, inner_of[lo:hi])
        if weight is not None:
            w = weight_of[lo:hi]
            d *= (w / total)[:, None]
            d[np.arange(hi - lo), inner_of[lo:hi]] -= w
            g["V"][k] = hidden_of[lo:hi].T @ d
            g["v"][k] = np.ones(hi - lo, d.dtype) @ d
            back_of[lo:hi] = d @ m["V"][k].T
    again = np.empty(len(want), np.int64)
    again[order] = np.arange(len(want))
    logp += logp_of.take(again)
    if weight is None:
        return logp
    back += back_of.take(again, axis=0)
    back *= hidden > 0
    g["H"][:] = state.T @ back
    g["h"][:] = np.ones(len(want), back.dtype) @ back
    return logp, back @ m["H"].T


def gradient(flat: np.ndarray, inputs: np.ndarray, targets: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the mean loss over the real targets of windows, and that loss."""
    m, out = unpack(flat), np.zeros_like(flat)
    g = unpack(out)
    a = attend(m, inputs)
    n = len(inputs)
    state = a["state"].reshape(-1, WIDTH)
    want, weight = targets.ravel(), real.ravel().astype(np.float32)
    weight /= max(weight.sum(), 1)
    logp, d_state = predict(m, state, want, weight, g)
    loss = float(-(logp * weight).sum())
    g["O"][:] = a["mixed"].reshape(-1, WIDTH).T @ d_state
    d_mixed = (d_state @ m["O"].T).reshape(n, WINDOW, WIDTH)
    d_s = d_mixed @ a["v"].transpose(0, 2, 1)
    d_s *= a["s"]
    d_s -= a["s"] * (d_s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(n, WINDOW, 1)
    d_qkv = np.concatenate([(d_s @ a["k"]) * np.float32(WIDTH ** -0.5), d_s.transpose(0, 2, 1) @ a["q"],
                            a["s"].transpose(0, 2, 1) @ d_mixed], -1).reshape(-1, 3 * WIDTH)
    g["Q"][:] = a["x"].reshape(-1, WIDTH).T @ d_qkv
    d_x = d_state + d_qkv @ m["Q"].T
    g["P"][:] = d_x.reshape(n, WINDOW, WIDTH).sum(0)
    where = inputs.ravel()
    for j in range(WIDTH):
        g["E"][:, j] = np.bincount(where, d_x[:, j], INPUTS)
    return out, loss


class Trainer:
    """Adam steps over batches of windows."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.copy()
        self.mean, self.square, self.steps, self.tokens = np.zeros_like(flat), np.zeros_like(flat), 0, 0

    def step(self, inputs, targets, real) -> float:
        g, loss = gradient(self.flat, inputs, targets, real)
        self.steps += 1
        self.tokens += int(real.sum())
        self.mean += 0.1 * (g - self.mean)
        self.square += 0.01 * (g * g - self.square)
        size = RATE * (1 - 0.99 ** self.steps) ** 0.5 / (1 - 0.9 ** self.steps)
        self.flat -= (size * self.mean / (np.sqrt(self.square) + 1e-6)).astype(np.float32)
        return loss


def grid(start: int, count: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """For ids ``start`` to ``start + count`` of a text: the starts of the windows that score them (window 0 scores all
    of its ids, window k at ``k * hop`` its last ``hop``), and each id's window as an index into them."""
    at = np.arange(start, start + count)
    window = np.maximum(0, (at - WINDOW + hop) // hop)
    first = int(window[0]) if count else 0
    return np.arange(first, int(window[-1]) + 1 if count else 0) * hop, window - first


def windows(parts, classes: Classes, begin_id: int, hop: int) -> tuple:
    """Inputs (n, WINDOW) of the windows of some parts and, for every id of the parts in order, its window,
    its place there and the part.  ``parts``: (start, before, ids) with ids as uint16 arrays."""
    streams, tops, of_window, place, of_part, made, at = [], [], [], [], [], 0, 0
    for p, (start, before, ids) in enumerate(parts):
        starts, window = grid(start, len(ids), hop)
        known = len(before)  # inputs of the part reach back to id start - known; input t is id t - 1
        lead = np.r_[np.uint16(begin_id), before] if known == start else before
        shift = start - known + (known != start)  # absolute number of the first input in the stream
        stream = np.concatenate([lead, ids[:-1]]) if len(ids) else lead
        streams.append(stream)
        tops.append(starts - shift + at)
        of_window.append(window + made)
        place.append(np.arange(start, start + len(ids)) - starts[window])
        of_part.append(np.full(len(ids), p))
        made += len(starts)
        at += len(stream)
    stream = np.concatenate([*streams, np.zeros(WINDOW, np.uint16)])
    inputs = classes.input.take(stream).take(np.concatenate(tops)[:, None] + np.arange(WINDOW))
    return inputs, np.concatenate(of_window), np.concatenate(place), np.concatenate(of_part)


def _parts(batch) -> list[tuple]:
    return [(s, np.frombuffer(b.as_py(), np.uint16), np.frombuffer(i.as_py(), np.uint16))
            for s, b, i in zip(batch.column("start").to_pylist(), batch.column("before"), batch.column("ids"))]


def _grouped(parts: list, most: int) -> Iterator[list]:
    """Parts in lists of about ``most`` ids."""
    some, n = [], 0
    for p in parts:
        some.append(p)
        n += len(p[2])
        if n >= most:
            yield some
            some, n = [], 0
    if some:
        yield some


def _train(flat: np.ndarray, classes: Classes, begin_id: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        trainer = Trainer(flat)
        for batch in batches:
            for some in _grouped(_parts(batch), 200_000):
                inputs, window, place, _ = windows(some, classes, begin_id, WINDOW)
                targets, real = np.zeros(inputs.shape, np.int32), np.zeros(inputs.shape, bool)
                targets[window, place] = classes.of[np.concatenate([p[2] for p in some])]
                real[window, place] = True
                order = np.random.default_rng(len(inputs)).permutation(len(inputs))
                for lo in range(0, len(order), STEP_WINDOWS):
                    at = order[lo:lo + STEP_WINDOWS]
                    trainer.step(inputs[at], targets[at], real[at])
        if trainer.tokens:
            n = len(flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(trainer.flat.astype(np.float64) * trainer.tokens),
                                              pa.array(np.full(n, float(trainer.tokens)))], ["pos", "value", "tokens"])

    return run


#: Windows that are scored at a time.
BLOCK_WINDOWS = 256


def log_probabilities(flat: np.ndarray, classes: Classes, parts, begin_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Natural log probability of every id of the parts, and its part."""
    m = unpack(flat)
    inputs, window, place, part = windows(parts, classes, begin_id, HOP)
    ids = np.concatenate([p[2] for p in parts])
    out = classes.member.take(ids)
    want = classes.of.take(ids)
    place += window % BLOCK_WINDOWS * WINDOW  # in its block of windows
    starts = range(0, len(inputs), BLOCK_WINDOWS)
    edges = np.searchsorted(window, [*starts, len(inputs)])  # ids lie in the order of their windows
    for top, lo, hi in zip(starts, edges, edges[1:]):
        state = attend(m, inputs[top:top + BLOCK_WINDOWS])["state"]
        out[lo:hi] += predict(m, state.reshape(-1, WIDTH).take(place[lo:hi], axis=0), want[lo:hi])
    return out, part


def _score(flat: np.ndarray, classes: Classes, begin_id: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            scores = []
            for some in _grouped(_parts(batch), 200_000):
                logp, part = log_probabilities(flat, classes, some, begin_id)
                scores.append(np.bincount(part, logp, len(some)) / _LN10)
            if scores:
                yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(np.concatenate(scores))], ["uid", "score"])

    return run


def train(parts: DataFrame, classes: Classes, begin_id: int, rounds: int = ROUNDS) -> np.ndarray:
    """The model's weights after rounds over all training parts."""
    flat = initial(classes)
    mine = F.crc32("ids") % rounds
    for r in range(rounds):
        trained = map_arrow(parts.where("learn").where(mine == r).select("start", "before", "ids"), _train(flat, classes, begin_id),
                            "pos int, value double, tokens double")
        mean = trained.groupBy("pos").agg((F.sum("value") / F.sum("tokens")).alias("value")).toPandas()  # one row per weight
        if len(mean):
            flat = flat.copy()
            flat[mean["pos"].to_numpy()] = mean["value"].to_numpy().astype(np.float32)
    return flat


# ---- the operator ----------------------------------------------------------------

def score(docs: DataFrame, learn: Column, keep: list[str], vocabulary: str | None = None) -> DataFrame:
    """``row`` (the columns to keep), n_tokens, n_known, train_tokens, base_score and score of every document.

    ``learn`` says which documents teach the counts and the model.
    """
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    probe = WordCoder(path, tuple)
    begin_id, end_id = (probe.tokenizer.token_to_id(t) for t in ("<|startoftext|>", "<|endoftext|>"))
    size = probe.tokenizer.get_vocab_size()
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(learn, F.lit(False)).alias("learn"), text_of(docs).alias("text"))
    schema = _FIELDS.format(row=rows.schema["row"].dataType.simpleString())
    names = [f.split()[0] for f in ("uid", "part", "row", "learn", "start", "before", "ids", "last", "block", "idx", "word", "n", "uids",
                                    "lengths", "words")]
    read = cut(map_arrow(rows, _read(path, end_id, names, size), schema), "lm-blocks")
    parts = read.where("uid IS NOT NULL").select("uid", "row", "learn", "start", "before", "ids", "last")
    words = read.where("word IS NOT NULL").select("block", "idx", "word", "n")
    blocks = read.where("words IS NOT NULL").select("block", "uids", "lengths", "words")
    ids = read.where("block IS NULL AND idx IS NOT NULL").groupBy("idx").agg(F.sum("n").alias("n"))

    # a word has at most one row a block, so the commonest word is no hot key here
    same = Window.partitionBy("word")
    counts = cut(words.select("block", "idx", F.sum("n").over(same).alias("c"), "n",
                              (F.min("block").over(same) == F.col("block")).alias("first")), "lm-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("first") & (F.col("c") > 0)).alias("v")).first()
    texts = parts.where("learn AND last").count()
    n, v = total["n"] + texts, total["v"] + (texts > 0)
    denominator = n + ALPHA * (v + 1)
    ship_package(docs.sparkSession)
    known = counts.select(F.col("block").alias("of"), "idx", "c")
    base = blocks.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(
        _base(denominator), "uid bigint, n_words bigint, n_known bigint, base double")
    base = base.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_known", "base")])

    found = ids.toPandas()  # at most one row per id of the vocabulary
    id_counts = np.zeros(size, np.int64)
    id_counts[found["idx"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    id_counts[end_id] += texts
    classes = Classes(id_counts)
    flat = train(parts, classes, begin_id)
    scored = map_arrow(parts.select("uid", "start", "before", "ids"), _score(flat, classes, begin_id), "uid bigint, score double")
    scored = scored.groupBy("uid").agg(F.sum("score").alias("score"))
    end = float(np.log10((texts + ALPHA) / denominator))
    return (parts.where("last").select("uid", "row").join(base, "uid").join(scored, "uid")
            .select("row", (F.col("n_words") + 1).alias("n_tokens"), (F.col("n_known") + int(texts > 0)).alias("n_known"),
                    F.lit(int(n)).cast("bigint").alias("train_tokens"), (F.col("base") + end).alias("base_score"), "score"))


def held_out(doc_id: Column) -> Column:
    """Documents that never teach: crc32 of the id's text is divisible by 10."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))
