"""Quality rules from tokeniser fertility, with rejection bands per language or script.

Public vocabularies are laid over every word of a text: how many characters a token of a
SentencePiece vocabulary covers, which share of its tokens are raw bytes (byte fallback), how many
characters a token of a byte-level vocabulary covers, and the entropy of the text's tokens.  Clean
texts of one language and length lie close together in these measures; markup junk, shouting,
binary debris and word spam lie far outside.  The bands come from all documents: per group
(language, or script where the language is unknown) and length class, the quartiles of each
measure, taken from exact counts of its rounded values.

Spark does the corpus work: one Arrow pass measures the texts, a grouped histogram gives the
quartiles (a few thousand bins a group, whatever the corpus), and a join on the group judges.

Defined results: a null text is the empty text, which has no words and fails the base rule; a
group too small for a band rejects nothing; repeated rows are judged alike; null ids are kept;
columns of the input that clash with names used here are safe, as the input row travels in one
struct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loglens.llm.common import cut, join_checked, map_arrow, row_with_text, texts, tokenizer_path

#: The rules' fixed values.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20

#: Measure: bins per unit, least half-width of its band, sides that reject.
MEASURES = {
    "chars_per_piece": (200, 0.30, "both"),
    "chars_per_byte_token": (200, 0.30, "both"),
    "fallback_share": (2000, 0.03, "high"),
    "token_entropy": (100, 0.60, "both"),
}
#: Half-width of a band in quartile distances beyond the median.
BAND_WIDTH = 5.0
#: A group needs this many documents for a band of its own.
LEAST_DOCUMENTS = 30

#: First code point of each script's main blocks (fixed values of the Unicode charts), in order.
SCRIPT_STARTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])


class Fertility:
    """Word table of a worker: each distinct word is encoded once and then known by a number."""

    def __init__(self, piece_path: str, byte_path: str, max_words: int = 300_000):
        import base64

        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.raw = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        with open(byte_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.count = self.filled = 0
        self.start = np.zeros(1024, np.int64)
        self.n_piece = np.zeros(1024, np.int64)
        self.n_raw = np.zeros(1024, np.int64)
        self.n_byte = np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.int32)

    def _learn(self, words: list[bytes]) -> None:
        encoded = self.pieces.encode([w.decode() for w in words], num_threads=1)
        lengths = np.fromiter(map(len, encoded), np.int64, len(words))
        tokens = np.fromiter((t for e in encoded for t in e), np.int32, int(lengths.sum()))
        end, last = self.count + len(words), self.filled + len(tokens)
        while end > len(self.start):
            for name in ("start", "n_piece", "n_raw", "n_byte"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        while last > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        at = slice(self.count, end)
        self.start[at] = self.filled + np.cumsum(lengths) - lengths
        self.n_piece[at] = lengths
        self.n_raw[at] = np.bincount(np.repeat(np.arange(len(words)), lengths), self.raw[tokens], len(words))
        self.n_byte[at] = [len(self.bytes.encode_ordinary(" " + w.decode())) for w in words]
        self.flat[self.filled:last] = tokens
        for i, w in enumerate(words, self.count):
            self.number[_key(w)] = i
        self.count, self.filled = end, last

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.number
        keys = words if max(map(len, words), default=0) <= 256 else [_key(w) for w in words]
        try:
            return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
        except KeyError:
            pass
        distinct = dict(zip(keys, words))
        missing = [w for k, w in distinct.items() if k not in known]
        if known and self.count + len(missing) > self.max_words:
            self.clear()
            known, missing = self.number, list(distinct.values())
        for i in range(0, len(missing), 50_000):
            self._learn(missing[i:i + 50_000])
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def entropy(self, numbers: np.ndarray) -> float:
        """Shannon entropy in bits of the piece tokens of a text."""
        word, times = np.unique(numbers, return_counts=True)
        lengths = self.n_piece[word]
        total = int(lengths.sum())
        if not total:
            return 0.0
        at = np.repeat(self.start[word] - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)
        counts = np.bincount(self.flat[at], np.repeat(times, lengths))
        share = counts[counts > 0] / counts.sum()
        return float(-(share * np.log2(share)).sum())


def _key(word: bytes) -> bytes:
    return word if len(word) <= 256 else b" " + hashlib.blake2b(word, digest_size=24).digest()


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    mix = np.zeros(n, np.uint64)
    for k in range(window):  # one sort of hashes; equal hashes are then compared word by word
        mix = mix * np.uint64(0x9E3779B97F4A7C15) + (numbers[k:k + n].astype(np.uint64) + np.uint64(1))
        mix ^= mix >> np.uint64(29)
    order = np.argsort(mix, kind="stable")
    same = np.flatnonzero(mix[order[1:]] == mix[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    if not all((numbers[a + k] == numbers[b + k]).all() for k in range(window)):
        _, inverse = np.unique(np.stack([numbers[k:k + n] for k in range(window)], 1), axis=0, return_inverse=True)
        twice = np.bincount(inverse.ravel())[inverse.ravel()] > 1
    else:
        twice = np.zeros(n, bool)
        twice[a] = twice[b] = True
    covered = np.zeros(len(numbers), bool)
    for k in range(window):
        covered[k:k + n] |= twice
    return int(covered.sum())


def script_of(text: str) -> str:
    """The script most letters of the text belong to."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letters = points[(points > 0x7F) | (((points | 0x20) >= 97) & ((points | 0x20) <= 122))]
    if not len(letters):
        return "none"
    block = np.bincount(np.searchsorted(_STARTS, letters, side="right") - 1, minlength=len(SCRIPT_STARTS))
    totals: dict[str, int] = {}
    for (_, name), count in zip(SCRIPT_STARTS, block):
        totals[name] = totals.get(name, 0) + int(count)
    return max(totals, key=lambda name: (totals[name], name))


def measure(text: str, table: Fertility) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens and the four measures."""
    words = text.encode().split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    dup_lines = len(lines) - len(set(lines))
    if not words:
        return 0, word_chars, symbols, dup_lines, 0, 0, None, None, None, None
    numbers = table.numbers(words)
    pieces = int(table.n_piece[numbers].sum())
    return (len(words), word_chars, symbols, dup_lines, repeated_words(numbers), pieces,
            word_chars / pieces, word_chars / int(table.n_byte[numbers].sum()),
            int(table.n_raw[numbers].sum()) / pieces, table.entropy(numbers))


_TABLES: dict = {}
_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *MEASURES, "script"]


def _measure_batches(paths: tuple):
    def run(batches) -> Iterator:
        import pyarrow as pa

        table = _TABLES.get(paths) or _TABLES.setdefault(paths, Fertility(*paths))
        types = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.string()]
        for batch in batches:
            out = []
            for text, lang in zip(texts(batch), batch.column("_lang").to_pylist()):
                text = text.as_py() or ""
                out.append((*measure(text, table), script_of(text) if lang is None else None))
            columns = [pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("_lang"), *columns],
                                             ["row", "_lang", *_NAMES])
        table.clear()  # the worker goes on to other work

    return run


def measured(docs: DataFrame, keep: list[str], vocabularies: tuple | None = None) -> DataFrame:
    """One row per document: ``row`` (a struct of the columns to keep) and the measures."""
    paths = vocabularies or (tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    rows = docs.select(*row_with_text(docs, keep), F.col("lang").cast("string").alias("_lang"))
    schema = ", ".join([f"row {rows.schema['row'].dataType.simpleString()}", "_lang string",
                        *(f"{n} bigint" for n in _NAMES[:6]), *(f"{n} double" for n in MEASURES), "script string"])
    return map_arrow(rows, _measure_batches(paths), schema)


def grouped(df: DataFrame) -> DataFrame:
    """Adds the band's key: language or else script, and the length class (a power of two of tokens)."""
    return (df.withColumn("band", F.coalesce(F.concat(F.lit("lang:"), "_lang"), F.concat(F.lit("script:"), "script")))
            .withColumn("size", F.when(F.col("n_tokens") > 0, F.floor(F.log2("n_tokens"))).cast("int")))


def bands(df: DataFrame, width: float = BAND_WIDTH, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per band key and length class, the limits of every measure (null where the group is too small).

    Quartiles come from counts per rounded value: the counts are bounded by the bins, not by the
    documents, and they are exact, so the limits do not depend on how rows are partitioned.
    """
    counts = (df.where("n_words > 0").select("band", "size", F.explode(F.array(*[
        F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * scale).cast("long").alias("bin"))
        for m, (scale, _, _) in MEASURES.items()])).alias("x"))
        .groupBy("band", "size", "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n")))
    group = Window.partitionBy("band", "size", "measure")
    upto = F.sum("n").over(group.orderBy("bin"))
    total = F.sum("n").over(group)
    at = counts.select("band", "size", "measure", "bin", "n", upto.alias("upto"), total.alias("total"))

    def quantile(q):
        return F.min(F.when(F.col("upto") >= F.col("total") * q, F.col("bin")))

    quartiles = at.groupBy("band", "size", "measure").agg(
        F.max("total").alias("total"), quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3"))
    limits = []
    for m, (scale, least, sides) in MEASURES.items():
        mine = F.col("measure") == m
        reach = F.greatest(F.lit(least), (F.col("q3") - F.col("q1")) / scale * width)
        enough = F.col("total") >= least_documents
        low, high = F.col("q2") / scale - reach, F.col("q2") / scale + reach
        limits += [F.max(F.when(mine & enough, low if sides == "both" else F.lit(None).cast("double"))).alias(f"low_{m}"),
                   F.max(F.when(mine & enough, high)).alias(f"high_{m}")]
    return quartiles.groupBy("band", "size").agg(*limits)


def judge(docs: DataFrame, keep: list[str], width: float = BAND_WIDTH, least_documents: int = LEAST_DOCUMENTS,
          vocabularies: tuple | None = None) -> DataFrame:
    """``row``, the measures, ``base_failed`` and ``kept`` for every document."""
    df = cut(grouped(measured(docs, keep, vocabularies)), "fertility")
    limits = bands(df, width, least_documents)
    outside = F.lit(False)
    for m in MEASURES:
        below = F.coalesce(F.col(m) < F.col(f"low_{m}"), F.lit(False))
        above = F.coalesce(F.col(m) > F.col(f"high_{m}"), F.lit(False))
        outside = outside | below | above
    base = (F.col("n_words") < LEAST_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    joined = join_checked(df, limits, ["band", "size"], "left", "fertility-bands")
    return joined.withColumn("base_failed", base).withColumn("outside_band", outside).withColumn(
        "kept", ~(F.col("base_failed") | F.col("outside_band")))
