"""Language identification with language-bitmask n-gram filters.

Every learned language has a Bloom filter of its letter trigrams (with word ends).  The filters lie
bit-sliced: slot p of the table holds one bit per language, so that a gram's few slots, ANDed,
name at once all languages that contain it.  A text's language is the one with the most of its
grams, after each language's count is corrected for the false positives that its filter's fill
predicts.

Learning counts grams per language over all labelled texts (an Arrow pass that sends a few
thousand sums per task, then a grouped sum), keeps those frequent enough to belong to the language, and
ORs their bits by slot; only the slot table, whose size is a parameter, reaches the driver and
is broadcast.  Prediction is one pass over the texts without a shuffle.

Defined results: a null text and one without a letter are ``und`` with score 0, as is every text when
nothing could be learned; a text whose grams are all unknown gets the alphabetically first language
with score 0; ties go to the alphabetically first; rows without a language teach nothing; repeated rows
count each time; a null id is neither held out nor learned from; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loglens.llm.common import cut, map_arrow, row_with_text, texts

#: Slots of the bit-sliced table (a power of two) and slots per gram.
SLOTS = 1 << 18
HASHES = 3
#: A gram belongs to a language from this share of the language's grams on.
LEAST_SHARE = 5e-5
LEAST_COUNT = 2
#: More languages than this would make the slot table too large to broadcast; it is an error.
MOST_LANGUAGES = 4096
#: Grams gathered before a task sums them up.
GATHER = 1_000_000

_LETTER = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def grams(text: str) -> np.ndarray:
    """The letter trigrams of the lower-cased text, 0 standing for a word's ends, as 63-bit numbers."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.uint64)
    after = np.zeros_like(letter)
    after[1:] = letter[:-1]
    run = np.where(letter, points, 0)[letter | after].astype(np.uint64)
    run = np.concatenate([np.zeros(1, np.uint64), run, np.zeros(1 if run[-1] else 0, np.uint64)])
    middle = run[1:-1] != 0
    return ((run[:-2] << np.uint64(42)) | (run[1:-1] << np.uint64(21)) | run[2:])[middle]


def slots(gram: np.ndarray, n_slots: int = SLOTS, hashes: int = HASHES) -> np.ndarray:
    """(hashes, grams) slot numbers by double hashing of a 64-bit mix."""
    x = gram.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    first, step = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return np.stack([(first + np.uint64(i) * step) & np.uint64(n_slots - 1) for i in range(hashes)]).astype(np.int64)


def _count_batches(batches):
    import pyarrow as pa

    waiting: dict[str, list] = {}
    size = 0

    def sums():
        for lang, parts in waiting.items():
            gram, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)),
                                              pa.array(n, pa.int64())], ["lang", "gram", "n"])
        waiting.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            found = grams(text.as_py())
            waiting.setdefault(lang, []).append(found)
            size += len(found)
            if size >= GATHER:
                yield from sums()
                size = 0
    yield from sums()


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows with a text and a language."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "text is not null and lang is not null")
    return map_arrow(rows, _count_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))


class Filters:
    """The bit-sliced table: ``words[w][slot]`` holds the bits of languages 64 w to 64 w + 63."""

    def __init__(self, languages: list[str], n_slots: int = SLOTS, hashes: int = HASHES):
        self.languages, self.n_slots, self.hashes = languages, n_slots, hashes
        self.words = np.zeros(((len(languages) + 63) // 64, n_slots), np.uint64)

    def fill(self) -> None:
        """Per language, the chance that an unknown gram is found."""
        share = [((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        self.false_positive = np.array(share) ** self.hashes

    def counts(self, gram: np.ndarray) -> np.ndarray:
        """Per language, how many of the grams its filter contains."""
        at = slots(gram, self.n_slots, self.hashes)
        out = np.zeros(len(self.languages), np.int64)
        for w, table in enumerate(self.words):
            mask = table[at[0]]
            for row in at[1:]:
                mask &= table[row]
            here = range(64 * w, min(64 * w + 64, len(self.languages)))
            if len(here) > 8:
                mask, times = np.unique(mask, return_counts=True)
            else:
                times = 1
            for i in here:
                out[i] = (((mask >> np.uint64(i % 64)) & np.uint64(1)).astype(np.int64) * times).sum()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if text is not None else ()
        if not len(found) or not self.languages:
            return "und", 0.0
        share = self.counts(found) / len(found)
        real = np.clip((share - self.false_positive) / np.maximum(1 - self.false_positive, 1e-9), 0, 1)
        best = int(np.argmax(real))
        return self.languages[best], float(real[best])


def learn(docs: DataFrame, n_slots: int = SLOTS, hashes: int = HASHES, least_share: float = LEAST_SHARE,
          least_count: int = LEAST_COUNT) -> Filters:
    """Filters from the ``text`` and ``lang`` of the given documents."""
    counts = cut(gram_counts(docs), "langid-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    languages = sorted(r.lang for r in totals.select("lang").limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    filters = Filters(languages, n_slots, hashes)
    if languages:
        number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
        kept = (counts.join(F.broadcast(totals), "lang")
                .where((F.col("n") >= least_count) & (F.col("n") >= F.col("total") * least_share))
                .select("gram", number[F.col("lang")].alias("language")))

        def place(batches):
            import pyarrow as pa

            for batch in batches:
                gram = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
                at = slots(gram, n_slots, hashes)
                language = np.tile(batch.column(1).to_numpy(zero_copy_only=False), hashes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.ravel()), pa.array((language // 64).astype(np.int64)),
                     pa.array((np.uint64(1) << (language % 64).astype(np.uint64)).astype(np.int64))],
                    ["slot", "word", "bit"])

        table = (map_arrow(kept, place, "slot bigint, word bigint, bit bigint")
                 .groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toArrow())  # at most the slots
        filters.words[table["word"].to_numpy(), table["slot"].to_numpy()] = table["bits"].to_numpy().astype(np.uint64)
    filters.fill()
    return filters


def predict(docs: DataFrame, filters: Filters, keep: list[str]) -> DataFrame:
    """``row`` (a struct of the columns to keep), ``lang_pred`` and ``score`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            found = [model.predict(text.as_py()) for text in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["row", "lang_pred", "score"])

    rows = docs.select(*row_with_text(docs, keep))
    return map_arrow(rows, run, f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Documents that never teach: crc32 of the id's text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
