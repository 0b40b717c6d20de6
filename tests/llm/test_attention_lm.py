"""Counts against brute force; the model against slow formulas, finite differences and held-out texts."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglens.llm import attention_lm as lm
from loglens.llm import registry
from loglens.llm.common import tokenizer_path
from loglens.llm.wordcode import WordCoder

from .util import awkward, empty, prose

BEGIN, END = 49406, 49407


@pytest.fixture(scope="module")
def coder():
    return WordCoder(tokenizer_path("word_bpe_49k.json"), tuple)


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def brute_base(rows):
    """doc -> (n_tokens, n_known, train_tokens, base_score) from (doc, text, learns) rows, in their order."""
    counts = Counter()
    for _, text, learns in rows:
        if learns:
            counts.update([*words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text, _ in rows:
        tokens = [*words_of(text), None]
        out.append((doc, len(tokens), sum(t in counts for t in tokens), n,
                    sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens)))
    return out


def slow(flat, classes, ids):
    """Natural log probability of every id, one at a time."""
    m = {k: v.astype(np.float64) for k, v in lm.unpack(flat).items()}
    inputs = [BEGIN, *ids[:-1]]
    out = []
    for t, i in enumerate(ids):
        top = 0 if t < lm.WINDOW else lm.HOP * math.ceil((t - lm.WINDOW + 1) / lm.HOP)
        x = np.array([m["E"][classes.input[inputs[j]]] + m["P"][j - top] for j in range(top, t + 1)])
        q, k, v = (x @ m["Q"][:, a * lm.WIDTH:(a + 1) * lm.WIDTH] for a in range(3))
        w = np.exp(q[-1] @ k.T / math.sqrt(lm.WIDTH))
        state = x[-1] + (w / w.sum()) @ v @ m["O"]
        hidden = np.maximum(state @ m["H"] + m["h"], 0)
        group, inner = divmod(int(classes.of[i]), lm.MEMBERS)
        top, low = np.exp(hidden @ m["U"] + m["u"]), np.exp(hidden @ m["V"][group] + m["v"][group])
        out.append(np.log(top[group] / top.sum()) + np.log(low[inner] / low.sum()) + classes.member[i])
    return np.array(out)


def some_model(ids, seed=3):
    classes = lm.Classes(np.bincount(ids, minlength=49408).astype(np.int64))
    flat = lm.initial(classes)
    return classes, flat + np.random.default_rng(seed).standard_normal(len(flat)).astype(np.float32) * np.float32(0.2)


def test_gradient_against_finite_differences():
    r = np.random.default_rng(0)
    classes, flat = some_model(r.integers(0, 49408, 5000))
    flat = flat.astype(np.float64)
    inputs = r.integers(0, 40, (5, lm.WINDOW)).astype(np.int32)
    targets, real = r.integers(0, lm.SINGLES + lm.SHARED, inputs.shape), r.random(inputs.shape) < 0.8
    g, loss = lm.gradient(flat, inputs, targets, real)
    at = 0
    for name, shape in lm.shapes().items():
        size = int(np.prod(shape))
        for i in r.choice(40 * lm.WIDTH if name == "E" else size, 12):
            moved = flat.copy()
            moved[at + i] += 1e-6
            up = lm.gradient(moved, inputs, targets, real)[1]
            moved[at + i] -= 2e-6
            down = lm.gradient(moved, inputs, targets, real)[1]
            assert g[at + i] == pytest.approx((up - down) / 2e-6, rel=2e-3, abs=2e-5), name
        at += size
    assert loss > 0


@pytest.mark.parametrize("n", [1, 2, 23, 24, 25, 40, 41, 57, 300])
def test_each_id_is_scored_once_and_as_the_slow_formula_does(n):
    r = np.random.default_rng(n)
    ids = r.integers(0, 300, n).astype(np.uint16)
    classes, flat = some_model(ids)
    nothing = np.zeros(0, np.uint16)
    want = slow(flat, classes, ids.tolist())
    got, part = lm.log_probabilities(flat, classes, [(0, nothing, ids), (0, nothing, ids[:1]), (0, nothing, ids)], BEGIN)
    assert got[:n] == pytest.approx(want, abs=1e-4) and got[n + 1:] == pytest.approx(want, abs=1e-4)
    assert np.bincount(part).tolist() == [n, 1, n]
    # a text in parts has the scores of the whole text
    for cut in sorted({1, n // 2, n - 1} & set(range(1, n))):
        before = ids[:cut][-lm.WINDOW:]
        got, _ = lm.log_probabilities(flat, classes, [(0, nothing, ids[:cut]), (cut, before, ids[cut:])], BEGIN)
        assert got == pytest.approx(want, abs=1e-4)


def test_probabilities_of_all_ids_sum_to_one():
    r = np.random.default_rng(1)
    ids = r.integers(0, 500, 40).astype(np.uint16)
    classes, flat = some_model(ids)
    nothing = np.zeros(0, np.uint16)
    total = 0.0
    for lo in range(0, 49408, 8000):
        parts = [(0, nothing, np.r_[ids[:30], np.uint16(i)]) for i in range(lo, min(lo + 8000, 49408))]
        got, _ = lm.log_probabilities(flat, classes, parts, BEGIN)
        total += float(np.exp(got[30::31]).sum())
    assert total == pytest.approx(1.0, abs=1e-3)


def test_training_windows_hold_every_id_once():
    r = np.random.default_rng(2)
    parts = [(0, np.zeros(0, np.uint16), r.integers(0, 99, n).astype(np.uint16)) for n in (1, 24, 25, 100)]
    classes, _ = some_model(parts[-1][2])
    inputs, window, place, part = lm.windows(parts, classes, BEGIN, lm.WINDOW)
    assert len(set(zip(window.tolist(), place.tolist()))) == len(window) == 150
    ids = np.concatenate([p[2] for p in parts])
    inside = place > 0
    assert (inputs[window, place][inside] == classes.input[np.r_[0, ids[:-1]][inside]]).all()


def test_segments_hold_all_words():
    data = prose(4, 3000).encode() + b"\n"
    for size in (1, 10, 1000, 10**6):
        assert sum(lm.segments(data, size), []) == data.split()
    assert list(lm.segments(b"")) == [[]]


def test_base_equals_brute_force_on_awkward_rows(spark):
    docs = awkward(spark).coalesce(1)
    rows = [(r.uid, r.doc_id, r.text) for r in docs.select("uid", "doc_id", "text").collect()]
    learns = F.col("doc_id") % 2 == 1
    got = lm.score(docs, learns, keep=docs.columns)
    got = sorted(((r.row.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got.collect()), key=repr)
    want = sorted(brute_base([(d, t, d is not None and d % 2 == 1) for _, d, t in rows]), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in want], rel=1e-9)


def test_small_blocks_and_parts_give_the_same_counts(spark):
    docs = spark.createDataFrame([(i, prose(i % 7, 50 + 30 * i)) for i in range(20)], "doc_id bigint, text string").repartition(2)
    path = tokenizer_path("word_bpe_49k.json")

    def read(size, most):
        def run(batches):
            lm.BLOCK_WORDS, lm.segments.__defaults__ = most, (size,)
            try:
                yield from lm._read(path, END, names, 49408)(batches)
            finally:
                lm.BLOCK_WORDS, lm.segments.__defaults__ = 3_000_000, (1_000_000,)

        return run

    names = [f.split()[0] for f in lm._FIELDS.format(row="x").split(", ")]
    rows = docs.select(F.struct("doc_id").alias("row"), F.lit(True).alias("learn"), "text")
    schema = lm._FIELDS.format(row="struct<doc_id:bigint>")
    whole, cut = (rows.mapInArrow(read(*how), schema).toPandas() for how in ((10**6, 10**6), (60, 40)))

    def ids_of(t):
        t = t[t.uid.notna()].sort_values(["uid", "part"])
        assert (t.groupby("uid")["last"].sum() == 1).all()
        return {k: b"".join(map(bytes, g["ids"])) for k, g in t.groupby("uid")}, t

    (a, _), (b, parts) = ids_of(whole), ids_of(cut)
    assert a == b and len(parts) > 40
    for _, g in parts.groupby("uid"):
        done = np.zeros(0, np.uint16)
        for start, before, ids in zip(g["start"], g["before"], g["ids"]):
            assert start == len(done) and bytes(before) == done[-lm.WINDOW:].tobytes()
            done = np.r_[done, np.frombuffer(ids, np.uint16)]
    for t in (whole, cut):
        counts = t[t.word.notna()].groupby("word")["n"].sum().to_dict()
        assert counts == Counter(w for r in docs.collect() for w in words_of(r.text))


def test_many_words_have_the_ids_of_single_words(coder):
    r = np.random.default_rng(6)
    words = ["don't", "5,000½", "naïve", "ÅNGSTRÖM", "<|endoftext|>", "x<|y", "你好", "\xa0", "a\xa0b", "''s's", "!?", "é", "é"]
    words += ["".join(r.choice(list("abé'5,.<|ßÜ'sreve"), r.integers(1, 9))) for _ in range(3000)]
    words = [w.encode() for w in dict.fromkeys(words)]
    assert coder.ids_of(words) == [coder.ids(w.decode()) for w in words]
    assert coder.ids_of([]) == []
    numbers = r.integers(0, 2**32, 1000).astype(np.uint32)
    assert (lm.unpacked(lm.packed(numbers)) == numbers).all() and len(lm.unpacked(lm.packed(numbers[:0]))) == 0


def test_empty_table_and_no_teachers(spark):
    assert lm.score(empty(spark), F.lit(True), ["doc_id"]).collect() == []
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    got = {r.row.doc_id: r for r in lm.score(docs, F.lit(False), ["doc_id"]).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[2].n_tokens) == (3, 0, 0, 1)
    assert got[1].base_score == pytest.approx(0.0) and got[1].score < got[2].score < 0


def test_query_on_the_given_documents(spark, coder):
    """Base figures exactly; the model must know more than the counts on texts that it has not seen."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in registry.op11_attention_lm(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    learns = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows}
    for d, n_tokens, n_known, n, base in brute_base([(d, t, learns[d]) for d, t in rows]):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns[d], n_tokens, n_known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    ids = {d: [i for w in words_of(t) for i in coder.ids(w)] + [END] for d, t in rows}
    counts = np.zeros(49408)
    for d, x in ids.items():
        if learns[d]:
            np.add.at(counts, x, 1)
    unigram = np.log10((counts + 0.1) / (counts + 0.1).sum())
    unseen = [d for d, _ in rows if not learns[d]]
    model, plain = sum(got[d].score for d in unseen), sum(unigram[ids[d]].sum() for d in unseen)
    assert model > 0.93 * plain  # both negative; the base is no yardstick: it leaves unseen words no room to be spelled


def test_words_of_many_texts_are_looked_up_together(coder):
    """New words are cut and encoded once a chunk, not once a text, and each has the ids that it has alone."""
    words = lm.Words(coder)
    calls, encode = [], coder.flat_ids
    rows = pa.RecordBatch.from_arrays(
        [pa.StructArray.from_arrays([pa.array(range(300))], ["doc_id"]), pa.array([i % 3 > 0 for i in range(300)]),
         pa.array([prose(i, 20 + i % 50) + " 你好 naïve" * (i % 2) for i in range(300)])], ["row", "learn", "text"])
    coder.flat_ids = lambda some: calls.append(len(some)) or encode(some)
    try:
        texts = [t.encode().lower().split() for t in rows.column(2).to_pylist()]
        numbers = words.numbers(sum(texts, []), np.repeat(rows.column(1).to_pylist(), [len(t) for t in texts]))
    finally:
        del coder.flat_ids
    assert calls == [len(words.number)]
    assert words.ids(numbers).tolist() == [i for t in texts for w in t for i in coder.ids(w.decode())]
    names = [f.split()[0] for f in lm._FIELDS.format(row="x").split(", ")]
    asked, looked = [], lm.Words.numbers
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 0})())
        patch.setattr(lm.Words, "numbers", lambda self, *a: asked.append(1) or looked(self, *a))
        parts = [r for b in lm._read(tokenizer_path("word_bpe_49k.json"), END, names, 49408)(iter([rows])) for r in b.to_pylist() if r["uid"] is not None]
    assert len(asked) == 1 and [r["row"]["doc_id"] for r in parts] == list(range(300))
    for r, t in zip(parts, texts):
        assert np.frombuffer(r["ids"], np.uint16).tolist() == [i for w in t for i in coder.ids(w.decode())] + [END]


def test_a_word_window_needs_one_order(spark):
    """The words' counts and their first blocks come from one sort by the word."""
    docs = spark.createDataFrame([(i, prose(i, 30)) for i in range(20)], "doc_id bigint, text string")
    plans, cut = [], lm.cut
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm, "cut", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or cut(df, name))
        lm.score(docs, F.lit(True), ["doc_id"]).collect()
    assert dict(plans)["lm-words"].count("Window [") == 1
