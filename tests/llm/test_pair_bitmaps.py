"""The alignment against a brute force that encodes whole texts and compares all token ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from loglens.llm import pair_bitmaps, registry
from loglens.llm.common import tokenizer_path
from loglens.llm.wordcode import _byte_letters

from .util import awkward, empty, prose

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    """Ids and byte strings of a text's tokens in both tokenizers, or None where they do not spell it."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    letters = {letter: byte for byte, letter in _byte_letters().items()}

    def both(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                   for i in ids_b]
        want = (" " + text).encode()
        return None if b"".join(bytes_a) != want or b"".join(bytes_b) != want else (ids_a, bytes_a, ids_b, bytes_b)

    return both


def ranges(parts):
    ends = np.cumsum([len(p) for p in parts]).tolist()
    return list(zip([0, *ends], ends))


def brute(texts, tokens):
    """Rows of the contract for a list of texts."""
    aligned = []
    for text in texts:
        t = tokens(text)
        if t is None:
            aligned.append(([], [], [], []))
            continue
        ids_a, bytes_a, ids_b, bytes_b = t
        ra, rb = ranges(bytes_a), ranges(bytes_b)
        links = [(i, j) for i, (s, e) in enumerate(ra) for j, (u, v) in enumerate(rb) if s < v and u < e]
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, at = [], 0
        for end in common:
            groups.append(([ids_a[i] for i, r in enumerate(ra) if at <= r[0] < end],
                           [ids_b[j] for j, r in enumerate(rb) if at <= r[0] < end]))
            at = end
        aligned.append((ids_a, ids_b, groups, [(ids_a[i], ids_b[j]) for i, j in links]))
    counts, documents = Counter(), Counter()
    for *_, links in aligned:
        counts.update(links)
        documents.update(set(links))
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    rows = []
    for ids_a, ids_b, groups, links in aligned:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(ids_a), len(ids_b), len(groups), len(links), sum(counts[p] == top[p[1]] for p in links),
                     sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if ids_a else ""))
    return rows, counts, documents


TEXTS = [
    "plain words here", " two  leading", "tab\tand\nlines\r\n\r\nmore ", "trailing   ", " ", "\n", "\r\n", "  \t\n ", "a\xa0 b　c \x85 d",
    "x;\r y\r\nz {\r\n", "\x1c\x1d a\x1cb", "naïve ÅNGSTRÖM 你好 世界 \U0001f600 ok <|endoftext|> <s> <0x0A> don't", "bad ▁ mark", "▁",
    "\x00a", "é é ½ 5,000", "", None, "同じ 文字 が 続く", "aa" * 700, "\t\t x", "end  sep  ", "a \xa0", "q​q﻿",
]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def rows_of(df):
    return [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
            for r in sorted(df.collect(), key=lambda r: r.row.doc_id)]


def test_alignment_equals_brute_force(spark, tokens):
    texts = TEXTS + [prose(s, 60) for s in range(12)] + [prose(3, 60)] * 4
    want, counts, documents = brute(texts, tokens)
    assert rows_of(pair_bitmaps.align(docs_of(spark, texts).repartition(3), ["doc_id"])) == want
    _, postings = pair_bitmaps.index(docs_of(spark, texts).repartition(3), ["doc_id"])
    pairs = {(r.a, r.b): r for r in pair_bitmaps.pair_counts(postings).collect()}
    assert {p: r.links for p, r in pairs.items()} == dict(counts)
    assert {p: r.documents for p, r in pairs.items()} == dict(documents)
    for r in postings.collect():  # what the bitmaps hold is what the columns say
        planes = [pair_bitmaps.members(bytes(p)) for p in r.planes]
        assert len(set(np.concatenate(planes).tolist())) == r.documents
        assert sum(len(p) << i for i, p in enumerate(planes)) == r.links


def test_random_white_space(spark, tokens):
    r = random.Random(5)
    marks = list(" \t\n\r\x0b\x0c\x1c\x85\xa0  　;{a?é1") + ["word", "  ", "\r\n", "}"]
    texts = ["".join(r.choice(marks) for _ in range(r.randint(1, 25))) for _ in range(400)]
    assert rows_of(pair_bitmaps.align(docs_of(spark, texts), ["doc_id"])) == brute(texts, tokens)[0]


def test_many_blocks_and_dense_bitmaps(spark, tokens, monkeypatch):
    """Small blocks, small segments and bitmaps in the plain form give the same numbers."""
    texts = TEXTS + [prose(s % 5, 80) for s in range(30)]
    want = brute(texts, tokens)[0]

    def run(batches):
        pair_bitmaps.BLOCK_ENTRIES, pair_bitmaps.SEGMENT, pair_bitmaps.MOST_CHUNKS = 300, 40, 50
        pair_bitmaps.GATHERED_LINKS = 100
        pair_bitmaps.segments.__defaults__ = (40,)
        pair_bitmaps.Aligner.__init__.__defaults__ = (50,)
        try:
            yield from pair_bitmaps._index(PATHS, "")(batches)
        finally:
            pair_bitmaps.BLOCK_ENTRIES, pair_bitmaps.SEGMENT, pair_bitmaps.MOST_CHUNKS = 2_000_000, 1_000_000, 250_000
            pair_bitmaps.GATHERED_LINKS = 1_000_000
            pair_bitmaps.segments.__defaults__ = (1_000_000,)
            pair_bitmaps.Aligner.__init__.__defaults__ = (250_000,)

    monkeypatch.setattr(pair_bitmaps, "_index", lambda paths, row: run)
    assert rows_of(pair_bitmaps.align(docs_of(spark, texts), ["doc_id"])) == want


def test_byte_encoder_equals_the_library_on_all_given_chunks(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATHS[0])
    library.encode_special_tokens = True
    chunks = set()
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        for part in pair_bitmaps.segments(" " + (r.text or "")):
            chunks.update(part)
    chunks = sorted(chunks)
    encoder, spelled = pair_bitmaps.byte_encoder(PATHS[0])
    got = [encoder.encode_ordinary(c) for c in chunks]
    assert got == [e.ids for e in library.encode_batch(chunks, add_special_tokens=False)]
    assert all(b"".join(spelled[i] for i in ids) == c.encode() for ids, c in zip(got, chunks))


def test_bitmaps_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 100, 4095, 4096, 60_000, 65_536):
        documents = np.sort(r.choice(65_536, n, replace=False))
        data = pair_bitmaps.container(documents)
        assert len(data) == min(2 * n, 8192) and (pair_bitmaps.members(data) == documents).all()


def test_dense_postings_are_read_back(spark):
    """A pair in more documents than a list of numbers is worth: plain bitmaps, also with multiplicities."""
    texts = ["a a" if i % 3 else "a b a" for i in range(9000)]
    rows = pair_bitmaps.align(docs_of(spark, texts).coalesce(1), ["doc_id"])
    got = {r.row.doc_id: (r.n_links, r.n_best, r.count_sum) for r in rows.collect()}
    for i in (0, 1, 2, 8999):
        n_a, n_b = 18000, 3000
        want = (2, 2, 2 * n_a) if i % 3 else (3, 3, 2 * n_a + n_b)
        assert got[i] == want


def test_awkward_and_empty(spark, tokens):
    docs = awkward(spark)
    texts = [r.text for r in docs.collect()]
    short = [t for t in texts if t is None or len(t) < 1000]
    got = pair_bitmaps.align(docs, keep=docs.columns).select("row.*", "n_a", "n_b", "n_links").collect()
    assert len(got) == len(texts)
    for r in got:
        t = tokens(r.text)
        assert (r.n_a, r.n_b) == ((len(t[0]), len(t[2])) if t else (0, 0))
    assert len(short) > 5
    assert pair_bitmaps.align(empty(spark), ["doc_id"]).collect() == []


def test_query_on_the_given_documents(spark, tokens):
    got = {r.doc_id: tuple(r)[1:] for r in registry.op13_pair_bitmaps(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        t = tokens(r.text)
        n_a, n_b, n_groups, n_links, *_ = got[r.doc_id]
        if t is None:
            assert got[r.doc_id] == (0, 0, 0, 0, 0, 0, "")
            continue
        assert (n_a, n_b) == (len(t[0]), len(t[2]))
        ends = {e for _, e in ranges(t[1])} & {e for _, e in ranges(t[3])}
        assert n_groups == len(ends) and n_links == n_a + n_b - n_groups
