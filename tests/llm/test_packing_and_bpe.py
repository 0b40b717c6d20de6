import hashlib
import zlib

import numpy as np
import pytest

from loglens.llm import chunk_bpe, registry, tier_packing
from loglens.llm.common import tokenizer_path
from loglens.llm.tier_packing import ids_as_u32
from loglens.llm.wordcode import WordCoder

from .util import awkward, empty, prose

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def whole(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def check_pieces(rows, ids_of):
    """Every id in exactly one piece, sequences gapless, full and of a window's length."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert 0 < r.length <= 2048
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == pieces[0].tier and at & (at - 1) == 0 and at <= 2048
    for key, lists in ids_of.items():
        pieces = sorted(by_doc[key], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == sum(len(x) for x in lists)
        if len(lists) == 1:
            at = 0
            for p in pieces:
                assert p.start == at and p.doc_tokens == len(lists[0])
                part = np.array(lists[0][p.start:p.start + p.length], "<u4").tobytes()
                assert p.ids_crc32 == zlib.crc32(part)
                at += p.length
    return by_sequence


def test_packing_is_a_partition_of_the_library_ids(spark, library):
    docs = awkward(spark)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append([*whole(library, r.text), tier_packing.END_ID])
    check_pieces(tier_packing.pack(docs).collect(), ids)


def test_packing_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id: [[*whole(library, r.text), tier_packing.END_ID]] for r in docs.collect()}
    rows = registry.op10_tier_packing(spark, "/root/testdata/sf0.001").collect()
    sequences = check_pieces(rows, ids)
    groups = {}
    for pieces in sequences.values():
        groups.setdefault(pieces[0].step_group, []).append(pieces[0].tier)
    full = [sum(g) for g in groups.values() if sum(g) == 2048 * tier_packing.WINDOWS_PER_STEP]
    assert len(full) >= len(groups) / 2


def test_packing_empty_table(spark):
    assert tier_packing.pack(empty(spark)).count() == 0


def test_packer_fills_gaps_from_shorter_tiers():
    windows = []
    p = tier_packing.Packer(lambda size, pieces: windows.append((size, pieces)), pool_windows=1)
    p.add("short", 200)
    p.add("long", 1900)
    p.add("long2", 1500)
    p.finish()
    size, pieces = windows[0]
    assert size == 2048 and [x[0] for x in pieces][:2] == ["long", "short"] or sum(x[2] for x in pieces) == size
    assert sum(x[2] for _, ps in windows for x in ps) == 3600


def test_tiers_must_double():
    with pytest.raises(ValueError):
        tier_packing.Packer(None, tiers=(256, 1024))


def test_word_coder_equals_library(library):
    coder = WordCoder(PATH, ids_as_u32, max_words=50)
    for text in ["", " ", "Don't <|endoftext|>x a<|startoftext|> 's 'S it's 12½3", "É é ΑΣ ς İ ǅ ﬁ 가나 가",
                 "a\x1cb\x1fc\x85d\xa0e　f", "!!??..--", "ß ẞ ª º µ ÷ ×", prose(1, 500), "́x ̀", "word​word"]:
        assert b"".join(coder.values(text.encode())) == ids_as_u32(whole(library, text)), text


def test_chunk_joins_agree_exactly(library):
    coder = WordCoder(PATH, ids_as_u32)
    rng = np.random.default_rng(5)
    texts = [prose(3, 3000), "x" * 9000, "你好世界" * 2000, "a b" * 100, " " * 5000, "don't<|endoftext|>" * 900]
    for text in texts:
        data = text.encode()
        cuts = [chunk_bpe.chunks(data)]
        for _ in range(5):  # any cut between characters must repair
            at = sorted({chunk_bpe._whole(data, int(x)) for x in rng.integers(1, len(data), 40)} - {len(data)})
            cuts.append([data[a:b] for a, b in zip([0, *at], [*at, len(data)])])
        for parts in cuts:
            assert b"".join(parts) == data
            made = [chunk_bpe.encode_chunk(p, coder) for p in parts]
            assert chunk_bpe.join_chunks(made, coder) == ids_as_u32(whole(library, text)), (text[:20], len(parts))


def test_chunks_are_found_again_at_other_places():
    common = prose(11, 2000).encode()
    a, b = chunk_bpe.chunks(b"start one " + common), chunk_bpe.chunks(prose(12, 300).encode() + common)
    assert len(set(a) & set(b)) > 0.7 * len(a)


def digest(library, text):
    ids = whole(library, text)
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_chunk_bpe_awkward_rows(spark, library):
    docs = awkward(spark)
    docs = docs.union(docs)  # everything is shared
    rows = chunk_bpe.encode(docs, ["doc_id", "text", "row"], finish=chunk_bpe.FinishDigest).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digest(library, r.row.text)
    for r in chunk_bpe.encode(awkward(spark), ["text"]).collect():
        assert r.ids == whole(library, r.row.text) and r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_chunk_bpe_whole_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = registry.op6_chunk_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digest(library, docs[r.doc_id])


def test_chunk_bpe_empty_table(spark):
    assert chunk_bpe.encode(empty(spark), ["doc_id"]).count() == 0
