import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loglens.llm import dart_minhash, tier_packing
from loglens.llm.common import cut, table, tokenizer_path

from .test_joins import brute_groups
from .test_text_operators import brute_rules, brute_spans

DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage's rows follow from its own input; the last one packs exactly the fourth one's texts."""
    from tokenizers import Tokenizer

    docs = table(spark, DIR, "documents")
    columns, held = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        held.append({r.doc_id: r for r in docs.collect()})
        docs = cut(stage(spark, docs, DIR), f"test-{name}")
        if name != "packing":
            assert docs.columns == columns
    everything, ruled, good, single, clean = held
    assert set(everything) > set(ruled) >= set(good) > set(single) == set(clean)
    assert not any(brute_rules(r.text or "")[5] for r in ruled.values())
    groups = brute_groups([(i, r.text) for i, r in good.items()])
    assert set(single) == {i for i, head in groups.items() if i == head}
    for i, r in clean.items():
        assert not brute_spans(r.text or "") and (r.text == single[i].text or brute_spans(single[i].text) or "[" in r.text)
    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    pieces: dict = {}
    for r in docs.collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(clean)
    for i, r in clean.items():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, tier_packing.END_ID]
        at = 0
        for p in sorted(pieces[i], key=lambda p: p.start):
            assert p.start == at and p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_toxic_labels_decide(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    kept = cut(corpus_pipeline.quality_classifier(spark, docs, "/root/testdata/sf0.01"), "test-kept").select("doc_id", F.lit(True).alias("kept"))
    labels = table(spark, "/root/testdata/sf0.01", "labels").join(kept, "doc_id", "left").fillna(False, ["kept"])
    sums = {r.toxic: (r.n, r.k) for r in labels.where("quality = 1 or toxic = 1").groupBy("toxic").agg(
        F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k")).collect()}
    assert sums[1][1] <= 0.05 * sums[1][0] and sums[0][1] >= 0.95 * sums[0][0]


def test_toxic_labels_decide_in_each_language(spark):
    path = "/root/testdata/sf0.1"
    docs = table(spark, path, "documents")
    kept = cut(corpus_pipeline.quality_classifier(spark, docs, path), "test-kept").select("doc_id", F.lit(1).alias("kept"))
    labels = table(spark, path, "labels").join(docs.select("doc_id", "lang"), "doc_id").join(kept, "doc_id", "left").fillna(0, ["kept"])
    sums = {(r.lang, r.toxic): r.kept for r in labels.where("quality = 1 or toxic = 1").groupBy("lang", "toxic").agg(F.avg("kept").alias("kept")).collect()}
    assert len(sums) == 8 and all(kept <= 0.05 if toxic else kept >= 0.95 for (_, toxic), kept in sums.items()), sums


#: Insults planted in the toxic documents of the table.
INSULTS = ["idiot", "loser", "trash", "pathetic", "worthless", "moron", "scum", "clown"]


def test_toxic_texts_go_and_clean_ones_stay(spark):
    """Some labels are wrong (plain prose labelled toxic), so toxic texts are told by their words."""
    path = "/root/testdata/sf0.01"
    docs = table(spark, path, "documents")
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, docs, path).select("doc_id").collect()}
    labels = {r.doc_id: r for r in table(spark, path, "labels").collect()}
    insults = {r.doc_id: len({w.strip(".,!?") for w in (r.text or "").lower().split()} & set(INSULTS)) for r in docs.collect()}
    toxic = {i for i, n in insults.items() if n >= 2}
    clean = {i for i, r in labels.items() if r.quality == 1 and r.toxic == 0 and insults.get(i) == 0}
    assert len(toxic) > 20 and len(toxic & kept) <= 0.05 * len(toxic)
    assert len(clean & kept) >= 0.95 * len(clean)


def test_no_documents(spark, scratch):
    path = f"{scratch}/none"
    table(spark, DIR, "documents").limit(0).write.parquet(f"{path}/documents.parquet")
    table(spark, DIR, "labels").limit(0).write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
    assert dart_minhash.representatives(table(spark, path, "documents")).count() == 0
