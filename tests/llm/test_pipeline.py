"""The pipeline's stages on a small corpus, against plain restatements of what each must do."""

import collections
import zlib

import numpy as np
import pytest

import corpus_pipeline
from fieldquarry.llm import neardup, quality, secrets

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(where / name))
        out.append(spark.read.parquet(str(where / name)))
    return out


def test_shape(stages):
    docs = stages[0]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    for s in stages[1:-1]:
        assert s.columns == docs.columns and [f.dataType for f in s.schema] == [f.dataType for f in docs.schema]


def test_quality_drops_what_it_rejects(spark, stages):
    docs, kept = stages[0], {r.doc_id for r in stages[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert np.mean([i in kept for i in good]) > 0.97 and np.mean([i in kept for i in bad]) < 0.2
    assert kept <= {r.doc_id for r in docs.collect()}


def test_one_document_of_each_group_stays(stages):
    before, after = stages[1], {r.doc_id for r in stages[2].collect()}
    group = {r.doc_id: r.component_id for r in neardup.near_duplicates(before).collect()}
    assert after == set(group.values())


def test_no_live_secret_is_left(stages):
    left = secrets.scan_secrets(stages[3]).selectExpr("exists(spans, s -> s.kind <> 'generic' AND s.label <> 'copied') AS x").where("x").count()
    assert left == 0 and stages[3].count() == stages[2].count()


def test_mix_repeats_documents_near_targets(stages):
    from fieldquarry.llm import mixing

    words = lambda t: len((t or "").split())
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in stages[4].collect():
        taken[r.source] += words(r.text)
    order = sorted(sizes)
    want = mixing.water_fill([sizes[s] for s in order], mixing.cycle_weights(order), sum(sizes.values()), 3)
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in zip(order, want))


def test_packing_keeps_every_token(stages):
    by = collections.defaultdict(list)
    for r in stages[5].collect():
        by[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    assert sum(r.piece == 0 for r in stages[5].collect()) == stages[4].count()
    for parts in by.values():
        assert sum(n for _, n in parts) <= 4096 and sorted(o for o, _ in parts)[0] == 0


def test_empty_corpus(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
