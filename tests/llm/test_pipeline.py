"""The pipeline's stages on small documents with planted cases, each against a plain version of its rule."""

from __future__ import annotations

from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_llm_operators import contaminated_brute, prose
from tramaline.llm.simhash import simhash
from tramaline.session import table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    good = [(i, prose(2000 + i, 70)) for i in range(300)]
    bad = [(400 + i, prose(2400 + i, 20) + " rotten vilest" * 6 + " " + prose(2500 + i, 20)) for i in range(80)]
    item = prose(3000, 40)
    planted = [(600, good[0][1]), (601, good[1][1] + " tail"), (602, "start " + item + " end"), (603, prose(3002, 70) + " password=abcdef123456"), (604, None), (605, ""), (None, prose(3001, 30))]
    docs = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in [*good, *bad, *planted]]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good[:200]] + [(i, 0, 1) for i, _ in bad[:60]]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "too few")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_duplicates", "decontamination", "secrets", "mixing"]
    docs = table(spark, folder, "documents")
    items = [tuple(r) for r in table(spark, folder, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), None if k == 4 else docs.schema)
        after = docs.collect()
        ids = [r.doc_id for r in after]
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality_classifier":
            assert not [i for i in ids if i is not None and 400 <= i < 480]
            assert sum(i is not None and i < 300 for i in ids) >= 295
        if name == "near_duplicates":
            prints = {r.doc_id: simhash((r.text or "").encode()) for r in before if r.doc_id is not None}
            near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2
            kept = [i for i in ids if i is not None]
            assert all(any(near(i, j) for j in prints if j < i) for i in set(prints) - set(kept))
            assert not any(near(i, j) for i in kept for j in kept if i < j)
            assert 600 not in ids and 0 in ids and None in ids
        if name == "decontamination":
            assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in before if not contaminated_brute(r.text, items)[-1])
            assert 602 not in ids
        if name == "secrets":
            assert len(after) == len(before)
            text = {r.doc_id: r.text for r in after}
            changed = [r.doc_id for r in before if r.text != text[r.doc_id]]
            assert changed == [603] and text[603].endswith(" [ASSIGN]")
        if name == "mixing":
            n = Counter(r.doc_id for r in after)
            assert set(n) <= {r.doc_id for r in before} and all(r.n_copies == n[r.doc_id] for r in after)
    assert corpus_pipeline.run(spark, folder).count() == len(after)
