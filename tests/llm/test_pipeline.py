import hashlib

import corpus_pipeline
from quillstream.llm.common import written

from .test_llm import TEXTS, docs, prose


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs(spark, TEXTS).drop("kept").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # No letters: 0, 1, 8. Equal texts: 3, 4, 5, of which 5 stays. 6 is near 5. The mixture takes 8/10 of one leaf.
    left = sorted((2, 5, 7, 9), key=lambda i: hashlib.md5(f"17:0:{i}".encode()).hexdigest())
    size = {i: len(TEXTS[i].split()) for i in left}
    budget, at, want = sum(size.values()) * 8 // 10, 0, set()
    for i in left:
        if at < budget:
            want.add(i)
        at += size[i]
    assert got == want


def through(spark, rows, *stages):
    """rows of (doc_id, text, lang, source) after the named stages."""
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        if name in stages:
            docs = written(stage(spark, docs, ""), "t")
    return docs


def test_rows_without_or_with_repeated_doc_id(spark):
    a, b, c, d, e = (prose(200, k) for k in range(5))
    near_c = c + " " + prose(3, 9)
    said = [(None, a), (None, a), (None, b), (1, b), (2, c), (2, c), (None, near_c), (3, d), (3, e), (None, prose(200, 7))]
    rows = [(i, t, "en", "src1") for i, t in [*said, *((k, prose(50, k)) for k in range(100, 112))]]
    got = sorted((r.doc_id or 0, r.text) for r in through(spark, rows, "language ID", "exact dedup", "MinHash near-dedup").collect() if (r.doc_id or 0) < 100)
    assert got == sorted([(0, a), (1, b), (2, c), (3, d), (3, e), (0, prose(200, 7))])


def test_language_stage_without_a_model(spark):
    rows = [(k, t, None, "src1") for k, t in enumerate(["Ein Text", "été", "12", "", None])]
    assert [(r.doc_id, r.lang) for r in sorted(through(spark, rows, "language ID").collect())] == [(0, None), (1, None)]


def test_language_stage_uses_the_prediction(spark):
    en, de = ("the cat and the dog of this house " * 9, "der hund und die katze aus dem haus " * 9)
    rows = [(k, (en, de)[k % 2] + str(k), ("en", "de")[k % 2], "src1") for k in range(80)]
    rows += [(100, en, "de", "src1"), (101, de, None, "src1"), (None, de, None, "src1")]
    got = {r.doc_id: r.lang for r in through(spark, rows, "language ID").collect()}
    assert len(got) == 83 and (got[100], got[101], got[None]) == ("en", "de", "de")


def test_mixture_cuts_the_last_document(spark):
    texts = {k: (" \n" if k % 2 else "") + "\t ".join(f"é{k}w{j}" for j in range(10 * k + 7)) + " " for k in range(8)}
    rows = [(k, t, "en", f"src{k % 3}") for k, t in texts.items()]
    got = {r.doc_id: r.text for r in through(spark, rows, "language ID", "mixing").collect()}
    total = sum(len(t.split()) for t in texts.values())
    assert sum(len(t.split()) for t in got.values()) == total * 8 // 10
    assert all(texts[k].startswith(t) and (t == texts[k] or not t[-1].isspace()) for k, t in got.items())
    assert any(t != texts[k] for k, t in got.items())


def test_extra_columns_with_clashing_names_and_no_rows(spark, tmp_path):
    names = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, held_out boolean, letters int, ambiguous string, keep_id long, kept string, __id long, tokens_taken long, n_tokens long, component_id string"
    texts = [prose(60, k) for k in range(12)] + [prose(60, 0)]
    rows = [(k, t, "en", "src1", len(t), "x", 1.0, True, 1, "a", 5, "k", 9, 1, 2, "c") for k, t in enumerate(texts)]
    for some in (rows, []):
        path = f"{tmp_path}/{len(some)}"
        spark.createDataFrame(some, names).write.parquet(f"{path}/documents.parquet")
        got = corpus_pipeline.run(spark, path)
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (got.count() > 0) == bool(some) and (0 not in {r.doc_id for r in got.collect()})
