import zlib

import numpy as np

from vidcohort.llm import langid as li


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = li.op10_langid(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and len(held) > 100
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_products_equal_the_vectors_cosine(spark):
    """The product table gives the dot product of bundled vectors."""
    df = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de")], "doc_id long, text string, lang string")
    langs, place, table = li.train(df)
    letters = li.letter_vectors()
    _, tri, n = li.trigram_counts(["the hund"])
    known = np.abs(table[place[tri]]).sum(axis=1) > 0
    vector = (li.bound(tri[known], letters).astype(float) * n[known, None]).sum(axis=0)
    own = []
    for lang in langs:
        _, t, c = li.trigram_counts([r.text for r in df.collect() if r.lang == lang])
        p = (li.bound(t, letters).astype(float) * c[:, None]).sum(axis=0)
        own.append(vector @ p / np.linalg.norm(p) / np.sqrt(li.DIMS))
    assert np.allclose(own, (n[:, None] * table[place[tri]]).sum(axis=0), rtol=1e-3)


def test_query_against_whole_vectors(spark):
    """Every document against bundles of all its trigram vectors, without the shortcuts of the query."""
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    letters = li.letter_vectors()

    def bundle(text):
        _, tri, n = li.trigram_counts([text])
        return (li.bound(tri, letters).astype(np.float32) * n[:, None].astype(np.float32)).sum(axis=0)

    vectors = {i: bundle(r.text) for i, r in docs.items() if r.text is not None}
    prototypes = {}
    for i, r in docs.items():
        if r.text is not None and r.lang is not None and zlib.crc32(str(i).encode()) % 5:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + vectors[i]
    got = {r.doc_id: r for r in li.op10_langid(spark, sf).collect()}
    assert got.keys() == docs.keys()
    same = []
    for i, r in docs.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cosine = {k: vectors[i] @ p / np.linalg.norm(vectors[i]) / np.linalg.norm(p) for k, p in prototypes.items()}
        same.append(got[i].lang_pred == max(cosine, key=cosine.get))
        assert abs(got[i].score - max(cosine.values())) < 0.05
    assert np.mean(same) > 0.99


def test_long_repeated_and_null_rows_of_the_query(spark, tmp_path):
    rows = [(1, "the cat and the dog " * 50_000, "en"), (2, "el gato y el perro", "es"), (2, "el gato y el perro", "es"), (None, "the dog", "en"), (2**60 + 1, "the cat", None)]
    rows += [(k, "the cat and the dog", "en") for k in range(10, 20)] + [(k, "el gato y el perro", "es") for k in range(20, 30)]
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "doc_id long, text string, lang string, lang_pred string, held_out boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id or 0, r.lang_pred, r.held_out) for r in li.op10_langid(spark, str(tmp_path)).collect() if (r.doc_id or 0) not in range(10, 30))
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert got == [(0, "en", None), (1, "en", fold(1)), (2, "es", fold(2)), (2, "es", fold(2)), (2**60 + 1, "en", fold(2**60 + 1))]


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?", None), (4, "the cat", "en"), (5, "el gato ñ", "es"), (6, "The CAT", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    predict = li.language(spark, li.train(df))
    got = {r.doc_id: r.p for r in df.select("doc_id", predict("text").alias("p")).collect()}
    assert [got[i].lang for i in range(1, 7)] == ["und", "und", "und", "en", "es", "en"]
    assert got[1].score == 0
    nothing = li.language(spark, li.train(df.limit(0)))
    assert {r.p.lang for r in df.select(nothing("text").alias("p")).collect()} == {"und"}
    kept = li.keep_identified(spark, df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6}


def test_the_pipeline_learns_from_all_rows(spark):
    """op10 holds a fold out; the pipeline does not, so that rows of that fold, or without an id, are enough to tell a language."""
    import zlib

    held_out = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5 == 0][:3]
    for ids in (held_out, [None] * 3):
        rows = [(ids[0], "a text", "en"), (ids[1], "ein Text", "de"), (ids[2], "12 34", "en")]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert sorted(r.text for r in li.keep_identified(spark, df).collect()) == ["a text", "ein Text"]
