"""The pipeline's stages on a small corpus, each against what its operator says alone."""

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, tmp_path):
    prose = lambda seed, n=80: " ".join(f"word{(seed * 31 + i * 17) % 977}" for i in range(n)) + "."
    texts = [prose(k) + "\n" + prose(k + 500) for k in range(12)]
    texts += [texts[0], texts[1].replace("word31", "other"), "short text.", "A | B | C\n" * 80, None, prose(77) + "\n" + texts[2].split("\n")[0]]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    return rows


def test_stages(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = [r.doc_id for r in docs.collect()]
    assert set(kept["quality rules"]) == {*range(14), 17}
    assert 12 not in kept["line dedup"] and 17 in kept["line dedup"]  # a whole copy goes, a partial one stays
    assert set(kept["simhash near-dedup"]) <= set(kept["line dedup"])
    assert set(kept["mixing"]) <= set(kept["simhash near-dedup"]) and max(map(kept["mixing"].count, kept["mixing"])) <= 2
    assert sorted(kept["bpe"]) == sorted(kept["mixing"])
    texts = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "line dedup")).collect()}
    assert texts[17].text == rows[17][1].split("\n")[0] and texts[17].n_chars == len(texts[17].text)
    ran = sorted((r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert ran == sorted((r.doc_id, r.ids_sha256) for r in docs.collect())


def test_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
