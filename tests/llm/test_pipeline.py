"""The pipeline's stages against brute force on their own inputs."""

import pytest

import corpus_pipeline
from lamina.llm import toxicity
from lamina.llm.common import Scratch, table
from test_operators import brute_components, slow_fingerprint, slow_hits


def test_stages(spark, small):
    scratch = Scratch(spark)
    docs = table(spark, small, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = scratch.keep(stage(spark, docs, small))
        kept[name] = before, {r.doc_id for r in out.collect()}
        if name != "byte_bpe":
            assert out.columns == columns
            docs = out
    before, after = kept["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity.score(table(spark, small, "documents"), toxicity.learn(table(spark, small, "documents"), table(spark, small, "labels"))).collect()}
    assert after == {i for i in before if scores[i] < 0.5}
    before, after = kept["exact_dedup"]
    best = {}
    for i, t in before.items():
        key = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), i))
    assert after == {i for _, i in best.values()}
    before, after = kept["simhash_dedup"]
    ids = sorted(before)
    assert after == {ids[i] for i in brute_components([slow_fingerprint(before[i]) for i in ids])}
    before, after = kept["decontaminate"]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    assert after == {i for i, t in before.items() if not slow_hits(t, items)[3]}
    assert kept["byte_bpe"][1] == after


def odd_documents(spark):
    """Null and empty texts, a null id, rows that repeat whole, a toxic one, and columns named as the stages name theirs."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron"
    texts = [(1, None), (2, ""), (3, " \n"), (4, "one two three four five six"), (4, "one two three four five six"), (5, "one two three  four five six"), (6, item), (7, item + " rho " * 400), (None, "the null id"), (8, "word " * 3000), (9, "One two three four five six")]
    return spark.createDataFrame([(i, t, "r", i, "f") for i, t in texts], "doc_id long, text string, __row string, row long, fp string"), spark.createDataFrame([(1, item), (None, "tau"), (2, None), (3, "")], "item_id long, text string")


def written(spark, tmp_path, name, df):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_odd_rows_and_empty_tables(spark, tmp_path, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs, items = odd_documents(spark)
    written(spark, tmp_path, "benchmark", items)
    written(spark, tmp_path, "labels", spark.createDataFrame([(4, 0), (8, 1), (None, 1)], "doc_id long, toxic int"))
    rows = [tuple(r) for r in docs.collect()]
    got = stage(spark, docs, str(tmp_path))
    if name == "byte_bpe":
        assert sorted(got.columns) == sorted(["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) and got.count() == len(rows)
    else:
        assert got.columns == docs.columns
        kept = sorted((r.doc_id or 0, r.text or "") for r in got.collect())
        ids = [i for i, _ in kept]
        if name == "toxicity":
            assert set(tuple(r) for r in got.collect()) <= set(rows) and ids.count(4) in (0, 2)  # repeated rows alike
        elif name == "exact_dedup":  # of 1, 2 and 3 the one with most code points; of 4, 4 and 5 the longest
            assert ids == [0, 3, 5, 6, 7, 8, 9]
        elif name == "simhash_dedup":  # 1, 2 and 3 have no words; words in lower case of 4, 4, 5 and 9 are the same
            assert ids == [0, 1, 4, 6, 7, 8]
        elif name == "decontaminate":  # 7 holds the item too, but under a twentieth of its words
            assert ids == [0, 1, 2, 3, 4, 4, 5, 7, 8, 9]
    empty = stage(spark, docs.limit(0), str(tmp_path))
    assert empty.count() == 0
    none = tmp_path / "none"
    written(spark, none, "benchmark", items.limit(0))
    written(spark, none, "labels", spark.createDataFrame([], "doc_id long, toxic int"))
    if name in ("toxicity", "decontaminate"):
        assert stage(spark, docs, str(none)).count() == len(rows)


def test_the_pipeline_of_an_odd_table(spark, tmp_path):
    docs, items = odd_documents(spark)
    written(spark, tmp_path, "documents", docs)
    written(spark, tmp_path, "benchmark", items)
    written(spark, tmp_path, "labels", spark.createDataFrame([(4, 0)], "doc_id long, toxic int"))
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == [0, 3, 5, 7, 8]
