"""The registered queries of the subpackage and the pipeline, at the smallest scale."""

import collections

import pytest

import corpus_pipeline
from inspectlake.llm import queries, secrets

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = [name for name in queries.queries() if name.startswith("op")]
    assert sorted(int(name[2:].split("_")[0]) for name in names) == list(range(1, 14))
    assert "pipeline" in queries.queries() and set(queries.oracle_sql()) <= set(queries.queries())


def test_language_is_right_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang").collect()}
    out = queries.op3_language_id(spark, SF_DIR).collect()
    held = [r for r in out if r.held_out and truth[r.doc_id]]
    assert len(out) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_pipeline_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, kept[-1], SF_DIR)
        assert out.columns == columns, name
        kept.append(spark.createDataFrame(out.collect(), docs.schema))
    found, single, clean, mixed = ([r.asDict() for r in frame.collect()] for frame in kept[1:])
    ids = lambda rows: collections.Counter(r["doc_id"] for r in rows)
    assert set(ids(single)) <= set(ids(found)) and max(ids(single).values()) == 1
    assert ids(clean) == ids(single) and not any(secrets.find(r["text"]) for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in clean)
    assert max(ids(mixed).values()) == 2 and set(ids(mixed)) <= set(ids(clean))
    bins = corpus_pipeline.best_fit_packing(spark, kept[-1], SF_DIR).collect()
    assert sum(r.length for r in bins) == sum(len(r["text"].encode().split()) for r in mixed)


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None), (None, "a b c", None, None, 5), (2, "", "en", "s", 0)]])
def test_pipeline_on_empty_and_awkward_documents(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 2
