import corpus_pipeline as p
from sluice.llm import decontaminate, line_dedup, ngram_join

from texts import ITEM, prose


def test_stages_in_order_and_their_effects(spark, make_docs, rnd, tmp_path):
    shared = "\n".join(prose(rnd, 20) for _ in range(3))
    rows = [(i, prose(rnd, rnd.randint(60, 160)), "en", "a") for i in range(100)]
    rows += [(200, prose(rnd, 70) + "\n" + shared, "en", "a"), (201, prose(rnd, 70) + "\n" + shared, "en", "a")]
    rows += [(300, rows[5][1], "en", "a"), (301, rows[5][1].replace(rows[5][1].split()[0], "Changed", 1), "en", "a")]
    rows += [(400, prose(rnd, 60) + " " + ITEM, "en", "a"), (500, "too short", "en", "a"), (501, None, "en", "a")]
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(r["doc_id"] for r in p.run(spark, str(tmp_path)).collect())
    assert got == [*range(100), 200, 201]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    lines = p.line_stage(spark, docs, str(tmp_path))
    assert lines.columns == docs.columns
    after = {r["doc_id"]: r for r in lines.collect()}
    assert shared in after[200]["text"] and shared not in after[201]["text"]
    assert after[201]["n_chars"] == len(after[201]["text"])


def test_every_stage_takes_odd_rows_and_no_rows(spark, make_docs, odd_rows, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (make_docs(odd_rows), make_docs(odd_rows).limit(0)):
        for _, stage in p.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= docs.count()
        assert p.token_stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_columns_with_names_used_inside_keep_their_values(spark, rnd, tmp_path):
    docs = spark.createDataFrame([(1, prose(rnd, 30), 77, 5), (2, None, 78, 6)], "doc_id long, text string, _n_lines int, _n_removed int")
    got = sorted(tuple(r)[2:] for r in p.line_stage(spark, docs, str(tmp_path)).collect())
    assert got == [(77, 5), (78, 6)]


def test_operators_are_registered():
    from sluice.llm import catalog

    names = {q.split("_")[0] for q in catalog.queries()}
    assert names == {f"op{n}" for n in range(1, 14)} and set(catalog.oracle_sql()) <= set(catalog.queries())
    assert [f for _, f in p.STAGES] and line_dedup and ngram_join and decontaminate
