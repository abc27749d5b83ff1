"""Driver contract: entry(), queries(), oracle_sql()."""

import __spark_entry__ as entry


def test_keys_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50


def test_entry_runs_with_stable_schema(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == entry.entry(spark).columns
    assert "line" in df.columns and "rank" in df.columns


def test_output_schemas(spark):
    from leafcast import schemas
    from leafcast.operators import documents as docs
    from leafcast.options import Options
    from leafcast.sources import adapters
    from leafcast.sources import captures as cap
    from conftest import SMALL

    q = entry.queries()
    assert tuple(q["index_rows"](spark, SMALL).columns) == schemas.INDEX_ROWS
    assert tuple(q["type_summary"](spark, SMALL).columns) == schemas.TYPE_SUMMARY
    assert tuple(q["authors"](spark, SMALL).columns) == schemas.AUTHORS
    assert tuple(q["site_index_lines"](spark, SMALL).columns) == schemas.INDEX_LINES
    posts = cap.full_post(adapters.full_posts_capture_v(spark, SMALL))
    assert tuple(docs.build_documents(posts, Options(), "raw").columns) == schemas.DOCUMENTS


def test_without_the_training_data_parts_the_other_queries_stay(monkeypatch):
    """What cannot be imported takes only its own queries away: first the pipeline, then all operators (here: no tokenizer files)."""
    import sys

    others = {k for k in entry.queries() if k != "pipeline" and not k.startswith("op")}
    assert len(others) >= 60
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and set(entry.queries()) >= others
    for name in [m for m in sys.modules if m.startswith("leafcast.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert set(entry.queries()) == others and set(entry.oracle_sql()) <= others
