"""Physical-plan properties that matter at scale: pruning, pushdown, top-N, no cross joins."""

import io
import re
from contextlib import redirect_stdout


import __spark_entry__ as entry
from conftest import SMALL
from leafcast.operators import index as idx
from leafcast.options import ADAPTER_OPTIONS
from leafcast.sources import adapters


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_newest_per_type_uses_partial_top_n(spark):
    df = idx.newest_per_type(adapters.posts_v(spark, SMALL), ADAPTER_OPTIONS)
    p = plan_text(df)
    # A partial WindowGroupLimit sits below each Exchange of the two-level top-N.
    assert len(re.findall(r"WindowGroupLimit", p)) >= 4


def test_scans_read_only_needed_columns(spark):
    p = plan_text(entry.queries()["normalize_url"](spark, SMALL))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p  # html is never read
    p = plan_text(entry.queries()["terms_flat"](spark, SMALL))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int>" in p
    assert re.search(r"PushedFilters: \[[^\]]*IsNotNull\(l_orderkey\)", p)
    p = plan_text(entry.queries()["newest_per_type"](spark, SMALL))
    assert "o_totalprice" not in p and "o_orderpriority" in p


def test_html_job_crosses_into_python_once(spark):
    p = plan_text(entry.queries()["markdown_pages"](spark, SMALL))
    assert len(re.findall(r"MapInArrow", p.split("\n\n(1)")[0])) == 1


def test_incremental_anti_join_is_an_equi_join(spark, tmp_path):
    from leafcast.operators import documents as docs
    from leafcast.options import Options
    from leafcast.sources import captures as cap

    out = str(tmp_path / "docs")
    posts = cap.full_post(adapters.full_posts_capture_v(spark, SMALL))
    docs.incremental_documents(spark, posts, out, Options(), run_id=1).write.parquet(out)
    p = plan_text(docs.incremental_documents(spark, posts, out, Options(), run_id=2))
    assert re.search(r"(SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin) LeftAnti", p)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p
