"""K1 two-level top-N equals a brute-force sort, whatever the partitioning and skew."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafcast.operators import index as idx
from leafcast.options import Options

POST = st.tuples(
    st.sampled_from(["hot", "hot", "hot", "warm", "cold"]),      # a skewed type distribution
    st.integers(min_value=1, max_value=400),                    # id (duplicates allowed)
    st.sampled_from(["", "2024-01-01", "2024-01-02", "2024-02-01", "2023-12-31"]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(posts=st.lists(POST, min_size=1, max_size=120), parts=st.integers(min_value=1, max_value=9),
       per_page=st.integers(min_value=1, max_value=7), pages=st.integers(min_value=1, max_value=3))
def test_newest_per_type_matches_brute_force(spark, posts, parts, per_page, pages):
    rows = [("s", t, i, d) for t, i, d in {(t, i, d) for t, i, d in posts}]  # (type, id, date) unique
    df = spark.createDataFrame(rows, "site string, type_key string, id bigint, date string").repartition(parts)
    opts = Options(posts_per_page=per_page, max_pages_per_type=pages)
    got = sorted((r.type_key, r.id, r.date, r.page, r.pos) for r in idx.newest_per_type(df, opts).collect())
    want = []
    for t in {r[1] for r in rows}:
        ranked = sorted((r for r in rows if r[1] == t), key=lambda r: (r[3], r[2]), reverse=True)[: per_page * pages]
        want += [(t, r[2], r[3], n // per_page + 1, n % per_page) for n, r in enumerate(ranked)]
    assert got == sorted(want)
    assert df.select(F.spark_partition_id()).distinct().count() <= parts


FETCHED = st.tuples(
    st.sampled_from(["post", "page"]),
    st.integers(min_value=1, max_value=12),          # id: duplicates on purpose
    st.integers(min_value=-1, max_value=13),         # parent: <= 0, present or absent
    st.sampled_from(["A", "B", " C\t", "", "D  E"]),  # raw titles
)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(posts=st.lists(FETCHED, min_size=1, max_size=40))
def test_parent_titles_match_the_reference_loop(spark, posts):
    rows = [("s", t, i, p, title, n // 5 + 1, n % 5) for n, (t, i, p, title) in enumerate(posts)]
    df = spark.createDataFrame(rows, "site string, type_key string, id bigint, parent bigint, title_raw string, "
                                     "page int, pos int")
    got = sorted((r.type_key, r.page, r.pos, r.parent_title)
                 for r in idx.with_parent_titles(idx.with_flat_titles(df)).collect())
    want = []
    for t in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == t]                     # fetch order = (page, pos)
        titles = {}
        for r in mine:                                            # later entries overwrite earlier ones
            titles[r[2]] = " ".join(r[4].split())
        for r in mine:
            want.append((t, r[5], r[6], titles.get(r[3], "") if r[3] > 0 else ""))
    assert got == sorted(want)
