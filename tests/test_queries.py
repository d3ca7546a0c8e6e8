import pytest

import __spark_entry__ as entry
from ledgerloom.plans import audits, cleaning, retrieval
from tests.oracle import agree

QUERIES = cleaning.QUERIES | retrieval.QUERIES | audits.QUERIES
ORACLE = cleaning.ORACLE | retrieval.ORACLE | audits.ORACLE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, sf, name):
    assert agree(spark, sf, QUERIES[name], ORACLE.get(name))


def test_entry(spark):
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["path", "score", "text", "graph", "hier", "graph_dist"]


EMPTY = ("p2_found", "p4_found", "p6_found", "p6_report", "bm25_topk", "folder_views", "edges_extract", "recall_totals", "source_mix", "lift_report", "knn_l2_topk", "session_debounce",
         "superseded_chain", "second_probe", "lift_pairs", "verify_run", "recurring_items", "unsettled_audits", "findings_since_cycle", "followed_questions", "markdown_tree", "source_edges", "log_lines_back", "store_tables", "search_cascade", "embed_signs", "phrase_match")


@pytest.fixture(scope="module")
def nothing(spark, sf, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("recall_log", "files", "edges", "tests", "dream_log", "documents", "events"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id = 0").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", EMPTY)
def test_empty_tables(spark, nothing, name):
    QUERIES[name](spark, nothing).collect()
