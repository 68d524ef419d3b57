import pytest

from tests.conftest import DATA
from twinlake import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, f"{DATA}/sf0.001"), duck.execute(queries.ORACLES[name]))


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["match_type", "match_key", "hash", "duplicate_count", "path", "size_bytes"]


@pytest.mark.parametrize("name", ["fuzzy_signature", "fuzzy_groups", "fuzzy_matches"])
def test_texts_without_a_shingle(spark, same, tmp_path, name):
    import duckdb

    texts = ["", None, "a", "a", "ok", "\u20ac", "\u20ac", "abcd", "abcd", "a longer text than that", "a longer text than that!"]
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    same(queries.QUERIES[name](spark, str(tmp_path)), c.execute(queries.ORACLES[name]))
