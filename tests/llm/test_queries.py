"""The registered queries on the smallest tables: columns, one row a document, and their SQL."""

import glob
import os

import pytest

from folio.llm.oracles import ORACLES
from folio.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op2_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_suffix_array_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op6_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op9_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op11_phrases": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op12_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op13_reshard": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "old_shard"],
    "op10_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_all_are_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cursor = con.execute(ORACLES[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert got == sorted(repr([r[i] for i in at]) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    if name.startswith(("op2", "op4", "op9", "op12", "op13")):
        n = spark.read.parquet(f"{SF}/documents.parquet").count()
        assert df.count() == df.select("doc_id").distinct().count() == n


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in COLUMNS])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
