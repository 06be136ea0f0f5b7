"""The registered queries over the smallest tables: their columns, and their rows where SQL gives them."""

import os

import duckdb
import pytest

from weft.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
COLUMNS = {
    2: "doc_id size text_crc32 law shard slot grown_shard",
    3: "page_id host path rule verdict",
    4: "doc_id held_out score predicted",
    6: "doc_id n_shingles component_id",
    7: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    8: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "doc_id n_words n_hit n_items items_sha256 contaminated",
}
KINDS = {"size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int", "held_out": "boolean", "score": "double", "predicted": "int", "n_shingles": "bigint", "n_chars": "bigint", "near_edited": "double", "near_next": "double", "n_tokens": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "contaminated": "boolean"}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    for c in COLUMNS.get(int(name[2:].split("_")[0]), "").split():
        assert c in df.columns and dict(df.dtypes)[c] == KINDS.get(c, dict(df.dtypes)[c])
    rows = df.collect()
    assert rows
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(registry.oracle_sql()[name])
        columns = [c[0] for c in found.description]
        assert sorted(map(repr, (tuple(r[c] for c in columns) for r in rows))) == sorted(map(repr, found.fetchall()))
    elif COLUMNS.get(int(name[2:].split("_")[0]), "").startswith("doc_id"):
        docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
