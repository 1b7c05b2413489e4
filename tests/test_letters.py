"""First letters and words of sentences against DuckDB, on letters of every kind."""

import unicodedata

import duckdb
import pyarrow as pa
import pyarrow.parquet
import pytest

from colloquy.plans import registry

#: Letters and marks of an old Unicode, which both engines know alike (but for two whose capitals are new).
LETTERS = [chr(i) for i in range(33, 0x1F000) if unicodedata.ucd_3_2_0.category(chr(i))[0] in "LM" and i not in (0x019B, 0x0264)]


@pytest.fixture(scope="module")
def letters(tmp_path_factory):
    folder = tmp_path_factory.mktemp("letters")
    texts = [" ".join(f"{c}er schreibt die und that {a}{c}the que." for a in ("x", "")) + f" Words that end with{c} and {c}." for c in LETTERS if ord(c) < 0x3000 or ord(c) >= 0xA640]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    pa.parquet.write_table(table, folder / "documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["f7_f8_sentences", "a6_o4_topic_points", "o3_x19_overview", "x19_f11_topic_groups", "f9_scoring_words"])
def test_letters_as_in_sql(spark, letters, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{letters}/documents.parquet'")
    df = registry.QUERIES[name](spark, str(letters))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
