"""Secrets in very long texts, widely copied ones, and rows with nulls."""

import hashlib
import random
import time

import duckdb
from pyspark.sql import functions as F
from test_text import brute_spans

from gridgrove.llm import secrets


def test_secrets_of_a_long_text(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(rng.choice(("token=", "x ", "é")) + f"{rng.getrandbits(160):040x}" for _ in range(100_000))
    assert len(long) > 4_000_000
    docs = spark.createDataFrame([(1, long, "s"), (2, "password=abcdefgh", None)], "doc_id bigint, text string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.op9_secrets(spark, str(tmp_path)).collect()}
    assert time.perf_counter() - began < 120
    base = brute_spans(long)
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert got[1].n_hex == base.count("hex") and got[1].n_assign == base.count("assign")
    assert got[2].spans == "assign:0:17"


def test_secrets_of_many_owners_and_nulls(spark, tmp_path):
    """A token that a third of all rows hold, null columns, candidates that touch base spans: as SQL has it."""
    rows = [(k, "see wide11wide22wide33wide44" if k % 3 == 0 else f"own{k:04d}" + "a1b2c3d4e5f6g7h8i9" + (" own9999q1w2e3r4t5y6u7i8o9" if k in (7, 8) else ""), ("r1", "r2", None)[k % 2 * 2]) for k in range(300)]
    rows += [(900, None, None), (901, "", "r1"), (902, "secret=zz11zz22zz33zz44zz55zz66 yy11yy22yy33yy44yy55yy66", "r1"), (903, "token: ab", "r1")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"id": F.lit("clash"), "row": F.lit("clash"), "m": F.lit(1), "spans": F.lit(2), "h": F.lit(3)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied"]
    got = sorted(tuple(r) for r in secrets.op9_secrets(spark, str(tmp_path)).select(*names).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({secrets.SQL})").fetchall())
    by_id = {r[0]: r for r in got}
    assert by_id[0][6:] == (0, 1) and by_id[1][6] == 1 and by_id[7][6:] == (1, 1) and by_id[902][5].startswith("assign:0:31,live:32:56")


def test_secrets_repeated_by_their_owner_in_tables_of_any_size(spark, tmp_path):
    """A token that one document repeats is live, whatever share of all candidates it makes up: as SQL has it."""
    own = " ".join(["own11own22own33own44own55"] * 5)
    rows = [(0, own, "r1"), (1, "twice1twice2twice3twice4 " * 2, "r1"), (2, "twice1twice2twice3twice4 " * 3, "r1"), *((k, "wide11wide22wide33wide44 " * 2, f"r{k % 2}") for k in range(3, 9))]
    filler = [(k, " ".join(f"{k:04d}fill{i:04d}a1b2c3d4e5f6g7" for i in range(600)), "r1") for k in range(100, 200)]  # 60,000 candidates
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_copied"]
    found = []
    for name, all_rows in (("alone", rows), ("beside", rows + filler)):
        spark.createDataFrame(all_rows, "doc_id bigint, text string, source string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = sorted(tuple(r) for r in secrets.op9_secrets(spark, str(tmp_path / name)).select(*names).collect())
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        assert got == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({secrets.SQL})").fetchall())
        found.append(got[: len(rows)])
    assert found[0] == found[1]
    assert [r[6:] for r in found[0][:4]] == [(5, 0), (2, 0), (3, 0), (0, 2)]
