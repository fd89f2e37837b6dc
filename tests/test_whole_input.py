"""Queries over text and the log read all of their input: every character and every conversation."""

import unicodedata

import duckdb
import pytest

from threadloom.plans import conversations, registry

FAR = "word " * 40


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Texts with a secret, an invisible character and a compatibility form far behind character 80."""
    out = str(tmp_path_factory.mktemp("whole"))
    rows = [(1, f"{FAR}password sk-abcdefgh12345 Cookie: sid=1 end", "en", "web"), (2, f"{FAR}a​b﻿cd ﬁＡ end", "en", "web"), (3, None, "en", "web"), (4, "", "de", "web"), (5, "short sk-abcdefgh12345", "de", "code")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{out}/documents.parquet")
    return out


def of(spark, folder, name, column):
    return {r["doc_id"]: r[column] for r in registry.queries()[name](spark, folder).collect()}


def whole_sql(folder, name, column):
    """The oracle SQL of a query, which reads whole texts, too."""
    sql = registry.oracle_sql()[name]
    assert "substr(text" not in sql and "%" not in sql
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return {r["doc_id"]: r[column] for r in con.sql(sql).to_arrow_table().to_pylist()}


def test_redact_reaches_the_end(spark, folder):
    got = of(spark, folder, "redact_secrets", "redacted")
    assert got[1].endswith(f"{FAR}password sk-***REDACTED*** Cookie: ***REDACTED*** end") and got[5].endswith("short sk-***REDACTED***")
    want = whole_sql(folder, "redact_secrets", "redacted")
    assert {k: v for k, v in got.items() if k != 3} == {k: v for k, v in want.items() if k != 3}


def test_sanitize_ranges_reaches_the_end(spark, folder):
    got = of(spark, folder, "sanitize_ranges", "clean")
    assert got[2] == f"{FAR}abcd ﬁＡ endxy" and got == whole_sql(folder, "sanitize_ranges", "clean")


def test_sanitize_nfkc_reaches_the_end(spark, folder):
    got = of(spark, folder, "sanitize_nfkc", "clean")
    assert got[2] == f"ABC1fi{FAR}abcd fiA end" and got[3] is None
    assert unicodedata.is_normalized("NFKC", got[2])


def test_replay_has_every_conversation(spark, tmp_path):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c"), (3, 0, "system", "d"), (None, 0, "user", "e")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, registry.queries()["replay_messages"](spark, str(tmp_path)).collect()), key=key) == rows
    log = conversations.event_log(spark, str(tmp_path))
    assert sorted(map(tuple, conversations.messages(log, [1, 3], ["user", "system"]).collect())) == [rows[0], rows[3]]
    assert conversations.messages(log, []).count() == 0
