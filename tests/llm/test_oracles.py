"""The DuckDB SQL of the queries, on the smallest tables, and of chats on quoted messages."""

import duckdb
import pytest

from llm import chat
from llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_oracle(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = c.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=repr) == sorted(map(tuple, want.fetchall()), key=repr)


def test_chat_oracle_on_quotes(spark):
    data = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> hello  there\n> How are you?\nFine."), (1, 3, "user", ">> How are you?\n> Fine.\nGood!\n\nReally"), (1, 4, "assistant", "> really\nyes"), (2, 0, "user", "> Hello there\nHi"), (2, 1, None, None),
            (None, 1, "user", "> Hi\nz"), (2, None, "user", "> Hi\nz"), (3, 1, "user", "Hi"), (3, 2, "a", ">Hi\n> > Hi"), (4, 0, "u", "a\nb\nc"), (4, 1, "v", "> b\nq"), (4, 2, "u", "> q\n>> a\n> q2\nzz"), (4, 3, "v", "> zz\n\n> q\nend")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_chats(df)
    c = duckdb.connect()
    c.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", data)
    want = c.sql(ORACLES["op2_chat_format"]).select(*got.columns).fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
