"""Queries against their SQL at the smallest scale. FOLIOMILL_ALL=1 runs every one."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from foliomill.oracle import ORACLE
from foliomill.queries import REGISTRY

TABLES = ["documents", "pages", "conversations"]
FAST = ["token_estimate", "slugify_url", "html_tokens", "html_elements", "page_markdown", "fragment_markdown", "save_all_pages",
        "tree_export_entries", "tree_cap", "tree_paginate", "md_to_html", "md_inline_html", "md_block_profile"]


def normal(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(frame.itertuples(index=False, name=None), key=repr)


def test_every_query_has_sql():
    assert set(REGISTRY) == set(ORACLE)
    assert set(entry.queries()) >= set(REGISTRY) and set(entry.queries()) >= set(entry.oracle_sql()) >= set(ORACLE)


@pytest.mark.parametrize("name", list(REGISTRY) if os.environ.get("FOLIOMILL_ALL") else FAST)
def test_query(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    ours, theirs = entry.queries()[name](spark, sf).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
