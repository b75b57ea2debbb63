"""The registered queries over the smallest tables, their SQL, and what repeated rows give."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lumenote.llm import decontam, ngram_join, packing, queries, suffix_dedup, token_counts, token_output

DATA = "/root/testdata/sf0.001"
EVERY_DOCUMENT = {"op2_suffix_dedup", "op3_quality", "op4_toxicity", "op5_ngram_join", "op6_token_output"}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered(spark, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = got.collect()
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    if name in EVERY_DOCUMENT:
        assert len(rows) == len({r.doc_id for r in rows}) == n
    if name == "op7_warc":
        assert len(rows) == spark.read.parquet(f"{DATA}/pages.parquet").count()
    if name == "op10_packing":
        assert len({r.doc_id for r in rows}) == n
    if name in queries.ORACLE_SQL:
        duck = duckdb.connect()
        for p in Path(DATA).glob("*.parquet"):
            duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        columns = sorted(got.columns)
        expected = duck.sql(queries.ORACLE_SQL[name])
        assert sorted(expected.columns) == columns
        want = expected.project(", ".join(f'"{c}"' for c in columns)).fetchall()
        assert Counter(tuple(r[c] for c in columns) for r in rows) == Counter(want)


def test_repeated_rows(spark):
    long = " ".join(f"palavra{i}" for i in range(80))
    rows = [(1, long), (1, long), (2, "outra coisa bem curta"), (3, long + " fim"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removed = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert removed == Counter({(1, len(long)): 2, (2, 0): 1, (3, len(long)): 1, (4, 0): 1})
    classes = Counter((r.doc_id, r.component_id, r.n_links) for r in ngram_join.ngram_join(docs, 3, 90).collect())
    assert classes == Counter({(1, 1, 2): 2, (2, 2, 0): 1, (3, 1, 2): 1, (4, 4, 0): 1})
    folder = token_output.new_folder(spark)
    token_output.write_tokens(docs, folder)
    read = sorted((r.start, r.doc_id, r.n_tokens) for r in token_output.read_tokens(spark, folder).collect())
    assert [d for _, d, _ in read] == [1, 1, 2, 3, 4] and all(a[0] + a[2] == b[0] for a, b in zip(read, read[1:], strict=False))
    places = [(r.sequence_id, r.offset, r.length) for r in packing.best_fit_packing(docs, limit=100).collect()]
    assert len(set(places)) == len(places) and Counter(r.doc_id for r in packing.token_pieces(docs, 4096).collect()) == Counter({1: 2, 2: 1, 3: 1, 4: 1})
    assert sum(r.n_docs for r in token_counts.length_histogram(docs).collect()) == 5
    item = spark.createDataFrame([(7, " ".join(long.split()[:20])), (7, " ".join(long.split()[:20]))], "item_id long, text string")
    assert sorted((r.doc_id, r.n_places) for r in decontam.leaks(docs, item).collect()) == [(1, 1), (3, 1)]


def test_sums_answer_any_limit(spark):
    lengths = [0, 0, 3, 5, 5, 9]
    histogram = spark.createDataFrame(list(Counter(lengths).items()), "n_tokens long, n_docs long")
    sums = token_counts.with_suffix_sums(histogram)
    limits = [-1, 0, 1, 3, 4, 5, 8, 9, 100]
    got = {r.context_limit: (r.docs_over, r.tokens_kept) for r in token_counts.totals(sums, limits[1:]).collect()}
    assert got == {x: (sum(n > x for n in lengths), sum(min(n, x) for n in lengths)) for x in limits[1:]}
    shares = [0.0, 0.3, 0.34, 0.5, 0.9, 1.0]
    import math

    ranked = {s: sorted(lengths)[max(1, math.ceil(s * 6)) - 1] for s in shares}
    assert {r.share: r.n_tokens for r in token_counts.quantiles(sums, shares).collect()} == ranked
    empty = token_counts.with_suffix_sums(spark.createDataFrame([], "n_tokens long, n_docs long"))
    assert [tuple(r) for r in token_counts.totals(empty, [5]).collect()] == [(5, 0, 0)] and token_counts.quantiles(empty, [0.5]).collect() == []
