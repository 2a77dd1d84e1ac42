"""Registered queries: DuckDB twins, and the pipeline against plain Python."""

import duckdb
import pytest

import corpus_pipeline
from conftest import SMALL
from tessera.llm import queries as Q
from tools.oracle_check import rows_of


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in Q.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_its_twin(spark, con, name):
    df = Q.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(Q.ORACLE[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, rows) == rows_of(cols, res.fetchall())


def test_entry_module_registers_them(spark):
    import __spark_entry__ as E
    names = E.queries()
    assert set(Q.QUERIES) <= set(names) and "pipeline" in names and set(Q.ORACLE) <= set(E.oracle_sql())


def test_pipeline_stages(spark, doc_rows):
    """Every stage against plain Python on what the stage before kept."""
    from llm import llm_brute as brute
    docs = corpus_pipeline.documents(spark, SMALL)
    kept = {r["doc_id"]: r["text"] for r in doc_rows}
    cols = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.table_of(stage(spark, docs, SMALL), "stage")
        rows = docs.collect()
        if i < 4:
            assert docs.columns == cols
        if i == 0:
            want = {k: t for k, t in kept.items() if not brute.base_failed(t)}
            assert {r.doc_id: r.text for r in rows} == want and len(want) < len(kept)
        elif i == 1:
            comp = brute.components({k: brute.fingerprint(t) for k, t in kept.items()})
            assert {r.doc_id: r.text for r in rows} == {k: t for k, t in kept.items() if comp[k] == k}
            assert len(rows) < len(kept)
        elif i == 2:
            assert {r.doc_id for r in rows} == set(kept)
            for r in rows:
                had = brute.base_spans(kept[r.doc_id])
                assert (r.text != kept[r.doc_id]) == bool(had) and not brute.base_spans(r.text)
                assert r.n_chars == len(r.text)
        elif i == 3:
            sizes = {k: len(t.encode().split()) for k, t in kept.items()}
            words = sum(len(r.text.encode().split()) for r in rows)
            # whole documents: each source may miss its target by half a document, and so may the budget
            assert abs(words - 1.5 * sum(sizes.values())) <= (len({r["source"] for r in doc_rows}) + 1) * max(sizes.values()) / 2
            for r in rows:
                assert kept[r.doc_id] == r.text
            assert max(sum(len(r.text.encode().split()) for r in rows if r.doc_id == k) / n
                       for k, n in sizes.items() if n) <= 2
            copies = len(rows)
        else:
            by = {}
            for r in rows:
                by.setdefault(r.sequence_id, []).append((r.offset, r.length))
            for places in by.values():
                at = 0
                for offset, length in sorted(places):
                    assert offset == at
                    at += length
                assert at <= 2048
            assert sum(r.piece == 0 for r in rows) == copies
        if i < 4:
            kept = {r.doc_id: r.text for r in rows}
            if i == 2:
                kept = {r.doc_id: r.text for r in rows}


@pytest.mark.parametrize("rows", ["edge", "none"])
def test_pipeline_on_awkward_tables(spark, rows, request, tmp_path):
    """The whole pipeline on rows with every awkward value and clashing columns, and on no rows."""
    docs = request.getfixturevalue(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r.doc_id for r in out.collect()} == ({6} if rows == "edge" else set())
