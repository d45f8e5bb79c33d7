"""Each stage of the pipeline against a plain version of it, on what the stage before kept."""

import duckdb
import pytest
from conftest import SF
from test_corpus_queries import plain_classes

import corpus_pipeline
from lumora.llm.queries import HITS_SQL, LINES_SQL, QUALITY_SQL
from lumora.llm.shared import written


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF), "stage"))
    return out


def sql(before, text):
    con = duckdb.connect()
    con.register("before", before.toPandas())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    return con.execute(text).fetchall()


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_keep_the_columns(kept):
    assert all(df.columns == kept[0].columns for df in kept[:-1])
    counts = [df.count() for df in kept]
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0


def test_quality(kept):
    want = sql(kept[0], f"WITH {QUALITY_SQL.format(source='before')} SELECT doc_id FROM verdicts WHERE kept")
    assert ids(kept[1]) == sorted(r[0] for r in want)


def test_lines(kept):
    want = sql(kept[1], f"WITH {LINES_SQL.format(source='before')} SELECT doc_id, kept_text FROM shortened WHERE n_removed = 0 OR regexp_matches(kept_text, '[^\\x20\\x09-\\x0D]')")
    assert sorted((r["doc_id"], r["text"]) for r in kept[2].collect()) == sorted(want)
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect())


def test_near_duplicates(kept):
    classes = plain_classes({r["doc_id"]: r["text"] for r in kept[2].collect()})
    assert ids(kept[3]) == sorted(set(classes.values()))


def test_benchmark(kept):
    want = sql(kept[3], f"WITH {HITS_SQL.format(source='before')} SELECT doc_id FROM judged WHERE NOT contaminated")
    assert ids(kept[4]) == sorted(r[0] for r in want)


def test_run_gives_the_last_stage(spark, kept):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, kept[-1].collect()))
