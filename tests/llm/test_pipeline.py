from __future__ import annotations

from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with planted near copies, benchmark passages, wordless rows and repeated sources."""
    folder = tmp_path_factory.mktemp("corpus")
    base = [f"w{k % 37}a w{k % 11}b w{k % 29}c plain{k} text here and more of it w{k % 5}d again item{k} end" for k in range(60)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    texts = [*base, base[3], base[4] + " tail", f"{base[5]} {item} {base[6]}", item, None, "...", ""]
    docs = [(k, t, "en", "hot" if k % 3 == 0 else f"s{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", texts, item


def test_stages_hand_documents_on(spark, tables):
    import corpus_pipeline

    folder, texts, item = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "sharding"]
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    n = len(texts)
    gone = {n - 3, n - 2, n - 1, 60, 61, n - 4}  # wordless, copies of 3 and 4, nothing but a benchmark item
    assert set(rows) == set(range(n)) - gone
    assert item not in rows[62].text and rows[62].n_chars == len(rows[62].text) < len(texts[62])
    assert all(rows[k].text == texts[k] for k in range(60))
    assert all(0 <= r.shard < 24 for r in rows.values())


def test_all_but_the_last_stage_return_the_columns(spark, tables):
    import corpus_pipeline

    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == COLUMNS
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).columns == [*COLUMNS, "shard"]


def test_shards_keep_the_order_of_the_mixture(spark, tmp_path):
    """Part files of very different sizes, which Spark does not read in their order."""
    import corpus_pipeline
    from tidemark.llm import mixing, sharding
    from tidemark.llm.queries import SOURCE_WEIGHTS

    docs = [(k, "word " * (1 + 400 * (k % 700 > 600)), "en", f"src{k * k % 7}", 1) for k in range(1500)]
    docs = spark.createDataFrame([*docs, docs[3], docs[3], (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    path = f"file://{tmp_path}/mixed"
    mixing.in_order(docs, SOURCE_WEIGHTS, rows_per_part=200).write.parquet(path)
    mixed = spark.read.parquet(path)
    position = {}
    for r in mixing.mix(docs, SOURCE_WEIGHTS).orderBy("position").collect():
        position.setdefault(r.doc_id, []).append(r.position)
    out = sharding.in_shards(mixed, SOURCE_WEIGHTS, rows_per_part=200)
    assert out.columns == [*COLUMNS, "shard", "slot"]
    out.write.parquet(f"file://{tmp_path}/out")
    for rows in (corpus_pipeline.STAGES[-1][1](spark, mixed, "").collect(), spark.read.parquet(f"file://{tmp_path}/out").orderBy("shard", "slot").collect()):
        assert len(rows) == 1503
        left = {k: list(v) for k, v in position.items()}
        got = [(r.shard, left[r.doc_id].pop(0)) for r in rows]
        assert got == sorted(got)
    assert len({r.shard for r in rows}) == 24
    slots = {}
    for r in rows:
        assert r.slot == slots.get(r.shard, 0)
        slots[r.shard] = r.slot + 1


@pytest.mark.skipif(not SF.exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["op1_decontaminate", "op3_jaccard_join", "op4_sharding"])
def test_queries_match_sql(spark, name):
    from tidemark.llm import oracle, queries

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    want = con.execute(oracle.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries.queries()[name](spark, str(SF))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want.fetchall())
