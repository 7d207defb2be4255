"""The stages one after another, each against a brute-force version on what it was given."""

import duckdb
import pytest

import corpus_pipeline
from tidewire.llm import line_dedup

from .test_corpus_operators import brute_groups, check_packing

TABLES = "documents labels benchmark".split()


@pytest.fixture(scope="module")
def stages(spark, tiny, tmp_path_factory):
    """Name -> (rows in, rows out), written and reread between the stages."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{tiny}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, tiny).write.parquet(f"{root}/{k}")
        after = spark.read.parquet(f"{root}/{k}")
        out[name] = (docs.collect(), after.collect())
        assert k == len(corpus_pipeline.STAGES) - 1 or sorted(after.dtypes) == sorted(docs.dtypes)
        docs = after
    return out


def test_classifier_keeps_the_good(stages, tiny):
    before, after = stages["quality classifier"]
    kept = {r.doc_id for r in after}
    label = dict(duckdb.sql(f"select doc_id, quality from '{tiny}/labels.parquet'").fetchall())
    hits = [(r.doc_id in kept) == (label[r.doc_id] == 1) for r in before if r.doc_id in label]
    assert sum(hits) / len(hits) > 0.95


def test_lines(stages):
    before, after = stages["line dedup"]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [(r.doc_id, r.text) for r in before])
    want = {i: t for i, t, _, gone in con.execute(line_dedup.ORACLE).fetchall() if t.strip(" ") or not gone}
    assert {r.doc_id: r.text for r in after} == want


def test_copies(stages):
    before, after = stages["MinHash near-dedup"]
    groups = brute_groups([(r.doc_id, r.text) for r in before], 80)
    assert {r.doc_id for r in after} == {i for i, (_, g) in groups.items() if i == g}


def test_leaks(stages, tiny):
    before, after = stages["benchmark decontamination"]
    words = lambda t: "".join(c if c.isalnum() or c == "_" else " " for c in t.lower()).split()
    items = [" ".join(words(t)) for (t,) in duckdb.sql(f"select text from '{tiny}/benchmark.parquet'").fetchall()]
    whole = {r.doc_id for r in before if any(f" {t} " in f" {' '.join(words(r.text))} " for t in items)}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert whole and whole <= gone and len(gone - whole) <= 0.01 * len(before)


def test_packing(stages, spark):
    before, after = stages["packing"]
    check_packing(spark, [(r.doc_id, r.text) for r in before], after)


def test_run_gives_the_pieces_of_the_last_stage(stages, spark, tiny):
    ran = corpus_pipeline.run(spark, tiny).collect()
    assert sum(r.length for r in ran) == sum(r.length for r in stages["packing"][1])
    assert {r.doc_id for r in ran} == {r.doc_id for r in stages["packing"][1]}


#: Nulls, empty and repeated rows, a passage that two documents share, copies, a leak, and no n_chars.
PASSAGE = "one line of some length\nanother line of the passage\nthe third line of it\n"
LEAK = "when the quick river rises over nine old stones the keeper counts them all twice"
COPY = " ".join(f"word{k}" for k in range(80))
ODD = [(1, None), (2, ""), (3, "   "), (None, "no id here at all"), (4, PASSAGE + "own end"), (5, PASSAGE + "other end"), (6, PASSAGE), (7, COPY), (8, COPY + " more"), (8, COPY + " more"), (9, "it said " + LEAK.replace("nine", "ten") + " and went"), (10, "a clean text of a few words")]
COLUMNS = "doc_id long, text string, line_count string, lines_removed int, text_hash string, row string, score double"


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, int(i != 3)) for i in range(1, 11)], "doc_id long, quality int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def odd_docs(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "lc", 7, "h", "r", 0.5) for i, t in rows], COLUMNS)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_odd_rows_and_columns(spark, odd_tables, name, stage):
    before = odd_docs(spark)
    after = stage(spark, before, odd_tables)
    assert after.dtypes == before.dtypes
    rows = after.collect()
    assert {(r.line_count, r.lines_removed, r.text_hash, r.row, r.score) for r in rows} == {("lc", 7, "h", "r", 0.5)}
    kept = sorted([r.doc_id or 0 for r in rows])
    want = {
        "line dedup": [0, 1, 2, 3, 4, 5, 7, 8, 8, 9, 10],
        "MinHash near-dedup": [0, 1, 2, 3, 4, 7, 9, 10],
        "benchmark decontamination": [0, 1, 2, 3, 4, 5, 6, 7, 8, 8, 10],
    }
    if name in want:
        assert kept == want[name]
    assert stage(spark, odd_docs(spark, []), odd_tables).count() == 0


def test_packing_of_odd_rows(spark, odd_tables):
    after = corpus_pipeline.STAGES[-1][1](spark, odd_docs(spark).selectExpr("*", "cast(null as string) source"), odd_tables).collect()
    assert sorted({r.doc_id or 0 for r in after}) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert sum(r.length for r in after if r.doc_id == 8) == 2 * next(r.doc_tokens for r in after if r.doc_id == 8)
    assert all(r.length == 1 for r in after if r.doc_id in (1, 2, 3))


def test_leaks_with_edits_equal_all_pairs(spark, tiny):
    """Items with words changed, left out and put in: the stage drops what an alignment with every item finds."""
    import random

    rnd = random.Random(6)
    items = [t.split() for (t,) in duckdb.sql(f"select text from '{tiny}/benchmark.parquet' order by item_id").fetchall()]
    words = lambda: [f"{rnd.choice('bcdfgh')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{rnd.randint(0, 9)}" for _ in range(40)]
    rows = []
    for k in range(60):
        item = list(items[k % len(items)])
        for _ in range(max(1, len(item) // 12)):
            at = rnd.randrange(len(item))
            item[at : at + 1] = [[], ["other"], [item[at], "extra"]][k % 3]
        rows.append((k, " ".join(words() + item + words())))
    rows += [(100 + k, " ".join(words() + words())) for k in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = {r.doc_id for r in corpus_pipeline.drop_leaks(spark, docs, tiny).collect()}
    assert kept == set(range(100, 160))


def test_tables_of_the_stages_go(spark, tiny):
    from pathlib import Path

    from tidewire.llm import common

    mark = common.shelves()
    out = corpus_pipeline.run(spark, tiny)
    left = [p for root in common._ROOTS[mark:] for p in Path(root.removeprefix("file://")).glob("*")]
    assert [p.name.split("-")[1] for p in left] == ["packing"] and out.count()
    common.release(spark, mark)
    assert not any(p.exists() for p in left)
