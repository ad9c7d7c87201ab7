import pytest

import corpus_pipeline
from raresift.llm import decontam, jaccard, toxicity
from raresift.llm.frames import materialize, table
from raresift.llm.queries import ORACLES, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf):
    out = [table(spark, sf, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), "stage"))
    return out


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    for df in steps[:-1]:
        assert df.columns == COLUMNS and df.schema == steps[0].schema


def test_each_stage_by_brute_force(spark, sf, steps):
    import re
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_decontam import brute as leaks
    from test_jaccard import brute as groups
    from test_packing import check_pieces

    texts = [{r.doc_id: r for r in df.collect()} for df in steps[:-1]]
    raw, calm, single, clean, hidden = texts
    model = toxicity.learn(steps[0], table(spark, sf, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(steps[0], model).collect()}
    assert set(calm) == {d for d, s in scores.items() if s < 0.5}
    assert set(single) == {d for d, (_, c) in groups([(d, r.text) for d, r in calm.items()]).items() if c == d}
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    word = re.compile(r"[0-9a-z]+")
    found = {d for d, r in single.items() for _, t in items if t in r.text}
    assert found <= set(single) - set(clean) and not {d for d in clean if any(t in clean[d].text for _, t in items)}
    if all(word.fullmatch(w) for _, t in items for w in re.findall(r"\w+", t.lower())):
        assert set(single) - set(clean) == {d for d, _ in leaks([(d, r.text) for d, r in single.items()], items)}
    assert set(hidden) == set(clean)
    for d, r in hidden.items():
        assert r.n_chars == len(r.text)
        for value in re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}", clean[d].text):
            assert value not in r.text
    order = sorted(hidden)
    place = {d: i for i, d in enumerate(order)}
    pieces = [type("P", (), r.asDict() | {"doc_id": place[r.doc_id]}) for r in steps[-1].collect()]
    check_pieces(pieces, [hidden[d].text for d in order], 1024)


def test_run_gives_the_last_stage(spark, sf, steps):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in corpus_pipeline.run(spark, sf).collect()) == sum(r.length for r in steps[-1].collect())


def test_stages_survive_empty_and_null_rows(spark, sf):
    schema = table(spark, sf, "documents").schema
    for rows in ([], [(None, None, None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", None, "s", 3)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "edge")
        assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows}


def test_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    import check

    rows, error = check.compare(spark, duck, sf, QUERIES[name], ORACLES[name])
    assert error is None and rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_unused_modules_stay_apart():
    """Nothing else in the library imports the subpackage."""
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent / "raresift"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "raresift.llm" not in f.read_text()
    assert decontam.K1 and jaccard.FRAGMENTS
