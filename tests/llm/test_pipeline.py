"""The pipeline against its stages on odd rows, and against a brute-force version on the small tables."""

import duckdb
import pytest

import corpus_pipeline
from landpulse.llm import line_rules, site_lines
from test_links import brute_components

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (2, "word " * 60, None, "s", None, "x"), (2, "word " * 60, None, "s", None, "x")]])
def test_stages_take_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == docs.columns
        assert out.count() <= max(len(rows), 0)


def test_run_agrees_with_brute_force(spark):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    ruled = "ruled AS (SELECT doc_id, source, clean AS body FROM measured WHERE kept)"
    sql = f"WITH {line_rules.sql_measures()}, {ruled}, {site_lines.sql_dropped('ruled', 'doc_id', 'source', 'body')} SELECT doc_id, kept_text FROM cleaned WHERE n_dropped = 0 OR n_dropped < n_lines"
    texts = dict(connection.execute(sql).fetchall())
    kept = {d for d, (_, component) in brute_components(texts, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PER_CENT).items() if d == component}
    items = [t.split() for (t,) in connection.execute(f"SELECT lower(text) FROM '{FOLDER}/benchmark.parquet'").fetchall()]

    def leaks(words):
        joined = " ".join(words)
        return any(" ".join(item) in joined for item in items)

    expected = {d for d in kept if not leaks(texts[d].lower().split())}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in got} == expected


def test_near_duplicates_takes_five_words_and_eighty_per_cent(spark):
    words = ["u%d" % k for k in range(330)]
    edited = lambda n, mark="": " ".join(f"x{k}" if k % 40 == 20 and k < 40 * n else w + mark for k, w in enumerate(words))
    # an edit changes five of 326 shingles: seven leave 291 of 361 (0.806), eight 286 of 366 (0.781)
    texts = {1: edited(0), 2: edited(7), 3: edited(0, "z"), 4: edited(8, "z")}
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    want = {d for d, (_, component) in brute_components(texts, 5, 80).items() if d == component}
    assert want == {1, 3, 4} and {d for d, (_, c) in brute_components(texts, 4, 85).items() if d == c} == {1, 2, 3, 4}
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()} == want


def test_near_duplicates_among_null_and_repeated_ids(spark):
    """Copies whose ids are null, negative or repeated go like others; the least id stays, null ids come last."""
    body = lambda mark: " ".join(f"{mark}{k}" for k in range(80))
    near = body("a") + " more"
    rows = [(None, body("a")), (7, body("a")), (7, near), (9, body("a")), (None, body("b")), (None, body("b")), (-3, body("c")), (4, body("c") + " more"), (5, body("d")), (5, body("e")),
            (6, ""), (None, ""), (6, None), (8, body("b"))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, own string")
    out = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    assert out.columns == docs.columns
    assert [d for d, _ in got] == [-3, 5, 5, 6, 6, 7, 8, None]
    assert {t[0] for d, t in got if d in (5, -3, 7, 8)} == {"a", "b", "c", "d", "e"}
