"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from habitscope.llm import chunk_bpe, chunk_dedup, language, line_windows, mixing, near_dups, projections, secret_crf
from habitscope.llm import site_quality, stages, token_counts

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, k1 string, h1 int, seq int, "
    "packed int, signature int, rep int, key int, centre int, lines int, host int, path int, recipe int, size int, "
    "row_hash int, spans int, ids int, content int, _kept_id int, _name int, _row int"
)
LONG = "lorem ipsum dolor sit amet " * 20000
TEXTS = [
    None,
    "",
    "   \n\t ",
    "...",
    "one",
    "one two",
    "the same line\nthe same line\nthe same line\nthe same line",
    LONG,
    "x" * 200000,
    "naïve café – 東京 🙂 password: abcdefgh12 <|endoftext|> tail",
    "the same line\nthe same line\nthe same line\nthe same line",
]


def rows():
    some = [(i, t, ["en", None, "fr"][i % 3], [None, "a", "b"][i % 3]) for i, t in enumerate(TEXTS)]
    return [*some, some[6], some[9], (None, "one two", "en", "a"), (None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, *[None] * 21) for r in rows()], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def labels(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))


OPERATORS = {
    "secrets": lambda d: secret_crf.find_secrets(d, secret_crf.fit(d)),
    "exact": chunk_dedup.exact_groups,
    "language": lambda d: language.identify(d, language.fit(d)),
    "encode": lambda d: chunk_bpe.decode(chunk_bpe.encode(d)),
    "mix": mixing.mix,
    "near": near_dups.near_groups,
    "quality": lambda d: site_quality.posteriors(d, site_quality.fit(d, labels(d)), F.col("source"), F.col("lang")),
    "lines": line_windows.without_repeats,
    "tokens": token_counts.token_counts,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, nothing, name):
    got = OPERATORS[name](docs).collect()
    order = lambda v: (v is None, v or 0)
    assert sorted((r.doc_id for r in got), key=order) == sorted((r[0] for r in rows()), key=order)
    again = OPERATORS[name](docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert OPERATORS[name](nothing).count() == 0


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_exact_groups(docs):
    got = by_id(chunk_dedup.exact_groups(docs).where("doc_id is not null"))
    assert (got[0].keep_id, got[1].keep_id, got[1].group_size) == (1, 1, 3)
    assert (got[6].keep_id, got[10].keep_id, got[10].group_size, got[6].kept) == (10, 10, 3, False)
    assert got[7].kept and got[8].kept


def test_near_groups_without_words(docs):
    got = by_id(near_dups.near_groups(docs).where("doc_id is not null"))
    assert [got[i].n_shingles for i in (0, 1, 2, 3, 4, 5)] == [0, 0, 0, 1, 1, 1]
    assert all(got[i].component_id == i for i in (0, 1, 2, 3, 4, 5))
    assert got[10].component_id == 6


def test_language_of_no_letters(docs):
    got = by_id(language.identify(docs, language.fit(docs)).where("doc_id is not null"))
    assert [got[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and all(got[i].rejected for i in (0, 1, 2, 3))
    assert got[7].lang_pred in ("en", "fr") and 0 <= got[7].score <= 1


def test_lines(docs):
    frame = line_windows.without_repeats(docs).where("doc_id is not null")
    got = by_id(frame)
    assert (got[0].text, got[0].n_lines, got[0].n_removed) == ("", 1, 0)
    # Windows at 0 and 1 of document 6 are equal: the second covers lines 1 to 3. Its repeated row loses all.
    assert sorted((r.text, list(r.removed)) for r in frame.where("doc_id = 6").collect()) == [
        ("", [0, 1, 2, 3]),
        ("the same line", [1, 2, 3]),
    ]
    assert (got[10].text, got[10].n_removed) == ("", 4)


def test_mix_takes_no_more_than_three_times(docs):
    got = mixing.mix(docs).collect()
    assert all(r.taken <= 3 * r["size"] for r in got) and sum(r.taken for r in got) > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, nothing, folder, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, folder)
    got.collect()
    if name != corpus_pipeline.STAGES[-1][0]:
        assert got.columns == stages.COLUMNS
    assert stage(spark, nothing, folder).count() == 0


def _documents(spark, some):
    return spark.createDataFrame(
        [(i, t, lang, "a", len(t or "")) for i, t, lang in some],
        "doc_id long, text string, lang string, source string, n_chars long",
    )


def test_a_rejected_row_does_not_come_back_by_its_id(spark, folder):
    words = "the house and the garden of that old man were there"
    clear = [(i, f"{words} {i}", "en") for i in range(20)]
    given = _documents(spark, [*clear, (None, words, "en"), (None, "...", None), (None, None, None), (3, "1234", None)])
    got = stages.identify_language(spark, given, folder).collect()
    assert sorted((r.text for r in got)) == sorted([t for _, t, _ in clear] + [words])


def test_documents_stay_where_nothing_is_labelled(spark, folder):
    given = _documents(spark, [(1, "a clean text", None), (2, "...", None), (3, None, None), (None, "one more", None)])
    assert language.fit(given) is None
    assert sorted(r.text for r in stages.identify_language(spark, given, folder).collect()) == ["a clean text", "one more"]
    told = by_id(language.identify(given, None))
    assert [told[i].rejected for i in (1, 2, 3, None)] == [False, True, True, False]
    assert all(r.lang_pred == "und" and r.score == 0 for r in told.values())


def test_stages_name_rows_by_id_and_text(spark, folder):
    long = " ".join(f"word{i}" for i in range(100))
    given = _documents(
        spark,
        [(None, long + " x", None), (None, long + " y", None), (None, long + " y", None)]
        + [(None, "alone one two three four five", None), (7, "first text of seven", None), (7, "another text of that id here", None)],
    )
    exact = stages.drop_exact(spark, given, folder)
    assert exact.count() == 5
    kept = sorted(r.text for r in stages.drop_near(spark, given, folder).collect())
    assert len(kept) == 4 and kept[-1].startswith(long) and kept[:3] == [
        "alone one two three four five", "another text of that id here", "first text of seven"
    ]
    # Ids are compared as numbers, and a row that has one goes before those that have none.
    given = _documents(spark, [(None, long + " x", None), (10, long + " y", None), (9, long + " z", None), (-1, "other", None)])
    assert sorted(r.doc_id for r in stages.drop_near(spark, given, folder).collect()) == [-1, 9]


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [[1.0, 0.0], None, [0.0, 0.0], [nan, 1.0], [inf, 1.0], [None, 1.0], [], [0.5], [1.0, 0.0], [1.0, 0.0], [0.0, 2.0]]
    frame = spark.createDataFrame([(i * 20 if i else 0, v, 1, 2) for i, v in enumerate(data)], "vec_id long, embedding array<double>, cell int, rank int")
    frame = frame.union(spark.createDataFrame([(None, [1.0, 1.0], 1, 1)], frame.schema))
    got = projections.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    first = [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0]
    assert first == [(1, 160, 1.0), (2, 180, 1.0), (3, 140, 0.5), (4, 200, 0.0)]
    assert {r.query_id for r in got} == {0, 140, 160, 180, 200}
    assert projections.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
