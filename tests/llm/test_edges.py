"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator and stage."""

import corpus_pipeline
import pytest
from helixframe.llm import decontaminate, exact_dedup, language, mixing, packing, pii, quality, repeats, simhash, warc, common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 8000
PLAIN = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 1),
    (2, "THE quick brown fox jumps over the lazy dog and runs away from it", "en", "a", 1),
    (3, "le chat est sur la table et le chien dort dans la maison de campagne", "fr", None, 1),
    (4, None, "en", "b", None),
    (5, "", None, "b", 0),
    (6, "   \t\n ", "en", "b", 0),
    (7, LONG, "en", "a", 1),
    (7, LONG, "en", "a", 1),
    (None, "a text without any id but with some words in it", None, None, None),
    (None, None, None, None, None),
    (9, "x", "en", "c", 1),
    (10, "1234 5678", "en", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(PLAIN, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Extra columns named as the operators name theirs."""
    names = ["digest", "keep_id", "kept", "fp", "component_id", "size", "target", "taken", "score", "lang_pred", "__salt", "th", "did", "base", "__key", "__first", "__hash", "__row", "__copy", "__passes", "shard", "slot", "c0", "c1"]
    return spark.createDataFrame([(*r, *["z"] * len(names)) for r in PLAIN], SCHEMA + "".join(f", {n} string" for n in names))


def items(spark, rows=((1, "the quick brown fox jumps over the lazy dog and runs"), (2, None), (3, "too short"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def labels(spark, docs):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (9, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


def index(spark):
    import uuid

    return exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}", 4)


RUNS = {
    "exact": lambda s, d: exact_dedup.deduplicate(d, index(s)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "simhash_lanes": lambda s, d: simhash.near_duplicates(d, 5, 8, 3, 35),
    "language": lambda s, d: language.identify(d),
    "pii": lambda s, d: pii.find(d),
    "repeats": lambda s, d: repeats.remove_repeats(d),
    "quality": lambda s, d: quality.classify(d, labels(s, d)),
    "mixing": lambda s, d: mixing.mix(d).taken(),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_document(spark, docs, odd, empty, name):
    assert RUNS[name](spark, docs).count() == len(PLAIN)
    assert RUNS[name](spark, odd).count() == len(PLAIN)
    assert RUNS[name](spark, empty).count() == 0


def test_exact_keeps_one_of_each_text(spark, docs):
    rows = exact_dedup.deduplicate(docs, index(spark)).collect()
    assert sum(r.kept for r in rows) == len({(t or "").lower() for _, t, *_ in PLAIN})
    assert {(r.doc_id, r.keep_id) for r in rows if r.doc_id in (1, 2)} == {(1, 2), (2, 2)}
    assert sorted(r.group_size for r in rows if r.doc_id == 4) == [3]


def test_exact_index_persists(spark, docs):
    ix = index(spark)
    exact_dedup.deduplicate(docs.where("doc_id = 1"), ix)
    again = {r.doc_id: r for r in exact_dedup.deduplicate(docs.where("doc_id in (2, 3)"), ix).collect()}
    assert (again[2].keep_id, again[2].kept, again[3].kept) == (1, False, True)
    assert ix.read().count() == 2


def test_index_stays_sorted(spark, monkeypatch):
    """Appends in many files are written anew; which rows are kept does not change, nor for equal rows."""
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 2)
    ix = index(spark)
    for k in range(4):
        batch = spark.createDataFrame([(i % 7 or None, f"text {k} {i % 5}") for i in range(20)] + [(3, "text 0 0")] * 2, "doc_id long, text string")
        got = exact_dedup.deduplicate(batch, ix).collect()
        assert sum(r.kept for r in got) == 5
    assert ix.read().count() == 20 and ix.buckets() == 4
    assert len(ix.read().inputFiles()) <= 8
    ix.drop()
    assert not ix.exists()


def test_language_of_odd_texts(spark, docs):
    rows = {r.doc_id: r for r in language.identify(docs).collect()}
    assert rows[4].lang_pred == rows[5].lang_pred == rows[10].lang_pred == "und" and rows[4].score == 0.0
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_mixing_takes_at_most_three_times(spark, docs):
    rows = mixing.mix(docs, block=8).taken().collect()
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    assert all(r.taken == 0 for r in rows if not r.size)


def test_decontamination(spark, docs, odd, empty):
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items(spark)).collect()} == {(1, 1), (2, 1)}
    assert decontaminate.drop_leaks(odd, items(spark)).count() == len(PLAIN) - 2
    assert decontaminate.leaks(empty, items(spark)).count() == 0
    assert decontaminate.leaks(docs, items(spark, [])).count() == 0


def test_packing(spark, docs, odd, empty):
    tokens = sum(r.n_tokens for r in packing.pack(docs).collect())
    assert tokens == sum(len(packing.Tokenizer().encode(t)) for _, t, *_ in PLAIN) == sum(r.n_tokens for r in packing.pack(odd).collect())
    assert packing.pack(empty).count() == 0


def test_warc(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (2, "http://b", "same"), (3, "http://c\r\nX: y", None), (4, "http://d", ""), (None, None, "alone"), (5, "u", LONG)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = warc.archive_pages(pages, common.shared_path(spark, "t")).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "response", 0), (1, "revisit", 2), (2, "response", 0), (2, "response", 0), (3, "revisit", 4), (4, "response", 0), (5, "response", 0)]
    assert warc.archive_pages(pages.limit(0), common.shared_path(spark, "t")).count() == 0


def test_stages(spark, docs, odd, empty, tmp_path):
    items(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for table in (docs, odd, empty):
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns
            assert out.count() <= 3 * len(PLAIN)
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


def test_stage_keeps_one_of_each_group(spark, docs, tmp_path):
    got = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()
    ids = [r.doc_id for r in got]
    assert 1 in ids and 2 not in ids and ids.count(7) == 1 and 3 in ids and 9 in ids
    kept = corpus_pipeline.identify_language(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in kept} >= {1, 2, 3, 7, 9} and not {4, 5, 6, 10} & {r.doc_id for r in kept}


def test_stage_keeps_other_texts_of_an_id(spark, tmp_path):
    words = [[f"{a}{i}" for i in range(40)] for a in "pqr"]
    texts = [" ".join(w) for w in words]
    rows = [(7, texts[0]), (7, texts[1]), (7, texts[1]), (8, texts[1]), (9, texts[2]), (None, texts[2] + " end"), (None, None), (9, None)]
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], SCHEMA)
    got = [r.text for r in corpus_pipeline.drop_near_copies(spark, table, str(tmp_path)).collect()]
    assert sorted((t or "")[:2] for t in got) == ["", "p0", "q0", "r0"]


def test_samples_keep_their_limit(spark, monkeypatch):
    """Thousands of rows of one id, equal and different, do not exceed the bound on what the driver gets."""
    rows = [(1, "the same text over and over", "en")] * 3000 + [(1, f"text {i} of one id", "en") for i in range(3000)] + [(i, f"le texte {i}", "fr") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    got, real = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: got.append(real(self)) or got[-1])
    language.train(docs, 100)
    assert len(got[-1]) <= 200
    quality.train(docs.select("doc_id", "text"), spark.createDataFrame([(1, 1), (1, 0)] + [(i, i % 2) for i in range(50)], "doc_id long, quality int"), 20)
    assert len(got[-1]) <= 40
