"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator and stage."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import (alignment, bpe, decontaminate, html_text, langid, licenses, lines, matroska, quality, queries, secrets, simhash,
                          suffix_array, vector_codes)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(12_000))
SAME = "the same words stand in both of these documents, line for line and word for word"
ROWS = [(1, SAME, "en"), (2, SAME, "en"), (2, SAME, "en"), (3, None, "en"), (4, "", None), (5, "   \n\t ", None), (None, SAME, "en"),
        (None, None, None), (6, LONG, "en"), (7, "!!! 123 ---", None), (8, "ñandú übergrößen 中文字 🎉 é", "es"), (9, "a", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "s", len(t) if t is not None else None) for i, t, g in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (None, "one two three four five six"), (4, "!!")],
                                 "item_id long, text string")


def clash(df):
    """The same rows with columns that the operators use inside."""
    names = ("fp", "id", "key", "node", "component", "u", "v", "h", "band", "size", "line_no", "norm", "first", "last", "other", "pos", "spans", "page", "host")
    return df.withColumns({n: F.lit(1) for n in names})


ROW_WISE = {
    "simhash": simhash.near_duplicates, "langid": langid.identify, "secrets": lambda d: secrets.digests(secrets.find(d)), "licenses": licenses.scan,
    "matroska": matroska.media_digests, "bpe": bpe.encode_decode, "lines": lines.line_report,
    "alignment": alignment.alignment, "quality": lambda d: quality.scored(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))),
}
STAGES = {name: f for name, f in corpus_pipeline.STAGES}


@pytest.mark.parametrize("name", ROW_WISE)
def test_one_row_for_each_row(name, docs):
    plain = ROW_WISE[name](docs)
    assert plain.count() == len(ROWS)
    other = ROW_WISE[name](clash(docs))
    assert other.columns == plain.columns and other.exceptAll(plain).count() == 0


@pytest.mark.parametrize("name", [*ROW_WISE, "suffix_array"])
def test_empty_table(name, docs):
    f = ROW_WISE.get(name, suffix_array.repeated_passages)
    assert f(docs.limit(0)).count() == 0


def test_simhash_of_nothing(docs):
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[(3, 0)] == got[(4, 0)] == got[(5, 0)] == got[(None, 0)] == 3
    same = {r.component_id for r in simhash.near_duplicates(docs).collect() if r.doc_id in (1, 2)}
    assert same == {1}


def test_wordless_texts(docs):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 7))
    assert all(0 <= r.score <= 1 and r.lang_pred != "und" for i, r in got.items() if i in (1, 6, 8, 9))
    assert {r.doc_id: r.n_tokens for r in bpe.encode_decode(docs).collect()}[4] == 0
    media = {r.doc_id: r for r in matroska.media_digests(docs).collect()}
    assert media[3].n_bytes == media[4].n_bytes == 0 and media[3].payload_bytes == 64 and media[3].media_sha256 == media[4].media_sha256


def test_nothing_labelled(docs):
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_passages_ignore_rows_without_id_and_repeats_of_one_document(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage + " a b c"), (1, passage), (None, passage), (2, "x " + passage + " y"), (3, " ".join(passage.split()[:49])), (4, None), (5, passage + " " + passage)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.first_word, r.end_word, r.other_doc_id) for r in suffix_array.repeated_passages(clash(d)).collect())
    assert got == [(1, 0, 60, 5), (2, 1, 61, 1), (5, 0, 120, 1)]
    long = d.withColumn("text", F.concat_ws(" ", F.lit(LONG), "text", F.lit(LONG)))
    assert {(r.doc_id, r.n_words > 24_000) for r in suffix_array.repeated_passages(long).collect()} >= {(1, True), (2, False), (5, True)}
    alone = d.where("doc_id = 5")
    assert suffix_array.repeated_passages(alone).count() == 0
    cleaned = {r.doc_id: r.text for r in suffix_array.remove_repeats(d.where("doc_id in (2, 3, 4)").union(d.where("doc_id = 1").limit(1))).collect()}
    assert cleaned[2] == "x  y" and cleaned[3] == rows[4][1] and cleaned[4] is None


def test_benchmark_edges(docs, benchmark):
    assert decontaminate.contamination(docs, benchmark).count() == 0
    assert decontaminate.contamination(docs.limit(0), benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == len(ROWS)
    hit = docs.sparkSession.createDataFrame([(1, "x one two Three, four five six. y"), (None, "alpha beta gamma delta epsilon zeta eta theta")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contamination(clash(hit), benchmark).collect()} == {(1, None), (None, 1)}


def test_page_edges(spark):
    page = "<html><body><nav>menu</nav><article><p>a &amp; b<br>c</p></article></body></html>"
    rows = [(1, "http://h/x", page), (1, "http://h/x", page), (2, None, None), (None, "", ""), (3, "u", "<p>plain"), (4, "u", "no markup at all")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract(clash(d.withColumn("text", F.lit("x"))).drop("spans")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a & b c", 7), (1, "a & b c", 7), (2, "", 0), (3, "plain", 5), (4, "no markup at all", 16)]
    assert html_text.extract(d.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_what_comes(name, spark, docs, sf_dir):
    out = STAGES[name](spark, docs, sf_dir)
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0
    if name != "bpe_encode_decode":
        assert out.columns == docs.columns and out.schema == docs.schema
        extra = STAGES[name](spark, clash(docs), sf_dir)
        assert extra.columns == clash(docs).columns
    assert out.count() <= len(ROWS)


def test_line_dedup_keeps_rows_and_null_texts(spark):
    rows = [(1, "one line of some length here\n\nkept in the first\nshort"), (2, "another text\none line of some length here"), (2, "another text\none line of some length here"),
            (3, None), (4, "ONE line of some length here "), (None, "one line of some length here"), (5, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    got = lines.dedup(d).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.text is not None) == sorted([
        (1, rows[0][1]), (2, "another text"), (2, "another text"), (4, ""), (0, rows[5][1]), (5, "")])
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got) and len(got) == len(rows)


def test_long_runs_neither_fail_nor_hang(spark):
    """Candidates, tags and pages of a megabyte that a pattern with recursion or a walk over all open elements would choke on."""
    path, tag = "a/1/" * 250_000 + " " + "ab/12/" * 1000 + "ab", "SPDX-License-Identifier: MIT" + " OR MIT" * 100_000
    d = spark.createDataFrame([(1, path), (2, tag), (3, "ISC OR " * 1000 + tag)], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.digests(secrets.find(d)).collect()} == {1: "", 2: "", 3: ""}
    assert {r.doc_id: r.licences for r in licenses.scan(d).collect()} == {1: "", 2: "MIT", 3: "MIT"}
    for page in ("<x>" * 300_000, "<p><table>" + "<x>" * 300_000, "<p><font>" * 100_000, "<ul>" + "<li><b>" * 150_000):
        assert html_text.parse(page + "end").text == ["end"]


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_alignment_of_what_has_no_tokens(spark):
    rows = [(1, None), (2, ""), (3, "a\u2581b"), (4, " "), (None, "a b"), (4, " ")]
    got = {r.doc_id: r for r in alignment.alignment(clash(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all((got[i].n_a, got[i].n_b, got[i].n_groups, got[i].count_sum, got[i].groups_sha256) == (0, 0, 0, 0, "") for i in (1, 2, 3))
    assert got[4].n_groups == 1 and got[4].count_sum == 2 and got[None].n_groups > 0


def test_quality_without_labels(docs):
    none = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert {(r.score, r.predicted) for r in quality.scored(docs, none).collect()} == {(0.5, 1)}
    assert quality.keep_good(clash(docs), none).count() == len(ROWS)
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    assert {r.predicted for r in quality.scored(docs, ones).collect()} == {1}


def test_vectors_that_cannot_be_coded(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 2.0, 3.0, 4.0], 1), (5, [1.0, 2.0, 3.0, 4.0], 1), (3, [-1.0, 0.5, -0.0001, 9.0], None), (None, [1.0, 2.0, 3.0, 5.0], None), (1, None, 1), (2, [nan, 1.0, 1.0, 1.0], 1),
            (7, [inf, 1.0, 1.0, 1.0], 1), (8, [1.0, None, 1.0, 1.0], 1), (9, [1.0, 2.0], 1), (10, [], 1)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = vector_codes.compress(d.withColumns({n: F.lit(1) for n in ("code", "error", "vector", "of", "label_error")})).collect()
    assert sorted((r.vec_id or 0, r.code, r.error, r.label_error) for r in got) == [
        (0, "01010101", 0, 0), (3, "00000000", 0, 0), (5, "01010102", 0, 0), (5, "01010102", 0, 0)]      # equal seeds part where a round moves one of them
    assert vector_codes.compress(d.limit(0)).count() == vector_codes.compress(d.where("vec_id in (1, 2)")).count() == 0
    assert [(r.code, r.error) for r in vector_codes.compress(d.where("vec_id = 10")).collect()] == [("00000000", 0)]
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 4, 1)], "vec_id long, embedding array<float>, label int")).count()


def test_score_is_a_number(docs):
    assert not any(math.isnan(r.score) for r in langid.identify(docs).collect())
