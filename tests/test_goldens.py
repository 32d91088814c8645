"""Hand-written rows for rules that are easy to get wrong."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from folioframe.functions import ids
from folioframe.functions import text as X
from folioframe.operators import chunk, clean, evaluate, evidence, index, pack, resolve, search
from folioframe.sources import feeds, files


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in df.select("i", make(F.col("v")).alias("r")).orderBy("i").collect()]


def test_doi(spark):
    values = ["https://doi.org/10.1000/ABC.", "doi:10.1/x", "http://dx.doi.org/10.1000/x", " ", None, "DOI:10.12345/a b", "dx.doi.org/10.1000/q,;"]
    assert column(spark, values, ids.doi) == ["10.1000/abc", None, "10.1000/x", None, None, None, "10.1000/q"]


def test_arxiv_pmid_openalex_year(spark):
    assert column(spark, ["arXiv:2101.00001v2", "https://arxiv.org/abs/hep-th/9901001?x=1", "abc", "2101.00001#s"], ids.arxiv) == [
        "2101.00001", "hep-th/9901001", None, "2101.00001"]
    assert column(spark, ["pmid:123", "PMID 12a", "https://pubmed.ncbi.nlm.nih.gov/77/"], ids.pmid) == ["123", None, "77"]
    assert column(spark, ["https://openalex.org/w12", "W5/", "A1"], ids.openalex) == ["W12", "W5", None]
    assert column(spark, ["2020-05-01", "c. 1999", "0999", "2101", "x2020"], ids.year) == [2020, 1999, None, None, None]


def test_inverted_index_and_dates(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},)], "m map<string, array<int>>")
    assert df.select(feeds.abstract_from_inverted_index(F.col("m"))).first()[0] == "a b a"
    parts = [[[2020]], [[2020, 5]], [[2020, 5, 7]], [[2020, 13]], [[]], None]
    assert column(spark, parts, feeds.date_from_parts, "array<array<int>>") == [
        datetime.date(2020, 1, 1), datetime.date(2020, 5, 1), datetime.date(2020, 5, 7), None, None, None]


def test_feed_files(spark, tmp_path):
    work = {"id": "https://openalex.org/W1", "title": " A ", "doi": "https://doi.org/10.1000/x", "publication_date": "2020-01-02", "cited_by_count": 3,
            "authorships": [{"author": {"display_name": "Ann"}}, {"author": {}}], "abstract_inverted_index": {"two": [1], "one": [0]},
            "primary_location": {"source": {"display_name": "J", "type": "journal"}}, "best_oa_location": None, "locations": [{"pdf_url": None}, {"pdf_url": "u"}]}
    (tmp_path / "o.json").write_text(json.dumps(work) + "\n" + json.dumps({"title": "no id"}) + "\n")
    row = feeds.read_openalex(spark, str(tmp_path / "o.json")).collect()
    assert len(row) == 1 and row[0]["provider_id"] == "W1" and row[0]["authors"] == ["Ann"] and row[0]["abstract"] == "one two" and row[0]["pdf_url"] == "u"
    (tmp_path / "c.json").write_text(json.dumps({"DOI": "10.1000/x", "title": ["T"], "author": [{"given": "A", "family": "B"}], "issued": {"date-parts": [[2021, 2]]}, "abstract": "<p>x</p>"}))
    row = feeds.read_crossref(spark, str(tmp_path / "c.json")).first()
    assert (row["title"], row["authors"], row["published"], row["abstract"]) == ("T", ["A B"], datetime.date(2021, 2, 1), "x")
    (tmp_path / "s.json").write_text(json.dumps({"paperId": "p", "title": "T", "year": 1999, "publicationDate": "?", "venue": "V"}))
    row = feeds.read_semantic_scholar(spark, str(tmp_path / "s.json")).first()
    assert (row["published"], row["journal"]) == (datetime.date(1999, 1, 1), "V")
    (tmp_path / "a.xml").write_text(
        '<feed><entry><id>http://arxiv.org/abs/2101.1v1</id><title>A\n B</title><published>2021-01-01T00:00:00Z</published><author><name>N</name></author>'
        '<category term="cs"/><link href="http://x/abs/1" type="text/html"/><link title="pdf" href="http://x/pdf/1" type="application/pdf"/></entry></feed>')
    row = feeds.read_arxiv_atom(spark, str(tmp_path / "a.xml")).first()
    assert (row["provider_id"], row["title"], row["venue"], row["pdf_url"]) == ("2101.1v1", "A B", "cs", "http://x/pdf/1")


def test_files_and_corpus(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.TXT").write_text("hello")
    row = files.scan_files(spark, str(tmp_path / "in")).first()
    assert (row["file_name"], row["file_extension"], row["file_size"]) == ("a.TXT", ".txt", 5)
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(100)], "chunk_id long, text string")
    out = str(tmp_path / "corpus")
    files.write_corpus(rows, out, "chunk_id", 8)
    files.write_corpus(rows, out, "chunk_id", 8)
    assert spark.read.parquet(out).count() == 100
    files.upsert_corpus(spark.createDataFrame([(5, "new"), (500, "more")], "chunk_id long, text string"), out, "chunk_id", 8)
    back = {r["chunk_id"]: r["text"] for r in spark.read.parquet(out).collect()}
    assert len(back) == 101 and back[5] == "new" and back[6] == "t6" and back[500] == "more"


def test_clean_text_folds_compatibility_forms(spark):
    assert column(spark, ["ﬁne  \t x\n\n\n\ny\x00", "plain  a", None], clean.clean_text) == ["fine x\n\ny", "plain a", None]
    assert column(spark, [" a \r\n\r\n\r\n b "], clean.normalize_lines) == ["a\n\nb"]


def test_headings(spark):
    text = "# A\n1.2 B\ntext\n"
    df = spark.createDataFrame([(1, text)], "document_id int, text string")
    got = [(r["line"], r["level"], r["number"], r["title"]) for r in chunk.detect_headers(df).orderBy("line").collect()]
    assert got == [(0, 1, None, "A"), (1, 2, "1.2", "B")]
    paper = "before\nAbstract\nAn abstract line.\n1 Introduction\nSome text here.\n\nMore text.\nReferences\n"
    df = spark.createDataFrame([(1, paper)], "document_id int, text string")
    sections = [(r["title"], r["level"], r["content"]) for r in chunk.parse_sections(df).orderBy("section_index").collect()]
    assert sections == [("Document", 1, "before"), ("Abstract", 1, "An abstract line."), ("1 Introduction", 1, "Some text here.\nMore text."), ("References", 1, "")]
    blocks = [(r["chunk_type"], r["text"], r["section_title"]) for r in chunk.structural_chunks(df).orderBy("chunk_index").collect()]
    assert blocks == [("structural", "before", None), ("heading", "Abstract", "Abstract"), ("structural", "An abstract line.", "Abstract"), ("heading", "Introduction", "Introduction"),
                      ("structural", "Some text here.", "Introduction"), ("structural", "More text.", "Introduction"), ("heading", "References", "References")]


@pytest.mark.parametrize("words, sizes", [(0, []), (1, [1]), (500, [500, 100]), (501, [500, 101]), (900, [500, 500, 100])])
def test_fixed_chunks(spark, words, sizes):
    df = spark.createDataFrame([(1, " ".join(["w"] * words))], "document_id int, text string")
    assert [r["token_count"] for r in chunk.fixed_chunks(df).orderBy("chunk_index").collect()] == sizes


def test_fixed_chunks_refuse_endless_overlap(spark):
    with pytest.raises(ValueError):
        chunk.fixed_chunks(spark.createDataFrame([(1, "a")], "document_id int, text string"), 10, 10)


def test_semantic_chunks_keep_every_word(spark):
    text = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(n)) + "." for i, n in enumerate((3, 40, 700, 5, 90, 200, 200, 1)))
    df = spark.createDataFrame([(1, text), (2, " ")], "document_id int, text string")
    pieces = [r["text"] for r in chunk.semantic_chunks(df, 200, 0, 20).orderBy("chunk_index").collect()]
    assert " ".join(pieces).split() == text.split()
    assert all(int(len(p.split()) * 1.3) <= 260 for p in pieces)
    rows = chunk.semantic_chunks(df, 200, 50, 20).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and {r["document_id"] for r in rows} == {1}


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, 3.0, 3000), (1, 2, 2.0, 2000), (1, 3, 1.0, 1000)], "query_id int, chunk_id int, score double, tokens int")
    got = {r["chunk_id"]: r["kept"] for r in pack.pack_budget(df, 4096).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_scaling_of_constant_and_single_scores(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.0), (2, 1, 3.0)], "query_id int, chunk_id int, score double")
    for kind, value in (("minmax", 1.0), ("zscore", 0.0), ("percent", 100.0)):
        assert {r["normalized"] for r in search.normalize_scores(df, kind).collect()} == {value}


def test_repeated_id_in_a_run_counts_once(spark):
    df = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3)], "query_id int, chunk_id int, rank int")
    got = {r["chunk_id"]: r["score"] for r in search.rrf_fuse([df]).collect()}
    assert got == {7: round(1 / 61, 6), 8: round(1 / 63, 6)}


def test_citation_markers(spark):
    answers = spark.createDataFrame([(1, "a [E1, E02] b"), (2, "x [E9]."), (3, "none")], "query_id int, answer string")
    held = spark.createDataFrame([(q, e) for q in (1, 2, 3) for e in ("E1", "E2", "E3")], "query_id int, evidence_id string")
    got = {r["query_id"]: (r["valid_ids"], r["invalid_ids"], r["missing_ids"], r["valid"]) for r in evidence.validate_citations(answers, held).collect()}
    assert got == {1: ("E1,E2", "", "E3", True), 2: ("", "E9", "E1,E2,E3", False), 3: ("", "", "E1,E2,E3", False)}
    stripped = {r["query_id"]: r["answer"] for r in evidence.strip_invalid_citations(answers, held).collect()}
    assert stripped == {1: "a [E1, E2] b", 2: "x .", 3: "none"}


def test_hallucination_edges(spark):
    qa = spark.createDataFrame([(1, "q", ""), (2, "q", "one two three four five"), (3, "q", "alpha beta gamma delta epsilon. tiny bit"), (4, "q", "short")], "query_id int, question string, answer string")
    ev = spark.createDataFrame([(1, "alpha"), (3, "alpha beta gamma"), (4, "words")], "query_id int, text string")
    got = {r["query_id"]: (r["hallucination"], r["supported_ratio"], r["has_hallucinations"]) for r in evaluate.hallucination(qa, ev).collect()}
    assert got == {1: (1.0, 0.0, True), 2: (1.0, 0.0, True), 3: (0.0, 1.0, False), 4: (0.0, 0.0, False)}


def test_squashed_scores(spark):
    values = [0.5, -0.5, 3.0, float("nan"), float("inf"), None]
    assert column(spark, values, search.squashed, "double") == [0.5, 0.25, 0.75, 0.0, 0.0, 0.0]


def test_model_hooks(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, "aa"), (2, "b")], "chunk_id long, text string")
    made = {r["chunk_id"]: r["embedding"] for r in index.embed_with_model(rows, lambda: lambda ts: np.array([[len(t), 0.0] for t in ts]), 2).collect()}
    assert made == {1: [1.0, 0.0], 2: [1.0, 0.0]}
    with pytest.raises(Exception, match="not finite"):
        index.embed_with_model(rows, lambda: lambda ts: np.full((len(ts), 2), np.nan), 2).collect()


def test_empty_text_is_its_own_opening(spark):
    df = spark.createDataFrame([(1, 1, ""), (1, 2, ""), (1, 3, "a"), (2, 1, "a")], "query_id int, chunk_id int, text string")
    assert {r["query_id"]: r["diversity"] for r in resolve.prefix_diversity(df).collect()} == {1: 1.0, 2: 1.0}


def test_term_boundaries(spark):
    df = spark.createDataFrame([("c++ code", "c++"), ("abc++", "c++"), ("a.b", "a.b"), ("axb", "a.b")], "t string, w string")
    assert [r[0] for r in df.select(X.has_term(F.col("t"), F.col("w"))).collect()] == [True, False, True, False]


def test_semantic_chunks_overlap_windows_and_small_pieces(spark):
    text = "a b c. d e f. g h i. j k l m n o p q r s t u v w x y z. one. two."
    rows = chunk.semantic_chunks(spark.createDataFrame([("x", text)], "document_id string, text string"), 8, 4, 2).orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == [
        "a b c. d e f.", "d e f. g h i.", "j k l m n o p q", "r s t u v w x y", "z.", "one. two."]


def test_records_of_one_batch_meet_on_weak_ids(spark):
    from folioframe.operators import resolve

    columns = "arrival long, provider string, provider_id string, doi string, arxiv_id string, pmid string, title string, published string"
    rows = [(1, "crossref", "a", "10.1/x", "2101.00001", None, "T", "2020"), (2, "crossref", "b", "10.1/y", "2101.00001", None, "T", "2020"),
            (3, "crossref", "c", "10.1/z", None, "77", "U", "2020"), (4, "crossref", "d", "10.1/w", None, None, "V", "2020")]
    batch = resolve.with_identity(spark.createDataFrame(rows, columns).withColumn("year", F.lit(2020)))
    store = batch.filter("arrival = 3").withColumn("arrival", F.lit(100).cast("long")).withColumn("doi", F.lit(None).cast("string"))
    merged, actions = resolve.upsert_papers(batch, store.limit(0))
    assert {r["record"]: r["action"] for r in actions.collect()} == {1: "created", 2: "duplicate", 3: "created", 4: "created"}
    assert {r["record"]: r["action"] for r in resolve.upsert_papers(batch, store)[1].collect()} == {1: "created", 2: "duplicate", 3: "duplicate", 4: "created"}
    assert merged.count() == 3


def test_search_takes_ids_of_any_type(spark):
    from folioframe.operators import search

    texts = [(i, f"w{i} w{i % 7} common words here w{i % 3}") for i in range(40)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").withColumn("metadata", F.create_map(F.lit("a"), F.lit("b")))
    queries = spark.createDataFrame([(1, "w3 common"), (2, "w5 w2 words")], "query_id long, text string")
    named = chunks.withColumn("chunk_id", F.format_string("c%03d", "chunk_id"))
    asked = queries.withColumn("query_id", F.format_string("q%d", "query_id"))
    plain = search.hybrid_search(queries, chunks, 5).collect()
    other = search.hybrid_search(asked, named, 5).collect()
    assert {(f"q{r.query_id}", f"c{r.chunk_id:03d}", r["rank"], r.rerank_score) for r in plain} == {
        (r.query_id, r.chunk_id, r["rank"], r.rerank_score) for r in other}
