"""One pass over the texts gives the words' weights and the mean length."""

from pyspark.sql import functions as F

from folioframe.operators import index as I
from folioframe.operators import search as S


def test_texts_are_read_once_for_counts_and_lengths(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def passed(text):
        seen.add(1)
        return text

    texts = ["a b b", "b c", "", None, " 12 a\n", "12"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    stats = I.doc_stats(chunks)
    want = {r["term"]: r["idf"] for r in I.with_idf(I.document_frequency(chunks), stats).collect()}
    mean = I.corpus_stats(stats).first()["avgdl"]
    queries = spark.createDataFrame([(1, "a b c 12 nowhere")], "query_id long, text string")
    S.bm25_search(queries, chunks.withColumn("text", passed("text")), 3)
    assert seen.value == len(texts)
    got = [tuple(r) for r in S.word_statistics(chunks).filter("idf IS NOT NULL").collect()]
    assert {t: i for t, i, _ in got} == want and {m for _, _, m in got} == {mean}
    # eight words in the five texts there are
    assert mean == 8 / 5
