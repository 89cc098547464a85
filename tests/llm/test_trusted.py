"""What makes up the trusted target of the quality rules."""

from sparkweave.llm import quality_rules


def test_a_document_with_a_line_twice_is_not_trusted(spark):
    words = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    once = "\n".join([" ".join(words[:20]), " ", " ", " ".join(words[20:])])
    twice = "\n".join([" ".join(words), "the same line", "the same line"])
    docs = spark.createDataFrame([(1, once), (2, twice)], "doc_id long, text string")
    worded = quality_rules.with_words(docs)
    found = worded.select("doc_id", quality_rules.trusted(worded).alias("t")).collect()
    assert {r.doc_id: r.t for r in found} == {1: True, 2: False}
