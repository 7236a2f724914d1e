"""The quality stage judges rows, not ids."""

from glyphsieve.llm import quality_rules

CLEAN = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120))


def test_null_and_repeated_ids(spark, labels, tmp_path):
    rows = [(None, CLEAN), (None, "too short"), (1, CLEAN + " one"), (1, "short as well"), (2, CLEAN + " two"), (None, None)]
    made = spark.createDataFrame(rows, "doc_id bigint, text string")
    path = str(tmp_path / "documents.parquet")
    made.repartition(2).write.parquet(path)
    for docs in (made, spark.read.parquet(path)):
        kept = quality_rules.keep(docs, labels.limit(0))
        assert kept.columns == docs.columns
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)
