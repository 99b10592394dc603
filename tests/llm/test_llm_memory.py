"""What a task holds at once where its rows are large."""

from pyspark.sql import functions as F

from driftgrid.llm import alignment, queries


def test_blocks_of_tokens_are_read_a_few_at_a_time(spark, sf_dir, monkeypatch):
    """A block is most of a megabyte; Spark reads 4,096 rows at once, which was the whole file of a task."""
    seen, key = {}, "spark.sql.parquet.columnarReaderBatchSize"
    real = alignment.written

    def noted(df, name, *args, **options):
        seen[name] = (int(spark.conf.get(key)), options)
        return real(df, name, *args, **options)

    monkeypatch.setattr(alignment, "written", noted)
    before = spark.conf.get(key)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.substring("text", 1, 200).alias("text"))
    assert alignment.align_documents(docs, queries.TOKENIZER, queries.PIECES).count() == docs.count()
    assert seen["pair-totals"][0] <= 64 and seen["alignment"][0] <= 64 and spark.conf.get(key) == before
    assert int(seen["aligned"][1]["parquet.block.size"]) <= 1 << 25
