import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from texts (ids in order) or from (id, text) pairs, with a clashing extra column."""
    from pyspark.sql import functions as F

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({"lang": F.lit("en"), "n": F.lit(1), "kept": F.lit("x"), "text_key": F.lit("y"), "fp": F.lit(0), "_score": F.lit(2), "_digest": F.lit("d"), "_KEY_ID": F.lit(1), "_key_digest": F.lit(1), "_leak": F.lit(0), "shards": F.lit(1)})

    return make
