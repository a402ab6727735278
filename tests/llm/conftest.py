import pytest
from pyspark.sql import functions as F

#: Columns whose names operators use within, to be carried or left unread.
CLASHING = ("fp", "key", "own", "size", "digest", "text_hash", "w", "epoch", "_drop_id", "_overlap_id", "tokens")


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows, clash=False):
        """rows of (doc_id, text[, lang, source])"""
        full = [(*r, *(None, None)[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        if clash:
            df = df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASHING)))
        return df

    return make
