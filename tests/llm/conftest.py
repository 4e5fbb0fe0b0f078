import pytest
from pyspark.sql import Row

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """From texts, or tuples of the columns, to a table of documents; an extra column has a name that operators use too."""

    def make(rows, extra=True):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (i, r)
            full.append((*r, *(None, None, None)[len(r) - 2 :]) if len(r) < 5 else r)
        df = spark.createDataFrame(full, DOC)
        if extra:
            from pyspark.sql import functions as F

            for name in ("size", "found", "label", "hash", "target"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
