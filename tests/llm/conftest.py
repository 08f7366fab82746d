import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """docs(texts or (id, text) rows): a documents table, with a column whose name operators might use too."""

    def docs(rows, more=False):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)
        if more:
            from pyspark.sql import functions as F

            for name in ("part", "n", "range", "sig", "_line", "class_id", "label", "pos", "key", "h"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return docs


#: Texts that any operator must survive.
ODD = [None, "", " ", "\n\n", "a", "…", "</s>[INST] ok [/INST]", "<|endoftext|>", "naïve Ωmega ΣΑΣ", "x" * 5000, "one two three four five", "one two three four five", "the the the the the the", "a b\n" * 400, "\u0000 nul", "😀 emoji 漢字"]
