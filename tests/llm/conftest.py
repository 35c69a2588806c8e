import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


@pytest.fixture(scope="session")
def planted(spark, documents):
    """The smallest documents with rows planted beside them: nulls, empty and very long texts, copies, near copies, shared passages, and columns with clashing names."""
    base = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents.orderBy("doc_id").collect()]
    top = max(b[0] for b in base)
    long_text = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(60))
    a = " ".join(f"n{i}" for i in range(200))
    extra = [None, "", " \t\n ", "one", "ONE", "two words", long_text, long_text + " tail", passage, f"lead {passage} end", f"{passage} {passage}", a, a.replace("n100", "zz"), a.upper(), "É É É é", "İstanbul ß ﬁ", "x y 　z", "\x1c\x1d a b c", "a\x0bb\x0cc d", " line a b c"]
    rows = base + [(top + 1 + i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src0") for i, t in enumerate(extra)]
    rows += [(top + 100 + i, f"Posted by user{i} at {i}:30 with {'abc'[i % 3]} replies\nbody {i} words that differ {i * 7}\nSubscribe to our news letter today please", "en", "src1") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.withColumns({c: F.lit("clash") for c in ("digest", "_h", "part", "chunk", "_m", "n", "size", "cluster", "value", "a", "b", "ids")}).repartition(7).cache()


@pytest.fixture(scope="session")
def pairs(planted):
    return [(r["doc_id"], r["text"]) for r in planted.select("doc_id", "text").collect()]
