"""Line dedup counts the words of a run only as far as the limit asks."""
from pyspark.sql import functions as F

from auditlens.llm import line_dedup


def test_words_are_counted_no_further_than_asked(spark):
    texts = ["", " ", "a", " a b ", "a b c", "\t a  b\nc ", "a b c d e"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for n in (1, 2, 3, 4):
        got = [r.x for r in df.select(line_dedup._has_words(F.col("text"), n).alias("x")).collect()]
        assert got == [len(t.split()) >= n for t in texts]
