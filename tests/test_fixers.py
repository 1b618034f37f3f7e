"""The rewriters leave fenced code and what needs no change alone."""

from pyspark.sql import functions as F

from siltstone.operators import fixers


def test_fixers(spark):
    texts = [
        ("In order to run, make use of x. It IS ABLE TO y.", "To run, use x. It Can y."),
        ("a\n```\nin order to\n```\nprior to b `due to the fact that`", "a\n```\nin order to\n```\nbefore b `because`"),
        ("", ""),
        (None, None),
        ("```open in order to", "```open to"),
    ]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, text string, want string")
    assert all(r.got == r.want for r in df.select("want", fixers.concise(F.col("text")).alias("got")).collect())
    loud = [("NEVER use the API!!! A_CAPS X2Y AB", "Never use the API! A_CAPS X2Y AB"), ("```\nNEVER\n``` STOP", "```\nNEVER\n``` Stop"), (None, None)]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(loud)], "i int, text string, want string")
    assert all(r.got == r.want for r in df.select("want", fixers.calm(F.col("text")).alias("got")).collect())
