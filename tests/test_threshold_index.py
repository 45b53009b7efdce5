"""Look-ups in the threshold index against counting."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.operators import product as Z


def test_look_ups_equal_counts(spark):
    rng = random.Random(5)
    words = [("u", k, rng.choice([0.0, 1e-6, 2e-5, rng.random() / 1e4])) for k in range(40) for _ in range(k * 3 % 50)]
    frame = spark.createDataFrame(words, "user_id string, submission_id int, language_frequency double")
    index = Z.threshold_index(frame)
    for t in [0.0, 1e-6, 2e-5, 1.0, *(rng.random() / 1e4 for _ in range(6))]:
        found = {r.submission_id: r.n for r in index.select("submission_id", Z.words_below(F.col("frequencies"), t).alias("n")).collect()}
        assert found == {k: sum(f < t for _, j, f in words if j == k) for k in {j for _, j, _ in words}}
    empty = spark.createDataFrame([([],)], "f array<double>")
    assert empty.select(Z.words_below(F.col("f"), 1.0).alias("n")).first().n == 0
