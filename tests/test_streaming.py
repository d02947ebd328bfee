"""A stream of queries finds what a table of them does."""

import random

from helixframe.operators.matches import maximal_matches
from helixframe.streaming.matching import matched_stream


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    refs = spark.createDataFrame([("r", word(300), 300)], "seq_id string, seq string, len long")
    rows = [(f"q{i}", s := word(20) + refs.first().seq[i * 20 : i * 20 + 30], len(s)) for i in range(8)]
    queries = spark.createDataFrame(rows, "seq_id string, seq string, len long")
    for part in range(2):
        queries.filter(f"int(substring(seq_id, 2)) % 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    matched_stream(stream, refs, str(tmp_path / "out"), str(tmp_path / "ck"), 12).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, maximal_matches(refs, queries, 12).collect()))
