"""The language model stores every trigram and every pair of its training texts."""

import pytest

from phonosearch.llm import kneser_ney


@pytest.mark.parametrize("hot", [1.0, 0.1])
def test_trigrams_and_pairs_seen_once_are_stored(spark, hot):
    texts = ["a b c d", "a b e", "f g", "c d a b"]
    df = spark.createDataFrame([(i, t) for i, t in zip([i for i in range(50) if not kneser_ney.held_out_crc(i)], texts)], "doc_id bigint, text string")
    model = kneser_ney.train(df, shards=3, hot=hot)
    words = [["<s>", "<s>", *t.split(), "</s>"] for t in texts]
    stored = lambda kind: sum(n for tables in model[kind].values() for n, _ in tables)
    assert stored("tri") == len({x for w in words for x in zip(w, w[1:], w[2:])})
    assert stored("bi") + stored("hot") == model["pairs"] == len({x for w in words for x in zip(w[1:], w[2:])})
    kneser_ney.remove(model)
