"""The streamed queries search the whole lexicon."""

import pyarrow as pa
import pyarrow.parquet as pq

from phonosearch.operators.word_search import batch_search
from phonosearch.plans.build_queries import query_stream
from phonosearch.plans.search_queries import request_for
from phonosearch.plans.testdata import lexicon


def test_rare_words_are_found(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [1, 2], "text": ["zzz " * 200_000, "purchased purchaser click clicks"]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"event_type": ["purchase", "click"]}), tmp_path / "events.parquet")
    got = {(r.query, r.rank, r.word, r.score) for r in query_stream(spark, str(tmp_path)).collect()}
    found = batch_search(lexicon(spark, str(tmp_path)), {w: request_for(w, mode="native") for w in ("purchase", "click")}, 3).collect()
    assert got == {(r.query, r.rank, r.word, r.key) for r in found}
    assert {("purchase", "purchased"), ("purchase", "purchaser"), ("click", "clicks")} <= {(q, w) for q, _, w, _ in got}
