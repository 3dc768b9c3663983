"""The service's verbs, errors, time-out, cancelling and caches."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from phonosearch.operators import topic
from phonosearch.operators.service import SearchError, SearchService, phonetic_key
from phonosearch.plans.request import Request, proportional
from phonosearch.sources import store
from test_search import EDGES, LINK, lexicon, request, units


def code_of(call, *args, **more):
    with pytest.raises(SearchError) as e:
        call(*args, **more)
    return e.value.code


def with_topics(spark):
    lex = lexicon(spark).withColumn("topic_row", F.when(F.col("word") == "tuna", -1).otherwise(F.col("word_id")).cast("bigint"))
    table = topic.vectors(spark.createDataFrame([(i, [1.0, float(i), 0.5]) for i in range(5)], "vec_id int, embedding array<double>"))
    return SearchService(lambda: lex, topics=lambda: table)


def test_verbs(spark):
    pairs = spark.createDataFrame(EDGES, "first int, second int")
    service = SearchService(lambda: lexicon(spark), lambda: pairs, lambda: units(spark))
    assert service.handle({"type": "init"}) == {"ko": 3, "en": 2}
    found = service.handle({"type": "resolve", "text": "가나"})
    assert found["native"] == list("kana") and found["sources"] == ["lexicon"] and code_of(service.handle, {"type": "resolve", "text": "?"}) == "no_pronunciation"
    number, rows = service.handle({"type": "linked", "request": LINK, "which": "ko", "layers": ("ko",)})
    assert rows[0].display == "사[가 나]비" and rows[0].rank == 1 and rows[0].split_label == "가 / 나"
    assert [r.rank for r in service.handle({"type": "page", "number": number, "offset": 1, "count": 1})] == [2]
    raw = service.raw["linked"]
    from dataclasses import replace

    service.linked(replace(LINK, frequency_weight=9.0), "ko", ("ko",))
    assert service.raw["linked"] is raw  # ranked again, not collected again
    assert code_of(service.linked, Request("k", ("k",)), "ko", ("ko",)) == "no_splits"
    assert code_of(SearchService(lambda: lexicon(spark)).linked, LINK, "ko", ("ko",)) == "asset_unavailable"
    assert code_of(service.page, 999) == "stale_results"


def test_topics(spark):
    service = with_topics(spark)
    number, rows = service.search(request(topic_weight=8.0), "가나")
    assert {r.word for r in rows} == {"가나", "다나", "기니", "canna"} & {r.word for r in rows} and not service.missing_topic(number) and rows
    number, rows = service.search(request(topic_weight=8.0), "tuna")
    assert service.missing_topic(number) and "tuna" in {r.word for r in rows}
    assert code_of(SearchService(lambda: lexicon(spark)).search, request(), "가나") == "asset_unavailable"


def test_scores_are_kept_by_all_that_decides_them(spark):
    one, other = request(transfer=proportional), request(transfer=lambda d, s, t: [9.0] * len(t))
    assert phonetic_key(one) != phonetic_key(other) and phonetic_key(one) == phonetic_key(request(transfer=proportional, frequency_weight=3.0))
    assert phonetic_key(request(is_vowel=lambda p: True)) != phonetic_key(request())


def test_a_page_may_be_asked_at_any_time(spark):
    service = SearchService(lambda: lexicon(spark))
    number, rows = service.search(request())
    service.silence = 0.2
    time.sleep(0.5)
    assert service.page(number, 0)[0].word == rows[0].word


def slow(spark, seconds):
    @F.udf("string")
    def wait(w):
        time.sleep(seconds)
        return w

    return lexicon(spark).repartition(1).withColumn("word", wait.asNondeterministic()("word"))


def test_silence_of_a_running_search_ends_it(spark):
    service = SearchService(lambda: slow(spark, 20), silence=1.0)
    began = time.monotonic()
    assert code_of(service.search, request()) == "search_timeout" and time.monotonic() - began < 15


@pytest.mark.parametrize("code", ["search_cancelled", "search_superseded"])
def test_a_running_search_is_stopped(spark, code):
    service = SearchService(lambda: slow(spark, 20))
    got = []
    thread = threading.Thread(target=lambda: got.append(code_of(service.search, request())))
    thread.start()
    time.sleep(2)
    if code == "search_cancelled":
        service.cancel(service.job.number)
    else:
        service.begin()
    thread.join(15)
    assert got == [code]


def test_errors_of_assets_and_jobs(spark, tmp_path):
    def damaged():
        raise store.IntegrityError("digest")

    assert code_of(SearchService(damaged).search, request()) == "asset_integrity"
    assert code_of(SearchService(lambda: 1 / 0).search, request()) == "asset_unavailable"

    @F.udf("double")
    def fails(x):
        raise ValueError("no")

    broken = lexicon(spark).withColumn("zipf", fails.asNondeterministic()("zipf"))
    service = SearchService(lambda: broken)
    assert code_of(service.search, request()) == "word_worker_failed"
    assert code_of(service.handle, {"type": "x"}) == "unsupported_message"
