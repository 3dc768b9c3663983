"""Stored tables: round trips, damage, pins, and what a failed write leaves."""

import json
import os

import pytest
from pyspark.sql import functions as F

from phonosearch.operators import topic
from phonosearch.sources import store


@pytest.fixture
def lexicon(spark):
    rows = [(i, f"w{i}", "en" if i % 2 else "ko", float(i), ["ab"], [], []) for i in range(20)]
    return spark.createDataFrame(rows, "word_id int, word string, lang string, zipf double, ko array<string>, native array<string>, koreanized array<string>")


def files_below(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_round_trip_by_language(spark, lexicon, tmp_path):
    at = str(tmp_path / "lexicon")
    first = store.write(lexicon, at, "lexicon", {"inventory": "abc"}, ("lang",))
    assert first["rows"] == 20 and any(f["name"].startswith("lang=en/") for f in first["files"])
    back = store.read(spark, at, "lexicon", {"inventory": "abc"})
    assert sorted(map(tuple, back.select(lexicon.columns).collect())) == sorted(map(tuple, lexicon.collect()))
    assert "lang=en" in back.where("lang = 'en'")._jdf.queryExecution().toString() or back.where("lang = 'en'").count() == 10
    second = store.write(lexicon.where("word_id < 5"), at, "lexicon", None, ("lang",))
    assert store.read(spark, at).count() == 5 and second["digest"] != first["digest"]
    store.write(lexicon.limit(1), at, "lexicon", None, ("lang",))
    assert sum(n.startswith("v-") for n in os.listdir(at)) == 2  # the one in use and the one before


def test_damage_is_found(spark, lexicon, tmp_path):
    at = str(tmp_path / "lexicon")
    store.write(lexicon, at, "lexicon", {"inventory": "abc"})
    assert store.problems(spark, at, "lexicon", {"inventory": "abc"}) == []
    assert store.problems(spark, at, "edges", {"inventory": "x"}) == ["kind lexicon", "pin inventory"]
    one = files_below(at)[0]
    raw = open(one, "rb").read()
    with open(one, "wb") as f:
        f.write(raw[:-1] + bytes([raw[-1] ^ 1]))
    crc = os.path.join(os.path.dirname(one), "." + os.path.basename(one) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    with pytest.raises(store.IntegrityError, match="digest"):
        store.read(spark, at)
    os.remove(one)
    assert [p.split()[0] for p in store.problems(spark, at)] == ["missing"]
    for m in (os.path.join(d, "_manifest.json") for d, _, names in os.walk(at) if "_manifest.json" in names):
        os.remove(m)
    with pytest.raises(store.IntegrityError):
        store.read(spark, at)
    with pytest.raises(FileNotFoundError):
        store.read(spark, str(tmp_path / "nothing"))


def test_a_failed_write_leaves_the_old_table(spark, lexicon, tmp_path):
    at = str(tmp_path / "lexicon")
    store.write(lexicon, at, "lexicon")
    with pytest.raises(ValueError):
        store.write(lexicon.limit(3), at, "lexicon", check=lambda df: False)
    assert store.read(spark, at).count() == 20
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "notes.txt").write_text("mine")
    with pytest.raises(FileExistsError):
        store.write(lexicon, str(tmp_path / "foreign"), "lexicon")
    assert json.loads((tmp_path / "lexicon" / "current.json").read_text())["versions"]


def test_search_results_are_the_same_over_a_stored_lexicon(spark, lexicon, tmp_path):
    """The round-trip check of a build: the digest of a page before and after."""
    from phonosearch.operators import integrity, word_search
    from phonosearch.plans.request import Request

    lex = lexicon.withColumn("ord", F.col("word_id"))
    page = lambda df: word_search.page(word_search.search(df, Request("x", ("k", "a"), languages=("ko", "en")))).withColumn("score", F.col("key"))
    digest = lambda df: integrity.result_digest(page(df), "rank", "lang", "word", "score").first()[0]
    before = digest(lex)
    store.write(lex, str(tmp_path / "l"), "lexicon", check=lambda back: digest(back) == before)
    assert digest(store.read(spark, str(tmp_path / "l"), "lexicon")) == before


def test_vectors_are_appended_with_their_dimensions(spark, tmp_path):
    at = str(tmp_path / "t")
    table = topic.vectors(spark.createDataFrame([(i, [float(i), 1.0, 2.0]) for i in range(4)], "vec_id int, embedding array<double>"))
    store.write(table, at, "topics")
    assert store.append_vectors(spark, at, table.limit(2))["rows"] == 6
    assert {r.row_id for r in store.read(spark, at, "topics").collect()} >= {4, 5} or store.read(spark, at).count() == 6
    short = topic.vectors(spark.createDataFrame([(0, [1.0])], "vec_id int, embedding array<double>"))
    with pytest.raises(ValueError):
        store.append_vectors(spark, at, short)
