"""Sources, lexicon building, events, topics, pronunciation and integrity."""

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonosearch.functions.inventory import CODES, decode, encode
from phonosearch.operators import build, events, g2p, integrity, topic
from phonosearch.operators.resolve import resolve
from phonosearch.sources import files


def test_events(spark):
    cases = [
        (list("kuk") + ["ʼ", "a"], ["k", "u", "k*", "a"], []), (["j", "i"], ["i"], []), (["w", "a"], ["wa"], []), (["m", "u", "ɾ"], ["m", "u", "l"], []), (["l", "a"], ["ɾ", "a"], []),
        (["q"], ["q"], ["q"]), ([], [], []), (["ʼ", "a"], ["ʼ", "a"], ["ʼ"]), (["j"], ["j"], ["j"]), (["j", "a", "j", "a"], ["ja", "ja"], []), (["d", "͡", "ʑ", "\u200b", "a", "l"], ["tɕ", "a", "l"], []),
        (["tʰ", "a"], ["tʰ", "a"], []), (["͡", "a", "a"], ["a͡a"], ["a͡a"]), (["q", "z", "q"], ["q", "z", "q"], ["q", "z"]),
    ]
    df = spark.createDataFrame([(i, e) for i, (e, _, _) in enumerate(cases)] + [(99, None)], "i int, e array<string>")
    got = {r.i: r.n for r in df.select("i", events.normalize(F.col("e")).alias("n")).collect()}
    assert [(got[i].phonemes, got[i].unknown) for i in range(len(cases))] == [(p, u) for _, p, u in cases] and got[99] is None


def test_codas(spark):
    cases = [
        ("국가", "k u k* a", "k u k k* a", 1, True), ("ab", "a a", "a a", 0, False), ("가가", "k a k* a", "k a k* a", 0, True), ("국국가", "k u k k* u k* a", "k u k k* u k k* a", 1, True),
        ("국가", "k u k k* a", "k u k k* a", 0, True), ("국", "k u k*", "k u k*", 0, True), ("국가", "k u k*", "k u k*", 0, False), ("", "", "", 0, False), ("각각각", "k* a k* a k* a k", "k* a k k* a k k* a k", 2, True),
    ]
    df = spark.createDataFrame([(i, w, p.split()) for i, (w, p, _, _, _) in enumerate(cases)] + [(99, None, ["a"])], "i int, w string, p array<string>")
    got = {r.i: r.n for r in df.select("i", events.restore_codas(F.col("w"), F.col("p")).alias("n")).collect()}
    assert [(" ".join(got[i].phonemes), got[i].restored, got[i].aligned) for i in range(len(cases))] == [x[2:] for x in cases] and got[99] is None


def test_sources(spark, tmp_path):
    (tmp_path / "raw.tsv").write_text("ko\t국가\tk|u|k|ʼ|a\nen\tx\t\n", encoding="utf-8")
    assert [tuple(r) for r in files.raw_events(spark, str(tmp_path / "raw.tsv")).collect()] == [("ko", "국가", ["k", "u", "k", "ʼ", "a"]), ("en", "x", [])]
    (tmp_path / "big.json").write_text(json.dumps({"entries": {"a": [["b", 3, 0.5], ["c", 1, 0.1]]}}))
    assert {tuple(r) for r in files.word_bigrams(spark, str(tmp_path / "big.json")).collect()} == {("a", "b", 3), ("a", "c", 1)}
    (tmp_path / "ko.json").write_text(json.dumps({"entries": {"가": ["가", [["나", 2, 0.1, "나다"], ["다", 1, 0.1]]]}}))
    (tmp_path / "bare.json").write_text(json.dumps({"가": [None, [["나", 2, 0.1]]]}))
    assert {tuple(r) for r in files.surface_bigrams(spark, str(tmp_path / "ko.json")).collect()} == {("가", "가", "나", 2, "나다"), ("가", "가", "다", 1, None)}
    assert [tuple(r) for r in files.surface_bigrams(spark, str(tmp_path / "bare.json")).collect()] == [("가", None, "나", 2, None)]
    (tmp_path / "loan.json").write_text(json.dumps({"love": ["러브", "로브"], "x": []}))
    assert dict(map(tuple, files.loanwords(spark, str(tmp_path / "loan.json")).collect())) == {"love": "러브", "x": None}
    (tmp_path / "p.json").write_text(json.dumps({"ko": {"가": "k a"}, "en": {}}))
    assert [tuple(r) for r in files.pronunciations(spark, str(tmp_path / "p.json"), "ko").collect()] == [("가", ["k", "a"])]
    (tmp_path / "d.json").write_text(json.dumps([{"word": "a", "lang": "en", "phonemes": ["a"], "zipf": None}]))
    assert files.dictionary(spark, str(tmp_path / "d.json")).first().phonemes == ["a"]


def test_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in build.first_wins(df, ["k"], F.col("o")).collect()} == {("a", "x"), ("b", None)}
    assert {(r.k, r.v) for r in build.last_wins(df, ["k"], F.col("o")).collect()} == {("a", "y"), ("b", None)}
    done = spark.createDataFrame([("a",)], "k string")
    assert [r.k for r in files.missing(df, done, "k").collect()] == ["b"]


def test_collation(spark):
    df = spark.createDataFrame(list(enumerate(["b", "a", "A", "나", "é", "가", "a"])), "word_id int, word string")
    got = [r.word for r in build.collated(df).orderBy("ord").collect()]
    assert got[:2] == ["가", "나"] and got[2:5] == ["a", "a", "A"] and got[-1] == "é"
    assert [r.ord for r in build.collated(df).orderBy("ord").collect()] == list(range(7))
    assert build.collated(df.limit(0)).count() == 0


def test_resolve(spark):
    rows = [(0, "사랑", "ko", [encode("s a ɾ a ŋ".split())], [], []), (1, "y2k", "en", [], [encode(["w"])], [encode(["u"])]), (2, "Love", "en", [], [], [encode(["l"])])]
    lex = spark.createDataFrame(rows, "word_id int, word string, lang string, ko array<string>, native array<string>, koreanized array<string>")
    q = spark.createDataFrame([(0, "사랑 LOVE"), (1, "123"), (2, "love 2 you y2k"), (3, "ㅋㅏ!"), (4, None), (5, "")], "query_id int, text string")
    got = {r.query_id: r for r in resolve(q, lex, CODES).collect()}
    assert decode(got[0].native) == "s a ɾ a ŋ l".split() and got[0].sources == ["lexicon", "lexicon"]
    assert got[1].native == "" and got[1].skipped == ["123"]
    assert got[2].tokens == ["love", "y2k"] and got[2].skipped == ["2", "you"]
    assert decode(got[3].native) == ["kʰ", "a"] and got[3].sources == ["jamo"]
    assert 4 not in got and 5 not in got


def test_topic_vectors(spark):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([[7, 0, 0, 0], [3, 0, 0, 0], [0, 7, 0, 0], [-7, 0, 0, 0], [4, 7, 0, 0], [0, 0, 0, 0]])], "vec_id int, embedding array<double>")
    t = topic.vectors(df)
    got = {r.row_id: r.similarity for r in topic.similarity_to(t, 0).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: -1, 4: pytest.approx(0.496, abs=1e-3), 5: 0}
    assert topic.appended(t, t.limit(2)).agg(F.max("row_id")).first()[0] == 7
    back = t.select("q", topic.unpacked(topic.packed(F.col("q"))).alias("u")).collect()
    assert all(r.q == r.u for r in back)


def test_g2p(spark):
    sizes = g2p.shapes(6, 7, 3, 4)
    rng = np.random.default_rng(0)
    n = sum(int(np.prod(s)) for s in sizes.values())
    raw = rng.normal(size=n).astype("<f4").tobytes()
    w = g2p.load(raw, sizes)
    assert len(g2p.decode([4, 5], w)) <= 12
    with pytest.raises(ValueError):
        g2p.load(raw[:-4], sizes)
    df = spark.createDataFrame([("en", "a", ["a"], [], 2), ("en", "a", ["o"], [], 1), ("en", "b c", ["b"], [], 1), ("xx", "d", ["d"], [], 1), ("en", "e", ["e"], ["?"], 1), ("en", "f", [], [], 1)], "lang string, word string, phonemes array<string>, unknown array<string>, ord int")
    assert [(r.word, r.phonemes) for r in g2p.training_pairs(df).collect()] == [("a", ["o"])]


def test_integrity(spark, tmp_path):
    from phonosearch.sources import store

    out = str(tmp_path / "out")
    integrity.publish(spark.range(3), out, lambda df: df.count() == 3)
    integrity.publish(spark.range(4), out, lambda df: df.count() == 4)
    assert store.read(spark, out).count() == 4
    with pytest.raises(ValueError):
        integrity.publish(spark.range(5), out, lambda df: False)
    assert store.read(spark, out).count() == 4
    (tmp_path / "foreign").mkdir()
    (tmp_path / "foreign" / "x").write_text("y")
    with pytest.raises(FileExistsError):
        integrity.publish(spark.range(1), str(tmp_path / "foreign"), lambda df: True)
    found = integrity.manifest(spark, out)
    assert found.count() == found.select("name").distinct().count() > 1  # names are paths, so files of two folders don't collide
    assert integrity.differences(found, found).count() == 0
    assert integrity.over_budget(found).first().fits


@pytest.mark.parametrize("each", [40, 7, 100_000])
def test_bigrams_are_written_in_bounded_objects(spark, tmp_path, each):
    """No object holds many more pairs than asked for, not even a frequent head's; no pair is lost."""
    rows = [("the", f'n"{i}', i) for i in range(300)] + [(f"w{i}", f"x{j}", i + j) for i in range(60) for j in range(i % 5)] + [('a"b\\', "é", 1)]
    at = str(tmp_path / "bigrams")
    files.write_word_bigrams(spark.createDataFrame(rows, "first string, second string, n bigint"), at, each)
    objects = [json.loads(gzip.decompress(p.read_bytes())) for p in (tmp_path / "bigrams").glob("part-*")]
    objects = [o["entries"] for o in objects]
    sizes = [sum(map(len, o.values())) for o in objects]
    assert sum(sizes) == len(rows) and max(sizes) <= each and all(e[2] == "0.5" for o in objects for x in o.values() for e in x)
    assert sorted(map(tuple, files.word_bigrams(spark, at).collect())) == sorted(rows)
    files.write_word_bigrams(spark.createDataFrame([], "first string, second string, n bigint"), at + "0", each)
    assert files.word_bigrams(spark, at + "0").count() == 0


@pytest.mark.parametrize("block, rows", [(2000, 8192), (3, 70)])
def test_study_of_all_pairs_without_a_table_of_pairs(spark, block, rows):
    """Sums, best rows and the exact percentile against brute force, with ties and a scheme that tells nothing; errors leave their task only where they may be the percentile."""
    from phonosearch.operators import study

    rng = np.random.default_rng(3)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    exact = unit(rng.normal(size=(420, 8)))
    schemes = [unit(np.sign(exact[:, :4])), exact.copy(), np.zeros((420, 2)), unit(exact[:, :5])]
    df = spark.createDataFrame([(i, *(m[i].tolist() for m in (exact, *schemes))) for i in range(420)], "row_id bigint, e array<double>, a array<double>, b array<double>, c array<double>, d array<double>")
    got = study.summed(df.repartition(3), 4, 10, block, rows)
    topics = np.arange(0, 420, 50)
    sims = lambda m: sum(np.multiply.outer(m[topics, k], m[:, k]) for k in range(m.shape[1]))
    best = lambda v: set(sorted(range(420), key=lambda i: (-v[i], i))[:10])
    for (corr, p99, kept), m in zip(got, schemes):
        x, y = sims(exact), sims(m)
        assert p99 == max(np.sort(abs(a - b))[-(-99 * 420 // 100) - 1] for a, b in zip(x, y))
        assert kept == pytest.approx(np.mean([len(best(a) & best(b)) / 10 for a, b in zip(x, y)]))
        assert corr is None if not m.any() else corr == pytest.approx(np.mean([np.corrcoef(a, b)[0, 1] for a, b in zip(x, y)]))


def test_quantization_study_joins_no_pairs(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=12).tolist()) for i in range(120)], "vec_id bigint, embedding array<float>")
    found = topic.quantization_study(df, (("pca", 8, 4), ("pq", 8, 2)), centres=4)
    assert "Join" not in found._jdf.queryExecution().toString()
    assert [(r.scheme, r.bytes) for r in found.collect()] == [("pca8/4", 4), ("pq8/2", 2)] and all(0 < r.p99 < 2 and 0 < r.corr < 1 and 0 <= r.kept <= 1 for r in found.collect())
