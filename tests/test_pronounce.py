"""Pronunciation tables, evaluation, weights, pairs, bundles and the small readers."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonosearch.functions import similarity, text
from phonosearch.functions.inventory import PHONEMES
from phonosearch.operators import build, g2p, integrity, pronounce
from phonosearch.sources import bundle, files
from phonosearch.sources.store import IntegrityError

RAW = [("ko", "국가", list("kuk") + ["ʼ", "a"], 1), ("ko", "나", ["x"], 1), ("ko", "나", ["n", "a"], 2), ("en", "love", ["l", "a", "b"], 1), ("en", "cat", ["k", "q", "t"], 1), ("en", "none", [], 1)]
FORMS = [("ko", "러브", ["l", "ʌ", "b", "ɯ"], 1)]


def tables(spark):
    schema = "lang string, word string, events array<string>, ord int"
    raw = spark.createDataFrame(RAW, schema)
    loan = spark.createDataFrame([("love", "러브"), ("cat", "캣")], "word string, hangul string")
    words = pronounce.spoken(raw)
    return raw, words, pronounce.table(words, pronounce.spoken(spark.createDataFrame(FORMS, schema)), loan)


def test_table(spark, tmp_path):
    raw, words, made = tables(spark)
    got = {(r.lang, r.word): (" ".join(r.phonemes), r.from_loanword, r.restored) for r in made.collect()}
    assert got == {("ko", "국가"): ("k u k k* a", False, 1), ("ko", "나"): ("n a", False, 0), ("en", "love"): ("ɾ ʌ p ɯ", True, 0), ("en", "cat"): ("k q t", False, 0)}
    s = pronounce.statistics(words, made).first().asDict()
    assert s == {"ko": 2, "en": 2, "en_from_loanword": 1, "aligned": 3, "unaligned": 0, "codas_restored": 1, "empty": 1}
    assert {r.symbol: r.n for r in pronounce.unknown_symbols(raw).collect()} == {"q": 1} | {r.symbol: r.n for r in pronounce.unknown_symbols(raw).where("symbol <> 'q'").collect()}
    at = str(tmp_path / "p")
    pronounce.write_json(made, at)
    assert {tuple(r) for r in files.pronunciations(spark, at, "ko").select("word", F.array_join("phonemes", " ")).collect()} == {("국가", "k u k k* a"), ("나", "n a")}


def test_evaluation_takes_the_best_reference(spark):
    p = spark.createDataFrame([("a", ["k", "a"]), ("b", ["t"]), ("c", ["t"])], "word string, phonemes array<string>")
    r = spark.createDataFrame([("a", ["k", "a"]), ("a", ["t"]), ("b", ["k", "a"]), ("b", ["t", "a"]), ("b", [])], "word string, phonemes array<string>")
    best = pronounce.best_of(p, r, PHONEMES)
    assert {x.word: (x.exact, x.error_rate) for x in best.collect()} == {"a": (True, 0.0), "b": (False, 0.5)}
    assert tuple(pronounce.summary(best).first()) == (2, 1, 0.5, 0.25)
    assert tuple(pronounce.parity(p, F.array(F.lit("t"))).first())[:2] == (3, 2)


def test_weights_and_pairs_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    w = {k: rng.normal(size=s).astype("<f4").astype(float) for k, s in g2p.shapes(6, 7, 3, 4).items()}
    raw, offsets = g2p.save(w)
    back = g2p.load(raw, g2p.sizes_of(offsets))
    assert list(back) == list(w) and all((back[k] == w[k]).all() for k in w)
    source, target = {"a": 4, "b": 5}, [*g2p.SPECIALS, "x", "y", "z"]
    run = g2p.predictor(raw, g2p.sizes_of(offsets), source, target)
    df = spark.createDataFrame([("ab", ["a", "b"]), ("b", ["b"])], "word string, t array<string>")
    expected = df.select("word", run(F.col("t")).alias("phonemes"), "t")
    hand = {x: [target[i] for i in g2p.decode([source[c] for c in x], w)] for x in ("ab", "b")}
    assert {r.word: r.phonemes for r in expected.collect()} == hand
    assert pronounce.parity(expected, run(F.col("t"))).first().rate == 1.0
    with pytest.raises(ValueError):
        g2p.sizes_of(json.dumps({"a": [1, [2]]}))
    pairs = spark.createDataFrame([("en", "a", ["x", "y"], "train"), ("ko", "b", ["z"], "dev")], "lang string, word string, phonemes array<string>, part string")
    g2p.write_pairs(pairs, str(tmp_path / "pairs"))
    assert [tuple(r) for r in g2p.read_pairs(spark, str(tmp_path / "pairs"), "train").select("lang", "word", "phonemes").collect()] == [("en", "a", ["x", "y"])]
    assert {tuple(r) for r in g2p.part_counts(pairs).collect()} == {("en", "train", 1), ("ko", "dev", 1)}


def test_union_offsets_frequencies_and_lengths(spark):
    d = spark.createDataFrame([("en", "b", 0), ("ko", "나", 1), ("en", "b", 5)], "lang string, word string, ord int")
    more = spark.createDataFrame([("en", "z"), ("en", "a"), ("ko", "가"), ("en", "b")], "lang string, word string")
    assert [r.word for r in build.ordered_union(d, more).orderBy("place").collect()] == ["b", "나", "가", "a", "z"]
    n = spark.createDataFrame([(i, i % 3) for i in range(50)], "k int, n int")
    got = {r.k: r.start for r in build.offsets(n, "k", "n").collect()}
    assert got == {i: sum(j % 3 for j in range(i)) for i in range(50)}
    z = lambda rows: spark.createDataFrame(rows, "lang string, word string, zipf double")
    diff = build.frequency_differences(z([("en", "a", 1.0), ("en", "b", 2.0), ("en", "c", None), ("en", "d", 3.0), ("en", "e", 4.0)]), z([("en", "a", 1.00005), ("en", "b", 2.1), ("en", "c", 1.0), ("en", "e", None)]))
    assert {r.word for r in diff.collect()} == {"b", "e"}
    sizes = [len(r.w) for r in build.by_length(spark.createDataFrame([("x" * (i * 7 % 40),) for i in range(200)], "w string"), "w").collect()]
    assert sizes == sorted(sizes)


def test_spans_and_multipliers(spark):
    df = spark.createDataFrame([(["k", "a", "n"],), ([],)], "p array<string>")
    spans = text.phoneme_spans(F.col("p"), 2)
    assert [[tuple(x) for x in r[0]] for r in df.select(spans).collect()] == [[("k", 2, 3), ("a", 3, 4), ("n", 4, 5)], []]
    m = text.detail_multipliers(text.phoneme_spans(F.col("p")), F.array(F.lit(2.0), F.lit(None).cast("double")), F.size("p"))
    assert [r[0] for r in df.select(m).collect()] == [[2.0, 1.0, 1.0], []]


def test_config_from_a_file(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"strict": 0.6, "place_caps": [[0.2, 0.7], [0.5, 0.6]]}))
    c = similarity.load_config(spark, str(tmp_path / "c.json"))
    assert c.strict == 0.6 and c.place_caps == ((0.2, 0.7), (0.5, 0.6)) and c.blend == similarity.Config().blend
    for bad in ({"place_caps": [[0.5, 0.7], [0.2, 0.6]]}, {"other": 1}):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            similarity.load_config(spark, str(tmp_path / "bad.json"))


def test_tables_of_text_and_pinned_files(spark, tmp_path):
    df = spark.createDataFrame([("ko", "가", 1.5), ("en", "a", None)], "lang string, word string, zipf double")
    files.tab_separated(df, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tab_separated(spark, str(tmp_path / "t"), "lang string, word string, zipf double").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    raw = gzip.compress(b"content")
    (tmp_path / "x.gz").write_bytes(raw)
    pin = hashlib.sha256(raw).hexdigest()
    assert files.verified_bytes(spark, str(tmp_path / "x.gz"), pin, hashlib.sha256(b"content").hexdigest()) == b"content"
    for wrong in ((pin[::-1], None), (pin, pin)):
        with pytest.raises(IntegrityError):
            files.verified_bytes(spark, str(tmp_path / "x.gz"), *wrong)


def test_bundle(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text("1")
    rules, z = (r"a/[a-z]+\.json",), str(tmp_path / "z.zip")
    pin = bundle.create(str(tmp_path), ["a/x.json"], {"reviewed": True}, z, rules)
    assert pin == bundle.create(str(tmp_path), ["a/x.json"], {"reviewed": True}, z, rules)
    assert bundle.restore(str(tmp_path / "out"), z, pin, rules) == ["a/x.json"] and (tmp_path / "out" / "a" / "x.json").read_text() == "1"
    with pytest.raises(ValueError, match="pinned"):
        bundle.restore(str(tmp_path / "out"), z, "0" * 64, rules)
    with pytest.raises(ValueError, match="allowed"):
        bundle.restore(str(tmp_path / "out2"), z, pin, ("b",))
    assert not (tmp_path / "out2").exists()
    draft = bundle.create(str(tmp_path), ["a/x.json"], {"reviewed": False}, z, rules)
    with pytest.raises(ValueError, match="reviewed"):
        bundle.restore(str(tmp_path / "out"), z, draft, rules)
    for names in (["a/x.json", "a/x.json"], ["../x"]):
        with pytest.raises(ValueError):
            bundle.create(str(tmp_path), names, {}, z, rules)


def test_review_draft(spark):
    df = spark.createDataFrame([("b", 2, "h2"), ("a", 1, "h1")], "name string, bytes bigint, sha256 string")
    d = integrity.review_draft(df, [{"asset": "a", "source": "s"}], {"m": "1"})
    assert d["reviewed"] is False and d["allowed_files"] == ["a", "b"] and d["files"][0] == {"path": "a", "bytes": 1, "sha256": "h1"}
