"""Queries over text, lexicon building, pronunciation, integrity and streams, each with its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonosearch.functions import text
from phonosearch.functions.inventory import CODA_LETTERS, CODAS, CODES, NUCLEI, NUCLEUS_LETTERS, ONSET_LETTERS, ONSETS
from phonosearch.functions.scores import tie_key
from phonosearch.operators import build, events, g2p, integrity, topic, word_search
from phonosearch.operators.resolve import resolve
from phonosearch.plans import sql
from phonosearch.plans.request import Request, aligned, proportional
from phonosearch.plans.search_queries import BASIC, EMB, DOT, EDGES, ranked_sql, request_for, topic_rows
from phonosearch.plans.testdata import edges, layered, lexicon, native_code, vocabulary, words
from phonosearch.session import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- Hangul ---------------------------------------------------------------------------------------

# Published inputs of text, sound, event and transfer cases.
KOREAN = ["맛있다", "사람이", "괜찮아", "없어", "국가", "신라", "읽는", "좋다", "가나다", "나도", "사랑", "외계", "웨이브", "의사", "ㅋㅏ", "ㅏㅏ", "ㅋㅋ", "가a나", "닭", "꽃잎", ""]
SPOKEN = [("맛있다", "m a t i t t* a"), ("사람이", "s a ɾ a m i"), ("괜찮아", "k wɛ n tɕʰ a n a"), ("없어", "ʌ p s* ʌ"), ("국가", "k u k k* a"), ("신라", "s i l ɾ a"), ("읽는", "i ŋ n ɯ n"), ("좋다", "tɕ o tʰ a"), ("가나다", "k a n a t a t a"), ("나도", "n a t o"), ("사랑", "s a ɾ a ŋ"), ("외계", "we k je"), ("웨이브", "we i p ɯ"), ("의사", "ɯ s a")]
HANGUL = f"w AS (SELECT * FROM {sql.values([(x,) for x in KOREAN], 'word')}), ch AS (SELECT word, unnest(string_split(word, '')) AS c, generate_subscripts(string_split(word, ''), 1) AS i FROM w WHERE word <> ''), code AS (SELECT word, i, c, unicode(c) - 44032 AS s FROM ch), syl AS (SELECT * FROM code WHERE s BETWEEN 0 AND 11171)"
LIST = lambda xs: "[" + ", ".join(map(sql.text, xs)) + "]"
PARTS = f"{LIST(ONSETS)}[s // 588 + 1] AS o, {LIST(NUCLEI)}[(s % 588) // 28 + 1] AS v, {LIST(CODAS)}[s % 28 + 1] AS f"


def korean(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in KOREAN], "word string")


@query(f"WITH {HANGUL} SELECT word, CAST(i - 1 AS INTEGER) AS pos, CAST(s // 588 AS INTEGER) AS onset, CAST((s % 588) // 28 AS INTEGER) AS nucleus, CAST(s % 28 AS INTEGER) AS coda FROM syl")
def hangul_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = korean(spark).where("word <> ''").select("word", F.posexplode(F.split("word", "")).alias("pos", "c")).withColumn("s", text.syllable(F.col("c"))).where("s is not null")
    return c.select("word", "pos", text.onset(F.col("s")).alias("onset"), text.nucleus(F.col("s")).alias("nucleus"), text.coda(F.col("s")).alias("coda"))


@query(f"WITH {HANGUL}, p AS (SELECT word, i, {PARTS} FROM syl), a AS (SELECT word, string_agg(trim(regexp_replace(o || ' ' || v || ' ' || f, ' +', ' ', 'g')), ' ' ORDER BY i) AS sounds FROM p GROUP BY word) SELECT w.word, coalesce(sounds, '') AS sounds FROM w LEFT JOIN a ON a.word = w.word")
def hangul_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return korean(spark).select("word", F.array_join(text.hangul_sounds(F.col("word")), " ").alias("sounds"))


@query(f"WITH {HANGUL}, p AS (SELECT word, i, CASE WHEN s BETWEEN 0 AND 11171 THEN o || ' ' || v || ' ' || f ELSE coalesce({sql.map_of(text.jamo_table())}[c], '') END AS x FROM (SELECT word, i, c, s, {PARTS} FROM code)), a AS (SELECT word, trim(regexp_replace(string_agg(x, ' ' ORDER BY i), ' +', ' ', 'g')) AS sounds FROM p GROUP BY word) SELECT w.word, coalesce(sounds, '') AS sounds FROM w LEFT JOIN a ON a.word = w.word")
def jamo_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return korean(spark).select("word", F.array_join(text.written_sounds(F.col("word")), " ").alias("sounds"))


@query(f"WITH {HANGUL} SELECT word, string_agg(CASE WHEN s BETWEEN 0 AND 11171 THEN 'C' || (s // 588) || ' V' || ((s % 588) // 28) || CASE WHEN s % 28 > 0 THEN ' J' || (s % 28) ELSE '' END ELSE c END, ' ' ORDER BY i) AS tokens FROM code GROUP BY word")
def g2p_input_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return korean(spark).where("word <> ''").select("word", F.array_join(text.model_tokens(F.col("word")), " ").alias("tokens"))


def spoken(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPOKEN, "word string, p string").select("word", F.split("p", " ").alias("sounds"))


@query()
def syllable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark).select("word", F.posexplode(text.syllable_spans(F.col("word"), F.col("sounds"))).alias("pos", "s")).select("word", "pos", "s.char", "s.start", "s.end")


@query()
def sound_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoken(spark).select("word", F.array_join(text.sound_names(F.col("word"), F.col("sounds")), "").alias("names"))


# ---- Text -----------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(strip_accents(lower(trim(text)))) AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold(F.col("text")).cast("binary")).alias("folded"))


@query("SELECT conv_id, turn, md5(strip_accents(lower(trim(text)))) AS folded FROM conversations")
def fold_any_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.fold_any(F.col("text")).cast("binary")).alias("folded"))


TOKENS = f"regexp_extract_all(strip_accents(lower(trim(text))), {sql.text(text.TOKEN)})"


@query(f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {TOKENS} AS t FROM documents)")
def tokenize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(text.fold(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("tokens"))


CLASSES = ["ㅋㅋ", "사랑", "ㅏ나", "the", "zzqq", "123", "y2k", "don't"]


@query(f"WITH {sql.WORDS}, t AS (SELECT * FROM {sql.values([(x,) for x in CLASSES], 'token')}) SELECT token, CASE WHEN regexp_matches(token, '[ㄱ-ㅎㅏ-ㅣ]') THEN 'jamo' WHEN regexp_matches(token, '^[가-힣]+$') THEN 'hangul' WHEN token IN (SELECT word FROM tok) THEN 'lexicon' WHEN regexp_matches(token, '^[0-9]+$') THEN 'number' ELSE 'model' END AS class FROM t")
def token_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.createDataFrame([(x,) for x in CLASSES], "token string")
    lex = words(spark, sf_dir).select(F.col("word").alias("token")).distinct().withColumn("known", F.lit(True))
    return t.join(lex, "token", "left").select("token", text.token_class(F.col("token"), F.col("known").isNotNull()).alias("class"))


@query(f"SELECT list, array_to_string(list_filter(list_transform(string_split(list, ','), lambda x: lower(trim(x))), lambda x: x <> ''), '|') AS words FROM {sql.values([('a, B ,,c',), ('',), (' Love ,',)], 'list')}")
def exclude_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("a, B ,,c",), ("",), (" Love ,",)], "list string").select("list", F.array_join(text.exclude_list(F.col("list")), "|").alias("words"))


BRACKETS = [("역사상", "최고의", "사상", "최"), ("사가", "나비", "가", "나"), ("a", "b", "", "xyz")]
SIDE = lambda w, t: f"greatest(1, least(length({w}), CASE WHEN length({t}) > 0 THEN length({t}) ELSE 1 END))"


@query(f"SELECT a, b, left(a, length(a) - x) || '[' || right(a, x) || ' ' || left(b, y) || ']' || substr(b, y + 1) AS display FROM (SELECT *, {SIDE('a', 'l')} AS x, {SIDE('b', 'r')} AS y FROM {sql.values(BRACKETS, 'a, b, l, r')})")
def bracket_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(BRACKETS, "a string, b string, l string, r string")
    return df.select("a", "b", text.bracketed(*(F.col(x) for x in "ablr")).alias("display"))


# ---- Lexicon --------------------------------------------------------------------------------------


@query(f"WITH {sql.VOCAB} SELECT word, n, zipf FROM lex")
def word_frequency_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir)


@query(f"WITH {sql.WORDS}, v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark), c AS (SELECT word, count(*) AS n FROM tok GROUP BY word) SELECT v.word, n, CASE WHEN n > 0 THEN round(log10(n / (SELECT count(*) FROM tok)::DOUBLE) + 9, 4) END AS zipf FROM v LEFT JOIN c ON c.word = v.word")
def vocabulary_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of the benchmark's words by the documents: words that documents lack have none."""
    v = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return build.counts(words(spark, sf_dir).select("word"), v)


@query(f"WITH {sql.LAYERS} SELECT joined, count(*) AS n_words FROM (SELECT array_to_string(native, ' ') AS joined FROM layers) GROUP BY joined")
def lexicon_distinct_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.functions.inventory import FIRST_CODE, PHONEMES

    seqs = build.distinct_sequences(vocabulary(spark, sf_dir).select(native_code(F.col("word")).alias("code")))
    names = F.array(*(F.lit(p) for p in PHONEMES))
    return seqs.select(F.array_join(F.transform(F.split("code", ""), lambda c: F.get(names, F.ascii(c) - FIRST_CODE)), " ").alias("joined"), "n_words")


def spelled(code):
    from phonosearch.functions.inventory import FIRST_CODE, PHONEMES

    return F.array_join(F.transform(F.split(code, ""), lambda c: F.get(F.array(*(F.lit(p) for p in PHONEMES)), F.ascii(c) - FIRST_CODE)), " ")


@query(f"WITH {sql.LAYERS} SELECT word, array_to_string(native, ' ') AS native, array_to_string(koreanized, ' ') AS koreanized FROM layers")
def lexicon_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled from one row for each reading."""
    lex = lexicon(spark, sf_dir)
    rows = lex.select("lang", "word", F.explode(F.array(F.struct(F.lit("native").alias("layer"), F.get("native", F.lit(0)).alias("code")), F.struct(F.lit("koreanized").alias("layer"), F.get("koreanized", F.lit(0)).alias("code")))).alias("x")).select("lang", "word", "x.layer", F.lit(0).alias("pos"), "x.code")
    out = build.assembled(rows)
    return out.select("word", spelled(F.get("native", F.lit(0))).alias("native"), spelled(F.get("koreanized", F.lit(0))).alias("koreanized"))


@query(f"WITH {sql.WORDS} SELECT word, row_number() OVER (ORDER BY word) - 1 AS ord FROM (SELECT DISTINCT word FROM tok)")
def collation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = words(spark, sf_dir).select("word").distinct().withColumn("word_id", F.xxhash64("word"))
    return build.collated(v).select("word", "ord")


FILES = [(1, 1, "사랑", "s a"), (1, 2, "사랑", "s b"), (2, 1, "사랑", "s c"), (2, 2, "나무", "n a"), (3, 1, "나무", "n b"), (3, 2, "꽃", "k t")]


@query(f"SELECT word, p FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY f, l) AS rn FROM {sql.values(FILES, 'f, l, word, p')}) WHERE rn = 1")
def first_file_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.first_wins(spark.createDataFrame(FILES, "f int, l int, word string, p string"), ["word"], F.col("f"), F.col("l")).select("word", "p")


@query(f"SELECT word, p FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY f DESC, l DESC) AS rn FROM {sql.values(FILES, 'f, l, word, p')}) WHERE rn = 1")
def last_file_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.last_wins(spark.createDataFrame(FILES, "f int, l int, word string, p string"), ["word"], F.col("f"), F.col("l")).select("word", "p")


FREQUENT = f"{sql.VOCAB}, big AS (SELECT word, n FROM lex WHERE n >= 3), {EDGES}"


def frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).where("n >= 3").select("word", F.col("word").alias("word_id"))


@query(f"WITH {FREQUENT} SELECT count(*) FILTER (WHERE first IN (SELECT word FROM big) AND second IN (SELECT word FROM big)) AS kept, count(*) FILTER (WHERE NOT (first IN (SELECT word FROM big) AND second IN (SELECT word FROM big))) AS skipped FROM edge")
def skipped_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit, lost = build.endpoints(edges(spark, sf_dir), frequent(spark, sf_dir))
    return hit.agg(F.count("*").alias("kept")).join(lost.agg(F.count("*").alias("skipped")), how="cross")


BENCH = "bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark)"


def bench_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()


@query(f"WITH {sql.WORDS}, {BENCH} SELECT word FROM bw EXCEPT SELECT word FROM tok")
def vocabulary_minus_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bench_words(spark, sf_dir).join(words(spark, sf_dir).select("word"), "word", "left_anti")


@query(f"WITH {sql.VOCAB}, {BENCH} SELECT word, n FROM lex WHERE word IN (SELECT word FROM bw)")
def needed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(spark, sf_dir).select("word", "n").join(bench_words(spark, sf_dir), "word", "left_semi")


@query(f"WITH {sql.VOCAB}, {BENCH}, c AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) SELECT word FROM bw UNION SELECT word FROM c")
def vocabulary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return bench_words(spark, sf_dir).unionByName(c).distinct()


SURFACES = [(0, "사가", None, 4.0), (1, "나비", None, 4.0), (2, "마니", None, None), (3, "사가는", 0, 3.0), (4, "마니는", 2, 2.5), (5, "소금도", 9, None)]


@query(f"WITH s AS (SELECT * FROM {sql.values(SURFACES, 'sid, text, norm_sid, zipf')}) SELECT a.sid, coalesce(b.zipf, a.zipf, 1.0)::DOUBLE AS meaning_zipf FROM (SELECT sid, CAST(norm_sid AS BIGINT) AS norm_sid, CAST(zipf AS DOUBLE) AS zipf FROM s) a LEFT JOIN (SELECT sid, CAST(zipf AS DOUBLE) AS zipf FROM s) b ON b.sid = a.norm_sid")
def normal_form_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.operators.linked_search import meaning_zipf

    return meaning_zipf(spark.createDataFrame(SURFACES, "sid int, text string, norm_sid int, zipf double"))


@query(f"WITH {sql.VOCAB}, {BENCH} SELECT bw.word, CASE WHEN n >= 3 THEN CAST(n AS BIGINT) WHEN bw.word LIKE 'th%' THEN 1000000 ELSE -1 END AS topic_row FROM bw LEFT JOIN lex ON lex.word = bw.word")
def topic_row_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bench_words(spark, sf_dir)
    lex = vocabulary(spark, sf_dir).where("n >= 3").select("word", F.col("n").alias("topic_row"))
    return build.topic_rows(b, lex, b.where("word like 'th%'").withColumn("topic_row", F.lit(1000000).cast("bigint")))


@query(f"WITH {sql.LAYERS}, x AS (SELECT word, native, unnest(range(1, least(4, len(native)) + 1)) AS k FROM layers) SELECT suffix, count(*) AS n_words FROM (SELECT array_to_string(native[len(native) - k + 1:], ' ') AS suffix FROM x) GROUP BY suffix")
def suffix_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = build.suffixes(vocabulary(spark, sf_dir).select("word", native_code(F.col("word")).alias("code")))
    return posted.groupBy("suffix").agg(F.count("*").alias("n_words")).select(spelled(F.col("suffix")).alias("suffix"), "n_words")


# ---- Events and transfers -------------------------------------------------------------------------

# Fixed values, as above.
EVENTS = [("국가", ["k", "u", "k", "ʼ", "a"]), ("사랑", ["s", "a", "ɾ", "a", "ŋ"]), ("외계", ["ø", "g", "j", "e"]), ("잡지", ["d", "͡", "ʑ", "a", "p", "t", "͡", "ɕ", "ʼ", "i"]), ("물", ["m", "u", "ɾ"]), ("이이", ["j", "i", "j", "i"]), ("q", ["q", "a"])]


@query()
def normalize_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(EVENTS, "word string, events array<string>").select("word", events.normalize(F.col("events")).alias("n"))
    return e.select("word", F.array_join("n.phonemes", " ").alias("phonemes"), F.array_join("n.unknown", " ").alias("unknown"))


@query()
def restore_codas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.createDataFrame(EVENTS, "word string, events array<string>").select("word", events.normalize(F.col("events")).alias("n"))
    r = e.select("word", events.restore_codas(F.col("word"), F.col("n.phonemes")).alias("r"))
    return r.select("word", F.array_join("r.phonemes", " ").alias("phonemes"), "r.restored", "r.aligned")


# Fixed values, as above.
TRANSFERS = [("1 10 1", "l ʌ v", "ɾ ʌ p ɯ"), ("1 1 10", "l ʌ v", "ɾ ʌ p ɯ"), ("1 10 1", "t aɪ m", "tʰ a i m"), ("10 5 1", "f l oʊ", "pʰ ɯ l ɾ o"), ("3 1 7", "l ʌ v", "l ʌ v")]


@query()
def aligned_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for d, a, b in TRANSFERS:
        detail = [float(x) for x in d.split()]
        rows.append((d, a, b, aligned(detail, a.split(), b.split()), proportional(detail, a.split(), b.split())))
    return spark.createDataFrame(rows, "detail string, source string, target string, aligned array<double>, proportional array<double>")


# ---- Pronunciation model --------------------------------------------------------------------------


@query(f"WITH {sql.WORDS} SELECT word, CASE WHEN x < 90 THEN 'train' WHEN x < 95 THEN 'dev' ELSE 'test' END AS part FROM (SELECT word, CAST(('0x' || substr(sha1(word), 1, 4)) AS INTEGER) % 100 AS x FROM (SELECT DISTINCT word FROM tok))")
def g2p_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words(spark, sf_dir).select("word").distinct().select("word", g2p.part_of(F.col("word")).alias("part"))


@query(f"WITH {sql.VOCAB}, d AS (SELECT word, levenshtein(replace(word, 'x', 'ks'), replace(replace(replace(word, 'x', 'ks'), 'c', 'k'), 'q', 'k')) AS d, length(replace(word, 'x', 'ks')) AS n FROM lex) SELECT round(avg((d = 0)::INT), 9) AS exact, round(sum(d) / sum(n), 9) AS error_rate, round(avg(d / n), 7) AS mean_rate FROM d")
def phoneme_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the letters as sounds against letters with c and q read as k."""
    letters = F.split(F.replace("word", F.lit("x"), F.lit("ks")), "")
    read = F.transform(letters, lambda c: F.when(c.isin("c", "q"), "k").otherwise(c))
    rows = vocabulary(spark, sf_dir).select(g2p.distance(letters, read, list("abcdefghijklmnopqrstuvwyz")).alias("d"), F.size(letters).alias("n"))
    out = g2p.error_rates(rows)
    return out.select(F.round("exact", 9).alias("exact"), F.round("error_rate", 9).alias("error_rate"), F.round("mean_rate", 7).alias("mean_rate"))


@query(f"WITH {sql.WORDS}, c AS (SELECT DISTINCT unnest(string_split(word, '')) AS symbol FROM tok), n AS (SELECT symbol, row_number() OVER (ORDER BY symbol) + 3 AS id FROM c) SELECT symbol, CAST(id AS INTEGER) AS id FROM n UNION ALL SELECT * FROM {sql.values([(s, i) for i, s in enumerate(g2p.SPECIALS)], 'symbol, id')}")
def g2p_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g2p.symbols(words(spark, sf_dir).select("word").distinct().select(F.explode(F.split("word", "")).alias("token")).distinct())


@query()
def g2p_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy inference over the benchmark's words with fixed random weights: no trained ones exist here."""
    import numpy as np

    source = {s: i for i, s in enumerate([*g2p.SPECIALS, *"abcdefghijklmnopqrstuvwxyz'"])}
    target = [*g2p.SPECIALS, *list(CODES)[:40]]
    sizes = g2p.shapes(len(source), len(target), 16, 24)
    raw = np.random.default_rng(7).normal(0, 0.4, sum(int(np.prod(s)) for s in sizes.values())).astype("<f4").tobytes()
    run = g2p.predictor(raw, sizes, source, target)
    return bench_words(spark, sf_dir).select("word", F.array_join(run(text.model_tokens(F.col("word"))), " ").alias("sounds"))


# ---- Queries in bulk ------------------------------------------------------------------------------


@query(f"WITH {sql.LAYERS}, q AS (SELECT item_id, {TOKENS} AS t FROM benchmark), tok2 AS (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM q), hit AS (SELECT item_id, token, pos, native FROM tok2 LEFT JOIN layers ON word = token) SELECT item_id AS query_id, coalesce(string_agg(array_to_string(native, ' '), ' ' ORDER BY pos) FILTER (WHERE native IS NOT NULL), '') AS native, coalesce(string_agg(token, ' ' ORDER BY pos) FILTER (WHERE native IS NULL), '') AS skipped FROM hit GROUP BY item_id")
def query_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as queries."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    got = resolve(q, lexicon(spark, sf_dir), CODES)
    return got.select("query_id", F.when(F.col("native") == "", "").otherwise(spelled(F.col("native"))).alias("native"), F.array_join("skipped", " ").alias("skipped"))


@query()
def query_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as a stream of queries, answered in micro-batches and gathered in a table of the shared folder."""
    import tempfile
    import uuid

    from phonosearch.streaming import query_stream as streaming

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="phonosearch-")
    at = f"{base}/query-stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select(F.col("event_type").alias("query"))
    lex = lexicon(spark, sf_dir).persist()

    def sink(found: DataFrame, number: int, part: int) -> None:
        found.write.mode("overwrite").parquet(f"{at}/out/batch={number}/part={part}")  # a retried batch writes the same again

    streaming.start(stream, lex, lambda w: request_for(w, mode="native"), sink, f"{at}/checkpoint", top=3).awaitTermination()
    lex.unpersist()
    return spark.read.parquet(f"{at}/out").distinct().select("query", F.col("rank").cast("bigint").alias("rank"), "word", F.col("key").alias("score"))


# ---- Quality and integrity ------------------------------------------------------------------------

EXACT = "x AS (SELECT vec_id AS row_id, v FROM unitv), ex AS (SELECT t.row_id AS t, a.row_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(list_zip(a.v, t.v), lambda z: z[1] * z[2])), lambda p, q: p + q) AS exact FROM x a CROSS JOIN (SELECT * FROM x WHERE row_id % 50 = 0) t), sm AS (SELECT t.row_id AS t, a.row_id, " + DOT.format(a="a.q", b="t.q") + " * a.inv_norm * t.inv_norm AS small FROM topicv a CROSS JOIN (SELECT * FROM topicv WHERE row_id % 50 = 0) t), bothv AS (SELECT t, row_id, exact, small FROM ex JOIN sm USING (t, row_id))"


def both_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = topic_rows(spark, sf_dir)
    t = q.where("row_id % 50 = 0").select(F.col("row_id").alias("t"), F.col("q").alias("t_q"), F.col("inv_norm").alias("t_n"))
    small = topic.by_blocks(q, t).select("t", "row_id", (topic.dot(F.col("q"), F.col("t_q")) * F.col("inv_norm") * F.col("t_n")).alias("small"))
    return small.join(topic.vectors_exact(table(spark, sf_dir, "embeddings")), ["t", "row_id"])


@query(f"WITH {EMB}, {EXACT} SELECT t, round(corr(exact, small), 6) AS corr, round(max(abs(exact - small)), 6) AS worst FROM bothv GROUP BY t")
def similarity_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_similarities(spark, sf_dir).groupBy("t").agg(F.round(F.corr("exact", "small"), 6).alias("corr"), F.round(F.max(F.abs(F.col("exact") - F.col("small"))), 6).alias("worst"))


@query(f"WITH {EMB}, {EXACT}, r AS (SELECT t, row_id, row_number() OVER (PARTITION BY t ORDER BY round(exact, 9) DESC, row_id) AS re, row_number() OVER (PARTITION BY t ORDER BY round(small, 9) DESC, row_id) AS rs FROM bothv) SELECT t, count(*) FILTER (WHERE re <= 50 AND rs <= 50) AS shared FROM r GROUP BY t")
def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    b = both_similarities(spark, sf_dir)
    top = lambda c: F.row_number().over(Window.partitionBy("t").orderBy(F.round(c, 9).desc(), "row_id"))
    a = b.withColumn("re", top("exact")).where("re <= 50").select("t", "row_id")
    s = b.withColumn("rs", top("small")).where("rs <= 50").select("t", "row_id")
    shared = a.join(s, ["t", "row_id"]).groupBy("t").agg(F.count("*").alias("shared"))
    return b.select("t").distinct().join(shared, "t", "left").select("t", F.coalesce("shared", F.lit(0)).alias("shared"))


@query(f"WITH {EMB}, {EXACT} SELECT b.t, count(*) FILTER (WHERE round(b.small, 9) > round(o.small, 9)) AS better FROM bothv b JOIN (SELECT t, small FROM bothv WHERE row_id = t + 10) o ON o.t = b.t GROUP BY b.t")
def translation_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are nearer to a topic than its counterpart, here the row ten further."""
    b = both_similarities(spark, sf_dir)
    own = b.where("row_id = t + 10").select("t", F.round("small", 9).alias("own"))
    return b.join(F.broadcast(own), "t").groupBy("t").agg(F.count_if(F.round("small", 9) > F.col("own")).alias("better"))


NUMBERED = ranked_sql(BASIC) + ", numbered AS (SELECT row_number() OVER (ORDER BY score DESC, word) AS rank, word, score FROM ranked)"


def first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_search.page(word_search.search(lexicon(spark, sf_dir), BASIC)).select("rank", "lang", "word", F.col("key").alias("score"))


@query(NUMBERED + " SELECT sha256(string_agg('en:' || word || ':' || score, chr(10) ORDER BY rank)) AS digest FROM numbered WHERE rank <= 99")
def result_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.result_digest(first_page(spark, sf_dir), "rank", "lang", "word", "score")


@query(NUMBERED + " SELECT rank, true AS same FROM numbered WHERE rank <= 99")
def parity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page by the Arrow kernel against the page by higher-order functions over the same words."""
    from phonosearch.operators import kernel
    from phonosearch.functions.scores import frequency_weight

    page = first_page(spark, sf_dir).persist()
    q = kernel.prepare(BASIC.native, None, BASIC.vowel_weight, BASIC.consonant_weight)
    again = page.select("word").join(vocabulary(spark, sf_dir), "word").withColumn("raw", kernel.plain_score(native_code(F.col("word")), q))
    ranked = again.withColumn("key", tie_key(frequency_weight(F.col("raw"), F.col("zipf"), BASIC.frequency_weight))).withColumn("ord", F.col("word"))
    other = word_search.page(ranked).select("rank", "word", F.col("key").alias("score"))
    return integrity.compared(page, other).select(F.col("rank").cast("bigint").alias("rank"), "same")


LISTED = [("a.parquet", 10, "x"), ("b.parquet", 20, "y"), ("c.parquet", 30, "z")]
FOUND = [("a.parquet", 10, "x"), ("b.parquet", 21, "y"), ("d.parquet", 5, "w")]


@query(f"WITH f AS (SELECT * FROM {sql.values(FOUND, 'name, bytes, sha256')}), l AS (SELECT * FROM {sql.values(LISTED, 'name, bytes, sha256')}) SELECT coalesce(f.name, l.name) AS name, CASE WHEN f.name IS NULL THEN 'missing' WHEN l.name IS NULL THEN 'extra' WHEN f.bytes <> l.bytes THEN 'size' ELSE 'digest' END AS problem FROM f FULL JOIN l ON f.name = l.name WHERE f.name IS NULL OR l.name IS NULL OR f.bytes <> l.bytes OR f.sha256 <> l.sha256")
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "name string, bytes bigint, sha256 string"
    return integrity.differences(spark.createDataFrame(FOUND, schema), spark.createDataFrame(LISTED, schema))


@query()
def input_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of the benchmark's files."""
    return integrity.manifest(spark, f"{sf_dir}/benchmark.parquet")


# ---- Korean ---------------------------------------------------------------------------------------

TOY = [(w, z, p) for (w, p), z in zip(SPOKEN, [5.0, 2.0, None, 4.5, 3.0, 3.6, 1.0, 6.0, 2.2, 4.0, 5.5, None, 3.4, 3.5])]
TOY_REQUEST = Request("마시다", ("m", "a", "s", "i", "t", "a"), korean=(("m", "a", "s", "i", "t", "a"),), languages=("ko",), frequency_weight=2.0)
TOY_SQL = f"toy AS (SELECT word, CAST(zipf AS DOUBLE) AS zipf, string_split(p, ' ') AS ph FROM {sql.values(TOY, 'word, zipf, p')})"


def toy_lexicon(spark: SparkSession) -> DataFrame:
    from phonosearch.functions.inventory import encode

    rows = [(w, w, "ko", z, w, [encode(p.split())], [], []) for w, z, p in TOY]
    return spark.createDataFrame(rows, "word_id string, word string, lang string, zipf double, ord string, ko array<string>, native array<string>, koreanized array<string>")


def toy_oracle() -> str:
    from phonosearch.plans.request import pairings

    q = pairings(TOY_REQUEST)[0][2][0]
    return f"WITH {sql.SIM}, {TOY_SQL}, " + sql.scored("x", "toy", "word", "ph", q) + f" SELECT word, {sql.key('s')} AS raw, {sql.key(sql.frequency('s', 'zipf', 2.0))} AS score FROM x JOIN toy ON word = k WHERE s > 40"


@query(toy_oracle())
def word_search_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_search.search(toy_lexicon(spark), TOY_REQUEST).select("word", tie_key(F.col("raw")).alias("raw"), F.col("key").alias("score"))


@query()
def linked_search_korean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces with written syllables: particles as heads are skipped, the shared part is bracketed."""
    from phonosearch.functions.inventory import encode
    from phonosearch.operators import linked_search

    surfaces = [(0, "사가", "s a k a", None, 4.0), (1, "나비", "n a p i", None, 4.0), (2, "마니", "m a n i", None, 3.0), (3, "가을", "k a i l", None, 4.0), (4, "사가는", "s a k a n i n", "사가", 3.0), (5, "소금", "s o k i m", None, 2.0)]
    units = spark.createDataFrame([(i, t, n, n is not None, encode(p.split()), z) for i, t, p, n, z in surfaces], "id int, text string, norm_text string, is_particle boolean, ko string, zipf double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (4, 1), (5, 1)], "first int, second int")
    request = Request("가나", tuple("kana"), korean=(tuple("kana"),), syllables=(("가", 0), ("나", 2)), frequency_weight=0.0, languages=("ko",))
    pairs, plan = linked_search.collect(units, edges, request, "ko", ("ko",))
    name = lambda c, z: units.select(F.col("id").alias(c), F.col("text").alias(f"{c}_text"), F.col("zipf").alias(z))
    both = pairs.join(name("first", "za"), "first").join(name("second", "zb"), "second").withColumn("zipf", (F.col("za") + F.col("zb")) / 2)
    return linked_search.describe(linked_search.rank(both, request), plan).select("display", "split_label", F.col("key").alias("score"))


REMAPS = [([1.0, 2.0, 3.0], 3, 6), ([1.0, 2.0, 3.0], 3, 2), ([4.0], 1, 3)]


@query(f"SELECT n, m, array_to_string([CAST(CAST(detail[least(n - 1, (i * n) // m) + 1] AS INTEGER) AS VARCHAR) for i in range(m)], ',') AS detail FROM {sql.values(REMAPS, 'detail, n, m')}")
def detail_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detail spread over a pronunciation of another length."""
    rows = [(n, m, ",".join(str(int(x)) for x in proportional(d, [""] * n, [""] * m))) for d, n, m in REMAPS]
    return spark.createDataFrame(rows, "n int, m int, detail string")


@query(f"WITH {sql.WORDS}, c AS (SELECT word, count(*) AS n FROM tok GROUP BY word) SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM c")
def frequency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique ranks over all words, by counted ranges."""
    return build.ranks(vocabulary(spark, sf_dir).select("word", "n"), F.desc("n"), F.col("word"))



# ---- Further inputs and checks --------------------------------------------------------------------

PHONETIC = [("사랑",), ("ㅋㅏ",), ("a",), ("사 랑",), ("",), ("가1",)]


@query(f"WITH {sql.LAYERS} SELECT word, regexp_full_match(word, '[가-힣ㄱ-ㅎㅏ-ㅣ]+') AS phonetic FROM (SELECT word FROM layers UNION ALL SELECT word FROM {sql.values(PHONETIC, 'word')})")
def phonetic_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vocabulary(spark, sf_dir).select("word").unionByName(spark.createDataFrame(PHONETIC, "word string"))
    return rows.select("word", text.is_phonetic(F.col("word")).alias("phonetic"))


@query(f"WITH {sql.LAYERS}, p AS (SELECT word, unnest(native) AS sound, generate_subscripts(native, 1) AS i FROM layers) SELECT word, sound, CAST(i + 2 AS INTEGER) AS start, CAST(i + 3 AS INTEGER) AS stop FROM p")
def phoneme_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all words' sounds behind three others."""
    sounds = F.transform(F.split(native_code(F.col("word")), ""), lambda c: F.try_element_at(text.literal_map((c, p) for p, c in CODES.items()), c))
    s = vocabulary(spark, sf_dir).select("word", F.explode(text.phoneme_spans(sounds, 3)).alias("s"))
    return s.select("word", F.col("s.char").alias("sound"), F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(f"WITH {sql.LAYERS}, p AS (SELECT word, len(native) AS n, unnest(range(len(native))) AS i FROM layers), m AS (SELECT word, i, CASE WHEN n >= 4 AND i >= 1 AND i < 3 THEN 5.0 WHEN i < 2 THEN 2.0 ELSE 1.0 END::DOUBLE AS x FROM p) SELECT word, array_to_string(list(CAST(CAST(x AS INTEGER) AS VARCHAR) ORDER BY i), ',') AS detail FROM m GROUP BY word")
def detail_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans over each word's sounds, the second of which lies over the first."""
    span = lambda a, b: F.struct(F.lit("").alias("char"), F.lit(a).alias("start"), F.lit(b).alias("end"))
    size = F.length(native_code(F.col("word")))
    spans = F.when(size >= 4, F.array(span(0, 2), span(1, 3))).otherwise(F.array(span(0, 2)))
    m = text.detail_multipliers(spans, F.array(F.lit(2.0), F.lit(5.0)), size)
    return vocabulary(spark, sf_dir).select("word", F.array_join(F.transform(m, lambda x: x.cast("int").cast("string")), ",").alias("detail"))


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words as English ones that were spoken as they are written."""
    return vocabulary(spark, sf_dir).select(F.lit("en").alias("lang"), "word", F.split("word", "").alias("phonemes"))


LOANS = "loan AS (SELECT word, word[:3] AS hangul FROM lex WHERE word LIKE 'th%'), form AS (SELECT DISTINCT word[:3] AS hangul FROM lex WHERE word LIKE 'th%' AND length(word) >= 5)"


@query(f"WITH {sql.VOCAB}, {LOANS} SELECT lex.word, CASE WHEN form.hangul IS NOT NULL THEN form.hangul || 'ɯ' ELSE lex.word END AS reading, form.hangul IS NOT NULL AS from_loanword FROM lex LEFT JOIN loan ON loan.word = lex.word LEFT JOIN form ON form.hangul = loan.hangul")
def loanword_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An English word is read as its loanword's spoken form where there is one; the spellings here are the first three letters of words in th."""
    from phonosearch.operators import pronounce

    th = vocabulary(spark, sf_dir).where("word like 'th%'").select("word", F.substring("word", 1, 3).alias("hangul"))
    forms = th.where("length(word) >= 5").select(F.lit("ko").alias("lang"), F.col("hangul").alias("word"), F.concat(F.split("hangul", ""), F.array(F.lit("ɯ"))).alias("phonemes")).distinct()
    got = pronounce.table(spoken_words(spark, sf_dir), forms, th)
    return got.select("word", F.array_join("phonemes", "").alias("reading"), "from_loanword")


@query(f"WITH {sql.VOCAB}, c AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations) GROUP BY word), z AS (SELECT word, round(log10(n / (SELECT sum(n) FROM c)::DOUBLE) + 9, 4) AS zipf FROM c) SELECT 'en' AS lang, lex.word, lex.zipf AS stored, z.zipf AS computed FROM lex JOIN z ON z.word = lex.word WHERE abs(lex.zipf - z.zipf) > 0.0001")
def frequency_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of documents against those of conversations."""
    talk = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    computed = build.counts(talk, talk.distinct()).select(F.lit("en").alias("lang"), "word", "zipf")
    return build.frequency_differences(vocabulary(spark, sf_dir).select(F.lit("en").alias("lang"), "word", "zipf"), computed)


@query(f"WITH {sql.VOCAB}, r AS (SELECT word, replace(word, 'e', 'a') AS r FROM lex UNION ALL SELECT word, replace(word, 't', '') FROM lex WHERE word LIKE '%t%'), d AS (SELECT word, levenshtein(word, r) AS d, greatest(length(r), 1) AS n FROM r) SELECT word, round(least(1.0, min(d / n)), 9) AS error_rate, min(d) = 0 AS exact FROM d GROUP BY word")
def best_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word's letters against the nearer of two spellings."""
    from phonosearch.operators import pronounce

    v = vocabulary(spark, sf_dir).select("word")
    letters = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    refs = v.select("word", letters(F.replace("word", F.lit("e"), F.lit("a"))).alias("phonemes")).unionByName(v.where("word like '%t%'").select("word", letters(F.replace("word", F.lit("t"), F.lit(""))).alias("phonemes")))
    got = pronounce.best_of(v.select("word", letters("word").alias("phonemes")), refs, list("abcdefghijklmnopqrstuvwxyz"))
    return got.select("word", F.round("error_rate", 9).alias("error_rate"), "exact")


@query(f"WITH {EDGES}, c AS (SELECT first AS word, count(*) AS n FROM edge GROUP BY first) SELECT word, n, CAST(coalesce(sum(n) OVER (ORDER BY word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c")
def edge_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each word's followers begin if all are written one after the other."""
    heads = edges(spark, sf_dir).groupBy(F.col("first").alias("word")).agg(F.count("*").alias("n"))
    return build.offsets(heads, "word", "n").select("word", "n", F.col("start").cast("bigint").alias("start"))


@query(f"WITH {sql.LAYERS}, s AS (SELECT native AS x FROM layers UNION SELECT koreanized FROM layers) SELECT count(*) AS words, CAST(0 AS BIGINT) AS ko, count(*) AS en, CAST(0 AS BIGINT) AS without_own_reading, (SELECT count(*) FROM s) AS sequences FROM layers")
def lexicon_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build.lexicon_statistics(lexicon(spark, sf_dir))


@query(f"WITH {sql.VOCAB}, c AS (SELECT substr(word, i, 1) AS symbol FROM lex, range(1, 30) t(i) WHERE i <= length(word)), d AS (SELECT DISTINCT word, substr(word, i, 1) AS symbol FROM lex, range(1, 30) t(i) WHERE i <= length(word)) SELECT symbol, count(*) AS n FROM d WHERE symbol IN ('c', 'f', 'j', 'q', 'r', 'v', 'w', 'z') AND NOT (symbol = 'w' AND word IN (SELECT word FROM lex WHERE NOT regexp_matches(word, 'w($|[^aeiou])'))) AND NOT (symbol = 'j' AND word IN (SELECT word FROM lex WHERE NOT regexp_matches(word, 'j($|[^aeoui])'))) GROUP BY symbol")
def unknown_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many words each letter stands that is no sound of the Korean inventory, if letters are events. A glide counts where no vowel follows."""
    from phonosearch.operators import pronounce

    return pronounce.unknown_symbols(vocabulary(spark, sf_dir).select(F.split("word", "").alias("events")))


@query(f"WITH {sql.VOCAB}, {BENCH}, d AS (SELECT 'en' AS lang, word, row_number() OVER (ORDER BY length(word), word) AS ord FROM bw), r AS (SELECT 'en' AS lang, word FROM lex WHERE word NOT IN (SELECT word FROM bw)), u AS (SELECT lang, word, 0 AS late, ord FROM d UNION ALL SELECT lang, word, 1, NULL FROM r) SELECT lang, word, row_number() OVER (ORDER BY late, ord, word) - 1 AS place FROM u")
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's words from short to long, then all others in order."""
    b = build.ranks(bench_words(spark, sf_dir), F.length("word"), F.col("word"), name="ord").select(F.lit("en").alias("lang"), "word", "ord")
    return build.ordered_union(b, vocabulary(spark, sf_dir).select(F.lit("en").alias("lang"), "word"))


@query(f"WITH {sql.VOCAB}, {BENCH} SELECT bw.word, CASE WHEN n IS NULL THEN NULL WHEN (length(bw.word) * 31 + ascii(bw.word)) % 500 < 100 THEN NULL ELSE CAST((length(bw.word) * 31 + ascii(bw.word)) % 500 AS BIGINT) END AS topic_row FROM bw LEFT JOIN lex ON lex.word = bw.word")
def topic_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic row of each of the benchmark's words, null where a search goes on without a topic. Rows here go by length and first letter, and those below 100 are none."""
    from phonosearch.operators.topic import looked_up

    row = ((F.length("word") * 31 + F.ascii("word")) % 500).cast("bigint")
    lex = lexicon(spark, sf_dir).withColumn("topic_row", F.when(row >= 100, row).otherwise(-1))
    return looked_up(bench_words(spark, sf_dir), lex).select("word", "topic_row")


ARTIFACT = [("index.html", 100, "<script src='https://x.example/a.js'></script>"), ("app.js", 50, "fetch('https://ok.example/x'); fetch('/local')"), (".env", 5, None), ("big.bin", 200, None), ("model.onnx", 20, None)]
ALLOWED = ["index.html", "app.js", "big.bin", "model.onnx", "lost.css"]
PROBLEMS = [("index.html", "external"), (".env", "denied"), (".env", "unlisted"), ("big.bin", "too_large"), ("model.onnx", "denied"), ("lost.css", "missing"), (None, "over_budget")]


@query(f"SELECT name, problem FROM {sql.values(PROBLEMS, 'name, problem')}")
def artifact_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(ARTIFACT, "name string, bytes bigint, text string")
    return integrity.artifact_problems(files, ALLOWED, total=300, each=150, hosts=("ok.example",))


@query(f"WITH {sql.LAYERS} SELECT lang, count(*) AS words, sum(length(word))::BIGINT AS letters, sum(len(native))::BIGINT AS sounds FROM (SELECT 'en' AS lang, word, native FROM layers) GROUP BY lang")
def stored_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon written with its manifest, verified and read back."""
    from phonosearch.plans.testdata import folder
    from phonosearch.sources import files

    at = folder(spark, "stored-lexicon")
    files.write_lexicon(lexicon(spark, sf_dir), at, {"inventory": "1"})
    back = files.read_lexicon(spark, at, {"inventory": "1"})
    return back.groupBy("lang").agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("letters"), F.sum(F.length(F.get("native", F.lit(0)))).alias("sounds"))


# ---- Sources: what they read is written from the tables first -------------------------------------


def one_object(rows: DataFrame, key: str, value, at: str, inside: str | None = None) -> None:
    """A JSON object {key: value}, or {inside: {key: value}}, as one file: the formats that the sources read are such."""
    whole = F.map_from_entries(F.collect_list(F.struct(F.col(key), value)))
    rows.agg((F.struct(whole.alias(inside)) if inside else whole).alias("o")).select(F.to_json("o")).coalesce(1).write.text(at)


def scratch(spark: SparkSession, name: str) -> str:
    from phonosearch.plans.testdata import folder

    return folder(spark, name)


@query(f"WITH {sql.LAYERS} SELECT word, 'en' AS lang, zipf, CAST(len(native) AS INTEGER) AS sounds, array_to_string(native, ' ') AS spelled FROM layers")
def source_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.sources import files

    at = scratch(spark, "dictionary")
    sounds = F.split(spelled(native_code(F.col("word"))), " ")
    rows = vocabulary(spark, sf_dir).select("word", F.lit("en").alias("lang"), sounds.alias("phonemes"), "zipf")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(at)
    return files.dictionary(spark, at).select("word", "lang", "zipf", F.size("phonemes").alias("sounds"), F.array_join("phonemes", " ").alias("spelled"))


@query(f"WITH {sql.VOCAB} SELECT 'en' AS lang, word, CAST(length(word) AS INTEGER) AS n, array_to_string(string_split(word, ''), ' ') AS events FROM lex")
def source_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.sources import files

    at = scratch(spark, "events")
    vocabulary(spark, sf_dir).select(F.concat_ws("\t", F.lit("en"), "word", F.array_join(F.split("word", ""), "|"))).write.text(at)
    return files.raw_events(spark, at).select("lang", "word", F.size("events").alias("n"), F.array_join("events", " ").alias("events"))


@query(f"WITH {sql.VOCAB} SELECT word, upper(word) AS hangul FROM lex")
def source_loanwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.sources import files

    at = scratch(spark, "loanwords")
    one_object(vocabulary(spark, sf_dir), "word", F.array(F.upper("word"), F.col("word")), at)
    return files.loanwords(spark, at).select("word", "hangul")


@query(f"WITH {EDGES} SELECT first AS head, second AS next, n AS count FROM edge")
def source_word_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.sources import files

    at = scratch(spark, "bigrams")
    files.write_word_bigrams(edges(spark, sf_dir), at)
    return files.word_bigrams(spark, at).select("head", "next", "count")


BENCH_EDGES = "bp AS (SELECT word AS head, lead(word) OVER (PARTITION BY item_id ORDER BY pos) AS next FROM (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark))), be AS (SELECT head, next, count(*) AS n FROM bp WHERE next IS NOT NULL GROUP BY head, next)"


@query(f"WITH {BENCH_EDGES} SELECT head, upper(head) AS norm, next, n AS count, CASE WHEN next LIKE '%n' THEN upper(next) END AS next_norm FROM be")
def source_surface_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the benchmark's words, with normal forms of some."""
    from phonosearch.sources import files

    at = scratch(spark, "surfaces")
    w = table(spark, sf_dir, "benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    after = lambda k: F.slice("w", F.lit(k), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = w.select(F.explode(F.arrays_zip(after(1).alias("a"), after(2).alias("b"))).alias("p")).groupBy(F.col("p.a").alias("head"), F.col("p.b").alias("next")).agg(F.count("*").alias("n"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    entry = F.concat(F.lit("["), quoted(F.col("next")), F.lit(","), F.col("n").cast("string"), F.lit(",0.5"), F.when(F.col("next").like("%n"), F.concat(F.lit(","), quoted(F.upper("next")))).otherwise(""), F.lit("]"))
    heads = pairs.groupBy("head").agg(F.concat(quoted(F.col("head")), F.lit(":["), quoted(F.upper("head")), F.lit(",["), F.array_join(F.collect_list(entry), ","), F.lit("]]")).alias("x"))
    heads.agg(F.concat(F.lit('{"entries":{'), F.array_join(F.collect_list("x"), ","), F.lit("}}")).alias("value")).coalesce(1).write.text(at)
    return files.surface_bigrams(spark, at).select("head", "norm", "next", "count", "next_norm")


@query(f"WITH {sql.VOCAB} SELECT 'en' AS lang, word, zipf FROM lex")
def source_tab_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.sources import files

    at = scratch(spark, "tab")
    files.tab_separated(vocabulary(spark, sf_dir).select(F.lit("en").alias("lang"), "word", "zipf"), at)
    return files.read_tab_separated(spark, at, "lang string, word string, zipf double")


@query(f"WITH {sql.VOCAB} SELECT word, array_to_string(string_split(word, ''), ' ') AS sounds FROM lex")
def source_pronunciations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phonosearch.operators import pronounce
    from phonosearch.sources import files

    at = scratch(spark, "pronunciations")
    pronounce.write_json(spoken_words(spark, sf_dir), at)
    return files.pronunciations(spark, at, "en_koreanized").select("word", F.array_join("phonemes", " ").alias("sounds"))


#: Letters as events: each is a sound by itself; what they become is spelled by letters that no word has.
AS_SOUNDS = {"A": "ja", "E": "je", "O": "jo", "U": "ju", "B": "wa", "C": "we", "D": "wi", "Y": "wi", "R": "ɾ"}
MERGED = "regexp_replace(" * 9 + "replace(translate(word, 'bdgx', 'ptkh'), 'y', 'Y')" + "".join(f", '{a}', '{b}', 'g')" for a, b in (("ja", "A"), ("je", "E"), ("jo", "O"), ("ju", "U"), ("ji", "i"), ("wa", "B"), ("we", "C"), ("wi", "D"), ("w([ou])", "\\1")))


@query(f"WITH {sql.VOCAB}, m AS (SELECT word, regexp_replace({MERGED}, 'l([aeiouAEOUBCDY])', 'R\\1', 'g') AS x FROM lex) SELECT word, array_to_string(list_transform(string_split(x, ''), lambda c: coalesce({sql.map_of(AS_SOUNDS.items())}[c], c)), ' ') AS phonemes FROM m")
def normalize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words' letters as events of the Korean inventory."""
    n = vocabulary(spark, sf_dir).select("word", events.normalize(F.split("word", "")).alias("n"))
    return n.select("word", F.array_join("n.phonemes", " ").alias("phonemes"))
