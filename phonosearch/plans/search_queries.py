"""Queries over the kernel, word search, linked search and topics, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonosearch.functions.scores import tie_key
from phonosearch.functions.similarity import Columns, consonant_similarity, phonemes, similarity_table, vowel_similarity
from phonosearch.operators import kernel, linked_search, topic, word_search
from phonosearch.plans import sql
from phonosearch.plans.request import Request, variants
from phonosearch.plans.testdata import edges, koreanized_sounds, lexicon, native_sounds, stored_edges, vocabulary
from phonosearch.session import table

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def request_for(word: str, **more) -> Request:
    return Request(word, tuple(native_sounds(word)), koreanized=(tuple(koreanized_sounds(word)),), **more)


BASIC = request_for("thing", mode="native")
HYBRID = request_for("anther")
K = "WITH " + sql.SIM + ", " + sql.LAYERS + ", "

#: Inputs of the published golden cases: feature similarities of vowels, differences of consonants.
GOLDEN_VOWELS = [(1, 1, 1), (0, 0, 0), (1, 0, 0), (0.5, 0.5, 0.5), (0.9, 0.1, 1), (0.3, 0.8, 0.55), (1, 1, 0), (0.75, 0.25, 0.5)]
GOLDEN_CONSONANTS = [
    (0, 0, 0, 0), (0.25, 0, 0, 0), (0.26, 0, 0, 0), (0.5, 0, 0, 0), (0.51, 0, 0, 0), (1, 0, 0, 0), (0, 0.25, 0, 0), (0, 0.26, 0, 0),
    (0, 0.5, 0, 0), (0, 0.51, 0, 0), (0, 1, 0, 0), (0.25, 0.25, 0, 0), (0.5, 0.5, 0.5, 0.5), (1, 1, 1, 1), (0.1, 0.9, 0.3, 0.7), (0.75, 0.2, 1, 0),
]


@query("WITH " + sql.SIM + " SELECT a, b, round(s, 9) AS s FROM sim")
def phoneme_similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_table(phonemes(spark)).select("a", "b", F.round("s", 9).alias("s"))


GOLD = [("v", i, *map(float, x), 0.0) for i, x in enumerate(GOLDEN_VOWELS)] + [("c", i, *map(float, x)) for i, x in enumerate(GOLDEN_CONSONANTS)]


@query(f"SELECT kind, CAST(n AS INTEGER) AS n, round(CASE WHEN kind = 'v' THEN {sql.vowel('a', 'b', 'c')} ELSE {sql.consonant('a', 'b', 'c', 'd')} END, 9) AS s FROM (SELECT kind, n, a::DOUBLE a, b::DOUBLE b, c::DOUBLE c, d::DOUBLE d FROM {sql.values(GOLD, 'kind, n, a, b, c, d')})")
def similarity_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.createDataFrame(GOLD, "kind string, n int, a double, b double, c double, d double")
    c = [F.col(x) for x in "abcd"]
    return df.select("kind", "n", F.round(F.when(F.col("kind") == "v", vowel_similarity(Columns, *c[:3])).otherwise(consonant_similarity(Columns, *c)), 9).alias("s"))


def kernel_query(name: str, request: Request, parts: str = "both", shortcut: bool = True) -> None:
    q = kernel.prepare(request.native, request.detail, request.vowel_weight, request.consonant_weight, request.use_detail, request.vowels_only)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lexicon(spark, sf_dir).select("word", tie_key(kernel.score(F.get("native", F.lit(0)), q, parts, shortcut)).alias("score"))

    run.__name__ = name
    query(K + sql.scored("x", "layers", "word", "native", q, parts, shortcut) + f" SELECT word, {sql.key('coalesce(s, 0.0)')} AS score FROM layers LEFT JOIN x ON word = k")(run)


kernel_query("kernel_score", BASIC)
kernel_query("edit_distance_weighted", BASIC, "alignment", False)
kernel_query("sliding_window_score", BASIC, "window", False)
kernel_query("kernel_vowel_only", replace(request_for("anthering"), vowels_only=True))
kernel_query("kernel_detail_weights", replace(BASIC, use_detail=True, detail=(1.0, 10.0, 5.0, 1.0, 3.0)))


@query(K + sql.scored("x", "layers", "word", "native", kernel.prepare(BASIC.native, None, 2.5, 1.0)) + f" SELECT word, {sql.key('s')} AS score FROM x JOIN layers ON word = k")
def kernel_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kernel by higher-order functions alone."""
    q = kernel.prepare(BASIC.native, None, 2.5, 1.0)
    from phonosearch.plans.testdata import native_code

    return vocabulary(spark, sf_dir).select("word", tie_key(kernel.plain_score(native_code(F.col("word")), q)).alias("score"))


def search_sql(r: Request) -> str:
    """raw(word, zipf, raw) of a request."""
    from phonosearch.plans.request import pairings

    parts, names = [], []
    for i, (lang, layer, queries, _, _) in enumerate(pairings(r)):
        if lang == "en":
            for j, q in enumerate(queries):
                parts.append(sql.scored(f"p{i}{j}", "cand", "word", layer, q))
                names.append(f"p{i}{j}")
    r = r.normalized()
    where = f"word <> {sql.text(r.query.lower())}" + "".join(f" AND NOT contains(word, {sql.text(e)})" for e in r.exclude)
    joins = " ".join(f"LEFT JOIN {n} ON {n}.k = word" for n in names)
    best = f"greatest({', '.join(f'coalesce({n}.s, 0.0)' for n in names)})"
    return K + f"cand AS (SELECT * FROM layers WHERE {where}), " + ", ".join(parts) + f", raw AS (SELECT word, zipf, {best} AS raw FROM cand {joins})"


def ranked_sql(r: Request) -> str:
    return search_sql(r) + f", ranked AS (SELECT word, zipf, raw, {sql.key(sql.frequency('raw', 'zipf', r.frequency_weight))} AS score FROM raw WHERE raw > 40)"


def word_query(name: str, request: Request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return word_search.search(lexicon(spark, sf_dir), request).select("word", tie_key(F.col("raw")).alias("raw"), F.col("key").alias("score"))

    run.__name__ = name
    query(ranked_sql(request) + f" SELECT word, {sql.key('raw')} AS raw, score FROM ranked")(run)


word_query("word_search_basic", BASIC)
word_query("word_search_native", replace(HYBRID, mode="native"))
word_query("word_search_koreanized", replace(HYBRID, mode="koreanized"))
word_query("word_search_hybrid", HYBRID)
word_query("word_search_exclude", replace(BASIC, exclude=("ing", " Th ")))
word_query("word_search_self_excluded", request_for("the", mode="native"))
word_query("word_search_vowels_only", replace(request_for("anthering", mode="native"), vowels_only=True))
word_query("word_rank_frequency", replace(BASIC, frequency_weight=8.0))


def page_query(name: str, request: Request, offset: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = word_search.page(word_search.search(lexicon(spark, sf_dir), request), offset)
        return found.select(F.col("rank").cast("bigint").alias("rank"), "word", F.col("key").alias("score"))

    run.__name__ = name
    query(ranked_sql(request) + f", numbered AS (SELECT row_number() OVER (ORDER BY score DESC, word) AS rank, word, score FROM ranked) SELECT * FROM numbered WHERE rank > {offset} AND rank <= {offset + 99}")(run)


page_query("word_page_1", BASIC, 0)
page_query("word_page_2", BASIC, 99)


@query()
def word_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page with the winning layer, its sounds and the matched places."""
    found = word_search.explain(word_search.page(word_search.search(lexicon(spark, sf_dir), HYBRID)), HYBRID)
    return found.select(F.col("rank").cast("bigint").alias("rank"), "word", F.col("key").alias("score"), "label", F.array_join("target", " ").alias("target"), F.array_join(F.transform("matched", lambda i: i.cast("string")), ",").alias("matched"))


BATCH = {w: request_for(w, mode="native") for w in ("thing", "anther", "onin", "hesh", "tion")}


def batch_sql() -> str:
    parts = [sql.scored(f"b{i}", "layers", "word", "native", kernel.prepare(r.native, None, r.vowel_weight, r.consonant_weight)) for i, r in enumerate(BATCH.values())]
    rows = " UNION ALL ".join(f"SELECT {sql.text(w)} AS query, word, {sql.key(sql.frequency('s', 'zipf', 1.0))} AS score FROM layers JOIN b{i} ON k = word WHERE word <> {sql.text(w)} AND s > 40" for i, w in enumerate(BATCH))
    return K + ", ".join(parts) + f", allrows AS ({rows}), numbered AS (SELECT query, word, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, word) AS rank FROM allrows) SELECT query, rank, word, score FROM numbered WHERE rank <= 10"


@query(batch_sql())
def batch_word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_search.batch_search(lexicon(spark, sf_dir), BATCH).select("query", F.col("rank").cast("bigint").alias("rank"), "word", F.col("key").alias("score"))


# ---- Linked search -----------------------------------------------------------------------------

LINKED = request_for("ander", mode="native", languages=("en",))
LINKED_HYBRID = request_for("anderin", mode="hybrid", languages=("en",))
EDGES = "pairs AS (SELECT word AS first, lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS second FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents))), edge AS (SELECT first, second, count(*) AS n FROM pairs WHERE second IS NOT NULL GROUP BY first, second)"


@query(f"WITH {EDGES} SELECT first, second, n FROM edge")
def bigram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir)


def split_rows(r: Request) -> list[tuple]:
    return [(s.number, len(s.left.phonemes), s.left_text, s.right_text, float(s.left_weight), float(s.right_weight)) for s in linked_search.splits(r, "en")]


def splits_sql(sounds: list[str]) -> str:
    """The split rule over a list of sounds."""
    vowels = ", ".join(sql.text(p) for p in sql.VOWELS)
    least = 1 if len(sounds) <= 4 else 2
    return f"SELECT CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS number, CAST(p AS INTEGER) AS place, array_to_string(ph[1:p], ' ') AS left_text, array_to_string(ph[p + 1:], ' ') AS right_text, CAST(p AS DOUBLE) AS left_weight, CAST(len(ph) - p AS DOUBLE) AS right_weight FROM (SELECT [{', '.join(map(sql.text, sounds))}] AS ph), range({least}, {len(sounds) - least + 1}) t(p) WHERE ph[p] IN ({vowels}) OR ph[p + 1] IN ({vowels})"


@query(splits_sql(list(LINKED.native)))
def linked_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(split_rows(LINKED), "number int, place int, left_text string, right_text string, left_weight double, right_weight double")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = lexicon(spark, sf_dir)
    return lex.select(F.col("word").alias("id"), F.col("word").alias("text"), F.lit(None).cast("string").alias("norm_text"), F.lit(False).alias("is_particle"), "zipf", "native", "koreanized")


def layers_of(r: Request) -> tuple[str, ...]:
    return {"native": ("native",), "koreanized": ("koreanized",)}.get(r.mode, ("native", "koreanized"))


def side_sql(name: str, q: kernel.Query, layer: str, side: str) -> str:
    """Boundary scores by layer: distinct parts are scored, then joined to words."""
    n = len(q.phonemes)
    part = f"{layer}[len({layer}) - {n - 1}:]" if side == "end" else f"{layer}[1:{n}]"
    return f"{name}_part AS (SELECT DISTINCT {part} AS ph FROM layers WHERE len({layer}) >= {n}), " + sql.scored(f"{name}_s", f"{name}_part", "array_to_string(ph, ' ')", "ph", q, "both", False) + f", {name} AS (SELECT word, CASE WHEN ph = [{', '.join(map(sql.text, q.phonemes))}] THEN 100.0::DOUBLE ELSE s END AS s FROM (SELECT word, {part} AS ph FROM layers WHERE len({layer}) >= {n}) JOIN {name}_s ON k = array_to_string(ph, ' '))"


def side_query(name: str, request: Request, side: str) -> None:
    plan = linked_search.splits(request, "en")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = units(spark, sf_dir).select("id", F.posexplode(linked_search.side_scores((F.col("native"),), plan, side)).alias("split", "s"))
        return got.where("s > 40").select(F.col("id").alias("word"), "split", tie_key(F.col("s")).alias("score"))

    run.__name__ = name
    parts = [side_sql(f"x{s.number}", s.left if side == "end" else s.right, "native", side) for s in plan]
    rows = " UNION ALL ".join(f"SELECT word, CAST({s.number} AS INTEGER) AS split, {sql.key('s')} AS score FROM x{s.number} WHERE s > 40" for s in plan)
    query(K + ", ".join(parts) + " " + rows)(run)


side_query("linked_boundary_left", LINKED, "end")
side_query("linked_boundary_right", LINKED, "start")


def collect_sql(r: Request) -> str:
    plan, layers = linked_search.splits(r, "en"), layers_of(r)
    parts, options = [], []
    for s in plan:
        for which, q, side in (("l", s.left, "end"), ("r", s.right, "start")):
            for layer in layers:
                parts.append(side_sql(f"{which}{s.number}_{layer}", q, layer, side))
            union = " UNION ALL ".join(f"SELECT word, s FROM {which}{s.number}_{layer}" for layer in layers)
            parts.append(f"{which}{s.number} AS (SELECT word, max(s) AS s FROM ({union}) GROUP BY word HAVING max(s) > 40)")
        options.append(f"SELECT first, second, {s.number} AS split, a.s AS l, b.s AS r, (a.s * {s.left_weight!r}::DOUBLE + b.s * {s.right_weight!r}::DOUBLE) / {s.left_weight + s.right_weight!r}::DOUBLE AS boundary FROM edge JOIN l{s.number} a ON a.word = first JOIN r{s.number} b ON b.word = second")
    blocked = "".join(f" AND NOT contains(first, {sql.text(e)}) AND NOT contains(second, {sql.text(e)})" for e in r.normalized().exclude)
    return K + EDGES + ", " + ", ".join(parts) + f", options AS ({' UNION ALL '.join(options)}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY first, second ORDER BY boundary DESC, split) AS rn FROM options WHERE true{blocked}) WHERE rn = 1)"


def pairs_of(spark: SparkSession, sf_dir: str, r: Request):
    u = units(spark, sf_dir)
    got, plan = linked_search.collect(u, stored_edges(spark, sf_dir), r, "en", layers_of(r))
    z = u.select("id", F.coalesce("zipf", F.lit(1.0)).alias("z"))
    both = got.join(z.select(F.col("id").alias("first"), F.col("z").alias("za")), "first").join(z.select(F.col("id").alias("second"), F.col("z").alias("zb")), "second")
    return both.withColumn("zipf", (F.col("za") + F.col("zb")) / 2), plan


def linked_query(name: str, request: Request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got, _ = linked_search.collect(units(spark, sf_dir), stored_edges(spark, sf_dir), request, "en", layers_of(request))
        return got.select("first", "second", "split", tie_key(F.col("left")).alias("left_score"), tie_key(F.col("right")).alias("right_score"), tie_key(F.col("boundary")).alias("boundary"))

    run.__name__ = name
    query(collect_sql(request) + f" SELECT first, second, CAST(split AS INTEGER) AS split, {sql.key('l')} AS left_score, {sql.key('r')} AS right_score, {sql.key('boundary')} AS boundary FROM best")(run)


linked_query("linked_collect", LINKED)
linked_query("linked_collect_hybrid", LINKED_HYBRID)
linked_query("linked_collect_exclude", replace(LINKED, exclude=("th",)))
LINKED_RANK = ", ranked AS (SELECT first, second, split, (a.zipf + b.zipf) / 2 AS zipf, boundary FROM best JOIN lex a ON a.word = first JOIN lex b ON b.word = second), scored AS (SELECT first, second, split, " + sql.key(sql.frequency("boundary", "zipf", 1.0)) + " AS score FROM ranked), numbered AS (SELECT row_number() OVER (ORDER BY score DESC, first, second) AS rank, * FROM scored)"


@query(collect_sql(LINKED) + LINKED_RANK + " SELECT rank, first, second, score FROM numbered WHERE rank <= 99")
def linked_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = pairs_of(spark, sf_dir, LINKED)
    page = word_search.page(linked_search.rank(pairs, LINKED), order=("first", "second"))
    return page.select(F.col("rank").cast("bigint").alias("rank"), "first", "second", F.col("key").alias("score"))


@query(collect_sql(LINKED) + LINKED_RANK + ", plan AS (" + splits_sql(list(LINKED.native)) + ") SELECT rank, first || ' + ' || second AS display, left_text || ' / ' || right_text AS split_label FROM numbered JOIN plan ON number = split WHERE rank <= 99")
def linked_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, plan = pairs_of(spark, sf_dir, LINKED)
    page = word_search.page(linked_search.rank(pairs, LINKED), order=("first", "second"))
    return linked_search.describe(page.withColumns({"first_text": F.col("first"), "second_text": F.col("second")}), plan).select(F.col("rank").cast("bigint").alias("rank"), "display", "split_label")


# ---- Topics -------------------------------------------------------------------------------------

EMB = """e AS (SELECT vec_id, [x::DOUBLE for x in embedding] AS v FROM embeddings), nrm AS (SELECT vec_id, v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, [x * x for x in v]), lambda a, x: a + x)) AS n FROM e),
unitv AS (SELECT vec_id, CASE WHEN n > 0 THEN [x / n for x in v] ELSE v END AS v, n FROM nrm), top AS (SELECT vec_id, v, list_max([abs(x) for x in v]) AS m FROM unitv),
vec AS (SELECT vec_id AS row_id, [CASE WHEN m > 0 THEN CAST(round_even(x / (m / 7), 0) AS INTEGER) ELSE 0 END for x in v] AS q FROM top),
inv_n AS (SELECT row_id, q, list_sum([CAST(x * x AS BIGINT) for x in q]) AS nn FROM vec), topicv AS (SELECT row_id, q, CASE WHEN nn > 0 THEN 1 / sqrt(nn::DOUBLE) ELSE 0.0 END AS inv_norm FROM inv_n)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] * z[2] AS BIGINT)))"


def topic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic.vectors(table(spark, sf_dir, "embeddings"))


@query(f"WITH {EMB} SELECT row_id, array_to_string([substr('0123456789abcdef', x + 9, 1) for x in q], '') AS packed FROM topicv")
def vector_pack_int4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_rows(spark, sf_dir).select("row_id", topic.packed(F.col("q")).alias("packed"))


@query(f"WITH {EMB} SELECT row_id, round(inv_norm, 9) AS inv_norm FROM topicv")
def vector_inverse_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the packed text, so that unpacking is part of it."""
    packed = topic_rows(spark, sf_dir).select("row_id", topic.unpacked(topic.packed(F.col("q"))).alias("q"))
    return packed.select("row_id", F.round(topic.inverse_norm(F.col("q")), 9).alias("inv_norm"))


@query(f"WITH {EMB} SELECT a.row_id, round({DOT.format(a='a.q', b='t.q')} * a.inv_norm * t.inv_norm, 9) AS similarity FROM topicv a CROSS JOIN (SELECT * FROM topicv WHERE row_id = 7) t")
def topic_cosine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic.similarity_to(topic_rows(spark, sf_dir), 7).select("row_id", F.round("similarity", 9).alias("similarity"))


@query(f"WITH {EMB}, s AS (SELECT a.row_id, {DOT.format(a='a.q', b='t.q')} * a.inv_norm * t.inv_norm AS s FROM topicv a CROSS JOIN (SELECT * FROM topicv WHERE row_id = 7) t) SELECT a.row_id AS first, b.row_id AS second, round(greatest(-1.0, least(1.0, (sa.s + sb.s) / sqrt(greatest(2 + 2 * ({DOT.format(a='a.q', b='b.q')} * a.inv_norm * b.inv_norm), 1e-9::DOUBLE)))), 9) AS similarity FROM topicv a JOIN topicv b ON b.row_id = a.row_id + 1 JOIN s sa ON sa.row_id = a.row_id JOIN s sb ON sb.row_id = b.row_id")
def pair_topic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = topic_rows(spark, sf_dir)
    s = topic.similarity_to(t, 7)
    side = lambda p, i: t.join(s, "row_id").select(F.col("row_id").alias(i), F.col("q").alias(f"{p}q"), F.col("inv_norm").alias(f"{p}inv_norm"), F.col("similarity").alias(f"{p}s"))
    both = side("a_", "first").withColumn("second", F.col("first") + 1).join(side("b_", "second"), "second")
    from phonosearch.functions.scores import pair_similarity

    return both.select("first", "second", F.round(pair_similarity(F.col("a_s"), F.col("b_s"), topic.cosine("a_", "b_")), 9).alias("similarity"))


TOPIC = replace(BASIC, topic_weight=6.0)


@query(search_sql(BASIC) + f", {EMB}, ts AS (SELECT a.row_id, {DOT.format(a='a.q', b='t.q')} * a.inv_norm * t.inv_norm AS s FROM topicv a CROSS JOIN (SELECT * FROM topicv WHERE row_id = 7) t), joined AS (SELECT word, zipf, raw, s FROM raw JOIN ts ON row_id = (len(word) * 31 + ascii(word)) % 500 WHERE raw > 40) SELECT word, {sql.key(sql.topic(sql.frequency('raw', 'zipf', 1.0), 's', 6.0))} AS score FROM joined")
def word_rank_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word's vector here is row (31 * length + first letter) mod 500 of embeddings."""
    s = topic.similarity_to(topic_rows(spark, sf_dir), 7)
    raw = word_search.score_raw(lexicon(spark, sf_dir), TOPIC).withColumn("row_id", ((F.length("word") * 31 + F.ascii("word")) % 500).cast("bigint"))
    return word_search.rank(raw.join(s, "row_id", "left"), TOPIC).select("word", F.col("key").alias("score"))


@query()
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = topic.vectors(topic.projected(table(spark, sf_dir, "embeddings"), 16), "row_id", "embedding")
    return small.select("row_id", topic.packed(F.col("q")).alias("packed"))


@query()
def quantization_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic.quantization_study(table(spark, sf_dir, "embeddings"))
