"""Word search over a lexicon table.

A lexicon has word_id, word, lang, zipf, ord and the layers ko, native and koreanized, each an array of
sequences as codes. All of a word's pronunciations are in its row, so its best score needs no shuffle:
filters come first, then one Arrow function for each pairing, then the threshold.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonosearch.functions.inventory import VOWELS, decode
from phonosearch.functions.scores import frequency_weight, tie_key, topic_weight
from phonosearch.functions.text import holds_any
from phonosearch.operators.kernel import best_score, match_indices, score_codes
from phonosearch.plans.request import Request, pairings

THRESHOLD, PAGE = 40.0, 99
LAYERS = ("ko", "native", "koreanized")


def candidates(lexicon: DataFrame, request: Request) -> DataFrame:
    """Words of the asked languages that are not the query itself and hold no excluded part."""
    r = request.normalized()
    lower = F.lower("word")
    out = lexicon.where(F.col("lang").isin(*r.languages)).where(lower != r.query.lower())
    return out.where(~holds_any(F.col("word"), list(r.exclude))) if r.exclude else out


def layer_of(layer: str):
    return F.when(F.size("ko") > 0, F.col("ko")).otherwise(F.col("native")) if layer == "ko" else F.col(layer)


def score_raw(lexicon: DataFrame, request: Request) -> DataFrame:
    """The candidates with raw, the best phonetic score; null where there is nothing to compare.

    raw depends on pronunciation settings alone, so that other settings rank the same rows again.
    """
    out, columns = candidates(lexicon, request), {}
    for k, (lang, layer, queries, _, cross) in enumerate(pairings(request)):
        if lang not in request.languages:
            continue
        test = F.col("lang") == lang
        lists = F.when(test & (F.size("koreanized") > 0) if cross else test, layer_of(layer))
        columns[f"_score_{k}"] = best_score(lists, list(queries))
    names = [F.col(c) for c in columns]
    raw = F.greatest(*names) if len(names) > 1 else names[0] if names else F.lit(None).cast("double")
    return out.withColumns(columns).withColumn("raw", raw).drop(*columns)


def rank(raw: DataFrame, request: Request) -> DataFrame:
    """Rows above the threshold with score and key; similarity, if a topic is on, must be a column of raw.

    The threshold is for the phonetic score alone. Words without a vector drop out while a topic is on.
    """
    out = raw.where(F.col("raw") > THRESHOLD).withColumn("score", frequency_weight(F.col("raw"), F.col("zipf"), request.frequency_weight))
    if request.topic_weight is not None:
        out = out.where(F.col("similarity").isNotNull()).withColumn("score", topic_weight(F.col("score"), F.col("similarity"), request.topic_weight))
    return out.withColumn("key", tie_key(F.col("score")))


def search(lexicon: DataFrame, request: Request) -> DataFrame:
    return rank(score_raw(lexicon, request), request)


def page(ranked: DataFrame, offset: int = 0, count: int = PAGE, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """`count` rows from `offset` on, with their rank from 1: a top-k of offset + count rows, never a full sort."""
    by = [F.desc("key"), *order]
    top = ranked.orderBy(*by).limit(offset + count)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*by))).where(F.col("rank") > offset)


def explain(rows: DataFrame, request: Request) -> DataFrame:
    """label, target and matched for each row of a page: the first pairing, pronunciation and query with the best score."""
    plan = pairings(request)
    kind = "struct<label:string,target:array<string>,matched:array<int>,best:double>"

    @F.arrow_udf(kind)
    def run(lang: pa.Array, ko: pa.Array, native: pa.Array, koreanized: pa.Array) -> pa.Array:
        out = []
        for own, *layers in zip(lang.to_pylist(), ko.to_pylist(), native.to_pylist(), koreanized.to_pylist()):
            named = dict(zip(LAYERS, (x or [] for x in layers)))
            best = None
            for at, layer, queries, label, cross in plan:
                if at != own or cross and not named["koreanized"]:
                    continue
                found = named["ko"] or named["native"] if layer == "ko" else named[layer]
                for code in found:
                    for q in queries:
                        s = float(score_codes(pa.array([code]), q)[0])
                        if best is None or s > best[0]:
                            best = (s, label, code, q)
            if best is None:
                out.append(None)
                continue
            s, label, code, q = best
            target = [p for p in decode(code) if not q.vowels_only or p in VOWELS]
            out.append({"label": label, "target": target, "matched": match_indices(target, q)[1], "best": s})
        return pa.array(out, pa.struct([("label", pa.string()), ("target", pa.list_(pa.string())), ("matched", pa.list_(pa.int32())), ("best", pa.float64())]))

    return rows.withColumn("_found", run("lang", *LAYERS)).select(*rows.columns, "_found.label", "_found.target", "_found.matched")


def batch_search(lexicon: DataFrame, requests: dict[str, Request], top: int = 10) -> DataFrame:
    """The best `top` words of each of many queries, in one pass over the lexicon.

    Each request's scores are columns of the same scan; a heap for each query and partition (the top-k
    aggregate) goes over the wire, never a row for each word and query.
    """
    columns, parts = {}, []
    for i, (name, r) in enumerate(requests.items()):
        plan, r = pairings(r), r.normalized()
        ok = F.col("lang").isin(*r.languages) & (F.lower("word") != r.query.lower()) & ~holds_any(F.col("word"), list(r.exclude))
        scores = []
        for j, (lang, layer, queries, _, cross) in enumerate(plan):
            if lang in r.languages:
                test = ok & (F.col("lang") == lang)
                columns[f"_score_{i}_{j}"] = best_score(F.when(test & (F.size("koreanized") > 0) if cross else test, layer_of(layer)), list(queries))
                scores.append(F.col(f"_score_{i}_{j}"))
        raw = F.greatest(*scores) if len(scores) > 1 else scores[0] if scores else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(name).alias("query"), raw.alias("raw"), F.lit(float(r.frequency_weight)).alias("weight")))
    own = ["word_id", "word", "lang", "zipf", "ord"]
    rows = lexicon.withColumns(columns).select(*own, F.explode(F.array(*parts)).alias("_part")).select(*own, "_part.*").where(F.col("raw") > THRESHOLD)
    z = rows.withColumn("score", weighted(rows)).withColumn("key", tie_key(F.col("score")))
    w = Window.partitionBy("query").orderBy(F.desc("key"), "ord")
    return z.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def weighted(rows: DataFrame):
    """frequency_weight() with the weight in a column."""
    z, share, s = F.coalesce("zipf", F.lit(1.0)), F.col("weight") / 10, F.col("raw")
    up = s + (100 - s) * (F.least(F.lit(1.0), (z - 3.5) / 4.5) * share * 0.8)
    down = s * (1 - F.pow((3.5 - F.greatest(F.lit(0.0), z)) / 3.5, F.lit(2.5)) * share)
    return F.when(z >= 3.5, up).otherwise(down)
