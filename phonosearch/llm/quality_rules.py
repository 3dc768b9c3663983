"""Quality rules as a learned decision list, in DataFrame functions only.

Statistics of each text are Spark expressions. A list of rules is learned by sequential covering on the
statistics of labelled documents: a rule grows, one threshold at a time, by the condition of greatest
information gain on a growing part, is pruned from its end on a pruning part, and is kept while it is
precise there; what it covers is taken away and the next rule is grown. The list is emitted as an ordered
conditional expression: the first rule that holds rejects, no rule keeps.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the labelled rows that rules are learned from.
SAMPLE_ROWS = 20_000
SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"
#: Positions in a packed window number: 24 bits.
PLACE_BITS = 24


def occurrences(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def statistics(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the contract's counts and the features of the rules, for each row of docs, as bigint and double."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    at0 = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), *more)
    at1 = at0.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), "")).withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]")))
    word = lambda i: F.get("words", i)
    hashed = F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.shiftleft(F.xxhash64(word(i), word(i + 1), word(i + 2)), PLACE_BITS).bitwiseOR(i.cast("bigint")))
    at2 = at1.select(
        "doc_id", *more, "words", F.size("words").cast("bigint").alias("n_words"), F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        reduce(lambda a, b: a + b, (occurrences(F.col("text"), c) for c in SYMBOLS)).cast("bigint").alias("n_symbols"),
        occurrences(F.col("text"), "!").cast("bigint").alias("n_marks"), F.regexp_count("text", F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.array_distinct("words")).cast("bigint").alias("n_distinct"),
        # windows whose hash stands beside an equal one may be repeated, all others are not; sorted longs, no strings
        F.when(F.size("words") < 4, F.array().cast("array<bigint>")).otherwise(F.sort_array(hashed)).alias("packed"),
    )
    packed = F.col("packed")
    kind = lambda x: F.shiftrightunsigned(x, PLACE_BITS)
    near = F.transform(packed, lambda x, i: F.when((kind(x) == kind(F.get(packed, i - 1))) | (kind(x) == kind(F.get(packed, i + 1))), x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).otherwise(F.lit(-1)))
    some = F.filter(near, lambda p: p >= 0)
    every = F.sequence(F.lit(0).cast("bigint"), F.size("words").cast("bigint") - 3)  # beyond 24 bits of places, all are looked at
    at3 = at2.withColumn("maybe", F.when(F.size("words") > (1 << PLACE_BITS), every).otherwise(some)).drop("packed")
    # the words themselves decide
    spelled = F.transform("maybe", lambda p: F.struct(F.concat_ws(" ", word(p.cast("int")), word(p.cast("int") + 1), word(p.cast("int") + 2)).alias("s"), p.alias("p")))
    at4 = at3.withColumn("spelled", F.when(F.size("maybe") < 2, F.slice(spelled, 1, 0)).otherwise(F.sort_array(spelled))).drop("maybe", "words")
    s = F.col("spelled")
    same = F.transform(s, lambda x, i: F.when((x["s"] == F.get(s, i - 1)["s"]) | (x["s"] == F.get(s, i + 1)["s"]), x["p"]).otherwise(F.lit(-1)))
    at5 = at4.withColumn("starts", F.sort_array(F.filter(same, lambda p: p >= 0))).drop("spelled")
    n = F.size("starts")
    apart = F.zip_with(F.slice("starts", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("starts", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3).cast("bigint")))
    at6 = at5.withColumn("n_repeat_words", F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(apart, F.lit(3).cast("bigint"), lambda a, x: a + x))).drop("starts")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1)).cast("double")
    return at6.select(
        "doc_id", *more, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("word_chars", "n_words").alias("mean_word"), share("n_symbols", "n_words").alias("symbols_per_word"), share("n_marks", "n_words").alias("marks_per_word"),
        share("n_upper", "word_chars").alias("upper_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_distinct", "n_words").alias("distinct_share"),
    )


FEATURES = ("mean_word", "symbols_per_word", "marks_per_word", "upper_share", "dup_line_share", "repeat_share", "distinct_share")
Condition = tuple[str, str, float]


def holds(row: dict, rule: list[Condition]) -> bool:
    return all(row[f] >= t if op == ">=" else row[f] <= t for f, op, t in rule)


def thresholds(values: list[float], most: int = 32) -> list[float]:
    """Midpoints between distinct values, at quantiles if there are many."""
    found = sorted(set(values))
    mid = [(a + b) / 2 for a, b in zip(found, found[1:])]
    return mid if len(mid) <= most else [mid[i * len(mid) // most] for i in range(most)]


def gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def grow(rows: list[dict], most: int = 3) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most and any(not r["bad"] for r in rows):
        p0 = sum(r["bad"] for r in rows)
        n0, best = len(rows) - p0, (0.0, None)
        if not p0:
            break
        for f in FEATURES:
            order = sorted(rows, key=lambda r: r[f])
            cuts = thresholds([r[f] for r in rows])
            below, at = [0, 0], 0
            for t in cuts:
                while at < len(order) and order[at][f] <= t:
                    below[order[at]["bad"]] += 1
                    at += 1
                for op, p, n in (("<=", below[1], below[0]), (">=", p0 - below[1], n0 - below[0])):
                    if (g := gain(p, n, p0, n0)) > best[0]:
                        best = (g, (f, op, t))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [r for r in rows if holds(r, rule[-1:])]
    return rule


def worth(rows: list[dict], rule: list[Condition]) -> tuple[float, int]:
    got = [r["bad"] for r in rows if holds(r, rule)]
    p = sum(got)
    return ((2 * p - len(got)) / len(got) if got else -1.0), p


def learn(rows: list[dict], precise: float = 0.98, least: int = 4, most: int = 12) -> list[list[Condition]]:
    """An ordered list of rules for the rows whose `bad` is true.

    A third of the rows prunes. A rule stays if it is right in `precise` of what it covers, growing and
    pruning parts together, of at least `least` bad rows; the first that isn't ends the list.
    """
    rules: list[list[Condition]] = []
    rest = [r | {"bad": int(r["bad"])} for r in rows]
    while len(rules) < most:
        growing, pruning = [r for r in rest if r["part"] != 0], [r for r in rest if r["part"] == 0]
        rule = grow(growing)
        while len(rule) > 1 and worth(pruning, rule[:-1]) >= worth(pruning, rule):
            rule = rule[:-1]
        got = [r["bad"] for r in rest if rule and holds(r, rule)]
        if sum(got) < least or sum(got) < precise * len(got):
            break
        rules.append(rule)
        rest = [r for r in rest if not holds(r, rule)]
    return rules


def expression(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds, else null."""
    out = F.lit(None).cast("int")
    for k in range(len(rules) - 1, -1, -1):
        test = reduce(lambda a, b: a & b, ((F.col(f) >= t) if op == ">=" else (F.col(f) <= t) for f, op, t in rules[k]))
        out = F.when(test, F.lit(k)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[list[Condition]]:
    """Rules from documents with a quality label (1 is good, 0 is bad), about sample_rows of them by hash of the id.

    Null ids and labels, and documents with contradicting labels, are not used. Without labels there are no rules.
    """
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    n = named.count()
    # at most a little over sample_rows rows of two numbers: small enough to send everywhere
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = named.where(part < int(min(1.0, sample_rows / max(1, n)) * (1 << 30))).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    own = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).join(F.broadcast(drawn), "doc_id")
    found = statistics(own, "quality").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3))).select("quality", "part", *FEATURES)
    rows = [r.asDict() | {"bad": r.quality == 0} for r in found.collect()]
    return learn(sorted(rows, key=lambda r: tuple(r[f] for f in FEATURES)))


def judge(docs: DataFrame, rules: list[list[Condition]]) -> DataFrame:
    """doc_id, the counts, base_failed, rule (the first that rejects, from 0), kept, for each row of docs.

    Null and empty texts have no words: their counts are zero and they fail the base test. Lines without a word are not
    counted as duplicates. Columns other than doc_id and text are not looked at. Repeated rows are judged each; an empty
    table gives an empty result; a statistic equal to a rule's threshold meets it.
    """
    own = statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).withColumn("rule", expression(rules))
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))
