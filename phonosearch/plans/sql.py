"""DuckDB text that the oracle queries share: tables as VALUES, the adapter's lexicon, the kernel."""

from __future__ import annotations

from phonosearch.functions.inventory import CONSONANTS, VOWELS
from phonosearch.functions.similarity import Config
from phonosearch.plans.testdata import LETTERS, STOPS, TO_KOREAN


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    """(VALUES ...) AS v(columns) as a subquery."""
    one = lambda x: text(x) if isinstance(x, str) or x is None else "[" + ", ".join(map(one, x)) + "]" if isinstance(x, (list, tuple)) else ("true" if x else "false") if isinstance(x, bool) else repr(x)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns}))"


def map_of(pairs) -> str:
    pairs = list(pairs)
    return "MAP([" + ", ".join(text(k) for k, _ in pairs) + "], [" + ", ".join(text(v) for _, v in pairs) + "])"


C = Config()
INVENTORY = values([(p, True, *map(float, f), 0.0) for p, f in VOWELS.items()] + [(p, False, *map(float, f)) for p, f in CONSONANTS.items()], "p, v, f1, f2, f3, f4")


def unit(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def vowel(h: str, b: str, r: str) -> str:
    w = C.vowel
    return unit(f"({h}) * ({b}) * ({r}) * {C.strict}::DOUBLE + (({h}) * {w[0]}::DOUBLE + ({b}) * {w[1]}::DOUBLE + ({r}) * {w[2]}::DOUBLE) * {C.blend}::DOUBLE")


def tiers(d: str, caps, beyond: float) -> str:
    return "CASE " + " ".join(f"WHEN {d} <= {x} THEN {cap}::DOUBLE" for x, cap in caps) + f" ELSE {beyond}::DOUBLE END"


def consonant(p: str, m: str, s: str, v: str) -> str:
    w = C.consonant
    near = " + ".join(f"{unit(f'1.0::DOUBLE - ({d})')} * {k}::DOUBLE" for d, k in zip((p, m, s, v), w))
    caps = [f"CASE WHEN {p} > 0 THEN {tiers(p, C.place_caps, C.place_else)} ELSE 1.0::DOUBLE END", f"CASE WHEN {m} > 0 THEN {tiers(m, C.manner_caps, C.manner_else)} ELSE 1.0::DOUBLE END", f"CASE WHEN {p} > 0 AND {m} > 0 THEN {C.both}::DOUBLE ELSE 1.0::DOUBLE END"]
    return unit(f"least({near}, {', '.join(caps)})")


SIM = f"""inv AS (SELECT p, v, f1::DOUBLE f1, f2::DOUBLE f2, f3::DOUBLE f3, f4::DOUBLE f4 FROM {INVENTORY}),
sim AS (SELECT a.p AS a, b.p AS b, CASE WHEN a.p = b.p THEN 1.0::DOUBLE WHEN a.v AND b.v THEN {vowel(*(unit(f"1.0::DOUBLE - abs(a.f{i} - b.f{i})") for i in (1, 2, 3)))}
  WHEN NOT a.v AND NOT b.v THEN {consonant(*(f"abs(a.f{i} - b.f{i})" for i in (1, 2, 3, 4)))} ELSE 0.0::DOUBLE END AS s, a.v AS va FROM inv a CROSS JOIN inv b)"""

WORDS = "tok AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"
VOCAB = f"{WORDS}, cnt AS (SELECT word, count(*) AS n FROM tok GROUP BY word), lex AS (SELECT word, n, round(log10(n / (SELECT sum(n) FROM cnt)::DOUBLE) + 9, 4) AS zipf FROM cnt)"
NATIVE = f"list_transform(string_split(replace(word, 'x', 'ks'), ''), lambda c: {map_of(LETTERS.items())}[c])"
KOREANIZED = f"list_transform(native, lambda c: coalesce({map_of(TO_KOREAN.items())}[c], c))"
LAYERS = f"{VOCAB}, nat AS (SELECT word, n, zipf, {NATIVE} AS native FROM lex), kor AS (SELECT *, {KOREANIZED} AS k0 FROM nat), layers AS (SELECT word, n, zipf, native, CASE WHEN k0[len(k0)] IN ({', '.join(map(text, STOPS))}) THEN list_append(k0, 'ɯ') ELSE k0 END AS koreanized FROM kor)"


def scored(name: str, source: str, key: str, sounds: str, query, parts: str = "both", shortcut: bool = True) -> str:
    """CTEs that end in `name`(key, s): the kernel's score of each row of source, whose list of sounds is given.

    Each target sound becomes a list [its weight, its similarity with each query sound]; the alignment's row is
    folded over them, and the window's shares are sums of what leads.
    """
    q, w = list(query.phonemes), list(query.weights)
    m, own = len(q), 0.0
    first = [0.0]
    for x in w:
        own += x
        first.append(first[-1] + x)
    d = lambda x: f"{x!r}::DOUBLE"
    sims = ", ".join(f"max(CASE WHEN b = {text(p)} THEN s END)" for p in q)
    keep = "WHERE va" if query.vowels_only else ""
    # the new row, each cell from the one before it
    cell, cells = "acc[1] + r[1]", []
    names = []
    for j in range(m):
        names.append(cell)
        cell = f"least(least(({cell}) + {d(w[j])}, acc[{j + 2}] + r[1]), acc[{j + 1}] + greatest(r[1], {d(w[j])}) * (1 - r[{j + 2}]))"
    names.append(cell)
    cells = ", ".join(names)
    window = " + ".join(f"lead(r[{j + 2}], {j}) OVER w * {d(w[j])}" for j in range(m))  # null beyond the last sound
    dp = f"CASE WHEN greatest(total, {d(own)}) > 0 THEN greatest(1 - dist / greatest(total, {d(own)}), 0) * 100 ELSE 0.0 END"
    slide = "coalesce(slide, 0.0)"
    slid = f"SELECT k, max(x) AS slide FROM (SELECT k, ({window}) / {d(own)} * 100 AS x FROM {name}_hit WINDOW w AS (PARTITION BY k ORDER BY i)) GROUP BY k" if own > 0 and m else f"SELECT k, 0.0::DOUBLE AS slide FROM {name}_hit GROUP BY k"
    best = {"both": f"greatest({dp}, {slide})", "alignment": dp, "window": slide}[parts]
    joined = text("".join(q))
    return f"""{name}_sim AS (SELECT a, [CASE WHEN bool_or(va) THEN {d(query.vowel_weight)} ELSE {d(query.consonant_weight)} END, {sims}] AS r, bool_or(va) AS va FROM sim GROUP BY a),
{name}_src AS (SELECT {key} AS k, {sounds} AS ph FROM {source}),
{name}_pos AS (SELECT k, unnest(ph) AS p, generate_subscripts(ph, 1) AS i FROM {name}_src),
{name}_hit AS (SELECT k, i, p, r FROM {name}_pos JOIN {name}_sim ON p = a {keep}),
{name}_rows AS (SELECT k, list(r ORDER BY i) AS rows, string_agg(p, '' ORDER BY i) AS joined FROM {name}_hit GROUP BY k),
{name}_win AS ({slid}),
{name}_dist AS (SELECT k, joined, list_sum(list_transform(rows, lambda r: r[1])) AS total, list_reduce(list_prepend([{', '.join(map(d, first))}], rows), lambda acc, r: [{cells}])[{m + 1}] AS dist FROM {name}_rows),
{name} AS (SELECT k, {f"CASE WHEN joined = {joined} THEN 100.0::DOUBLE ELSE {best} END" if shortcut else best} AS s FROM {name}_dist JOIN {name}_win USING (k))"""


def frequency(score: str, zipf: str, weight: float) -> str:
    z, w = f"coalesce({zipf}, 1.0::DOUBLE)", f"{weight / 10!r}::DOUBLE"
    return f"CASE WHEN {z} >= 3.5 THEN {score} + (100 - {score}) * (least(1.0::DOUBLE, ({z} - 3.5::DOUBLE) / 4.5::DOUBLE) * {w} * 0.8::DOUBLE) ELSE {score} * (1 - pow((3.5::DOUBLE - greatest(0.0::DOUBLE, {z})) / 3.5::DOUBLE, 2.5::DOUBLE) * {w}) END"


def topic(score: str, similarity: str, weight: float) -> str:
    return f"({score}) * (1 - (1 - greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({similarity} + 1) / 2))) * {weight / 10 * 0.7!r}::DOUBLE)"


def key(score: str) -> str:
    return f"CAST(floor(({score}) * 1000 + 0.5) AS BIGINT)"
