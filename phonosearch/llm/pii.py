"""Personal data: keyed surrogates of the same type, in DataFrame functions only.

One pattern finds all entities of a text, so that they never overlap; the text is split at the same
places. An entity's canonical value (case folded, separators dropped) with a key gives its surrogate
through SHA-256, so every mention of a value gets the same surrogate in any notation, and without the key
nobody can tell which. Digits become digits, letters letters of the same case, hexadecimal stays hexadecimal,
country codes, issuers, top-level domains, titles and all separators stay, card numbers pass their check sum (numbers that
don't are none).

Names stand behind a title. Given names (by gender) and surnames are values of their own, from lists of the same script, so
"Mr John Smith" and "Mr Smith" share a surname. A full name that some titled mention of the corpus has is replaced wherever it stands in any text;
in a text with a titled mention, its surname is replaced without a title too.

Collision checks run over the table of the corpus's distinct values: where two values would get one
surrogate, or a surrogate is some value of the corpus, all but the first value get another attempt, until no
two meet. After GROW attempts a surrogate gets a character or a surname more. Mentions are joined to that table; only texts that hold an
entity or a learned name are ever shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Attempts after which a surrogate is made longer than its value.
GROW = 12

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SECRET = r"(?:password|passwd|secret|token|api_key|apikey|access_key)"
MALE = r"(?:Mr|Herr|Señor|Sr|Monsieur|Sir|Κύριος|κύριος|Κύριο|κύριο|Господин|господин|Г-н|г-н)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Κυρία|κυρία|Госпожа|госпожа|Г-жа|г-жа)"
NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: E.164: 7 to 15 digits behind a plus, each with one separator or bracket at most on either side; else groups of 2 to 4 digits.
INTERNATIONAL = (
    r"(?<![0-9A-Za-z+])\+[0-9](?:[ .-]?\(?[0-9]\)?){6,14}(?![0-9])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])"
)
#: (415) 555 0101, 415-555-0101 with any separator, and 9 to 11 digits in groups behind a zero (0170 1234567, 01 42 68 53 00).
NATIONAL = (
    r"(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9]|[0-9][.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
    r"|(?<![0-9A-Za-z.,+-])(?=(?: ?[0-9]){9,11}(?! ?[0-9]))0[1-9][0-9]{0,3}(?: [0-9]{2,8}){1,4}(?![0-9]|[.,-][0-9])"
)
#: Country codes as the ITU gives them, so that a number without separators is the same value; else what stands before a separator.
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}|[0-9]{1,2}(?=[ .(-]))"
#: Kind and pattern, in the order in which they are tried. Repeats are possessive or bounded: long runs of letters cost one look.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": rf"(?<![A-Za-z0-9])(?i:{SECRET}) ?[=:] ?[\"']?[A-Za-z0-9+/_-]{{8,}}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": rf"{INTERNATIONAL}|{NATIONAL}",
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? {NAME}(?: {NAME})?",
}
PATTERN = "|".join(PATTERNS.values())
#: Every entity holds a digit, an @, a key's prefix, a title or a secret's word: texts without one need no closer look.
HINT = rf"[0-9@]|AKIA|ASIA|(?i:{SECRET}) ?[=:]|(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{Lu}}"

#: Given names by script and gender, surnames by script.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Casper Dario Emil Felix Gustav Hugo Ivan Jonas Klaus Leon Marco Nils Oscar Pablo Quentin Rafael Simon Tobias Ulrich Victor Walter Xaver".split(),
    ("latin", "f"): "Alina Bianca Carla Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nadia Olga Paula Rosa Sofia Teresa Ursula Vera Wanda Xenia Yvonne".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Григорий Дмитрий Егор Иван Кирилл Максим Николай Олег Павел".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Ирина Ксения Мария Нина Ольга Полина".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Ηλίας Θανάσης Ιάσονας Κώστας Λεωνίδας Μανώλης Νίκος Πέτρος".split(),
    ("greek", "f"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ιωάννα Κατερίνα Λυδία Μαρία Ρένα Σοφία".split(),
}
SURNAMES = {
    "latin": "Abel Bauer Castell Dorn Engel Falk Grau Holm Ibarra Jansen Keller Lorca Moreau Nolde Orban Prado Quint Renard Sommer Torres Urban Vidal Wenzel Zamora".split(),
    "cyrillic": "Белов Волков Громов Дубов Ершов Зайцев Климов Лосев Морозов Носков Орлов Петров".split(),
    "greek": "Αλεξίου Βλάχου Γεωργίου Δήμου Ευαγγέλου Ιωάννου Κωνσταντίνου Λάμπρου Μιχαήλ Νικολάου Οικονόμου Παύλου".split(),
}


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(list(PATTERNS.items())[:-1]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def kept_part(kind: Column, entity: Column) -> Column:
    """What stays in front of an entity: a title, a secret's word, a country code, a card's issuer."""
    return (
        F.when(kind == "name", F.regexp_extract(entity, r"^\S+ ", 0))
        .when(kind == "secret", F.regexp_extract(entity, rf"^(?i:{SECRET}) ?[=:] ?[\"']?", 0))
        .when(kind == "access_key", F.substring(entity, 1, 4))
        .when(kind == "phone", F.regexp_extract(entity, COUNTRY, 0))
        .when(kind == "card", F.substring(entity, 1, 1))
        .when(kind == "iban", F.substring(entity, 1, 2))
        .otherwise("")
    )


def end_part(kind: Column, entity: Column) -> Column:
    """What stays behind: an address's top-level domain."""
    return F.when(kind == "email", F.regexp_extract(entity, r"\.[A-Za-z]+$", 0)).otherwise("")


def plain(kind: Column, body: Column) -> Column:
    """The letters and digits of an entity's changing part."""
    return F.when(kind.isin("ip", "name"), body).when(kind == "email", F.lower(F.regexp_replace(body, r"[^A-Za-z0-9]", ""))).otherwise(F.regexp_replace(body, r"[^A-Za-z0-9]", ""))


def noise(seed: Column, j: Column) -> Column:
    """The j-th number from 0 to 65535 of a keyed stream."""
    block = F.sha2(F.concat(seed, F.lit("/"), F.floor(j / 16).cast("string")), 256)
    return F.conv(F.substr(block, (4 * (j % 16) + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


def pick(names: list[str], at: Column) -> Column:
    return F.get(F.array(*(F.lit(x) for x in names)), at % len(names))


def script_of(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def surrogate(kind: Column, core: Column, seed: Column, attempt: Column) -> Column:
    """What takes the place of core, of the same kinds of characters and, for GROW attempts, of the same length; names and addresses by their own rules."""
    longer = F.floor(attempt / GROW)
    letters = F.split(F.concat(core, F.expr("repeat(right(core, 1), cast(floor(attempt / %d) as int))" % GROW)), "")
    hexadecimal = core.rlike("^[0-9a-f]{8,}$")

    def one(c: Column, j: Column) -> Column:
        v = noise(seed, j.cast("int"))
        return (
            F.when(hexadecimal & (kind == "secret"), F.substr(F.lit("0123456789abcdef"), v % 16 + 1, F.lit(1)))
            .when(c == "0", (v % 10).cast("string"))
            .when(c.rlike("[0-9]"), (v % 9 + 1).cast("string"))
            .when(c.rlike("[a-z]"), F.char(97 + v % 26))
            .when(c.rlike("[A-Z]"), F.char(65 + v % 26))
            .otherwise(c)
        )

    changed = F.array_join(F.transform(letters, one), "")
    ip = F.concat_ws(".", *((noise(seed, F.lit(i)) % 254 + 1).cast("string") for i in range(4)))
    # after some attempts a name has further parts, so that there are always more names than values
    parts = F.sequence(F.lit(0), F.floor(attempt / 3).cast("int") + longer.cast("int"))

    def name(names: list[str], end: Column) -> Column:
        return F.concat(F.array_join(F.transform(parts, lambda i: pick(names, noise(seed, i))), "-"), end)

    script, none = script_of(core), F.lit("")
    # surnames of women in Cyrillic end so
    she = F.when(core.rlike("[ая]$"), "а").otherwise("")
    family = F.when(script == "cyrillic", name(SURNAMES["cyrillic"], she)).when(script == "greek", name(SURNAMES["greek"], none)).otherwise(name(SURNAMES["latin"], none))
    given = {g: F.when(script == "cyrillic", name(GIVEN["cyrillic", g], none)).when(script == "greek", name(GIVEN["greek", g], none)).otherwise(name(GIVEN["latin", g], none)) for g in "mf"}
    return F.when(kind == "ip", ip).when(kind == "surname", family).when(kind == "given m", given["m"]).when(kind == "given f", given["f"]).otherwise(changed)


def passes(digits: Column) -> Column:
    """Whether the digits of a text pass the Luhn check."""
    places = F.transform(F.reverse(F.split(F.regexp_replace(digits, "[^0-9]", ""), "")), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def checked(issuer: Column, digits: Column) -> Column:
    """Digits whose last one is replaced so that issuer and digits pass the Luhn check."""
    n = F.length(digits)
    all_but = F.concat(issuer, F.substr(digits, F.lit(1), n - 1))
    places = F.transform(F.reverse(F.split(all_but, "")), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    total = F.aggregate(places, F.lit(0), lambda a, x: a + x)
    return F.concat(F.substr(digits, F.lit(1), n - 1), ((10 - total % 10) % 10).cast("string"))


def filled(kind: Column, body: Column, core: Column) -> Column:
    """A mention's own notation with the surrogate's letters and digits in their places."""
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("i"))

    def step(a: Column, c: Column) -> Column:
        new = F.substr(core, a["i"] + 1, F.lit(1))
        same_case = F.when(c.rlike("[A-Z]") & (kind == "email"), F.upper(new)).otherwise(new)
        return F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["s"], same_case).alias("s"), (a["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["i"].alias("i")))

    # what a longer surrogate has besides goes behind the rest
    whole = F.aggregate(F.split(body, ""), start, step, lambda a: F.concat(a["s"], F.substr(core, a["i"] + 1, F.length(core))))
    return F.when(kind.isin("ip", "name"), core).otherwise(whole)


def mentions(held: DataFrame) -> DataFrame:
    """row, pos, kind, before, body, after, core, canon, gender, given, surname: a row for each entity of rows with an array `entities`; card numbers that fail the check are none."""
    e = F.col("entity")
    at = held.select("row", F.posexplode("entities").alias("pos", "entity")).withColumn("kind", kind_of(e))
    at = at.where((F.col("kind") != "card") | passes(e))
    kind, body = F.col("kind"), F.col("body")
    at = at.withColumns({"before": kept_part(kind, e), "after": end_part(kind, e)})
    at = at.withColumn("body", F.substr("entity", F.length("before") + 1, F.length("entity") - F.length("before") - F.length("after")))
    at = at.withColumn("core", plain(kind, body))
    # an address's whole spelling is part of what it is
    canon = F.when(kind == "email", F.lower(e)).when(kind.isin("card", "phone", "iban"), F.concat(F.regexp_replace("before", "[^A-Z0-9]", ""), F.lit(":"), F.col("core"))).otherwise(F.col("core"))
    gender = F.when(kind == "name", F.when(F.col("before").rlike(f"^{FEMALE}"), "f").otherwise("m"))
    parts = F.split(body, " ")
    given = F.when((kind == "name") & (F.size(parts) > 1), parts[0])
    return at.withColumns({"canon": canon, "gender": gender, "given": given, "surname": F.when(kind == "name", F.element_at(parts, -1))}).drop("entity")


def values_of(spoken: DataFrame) -> DataFrame:
    """kind, canon, core, issuer of all that gets a surrogate: a name's parts, any other entity's core."""
    given = spoken.where("given is not null").select(F.concat(F.lit("given "), "gender").alias("kind"), F.col("given").alias("canon"), F.col("given").alias("core"), F.lit("").alias("issuer"))
    surname = spoken.where("surname is not null").select(F.lit("surname").alias("kind"), F.col("surname").alias("canon"), F.col("surname").alias("core"), F.lit("").alias("issuer"))
    return spoken.where("kind <> 'name'").select("kind", "canon", "core", F.col("before").alias("issuer")).unionByName(given).unionByName(surname)


def assign(values: DataFrame, key: str, rounds: int = 100) -> DataFrame:
    """kind, canon, core -> surrogate: one for each distinct value, no two of a kind alike and none that is a value itself.

    Each round halves what collides or better, as a surrogate that collides GROW times gets longer. Only IPv4 addresses can't:
    a corpus with most of the four thousand million of them ends in an error.
    """
    kind, canon = F.col("kind"), F.col("canon")
    at = cut(values.groupBy("kind", "canon").agg(F.min("core").alias("core"), F.min("issuer").alias("issuer")).withColumn("attempt", F.lit(0)))
    real = at.select("kind", F.col("core").alias("surrogate"), F.lit(True).alias("taken")).distinct()
    for _ in range(rounds):
        seed = F.concat_ws("|", F.lit(key), kind, canon, F.col("attempt").cast("string"))
        made = surrogate(kind, F.col("core"), seed, F.col("attempt"))
        found = at.withColumn("surrogate", made).withColumn("surrogate", F.when(kind == "card", checked(F.col("issuer"), F.col("surrogate"))).otherwise(F.col("surrogate")))
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "canon"))
        judged = cut(found.join(real, ["kind", "surrogate"], "left").withColumn("again", F.col("taken").isNotNull() | (first > 1)).drop("taken"))
        if judged.where("again").isEmpty():
            return judged.select("kind", "canon", "surrogate")
        at = judged.select("kind", "canon", "core", "issuer", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def entities_of(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


#: Two capitalised words side by side, overlapping ones too: what a full name looks like.
FULL = rf"(?<![\p{{L}}-])(?=({NAME} {NAME})(?![\p{{L}}-]))"


def full_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FULL), F.lit(1)))


def replaced_in(gap: Column, names: Column) -> Column:
    """A text between entities with the names (old, new) replaced where they stand as whole words, in their order."""
    return F.aggregate(names, gap, lambda g, n: F.regexp_replace(g, F.concat(F.lit(r"(?<![\p{L}-])"), n["old"], F.lit(r"(?![\p{L}-])")), n["new"]))


def surrogated(docs: DataFrame, key: str) -> DataFrame:
    """own (the row of docs as a struct), text (the new one, null if nothing was replaced), entities (how many), kinds (which, sorted)."""
    if not key:
        raise ValueError("surrogates need a key")
    text, row = F.col("text").cast("string"), F.monotonically_increasing_id()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    found = F.coalesce(text.rlike(HINT) & text.rlike(PATTERN), F.lit(False))
    some = whole.select("own", F.col("text"), entities_of(F.col("text")).alias("entities")).where(F.size("entities") > 0)
    held = cut(some.select("own", "entities", F.split("text", PATTERN, -1).alias("gaps"))).withColumn("row", row)  # the same at each reading of the files
    spoken = cut(mentions(held))
    table = assign(values_of(spoken), key)
    surnames, givens = table.where("kind = 'surname'").select(F.col("canon").alias("surname"), F.col("surrogate").alias("new_surname")), table.where("kind like 'given %'")
    named = spoken.where("kind = 'name'").select("row", "pos", "kind", "before", "gender", "given", "surname").join(surnames, "surname")
    named = named.join(givens.select(F.substring("kind", 7, 1).alias("gender"), F.col("canon").alias("given"), F.col("surrogate").alias("new_given")), ["gender", "given"], "left")
    other = spoken.where("kind <> 'name'").join(table, ["kind", "canon"]).select("row", "pos", "kind", F.concat("before", filled(F.col("kind"), F.col("body"), F.col("surrogate")), "after").alias("new"))
    title = named.select("row", "pos", "kind", F.concat("before", F.concat_ws(" ", "new_given", "new_surname")).alias("new"))
    entity = F.struct("pos", "new", "kind")
    lists = other.unionByName(title).groupBy("row").agg(F.array_sort(F.collect_list(entity)).alias("news"))

    none = whole.where(~found)
    learned = cut(named.where("given is not null").groupBy("given", "surname").agg(F.min(F.struct("gender", "new_given", "new_surname")).alias("new")))
    full = small(learned.select(F.concat_ws(" ", "given", "surname").alias("old"), F.concat_ws(" ", "new.new_given", "new.new_surname").alias("new")))
    bare = named.select("row", F.struct(F.lit(1).alias("rank"), F.col("surname").alias("old"), F.col("new_surname").alias("new")).alias("name")).distinct()
    if not learned.isEmpty():
        # texts without an entity that hold a learned name are brought in; a doc_id and a text's hash say which
        th = F.xxhash64("text").alias("th")
        keyed = none.select("own", "doc_id", "text", th)
        hits = keyed.select("doc_id", "th", F.explode(full_names(F.col("text"))).alias("old")).join(full, "old", "left_semi").select("doc_id", "th").distinct()
        hits = small(hits)
        same = keyed["doc_id"].eqNullSafe(hits["doc_id"]) & (keyed["th"] == hits["th"])
        more = keyed.join(hits, same, "left_semi").select("own", F.array().cast("array<string>").alias("entities"), F.array("text").alias("gaps"))
        none = keyed.join(hits, same, "left_anti").select("own", "text")
        held = held.unionByName(cut(more).withColumn("row", -1 - row))
        spoken_rows = held.select("row", F.explode(full_names(F.array_join("gaps", "\n"))).alias("old"))
        full_here = spoken_rows.join(full, "old").select("row", F.struct(F.lit(0).alias("rank"), "old", "new").alias("name"))
        bare = bare.unionByName(full_here)
    names = bare.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    done = held.join(lists, "row", "left").join(names, "row", "left")
    names = F.coalesce("names", F.array().cast("array<struct<rank:int,old:string,new:string>>"))
    news = F.map_from_arrays(F.coalesce(F.col("news")["pos"], F.array().cast("array<int>")), F.coalesce(F.col("news")["new"], F.array().cast("array<string>")))
    # what the pattern found but is no entity stays as it is
    between = F.transform("entities", lambda e, i: F.coalesce(F.try_element_at(F.col("by_pos"), i), e))
    gaps = F.transform("gaps", lambda g: replaced_in(g, F.col("names")))
    done = done.withColumns({"by_pos": news, "names": names}).withColumns({"new": F.array_join(F.zip_with(gaps, between, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), ""), "old": F.array_join(F.zip_with("gaps", "entities", lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")})
    kinds = F.coalesce(F.array_distinct(F.col("news")["kind"]), F.array().cast("array<string>"))
    changed = F.col("new") != F.col("old")
    kinds = F.when(changed & (F.size("names") > 0), F.array_union(kinds, F.array(F.lit("name")))).otherwise(kinds)
    out = done.select("own", F.when(changed, F.col("new")).alias("text"), F.coalesce(F.size("news"), F.lit(0)).alias("entities"), F.array_sort(kinds).alias("kinds"))
    return none.select("own", F.lit(None).cast("string").alias("text"), F.lit(0).alias("entities"), F.array().cast("array<string>").alias("kinds")).unionByName(out)


def columns_of(docs: DataFrame, names: list[str]) -> list[Column]:
    """Those columns of surrogated(docs), with the new text and its length."""
    types, new = dict(docs.dtypes), F.col("text")
    swap = {"text": F.coalesce(new, F.col("own.text").cast("string"))} | ({"n_chars": F.when(new.isNotNull(), F.length(new).cast(types["n_chars"])).otherwise(F.col("own.n_chars"))} if "n_chars" in names else {})
    return [swap[c].alias(c) if c in swap else F.col(f"own.`{c}`") for c in names]


def pseudonymized(docs: DataFrame, key: str) -> DataFrame:
    """The rows of docs with all columns; in text every entity is replaced.

    Null and empty texts, and texts without an entity, stay as they are. Repeated rows stay repeated and
    are changed alike. A column n_chars, if there is one, gets the new length where a text changes. Names of other columns don't
    matter. Of a name that is learned with both genders the male surrogate is taken where no title tells. An empty table gives an empty result.
    """
    return surrogated(docs, key).select(*columns_of(docs, docs.columns))


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """pseudonymized() with _entities_ (how many the pattern found) and _kinds_ (which, sorted); columns of docs of these two names give way."""
    names = [c for c in docs.columns if c not in ("_entities_", "_kinds_")]
    return surrogated(docs, key).select(*columns_of(docs, names), F.col("entities").alias("_entities_"), F.col("kinds").alias("_kinds_"))
