"""Keyword matching against dictionary entries, and the taxonomy of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiqua.functions import text
from lexiqua.operators.spread import spread
from lexiqua.sources.scratch import written

# The ordered family rules, and groups of files.
FAMILIES = [
    ("theorem", ["theorem", "proof"]), ("formula", ["formula", "=", "derivative", "integral"]), ("metabolite", ["metabolite", "intermediate", "enzyme"]),
    ("drug", ["drug", "analgesic", "recreational"]), ("atomic", ["electron", "ion", "nucleus", "quark"]), ("linear_algebra", ["matrix", "vector"]),
]
GROUPS = {
    "math": "algebra linear_algebra calculus math geometry complex_numbers probability statistics trigonometry vectors".split(),
    "science": "biology chemistry physics thermodynamics".split(), "code": ["code_dictionary"], "definitions": ["wikipedia_defs"],
}
#: Up to so many keywords, in so many rows, go into a plan as literals; more are joined by what they are made of.
LITERAL_KEYWORDS, LITERAL_ROWS = 1_000, 100_000
#: Letters of the parts on which keywords and texts meet, and keywords that are broadcast at a time.
GRAM, BROADCAST_KEYWORDS = 3, 500_000
#: Letters of a text that runs are taken of at a time, and letters from a run on that are compared before the whole keyword is looked for.
PIECE, AHEAD = 64, 16
#: Entries that a task judges, and rows of words of prompts that are broadcast.
ENTRY_ROWS, BROADCAST_WORDS = 50_000, 100_000
# Fixed value: what an equation in a gloss looks like.
EQUATION = r"([A-Za-z0-9()\[\]{}.+\-^_=/]+\s*=\s*[A-Za-z0-9().+\-^_/]+)"


def kingdom(file: Column) -> Column:
    stem = F.regexp_replace(file, r"\.json$", "")
    found = F.when(F.lit(False), "")
    for group, names in GROUPS.items():
        found = found.when(stem.isin(*names), group)
    return found.otherwise("other")


def family(gloss: Column) -> Column:
    g = F.lower(text.blank(gloss))
    found = F.when(F.lit(False), "")
    for name, marks in FAMILIES:
        any_mark = F.lit(False)
        for m in marks:
            any_mark = any_mark | g.contains(m)
        found = found.when(any_mark, name)
    return found.otherwise("general")


def order_of(gloss: Column) -> Column:
    """The first equation in a gloss, else its first 200 characters."""
    g = F.trim(text.blank(gloss))
    equation = F.regexp_extract(g, EQUATION, 1)
    return F.when(equation != "", equation).when(F.length(g) > 200, F.concat(F.substring(g, 1, 200), F.lit("..."))).otherwise(g)


def keyword_counts(tokens: Column) -> Column:
    """An array's words as structs ``less`` (minus the count), ``pos`` (first place), ``keyword``, most frequent first, ties by first place."""

    def counted(ordered: Column) -> Column:
        at = lambda i: F.get(ordered, i)
        starts = F.filter(F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (at(i)["w"] != at(F.greatest(i - 1, F.lit(0)))["w"]))
        each = lambda starts: F.transform(starts, lambda b, k: F.struct((b - F.coalesce(F.get(starts, k + 1), F.size(ordered))).alias("less"), at(b)["pos"].alias("pos"), at(b)["w"].alias("keyword")))
        return F.sort_array(F.get(F.transform(F.array(starts), each), F.lit(0)))

    # Each value is bound once: Catalyst computes an expression as often as it is written.
    placed = lambda t: F.sort_array(F.transform(t, lambda w, i: F.struct(w.alias("w"), i.alias("pos"))))
    whole = lambda t: F.when(F.size(t) > 0, F.get(F.transform(F.array(placed(t)), counted), F.lit(0)))
    return F.get(F.transform(F.array(tokens), whole), F.lit(0))


def keywords(df: DataFrame, id_cols: list[str], text_col: str, top: int = 6) -> DataFrame:
    """The most frequent keywords of each row's text, ties by first place: ``id_cols, keyword, n, rank``.

    All of a text's words are in its row, so they are sorted and counted there; nothing is shuffled.
    """
    counts = keyword_counts(text.keyword_tokens(F.col(text_col)))
    best = df.select(*id_cols, F.posexplode(F.slice(counts, 1, top)).alias("_at", "_k"))
    return best.select(*id_cols, F.col("_k.keyword").alias("keyword"), (-F.col("_k.less")).cast("long").alias("n"), (F.col("_at") + 1).alias("rank"))


def _judged(entries: DataFrame) -> DataFrame:
    """``entries``, spread over tasks, with the plain forms of what keywords are looked for in: ``_key``, ``_senses`` and all of it (``_whole``).

    They are computed once for an entry, not for each keyword.
    """
    some = F.coalesce("senses", F.array().cast(entries.schema["senses"].dataType))
    told = F.transform(some, lambda s: F.struct(text.normalize(s["gloss"]).alias("gloss"), F.transform(F.coalesce(s["synonyms"], F.array().cast("array<string>")), text.normalize).alias("synonyms")))
    plain = spread(entries, ENTRY_ROWS, "file", "key").withColumn("_key", text.normalize(F.col("key"))).withColumn("_senses", told)
    return plain.withColumn("_whole", F.concat_ws(" ", "_key", F.array_join(F.transform("_senses", lambda s: F.concat_ws(" ", s["gloss"], F.array_join(s["synonyms"], " "))), " ")))


def _literal(entries: DataFrame, words: list[str]) -> DataFrame:
    """``_judged`` entries with each keyword in them (``kw``: ``keyword``, ``normal``), which are literals of the plan."""
    kws = F.array(*[F.struct(F.lit(w).alias("keyword"), F.lit("".join(c for c in w.lower() if c.isascii() and c.isalnum())).alias("normal")) for w in dict.fromkeys(words)])
    return entries.withColumn("kw", F.explode(F.filter(kws, lambda k: (k["normal"] != "") & F.contains(F.col("_whole"), k["normal"]))))


def grams(c: Column, n: int = GRAM) -> Column:
    """The distinct runs of ``n`` letters and digits of a text in plain lower-case ASCII."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=([a-z0-9]{{{n}}}))"), F.lit(1)))


def _texts(entries: DataFrame) -> DataFrame:
    """``_judged`` entries, a row for each text of theirs (``text``, never empty) that keywords are looked for in, with its ``field`` and ``sense``.

    A sense's synonyms are one text, apart by spaces: no plain keyword holds one.
    """
    told = lambda field, sense, c: F.struct(F.lit(field).alias("field"), sense.alias("sense"), c.alias("text"))
    each = lambda s, i: F.array(told("synonym", i, F.array_join(s["synonyms"], " ")), told("gloss", i, s["gloss"]))
    texts = F.concat(F.array(told("key", F.lit(0), F.col("_key"))), F.flatten(F.transform("_senses", each)))
    return entries.select("file", "key", "senses", "_key", F.explode(texts).alias("_t")).select("file", "key", "senses", "_key", "_t.field", "_t.sense", "_t.text").filter("text <> ''")


def _runs(texts: DataFrame) -> DataFrame:
    """``texts`` with each run of up to ``GRAM`` characters of theirs (``gram``), and where it begins (``at``, from 1; ``_k`` in ``_piece``), as often as it is there.

    They are rows from the start: neither a pattern nor an array of texts is made for them. A place in a text is found by going there
    from its begin, so a long one is cut into pieces first.
    """
    cut = texts.withColumn("_p", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((length(text) - 1) div {PIECE} AS INT)"))))
    cut = cut.withColumn("_piece", F.expr(f"substring(text, _p * {PIECE} + 1, {PIECE + AHEAD - 1})")).withColumn("_n", F.length("_piece"))
    placed = cut.withColumn("_i", F.explode(F.sequence(F.lit(0), F.least(F.lit(PIECE), "_n") * GRAM - 1))).filter(f"_i div {GRAM} + _i % {GRAM} < _n")
    k = f"CAST(_i div {GRAM} AS INT) + 1"
    return placed.selectExpr(*texts.columns, "_piece", f"{k} AS _k", f"_p * {PIECE} + {k} AS at", f"substring(_piece, {k}, _i % {GRAM} + 1) AS gram")


def _listed(entries: DataFrame, words: DataFrame) -> DataFrame:
    """``gram, normal, keywords``: the plain keywords that may be in an entry, each with the keywords of ``words`` (``keyword``) that it stands for.

    A text can only hold a keyword if it holds all its runs of ``GRAM`` characters (a shorter keyword is a run of its own), so it is
    enough to meet on one of them: the one that is the rarest in entries; if none holds it, the keyword goes. Runs are of 36
    characters and spaces, so there are under 53 000 of them: their counts are small whatever the tables are. Most words of prose begin
    or end as nothing in entries does: they go before any are gathered.
    """
    counts = written(_runs(_texts(entries)).groupBy("gram").agg(F.count("*").alias("n")), "runs")
    # Of an array, so it is computed once: Catalyst computes an expression as often as it is read.
    kws = words.select("keyword").distinct().select("keyword", F.explode(F.array(text.normalize(F.col("keyword")))).alias("normal")).filter("normal <> ''")
    for end in (F.left, F.right):
        kws = kws.join(F.broadcast(counts.select(F.col("gram").alias("_held"))), end(F.col("normal"), F.lit(GRAM)) == F.col("_held"), "left_semi")
    kws = kws.groupBy("normal").agg(F.collect_set("keyword").alias("keywords"))
    runs = kws.select("normal", "keywords", F.explode(F.when(F.length("normal") >= GRAM, grams(F.col("normal"))).otherwise(F.array("normal"))).alias("gram"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")
    chosen = runs.join(F.broadcast(counts), "gram", "left").groupBy("normal").agg(rarest, F.first("keywords").alias("keywords"))
    return chosen.filter("r.n > 0").select(F.col("r.gram").alias("gram"), "normal", "keywords")


def _hits() -> Column:
    """Where an entry (``_key``, ``_senses``) holds ``kw``: ``field, sense``."""
    holds = lambda c: F.contains(c, F.col("kw.normal"))
    hits = lambda s, i: F.concat(
        F.when(F.exists(s["synonyms"], holds), F.array(F.struct(F.lit("synonym").alias("field"), i.alias("sense")))).otherwise(F.array()),
        F.when(holds(s["gloss"]), F.array(F.struct(F.lit("gloss").alias("field"), i.alias("sense")))).otherwise(F.array()),
    )
    return F.when(holds(F.col("_key")), F.array(F.struct(F.lit("key").alias("field"), F.lit(0).alias("sense")))).otherwise(F.flatten(F.transform("_senses", hits)))


def matches(entries: DataFrame, words: list[str] | DataFrame) -> DataFrame:
    """Entries that hold a keyword: ``keyword, file, key, senses, field, sense`` (the matched sense's number).

    ``entries`` is ``file, key, senses`` with ``senses`` an array of structs with ``gloss`` and ``synonyms``. A keyword in the
    key gives one row and no others of that entry; else each sense gives a row for a synonym and one for its gloss. Keywords are
    a list or a column ``keyword``, as many as there may be, each once whatever its repeats; null ones and those without letters or digits
    match nothing. A few of them go into the plan as literals; more are read once, and those that may be in an entry (see ``_listed``) are
    written. They meet entries on their rarest run of characters, as plain keywords with all that these stand for: an entry is judged once
    for all that are spelt alike. They are broadcast, in as many parts as their number needs. Entries are judged in their rows, in as many
    tasks as they are for; a text meets a keyword as often as it holds its run, and the first place of the keyword itself counts.
    """
    if isinstance(words, DataFrame):
        rows = [r[0] for r in words.select("keyword").filter("keyword IS NOT NULL").limit(LITERAL_ROWS + 1).collect()]
    else:
        rows = [w for w in words if w is not None]
    listed = list(dict.fromkeys(rows))
    judged = _judged(entries.select("file", "key", "senses"))
    if len(listed) <= LITERAL_KEYWORDS and (len(rows) <= LITERAL_ROWS or not isinstance(words, DataFrame)):
        found = ["file", "key", "senses", "hit.field", "hit.sense"]
        return _literal(judged, sorted(listed)).withColumn("hit", F.explode(_hits())).select(F.col("kw.keyword").alias("keyword"), *found)
    asked = words if isinstance(words, DataFrame) else entries.sparkSession.createDataFrame([(w,) for w in listed], "keyword string")
    possible = written(_listed(judged, asked), "keywords").withColumn("_off", F.expr("instr(normal, gram) - 1")).withColumn("_rest", F.expr(f"substring(normal, _off + 1, {AHEAD})"))
    parts = (possible.agg(F.sum(F.size("keywords"))).first()[0] or 0) // BROADCAST_KEYWORDS + 1
    runs = _runs(_texts(judged))
    met = None
    for part in range(parts):
        some = possible.filter(F.pmod(F.xxhash64("normal"), F.lit(parts)) == part) if parts > 1 else possible
        held = runs.join(F.broadcast(some), "gram").filter(f"at > _off AND startswith(substring(_piece, _k, {AHEAD}), _rest) AND instr(text, normal) = at - _off AND (field = 'key' OR NOT contains(_key, normal))")
        named = held.select(F.explode("keywords").alias("keyword"), "file", "key", "senses", "field", "sense")
        met = named if met is None else met.unionByName(named)
    return met


def told_by(words: DataFrame, found: DataFrame) -> DataFrame:
    """``words`` with what was ``found`` for their keyword. Some keywords are in most entries, so up to ``BROADCAST_WORDS`` rows of words are
    broadcast, and entries stay in their tasks; more of them are joined by a shuffle."""
    few = len(words.select("keyword").limit(BROADCAST_WORDS + 1).collect()) <= BROADCAST_WORDS
    return found.join(F.broadcast(words) if few else words, "keyword")


def last_matches(found: DataFrame) -> DataFrame:
    """Of the matches of one entry the last (by field, then sense), so each file and key is there once."""
    last = F.row_number().over(Window.partitionBy("file", "key").orderBy(F.desc("sense"), F.desc("field"), "keyword"))
    return found.withColumn("_n", last).filter("_n = 1").drop("_n")


def entry_tokens(senses: Column) -> Column:
    """The tokens of all senses' glosses and synonyms, in order, with repeats."""
    each = lambda s: F.concat(text.tokenize(s["gloss"]), F.flatten(F.transform(F.coalesce(s["synonyms"], F.array().cast("array<string>")), text.tokenize)))
    return F.flatten(F.transform(senses, each))


def choose_sense(senses: Column) -> Column:
    """The first sense of an entry; null without any."""
    return F.get(senses, F.lit(0))


def taxonomy(found: DataFrame, more: bool = False) -> DataFrame:
    """Matches as taxa: ``keyword, kingdom, phylum, family, order, variable, type, value``; with ``more``, their entry's ``key``, first ``gloss`` and ``synonyms``, too."""
    first = choose_sense(F.col("senses"))
    gloss = F.get("senses", F.col("sense"))["gloss"]
    told = F.when(F.col("field") == "key", first["gloss"]).otherwise(gloss)
    value = F.when(F.col("field") == "synonym", F.array_join(F.get("senses", F.col("sense"))["synonyms"], ", ")).when(F.col("field") == "gloss", gloss).otherwise(first["gloss"])
    also = ["key", text.blank(first["gloss"]).alias("gloss"), F.coalesce(first["synonyms"], F.array().cast("array<string>")).alias("synonyms")] if more else []
    return found.select("keyword", kingdom(F.col("file")).alias("kingdom"), F.regexp_replace("file", r"\.json$", "").alias("phylum"), family(told).alias("family"), order_of(told).alias("order"), text.normalize(F.col("key")).alias("variable"), F.when(F.col("field") == "key", "entry").otherwise(F.col("field")).alias("type"), text.blank(value).alias("value"), *also)


def score() -> Column:
    """A taxon's score, of its columns."""
    return (
        F.when(F.col("family") != "general", 3).otherwise(0) + F.when(F.col("type") == "gloss", 2).when(F.col("type") == "synonym", 1).otherwise(0)
        + F.least(F.lit(3), F.floor(F.length("value") / 50)) + F.when(F.length("variable") > 3, 1).otherwise(0)
    ).cast("long")


def depth() -> Column:
    return (F.when(F.col("family") != "general", 3).otherwise(0) + F.least(F.lit(10), F.floor(F.length("order") / 50)) + F.least(F.lit(10), F.floor(F.length("value") / 80))).cast("long")
