"""Operator 6: line dedup by a log-template tree; lines of templates that recur across documents are dropped.

A line is parsed to a fixed depth: its number of tokens, then its leading ``DEPTH`` tokens, where a token with a
digit counts as a variable field (but not in a line of such tokens only, which is taken as it is).  Inside a leaf of
that tree a place is agreed if ``SUPPORT`` documents have the line's token there, a field too; the agreed places are
the line's template.  A template recurs if the documents of its lines add up to ``SUPPORT``, at least ``CONSTANT`` of its
places are agreed and one of them has a word (a line counts once in a document).  So a line that recurs word for word
is a template whatever its digits, unless it is empty.

A field whose values are skewed has a frequent value that looks like a constant.  So a line also goes if it equals a
line of ``SUPPORT`` documents at all places but one, in any leaf, and the rest meets the same conditions.  Such a place
is found by hashes of a line without one of its places, so this is linear in the lines whatever the leaf; the
candidates are lines with the same number of tokens and the same leading tokens but for one place.  Decisions don't
depend on the order of the lines.

Lines are hashed first and written as narrow rows; leaves, lines and openings are counted from these, and only lines
that can recur go on with their words.  Counting is by partial sums, so a line that all documents share is one row
per task; lines are joined with what is known of them by shuffles, whose hot keys can be split.  Whole copies of a
document recur line by line, so exact dedup comes before this operator.

Defined cases: a null text is empty; lines without tokens are never dropped; rows of one id with different texts
are separate documents, repeated rows are alike; a document all of whose lines recur becomes the empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.llm.common import documents, text_hash, unused
from sightings.session import staged

DEPTH, SUPPORT, CONSTANT = 3, 5, 0.6
WORDS = 1 << 18  # of 64 bits, in the filter that lines pass before they are joined: at most as many rows are broadcast
FIELD = "<*>"
_SPACE = r"[\x20\x09\x0B-\x0D]+"
_VARIABLE = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
# The same for an engine that tries one start after the other: from a token's first character, without going back.
_VARIABLE_ONCE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


# A line of fields only.
_FIELDS = r"<\*>(?: <\*>)*"


def masked(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns and ``lines``: the text's lines with variable fields for tokens with a digit, one space between tokens
    and none around a line; lines of such tokens only keep them.  Each step rewrites only the texts that need it."""

    def has(*marks: str) -> Column:
        found = [F.contains(F.col("plain"), F.lit(mark)) for mark in marks]
        return reduce(lambda a, b: a | b, found)

    around = F.startswith(F.col("plain"), F.lit(" ")) | F.endswith(F.col("plain"), F.lit(" ")) | has(" \n", "\n ")
    steps = [
        (has("  ", "\t", "\x0b", "\x0c", "\r"), _SPACE, " "),
        (around, r"(?dm)^ | $", ""),
    ]
    rows = docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("plain"))
    for needed, pattern, value in steps:
        rows = rows.withColumn("plain", F.when(needed, F.regexp_replace("plain", pattern, value)).otherwise(F.col("plain")))
    digits = F.col("plain").rlike("[0-9]")
    rows = rows.withColumn("masked", F.when(digits, F.regexp_replace("plain", _VARIABLE_ONCE, FIELD)).otherwise(F.col("plain")))
    own, plain = F.split("masked", "\n"), F.split("plain", "\n")
    kept = F.zip_with(own, plain, lambda line, was: F.when(line.rlike(f"(?d)^{_FIELDS}$"), was).otherwise(line))
    only_fields = digits & F.col("masked").rlike(f"(?dm)^{_FIELDS}$")
    return rows.withColumn("lines", F.when(only_fields, kept).otherwise(own)).drop("plain", "masked")


def _leaf(tokens: Column) -> Column:
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, DEPTH))


def _openings(tokens: Column) -> Column:
    """Hashes of the line's number of tokens and its leading tokens but one, for each of these."""
    lead = [F.get(tokens, F.lit(i)) for i in range(DEPTH)]
    return F.array(*[F.xxhash64(F.size(tokens), F.lit(i), *lead[:i], *lead[i + 1 :]) for i in range(DEPTH)])


def _enough(tokens: Column, constant: float) -> Column:
    """True where a line without one of its places still has enough of them."""
    return F.size(tokens) - 1 >= constant * F.size(tokens)


def hashed_lines(docs: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """(doc_id, hash, place, first, said, leaf, openings) of every line with tokens, written once.

    ``first`` is true at one place of a text's equal lines; openings are null where a line can't miss a place.  All that
    is counted over lines is counted from these narrow rows, so texts are masked twice in all: here, and for the
    words of the lines that can recur.
    """
    rows = masked(docs, "doc_id", text_hash(F.col("text")).alias("hash"))
    ordered = F.sort_array(F.transform("lines", lambda line, i: F.struct(line.alias("line"), i.alias("place"))))
    rows = rows.select("doc_id", "hash", ordered.alias("ordered"))

    def noted(one: Column, i: Column) -> Column:
        before = F.get(F.col("ordered"), i - 1)["line"]
        return F.struct(one["line"].alias("line"), one["place"].alias("place"), (~before.eqNullSafe(one["line"])).alias("first"))

    # a text has one line at least; the plain explode would add a filter on the lines, which masks every text twice
    rows = rows.select("doc_id", "hash", F.explode_outer(F.transform("ordered", noted)).alias("one")).select("doc_id", "hash", "one.*")
    rows = rows.where("line <> ''").withColumn("tokens", F.split("line", " "))
    openings = F.when(_enough(F.col("tokens"), constant), _openings(F.col("tokens")))
    said, leaf = F.xxhash64("line").alias("said"), F.xxhash64(_leaf(F.col("tokens"))).alias("leaf")
    return staged(rows.select("doc_id", "hash", "place", "first", said, leaf, openings.alias("openings")), "hashed-lines")


def _holes(lines: DataFrame, constant: float) -> DataFrame:
    """(said, hole): every line without each of its places, where what remains has a word and enough places.

    A hole is the exclusive or of the hashes of the other places, so each costs one step whatever the line's length.
    """
    split = lines.select(F.xxhash64("line").alias("said"), F.split("line", " ").alias("tokens"))
    size = F.size("tokens")
    split = split.where(_enough(F.col("tokens"), constant))
    words = size - F.size(F.filter("tokens", lambda t: t == FIELD))
    marks = F.transform("tokens", lambda t, i: F.struct(F.xxhash64(i, t).alias("hash"), (t != FIELD).cast("int").alias("word")))
    each = split.select("said", size.alias("size"), words.alias("words"), marks.alias("marks"))
    whole = F.aggregate("marks", F.lit(0).cast("bigint"), lambda x, mark: x.bitwiseXOR(mark["hash"]))
    each = each.select("said", "size", "words", whole.alias("whole"), F.posexplode_outer("marks").alias("place", "mark"))
    rest = F.col("whole").bitwiseXOR(F.col("mark.hash"))
    return each.where(F.col("words") > F.col("mark.word")).select("said", F.xxhash64("size", "place", rest).alias("hole"))


def _candidates(hashes: DataFrame, support: int) -> DataFrame:
    """(said, n, alike): lines of leaves that can recur with the number of their documents, and lines with the number of
    tokens and the leading tokens but for one place of a line of ``support`` documents, which are ``alike``."""
    once = hashes.where("first").select("said", "leaf", "openings")
    leaves = staged(once.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("leaf"), "leaves")
    likely = once.join(leaves, "leaf", "left_semi")
    counted = staged(likely.groupBy("said").agg(F.count(F.lit(1)).alias("n"), F.first("openings").alias("openings")), "leaf-lines")
    often = counted.where(F.col("n") >= support).select(F.explode("openings").alias("opening")).distinct()
    opened = once.where("openings is not null").select("said", F.explode("openings").alias("opening"))
    alike = opened.join(staged(often, "openings"), "opening", "left_semi").select("said")
    both = counted.select("said", "n", F.lit(False).alias("alike")).unionByName(
        alike.select("said", F.lit(None).cast("bigint").alias("n"), F.lit(True).alias("alike")))
    return staged(both.groupBy("said").agg(F.max("n").alias("n"), F.max("alike").alias("alike")), "candidates")


def _possible(lines: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """The lines whose bit is set in a filter of the wanted hashes, so that few others are shuffled by the exact join
    that has to follow.  The filter has at most ``words`` rows, however many hashes there are."""
    word, bit = F.pmod("said", F.lit(words)), F.expr("shiftleft(1L, cast(shiftright(said, 58) & 63 AS int))")
    bits = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return lines.join(F.broadcast(bits), (word == F.col("word")) & (bit.bitwiseAND(F.col("bits")) != 0), "left_semi")


def recurring(docs: DataFrame, hashes: DataFrame, support: int = SUPPORT, constant: float = CONSTANT) -> DataFrame:
    """(said), the hash of every masked line whose template recurs, or that is one place off a line that does."""
    wanted = _candidates(hashes, support)
    lines = masked(docs).select(F.explode_outer(F.array_distinct("lines")).alias("line")).where("line <> ''")
    lines = _possible(lines.withColumn("said", F.xxhash64("line")), wanted).join(wanted, "said", "left_semi").distinct()
    lines = staged(lines.join(wanted, "said").select("line", "n", "alike"), "lines")
    known = lines.where("n is not null").select("line", "n")
    # from here on a line, and a token at its place in its leaf, are 64-bit hashes: rows are narrow whatever the texts
    known = known.withColumn("tokens", F.split("line", " ")).withColumn("path", F.xxhash64(_leaf(F.col("tokens"))))
    each = known.select(F.xxhash64("line").alias("said"), "n", F.size("tokens").alias("size"), "path", F.posexplode("tokens").alias("place", "token"))
    each = each.select("said", "n", "size", F.xxhash64("path", "place", "token").alias("slot"), (F.col("token") != FIELD).alias("word"))
    held = each.groupBy("slot").agg(F.sum("n").alias("held")).where(F.col("held") >= support).select("slot")
    # a line's agreed places; a slot has its leaf and place in it, so equal sets are equal templates
    kept = each.join(held, "slot", "left_semi")
    template = F.xxhash64(F.sort_array(F.collect_list("slot"))).alias("template")
    shaped = kept.groupBy("said", "n", "size").agg(template, F.count(F.lit(1)).alias("agreed"), F.max("word").alias("word"))
    shaped = staged(shaped.where(F.col("word") & (F.col("agreed") >= constant * F.col("size"))).select("said", "n", "template"), "templates")
    often = shaped.groupBy("template").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("template")
    recurs = shaped.join(often, "template", "left_semi").select("said")
    frequent = known.where((F.col("n") >= support) & F.exists("tokens", lambda t: t != FIELD)).select("line")
    holes = staged(_holes(frequent, constant).select("hole").distinct(), "holes")
    one_off = _holes(lines.where("alike").select("line"), constant).join(holes, "hole", "left_semi").select("said")
    return recurs.unionByName(one_off).distinct()


def drop_recurring(docs: DataFrame, support: int = SUPPORT, constant: float = CONSTANT) -> DataFrame:
    """docs' columns with the text without its recurring lines, and n_lines and n_dropped (which see)."""
    hashed, ids, dropped, key, lines, gone = unused(docs.columns, "text_hash", "key_id", "dropped", "key_hash", "n_lines", "n_dropped")
    hashes = hashed_lines(docs, constant)
    said = staged(recurring(docs, hashes, support, constant), "recurring-lines")
    places = hashes.select("doc_id", "hash", "place", "said").join(said, "said", "left_semi")
    drops = places.groupBy("doc_id", "hash").agg(F.collect_set("place").alias("places"))
    drops = drops.select(F.col("doc_id").alias(ids), F.col("hash").alias(key), F.col("places").alias(dropped))
    marked = docs.withColumn(hashed, text_hash(F.col("text")))
    marked = marked.join(drops, marked["doc_id"].eqNullSafe(drops[ids]) & (marked[hashed] == drops[key]), "left")
    own = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    stays = F.filter(own, lambda _, i: ~F.array_contains(F.col(dropped), i))
    text = F.when(F.col(dropped).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(F.array_join(stays, "\n"))
    counts = F.size(own).cast("bigint").alias(lines), F.coalesce(F.size(dropped), F.lit(0)).cast("bigint").alias(gone)
    return marked.select(*[text.alias(c) if c.lower() == "text" else F.col(c) for c in docs.columns], *counts)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return drop_recurring(docs)


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
own AS (SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
spaced AS (SELECT r, place, line AS raw, trim(regexp_replace(line, '{_SPACE}', ' ', 'g'), ' ') AS line FROM own),
hidden AS (SELECT *, regexp_replace(line, '{_VARIABLE}', '{FIELD}', 'g') AS fields FROM spaced),
m AS (SELECT r, place, raw, CASE WHEN regexp_full_match(fields, '{_FIELDS}') THEN line ELSE fields END AS line FROM hidden),
k AS (SELECT line, count(DISTINCT r) AS n, string_split(line, ' ') AS tokens FROM m WHERE line <> '' GROUP BY line),
p AS (SELECT *, concat_ws(' ', len(tokens), array_to_string(tokens[1:{DEPTH}], ' ')) AS path FROM k),
leaf AS (SELECT path FROM p GROUP BY path HAVING sum(n) >= {SUPPORT}),
e AS (SELECT line, n, path, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM p WHERE path IN (FROM leaf)),
held AS (SELECT path, place, token FROM e GROUP BY ALL HAVING sum(n) >= {SUPPORT}),
c AS (SELECT line, path, any_value(n) AS n, list((place, token) ORDER BY place) AS agreed,
  bool_or(token <> '{FIELD}') AS word FROM e JOIN held USING (path, place, token) GROUP BY line, path),
s AS (SELECT c.* FROM c JOIN p USING (line) WHERE word AND len(agreed) >= {CONSTANT} * len(tokens)),
often AS (SELECT path, agreed FROM s GROUP BY path, agreed HAVING sum(n) >= {SUPPORT}),
each AS (SELECT line, n, tokens, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM k),
hole AS (SELECT line, n, place, tokens[:place - 1] AS before, tokens[place + 1:] AS behind FROM each
  WHERE len(tokens) - 1 >= {CONSTANT} * len(tokens) AND len(list_filter(tokens, lambda t: t <> '{FIELD}')) > (token <> '{FIELD}')::INT),
frequent AS (SELECT DISTINCT place, before, behind FROM hole WHERE n >= {SUPPORT}),
said AS (SELECT line FROM s JOIN often USING (path, agreed) UNION SELECT line FROM hole JOIN frequent USING (place, before, behind)),
gone AS (SELECT r, count(*) AS n_dropped FROM m WHERE line IN (FROM said) GROUP BY r),
stay AS (SELECT r, string_agg(raw, chr(10) ORDER BY place) AS text FROM m WHERE line NOT IN (FROM said) GROUP BY r)
SELECT doc_id, coalesce(stay.text, '') AS text, len(string_split(d.text, chr(10))) AS n_lines,
  coalesce(n_dropped, 0) AS n_dropped
FROM d LEFT JOIN gone USING (r) LEFT JOIN stay USING (r)
"""
