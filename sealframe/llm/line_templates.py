"""Line dedup by a log-template tree, with DataFrame operations only.

A line's template is found by a tree of fixed depth:

1. the number of tokens. Tokens are cut at their first digit, which generalises numbers, dates and codes. A line of more
   than ``POSITIONS`` tokens is laid on so many positions, stretches of equal length; else every token is a position;
2. the leading quarter of the positions (one at least). Count and lead are the leaf;
3. within the leaf, positions are generalised where values vary: a value that less than half as many of the leaf's
   lines have as have what the line's other positions hold becomes a wildcard, of which a line has ``FIELDS`` at most,
   and at most one for three positions; lines of less than ``SHORT`` tokens have none.

A template recurs if it stands in ``MIN_DOCS`` documents or more; a line of ``LONG_TEXT`` tokens or more recurs also if two
documents have it word for word. Recurring lines are dropped from all documents but the first of them (the smallest id), line by line,
whatever share of a document they are.

Only leaves with several different lines are looked into, and there each different line once. Counts are partly aggregated
before they are shuffled. Keys with a good share of all rows are few (their number is bounded by that share) and are
broadcast; only the others are joined by shuffle, so that no task gets the rows of a very common line, leaf or word.

With ``keep_copies`` (for a pipeline that has an operator on near duplicates behind this one) equal texts count as one and lose the
same lines, so they stay equal, and a text is left whole if it is verified as a near copy: half its words recur, and five-word
shingles are shared with the text that most of its lines come from to ``SIMILARITY`` or more.

Cases: a null text stays null and has no lines; lines without tokens are never dropped; a null id is
never the first; repeated rows (equal id and text) come out alike, and count as documents of their own, but as one where
fields are generalised; texts of any length are parsed whole; an empty table gives an empty result; all columns
are kept, and columns made here are named by ``made``, which must not clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted

#: Documents in which a template recurs.
MIN_DOCS = 4
#: Positions of a line, at most.
POSITIONS = 12
#: Wildcards of a template, at most, and tokens of lines that have any, at least.
FIELDS, SHORT = 2, 5
#: Lines with so many tokens recur in two texts, if equal.
LONG_TEXT = 20
#: Share of all five-word shingles that a near copy has in common with the other text.
SIMILARITY = 0.8
MADE = ("n_lines", "n_dropped")

_TOKENS = r"transform(split(regexp_replace(text, '[0-9][^ \t\n\u000b\u000c\r]*', '<*>'), '\n'), x -> split(trim(BOTH ' ' FROM translate(x, '\t\u000b\u000c\r', '    ')), ' +'))"
#: Per line its number of tokens and a hash of every position's tokens.
_POSITIONS = f"""
    transform({_TOKENS}, t -> named_struct(
        'n', if(t[0] = '', 0, size(t)),
        'at', transform(sequence(1, least(size(t), {POSITIONS})), i -> hash(slice(t,
            (((i - 1) * size(t) + least(size(t), {POSITIONS}) - 1) div least(size(t), {POSITIONS})) + 1,
            ((i * size(t) + least(size(t), {POSITIONS}) - 1) div least(size(t), {POSITIONS}))
            - (((i - 1) * size(t) + least(size(t), {POSITIONS}) - 1) div least(size(t), {POSITIONS})))))))"""
#: Besides these the leaf, and the keys of the line: of its tokens and, if it is long, of its words; the lowest bit tells which.
_LINES = f"""
    zip_with({_POSITIONS}, split(text, '\n'), (x, l) -> named_struct('n', x.n, 'at', x.at,
        'leaf', xxhash64(x.n, slice(x.at, 1, greatest(1, size(x.at) div 4))),
        'keys', if(x.n = 0, cast(array() as array<bigint>),
            array(xxhash64(x.n, x.at) & -2L) || if(x.n >= {LONG_TEXT}, array(xxhash64('line', trim(l)) | 1L), cast(array() as array<bigint>)))))"""
_SHINGLES = r"array_distinct(flatten(transform(array(split(trim(regexp_replace({}, '\\s+', ' ')), ' ')), w -> transform(sequence(1, greatest(size(w) - 4, 1)), i -> xxhash64(slice(w, i, 5))))))"


def _generalised(lines: DataFrame, min_docs: int) -> DataFrame:
    """Of ``lines`` (n, at, leaf, key), those keys whose template has wildcards: key, template, and the key's number of lines."""
    long_enough = lines.where(F.col("n") >= SHORT)
    leaves = long_enough.groupBy("leaf").agg(F.count(F.lit(1)).alias("in_leaf"), F.min("key").alias("low"), F.max("key").alias("high"))
    several = cut(leaves.where((F.col("in_leaf") >= min_docs) & (F.col("low") < F.col("high"))).select("leaf", "in_leaf"))
    within = join_counted(long_enough, several, "leaf", "in_leaf")
    different = cut(within.groupBy("leaf", "key").agg(F.first("at").alias("at"), F.count(F.lit(1)).alias("lines")))
    lead = F.expr("greatest(1, size(at) div 4)")
    words = different.select("leaf", "key", "lines", lead.alias("lead"), F.posexplode("at").alias("p", "v")).where("p >= lead")
    words = words.select("key", "lines", "p", F.xxhash64("leaf", "p", "v").alias("word"))
    counted = cut(words.groupBy("word").agg(F.sum("lines").alias("c"), F.count(F.lit(1)).alias("keys")))
    told = join_counted(words.select("key", "p", "word"), counted, "word", "keys")
    counts = told.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", "c"))).alias("counts"))
    fields = F.expr(f"least({FIELDS}, size(at) div 3)")
    # The lead has all the leaf's lines, so it is among the most common positions.
    usual = F.expr("sort_array(counts.c, false)[size(at) - fields - lead - 1]")
    ranked = different.join(counts, "key").withColumn("lead", lead).withColumn("fields", fields).withColumn("usual", usual)
    masked = F.expr("transform(at, (v, i) -> if(i >= lead and 2 * counts[i - lead].c < usual, cast(null as int), v))")
    templates = ranked.withColumn("masked", masked).where(F.exists("masked", lambda v: v.isNull()))
    # Nulls leave a hash as it is, so their places are hashed as well.
    return templates.select("key", F.expr("xxhash64(leaf, masked, transform(masked, v -> v is null))").alias("template"), "lines")


def _dropped(units: DataFrame, min_docs: int, place: Column) -> DataFrame:
    """The lines to drop of ``units`` (doc_id, hash, lines): doc_id, hash, pos, n and ``first``, the smallest place of a unit with such a line."""
    lines = units.select("doc_id", "hash", place.alias("place"), F.posexplode("lines").alias("pos", "line")).where("line.n > 0")
    templates = cut(_generalised(lines.select("line.n", "line.at", "line.leaf", F.col("line.keys")[0].alias("key")), min_docs))
    counted = units.select(place.alias("place"), F.explode(F.array_distinct(F.flatten("lines.keys"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("place").alias("first"))
    equal = counted.where(F.col("docs") >= F.when(F.expr("key & 1") == 1, 2).otherwise(min_docs)).join(templates.select("key"), "key", "left_anti")
    rows = lines.select("doc_id", "hash", "place", "pos", "line.n", F.explode("line.keys").alias("key"))
    whole = join_counted(rows, cut(equal), "key", "docs").select("doc_id", "hash", "place", "pos", "n", "first")

    general = cut(join_counted(rows, templates, "key", "lines").select("doc_id", "hash", "place", "pos", "n", "template"))
    recurring = general.groupBy("template", "doc_id", "hash").agg(F.first("place").alias("place")).groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("place").alias("first"))
    varied = join_counted(general, cut(recurring.where(F.col("docs") >= min_docs)), "template", "docs").select(whole.columns)
    return whole.unionByName(varied).where(F.coalesce(F.col("place") != F.col("first"), F.lit(True))).drop("place")


def _parsed(docs: DataFrame) -> DataFrame:
    """Per row with a text: doc_id, the text, and its hash."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").withColumn("hash", F.xxhash64("text"))


def _each(docs: DataFrame, min_docs: int) -> DataFrame:
    """Per id and hash: ascending positions of the lines to drop."""
    units = cut(_parsed(docs).select("doc_id", "hash", F.expr(_LINES).alias("lines")))
    return _dropped(units, min_docs, F.col("doc_id")).groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("pos")).alias("positions"))


def _but_copies(docs: DataFrame, min_docs: int) -> DataFrame:
    """As ``_each``, for texts that are no near copies."""
    text = _parsed(docs)
    texts = text.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    units = cut(texts.select("doc_id", "hash", "copies", F.expr(_LINES).alias("lines")))
    # Null ids come last.
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "hash")
    lines = _dropped(units, min_docs, place).groupBy("hash", "pos", "n").agg(F.min("first").getField("hash").alias("first"))
    found = cut(lines.groupBy("hash").agg(F.array_sort(F.collect_set("pos")).alias("positions"), F.sum("n").alias("lost"), F.expr("mode(first)").alias("first")))
    told = found.join(units.select("hash", "copies", F.expr("aggregate(lines, 0L, (a, x) -> a + x.n)").alias("words")), "hash")
    maybe = told.where("2 * lost >= words").select("hash", "first")
    wanted = maybe.select(F.col("hash").alias("pair"), F.explode(F.array("hash", "first")).alias("hash")).join(units.select("hash", "doc_id"), "hash")
    # A text is read from the row that stands for it, so that no task gets all copies of one.
    both = wanted.join(text, (wanted.doc_id.eqNullSafe(text.doc_id)) & (wanted.hash == text.hash)).select("pair", wanted.hash, F.expr(_SHINGLES.format("text")).alias("shingles"))
    sides = both.groupBy("pair").agg(F.min_by("shingles", "hash").alias("a"), F.max_by("shingles", "hash").alias("b"))
    near = sides.where(F.size(F.array_intersect("a", "b")) >= SIMILARITY * F.size(F.array_union("a", "b"))).select(F.col("pair").alias("hash"))
    lose = told.join(near, "hash", "left_anti").select("hash", "copies", "positions")
    return join_counted(text.select("doc_id", "hash").distinct(), cut(lose), "hash", "copies").drop("copies")


def _without(lines: Column, positions: Column) -> Column:
    """``lines`` without those at the ascending ``positions``: the stretches between them, end to end."""
    ends = F.concat(positions, F.array(F.size(lines)))
    return F.flatten(F.transform(ends, lambda p, i: F.slice(lines, F.when(i == 0, 1).otherwise(F.get(ends, i - 1) + 2), p - F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1))))


def drop_recurring(docs: DataFrame, min_docs: int = MIN_DOCS, made: tuple[str, str] = MADE, keep_copies: bool = False) -> DataFrame:
    """All rows and columns of ``docs``, ``text`` without recurring lines, and the columns ``made``: lines, and lines dropped."""
    if clash := {c.lower() for c in made} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns of these names are made here: {sorted(clash)}")
    given = docs.columns
    dropped = (_but_copies if keep_copies else _each)(docs, min_docs)
    found = dropped.select(F.col("doc_id").alias("id"), F.col("hash").alias("text_hash"), "positions")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in given)).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("own_hash"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("text_hash")), "left")
    lines = F.split(F.col("row.text").cast("string"), "\n")
    drop = F.col("positions").isNotNull()
    text = F.when(drop, F.array_join(_without(lines, F.col("positions")), "\n")).otherwise(F.col("row.text"))
    columns = [text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in given]
    values = (F.coalesce(F.size(lines), F.lit(0)), F.when(drop, F.size("positions")).otherwise(0))
    return joined.select(*columns, *(v.alias(n) for v, n in zip(values, made, strict=True)))


def oracle_sql(min_docs: int = MIN_DOCS, docs: str = "documents") -> str:
    """DuckDB SQL of ``drop_recurring``: doc_id, text and ``MADE``, for tables without null texts or repeated ids."""
    return f"""
WITH tokens AS (
    SELECT doc_id, pos, line,
        string_split_regex(trim(regexp_replace(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), '[0-9][^ ]*', '<*>', 'g'), ' '), ' +') AS t
    FROM (SELECT doc_id, unnest(string_split("text", chr(10))) AS line, generate_subscripts(string_split("text", chr(10)), 1) AS pos FROM {docs})
),
counted AS (SELECT doc_id, pos, line, t, CASE WHEN t[1] = '' THEN 0 ELSE len(t) END AS n, least(len(t), {POSITIONS}) AS p FROM tokens),
laid AS (
    SELECT doc_id, pos, n, p, greatest(1, p // 4) AS lead, least({FIELDS}, p // 3) AS fields,
        list_transform(range(p), lambda j: t[(j * n + p - 1) // p + 1 : ((j + 1) * n + p - 1) // p]) AS parts
    FROM counted WHERE n > 0
),
words AS (
    SELECT doc_id, pos, i, count(*) OVER (PARTITION BY n, parts[1:lead], i, parts[i]) AS c
    FROM (SELECT *, unnest(range(lead + 1, p + 1)) AS i FROM laid WHERE n >= {SHORT})
),
counts AS (SELECT doc_id, pos, list(c ORDER BY i) AS c FROM words GROUP BY ALL),
usual AS (SELECT doc_id, pos, c, list_reverse_sort(c)[p - fields - lead] AS q FROM counts JOIN laid USING (doc_id, pos)),
templates AS (
    SELECT doc_id, pos, {min_docs} AS needed,
        [[n::VARCHAR]] || CASE WHEN q IS NULL THEN parts ELSE list_transform(parts, lambda v, i: CASE WHEN i > lead AND 2 * c[i - lead] < q THEN NULL ELSE v END) END AS key
    FROM laid LEFT JOIN usual USING (doc_id, pos)
    UNION ALL SELECT doc_id, pos, 2, [[trim(line, ' ')]] FROM counted WHERE n >= {LONG_TEXT}
),
recurring AS (SELECT needed, key, min(doc_id) AS first FROM templates GROUP BY needed, key HAVING count(DISTINCT doc_id) >= needed),
dropped AS (SELECT DISTINCT doc_id, pos FROM templates JOIN recurring USING (needed, key) WHERE doc_id <> first)
SELECT doc_id,
    coalesce(string_agg(line, chr(10) ORDER BY c.pos) FILTER (WHERE d.pos IS NULL), '') AS "text",
    CAST(count(*) AS INTEGER) AS n_lines,
    CAST(count(d.pos) AS INTEGER) AS n_dropped
FROM counted c LEFT JOIN dropped d USING (doc_id, pos)
GROUP BY doc_id
"""
