"""Operator 4 [native]: line dedup by a deletion-neighbourhood join.

A line is its words (cut at blanks). Two lines are duplicates if their words are equal, or if
both have at least ``NEAR_WORDS`` words and one edit (a word replaced, added or missing)
turns one into the other. Every line that has an earlier duplicate (by doc_id, then line
number) is removed, judged on the input, however short it is; blank lines stay.

1. Equal lines become one class with its earliest place (one aggregate, map-side combined).
2. One edit leaves the first or the last half of the words untouched: only classes that share
   a half with another class go on.
3. These emit their whole deletion neighbourhood as hashed keys: each variant with one word
   deleted, keyed with the place of the deletion, and the whole line keyed with each gap. Two
   lines meet under a key exactly if a word replaced (deletion and deletion) or added
   (deletion and gap) there makes them equal. Prefix and suffix hashes make a variant's key
   from two running sums, so a line of n words costs O(n).
4. All lines under one key are duplicates of each other, so a key needs only its earliest
   line, a minimum that is combined map-side, and no pairs: a crowded key costs its rows.
5. The earliest partner of each class is verified word by word.

Only DataFrame functions are used. Defined cases: null text stays null, with 0 lines; blank
lines stay; a document may lose all its text and stays; rows with one doc_id and one text count as one document; a null doc_id counts as
later than all others; all columns of the input stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.common import checked_broadcast, staged, without_clash

NEAR_WORDS = 8
BLANKS = "[ \\\\t\\\\x0B\\\\f\\\\r]+"
#: Blanks that a line may have beside single spaces between words.
ODD_BLANKS = ("  ", "\\t", "\\x0B", "\\f", "\\r")
MASK = (1 << 35) - 1
CLASS = ["h1", "h2"]
#: A side of at most so many narrow rows (some 10 MB) is broadcast.
BROADCAST_ROWS = 200_000
PLACE = "named_struct('none', __id is null, 'id', __id, 'row', __row, 'line_no', line_no)"


def _identified(docs: DataFrame) -> DataFrame:
    """``docs`` with __id, __text and __row, the identity of a document."""
    return docs.select("*", F.expr("cast(doc_id as long)").alias("__id"), F.expr("cast(text as string)").alias("__text")).withColumn(
        "__row", F.xxhash64("__text"))


def _plain_blanks(text: str) -> str:
    """The text with every run of blanks as one space; most texts have no other."""
    odd = " or ".join(f"contains({text}, chr({ord(b.encode().decode('unicode_escape'))}))" if len(b) > 1 and b != "  " else f"contains({text}, '{b}')"
                      for b in ODD_BLANKS)
    return f"if({odd}, regexp_replace({text}, '{BLANKS}', ' '), {text})"


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line that is not blank: place, class hash, keys of its halves."""
    rows = (_identified(docs).where("__text is not null")
            .select("__id", "__row", F.posexplode(F.split(F.expr(_plain_blanks("__text")), "\n")).alias("line_no", "line"))
            .select("__id", "__row", "line_no", F.expr("trim(line)").alias("line"))
            .where("line <> ''").withColumn("n", F.expr("cast(octet_length(line) - octet_length(replace(line, ' ', '')) + 1 as int)")))
    halves = []
    for j, h in enumerate(("n div 2", "(n - 1) div 2")):
        for side, sign in (("first", ""), ("last", "-")):
            key = f"xxhash64('{side}', {h}, substring_index(line, ' ', cast({sign}({h}) as int)))"
            unless = "" if j == 0 else " and n % 2 = 0"
            halves.append(f"if(n >= {NEAR_WORDS}{unless}, {key}, null) k{len(halves)}")
    return rows.selectExpr("__id", "__row", "line_no", "xxhash64(line) h1", "xxhash64(n, line) h2", *halves)


def near_classes(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """h1, h2 of the classes that have an earlier class within one edit."""
    keys = lines.select(*CLASS, F.explode(F.array(*[f"k{i}" for i in range(4)])).alias("k")).where("k is not null")
    shared = staged(keys.groupBy("k").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("k"), "lines-halves")
    places = lines.selectExpr(*CLASS, f"{PLACE} place", "explode(array(k0, k1, k2, k3)) k")
    candidates = (places.join(checked_broadcast(shared, BROADCAST_ROWS), "k", "left_semi")
                  .groupBy(*CLASS).agg(F.min("place").alias("place")))
    candidates = staged(candidates, "lines-candidates")
    wanted = candidates.select(*CLASS, F.col("place.id").alias("__i"), F.col("place.row").alias("__r"), F.col("place.line_no").alias("__l"))
    source = _identified(docs).where("__text is not null").select("__id", "__row", "__text")
    here = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__r"))
    if candidates.count() <= BROADCAST_ROWS:
        here = here & (F.col("line_no") == F.col("__l"))
        texts = (source.select("__id", "__row", F.posexplode(F.split(F.expr(_plain_blanks("__text")), "\n")).alias("line_no", "line"))
                 .join(F.broadcast(wanted), here).select(*CLASS, "line"))
    else:
        per_doc = wanted.groupBy("__i", "__r").agg(F.collect_list(F.struct(*CLASS, "__l")).alias("found"))  # lines of one document
        texts = (source.join(per_doc, here).select(F.split(F.expr(_plain_blanks("__text")), "\n").alias("lines"), F.explode("found").alias("c"))
                 .select("c.h1", "c.h2", F.expr("lines[c.__l]").alias("line")))
    texts = texts.selectExpr(*CLASS, "split(trim(line), ' ') w").dropDuplicates(CLASS)  # repeated rows give a line twice
    # Sorted by place, so the running id has the order of the places.
    texts = staged(candidates.join(texts, CLASS).orderBy("place").select(
        *CLASS, F.monotonically_increasing_id().alias("ord"), "w", F.size("w").alias("n")), "lines-near")

    over = Window.partitionBy("ord").orderBy("pos")
    words = (texts.select("ord", "n", F.posexplode(F.expr("transform(w, x -> xxhash64(x))")).alias("pos", "word"))
             .repartition("ord")
             .withColumn("p", F.xxhash64("word", "pos").bitwiseAND(F.lit(MASK)))
             .withColumn("s", F.xxhash64("word", F.col("n") - F.col("pos"), F.lit(1)).bitwiseAND(F.lit(MASK)))
             .withColumn("before", F.coalesce(F.sum("p").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("after", F.coalesce(F.sum("s").over(over.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))))
    variants = staged(words.select("ord", F.explode(F.expr("""concat(
        array(xxhash64(n - 1, pos, before, after), xxhash64(n, pos, before, after + s)),
        if(pos = n - 1, array(xxhash64(n, n, before + p, 0L)), array()))""")).alias("k")), "lines-variants")
    earliest = staged(variants.groupBy("k").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
                      .where("first < last").select("k", "first"), "lines-keys")
    partner = (variants.join(checked_broadcast(earliest, BROADCAST_ROWS), "k").where("first < ord")
               .groupBy("ord").agg(F.min("first").alias("first")))
    a = texts.select(*CLASS, "ord", F.col("w").alias("a"))
    b = texts.select(F.col("ord").alias("first"), F.col("w").alias("b"))
    same = "coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> coalesce(x = y, false)), false), 0) - 1, size({a}))"
    return a.join(partner, "ord").join(b, "first").where(f"""abs(size(a) - size(b)) <= 1 and {same.format(a='a', b='b')}
        + {same.format(a='reverse(a)', b='reverse(b)')} >= greatest(size(a), size(b)) - 1""").select(*CLASS)


def removed_lines(docs: DataFrame) -> DataFrame:
    """__id, __row, removed (line numbers) of the documents that lose lines."""
    lines = staged(line_table(docs), "lines")
    near = near_classes(docs, lines).withColumn("near", F.lit(True))
    equal = (lines.groupBy(*CLASS).agg(F.min(F.expr(PLACE)).alias("place"), F.count("*").alias("n_lines"))
             .where("n_lines > 1").select(*CLASS, "place"))
    repeated = staged(equal.join(near, CLASS, "full"), "lines-repeated")
    gone = (lines.select("__id", "__row", "line_no", *CLASS).join(checked_broadcast(repeated, BROADCAST_ROWS), CLASS)
            .where(F.coalesce("near", F.lit(False)) | (F.expr(PLACE) > F.col("place"))))
    return gone.groupBy("__id", "__row").agg(F.collect_set("line_no").alias("__removed"))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of text; plus __n_lines and __n_removed."""
    return without_clash(docs, _without_repeated)


def _without_repeated(docs: DataFrame) -> DataFrame:
    marks = removed_lines(docs).select(F.col("__id").alias("__i"), F.col("__row").alias("__r"), "__removed")
    joined = _identified(docs).join(marks, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__row") == F.col("__r")), "left")
    lines = "split(__text, '\\n')"
    kept = f"""array_join(transform(array_except(sequence(0, size({lines}) - 1), __removed), i -> {lines}[i]), '\\n')"""
    text = F.expr(f"case when __removed is null then __text else {kept} end")
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
                         F.expr(f"if(__text is null, 0L, cast(size({lines}) as long))").alias("__n_lines"),
                         F.coalesce(F.size("__removed"), F.lit(0)).cast("long").alias("__n_removed"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (null text: null)."""
    return drop_repeated_lines(docs.select("doc_id", "text")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
w AS (
  SELECT doc_id, i, line, list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '') AS w FROM l),
c AS (
  SELECT w, len(w) AS n, min((doc_id, i)) AS place FROM w WHERE len(w) >= 1 GROUP BY w),
v AS (
  SELECT w, place, p, n - 1 AS m, array_to_string(w[1:p - 1] || w[p + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM c WHERE n >= {NEAR_WORDS})
  UNION ALL
  SELECT w, place, p, n, array_to_string(w, ' ') FROM (SELECT *, unnest(range(1, n + 2)) AS p FROM c WHERE n >= {NEAR_WORDS})),
near AS (
  SELECT DISTINCT w FROM (SELECT w, place, min(place) OVER (PARTITION BY md5(rest), p, m) AS first FROM v) WHERE first < place),
gone AS (
  SELECT w.doc_id, w.i FROM w JOIN c ON w.w = c.w LEFT JOIN near ON near.w = w.w WHERE near.w IS NOT NULL OR (w.doc_id, w.i) > c.place)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(g.n, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS kept_sha256
FROM documents d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g ON g.doc_id = d.doc_id
LEFT JOIN (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i
           WHERE gone.i IS NULL GROUP BY l.doc_id) k ON k.doc_id = d.doc_id
"""
