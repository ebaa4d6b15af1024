"""Benchmark decontamination with a positional inverted index of the documents, in DataFrame functions only.

``build`` stores the postings of all documents: one row (term, doc, pos) for every word. A term's postings lie one behind the
other in a segment, by document and position (terms are in the order of their hash). A segment is what one task reads, so no posting is shuffled; sorted postings compress to a few
bytes. A document's header is a row without a term: its number, its id and how many words it has.

``phrases`` looks for all windows of ``window`` consecutive words of the items (an item with fewer is one window). The words of a
window are ranked by how often they occur in the documents. The list of its rarest word, moved by that word's offset,
gives the places where the window may lie; it is intersected with the moved list of the second rarest word. For the places
left, windows of one item that lie on one diagonal (document position minus item position) are put together, and the moved lists of
all words still open are intersected at once. A stretch of ``window`` or more consecutive item words found on a diagonal is
an exact match, and each of its windows occurs there. All joins are by (document, position), which no word makes hot.

Proximity matches are item windows whose different words all lie within the window's length and ``slack`` more words of a document, in any
order: from the list of the rarest word, lists are intersected by distance, in blocks of positions, in the same order.
Both searches read the index three times: to count the terms, for the rarest words' lists, and for the lists of documents still open.

Tables of terms, windows and of documents with open places are broadcast only if their counted size allows it (``BROADCAST_BYTES``);
beyond it the same joins are done by shuffle, with equal results. Intermediate results are written, so that a lost executor repeats its tasks only.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Edge cases: a null or empty text has no words; an item without words has no
window; items are told apart by id (a null id counts as the empty text) and repeated rows of one count once; every document
row is one document, repeated and null ids included; an empty table gives an empty result, an empty benchmark one without
hits; other columns are not read. A document is indexed whole, so its postings pass through one task, as the text itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from classcraft.llm.common import fresh_path, written

# The characters that separate words, after A-Z became a-z.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WINDOW, SLACK = 10, 5
BROADCAST_BYTES = 32 << 20


def words_of(text: str) -> Column:
    """The words of a text, in order; none for a null."""
    parts = F.split(F.coalesce(F.translate(F.col(text), UPPER, LOWER), F.lit("")), BETWEEN_WORDS)
    # separators at either end leave an empty part there
    inner = lambda w: F.slice(w, F.lit(1) + _empty(F.get(w, F.lit(0))),
                              F.greatest(F.size(w) - _empty(F.get(w, F.lit(0))) - _empty(F.get(w, F.size(w) - 1)), F.lit(0)))
    return F.element_at(F.transform(F.array(parts), inner), 1)


def _empty(word: Column) -> Column:
    return (word == "").cast("int")


# ── the index ───────────────────────────────────────────────────────────────
def build(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> str:
    """Write the index of ``docs`` and return its folder."""
    path = fresh_path(docs.sparkSession, "phrase-index")
    numbered = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(f"`{doc_id}`").alias("doc_id"), words_of(f"`{text}`").alias("w"))
    # place 0 is the header, place p the word p - 1
    cells = numbered.select("doc", "doc_id", F.size("w").alias("n"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.col("w"))).alias("p", "term"))
    header = F.col("p") == 0
    rows = cells.select("term", "doc", (F.col("p") - 1).alias("pos"), F.when(header, F.col("doc_id")).alias("doc_id"), F.when(header, F.col("n")).alias("n_words"))
    # one long to sort by: a radix sort, which keeps the order of documents and positions within a term
    place = F.when(F.col("term").isNull(), F.lit(-(1 << 63))).otherwise(F.xxhash64("term"))
    (rows.sortWithinPartitions(place).write.option("compression", "zstd").option("parquet.writer.version", "v2")
     .option("parquet.enable.dictionary#doc", "false").option("parquet.enable.dictionary#pos", "false").parquet(path))
    return path


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("term IS NOT NULL").select("term", "doc", "pos")


def headers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("term IS NULL").select("doc", "doc_id", F.col("n_words").cast("long").alias("n_words"))


# ── items, their windows and the order of intersection ──────────────────────
def bounded(small: DataFrame, size: Column) -> DataFrame:
    """``small`` marked for broadcast if its rows, of ``size`` bytes each, are within the bound."""
    held = small.agg(F.sum(size + 32)).first()[0] or 0
    return F.broadcast(small) if held <= BROADCAST_BYTES else small.hint("shuffle_hash")


def numbered_items(items: DataFrame, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item, item_id as text, words) of the items that have words."""
    rows = items.select(F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"), words_of(f"`{text}`").alias("words"))
    return written(rows.where(F.size("words") > 0).distinct().withColumn("item", F.monotonically_increasing_id()), "phrase-items")


def ranked_windows(index: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(item, s, words, js, terms): each window's start and length, and its offsets in the item and words, the rarest first.

    Windows with a word that no document has are left out.
    """
    terms = written(items.select(F.explode("words").alias("term")).distinct(), "phrase-terms")
    found = index.join(bounded(terms, F.length("term")), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    words = F.least(F.size("words"), F.lit(window))
    cells = items.select("item", "words", words.alias("length"), F.explode(F.sequence(F.lit(0), F.size("words") - words)).alias("s"))
    cells = cells.select("item", "s", "length", F.explode(F.transform(F.sequence(F.lit(0), F.col("length") - 1),
                                                                      lambda o: F.struct((F.col("s") + o).alias("j"), F.get("words", F.col("s") + o).alias("term")))).alias("x"))
    ranked = cells.select("item", "s", "length", "x.*").join(found, "term").groupBy("item", "s", "length").agg(
        F.array_sort(F.collect_list(F.struct("n", "j", "term"))).alias("x")).where(F.size("x") == F.col("length"))
    return written(ranked.select("item", "s", "length", F.col("x.j").alias("js"), F.col("x.term").alias("terms")), "phrase-windows")


def rare_lists(index: DataFrame, windows: DataFrame) -> DataFrame:
    """The postings of the words that are the rarest or second rarest different ones of some window: the lists to begin with."""
    asked = windows.select(F.explode(F.slice(F.array_distinct("terms"), 1, 2)).alias("term"))
    seconds = windows.select(F.get("terms", F.lit(1)).alias("term")).where("term IS NOT NULL")
    terms = written(asked.unionByName(seconds).distinct(), "phrase-rare-terms")
    return written(index.join(bounded(terms, F.length("term")), "term", "left_semi"), "phrase-rare")


def lists_of(index: DataFrame, items: DataFrame, docs: DataFrame) -> DataFrame:
    """The postings of the items' words in the documents ``docs``, those with places still open."""
    terms = written(items.select(F.explode("words").alias("term")).distinct(), "phrase-terms")
    held = written(docs.distinct(), "phrase-docs")
    return written(index.join(bounded(held, F.lit(8)), "doc", "left_semi").join(bounded(terms, F.length("term")), "term", "left_semi"), "phrase-lists")


# ── exact phrases ───────────────────────────────────────────────────────────
def open_diagonals(rare: DataFrame, windows: DataFrame) -> DataFrame:
    """(item, doc, delta, starts, length): diagonals with the windows whose two rarest words both lie there."""
    pair = windows.select("item", "s", "length", F.get("terms", F.lit(0)).alias("term"), F.get("js", F.lit(0)).alias("j"),
                          F.get("terms", F.lit(1)).alias("next"), F.get("js", F.lit(1)).alias("next_j"))
    place = F.col("pos") - F.col("j")
    first = rare.join(bounded(pair, F.length("term") + F.length(F.coalesce("next", F.lit("")))), "term").where(place + F.col("s") >= 0)
    first = first.select("item", "s", "length", "doc", place.alias("delta"), F.col("next").alias("term"), (place + F.col("next_j")).alias("pos"))
    both = first.where("term IS NOT NULL").join(rare, ["doc", "pos", "term"], "left_semi")
    left = both.unionByName(first.where("term IS NULL"))  # a window of one word
    return written(left.groupBy("item", "doc", "delta").agg(F.collect_set("s").alias("starts"), F.first("length").alias("length")), "phrase-diagonals")


def stretches(diagonals: DataFrame, lists: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """(item, item_id, doc, delta, first, last): maximal stretches of item words on the diagonals, at least one window long."""
    needed = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1))))
    probes = diagonals.join(items.select("item", "words"), "item").select("item", "doc", "delta", "words", F.explode(needed).alias("j")).select(
        "item", "doc", "delta", "j", F.get("words", F.col("j")).alias("term"), (F.col("delta") + F.col("j")).alias("pos"))
    found = probes.join(lists, ["doc", "pos", "term"], "left_semi")
    along = Window.partitionBy("item", "doc", "delta").orderBy("j")
    islands = found.select("item", "doc", "delta", "j", (F.col("j") - F.row_number().over(along)).alias("island")).groupBy("item", "doc", "delta", "island").agg(
        F.min("j").alias("a"), F.max("j").alias("b"))
    whole = items.select("item", "item_id", F.least(F.size("words"), F.lit(window)).alias("length"))
    return islands.join(whole, "item").where(F.col("b") - F.col("a") + 1 >= F.col("length")).select(
        "item", "item_id", "doc", "delta", (F.col("delta") + F.col("a")).alias("first"), (F.col("delta") + F.col("b")).alias("last"))


# ── proximity ───────────────────────────────────────────────────────────────
def _around(at: str, widest: int) -> Column:
    """The blocks of ``widest`` positions that a stretch with the position ``at`` may touch."""
    b = F.floor(F.col(at) / widest)
    return F.explode(F.array(b - 1, b, b + 1))


def _blocks(postings_: DataFrame, widest: int) -> DataFrame:
    return postings_.select("doc", "term", F.floor(F.col("pos") / widest).alias("block"), "pos")


NEAR = "abs(pos - at) < reach"


def open_neighbourhoods(rare: DataFrame, windows: DataFrame, slack: int, widest: int) -> DataFrame:
    """(item, s, reach, doc, at): places of a window's rarest word that have its second rarest different word near."""
    terms = F.array_distinct("terms")   # keeps the first of each: the rarest still come first
    pair = windows.select("item", "s", (F.col("length") + slack).alias("reach"), F.get(terms, F.lit(0)).alias("term"), F.get(terms, F.lit(1)).alias("next"))
    first = rare.join(bounded(pair, F.length("term") + F.length(F.coalesce("next", F.lit("")))), "term")
    first = first.select("item", "s", "reach", "doc", F.col("pos").alias("at"), F.col("next").alias("term"))
    probed = first.where("term IS NOT NULL").select("*", _around("at", widest).alias("block"))
    both = probed.join(_blocks(rare, widest), ["doc", "term", "block"]).where(NEAR).select("item", "s", "reach", "doc", "at")
    return written(both.unionByName(first.where("term IS NULL").drop("term")).distinct(), "phrase-near")


def neighbours(places: DataFrame, lists: DataFrame, items: DataFrame, windows: DataFrame, widest: int) -> DataFrame:
    """(item, item_id, doc) of the items with a window whose different words all lie within its reach."""
    terms = windows.select("item", "s", F.array_distinct("terms").alias("terms"))
    wanted = places.join(terms, ["item", "s"]).select("item", "s", "reach", "doc", "at", F.size("terms").alias("different"), F.explode("terms").alias("term"))
    around = wanted.select("*", _around("at", widest).alias("block")).join(_blocks(lists, widest), ["doc", "term", "block"]).where(NEAR)
    gathered = around.groupBy("item", "s", "reach", "doc", "at", "different").agg(F.collect_list(F.struct("pos", "term")).alias("x"))
    within = lambda p: F.size(F.array_distinct(F.transform(
        F.filter("x", lambda y: (y["pos"] >= p["pos"]) & (y["pos"] < p["pos"] + F.col("reach"))), lambda y: y["term"]))) == F.col("different")
    return gathered.where(F.exists("x", within)).select("item", "doc").distinct().join(items.select("item", "item_id"), "item")


def search(spark: SparkSession, path: str, items: DataFrame, window: int = WINDOW, slack: int = SLACK) -> tuple[DataFrame, DataFrame]:
    """(exact matches as ``stretches`` gives them, proximity matches as ``neighbours`` gives them) of numbered items in an index."""
    index = postings(spark, path)
    windows = ranked_windows(index, items, window)
    widest = window + slack
    rare = rare_lists(index, windows)
    diagonals, places = open_diagonals(rare, windows), open_neighbourhoods(rare, windows, slack, widest)
    lists = lists_of(index, items, diagonals.select("doc").unionByName(places.select("doc")))
    return stretches(diagonals, lists, items, window), neighbours(places, lists, items, windows, widest)


# ── the report ──────────────────────────────────────────────────────────────
def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, slack: int = SLACK, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near, the items with a proximity match
    (those with an exact one among them)."""
    spark = docs.sparkSession
    path = build(docs, text)
    exact, near = search(spark, path, numbered_items(items, text), window, slack)
    found = written(exact, "phrase-found")
    before = Window.partitionBy("doc").orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("last").over(before), F.lit(-1))
    spans = found.select("doc", "first", "last").distinct().select("doc", (F.col("last") - F.greatest("first", reached + 1) + 1).alias("new"))
    hits = spans.groupBy("doc").agg(F.sum(F.greatest("new", F.lit(0))).cast("long").alias("n_hit"))
    names = found.groupBy("doc").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    close = near.groupBy("doc").agg(F.countDistinct("item_id").alias("n_near"))
    rows = headers(spark, path).join(hits.join(names, "doc").join(close, "doc", "full"), "doc", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", number("n_hit").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                       F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
                       number("n_near").alias("n_near"))


# n_near is by definition: the least stretch from any place of a window's word that holds all its different words.
ORACLE_SQL = r"""
WITH lowered AS (
  SELECT 'd' AS kind, row_number() OVER () AS doc, doc_id AS id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM windows), grams AS (
  SELECT doc, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM lowered, lengths, unnest(range(1, len(w) - n + 2)) AS t(s)
), found AS (
  SELECT DISTINCT doc, s, n, item_id FROM grams JOIN windows USING (n, phrase)
), hits AS (
  SELECT doc, count(DISTINCT s + o) AS n_hit FROM found, unnest(range(0, n)) AS t(o) GROUP BY doc
), named AS (
  SELECT doc, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc, item_id FROM found) GROUP BY doc
), wanted AS (
  SELECT item_id, phrase, n, len(list_distinct(string_split(phrase, ' '))) AS different, unnest(list_distinct(string_split(phrase, ' '))) AS term FROM windows
), places AS (
  SELECT doc, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM lowered
), first AS (
  SELECT term, count(*) AS c FROM places WHERE term IN (SELECT term FROM wanted) GROUP BY term
), rarest AS (
  SELECT item_id, phrase, n, different, arg_min(term, (c, term)) AS term FROM wanted JOIN first USING (term) GROUP BY ALL HAVING count(*) = different
), close AS (
  SELECT item_id, phrase, n, different, doc, pos AS at FROM rarest JOIN places USING (term)
), around AS (
  SELECT c.item_id, c.phrase, c.n, c.different, c.doc, c.at, p.pos, p.term
  FROM close c JOIN places p ON p.doc = c.doc AND p.pos BETWEEN c.at - c.n - 4 AND c.at + c.n + 4
  WHERE list_contains(string_split(c.phrase, ' '), p.term)
), near AS (
  SELECT a.doc, a.item_id, a.phrase, a.at, a.pos FROM around a JOIN around b ON a.doc = b.doc AND a.item_id = b.item_id AND a.phrase = b.phrase AND a.at = b.at
   AND b.pos BETWEEN a.pos AND a.pos + a.n + 4
  GROUP BY a.doc, a.item_id, a.phrase, a.at, a.pos, a.different HAVING count(DISTINCT b.term) = a.different
), close_items AS (SELECT doc, count(DISTINCT item_id) AS n_near FROM near GROUP BY doc)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM lowered LEFT JOIN hits USING (doc) LEFT JOIN named USING (doc) LEFT JOIN close_items USING (doc)
"""
