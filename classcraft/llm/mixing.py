"""Mix sources to target weights: hash-threshold histograms, DataFrame functions only.

A source's target is its weighted share of ``share`` times all words, but at most ``max_repeat``
times its own words; what is cut off goes to the other sources by weight until none is above
(water filling, solved in closed form over the sources sorted by where they fill up).

Every document has a fixed 36-bit hash of its id. A source takes each document floor(target / size
of the source) times and once more where the hash is under the source's threshold. The threshold comes from
nested histograms: words by (source, leading 12 bits), a running sum of the at most 4,096 buckets finds the
one that the budget ends in, and only documents of that bucket are counted again by the next 12 bits.
Nothing is sorted by document, and the filter is one comparison. After 36 bits the last bucket
is a document or a tie of ids; it is taken if that brings the source nearer to its target.

Edge cases: a null text has size 0; a null source is a source of its own and comes last; null ids share
one hash; repeated rows share the hash of their id, so they are taken alike; sources without words get
target 0; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from classcraft.llm.common import WORD_PATTERN, written

BITS, LEVELS = 12, 3  # 12 bits a histogram, three nested histograms
HASH_DIGITS = BITS * LEVELS // 4


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words and 36-bit hash of every document."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long").alias("h"))


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, so the windows are small."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("fill", "turn")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (sources.withColumn("turn", F.row_number().over(by_name))
              .withColumn("weight", F.element_at(cycle, ((F.col("turn") - 1) % len(weights) + 1).cast("int")))
              .withColumn("cap", F.col("source_size") * F.lit(max_repeat))
              .withColumn("fill", F.col("cap") / F.col("weight")))
    whole = Window.partitionBy()
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    leveled = ranked.withColumn("level", level)
    water = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "turn", "level"))).over(whole)["level"]
    return leveled.withColumn("water", F.coalesce(water, F.lit(0.0))).select(
        "source", "source_size", F.round(F.least("cap", F.col("water") * F.col("weight")), 6).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, cut): whole copies of each document, one more where h < cut."""
    state = (targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                .otherwise(0).cast("long"))
             .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
             .withColumn("prefix", F.lit(0).cast("long")))
    for step in range(LEVELS):
        shift = BITS * (LEVELS - 1 - step)
        here, s = rows.alias("r"), state.alias("s")
        match = F.col("r.source").eqNullSafe(F.col("s.source")) & (F.shiftright("h", shift + BITS) == F.col("prefix"))
        buckets = (here.join(s, match).groupBy(F.col("s.source").alias("source"), F.shiftright("h", shift).alias("bucket"))
                   .agg(F.sum("size").alias("words")))
        through = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        sums = buckets.withColumn("through", through).alias("b")
        ended = (sums.join(s, F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("through") > F.col("rest")))
                 .groupBy(F.col("s.source").alias("source"))
                 .agg(F.min(F.struct("bucket", "words", "through")).alias("end")).alias("e"))
        state = written(s.join(ended, F.col("e.source").eqNullSafe(F.col("s.source")), "left").select(
            "s.source", "source_size", "target", "copies",
            (F.col("rest") - (F.col("end.through") - F.col("end.words"))).alias("rest"),
            F.col("end.bucket").alias("prefix"), F.col("end.words").alias("unit")), "mix-state")
    nearer = F.col("rest") * 2 > F.col("unit")
    return state.select("source", "source_size", "target", "copies",
                        F.coalesce(F.col("prefix") + F.when(nearer, 1).otherwise(0), F.lit(0)).cast("long").alias("cut"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): words taken of each document, repeats counted."""
    rows = written(sized(docs), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sources, weights, share, max_repeat), "mix-targets")
    cuts = thresholds(rows, targets).alias("c")
    joined = rows.alias("r").join(cuts, F.col("r.source").eqNullSafe(F.col("c.source")))
    copies = F.col("copies") + (F.col("h") < F.col("cut")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"),
                         copies.alias("n_copies"), "h", F.col("r.source").alias("source"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it is taken.

    A document without words is neither wanted nor in the way: it stays once.
    The decision is a function of (source, hash of the id), so the text is never shuffled: the thresholds,
    one row per source, are joined to the documents.
    """
    rows = written(sized(docs), "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sources, **options), "mix-targets")
    cuts = thresholds(rows, targets).alias("c")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    whole = docs.select(
        F.struct(*docs.columns).alias("row"), F.col("source").cast("string").alias("of"),
        F.coalesce(F.col("text"), F.lit("")).rlike(WORD_PATTERN).alias("has_words"),
        F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long").alias("h"))
    joined = whole.join(cuts, F.col("of").eqNullSafe(F.col("c.source")))
    times = F.when(F.col("has_words"), F.col("copies") + (F.col("h") < F.col("cut")).cast("long")).otherwise(1).cast("int")
    return joined.select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 10),
      lambda i: (instr('0123456789abcdef', substr(md5(coalesce(doc_id::VARCHAR, '')), i, 1)) - 1)::BIGINT)),
      lambda a, b: a * 16 + b) AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM s0),
s2 AS (SELECT *, [5.0, 2.0, 1.0][((turn - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2 AS cap FROM s1),
s3 AS (SELECT *, cap / weight AS fill FROM s2),
s4 AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY fill, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s3),
w AS (SELECT coalesce((SELECT level FROM s4 WHERE level <= fill ORDER BY fill, turn LIMIT 1), 0) AS water),
t AS (SELECT source, source_size, round(least(cap, water * weight), 6) AS target FROM s4, w),
t2 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
t3 AS (SELECT *, target - copies * source_size AS rest FROM t2),
u AS (SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h),
c AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h) AS through FROM u),
e AS (SELECT c.source, min(h) AS edge FROM c JOIN t3 ON c.source IS NOT DISTINCT FROM t3.source WHERE through > rest GROUP BY c.source),
cut AS (SELECT t3.*, coalesce(c.h + CASE WHEN (rest - (through - words)) * 2 > words THEN 1 ELSE 0 END, 0) AS cut
  FROM t3 LEFT JOIN e ON e.source IS NOT DISTINCT FROM t3.source
  LEFT JOIN c ON c.source IS NOT DISTINCT FROM t3.source AND c.h = e.edge)
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN h < cut THEN 1 ELSE 0 END) AS taken
FROM d JOIN cut ON d.source IS NOT DISTINCT FROM cut.source
"""
