"""Operator 7: benchmark passages in training texts by spaced-seed hashing. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .sized import maybe_broadcast

#: Token positions that count. Any 13 aligned tokens with at most two substitutions, and any 10 to 12
#: with at most one, hold one of the two masks unharmed.
MASKS = ((0, 2, 4, 5, 6, 7), (0, 1, 2, 3, 6, 8))
WINDOW, SUBSTITUTIONS = 13, 2
#: Items of fewer tokens have masks of their own.
LONG = 10
SEED_BYTES, HIT_BYTES = 256 << 20, 16 << 20
#: Alignments that are compared beside one copy of a text.
HITS = 512

#: White space, control characters and punctuation: ASCII, Latin-1 but for letters, general and CJK blocks.
BREAK = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\u2000-\u206f\u3000-\u303f]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of what is not a break."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def short_masks(n: int) -> list[tuple[int, ...]]:
    """Masks over a whole item of ``n`` < LONG tokens: all of it, or its even and its odd places if one may differ."""
    if n * SUBSTITUTIONS // WINDOW == 0:
        return [tuple(range(n))]
    return [tuple(range(0, n, 2)), tuple(range(1, n, 2))]


def _masks(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(item length, mask); length 0 stands for all long items."""
    return [(0, m) for m in MASKS] + [(n, m) for n in short for m in short_masks(n)]


def seeds(texts: DataFrame, names: list[str], pos: str, short: list[int]) -> DataFrame:
    """``seed``, ``names``, ``pos``, ``_for``: a hash per token position and mask; masked-out positions are ignored.

    The seed is null where the mask reaches beyond the text. ``_for`` is the item length of the mask.
    """
    masks = _masks(short)
    hashed = texts.select(*names, F.transform(tokens(F.col("_text")), lambda w: F.xxhash64(w)).alias("_h"))

    def at(_: Column, i: Column) -> Column:
        return F.array(*[F.when(F.get("_h", i + mask[-1]).isNotNull(), F.xxhash64(F.lit(n), F.lit(k), *[F.get("_h", i + j) for j in mask])) for k, (n, mask) in enumerate(masks)])

    every = hashed.select(*names, F.posexplode(F.flatten(F.transform("_h", at))).alias("_p", "seed"))
    lengths = F.array(*[F.lit(n) for n, _ in masks])
    return every.select("seed", *names, F.floor(F.col("_p") / len(masks)).cast("int").alias(pos), F.get(lengths, (F.col("_p") % len(masks)).cast("int")).alias("_for"))


def _verified(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """``doc_id, k1, k2, item_id, shift, matched, best_window`` of every alignment that is a leak; k1, k2 hash the text."""
    keep = Scratch(docs.sparkSession, "leaks")
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")).where("_text is not null")
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("string").alias("_text")).where("_text is not null").distinct()
    items = keep.save(items.withColumn("_item", F.monotonically_increasing_id()).withColumn("_i", tokens(F.col("_text"))).where(F.size("_i") > 0), "items")
    sized = items.withColumn("_n", F.size("_i"))
    short = sorted(r["_n"] for r in sized.where(F.col("_n") < LONG).select("_n").distinct().collect())  # nine lengths at most
    own = F.when(F.col("_n") < LONG, (F.col("_for") == F.col("_n")) & (F.col("_b") == 0)).otherwise(F.col("_for") == 0)
    known = seeds(sized, ["_item", "_n"], "_b", short).where(F.col("seed").isNotNull() & own)
    known = keep.save(known.select("seed", "_item", "_n", "_b").distinct(), "seeds")
    name = ["doc_id", "k1", "k2"]
    found = seeds(texts, name, "_d", short).select("seed", *name, "_d").join(maybe_broadcast(known, SEED_BYTES), "seed")
    hits = keep.save(found.select(*name, "_item", "_n", (F.col("_d") - F.col("_b")).alias("shift")).distinct(), "hits")
    # a text meets its alignments in lots of bounded size, so its tokens are split once a lot and no lot grows with the data
    lots = hits.groupBy(*name).agg(F.ceil(F.count("*") / HITS).alias("_lots"))
    renamed = {c: f"_{c}" for c in name}
    dealt = hits.join(lots.withColumnsRenamed(renamed), same_names(name)).select(*name, "_item", "_n", "shift", F.pmod(F.xxhash64("_item", "shift"), F.col("_lots")).alias("_lot"))
    lot = keep.save(dealt.groupBy(*name, "_lot").agg(F.collect_list(F.struct("_item", "_n", "shift")).alias("_hits")), "lots")
    # rows that repeat whole hold the same leaks; the mark keeps filters above the split
    lot = maybe_broadcast(lot.withColumnsRenamed(renamed), HIT_BYTES)
    wide = texts.join(lot, same_names(name)).select(*name, "_hits", tokens(F.col("_text")).alias("_w"), F.monotonically_increasing_id().alias("_mark")).where("_mark >= 0")
    start = lambda x: F.greatest(F.lit(0), -x["shift"])
    part = lambda x: F.slice("_w", start(x) + x["shift"] + 1, F.greatest(F.least(x["_n"], F.size("_w") - x["shift"]) - start(x), F.lit(0)))
    one = wide.select(*name, F.explode(F.transform("_hits", lambda x: F.struct(x["_item"].alias("_item"), x["shift"].alias("shift"), part(x).alias("_p")))).alias("_x")).select(*name, "_x.*")
    joined = one.join(maybe_broadcast(items.select("_item", "item_id", "_i"), HIT_BYTES), "_item")
    aligned = F.zip_with("_p", F.slice("_i", F.greatest(F.lit(0), -F.col("shift")) + 1, F.size("_p")), lambda a, b: (a == b).cast("int"))
    joined = joined.select(*name, "item_id", "shift", F.least(F.lit(WINDOW), F.size("_i")).alias("_n"), aligned.alias("_e"), F.monotonically_increasing_id().alias("_mark"))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_e") - F.col("_n") + 1), lambda s: F.aggregate(F.slice("_e", s, F.col("_n")), F.lit(0), lambda x, y: x + y)))
    matched = F.aggregate("_e", F.lit(0), lambda x, y: x + y)
    scored = joined.where((F.size("_e") >= F.col("_n")) & (F.col("_mark") >= 0)).select(*name, "item_id", "shift", "_n", best.alias("best_window"), matched.alias("matched"))
    return scored.where(F.col("best_window") >= F.col("_n") - F.floor(F.col("_n") * SUBSTITUTIONS / WINDOW))


def same_names(name: list[str]) -> Column:
    """Equality of columns with those renamed by a leading underscore, nulls equal."""
    out = F.lit(True)
    for c in name:
        out = out & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and benchmark item that it leaks.

    Returns ``doc_id, item_id, at_word, matched, best_window``. Seeds of both sides are joined by
    hash; a hit proposes an alignment (difference of positions), and the aligned tokens are
    compared one by one. It is a leak if some 13 aligned tokens (the whole item if shorter)
    have at most two substitutions (in proportion if shorter: one from 7 tokens on, none below).
    ``matched`` counts equal tokens of the alignment, ``at_word`` is where the item starts in the
    document (the least such).

    Items of any length are found: those under 10 tokens by masks over the whole item. Null or empty
    texts on either side match nothing. Very long texts are searched whole. Rows that share an id
    are one document, and so are those with a null id, which have the id null. Empty tables give
    an empty table; other columns play no part.
    """
    good = _verified(docs, benchmark, id_col, text_col, item_col, item_text)
    return good.groupBy("doc_id", "item_id").agg(F.min("shift").alias("at_word"), F.max("matched").cast("long").alias("matched"), F.max("best_window").cast("long").alias("best_window"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text leaks no item; all columns stay, whatever they are called.

    Told by the text, not the id: rows with null or repeated ids are judged each on its own. Null
    and empty texts leak nothing and stay, and so does every row if the benchmark is empty.
    """
    keep = Scratch(docs.sparkSession, "leaks")
    bad = keep.save(_verified(docs, benchmark, id_col, text_col, "item_id", "text").select(F.col("k1").alias("_1"), F.col("k2").alias("_2")).distinct(), "texts")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.struct("*").alias("_row"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b"))
    return rows.join(maybe_broadcast(bad, HIT_BYTES), (F.col("_a") == F.col("_1")) & (F.col("_b") == F.col("_2")), "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: No seeds: every pair of equal tokens, counted per alignment and in each run of 13 places.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x{7b}-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-\x2f\x3a-\x40\x5b-\x60\x{7b}-\x{a9}\x{ab}-\x{b1}\x{b4}\x{b6}-\x{b8}\x{bb}\x{bf}\x{2000}-\x{206f}\x{3000}-\x{303f}]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), dt AS (SELECT doc_id, len(w) AS nd, unnest(w) AS t, unnest(range(len(w))) AS p FROM d
), bt AS (SELECT item_id, len(w) AS ni, least(13, len(w)) AS k, unnest(w) AS t, unnest(range(len(w))) AS p FROM b
), g AS (
  SELECT doc_id, item_id, dt.p - bt.p AS shift, any_value(ni) AS ni, any_value(nd) AS nd, any_value(k) AS k, count(*) AS matched, list(bt.p) AS places
  FROM dt JOIN bt USING (t) GROUP BY ALL HAVING count(*) >= any_value(k) - any_value(k) * 2 // 13
), a AS (
  SELECT doc_id, item_id, shift, k, matched, unnest(places) AS q FROM g
  WHERE least(ni, nd - shift) - greatest(0, -shift) >= k
), r AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY q RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM a
), s AS (
  SELECT doc_id, item_id, shift, any_value(matched) AS matched, max(c) AS best, any_value(k) AS k FROM r GROUP BY ALL
)
SELECT doc_id, item_id, min(shift)::INT AS at_word, max(matched)::BIGINT AS matched, max(best)::BIGINT AS best_window
FROM s WHERE best >= k - k * 2 // 13 GROUP BY doc_id, item_id
"""
