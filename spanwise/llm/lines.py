"""Operator 8: equal and nearly equal lines by a segment-partition edit join. Built-in functions only."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .sized import maybe_broadcast

#: Lines are compared by edits from 15 characters an edit on; exact repeats need no length.
EDITS, LEAST_CHARS = 2, 30
WORD = "[\\p{L}\\p{N}]"
ID_BYTES = 16 << 20
#: Lines that may share a segment before it is split by the rest of the lines. A line's keys for the
#: split cost about as much as this many comparisons of letter counts, by estimate; it was not measured.
CROWD = 8192


def _segments(edits: int) -> Column:
    """Hashes of the edits + 1 even segments of a line, with the line's length and the segment's place."""
    n, parts = F.col("n"), edits + 1
    out = []
    for i in range(parts):
        start = F.floor(n / parts) * i + F.greatest(F.lit(0), n % parts - (parts - i))
        size = F.floor(n / parts) + F.when(F.lit(parts - i) <= n % parts, 1).otherwise(0)
        out.append(F.xxhash64(n, F.lit(i), F.substring("line", (start + 1).cast("int"), size.cast("int"))))
    return F.array(*out)


def _probes(edits: int) -> Column:
    """Hashes of the substrings that can equal a segment of a line 0..edits shorter (multi-match-aware selection), those in ``segments`` too."""
    parts, out = edits + 1, []
    for d in range(edits + 1):
        n = F.col("n") - d
        for i in range(parts):
            start = F.floor(n / parts) * i + F.greatest(F.lit(0), n % parts - (parts - i))
            size = F.floor(n / parts) + F.when(F.lit(parts - i) <= n % parts, 1).otherwise(0)
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                at = start + shift + 1
                if d == shift == 0:  # the line's own segment
                    out.append(F.element_at("segments", i + 1))
                    continue
                piece = F.substring("line", at.cast("int"), size.cast("int"))
                out.append(F.when((n >= parts) & (at >= 1) & (at + size - 1 <= F.col("n")), F.xxhash64(n.cast("int"), F.lit(i), piece)))
    return F.array_distinct(F.array_compact(F.array(*out)))


LETTERS = "eantoirs"


def _letters(line: Column) -> Column:
    """Counts of eight frequent letters modulo 16, four bits each."""
    packed = F.lit(0)
    for k, letter in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        packed = packed.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)), 4 * k))
    return packed


def _letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of how far the counts are apart; an edit changes two of them by one at most."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        d = (F.shiftrightunsigned(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * k).bitwiseAND(F.lit(15))).bitwiseAND(F.lit(15))
        total = total + F.least(d, 16 - d)
    return total


def _occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, short: bool = False) -> DataFrame:
    """``doc, at, line, n, k1, k2`` for every line of at least ``least`` characters, or with ``short`` a word; the hashes are 128 bits."""
    split = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("at", "line"))
    taken = F.length("line") >= least
    return split.where(taken | F.col("line").rlike(WORD) if short else taken).select("doc", "at", "line", F.length("line").alias("n"), F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _distinct(docs: DataFrame, id_col: str, text_col: str, least: int, short: bool) -> DataFrame:
    """One row per different line: hashes, first place, whether it comes again; text, length and letters of those compared by edits."""
    long_enough = F.col("n") >= least
    every = _occurrences(docs, id_col, text_col, least, short).withColumn("line", F.when(long_enough, F.col("line")))
    return every.groupBy("k1", "k2").agg(F.min(F.struct("doc", "at")).alias("first"), (F.count("*") > 1).alias("again"), F.any_value("line").alias("line"), F.any_value("n").alias("n"))


def _indexed(distinct: DataFrame, edits: int) -> DataFrame:
    """``distinct`` with what every later step asks of a line: its letters and the hashes of its segments."""
    there = F.col("line").isNotNull()
    return distinct.withColumns({"bits": F.when(there, _letters(F.col("line"))), "segments": F.when(there, _segments(edits))})


def _cuts(edits: int, probe: bool) -> Column:
    """Array of ``places, shifts``: which segments of ``3 * edits`` are left out, and how far the text behind each has moved.

    Lines within ``edits`` edits agree outside some ``edits`` segments. Behind the j-th of these the longer
    line is moved by ``shifts[j]``; the moves cost an edit for each character. The shorter line has none.
    """
    out = []
    for places in itertools.combinations(range(3 * edits), edits):
        for moved in itertools.product(range(-edits, edits + 1), repeat=edits) if probe else [(0,) * edits]:
            if moved[-1] >= 0 and sum(abs(x - y) for x, y in zip(moved, (0, *moved[:-1]), strict=True)) <= edits:
                out.append(F.struct(F.array(*map(F.lit, places)).alias("places"), F.array(*map(F.lit, moved)).alias("shifts")))
    return F.array(*out)


def _cut(rows: DataFrame, edits: int, probe: bool) -> DataFrame:
    """``key, end, k, f, bits, n, t``: rows by what their text ``t`` has outside each choice of segments; ``t`` is then the rest.

    ``end`` marks keys whose text had at most a character a segment; their rest is too short to be cut again.
    """
    parts, t = 3 * edits, F.col("t")
    places, shifts = F.col("_cut.places"), F.col("_cut.shifts")
    size = F.length("t") - shifts[edits - 1]  # length of the shorter text
    kept, rest, sound, behind, moved = [], [], size >= 0, F.lit(0), F.lit(0)
    for j in range(edits):
        i = places[j]
        start = (F.floor(size / parts) * i + F.greatest(F.lit(0), size % parts - (parts - i))).cast("int")
        stop = start + (F.floor(size / parts) + F.when(parts - i <= size % parts, 1).otherwise(0)).cast("int")
        kept.append(F.substring(t, behind + moved + 1, start - behind))
        rest.append(F.substring(t, start + moved + 1, stop + shifts[j] - start - moved))
        sound = sound & (stop + shifts[j] >= start + moved)
        behind, moved = stop, shifts[j]
    kept.append(F.substring(t, behind + moved + 1, F.length("t")))
    cut = rows.withColumn("_cut", F.explode(_cuts(edits, probe))).where(sound)
    return cut.select(F.xxhash64("g", size.cast("int"), places, F.concat(*kept)).alias("key"), (size <= parts).alias("end"), "k", "f", "bits", "n", F.concat(*rest).alias("t"))


def _verified(pairs: DataFrame, distinct: DataFrame, keep: Scratch, edits: int) -> DataFrame:
    """``a1, a2, b1, b2`` of the pairs ``a, b`` within ``edits`` edits; ``pairs`` is a written table."""
    ids = keep.save(pairs.select(F.col("a").alias("_k")).unionByName(pairs.select(F.col("b").alias("_k"))).distinct(), "ids")
    texts = distinct.where("line is not null").join(maybe_broadcast(ids, ID_BYTES), F.col("k1") == F.col("_k"), "left_semi")
    texts = keep.save(texts.select("k1", "k2", "line"), "lines")
    one = texts.select(F.col("k1").alias("a"), F.col("k2").alias("a2"), F.col("line").alias("_la"))
    two = texts.select(F.col("k1").alias("b"), F.col("k2").alias("b2"), F.col("line").alias("_lb"))
    checked = pairs.join(one, "a").join(two, "b").where(F.levenshtein("_la", "_lb", edits) >= 0)
    return checked.select(F.col("a").alias("a1"), "a2", F.col("b").alias("b1"), "b2")


def _near(a: str, b: str, edits: int) -> Column:
    """Rows ``a`` (the longer line, of equal ones the greater hash) and ``b`` may be within ``edits`` edits by their letters."""
    apart = F.col(f"{a}.n") - F.col(f"{b}.n")
    # of the edits, as many as the lengths differ by are insertions, which change one count only
    return (_letters_apart(F.col(f"{a}.bits"), F.col(f"{b}.bits")) <= 2 * edits - apart) & ((apart > 0) | (F.col(f"{a}.k") > F.col(f"{b}.k"))) & (F.col(f"{a}.k") != F.col(f"{b}.k"))


def _crowded(index: DataFrame, key: str, crowd: int, keep: Scratch) -> DataFrame | None:
    """The keys that more than ``crowd`` rows share, or None."""
    found = keep.save(index.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select(F.col(key).alias("_hot")), "crowded")
    return None if found.isEmpty() else maybe_broadcast(found, ID_BYTES)


def _crowded_links(lines: DataFrame, distinct: DataFrame, keep: Scratch, edits: int, crowd: int) -> DataFrame:
    """Links among lines that share a crowded segment; each line with an earlier line near it has one at least.

    First every row meets the earliest line of its key alone, which settles lines near a common one.
    Lines left are compared within keys of at most ``crowd`` lines: a key with more is cut again by the
    text it left out, until that is a few characters.
    """
    rows = keep.save(lines, "crowd")
    index, probe = _cut(rows, edits, False), _cut(rows, edits, True)
    index, probe = keep.save(index, "index"), keep.save(probe, "probe")
    pairs = None
    for mine, other in ((probe, index), (index, probe)):
        least = other.groupBy(F.col("key").alias("_key")).agg(F.min(F.struct("f", "k")).alias("_m"))
        met = mine.join(least, F.col("key") == F.col("_key")).where((F.col("_m.f") < F.col("f")) & (F.col("_m.k") != F.col("k"))).select(F.col("k").alias("a"), F.col("_m.k").alias("b"))
        pairs = met if pairs is None else pairs.unionByName(met)
    links = keep.save(_verified(keep.save(pairs.distinct(), "pairs"), distinct, keep, edits), "links")
    settled = keep.save(links.select(F.col("a1").alias("_settled")).distinct(), "settled")
    index, probe = (side.join(maybe_broadcast(settled, ID_BYTES), F.col("k") == F.col("_settled"), "left") for side in (index, probe))
    while True:
        hot = _crowded(index.where(~F.col("end")), "key", crowd, keep)
        few = [side if hot is None else side.join(hot, F.col("key") == F.col("_hot"), "left_anti") for side in (index, probe)]
        later = (F.col("a._settled").isNull() & (F.col("b.f") < F.col("a.f"))) | (F.col("b._settled").isNull() & (F.col("a.f") < F.col("b.f")))
        met = few[1].alias("a").join(few[0].alias("b"), (F.col("a.key") == F.col("b.key")) & _near("a", "b", edits) & later)
        met = keep.save(met.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct(), "pairs")
        links = links.unionByName(_verified(met, distinct, keep, edits))
        if hot is None:
            return links
        again = [keep.save(side.join(hot, F.col("key") == F.col("_hot"), "left_semi").withColumnRenamed("key", "g"), "again") for side in (index, probe)]
        index, probe = (_cut(side, edits, k == 1).join(maybe_broadcast(settled, ID_BYTES), F.col("k") == F.col("_settled"), "left") for k, side in enumerate(again))


def similar_pairs(distinct: DataFrame, keep: Scratch, edits: int, crowd: int = CROWD) -> DataFrame:
    """``a1, a2, b1, b2``: hashes of two different lines within ``edits`` edits.

    ``distinct`` is a written table of ``_indexed``. Pairs that share a segment of at most ``crowd``
    lines all appear; of the others enough for each line to meet an earlier one, if there is any.
    """
    rows = distinct.where("line is not null").select(F.col("k1").alias("k"), "n", "line", "first", "bits", "segments")
    index = rows.select(F.explode("segments").alias("h"), "k", "n", "bits")
    probe = rows.select(F.explode(_probes(edits)).alias("h"), "k", "n", "bits")
    hot = _crowded(index, "h", crowd, keep) if edits else None
    few = [side if hot is None else side.join(hot, F.col("h") == F.col("_hot"), "left_anti") for side in (index, probe)]
    pairs = few[1].alias("a").join(few[0].alias("b"), (F.col("a.h") == F.col("b.h")) & _near("a", "b", edits))
    pairs = keep.save(pairs.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct(), "pairs")
    links = _verified(pairs, distinct, keep, edits)
    if hot is None:
        return links
    shared = index.select("h", "k").unionByName(probe.select("h", "k")).join(hot, F.col("h") == F.col("_hot"), "left_semi")
    crowded = rows.join(shared.select(F.col("k").alias("_k")).distinct(), F.col("k") == F.col("_k"), "left_semi")
    crowded = crowded.select(F.lit(0).cast("long").alias("g"), "k", F.col("first").alias("f"), "bits", "n", F.col("line").alias("t"))
    return links.unionByName(_crowded_links(crowded, distinct, keep, edits, crowd))


def repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False, crowd: int = CROWD) -> DataFrame:
    """``doc, at`` of every line that an earlier line equals or is within ``edits`` edits of.

    Earlier: by document id, then by place. Lines under ``least`` characters are left alone, or
    with ``short`` are compared for equality alone if they hold a letter or digit. Segments that
    more than ``crowd`` lines share are split by the rest of the lines; the result is the same.
    """
    keep = Scratch(docs.sparkSession, "lines")
    distinct = keep.save(_indexed(_distinct(docs, id_col, text_col, least, short), edits), "distinct")
    links = keep.save(similar_pairs(distinct, keep, edits, crowd), "links")
    every = _occurrences(docs, id_col, text_col, least, short).select("doc", "at", "k1", "k2")
    firsts = distinct.select("k1", "k2", "first", "again")
    both = links.unionByName(links.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2")))
    around = both.join(firsts.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "first"), ["b1", "b2"]).groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.min("first").alias("near"))
    # a line that is there once is its own first, so it needs no limit of its own
    limits = firsts.where("again").drop("again").unionByName(around.withColumnRenamed("near", "first")).groupBy(F.col("k1").alias("_1"), F.col("k2").alias("_2")).agg(F.min("first").alias("least"))
    placed = every.join(limits, (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")))
    return placed.where(F.struct("doc", "at") > F.col("least")).select("doc", "at")


def _ids_repeat(docs: DataFrame, id_col: str) -> bool:
    """Whether rows share an id or have none, so that an id does not tell a row."""
    return not docs.groupBy(F.col(id_col).alias("_id")).count().where("count > 1 OR _id IS NULL").isEmpty()


def _numbered(docs: DataFrame, keep: Scratch, id_col: str, text_col: str) -> DataFrame:
    """``_row, _id, _text``: rows written once with a number each; ``_id`` is id and number."""
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_name"), F.col(text_col).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_number"))
    return keep.save(rows, "rows").select("_row", F.struct("_name", "_number").alias("_id"), "_text")


def line_report(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``doc_id, n_lines, n_removed, removed`` per row; ``removed``: places from 0, comma-joined.

    Null text: no lines. Very long texts are split whole, very long lines compared whole. Where
    rows share an id or have none, each row is judged by itself: those without id come first, and rows
    of one id in the order in which they are written once. Ties cannot occur, as places differ.
    An empty table gives an empty table; other columns play no part.
    """
    if _ids_repeat(docs, id_col):
        rows = _numbered(docs, Scratch(docs.sparkSession, "lines-rows"), id_col, text_col)
        return _line_report(rows, edits, least, "_id", "_text", short).withColumn("doc_id", F.col("doc_id._name"))
    return _line_report(docs, edits, least, id_col, text_col, short)


def _line_report(docs: DataFrame, edits: int, least: int, id_col: str, text_col: str, short: bool) -> DataFrame:
    gone = repeated_lines(docs, edits, least, id_col, text_col, short).groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("places"))
    counts = docs.groupBy(F.col(id_col).alias("doc_id")).agg(F.sum(F.coalesce(F.size(F.split(F.col(text_col).cast("string"), "\n")), F.lit(0))).cast("long").alias("n_lines"))
    out = counts.join(gone, F.col("doc_id").eqNullSafe(F.col("doc")), "left")
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("places", ","), F.lit("")).alias("removed"))


def drop_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of their texts; other columns stay, whatever they are called.

    Null text stays null; a text all of whose lines go is left empty. Each row loses its own places, also
    where rows share an id or have none (see ``line_report``). Very long texts are
    split whole. An empty table gives an empty table.
    """
    if _ids_repeat(docs, id_col):
        rows = _numbered(docs, Scratch(docs.sparkSession, "lines-rows"), id_col, text_col)
    else:
        rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    gone = repeated_lines(rows, edits, least, "_id", "_text", short).groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("at").alias("_gone"))
    lines = F.filter(F.transform(F.split("_text", "\n"), lambda line, i: F.when(~F.coalesce(F.array_contains("_gone", i), F.lit(False)), line)), lambda x: x.isNotNull())
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_doc")), "left")
    return joined.select(*[F.array_join(lines, "\n").alias(c) if c == text_col else F.col(f"_row.{c}") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), short=True)


#: No segments: all pairs of different lines of nearly equal length. The distance there counts bytes, so
#: letters beyond ASCII, few in the tables, become one control character each.
BEYOND = "äöüßéèêëàâçñáíóúÄÖÜÉÈÊÇÑÍÓÁÚ"
ORACLE = rf"""
WITH o AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents
), t AS (SELECT * FROM o WHERE length(line) >= {LEAST_CHARS} OR regexp_matches(line, '[\p{{L}}\p{{N}}]')
), f AS (SELECT line, min((doc_id, place)) AS first FROM t GROUP BY line
), u AS (SELECT line, first, length(line) AS n, translate(line, '{BEYOND}', (SELECT string_agg(chr(i::INT), '' ORDER BY i) FROM range(1, {len(BEYOND) + 3}) r(i) WHERE i NOT IN (9, 10))) AS x FROM f WHERE length(line) >= {LEAST_CHARS}
), g AS (SELECT x.line, min(y.first) AS first FROM u x JOIN u y ON y.n BETWEEN x.n - {EDITS} AND x.n + {EDITS} AND y.first < x.first AND levenshtein(x.x, y.x) <= {EDITS} GROUP BY x.line
), k AS (SELECT f.line, least(f.first, coalesce(g.first, f.first)) AS least FROM f LEFT JOIN g USING (line)
), z AS (SELECT doc_id, count(*) AS n, string_agg(place, ',' ORDER BY place) AS removed FROM t JOIN k USING (line) WHERE (doc_id, place) > least GROUP BY doc_id)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN z USING (doc_id)
"""
