"""Operator 5: quality rules from a threshold table, compiled into one projection. Built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words that stop words are looked for among: runs of the Latin letters that the lists use, in lower case.
TERM = "[a-zß-öø-ÿœ]+"
LISTED = ("en", "de", "fr", "es")
#: Frequent function words of these four languages.
STOP_WORDS = (
    "the of and to in is that for it with as was by on are this be at from or an have not which "
    "der die das und ist nicht ein eine mit von zu den dem auf für "
    "le la les de des du et est un une en que qui pour dans sur "
    "el los las y es una por con para se del al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``numerator`` must be at least / at most ``threshold`` times ``denominator``."""

    name: str
    numerator: str
    denominator: str | None
    at_least: float | None = None
    at_most: float | None = None

    def holds(self) -> Column:
        whole = F.col(self.denominator) if self.denominator else F.lit(1)
        good = F.lit(True)
        if self.at_least is not None:
            good = good & (F.col(self.numerator) >= whole * F.lit(self.at_least))
        if self.at_most is not None:
            good = good & (F.col(self.numerator) <= whole * F.lit(self.at_most))
        return good


RULES = (
    Rule("word_length", "word_chars", "n_words", at_least=2.0, at_most=15.0),
    Rule("symbol_ratio", "n_symbols", "n_words", at_most=0.1),
    Rule("mark_ratio", "n_marks", "n_words", at_most=0.3),
    Rule("stop_words", "n_stop_words", "n_terms", at_least=0.05),
    Rule("line_ratio", "n_dup_lines", "n_lines", at_most=0.5),
)


def measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, lang_col: str | None = None) -> DataFrame:
    """The counts that rules refer to, beside the columns ``keep``.

    Stop words are counted with each occurrence among ``n_terms``, runs of Latin letters in lower case,
    so neither case nor punctuation hides one. A text of which fewer runs than half its words are such
    is in another script: its ``n_terms`` is 0, and so it is where ``lang_col`` names a language without a list.

    Repeated 3-word windows: 64-bit hashes of windows (built from their words' hashes in order);
    where two are equal, sorting (hash, position) within the text puts them side by side.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    names = keep if keep is not None else docs.columns
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")  # empty only at the ends
    listed = F.coalesce(F.col(lang_col).cast("string").isin(*LISTED), F.lit(True)) if lang_col else F.lit(True)
    terms = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    step = docs.select(*names, text.alias("_t"), words.alias("_w"), F.when(listed, terms).otherwise(F.array()).alias("_k"), F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"))

    def neighbours(column: str, combine) -> Column:
        """combine(x[i], x[i + 1]) over the array; both sides are arguments, not captures."""
        n = F.size(column)
        return F.zip_with(F.slice(column, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(column, F.lit(2), n), combine)

    counts = {
        "n_words": F.size("_w"),
        "word_chars": F.length(F.array_join("_w", "")),
        "n_symbols": F.regexp_count("_t", F.lit("[#*$%&|<>]")),
        "n_marks": F.regexp_count("_t", F.lit("[!?]")),
        "n_terms": F.when(2 * F.size("_k") >= F.size("_w"), F.size("_k")).otherwise(0),
        "n_stop_words": F.size(F.filter("_k", lambda w: w.isin(*STOP_WORDS))),
        "n_lines": F.size("_l"),
        "n_dup_lines": F.size("_l") - F.size(F.array_distinct("_l")),
    }
    step = step.select(*names, *[c.cast("long").alias(n) for n, c in counts.items()], neighbours("_w", lambda a, b: F.xxhash64(a, b)).alias("_2"))
    step = step.select(*names, *counts, neighbours("_2", lambda a, b: F.xxhash64(a, b)).alias("_3"))
    step = step.select(*names, *counts, F.when(F.size("_3") > F.size(F.array_distinct("_3")), F.sort_array(F.transform("_3", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"))
    equal = neighbours("_s", lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.size(F.array_distinct(F.flatten(F.filter(equal, lambda p: p.isNotNull()))))
    return step.select(*names, *counts, F.when(F.col("_s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"))


def verdicts(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``base_failed``, ``failed_rules`` and ``kept``: the threshold table as one projection."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.array_compact(F.array(*[F.when(~r.holds(), F.lit(r.name)) for r in rules]))
    return measured.select("*", base.alias("base_failed"), F.array_join(failed, ",").alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """Measures and verdict of every row; no shuffle, no user function.

    Null text: no words, so base_failed. Null or repeated ids keep a row each. An empty table
    gives an empty table; other columns play no part.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), (F.col(lang_col) if lang_col else F.lit(None)).alias("_lang"))
    return verdicts(measures(slim, "_text", ["doc_id"], "_lang" if lang_col else None), rules)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", lang_col: str | None = None) -> DataFrame:
    """The rows that pass, with their own columns, whatever those are called.

    The mark keeps the optimizer from moving the filter below the projections, where it would
    repeat every measure once per place that uses it.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"), (F.col(lang_col) if lang_col else F.lit(None)).alias("_lang"))
    judged = verdicts(measures(packed, "_text", ["_row"], "_lang" if lang_col else None), rules).select("_row", "kept", F.monotonically_increasing_id().alias("_mark"))
    return judged.where("kept and _mark >= 0").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, doc_id AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))
), p AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), s AS (
  SELECT r, count(*) AS n_runs, count(*) FILTER (x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)})) AS n_stop_words
  FROM (SELECT r, unnest(regexp_extract_all(lower(t), '{TERM}')) AS x FROM d) GROUP BY r
), m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks,
         CASE WHEN 2 * coalesce(n_runs, 0) >= len(w) THEN coalesce(n_runs, 0) ELSE 0 END::BIGINT AS n_terms,
         coalesce(n_stop_words, 0)::BIGINT AS n_stop_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN l USING (r) LEFT JOIN p USING (r) LEFT JOIN s USING (r)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',',
           CASE WHEN word_chars < 2.0e0 * n_words OR word_chars > 15.0e0 * n_words THEN 'word_length' END,
           CASE WHEN n_symbols > 0.1e0 * n_words THEN 'symbol_ratio' END,
           CASE WHEN n_marks > 0.3e0 * n_words THEN 'mark_ratio' END,
           CASE WHEN n_stop_words < 0.05e0 * n_terms THEN 'stop_words' END,
           CASE WHEN n_dup_lines > 0.5e0 * n_lines THEN 'line_ratio' END) AS failed_rules
  FROM m
)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v
"""
