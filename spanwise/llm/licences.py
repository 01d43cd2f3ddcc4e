"""Operator 4: known licence texts by the digest of a canonical form. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .sized import maybe_broadcast

DIGEST_BYTES = 16 << 20

_PERMIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Licence texts and one-line notices, by SPDX identifier. A caller may add a whole licence list.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", f"MIT License\n{_PERMIT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_WARRANTY}"),
    ("MIT", f"{_PERMIT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_WARRANTY}"),
    ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n{_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_GRANT}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD_WARRANTY}"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0-only", "Licensed under the GPL v3."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
)
#: Spellings that count as one, after lower-casing; a subset of those in public matching guidelines.
EQUIVALENT = (
    (r"licence", "license"), (r"sub[ -]license", "sublicense"), (r"non[ -]commercial", "noncommercial"),
    (r"non[ -]infringement", "noninfringement"), (r"holder", "owner"), (r"https", "http"),
    (r"acknowledgement", "acknowledgment"), (r"organisation", "organization"), (r"per cent", "percent"),
)
_EQUIVALENT_ANY = "|".join(p for p, _ in EQUIVALENT)
#: After the word "copyright" at the start of a line, these go on with a sentence; anything else names an owner.
PROSE = r"(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|infringements?|protections?|claims?|acts?|disclaimers?|and|or|in|is|of|to|for)\b"
#: Characters of a known text's beginning by which runs of lines are found.
HEAD = 24


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, words only; line breaks are kept."""
    out = F.lower(text)
    out = F.when(F.contains(out, F.lit("(c)")) | F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("©")), F.regexp_replace(out, r"(?md)^[^a-z0-9\n]*(copyright[ \t:]++(?!" + PROSE + r")|\(c\)|©|all rights reserved)[^\n]*$", "")).otherwise(out)
    spelled = out
    for pattern, one in EQUIVALENT:
        spelled = F.regexp_replace(spelled, pattern, one)
    out = F.when(out.rlike(_EQUIVALENT_ANY), spelled).otherwise(out)
    out = F.regexp_replace(F.replace(out, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\n]+", " ")
    return F.regexp_replace(out, r" ?\n ?", "\n")


def _flat(canon: Column) -> Column:
    return F.trim(F.regexp_replace(canon, r"\s+", " "))


def known_digests(known: DataFrame) -> DataFrame:
    """``license_id, text`` -> ``license_id, digest, n``; texts that become equal are one digest each."""
    flat = _flat(canonical(F.col("text")))
    return known.where("text is not null and license_id is not null").select("license_id", F.sha2(flat, 256).alias("digest"), F.length(flat).alias("n")).where("n > 0").distinct()


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence texts found as a whole document, a paragraph, a line or a run of lines.

    A run is two or more lines with words, not all of the document's; so a licence above a program is found,
    whatever comment marks and line breaks it has. A run is looked up where a line begins like a known text
    (its first 24 characters, or all of a shorter line) and a line ends after just as many characters. The list of
    beginnings and lengths comes to the driver; it grows with ``known`` alone.

    Returns one row per document, licence and unit: ``doc_id, license_id, unit, n_found``.
    Each unit's canonical form is hashed whole and looked up among the digests of ``known``
    (``license_id, text``; ours if none is given). A unit whose canonical length no known
    text has is not hashed: it cannot match.

    Null or empty text: no row. Rows that share an id are one document. Empty tables give an
    empty table; other columns play no part.
    """
    spark = docs.sparkSession
    if known is None:
        known = spark.createDataFrame(list(KNOWN), "license_id string, text string")
    keep = Scratch(spark, "licences")
    digests = keep.save(known_digests(known), "digests")
    sizes = [r["n"] for r in digests.select("n").distinct().collect()] if digests.select("n").distinct().count() <= 10_000 else None
    one = docs.select(F.col(id_col).alias("doc_id"), canonical(F.col(text_col).cast("string")).alias("_c")).where("_c is not null")
    flat = _flat(canonical(F.col("text")))
    heads = known.where("text is not null and license_id is not null").select(flat.alias("x")).select("x", F.explode(F.sequence(F.lit(1), F.lit(HEAD))).alias("k"))
    heads = [r[0] for r in heads.where(f"x <> '' and (k = {HEAD} or substring(x, k + 1, 1) = ' ')").select(F.expr("substring(x, 1, k)")).distinct().collect()]
    most = digests.agg(F.max("n")).first()[0] or 0
    lengths = F.array(*[F.lit(n) for n in sorted(sizes)]).cast("array<int>") if sizes is not None else F.sequence(F.lit(1), F.lit(most))
    one = one.select("doc_id", F.split("_c", "\n").alias("_l"), F.split("_c", "\n{2,}").alias("_p"), _flat(F.col("_c")).alias("_t"), F.filter(F.transform(F.split("_c", "\n"), lambda w: F.trim(w)), lambda w: w != "").alias("_w"))
    begins = F.filter(F.transform("_w", lambda w, i: F.when(F.substring(w, 1, HEAD).isin(heads), i)), lambda i: i.isNotNull()) if heads else F.array().cast("array<int>")

    def runs_from(i):
        """All runs from line ``i`` on that have a known length; a text of n characters has n / 2 lines at most."""
        rest = F.array_join(F.slice("_w", i + 1, F.lit(most // 2 + 2)), "\n")
        ends = lambda n: (F.length(F.get("_w", i)) < n) & (F.length(rest) >= n) & F.substring(rest, n + 1, F.lit(1)).isin("", "\n") & ~((i == 0) & (F.length("_t") == n))
        return F.transform(F.filter(lengths, ends), lambda n: F.struct(F.lit("run").alias("unit"), F.replace(F.substring(rest, F.lit(1), n), F.lit("\n"), F.lit(" ")).alias("x")))

    units = one.select(
        "doc_id",
        F.explode(
            F.concat(
                F.array(F.struct(F.lit("text").alias("unit"), F.col("_t").alias("x"))),
                F.when(F.size("_p") > 1, F.transform("_p", lambda p: F.struct(F.lit("paragraph").alias("unit"), _flat(p).alias("x")))).otherwise(F.array().cast("array<struct<unit:string,x:string>>")),
                F.transform("_l", lambda p: F.struct(F.lit("line").alias("unit"), F.trim(p).alias("x"))),
                F.flatten(F.transform(begins, runs_from)),
            )
        ).alias("u"),
    ).select("doc_id", "u.unit", "u.x")
    if sizes is not None:
        units = units.where(F.length("x").isin(sizes) if sizes else F.lit(False))
    found = units.select("doc_id", "unit", F.sha2("x", 256).alias("digest")).join(maybe_broadcast(digests.select("license_id", "digest"), DIGEST_BYTES), "digest")
    return found.groupBy("doc_id", "license_id", "unit").agg(F.count("*").alias("n_found"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(text: str) -> str:
    # lines that go on with a sentence are marked, those that name an owner go, the mark goes
    out = f"regexp_replace(lower({text}), '(?m)^([^a-z0-9\\n]*)copyright([ \\t:]+{PROSE})', '\\1qxcopyright\\2', 'g')"
    out = f"regexp_replace({out}, '(?m)^[^a-z0-9\\n]*(copyright[ \\t:]|\\(c\\)|©|all rights reserved)[^\\n]*$', '', 'g')"
    out = f"replace({out}, 'qxcopyright', 'copyright')"
    for pattern, one in EQUIVALENT:
        out = f"regexp_replace({out}, '{pattern}', '{one}', 'g')"
    out = f"regexp_replace(replace({out}, '&', ' and '), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g')"
    return f"regexp_replace({out}, ' ?\\n ?', chr(10), 'g')"


def _sql_flat(text: str) -> str:
    return f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"


ORACLE = f"""
WITH known(license_id, text) AS (VALUES {", ".join("('" + i + "', '" + t.replace("'", "''") + "')" for i, t in KNOWN)}
), k AS (
  SELECT DISTINCT license_id, {_sql_flat(_sql_canonical("text"))} AS flat, sha256(flat) AS digest FROM known
), d AS (
  SELECT doc_id, {_sql_canonical("text")} AS c FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, 'text' AS unit, {_sql_flat("c")} AS x FROM d
  UNION ALL SELECT doc_id, 'line', trim(unnest(string_split(c, chr(10)))) FROM d
  UNION ALL SELECT doc_id, 'paragraph', {_sql_flat("p")} FROM (SELECT doc_id, unnest(regexp_split_to_array(c, '\\n{{2,}}')) AS p FROM d WHERE regexp_matches(c, '\\n{{2,}}'))
), f AS (
  SELECT doc_id, license_id, flat, length(flat) AS n, all_n, regexp_extract_all(c, '[^ \\n][^\\n]*') AS w
  FROM (SELECT doc_id, c, {_sql_flat("c")} AS x, length(x) AS all_n FROM d) JOIN k ON contains(x, flat)
), g AS (
  SELECT *, rtrim(array_to_string(list_slice(w, i, len(w)), chr(10))) AS rest FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f)
)
SELECT doc_id, license_id, unit, count(*) AS n_found FROM u JOIN k ON digest = sha256(x) WHERE x <> '' GROUP BY ALL
UNION ALL
SELECT doc_id, license_id, 'run', count(*) FROM g
WHERE replace(left(rest, n), chr(10), ' ') = flat AND substr(rest, n + 1, 1) IN ('', chr(10)) AND length(rtrim(w[i])) < n AND NOT (i = 1 AND n = all_n)
GROUP BY ALL
"""
