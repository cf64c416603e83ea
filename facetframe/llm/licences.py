"""Licence scan by canonical digests of entire texts."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .common import small

# Spellings that count as equal in licence texts, and what they are replaced by.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"),
             ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"),
             ("behaviour", "behavior"), ("favour", "favor"), ("fulfil", "fulfill"), ("honour", "honor"),
             ("labelled", "labeled"), ("merchantibility", "merchantability"), ("modelled", "modeled"),
             ("organisation", "organization"), ("recognised", "recognized"), ("utilise", "utilize"),
             ("whilst", "while"), ("wilful", "willful"), ("https", "http"))

_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""

# Public licence texts and the notices that stand for them.
KNOWN = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
            "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software.\n\n" + _WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _AUTHOR),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted.\n\n" + _AUTHOR),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at\n\n"
                   "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                   "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
                   "language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
)
#: Entire public texts, one file for each licence; read by the driver.
TEXTS = Path(__file__).resolve().parent / "licence_texts"
# Title lines that stand above texts which are also used without one.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}
_APPENDIX = "END OF TERMS AND CONDITIONS"
#: A line that names a holder and a year: dropped before texts are compared.
COPYRIGHT = r"^[^\p{L}\p{N}]*(copyright[^\p{L}\p{N}]*(\(c\)|©|[0-9]{4})|\(c\)[^\p{L}\p{N}]*[0-9]{4}|©)"
APART = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """Lines in lower case without punctuation, copyright lines and variants of spelling; words one blank apart."""
    lines = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: ~x.rlike(COPYRIGHT))
    wide = F.concat(F.lit("  "), F.replace(F.regexp_replace(F.array_join(lines, "\n"), APART, "  "), F.lit("\n"), F.lit("  \n  ")), F.lit("  "))
    spelled = wide
    for variant, usual in SPELLINGS:
        spelled = F.replace(spelled, F.lit(f" {variant} "), F.lit(f" {usual} "))
    any_variant = "(" + "|".join(v for v, _ in SPELLINGS) + ")"
    return F.transform(F.split(F.when(wide.rlike(any_variant), spelled).otherwise(wide), "\n", -1),
                       lambda x: F.trim(F.regexp_replace(x, " +", " ")))


def units(lines: Column) -> Column:
    """What is compared as an entire text: all of it, each block between empty lines, each line."""
    blocks = F.transform(F.split(F.array_join(lines, "\n"), "\n\n+", -1), lambda b: F.trim(F.replace(b, F.lit("\n"), F.lit(" "))))
    return F.filter(F.array_distinct(F.concat(F.array(whole(lines)), blocks, lines)), lambda u: u != "")


def whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def _forms(licence: str, text: str) -> list[str]:
    """A text as it is also written: without its title or the appendix on its use, clauses unnumbered, owner for holder."""
    forms = [text]
    if licence.startswith("BSD"):
        forms += [f.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR") for f in forms]
        forms += [re.sub(r"(?m)^[1-3]\. ", "* ", f) for f in forms]
    if _APPENDIX in text:
        terms = text.split(_APPENDIX)[0]
        forms += [terms, terms + _APPENDIX, re.sub(r"(?m)^.*Copyright \[yyyy\].*$", "", text)]     # a name filled in goes, too
    if licence not in TITLES:
        rest = [f.lstrip().split("\n\n", 1)[1] for f in forms]
        return forms + rest
    # the second line of a copyright notice, which texts of two lines have
    forms += ["All rights reserved.\n\n" + f for f in forms]
    return forms + [f"{title}\n\n{f}" for title in TITLES[licence] for f in forms]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): KNOWN, and the entire texts of TEXTS and of KNOWN, in all their forms."""
    entire = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    entire += [(licence, text) for licence, text in KNOWN if licence in TITLES and "\n\n" in text]
    return [*KNOWN, *((licence, form) for licence, text in entire for form in _forms(licence, text))]


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, digest) of entire known texts."""
    known = known_texts() if known is None else known
    texts = spark.createDataFrame(list(known), "licence string, text string")
    return texts.select("licence", F.md5(whole(canonical_lines(F.col("text")))).alias("digest")).distinct()


def scan_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licence, n_units, entire): the known texts that a document is or holds as a block or line.

    ``known`` is a table (licence, digest), see ``known_digests``; ``entire`` tells that the whole document is
    one. Null and empty texts hold nothing. Rows that repeat an id are taken together.
    """
    known = small(cut_lineage(known if known is not None else known_digests(docs.sparkSession)))
    lines = docs.select(col(id_col).alias("doc_id"), canonical_lines(col(text)).alias("lines"))
    digests = lines.select("doc_id", F.md5(whole(F.col("lines"))).alias("__whole"),
                           F.transform(units(F.col("lines")), lambda u: F.md5(u)).alias("__units"))
    each = digests.select("doc_id", "__whole", F.explode_outer("__units").alias("digest"))
    return each.join(known, "digest").groupBy("doc_id", "licence").agg(
        F.count_distinct("digest").cast("long").alias("n_units"), F.max(F.col("digest") == F.col("__whole")).alias("entire"))
