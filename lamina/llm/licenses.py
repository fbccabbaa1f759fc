"""Licence scans by sentence rules, in DataFrame operations alone.

A text is cut into sentences, each normalised sentence is looked up among known licence sentences, and the
identifiers that come up, in text order, are matched against ordered rules: the longest rules first, each
taking the identifiers that it matches out of the sequence. Known are the headers, the short texts and the opening
sentences of long texts of common licences; other sentences of long texts have no identifier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, settled, table

# Normalised sentences of public licence texts and their identifiers.
SENTENCES = {
    "MIT-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "MIT-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MIT-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "MIT-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "MIT-ref": "released under the mit license",
    "MIT-ref2": "licensed under the mit license",
    "BSD-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BSD-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BSD-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "BSD-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-asis": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "BSD-liability": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "ISC-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "Apache-ref": "licensed under the apache license version 2.0",
    "Apache-head": "licensed under the apache license version 2.0 the license",
    "Apache-first": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "Apache-comply": "you may not use this file except in compliance with the license",
    "Apache-at": "you may obtain a copy of the license at",
    "Apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
    "Apache-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "Apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "GPL-useful": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "LGPL-useful": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GNU-verbatim": "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "Apache-title": "apache license version 2.0 january 2004 http www.apache.org licenses",
    "Apache-terms": "terms and conditions for use reproduction and distribution",
    "MPL-title": "mozilla public license version 2.0",
    "MPL-subject": "this source code form is subject to the terms of the mozilla public license v 2.0",
    "MPL-obtain": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
    "MPL-obtain-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0",
    "MPL-ref": "licensed under the mozilla public license version 2.0",
    "Zlib-asis": "this software is provided as-is without any express or implied warranty",
    "Zlib-held": "in no event will the authors be held liable for any damages arising from the use of this software",
    "Zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "Zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "Zlib-product": "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    "Zlib-altered": "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    "Zlib-notice": "this notice may not be removed or altered from any source distribution",
    "Zlib-ref": "licensed under the zlib license",
    "Zlib-ref2": "released under the zlib license",
    "CC0-dedicate": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "CC0-waive": "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work",
    "CC0-warranty": "this software is distributed without any warranty",
    "CC0-title": "cc0 1.0 universal",
    "EPL-1-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0 which accompanies this distribution and is available at http www.eclipse.org legal epl-v10.html",
    "EPL-2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl-2.0",
    "EPL-1-ref": "licensed under the eclipse public license version 1.0",
    "EPL-2-ref": "licensed under the eclipse public license version 2.0",
    "BSL-title": "boost software license version 1.0 august 17th 2003",
    "BSL-title2": "boost software license version 1.0",
    "BSL-ref": "distributed under the boost software license version 1.0",
    "BSL-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following",
    "BSL-notices": "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor",
    "WTFPL-title": "do what the fuck you want to public license",
    "WTFPL-verbatim": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "WTFPL-terms": "do what the fuck you want to public license terms and conditions for copying distribution and modification",
    "WTFPL-do": "you just do what the fuck you want to",
    "ISC-asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "ISC-liability": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "0BSD-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "ISC-ref": "licensed under the isc license",
    "BSD-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "Unlicense-grant": "this is free and unencumbered software released into the public domain",
    "Unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
    "PD-ref": "this work is in the public domain",
    "PD-ref2": "this file is in the public domain",
    "Reserved": "all rights reserved",
}

# SPDX identifiers of common licences, as tags name them.
SPDX = """0BSD AFL-3.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0
CC0-1.0 CDDL-1.0 CDDL-1.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 ISC MIT MIT-0 MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL
NCSA ODbL-1.0 OFL-1.1 OpenSSL PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()

# The families below differ by version or clause alone.
GNU = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
CREATIVE = {"by": "attribution", "by-sa": "attribution-sharealike", "by-nc": "attribution-noncommercial", "by-nd": "attribution-noderivatives", "by-nc-sa": "attribution-noncommercial-sharealike", "by-nc-nd": "attribution-noncommercial-noderivatives"}


#: What stands between sentences of a lower-case text: a full stop (but after v, for version), a colon at the end of a line, a line without letters or
#: digits; copyright lines say who, not what, and part sentences too.
BOUNDARY = r"(?m)(?<!\bv)[.!?]+(?=\s|$)\s*|:[ \t]*(?=\n)|\n[\s*#/;%-]*\n|^[^\na-z]*copyright (?:\(c\)|©|\d{4})[^\n]*(?:\n|$)"
#: A tag and its expression.
TAG = r"(?i)SPDX-License-Identifier:[ \t]*(\(*[a-z0-9.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[a-z0-9.+-]+\)*)*)"


def sentences() -> dict[str, str]:
    """Normalised sentence: identifier."""
    out = {s: i for i, s in SENTENCES.items()}
    for name, full in GNU.items():
        for v in ("2", "2.1", "3"):
            for work in ("this work is licensed under", "this program is licensed under", "this software is licensed under", "licensed under", "released under"):
                out[f"{work} the {full} version {v}"] = f"{name}-{v}-ref"
            free = f"you can redistribute it and or modify it under the terms of the {full} as published by the free software foundation either version {v} of the license or at your option any later version"
            for work in ("this program", "this library", "this file", "this software"):
                out[f"{work} is free software {free}"] = f"{name}-{v}-later"
        for month in ("june 1991", "february 1999", "29 june 2007", "19 november 2007"):
            for v in ("2", "2.1", "3"):
                out[f"{full} version {v} {month}"] = f"{name}-{v}-title"
        out[f"see the {full} for more details"] = f"{name}-see"
        for work in ("program", "library", "software", "file"):
            for where in ("", " if not see http www.gnu.org licenses", " if not see https www.gnu.org licenses"):
                out[f"you should have received a copy of the {full} along with this {work}{where}"] = f"{name}-received"
    for where in ("http", "https"):
        out[f"if not see {where} www.gnu.org licenses"] = "GNU-address"
    for clause, full in CREATIVE.items():
        for v in ("3.0", "4.0"):
            for work in ("licensed under", "this work is licensed under", "released under"):
                out[f"{work} cc {clause} {v}"] = f"CC-{clause}-{v}-ref"
            out[f"this work is licensed under a creative commons {full} {v} international license"] = f"CC-{clause}-{v}-ref"
    for scheme in ("http", "https"):
        for ending in ("", ".txt", ".html"):
            copy = f"{SENTENCES['Apache-at']} {scheme} www.apache.org licenses license-2.0{ending}"
            out[copy] = "Apache-copy"
            out[f"{copy} {SENTENCES['Apache-asis']}"] = "Apache-copy-asis"  # no empty line between them
    return out


def rules() -> list[tuple[str, list[str]]]:
    """(licence, identifiers in order): longer ones are tried first, of equal length the one that stands first here."""
    bsd = ["BSD-grant", "BSD-source", "BSD-binary"]
    ends = (["BSD-asis", "BSD-liability"], ["BSD-asis"], [])
    out = [("BSD-4-Clause", [*bsd, "BSD-advertising", "BSD-names", *e]) for e in ends]
    out += [("BSD-3-Clause", [*bsd, "BSD-names", *e]) for e in ends] + [("BSD-2-Clause", [*bsd, *e]) for e in ends]
    mit = ["MIT-grant", "MIT-notice", "MIT-asis", "MIT-liability"]
    out += [("MIT", mit[:n]) for n in (4, 3, 2)]
    zlib = ["Zlib-asis", "Zlib-held", "Zlib-grant", "Zlib-origin", "Zlib-product", "Zlib-altered", "Zlib-notice"]
    out += [("Zlib", zlib), ("Zlib", zlib[:3]), ("Zlib", zlib[2:]), ("Zlib", zlib[2:3])]
    out += [("ISC", ["ISC-grant", "ISC-asis", "ISC-liability"]), ("ISC", ["ISC-grant"]), ("0BSD", ["0BSD-grant", "ISC-asis", "ISC-liability"])]
    out += [("BSL-1.0", [*t, "BSL-grant", "BSL-notices", *e]) for t in (["BSL-title"], ["BSL-title2"], []) for e in (["MIT-asis"], [])]
    out += [("WTFPL", ["WTFPL-title", "WTFPL-verbatim", "WTFPL-terms", "WTFPL-do"]), ("WTFPL", ["WTFPL-verbatim", "WTFPL-terms"])]
    out += [("Unlicense", ["Unlicense-grant", "Unlicense-anyone"]), ("CC0-1.0", ["CC0-dedicate", "CC0-warranty"])]
    out += [("Apache-2.0", ["Apache-title", "Apache-terms"])]
    for obtain in ("MPL-obtain", "MPL-obtain-s"):
        out += [("MPL-2.0", ["MPL-subject", obtain])]
    alone = "Apache-2.0 Apache-ref, Apache-2.0 Apache-head, MIT MIT-ref, MIT MIT-ref2, MPL-2.0 MPL-subject, MPL-2.0 MPL-ref, MPL-2.0 MPL-title, Zlib Zlib-ref, Zlib Zlib-ref2, CC0-1.0 CC0-dedicate, CC0-1.0 CC0-waive, CC0-1.0 CC0-title, EPL-1.0 EPL-1-terms, EPL-2.0 EPL-2-terms, EPL-1.0 EPL-1-ref, EPL-2.0 EPL-2-ref, BSL-1.0 BSL-ref, BSL-1.0 BSL-grant, WTFPL WTFPL-title, WTFPL WTFPL-do, ISC ISC-ref, Unlicense Unlicense-grant, Public-domain PD-ref, Public-domain PD-ref2"
    out += [(licence, [i]) for licence, i in (x.split(" ") for x in alone.split(", "))]
    for first in (["Apache-head", "Apache-comply"], ["Apache-first"]):
        for copy in (["Apache-at", "Apache-asis"], ["Apache-copy", "Apache-asis"], ["Apache-copy-asis"]):
            out += [("Apache-2.0", [*first, *copy, "Apache-see"]), ("Apache-2.0", [*first, *copy])]
        out += [("Apache-2.0", [*first, "Apache-at"]), ("Apache-2.0", [*first, "Apache-copy"]), ("Apache-2.0", first)]
    for name in GNU:
        for v in ("2", "2.1", "3"):
            spdx = f"{name}-{v if '.' in v else v + '.0'}"
            later, see, got = f"{name}-{v}-later", f"{name}-see", f"{name}-received"
            for useful in ("GPL-useful", "LGPL-useful"):
                out += [(f"{spdx}-or-later", [later, useful, see, got, "GNU-address"]), (f"{spdx}-or-later", [later, useful, see, got]), (f"{spdx}-or-later", [later, useful, see])]
            out += [(f"{spdx}-or-later", [later]), (f"{spdx}-only", [f"{name}-{v}-ref"]), (spdx, [f"{name}-{v}-title", "GNU-verbatim"]), (spdx, [f"{name}-{v}-title"])]
    for clause in CREATIVE:
        out += [(f"CC-{clause.upper()}-{v}", [f"CC-{clause}-{v}-ref"]) for v in ("3.0", "4.0")]
    return sorted(out, key=lambda r: -len(r[1]))


def spdx_names() -> dict[str, str]:
    """Lower-case identifier in a tag: its canonical form."""
    out = {n.lower(): n for n in SPDX}
    for name in GNU:
        for v in ("2.0", "2.1", "3.0"):
            out |= {f"{name}-{v}".lower(): f"{name}-{v}-only", f"{name}-{v}+".lower(): f"{name}-{v}-or-later"}
            out |= {f"{name}-{v}-{w}".lower(): f"{name}-{v}-{w}" for w in ("only", "or-later")}
    for clause in CREATIVE:
        out |= {f"cc-{clause}-{v}": f"CC-{clause.upper()}-{v}" for v in ("3.0", "4.0")}
    return out


def _tagged(text: Column) -> Column:
    """Array of the licences that tags in a text name: the operands of AND and OR, an exception with its licence."""
    names = F.create_map(*[F.lit(x) for pair in spdx_names().items() for x in pair])
    terms = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TAG), F.lit(1)), lambda e: F.split(F.regexp_replace(e, r"[()]", " "), r"(?i)\s+(?:and|or)\s+")))

    def canonical(term: Column) -> Column:
        parts = F.split(F.trim(term), r"(?i)\s+with\s+")
        licence = F.coalesce(F.element_at(names, F.lower(parts[0])), parts[0])
        return F.when(F.size(parts) > 1, F.concat_ws(" WITH ", licence, F.get(parts, F.lit(1)))).otherwise(licence)

    found = F.filter(F.transform(terms, canonical), lambda x: x != "")
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), found).otherwise(F.array().cast("array<string>"))


def _normal(sentence: Column) -> Column:
    """Words of a lower-case sentence, one space between them, without punctuation around them."""
    words = F.regexp_replace(sentence, r"[^\p{L}\p{N}.+-]+", " ")
    return F.trim(F.regexp_replace(words, r"(?<![\p{L}\p{N}])[.+-]+ ?|[.-]+(?![\p{L}\p{N}])", ""))


def _matched(known: Column) -> Column:
    """Of identifiers in order, each between commas: struct of what no rule took (cut into runs by ;) and the licences found."""
    table = F.array(*[F.struct(F.lit("".join(f",{i}," for i in wanted)).alias("ids"), F.lit(licence).alias("licence")) for licence, wanted in rules()])
    start = F.struct(known.alias("left"), F.array().cast("array<string>").alias("found"))
    # what a rule took leaves a mark, so that its neighbours don't become adjacent
    take = lambda acc, r: F.when(F.instr(acc["left"], r["ids"]) > 0, F.struct(F.replace(acc["left"], r["ids"], F.lit(";")).alias("left"), F.array_append(acc["found"], r["licence"]).alias("found"))).otherwise(acc)
    return F.when(known == "", start).otherwise(F.aggregate(table, start, take))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, sentence_ids array (in text order), licenses array (sorted, distinct), unmatched array.

    Sentences end as BOUNDARY says, whatever their length; in a sentence over several lines each line counts too, but
    not for the rules where the sentence is known as a whole. Rules match identifiers that follow one another, unknown
    sentences between them left out; the longest rules first, of equal length the first in rules(). A rule takes all
    places where it matches, and what a rule took parts its neighbours. SPDX tags have the identifier SPDX-tag, match
    no rule and name their licences themselves, in canonical form where it is known, else as they are written.
    unmatched: identifiers that no rule took, but tags. Null and empty texts have none of all; repeated rows give a
    row each; an empty table gives an empty result. Only id and text are read.
    """
    docs = settled(docs.select(id_col, text_col))
    spark = docs.sparkSession
    known = spark.createDataFrame([(s, i) for s, i in sentences().items()], "s string, known string")  # of fixed size
    plain = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.split(F.lower(plain), BOUNDARY)
    base = docs.select(row_of(docs).alias("row"), F.col(id_col).alias("doc_id"), _tagged(plain).alias("tags"), F.concat(F.array(F.lit(None).cast("string")), parts).alias("parts"))
    each = base.select("row", "doc_id", "tags", F.posexplode("parts").alias("i", "part"))
    lines = F.when(F.instr("part", "\n") > 0, F.concat(F.array("part"), F.split("part", "\n"))).otherwise(F.array("part"))
    each = each.select("row", "doc_id", F.when(F.col("i") == 0, F.col("tags")).alias("tags"), "i", F.posexplode(lines).alias("j", "s"))
    each = each.withColumn("s", F.when(F.col("i") > 0, _normal(F.col("s"))))
    each = each.join(F.broadcast(known), "s", "left")
    each = each.withColumn("known", F.coalesce("known", F.when(F.startswith("s", F.lit("spdx-license-identifier")), F.lit("SPDX-tag"))))
    each = each.where("known IS NOT NULL OR i = 0")
    seq = each.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("known").isNotNull(), F.struct("i", "j", "known")))).alias("seq"), F.flatten(F.collect_list("tags")).alias("tags"))
    wholes = F.transform(F.filter("seq", lambda x: x["j"] == 0), lambda x: x["i"])
    counted = F.transform(F.filter("seq", lambda x: (x["j"] == 0) | ~F.array_contains("wholes", x["i"])), lambda x: F.when(x["known"] == "SPDX-tag", F.lit(";")).otherwise(F.concat(F.lit(","), x["known"], F.lit(","))))
    ids = seq.withColumn("wholes", wholes).select("doc_id", "tags", F.transform("seq", lambda x: x["known"]).alias("sentence_ids"), F.concat_ws("", counted).alias("known"))
    ids = ids.withColumn("m", _matched(F.col("known")))
    left = F.filter(F.split(F.col("m.left"), "[,;]"), lambda x: x != "")
    return ids.select(F.col("doc_id").alias(id_col), "sentence_ids", F.array_sort(F.array_distinct(F.concat("m.found", "tags"))).alias("licenses"), left.alias("unmatched"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"))
