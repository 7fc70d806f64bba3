"""License scans: canonical digests of entire texts, joined to those of known licences.

Canonical form, in this order: A-Z lower-cased; copyright lines dropped (a
line that begins with a copyright mark or word and names a year, or reserves
all rights); what is no letter or digit becomes one blank; equivalent
spellings become one; blanks at the ends go. The digest is its SHA-256.

The same is done for every line of a text, which finds licence notices in
longer documents: the line as a whole must be a known text. Lines that cannot
be one (no word of any, and shorter than every known licence) are passed over.

Known are the licences of KNOWN, by their texts or titles and texts, and those
of PUBLISHED, by digests of the texts that Debian's base-files gives, with and
without what follows their terms. Other wordings, such as older addresses of a
foundation inside the text, are other digests; ``scan`` takes any table.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import keyed_text, map_slices, stash

#: Known digests up to which every worker gets them to look lines up; more are joined to the lines.
NOTICES_LIMIT = 50_000
#: Characters of a text beyond which it is a licence, not a notice, and may have a title.
LEAST_TITLED = 400
#: Marks outside ASCII that count as punctuation. Fixed values.
MARKS = "“”„‘’‚«»‹›–—…•·©®™ "
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:copyright[^\n]*(?:\(c\)|©|[0-9]{4}|yyyy|<year>)|\(c\) ?[0-9]{4}|© ?[0-9]{4})[^\n]*$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
PUNCTUATION = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
#: Spellings that count as the same. Fixed values, after the public licence-matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright owner": "copyright holder", "copyright owners": "copyright holders",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment",
    "https": "http", "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor",
    "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling",
    "non commercial": "noncommercial", "non infringement": "noninfringement", "offence": "offense", "optimise": "optimize", "organisation": "organization",
    "organise": "organize", "per cent": "percent", "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub licence": "sublicense", "sub license": "sublicense", "sublicence": "sublicense", "utilisation": "utilization",
    "whilst": "while", "wilful": "willful",
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_START = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_END = (
    "\n" + _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: Titles that may stand before the text of a licence. Fixed values.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "MIT-0": ("MIT No Attribution",), "ISC": ("ISC License", "The ISC License"), "0BSD": ("Zero-Clause BSD", "BSD Zero Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License"), "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License"), "Zlib": ("zlib License", "The zlib License"), "Unlicense": ("The Unlicense",),
}
#: Licences that an SPDX line may name. Fixed values.
SPDX = (
    "MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause Apache-2.0 GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later "
    "AGPL-3.0-only AGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-2.0 Artistic-1.0-Perl GFDL-1.2-only GFDL-1.3-only Unlicense BSL-1.0 Zlib CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0"
).split()
#: (licence, text) of public licences and of the notices that name one. Fixed values.
KNOWN = (
    ("MIT", _MIT_START + ", subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software." + _MIT_END),
    ("MIT-0", _MIT_START + "." + _MIT_END),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n"
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
        "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n"
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n"
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n"
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n" + _AS_IS + " "
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
        "For more information, please refer to <http://unlicense.org/>",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    (
        "BSD-3-Clause",
        _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n" + _BSD_END,
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n"
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    *((x, f"SPDX-License-Identifier: {x}") for x in SPDX),
)
#: (licence, digest, characters of the canonical form) of published texts, whole and without what follows their terms. Fixed values.
PUBLISHED = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543", 9886),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f", 8842),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40", 8870),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702", 5833),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", 1361),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e", 6691),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60", 19583),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826", 22018),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765),
    ("GPL-1.0-only", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", 9387),
    ("GPL-1.0-only", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", 9415),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117),
    ("GPL-2.0-only", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", 14455),
    ("GPL-2.0-only", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", 14483),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", 33406),
    ("GPL-3.0-only", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191", 30940),
    ("GPL-3.0-only", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636", 30968),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908", 24130),
    ("LGPL-2.0-only", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2", 22249),
    ("LGPL-2.0-only", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260", 22277),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", 25217),
    ("LGPL-2.1-only", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df", 23337),
    ("LGPL-2.1-only", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4", 23365),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be", 7104),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6", 22447),
    ("MPL-1.1", "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87", 21012),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a", 14341),
    ("MPL-2.0", "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de", 13661),
)
_marks = str.maketrans(dict.fromkeys(MARKS, " "))
_copyright = re.compile(COPYRIGHT)
#: What is no letter or digit of ASCII becomes a blank; bytes beyond ASCII stay.
_blanks = bytes(k if k > 127 or chr(k).isalnum() else 32 for k in range(256))
_words = {a.encode(): b.encode() for a, b in SPELLINGS.items() if " " not in a}
_pairs = {a.encode(): b.encode() for a, b in SPELLINGS.items() if " " in a}
_pair = re.compile(rb"(?<![^ ])(?:" + b"|".join(sorted(_pairs, key=len, reverse=True)) + rb")(?![^ ])")


def _canonical(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only
    if b"copyright" in data or b"(c)" in data or b"all rights" in data or "©".encode() in data:
        data = _copyright.sub("", data.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")
    if not data.isascii():
        data = data.decode("utf-8", "surrogatepass").translate(_marks).encode("utf-8", "surrogatepass")
    words = data.translate(_blanks).split()
    joined = b" ".join(words)
    if any(a in joined for a in _pairs):
        words = _pair.sub(lambda m: _pairs[m[0]], joined).split()
    return b" ".join([_words.get(w, w) for w in words])


def canonical(text: str) -> str:
    """The canonical form of a text."""
    return _canonical(text).decode("utf-8", "surrogatepass")


def digest(text: str) -> str:
    """SHA-256 of the canonical form, in hex."""
    return hashlib.sha256(_canonical(text)).hexdigest()


def known_digests(known: tuple[tuple[str, str], ...] = KNOWN) -> dict[str, str]:
    """Digest to licence of the texts, of titles and texts, and of PUBLISHED; of one digest the least licence."""
    titled = [(i, f"{title}\n{t}") for i, t in known for title in TITLES.get(i, ()) if len(t) > LEAST_TITLED]
    rows = [(i, digest(t)) for i, t in [*known, *titled]] + [(i, d) for i, d, _ in PUBLISHED]
    return {d: i for i, d in sorted(rows, reverse=True)}


def _words_to_look_for() -> re.Pattern:
    """A pattern that every line finds, in lower case, that is one of KNOWN as a whole: of each its longest word that no spelling rule makes."""
    made = {w for x in SPELLINGS.values() for w in x.split()}
    words = {max((w for w in canonical(t).split() if w not in made), key=len) for _, t in KNOWN}
    return re.compile("|".join(sorted(map(re.escape, words))))


_look_for = _words_to_look_for()
#: Characters of the shortest line that may be one of PUBLISHED; spelling rules add a few to a text.
_least_published = min(n for *_, n in PUBLISHED) * 9 // 10


def _may_be_known(line: str) -> bool:
    return len(line) >= _least_published or bool(_look_for.search(line.lower()))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, digest, license_id, notices), one per input row.

    license_id: the licence that the entire text is, or null. notices: the
    licences that whole lines name, sorted and joined by commas, or null.
    known: (digest, license_id), ``known_digests`` by default; a digest that
    stands for several licences names the least. A null text counts as empty;
    repeated rows and null ids are kept; extra columns are left out; an empty
    table gives no rows. One pass over the texts; their digests are joined,
    and copies of one text are one key of a join that may be split. Beyond
    NOTICES_LIMIT known digests the lines' digests are joined, too.
    """
    spark, own = docs.sparkSession, known is None
    if own:
        known = spark.createDataFrame(sorted(known_digests().items()), "digest string, license_id string")
    known = known.filter("digest is not null and license_id is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))
    few = own or known.count() <= NOTICES_LIMIT
    names = {r.digest: r.license_id for r in known.collect()} if few else {}
    keyed = keyed_text(docs, doc_id, text)
    id_type = keyed.schema["doc_id"].dataType.simpleString()

    def digests_of_lines(t: str) -> set[str]:
        if own and not _look_for.search(t.lower()) and len(t) < _least_published:
            return set()
        return {digest(line) for line in set(t.split("\n")) if not own or _may_be_known(line)}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        whole = pa.array([digest(t) for t in texts], pa.string())
        if few:
            notices = pa.array([",".join(sorted({names[d] for d in digests_of_lines(t) if d in names})) or None for t in texts], pa.string())
            return pa.RecordBatch.from_arrays([batch.column(0), whole, notices], ["doc_id", "digest", "notices"])
        marks = pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary())
        lines = pa.array([sorted(digests_of_lines(t)) for t in texts], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([batch.column(0), whole, marks, lines], ["doc_id", "digest", "mark", "lines"])

    if few:
        marked = map_slices(keyed, run, f"doc_id {id_type}, digest string, notices string")
        return marked.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license_id", "notices")
    marked = stash(map_slices(keyed, run, f"doc_id {id_type}, digest string, mark binary, lines array<string>"), "lines")
    lines = marked.select("mark", F.explode("lines").alias("digest")).distinct()
    notices = lines.join(known, "digest").groupBy("mark").agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    return marked.drop("lines").join(notices, "mark", "left").join(known, "digest", "left").select("doc_id", "digest", "license_id", "notices")


def _sql_canonical(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = f"regexp_replace({out}, {quote(COPYRIGHT)}, '', 'g')"
    out = f"translate({out}, {quote(MARKS)}, {quote(' ' * len(MARKS))})"
    out = f"' ' || trim(regexp_replace({out}, {quote(PUNCTUATION)}, ' ', 'g'), ' ') || ' '"
    for a, b in SPELLINGS.items():
        out = f"regexp_replace({out}, ' {a} ', ' {b} ', 'g')"
    return f"trim({out}, ' ')"


def oracle() -> str:
    """The scan of ``documents`` in DuckDB SQL."""
    values = ", ".join(f"('{d}', '{i}')" for d, i in sorted(known_digests().items()))
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
     whole AS (SELECT doc_id, sha256({_sql_canonical("coalesce(text, '')")}) AS digest FROM documents),
     lines AS (SELECT DISTINCT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
     notes AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
               FROM (SELECT doc_id, sha256({_sql_canonical('line')}) AS digest FROM lines) JOIN known USING (digest) GROUP BY doc_id)
SELECT doc_id, digest, license_id, notices FROM whole LEFT JOIN known USING (digest) LEFT JOIN notes USING (doc_id)"""
