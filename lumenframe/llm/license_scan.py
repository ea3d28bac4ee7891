"""License scans: canonical digest lookup. Case, punctuation, copyright lines and equivalent spellings are normalised, and
the digests of entire texts are hash-joined with those of known licences.

Entire texts are whole documents, their paragraphs of several lines, and their single lines, of the latter two those that
speak of a licence. The known table has a few hundred rows, so the join needs no shuffle. Only DataFrame functions are used.

Cases: a null or empty text, and one that normalises to nothing, matches nothing; rows with equal doc_id count together; a
null doc_id is kept as one document; very long texts are taken whole; extra columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Known licences: identifier and entire text, or the notice that applies it (fixed values).
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Licensed under the WTFPL, version 2."),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
]

#: Equivalent spellings, as whole words (fixed values).
SPELLINGS = [
    ("licenced", "licensed"),
    ("licences?", "license"),
    ("licenses", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("noncommercial", "non commercial"),
    ("sharealike", "share alike"),
    ("v", "version"),
    ("https?", "http"),
]

#: Words of which every known text has one (fixed values).
CLUE = "(?i)licen[cs]e|permission|public domain|wtfpl|spdx"
#: A line that only states whose the text is (fixed values).
COPYRIGHT = r"^[\s#*/;%-]*(?:copyright|©|\(c\)|all rights reserved)"
#: The same for canonical(): running text that a line break puts first ("copyright notice", a list's "(c) you must") stays.
STATEMENT = r"^[\s#*/;%-]*(?:copyright(?!\s+(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|interests?|rights?|treaty|permission|disclaimers?|status|on|in|and|or|is|as|to|for|resulting|claimed)\b)|©|\(c\)(?!\s*(?:you|if|the|a|an|to|in|on|for|from|of|this|that|any|all|with|it|do|does|no|use|under|convey|accompany|each|every|must)\b)|all rights reserved)"
#: CLUE, with what the canonical form joins or splits, and the word of the BSD texts.
HINT = r"(?i)licen[cs]e|permission|public[^\p{L}\p{N}]+domain|wtfpl|spdx|redistribution"
#: Title lines that stand before the full texts of KNOWN.
TITLES = {"MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"], "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"]}
#: SHA-256 of canonical full texts: whole, without the title, and without the appendix after the terms; the BSD texts
#: with numbers, bullets and both usual names of the holder.
FULL = [
    ("Apache-2.0", "0daf10cced888d30afa80cd46c4201e8e0fbfdd2453e648843f4880d77e6f1fc"),
    ("Apache-2.0", "750f45954512b8517fda5aa6cc5835c0173317d988bbf59d6e6e6ad090d29b9e"),
    ("Apache-2.0", "850e2753b51d64381e95bb2b20b3f6788f7411ae36654ac1047652730e399b56"),
    ("Apache-2.0", "a443eb52c3b2c8d77ae2b33106781aac955f384d3a47e3dc81400e3232e254c7"),
    ("Apache-2.0", "bae93cfb800f05c4280b38f22bcd9c6f975981ba82549436c0f42d19c6b47e73"),
    ("Apache-2.0", "d7b1876ed154692821ffad72dad1f48b9e8030818615b9cda7442a21facd0e9f"),
    ("BSD-2-Clause", "117fa84a7ffb2cb3a2ba7d18dd284e7283b034d6fb6c6419721ee4e28b5306fe"),
    ("BSD-2-Clause", "1e519f8916dca74c89371617f4339d40a4ed3bb71e801c14aa72e8071bafaf81"),
    ("BSD-2-Clause", "239190ee903aca2851ccd5099cd7954d026d60f9b9f98e391ca652499c6aaae1"),
    ("BSD-2-Clause", "23d7258e25bd67982ccec4b5bfc05631a20f8ee5bd5fe7eb70694c100aae88d2"),
    ("BSD-2-Clause", "33903615089fdb3ab02696d1bd92eb9580c2c7a0e0c8714aa95b0dfc1dcdb89c"),
    ("BSD-2-Clause", "447686a56472ea2e9713ca89034ee666e6646bd1a33eba38690cb875708663e2"),
    ("BSD-2-Clause", "5151319f99abfc15f9a1aab05c799faf3b0e5715fac5a5812b9d3566ae984374"),
    ("BSD-2-Clause", "6a5d49c15e02e9e94957d78177d86e8631be9a19549a7cfd2e8c3be2699f00b9"),
    ("BSD-2-Clause", "7be8178e4e9d0dea6ff4b04bd52bd086d7ea8386a5a6e09760df916bae5d42d2"),
    ("BSD-2-Clause", "85c46767b6234227cebe127f5c22b9ede02ee48dda5f148ccefe8432c4d93221"),
    ("BSD-2-Clause", "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74"),
    ("BSD-2-Clause", "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30"),
    ("BSD-2-Clause", "b02d799e391838a73a0ccc75692ba88eafccab18abbd5f907e855d22048655d4"),
    ("BSD-2-Clause", "e90608a663ae638023eb95a6ae359f7b6b865e6237fa832c48500c4e1af035b9"),
    ("BSD-2-Clause", "f660a20fd170fe8b6282213c3411227a553f1451ee95bd49ed6ca3abe7045314"),
    ("BSD-2-Clause", "f9c0de945db946a0b06e8587a80b1b35b3f3e48a0f63cb64860eb4e433d32c7b"),
    ("BSD-3-Clause", "0fbd7c43c4bb3e398d262b8e39f58ee0a8709a2b3b6b4bee4e033b3d5755f58d"),
    ("BSD-3-Clause", "1b9c2fc92ea32d1c705d689163d6e1783efd910af0262514c4185cad11fefe75"),
    ("BSD-3-Clause", "2197427e156dd704210ae726a3807f7deae35bc31d7243168c575348f6a5419b"),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651"),
    ("BSD-3-Clause", "326c317935b3409d9750fd4ad5326ce15c9b75d313b4baf2cb9ff54accf8d903"),
    ("BSD-3-Clause", "4079d1a9108ca437dd29ac26e1f73dbf7bb3b61ba3392438373db7018cf188c3"),
    ("BSD-3-Clause", "4241a91ed59fdc8d1c20d065984925429610744add02cce3becf94e4e83c49f9"),
    ("BSD-3-Clause", "52c8e1f1387429e4ac2e46a159e2b2d17320de20b05dce03cbd7a7cf9be73702"),
    ("BSD-3-Clause", "53075742228962c7ea381b8242c64602fa32e7b8f52facb6d13ee4f9c596ddfa"),
    ("BSD-3-Clause", "69fcedb70fd1930cb5d773bb71eb605a3aec6362c678302194666d60ca468f71"),
    ("BSD-3-Clause", "73a15ef51d0f74bce7fc4d1287b8d8a639c37581de7f63863957aea115dca7da"),
    ("BSD-3-Clause", "76b173bb2a6492f7941f15493bc75af0a3afc02b9cde5cdc0cad10b180455932"),
    ("BSD-3-Clause", "85a253fdca75357d8f16143d242204d0c291650df54bf470a94c229f0d848c65"),
    ("BSD-3-Clause", "8ba6133c391f099f3936e999218e881ea570d37c2b504821ed3199d4b5421c47"),
    ("BSD-3-Clause", "8ec96ac102a1a4e8a51586c5069c7bbf5b233cd4fd6c2e01ef2e376f9fbace63"),
    ("BSD-3-Clause", "94a0a44b170114affb7b3975c6987906dca819b6cbd93510aa70be57345a1e3f"),
    ("BSD-3-Clause", "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2"),
    ("BSD-3-Clause", "b6ab7953b6c80a72261014244324a70663f1807fa212f52461b24c95eb16b4a9"),
    ("BSD-3-Clause", "cc3432eb2f19bb6fe96706bad75b6fce1039db64fb70486899bf6425dea4d9cb"),
    ("BSD-3-Clause", "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15"),
    ("BSD-3-Clause", "d0a339eb5454123c6a1f2696aace557e0561866f3fe33b93ffad58ecfcab7060"),
    ("BSD-3-Clause", "e0a2092139c370f402284efaf452317f36b6cf859e5aadc058eb21b6e63bebeb"),
    ("BSD-3-Clause", "e612af111b0f62aac3e107973cd804ade8a118ba3c7034d6824ebdce9852ba2e"),
    ("BSD-3-Clause", "f94931e221f919e6cec5ca99e0ea7da1912b2c7d805cdaee8baf508c248bc1af"),
    ("CC0-1.0", "0c3e4ca5ed7ced6289d3f5d9a83e4100f9f34d87983b17dc5865376a8a0a98f3"),
    ("CC0-1.0", "2962ebabf2783b8e79876e1dbed7cb6d6e1ade5b084c1ab58461e3609a5cfab6"),
    ("GPL-2.0", "48936df8cabd5a1d8357c891cedc9f01fc84d84d5873cd736e895c9e0f4af1e7"),
    ("GPL-2.0", "98666243cf5b8aeb52a6c7d24fb59712151a50e18ac08935685237bd5cbdeb04"),
    ("GPL-2.0", "a54553829cc70a1752ae3dae3fc8f947a29c59b4f095defcfbe8ce9c8cb85dde"),
    ("GPL-2.0", "b02df54e72b0458e07f05be436272c222b9225a56c1999f4c51752c33951896b"),
    ("GPL-2.0", "f406309918612b407799ee8bdc9862893b25675c0f42ac6a005146cff3cd19e0"),
    ("GPL-2.0", "fbb75c474a9ed7380acb22da3dc29fe7051a2f38bcd3c84408018344575b679d"),
    ("GPL-3.0", "00706f48d640d51649675355fce176d685d3d094b62a21c97007fe0f81f6812e"),
    ("GPL-3.0", "469d73e3074705f568679106f8fea8bc080dcb78961d59b7ec0fd457be0d7557"),
    ("GPL-3.0", "65bb95ae62841d945f665ec3fb2e5704fcec1f755d1827a47f229b0e1ab966e8"),
    ("GPL-3.0", "687e35485959cebb78afc97d0ef9a10ec32b345e3f8cd24afd5093c5b6d41741"),
    ("GPL-3.0", "7161964522d38f93d9368ab8af4f4ad876ed1affd40797f800c3efecddf84086"),
    ("GPL-3.0", "e5d450eee65b3b7088759b9fb7814766e5632dd585291dec480b67de137965dd"),
    ("LGPL-2.1", "04bcb395bfa0054ab892ebb580f1c233a32e58143cf3a3879c7fd0c94c7952c0"),
    ("LGPL-2.1", "aa7216ccfcc6856829a09e09cf44a8a6c6595c5eb94a40b77195d2469a1aa09c"),
    ("LGPL-2.1", "b85498f3b41b6948a50c8db616f6116f21ce73824b4d50289305fe02249eddcb"),
    ("LGPL-2.1", "db8b3ad959c128a6aaa45a05e6d802c4d4026ea007f6dd35d14476834a85c290"),
    ("LGPL-2.1", "df2b17d97599dc627f1d7f649aef5b3db520e84c81879797ea4f81bcd00d3cce"),
    ("LGPL-2.1", "fdb6dab91314ba445afed09d727b3ae444cc0e4f93b867b13e9285744676e331"),
    ("LGPL-3.0", "3c109b32fc12cedb18f514c338498353cbbafbc7ad3aa3aed8c864396943f25a"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-2.0", "2212c5e23b2989b1ba6109f4c895a27fa3962785973f6ec2725352888a04ce10"),
    ("MPL-2.0", "24b0b26ac9ffcc04a78b1b09bbace50677735ab5cb608e878845d60d6cb325b5"),
    ("MPL-2.0", "8ca1b1720c61cc2bde63df3d5a1634c1448cbbef99d787813997dc877dab603d"),
    ("MPL-2.0", "b839637772c7e90d3706cc729c774502420ea09441d63e6e083477f88a8ce95a"),
]


#: What may follow a statement of ownership on its line and is kept.
NOTICE = r"[.;,]\s+([^.;]*(?:licen[cs]|spdx|permission|public domain)[\s\S]*)$"
#: Between paragraphs.
BLANK = r"\n[ \t\r\n]*\n"
#: What lines begin and end with that says nothing; a paragraph has two lines with something on them if, stripped of this at
#: its ends, it still has a line feed.
SPACE = " \t\r\n"
MOST_BROADCAST = 100_000


def canonical(line: Column) -> Column:
    """Lower case, words only, one space between them, one spelling. Of a line that states whose the text is, only a notice
    behind that is kept."""
    out = F.lower(line)
    out = F.regexp_replace(F.when(out.rlike(STATEMENT), F.regexp_extract(out, NOTICE, 1)).otherwise(out), r"[^\p{L}\p{N}]+", " ")
    for a, b in SPELLINGS:
        out = F.regexp_replace(out, rf"\b{a}\b", b)
    return F.trim(out)


def known(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license, digest of each known text, once each."""
    titled = [(name, f"{title} {text}") for name, text in KNOWN if len(text) > 400 for title in TITLES.get(name, [])]
    rows = spark.createDataFrame(texts or KNOWN + titled, "license string, text string")
    rows = rows.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest"))
    return (rows if texts else rows.union(spark.createDataFrame(FULL, "license string, digest string"))).distinct()


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """docs: doc_id, text; texts: other known licences than KNOWN and FULL, each with a word of HINT. Returns doc_id, license,
    scope (`document`, `paragraph` or `line`), n_matches."""
    if without := [name for name, text in texts or [] if not re.search(HINT.replace(r"\p{L}\p{N}", r"\w"), text)]:
        raise ValueError(f"texts without a word that lines are looked at for: {without}")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(HINT))
    joined = lambda text: F.trim(F.array_join(F.filter(F.transform(F.split(text, "\n"), canonical), lambda x: x != ""), " "))
    single = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(HINT)), canonical)
    parts = F.transform(F.filter(F.split("text", BLANK), lambda x: F.btrim(x, F.lit(SPACE)).contains("\n") & x.rlike(HINT)), joined)
    unit = lambda scope: lambda x: F.struct(F.lit(scope).alias("scope"), x.alias("t"))
    units = F.concat(F.array(unit("document")(joined(F.col("text")))), F.when(F.col("text").rlike(BLANK), F.transform(parts, unit("paragraph"))).otherwise(F.array().cast("array<struct<scope: string, t: string>>")), F.transform(single, unit("line")))
    found = some.select("doc_id", F.explode_outer(units).alias("u")).where(F.col("u.t") != "")
    table = known(docs.sparkSession, texts)
    table = F.broadcast(table) if len(texts or []) <= MOST_BROADCAST else table
    found = found.select("doc_id", "u.scope", F.sha2("u.t", 256).alias("digest")).join(table, "digest")
    return found.groupBy("doc_id", "license", "scope").agg(F.count("*").alias("n_matches"))
