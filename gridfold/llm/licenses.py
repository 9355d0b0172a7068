"""Licence scans by sentences: known sentences become identifiers, rules match sequences of identifiers.

A text is normalised (lower case, letters and digits only, single blanks) with marks where lines and
sentences end; a blank line ends a sentence too. A known sentence is one whole line or several whole
lines in a row without a sentence's end between them, so that notices may be wrapped anywhere. A table
of normalised licence sentences, with holes for versions and names, gives each its identifier. Rules are ordered: the first whose identifiers occur in its order, with nothing but
unknown sentences between them, names the licence, takes its sentences, and so on down the list.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridfold.llm.common import let

#: Where a sentence ends: a period, semicolon, colon, question or exclamation mark before a blank; the period of "v. 2.0"
#: and the colon after "identifier" are none.
SENTENCE_END = r"[.;:?!](?=[\x20\x09-\x0D]|$)(?<!\b[vV]\.(?=[\x20\x09-\x0D][0-9]))(?<!identifier:)"
#: A work that a sentence is about, and how it is licensed; parts of the sentences below. Fixed values.
_WORK = r"(this (work|file|program|software|project|code|library|module|package) is )?"
_UNDER = _WORK + r"(released|licensed|distributed|made available|available) under (the terms of )?(the |a |an )?"
#: Normalised sentences by identifier; fixed values, from the licences' public texts. The first that matches counts:
#: a sentence that goes on from another's words comes before it.
SENTENCES = (
    ("ApacheRef", _UNDER + r"apache license (version )?2( 0)?( the license)?"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheComply", r"you may not use this file except in compliance with the license"),
    ("ApacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("ApacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("MitRef", _UNDER + r"(mit|mit x11|x11 mit|expat) license"),
    ("MitStyleRef", r"use of this source code is governed by an mit style license that can be found in the license file.*"),
    ("BoostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    ("NcsaGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction .*"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .*"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind express or implied .*"),
    ("MitLiability", r"in no event shall the authors or copyright holders be liable .*"),
    ("BsdStyleRef", r"use of this source code is governed by a bsd style license that can be found in the license file.*"),
    ("Bsd3Ref", _UNDER + r"(bsd 3 clause|3 clause bsd|new bsd|modified bsd) license"),
    ("Bsd2Ref", _UNDER + r"(bsd 2 clause|2 clause bsd|simplified bsd) license"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BsdSource", r"([0-9]+ )?redistributions of source code must retain the above copyright notice .*"),
    ("BsdBinary", r"([0-9]+ )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("BsdAdvertising", r"([0-9]+ )?all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment.*"),
    ("BsdEndorse", r"([0-9]+ )?neither the name of .* may be used to endorse or promote products .*"),
    ("BsdAsIs", r"this software is provided by the .* as is and any express or implied warranties .*"),
    ("IscGrant", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroBsdGrant", r"permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties with regard to this software .*"),
    ("IscRef", _UNDER + r"isc license"),
    ("ZlibAsIs", r"this software is provided as is without any express or implied warranty"),
    ("ZlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ZlibOrigin", r"([0-9]+ )?the origin of this software must not be misrepresented.*"),
    ("ZlibRef", _UNDER + r"zlib( libpng)? license"),
    ("BoostRef", _UNDER + r"boost software license (version |v)?1 0.*"),
    ("UnlicenseFree", r"this is free and unencumbered software released into the public domain"),
    ("UnlicenseAnyone", r"anyone is free to copy modify publish use compile sell or distribute this software .*"),
    ("AgplRef", _UNDER + r"gnu affero general public license.*"),
    ("LgplRef", _UNDER + r"gnu (lesser|library) general public license.*"),
    ("GplRef3", _UNDER + r"gnu general public license (version |v)?3( 0)?( or later| or any later version)?"),
    ("GplRef2", _UNDER + r"gnu general public license (version |v)?2( 0)?( or later| or any later version)?"),
    ("AgplGrant", r"(this program is free software )?you can redistribute it and or modify it under the terms of the gnu affero general public license .*"),
    ("LgplGrant", r"(this library is free software )?you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license .*"),
    ("GplGrant3", r"(this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GplGrant2", r"(this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GplHead3", r"gnu general public license version 3 29 june 2007"),
    ("GplHead2", r"gnu general public license version 2 june 1991"),
    ("LgplHead3", r"gnu lesser general public license version 3 29 june 2007"),
    ("LgplHead21", r"gnu lesser general public license version 2 1 february 1999"),
    ("AgplHead", r"gnu affero general public license version 3 19 november 2007"),
    ("GplGrantOnly", r"(this program is free software )?you can redistribute it and or modify it under the terms of the gnu general public license version 2( only)? as published by the free software foundation"),
    ("PerlTerms", r"(this is free software )?you can redistribute it and or modify it under the same terms as perl( [0-9] system)?( programming language system)?( itself)?"),
    ("GplNoWarranty", r"this (program|library) is distributed in the hope that it will be useful but without any warranty .*"),
    ("GplSee", r"see the gnu (lesser |library |affero )?general public license for more details"),
    ("GplReceived", r"you should have received a copy of the gnu (lesser |library |affero )?general public license along with this (program|library).*"),
    ("ArtisticHead", r"the artistic license( 2 0)?"),
    ("WtfplHead", r"do what the fuck you want to public license"),
    ("MplHead", r"mozilla public license version 2 0"),
    ("ApacheHead", r"apache license version 2 0 january 2004"),
    ("MplRef", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("MplObtain", r"if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("EplRef2", r"this program and the accompanying materials are made available under the terms of the eclipse public license (v |v|version )?2 0.*"),
    ("EplRef1", r"(all rights reserved )?this program and the accompanying materials are made available under the terms of the eclipse public license (v |v|version )?1 0.*"),
    ("CddlRef", r"the contents of this file are subject to the terms of the common development and distribution license .*"),
    ("EuplRef", r"licensed under the eupl (version |v)?1 [12].*"),
    ("MsPlRef", r"this (source|source code|code) is subject to the microsoft public license.*"),
    ("OflRef", r"this font software is licensed under the sil open font license version 1 1"),
    ("PsfRef", r"licensed to psf under a contributor agreement"),
    ("Cc0Ref", _UNDER + r"(cc0|creative commons zero)( v?1 0)?( universal)?( license)?"),
    ("Cc0Waiver", r"to the extent possible under law .* waived all copyright and related or neighboring rights to .*"),
    ("CcByNcSaRef", _UNDER + r"(cc by nc sa|creative commons attribution non ?commercial share ?alike)( [0-9] 0)?( international)?( license)?"),
    ("CcByNcNdRef", _UNDER + r"(cc by nc nd|creative commons attribution non ?commercial no ?derivatives)( [0-9] 0)?( international)?( license)?"),
    ("CcByNcRef", _UNDER + r"(cc by nc|creative commons attribution non ?commercial)( [0-9] 0)?( international)?( license)?"),
    ("CcBySaRef", _UNDER + r"(cc by sa|creative commons attribution share ?alike)( [0-9] 0)?( international)?( license)?"),
    ("CcByNdRef", _UNDER + r"(cc by nd|creative commons attribution no ?derivatives)( [0-9] 0)?( international)?( license)?"),
    ("CcByRef", _UNDER + r"(cc by|creative commons attribution)( [0-9] 0)?( international)?( license)?"),
    ("PublicDomain", r"this (work|file|program|software|code) is (hereby )?((released|placed) into|placed in|in) the public domain"),
    ("CopyrightLine", r"copyright (c )?[0-9]{4}.*"),
    ("AllRights", r"all rights reserved"),
)
#: Licence names that a line "SPDX-License-Identifier: ..." may give, alone, with -only, -or-later or +, or joined by OR, AND and WITH. Fixed values.
SPDX_NAMES = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0",
    "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "PSF-2.0", "Unlicense", "WTFPL", "X11", "Zlib",
)
SPDX_LINE = "spdx license identifier"
#: Normalised names with the identifiers of their sentences.
SPDX = {re.sub(r"[^a-z0-9]+", " ", name.lower()): f"Spdx-{name}" for name in SPDX_NAMES}


def _holes(pattern: str) -> str:
    """A sentence's pattern over a marked text: each blank may be a line's end, and a hole at the end ends with its line."""
    return re.sub(r"\.\*$", r"[^\n|]*", pattern).replace(".*", "[^|]*?").replace(" ", r"[ \n]")


_PLAIN = [p for _, p in (*SENTENCES, ("", SPDX_LINE + " .*")) if not p.startswith(_UNDER)]
_NAMED = [p.removeprefix(_UNDER) for _, p in SENTENCES if p.startswith(_UNDER)]
#: Any known sentence in a marked text. Those that begin alike share that part; their order among themselves is kept.
KNOWN = "(?<![a-z0-9 ])(?:" + "|".join([*map(_holes, _PLAIN), _holes(_UNDER) + "(?:" + "|".join(map(_holes, _NAMED)) + ")"]) + ")(?![a-z0-9 ])"
#: Ordered rules: a licence and its sequence of identifiers; longer ones come before their parts. Fixed values.
RULES = (
    ("Apache-2.0", ("ApacheRef", "ApacheComply", "ApacheObtain", "ApacheAsIs", "ApacheSee")),
    ("Apache-2.0", ("ApacheRef", "ApacheComply", "ApacheObtain", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheComply", "ApacheObtain", "ApacheAsIs")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs", "MitLiability")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitRef", "MitGrant")),
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvertising", "BsdEndorse")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("0BSD", ("ZeroBsdGrant", "IscAsIs")),
    ("Zlib", ("ZlibAsIs", "ZlibGrant", "ZlibOrigin")),
    ("Zlib", ("ZlibGrant", "ZlibOrigin")),
    ("Unlicense", ("UnlicenseFree", "UnlicenseAnyone")),
    ("AGPL-3.0", ("AgplGrant", "GplNoWarranty", "GplSee", "GplReceived")),
    ("LGPL", ("LgplGrant", "GplNoWarranty", "GplSee", "GplReceived")),
    ("GPL-3.0", ("GplGrant3", "GplNoWarranty", "GplSee", "GplReceived")),
    ("GPL-2.0", ("GplGrant2", "GplNoWarranty", "GplSee", "GplReceived")),
    ("AGPL-3.0", ("AgplGrant", "GplNoWarranty")),
    ("LGPL", ("LgplGrant", "GplNoWarranty")),
    ("GPL-3.0", ("GplGrant3", "GplNoWarranty")),
    ("GPL-2.0", ("GplGrant2", "GplNoWarranty")),
    ("GPL-2.0", ("GplGrantOnly", "GplNoWarranty")),
    ("MPL-2.0", ("MplRef", "MplObtain")),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitStyleRef",)),
    ("NCSA", ("NcsaGrant",)),
    ("MIT", ("MitGrant",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("BSL-1.0", ("BoostRef",)),
    ("BSD", ("BsdStyleRef",)),
    ("BSD-3-Clause", ("Bsd3Ref",)),
    ("BSD-2-Clause", ("Bsd2Ref",)),
    ("ISC", ("IscGrant",)),
    ("ISC", ("IscRef",)),
    ("0BSD", ("ZeroBsdGrant",)),
    ("Zlib", ("ZlibRef",)),
    ("Unlicense", ("UnlicenseFree",)),
    ("AGPL-3.0", ("AgplRef",)),
    ("AGPL-3.0", ("AgplGrant",)),
    ("GPL-3.0", ("GplRef3",)),
    ("GPL-2.0", ("GplRef2",)),
    ("GPL-3.0", ("GplGrant3",)),
    ("GPL-2.0", ("GplGrant2",)),
    ("GPL-3.0", ("GplHead3",)),
    ("GPL-2.0", ("GplHead2",)),
    ("LGPL", ("LgplHead3",)),
    ("LGPL", ("LgplHead21",)),
    ("AGPL-3.0", ("AgplHead",)),
    ("Artistic", ("ArtisticHead",)),
    ("WTFPL", ("WtfplHead",)),
    ("MPL-2.0", ("MplHead",)),
    ("Apache-2.0", ("ApacheHead",)),
    ("GPL-2.0", ("GplGrantOnly",)),
    ("LGPL", ("LgplRef",)),
    ("LGPL", ("LgplGrant",)),
    ("Artistic", ("PerlTerms",)),
    ("MPL-2.0", ("MplRef",)),
    ("EPL-2.0", ("EplRef2",)),
    ("EPL-1.0", ("EplRef1",)),
    ("CDDL", ("CddlRef",)),
    ("EUPL", ("EuplRef",)),
    ("MS-PL", ("MsPlRef",)),
    ("OFL-1.1", ("OflRef",)),
    ("PSF-2.0", ("PsfRef",)),
    ("CC0-1.0", ("Cc0Ref",)),
    ("CC0-1.0", ("Cc0Waiver",)),
    ("CC-BY-NC-SA", ("CcByNcSaRef",)),
    ("CC-BY-NC-ND", ("CcByNcNdRef",)),
    ("CC-BY-NC", ("CcByNcRef",)),
    ("CC-BY-SA", ("CcBySaRef",)),
    ("CC-BY-ND", ("CcByNdRef",)),
    ("CC-BY", ("CcByRef",)),
    ("Public-Domain", ("PublicDomain",)),
    *((name, (f"Spdx-{name}",)) for name in SPDX_NAMES),
    ("All-Rights-Reserved", ("CopyrightLine", "AllRights")),
    ("All-Rights-Reserved", ("AllRights",)),
)


def marked(text: Column) -> Column:
    """Lower-case words with single blanks between them, \\n between lines and | between sentences."""
    ends = F.regexp_replace(F.lower(text), SENTENCE_END, "\n\n")
    lines = F.regexp_replace(F.regexp_replace(ends, r"[^a-z0-9\n]+", " "), r" ?\n ?", "\n")
    return F.btrim(F.regexp_replace(lines, r"\n{2,}", "|"))


def identifier(sentence: Column) -> Column:
    """Of a normalised sentence: the first of the table whose pattern it is as a whole; null where it is none that is known."""
    table = F.array(*(F.struct(F.lit(f"^({p})$").alias("pattern"), F.lit(name).alias("name")) for name, p in SENTENCES))
    return F.get(F.filter(table, lambda row: F.call_function("regexp_like", sentence, row["pattern"])), F.lit(0))["name"]


def expression(line: Column) -> Column:
    """The identifiers of the known licences that a normalised line with an SPDX expression names; exceptions and unknown names give none."""
    parts = F.split(F.substring(line, F.lit(len(SPDX_LINE) + 2), F.length(line)), " (?:or(?! later)|and|with) ")
    table = F.map_from_arrays(F.array(*map(F.lit, SPDX)), F.array(*map(F.lit, SPDX.values())))
    named = F.transform(parts, lambda p: F.try_element_at(table, F.regexp_replace(p, " (only|or later)$", "")))
    return F.filter(named, lambda name: name.isNotNull())


def identifiers(text: Column) -> Column:
    """The known sentences of a text, in order; an SPDX expression gives one for each licence in it."""
    found = F.transform(F.regexp_extract_all(marked(text), F.lit(KNOWN), F.lit(0)), lambda s: F.translate(s, "\n", " "))
    of = lambda s: F.when(F.startswith(s, F.lit(SPDX_LINE)), expression(s)).otherwise(F.array(identifier(s)))
    return let(found, lambda all_of: F.flatten(F.transform(all_of, of)))


def licences(found: Column) -> Column:
    """Licences of a sequence of identifiers: rules in their order, each as often as it matches what is left."""
    rules = F.array(*(F.struct(F.lit("".join(f"|{i}|" for i in sequence)).alias("part"), F.lit(name).alias("name")) for name, sequence in RULES))
    blank = F.struct(F.concat(F.lit("|"), F.array_join(found, "||"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        # A mark stays where a match was, so that its neighbours don't become a sequence.
        taken = F.struct(F.replace(acc["left"], rule["part"], F.lit("/")).alias("left"), F.array_append(acc["names"], rule["name"]).alias("names"))
        return F.when(F.call_function("instr", acc["left"], rule["part"]) > 0, taken).otherwise(acc)

    scanned = F.aggregate(rules, blank, step, lambda acc: F.array_distinct(acc["names"]))
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(scanned)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, sentences, licences): identifiers of known sentences in order, and licence names in order of the rules.

    One row for each row of `df`. A null or empty text has neither. Rows are independent of each
    other; columns other than the two aren't read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    found = df.select(F.col(f"`{id_col}`").alias("doc"), identifiers(text).alias("sentences"))
    return found.withColumn("licences", licences(F.col("sentences")))
