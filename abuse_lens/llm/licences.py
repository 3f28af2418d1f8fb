"""Licence recognition by known sentences and ordered rules (operator 5).

A text is cut into sentences, each is normalised and looked up among known
licence sentences; the identifiers found, in order and without what stands
between them, are matched against ordered rules.  An earlier rule is tried
first and what it has matched is used up, so that a licence made of several
sentences is never also reported as one of its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abuse_lens.llm.common import let

# Well-known sentences of public licences, as their texts have them, and what each is called here.
SENTENCES = {
    "mit-name": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-released": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "apache-header": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "Released under the Apache License, Version 2.0.",
    ],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at"],
    "gpl3-named": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
    ],
    "gpl-free": ["This program is free software:", "This program is free software;"],
    "gpl3-redistribute": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl2-redistribute": [
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    ],
    "gpl2-version": ["either version 2 of the License, or (at your option) any later version."],
    "bsd-redistribution": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: (licence, sentence identifiers in order); earlier rules first.
RULES = [
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-redistribute"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-redistribute", "gpl2-version"]),
    ("Apache-2.0", ["apache-header", "apache-comply", "apache-copy"]),
    ("Apache-2.0", ["apache-header", "apache-comply"]),
    ("Apache-2.0", ["apache-header"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-name", "mit-grant", "mit-notice"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-released"]),
    ("MIT", ["mit-name"]),
    ("GPL-3.0-only", ["gpl3-named"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense"]),
    ("CC-BY-SA-4.0", ["cc-by-sa"]),
    ("CC-BY-NC-4.0", ["cc-by-nc"]),
    ("CC-BY-4.0", ["cc-by"]),
    ("CC0-1.0", ["cc0"]),
]
#: Normalised sentences with a free name in them, and the known sentence that each is read as.
FORMS = [
    (
        "^neither the names? of .+ nor the names of (its|their) contributors may be used",
        "neither the name of the copyright holder nor the names of its contributors may be used",
    ),
]
#: A sentence ends at one of these before white space, but not behind a name such as "Example Inc." in a form above.
SENTENCE_END = r"([.!?;:])\s++(?!(?i:nor\s+the\s+names\s+of\b))"


def normalise(sentence: Column) -> Column:
    """Lower case; every run of other than letters and digits is one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def _identifier(piece: Column, known: Column) -> Column:
    """The identifier of a known sentence, else null."""
    plain = normalise(piece)
    for form, sentence in FORMS:
        plain = F.regexp_replace(plain, form, sentence)
    return F.element_at(known, plain)


def _identifiers(text: Column, known: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence runs over the lines of its paragraph.  If it is not known, each of
    its lines is looked up on its own, where it stands.
    """
    ended = F.regexp_replace(F.translate(text, "\u0001", " "), r"\n[ \t\r]*\n\s*", "\u0001")  # an empty line ends a sentence
    pieces = F.split(F.regexp_replace(ended, SENTENCE_END, "$1\u0001"), "\u0001")
    none = F.array().cast("array<string>")

    def read(piece: Column) -> Column:
        lines = F.filter(F.transform(F.split(piece, r"\n"), lambda s: _identifier(s, known)), lambda i: i.isNotNull())
        alone = F.when(F.contains(piece, F.lit("\n")), lines).otherwise(none)
        return let(_identifier(piece, known), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(alone))

    return F.flatten(F.transform(pieces, read))


def _match(ids: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """Licences of the rules that fit, in rule order, each as often as it fits."""
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f",{',,'.join(s)},").alias("run")) for n, s in rules])
    line = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    none = F.array().cast("array<string>")

    def step(state: Column, rule: Column) -> Column:
        rest = F.replace(state["line"], rule["run"], F.lit("|"))
        gone = F.length(state["line"]) - F.length(rest)
        times = (gone / (F.length(rule["run"]) - 1)).cast("int")
        found = F.concat(state["found"], F.array_repeat(rule["name"], times))
        return F.struct(rest.alias("line"), found.alias("found"))

    matched = F.aggregate(table, F.struct(line.alias("line"), none.alias("found")), step, lambda s: s["found"])
    return F.when(F.size(ids) > 0, matched).otherwise(none)


def scan(
    docs: DataFrame,
    sentences: dict[str, list[str]] = SENTENCES,
    rules: list[tuple[str, list[str]]] = RULES,
) -> DataFrame:
    """doc_id, sentence_ids and licences (both arrays of strings) for every row.

    A sentence may stand on a line of its own or run over several lines; both are
    recognised in the same text.  Null and empty texts have empty arrays.  The sentence table is a literal and so
    should have at most some hundred entries; ``scan`` raises above 2000.
    """
    table = {_plain(s): name for name, group in sentences.items() for s in group}
    if len(table) > 2000:
        raise ValueError("the sentence table is a literal of at most 2000 entries")
    text = F.coalesce(F.col("text"), F.lit(""))
    # words without which no known sentence can be: texts with none of them need no cutting
    words = sorted({min(s.split(), key=lambda w: (-len(w), w)) for s in table})
    may = F.lower(text).rlike("|".join(words))
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    ids = F.when(may, _identifiers(text, known)).otherwise(F.array().cast("array<string>"))
    return docs.select("doc_id", ids.alias("sentence_ids")).select(
        "doc_id", "sentence_ids", _match(F.col("sentence_ids"), rules).alias("licences")
    )


def _plain(sentence: str) -> str:
    """``normalise`` for the table's own sentences."""
    return " ".join("".join(c if c.isalpha() or c.isnumeric() else " " for c in sentence.lower()).split())
