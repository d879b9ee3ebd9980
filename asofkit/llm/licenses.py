"""Licence scans by sentence rules.

Sentences are normalised and mapped to the identifiers of known licence sentences. The sequence of
identifiers of a text is then matched against licence rules in their order: the first rule that fits
somewhere takes its sentences away, so that the short rules only see what the long ones left.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A grant has one of these before the licence's name, anywhere in its sentence; a further name may follow "or" or "and".
VERB = re.compile(r"\b(?:licensed|released|distributed|available|published|provided|covered)\b")
GRANT = r"(?P<lead>under|by|or|and)\b(?: the)?(?: terms of)?(?: the)?"
# Sentences of the published licence texts and of the usual notices, normalised. They may stand anywhere in a sentence; of two that overlap the first counts.
SENTENCES = [
    ("apache-2-grant", GRANT + r" apache (?:software )?licen[sc]e,?(?: version| v)? ?2(?:\.0)?\b"),
    ("apache-compliance", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-copy", r"you may obtain a copy of the licen[sc]e at"),
    ("apache-as-is", r"unless required by applicable law or agreed to in writing,? software distributed under the licen[sc]e is distributed on an as is basis"),
    ("lgpl-2-1-grant", GRANT + r" gnu (?:lesser|library) general public licen[sc]e,?(?: version| v)? ?2\.1\b"),
    ("lgpl-3-grant", GRANT + r" gnu (?:lesser|library) general public licen[sc]e,?(?: version| v)? ?3(?:\.0)?\b"),
    ("agpl-3-grant", GRANT + r" gnu affero general public licen[sc]e,?(?: version| v)? ?3(?:\.0)?\b"),
    ("gpl-2-grant", GRANT + r" gnu general public licen[sc]e,?(?: version| v)? ?2(?:\.0)?\b"),
    ("gpl-3-grant", GRANT + r" gnu general public licen[sc]e,?(?: version| v)? ?3(?:\.0)?\b"),
    ("gpl-terms", r"redistribute it and/or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2-or-later", r"either version 2 of the licen[sc]e,? or \(?at your option\)? any later version"),
    ("gpl-3-or-later", r"either version 3 of the licen[sc]e,? or \(?at your option\)? any later version"),
    ("gpl-no-warranty", r"this program is distributed in the hope that it will be useful,? but without any warranty"),
    ("mpl-2-grant", GRANT + r" mozilla public licen[sc]e,?(?: version| v)? ?2(?:\.0)?\b"),
    ("mit-grant", GRANT + r" mit(?:/x11)? licen[sc]e\b"),
    ("mit-permission", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc-permission", r"permission to use,? copy,? modify,? and/?(?:or)? distribute this software for any purpose"),
    ("bsd-3-grant", GRANT + r" (?:3-clause bsd|bsd 3-clause|new bsd|modified bsd) licen[sc]e\b"),
    ("bsd-2-grant", GRANT + r" (?:2-clause bsd|bsd 2-clause|simplified bsd) licen[sc]e\b"),
    ("bsd-permission", r"redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"neither the name of\b.* may be used to endorse or promote products"),
    ("as-is", r"(?:the|this) software is provided\b.* as is\b"),
    ("cc-by-nc-4", GRANT + r" (?:cc[ -]by-nc|creative commons attribution-noncommercial)(?: international)?(?: licen[sc]e)? ?4\.0\b"),
    ("cc-by-sa-4", GRANT + r" (?:cc[ -]by-sa|creative commons attribution-sharealike)(?: international)?(?: licen[sc]e)? ?4\.0\b"),
    ("cc-by-4", GRANT + r" (?:cc[ -]by|creative commons attribution)(?: international)?(?: licen[sc]e)? ?4\.0\b"),
    ("cc0", r"(?:cc0|cc zero)\b"),
    ("public-domain", r"(?:dedicated to|released into|in) the public domain\b"),
    ("all-rights", r"all rights reserved\b"),
]
# The order decides; a rule's identifiers have to follow each other among the known sentences.
RULES = [
    ("Apache-2.0", ("apache-2-grant", "apache-compliance", "apache-copy", "apache-as-is")),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl-2-or-later", "gpl-no-warranty")),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl-3-or-later", "gpl-no-warranty")),
    ("MIT", ("mit-permission", "mit-notice", "as-is")),
    ("BSD-3-Clause", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-permission", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-permission", "as-is")),
    ("GPL-2.0-or-later", ("gpl-terms", "gpl-2-or-later")),
    ("GPL-3.0-or-later", ("gpl-terms", "gpl-3-or-later")),
    ("MIT", ("mit-permission", "mit-notice")),
    ("Apache-2.0", ("apache-2-grant",)),
    ("LGPL-2.1", ("lgpl-2-1-grant",)),
    ("LGPL-3.0", ("lgpl-3-grant",)),
    ("AGPL-3.0", ("agpl-3-grant",)),
    ("GPL-2.0", ("gpl-2-grant",)),
    ("GPL-3.0", ("gpl-3-grant",)),
    ("GPL", ("gpl-terms",)),
    ("MPL-2.0", ("mpl-2-grant",)),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-permission",)),
    ("BSD-3-Clause", ("bsd-3-grant",)),
    ("BSD-2-Clause", ("bsd-2-grant",)),
    ("BSD", ("bsd-permission",)),
    ("ISC", ("isc-permission",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC0-1.0", ("cc0",)),
    ("Public-Domain", ("public-domain",)),
    ("All-Rights-Reserved", ("all-rights",)),
]
#: Per identifier the parts of its sentence, with anything between them.
KNOWN = [(name, [re.compile((r"\b" if not k else "") + part) for k, part in enumerate(pattern.split(".*"))]) for name, pattern in SENTENCES]
#: Every sentence above contains one of these.
STEM = re.compile(r"licen|permi|redistribut|version|warranty|copyright|endorse|as.is|\bcc|creative commons|public domain|rights reserved", re.I)
SENTENCE = re.compile(r"[^\n]+?(?:[.!?;](?=\s|$)|(?=\n)|\Z)")
WORD = re.compile(r"[^\s\"'`*#>|%$&“”‘’]+")
#: Where a sentence that goes on over line ends stops: after a full stop (group 1), or at an empty line.
STOP = re.compile(r"(\.)(?=\s|$)|\n\s*\n")
LONG = 2_000


def normalise(sentence: str) -> tuple[str, list[int], list[int]]:
    """Lower case, without quotes and comment marks, one space for white space; where each word begins, here and there."""
    words = [(m.group().lower(), m.start()) for m in WORD.finditer(sentence)]
    here, at = [], 0
    for w, _ in words:
        here.append(at)
        at += len(w) + 1
    return " ".join(w for w, _ in words), here, [start for _, start in words]


def statements(plain: str, parts: list[re.Pattern]) -> Iterator[tuple[int, int, str | None]]:
    """(start, end, lead) of every place where the parts follow each other."""
    first = parts[0].search(plain)
    while first:
        last = first
        for part in parts[1:]:
            last = part.search(plain, last.end())
            if not last:
                return
        yield first.start(), last.end(), first.groupdict().get("lead")
        first = parts[0].search(plain, last.end())


def identified(sentence: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of all statements in a sentence, in order; an identifier that follows itself counts once."""
    plain, here, there = normalise(sentence)
    verb = VERB.search(plain)
    found = []
    for rank, (name, parts) in enumerate(KNOWN):
        for start, end, lead in statements(plain, parts):
            if lead is None or verb and verb.end() <= start:
                found.append((start, end, rank, name, lead in ("or", "and")))
    # The earlier identifier of two that overlap counts; then a name after "or" or "and" needs a statement before it.
    taken: list[tuple] = []
    for x in sorted(found, key=lambda x: (x[2], x[0])):
        k = bisect_left(taken, x)
        if (not k or taken[k - 1][1] <= x[0]) and (k == len(taken) or x[1] <= taken[k][0]):
            taken.insert(k, x)
    kept: list[tuple[str, int, int]] = []
    for start, end, _, name, further in taken:
        if further and not kept or kept and kept[-1][0] == name:
            continue
        first, last = bisect_right(here, start) - 1, bisect_left(here, end) - 1
        kept.append((name, there[first], there[last] + end - here[last]))
    return kept


def known_sentences(text: str) -> list[tuple[str, int, int]]:
    """(identifier, start, end) of the licence sentences of a text. Line ends inside a sentence are tried both ways.

    A sentence with several statements is cut after each but the last. Of sentences over ``LONG`` characters, such
    as lines without punctuation, only the statements themselves are in the spans.
    """
    found, done = [], 0
    stops: list[tuple[int, bool]] | None = None
    for stem in STEM.finditer(text):
        if stem.start() < done:
            continue
        begin = max(done, text.rfind("\n", done, stem.start()) + 1)
        for m in SENTENCE.finditer(text, begin):
            if m.end() <= stem.start():
                continue
            names, end = identified(m.group()), m.end()
            if not names:  # the sentence may go on in the next line, as in notices that are wrapped
                if stops is None:
                    stops = [(s.end() if s[1] else s.start(), bool(s[1])) for s in STOP.finditer(text)]
                k = bisect_right(stops, (m.start(), True))
                if k < len(stops) and stops[k][1] and stops[k][0] > end:
                    end = stops[k][0]
                    names = identified(text[m.start() : end])
            at = m.start() + len(m.group()) - len(m.group().lstrip())
            for k, (name, first, last) in enumerate(names):
                if end - m.start() > LONG:
                    found.append((name, m.start() + first, m.start() + last))
                else:
                    stop = end if k + 1 == len(names) else m.start() + last
                    found.append((name, at, stop))
                    at = stop
            done = end
            break
    return found


def recognised(sentences: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(licence, start, end) by the rules, in text order."""
    left = list(sentences)
    result = []
    for licence, rule in RULES:
        at = 0
        while at + len(rule) <= len(left):
            if tuple(name for name, _, _ in left[at : at + len(rule)]) == rule:
                result.append((licence, left[at][1], left[at + len(rule) - 1][2]))
                del left[at : at + len(rule)]
            else:
                at += 1
    return sorted(result, key=lambda r: (r[1], r[2], r[0]))


RESULT = "doc_id long, n_sentences long, n_licenses long, licenses string, sentence_ids string, spans string"


def scanned(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, numbers, licences (sorted, distinct), sentence identifiers and licence:start:end spans.

    Spans are in code points, end exclusive. A null or empty text has none. One row per input row, repeated or
    not; columns other than doc_id and text are not looked at.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                sentences = known_sentences(text) if text else []
                found = recognised(sentences)
                rows.append(
                    (
                        len(sentences),
                        len(found),
                        ",".join(sorted({f[0] for f in found})),
                        ",".join(s[0] for s in sentences),
                        ",".join(f"{a}:{b}:{c}" for a, b, c in found),
                    )
                )
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = [c.split()[0] for c in RESULT.split(", ")]
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, RESULT)
