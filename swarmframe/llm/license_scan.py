"""Licence scan: fuzzy short-notice search.

Every notice is split by the pigeonhole rule into one more exact seeds than it
may hold errors, so each occurrence within the bound contains a seed unchanged.
An Aho-Corasick automaton finds all seeds of all notices in one pass over the
text; the regex library's bounded-error matching then verifies a window around
each seed and reports span and edits.

Defined results: a null text counts as empty and gives zero words and no match;
repeated rows give one result each; columns other than the id and text are not
read. The whole text is searched whatever its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import arrow_schema, map_batches, slices, table

#: Each byte of UTF-8 text after lower-casing A-Z: digits, letters and all of non-ASCII stay, the rest parts words.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)


@dataclass(frozen=True)
class Notice:
    """A phrase of words with at most ``errors`` edits, followed by words that must stand exactly."""

    label: str
    phrase: str
    errors: int
    exact: str = ""


#: Phrases whose exact places are counted, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

NOTICES = (
    Notice("mit", "under the mit license", 2),
    Notice("apache-2", "apache license version", 2, "2"),
    Notice("cc-by-nc", "", 0, "cc by nc"),
    Notice("cc-by-sa", "", 0, "cc by sa"),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("gpl-3", "gnu general public license version", 3, "3"),
    Notice("gpl-2", "gnu general public license version", 3, "2"),
    Notice("lgpl", "gnu lesser general public license", 2),
    Notice("agpl", "gnu affero general public license", 2),
    Notice("mpl-2", "mozilla public license version", 2, "2"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 5),
    Notice("bsd", "redistribution and use in source and binary forms", 4),
    Notice("unlicense", "free and unencumbered software released into the public domain", 4),
    Notice("isc", "permission to use copy modify and or distribute this software", 4),
    Notice("mit", "the software is provided as is without warranty of any kind", 4),
    Notice("apache-2", "licensed under the apache license version", 3, "2"),
    Notice("epl", "eclipse public license", 2),
    Notice("cddl", "common development and distribution license", 3),
    Notice("eupl", "european union public licence", 2),
    Notice("boost", "boost software license version", 2, "1"),
    Notice("zlib", "altered source versions must be plainly marked as such", 4),
    Notice("artistic", "the artistic license", 1, "2"),
    Notice("odbl", "open database license", 2),
    Notice("ofl", "sil open font license", 2),
)


def seeds_of(notice: Notice) -> list[tuple[str, int]]:
    """The seeds and their offsets: errors + 1 parts of nearly equal length, or all of an exact notice."""
    if not notice.phrase:
        return [(notice.exact, 0)]
    parts, n = notice.errors + 1, len(notice.phrase)
    cuts = [n * i // parts for i in range(parts + 1)]
    return [(notice.phrase[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Finds the notices and the exact places of base phrases in one text."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, base: tuple[tuple[str, str], ...] = BASE):
        self.notices, self.base = notices, base
        owners: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, notice in enumerate(notices):
            for seed, offset in seeds_of(notice):
                owners[seed].append((k, offset))
        for k, (phrase, _) in enumerate(base):  # an exact place holds the whole phrase; its seed is its longest notice-like part
            owners[phrase].append((len(notices) + k, 0))
        self.seeds = ahocorasick.Automaton()
        for seed, who in owners.items():
            self.seeds.add_word(seed, (len(seed), who))
        self.seeds.make_automaton()
        self.patterns = []
        for notice in notices:
            fuzzy = f"(?:{regex.escape(notice.phrase)}){{e<={notice.errors}}}" if notice.phrase else ""
            tail = regex.escape(notice.exact)
            self.patterns.append(regex.compile(rf"(?e)(?<= ){fuzzy}{' ' if fuzzy and tail else ''}{tail}(?= )"))
        self.lengths = [len(n.phrase) + bool(n.phrase and n.exact) + len(n.exact) for n in notices]

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int]], list[tuple[str, int, int]]]:
        """Words; (label, start, end, edits) of each match; (label, first word, last word) of each base place.

        Starts and ends are characters of the normalised text: words joined by one space.
        """
        words = (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()
        if not words:
            return 0, [], []
        joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
        windows: dict[int, list[list[int]]] = {}
        exact: list[tuple[int, int, int]] = []
        for end, (length, who) in self.seeds.iter(joined):
            start = end + 1 - length
            for k, offset in who:
                if k >= len(self.notices):  # the exact check of a base phrase
                    if joined[start - 1] == " " and joined[end + 1] == " ":
                        exact.append((k - len(self.notices), start, end))
                    continue
                slack = self.notices[k].errors + 1
                low, high = max(0, start - offset - slack), min(len(joined), start - offset + self.lengths[k] + slack)
                spans = windows.setdefault(k, [])
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = max(high, spans[-1][1])
                else:
                    spans.append([low, high])
        matches: list[tuple[str, int, int, int]] = []
        for k, spans in windows.items():
            label = self.notices[k].label
            for low, high in spans:
                for m in self.patterns[k].finditer(joined, low, high):
                    matches.append((label, m.start() - 1, m.end() - 1, sum(m.fuzzy_counts)))
        places, at, seen = [], 0, 1  # one walk counts the words before each place
        for k, start, _ in sorted(exact, key=lambda x: x[1]):
            at, seen = at + joined.count(" ", seen, start), start
            phrase, label = self.base[k]
            places.append((label, at, at + phrase.count(" ")))
        return len(words), sorted(matches, key=lambda m: (m[1], m[0])), places


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())])
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(SPAN)),
])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = NOTICES) -> DataFrame:
    """One row for each document: words, exact places, labels, best score and all spans."""
    out = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for part in slices(batches, 1024):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, matches, exact = scanner.scan(text)
                best = max((1.0 - e / max(1, end - start) for _, start, end, e in matches), default=0.0)
                rows.append({
                    "doc_id": doc, "n_words": n, "n_base": len(exact),
                    "first_word": exact[0][1] if exact else None, "last_word": exact[-1][1] if exact else None,
                    "base_labels": ",".join(sorted({x[0] for x in exact})),
                    "labels": ",".join(sorted({x[0] for x in exact} | {x[0] for x in matches})),
                    "score": min(1.0, max(0.0, 1.0 if exact else best)),
                    "spans": [{"label": a, "start": s, "end": t, "edits": e} for a, s, t, e in matches],
                })
            yield pa.RecordBatch.from_pylist(rows, out)

    return map_batches(docs.select(docs[id_col].cast("long"), docs[text_col].cast("string")), run, SCHEMA)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op1_license_scan": op1_license_scan}
