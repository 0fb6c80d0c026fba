"""License scans: ordered signature rules over a text's words, in DataFrame functions alone.

A text's words, A-Z lower-cased, are joined by blanks; signatures are regular expressions over
that string. A rule is tried only where the longest plain text of its signature occurs, and texts
without any word that all signatures need are done after one search. Detections of all rules are places (first word, end word); one that
lies inside a detection of the same or a better priority is suppressed, so that the most
telling signature of a passage stays.

The signatures combine license families, their versions and the forms in which a license is
stated (identifier, grant, versioned name, address, plain name).
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import ascii_lower, text_or_empty, without_names
from flowlens.llm.spans import let, running

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
TRUST = [1.0, 0.95, 0.85, 0.75, 0.6]  # by priority
# fixed values: label, names, identifier, versions, address
FAMILIES = [
    ("gpl", ["gnu general public license", "gnu gpl", "gpl"], "gpl", ["1.0", "2.0", "3.0"], "gnu org licenses gpl"),
    ("lgpl", ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl"], "lgpl", ["2.0", "2.1", "3.0"], "gnu org licenses lgpl"),
    ("agpl", ["gnu affero general public license", "gnu agpl", "agpl"], "agpl", ["1.0", "3.0"], "gnu org licenses agpl"),
    ("gfdl", ["gnu free documentation license", "gfdl"], "gfdl", ["1.1", "1.2", "1.3"], "gnu org licenses fdl"),
    ("apache", ["apache software license", "apache license"], "apache", ["1.0", "1.1", "2.0"], "apache org licenses license"),
    ("mpl", ["mozilla public license", "mpl"], "mpl", ["1.0", "1.1", "2.0"], "mozilla org mpl"),
    ("epl", ["eclipse public license", "epl"], "epl", ["1.0", "2.0"], "eclipse org legal epl"),
    ("cddl", ["common development and distribution license", "cddl"], "cddl", ["1.0", "1.1"], "opensource org licenses cddl"),
    ("cpl", ["common public license"], "cpl", ["1.0"], "opensource org licenses cpl"),
    ("artistic", ["artistic license", "perl artistic license"], "artistic", ["1.0", "2.0"], "opensource org licenses artistic license"),
    ("boost", ["boost software license"], "bsl", ["1.0"], "boost org license"),
    ("ofl", ["sil open font license", "open font license"], "ofl", ["1.0", "1.1"], "scripts sil org ofl"),
    ("osl", ["open software license"], "osl", ["1.0", "2.0", "2.1", "3.0"], "opensource org licenses osl"),
    ("afl", ["academic free license"], "afl", ["1.1", "1.2", "2.0", "2.1", "3.0"], "opensource org licenses afl"),
    ("eupl", ["european union public licen[cs]e", "eupl"], "eupl", ["1.0", "1.1", "1.2"], "joinup ec europa eu eupl"),
    ("python", ["python software foundation license", "psf license"], "psf", ["2.0"], "python org psf license"),
    ("php", ["php license"], "php", ["3.0", "3.01"], "php net license"),
    ("zope", ["zope public license", "zpl"], "zpl", ["1.1", "2.0", "2.1"], "zope org resources zpl"),
    ("cc-by", ["creative commons attribution", "cc by"], "cc by", ["1.0", "2.0", "2.5", "3.0", "4.0"], "creativecommons org licenses by"),
    ("cc-by-sa", ["creative commons attribution share ?alike", "cc by sa"], "cc by sa", ["1.0", "2.0", "2.5", "3.0", "4.0"], "creativecommons org licenses by sa"),
    ("cc-by-nd", ["creative commons attribution no ?deriv(?:ative)?s(?: works)?", "cc by nd"], "cc by nd", ["1.0", "2.0", "2.5", "3.0", "4.0"], "creativecommons org licenses by nd"),
    ("cc-by-nc", ["creative commons attribution non ?commercial", "cc by nc"], "cc by nc", ["1.0", "2.0", "2.5", "3.0", "4.0"], "creativecommons org licenses by nc"),
    ("cc-by-nc-sa", ["creative commons attribution non ?commercial share ?alike", "cc by nc sa"], "cc by nc sa", ["1.0", "2.0", "2.5", "3.0", "4.0"], "creativecommons org licenses by nc sa"),
    ("cc-by-nc-nd", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?", "cc by nc nd"], "cc by nc nd", ["1.0", "2.0", "2.5", "3.0", "4.0"], "creativecommons org licenses by nc nd"),
    ("cc0", ["creative commons zero", "cc0"], "cc0", ["1.0"], "creativecommons org publicdomain zero"),
]
# fixed values: label, signatures without versions, best first
SINGLE = [
    ("mit", ["released under the mit licen[cs]e", "licensed under the mit licen[cs]e", "the mit licen[cs]e", "mit licen[cs]e", "spdx license identifier mit"]),
    ("mit", ["permission is hereby granted free of charge to any person obtaining a copy", "the software is provided as is without warranty of any kind express or implied"]),
    ("isc", ["isc licen[cs]e", "spdx license identifier isc"]),
    ("isc", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("bsd", ["bsd licen[cs]e", "bsd style licen[cs]e"]),
    ("bsd-2-clause", ["bsd 2 clause(?: licen[cs]e)?", "simplified bsd licen[cs]e", "two clause bsd licen[cs]e"]),
    ("bsd-3-clause", ["bsd 3 clause(?: licen[cs]e)?", "new bsd licen[cs]e", "modified bsd licen[cs]e", "three clause bsd licen[cs]e"]),
    ("bsd-4-clause", ["bsd 4 clause(?: licen[cs]e)?", "original bsd licen[cs]e"]),
    ("bsd-3-clause", ["neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote"]),
    ("bsd-2-clause", ["redistribution and use in source and binary forms with or without modification are permitted"]),
    ("bsd-4-clause", ["all advertising materials mentioning features or use of this software must display"]),
    ("zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e"]),
    ("zlib", ["the origin of this software must not be misrepresented"]),
    ("unlicense", ["the unlicense", "unlicense org"]),
    ("public-domain", ["released into the public domain", "dedicated to the public domain", "this work is in the public domain"]),
    ("wtfpl", ["wtfpl", "do what the fuck you want to public license"]),
    ("ms-pl", ["microsoft public licen[cs]e"]),
    ("ms-rl", ["microsoft reciprocal licen[cs]e"]),
    ("proprietary", ["all rights reserved", "confidential and proprietary"]),
]
_EDGE = (r"(?<![^ ])(?:", r")(?![^ ])")
_OUT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
# every signature needs one of these: parts of words, whole words, or the two words of the last
GATE_PARTS = ["licen", "commons", "domain", "wtfpl", "permission", "reserved", "redistribution", "misrepresented", "advertising", "endorse", "proprietary", "warranty"]
GATE_WORDS = ["bsd", "gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "ofl", "eupl", "zpl", "cc0"]
GATE = rf"(?:^|{_OUT})(?:{'|'.join(GATE_WORDS)}|cc{_OUT}+by)(?:$|{_OUT})"


def needed(pattern: str) -> str:
    """The longest plain text that every match of a signature holds, of those that pass the gate if any."""
    flat = None
    while flat != pattern:
        flat, pattern = pattern, re.sub(r"\((?:[^()]*)\)[?]?(?:\{[^}]*\})?|\[[^]]*\][?]?|[a-z0-9 ][?]", "|", pattern)
    return max(re.findall("[a-z0-9 ]+", flat), key=lambda run: (gated(run), len(run)))


def gated(run: str) -> bool:
    """Whether a text with this run of words passes the gate."""
    return any(p in run for p in GATE_PARTS) or not set(GATE_WORDS).isdisjoint(run.split()) or "cc by" in run


def rules() -> list[dict]:
    """All signatures: key (a text that every match holds), label, priority (0 is best) and pattern over blank-joined words."""
    out = []

    def add(label: str, priority: int, pattern: str) -> None:
        out.append({"key": needed(pattern), "label": label, "priority": priority, "pattern": pattern.join(_EDGE)})

    for label, names, ident, versions, address in FAMILIES:
        later = "(?: or (?:any )?later(?: version)?| only| plus)?"
        for name in names:
            add(label, 4, name)
            add(label, 3, f"(?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of (?:the )?)?{name}(?: licen[cs]e)?")
        for v in versions:
            number = v.replace(".", " ")
            short = number.removesuffix(" 0")
            versioned = f"(?:{number}|{short}|v{number}|v{short})"
            full = f"{label}-{v}"
            add(full, 1, f"spdx license identifier {ident} {number}{later}")
            add(full, 2, f"(?:https? )?(?:www )?{address} (?:v ?)?{versioned}")
            for name in names:
                stated = f"{name}(?: licen[cs]e)?(?: (?:version|ver|v))? {versioned}"
                add(full, 0, f"(?:licensed|released|distributed|published|available) under (?:the |a )?(?:terms of (?:the )?)?{stated}{later}")
                add(full, 2, f"{stated}{later}")
    for label, signatures in SINGLE:
        for i, s in enumerate(signatures):
            add(label, 1 if len(s.split()) > 5 else 3 if i + 1 < len(signatures) else 4, s)
    return out


_RULE = "array<struct<key: string, label: string, priority: int, pattern: string>>"
_FOUND = "array<struct<start: int, less: int, priority: int, label: string>>"


def _marked_words(words: Column, pattern: Column) -> Column:
    """array<struct<s, e>>: first and last word of each match of a pattern in the joined words."""
    parts = F.split(F.regexp_replace(words, pattern, F.lit("\u0001$0\u0002")), " ", -1)
    numbered = F.transform(parts, lambda w, i: F.struct(
        F.when(F.startswith(w, F.lit("\u0001")), i).alias("s"), F.when(F.endswith(w, F.lit("\u0002")), i).alias("e")
    ))
    edges = F.filter(numbered, lambda x: x["s"].isNotNull() | x["e"].isNotNull())
    starts = F.transform(F.filter(edges, lambda x: x["s"].isNotNull()), lambda x: x["s"])
    ends = F.transform(F.filter(edges, lambda x: x["e"].isNotNull()), lambda x: x["e"])
    return F.arrays_zip(starts, ends).cast("array<struct<s: int, e: int>>")


def detections(words: Column, present: Column) -> Column:
    """Places of the rules whose key is present: start, less (minus the end, so that longer ones sort first), priority, label."""
    known = F.from_json(F.lit(json.dumps(rules())), _RULE)
    tried = F.filter(known, lambda r: F.array_contains(present, r["key"]) & F.regexp_like(words, r["pattern"]))
    placed = F.flatten(F.transform(tried, lambda r: F.transform(_marked_words(words, r["pattern"]), lambda m: F.struct(
        m["s"].alias("start"), (-m["e"] - 1).alias("less"), r["priority"].alias("priority"), r["label"].alias("label"),
    ))))
    return F.array_sort(placed.cast(_FOUND))


def unsuppressed(found: Column) -> Column:
    """Detections that lie inside none of the same or a better priority. In the order by start and
    falling end, that is one whose end is beyond all ends seen of those priorities."""
    def kept(rows: Column) -> Column:
        ends = F.transform(rows, lambda x: F.transform(  # of the detection's own and all worse priorities
            F.sequence(F.lit(0), F.lit(len(TRUST) - 1)), lambda p: F.when(p >= x["priority"], -x["less"]).otherwise(-1)))
        none = F.array_repeat(F.lit(-1), len(TRUST))
        seen = running(ends, none, "array<int>", lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
        met = F.zip_with(rows, seen, lambda x, s: F.struct(x.alias("x"), (F.get(s, x["priority"]) < -x["less"]).alias("beyond")))
        return F.transform(F.filter(met, lambda m: m["beyond"]), lambda m: m["x"]).cast(_FOUND)

    return let(found, kept)


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Words are runs of letters, digits and signs beyond ASCII, A-Z lower-cased; a null text has
    none. n_base counts the places of the base phrases, first_word and last_word are their
    smallest and largest first word (null without any). ``detections`` are the rules' places
    that remain (start, end, priority, label); ``labels`` joins theirs and the base labels.
    ``score`` is the trust in the best of them, 0 without any. Caller columns of these names
    are replaced; rows are scanned each on its own.
    """
    docs = without_names(docs, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"])
    low = ascii_lower(text_or_empty(text))
    gate = F.regexp_like(low, F.lit(GATE))
    for part in reversed(GATE_PARTS):
        gate = F.contains(low, F.lit(part)) | gate
    words = F.array_join(F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)), " ")
    out = docs.withColumn("n_words", F.regexp_count(low, F.lit(WORDS)).cast("long")).withColumn("_words", F.when(gate, words))
    keys = F.from_json(F.lit(json.dumps(sorted({r["key"] for r in rules()}))), "array<string>")
    out = out.withColumn("_present", F.when(F.col("_words").isNotNull(), F.filter(keys, lambda k: F.contains(F.col("_words"), k))))
    none = F.array().cast("array<struct<s: int, e: int>>")
    places = [
        F.when(F.contains("_words", F.lit(phrase)), _marked_words(F.col("_words"), F.lit(phrase.join(_EDGE)))).otherwise(none)
        for phrase, _ in BASE
    ]
    out = out.withColumn("_places", F.array(*places))
    at = F.transform(F.flatten("_places"), lambda m: m["s"].cast("long"))
    names = F.array(*[F.when(F.size(F.get("_places", F.lit(i))) > 0, name) for i, (_, name) in enumerate(BASE)])
    out = out.withColumns({
        "n_base": F.size(at).cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at),
        "_names": F.array_compact(names),
        "_kept": F.when(F.size("_present") > 0, unsuppressed(detections(F.col("_words"), F.col("_present")))).otherwise(F.array().cast(_FOUND)),
    })
    trust = F.array(*[F.lit(t) for t in TRUST])
    best = F.array_max(F.transform("_kept", lambda x: F.get(trust, x["priority"])))
    own = F.transform("_kept", lambda x: x["label"])
    return out.withColumns({
        "base_labels": F.array_join(F.array_sort("_names"), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat("_names", own))), ","),
        "score": F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.col("n_base") > 0, TRUST[-1]).otherwise(0.0)),
        "detections": F.transform("_kept", lambda x: F.struct(
            x["start"].alias("start"), (-x["less"]).alias("end"), x["priority"].alias("priority"), x["label"].alias("label"))),
    }).drop("_words", "_present", "_places", "_names", "_kept")
