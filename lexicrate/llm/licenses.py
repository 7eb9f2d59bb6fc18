"""Operator 2: license scans by ordered signature rules, native to Spark SQL.

A rule is a regular expression over a text's normalized words, with a priority
and a confidence.  Most are hand-written, one by one (``license_rules`` and
``NOTICES``); license names in sentence frames add their products.  A keyword
decides whether a rule is tried at all, and a few stems decide whether a text is
looked at; few texts hold any.  Detections are spans of words.  One that lies within a detection of the same or
a better priority is suppressed.

The base phrases are rules of the lowest priority that can't be suppressed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .license_rules import signatures
from .shared import documents, staged
from .words import normalized, word_count

#: Phrases and their labels, as the contract fixes them.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: label, keyword, name as a pattern over normalized words
LICENSES = [
    ("mit", "mit", r"mit"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache", "apache", r"apache(?: software)?"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|simplified bsd|freebsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd)"),
    ("bsd", "bsd", r"bsd"),
    ("isc", "isc", r"isc"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public license(?: gpl)?(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version)?(?: 2(?: 0)?|v2)(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version)?(?: 3(?: 0)?|v3)(?: only| or later)?"),
    ("lgpl-2.1", "lesser general", r"(?:gnu )?lesser general public license(?: version| v)? 2(?: 1)?"),
    ("lgpl-3.0", "lesser general", r"(?:gnu )?lesser general public license(?: version| v)? 3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: v?[23](?: [01])?)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version| v)?(?: 3(?: 0)?)?"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version| v)?(?: 2(?: 0)?)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v)?(?: [12](?: 0)?)?"),
    ("cddl-1.0", "common development", r"common development and distribution license(?: version)?(?: 1 [01])?"),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] 0)?(?: international| unported| generic)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] 0)?(?: international| unported)?"),
    ("cc-by-sa", "cc by", r"cc by sa(?: [1-4] 0)?"),
    ("cc-by-nc", "cc by", r"cc by nc(?: [1-4] 0)?"),
    ("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1-4] 0)?"),
    ("cc-by-nd", "cc by", r"cc by nd(?: [1-4] 0)?"),
    ("cc-by", "cc by", r"cc by [1-4] 0"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("unlicense", "unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("artistic-2.0", "artistic", r"artistic license(?: 2(?: 0)?)?"),
    ("boost", "boost", r"boost software license(?: version)?(?: 1 0)?"),
    ("python", "python", r"python software foundation(?: license)?(?: version)?(?: 2)?"),
    ("openssl", "openssl", r"openssl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version)?(?: 1 1)?"),
]

#: frame around a name, priority (smaller is better), confidence
FRAMES = [
    (r"spdx license identifier {}", 1, 1.0),
    (r"licensed under (?:the )?(?:terms of (?:the )?)?{}(?: license)?", 2, 0.95),
    (r"(?:released|distributed|published) under (?:the )?(?:terms of (?:the )?)?{}(?: license)?", 2, 0.95),
    (r"(?:available|provided) under (?:the )?(?:terms of (?:the )?)?{}(?: license)?", 2, 0.9),
    (r"under the terms of (?:the )?{}(?: license)?", 2, 0.9),
    (r"subject to (?:the )?(?:terms of (?:the )?)?{}(?: license)?", 2, 0.85),
    (r"(?:license|licence) (?:is )?{}", 3, 0.8),
    (r"{} (?:license|licence|licensed)", 3, 0.8),
]

#: Names that say enough when they stand alone.
ALONE = {
    "general public", "lesser general", "affero", "mozilla", "eclipse", "creative commons",
    "common development", "cc by", "cc0", "unlicense", "wtfpl", "boost", "open font", "lgpl",
}

#: label, keyword, pattern, priority, confidence of sentences without a name
NOTICES = [
    ("copyright", "copyright", r"copyright(?: c)?(?: [12][0-9]{3}){1,4}", 3, 0.6),
    ("copyright", "copyright", r"copyright c", 4, 0.5),
    ("copyright", "copyright", r"copyright (?:holders?|owners?)", 4, 0.4),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 2, 0.9),
    ("public-domain", "public domain", r"public domain", 4, 0.5),
    ("warranty-disclaimer", "warrant", r"without warranties or conditions of any kind", 3, 0.7),
    ("warranty-disclaimer", "warrant", r"without (?:any )?warranty", 3, 0.6),
    ("warranty-disclaimer", "warrant", r"provided as is without warranty of any kind", 2, 0.8),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 1, 0.95),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software", 1, 0.95),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 1, 0.95),
    ("redistribution", "redistribut", r"redistributions? (?:of|in) (?:source code|binary form)", 3, 0.6),
    ("proprietary", "proprietary", r"proprietary and confidential", 2, 0.8),
    ("proprietary", "written permission", r"without (?:prior )?written permission", 3, 0.6),
    ("gpl", "free software", r"free software you can redistribute it and or modify it", 1, 0.95),
    ("reserved", "rights reserved", r"(?:all|some) rights reserved", 4, 0.6),
]

BASE_PRIORITY = 9

#: Parts of many keywords; a text without these and the other keywords has no license.
STEMS = [
    "licen", "public", "copyright", "permi", "software", "warrant", "creative", "creativecommons",
    "redistribut", "rights", "commercial", "version",
]


def gates() -> list[str]:
    """Substrings of which every keyword holds one, as few as that takes."""
    keywords = {k for _, k, _, _, _ in rules()}
    left = {next((s for s in STEMS if s in k), k) for k in keywords}
    return sorted(k for k in left if not any(other != k and other in k for other in left))


def rules() -> list[tuple[str, str, str, int, float]]:
    """All rules in order: (label, keyword, pattern, priority, confidence)."""
    written = [rule[:5] for rule in signatures()]
    framed = [
        (label, keyword, frame.format(name), priority, confidence)
        for frame, priority, confidence in FRAMES
        for label, keyword, name in LICENSES
    ]
    alone = [(label, k, name, 4, 0.7) for label, k, name in LICENSES if k in ALONE]
    base = [(label, phrase, phrase, BASE_PRIORITY, 0.5) for phrase, label in BASE.items()]
    return written + NOTICES + framed + alone + base


RULE = "struct<label:string,pattern:string,priority:int,confidence:double,rule:int>"
SPAN = "array<struct<start:bigint,end:bigint,label:string,priority:int,confidence:double,rule:int>>"


def _by_keyword() -> Column:
    """The rules as one constant: an array of (keyword, its rules)."""
    groups: dict[str, list[Column]] = {}
    for i, (label, keyword, pattern, priority, confidence) in enumerate(rules()):
        # a look-ahead for the last space, so that neighbours may share it
        fields = F.struct(
            F.lit(label).alias("label"),
            F.lit(rf"(?<= )(?:{pattern})(?= )").alias("pattern"),
            F.lit(priority).alias("priority"),
            F.lit(confidence).alias("confidence"),
            F.lit(i).alias("rule"),
        )
        groups.setdefault(keyword, []).append(fields)
    return F.array(
        *[F.struct(F.lit(k).alias("keyword"), F.array(*r).alias("rules")) for k, r in groups.items()]
    )


def _marked(padded: Column, rule: Column) -> Column:
    """Spans of words that match one rule.

    Marks go around the matches; the words that carry one are the spans' ends.
    The time is linear in the text, however many matches there are.
    """
    marked = F.regexp_replace(
        padded, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit("\u0001$1\u0002")
    )
    words = F.split(F.trim(marked), " ", -1)
    at = lambda mark: F.filter(
        F.transform(words, lambda w, i: F.when(F.contains(w, F.lit(mark)), i)),
        lambda i: i.isNotNull(),
    )
    return F.zip_with(
        at("\u0001"), at("\u0002"),
        lambda a, b: F.struct(
            a.cast("long").alias("start"), (b + 1).cast("long").alias("end"),
            rule["label"].alias("label"), rule["priority"].alias("priority"),
            rule["confidence"].alias("confidence"), rule["rule"].alias("rule"),
        ),
    )


def _detections(norm: Column) -> Column:
    padded = F.concat(F.lit(" "), norm, F.lit(" "))
    tried = F.flatten(
        F.transform(
            F.filter(_by_keyword(), lambda k: F.contains(norm, k["keyword"])), lambda k: k["rules"]
        )
    )
    found = F.transform(
        F.filter(tried, lambda r: F.rlike(padded, r["pattern"])), lambda r: _marked(padded, r)
    )
    return F.flatten(found)


def scan_licenses(df: DataFrame) -> DataFrame:
    """License notices in every whole text of ``df(doc_id, text)``.

    Returns doc_id, n_words, base (places of the base phrases: start, label) and
    detections: the spans that no other one suppresses (start, end in words,
    label, priority, confidence, rule).  Null or empty text has no words and
    nothing in it.  Rows stay one to one, repeated rows and null ids included;
    other columns are not read.
    """
    norm = df.select(F.col("doc_id").cast("long").alias("doc_id"), normalized(F.col("text")).alias("norm"))
    any_keyword = reduce(lambda a, b: a | b, [F.contains("norm", F.lit(k)) for k in gates()])
    flagged = norm.select(
        "doc_id", "norm", word_count(F.col("norm")).alias("n_words"),
        F.coalesce(any_keyword, F.lit(False)).alias("likely"),
    )
    empty = F.array().cast("array<string>")
    worded = flagged.withColumn(
        "_words", F.when(F.col("likely"), F.split("norm", " ", -1)).otherwise(empty)
    )
    base_none = F.array().cast("array<struct<start:bigint,label:string>>")
    found = worded.select(
        "doc_id", "n_words",
        F.when(F.col("likely"), _base_places()).otherwise(base_none).alias("base"),
        F.when(F.col("likely"), _detections(F.col("norm"))).otherwise(F.array().cast(SPAN)).alias("spans"),
    )
    scanned = staged(found.withColumn("row", F.monotonically_increasing_id()), "licenses")

    # Spans in order of start, longest first: what holds a span comes before it.
    each = scanned.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "priority", "rule")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({p for _, _, _, p, _ in rules()})
    reach = {p: F.max(F.when(F.col("priority") <= p, F.col("end"))).over(before) for p in levels}
    own = reduce(
        lambda rest, p: F.when(F.col("priority") == p, F.col(f"reach{p}")).otherwise(rest), levels, F.lit(None)
    )
    kept = (
        each.withColumns({f"reach{p}": c for p, c in reach.items()})
        .where(F.coalesce(own, F.lit(-1)) < F.col("end"))
        .groupBy("row")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("start", "end", "label", "priority", "confidence", "rule"))
            ).alias("detections")
        )
    )
    return scanned.join(kept, "row", "left").select(
        "doc_id", "n_words", "base", F.coalesce("detections", F.array().cast(SPAN)).alias("detections")
    )


def _phrase_at(wanted: list[str], label: str):
    """For a word and its place: the start of a phrase, or null."""

    def hit(word: Column, place: Column) -> Column:
        stands = F.slice("_words", place + 1, len(wanted)) == F.array(*map(F.lit, wanted))
        start = F.struct(place.cast("long").alias("start"), F.lit(label).alias("label"))
        return F.when((word == wanted[0]) & stands, start)

    return hit


def _base_places() -> Column:
    """Starts of every base phrase, overlapping ones included: (start, label)."""
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    parts = []
    for phrase, label in BASE.items():
        starts = F.transform("_words", _phrase_at(phrase.split(" "), label))
        places = F.filter(starts, lambda x: x.isNotNull())
        parts.append(F.when(F.contains("norm", F.lit(phrase)), places).otherwise(none))
    return F.concat(*parts)


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(documents(spark, sf_dir))
    starts = F.transform("base", lambda b: b["start"])
    labels = lambda c: F.array_distinct(F.transform(c, lambda x: x["label"]))
    base = labels("base")
    text = lambda c: F.array_join(F.array_sort(c), ",")
    confidence = F.array_max(F.transform("detections", lambda d: d["confidence"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        text(base).alias("base_labels"),
        text(F.array_union(base, labels("detections"))).alias("labels"),
        F.coalesce(
            F.greatest(confidence, F.when(F.size("base") > 0, 0.5)), F.lit(0.0)
        ).alias("score"),
    )
