"""License detection by ordered signature rules, in DataFrame functions only.

A text is reduced to its lower-case words joined by single spaces.  Rules are
regular expressions over that form.  Each has a keyword; a rule runs on a text
only if a word of it starts with the keyword, and texts with neither a form
of "license" nor the keyword of a license sentence are not even reduced.  Detections are intervals of words with a priority.  A detection
inside another one is suppressed when the other has the better priority or,
at equal priority, is longer.

The rules are built from the table of licenses and the sentence templates
below (hundreds of them), after the three base phrases, which are never
suppressed.

Defined results: NULL and wordless texts have no words and detections; rows
that repeat a doc_id are judged one by one; extra columns are ignored.
Suppression compares the detections of one text with each other, so its work
grows with the square of their number in that text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word characters before lower-casing, as a class of what they are not (fixed value of the contract).
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOT_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Fixed values of the contract: base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: (keyword, expression for the name, SPDX identifiers as words).  Every match of the name holds a word that
#: starts with the keyword; where no word is common to all forms of a name, a further form has an entry with "-name",
#: None where it adds no identifier.
LICENSES = {
    "agpl": ("affero", r"(?:gnu )?affero general public", r"agpl(?: \d)*(?: only| or later)?"),
    "apache": ("apache", r"apache(?: software)?", r"apache(?: \d)*"),
    "artistic": ("artistic", r"artistic", r"artistic(?: \d)*(?: perl| cl8)?"),
    "beerware": ("beer", r"beer ?ware", r"beerware"),
    "bsd": ("bsd", r"(?:(?:new|modified|simplified|original|revised|free|\d|two|three|four) )?(?:clause )?bsd", r"(?:0)?bsd(?: \d clause)?"),
    "bsl": ("boost", r"boost(?: software)?", r"bsl 1 0"),
    "busl": ("business", r"business source", r"busl 1 1"),
    "cc0": ("cc0", r"(?:creative commons )?cc0(?: universal)?", r"cc0 1 0"),
    "cc-by": ("attribution", r"(?:creative commons |cc )attribution", r"cc by \d \d"),
    "cc-by-sa": ("attribution", r"(?:creative commons |cc )?attribution share ?alike", r"cc by sa \d \d"),
    "cc-by-nc": ("attribution", r"(?:creative commons |cc )?attribution non ?commercial", r"cc by nc(?: sa| nd)? \d \d"),
    "cddl": ("cddl", r"cddl", r"cddl 1 \d"),
    "cddl-name": ("common development", r"common development and distribution", None),
    "cecill": ("cecill", r"cecill(?: [abc])?", r"cecill(?: [abc\d])*"),
    "cpl": ("common public", r"common public", r"cpl 1 0"),
    "ecl": ("educational", r"educational community", r"ecl \d 0"),
    "epl": ("eclipse", r"eclipse public", r"epl \d 0"),
    "eupl": ("european", r"european union public", r"eupl 1 \d"),
    "fdl": ("documentation", r"(?:gnu )?free documentation", r"gfdl 1 \d(?: or later| only)?"),
    "gpl": ("gpl", r"(?:gnu )?gpl(?:v\d)?", r"gpl(?: \d)*(?: only| or later)?"),
    "gpl-name": ("gnu", r"gnu general public", r"gnu gpl"),
    "ipa": ("ipa", r"ipa font", r"ipa"),
    "isc": ("isc", r"isc", r"isc"),
    "lgpl": ("lesser", r"(?:gnu )?lesser general public", r"lgpl(?: \d)*(?: only| or later)?"),
    "lgpl-name": ("library", r"(?:gnu )?library general public", None),
    "lppl": ("latex", r"latex project public", r"lppl 1 \d c?"),
    "mit": ("mit", r"(?:expat )?mit(?: expat)?", r"mit(?: 0)?"),
    "mpl": ("mozilla", r"mozilla public", r"mpl \d \d"),
    "ms-pl": ("microsoft", r"microsoft public", r"ms pl"),
    "ms-rl": ("reciprocal", r"microsoft reciprocal", r"ms rl"),
    "ncsa": ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa"),
    "odbl": ("database", r"open database", r"odbl 1 0"),
    "ofl": ("font", r"(?:sil )?open font", r"ofl 1 \d"),
    "openssl": ("openssl", r"openssl", r"openssl"),
    "osl": ("open software", r"open software", r"osl \d \d"),
    "php": ("php", r"php", r"php 3 0\d?"),
    "postgresql": ("postgresql", r"postgresql", r"postgresql"),
    "psf": ("python", r"python(?: software foundation)?", r"psf 2 0"),
    "qpl": ("q public", r"q public", r"qpl 1 0"),
    "ruby": ("ruby", r"ruby", r"ruby"),
    "sspl": ("server side", r"server side public", r"sspl 1 0"),
    "unicode": ("unicode", r"unicode", r"unicode(?: dfs 201\d| 3 0)"),
    "unlicense": ("unlicense", r"unlicense", r"unlicense"),
    "upl": ("universal permissive", r"universal permissive", r"upl 1 0"),
    "vim": ("vim", r"vim", r"vim"),
    "w3c": ("w3c", r"w3c(?: software)?", r"w3c"),
    "wtfpl": ("wtfpl", r"wtfpl", r"wtfpl"),
    "wtfpl-name": ("do what the", r"do what the fuck you want to public", None),
    "x11": ("x11", r"x11", r"x11"),
    "zlib": ("zlib", r"zlib(?: libpng)?", r"zlib"),
    "zpl": ("zope", r"zope public", r"zpl \d \d"),
}
#: (template, priority, score); {n} the name, {i} the identifier.
TEMPLATES = [
    (r"spdx license identifier {i}", 1, 1.0),
    (r"(?:re)?(?:licensed|released|distributed|published|provided|available) (?:to you )?under (?:the |a |an )?{n} licen[cs]e(?: (?:version |v)?\d(?: \d)*)?", 2, 0.95),
    (r"under the terms (?:and conditions )?of the {n} licen[cs]e(?: (?:version |v)?\d(?: \d)*)?", 2, 0.95),
    (r"(?:is|are) (?:re|dual )?licensed (?:under|by) (?:the )?{n}", 3, 0.85),
    (r"{n} licen[cs]e (?:version |v)?\d(?: \d)*", 3, 0.9),
    (r"{n} licen[cs]e", 4, 0.8),
    (r"licen[cs]e (?:is )?{n}", 5, 0.6),
]
#: Sentences of license texts: (label, keyword, expression).
SENTENCES = [
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "purpose", r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "endorse", r"may be used to endorse or promote products derived from this software"),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("apache", "apache", r"www apache org licenses(?: license)? 2 0"),
    ("gpl", "gnu", r"www gnu org licenses(?: gpl| old licenses)?"),
    ("mpl", "mozilla", r"mozilla org mpl 2 0"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "domain", r"(?:released|dedicated|placed) (?:in|into|to) the public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by \d \d"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa \d \d"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
]


#: In every rule made from a template, and in the base phrases.
ANY_LICENSE = "licen"


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: str
    priority: int
    score: float


def rules() -> list[Rule]:
    """All rules in order: the base phrases, then sentences, then every license in every template."""
    out = [Rule(f"base:{label}", label, "license", phrase, 0, 0.9) for phrase, label in BASE.items()]
    out += [Rule(f"text:{label}:{k}", label, keyword, pattern, 1, 1.0) for k, (label, keyword, pattern) in enumerate(SENTENCES)]
    for label, (keyword, name, ident) in LICENSES.items():
        for k, (template, priority, score) in enumerate(TEMPLATES):
            if ident is None and "{i}" in template:
                continue
            pattern = template.replace("{n}", f"(?:{name})").replace("{i}", f"(?:{ident})")
            # an identifier need not hold the name's keyword
            out.append(Rule(f"{label}:{k}", label.removesuffix("-name"), "spdx" if "spdx" in template else keyword, pattern, priority, score))
    return out


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _places(norm: Column, rule: Column) -> Column:
    """Intervals of words of a rule's matches: the pieces between the matches give the offsets."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))
    found = F.regexp_extract_all(norm, pattern, F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(norm, pattern, -1), F.lit(1), F.size(found)).alias("piece"), found.alias("hit"))
    empty = F.array().cast("array<struct<start:int,end:int,rule:string,label:string,priority:int,score:double>>")

    def step(acc, x):
        start = acc["at"] + _spaces(x["piece"])
        end = start + _spaces(x["hit"])
        one = F.struct(start.alias("start"), (end + 1).alias("end"), rule["name"].alias("rule"), rule["label"].alias("label"),
                       rule["priority"].alias("priority"), rule["score"].alias("score"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))
    return F.aggregate(zipped, F.struct(F.lit(-1).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _inside(d: Column, e: Column) -> Column:
    """``d`` lies in ``e`` and gives way to it."""
    longer = (e["end"] - e["start"]) > (d["end"] - d["start"])
    return (e["start"] <= d["start"]) & (e["end"] >= d["end"]) & (
        (e["priority"] < d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (~longer & (e["rule"] < d["rule"])))))


def scan_licenses(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, base, found``: the base detections and those left after suppression, for every row.

    Both are arrays of ``start, end`` (words, end exclusive), ``rule, label, priority, score``.
    """
    table = rules() if table is None else table
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.lower(text)  # only to find candidates: it covers the ASCII lower-casing
    some = F.lit(False)
    for word in sorted({ANY_LICENSE if ANY_LICENSE in r.pattern else r.keyword for r in table}):
        some = some | lower.contains(word)
    all_rules = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in vars(r).items()]) for r in table])
    src = docs.select("doc_id", F.regexp_count(text, F.lit(WORDS)).cast("long").alias("n_words"),
                      F.when(some, F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), NOT_WORDS, " ")), F.lit(" "))).alias("norm"))
    gated = F.filter(all_rules, lambda r: F.contains(F.col("norm"), F.concat(F.lit(" "), r["keyword"])))
    hits = src.withColumn("hits", F.when(F.col("norm").isNotNull(), F.flatten(F.transform(gated, lambda r: _places(F.col("norm"), r)))))
    none = F.array().cast("array<struct<start:int,end:int,rule:string,label:string,priority:int,score:double>>")
    hits = hits.select("doc_id", "n_words", F.coalesce("hits", none).alias("hits"))
    kept = F.filter("hits", lambda d: (d["priority"] == 0) | ~F.exists("hits", lambda e: _inside(d, e)))
    return hits.select("doc_id", "n_words", F.filter("hits", lambda d: d["priority"] == 0).alias("base"), F.array_sort(kept).alias("found"))


def _labels(detections: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def license_report(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``."""
    starts = F.transform("base", lambda d: d["start"])
    return scan_licenses(docs, table).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        _labels("base").alias("base_labels"), _labels("found").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["score"])), F.lit(0.0)).alias("score"))
