"""Operator 9 [native]: license scan with ordered signature rules.

Text is lower-cased and cut into words (runs of letters, digits and everything beyond ASCII);
rules are regular expressions over the words joined by single spaces, so a rule sees neither
punctuation nor line breaks. Each rule has a keyword that every match holds, a label, a
priority and its place in the rule order. Per document:

1. keyword prefilter: a document without any keyword runs no rule; otherwise only the rules
   whose keyword it holds are run;
2. every match becomes an interval of words;
3. suppression: an interval inside another one of the same or a higher priority goes; of two
   equal intervals the higher priority, then the earlier rule, stays;
4. the remaining intervals give the labels. The base phrases are rules too, but their places
   and labels are always kept.

``score`` is 1 - 1 / (1 + sum of the priorities of the remaining intervals).

All of it is DataFrame functions: one pass over the text without a shuffle, whose result (a
few numbers a document, and intervals for the few that have any) is written once; the
suppression is one window over a document's intervals.

Defined cases: null or empty text has 0 words, 0 places, empty labels, score 0; rows keep
their multiplicity, null doc_id included; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civicflow.llm.common import staged

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Words that are no keyword if the name has another one.
GENERIC = {"general", "public", "licen", "software", "open", "free", "source", "foundation"}

_LICENSED = "(?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?"
_VERSION = "(?:licen[cs]e )?(?:version |ver |v ?)?"
_LATER = "(?: or (?:any )?later(?: version)?| only)?"

#: Families: label, name in words, short name in words, versions in words (as written after
#: normalisation, "2.0" reads "2 0").
FAMILIES = [
    ("gpl", "gnu general public licen[cs]e", "gpl", ["1", "2", "3"]),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "lgpl", ["2", "2 1", "3"]),
    ("agpl", "gnu affero general public licen[cs]e", "agpl", ["1", "3"]),
    ("gfdl", "gnu free documentation licen[cs]e", "gfdl", ["1 1", "1 2", "1 3"]),
    ("apache", "apache (?:software )?licen[cs]e", "apache", ["1", "1 1", "2", "2 0"]),
    ("mpl", "mozilla public licen[cs]e", "mpl", ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse public licen[cs]e", "epl", ["1 0", "2 0"]),
    ("cddl", "common development and distribution licen[cs]e", "cddl", ["1 0", "1 1"]),
    ("cpl", "common public licen[cs]e", "cpl", ["0 5", "1 0"]),
    ("eupl", "european union public licen[cs]e", "eupl", ["1 0", "1 1", "1 2"]),
    ("osl", "open software licen[cs]e", "osl", ["1 0", "2 0", "2 1", "3 0"]),
    ("afl", "academic free licen[cs]e", "afl", ["1 1", "2 0", "2 1", "3 0"]),
    ("artistic", "artistic licen[cs]e", "artistic", ["1 0", "2 0"]),
    ("boost", "boost software licen[cs]e", "bsl", ["1 0"]),
    ("ofl", "sil open font licen[cs]e", "ofl", ["1 0", "1 1"]),
    ("odbl", "open database licen[cs]e", "odbl", ["1 0"]),
    ("odc-by", "open data commons attribution licen[cs]e", "odc by", ["1 0"]),
    ("pddl", "public domain dedication and licen[cs]e", "pddl", ["1 0"]),
    ("zpl", "zope public licen[cs]e", "zpl", ["1 1", "2 0", "2 1"]),
    ("lppl", "latex project public licen[cs]e", "lppl", ["1 0", "1 1", "1 2", "1 3", "1 3c"]),
    ("python", "python software foundation licen[cs]e", "psf", ["2", "2 0"]),
    ("php", "php licen[cs]e", "php", ["3 0", "3 01"]),
    ("cecill", "cecill free software licen[cs]e", "cecill", ["1 0", "1 1", "2 0", "2 1"]),
    ("apsl", "apple public source licen[cs]e", "apsl", ["1 0", "1 1", "1 2", "2 0"]),
    ("ms-pl", "microsoft public licen[cs]e", "ms pl", []),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "ms rl", []),
    ("ogl", "open government licen[cs]e", "ogl", ["1 0", "2 0", "3 0"]),
    ("unlicense", "the unlicense", "unlicense", []),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "wtfpl", ["2"]),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", "ncsa", []),
    ("postgresql", "postgresql licen[cs]e", "postgresql", []),
    ("vim", "vim licen[cs]e", "vim", []),
    ("upl", "universal permissive licen[cs]e", "upl", ["1 0"]),
    ("mulan", "mulan permissive software licen[cs]e", "mulanpsl", ["1", "2"]),
    ("sspl", "server side public licen[cs]e", "sspl", ["1"]),
    ("busl", "business source licen[cs]e", "busl", ["1 0", "1 1"]),
    ("elastic", "elastic licen[cs]e", "elv2", ["2 0"]),
    ("cc0", "creative commons zero", "cc0", ["1 0"]),
]

#: Creative Commons terms: label, name in words, short name in words.
COMMONS = [
    ("cc-by", "attribution", "by"),
    ("cc-by-sa", "attribution share ?alike", "by sa"),
    ("cc-by-nd", "attribution no ?deriv(?:ative)?s?(?: works)?", "by nd"),
    ("cc-by-nc", "attribution non ?commercial", "by nc"),
    ("cc-by-nc-sa", "attribution non ?commercial share ?alike", "by nc sa"),
    ("cc-by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?", "by nc nd"),
]
COMMONS_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Single signatures: label, priority, keyword, pattern.
SIGNATURES = [
    ("mit", 3, "mit licen", "(?:the )?mit licen[cs]e"),
    ("mit", 3, "expat licen", "expat licen[cs]e"),
    ("mit", 2, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 3, "isc licen", "(?:the )?isc licen[cs]e"),
    ("isc", 2, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
    ("0bsd", 3, "bsd", "(?:0bsd|zero clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?)"),
    ("bsd-2-clause", 3, "bsd", "(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-3-clause", 3, "bsd", "(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)(?: licen[cs]e)?"),
    ("bsd-4-clause", 3, "bsd", "(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?"),
    ("bsd", 2, "bsd licen", "bsd licen[cs]e"),
    ("bsd", 2, "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("zlib", 3, "zlib", "zlib(?: libpng)? licen[cs]e"),
    ("openssl", 3, "openssl licen", "openssl licen[cs]e"),
    ("x11", 3, "x11 licen", "x11 licen[cs]e"),
    ("curl", 3, "curl licen", "curl licen[cs]e"),
    ("ruby", 3, "ruby licen", "ruby licen[cs]e"),
    ("perl", 2, "same terms as perl", "(?:under )?(?:the )?same terms as perl(?: itself)?"),
    ("json", 3, "json licen", "json licen[cs]e"),
    ("json", 2, "shall be used for good not evil", "the software shall be used for good not evil"),
    ("beerware", 3, "beer", "(?:beer ?ware licen[cs]e|the beer ware)"),
    ("hippocratic", 3, "hippocratic licen", "hippocratic licen[cs]e"),
    ("public-domain", 2, "public domain", "(?:in|into|to) the public domain"),
    ("public-domain", 1, "public domain", "public domain"),
    ("fair-source", 3, "fair source", "fair source licen[cs]e"),
    ("commons-clause", 3, "commons clause", "commons clause(?: licen[cs]e)?(?: condition)?"),
    ("proprietary", 2, "proprietary", "proprietary (?:and confidential|licen[cs]e|software)"),
    ("proprietary", 2, "confidential", "confidential and proprietary"),
    ("reserved", 3, "all rights reserved", "copyright (?:c )?[0-9]{4}(?: [0-9]{4})?(?: [^ ]+){1,6} all rights reserved"),
    ("reserved", 2, "no part of this", "no part of this (?:publication|book|work|document) may be reproduced"),
    ("copyright", 1, "copyright", "copyright (?:c )?(?:by )?[0-9]{4}"),
    ("copyright", 1, "copyrighted", "copyrighted (?:material|work)"),
    ("no-warranty", 1, "without warrant", "without warrant(?:y|ies) of any kind"),
    ("no-warranty", 1, "without any warranty", "without any warranty"),
    ("no-warranty", 1, "provided as is", "provided as is"),
    ("open-source", 1, "open source licen", "open source licen[cs]e"),
    ("commercial", 2, "commercial licen", "commercial licen[cs]e"),
    ("eula", 3, "end user licen", "end user licen[cs]e agreement"),
    ("terms-of-service", 1, "terms of service", "terms of service"),
]


def _label(name: str, version: str) -> str:
    return f"{name}-{version.replace(' ', '.')}" if version else name


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, pattern) in rule order; base phrases first."""
    out = [(label, 1, phrase, phrase) for phrase, label in BASE.items()]
    for label, name, short, versions in FAMILIES:
        # The keyword is outside every group: all alternatives hold it.
        words = re.sub(r"\(\?:.*?\)", " ", name).replace("[cs]e", "").split()
        key = max(words, key=lambda w: (w not in GENERIC, len(w)))
        for version in sorted(versions, key=len, reverse=True):
            number = version.replace(" ", " ?") + ("" if " " in version else "(?: 0)?")
            out.append((_label(label, version), 4, key, f"{name} (?:licen[cs]e )?(?:{short} )?{_VERSION}{number}{_LATER}"))
            out.append((_label(label, version), 3, short, f"{short} ?{_VERSION}{number}{_LATER}"))
        out.append((label, 2, key, f"(?:{_LICENSED})?{name}"))
        out.append((label, 2, short, f"{short} licen[cs]ed?"))
        out.append((label, 3, "spdx", f"spdx licen[cs]e identifier {short}"))
    for label, name, short in COMMONS:
        for version in COMMONS_VERSIONS:
            out.append((_label(label, version), 4, "creative commons", f"creative commons {name}(?: international| unported)? {_VERSION}{version}"))
            out.append((_label(label, version), 3, f"cc {short}", f"cc {short} {version}"))
        out.append((label, 2, "creative commons", f"creative commons {name}(?: licen[cs]e)?"))
        out.append((label, 2, f"cc {short}", f"cc {short}(?: licen[cs]e)?"))
    return out + [(label, priority, key, pattern) for label, priority, key, pattern in SIGNATURES]


RULES = rules()
PRIORITIES = (1, 2, 3, 4)
KEYWORDS = sorted({r[2] for r in RULES})
#: One keyword of each stem: a document that holds none of these holds no keyword at all.
GATE = [k for k in KEYWORDS if not any(g != k and g in k for g in KEYWORDS)]


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def intervals(docs: DataFrame) -> DataFrame:
    """doc_id, row (unique), n_words, found: array of (first, last, rule, priority, base)
    for every match of every rule. Words are counted from 0."""
    by_key = {}  # a keyword is looked for once, whatever the number of its rules
    for i, (_, priority, key, pattern) in enumerate(RULES):
        by_key.setdefault(key, []).append(f"named_struct('no', {i}, 'priority', {priority}, 'pattern', {_literal(f' (?:{pattern})(?= )')})")
    key_array = "array(" + ", ".join(f"named_struct('key', {_literal(k)}, 'rules', array({', '.join(r)}))" for k, r in by_key.items()) + ")"
    held = f"flatten(transform(filter({key_array}, k -> contains(__words, k.key)), k -> k.rules))"
    gate = " or ".join(f"contains(__words, {_literal(k)})" for k in GATE)
    # Pieces between matches and the matches themselves; spaces before a match = its first word.
    places = """transform(
        aggregate(
          zip_with(split(__words, r.pattern, -1), regexp_extract_all(__words, r.pattern, 0), (a, b) -> named_struct('a', a, 'b', b)),
          named_struct('at', 0L, 'out', cast(array() as array<struct<first:bigint,last:bigint>>)),
          (s, x) -> if(x.b is null, s, named_struct(
              'at', s.at + spaces(x.a) + spaces(x.b),
              'out', array_append(s.out, named_struct('first', s.at + spaces(x.a), 'last', s.at + spaces(x.a) + spaces(x.b) - 1))))
        ).out,
        p -> named_struct('first', p.first, 'last', p.last, 'rule', r.no, 'priority', r.priority, 'base', r.no < %d))""" % len(BASE)
    for name in ("x.a", "x.b"):
        places = places.replace(f"spaces({name})", f"cast(length({name}) - length(replace({name}, ' ', '')) as bigint)")
    return (docs.selectExpr("cast(doc_id as long) doc_id", "lower(coalesce(cast(text as string), '')) __text")
            .selectExpr("doc_id", r"concat(' ', trim(regexp_replace(__text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ')), ' ') __words")
            .selectExpr("doc_id", "monotonically_increasing_id() row",
                        "if(__words = '  ', 0L, cast(length(__words) - length(replace(__words, ' ', '')) - 1 as bigint)) n_words",
                        f"case when {gate} then flatten(transform({held}, r -> {places})) end found"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = staged(intervals(docs), "licenses")
    each = found.where("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.*")
    w = (Window.partitionBy("row").orderBy(F.col("first"), F.col("last").desc(), F.col("priority").desc(), F.col("rule"))
         .rowsBetween(Window.unboundedPreceding, -1))
    for p in PRIORITIES:
        each = each.withColumn(f"__end{p}", F.max(F.when(F.col("priority") >= p, F.col("last"))).over(w))
    held = F.coalesce(*[F.when(F.col("priority") == p, F.col(f"__end{p}")) for p in PRIORITIES])
    label = F.element_at(F.array(*[F.lit(r[0]) for r in RULES]), F.col("rule") + 1)
    each = each.withColumn("__kept", F.coalesce(held < F.col("last"), F.lit(True))).withColumn("__label", label)

    def joined(condition):
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("__label")))), ",")

    base, kept = F.col("base"), F.col("__kept")
    per_row = each.groupBy("row").agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(base | kept).alias("labels"),
        F.sum(F.when(kept, F.col("priority")).otherwise(0)).alias("__weight"))
    return (found.select("doc_id", "row", "n_words").join(per_row, "row", "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
                    F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
                    (1 - 1 / (1 + F.coalesce("__weight", F.lit(0)))).cast("double").alias("score")))
