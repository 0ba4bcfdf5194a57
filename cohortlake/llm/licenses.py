"""License scans: ordered signature rules behind a keyword prefilter, native Spark.

A text becomes its words, lower-cased and without punctuation, each between two spaces of its own.
A rule is a label, a priority, a confidence, a regular expression over such words and the keywords
without which it can't match.  A document's words are met with all keywords once; only the rules
whose keywords are all there run their expression.  Detections are word intervals; one inside an
interval of the same or a better priority is suppressed (of equal intervals the first rule stays).

Base phrases are places where a phrase's words stand in a row.  They are reported beside the
detections, whatever those say, and their labels stay.

Nulls and empties: a null or empty text has no words and no detections; repeated rows each get
their own result.  Input columns named like the added ones give way to them, others pass through.
"""

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, LOWER, ascii_lower, table, without

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
PHRASE_SCORE = 0.5

# Fixed values of the rules: a licence's label, the words of its identifier, and its name as a
# regular expression.  Its whole words outside brackets are its keywords.
NAMES = [
    ("0bsd", "0bsd", "zero clause bsd"),
    ("afl-3.0", "afl 3 0", "academic free (license )?(licence )?(version |v )?3( 0)?"),
    ("agpl-1.0", "agpl 1 0", "affero general public license (version |v )?1( 0)?"),
    ("agpl-3.0", "agpl 3 0", "(gnu )?affero general public license (version |v )?3( 0)?"),
    ("apache-1.1", "apache 1 1", "apache (software )?(license )?(version |v )?1 1"),
    ("apache-2.0", "apache 2 0", "apache (software )?(license )?(licence )?(version |v )?2( 0)?"),
    ("apsl-2.0", "apsl 2 0", "apple public source (license )?(version |v )?2( 0)?"),
    ("artistic-1.0", "artistic 1 0", "artistic license (version |v )?1( 0)?"),
    ("artistic-2.0", "artistic 2 0", "artistic license (version |v )?2( 0)?"),
    ("beerware", "beerware", "beer ware license"),
    ("blueoak-1.0.0", "blueoak 1 0 0", "blue oak model license (version )?1( 0)?( 0)?"),
    ("bsd-1-clause", "bsd 1 clause", "(1 |one )clause bsd"),
    ("bsd-2-clause", "bsd 2 clause", "(2 clause |two clause |simplified |freebsd )bsd"),
    ("bsd-3-clause", "bsd 3 clause", "(3 clause |three clause |new |modified |revised )bsd"),
    ("bsd-4-clause", "bsd 4 clause", "(4 clause |four clause |original )bsd"),
    ("bsl-1.0", "bsl 1 0", "boost software license( version)?( 1)?( 0)?"),
    ("busl-1.1", "busl 1 1", "business source license( version)?( 1)?( 1)?"),
    ("cddl-1.0", "cddl 1 0", "common development and distribution license( version)?( 1)?( 0)?"),
    ("cecill-2.1", "cecill 2 1", "cecill (free software )?(license )?(agreement )?(version |v )?2( 1)?"),
    ("cpl-1.0", "cpl 1 0", "common public license( version)?( 1)?( 0)?"),
    ("ecl-2.0", "ecl 2 0", "educational community license( version)?( 2)?( 0)?"),
    ("epl-1.0", "epl 1 0", "eclipse public license (version |v )?1( 0)?"),
    ("epl-2.0", "epl 2 0", "eclipse public license (version |v )?2( 0)?"),
    ("eupl-1.1", "eupl 1 1", "european union public licen[cs]e (version |v )?1 1"),
    ("eupl-1.2", "eupl 1 2", "european union public licen[cs]e (version |v )?1 2"),
    ("gfdl-1.2", "gfdl 1 2", "free documentation license (version |v )?1 2"),
    ("gfdl-1.3", "gfdl 1 3", "free documentation license (version |v )?1 3"),
    ("gpl-1.0", "gpl 1 0", "(gnu )?general public license (version |v )?1( 0)?"),
    ("gpl-2.0", "gpl 2 0", "(gnu )?general public license (version |v )?2( 0)?"),
    ("gpl-3.0", "gpl 3 0", "(gnu )?general public license (version |v )?3( 0)?"),
    ("isc", "isc", "isc licen[cs]e"),
    ("json", "json license", "json license"),
    ("lgpl-2.0", "lgpl 2 0", "(gnu )?library general public license (version |v )?2( 0)?"),
    ("lgpl-2.1", "lgpl 2 1", "(gnu )?lesser general public license (version |v )?2 1"),
    ("lgpl-3.0", "lgpl 3 0", "(gnu )?lesser general public license (version |v )?3( 0)?"),
    ("libpng", "libpng", "libpng license"),
    ("lppl-1.3c", "lppl 1 3c", "latex project public license( version)?( 1)?( 3c)?"),
    ("mit", "mit", "mit licen[cs]e"),
    ("mit-0", "mit 0", "mit no attribution"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license (version |v )?1 1"),
    ("mpl-2.0", "mpl 2 0", "mozilla public license (version |v )?2( 0)?"),
    ("ms-pl", "ms pl", "microsoft public license"),
    ("ms-rl", "ms rl", "microsoft reciprocal license"),
    ("mulanpsl-2.0", "mulanpsl 2 0", "mulan permissive software license( version)?( 2)?( 0)?"),
    ("ncsa", "ncsa", "ncsa (open source )?license"),
    ("odbl-1.0", "odbl 1 0", "open database license( version)?( 1)?( 0)?"),
    ("ofl-1.1", "ofl 1 1", "sil open font license( version)?( 1)?( 1)?"),
    ("openssl", "openssl", "openssl license"),
    ("osl-3.0", "osl 3 0", "open software license (version |v )?3( 0)?"),
    ("pddl-1.0", "pddl 1 0", "public domain dedication and license( version)?( 1)?( 0)?"),
    ("php-3.01", "php 3 01", "php license (version |v )?3( 01)?"),
    ("postgresql", "postgresql", "postgresql license"),
    ("psf-2.0", "psf 2 0", "python software foundation license( version)?( 2)?( 0)?"),
    ("ruby", "ruby license", "ruby license"),
    ("sspl-1.0", "sspl 1 0", "server side public license( version)?( 1)?( 0)?"),
    ("unlicense", "unlicense", "the unlicense"),
    ("upl-1.0", "upl 1 0", "universal permissive license( version)?( 1)?( 0)?"),
    ("vim", "vim license", "vim license"),
    ("w3c", "w3c", "w3c software (notice and )?(document )?license"),
    ("wtfpl", "wtfpl", "do what the fuck you want to public license"),
    ("x11", "x11", "x11 license"),
    ("zlib", "zlib", "zlib (libpng )?license"),
    ("zpl-2.1", "zpl 2 1", "zope public license (version |v )?2( 1)?"),
]
#: Forms in which a licence is named: priority, confidence, expression, keywords of its own.
FORMS = [
    (1, 1.0, "spdx license identifier {id}( only| or later)?", ["spdx", "identifier"]),
    (2, 0.9, "(licensed|licenced|released|distributed|published|available|covered|provided) (under|by) (the )?(terms of )?(the )?(terms of )?(the )?{name}", []),
    (2, 0.9, "licen[cs]ed? (is )?{id}", []),
    (2, 0.8, "opensource org licen[cs]es {id}", ["opensource", "org"]),
    (2, 0.8, "spdx org licen[cs]es {id}", ["spdx", "org"]),
    (3, 0.6, "{name}", []),
]
# Creative Commons: kinds with their letters and their words, by version.
COMMONS = [("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(ative)?s"), ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"), ("by nc nd", "attribution non ?commercial no ?deriv(ative)?s")]
VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Whole-text clauses and notices: label, priority, confidence, expression, keywords.
CLAUSES = [
    ("cc0-1.0", 1, 1.0, "spdx license identifier cc0 1 0", ["spdx", "cc0"]),
    ("cc0-1.0", 2, 0.9, "cc0 (1 0 )?universal", ["cc0", "universal"]),
    ("cc0-1.0", 2, 0.8, "creativecommons org publicdomain zero 1 0", ["creativecommons", "publicdomain", "zero"]),
    ("public-domain", 3, 0.6, "(released|placed|dedicated|is|are) (into |in |to )?(the )?public domain", ["public", "domain"]),
    ("public-domain", 3, 0.7, "creativecommons org publicdomain mark 1 0", ["creativecommons", "publicdomain", "mark"]),
    ("mit", 2, 0.9, "permission is hereby granted free of charge to any person obtaining a copy", ["permission", "hereby", "granted", "charge", "obtaining"]),
    ("isc", 2, 0.9, "permission to use copy modify and or distribute this software for any purpose", ["permission", "copy", "modify", "distribute", "purpose"]),
    ("bsd", 2, 0.9, "redistribution and use in source and binary forms with or without modification", ["redistribution", "binary", "forms", "modification"]),
    ("apache-2.0", 2, 0.9, "you may not use this file except in compliance with the license", ["file", "except", "compliance"]),
    ("gpl", 2, 0.8, "free software you can redistribute it and or modify it under the terms of the gnu general public license", ["redistribute", "modify", "gnu", "general", "public"]),
    ("lgpl", 2, 0.8, "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ["redistribute", "modify", "gnu", "lesser"]),
    ("mpl-2.0", 2, 0.9, "this source code form is subject to the terms of the mozilla public license", ["source", "form", "subject", "mozilla"]),
    ("zlib", 2, 0.9, "this software is provided as is without any express or implied warranty", ["provided", "express", "implied", "warranty"]),
    ("unlicense", 2, 0.9, "free and unencumbered software released into the public domain", ["unencumbered", "released", "domain"]),
    ("bsl-1.0", 2, 0.9, "obtaining a copy of the software and accompanying documentation covered by this license", ["obtaining", "accompanying", "covered"]),
    ("wtfpl", 2, 0.8, "you just do what the fuck you want to", ["just", "fuck", "want"]),
    ("mit", 3, 0.6, "expat licen[cs]e", []),
    ("bsd", 3, 0.6, "bsd licen[cs]e", []),
    ("cc0-1.0", 3, 0.6, "creative commons zero", []),
    ("gpl", 4, 0.5, "gnu gpl", []),
    ("gpl-2.0", 4, 0.5, "gplv2", []),
    ("gpl-3.0", 4, 0.5, "gplv3", []),
    ("proprietary", 3, 0.6, "(proprietary and confidential|confidential and proprietary)", ["proprietary", "confidential"]),
    ("proprietary", 3, 0.6, "unauthorized (copying|use|reproduction|distribution)", []),
    ("proprietary", 3, 0.6, "unauthorised (copying|use|reproduction|distribution)", []),
    ("no-reuse", 3, 0.6, "(may not|must not) be (reproduced|copied|redistributed|republished|rewritten)", ["not", "be"]),
    ("no-reuse", 3, 0.6, "without (the )?(prior )?(express )?(written )?(permission|consent)", ["without"]),
    ("non-commercial", 3, 0.6, "non ?commercial (use|purposes) only", ["only"]),
    ("copyright", 4, 0.4, "copyright (c )?(by )?[12][09][0-9][0-9]( [12][09][0-9][0-9])?", ["copyright"]),
    ("copyright", 4, 0.3, "c (19|20)[0-9][0-9]", []),
    ("copyright", 4, 0.3, "© (19|20)[0-9][0-9]", ["©"]),
    ("copyright", 4, 0.3, "copyright (notice|holder|owner|holders|owners)", ["copyright"]),
    ("trademark", 4, 0.3, "(registered )?trademarks? of", ["of"]),
    ("warranty", 4, 0.3, "without (any )?warrant(y|ies)( of any kind)?", ["without"]),
]


def needed(pattern: str) -> list[str]:
    """Words that stand whole in every match.  A bracket of whole words goes; one inside a word spoils it."""
    whole = lambda m: "" if all(x.startswith(" ") or x.endswith(" ") for x in m[1].split("|")) else "*"
    return [w for w in re.sub(r"\(([^()]*)\)\??", whole, pattern.replace(" ?", "*")).split() if w.isalnum()]


def compile_rules() -> list[tuple]:
    """Rows (id, label, priority, confidence, pattern over spaced words, keywords), in order of priority."""
    rules = []
    for label, words, name in NAMES:
        for priority, confidence, form, keywords in FORMS:
            rules.append((label, priority, confidence, form.format(id=words, name=name), keywords))
    for letters, words in COMMONS:
        for version in VERSIONS:
            label = f"cc-{letters} {version.replace(' ', '.')}".replace(" ", "-")
            rules.append((label, 1, 1.0, f"spdx license identifier cc {letters} {version}", ["spdx"]))
            rules.append((label, 2, 0.9, f"creativecommons org licenses {letters} {version}", ["creativecommons"]))
            rules.append((label, 2, 0.9, f"creative commons {words} {version}( international| unported| generic)?", ["creative", "commons"]))
            rules.append((label, 3, 0.8, f"cc {letters} {version}", ["cc"]))
    rules += CLAUSES
    rules = sorted(rules, key=lambda r: r[1])
    out = []
    for i, (label, priority, confidence, pattern, keywords) in enumerate(rules):
        # "share ?alike" stands for one word or two: a space of a rule is two in the text.
        spaced = pattern.replace(" ?", "(  )?").replace(" ", "  ").replace("(    )?", "(  )?")
        keys = sorted({*keywords, *needed(pattern)})
        if not keys:
            raise ValueError(f"a rule needs a keyword: {pattern}")
        out.append((i, label, priority, confidence, f" {spaced} ", keys))
    return out


RULES = compile_rules()
FIELDS = "struct<id:int,label:string,priority:int,confidence:double,pattern:string,keywords:array<string>>"
FOUND = "array<struct<start:int,end:int,label:string,priority:int,confidence:double,rule:int>>"


def literal(rules: list[tuple]) -> Column:
    """The rules as one constant array, made when the plan is."""
    names = ("id", "label", "priority", "confidence", "pattern", "keywords")
    return F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rules])), f"array<{FIELDS}>")


def places(words: str, phrase: str) -> Column:
    """Word numbers at which the words of a phrase stand in a row."""
    def fits(w: Column, i: Column) -> Column:
        out = w == phrase.split()[0]
        for k, x in enumerate(phrase.split()[1:], 1):
            out &= F.coalesce(F.get(words, i + k) == x, F.lit(False))
        return F.when(out, i)

    return F.array_compact(F.transform(words, fits))


def intervals(spaced: Column, pattern: Column) -> Column:
    """Word intervals (start, end) of all matches; a word has two spaces in the spaced text."""
    held = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    found = F.regexp_extract_all(spaced, pattern, F.lit(0))
    pairs = F.arrays_zip(F.slice(F.split(spaced, pattern, -1), 1, F.size(found)).alias("p"), found.alias("m"))

    def add(a: Column, x: Column) -> Column:
        start = (a["at"] + held(x["p"]) / 2).cast("int")
        end = (start + held(x["m"]) / 2).cast("int")
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("out")), add)["out"]


def standing(found: Column, levels: int) -> Column:
    """Detections less those inside an interval of the same or a better priority.

    In order of start, falling end, priority and rule, whatever covers a detection comes before it;
    the furthest end of each priority and all better ones is all that has to be known of those.
    """
    by = F.transform(found, lambda d: F.struct(d["start"], (-d["end"]).alias("back"), d["priority"], d["rule"], d.alias("d")))
    order = F.transform(F.array_sort(by), lambda x: x["d"])
    state = F.struct(F.array_repeat(F.lit(-1), levels).alias("ends"), F.array().cast(FOUND).alias("out"))

    def step(a: Column, d: Column) -> Column:
        ends = F.transform(a["ends"], lambda e, i: F.when(i + 1 >= d["priority"], F.greatest(e, d["end"])).otherwise(e))
        kept = F.when(F.get(a["ends"], d["priority"] - 1) >= d["end"], a["out"]).otherwise(F.concat(a["out"], F.array(d)))
        return F.struct(ends.alias("ends"), kept.alias("out"))

    return F.aggregate(order, state, step)["out"]


def scan(docs: DataFrame, rules: list[tuple] = RULES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """``docs`` with n_words, ``base`` (start, label of each phrase) and ``detections`` (word intervals)."""
    docs = without(docs, "n_words", "base", "detections")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(row.alias("row"), F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SPLIT), lambda w: w != "").alias("w"))
    keys = sorted({k for r in rules for k in r[5]} | {k for p, _ in phrases for k in p.split()})
    rows = rows.select("row", "w", F.array_intersect("w", F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("hits"))
    has = lambda words: F.forall(words, lambda k: F.array_contains("hits", k))
    able = F.when(F.size("hits") > 0, F.filter(literal(rules), lambda r: has(r["keywords"]))).otherwise(F.array().cast(f"array<{FIELDS}>"))
    at = lambda p, label: F.transform(F.when(has(F.array(*map(F.lit, p.split()))), places("w", p)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))
    base = F.array_sort(F.concat(F.array().cast("array<struct<start:int,label:string>>"), *(at(p, label) for p, label in phrases)))
    rows = rows.select("row", "w", able.alias("able"), base.alias("base"))
    spaced = F.when(F.size("able") > 0, F.concat(F.lit(" "), F.array_join("w", "  "), F.lit(" "))).otherwise(F.lit(""))
    rows = rows.select("row", F.size("w").cast("long").alias("n_words"), "able", "base", spaced.alias("spaced"))
    of_rule = lambda r: F.transform(intervals(F.col("spaced"), r["pattern"]), lambda m: F.struct(m["start"], m["end"], r["label"].alias("label"), r["priority"].alias("priority"), r["confidence"].alias("confidence"), r["id"].alias("rule")))
    found = F.when(F.size("able") > 0, F.flatten(F.transform("able", of_rule))).otherwise(F.array().cast(FOUND))
    rows = rows.select("row", "n_words", "base", found.alias("found"))
    levels = max((r[2] for r in rules), default=1)
    kept = F.when(F.size("found") > 0, standing(F.col("found"), levels)).otherwise(F.array().cast(FOUND))
    rows = rows.select("row", "n_words", "base", kept.alias("detections"))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns), "n_words", "base", "detections")


def op12_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    own, starts = F.col("base.label"), F.col("base.start")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.when(F.size("base") > 0, PHRASE_SCORE).otherwise(0.0), F.coalesce(F.array_max(F.col("detections.confidence")), F.lit(0.0)))
    return docs.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(own).alias("base_labels"), joined(F.concat(own, F.col("detections.label"))).alias("labels"), score.alias("score"),
    )


def sql(rules: list[tuple] = RULES, phrases: list[tuple[str, str]] = PHRASES) -> str:
    """The query in SQL: all rules with all keywords present, positions by summed pieces, suppression by a pair test."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {text(label)}, {p}, {c}::DOUBLE, {text(x)}, [{', '.join(map(text, keys))}])" for i, label, p, c, x, keys in rules)
    stands = " UNION ALL ".join(
        f"SELECT doc_id, i, {text(label)} AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE {' AND '.join(f'w[i + {k}] = {text(x)}' for k, x in enumerate(p.split()))}" for p, label in phrases
    )
    return f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPLIT}'), lambda x: x <> '') AS w FROM documents),
base AS ({stands}),
r(id, label, priority, confidence, pattern, keywords) AS (VALUES {values}),
t AS (SELECT doc_id, ' ' || array_to_string(w, '  ') || ' ' AS s, w FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, s, id, label, priority, confidence, pattern, regexp_extract_all(s, pattern) AS found FROM t JOIN r ON list_has_all(w, keywords)),
p AS (SELECT doc_id, id, label, priority, confidence, k, found, string_split_regex(s, pattern) AS pieces FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m WHERE len(found) > 0)),
n AS (SELECT *, list_sum(list_transform(pieces[1:k], lambda x: length(x) - length(replace(x, ' ', '')))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x) - length(replace(x, ' ', '')))), 0) AS a,
             length(found[k]) - length(replace(found[k], ' ', '')) AS l FROM p),
x AS (SELECT doc_id, id, label, priority, confidence, a, a + l AS z FROM n),
s AS (SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM x AS y WHERE y.doc_id = x.doc_id AND y.a <= x.a AND y.z >= x.z
        AND (y.priority < x.priority OR (y.priority = x.priority AND (y.z - y.a > x.z - x.a OR y.id < x.id))))),
bs AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS z, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
ds AS (SELECT doc_id, list(DISTINCT label) AS labels, max(confidence) AS top FROM s GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(bs.n, 0) AS n_base, bs.a AS first_word, bs.z AS last_word,
  array_to_string(list_sort(coalesce(bs.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ds.labels, [])))), ',') AS labels,
  greatest(CASE WHEN bs.n > 0 THEN {PHRASE_SCORE} ELSE 0 END, coalesce(top, 0))::DOUBLE AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN ds USING (doc_id)
"""


OP12_SQL = sql()
