"""License scans: ordered signature rules in DataFrame functions only.

Every rule is a regex with a priority and keywords, one of which each of its
matches holds. A document is looked at closely only if it may match a rule, by
a gate drawn from the rules, and a rule's regex runs only on texts that hold
one of its keywords. Each match is an interval; one that lies within an
interval of the same or a better priority is suppressed. What is left gives the
labels. Everything happens within the row: no shuffle, no Python.

Defined cases: a null text counts as empty; an empty text has no words, no
places, empty labels and score 0; a text of any length is scanned whole; of
equal intervals the better priority stays, then the label that sorts first;
repeated rows each give a row of their own; an empty table gives no rows;
columns of the input other than doc_id and text are ignored, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the contract: word separators of the lower-cased text, phrases and their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
#: The same before lower-casing A-Z.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

#: What may stand for a blank of a name, and for a blank that may be missing.
_G, _G0 = r"[\s,\-_()'\"]{1,4}", r"[\s,\-_()'\"]{0,4}"
#: Label, keywords, SPDX ids, name (a blank is any gap, " ?" a gap or none, {v} the word version or v, or neither), page, whether the name alone tells the license.
LICENSES = (
    ("mit", ("mit",), "mit", "mit(?: expat)?", "opensource.org/licenses/mit", False),
    ("mit-0", ("mit",), "mit-0", "mit(?: 0| no attribution)", "github.com/aws/mit-0", False),
    ("apache-2", ("apache",), "apache-2\\.0", "apache(?: software)?(?: license)?,? ?{v}2(?:\\.0)?", "apache.org/licenses/license-2.0", True),
    ("apache-1.1", ("apache",), "apache-1\\.1", "apache(?: software)?(?: license)?,? ?{v}1\\.1", "apache.org/licenses/license-1.1", True),
    ("gpl-3", ("gpl", "general"), "gpl-3\\.0(?:-only|-or-later|\\+)?", "(?:gnu )?(?:general public licen[cs]e|gpl),? ?{v}3(?:\\.0)?(?: or later|\\+)?", "gnu.org/licenses/gpl-3.0", True),
    ("gpl-2", ("gpl", "general"), "gpl-2\\.0(?:-only|-or-later|\\+)?", "(?:gnu )?(?:general public licen[cs]e|gpl),? ?{v}2(?:\\.0)?(?: or later|\\+)?", "gnu.org/licenses/gpl-2.0", True),
    ("gpl", ("gpl", "general"), "gpl", "(?:gnu (?:general public licen[cs]e|gpl)|gpl)", "gnu.org/licenses/gpl", True),
    ("lgpl-3", ("lgpl", "lesser"), "lgpl-3\\.0(?:-only|-or-later|\\+)?", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?{v}3(?:\\.0)?(?: or later|\\+)?", "gnu.org/licenses/lgpl-3.0", True),
    ("lgpl-2.1", ("lgpl", "lesser"), "lgpl-2\\.1(?:-only|-or-later|\\+)?", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl),? ?{v}2\\.1(?: or later|\\+)?", "gnu.org/licenses/lgpl-2.1", True),
    ("lgpl", ("lgpl", "lesser"), "lgpl", "(?:gnu )?(?:lesser general public licen[cs]e|lgpl)", "gnu.org/licenses/lgpl", True),
    ("agpl-3", ("agpl", "affero"), "agpl-3\\.0(?:-only|-or-later|\\+)?", "(?:gnu )?(?:affero general public licen[cs]e|agpl)(?:,? ?{v}3(?:\\.0)?)?(?: or later|\\+)?", "gnu.org/licenses/agpl", True),
    ("gfdl", ("gfdl", "documentation"), "gfdl-1\\.[123](?:-only|-or-later)?", "(?:gnu free documentation licen[cs]e|gfdl)", "gnu.org/licenses/fdl", True),
    ("bsd-2", ("bsd",), "bsd-2-clause", "(?:(?:simplified|2 clause|two clause) bsd|bsd 2 clause)", "opensource.org/licenses/bsd-2-clause", True),
    ("bsd-3", ("bsd",), "bsd-3-clause", "(?:(?:new|modified|revised|3 clause|three clause) bsd|bsd 3 clause)", "opensource.org/licenses/bsd-3-clause", True),
    ("bsd-4", ("bsd",), "bsd-4-clause", "(?:(?:original|4 clause|four clause) bsd|bsd 4 clause)", "directory.fsf.org/wiki/license:bsd-4clause", True),
    ("bsd", ("bsd",), "0bsd", "(?:0 ?)?bsd(?: style)?", "opensource.org/licenses/bsd", False),
    ("isc", ("isc",), "isc", "isc", "opensource.org/licenses/isc", False),
    ("mpl-2", ("mpl", "mozilla"), "mpl-2\\.0", "(?:mozilla public licen[cs]e|mpl),? ?{v}2(?:\\.0)?", "mozilla.org/mpl/2.0", True),
    ("mpl-1.1", ("mpl", "mozilla"), "mpl-1\\.1", "(?:mozilla public licen[cs]e|mpl),? ?{v}1\\.1", "mozilla.org/mpl/1.1", True),
    ("epl-2", ("epl", "eclipse"), "epl-2\\.0", "(?:eclipse public licen[cs]e|epl),? ?{v}2(?:\\.0)?", "eclipse.org/legal/epl-2.0", True),
    ("epl-1", ("epl", "eclipse"), "epl-1\\.0", "(?:eclipse public licen[cs]e|epl),? ?{v}1(?:\\.0)?", "eclipse.org/legal/epl-v10", True),
    ("cddl", ("cddl", "distribution"), "cddl-1\\.[01]", "(?:common development and distribution licen[cs]e|cddl)", "opensource.org/licenses/cddl", True),
    ("cc0", ("cc0", "commons"), "cc0-1\\.0", "(?:cc0(?: 1\\.0)?|creative commons zero)", "creativecommons.org/publicdomain/zero", True),
    ("cc-by-4", ("cc", "commons"), "cc-by-4\\.0", "(?:cc by|creative commons attribution) 4\\.0", "creativecommons.org/licenses/by/4.0", True),
    ("cc-by-3", ("cc", "commons"), "cc-by-3\\.0", "(?:cc by|creative commons attribution) 3\\.0", "creativecommons.org/licenses/by/3.0", True),
    ("cc-by", ("cc", "commons"), "cc-by", "(?:cc by|creative commons attribution)", "creativecommons.org/licenses/by/", True),
    ("cc-by-sa", ("cc", "commons"), "cc-by-sa-[1234]\\.[05]", "(?:cc by sa|creative commons attribution share ?alike)(?: [1234]\\.[05])?", "creativecommons.org/licenses/by-sa", True),
    ("cc-by-nd", ("cc", "commons"), "cc-by-nd-[1234]\\.[05]", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1234]\\.[05])?", "creativecommons.org/licenses/by-nd", True),
    ("cc-by-nc", ("cc", "commons"), "cc-by-nc-[1234]\\.[05]", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1234]\\.[05])?", "creativecommons.org/licenses/by-nc/", True),
    ("cc-by-nc-sa", ("cc", "commons"), "cc-by-nc-sa-[1234]\\.[05]", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1234]\\.[05])?", "creativecommons.org/licenses/by-nc-sa", True),
    ("cc-by-nc-nd", ("cc", "commons"), "cc-by-nc-nd-[1234]\\.[05]", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1234]\\.[05])?", "creativecommons.org/licenses/by-nc-nd", True),
    ("unlicense", ("unlicense",), "unlicense", "unlicense", "unlicense.org", True),
    ("wtfpl", ("wtfpl", "what"), "wtfpl", "(?:wtfpl|do what the fuck you want to public licen[cs]e)", "wtfpl.net", True),
    ("zlib", ("zlib",), "zlib", "zlib(?: libpng)?", "opensource.org/licenses/zlib", False),
    ("artistic-2", ("artistic",), "artistic-2\\.0", "artistic licen[cs]e,? ?{v}2(?:\\.0)?", "opensource.org/licenses/artistic-2.0", True),
    ("artistic", ("artistic",), "artistic-1\\.0", "artistic", "opensource.org/licenses/artistic", False),
    ("boost", ("boost",), "bsl-1\\.0", "boost software licen[cs]e(?:,? ?{v}1\\.0)?", "boost.org/license_1_0", True),
    ("python", ("python", "psf"), "python-2\\.0", "(?:python(?: software foundation)?|psf)", "python.org/psf/license", False),
    ("ruby", ("ruby",), "ruby", "ruby", "ruby-lang.org/en/about/license", False),
    ("php", ("php",), "php-3\\.01?", "php", "php.net/license", False),
    ("openssl", ("openssl",), "openssl", "openssl", "openssl.org/source/license", False),
    ("postgresql", ("postgresql",), "postgresql", "postgresql", "postgresql.org/about/licence", False),
    ("ofl", ("font", "ofl"), "ofl-1\\.[01]", "(?:(?:sil )?open font licen[cs]e|sil ofl)", "scripts.sil.org/ofl", True),
    ("eupl", ("eupl", "european"), "eupl-1\\.[0123]", "(?:european union public licen[cs]e|eupl)(?:,? ?{v}1\\.[0123])?", "eupl.eu", True),
    ("ms-pl", ("ms", "microsoft"), "ms-pl", "(?:microsoft public licen[cs]e|ms pl)", "opensource.org/licenses/ms-pl", False),
    ("odbl", ("odbl", "database"), "odbl-1\\.0", "(?:(?:open data commons )?open database licen[cs]e|odbl)", "opendatacommons.org/licenses/odbl", True),
    ("odc-by", ("odc", "commons"), "odc-by-1\\.0", "(?:odc by|open data commons attribution licen[cs]e)", "opendatacommons.org/licenses/by", False),
    ("bigscience-rail", ("rail",), "bigscience-bloom-rail-1\\.0", "(?:bigscience )?(?:open ?)?rail(?: m)?", "bigscience.huggingface.co/blog/the-bigscience-rail-license", False),
)
#: Sentences of the licenses themselves: label, keyword, regex
TEXTS = (
    ("apache-2", "licen", "licensed under the apache license, version 2\\.0 \\(? ?the license"),
    ("apache-2", "licen", "you may not use this file except in compliance with the license"),
    ("gpl", "licen", "redistribute it and/?(?: ?or)? modify it under the terms of the gnu general public license"),
    ("lgpl", "licen", "redistribute it and/?(?: ?or)? modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "licen", "redistribute it and/?(?: ?or)? modify it under the terms of the gnu affero general public license"),
    ("gfdl", "licen", "permission is granted to copy, distribute and/?(?: ?or)? modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "licen", "this source code form is subject to the terms of the mozilla public license,? v\\. ?2\\.0"),
    ("epl-2", "licen", "made available under the terms of the eclipse public license ?v?\\.? ?2\\.0"),
    ("cddl", "licen", "subject to the terms of the common development and distribution license"),
    ("boost", "licen", "distributed under the boost software license,? version 1\\.0"),
    ("cc-by", "licen", "this work is licensed under a creative commons attribution(?: [1234]\\.[05])?(?: international)? license"),
    ("cc-by-sa", "licen", "this work is licensed under a creative commons attribution share ?alike(?: [1234]\\.[05])?(?: international)? license"),
    ("cc-by-nc", "licen", "this work is licensed under a creative commons attribution non ?commercial(?: [1234]\\.[05])?(?: international)? license"),
    ("ofl", "licen", "this font software is licensed under the sil open font license"),
    ("artistic", "licen", "you may redistribute (?:it|this software) under the same terms as perl itself|the artistic license"),
    ("python", "licen", "python software foundation license(?: version 2)?"),
    ("openssl", "licen", "this product includes software developed by the openssl project|openssl and ssleay license"),
    ("unlicense", "domain", "free and unencumbered software released into the public domain"),
    ("bsd-3", "redistribution", "redistribution and use in source and binary forms,? with or without modification,? are permitted"),
    ("mit", "permission", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("isc", "permission", "permission to use, copy, modify, and/?(?: ?or)? distribute this software for any purpose with or without fee"),
    ("zlib", "permission", "permission is granted to anyone to use this software for any purpose"),
)
#: Statements that name no license: label, keyword, regex
GENERAL = (
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("public-domain", "domain", "(?:in|into|to) the public domain"),
    ("proprietary", "proprietary", "proprietary (?:and confidential|software|licen[cs]e)"),
    ("non-commercial", "commercial", "for non ?commercial (?:use|purposes) only"),
    ("copyright-notice", "copyright", "copyright ?(?:c |©)? ?(?:19|20)\\d\\d"),
    ("no-warranty", "warrant", "without (?:any )?warranty of any kind"),
    ("bsd-text", "redistribution", "redistribution and use in source and binary forms"),
    ("mit-text", "permission", "permission is hereby granted, free of charge, to any person"),
    ("isc-text", "permission", "permission to use, copy, modify, and/?(?: ?or)? distribute this software"),
    ("copyleft", "copyleft", "copyleft"),
)
_GRANT = r"(?:licen[cs]ed|released|distributed|published|available|provided|redistribute it) under (?:the )?(?:terms of (?:the )?)?"
#: Abbreviations that tell a license: literals that are rare, and others with what must follow.
_RARE = ("apache", "bsd", "cddl", "commons", "eupl", "gfdl", "gpl", "odbl", "sil", "wtfpl")
_SHORT = (("mpl", r"(?<!\w)mpl[\s,\-_()'\".v]{0,9}(?:version)?[\s,\-_()'\"]{0,4}[12]"), ("epl", r"(?<!\w)epl[\s,\-_()'\".v]{0,9}(?:version)?[\s,\-_()'\"]{0,4}[12]"), ("cc", r"(?<!\w)cc(?:0|[\s,\-_()'\"]{1,4}by)"))
_END = r"(?![\w-]|\.\d)"


def _gapped(name: str) -> str:
    return name.replace("{v}", r"(?:version |v\.? ?)?").replace(" ?", _G0).replace(" ", _G)


Rule = tuple[int, tuple[str, ...], str, str]


def rules() -> list[Rule]:
    """(priority, keywords, label, regex), best priority (0) first."""
    made: list[Rule] = []
    for label, words, spdx, name, page, alone in LICENSES:
        name = _gapped(name)
        made += [
            (0, ("spdx",), label, rf"spdx-license-identifier:\s*{spdx}(?![\w.+-])"),
            (0, (page,), label, page.replace(".", r"\.")),
            (1, words, label, rf"(?<!\w){_gapped(_GRANT)}{name}{_END}"),
            (2, words, label, rf"(?<!\w){name}{_G}(?:public{_G})?licen[cs]e(?!\w)"),
            (2, words, label, rf"(?<!\w)licen[cs]e\s*[:=]\s*{name}{_END}"),
            (2, words, label, rf"(?<!\w){name}{_G}licen[cs]ed(?!\w)"),
        ]
        if alone:
            made.append((2, words, label, rf"(?<!\w){name}{_END}"))
    made += [(1, (word,), label, rf"(?<!\w)(?:{_gapped(rx)})(?!\w)") for label, word, rx in TEXTS]
    made += [(3, (word,), label, rf"(?<!\w){_gapped(rx)}(?!\w)") for label, word, rx in GENERAL]
    return sorted(made, key=lambda r: r[0])


def _gate(low: Column) -> Column:
    """Whether any rule may match: every match holds `licen`, a page, an abbreviation, or a grant's, a sentence's or a general statement's words."""
    literals = ["licen", *_RARE, *sorted({page for *_, page, _ in LICENSES if "licen" not in page})]
    sentences = [(word, _gapped(rx)) for _, word, rx in (*TEXTS, *GENERAL) if word != "licen"]
    gate = F.lit(False)
    for word in literals:
        gate = gate | F.contains(low, F.lit(word))
    for word, rx in (("under", _gapped(_GRANT)), *_SHORT, *sentences):
        gate = gate | (F.contains(low, F.lit(word)) & F.rlike(low, F.lit(rx)))
    return gate


#: What a label of each priority is worth.
WEIGHTS = {0: 0.95, 1: 0.9, 2: 0.7, 3: 0.4}


def _base_regex(phrase: str) -> str:
    """The phrase's words with separators between; the literal first word leads, so that the regex engine can skip ahead."""
    word = SEPARATORS.replace("[", "[^", 1)
    first, _, rest = phrase.partition(" ")
    return rf"{first}(?<!{word}{first}){SEPARATORS}+" + rest.replace(" ", f"{SEPARATORS}+") + rf"(?!{word})"


def _pieces(text: Column, regex: str) -> Column:
    return F.split(text, F.lit(regex), -1)


def _count_words(parts: Column) -> Column:
    """Words between the separators that a text was split at: all pieces but an empty first and last one."""
    empty = F.lit("")
    return F.size(parts) - (parts[0] == empty).cast("int") - ((F.size(parts) > 1) & (F.element_at(parts, -1) == empty)).cast("int")


def _intervals(low: Column, rule: Column) -> Column:
    """Every match of the rule as (start, -end, priority, label)."""
    found = F.regexp_extract_all(low, rule["regex"], F.lit(0))
    between = F.split(low, rule["regex"], -1)
    empty = F.array().cast("array<struct<start:int,neg_end:int,priority:int,label:string>>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), (-end).alias("neg_end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.when(pair["hit"].isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(one))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    pairs = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(pairs, start, step, lambda s: s["out"]))


def _kept(found: Column) -> Column:
    """Labels and priorities of the intervals that no interval of the same or a better priority contains."""
    levels = sorted(WEIGHTS)
    kind = "array<struct<priority:int,label:string>>"
    start = F.struct(*[F.lit(-1).alias(f"e{k}") for k in levels], F.array().cast(kind).alias("out"))

    def step(state: Column, x: Column) -> Column:
        end = -x["neg_end"]
        inside = F.lit(False)
        for k in levels:
            inside = inside | ((F.lit(k) <= x["priority"]) & (state[f"e{k}"] >= end))
        ends = [F.when((x["priority"] == k) & (state[f"e{k}"] < end), end).otherwise(state[f"e{k}"]).alias(f"e{k}") for k in levels]
        one = F.struct(x["priority"].alias("priority"), x["label"].alias("label"))
        return F.struct(*ends, F.when(inside | F.array_contains(state["out"], one), state["out"]).otherwise(F.concat(state["out"], F.array(one))).alias("out"))

    return F.aggregate(F.sort_array(found), start, step, lambda s: s["out"])


def _any(low: Column, words: tuple[str, ...]) -> Column:
    found = F.contains(low, F.lit(words[0]))
    for word in words[1:]:
        found = found | F.contains(low, F.lit(word))
    return found


def _lower(text: Column) -> Column:
    """A-Z in lower case; other letters may be so too, but none becomes a letter of a-z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))  # the signs whose lower case holds one
    return F.when(odd, F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: words, places of the base phrases, labels, score."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    every = "(?:" + "|".join(map(_base_regex, BASE_PHRASES.values())) + ")"
    ordered = rules()

    df = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("low", _lower(F.col("text")))
    low = F.col("low")
    gate = _gate(low)
    near = F.rlike("low", F.lit(rf"cc{SEPARATORS}+by{SEPARATORS}+nc")) | F.contains(low, F.lit("license"))
    # split() is linear in the text; the regexp_extract_all family copies the text for every match.
    df = df.select("doc_id", _pieces(F.col("text"), f"{RAW_SEPARATORS}+").alias("parts"), F.when(gate | near, low).alias("low"), near.alias("near"))
    df = df.select("doc_id", _count_words(F.col("parts")).cast("long").alias("n_words"), "low", "near")

    counts = {k: F.when(F.col("near"), F.size(_pieces(low, _base_regex(p))) - 1).otherwise(0) for k, p in BASE_PHRASES.items()}
    df = df.select("*", *[n.alias(f"n_{k}") for k, n in counts.items()])
    n_base = sum((F.col(f"n_{k}") for k in BASE_PHRASES), F.lit(0))
    base = F.array_compact(F.array(*[F.when(F.col(f"n_{k}") > 0, F.lit(k)) for k in sorted(BASE_PHRASES)]))
    # every rule's pattern is a literal here, compiled once; only rules that do match are run again for their places
    matched = F.array_compact(F.array(*[F.when(_any(low, words) & F.rlike(low, F.lit(rx)), F.struct(F.lit(p).alias("priority"), F.lit(n).alias("label"), F.lit(rx).alias("regex"))) for p, words, n, rx in ordered]))
    df = df.select("doc_id", "n_words", "low", n_base.cast("long").alias("n_base"), base.alias("base"), F.when(low.isNotNull(), matched).alias("matched"))
    found = F.flatten(F.transform("matched", lambda r: _intervals(low, r)))
    df = df.select("doc_id", "n_words", "low", "n_base", "base", F.when(low.isNotNull(), _kept(found)).alias("kept"))

    has = F.col("n_base") > 0
    here = F.when(has, low)
    before = F.length(_pieces(here, every)[0])
    until = F.length(low) - F.length(F.element_at(_pieces(here, f"(?={every})"), -1))
    df = df.select("*", _pieces(F.substring(here, F.lit(1), before), f"{SEPARATORS}+").alias("before"), _pieces(F.substring(here, F.lit(1), until), f"{SEPARATORS}+").alias("until"))
    best = F.array_min(F.transform("kept", lambda k: k["priority"]))
    labels = F.array_sort(F.array_union("base", F.coalesce(F.transform("kept", lambda k: k["label"]), F.array().cast("array<string>"))))
    score = F.when(has, F.lit(1.0))
    for k, v in WEIGHTS.items():
        score = score.when(best == k, F.lit(v))
    return df.select(
        "doc_id", "n_words", "n_base",
        F.when(has, _count_words(F.col("before"))).cast("long").alias("first_word"),
        F.when(has, _count_words(F.col("until"))).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.otherwise(F.lit(0.0)).alias("score"),
    )
