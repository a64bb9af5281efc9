"""License scans by diagonal voting over rolling word k-grams.

Words are lower-cased runs of letters, digits and characters beyond ASCII. Each
document's rolling k-gram hashes are joined to the positions at which the
templates have them, and the words of each hit are held against the template's.
A hit votes for a diagonal: its position in the document less that in the
template. Votes are added up by diagonal, neighbouring diagonals of one template
are merged (words put in or left out move a match to the next diagonal), and a
span is verified by the different positions of its template that were met: it
stands if they are enough.

Phrases (templates of ``exact``) must be met word for word on one diagonal.
Names of licenses are short templates of short k-grams; what tells one license
from another in a template is marked and must be met unchanged.
Everything runs as DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Passages of public licenses, openings first, and their labels. Words in braces must be met unchanged.
TEMPLATES = (
    ("licensed under the {apache license} version 2 0 the license you may not use this file except in compliance with the license", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0-1.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0"),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "apache-2.0"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a {particular purpose and noninfringement}", "mit"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "bsd"),
    ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "isc"),
    ("is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {gnu general public license} for more details", "gpl"),
    ("is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {gnu lesser general public license} for more details", "lgpl"),
    ("the licenses for most software are designed to take away your freedom to share and change it by contrast the {gnu general public license} is intended to guarantee your freedom to share and change free software", "gpl-2.0"),
    ("the {gnu general public license} is a free copyleft license for software and other kinds of works", "gpl-3.0"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2.0"),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "unlicense"),
    ("the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights", "cc0-1.0"),
)
# One-line references and their labels. Words in braces must be met unchanged, with what lies between.
NAMES = (
    *((f"licensed under the {{{name}}} version {{{v}}}", label) for name, v, label in (
        ("apache license", "2 0", "apache-2.0"), ("apache license", "2", "apache-2.0"), ("mozilla public license", "2 0", "mpl-2.0"),
        *((f"gnu {kind}general public license", v, f"{short}gpl-{v.replace(' ', '.') if ' ' in v else v + '.0'}") for kind, short in (("", ""), ("lesser ", "l"), ("affero ", "a")) for v in ("2", "2 1", "3") if (short, v) not in (("", "2 1"), ("l", "2"), ("a", "2"), ("a", "2 1"))),
    )),
    *((f"{{{text}}}", label) for label, texts in (
        ("mit", ("the mit license", "under mit license", "under an mit license", "is mit licensed", "mit license copyright", "identifier mit")),
        ("apache-2.0", ("apache license 2 0", "apache license v2", "apache license v2 0", "apache software license 2 0", "apache 2 0 license", "identifier apache 2 0")),
        ("bsd", ("bsd license", "bsd 2 clause", "bsd 3 clause", "2 clause bsd", "3 clause bsd")),
        ("isc", ("the isc license", "under isc license", "isc license copyright", "identifier isc")),
        ("gpl-2.0", ("gnu general public license 2", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gnu gplv2", "identifier gpl 2 0")),
        ("gpl-3.0", ("gnu general public license 3", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gnu gplv3", "identifier gpl 3 0")),
        ("lgpl-2.1", ("gnu lesser general public license 2 1", "gnu lesser general public license v2 1", "identifier lgpl 2 1")),
        ("lgpl-3.0", ("gnu lesser general public license 3", "gnu lesser general public license v3", "identifier lgpl 3 0")),
        ("agpl-3.0", ("gnu affero general public license 3", "gnu affero general public license v3", "identifier agpl 3 0")),
        ("mpl-2.0", ("mozilla public license 2 0", "mozilla public license v2 0", "mozilla public license v 2 0", "identifier mpl 2 0")),
        *((f"cc-by{'-' * bool(kind)}{kind.replace(' ', '-')}-4.0", (" ".join(f"cc by {kind} 4 0".split()), " ".join(f"creative commons attribution {long} 4 0".split()))) for kind, long in (("", ""), ("nc", "noncommercial"), ("sa", "sharealike"), ("nd", "noderivatives"), ("nc sa", "noncommercial sharealike"), ("nc nd", "noncommercial noderivatives"))),
        ("unlicense", ("the unlicense", "identifier unlicense")),
        ("cc0-1.0", ("cc0 1 0", "creative commons zero")),
    ) for text in texts),
)
#: Words of a k-gram; names are too short for the templates'.
PHRASE_GRAM, TEMPLATE_GRAM = 2, 4
NAME_GRAM = PHRASE_GRAM
#: Diagonals this near are one match.
NEAR = 3
#: Share of a template's k-grams that a span needs.
COVERAGE = 0.6
_CUT = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: str) -> str:
    """SQL: the words of a text. Lower-casing beyond ASCII doesn't move a word's bounds; the one sign that would become an ASCII letter, U+212A, is put aside first."""
    return f"filter(split(lower(replace({text}, '\u212a', '\ufffd')), '{_CUT}', -1), w -> w != '')"


def _grams(hashes: str, k: int) -> str:
    """SQL: the hashes of rolling k-grams, from the hashes of the words; none if there are fewer words."""
    parts = ", ".join(f"element_at({hashes}, i + {j})" for j in range(k))
    return f"IF(size({hashes}) >= {k}, transform(sequence(1, size({hashes}) - {k - 1}), i -> xxhash64({k}, {parts})), CAST(array() AS ARRAY<BIGINT>))"


def _marked(text: str, k: int) -> tuple[str, list[int]]:
    """A template without its braces, and the k-grams it must be met with: those within braces, or the one that ends with shorter ones."""
    words, needed, start = [], [], 0
    for w in text.split():
        if w.startswith("{"):
            start = len(words)
        words.append(w.strip("{}"))
        if w.endswith("}"):
            needed += range(max(0, min(start, len(words) - k)), len(words) - k + 1)
    return " ".join(words), sorted({*needed})


def template_table(spark: SparkSession, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, names: tuple = NAMES) -> DataFrame:
    """gram, its words, template, at, label, exact, k, grams (how many the template has), needed and bit (marks of those it must be met with), one row per template k-gram. Its size is the templates'."""
    lines = []
    for i, (text, label) in enumerate((*phrases, *templates, *names)):
        k = PHRASE_GRAM if i < len(phrases) else TEMPLATE_GRAM if i < len(phrases) + len(templates) else NAME_GRAM
        plain, needed = _marked(text, k)
        lines.append(f"{plain}\t{label}\t{i < len(phrases)}\t{k}\t{' '.join(map(str, needed))}")
    # one literal: a row of literals for each template would be compiled to code of that size
    rows = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(lines)), "\n")).alias("template", "line")).withColumn("f", F.split("line", "\t"))
    field = lambda i: F.element_at("f", i)
    must = F.transform(F.filter(F.split(field(5), " "), lambda w: w != ""), lambda w: w.cast("int"))
    rows = rows.select("template", field(1).alias("text"), field(2).alias("label"), field(3).cast("boolean").alias("exact"), field(4).cast("int").alias("k"), must.alias("must"))
    rows = rows.withColumn("w", F.expr(_words("text"))).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    grams = F.when(F.col("k") == PHRASE_GRAM, F.expr(_grams("h", PHRASE_GRAM))).otherwise(F.expr(_grams("h", TEMPLATE_GRAM)))
    listed = rows.withColumn("g", grams).select("template", "label", "exact", "k", "must", "w", F.size("g").alias("grams"), F.posexplode("g").alias("at", "gram"))
    bit = F.expr("CASE WHEN array_position(must, at) > 0 THEN shiftleft(1L, CAST(array_position(must, at) AS INT) - 1) ELSE 0L END")
    return listed.select("template", "label", "exact", "k", "grams", "at", "gram", F.expr("array_join(slice(w, at + 1, k), ' ')").alias("said"), F.expr("shiftleft(1L, size(must)) - 1L").alias("needed"), bit.alias("bit"))


def license_scan(df: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", names: tuple = NAMES) -> DataFrame:
    """For every row doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and ``spans``.

    n_base counts the places of phrases, first_word and last_word are the least
    and greatest of their starts in words from 0 (null without any).
    base_labels has the phrases' labels and labels also the templates', both
    distinct, sorted and comma-joined ('' without any). score is the best share
    of a template's different k-grams met, 1 for a phrase, 0 for none. spans
    lists label, first word, end word and share of each match, in that order. A null text is empty.
    Repeated rows and null doc_ids stay apart; an empty table gives an empty
    result; other columns aren't read.
    """
    spark = df.sparkSession
    docs = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.expr(_words(f"coalesce(`{text_col}`, '')")).alias("w")).withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    # a zero before the k-grams meets a template row of its own, so that every document stays in the one pass
    size = F.size("h")
    grams = docs.select("rid", "doc_id", "w", size.cast("long").alias("n_words"), F.greatest(size - (PHRASE_GRAM - 1), F.lit(0)).alias("n_short"), F.expr(f"concat(array(0L), {_grams('h', PHRASE_GRAM)}, {_grams('h', TEMPLATE_GRAM)})").alias("g"))
    # outer, though g is never empty: else Spark would filter by g's size first and work out the hashes anew for each k-gram
    rolling = grams.select("rid", "doc_id", "w", "n_words", "n_short", F.posexplode_outer("g").alias("i", "gram"))
    nothing = {"template": F.lit(-1), "label": F.lit(""), "exact": F.lit(False), "k": F.lit(PHRASE_GRAM), "grams": F.lit(1), "at": F.lit(0), "gram": F.lit(0).cast("long"), "said": F.lit(""), "needed": F.lit(0).cast("long"), "bit": F.lit(0).cast("long")}
    held = spark.range(1).select(*(c.alias(n) for n, c in nothing.items()))
    # broadcast: a row for each k-gram of the templates, which don't grow with the data
    hits = rolling.join(F.broadcast(template_table(spark, phrases, templates, names).unionByName(held)), "gram")
    # index in g -> word position: the short k-grams first, then the templates'
    word = F.when(F.col("template") < 0, 0).when(F.col("k") == PHRASE_GRAM, F.col("i") - 1).otherwise(F.col("i") - 1 - F.col("n_short"))
    found = hits.withColumn("word", word)
    # a hash is only a hint: the words themselves must be the template's
    met = (F.col("template") < 0) | (F.array_join(F.slice("w", F.col("word") + 1, F.col("k")), " ") == F.col("said"))
    placed = found.where(met).select("rid", "doc_id", "n_words", "template", "label", "exact", "k", "grams", "needed", "bit", "at", "word", (F.col("word") - F.col("at")).alias("diagonal")).repartition("rid")
    keys = ["rid", "doc_id", "n_words", "template", "label", "exact", "k", "grams", "needed"]
    # a diagonal meets each position of its template once at most
    voted = placed.groupBy(*keys, "diagonal").agg(F.collect_list("at").alias("at"), F.min("word").alias("first"), F.max("word").alias("last"), F.bit_or("bit").alias("met"))
    # neighbours in order of diagonal fall into one match while the gap stays small; phrases aren't merged
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    apart = F.col("exact") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEAR, F.lit(True))
    runs = voted.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy(*keys, "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("positions"), F.min("first").alias("first"), F.max("last").alias("last"), F.bit_or("met").alias("met"))
    share = F.col("positions") / F.col("grams")
    stands = (F.col("template") >= 0) & F.when(F.col("exact"), share == 1).otherwise((share >= coverage) & (F.col("met") == F.col("needed")))
    span = F.when(stands, F.struct("label", "first", (F.col("last") + F.col("k")).alias("end"), share.alias("share")))
    base = F.when(stands & F.col("exact"), F.col("first").cast("long"))
    per = merged.withColumn("span", span).withColumn("base", base).withColumn("base_label", F.when(F.col("base").isNotNull(), F.col("label"))).groupBy("rid", "doc_id", "n_words").agg(
        F.count("base").alias("n_base"), F.min("base").alias("first_word"), F.max("base").alias("last_word"), F.collect_set("base_label").alias("base_labels"), F.collect_set("span.label").alias("labels"), F.coalesce(F.max("span.share"), F.lit(0.0)).alias("score"), F.sort_array(F.collect_list("span")).alias("spans")
    )
    joined = lambda c: F.array_join(F.sort_array(c), ",").alias(c)
    return per.select("doc_id", "n_words", "n_base", "first_word", "last_word", joined("base_labels"), joined("labels"), "score", "spans")
