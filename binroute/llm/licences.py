"""Licence statements: a trained paragraph classifier, confirmed by templates.

Paragraphs are lines, and runs of lines without comment marks. A multinomial logistic regression over hashed word unigrams,
bigrams and trigrams tells licence families from one another and from other text;
it is trained here on the templates below, damaged in fixed ways, against a bounded
sample of the corpus' own paragraphs. A probability counts only above a bar that is
calibrated on held-out paragraphs; below it the family is unknown. A prediction is
confirmed if the paragraph has enough of the words of one of the family's templates.
Everything runs on built-in functions and the ML library's transformers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from binroute.sources.scratch import materialize

UNKNOWN = "unknown"
#: Usual statements of public licences (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
}
FAMILIES = (*TEMPLATES, UNKNOWN)
BUCKETS = 1 << 15
#: Bound on the corpus paragraphs that stand for other text in training.
BACKGROUND = 4_000
#: Least share of a template's words that a paragraph must have.
CONFIRMED = 0.6
_WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"


#: Marks of comments before and after the words of a line, and the characters that a line with such marks or blanks begins or ends with.
_BEFORE, _AFTER = r"^\s*(?:<!--|/\*+|\*+/|\*+|//+[!/]*|#+|--+|;+|%+|>+|\.\.|(?i:rem|dnl)\b)?\s*", r"\s*(?:\*+/|-->|\*+|#+)?\s*$"
_BLANKS = " \t\n\x0b\f\r"
_STARTS, _ENDS = [*_BLANKS, *"</*#-;%>.rRdD"], [*_BLANKS, *"/>*#", "\x85", "\u2028", "\u2029"]


def _unmarked(line: Column) -> Column:
    """A line with a letter, without comment marks; few lines begin or end so that they could have any."""
    bare = F.when(F.substring(line, 1, 1).isin(*_STARTS), F.regexp_replace(line, _BEFORE, "")).otherwise(line)
    return F.when(F.substring(line, -1, 1).isin(*_ENDS), F.regexp_replace(bare, _AFTER, "")).otherwise(bare)


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, paragraph, text)`` per line with a letter, and per run of several such lines; lines count from 0.

    A run has the number of its first line, and its lines without comment marks,
    joined by spaces. ``__wrapped`` marks runs; ``__run, __block`` name the run that a
    row belongs to. A line without a letter ends a run. Null and empty texts have none.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    bare = F.transform(lines, lambda line, i: F.when(line.rlike(r"\p{L}"), F.concat(i.cast("string"), F.lit("\x01"), line)).otherwise(""))
    blocks = docs.select(F.col(id_col), F.explode(F.split(F.array_join(bare, "\n"), "\n{2,}")).alias("__block"))
    numbered = F.filter(F.split("__block", "\n"), lambda line: line != "")
    parts = F.transform(numbered, lambda line: F.struct(F.substring_index(line, "\x01", 1).cast("long").alias("paragraph"), line.substr(F.instr(line, "\x01") + 1, F.length(line)).alias("text")))
    # A run is joined once, below the explode; above it, every line of the run would join it again.
    rows = blocks.where(~F.col("__block").isin("", "\n")).select(F.col(id_col), parts.alias("__lines"))
    rows = rows.withColumn("__whole", F.array_join(F.transform("__lines", lambda line: _unmarked(line["text"])), " "))
    rows = rows.select(id_col, "__lines", "__whole", F.col("__lines")[0]["paragraph"].alias("__run"), F.xxhash64("__whole").alias("__block"))
    run = F.array(F.struct(F.col("__run").alias("paragraph"), F.col("__whole").alias("text"), F.lit(True).alias("wrapped")))
    own = F.transform("__lines", lambda line: F.struct(line["paragraph"].alias("paragraph"), line["text"].alias("text"), F.lit(False).alias("wrapped")))
    every = F.when(F.size("__lines") > 1, F.concat(own, run)).otherwise(own)
    named = rows.select(id_col, "__run", "__block", F.explode(every).alias("__p"))
    return named.select(id_col, "__p.paragraph", "__p.text", "__run", "__block", F.col("__p.wrapped").alias("__wrapped"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def vectors(rows: DataFrame) -> DataFrame:
    """``rows`` with ``features``, counts of hashed word n-grams of ``text``; sparse."""
    rows = RegexTokenizer(inputCol="text", outputCol="w1", gaps=False, pattern=_WORD).transform(rows)
    for n in (2, 3):
        rows = NGram(n=n, inputCol="w1", outputCol=f"w{n}").transform(rows)
    grams = rows.withColumn("grams", F.concat("w1", "w2", "w3")).drop("w1", "w2", "w3")
    return HashingTF(numFeatures=BUCKETS, inputCol="grams", outputCol="features", binary=True).transform(grams).drop("grams")


def statements(spark: SparkSession) -> DataFrame:
    """``(text, family)``: every template as it is, without its first or last words, and with words around it."""
    rows = []
    for family, templates in TEMPLATES.items():
        for template in templates:
            words = template.split()
            rows.append((template, family))
            rows.append((template.lower().rstrip("."), family))
            rows.append((template.upper(), family))
            rows.append((f"Copyright (c) 2020 The Authors. {template} All rights reserved.", family))
            rows.append((f"Note that this document is {words[0].lower()} {' '.join(words[1:])}", family))
            if len(words) > 6:
                rows.append((" ".join(words[1:]), family))
                rows.append((" ".join(words[: len(words) - 1]), family))
                rows.append((" ".join(w for i, w in enumerate(words) if i % 7 != 3), family))
    return spark.createDataFrame(rows, "text string, family string")


#: Text about licences that names none (fixed values); it teaches that the word alone does not make a family.
OTHER = (
    "This license is not transferable.", "See the license for details.", "All rights reserved.", "Copyright 2020 The Authors.",
    "The driver has a license.", "Released under a public agreement.", "This work is free.", "Licensed under other terms.",
    "The general public was not admitted.", "The work was published in four versions.", "Version 2.0", "Version 3 of the plan.",
)


@dataclass
class Scanner:
    """A trained model and the probability from which a family counts."""

    model: LogisticRegressionModel
    bar: float

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, paragraph, text, family, probability, template_share, confirmed)`` per paragraph that a family claims.

        Paragraphs of the unknown class are left out. Ties go to the earlier family.
        A run of lines is reported if none of its lines is confirmed alone.
        """
        scored = self.model.transform(vectors(paragraphs(docs, id_col, text_col)))
        # A filter is not pushed below a row number: it would repeat tokenizer, n-grams and model for each of its conditions.
        chances = scored.select(id_col, "paragraph", "text", "__run", "__block", "__wrapped", vector_to_array("probability").alias("p"), F.monotonically_increasing_id().alias("__row"))
        known = F.slice("p", 1, len(TEMPLATES))
        best = chances.withColumn("probability", F.array_max(known)).where((F.col("__row") >= 0) & (F.col("probability") >= self.bar) & (F.array_max("p") == F.col("probability")))
        family = F.element_at(F.lit(list(TEMPLATES)), F.array_position(known, F.col("probability")).cast("int"))
        claimed = best.select(id_col, "paragraph", "text", "__run", "__block", "__wrapped", family.alias("family"), F.round("probability", 6).alias("probability"))
        alone = F.max(F.col("confirmed") & ~F.col("__wrapped")).over(Window.partitionBy(id_col, "__run", "__block"))  # lines of one run
        told = confirm(claimed).withColumn("__alone", alone).where(~(F.col("__wrapped") & F.col("__alone")))
        return told.drop("__run", "__block", "__wrapped", "__alone")


def confirm(claimed: DataFrame) -> DataFrame:
    """Compare paragraphs with the templates of their family by shared words."""
    words = F.array_distinct(_words(F.col("text")))
    known = F.map_from_arrays(F.lit(list(TEMPLATES)), F.array(*[F.array(*[F.lit(sorted(set(_template_words(t)))) for t in own]) for own in TEMPLATES.values()]))
    compared = claimed.withColumns({"__words": words, "__templates": F.element_at(known, F.col("family"))})
    shares = F.transform("__templates", lambda own: F.size(F.array_intersect(F.col("__words"), own)) / F.size(own))
    compared = compared.withColumn("template_share", F.round(F.array_max(shares), 6)).drop("__words", "__templates")
    return compared.withColumn("confirmed", F.col("template_share") >= CONFIRMED)


def _template_words(template: str) -> list[str]:
    import regex

    return regex.findall(_WORD, template.lower())


def train(docs: DataFrame, text_col: str = "text", background: int = BACKGROUND) -> Scanner:
    """Fit on templates and on at most ``background`` paragraphs of the corpus, chosen by hash.

    A fifth of the background and of the variants of templates is held out of the
    fit, never a template as it is; the bar lies
    midway between the most sure mistake on held-out background and the least sure
    held-out statement, and at 0.5 at least. Corpus paragraphs that speak of
    licences or copyright are not used as background.
    """
    spark = docs.sparkSession
    few = F.xxhash64("text")
    every = max(1, docs.count() // background)  # a document has several paragraphs
    # Hashes first: few paragraphs then meet the words.
    lines = paragraphs(docs.withColumn("__id", F.lit(0)), "__id", text_col).select("text").where(F.pmod(few, F.lit(every)) == 0)
    chosen = lines.where(~F.lower("text").rlike("licen[cs]e|copyright|creative commons|spdx|redistribut"))
    other = chosen.select("text", few.alias("h")).distinct().orderBy("h").limit(background).select("text")
    named = spark.createDataFrame([(t,) for t in OTHER], "text string")
    rows = statements(spark).unionByName(other.unionByName(named).withColumn("family", F.lit(UNKNOWN)))
    index = (F.array_position(F.lit(list(FAMILIES)), F.col("family")) - 1).cast("double")
    whole = F.col("text").isin([t for own in TEMPLATES.values() for t in own])  # of each template one variant is fitted at least
    rows = rows.withColumn("label", index).withColumn("held", (F.pmod(F.xxhash64("text", F.lit(7)), F.lit(5)) == 0) & ~whole)
    share = F.when(F.col("family") == UNKNOWN, 1.0).otherwise(5.0)
    made = materialize(vectors(rows).withColumn("weight", share), "licence-training")
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=60, weightCol="weight").fit(made.where(~F.col("held")))
    tested = model.transform(made.where("held")).withColumn("p", vector_to_array("probability"))
    best = F.array_max(F.slice("p", 1, len(TEMPLATES)))
    bounds = tested.agg(F.max(F.when(F.col("family") == UNKNOWN, best)).alias("wrong"), F.min(F.when(F.col("family") != UNKNOWN, best)).alias("right")).first()
    bar = max(0.5, ((bounds["wrong"] or 0.0) + (bounds["right"] or 1.0)) / 2)
    return Scanner(model, bar)
