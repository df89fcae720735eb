"""License scan by diagonal voting, in DataFrame expressions only.

The rolling word k-grams of every text are hashed and joined to the positions of the same gram in the
templates: 2-grams for templates of fewer than LONG words, 4-grams for longer ones. (Grams whose hash
no template has are left out before they become rows, as a semi-join would.) A hit votes for the
diagonal text position minus template position; votes are pre-aggregated; diagonals within SLACK of
the smallest one of a span are merged to bridge inserted or missing words; a span counts when its
hits, taken in the template's order and the text's, cover enough of the template. A hit holds only if
the gram's words themselves are equal, so no hash collision survives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Phrases that count wherever their words stand consecutively, with their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
# Opening or typical words of public licenses, with labels of our own.
TEMPLATES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("gnu general public license as published by the free software foundation", "gpl-notice"),
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("all rights reserved", "all-rights-reserved"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
     "merchantability fitness for a particular purpose and noninfringement", "mit-text"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under "
     "the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-2.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation either version 3 of the license or at your option any later version", "gpl-3.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
     "that the above copyright notice and this permission notice appear in all copies", "isc"),
]
#: What stands between words: every ASCII character but letters and digits, one by one, which Java tests by a table. Beyond ASCII all are letters.
SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
BETWEEN = "[" + "".join(f"\\x{ord(c):02X}" for c in SEPARATORS) + "]+"
#: Diagonals this near to a span's smallest one belong to it; a span counts from this share of its template's grams.
SLACK, COVERAGE = 3, 0.9
#: Templates of so many words are found by 4-grams, others by 2-grams.
LONG = 12


def _grams(base: list, templates: list) -> list[tuple[int, str, str, str, bool, int, int]]:
    """k, gram, phrase, label, is_base, grams of the phrase, position."""
    rows = []
    for is_base, (phrase, label) in [(True, x) for x in base] + [(False, x) for x in templates]:
        w = phrase.split(" ")
        k = 4 if len(w) >= LONG and not is_base else 2
        rows += [(k, " ".join(w[i : i + k]), phrase, label, is_base, len(w) - k + 1, i) for i in range(len(w) - k + 1)]
    return rows


def _found(docs: DataFrame, base: list, templates: list) -> DataFrame:
    """key, doc_id, n_words, grams: one row a document, with the (k, pos, gram) that some template has. The only reading of the texts."""
    spark = docs.sparkSession
    rows = _grams(base, templates)
    # two characters beyond ASCII become ASCII letters in lower(): they are to stay what they are, a letter of no template
    text = F.coalesce("text", F.lit(""))
    for c in ("\u212a", "\u0130"):
        text = F.replace(text, F.lit(c), F.lit("\ufffd"))
    text = F.btrim(F.lower(text), F.lit(SEPARATORS))
    out = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, BETWEEN)).alias("w"))
    every = []
    for k in sorted({r[0] for r in rows}):
        known = spark.sql(f"SELECT DISTINCT xxhash64({', '.join(f'w{i}' for i in range(k))}) AS h FROM VALUES " + ", ".join("('" + "', '".join(r[1].split(" ")) + "')" for r in rows if r[0] == k) + f" AS t({', '.join(f'w{i}' for i in range(k))}) ORDER BY h")
        hashes = ", ".join(f"{r[0]}L" for r in known.collect())
        at = f"filter(if(size(w) < {k}, cast(array() as array<int>), sequence(0, size(w) - {k})), i -> xxhash64({', '.join(f'w[i + {i}]' if i else 'w[i]' for i in range(k))}) IN ({hashes}))"
        every.append(f"transform({at}, i -> named_struct('k', {k}, 'pos', i, 'gram', array_join(slice(w, i + 1, {k}), ' ')))")
    grams = f"concat({', '.join(every)})" if every else "cast(array() as array<struct<k:int,pos:int,gram:string>>)"
    return out.select("key", "doc_id", F.size("w").cast("long").alias("n_words"), F.expr(grams).alias("grams"))


def _spans(found: DataFrame, base: list, templates: list, slack: int, coverage: float) -> DataFrame:
    spark = found.sparkSession
    rows = _grams(base, templates)
    values = ", ".join(f"({k}, '{gram}', '{phrase}', '{label}', {str(is_base).lower()}, {n}, {at})" for k, gram, phrase, label, is_base, n, at in rows)
    table = spark.sql(f"SELECT *, xxhash64(t_gram) AS t_hash FROM VALUES {values} AS t(t_k, t_gram, phrase, label, is_base, t_grams, t_pos)")
    table = F.broadcast(table)  # the fixed list
    rolled = found.select("key", "doc_id", F.explode("grams").alias("g")).select("key", "doc_id", "g.*")
    hits = rolled.join(table, (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")) & (F.col("k") == F.col("t_k")))
    place = ["key", "doc_id", "phrase", "label", "is_base"]
    votes = hits.groupBy(*place, "k", "t_grams", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(F.collect_set("t_pos").alias("at"))
    line = Window.partitionBy(*place).orderBy("diagonal").rangeBetween(0, slack)
    near = votes.withColumn("near", F.when(F.col("is_base"), F.array(F.struct("diagonal", "at"))).otherwise(F.collect_list(F.struct("diagonal", "at")).over(line)))
    # hits in the template's order, of which each must stand behind the one before it in the text
    ordered = near.withColumn("hits", F.expr("array_sort(flatten(transform(near, n -> transform(n.at, t -> named_struct('t', t, 'pos', t + n.diagonal)))))"))
    walk = F.expr("""
        aggregate(hits, named_struct('t', -1, 'pos', -1, 'first', -1, 'n', 0),
                  (s, x) -> if(x.t > s.t AND x.pos > s.pos, named_struct('t', x.t, 'pos', x.pos, 'first', if(s.n = 0, x.pos, s.first), 'n', s.n + 1), s))
    """)
    spans = ordered.withColumn("s", walk).select(*place, "diagonal", F.col("s.first").cast("long").alias("first"), (F.col("s.pos") + F.col("k") - 1).cast("long").alias("last"), (F.col("s.n") / F.col("t_grams")).alias("covered"))
    spans = spans.withColumn("verified", F.col("covered") >= F.when(F.col("is_base"), 1.0).otherwise(coverage))
    # a span that a span of the same template overlaps from the left is the same place
    before = F.lag("last").over(Window.partitionBy(*place, "verified").orderBy("first", F.col("last").desc(), "diagonal"))
    spans = spans.withColumn("_before", before)
    return spans.where(~F.col("verified") | F.col("is_base") | F.col("_before").isNull() | (F.col("first") > F.col("_before"))).drop("_before", "diagonal")


def scan(docs: DataFrame, base: list = BASE, templates: list = TEMPLATES, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """Spans found: key (a number of the row), doc_id, phrase, label, is_base, first, last (word numbers from 0), covered (0 to 1), verified.

    Base phrases only with all words in place; other templates from ``coverage`` of their grams, in
    order, with shifts of ``slack`` words in all. Spans below that are returned with their share, so
    that a score can use it. Repeated rows have spans of their own; null texts have none.
    """
    return _spans(cut(_found(docs, base, templates)), base, templates, slack, coverage)


def license_labels(docs: DataFrame, base: list = BASE, templates: list = TEMPLATES, slack: int = SLACK, coverage: float = COVERAGE) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of base phrases; first_word and last_word are their smallest and largest
    start (null without any). Labels are distinct, sorted and comma-joined, empty without any. score is
    1 with a verified span, else the largest share of a template that was seen. Null text is empty.
    Repeated rows give repeated results; a null doc_id stays null; other columns are not read.
    """
    rows = cut(_found(docs, base, templates))
    start = F.when(F.col("verified") & F.col("is_base"), F.col("first"))
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = _spans(rows, base, templates, slack, coverage).groupBy("key").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        join(F.when(start.isNotNull(), F.col("label"))).alias("base_labels"), join(F.when(F.col("verified"), F.col("label"))).alias("labels"),
        F.max(F.when(F.col("verified"), 1.0).otherwise(F.least(F.col("covered"), F.lit(0.99)))).alias("score"),
    )
    out = rows.drop("grams").join(found, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
