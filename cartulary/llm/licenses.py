"""License scans by diagonal voting.

All rolling k-grams of a document's words are joined, by hash and words, to the positions they have in license templates.
A match of document position p and template position q votes for the diagonal p - q. Votes are counted per diagonal;
around each one the neighbouring diagonals (words inserted or lost) are merged, and the merged span is verified: the
share of the template's k-grams that it holds, each compared word by word. Of verified spans whose diagonals are
neighbours the best one stays, so what stands beside a license can't hide it. Phrases are templates that must match
whole, on one diagonal.

DataFrame functions only. The templates are fixed, so is the broadcast side's size; matches are grouped by document.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals at most this far from a span's middle one, and spans with at least this share of a template's k-grams, count.
NEAR, LEAST = 8, 0.6

# The phrases, with their labels, that are always reported.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Opening or notice texts of public licenses, with the labels that they add.
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-2-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "gpl-3-line": "this work is licensed under the gnu general public license version 3",
    "cc-by-line": "this work is licensed under a creative commons attribution license",
    "mit-line": "this work is licensed under the mit license",
    "apache-2-line": "this work is licensed under the apache license version 2",
}

SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words. Letters that only Unicode folds stay inside the same words."""
    return F.regexp_extract_all(F.lower(text), F.lit(SPLIT), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """(template, phrase, label, grams, q, gram): every k-gram of every template and phrase, and the mark that ends a
    text (template -1), so that each text meets one row at least."""
    rows = [(p, True, label) for p, label in PHRASES.items()] + [(t, False, label) for label, t in TEMPLATES.items()]
    rows = [(i, phrase, label, len(text.split()) - K + 1, text.split()) for i, (text, phrase, label) in enumerate(rows)]
    columns = [
        F.struct(F.lit(i).alias("template"), F.lit(phrase).alias("phrase"), F.lit(label).alias("label"), F.lit(n).alias("grams"), F.lit(q).alias("q"), F.lit(" ".join(w[q : q + K])).alias("gram"))
        for i, phrase, label, n, w in [*rows, (-1, False, "", 1, [])]
        for q in range(n)
    ]
    return spark.range(1).select(F.inline(F.array(*columns)))


def matches(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, template, phrase, label, grams, p, q): every k-gram of every text that stands in a template, and for each
    text a row of template -1 whose p is the number of its words. The texts are read once."""
    gram = lambda w: F.concat(F.transform(w, lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, K)))), F.array(F.lit("")))
    grams = F.transform(F.array(words(F.col(text))), gram)[0]
    rolled = docs.select(*key, F.posexplode(grams).alias("p", "gram")).withColumn("hash", F.xxhash64("gram"))
    known = F.broadcast(templates(docs.sparkSession).withColumn("hash", F.xxhash64("gram")))  # some hundred rows
    return rolled.join(known, ["hash", "gram"]).drop("hash", "gram")


def spans(docs: DataFrame, key: list[str], text: str = "text", near: int = NEAR, least: float = LEAST) -> DataFrame:
    """(key, label, phrase, first, last, score, rows): every verified place, words from first to last, score the share
    of the template's k-grams found. A row of label '' per key has the text's number of words as first, and how often
    the key's row is repeated as rows. A key must tell texts apart."""
    diagonal = matches(docs, key, text).withColumn("d", F.col("p") - F.col("q"))
    votes = diagonal.groupBy(*key, "template", "phrase", "label", "grams", "d").agg(F.collect_set("q").alias("q"), F.min("p").alias("first"), F.max("p").alias("last"), F.count("*").alias("rows"))
    # a span is the diagonals around one of them: at most grams + 2 * near positions long, whatever else the text holds
    around = Window.partitionBy(*key, "template", "phrase").orderBy("d").rangeBetween(-near, near)
    spanned = votes.withColumns({"own": F.size("q"), "all": F.when(F.col("phrase"), F.col("q")).otherwise(F.array_distinct(F.flatten(F.collect_list("q").over(around))))})
    spanned = spanned.withColumns({f"{c}_span": F.when(F.col("phrase"), F.col(c)).otherwise(f(c).over(around)) for c, f in (("first", F.min), ("last", F.max))})
    rank = F.struct(F.size("all").alias("held"), "own", (-F.col("d")).alias("d"))
    best = spanned.withColumn("rank", rank).where(F.when(F.col("phrase"), F.col("rank.held") == F.col("grams")).otherwise(F.col("rank.held") >= least * F.col("grams")))
    best = best.withColumn("top", F.col("phrase") | (F.col("rank") == F.max("rank").over(around))).where("top")
    return best.select(*key, "label", "phrase", F.col("first_span").alias("first"), (F.col("last_span") + K - 1).alias("last"), (F.col("rank.held") / F.col("grams")).alias("score"), "rows")


def scan(docs: DataFrame, text: str = "text", near: int = NEAR, least: float = LEAST) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document; null text counts
    as empty. Rows are told apart by doc_id and text; repeated rows, also of null ids, each get the same result."""
    docs = docs.select("doc_id", F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = spans(docs.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], "text", near, least)
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base, real = F.when(F.col("phrase"), F.col("first").cast("long")), F.col("label") != ""
    out = found.groupBy("doc_id", "h").agg(
        F.max(F.when(~real, F.col("first"))).cast("long").alias("n_words"), F.max(F.when(~real, F.col("rows"))).alias("rows"),
        F.count_if("phrase").alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), joined(F.when(real, F.col("label"))).alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("score"))), F.lit(0.0)).alias("score"),
    )
    repeated = out.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return repeated.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
