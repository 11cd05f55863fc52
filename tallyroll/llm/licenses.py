"""License scans by diagonal voting, in DataFrame operations only.

Every text is cut into words and all its pairs of neighbouring words are joined, by hash and by the words themselves, with
the word pairs of templates (phrases and notices of known licenses). A hit votes for its diagonal: word number in the
text less word number in the template. Votes are added up by diagonal, diagonals of a template close to each other are
merged into one span, as inserted or lost words move a copy from one diagonal to the next, and spans are verified: a
phrase has to stand whole on one diagonal, a notice has to show enough different word pairs of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Diagonals of a template at most so many words apart are one span.
SLACK = 4
#: Part of a notice's word pairs that a span must show.
COVER = 0.6
#: (label, phrase); the first three are the base (fixed values).
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
PHRASES = [
    ("apache", "apache license"), ("mit", "mit license"), ("bsd", "bsd license"), ("mpl", "mozilla public license"),
    ("public-domain", "public domain dedication"), ("unlicense", "released into the public domain"),
]
#: Opening notices of public licenses (fixed values).
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
            "publish distribute sublicense and or sell copies of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by "
               "applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
            "published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
            "that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
]
#: Stray word pairs of a notice: diagonals with fewer votes have none.
VOTES = 2
#: Word pairs shown are kept as bits of one long.
LONGEST = 64
#: Stands for the text itself among its word pairs; no word holds a slash.
SELF = "/"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _pairs(words: Column) -> Column:
    """(at, a, b) for every pair of neighbouring words."""
    return F.when(F.size(words) > 1, F.transform(
        F.sequence(F.lit(0), F.size(words) - 2),
        lambda i: F.struct(i.cast("int").alias("at"), F.get(words, i).alias("a"), F.get(words, i + 1).alias("b")))).otherwise(F.array().cast(
            "array<struct<at:int,a:string,b:string>>"))


def templates(spark: SparkSession) -> DataFrame:
    """number, label, whole, base, total, t_at, a, b: one row for each word pair; and the row that stands for a text itself.

    The table is made of the constants above alone, so its size is bounded.
    """
    rows = [(label, text, True, True) for label, text in BASE] + [(label, text, True, False) for label, text in PHRASES] + [
        (label, text, False, False) for label, text in NOTICES]
    if any(len(text.split()) > LONGEST for _, text, _, _ in rows):
        raise ValueError(f"a template holds at most {LONGEST} words")
    made = F.array(*[F.struct(
        F.lit(k).alias("number"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(whole).alias("whole"), F.lit(base).alias("base"))
        for k, (label, text, whole, base) in enumerate(rows)])
    known = spark.range(1).select(F.inline(made)).withColumn("words", words_of(F.col("text"))).select(
        "number", "label", "whole", "base", (F.size("words") - 1).alias("total"), F.explode(_pairs(F.col("words"))).alias("p"))
    known = known.select("number", "label", "whole", "base", "total", F.col("p.at").alias("t_at"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    own = spark.range(1).select(
        F.lit(-1).alias("number"), F.lit("").alias("label"), F.lit(False).alias("whole"), F.lit(False).alias("base"), F.lit(0).alias("total"),
        F.lit(0).alias("t_at"), F.lit(SELF).alias("a"), F.lit(SELF).alias("b"))
    return known.unionByName(own)


def votes(docs: DataFrame) -> DataFrame:
    """row, doc_id, number, ..., at, t_at: every word pair of every text that a template has, and one row for the text itself.

    ``row`` tells texts apart, also repeated ones. The text's own row has number -1 and its word count as ``at``.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words_of(F.col("text")).alias("words"))
    own = F.array(F.struct(F.size("words").alias("at"), F.lit(SELF).alias("a"), F.lit(SELF).alias("b")))
    pairs = words.select("row", "doc_id", F.explode(F.concat(own, _pairs(F.col("words")))).alias("p")).select(
        "row", "doc_id", F.col("p.at").alias("at"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    known = templates(docs.sparkSession).withColumn("h", F.xxhash64("a", "b"))
    return pairs.withColumn("h", F.xxhash64("a", "b")).join(F.broadcast(known), ["h", "a", "b"]).drop("h", "a", "b")


def spans(docs: DataFrame, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """row, doc_id, label, base, first, last, n, score: the verified spans of each text, and its own row (label null, n words).

    A phrase's row holds all its ``n`` places, from the first to the last start; a notice's row one span.
    """
    keys = ["row", "doc_id", "number", "label", "whole", "base", "total"]
    # One shuffle, by the text, for all that follows: no more than a text's own hits meet in one place.
    lines = votes(docs).repartition("row").groupBy(*keys, (F.col("at") - F.col("t_at")).alias("diagonal")).agg(
        F.count("*").alias("hits"), F.min("at").alias("first"), F.max("at").alias("last"), F.expr("bit_or(shiftleft(1L, t_at))").alias("shown"))
    own, notice = F.col("number") < 0, F.expr("not whole and number >= 0")
    # A phrase stands whole where its diagonal has all its word pairs.
    lines = lines.filter(own | F.expr("whole and hits = total") | (notice & (F.col("hits") >= VOTES)))
    by_diagonal = Window.partitionBy("row", "number").orderBy("diagonal")
    apart = notice & (F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > slack)
    merged = lines.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("span", F.sum("apart").over(by_diagonal)).groupBy(*keys, "span").agg(
        F.min(F.when(F.col("whole"), F.col("diagonal")).otherwise(F.col("first"))).alias("first"),
        F.max(F.when(F.col("whole"), F.col("diagonal")).otherwise(F.col("last"))).alias("last"),
        F.count("*").alias("n"), F.expr("bit_count(bit_or(shown))").alias("shown"))
    score = F.when(own, F.lit(0.0)).when(F.col("whole"), F.lit(1.0)).otherwise(F.col("shown") / F.col("total"))
    return merged.withColumn("score", score).filter(own | (F.col("score") >= cover)).select(
        "row", "doc_id", F.when(~own, F.col("label")).alias("label"), "base", F.when(~own, F.col("first")).alias("first"), F.when(~own, F.col("last")).alias("last"),
        F.when(own, F.col("first")).when(F.col("whole"), F.col("n")).otherwise(F.lit(1)).cast("long").alias("n"), "score")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every text.

    ``docs``: doc_id, text; whole texts. A null text is empty and has no words, no labels and the score 0; repeated rows and
    null ids give a row each; texts may have any length. Labels are distinct, sorted and joined by commas; the score is the
    part of its template that the best span shows, 1 for a phrase.
    """
    found = spans(docs)
    base = F.col("base") & F.col("label").isNotNull()
    joined = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    return found.groupBy("row", "doc_id").agg(
        F.sum(F.when(F.col("label").isNull(), F.col("n"))).alias("n_words"),
        F.coalesce(F.sum(F.when(base, F.col("n"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("score").alias("score")).drop("row")


ORACLE = """
with known(number, label, phrase, whole, base) as (values %s),
    cut as (select row_number() over () as r, doc_id,
              regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '%s') as w from documents),
    pieces as (select number, label, whole, base, string_split(phrase, ' ') as w from known),
    pairs as (select number, label, whole, base, len(w) - 1 as total, k, w[k] as a, w[k + 1] as b from (select *, unnest(range(1, len(w))) as k from pieces)),
    texts as (select r, k, w[k] as a, w[k + 1] as b from (select r, w, unnest(range(1, len(w))) as k from cut)),
    -- Phrases are found as whole slices of the word list.
    starts as (select r, label, base, t.k - 1 as start, 1.0 as score
               from texts t join pieces p on p.whole and p.w[1] = t.a and p.w[2] = t.b join cut using (r) where cut.w[t.k : t.k + len(p.w) - 1] = p.w),
    lines as (select r, number, label, total, t.k - p.k as d, list(p.k) as shown from texts t join pairs p using (a, b) where not whole group by all having count(*) >= 2),
    marked as (select *, d - lag(d) over (partition by r, number order by d) as gap from lines),
    numbered as (select *, count(*) filter (gap is null or gap > 4) over (partition by r, number order by d) as span from marked),
    notices as (select r, label, list_unique(flatten(list(shown))) / total as score from numbered group by r, number, label, total, span),
    found as (select r, label, base, start, score from starts union all select r, label, false, null, score from notices where score >= 0.6)
select any_value(doc_id) as doc_id, cast(any_value(len(w)) as bigint) as n_words, count(start) filter (base) as n_base,
  min(start) filter (base) as first_word, max(start) filter (base) as last_word,
  coalesce(array_to_string(list_sort(list(distinct label) filter (base)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list(distinct label) filter (label is not null)), ','), '') as labels,
  cast(coalesce(max(score), 0) as double) as score
from cut left join found using (r) group by r
""" % (", ".join(f"({k}, '{label}', '{text}', {whole}, {base})" for k, (label, text, whole, base) in enumerate(
    [(*x, True, True) for x in BASE] + [(*x, True, False) for x in PHRASES] + [(*x, False, False) for x in NOTICES])), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
