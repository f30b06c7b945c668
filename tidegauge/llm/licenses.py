"""License scans by diagonal voting.

Every pair of neighbouring words of a text is hashed and equi-joined with the
positions of the same pair in a set of templates.  Each hit votes for a
diagonal, the offset between the word's place in the text and in the template.
Votes of one diagonal mean an unbroken copy; neighbouring diagonals, as a word
that was put in or left out makes them, are merged into a strip of bounded
width.  A strip is verified by an ordered alignment: the longest chain of its
hits that rises in the text and in the template, so that a template place counts
once, however often its words are repeated.

Short phrases are templates too, and stand where one diagonal holds all their
pairs.  The join compares the words beside the hash, so every vote is exact.
Templates of up to ``BROADCAST_PAIRS`` word pairs are broadcast; votes are gathered by
diagonal, a template's length at most, and pairs that hit nothing never leave
their task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.text import joined, words

#: So many word pairs of templates are broadcast, some 10 MB; more are joined as Spark sees fit.
BROADCAST_PAIRS = 100_000

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Sentences of the licenses' own notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0 you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
}


def template_positions(spark: SparkSession, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(tid, label, exact, pairs, tpos, left, right): a row for each pair of neighbouring words of each template."""
    rows = []
    for tid, (body, label, exact) in enumerate([(p, x, True) for p, x in phrases.items()] + [(p, x, False) for p, x in notices.items()]):
        w = body.split()
        if len(w) < 2:
            raise ValueError(f"a template needs two words: {body!r}")
        rows += [(tid, label, exact, len(w) - 1, i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    out = spark.createDataFrame(rows, "tid int, label string, exact boolean, pairs int, tpos int, left string, right string")
    return F.broadcast(out) if len(rows) <= BROADCAST_PAIRS else out


def votes(docs: DataFrame, templates: DataFrame, *, keep: list[str], text: str) -> DataFrame:
    """Votes by row, template and diagonal, beside one row without a template for every distinct row.

    Rows are told apart by ``keep`` and a digest of the text; ``copies`` counts
    the repeated ones.  ``places`` are the template places that voted.
    """
    base = docs.select(*[F.col(c).alias(f"keep_{c}") for c in keep], F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"), words(F.col(text)).alias("w"))
    n = F.size("w")
    grams = F.zip_with(F.slice("w", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    first = F.array(F.struct(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))
    keys = [*[f"keep_{c}" for c in keep], "digest", "n_words"]
    rolled = base.select(*keys[:-1], n.cast("long").alias("n_words"), F.posexplode(F.concat(first, grams)).alias("at", "g"))
    rolled = rolled.select(*keys, (F.col("at") - 1).alias("pos"), F.xxhash64("g.a", "g.b").alias("hash"), F.col("g.a").alias("a"), F.col("g.b").alias("b"))
    known = templates.withColumn("hash", F.xxhash64("left", "right"))
    hit = rolled.join(known, (rolled["hash"] == known["hash"]) & (F.col("a") == F.col("left")) & (F.col("b") == F.col("right")), "left")
    hit = hit.filter((F.col("pos") == -1) | F.col("tid").isNotNull())
    return hit.groupBy(*keys, "tid", "label", "exact", "pairs", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.collect_set("tpos").alias("places")
    )


def chain(hits: Column) -> Column:
    """Length of the longest chain of (template place, minus the place in the text) that rises in both places.

    Patience sorting: the k-th tail is the least end of a chain of k hits.  Hits
    of one template place come with falling text places, so a chain holds one.
    """
    none = F.array().cast("array<long>")
    tails = F.aggregate(
        F.array_sort(hits),
        none,
        lambda acc, h: F.concat(F.filter(acc, lambda t: t < -h["back"]), F.array(-h["back"]), F.slice(F.filter(acc, lambda t: t >= -h["back"]), F.lit(2), F.size(acc) + 1)),
    )
    return F.size(tails)


def scan(
    docs: DataFrame, *, keep: list[str], text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, tolerance: int = 3, least_share: float = 0.6
) -> DataFrame:
    """One row per row of ``docs``: ``keep``, n_words and ``spans``.

    ``spans`` is an array of (first, last, label, exact, share): word places from
    0, both inclusive.  A phrase needs all its pairs on one diagonal.  A notice
    needs ``least_share`` of its pairs, each once and in order, on diagonals of
    which no two are more than ``tolerance`` apart.

    Edge cases: null and empty texts have no words and no spans; repeated rows
    are returned as often as they came; an empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    counted = votes(docs, template_positions(spark, phrases, notices), keep=keep, text=text)
    doc = [*[f"keep_{c}" for c in keep], "digest", "n_words"]
    # a notice's strip begins at any of its diagonals; a phrase's diagonals stay apart
    group = Window.partitionBy(*doc, "tid").orderBy("diagonal")
    own = F.transform("places", lambda t: F.struct(t.alias("tpos"), (-(F.col("diagonal") + t)).cast("long").alias("back")))
    strips = counted.withColumn("own", own).withColumn("hits", F.when(F.col("exact"), F.col("own")).otherwise(F.flatten(F.collect_list("own").over(group.rangeBetween(0, tolerance)))))
    least = F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(float(least_share))) * F.col("pairs")
    distinct = F.size(F.array_distinct(F.transform("hits", lambda h: h["tpos"])))
    # the chain is drawn only where enough distinct places voted, and only there it can be long enough
    held = F.when(F.col("tid").isNotNull() & (distinct >= least), F.when(F.col("exact"), distinct).otherwise(chain(F.col("hits"))))
    sound = strips.withColumn("held", held).filter(F.col("tid").isNull() | (F.col("held") >= least))
    # strips that overlap tell of one copy: the best of them stays
    fresh = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(group) > tolerance), F.lit(False)).cast("int")
    places = F.transform("hits", lambda h: -h["back"])
    entry = F.struct("held", (-F.col("diagonal")).alias("early"), F.array_min(places).alias("first"), (F.array_max(places) + 1).alias("last"), "label", "exact", "pairs")
    run = F.sum(fresh).over(group.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = sound.withColumn("run", run).groupBy(*doc, "tid", "run").agg(F.max(F.when(F.col("tid").isNotNull(), entry)).alias("entry"), F.max("votes").alias("votes"))
    rows = best.groupBy(*doc).agg(F.max(F.when(F.col("tid").isNull(), F.col("votes"))).alias("copies"), F.collect_list("entry").alias("found"))
    spans = F.transform("found", lambda s: F.struct(s["first"], s["last"], s["label"].alias("label"), s["exact"].alias("exact"), (s["held"] / s["pairs"]).alias("share")))
    out = rows.select(*doc, "copies", F.array_sort(spans).alias("spans")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select(*[F.col(f"keep_{c}").alias(c) for c in keep], "n_words", "spans")


def digest(scanned: DataFrame, *, keep: list[str]) -> DataFrame:
    """Places of phrases, their first and last word, the labels and the best share."""
    base = F.filter("spans", lambda s: s["exact"])
    firsts = F.transform(base, lambda s: s["first"])
    return scanned.select(
        *keep,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        joined(F.transform(base, lambda s: s["label"])).alias("base_labels"),
        joined(F.transform("spans", lambda s: s["label"])).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )
