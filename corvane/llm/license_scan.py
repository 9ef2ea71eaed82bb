"""Licence scans by diagonal voting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm._common import ascii_lower, split_words

#: Label and words of phrases that are found wherever they stand.
BASE_PHRASES = (("cc-by", ("cc", "by")), ("gpl", ("general", "public", "license")), ("reserved", ("all", "rights", "reserved")))

#: Label, wording and, where others share most of the wording, the words that tell it from them, of licence notices and of
#: whole short licences. What is broadcast does not grow with the data.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license", ""),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", "apache license"),
    ("bsd", "redistributions of source code must retain the above copyright notice", ""),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ""),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors", ""),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "or organization obtaining"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "attribution 4"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "by nc 4"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial 4"),
    ("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", "nc nd 4"),
    ("cc-by-nc-nd-4.0", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", "noncommercial noderivatives 4"),
    ("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", "nc sa 4"),
    ("cc-by-nc-sa-4.0", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license", "noncommercial sharealike 4"),
    ("cc-by-nd-4.0", "licensed under cc by nd 4 0", "by nd 4"),
    ("cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0 international license", "attribution noderivatives 4"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "by sa 4"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike 4"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright", ""),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "license version 2"),
    ("gpl-2.0", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "version 2 of"),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "license version 3"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "license version 3"),
    ("gpl-3.0", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "version 3 of"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general"),
    ("lgpl", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version of the license or at your option any later version", "gnu lesser general"),
    ("agpl-3.0", "licensed under the gnu affero general public license version 3", "gnu affero general"),
    ("agpl-3.0", "free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu affero general"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ""),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ""),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "copy of this"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", ""),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("proprietary", "no part of this publication may be reproduced without prior written permission", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ""),
)


def _gram_hash(words: Column, x: Column, i: Column, k: int) -> Column:
    return F.xxhash64(x, *[F.get(words, i + j) for j in range(1, k)])


def template_positions(spark: SparkSession, templates: tuple[tuple[str, str, str], ...], k: int) -> DataFrame:
    """One row for each place of k words in a template: hash, words, template, place, number of places, whether the words that tell it from others stand there."""
    rows = [(t, label, text.split(), key) for t, (label, text, key) in enumerate(templates)]
    df = spark.createDataFrame(rows, "_cv_tid int, _cv_label string, _cv_tw array<string>, _cv_told string")
    hashes = F.slice(F.transform("_cv_tw", lambda x, i: _gram_hash(F.col("_cv_tw"), x, i, k)), F.lit(1), F.size("_cv_tw") - (k - 1))
    df = df.select("_cv_tid", "_cv_label", "_cv_tw", "_cv_told", (F.size("_cv_tw") - (k - 1)).alias("_cv_of"), F.posexplode(hashes).alias("_cv_tpos", "_cv_hash"))
    gram = F.slice("_cv_tw", F.col("_cv_tpos") + 1, k)
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    told = (F.col("_cv_told") == "") | F.contains(padded(F.array_join(gram, " ")), padded(F.col("_cv_told")))
    return df.select("_cv_hash", "_cv_tid", "_cv_label", "_cv_of", "_cv_tpos", gram.alias("_cv_gram"), told.alias("_cv_told"))


def _base_starts(lowered: Column, words: Column, phrase: tuple[str, ...]) -> Column:
    """Where the phrase's words stand. A text without its first and last word as substrings has none, which spares the walk."""
    k = len(phrase)

    def stands(x: Column, i: Column) -> Column:
        out = x == phrase[0]
        for j in range(1, k):
            out = out & (F.coalesce(F.get(words, i + j), F.lit("")) == phrase[j])
        return out

    marked = F.transform(words, lambda x, i: F.when(stands(x, i), i.cast("long")).otherwise(F.lit(-1).cast("long")))
    may = F.contains(lowered, F.lit(phrase[0])) & F.contains(lowered, F.lit(phrase[-1]))
    return F.when(may, F.filter(marked, lambda s: s >= 0)).otherwise(F.array().cast("array<bigint>"))


def scan_licenses(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 3, near: int = 2, covered: float = 0.6, templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> DataFrame:
    """Licence notices in documents.

    All rolling hashes of ``k`` words meet the templates' places; hits (their words compared) vote for the diagonal
    document place minus template place; diagonals at most ``near`` apart are one span; a span that holds at least
    ``covered`` of its template's places, over no more than twice its length, and the words that tell the template from
    others, is a notice. Of notices that share words of the document, directly or through others, the one with the most
    votes stays (then the largest share, the first place, the label): those words stand for one licence. Base phrases are
    found wherever their words stand in a row.

    Returns one row per document: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score (1 with a
    base phrase, else the best share covered) and spans (label, first word, end, share). Null counts as an empty text,
    which has no words; null or repeated ids are rows of their own; an empty table gives no rows; other columns are not
    read.
    """
    lowered = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    docs = df.select(F.col(id_col).alias("_cv_id"), F.monotonically_increasing_id().alias("_cv_rid"), lowered.alias("_cv_low")).withColumn("_cv_words", split_words(F.col("_cv_low")))
    words = F.col("_cv_words")
    docs = docs.select("_cv_id", "_cv_rid", "_cv_words", F.transform(words, lambda x, i: _gram_hash(words, x, i, k)).alias("_cv_hashes"), *[_base_starts(F.col("_cv_low"), words, p).alias(f"_cv_b{j}") for j, (_, p) in enumerate(BASE_PHRASES)])
    n = F.size("_cv_words")
    starts = F.concat(*[F.col(f"_cv_b{j}") for j in range(len(BASE_PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_cv_b{j}") > 0, F.lit(label)) for j, (label, _) in enumerate(BASE_PHRASES)]))
    # Each document sends a row of its own (the last place, without a hash) beside those of its hits, so that none is lost.
    hashes = F.concat(F.slice("_cv_hashes", F.lit(1), F.greatest(n - (k - 1), F.lit(0))), F.array(F.lit(None).cast("long")))
    # Computed before the rows are dealt out: a row per place carries references only. The outer form (no array is empty) keeps a filter on the array's size, which would make it twice, from the plan.
    docs = docs.select("_cv_id", "_cv_rid", "_cv_words", n.cast("long").alias("_cv_n"), starts.alias("_cv_starts"), labels.alias("_cv_base"), hashes.alias("_cv_hashes"))
    places = docs.select("_cv_id", "_cv_rid", "_cv_words", "_cv_n", "_cv_starts", "_cv_base", F.posexplode_outer("_cv_hashes").alias("_cv_pos", "_cv_hash"))
    met = places.join(F.broadcast(template_positions(df.sparkSession, templates, k)), "_cv_hash", "left")
    met = met.where(F.col("_cv_hash").isNull() | (F.slice("_cv_words", F.col("_cv_pos") + 1, k) == F.col("_cv_gram")))
    own = F.col("_cv_hash").isNull()
    met = met.select(
        "_cv_rid", "_cv_tid", "_cv_label", "_cv_of", "_cv_told", "_cv_pos", (F.col("_cv_pos") - F.col("_cv_tpos")).alias("_cv_diag"),
        F.when(own, F.struct(F.col("_cv_id").alias("id"), F.col("_cv_n").alias("n"), F.col("_cv_starts").alias("starts"), F.col("_cv_base").alias("base"))).alias("_cv_doc"),
    ).repartition("_cv_rid")
    votes = met.groupBy("_cv_rid", "_cv_tid", "_cv_diag").agg(F.count("*").alias("_cv_votes"), F.min("_cv_pos").alias("_cv_lo"), F.max("_cv_pos").alias("_cv_hi"), F.first("_cv_label").alias("_cv_label"), F.first("_cv_of").alias("_cv_of"), F.max("_cv_told").alias("_cv_told"), F.first("_cv_doc", ignorenulls=True).alias("_cv_doc"))
    by_diag = Window.partitionBy("_cv_rid", "_cv_tid").orderBy("_cv_diag")
    opens = F.coalesce(F.col("_cv_diag") - F.lag("_cv_diag").over(by_diag) > near, F.lit(True)).cast("int")
    spans = votes.withColumn("_cv_open", opens).withColumn("_cv_island", F.sum("_cv_open").over(by_diag.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.groupBy("_cv_rid", "_cv_tid", "_cv_island").agg(F.sum("_cv_votes").alias("_cv_votes"), F.min("_cv_lo").alias("_cv_lo"), (F.max("_cv_hi") + k).alias("_cv_hi"), F.first("_cv_label").alias("_cv_label"), F.first("_cv_of").alias("_cv_of"), F.max("_cv_told").alias("_cv_told"), F.first("_cv_doc", ignorenulls=True).alias("_cv_doc"))
    share = F.least(F.lit(1.0), F.col("_cv_votes") / F.col("_cv_of"))
    sure = (share >= covered) & (F.col("_cv_hi") - F.col("_cv_lo") <= 2 * (F.col("_cv_of") + (k - 1))) & F.col("_cv_told")
    # The document's own row has no template and stands before its spans.
    spans = spans.withColumn("_cv_share", share).where(F.col("_cv_tid").isNull() | sure).withColumn("_cv_lo", F.when(F.col("_cv_tid").isNotNull(), F.col("_cv_lo")).otherwise(-1))
    by_place = Window.partitionBy("_cv_rid").orderBy("_cv_lo", "_cv_hi", "_cv_tid")
    reached = F.max(F.when(F.col("_cv_tid").isNotNull(), F.col("_cv_hi"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_cv_open", F.coalesce(F.col("_cv_lo") >= reached, F.lit(True)).cast("int")).withColumn("_cv_group", F.sum("_cv_open").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.when(F.col("_cv_tid").isNotNull(), F.struct((-F.col("_cv_votes")).alias("v"), (-F.col("_cv_share")).alias("s"), F.col("_cv_lo").alias("first"), F.col("_cv_label").alias("label"), F.col("_cv_hi").alias("end"))))
    spans = spans.groupBy("_cv_rid", "_cv_group").agg(best.alias("_cv_best"), F.first("_cv_doc", ignorenulls=True).alias("_cv_doc"))
    told = F.struct(F.col("_cv_best.label").alias("label"), F.col("_cv_best.first").alias("first"), F.col("_cv_best.end").alias("end"), (-F.col("_cv_best.s")).alias("share"))
    per_doc = spans.groupBy("_cv_rid").agg(
        F.first("_cv_doc", ignorenulls=True).alias("d"),
        F.sort_array(F.collect_list(F.when(F.col("_cv_best").isNotNull(), told))).alias("spans"),
    )
    starts, base = F.col("d.starts"), F.col("d.base")
    return per_doc.select(
        F.col("d.id").alias(id_col),
        F.col("d.n").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat(base, F.transform("spans", lambda s: s["label"])))), ",").alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"),
        "spans",
    )
