"""License scan by a positional index of rare words, in DataFrame expressions alone.

Templates are sentences of licences.  The document frequency of every template word is counted over all documents;
the words of a template with the highest inverse document frequency are its rare words, and the rarest is its
anchor.  A file's words are looked up among the anchors.  Every place of an anchor's posting gives the template a
start relative to it; the start stands if the template's other rare words lie at their relative positions too
(the intersection of postings), and if its mandatory key phrases are all there, word for word.

Words are maximal runs of ASCII letters and digits and of any characters beyond ASCII, after lower-casing A to Z.

Defined cases: null and empty texts have no words and no labels; a template that lies in a text several times
counts at each place; repeated rows are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm._common import table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3

# fixed values: the base phrases and their labels
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: sentences of public licences and the labels they stand for; in brackets the mandatory key phrases
SENTENCES = (
    ("[mit license]", "mit"),
    ("[permission is hereby granted free of charge] to any person [obtaining a copy]", "mit"),
    ("[apache license version 2 0]", "apache-2.0"),
    ("[apache license 2 0]", "apache-2.0"),
    ("[gnu general public license version 3]", "gpl-3"),
    ("[gnu general public license version 2]", "gpl-2"),
    ("[gnu general public license v3]", "gpl-3"),
    ("[gnu general public license v2]", "gpl-2"),
    ("[lesser general public license]", "lgpl"),
    ("[affero general public license]", "agpl"),
    ("[mozilla public license]", "mpl"),
    ("[eclipse public license]", "epl"),
    ("[redistribution and use in source and binary forms] with or without modification [are permitted]", "bsd"),
    ("[bsd license]", "bsd"),
    ("[isc license]", "isc"),
    ("[permission to use copy modify] and or distribute this software [for any purpose]", "isc"),
    ("[cc by nc]", "cc-by-nc"),
    ("[cc by sa]", "cc-by-sa"),
    ("[cc by nd]", "cc-by-nd"),
    ("[creative commons attribution]", "cc-by"),
    ("[cc0]", "cc0"),
    ("[free and unencumbered software] released into the [public domain]", "unlicense"),
    ("[dedicated to the public domain]", "public-domain"),
    ("[the software is provided as is] without warranty [of any kind]", "no-warranty"),
)


@dataclass(frozen=True)
class Template:
    label: str
    base: bool
    words: tuple[str, ...]
    keys: tuple[tuple[int, tuple[str, ...]], ...]


def templates(base: dict[str, str] = BASE, sentences: tuple[tuple[str, str], ...] = SENTENCES) -> list[Template]:
    out = [Template(label, True, tuple(p.split()), ((0, tuple(p.split())),)) for p, label in base.items()]
    for sentence, label in sentences:
        words: list[str] = []
        keys = []
        for part in sentence.replace("[", "|[").replace("]", "]|").split("|"):
            inside = part.strip().strip("[]").split()
            if part.startswith("["):
                keys.append((len(words), tuple(inside)))
            words += inside
        out.append(Template(label, False, tuple(words), tuple(keys)))
    return out


def words_of(text: str) -> Column:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), upper, lower), F.lit(WORD), F.lit(0))


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def inverse_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, float]:
    """ln((documents + 1) / (documents with the word + 1)) over all rows of a DataFrame with the words of its rows."""
    total = F.lit(None).cast("string")
    found = words.select(F.explode(F.concat(F.array(total), F.array_intersect("__license_words", _strings(vocabulary)))).alias("w"))
    counts = {r.w: r.n for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}  # one row a template word
    n = counts.get(None, 0)
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def scan(df: DataFrame, text: str = "text", known: list[Template] | None = None, rare: int = RARE) -> DataFrame:
    """Add n_words, score, labels (array) and ``places`` (array of start, length, label, base) to every row."""
    known = known or templates()
    vocabulary = sorted({w for t in known for w in t.words})
    df = df.withColumn("__license_words", words_of(text))
    idf = inverse_frequencies(df.select("__license_words"), vocabulary)
    entries, anchors = [], set()
    for t in known:
        ranked = sorted(range(len(t.words)), key=lambda i: (-idf[t.words[i]], t.words[i], i))[:rare]
        anchor = ranked[0]
        anchors.add(t.words[anchor])
        others = [(i, t.words[i]) for i in sorted(ranked[1:])]
        entries.append((t, anchor, others, sum(idf[t.words[i]] for i in ranked)))
    lookup = _strings(sorted(anchors))
    numbered = F.transform("__license_words", lambda w, i: F.struct(i.cast("int").alias("i"), w.alias("w")))
    hits = F.filter(numbered, lambda x: F.array_contains(lookup, x["w"]))
    none = F.array().cast("array<struct<i:int,w:string>>")
    df = df.withColumn("__license_hits", F.when(F.arrays_overlap("__license_words", lookup), hits).otherwise(none))

    def starts(t: Template, anchor: int, others: list[tuple[int, str]]) -> Column:
        """Starts of the template in the row: postings of its anchor, intersected and verified."""
        at = F.transform(F.filter("__license_hits", lambda x: x["w"] == t.words[anchor]), lambda x: x["i"] - anchor)

        def stands(start: Column) -> Column:
            ok = (start >= 0) & (start + len(t.words) <= F.size("__license_words"))
            for i, w in others:
                ok = ok & (F.get("__license_words", start + i) == w)
            for i, phrase in t.keys:
                ok = ok & (F.slice("__license_words", F.greatest(start, F.lit(0)) + i + 1, len(phrase)) == _strings(phrase))
            return F.coalesce(ok, F.lit(False))

        return F.transform(F.filter(at, stands), lambda s: F.struct(s.cast("int").alias("start"), F.lit(len(t.words)).alias("length"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(weight).alias("weight")))

    found = []
    for t, anchor, others, weight in entries:
        found.append(starts(t, anchor, others))
    empty = F.array().cast("array<struct<start:int,length:int,label:string,base:boolean,weight:double>>")
    places = F.when(F.size("__license_hits") > 0, F.array_sort(F.flatten(F.array(*found)))).otherwise(empty)
    df = df.withColumn("places", places).withColumn("n_words", F.size("__license_words").cast("long"))
    # each label counts once, with its heaviest template
    weight = F.aggregate(F.array_distinct(F.transform("places", lambda p: p["label"])), F.lit(0.0), lambda acc, name: acc + F.array_max(F.transform(F.filter("places", lambda p: p["label"] == name), lambda p: p["weight"])))
    labels = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    return df.withColumn("labels", labels).withColumn("score", 1 - 1 / (1 + weight)).drop("__license_words", "__license_hits")


def op5_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    base = F.filter("places", lambda p: p["base"])
    out = scan(documents).withColumn("_base", base)
    at = F.transform("_base", lambda p: p["start"].cast("long"))
    return out.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("_base", lambda p: p["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )
