"""Dictionaries: catalogues joined by id, sources merged by priority, terms found in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extract_pattern
from .common import row_numbers
from .containment import first_term


def translate_catalogue(catalogue: DataFrame, source: str = "en") -> DataFrame:
    """lang, id, term, target, pos of a catalogue (lang, id, name, pos): names of other languages joined to those of ``source`` by id.

    Of repeated ids the last place gives the name, the first one ``pos``. Ids whose last name is null or empty on either side are left out.
    """
    named = catalogue.groupBy("lang", "id").agg(F.max_by(F.struct("name"), "pos")["name"].alias("name"), F.min("pos").alias("pos")).filter("name <> ''")
    target = named.filter(F.col("lang") == source).select("id", F.col("name").alias("target"))
    return named.filter(F.col("lang") != source).select("lang", "id", F.col("name").alias("term"), "pos").join(target, "id").select("lang", "id", "term", "target", "pos")


def catalogue_terms(translated: DataFrame, priorities: dict[str, int]) -> DataFrame:
    """kind, term, target, priority, pos of ``translate_catalogue``'s rows: each name as a full term, and its pattern where both have one and they differ.

    Languages with a higher priority win over others; ``priorities`` names those that are taken.
    """
    ranked = translated.withColumn("priority", F.try_element_at(F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv]), F.col("lang"))).filter("priority is not null")
    full = ranked.select(F.lit("full").alias("kind"), "term", "target", "priority", "pos")
    pattern = ranked.select(F.lit("pattern").alias("kind"), extract_pattern(F.col("term")).alias("term"), extract_pattern(F.col("target")).alias("target"), "priority", "pos")
    return full.unionByName(pattern.filter("term <> '' and target <> '' and term <> target"))


def stored_terms(merged: DataFrame, sources: dict[int, str]) -> DataFrame:
    """``merge_terms``' rows as the term store has them: source by priority, ord the place among the terms of the kind from 0."""
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in sources.items() for x in kv]), F.col("first_priority"))
    kinds = [row_numbers(merged.filter(F.col("kind") == k), ["first_priority", "first_pos", "term"], "ord") for k in ("full", "pattern")]
    return kinds[0].unionByName(kinds[1]).select("kind", "term", "target", label.alias("source"), F.col("first_priority").alias("priority"), "ord")


def union_terms(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def merge_terms(*sources: DataFrame) -> DataFrame:
    """kind, term, target, ord of sources with (kind, term, target, priority, pos): the highest priority gives the target, the first place the order."""
    rank = F.struct("priority", "pos")
    merged = union_terms(*sources).groupBy("kind", "term").agg(F.max_by("target", rank).alias("target"), F.min(rank).alias("__first"))
    return merged.select("kind", "term", "target", F.col("__first.priority").alias("first_priority"), F.col("__first.pos").alias("first_pos"))


def term_counts(terms: DataFrame) -> DataFrame:
    return terms.groupBy("kind").agg(F.count("*").alias("n"))


def match_terms(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, min_len: int = 1) -> DataFrame:
    """id, term, target: for each row of ``texts`` the first term (by ord) that its text contains; rows without one are left out."""
    asked = terms.filter(F.length("term") >= min_len).select("term", "target", "ord")
    return first_term(texts.select(id_col, text_col), asked, text_col, ["ord"]).select(id_col, "term", "target")


def coverage(terms: DataFrame, required: DataFrame) -> DataFrame:
    """term, target of the required terms; (missing) where there is none."""
    have = terms.groupBy("term").agg(F.min("target").alias("target"))
    return required.join(have, "term", "left").select("term", F.coalesce("target", F.lit("(missing)")).alias("target"))


def dictionary_lookup(texts: DataFrame, full: DataFrame, patterns: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``texts``' other columns, mode, term, target: for each row the first full name in its text, else the first pattern of two characters or more.

    Both dictionaries are looked up in one pass over the texts; rows without either are left out.
    """
    both = full.select("term", "target", F.lit("full").alias("mode"), "ord").unionByName(
        patterns.filter(F.length("term") >= 2).select("term", "target", F.lit("pattern").alias("mode"), "ord"))
    ranked = both.withColumn("__rank", F.when(F.col("mode") == "full", 0).otherwise(1))
    return first_term(texts, ranked, text_col, ["__rank", "ord"])
