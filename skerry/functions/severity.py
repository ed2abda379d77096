"""Severities and priorities: ranks, names and the numbers behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("UNKNOWN", "LOW", "MEDIUM", "HIGH", "CRITICAL")
PRIORITIES = (("CRITICAL", 5.0), ("HIGH", 3.0), ("MEDIUM", 1.5), ("LOW", 0.5))
PRIORITY_RANK = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def parse(text: Column) -> Column:
    """Rank 0 (unknown) to 4 (critical)."""
    t, out = F.upper(F.trim(text)), F.lit(0)
    for rank, name in enumerate(LEVELS):
        out = F.when(t == name, rank).otherwise(out)
    return out.cast("tinyint")


def name(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), rank.cast("int") + 1)


def number(rank: Column) -> Column:
    return rank.cast("double")


def of_cvss(score: Column) -> Column:
    return F.when(score >= 9, 4).when(score >= 7, 3).when(score >= 4, 2).when(score > 0, 1).otherwise(0).cast("tinyint")


def of_advisory(stated: Column, scores: Column) -> Column:
    """The stated severity if it is one of four words, else the first CVSS score's that starts with a number."""
    first = F.try_element_at(scores, F.lit(1))
    value = F.nullif(F.regexp_extract(first, r"^\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.when(F.lower(stated).isin("critical", "high", "medium", "low"), parse(stated)).otherwise(of_cvss(F.coalesce(value, F.lit(0.0))))


def priority(score: Column) -> Column:
    out = F.lit("NONE")
    for word, least in reversed(PRIORITIES):
        out = F.when(score >= least, word).otherwise(out)
    return out


def priority_rank(word: Column, default: str = "LOW") -> Column:
    w, out = F.upper(F.trim(word)), F.lit(PRIORITY_RANK[default])
    for n, r in PRIORITY_RANK.items():
        out = F.when(w == n, r).otherwise(out)
    return out
