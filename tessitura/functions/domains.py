"""Closed sets of words that a score may hold."""

from __future__ import annotations

from pyspark.sql import Column

# Articulations and dynamics.
ARTICULATIONS = ("accent", "strong-accent", "staccato", "staccatissimo", "tenuto", "detached-legato", "spiccato", "breath-mark", "caesura", "stress", "unstress", "soft-accent")
DYNAMICS = ("pppp", "ppp", "pp", "p", "mp", "mf", "f", "ff", "fff", "ffff", "sfz", "fp", "sf", "fz", "rfz", "sfp")


def is_articulation(word: Column) -> Column:
    return word.isin(*ARTICULATIONS)


def is_dynamic(word: Column) -> Column:
    return word.isin(*DYNAMICS)
