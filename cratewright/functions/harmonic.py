"""How well two tracks go together: tempo, key, genre, theme, and the transition between them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cratewright.functions import lookups

BPM_STEPS = ((2.0, 1.0), (6.0, 0.85), (12.0, 0.6), (18.0, 0.3), (30.0, 0.1))


def bpm_compat(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    out = F.when(F.coalesce((a <= 0) | (b <= 0), F.lit(True)), 0.5)
    for most, score in BPM_STEPS:
        out = out.when(d <= most, score)
    return out.otherwise(0.0)


def key_number(key: Column) -> Column:
    """The number of a key such as ``12d``; null if it has none."""
    return F.regexp_extract(F.trim(key), r"^(-?\d{1,9}).$", 1).try_cast("int")


def key_distance(n1: Column, l1: Column, n2: Column, l2: Column) -> Column:
    """Distance of two keys given as number and letter; 0.5 if either has no number."""
    same = l1 == l2
    d = F.least(F.abs(n1 - n2), 12 - F.abs(n1 - n2))
    return (
        F.when(n1.isNull() | n2.isNull(), 0.5)
        .when((n1 == n2) & same, 1.0)
        .when(n1 == n2, 0.9)
        .when((d == 1) & same, 0.85)
        .when(d == 1, 0.6)
        .when((d == 2) & same, 0.4)
        .when(d <= 3, 0.2)
        .otherwise(0.05)
    )


def key_compat(a: Column, b: Column) -> Column:
    """Distance on the circle of twelve keys, letter included; 0.5 if either cannot be read."""
    return key_distance(key_number(a), F.substring(F.trim(a), -1, 1), key_number(b), F.substring(F.trim(b), -1, 1))


def _pair_map(pairs: list[tuple[str, str, float]]) -> Column:
    return F.create_map(*(x for a, b, w in pairs for x in (F.lit(f"{a}\t{b}"), F.lit(w))))


def genre_compat(a: Column, b: Column) -> Column:
    """1 same, 0.6 and 0.3 one and two steps along the directed genre graph, else 0.05; 0.3 if unknown."""
    found = F.try_element_at(_pair_map(lookups.two_steps()), F.concat(a, F.lit("\t"), b))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.3).when(a == b, 1.0).otherwise(F.coalesce(found, F.lit(0.05)))


def theme_compat(a: Column, b: Column) -> Column:
    found = F.try_element_at(_pair_map(lookups.theme_pairs()), F.concat(a, F.lit("\t"), b))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).when(a == b, 1.0).when((a == "surreal") | (b == "surreal"), 0.5).otherwise(F.coalesce(found, F.lit(0.0)))


def transition(bpm1: Column, key1: Column, genre1: Column, bpm2: Column, key2: Column, genre2: Column) -> Column:
    """The name of the transition from one track to the next."""
    d = F.when(F.coalesce((bpm1 > 0) & (bpm2 > 0), F.lit(False)), F.abs(bpm1 - bpm2)).otherwise(999.0)
    k = key_compat(key1, key2)
    same = F.coalesce(genre1, F.lit("")) == F.coalesce(genre2, F.lit(""))
    return (
        F.when((d <= 2.5) & same & (k >= 0.8), "BEAT+FRAGMENT")
        .when((d <= 6) & (k >= 0.8), "BEAT MATCH")
        .when((d <= 6) & (k < 0.4), "BEAT+FX")
        .when(d <= 6, "BEAT MATCH")
        .when((d <= 12) & (k >= 0.5) & ~same, "STEM BLEND")
        .when((d <= 12) & (k >= 0.5), "BLEND")
        .when(k < 0.25, "EFFECT FADE")
        .when((d > 12) & (k >= 0.6), "LOOP DROP")
        .otherwise("BLEND")
    )


def bpm_color(bpm: Column) -> Column:
    """The colour band of a tempo, as text: 1 from 118 to 124, then a band for every 6 beats away."""
    b = F.bround(bpm, 0)
    d = F.least(F.abs(b - 118), F.abs(b - 124))
    out = F.when((b >= 118) & (b <= 124), "1")
    for band, most in enumerate((6, 12, 18, 24, 30), 2):
        out = out.when(d <= most, str(band))
    return out.otherwise("7")


def fold_bpm(bpm: Column) -> Column:
    """Double-time and half-time tempos brought to one range."""
    return F.when(bpm >= 150, bpm / 2).when((bpm > 0) & (bpm < 60), bpm * 2).otherwise(bpm)
