"""Joins and orderings of tracks, beads, organs and materials."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, MapType, StringType


def name_key(name: Column) -> Column:
    """Names compare without case, blanks, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, r"[\s_-]", ""))


def resolve_presets(names: DataFrame, presets: DataFrame, most: int = 10_000) -> DataFrame:
    """``names`` (with ``name``) and the preset that ``name`` or an alias gives; the first preset wins, none is null.

    ``presets``: (ordinal, preset, aliases). Up to ``most`` presets are broadcast.
    """
    rows = presets.select("ordinal", "preset", F.explode(F.concat(F.array("preset"), F.coalesce("aliases", F.array()))).alias("alias"))
    keys = rows.groupBy(name_key(F.col("alias")).alias("__key")).agg(F.min_by("preset", "ordinal").alias("preset"))
    keys = F.broadcast(keys) if presets.limit(most + 1).count() <= most else keys
    return names.withColumn("__key", name_key(F.col("name"))).join(keys, "__key", "left").drop("__key")


def organ_densities(organs: DataFrame, media: DataFrame) -> DataFrame:
    """Organs with their medium's row by (sex, medium_id); an organ's own density wins."""
    own = organs.withColumnRenamed("density", "__own")
    return own.join(media, ["sex", "medium_id"], "left").withColumn("density", F.coalesce("__own", "density")).drop("__own")


def merge_tracks(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Tracks (view, target, u, observed, merged) of both directions: forward where it is valid, else backward."""
    f, b = (t.select("view", "target", *(F.col(c).alias(f"{n}_{c}") for c in ("u", "observed", "merged"))) for n, t in (("f", forward), ("b", backward)))
    rows = f.join(b, ["view", "target"], "full")
    seen, merged = (F.coalesce(f"f_{c}", F.lit(False)) | F.coalesce(f"b_{c}", F.lit(False)) for c in ("observed", "merged"))
    return rows.select("view", "target", F.coalesce("f_u", "b_u").alias("u"), seen.alias("observed"), (seen & ~merged).alias("usable"))


def bilinear_table(x: Column, y: Column, xs: list[float], ys: list[float], table: list[list[float]]) -> Column:
    """Bilinear look-up in a small table given as literals; x is clamped, beyond the last y it is 0."""

    def cell(v: Column, nodes: list[float]) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(len(nodes) - 2), sum((F.when(v >= n, 1).otherwise(0) for n in nodes[1:]), F.lit(0))))

    x = F.least(F.greatest(x, F.lit(xs[0])), F.lit(xs[-1]))
    nodes = {n: F.array(*map(F.lit, v)) for n, v in (("x", xs), ("y", ys))}
    grid = F.array(*(F.array(*map(F.lit, row)) for row in table))
    i, j = cell(x, xs), cell(y, ys)
    s, t = ((v - nodes[n][k]) / (nodes[n][k + 1] - nodes[n][k]) for v, n, k in ((x, "x", i), (y, "y", j)))
    row = lambda k: grid[k][j] * (1 - t) + grid[k][j + 1] * t
    return F.when(y > ys[-1], 0.0).otherwise(row(i) * (1 - s) + row(i + 1) * s)


def ring_order(beads: DataFrame, ring: list[str], x: Column, y: Column, bead: str, shift: int = 0) -> DataFrame:
    """Each ring's beads numbered by angle around the origin, then turned by ``shift`` places."""
    w = Window.partitionBy(*ring)
    place = F.row_number().over(w.orderBy(F.round(F.atan2(y, x), 9), bead)) - 1
    return beads.withColumn("place", place).withColumn("turned", F.pmod(F.col("place") + shift, F.count(F.lit(1)).over(w)).cast("int"))


def first_centres(centres: DataFrame, by: list[str], v: str, u: str, expected: int) -> DataFrame:
    """The first ``expected`` centres of each frame in row-major order."""
    return centres.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(v, u)) - 1).where(F.col("place") < expected)


def row_components(pixels: DataFrame, hit: Column) -> DataFrame:
    """(view, component, area, first_u) of runs of hit pixels along each detector row."""
    w = Window.partitionBy("view").orderBy("u")
    rows = pixels.where(hit).withColumn("component", F.col("u") - F.row_number().over(w))
    return rows.groupBy("view", "component").agg(F.count(F.lit(1)).alias("area"), F.min("u").alias("first_u")).drop("component")


# Standard atomic weights.
ATOMIC_WEIGHT = {"H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "K": 39.098, "Ca": 40.078, "Fe": 55.845, "Cu": 63.546, "I": 126.904, "Gd": 157.25, "W": 183.84}
_PART = re.compile(r"([A-Z][a-z]?)|(\()|(\))|(\d+)")


def atom_counts(formula: str) -> dict[str, int]:
    """Atoms of a formula with nested groups, such as Ca10(PO4)6(OH)2."""
    stack: list[list[tuple[str, int]]] = [[]]
    group: list[tuple[str, int]] = []  # what a following number multiplies
    at = 0
    for m in _PART.finditer(formula):
        if m.start() != at:
            raise ValueError(f"formula {formula!r} at {at}")
        at = m.end()
        element, opens, closes, number = m.groups()
        if number:
            stack[-1][len(stack[-1]) - len(group) :] = [(e, n * int(number)) for e, n in group]
            group = []
        elif opens:
            stack.append([])
            group = []
        else:
            if closes and len(stack) < 2:
                raise ValueError(f"formula {formula!r} at {m.start()}")
            group = stack.pop() if closes else [(element, 1)]
            stack[-1].extend(group)
    if at != len(formula) or len(stack) != 1:
        raise ValueError(f"formula {formula!r} at {at}")
    out: dict[str, int] = {}
    for e, n in stack[0]:
        out[e] = out.get(e, 0) + n
    return out


@F.pandas_udf(MapType(StringType(), IntegerType()))
def _atoms(formula: pd.Series) -> pd.Series:
    return formula.map(atom_counts)


def weight_fractions(compounds: DataFrame) -> DataFrame:
    """(formula) to (formula, element, fraction by weight). Unknown elements give a null fraction."""
    known = F.create_map(*(F.lit(x) for pair in ATOMIC_WEIGHT.items() for x in pair))
    rows = compounds.select("formula").distinct().select("formula", F.explode(_atoms("formula")).alias("element", "n"))
    mass = F.col("n") * F.try_element_at(known, F.col("element"))
    return rows.select("formula", "element", (mass / F.sum(mass).over(Window.partitionBy("formula"))).alias("fraction"))
