"""Every registered query of the library, and the SQL that states the same rows."""

from __future__ import annotations

from voxelbase.queries import analytic, beads, corrections, figures, flow, images, measure, neighbour, pointwise, poses, recon, relate, scanners

FAMILIES = (pointwise, neighbour, images, measure, recon, scanners, analytic, corrections, beads, poses, flow, relate, figures)

QUERIES: dict = {}
ORACLES: dict = {}
for family in FAMILIES:
    QUERIES |= family.QUERIES
    ORACLES |= family.ORACLES
