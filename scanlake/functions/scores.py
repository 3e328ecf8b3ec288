"""Scalar scores of glyph geometry and the coverage gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the piecewise log-likelihood: the inner limit in sigmas and the offset that joins the pieces.
INNER, JOIN = 0.75, 0.2109375


def quantized_ll(error: Column, sigma: Column) -> Column:
    """Log-likelihood of a residual, flatter within INNER sigmas (a sigma of 1e-12 at least)."""
    sigma = F.greatest(sigma, F.lit(1e-12))
    z = error / sigma
    return F.when(F.abs(error) < INNER * sigma, -0.5 * (z / 2) * (z / 2)).otherwise(-0.5 * z * z + JOIN)


def center_span_scale(obs_first: Column, obs_last: Column, pred_first: Column, pred_last: Column) -> Column:
    """Ratio of the spans of centres; null if either is below half a pixel."""
    obs, pred = obs_last - obs_first, pred_last - pred_first
    return F.when((obs >= 0.5) & (pred >= 0.5), obs / pred)


def combined_geo_ll(combined: Column, h: Column, v: Column) -> Column:
    """The combined score, or both parts, or the one there is."""
    return F.coalesce(combined, h + v, h, v)


def coverage_gate(n: Column, n_windows: Column) -> Column:
    """Enough observations: 40 % of the windows, three at least, but never more than there are."""
    return n >= F.least(n_windows, F.greatest(F.lit(3), F.ceil(0.4 * n_windows)))


def font_size_pt(height_px: Column, dpi: Column, ascent_share: Column | None = None) -> Column:
    """Em size in points from a line's height; the height itself where the font is unknown."""
    plain = height_px * 72.0 / dpi
    return plain if ascent_share is None else F.coalesce(plain / ascent_share, plain)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer grey value of a colour."""
    return F.floor((2126 * r + 7152 * g + 722 * b) / 10000).cast("int")


def affine(x: Column, y: Column, m: list[Column]) -> tuple[Column, Column]:
    """A point through a 2 x 3 matrix given as [a, b, c, d, e, f]."""
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def em_from_scale(scale: Column, units: Column) -> Column:
    """Em size in pixels from pixels a font unit."""
    return scale * units
