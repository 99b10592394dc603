"""Image calibration and scaling as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Antenna pattern of a fine beam in dB over (theta - centre) / width, highest power first, and of an L-band sensor over theta - 34.
FINE_BEAM = (0.044834, -0.048875, -0.338039, 0.414746, 0.767037, -2.244836, -1.038396, 1.074398, 0.935996, 1.707515)
FINE_CENTRE, FINE_WIDTH = 33.399360, 1.880050
L_BAND = (0.00006896, 0.00011602, -0.05117270, 0.00516289, 1.00243524)
L_BAND_CENTRE = 34.0


def _poly(coefficients: tuple[float, ...], x: Column) -> Column:
    """A polynomial, highest power first."""
    return reduce(lambda a, c: a * x + c, coefficients[1:], F.lit(coefficients[0]))


def sensor_calibration(value: Column, sensor: Column, theta: Column, psi: Column, beta_nought: Column, gain: Column) -> Column:
    """value by sensor: 'table' times a gain, 's1', 'fine', 'lband', else the cosmetic third power of sin; theta in degrees."""
    fine = F.pow(F.lit(10.0), _poly(FINE_BEAM, (theta - FINE_CENTRE) / FINE_WIDTH) / 10)
    lband = F.pow(_poly(L_BAND, theta - L_BAND_CENTRE), 2)
    return F.when(value <= 0, value).when(sensor == "table", value * gain).when(sensor == "s1", value * F.sin(psi) / (beta_nought * beta_nought)).when(sensor == "fine", value / fine).when(sensor == "lband", value / lband).otherwise(value * F.pow(F.sin(psi), 3))


def fine_beam_final(value: Column) -> Column:
    """the final scale of fine-beam sigma nought."""
    return value / 27.3 - 0.0058


def to_db(value: Column) -> Column:
    """power in dB, to a hundredth; small power is held at -29.9, none is -30."""
    held = F.when(value < 0.001001, F.when(value > 1e-9, 0.00102).otherwise(0.001)).otherwise(value)
    return F.round(F.log10(held) * 1000, 0) / 100


def gamma0(sigma_db: Column, correction: Column) -> Column:
    """gamma nought in dB."""
    return F.greatest(F.round(sigma_db + correction, 2), F.lit(-30.0))


def gamma_correction(beta_area: Column, gamma_area: Column, psi: Column) -> Column:
    """in dB between -29.9 and 20; -30 in shadow."""
    ratio = 10 * F.log10(beta_area / gamma_area / F.sin(psi))
    return F.when(gamma_area <= 0, -30.0).otherwise(F.greatest(F.least(ratio, F.lit(20.0)), F.lit(-29.9)))


def byte_scale(value: Column, lower: float, upper: float, exponent: float = 1.0) -> Column:
    """0 stays 0, else 1 to 255 between the bounds."""
    share = F.pow(F.greatest(F.least((value - lower) / (upper - lower), F.lit(1.0)), F.lit(0.0)), F.lit(exponent))
    return F.when(value == 0, 0).otherwise(F.greatest(F.least((share * 255).cast("int"), F.lit(255)), F.lit(1))).cast("int")
