"""Scalar conversions and response curves, all inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING_SENTINEL = 9999.0
KELVIN_OFFSET = 273.15
HALF_HOUR_CARBON = 0.02161926  # umol m-2 s-1 -> gC m-2 per half-hour
DAY_CARBON = 1e-6 * 0.012011 * 1000 * 86400  # umol m-2 s-1 -> gC m-2 per day
NULL_MODEL_BASE, NULL_MODEL_RATE = 0.598, 0.044
MOYANO_LIMIT, MOYANO_SCALE = 0.42, 0.1764
REFERENCE_KELVIN, TEMPERATURE_EXPONENT = 293.15, 1.75


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number_or_null(c: Column | str) -> Column:
    """NaN becomes null: NaN sorts above every number and poisons averages."""
    c = _col(c)
    return F.when(~F.isnan(c), c)


def sentinel_to_null(c: Column | str, sentinel: float = MISSING_SENTINEL) -> Column:
    c = _col(c)
    return F.when((c != F.lit(sentinel)) & ~F.isnan(c), c)


def is_finite(c: Column | str) -> Column:
    """Not null, not NaN, not infinite."""
    c = _col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def kelvin_to_celsius(c: Column | str) -> Column:
    return _col(c) - F.lit(KELVIN_OFFSET)


def reduced_temperature(celsius: Column | str) -> Column:
    """Tens of degrees above 10 C."""
    return (_col(celsius) - F.lit(10.0)) / F.lit(10.0)


def reduced_temperature_kelvin(kelvin: Column | str) -> Column:
    return reduced_temperature(kelvin_to_celsius(kelvin))


def log_flux(flux: Column | str) -> Column:
    """ln of a positive flux, null otherwise."""
    flux = _col(flux)
    return F.when(flux > 0, F.ln(flux))


def null_model_flux(kelvin: Column | str) -> Column:
    return F.lit(NULL_MODEL_BASE) + F.exp(F.lit(NULL_MODEL_RATE) * kelvin_to_celsius(kelvin))


def half_hour_carbon(flux: Column | str) -> Column:
    return _col(flux) * F.lit(HALF_HOUR_CARBON)


def clamp_at_zero(c: Column | str) -> Column:
    """Null stays null (``greatest`` alone would turn it into zero)."""
    c = _col(c)
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def title_case(text: Column | str) -> Column:
    """Capitalise every word; hyphens and blanks start a new word."""
    words = F.split(F.lower(_col(text)), r"(?<=[^\p{L}\p{N}'_])")
    capital = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20)))
    return F.array_join(capital, "")


def name_part(text: Column | str, pattern: str, group: int = 1) -> Column:
    """A capture group of a file or column name; null where the pattern does not occur."""
    return F.nullif(F.regexp_extract(_col(text), pattern, group), F.lit(""))


def moyano_water_response(water: Column | str) -> Column:
    w = _col(water)
    curve = F.pow(F.lit(MOYANO_LIMIT) - w, F.lit(10.0 / 3.0)) / F.lit(MOYANO_SCALE)
    return F.when(w.between(0.0, MOYANO_LIMIT), curve).when(w.isNotNull(), F.lit(0.0))


def linear_water_response(water: Column | str) -> Column:
    return F.lit(1.0) - _col(water)


def temperature_response(celsius: Column | str) -> Column:
    kelvin = _col(celsius) + F.lit(KELVIN_OFFSET)
    return F.pow(kelvin / F.lit(REFERENCE_KELVIN), F.lit(TEMPERATURE_EXPONENT))


def diurnal_temperature(hour: Column | str) -> Column:
    return F.lit(30.0) - F.lit(10.0) * F.sin(F.pi() * _col(hour) / F.lit(12.0))


def fick_flux(diffusivity: Column | str, celsius: Column | str, water: Column | str, gradient: Column | str) -> Column:
    """Soil flux from a vertical concentration gradient, scaled by temperature and water."""
    return -_col(diffusivity) * temperature_response(celsius) * moyano_water_response(water) * _col(gradient)


def within(obs: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Interval coverage flag, both ends included."""
    return _col(obs).between(_col(lo), _col(hi))


def taylor_x(sd: Column | str, r: Column | str) -> Column:
    return _col(sd) * _col(r)


def taylor_y(sd: Column | str, r: Column | str) -> Column:
    """sd * sin(acos r), safe when rounding pushes r past 1."""
    r = _col(r)
    return F.when(r.isNotNull(), _col(sd) * F.sqrt(F.greatest(F.lit(1.0) - r * r, F.lit(0.0))))
