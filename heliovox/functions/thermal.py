"""Radiometry and building physics as column expressions. Whatever is undefined (a root of a negative number, a
division by zero, a distance that isn't positive) is null, never NaN or an error."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KELVIN = 273.15
# Coefficients of the water-vapour polynomial, of the two exponentials and their mixing weight.
VAPOUR = (1.5587, 6.939e-2, -2.7816e-4, 6.8455e-7)
ALPHA = (0.006569, 0.01262)
BETA = (-0.002276, -0.00667)
MIX = 1.9
# Heat transfer coefficients by surface type, W/m2K.
FILM = {"floor": 5.9, "ceiling": 10.0, "wall": 7.7}


def water_vapour(humidity: Column, air_c: Column) -> Column:
    """g/m3 of water in air of a relative humidity in percent."""
    a, b, c, d = map(F.lit, VAPOUR)
    return humidity / 100.0 * F.exp(a + b * air_c + c * F.pow(air_c, F.lit(2.0)) + d * F.pow(air_c, F.lit(3.0)))


def transmittance(distance_m: Column, humidity: Column, air_c: Column) -> Column:
    """Share of infrared radiation that air lets through, 0 to 1; null unless the distance is positive."""
    d = F.when(distance_m > 0, F.sqrt(distance_m))
    w = F.sqrt(water_vapour(humidity, air_c))
    term = lambda k: F.exp(-d * (F.lit(ALPHA[k]) + F.lit(BETA[k]) * w))
    # greatest and least skip nulls, so the distance is asked again.
    return F.when(distance_m > 0, F.least(F.greatest(MIX * term(0) + (1 - MIX) * term(1), F.lit(0.0)), F.lit(1.0)))


def radiance(celsius: Column) -> Column:
    return F.pow(celsius + KELVIN, F.lit(4.0))


def celsius(radiance_: Column) -> Column:
    return F.when(radiance_ > 0, F.pow(radiance_, F.lit(0.25)) - KELVIN)


def true_temperature(apparent: Column, emissivity: Column, tau: Column, reflected: Column, air: Column) -> Column:
    """Surface temperature from the radiation balance of the surface, its surroundings and the air between."""
    own = radiance(apparent) - (1 - emissivity) * tau * radiance(reflected) - (1 - tau) * radiance(air)
    return celsius(F.try_divide(own, emissivity * tau))


def u_value(surface: Column, inside: Column, outside: Column, film: Column, gain: Column | None = None) -> Column:
    """Thermal transmittance h (Ti - Ts) / (Ti - To), with an absorbed solar gain added to the flow; null if Ti = To."""
    flow = film * (inside - surface)
    return F.try_divide(flow if gain is None else flow + gain, inside - outside)


def sol_air(outside: Column, absorptance: Column, irradiance: Column, film: Column, long_wave: Column | None = None) -> Column:
    """Outdoor temperature that would pass the same heat without sun: To + (alpha I - eps dR) / h."""
    gain = absorptance * irradiance if long_wave is None else absorptance * irradiance - long_wave
    return outside + F.try_divide(gain, film)


def u_value_sol_air(surface: Column, inside: Column, sol_air_: Column, film: Column) -> Column:
    return F.when(F.abs(inside - sol_air_) >= 1e-6, film * (inside - surface) / (inside - sol_air_))


def surface_for_u(u: Column, inside: Column, outside: Column, film: Column) -> Column:
    """Surface temperature that a known U-value would give, the inverse of `u_value`."""
    return inside - F.try_divide(u * (inside - outside), film)


def surface_type(to_floor: Column, to_ceiling: Column, near: float) -> Column:
    """floor, ceiling or wall by the distances to both planes; equal distances are floor."""
    return F.when((to_floor <= near) & (to_floor <= to_ceiling), "floor").when(to_ceiling <= near, "ceiling").otherwise("wall")


def film_coefficient(kind: Column) -> Column:
    out = F.lit(None).cast("double")
    for k, v in FILM.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def flag(surface: Column, inside: Column, outside: Column, material: Column, suspected: list[str], possible: list[str]) -> Column:
    """'' if the surface lies between both air temperatures, else why it may not."""
    plausible = surface.between(F.least(inside, outside), F.greatest(inside, outside))
    return F.when(plausible, "").when(material.isin(suspected), "solar_suspected").when(material.isin(possible), "solar_possible").otherwise("implausible")


def plane_of_array(direct: Column, diffuse: Column, modifier: Column) -> Column:
    """Effective irradiance: direct times incidence modifier plus diffuse, none of them below zero, the modifier at most 1; missing parts count as 0."""
    zero = F.lit(0.0)
    iam = F.coalesce(F.least(F.greatest(F.nanvl(modifier, zero), zero), F.lit(1.0)), zero)
    return F.greatest(direct, zero) * iam + F.greatest(diffuse, zero)
