"""Scalar expressions over gridded monthly series: rescaling, masks, time features, indices, names.

All are Catalyst expressions; none leaves the JVM. Missing pixels are NULL; NaN and the
infinities are values of their own and pass through unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published scale factors of the Landsat, ERA5 and AVHRR products, and quality bits.
OPTICAL = (0.0000275, -0.2)
THERMAL = (0.00341802, 149.0)
PRECIPITATION_FACTOR = 1000.0
KELVIN = 273.15
AVHRR_FACTOR = 0.0001
QA_BITS = (1 << 3) | (1 << 4)

# Band order and the sensors' band names.
BANDS = ("red", "green", "blue", "nir", "swir1", "swir2", "thermal")
FEATURES = ("dem", "x", "y", "month_sin", "month_cos", "year", "precip", "temp")
BAND_MAP = {
    "tm": {"SR_B3": "red", "SR_B2": "green", "SR_B1": "blue", "SR_B4": "nir", "SR_B5": "swir1", "SR_B7": "swir2", "ST_B6": "thermal"},
    "oli": {"SR_B4": "red", "SR_B3": "green", "SR_B2": "blue", "SR_B5": "nir", "SR_B6": "swir1", "SR_B7": "swir2", "ST_B10": "thermal"},
}
FAMILY = {"l5": "tm", "l7": "tm", "l8": "oli", "l9": "oli"}
EPSILON = 1e-6


def optical(dn: Column) -> Column:
    return dn * F.lit(OPTICAL[0]) + F.lit(OPTICAL[1])


def thermal(dn: Column) -> Column:
    return dn * F.lit(THERMAL[0]) + F.lit(THERMAL[1])


def rescaled(name: Column, dn: Column) -> Column:
    """A long-form value by its source band's prefix; other bands stay as they are."""
    return F.when(name.startswith("SR_B"), optical(dn)).when(name.startswith("ST_B"), thermal(dn)).otherwise(dn)


def precipitation(value: Column) -> Column:
    return value * F.lit(PRECIPITATION_FACTOR)


def celsius(value: Column) -> Column:
    return value - F.lit(KELVIN)


def clear(qa: Column, saturation: Column | None = None) -> Column:
    """Whether neither cloud bit is set and, if given, no band is saturated."""
    fine = qa.bitwiseAND(F.lit(QA_BITS)) == 0
    return fine if saturation is None else fine & (saturation == 0)


def masked(value: Column, keep: Column) -> Column:
    """The value, or NULL where it is masked; the row stays."""
    return F.when(keep, value)


def clip01(value: Column) -> Column:
    """Clipped to [0, 1]; NULL and NaN stay."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)))


def finite(value: Column) -> Column:
    """False for NULL, NaN and the infinities."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def month_sin(month: Column) -> Column:
    return F.sin(F.lit(2.0) * F.pi() * month / F.lit(12.0))


def month_cos(month: Column) -> Column:
    return F.cos(F.lit(2.0) * F.pi() * month / F.lit(12.0))


def unit_coordinate(index: Column, size: Column) -> Column:
    """Position in [0, 1] along an axis; 0 where the axis has one cell."""
    return F.when(size <= 1, F.lit(0.0)).otherwise(index.cast("double") / F.greatest(size - 1, F.lit(1)).cast("double"))


def along(index: Column, size: Column, low: float, high: float) -> Column:
    """The index-th of ``size`` evenly spaced values from low to high, both included."""
    return F.lit(float(low)) + unit_coordinate(index, size) * F.lit(float(high) - float(low))


def guarded_ratio(top: Column, bottom: Column) -> Column:
    """A quotient that is NaN for 0/0 and infinite for x/0, as floating point has it."""
    inf = F.lit(float("inf"))
    at_zero = F.when(top > 0, inf).when(top < 0, -inf).otherwise(F.lit(float("nan")))
    return F.when(bottom == 0, at_zero).otherwise(top / F.when(bottom != 0, bottom))


def ndvi(red: Column, nir: Column) -> Column:
    return guarded_ratio(nir - red, nir + red + F.lit(EPSILON))


def bsi(swir1: Column, red: Column, nir: Column, blue: Column) -> Column:
    return guarded_ratio((swir1 + red) - (nir + blue), (swir1 + red) + (nir + blue) + F.lit(EPSILON))


def vhi(ndvi_: Column, thermal_: Column) -> Column:
    return (ndvi_ + (F.lit(1.0) - thermal_)) / F.lit(2.0)


def padded_month(month: Column) -> Column:
    return F.lpad(month.cast("string"), 2, "0")


def date_label(year: Column, month: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), padded_month(month))


def file_stem(*parts: Column) -> Column:
    """Lower-cased parts joined by underscores."""
    return F.concat_ws("_", *(F.lower(p.cast("string")) for p in parts))


def gap_entry(year: Column, month: Column) -> Column:
    """One month as the text of a script literal."""
    return F.concat(F.lit("  {y: "), year.cast("string"), F.lit(", m: "), month.cast("string"), F.lit("}"))


def presence_status(count: Column) -> Column:
    return F.when(count > 0, F.lit("With Images")).otherwise(F.lit("No Images"))


def reflected(index: Column, size: Column) -> Column:
    """An index off either end, mirrored about the end cell."""
    return F.when(index < 0, -index).when(index > size - 1, 2 * (size - 1) - index).otherwise(index)
