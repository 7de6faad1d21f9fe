"""Value rules: finite numbers, half-even rounding, tolerant casts, and slider and micron conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PIXEL_SIZE_UM = 0.5064
SLIDER_STEPS_PER_UM = 10
DEFAULT_BUFFER_UM, MOST_BUFFER_UM = 2.0, 5.0
DEFAULT_BUFFER_PX = 4


def column(name: str) -> Column:
    """A column by its literal name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def finite(value: Column) -> Column:
    """True for finite numbers, false for NaN and infinities, null for null."""
    return F.abs(value) < F.lit(float("inf"))


def when_finite(value: Column) -> Column:
    """The value if it is finite, else null, which aggregates ignore."""
    return F.when(finite(value), value)


def number(value: Column) -> Column:
    """A double, or null where the value is not a number."""
    return value.try_cast("double")


def whole(value: Column) -> Column:
    """Rounded half to even, as a long."""
    return F.rint(value).cast("long")


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= absolute + relative * F.abs(b)


def buffer_um_from_slider(slider: Column) -> Column:
    return slider / F.lit(float(SLIDER_STEPS_PER_UM))


def buffer_px_from_um(microns: Column, pixel_size_um: float = DEFAULT_PIXEL_SIZE_UM) -> Column:
    return F.greatest(whole(microns / pixel_size_um), F.lit(0).cast("long"))


def buffer_slider_from_px(pixels: Column, pixel_size_um: float = DEFAULT_PIXEL_SIZE_UM) -> Column:
    microns = F.least(F.greatest(pixels * F.lit(pixel_size_um), F.lit(0.0)), F.lit(MOST_BUFFER_UM))
    return whole(microns * SLIDER_STEPS_PER_UM)


def compartment_from_flags(nucleus: Column, cytoplasm_membrane: Column) -> Column:
    """Both flags mean all of the cell, one its own part, none a null."""
    return F.when(nucleus & cytoplasm_membrane, "all").when(nucleus, "nucleus").when(cytoplasm_membrane, "cytoplasm_membrane")


def window_start(centre: Column, size: Column, extent: Column) -> Column:
    """First pixel of a window of ``size`` around ``centre``, moved inside ``extent`` where it fits."""
    zero = F.lit(0).cast("long")
    return F.least(F.greatest(whole(centre - size / 2), zero), F.greatest((extent - size).cast("long"), zero))
