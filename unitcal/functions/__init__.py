from unitcal.functions.columns import (
    approximately,
    draw_bits,
    high_flag,
    inf,
    is_finite,
    nan,
    normal_cdf,
    normal_quantile,
    signed_asinh,
    to_double,
)

__all__ = [
    "approximately",
    "draw_bits",
    "high_flag",
    "inf",
    "is_finite",
    "nan",
    "normal_cdf",
    "normal_quantile",
    "signed_asinh",
    "to_double",
]
