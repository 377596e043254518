from binroute.functions.scalars import (  # noqa: F401
    bin_of,
    bin_prefix,
    bin_suffix,
    exact_percent,
    month_window,
    safe_div,
    strip,
    trailing_month,
)
