"""Constants and functions that several test modules share."""

import datetime as dt

DAY = dt.date(2026, 1, 10)
NOON = dt.datetime(2026, 1, 10, 12, 0)
LATER = dt.datetime(2026, 1, 10, 13, 0)


def tuples(df, *columns):
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=repr)
