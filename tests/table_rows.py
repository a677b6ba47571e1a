"""Small helpers of the tests: days and result rows."""

import datetime as dt


def day(n: int) -> dt.date:
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
