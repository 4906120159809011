"""Comparing the results of two engines."""

import pandas as pd


def rows_of(frame):
    """Rows as sorted tuples of text, columns by name, floats rounded; for comparing two engines."""

    def plain(x):
        if pd.isna(x):
            return "null"
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") or type(x).__name__ == "Decimal" else str(x)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False))
