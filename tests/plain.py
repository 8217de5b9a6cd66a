"""Results as plain values, for comparisons."""


def rows(df):
    """Rows as plain tuples, in the order of the frame."""
    return [tuple(row) for row in df.collect()]
