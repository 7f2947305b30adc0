"""What several test modules use."""


def rows(df):
    """Rows as strings, sorted; null is empty."""
    return sorted(",".join("" if v is None else str(v) for v in r) for r in df.collect())
