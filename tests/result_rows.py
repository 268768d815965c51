"""Results of queries as plain rows."""


def rows(df, *order):
    """Collect a small result as a list of dicts, ordered by ``order``."""
    out = [r.asDict() for r in df.collect()]
    return sorted(out, key=lambda r: tuple((r[c] is None, r[c]) for c in order)) if order else out
