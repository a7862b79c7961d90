"""Comparing a DataFrame with a SQL query of another engine."""


def plain(value):
    """A value that compares equal across engines."""
    import decimal

    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


def same_rows(df, connection, sql):
    """Assert that a DataFrame and a query give the same bag of rows and the same column names."""
    names = sorted(df.columns)
    found = connection.execute(sql)
    own = [c[0] for c in found.description]
    assert sorted(own) == names
    order = [own.index(n) for n in names]
    expected = sorted(repr([plain(row[i]) for i in order]) for row in found.fetchall())
    assert sorted(repr([plain(row[n]) for n in names]) for row in df.collect()) == expected
