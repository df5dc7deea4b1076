import math


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def same(df, con, sql):
    """Rows of a DataFrame and of SQL as sorted plain tuples, columns by name."""
    names = sorted(df.columns)
    left = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    cur = con.execute(sql)
    at = {d[0]: i for i, d in enumerate(cur.description)}
    assert sorted(at) == names
    right = sorted((tuple(plain(r[at[c]]) for c in names) for r in cur.fetchall()), key=repr)
    return left, right
