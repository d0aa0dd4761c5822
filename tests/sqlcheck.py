"""Comparing a query with its SQL."""


def plain(rows, columns):
    """Rows as sorted tuples with columns in name order, numbers compared to nine digits."""

    def one(v):
        if v is None or v != v:
            return "~"
        if isinstance(v, bool):
            return str(int(v))
        if isinstance(v, (int, float)):
            return f"{float(v):.9g}"
        return str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same_as_sql(df, db, sql):
    found = db.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    return plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), found.columns)
