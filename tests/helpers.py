import hashlib
import math


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 9) + 0.0)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def digest(cols, rows):
    return hashlib.md5(repr(canon(cols, rows)).encode()).hexdigest()


def assert_same(df, con, sql):
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    a, b = canon(df.columns, rows), canon(ocols, orows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        raise AssertionError(f"value mismatch, first differences: {diff}")
