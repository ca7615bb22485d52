"""Runs an oracle's SQL over a few rows."""
import duckdb


def rows(sql, **tables):
    """tables: name -> (columns with types, rows). Rows of the result as sorted dicts' items."""
    con = duckdb.connect()
    for name, (columns, data) in tables.items():
        con.execute(f"create table {name} ({columns})")
        if data:
            con.executemany(f"insert into {name} values ({', '.join('?' * len(data[0]))})", data)
    r = con.execute(sql)
    cols = [c[0] for c in r.description]
    return normal([dict(zip(cols, x, strict=True)) for x in r.fetchall()])


def normal(dicts):
    return sorted(str(sorted((k, round(v, 9) if isinstance(v, float) else v) for k, v in d.items())) for d in dicts)


def of(df):
    return normal([r.asDict() for r in df.collect()])
