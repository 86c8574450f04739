"""Results of two engines in one form."""

from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(con, sf_dir):
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, bool):
            return ("b", x)
        if isinstance(x, (int, float, Decimal)):
            return ("n", round(float(x), 6))
        return ("", "") if x is None else ("s", str(x))

    return sorted(tuple(plain(r[i]) for i in order) for r in data)
