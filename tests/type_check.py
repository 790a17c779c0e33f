"""List registered queries whose column types differ between Spark and DuckDB.

Usage: python tests/type_check.py [sf_dir]. Only plans are built on the Spark
side (schemas, no execution beyond eager checkpoints); DuckDB runs LIMIT 0.
"""
import sys

sys.path.insert(0, ".")

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT",
                 "tinyint": "TINYINT", "timestamp": "TIMESTAMP WITH TIME ZONE", "timestamp_ntz": "TIMESTAMP"}


def main(sf_dir):
    import __spark_entry__ as E
    from pricewise.session import build_session
    from tests.oracle_check import duck
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    sqls = E.oracle_sql()
    bad = 0
    for name, fn in sorted(E.queries().items()):
        if name not in sqls:
            continue
        s_types = {c: SPARK_TO_DUCK.get(t, t) for c, t in fn(spark, sf_dir).dtypes}
        rel = con.sql(f"SELECT * FROM ({sqls[name]}) LIMIT 0")
        d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (s_types.get(c), d_types.get(c)) for c in set(s_types) | set(d_types)
                if s_types.get(c) != d_types.get(c)}
        if diff:
            bad += 1
            print(name, diff, flush=True)
    print("mismatched queries:", bad)


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01")
