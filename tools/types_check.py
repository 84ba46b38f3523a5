"""Compare the column types of every Spark query with its DuckDB oracle."""
import importlib.util, sys
sys.path.insert(0, '/root/repo')
import duckdb
from redline.session import local_session
spec = importlib.util.spec_from_file_location("e", "/root/repo/__spark_entry__.py"); e = importlib.util.module_from_spec(spec); spec.loader.exec_module(e)
spark = local_session()
sf = sys.argv[1] if len(sys.argv) > 1 else '/root/testdata/sf0.001'
con = duckdb.connect()
for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
M = {'bigint': 'BIGINT', 'int': 'INTEGER', 'string': 'VARCHAR', 'boolean': 'BOOLEAN', 'double': 'DOUBLE', 'float': 'FLOAT'}
qs, sql = e.queries(), e.oracle_sql()
bad = 0
for k in qs:
    sp = dict(qs[k](spark, sf).dtypes)
    rel = con.sql(sql[k])
    dk = dict(zip(rel.columns, [str(t) for t in rel.types]))
    diffs = {c: (sp.get(c), dk.get(c)) for c in set(sp) | set(dk) if M.get(sp.get(c), sp.get(c)) != dk.get(c)}
    if diffs:
        bad += 1
        print(k, diffs)
print('queries with type differences:', bad)
