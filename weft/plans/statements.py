"""Statements as text, each query in a namespace of its own."""

from __future__ import annotations

from weft.operators.statements import Statements
from weft.plans.base import Catalog, table

_C = Catalog()
QUERIES, ORACLE = _C.queries, _C.oracle


def _script(name: str, statements: list[str], sql: str) -> None:
    """The rows of the last statement; the tables of the directory are views of the session."""

    def run(spark, sf_dir):
        for t in ("nation", "region", "supplier", "customer"):
            table(spark, sf_dir, t).createOrReplaceTempView(t)
        before = spark.catalog.currentDatabase()
        spark.sql(f"DROP DATABASE IF EXISTS weft_{name} CASCADE")
        on, out = Statements(spark, f"weft_{name}"), None
        try:
            for s in statements:
                out = on.execute(s)
        finally:
            spark.catalog.setCurrentDatabase(before)
        return out

    _C.query(name, sql)(run)


_script("ddl_create_insert", ["CREATE TABLE box (id INTEGER NOT NULL, name VARCHAR(20) DEFAULT 'none', size DOUBLE, PRIMARY KEY (id))", "INSERT INTO box VALUES (1, 'a', 1.5), (2, 'b', NULL)", "INSERT INTO box (id) VALUES (3)", "INSERT INTO box (id, size) SELECT r_regionkey + 10, 2 FROM region", "SELECT * FROM box"],
        "SELECT * FROM (VALUES (1, 'a', 1.5), (2, 'b', NULL), (3, 'none', NULL)) AS t(id, name, size) UNION ALL SELECT r_regionkey + 10, 'none', 2.0 FROM region")
_script("ddl_alter_table", ["CREATE TABLE box AS SELECT n_nationkey AS id, n_name AS name, n_regionkey AS r FROM nation", "ALTER TABLE box ADD COLUMN mark VARCHAR(5) DEFAULT 'x'", "ALTER TABLE box RENAME COLUMN name TO label", "ALTER TABLE box MODIFY COLUMN r SET TYPE VARCHAR(10)", "ALTER TABLE box RENAME TO crate", "ALTER TABLE crate DROP COLUMN id", "ALTER TABLE crate PARTITION BY LIST (r)", "ALTER TABLE crate MERGE PARTITIONS", "SELECT label, r, mark FROM crate"],
        "SELECT n_name AS label, CAST(n_regionkey AS VARCHAR) AS r, 'x' AS mark FROM nation")
_script("ddl_update_delete", ["CREATE TABLE box AS SELECT n_nationkey AS id, n_name AS name, n_regionkey AS r FROM nation", "UPDATE box SET name = upper(concat(name, 'q')), r = r + 1 WHERE r >= 3", "DELETE FROM box WHERE id < 5 OR name = 'x'", "SELECT * FROM box"],
        "SELECT n_nationkey AS id, CASE WHEN n_regionkey >= 3 THEN upper(n_name || 'q') ELSE n_name END AS name, CASE WHEN n_regionkey >= 3 THEN n_regionkey + 1 ELSE n_regionkey END AS r FROM nation WHERE n_nationkey >= 5")
_script("ddl_merge", ["CREATE TABLE box AS SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey < 10", "MERGE INTO box AS b USING (SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_nationkey >= 5) AS s ON b.id = s.k WHEN MATCHED THEN UPDATE SET name = concat('r', s.r) WHEN NOT MATCHED THEN INSERT (id, name) VALUES (s.k, 'new')", "SELECT * FROM box"],
        "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 5 THEN n_name WHEN n_nationkey < 10 THEN 'r' || n_regionkey ELSE 'new' END AS name FROM nation")
_script("ddl_views", ["CREATE TABLE box AS SELECT n_nationkey AS id, n_regionkey AS r FROM nation", "CREATE VIEW few AS SELECT id, r FROM box WHERE r = 1", "ALTER VIEW few RENAME COLUMN r TO region", "ALTER VIEW few RENAME TO some", "CREATE MATERIALIZED VIEW sums AS SELECT r, count(*) AS n FROM box GROUP BY r FRESHNESS MANUAL", "DELETE FROM box WHERE id < 10", "ALTER MATERIALIZED VIEW sums FRESHNESS MANUAL", "ALTER MATERIALIZED VIEW sums RENAME COLUMN n TO total", "SELECT some.id, some.region, sums.total FROM some JOIN sums ON some.region = sums.r"],
        "SELECT n_nationkey AS id, n_regionkey AS region, count(*) OVER () AS total FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 10")
_script("ddl_namespaces", ["CREATE NAMESPACE IF NOT EXISTS weft_other", "CREATE TABLE IF NOT EXISTS weft_other.box (id BIGINT UNIQUE, tags VARCHAR(9) ARRAY(1, 5))", "TRUNCATE TABLE weft_other.box", "INSERT INTO weft_other.box VALUES (7, array('a', 'b'))", "CREATE TABLE mine AS SELECT * FROM weft_other.box", "DROP NAMESPACE weft_other", "SELECT * FROM mine"], "SELECT CAST(7 AS BIGINT) AS id, ['a', 'b'] AS tags")
_script("ddl_constraints", ["CREATE TABLE parent AS SELECT r_regionkey AS id FROM region", "ALTER TABLE parent ADD PRIMARY KEY (id)", "CREATE TABLE child (id INTEGER, p INTEGER, CONSTRAINT up FOREIGN KEY (p) REFERENCES parent (id), CHECK (id > 0))", "ALTER TABLE child ADD UNIQUE INDEX one ON (id, p)", "INSERT INTO child VALUES (1, 0), (2, 1), (2, 2)", "ALTER TABLE child DROP FOREIGN KEY up", "ALTER TABLE child DROP INDEX one", "INSERT INTO child VALUES (2, 1), (3, 999)", "SELECT p, count(*) AS n FROM child GROUP BY p ORDER BY p"], "SELECT * FROM (VALUES (0, 1), (1, 2), (2, 1), (999, 1)) AS t(p, n)")
