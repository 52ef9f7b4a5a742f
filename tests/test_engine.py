"""The SQL front end: refusals by name, the dialect's functions, tables and parameters."""

import pytest

from tidemark.engine import REFUSED_MYSQL, Engine
from tidemark.errors import BindError, ParseError, Unsupported


@pytest.fixture(scope="module")
def engine(spark):
    t = spark.createDataFrame([(1, "Äbc", 2.5), (2, "abcdef", None), (3, None, -1.5)], "id long, s string, x double")
    return Engine(spark, {"t": t, "u": t.filter("id < 3")})


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "text, name",
    [
        ("SELECT * FROM t RIGHT JOIN u ON t.id = u.id", "RIGHT JOIN"), ("SELECT * FROM t FULL OUTER JOIN u ON t.id = u.id", "FULL JOIN"), ("SELECT * FROM t JOIN u USING (id)", "USING"),
        ("SELECT id FROM t GROUP BY ROLLUP(id)", "ROLLUP"), ("SELECT id FROM t WHERE s ILIKE 'a'", "ILIKE"), ("SELECT id FROM t QUALIFY row_number() OVER (ORDER BY id) = 1", "QUALIFY"),
        ("WITH RECURSIVE x(n) AS (SELECT 1) SELECT n FROM x", "RECURSIVE"), ("SELECT id FROM t INTERSECT ALL SELECT id FROM u", "INTERSECT ALL"), ("SELECT id FROM t UNION (SELECT id FROM u)", "arm"),
        ("VALUES (1), (2)", "VALUES"), ("SELECT DISTINCT ON (id) id FROM t", "DISTINCT ON"), ("SAVEPOINT a", "SAVEPOINT"), ("SELECT id FROM t MINUS SELECT id FROM u", "MINUS"), ("DELETE FROM t", "queries"),
    ],
)
def test_refusals(engine, text, name):
    with pytest.raises(Unsupported, match=name):
        engine.sql(text)


def test_other_dialect_refuses_functions(spark, engine):
    other = Engine(spark, engine.tables, mysql=True)
    for f in REFUSED_MYSQL:
        with pytest.raises(Unsupported, match=f):
            other.sql(f"SELECT {f.lower()}(1) FROM t")
    assert rows(engine.sql("SELECT 'QUALIFY ILIKE' AS a /* ROLLUP */ -- MINUS\n FROM t WHERE id = 1")) == [("QUALIFY ILIKE",)]


def test_functions(engine):
    got = rows(engine.sql("SELECT upper(s), lower(s), hex(s), substr(s, -2), substr(s, 0, 2), substr(s, 3, -2), max(id, x), round(x) FROM t ORDER BY id"))
    assert got[0] == ("ÄBC", "Äbc", "C3846263", "bc", "Ä", "Äb", 2.5, 3.0)
    assert got[1] == ("ABCDEF", "abcdef", "616263646566", "ef", "a", "ab", None, None) and got[2][:3] == (None, None, "") and got[2][6:] == (3.0, -2.0)
    assert rows(engine.sql("SELECT id FROM t WHERE s LIKE '%BCD%' OR s LIKE 'x!%' ESCAPE '!'")) == [(2,)]
    assert rows(engine.sql("SELECT max(id) AS m, count(*) AS n FROM t")) == [(3, 3)]


def test_tables_and_parameters(engine):
    assert rows(engine.sql("SELECT t.id, b.s FROM t LEFT JOIN u AS b ON b.id = t.id AND b.id < ? WHERE t.id <= ? ORDER BY t.id", [2, 2])) == [(1, "Äbc"), (2, None)]
    assert rows(engine.sql("WITH c AS (SELECT id FROM T WHERE id > :low) SELECT count(*) AS n FROM c, u;", {"low": 1})) == [(4,)]
    with pytest.raises(BindError):
        engine.sql("SELECT ? FROM t", [1, 2])
    for bad in ("SELECT 'a FROM t", "SELECT 1; SELECT 2"):
        with pytest.raises(ParseError):
            engine.sql(bad)


def test_store(spark, tmp_path):
    from tidemark.sources.store import Spec, Store

    s = Store(spark, str(tmp_path / "db"))
    s.create_table("Items", [Spec("id", "INTEGER", primary_key=True), Spec("name", "TEXT")])
    s.insert("items", spark.createDataFrame([("a",), ("b",)], "name string").coalesce(1))
    assert rows(Engine(spark, s).sql("SELECT count(*) AS n FROM items WHERE items.id > 1")) == [(1,)]
