import sqlite3

import pytest

from larkspur.functions.values import real_text
from larkspur.session import Engine
from larkspur.shell import Shell

SHOP = """
CREATE TABLE fruit(id INTEGER PRIMARY KEY, name TEXT, price REAL, kind TEXT, stock INTEGER);
CREATE INDEX by_kind ON fruit(kind);
INSERT INTO fruit VALUES (1,'pear',1.5,'pome',100),(2,'plum',0.75,'stone',200),(3,'apple',2,'pome',NULL),(4,NULL,-0.0,'stone',50),(5,'cherry',2.2250738585072014e-308,NULL,-3);
"""


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shop") / "s.db")
    db = sqlite3.connect(path)
    db.executescript(SHOP)
    return Engine(spark, sqlite=path), db


def run(engine, text):
    return Shell(engine).process(text)


def test_headers_nulls_and_reals(shop):
    assert run(shop[0], ".headers on\n.mode list\nSELECT * FROM fruit ORDER BY id;\n") == (
        "id|name|price|kind|stock\n1|pear|1.5|pome|100\n2|plum|0.75|stone|200\n3|apple|2.0|pome|\n4||0.0|stone|50\n5|cherry|2.2250738585072e-308||-3\n"
    )


def test_separator_comments_several_statements(shop):
    text = "-- first\n.separator ,\nSELECT id, name FROM fruit\n  WHERE kind = 'pome' -- inside\n ORDER BY name; SELECT id FROM fruit WHERE id IS 2;\n\nSELECT 'a;b' AS x FROM fruit LIMIT 1;"
    assert run(shop[0], text) == "3,apple\n1,pear\n2\na;b\n"


def test_errors_do_not_end_the_batch(shop):
    out = run(shop[0], "SELECT nope FROM fruit;\nSELECT * FROM nowhere;\nSELEC 1;\nSELECT id FROM fruit WHERE id = 1;\n.quit\nSELECT id FROM fruit;")
    assert out.splitlines() == ["Error: no such column: nope", "Error: no such table: nowhere", "Error: expected SELECT at 0, found 'SELEC'", "1"]


def test_empty_results_print_nothing(shop):
    assert run(shop[0], ".headers on\nSELECT * FROM fruit WHERE id > 100;\nSELECT * FROM fruit LIMIT 0;") == ""


def test_explain_shows_the_plan(shop):
    out = run(shop[0], "EXPLAIN SELECT name FROM fruit ORDER BY price LIMIT 3;")
    assert "TakeOrderedAndProject" in out
    assert "TakeOrderedAndProject" in shop[0].explain("SELECT name FROM fruit ORDER BY price LIMIT 3")


def test_rows_as_dicts(shop):
    assert shop[0].rows("SELECT id AS k, name AS k FROM fruit WHERE id < 3 ORDER BY id") == [{"k": "pear"}, {"k": "plum"}]
    assert shop[0].rows("SELECT stock+1, -price, typeof(kind), 'x' FROM fruit WHERE id = 1") == [{"stock+1": 101, "-price": -1.5, "typeof(kind)": "text", "x": "x"}]


@pytest.mark.parametrize("sql", ["SELECT id FROM fruit WHERE kind IN ('pome', 'stone') AND stock > 60;", "SELECT id FROM fruit WHERE kind IS NOT 'pome' ORDER BY id;", "SELECT id FROM fruit WHERE kind = 'pome' AND price > 1.6;",
                                 "SELECT name || ':' || price AS t FROM fruit WHERE price > 0.5 ORDER BY id;", "SELECT id FROM fruit ORDER BY kind, price DESC;", "SELECT name FROM fruit WHERE (kind = 'pome' OR stock = 50) AND id < 4;"])
def test_like_the_library(shop, sql):
    want = "".join("|".join("" if x is None else real_text(x) if isinstance(x, float) else str(x) for x in r) + "\n" for r in shop[1].execute(sql))
    assert run(shop[0], sql) == want


@pytest.mark.parametrize("v", [0.0, -0.0, 1.0, 1.5, 1e15, 1e14, 123456789012345.6, 1e-5, 0.0001, 1.7976931348623157e308, 3.14, 100.0, 1e100, -2.5e-10, 0.1 + 0.2, 99999999999999.9])
def test_real_text(spark, v):
    from pyspark.sql import functions as F

    from larkspur.functions.values import _real_texts

    db = sqlite3.connect(":memory:")
    want = db.execute("SELECT ? || ''", (v,)).fetchone()[0]
    want = "0.0" if want == "-0.0" else want
    assert real_text(v) == want
    assert spark.range(1).select(_real_texts(F.lit(v))).first()[0] == want


#: A column of each declared type that the file format's affinity rules tell apart.
TYPES = {
    "id": "INTEGER PRIMARY KEY", **{f"i_{t.lower().replace(' ', '_')}": f'"{t}"' if " " in t else t for t in ("INTEGER", "INT", "TINYINT", "SMALLINT", "MEDIUMINT", "BIGINT", "UNSIGNED BIG INT", "INT2", "INT4", "INT8")},
    "t_text": "TEXT", "t_character": "CHARACTER(20)", "t_varchar": "VARCHAR(255)", "t_varying": '"VARYING CHARACTER(255)"', "t_nchar": "NCHAR(55)", "t_native": '"NATIVE CHARACTER(70)"', "t_nvarchar": "NVARCHAR(100)", "t_clob": "CLOB",
    "b_blob": "BLOB", "b_json": '"JSON BLOB"', "b_none": "", "r_real": "REAL", "r_double": "DOUBLE", "r_precision": '"DOUBLE PRECISION"', "r_float": "FLOAT",
    "n_numeric": "NUMERIC", "n_decimal": "DECIMAL(10,5)", "n_boolean": "BOOLEAN", "n_date": "DATE", "n_datetime": "DATETIME", "n_timestamp": "TIMESTAMP", "n_json": "JSON", "n_jsonb": "JSONB",
}


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "w.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE w(" + ", ".join(f"{c} {t}" for c, t in TYPES.items()) + ")")
    edges = [127, -128, 32767, -32768, 8388607, -8388608, 2147483647, 140737488355327, 2**63 - 1, -(2**63)]
    kinds = {
        "i": [edges, [0] * 10, [None] * 10, [1, 255, 65535, 2**24, -1, 2**47, 2**48, -(2**31) - 1, 7, 8]],
        "t": [["plain"] * 8, [""] * 8, [None] * 8, ["é", "7", "x'y", "a|b", " lead", "long " * 900, "tab\tbed", "1e5"]],
        "b": [[b"bytes", '{"a":1}', "any"], [b"", "[]", b"blob"], [None] * 3, [b"z" * 5000, "x", "text"]],
        "r": [[1.5, -2.25, 1e300, 3.0], [0, -0.0, 5, -7], [None] * 4, [1 / 3, 2.5e-9, 1e15, 123456789.125]],
        "n": [[12, 99.75, 1, "2024-01-31", "2024-01-31 10:00:00", "now", '{"k":2}', "[1]"], [0, 0, 0, "", "x", "y", "{}", "null"], [None] * 8, [-5, -0.125, 1, "1999", "20240131", 3, "7", 8.5]],
    }
    for i in range(4):
        row = [i + 1, *[x for k in "itbrn" for x in kinds[k][i]]]
        db.execute(f"INSERT INTO w VALUES({','.join('?' * len(TYPES))})", row)
    db.execute("CREATE TABLE goods(id INTEGER PRIMARY KEY, label TEXT, price REAL, shelf TEXT, stock INTEGER)")
    db.executemany("INSERT INTO goods VALUES(?,?,?,?,?)", [(i, f"{'abcdefgh'[i % 8]}{i}", i * 2.5 % 7, ("top", "low", None)[i % 3], None if i % 5 == 4 else i * 10) for i in range(1, 30)])
    db.execute("CREATE INDEX on_shelf ON goods(shelf)")
    db.commit()
    return Engine(spark, sqlite=path), db


def listed(db, sql, headers):
    """What the library's own shell prints in list mode, where it prints reals with 15 digits."""

    def text(x):
        return "" if x is None else real_text(x) if isinstance(x, float) else x.decode() if isinstance(x, bytes) else str(x)

    cursor = db.execute(sql)
    rows = cursor.fetchall()
    return "".join("|".join(r) + "\n" for r in ([[c[0] for c in cursor.description]] if headers and rows else []) + [list(map(text, r)) for r in rows])


STATEMENTS = [
    "SELECT * FROM w", *[f"SELECT id, {c}, typeof({c}) AS k FROM w" for c in ("i_integer", "b_none", "b_json", "r_float", "n_decimal", "n_timestamp", "n_jsonb")],
    "SELECT id, i_bigint, i_int8 FROM w WHERE i_bigint > 100 ORDER BY i_bigint DESC", "SELECT t_clob FROM w WHERE t_clob = 7", "SELECT r_real, r_real + 1 AS more, -r_double AS less FROM w ORDER BY r_real", "SELECT n_decimal FROM w ORDER BY n_decimal",
    "SELECT * FROM goods ORDER BY price, id", "SELECT label, price FROM goods ORDER BY price DESC, label LIMIT 3", "SELECT label FROM goods ORDER BY stock, id LIMIT 4 OFFSET 2", "SELECT * FROM goods LIMIT 5", "SELECT id, label FROM goods LIMIT 3 OFFSET 26",
    "SELECT label FROM goods WHERE shelf = 'top' ORDER BY id LIMIT 2", "SELECT id, shelf FROM goods WHERE shelf IS NULL", "SELECT id FROM goods WHERE shelf IS NOT 'low' AND stock >= 60", "SELECT id FROM goods WHERE shelf IN ('top', 'low') AND price > 5 ORDER BY id", "SELECT id FROM goods WHERE stock = 10 OR shelf = 'low' OR price < 1 ORDER BY id",
    "SELECT id, price > 3 AS p, shelf = 'top' AS t, stock IS NULL AS n FROM goods WHERE id < 9", "SELECT id, stock / 7 AS q, stock % 7 AS r, price * 2 AS d, label || '-' || stock AS s FROM goods WHERE id <> 4", "SELECT id FROM goods WHERE id = 99", "SELECT rowid AS r, id FROM goods WHERE rowid >= 28",
]


@pytest.mark.parametrize("headers", [True, False])
def test_a_batch_gives_the_librarys_lines(wide, headers):
    engine, db = wide
    got = run(engine, f".headers {'on' if headers else 'off'}\n.mode list\n" + "".join(f"{s};\n" for s in STATEMENTS))
    want = "".join(listed(db, s, headers) for s in STATEMENTS)
    assert got.splitlines() == want.splitlines()
