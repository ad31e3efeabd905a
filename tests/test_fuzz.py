"""Random statements against the SQLite library that comes with Python."""

import math
import random
import sqlite3

import pytest

from larkspur.session import Engine


def _value(rng, kind):
    if rng.random() < 0.2:
        return None
    return {
        # small numbers that meet, the edges of stored widths, and what sums and products of three of them keep within 64 bits
        "int": lambda: rng.choice([*range(-3, 12), -(2**7), 2**15 - 1, 2**16 + 1, -(2**20)]),
        # plain words in both cases, texts that read as numbers in full or in part, blanks, quotes, beyond ASCII, a long one
        "text": lambda: rng.choice(["apple", "Apple", "hello", "10", "7", " 4\t", "+8", "-3.5", "6e2", ".5", "9lives", "0x1F", "", " ", "it's", "%_", "ß", "zażółć", "long " * 60]),
        # whole values, halves, negative zero, and magnitudes that print with an exponent
        "real": lambda: rng.choice([-0.0, 1.0, 4.0, 7.0, 0.5, -2.25, 1 / 3, 6.02e23, 1.6e-19]),
        "mixed": lambda: _value(rng, rng.choice(["int", "text", "real", "blob"])),
        "blob": lambda: rng.choice([b"", b"\x01", b"7", b"hello", "zaż".encode()]),
    }[kind]()


@pytest.fixture(scope="module")
def pair(spark, tmp_path_factory):
    rng = random.Random(5)
    path = str(tmp_path_factory.mktemp("fuzz") / "t.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE t(id INTEGER PRIMARY KEY, a INTEGER, b TEXT, c REAL, d)")
    for i in range(1, 61):
        db.execute("INSERT INTO t VALUES(?,?,?,?,?)", (i, *(_value(rng, k) for k in ("int", "text", "real", "mixed"))))
    db.execute("CREATE TABLE u(k INTEGER, w TEXT)")
    for _ in range(15):
        db.execute("INSERT INTO u VALUES(?,?)", (_value(rng, "int"), _value(rng, "text")))
    db.commit()
    return Engine(spark, sqlite=path), db


_COLUMNS = ["id", "a", "b", "c", "rowid"]
_LITERALS = ["0", "1", "7", "10", "-1", "2.5", "'10'", "'hello'", "'7'", "''", "NULL", "'1e3'", "3.0"]


def _expr(rng, depth, columns):
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(columns if rng.random() < 0.65 else _LITERALS)
    sub = lambda: _expr(rng, depth - 1, columns)
    kind = rng.random()
    if kind < 0.3:
        return f"({sub()} {rng.choice(['=', '!=', '<', '<=', '>', '>=', '==', '<>', 'IS', 'IS NOT'])} {sub()})"
    if kind < 0.5:
        return f"({sub()} {rng.choice(['+', '-', '*', '/', '%'])} {sub()})"
    if kind < 0.58:
        return f"({sub()} || {sub()})"
    if kind < 0.66:
        return f"typeof({sub()})"
    if kind < 0.72:
        return f"({rng.choice(['-', '+', 'NOT'])} {sub()})"
    if kind < 0.8:
        return f"({sub()} {rng.choice(['AND', 'OR'])} {sub()})"
    if kind < 0.88:
        return f"({sub()} {rng.choice(['', 'NOT '])}IN ({', '.join(rng.choice(_LITERALS) for _ in range(rng.randint(1, 4)))}))"
    if kind < 0.94:
        return f"({sub()} IS {rng.choice(['', 'NOT '])}NULL)"
    return f"({sub()} BETWEEN {sub()} AND {sub()})"


def _plain(v):
    if hasattr(v, "cls"):
        v = next((x for x in (v.t, v.b, v.i, v.num) if x is not None), None)
    if isinstance(v, bytearray):
        v = bytes(v)
    if isinstance(v, float):
        return "inf" if math.isinf(v) else float(f"{v:.12g}")
    return v


def _same(a, b):
    a, b = _plain(a), _plain(b)
    return type(a) is type(b) and a == b


def test_expressions(pair):
    engine, db = pair
    rng = random.Random(11)
    bad = []
    for columns in (_COLUMNS, [*_COLUMNS, "d"]):
        for _ in range(6):
            exprs = [_expr(rng, 2, columns) for _ in range(8)]
            sql = "SELECT id, " + ", ".join(f"{e} AS e{i}" for i, e in enumerate(exprs)) + " FROM t ORDER BY id"
            want = db.execute(sql).fetchall()
            got = engine.plan(sql).collect()
            for i, e in enumerate(exprs, 1):
                for x, y in zip(want, got, strict=True):
                    if not _same(x[i], y[i]):
                        bad.append((e, x[0], x[i], _plain(y[i]), db.execute("SELECT a, b, c, d FROM t WHERE id=?", (x[0],)).fetchone()))
                        break
    assert not bad, bad[:6]


def test_filters_and_order(pair):
    engine, db = pair
    rng = random.Random(23)
    for k in range(20):
        columns = [*_COLUMNS, "d"] if k % 2 else _COLUMNS
        where = _expr(rng, 2, columns)
        keys = ", ".join(f"{rng.choice(columns)}{rng.choice(['', ' DESC', ' ASC'])}" for _ in range(rng.randint(1, 3)))
        cut = rng.choice(["", " LIMIT 5", " LIMIT 7 OFFSET 3", " LIMIT 0", " LIMIT 50 OFFSET 100"])
        sql = f"SELECT id, a, b FROM t WHERE {where} ORDER BY {keys}, id{cut}"
        assert [tuple(r) for r in engine.plan(sql).collect()] == db.execute(sql).fetchall(), sql


@pytest.mark.parametrize("sql", [
    "SELECT id FROM t LIMIT 4",
    "SELECT id FROM t WHERE a IS NOT NULL LIMIT 4 OFFSET 2",
    "SELECT id FROM t ORDER BY rowid DESC",
    "SELECT a b, id FROM t WHERE b = 'hello'",
    "SELECT a + 1 AS n, id FROM t WHERE n > 8 ORDER BY n DESC, id LIMIT 3",
    "SELECT id, -7 / 2 AS q, -7 % 2 AS r, 5.5 % 2 AS s, 1 + 2 || 3 AS u FROM t ORDER BY id",
    "SELECT id, 'it''s' AS s, .5 AS f, 1e3 AS g, \"a\" AS q FROM t ORDER BY id -- the end",
    "SELECT d FROM t ORDER BY d, id",
    "SELECT typeof(d) AS k, count(*) AS n FROM t GROUP BY typeof(d) ORDER BY k",
    "SELECT b, count(*) AS n, sum(a) AS s, avg(c) AS m, min(c) AS lo, max(a) AS hi FROM t GROUP BY b ORDER BY b",
    "SELECT DISTINCT a FROM t ORDER BY a DESC",
    "SELECT x.id, y.id AS other FROM t x JOIN t y ON x.a = y.a AND x.id < y.id ORDER BY x.id, y.id",
    "SELECT x.id, y.b FROM t x LEFT JOIN t y ON x.id + 50 = y.id ORDER BY x.id",
    "SELECT a FROM t UNION SELECT id FROM t ORDER BY 1",
    "SELECT a FROM t EXCEPT SELECT id FROM t ORDER BY a",
    "SELECT CASE a WHEN 7 THEN 'seven' WHEN 10 THEN 10 ELSE b END AS v, id FROM t ORDER BY id",
    "SELECT id, CAST(b AS INTEGER) AS i, CAST(c AS TEXT) AS s, CAST(a AS REAL) AS r FROM t ORDER BY id",
    "SELECT id FROM t WHERE b LIKE '%E%' OR b GLOB '[0-9]*' ORDER BY id",
    "SELECT coalesce(a, b, c) AS v, ifnull(c, 0.5) AS w, nullif(a, 7) AS x, abs(a) AS y, length(b) AS z, upper(b) AS u, id FROM t ORDER BY id",
    "SELECT count(*) FROM (SELECT DISTINCT b FROM t)",
    "SELECT a & 3 AS x, a | 8 AS y, a << 2 AS z, a >> 1 AS w, ~a AS v, id FROM t ORDER BY id",
    "SELECT id FROM t WHERE a IN (SELECT id FROM t) ORDER BY id",
    "SELECT id FROM t WHERE a NOT IN (SELECT id FROM t WHERE id > 8) ORDER BY id",
    "SELECT id FROM t WHERE a NOT IN (SELECT a FROM t) ORDER BY id",
    "SELECT id FROM t WHERE a NOT IN (SELECT a FROM t WHERE id > 999) ORDER BY id",
    "WITH x(k) AS (SELECT a FROM t), y AS (SELECT k + 1 AS m FROM x WHERE k IS NOT NULL) SELECT m, count(*) AS n FROM y GROUP BY m ORDER BY m",
    "SELECT id, row_number() OVER (ORDER BY b, id) AS r, sum(a) OVER (PARTITION BY b ORDER BY id) AS s, count(*) OVER (PARTITION BY b) AS n, lead(id, 2) OVER (ORDER BY id) AS l FROM t ORDER BY id",
    "SELECT max(a, id) AS hi, min(a, id, 3) AS lo, id FROM t ORDER BY id",
    "SELECT 1+1 AS x, 'a' AS y",
    "SELECT 1 WHERE 0",
    "VALUES (1,'a'),(2,NULL)",
    "SELECT * FROM (VALUES (1,'a'),(2,'b')) ORDER BY column1 DESC",
    "SELECT id, (SELECT max(k) FROM u) AS m FROM t ORDER BY id",
    "SELECT id, (SELECT count(*) FROM u WHERE u.k = t.a) AS m FROM t ORDER BY id",
    "SELECT id FROM t WHERE a = (SELECT min(k) FROM u) ORDER BY id",
    "SELECT id FROM t WHERE a > (SELECT avg(k) FROM u WHERE w = b COLLATE NOCASE) ORDER BY id",
    "SELECT id FROM t WHERE EXISTS (SELECT 1 FROM u WHERE u.k = t.a) ORDER BY id",
    "SELECT id FROM t WHERE NOT EXISTS (SELECT 1 FROM u WHERE k = a) ORDER BY id",
    "SELECT id FROM t WHERE a IN (SELECT k FROM u WHERE w = b) ORDER BY id",
    "SELECT id FROM t WHERE a NOT IN (SELECT k FROM u WHERE w = b) ORDER BY id",
    "SELECT id FROM t WHERE a = 1 OR EXISTS (SELECT 1 FROM u WHERE u.k = t.a + 1) ORDER BY id",
    "SELECT id, EXISTS (SELECT 1 FROM u WHERE k = 9) AS e FROM t ORDER BY id LIMIT 2",
    "SELECT a, count(*) FILTER (WHERE b = 'x') AS n, sum(c) FILTER (WHERE id > 10) AS s FROM t GROUP BY a ORDER BY a",
    "SELECT id, count(*) FILTER (WHERE b = 'y') OVER (ORDER BY id) AS n FROM t ORDER BY id",
    "SELECT id, sum(a) OVER (ORDER BY id RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM t ORDER BY id",
    "SELECT id, count(*) OVER (ORDER BY a GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS s FROM t ORDER BY id",
    "SELECT id, sum(id) OVER w AS s, row_number() OVER (w ROWS UNBOUNDED PRECEDING) AS r FROM t WINDOW w AS (PARTITION BY b ORDER BY id) ORDER BY id LIMIT 9",
    "SELECT id FROM t WHERE b = 'Y' COLLATE NOCASE ORDER BY b COLLATE NOCASE, id",
    "SELECT id, b FROM t ORDER BY b COLLATE NOCASE DESC, id",
    "SELECT id FROM t WHERE b LIKE '5!_%' ESCAPE '!' ORDER BY id",
    "SELECT id FROM t WHERE b LIKE '%!%' ESCAPE '!' ORDER BY id",
    "SELECT id FROM t WHERE b NOT LIKE b ORDER BY id",
    "SELECT id FROM t WHERE b LIKE upper(b) ORDER BY id",
    "SELECT b, max(id) AS m, a FROM t GROUP BY b ORDER BY b",
    "SELECT b, min(c) AS m, a+1 AS n FROM t WHERE c IS NOT NULL AND id<9 GROUP BY b ORDER BY b",
    "SELECT a, group_concat(b) IS NULL AS g FROM t GROUP BY a ORDER BY a",
    "SELECT id, count(*) OVER () AS n FROM main.t ORDER BY id LIMIT 3 OFFSET 2",
    "SELECT a, (SELECT count(*) FROM u WHERE k = a) AS n, count(*) AS c FROM t GROUP BY a ORDER BY a",
    "SELECT id FROM t x WHERE a = (SELECT max(a) FROM t y WHERE y.b = x.b) ORDER BY id",
    "SELECT id, (SELECT w FROM u WHERE u.k = t.a ORDER BY w LIMIT 1) AS f FROM t ORDER BY id",
    "SELECT id FROM t WHERE (SELECT count(*) FROM u WHERE k = a) BETWEEN 1 AND 2 ORDER BY id",
    "SELECT id, a IN (SELECT k FROM u WHERE k IS NOT NULL) AS i FROM t ORDER BY id",
    "SELECT count(*) OVER () AS n, row_number() OVER (ORDER BY b, id) AS r FROM t ORDER BY id LIMIT 3",
    "SELECT id FROM t ORDER BY row_number() OVER (ORDER BY id DESC) LIMIT 4 OFFSET 1",
    "SELECT a, count(*) AS n, rank() OVER (ORDER BY count(*) DESC) AS r FROM t GROUP BY a ORDER BY r, a",
    "SELECT group_concat(w) IS NULL, group_concat('') AS e FROM (SELECT '' AS w)",
])
def test_statement(pair, sql):
    engine, db = pair
    want, got = db.execute(sql).fetchall(), engine.plan(sql).collect()
    assert len(want) == len(got)
    for x, y in zip(want, got, strict=True):
        assert all(_same(a, b) for a, b in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize(("sql", "params"), [
    ("SELECT id FROM t WHERE a = ? AND b <> ? ORDER BY id LIMIT ?", (2, "x", 3)),
    ("SELECT id, ?2 AS x, ?1 AS y, ? AS z FROM t WHERE id < 3 ORDER BY id", ("p", 1.5, None)),
    ("SELECT :k + 1 AS n, $s AS s, @b AS b", {"k": 4, "s": "it's", "b": b"\x01"}),
    ("SELECT id, a IS TRUE AS t, a IS NOT FALSE AS f, TRUE AS x, b IS FALSE AS g FROM t ORDER BY id", ()),
    ("SELECT id FROM t WHERE (a, id) > (2, 10) ORDER BY id", ()),
    ("SELECT id FROM t WHERE (a, b) = (7, '7') OR (id, a) IN ((1, 3), (4, 2)) ORDER BY id", ()),
    ("SELECT id, (a, b) IS (1, NULL) AS i, (a, id) <= (3, 7) AS l, (a, b) <> (1, 'apple') AS n FROM t ORDER BY id", ()),
    ("SELECT id FROM t WHERE (a, id) NOT IN ((1, 0), (3, 1)) ORDER BY id", ()),
    ("SELECT id, hex(b) AS h, unicode(b) AS u, sign(c) AS s, sign(b) AS t, hex(a) AS i FROM t ORDER BY id", ()),
    ("SELECT typeof(CURRENT_DATE) AS d, length(CURRENT_TIMESTAMP) AS t, length(CURRENT_TIME) AS s", ()),
])
def test_variables_rows_and_truth(pair, sql, params):
    engine, db = pair
    want, got = db.execute(sql, params).fetchall(), engine.plan(sql, params).collect()
    assert len(want) == len(got)
    for x, y in zip(want, got, strict=True):
        assert all(_same(a, b) for a, b in zip(x, y, strict=True)), (x, y)
