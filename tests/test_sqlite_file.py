"""The file reader against the SQLite library that comes with Python."""

import sqlite3

import pytest

from larkspur.session import Engine
from larkspur.sources.schema_text import columns_of, index_of
from larkspur.sources.sqlite_file import NotADatabase, Pages, decode, read_catalogue


def build(path, statements, page_size=4096):
    db = sqlite3.connect(path)
    db.execute(f"PRAGMA page_size={page_size}")
    for sql, *args in statements:
        db.execute(sql, *args)
    db.commit()
    return db


def all_rows(path, table):
    info = read_catalogue(path)[table]
    pages = Pages(path)
    out = []
    for leaf in pages.leaves(info.root):
        for rowid, record in pages.rows(leaf):
            v = decode(record, pages.header.encoding)
            out.append((rowid, *v, *[None] * (len(info.columns) - len(v))))
    pages.close()
    return out


@pytest.mark.parametrize("page_size", [512, 1024, 4096, 32768, 65536])
def test_overflow_and_levels(tmp_path, page_size):
    path = str(tmp_path / "x.db")
    sizes = [1, page_size - 36, page_size - 35, page_size - 34, 3 * page_size, 100_000]
    db = build(path, [("CREATE TABLE t(a TEXT, b BLOB)",), *[("INSERT INTO t VALUES(?,?)", ("é" * n, bytes(range(256)) * (n // 256 + 1))) for n in sizes],
                      *[("INSERT INTO t VALUES(?,?)", (f"row {i}", None)) for i in range(5000)]], page_size)
    assert all_rows(path, "t") == db.execute("SELECT rowid, a, b FROM t ORDER BY rowid").fetchall()


def test_rowids_and_short_records(tmp_path):
    path = str(tmp_path / "x.db")
    db = build(path, [("CREATE TABLE t(a TEXT, n INTEGER PRIMARY KEY)",), *[("INSERT INTO t VALUES(?,?)", (f"v{i}", i)) for i in (-(2**63), -5, 0, 7, 2**63 - 1)],
                      ("ALTER TABLE t ADD COLUMN late REAL",), ("INSERT INTO t VALUES('x', 8, 3)",)])
    got = [(r[0], r[1], r[3]) for r in all_rows(path, "t")]
    assert got == [(r, a, None if c is None else c) for r, a, c in db.execute("SELECT rowid, a, late FROM t ORDER BY n")]


def test_utf16(tmp_path):
    path = str(tmp_path / "x.db")
    db = sqlite3.connect(path)
    db.execute("PRAGMA encoding='UTF-16le'")
    db.execute("CREATE TABLE t(a TEXT)")
    db.execute("INSERT INTO t VALUES('zażółć 🎉')")
    db.commit()
    assert all_rows(path, "t") == [(1, "zażółć 🎉")]


def test_not_a_database(tmp_path):
    p = tmp_path / "x"
    p.write_bytes(b"no database at all" * 20)
    with pytest.raises(NotADatabase):
        read_catalogue(str(p))


def test_definitions():
    cols = columns_of('CREATE TABLE "my t"(id INTEGER PRIMARY KEY, "a b" VARCHAR(20) NOT NULL DEFAULT \'x,y\', c "UNSIGNED BIG INT", d, [e] DECIMAL(10, 5), `f` REAL, UNIQUE(c, d)) -- end')
    assert [(c.name, c.affinity, c.is_rowid) for c in cols] == [
        ("id", "integer", True), ("a b", "text", False), ("c", "integer", False), ("d", "blob", False), ("e", "numeric", False), ("f", "real", False)
    ]
    assert [c.is_rowid for c in columns_of("CREATE TABLE t(a TEXT, k INTEGER, PRIMARY KEY(k))")] == [False, True]
    assert not any(c.is_rowid for c in columns_of("CREATE TABLE t(a INT PRIMARY KEY, b INTEGER, c INTEGER, PRIMARY KEY(b, c))"))
    found = index_of("CREATE UNIQUE INDEX IF NOT EXISTS i ON t (a, b DESC) WHERE a > 1")
    assert (found.name, found.table, found.columns, found.unique) == ("i", "t", (("a", False), ("b", True)), True)


def test_engine_reads_in_parallel_and_pushes_down(spark, tmp_path):
    path = str(tmp_path / "x.db")
    db = build(path, [("CREATE TABLE big(id INTEGER PRIMARY KEY, k INTEGER, s TEXT)",), ("CREATE INDEX i ON big(k)",), ("CREATE VIEW w AS SELECT 1",),
                      *[("INSERT INTO big VALUES(?,?,?)", (i, i % 100, f"name {i}" * 3)) for i in range(30_000)]], 512)
    engine = Engine(spark, sqlite=path)
    assert engine.tables() == ["big"]
    assert engine.plan("SELECT * FROM big").rdd.getNumPartitions() > 1
    for sql in ("SELECT * FROM big WHERE k = 7 AND s != 'x' ORDER BY id", "SELECT count(*), sum(k) FROM big", "SELECT rowid, s FROM big WHERE rowid > 29990 ORDER BY rowid DESC", "SELECT id FROM big WHERE s != '' LIMIT 9 OFFSET 4"):
        assert [tuple(r) for r in engine.plan(sql).collect()] == db.execute(sql).fetchall(), sql
    engine.close()
    assert engine.tables() == []


def test_every_class(spark, tmp_path):
    path = str(tmp_path / "x.db")
    rows = [(1, 2**63 - 1, "text", b"\x00\xff", 1.5, 99.99, "any"), (2, -(2**63), "", b"", -0.0, 0, b"\x01"), (3, None, None, None, None, None, None), (4, 127, "é", b"a", 3, "x", 12)]
    db = build(path, [("CREATE TABLE v(id INTEGER PRIMARY KEY, i BIGINT, t VARCHAR(9), b BLOB, r DOUBLE, n DECIMAL(10,5), d)",), *[("INSERT INTO v VALUES(?,?,?,?,?,?,?)", r) for r in rows]])
    engine = Engine(spark, sqlite=path)
    sql = "SELECT typeof(i) i, typeof(t) t, typeof(b) b, typeof(r) r, typeof(n) n, typeof(d) d FROM v ORDER BY id"
    assert [tuple(r) for r in engine.plan(sql).collect()] == db.execute(sql).fetchall()
    kinds = dict(engine.plan("SELECT * FROM v").dtypes)
    assert (kinds["i"], kinds["t"], kinds["b"], kinds["r"]) == ("bigint", "string", "binary", "double") and kinds["d"].startswith("struct")


def test_the_driver_reads_interior_pages_and_one_leaf(tmp_path, monkeypatch):
    path = str(tmp_path / "x.db")
    db = build(path, [("CREATE TABLE big(id INTEGER PRIMARY KEY, s TEXT)",), *[("INSERT INTO big VALUES(?,?)", (i, f"name {i}" * 4)) for i in range(20_000)]], 512)
    read = []
    plain = Pages.page
    monkeypatch.setattr(Pages, "page", lambda self, n: read.append(n) or plain(self, n))
    root = read_catalogue(path)["big"].root
    read.clear()
    pages = Pages(path)
    leaves = pages.leaves(root)
    kinds = [plain(pages, n)[0] for n in set(read)]
    assert kinds.count(13) == 1 and kinds.count(5) == len(kinds) - 1 and len(set(read)) * 20 < len(leaves)
    assert sum(1 for leaf in leaves for _ in pages.rows(leaf)) == 20_000 and db.execute("SELECT count(*) FROM big").fetchone() == (20_000,)


def test_a_table_that_cannot_be_read_fails_alone_and_classes_are_lazy(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.db")
    build(path, [("CREATE TABLE a(x INTEGER)",), ("INSERT INTO a VALUES(3)",), ("CREATE TABLE w(k TEXT PRIMARY KEY, v INTEGER) WITHOUT ROWID",), ("INSERT INTO w VALUES('a', 1)",), ("CREATE TABLE n(c TEXT DEFAULT 'WITHOUT ROWID')",)])
    engine = Engine(spark, sqlite=path)
    assert engine.tables() == ["a", "n", "w"] and not engine.catalogue.tables
    assert [tuple(r) for r in engine.plan("SELECT x FROM main.a").collect()] == [(3,)]
    assert set(engine.catalogue.tables) == {"a"}
    for _ in range(2):
        with pytest.raises(LookupError, match="WITHOUT ROWID"):
            engine.plan("SELECT * FROM w")
    assert engine.plan("SELECT * FROM n").collect() == []


def test_content_in_a_write_ahead_log_is_refused(tmp_path):
    path = str(tmp_path / "x.db")
    db = sqlite3.connect(path)
    db.execute("PRAGMA journal_mode=WAL")
    db.execute("CREATE TABLE a(x INTEGER)")
    db.commit()
    with pytest.raises(NotADatabase, match="-wal"):
        read_catalogue(path)
    db.close()
    assert set(read_catalogue(path)) == {"a"}
