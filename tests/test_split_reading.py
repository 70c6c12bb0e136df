"""Quoted line breaks and SQL dumps, cut at any byte."""

import random
from pathlib import Path

import pytest

from quarrystat.sources import quoted_csv, readers, sql_dump


@pytest.fixture(params=[24, 90, 1 << 20])
def small_splits(request, monkeypatch):
    """Files cut every so many bytes, as Spark cuts them: a line belongs to the split that holds its first byte."""

    def cut(spark, path):
        rows = []
        for file in sorted(Path(path).glob("*")) if Path(path).is_dir() else [Path(path)]:
            at = 0
            for line in file.read_bytes().removesuffix(b"\n").split(b"\n"):
                rows.append((line.decode(), str(file), at // request.param * request.param))
                at += len(line) + 1
        return spark.createDataFrame(rows, "value string, file string, start long").coalesce(1)

    monkeypatch.setattr(quoted_csv, "split_lines", cut)
    monkeypatch.setattr(sql_dump, "split_lines", cut)


def test_quoted_line_breaks(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    got = readers.read_any(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["a", "b"] and sorted(tuple(r) for r in got.collect()) == [(1, "x\ny"), (2, "z")]


def test_csv_of_all_kinds(spark, small_splits, tmp_path):
    """Fields with separators, quotes, line breaks, carriage returns, stray quotes; a header with a line break; two files."""
    import csv
    import io

    r = random.Random(5)
    words = ["", "plain", 'say "hi"', "a,b", "line\nbreak", '"', "\n\n", "x\r\ny", "é😀", "5 inch"]
    rows = [(i, r.choice(words), r.choice(words), f"{r.random():.3f}") for i in range(60)]
    for part in range(2):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\r\n" if part else "\n")
        w.writerow(["id", "two\nlines", "c", "c"])
        w.writerows(rows[30 * part : 30 * part + 30])
        (tmp_path / f"part{part}.csv").write_bytes(out.getvalue().encode())
    got = readers.read_any(spark, str(tmp_path), "csv")
    assert got.columns == ["id", "two\nlines", "c", "c_2"] and [t for _, t in got.dtypes] == ["int", "string", "string", "double"]
    assert sorted(tuple(x) for x in got.collect()) == [(i, a or None, b or None, float(x)) for i, a, b, x in rows]


def test_csv_without_breaks_stays_plain(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x ""y"""\n2,5" pipe\n')
    assert not quoted_csv.quoted_breaks(spark, str(tmp_path / "a.csv"))[1]
    assert sorted(tuple(r) for r in readers.read_any(spark, str(tmp_path / "a.csv")).collect()) == [(1, 'x "y"'), (2, '5" pipe')]
    (tmp_path / "b.csv").write_text('a,b\n1,"open\n2,z\n')
    assert quoted_csv.quoted_breaks(spark, str(tmp_path / "b.csv"))[1]


def test_dump_of_four_rows(spark, small_splits, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE t (id INT, name TEXT);\nINSERT INTO t VALUES (1,'a;b'),(2,'it''s\nline2');\nINSERT INTO `t` (id,name) VALUES\n (3,NULL),\n (4,'x, (y)');\n")
    got = readers.read_any(spark, str(tmp_path / "d.sql"))
    assert sorted(tuple(r) for r in got.collect()) == [("1", "a;b"), ("2", "it's\nline2"), ("3", None), ("4", "x, (y)")]


DUMP = """-- a dump; with 'quotes
/* INSERT INTO t VALUES ('no', 1);
   still a comment ( */
CREATE TABLE IF NOT EXISTS "app"."other" (x INT);
CREATE TABLE `app`.`t` (
  `id` INT NOT NULL, -- it's the id
  "values" VARCHAR(20) DEFAULT 'a,b',
  amount DECIMAL(10, 2),
  PRIMARY KEY (`id`), KEY k (amount)
) ENGINE=x;
"""


def test_dump_of_all_kinds(spark, small_splits, tmp_path):
    r = random.Random(9)
    texts = ["", "plain", "it's", "a;b", "(x", "y)", "--", "/*", "*/", "line\nbreak", "VALUES (1)", '"', "`", "é😀", "a,b", "INSERT INTO t VALUES ('z')"]
    out, want = [DUMP], []
    quote = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    for i in range(40):
        n = r.choice([1, 1, 2, 5])
        rows = [(str(100 * i + j), r.choice([*texts, None]), f"{r.random():.2f}") for j in range(n)]
        want += rows
        gap = r.choice([",", ",\n  ", " ,\n"])
        if r.random() < 0.5:
            out.append(f"INSERT INTO t VALUES {gap.join(f'({a},{quote(b)},{c})' for a, b, c in rows)};\n")
        else:
            out.append(f"insert ignore into `app`.\"t\"\n(amount, `values`, id) values\n{gap.join(f'( {c} , {quote(b)},{a})' for a, b, c in rows)}\n;\n")
        if r.random() < 0.3:
            out.append(r.choice(["INSERT INTO other VALUES (1),(2);\n", "-- it's; (\n", "/* ' \n ; */", "SELECT ';(', `x``y` FROM z;", "UPDATE t SET amount = (1);\n"]))
    out.append("INSERT INTO t (id, amount) VALUES (7, (1+2)*3) ON DUPLICATE KEY UPDATE amount=VALUES(amount), id=VALUES(id);\nCOMMIT")
    want.append(("7", None, "(1+2)*3"))
    (tmp_path / "d.sql").write_text("".join(out))
    got = sql_dump.read_sql_dump(spark, str(tmp_path / "d.sql"), "t")
    assert got.columns == ["id", "values", "amount"]
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    other = sql_dump.read_sql_dump(spark, str(tmp_path / "d.sql"))
    assert other.columns == ["x"] and other.count() == sum(x.startswith("INSERT INTO other") for x in out) * 2


def test_dump_with_escapes(spark, small_splits, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE t (a TEXT);\nINSERT INTO t VALUES ('it\\'s; (\\\\'),('x\\ny\\\n');INSERT INTO t VALUES\n('\"');\n")
    got = sql_dump.read_sql_dump(spark, str(tmp_path / "d.sql"), escapes=True)
    assert sorted(r["a"] for r in got.collect()) == sorted(["it's; (\\", "x\ny\n", '"'])


def test_dump_without_create(spark, tmp_path):
    (tmp_path / "d.sql").write_text("INSERT INTO t (b, a) VALUES (1, 2), (3, 4);\nINSERT INTO u (c) VALUES (5);")
    assert sorted(tuple(r) for r in readers.read_any(spark, str(tmp_path / "d.sql")).collect()) == [("1", "2"), ("3", "4")]
    (tmp_path / "e.sql").write_text("INSERT INTO t VALUES (1);")
    with pytest.raises(ValueError):
        readers.read_any(spark, str(tmp_path / "e.sql"))


@pytest.mark.parametrize("text", ["CREATE TABLE t (a INT);\nINSERT INTO t VALUES (1),('open\n", "CREATE TABLE t (a INT, b INT);\nINSERT INTO t VALUES (1);\n"])
def test_dump_that_is_broken_raises(spark, small_splits, tmp_path, text):
    (tmp_path / "d.sql").write_text(text)
    with pytest.raises(Exception):
        readers.read_any(spark, str(tmp_path / "d.sql")).collect()


def test_one_statement_over_many_splits(spark, tmp_path):
    """One INSERT of 200,000 rows: no task reads more than its split."""
    with open(tmp_path / "d.sql", "w") as f:
        f.write("CREATE TABLE t (id INT, s TEXT);\nINSERT INTO t VALUES\n")
        f.write(",\n".join(f"({i},'row ''{i}'';\nnext (line)')" for i in range(200_000)))
        f.write(";\n")
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "200000")
    try:
        path = str(tmp_path / "d.sql")
        assert sql_dump.split_lines(spark, path).select("start").distinct().count() > 30
        got = sql_dump.read_sql_dump(spark, path).selectExpr("count(*) AS n", "count(DISTINCT id) AS d", "sum(CAST(id AS BIGINT)) AS s", "count_if(s = concat('row ''', id, ''';\nnext (line)')) AS same").first()
        assert tuple(got) == (200_000, 200_000, 199_999 * 100_000, 200_000)
    finally:
        spark.conf.set(name, before)
