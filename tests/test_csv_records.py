import csv
import io

import pytest
from hypothesis import given
from hypothesis import strategies as st

from factlane.sources.city_csv import read_city_files
from factlane.sources.csv_records import ends_quoted, traced_lines

CELL = st.text(alphabet='ab,"\n ', max_size=8)


@given(st.lists(st.lists(CELL, min_size=1, max_size=4), min_size=1, max_size=6))
def test_borders_are_those_of_the_csv_module(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    quoted, borders = False, 0
    for line in out.getvalue().encode().split(b"\n")[:-1]:
        quoted = ends_quoted(line, quoted)
        borders += not quoted
    assert not quoted and borders == len(rows)


@pytest.mark.parametrize("line, plain, quoted", [
    (b"a,b", False, True), (b'a"b,c', False, False), (b'"a', True, False), (b'a,"', True, False),
    (b'"a""', True, False), (b'"a"b,"c', True, True), (b'""', False, True), (b"", False, True),
])
def test_state_after_a_line(line, plain, quoted):
    assert (ends_quoted(line, False), ends_quoted(line, True)) == (plain, quoted)


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Lets the exports, and nothing else, be read in ranges of a size."""

    def use(size):
        def read(session, paths):
            names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
            before = {n: session.conf.get(n) for n in names}
            try:
                for name in names:
                    session.conf.set(name, str(size))
                return traced_lines(session, paths)
            finally:
                for name, value in before.items():
                    session.conf.set(name, value)

        monkeypatch.setattr("factlane.sources.city_csv.traced_lines", read)

    return use


def _write(path, rows, encoding, end):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode(encoding))


def test_one_export_in_many_ranges(spark, tmp_path, small_ranges):
    body = [
        [f"景点{i}", "甲\n" * (i % 5) + '"乙",' + "\n丙" * (i % 3), '"' if i % 4 else "", "长" * (i % 7) + ("\n\n行" * 60 if i == 17 else "")]
        for i in range(60)
    ]
    rows = [["名字", "地\n址", "评分", "介绍"], *body]
    for name, encoding, end in (("a.csv", "utf-8-sig", "\n"), ("b.csv", "gbk", "\r\n"), ("c.csv", "utf-8", "\n")):
        _write(tmp_path / name, rows, encoding, end)
    # c has a row with a cell too many, d a cell that never ends, e nothing
    with open(tmp_path / "c.csv", "a") as file:
        file.write("x,y,z,u,v\n")
    (tmp_path / "d.csv").write_text('名字,评分\n一,1\n"二,2\n三,3\n')
    (tmp_path / "e.csv").write_bytes(b"")
    columns = ["名字", "地\n址", "评分", "介绍", "门票"]
    cities = {f"{c}.csv": c for c in "badce"}
    wanted = [(*[v or None for v in row], None, city) for city in "ba" for row in body]
    size = (tmp_path / "a.csv").stat().st_size
    for ranges in (1, 8, 40):
        small_ranges(max(size // ranges, 1) + 1)
        read = read_city_files(spark, str(tmp_path), cities, columns)
        assert [tuple(r)[:-1] for r in read.orderBy("ord").collect()] == wanted, ranges
        assert ranges < 8 or read.select("ord.block").distinct().count() > 5


def test_a_record_too_long(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("factlane.sources.city_csv.MAX_RECORD_BYTES", 50)
    _write(tmp_path / "a.csv", [["名字"], ["甲\n" * 40]], "utf-8", "\n")
    _write(tmp_path / "b.csv", [["名字"], ["甲\n乙"], ["丙"]], "utf-8", "\n")
    read = read_city_files(spark, str(tmp_path), {"a.csv": "a", "b.csv": "b"}, ["名字"])
    assert [r["名字"] for r in read.orderBy("ord").collect()] == ["甲\n乙", "丙"]


def test_a_quote_inside_a_cell_opens_nothing(spark, tmp_path, small_ranges):
    (tmp_path / "a.csv").write_text("名字,评分\n" + "".join(f'5"{i},"{i}\n"\n' for i in range(20)))
    small_ranges(16)
    read = read_city_files(spark, str(tmp_path), {"a.csv": "a"}, ["名字", "评分"])
    assert [(r["名字"], r["评分"]) for r in read.orderBy("ord").collect()] == [(f'5"{i}', f"{i}\n") for i in range(20)]
