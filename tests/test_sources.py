from __future__ import annotations

import json

import pytest

from rowloom.operators.headers import column_letter, column_name, detect_header_rows, promote_headers
from rowloom.sources import detect
from rowloom.sources.detect import detect_formats, head_of
from rowloom.sources.documents import load_documents
from rowloom.sources.sinks import output_path, save_column, save_table
from rowloom.sources.tables import load_table, read_delimited, read_json, read_ragged, with_row_id


def put(folder, name, content):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
    return str(path)


def cells(df):
    return [tuple(r) for r in df.collect()]


def test_delimited_text(spark, tmp_path):
    path = put(tmp_path, "plain.csv", 'a,"x, ""y""",1\nNULL,NA,na\nN/A,n/a,null\nNa,,3,extra\nshort\n')
    assert cells(load_table(spark, path)) == [
        ("a", 'x, "y"', "1", None), (None,) * 4, (None,) * 4, ("Na", None, "3", "extra"), ("short", None, None, None),
    ]
    assert cells(read_delimited(spark, path, columns=3))[3] == ("Na", None, "3")


def test_delimited_types_fit_all_rows(spark, tmp_path):
    rows = "1;0.5;true;x\n2;NA;false;y\n;7;true;3\n"
    df = read_delimited(spark, put(tmp_path, "typed.txt", rows), ";", infer=True)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string"]
    late = read_delimited(spark, put(tmp_path, "late.txt", rows * 60 + "four;z;maybe;\n"), ";", infer=True)
    assert [t for _, t in late.dtypes] == ["string"] * 4
    assert cells(late)[-1] == ("four", "z", "maybe", None)


def test_width_is_that_of_the_widest_line(spark, tmp_path):
    assert cells(load_table(spark, put(tmp_path, "title.csv", 'title\n1,"2,2",3\n4,5,6\n'))) == [
        ("title", None, None), ("1", "2,2", "3"), ("4", "5", "6"),
    ]
    wide = put(tmp_path, "wide.csv", "a,b\n1,2,3\n".encode("utf-16"))
    assert len(load_table(spark, wide).columns) == 3


def test_json_lines_are_told_from_arrays(spark, tmp_path):
    path = save_table(spark.range(100).repartition(3), str(tmp_path / "lines.json"))
    assert load_table(spark, path).count() == 100
    assert load_table(spark, put(tmp_path, "array.json", '[{"a": 1},\n {"a": 2}]')).count() == 2
    assert load_table(spark, put(tmp_path, "pretty.json", '{\n "a": 1\n}')).count() == 1


@pytest.mark.parametrize("whole", [32 << 20, 0])
def test_formats_are_found_for_each_file(spark, tmp_path, monkeypatch, whole):
    monkeypatch.setattr(detect, "WHOLE_BYTES", whole)
    monkeypatch.setattr(detect, "HEAD_BYTES", 1 << 10)
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("é,1\n".encode())
    (folder / "b [x].csv").write_bytes("ü;2;3\n".encode("latin-1"))
    (folder / "c.csv").write_bytes("ö\t4\n".encode("utf-16"))
    (folder / "d.csv").write_bytes(b"x,5\n" * 1000 + "ß,6\n".encode("latin-1"))
    (folder / "e.csv").write_bytes(b"")
    rows = set(cells(load_table(spark, str(folder))))
    assert rows == {("é", "1", None), ("ü", "2", "3"), ("ö", "4", None), ("x", "5", None), ("ß", "6", None)}
    assert load_table(spark, str(folder), infer=True).schema["_c1"].dataType.simpleString() == "bigint"
    folder = tmp_path / "mixed.json"
    folder.mkdir()
    (folder / "a.json").write_text('{"a": 1, "b": {"x": 1}}\n{"a": 2}\n')
    (folder / "b.json").write_text('[{"a": "t", "b": {"y": "é"}},\n {"a": "u"}]', encoding="latin-1")
    got = {(r["a"], r["b"] and r["b"].x, r["b"] and r["b"].y) for r in load_table(spark, str(folder)).collect()}
    assert got == {("1", 1, None), ("2", None, None), ("t", None, "é"), ("u", None, None)}


def test_two_megabytes_in_one_quoted_cell(spark, tmp_path):
    long = 'x""' * 700_000
    path = put(tmp_path, "long.csv", f'a,"{long}",1\nb,"{"y" * 2_000}",2\n')
    got = cells(load_table(spark, path))
    assert got == [("a", 'x"' * 700_000, "1"), ("b", "y" * 2_000, "2")]


def test_files_are_read_by_what_their_quotes_say(spark, tmp_path):
    """A plain file, one with quoted line ends, one whose quote is never closed, one with quotes inside of cells: no cell is lost."""
    folder = tmp_path / "mixed.csv"
    folder.mkdir()
    put(folder, "a.csv", "1,plain\n2,two,more\n")
    put(folder, "b.csv", '3,"line\nend, and ""quotes"""\n4,x\n')
    put(folder, "c.csv", '5,"never closed\n6,y\n')
    put(folder, "d.csv", '7,a 5" pipe\n8,and 7" more\n')
    got = sorted(cells(load_table(spark, str(folder), row_id=True)))
    assert got == [
        (0, "1", "plain", None), (1, "2", "two", "more"), (2, "3", 'line\nend, and "quotes"', None), (3, "4", "x", None),
        (4, "5", '"never closed', None), (5, "6", "y", None), (6, "7", 'a 5" pipe', None), (7, "8", 'and 7" more', None),
    ]
    one = load_table(spark, str(folder / "c.csv"))
    assert one.columns == ["column_0", "column_1"] and cells(one) == [("5", '"never closed'), ("6", "y")]


def test_what_was_saved_comes_back(spark, tmp_path):
    rows = [(i, f'x{i}\n"{i}", z' if i % 3 else None, "" if i % 2 else "NA?") for i in range(100)]
    df = spark.createDataFrame(rows, "`a,b` int, b string, c string").repartition(3, "a,b")
    path = save_table(df, str(tmp_path / "saved.csv"))
    back = load_table(spark, path, row_id=True)
    got = [tuple(r)[1:] for r in back.orderBy("row_id").collect()]
    assert got[0] == ("a,b", "b", "c") and len(got) == 101
    assert {g[0]: g for g in got[1:]} == {str(a): (str(a), b, c or None) for a, b, c in rows}
    promoted = promote_headers(back)
    assert promoted.count() == 100 and promoted.columns[1] == "[A] a,b"


def test_rows_are_numbered_in_the_order_of_the_files(spark, tmp_path, monkeypatch):
    folder = tmp_path / "order.csv"
    folder.mkdir()
    put(folder, "a.csv", "key,value\n")
    put(folder, "b.csv", "".join(f"{i},row{i}\n" for i in range(30_000)))
    put(folder, "c.csv", "last,one\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = load_table(spark, str(folder), row_id=True).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["row_id"] for r in got] == list(range(30_002))
    assert tuple(got[0])[1:] == ("key", "value") and tuple(got[-1])[1:] == ("last", "one")
    assert [r["_c0"] for r in got[1:-1]] == [str(i) for i in range(30_000)]


def test_windows_1252_is_told_from_latin(spark, tmp_path):
    text = "“größe”;€ 5 – é\n1;2\n"
    path = put(tmp_path, "west.csv", text.encode("cp1252"))
    assert cells(load_table(spark, path)) == [("“größe”", "€ 5 – é"), ("1", "2")]


def test_jobs_do_not_grow_with_the_number_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(detect, "WHOLE_BYTES", 0)

    def jobs(n):
        folder = tmp_path / f"many{n}.csv"
        folder.mkdir()
        for i in range(n):
            put(folder, f"f{i}.csv", f"é{i};x\n".encode("latin-1") if i % 2 else f"é{i},x\n")
        group = f"jobs-{n}"
        spark.sparkContext.setJobGroup(group, group)
        assert load_table(spark, str(folder)).count() == n
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("rest", "rest")
        return found

    few = jobs(4)
    assert jobs(200) <= few + 4


def test_the_head_of_a_file_is_bounded(spark, tmp_path):
    path = put(tmp_path, "one.json", "[" + '{"a": 1}, ' * 400_000 + '{"a": 2}]')
    assert len(head_of(spark, path).first()["content"]) <= 1 << 20


def test_a_late_byte_decides_the_encoding(spark):
    rows = spark.createDataFrame([("f", bytearray(b"x" * 200_000 + b"\xe9"))], "path string, content binary")
    assert detect_formats(rows).first()["encoding"] == "iso-8859-1"


def test_encodings(spark, tmp_path):
    text = "größe;é\n1;2\n"
    for name, data, encoding in [
        ("a.csv", text.encode("utf-8"), "utf-8"), ("b.csv", text.encode("latin-1"), "iso-8859-1"),
        ("c.csv", text.encode("utf-16"), "utf-16"), ("d.csv", b"", None),
    ]:
        path = put(tmp_path, name, data)
        if encoding is None:
            with pytest.raises(FileNotFoundError):
                head_of(spark, path)
            continue
        found = detect_formats(head_of(spark, path)).first()
        assert (found["encoding"], found["delimiter"]) == (encoding, ";"), name
        assert cells(load_table(spark, path)) == [("größe", "é"), ("1", "2")], name


def test_a_sample_may_end_inside_a_character(spark, tmp_path):
    for shift in range(4):
        path = put(tmp_path, f"long{shift}.csv", ("x" * shift + "😀" * 30_000 + "\n") * 2)
        assert detect_formats(head_of(spark, path)).first()["encoding"] == "utf-8"


@pytest.mark.parametrize("text,delimiter", [
    ("a,b;c\n", ","), ("a;b\n", ";"), ("plain\n", ","), ("a\tb\tc,d", "\t"), ("a|b\n" * 3 + "c,d\n", "|"),
    ("x\n" * 5 + "a;b;c\n", ","), ("a;b\rc;d\r" + "x\r" * 3 + ",,,,,,", ";"),
])
def test_delimiters(spark, tmp_path, text, delimiter):
    rows = spark.createDataFrame([("f", bytearray(text.encode()))], "path string, content binary")
    assert detect_formats(rows).first()["delimiter"] == delimiter


def test_ragged_text(spark, tmp_path):
    path = put(tmp_path, "ragged.txt", 'a;"b;c\n\n \t\n;x\nlast\n1;2;3;4;\n')
    assert cells(read_ragged(spark, path, ";")) == [
        ("a", '"b', "c", "", ""), ("", "x", "", "", ""), ("last", "", "", "", ""), ("1", "2", "3", "4", ""),
    ]
    latin = put(tmp_path, "latin.txt", "é|ü".encode("latin-1"))
    assert cells(read_ragged(spark, latin, "|", "iso-8859-1")) == [("é", "ü")]


def test_json(spark, tmp_path):
    records = [{"a": 1, "b": "x"}, {"a": None, "b": "é\n"}]
    array = put(tmp_path, "array.json", json.dumps(records, indent=1))
    assert cells(load_table(spark, array)) == [(1, "x"), (None, "é\n")]
    latin = put(tmp_path, "latin.json", '[{"a": "caf\xe9"}]'.encode("latin-1"))
    assert cells(load_table(spark, latin)) == [("café",)]
    wide = put(tmp_path, "wide.json", '[{"a": "café"}]'.encode("utf-16"))
    assert cells(load_table(spark, wide)) == [("café",)]
    lines = put(tmp_path, "lines.json", "\n".join(json.dumps(r) for r in records))
    assert cells(read_json(spark, lines, lines=True)) == [(1, "x"), (None, "é\n")]


def test_documents(spark, tmp_path):
    put(tmp_path, "a.txt", "  héllo\r\nworld \n")
    put(tmp_path, "b.MD", "caf\xe9".encode("latin-1"))
    put(tmp_path, "c.pdf", b"%PDF")
    put(tmp_path, "copy.txt", "  héllo\r\nworld \n")
    found = {r["doc_name"]: r for r in load_documents(spark, str(tmp_path)).collect()}
    assert {n: r["text"] for n, r in found.items()} == {
        "a.txt": "héllo\nworld", "b.MD": "café", "c.pdf": None, "copy.txt": "héllo\nworld",
    }
    assert found["a.txt"]["content_hash"] == found["copy.txt"]["content_hash"] != found["b.MD"]["content_hash"]


def test_sinks_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd', None), (2, "", "é")], "k long, t string, n string")
    path = save_table(df, str(tmp_path / "t.csv"))
    back = spark.read.options(header="true", multiLine="true", escape='"').csv(path)
    assert sorted(cells(back)) == [("1", 'a "b", c\nd', None), ("2", None, "é")]
    assert sorted(cells(load_table(spark, save_table(df, str(tmp_path / "t.parquet")))), key=str) == cells(df)
    assert sorted(cells(read_json(spark, save_table(df, str(tmp_path / "t.json")), lines=True).select("k", "t", "n"))) == cells(df)
    assert save_table(df, str(tmp_path / "t.xyz")).endswith(".xyz.csv")
    save_column(df.coalesce(1), "n", str(tmp_path / "col"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "col")).collect()] == ["", "---", "é", "---"]


def test_output_path():
    assert output_path("/a/t.csv", "out.json") == "out.json"
    assert output_path("/a/t.v1.xlsx", "out.txt") == "/a/t.v1_mutated.xlsx"
    assert output_path("/a/t.csv") == "/a/t_mutated.csv"


def headed(spark, rows):
    width = len(rows[0])
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "row_id long, " + ", ".join(f"c{i} string" for i in range(width))
    )


@pytest.mark.parametrize("rows,want", [
    ([["a", "b"], ["x", "y"], ["1", "2"]], (1, 0.5)),
    ([["a", "b"]] + [["1", "x"]] * 5, (1, 0.8)),
    ([["a", "b"], ["c", ""]] + [["1", "2"]] * 4, (2, 0.7)),
    ([["a", "b"], ["-1.5", "x"]] + [["1", "2"]] * 4, (1, 0.8)),
    ([["a", "b"], [None, ""]] + [["1", "2"]] * 4, (2, 0.7)),
    ([["a"] * 6, ["x"] * 5 + ["7"]] + [["1"] * 6] * 4, (2, 0.7)),
])
def test_header_detection(spark, rows, want):
    assert tuple(detect_header_rows(headed(spark, rows)).first()) == want


def test_header_promotion(spark):
    df = headed(spark, [["Name", "", None], ["first", "", "x"], ["1", "2", "3"], ["4", None, "6"]])
    out = promote_headers(df, 2)
    assert out.columns == ["row_id", "[A] Name - first", "[B] Column 2", "[C] x"]
    assert cells(out.orderBy("row_id")) == [(2, "1", "2", "3"), (3, "4", None, "6")]
    assert [t for _, t in promote_headers(df, 2, infer=True).dtypes] == ["bigint"] * 4
    assert promote_headers(df, 9).count() == 0
    assert promote_headers(df, 0).columns == df.columns


def test_column_letters():
    assert [column_letter(i) for i in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]
    assert column_name(1, ["", ""]) == "[B] Column 2"


def test_row_ids_follow_the_file(spark, tmp_path):
    path = put(tmp_path, "t.csv", "".join(f"{i},x\n" for i in range(500)))
    df = with_row_id(load_table(spark, path))
    assert [r["_c0"] for r in df.orderBy("row_id").collect()] == [str(i) for i in range(500)]


def test_round_trip_parts_grow_with_the_table(spark, tmp_path, monkeypatch):
    """Parts whose cells hold line ends are read whole, so their number follows the size of the text."""
    from registry import tables

    rows = [(i, f'a "quoted" word,\nline {i}\n' * 4 + "end", "en", "web", 5) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    paths, own = [], tables.save_table
    monkeypatch.setattr(tables, "_PART_BYTES", 400)
    monkeypatch.setattr(tables, "save_table", lambda *args: paths.append(own(*args)) or paths[-1])
    got = tables.csv_round_trip(spark, str(tmp_path)).collect()
    assert sum(r["is_header"] for r in got) == 1
    assert sorted((r["doc_id"], r["text"]) for r in got if not r["is_header"]) == sorted((str(r[0]), r[1].strip()) for r in rows)
    assert len(spark.read.text(paths[0]).inputFiles()) > 6
