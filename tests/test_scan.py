"""Statement source: boundaries, directives, splits, line ends, encodings."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators.values import good_rows, rejected_rows, typed_rows
from sluice.plans.migrate import as_struct
from sluice.sources.auto import read_any
from sluice.sources.dumps import read_statements, with_positions
from sluice.sources.encoding import file_charsets, file_separators, read_unsplittable
from sluice.sources.dumps import assemble, scan, to_statements
from tests.conftest import write

SCHEMA = "id int, s string"


def ordered(df):
    return [r.stmt for r in df.orderBy("file_path", "block_start", "ord", "sub").collect()]


def test_directives_comments_and_missing_end(spark, folder):
    path = write(folder, "a.sql", "-- it's a comment\nPROMPT x\n\nSET DEFINE OFF\nINSERT INTO t VALUES (1,\n 'a');\n"
                 "COMMIT;\n/* two\nlines; */\nINSERT INTO t -- why\nVALUES (2, 'b -- no comment /* c */'); \nINSERT INTO t VALUES (3, 'c')")
    got = ordered(read_statements(spark, path))
    assert [g for g in got if g.startswith("INSERT")] == [
        "INSERT INTO t VALUES (1,\n 'a');", "INSERT INTO t  \nVALUES (2, 'b -- no comment /* c */');",
        "INSERT INTO t VALUES (3, 'c');"]


def test_literals_keep_everything(spark, folder):
    hard = ["a;\nb", "it's", "x', 'y", "(1, 2)", "-- no", "SET x\nPROMPT y", "INSERT INTO q VALUES (9);\n", "", "NULL",
            "a  b\t c", ";\n;\n;\n", "中文，。", "\"", "--';\n"]
    text = "".join(f"INSERT INTO t (id, s) VALUES ({i}, '{h.replace(chr(39), chr(39) * 2)}');\n" for i, h in enumerate(hard))
    rows = good_rows(typed_rows(read_statements(spark, write(folder, "a.sql", text)), as_struct(SCHEMA)))
    assert {r.id: r.s for r in rows.collect()} == dict(enumerate(hard))


def test_split_size_does_not_matter(spark, folder):
    rng = random.Random(7)
    parts = ["x", ";\n", "''", "(", ",", "-- a", "\n", "SET y", '"']
    text, want = "-- don't stop\n", {}
    for i in range(3000):
        body = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) + "z" * rng.randint(0, 30)
        want[i] = body.replace("''", "'")
        text += f"INSERT INTO t VALUES ({i}, '{body}');\n" + ("-- it's\n" if i % 97 == 0 else "")
    path = write(folder, "a.sql", text)
    for size in (1 << 30, 20_000, 3_000):
        stmts = read_statements(spark, path, chunk_bytes=size)
        rows = good_rows(typed_rows(stmts, as_struct(SCHEMA)))
        assert {r.id: r.s for r in rows.collect()} == want
        placed = with_positions(stmts).select("pos", "stmt").orderBy("pos").collect()
        assert [p.pos for p in placed] == list(range(1, len(want) + 1))
        assert placed[41].stmt.startswith("INSERT INTO t VALUES (41,")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="a';,()\n\"-/*x中 ", max_size=14), min_size=1, max_size=25))
def test_any_literal_survives(spark, tmp_path_factory, texts):
    dump = "".join(f"INSERT INTO t VALUES ({i}, '{x.replace(chr(39), chr(39) * 2)}');\n" for i, x in enumerate(texts))
    path = write(str(tmp_path_factory.mktemp("h")), "a.sql", dump)
    rows = good_rows(typed_rows(read_statements(spark, path, chunk_bytes=64), as_struct(SCHEMA)))
    assert {r.id: r.s for r in rows.collect()} == dict(enumerate(texts))


def test_unbalanced_file_keeps_what_can_be_read(spark, folder):
    path = write(folder, "a.sql", "INSERT INTO t VALUES (1, 'a');\nINSERT INTO t VALUES (2, 'open);\nINSERT INTO t VALUES (3, 'c');\n")
    typed = typed_rows(read_statements(spark, path), as_struct(SCHEMA))
    assert sorted(r.id for r in good_rows(typed).collect()) == [1, 3]
    assert [r.reason for r in rejected_rows(typed).collect()] == ["unparsed_values"]


def test_crlf_and_separators(spark, folder):
    crlf = write(folder, "crlf.sql", "-- c\r\nINSERT INTO t VALUES (1, 'a');\r\nINSERT INTO t VALUES (2,\r\n 'b');\r\n")
    write(folder, "lf.sql", "INSERT INTO t VALUES (3, 'c');\nINSERT INTO t VALUES (4, 'd');\n")
    ends = {r.file_path.rsplit("/", 1)[-1]: r.separator for r in file_separators(spark, folder).collect()}
    assert ends == {"crlf.sql": ";\r\n", "lf.sql": ";\n"}
    rows = good_rows(typed_rows(read_statements(spark, crlf, ";\r\n"), as_struct(SCHEMA)))
    assert sorted((r.id, r.s) for r in rows.collect()) == [(1, "a"), (2, "b")]
    # read with the plain separator the records hold several statements and are split inside
    rows = good_rows(typed_rows(read_statements(spark, crlf), as_struct(SCHEMA)))
    assert sorted((r.id, r.s) for r in rows.collect()) == [(1, "a"), (2, "b")]


def test_charsets_of_files(spark, folder):
    text = "INSERT INTO t VALUES (1, '中文测试数据');\nINSERT INTO t VALUES (2, '你好世界');\n"
    for name in ("utf-8", "gbk", "utf-16"):
        write(folder, f"{name}.sql", text.encode(name))
    write(folder, "bom.sql", b"\xef\xbb\xbf" + text.encode())
    got = {r.file_path.rsplit("/", 1)[-1]: r.encoding for r in file_charsets(spark, folder).collect()}
    assert got == {"utf-8.sql": "utf-8", "gbk.sql": "gbk", "utf-16.sql": "utf-16", "bom.sql": "utf-8"}
    want = [(1, "中文测试数据"), (2, "你好世界")]
    gbk = read_statements(spark, f"{folder}/gbk.sql", encoding="gbk")
    wide = to_statements(assemble(scan(read_unsplittable(spark, f"{folder}/utf-16.sql"))))
    marked = read_statements(spark, f"{folder}/bom.sql")
    for stmts in (gbk, wide, marked):
        assert sorted((r.id, r.s) for r in good_rows(typed_rows(stmts, as_struct(SCHEMA))).collect()) == want


def test_mixed_folder(spark, folder):
    write(folder, "a.sql", "INSERT INTO t VALUES (1, '中文测试数据');\r\nINSERT INTO t VALUES (2, 'b');\r\n".encode("gbk"))
    write(folder, "b.sql", "INSERT INTO t VALUES (3, '你好;\n世界');\nINSERT INTO t VALUES (4, 'd');\n")
    write(folder, "c.sql", "INSERT INTO t VALUES (5, '你好');\nINSERT INTO t VALUES (6, 'f');\n".encode("utf-16"))
    rows = good_rows(typed_rows(read_any(spark, folder), as_struct(SCHEMA)))
    assert {r.id: r.s for r in rows.collect()} == {1: "中文测试数据", 2: "b", 3: "你好;\n世界", 4: "d", 5: "你好", 6: "f"}


def test_empty_and_comment_only_files(spark, folder):
    write(folder, "empty.sql", "")
    write(folder, "comment.sql", "-- it's nothing\nPROMPT done\n")
    assert ordered(read_statements(spark, folder).filter(F.col("stmt").rlike("INSERT"))) == []


def test_wide_charsets_are_split(spark, folder):
    text = "".join(f"INSERT INTO t VALUES ({i}, '中文;\n测试{i}Ċ;');\n" for i in range(60))
    for name, mark in (("utf-16-le", b"\xff\xfe"), ("utf-16-be", b"\xfe\xff"), ("utf-32-le", b"\xff\xfe\0\0"), ("utf-32-be", b"\0\0\xfe\xff")):
        write(folder, f"{name}.sql", mark + text.encode(name))
    want = sorted([(i, f"中文;\n测试{i}Ċ;") for i in range(60)] * 4)
    for size in (997, 4000):
        stmts = read_any(spark, folder, chunk_bytes=size)
        assert stmts.select("file_path", "block_start").distinct().count() > 20000 // size
        assert sorted((r.id, r.s) for r in good_rows(typed_rows(stmts, as_struct(SCHEMA))).collect()) == want


def test_separators_across_code_units(spark, folder):
    """U+4100 U+3B00 U+0A41 hold the bytes of a separator; such a file is read whole."""
    odd = "INSERT INTO t VALUES (1, 'a䄀㬀ੁ');\nINSERT INTO t VALUES (2, 'b');\n"
    assert ";\n".encode("utf-16-be") in odd.split(");")[0].encode("utf-16-be")
    write(folder, "odd.sql", b"\xfe\xff" + odd.encode("utf-16-be"))
    rows = good_rows(typed_rows(read_any(spark, folder), as_struct(SCHEMA))).collect()
    assert sorted((r.id, r.s) for r in rows) == [(1, "a䄀㬀ੁ"), (2, "b")]


def test_lexer_states(spark, folder):
    """Directives, comments and quotes of all kinds with separators in them, whatever the splits are."""
    pieces = ["PROMPT it's\n", "REM don't;\n", "-- it's;\n", "/* it's;\n'' */\n", "SET x it's;\n", ""]
    values = ["'a;\nb'", "q'[it's;\nx]'", "'it''s' /* ';\n */", "Q'!;\n'!'", "'x' -- ';\n", "N'y'"]
    want, text = {}, ""
    told = ["a;\nb", "it's;\nx", "it's", ";\n'", "x", "y"]
    for i in range(300):
        text += pieces[i % 6] + f"INSERT INTO t VALUES ({i}, {values[(i // 6) % 6]});\n"
        want[i] = told[(i // 6) % 6]
    path = write(folder, "a.sql", text)
    for size in (1 << 20, 900):
        stmts = read_statements(spark, path, chunk_bytes=size)
        assert stmts.agg(F.max(F.length("stmt"))).first()[0] < 100
        typed = typed_rows(stmts, as_struct(SCHEMA))
        assert rejected_rows(typed).count() == 0
        assert {r.id: r.s for r in good_rows(typed).collect()} == want


def test_bytes_that_do_not_fit_are_rejects(spark, folder):
    good, bad = "INSERT INTO t VALUES (1, '中');\n".encode("gbk"), b"INSERT INTO t VALUES (2, 'x\xff\xffy');\n"
    for encoding, data in (("gbk", good + bad), ("utf-8", "INSERT INTO t VALUES (1, '中');\n".encode() + bad)):
        path = write(folder, f"{encoding}.sql", data)
        typed = typed_rows(read_statements(spark, path, encoding=encoding), as_struct(SCHEMA))
        assert [(r.id, r.s) for r in good_rows(typed).collect()] == [(1, "中")]
        assert [r.reason for r in rejected_rows(typed).collect()] == ["bad_bytes"]
