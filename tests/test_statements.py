"""Cases written from the rules: tokens, obfuscation, normalization, metadata."""

import glob
import io
import json
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from inkstone import cli
from inkstone.functions import Dialect, NormalizerConfig, ObfuscatorConfig, obfuscate, obfuscate_and_normalize, tokenize
from inkstone.functions.tokens import FIELDS
from inkstone.functions.views import create_statement_view
from inkstone.operators.statements import fingerprint_counts, token_rows
from inkstone.plans import queries
from inkstone.sources.statements import read_statements, write_results
from inkstone.streaming.statements import normalized_stream, windowed_fingerprints


def all_of(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    return [r.x for r in df.select("i", column(F.col("sql")).alias("x")).orderBy("i").collect()]


TOKENS = [
    ("", "SELECT/**/1", "COMMAND:SELECT MULTILINE_COMMENT:/**/ NUMBER:1"),
    ("", "FROM=1", "IDENT:FROM OPERATOR:= NUMBER:1"),
    ("", "id=-1", "IDENT:id OPERATOR:=- NUMBER:1"),
    ("", "019", "NUMBER:01 NUMBER:9"),
    ("", "-0x1F", "NUMBER:-0 IDENT:x1F"),
    ("", "0x1F", "NUMBER:0x1F"),
    ("", "'a''b'", "STRING:'a' STRING:'b'"),
    ("", r"'a\'b'", r"STRING:'a\'b'"),
    ("oracle", r"'a\'b'", r"STRING:'a\' IDENT:b INCOMPLETE_STRING:'"),
    ("", "'open", "INCOMPLETE_STRING:'open"),
    ("", "/*open", "ERROR:/*open"),
    ("", "count(*)", "FUNCTION:count PUNCTUATION:( WILDCARD:* PUNCTUATION:)"),
    ("", "NULL::text", "NULL:NULL OPERATOR::: IDENT:text"),  # a colon is an operator where it begins a run
    ("", "a->>'k'", "IDENT:a JSON_OP:->> STRING:'k'"),
    ("", "=?", "OPERATOR:= OPERATOR:?"),
    ("", "$1$x$y$x$", "POSITIONAL_PARAMETER:$1 DOLLAR_QUOTED_STRING:$x$y$x$"),
    ("", "$func$b$func$", "DOLLAR_QUOTED_FUNCTION:$func$b$func$"),
    ("", '"a"."b"', 'QUOTED_IDENT:"a"."b"'),
    ("mysql", '"a"`b`#c', 'STRING:"a" QUOTED_IDENT:`b` COMMENT:#c'),
    ("mssql", "[a].b", "QUOTED_IDENT:[a] PUNCTUATION:. IDENT:b"),
    ("snowflake", "@s/x", "IDENT:@s/x"),
    ("", "@@v", "SYSTEM_VARIABLE:@@v"),
    ("", "été(", "IDENT:été PUNCTUATION:("),
    ("", "PROCEDURE WITH AS TRUE", "PROC_INDICATOR:PROCEDURE CTE_INDICATOR:WITH ALIAS_INDICATOR:AS BOOLEAN:TRUE"),
]


@pytest.mark.parametrize("dialect", sorted({d for d, _, _ in TOKENS}))
def test_tokens(spark, dialect):
    cases = [(s, w) for d, s, w in TOKENS if d == dialect]
    got = all_of(spark, [s for s, _ in cases], lambda c: tokenize(c, dialect))
    shown = [" ".join(f"{t.type}:{t.value}" for t in ts if t.type != "SPACE") for ts in got]
    assert shown == [w for _, w in cases]


def test_any_text_survives(spark):
    texts = ["", "x" * 100_000, "/*" + " " * 100_000 + "*/ SELECT 1", "'" * 999, '"', " é🙂`~\\", "$a$ $b$", None, "a\0b"]
    got = all_of(spark, texts, tokenize)
    assert [None if t is None else "".join(x.value for x in t) for t in got] == [*texts[:-1], "a"]


def test_obfuscation(spark):
    every = ObfuscatorConfig(replace_digits=True, replace_positional_parameter=True, replace_boolean=True, replace_null=True, replace_bind_parameter=True)
    texts = ["SELECT 'x', 1.5, $1, @p, true, NULL FROM users12a -- 9", "  SELECT 1 ", "SELECT extract(EPOCH from t), extract(foo from t)", "/* 'x' ", None]
    assert all_of(spark, texts, lambda c: obfuscate(c, every)) == ["SELECT ?, ?, ?, ?, ?, ? FROM users?a -- 9", "SELECT ?", "SELECT extract(? from t), extract(foo from t)", "/* 'x'", None]
    assert all_of(spark, ["a -> 'k' = 'v'", "$func$SELECT 1$func$"], lambda c: obfuscate(c, ObfuscatorConfig(keep_json_path=True, dollar_quoted_func=True))) == ["a -> 'k' = ?", "$func$SELECT ?$func$"]


NORMAL = [
    ("SELECT  a AS b,c FROM t AS x -- end", "SELECT a, c FROM t"),
    ("SELECT * FROM t WHERE id IN (1, 2,3)", "SELECT * FROM t WHERE id IN ( ? )"),
    ("(@p1 bigint)SELECT @p1", "SELECT @p1"),
    ("(SELECT 1) UNION (SELECT 2);", "( SELECT ? ) UNION ( SELECT ? )"),
    ('SELECT "a b", "c" FROM "d"', 'SELECT "a b", c FROM d'),
    ("SELECT CAST(x AS int), CAST(y AS varchar(10))", "SELECT CAST ( x ), CAST ( y AS varchar ( ? ) )"),
    ("SELECT f(1, a, 2)", "SELECT f ( ?, a, )"),
    ("(SELECT f(1, a))", ",( SELECT f ( ? a ) )"),
    ("(", "("),
    ("", ""),
    (None, None),
]


def test_normalization(spark):
    got = all_of(spark, [s for s, _ in NORMAL], lambda c: obfuscate_and_normalize(c)["sql"])
    assert got == [w for _, w in NORMAL]
    again = all_of(spark, [w for _, w in NORMAL[:7]], lambda c: obfuscate_and_normalize(c)["sql"])
    assert again[:5] == [w for _, w in NORMAL[:5]]


def test_metadata(spark):
    every = NormalizerConfig(collect_tables=True, collect_commands=True, collect_comments=True, collect_procedures=True)
    texts = ["WITH c AS (SELECT 1), d AS (SELECT 2) SELECT * FROM c, d, [x] JOIN y1 /* é */", "CREATE PROCEDURE p AS UPDATE t SET a = 1", "TRUNCATE t"]
    got = all_of(spark, texts, lambda c: obfuscate_and_normalize(c, ObfuscatorConfig(replace_digits=True), every, "mssql")["metadata"])
    assert (got[0].tables, got[0].commands, got[0].comments, got[0].procedures) == (["d", "x", "y?"], ["SELECT", "JOIN"], ["/* é */"], [])
    assert got[0].size == len("dxy?SELECTJOIN") + len("/* é */".encode())
    assert (got[1].tables, got[1].procedures) == (["t"], ["p"]) and got[2].tables == []


def test_many_parameters(spark):
    text = "SELECT * FROM t WHERE id IN (" + ", ".join(f"${i}" for i in range(1, 15_001)) + ")"
    assert all_of(spark, [text], lambda c: obfuscate_and_normalize(c, ObfuscatorConfig(replace_positional_parameter=True))["sql"]) == ["SELECT * FROM t WHERE id IN ( ? )"]


def test_plans_stay_in_the_jvm(spark):
    exchanges = lambda df, **how: fingerprint_counts(df, **how)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    distinct = spark.range(500).select(F.concat(F.lit("SELECT "), "id").alias("sql"))
    repetitive = distinct.select(F.concat(F.lit("SELECT "), F.length("sql")).alias("sql"))
    assert "Python" not in fingerprint_counts(distinct)._jdf.queryExecution().executedPlan().toString()
    # one shuffle for equal fingerprints, and one for equal texts if the first rows tell that there are any to speak of
    assert (exchanges(distinct), exchanges(repetitive)) == (1, 2)
    assert (exchanges(distinct, repeats=True), exchanges(repetitive, repeats=False)) == (2, 1)
    for df in (distinct, repetitive):
        assert {tuple(r) for r in fingerprint_counts(df).collect()} == {("SELECT ?", 500)}
    # a text is cut once: no filter that Spark infers cuts it another time
    rows = token_rows(distinct).groupBy("type").count()._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count("array_remove") == 1


def test_sources_cli_and_views(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.sql").write_text("SELECT 1\r\nFROM t7;\n")
    assert [r.sql for r in read_statements(spark, str(tmp_path / "a.sql")).collect()] == ["SELECT 1\nFROM t7;"]
    assert read_statements(spark, str(tmp_path / "a.sql"), "lines").count() == 2
    write_results(read_statements(spark, str(tmp_path / "a.sql")), str(tmp_path / "p"))
    assert read_statements(spark, str(tmp_path / "p"), "parquet").count() == 1
    cli.main(["-input", str(tmp_path / "a.sql"), "-with-metadata"])
    shown = json.loads(capsys.readouterr().out)
    assert shown["sql"] == "SELECT ? FROM t?" and shown["metadata"]["tables"] == ["t?"]
    cli.main(["-input", str(tmp_path / "a.sql"), "-mode", "tokenize"])
    assert capsys.readouterr().out.split() == ["SELECT", "1", "FROM", "t7", ";"]
    cli.main(["-input", str(tmp_path / "a.sql"), "-mode", "obfuscate", "-output", f"{tmp_path / 'o'}/", "--no-replace-digits"])
    assert [r.value for r in spark.read.text(str(tmp_path / "o"), wholetext=True).collect()][0].strip().endswith("t7;")
    for _ in range(2):  # the second time it is replaced
        cli.main(["-input", str(tmp_path / "a.sql"), "-mode", "obfuscate", "-output", str(tmp_path / "o.sql"), "--no-replace-digits"])
    assert (tmp_path / "o.sql").read_text() == "SELECT ?\nFROM t7;\n" and not list(tmp_path.glob("o.sql.*"))
    cli.main(["-input", str(tmp_path / "a.sql"), "-mode", "obfuscate", "-replace-digits=false", "-replace-null"])
    assert capsys.readouterr().out.strip().endswith("t7;")
    monkeypatch.setattr(sys, "stdin", io.StringIO("SELECT 1\r\nFROM t\r\n"))
    cli.main(["-mode=normalize", "-uppercase-keywords=1"])
    assert capsys.readouterr().out == "SELECT 1 FROM t\n"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["-replace-null=maybe"])
    create_statement_view(spark.createDataFrame([("SELECT 5",)], "sql string"), "statements")
    assert spark.sql("SELECT normalized_sql FROM statements").first()[0] == "SELECT ?"


def test_streams(spark, tmp_path):
    rows = [("2026-01-01 00:00:01", "SELECT 1"), ("2026-01-01 00:00:02", "SELECT 2"), ("2026-01-01 00:07:00", "SELECT 3")]
    spark.createDataFrame(rows, "ts string, sql string").select(F.col("ts").cast("timestamp").alias("ts"), "sql").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, sql string").parquet(str(tmp_path / "in"))
    for name, out, mode in (("plain", normalized_stream(stream), "append"), ("counts", windowed_fingerprints(stream, "ts"), "complete")):
        query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert {r.normalized_sql for r in spark.table("plain").collect()} == {"SELECT ?"}
    assert sorted(r.statements for r in spark.table("counts").collect()) == [1, 2]


REGISTERED = ["fingerprints_distinct", "metadata_distinct", "dialects_by_row", "configs_by_row", "sql_functions", "cli_modes", "cli_one_file", "tokenize_counts", "normalize_in_list", "dialects", "dialect_tokens", "tokens_numbers", "tokens_open_and_quoted", "tokens_signs", "tokens_names", "obfuscate_unchanged", "obfuscate_token", "normalize_names_mssql", "normalize_statements", "cli_over_files", "view_columns", "stream_fingerprints", "fingerprints", "metadata_tables"]


@pytest.mark.parametrize("name", REGISTERED)
def test_registered_query_equals_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want, got = con.execute(queries.ORACLES[name]).df(), queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(got[columns].itertuples(index=False, name=None)) == sorted(want[columns].itertuples(index=False, name=None))


def test_equal_statements_are_read_once(spark):
    rows = fingerprint_counts(spark.createDataFrame([("SELECT 1",)] * 5 + [("SELECT 2",), (None,)], "sql string")).collect()
    assert {r.normalized_sql: r.statements for r in rows} == {"SELECT ?": 6, None: 1}


def test_token_rows_keep_other_columns(spark):
    rows = token_rows(spark.createDataFrame([(7, "SELECT a")], "k int, sql string")).orderBy("pos").collect()
    assert [(r.k, r.pos, r.type) for r in rows] == [(7, 0, "COMMAND"), (7, 1, "SPACE"), (7, 2, "IDENT")]


def test_fields_of_tokens(spark):
    """Only the wanted fields are made; they are those of all."""
    row = spark.createDataFrame([("SELECT 'a\x01b' FROM t1 -- x",), (None,), ("",)], "sql string").select(tokenize(F.col("sql")).alias("a"), tokenize(F.col("sql"), fields=["value", "type"]).alias("b")).collect()
    assert [None if r.a is None else [(t.value, t.type) for t in r.a] for r in row] == [None if r.b is None else [tuple(t) for t in r.b] for r in row]
    assert [list(t.asDict()) for t in row[0].b[:1]] == [["value", "type"]]


def test_parts_grow_in_number_and_not_in_size(spark, tmp_path):
    """A table is worked on in more parts than it is read in, so that a part of a large one is not the work of hours; the parts of twice as
    many are as large."""
    from inkstone.sources.statements import spread

    sizes = []
    for n in (4, 8):
        spark.range(n * 16_000).repartition(n).write.parquet(f"{tmp_path}/{n}")
        spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 30))  # a part for each file
        try:
            table = spark.read.parquet(f"{tmp_path}/{n}")
            assert table.rdd.getNumPartitions() == n
            sizes.append(max(r["count"] for r in spread(table).groupBy(F.spark_partition_id()).count().collect()))
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert max(sizes) < 2_000


def test_roundtrip_reads_whole_texts(spark, tmp_path):
    """Its SQL counts every text: null, and those with more after a NUL, too. Tokens are made with all their fields."""
    texts = ["SELECT 1", None, "", "\0", "a\0b", "a\0'b\0\"c /*\0*/ [d", "$a$ x\0y $a$ z\0 1", "$a$ x\0 open", "\x01\x02\x03\x04\x05\x06", "\x03\x04\0\x01", "it's \x01 'q\0\0", "é漢😀\0é"]
    con = duckdb.connect()
    for name, column in (("documents", "text"), ("conversations", "text"), ("pages", "html")):
        spark.createDataFrame([(t,) for t in texts], f"{column} string").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    made = queries.tokenize_roundtrip(spark, str(tmp_path))
    assert sorted(map(tuple, made.collect())) == sorted(con.execute(queries.ORACLES["tokenize_roundtrip"]).fetchall())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert [field for field in FIELDS if f"{field}, " not in plan] == []


def test_tokens_past_a_nul(spark):
    """Each NUL outside a dollar quote is a token, and what follows it is read as a text of its own."""
    texts = ["SELECT 'a\0b' FROM t\0", "\0\0x", "$t$\0$t$\0$t$\0", "a\0b", "FROM\0t1", None, ""]
    for dialect in Dialect:
        got = all_of(spark, texts, lambda c: tokenize(c, dialect, past_nul=True))  # noqa: B023
        for text, tokens in zip(texts, got, strict=True):
            assert (None if tokens is None else "".join(t.value for t in tokens)) == text
        first, *_ = got
        assert [(t.type, t.value) for t in first if t.type != "SPACE"] == [("COMMAND", "SELECT"), ("INCOMPLETE_STRING", "'a"), ("EOF", "\0"), ("IDENT", "b"), ("INCOMPLETE_STRING", "' FROM t"), ("EOF", "\0")]
        assert [t.type for t in got[1]] == ["EOF", "EOF", "IDENT"]
        assert [t.type for t in got[4]] == ["KEYWORD", "EOF", "IDENT"]
    assert [t.type for t in got[2]] == ["DOLLAR_QUOTED_STRING", "EOF", "ERROR"]
