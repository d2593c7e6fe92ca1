"""Registered queries of the SQL-text operations.

The test tables hold no SQL, so statements are put together from their columns. The expected results are written down by
hand from the rules, with values and counts from plain SQL; nothing of them comes from the operations themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone import cli
from inkstone.functions.catalog import create_functions
from inkstone.functions.dialects import Dialect
from inkstone.functions.normalize import NormalizerConfig, normalize, obfuscate_and_normalize
from inkstone.functions.obfuscate import ObfuscatorConfig, obfuscate, obfuscate_token_value
from inkstone.functions.tokens import tokenize
from inkstone.functions.views import create_statement_view
from inkstone.operators.statements import distinct_statements, fingerprint_counts, token_rows, with_normalized, with_normalized_by_row, with_obfuscated
from inkstone.sources.statements import parts_of, read_statements, shared_folder, spread, write_file, write_results
from inkstone.streaming.statements import windowed_fingerprints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str):
    def add(query):
        QUERIES[query.__name__] = query
        ORACLES[query.__name__] = oracle
        return query

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def said(*parts: str | Column) -> Column:
    """A statement from texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def counted(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("statements"))


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(said("SELECT * FROM orders WHERE o_orderkey = ", F.col("o_orderkey"), " AND o_orderstatus = '", F.col("o_orderstatus"), "'").alias("sql"))


@registered("""
SELECT t.type, t.n * c.statements AS tokens FROM (SELECT count(*) AS statements FROM orders) c,
(VALUES ('COMMAND', 1), ('WILDCARD', 1), ('KEYWORD', 3), ('IDENT', 3), ('OPERATOR', 2), ('NUMBER', 1), ('STRING', 1), ('SPACE', 11)) t(type, n)""")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rows(lookups(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("tokens"))


@registered("""
SELECT 'documents' AS source, count(*) AS texts, count(*) AS lossless, sum(length(text))::BIGINT AS n_chars FROM documents
UNION ALL SELECT 'conversations', count(*), count(*), sum(length(text))::BIGINT FROM conversations
UNION ALL SELECT 'pages', count(*), count(*), sum(length(html))::BIGINT FROM pages""")
def tokenize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tokens of any text, each with its type, join to that text: past NULs too, and null gives null."""

    def one(name: str, column: str) -> DataFrame:
        rows = read(spark, sf_dir, name).select(F.col(column).alias("text"), tokenize(F.col(column), past_nul=True).alias("tokens"))
        typed = F.coalesce(F.forall("tokens", lambda t: t["type"].isNotNull()), F.lit(True))
        lossless = F.array_join("tokens.value", "").eqNullSafe(F.col("text")) & typed
        return rows.agg(F.lit(name).alias("source"), F.count("*").alias("texts"), F.count_if(lossless).alias("lossless"), F.sum(F.char_length("text")).alias("n_chars"))

    return reduce(DataFrame.unionAll, [one("documents", "text"), one("conversations", "text"), one("pages", "html")])


@registered("SELECT 'SELECT * FROM orders WHERE o_orderkey = ? AND o_orderstatus = ?' AS obfuscated_sql, count(*) AS statements FROM orders")
def obfuscate_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(with_obfuscated(lookups(spark, sf_dir)), "obfuscated_sql")


@registered("""
SELECT CASE WHEN floor(c_acctbal) < 0 THEN 'SELECT bal=-?, bal= ?' ELSE 'SELECT bal=?, bal= ?' END AS obfuscated_sql, count(*) AS statements FROM customer GROUP BY 1""")
def obfuscate_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sign after an operator belongs to the operator, after a space to the number."""
    balance = F.floor("c_acctbal")
    return counted(with_obfuscated(read(spark, sf_dir, "customer").select(said("SELECT bal=", balance, ", bal= ", balance).alias("sql"))), "obfuscated_sql")


@registered("SELECT 'SELECT * FROM t_? WHERE s?x? = ?' AS obfuscated_sql, count(*) AS statements FROM supplier")
def obfuscate_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(said("SELECT * FROM t_", F.col("s_nationkey"), " WHERE s9x", F.col("s_suppkey"), " = 1").alias("sql"))
    return counted(with_obfuscated(rows, ObfuscatorConfig(replace_digits=True)), "obfuscated_sql")


@registered("""
SELECT o.option, o.obfuscated_sql, c.statements FROM (SELECT count(*) AS statements FROM part) c, (VALUES
('none', 'SELECT TRUE, null, $1, @p FROM t1 WHERE a -> ? = ?'), ('replace_boolean', 'SELECT ?, null, $1, @p FROM t1 WHERE a -> ? = ?'), ('replace_null', 'SELECT TRUE, ?, $1, @p FROM t1 WHERE a -> ? = ?'),
('replace_positional_parameter', 'SELECT TRUE, null, ?, @p FROM t1 WHERE a -> ? = ?'), ('replace_bind_parameter', 'SELECT TRUE, null, $1, ? FROM t1 WHERE a -> ? = ?'),
('replace_digits', 'SELECT TRUE, null, $1, @p FROM t? WHERE a -> ? = ?'), ('keep_json_path', 'SELECT TRUE, null, $1, @p FROM t1 WHERE a -> ''k'' = ?')) o(option, obfuscated_sql)""")
def obfuscate_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(said("SELECT TRUE, null, $1, @p FROM t1 WHERE a -> 'k' = ", F.col("p_size")).alias("sql"))
    options = ["replace_boolean", "replace_null", "replace_positional_parameter", "replace_bind_parameter", "replace_digits", "keep_json_path"]
    made = [("none", ObfuscatorConfig()), *((o, ObfuscatorConfig(**{o: True})) for o in options)]
    return reduce(DataFrame.unionAll, [counted(with_obfuscated(rows, c), "obfuscated_sql").select(F.lit(o).alias("option"), "obfuscated_sql", "statements") for o, c in made])


@registered("""
SELECT CASE n_nationkey % 3 WHEN 0 THEN 'SELECT EXTRACT(? FROM t)' WHEN 1 THEN 'SELECT EXTRACT(fortnight FROM t)' ELSE 'SELECT EXTRACT (epoch FROM t)' END AS obfuscated_sql, count(*) AS statements FROM nation GROUP BY 1""")
def obfuscate_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only known fields right inside the call count."""
    k = F.col("n_nationkey") % 3
    text = F.when(k == 0, "SELECT EXTRACT(Epoch FROM t)").when(k == 1, "SELECT EXTRACT(fortnight FROM t)").otherwise("SELECT EXTRACT (epoch FROM t)")
    return counted(with_obfuscated(read(spark, sf_dir, "nation").select(text.alias("sql"))), "obfuscated_sql")


@registered("SELECT 'SELECT * FROM lineitem WHERE l_orderkey = ? AND l_linenumber IN ( ? )' AS normalized_sql, count(DISTINCT l_orderkey) AS statements FROM lineitem")
def normalize_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of any length collapse to one placeholder."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lists = table.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("l_linenumber")).cast("array<string>"), ", ").alias("l"))
    statements = lists.select(said("SELECT * FROM lineitem WHERE l_orderkey = ", F.col("l_orderkey"), " AND l_linenumber IN (", F.col("l"), ")").alias("sql"))
    # each order is in one statement, so none repeats; dealt anew, since few bytes are much work
    return fingerprint_counts(statements.repartition(parts_of(table)), repeats=False)


@registered("SELECT n_nationkey, 'SELECT n.n_name FROM nation WHERE n.n_nationkey = ' || n_nationkey AS dropped, 'SELECT n.n_name AS name FROM nation AS n WHERE n.n_nationkey = ' || n_nationkey AS kept FROM nation")
def normalize_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", said("SELECT  n.n_name AS name -- who\n FROM nation AS n WHERE n.n_nationkey = ", F.col("n_nationkey")).alias("sql"))
    both = with_normalized(rows).withColumnRenamed("normalized_sql", "dropped")
    return with_normalized(both, NormalizerConfig(keep_sql_alias=True)).select("n_nationkey", "dropped", F.col("normalized_sql").alias("kept"))


@registered("""
SELECT r_regionkey, 'SELECT r_name, "r key" FROM region WHERE r_regionkey = ' || r_regionkey AS stripped, 'SELECT "r_name", "r key" FROM "region" WHERE "r_regionkey" = ' || r_regionkey AS kept,
'SELECT r_name FROM dbo.region WHERE r_regionkey = ' || r_regionkey AS brackets FROM region""")
def normalize_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("r_regionkey")
    rows = read(spark, sf_dir, "region").select("r_regionkey", said('SELECT "r_name", "r key" FROM "region" WHERE "r_regionkey" = ', key).alias("sql"), said("SELECT [r_name] FROM [dbo].[region] WHERE [r_regionkey] = ", key).alias("brackets_sql"))
    out = with_normalized(rows).withColumnRenamed("normalized_sql", "stripped")
    out = with_normalized(out, NormalizerConfig(keep_identifier_quotation=True)).withColumnRenamed("normalized_sql", "kept")
    out = with_normalized(out, sql_col="brackets_sql", dialect=Dialect.MSSQL).withColumnRenamed("normalized_sql", "brackets")
    return out.select("r_regionkey", "stripped", "kept", "brackets")


@registered("""
SELECT r_regionkey, 'SELECT count ( * ) FROM region WHERE ( r_regionkey = ' || r_regionkey || ' )' AS spaced, 'SELECT count(*) FROM region WHERE (r_regionkey = ' || r_regionkey || ')' AS tight, 'SELECT * FROM region WHERE r_regionkey = @p1' AS parameters FROM region""")
def normalize_parens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces at parentheses, and a leading list of parameters that is dropped."""
    rows = read(spark, sf_dir, "region").select("r_regionkey", said("SELECT count( *) FROM region WHERE (r_regionkey=", F.col("r_regionkey"), ")").alias("sql"), F.lit("(@p1 bigint)SELECT * FROM region WHERE r_regionkey = @p1").alias("prepared"))
    rows = rows.withColumn("sql", F.regexp_replace("sql", "=", " = "))
    out = with_normalized(rows).withColumnRenamed("normalized_sql", "spaced")
    out = with_normalized(out, NormalizerConfig(remove_space_between_parentheses=True)).withColumnRenamed("normalized_sql", "tight")
    return with_normalized(out, sql_col="prepared").select("r_regionkey", "spaced", "tight", F.col("normalized_sql").alias("parameters"))


@registered("""
SELECT n_nationkey, 'DELETE FROM nation WHERE n_nationkey = ' || n_nationkey AS cut, 'DELETE FROM nation WHERE n_nationkey = ' || n_nationkey || ';' AS kept, 'DELETE FROM nation WHERE n_nationkey = ' || n_nationkey AS upper FROM nation""")
def normalize_semicolon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", said("delete from nation where n_nationkey = ", F.col("n_nationkey"), " ;\n").alias("lower_sql"), said("DELETE FROM nation\tWHERE n_nationkey = ", F.col("n_nationkey"), ";  ").alias("sql"))
    out = with_normalized(rows).withColumnRenamed("normalized_sql", "cut")
    out = with_normalized(out, NormalizerConfig(keep_trailing_semicolon=True)).withColumnRenamed("normalized_sql", "kept")
    return with_normalized(out, NormalizerConfig(uppercase_keywords=True), sql_col="lower_sql").select("n_nationkey", "cut", "kept", F.col("normalized_sql").alias("upper"))


@registered("""
SELECT n_nationkey, 'CREATE FUNCTION f' || n_nationkey || ' ( ) RETURNS int AS $func$BEGIN RETURN ?; END$func$ LANGUAGE plpgsql' AS body, 'CREATE FUNCTION f' || n_nationkey || ' ( ) RETURNS int AS ? LANGUAGE plpgsql' AS hidden FROM nation""")
def normalize_function_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation").select("n_nationkey", said("CREATE FUNCTION f", F.col("n_nationkey"), "() RETURNS int AS $func$\nBEGIN\n  RETURN ", F.col("n_nationkey"), " ;\nEND\n$func$ LANGUAGE plpgsql").alias("sql"))
    out = with_normalized(rows, obfuscator=ObfuscatorConfig(dollar_quoted_func=True), dialect="postgresql").withColumnRenamed("normalized_sql", "body")
    return with_normalized(out, obfuscator=ObfuscatorConfig(), dialect="postgres").select("n_nationkey", "body", F.col("normalized_sql").alias("hidden"))


#: One statement for each order priority's first digit.
STATEMENTS = {
    "1": "WITH c AS (SELECT * FROM a) SELECT * FROM c, b JOIN d ON c.x = d.x /* join */",
    "2": "INSERT INTO a (x) VALUES (1) -- add",
    "3": "UPDATE a SET x = 1; DELETE FROM b",
    "4": "CREATE PROCEDURE p AS SELECT 1",
    "5": "SELECT 1 -- one",
}


def prioritised(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("o_orderpriority", 1, 1)
    text = reduce(lambda c, kv: c.when(k == kv[0], kv[1]), list(STATEMENTS.items())[1:], F.when(k == "1", STATEMENTS["1"]))
    return read(spark, sf_dir, "orders").select(text.alias("sql"))


def by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = NormalizerConfig(collect_tables=True, collect_commands=True, collect_comments=True, collect_procedures=True)
    return with_normalized(distinct_statements(prioritised(spark, sf_dir), "sql"), every)


def summed(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.sum("statements").alias("statements"))


def metadata_oracle(kind: str, *values: str) -> str:
    listed = ", ".join(f"('{i + 1}', '{v}')" for i, v in enumerate(values))
    return f"SELECT v.{kind}, count(*) AS statements FROM orders JOIN (VALUES {listed}) v(k, {kind}) ON v.k = substr(o_orderpriority, 1, 1) GROUP BY 1"


def metadata_counts(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return summed(by_priority(spark, sf_dir).select(F.array_join(f"metadata.{kind}", "|").alias(kind), "statements"), kind)


@registered(metadata_oracle("tables", "a|b|d", "a", "a|b", "", ""))
def metadata_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_counts(spark, sf_dir, "tables")


@registered(metadata_oracle("commands", "SELECT|JOIN", "INSERT", "UPDATE|DELETE", "CREATE|SELECT", "SELECT"))
def metadata_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_counts(spark, sf_dir, "commands")


@registered(metadata_oracle("comments", "/* join */", "-- add", "", "", "-- one"))
def metadata_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_counts(spark, sf_dir, "comments")


@registered(metadata_oracle("procedures", "", "", "", "p", ""))
def metadata_procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata_counts(spark, sf_dir, "procedures")


@registered("""
SELECT v.size::INTEGER AS size, count(*) AS statements FROM orders JOIN (VALUES
('1', strlen('abd') + strlen('SELECTJOIN') + strlen('/* join */')), ('2', strlen('a') + strlen('INSERT') + strlen('-- add')), ('3', strlen('ab') + strlen('UPDATEDELETE')),
('4', strlen('CREATESELECT') + strlen('p')), ('5', strlen('SELECT') + strlen('-- one'))) v(k, size) ON v.k = substr(o_orderpriority, 1, 1) GROUP BY 1""")
def metadata_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summed(by_priority(spark, sf_dir).select(F.col("metadata.size").alias("size"), "statements"), "size")


@registered("""
SELECT v.normalized_sql, count(*) AS statements FROM orders JOIN (VALUES
('1', 'WITH c AS ( SELECT * FROM a ) SELECT * FROM c, b JOIN d ON c.x = d.x'), ('2', 'INSERT INTO a ( x ) VALUES ( ? )'), ('3', 'UPDATE a SET x = ?; DELETE FROM b'),
('4', 'CREATE PROCEDURE p AS SELECT ?'), ('5', 'SELECT ?')) v(k, normalized_sql) ON v.k = substr(o_orderpriority, 1, 1) GROUP BY 1""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_counts(prioritised(spark, sf_dir))


#: The same with an order's key in each, so that no two texts are alike.
KEYED = {
    "1": "WITH c AS (SELECT * FROM a) SELECT * FROM c, b JOIN d ON c.x = d.x AND d.y = {} /* join */",
    "2": "INSERT INTO a (x) VALUES ({}) -- add",
    "3": "UPDATE a SET x = {}; DELETE FROM b",
    "4": "CREATE PROCEDURE p AS SELECT {}",
    "5": "SELECT {} -- one",
}


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("o_orderpriority", 1, 1)
    text = reduce(lambda c, kv: c.when(k == kv[0], kv[1]), list(KEYED.items())[1:], F.when(k == "1", KEYED["1"]))
    return read(spark, sf_dir, "orders").select(F.replace(text, F.lit("{}"), F.col("o_orderkey").cast("string")).alias("sql"))


@registered("""
SELECT v.normalized_sql, count(*) AS statements FROM orders JOIN (VALUES
('1', 'WITH c AS ( SELECT * FROM a ) SELECT * FROM c, b JOIN d ON c.x = d.x AND d.y = ?'), ('2', 'INSERT INTO a ( x ) VALUES ( ? )'), ('3', 'UPDATE a SET x = ?; DELETE FROM b'),
('4', 'CREATE PROCEDURE p AS SELECT ?'), ('5', 'SELECT ?')) v(k, normalized_sql) ON v.k = substr(o_orderpriority, 1, 1) GROUP BY 1""")
def fingerprints_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of which no two are alike: each is read where it is, and only fingerprints are shuffled."""
    return fingerprint_counts(keyed(spark, sf_dir))


@registered("""
SELECT v.found, count(*) AS statements FROM orders JOIN (VALUES
('1', 'a|b|d;SELECT|JOIN;/* join */;;23'), ('2', 'a;INSERT;-- add;;13'), ('3', 'a|b;UPDATE|DELETE;;;14'), ('4', ';CREATE|SELECT;;p;13'), ('5', ';SELECT;-- one;;12')) v(k, found) ON v.k = substr(o_orderpriority, 1, 1) GROUP BY 1""")
def metadata_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metadata of statements of which no two are alike."""
    every = NormalizerConfig(collect_tables=True, collect_commands=True, collect_comments=True, collect_procedures=True)
    m = with_normalized(keyed(spark, sf_dir), every).select(F.concat_ws(";", *[F.array_join(f"metadata.{k}", "|") for k in ("tables", "commands", "comments", "procedures")], "metadata.size").alias("found"))
    return counted(m, "found")


@registered("""
SELECT d.dialect, d.normalized_sql, count(*) AS statements FROM orders JOIN (VALUES (0, '', 'SELECT [ a b ], ` c ` FROM t WHERE k = ? AND v = @p # x'), (1, 'postgresql', 'SELECT [ a b ], ` c ` FROM t WHERE k = ? AND v = @p # x'), (2, 'mysql', 'SELECT [ a b ], c FROM t WHERE k = ? AND v = @p'),
(3, 'sqlserver', 'SELECT [a b], ` c ` FROM t WHERE k = ? AND v = @p # x'), (4, 'oracle', 'SELECT [ a b ], ` c ` FROM t WHERE k = ? AND v = @p # x'), (5, 'snowflake', 'SELECT [ a b ], ` c ` FROM t WHERE k = ? AND v = @p # x')) d(k, dialect, normalized_sql) ON d.k = o_orderkey % 6 GROUP BY ALL""")
def dialects_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six dialects in one table: the cut of tokens is chosen by a column, all later rules are shared."""
    names = F.array(*[F.lit(d) for d in ("", "postgresql", "mysql", "sqlserver", "oracle", "snowflake")])
    rows = read(spark, sf_dir, "orders").select(F.get(names, (F.col("o_orderkey") % 6).cast("int")).alias("dialect"), said("SELECT [a b], `c` FROM t WHERE k = ", F.col("o_orderkey"), " AND v = @p # x").alias("sql"))
    made = with_normalized(rows, obfuscator=ObfuscatorConfig(), dialect_col="dialect")
    return made.groupBy("dialect", "normalized_sql").agg(F.count("*").alias("statements"))


@registered("""
SELECT v.k, v.normalized_sql, v.tables, count(*) AS statements FROM supplier JOIN (VALUES
(0, 'SELECT "a" AS b FROM t1 WHERE c = TRUE', ''), (1, 'SELECT a FROM t? WHERE c = ?', 't?'), (2, 'SELECT "a" FROM t1 WHERE c = TRUE;', '')) v(k, normalized_sql, tables) ON v.k = s_suppkey % 3 GROUP BY ALL""")
def configs_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row has its own configurations."""
    k = (F.col("s_suppkey") % 3).cast("int")
    options = lambda *names: F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(True)) for n in names]))
    none = F.lit(None).cast("map<string,boolean>")
    rows = read(spark, sf_dir, "supplier").select(
        k.alias("k"),
        F.lit('SELECT "a" AS b FROM t1 WHERE c = TRUE;').alias("sql"),
        F.when(k == 1, options("replace_digits", "Replace_Boolean")).otherwise(none).alias("obfuscator"),
        F.when(k == 0, options("keep_sql_alias", "keep_identifier_quotation")).when(k == 1, options("collect_tables")).otherwise(options("keep_trailing_semicolon", "keep_identifier_quotation")).alias("normalizer"),
    )
    made = with_normalized_by_row(rows)
    return made.groupBy("k", "normalized_sql", F.array_join("metadata.tables", "|").alias("tables")).agg(F.count("*").alias("statements"))


@registered("""
SELECT 'SELECT ?, ? FROM `t` # ' || n_nationkey AS mysql, 'SELECT ?, "q" FROM `t` # ?' AS generic, 'SELECT ?, ? FROM `t`' AS normalized, 't' AS tables, 12 AS tokens, n_nationkey FROM nation""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions in SQL."""
    create_functions(spark, config=NormalizerConfig(collect_tables=True, keep_identifier_quotation=True), prefix="inkstone_")
    read(spark, sf_dir, "nation").select("n_nationkey", said("SELECT 'it\\'s', \"q\" FROM `t` # ", F.col("n_nationkey")).alias("sql")).createOrReplaceTempView("inkstone_nation_statements")
    return spark.sql("""
        SELECT inkstone_obfuscate(sql, 'mysql') AS mysql, inkstone_obfuscate(sql) AS generic, made.sql AS normalized, array_join(made.metadata.tables, ',') AS tables, size(inkstone_tokenize(sql, 'mysql')) AS tokens, n_nationkey
        FROM (SELECT *, inkstone_obfuscate_and_normalize(sql, 'MySQL') AS made FROM inkstone_nation_statements)""")


@registered("""
SELECT d.dialect, d.obfuscated_sql, c.statements FROM (SELECT count(*) AS statements FROM nation) c, (VALUES
('', 'SELECT ?, "q", @v, :w # ?'), ('postgresql', 'SELECT ?, "q", @v, :w # ?'), ('mysql', 'SELECT ?, ?, @v, :w # 1'), ('mssql', 'SELECT ?x?'), ('oracle', 'SELECT ?x?'), ('snowflake', 'SELECT ?, "q", @v, :w # ?')) d(dialect, obfuscated_sql)""")
def dialects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text in all dialects, chosen by a column: escapes in strings, double quotes, hash signs."""
    names = F.array(*[F.lit(d.value) for d in Dialect])
    rows = read(spark, sf_dir, "nation").select(F.explode(names).alias("dialect"), F.lit("""SELECT '\\'x', "q", @v, :w # 1""").alias("sql"))
    made = with_obfuscated(rows, dialect_col="dialect")
    return made.groupBy("dialect", "obfuscated_sql").agg(F.count("*").alias("statements"))


@registered("""
SELECT d.dialect, d.bind, d.type, c.statements FROM (SELECT count(*) AS statements FROM region) c, (VALUES
('', ':b', 'OPERATOR'), ('oracle', ':b', 'BIND_PARAMETER'), ('', '@s', 'BIND_PARAMETER'), ('snowflake', '@s', 'IDENT'), ('mssql', '#t', 'IDENT'), ('mysql', '#t', 'COMMENT'), ('', '#t', 'OPERATOR'), ('mssql', '$a', 'IDENT'), ('', '$a', 'ERROR'), ('mysql', '`', 'ERROR'), ('', '`', 'UNKNOWN'),
('mssql', '[x]', 'QUOTED_IDENT'), ('', '[x]', 'PUNCTUATION'), ('', '@@v', 'SYSTEM_VARIABLE'), ('', '->>', 'JSON_OP')) d(dialect, bind, type)""")
def dialect_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of the first token of texts that dialects read differently."""
    cases = [("", ":b"), ("oracle", ":b"), ("", "@s"), ("snowflake", "@s"), ("mssql", "#t"), ("mysql", "#t"), ("", "#t"), ("mssql", "$a"), ("", "$a"), ("mysql", "`"), ("", "`"), ("mssql", "[x]"), ("", "[x]"), ("", "@@v"), ("", "->>")]
    rows = read(spark, sf_dir, "region").select(F.explode(F.array(*[F.struct(F.lit(d).alias("dialect"), F.lit(b).alias("bind")) for d, b in cases])).alias("c")).select("c.*")
    first = token_rows(rows.withColumn("sql", F.col("bind")), dialect_col="dialect").where("pos = 0")
    return first.groupBy("dialect", "bind", "type").agg(F.count("*").alias("statements"))


def by_case(name: str, result: Callable[[Column], Column], cases: list[tuple[str, str]]) -> None:
    """Registers a query of statements in which {} stands for a supplier's key, and what each must give."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        texts = F.array(*[F.struct(F.lit(i).alias("case_no"), F.lit(text).alias("text")) for i, (text, _) in enumerate(cases)])
        rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(texts).alias("c")).select("s_suppkey", "c.*")
        made = rows.select("case_no", "s_suppkey", F.replace("text", F.lit("{}"), F.col("s_suppkey").cast("string")).alias("sql"))
        return made.select("case_no", "s_suppkey", result(F.col("sql")).alias("result"))

    quoted = ", ".join("({}, '{}')".format(i, want.replace("'", "''")) for i, (_, want) in enumerate(cases))
    QUERIES[name] = query
    ORACLES[name] = f"SELECT v.case_no, s_suppkey, replace(v.want, '{{}}', s_suppkey::VARCHAR) AS result FROM supplier, (VALUES {quoted}) v(case_no, want)"


def listed(dialect: str = "") -> Callable[[Column], Column]:
    """Type and text of each token but spaces."""
    return lambda sql: F.array_join(F.transform(F.filter(tokenize(sql, dialect), lambda t: t["type"] != "SPACE"), lambda t: F.concat_ws(":", t["type"], t["value"])), " ")


def normalized(config: NormalizerConfig | None = None, dialect: str = "", obfuscator: ObfuscatorConfig | None = None) -> Callable[[Column], Column]:
    return lambda sql: (normalize(sql, config, dialect) if obfuscator is None else obfuscate_and_normalize(sql, obfuscator, config, dialect))["sql"]


by_case(
    "tokens_numbers",
    listed(),
    [
        ("SELECT 0x{}F", "COMMAND:SELECT NUMBER:0x{}F"),
        ("017 {}", "NUMBER:017 NUMBER:{}"),
        ("019", "NUMBER:01 NUMBER:9"),
        ("1e {}.5", "NUMBER:1e NUMBER:{}.5"),
        ("1.2.3,{}e-7", "NUMBER:1.2.3 PUNCTUATION:, NUMBER:{}e-7"),
        ("id=-{}", "IDENT:id OPERATOR:=- NUMBER:{}"),
        ("id = -{}", "IDENT:id OPERATOR:= NUMBER:-{}"),
    ],
)
by_case(
    "tokens_open_and_quoted",
    listed(),
    [
        ("SELECT /* open {}", "COMMAND:SELECT ERROR:/* open {}"),
        ("SELECT 'open {}", "COMMAND:SELECT INCOMPLETE_STRING:'open {}"),
        ('"open {}', 'ERROR:"open {}'),
        ("$t$ body {} $t$", "DOLLAR_QUOTED_STRING:$t$ body {} $t$"),
        ("$t$ body {}", "ERROR:$t$ body {}"),
        ("'it''s {}'", "STRING:'it' STRING:'s {}'"),
        ("/* a {} */ -- b {}", "MULTILINE_COMMENT:/* a {} */ COMMENT:-- b {}"),
    ],
)
by_case(
    "tokens_signs",
    listed(),
    [
        ("a{} @@ b", "IDENT:a{} JSON_OP:@@ IDENT:b"),
        ("a @? b{}", "IDENT:a JSON_OP:@? IDENT:b{}"),
        ("a{} @> b", "IDENT:a{} JSON_OP:@> IDENT:b"),
        ("a=?", "IDENT:a OPERATOR:= OPERATOR:?"),
        ("a=@p{}", "IDENT:a OPERATOR:= BIND_PARAMETER:@p{}"),
        ("@@v{}", "SYSTEM_VARIABLE:@@v{}"),
        ("a #>> b{}", "IDENT:a JSON_OP:#>> IDENT:b{}"),
    ],
)
by_case(
    "tokens_names",
    listed(),
    [
        ("a{}\0b", "IDENT:a{}"),
        ("SELECT caf\u00e9{}", "COMMAND:SELECT IDENT:caf\u00e9{}"),
        ("\u00e9t\u00e9(", "IDENT:\u00e9t\u00e9 PUNCTUATION:("),
        ("FROM={}", "IDENT:FROM OPERATOR:= NUMBER:{}"),
        ("FROM(", "KEYWORD:FROM PUNCTUATION:("),
        ("dir/file{}", "IDENT:dir/file{}"),
        ("v$session{}", "IDENT:v$session{}"),
        ("sum{}(x)", "FUNCTION:sum{} PUNCTUATION:( IDENT:x PUNCTUATION:)"),
    ],
)
by_case(
    "obfuscate_unchanged",
    lambda sql: obfuscate(sql),
    [
        ("SELECT 1 -- {}", "SELECT ? -- {}"),
        ("SELECT 'x' /* '{}' */", "SELECT ? /* '{}' */"),
        ("SELECT /* {}", "SELECT /* {}"),
        ("\u00a0\u2003SELECT {}\u3000\n", "SELECT ?"),
        ('SELECT "c{}" FROM t{}', 'SELECT "c{}" FROM t{}'),
        ("SELECT $t${}$t$, $1", "SELECT ?, $1"),
    ],
)
by_case("obfuscate_token", lambda sql: F.concat_ws(" ", obfuscate_token_value(F.lit("NUMBER"), sql), obfuscate_token_value(F.lit("IDENT"), sql, config=ObfuscatorConfig(replace_digits=True)), obfuscate_token_value(F.lit("STRING"), sql, F.lit("JSON_OP"), ObfuscatorConfig(keep_json_path=True))), [("7x{}", "? ?x? 7x{}")])
by_case("normalize_names_mssql", normalized(dialect="mssql"), [("SELECT t.[Col{}] FROM  [db].[t]", "SELECT t.Col{} FROM db.t"), ("SELECT #tmp{}.a FROM #tmp{}", "SELECT #tmp{}.a FROM #tmp{}")])
by_case(
    "normalize_statements",
    normalized(obfuscator=ObfuscatorConfig()),
    [
        ("SELECT * FROM t WHERE a = :name{}", "SELECT * FROM t WHERE a = :name{}"),
        ("MERGE INTO t{} USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = 1", "MERGE INTO t{} USING s ON t.id = s.id WHEN MATCHED THEN UPDATE SET a = ?"),
        ("SELECT a, row_number() OVER (PARTITION BY b ORDER BY c DESC) FROM t{}", "SELECT a, row_number ( ) OVER ( PARTITION BY b ORDER BY c DESC ) FROM t{}"),
        ("INSERT INTO t{} (a, b) VALUES ({}, 'x'), (2, 'y')", "INSERT INTO t{} ( a, b ) VALUES ( ? ), ( ? )"),
        ("SELECT a FROM t{} WHERE b BETWEEN 1 AND 2 OR c LIKE '%x'\n  LIMIT 5;", "SELECT a FROM t{} WHERE b BETWEEN ? AND ? OR c LIKE ? LIMIT ?"),
    ],
)


@registered("SELECT 'SELECT ? FROM t?' AS value, count(*) AS statements FROM supplier")
def cli_over_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's rows, over statements that were written and read again as files of lines."""
    path = f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}"
    write_results(read(spark, sf_dir, "supplier").select(said("SELECT ", F.col("s_suppkey"), " FROM t", F.col("s_nationkey")).alias("value")), path, "text")
    return counted(cli.results(read_statements(spark, path, "lines"), cli.parser().parse_args(["-replace-digits=true"])), "value")


@registered("""
SELECT v.mode, replace(v.value, '{}', s_suppkey::VARCHAR) AS value, count(*) AS n FROM supplier, (VALUES ('tokenize', 'SELECT'), ('tokenize', ' '), ('tokenize', '{}'), ('tokenize', ' '), ('tokenize', 'FROM'), ('tokenize', ' '), ('tokenize', 't'), ('tokenize', ';'),
('obfuscate', 'SELECT ? FROM t;'), ('normalize', '{"sql":"SELECT {} FROM t","metadata":{"size":7,"tables":["t"],"comments":[],"commands":["SELECT"],"procedures":[]}}')) v(mode, value) GROUP BY ALL""")
def cli_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's other modes, the last one with metadata."""
    rows = read(spark, sf_dir, "supplier").select(said("SELECT ", F.col("s_suppkey"), " FROM t;").alias("sql"))
    made = [cli.results(rows, cli.parser().parse_args(["-mode", mode, "-with-metadata"])).select(F.lit(mode).alias("mode"), "value") for mode in ("tokenize", "obfuscate", "normalize")]
    return reduce(DataFrame.unionAll, made).groupBy("mode", "value").agg(F.count("*").alias("n"))


@registered("SELECT 'SELECT ? FROM t?' AS value, count(*) AS statements FROM supplier")
def cli_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in one file, whose lines are those of the parts."""
    path = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}.sql"
    rows = read(spark, sf_dir, "supplier").select(said("SELECT ", F.col("s_suppkey"), " FROM t", F.col("s_nationkey")).alias("sql"))
    write_file(cli.results(rows, cli.parser().parse_args([])), path)
    return counted(read_statements(spark, path, "lines"), "sql").withColumnRenamed("sql", "value")


@registered("SELECT 'SELECT ? FROM t' AS obfuscated_sql, 'SELECT ? FROM t' AS normalized_sql, 't' AS tables, count(*) AS statements FROM supplier")
def view_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier").select(said("SELECT ", F.col("s_suppkey"), " FROM t").alias("sql"))
    create_statement_view(rows, "inkstone_statements", config=NormalizerConfig(collect_tables=True))
    return spark.sql("SELECT obfuscated_sql, normalized_sql, array_join(metadata.tables, ',') AS tables, count(*) AS statements FROM inkstone_statements GROUP BY ALL")


@registered("SELECT date_trunc('hour', ts) AS window_start, 'SELECT ? WHERE k = ?' AS normalized_sql, count(*) AS statements FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per hour and fingerprint of the events as a stream, each event as a statement."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    path = f"{sf_dir}/events.parquet"
    # a pattern, so that the table may be a file or a folder
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    statements = events.where("ts IS NOT NULL").select(F.col("ts").cast("timestamp").alias("at"), said("SELECT '", F.col("ts"), "' WHERE k = 1").alias("sql"))

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/counts")

    counts = windowed_fingerprints(statements, "at", "1 hour")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/counts").select("window_start", "normalized_sql", "statements")
