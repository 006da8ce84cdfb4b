import sqlite3

from pyspark.sql import functions as F

from tidemill.operators import knowledge
from tidemill.sources import sqlite_details as D


def test_sqlite_details(spark, tmp_path):
    path = str(tmp_path / "x.db")
    con = sqlite3.connect(path)
    con.executescript("""
        CREATE TABLE parent (id INTEGER PRIMARY KEY, code TEXT UNIQUE NOT NULL DEFAULT 'x');
        CREATE TABLE child (a INT, b INT, rowid TEXT, total INT GENERATED ALWAYS AS (a + b) STORED, parent_id INT REFERENCES parent (id) ON DELETE CASCADE, PRIMARY KEY (b, a)) WITHOUT ROWID;
        CREATE INDEX some ON child (a, parent_id) WHERE a > 1;
        CREATE TABLE named (rowid TEXT);
        CREATE VIEW v AS SELECT id FROM parent;
        CREATE TRIGGER tr AFTER INSERT ON parent BEGIN SELECT 1; END;
    """)
    con.close()
    meta = lambda t: D.metadata(spark, path, t).first()
    assert (meta("parent").rowid_name, meta("parent").primary_key) == ("rowid", ["id"]) and meta("named").rowid_name == "_rowid_"
    assert meta("child").without_rowid and meta("child").rowid_name is None and meta("child").primary_key == ["b", "a"]
    assert meta("v").kind == "view" and meta("v").definition.startswith("CREATE VIEW")
    cols = {r.name: r for r in D.columns(spark, path, "child").collect()}
    assert cols["total"].generated and cols["b"].key == 1 and not cols["a"].generated
    code = D.columns(spark, path, "parent").where("name = 'code'").first()
    assert code.not_null and code.default == "'x'"
    assert {(r.name, r.origin, r.partial, tuple(r.columns)) for r in D.indexes(spark, path, "child").collect()} >= {("some", "c", True, ("a", "parent_id"))}
    assert [(r.from_column, r.to_table, r.to_column, r.on_delete) for r in D.foreign_keys(spark, path, "child").collect()] == [("parent_id", "parent", "id", "CASCADE")]
    assert D.triggers(spark, path, "parent").first().name == "tr" and D.triggers(spark, path, "child").count() == 0
    assert {(r.name, r.kind) for r in D.objects(spark, path).collect()} >= {("v", "view"), ("some", "index"), ("tr", "trigger"), ("child", "table")}


def test_runbook(spark):
    entries = [("good", "monthly revenue by region".split(), 4, 0), ("failing", "monthly revenue by region".split(), 1, 5), ("far", "list of users".split(), 9, 0), ("half", "monthly revenue".split(), 4, 0)]
    df = spark.createDataFrame(entries, "name string, tokens array<string>, runs int, failures int")
    words = spark.createDataFrame([(w,) for w in "monthly revenue region us".split()], "token string")
    got = [(r.name, r.hits) for r in knowledge.recalled_runbook(df, words).collect()]
    assert got == [("good", 3), ("half", 2)]
    assert knowledge.recalled_runbook(df, words.limit(0)).count() == 0


def test_sections_and_notes(spark):
    parts = spark.createDataFrame([(2, "b" * 50), (1, "a" * 30), (3, "c" * 10)], "place int, text string")
    assert knowledge.sections(parts, "h", 60).first().text == "h\n" + "a" * 30 + "\n" + "c" * 10
    assert knowledge.sections(parts.limit(0), "h").first().text is None
    domains = spark.createDataFrame([("sales", ["t", "u"]), ("hr", ["x"])], "path string, tables array<string>")
    terms = spark.createDataFrame([(f"n{i}", "t", float(i)) for i in range(9)], "name string, table string, weight double")
    runbook = spark.createDataFrame([("r1", "t", 3), ("r2", "x", 1)], "name string, table string, runs int")
    links = spark.createDataFrame([("t", "u", 1.0), ("x", "t", 2.0), ("u", "x", 5.0)], "a string, b string, weight double")
    notes = [r.note for r in knowledge.table_notes(domains, terms, runbook, links, "t").orderBy("place").collect()]
    assert notes[0] == "domain sales" and sorted(notes[1:7]) == [f"term n{i}" for i in range(3, 9)] and notes[7] == "runbook r1" and set(notes[8:]) == {"feeds u", "fed by x"}


def test_registered_function(spark):
    from tidemill.plans.script import register_functions

    register_functions(spark)
    rows = spark.sql("SELECT text_tokens('The customerOrders listed') AS t, mask_value('4111-1111') AS m").first()
    assert rows.t == ["customer", "orders", "order", "listed"] and rows.m == "1111"
    df = spark.createDataFrame([("a b",), (None,)], "x string").select(F.expr("text_tokens(x)").alias("t"))
    assert [r.t for r in df.collect()] == [[], []]


FAMILIES = [
    ("INTEGER", "int", "int"), ("bigint(20)", "int", "int"), ("int8", "int", "int"), ("tinyint", "int", "tinyint"), ("unsigned big int", "int", "unsigned big int"), ("bigserial", "int", "int"),
    ("double precision", "float", "float"), ("numeric( 10 , 2 )", "float", "numeric"), ("DECIMAL(5,2)", "float", "numeric"), ("money", "float", "numeric"), ("number", "float", "number"),
    ("timestamp(3) with time zone", "datetime", "timestamptz"), ("timestamp without  time zone", "datetime", "timestamp"), ("timestamp_ntz", "datetime", "timestamp_ntz"), ("date", "date", "date"), ("interval year to month", "time", "interval year to month"),
    ("jsonb", "json", "jsonb"), ("bytea", "blob", "bytea"), ("uuid", "uuid", "uuid"), ("character varying(20)", "text", "text"), ("NVARCHAR(5)", "text", "text"), ("enum('a','b')", "text", "enum('a','b')"), ("text[]", "array", "text[]"), ("array<int>", "array", "array<int>"),
    ("boolean", "bool", "bool"), ("my   type", "other", "my type"), ("", "other", ""), ("point", "other", "point"),
]


def test_type_families_and_short_names(spark):
    from tidemill.functions import text as X

    got = spark.createDataFrame([(i, d) for i, (d, _, _) in enumerate(FAMILIES)], "i int, d string").select("i", X.type_family(F.col("d")).alias("f"), X.compact_type(F.col("d")).alias("s")).orderBy("i").collect()
    assert [(r.f, r.s) for r in got] == [(f, s) for _, f, s in FAMILIES]
