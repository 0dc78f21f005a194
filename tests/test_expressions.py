import pytest

from tidemill.errors import SqlError

CASES = [
    ("'a' || 'b' || 'c'", "abc"), ("1 || '-' || 2", "1-2"), ("'x' || NULL", None), ("1 + 2 || 3", "33"),
    ("'42'::int", 42), ("1.7::integer", 2), ("5::text", "5"), ("(-2.5)::int", -3), ("'1.7'::int", 2), ("2.0::text", "2.0"),
    ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("1 / 0", None), ("5 % 0", None), ("1.5 / 0", None), ("17 % 5", 2),
    ("CASE WHEN 5 < 10 THEN 'lo' ELSE 'hi' END", "lo"), ("CASE 3 WHEN 1 THEN 'a' END", None), ("CASE NULL WHEN NULL THEN 1 ELSE 2 END", 2),
    ("5 IN (1, NULL)", None), ("5 IN ()", False), ("5 NOT IN (1, 2)", True), ("2 BETWEEN 2 AND 3", True),
    ("'100%' LIKE '100\\%' ESCAPE '\\'", True), ("'1000' LIKE '100\\%' ESCAPE '\\'", False), ("'abc' ILIKE 'ABC'", True), ("'abc' LIKE 'ABC'", False),
    ("ifnull(NULL, 7)", 7), ("iif(0, 'x', 'y')", "y"), ("greatest(3, 9, 1)", 9), ("least(3, NULL, 1)", 1), ("nullif(3, 3)", None),
    ("1 = '1'", False), ("1 <> '1'", True), ("1 < '2'", None), ("NOT 0", True), ("'0' AND 1", False), ("TRUE = 1", True),
    ("substr('hello', 2, 3)", "ell"), ("substr('hello', -2)", "lo"), ("substr('abc', 0, 2)", "a"), ("replace('a-b-c', '-', '_')", "a_b_c"), ("instr('hello', 'l')", 3), ("instr('hello', 'z')", 0),
    ("repeat('ab', 3)", "ababab"), ("reverse('abc')", "cba"), ("left('hello', 2)", "he"), ("right('hello', 2)", "lo"), ("left('hello', -2)", "hel"), ("right('hello', -2)", "llo"), ("lpad('7', 3, '0')", "007"), ("rpad('7', 3, '.')", "7.."), ("lpad('hello', 2)", "he"),
    ("trim('  a\t\n')", "a"), ("concat('a', NULL, 'b')", "ab"), ("length('héé')", 3), ("hex('AB')", "4142"), ("upper('é')", "É"),
    ("ceil(2.1)", 3.0), ("floor(2.9)", 2.0), ("sqrt(9)", 3.0), ("power(2, 10)", 1024.0), ("mod(17, 5)", 2), ("sign(-4)", -1), ("round(3.14159, 2)", 3.14), ("round(2.6)", 3), ("abs(-7)", 7), ("trunc(-2.7)", -2.0), ("log(100)", 2.0), ("mod(1, 0)", None), ("ln(0)", float("-inf")),
    ("date('2021-07-04 12:30:45')", "2021-07-04"), ("datetime('2021-07-04 12:30:45')", "2021-07-04 12:30:45"), ("date_trunc('month', '2021-07-04 12:30:45')", "2021-07-01 00:00:00"), ("extract(year FROM '2021-07-04 12:30:45')", 2021), ("extract(dow FROM '2021-07-04 12:30:45')", 0), ("extract(nothing FROM '2021-07-04')", None),
    ("strftime('%Y/%m/%d', '2021-07-04 12:30:45')", "2021/07/04"), ("datetime('2021-07-04T12:30:45+02:00')", "2021-07-04 12:30:45"), ("unixepoch('1970-01-02')", 86400), ("datetime(0)", "1970-01-01 00:00:00"),
    ("typeof(1)", "integer"), ("typeof('x')", "text"), ("typeof(1.5)", "real"), ("typeof(NULL)", "null"), ("typeof([1, 2])", "vector"), ("length(gen_random_uuid())", 36), ("substr(gen_random_uuid(), 15, 1)", "4"), ("random() < 1", True),
    ("""'{"name":"Ada","tags":["a","b"],"age":36}' ->> 'name'""", "Ada"), ("""'{"tags":["a","b"]}' -> 'tags' ->> 1""", "b"), ("""'{"tags":["a","b"]}' -> 'tags' -> -1""", '"b"'), ("""'{"a":null}' -> 'a'""", "null"), ("""'{"a":null}' ->> 'a'""", None),
    ("""json_extract('{"age":36}', '$.age')""", "36"), ("""json_extract('{"ok":true}', '$.ok')""", "1"), ("json_array(1, 'two', 3)", '[1,"two",3]'), ("json_build_object('k', 1, 'name', 'Ada')", '{"k":1,"name":"Ada"}'), ("json_build_object('n', NULL)", '{"n":null}'), ("'nope' -> 'a'", None), ("to_json('a\"b')", '"a\\"b"'),
    ("lower(NULL)", None), ("abs(NULL)", None), ("'it''s'", "it's"), ("-2 * -3", 6), ("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("1 -- no\n", 1), ("X'4142'::text", "QUI="),
]


def test_values(plain):
    """All in one query: a column each."""
    got = plain.query("SELECT " + ", ".join(f"{sql}\n AS c{i}" for i, (sql, _) in enumerate(CASES))).rows[0]
    wrong = [(sql, want, have) for (sql, want), have in zip(CASES, got, strict=True) if have != want or isinstance(have, bool) != isinstance(want, bool)]
    assert not wrong


@pytest.mark.parametrize("sql", ["'nope'::int", "nope(1)", "iif(1, 2)", "date_trunc('fortnight', '2021-01-01')", "json_build_object('a')", "strftime(lower('a'), 'now')", "[1, 2] <-> [1, 2, 3]"])
def test_errors(plain, sql):
    with pytest.raises(SqlError):
        _ = plain.query(f"SELECT {sql}").rows


def test_null_order(plain):
    rows = "(VALUES (1, 10), (2, NULL), (3, 20)) v"
    assert [r[0] for r in plain.query(f"SELECT column1 FROM {rows} ORDER BY column2")] == [2, 1, 3]
    assert [r[0] for r in plain.query(f"SELECT column1 FROM {rows} ORDER BY column2 DESC")] == [3, 1, 2]
    assert [r[0] for r in plain.query(f"SELECT column1 FROM {rows} ORDER BY column2 NULLS LAST")] == [1, 3, 2]
    assert [r[0] for r in plain.query(f"SELECT column1 FROM {rows} ORDER BY column2 DESC NULLS FIRST")][0] == 2


def test_parameters(plain):
    assert plain.query("SELECT $2, $1, $2", [1, "dup"]).rows == [("dup", 1, "dup")]
    assert plain.query("SELECT :a || :b || :a AS t", {"a": "x", "b": "y"}).rows == [("xyx",)]
    assert plain.query("SELECT ?, ?", [None, [1.0, 2.0]]).rows == [(None, [1.0, 2.0])]
    s = plain.prepare("SELECT column1 FROM (VALUES (1), (2), (3)) v WHERE column1 > :low ORDER BY 1 + 0, column1").bind("low", 1)
    assert s.step() and s.row == (2,) and s.step() and not s.step()
    with pytest.raises(Exception, match="no parameter"):
        s.bind(3, 1)


def test_vectors(plain, spark):
    items = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, [0.9, 0.1, 0.0]), (5, None)], "id bigint, embedding array<float>")
    plain.db.attach("items", items)
    for op in ("<->", "<=>", "<#>"):
        assert [r[0] for r in plain.query(f"SELECT id FROM items WHERE embedding IS NOT NULL ORDER BY embedding {op} [1, 0, 0], id LIMIT 2")] == [1, 4]
    assert plain.query("SELECT id FROM items WHERE embedding IS NOT NULL ORDER BY embedding <-> '[0,1,0]' LIMIT 1").rows == [(2,)]
    assert plain.query("SELECT embedding <-> [1, 0, 0] FROM items WHERE id = 5").rows == [(None,)]
    with pytest.raises(SqlError):
        _ = plain.query("SELECT embedding <-> [1, 0] FROM items").rows


