"""Programs as sources."""

import sys

import pytest

from lorica.sources.commands import command, piped


def python(code):
    return [sys.executable, "-c", code]


def test_command(spark):
    lines = command(spark, python("import json\nfor i in range(2500): print(json.dumps({'a': i, 'b': 'é' * (i % 3)}))"), "a int, b string")
    assert lines.count() == 2500 and lines.where("a = 5").first()["b"] == "éé"
    array = command(spark, python("print('[{\"a\": 1},\\n {\"a\": 2, \"b\": [3]}]')"), "a int, b array<int>", array=True)
    assert [tuple(r) for r in array.orderBy("a").collect()] == [(1, None), (2, [3])]
    assert command(spark, python("pass"), "a int").count() == command(spark, python("print()"), "a int", array=True).count() == 0


@pytest.mark.parametrize("code,said", [("import sys; print('{}'); sys.exit('no luck')", "no luck"), ("print('{\"a\": 1')", "JSON|json|MALFORMED"), ("raise SystemExit(3)", "ended with 3")])
def test_a_program_that_fails(spark, code, said):
    with pytest.raises(Exception, match=said):
        command(spark, python(code), "a int").collect()


def test_piped(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else f"x\n{i}") for i in range(3000)], "i int, t string").repartition(4)
    double = "import json, sys\nfor l in sys.stdin:\n    r = json.loads(l)\n    for k in range(r['i'] % 3): print(json.dumps({'i': r['i'], 'k': k, 'null': r['t'] is None}))"
    got = sorted(tuple(r) for r in piped(df, python(double), "i int, k int, null boolean").collect())
    assert got == sorted((i, k, i % 5 == 0) for i in range(3000) for k in range(i % 3))
    first = "import sys; sys.stdin.readline(); print('{\"i\": 1}')"  # it does not read all, and ends well
    assert piped(df, python(first), "i int").count() == 4
    assert piped(df.limit(0), python(double), "i int").count() == 0
    with pytest.raises(Exception, match="bad row"):
        piped(df, python("import sys\nfor l in sys.stdin:\n    if '77' in l: sys.exit('bad row')"), "i int").collect()
