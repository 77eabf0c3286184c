"""Style sheets: rows from files and texts, the cascade, expectations."""

import random

from lorica.operators import styles
from lorica.operators.styles import Expected
from lorica.sources.styles import StyleReader, declarations, parsed, stylesheets


def short(css):
    return [(s, p, v, lo, hi) for _, s, p, v, _, _, lo, hi in declarations(css)]


def test_declarations():
    assert short("a{b:c}") == [("a", "b", "c", None, None)]
    assert short("a , b>c{ x : 1 ; y:2 !important }") == [("a", "x", "1", None, None), ("b>c", "x", "1", None, None), ("a", "y", "2", None, None), ("b>c", "y", "2", None, None)]
    assert [r[0] for r in declarations("a,b{x:1;y:2}")] == [0, 0, 1, 1] and [r[4] for r in declarations("a{x:1!IMPORTANT;y:2}")] == [True, False]
    assert short("/* a{b:c} */a{/*;*/b:/*}*/c}") == [("a", "b", "c", None, None)]
    assert short("""a{content:"};{:";b:url(data:x;base64,{}==);c:'it\\'s }'}""") == [("a", "content", '"};{:"', None, None), ("a", "b", "url(data:x;base64,{}==)", None, None), ("a", "c", "'it\\'s }'", None, None)]
    assert short("a:not(.b,.c),d[e=','] {f:g}") == [("a:not(.b,.c)", "f", "g", None, None), ("d[e=',']", "f", "g", None, None)]
    assert short("@media (min-width:10px) and (max-width: 90.5px){@supports (x:y){@media (width<=80px){a{b:c}}}}a{b:d}") == [("a", "b", "c", 10.0, 80.5 - 0.5), ("a", "b", "d", None, None)]
    assert short("@media (width >= 5px){a{b:c}}@MEDIA print{d{e:f}}") == [("a", "b", "c", 5.0, None), ("d", "e", "f", None, None)]
    assert [r[5] for r in declarations("@media print{@media (width<=8px){a{b:c}}}")] == [["print", "(width<=8px)"]]
    assert short("@import 'x';@font-face{src:y}@keyframes k{from{a:b}50%{a:c}}") == [("from", "a", "b", None, None), ("50%", "a", "c", None, None)]
    assert short("a{b:c;d{e:f}g:h}") == [("a", "b", "c", None, None), ("d", "e", "f", None, None), ("a", "g", "h", None, None)]
    assert short("a{b:c") == short("a{b:c;;}}") == [("a", "b", "c", None, None)] and short("") == short("}};{}a{}b") == [] and short("/* open") == []
    assert short("a{--x:{y:z};b:c}")[-1][:3] == ("a", "b", "c")
    assert len(short("a{b:" + "c" * 1_000_000 + "}" + "a{b:c}" * 20_000)) == 20_001


def write(folder, sheets):
    for name, css in sheets.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_text(css)


def test_files(spark, tmp_path):
    write(tmp_path, {"b.css": ".g{c:2}@media (max-width:500px){.g{c:1}}", "a.css": ".g{c:9;d:8}", "sub/c.css": ".h{é:ü}", "no.txt": ".g{c:0}", "empty.css": ""})
    rows = stylesheets(spark, str(tmp_path))
    assert sorted((r["file"], r["ord"], r["selector"], r["prop"], r["value"], r["max_width"]) for r in rows.collect()) == [("a.css", 0, ".g", "c", "9", None), ("a.css", 1, ".g", "d", "8", None), ("b.css", 0, ".g", "c", "2", None), ("b.css", 1, ".g", "c", "1", 500.0), ("sub/c.css", 0, ".h", "é", "ü", None)]
    assert stylesheets(spark, f"file://{tmp_path}", 1).rdd.getNumPartitions() == 4 and rows.rdd.getNumPartitions() == 1
    held = {(r["prop"], r["width"]): r["value"] for r in styles.resolved(rows, [400, 500, 501]).where("selector = '.g'").collect()}
    assert held == {("c", 400.0): "1", ("c", 500.0): "1", ("c", 501.0): "2", ("d", 400.0): "8", ("d", 500.0): "8", ("d", 501.0): "8"}
    wanted = [Expected(".g", "c", 500, "is", "1"), Expected(".g", "c", 900, "is", "1"), Expected(".g", "d", 900, "at_least", "8.5"), Expected(".x", "y", 1, "holds", ""), Expected(".h", "é", 3, "holds", "ü")]
    failed = {(r["selector"], r["prop"], r["width"], r["value"]) for r in styles.failures(rows, wanted).collect()}
    assert failed == {(".g", "c", 900.0, "2"), (".g", "d", 900.0, "8"), (".x", "y", 1.0, None)}
    (tmp_path / "none").mkdir()
    assert stylesheets(spark, str(tmp_path / "none")).count() == 0


def test_partitions_by_bytes(tmp_path):
    write(tmp_path, {f"{k:03}.css": "a{b:c}" * (k % 7) for k in range(100)})
    parts = StyleReader({"path": str(tmp_path), "partitionBytes": "100"}).partitions()
    names = [n for p in parts for n in p.paths]
    assert names == [f"{k:03}.css" for k in range(100)] and all(sum(6 * (int(n[:3]) % 7) for n in p.paths) <= 100 for p in parts) and len(parts) > 10


def test_basis_and_keys(spark):
    sheets = spark.createDataFrame([(1, ".a{flex:1 1  104px}"), (2, ".a{flex: 104px }"), (3, ".a{flex:2 1 104px}"), (4, None), (5, "")], "site int, css string")
    rows = parsed(sheets, "site")
    expected = [Expected(".a", "flex", 100, "basis", "104px"), Expected(".a", "flex", 100, "unknown", "104px")]
    failed = {(r["site"], r["kind"]) for r in styles.failures(rows, expected, sheets, by=["site"], order=["ord"]).collect()}
    assert failed == {(3, "basis"), (4, "basis"), (5, "basis"), *((k, "unknown") for k in range(1, 6))}


def test_cascade_against_a_loop(spark):
    r = random.Random(4)
    rules, css = [], ""
    for k in range(300):
        lo, hi = r.choice([None, r.randrange(100, 900)]), r.choice([None, r.randrange(100, 900)])
        selector, prop = r.choice([".a", ".b"]), r.choice(["x", "y"])
        rules.append((selector, prop, str(k), lo, hi))
        inner = f"{selector}{{{prop}:{k}}}"
        inner = f"@media (max-width:{hi}px){{{inner}}}" if hi else inner
        css += f"@media (min-width: {lo}px){{{inner}}}" if lo else inner
    want = {}
    for w in range(100, 900, 50):
        for s, p, v, lo, hi in rules:
            if (lo is None or lo <= w) and (hi is None or w <= hi):
                want[s, p, float(w)] = v
    rows = parsed(spark.createDataFrame([("f", css)], "file string, css string"), "file")
    assert {(x["selector"], x["prop"], x["width"]): x["value"] for x in styles.resolved(rows, range(100, 900, 50)).collect()} == want
