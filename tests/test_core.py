"""Scanner, repetition, rules, settings, stripper and hot keys."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.functions.languages import LANGUAGES, Language
from plumbline.functions.lexing import normalize_whitespace, strip_comments
from plumbline.operators import reports, rules, scan
from plumbline.operators import repetition as rep
from plumbline.operators.config import apply_settings, config_errors, parse_settings
from plumbline.operators.hotkeys import compress_values, heavy_keys, key_results, weighted_percentiles
from plumbline.session import intermediate, materialize
from plumbline.sources import sinks
from plumbline.sources.tables import clean_path, first_rows
from plumbline.sources.tree import SETTINGS, is_named, read_settings, read_tree
from plumbline.streaming import debounce as debounces
from plumbline.streaming.debounce import debounce, debounce_stream, read_edits, to_analyse

# (ext, content, lines, imports, depth, repetition in per cent with blocks of 4 lines)
CASES = [
    ("rs", "", 0, 0, 0, 0.0),
    ("rs", "a\nb", 2, 0, 0, 0.0),
    ("rs", "\n\n", 2, 0, 0, 0.0),
    ("rs", " " * 28 + "\n", 1, 0, 7, 0.0),
    ("rs", "\t" * 7 + "x\n", 1, 0, 7, 0.0),
    ("py", '"""\nfrom the server\n"""\nimport os\n', 4, 2, 0, 0.0),
    ("rs", "user = 1\nmodule = 2\npub use x;\n", 3, 2, 0, 0.0),
    ("lua", "--[[ a\nb = 1\n]]\nc=2\n", 4, 0, 0, 0.0),
    ("rs", "fn f<'a>() {}\n// it is\nx\n", 3, 0, 0, 0.0),
    ("rs", '"a\\\nb"\nc\n', 2, 0, 0, 0.0),
    ("rs", "    beep(7);\n" * 400, 400, 0, 1, 100.0),
    ("cs", "var k = 0;\n" * 410, 410, 0, 0, 100.0),
    ("rs", "a\nb\nc\nd\n\n// x\na\nb\nc\nd\n", 10, 0, 0, 80.0),
    ("rs", "a\n\nb\nc\nd\nz\na\nb\nc\n//k\nd\n", 11, 0, 0, 800 / 11),
    ("rs", "/* x\n*/        y\n", 2, 0, 2, 0.0),
    ("go", "import q\nfunc a() {\n\treturn\n}\n" * 90, 360, 90, 1, 100.0),
    ("js", "let u = 1;\nlet v = u;\n\tlet w = v + u;\n" * 300, 900, 0, 1, 100.0),
    ("gd", "# c\nextends Node\n", 2, 1, 0, 0.0),
    ("cs", "x = `a\n  b`;  \n", 2, 0, 0, 0.0),
]


def scanned(spark, rows, languages=LANGUAGES):
    df = spark.createDataFrame(rows, "path string, ext string, content string")
    return scan.scan_lines(df, languages)


def measured(spark, rows, window=4):
    return scan.measured(scanned(spark, rows)).withColumn("window", F.lit(window))


def test_metrics(spark):
    m = measured(spark, [(f"{i}.{e}", e, c) for i, (e, c, *_) in enumerate(CASES)])
    got = {x.path: x for x in rep.with_local_repetition(m).collect()}
    for i, (ext, _, lines, imports, depth, repetition) in enumerate(CASES):
        x = got[f"{i}.{ext}"]
        assert (x.lines, x.imports, x.depth) == (lines, imports, depth), CASES[i]
        assert abs(x.repetition - repetition) < 1e-9, CASES[i]


def test_code_lines(spark):
    rows = scanned(spark, [("a", "rs", "x = 'it\\'s // no'; // yes\n/* a\n b */ y /* z */ w\n"), ("b", "lua", "--[[ a\nb = 1\n]]\n")])
    got = defaultdict(list)
    for x in scan.line_table(rows).where("code <> ''").orderBy("path", "line").collect():
        got[x.path].append((x.line, x.code))
    assert got == {"a": [(1, "x = 'it\\'s // no';"), (3, "y  w")], "b": [(2, "b = 1"), (3, "]]")]}


def test_an_added_language_is_scanned_stripped_and_fixed(spark):
    cobol = Language("Cobol", ("cob",), "*>", None, ("COPY",), 7)
    text = "*> head\n       COPY x. *> y\n              MOVE a.\n"
    assert scanned(spark, [("a", "cob", text)]).first().lines[1].is_import is False
    lines = scanned(spark, [("a", "cob", text)], [*LANGUAGES, cobol]).first().lines
    assert [(x.depth, x.is_import, x.code) for x in lines] == [(0, False, ""), (1, True, "COPY x."), (2, False, "MOVE a.")]
    df = spark.createDataFrame([("cob", text)], "ext string, content string")
    assert df.select(strip_comments(F.col("content"), F.col("ext"), True, languages=[*LANGUAGES, cobol])).first()[0] == "COPY x.\n              MOVE a."
    found = spark.createDataFrame([("a.cob", "max-lines")], "path string, rule string")
    assert reports.quick_fixes(found, F.lit("cob"), [*LANGUAGES, cobol]).first().edit == f"*> {scan.DISABLE_TAG} max-lines\n"


def test_windows_reject_sizes_below_one(spark):
    with pytest.raises(Exception, match="at least 1"):
        rep.windows(measured(spark, [("a", "rs", "x\n")], 0)).collect()


def test_repetition_within_a_row_equals_counting_lines(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", "c\n", "// x\n", "\n", "d\n", "e\n"]) + "\n" * r.randint(0, 1) for _ in range(r.randint(0, 60))) for _ in range(40)]
    for window in (1, 3):
        m = measured(spark, [(str(i), "rs", t) for i, t in enumerate(texts)], window)
        got = {x.path: x.repetition for x in rep.with_local_repetition(m).collect()}
        for x in m.collect():
            places = defaultdict(list)
            for i in range(len(x.hashes) - window + 1):
                places[tuple(x.hashes[i : i + window])].append(i)
            hit = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(window)}
            assert abs(got[x.path] - (100 * len(hit) / x.lines if x.lines else 0)) < 1e-9


def test_repetition_across_files_counts_physical_lines(spark):
    m = rep.with_local_repetition(measured(spark, [("a", "rs", "1\n2\n\n3\n4\n5\n"), ("b", "rs", "1\n2\n3\n4\n"), ("c", "rs", "9\n")]))
    out = rep.with_global_repetition(m, rep.group_members(rep.windows(m)))
    assert {x.path: round(x.repetition, 3) for x in out.collect()} == {"a": 66.667, "b": 100.0, "c": 0.0}


def test_other_places_are_limited_and_counted(spark):
    m = measured(spark, [(f"{i}", "rs", "q\nw\n") for i in range(6)], 2)
    got = {x.path: x for x in rep.with_other_places(rep.group_members(rep.windows(m)), limit=3).collect()}
    assert [p.path for p in got["0"].others] == ["1", "2", "3"] and got["0"].more == 2
    assert [p.path for p in got["5"].others] == ["0", "1", "2"] and got["5"].more == 2
    assert spark.range(1).select(reports.also_in(F.array(F.struct(F.lit("a").alias("path"), F.lit(1).alias("line"))), F.lit(2))).first()[0] == "a:1 and 2 more"
    assert spark.range(1).select(reports.head_lines(F.lit("1\n2\n3\n4"))).first()[0] == "1\n2\n3"


def test_blocks_at_the_end_are_counted_but_not_listed(spark):
    text = "a\nb\nx\na\nb\n"
    m = measured(spark, [("p", "rs", text)], 2)
    files = spark.createDataFrame([("p", text)], "path string, content string")
    assert [(x.line, x.content, [tuple(o) for o in x.others]) for x in rep.local_details(rep.windows(m), files, m).collect()] == [(1, "a\nb", [("p", 4)])]


def test_directives(spark):
    nine, tag, off = "x\n" * 9, scan.IGNORE_TAG, scan.DISABLE_TAG
    rows = [(f"{nine}// {tag}", True), (f"{nine}x\n// {tag}", False), (tag.title(), False), (f"# {tag}\ncode()", True)]
    df = spark.createDataFrame(rows, "content string, want boolean")
    assert df.where(scan.is_ignored(F.col("content")) != F.col("want")).count() == 0
    df = spark.createDataFrame([(f"// {off.upper()} max-lines Max-Depth */\ncode()",), ("x\n" * 20 + f"// {off} max-lines",), ("",)], "content string")
    assert [x[0] for x in df.select(scan.disabled_rules(F.col("content"))).collect()] == [["max-lines", "max-depth", "*/"], [], []]
    assert spark.range(1).select(scan.is_line_ignored(F.lit(f"x // {tag}")), scan.is_line_ignored(F.lit("x"))).first()[:] == (True, False)


STRIPS = [
    ("rs", True, "{\n  // first\n  /* second */\n  let n = 8;\n}", "{\n\n  let n = 8;\n}"),
    ("rs", False, "/// about\nstruct A;", "/// about\nstruct A;"),
    ("rs", True, "/// about\nstruct A;", "struct A;"),
    ("rs", True, 'u = "ftp://host/a"; // b', 'u = "ftp://host/a";'),
    ("rs", False, "let a = 1; // plain\n", "let a = 1;"),
    ("tsx", True, "<p>{/* one */}</p>", "<p></p>"),
    ("tsx", True, "<p>{  /* one */  }</p>", "<p></p>"),
    ("tsx", False, "<p>{\n  /* one */\n}</p>", "<p></p>"),
    ("tsx", True, "f(() => { g(); /* c */ });", "f(() => { g();  });"),
    ("py", False, 'x = 1 # c\n"""doc"""\n', 'x = 1\n"""doc"""'),
    ("lua", False, "--[[ a\nb ]]\nc=2 -- d\n", "c=2"),
    ("rs", True, "/* \n\n\n*/\n\n\n  x  \n", "x"),
    ("txt", True, "a // b  \n\n\n", "a // b  \n\n\n"),
]


def test_strip(spark):
    for aggressive in (True, False):
        rows = [(e, c, w) for e, a, c, w in STRIPS if a == aggressive]
        df = spark.createDataFrame(rows, "ext string, content string, want string")
        for x in df.withColumn("got", strip_comments(F.col("content"), F.col("ext"), aggressive)).collect():
            assert x.got == x.want
    df = spark.createDataFrame([("rs", "let a = 1; // plain\n"), ("py", "x = 1 # c\n")], "ext string, content string")
    assert [x[0] for x in df.select(strip_comments(F.col("content"), F.col("ext"), False, literal=True)).collect()] == ["let a = 1; // plain", "x = 1"]
    df = spark.createDataFrame([("tsx", "f(() => { g(); /* c */ });"), ("tsx", "/* a\nb */\n\n}x"), ("rs", "{ /* c */ }")], "ext string, content string")
    assert [x[0] for x in df.select(strip_comments(F.col("content"), F.col("ext"), True, literal=True)).collect()] == ["f(() => { g(); );", "x", "{  }"]
    assert spark.range(1).select(normalize_whitespace(F.lit("\n a \r\n\n\n\nb\t\n"))).first()[0] == "a\n\nb"


def test_rules_and_verdicts(spark):
    t = spark.createDataFrame([("default", 10, None, 2, 10.0, 4), ("cpp", 20, 3, None, None, None)], "ext string, max_lines long, max_depth long, max_imports long, max_repetition double, min_duplicate_lines long")
    rows = [("a.rs", "rs", 11, 2, 12.25, [], [0, 7]), ("b.h", "h", 20, 3, 10.0, [], [3]), ("c.rs", "rs", 11, 9, 50.0, ["max-lines", "max-imports", "max-depth"], [9]), ("d", None, 10, 2, 0.0, [], [])]
    m = spark.createDataFrame(rows, "path string, ext string, lines long, imports long, repetition double, disabled array<string>, depths array<int>")
    m = rules.with_limits(m, t)
    assert {(x.path, x.max_lines, x.max_depth, x.max_imports) for x in m.collect()} == {("a.rs", 10, 6, 2), ("b.h", 20, 3, 2), ("c.rs", 10, 6, 2), ("d", 10, 6, 2)}
    judged = rules.with_issues(m, {"max_repetition": "warning"})
    assert {(x.path, x.message, x.severity, x.line) for x in rules.issue_table(judged).collect()} == {
        ("a.rs", "File too long: 11 lines (max 10)", "error", None), ("a.rs", "High code repetition: 12.2% (max 10.0%)", "warning", None), ("a.rs", "Excessive nesting: 7 levels (max 6)", "error", 2),
        ("b.h", "Too many imports: 3 (max 2)", "error", None), ("c.rs", "High code repetition: 50.0% (max 10.0%)", "warning", None),
    }
    assert {(x.path, len(x.issues), x.passed) for x in judged.collect()} == {("a.rs", 3, False), ("b.h", 1, False), ("c.rs", 1, True), ("d", 0, True)}
    assert {x.severity for x in rules.issue_table(rules.with_issues(m.withColumn("sev_max_lines", F.lit("warning")), depth=False).where("path = 'a.rs'")).collect()} == {"warning", "error"}
    assert rules.issue_table(rules.with_issues(m, depth=False)).where("rule = 'max-depth'").count() == 0
    assert tuple(reports.summary(judged).first()) == (4, 2, 2, False)
    assert tuple(rules.exit_code(judged).first()) == (False, 1) and tuple(rules.exit_code(judged.limit(0)).first()) == (True, 0)
    assert [x.path for x in reports.ranked(judged).collect()] == ["c.rs", "d", "a.rs", "b.h"]
    assert {x.path: x.report[:9] for x in reports.json_report(reports.problems(judged)).collect()} == {"a.rs": '[{"line":', "b.h": '{"line":1', "c.rs": '{"line":1'}
    assert tuple(reports.quiet_summary(judged).first()) == (4, 2, 2)
    assert reports.quiet_summary(judged.where("path = 'd'")).count() == 0 and reports.quiet(judged).count() == 3


BODIES = [
    ("", '{"exclude": [], "thresholds": {"global": {"max_lines": 100}, "overrides": {"java": {"max_imports": 100}}, "severities": {"max_lines": "warning"}}}'),
    ("a", '{"exclude": ["gen"], "thresholds": {"global": {"max_lines": 400, "max_depth": 3}, "overrides": {"java": {"max_lines": 7}}, "severities": {"max-lines": "error"}}}'),
    ("b", '{"thresholds": {"severities": {"max-lines": "fatal"}}}'), ("c", "{"), ("d", '{"thresholds": {"global": {"min_duplicate_lines": 0}}}'), ("e", '{"extra": 1}'), ("f", "[]"),
]


def test_settings_reach_the_files(spark):
    settings = parse_settings(spark.createDataFrame(BODIES, "dir string, body string"))
    rows = [("x.java", ""), ("a/x.java", "a"), ("a/y/gen.rs", "a/y"), ("a/y/z.rs", "a/y"), *((f"{d}/q/x.rs", f"{d}/q") for d in "bcdef")]
    files = spark.createDataFrame([(p, p.rsplit(".")[-1], d) for p, d in rows], "path string, ext string, dir string")
    got = {x.path: x for x in apply_settings(files, settings).collect()}
    assert set(got) == {"x.java", "a/x.java", "a/y/z.rs"}
    # an override counts as a whole, and a limit that is the default does not override
    assert (got["x.java"].max_imports, got["x.java"].max_lines, got["x.java"].sev_max_lines) == (100, 100, "warning")
    assert (got["a/x.java"].max_imports, got["a/x.java"].max_lines, got["a/x.java"].sev_max_lines) == (25, 7, "error")
    assert (got["a/y/z.rs"].max_lines, got["a/y/z.rs"].max_depth) == (100, 3)
    assert {tuple(x) for x in config_errors(settings, files).collect()} == {(d, 1) for d in "bcdef"}
    broken_root = parse_settings(spark.createDataFrame([("", "{"), *BODIES[1:2]], "dir string, body string"))
    assert apply_settings(files, broken_root).count() == 0
    none = apply_settings(files, settings.limit(0)).collect()
    assert len(none) == len(rows) and none[0].max_lines == 400 and none[0].sev_max_lines is None


def test_sinks(spark, tmp_path):
    report = spark.createDataFrame([("b", '{"line":1,"message":"m"}'), ('a"x', "[1,2]")], "path string, report string")
    sinks.write_json_report(report, str(tmp_path / "r"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "r")).collect()]
    assert sorted(x["path"] for x in lines) == ['a"x', "b"] and [x for x in lines if x["path"] == "b"][0]["report"] == {"line": 1, "message": "m"}
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json_report(report, str(tmp_path / "r"))


def test_hot_keys_match_plain_counting(spark):
    r = random.Random(1)
    data = [(r.choice(["hot"] * 6 + ["b", "c", None]), r.choice([1, 2, 3, None]), i, "x") for i in range(900)]
    df = spark.createDataFrame(data, "k string, v int, at int, key string")
    got = {x.key: x for x in key_results(compress_values(df, "k", "v", "at")).collect()}
    for k in ("hot", "b", "c"):
        rows = [d for d in data if d[0] == k]
        c = Counter(d[1] for d in rows if d[1] is not None)
        mode = min(c, key=lambda v: (-c[v], v))
        x = got[k]
        assert (x.entries, x.distinct_values, x.mode_value, x.mode_weight, x.first_place) == (len(rows), len(c), mode, c[mode], rows[0][2])
    assert set(got) == {"hot", "b", "c"}
    p = {(x.key, x.p): x.value for x in weighted_percentiles(compress_values(df, "k", "v"), [0.5, 1.0]).collect()}
    many = [("hot", r.randint(0, 5000)) for _ in range(4000)] + [("cold", 3), ("cold", None)]
    frame = spark.createDataFrame(many, "k string, v int")
    for x in weighted_percentiles(compress_values(frame, "k", "v"), [0.0, 0.3, 0.99, 1.0]).collect():
        own = sorted(v for k, v in many if k == x.key and v is not None)
        assert x.value == own[max(-int(-x.p * len(own) // 1), 1) - 1]
    values = sorted(d[1] for d in data if d[0] == "hot" and d[1] is not None)
    assert p["hot", 0.5] == values[-(-len(values) // 2) - 1] and p["hot", 1.0] == 3
    assert [x.key for x in heavy_keys(compress_values(df, "k", "v"), 900, 25, 0.5).collect()] == ["hot"]
    assert key_results(compress_values(df.limit(0), "k", "v")).count() == 0
    nulls = spark.createDataFrame([("a", None), ("a", None)], "k string, v int")
    assert tuple(key_results(compress_values(nulls, "k", "v")).first()) == ("a", 2, 0, None, None, None)


def test_paths(spark):
    df = spark.createDataFrame([("./a//b\\c/./d.rs",), ("a/b",), (None,), ("a/././b",)], "p string")
    assert [x[0] for x in df.select(clean_path(F.col("p"))).collect()] == ["a/b/c/d.rs", "a/b", None, "a/b"]


def test_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "src/a.rs").write_text("fn f() {}\n")
    (tmp_path / "src/__init__.py").write_text("")
    (tmp_path / "src/bad.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "src/big.py").write_bytes(b"x = 1\n" * 4000 + b"import \xff\nimport y\n")
    (tmp_path / "build.txt").write_text("x")
    (tmp_path / ".hidden/b.rs").write_text("x")
    (tmp_path / SETTINGS).write_text("{}")
    got = {x.path: x for x in read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/a.rs", "src/big.py", "src/__init__.py"} and got["src/a.rs"].dir == "src" and got["src/a.rs"].ext == "rs"
    assert {x.path: x.imports for x in scan.measured(scan.scan_lines(read_tree(spark, str(tmp_path)))).collect()}["src/big.py"] == 1
    assert read_tree(spark, str(tmp_path), ["src"]).count() == 0
    (tmp_path / "src" / SETTINGS).write_text('{"exclude": []}')
    dirs = spark.createDataFrame([("src/deep",), ("src",)], "dir string")
    assert {tuple(x) for x in read_settings(dirs, str(tmp_path)).collect()} == {("", "{}"), ("src", '{"exclude": []}')}
    (tmp_path / ".gitignore").write_text("*.rs\n!a.rs\n")
    (tmp_path / "src/.gitignore").write_text("big.*\n")
    assert {x.path for x in read_tree(spark, str(tmp_path), ignore=True).collect()} == {"src/a.rs", "src/__init__.py"}
    (tmp_path / "none").mkdir()
    assert read_tree(spark, str(tmp_path / "none")).count() == 0


def test_ignore_patterns():
    files = {"": "# c\n\nout/\n/top.rs\n*.log\nd/**/x.rs\n[ab].py\n", "keep": "!*.log\n"}
    named = ["out/a.rs", "k/out/b.rs", "top.rs", "a.log", "k/a.log", "d/x.rs", "d/e/f/x.rs", "k/a.py"]
    kept = ["k/top.rs", "outer/a.rs", "keep/a.log", "d/y.rs", "c.py", "k/out"]
    assert [p for p in named if not is_named(p, files)] == [] and [p for p in kept if is_named(p, files)] == []


def test_first_rows_keeps_one_row_per_key(spark, tmp_path):
    rows = [("a", "1"), ("b", "2"), ("a", "1"), (None, "3"), ("c", None), ("a", "1")]
    spark.createDataFrame(rows, "k string, v string").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert sorted(map(tuple, first_rows(df, F.col("k")).collect()), key=str) == [("a", "1"), ("b", "2"), ("c", None)]
    assert sorted(map(tuple, first_rows(df, F.col("k"), F.col("v").isNotNull()).collect())) == [("a", "1"), ("b", "2")]


def test_intermediate_tables_end_with_their_scope(spark):
    with intermediate():
        df = materialize(spark.range(5))
        assert df.count() == 5
    with pytest.raises(Exception):
        df.collect()


def test_debounce(spark, tmp_path, monkeypatch):
    rows = [("a", "1", 0.0), ("a", "2", 0.2), ("a", "3", 1.0), ("b", "4", 0.1), (None, "5", 0.0)]
    df = spark.createDataFrame(rows, "uri string, text string, at double").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    assert {(x.uri, x.text) for x in debounce(df).collect()} == {("a", "2"), ("a", "3"), ("b", "4")}
    r = random.Random(2)
    times = sorted({r.randint(-5000, 5000) for _ in range(1500)})
    many = spark.createDataFrame([("u", t) for t in times], "uri string, t int").withColumn("ts", F.timestamp_millis("t"))
    quiet = {a for a, b in zip(times, [*times[1:], 10**9]) if b - a >= 4}
    for stretch in (1, 3, 1000):
        monkeypatch.setattr(debounces, "STRETCH", stretch)
        assert {x.t for x in debounce(many, "4 milliseconds").collect()} == quiet
    src = str(tmp_path / "in")
    df.where("uri IS NOT NULL").coalesce(1).write.parquet(src)
    spark.createDataFrame([("z", "9", 1e6)], "uri string, text string, at double").withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("uri string, text string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = debounce_stream(stream).writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(x.uri, x.text) for x in spark.table("bursts").collect()} >= {("a", "2"), ("a", "3"), ("b", "4")}


def test_opened_documents_and_last_changes_are_analysed(spark, tmp_path):
    rows = [("a", "open", 0.0), ("a", "change", 0.1), ("a", "change", 0.2), ("a", "open", 0.25), ("b", None, 5.0)]
    df = spark.createDataFrame(rows, "uri string, kind string, at double").withColumn("ts", F.timestamp_seconds("at"))
    assert sorted((x.uri, x.at) for x in to_analyse(df).collect()) == [("a", 0.0), ("a", 0.2), ("a", 0.25), ("b", 5.0)]
    (tmp_path / "x.json").write_text('{"uri": "a", "kind": "open", "text": "t", "ts": "2040-01-01T00:00:00Z"}\n')
    q = read_edits(spark, str(tmp_path)).writeStream.format("memory").queryName("edits").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("edits").first().text == "t"
