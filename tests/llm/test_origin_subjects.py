"""Origin of files and subjects of documents."""

import random

from plumbline.llm.origin import counting, file_labels, text_levels
from plumbline.llm.subjects import classify, fit, reasoning, training_rows

HAND = "import a\n\ndef run(x):\n    total = compute_the_total(x, 17)\n    return total\n" * 4


def hand(i):
    return "".join(f"def name_{i}_{k}(x):\n    value_{i}_{k} = handle_the_case_{i}_{k}(x + {k})\n    return value_{i}_{k}\n" for k in range(6))


FILES = [
    (1, "p/src/a.py", hand(1), None),
    (2, "p/src/gen_a.py", "x = 'Code generated by t. DO NOT EDIT.'\n" + hand(2), None),
    (3, "p/src/b.py", "# Code generated by tool. DO NOT EDIT.\n" + hand(3), None),
    (4, "p/vendor/lib/x.js", hand(4), None),
    (5, "p/src/vendors/y.js", hand(5), None),
    (6, "q/lib/x_copy.js", hand(4), None),
    (7, "q/src/t.js", "t = [\n" + "    123, 456, 789, 1011,\n" * 60 + "]\n", None),
    (8, "q/src/m.js", "function a(b){return b.c(d)}" * 60, None),
    (9, "q/generated-sources/x/z.java", None, None),
    (10, "q/src/one.py", hand(10) + "s = '" + "abc-" * 60 + "'\n", None),
    (11, None, "// <auto-generated>\n" + hand(11), None),
    (12, None, None, None),
    (13, "", "", None),
    (14, "q/src/same_a.py", hand(14), None),
    (15, "q/src/same_b.py", hand(14), None),
    (1, "p/src/a.py", hand(1), None),
    (None, "p/src/n.py", hand(16), None),
    (16, "q/src/foot.py", hand(17) + "# @generated by tool from x\n", None),
    (17, "deep/" + "d/" * 40 + "x.py", hand(18) * 50, None),
]
SCHEMA = "file_id long, path string, content string, score int"


def labels(df, reports=None):
    return {x.file_id: x.label for x in file_labels(df, reports).collect()}


def test_labels(spark):
    df = spark.createDataFrame(FILES, SCHEMA)
    got = labels(df)
    assert got == {
        1: "handwritten", 2: "handwritten", 3: "generated", 4: "vendored", 5: "handwritten", 6: "vendored", 7: "blob", 8: "minified", 9: "generated",
        10: "handwritten", 11: "generated", 12: "handwritten", 13: "handwritten", 14: "handwritten", 15: "handwritten", 16: "generated", 17: "handwritten",
    }
    reports = spark.createDataFrame([(1, 5, 80.0, None, 2), (None, None, None, None, 3), (9, None, None, None, 1)], "file_id long, lines long, repetition double, run_ts timestamp, label int")
    assert labels(df, reports)[1] == "handwritten"
    assert labels(df.limit(0), reports) == {}


def test_a_directory_speaks_for_its_files(spark):
    rows = [(i, f"p/tools/out/f{i}.py", "# @generated by tool\n" + hand(i)) for i in range(6)] + [(9, "p/tools/out/f9.py", None), (10, "p/tools/in/f10.py", None)]
    got = labels(spark.createDataFrame(rows, "file_id long, path string, content string"))
    assert got[9] == "generated" and got[10] == "handwritten"


def test_partial_copies_of_a_library(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    code = lambda n: [f"    {word()} = {word()}.{word()}({word()})" for _ in range(n)]
    library = code(60)
    rows = [(0, "p/vendor/lib/x.py", "\n".join(library)), (9, "r/src/own.py", "\n".join(code(60)))]
    for i in range(1, 5):  # half of it each, and own lines around it
        rows.append((i, f"q{i}/src/half.py", "\n".join(code(10) + r.sample(library, 30) + code(10))))
    got = labels(spark.createDataFrame(rows, "file_id long, path string, content string"))
    assert got == {0: "vendored", 1: "vendored", 2: "vendored", 3: "vendored", 4: "vendored", 9: "handwritten"}


def test_markers_anywhere_in_the_comments():
    licence = "".join(f"# line {i} of the licence\n" for i in range(80))
    generated, vendored = "# Code generated by tool.\n", "# Copied from the acme project\n"
    long = "".join(map(hand, range(20, 24)))
    marks = lambda text: text_levels(text)[0][:2]
    assert marks(long) == [3, 3]
    assert marks(licence + generated + hand(1)) == [0, 3] and marks(licence + vendored + hand(1)) == [3, 0]
    assert marks(hand(1)[:60] + "\n" + generated + long) == [1, 3]
    assert marks(long + generated + long) == [2, 3] and marks(long + vendored + long) == [3, 2]
    assert marks(long + generated) == [0, 3]
    assert marks(long + generated.replace("# ", "s = ") + long) == [3, 3]


def test_counting_lines_are_no_plain_repetition():
    filled = [f"register_{i:03d}(table, {i});" for i in range(60)]
    assert counting([x for line in filled for x in (line, "flush(table);")]) == 3
    assert counting(filled + [f"own_{chr(97 + i % 26)}{chr(97 + i // 26)}(x);" for i in range(60)]) == 2
    assert counting(["register_001(table, 1);", "flush(table);"] * 200) == 0
    assert counting([f"case {i}: return {i};" for i in range(8)]) == 0
    assert counting([]) == 0


def test_levels_of_shapes():
    odd = hand(1) + "s = '" + "abc-" * 900 + "'\n"
    assert text_levels(odd)[0][2:4] == [1, 1]
    assert text_levels("# licence\n" * 30 + "function a(b){return b.c(d)}" * 60)[0][2:4] == [2, 0]
    assert text_levels("t = [\n" + "    123, 456, 789, 1011,\n" * 60 + "]\n")[0][2:] == [0, 2, 0]
    assert text_levels("")[0] == text_levels(" \n\n")[0] == [-1] * 5


def test_tables_are_fitted_to_the_data(spark):
    # a wording of names that means nothing by itself: files ending so are those with markers
    rows = [(i, f"p{i % 40}/app/f{i}.py", ("# @generated by tool\n" if i % 4 == 0 else "") + hand(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "file_id long, path string, content string")
    got = labels(df)
    assert {i for i, x in got.items() if x == "generated"} == {i for i in range(0, 400, 4)}


def test_precision_and_recall_on_made_projects(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    body = lambda n=14: "".join(f"    {word()} = {word()}.{word()}({word()}, {word()})\n" for _ in range(n))
    libraries = [body(30) for _ in range(20)]
    rows, truth = [], {}

    def add(path, text, other):
        truth[len(rows)] = other
        rows.append((len(rows), path, text))

    for p in range(40):
        tool, home = r.random() < 0.4, r.choice(["src", "app", "core"])
        for k in range(12):
            add(f"p{p}/{home}/{word()}/f{k}.py", ("# licence\n" if p % 2 else "") + body() * r.choice([1, 1, 1, 20]), False)
        add(f"p{p}/{home}/about.py", "TEXT = 'Code generated by t. DO NOT EDIT.'\n" + body(), False)
        add(f"p{p}/{home}/odd.py", body() + "s = '" + "abc/" * 800 + "'\n", False)
        for k in range(3 * tool):  # two of three with a marker, the third known by its directory
            add(f"p{p}/{home}/generated/g{k}.py", ("# Code generated by tool. DO NOT EDIT.\n" if k else "") + body(), True)
        if p % 5 == 0:
            add(f"p{p}/{home}/{word()}.py", "".join(f"register_{i:03d}(table, {i})\nflush(table)\n" for i in range(90)), True)
            add(f"p{p}/static/app.min.js", "function a(b){return b.c(d)}" * 90, True)
            add(f"p{p}/data/table.py", "t = [\n" + "    17, 230, 4110, 5,\n" * 50 + "]\n", True)
        library = r.choice(libraries)
        add(f"p{p}/vendor/{word()}/x.py", library, True)
        if p % 3 == 0:  # a copy outside of the known directories
            add(f"p{p}/{home}/{word()}.py", r.choice(libraries), None)
    known = {text for i, p, text in rows if "/vendor/" in p}
    truth = {i: text in known if truth[i] is None else truth[i] for i, _, text in rows}
    got = labels(spark.createDataFrame(rows, "file_id long, path string, content string"))
    found = {i for i, x in got.items() if x != "handwritten"}
    want = {i for i, x in truth.items() if x}
    assert len(found & want) >= 0.98 * len(found) and len(found & want) >= 0.98 * len(want), (sorted(found - want), sorted(want - found))


TERMS = {"tax": ["levy", "duty", "audit", "excise"], "sport": ["referee", "league", "athlete", "doping"], "law": ["service", "costs", "delay"]}
FRAMES = ["The dispute concerns the {}.", "As to the {}, the claimant replied.", "The expert described the {} in detail."]


def decision(r, subjects):
    lines = ["COURT OF X", f"Chamber: {r.choice(list(TERMS)).title()}", "Headnote:", "The league decides.", ""]
    for k in range(1, 9):
        own = r.choice(FRAMES).format(r.choice(TERMS[r.choice(subjects)]))
        aside = f" This case is not about the {r.choice(TERMS[r.choice(list(TERMS))])}." if r.random() < 0.3 else ""
        lines.append(f"[{k}] {own}{aside} We agree (see In re Y (the {r.choice(TERMS['sport'])}), 3 R. 5).")
        if k == 4:
            lines.append("- 2 -")
    return "\n".join(lines)


def test_reasoning_only():
    text = "COURT\n12/30\nHeadnote:\nThe tax decides.\n¶ 1 The levy (see A (the duty), 3) is\nPage 2 of 3\ndue. It fails.\n§ 2 Costs follow."
    assert [" ".join(s.split()) for s in reasoning(text)] == ["The levy is due.", "It fails.", "Costs follow."]
    assert reasoning("") == [] and reasoning("no paragraphs here") == []


def test_subjects_held_out(spark):
    r = random.Random(1)
    docs = []
    for i in range(500):
        s = ["law"] if r.random() < 0.2 else r.sample(["tax", "sport"], r.choice([1, 1, 2]))
        docs.append((i, decision(r, s), set(s)))
    known = [(i, (" " + x).upper()) for i, _, s in docs[:300] for x in s] + [(0, "unknown"), (None, "tax"), (1, None), (3, "tax " if "tax" in docs[3][2] else "sport")]
    frame = spark.createDataFrame([(i, t, "q") for i, t, _ in docs] + [(900, None, ""), (901, "", ""), (902, "no paragraphs", ""), (None, docs[0][1], ""), (0, docs[0][1], "")], "doc_id long, text string, subject string")
    marked = training_rows(frame, spark.createDataFrame(known, "doc_id long, subject string"), 1000, 100).collect()
    assert len([x for x in marked if x.labels]) == 300
    model = fit([x.text for x in marked], [set(x.labels) for x in marked], [None] * len(marked), list(TERMS), "law")
    got = {}
    for x in classify(frame, model).collect():
        got.setdefault(x.doc_id, set()).add(x.subject)
    right = sum(got.get(i) == s for i, _, s in docs[300:])
    assert right >= 0.9 * 200
    assert not {900, 901, 902, None} & got.keys()
    assert classify(frame.limit(0), model).count() == 0
    nothing = fit([], [], [], list(TERMS))
    assert classify(frame, nothing).count() == 0
