"""Diff parsing edge cases (binary files, languages, hunk headers, markers)."""

from revlens.operators import diffs as D

PATCH = "@@ -1,3 +1,4 @@ ctx\n+added\n+++i\n-removed\n---sql\n+\n+   \n-\n same\n@@ -9 +12 @@\n+x"


def _parse(spark, rows):
    df = spark.createDataFrame(rows, "filename string, patch string")
    return {r.filename: r for r in D.changed_files(df).collect()}


def test_binary_file_skipped(spark):
    got = _parse(spark, [("img.png", None), ("empty.py", ""), ("a.py", "@@ -1 +1 @@\n+x")])
    assert set(got) == {"a.py"}


def test_language_by_last_dot(spark):
    names = ["app.js", "style.css", "m.py", "c.ts", "d.jsx", "e.tsx", "App.PY", "dir.d/Makefile", "noext", "x."]
    got = _parse(spark, [(n, "+x") for n in names])
    expect = {"app.js": "javascript", "style.css": "unknown", "m.py": "python", "c.ts": "javascript",
              "d.jsx": "javascript", "e.tsx": "javascript", "App.PY": "unknown", "dir.d/Makefile": "unknown",
              "noext": "unknown", "x.": "unknown"}
    assert {k: v.language for k, v in got.items()} == expect


def test_lines_and_hunks(spark):
    r = _parse(spark, [("f.py", PATCH)])["f.py"]
    assert list(r.added_lines) == ["added", "   ", "x"]
    assert list(r.removed_lines) == ["removed"]
    assert [(h.start, h.length) for h in r.hunks] == [(1, 4), (12, 1)]


def test_diff_line_table(spark):
    df = spark.createDataFrame([("f.py", PATCH)], "filename string, patch string")
    kinds = [r.kind for r in D.diff_lines(df).orderBy("line_no").collect()]
    assert kinds[:5] == ["hunk", "added", "other", "removed", "other"]
