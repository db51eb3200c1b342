"""Source files of several shapes as a derived table, with their function facts told by hand.

A file's text is one sample with the part key in its names; the facts are the
oracle's and are never read by the job.
"""

from __future__ import annotations

# (language, text, facts); K stands for the file's key, facts are
# (name, first line, last line, complexity, docstring, parameters, method)
SAMPLES = [
    ("python", '''class Store_K(Base):
\t"""Holds def inner(x): in its text"""
\tasync def fetch_K(
\t\tself,
\t\tkey: int = default(1, 2),
\t\t*args, many=[1, (2, 3)], **kw,
\t) -> dict:
\t\t"""Doc
\tdef not_a_function(): or if"""
\t\tif key and many:  # and or
\t\t\treturn "x or y"

\t\treturn 1
\tdef short_K(self): "one line"
''', [("fetch_K", 2, 12, 3, True, 4, True), ("short_K", 13, 13, 1, True, 0, True)]),
    ("python", '''def one_K(x): return x if x and y else [i for i in x if i]
def outer_K(a=lambda: {1: 2}, /, *, b):
    # note
    class Inner:
        def method_K(self, q):
            with a as b, c:
                pass
    try:
        for i in x: pass
    except (A,
            B):
        y = (1 +
  2)
    else: pass

z = 1
''', [("one_K", 0, 0, 2, False, 1, False), ("outer_K", 1, 13, 5, False, 2, False), ("method_K", 4, 6, 2, False, 1, False)]),
    ("python", '''@register(a or b)
def last_K(cls, q: "def s(): pass" = "(,", w=")"):
    text = f"""
def nope(): pass
"""
    while q or \\
            w: q = w
    return text
    # trailing
async def unfinished_K(a,
        b
''', [("last_K", 1, 7, 3, False, 2, False), ("unfinished_K", 9, 10, 1, False, 2, False)]),
    ("javascript", '''// function comment_K() {}
const mul_K = (a, b) => { return a * b; };
let t = `a ${items.map(i => `n ${i.x && 1}`).join(",")} function no() {}`;
function greet_K(name = "x", {a, b}, ...rest) { "use strict"; if (a && b || /[/"]x{2}/.test(name)) { return 1; } else if (b) { for (const q of b) {} } }
const dbl_K = x => x * 2, sum_K = async (p, q) =>
  p
  + q
function after_K() { /* note */ "no"; }
''', [("mul_K", 1, 1, 1, False, 2, False), ("i", 2, 2, 2, False, 1, False), ("greet_K", 3, 3, 6, True, 3, False),
      ("dbl_K", 4, 4, 1, False, 1, False), ("sum_K", 4, 6, 1, False, 2, False), ("after_K", 7, 7, 1, False, 0, False)]),
    ("javascript", '''class Calc_K extends mix(A, {}) {
  #p = 1;
  static async run_K(a) {
    do { a--; } while (a > 0);
    try { x(); } catch (e) { } finally {}
  }
  get value_K() { return this.#p; }
  *gen_K() {}
  [Symbol.iterator]() { function inner_K(a) {} }
  handler = (e) => { this.x(e) };
  catch(e) { }
}
''', [("run_K", 2, 5, 3, False, 1, True), ("value_K", 6, 6, 1, False, 0, True), ("gen_K", 7, 7, 1, False, 0, True),
      ("<anonymous>", 8, 8, 1, False, 0, True), ("inner_K", 8, 8, 1, False, 1, False),
      ("<anonymous>", 9, 9, 1, False, 1, True), ("catch", 10, 10, 1, False, 1, True)]),
    ("javascript", '''const o_K = { foo_K() { return 1 }, bar: function() {}, baz: async (x) => x };
var f_K = function named_K(a, b, c) {
  switch (a) { case 1: return b ? c : a }
}
const r = a / b / c; export default function () { `doc`; }
if (x) { foo(1) }
p.then((v) => v).catch(err => { while (err) log(err) })
''', [("foo_K", 0, 0, 1, False, 0, False), ("<anonymous>", 0, 0, 1, False, 0, False), ("x", 0, 0, 1, False, 1, False),
      ("f_K", 1, 3, 1, False, 3, False), ("<anonymous>", 4, 4, 1, True, 0, False), ("v", 6, 6, 1, False, 1, False),
      ("err", 6, 6, 2, False, 1, False)]),
    ("ruby", "def x_K\nend\n", []),
]


def _sql_text(text: str) -> str:
    """SQL of a text, in a form that Spark and DuckDB read alike (K is the key, special letters by number)."""
    parts, plain = [], ""
    for c in text:
        if c == "K" or c in "'\\$\n\t{}`":
            if plain:
                parts.append(f"'{plain}'")
                plain = ""
            parts.append("CAST(p_partkey AS STRING)" if c == "K" else f"chr({ord(c)})")
        else:
            plain += c
    if plain:
        parts.append(f"'{plain}'")
    return f"concat({', '.join(parts)})"


def source_template() -> str:
    """The derived table (file_id, language, source)."""
    n = len(SAMPLES)
    langs = " ".join(f"WHEN {i} THEN '{s[0]}'" for i, s in enumerate(SAMPLES))
    texts = " ".join(f"WHEN {i} THEN {_sql_text(s[1])}" for i, s in enumerate(SAMPLES))
    return (f"SELECT p_partkey AS file_id, CASE p_partkey % {n} {langs} END AS language, "
            f"CASE p_partkey % {n} {texts} END AS source FROM {{part}}")


def facts_sql() -> str:
    """The facts of every file, told by hand."""
    rows = ",\n".join(f"({i}, '{name}', {a}, {b}, {c}, {str(d).lower()}, {p}, {str(m).lower()})"
                      for i, s in enumerate(SAMPLES) for name, a, b, c, d, p, m in s[2])
    return (f"SELECT p_partkey AS file_id, replace(name, 'K', CAST(p_partkey AS VARCHAR)) AS name, start_line, end_line, "
            f"complexity, has_docstring, param_count, is_method\nFROM part JOIN (VALUES {rows}) "
            f"AS v(sample, name, start_line, end_line, complexity, has_docstring, param_count, is_method) "
            f"ON p_partkey % {len(SAMPLES)} = v.sample")
