"""Definitions against a plain scanner; macros; cards rebuilt from files."""

import hashlib
import json
import random

import pytest

from heddle.operators import cards, csource as C


def plain(source):
    """Definitions by one walk over characters."""
    code, i = list(source), 0
    while i < len(source):
        two = source[i : i + 2]
        j = i + 1
        if two == "//":
            while j < len(source) and source[j] != "\n":
                j += 1
        elif two == "/*":
            j = source.find("*/", i + 2)
            j = len(source) if j < 0 else j + 2
        elif source[i] in "\"'":
            while j < len(source) and source[j] != source[i]:
                j += 2 if source[j] == "\\" else 1
            j = min(j + 1, len(source))
        else:
            i += 1
            continue
        for k in range(i, j):
            if source[k] != "\n":
                code[k] = " "
        i = j
    code = "".join(code)

    def match(at, a, b):
        depth = 0
        for k in range(at, len(code)):
            depth += (code[k] == a) - (code[k] == b)
            if depth == 0:
                return k
        return None

    out, i = [], 0
    while i < len(code):
        if (code[i].isalpha() or code[i] == "_") and (i == 0 or not (code[i - 1].isalnum() or code[i - 1] == "_")):
            j = i
            while j < len(code) and (code[j].isalnum() or code[j] == "_"):
                j += 1
            k = j
            while k < len(code) and code[k].isspace():
                k += 1
            if k < len(code) and code[k] == "(" and code[i:j] not in C.CONTROL and (close := match(k, "(", ")")) is not None:
                b = close + 1
                while b < len(code) and code[b].isspace():
                    b += 1
                if b < len(code) and code[b] == "{" and (end := match(b, "{", "}")) is not None:
                    first = max(code.rfind(c, 0, i) for c in ";{}") + 1
                    out.append((code[i:j], source[first : end + 1].strip()))
            i = j
        else:
            i += 1
    return out


PIECES = ["int f(int a)", " {", "}", "}\n", ";", "g(", ")", "/* } */", "// {\n", '"{\\""', "'}'", "if (x)", "void h ( void )\n", "return f(1);", "\n", "#define X(a) { a }\n", "'", '"', "/*", "struct s {", "\\"]


@pytest.mark.parametrize("seed", range(60))
def test_definitions(seed):
    rng = random.Random(seed)
    source = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 50)))
    assert [(n, source[a:z]) for n, a, z in C.definitions(source)] == plain(source)


def test_functions_and_names(spark):
    source = 'int f(void);\nint f(void) { return "}"[0]; }\nint f(int x) { return f(); }\nint g(void) { if (f()) { return 1; } return 0; }\n'
    rows = spark.createDataFrame([(1, source), (2, None), (3, "int f(")], "id int, t string")
    assert sorted(tuple(r) for r in C.functions(rows, "id", "t").collect()) == [
        (1, "f", 1, 'int f(void) { return "}"[0]; }'), (1, "f", 2, "int f(int x) { return f(); }"), (1, "g", 1, "int g(void) { if (f()) { return 1; } return 0; }")]
    only = spark.createDataFrame([(1, "g")], "id int, name string")
    assert [r.name for r in C.functions(rows, "id", "t", only).collect()] == ["g"]


def test_macros(spark):
    source = "#define LIMIT 3\n  #  define  MAX( a,b ) \\\n   ((a) > (b) \\\r\n ? (a) : (b))\n#undef LIMIT\n#define 9bad 1\n#defined NO\nint x; #define no\n#define EMPTY\n"
    got = C.macros(spark.createDataFrame([(1, source), (2, None)], "id int, t string"), "id", "t").collect()
    assert [(r.name, r.definition) for r in got] == [("LIMIT", "#define LIMIT 3"), ("MAX", "#define MAX( a,b ) ((a) > (b) ? (a) : (b))"), ("EMPTY", "#define EMPTY")]


def test_cards_from_a_folder(spark, tmp_path):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def put(folder, name, body, damaged=False, **meta):
        (tmp_path / folder).mkdir(exist_ok=True)
        front = {k: v if isinstance(v, str) else json.dumps(v) for k, v in meta.items()} | {"sha256": sha(body)}
        (tmp_path / folder / name).write_text(f"---\n{json.dumps(front)}\n---\n{body}{'x' if damaged else ''}")

    put("drafts", "1.md", "old", id="a", status="draft")
    put("cards", "1.md", "new", id="a", status="approved", publication_op_id="p1", anchors=[{"usr": "u1", "relation": None}, {"usr": "u2", "active": 0}], reviews=[{"action": "approve", "reviewer": "r"}])
    put("cards", "2.md", "changed later", id="b", status="approved", publication_op_id="p2")
    put("cards", "3.md", "never published", id="c", status="stale")
    put("drafts", "4.md", "first", id="d", status="draft")
    put("drafts", "5.md", "second", id="d", status="pending")
    put("cards", "6.md", "twice", id="e", status="draft")
    put("cards", "7.md", "twice too", id="e", status="draft")
    put("drafts", "8.md", "torn", damaged=True, id="f", status="draft")
    put("drafts", "9.md", "nobody", status="draft")
    journal = spark.createDataFrame([("p1", "committed", "cards/1.md", sha("new")), ("p2", "committed", "cards/2.md", sha("as published")), ("p3", "prepared", "cards/3.md", sha("x"))], "op string, state string, path string, sha string")
    files = cards.read_cards(spark, str(tmp_path))
    got = {r.path: (r.id, r.status, r.state, r.fault) for r in cards.rebuild(files, journal).collect()}
    assert got == {
        "drafts/1.md": ("a", "draft", "shadowed", None), "cards/1.md": ("a", "approved", "card", None), "cards/2.md": ("b", "approved", "quarantine", "differs_from_journal"),
        "cards/3.md": ("c", "pending", "card", None), "drafts/4.md": ("d", "draft", "shadowed", None), "drafts/5.md": ("d", "pending", "card", None),
        "cards/6.md": ("e", "draft", "quarantine", "duplicate_canonical_id"), "cards/7.md": ("e", "draft", "quarantine", "duplicate_canonical_id"),
        "drafts/8.md": ("f", "draft", "quarantine", "corrupt"), "drafts/9.md": (None, "draft", "quarantine", "missing_id")}
    anchors = cards.listed(files, "anchors")
    definitions = spark.createDataFrame([("u1", 11), ("u2", 12)], "usr string, node int")
    assert [tuple(r) for r in cards.links(anchors, definitions).collect()] == [("a", 11, "explains", "certain")]
    assert [r.action for r in cards.listed(files, "reviews").collect()] == ["approve"]
