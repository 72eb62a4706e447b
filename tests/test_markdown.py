"""Sections and pages of Markdown: exact joins, fences, mechanisms, oversized blocks, and a plain scanner."""

import random

import pytest

from heddle.operators import markdown as M


def plain_fences(lines):
    """Open marker before each line, written apart from the library."""
    mark, out = None, []
    for line in lines:
        out.append(mark)
        bare = line.rstrip("\r\n")
        lead = len(bare) - len(bare.lstrip(" "))
        body = bare[lead:]
        n = len(body) - len(body.lstrip(body[0])) if body and body[0] in "`~" else 0
        if lead <= 3 and n >= 3:
            if mark is None:
                mark = body[0] * n
            elif body[0] == mark[0] and n >= len(mark) and not body[n:].strip():
                mark = None
    return out


def random_text(seed):
    rng = random.Random(seed)
    lines = ["## One", "## Two  ", "text", "a sentence.", "  ", "", "- item", "2) second", "```", "```c", "~~~~", "~~~", "````", "    ```", "### deep", '<a id="mechanism-1"></a>', "完成。", "# top", "#### four", "ends.**", "##no"]
    return "".join(rng.choice(lines) + rng.choice(["\n", "\n", "\r\n"]) for _ in range(rng.randint(0, 60)))


@pytest.mark.parametrize("seed", range(40))
def test_sections_and_lossless_blocks(seed):
    text = random_text(seed)
    lines = text.splitlines(keepends=True)
    starts = [i for i, (line, m) in enumerate(zip(lines, plain_fences(lines))) if m is None and line.startswith("## ") and line[2:].strip()]
    want = [(lines[a][2:].strip(), "".join(lines[a + 1 : z]).strip()) for a, z in zip(starts, [*starts[1:], len(lines)])]
    assert M.sections(text) == want
    for _, body in want:
        parts = M.blocks(body)
        assert "".join(parts) == body
        edges = {sum(map(len, parts[:k])) for k in range(1, len(parts))}
        at = 0
        own = body.splitlines(keepends=True)
        for line, mark in zip(own, plain_fences(own)):
            assert mark is None or at not in edges  # never inside a fence
            at += len(line)


def test_where_blocks_end():
    assert M.blocks("One.\n\nTwo\n\nthree.\n\nFour") == ["One.\n\n", "Two\n\nthree.\n\n", "Four"]
    assert M.blocks("## H\n\nfirst.\n") == ["## H\n\nfirst.\n"]
    assert M.blocks("- a\n- b\n  more\n- c\n") == ["- a\n", "- b\n  more\n", "- c\n"]
    assert M.blocks("see\n```\na.\n\n- b\n```\n\nnext") == ["see\n```\na.\n\n- b\n```\n\n", "next"]
    a, b = '<a id="mechanism-x"></a>\n### X\nclaim.\n\ncondition.\n\n- bound\n', '<a id="mechanism-y"></a>\n### Y\nclaim.\n'
    assert M.blocks("intro.\n" + a + b) == ["intro.\n", a, b]
    assert M.blocks("### A\nx.\n\ny.\n### B\nz") == ["### A\nx.\n\ny.\n", "### B\nz"]


def test_pages_join_to_the_exact_text(spark):
    texts = {i: random_text(i) for i in range(60)} | {60: None, 61: "", 62: "no heading", 63: "## Empty\n\n", 64: "## Big\n" + "无断点" * 400 + "。\n\nAfter it.\n"}
    texts[65] = "## Flow\n" + "\n\n".join(f"完整条件 {i}：只有满足前提且指针有效，才能执行操作。" * 2 for i in range(50))
    rows = M.read_pages(spark.createDataFrame(list(texts.items()), "id int, md string").selectExpr("*", "1 AS page"), "id", "md", 150).persist()
    got = {}
    for r in rows.orderBy("id", "section", "block").collect():
        text = got.setdefault((r.id, r.section), [])
        assert r.offset == len("".join(text).encode())
        text.append(r.text)
    want = {(i, n): f"## {title}\n{body}" for i, t in texts.items() for n, (title, body) in enumerate(M.sections(t or "")) if body}
    assert {k: "".join(v) for k, v in got.items()} == want
    pages = M.page_texts(rows, "id").orderBy("id", "section", "page").collect()
    for key in want:
        own = [p for p in pages if (p.id, p.section) == key]
        assert [p.offset for p in own[1:]] + [None] == [p.next_offset for p in own]
        assert all(len(p.text.encode()) <= 450 for p in own)
    big = [p for p in pages if p.id == 64]
    assert [(p.oversize, p.text) for p in big] == [(True, ""), (False, "After it.")]
    assert big[0].required_budget == -(-len(got[64, 0][0].encode()) // 3)
    flow = [p for p in pages if p.id == 65]
    assert len(flow) > 1 and "".join(p.text for p in flow) == want[65, 0]
    rows.unpersist()
