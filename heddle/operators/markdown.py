"""Sections and pages of Markdown: level-two sections outside fences, blocks that stay whole, byte offsets, pages within a budget."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.text import short_id

MOST_BUDGET, BYTES_A_TOKEN = 8000, 3
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)")
TITLE = re.compile(r"##\s+(.+?)\s*$")
ENDS = re.compile(r"[.!?。！？][*_`]*$")
BARE_FENCE = re.compile(r" {0,3}(?:`{3,}|~{3,})\s*$")
#: What an unfenced line starts with.
ANCHOR, SUBHEADING, HEADING, BULLET = re.compile(r"<a\s+id=[\"']mechanism-"), re.compile(r"###\s+"), re.compile(r"#{2,6}\s+"), re.compile(r"(?:[-+*]|\d+[.)])\s+")


def fenced(lines: list[str]) -> Iterator[tuple[str, bool]]:
    """Each line, and whether it lies inside a fence; the opening line does not, the closing one does."""
    open_ = ""
    for line in lines:
        inside = bool(open_)
        mark = FENCE.fullmatch(line.rstrip("\r\n"))
        if mark and not open_:
            open_ = mark[1]
        elif mark and mark[1].startswith(open_) and not mark[2].strip():  # as long at least, of the same character
            open_ = ""
        yield line, inside


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) of the level-two sections; what stands before the first belongs to none."""
    found: list[tuple[str, list[str]]] = []
    for line, inside in fenced(text.splitlines(keepends=True)):
        title = None if inside else TITLE.match(line)
        if title:
            found.append((title[1], []))
        elif found:
            found[-1][1].append(line)
    return [(title, "".join(body).strip()) for title, body in found]


@dataclass
class Block:
    """What a block holds so far, and what the lines before the next one were."""

    filled: bool = False
    listed: bool = False
    mechanism: bool = False  # from the first anchor or level-three heading on, only these cut
    named: bool = False  # an anchor waits for its heading
    gap: bool = False
    ended: bool = False

    def cuts(self, line: str) -> bool:
        if not self.filled:
            return False
        if ANCHOR.match(line) or (SUBHEADING.match(line) and not self.named):
            return True
        if self.mechanism or not line.strip():
            return False
        return (self.gap and self.ended) or (self.listed and bool(BULLET.match(line)))

    def take(self, line: str) -> None:
        anchor, sub, words = bool(ANCHOR.match(line)), bool(SUBHEADING.match(line)), bool(line.strip())
        if anchor or sub:
            self.mechanism, self.named = True, anchor
        elif words:
            self.named = False
        self.gap = not words
        self.listed |= bool(BULLET.match(line))
        self.filled |= words and not anchor and not HEADING.match(line)


def blocks(text: str) -> list[str]:
    """Paragraphs, list entries, fences and mechanism entries, which joined give the text again.

    A heading stays with what follows; a blank line parts paragraphs only after a finished sentence or a fence.
    """
    out, state = [""], Block()
    for line, inside in fenced(text.splitlines(keepends=True)):
        if not inside:
            if state.cuts(line):
                out.append("")
                state.filled = state.listed = False
            state.take(line)
        if line.strip():
            state.ended = bool(ENDS.search(line.rstrip()) or BARE_FENCE.match(line))
        out[-1] += line
    return out


def paged(sizes: list[int], budget: int) -> list[int]:
    """The page of each block: a page is closed before the block that would overflow it; a larger block stands alone."""
    room, page, used, out = min(budget, MOST_BUDGET) * BYTES_A_TOKEN, 0, 0, []
    for n in sizes:
        if used and used + n > room:
            page, used = page + 1, 0
        used += n
        out.append(page)
    return out


SCHEMA = "section int, title string, block int, page int, size bigint, oversize boolean, required_budget bigint, text string"


def read_pages(rows: DataFrame, id_col: str, text_col: str, budget: int = 2000) -> DataFrame:
    """id_col, section, section_id, title, block, offset, size, page, oversize, required_budget, text: every block of every section that has a body.

    A section's text is its heading and its stripped body; `offset` is a block's first byte in it, so offsets of pages
    are those of their first blocks. A block over the budget is flagged, never cut, with the budget it needs.
    Null texts have no sections. A section's blocks come from one row, so a row is the most a task holds.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room = min(budget, MOST_BUDGET) * BYTES_A_TOKEN
        for b in batches:
            for key, text in zip(b.column(0), b.column(1).to_pylist()):
                for n, (title, body) in enumerate(sections(text or "")):
                    if not body:
                        continue
                    parts = blocks(f"## {title.strip()}\n{body}")
                    sizes = [len(p.encode()) for p in parts]
                    cols = [pa.array([x] * len(parts), t) for x, t in ((key.as_py(), b.column(0).type), (n, pa.int32()), (title.strip(), pa.string()))]
                    cols += [pa.array(range(len(parts)), pa.int32()), pa.array(paged(sizes, budget), pa.int32()), pa.array(sizes, pa.int64()), pa.array([s > room for s in sizes]), pa.array([-(-s // BYTES_A_TOKEN) for s in sizes], pa.int64()), pa.array(parts)]
                    yield pa.RecordBatch.from_arrays(cols, [id_col, "section", "title", "block", "page", "size", "oversize", "required_budget", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    each = rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {SCHEMA}")
    before = F.sum("size").over(Window.partitionBy(id_col, "section").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("offset", F.coalesce(before, F.lit(0))).withColumn("section_id", short_id(F.col(id_col).cast("string"), "title", size=16))


def outline(blocks_: DataFrame, id_col: str) -> DataFrame:
    """id_col, section, section_id, title, n_pages, n_bytes: what can be read, from the blocks of `read_pages`."""
    return blocks_.groupBy(id_col, "section", "section_id", "title").agg((F.max("page") + 1).cast("bigint").alias("n_pages"), F.sum("size").alias("n_bytes"), F.max("oversize").alias("oversize"))


def page_texts(blocks_: DataFrame, id_col: str) -> DataFrame:
    """id_col, section, page, offset, next_offset (null at the end), text, oversize, required_budget: what one read returns; an oversize page has no text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "")  # bounded by the budget, or one block
    pages = blocks_.groupBy(id_col, "section", "page").agg(F.min("offset").alias("offset"), F.sum("size").alias("size"), F.max("oversize").alias("oversize"), F.max("required_budget").alias("need"), text.alias("text"))
    last = F.max("page").over(Window.partitionBy(id_col, "section"))
    return pages.select(id_col, "section", "page", "offset", F.when(F.col("page") < last, F.col("offset") + F.col("size")).alias("next_offset"),
                        F.when(~F.col("oversize"), F.col("text")).otherwise("").alias("text"), "oversize", F.when(F.col("oversize"), F.col("need")).alias("required_budget"))
