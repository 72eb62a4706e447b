"""Questions enriched by a bilingual vocabulary, and parts of identifiers in questions and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a phrase of a question adds to it; words that are no identifier parts; parts that stand for an action; other forms of a part.
VOCABULARY = {
    "解析": "parse parser", "对象": "object", "数组": "array",
    "字符串": "string", "数字": "number", "字面量": "literal value",
    "序列化": "serialize serialization print output", "无格式": "unformatted",
    "输出": "output print", "缓冲区": "buffer", "增长": "grow allocate",
    "扩容": "grow resize reallocate ensure buffer", "内存": "memory allocate realloc",
    "比较": "compare", "递归": "recursive", "类型": "type",
    "大小写": "case sensitive", "查找": "get find lookup", "成员": "item member",
    "引用计数": "reference count ref", "释放": "free release",
    "链表": "chain list", "头部": "header head", "网络接口": "network interface netif",
    "默认接口": "default interface", "设置": "set", "切换": "set change",
    "发送队列": "send queue unsent", "应用数据": "application data",
    "限制": "limit available", "收包": "input receive packet",
    "调用": "call caller", "影响": "impact caller", "入口": "entry",
    "定义": "definition", "函数": "function",
    "serialization": "serialize print output buffer ensure reallocate",
    "serialize": "serialization print output buffer ensure reallocate",
    "grow": "resize reallocate ensure buffer",
}
STOP = (
    "the", "and", "for", "with", "where", "which", "what", "how", "function",
    "definition", "entry", "code", "source", "network", "interface", "output",
    "input", "change", "impact", "caller", "call", "json", "tcp", "parser",
)
ACTIONS = (
    "parse", "print", "serialize", "compare", "set", "get", "free", "release",
    "add", "remove", "ensure", "grow", "resize", "find", "lookup", "read", "write",
)
ALIASES = {"parser": "parse", "parsing": "parse", "parsed": "parse", "values": "value", "objects": "object", "arrays": "array"}


def enriched(text: Column | str, vocabulary: dict[str, str] = VOCABULARY) -> Column:
    """The question, followed by what its phrases add, in the order of the vocabulary."""
    text = F.col(text) if isinstance(text, str) else text
    return F.concat_ws(" ", text, *(F.when(text.contains(p), added) for p, added in vocabulary.items()))


def query_parts(text: Column | str) -> Column:
    """Sorted lower-case parts (two letters or more) of the identifiers in an enriched question, other forms added, stop words left out."""
    tokens = F.regexp_extract_all(enriched(text), F.lit("[A-Za-z][A-Za-z0-9_]*"), F.lit(0))
    split = F.split(F.lower(F.regexp_replace(F.array_join(tokens, " "), "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    parts = F.filter(split, lambda x: F.length(x) >= 2)
    other = F.array_compact(F.array(*(F.when(F.array_contains(parts, a), b) for a, b in ALIASES.items())))
    return F.array_sort(F.array_distinct(F.filter(F.concat(parts, other), lambda x: ~x.isin(*STOP))))


def expansion(text: Column | str) -> Column:
    """Sorted lower-case parts (three letters or more) of the identifiers of a text, blank-joined: what its index entry gets besides."""
    words = F.regexp_extract_all(text, F.lit(r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"), F.lit(0))
    split = F.split(F.regexp_replace(F.array_join(words, " "), "([a-z0-9])([A-Z])", "$1_$2"), "[_ ]+")
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(split, lambda x: F.length(x) >= 3), lambda x: F.lower(x)))), " ")
