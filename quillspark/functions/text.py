"""Text functions as column expressions: no Python runs on the executors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

KEYWORD = "[\\u4e00-\\u9fff]{2,}|[A-Za-z0-9_]{2,}"
TERM = "[\\u4e00-\\u9fff]|[a-z0-9_]+"
#: The characters that number a heading, its units, what may stand before the
#: first marker of a line, what may follow a marker, and what is stripped off a segment.
NUMERAL = "0-9零一二三四五六七八九十百千万两〇"
UNITS = "篇集章"
BEFORE = " \t\n\r\u3000\"“”‘’《》【】[]()（）-"
AFTER = " \t\u3000\n\r-—~·•|/（）()[]【】《》<>:：,，.。!?！？;；\"“”'‘’第"
STRIPPED = " \u3000-—~·•|/（）()[]【】《》<>"
HEADING = f"第[{NUMERAL}]+[{UNITS}]"


def any_of(characters: str, negated: bool = False) -> str:
    """A class of characters for a pattern."""
    return "[" + "^" * negated + "".join("\\" + c if c in "\\[]^-&~" else c for c in characters) + "]"


def normalize_line(line: Column) -> Column:
    """Trimmed, runs of Unicode white space as one space."""
    return F.regexp_replace(F.regexp_replace(line, "(?U)[\\s\\x1c-\\x1f]+", " "), "^ | $", "")


def is_heading(line: Column, max_chars: int = 40) -> Column:
    """A short line that opens with a numbered marker, each marker followed by a separator."""
    line = normalize_line(line)
    shape, stray = f"^{any_of(BEFORE)}*{HEADING}", f"{HEADING}{any_of(AFTER, True)}"
    return (F.length(line) > 0) & (F.length(line) <= max_chars) & line.rlike(shape) & ~line.rlike(stray)


def heading_segments(line: Column) -> Column:
    """The parts of a heading line, one for each marker, without separators at their ends."""
    parts = F.filter(F.split(normalize_line(line), f"(?={HEADING})"), lambda x: x.rlike(f"^{HEADING}"))
    return F.transform(parts, lambda x: F.regexp_replace(x, f"^{any_of(STRIPPED)}+|{any_of(STRIPPED)}+$", ""))


def sentences(text: Column, delimiters: str = "。！？\\n") -> Column:
    """Sentences with their delimiters, trimmed, the tail kept, none empty."""
    parts = F.regexp_extract_all(text, F.lit(f"[^{delimiters}]*[{delimiters}]+|[^{delimiters}]+$"), F.lit(0))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", "")), lambda x: x != "")


def terms(text: Column) -> Column:
    """Index terms: single CJK characters and lower-case word runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def keywords(text: Column, most: int = 8) -> Column:
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(KEYWORD), F.lit(0))), 1, most)


def entity_keywords(entities: Column, text: Column, user: str, most: int = 8) -> Column:
    """The usable entities if there are any, else the keywords of the text."""
    usable = F.array_distinct(F.filter(F.transform(entities, lambda x: F.trim(x)), lambda x: (x != "") & (x != user)))
    return F.when(F.size(usable) > 0, F.slice(usable, 1, most)).otherwise(keywords(text, most))


def json_block(text: Column) -> Column:
    """The fenced block of a model's answer, else the span from first { to last }."""
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    bare = F.regexp_extract(text, "(?s)\\{.*\\}", 0)
    return F.when(fenced != "", fenced).when(bare != "", bare)


GRAPH = "nodes array<struct<id:string,type:string,description:string>>, edges array<struct<source:string,target:string,relation:string,description:string>>"


def parse_graph(text: Column, unknown: str = "未知") -> Column:
    """Tolerant parse to nodes (with an id, type defaulted) and edges (with all ends)."""
    raw = F.from_json(json_block(text), GRAPH)
    blank = lambda c: F.coalesce(F.trim(c), F.lit(""))
    nodes = F.transform(
        F.filter(F.coalesce(raw["nodes"], F.array().cast("array<struct<id:string,type:string,description:string>>")), lambda n: blank(n["id"]) != ""),
        lambda n: F.struct(F.trim(n["id"]).alias("id"), F.coalesce(F.nullif(blank(n["type"]), F.lit("")), F.lit(unknown)).alias("type"), blank(n["description"]).alias("description")),
    )
    edges = F.filter(
        F.coalesce(raw["edges"], F.array().cast("array<struct<source:string,target:string,relation:string,description:string>>")),
        lambda e: (blank(e["source"]) != "") & (blank(e["target"]) != "") & (blank(e["relation"]) != ""),
    )
    return F.struct(nodes.alias("nodes"), edges.alias("edges"))


#: Answers that stand for no summary, and words of answers that decline one.
NO_SUMMARY = ["无", "暂无", "无内容", "空", "空字符串", "none", "null", "n/a", "na", "skip", "无有效信息", "纯闲聊"]
DECLINED = ["闲聊", "无需记录", "不需要记录", "跳过", "无长期记忆价值"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_summary(text: Column, most: int = 4) -> Column:
    """Wrapping quotes off, white space collapsed, then the first `most` sentences that
    differ by more than white space, as they stood. Null or blank: empty."""
    space = lambda c, by: F.regexp_replace(c, "(?U)\\s+", by)
    bare = F.regexp_replace(F.trim(space(F.coalesce(text, F.lit("")), " ")), "^[\"'`“”‘’]+|[\"'`“”‘’]+$", "")
    parts = F.regexp_extract_all(F.trim(bare), F.lit("[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+$"), F.lit(0))
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    first = lambda p, keys: F.filter(p, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
    firsts = bound(parts, lambda p: bound(F.transform(p, lambda x: space(x, "")), lambda keys: first(p, keys)))
    return F.array_join(F.slice(firsts, 1, most), "")


def no_memory(summary: Column) -> Column:
    """Whether a cleaned summary is blank, a marker of emptiness or a refusal."""
    declined = F.lit(False)
    for word in DECLINED:
        declined = declined | summary.contains(word)
    return (F.coalesce(summary, F.lit("")) == "") | F.lower(summary).isin(*NO_SUMMARY) | declined


def relation_name(text: Column) -> Column:
    """Letters, digits and underscores; RELATED_TO where none is left."""
    return F.coalesce(F.nullif(F.regexp_replace(text, "[^\\p{L}\\p{N}_]", ""), F.lit("")), F.lit("RELATED_TO"))


def sanitize_message(text: Column) -> Column:
    """Mentions removed, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "@_user_\\d+|@ou_[A-Za-z0-9]+", ""), "(?U)\\s+", " "))


def message_text(content: Column) -> Column:
    """The text field of a JSON object ('' without one), any other content as it is."""
    is_object = F.get_json_object(content, "$").startswith("{")
    return F.when(F.coalesce(is_object, F.lit(False)), F.coalesce(F.get_json_object(content, "$.text"), F.lit(""))).otherwise(content)


def join_ordered(order: Column, text: Column, separator: str) -> Column:
    """Aggregate: texts joined in the given order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda s: s["t"]), separator)


#: One token: a CJK character, a run of other letters and digits, or any other character that is no space.
TOKEN = "[\\u4e00-\\u9fff]|[A-Za-z0-9_]+|[^\\sA-Za-z0-9_\\u4e00-\\u9fff]"


def token_length(text: Column) -> Column:
    """Tokens by a fixed rule, the last of the counters of assist.token_lengths()."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")


def to_double(value: Column) -> Column:
    """A number, 0.0 where there is none."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0))


def answer_text(content: Column) -> Column:
    """The text of a model's answer: a JSON list of parts (strings, or objects with a text), an
    object with content or, without any, reasoning_content; any other text as it is."""
    parts = F.from_json(content, "array<string>")
    texts = F.transform(parts, lambda x: F.coalesce(F.get_json_object(x, "$.text"), F.when(x.startswith("{"), F.lit("")).otherwise(x)))
    whole = F.coalesce(F.nullif(F.trim(F.get_json_object(content, "$.content")), F.lit("")), F.get_json_object(content, "$.reasoning_content"), F.lit(""))
    start = F.trim(content)
    return F.trim(F.when(start.startswith("["), F.coalesce(F.array_join(texts, ""), content)).when(start.startswith("{"), whole).otherwise(F.coalesce(content, F.lit(""))))


#: Texts that stand for a summary that could not be made.
FAILED = ("无法生成", "生成失败", "内容缺失")


def failed_summary(summary: Column) -> Column:
    """Blank, or a stand-in for a summary."""
    found = F.trim(F.coalesce(summary, F.lit(""))) == ""
    for text in FAILED:
        found = found | F.coalesce(summary, F.lit("")).contains(text)
    return found


def event_id(*columns: Column) -> Column:
    """An id of a turn, the same for equal columns."""
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("\u001f", *columns), 256), 1, 8))


def contexts(text: Column, separator: str = "\n---\n") -> Column:
    """The blocks of a retrieved text that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))), lambda x: x != "")
