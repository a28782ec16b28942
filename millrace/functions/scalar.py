"""Scalar functions as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode blanks as Python's ``str.split`` sees them; Java's class lacks four of them.
BLANKS = r"[\s\x1c-\x1f\x85   -     　]+"
TRUNCATED = "\n<truncated_content>"


def sha256_hex(c: Column) -> Column:
    """SHA-256 of the text in UTF-8, lower-case hex."""
    return F.sha2(c, 256)


@F.pandas_udf(T.StringType())
def compact_number(n: pd.Series) -> pd.Series:
    """Short form of a count: one decimal at most, then K, M or B.

    Half steps round by the exact binary value, which none of the built-in formatters do.
    """

    def short(x) -> str | None:
        if pd.isna(x):
            return None
        for size, unit in ((10**9, "B"), (10**6, "M"), (10**3, "K")):
            if x >= size:
                whole, _, tenth = f"{int(x) / size:.1f}".partition(".")
                return whole + (f".{tenth}" if tenth != "0" else "") + unit
        return str(int(x))

    return n.map(short)


@F.pandas_udf(T.StringType())
def template_prefix(template: pd.Series) -> pd.Series:
    """What all prompts of a template begin with."""
    from millrace.plans.template import PromptTemplate

    return template.map(lambda t: None if t is None else PromptTemplate.parse(t).prefix)


def in_range(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive range test; a missing bound does not bind."""
    above = c >= F.lit(low) if low is not None else F.lit(True)
    return above & (c <= F.lit(high)) if high is not None else above


def length_in_range(c: Column, low: int | None = None, high: int | None = None) -> Column:
    return in_range(F.length(c), low, high)


def n_words(c: Column) -> Column:
    """Number of blank-separated words."""
    words = lambda blanks: F.regexp_count(c, F.lit(f"[^{blanks}]++"))
    # The short list of blanks is several times faster, and all that a text in ASCII can hold.
    return F.when(F.octet_length(c) == F.length(c), words(r" \t\n\x0b\f\r\x1c\x1d\x1e\x1f")).otherwise(words(BLANKS[1:-2])).cast("long")


def n_occurrences(c: Column, what: str) -> Column:
    """Non-overlapping occurrences of a fixed string."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)).cast("long")


def is_stub(c: Column, marker: str) -> Column:
    return F.contains(F.lower(c), F.lit(marker.lower()))


def passes_quality(text: Column, sentences: int = 3, words: tuple[int, int] = (30, 24_000), chars: tuple[int, int] = (200, 72_000)) -> Column:
    """Enough sentence ends, and word and character counts strictly inside their bounds."""
    ends = n_occurrences(F.concat(text, F.lit(" ")), ". ")
    # The number of words is bound to a variable, so it is counted once, for texts that pass the rest.
    counted = F.exists(F.array(n_words(text)), lambda n: (n > words[0]) & (n < words[1]))
    return (F.length(text) > chars[0]) & (F.length(text) < chars[1]) & (ends >= sentences) & counted


def title_starts_with(title: Column, prefix: str) -> Column:
    return F.startswith(F.lower(title), F.lit(prefix.lower()))


def truncate(c: Column, n: int, marker: str = "") -> Column:
    """First n characters, with a marker if something was cut; 0 keeps all."""
    return c if n <= 0 else F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(marker))).otherwise(c)


def json_text_length(c: Column) -> Column:
    """Length of a string inside ASCII JSON: quotes, backslashes and short escapes take 2 characters, others 6 or 12."""

    def added(special: Column) -> Column:
        """Further characters of those that are not written as they are."""
        short = F.length(F.regexp_replace(special, r'[^"\\\x08\x0c\n\r\t]++', ""))
        wide = (F.octet_length(F.encode(special, "UTF-16BE")) / 2).cast("int") - F.length(special)
        return 5 * F.length(special) - 4 * short + 6 * wide

    # Runs of plain characters go first, so that the rest is short.
    return F.length(c) + F.transform(F.array(F.regexp_replace(c, r"[ !#-\[\]-~]++", "")), added)[0]


def prompt_length(messages: Column) -> Column:
    """Length of the messages as ASCII JSON with ``", "`` and ``": "`` between items.

    Each message has 2 braces, its keys "role" and "content" with separators (23
    characters) and 4 quotes; brackets and separators of the list add 2 for each message.
    """
    each = F.transform(messages, lambda m: json_text_length(m["role"]) + json_text_length(m["content"]) + 27)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) + 2 * F.greatest(F.size(messages), F.lit(1))


def catalog(code: Column, description: Column, order: Column, intro: str = "") -> Column:
    """Aggregate: bullet list of codes and descriptions in order, under an optional introduction."""
    line = F.concat(F.lit("- `"), code, F.lit("` — "), description)
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"])
    return F.concat(F.lit(intro.strip() + "\n" if intro.strip() else ""), F.array_join(lines, "\n"))


def split_system(messages: Column) -> Column:
    """Struct of the other messages and the system text, whose message must be single and first if there is one."""
    system = F.filter(messages, lambda m: m["role"] == "system")
    rest = F.filter(messages, lambda m: m["role"] != "system")
    good = (F.size(system) == 0) | ((F.size(system) == 1) & (messages[0]["role"] == "system"))
    text = F.when(F.size(system) == 1, system[0]["content"])
    return F.struct(rest.alias("messages"), F.when(good, text).alias("system"), good.alias("valid"))


def join_text_blocks(blocks: Column) -> Column:
    """Texts of the blocks of type text, one a line, without blanks at either end."""
    texts = F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"])
    return F.trim(F.array_join(texts, "\n"))


#: Stop reasons that count as a finished answer.
FINISHED = {"openai": ("stop",), "claude": ("end_turn", "stop_sequence"), "vllm_offline": ("stop",)}
#: Providers for which a missing stop reason counts as finished.
MAY_BE_MISSING = ("claude", "vllm_offline")


def is_finished(provider: str, reason: Column) -> Column:
    """Whether a stop reason counts as a finished answer for a provider."""
    return F.coalesce(reason.isin(*FINISHED[provider]), F.lit(provider in MAY_BE_MISSING))


def sections(text: Column) -> Column:
    """Sections below level-2 headings as array of (heading, text, index).

    Lines of level-1 headings do not count. What stands before the first heading and the
    first section's own lines are left out, and sections without lines are counted only.
    """
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: ~F.startswith(x, F.lit("# ")))
    state = "struct<i:int,heading:string,lines:array<string>,done:array<struct<heading:string,text:string,index:int>>>"
    start = F.struct(F.lit(-1).alias("i"), F.lit("").alias("heading"), F.array().cast("array<string>").alias("lines"), F.array().cast("array<struct<heading:string,text:string,index:int>>").alias("done")).cast(state)
    closed = lambda s: F.when(F.size(s["lines"]) > 0, F.concat(s["done"], F.array(F.struct(s["heading"].alias("heading"), F.array_join(s["lines"], "\n").alias("text"), s["i"].alias("index"))))).otherwise(s["done"])

    def step(s: Column, line: Column) -> Column:
        opened = F.struct((s["i"] + 1).alias("i"), F.trim(F.substring(line, F.lit(4), F.length(line))).alias("heading"), F.array().cast("array<string>").alias("lines"), closed(s).alias("done"))
        # The last line of a text that ends in a line break is no line.
        taken = F.when(s["i"] > 0, F.concat(s["lines"], F.array(line))).otherwise(s["lines"])
        added = F.struct(s["i"].alias("i"), s["heading"].alias("heading"), taken.alias("lines"), s["done"].alias("done"))
        return F.when(F.startswith(line, F.lit("## ")), opened).otherwise(added).cast(state)

    ends = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.aggregate(ends, start, step, closed)
