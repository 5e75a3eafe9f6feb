"""Tags and scenario information derived from titles, texts and paths."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACES, any_match, basename, java, lines, literal_contains, strip
from ..plugins import ChatClient
from ..rules import ENTITY_PATTERN, ENTITY_STOP, POINT_PATTERNS, RULE_PATTERNS, SCENARIO_METADATA, SCENARIO_SKIPPED, SCENARIO_WORDS, SECTION_NUMBER, TITLE_WORDS


def name_version_tag(source: Column, version: Column) -> Column:
    """File stem, '_V' and the version, with '/' and ':' as '-'; null without a source."""
    stem = F.regexp_replace(basename(source), r"(?<=.)\.[^.]*$", "")
    tag = F.when(version.isNotNull() & (version != ""), F.concat(stem, F.lit("_V"), version)).otherwise(stem)
    return F.translate(tag, "/:", "--")


def title_tags(title: Column) -> Column:
    """The title words a title contains; null without a title."""
    return F.when(title.isNotNull(), F.filter(F.array(*map(F.lit, TITLE_WORDS)), lambda w: F.contains(title, w)))


def intro_tags(text: Column, most: int = 3) -> Column:
    """The first words of at least two characters in the first five lines; anything but word characters parts words."""
    intro = F.array_join(F.slice(lines(text), 1, 5), "\n")
    words = F.split(strip(F.regexp_replace(intro, f"(?U)[^\\w{SPACES}一-鿿]", " ")), f"[{SPACES}]+")
    return F.slice(F.filter(words, lambda w: F.length(w) >= 2), 1, most)


def level_tag(level: Column) -> Column:
    return F.when(level == 1, "chapter").when(level == 2, "section").when(level == 3, "subsection")


def tags(source: Column, version: Column, title: Column, text: Column, level: Column) -> Column:
    """Union of all tags, sorted, without nulls."""
    none = F.array().cast("array<string>")
    every = F.concat(F.array(name_version_tag(source, version), level_tag(level)), F.coalesce(title_tags(title), none), F.coalesce(intro_tags(text), none))
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: t.isNotNull() & (t != ""))))


def module_name(source: Column) -> Column:
    """Parent folder of a file; the stem's first part where that is 'docs' or missing."""
    parts = F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/")
    first = F.split(F.element_at(parts, -1), r"\.")[0]
    parent = F.when(F.size(parts) >= 2, F.element_at(parts, F.greatest(F.lit(-2), -F.size(parts))))
    return F.when(source.isNull() | (source == ""), "未知模块").when(parent != "docs", parent).when(parent.isNotNull(), first).otherwise(F.split(source, r"\.")[0])


def scenario_type(text: Column) -> Column:
    """The type with most of its words present; ties settle in the order positive, negative, boundary."""
    p, n, b = (literal_contains(text, SCENARIO_WORDS[k]) for k in ("positive", "negative", "boundary"))
    top = F.greatest(p, n, b)
    return F.when(text.isNull(), None).when(top == p, "positive").when(top == n, "negative").otherwise("boundary")


def _extracted(text: Column, patterns, least: int, most: int, cap: int) -> Column:
    found = F.concat(*[F.regexp_extract_all(text, F.lit(java(p)), F.lit(0)) for p in patterns])
    return F.slice(F.array_distinct(F.filter(F.transform(found, strip), lambda x: (F.length(x) > least) & (F.length(x) < most))), 1, cap)


def rules(text: Column) -> Column:
    """Conditional sentences of 11 to 199 characters, first seen first, at most 10 a text."""
    return _extracted(text, RULE_PATTERNS, 10, 200, 10)


def test_points(text: Column) -> Column:
    """Sentences on what to check, of 6 to 99 characters, at most 10 a text."""
    return _extracted(text, POINT_PATTERNS, 5, 100, 10)


def entities(text: Column) -> Column:
    """table.field references, sorted, at most 20 a text; the field isn't one of a few common words."""
    # Only a run's first letter can start a match, so long runs are looked at once.
    found = F.regexp_extract_all(F.lower(text), F.lit("(?<![a-z_][0-9]{0,50})" + ENTITY_PATTERN), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: ~F.split(x, r"\.")[1].isin(*ENTITY_STOP)))), 1, 20)


def scenario(text: Column) -> Column:
    return F.struct(scenario_type(text).alias("scenario_type"), rules(text).alias("rules"), entities(text).alias("entities"), test_points(text).alias("test_points"))


def scenario_kept(title: Column, body: Column) -> Column:
    """Does a section hold a scenario? Not by its title, a body under 50 characters, or three metadata lines in its first five."""
    meta = F.size(F.filter(F.slice(lines(body), 1, 5), lambda x: any_match(strip(x), SCENARIO_METADATA)))
    return ~(any_match(title, SCENARIO_SKIPPED) | (F.length(strip(body)) < 50) | (meta >= 3))


def scenario_sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section_index, section_number, section_title, section) of sections numbered a.b.c.

    A number's white space may cross a newline, so headings are marked in the whole text first, then it is split."""
    head = "(?m)" + java(SECTION_NUMBER)
    mark = "\u0001"
    marked = F.regexp_replace(F.translate(F.col(text), mark, ""), head, f"{mark}$1{mark}$2{mark}")
    parts = F.split(marked, mark)
    n = F.floor((F.size(parts) - 1) / 3)
    cut = F.transform(F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))), lambda k: F.struct(parts[k * 3 + 1].alias("number"), strip(parts[k * 3 + 2]).alias("title"), strip(parts[k * 3 + 3]).alias("body")))
    rows = df.select(key, F.posexplode(cut).alias("section_index", "s"))
    return rows.select(key, "section_index", F.col("s.number").alias("section_number"), F.col("s.title").alias("section_title"), F.col("s.body").alias("section"))


def chat_tags(df: DataFrame, text: str, title: str, order: str, chat: ChatClient, every: int = 3, long: int = 500, most: int = 5) -> DataFrame:
    """df with chat_tags: up to `most` tags by a chat client, for every so manyth row that is long or has a title; a failing
    client gives none. Rows are asked for where they are."""

    def run(batches):
        for b in batches:
            out = []
            for t, h, n in zip(b.column(text).to_pylist(), b.column(title).to_pylist(), b.column(order).to_pylist(), strict=True):
                tags: list[str] = []
                if t and n % every == 0 and (len(t) > long or h):
                    try:
                        reply = chat.chat([{"role": "user", "content": f"Give three to five keywords for this text, parted by commas, nothing else:\n{t[:500]}"}])
                        tags = [x for x in (w.strip().strip(".,;:!?") for w in reply.split(",")) if x][:most]
                    except Exception:  # noqa: BLE001 - tags are an extra
                        pass
                out.append(tags)
            yield b.append_column("chat_tags", pa.array(out, pa.list_(pa.string())))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "chat_tags array<string>"])
    return df.mapInArrow(run, schema)
