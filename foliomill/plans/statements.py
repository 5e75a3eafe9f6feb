"""DuckDB statements of the queries with sections, state machines and extractions: windows and recursive expressions over lines."""

from __future__ import annotations

from ..functions.text import SPACES
from ..rules import (
    APPROVAL_STARTS, METADATA_LINES, PAGE_LINES, POINT_PATTERNS, REAL_HEADINGS, RULE_PATTERNS, SCENARIO_METADATA, SCENARIO_SKIPPED, SCENARIO_WORDS, SECTION_NUMBER, SEPARATORS, TITLE_WORDS, TOC_ENTRIES, TOC_LINES, TOC_STARTS,
    WATERMARK_LINES, WORD_HEADINGS,
)

W = f"[{SPACES}]"


def pattern(p: str) -> str:
    """A pattern with Unicode digits and white space, quoted."""
    out = p.replace(r"[\s", f"[{SPACES}").replace(r"\s", W).replace(r"\d", r"\p{Nd}")
    return "'" + out.replace("'", "''") + "'"


def any_of(c: str, patterns) -> str:
    return f"regexp_matches({c}, {pattern('(?:' + '|'.join(patterns) + ')')})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


LINES = "SELECT record_id, i, a[i] AS line FROM (SELECT record_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT record_id, string_split(page_content, chr(10)) AS a FROM kb_document WHERE page_content IS NOT NULL))"


def flagged(src: str) -> str:
    """Lines (record_id, i, line) with what each is by itself."""
    kinds = {"meta": METADATA_LINES, "head": REAL_HEADINGS, "tocs": TOC_STARTS, "entry": TOC_ENTRIES, "appr": APPROVAL_STARTS, "rule": SEPARATORS, "page": PAGE_LINES, "mark": WATERMARK_LINES}
    return f"SELECT *, x = '' AS blank, {', '.join(f'{any_of("x", p)} AS {k}' for k, p in kinds.items())}, starts_with(x, '|') AS bar, starts_with(x, '|') AND ends_with(x, '|') AS rowl, contains(x, '---') AS dashes FROM (SELECT record_id, i, line, {strip('line')} AS x FROM {src})"


# State machines: fields with first values, the new value of each, and whether a line stays.
META_OUT = "(s.skip AND NOT x.meta AND ((x.blank AND s.blanks >= 1) OR (NOT x.blank AND x.head)))"
TOC_OUT = f"(s.toc AND (s.n + 1 > {TOC_LINES} OR (NOT x.blank AND NOT x.entry)))"
SEP_KEPT = "(x.rowl OR (s.tab AND (x.bar OR x.dashes)))"
MACHINES = {
    "metadata": (
        {"skip": "false", "blanks": "0"},
        {"skip": f"CASE WHEN x.meta THEN true WHEN {META_OUT} THEN false ELSE s.skip END", "blanks": f"CASE WHEN x.meta OR {META_OUT} THEN 0 WHEN s.skip AND x.blank THEN s.blanks + 1 ELSE s.blanks END"},
        f"NOT x.meta AND (NOT s.skip OR {META_OUT})",
    ),
    "toc": (
        {"toc": "false", "n": "0"},
        {"toc": f"(NOT s.toc AND x.tocs) OR (s.toc AND NOT {TOC_OUT})", "n": "CASE WHEN s.toc THEN s.n + 1 ELSE 0 END"},
        f"(NOT s.toc AND NOT x.tocs) OR {TOC_OUT}",
    ),
    "approval": ({"ap": "false"}, {"ap": "CASE WHEN x.appr THEN true WHEN x.head THEN false ELSE s.ap END"}, "NOT (CASE WHEN x.appr THEN true WHEN x.head THEN false ELSE s.ap END)"),
    "separators": (
        {"tab": "false"},
        {"tab": f"CASE WHEN {SEP_KEPT} THEN true WHEN s.tab AND NOT x.blank AND NOT x.bar THEN false ELSE s.tab END"},
        f"{SEP_KEPT} OR NOT x.rule",
    ),
}


def machine(name: str, src: str, out: str) -> str:
    """Expressions of a state machine over lines in src, those kept in out, numbered anew."""
    first, new, keep = MACHINES[name]
    return (
        f"{out}_s AS (SELECT DISTINCT record_id, CAST(0 AS BIGINT) AS i, {', '.join(f'{v} AS {k}' for k, v in first.items())}, false AS keep FROM {src} "
        f"UNION ALL SELECT s.record_id, x.i, {', '.join(new[k] for k in first)}, {keep} FROM {out}_s s JOIN {src} x ON x.record_id = s.record_id AND x.i = s.i + 1), "
        f"{out} AS MATERIALIZED (SELECT x.* REPLACE (row_number() OVER (PARTITION BY x.record_id ORDER BY x.i) AS i) FROM {out}_s s JOIN {src} x USING (record_id, i) WHERE s.keep)"
    )


def whole(lines: str) -> str:
    """Texts of the lines; one that no line is left of is empty, not missing."""
    return f"SELECT k.record_id, CASE WHEN k.page_content IS NOT NULL THEN coalesce(t.text, '') END AS text FROM kb_document k LEFT JOIN (SELECT record_id, string_agg(line, chr(10) ORDER BY i) AS text FROM {lines} GROUP BY 1) t USING (record_id)"


def region(name: str) -> str:
    return f"WITH RECURSIVE l0 AS MATERIALIZED ({flagged(f'({LINES})')}), {machine(name, 'l0', 'l1')} {whole('l1')}"


def normalised(c: str) -> str:
    return f"regexp_replace(array_to_string(list_transform(string_split(regexp_replace(replace(replace({c}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: {strip('x')}), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g')"


def sections(which: str, head: str, level: str, title: str) -> str:
    return (
        f"WITH h AS (SELECT *, {head} AS head, {level} AS lvl, {title} AS ttl FROM (SELECT l.*, {strip('line')} AS s FROM ({LINES}) l JOIN kb_document k USING (record_id) WHERE {which})), "
        "g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY record_id ORDER BY i) AS sec FROM h), "
        "f AS (SELECT record_id, sec, max(CASE WHEN head THEN lvl END) AS lvl, max(CASE WHEN head THEN ttl END) AS ttl, string_agg(line, chr(10) ORDER BY i) AS body FROM g GROUP BY 1, 2) "
        f"SELECT record_id, CAST(sec - CASE WHEN record_id IN (SELECT record_id FROM g WHERE sec = 0) THEN 0 ELSE 1 END AS INT) AS section_index, CAST(coalesce(lvl, 0) AS INT) AS section_level, coalesce(ttl, '') AS section_title, {strip('body')} AS section FROM f WHERE {strip('body')} <> ''"
    )


def extracted(patterns, least: int, most: int, name: str) -> str:
    every = f"list_concat({', '.join(f'regexp_extract_all(page_content, {pattern(p)})' for p in patterns[:2])})"
    for p in patterns[2:]:
        every = f"list_concat({every}, regexp_extract_all(page_content, {pattern(p)}))"
    return (
        f"WITH f AS (SELECT record_id, {every} AS a FROM kb_document WHERE page_content IS NOT NULL), u AS (SELECT record_id, i, {strip('a[i]')} AS r FROM (SELECT record_id, a, unnest(generate_series(1, len(a))) AS i FROM f)), "
        f"d AS (SELECT record_id, r, min(i) AS i FROM u WHERE length(r) > {least} AND length(r) < {most} GROUP BY 1, 2) SELECT record_id, CAST(n - 1 AS INT) AS no, r AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY i) AS n FROM d) WHERE n <= 10"
    )


def statements(path, tag: str) -> dict[str, str]:
    """path(column): a path as compared; tag: a row's name and version tag, of columns stem and version."""
    words = lambda c, w: "(" + " + ".join(f"CASE WHEN contains({c}, '{x}') THEN 1 ELSE 0 END" for x in w) + ")"
    p, n, b = (words("section", SCENARIO_WORDS[k]) for k in ("positive", "negative", "boundary"))
    heads = [f"regexp_matches(s, {pattern(x)})" for x in WORD_HEADINGS]
    number = f"regexp_extract(s, {pattern(WORD_HEADINGS[0])}, 1)"
    markdown = pattern(r"^(#{1,6})\s+(.+)$")
    intro = f"list_slice(list_filter(string_split_regex({strip(f"regexp_replace(array_to_string(list_slice(string_split(page_content, chr(10)), 1, 5), chr(10)), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}{SPACES}一-鿿]', ' ', 'g')")}, '{W}+'), lambda w: length(w) >= 2), 1, 3)"
    titles = "[" + ", ".join(f"CASE WHEN contains(section_title, '{w}') THEN '{w}' END" for w in TITLE_WORDS) + "]"
    level = "CASE section_level WHEN 1 THEN 'chapter' WHEN 2 THEN 'section' WHEN 3 THEN 'subsection' END"
    every = f"list_concat(list_concat([{tag}, {level}], {titles}), coalesce({intro}, []))"
    text = strip("page_content")
    clean = ", ".join([machine("metadata", "l0", "l1"), machine("toc", "l1", "l2"), machine("approval", "l2", "l3"), machine("separators", "l3", "l4")])
    mark = "chr(1)"
    return {
        "route_strategy": f"SELECT record_id, CASE WHEN page_content IS NULL THEN NULL WHEN contains(page_content, '#') THEN 'markdown' WHEN regexp_matches(lower(coalesce(source, '')), '\\.(docx|doc)$') OR len(list_filter(list_slice(string_split(page_content, chr(10)), 1, 20), lambda x: {any_of(strip('x'), WORD_HEADINGS)})) >= 2 THEN 'word' ELSE 'paragraph' END AS strategy FROM kb_document",
        "markdown_sections": sections("contains(page_content, '#')", f"regexp_matches(s, {markdown})", f"length(regexp_extract(s, {markdown}, 1))", strip(f"regexp_extract(s, {markdown}, 2)")),
        "word_sections": sections("NOT contains(page_content, '#')", f"({' OR '.join(heads)})", f"CASE WHEN {heads[0]} THEN length({number}) - length(replace({number}, '.', '')) + 1 WHEN {heads[1]} OR {heads[2]} THEN 1 ELSE 2 END", "s"),
        "region_metadata": region("metadata"),
        "region_toc": region("toc"),
        "table_separators": region("separators"),
        "cleaned_pages": f"WITH RECURSIVE l0 AS MATERIALIZED ({flagged(f'({LINES})')}), {clean}, t AS MATERIALIZED ({whole('(SELECT * FROM l4 WHERE NOT page AND NOT mark)')}) SELECT record_id, {normalised('text')} AS text FROM t WHERE length({strip('text')}) >= 20 AND record_id IN (SELECT min(record_id) FROM t WHERE text IS NOT NULL GROUP BY md5(regexp_replace(lower(text), '{W}+', '', 'g')))",
        "intro_tags": f"SELECT record_id, CASE WHEN page_content IS NOT NULL THEN coalesce(array_to_string({intro}, ','), '') END AS tags FROM kb_document",
        "all_tags": f"SELECT record_id, coalesce(array_to_string(list_sort(list_distinct(list_filter({every}, lambda t: t IS NOT NULL AND t <> ''))), ','), '') AS tags FROM (SELECT *, regexp_replace(list_extract(string_split(replace(source, '\\', '/'), '/'), -1), '(.)\\.[^.]*$', '\\1') AS stem FROM kb_document)",
        "rule_extract": extracted(RULE_PATTERNS, 10, 200, "rule"),
        "test_point_extract": extracted(POINT_PATTERNS, 5, 100, "point"),
        "scenario_sections": f"WITH m AS (SELECT record_id, string_split(regexp_replace(replace(page_content, {mark}, ''), {pattern('(?m)' + SECTION_NUMBER)}, {mark} || '\\1' || {mark} || '\\2' || {mark}, 'g'), {mark}) AS a FROM kb_document WHERE page_content IS NOT NULL), "
        f"c AS (SELECT record_id, k AS section_index, a[3 * k + 2] AS section_number, {strip('a[3 * k + 3]')} AS section_title, {strip('a[3 * k + 4]')} AS section FROM (SELECT record_id, a, unnest(generate_series(0, CAST((len(a) - 1) // 3 AS BIGINT) - 1)) AS k FROM m)) "
        f"SELECT record_id, CAST(section_index AS INT) AS section_index, section_number, section_title, section, CASE WHEN {p} >= greatest({n}, {b}) THEN 'positive' WHEN {n} >= {b} THEN 'negative' ELSE 'boundary' END AS scenario_type FROM c WHERE NOT {any_of('section_title', SCENARIO_SKIPPED)} AND length({strip('section')}) >= 50 AND len(list_filter(list_slice(string_split(section, chr(10)), 1, 5), lambda x: {any_of(strip('x'), SCENARIO_METADATA)})) < 3",
        "chunk_types": f"SELECT record_id, CASE WHEN page_content IS NULL THEN NULL WHEN starts_with({text}, '|') AND ends_with({text}, '|') AND (contains(page_content, '---') OR contains(page_content, ' | ')) THEN 'table' WHEN regexp_matches(page_content, '^\\p{{Nd}}+[、.]') THEN 'list' WHEN regexp_matches(page_content, '^(#{{1,6}}{W}+|\\p{{Nd}}+([.:]|{W}))') THEN 'heading' WHEN contains(page_content, chr(10)) THEN 'paragraph' ELSE 'sentence' END AS chunk_type FROM kb_document",
        "split_text_pack": f"WITH RECURSIVE q AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, p FROM (SELECT doc_id, j, {strip('a[j]')} AS p FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS j FROM (SELECT doc_id, string_split_regex(text, '\\n{W}*\\n|\\n') AS a FROM documents WHERE text IS NOT NULL))) WHERE p <> ''), "
        "s AS (SELECT doc_id, i, length(p) AS n, CAST(0 AS BIGINT) AS g FROM q WHERE i = 1 UNION ALL SELECT s.doc_id, q.i, CASE WHEN s.n + length(q.p) + 2 > 1500 THEN length(q.p) ELSE s.n + 2 + length(q.p) END, s.g + CASE WHEN s.n + length(q.p) + 2 > 1500 THEN 1 ELSE 0 END FROM s JOIN q ON q.doc_id = s.doc_id AND q.i = s.i + 1) "
        "SELECT doc_id, CAST(g AS INT) AS chunk_index, string_agg(p, chr(10) || chr(10) ORDER BY i) AS chunk FROM s JOIN q USING (doc_id, i) GROUP BY 1, 2",
        "manifest_latest": f"SELECT path, processed_at, hash, size, image_processed FROM (SELECT {path('path')} AS path, processed_at, hash, size, image_processed FROM file_state WHERE path IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY path ORDER BY processed_at DESC NULLS LAST, hash DESC NULLS LAST, size DESC NULLS LAST, image_processed DESC NULLS LAST) = 1",
        "case_report": "SELECT seq, concat_ws(chr(10), CASE WHEN coalesce(step_id, 0) = 1 AND {0} <> '' THEN '## ' || {0} END, CASE WHEN {1} <> '' THEN '- precondition: ' || precondition END, CASE WHEN {2} <> '' THEN '- priority: ' || priority END, '- step ' || step_id || ': ' || step, CASE WHEN {3} <> '' THEN '- expected: ' || expected END) AS markdown FROM case_row".format(*(strip(f"coalesce({c}, '')") for c in ("name", "precondition", "priority", "expected"))),
        "reply_cases": "SELECT seq, CAST(0 AS INT) AS case_index, name, step_id, replace(replace(step, chr(13), ''), chr(10), '\\n') AS step, precondition, priority, expected FROM case_row",
    }
