"""Catalogue of the core queries and their DuckDB statements. Each runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, literal_contains, normalise
from ..operators import cases, chunk, clean, incremental, labels, manifest, search, structure, versions
from ..operators.tables import markdown_rows
from ..plugins import overlap_scorer
from ..rules import APPROVAL_STARTS, PAGE_LINES, REAL_HEADINGS, SCENARIO_WORDS, TITLE_WORDS, WATERMARK_LINES
from ..session import cut, table
from .statements import statements

FLAGSHIP = "hybrid_topk"
QUERY_TERMS = ["system", "approval", "system", "同", "步"]


def _kb(s, sf):
    return table(s, sf, "kb_document")


def _docs(s, sf):
    return table(s, sf, "documents")


def _query_vector(s, sf) -> list[float]:
    return table(s, sf, "embeddings").orderBy("vec_id").select("embedding").first()[0]


# -- structure and cleaning ------------------------------------------------------------------------------------------


def paragraph_split(s, sf):
    return structure.paragraphs(_kb(s, sf), "record_id", "page_content")


def route_strategy(s, sf):
    return _kb(s, sf).select("record_id", structure.strategy(F.col("page_content"), F.col("source")).alias("strategy"))


def markdown_sections(s, sf):
    kb = _kb(s, sf).filter(F.contains("page_content", F.lit("#")))
    return structure.sections(kb, "record_id", "page_content", structure.markdown_heading)


def word_sections(s, sf):
    kb = _kb(s, sf).filter(~F.contains("page_content", F.lit("#")))
    return structure.sections(kb, "record_id", "page_content", structure.word_heading)


def merge_short_rows(s, sf):
    rows = _kb(s, sf).select("record_id", "page_content", "source", "version")
    return structure.merge_short(rows, "record_id", "page_content", ["source", "version"])


def content_dedup(s, sf):
    return clean.deduplicated(_kb(s, sf).select("record_id", "page_content"), "record_id", "page_content").select("record_id")


def min_length_after_dedup(s, sf):
    kept = clean.deduplicated(_kb(s, sf).select("record_id", "page_content"), "record_id", "page_content")
    return clean.long_enough(kept, "page_content").select("record_id")


def normalize_format(s, sf):
    return _kb(s, sf).select("record_id", normalise(F.col("page_content")).alias("text"))


def line_filter(s, sf):
    c = clean.without_watermarks(clean.without_page_lines(F.col("page_content")))
    return _kb(s, sf).select("record_id", c.alias("text"))


def region_approval(s, sf):
    return _kb(s, sf).select("record_id", clean.without_approval(F.col("page_content")).alias("text"))


def region_metadata(s, sf):
    return _kb(s, sf).select("record_id", clean.without_metadata(F.col("page_content")).alias("text"))


def region_toc(s, sf):
    return _kb(s, sf).select("record_id", clean.without_toc(F.col("page_content")).alias("text"))


def table_separators(s, sf):
    return _kb(s, sf).select("record_id", clean.without_separators(F.col("page_content")).alias("text"))


def cleaned_pages(s, sf):
    """All cleaning filters, deduplication, length filter and normalisation in their order."""
    rows = _kb(s, sf).select("record_id", clean.cleaned(F.col("page_content")).alias("text"))
    kept = clean.long_enough(clean.deduplicated(cut(rows), "record_id", "text"), "text")
    return kept.select("record_id", normalise(F.col("text")).alias("text"))


# -- labels ---------------------------------------------------------------------------------------------------------


def title_tags(s, sf):
    return _kb(s, sf).select("record_id", F.array_join(labels.title_tags(F.col("section_title")), ",").alias("tags"))


def intro_tags(s, sf):
    return _kb(s, sf).select("record_id", F.array_join(labels.intro_tags(F.col("page_content")), ",").alias("tags"))


def doc_name_version_tag(s, sf):
    return _kb(s, sf).select("record_id", labels.name_version_tag(F.col("source"), F.col("version")).alias("tag"))


def all_tags(s, sf):
    t = labels.tags(*map(F.col, ("source", "version", "section_title", "page_content", "section_level")))
    return _kb(s, sf).select("record_id", F.array_join(t, ",").alias("tags"))


def module_name(s, sf):
    return _kb(s, sf).select("record_id", labels.module_name(F.col("source")).alias("module"))


def scenario_type(s, sf):
    return _kb(s, sf).select("record_id", labels.scenario_type(F.col("page_content")).alias("scenario_type"))


def scenario_word_counts(s, sf):
    return _kb(s, sf).select("record_id", *[literal_contains(F.col("page_content"), SCENARIO_WORDS[k]).cast("long").alias(k) for k in SCENARIO_WORDS]).filter("positive is not null")


def entity_extract(s, sf):
    return _kb(s, sf).select("record_id", F.explode(labels.entities(F.col("page_content"))).alias("entity"))


def rule_extract(s, sf):
    return _kb(s, sf).select("record_id", F.posexplode(labels.rules(F.col("page_content"))).alias("no", "rule"))


def test_point_extract(s, sf):
    return _kb(s, sf).select("record_id", F.posexplode(labels.test_points(F.col("page_content"))).alias("no", "point"))


def scenario_sections(s, sf):
    found = labels.scenario_sections(_kb(s, sf), "record_id", "page_content")
    return found.filter(labels.scenario_kept(F.col("section_title"), F.col("section"))).select("*", labels.scenario_type(F.col("section")).alias("scenario_type"))


# -- chunks ---------------------------------------------------------------------------------------------------------


def sentence_split(s, sf):
    return _docs(s, sf).select("doc_id", F.posexplode(chunk.sentences(F.col("text"))).alias("no", "sentence"))


def clause_split(s, sf):
    return _docs(s, sf).select("doc_id", F.posexplode(chunk.clauses(F.col("text"))).alias("no", "clause"))


def table_lines(s, sf):
    rows = _kb(s, sf).select("record_id", F.posexplode(F.split("page_content", "\n", -1)).alias("line_no", "line"))
    return rows.filter(chunk.table_line(F.col("line")))


def chunk_types(s, sf):
    return _kb(s, sf).select("record_id", chunk.chunk_type(F.col("page_content")).alias("chunk_type"))


def split_text_pack(s, sf):
    return _docs(s, sf).select("doc_id", F.posexplode(chunk.packed(F.col("text"))).alias("chunk_index", "chunk"))


def semantic_chunks(s, sf):
    return chunk.semantic_chunks(_kb(s, sf), "record_id", "page_content", "has_tables")


def markdown_table(s, sf):
    return markdown_rows(table(s, sf, "nation"), "n_nationkey")


# -- retrieval ------------------------------------------------------------------------------------------------------


def corpus_terms(s, sf):
    return search.corpus_stats(_docs(s, sf), "text")[0]


def bm25_topk(s, sf):
    top = search.topk(search.bm25(_docs(s, sf), "doc_id", "text", QUERY_TERMS), "bm25", "doc_id", 20)
    return top.select("doc_id", F.round("bm25", 6).alias("score"))


def vector_topk(s, sf):
    return search.vector_topk(table(s, sf, "embeddings"), "vec_id", "embedding", _query_vector(s, sf), 10).select("vec_id", "similarity", "rank")


def filtered_vector_topk(s, sf):
    e = search.matching(table(s, sf, "embeddings"), {"label": 3})
    return search.vector_topk(e, "vec_id", "embedding", _query_vector(s, sf), 10).select("vec_id", "similarity", "rank")


def hybrid_topk(s, sf):
    v = search.vector_topk(table(s, sf, "embeddings"), "vec_id", "embedding", _query_vector(s, sf), 20).select(F.col("vec_id").alias("doc_id"), "rank")
    b = search.topk(search.bm25(_docs(s, sf), "doc_id", "text", QUERY_TERMS), "bm25", "doc_id", 20)
    b = b.withColumn("b_rank", F.row_number().over(Window.orderBy(F.desc("bm25"), "doc_id")))
    return search.fused(v, b, "doc_id").orderBy(*search.fused_order(), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


def tag_contains(s, sf):
    return search.with_tag(_kb(s, sf), "tags", "临时").select("record_id", search.tag_level(F.col("tags"), "临时").alias("level"))


def metadata_filter(s, sf):
    return search.matching(_kb(s, sf), {"type": "word", "module": "仓储"}).select("record_id")


def name_boost(s, sf):
    """All rows with their place among their like: those with the name in a tag, by level, and the rest, by score."""
    rows = _kb(s, sf).select("record_id", F.coalesce(F.col("original_length"), F.lit(0)).alias("score"), search.tag_level(F.col("tags"), "临时").alias("level"))
    return rows.select("record_id", "level", F.when(F.col("level").isNotNull(), 0).otherwise(1).alias("block"), F.when(F.col("level").isNull(), F.col("score")).alias("score"))


def version_boost(s, sf):
    """All rows, those of the three newest versions in the first block of the order."""
    rows = _kb(s, sf)
    newest = [r.version for r in versions.versions(rows).limit(3).collect()]
    boosted = F.coalesce(F.col("version").isin(*newest), F.lit(False))
    return rows.select("record_id", boosted.alias("boosted"), F.when(boosted, 0).otherwise(1).alias("block"))


def version_in(s, sf):
    """Rows of any of the versions of a comma-separated request."""
    rows = _kb(s, sf)
    return versions.of_versions(rows, versions.requested(rows, "最新, 第三新")[0]).select("record_id", "version")


THREE_QUERIES = [["system"], ["approval"], ["同", "步"]]


def _three_lists(df, key, text, k):
    """Top k of each of the three queries, from one pass over the texts."""
    scored, parts = cut(search.bm25_many(df, key, text, THREE_QUERIES)), None
    for no in range(len(THREE_QUERIES)):
        top = search.topk(scored.filter(F.col("query_no") == no), "bm25", key, k)
        top = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bm25"), key)))
        parts = top if parts is None else parts.unionByName(top)
    return parts.select(key, "query_no", "rank")


def multi_query_union(s, sf):
    return search.first_seen(_three_lists(_docs(s, sf), "doc_id", "text", 20), "query_no", "rank", "doc_id")


QUESTION = "system approval 同步"


def rerank_topk(s, sf):
    """The BM25 list of the question's terms, in order of the pair scorer."""
    docs = _docs(s, sf)
    top = search.topk(search.bm25(docs, "doc_id", "text", QUERY_TERMS), "bm25", "doc_id", 20)
    rows = search.reranked(docs.select("doc_id", "text").join(F.broadcast(top), "doc_id"), "text", QUESTION, overlap_scorer)  # 20 rows
    return rows.orderBy(F.desc("rerank"), F.desc("bm25"), "doc_id").limit(10).select("doc_id", F.round("rerank", 6).alias("rerank"))


def version_supplement(s, sf):
    """More rows of the three newest versions than a search of the word files found."""
    rows = _kb(s, sf).filter("page_content is not null").select("record_id", "page_content", "version", "type", "module")
    newest = [r.version for r in versions.versions(rows).limit(3).collect()]
    found = search.matching(rows, {"type": "word", "module": "仓储"})
    more = search.version_supplement(rows, found, newest, "page_content", "record_id", QUESTION, overlap_scorer, 20)
    return more.select("record_id", F.round("rerank", 6).alias("rerank"))


def multi_query_full(s, sf):
    """Several queries in full: first-seen union by content, rows of the newest versions added, reranked, rows with the name in a tag first."""
    rows = _kb(s, sf).filter("page_content is not null").select("record_id", "page_content", "version", "tags")
    newest = [r.version for r in versions.versions(rows).limit(3).collect()]
    lists = rows.join(F.broadcast(_three_lists(rows, "record_id", "page_content", 20)), "record_id")  # 60 rows
    found = cut(search.first_seen(lists, "query_no", "rank", "page_content"))
    more = search.version_supplement(rows, found, newest, "page_content", "record_id", QUESTION, overlap_scorer, 10)
    every = found.select("record_id", "page_content", "version", "tags").unionByName(more.select("record_id", "page_content", "version", "tags"))
    scored = search.reranked(every, "page_content", QUESTION, overlap_scorer)
    named = F.coalesce(search.tag_level(F.col("tags"), "临时").isNotNull(), F.lit(False))
    return scored.orderBy(F.when(named, 0).otherwise(1), F.desc("rerank"), "record_id").limit(20).select("record_id", F.round("rerank", 6).alias("rerank"))


def supplement_unseen(s, sf):
    docs = _docs(s, sf).select("doc_id", "text", "source").filter("text is not null")
    found, more = docs.filter("source = 'wiki_warehouse'"), docs.filter("source like 'share%'")
    return search.supplemented(found, more, "text").select("doc_id")


def parent_recall(s, sf):
    m = table(s, sf, "message").filter(F.contains("content", F.lit("同步"))).select("conv_id", "turn")
    convs = table(s, sf, "message").groupBy("conv_id").agg(F.count("*").alias("messages"))
    return search.parents(m, convs, "conv_id", "turn").select("conv_id", "messages", F.col("best_rank").alias("first_turn"))


def history_text(s, sf):
    return search.conversation(table(s, sf, "message"), "conv_id", "turn", "role", "content")


def context_block(s, sf):
    return search.context(_docs(s, sf).filter("text is not null"), "doc_id", "text")


# -- versions and files ---------------------------------------------------------------------------------------------


def version_list(s, sf):
    return versions.versions(_kb(s, sf))


def version_latest(s, sf):
    return versions.nth_newest(_kb(s, sf), 1).select("record_id")


def version_second_by_module(s, sf):
    return versions.nth_newest(_kb(s, sf), 2, "module").select("record_id")


def version_by_name(s, sf):
    return versions.versions(_kb(s, sf), "变更记录")


def document_name_input(s, sf):
    return _kb(s, sf).select("record_id", versions.is_document_name(F.col("version")).alias("is_name"))


def manifest_latest(s, sf):
    return manifest.latest(table(s, sf, "file_state"))


def changed_files(s, sf):
    files = table(s, sf, "file_scan").filter("source is not null").select("scan_id", incremental.plain_path(F.col("source")).alias("path"), F.col("file_hash").alias("hash"))
    return manifest.changed(files, table(s, sf, "file_state"), True).select("scan_id")


def manifest_upsert(s, sf):
    state = manifest.latest(table(s, sf, "file_state")).select("path", "hash")
    new = table(s, sf, "file_scan").filter("source is not null and file_hash <> ''").groupBy(incremental.plain_path(F.col("source")).alias("path")).agg(F.max("file_hash").alias("hash"))
    return manifest.upserted(state, new)


def build_status(s, sf):
    files = table(s, sf, "file_scan").select(incremental.plain_path(F.col("source")).alias("path"))
    state = table(s, sf, "file_state").select(incremental.plain_path(F.col("path")).alias("path"))
    return manifest.build_status(files, state)


def list_page(s, sf):
    rows = table(s, sf, "file_scan").filter(F.contains(F.lower("source"), F.lit(".docx")))
    return rows.orderBy(F.desc("modified_at"), "scan_id").offset(10).limit(10).select("scan_id", "size")


def scan_intervals(s, sf):
    return incremental.intervals(table(s, sf, "file_scan"), "scan_id")


def p4_found(s, sf):
    return incremental.file_changes(table(s, sf, "file_scan"), table(s, sf, "file_state"), table(s, sf, "build_run"))


# -- test cases -----------------------------------------------------------------------------------------------------


def _cases(s, sf):
    return table(s, sf, "case_row")


def orphan_steps(s, sf):
    return cases.without_orphans(_cases(s, sf), "seq", "source").select("seq")


def attach_steps(s, sf):
    return cases.attached(_cases(s, sf), "seq", "source").select("seq", "case_name")


def case_numbers(s, sf):
    return cases.numbered(_cases(s, sf)).filter("case_number is not null").select("seq", "case_number")


def case_name_dedup(s, sf):
    return cases.first_names(_cases(s, sf)).select("seq")


def case_sheet(s, sf):
    return cases.sheet(_cases(s, sf)).select("seq", "c1", "c4", "c6", "c7", "c8", "c9", "c10")


def case_report(s, sf):
    return cases.report(_cases(s, sf))


def case_counts(s, sf):
    return cases.distinct_names(_cases(s, sf))


def json_parse(s, sf):
    e = table(s, sf, "events").select("event_id", F.try_parse_json("props").alias("j"))
    return e.select("event_id", F.to_json("j").isNotNull().alias("parsed"))


def reply_cases(s, sf):
    """Replies of a chat model as they come: bare, fenced, or without their end; one a row of the case table."""
    case = F.struct("name", "step_id", "step", "precondition", "priority", "expected")
    said = F.to_json(F.array(case))
    form = F.pmod(F.col("seq"), F.lit(3))
    reply = F.when(form == 0, said).when(form == 1, F.concat(F.lit("Here they are:\n```json\n"), said, F.lit("\n```"))).otherwise(F.expr("left(said, length(said) - 1)"))
    return cases.reply_cases(_cases(s, sf).withColumn("said", said).select("seq", reply.alias("reply")), "seq", "reply")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = """paragraph_split route_strategy markdown_sections word_sections merge_short_rows content_dedup min_length_after_dedup normalize_format
        line_filter region_approval region_metadata region_toc table_separators cleaned_pages title_tags intro_tags doc_name_version_tag all_tags module_name
        scenario_type scenario_word_counts entity_extract rule_extract test_point_extract scenario_sections sentence_split clause_split table_lines chunk_types
        split_text_pack semantic_chunks markdown_table corpus_terms bm25_topk vector_topk filtered_vector_topk hybrid_topk tag_contains metadata_filter
        name_boost version_boost version_in rerank_topk version_supplement multi_query_full multi_query_union supplement_unseen parent_recall history_text context_block version_list version_latest
        version_second_by_module version_by_name document_name_input manifest_latest changed_files manifest_upsert build_status list_page scan_intervals
        p4_found orphan_steps attach_steps case_numbers case_name_dedup case_sheet case_report case_counts json_parse reply_cases""".split()
    return {n: globals()[n] for n in names}


# -- DuckDB statements ----------------------------------------------------------------------------------------------

W = f"[{SPACES}]"


def _q(text: str) -> str:
    return text.replace("'", "''")


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def _re(patterns) -> str:
    return _q("(?:" + "|".join(p.replace(r"[\s", f"[{SPACES}").replace(r"\s", W) for p in patterns) + ")")


def _path(c: str) -> str:
    return f"regexp_replace(replace({c}, '\\', '/'), '^\\./', '')"


def oracle_sql() -> dict[str, str]:
    lines = "SELECT record_id, a[i] AS line, i FROM (SELECT record_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT record_id, string_split(page_content, chr(10)) AS a FROM kb_document WHERE page_content IS NOT NULL))"
    filtered = lambda keep: f"SELECT k.record_id, CASE WHEN k.page_content IS NOT NULL THEN coalesce(t.text, '') END AS text FROM kb_document k LEFT JOIN (SELECT record_id, string_agg(line, chr(10) ORDER BY i) AS text FROM ({lines}) WHERE {keep} GROUP BY 1) t USING (record_id)"
    # Texts of which no line is left are empty, not missing.
    words = lambda w: "(" + " + ".join(f"CASE WHEN contains(page_content, '{x}') THEN 1 ELSE 0 END" for x in w) + ")"
    p, n, b = (words(SCENARIO_WORDS[k]) for k in SCENARIO_WORDS)
    dedup = f"SELECT min(record_id) AS record_id FROM kb_document WHERE page_content IS NOT NULL GROUP BY md5(regexp_replace(lower(page_content), '{W}+', '', 'g'))"
    name = _strip("coalesce(name, '')")
    step = _strip("coalesce(step, '')")
    main = f"(coalesce(step_id, 0) = 1 AND {name} <> '')"
    toks = "regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]')"

    newest = "page_content IS NOT NULL AND version IN (SELECT DISTINCT version FROM kb_document WHERE page_content IS NOT NULL AND version IS NOT NULL ORDER BY 1 DESC LIMIT 3)"
    share = lambda c: f"(len(list_filter(['system', 'approval', '同', '步'], lambda w: list_contains(regexp_extract_all(lower({c}), '[a-z0-9]+|[一-鿿]'), w))) / 4.0)"

    def bm25(terms, limit, source="documents", key="doc_id", text="text"):
        toks = f"regexp_extract_all(lower({text}), '[a-z0-9]+|[一-鿿]')"
        per = " + ".join(
            f"CASE WHEN tf{k} > 0 THEN {terms.count(w)} * (SELECT CASE WHEN i < 0 THEN 0.25 * (SELECT m FROM mi) ELSE i END FROM (SELECT coalesce((SELECT idf FROM idf WHERE term = '{w}'), 0) AS i)) * tf{k} * 2.5 / (tf{k} + 1.5 * (0.25 + 0.75 * dl / (SELECT a FROM c))) ELSE 0 END"
            for k, w in enumerate(sorted(set(terms)))
        )
        tf = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(sorted(set(terms))))
        return f"(WITH d AS (SELECT {key}, {toks} AS t FROM {source} WHERE {text} IS NOT NULL), c AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM d) GROUP BY 1), idf AS (SELECT term, ln(c.n - df + 0.5) - ln(df + 0.5) AS idf FROM df, c), mi AS (SELECT avg(idf) AS m FROM idf), s AS (SELECT {key}, len(t) AS dl, {tf} FROM d) SELECT {key}, {per} AS bm25 FROM s WHERE {per} > 0 ORDER BY bm25 DESC, {key} LIMIT {limit})"

    qv = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
    sim = f"round(list_dot_product(embedding::DOUBLE[], {qv}::DOUBLE[]), 6)"
    vec = lambda where, k: f"SELECT vec_id, s AS similarity, CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS INT) AS rank FROM (SELECT vec_id, {sim} AS s FROM embeddings WHERE {where} ORDER BY s DESC, vec_id LIMIT {k})"
    level = "list_max(list_transform(tags, lambda t: CASE WHEN t = '临时' THEN 2 WHEN starts_with(t, '临时') THEN 1 WHEN contains(t, '临时') THEN 0 END))"
    known = f"SELECT path, arg_max(hash, (processed_at, coalesce(hash, ''))) AS hash FROM (SELECT {_path('path')} AS path, hash, processed_at FROM file_state WHERE path IS NOT NULL) GROUP BY 1"
    tag = "translate(CASE WHEN version IS NOT NULL AND version <> '' THEN stem || '_V' || version ELSE stem END, '/:', '--')"
    return statements(_path, tag) | {
        "paragraph_split": f"SELECT record_id, CAST(i - 1 AS INT) AS paragraph_index, {_strip('a[i]')} AS paragraph FROM (SELECT record_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT record_id, string_split_regex(page_content, '\\n{W}*\\n|\\n') AS a FROM kb_document WHERE page_content IS NOT NULL)) WHERE {_strip('a[i]')} <> ''",
        "content_dedup": dedup,
        "min_length_after_dedup": f"SELECT record_id FROM kb_document JOIN ({dedup}) USING (record_id) WHERE length({_strip('page_content')}) >= 20",
        "normalize_format": f"SELECT record_id, regexp_replace(array_to_string(list_transform(string_split(regexp_replace(replace(replace(page_content, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)), lambda x: {_strip('x')}), chr(10)), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM kb_document",
        "line_filter": filtered(f"NOT regexp_matches({_strip('line')}, '{_re(PAGE_LINES + WATERMARK_LINES)}')"),
        "region_approval": f"SELECT k.record_id, CASE WHEN k.page_content IS NOT NULL THEN coalesce(t.text, '') END AS text FROM kb_document k LEFT JOIN (SELECT record_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT *, last_value(e IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY i) AS st FROM (SELECT *, CASE WHEN regexp_matches({_strip('line')}, '{_re(APPROVAL_STARTS)}') THEN 1 WHEN regexp_matches({_strip('line')}, '{_re(REAL_HEADINGS)}') THEN 0 END AS e FROM ({lines}))) WHERE coalesce(st, 0) = 0 GROUP BY 1) t USING (record_id)",
        "merge_short_rows": "SELECT min(record_id) AS first_record_id, string_agg(coalesce(page_content, ''), chr(10) || chr(10) ORDER BY record_id) AS page_content, arg_max(source, record_id) AS source, arg_max(version, record_id) AS version FROM (SELECT *, sum(CASE WHEN length(coalesce(page_content, '')) >= 50 THEN 1 ELSE 0 END) OVER (ORDER BY record_id) AS g FROM kb_document) GROUP BY g",
        "title_tags": "SELECT record_id, CASE WHEN section_title IS NOT NULL THEN concat_ws(',', " + ", ".join(f"CASE WHEN contains(section_title, '{w}') THEN '{w}' END" for w in TITLE_WORDS) + ") END AS tags FROM kb_document",
        "doc_name_version_tag": f"SELECT record_id, translate(CASE WHEN version IS NOT NULL AND version <> '' THEN stem || '_V' || version ELSE stem END, '/:', '--') AS tag FROM (SELECT *, regexp_replace(list_extract(string_split(replace(source, '\\', '/'), '/'), -1), '(.)\\.[^.]*$', '\\1') AS stem FROM kb_document)",
        "module_name": "SELECT record_id, CASE WHEN source IS NULL OR source = '' THEN '未知模块' WHEN len(p) >= 2 AND p[-2] <> 'docs' THEN p[-2] WHEN len(p) >= 2 THEN split_part(p[-1], '.', 1) ELSE split_part(source, '.', 1) END AS module FROM (SELECT record_id, source, string_split(replace(source, '\\', '/'), '/') AS p FROM kb_document)",
        "scenario_type": f"SELECT record_id, CASE WHEN page_content IS NULL THEN NULL WHEN {p} >= greatest({n}, {b}) THEN 'positive' WHEN {n} >= {b} THEN 'negative' ELSE 'boundary' END AS scenario_type FROM kb_document",
        "scenario_word_counts": f"SELECT record_id, CAST({p} AS BIGINT) AS positive, CAST({n} AS BIGINT) AS negative, CAST({b} AS BIGINT) AS boundary FROM kb_document",
        "entity_extract": "SELECT record_id, unnest(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(lower(page_content), '[a-z_][a-z0-9_]*\\.[a-z_][a-z0-9_]*'), lambda x: NOT list_contains(['and', 'or', 'not', 'in', 'is', 'null', 'true', 'false', 'if', 'else', 'then'], split_part(x, '.', 2))))), 1, 20)) AS entity FROM kb_document",
        "sentence_split": "SELECT doc_id, CAST(i - 1 AS INT) AS no, a[i] AS sentence FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^。！？.!?\\n]*[。！？.!?\\n]|[^。！？.!?\\n]+$') AS a FROM documents WHERE text IS NOT NULL))",
        "clause_split": "SELECT doc_id, CAST(i - 1 AS INT) AS no, a[i] AS clause FROM (SELECT doc_id, a, unnest(generate_series(1, len(a))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^，、；,;]*[，、；,;]|[^，、；,;]+$') AS a FROM documents WHERE text IS NOT NULL))",
        "table_lines": f"SELECT record_id, CAST(i - 1 AS INT) AS line_no, line FROM ({lines}) WHERE starts_with({_strip('line')}, '|') AND ends_with({_strip('line')}, '|') AND len(string_split({_strip('line')}, '|')) >= 4",
        "markdown_table": "SELECT n_nationkey, '| ' || n_nationkey || ' | ' || substr(coalesce(n_name, ' '), 1, 100) || ' | ' || coalesce(CAST(n_regionkey AS VARCHAR), ' ') || ' |' AS line FROM nation",
        "corpus_terms": f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({toks})) AS term FROM documents WHERE text IS NOT NULL) GROUP BY 1",
        "bm25_topk": f"SELECT doc_id, round(bm25, 6) AS score FROM {bm25(QUERY_TERMS, 20)}",
        "vector_topk": vec("true", 10),
        "filtered_vector_topk": vec("label = 3", 10),
        "hybrid_topk": f"WITH v AS ({vec('true', 20)}), b AS (SELECT *, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS b_rank FROM {bm25(QUERY_TERMS, 20)}), u AS (SELECT vec_id AS doc_id, 0.5 * (1.0 / rank) / (SELECT max(1.0 / rank) FROM v) AS part, rank AS v_rank, NULL AS b_rank FROM v UNION ALL SELECT doc_id, 0.3 * bm25 / (SELECT max(bm25) FROM b), NULL, b_rank FROM b) SELECT doc_id, round(sum(part), 6) AS score FROM u GROUP BY 1 ORDER BY round(sum(part), 9) DESC, min(v_rank) NULLS LAST, min(b_rank) NULLS LAST, doc_id LIMIT 10",
        "tag_contains": f"SELECT record_id, CAST({level} AS INT) AS level FROM kb_document WHERE len(list_filter(tags, lambda t: contains(t, '临时'))) > 0",
        "metadata_filter": "SELECT record_id FROM kb_document WHERE type = 'word' AND module = '仓储'",
        "name_boost": f"SELECT record_id, CAST(l AS INT) AS level, CASE WHEN l IS NULL THEN 1 ELSE 0 END AS block, CASE WHEN l IS NULL THEN coalesce(original_length, 0) END AS score FROM (SELECT *, {level} AS l FROM kb_document)",
        "version_boost": "WITH n AS (SELECT DISTINCT version FROM kb_document WHERE version IS NOT NULL ORDER BY 1 DESC LIMIT 3) SELECT record_id, coalesce(version IN (SELECT version FROM n), false) AS boosted, CASE WHEN version IN (SELECT version FROM n) THEN 0 ELSE 1 END AS block FROM kb_document",
        "version_in": "WITH n AS (SELECT version, row_number() OVER (ORDER BY version DESC) AS r FROM (SELECT DISTINCT version FROM kb_document WHERE version IS NOT NULL)) SELECT record_id, version FROM kb_document WHERE version IN (SELECT version FROM n WHERE r IN (1, 3))",
        "rerank_topk": f"SELECT doc_id, round({share('text')}, 6) AS rerank FROM {bm25(QUERY_TERMS, 20)} JOIN documents USING (doc_id) ORDER BY {share('text')} DESC, bm25 DESC, doc_id LIMIT 10",
        "version_supplement": f"SELECT record_id, round({share('page_content')}, 6) AS rerank FROM kb_document WHERE {newest} AND substr(page_content, 1, 100) NOT IN (SELECT substr(page_content, 1, 100) FROM kb_document WHERE page_content IS NOT NULL AND type = 'word' AND module = '仓储') ORDER BY {share('page_content')} DESC, record_id LIMIT 20",
        "multi_query_full": f"WITH l AS ({' UNION ALL '.join(f'SELECT record_id, {k} AS query_no, row_number() OVER (ORDER BY bm25 DESC, record_id) AS rank FROM {bm25(t, 20, "kb_document", "record_id", "page_content")}' for k, t in enumerate(THREE_QUERIES))}), f AS (SELECT k.* FROM l JOIN kb_document k USING (record_id) QUALIFY row_number() OVER (PARTITION BY page_content ORDER BY query_no, rank) = 1), "
        f"m AS (SELECT * FROM kb_document WHERE {newest} AND substr(page_content, 1, 100) NOT IN (SELECT substr(page_content, 1, 100) FROM f) ORDER BY {share('page_content')} DESC, record_id LIMIT 10) SELECT record_id, round({share('page_content')}, 6) AS rerank FROM (SELECT record_id, page_content, tags FROM f UNION ALL SELECT record_id, page_content, tags FROM m) ORDER BY CASE WHEN len(list_filter(tags, lambda t: contains(t, '临时'))) > 0 THEN 0 ELSE 1 END, {share('page_content')} DESC, record_id LIMIT 20",
        "multi_query_union": "SELECT doc_id, CAST(query_no AS INT) AS query_no, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY query_no, rank) AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, {k} AS query_no, row_number() OVER (ORDER BY bm25 DESC, doc_id) AS rank FROM {bm25(t, 20)}" for k, t in enumerate(THREE_QUERIES)) + ")) WHERE n = 1",
        "supplement_unseen": "SELECT doc_id FROM documents WHERE text IS NOT NULL AND source = 'wiki_warehouse' UNION ALL SELECT doc_id FROM documents WHERE text IS NOT NULL AND source LIKE 'share%' AND substr(text, 1, 100) NOT IN (SELECT substr(text, 1, 100) FROM documents WHERE text IS NOT NULL AND source = 'wiki_warehouse')",
        "parent_recall": "SELECT conv_id, (SELECT count(*) FROM message x WHERE x.conv_id = m.conv_id) AS messages, min(turn) AS first_turn FROM message m WHERE contains(content, '同步') AND conv_id IS NOT NULL GROUP BY conv_id",
        "history_text": "SELECT conv_id, string_agg(r || ': ' || content, chr(10) ORDER BY turn NULLS FIRST, r, content) AS history FROM (SELECT DISTINCT conv_id, turn, CASE WHEN lower(trim(role)) = 'user' THEN 'user' ELSE 'assistant' END AS r, content FROM message WHERE content IS NOT NULL) GROUP BY conv_id",
        "context_block": "SELECT string_agg('[' || n || '] ' || c, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT row_number() OVER (ORDER BY doc_id) AS n, substr(text, 1, 1000) AS c FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 5)",
        "version_list": "SELECT DISTINCT version FROM kb_document WHERE version IS NOT NULL",
        "version_latest": "SELECT record_id FROM kb_document WHERE version = (SELECT max(version) FROM kb_document)",
        "version_second_by_module": "SELECT k.record_id FROM kb_document k JOIN (SELECT module, version, dense_rank() OVER (PARTITION BY module ORDER BY version DESC) AS r FROM (SELECT DISTINCT module, version FROM kb_document WHERE version IS NOT NULL)) v ON k.module = v.module AND k.version = v.version WHERE r = 2",
        "version_by_name": "SELECT DISTINCT version FROM kb_document WHERE version IS NOT NULL AND contains(source, '变更记录')",
        "document_name_input": "SELECT record_id, CASE WHEN version IS NULL OR version = '' THEN false WHEN regexp_matches(version, '^\\d[_\\-\\d]{5,19}$') THEN false WHEN lower(version) IN ('.docx', '.doc', '.pdf', '.xlsx', '.xls', '.txt', '.md') THEN true WHEN regexp_matches(version, '^\\d{4,8}$') THEN false ELSE true END AS is_name FROM kb_document",
        "changed_files": f"WITH k AS (SELECT path, arg_max(row(hash, image_processed), (processed_at, coalesce(hash, ''), size, image_processed)) AS r FROM (SELECT {_path('path')} AS path, hash, processed_at, size, image_processed FROM file_state WHERE path IS NOT NULL) GROUP BY 1) SELECT scan_id FROM file_scan f LEFT JOIN k ON {_path('f.source')} = k.path WHERE f.source IS NOT NULL AND (struct_extract(r, 1) IS NULL OR struct_extract(r, 1) <> f.file_hash OR NOT coalesce(struct_extract(r, 2), false))",
        "manifest_upsert": f"WITH n AS (SELECT {_path('source')} AS path, max(file_hash) AS hash FROM file_scan WHERE source IS NOT NULL AND file_hash <> '' GROUP BY 1), k AS ({known}) SELECT path, hash FROM n UNION ALL SELECT path, hash FROM k WHERE path NOT IN (SELECT path FROM n)",
        "build_status": f"SELECT f AS files, i AS indexed, CASE WHEN f = 0 THEN 'empty' WHEN i = 0 THEN 'none' WHEN i < f THEN 'partial' ELSE 'built' END AS status FROM (SELECT count(DISTINCT {_path('source')}) AS f FROM file_scan), (SELECT count(DISTINCT {_path('path')}) AS i FROM file_state)",
        "list_page": "SELECT scan_id, size FROM file_scan WHERE contains(lower(source), '.docx') ORDER BY modified_at DESC NULLS LAST, scan_id LIMIT 10 OFFSET 10",
        "scan_intervals": "SELECT min(n) AS first, max(n) AS last FROM (SELECT n, n - row_number() OVER (ORDER BY n) AS g FROM (SELECT DISTINCT scan_id AS n FROM file_scan WHERE scan_id IS NOT NULL)) GROUP BY g",
        "p4_found": f"WITH s AS (SELECT scan_id, {_path('source')} AS path, version, file_hash FROM file_scan WHERE source IS NOT NULL AND file_hash <> ''), c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY path ORDER BY version DESC NULLS LAST, scan_id) = 1), k AS (SELECT {_path('path')} AS path, hash FROM file_state WHERE path IS NOT NULL AND hash <> '' AND run_id IN (SELECT run_id FROM build_run WHERE lower(status) = 'success') QUALIFY row_number() OVER (PARTITION BY {_path('path')} ORDER BY processed_at DESC NULLS LAST, hash DESC) = 1) SELECT scan_id FROM c LEFT JOIN k USING (path) WHERE hash IS NULL OR hash <> file_hash",
        "orphan_steps": f"SELECT seq FROM (SELECT *, sum(CASE WHEN {main} THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY seq) AS m FROM case_row) WHERE NOT (coalesce(step_id, 0) > 1 AND {step} <> '' AND m = 0)",
        "attach_steps": f"SELECT seq, CASE WHEN {main} THEN {name} WHEN coalesce(step_id, 0) > 1 AND {name} = '' THEN l END AS case_name FROM (SELECT *, last_value(CASE WHEN {main} THEN {name} END IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq) AS l FROM case_row)",
        "case_numbers": f"SELECT seq, CAST(row_number() OVER (ORDER BY seq) AS BIGINT) AS case_number FROM case_row WHERE {main}",
        "case_name_dedup": f"SELECT seq FROM case_row WHERE {name} = '' OR seq IN (SELECT min(seq) FROM case_row WHERE {name} <> '' GROUP BY {name})",
        "case_sheet": f"SELECT seq, CASE WHEN {main} THEN CAST(sum(CASE WHEN {main} THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS BIGINT) END AS c1, CASE WHEN step_id = 1 THEN name END AS c4, replace(precondition, '\\n', chr(10)) AS c6, CASE WHEN step_id = 1 THEN priority END AS c7, step_id AS c8, replace(step, '\\n', chr(10)) AS c9, replace(expected, '\\n', chr(10)) AS c10 FROM case_row WHERE {step} <> ''",
        "case_counts": f"SELECT count(DISTINCT CASE WHEN {name} <> '' THEN {name} END) AS cases, count(*) FILTER (step_id = 1) AS first_steps, count(*) AS rows FROM case_row",
        "json_parse": "SELECT event_id, TRY_CAST(props AS JSON) IS NOT NULL AS parsed FROM events",
    }
