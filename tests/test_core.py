"""Core operators on authored fixtures."""

import io
import json
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.functions.ordered import running
from foliomill.functions.text import dedup_key, normalise, strip
from foliomill.operators import cases, chunk, clean, incremental, labels, manifest, search, structure, versions


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def test_strip_and_keys_know_all_white_space(spark):
    assert one(spark, "　 \x1c a b\x85 ", strip) == "a b"
    assert one(spark, "A　b C", dedup_key) == "abc"
    assert one(spark, None, strip) is None


def test_normalise_collapses_before_it_strips(spark):
    assert one(spark, "a\r\n\n\n\n b\x07 \n \n \nc", normalise) == "a\n\nb\n\n\nc"


def test_page_lines_and_watermarks(spark):
    text = "第 3 页\n12\nPage 4\n第十页\n正文 12\n机密\n[内部]\nDRAFT\n机密文件"
    assert one(spark, text, lambda c: clean.without_watermarks(clean.without_page_lines(c))) == "正文 12\n机密文件"


def test_metadata_region_counts_blanks_over_the_region(spark):
    assert one(spark, "文档编号 1\n\nx\n\ny", clean.without_metadata) == "\ny"
    assert one(spark, "文档编号 1\nx\n1.1 范围\ny", clean.without_metadata) == "1.1 范围\ny"


def test_toc_region(spark):
    assert one(spark, "目 录\n1. a\n\n第一章 b\n正文", clean.without_toc) == "正文"
    long = "目录\n" + "\n".join(f"{k}. x" for k in range(52))
    assert one(spark, long, clean.without_toc) == "50. x\n51. x"


def test_approval_region_ends_at_a_heading_only(spark):
    assert one(spark, "a\n修改历史\nx\n\ny\n1.1 标题\nz", clean.without_approval) == "a\n1.1 标题\nz"


def test_separators_are_kept_in_tables(spark):
    assert one(spark, "-----\n| a | b |\n|---|---|\n-----\n｜\ntext\n=====", clean.without_separators) == "| a | b |\n|---|---|\n-----\ntext"


def test_strategy(spark):
    rows = spark.createDataFrame([("C# x", None), ("x", "a.DOCX"), ("1 范围\n1.1 概述", None), ("x", None), (None, "a.doc")], "t string, s string")
    assert [r[0] for r in rows.select(structure.strategy(F.col("t"), F.col("s"))).collect()] == ["markdown", "word", "word", "paragraph", None]


def test_word_heading_levels(spark):
    got = [one(spark, t, lambda c: structure.word_heading(c)[1]) for t in ("1 范围", "1.1 概述", "II. X", "第三章 Y", "(1) Z", "(一) W", "prose")]
    assert got == [1, 2, 1, 1, 2, 2, None]


def test_markdown_sections_count_empty_ones(spark):
    df = spark.createDataFrame([(1, "pre\n# A\nx\n## B\ny\n"), (2, "# only"), (3, None), (4, "")], "k long, t string")
    got = sorted(tuple(r) for r in structure.sections(df, "k", "t", structure.markdown_heading).collect())
    assert got == [(1, 0, 0, "", "pre"), (1, 1, 1, "A", "# A\nx"), (1, 2, 2, "B", "## B\ny"), (2, 0, 1, "only", "# only")]


def test_merge_short_folds_across_sources(spark):
    rows = [(k, "x" * n, s) for k, (n, s) in enumerate([(60, "a"), (10, "a"), (10, None), (70, "b"), (5, "c")])]
    df = spark.createDataFrame(rows, "o long, t string, s string")
    got = sorted(tuple(r) for r in structure.merge_short(df, "o", "t", ["s"]).select("first_o", F.length("t"), "s").collect())
    assert got == [(0, 84, "a"), (3, 77, "c")]


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_running_is_the_same_for_every_block_size(spark, block):
    rows = [(k, k % 3 if k % 4 else None, "a" if k % 2 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "o long, v int, p string").repartition(5)
    got = {r.o: (r.s, r.l) for r in running(df, "o", "p", {"s": F.coalesce("v", F.lit(0))}, {"l": F.col("v")}, block).collect()}
    state = {}
    for o, v, p in rows:
        s, last = state.get(p, (0, None))
        state[p] = (s + (v or 0), v if v is not None else last)
        assert got[o] == state[p]


def test_dedup_comes_before_the_length_filter(spark):
    df = spark.createDataFrame([(1, "short text"), (2, "s h o r t t e x t" + " " * 20 + "."[:0]), (3, None), (4, "y" * 30), (5, "Y" * 30)], "k long, t string")
    kept = clean.deduplicated(df, "k", "t")
    assert sorted(r.k for r in kept.collect()) == [1, 4]
    assert [r.k for r in clean.long_enough(kept, "t").collect()] == [4]


def test_scenario_types_settle_ties(spark):
    assert [one(spark, t, labels.scenario_type) for t in ("不通过", "不等于", "无关", "失败错误成功", None)] == ["positive", "negative", "positive", "negative", None]


def test_rules_and_points_bounds(spark):
    rule = lambda n: "如" + "果" * (n - 4) + "，是。"
    assert one(spark, rule(10), labels.rules) == []
    assert one(spark, "x" + "如果金额大于上限额度，则系统提示错误。", labels.rules)[0].endswith("错误。")
    assert one(spark, "检查单据的全部金额。检查单据的全部金额。", labels.test_points) == ["检查单据的全部金额。"]
    assert one(spark, "a_b.cd x.and T_q.R1", labels.entities) == ["a_b.cd", "t_q.r1"]


def test_scenario_sections_cross_a_newline(spark):
    df = spark.createDataFrame([(1, "前言\n4.1.0商机审核优化\nbody1\n4.1.1\nnext line\nbody2"), (2, "none"), (3, None)], "k long, t string")
    got = [tuple(r)[2:] for r in labels.scenario_sections(df, "k", "t").orderBy("section_index").collect()]
    assert got == [("4.1.0", "商机审核优化", "body1"), ("4.1.1", "next line", "body2")]


def test_module_and_name_tags(spark):
    assert [one(spark, t, labels.module_name) for t in ("docs/计量/a.docx", "docs\\a.b.docx", "x.md", "", None)] == ["计量", "a", "x", "未知模块", "未知模块"]
    assert one(spark, "d/a.b.docx", lambda c: labels.name_version_tag(c, F.lit("1:2"))) == "a.b_V1-2"


def test_chunk_types(spark):
    assert [one(spark, t, chunk.chunk_type) for t in ("| a | b |", "1、x", "1.1 x", "# x", "1: x", "a\nb", "a", None)] == ["table", "list", "list", "heading", "heading", "paragraph", "sentence", None]


def test_packed_matches_a_plain_loop(spark):
    texts = ["", "a\nb\n\nc", "\n".join("x" * (k * 7 % 40) for k in range(60)), "z" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, (got,) in zip(texts, df.select(chunk.packed(F.col("t"), 100)).collect(), strict=True):
        want, cur = [], ""
        for p in (x.strip() for x in t.split("\n")):
            if not p:
                continue
            if len(cur) + len(p) + 2 <= 100:
                cur = f"{cur}\n\n{p}" if cur else p
            else:
                want += [cur] if cur else []
                cur = p
        assert got == want + ([cur] if cur else [])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab。，.\n|  1、", max_size=900), st.integers(60, 200))
def test_chunker_is_total_and_bounded(text, size):
    got = chunk.SemanticChunker(size, 20, 10).split(text)
    assert got == chunk.SemanticChunker(size, 20, 10).split(text)
    plain = "|" not in text
    assert all(x.strip() for x in got)
    assert not plain or all(len(x) <= size + 20 for x in got)


def test_chunker_repeats_table_heads():
    table = "| h | i |\n|---|---|\n" + "\n".join(f"| r{k} | {'x' * 30} |" for k in range(60))
    got = chunk.SemanticChunker(500).split(table)
    assert len(got) > 3 and all(g.startswith("| h | i |\n|---|---|\n") for g in got)
    assert sum(g.count("| r") for g in got) == 60
    assert chunk.SemanticChunker().split(None) == [] and chunk.SemanticChunker().split(" \n ") == []
    assert chunk.SemanticChunker().split("x" * 49) == [] and len(chunk.SemanticChunker().split("x" * 50)) == 1


def test_bm25_matches_the_formula_and_floors_negative_idf(spark):
    docs = {1: "a a b", 2: "a c", 3: "a d d", 4: "b"}
    df = spark.createDataFrame(list(docs.items()), "k long, t string")
    toks = {k: t.split() for k, t in docs.items()}
    n, avg = 4, sum(map(len, toks.values())) / 4
    dfs = {w: sum(w in t for t in toks.values()) for w in "abcd"}
    idf = {w: search.idf(n, d) for w, d in dfs.items()}
    mean = sum(idf.values()) / 4
    assert idf["a"] < 0
    want = {}
    for k, t in toks.items():
        s = sum((0.25 * mean if idf[w] < 0 else idf[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in ["a", "d", "d"])
        if s > 0:
            want[k] = round(s, 9)
    assert {r.k: round(r.bm25, 9) for r in search.bm25(df, "k", "t", ["a", "d", "d"]).collect()} == want
    assert search.bm25(df, "k", "t", []).count() == 0


def test_fusion_counts_repeated_contents(spark):
    v = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "c string, rank int")
    b = spark.createDataFrame([("y", 4.0, 1), ("z", 2.0, 2)], "c string, bm25 double, b_rank int")
    got = {r.c: round(r.score, 6) for r in search.fused(v, b, "c").collect()}
    m = 0.5  # the greatest last reciprocal rank is y's
    assert got == {"x": round(2 * 0.5 * (1 / 3) / m, 6), "y": round(0.5 * 0.5 / m + 0.3, 6), "z": 0.15}
    assert search.fused(v.limit(0), b, "c").count() == 2


def test_versions(spark):
    df = spark.createDataFrame([("20240101_000000", "a/x.docx"), ("20240201_000000", "a/y.docx"), ("20240301_000000", "a/y.docx"), (None, "z")], "version string, source string")
    r = lambda w: versions.resolve(df, w)
    assert r("") == r("最新") == ["20240301_000000"]
    assert r("第二新") == ["20240201_000000"] and r("第三新") == ["20240101_000000"] and r("oldest") == ["20240101_000000"]
    assert r("前2个") == ["20240301_000000", "20240201_000000"] and r("最近3个") == []
    assert r("y.docx") == ["20240301_000000", "20240201_000000"] and r("202401") == ["20240101_000000"]
    assert versions.filtered(df, "nothing").count() == 4 and versions.filtered(df, "nothing", True).count() == 0
    assert [one(spark, t, versions.is_document_name) for t in ("20240101_000000", "2024", ".pdf", "最新", "", None)] == [False, False, True, True, False, False]


def test_case_rows(spark):
    rows = [(1, "s0", 2, ""), (2, "s1", 1, "A"), (3, "s2", 2, ""), (4, "", 2, None), (5, "s3", 1, ""), (6, "s4", 1, "B"), (7, "s5", 3, None), (8, "s6", 1, "A")]
    df = spark.createDataFrame([(a, b, c, d, None, None, "e\\nf") for a, b, c, d in rows], "seq long, step string, step_id int, name string, precondition string, priority string, expected string")
    assert [r.seq for r in cases.without_orphans(df).orderBy("seq").collect()] == [2, 3, 4, 5, 6, 7, 8]
    assert {r.seq: r.case_name for r in cases.attached(df).collect()} == {1: None, 2: "A", 3: "A", 4: "A", 5: None, 6: "B", 7: "B", 8: "A"}
    assert [(r.seq, r.case_number) for r in cases.numbered(df).filter("case_number > 0").orderBy("seq").collect()] == [(2, 1), (6, 2), (8, 3)]
    assert sorted(r.seq for r in cases.first_names(df).collect()) == [1, 2, 3, 4, 5, 6, 7]
    s = {r.seq: r for r in cases.sheet(df).collect()}
    assert 4 not in s and s[2].c10 == "e\nf" and s[8].c1 == 3 and s[3].c4 is None


def test_json_replies(spark):
    good = json.dumps([{"name": "n", "step_id": 1, "step": "a"}])
    rows = [(1, good), (2, f"```json\n{good}\n```"), (3, '[{"name": "n", "step_id": 1, "step": "a\nb"}]'), (4, '[{"name": "n", "step_id": 1, "step": "a"}, {"name": "m", "st'), (5, "[{'name': 'n', 'step_id': 1, 'step': 'a'}]"), (6, None), (7, "nothing")]
    got = {}
    for r in cases.reply_cases(spark.createDataFrame(rows, "k long, r string"), "k", "r").collect():
        got.setdefault(r.k, []).append((r.name, r.step_id, r.step))
    assert got[1] == got[2] == got[5] == [("n", 1, "a")]
    assert got[3] == [("n", 1, "a\\nb")] and got[4][0] == ("n", 1, "a")
    assert 6 not in got and 7 not in got
    assert not cases.is_complete("```[]```") and cases.is_complete('[{"a": 1}]')
    assert cases.markdown_cases("## 用例名称：登录\n- 前置条件：无\n1. 打开\n2. 提交")[0] == {"name": "登录", "steps": ["打开", "提交"], "precondition": "无"}


def test_manifest(spark):
    state = spark.createDataFrame([("./a", "1", 5, True, "2024-01-01"), ("a", "2", 5, False, "2024-01-02"), ("b\\c", "3", 5, True, "2024-01-01")], "path string, hash string, size long, image_processed boolean, p string").withColumn("processed_at", F.to_timestamp("p"))
    files = spark.createDataFrame([("a", "2"), ("b/c", "4"), ("d", "5")], "path string, hash string")
    assert sorted(r.path for r in manifest.changed(files, state).collect()) == ["b/c", "d"]
    assert sorted(r.path for r in manifest.changed(files, state, True).collect()) == ["a", "b/c", "d"]
    assert manifest.build_status(files, state.limit(0)).first().status == "none"


@pytest.mark.parametrize("seed", range(6))
def test_intervals_are_set_operations(spark, seed):
    rng = random.Random(seed)
    dense = rng.choice([0.1, 0.5, 0.9])
    a, b = ({k for k in range(rng.choice([0, 5, 400])) if rng.random() < dense} for _ in range(2))
    df = lambda s: spark.createDataFrame([(x,) for x in s] + [(None,)], "n long").repartition(3)
    ia, ib = (incremental.cut(incremental.intervals(df(x), "n")) for x in (a, b))
    expand = lambda d: [x for f, l in d.collect() for x in range(f, l + 1)]
    assert sorted(expand(ia)) == sorted(a)
    rows = sorted(map(tuple, ia.collect()))
    assert all(y[0] > x[1] + 1 for x, y in zip(rows, rows[1:], strict=False))
    assert sorted(expand(incremental.subtract(ia, ib))) == sorted(a - b)
    assert sorted(r.n for r in incremental.within(df(a), "n", ib).collect()) == sorted(a & b)


def test_long_and_overlapping_intervals_merge(spark):
    df = spark.createDataFrame([(0, 1 << 50), (5, 9), ((1 << 50) + 1, (1 << 50) + 4), ((1 << 51), 1 << 51)], "first long, last long")
    assert sorted(map(tuple, incremental.merged(df).collect())) == [(0, (1 << 50) + 4), (1 << 51, 1 << 51)]
    cut = incremental.subtract(df, spark.createDataFrame([(7, (1 << 50) + 2)], "first long, last long"))
    assert sorted(map(tuple, cut.collect())) == [(0, 6), ((1 << 50) + 3, (1 << 50) + 4), (1 << 51, 1 << 51)]


def test_file_changes_edge_cases(spark):
    scan = spark.createDataFrame([(1, "./a", "h1", "v1"), (2, "a", "h2", "v2"), (3, "b\\c", "x", None), (4, "d", "", "v1"), (5, None, "q", "v1"), (6, "e", "e1", "v1"), (7, "e", "e1", "v1")], "scan_id long, source string, file_hash string, version string")
    state = spark.createDataFrame([("a", "h2", "2024-01-02", 2), ("a", "h1", "2024-01-01", 1), ("b/c", "x", "2024-01-01", 1), ("e", "e0", "2024-01-01", 1), ("e", "e1", "2024-01-03", 9)], "path string, hash string, p string, run_id int").withColumn("processed_at", F.to_timestamp("p"))
    runs = spark.createDataFrame([(1, "Success"), (2, None)], "run_id int, status string")
    got = lambda s, t, r: sorted(x.scan_id for x in incremental.file_changes(s, t, r).collect())
    assert got(scan, state, runs) == [2, 6]
    assert got(scan, state.limit(0), runs) == [2, 3, 6]
    assert got(scan.limit(0), state, runs) == []


def test_interval_log_neither_skips_nor_repeats(spark, tmp_path):
    log = incremental.IntervalLog(spark, f"file://{tmp_path}/log")
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "n long")
    assert log.output() is None
    first = log.pending(rows([1, 2, 5]), "n")
    log.commit(first, first, "n")
    # A run that dies after its output was written, before its commit.
    rows([3]).write.parquet(f"{log.path}/data/lost")
    late = log.pending(rows([1, 2, 3, 4, 5, 6]), "n")
    assert sorted(r.n for r in late.collect()) == [3, 4, 6]
    log.commit(late, late, "n")
    assert sorted(r.n for r in log.output().collect()) == [1, 2, 3, 4, 5, 6]
    assert sorted(map(tuple, log.processed().collect())) == [(1, 6)]
    assert log.pending(rows([1, 6]), "n").isEmpty()


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml").replace("_json", ".json"), text)
    return out.getvalue()


def test_sources_and_engine(spark, tmp_path, monkeypatch):
    from foliomill import engine
    from foliomill.engine import KnowledgeBase
    from foliomill.sources import files, office

    p = lambda t: f'<w:p xmlns:w="w"><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    doc = f'<w:document xmlns:w="w"><w:body>{p("Intro")}<w:tbl><w:tr>{cell("h1")}{cell("h2")}</w:tr><w:tr>{cell("a")}{cell("")}</w:tr></w:tbl></w:body></w:document>'
    assert office.docx(zipped(word__document_xml=doc))["text"] == "Intro\n\n| h1 | h2 |\n|---|---|\n| a |   |"
    sheet = '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>k</t></is></c><c r="C1"><v>2</v></c></row></sheetData></worksheet>'
    assert "| k |  | 2 |" in office.xlsx(zipped(**{"xl__workbook_xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl__worksheets__sheet1_xml": sheet}))["text"]
    assert office.xmind(zipped(content_json=json.dumps([{"rootTopic": {"title": "r", "children": {"attached": [{"title": "c"}]}}}])))["text"] == "# r\n## c"
    assert "a\nb" in office.pptx(zipped(ppt__slides__slide1_xml='<s xmlns:a="a"><sp><a:p><a:r><a:t>a</a:t></a:r></a:p><a:p><a:r><a:t>b</a:t></a:r></a:p></sp></s>'))["text"]
    src = tmp_path / "src" / "仓储"
    src.mkdir(parents=True)
    (src / "a.md").write_text("# 入库\n" + "同步入库单的状态需要检查库存数量。" * 8, "utf-8")
    (src / "b.csv").write_bytes("名,值\n甲,1\n".encode("gbk"))
    (src / "bad.docx").write_bytes(b"no zip")
    (src / "skip.exe").write_bytes(b"x")
    got = {r.source.rsplit("/", 1)[-1]: r for r in files.load_documents(spark, f"file://{tmp_path}/src", "20240101_000000").collect()}
    assert set(got) == {"a.md", "b.csv", "bad.docx"} and got["b.csv"].page_content == "名: 甲\n值: 1" and got["bad.docx"].page_content is None
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    commit, kb._commit = kb._commit, lambda *a: (_ for _ in ()).throw(OSError("the driver is lost"))
    with pytest.raises(OSError):
        kb.build(f"file://{tmp_path}/src", "20240101_000000")
    assert kb.chunks().isEmpty() and kb.state().isEmpty()
    kb._commit = commit
    assert kb.build(f"file://{tmp_path}/src", "20240101_000000") == 2
    once = kb.chunks().count()
    assert once and kb.chunks().select("chunk_id").distinct().count() == once
    opened = []
    monkeypatch.setattr(engine, "load_documents", lambda s, p, *a: opened.append(p) or files.load_documents(s, p, *a))
    assert kb.build(f"file://{tmp_path}/src", "20240102_000000") == 0
    assert all(p.endswith("bad.docx") for batch in opened for p in batch)  # what failed is tried again, nothing else is opened
    (src / "c.txt").write_text("出库单与同步状态的核对说明，" * 8, "utf-8")
    opened.clear()
    assert kb.build(f"file://{tmp_path}/src", "20240102_000000") == 1 and sorted(p.rsplit("/", 1)[-1] for p in opened[0]) == ["bad.docx", "c.txt"]
    hit = kb.retrieve("同步状态").collect()
    assert hit and {r.module for r in hit} == {"仓储"} and hit[0].rerank >= hit[-1].rerank
    assert "同步" in kb.ask("同步状态")
    assert kb.retrieve("同步状态", "20240102_000000").count() == kb.retrieve("同步", "c_V20240102_000000").filter("source like '%c.txt'").count() == 1
    assert kb.filtered_retrieve("同步状态", {"module": "仓储"}).count() and kb.advanced_retrieve("同步状态", conditions={"module": "无"}).isEmpty()
    assert {r.source.rsplit("/", 1)[-1] for r in kb.parent_retrieve("同步状态").collect()} == {"a.md", "c.txt"}
    assert kb.multi_retrieve("同步状态", ["库存数量"]).count() == kb.multi_retrieve("同步状态", []).count() == 2
    assert kb.requested_retrieve("同步", "oldest, c_V").first().source.endswith("c.txt")
    assert kb.preview(kb.retrieve("同步")).columns == ["source", "version", "preview"]
    assert kb.advanced_retrieve("库存", [{"role": "user", "content": "同步"}]).count()
    kb.add_documents(spark.createDataFrame([("note", "h", "20240103_000000", "txt", 0, "同步补充说明。" * 10)], "source string, file_hash string, version string, type string, part int, page_content string"))
    assert not kb.chunks().filter("source = 'note'").isEmpty() and "note" in {r.source for r in kb.retrieve("同步补充").collect()}
    kb.delete("note")
    assert kb.chunks().filter("source = 'note'").isEmpty() and "note" not in {r.source for r in kb.retrieve("同步补充").collect()}
    assert kb.build(f"file://{tmp_path}/src", "20240104_000000", rebuild=True) == 3 and {r.version for r in kb.chunks().collect()} == {"20240104_000000"}


def test_inverted_index_scores_as_the_scan(spark):
    df = spark.createDataFrame([(1, "a a b"), (2, "a c"), (3, "a d d"), (4, "b"), (5, None)], "k long, t string")
    index = search.postings(df, "k", "t")
    stats = search.index_stats(index, "k")
    for q in (["a", "d", "d"], ["b"], ["zz"], []):
        want = {r.k: round(r.bm25, 9) for r in search.bm25(df, "k", "t", q).collect()}
        assert {r.k: round(r.bm25, 9) for r in search.bm25_of(index, "k", q, stats).collect()} == want


def test_requests_rewrites_and_chat_tags(spark):
    from foliomill.plugins import EchoChat, rewritten

    class Scripted:
        def __init__(self, reply):
            self.reply = reply

        def chat(self, messages):
            if self.reply is None:
                raise OSError("no line")
            return self.reply

    df = spark.createDataFrame([("20240101_000000", "a/x.docx"), ("20240201_000000", "a/y.docx"), ("20240301_000000", "a/y.docx")], "version string, source string")
    assert versions.requested(df, "20240101_000000, 第二新, 手册") == (["20240201_000000", "20240101_000000"], "手册")
    assert versions.requested(df, None) == ([], None) and versions.requested(df, "最新") == (["20240301_000000"], None)
    assert versions.of_versions(df, ["20240101_000000", "20240301_000000"]).count() == 2 and versions.of_versions(df, []).isEmpty()
    assert rewritten(Scripted(" a \n\nb\nc"), "q") == ["q", "a", "b"] and rewritten(Scripted(None), "q") == ["q"] and rewritten(EchoChat(), "q") == ["q"]
    rows = spark.createDataFrame([(0, "x" * 600, ""), (1, "x" * 600, ""), (3, "short", "title"), (6, "short", ""), (9, None, "t")], "n int, t string, h string")
    got = {r.n: r.chat_tags for r in labels.chat_tags(rows, "t", "h", "n", Scripted("a, b., ,c,d,e,f")).collect()}
    assert got == {0: ["a", "b", "c", "d", "e"], 1: [], 3: ["a", "b", "c", "d", "e"], 6: [], 9: []}


def test_word_tables_images_and_names():
    from foliomill.plugins import SizeVision
    from foliomill.sources import files, office

    p = lambda t: f'<w:p xmlns:w="w"><w:r><w:t>{t}</w:t></w:r></w:p>'
    cell = lambda t, more="": f"<w:tc><w:tcPr>{more}</w:tcPr>{p(t)}</w:tc>"
    row = lambda *c: f"<w:tr>{''.join(c)}</w:tr>"
    table = row(cell("Title", '<w:gridSpan w:val="2"/>')) + row(cell("column with a long name"), cell("b")) + row(cell("x", '<w:vMerge w:val="restart"/>'), cell("1")) + row(cell("", "<w:vMerge/>"), cell("2"))
    got = office.docx(zipped(word__document_xml=f'<w:document xmlns:w="w"><w:body><w:tbl>{table}</w:tbl></w:body></w:document>'))
    assert got["text"] == "Title\n\n| column with a long name | b |\n|---|---|\n| x | 1 |\n| x | 2 |" and got["table_headers"] == ["column with a long n | b"]
    assert office.image_block([]) == "" and office.image_block(["a", "b"]).endswith("[图片1: a]\n\n[图片2: b]")
    assert SizeVision().describe(b"\x89PNG1234") == "png, 8 bytes"
    assert [office.upload_name(x) for x in ("a/b c.txt", "需求 1.docx", "..\\..", "../../etc/p")] == ["b_c.txt", "需求 1.docx", "file", "p"]
    assert files.parts_of(".txt", "x".encode())[0]["text"] == "x"


def test_generation_loop_and_workbook(spark, tmp_path):
    from foliomill.operators import generate
    from foliomill.sources import office

    class Scripted:
        replies = ["no json", json.dumps([{"name": "", "step_id": 2, "step": "orphan"}, {"name": "A", "step_id": 1, "step": "x"}]), json.dumps([{"name": "A", "step_id": 1, "step": "again"}, {"name": "B", "step_id": 1, "step": "y"}, {"name": "", "step_id": 2, "step": "z"}])]

        def chat(self, messages):
            return self.replies.pop(0) if self.replies else "[]"

    got = generate.generate(spark, Scripted(), "q", "c", 10, 5)
    assert [(r.name, r.step, r.case_name, r.case_number) for r in got.orderBy("seq").collect()] == [("A", "x", "A", 1), ("B", "y", "B", 2), ("", "z", "B", None)]
    generate.sheet_file(got, f"{tmp_path}/s.xlsx")
    with open(f"{tmp_path}/s.xlsx", "rb") as f:
        assert "| 2 |   |   | B |" in office.xlsx(f.read())["text"]
    generate.report_files(got, f"file://{tmp_path}/report")
    assert any("## B" in r.value for r in spark.read.text(f"file://{tmp_path}/report").collect())


def test_stream_takes_each_file_once(spark, tmp_path):
    from foliomill.streaming.ingest import append_new

    src, sink, ck = (f"file://{tmp_path}/{x}" for x in ("src", "sink", "ck"))
    spark.createDataFrame([(1,), (2,)], "n long").write.parquet(src)
    for more in (None, [(3,)]):
        if more:
            spark.createDataFrame(more, "n long").write.mode("append").parquet(src)
        append_new(spark, src, "n long", lambda d: d, sink, ck).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_conversation_and_supplement(spark):
    m = spark.createDataFrame([(1, 1, " User", "q"), (1, 2, "bot", "a"), (1, 2, "bot", "a"), (1, 3, None, None)], "c long, t int, r string, x string")
    assert search.conversation(m, "c", "t", "r", "x").first().history == "user: q\nassistant: a"
    a, b = (spark.createDataFrame([(x,) for x in rows], "t string") for rows in (["p" * 120], ["p" * 110, "q"]))
    assert sorted(r.t for r in search.supplemented(a, b, "t").collect()) == ["p" * 120, "q"]


def test_catalogue_has_names_for_all_statements():
    from foliomill.plans import catalog

    assert set(catalog.oracle_sql()) <= set(catalog.queries())
