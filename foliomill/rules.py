"""Rule packs: the patterns and word lists that operators are parametrised with."""

from __future__ import annotations

# Patterns, word lists and limits whose results must be kept. All patterns are matched from the start
# of a stripped line unless said otherwise.

# Page numbers in headers and footers.
PAGE_LINES = (r"^第\s*\d+\s*页\s*$", r"^\d+\s*$", r"^\s*Page\s+\d+\s*$", r"^第\s*[一二三四五六七八九十百千]+\s*页\s*$")
# Watermarks.
WATERMARK_LINES = (r"^(内部资料|机密|绝密|草稿|未生效|DRAFT)$", r"^\[?\s*(内部|机密|秘密)\s*\]?$")
# Headings of word-processor documents, first match wins.
WORD_HEADINGS = (
    r"^(\d+(?:\.\d+)*)\s+([^\d].*)$",
    r"^([IVXLC]+)\.\s+(.*)$",
    r"^第([一二三四五六七八九十百千\d]+)\s*[章篇节条]\s+(.*)$",
    r"^(\([一二三四五六七八九十\d]+\))\s+(.*)$",
)
# Lines of a document's metadata table.
METADATA_LINES = (
    r"^文档编号\s*", r"^项目名称\s*", r"^需求名称\s*", r"^程\s*序\s*名\s*", r"^事务代码\s*", r"^关键用户\s*", r"^用\s*户\s*", r"^业务顾问\s*",
    r"^版\s*本\s*", r"^分\s*类\s*", r"^需求类型\s*", r"^开发类型\s*", r"^运行频率\s*", r"^优先级别\s*", r"^基本内容\s*", r"^基本\s*内容\s*",
)
# Start of a table of contents, and its entries.
TOC_STARTS = (r"^目\s*录$", r"^目\s*录\s", r"^TOC$", r"^Table of Contents")
TOC_ENTRIES = (r"^\d+[\.. ]", r"^第.*章", r"^第.*节")
TOC_LINES = 50
# Start of an approval region.
APPROVAL_STARTS = (r"^审\s*批\s*内\s*容", r"^修改历史", r"^签名\s*", r"^功能规范确认", r"^供应商", r"^程序测试确认")
# Headings that end a skipped region.
REAL_HEADINGS = (r"^\d+\.\d+\s+", r"^\d+\s+[^\d\s]", r"^第[一二三四五六七八九十百千\d]+[章篇节条]", r"^#{1,6}\s+", r"^\([一二三四五六七八九十\d]+\)\s+", r"^[IVX]+\.\s+")
# Rules drawn with characters.
SEPARATORS = (r"^[－\-=]{3,}$", r"^\s*[｜|]\s*$", r"^[\s│┆├─┣┤┴┬┼]+\s*$")
# Words of titles that become tags.
TITLE_WORDS = ("概述", "简介", "介绍", "定义", "说明", "要求", "规范", "标准", "流程", "步骤", "方法", "方案", "总结", "结论")
# Scenario words by type, in the order in which ties are settled.
SCENARIO_WORDS = {
    "positive": ("成功", "通过", "正常", "正确", "有效", "完成", "允许"),
    "negative": ("失败", "不通过", "异常", "错误", "拒绝", "无效", "禁止", "不能", "无法", "不存在", "不等于"),
    "boundary": ("最大", "最小", "最多", "最少", "边界", "临界", "上限", "下限", "等于"),
}
# Titles of sections that hold no scenario, and metadata lines of such sections.
SCENARIO_SKIPPED = (r"^基本信息", r"^背景描述", r"^开发目的", r"^程序性能", r"^运行环境", r"^附件/样本", r"^审批内容", r"^修改历史", r"^版本更新", r"^程序测试")
SCENARIO_METADATA = (
    r"^文档编号", r"^项目名称", r"^需求名称", r"^程序名", r"^事务代码", r"^关键用户", r"^业务顾问", r"^需求日期", r"^版本", r"^分类", r"^需求类型", r"^开发类型", r"^运行频率", r"^优先级别",
)
SECTION_NUMBER = r"^(\d+\.\d+\.\d+)\s*([^\d\n][^\n]*)$"
# Rules, entities and test points inside a text (searched anywhere).
RULE_PATTERNS = (r"[如果当若假设]([^。，,]+?)[，,]([^。，。]+?)[。\n]", r"[是否]([^。，,]+?)[，。](?:则)?([^。，。]+?)[。\n]", r"当([^。，,]+?)时[，,]([^。，。]+?)[。\n]")
POINT_PATTERNS = (r"[需要必须应当]([^。，,]+?)[。\n]", r"验证([^。，,]+?)[。\n]", r"检查([^。，,]+?)[。\n]", r"确保([^。，,]+?)[。\n]")
ENTITY_PATTERN = r"[a-z_][a-z0-9_]*\.[a-z_][a-z0-9_]*"
ENTITY_STOP = ("and", "or", "not", "in", "is", "null", "true", "false", "if", "else", "then")
# Words that mark a text as test cases, and structures that are kept whole (searched anywhere).
CASE_WORDS = ("用例名称", "测试步骤", "预期结果", "前置条件", "步骤ID", "优先级")
CASE_STRUCTURES = (r"用例名称[：:][^\n]+", r"前置条件[：:][^\n]+", r"优先级[：:][^\n]+", r"步骤ID[：:][^\n]+", r"测试步骤[：:][^\n]+", r"预期结果[：:][^\n]+", r"\d+[、.、]((?:(?!预期结果).)+)")
SENTENCE_MARKS = "。！？.!?\n"
CLAUSE_MARKS = "，、；,;"
# File suffixes that are read.
SUFFIXES = (".txt", ".md", ".pdf", ".csv", ".json", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".xmind", ".vsdx", ".vsd")
DECODERS = ("utf-8", "gbk", "gb2312", "gb18030", "utf-8-sig", "latin1")
# Limits.
CHUNK_SIZE, CHUNK_OVERLAP, SHORT_CHUNK, SHORT_ROW, SHORT_DOC = 1500, 300, 50, 50, 20
TOP_K, WEIGHT_VECTOR, WEIGHT_BM25 = 5, 0.5, 0.3
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
# Version words: newest, oldest, second and third newest.
VERSION_WORDS = {
    "first": ("最新", "最新版本", "newest", "latest"),
    "last": ("最旧", "最早", "oldest", "earliest"),
    "second": ("第二新", "倒数第二", "2nd newest"),
    "third": ("第三新", "倒数第三", "3rd newest"),
}
NAME_SUFFIXES = (".docx", ".doc", ".pdf", ".xlsx", ".xls", ".txt", ".md")
