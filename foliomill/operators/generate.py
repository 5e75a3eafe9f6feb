"""Case generation over a chat client: batches until enough rows, then the row operators; sheets and reports as files."""

from __future__ import annotations

import io
import math
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plugins import ChatClient
from . import cases

FIELDS = ("name", "step_id", "step", "precondition", "priority", "expected")
SCHEMA = "seq long, name string, step_id int, step string, precondition string, priority string, expected string"
TRIES = 3


def batch(chat: ChatClient, question: str, context: str, examples: list[dict], count: int, done: list[str]) -> list[dict]:
    """Rows of one reply; a reply without any is asked for again, with a reminder, up to TRIES times."""
    text = cases.prompt(question, context, examples, count, done)
    for k in range(TRIES):
        rows = cases.parsed_cases(chat.chat([{"role": "user", "content": text}]), count)
        if rows:
            return rows
        text += f"\n\nReminder {k + 1}: answer with the JSON array alone."
    return []


def generate(spark: SparkSession, chat: ChatClient, question: str, context: str, count: int = 10, per_batch: int = 5, examples: list[dict] | None = None) -> DataFrame:
    """Case rows (count is in rows, sub-steps included): batches until there are enough or the limit of batches is reached; repeated
    names and orphaned steps are dropped, steps attached and numbered."""
    rows: list[dict] = []
    for _ in range(math.ceil(count / per_batch) * TRIES * 3):
        if len(rows) >= count:
            break
        got = batch(chat, question, context, examples or [], min(per_batch, count - len(rows)), [r["name"] for r in rows if r.get("name")])
        known = {r["name"] for r in rows if r.get("name")}
        fresh = [r for r in got if not r.get("name") or r["name"] not in known]
        if not fresh:
            break
        rows += fresh
    as_int = lambda v: int(v) if str(v).isdigit() else None
    data = [(k, *(as_int(r.get(f)) if f == "step_id" else None if r.get(f) is None else str(r[f]) for f in FIELDS)) for k, r in enumerate(rows[:count])]
    df = cases.first_names(spark.createDataFrame(data, SCHEMA))
    return cases.numbered(cases.attached(cases.without_orphans(df)))


def column_name(k: int) -> str:
    return chr(64 + k) if k <= 26 else column_name((k - 1) // 26) + chr(65 + (k - 1) % 26)


def xlsx(rows: list[list], title: str = "cases") -> bytes:
    """A workbook with one sheet of inline strings and numbers."""
    def cell(r, c, v):
        at = f'r="{column_name(c)}{r}"'
        if v is None:
            return ""
        return f"<c {at}><v>{v}</v></c>" if isinstance(v, int) else f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join(f'<row r="{r}">{"".join(cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(rows, 1))
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{pkg}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{pkg}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def sheet_file(df: DataFrame, path: str, order: str = "seq") -> None:
    """Write the ten-column sheet of one generation (not of a corpus: it is one file) as a workbook."""
    rows = cases.sheet(df, order).orderBy(order).drop(order).toLocalIterator()
    with open(path, "wb") as f:
        f.write(xlsx([list(r) for r in rows]))


def report_files(df: DataFrame, path: str, order: str = "seq") -> None:
    """Write the markdown report as text files, in order."""
    cases.report(df, order).orderBy(order).select(F.concat("markdown", F.lit("\n"))).write.mode("overwrite").text(path)
