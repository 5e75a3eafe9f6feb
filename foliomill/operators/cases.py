"""Test-case rows: attaching, numbering and deduplicating steps, parsing and repairing replies, reports and sheets."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import running
from ..functions.text import strip

CASE = T.ArrayType(T.StructType([T.StructField(f, T.IntegerType() if f == "step_id" else T.StringType()) for f in ("name", "step_id", "step", "precondition", "priority", "expected")]))


def _name() -> Column:
    return strip(F.coalesce("name", F.lit("")))


def is_main() -> Column:
    """A case's first step: step 1 with a name."""
    return (F.coalesce("step_id", F.lit(0)) == 1) & (_name() != "")


def without_orphans(df: DataFrame, order: str = "seq", part: str | None = None) -> DataFrame:
    """Rows but for later steps with text that no main step precedes; all else stays."""
    sub = (F.coalesce("step_id", F.lit(0)) > 1) & (strip(F.coalesce("step", F.lit(""))) != "")
    return running(df, order, part, sums={"mains": F.when(is_main(), 1).otherwise(0)}).filter(~(sub & (F.col("mains") == 0))).drop("mains")


def attached(df: DataFrame, order: str = "seq", part: str | None = None) -> DataFrame:
    """df with case_name: a main step's own name, for unnamed later steps that of the latest main step, else null."""
    main = running(df, order, part, lasts={"latest": F.when(is_main(), _name())})
    sub = (F.coalesce("step_id", F.lit(0)) > 1) & (_name() == "")
    return main.withColumn("case_name", F.when(is_main(), _name()).when(sub, F.col("latest"))).drop("latest")


def numbered(df: DataFrame, order: str = "seq", part: str | None = None) -> DataFrame:
    """df with case_number on main steps: their running count."""
    out = running(df, order, part, sums={"mains": F.when(is_main(), 1).otherwise(0)})
    return out.withColumn("case_number", F.when(is_main(), F.col("mains"))).drop("mains")


def first_names(df: DataFrame, order: str = "seq") -> DataFrame:
    """Rows but for named ones whose name came earlier; rows without name stay."""
    first = df.filter(_name() != "").groupBy(_name().alias("__k")).agg(F.min(order).alias(order))
    return df.filter(_name() == "").unionByName(df.join(first.select(order), order, "left_semi").filter(_name() != ""))


def real_newlines(c: Column) -> Column:
    return F.replace(c, F.lit("\\n"), F.lit("\n"))


def literal_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\\n"))


def sheet(df: DataFrame, order: str = "seq", part: str | None = None) -> DataFrame:
    """The ten-column sheet: case number, name and priority on main steps, precondition, step and expected with real newlines.

    Rows with a blank step are left out first."""
    rows = numbered(df.filter(strip(F.coalesce("step", F.lit(""))) != ""), order, part)
    one = F.coalesce("step_id", F.lit(0)) == 1
    empty = F.lit(None).cast("string")
    return rows.select(
        order, F.col("case_number").alias("c1"), empty.alias("c2"), empty.alias("c3"), F.when(one, F.col("name")).alias("c4"), empty.alias("c5"), real_newlines(F.col("precondition")).alias("c6"),
        F.when(one, F.col("priority")).alias("c7"), F.col("step_id").alias("c8"), real_newlines(F.col("step")).alias("c9"), real_newlines(F.col("expected")).alias("c10"),
    )


def report(df: DataFrame, order: str = "seq") -> DataFrame:
    """(order, markdown): a heading and fields a row, as a markdown report."""
    field = lambda label, c: F.when(strip(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"- {label}: "), F.col(c)))
    return df.select(order, F.concat_ws("\n", F.when(is_main(), F.concat(F.lit("## "), _name())), field("precondition", "precondition"), field("priority", "priority"), F.concat(F.lit("- step "), F.col("step_id"), F.lit(": "), F.col("step")), field("expected", "expected")).alias("markdown"))


# -- replies of chat models ---------------------------------------------------------------------------------------


def unfenced(text: str) -> str:
    m = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    return (m.group(1) if m else text).strip()


def escaped_newlines(text: str) -> str:
    """Raw newlines inside JSON strings as escapes, carriage returns out."""
    out, inside, skip = [], False, False
    for c in text.replace("\r", ""):
        if skip:
            skip = False
        elif c == "\\":
            skip = inside
        elif c == '"':
            inside = not inside
        elif c == "\n" and inside:
            out.append("\\n")
            continue
        out.append(c)
    return "".join(out)


def is_complete(text: str) -> bool:
    """Balanced brackets and quotes; brackets count inside strings too, a fence makes it incomplete."""
    x = text.strip()
    return x[:1] in ("[", "{") and x[-1:] in ("]", "}") and x.count("[") == x.count("]") and x.count("{") == x.count("}") and len(re.findall(r'(?<!\\)"', x)) % 2 == 0


def closed(text: str) -> str:
    """A cut reply from its first bracket: the open string closed, dangling separators dropped, brackets closed in order."""
    start = min((k for k in (text.find("["), text.find("{")) if k >= 0), default=-1)
    if start < 0:
        return ""
    stack, inside, skip = [], False, False
    x = text[start:]
    for c in x:
        if skip:
            skip = False
        elif inside:
            skip, inside = c == "\\", c != '"'
        elif c == '"':
            inside = True
        elif c in "[{":
            stack.append("]" if c == "[" else "}")
        elif c in "]}" and stack:
            stack.pop()
    x = x + '"' * inside
    if stack and stack[-1] == "}":
        x = re.sub(r',\s*"[^"]*"\s*:?\s*$', "", x) if re.search(r'[{,]\s*"[^"]*"\s*:?\s*$', x) and not re.search(r':\s*"[^"]*"\s*$', x) else x
    return re.sub(r"[,\s]+$", "", x) + "".join(reversed(stack))


FIELD = {f: re.compile(rf"""["']?{f}["']?\s*:\s*["']([^"']*)["']""", re.S) for f in ("name", "step", "precondition", "priority", "expected")}
STEP_ID = re.compile(r"""["']?step_id["']?\s*:\s*(\d+)""")


def block_fields(block: str) -> dict:
    """A case from a damaged object: each field by its pattern."""
    out = {f: m.group(1).strip() for f, p in FIELD.items() if (m := p.search(block))}
    if m := STEP_ID.search(block):
        out["step_id"] = int(m.group(1))
    return out


def parsed_cases(reply: str | None, expected: int | None = None) -> list[dict]:
    """Cases of a reply: parsed as it is, then with the cut end closed, then object by object, keeping those with a name or step."""
    if not reply:
        return []
    x = escaped_newlines(unfenced(reply))
    for attempt in (x, closed(x)):
        try:
            got = json.loads(attempt)
        except ValueError:
            continue
        rows = [r for r in (got if isinstance(got, list) else [got]) if isinstance(r, dict)]
        if rows:
            return [r | {"step": str(r["step"]).replace("\n", "\\n")} if r.get("step") else r for r in rows]
    rows = [c for b in re.findall(r"\{[^{}]*\}?", x) if (c := block_fields(b)).get("name") or c.get("step")]
    return [{k: v.replace("\n", "\\n") if isinstance(v, str) else v for k, v in r.items()} for r in rows][:expected]


def reply_cases(df: DataFrame, key: str, reply: str) -> DataFrame:
    """(key, case_index, name, step_id, step, precondition, priority, expected) of replies; well-formed arrays are parsed in the JVM,
    only what fails goes through the repair in Python."""
    good = F.from_json(F.col(reply), CASE, {"mode": "PERMISSIVE"})
    ok = F.coalesce(F.trim(reply).startswith("[") & good.isNotNull() & (F.size(good) > 0), F.lit(False))
    direct = df.filter(ok).select(key, F.posexplode(good).alias("case_index", "c")).select(key, "case_index", "c.*")
    kind = df.schema[key].dataType.simpleString()
    fields = ("name", "step_id", "step", "precondition", "priority", "expected")

    def mend(batches):
        as_int = lambda v: int(v) if str(v).isdigit() else None
        for b in batches:
            rows, no, found = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                got = parsed_cases(text)
                rows += [k] * len(got)
                no += range(len(got))
                found += [[as_int(r.get(f)) if f == "step_id" else None if r.get(f) is None else str(r[f]) for f in fields] for r in got]
            columns = list(zip(*found, strict=True)) if found else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), *(pa.array(c, pa.int32() if f == "step_id" else pa.string()) for f, c in zip(fields, columns, strict=True))], names=["key", "case_index", *fields])

    schema = f"key {kind}, case_index int, " + ", ".join(f"{f} {'int' if f == 'step_id' else 'string'}" for f in fields)
    rest = df.filter(~ok).filter(F.col(reply).isNotNull()).select(F.col(key).alias("key"), F.col(reply).alias("reply")).mapInArrow(mend, schema).withColumnRenamed("key", key)
    return direct.unionByName(rest).withColumn("step", literal_newlines(F.col("step")))


def markdown_cases(text: str) -> list[dict]:
    """Cases of a markdown reply: a heading starts one, labelled lines fill it, numbered lines are its steps."""
    labels = {"前置条件": "precondition", "precondition": "precondition", "优先级": "priority", "priority": "priority", "预期结果": "expected", "expected": "expected"}
    out: list[dict] = []
    for line in text.split("\n"):
        x = line.strip()
        if m := re.match(r"^#{2,6}\s+(.*)", x):
            out.append({"name": re.sub(r"^(?:用例名称|case)\s*\d*\s*[：:.]\s*", "", m.group(1)).strip(), "steps": []})
        elif out and (m := re.match(r"^[-*\s]*\**([^：:*]+?)\**\s*[：:]\s*(.+)$", x)) and m.group(1).strip().lower() in labels:
            out[-1][labels[m.group(1).strip().lower()]] = m.group(2).strip()
        elif out and (m := re.match(r"^[-*\s]*(\d+)\s*[.、)]\s*(.+)$", x)):
            out[-1]["steps"].append(m.group(2).strip())
    return out


def prompt(question: str, context: str, examples: list[dict], count: int, done: list[str]) -> str:
    """Prompt for more cases: context, examples, the names already present (at most 20) and the wanted form."""
    parts = [f"Write {count} test cases for: {question}", f"Context:\n{context}"]
    if examples:
        parts.append("Examples:\n" + json.dumps(examples, ensure_ascii=False))
    if done:
        parts.append("Already present: " + "; ".join(done[-20:]))
    parts.append("Answer with a JSON array of objects with name, step_id, step, precondition, priority, expected. Only step 1 has a name.")
    return "\n\n".join(parts)


def distinct_names(df: DataFrame) -> DataFrame:
    """(cases, named, rows): distinct names, first steps, rows."""
    return df.agg(F.countDistinct(F.when(_name() != "", _name())).alias("cases"), F.count_if(F.coalesce("step_id", F.lit(0)) == 1).alias("first_steps"), F.count("*").alias("rows"))


