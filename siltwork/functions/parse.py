"""Items, records and blocks out of generated text. All but pyrepr_to_json are JVM expressions. Null gives an empty
array, or null where one value is asked for."""

from __future__ import annotations

import ast
import json
import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siltwork.functions import text as T

# Patterns of weakness tags, keywords of specialties, acronyms that are words.
WEAKNESSES = {
    "missing_baseline": r"baseline|comparison|benchmark|state.of.the.art|sota",
    "limited_scope": r"narrow|limited|specific|only\s+tested|single\s+(domain|dataset|task)",
    "scalability": r"scal|large.scale|compute|cost|memory|overhead|efficient",
    "statistical": r"statistic|significance|variance|confidence|error.bar|p.value|repeated",
    "novelty": r"incremental|marginal|trivial|well.explored|prior.work|already",
    "reproducibility": r"reproduc|replicate|code|implementation|detail|hyperparameter",
    "ablation": r"ablation|component|contribution|isolat",
    "generalization": r"generaliz|transfer|out.of.distribution|ood|domain.shift|robustness",
    "data_quality": r"bias|imbalance|representative|annotation|noise|label",
    "clarity": r"clarity|writing|unclear|ambiguous|notation|definition",
}
SPECIALTIES = {
    "novelty_significance": ["novel", "novelty", "significance", "contribution", "incremental", "original", "prior work", "impact", "motivation"],
    "theoretical_methodological": ["theoretical", "theory", "assumption", "proof", "derivation", "method", "methodolog", "ablation", "component", "formulation"],
    "experimental_evaluation": ["experiment", "evaluation", "baseline", "metric", "statistical", "significance test", "comparison", "benchmark", "result", "error bar"],
    "generalization_robustness_efficiency": ["generaliz", "robust", "efficien", "latency", "compute", "cost", "out-of-distribution", "ood", "scalab", "deployment", "resource"],
    "clarity_interpretability_reproducibility": ["clarity", "clear", "interpret", "explain", "reproduc", "replicat", "code", "seed", "hyperparameter", "document"],
    "data_ethics": ["data", "dataset", "bias", "fairness", "ethic", "privacy", "label", "annotation", "representative", "societal"],
}
PLAIN_WORDS = ("THE", "AND", "FOR", "WITH", "FROM", "THIS", "THAT", "ARE", "NOT", "BUT", "HAS", "WAS", "HIS", "HER", "OUR", "CAN", "ALL", "ITS")
SYSTEM_PROMPT = (
    "You are an expert scientific paper reviewer. Your task is to identify ALL limitations "
    "of the given paper. Be thorough, specific, and evidence-grounded."
)


def stripped(c: Column, characters: str = r"\s") -> Column:
    return F.regexp_replace(c, f"^[{characters}]+|[{characters}]+$", "")


def lines(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), r"\r\n|\n|\r")


def bullets(c: Column, over: int = 20) -> Column:
    """Items of a bulleted text, with the lines that follow them; without bullets, parts between numbers or blank
    lines. Thoughts in <think> are left out, white space is single; items of up to so many characters go."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", " ")
    marked = F.regexp_extract_all(t, F.lit(r"(?msd)^\s*[-*•]\s+(.+?)(?=\n\s*[-*•]\s|\z)"), F.lit(1))
    items = F.when(F.size(marked) > 0, marked).otherwise(F.split(t, r"\n\s*\d+\.\s+|\n\n+"))
    return F.filter(F.transform(items, T.collapse_space), lambda x: F.length(x) > over)


# The lines of a merged report.
REPORT_MARK = r"(?:-|\*|\d+\.)"
REPORT_INTRODUCTIONS = ("consolidated list", "limitations identified")
REPORT_EVIDENCE = rf"(?i)^{REPORT_MARK}?\s*[*_]*Evidence[*_]*\s*:"
REPORT_BOLD = r"^\*\*(.*?)\*\*:?$"
REPORT_TITLE = r"^(?:####|###)\s+(.*)$"
REPORT_INLINE = rf"^{REPORT_MARK}\s*[*_]+(.*?)[*_]+\s*:\s*(.*)$"
REPORT_NAMED = rf"(?i)^{REPORT_MARK}\s*[*_]*Limitation[*_]*\s*:\s*(.*)$"
REPORT_ITEM = rf"^{REPORT_MARK}\s+(.*)$"
REPORT_EDGE = r"*:\- "


def reference_items(c: Column, over: int = 10) -> Column:
    """Lines without their list marks that are longer than so many characters."""
    return F.filter(F.transform(lines(c), lambda x: stripped(F.regexp_replace(x, r"^\s*[-*•\d.]+\s*", ""))), lambda x: F.length(x) > over)


def numbered_lines(c: Column) -> Column:
    """(id, text) of lines that aren't blank; ids count all lines from 0, so they have gaps."""
    every = F.transform(F.split(stripped(F.coalesce(c, F.lit(""))), "\n"), lambda x, i: F.struct(i.alias("gt_id"), stripped(x).alias("gt_text")))
    return F.filter(every, lambda x: x["gt_text"] != "")


def report_items(c: Column) -> Column:
    """Items (llm_id, category, limitation) of a merged report. A line is a category (bold or ###), an item with a bold
    category, an item after "Limitation:", a list item, or goes on with the item before; evidence and the report's
    introduction are skipped. Lines are told apart by one match each, items come from one fold over them."""
    bare = F.filter(F.transform(lines(c), lambda x: stripped(x, r"\s '\"")), lambda x: x != "")
    skipped = lambda x: reduce(or_, [F.contains(F.lower(x), F.lit(p)) for p in REPORT_INTRODUCTIONS], x.rlike(REPORT_EVIDENCE))
    bold, title, inline, named, item, edge = REPORT_BOLD, REPORT_TITLE, REPORT_INLINE, REPORT_NAMED, REPORT_ITEM, REPORT_EDGE

    def told(x: Column) -> Column:
        line = lambda starts, category, body: F.struct(F.lit(starts).alias("starts"), category.alias("category"), body.alias("body"))
        none, nothing = F.lit(None).cast("string"), F.lit("")
        got = lambda p, g=1: F.regexp_extract(x, p, g)
        return (
            F.when(x.rlike(bold), line(True, stripped(got(bold)), nothing))
            .when(x.rlike(title), line(True, stripped(got(title), edge), nothing))
            .when(x.rlike(inline), line(True, stripped(got(inline), edge), stripped(got(inline, 2))))
            .when(x.rlike(named), line(True, none, stripped(got(named))))
            .when(x.rlike(item), line(True, none, stripped(got(item))))
            .otherwise(line(False, none, x))
        )

    one = F.struct(F.lit("").alias("category"), F.lit("").alias("limitation"))
    start = F.struct(F.lit("General").alias("category"), F.lit("").alias("open"), F.filter(F.array(one), lambda x: F.lit(False)).alias("done"))
    closed = lambda s: F.when(s["open"] != "", F.concat(s["done"], F.array(F.struct(s["category"].alias("category"), s["open"].alias("limitation"))))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        more = F.when(s["open"] == "", x["body"]).otherwise(F.concat(s["open"], F.lit(" "), x["body"]))
        return F.struct(
            F.coalesce(x["category"], s["category"]).alias("category"),
            F.when(x["starts"], x["body"]).otherwise(more).alias("open"),
            F.when(x["starts"], closed(s)).otherwise(s["done"]).alias("done"),
        )

    folded = F.aggregate(F.transform(F.filter(bare, lambda x: ~skipped(x)), told), start, step, closed)
    return F.transform(folded, lambda x, i: F.struct(i.alias("llm_id"), x["category"].alias("category"), x["limitation"].alias("limitation")))


def json_text(c: Column) -> Column:
    """The JSON of a model's answer, for from_json: what a fence holds, else from the first bracket to its last
    partner, without commas before closing brackets; null without any."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", " ")
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*([\[{].*?[\]}])\s*```", 1)
    plain = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    found = F.when(fenced != "", fenced).when(plain != "", plain)
    return F.regexp_replace(found, r",\s*([}\]])", "$1")


def _to_json(cell: str | None) -> str | None:
    value = (cell or "").strip()
    for _ in range(2):  # cells may be encoded twice
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value)
        except ValueError:
            try:
                value = ast.literal_eval(value)
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                return None
    return json.dumps(value, ensure_ascii=False, default=str) if isinstance(value, (dict, list, tuple)) else None


@F.pandas_udf(StringType())
def _pyrepr(cells: pd.Series) -> pd.Series:
    return cells.map(_to_json)


def pyrepr_to_json(c: Column) -> Column:
    """A list or record printed by Python or as JSON, once or twice encoded, as JSON; null if it is neither."""
    return _pyrepr(c)


def boxed(c: Column, name: str) -> Column:
    """What <boxed_NAME> holds; empty if there is none."""
    return stripped(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?is)<\s*boxed_{re.escape(name)}\s*>(.*?)</\s*boxed_{re.escape(name)}\s*>", 1))


def tagged_prompt_to_chat(c: Column, default_system: str = SYSTEM_PROMPT) -> Column:
    """[SYSTEM] ... [USER] ... as a prompt of marked turns, open for the assistant; without tags all is the user's."""
    both = r"(?s)\[SYSTEM\]\s*(.*?)\s*\[USER\]\s*(.*)"
    tagged = F.coalesce(c, F.lit("")).rlike(both)
    system = F.when(tagged, stripped(F.regexp_extract(c, both, 1))).otherwise(default_system)
    user = F.when(tagged, stripped(F.regexp_extract(c, both, 2))).otherwise(stripped(F.coalesce(c, F.lit(""))))
    return F.concat(F.lit("<|im_start|>system\n"), system, F.lit("<|im_end|>\n<|im_start|>user\n"), user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def entities(c: Column) -> Column:
    """Distinct acronyms, capitalised phrases, words with digits (all in lower case) and percentages, sorted."""
    t = F.coalesce(c, F.lit(""))
    found = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    low = lambda a: F.transform(a, F.lower)
    acronyms = F.filter(found(r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9]{1,5}(?![\p{L}\p{N}_])"), lambda x: ~x.isin(*PLAIN_WORDS))
    phrases = found(r"(?:[A-Z][a-z]+(?:\s+|-)){1,3}[A-Z][a-z]+")
    coded = found(r"(?<![\p{L}\p{N}_])[A-Za-z]+[-_]?\d+[A-Za-z]*(?![\p{L}\p{N}_])")
    return F.array_sort(F.array_distinct(F.concat(low(acronyms), low(phrases), low(coded), found(r"\d+\.?\d*\s*%"))))


def bold_items(c: Column) -> Column:
    """(category, body) of lines that start with a bold heading, numbered, bulleted or bare."""
    line = r"(?m)^[ \t]*(?:[0-9]+[.)]|[-*])?[ \t]*\*\*([^*\n]+?):?\*\*:?[ \t]*(.*)$"
    part = lambda i: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(line), F.lit(i))
    return F.zip_with(part(1), part(2), lambda a, b: F.struct(a.alias("category"), b.alias("body")))


def weakness_tags(c: Column) -> Column:
    """The tags of which the pattern occurs, in their order; other if none does."""
    t = F.coalesce(c, F.lit(""))
    tags = F.array_compact(F.array(*[F.when(t.rlike("(?i)" + p), F.lit(tag)) for tag, p in WEAKNESSES.items()]))
    return F.when(F.size(tags) > 0, tags).otherwise(F.array(F.lit("other")))


def specialty(c: Column) -> Column:
    """The specialty with most of its keywords in the text, of equals the first; other without any."""
    low = F.lower(F.coalesce(c, F.lit("")))
    counts = [sum((F.contains(low, F.lit(k)).cast("int") for k in keys), F.lit(0)) for keys in SPECIALTIES.values()]
    scored = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (n, name) in enumerate(zip(counts, SPECIALTIES))])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise("other")


def sentence_cut(c: Column, most: int, share: float = 0.8) -> Column:
    """The first characters up to a bound, cut after their last full stop if that lies behind a share of them."""
    head = F.substring(c, 1, most)
    stop = F.length(head) - F.locate(".", F.reverse(head)) + 1
    cut = F.when((F.locate(".", head) > 0) & (stop > most * share), F.left(head, stop)).otherwise(head)
    return F.when(F.length(c) <= most, c).otherwise(cut)


def novelty_flags(c: Column) -> Column:
    number = lambda name: F.regexp_extract(F.coalesce(c, F.lit("")), rf"{name}\s*:\s*(\d+)", 1).try_cast("int")
    return F.struct(number("BinaryNoveltyFlag").alias("flag"), number("DegreeNoveltyScore").alias("degree"))
