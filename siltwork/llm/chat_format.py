"""Chat formatting, in DataFrame operations only: heterogeneous records to canonical turns, and turns to training text.

Records are JSON or VARIANT. The fingerprint of a record is the hash of those of its nested field paths that any layout
speaks of, so ids, sources and other fields beside them don't matter; it selects one of ``MAPPINGS``, each a declaration
of the paths that a layout has and how they become turns. A record whose fingerprint no mapping knows, as one that mixes
two layouts, is reported with no turns, never guessed at.

The text of a conversation is ``<|im_start|>role \\n text <|im_end|> \\n`` for each turn. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, in roles a newline becomes ``<\\n``; so control strings stand only
where the template put them, and reading back is exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"

_TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """A layout: the paths its records may have (as sets of alternatives), and its turns.

    kind "list": turns are the elements of path, with fields role and text. kind "fields": each (role, path) that is
    present and not empty gives a turn; paths joined by "+" are joined by a blank line.
    """

    name: str
    layouts: tuple[tuple[str, ...], ...]
    kind: str
    path: str = "$"
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


MAPPINGS = (
    Mapping("turn", (("role", "text"),), "fields_row", role="role", text="text"),
    Mapping("turn_content", (("content", "role"),), "fields_row", role="role", text="content"),
    Mapping("messages", (("messages[].content", "messages[].role"), ("messages[]",)), "list", "$.messages", "role", "content"),
    Mapping("bare_messages", (("[].content", "[].role"), ("[]",)), "list", "$", "role", "content"),
    Mapping("shared_chat", (("conversations[].from", "conversations[].value"), ("conversations[]",)), "list", "$.conversations", "from", "value", roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
    Mapping("instruction", (("instruction", "output"), ("input", "instruction", "output"), ("instruction", "output", "system"), ("input", "instruction", "output", "system")), "fields", fields=(("system", "$.system"), ("user", "$.instruction+$.input"), ("assistant", "$.output"))),
    Mapping("prompt_completion", (("completion", "prompt"),), "fields", fields=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("prompt_response", (("prompt", "response"), ("prompt", "response", "system")), "fields", fields=(("system", "$.system"), ("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("question_answer", (("answer", "question"), ("answer", "context", "question")), "fields", fields=(("user", "$.context+$.question"), ("assistant", "$.answer"))),
)


#: All paths that a layout speaks of; list[] stands for a list without elements.
KNOWN_PATHS = sorted({p for m in MAPPINGS for layout in m.layouts for p in layout})


def _has(record: Column, path: str) -> Column:
    """Whether a VARIANT has a path, be its value null: a field, a field of any element of a list, or an empty list."""
    there = lambda v, name: F.try_variant_get(v, f"$.{name}", "variant").isNotNull()
    if "[]" not in path:
        return there(record, path)
    name, _, field = path.partition("[]")
    items = F.try_variant_get(record, f"$.{name}" if name else "$", "array<variant>")
    return F.coalesce(F.exists(items, lambda e: there(e, field.lstrip("."))) if field else F.size(items) == 0, F.lit(False))


def fingerprint(record: Column) -> Column:
    """Hash of the known nested field paths of a VARIANT, independent of field order and of the types of leaves."""
    return F.xxhash64(F.array_join(F.array_compact(F.array(*[F.when(_has(record, p), p) for p in KNOWN_PATHS])), ","))


def _value(record: Column, path: str) -> Column:
    return F.try_variant_get(record, path, "string")


def _role(name: Column, m: Mapping) -> Column:
    known = F.coalesce(name, F.lit(""))
    return reduce(lambda a, kv: F.when(known == kv[0], kv[1]).otherwise(a), m.roles, known)


def _mapped(record: Column, m: Mapping) -> Column:
    if m.kind == "list":
        items = F.try_variant_get(record, m.path, "array<variant>")
        return F.transform(items, lambda e: F.struct(_role(F.try_variant_get(e, f"$.{m.role}", "string"), m).alias("role"), F.coalesce(F.try_variant_get(e, f"$.{m.text}", "string"), F.lit("")).alias("text")))
    if m.kind == "fields_row":
        return F.array(F.struct(_role(_value(record, f"$.{m.role}"), m).alias("role"), F.coalesce(_value(record, f"$.{m.text}"), F.lit("")).alias("text")))
    turns = []
    for role, path in m.fields:
        parts = F.filter(F.array(*[_value(record, p) for p in path.split("+")]), lambda x: x.isNotNull() & (x != ""))
        turns.append(F.struct(F.lit(role).alias("role"), F.array_join(parts, "\n\n").alias("text")))
    # The answer stays even if it is empty; other fields only if they say something.
    return F.filter(F.array(*turns), lambda t: (t["text"] != "") | (t["role"] == "assistant"))


def canonical_turns(records: DataFrame, *, record: str = "record") -> DataFrame:
    """records with fingerprint, layout (the mapping's name, null if none knows it) and turns (role, text).

    record is a VARIANT or a JSON string. Null or malformed records have a null fingerprint, layout and turns. Null
    texts and roles become empty; roles are renamed where a mapping says so.
    """
    v = F.col(record) if records.schema[record].dataType.typeName() == "variant" else F.try_parse_json(F.col(record))
    out = records.drop(*[c for c in ("fingerprint", "layout", "turns") if c != record]).withColumn("__v", v)
    out = out.withColumn("fingerprint", F.when(F.col("__v").isNotNull(), fingerprint(F.col("__v"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for m in MAPPINGS:
        known = [F.col("fingerprint") == F.xxhash64(F.lit(",".join(sorted(p)))) for p in m.layouts]
        hit = reduce(lambda a, b: a | b, known)
        layout, turns = F.when(hit, F.lit(m.name)).otherwise(layout), F.when(hit, _mapped(F.col("__v"), m).cast(_TURNS)).otherwise(turns)
    return out.withColumn("layout", layout).withColumn("turns", turns).drop("__v")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def format_chat(turns: DataFrame, *, conv: str = "conv_id", order: list[str] | None = None, role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row for each conversation: conv, formatted, spans (start, length in code points of each text to learn from).

    Turns stand in the order given, then by role and text, so ties give one result; repeated rows are repeated turns.
    Null roles and texts are empty; a null conv is a conversation of its own. A conversation is one row in the end, so
    its turns meet in one task.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    head = F.concat(F.lit(START), escape_role(r), F.lit("\n"))
    rows = turns.select(F.col(conv).alias("c"), F.struct(*[F.col(x) for x in order or ["turn"]], r.alias("r"), t.alias("t")).alias("o"), head.alias("head"), escape(t).alias("body"), (r == learn).alias("learn"))
    rows = rows.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    upto = F.sum(F.length("segment")).over(Window.partitionBy("c").orderBy("o").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("start", (F.coalesce(upto, F.lit(0)) + F.length("head")).cast("int"))
    # The place in the text says the order, where turns tie on everything they are equal.
    got = rows.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("start", "segment", "learn", F.length("body").alias("length")))).alias("s"))
    spans = F.transform(F.filter("s", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return got.select(F.col("c").alias(conv), F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"), spans.alias("spans"))


def parse_chat(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation."""
    segments = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n")
        body = F.substring(x, cut + 1, F.length(x) - cut - len(END) - 1)
        return F.struct(unescape_role(F.substring(x, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(segments, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
