"""Text for prompts: cleaning of dumped cells, lists, truncation, sections, context blocks and templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What dumped cells are freed of, in this order.
DUMP_NOISE = ((r"\\+n", " "), (r"\\+[\"']", '"'), (r"[{}\[\]]", " "), (r"'\s*:\s*'", ": "), (r"'\s*,\s*'", ", "), (r"\s{2,}", " "))
UNUSABLE = "PENDING|ERROR|SKIPPED"
TRUNCATED = " ... [TRUNCATED]"


def plain_dump(c: Column) -> Column:
    """A cell that Python or JSON printed, as prose."""
    for pattern, by in DUMP_NOISE:
        c = F.regexp_replace(c, pattern, by)
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def as_text(c: Column, kind: str) -> Column:
    """Any cell as text: arrays of strings joined by a blank, records as JSON, binaries as UTF-8; null is empty."""
    if kind == "array":
        out = F.array_join(c, " ")
    elif kind in ("struct", "map", "variant"):
        out = F.to_json(c)
    else:
        out = F.decode(c, "UTF-8") if kind == "binary" else c.cast("string")
    return F.coalesce(out, F.lit(""))


def usable(c: Column, least: int = 50) -> Column:
    """A text of enough characters that isn't the note of a failed call."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.length(t) >= least) & ~t.rlike(f"^(?:{UNUSABLE})")


def numbered_items(c: Column, least: int = 10) -> Column:
    """Items of a numbered list; without two of them, those of a bulleted one; without two, paragraphs."""
    t = F.coalesce(c, F.lit(""))
    cut = lambda p: F.filter(F.transform(F.split(t, p), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) > least)
    numbered, bulleted = cut(r"(?:^|\n)[ \t]*[0-9]+[.)][ \t]+"), cut(r"(?:^|\n)[ \t]*[-*•][ \t]+")
    return F.when(F.size(numbered) > 1, numbered).when(F.size(bulleted) > 1, bulleted).otherwise(cut(r"\n[ \t]*\n"))


def bullets(items: Column, tag: str | None = None) -> Column:
    """A bulleted list of an array; each item marked with [tag]."""
    head = f"- [{tag}] " if tag else "- "
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(kept, lambda x: F.concat(F.lit(head), x)), "\n")


def continued_bullets(c: Column) -> Column:
    """Bullets with the lines that continue them, joined by a blank; what stands before the first is left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    mark = r"^(?:[-*•]|[0-9]+[.)])\s+"

    def step(s: Column, x: Column) -> Column:
        own = F.regexp_replace(x, mark, "")
        more = F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.concat(F.element_at(s, -1), F.lit(" "), x)))
        return F.when(x.rlike(mark), F.concat(s, F.array(own))).when(F.size(s) == 0, s).otherwise(more)

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def head(c: Column, most: int, marker: str = TRUNCATED) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(marker))).otherwise(c)


def head_words(c: Column, most: int, marker: str = TRUNCATED) -> Column:
    """The first words, for a budget of tokens."""
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    return F.when(F.size(words) > most, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit(marker))).otherwise(F.array_join(words, " "))


def overlapping_pieces(c: Column, size: int = 512, overlap: int = 50) -> Column:
    """Pieces of so many characters that share an overlap with the one before."""
    n, step = F.length(F.coalesce(c, F.lit(""))), size - overlap
    starts = F.when(n == 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), n - overlap, F.lit(step)))
    return F.transform(starts, lambda i: F.substring(c, i, F.lit(size)))


def section(sections: Column, keyword: str, joined: bool = False) -> Column:
    """The text of the first section (heading, text) whose heading holds a keyword, or of all of them; empty without one."""
    hit = F.filter(sections, lambda s: F.contains(F.lower(s["heading"]), F.lit(keyword)))
    texts = F.transform(hit, lambda s: s["text"])
    return F.array_join(texts, "\n\n") if joined else F.coalesce(F.get(texts, 0), F.lit(""))


def document_text(title: Column, abstract: Column, sections: Column) -> Column:
    """A cited paper as one text; parts that are missing are left out."""
    part = lambda name, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(name), c))
    rest = F.array_join(F.transform(sections, lambda s: F.concat(s["heading"], F.lit(": "), s["text"])), "\n")
    return F.concat_ws("\n", part("Title: ", title), part("Abstract: ", abstract), F.nullif(rest, F.lit("")))


def context_block(entries: Column, most: int) -> Column:
    """Cited papers (title, abstract, introduction) as a numbered block, cut at a bound."""
    one = lambda e, i: F.concat(*[x for name, field in (("Title", "title"), ("Abstract", "abstract"), ("Introduction", "introduction")) for x in (F.lit("" if name == "Title" else "\n"), F.lit("Paper"), (i + 1).cast("string"), F.lit(f"_{name}: "), F.coalesce(e[field], F.lit("")))])
    return head(F.array_join(F.transform(entries, one), "\n\n"), most)


def template(text: str, **fields: Column) -> Column:
    """A prompt with its {fields} filled; null fields are empty."""
    out = F.lit(text)
    for name, c in fields.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(c.cast("string"), F.lit("")))
    return out


def prefixed_field(c: Column) -> Column:
    """What follows the first colon: of gt_id:0 the 0."""
    return F.trim(F.split_part(c, F.lit(":"), F.lit(2)))


def says_yes(c: Column) -> Column:
    return F.contains(F.upper(F.coalesce(c, F.lit(""))), F.lit("YES"))
