"""Rewards of the steps of a generated review, all as JVM expressions. Null text counts as empty; scores lie in 0 to 1
unless said otherwise."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions import metrics as M
from siltwork.functions import parse as P
from siltwork.functions import quality as Q
from siltwork.functions import text as T

# Weights, bounds, words and patterns of the rewards.
STEP_WEIGHTS = {"search": 0.22, "retrieve": 0.30, "synthesize": 0.48}
COMPOSITE_WEIGHTS = {"f1": 0.20, "semantic": 0.15, "judge": 0.30, "structure": 0.15, "grounding": 0.20}
SOURCE_WORDS = ("paper", "cited", "rag", "abstract", "introduction", "baseline")
CONCRETE_WORDS = ("baseline", "ablation", "dataset", "metric", "seed", "split", "compute", "code", "reproduc", "rag", "cited", "robust")
FEWEST_ITEMS, MOST_ITEMS = 3, 20
SOURCE_CHARACTERS = 16_000
GENERIC = (
    r"lack(s|ing)?\s+(of\s+)?(comprehensive\s+)?ablation\s+stud(y|ies)",
    r"insufficient\s+statistical\s+(analysis|validation|testing)",
    r"limited\s+generali[sz]ability",
    r"reproducibility\s+concern",
    r"ethical\s+considerations?\s+(are\s+)?not\s+(adequately\s+)?discussed",
    r"lack(s|ing)?\s+(of\s+)?comprehensive\s+proof",
    r"potentially\s+outdated\s+baselines?",
    r"unclear\s+metrics?\s+affecting",
    r"need\s+for\s+more\s+precise\s+details",
    r"lack(s|ing)?\s+(of\s+)?discussion\s+on\s+dataset\s+representativeness",
    r"contribution\s+may\s+be\s+overstated",
    r"incremental\s+rather\s+than\s+groundbreaking",
    r"fairness\s+and\s+privacy",
    r"bias,?\s+fairness,?\s+(and\s+)?privacy",
    r"does\s+not\s+discuss\s+the\s+representativeness",
    r"overlooks?\s+ethical\s+considerations",
    r"may\s+not\s+be\s+statistically\s+robust",
    r"more\s+thorough(ly)?\s+detailed\s+to\s+enable\s+independent\s+verif",
    r"could\s+benefit\s+from\s+greater\s+precision",
    r"not\s+entirely\s+novel",
    r"compute\s+requirements\s+are\s+not\s+discussed\s+in\s+detail",
)


# What counts as a snippet, a quote, something named and something vague.
SNIPPET = r"(?i)(?:Evidence|Quote|Span)\s*:?\s*([^.\n]{18,220}(?:\.|$))"
QUOTED = "[\"“‘']([^\"”’']{12,200})[\"”’']"
NAMED = r"\b\d+(?:\.\d+)?%?|\b[A-Z][A-Za-z0-9_-]{2,}\b"
VAGUE = r"\b(some|various|several|many|things|issues|aspects)\b"


def _own(c: Column) -> Column:
    return P.stripped(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<think>.*?</think>", " "))


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _some(c: Column, words: tuple[str, ...]) -> Column:
    return (Q.present(c, words) > 0).cast("double")


def search_reward(c: Column) -> Column:
    """Distinct content words, lines and named sources of a search step."""
    t = _own(c)
    n_lines = F.size(F.filter(P.lines(t), lambda x: P.stripped(x) != ""))
    score = 0.35 + 0.35 * Q.capped(F.size(M.content_words(t)) / 35.0) + 0.20 * Q.capped(n_lines / 3.0) + 0.10 * _some(t, SOURCE_WORDS)
    return F.when(t == "", 0.0).otherwise(F.round(_clamped(score), 4))


def retrieve_reward(c: Column, source: Column) -> Column:
    """The share of the first six snippets that the source holds or overlaps, and how many there are."""
    t = _own(c)
    marked = F.regexp_extract_all(t, F.lit(SNIPPET), F.lit(1))
    plain = F.transform(F.filter(P.lines(t), lambda x: F.length(P.stripped(x)) > 18), lambda x: P.stripped(x, r" \-0-9."))
    snippets = F.when(F.size(marked) > 0, marked).otherwise(plain)
    near = M.content_words(F.substring(F.coalesce(source, F.lit("")), 1, 12_000))
    held = T.let(near, lambda words: F.size(F.filter(F.slice(snippets, 1, 6), lambda s: M.quote_contained(s, source) | (T.jaccard(M.content_words(s), words) > 0.05))))
    share = held / F.greatest(F.lit(1), F.least(F.size(snippets), F.lit(6)))
    return F.when(t == "", 0.0).otherwise(F.round(_clamped(0.25 + 0.55 * share + 0.20 * Q.capped(F.size(snippets) / 3.0)), 4))


def statement_specificity(c: Column) -> Column:
    n = F.size(F.filter(F.split(P.stripped(c), r"\s+"), lambda w: w != ""))
    length = F.when(n.between(8, 55), 0.30).when(n.between(5, 80), 0.16).otherwise(0.0)
    named = Q.matches(c, NAMED) > 0
    generic = Q.matches(F.lower(c), VAGUE)
    return _clamped(length + 0.35 * _some(c, CONCRETE_WORDS) + 0.15 * named.cast("double") - F.least(F.lit(0.25), 0.05 * generic))


def synthesis_reward(c: Column, source: Column) -> Column:
    """The mean score of the statements of a text and a factor of their number; 0 without any. A statement is scored by
    its quotes in the source, its own overlap, its specificity and how like the others it is."""
    items = F.transform(P.bullets(c), lambda s: F.struct(s.alias("s"), M.content_words(s).alias("w")))
    near = M.content_words(F.substring(F.coalesce(source, F.lit("")), 1, SOURCE_CHARACTERS))

    def scored(item: Column, every: Column, words: Column) -> Column:
        s, w = item["s"], item["w"]
        quotes = F.regexp_extract_all(s, F.lit(QUOTED), F.lit(1))
        by_quote = F.array_max(F.transform(quotes, lambda q: F.when(M.quote_contained(q, source), 1.0).otherwise(Q.capped(3.0 * T.jaccard(M.content_words(q), words)))))
        alike = F.coalesce(F.array_max(F.transform(F.filter(every, lambda o: o["s"] != s), lambda o: T.jaccard(w, o["w"]))), F.lit(0.0))

        def total(grounded: Column) -> Column:
            evidence = _clamped(0.35 * (F.size(quotes) > 0).cast("double") + 0.65 * grounded)
            return F.round(_clamped(0.42 * grounded + 0.24 * statement_specificity(s) + 0.20 * evidence + 0.04 * (1.0 - alike)), 4)

        return T.let(F.coalesce(by_quote, Q.capped(2.2 * T.jaccard(w, words))), total)

    def reward(x: Column) -> Column:
        every, n = x["items"], F.size(x["items"])
        factor = F.when(n.between(2, 7), 1.0).when(n <= 10, 0.80).otherwise(0.55)
        mean = F.aggregate(F.transform(every, lambda item: scored(item, every, x["words"])), F.lit(0.0), lambda a, v: a + v) / n
        return F.when(n == 0, 0.0).otherwise(F.round(_clamped(0.90 * mean + 0.10 * factor), 4))

    return T.let(F.struct(items.alias("items"), near.alias("words")), reward)


def worker_reward(search: Column, retrieve: Column, synthesis: Column) -> Column:
    """The weighted sum of the three step rewards."""
    w = STEP_WEIGHTS
    return F.round(_clamped(w["search"] * search + w["retrieve"] * retrieve + w["synthesize"] * synthesis), 4)


def master_reward(synthesis: Column) -> Column:
    """A master only synthesizes."""
    return F.round(_clamped(synthesis), 4)


def format_reward(c: Column) -> Column:
    """A struct (total, penalty, section, bullets): a <think> part, a section of limitations and tagged bullets in it."""
    t = F.coalesce(c, F.lit(""))
    section = r"(?msd)^#{2,3}\s*(?:Limitations|Weaknesses)\s*\n(.*?)(?=\n#{2,}\s*\S+|\z)"
    has = t.rlike(section)
    tagged = Q.matches(F.regexp_extract(t, section, 1), r"(?imd)^\s*[-*]\s*\[(?:Major|Minor)\]")
    bullets = F.when(has, Q.capped(tagged / 4.0)).otherwise(0.0)
    penalty = -0.25 * ((~t.rlike(r"(?is)<think>.*?</think>")).cast("int") + (~has).cast("int"))
    total = _clamped(0.5 * has.cast("double") + 0.5 * bullets + penalty)
    return F.struct(total.alias("total"), penalty.alias("penalty"), has.cast("double").alias("section"), bullets.alias("bullets"))


def structure_score(thinking: Column, limitations: Column) -> Column:
    """Bullets, named categories, steps of reasoning and length; 0 without limitations."""
    t = F.coalesce(limitations, F.lit(""))
    bullets = Q.matches(t, r"(?md)^[\-*•]")
    categories = Q.matches(t, "(?i)novelty|method|experiment|generaliz|clarity|data|ethic|robustness|reproducib")
    steps = Q.matches(thinking, r"(?i)step\s*[1-8]|understand|novelty.?check|method.?audit|experiment|generalisa|clarity|data|prioriti")
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    parts = [Q.capped(n / most) for n, most in ((bullets, 8.0), (categories, 5.0), (steps, 6.0), (words, 300.0))]
    return F.when(t == "", 0.0).otherwise(reduce(add, parts) / 4)


def grounding_score(text: Column, paper: Column) -> Column:
    """The share of the paper's entities that the text names, full at 30 %; 0.5 for a paper without any."""
    names = P.entities(paper)
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.size(names) == 0, 0.5).otherwise(Q.capped(F.size(F.filter(names, lambda e: F.contains(low, e))) / F.size(names) / 0.30))


def composite_score(f1: Column, semantic: Column, judge: Column, structure: Column, grounding: Column) -> Column:
    """The weighted sum; judge marks go from 0 to 5, an unknown semantic similarity counts 0.5."""
    w = COMPOSITE_WEIGHTS
    total = w["f1"] * f1 + w["semantic"] * F.coalesce(semantic, F.lit(0.5)) + w["judge"] * judge / 5.0 + w["structure"] * structure + w["grounding"] * grounding
    return F.round(total, 4)


def length_penalty(n: Column) -> Column:
    """0 for a number of items in bounds; linear below them, logarithmic above, 1 at most."""
    few = Q.capped((FEWEST_ITEMS - n) / FEWEST_ITEMS)
    many = Q.capped(F.log1p((n - MOST_ITEMS).cast("double")) / F.log1p(F.lit(20.0)))
    return F.when(n < FEWEST_ITEMS, few).when(n > MOST_ITEMS, many).otherwise(0.0)


def generic_phrases(c: Column) -> Column:
    """How many of the template phrases the text holds."""
    return reduce(add, [F.coalesce(c, F.lit("")).rlike("(?i)" + p).cast("int") for p in GENERIC])


def names_paper(text: Column, paper: Column, least: int = 2) -> Column:
    """Whether the text names so many acronyms of the paper."""
    found = F.regexp_extract_all(F.coalesce(paper, F.lit("")), F.lit(r"(?<![\p{L}\p{N}_])[A-Z][A-Z0-9]{1,5}(?![\p{L}\p{N}_])"), F.lit(0))
    own = F.array_distinct(F.filter(found, lambda x: ~x.isin(*P.PLAIN_WORDS)))
    high = F.upper(F.coalesce(text, F.lit("")))
    return F.size(F.filter(own, lambda a: F.contains(high, a))) >= least


# Marks of a leader's texts, and the weights of a worker's alignment.
FEEDBACK_MARKS = ("COVERAGE_GAPS", "FEEDBACK_FOR", "ADDITIONAL_WORKERS", "PRIORITY_GUIDANCE", "FINAL_ASSESSMENT")
PLANNING_MARKS = ("SELECTED_WORKERS", "GUIDANCE_FOR", "NUM_ROUNDS", "CRITICAL_CATEGORIES")
ALIGNMENT_WEIGHTS = {"j": 0.70, "g": 0.15, "f": 0.15}


def marked_share(c: Column, marks: tuple[str, ...]) -> Column:
    """The share of marks that a text holds, in any case."""
    high = F.upper(F.coalesce(c, F.lit("")))
    return reduce(add, [F.contains(high, F.lit(m)).cast("int") for m in marks]) / float(len(marks))


def leader_reward(*, decision: Column, feedback: Column, planning: Column, breadth: Column, workers: Column, weights: dict[str, float]) -> Column:
    """The weighted mean of a leader's decision, feedback, planning, breadth and thrift: three to five workers are best."""
    thrift = F.when(workers.between(3, 5), 1.0).when(workers <= 7, 0.7).otherwise(0.5)
    total = decision * weights["decision"] + (feedback + planning) * weights["feedback"] + breadth * weights["breadth"] + thrift * 0.5
    return total / (weights["decision"] + 2 * weights["feedback"] + weights["breadth"] + 0.5)


def rating_label(c: Column) -> Column:
    """A rating of 5 or less is accepted, a higher one or one that is no number isn't."""
    return F.when(F.coalesce(c.try_cast("int"), F.lit(999)) <= 5, "strong_accept").otherwise("strong_reject")


def f_beta(precision: Column, recall: Column, beta: float = 1.5) -> Column:
    return T.safe_divide((1 + beta * beta) * precision * recall, beta * beta * precision + recall)
