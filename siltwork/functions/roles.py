"""Rewards of agents by their role and of the steps of a claim-based review, as JVM expressions. Null text counts as empty
and a null part of a weighted sum as 0; similarities of embeddings and marks of judges come as columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions import parse as P
from siltwork.functions import quality as Q
from siltwork.functions import text as T

# Weights, bounds, words and patterns of role rewards and step scores.
WORKER_WEIGHTS = {"f1": 0.40, "grounding": 0.15, "specificity": 0.10, "severity": 0.05, "rouge": 0.10, "length_penalty": -0.10, "redundancy_penalty": -0.10}
MASTER_WEIGHTS = {"f1": 0.40, "grounding": 0.10, "specificity": 0.05, "severity": 0.05, "dedup": 0.10, "organization": 0.10, "rouge": 0.10, "length_penalty": -0.10, "redundancy_penalty": -0.10}
FEEDBACK_WEIGHTS = {"delta": 0.40, "quality": 0.35, "room": 0.25}
HANDOFF_WEIGHTS = {"coverage": 0.55, "structure": 0.45}
NOVELTY_WEIGHT = 0.5
BETA = 1.5
HANDOFF_BULLET = r"(?msd)^\s*[-*•]\s+(.+?)(?=\n\s*[-*•]\s|\z)"
ROLE_WEIGHTS = {"category": 2.0, "specificity": 1.5, "evidence": 1.0, "overlap": 1.5, "quality": 1.0}
ROLE_SPECIFICS = (r"\d+\.?\d*\s*%", r"table\s*\d+", r"figure\s*\d+", r"section\s*\d+", r"equation\s*\d+", r"\d+\.\d+")
ROLE_EVIDENCE = (r"(section|table|figure|equation|experiment|appendix|algorithm)\s*\w*", r'"[^"]{5,}"')
ROLE_GENERIC = ("the paper should", "future work could", "it would be better", "more experiments are needed", "the authors could")
ROLE_KEYWORDS = {
    "novelty_significance": ("novel", "significance", "incremental", "contribution", "original", "prior work", "differentiation", "impact", "motivation"),
    "theoretical_methodological": ("method", "theoretical", "proof", "assumption", "ablation", "algorithm", "formulation", "derivation", "approximation"),
    "experimental_evaluation": ("experiment", "baseline", "metric", "comparison", "statistical", "evaluation", "benchmark", "dataset", "result", "performance"),
    "generalization_robustness_efficiency": ("generalization", "robustness", "efficiency", "scalability", "computational", "resource", "deployment", "practical", "cost"),
    "clarity_interpretability_reproducibility": ("clarity", "reproducibility", "interpretability", "documentation", "hyperparameter", "code", "notation", "explanation"),
    "data_ethics": ("data", "bias", "fairness", "ethics", "privacy", "integrity", "annotation", "demographic", "consent", "transparency"),
    "citation": ("citation", "related work", "prior", "reference", "comparison", "literature", "survey", "overlooked", "missing"),
}
KEY_SECTIONS = ("abstract", "introduction", "method", "methodology", "results", "experiment", "discussion", "conclusion", "related work")
SCOPE_DIMENSIONS = ("validation", "contextualization", "generalizability", "scope")
CLAIM_NUMBER = r"\d+\.?\d*\s*%?"
CLAIM_METHOD = r"(algorithm|model|framework|approach|network|transformer|encoder|decoder|architecture)"
CLAIM_COMPARISON = r"(outperform|improve|better|faster|state-of-the-art|SOTA|baseline|benchmark|accuracy|F1)"
NOVELTY_MARKS = (r"Novelty Score[:\s]*\d", r"Rigor Score[:\s]*\d", r"Evidence")
NOVELTY_CONCRETE = r"(specifically|concretely|in particular|for example|e\.g\.)"
NOVELTY_COMPARED = r"(compared to|in contrast|whereas|while|differs from|similar to)"
SCOPE_MARKS = r"(?:Validation|Contextualization|Generalizability) Score[:\s]*\d"
LIMITATION_CONCRETE = r"(specific|particular|e\.g\.|for example|such as|Table|Figure|Section|equation|\d+\.?\d*%?|dataset|benchmark|baseline|ablation)"
CLAIM_WEIGHTS = {"format": 0.10, "coverage": 0.15, "faithfulness": 0.50, "specificity": 0.25}
NOVELTY_WEIGHTS = {"format": 0.20, "grounding": 0.30, "references": 0.25, "specificity": 0.25}
SCOPE_WEIGHTS = {"format": 0.20, "grounding": 0.25, "completeness": 0.30, "specificity": 0.25}
LIMITATION_WEIGHTS = {"specificity": 0.20, "grounding": 0.20, "non_redundancy": 0.15, "gt_coverage": 0.20, "soundness": 0.25}
REVIEW_WEIGHTS = {"claims": 0.15, "novelty": 0.25, "scope": 0.25, "limitations": 0.35}
SHORTEST_STEP = 50
LEAST_OWN_WORDS = 0.15
PLAIN_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "shall", "can", "need", "dare", "ought",
    "used", "to", "of", "in", "for", "on", "with", "at", "by", "from",
    "as", "into", "through", "during", "before", "after", "above", "below",
    "between", "out", "off", "over", "under", "again", "further", "then",
    "once", "and", "but", "or", "nor", "not", "no", "so", "than", "too",
    "very", "just", "about", "up", "down", "each", "every", "all", "any",
    "few", "more", "most", "other", "some", "such", "only", "own", "same",
    "that", "this", "these", "those", "it", "its", "he", "she", "they",
    "them", "their", "we", "our", "you", "your", "which", "what", "who",
    "whom", "how", "when", "where", "why", "if", "because", "while",
    "paper", "study", "work", "research", "method", "approach", "model",
    "results", "data", "analysis", "experiment", "also", "however",
    "limitation", "lack", "missing", "insufficient", "limited", "without",
)


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _has(c: Column, pattern: str) -> Column:
    return F.coalesce(c, F.lit("")).rlike("(?i)" + pattern).cast("int")


def _mean(values: Column) -> Column:
    """The mean of an array, 0 for an empty one."""
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)).otherwise(0.0)


def n_words(c: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""))


def weighted(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    return reduce(add, [F.coalesce(parts[n], F.lit(0.0)) * w for n, w in weights.items() if n in parts])


def composite(parts: dict[str, Column], weights: dict[str, float]) -> Column:
    """The weighted sum of a worker's or master's parts, penalties taken off, in 0 to 1."""
    return _clamped(weighted(parts, weights))


def item_list_f1(matched: Column, novel: Column, n_pred: Column, n_gt: Column, verified: Column) -> Column:
    """F-beta of matched items, where valid new items count half for precision; the precision where there are no
    references. Matches that words don't verify weigh half."""
    precision = (matched + NOVELTY_WEIGHT * novel) / F.greatest(n_pred, F.lit(1))
    recall = matched / F.greatest(n_gt, F.lit(1))
    f = F.when(precision + recall < 1e-9, 0.0).otherwise((1 + BETA * BETA) * precision * recall / (BETA * BETA * precision + recall + 1e-9))
    return F.when(n_pred == 0, 0.0).otherwise(F.when(n_gt > 0, f).otherwise(precision) * (0.5 + 0.5 * verified))


def boilerplate_share(items: Column, paper: Column) -> Column:
    """The share of items of which the paper holds few words of four letters or more, plain ones aside, or that have none;
    0.5 without items or a paper."""

    def share(x: Column) -> Column:
        def plain(item: Column) -> Column:
            every = F.regexp_extract_all(F.lower(item), F.lit("[a-z]+"), F.lit(0))
            own = F.filter(every, lambda w: (F.length(w) > 3) & ~w.isin(*PLAIN_WORDS))
            return T.let(own, lambda ws: (F.size(ws) == 0) | (F.size(F.filter(ws, lambda w: F.contains(x["low"], w))) / F.size(ws) < LEAST_OWN_WORDS))

        return F.size(F.filter(x["items"], plain)) / F.size(x["items"])

    known = (F.coalesce(F.size(items), F.lit(0)) > 0) & (F.coalesce(paper, F.lit("")) != "")
    return F.when(known, T.let(F.struct(items.alias("items"), F.lower(paper).alias("low")), share)).otherwise(0.5)


def feedback(initial: Column, revised: Column, quality: Column) -> Column:
    """What feedback is worth, as a struct (delta, room, composite): what it improved, by itself and against the room
    there was, and its own quality."""
    delta = revised - initial
    room = _clamped(delta / F.greatest(1.0 - initial, F.lit(0.05)))
    total = weighted({"delta": _clamped(0.5 + 2.0 * delta), "quality": quality, "room": room}, FEEDBACK_WEIGHTS)
    return F.struct(delta.alias("delta"), room.alias("room"), _clamped(total).alias("composite"))


def handoff(text: Column, names: Column) -> Column:
    """A leader's summary for the master, as a struct (coverage, structure, composite): workers that it names, sections,
    bullets and whom it is for."""
    t = F.coalesce(text, F.lit(""))
    named = F.size(F.filter(names, lambda n: F.contains(t, n)))
    sections, bullets = F.when(F.contains(t, F.lit("###")), named).otherwise(0), F.regexp_count(t, F.lit(HANDOFF_BULLET))
    coverage = named / F.greatest(F.size(names), F.lit(1))
    structure = (
        F.when(F.contains(F.lower(t), F.lit("master")), 0.3).otherwise(0.0)
        + F.when(bullets >= 6, 0.3).when(bullets >= 3, 0.15).otherwise(0.0)
        + F.when(sections >= F.size(names) * 0.5, 0.4).when(sections > 0, 0.2).otherwise(0.0)
    )
    structure = Q.capped(structure)
    return F.struct(coverage.alias("coverage"), structure.alias("structure"), weighted({"coverage": coverage, "structure": structure}, HANDOFF_WEIGHTS).alias("composite"))


def role_parts(output: Column, role: str) -> dict[str, Column]:
    """Category coverage, specificity, evidence and quality of a worker's output for its role; the overlap with its
    references comes from tfidf_cosine."""
    words, low = ROLE_KEYWORDS[role], F.lower(F.coalesce(output, F.lit("")))
    hits = reduce(add, [_has(output, w) for w in words])
    n = n_words(output)
    length = F.when(n < 30, 0.2).when(n < 80, 0.5).otherwise(Q.capped(n / 200.0))
    generic = reduce(add, [F.contains(low, F.lit(g)).cast("int") for g in ROLE_GENERIC])
    return {
        "category": Q.capped(hits / max(3.0, len(words) * 0.4)),
        "specificity": Q.capped(reduce(add, [_has(output, p) for p in ROLE_SPECIFICS]) / 3.0),
        "evidence": Q.capped(reduce(add, [F.regexp_count(F.coalesce(output, F.lit("")), F.lit("(?i)" + p)) for p in ROLE_EVIDENCE]) * 0.15),
        "quality": F.greatest(F.lit(0.0), length - generic * 0.1),
    }


def role_relevant(line: Column, role: str) -> Column:
    """Whether a reference concerns a role."""
    return reduce(add, [_has(line, w) for w in ROLE_KEYWORDS[role]]) > 0


def role_reward(parts: dict[str, Column], overlap: Column) -> Column:
    """The weighted mean of a worker's parts and its overlap with the role's references, 0.5 where it has none."""
    return weighted({**parts, "overlap": F.coalesce(overlap, F.lit(0.5))}, ROLE_WEIGHTS) / sum(ROLE_WEIGHTS.values())


def combined_reward(rule: Column, zero_shot: Column, trained: Column, zero_shot_weight: float = 1.0) -> Column:
    """The mean of the rule reward and of those others that there are."""
    weight = 1.0 + F.when(zero_shot.isNotNull(), zero_shot_weight).otherwise(0.0) + F.when(trained.isNotNull(), 1.0).otherwise(0.0)
    return (rule + F.coalesce(zero_shot * zero_shot_weight, F.lit(0.0)) + F.coalesce(trained, F.lit(0.0))) / weight


def claims_step(claims: Column, sections: Column, faithfulness: Column) -> Column:
    """An array of claims (claim, section, type, evidence_quote), 0 for none: a field that is there isn't null. Sections
    that the paper has bound those that can be covered; without any known, all key sections do."""
    whole = F.transform(claims, lambda c: (c["claim"].isNotNull() & c["section"].isNotNull() & c["type"].isNotNull() & c["evidence_quote"].isNotNull()).cast("double"))
    key = F.array(*map(F.lit, KEY_SECTIONS))
    known = F.transform(F.coalesce(sections, F.array().cast("array<string>")), F.lower)
    target = F.when(F.size(known) > 0, F.array_intersect(key, known)).otherwise(key)
    said = F.transform(claims, lambda c: F.lower(F.coalesce(c["section"], F.lit(""))))
    coverage = F.size(F.array_intersect(said, target)) / F.greatest(F.size(target), F.lit(1))
    specific = F.transform(claims, lambda c: 0.4 * _has(c["claim"], CLAIM_NUMBER) + 0.3 * _has(c["claim"], CLAIM_METHOD) + 0.3 * _has(c["claim"], CLAIM_COMPARISON))
    total = weighted({"format": _mean(whole), "coverage": coverage, "faithfulness": faithfulness, "specificity": _mean(specific)}, CLAIM_WEIGHTS)
    return F.when(F.coalesce(F.size(claims), F.lit(0)) > 0, total).otherwise(0.0)


def novelty_step(text: Column, grounding: Column, references: Column) -> Column:
    """Marks, grounding, cited references (the first 30; 0.5 where the paper has none) and concrete words; 0 for a text under
    50 characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    cited = F.size(F.filter(F.slice(references, 1, 30), lambda r: (F.length(r) > 5) & F.contains(low, F.substring(F.lower(r), 1, 30))))
    overlap = F.when(F.coalesce(F.size(references), F.lit(0)) > 0, Q.capped(cited / 3.0)).otherwise(0.5)
    specific = 0.3 * _has(text, NOVELTY_CONCRETE) + 0.3 * _has(text, NOVELTY_COMPARED) + 0.4 * Q.capped(n_words(text) / 200.0)
    parts = {"format": reduce(add, [_has(text, p) for p in NOVELTY_MARKS]) / 3.0, "grounding": grounding, "references": overlap, "specificity": specific}
    return F.when(F.length(low) < SHORTEST_STEP, 0.0).otherwise(weighted(parts, NOVELTY_WEIGHTS))


def scope_step(text: Column, grounding: Column) -> Column:
    """Marks, grounding, dimensions named and evidence; 0 for a text under 50 characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = reduce(add, [F.contains(low, F.lit(w)).cast("int") for w in SCOPE_DIMENSIONS]) / len(SCOPE_DIMENSIONS)
    specific = 0.3 * _has(text, "Evidence") + 0.3 * _has(text, "limitation") + 0.4 * Q.capped(n_words(text) / 200.0)
    parts = {"format": Q.capped(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?i)" + SCOPE_MARKS)) / 3.0), "grounding": grounding, "completeness": named, "specificity": specific}
    return F.when(F.length(low) < SHORTEST_STEP, 0.0).otherwise(weighted(parts, SCOPE_WEIGHTS))


def limitations_step(items: Column, grounding: Column, non_redundancy: Column, gt_coverage: Column, soundness: Column) -> Column:
    """An array of limitations (limitation, category, severity), 0 for none."""
    some = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    specific = F.transform(items, lambda x: 0.35 * _has(x["limitation"], LIMITATION_CONCRETE) + 0.15 * some(x["category"]) + 0.10 * some(x["severity"]) + 0.40 * Q.capped(n_words(x["limitation"]) / 35.0))
    parts = {"specificity": _mean(specific), "grounding": grounding, "non_redundancy": non_redundancy, "gt_coverage": gt_coverage, "soundness": soundness}
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, weighted(parts, LIMITATION_WEIGHTS)).otherwise(0.0)


def review_score(steps: dict[str, Column]) -> Column:
    return weighted(steps, REVIEW_WEIGHTS)


# The lines of two further grammars of reports.
LISTED_CATEGORY = r"^\s*-\s*\*\*(.+?)\*\*.*$"
LISTED_ITEM = r"^\s*-\s+(.+)$"
LISTED_OPEN = r"^\s*- \*\*"
HEADED_BOLD = r"^\*\*(.*?)\*\*:?$"
HEADED_TITLE = r"(?s)^#+(.*)$"
HEADED_EDGE = r" \t\n\r\xA0"
HEADED_SKIPPED = "Final List"


def _carried(told: Column) -> Column:
    """Items (llm_id, category, limitation) of lines told as (category, body): a category holds until the next."""
    one = F.struct(F.lit("").alias("category"), F.lit("").alias("limitation"))
    start = F.struct(F.lit("General").alias("category"), F.filter(F.array(one), lambda x: F.lit(False)).alias("done"))

    def step(s: Column, x: Column) -> Column:
        item = F.struct(s["category"].alias("category"), x["body"].alias("limitation"))
        return F.struct(F.coalesce(x["category"], s["category"]).alias("category"), F.when(x["body"].isNotNull(), F.concat(s["done"], F.array(item))).otherwise(s["done"]).alias("done"))

    got = F.aggregate(told, start, step, lambda s: s["done"])
    return F.transform(got, lambda x, i: F.struct(i.alias("llm_id"), x["category"].alias("category"), x["limitation"].alias("limitation")))


def _told(category: Column | None = None, body: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct((none if category is None else category).alias("category"), (none if body is None else body).alias("body"))


def listed_items(c: Column) -> Column:
    """A report of bullets: bold ones are categories, all others items."""
    told = lambda x: F.when(x.rlike(LISTED_CATEGORY), _told(category=P.stripped(P.stripped(F.regexp_extract(x, LISTED_CATEGORY, 1)), " :"))).when(x.rlike(LISTED_ITEM) & ~x.rlike(LISTED_OPEN), _told(body=P.stripped(F.regexp_extract(x, LISTED_ITEM, 1)))).otherwise(_told())
    return _carried(F.transform(F.split(P.stripped(F.coalesce(c, F.lit(""))), "\n"), lambda x: told(F.regexp_replace(x, r"\s+$", ""))))


def headed_items(c: Column) -> Column:
    """A report of headings (# or bold), numbered items with bold titles, and bullets with or without a title; a title is
    set before its text with a colon."""

    def titled(x: Column) -> Column:
        parts = F.split(x, r"\*\*", 3)
        return F.concat(P.stripped(parts[1]), F.lit(": "), P.stripped(F.regexp_replace(parts[2], "^[: ]+", "")))

    def told(x: Column) -> Column:
        bare = P.stripped(F.regexp_extract(x, HEADED_TITLE, 1))
        body = P.stripped(F.substring(x, 2, 1_000_000_000))
        colon = F.split(body, ":", 2)
        bold = lambda t: F.size(F.split(t, r"\*\*", 3)) >= 3
        bullet = (
            F.when(F.contains(body, F.lit("**")), F.when(bold(body), titled(body)).otherwise(body))
            .when(F.contains(body, F.lit(":")), F.concat(P.stripped(colon[0]), F.lit(": "), P.stripped(colon[1])))
            .otherwise(body)
        )
        return (
            F.when(x.startswith("#"), F.when(F.contains(bare, F.lit(HEADED_SKIPPED)), _told()).otherwise(_told(category=bare)))
            .when(x.rlike(HEADED_BOLD), _told(category=P.stripped(F.regexp_extract(x, HEADED_BOLD, 1))))
            .when(F.contains(x, F.lit("**")) & x.rlike(r"^\d"), F.when(bold(x), _told(body=titled(x))).otherwise(_told()))
            .when(x.rlike("^[-*]"), _told(body=bullet))
            .otherwise(_told())
        )

    bare = F.filter(F.transform(P.lines(c), lambda x: P.stripped(x, HEADED_EDGE)), lambda x: x != "")
    return _carried(F.transform(bare, told))
