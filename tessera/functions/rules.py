"""Domain rules as Column expressions: labels, keyword flags, disagreement,
decisions and provenance (DOM)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import blank_to_null, code

# Label spellings and their standard labels.
MONOTOPIC, BITOPIC = "MONOTOPIC MEMBRANE PROTEINS", "BITOPIC PROTEINS"
ALPHA, BETA = "TRANSMEMBRANE PROTEINS:ALPHA-HELICAL", "TRANSMEMBRANE PROTEINS:BETA-BARREL"
STANDARD_LABELS = {
    "monotopic membrane proteins": MONOTOPIC,
    "monotopic proteins": MONOTOPIC,
    "monotopic/peripheral": MONOTOPIC,
    "all alpha monotopic/peripheral": MONOTOPIC,
    "peripheral": MONOTOPIC,
    "bitopic": BITOPIC,
    "bitopic proteins": BITOPIC,
    "transmembrane proteins:alpha-helical": ALPHA,
    "transmembrane protein:alpha-helical": ALPHA,
    "alpha-helical": ALPHA,
    "alpha helical": ALPHA,
    "all alpha": ALPHA,
    "transmembrane proteins:beta-barrel": BETA,
    "transmembrane protein:beta-barrel": BETA,
    "beta-barrel": BETA,
    "beta barrel": BETA,
}
# Labels that don't disagree with each other, by bucket.
PLAIN_TRANSMEMBRANE = ("TRANSMEMBRANE", "TRANSMEMBRANE PROTEINS")
DISAGREEMENT_BUCKET = "TRANSMEMBRANE PROTEINS:ALPHA-HELICAL / BITOPIC"
EXPERT_BUCKET = "TRANSMEMBRANE / BITOPIC BENCHMARK"

# Keyword rules (id, pattern, flags, override, confidence).
KEYWORD_RULES = (
    (
        "pore_forming_toxin",
        r"\b(pore[- ]forming|hemolysin|cytolysin|perfringolysin|cytolytic|pore former|cholesterol[- ]dependent cytolysin|membrane attack complex|macpf|aerolysin|anthrolysin|streptolysin|listeriolysin|leukocidin|tox[in]?)\b",
        ("state_dependent", "soluble_to_membrane_transition"),
        False,
        "high",
    ),
    (
        "assembly_dependent_insertion",
        r"\b(prepore|pre[- ]pore|oligomer(?:ic|ization)?|multimer(?:ic|ization)?|assembly[- ]dependent|membrane insertion|inserted state|insertion complex|pore assembly)\b",
        ("state_dependent",),
        False,
        "medium",
    ),
    (
        "explicit_state_switching",
        r"\b(state[- ]dependent|conformational change|conformational switch|switching|activated state|inactive state|transition state|closed state|open state)\b",
        ("state_dependent",),
        None,
        "medium",
    ),
    (
        "amphitropic_or_reversible_association",
        r"\b(amphitropic|peripheral membrane(?: protein)?|membrane[- ]associated|reversible membrane binding|lipid[- ]binding|membrane recruitment)\b",
        ("state_dependent",),
        None,
        "medium",
    ),
    (
        "expression_helper_or_fusion_construct",
        r"\b(fusion partner|expression helper|mistic|carrier protein|solubility tag|fusion construct)\b",
        ("not_membrane_protein_candidate",),
        False,
        "high",
    ),
    (
        "engineered_or_partial_construct",
        r"\b(truncated|engineered|chimera|chimeric|synthetic construct|designed protein|isolated domain|partial structure|protein fragment|fragment)\b",
        (),
        None,
        "low",
    ),
    ("artificial_environment_context", r"\b(detergent|micelle|nanodisc|bicelle|liposome)\b", (), None, "low"),
)
#: Overrides by entity (flags, benchmark suitability, confidence).
ENTITY_OVERRIDES = {"1PFO": (("state_dependent", "soluble_to_membrane_transition"), False, "high"), "1YGM": (("not_membrane_protein_candidate",), False, "high")}
CONFIDENCE = ("none", "low", "medium", "high")
FLAGS = ("state_dependent", "soluble_to_membrane_transition", "not_membrane_protein_candidate")


def standard_label(c: Column) -> Column:
    """Standard label: a known spelling, else by keyword, else upper case (DOM-1)."""
    t = F.trim(c.cast("string"))
    low = F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    known = F.try_element_at(F.create_map(*[F.lit(x) for kv in STANDARD_LABELS.items() for x in kv]), low)
    guess = (
        F.when(low.contains("monotopic") | low.contains("peripheral"), MONOTOPIC)
        .when(low.contains("bitopic"), BITOPIC)
        .when(low.contains("beta") & low.contains("barrel"), BETA)
        .when(low.contains("alpha") & (low.contains("helical") | low.contains("helix")), ALPHA)
        .otherwise(F.upper(t))
    )
    return F.when(t != "", F.coalesce(known, guess))


def disagreement_bucket(c: Column) -> Column:
    """Labels that count as agreeing share a bucket (DOM-2)."""
    label = standard_label(c)
    return F.when(label.isin(BITOPIC, ALPHA, *PLAIN_TRANSMEMBRANE), DISAGREEMENT_BUCKET).otherwise(label)


def expert_bucket(c: Column) -> Column:
    """Coarser buckets of the expert benchmark (DOM-3)."""
    label = standard_label(c)
    return F.when(label.isin(BITOPIC, ALPHA, BETA, *PLAIN_TRANSMEMBRANE), EXPERT_BUCKET).otherwise(label)


def report_label(c: Column) -> Column:
    """The report's variant: unknown words are 'not a membrane protein' (SCL-52)."""
    label = standard_label(c)
    return F.when(F.lower(F.trim(c)).contains("not a membrane"), "NOT A MEMBRANE PROTEIN").otherwise(label)


def assessment(entity: Column, words: Column, is_replaced: Column) -> Column:
    """Keyword assessment of a record (DOM-4).

    struct of the three flags, matched rule ids, confidence and recommendation.
    A rule or entity override that says no is final; without one, a record is
    recommended when no flag is set; a replaced record never is.
    """
    hits = [(rule, F.coalesce(words.rlike(f"(?i){rule[1]}"), F.lit(False))) for rule in KEYWORD_RULES]
    own = [(name, what, F.upper(entity) == name) for name, what in ENTITY_OVERRIDES.items()]
    either = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    flag = {f: either([h for r, h in hits if f in r[2]] + [is_it for _, what, is_it in own if f in what[0]]) for f in FLAGS}
    refused = either([h for r, h in hits if r[3] is False] + [is_it for _, what, is_it in own if what[1] is False])
    rank = F.greatest(F.lit(0), *[F.when(h, CONFIDENCE.index(r[4])).otherwise(0) for r, h in hits], *[F.when(is_it, CONFIDENCE.index(what[2])).otherwise(0) for _, what, is_it in own])
    ids = F.filter(F.array(*[F.when(is_it, F.lit(f"override:{name}")) for name, _, is_it in own], *[F.when(h, F.lit(r[0])) for r, h in hits]), lambda x: x.isNotNull())
    context = flag["state_dependent"] | flag["soluble_to_membrane_transition"]
    return F.struct(
        *[flag[f].alias(f) for f in FLAGS],
        ids.alias("rules"),
        F.get(F.array(*[F.lit(x) for x in CONFIDENCE]), rank).alias("confidence"),
        (~refused & ~context & ~flag["not_membrane_protein_candidate"] & ~F.coalesce(is_replaced, F.lit(False))).alias("recommended"),
    )


def distinct_present(*cs: Column) -> Column:
    """Number of different values that are not null."""
    return F.size(F.array_distinct(F.filter(F.array(*cs), lambda x: x.isNotNull())))


def disagreement(labels: list[Column], counts: list[Column], boundary: Column) -> Column:
    """struct(group, count, boundary, any) of a record's sources (DOM-6)."""
    group = distinct_present(*[disagreement_bucket(c) for c in labels]) > 1
    count = distinct_present(*[c.cast("long") for c in counts]) > 1
    edge = F.coalesce(boundary, F.lit(False))
    return F.struct(group.alias("group"), count.alias("count"), edge.alias("boundary"), (group | count | edge).alias("any"))


def decision(any_disagreement: Column, review: Column, expert_missing: Column, replaced: Column, flagged: Column, boundary: Column, label_agrees: Column, count_agrees: Column) -> Column:
    """struct(include, high_confidence): inclusion in the benchmark (DOM-7).

    Missing truth values count as false throughout.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    status = F.coalesce(F.lower(F.trim(review)), F.lit(""))
    rejected = status == "rejected"
    include = (yes(any_disagreement) | status.isin("accepted", "reviewed", "uncertain")) & ~yes(expert_missing) & ~rejected
    high = include & ~rejected & ~yes(replaced) & ~yes(flagged) & ~yes(boundary) & yes(label_agrees) & yes(count_agrees)
    return F.struct(include.alias("include"), high.alias("high_confidence"))


def status(include: Column, high: Column, recommended: Column, rejected: Column) -> Column:
    """Five-way status (DOM-8)."""
    return (
        F.when(F.coalesce(rejected, F.lit(False)), "excluded").when(high, "high_confidence").when(include & F.coalesce(recommended, F.lit(True)), "included_with_caution")
        .when(~F.coalesce(recommended, F.lit(True)), "not_recommended").otherwise("excluded")
    )


def reasons(codes: Column, phrases: dict[str, str]) -> Column:
    """Text of reason codes (DOM-9)."""
    known = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    return F.array_join(F.transform(codes, lambda c: F.coalesce(F.try_element_at(known, c), c)), "; ")


def consensus(*predictions: Column) -> Column:
    """Agreement of predictors: null below two, else whether all agree (DOM-11)."""
    given = F.filter(F.array(*predictions), lambda x: x.isNotNull())
    return F.when(F.size(given) >= 2, F.size(F.array_distinct(given)) == 1)


def sources_present(**by: Column) -> Column:
    """Names of the sources that have a value (DOM-12)."""
    return F.filter(F.array(*[F.when(blank_to_null(c).isNotNull(), F.lit(name)) for name, c in by.items()]), lambda x: x.isNotNull())


def provenance(**fields: tuple[Column, str]) -> Column:
    """Map of field to the source it came from, for fields with a value (DOM-13)."""
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.when(c.isNotNull(), F.lit(src)).alias("v")) for k, (c, src) in fields.items()]), lambda e: e["v"].isNotNull()))


def class_differs(mapped: Column, group: Column) -> Column:
    """Case-insensitive difference of a mapped class; unmapped is no difference (DOM-15)."""
    return F.coalesce(F.lower(mapped) != F.lower(group), F.lit(False))


def regroup(c: Column, to: str, members: list[str]) -> Column:
    """DOM-16."""
    return F.when(c.isin(*members), to).otherwise(c)


def canonical_code(own: Column, replacement: Column, canonical: Column) -> Column:
    """canonical, else replacement, else the code itself (DOM-17)."""
    return F.coalesce(blank_to_null(code(canonical)), blank_to_null(code(replacement)), code(own))


def redirect(requested: Column, resolved: Column) -> Column:
    """found / redirected / missing (DOM-20)."""
    return F.when(resolved.isNull(), "missing").when(code(requested) == code(resolved), "found").otherwise("redirected")


def in_order(*labelled: tuple[str, Column]) -> Column:
    """struct(value, source) of the first source with a value (DOM-21)."""
    value = F.coalesce(*[blank_to_null(c) for _, c in labelled])
    source = F.coalesce(*[F.when(blank_to_null(c).isNotNull(), F.lit(n)) for n, c in labelled])
    return F.struct(value.alias("value"), source.alias("source"))


def comparison_rows(**by: tuple[Column, Column]) -> Column:
    """array of struct(source, label, count), to be inlined (DOM-23, DOM-24)."""
    return F.array(*[F.struct(F.lit(n).alias("source"), standard_label(a).alias("label"), b.cast("long").alias("count")) for n, (a, b) in by.items()])


def links(own: Column, **templates: str) -> Column:
    """struct of urls with the code filled in (DOM-25)."""
    return F.struct(*[F.replace(F.lit(t), F.lit("{code}"), code(own)).alias(n) for n, t in templates.items()])
