"""Personal data: spans by fixed patterns, and spans that boosted trees pick from generous candidates."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportloom.llm.common import staged

#: Kinds in the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that Java's matcher neither recurses nor reads a run twice: runs are possessive and are
#: entered at their start or where the last match ended. They find what the plain forms find; a card is a whole chain of digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that every match of a kind holds, to pass over most texts without matching.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}

#: Candidate generators: looser forms of the same kinds, and forms that the base patterns do not know. They overlap.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\]|at\x20)\x20?[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._-]?[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])[+(]?[0-9][0-9\x20().-]{6,18}[0-9](?![0-9])",
}
#: Words whose presence shortly before a candidate says something about it.
CONTEXT = {
    "email": r"(?i)mail|contact|write|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|address|adresse",
    "card": r"(?i)card|visa|payment|karte|carte|tarjeta",
    "phone": r"(?i)\btel|phone|call|fax|mobil",
}
NEAR = 24

#: Rows beyond which more of one kind, touched or not, weigh no more in the trees, so that none outweighs the others.
EVEN = 2_500
#: Precision that a kind's threshold must reach among all candidates, and how many hits it must rest on.
PRECISION, HITS = 0.95, 20

_SPAN = "array<struct<start:int,end:int,match:string>>"
_NUMBERED = "array<struct<kind:int,start:int,end:int,match:string>>"


def found_spans(text: Column, pattern: str) -> Column:
    """All leftmost matches of a pattern as (start, end, match), in code points, the end exclusive.

    The pieces between the matches give the places: pieces and matches alternate.
    """
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda match, gap: F.struct(match.alias("match"), F.char_length(gap).alias("gap")),
    )
    none = F.array().cast(_SPAN)
    summed = F.aggregate(
        F.filter(pairs, lambda p: p["match"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["gap"] + F.char_length(p["match"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + p["gap"]).alias("start"),
                        (acc["at"] + p["gap"] + F.char_length(p["match"])).alias("end"),
                        p["match"].alias("match"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), summed).otherwise(none)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass the Luhn check."""
    padded = F.lpad(digits, 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    places = F.array(*(F.substring(doubled if i % 2 else padded, i, 1).cast("int") for i in range(1, 21)))
    return F.aggregate(places, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        plain = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(plain, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return luhn(digits_of(match))
    if kind == "phone":
        return F.length(digits_of(match)).between(9, 15)
    return F.lit(True)


def _numbered(kind: str, spans: Column) -> Column:
    number = F.lit(KINDS.index(kind))
    return F.transform(
        spans, lambda s: F.struct(number.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"))
    )


def base_spans(text: Column) -> Column:
    """Valid matches of the base patterns, as (kind's number, start, end, match), kind by kind."""
    none = F.array().cast(_NUMBERED)

    def of(kind: str) -> Column:
        spans = _numbered(kind, F.filter(found_spans(text, PATTERNS[kind]), lambda s: valid(kind, s["match"])))
        return F.when(F.contains(text, F.lit(SIGNS[kind])), spans).otherwise(none) if kind in SIGNS else spans

    return F.concat(*map(of, KINDS))


def candidate_spans(text: Column) -> Column:
    """Matches of the candidate generators, overlapping ones too, with what stands before and after each."""
    every = F.concat(*(_numbered(kind, found_spans(text, GENERATORS[kind])) for kind in KINDS))
    return F.transform(
        every,
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"),
            F.substring(text, F.greatest(s["start"] - NEAR, F.lit(0)) + 1, F.least(s["start"], F.lit(NEAR))).alias("left"),
            F.substring(text, s["end"] + 1, F.lit(1)).alias("right"),
        ),
    )


def canonical(kind: Column, match: Column) -> Column:
    """A candidate in the form of its kind's base pattern: spelled-out signs as signs, a card's digits alone, a phone with its plus.

    What has no such form stays as it is: "at" as a word unless "dot" is one too, a number that is neither international
    nor grouped as phones are, a date.
    """
    email = F.regexp_replace(match, r"\x20?(?:\(at\)|\[at\]|@)\x20?", "@")
    email = F.when(match.contains(" dot "), F.regexp_replace(email, r"\x20at\x20", "@")).otherwise(email)
    email = F.regexp_replace(email, r"\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20", ".")
    grouped = F.regexp_like(match, F.lit(r"^\+|[0-9][\x20().-]+[0-9]+[\x20().-]+[0-9]"))
    other = F.regexp_like(match, F.lit(r"^(?:(?:19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}(?![0-9])|[0-9]+(?:\.[0-9]+){3}$)"))
    phone = F.when(grouped & ~other, F.concat(F.lit("+"), F.regexp_replace(match, "^[^0-9]*(?:00)?", ""))).otherwise(match)
    forms = {"email": email, "ip": match, "card": digits_of(match), "phone": phone}
    return F.coalesce(*(F.when(kind == i, forms[name]) for i, name in enumerate(KINDS)))


def meets_base(kind: Column, form: Column) -> Column:
    """Whether a candidate's canonical form is a valid whole match of its kind's base pattern, or an address of eight hexadecimal groups."""
    whole = {name: F.regexp_like(form, F.lit(f"^(?:{PATTERNS[name]})$")) & valid(name, form) for name in KINDS}
    whole["ip"] = whole["ip"] | F.regexp_like(form, F.lit("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$"))
    return F.coalesce(*(F.when(kind == i, whole[name]) for i, name in enumerate(KINDS)))


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context features of candidates, as columns of numbers; of the canonical form, without the signs that the base asks for."""
    match = F.regexp_replace("form", r"^\+|@", "")
    digits = digits_of(match)
    made = {f"is_{kind}": F.col("kind") == i for i, kind in enumerate(KINDS)}
    made |= {f"near_{kind}": F.regexp_like("left", F.lit(words)) for kind, words in CONTEXT.items()}
    made |= {
        "size": F.char_length(match),
        "digits": F.length(digits),
        "passes_luhn": (F.length(digits) <= 20) & luhn(digits),
        "dots": F.char_length(match) - F.char_length(F.translate(match, ".", "")),
        "colons": F.char_length(match) - F.char_length(F.translate(match, ":", "")),
        "gaps": F.char_length(match) - F.char_length(F.regexp_replace(match, r"[\x20()-]", "")),
        "letters": F.char_length(match) - F.char_length(F.regexp_replace(match, "[A-Za-z]", "")),
        "largest_part": F.array_max(F.transform(F.split(match, "[^0-9]+"), F.char_length)),
        "after_word": F.regexp_like("left", F.lit("[A-Za-z0-9]$")),
        "before_word": F.regexp_like("right", F.lit("[A-Za-z0-9]")),
    }
    return rows.withColumns({f"f_{name}": value.cast("double") for name, value in made.items()}), [f"f_{n}" for n in made]


def cross_judged(ready: DataFrame) -> DataFrame | None:
    """All candidates with the ``chance`` that boosted trees give them; None where the labels cannot carry a model.

    Every candidate is learnt from and judged: those of each half by trees grown on all of the other half.
    """
    seen = ready.groupBy("half", "label", "kind", "touched").count().collect()  # at most 32 rows
    if min(sum(r["count"] for r in seen if (r["half"], r["label"]) == (half, label)) for half in (0, 1) for label in (0.0, 1.0)) < HITS:
        return None
    weight = F.lit(1.0)
    for kind in range(len(KINDS)):
        for touched in (True, False):
            n = sum(r["count"] for r in seen if (r["kind"], r["touched"]) == (kind, touched))
            part = (F.col("kind") == kind) & (F.col("touched") == touched)
            weight = F.when(part, min(1.0, EVEN / max(n, 1))).otherwise(weight)
    weighed = ready.select("features", "label", "half", weight.alias("weight"))
    grower = GBTClassifier(labelCol="label", weightCol="weight", maxIter=8, maxDepth=4, seed=3)
    chance = F.get(vector_to_array("probability"), F.lit(1)).alias("chance")
    judged = [
        grower.fit(weighed.where(F.col("half") == 1 - half)).transform(ready.where(F.col("half") == half)).select(*ready.columns, chance)
        for half in (0, 1)
    ]
    return judged[0].union(judged[1])


def thresholds(judged: DataFrame) -> dict[int, float]:
    """For each kind the least chance from which candidates are right often enough, counted over all of them."""
    cells = judged.select("kind", "label", "touched", F.floor(F.col("chance") * 100).alias("cell"))
    above = Window.partitionBy("kind").orderBy(F.desc("cell"))
    free = (~F.col("touched")).cast("int")
    totals = {"hits": F.col("label"), "n": F.lit(1), "free_hits": F.col("label") * free, "free_n": free}
    cells = cells.groupBy("kind", "cell").agg(*(F.sum(value).alias(name) for name, value in totals.items()))
    # The precision must hold for all of a kind and for those that may be added.
    cuts = (
        cells.select("kind", "cell", *(F.sum(name).over(above).alias(name) for name in totals))
        .where((F.col("hits") >= HITS) & (F.col("hits") >= PRECISION * F.col("n")) & (F.col("cell") >= 50))
        .where(F.col("free_hits") >= PRECISION * F.col("free_n"))
        .groupBy("kind").agg(F.min("cell").alias("cut")).collect()
    )  # at most one row for each kind
    return {row["kind"]: row["cut"] / 100 for row in cuts}


def _scored(candidates: DataFrame) -> DataFrame:
    """Candidates that the boosted trees accept, with their ``score``; none where the labels cannot carry a model."""
    made, names = features(candidates)
    half = F.pmod(F.xxhash64("doc_key", "kind", "start", "end"), F.lit(2)).cast("int")
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(made.withColumn("half", half))
    ready = staged(ready.select("doc_key", "kind", "start", "end", "label", "touched", "half", "features"), "pii-features")
    judged = cross_judged(ready)
    if judged is None:
        return ready.where("false").select("doc_key", "kind", "start", "end", F.lit(0.0).alias("score"))
    judged = staged(judged.drop("features"), "pii-judged")
    limit = F.lit(2.0)
    for kind, cut in thresholds(judged).items():
        limit = F.when(F.col("kind") == kind, cut).otherwise(limit)
    return judged.where(F.col("chance") >= limit).select("doc_key", "kind", "start", "end", F.col("chance").alias("score"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def written(spans: Column) -> Column:
    """Spans as kind:start:end, by kind as listed and then by start, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text: ``doc_id``, ``base``, ``added`` (arrays of kind's number, start, end).

    ``base`` holds the matches of the fixed patterns that pass their checks. Generous generators propose overlapping
    candidates; boosted trees, grown on format and context features of all of them, score them all: each half by the trees of the
    other. (Where features are cut, MLlib takes from quantiles of at least 10,000 rows.) A candidate's label is
    whether it meets a base span of its kind or, touching none, would be one in its canonical form ("(at)" as "@", a card without
    separators, a grouped number with its "+"), so what may be added has both labels; the trees do not see the signs. Thresholds for each
    kind come from all candidates. Accepted candidates that touch no base span are added; of overlapping ones the
    best scored stays (then the longer, then by kind and place). Where there are too few examples nothing is added.

    Null text counts as empty and has no spans; rows that repeat id and text get the same spans; null ids are kept; an empty
    table gives an empty table; other columns are not looked at.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"))
    key = F.struct("doc_id", F.xxhash64("text"), F.octet_length("text"))
    slim = staged(
        rows.select(
            "doc_id", F.xxhash64(key).alias("doc_key"),
            base_spans(F.col("text")).alias("base"), candidate_spans(F.col("text")).alias("candidates"),
        ),
        "pii-spans",
    )
    each = slim.where("size(candidates) > 0").dropDuplicates(["doc_key"]).select("doc_key", "base", F.explode("candidates").alias("c"))
    touched = F.exists("base", lambda b: _overlap(b, F.col("c")))
    same = F.exists("base", lambda b: _overlap(b, F.col("c")) & (b["kind"] == F.col("c.kind")))
    each = each.select("doc_key", "c.*", touched.alias("touched"), same.alias("same"), canonical(F.col("c.kind"), F.col("c.match")).alias("form"))
    label = F.col("same") | (~F.col("touched") & meets_base(F.col("kind"), F.col("form")))
    candidates = staged(each.withColumn("label", label.cast("double")).drop("same"), "pii-candidates")
    accepted = _scored(candidates).join(
        candidates.where("NOT touched").select("doc_key", "kind", "start", "end"), ["doc_key", "kind", "start", "end"], "left_semi"
    )
    listed = accepted.groupBy("doc_key").agg(
        F.collect_list(F.struct("score", (F.col("end") - F.col("start")).alias("size"), (-F.col("kind")).alias("rank"), (-F.col("start")).alias("place"), "kind", "start", "end")).alias("all")
    )
    best = F.filter("all", lambda a: ~F.exists("all", lambda b: _overlap(a, b) & (b > a)))
    added = F.transform(best, lambda a: F.struct(a["kind"].alias("kind"), a["start"].alias("start"), a["end"].alias("end")))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    return slim.join(listed.select("doc_key", added.alias("added")), "doc_key", "left").select(
        "doc_id", plain.alias("base"), F.coalesce("added", none).alias("added")
    )
