r"""Personal data in texts by weak supervision.

Patterns propose spans. Labelers look at each proposal and vote for, against or not at all: the regular expression's
own check (Luhn, ranges, digit counts), a gazetteer of cue words before the span, one of reserved values, the
characters around the span, and the variety of its characters. Expectation maximisation over the histogram of votes
(two hidden classes, labelers independent given the class) estimates how reliable each labeler is; the posteriors
then train the final classifier, a logistic regression over kind and votes, which is scored as a column expression.
The histogram has at most ``len(KINDS) * 3 ** 5`` rows whatever the corpus, and is all that reaches the driver.

Base spans (a pattern of a base kind that passes its check) always stay. Proposals that only the looser patterns make
(kind ``other``) are added where the classifier says so and no base span overlaps them.

Everything on the way is DataFrame functions. Positions are characters from 0, ends exclusive; they follow from the
lengths of the stretches between matches, summed along the text. Patterns are written without groups that repeat, so
no text, however long, exhausts the stack of the regular expression engine: separators that belong to a number or a
domain are first replaced by ``JOIN``, one for one. Null or empty texts have no spans. Repeated rows each get a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import land

JOIN, OTHER = "\ue000", "\ue001"
KINDS = ["email", "ip", "card", "phone", "other"]
BASE = KINDS[:4]
LOCAL = f"A-Za-z0-9._%+{JOIN}-"
# Shapes of personal data and of credentials.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++{JOIN}[A-Za-z0-9{JOIN}-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"(?<![0-9{JOIN}])[0-9][0-9{JOIN}]{{13,}}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])(?:password|passwd|secret|token|api_key)\x20?[=:]\x20?[^\s]{6,}+"
    r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
    r"|(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
CUES = r"(?i)(?:mail|contact|write|phone|tel|call|fax|mobile|card|visa|account|ssn|social|address|host|ip|user|login|password|key)[^A-Za-z]{0,3}$"
RESERVED = r"(?i)(?:@example\.|@test\.|^127\.|^0\.|^10\.|^192\.168\.|^0+$|000-00-0000|123-45-6789)"
LABELERS = ["shape", "cue", "reserved", "around", "variety"]
STEPS = 60


def proposals(docs: DataFrame) -> DataFrame:
    """One row per match (uid, doc_id, kind, start, end, match, before, after); a null kind for rows without any."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), JOIN, OTHER)
    joined = {
        "email": F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", JOIN),
        "card": F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", JOIN),
    }
    may = {"email": text.contains("@"), "phone": text.contains("+")}
    digits = text.rlike("[0-9]")

    def matches(kind: str) -> Column:
        source, pattern = joined.get(kind, text), PATTERNS[kind]
        # One more stretch than matches: the last has no match behind it.
        both = F.arrays_zip(
            F.split(source, pattern, -1).alias("gap"), F.regexp_extract_all(source, F.lit(pattern), F.lit(0)).alias("match")
        )
        rows = F.transform(both, lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).alias("gap"), z["match"].alias("match"),
            F.right(z["gap"], F.lit(24)).alias("before"), F.left(z["gap"], F.lit(1)).alias("head"),
        ))
        rows = F.when(F.size(rows) > 1, rows)
        return F.when(may.get(kind, digits if kind in ("ip", "card") else F.lit(True)), rows)

    found = F.filter(F.array(*[matches(k) for k in KINDS]), lambda x: x.isNotNull())
    # Numbered before the explosion, so that all matches of a row share its number.
    numbered = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.flatten(found).alias("_found"))
    rows = numbered.select("uid", "doc_id", F.explode_outer("_found").alias("m")).select("uid", "doc_id", "m.*")
    order = Window.partitionBy("uid", "kind").orderBy("i")
    before = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", before + F.col("gap")).withColumn("after", F.lead("head").over(order))
    return rows.where("kind is null or match is not null").select(
        "uid", "doc_id", "kind", F.col("start").cast("long").alias("start"),
        (F.col("start") + F.length("match")).cast("long").alias("end"), "match", "before", "after",
    )


def passes() -> Column:
    """Whether a match of a base kind passes its check."""
    digits = F.regexp_replace("match", "[^0-9]", "")
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return (
        F.when(F.col("kind") == "email", F.lit(True))
        .when(F.col("kind") == "ip", F.col("match").rlike(rf"^{part}\.{part}\.{part}\.{part}$"))
        .when(F.col("kind") == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19)))
        .when(F.col("kind") == "phone", F.length(digits).between(10, 15))
        .otherwise(F.lit(False))
    )


def voted(found: DataFrame) -> DataFrame:
    """Adds ``base`` and a column of -1, 0 or 1 for each labeler."""
    plain = F.regexp_replace("match", JOIN, ".")
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    kinds = F.size(F.array_distinct(F.split("match", "")))
    edge = F.col("before").rlike(r"[A-Za-z0-9]$") | F.coalesce(F.col("after").rlike(r"^[A-Za-z0-9]"), F.lit(False))
    return (
        found.withColumn("base", F.coalesce(passes(), F.lit(False)))
        .withColumn("shape", vote(F.col("base") | plain.rlike(r"^(?:AKIA|[a-z_]+ ?[=:])"), F.col("kind") != "other"))
        .withColumn("cue", vote(F.col("before").rlike(CUES) | plain.rlike(r"^[a-z_]+ ?[=:]"), F.lit(False)))
        .withColumn("reserved", vote(F.lit(False), plain.rlike(RESERVED)))
        .withColumn("around", vote(~edge, edge))
        .withColumn("variety", vote(kinds >= 6, kinds <= 3))
    )


def reliabilities(histogram: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[list[dict[int, float]]]]:
    """Prior of personal data, and by class and labeler the probability of each vote, by expectation maximisation."""
    k = len(LABELERS)
    total = sum(n for _, n in histogram)
    mine = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for v, _ in histogram]
    prior, rates = 0.5, []
    for _ in range(STEPS):
        prior = (sum(p * n for p, (_, n) in zip(mine, histogram, strict=True)) + 1) / (total + 2)
        rates = []
        for cls in (0, 1):
            weight = [(p if cls else 1 - p) * n for p, (_, n) in zip(mine, histogram, strict=True)]
            rates.append([
                {x: (sum(w for w, (v, _) in zip(weight, histogram, strict=True) if v[j] == x) + 1) / (sum(weight) + 3) for x in (-1, 0, 1)}
                for j in range(k)
            ])
        mine = [posterior(v, prior, rates) for v, _ in histogram]
    return prior, rates


def posterior(votes: tuple[int, ...], prior: float, rates: list[list[dict[int, float]]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(rates[1][j][v] / rates[0][j][v]) for j, v in enumerate(votes))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, odds))))


def train(cells: list[tuple[str, tuple[int, ...], int]], labels: list[float]) -> dict[str, float]:
    """Logistic regression on soft labels: a weight per kind, and per labeler and vote; by gradient steps."""
    names = [[kind, *(f"{name}:{v}" for name, v in zip(LABELERS, votes, strict=True) if v)] for kind, votes, _ in cells]
    total = sum(n for *_, n in cells) or 1
    weights = {x: 0.0 for some in names for x in some}
    for _ in range(300):
        slope = {x: 1e-3 * w for x, w in weights.items()}
        for some, (_, _, n), y in zip(names, cells, labels, strict=True):
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, sum(weights[x] for x in some)))))
            for x in some:
                slope[x] += (p - y) * n / total
        for x in weights:
            weights[x] -= 2.0 * slope[x]
    return weights


def fit(votes: DataFrame) -> dict[str, float]:
    """The final classifier's weights, from the histogram of kinds and votes."""
    rows = votes.where("kind is not null").groupBy("kind", *LABELERS).count().collect()  # bounded, see above
    cells = sorted((r["kind"], tuple(r[x] for x in LABELERS), r["count"]) for r in rows)
    if not cells:
        return {}
    sums: dict[tuple[int, ...], int] = {}
    for _, v, n in cells:
        sums[v] = sums.get(v, 0) + n
    prior, rates = reliabilities(sorted(sums.items()))
    return train(cells, [posterior(v, prior, rates) for _, v, _ in cells])


def probability(weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for kind in KINDS:
        total = total + F.when(F.col("kind") == kind, F.lit(weights.get(kind, 0.0))).otherwise(F.lit(0.0))
    for name in LABELERS:
        for v in (-1, 1):
            total = total + F.when(F.col(name) == v, F.lit(weights.get(f"{name}:{v}", 0.0))).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def spans(docs: DataFrame) -> DataFrame:
    """uid, doc_id, kind, start, end, base, probability of accepted spans; a null kind for rows without any."""
    votes = land(voted(proposals(docs)), "votes")
    scored = votes.withColumn("probability", probability(fit(votes)))
    order = Window.partitionBy("uid").orderBy("start", "end", "kind")
    # Running frames from the other end: a frame that shrinks would be summed anew for each row.
    back = Window.partitionBy("uid").orderBy(*[F.desc(c) for c in ("start", "end", "kind")])
    held = F.when(F.col("base"), F.col("end")), F.when(F.col("base"), F.col("start"))
    reach = F.max(held[0]).over(order.rowsBetween(Window.unboundedPreceding, -1))
    follow = F.min(held[1]).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(follow >= F.col("end"), F.lit(True)))
    good = F.col("base") | ((F.col("kind") == "other") & (F.col("probability") >= 0.5) & free)
    return scored.withColumn("_good", F.coalesce(good, F.lit(False))).select(
        "uid", "doc_id", *[F.when(F.col("_good"), F.col(c)).alias(c) for c in ("kind", "start", "end", "base", "probability")]
    )


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per row of ``docs``."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    name = F.concat_ws(":", "kind", "start", "end")
    entry = F.struct(F.col("start"), rank.alias("rank"), F.col("end"), name.alias("name"))
    listed = lambda when: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.when(when, entry))), lambda x: x["name"]))
    return (
        spans(docs)
        .groupBy("uid")
        .agg(
            F.first("doc_id").alias("doc_id"),
            *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
            F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
            listed(F.col("kind").isNotNull()).alias("spans"),
        )
        .drop("uid")
    )
