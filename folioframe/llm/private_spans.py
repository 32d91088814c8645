"""Personal data by weak supervision, in DataFrame expressions only.

Labelers vote on candidate spans; expectation-maximisation estimates how reliable each is; the
posteriors train the classifier that decides on all spans that no base rule has settled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.llm.common import let, stored

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# -- patterns: possessive where nothing behind could need a character back, so that each text
# is scanned in linear time; a match starts where a run of its characters starts.
_LOCAL = "[A-Za-z0-9._%+-]"
_LABEL = "[A-Za-z0-9-]++"
_RUN = "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
BASE_EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}(?:\.{_LABEL})++"
BASE_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
BASE_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_AT, _DOT = r" ?[\[(] ?(?:at|AT|@) ?[\])] ?", r" ?[\[(] ?(?:dot|DOT|\.) ?[\])] ?"
LOOSE_EMAIL = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++(?:{_AT}{_LABEL}(?:(?:{_DOT}| (?:dot|DOT) |\.){_LABEL})++"
    rf"| (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL})++)"
)
LOOSE_EMAIL_SIGN = r"[\[(] ?(?:at|AT|@) ?[\])]| (?:dot|DOT) "
LOOSE_IP = r"(?<![0-9])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)| dot )[0-9]{1,3}){3}(?![0-9])"
LOOSE_PHONE = r"(?<![0-9A-Za-z+.(-])(?<![0-9] )\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![ .-]?[0-9])(?![A-Za-z])"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IN_RANGE = rf"^{_PART}(?:\.{_PART}){{3}}$"

# -- gazetteers and context words (fixed values)
DOMAINS = "com org net edu gov io info co de fr es uk eu us ch at it nl"
ISSUERS = "^(?:3[47]|4|5[1-5]|2[2-7]|6)"
FOR = {
    EMAIL: "mail email e-mail contact contacto kontakt courriel correo write reach to at",
    IP: "ip address host server addr adresse from by dirección client",
    CARD: "card visa mastercard amex credit debit karte carte tarjeta cc pan number",
    PHONE: "phone call tel telephone mobile fax cell telefon téléphone teléfono ring at",
}
AGAINST = "isbn issn version order invoice token password id ref sku serial hash page vol no nr build license"
LABELERS = ("form", "check", "gazetteer", "for", "against", "edge")
ROUNDS, CERTAIN = 50, 0.95
WORD_SLOTS, SHAPE_SLOTS = 512, 256


def spans(text: Column, pattern: str, sign: Column) -> Column:
    """Start, end and piece of the non-overlapping matches of texts for which ``sign`` holds.

    The pieces and the gaps between them, laid end to end, give the places in code points.
    """
    kind = "array<struct<start: int, end: int, piece: string>>"

    def lay(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        stop = start + F.length(pair["piece"])
        span = F.struct(start.alias("start"), stop.alias("end"), pair["piece"].alias("piece"))
        return F.struct(stop.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("piece"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("spans"))
    laid = F.aggregate(F.filter(pairs, lambda p: p["piece"].isNotNull()), start, lay, lambda s: s["spans"])
    return F.when(sign, laid).otherwise(F.array().cast(kind))


def digits(piece: Column) -> Column:
    return F.regexp_replace(piece, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(i: Column) -> Column:
        digit = F.substring(number, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    each = F.transform(F.sequence(F.lit(1), F.length(number)), value)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def is_base(kind: int, piece: Column) -> Column:
    """Whether a match of a base pattern stands; a match that fails is not tried again."""
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return piece.rlike(IN_RANGE)
    number = digits(piece)
    if kind == CARD:
        return F.length(number).between(16, 19) & luhn(number)
    return F.length(number).between(8, 15)


def near(text: Column, span: Column) -> tuple[Column, Column]:
    """Up to 48 characters before and one behind."""
    first = F.greatest(span["start"] - 48, F.lit(0))
    return F.substring(text, first + 1, span["start"] - first), F.substring(text, span["end"] + 1, F.lit(1))


def last_words(left: Column) -> Column:
    """The last four words before a span, in lower case, without marks at their ends."""
    words = F.split(F.trim(F.lower(left)), r"[\s]+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.slice(F.reverse(bare), 1, 4)


def choice(kind: Column, of) -> Column:
    """``of(k)`` for the kind k at hand."""
    picked = F.when(kind == 0, of(0))
    for k in range(1, len(KINDS)):
        picked = picked.when(kind == k, of(k))
    return picked


def votes(span: Column, words: Column, right: Column, left: Column) -> Column:
    """One letter per labeler: y, n, or - where it abstains."""
    piece, kind = span["piece"], span["kind"]
    number = digits(piece)
    form = choice(kind, lambda k: {
        EMAIL: piece.rlike(r"@|[\[(]"), IP: piece.rlike(r"^[0-9]{1,3}(?:[^0-9]+[0-9]{1,3}){3}$"),
        CARD: piece.rlike(r"^(?:[0-9]{16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})$"),
        PHONE: piece.rlike(r"^\+|^\([0-9]{3}\)|^[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}$")}[k])
    check = choice(kind, lambda k: {
        EMAIL: piece.rlike(r"[A-Za-z]"), IP: F.regexp_replace(piece, r"[^0-9]+", ".").rlike(IN_RANGE),
        CARD: luhn(number), PHONE: ~number.rlike(r"^([0-9])\1+$")}[k])
    known = choice(kind, lambda k: {
        EMAIL: F.lower(F.regexp_extract(piece, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS.split()),
        IP: ~piece.rlike(r"^0"), CARD: number.rlike(ISSUERS), PHONE: ~F.substring(number, 1, 1).isin("0")}[k])
    told = choice(kind, lambda k: F.arrays_overlap(words, F.array(*map(F.lit, FOR[k].split()))))
    warned = F.arrays_overlap(words, F.array(*map(F.lit, AGAINST.split())))
    inside = F.substring(left, -1, 1).rlike(r"[\p{L}\p{N}_=:/\"]") | right.rlike(r"[\p{L}\p{N}_=/\"]")

    def letter(yes: Column | None, no: Column | None) -> Column:
        said = F.lit("-")
        if no is not None:
            said = F.when(no, "n").otherwise(said)
        return F.when(yes, "y").otherwise(said) if yes is not None else said

    return F.concat(
        letter(form, ~form), letter(check, ~check), letter(known, ~known), letter(told, None), letter(None, warned),
        letter(~inside, inside))


def traits(span: Column, words: Column, right: Column, left: Column) -> Column:
    """What the span classifier looks at: a bounded number of values each."""
    side = lambda c: (
        F.when(c == "", "edge").when(c.rlike(r"\s"), "blank").when(c.rlike(r"[\p{L}]"), "letter")
        .when(c.rlike(r"[0-9]"), "digit").otherwise("mark"))
    shape = F.regexp_replace(F.regexp_replace(span["piece"], "[0-9]+", "9"), "[A-Za-z]+", "a")
    return F.array(
        F.concat(F.lit("length "), F.least(F.floor((span["end"] - span["start"]) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("digits "), F.least(F.length(digits(span["piece"])), F.lit(20)).cast("string")),
        F.concat(F.lit("before "), side(F.substring(left, -1, 1))),
        F.concat(F.lit("behind "), side(right)),
        F.concat(F.lit("shape "), F.pmod(F.xxhash64(shape), F.lit(SHAPE_SLOTS)).cast("string")),
        F.concat(F.lit("word "), F.pmod(F.xxhash64(F.get(words, F.lit(0))), F.lit(WORD_SLOTS)).cast("string")),
    )


def candidates(text: Column) -> Column:
    """All spans that any pattern proposes, with votes and traits; base ones are marked.

    A loose span that touches a base span is not proposed.
    """
    def tagged(found: Column, kind: int, base) -> Column:
        return F.transform(found, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["piece"].alias("piece"),
            base(s["piece"]).alias("base")))

    has = lambda part: F.contains(text, F.lit(part))
    never = lambda piece: F.lit(False)
    found = F.concat(
        tagged(spans(text, BASE_EMAIL, has("@")), EMAIL, lambda p: F.lit(True)),
        tagged(F.filter(spans(text, BASE_IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: is_base(IP, s["piece"])), IP, lambda p: F.lit(True)),
        tagged(spans(text, _RUN, text.rlike(_RUN)), CARD, lambda p: is_base(CARD, p)),
        tagged(F.filter(spans(text, BASE_PHONE, has("+")), lambda s: is_base(PHONE, s["piece"])), PHONE, lambda p: F.lit(True)),
        tagged(spans(text, LOOSE_EMAIL, text.rlike(LOOSE_EMAIL_SIGN)), EMAIL, never),
        tagged(spans(text, LOOSE_IP, has("[.]") | has("(.)") | has(" dot ")), IP, never),
        tagged(spans(text, LOOSE_PHONE, text.rlike(LOOSE_PHONE)), PHONE, never),
    )

    def told(span: Column) -> Column:
        left, right = near(text, span)
        return let(last_words(left), lambda words: F.struct(
            span["kind"].alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["base"].alias("base"),
            votes(span, words, right, left).alias("votes"), traits(span, words, right, left).alias("traits")))

    def apart(all_found: Column) -> Column:
        base = F.filter(all_found, lambda s: s["base"])
        free = F.filter(all_found, lambda s: s["base"] | ~F.exists(
            base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.transform(F.array_sort(free), told)

    return let(found, apart)


@dataclass(frozen=True)
class Model:
    """Prior log odds of each kind and the weight of each trait, as plain numbers."""

    prior: dict[str, float]
    weights: dict[str, float]


def reliabilities(rows: list[tuple[int, str, bool, int]]) -> dict[tuple[int, str], float]:
    """Posterior that a span is personal data, by kind and votes, after EM.

    ``rows``: kind, votes, base, count; at most 4 x 3^6 x 2 of them. Base spans are known to be
    positive. Each labeler has, for each kind, the chances of its three answers for either truth.
    """
    half = {"y": 0.8, "n": 0.2, "-": 0.5}
    chance = {}
    for kind, said, base, _ in rows:
        votes_for = [half[v] for v in said if v != "-"]
        chance[kind, said, base] = 1.0 if base else sum(votes_for) / len(votes_for) if votes_for else 0.5
    posterior: dict[tuple[int, str], float] = {}
    for _ in range(ROUNDS):
        table: dict = {}
        total: dict = {}
        for kind, said, base, n in rows:
            p = chance[kind, said, base]
            for truth, weight in ((1, p * n), (0, (1 - p) * n)):
                total[kind, truth] = total.get((kind, truth), 0.0) + weight
                for labeler, answer in enumerate(said):
                    table[kind, truth, labeler, answer] = table.get((kind, truth, labeler, answer), 0.0) + weight
        for kind, said, base, _ in rows:
            odds = math.log((total[kind, 1] + 1) / (total[kind, 0] + 1))
            for labeler, answer in enumerate(said):
                up, down = ((table.get((kind, t, labeler, answer), 0.0) + 1) / (total[kind, t] + 3) for t in (1, 0))
                odds += math.log(up / down)
            posterior[kind, said] = 1 / (1 + math.exp(-max(-60.0, min(60.0, odds))))
            chance[kind, said, base] = 1.0 if base else posterior[kind, said]
    return posterior


def lookup(values: dict[str, float]) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(0.0))


def train(marked: DataFrame) -> Model:
    """A span classifier from ``marked(cands)``: log odds of each trait under the posteriors.

    Both passes are plain sums over all candidates; what reaches the driver has one row per
    pattern of votes or per trait value, whose number is fixed.
    """
    each = marked.select(F.explode("cands").alias("c")).select("c.*")
    counts = each.groupBy("kind", "votes", "base").agg(F.count("*").alias("n")).collect()
    posterior = reliabilities(sorted((r.kind, r.votes, r.base, r.n) for r in counts))
    soft = F.coalesce(
        F.when(F.col("base"), 1.0),
        F.try_element_at(lookup({f"{k} {v}": p for (k, v), p in posterior.items()}), F.concat_ws(" ", "kind", "votes")), F.lit(0.5))
    sums = (
        each.select("kind", soft.alias("p"), F.explode(F.concat(F.array(F.lit("")), F.col("traits"))).alias("trait"))
        .groupBy("kind", "trait").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    )
    totals = {r.kind: (r.yes, r.no) for r in sums if r.trait == ""}
    prior = {str(k): math.log((yes + 1) / (no + 1)) for k, (yes, no) in totals.items()}
    weights = {
        f"{r.kind} {r.trait}": math.log((r.yes + 1) / (totals[r.kind][0] + 2) * (totals[r.kind][1] + 2) / (r.no + 1))
        for r in sums if r.trait
    }
    return Model(prior, weights)


def find(docs: DataFrame, model: Model | None = None, certain: float = CERTAIN) -> DataFrame:
    """Per row of ``docs(doc_id, text)`` the base counts, their digest and all spans.

    ``spans`` lists kind:start:end, in code points, end exclusive: base spans and those that
    the classifier gives a probability of ``certain`` or more, if at least two more labelers
    confirm than deny them and one of check and context does. A null or empty text has none:
    counts 0, the digest of the empty string, an empty list. Repeated rows are judged alike.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = stored(docs.select("doc_id", candidates(text).alias("cands")), "private-spans")
    model = model or train(marked)
    weights, prior = lookup(model.weights), lookup(model.prior)

    def odds(c: Column) -> Column:
        kind = c["kind"].cast("string")
        start = F.coalesce(F.try_element_at(prior, kind), F.lit(0.0))
        parts = F.transform(c["traits"], lambda t: F.coalesce(F.try_element_at(weights, F.concat(kind, F.lit(" "), t)), F.lit(0.0)))
        return start + F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    def backed(c: Column) -> Column:
        marks = lambda v: F.length(F.regexp_replace(c["votes"], f"[^{v}]", ""))
        vouched = F.substring(c["votes"], 2, 1).isin("y") | F.substring(c["votes"], 4, 1).isin("y")
        return (marks("y") >= marks("n") + 2) & vouched

    def listed(found: Column) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(found, lambda c: F.concat_ws(
            ":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")

    base = F.filter("cands", lambda c: c["base"])
    final = F.filter("cands", lambda c: c["base"] | (backed(c) & (odds(c) >= math.log(certain / (1 - certain)))))
    counts = [F.size(F.filter("cands", (lambda k: lambda c: c["base"] & (c["kind"] == k))(k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(KINDS)]
    return marked.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(final).alias("spans"))
