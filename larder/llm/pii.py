"""Personal data by weak supervision: regex, gazetteer and context labelers vote, expectation-maximisation weighs them, a span classifier decides (native)."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

# Patterns of the four base kinds. They match what the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
# match, leftmost first; possessive runs and looks behind keep them linear in very long words.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to hold a match of a kind.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9][\x20().0-9-]"}
# Gazetteers of given names (common ones in English, German, French and Spanish), titles, endings
# of hosts, calling codes, and first digits of cards.
GIVEN_NAMES = """
Adam Agnes Alan Albert Alejandro Alexander Alice Amanda Amelia Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antoine Antonio Barbara Beatriz Benjamin Bernard Birgit Brian
Camille Carla Carlos Carmen Carol Catherine Charles Charlotte Christian Christine Claire Claudia Daniel David Deborah Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric
Fernando Francisco Frank Friedrich Gabriel George Greta Hans Heinrich Helen Helga Henri Ingrid Isabel Isabella Jack Jacques James Jane Javier Jean Jennifer Jessica Joan Johannes
John Jorge Joseph Juan Judith Julia Julie Jürgen Karen Karin Karl Kevin Klaus Laura Laurent Linda Lisa Louis Lucas Lucia Luis Manuel Margaret Maria Marie Mark Marta Martin Mary
Matthew Michael Miguel Monika Nancy Nathalie Nicolas Nicole Olivia Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Rafael Rebecca Richard Robert Rosa Ruth Sabine Samuel
Sandra Sara Sarah Sofia Sophie Stefan Stephanie Steven Susan Sylvie Teresa Thomas Ursula Victor Walter William Wolfgang
""".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Señor Señora".split()
HOSTS = "com org net edu gov io de fr es uk eu info".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split()
CARDS = "34 36 37 38 4 51 52 53 54 55 60 62 65 2".split()


def any_of(words: list[str]) -> str:
    """A pattern of any of the words, by first letter, so that a text is not tried against all of them at each place."""
    by: dict[str, list[str]] = {}
    for word in words:
        by.setdefault(word[0], []).append(word[1:])
    return "(?=\\p{Lu})(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(by.items())) + ")"


_NAMES = any_of(TITLES + GIVEN_NAMES)
#: Kinds that the method adds: candidates are what a broad pattern finds, labelers and classifier decide.
ADDED = {
    "name": rf"(?<!\p{{L}}){_NAMES}\.?\x20\p{{Lu}}\p{{Ll}}++(?:\x20\p{{Lu}}\p{{Ll}}++)?+",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "near_card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])",
    "near_phone": r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++(?:(?:\x20?[(\[](?:dot|DOT)[)\]]\x20?|\.)[A-Za-z0-9-]++)++",
}
NEEDS |= {"name": rf"{_NAMES}\.?\x20\p{{Lu}}", "national_id": r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "near_card": NEEDS["card"], "near_phone": NEEDS["phone"], "spelled_email": r"[(\[](?:at|AT)[)\]]"}
KINDS = [*BASE, *ADDED]
# Words near a span that speak for its kind, and words that speak against any kind.
CUES = {
    "email": "e-?mail|mailto|contact|write|reach|correo|courriel|adresse", "ip": "ip|server|host|address|login|from", "card": "card|visa|credit|payment|pay|karte|tarjeta|carte",
    "phone": "phone|tel|call|mobile|fax|cell|whatsapp|telefon|t[eé]l[eé]fono", "name": "name|dear|by|contact|signed|from|nom|nombre", "national_id": "ssn|social|security|tax|national|id|passport",
    "spelled_email": "e-?mail|contact|write|reach|correo|courriel",
}
CUES |= {"near_card": CUES["card"], "near_phone": CUES["phone"]}
AGAINST = "version|release|build|isbn|issn|order|invoice|section|chapter|figure|table|page|vol|sha|commit"
LABELERS = ("strict", "listed", "cue", "against", "apart")
NEAR = 40
ROUNDS = 30
#: How many spans of a kind weigh as much as those of all kinds, when a labeler's reliability for the kind is estimated.
PULL = 50
#: Items of a block of ``running``.
BLOCK = 256
MOST = (1 << 31) - 1
SIZES, WORDS = 8, 32
#: Features of a span besides its votes, and how many values each has; the weight of their log-odds, as neighbouring features tell alike.
FEATURES = {"size": SIZES, "shape": 16, "left_word": WORDS, "right_word": WORDS}
FEATURE_WEIGHT, SMOOTH = 0.5, 1.0


def located(text: Column, pattern: str, needs: str) -> tuple[Column, Column]:
    """Texts between the matches of a pattern (one more than matches), and the matches; none where ``needs`` fails."""
    may = text.rlike(needs)
    none = F.array().cast("array<string>")
    return F.when(may, F.split(text, pattern, -1)).otherwise(none), F.when(may, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    step = F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 0, _doubled(F.substring(digits, n - i + 1, F.lit(1)).cast("int"))).otherwise(F.substring(digits, n - i + 1, F.lit(1)).cast("int")),
    )
    return step % 10 == 0


def _doubled(d: Column) -> Column:
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def _valid(kind: str, value: Column) -> Column:
    """What the contract asks of a base match beyond its pattern."""
    if kind == "ip":
        small = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(small(p)) <= 3) & (F.substring(small(p), 1, 3).cast("int") <= 255))
    if kind in ("card", "near_card"):
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind in ("phone", "near_phone"):
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _vote(good: Column, bad: Column | None = None) -> Column:
    """1 for, 2 against, 0 abstains."""
    v = F.when(good, F.lit(1))
    return (v if bad is None else v.when(bad, F.lit(2))).otherwise(F.lit(0))


def _votes(kind: str, value: Column, left: Column, right: Column) -> list[Column]:
    digits = F.regexp_replace(value, "[^0-9]", "")
    strict = {
        "email": value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}$"),
        "ip": value.rlike(r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"),
        "card": F.length(digits).isin(15, 16), "phone": F.length(digits).between(11, 13),
        "name": value.rlike(rf"^(?:{'|'.join(TITLES)})\.? "), "national_id": ~value.rlike(r"^(?:000|666|9)|-00-|-0000$"), "spelled_email": value.rlike(r"[A-Za-z]{2,}$"),
    }[kind.removeprefix("near_")]
    listed = {
        "email": value.rlike(rf"\.(?:{'|'.join(HOSTS)})$"), "ip": ~value.rlike(r"^(?:0|22[4-9]|23[0-9]|24[0-9]|25[0-5])\."), "card": digits.rlike(f"^(?:{'|'.join(CARDS)})"),
        "phone": digits.rlike(f"^(?:{'|'.join(CALLING)})"), "name": value.rlike(rf"(?<!\p{{L}}){any_of(GIVEN_NAMES)}(?!\p{{L}})"),
        "national_id": value.rlike("^(?:[0-6][0-9]{2}|7[0-6][0-9]|77[0-2])-"),  # areas that were ever dealt out
        "spelled_email": value.rlike(rf"(?:{'|'.join(HOSTS)})$"),
    }[kind.removeprefix("near_")]
    near = F.lower(F.concat(F.right(left, F.lit(NEAR)), F.lit(" "), F.left(right, F.lit(NEAR // 2))))
    apart = left.rlike(r"(?:^|[\s(\[<\"':;,.=])$") & right.rlike(r"^(?:$|[\s)\]>\"':;,.!?])")
    return [_vote(strict, ~strict), _vote(listed), _vote(near.rlike(rf"(?<!\p{{L}})(?:{CUES[kind]})(?!\p{{L}})")), _vote(F.lit(False), near.rlike(rf"(?<!\p{{L}})(?:{AGAINST})(?!\p{{L}})")), _vote(apart, ~apart)]


def _word_code(context: Column, pattern: str) -> Column:
    """A hashed neighbouring word, 1 to WORDS - 1, or 0 without one."""
    word = F.regexp_extract(F.lower(context), pattern, 1)
    return F.when(word == "", F.lit(0)).otherwise(F.pmod(F.crc32(word), F.lit(WORDS - 1)).cast("int") + 1)


def _features(value: Column, left: Column, right: Column) -> list[Column]:
    """What the classifier sees of a span, a small number each: size, characters, the words before and after."""
    size = F.least(F.lit(SIZES - 1), F.floor(F.log2(F.length(value))).cast("int"))
    shape = sum((value.rlike(p).cast("int") * (1 << i) for i, p in enumerate(("[A-Z]", "[a-z]", "[0-9]{3}", r"[\x20().-]"))), F.lit(0))
    return [size, shape.cast("int"), _word_code(left, r"(\p{L}+)[^\p{L}]*$"), _word_code(right, r"^[^\p{L}]*(\p{L}+)")]


def _shown(valid: Column, ord_: int, kind: str) -> Column:
    def shown(x):
        votes = _votes(kind, x["value"], x["left"], x["right"])
        code = sum((v * 3**i for i, v in enumerate(votes[1:], 1)), votes[0])
        seen = zip(FEATURES, _features(x["value"], x["left"], x["right"]), strict=True)
        return F.struct(x["start"].alias("start"), F.lit(ord_).alias("ord"), x["end"].alias("end"), code.cast("int").alias("votes"), *[c.alias(n) for n, c in seen])

    return F.transform(valid, shown)


def running(items: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each item the number that ``step`` has made of those before it, starting from 0.

    An array that grows in an aggregate is copied at each item; here it is BLOCK items at most, and
    then one array a block, so that very many items cost little more than in proportion.
    """
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK)))
    parts = F.when(F.size(items) > 0, parts)

    def inside(part, at):
        start = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, start, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))

    def add(acc, part):
        found = inside(part, acc["at"])
        return F.struct(found["at"].alias("at"), F.concat(acc["out"], F.array(found["out"])).alias("out"))

    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), add, lambda acc: F.flatten(acc["out"]))
    return F.coalesce(whole, F.array().cast("array<int>"))


def candidates(docs: DataFrame) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, and ``found``: array of (start, ord, end, votes, features) of all valid
    base matches and of the candidates of added kinds that overlap none of these, so that nothing is observed twice.
    As a struct, no input column can clash with an inner one.

    Offsets are sums of the lengths of the texts between matches and of the matches, in code points.
    """
    wide = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    wide = wide.withColumns({f"{part}_{kind}": col for kind in KINDS for part, col in zip(("gaps", "hits"), located(text, (BASE | ADDED)[kind], NEEDS[kind]), strict=True)})
    spans = []
    for ord_, kind in enumerate(KINDS):
        gaps, hits = F.col(f"gaps_{kind}"), F.col(f"hits_{kind}")
        pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), hits.alias("h"), F.slice(gaps, F.lit(2), F.size(hits)).alias("r"))

        def hit(x, at):
            begin = at + F.length(x["g"])
            left, right = F.right(x["g"], F.lit(NEAR)), F.left(x["r"], F.lit(NEAR))
            return F.struct(begin.alias("start"), (begin + F.length(x["h"])).alias("end"), x["h"].alias("value"), left.alias("left"), right.alias("right"))

        found = F.zip_with(pairs, running(pairs, lambda at, x: at + F.length(x["g"]) + F.length(x["h"])), hit)
        spans.append(_shown(F.filter(found, lambda x: _valid(kind, x["value"])), ord_, kind))  # noqa: B023
    return wide.select("row", F.array_sort(F.concat(*spans)).alias("found")).select("row", _apart(F.col("found")).alias("found"))


def _apart(found: Column) -> Column:
    """``found``, sorted by start and kind, without added spans that overlap a base one.

    Such a base span begins before the added one and ends after its start, or begins after it and before its end;
    a scan from each side tells the last end and the next start, in proportion to the spans.
    """
    base = lambda x: x["ord"] < len(BASE)
    ends = running(found, lambda at, x: F.greatest(at, F.when(base(x), x["end"]).otherwise(0)))
    # the least start of what follows, as the greatest distance from the largest int
    starts = F.reverse(running(F.reverse(found), lambda at, x: F.greatest(at, F.when(base(x), MOST - x["start"]).otherwise(0))))
    marked = F.arrays_zip(found.alias("x"), ends.alias("ended"), starts.alias("begins"))
    free = F.filter(marked, lambda m: base(m["x"]) | (m["ended"] <= m["x"]["start"]) & (MOST - m["begins"] >= m["x"]["end"]))
    mixed = F.exists(found, base) & F.exists(found, lambda x: ~base(x))
    return F.when(mixed, F.transform(free, lambda m: m["x"])).otherwise(found)


@dataclass
class SpanModel:
    """Log-odds of a span being personal data: a weight per kind, per kind and vote of each labeler, and per kind and value of each feature."""

    kind: list[float]
    votes: list[list[float]]  # of each labeler, three of each kind
    features: dict[str, list[float]]

    def odds(self, span: Column) -> Column:
        pick = lambda w, at: F.element_at(F.array(*[F.lit(float(x)) for x in w]), (at + 1).cast("int"))
        total = pick(self.kind, span["ord"])
        for i, w in enumerate(self.votes):
            total = total + pick(w, span["ord"] * 3 + F.floor(span["votes"] / F.lit(3**i)).cast("int") % 3)
        for name, w in self.features.items():
            total = total + pick(w, span["ord"] * FEATURES[name] + span[name])
        return total


#: What a labeler votes, at the start, on personal data and on other spans: abstains, for, against.
START = {1: [0.25, 0.6, 0.15], 0: [0.25, 0.15, 0.6]}
Tables = list[dict[int, list[float]]]


def _table(patterns: list[tuple[int, float, float]], labeler: int, start: dict[int, list[float]], pull: float) -> dict[int, list[float]]:
    """How often a labeler votes what on either class, of (vote pattern, spans, share of personal data) and ``start`` as ``pull`` spans more."""
    t = {}
    for y in (0, 1):
        weight = [0.0, 0.0, 0.0]
        for p, n, share in patterns:
            weight[p // 3**labeler % 3] += n * (share if y else 1 - share)
        t[y] = [(w + pull * s) / (sum(weight) + pull) for w, s in zip(weight, start[y], strict=True)]
    for v in (1, 2):  # a vote never speaks against what it is for
        if (t[1][v] < t[0][v]) == (v == 1):
            t[1][v] = t[0][v] = (t[1][v] + t[0][v]) / 2
    return {y: [x / sum(t[y]) for x in t[y]] for y in (0, 1)}


def reliabilities(patterns: list[tuple[int, int, float]], rounds: int = ROUNDS, pull: float = PULL) -> tuple[dict[tuple[int, int], float], dict[int, float], dict[int, Tables]]:
    """Posterior of each (kind, vote pattern) given how often it occurs, the share of personal data in each kind, and for each
    kind and labeler how often it votes what (1 for personal data, 0 for other spans), by expectation-maximisation.

    Two classes; each labeler's votes are independent given the class, with a prior per kind. Its reliability for a kind
    is that for all kinds, with a weight of ``pull`` spans, and what the kind's own spans show, so kinds with few
    spans share and those with many have their own. Starts from labelers that are right four times in five.
    """
    kinds = sorted({k for k, _, _ in patterns})
    prior = dict.fromkeys(kinds, 0.7)
    tables = {k: [START] * len(LABELERS) for k in kinds}
    post: dict[tuple[int, int], float] = {}
    for _ in range(rounds):
        for k, p, _n in patterns:
            a, b = math.log(prior[k]), math.log(1 - prior[k])
            for i, t in enumerate(tables[k]):
                v = p // 3**i % 3
                a, b = a + math.log(t[1][v]), b + math.log(t[0][v])
            post[k, p] = 1 / (1 + math.exp(max(-50, min(50, b - a))))
        seen = {k: [(p, n, post[kk, p]) for kk, p, n in patterns if kk == k] for k in kinds}
        for k in kinds:
            share = (sum(n * y for _, n, y in seen[k]) + 0.7) / (sum(n for _, n, _ in seen[k]) + 1)
            prior[k] = min(max(share, 0.001), 0.999)
        shared = [_table([x for k in kinds for x in seen[k]], i, START, 5) for i in range(len(LABELERS))]
        tables = {k: [_table(seen[k], i, t, pull) for i, t in enumerate(shared)] for k in kinds}
    return post, prior, tables


def train_spans(found: DataFrame) -> SpanModel:
    """The classifier from all candidates of ``found``: votes by the labelers' reliabilities, features by their share of
    soft labels, what expectation-maximisation takes each candidate for.

    Only counts per kind and vote pattern, 9 * 3**5 rows at most, and per kind and value of a feature, 9 * 88
    rows at most, reach the driver. Without candidates all weights are 0.
    """
    spans = found.select(F.explode("found").alias("s")).select("s.*")
    rows = spans.groupBy("ord", "votes").count().orderBy("ord", "votes").collect()
    model = SpanModel([0.0] * len(KINDS), [[0.0] * (3 * len(KINDS)) for _ in LABELERS], {n: [0.0] * (len(KINDS) * size) for n, size in FEATURES.items()})
    if not rows:
        return model
    post, prior, tables = reliabilities([(r["ord"], r["votes"], float(r["count"])) for r in rows])
    for k, share in prior.items():
        model.kind[k] = math.log(share / (1 - share))
    for k, own in tables.items():
        for weights, t in zip(model.votes, own, strict=True):
            weights[3 * k : 3 * k + 3] = [math.log(t[1][v] / t[0][v]) for v in range(3)]
    values = ", ".join(f"({k}, {p}, {y!r}D)" for (k, p), y in sorted(post.items()))
    soft = found.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(ord, votes, y)")
    seen = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(n).alias("value")) for i, n in enumerate(FEATURES)])
    labelled = spans.join(F.broadcast(soft), ["ord", "votes"]).select("ord", "y", F.explode(seen).alias("f"))
    sums = labelled.groupBy("ord", "f.feature", "f.value").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    names = list(FEATURES)
    totals: dict[tuple[int, int], list[float]] = {}
    cells = [(r["ord"], r["feature"], r["value"], r["good"], r["bad"]) for r in sums.collect()]
    for k, f, _, good, bad in cells:
        total = totals.setdefault((k, f), [0.0, 0.0])
        total[0], total[1] = total[0] + good, total[1] + bad
    for k, f, v, good, bad in cells:
        all_good, all_bad = totals[k, f]
        share = (good + SMOOTH) / (all_good + 2 * SMOOTH), (bad + SMOOTH) / (all_bad + 2 * SMOOTH)
        model.features[names[f]][k * FEATURES[names[f]] + v] = FEATURE_WEIGHT * max(-3.0, min(3.0, math.log(share[0] / share[1])))
    return model


def decided(found: DataFrame, model: SpanModel) -> DataFrame:
    """``row`` and ``spans``, array of (start, ord, end): all base spans, and the added ones that the
    classifier finds likelier personal than not. Candidates overlap no base span."""
    kept = F.filter("found", lambda x: (x["ord"] < len(BASE)) | (model.odds(x) > 0))
    return found.select("row", F.transform(kept, lambda x: F.struct(x["start"], x["ord"], x["end"])).alias("spans"))


def _listing(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    one = lambda x: F.concat_ws(":", F.element_at(kinds, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every whole text.

    Base matches are leftmost and non-overlapping per kind; an ip with a part over 255, a card
    without 14 to 19 digits that pass the Luhn sum, and a phone without 10 to 15 digits are
    dropped. The method adds spans of the kinds name, national_id, near_card and near_phone
    (such inside a dropped match) and spelled_email.
    spans lists kind:start:end by start, then kind; offsets are code points, the end exclusive.

    Null and empty text have no spans (the digest of an empty text). Repeated rows get equal
    results; other columns are not read. No rows give no rows.
    """
    found = candidates(docs.select("doc_id", "text")).select(F.struct("row.doc_id").alias("row"), "found")
    found = written(found, "pii-candidates")
    out = decided(found, train_spans(found)).select("row.doc_id", "spans")
    base = F.filter("spans", lambda x: x["ord"] < len(BASE))
    count = lambda o: F.size(F.filter("spans", lambda x: x["ord"] == o)).cast("long")
    return out.select(
        "doc_id", *[count(o).alias(f"n_{k}") for o, k in enumerate(BASE)], F.sha2(_listing(base), 256).alias("base_sha256"),
        _listing(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda x: x["ord"] >= len(BASE))).cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every personal span replaced by its kind in capitals and brackets; overlapping spans become one.

    n_chars, where it is a column, counts the new text. Null text stays null, texts without spans stay as they
    are, repeated rows stay equal, all other columns pass, whatever their names. No rows give no rows.
    The patterns run once: rows and candidates are written, then the classifier is trained and applied to them.
    """
    found = written(candidates(docs), "pii-candidates")
    marked = decided(found, train_spans(found))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("row.text")
    # for each span, where the spans before it end
    before = running(F.col("spans"), lambda at, x: F.greatest(at, x["end"]))
    pieces = F.zip_with("spans", before, lambda x, at: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.element_at(kinds, x["ord"] + 1))).otherwise(""))
    last = F.array_max(F.transform("spans", lambda x: x["end"]))
    whole = F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))
    cut = marked.select("row", F.when(F.size("spans") > 0, whole).otherwise(text).alias("text"))
    made = {"text": F.col("text")} | ({"n_chars": F.char_length("text").cast("long")} if "n_chars" in docs.columns else {})
    return cut.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
