"""Personal data by candidate gradient boosting, in DataFrame operations only.

High-recall patterns propose spans of a text: the base kinds, which are always kept, and
wider ones (spelled-out addresses, grouped numbers, national formats, secrets after a
key word).  Each wider candidate gets format and context features; boosted regression
trees, trained here on sentences built from stated frames, turn them into a score, and
the calibrated threshold selects the redactions.  The trees are compiled to SQL CASE
expressions, so that scoring stays inside Spark.

Cases: null text is empty; a text without matches has no spans; repeated rows are
searched each; very long texts, and texts with very many matches, are searched whole.  Patterns over digits or addresses are
written so that the engine's stack and time stay bounded on long runs.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds, in the order in which spans that start together are listed.
KINDS = ["email", "ip", "card", "phone"]

# Patterns of the base kinds.  `(?:\G|(?<!..))` starts a run only at its beginning or
# where the last match ended, which finds the same matches in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: On a text in which separators that do not stand between two digits have been replaced.
CARD = r"[0-9][\x20\-0-9]+"
LOOSE_SEPARATOR = r"(?<![0-9])[\x20-](?=[0-9])|[\x20-](?![0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

# Wider candidates: kind and pattern.  Runs have no upper length, so that no tail of one stays behind.
WIDER = [
    ("email", r"(?<![A-Za-z0-9._-])[A-Za-z][A-Za-z0-9._-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b"),
    ("phone", r"(?<![\w+.-])\(?0?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![\w.-])"),
    ("ssn", r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("secret", r"(?i)\b(?:password|passwd|secret|token|api[_-]?key)\b ?[=:] ?[\"']?[A-Za-z0-9+/_=-]{8,}+"),
    ("secret", r"(?<![A-Za-z0-9_-])(?:AKIA|ASIA|ghp_|gho_|sk-|xox[abp]-)[A-Za-z0-9_-]{12,}+"),
]
ALL_KINDS = [*KINDS, "iban", "secret", "ssn"]

CONTEXT_CHARS = 24
CUES = r"(?i)\b(?:call|phone|tel|mobile|contact|mail|email|reach|write|ssn|social|iban|account|pay|login|user)\b"
ANTI_CUES = r"(?i)\b(?:version|order|invoice|isbn|model|page|chapter|section|serial|ticket|build|score|room)\b"

FEATURES = ["is_email", "is_phone", "is_ssn", "is_iban", "is_secret", "n_chars", "n_digits", "n_letters", "n_separators", "distinct", "cue", "anti_cue"]


def _luhn(digits: Column) -> Column:
    """Luhn's check on a string of digits, read from the right."""
    reverse = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(reverse))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running values of an array under an associative `combine`, in log2(size) passes over it."""
    passes = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    step = lambda acc, k: F.transform(acc, lambda x, i: F.coalesce(combine(x, F.get(acc, i - F.pow(F.lit(2), k).cast("int"))), x))
    return F.aggregate(passes, values, step)


def located(text: Column, pattern: str) -> Column:
    """The matches of a pattern in order, as structs (start, body): starts add up the lengths of
    the pieces between matches and of the matches before.

    The arrays are arguments of functions and not named inside lambdas, which would work them out
    again for each element."""
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda gap, body: F.struct((F.length(gap) + F.coalesce(F.length(body), F.lit(0))).alias("size"), body.alias("body")),
    )
    ends = running(F.transform(pieces, lambda p: p["size"]), lambda x, y: x + y)
    rows = F.zip_with(pieces, ends, lambda p, e: F.struct((e - F.length(p["body"])).alias("start"), p["body"].alias("body")))
    return F.filter(rows, lambda x: x["body"].isNotNull())


def _as_spans(kind: str, rows: Column) -> Column:
    return F.transform(rows, lambda r: F.struct(r["start"].alias("start"), F.lit(ALL_KINDS.index(kind)).alias("rank"), (r["start"] + F.length(r["body"])).alias("stop"), r["body"].alias("body")))


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each base kind, failing matches dropped."""
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,body:string>>")
    emails = F.when(F.instr(text, "@") > 0, _as_spans("email", located(text, EMAIL))).otherwise(none)

    def small(part: Column) -> Column:
        rest = F.ltrim(part, F.lit("0"))
        return (F.length(rest) <= 3) & (F.coalesce(rest.try_cast("int"), F.lit(0)) <= 255)

    ips = F.filter(_as_spans("ip", located(text, IP)), lambda s: F.forall(F.split(s["body"], "\\."), small))
    ips = F.when(F.rlike(text, F.lit(r"[0-9]\.[0-9]")), ips).otherwise(none)
    tight = F.regexp_replace(text, LOOSE_SEPARATOR, "_")
    cards = F.filter(_as_spans("card", located(tight, CARD)), lambda s: F.length(_digits(s["body"])).between(12, 19))
    cards = F.filter(cards, lambda s: _luhn(_digits(s["body"])))
    cards = F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), cards).otherwise(none)
    phones = F.filter(_as_spans("phone", located(text, PHONE)), lambda s: F.length(_digits(s["body"])).between(9, 15))
    phones = F.when(F.instr(text, "+") > 0, phones).otherwise(none)
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def features(kind_rank: Column, body: Column, before: Column) -> dict[str, Column]:
    """Format and context features of a candidate."""
    flags = {f"is_{k}": (kind_rank == ALL_KINDS.index(k)).cast("double") for k in ("email", "phone", "ssn", "iban", "secret")}
    count = lambda pattern: (F.length(body) - F.length(F.regexp_replace(body, pattern, ""))).cast("double")
    return flags | {
        "n_chars": F.length(body).cast("double"),
        "n_digits": count("[0-9]"),
        "n_letters": count("[A-Za-z]"),
        "n_separators": count("[^0-9A-Za-z]"),
        "distinct": F.size(F.array_distinct(F.split(_digits(body), ""))).cast("double"),
        "cue": F.rlike(before, F.lit(CUES)).cast("double"),
        "anti_cue": F.rlike(before, F.lit(ANTI_CUES)).cast("double"),
    }


# Sentences that the trees are trained on: kind, whether it is personal, text before, candidate.
def training_rows(n: int = 4000, seed: int = 7) -> list[tuple[list[float], int]]:
    """Features and label of candidates in built sentences: frames that introduce personal data,
    frames that introduce other numbers, and bare ones."""
    rng = random.Random(seed)
    cues = ["call me on ", "phone: ", "my ssn is ", "account iban ", "write an email to ", "contact ", "user login ", ""]
    others = ["order ", "version ", "isbn ", "serial ", "ticket ", "invoice no ", "page ", ""]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    rows = []
    for _ in range(n):
        kind = rng.choice(["email", "phone", "ssn", "iban", "secret"])
        good = rng.random() < 0.5
        if kind == "email":
            body = f"{word(6)} at {word(7)} dot com" if good else f"{word(4)} at {word(3)} dot {word(9)}"
            if good and rng.random() < 0.5:
                body = f"{word(6)} (at) {word(7)} (dot) org"
        elif kind == "phone":
            body = f"({digits(3)}) {digits(3)}-{digits(4)}" if good else f"{digits(2)}.{digits(3)}.{digits(3)}"
        elif kind == "ssn":
            body = f"{digits(3)}-{digits(2)}-{digits(4)}"
        elif kind == "iban":
            body = f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)} " + " ".join(digits(4) for _ in range(4)) if good else f"AB{digits(2)} " + " ".join(word(4).upper() for _ in range(3))
        else:
            body = f"{rng.choice(['password', 'token', 'secret'])}={''.join(rng.choice('0123456789abcdef') for _ in range(18))}" if good else f"token: {word(9)}"
            if good and rng.random() < 0.4:
                body = rng.choice(["AKIA", "ghp_", "sk-"]) + "".join(rng.choice("0123456789ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(rng.choice([16, 24])))
        frame = rng.choice(cues if good and rng.random() < 0.9 else others)
        rows.append((python_features(kind, body, frame), int(good)))
    return rows


def python_features(kind: str, body: str, before: str) -> list[float]:
    """The features of one candidate, as `features` gives them."""
    digits = re.sub("[^0-9]", "", body)
    values = [float(kind == k) for k in ("email", "phone", "ssn", "iban", "secret")]
    values += [len(body), len(digits), len(re.findall("[A-Za-z]", body)), len(re.findall("[^0-9A-Za-z]", body)), max(1, len(set(digits)))]
    return [*map(float, values), float(bool(re.search(CUES, before))), float(bool(re.search(ANTI_CUES, before)))]


def _grow(rows: list[tuple[list[float], float, float]], depth: int) -> tuple | float:
    """A regression tree on (features, gradient, curvature); leaves are Newton steps."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = (1e-6, 0, 0.0)
    if depth:
        for f in range(len(FEATURES)):
            ordered = sorted(rows, key=lambda r: r[0][f])
            left_g = left_h = 0.0
            for a, b in zip(ordered, ordered[1:], strict=False):
                left_g += a[1]
                left_h += a[2]
                if a[0][f] < b[0][f] and min(left_h, h - left_h) > 1:
                    gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                    if gain > best[0]:
                        best = (gain, f, (a[0][f] + b[0][f]) / 2)
    if best[0] <= 1e-6:
        return g / (h + 1)
    _, f, cut = best
    return f, cut, _grow([r for r in rows if r[0][f] < cut], depth - 1), _grow([r for r in rows if r[0][f] >= cut], depth - 1)


def _value(tree: tuple | float, x: list[float]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] < tree[1] else tree[3]
    return tree


@lru_cache(1)
def model(trees: int = 24, depth: int = 3, rate: float = 0.3, recall: float = 0.95) -> tuple[list, float]:
    """Boosted trees by logistic loss, and the threshold on their score: the largest that keeps
    the stated recall on the fifth of the rows held back for calibration."""
    rows = training_rows()
    fit, hold = rows[len(rows) // 5 :], rows[: len(rows) // 5]
    scores, out = [0.0] * len(fit), []
    for _ in range(trees):
        chance = [1 / (1 + math.exp(-s)) for s in scores]
        tree = _grow([(x, y - p, p * (1 - p)) for (x, y), p in zip(fit, chance, strict=True)], depth)
        out.append(tree)
        scores = [s + rate * _value(tree, x) for s, (x, _) in zip(scores, fit, strict=True)]
    held = sorted(sum(rate * _value(t, x) for t in out) for x, y in hold if y)
    return out, held[int((1 - recall) * len(held))]


def compiled(tree: tuple | float, columns: dict[str, Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, low, high = tree
    return F.when(columns[FEATURES[f]] < cut, compiled(low, columns)).otherwise(compiled(high, columns))


def wider_spans(text: Column, rate: float = 0.3) -> Column:
    """Wider candidates whose score reaches the threshold."""
    trees, threshold = model()
    none = F.array().cast("array<struct<start:int,rank:int,stop:int,body:string>>")
    kinds = []
    for kind, pattern in WIDER:
        kinds.append(F.when(F.rlike(text, F.lit(pattern)), _as_spans(kind, located(text, pattern))).otherwise(none))

    def chosen(s: Column) -> Column:
        width = F.least(s["start"], F.lit(CONTEXT_CHARS))
        x = features(s["rank"], s["body"], F.substring(text, s["start"] - width + 1, width))
        total = compiled(trees[0], x)
        for t in trees[1:]:
            total = total + compiled(t, x)
        return total * rate >= threshold

    return F.filter(F.concat(*kinds), chosen)


def find_pii(docs: DataFrame) -> DataFrame:
    """Per document: the base spans of each kind and all spans, as arrays of (start, rank, stop, body)
    sorted by start, then kind; a wider span that lies inside a base one gives way to it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"), *[c.alias(k) for k, c in base_spans(text).items()], wider_spans(text).alias("wider"))
    found = found.withColumn("base", F.array_sort(F.concat(*KINDS)))
    marked = lambda spans, own: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), F.lit(own).alias("wider"), x.alias("span")))
    both = F.array_sort(F.array_distinct(F.concat(marked(F.col("base"), 0), marked(F.col("wider"), 1))))
    found = found.withColumn("both", F.when(F.size("wider") > 0, both))
    # the furthest end of the base spans that start no later
    reach = running(F.transform("both", lambda x: F.when(x["wider"] == 0, x["span"]["stop"]).otherwise(0)), F.greatest)
    kept = F.filter(F.zip_with("both", reach, lambda x, e: F.when((x["wider"] == 0) | (e < x["span"]["stop"]), x["span"])), lambda x: x.isNotNull())
    return found.withColumn("spans", F.when(F.size("wider") > 0, F.array_sort(F.array_distinct(kept))).otherwise(F.array_distinct("base"))).drop("both")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["stop"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """A column `text`: the texts of `docs` with each span's characters replaced by its kind in brackets; overlapping spans merge."""
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    found = find_pii(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")).select("text", "spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        mark = F.when(s["start"] < acc["at"], F.lit("")).otherwise(F.concat(gap, F.lit("["), F.get(names, s["rank"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    end = lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    return found.select(F.aggregate("spans", start, step, end).alias("text"))
